"""Language-model scores from a class bigram model (Brown et al. 1992) with distributed exchange clustering.

P(w_i | w_{i-1}) = P(g_i | g_{i-1}) P(w_i | g_i), where g is a word's class; each document ends with an end token,
which also stands before its first word.

* Vocabulary: every word that occurs ``MIN_COUNT`` times or more in training, however many there are. All rarer and all unseen words share one class; the
  end token has a class alone.
* Exchange clustering moves each word of the vocabulary to the class that raises the likelihood of the class bigrams most. The ``LEADERS`` most
  frequent words are exchanged one by one on the driver, which is a start for all; then come sweeps over the whole vocabulary (as Uszkoreit and
  Brants 2008 do): tasks count, for each word, the classes before and behind it; Spark adds the counts up by word; a word's task compares all classes, with
  the table of class bigrams as it was before the sweep. From the second sweep on, half of the words may move at a time, since
  words that move together can lose what each would gain alone; a sweep that lowers the likelihood is undone, and half as many words may move in those after it. Sweeps go on until
  what one raises the likelihood, for its share of the words, is less than ``SETTLED`` a token, or until an undone one moved an eighth: there is no limit on their number, and as the
  likelihood is bounded they end.
* P(g | g') = (n(g', g) + C P(g)) / (n(g') + C) with P(g) = (n(g) + 1) / (N + C), C the number of classes;
  P(w | g) = (c(w) + 1) / (n(g) + V(g)), V(g) the distinct words of g, and one more for all unseen words where g is the class of rare ones.

All counts are over every token of every training document. What a task holds has a size bound: the words of the vocabulary if they are
``HEAD`` at most (a hash and its place, some 14 bytes each, where texts become numbers; one byte, the class, in the counts of a sweep; some 20 in the score), bigrams of leaders, and (classes)^2 numbers. The driver has hash, count and class of these words,
and gets one byte a word from a sweep. A task adds up what these words give and sends each document's other words to the counts by a shuffle. A larger vocabulary stays distributed: word bigrams are counted once, and
classes come to them by shuffled joins in every sweep and in the score; results are the same. There the ``HEAVY`` most frequent words meet their classes by a
broadcast, so no join gathers a frequent word's rows. Training texts are split into words twice: for the counts, and into the numbers of their words, which sweeps read.

Words: runs of characters other than 20 and 09-0D, A-Z as a-z, told apart by a 64-bit hash. Null or empty text: the end
token only. A null doc_id trains and isn't held out. Rows that repeat are scored, and counted, each. No training rows: every
count is 0 and the formulas hold. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm import _bytes as B
from tidewater.llm._frames import docs, stored

U = np.uint64
#: HEAD + 1 fits into three bytes (see ``coded``).
LEADERS, HEAD, MIN_COUNT = 1000, 1 << 23, 3
#: Words that a shuffled join doesn't gather: any other word is less than 1 / HEAVY of all.
HEAVY = 1 << 16
#: Exchange has settled when a sweep raises the log-likelihood (natural logarithm) by less than so much a token.
SETTLED = 0.005
#: Classes that exchange deals with; then the class of rare words and the end token's.
MOVING = 62
RARE, STOP, CLASSES = MOVING, MOVING + 1, MOVING + 2
#: Hashes that stand for the end token, and for all words that have no class of their own.
END, OTHER = U(0x5851F42D4C957F2D), U(0x14057B7EF767814F)
WIDTH = 2 * CLASSES
#: Gains by counts up to this are looked up.
EASY = 8
#: Tokens whose counts a task packs at once, and tokens for each range of words that meets in one place.
PACKED, RANGE = 3_000_000, 1_000_000


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of each token, end tokens included, in order."""
    n = len(offs) - 1
    low = B.LOWER[data]
    starts, ends, doc = B.words(low, offs)
    h = B.span_hash(low, starts, ends)
    at = np.cumsum(np.bincount(doc, minlength=n))
    return np.insert(doc, at, np.arange(n)), np.insert(h, at, END)


def word_counts(train: DataFrame) -> DataFrame:
    """h, n of every word of ``train`` (doc_id, text), the end token included."""

    def run(batches):
        for batch in batches:
            for _, _, data, offs in B.text_pieces(batch):
                own, n = np.unique(tokens(data, offs)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n, pa.int64())], ["h", "n"])

    return stored(train.mapInArrow(B.trimmed(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))


def before(s: np.ndarray, end: int) -> np.ndarray:
    """The symbol before each; documents are in a row, each closed by the end token, which so stands before the next one's first."""
    out = np.empty_like(s)
    out[:1] = end
    out[1:] = s[:-1]
    return out


@dataclass
class Table:
    """Classes of words for a task: ``keys`` are hashes, ascending; a word that isn't there is rare."""

    keys: np.ndarray
    classes: np.ndarray
    starts: np.ndarray | None = field(default=None)

    def __getstate__(self):
        return self.__dict__ | {"starts": None}

    def place(self, h: np.ndarray) -> np.ndarray:
        """Each word's place, -1 for none."""
        bits = max(1, len(self.keys).bit_length())
        if self.starts is None:
            # Hashes are even, so that their first bits lead to about one key.
            self.starts, step = np.empty((1 << bits) + 1, np.int32), 1 << 16
            self.starts[-1] = len(self.keys)
            for x in range(0, 1 << bits, step):
                first = np.arange(x, min(x + step, 1 << bits), dtype=U) << U(64 - bits)
                self.starts[x : x + len(first)] = np.searchsorted(self.keys, first)
        out = np.full(len(h), -1, np.int64)
        spot = (h >> U(64 - bits)).astype(np.int64)
        at, end = self.starts[spot], self.starts[spot + 1]
        live = np.flatnonzero(at < end)
        while len(live):
            own, wanted = self.keys[at[live]], h[live]
            found = live[own == wanted]
            out[found] = at[found]
            live = live[own < wanted]
            at[live] += 1
            live = live[at[live] < end[live]]
        return out

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's place (-1 for none) and class."""
        at = self.place(h)
        other = np.where(h == END, STOP, RARE)
        return at, np.where(at >= 0, self.classes[at], other) if len(self.keys) else other


def coded(train: DataFrame, sent: Broadcast) -> DataFrame:
    """ids: the places in the keys of ``sent`` (a Table) of the words of each run of texts, three bytes each; len(keys) stands for other words, one more for the end. Written."""

    def run(batches):
        table = sent.value
        v = len(table.keys)
        for batch in batches:
            for _, _, data, offs in B.text_pieces(batch):
                h = tokens(data, offs)[1]
                at = table.place(h)
                at = np.where(h == END, v + 1, np.where(at >= 0, at, v)).astype("<u4")
                yield pa.RecordBatch.from_arrays([pa.array([at.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()], pa.binary())], ["ids"])

    return stored(train.mapInArrow(B.trimmed(run), "ids binary"))


def _ids(batch: pa.RecordBatch):
    """The numbers of each run of ``coded``."""
    for x in batch.column(0):
        three = np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, 3)
        four = np.zeros((len(three), 4), np.uint8)
        four[:, :3] = three
        yield four.view("<u4").ravel().astype(np.int64)


def bigram_table(runs: DataFrame, group: np.ndarray, size: int) -> np.ndarray:
    """Counts of (symbol before, symbol) over ``runs`` (see ``coded``): size * size numbers from each task. ``group`` has each number's symbol; size - 1 is the end."""
    sent = runs.sparkSession.sparkContext.broadcast(group)

    def run(batches):
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            for ids in _ids(batch):
                s = sent.value[ids].astype(np.int64)
                total += np.bincount(before(s, size - 1) * size + s, minlength=size * size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["pair", "n"])

    return _square(runs.mapInArrow(B.trimmed(run), "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")), size)


def _square(pairs: DataFrame, size: int) -> np.ndarray:
    got = pairs.toArrow()  # (pair, n): size * size rows at most
    out = np.zeros(size * size)
    out[np.asarray(got.column("pair"))] = np.asarray(got.column("n"))
    return out.reshape(size, size)


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(n: np.ndarray) -> float:
    """What the likelihood of the class bigrams depends on."""
    return float(xlogx(n).sum() - xlogx(n.sum(0)).sum() - xlogx(n.sum(1)).sum())


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = 10) -> np.ndarray:
    """Class of each symbol, moved one by one; the last two symbols' classes are ``classes`` - 2 and ``classes`` - 1 and no other's."""
    m, k = len(bigrams), classes - 2
    weight = bigrams.sum(0) + bigrams.sum(1)
    order = np.argsort(-weight[:-2], kind="stable")
    g = np.empty(m, np.int64)
    g[order] = np.arange(m - 2) % max(k, 1)
    g[-2:] = k, k + 1
    by_class = np.zeros((m, classes))
    by_class[np.arange(m), g] = 1
    n = by_class.T @ bigrams @ by_class
    for _ in range(sweeps):
        moved = 0
        for w in order:
            if not weight[w]:
                continue
            own, out, into, loop = g[w], np.bincount(g, bigrams[w], minlength=classes), np.bincount(g, bigrams[:, w], minlength=classes), bigrams[w, w]
            out[own] -= loop
            into[own] -= loop
            # The table without w, and what each class would gain by taking it.
            n[own, :] -= out
            n[:, own] -= into
            n[own, own] -= loop
            rows, cols = n.sum(1), n.sum(0)
            new_rows, new_cols = n + out[None, :], n + into[:, None]
            gain = (xlogx(new_rows) - xlogx(n)).sum(1) + (xlogx(new_cols) - xlogx(n)).sum(0)
            d = np.arange(classes)
            both = n[d, d] + out[d] + into[d] + loop
            gain += xlogx(both) - xlogx(new_rows[d, d]) - xlogx(new_cols[d, d]) + xlogx(n[d, d])
            gain -= xlogx(rows + out.sum() + loop) - xlogx(rows) + xlogx(cols + into.sum() + loop) - xlogx(cols)
            best = int(np.argmax(gain[:k]))
            if gain[best] <= gain[own] + 1e-9:
                best = own
            n[best, :] += out
            n[:, best] += into
            n[best, best] += loop
            moved += best != own
            g[w] = best
        if not moved:
            break
    return g


class Gains:
    """What the likelihood gains when counts are added to the table ``n`` of class bigrams, or taken from it.

    Columns 0 to CLASSES - 1 stand for classes behind a word, the others for those before it.
    """

    def __init__(self, n: np.ndarray):
        self.both = np.concatenate((n, n.T), 1)  # class, column
        self.margins = np.stack((n.sum(1), n.sum(0)))
        cells = self.both[:MOVING].T  # column, class to move to
        self.easy = np.stack([xlogx(cells + x) - xlogx(cells) for x in range(EASY + 1)])

    def best(self, word: np.ndarray, k: np.ndarray, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The best of the moving classes for each word, from its counts ``x`` in columns ``k``, sorted by ``word`` (0, 1, ...); ``own`` are the words'
        classes, with the words in the table. Only a real gain moves a word."""
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        add = self.easy[np.minimum(x, EASY), k]
        large = np.flatnonzero(x > EASY)
        cells = self.both[:MOVING].T[k[large]]
        add[large] = xlogx(cells + x[large, None]) - xlogx(cells)
        take = np.add.reduceat(add, first, axis=0)
        # What the class that a word is in would lose without it.
        here = self.both[own[word], k]
        stay = np.add.reduceat(xlogx(here) - xlogx(np.maximum(here - x, 0)), first)
        for side, cols in ((0, k < CLASSES), (1, k >= CLASSES)):
            total = np.add.reduceat(np.where(cols, x, 0), first)
            m = self.margins[side]
            take -= xlogx(m[None, :MOVING] + total[:, None]) - xlogx(m[None, :MOVING])
            stay -= xlogx(m[own]) - xlogx(np.maximum(m[own] - total, 0))
        inside = np.flatnonzero(own < MOVING)
        take[inside, own[inside]] = stay[inside]
        best = take.argmax(1)
        better = take[np.arange(len(own)), best] > np.where(own < MOVING, stay, -np.inf) + 1e-9
        return np.where(better, best, own)


def _moved(h: np.ndarray, now: np.ndarray, word: np.ndarray, k: np.ndarray, x: np.ndarray, gains: Gains, nth: int, share: int) -> np.ndarray:
    """The classes of the words ``h``, now in ``now``, after the ``nth`` sweep, in which one of ``share`` may move; their counts ``x`` in columns ``k`` are sorted by ``word``
    (0, 1, ...). Each word has its turn once in ``share`` sweeps."""
    free = (B.mix(h.view(U) + U(nth // share)) >> U(40)) % U(share) == U(nth % share)
    out, some = now.copy(), np.flatnonzero(free)
    if len(some):
        keep = free[word]
        out[some] = gains.best((np.cumsum(free) - 1)[word[keep]], k[keep], x[keep], now[some])
    return out


def swept(runs: DataFrame, known: Broadcast, classes: np.ndarray, n: np.ndarray, nth: int, share: int) -> np.ndarray:
    """The class of every key of ``known`` (a Table) after a sweep over ``runs`` (see ``coded``); ``classes`` are those before it, ``n`` is the table of class bigrams.

    A task counts, for each word, the classes behind it (columns 0 to CLASSES - 1) and before it, and packs the counts of a range of words into one value; the ranges meet by a shuffle,
    where a task adds them up and compares the classes.
    """
    sent = runs.sparkSession.sparkContext.broadcast((classes, n))
    parts, v = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(classes)
    width = max(1, -(-v // max(2 * parts, int(n.sum()) // RANGE)))  # words of a range

    def count(batches):
        found, held = [], 0
        group = np.concatenate((sent.value[0], [RARE, STOP])).astype(np.int8)

        def leave():
            x = np.concatenate(found)
            found.clear()
            x.sort()
            first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]][: len(x)])
            own, n = x[first], np.diff(np.r_[first, len(x)])
            del x
            at = np.arange(0, -(-v // width) + 1) * width * WIDTH
            cut = np.searchsorted(own, at)
            out = []
            for i in np.flatnonzero(np.diff(cut)):
                x = own[cut[i] : cut[i + 1]]
                # Steps and counts are small: as planes of bytes, most of which are zeros.
                planes = np.stack((np.diff(x, prepend=at[i]), n[cut[i] : cut[i + 1]])).astype("<u4").view(np.uint8).reshape(2, -1, 4).transpose(0, 2, 1)
                out.append((int(i), len(x).to_bytes(4, "little") + pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)))
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())], ["span", "packed"])

        for batch in batches:
            for at in _ids(batch):
                # A document's last token is the end, which stands before the first word of the next; a run begins and ends with a document.
                s = group[at].astype(np.int64)
                word = at < v
                key = at * WIDTH
                found += [(key[:-1] + s[1:])[word[:-1]], (key + CLASSES + before(s, STOP))[word]]
                held += len(s)
                if held > PACKED:
                    yield leave()
                    held = 0
        if found:
            yield leave()

    def solve(batches):
        keys, (classes, n) = known.value.keys, sent.value
        gains = Gains(n)

        def done(span, blobs):
            own, x = [], []
            for b in blobs:
                size = int.from_bytes(b[:4], "little")
                planes = np.frombuffer(pa.decompress(b[4:], 8 * size, codec="zstd", asbytes=True), np.uint8).reshape(2, 4, size)
                step, c = np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u4")[..., 0]
                own.append(np.cumsum(step.astype(np.int64)) + span * width * WIDTH)
                x.append(c)
            own, at = np.unique(np.concatenate(own), return_inverse=True)
            x = np.bincount(at, np.concatenate(x)).astype(np.int64)
            place, word = np.unique(own // WIDTH, return_inverse=True)
            g = classes[span * width : (span + 1) * width].copy()
            g[place - span * width] = _moved(keys[place], classes[place].astype(np.int64), word, own % WIDTH, x, gains, nth, share)
            return pa.RecordBatch.from_arrays([pa.array([span], pa.int32()), pa.array([g.tobytes()], pa.binary())], ["span", "g"])

        now, blobs = None, []
        for batch in batches:
            for span, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if span != now and blobs:
                    yield done(now, blobs)
                    blobs = []
                now = span
                blobs.append(blob)
        if blobs:
            yield done(now, blobs)

    packed = runs.mapInArrow(B.trimmed(count), "span int, packed binary")
    out = classes.copy()
    # One byte a word.
    for span, g in packed.repartition(parts, "span").sortWithinPartitions("span").mapInArrow(B.trimmed(solve), "span int, g binary").collect():
        out[span * width : (span + 1) * width] = np.frombuffer(g, np.int8)
    return out


def _table_of(counts: DataFrame) -> np.ndarray:
    """The table of class bigrams from counts (h, g, k, n)."""
    return _square(counts.filter(F.col("k") < CLASSES).groupBy((F.col("g") * CLASSES + F.col("k")).alias("pair")).agg(F.sum("n").alias("n")), CLASSES)


def word_bigrams(train: DataFrame) -> DataFrame:
    """a, b, n of every pair of words in a row, the end token before a document's first."""

    def run(batches):
        for batch in batches:
            for _, _, data, offs in B.text_pieces(batch):
                _, h = tokens(data, offs)
                own, n = np.unique(np.stack([before(h, END), h], 1), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own[:, 0].view(np.int64)), pa.array(own[:, 1].view(np.int64)), pa.array(n, pa.int64())], ["a", "b", "n"])

    return stored(train.mapInArrow(B.trimmed(run), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")))


def _met(rows: DataFrame, key: str, found: DataFrame, heavy: DataFrame) -> DataFrame:
    """``rows`` and what ``found`` (c_h, ...) has for the hash in ``key``, null where it has none. Words of ``heavy`` (t_h, at most HEAVY) meet theirs by a
    broadcast, the end token too; their rows are then spread over all tasks of the shuffled join for the others."""
    others = [c for c in found.columns if c != "c_h"]
    frequent = F.col("c_h") == F.col("t_h")
    top = found.join(F.broadcast(heavy), frequent).select("t_h", *[F.col(c).alias(f"t_{c}") for c in others])
    rest = found.join(F.broadcast(heavy), frequent, "left_anti").withColumn("c_free", F.lit(True))
    own = rows.join(F.broadcast(top), F.col(key) == F.col("t_h"), "left")
    own = own.withColumn("m_free", F.col("t_h").isNull() & (F.col(key) != F.lit(int(END.view(np.int64)))))
    own = own.withColumn("m_key", F.when(F.col("m_free"), F.col(key)).otherwise(F.xxhash64(*rows.columns)))
    met = own.join(rest, (F.col("m_key") == F.col("c_h")) & (F.col("m_free") == F.col("c_free")), "left")
    return met.select(*rows.columns, *[F.coalesce(f"t_{c}", c).alias(c) for c in others])


def _heavy(counts: DataFrame) -> DataFrame:
    """The most frequent words of ``counts`` (h, n)."""
    return stored(counts.orderBy(F.desc("n"), "h").limit(HEAVY).select(F.col("h").alias("t_h")))


def _classed(pairs: DataFrame, classes: DataFrame, heavy: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) and the classes ga, gb of both words, and whether they are words of ``classes`` (h, g): in_a, in_b."""
    other = lambda x: F.coalesce(F.col("c_g"), F.when(F.col(x) == F.lit(int(END.view(np.int64))), STOP).otherwise(RARE))
    for x in "ab":
        met = _met(pairs, x, classes.select(F.col("h").alias("c_h"), F.col("g").alias("c_g")), heavy)
        pairs = met.withColumns({f"g{x}": other(x), f"in_{x}": F.col("c_g").isNotNull() & (F.col("c_g") != STOP)}).drop("c_g")
    return pairs


def sweep(counts: DataFrame, n: np.ndarray, nth: int, share: int) -> DataFrame:
    """The same as ``swept`` from counts (h, g, k, n: how often class k, or CLASSES + k for the one before, stands beside a word of class g), where the vocabulary is too large for tasks."""
    sent = counts.sparkSession.sparkContext.broadcast(n)

    def run(batches):
        gains = Gains(sent.value)

        def solve(h, g, k, x):
            new = np.r_[True, h[1:] != h[:-1]]
            own, now = h[new], g[new].astype(np.int64)
            out = _moved(own, now, np.cumsum(new) - 1, k, x, gains, nth, share)
            real = (own != END.view(np.int64)) & (own != OTHER.view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(own[real]), pa.array(out[real].astype(np.int32))], ["h", "g"])

        held: list = []
        size = 0
        for batch in batches:
            held.append(tuple(np.asarray(c) for c in batch.columns))
            size += batch.num_rows
            if size > 100_000:
                cols = [np.concatenate(x) for x in zip(*held)]
                cut = int(np.searchsorted(cols[0], cols[0][-1]))
                if cut:
                    yield solve(*(c[:cut] for c in cols))
                held, size = [tuple(c[cut:] for c in cols)], len(cols[0]) - cut
        if size:
            yield solve(*(np.concatenate(x) for x in zip(*held)))

    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(counts.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(B.trimmed(run), "h long, g int"))


def clustered(train: DataFrame, vocabulary: DataFrame, known: Broadcast | None, settled: float = SETTLED) -> tuple[DataFrame | np.ndarray, np.ndarray]:
    """The class of every word of ``vocabulary`` (h, n; not the end token), and the table of class bigrams. ``known``, if the vocabulary fits into tasks, is a Table of its words, and their
    classes come in its order, else as h, g."""
    spark = train.sparkSession
    top = vocabulary.orderBy(F.desc("n"), "h").limit(LEADERS).toArrow()
    lead = np.sort(np.asarray(top.column("h")).view(U))
    m = len(lead)
    # Leaders as symbols 0 to m - 1, then all other words, then the end.
    table = known or spark.sparkContext.broadcast(Table(lead, np.zeros(0, np.int8)))
    keys, runs = table.value.keys, coded(train, table)
    symbols, place = np.full(len(keys) + 2, m, np.int16), np.searchsorted(keys, lead)
    symbols[place], symbols[-1] = np.arange(m), m + 1
    g = exchange(bigram_table(runs, symbols, m + 2), CLASSES)
    if known:
        classes = np.full(len(keys), RARE, np.int8)
        classes[place] = g[:m]
    else:
        start = spark.createDataFrame(list(zip(lead.view(np.int64).tolist(), g[:m].tolist())), "s_h long, s_g int")
        classes = stored(vocabulary.join(F.broadcast(start), F.col("h") == F.col("s_h"), "left").select("h", F.coalesce("s_g", F.lit(RARE)).alias("g")))
        bigrams, heavy = word_bigrams(train), _heavy(vocabulary)

    def counted(classes):
        met = _classed(bigrams, classes, heavy)
        name = lambda x: F.when(F.col(f"g{x}") == STOP, F.lit(int(END.view(np.int64)))).when(F.col(f"in_{x}"), F.col(x)).otherwise(F.lit(int(OTHER.view(np.int64))))
        behind = met.select(name("a").alias("h"), F.col("ga").alias("g"), F.col("gb").alias("k"), "n")
        prior = met.filter("in_b").select(F.col("b").alias("h"), F.col("gb").alias("g"), (F.col("ga") + CLASSES).alias("k"), "n")
        return stored(behind.unionByName(prior).groupBy("h", "g", "k").agg(F.sum("n").alias("n")))

    kept, nth, share = None, 0, 1  # classes, table, likelihood and counts before the last sweep
    while True:
        counts = None
        if known:
            n = bigram_table(runs, np.concatenate((classes, [RARE, STOP])).astype(np.int8), CLASSES)
        else:
            counts = counted(classes)
            n = _table_of(counts)
        if not n.sum():
            return classes, n
        value = likelihood(n)
        # The first sweep takes words out of the class of rare ones, so that it isn't compared.
        if nth > 1 and value < kept[2]:
            if share >= 8:
                return kept[:2]
            classes, n, value, counts = kept
            share *= 2
        elif nth > 1 and (value - kept[2]) * share / 2 < settled * n.sum():
            return classes, n
        elif nth == 1:
            share = 2
        kept = (classes, n, value, counts)
        classes = swept(runs, known, classes, n, nth, share) if known else sweep(counts, n, nth, share)
        nth += 1


@dataclass
class Model:
    """``words`` (h, n, g) has every word of training. ``known``, if those that aren't rare fit into tasks, has them and the end token, and ``counts`` theirs;
    ``step`` is log10 P(g | g') less log10 of the denominator of P(w | g), [g', g]."""

    words: DataFrame
    known: Table | None
    counts: np.ndarray | None
    step: np.ndarray
    n_tokens: int
    n_distinct: int

    @property
    def whole(self) -> bool:
        """Whether the words that aren't rare fit into tasks."""
        return self.known is not None


def _looked_up(counts: DataFrame, known: Table) -> DataFrame:
    """``counts`` (h, n) and the class g of each word."""
    sent = counts.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        for batch in batches:
            g = sent.value.find(np.asarray(batch.column(0)).view(U))[1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(g.astype(np.int32))], ["h", "n", "g"])

    return counts.select("h", "n").mapInArrow(B.trimmed(run), "h long, n long, g int")


def fit(train: DataFrame, settled: float = SETTLED) -> Model:
    """The model of ``train`` (doc_id, text)."""
    end = int(END.view(np.int64))
    counts = word_counts(train)
    vocabulary = counts.filter((F.col("n") >= MIN_COUNT) & (F.col("h") != F.lit(end)))
    if vocabulary.count() <= HEAD:
        keys, c = _fetched(vocabulary)
        classes, table = clustered(train, vocabulary, train.sparkSession.sparkContext.broadcast(Table(keys, np.zeros(0, np.int8))), settled)
        words = stored(_looked_up(counts, Table(keys, classes)))
        ends, at = counts.filter(F.col("h") == end).first(), np.searchsorted(keys, END)
        if ends:
            keys, classes, c = np.insert(keys, at, END), np.insert(classes, at, STOP), np.insert(c.astype(np.int64), at, ends["n"])
        known, c = Table(keys, classes), _narrow(c)
    else:
        classes, table = clustered(train, vocabulary, None, settled)
        words = counts.join(classes.withColumnRenamed("h", "c_h"), F.col("h") == F.col("c_h"), "left")
        words = stored(words.select("h", "n", F.coalesce("g", F.when(F.col("h") == F.lit(end), STOP).otherwise(RARE)).alias("g")))
        known = c = None
    n, v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in words.groupBy("g").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():  # CLASSES rows
        n[r["g"]], v[r["g"]] = r["n"], r["v"]
    alone = (n + 1) / (n.sum() + CLASSES)
    unseen = np.arange(CLASSES) == RARE
    step = np.log10((table + CLASSES * alone[None, :]) / (table.sum(1)[:, None] + CLASSES)) - np.log10(np.maximum(n + v + unseen, 1))[None, :]
    return Model(words, known, c, step, int(n.sum()), int(v.sum()))


def _narrow(c: np.ndarray) -> np.ndarray:
    """Counts in as few bytes as the largest takes."""
    return c.astype(np.min_scalar_type(int(c.max(initial=0))))


def _fetched(vocabulary: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and counts of the words of ``vocabulary``, HEAD at most."""
    got = vocabulary.select("h", "n").toArrow()
    h, c = np.asarray(got.column("h")).view(U), _narrow(np.asarray(got.column("n")))
    del got
    o = np.argsort(h)
    return h[o], c[o]


def _scores(sums: DataFrame, model: Model) -> DataFrame:
    base = F.col("counted") - F.col("n_tokens") * F.lit(float(np.log10(model.n_tokens + model.n_distinct + 1)))
    out = sums.withColumn("base_score", base).withColumn("score", F.col("counted") + F.col("walk"))
    return out.select("doc_id", "n_tokens", "n_known", "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def score(df: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score, perplexity of every row of ``df`` (doc_id, text)."""
    if not model.whole:
        return _score_by_joins(df, model)
    sent = df.sparkSession.sparkContext.broadcast((model.known, model.counts, model.step))
    kind = "row long, doc_id long, h long, n_tokens long, n_known long, counted double, walk double, tf long"

    def run(batches):
        from pyspark import TaskContext

        table, counts, step = sent.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, b, data, offs in B.text_pieces(batch):
                n = b - a
                doc, h = tokens(data, offs)
                at, g = table.find(h)
                walk = step[before(g, STOP), g]
                known = at >= 0
                ids = row + np.arange(n)
                row += n
                zero = np.zeros(n, np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids), batch.column(0)[a:b].cast(pa.int64()), pa.array(B.mix(ids.astype(U)).view(np.int64)), pa.array(np.bincount(doc, minlength=n)),
                    pa.array(np.bincount(doc[known], minlength=n)), pa.array(np.bincount(doc[known], np.log10(counts[at[known]] + 1.0), minlength=n) + 0.0), pa.array(np.bincount(doc, walk, minlength=n) + 0.0), pa.array(zero),
                ], ["row", "doc_id", "h", "n_tokens", "n_known", "counted", "walk", "tf"])
                # Words outside the vocabulary, each rare or new: one row for each document and word.
                doc, h = doc[~known], h[~known]
                o = np.lexsort((h, doc))
                doc, h = doc[o], h[o]
                new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])][: len(h)])
                tf = np.diff(np.r_[new, len(h)])
                k = len(new)
                z, zf = pa.array(np.zeros(k, np.int64)), pa.array(np.zeros(k))
                yield pa.RecordBatch.from_arrays([pa.array(ids[doc[new]]), pa.nulls(k, pa.int64()), pa.array(h[new].view(np.int64)), z, z, zf, zf, pa.array(tf)], ["row", "doc_id", "h", "n_tokens", "n_known", "counted", "walk", "tf"])

    rows = df.mapInArrow(B.trimmed(run), kind)
    c = model.words.filter(F.col("g") == RARE).select("h", F.col("n").alias("c"))
    met = rows.join(c, "h", "left")
    sums = met.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("n_tokens").alias("n_tokens"),
        (F.sum("n_known") + F.sum(F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0))).alias("n_known"),
        (F.sum("counted") + F.sum(F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + 1.0))).alias("counted"),
        F.sum("walk").alias("walk"),
    )
    return _scores(sums, model)


def _score_by_joins(df: DataFrame, model: Model) -> DataFrame:
    """The same where the vocabulary is too large for a task: each document's bigrams meet counts and classes by shuffles."""

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, b, data, offs in B.text_pieces(batch):
                doc, h = tokens(data, offs)
                own, first, tf = np.unique(np.stack([doc.astype(U), before(h, END), h], 1), axis=0, return_index=True, return_counts=True)
                ids = batch.column(0)[a:b].cast(pa.int64()).take(pa.array(doc[first]))
                yield pa.RecordBatch.from_arrays([pa.array(row + own[:, 0].astype(np.int64)), ids, pa.array(own[:, 1].view(np.int64)), pa.array(own[:, 2].view(np.int64)), pa.array(tf, pa.int64())], ["row", "doc_id", "a", "b", "tf"])
                row += b - a

    pairs = df.mapInArrow(B.trimmed(run), "row long, doc_id long, a long, b long, tf long")
    heavy = _heavy(model.words)
    known = _classed(pairs, model.words.select("h", "g"), heavy)
    met = _met(known, "b", model.words.select(F.col("h").alias("c_h"), F.col("n").alias("c")), heavy)
    step = F.element_at(F.lit(model.step.ravel().tolist()), F.col("ga") * CLASSES + F.col("gb") + 1)
    sums = met.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("tf").alias("n_tokens"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0)).alias("n_known"),
        F.sum(F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("counted"),
        F.sum(F.col("tf") * step).alias("walk"),
    )
    return _scores(sums, model)


def train_and_score(df: DataFrame, is_train: Column) -> DataFrame:
    """Learn from the rows of ``df`` (doc_id, text) where ``is_train`` (a condition on doc_id) holds, score all; also train_tokens."""
    d = docs(df)
    model = fit(d.filter(is_train))
    return score(d, model).withColumn("train_tokens", F.lit(model.n_tokens).cast("long"))
