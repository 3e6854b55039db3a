"""Term counts, class-based term weights, n-gram vocabulary."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pandas.util import hash_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import lexicon as lx
from tidewater.functions import text as tx
from tidewater.plans.storage import stored


def words_of(column: str, stop: Iterable[str], least: int = 2, split: Callable[[str], Column] | None = None) -> Column:
    """Words of ``least`` characters that aren't stop words: runs of letters and digits, or what ``split`` (such as a segmenter) makes of the lowered text."""
    if split is None:
        return tx.tokens(F.col(column), stop, least)
    stop = list(stop)
    return F.filter(split(F.lower(tx.string(F.col(column)))), lambda w: (F.char_length(w) >= least) & ~w.isin(stop))


def term_counts(df: DataFrame, column: str, stop: Iterable[str] = lx.STOP_WORDS, least: int = 2, split: Callable | None = None) -> DataFrame:
    """word, freq over all rows."""
    words = df.select(words_of(column, stop, least, split).alias("_words")).select(F.explode("_words").alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("freq"))


def class_terms(df: DataFrame, cls: str, column: str, stop: Iterable[str] = lx.STOP_WORDS, k: int = 10, split: Callable | None = None) -> DataFrame:
    """The ``k`` words of each class with the largest tf * ln(1 + A / f): tf in the class, f over all, A mean words of a class. Ties by word."""
    words = df.select(F.col(cls), words_of(column, stop, split=split).alias("_words")).select(cls, F.explode("_words").alias("word"))
    tf = words.groupBy(cls, "word").agg(F.count("*").alias("tf"))
    f = tf.groupBy("word").agg(F.sum("tf").alias("f"))
    mean = tf.agg((F.sum("tf") / F.countDistinct(cls)).alias("a"))  # one row
    weight = F.col("tf") * F.log1p(F.col("a") / F.col("f"))
    scored = tf.join(f, "word").crossJoin(F.broadcast(mean)).select(cls, "word", "tf", weight.alias("weight"))
    w = Window.partitionBy(cls).orderBy(F.round("weight", 9).desc(), F.asc("word"))
    return scored.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


#: Grams that a task's summary holds at first, and candidates of the exact count for each wanted gram.
ROOM, SPARE = 1 << 17, 4


def ngram_vocabulary(df: DataFrame, column: str, size: int = 2000, min_df: int = 3, n: int = 2, stop: Iterable[str] = (), room: int | None = None) -> DataFrame:
    """term, freq, df of the ``size`` most frequent 1- to n-grams found in at least ``min_df`` rows. Ties by term.

    Each task keeps a summary of the most frequent grams (Misra and Gries 1982, merged as by Agarwal et al. 2012): counts that are too low by at most what the summary lost. Summaries add
    up, and so do their losses. The most frequent of the sums are counted exactly in a second pass, their rows found by hash inside the task; if every other gram's bound is
    below the last count that is wanted, the result is proven, else summaries and candidates grow, and at last all grams are counted by a shuffle.
    """
    own = df.select(tx.tokens(F.col(column), stop).alias("_w"))
    room, spare = room or ROOM, SPARE
    for _ in range(3):
        parts = stored(own.mapInArrow(_summaries(n, room), "h long, low long, lost long"))
        sums = parts.filter("h is not null").groupBy("h").agg(F.sum("low").alias("low"))
        top = sums.orderBy(F.desc("low"), "h").limit(size * spare + 1).collect()  # candidates
        lost = parts.agg(F.sum("lost")).first()[0] or 0
        few = len(top) <= size * spare
        cut = lost + (0 if few else top[-1]["low"])
        found = own.mapInArrow(_exact(n, np.sort(np.array([r["h"] for r in top[: size * spare]], np.int64))), "term string, freq long, df long")
        exact = stored(found.groupBy("term").agg(F.sum("freq").alias("freq"), F.sum("df").alias("df")).filter(F.col("df") >= min_df))
        best = exact.orderBy(F.desc("freq"), "term").limit(size)
        last = best.agg(F.min("freq").alias("f"), F.count("*").alias("n")).first()
        if few and not lost or last["n"] == size and cut < last["f"]:
            return best
        room, spare = 4 * room, 4 * spare
    return _all_grams(own, size, min_df, n)


def _hashed(lists: pa.ListArray, n: int):
    """For each k up to ``n``: hash and row of every run of k words of a row, and the places of its words in the flat array; the flat array."""
    flat = lists.flatten().dictionary_encode()
    words = flat.dictionary.to_numpy(zero_copy_only=False)
    own = (hash_array(words, categorize=False) if len(words) else np.zeros(0, np.uint64))[np.asarray(flat.indices)]
    row = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths().fill_null(0)))
    h = own.copy()
    for k in range(1, n + 1):
        if k > 1:
            h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + own[k - 1 :]
        inside = row[: len(h)] == row[k - 1 :]
        at = np.flatnonzero(inside)
        yield k, h[at].view(np.int64), row[at], at, flat


def _summaries(n: int, room: int):
    """Tasks' summaries: h and low (at most its count); a row without h has what was lost, by which any count is at most higher."""

    def run(batches):
        keys, counts, lost = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for b in batches:
            new = np.concatenate([np.zeros(0, np.int64), *(h for _, h, _, _, _ in _hashed(b.column(0), n))])
            own, c = np.unique(new, return_counts=True)
            keys, at = np.unique(np.concatenate((keys, own)), return_inverse=True)
            counts = np.bincount(at, np.concatenate((counts, c)), len(keys)).astype(np.int64)
            if len(keys) > room:
                # Taking the first count that has no room from all others leaves those that have.
                off = int(np.partition(counts, len(counts) - room - 1)[len(counts) - room - 1])
                lost += off
                keys, counts = keys[counts > off], counts[counts > off] - off
        for i in range(0, len(keys), 1 << 16):
            part = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(keys[part]), pa.array(counts[part]), pa.array(np.zeros(len(keys[part]), np.int64))], ["h", "low", "lost"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([0]), pa.array([lost])], ["h", "low", "lost"])

    return run


def _exact(n: int, wanted: np.ndarray):
    """term, freq, df of the grams whose hash is in ``wanted``, of each task."""

    def run(batches):
        total: dict[str, list[int]] = {}
        for b in batches:
            for k, h, row, at, flat in _hashed(b.column(0), n):
                place = np.minimum(np.searchsorted(wanted, h), max(0, len(wanted) - 1))
                ok = np.flatnonzero(wanted[place] == h) if len(wanted) else np.zeros(0, np.int64)
                if not len(ok):
                    continue
                codes = np.asarray(flat.indices)
                place, row, cols = place[ok], row[ok], [codes[at[ok] + j] for j in range(k)]
                places, first, which = np.unique(place, return_index=True, return_inverse=True)
                # Other words under the hash of a gram, which hardly occur, are counted one by one.
                same = np.all([c == c[first][which] for c in cols], axis=0)
                each, freq = np.unique(row[same] * len(places) + which[same], return_counts=True)
                freqs, dfs = np.bincount(each % len(places), freq, len(places)), np.bincount(each % len(places), minlength=len(places))
                name = lambda i, cols=cols, flat=flat: " ".join(flat.dictionary[int(c[i])].as_py() for c in cols)
                found = [(name(i), int(f), int(d)) for i, f, d in zip(first, freqs, dfs, strict=True)]
                odd: dict[tuple[int, str], int] = {}
                for i in np.flatnonzero(~same):
                    odd[int(row[i]), name(i)] = odd.get((int(row[i]), name(i)), 0) + 1
                for term, f, d in [*found, *((t, f, 1) for (_, t), f in odd.items())]:
                    old = total.setdefault(term, [0, 0])
                    old[0] += f
                    old[1] += d
        rows = list(total.items())
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.string()), pa.array([c[0] for _, c in rows], pa.int64()), pa.array([c[1] for _, c in rows], pa.int64())], ["term", "freq", "df"])

    return run


def _all_grams(own: DataFrame, size: int, min_df: int, n: int) -> DataFrame:
    """The same from counts of all grams: 64-bit hashes are counted first, added up inside tasks; strings are made and moved only for the ``size`` most frequent and those that
    tie with the last."""
    every = F.transform("_w", lambda w: F.xxhash64(w))
    for k in range(2, n + 1):
        every = F.concat(every, _grams("_w", k, lambda *ws: F.xxhash64(*ws), "bigint"))
    # In a row's sorted hashes, the first of equals counts the row.
    marked = own.select(F.sort_array(every).alias("_h")).select(F.explode(F.transform("_h", lambda h, i: F.struct(h.alias("h"), (F.when(i > 0, F.get("_h", i - 1)).otherwise(None).eqNullSafe(h)).alias("again")))).alias("g"))
    counts = stored(marked.groupBy("g.h").agg(F.count("*").alias("freq"), F.count_if(~F.col("g.again")).alias("df")).filter(F.col("df") >= min_df))
    last = counts.orderBy(F.desc("freq")).limit(size).agg(F.min("freq")).first()[0]
    wanted = counts.filter(F.col("freq") >= (last or 0))
    pairs = F.transform("_w", lambda w: F.struct(F.xxhash64(w).alias("h"), w.alias("term")))
    for k in range(2, n + 1):
        pairs = F.concat(pairs, _grams("_w", k, lambda *ws: F.struct(F.xxhash64(*ws).alias("h"), F.concat_ws(" ", *ws).alias("term")), "struct<h:bigint,term:string>"))
    named = own.select(F.inline(pairs)).join(wanted, "h").groupBy("h").agg(F.min("term").alias("term"), F.first("freq").alias("freq"), F.first("df").alias("df"))
    return named.select("term", "freq", "df").orderBy(F.desc("freq"), "term").limit(size)


def _grams(words: str, k: int, make: Callable[..., Column], kind: str) -> Column:
    """Array of ``make`` of each run of ``k`` words of the array column."""
    last = F.size(words) - k
    runs = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: make(*[F.get(words, i + j) for j in range(k)]))
    return F.when(last >= 0, runs).otherwise(F.array().cast(f"array<{kind}>"))
