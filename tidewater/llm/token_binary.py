"""Token ids as flat unsigned integers with 64-bit document offsets.

Layout of an output folder, all little-endian:

* ``ids-PPPPP.bin``: the ids of partition P's documents, one after another, as unsigned
  16-bit (vocabularies of at most 65,536 ids) or 32-bit integers;
* ``offsets-PPPPP.bin``: an unsigned 64-bit integer for each of its documents, the number
  of ids of all documents before it, over all partitions; then the end of the last one;
* ``docs-PPPPP.bin``: their doc_ids as signed 64-bit integers, in order.

Documents are in ascending doc_id order over the partitions (range partitioning with a
sort inside, rows with a null doc_id first). A first pass over the sorted partitions writes each
one's ids under a name that holds its attempt, and returns one small row for each file; partition
bases are prefix sums of those rows' counts. A second pass over those rows writes the offsets. A task that is run
again leaves another file; the rows that came back name the one that counts.

Files go through the file system that the folder's URI names (a mounted folder, or any store that pyarrow
knows); a mounted file is mapped into memory when it is read.

The vocabulary drops white space, so a text's ids are those of its words, whatever stands beside them. A worker keeps
the ids of the words that it has met in a hash table of bounded size, so that a frequent word is encoded by the library
once; words are told apart by a 64-bit hash.

A special token's name in a text is that token, as in the library's plain call; texts with ``<|`` are encoded whole by the library.

Null text: the end id alone. Repeated doc_ids: one entry for each row, ties in any order.
An empty table gives files without ids and an empty result.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm import _bytes as B
from tidewater.llm._frames import docs, shared_dir

U = np.uint64

TABLE_WORDS = 3_000_000

MARK = "\x01"
#: What the names of the vocabulary's added tokens begin with.
SPECIAL = b"<|"
MANIFEST = "part int, attempt string, n_docs long, n_ids long"


class WordTable:
    """From 64-bit word hashes to runs of ids: open addressing in flat arrays, a few dozen bytes a word."""

    def __init__(self, kind: str, most: int):
        self.kind, self.most = kind, most
        self.clear()

    def clear(self) -> None:
        self.n, self.n_ids = 0, 0
        self.slots = np.full(1 << 16, -1, np.int32)
        self.keys = np.empty(1 << 15, U)
        self.at = np.zeros((1 << 15) + 1, np.int64)
        self.ids = np.empty(1 << 17, self.kind)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Each hash's entry, or -1."""
        out = np.full(len(h), -1, np.int64)
        mask = U(len(self.slots) - 1)
        live, place = np.arange(len(h)), h & mask
        while len(live):
            entry = self.slots[place]
            got = entry >= 0
            same = got & (self.keys[entry] == h[live])
            out[live[same]] = entry[same]
            on = got & ~same
            live, place = live[on], (place[on] + U(1)) & mask
        return out

    def add(self, h: np.ndarray, lens: np.ndarray, ids: np.ndarray) -> None:
        """New distinct hashes with their runs of ``ids``, one after another."""
        n, total = self.n + len(h), self.n_ids + len(ids)
        while n > len(self.keys):
            self.keys = np.concatenate((self.keys, np.empty_like(self.keys)))
            self.at = np.concatenate((self.at, np.zeros(len(self.at) - 1, np.int64)))
        while total > len(self.ids):
            self.ids = np.concatenate((self.ids, np.empty_like(self.ids)))
        self.keys[self.n : n] = h
        self.at[self.n + 1 : n + 1] = self.n_ids + np.cumsum(lens)
        self.ids[self.n_ids : total] = ids
        first, self.n, self.n_ids = self.n, n, total
        if 2 * n > len(self.slots):
            self.slots = np.full(1 << int(4 * n - 1).bit_length(), -1, np.int32)
            first = 0
        mask = U(len(self.slots) - 1)
        entry = np.arange(first, n)
        place = self.keys[first:n] & mask
        while len(entry):
            free = self.slots[place] < 0
            self.slots[place[free]] = entry[free]  # of several for one slot the last stays; the others go on
            rest = self.slots[place] != entry
            entry, place = entry[rest], (place[rest] + U(1)) & mask

    def runs(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length of each entry's run, and all runs' ids, one after another."""
        start = self.at[entries]
        lens = self.at[entries + 1] - start
        ends = np.cumsum(lens)
        return lens, self.ids[np.repeat(start - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)]


class WordIds:
    """Ids of runs of texts."""

    def __init__(self, path: str, width: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        if any(not t.content.startswith(SPECIAL.decode()) for t in self.tok.get_added_tokens_decoder().values()):
            raise ValueError(f"an added token doesn't begin with {SPECIAL!r}")
        (self.mark,) = self.tok.encode(MARK, add_special_tokens=False).ids
        self.kind = f"<u{width}"
        self.table = WordTable(self.kind, TABLE_WORDS)

    def narrow(self, ids: list[int]) -> np.ndarray:
        return np.array(ids, self.kind)

    def learn(self, h: np.ndarray, words: list[str]) -> None:
        """Words with ``MARK`` inside are encoded alone, the others in one line with a word between them whose only id nothing else there has."""
        odd = np.array([MARK in w for w in words], bool)
        for i in np.flatnonzero(odd):
            ids = self.narrow(self.tok.encode(words[i], add_special_tokens=False).ids)
            self.table.add(h[i : i + 1], np.array([len(ids)]), ids)
        plain = np.flatnonzero(~odd)
        if len(plain):
            line = f" {MARK} ".join([words[i] for i in plain])
            ids = self.narrow(self.tok.encode_batch_fast([line], add_special_tokens=False)[0].ids)
            cut = np.flatnonzero(ids == self.mark)
            lens = np.diff(np.concatenate(([-1], cut, [len(ids)]))) - 1
            self.table.add(h[plain], lens, np.delete(ids, cut))

    def encode(self, data: np.ndarray, offs: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text with its end id, and all ids."""
        n = len(offs) - 1
        starts, ends, doc = B.words(data, offs)
        # A special token's name can begin and end anywhere in a word: such texts are encoded whole.
        at = np.flatnonzero((data[:-1] == SPECIAL[0]) & (data[1:] == SPECIAL[1]))
        own = np.searchsorted(offs, at, "right") - 1
        odd = np.unique(own[at + 1 < offs[own + 1]])
        whole = [self.narrow(self.tok.encode(data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace"), add_special_tokens=False).ids) for i in odd.tolist()]
        if len(odd):
            plain = ~np.isin(doc, odd)
            starts, ends, doc = starts[plain], ends[plain], doc[plain]
        h = B.span_hash(data, starts, ends)
        entries = self.table.find(h)
        new = np.flatnonzero(entries < 0)
        if len(new):
            if self.table.n + len(new) > self.table.most:
                self.table.clear()
                new = np.arange(len(h))
            own, where = np.unique(h[new], return_index=True)
            raw = data.tobytes()
            pick = new[where]
            self.learn(own, [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[pick].tolist(), ends[pick].tolist())])
            entries = self.table.find(h)
        lens, ids = self.table.runs(entries)
        per = np.bincount(doc, lens, minlength=n).astype(np.int64)
        if len(odd):
            size = np.array([len(x) for x in whole])
            ids = np.insert(ids, np.repeat(np.cumsum(per)[odd], size), np.concatenate(whole))
            per[odd] += size
        return per + 1, np.insert(ids, np.cumsum(per), np.array(end, self.kind))


@lru_cache(maxsize=4)
def words_of(path: str, width: int) -> WordIds:
    return WordIds(path, width)


def filesystem(uri: str):
    """(pyarrow file system, path) for a folder's URI or plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _array(store, path: str, kind: str) -> np.ndarray:
    """A file as an array: mapped into memory where the store is a local or mounted folder, else read."""
    from pyarrow import fs

    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, kind, "r") if store.get_file_info(path).size else np.zeros(0, kind)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def write_tokens(df: DataFrame, out_dir: str, tokenizer_path: str, end_id: int, width: int = 2, partitions: int | None = None) -> DataFrame:
    """Write ids and offsets of ``df`` (doc_id, text) under ``out_dir``; the manifest, with each part's base.

    ``width`` is 2 or 4 bytes an id; ids that don't fit raise OverflowError.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = docs(df).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")

    def ids(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        part, attempt = task.partitionId(), str(task.taskAttemptId())
        store, base = filesystem(out_dir)
        store.create_dir(base, recursive=True)
        coder = words_of(tokenizer_path, width)
        n_docs = n_ids = 0
        tail = f"{part:05d}-{attempt}.bin"
        with store.open_output_stream(f"{base}/ids-{tail}") as to, store.open_output_stream(f"{base}/docs-{tail}") as who:
            for batch in batches:
                doc_ids = batch.column(0)
                for a, b, data, offs in B.text_pieces(batch):
                    lens, ids_ = coder.encode(data, offs, end_id)
                    to.write(ids_.tobytes())
                    own = doc_ids[a:b]
                    valid = np.asarray(own.is_valid()).astype("<i8")
                    who.write(np.stack([np.asarray(own.fill_null(0)), valid, lens], 1).astype("<i8").tobytes())
                    n_docs += b - a
                    n_ids += len(ids_)
        yield pa.RecordBatch.from_pylist([{"part": part, "attempt": attempt, "n_docs": n_docs, "n_ids": n_ids}], pa.schema([("part", pa.int32()), ("attempt", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    path = f"{shared_dir(spark)}"
    placed.mapInArrow(B.trimmed(ids), MANIFEST).write.parquet(path)
    parts = spark.read.schema(MANIFEST).parquet(path)
    # One row a partition, so a window over all of them is small at any input size.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = parts.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def offsets(batches):
        store, base = filesystem(out_dir)
        for batch in batches:
            for r in batch.to_pylist():
                tail = f"{r['part']:05d}-{r['attempt']}.bin"
                who = _array(store, f"{base}/docs-{tail}", "<i8").reshape(-1, 3)
                at = np.concatenate(([0], np.cumsum(who[:, 2]))).astype("<u8") + np.uint64(r["base"])
                with store.open_output_stream(f"{base}/offsets-{tail}") as to:
                    to.write(at.tobytes())
            yield batch

    path = shared_dir(spark)
    spread = based.repartition(n, "part")
    spread.mapInArrow(B.trimmed(offsets), MANIFEST + ", base long").write.parquet(path)
    return spark.read.schema(MANIFEST + ", base long").parquet(path)


def read_tokens(manifest: DataFrame, out_dir: str, width: int = 2, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids (or, with ``digest``, ids_crc32), from the files that the manifest names."""
    spark = manifest.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    last = ("ids_crc32", pa.int64()) if digest else ("ids", pa.list_(pa.int64()))
    form = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), last])

    def read(batches):
        store, base = filesystem(out_dir)
        for batch in batches:
            for r in batch.to_pylist():
                tail = f"{r['part']:05d}-{r['attempt']}.bin"
                who = _array(store, f"{base}/docs-{tail}", "<i8").reshape(-1, 3)
                at = _array(store, f"{base}/offsets-{tail}", "<u8").astype(np.int64)
                ids = _array(store, f"{base}/ids-{tail}", f"<u{width}")
                for i in range(0, len(who), 1000):
                    k = range(i, min(i + 1000, len(who)))
                    own = [ids[at[j] - r["base"] : at[j + 1] - r["base"]] for j in k]
                    got = [zlib.crc32(x.astype("<u4").tobytes()) for x in own] if digest else [x.tolist() for x in own]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([int(who[j, 0]) if who[j, 1] else None for j in k], pa.int64()),
                        pa.array([int(at[j]) for j in k], pa.int64()),
                        pa.array([len(x) for x in own], pa.int64()),
                        pa.array(got, last[1]),
                    ], schema=form)

    kind = "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<long>")
    return manifest.repartition(n, "part").mapInArrow(B.trimmed(read), kind)
