"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The rank file is turned into a tokenizers BPE model: its bytes are written as the
printable characters of the byte-level alphabet, and a token's merges are all its
splits into two tokens, in the order of its rank, so that the library merges in
exactly the order of the ranks. Decoding looks every id's bytes up in the reversed table and joins
them, so that characters split over tokens come out whole.

Nulls: a null text is the empty text (no ids). Repeated rows are encoded each. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidewater.llm import _bytes as B
from tidewater.llm._frames import docs


def byte_alphabet() -> list[str]:
    """The printable character of each byte: itself if printable in Latin-1, else 256, 257, ... in order."""
    solid = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [], 0
    for b in range(256):
        if b in solid:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class ByteBPE:
    """Encoder and decoder for one rank file; ``pattern`` splits the text before the merges."""

    def __init__(self, ranks_path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = read_ranks(ranks_path)
        chars = byte_alphabet()
        name = {t: "".join(chars[b] for b in t) for t in ranks}
        merges = []
        for t in sorted(ranks, key=ranks.get):
            if len(t) > 1:
                parts = [(t[:i], t[i:]) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
                merges += [(name[a], name[b]) for a, b in parts if ranks[a] < ranks[t] and ranks[b] < ranks[t]]
        self.tok = Tokenizer(models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges))
        self.tok.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(Regex(pattern), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ])
        self.table: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.table[r] = t
        self.said = list(map(str, range(len(self.table))))

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0]

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))

    def decode(self, ids) -> str:
        """Text of ids; bytes that are no whole character come out as U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def offsets(self, ids) -> list[tuple[int, int]]:
        """Character span of each id in the decoded text; a token that begins inside a character starts at that character."""
        out, at = [], 0
        for i in ids:
            piece = self.table[i]
            begun = sum((b & 0xC0) != 0x80 for b in piece)
            start = at if piece[:1] and (piece[0] & 0xC0) != 0x80 else max(0, at - 1)
            at += begun
            out.append((start, at))
        return out

    def digest(self, ids: list[int]) -> tuple[int, str, str]:
        """Number of ids, sha256 of the decimal ids joined by spaces, sha256 of the decoded bytes."""
        said = " ".join(map(self.said.__getitem__, ids)).encode()
        return len(ids), hashlib.sha256(said).hexdigest(), hashlib.sha256(self.decode_bytes(ids)).hexdigest()


_kept: dict[tuple, ByteBPE] = {}


def tokenizer(ranks_path: str, pattern: str) -> ByteBPE:
    """One per worker process."""
    key = (ranks_path, pattern)
    if key not in _kept:
        _kept[key] = ByteBPE(ranks_path, pattern)
    return _kept[key]


def texts(batch: pa.RecordBatch, most: int = 256 << 10) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) in runs of about ``most`` bytes."""
    ids, col = batch.column(0).to_pylist(), batch.column(1)
    from_, size = 0, 0
    run: list[str] = []
    for i in range(len(ids)):
        t = col[i].as_py() or ""
        run.append(t)
        size += len(t)
        if size >= most:
            yield ids[from_ : i + 1], run
            from_, size, run = i + 1, 0, []
    if run:
        yield ids[from_:], run


def encode(df: DataFrame, ranks_path: str, pattern: str, with_offsets: bool = False) -> DataFrame:
    """doc_id, ids (array of int) and, if asked for, offsets (array of [start, end) in characters)."""
    kind = "doc_id long, ids array<int>" + (", offsets array<struct<start:int,end:int>>" if with_offsets else "")

    def run(batches):
        b = tokenizer(ranks_path, pattern)
        for batch in batches:
            for ids, run_ in texts(batch):
                coded = b.encode_many(run_)
                cols = [pa.array(ids, pa.int64()), pa.array(coded, pa.list_(pa.int32()))]
                if with_offsets:
                    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
                    cols.append(pa.array([[{"start": x, "end": y} for x, y in b.offsets(c)] for c in coded], pa.list_(span)))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "offsets"][: len(cols)])

    return docs(df).mapInArrow(B.trimmed(run), kind)


def decode(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and text of a frame with doc_id and ids; null ids give the empty text."""

    def run(batches):
        b = tokenizer(ranks_path, pattern)
        for batch in batches:
            out = [b.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return df.select("doc_id", "ids").mapInArrow(B.trimmed(run), "doc_id long, text string")


def round_trip(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode, then decode: doc_id, n_tokens, ids_sha256, decoded_sha256, without moving ids out of the worker."""

    def run(batches):
        b = tokenizer(ranks_path, pattern)
        for batch in batches:
            for ids, run_ in texts(batch):
                n, a, d = zip(*map(b.digest, b.encode_many(run_)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs(df).mapInArrow(B.trimmed(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
