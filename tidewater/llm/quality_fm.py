"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score(x) = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairwise term is half of
sum_f (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2, so its cost is linear in the number of features.

Features of a text: its distinct lower-case words hashed into ``2**BITS`` places, weighted by
log(1 + count) and scaled to length 1; one-hot bins of structure statistics (symbols, digits, capitals,
word length, repeated words, repeated lines, ...); one-hot bins of metadata (numeric columns
named by the caller, by powers of two; null or negative has a bin of its own). An empty text has its statistics' bins only.

Labels are learnt from a bounded sample: of the labelled documents that the caller admits, the ``sample`` ones
with the smallest hash of their id. A document with several labels counts as good if most are 1 (a tie is 0). The
sample's sparse features go to the driver (at most ``sample`` documents; their texts don't); the model
has a fixed size and goes to every task. Scoring covers every whole text, in one pass without a shuffle.

No labels: every score is 0.5. Null text: the empty text. Rows that repeat an id are scored each and train once. A null id is scored and never trains.
An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm import _bytes as B
from tidewater.llm._frames import pick, small_batches

BITS = 16
WORDS = 1 << BITS
RANK = 8
#: Upper edges of the bins of each structure statistic.
EDGES = {
    "symbols": [0.0005, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2],
    "punctuation": [0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.15],
    "digits": [0.0005, 0.002, 0.01, 0.03, 0.1],
    "capitals": [0.005, 0.01, 0.02, 0.04, 0.08, 0.2, 0.5],
    "high_bytes": [0.001, 0.01, 0.03, 0.06, 0.12, 0.3],
    "spaces": [0.08, 0.12, 0.15, 0.18, 0.22, 0.3],
    "word_bytes": [2, 3, 4, 4.5, 5, 5.5, 6, 7, 9, 14],
    "distinct_words": [0.1, 0.3, 0.5, 0.7, 0.8, 0.9, 0.97, 0.995],
    "top_word": [0.01, 0.02, 0.04, 0.06, 0.1, 0.2, 0.4],
    "line_bytes": [10, 30, 60, 120, 250, 500, 1000, 3000],
    "same_lines": [0.001, 0.05, 0.15, 0.3, 0.5, 0.8],
    "words": [1, 5, 20, 50, 100, 300, 1000, 3000, 10000],
}
_CLASS = np.zeros(256, np.uint8)  # 1 symbol, 2 punctuation, 3 digit, 4 capital, 5 high byte, 6 space
_CLASS[[*b"#*$%&|<>{}[]\\^~_=+@/"]] = 1
_CLASS[[*b".,;:!?'\"()-"]] = 2
_CLASS[48:58] = 3
_CLASS[65:91] = 4
_CLASS[128:] = 5
_CLASS[[*b" \t\n\x0b\x0c\r"]] = 6
_START = {k: WORDS + sum(len(e) + 1 for e in list(EDGES.values())[:i]) for i, k in enumerate(EDGES)}
META = WORDS + sum(len(e) + 1 for e in EDGES.values())
META_BINS = 40


def n_features(n_meta: int) -> int:
    return META + META_BINS * n_meta


def features(data: np.ndarray, offs: np.ndarray, meta: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows' first positions (one more than rows), feature indices and values of a run of texts."""
    n = len(offs) - 1
    size = np.diff(offs)
    some = np.maximum(size, 1)
    doc = np.repeat(np.arange(n), size)
    kinds = np.bincount(doc * 8 + _CLASS[data], minlength=8 * n).reshape(n, 8)
    low = B.LOWER[data]
    starts, ends, wdoc = B.words(low, offs)
    h = B.span_hash(low, starts, ends)
    n_words = np.bincount(wdoc, minlength=n)
    # Distinct words of each document: sort by (document, place), where hashes keep 40 bits beside the document.
    key = (wdoc.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24))
    uniq, counts = np.unique(key, return_counts=True)
    udoc = (uniq >> np.uint64(40)).astype(np.int64)
    place = ((uniq >> np.uint64(8)) & np.uint64(WORDS - 1)).astype(np.int64)
    v = np.log1p(counts)
    v = v / np.sqrt(np.maximum(np.bincount(udoc, v * v, minlength=n), 1e-9))[udoc]
    distinct = np.bincount(udoc, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, udoc, counts)
    solid = np.maximum(n_words, 1)
    # Lines and those equal to another one of their document.
    cut = np.flatnonzero(data == 10)
    l_start = np.sort(np.concatenate((offs[:-1], cut + 1)))
    l_end = np.sort(np.concatenate((cut, offs[1:])))
    l_doc = np.searchsorted(offs, l_start, "right") - 1
    full = l_end > l_start
    l_start, l_end, l_doc = l_start[full], l_end[full], l_doc[full]
    l_hash = B.span_hash(data, l_start, l_end)
    n_lines = np.bincount(l_doc, minlength=n)
    l_uniq = np.unique((l_doc.astype(np.uint64) << np.uint64(40)) | (l_hash >> np.uint64(24)))
    l_distinct = np.bincount((l_uniq >> np.uint64(40)).astype(np.int64), minlength=n)
    stats = {
        "symbols": kinds[:, 1] / some, "punctuation": kinds[:, 2] / some, "digits": kinds[:, 3] / some, "capitals": kinds[:, 4] / some,
        "high_bytes": kinds[:, 5] / some, "spaces": kinds[:, 6] / some, "word_bytes": (size - kinds[:, 6]) / solid, "distinct_words": distinct / solid,
        "top_word": top / solid, "line_bytes": size / np.maximum(n_lines, 1), "same_lines": 1 - l_distinct / np.maximum(n_lines, 1), "words": n_words,
    }
    cols = [_START[k] + np.searchsorted(EDGES[k], stats[k], "right") for k in EDGES]
    for i, m in enumerate(meta):
        bad = ~np.isfinite(m) | (m < 0)
        cols.append(META + META_BINS * i + np.where(bad, META_BINS - 1, np.minimum(np.log2(np.where(bad, 0, m) + 1).astype(np.int64), META_BINS - 2)))
    fixed = np.stack(cols, 1)
    per = distinct + fixed.shape[1]
    first = np.concatenate(([0], np.cumsum(per)))
    idx, val = np.empty(first[-1], np.int64), np.empty(first[-1])
    at = np.arange(len(uniq)) + (udoc * fixed.shape[1])
    idx[at], val[at] = place, v
    spots = (first[1:] - fixed.shape[1])[:, None] + np.arange(fixed.shape[1])
    idx[spots], val[spots] = fixed, 0.3
    return first, idx, val


@dataclass
class Machine:
    """Weights: ``w0``, ``w`` (features) and ``v`` (features x RANK)."""

    w0: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, first: np.ndarray, idx: np.ndarray, val: np.ndarray) -> np.ndarray:
        if len(first) < 2:
            return np.zeros(0)
        vx = self.v[idx] * val[:, None]
        s, sq = np.add.reduceat(vx, first[:-1]), np.add.reduceat(vx * vx, first[:-1])
        return self.w0 + np.add.reduceat(self.w[idx] * val, first[:-1]) + 0.5 * (s * s - sq).sum(1)

    def score(self, first, idx, val) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(first, idx, val), -30, 30)))


def fit_machine(first: np.ndarray, idx: np.ndarray, val: np.ndarray, y: np.ndarray, size: int, epochs: int = 6, rate: float = 0.1, l2: float = 1e-5, seed: int = 1) -> Machine:
    """Adagrad on the logistic loss, in batches of 64 rows."""
    rng = np.random.default_rng(seed)
    good = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    m = Machine(float(np.log(good / (1 - good))), np.zeros(size), rng.normal(0, 0.02 if len(y) else 0, (size, RANK)))
    gw, gv, g0 = np.full(size, 1e-3), np.full((size, RANK), 1e-3), 1e-3
    lens = np.diff(first)
    for _ in range(epochs if len(y) else 0):
        order = rng.permutation(len(y))
        for k in range(0, len(order), 64):
            rows = order[k : k + 64]
            n = lens[rows]
            f = np.concatenate(([0], np.cumsum(n)))
            at = np.repeat(first[rows] - f[:-1], n) + np.arange(f[-1])
            i, x = idx[at], val[at]
            vx = m.v[i] * x[:, None]
            s = np.add.reduceat(vx, f[:-1])
            out = m.w0 + np.add.reduceat(m.w[i] * x, f[:-1]) + 0.5 * (s * s - np.add.reduceat(vx * vx, f[:-1])).sum(1)
            err = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[rows]) / len(rows)
            e = np.repeat(err, n)
            uniq, inv = np.unique(i, return_inverse=True)
            dw = np.bincount(inv, e * x, minlength=len(uniq)) + l2 * m.w[uniq]
            part = (e * x)[:, None] * (np.repeat(s, n, axis=0) - vx)
            dv = np.stack([np.bincount(inv, part[:, r], minlength=len(uniq)) for r in range(RANK)], 1) + l2 * m.v[uniq]
            d0 = err.sum()
            gw[uniq] += dw * dw
            gv[uniq] += dv * dv
            g0 += d0 * d0
            m.w[uniq] -= rate * dw / np.sqrt(gw[uniq])
            m.v[uniq] -= rate * 0.5 * dv / np.sqrt(gv[uniq])
            m.w0 -= rate * d0 / np.sqrt(g0)
    return Machine(m.w0, m.w.astype(np.float32), m.v.astype(np.float32))


def _arrow_features(texts: pd.Series | pa.Array, meta: list):
    batch = pa.RecordBatch.from_arrays([texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())], ["text"])
    for a, b, data, offs in B.text_pieces(batch):
        yield a, b, features(data, offs, [np.asarray(m[a:b], np.float64) for m in meta])


def train(df: DataFrame, labels: DataFrame, admit: Column | None = None, sample: int = 6000, meta: tuple[str, ...] = ()) -> Machine:
    """Fit on at most ``sample`` labelled documents; ``labels`` has doc_id and quality, ``admit`` is a condition on doc_id."""
    y = pick(labels, "doc_id", "quality").filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    if admit is not None:
        y = y.filter(admit)
    y = y.groupBy("doc_id").agg((F.avg("quality") > 0.5).cast("int").alias("y"))
    chosen = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded, so it may be broadcast
    d = pick(df, "doc_id", "text", *meta).toDF("doc_id", "text", *[f"m{i}" for i in range(len(meta))])
    d = d.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *[F.col(f"m{i}").cast("double") for i in range(len(meta))])
    met = d.join(F.broadcast(chosen), "doc_id")
    # Rows that share an id train once, so that ``sample`` bounds the rows: the one whose text (then metadata) has the least hash.
    cols = ["text", *[f"m{i}" for i in range(len(meta))]]
    once = met.groupBy("doc_id").agg(F.min_by(F.struct(*cols, "y"), F.xxhash64(*cols)).alias("row"))
    rows = small_batches(once.select("doc_id", *[F.col(f"row.{c}").alias(c) for c in [*cols, "y"]]))

    def sparse(batches):
        for batch in batches:
            cols = [np.array(batch.column(batch.schema.get_field_index(f"m{i}")).to_numpy(zero_copy_only=False), np.float64) for i in range(len(meta))]
            text, ids, ys = (batch.column(batch.schema.get_field_index(c)) for c in ("text", "doc_id", "y"))
            for a, b, (first, idx, val) in _arrow_features(text, cols):
                form = lambda x, t: pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(x, t))
                yield pa.RecordBatch.from_arrays([ids[a:b], ys[a:b], form(idx, pa.int32()), form(val, pa.float32())], ["doc_id", "y", "idx", "val"])

    got = rows.mapInArrow(B.trimmed(sparse), "doc_id long, y int, idx array<int>, val array<float>").toArrow().combine_chunks()
    got = got.sort_by("doc_id")
    idx = got.column("idx").combine_chunks()
    val = got.column("val").combine_chunks()
    if isinstance(idx, pa.ChunkedArray):
        idx, val = (pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], pa.list_(pa.int32())) for c in (idx, val))
    first = np.concatenate(([0], np.cumsum(np.asarray(idx.value_lengths()).astype(np.int64)))) if len(idx) else np.zeros(1, np.int64)
    return fit_machine(first, np.asarray(idx.flatten()).astype(np.int64), np.asarray(val.flatten()).astype(np.float64), np.asarray(got.column("y")).astype(np.float64), n_features(len(meta)))


def scorer(spark, machine: Machine, n_meta: int = 0):
    """A pandas UDF (text, numeric metadata columns as doubles) -> score; the model goes out as one broadcast of fixed size."""
    sent = spark.sparkContext.broadcast(machine)

    def score(text: pd.Series, *meta: pd.Series) -> pd.Series:
        out = np.zeros(len(text))
        for a, b, f in _arrow_features(text.fillna(""), [m.to_numpy(np.float64, na_value=np.nan) for m in meta]):
            out[a:b] = sent.value.score(*f)
        return pd.Series(out)

    def run(batches):
        for cols in batches:
            yield score(*cols) if isinstance(cols, tuple) else score(cols)

    from collections.abc import Iterator

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]] if n_meta else Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")


def with_score(df: DataFrame, machine: Machine, text: str = "text", meta: tuple[str, ...] = (), name: str = "score") -> DataFrame:
    """``df`` and a column ``name``, 0 to 1, for every row."""
    score = scorer(df.sparkSession, machine, len(meta))
    return small_batches(df).withColumn(name, score(F.col(text), *[F.col(m).cast("double") for m in meta]))


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def score_documents(df: DataFrame, machine: Machine, meta: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score, predicted (score >= 0.5) of every row."""
    named = tuple(f"m{i}" for i in range(len(meta)))
    d = pick(df, "doc_id", "text", *meta).toDF("doc_id", "text", *named)
    return with_score(d, machine, meta=named).select(F.col("doc_id").cast("long").alias("doc_id"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
