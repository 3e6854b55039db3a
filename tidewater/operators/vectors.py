"""Text vectors trained on the texts themselves: windowed co-occurrence, positive pointwise information, a randomised factorisation.

* Vocabulary: the ``most`` most frequent words that occur ``least`` times or more. It is what bounds every table that a task or the driver holds (a few numbers for each word of it);
  other words have no vector, as in any model with a vocabulary.
* Counts of pairs of words at most ``reach`` words apart, over all texts, both ways round; tasks add up their own first.
* The matrix of positive pointwise information, ln(n(a, b) N / (n(a) n(b))) where that is over 0, stays distributed. Its range is found by products with a few random
  vectors (Halko, Martinsson and Tropp 2011); each product is one pass over its entries that leaves a row for each word.
* A text's vector is the mean of its words' vectors weighted by 1e-3 / (1e-3 + share of the word) (Arora et al. 2017), scaled to length 1; zeros if it has no word of the vocabulary.

A null or empty text has a vector of zeros. Empty tables give an empty vocabulary and vectors of zeros.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import text as tx
from tidewater.plans.storage import stored

SMOOTH = 1e-3


def vocabulary(df: DataFrame, column: str, least: int = 5, most: int = 1 << 15, split: Callable[..., Column] | None = None) -> DataFrame:
    """word, n, place (from 0, the most frequent first, ties by word)."""
    words = (split or (lambda c: tx.tokens(c, ())))(F.col(column))
    counts = df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    top = counts.orderBy(F.desc("n"), "word").limit(most).toArrow()  # ``most`` rows
    spark = df.sparkSession
    rows = [(w, n, i) for i, (w, n) in enumerate(zip(top["word"].to_pylist(), top["n"].to_pylist(), strict=True))]
    return spark.createDataFrame(rows, "word string, n long, place int")


def pair_counts(df: DataFrame, column: str, words: list[str], reach: int = 5, split: Callable[..., Column] | None = None) -> DataFrame:
    """a, b, n: how often word b (places in ``words``) stands at most ``reach`` words after or before word a; other words keep their places in a text. Written."""
    sent = df.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    def count(batches):
        place, size = sent.value, len(sent.value)
        found, held = [], 0

        def leave():
            own, n = np.unique(np.concatenate(found), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(own // size, pa.int32()), pa.array(own % size, pa.int32()), pa.array(n, pa.int64())], ["a", "b", "n"])

        for b in batches:
            lists = b.column(0)
            flat = np.array([place.get(w, -1) for w in lists.flatten().to_pylist()], np.int64)
            text = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths().fill_null(0)))
            for k in range(1, reach + 1):
                x, y = flat[:-k], flat[k:]
                ok = (x >= 0) & (y >= 0) & (text[:-k] == text[k:])
                found += [x[ok] * size + y[ok], y[ok] * size + x[ok]]
                held += 2 * int(ok.sum())
            if held > 2_000_000:
                yield leave()
                found, held = [], 0
        if held:
            yield leave()

    own = df.select((split or (lambda c: tx.tokens(c, ())))(F.col(column)).alias("w"))
    return stored(own.mapInArrow(count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")))


def information(pairs: DataFrame) -> DataFrame:
    """a, b, x: positive pointwise information. Written."""
    one = pairs.groupBy("a").agg(F.sum("n").alias("na"))
    total = pairs.agg(F.sum("n").alias("total"))
    met = pairs.join(F.broadcast(one), "a").join(F.broadcast(one.toDF("b", "nb")), "b").crossJoin(F.broadcast(total))  # a row for each word; one row
    x = F.ln(F.col("n") * F.col("total").cast("double") / (F.col("na").cast("double") * F.col("nb")))
    return stored(met.select("a", "b", x.alias("x")).filter("x > 0"))


def product(entries: DataFrame, right: np.ndarray) -> np.ndarray:
    """The symmetric matrix of ``entries`` (a, b, x) times ``right``, a row for each word."""
    sent = entries.sparkSession.sparkContext.broadcast(right)

    def multiply(batches):
        right, out = sent.value, None
        for b in batches:
            a, c, x = (np.asarray(b.column(i)) for i in range(3))
            order = np.argsort(a, kind="stable")
            a, part = a[order], right[c[order]] * x[order][:, None]
            first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
            if len(first):
                out = np.zeros_like(right) if out is None else out
                out[a[first]] += np.add.reduceat(part, first, axis=0)
        if out is not None:
            some = np.flatnonzero(out.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(list(out[some]), pa.list_(pa.float64()))], ["a", "y"])

    # Entries of a word are in one task, so each word's row is made once.
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    got = entries.repartition(parts, "a").mapInArrow(multiply, "a int, y array<double>").toArrow()  # rows of the vocabulary
    out = np.zeros_like(right)
    if got.num_rows:
        out[np.asarray(got["a"])] = np.array(got["y"].to_pylist())
    return out


def factors(entries: DataFrame, size: int, dims: int, rounds: int = 2, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The ``dims`` largest eigenvalues by size and eigenvectors (columns; the largest number of each positive) of the matrix of ``entries``, approximately."""
    wide = min(size, dims + 10)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, wide)))[0]
    for _ in range(rounds):
        q = np.linalg.qr(product(entries, q))[0]
    y = product(entries, q)
    values, turn = np.linalg.eigh((q.T @ y + y.T @ q) / 2)
    best = np.argsort(-np.abs(values), kind="stable")[:dims]
    v = q @ turn[:, best]
    sign = np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])
    return values[best], v * np.where(sign == 0, 1, sign)


@dataclass
class Vectors:
    """Words of a vocabulary, their counts and vectors."""

    words: list[str]
    counts: np.ndarray
    vectors: np.ndarray
    dims: int


def train(df: DataFrame, column: str, dims: int = 64, least: int = 5, most: int = 1 << 15, reach: int = 5, split: Callable[..., Column] | None = None) -> Vectors:
    """Vectors of the words of ``df``'s texts."""
    top = vocabulary(df, column, least, most, split).orderBy("place").toArrow()
    words, counts = top["word"].to_pylist(), np.asarray(top["n"].to_pylist(), np.float64)
    if not words:
        return Vectors([], counts, np.zeros((0, dims)), dims)
    values, v = factors(information(pair_counts(df, column, words, reach, split)), len(words), dims)
    own = v * np.sqrt(np.abs(values))[None, :]
    return Vectors(words, counts, np.concatenate((own, np.zeros((len(own), dims - own.shape[1]))), 1), dims)


def embed(df: DataFrame, column: str, model: Vectors, name: str = "vector", split: Callable[..., Column] | None = None) -> DataFrame:
    """``df`` and each text's vector under ``name``."""
    weight = SMOOTH / (SMOOTH + model.counts / max(1.0, model.counts.sum()))
    sent = df.sparkSession.sparkContext.broadcast(({w: i for i, w in enumerate(model.words)}, model.vectors * weight[:, None]))
    dims = model.dims

    @F.pandas_udf("array<double>")
    def mean(lists):
        place, vectors = sent.value

        def one(words):
            at = [i for i in (place.get(w, -1) for w in (words if words is not None else ())) if i >= 0]
            v = vectors[at].sum(0) if at else np.zeros(dims)
            size = np.sqrt((v * v).sum())
            return v / size if size > 0 else v

        return lists.map(one)

    return df.withColumn(name, mean((split or (lambda c: tx.tokens(c, ())))(F.col(column))))
