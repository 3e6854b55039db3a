"""Trained text vectors against plain versions, and against hashed counts at telling languages apart."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import strategy, vectors

SF = "/root/testdata/sf0.01"


def texts(spark):
    rows = [(i, t) for i, t in enumerate(["a b c a", "b c d", "a b b c c d", "x y", "x y x", "a c", "", None, "d b a c x"] * 3)]
    return spark.createDataFrame(rows, "id long, t string").repartition(3)


def blanks(c):
    return F.filter(F.split(F.coalesce(c, F.lit("")), " "), lambda w: w != "")


def plain_pairs(words, lists, reach):
    out = {}
    for ws in lists:
        for i, a in enumerate(ws):
            for j, b in enumerate(ws):
                if i != j and abs(i - j) <= reach and a in words and b in words:
                    k = (words.index(a), words.index(b))
                    out[k] = out.get(k, 0) + 1
    return out


def test_counts_information_and_product(spark):
    df = texts(spark)
    top = vectors.vocabulary(df, "t", least=6, split=blanks).orderBy("place").collect()
    lists = [(r.t or "").split() for r in df.collect()]
    n = {w: sum(x.count(w) for x in lists) for w in "abcdxy"}
    words = [r.word for r in top]
    assert [(r.word, r.n) for r in top] == sorted(((w, k) for w, k in n.items() if k >= 6), key=lambda x: (-x[1], x[0]))
    pairs = vectors.pair_counts(df, "t", words, 2, blanks)
    want = plain_pairs(words, lists, 2)
    assert {(r.a, r.b): r.n for r in pairs.collect()} == want
    total = sum(want.values())
    side = {a: sum(v for (x, _), v in want.items() if x == a) for a in range(len(words))}
    m = np.zeros((len(words), len(words)))
    for (a, b), v in want.items():
        m[a, b] = max(0.0, np.log(v * total / (side[a] * side[b])))
    entries = vectors.information(pairs)
    right = np.random.default_rng(1).normal(size=(len(words), 3))
    assert vectors.product(entries, right) == pytest.approx(m @ right)
    values, v = vectors.factors(entries, len(words), 3)
    exact = np.linalg.eigvalsh(m)
    assert np.abs(values) == pytest.approx(np.sort(np.abs(exact))[::-1][:3]) and np.abs(v.T @ v - np.eye(3)).max() < 1e-9


def accuracy(df, column):
    """Share of held-out rows whose nearest mean vector is their own language's."""
    rows = df.select("doc_id", "lang", column).collect()
    x, y = np.array([r[column] for r in rows]), np.array([r.lang for r in rows])
    held = np.array([r.doc_id % 3 == 1 for r in rows])
    names = sorted(set(y.tolist()))
    means = np.array([x[~held & (y == n)].mean(0) for n in names])
    means /= np.linalg.norm(means, axis=1)[:, None]
    return (np.array(names)[(x[held] @ means.T).argmax(1)] == y[held]).mean()


def test_trained_vectors_tell_languages_apart(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("lang is not null and text is not null").repartition(4)
    docs = docs.withColumn("text", F.expr("array_join(slice(split(text, ' '), 1, 12), ' ')"))  # short ones, as posts are
    model = vectors.train(docs.filter("doc_id % 3 <> 1"), "text", dims=16, least=3)
    got = vectors.embed(docs, "text", model).withColumn("hashed", strategy.hashed_embedding("text", 16))
    trained, hashed = accuracy(got, "vector"), accuracy(got, "hashed")
    assert trained > hashed and trained > 0.9


def test_no_words(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "id long, t string")
    model = vectors.train(df, "t", dims=4)
    assert [list(r.vector) for r in vectors.embed(df, "t", model).collect()] == [[0.0] * 4] * 2
    none = df.filter("id < 0")
    assert vectors.embed(none, "t", vectors.train(none, "t", dims=4)).count() == 0
