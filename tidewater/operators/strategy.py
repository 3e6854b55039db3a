"""From topics to strategies: behaviour scores, mixed vectors, similarity, hierarchical clustering, naming, outliers.

Topics are few (tens): their vectors may be collected; rows never are.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import lexicon as lx
from tidewater.functions import math as mx
from tidewater.functions import text as tx
from tidewater.operators.observe import OUTLIER

DIMS = ["complexity", "timespan", "product", "scientific", "attitude", "social", "data", "guidance"]
#: Names under which a strategy's profile keeps the first six behaviour scores.
PROFILE = ["exercise", "diet", "medical", "special_group", "tech_quant", "innovation"]


def behaviour(df: DataFrame, topic: str, column: str, order: str, words: dict[str, list[str]] = lx.BEHAVIOUR, first: int | None = None) -> DataFrame:
    """One row a topic with the eight scores, from which words stand in its rows; with ``first`` in its first ``first`` rows by ``order`` only."""
    own = df.select(topic, order, tx.string(F.col(column)).alias("_t"))
    if first is not None:
        w = Window.partitionBy(topic).orderBy(order)
        own = own.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= first)
    every = sorted({x for ws in words.values() for x in ws})
    at = {x: f"_w{i}" for i, x in enumerate(every)}
    flags = own.groupBy(topic).agg(*[F.max(F.contains("_t", F.lit(x)).cast("int")).alias(at[x]) for x in every])
    n = lambda k: sum((F.col(at[x]) for x in words[k]), F.lit(0)).cast("double")
    ratio = lambda a, b: n(a) / (n(a) + n(b) + 1)
    attitude = ((n("positive") - n("negative")) / (n("positive") + n("negative") + 1) + 1) / 2
    scores = [ratio("complex", "simple"), ratio("long_term", "short_term"), F.least(F.lit(1.0), n("product") / 10), ratio("scientific", "unscientific"), attitude, n("social") / 10, n("data") / 10, n("guidance") / 10]
    return flags.select(topic, *[s.alias(d) for s, d in zip(scores, DIMS)])


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """group, centre: the mean vector."""
    flat = df.select(group, F.posexplode(vector).alias("i", "x"))
    means = flat.groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s.m).alias("centre"))


def z_scores(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key, z: each dimension less its mean, by its population deviation + 1e-8."""
    flat = df.select(key, F.posexplode(vector).alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    stats = flat.groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    z = flat.join(stats, "i").select(key, "i", ((F.col("x") - F.col("m")) / (F.col("s") + 1e-8)).alias("z"))
    return z.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "z"))), lambda s: s.z).alias("z"))


def mixed_vector(z: Column, behaviour: Column, emotion: Column, dims: int) -> Column:
    """0.2 z + 0.6 behaviour + 0.2 emotion, the latter two repeated to ``dims`` elements; emotion is [(sentiment + 1) / 2, arousal]."""
    b = mx.expand(behaviour, dims, 5)
    e = mx.expand(emotion, dims, 2)
    return mx.add(mx.add(mx.scale(z, 0.2), mx.scale(b, 0.6)), mx.scale(e, 0.2))


def similarities(topics: DataFrame, key: str, vector: str) -> DataFrame:
    """topic_i, topic_j, similarity, distance for all pairs of a table of topics."""
    a = topics.select(F.col(key).alias("topic_i"), F.col(vector).alias("vi"))
    b = topics.select(F.col(key).alias("topic_j"), F.col(vector).alias("vj"))
    s = a.crossJoin(b).withColumn("similarity", mx.cosine(F.col("vi"), F.col("vj")))
    return s.select("topic_i", "topic_j", "similarity", mx.cosine_distance(F.col("similarity"), F.col("topic_i") == F.col("topic_j")).alias("distance"))


def average_linkage(distance: np.ndarray, k: int) -> np.ndarray:
    """Cluster numbers of an average-linkage clustering into ``k``; the closest pair merges first, ties by the lowest numbers."""
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, label, alive = np.ones(n), np.arange(n), list(range(n))
    while len(alive) > max(1, k):
        sub = d[np.ix_(alive, alive)]
        i, j = divmod(int(np.argmin(sub)), len(alive))
        a, b = sorted((alive[i], alive[j]))
        merged = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        d[a], d[:, a] = merged, merged
        d[a, a] = np.inf
        size[a] += size[b]
        label[label == b] = a
        alive.remove(b)
    return np.unique(label, return_inverse=True)[1]


def silhouette(distance: np.ndarray, label: np.ndarray) -> float:
    """Mean silhouette; a cluster of one counts 0."""
    out = []
    for i in range(len(label)):
        own = (label == label[i]) & (np.arange(len(label)) != i)
        if not own.any():
            out.append(0.0)
            continue
        a = distance[i, own].mean()
        b = min(distance[i, label == c].mean() for c in set(label.tolist()) - {label[i]})
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(out))


def best_k(distance: np.ndarray, low: int, high: int) -> int:
    """The first number of clusters with the best silhouette."""
    best, top = low, -2.0
    for k in range(low, high + 1):
        label = average_linkage(distance, k)
        if 1 < len(set(label.tolist())) < len(distance) and (s := silhouette(distance, label)) > top:
            best, top = k, s
    return best


def cluster_topics(distance: np.ndarray, share: float = 0.4) -> np.ndarray:
    """Consecutive cluster numbers: 4 to 6 clusters by silhouette (n - 1 for fewer than 5 topics), then clusters with more than
    ``share`` of the topics split into three or four. Clusters of fewer than three topics aren't split."""
    n = len(distance)
    if n < 2:
        return np.zeros(n, np.int64)
    high = min(6, n - 1)
    label = average_linkage(distance, high if 4 > high else best_k(distance, 4, high))
    fresh = label.max() + 1
    for c in range(label.max() + 1):
        own = np.flatnonzero(label == c)
        if len(own) / n > share and len(own) >= 3:
            k = max(3, min(4 if len(own) > 7 else 3, len(own)))
            sub = average_linkage(distance[np.ix_(own, own)], k)
            for s in range(1, sub.max() + 1):
                label[own[sub == s]] = fresh
                fresh += 1
    return np.unique(label, return_inverse=True)[1]


def meta_strategies(pairs: DataFrame) -> DataFrame:
    """topic, meta_strategy (MS0, MS1, ...) from ``similarities``; fewer than two topics are all outliers."""
    spark = pairs.sparkSession
    rows = pairs.select("topic_i", "topic_j", "distance").collect()  # topics squared
    topics = sorted({r[0] for r in rows})
    at = {t: i for i, t in enumerate(topics)}
    d = np.zeros((len(topics), len(topics)))
    for i, j, x in rows:
        d[at[i], at[j]] = x if x is not None else 1.0
    label = cluster_topics(d)
    out = [(t, f"MS{label[i]}" if len(topics) > 1 else OUTLIER) for t, i in at.items()]
    return spark.createDataFrame(out, f"topic {dict(pairs.dtypes)['topic_i']}, meta_strategy string")


def strategy_info(mapping: DataFrame, terms: DataFrame, behaviours: DataFrame) -> DataFrame:
    """meta_strategy, semantic_name, member_topics, top_keywords (ten of its topics' first five words), n_topics, profile.

    ``terms``: topic, word, place; ``behaviours``: topic and DIMS.
    """
    words = mapping.join(terms.filter("place <= 5"), "topic").groupBy("meta_strategy", "word").agg(F.count("*").alias("k"))
    w = Window.partitionBy("meta_strategy").orderBy(F.desc("k"), F.asc("word"))
    top = words.withColumn("r", F.row_number().over(w)).filter("r <= 10").groupBy("meta_strategy").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "word"))), lambda s: s.word).alias("top_keywords"))
    members = mapping.groupBy("meta_strategy").agg(F.sort_array(F.collect_list("topic")).alias("member_topics"), F.count("*").alias("n_topics"))
    means = mapping.join(behaviours, "topic").groupBy("meta_strategy").agg(F.struct(*[F.avg(d).alias(p) for d, p in zip(DIMS, PROFILE)]).alias("profile"))
    got = members.join(top, "meta_strategy", "left").join(means, "meta_strategy", "left")
    return got.withColumn("semantic_name", tx.strategy_name(F.array_join(F.coalesce("top_keywords", F.array().cast("array<string>")), " "), F.col("profile")))


def most_alike(vector: str, centres: DataFrame, group: str) -> Column:
    """struct<name, similarity> of the group whose centre (group, centre) is most like a row's vector; ties to the first by name, no centre at all is null.

    ``centres`` is one row a strategy; they become literals, so rows are judged where they are.
    """
    rows = sorted((r for r in centres.select(group, "centre").collect() if r[0] is not None), key=lambda r: r[0])
    kind = f"struct<s:double,r:int,name:{dict(centres.dtypes)[group]},similarity:double>"
    # Centres are scaled here, a row's length is found once.
    scaled = [(i, r[0], [float(x) / size for x in r[1]]) for i, r in enumerate(rows) if (size := float(np.sqrt(sum(float(x) ** 2 for x in r[1])))) > 0]

    def judged(length):
        def one(i, name, unit):
            return mx.let(F.try_divide(mx.dot(F.col(vector), F.lit(unit)), length), lambda c: F.struct(F.round(c, 12).alias("s"), F.lit(-i).alias("r"), F.lit(name).alias("name"), c.alias("similarity")).cast(kind))

        return F.array_max(F.array(*[one(*x) for x in scaled]))

    best = mx.let(mx.norm(F.col(vector)), judged) if scaled else F.lit(None).cast(kind)
    return mx.let(best, lambda b: F.struct(b["name"].alias("name"), b["similarity"].alias("similarity")))


def reassign(outliers: DataFrame, key: str, vector: str, centres: DataFrame, group: str) -> DataFrame:
    """key, ``group``, similarity: each row's most alike group."""
    got = outliers.select(key, most_alike(vector, centres, group).alias("_best"))
    return got.select(key, F.col("_best.name").alias(group), F.col("_best.similarity").alias("similarity"))


def split_topic(df: DataFrame, topic: str, vector: str, big: float = 0.30, huge: float = 0.50, seeds: Sequence[int] = tuple(range(42, 52))) -> DataFrame:
    """``df`` with topics over ``big`` of the rows split by k-means (4 parts over ``huge``, else 3; the best of several starts).

    Part 0 keeps the topic's number, part j has the largest number so far + j. Topic -1 is never split.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    counts = {r[0]: r[1] for r in df.groupBy(topic).count().collect()}  # one row a topic
    total, largest = sum(counts.values()), max(counts, default=-1)
    out = df
    for t in sorted(k for k, n in counts.items() if k != -1 and n / total > big):
        k = 4 if counts[t] / total > huge else 3
        own = out.filter(F.col(topic) == t).withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
        models = [KMeans(k=k, seed=s, featuresCol="_v", predictionCol="_part").fit(own) for s in seeds]
        best = min(models, key=lambda m: m.summary.trainingCost)
        part = best.transform(own).withColumn(topic, F.when(F.col("_part") == 0, t).otherwise(F.col("_part") + largest).cast(dict(df.dtypes)[topic])).select(*df.columns)
        out = out.filter(~F.col(topic).eqNullSafe(F.lit(t))).unionByName(part)
        largest += k - 1
    return out


def fit_topics(df: DataFrame, vector: str, k: int = 15, least: int = 200, seed: int = 42, spread: float | None = 3.0) -> DataFrame:
    """Adds topic and topic_probability: a k-means cluster of the vectors, and the share of its centre in the sum of inverse squared distances to all.

    Topic -1, probability 0: rows farther from their centre than the mean of its rows and ``spread`` standard deviations (None: no such rows), clusters
    of fewer than ``least`` rows, and rows without a vector.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    some = df.filter(F.col(vector).isNotNull())
    v = some.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="topic").fit(v)
    near = lambda c: F.aggregate(F.zip_with(vector, F.lit([float(x) for x in c]), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
    placed = model.transform(v).withColumn("_d", F.array(*[near(c) for c in model.clusterCenters()]))
    share = lambda d: 1 / (F.lit(1e-9) + d)
    own = F.get("_d", F.col("topic"))
    placed = placed.withColumns({"_p": share(own) / F.aggregate("_d", F.lit(0.0), lambda a, d: a + share(d)), "_far": F.sqrt(own)})
    sizes = placed.groupBy("topic").agg(F.count("*").alias("_n"), F.avg("_far").alias("_m"), F.stddev_pop("_far").alias("_s"))
    kept = placed.join(F.broadcast(sizes), "topic")  # k rows
    out = F.col("_n") < least
    if spread is not None:
        out = out | (F.col("_far") > F.col("_m") + spread * F.col("_s"))
    kept = kept.withColumns({"topic": F.when(out, -1).otherwise(F.col("topic")), "topic_probability": F.when(out, 0.0).otherwise(F.col("_p"))})
    none = df.filter(F.col(vector).isNull()).withColumns({"topic": F.lit(-1), "topic_probability": F.lit(0.0)})
    return kept.select(*df.columns, "topic", "topic_probability").unionByName(none)


def hashed_embedding(column: str, dims: int = 64) -> Column:
    """A vector of a text without a model: counts of its words by hash, scaled to length 1."""
    words = tx.tokens(F.col(column), ())
    places = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dims)))
    # What taking a place's number out of the array leaves out is its count.
    counts = mx.let(places, lambda ps: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: (F.size(ps) - F.size(F.array_remove(ps, i.cast("long")))).cast("double")))
    return mx.let(counts, lambda v: mx.let(mx.norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0))))
