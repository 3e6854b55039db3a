"""Topics by density: reduced vectors, neighbour lists, a minimum spanning forest of mutual reachability, a condensed tree.

Rows with equal vectors are one point with a weight, so what follows grows with different vectors only, and copies count as neighbours of each other.

* ``reduced``: principal axes. Tasks add up Gram sums of their Arrow batches; a table of (dimensions + 1)^2 numbers reaches the driver.
* ``neighbours``: a forest of random projections. Coarse cells are cut by trees that are fitted on a bounded sample; a task cuts a cell on until its blocks are small and
  compares each block with itself. Lists of several trees are merged. Approximate; exact while all points fit into a block.
* ``spanning_forest``: Borůvka rounds. Each component takes its least outgoing edge; between two components only the least edge goes on.
* ``condensed``: the hierarchy of merges in which both sides have ``least`` rows. Edges are taken in ascending bands; inside a band, what the band connects is
  independent of the rest and is folded in a task of its own, with everything lighter contracted into points.
* ``density_topics``: the most stable clusters of that tree; what belongs to none is topic -1.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators.network import components
from tidewater.plans.storage import forget, stored

#: Rows that a coarse tree is fitted on, points of a coarse cell, and points of a block that is compared with itself.
SAMPLE, CELL, BLOCK = 1 << 15, 1 << 16, 256
#: Edges of a band: an 1/BANDS of all, but at least so many.
BANDS, BAND = 64, 1 << 20
#: 1 / distance is taken of this distance at least.
NEAR = 1e-9


def matrix(column: pa.ListArray | pa.ChunkedArray) -> np.ndarray:
    """Rows of numbers of a list column, in double; all rows have one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):  # of no chunks
        return np.zeros((0, 0))
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1)


def gram(df: DataFrame, vector: str) -> np.ndarray:
    """Sums of products of all pairs of dimensions, and of each with 1 (the last row and column), over the rows with a vector."""

    def add(batches):
        total = None
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0))
                x = np.concatenate((x, np.ones((len(x), 1))), 1)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "x"])

    def meet(t: pa.Table) -> pa.Table:
        return pa.table({"i": t["i"].slice(0, 1), "x": pa.array([matrix(t["x"]).sum(0)], pa.list_(pa.float64()))})

    parts = df.filter(F.col(vector).isNotNull()).select(vector).mapInArrow(add, "i int, x array<double>")
    rows = sorted(parts.groupBy("i").applyInArrow(meet, "i int, x array<double>").collect())  # (dimensions + 1) rows
    return np.array([r["x"] for r in rows])


def principal_axes(df: DataFrame, vector: str, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The mean and the ``dims`` axes of most variance (rows; the largest number of each is positive)."""
    g = gram(df, vector)
    if not len(g):
        return np.zeros(0), np.zeros((0, 0))
    n = g[-1, -1]
    mean = g[-1, :-1] / n
    values, axes = np.linalg.eigh(g[:-1, :-1] / n - np.outer(mean, mean))
    axes = axes.T[np.argsort(-values, kind="stable")][: min(dims, len(mean))]
    sign = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])
    return mean, axes * np.where(sign == 0, 1, sign)[:, None]


def reduced(df: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """key, vector (of ``dims`` numbers, or all if they are fewer) of the rows that have a vector."""
    mean, axes = principal_axes(df, vector, dims)
    kind = df.schema[key].dataType.simpleString()

    def project(batches):
        for b in batches:
            x = matrix(b.column(1)) if b.num_rows else np.zeros((0, len(mean)))
            # Sums in the order of dimensions, so that a row's numbers don't depend on its batch.
            y = np.zeros((len(x), len(axes)))
            for i in range(len(mean)):
                y += (x[:, i] - mean[i])[:, None] * axes[None, :, i]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(y), pa.list_(pa.float64()))], ["key", "vector"])

    return df.filter(F.col(vector).isNotNull()).select(key, vector).mapInArrow(project, f"key {kind}, vector array<double>").toDF(key, "vector")


def points(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id (the least key), weight, vector of each different vector."""
    return df.groupBy(vector).agg(F.min(key).cast("long").alias("id"), F.count("*").alias("weight")).select("id", "weight", F.col(vector).alias("vector"))


def _directions(seed: int, n: int, dims: int) -> np.ndarray:
    v = np.random.default_rng(seed).standard_normal((n, dims))
    return v / np.sqrt((v * v).sum(1))[:, None]


def _coarse(sample: np.ndarray, depth: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A tree's directions (one a level) and thresholds (of each node, in heap order): medians of the sample."""
    way = _directions(seed, depth, sample.shape[1]) if depth else np.zeros((0, sample.shape[1]))
    cut, node = np.zeros(2**depth), np.ones(len(sample), np.int64)
    for level in range(depth):
        s = sample @ way[level]
        for k in range(2**level, 2 ** (level + 1)):
            own = s[node == k]
            cut[k] = np.median(own) if len(own) else 0.0
        node = 2 * node + (s > cut[node])
    return way, cut


def _blocks(x: np.ndarray, seed: int, most: int):
    """Places of the rows of ``x`` in blocks of at most ``most``, cut at medians of random directions."""
    rng = np.random.default_rng(seed)
    todo = [np.arange(len(x))]
    while todo:
        own = todo.pop()
        if len(own) <= most:
            yield own
            continue
        way = rng.standard_normal(x.shape[1])
        order = own[np.argsort(x[own] @ way, kind="stable")]
        # Cut near the middle, elsewhere from tree to tree.
        at = int(len(order) * rng.uniform(0.4, 0.6))
        todo += [order[:at], order[at:]]


def neighbours(given: DataFrame, k: int, trees: int = 8, seed: int = 1) -> DataFrame:
    """id, weight, near: array of (d, id, weight), the ``k`` nearest other points found, by distance and id. ``given`` is a stored table as from ``points``."""
    n = given.count()
    depth = max(0, math.ceil(math.log2(max(1, n) / CELL)))
    tables = []
    if depth:
        some = given.filter(F.pmod(F.xxhash64("id"), F.lit(-(-n // SAMPLE))) == 0).select("vector").limit(2 * SAMPLE).toArrow()
        sample = matrix(some.column("vector"))
        depth = min(depth, int(math.log2(max(1, len(sample) / 8))))
    for t in range(trees):
        tables.append(_coarse(sample, depth, seed + t) if depth else None)
    sent = given.sparkSession.sparkContext.broadcast(tables)

    def route(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("vector"))
            for t, table in enumerate(sent.value):
                node = np.ones(len(x), np.int64)
                if table is not None:
                    way, cut = table
                    for level in range(len(way)):
                        node = 2 * node + ((x @ way[level]) > cut[node])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(node), b.column("id"), b.column("weight"), b.column("vector")], ["tree", "cell", "id", "weight", "vector"])

    routed = given.select("id", "weight", "vector").mapInArrow(route, "tree int, cell long, id long, weight long, vector array<double>")
    sizes = stored(routed.groupBy("tree", "cell").agg(F.ceil(F.count("*") / (4 * CELL)).alias("parts")))
    # A cell that the sample's trees left too large is dealt out; its parts are alike.
    dealt = routed.join(sizes, ["tree", "cell"]).withColumn("part", F.pmod(F.xxhash64("id", "tree"), "parts"))

    def nearest(t: pa.Table) -> pa.Table:
        ids, weight, x = np.asarray(t["id"]), np.asarray(t["weight"]), matrix(t["vector"])
        order = np.argsort(ids)
        ids, weight, x = ids[order], weight[order], x[order]
        tree, cell = t["tree"][0].as_py(), t["cell"][0].as_py()
        out = [[], [], [], []]
        for own in _blocks(x, seed * 1_000_003 + tree * 1009 + cell, BLOCK):
            y = x[own]
            size = (y * y).sum(1)
            far = size[:, None] + size[None, :] - 2 * y @ y.T
            np.fill_diagonal(far, np.inf)
            m = min(k, len(own) - 1)
            if m < 1:
                continue
            # A few more than asked for by the fast sum, then in order of the exact one.
            some = np.argpartition(far, min(m + 7, len(own) - 1), axis=1)[:, : min(m + 8, len(own) - 1)]
            d = np.sqrt(((y[:, None, :] - y[some]) ** 2).sum(2))
            d[some == np.arange(len(own))[:, None]] = np.inf
            best = np.lexsort((ids[own[some]], d), axis=1)[:, :m]
            row = np.arange(len(own))[:, None]
            other = own[some[row, best]]
            for list_, new in zip(out, (np.repeat(ids[own], m), d[row, best].ravel(), ids[other].ravel(), weight[other].ravel()), strict=True):
                list_.append(new)
        cols = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["id", "d", "other", "w"])

    found = dealt.groupBy("tree", "cell", "part").applyInArrow(nearest, "id long, d double, other long, w long")
    lists = found.distinct().groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", F.col("other").alias("id"), F.col("w").alias("weight")))), 1, k).alias("near"))
    return given.select("id", "weight").join(lists, "id", "left")


def reachability(near: DataFrame, k: int) -> DataFrame:
    """a < b, w: the greatest of both core distances and the distance, for each pair in a list of ``neighbours``. The core distance is the least one
    within which there are ``k`` rows, the point's own included; the last of its list if that has too few."""
    step = lambda a, x: F.struct((a["n"] + x["weight"]).alias("n"), F.when(a["n"] >= k, a["core"]).otherwise(x["d"]).alias("core"))
    core = F.aggregate("near", F.struct(F.col("weight").alias("n"), F.lit(0.0).alias("core")), step, lambda a: a["core"])
    own = stored(near.filter(F.col("near").isNotNull()).select("id", core.alias("core"), "near"))
    pairs = own.select("id", "core", F.explode("near").alias("x")).select("id", "core", F.col("x.id").alias("other"), F.col("x.d").alias("d"))
    both = pairs.join(own.select(F.col("id").alias("other"), F.col("core").alias("core_b")), "other")
    w = F.greatest("d", "core", "core_b")
    return both.groupBy(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).agg(F.min(w).alias("w"))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """The edges (a, b, w) of a minimum spanning forest of ``edges``; equal weights go by (a, b)."""
    left = stored(edges.select(F.col("a").alias("ca"), F.col("b").alias("cb"), F.struct("w", "a", "b").alias("e")))
    taken = []
    while True:
        ways = left.select(F.col("ca").alias("c"), "e", F.col("cb").alias("to")).unionByName(left.select(F.col("cb").alias("c"), "e", F.col("ca").alias("to")))
        least = stored(ways.groupBy("c").agg(F.min(F.struct("e", "to")).alias("m")).select("c", "m.e", F.col("m.to").alias("up")))
        if least.isEmpty():
            break
        taken.append(stored(least.select("e.a", "e.b", "e.w").distinct()))
        # Each component hangs on the one that its edge leads to; only two that took the same edge hang on each other: the lesser is the root.
        other = least.select(F.col("c").alias("up"), F.col("up").alias("back"))
        root = (F.col("back") == F.col("c")) & (F.col("c") < F.col("up"))
        up = stored(least.select("c", "up").join(other, "up", "left").select("c", F.when(root, F.col("c")).otherwise(F.col("up")).alias("up")))
        while True:
            above = up.select(F.col("c").alias("up"), F.col("up").alias("top"))
            new = stored(up.join(above, "up").select("c", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
            moved = not new.filter("moved").isEmpty()
            forget(up)
            up = new.drop("moved")
            if not moved:
                break
        was = [left, least, up]
        for side in ("ca", "cb"):
            left = left.join(up.select(F.col("c").alias(side), "up"), side).drop(side).withColumnRenamed("up", side)
        between = left.filter("ca != cb").groupBy(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb"))
        left = stored(between.agg(F.min("e").alias("e")))
        for t in was:
            forget(t)
    if not taken:
        return edges.limit(0)
    out = taken[0]
    for t in taken[1:]:
        out = out.unionByName(t)
    return out


def _parent(a: int, b: int) -> int:
    """The number of the cluster that two others become."""
    return -1 - int.from_bytes(hashlib.sha256(f"{min(a, b)}:{max(a, b)}".encode()).digest()[:8], "big") // 2


def fold(nodes: list[tuple[int, int, int | None]], edges: list[tuple[float, int, int, int, int]], least: int) -> tuple[list, list, tuple]:
    """Merges along edges (weight, a, b, component, component) in order, over nodes (component, rows, cluster or None) that they connect.

    Returns attachments (component, cluster, weight), merges (parent, child, weight), and the (rows, cluster) of the whole. A component of fewer than ``least`` rows has no
    cluster and keeps its members; it attaches to the cluster that it meets or that it becomes with another.
    """
    up = {c: c for c, _, _ in nodes}
    rows = {c: n for c, n, _ in nodes}
    cluster = {c: g for c, _, g in nodes}
    held = {c: [c] for c, _, g in nodes if g is None}
    attached, merged = [], []

    def top(c):
        while up[c] != c:
            up[c] = up[up[c]]
            c = up[c]
        return c

    root = nodes[0][0]
    for w, _, _, a, b in sorted(edges):
        a, b = top(a), top(b)
        if rows[a] < rows[b]:
            a, b = b, a
        up[b], root = a, a
        rows[a] += rows[b]
        ga, gb = cluster[a], cluster[b]
        if ga is not None and gb is not None:
            cluster[a] = _parent(ga, gb)
            merged += [(cluster[a], ga, w), (cluster[a], gb, w)]
        elif ga is None and gb is None:
            held[a] += held.pop(b)
            if rows[a] >= least:
                cluster[a] = min(held[a])
                attached += [(c, cluster[a], w) for c in held.pop(a)]
        else:
            cluster[a] = gb if ga is None else ga
            attached += [(c, cluster[a], w) for c in held.pop(a if ga is None else b)]
    return attached, merged, (rows[root], cluster[root])


def condensed(given: DataFrame, forest: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(id, weight, cluster, w): the cluster that each point attaches to and the distance where it does, null if to none; (parent, child, w): which clusters become one.

    ``given`` has id and weight; ``forest`` is a stored table as from ``spanning_forest``.
    """
    heavy = F.col("weight") >= least
    # Where a point is: its component, and the cluster and distance once it has attached. Copies alone may be a cluster.
    at = stored(given.select("id", "weight", F.col("id").alias("component"), F.when(heavy, F.col("id")).alias("cluster"), F.when(heavy, 0.0).alias("w")))
    state = stored(given.select(F.col("id").alias("component"), F.col("weight").alias("n"), F.when(heavy, F.col("id")).alias("cluster")))
    merges = []
    kind = "what int, c long, g long, n long, w double"

    def one(t: pa.Table) -> pa.Table:
        nodes, edges = [], []
        for r in t.to_pylist():
            if r["is_node"]:
                nodes.append((r["ca"], r["n"], r["cluster"]))
            else:
                edges.append((r["w"], r["a"], r["b"], r["ca"], r["cb"]))
        attached, merged, (n, cluster) = fold(sorted(nodes), edges, least)
        name = t["component"][0].as_py()
        out = [(0, c, g, None, w) for c, g, w in attached] + [(1, child, parent, None, w) for parent, child, w in merged] + [(2, name, cluster, n, None)]
        cols = list(zip(*out, strict=True))
        return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.float64())], names=["what", "c", "g", "n", "w"])

    for band in _bands(forest):
        mapped = band
        for end, side in (("a", "ca"), ("b", "cb")):
            mapped = mapped.join(at.select(F.col("id").alias(end), F.col("component").alias(side)), end)
        mapped = stored(mapped)
        inside = mapped.select(F.explode(F.array("ca", "cb")).alias("id")).distinct().select(F.lit("").alias("window"), "id")
        names = stored(components(inside, mapped.select(F.lit("").alias("window"), F.col("ca").alias("src"), F.col("cb").alias("dst"))).select(F.col("id").alias("ca"), "component"))
        own = names.join(state.withColumnRenamed("component", "ca"), "ca").withColumn("is_node", F.lit(True))
        links = mapped.join(names, "ca").withColumn("is_node", F.lit(False))
        got = stored(own.unionByName(links, allowMissingColumns=True).groupBy("component").applyInArrow(one, kind))
        merges.append(got.filter("what = 1").select(F.col("g").alias("parent"), F.col("c").alias("child"), "w"))
        new = got.filter("what = 0").select(F.col("c").alias("component"), F.col("g").alias("new_g"), F.col("w").alias("new_w"))
        moved = names.select(F.col("ca").alias("component"), F.col("component").alias("to"))
        at = at.join(new, "component", "left").join(moved, "component", "left")
        at = stored(at.select("id", "weight", F.coalesce("to", "component").alias("component"), F.coalesce("cluster", "new_g").alias("cluster"), F.when(F.col("cluster").isNotNull(), F.col("w")).otherwise(F.col("new_w")).alias("w")))
        rest = state.join(names.select(F.col("ca").alias("component")), "component", "left_anti")
        state = stored(rest.unionByName(got.filter("what = 2").select(F.col("c").alias("component"), "n", F.col("g").alias("cluster"))))
    spark = given.sparkSession
    tree = spark.createDataFrame([], "parent long, child long, w double")
    for m in merges:
        tree = tree.unionByName(m)
    return at.select("id", "weight", "cluster", "w"), stored(tree)


def _bands(forest: DataFrame) -> list[DataFrame]:
    """The edges in ascending bands of weight; equal weights stay together."""
    n = forest.count()
    most = max(BAND, n // BANDS)
    if n <= most:
        return [forest] if n else []
    parts = -(-n // most)
    cuts = sorted(set(forest.approxQuantile("w", [i / parts for i in range(1, parts)], 0.1 / parts)))
    place = sum((F.when(F.col("w") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    dealt = stored(forest.withColumn("band", place))
    return [dealt.filter(F.col("band") == i).drop("band") for i in range(len(cuts) + 1)]


def chosen(sums: dict[int, tuple[int, float]], merges: list[tuple[int, int, float]]) -> dict[int, int | None]:
    """Cluster -> the chosen cluster that it is or lies in, None if it lies in none. ``sums``: rows that attach to a cluster, and the sum of their 1 / distance.

    A cluster's stability is what its rows' densities (1 / distance) exceed the density at which it becomes part of another. It is chosen if it is as stable as the best choice below it; a single
    root, which is everything, isn't.
    """
    below: dict[int, list[int]] = {}
    above: dict[int, tuple[int, float]] = {}
    for parent, child, w in merges:
        below.setdefault(parent, []).append(child)
        above[child] = (parent, 1 / max(w, NEAR))
    every = set(sums) | set(below) | set(above)
    roots = sorted(every - set(above))
    order, todo = [], list(roots)
    while todo:
        c = todo.pop()
        order.append(c)
        todo += sorted(below.get(c, []))
    rows, stable, best, take = {}, {}, {}, set()
    for c in reversed(order):
        n, dense = sums.get(c, (0, 0.0))
        for x in below.get(c, []):
            n, dense = n + rows[x], dense + rows[x] * above[x][1]
        rows[c] = n
        stable[c] = dense - n * (above[c][1] if c in above else 0.0)
        under = sum(best[x] for x in sorted(below.get(c, [])))
        only = len(roots) == 1 and c == roots[0]
        if not only and stable[c] >= under:
            best[c] = stable[c]
            take.add(c)
        else:
            best[c] = under
    out: dict[int, int | None] = {}
    for c in order:
        lies_in = out.get(above[c][0]) if c in above else None
        out[c] = lies_in if lies_in is not None else c if c in take else None
    return out


def density_topics(df: DataFrame, key: str, vector: str, least: int = 200, k: int = 10, dims: int = 16, trees: int = 8) -> DataFrame:
    """key, topic, topic_probability of every row of ``df``: clusters by density of ``least`` rows or more, numbered from the largest; the rest, and rows without a vector, are topic -1
    with probability 0. The probability is a row's density (1 / the distance where it attaches) in units of the greatest in its topic.

    ``key`` is an integer column without nulls and without repeats. Clusters (at most 2 rows / ``least`` of them) are chosen on the driver.
    """
    rows = df.select(F.col(key).alias("own"), F.col(vector).alias("vector"))
    low = stored(reduced(rows, "own", "vector", dims))
    given = stored(points(low, "own", "vector"))
    forest = stored(spanning_forest(stored(reachability(stored(neighbours(given, max(k, 1) + 4, trees)), k))))
    at, tree = condensed(given, forest, least)
    dense = 1 / F.greatest(F.col("w"), F.lit(NEAR))
    at = stored(at.withColumn("dense", dense))
    sums = {r["cluster"]: (r["n"], r["s"]) for r in at.filter("cluster is not null").groupBy("cluster").agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("dense")).alias("s")).collect()}
    lies = chosen(sums, [tuple(r) for r in tree.collect()])
    spark = df.sparkSession
    names = spark.createDataFrame([(c, t) for c, t in lies.items() if t is not None], "cluster long, top long")
    placed = at.join(names, "cluster", "left")
    sizes = sorted(((-r["n"], r["top"], r["m"]) for r in placed.filter("top is not null").groupBy("top").agg(F.sum("weight").alias("n"), F.max("dense").alias("m")).collect()))
    topics = spark.createDataFrame([(t, i, m) for i, (_, t, m) in enumerate(sizes)], "top long, topic int, most double")
    of = placed.join(topics, "top", "left").select("id", F.coalesce("topic", F.lit(-1)).alias("topic"), F.when(F.col("topic").isNotNull(), F.col("dense") / F.col("most")).otherwise(0.0).alias("topic_probability"))
    # Rows meet their point by their vector.
    ids = low.join(given.select("vector", "id"), "vector").select("own", "id").join(of, "id").drop("id")
    got = rows.select("own").join(ids, "own", "left")
    return got.select(F.col("own").alias(key), F.coalesce("topic", F.lit(-1)).alias("topic"), F.coalesce("topic_probability", F.lit(0.0)).alias("topic_probability"))
