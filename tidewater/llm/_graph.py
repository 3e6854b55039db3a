"""Connected components of an edge table, by alternating stars; nothing reaches the driver but counts.

Each round replaces edges so that every node points to a smaller one (large star), then to the smallest that its
neighbourhood knows (small star), until nothing changes. Both are a minimum per node (partial aggregation) joined to the edges,
so a node with very many edges is pre-aggregated, and AQE can split it in the join. Rounds are written to the
shared folder; a round's table goes when the next one is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm._frames import forget, stored


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a > b). Large star: the greater neighbours of each node go to the least of its neighbours and itself;
    small star: its smaller neighbours and itself do."""
    if large:
        both = edges.select(F.col("b").alias("u"), F.col("a").alias("v")).unionByName(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        up = both.filter(F.col("v") > F.col("u"))
        out = up.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy(F.col("a")).agg(F.min("b").alias("m"))
        out = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node of ``edges`` (a long, b long).

    Loops, repeated edges and either order of the ends are fine; rows with a null end are ignored.
    """
    e = stored(edges.filter("a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    state = _state(e)
    while state[0]:
        last, e = e, stored(_star(_star(e, True), False))
        now = _state(e)
        forget(last)
        if now == state:
            break
        state = now
    # Now every node but a root has one edge, to its root.
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


class Forest:
    """Union-find over 64-bit node names for one task: merges many edges into a star for each component."""

    def __init__(self, most: int = 500_000):
        self.up: dict[int, int] = {}
        self.most = most

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (p := up.setdefault(root, root)) != root:
            root = p
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    def union(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def full(self) -> bool:
        return len(self.up) >= self.most

    def stars(self) -> list[tuple[int, int]]:
        """An edge from each node to its root; empties the forest."""
        out = [(x, r) for x in list(self.up) if (r := self.find(x)) != x]
        self.up = {}
        return out
