"""Strategy competition per window: replicator dynamics and equilibria, without Python in the plan.

One row a window carries the strategies' state as an array; the Euler steps are a fold over a sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import lexicon as lx
from tidewater.functions import math as mx
from tidewater.functions import text as tx

ALPHA, BETA, DT, STEPS, CLOSE = 0.45, 0.45, 0.01, 1000, 1e-4


def replicator(x: Column, utilities: Column) -> Column:
    """x (u - x.u), element by element."""
    return mx.let(mx.dot(x, utilities), lambda mean: F.zip_with(x, utilities, lambda a, u: a * (u - mean)))


def step(x: Column, fixed: Column, alpha: float, dt: float) -> Column:
    """The next state; ``fixed`` is what utility has besides alpha * popularity."""
    u = F.zip_with(x, fixed, lambda a, f: alpha * a + f)
    return mx.let(u, lambda u: mx.renormalised(F.zip_with(x, replicator(x, u), lambda a, d: a + dt * d)))


def evolve(x: Column, fixed: Column, alpha: float = ALPHA, dt: float = DT, steps: int = STEPS, close: float = CLOSE) -> Column:
    """struct<x, done, n>: the state after ``steps`` Euler steps, or before the first one shorter than ``close``; n steps were taken."""
    state = lambda x, done, n: F.struct(x.alias("x"), done.alias("done"), n.alias("n"))
    start = state(mx.let(mx.total(x), lambda s: F.when(s > 0, F.transform(x, lambda a: a / s)).otherwise(F.transform(x, lambda _: 1.0 / F.size(x)))), F.lit(False), F.lit(0))

    def on(s: Column, _: Column) -> Column:
        moved = mx.let(step(s["x"], fixed, alpha, dt), lambda y: F.struct(y.alias("y"), (F.sqrt(mx.total(F.zip_with(y, s["x"], lambda a, b: (a - b) * (a - b)))) < close).alias("near")))
        went = mx.let(moved, lambda m: F.when(m["near"], state(s["x"], F.lit(True), s["n"])).otherwise(state(m["y"], F.lit(False), s["n"] + 1)))
        return F.when(s["done"], s).otherwise(went)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, on)


def simulate(obs: DataFrame, names: bool = False, alpha: float = ALPHA, beta: float = BETA, default_cost: float = lx.DEFAULT_COST, **how) -> DataFrame:
    """time_window, meta_strategy, initial, final, steps of every active strategy (n > 0) of ``obs``; windows without one vanish.

    ``names``: costs follow the strategies' names; else all have the default cost.
    """
    cost = tx.strategy_cost(F.col("meta_strategy"), default=default_cost) if names else F.lit(default_cost)
    active = obs.filter(F.col("n") > 0).withColumn("_cost", cost)
    entry = F.struct("meta_strategy", F.col("n").cast("double").alias("n"), (beta * F.coalesce(F.col("sentiment"), F.lit(0.0)) - F.col("_cost")).alias("fixed"))
    rows = active.groupBy("time_window").agg(F.sort_array(F.collect_list(entry)).alias("s"))
    parts = rows.select("time_window", F.transform("s", lambda e: e.meta_strategy).alias("names"), F.transform("s", lambda e: e.n).alias("x"), F.transform("s", lambda e: e.fixed).alias("fixed"))
    done = parts.withColumn("end", evolve(F.col("x"), F.col("fixed"), alpha, **how))
    flat = done.select("time_window", F.col("end.n").alias("steps"), F.expr("aggregate(x, 0D, (a, b) -> a + b)").alias("total"), F.posexplode(F.arrays_zip("names", "x", F.col("end.x").alias("end"))).alias("i", "e"))
    return flat.select("time_window", F.col("e.names").alias("meta_strategy"), (F.col("e.x") / F.col("total")).alias("initial"), F.col("e.end").alias("final"), "steps")


def trajectory(obs: DataFrame, every: int = 1, alpha: float = ALPHA, beta: float = BETA, default_cost: float = lx.DEFAULT_COST, dt: float = DT, steps: int = STEPS, close: float = CLOSE) -> DataFrame:
    """time_window, iteration, meta_strategy, share: the states that the simulation goes through, every ``every`` steps."""
    marks = F.explode(F.sequence(F.lit(0), F.lit(steps), F.lit(every)))
    entry = F.struct("meta_strategy", F.col("n").cast("double").alias("n"), (beta * F.coalesce(F.col("sentiment"), F.lit(0.0)) - default_cost).alias("fixed"))
    rows = obs.filter(F.col("n") > 0).groupBy("time_window").agg(F.sort_array(F.collect_list(entry)).alias("s"))
    x, fixed = F.transform("s", lambda e: e.n), F.transform("s", lambda e: e.fixed)
    state = F.struct(mx.let(mx.total(x), lambda t: F.transform(x, lambda a: a / t)).alias("x"), F.lit(False).alias("done"))

    def on(hist: Column, _: Column) -> Column:
        s = F.element_at(hist, -1)
        y = step(s["x"], fixed, alpha, dt)
        near = lambda y: F.sqrt(mx.total(F.zip_with(y, s["x"], lambda a, b: (a - b) * (a - b)))) < close
        more = mx.let(y, lambda y: F.when(near(y), F.transform(hist, lambda h: F.struct(h["x"].alias("x"), F.lit(True).alias("done")))).otherwise(F.concat(hist, F.array(F.struct(y.alias("x"), F.lit(False).alias("done"))))))
        return F.when(s["done"], hist).otherwise(more)

    hist = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.array(state), on)
    own = rows.select("time_window", F.transform("s", lambda e: e.meta_strategy).alias("names"), hist.alias("hist")).withColumn("iteration", marks)
    one = own.filter(F.col("iteration") < F.size("hist")).select("time_window", "iteration", "names", F.get("hist", F.col("iteration"))["x"].alias("x"))
    return one.select("time_window", "iteration", F.explode(F.arrays_zip("names", "x")).alias("e")).select("time_window", "iteration", F.col("e.names").alias("meta_strategy"), F.col("e.x").alias("share"))


def equilibria(sim: DataFrame) -> DataFrame:
    """time_window, dominant_strategy (ties: first by name), dominant_ratio, diversity, equilibrium_type, n_active_strategies."""
    w = Window.partitionBy("time_window").orderBy(F.desc("final"), F.asc("meta_strategy"))
    placed = sim.withColumn("_place", F.row_number().over(w))
    got = placed.groupBy("time_window").agg(
        F.max(F.when(F.col("_place") == 1, F.col("meta_strategy"))).alias("dominant_strategy"),
        F.max("final").alias("dominant_ratio"),
        mx.entropy(F.col("final")).alias("diversity"),
        F.count("*").alias("n_active_strategies"),
    )
    kind = F.when(F.col("dominant_ratio") > 0.8, "主导均衡").when(F.col("diversity") > 0.8, "混合均衡").otherwise("部分主导")
    return got.withColumn("equilibrium_type", kind)
