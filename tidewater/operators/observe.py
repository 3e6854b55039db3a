"""Strategies of rows and the (window, strategy) observation table, in long form; pivots are for sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OUTLIER = "MS_Outlier"


def map_strategies(df: DataFrame, mapping: DataFrame, key: str = "topic", strategy: str = "meta_strategy", default: str = OUTLIER) -> DataFrame:
    """Each row's strategy by its key, ``default`` where the mapping (key, strategy) has none. A mapping has one row a key."""
    return df.join(mapping.select(key, strategy), key, "left").withColumn(strategy, F.coalesce(strategy, F.lit(default)))


def observations(df: DataFrame, window: str = "time_window", strategy: str = "meta_strategy", sentiment: str = "sentiment", arousal: str | None = None) -> DataFrame:
    """time_window, meta_strategy, n, sentiment, arousal (means), popularity (share of the window); only what occurs."""
    aggs = [F.count("*").alias("n"), F.avg(sentiment).alias("sentiment"), (F.avg(arousal) if arousal else F.lit(0.0)).alias("arousal")]
    got = df.groupBy(F.col(window).alias("time_window"), F.col(strategy).alias("meta_strategy")).agg(*aggs)
    return got.withColumn("popularity", F.col("n") / F.sum("n").over(Window.partitionBy("time_window")))


def dense(obs: DataFrame) -> DataFrame:
    """``obs`` with a row of zeros for each (window, strategy) that doesn't occur. Both sides are distinct values of a table of groups."""
    grid = obs.select("time_window").distinct().crossJoin(obs.select("meta_strategy").distinct())
    return grid.join(obs, ["time_window", "meta_strategy"], "left").na.fill(0)


def matrix(obs: DataFrame, value: str, strategies: Sequence[str] | None = None) -> DataFrame:
    """One row a window, one column a strategy, 0 where none. Name the strategies for a stable schema and one pass less."""
    p = obs.groupBy("time_window").pivot("meta_strategy", list(strategies)) if strategies else obs.groupBy("time_window").pivot("meta_strategy")
    return p.agg(F.first(value)).na.fill(0)


def from_matrix(wide: DataFrame, value: str, window: str = "time_window") -> DataFrame:
    """Long form of a window-by-strategy matrix."""
    cols = [c for c in wide.columns if c != window]
    return wide.unpivot([window], cols, "meta_strategy", value)


def strategy_means(df: DataFrame, strategy: str = "meta_strategy") -> DataFrame:
    return df.groupBy(strategy).agg(F.count("*").alias("n"), F.avg("sentiment").alias("sentiment"), F.avg("arousal").alias("arousal"))
