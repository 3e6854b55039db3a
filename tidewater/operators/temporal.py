"""Short texts, suspected bots, calendar windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions import math as mx
from tidewater.operators.screening import first_column

TIME_COLUMNS = ("日期", "发布时间", "time", "date", "时间")


def drop_short(df: DataFrame, column: str, least: int = 5) -> DataFrame:
    return df.filter(F.char_length(column) >= least)


def drop_bots(df: DataFrame, user: str, most: int = 100) -> DataFrame:
    """Without the rows of users with more than ``most`` rows; rows without a user stay. A frame without the column stays as it is."""
    if user not in df.columns:
        return df
    busy = df.groupBy(user).agg(F.count(user).alias("_n")).filter(F.col("_n") > most).select(user)
    return df.join(busy, user, "left_anti")


def window_counts(df: DataFrame, window: str = "time_window") -> DataFrame:
    return df.groupBy(window).agg(F.count("*").alias("n"))


def with_windows(df: DataFrame, time_col: str | None = None, unit: str = "M", min_docs: int = 100, candidates: Sequence[str] = TIME_COLUMNS) -> DataFrame:
    """Adds time_window. Rows whose time can't be read go, then windows with fewer than ``min_docs`` rows.

    The time column is ``time_col``, else the first candidate there; without any all rows are in window 0.
    """
    if unit not in ("M", "W", "D"):
        raise ValueError(f"unit is M, W or D, not {unit!r}")
    c = time_col if time_col in df.columns else first_column(df.columns, candidates)
    if c is None:
        return df.withColumn("time_window", F.lit("0"))
    ts = F.col(c) if dict(df.dtypes)[c].startswith("timestamp") else mx.to_time(F.col(c))
    timed = df.withColumn("_ts", ts).filter(F.col("_ts").isNotNull()).withColumn("time_window", mx.period(F.col("_ts"), unit)).drop("_ts")
    full = window_counts(timed).filter(F.col("n") >= min_docs).select("time_window")
    return timed.join(full, "time_window", "left_semi").select(*df.columns, "time_window")
