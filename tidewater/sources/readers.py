"""Readers: CSV globs, matrices, JSON documents, Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewater.operators.observe import from_matrix


def read_posts(spark: SparkSession, path: str | list[str], schema: StructType | None = None, tolerant: bool = True) -> DataFrame:
    """CSV files of a glob (or of a list) with a header, and each row's file name as source_file. No file at all is an error.

    Fields may hold line breaks and doubled quotes; a byte order mark is skipped. ``tolerant``: rows that can't be parsed have nulls, files that
    can't be read are skipped; else either fails the read.
    """
    if isinstance(path, str) and not _matches(spark, path):
        raise FileNotFoundError(path)
    r = spark.read.options(header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE" if tolerant else "FAILFAST", ignoreCorruptFiles=tolerant, encoding="UTF-8")
    df = (r.schema(schema) if schema else r).csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns]).withColumn("source_file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def _matches(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_matrix(spark: SparkSession, path: str, value: str = "n") -> DataFrame:
    """Long form of a window-by-strategy CSV whose first column is the window."""
    wide = spark.read.options(header=True).csv(path)  # nothing is inferred: a window such as 2024-01 is no date
    named = wide.withColumnRenamed(wide.columns[0], "time_window")
    rest = [c for c in named.columns if c != "time_window"]
    return from_matrix(named.select("time_window", *[F.col(f"`{c}`").cast("double").alias(c) for c in rest]), value)


def read_document(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A JSON document over several lines a file, or with ``lines`` an object in each line, as ``write_json`` writes them."""
    return spark.read.option("multiLine", not lines).json(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
