"""Relevance and quality filters, deduplication, union of sources."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import lexicon as lx
from tidewater.functions import text as tx


def with_relevance(df: DataFrame, columns: Sequence[str], lex: lx.Lexicon, min_score: float = 3.5, min_core: int = 1, core_weight: float = 2.5, min_contrary: int = 2,
                   excluded: Iterable[str] = lx.EXCLUDED, removed: Iterable[str] = lx.REMOVED) -> DataFrame:
    """Adds relevance_score, n_core, n_contrary, is_related.

    Scores add up over the columns. Related: (score and core words reach their minima) or enough contrary words; one excluded word in any
    column makes the row unrelated with score 0. Without columns no row is related.
    """
    excluded, removed = list(excluded), list(removed)
    own, got = df.columns, df
    score, core, contrary, out = F.lit(0.0), F.lit(0), F.lit(0), F.lit(False)
    for i, c in enumerate(columns):
        # A generator is what no filter is pushed through: the text is cleaned and lowered once, whatever is asked of the result.
        got = got.select("*", F.inline(F.transform(F.array(tx.remove_words(F.col(c), removed)), _lowered(c, i))))
        low = F.col(f"_low{i}")
        out = out | tx.contains_any(low, excluded)
        score = score + tx.match_weight(low, lex, lowered=True) * F.col(f"_factor{i}")
        core = core + tx.match_weight(low, lex, least=core_weight, count=True, lowered=True)
        contrary = contrary + tx.match_weight(low, lex, only=set(lex.contrary), count=True, lowered=True)
    zeroed = lambda c, z: F.when(out, z).otherwise(c)
    sums = F.struct(zeroed(score, 0.0).alias("relevance_score"), zeroed(core, 0).alias("n_core"), zeroed(contrary, 0).alias("n_contrary"))
    got = got.select(*own, F.inline(F.array(sums)))
    related = ((F.col("relevance_score") >= min_score) & (F.col("n_core") >= min_core)) | (F.col("n_contrary") >= min_contrary)
    return got.withColumn("is_related", related if columns else F.lit(False))


def _lowered(c: str, i: int):
    """A cleaned text in lower case and its length factor, as struct<_low..., _factor...>; the factor is 0 where the column is null."""
    return lambda t: F.struct(F.lower(t).alias(f"_low{i}"), F.when(F.col(c).isNull(), 0.0).otherwise(tx.length_factor(t)).alias(f"_factor{i}"))


def clean_columns(df: DataFrame, removed: Iterable[str] = lx.REMOVED) -> DataFrame:
    """Every text column without the words that are removed; others as they are."""
    removed = list(removed)
    return df.select(*[tx.remove_words(F.col(f"`{c}`"), removed).alias(c) if kind == "string" else F.col(f"`{c}`") for c, kind in df.dtypes])


def split_related(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that are related, and all others."""
    yes = F.coalesce(F.col("is_related"), F.lit(False))
    return df.filter(yes), df.filter(~yes)


def keyword_counts(df: DataFrame, columns: Sequence[str], lex: lx.Lexicon, removed: Iterable[str] = lx.REMOVED) -> DataFrame:
    """keyword, n: in how many (row, column) cells each keyword stands."""
    removed = list(removed)
    cells = reduce(lambda a, b: F.concat(a, b), [F.transform(tx.keyword_matches(tx.remove_words(F.col(c), removed), lex), lambda m: m.keyword) for c in columns])
    return df.select(F.explode(cells).alias("keyword")).groupBy("keyword").agg(F.count("*").alias("n"))


def top(df: DataFrame, count: str, key: str, k: int) -> DataFrame:
    """The ``k`` rows with the largest count; ties by key."""
    return df.orderBy(F.desc(count), F.asc(key)).limit(k)


def good_quality(df: DataFrame, column: str) -> DataFrame:
    return df.filter(tx.quality_reason(F.col(column)) == "ok")


def keep_first(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order``, which must leave no ties."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).filter("_place = 1").drop("_place")


def dedup_id(df: DataFrame, id_col: str, order: Sequence[Column], collapse_null_ids: bool = False) -> DataFrame:
    """One row for each id. Rows without an id are all kept, unless ``collapse_null_ids`` takes null as an id."""
    if collapse_null_ids:
        return keep_first(df, [id_col], order)
    return keep_first(df.filter(F.col(id_col).isNotNull()), [id_col], order).unionByName(df.filter(F.col(id_col).isNull()))


def dedup_content(df: DataFrame, column: str, interaction: str | None, tie: str) -> DataFrame:
    """The row with the most interaction of each content fingerprint; ties go to the smallest ``tie``."""
    order = ([F.col(interaction).desc_nulls_last()] if interaction else []) + [F.col(tie).asc()]
    return keep_first(df.withColumn("_print", tx.fingerprint(F.col(column))), ["_print"], order).drop("_print")


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all frames; columns meet by name, missing ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def sample(df: DataFrame, id_col: str, k: int = 1000) -> DataFrame:
    """At most ``k`` rows in the order of the md5 of their id: the same ones however the rows are spread."""
    return df.orderBy(F.md5(F.col(id_col).cast("string")), id_col).limit(k)


def first_column(columns: Sequence[str], candidates: Sequence[str], required: bool = False) -> str | None:
    """The first candidate that is there."""
    for c in candidates:
        if c in columns:
            return c
    if required:
        raise ValueError(f"none of {list(candidates)} is among {list(columns)}")
    return None
