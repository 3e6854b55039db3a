"""Line deduplication by range-partitioned line hashes; DataFrame functions only.

A line's key is the line without white space (20, 09-0D) at both ends and with A-Z in
lower case. Rows (128-bit key hash, salt, document, position) are range partitioned by key hash and salt, and sorted by document and
position inside each part of a key. The salt is a hash of the document, so a key found in a third of all lines is spread over as many
parts as there are partitions. A window streams each part in that order: a row whose document isn't the one before counts one document more, and the part's
first row is its first occurrence. One partial row a part (documents, first occurrence) meets the others of its key in a second
exchange. The result is a compressed keep bitmap per document, never text:
alternating run lengths of kept and dropped lines, beginning with kept ones. Texts are moved only if the bitmaps are too many to broadcast,
and then only those that may lose a line.

Modes: ``drop="all"`` drops every line whose key is found in at least ``min_docs`` documents;
``drop="later"`` keeps the first one in order of (document, position).
Keys shorter than ``min_chars`` code points are always kept.

A document is a (doc_id, text): rows that repeat both are one document and get the same bitmap. Null or empty text:
one empty line. A null doc_id is a value like others. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm._frames import docs, meet_few, small, stored

UPPER, LOWER_ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER_)


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _keyed(df: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, th (hash of the text), pos, h1, h2 of every line with a key that is long enough."""
    lines = df.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    keyed = lines.select("doc_id", "th", "pos", line_key(F.col("line")).alias("key"))
    if min_chars > 0:
        keyed = keyed.filter(F.char_length("key") >= min_chars)
    return keyed.select("doc_id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


def keep_bitmaps(df: DataFrame, min_docs: int = 10, min_chars: int = 1, drop: str = "all") -> DataFrame:
    """doc_id, th, keep_runs (array of int) of the documents that lose a line; ``df`` has doc_id and text."""
    if drop not in ("all", "later"):
        raise ValueError(f"drop is all or later, not {drop}")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = ["h1", "h2", "salt"]
    # Range partitioning reads its input twice, and the rows are used twice: they are made once, without text.
    keyed = stored(_keyed(df, min_chars).withColumn("salt", F.pmod(F.xxhash64("doc_id", "th"), F.lit(n)).cast("int")))
    placed = keyed.repartitionByRange(n, *part).sortWithinPartitions(*part, "doc_id", "th", "pos")
    stream = Window.partitionBy(*part).orderBy("doc_id", "th", "pos")
    same = F.lag("doc_id").over(stream).eqNullSafe(F.col("doc_id")) & F.coalesce(F.lag("th").over(stream) == F.col("th"), F.lit(False))
    streamed = placed.select(*part, "doc_id", "th", "pos", same.alias("same"), F.row_number().over(stream).alias("nth"))
    totals = [F.count_if(~F.col("same")).alias("n_docs")]
    if drop == "later":
        totals.append(F.max(F.when(F.col("nth") == 1, F.struct("doc_id", "th", "pos"))).alias("first"))
    partial = streamed.groupBy(*part).agg(*totals)
    together = [F.sum("n_docs").alias("n_docs")] + ([F.min("first").alias("first")] if drop == "later" else [])
    frequent = stored(partial.groupBy("h1", "h2").agg(*together).filter(F.col("n_docs") >= min_docs))
    hit = keyed.join(small(frequent), ["h1", "h2"])
    if drop == "later":
        is_first = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.th") == F.col("th")) & (F.col("first.pos") == F.col("pos"))
        hit = hit.filter(~is_first)
    return _runs(hit.select("doc_id", "th", "pos"))


def _runs(dropped: DataFrame) -> DataFrame:
    """Alternating lengths of kept and dropped runs of each document from its dropped positions."""
    at = Window.partitionBy("doc_id", "th").orderBy("pos")
    begins = dropped.withColumn("begins", F.when(F.col("pos") - F.lag("pos").over(at) <= 1, 0).otherwise(1))
    runs = begins.withColumn("run", F.sum("begins").over(at)).groupBy("doc_id", "th", "run").agg(F.min("pos").alias("pos"), F.max("pos").alias("last"))
    gaps = runs.withColumn("kept", F.col("pos") - F.coalesce(F.lag("last").over(at) + 1, F.lit(0)))
    pairs = F.sort_array(F.collect_list(F.struct("pos", "kept", (F.col("last") - F.col("pos") + 1).alias("lost"))))
    return gaps.groupBy("doc_id", "th").agg(F.flatten(F.transform(pairs, lambda r: F.array(r.kept, r.lost))).alias("keep_runs"))


def with_bitmaps(df: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` and each row's keep_runs, null where it loses nothing; no column of ``df`` is named keep_runs, b_id, b_th or own_th."""
    few = stored(bitmaps.select(F.col("doc_id").alias("b_id"), F.col("th").alias("b_th"), "keep_runs"))
    return meet_few(df.withColumn("own_th", F.xxhash64(text_col)), few, "left", id_col, "own_th").drop("own_th")


def n_dropped(runs: Column) -> Column:
    return F.coalesce(F.aggregate(F.filter(runs, lambda x, i: i % 2 == 1), F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")


def kept_text(text: Column, runs: Column) -> Column:
    """The kept lines joined by line feeds; the text itself where runs are null."""
    ones, zeros = F.lit("1"), F.lit("0")
    bits = F.encode(F.array_join(F.transform(runs, lambda x, i: F.when(i % 2 == 0, F.repeat(ones, x)).otherwise(F.repeat(zeros, x))), ""), "utf-8")
    # A position past the last dropped run has an empty byte string, not "0".
    kept = F.filter(split_lines(text), lambda line, i: F.substring(bits, i + 1, 1) != F.lit(b"0"))
    return F.when(runs.isNull(), text).otherwise(F.array_join(kept, "\n"))


def dedup_lines(df: DataFrame, min_docs: int = 10, min_chars: int = 1, drop: str = "all") -> DataFrame:
    """doc_id, text (kept lines), n_lines, n_dropped, keep_runs of every row."""
    d = docs(df)
    got = with_bitmaps(d, keep_bitmaps(d, min_docs, min_chars, drop))
    return got.select("doc_id", kept_text(F.col("text"), F.col("keep_runs")).alias("text"), F.size(split_lines(F.col("text"))).cast("long").alias("n_lines"), n_dropped(F.col("keep_runs")).alias("n_dropped"), "keep_runs")
