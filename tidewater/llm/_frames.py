"""Column picking, shared storage and size-checked broadcasts."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only if its counted rows take at most so many bytes.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly these columns, matched by exact name, however many others there are."""
    place: dict[str, int] = {}
    for i, c in enumerate(df.columns):
        place.setdefault(c, i)
    missing = [n for n in names if n not in place]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{place[n]}").alias(n) for n in names])


#: Bytes of an Arrow batch between Spark and a worker; with whole texts in it, the default of 64 MB is many times the rest.
BATCH_BYTES = 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches of its session limited to ``BATCH_BYTES``."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def docs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` long and ``text`` string without nulls in ``text``."""
    d = small_batches(pick(df, id_col, text_col)).toDF("doc_id", "text")
    return d.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir, which driver and executors share.

    Only where that setting is missing and everything runs on one machine (tests) a local default is set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file:///tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with columns c0, c1, ..., which clash with nothing."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors. Columns may differ only by case."""
    spark, plain = df.sparkSession, numbered(df)
    path = shared_dir(spark)
    plain.write.parquet(path)
    return spark.read.schema(plain.schema).parquet(path).toDF(*df.columns)


def forget(df: DataFrame) -> None:
    """Deletes the files of ``df``, a table from ``stored`` that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let_go(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files that nothing refers to any more, which it does when the driver collects garbage; for after a large shuffle whose result is stored."""
    gc.collect()
    spark._jvm.System.gc()


def _width(kind: T.DataType, value: Column) -> Column:
    """Bytes of a value, about: what it holds and 8 for a place; elements of arrays by their own width."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return 16 + F.coalesce(F.octet_length(value), F.lit(0))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StringType | T.BinaryType | T.ArrayType | T.StructType):
            return 16 + F.coalesce(F.aggregate(value, F.lit(0).cast("long"), lambda a, x: a + _width(kind.elementType, x).cast("long")), F.lit(0))
        return 16 + 8 * F.coalesce(F.size(value), F.lit(0))
    if isinstance(kind, T.StructType):
        return sum((_width(f.dataType, value[f.name]) for f in kind.fields), F.lit(8))
    return F.lit(8)


def weight(df: DataFrame) -> int:
    """Bytes of all rows of ``df``, counted."""
    row = sum((_width(f.dataType, F.col(f.name)) for f in df.schema.fields), F.lit(16))
    return df.agg(F.sum(row.cast("long"))).first()[0] or 0


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if its counted bytes are within the bound, else as it is. ``df`` is read twice: give a stored table."""
    return F.broadcast(df) if weight(df) <= BROADCAST_BYTES else df


#: Bits of a sieve: 8 MB however many keys there are.
SIEVE = 1 << 26


def _sieved(df: DataFrame, th: str, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows of ``df`` whose hash ``th`` may be among ``keys``, the others), without moving any row: by a bitmap of fixed size."""
    place = lambda c: F.pmod(F.col(c), F.lit(SIEVE))
    bits = keys.groupBy(F.bitmap_bucket_number(place(key)).alias("s_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place(key))).alias("s_bits"))
    bits = stored(bits)
    spot = F.bitmap_bit_position(place(th)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("s_bits"), (spot / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.expr("shiftright(s_byte, s_at)").bitwiseAND(1) == 1, F.lit(False))
    own = df.join(F.broadcast(bits), F.bitmap_bucket_number(place(th)) == F.col("s_bucket"), "left").withColumn("s_byte", byte).withColumn("s_at", F.pmod(spot, F.lit(8)))
    own = own.withColumn("s_hit", hit)
    return own.filter("s_hit").select(*df.columns), own.filter("not s_hit").select(*df.columns)


def few_key(id_col: str, th_col: str) -> Column:
    """A hash of a document's id and text for a sieve, so that copies of a text under other ids are told apart."""
    return F.xxhash64(F.col(id_col).cast("string"), F.col(th_col))


def meet_few(df: DataFrame, few: DataFrame, how: str, id_col: str = "doc_id", th_col: str = "th") -> DataFrame:
    """``df`` joined (inner, left or left_anti) to ``few`` (b_id, b_th, others) by document, a null id like other values.

    ``few`` is broadcast if its bytes are within the bound. Else a sieve picks the rows of ``df`` that may have a partner, and only these, with their
    texts, are shuffled. For left_anti only their ids and hashes are: what the sieve picks without a partner is so little that it is broadcast, within the bound, and no text moves.
    ``few`` is a stored table with one row for each (b_id, b_th); the columns of ``df`` clash with none of its.
    """
    on = F.col(id_col).eqNullSafe(F.col("b_id")) & (F.col(th_col) == F.col("b_th"))
    others = [c for c in few.columns if c not in ("b_id", "b_th")] if how != "left_anti" else []
    if weight(few) <= BROADCAST_BYTES:
        return df.join(F.broadcast(few), on, how).select(*df.columns, *others)
    maybe, never = _sieved(df.withColumn("s_key", few_key(id_col, th_col)), "s_key", few.select(few_key("b_id", "b_th").alias("b_key")), "b_key")
    maybe, never = maybe.drop("s_key"), never.drop("s_key")
    if how == "left_anti":
        spared = maybe.select(id_col, th_col).join(few, on, how)
        spared = stored(spared.select(F.col(id_col).alias("b_id"), F.col(th_col).alias("b_th")).distinct())
        if weight(spared) <= BROADCAST_BYTES:
            return maybe.join(F.broadcast(spared), on, "left_semi").unionByName(never)
    met = maybe.join(few, on, how).select(*df.columns, *others)
    if how == "inner":
        return met
    return met.unionByName(never.select(*df.columns, *[F.lit(None).cast(few.schema[c].dataType).alias(c) for c in others]))
