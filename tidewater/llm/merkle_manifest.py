"""Merkle manifest of a dataset: a leaf for each row, a tree for each source, a tree over the sources.

A leaf is the hash of a row's fields, each written as ``-`` (null) or its length in bytes, a colon and its value. Leaves of a source ascend by doc_id (nulls
first; rows that share an id by their leaves, so repeated rows are neighbours with equal leaves). While a level has several nodes, every 16 consecutive ones
become the hash of their digests, concatenated as hex. What remains is the source's root; those, ordered by source (null first, then by bytes), are
the leaves of the outer tree.

How it runs. Spark hashes rows, sorts the light leaf table by ranges of (source, doc_id, leaf) and numbers each source's leaves by prefix sums over the
sorted partitions, so a source with a third of all rows is spread over as many tasks as any other. 16**3 consecutive leaves are a bucket. Buckets are whole
in a task, which feeds them as Arrow tables, a bounded number at a time, to DuckDB: three level queries (ordered ``string_agg``, ``sha256``) give the bucket's
root. The roots are again numbered nodes, and the same step folds them until each source has one. The way up (digests to the left and to the right
on each level) of a bucket is joined to it, and a second pass over buckets derives each leaf's proof and folds it.

An empty table gives an empty manifest. Other columns are ignored, whatever their names. Texts of any length are hashed once, by Spark; no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm._frames import pick, small, small_batches, stored

#: Children of a node.
ARITY = 16
#: Levels that a bucket folds, and its leaves.
DEPTH = 3
BUCKET = ARITY**DEPTH
#: Leaves that DuckDB gets at a time: whole buckets until there are so many. A bucket has at most 4,096.
BLOCK_ROWS = 1 << 14
UPPER, LOWER_ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(c: Column) -> Column:
    """A field as it goes into a leaf."""
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(*fields: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def leaves(df: DataFrame) -> DataFrame:
    """doc_id, source, leaf and, where 5 divides the id's checksum, the leaf of the row with its text in lower case (``tampered``, else null)."""
    d = small_batches(pick(df, *FIELDS))
    own = [F.col(c) for c in FIELDS]
    changed = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 5 == 0
    tampered = F.when(changed, leaf(*own[:-1], F.translate("text", UPPER, LOWER_)))
    return d.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf(*own).alias("leaf"), tampered.alias("tampered"))


def placed(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``df`` (a stored table) as nodes: ``group`` named grp, ``pos``, a row's place in its group in this order, and ``n``, the group's rows.

    Written before it is numbered and after, so that a task that runs again finds the same numbers.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.withColumnRenamed(group, "grp").repartitionByRange(parts, "grp", *order).sortWithinPartitions("grp", *order)
    # Ids count up by one inside a partition, where the rows of a group are consecutive.
    rows = stored(spread.withColumn("row", F.monotonically_increasing_id())).withColumn("part", F.shiftright("row", 33))
    per = rows.groupBy(F.col("grp").alias("of"), F.col("part").alias("of_part")).agg(F.min("row").alias("first"), F.count("*").alias("rows"))
    before = Window.partitionBy("of").orderBy("of_part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start")
    per = stored(per.select("of", "of_part", "first", start, F.sum("rows").over(Window.partitionBy("of")).alias("n")))
    met = rows.join(small(per), F.col("grp").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")))
    own = [c for c in rows.columns if c not in ("row", "part")]
    return stored(met.select(*own, (F.col("row") - F.col("first") + F.col("start")).alias("pos"), "n"))


def _bucketed(nodes: DataFrame, ways: DataFrame | None = None, *more: str) -> DataFrame:
    """Whole buckets in a task, in order; before a bucket's nodes stands a row with pos -1, the bucket's way and its group's root, if these are given."""
    levels = sum((F.when(F.col("n") > ARITY**k, 1).otherwise(0) for k in range(DEPTH)), F.lit(0))
    b = nodes.select("grp", F.floor(F.col("pos") / BUCKET).cast("long").alias("bucket_no"), "pos", levels.cast("int").alias("levels"), "h", *more)
    if ways is not None:
        b = b.unionByName(ways.withColumn("pos", F.lit(-1).cast("long")), allowMissingColumns=True)
    return b.repartition("grp", "bucket_no").sortWithinPartitions("grp", "bucket_no", "pos")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole buckets, some BLOCK_ROWS rows at a time, from rows that are sorted by bucket."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.num_rows for x in held) < BLOCK_ROWS:
            continue
        t = pa.Table.from_batches(held)
        at = lambda i, t=t: (t["grp"][i].as_py(), t["bucket_no"][i].as_py())
        cut, end, last = 0, t.num_rows - 1, at(t.num_rows - 1)
        while cut < end:  # the first row of the last bucket, which may go on in the next batch
            mid = (cut + end) // 2
            cut, end = (cut, mid) if at(mid) == last else (mid + 1, end)
        if cut:
            yield t.slice(0, cut)
        held = t.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator:
    """A connection for each block, with tables block (all rows and ``bucket``, a number) and l0, l1, ... (the nodes of each level)."""
    import duckdb

    # A task has one core; a block has a few MB.
    con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
    for given in _blocks(batches):
        con.register("given", given)
        con.execute("CREATE OR REPLACE TEMP TABLE block AS SELECT *, dense_rank() OVER (ORDER BY grp NULLS FIRST, bucket_no) AS bucket FROM given")
        con.unregister("given")
        con.execute("CREATE OR REPLACE TEMP TABLE l0 AS SELECT bucket, pos, levels, h FROM block WHERE pos >= 0")
        for k in range(DEPTH):
            con.execute(
                f"""CREATE OR REPLACE TEMP TABLE l{k + 1} AS SELECT bucket, pos // {ARITY} AS pos, any_value(levels) AS levels, sha256(string_agg(h, '' ORDER BY pos)) AS h
                FROM l{k} WHERE levels > {k} GROUP BY bucket, pos // {ARITY}"""
            )
        yield con
    con.close()


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tops = " UNION ALL ".join(f"SELECT bucket, h FROM l{k} WHERE levels = {k}" for k in range(DEPTH + 1))
    kind = pa.schema([("grp", pa.string()), ("bucket_no", pa.int64()), ("h", pa.string())])
    for con in _folded(batches):
        got = con.sql(f"SELECT b.grp, b.bucket_no, t.h FROM ({tops}) t JOIN (SELECT DISTINCT grp, bucket_no, bucket FROM block) b USING (bucket)")
        yield from got.to_arrow_table().cast(kind).to_batches()


def bucket_roots(nodes: DataFrame) -> DataFrame:
    """grp, bucket_no, h (the bucket's root) of ``nodes``."""
    return stored(_bucketed(nodes).mapInArrow(_roots, "grp string, bucket_no long, h string"))


def _climbed() -> str:
    """SQL: the nodes of a block with the way of each: the digests to the left and to the right on each level, of the bucket and above it."""
    beside = f"""SELECT bucket, pos, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
        coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
        FROM l{{k}} WHERE levels > {{k}} WINDOW w AS (PARTITION BY bucket, pos // {ARITY} ORDER BY pos)"""
    step = "CASE WHEN w{k}.pos IS NULL THEN [] ELSE [{{'l': w{k}.l, 'r': w{k}.r}}] END"
    steps = " || ".join(step.format(k=k) for k in range(DEPTH))
    joins = " ".join(f"LEFT JOIN ({beside.format(k=k)}) w{k} ON w{k}.bucket = n.bucket AND w{k}.pos = n.pos // {ARITY**k}" for k in range(DEPTH))
    return f"SELECT n.*, {steps} || u.way AS up, u.h AS subroot FROM (SELECT * FROM block WHERE pos >= 0) n JOIN (SELECT bucket, way, h FROM block WHERE pos < 0) u ON u.bucket = n.bucket {joins}"


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    way = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))
    kind = pa.schema([("grp", pa.string()), ("pos", pa.int64()), ("way", way), ("name", pa.string()), ("h", pa.string())])
    for con in _folded(batches):
        for b in con.sql(f"SELECT grp, pos, up, name, h FROM ({_climbed()})").to_arrow_reader(2048):
            yield from pa.Table.from_batches([b]).rename_columns(kind.names).cast(kind).to_batches()


def _proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string())])
    for con in _folded(batches):
        above = con.execute("SELECT max(len(way)) FROM block WHERE pos < 0").fetchall()[0][0]
        fold = "coalesce(tampered, h)"
        sql = f"SELECT *, {fold} AS f FROM ({_climbed()})"
        for k in range(1, DEPTH + above + 1):
            sql = f"SELECT * REPLACE (CASE WHEN len(up) >= {k} THEN sha256(up[{k}].l || f || up[{k}].r) ELSE f END AS f) FROM ({sql})"
        proof = "sha256(array_to_string(list_transform(up, lambda x: x.l || x.r), ''))"
        for b in con.sql(f"SELECT doc_id, h, subroot, {proof}, f FROM ({sql})").to_arrow_reader(8192):
            yield from pa.Table.from_batches([b]).rename_columns(kind.names).cast(kind).to_batches()


_WAY = "array<struct<l:string,r:string>>"


def climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of every DEPTH-th level, and (grp, h): the root of each group."""
    levels = [nodes]
    while True:
        roots = bucket_roots(levels[-1])
        if (levels[-1].agg(F.max("n")).first()[0] or 0) <= BUCKET:
            return levels, roots.select("grp", "h")
        sizes = stored(levels[-1].filter("pos = 0").select(F.col("grp").alias("of"), F.ceil(F.col("n") / BUCKET).cast("long").alias("n")))
        met = roots.join(small(sizes), F.col("grp").eqNullSafe(F.col("of")))
        levels.append(stored(met.select("grp", F.col("bucket_no").alias("pos"), "n", "h", F.lit(None).cast("string").alias("name"))))


def descend(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """grp, bucket_no, way, h (as in ``tops``) of the buckets of ``levels[0]``, from the same of each group's last bucket."""
    ways = tops
    for nodes in reversed(levels[1:]):
        got = _bucketed(nodes, ways, "name").mapInArrow(_ways, f"grp string, pos long, way {_WAY}, name string, h string")
        own = got.select("grp", F.col("pos").alias("bucket_no"), "way")
        of = tops.select(F.col("grp").alias("of"), F.col("h"))
        ways = stored(own.join(small(of), F.col("grp").eqNullSafe(F.col("of"))).drop("of"))
    return ways


def manifest(df: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of ``df`` (the columns of FIELDS).

    proof_sha256 is the hash of all digests on the way to the root, by level, from left to right; folded_root is the root that this way gives for the
    row's leaf, or for the tampered one where there is one; verified says whether it is the root.
    """
    spark = df.sparkSession
    nodes = placed(stored(leaves(df).withColumnRenamed("leaf", "h")), "source", ["doc_id", "h"])
    levels, subroots = climb(nodes)
    # The outer tree: one group, whose leaves are the sources' roots.
    outer = placed(stored(subroots.select(F.lit("").alias("all"), F.col("grp").alias("name"), "h")), "all", ["name"])
    above, root = climb(outer)
    root = stored(root)
    start = root.select("grp", F.lit(0).cast("long").alias("bucket_no"), F.array().cast(_WAY).alias("way"), "h")
    up = _bucketed(outer, descend(above, stored(start)), "name").mapInArrow(_ways, f"grp string, pos long, way {_WAY}, name string, h string")
    tops = stored(up.select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("bucket_no"), "way", "h"))
    proofs = _bucketed(nodes, descend(levels, tops), "doc_id", "tampered").mapInArrow(_proofs, "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string")
    top = root.select(F.col("h").alias("root"))
    got = proofs.join(F.broadcast(top.limit(1)))
    return got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
