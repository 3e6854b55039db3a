"""Writers: tables, per-source splits, matrices, nested JSON, terms, corpora, graphs, reports."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions import text as tx
from tidewater.operators.observe import matrix


def write_table(df: DataFrame, path: str, form: str = "parquet", by: Sequence[str] = ()) -> None:
    """Parquet or CSV with a header; ``by`` splits the output, one folder a value (for instance source_file)."""
    w = df.write.mode("overwrite")
    w = w.partitionBy(*by) if by else w
    w.option("header", True).csv(path) if form == "csv" else w.format(form).save(path)


def write_matrices(obs: DataFrame, path: str, strategies: Sequence[str] | None = None) -> None:
    """A CSV for each of counts, sentiment, arousal, popularity: a row a window, a column a strategy."""
    for value in ("n", "sentiment", "arousal", "popularity"):
        matrix(obs, value, strategies).orderBy("time_window").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/{value}")


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a row, nested as the columns are; nulls are left out."""
    df.write.mode("overwrite").json(path)


def write_terms(terms: DataFrame, path: str) -> None:
    """word <tab> freq, most frequent first."""
    terms.select("word", "freq").orderBy(F.desc("freq"), "word").write.mode("overwrite").option("sep", "\t").csv(path)


def write_corpus(df: DataFrame, column: str, path: str, least: int = 20) -> None:
    """One text a line, white space squeezed, those of ``least`` characters or more."""
    df.select(tx.squeeze(F.col(column)).alias("value")).filter(F.char_length("value") >= least).write.mode("overwrite").text(path)


def _attribute(c: Column) -> Column:
    """Text as the value of an XML attribute."""
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\t", "&#9;"), ("\r", "&#13;")):
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


HEADER = '<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2">\n<graph defaultedgetype="undirected" mode="static">\n'
HEADER += '<attributes class="node"><attribute id="0" title="strategy" type="string"/><attribute id="1" title="class" type="long"/></attributes>\n<nodes>'


def graph_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """window, place (of a line: section, two numbers), value: the lines of a GEXF file of each window.

    ``nodes``: window, node, id, strategy, rep; ``edges``: window, src, dst, weight. A node that isn't its class's representative hangs on it by one edge of weight 1, so that copies
    of a post don't bring an edge for each two of them; ``class`` tells who belongs together.
    """
    at = lambda section, a=F.lit(0), b=F.lit(0): [F.lit(section).alias("section"), a.cast("long").alias("a"), b.cast("long").alias("b")]
    own = F.format_string('<node id="%d" label="%s"><attvalues><attvalue for="0" value="%s"/><attvalue for="1" value="%d"/></attvalues></node>', "node", _attribute(F.coalesce(F.col("id").cast("string"), F.lit(""))), _attribute(F.coalesce("strategy", F.lit("Unknown"))), "rep")
    copies = nodes.filter("node <> rep").select("window", F.col("rep").alias("src"), F.col("node").alias("dst"), F.lit(1.0).alias("weight"))
    link = F.format_string('<edge id="%d-%d" source="%d" target="%d" weight="%s"/>', "src", "dst", "src", "dst", F.col("weight").cast("string"))
    windows = nodes.select("window").distinct()
    out = windows.select("window", *at(0), F.lit(HEADER).alias("value")).unionByName(nodes.select("window", *at(1, F.col("node")), own.alias("value")))
    out = out.unionByName(windows.select("window", *at(2), F.lit("</nodes>\n<edges>").alias("value")))
    out = out.unionByName(edges.select("window", "src", "dst", "weight").unionByName(copies).select("window", *at(3, F.col("src"), F.col("dst")), link.alias("value")))
    return out.unionByName(windows.select("window", *at(4), F.lit("</edges>\n</graph>\n</gexf>").alias("value")))


def write_graphs(nodes: DataFrame, edges: DataFrame, path: str) -> list[str]:
    """A GEXF file for each window under ``path``, of any size; their names. Columns as in ``graph_lines``.

    Lines are range partitioned by window and place, so fragments are written by many tasks; the file system's streams put them together in order, and no row, task or
    the driver holds a graph.
    """
    spark, parts = nodes.sparkSession, f"{path.rstrip('/')}/parts"
    order = ["window", "section", "a", "b"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = graph_lines(nodes, edges).repartitionByRange(n, *order).sortWithinPartitions(*order)
    lines.select("window", "value").write.mode("overwrite").partitionBy("window").text(parts)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs, copy = fs_path(parts).getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes
    out = []
    for folder in sorted((x.getPath() for x in fs.listStatus(fs_path(parts)) if x.isDirectory()), key=lambda x: x.getName()):
        name = folder.getName().removeprefix("window=")
        whole = fs.create(fs_path(path, f"{name}.gexf"), True)
        # Part files are numbered by partition, so in order of place.
        for part in sorted((x.getPath() for x in fs.listStatus(folder) if x.getPath().getName().startswith("part-")), key=lambda x: x.getName()):
            piece = fs.open(part)
            copy(piece, whole, 1 << 16, False)
            piece.close()
        whole.close()
        out.append(f"{name}.gexf")
    fs.delete(fs_path(parts), True)
    return out


def findings(tables: dict[str, DataFrame]) -> list[str]:
    """What the analysis says in words, from the tables of the last stage; what isn't there is left out."""
    out = []
    if "scalars" in tables and (r := tables["scalars"].first()):
        out.append(f"{r['n_rows']} posts in {r['n_windows']} windows follow {r['n_strategies']} strategies.")
    if "snowball" in tables:
        rows = tables["snowball"].select(F.col("meta_strategy").alias("s")).distinct().orderBy("s").collect()  # strategies
        out.append("Strategies that snowball (early volume draws more): " + (", ".join(str(r["s"]) for r in rows) or "none") + ".")
    if "homogenisation" in tables and (r := tables["homogenisation"].first()):
        out.append("Networks grow denser and more clustered from window to window: posts come to say the same." if r["is_homogenising"] else "Networks don't grow both denser and more clustered: no sign that posts come to say the same.")
    if "gap" in tables and (r := tables["gap"].first()):
        out.append("Arousal apart: " + ", ".join(f"{k} {v:.4f}" if isinstance(v, float) else f"{k} {v}" for k, v in r.asDict().items()) + ".")
    if "diversity" in tables and (r := tables["diversity"].first()) and r["band"]:
        out.append(f"The diversity of strategies in equilibrium is {r['band']} ({r['avg_diversity']:.4f}).")
    return out


def report(title: str, sections: dict[str, DataFrame], most: int = 50, now: datetime | None = None, said: Sequence[str] = ()) -> str:
    """Markdown: what was found in words, then a table for each section: its first ``most`` rows in order of its columns, and how many there are."""
    out = [f"# {title}", "", f"Made {(now or datetime.now()):%Y-%m-%d %H:%M:%S}", ""]
    if said:
        out += ["## findings", "", *[f"- {x}" for x in said], ""]
    for name, df in sections.items():
        order = [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
        rows = (df.orderBy(*order) if order else df).limit(most).collect()
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows]
        total = df.count() if len(rows) == most else len(rows)
        out += ["", f"{len(rows)} of {total} rows", ""]
    return "\n".join(out)
