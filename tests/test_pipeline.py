import os

import pytest
from pyspark.sql import functions as F

from tidewater.plans.stages import Pipeline, Settings
from tidewater.sources import readers, writers
from tidewater.streaming.windows import stream_observations, write_stream

WORDS = ["成功 减肥 运动 坚持 数据", "失败 反弹 节食 焦虑 医生", "饮食 均衡 研究 科学 营养", "打卡 一起 健身 开心 分享"]


@pytest.fixture(scope="module")
def posts(spark):
    rows = [(i, f"{WORDS[i % 4]} 第{i}篇 words w{i % 4} x{i % 4}", f"2024-0{1 + i % 3}-10 00:00:00", f"u{i}") for i in range(240)]
    return spark.createDataFrame(rows, "post_id long, text string, time string, user_id string")


def test_all_stages(spark, posts, tmp_path):
    p = Pipeline(spark, str(tmp_path), Settings(min_docs=10, topics=6, min_topic=5, similarity=0.9, method="centres"))
    seconds = p.run(posts)
    assert list(seconds) == [f"stage{k}" for k in range(1, 6)]
    obs = p.read("observations")
    assert obs.agg(F.sum("n")).first()[0] == 240
    assert p.read("network").filter("window = 'all'").count() == 1
    text = "\n".join(r[0] for r in spark.read.text(f"{tmp_path}/report").collect())
    assert "Opinion dynamics" in text and "240 posts in 3 windows" in text
    assert list(p.run(stages=[4, 5], skip=[5])) [-1] in ("stage5", "stage4")
    with pytest.raises(ValueError):
        p.run(stages=[7])


def test_screening_and_stages_of_han_posts(spark, tmp_path):
    """Stage 0 on raw posts: relevance over several columns, quality, ids and contents once, files by source; repeated ids in stage 2."""
    from tidewater.functions import lexicon as lx

    lex = lx.Lexicon.of({"效果词": ["瘦了", "掉秤"], "核心词": ["减肥", "体重管理"], "相关词": ["腰围"], "反减肥词": ["大码", "躺平"]})
    body = "坚持减肥三个月终于掉秤瘦了腰围也小了很多真的很开心数据记录每天打卡"
    raw = [(str(i % 200), f"{body}{i % 150}", "2024-01-10" if i % 2 else "2024-02-10", f"u{i}", i, "cleaned_a.csv" if i % 3 else "cleaned_b.csv") for i in range(240)]
    raw += [("n1", "今天天气不错适合出门散步吃饭聊天", "2024-01-10", "u", 1, "cleaned_a.csv"), ("n2", body + "招聘", "2024-01-10", "u", 1, "cleaned_a.csv"), ("n3", "大码躺平就好不用在意别人的眼光啊", "2024-01-10", "v", 1, "cleaned_b.csv"), ("n4", "减肥掉秤瘦了", "2024-01-10", "v", 1, "cleaned_b.csv")]
    raw += [(None, body + "无号", "2024-01-10", "w", 1, "cleaned_b.csv")]
    posts = spark.createDataFrame(raw, "`微博ID` string, `全文内容` string, time string, user_id string, `点赞数` long, source_file string").withColumn("post_id", F.lit(7))
    p = Pipeline(spark, str(tmp_path), Settings(lexicon=lex, min_docs=10, topics=3, min_topic=5, similarity=0.9, words=["减肥", "体重管理"]))
    p.run(posts, stages=[0, 1, 2, 3, 4, 5])
    related = {r["微博ID"]: r["点赞数"] for r in p.read("related").collect()}
    assert "n1" not in related and "n2" not in related and "n4" not in related and "n3" in related and "" in related  # cleaning makes null ids empty
    assert len(related) == 152 and p.read("related").select("全文内容").distinct().count() == 152
    assert {r["微博ID"] for r in p.read("unrelated").collect()} == {"n1", "n2"}
    counts = {r.keyword: r.n for r in p.read("keywords").collect()}
    assert counts["掉秤"] == 243 and counts["大码"] == 1
    assert p.read("strategy_posts").count() == p.read("posts").count() == 152
    assert {r.word for r in p.read("terms").collect()} >= {"减肥", "打卡", "数据"}
    assert set(os.listdir(tmp_path / "files")) >= {"related", "unrelated", "terms", "corpus", "matrices", "strategies", "mapping", "graphs"}
    assert p.read("homogenisation").columns == ["density_slope", "clustering_slope", "is_homogenising"]
    with pytest.raises(ValueError):
        Pipeline(spark, str(tmp_path)).run(posts, stages=[0])
    with pytest.raises(ValueError):
        Pipeline(spark, str(tmp_path), Settings(lexicon=lex)).run(stages=[0, 1])


def test_csv_in_and_out(spark, tmp_path):
    (tmp_path / "cleaned_a.csv").write_bytes("﻿text,n\n\"a \"\"q\"\"\nb\",1\n".encode())
    (tmp_path / "cleaned_b.csv").write_text("text,n\nc,2\n")
    got = readers.read_posts(spark, f"{tmp_path}/cleaned_*.csv").orderBy("n").collect()
    assert [(r.text, r.n, r.source_file) for r in got] == [('a "q"\nb', "1", "cleaned_a.csv"), ("c", "2", "cleaned_b.csv")]
    with pytest.raises(FileNotFoundError):
        readers.read_posts(spark, f"{tmp_path}/none_*.csv")
    df = spark.createDataFrame([("a", "x", 1, 0.5, 0.1, 1.0), ("b", "y", 2, 0.5, 0.1, 1.0)], "time_window string, meta_strategy string, n long, sentiment double, arousal double, popularity double")
    writers.write_matrices(df, f"{tmp_path}/m")
    back = {(r.time_window, r.meta_strategy): r.n for r in readers.read_matrix(spark, f"{tmp_path}/m/n").collect()}
    assert back == {("a", "x"): 1.0, ("a", "y"): 0.0, ("b", "x"): 0.0, ("b", "y"): 2.0}
    writers.write_corpus(spark.createDataFrame([("x" * 19,), ("y  " + "z" * 20,)], "t string"), "t", f"{tmp_path}/c")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/c").collect()] == ["y " + "z" * 20]
    writers.write_json(df, f"{tmp_path}/j")
    assert readers.read_document(spark, f"{tmp_path}/j").count() == 2
    writers.write_terms(spark.createDataFrame([("a", 1), ("b", 2)], "word string, freq long"), f"{tmp_path}/t")
    writers.write_table(df, f"{tmp_path}/p", by=["meta_strategy"])
    assert sorted(x for x in os.listdir(tmp_path / "p") if "=" in x) == ["meta_strategy=x", "meta_strategy=y"]


def test_graph_files_of_any_size(spark, tmp_path):
    """A window of 50,000 nodes, and one whose name and values need care, are files that parse."""
    from xml.etree import ElementTree

    nodes = spark.range(50_000).select(F.lit("2024-01").alias("window"), F.col("id").alias("node"), F.concat(F.lit("p"), "id").alias("id"), F.lit("s").alias("strategy"), (F.col("id") - F.col("id") % 2).alias("rep"))
    odd = spark.createDataFrame([("2024-01-01/2024-01-07", 1, 'a"<b>&', 'x"\n', 1), ("2024-01-01/2024-01-07", 2, None, None, 2)], "window string, node long, id string, strategy string, rep long")
    edges = nodes.filter("node % 2 = 0 and node > 0").select("window", F.lit(0).cast("long").alias("src"), F.col("node").alias("dst"), F.lit(0.5).alias("weight"))
    edges = edges.unionByName(spark.createDataFrame([("2024-01-01/2024-01-07", 1, 2, 0.25)], "window string, src long, dst long, weight double"))
    names = writers.write_graphs(nodes.unionByName(odd), edges, f"{tmp_path}/g")
    assert len(names) == 2 and {x for x in os.listdir(tmp_path / "g") if x.endswith(".gexf")} == set(names)
    seen = {}
    for name in names:
        root = ElementTree.parse(tmp_path / "g" / name).getroot()
        space = "{http://www.gexf.net/1.2draft}"
        seen[name] = (list(root.iter(f"{space}node")), list(root.iter(f"{space}edge")))
    big = seen["2024-01.gexf"]
    assert len(big[0]) == 50_000 and [n.get("id") for n in big[0]] == [str(i) for i in range(50_000)] and big[0][7].get("label") == "p7"
    assert len(big[1]) == 24_999 + 25_000 and len({e.get("id") for e in big[1]}) == len(big[1])
    small = next(v for k, v in seen.items() if k != "2024-01.gexf")
    assert small[0][0].get("label") == 'a"<b>&' and small[0][0][0][0].get("value") == 'x"\n' and small[0][1][0][0].get("value") == "Unknown"
    assert [(e.get("source"), e.get("target"), e.get("weight")) for e in small[1]] == [("1", "2", "0.25")]


def test_report_rows_are_in_order(spark):
    df = spark.createDataFrame([(i * 37 % 100, {"a": i}) for i in range(100)], "n long, m map<string,long>").repartition(5)
    text = writers.report("T", {"x": df}, most=3, said=["one thing"])
    assert "- one thing" in text and "3 of 100 rows" in text
    assert [line.split("|")[1].strip() for line in text.splitlines() if line.startswith("| ") and "n" not in line.split("|")[1]] == ["0", "1", "2"]


def test_bad_files_and_rows_dont_stop_a_tolerant_read(spark, tmp_path):
    import gzip

    (tmp_path / "a.csv").write_text("text,n\ngood,1\n")
    whole = gzip.compress(b"text,n\n" + b"lost,2\n" * 50_000)
    (tmp_path / "b.csv.gz").write_bytes(whole[: len(whole) // 2])
    got = readers.read_posts(spark, f"{tmp_path}/*", schema=readers.StructType.fromDDL("text string, n int"))
    assert got.filter("text = 'good'").select("n", "source_file").first() == (1, "a.csv")
    with pytest.raises(Exception):
        readers.read_posts(spark, f"{tmp_path}/*", schema=readers.StructType.fromDDL("text string, n int"), tolerant=False).collect()


def test_stream(spark, tmp_path):
    rows = [(f"2024-01-0{d} 0{h}:00:00", "a", float(h)) for d in (1, 2, 5) for h in (1, 2)]
    spark.createDataFrame(rows, "ts string, s string, v double").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/in")
    src = spark.readStream.schema("ts timestamp, s string, v double").parquet(f"{tmp_path}/in")
    q = write_stream(stream_observations(src, "ts", "s", "v"), f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination(60)
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("window_start").collect()
    assert [(r.window_start.day, r.n, r.sentiment) for r in got][:2] == [(1, 2, 1.5), (2, 2, 1.5)]
