import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.functions import lexicon as lx
from tidewater.operators import analysis, game, network, observe, screening, segmentation, strategy, temporal, terms

LEX = lx.Lexicon.of({"产品词": ["dog"], "反减肥词": ["slow", "calm"]})


def related(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string")
    got = screening.with_relevance(df, ["a", "b"], LEX, min_score=3.0, excluded=["bad"], removed=[])
    return [r.is_related for r in got.orderBy("i").collect()]


def test_relevance(spark):
    rows = [("dog", None), ("cat", None), ("dog", "so bad"), ("slow and calm", None), ("slow", "calm"), ("slow", None), (None, None)]
    assert related(spark, rows) == [True, False, False, True, True, False, False]


def test_split_is_a_partition(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "i int, is_related boolean")
    yes, no = screening.split_related(df)
    assert [r.i for r in yes.collect()] == [1] and sorted(r.i for r in no.collect()) == [2, 3]


def test_dedup(spark):
    df = spark.createDataFrame([(1, "A  b", 3.0), (2, "a b", 9.0), (3, " a b ", 9.0), (4, "c", None), (5, None, 1.0)], "i int, t string, v double")
    got = screening.dedup_content(df, "t", "v", "i")
    assert sorted(r.i for r in got.collect()) == [2, 4, 5]
    again = screening.dedup_content(got, "t", "v", "i")
    assert again.count() == got.count()


def test_dedup_id_keeps_rows_without_id(spark):
    df = spark.createDataFrame([("x", 1), ("x", 2), (None, 3), (None, 4)], "k string, i int")
    assert screening.dedup_id(df, "k", [F.asc("i")]).count() == 3
    assert screening.dedup_id(df, "k", [F.asc("i")], collapse_null_ids=True).count() == 2


def test_bots(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] * 4 + [(None,)] * 9, "u string")
    got = temporal.drop_bots(df, "u", 3)
    assert got.filter("u = 'a'").count() == 3 and got.filter("u = 'b'").count() == 0 and got.filter("u is null").count() == 9
    assert temporal.drop_bots(df, "nobody", 3).count() == df.count()


def test_windows(spark):
    df = spark.createDataFrame([("2024-01-05",), ("2024-01-06",), ("2024-02-01",), ("what",), (None,)], "date string")
    assert [r.time_window for r in temporal.with_windows(df, unit="M", min_docs=2).collect()] == ["2024-01"] * 2
    assert temporal.with_windows(df.toDF("other"), min_docs=2).select("time_window").distinct().first()[0] == "0"
    with pytest.raises(ValueError):
        temporal.with_windows(df, unit="Q")


def obs(spark, rows):
    return spark.createDataFrame(rows, "time_window string, meta_strategy string, n long, sentiment double")


def test_growth_with_gaps(spark):
    got = {(r.time_window, r.meta_strategy): r.growth for r in analysis.growth(obs(spark, [("1", "a", 2, 0.0), ("2", "a", 3, 0.0), ("2", "b", 1, 0.0), ("3", "a", 3, 0.0)])).collect()}
    assert got[("2", "a")] == pytest.approx(0.5) and got[("2", "b")] == math.inf and got[("3", "b")] == pytest.approx(-1.0) and got[("1", "a")] is None


def euler(x, fixed, steps=1000):
    x = x / x.sum()
    for i in range(steps):
        u = 0.45 * x + fixed
        y = np.maximum(x + 0.01 * x * (u - x @ u), 0)
        y /= y.sum()
        if np.linalg.norm(y - x) < 1e-4:
            return x, i
        x = y
    return x, steps


def test_simulation_matches_numpy(spark):
    rows = [("w", s, n, f) for s, n, f in (("a", 5, 1.0), ("b", 3, -0.5), ("c", 2, 0.2), ("d", 0, 1.0))] + [("u", "a", 2, 0.0), ("u", "b", 2, 0.0)]
    sim = game.simulate(obs(spark, rows))
    got = {(r.time_window, r.meta_strategy): r for r in sim.collect()}
    x, steps = euler(np.array([5.0, 3.0, 2.0]), 0.45 * np.array([1.0, -0.5, 0.2]) - 0.3)
    assert [got[("w", s)].final for s in "abc"] == pytest.approx(list(x), abs=1e-12) and got[("w", "a")].steps == steps
    assert ("w", "d") not in got and got[("u", "a")].final == 0.5 and got[("u", "a")].steps == 0
    assert sum(r.final for r in got.values() if r.time_window == "w") == pytest.approx(1.0)
    last = game.trajectory(obs(spark, rows)).filter("time_window = 'w' and meta_strategy = 'a'").orderBy(F.desc("iteration")).first()
    assert last.iteration == steps and last.share == pytest.approx(x[0])


def test_equilibria_ties_and_types(spark):
    sim = spark.createDataFrame([("t", "b", 0.5), ("t", "a", 0.5), ("d", "a", 0.9), ("d", "b", 0.1), ("m", "a", 0.4), ("m", "b", 0.3), ("m", "c", 0.3)], "time_window string, meta_strategy string, final double")
    got = {r.time_window: r for r in game.equilibria(sim).collect()}
    assert got["t"].dominant_strategy == "a" and got["t"].equilibrium_type == "部分主导"
    assert got["d"].equilibrium_type == "主导均衡" and got["m"].equilibrium_type == "混合均衡"


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame([("w", i, s) for i, s in enumerate(["x", "x", "y", "MS_Outlier", None])] + [("e", 1, "x"), ("e", 2, "x"), ("s", 9, "y")], "window string, id long, strategy string")
    edges = spark.createDataFrame([("w", 0, 1, 1.0), ("w", 0, 2, 1.0), ("w", 1, 2, 1.0), ("w", 2, 3, 1.0)], "window string, src long, dst long, weight double")
    return nodes, edges


def test_graph_metrics(graph):
    got = {r.window: r for r in network.network_metrics(*graph).collect()}
    w = got["w"]
    assert (w.n_nodes, w.n_edges, w.density) == (5, 4, pytest.approx(0.4))
    assert w.avg_clustering == pytest.approx((1 + 1 + 1 / 3) / 5)
    assert (w.n_components, w.largest_component_size) == (2, 4)
    assert w.strategy_distribution == {"x": 2, "y": 1, "MS_Outlier": 1, "Unknown": 1}
    assert w.echo_chamber == {"x": pytest.approx(1 / 3), "y": 0.0}
    assert (got["e"].density, got["e"].avg_clustering, got["e"].n_components) == (0.0, 0.0, 2)
    assert (got["s"].density, got["s"].n_components) == (0.0, 1)


def test_edges_in_blocks_match_brute_force(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 4))
    nodes = spark.createDataFrame([("w", i, v[i].tolist()) for i in range(60)] + [("w", 60, [0.0] * 4), ("w", 61, None)], "window string, id long, embedding array<double>")
    got = {(r.src, r.dst) for r in network.similarity_edges(nodes, 0.8, block=16).collect()}
    u = v / np.linalg.norm(v, axis=1)[:, None]
    assert got == {(i, j) for i in range(60) for j in range(i + 1, 60) if u[i] @ u[j] >= 0.8}


def test_clustering_helpers():
    d = np.array([[0, 1, 9, 9], [1, 0, 9, 9], [9, 9, 0, 2], [9, 9, 2, 0]], float)
    assert strategy.average_linkage(d, 2).tolist() == [0, 0, 1, 1]
    assert strategy.best_k(d, 2, 3) == 2
    for n in range(0, 6):
        x = np.abs(np.subtract.outer(np.arange(n), np.arange(n))).astype(float)
        label = strategy.cluster_topics(x)
        assert len(label) == n and sorted(set(label.tolist())) == list(range(len(set(label.tolist()))))


def test_few_topics_are_outliers(spark):
    pairs = spark.createDataFrame([(3, 3, 0.0)], "topic_i int, topic_j int, distance double")
    assert [tuple(r) for r in strategy.meta_strategies(pairs).collect()] == [(3, observe.OUTLIER)]


def test_segmenter(spark):
    seg = segmentation.lattice_segmenter({"减肥": 3, "体重管理": 1})
    df = spark.createDataFrame([("体重管理abc减肥好 x1",), (None,)], "t string")
    assert [r[0] for r in df.select(seg("t")).collect()] == [["体重管理", "abc", "减肥", "好", "x1"], []]


def test_histogram_and_bands(spark):
    df = spark.range(0, 31).select(F.col("id").cast("double").alias("v"))
    got = {r.bin: r.n for r in analysis.histogram(df, "v", 30).collect()}
    assert got[30] == 2 and sum(got.values()) == 31
    assert analysis.histogram(spark.createDataFrame([(1.0,), (1.0,)], "v double"), "v").collect()[0].n == 2


def test_topics_have_probabilities_and_outliers(spark):
    from tidewater.operators import strategy

    rows = [(i, [float(i % 2) * 10 + 0.01 * (i % 7), 1.0]) for i in range(100)] + [(200, [5.0, 40.0]), (201, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {r.id: r for r in strategy.fit_topics(df, "v", 2, 10).collect()}
    assert len(got) == 102 and got[201].topic == -1 and got[201].topic_probability == 0
    assert got[200].topic == -1 and got[200].topic_probability == 0
    assert {got[0].topic, got[1].topic} == {0, 1} and 0.9 < got[0].topic_probability <= 1
    kept = {r.id: r for r in strategy.fit_topics(df, "v", 2, 10, spread=None).collect()}
    assert kept[200].topic in (0, 1) and 0.4 < kept[200].topic_probability < 1


def test_most_alike_on_the_row(spark):
    from tidewater.operators import strategy

    centres = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", [0.0, 1.0])], "s string, centre array<double>")
    rows = spark.createDataFrame([(1, [3.0, 0.1]), (1, [0.1, 3.0]), (1, [0.0, 0.0]), (None, [1.0, 0.0])], "id long, v array<double>")
    got = [(r.id, r.s) for r in strategy.reassign(rows, "id", "v", centres, "s").collect()]
    assert sorted(got, key=str) == sorted([(1, "a"), (1, "c"), (1, "a"), (None, "a")], key=str)
    assert strategy.reassign(rows, "id", "v", centres.limit(0), "s").filter("s is null").count() == 4


def test_describe_by_sketch(spark):
    from tidewater.operators import analysis

    df = spark.range(1001).select(F.col("id").cast("double").alias("x"))
    exact, about = analysis.describe(df, ["x"]).first(), analysis.describe(df, ["x"], 10_000).first()
    assert (exact.p25, exact.p50, exact.p75) == (250, 500, 750) and abs(about.p50 - 500) <= 1


@pytest.mark.parametrize("room", [None, 40, 8])
def test_ngrams_by_summaries(spark, monkeypatch, room):
    """Counts are exact whatever the summaries lose: a small room grows, and at last all grams are counted."""
    import random

    r = random.Random(3)
    words = [f"w{int(r.paretovariate(0.8)) % 400}" for _ in range(6000)]
    rows = [(" ".join(words[i : i + r.randint(0, 12)]),) for i in range(0, 5900, 9)] + [(None,), ("",), ("solo " * 50,)]
    df = spark.createDataFrame(rows, "t string").repartition(4)
    for n, size in ((1, 5), (2, 20), (3, 1000)):
        got = [tuple(x) for x in terms.ngram_vocabulary(df, "t", size, 3, n, (), room).collect()]
        freq, found = {}, {}
        for i, (t,) in enumerate(rows):
            w = (t or "").split()
            for k in range(1, n + 1):
                for j in range(len(w) - k + 1):
                    g = " ".join(w[j : j + k])
                    freq[g] = freq.get(g, 0) + 1
                    found.setdefault(g, set()).add(i)
        want = sorted(((g, c, len(found[g])) for g, c in freq.items() if len(found[g]) >= 3), key=lambda x: (-x[1], x[0]))[:size]
        assert got == want


def test_grams_of_one_hash_stay_apart(spark, monkeypatch):
    lists = spark.createDataFrame([(["a", "b", "a"],), (["b"],), (["c"],)], "w array<string>").coalesce(1).toArrow().column("w").combine_chunks()
    monkeypatch.setattr(terms, "hash_array", lambda x, categorize: terms.np.array([7 if w in "ab" else 9 for w in x], terms.np.uint64))
    batch = terms.pa.RecordBatch.from_arrays([lists], ["w"])
    got = next(terms._exact(1, terms.np.array([7]))(iter([batch]))).to_pylist()
    assert sorted((x["term"], x["freq"], x["df"]) for x in got) == [("a", 2, 1), ("b", 2, 2)]


def test_quartiles_by_narrowing(spark, monkeypatch):
    """Equal to Spark's own percentiles, with ties, few and one value, huge spreads, infinite values and NaN."""
    import random

    monkeypatch.setattr(analysis, "BINS", 16)
    monkeypatch.setattr(analysis, "FEW", 8)
    r = random.Random(2)
    inf = float("inf")
    cols = {
        "a": [r.gauss(0, 1) for _ in range(700)], "b": [float(r.randint(0, 3)) for _ in range(700)], "c": [10.0 ** r.randint(-300, 300) for _ in range(700)],
        "d": [5.0], "e": [None] * 3, "f": [r.choice([inf, -inf, 1.0, 2.0, 1e308, -1e308]) for _ in range(700)], "g": [float("nan")] * 300 + [r.random() for _ in range(400)],
    }
    rows = [tuple(v[i] if i < len(v) else None for v in cols.values()) for i in range(700)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(3)
    got = {x.metric: x for x in analysis.describe(df, list(cols)).collect()}
    assert got.keys() == cols.keys() and got["e"].p50 is None and got["d"].p25 == got["d"].p75 == 5.0
    plain = lambda v, q: (lambda s, p: s[int(p)] if p == int(p) or s[int(p)] == s[int(p) + 1] else s[int(p)] * (1 - p + int(p)) + s[int(p) + 1] * (p - int(p)))(sorted(v, key=lambda x: (x != x, x)), q * (len(v) - 1))
    for c in "abcfg":
        for q, p in ((0.25, got[c].p25), (0.5, got[c].p50), (0.75, got[c].p75)):
            want = plain(cols[c], q)
            assert p == pytest.approx(want, rel=1e-12) or p != p and want != want, (c, q, p, want)
