import pytest
from pyspark.sql import functions as F

from tidewater.functions import lexicon as lx
from tidewater.functions import math as mx
from tidewater.functions import text as tx


def one(spark, values, expr, kind="t string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {kind}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_remove_words_longest_first(spark):
    got = one(spark, [None, "", "责任编辑张三  \t来", "the end  x", "编辑"], tx.remove_words(F.col("t")))
    assert got == ["", "", "张三 来", "x", ""]


def test_clean_text(spark):
    got = one(spark, [None, " 看 https://a.b/c?d 好", "@某人 你好，世界", "#话题# ok", "a[笑]b<br>c", "It's \"fine\"; 1,2。"], tx.clean_text(F.col("t")))
    assert got == ["", "看  好", "你好世界", "ok", "abc", 'Its "fine"; 1,2。']


@pytest.mark.parametrize("n,want", [(19, 1.1), (20, 1.05), (49, 1.05), (50, 1.0), (199, 1.0), (200, 0.9), (499, 0.9), (500, 0.7)])
def test_length_factor(spark, n, want):
    assert one(spark, ["x" * n], tx.length_factor(F.col("t"))) == [want]


def test_length_factor_null(spark):
    assert one(spark, [None], tx.length_factor(F.col("t"))) == [0.7]


def test_quality_reason_every_branch(spark):
    texts = [None, "  ", "x" * 14, "abcdefgh ijklmno", "abc" + "d" * 6 + " efghijkl", "abc" + "d" * 5 + " efghijkl", " ".join(["http://a.b"] * 3) + " text", " ".join(["http://a.b"] * 4) + " text", "abcdefghi" + "!?" * 3, "abcdef" + "!?" * 5]
    want = ["empty", "empty", "short", "ok", "repeated", "ok", "ok", "links", "ok", "special"]
    assert one(spark, texts, tx.quality_reason(F.col("t"))) == want


def test_special_ratio_boundary(spark):
    assert one(spark, ["abcdefghijkl" + "!?" * 4, "abcdefghijk" + "!?" * 4], tx.quality_reason(F.col("t"))) == ["ok", "special"]


def test_keyword_in_two_categories_has_last_weight_and_first_place():
    lex = lx.Lexicon.of({"核心词": ["a", "b"], "产品词": ["a"], "别的": ["c"]})
    assert lex.keywords == ("a", "b", "c") and lex.weights == (3.0, 1.5, 1.0)


def test_mixed_case_keywords(spark):
    lex = lx.Lexicon.of({"核心词": ["BMI"]})
    ours = one(spark, ["my bmi is"], F.size(tx.keyword_matches(F.col("t"), lex)))
    literal = one(spark, ["my BMI is"], F.size(tx.keyword_matches(F.col("t"), lex, literal_case=True)))
    assert (ours, literal) == ([1], [0])


def test_keyword_score(spark):
    lex = lx.Lexicon.of({"核心词": ["cat"], "产品词": ["dog"]})
    got = one(spark, [None, " ", "a cat, a cat", "cat and dog", "cat bad"], tx.keyword_score(F.col("t"), lex, ["bad"], []))
    assert got == [0.0, 0.0, pytest.approx(1.65), pytest.approx(4.95), 0.0]


def test_sentiment_and_arousal(spark):
    got = one(spark, ["成功 开心 失败", "", None], F.struct(tx.sentiment(F.col("t")).alias("s"), tx.arousal(F.col("t")).alias("a")))
    assert [(round(r.s, 4), r.a) for r in got] == [(0.3333, 1.0), (0.0, 0.0), (0.0, 0.0)]


def test_names_and_costs(spark):
    assert one(spark, ["科学运动", "走捷径", "放弃", "健身", "x"], tx.strategy_cost(F.col("t"))) == [0.5, 0.1, 0.2, 0.4, 0.3]
    assert one(spark, ["运动 饮食", "hiit 力量训练", "nothing"], tx.strategy_name(F.col("t"))) == ["运动主导型", "运动主导型", "综合策略型"]


def test_profile_rules(spark):
    df = spark.createDataFrame([((0.7, 0.0, 0.0, 0.0, 0.0, 0.0),), ((0.5, 0.5, 0.0, 0.0, 0.0, 0.0),), ((0.1, 0.1, 0.1, 0.1, 0.4, 0.4),), ((0.0, 0.0, 0.6, 0.0, 0.0, 0.0),)],
                               "p struct<exercise:double,diet:double,medical:double,special_group:double,tech_quant:double,innovation:double>")
    assert [r[0] for r in df.select(tx.strategy_name(F.lit(""), F.col("p"))).collect()] == ["运动主导型", "运动饮食结合型", "科技驱动创新型", "医学干预型"]


def test_periods(spark):
    got = one(spark, ["2024-03-03 12:00:00", "2024-03-04", "nonsense", None], F.struct(*[mx.period(mx.to_time(F.col("t")), u).alias(u) for u in "MWD"]))
    assert tuple(got[0]) == ("2024-03", "2024-02-26/2024-03-03", "2024-03-03")
    assert got[1].W == "2024-03-04/2024-03-10"
    assert tuple(got[2]) == tuple(got[3]) == (None, None, None)
    with pytest.raises(ValueError):
        mx.period(F.lit(None), "Y")


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 4.0], [0.0, 0.0], [-1.0, 3.0])], "a array<double>, b array<double>, z array<double>, n array<double>")
    r = df.select(mx.cosine(F.col("a"), F.col("b")), mx.cosine(F.col("a"), F.col("z")), mx.renormalised(F.col("n")), mx.renormalised(F.col("z"))).first()
    assert r[0] == pytest.approx(1.0) and r[1] is None and r[2] == [0.0, 1.0] and r[3] == [0.0, 0.0]
