"""Lattice segmentation against all paths, learnt words against plain counts."""

import math
import random

import pytest

from tidewater.operators import segmentation as sg


def paths(run, words):
    if not run:
        yield []
        return
    for k in range(1, len(run) + 1):
        if k == 1 or run[:k] in words:
            for rest in paths(run[k:], words):
                yield [run[:k], *rest]


def test_best_path_is_the_best_of_all():
    r = random.Random(4)
    for _ in range(300):
        letters = "天地人和"
        words = {"".join(r.choice(letters) for _ in range(r.randint(1, 4))): r.randint(1, 50) for _ in range(r.randint(0, 12))}
        total = sum(words.values()) + 1
        score, unknown = {w: math.log(n / total) for w, n in words.items()}, math.log(1 / total)
        run = "".join(r.choice(letters) for _ in range(r.randint(0, 9)))
        got = sg.best_path(run, score, max(map(len, words), default=1), unknown)
        worth = lambda p: sum(score.get(w, unknown) for w in p)
        assert "".join(got) == run and worth(got) == pytest.approx(max(map(worth, paths(run, words))))


def test_a_frequent_word_wins_over_the_longest_first(spark):
    """Forward maximum match would take the first two characters."""
    df = spark.createDataFrame([(1, "研究生命"), (2, None), (3, ""), (4, "BMI达到24，abc减肥!好")], "id long, t string")
    split = sg.lattice_segmenter({"研究": 50, "研究生": 2, "生命": 50, "命": 1, "减肥": 5, "BMI": 3})
    got = {r.id: r.w for r in df.select("id", split("t").alias("w")).collect()}
    assert got == {1: ["研究", "生命"], 2: [], 3: [], 4: ["BMI", "达", "到", "24", "abc", "减肥", "好"]}


def test_learnt_words_equal_plain_counts(spark):
    r = random.Random(5)
    filler = [chr(0x4E00 + 37 * i) for i in range(60)]
    texts = ["".join(r.choice(filler) for _ in range(r.randint(0, 4))) + w + "".join(r.choice(filler) for _ in range(r.randint(0, 4))) + ("，" if r.random() < 0.3 else "") for w in ["碳循环", "液断", "碳循环", "平台期"] for _ in range(40)]
    rows = [(t,) for t in texts] + [(None,), ("",), ("no han 12",), (texts[0],), (texts[0],)]
    got = {x.word: x.n for x in sg.learn(spark.createDataFrame(rows, "t string").repartition(3), "t", ["平台期", "没有"]).collect()}
    import re

    count, left, right = {}, {}, {}
    for (t,) in rows:
        for run in re.findall("[一-鿿]+", t or ""):
            for i in range(len(run)):
                for k in range(1, min(4, len(run) - i) + 1):
                    g = run[i : i + k]
                    count[g] = count.get(g, 0) + 1
                    for side, c in ((left, run[i - 1] if i else ""), (right, run[i + k : i + k + 1])):
                        side.setdefault(g, {})[c] = side.setdefault(g, {}).get(c, 0) + 1
    total = sum(n for g, n in count.items() if len(g) == 1)
    entropy = lambda d: -sum(n / sum(d.values()) * math.log(n / sum(d.values())) for n in d.values())
    want = {}
    for g, n in count.items():
        ties = [n * total / (count[g[:i]] * count[g[i:]]) for i in range(1, len(g))]
        if g == "平台期" or len(g) > 1 and n >= 5 and min(ties) >= 20 and min(entropy(left[g]), entropy(right[g])) >= 0.8:
            want[g] = n
    assert got == want and {"液断", "平台期"} <= set(got)
