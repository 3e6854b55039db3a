"""Segmentation of Han text: a lattice of words, and words learnt from the texts.

All words of the dictionary inside a run of Han form a lattice, together with its single characters; the path of the largest sum of ln(frequency / total) is
found by dynamic programming from the end; of equal paths the one with the longest first word. Latin letters and digits stand in runs, everything else separates.

Unknown words are runs of two to ``longest`` characters that occur often, cohere and stand in varied company. Cohesion is the least of n(run) N / (n(left part) n(right part)) over all
cuts; variety is the lesser of the entropies of the characters to the left and to the right (the ends of a run of Han are a neighbour each). Spark counts all of that over all texts; only
the dictionary, at most ``most`` words, goes to tasks.

Null and empty texts have no words.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.plans.storage import stored

HAN = "[\\u4e00-\\u9fff]+"


def _is_han(c: str) -> bool:
    return "一" <= c <= "鿿"


def grams(df: DataFrame, column: str, longest: int) -> DataFrame:
    """gram, before, after, n: substrings of runs of Han of 1 to ``longest`` characters by their neighbours ('' at an end of a run). Counted inside tasks first."""
    runs = df.select(F.explode(F.regexp_extract_all(F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit(HAN), F.lit(0))).alias("run"))
    at = F.explode(F.sequence(F.lit(1), F.char_length("run"))).alias("i")
    placed = runs.groupBy("run").agg(F.count("*").alias("m")).select("run", "m", at)
    size = F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.char_length("run") - F.col("i") + 1))).alias("k")
    cut = placed.select("run", "m", "i", size)
    one = lambda from_, n: F.substring("run", from_, n)
    before = F.when(F.col("i") > 1, one(F.col("i") - 1, F.lit(1))).otherwise("")
    cut = cut.select(one(F.col("i"), F.col("k")).alias("gram"), before.alias("before"), one(F.col("i") + F.col("k"), F.lit(1)).alias("after"), "m")
    return cut.groupBy("gram", "before", "after").agg(F.sum("m").alias("n"))


def learn(df: DataFrame, column: str, known: Iterable[str] = (), longest: int = 4, least: int = 5, cohesion: float = 20.0, variety: float = 0.8, most: int = 1 << 16) -> DataFrame:
    """word, n of the words found in the texts: those of ``known`` (Han only, of any frequency but 0) and unknown ones, the ``most`` most frequent."""
    known = sorted({w for w in known if w and all(map(_is_han, w))})
    longest = max([longest, *map(len, known)])
    beside = stored(grams(df, column, longest))
    counts = stored(beside.groupBy("gram").agg(F.sum("n").alias("n")))
    total = counts.filter(F.char_length("gram") == 1).agg(F.sum("n").alias("total"))  # one row
    frequent = counts.filter((F.char_length("gram") > 1) & (F.col("n") >= least))
    cuts = frequent.select("gram", "n", F.explode(F.sequence(F.lit(1), F.char_length("gram") - 1)).alias("i"))
    parts = cuts.select("gram", "n", F.substring("gram", F.lit(1), F.col("i")).alias("left"), F.substring("gram", F.col("i") + 1, F.char_length("gram")).alias("right"))
    met = parts.join(counts.toDF("left", "n_left"), "left").join(counts.toDF("right", "n_right"), "right").crossJoin(F.broadcast(total))
    tied = met.groupBy("gram", "n").agg(F.min(F.col("n") * F.col("total").cast("double") / (F.col("n_left").cast("double") * F.col("n_right"))).alias("cohesion"))

    def entropy(side: str) -> DataFrame:
        one = beside.join(frequent.select("gram"), "gram", "left_semi").groupBy("gram", side).agg(F.sum("n").alias("m"))
        sums = one.groupBy("gram").agg(F.sum("m").alias("all"), F.sum(F.col("m") * F.ln("m")).alias("s"))
        return sums.select("gram", (F.ln("all") - F.col("s") / F.col("all")).alias(f"h_{side}"))

    fresh = tied.filter(F.col("cohesion") >= cohesion).join(entropy("before"), "gram").join(entropy("after"), "gram").filter(F.least("h_before", "h_after") >= variety)
    old = counts.filter(F.col("gram").isin(known)) if known else counts.limit(0)
    every = fresh.select("gram", "n").unionByName(old.select("gram", "n")).distinct()
    return every.select(F.col("gram").alias("word"), "n").orderBy(F.desc("n"), "word").limit(most)


def best_path(run: str, score: dict[str, float], longest: int, unknown: float) -> list[str]:
    """The words of the best path through the lattice of ``run``; a character that is no word scores ``unknown``."""
    n = len(run)
    worth, step = [0.0] * (n + 1), [1] * (n + 1)
    for i in range(n - 1, -1, -1):
        worth[i], step[i] = score.get(run[i], unknown) + worth[i + 1], 1
        for k in range(2, min(longest, n - i) + 1):
            s = score.get(run[i : i + k])
            if s is not None and s + worth[i + k] >= worth[i]:
                worth[i], step[i] = s + worth[i + k], k
    out, i = [], 0
    while i < n:
        out.append(run[i : i + step[i]])
        i += step[i]
    return out


def lattice_segmenter(words: dict[str, int]) -> Callable[..., Column]:
    """A pandas UDF text -> array of words by ``words`` (word -> frequency; 0 counts as 1)."""
    frequency = {w: max(1, n) for w, n in words.items()} | {w.lower(): max(1, n) for w, n in words.items()}
    total = sum(frequency.values()) + 1
    score = {w: math.log(n / total) for w, n in frequency.items()}
    longest, unknown = max(map(len, frequency), default=1), math.log(1 / total)

    @F.pandas_udf("array<string>")
    def segment(texts: pd.Series) -> pd.Series:
        def one(t):
            out, i, t = [], 0, t or ""
            while i < len(t):
                j, han = i + 1, _is_han(t[i])
                if han or t[i].isalnum():
                    while j < len(t) and _is_han(t[j]) == han and (han or t[j].isalnum()):
                        j += 1
                    out += best_path(t[i:j], score, longest, unknown) if han else [t[i:j]]
                i = j
            return out

        return texts.map(one)

    return segment
