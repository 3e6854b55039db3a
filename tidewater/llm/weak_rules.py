"""Quality rules by weak supervision; DataFrame functions only.

Each rule votes good (1) or bad (0) on a document or abstains (-1). Rules are taken as
independent given the hidden quality; expectation-maximisation over the counts of vote patterns
estimates the share of good documents and, for each rule, how often it votes good, bad or abstains on
good and on bad documents. A document's posterior probability of being good replaces
a filter that all rules must pass.

Only pattern counts reach the driver: at most 3**len(RULES) rows, however large the table. The measures of each document
are computed once and written to the shared folder; no text moves and nothing but pattern counts is shuffled.

Words are runs of characters other than 20 and 09-0D. Null or empty text: no words, every measure 0.
Repeated rows count as often as they occur. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm._frames import docs, stored

SYMBOLS = "#*$%&|<>"
WORD_BREAK = r"[\x20\x09-\x0D]+"
#: Function words of the languages that the corpus is expected to have (fixed values, a parameter of ``votes``).
FUNCTION_WORDS = [
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "with",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "des", "ein",
    "le", "la", "les", "et", "de", "des", "en", "un", "que", "pour",
    "el", "los", "y", "se", "las", "por", "con", "una", "para", "al",
]


def measures(df: DataFrame) -> DataFrame:
    """doc_id and the measures that the rules read, one row for each row of ``df``."""
    text = F.col("text")
    words = F.filter(F.split(text, WORD_BREAK), lambda w: w != "")
    d = df.select("doc_id", "text", words.alias("w"))
    d = d.withColumn("n", F.size("w"))
    # Hashes of the 3-word windows; an array of long is compared and sorted without objects.
    window = F.when(F.col("n") >= 3, F.transform(F.sequence(F.lit(0), F.greatest(F.col("n") - 3, F.lit(0))), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))))
    d = d.withColumn("h", F.coalesce(window, F.array().cast("array<long>")))
    distinct = F.size(F.array_distinct("h"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    d = d.withColumn("lines", lines)
    return d.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(distinct < F.size("h"), _repeated("h")).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))).cast("long").alias("n_capitals"),
        F.size(F.filter("w", lambda x: x.isin(FUNCTION_WORDS))).cast("long").alias("n_function"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
    )


def _repeated(h: str) -> Column:
    """Number of words inside windows whose hash occurs at least twice.

    Windows are sorted by (hash, place); those equal to a neighbour are marked; a marked window at place p covers the
    words p, p + 1, p + 2, so in order of places it adds 3 words less those that the marked window before it has covered.
    """
    placed = F.array_sort(F.transform(F.col(h), lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

    def marked(s: Column) -> Column:
        before = lambda a, k: F.coalesce(F.when(k > 0, F.get(s, k - 1)["x"] == a["x"]), F.lit(False))
        after = lambda a, k: F.coalesce(F.get(s, k + 1)["x"] == a["x"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, lambda a, k: before(a, k) | after(a, k)), lambda a: a["i"]))

    # transform over a one-element array binds a value, so that it is computed once.
    places = F.get(F.transform(F.array(placed), marked), F.lit(0))
    covered = lambda m: F.aggregate(m, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, p: F.struct((a["n"] + F.least(p - a["last"], F.lit(3))).alias("n"), p.alias("last")), lambda a: a["n"])
    return F.get(F.transform(F.array(places), covered), F.lit(0))


def rules() -> dict[str, Column]:
    """Each rule's vote from the columns of ``measures``: 1 good, 0 bad, -1 abstains."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    mean = F.col("word_chars") / n
    bad = lambda c: F.when(c, 0).otherwise(-1)
    return {
        "symbols": bad(F.col("n_symbols") > 0.02 * chars),
        "capitals": bad(F.col("n_capitals") > 0.2 * chars),
        "repeats": bad(F.col("n_repeat_words") > 0.3 * n),
        "lines": bad(F.col("n_dup_lines") > 0.3 * F.col("n_lines")),
        "distinct": F.when(F.col("n_words") < 20, -1).when(F.col("n_distinct") < 0.4 * n, 0).otherwise(1),
        "word_length": F.when((mean < 3) | (mean > 6), 0).when(F.col("n_words") < 20, -1).otherwise(1),
        "function": F.when(F.col("n_words") < 20, -1).when(F.col("n_function") < 0.05 * n, 0).when(F.col("n_function") > 0.1 * n, 1).otherwise(-1),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50, good: float = 0.8) -> tuple[float, list[list[list[float]]]]:
    """Share of good documents and P(vote | quality) as [rule][quality][vote + 1], by expectation-maximisation.

    Starts from rules that mostly abstain on bad documents and seldom vote bad on good ones; add-one counts keep
    every probability above 0, so that no vote is ever impossible.
    """
    n_rules = len(patterns[0][0]) if patterns else len(rules())
    table = [[[0.5, 0.4, 0.1], [0.5, 0.02, 0.48]] for _ in range(n_rules)]
    for _ in range(rounds if patterns else 0):
        sums = [[[1.0] * 3 for _ in range(2)] for _ in range(n_rules)]
        total = [1.0, 1.0]
        for votes, count in patterns:
            p = posterior(votes, good, table)
            for q, w in ((1, p * count), (0, (1 - p) * count)):
                total[q] += w
                for r, v in enumerate(votes):
                    sums[r][q][v + 1] += w
        good = total[1] / (total[0] + total[1])
        table = [[[x / sum(s) for x in s] for s in rule] for rule in sums]
    return good, table


def posterior(votes: tuple[int, ...], good: float, table: list) -> float:
    z = math.log(good / (1 - good)) + sum(math.log(table[r][1][v + 1] / table[r][0][v + 1]) for r, v in enumerate(votes))
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def judged(df: DataFrame, rounds: int = 50) -> DataFrame:
    """doc_id, the measures, each rule's vote (vote_<rule>) and p_good of every row of ``df`` (doc_id, text)."""
    names = list(rules())
    voted = stored(measures(docs(df)).select("*", *[v.alias(f"vote_{k}") for k, v in rules().items()]))
    counts = voted.groupBy(*[f"vote_{k}" for k in names]).count().collect()
    patterns = sorted((tuple(int(r[i]) for i in range(len(names))), int(r["count"])) for r in counts)
    good, table = fit(patterns, rounds)
    z = F.lit(math.log(good / (1 - good)))
    for r, k in enumerate(names):
        weight = [math.log(table[r][1][v] / table[r][0][v]) for v in range(3)]
        z = z + F.when(F.col(f"vote_{k}") == 1, weight[2]).when(F.col(f"vote_{k}") == 0, weight[1]).otherwise(weight[0])
    return voted.withColumn("p_good", 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), z)))))
