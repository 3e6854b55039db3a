"""Text expressions: cleaning, scoring, quality. ``Column -> Column``, all in the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions import lexicon as lx
from tidewater.functions.math import let

#: White space and its opposite as character classes that Java and RE2 read alike.
WS = r"[\t-\r\x{1c}-\x{1f}\x{85}\p{Z}]"
SOLID = r"[^\t-\r\x{1c}-\x{1f}\x{85}\p{Z}]"
URL = r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*(),\\]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
#: Patterns that cleaning deletes, in order.
CLEANING = [
    rf"http[s]?://{SOLID}+",
    rf"@{SOLID}+",
    rf"#{SOLID}+#",
    r"\[[^\n]*?\]",
    r"<[^\n]*?>",
    r"""[^\x{4e00}-\x{9fa5}a-zA-Z0-9,。!?;:"\t-\r\x{1c}-\x{1f}\x{85}\p{Z}]""",
]
SPECIAL = r"[^\p{L}\p{M}\p{N}_\t-\r\x{1c}-\x{1f}\x{85}\p{Z}\x{4e00}-\x{9fff}]"


def string(c: Column) -> Column:
    """Text of any column; null is the empty text."""
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, rf"{WS}+", " "))


def remove_words(c: Column, words: Iterable[str] = lx.REMOVED) -> Column:
    """Each word, longest first, becomes a space; then ``squeeze``. Null gives the empty text."""
    out = string(c)
    for w in sorted(words, key=len, reverse=True):
        out = F.replace(out, F.lit(w), F.lit(" "))
    return squeeze(out)


def clean_text(c: Column) -> Column:
    """Without links, mentions, hashtags, bracketed marks, tags and unusual characters."""
    out = string(c)
    for pattern in CLEANING:
        out = F.regexp_replace(out, pattern, "")
    return strip(out)


def length_factor(c: Column) -> Column:
    """Trust in a score by text length: short texts more, long ones less; null least."""
    n = F.char_length(c)
    return F.when(n < 20, 1.1).when(n < 50, 1.05).when(n < 200, 1.0).when(n < 500, 0.9).otherwise(0.7)


def _hits(text: Column, words: Iterable[str]) -> list[Column]:
    return [F.contains(text, F.lit(w)) for w in words]


def contains_any(text: Column, words: Iterable[str]) -> Column:
    out = F.lit(False)
    for h in _hits(text, words):
        out = out | h
    return out


def count_present(text: Column, words: Iterable[str]) -> Column:
    """How many of the words (with their repetitions in the list) stand in the text at least once."""
    out = F.lit(0)
    for h in _hits(text, words):
        out = out + h.cast("int")
    return out


def keyword_matches(text: Column, lex: lx.Lexicon, literal_case: bool = False) -> Column:
    """array<struct<keyword, weight>> of keywords in the lower-cased text, in the lexicon's order.

    ``literal_case`` leaves keywords as they are, so those with capitals never match.
    """
    low = F.lower(text)
    none = F.lit(None).cast("struct<keyword:string,weight:double>")
    each = [
        F.when(F.contains(low, F.lit(k if literal_case else k.lower())), F.struct(F.lit(k).alias("keyword"), F.lit(w).alias("weight"))).otherwise(none)
        for k, w in zip(lex.keywords, lex.weights)
    ]
    return F.filter(F.array(*each), lambda m: m.isNotNull()) if each else F.array().cast("array<struct<keyword:string,weight:double>>")


def match_weight(text: Column, lex: lx.Lexicon, least: float | None = None, only: Iterable[str] | None = None, count: bool = False, literal_case: bool = False, lowered: bool = False) -> Column:
    """Sum of weights (or number) of keywords present, of those that weigh ``least`` or are in ``only``. Plain columns, no arrays."""
    low = text if lowered else F.lower(text)
    out = F.lit(0) if count else F.lit(0.0)
    for k, w in zip(lex.keywords, lex.weights):
        if (least is None or w >= least) and (only is None or k in only):
            out = out + F.when(F.contains(low, F.lit(k if literal_case else k.lower())), 1 if count else w).otherwise(0)
    return out


def keyword_score(text: Column, lex: lx.Lexicon, excluded: Iterable[str] = lx.EXCLUDED, removed: Iterable[str] = lx.REMOVED) -> Column:
    """Weight of matches times the length factor; 0 for blank texts and those with an excluded word."""
    blank = F.coalesce(strip(text) == "", F.lit(True))
    # The cleaned and the lowered text are bound once.
    score = let(remove_words(text, removed), lambda t: let(F.lower(t), lambda low: F.when(contains_any(low, excluded), 0.0).otherwise(match_weight(low, lex, lowered=True) * length_factor(t))))
    return F.when(blank, 0.0).otherwise(score)


def render_matches(matches: Column, most: int = 10) -> Column:
    """The first matches as ``keyword(weight)``, joined by ``; ``."""
    return F.array_join(F.transform(F.slice(matches, 1, most), lambda m: F.concat(m.keyword, F.lit("("), m.weight.cast("string"), F.lit(")"))), "; ")


def quality_reason(text: Column, removed: Iterable[str] = lx.REMOVED) -> Column:
    """The first rule that a text breaks: empty, short, repeated, links, special; else ok."""
    t = remove_words(text, removed)
    n = F.char_length(t)
    special = n - F.char_length(F.regexp_replace(t, SPECIAL, ""))
    return (
        F.when(t == "", "empty").when(n < 15, "short").when(t.rlike(r"([^\n])\1{5,}"), "repeated")
        .when(F.regexp_count(t, F.lit(URL)) > 3, "links").when(special > 0.4 * n, "special").otherwise("ok")
    )


def fingerprint(c: Column) -> Column:
    """Lower case, white space squeezed; null stays null."""
    return squeeze(F.lower(c))


def sentiment(c: Column, positive: Iterable[str] = lx.POSITIVE, negative: Iterable[str] = lx.NEGATIVE) -> Column:
    """(p - n) / max(1, p + n) of words present."""
    t = F.lower(string(c))
    p, n = count_present(t, positive), count_present(t, negative)
    return (p - n) / F.greatest(F.lit(1), p + n)


def arousal(c: Column, positive: Iterable[str] = lx.POSITIVE, negative: Iterable[str] = lx.NEGATIVE) -> Column:
    """min(1, (p + n) / max(1, length / 100))."""
    t = F.lower(string(c))
    return F.least(F.lit(1.0), (count_present(t, positive) + count_present(t, negative)) / F.greatest(F.lit(1.0), F.char_length(t) / 100.0))


def tokens(c: Column, stop: Iterable[str] = lx.STOP_WORDS, least: int = 2) -> Column:
    """Lower-case runs of letters and digits of ``least`` characters that aren't stop words."""
    stop = list(stop)
    words = F.split(F.lower(string(c)), r"[^\p{L}\p{N}]+")
    return F.filter(words, lambda w: (F.char_length(w) >= least) & ~w.isin(stop))


def name_class(name: Column) -> Column:
    """science or shortcut, by what a strategy's name has; else null."""
    return F.when(contains_any(name, ["科学", "健康"]), "science").when(contains_any(name, ["快速", "捷径"]), "shortcut")


def strategy_cost(name: Column, rules=lx.COST_RULES, default: float = lx.DEFAULT_COST) -> Column:
    """The first rule with a word in the lower-cased name."""
    low, out = F.lower(name), F.lit(default)
    for words, cost in reversed(rules):
        out = F.when(contains_any(low, words), cost).otherwise(out)
    return out


def strategy_name(keywords: Column, profile: Column | None = None, patterns=lx.STRATEGY_PATTERNS, literal_case: bool = False) -> Column:
    """A strategy's name from its profile (struct) by thresholds, else from its keywords (text) by the most pattern words."""
    low = F.lower(keywords)
    counts = F.array(*[count_present(low, words if literal_case else [w.lower() for w in words]) for words in patterns.values()])
    names = F.array(*map(F.lit, patterns))
    # The counts are bound once; array_position finds the first of equals.
    out = let(counts, lambda c: F.when(F.array_max(c) > 0, F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))).otherwise("综合策略型"))
    if profile is None:
        return out
    p = profile
    return F.when(p.isNull(), out).otherwise(
        F.when(p["exercise"] > 0.6, "运动主导型").when(p["diet"] > 0.6, "饮食控制型").when(p["medical"] > 0.5, "医学干预型")
        .when(p["special_group"] > 0.5, "特殊人群适配型").when(p["tech_quant"] > 0.5, "技术量化型").when(p["innovation"] > 0.5, "创新方法型")
        .when((p["exercise"] > 0.4) & (p["diet"] > 0.4), "运动饮食结合型").when((p["tech_quant"] > 0.3) & (p["innovation"] > 0.3), "科技驱动创新型")
        .otherwise(out)
    )
