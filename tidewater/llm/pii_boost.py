"""Personal data: high-recall generators propose spans, boosted trees score them, calibrated thresholds select; DataFrame functions only.

Base spans are the leftmost non-overlapping matches of a pattern of each kind (email, ip, card, phone) that pass the kind's own check; they always stay.
Generators are looser or differently cut patterns, so that their spans overlap: a card number inside a longer row of numbers, a phone number without a country code or
with other numbers after it, an address written with (at) and (dot). Each candidate has a few small format and context features.

Labels come from the text itself: a candidate that is a base span is positive; one that fails its kind's check and meets no base span is negative; the others are unlabelled, and
they are what the trees decide. Candidates are counted by feature vector, over all documents; there are at most PATTERNS such vectors, whatever the corpus, so only they reach the driver, where gradient
boosting (logistic loss, Newton steps, trees of depth two) fits on two thirds of the documents. The other third calibrates: scores are made monotone probabilities by pooling
adjacent violators, and each kind gets the least score from which the probability is at least ``precision``; a kind without enough calibration cases adds nothing. The trees become column expressions.

Patterns have possessive quantifiers, which don't backtrack, wherever that leaves their matches as they are: a text of any length is scanned in linear time without deep recursion. Places are
code points, ends exclusive. Offsets are sums over the pieces between matches, in blocks of 256, so that texts with very many matches stay far below quadratic work.

A null text is empty and has no spans; a null doc_id is a value like others; repeated rows give repeated results; empty tables give empty results, and without labelled candidates
only base spans are found. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm._frames import docs, stored

KINDS = ["email", "ip", "card", "phone"]
_LOCAL, _HOST = "A-Za-z0-9._%+-", "A-Za-z0-9-"
#: Equal to the plain patterns in what they match: a local part begins where the last match ended or no local character stands before it.
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_HOST}]++(?:\.[{_HOST}]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: (kind, pattern, what a text must have) of each generator.
GENERATORS = [
    ("email", rf"(?<![{_LOCAL}])[{_LOCAL}]++@[{_HOST}]++(?:\.[{_HOST}]++)*+", "@"),
    ("email", rf"(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}+\x20?[\[({{]\x20?(?:at|AT|At)\x20?[\])}}]\x20?[{_HOST}]++(?:(?:\.|\x20?[\[({{]\x20?(?:dot|DOT|Dot)\x20?[\])}}]\x20?)[{_HOST}]++)++", "[\\[({]\\x20?[aA][tT]"),
    ("ip", r"(?<![0-9.])[0-9]{1,4}+(?:\.[0-9]{1,4}+){3}(?![0-9.])", r"\.[0-9]{1,4}\."),
    ("card", r"(?<![0-9])[0-9]{12,19}+(?![0-9])", "[0-9]{12}"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[\x20-][0-9]{4}){2}[\x20-][0-9]{1,7}+(?![0-9])", "[0-9]{4}[ -][0-9]{4}[ -][0-9]"),
    ("phone", r"(?:\+[0-9]{1,3}[\x20.-]?)?+(?:\([0-9]{3}\)|(?<![0-9])[0-9]{3})[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])", "[0-9]{3}[ .-][0-9]{4}"),
    ("phone", r"\+[0-9]{1,3}+[\x20.-]?[0-9]{6,12}+(?![0-9])", r"\+[0-9]"),
    ("phone", r"(?<![0-9+().-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])", "[0-9]{3}[ .-][0-9]{4}"),
]
#: Matches that are summed at a time.
RUN = 256
BEFORE, AFTER = 24, 8
_HIT = "struct<at:long,end:long,hit:string,before:string,after:string>"
#: Cues in the characters before a candidate: 1 for what names another number, 2 for what names personal data.
OTHER = r"(?i)(?:token|secret|hash|sha|key|version|isbn|issn|order|serial)[^A-Za-z0-9]{0,6}\z"
OWN = r"(?i)(?:phone|tel|call|fax|mobile|card|visa|mail|contact|address|host|ip|server)[^A-Za-z0-9]{0,6}\z"
#: Feature -> number of its values.
FEATURES = {"gen": len(GENERATORS), "digits": 6, "luhn": 2, "octets": 2, "marks": 3, "plus": 2, "paren": 2, "dots": 3, "left": 5, "right": 5, "cue": 3}
PATTERNS = math.prod(FEATURES.values())


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scanned(items: Column, zero: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """Array of what ``step(state, item)`` gives beside the next state, of type ``kind``; in runs, so that a growing array is copied once a run."""
    none = F.array().cast(f"array<{kind}>")

    def one(a: Column, x: Column) -> Column:
        state, out = step(a["s"], x)
        return F.struct(state.alias("s"), F.concat(a["out"], F.array(out)).alias("out"))

    def over(own: Column) -> Column:
        run = lambda s, k: F.aggregate(F.slice(own, k * RUN + 1, F.lit(RUN)), F.struct(s.alias("s"), none.alias("out")), one)
        runs = F.sequence(F.lit(0), F.floor((F.size(own) - 1) / RUN).cast("int"))
        joined = lambda a, k: bound(run(a["s"], k), lambda r: F.struct(r["s"].alias("s"), F.concat(a["out"], r["out"]).alias("out")))
        return F.when(F.size(own) > 0, F.aggregate(runs, F.struct(zero.alias("s"), none.alias("out")), joined, lambda a: a["out"])).otherwise(none)

    return bound(items, over)


def found(text: Column, pattern: str) -> Column:
    """Array of the matches of ``pattern``: at, end (code points), hit, and some characters before and after it."""

    def placed(b: Column) -> Column:
        piece = lambda i: F.get(b["p"], i)
        one = lambda h, i: F.struct(h.alias("hit"), F.char_length(piece(i)).cast("long").alias("gap"), F.right(piece(i), F.lit(BEFORE)).alias("before"), F.left(piece(i + 1), F.lit(AFTER)).alias("after"))
        return scanned(F.transform(b["h"], one), F.lit(0).cast("long"), _HIT, step)

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        end = at + x["gap"] + F.char_length(x["hit"])
        return end, F.struct((at + x["gap"]).alias("at"), end.alias("end"), x["hit"].alias("hit"), x["before"].alias("before"), x["after"].alias("after"))

    return bound(F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("h")), placed)


def digits(s: Column) -> Column:
    return F.translate(s, " -.()+", "")


def luhn(d: Column) -> Column:
    """Whether the digits pass the check: every second one from the right is doubled, digit sums divide by ten."""
    back = F.reverse(d)
    text = F.concat(F.regexp_replace(back, "([0-9])[0-9]?", "$1"), F.translate(F.regexp_replace(back, "[0-9]([0-9]?)", "$1"), "0123456789", "0246813579"))
    count = lambda k: F.char_length(text) - F.char_length(F.translate(text, str(k), ""))
    return sum((count(k) * k for k in range(1, 10)), F.lit(0)) % 10 == 0


def octets(s: Column) -> Column:
    """Whether each of the numbers between dots is at most 255."""

    def low(part: Column) -> Column:
        bare = F.ltrim(part, F.lit("0"))
        return (F.char_length(bare) < 3) | ((F.char_length(bare) == 3) & (bare <= "255"))

    return F.forall(F.split(s, r"\.", -1), low)


def passes(kind: str, hit: Column) -> Column:
    """The check of a kind on a match of it."""
    if kind == "card":
        n = F.char_length(digits(hit))
        return n.between(14, 19) & luhn(digits(hit))
    if kind == "phone":
        return F.char_length(digits(hit)).between(10, 15)
    return octets(hit) if kind == "ip" else F.contains(hit, F.lit("@")) & F.contains(F.substring_index(hit, "@", -1), F.lit("."))


_NEEDS = {"email": "@", "ip": r"\.[0-9]+\.", "card": "[0-9](?:[ -]?[0-9]){13}", "phone": r"\+[0-9]"}


def _matched(text: Column, pattern: str, need: str) -> Column:
    """Matches of a text that has what they need, else none."""
    has = F.contains(text, F.lit(need)) if len(need) == 1 else F.rlike(text, F.lit(need))
    return F.when(has, found(text, pattern)).otherwise(F.array().cast(f"array<{_HIT}>"))


def base_spans(text: Column) -> Column:
    """Array of (at, kind, end), kind as a place in KINDS, in order of at and kind."""

    def of(k: int, kind: str) -> Column:
        good = F.filter(_matched(text, BASE[kind], _NEEDS[kind]), lambda x: passes(kind, x["hit"]))
        return F.transform(good, lambda x: F.struct(x["at"].alias("at"), F.lit(k).alias("kind"), x["end"].alias("end")))

    return F.array_sort(F.concat(*[of(k, kind) for k, kind in enumerate(KINDS)]))


def _beside(c: Column) -> Column:
    """What a neighbouring character is: 0 none or white space, 1 a digit, 2 a letter, 3 a quote or an equals sign, 4 other."""
    return F.when((c == "") | F.rlike(c, F.lit(r"\s")), 0).when(F.rlike(c, F.lit("[0-9]")), 1).when(F.rlike(c, F.lit(r"\p{L}")), 2).when(c.isin('"', "'", "=", "`"), 3).otherwise(4)


def _features(kind: str, gen: int, x: Column) -> dict[str, Column]:
    hit = x["hit"]
    n = F.char_length(F.regexp_replace(hit, "[^0-9]", ""))
    mark = lambda m: F.when(F.contains(hit, F.lit(m)), 1).otherwise(0)
    dots = F.char_length(hit) - F.char_length(F.translate(hit, ".", ""))
    last = F.substring_index(hit, "@", -1) if kind == "email" else hit
    host = F.char_length(last) - F.char_length(F.translate(last, ".", ""))
    return {
        "gen": F.lit(gen),
        "digits": F.when(n < 7, 0).when(n < 10, 1).when(n < 13, 2).when(n < 16, 3).when(n == 16, 4).otherwise(5),
        "luhn": (n.between(14, 19) & luhn(digits(hit))).cast("int") if kind == "card" else F.lit(0),
        "octets": octets(hit).cast("int") if kind == "ip" else F.lit(0),
        "marks": F.least(mark(" ") + mark("-"), F.lit(2)),
        "plus": mark("+"),
        "paren": mark("("),
        "dots": F.least(host if kind == "email" else dots, F.lit(2)),
        "left": _beside(F.right(x["before"], F.lit(1))),
        "right": _beside(F.left(x["after"], F.lit(1))),
        "cue": F.when(F.rlike(x["before"], F.lit(OTHER)), 1).when(F.rlike(x["before"], F.lit(OWN)), 2).otherwise(0),
    }


def candidates(text: Column) -> Column:
    """Array of (at, kind, end, sure: it passes the kind's check, f: its features) from all generators."""

    def of(g: int, kind: str, pattern: str, need: str) -> Column:
        def one(x: Column) -> Column:
            f = F.struct(*[c.cast("int").alias(k) for k, c in _features(kind, g, x).items()])
            # Written-out addresses have no @: that they match is their check.
            ok = F.lit(True) if kind == "email" and need != "@" else passes(kind, x["hit"])
            return F.struct(x["at"].alias("at"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end"), ok.alias("sure"), f.alias("f"))

        return F.transform(_matched(text, pattern, need), one)

    return F.concat(*[of(g, *x) for g, x in enumerate(GENERATORS)])


_VECTOR = f"struct<{','.join(f'{k}:int' for k in FEATURES)}>"
_CANDIDATE = f"struct<at:long,kind:int,end:long,sure:boolean,f:{_VECTOR},own:boolean,meets:boolean>"


def marked(base: Column, cand: Column) -> Column:
    """Candidates in order of (at, kind, end) with own: it is a base span, meets: it overlaps one. Two sweeps, whatever the number of spans."""
    first = F.transform(base, lambda b: F.struct(b["at"].alias("at"), b["kind"].alias("kind"), b["end"].alias("end"), F.lit(0).alias("c"), F.lit(None).cast("boolean").alias("sure"), F.lit(None).cast(_VECTOR).alias("f")))
    rest = F.transform(cand, lambda c: F.struct(c["at"].alias("at"), c["kind"].alias("kind"), c["end"].alias("end"), F.lit(1).alias("c"), c["sure"].alias("sure"), c["f"].alias("f")))
    every = F.array_sort(F.concat(first, rest))
    is_base = lambda x: x["c"] == 0

    # Forward: how far base spans that began have reached; an equal base span stands right before its candidates.
    def forward(s: Column, x: Column) -> tuple[Column, Column]:
        key = F.struct(x["at"].alias("at"), x["kind"].alias("kind"), x["end"].alias("end"))
        state = F.struct(F.when(is_base(x), F.greatest(s["reach"], x["end"])).otherwise(s["reach"]).alias("reach"), F.when(is_base(x), key).otherwise(s["last"]).alias("last"))
        out = F.struct(x["at"].alias("at"), x["kind"].alias("kind"), x["end"].alias("end"), x["c"].alias("c"), x["sure"].alias("sure"), x["f"].alias("f"), F.coalesce(s["last"] == key, F.lit(False)).alias("own"), (s["reach"] > x["at"]).alias("meets"))
        return state, out

    # Backward: where the next base span begins.
    def backward(near: Column, x: Column) -> tuple[Column, Column]:
        out = F.struct(x["at"].alias("at"), x["kind"].alias("kind"), x["end"].alias("end"), x["c"].alias("c"), x["sure"].alias("sure"), x["f"].alias("f"), x["own"].alias("own"), (x["meets"] | (near < x["end"])).alias("meets"))
        return F.when(is_base(x), x["at"]).otherwise(near), out

    swept = _CANDIDATE.replace("sure", "c:int,sure")
    none = F.struct(F.lit(0).cast("long").alias("reach"), F.lit(None).cast("struct<at:long,kind:int,end:long>").alias("last"))
    there = scanned(every, none, swept, forward)
    back = F.reverse(scanned(F.reverse(there), F.lit(2**62).cast("long"), swept, backward))
    return F.transform(F.filter(back, lambda x: x["c"] == 1), lambda x: F.struct(*[x[k].alias(k) for k in ("at", "kind", "end", "sure", "f", "own", "meets")]))


def proposed(df: DataFrame) -> DataFrame:
    """doc_id, base (array of at, kind, end) and cand (candidates, marked) of every row of ``df``; no text. Written: texts are scanned once."""
    d = docs(df).select("doc_id", base_spans(F.col("text")).alias("base"), candidates(F.col("text")).alias("cand"))
    return stored(d.select("doc_id", "base", marked(F.col("base"), F.col("cand")).alias("cand")))


Counts = list[tuple[tuple[int, ...], bool, int, int]]


def pattern_counts(rows: DataFrame) -> Counts:
    """(features, held out, positives, negatives) of labelled candidates: at most 2 * PATTERNS rows."""
    held = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "utf-8")) % 3 == 1
    one = rows.select(held.alias("held"), F.explode("cand").alias("c")).filter("c.own or not (c.sure or c.meets)")
    got = one.groupBy("held", *[F.col(f"c.f.{k}").alias(k) for k in FEATURES]).agg(F.count_if("c.own").alias("good"), F.count_if(~F.col("c.own")).alias("bad"))
    return sorted((tuple(int(r[k]) for k in FEATURES), bool(r["held"]), int(r["good"]), int(r["bad"])) for r in got.collect())


#: A leaf's value, or (feature, operator, value, if so, if not); the operator is <= or ==.
Tree = float | tuple


def value(tree: Tree, f: tuple[int, ...]) -> float:
    while isinstance(tree, tuple):
        k, op, v, yes, no = tree
        tree = yes if (f[k] <= v if op == "<=" else f[k] == v) else no
    return tree


def _leaf(g: float, h: float, shrink: float, rate: float) -> float:
    return rate * g / (h + shrink)


def _grow(rows: list[tuple[tuple[int, ...], float, float]], depth: int, shrink: float, rate: float) -> Tree:
    """The tree of this depth with the largest gains; rows are (features, gradient, curvature). Ties: the first feature, operator and value."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    best = (1e-9, None)
    for k, n in enumerate(FEATURES.values()) if depth else ():
        sums = [[0.0, 0.0] for _ in range(n)]
        for f, a, b in rows:
            sums[f[k]][0] += a
            sums[f[k]][1] += b
        below = [0.0, 0.0]
        for v in range(n):
            below = [below[0] + sums[v][0], below[1] + sums[v][1]]
            for op, (a, b) in (("<=", below), ("==", sums[v])):
                if 0 < b < h:
                    gain = a * a / (b + shrink) + (g - a) ** 2 / (h - b + shrink) - g * g / (h + shrink)
                    if gain > best[0] + 1e-12:
                        best = (gain, (k, op, v))
    if best[1] is None:
        return _leaf(g, h, shrink, rate)
    k, op, v = best[1]
    yes = [r for r in rows if (r[0][k] <= v if op == "<=" else r[0][k] == v)]
    no = [r for r in rows if not (r[0][k] <= v if op == "<=" else r[0][k] == v)]
    return (k, op, v, _grow(yes, depth - 1, shrink, rate), _grow(no, depth - 1, shrink, rate)) if yes and no else _leaf(g, h, shrink, rate)


def boost(counts: Counts, rounds: int = 30, depth: int = 2, shrink: float = 1.0, rate: float = 0.3) -> list[Tree]:
    """Trees that add up to a candidate's log-odds, from the counts that aren't held out."""
    rows = [(f, good, bad) for f, held, good, bad in counts if not held]
    trees: list[Tree] = []
    score = [0.0] * len(rows)
    for _ in range(rounds if rows else 0):
        steps = []
        for (f, good, bad), z in zip(rows, score, strict=True):
            p = 1 / (1 + math.exp(-z))
            steps.append((f, good - (good + bad) * p, (good + bad) * p * (1 - p)))
        trees.append(_grow(steps, depth, shrink, rate))
        score = [z + value(trees[-1], r[0]) for r, z in zip(rows, score, strict=True)]
    return trees


def calibrated(cases: list[tuple[float, int, int]]) -> list[tuple[float, float]]:
    """(least score, probability) of each step, ascending, by pooling adjacent violators over (score, positives, negatives)."""
    pools: list[list[float]] = []
    for z, good, bad in sorted(cases):
        pools.append([z, good, good + bad])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, a, n = pools.pop()
            pools[-1][1] += a
            pools[-1][2] += n
    return [(z, a / n) for z, a, n in pools]


def thresholds(counts: Counts, trees: list[Tree], precision: float, least: int) -> dict[int, float]:
    """Kind -> the least score from which the probability is ``precision``, for kinds with ``least`` positives or more among what is held out."""
    out = {}
    for k, kind in enumerate(KINDS):
        gens = {g for g, x in enumerate(GENERATORS) if x[0] == kind}
        cases = [(round(sum(value(t, f) for t in trees), 9), good, bad) for f, held, good, bad in counts if held and f[0] in gens]
        steps = [z for z, p in calibrated(cases) if p >= precision]
        if steps and sum(c[1] for c in cases) >= least:
            out[k] = steps[0]
    return out


def _scored(tree: Tree, f: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    k, op, v, yes, no = tree
    c = f[list(FEATURES)[k]]
    return F.when(c <= v if op == "<=" else c == v, _scored(yes, f)).otherwise(_scored(no, f))


def detect(df: DataFrame, precision: float = 0.9, least: int = 20, rounds: int = 30) -> DataFrame:
    """doc_id, base and spans (arrays of at, kind, end; kind as a place in KINDS) of every row of ``df``; spans are the base ones and those that the trees add.

    Added spans meet no base span and no other: from left to right, of those that begin together the longest.
    """
    rows = proposed(df)
    counts = pattern_counts(rows)
    trees = boost(counts, rounds)
    least_score = thresholds(counts, trees, precision, least)
    score = lambda f: sum((_scored(t, f) for t in trees), F.lit(0.0))
    enough = lambda c: F.coalesce(*[F.when(c["kind"] == k, F.round(score(c["f"]), 9) >= z) for k, z in least_score.items()], F.lit(False))
    chosen = F.filter("cand", lambda c: c["sure"] & ~c["own"] & ~c["meets"] & enough(c))
    added = F.array_sort(F.transform(chosen, lambda c: F.struct(c["at"].alias("at"), (-c["end"]).alias("back"), c["kind"].alias("kind"))))

    def free(reach: Column, c: Column) -> tuple[Column, Column]:
        fits = c["at"] >= reach
        return F.when(fits, -c["back"]).otherwise(reach), F.struct(c["at"].alias("at"), c["kind"].alias("kind"), (-c["back"]).alias("end"), fits.alias("fits"))

    kept = F.filter(scanned(added, F.lit(0).cast("long"), "struct<at:long,kind:int,end:long,fits:boolean>", free), lambda c: c["fits"])
    plain = F.transform(kept, lambda c: F.struct(c["at"].alias("at"), c["kind"].alias("kind"), c["end"].alias("end")))
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", plain)).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of each, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["at"], s["end"])), ",")


def digest(found_: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256 and spans (text) from what ``detect`` gives."""
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    n = [of(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found_.select("doc_id", *n, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each run of overlapping spans replaced by the first one's kind in brackets; ``spans`` as from ``detect``."""
    whole = F.lit(2**31 - 1).cast("long")
    ends = F.concat(spans, F.array(F.struct(whole.alias("at"), F.lit(-1).alias("kind"), whole.alias("end"))))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(reach: Column, s: Column) -> tuple[Column, Column]:
        apart = s["at"] >= reach
        before = F.substring(text, (reach + 1).cast("int"), F.greatest(s["at"] - reach, F.lit(0)).cast("int"))
        out = F.when(apart, F.concat(before, F.coalesce(F.get(names, s["kind"]), F.lit("")))).otherwise("")
        return F.greatest(reach, s["end"]), out

    return F.array_join(scanned(ends, F.lit(0).cast("long"), "string", step), "")
