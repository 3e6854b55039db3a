"""Benchmark decontamination by spaced-seed hashing; DataFrame functions only.

A mask such as 110111 hashes the words at its ones and ignores those at its zeros. Test items and documents are
hashed at every word position under every mask; equal hashes join; a hit puts the item beside the document on a
diagonal (document position less item position). Around the hits the words are compared one by one: a document
is reported for an item if some window of ``window`` words of the item (the whole item, if shorter) agrees in at
least ``percent`` percent of its places on one diagonal. Substituted words are tolerated; an inserted or dropped word moves
the rest to another diagonal, where it counts by itself.

Every such window has a seed without a substitution: all ways to lose places are listed for each length of window that
the items have, and where the masks miss one, masks for items of that length are added (see tests; with the default masks, window and
percent none for 8, 9, 13, 14 and 16 words or more). No mask begins or ends with a zero, so places beyond the document's ends are
substitutions like others.

Words are the runs of characters other than 20 and 09-0D of the text with A-Z in lower case. The documents' text
never moves: test hashes are broadcast if their counted bytes are few. Else a bitmap of fixed size picks the documents' seeds that items may have, and only these are shuffled,
without words; hits are merged by (document, item, diagonal) before any words are fetched, and only the words of documents with a hit move.
Null or empty texts match nothing. Rows of documents that repeat (doc_id, text) count once; items with equal text are
reported each, also one without an item_id. Empty tables give an empty result.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm import _frames
from tidewater.llm._frames import _sieved, docs, meet_few, small, stored

MASKS = ("110111", "111011", "1101011")
WORD_BREAK = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def word_hashes(text: Column) -> Column:
    """array<long> of the lower-case words' hashes."""
    low = F.translate(F.btrim(text, F.lit(SPACES)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(low == "", F.array().cast("array<long>")).otherwise(F.transform(F.split(low, WORD_BREAK), lambda w: F.xxhash64(w)))


def seeds(h: str, i: str, n: str, masks: list[str], only: dict[str, Column]) -> Column:
    """array<long> of the seeds that begin at word ``i``; null where a mask runs past the end or its condition in ``only`` fails."""
    out = []
    for m in masks:
        places = [F.get(F.col(h), F.col(i) + o) for o, one in enumerate(m) if one == "1"]
        fits = F.col(i) + len(m) <= F.col(n)
        out.append(F.when(fits & only[m] if m in only else fits, F.xxhash64(F.lit(m), *places)))
    return F.array(*out)


def meets(mask: str, kept: str) -> bool:
    """Whether all ones of ``mask`` lie on ones of ``kept`` somewhere."""
    m, k = int(mask[::-1], 2), int(kept[::-1], 2)
    return any((k >> s) & m == m for s in range(len(kept) - len(mask) + 1))


def own_masks(n: int, percent: int, masks: tuple[str, ...] = MASKS) -> list[str]:
    """What to add to ``masks`` so that any ``n`` places of which at least ``percent`` percent agree have a seed."""
    lost = n - -(-n * percent // 100)
    # Among the places that agree, some are in a row for so long: complete by itself, but with many hits.
    row = ["1" * max(1, -(-(n - lost) // (lost + 1)))]
    if comb(n, lost) > 10_000:
        return row
    ways = ("".join("0" if i in gone else "1" for i in range(n)) for gone in combinations(range(n), lost))
    left = [kept for kept in ways if not any(meets(m, kept) for m in masks)]
    if len(left) > 100:
        return row
    out, usual = [], "1" * min(m.count("1") for m in masks)
    while left:
        best = max([usual, *(kept.strip("0") for kept in left)], key=lambda m: sum(meets(m, kept) for kept in left))
        out.append(best)
        left = [kept for kept in left if not meets(best, kept)]
    return out


def _seeded(d: DataFrame, masks: list[str], only: dict[str, Column] = {}) -> DataFrame:
    """``d`` (with h) and a row for each (position i, seed)."""
    shortest = min(map(len, masks))
    at = d.withColumn("n", F.size("h")).filter(F.col("n") >= shortest)
    at = at.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - shortest)))
    return at.withColumn("seed", F.explode(seeds("h", "i", "n", masks, only)))


def find_leaks(documents: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, window: int = 20, percent: int = 80, by_text: bool = False) -> DataFrame:
    """doc_id, item_id, similarity (of the best window), n_places (diagonals that pass), one row for each pair found; with ``by_text`` for each text (th,
    its xxhash64), where rows may share a doc_id.

    ``documents`` has doc_id and text, ``benchmark`` item_id and text.
    """
    items = stored(docs(benchmark, "item_id", "text").select(F.col("doc_id").alias("item_id"), word_hashes(F.col("text")).alias("ih")).filter(F.size("ih") > 0).distinct().withColumn("item", F.xxhash64("item_id", "ih")))
    masks = tuple(m.strip("0") for m in masks)
    spans: dict[str, list[int]] = {}  # the lengths of window that an added mask is for
    for r in items.select(F.least(F.size("ih"), F.lit(window)).alias("n")).distinct().orderBy("n").collect():  # window rows at most
        for m in own_masks(r["n"], percent, masks):
            spans.setdefault(m, []).append(r["n"])
    all_masks = list(dict.fromkeys([*masks, *spans]))
    only = {m: F.least(F.col("n"), F.lit(window)).isin(ns) for m, ns in spans.items() if m not in masks}
    keyed = items.withColumn("h", F.col("ih"))
    item_seeds = stored(_seeded(keyed, all_masks, only).filter(F.col("seed").isNotNull()).select("seed", "item", F.col("i").alias("ipos")))
    d = docs(documents).select("doc_id", F.xxhash64("text").alias("th"), word_hashes(F.col("text")).alias("h"))
    diagonal = (F.col("i") - F.col("ipos")).alias("diagonal")
    key = ["doc_id", "th", "item", "diagonal"]
    # Places where document and item agree: a number for each word of the item goes on, the document's words don't.
    beside = F.transform("ih", lambda x, k: F.coalesce(F.when(F.col("diagonal") + k >= 0, F.get(F.col("h"), F.col("diagonal") + k) == x), F.lit(False)).cast("int"))
    if _frames.weight(item_seeds) <= _frames.BROADCAST_BYTES:
        hits = _seeded(d, all_masks).join(F.broadcast(item_seeds), "seed").select("doc_id", "th", "item", diagonal, "h")
        lined = hits.join(small(items), "item").select(*key, "item_id", F.size("ih").alias("n"), beside.alias("same"))
        once = lined.groupBy(*key, "item_id").agg(F.first("n").alias("n"), F.first("same").alias("same"))
    else:
        bare = _seeded(d, all_masks).select("seed", "doc_id", "th", "i").filter(F.col("seed").isNotNull())
        bare = _sieved(bare, "seed", item_seeds, "seed")[0]
        found = stored(bare.join(item_seeds, "seed").select("doc_id", "th", "item", diagonal).distinct())
        # One row for each document with a hit meets the documents, then its own hits, then each hit its item.
        few = stored(found.select(F.col("doc_id").alias("b_id"), F.col("th").alias("b_th")).distinct())
        words = stored(meet_few(d, few, "inner").dropDuplicates(["doc_id", "th"]).select(F.col("doc_id").alias("o_id"), F.col("th").alias("o_th"), "h"))
        near = found.join(words, F.col("doc_id").eqNullSafe(F.col("o_id")) & (F.col("th") == F.col("o_th"))).join(small(items), "item")
        once = near.select(*key, "item_id", F.size("ih").alias("n"), beside.alias("same"))
    w = F.least(F.col("n"), F.lit(window))
    sums = F.transform(F.sequence(F.lit(0), F.col("n") - w), lambda s: F.aggregate(F.slice("same", s + 1, w), F.lit(0), lambda a, x: a + x))
    scored = once.select("doc_id", "th", "item_id", F.array_max(sums).alias("best"), w.alias("w")).filter(F.col("best") * 100 >= F.col("w") * percent)
    return scored.groupBy("doc_id", *(["th"] if by_text else []), "item_id").agg(F.max(F.col("best") / F.col("w")).alias("similarity"), F.count("*").alias("n_places"))
