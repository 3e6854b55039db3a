"""Personal data, conversation repair and the Merkle manifest against plain versions of their definitions."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidewater.llm import _frames, conversation_repair, merkle_manifest, pii_boost, queries

SF = "/root/testdata/sf0.001"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def as_set(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# Personal data

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
CARD, PHONE = "4845168114407329", "+1 (017) 555-7713"


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        total += int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c))))
    return total % 10 == 0


def good(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"ip": lambda: all(int(x) <= 255 for x in m.split(".")), "card": lambda: 14 <= len(d) <= 19 and luhn(d), "phone": lambda: 10 <= len(d) <= 15, "email": lambda: True}[kind]()


def base(t):
    return sorted((m.start(), i, m.end()) for i, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, t or "") if good(k, m[0]))


def spelled(spans):
    return ",".join(f"{list(PLAIN)[k]}:{a}:{e}" for a, k, e in spans)


def pii_rows():
    r = random.Random(5)
    rows = [(i, "".join(r.choice("aB1.@+-% ()9_é🎉\n") for _ in range(r.randint(0, 60)))) for i in range(800)]
    parts = [CARD, "1.2.3.4", "a.b@c.d", " ", PHONE, "-", ".", "é", "256.1.1.1", "@", "x", "0"]
    rows += [(1000 + i, "".join(r.choice(parts) for _ in range(r.randint(0, 12)))) for i in range(500)]
    rows += [(None, None), (None, "x@y.z"), (1, ""), (2000, "a" * 4000), (2001, "1 " * 9000), (2002, "a@b" + ".c" * 9000), (2003, f"{PHONE}\n" * 700), (2004, "+1" + " " * 5000), (2005, "1.1.1.1 " * 900 + "é"), (2006, "9" * 4000)]
    return rows + [(2010, "x@y.z"), (2010, "x@y.z")]


def pii_frame(spark, rows):
    return spark.createDataFrame([(d, t, "other", 3) for d, t in rows], "doc_id long, text string, TEXT string, at long").repartition(3)


def test_pii_base_spans_and_additions(spark):
    rows = pii_rows()
    found = pii_boost.detect(pii_frame(spark, rows))
    got = pii_boost.digest(found).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    want = [(d, *[sum(s[1] == k for s in base(t)) for k in range(4)], sha(spelled(base(t)))) for d, t in rows]
    assert as_set(got) == sorted(want, key=str)
    text = dict(rows)
    for r in found.filter("doc_id is not null").collect():
        own, every = [tuple(s) for s in r.base], [tuple(s) for s in r.spans]
        assert every == sorted(every) and not set(own) - set(every)
        for a, k, e in set(every) - set(own):  # what is added is such data, and meets no other span
            kind = list(PLAIN)[k]
            assert good(kind, text[r.doc_id][a:e]) and not any(x < e and a < y for x, _, y in every if (x, y) != (a, e))


def test_pii_finds_what_the_base_misses_and_leaves_the_rest(spark):
    words = "the of and in thion erand".split()
    r = random.Random(2)
    plain = lambda: " ".join(r.choice(words) for _ in range(8))
    rows = [(i, f"{plain()} {x} {plain()}") for i, x in enumerate([CARD, PHONE, "me@host.example.com", "10.20.30.40", "4845168114407320", "555-7713"] * 60)]
    rows += [(1000, f"{plain()} {CARD} 7536784127813050 {plain()}"), (1001, f"{plain()} {PHONE} 190.137.223.204 {plain()}"), (1002, f"12 {CARD} {plain()}")]
    rows += [(2000 + i, f"{plain()} version 4.0. {i} 1234-56 {plain()}") for i in range(50)]
    got = {x.doc_id: x for x in pii_boost.detect(pii_frame(spark, rows), least=5).collect()}
    text = dict(rows)
    cut = lambda d: [text[d][s.at : s.end] for s in got[d].spans]
    assert cut(1000) == [CARD, "7536784127813050"] and not got[1000].base
    assert cut(1001) == [PHONE, "190.137.223.204"] and cut(1002) == [CARD]
    assert all(not got[2000 + i].spans for i in range(50))
    # 1 in 10 numbers passes the check by chance: this one doesn't.
    assert all(not got[d].spans for d, t in rows if "4845168114407320" in t)


def test_pii_redaction(spark):
    rows = [(1, f"a {PHONE}, x@y.zé {CARD}"), (2, ""), (3, "none"), (4, None), (5, "1.2.3.4@h.com z")]
    d = _frames.docs(pii_frame(spark, rows))
    got = dict(tuple(x) for x in d.select("doc_id", pii_boost.redacted(F.col("text"), pii_boost.base_spans(F.col("text")))).collect())
    assert got == {1: "a [PHONE], [EMAIL]é [CARD]", 2: "", 3: "none", 4: "", 5: "[EMAIL] z"}


def test_pii_empty(spark):
    assert pii_boost.digest(pii_boost.detect(pii_frame(spark, []))).count() == 0


def test_boosting_by_definition():
    """The first tree's root is the split of the largest gain over all splits; boosting lowers the loss; what is held out doesn't count."""
    import math

    r = random.Random(4)
    sizes = list(pii_boost.FEATURES.values())
    counts = []
    for _ in range(120):
        f = tuple(r.randrange(n) for n in sizes)
        p = 0.9 if f[2] and f[8] != 1 else 0.1
        n = r.randint(1, 30)
        good_ = sum(r.random() < p for _ in range(n))
        counts.append((f, r.random() < 0.3, good_, n - good_))
    trees = pii_boost.boost(counts, 20)
    assert trees == pii_boost.boost([c for c in counts if not c[1]], 20)
    rows = [(c[0], c[2] - (c[2] + c[3]) / 2, (c[2] + c[3]) / 4) for c in counts if not c[1]]

    def gain(yes):
        g, h = (sum(x[i] for x in rows) for i in (1, 2))
        a, b = (sum(x[i] for x in rows if yes(x[0])) for i in (1, 2))
        return a * a / (b + 1) + (g - a) ** 2 / (h - b + 1) - g * g / (h + 1) if 0 < b < h else 0

    best = max(gain(lambda f, k=k, v=v, op=op: f[k] <= v if op else f[k] == v) for k, n in enumerate(sizes) for v in range(n) for op in (True, False))
    k, op, v = trees[0][:3]
    assert gain(lambda f: f[k] <= v if op == "<=" else f[k] == v) == pytest.approx(best)

    def loss(n):
        out = 0
        for f, held, a, b in counts:
            z = sum(pii_boost.value(t, f) for t in trees[:n])
            out += 0 if held else a * math.log1p(math.exp(-z)) + b * math.log1p(math.exp(z))
        return out

    losses = [loss(n) for n in range(21)]
    assert all(a >= b for a, b in itertools.pairwise(losses)) and losses[20] < 0.7 * losses[0]


def test_calibration_is_monotone_and_pools():
    steps = pii_boost.calibrated([(0.1, 0, 4), (0.2, 3, 1), (0.3, 1, 3), (0.4, 4, 0), (0.4, 4, 0)])
    assert steps == [(0.1, 0.0), (0.2, 0.5), (0.4, 1.0)]


# Conversations


def repair_rows():
    r = random.Random(6)
    rows = []
    for c in [None, *range(250)]:
        turns = sorted(r.sample(range(14), r.randint(1, 7))) if c != 3 else range(400)
        for t in turns:
            rows.append((c, t if r.random() < 0.95 else None, r.choice(["user", "assistant", "system", "user", "assistant", None, "", "tool"]), r.choice(["Hi.", "No end", "", None, " \n", "Yes! ", "Éa?", f"t{r.randrange(99)}.", "A.b.c."])))
    rows += [(900, 1, "user", "Same."), (900, 1, "user", "Same."), (900, 2, "assistant", "Ok."), (901, None, None, None)] + [(902, 5, "user", "Again.")] * 6
    return rows


def damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(c, t, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, turns), by trying every edit: a search over (row, last role), forwards, all audits of the least cost kept."""
    fault = faults(rows)
    level = {"": [(0, "", ())]}

    def inserted(level):
        out = {k: list(v) for k, v in level.items()}
        for _ in range(2):
            for state, after in (("", "u"), ("s", "u"), ("u", "a"), ("a", "u")):
                for c, a, t in list(out.get(state, [])):
                    new = (c + 2, a + "I", (*t, ({"u": "user", "a": "assistant"}[after], "")))
                    if new not in out.setdefault(after, []):
                        out[after].append(new)
        return out

    def least(level):
        return {k: [x for x in v if x[0] == min(y[0] for y in v)] for k, v in level.items()}

    for (_, _, role, text), f in zip(rows, fault, strict=True):
        new = {}
        for state, ways in inserted(level).items():
            for c, a, t in ways:
                new.setdefault(state, []).append((c + 3, a + "D", t))
                if f in ("b", "d"):
                    continue
                allowed = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
                if role[:1] and role[:1] in allowed:
                    new.setdefault(role[:1], []).append((c + (f == "t"), a + "K", (*t, (role, text))))
                for to, name in (("u", "user"), ("a", "assistant")):
                    if to in allowed:
                        new.setdefault(to, []).append((c + 2 + (f == "t"), a + "R", (*t, (name, text))))
        level = least(new)
    ends = [x for k, v in inserted(level).items() if k in ("", "a") for x in v]
    return min(ends)


def repaired(rows):
    after = damage(rows)
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), sha(r[3])))
        if not own:
            out.append((conv, 0, 0, 0, 0, 0, 0, "", sha("")))
            continue
        f, turns = faults(own), [r[1] for r in own if r[1] is not None]
        cost, audit, turned = cheapest(own)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, f.count("b"), f.count("d"), f.count("t"), illegal, cost, audit, sha("\n".join(f"{a}:{b}" for a, b in turned))))
    return out


def repair_frame(spark, rows):
    return spark.createDataFrame([(c, t, r, x, "other", 4) for c, t, r, x in rows], "conv_id long, turn long, role string, text string, TURN string, copies int")


@pytest.mark.parametrize("bound", [None, -1])
def test_repair_against_all_edits(spark, monkeypatch, bound):
    if bound:
        monkeypatch.setattr(_frames, "BROADCAST_BYTES", bound)
    rows = [r for r in repair_rows() if r[0] != 3]
    d = conversation_repair.turns(repair_frame(spark, rows).repartition(3))
    got = conversation_repair.repair(conversation_repair.damaged(d), d, digest=True)
    assert as_set(got) == sorted(repaired(rows), key=str)


def test_repair_turns_are_what_the_digest_hashes(spark):
    rows = repair_rows()
    d = conversation_repair.turns(repair_frame(spark, rows).repartition(3))
    d = conversation_repair.damaged(d)
    digest = {r.conv_id: r for r in conversation_repair.repair(d, d, digest=True).collect()}
    turned = {}
    for r in conversation_repair.repair(d, d).collect():
        turned.setdefault(r.conv_id, []).append((r.place, r.role, r.text, r.edit))
    for c, r in digest.items():
        own = sorted(turned.get(c, []))
        assert [x[0] for x in own] == list(range(len(own)))
        assert sha("\n".join(f"{a}:{b}" for _, a, b, _ in own)) == r.repaired_sha256
        assert "".join(x[3] for x in own) == r.audit.replace("D", "")
        assert re.fullmatch("(s?(ua)+)?", "".join(x[1][:1] for x in own))


def test_repair_tables_compose():
    """Any cut of a conversation's rows gives the same cost and audit."""
    r = random.Random(9)
    for _ in range(60):
        rows = [(r.choice(["s", "u", "a", "t", ""]), r.choice([0, 0, 0, 1, 2, 3]), r.choice([1, 1, 3])) for _ in range(r.randint(1, 30))]
        whole = conversation_repair.between(rows, ["", "s", "u", "a"])
        cuts = sorted(r.sample(range(len(rows) + 1), min(3, len(rows))))
        parts = [rows[a:b] for a, b in itertools.pairwise([0, *cuts, len(rows)])]
        assert conversation_repair.balanced([conversation_repair.between(p, ["", "s", "u", "a"]) for p in parts]) == whole


def test_repair_cuts_conversations_between_tasks(spark, monkeypatch):
    """A conversation that several tasks hold gives what one task gives."""
    rows = [(1, t, ["user", "assistant", "user", "system"][t * t % 4], f"t{t % 300}{'.' if t % 5 else ''}") for t in range(3000)] + [(2, 1, "user", "Hi.")]
    d = conversation_repair.turns(repair_frame(spark, rows).repartition(6))
    one = as_set(conversation_repair.repair(d.coalesce(1), d, digest=True))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        alone = as_set(conversation_repair.repair(d, d, digest=True))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert one == alone and len(one) == 2


def test_repair_empty(spark):
    d = conversation_repair.turns(repair_frame(spark, []))
    assert conversation_repair.repair(d, d, digest=True).count() == 0 and conversation_repair.repair(d, d).count() == 0


# Merkle manifest


def tree(h):
    """The root of these leaves, and for each leaf (left, right) on each level."""
    ways, at, level = [[] for _ in h], list(range(len(h))), list(h)
    while len(level) > 1:
        for i in range(len(h)):
            a = at[i]
            run = level[a // 16 * 16 : a // 16 * 16 + 16]
            ways[i].append(("".join(run[: a % 16]), "".join(run[a % 16 + 1 :])))
            at[i] = a // 16
        level = [sha("".join(level[k : k + 16])) for k in range(0, len(level), 16)]
    return level[0], ways


def manifest(rows):
    low = lambda t: t and re.sub("[A-Z]", lambda m: m[0].lower(), t)
    leaf = lambda r: sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))
    by = {}
    for r in rows:
        changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        by.setdefault(r[1], []).append((r[0], leaf(r), leaf((*r[:4], low(r[4]))) if changed else None))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[1] for x in by[s]]) for s in names if not by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))}
    root, outer = tree([trees[s][0] for s in names]) if names else ("", [])
    out = []
    for s, above in zip(names, outer, strict=True):
        for (d, own, changed), inner in zip(by[s], trees[s][1], strict=True):
            f = changed or own
            for a, b in inner + above:
                f = sha(a + f + b)
            out.append((d, own, trees[s][0], root, sha("".join(a + b for a, b in inner + above)), f, f == root))
    return out


def manifest_rows(kind):
    r = random.Random(3)
    if kind == "awkward":
        sources = [None, "", "a", "b", "é", "big", "big", "big"] + [f"s{j}" for j in range(20)]
        rows = [(None if i % 50 == 0 else i // 2, r.choice(sources), r.choice(["en", None]), r.choice([None, 3]), r.choice([None, "", f"AbC {i}", "É" * 3000])) for i in range(700)]
        return rows + [(7, "a", "en", 3, "Same")] * 40
    if kind == "levels":  # one source has several buckets, so a level above buckets
        return [(i * 7, "big" if i % 10 else None, "en", i, f"T{i}") for i in range(9000)]
    return [(i, f"s{i}", "en", i, f"T{i}") for i in range(4200)] if kind == "sources" else [(1, "a", "x", 3, "Abc")]


@pytest.mark.parametrize("kind,bound", [("awkward", None), ("awkward", -1), ("levels", None), ("sources", None), ("one", None)])
def test_manifest(spark, monkeypatch, kind, bound):
    if bound:
        monkeypatch.setattr(_frames, "BROADCAST_BYTES", bound)
    rows = manifest_rows(kind)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, TEXT string, pos long").repartition(5)
    assert as_set(merkle_manifest.manifest(df)) == sorted(manifest(rows), key=str)


def test_manifest_blocks_are_whole_buckets(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(merkle_manifest, "BLOCK_ROWS", 10)
    r = random.Random(1)
    keys = [(s, b) for s in (None, "a", "b") for b in range(6) for _ in range(r.randint(1, 25))]
    cols = {"grp": pa.array([k[0] for k in keys], pa.string()), "bucket_no": pa.array([k[1] for k in keys]), "pos": pa.array(range(len(keys)))}
    given = [pa.RecordBatch.from_arrays([c.slice(i, 7) for c in cols.values()], list(cols)) for i in range(0, len(keys), 7)]
    blocks = [t.to_pylist() for t in merkle_manifest._blocks(iter(given))]
    assert [x["pos"] for t in blocks for x in t] == list(range(len(keys)))
    held = [{(x["grp"], x["bucket_no"]) for x in t} for t in blocks]
    assert len(blocks) > 5 and all(not a & b for a, b in itertools.combinations(held, 2))


def test_manifest_empty(spark):
    df = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle_manifest.manifest(df).count() == 0


def test_queries_equal_plain_versions(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op11_pii_boost(spark, SF).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    assert as_set(got) == sorted([(d, *[sum(s[1] == k for s in base(t)) for k in range(4)], sha(spelled(base(t)))) for d, t in rows], key=str)
