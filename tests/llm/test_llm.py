"""Each operator against its plain version on awkward rows, and on the smallest tables."""

import functools
import os
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from tidewater.llm import _frames, _graph, _induced, byte_bpe, class_lm, decontaminate, jaccard_join, line_dedup, quality_fm, suffix_dedup, token_binary, token_trie, weak_rules  # noqa: E402
from tidewater.llm import _bytes as B  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "extra string, doc_id long, text string, TEXT string, score double, node long, h long"


def sentence(r, n):
    return " ".join(r.choice(["the", "of", "And", "ürun", "x.", "tion", "réé", "in"]) + r.choice(["", "a", "b", "cc", "d"]) for _ in range(n))


def awkward():
    """(doc_id, text) rows: nulls, empties, ties, repeated rows, copies, near copies, one long text."""
    r = random.Random(7)
    base = sentence(r, 120)
    w = base.split(" ")
    rows = [(None, None), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "ONE  two\n"), (7, base), (7, base), (None, base), (8, base.upper()), (9, base + " more")]
    for i in range(10, 22):
        c = list(w)
        c[r.randrange(len(c))] = f"new{i % 4}"
        rows.append((i, " ".join(c) + ("\nShared Line \n" if i % 2 else "\n  shared line") + f"\nown {i}"))
    rows += [(40 + i, "shared line\n\n" + sentence(r, 3)) for i in range(6)]
    long_ = "\n".join(sentence(r, 30) for _ in range(400))
    rows += [(60, long_), (61, "y" * 3000), (62, "y" * 450 + "z"), (63, long_[5000:6000] + sentence(r, 50)), (64, "the of the of the of the of the of"), (65, "a\x1cb\x0bc é🎉 <|endoftext|> \x01 İΣ")]
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame([("e", d, t, "other", 1.5, 3, 4) for d, t in rows], SCHEMA).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def as_rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80), (1, 50), (2, 100)])
def test_near_components(spark, rows, k, percent):
    got = jaccard_join.near_components(frame(spark, rows), k, percent)
    assert as_rows(got, "doc_id", "n_shingles", "component_id") == sorted(brute.near(rows, k, percent), key=str)


def test_near_components_in_sub_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 150)
    got = jaccard_join.near_components(frame(spark, rows), 3, 80)
    assert as_rows(got, "doc_id", "n_shingles", "component_id") == sorted(brute.near(rows, 3, 80), key=str)


def test_sides_too_large_to_broadcast(spark, rows, monkeypatch):
    monkeypatch.setattr(_frames, "BROADCAST_BYTES", -1)
    got = jaccard_join.near_components(frame(spark, rows), 3, 90)
    assert as_rows(got, "doc_id", "n_shingles", "component_id") == sorted(brute.near(rows, 3, 90), key=str)
    got = suffix_dedup.dedup_spans(frame(spark, rows), 60, digest=True)
    assert as_rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.repeats(rows, 60), key=str)
    got = line_dedup.dedup_lines(frame(spark, rows), min_docs=10)
    assert as_rows(got, "doc_id", "n_lines", "n_dropped", "text") == sorted(brute.drop_lines(rows), key=str)


def test_texts_that_stay_do_not_move(spark, monkeypatch):
    """left_anti beyond the broadcast bound: whatever else the sieve picks is told apart by keys; copies of a dropped text under other ids stay."""
    monkeypatch.setattr(_frames, "BROADCAST_BYTES", 200)
    monkeypatch.setattr(_frames, "SIEVE", 64)
    own = spark.createDataFrame([(i if i else None, f"text {i % 40}") for i in range(100)], "doc_id long, text string").withColumn("th", F.xxhash64("text"))
    own = _frames.stored(own)
    few = _frames.stored(own.filter("doc_id is null or doc_id <= 90").select(F.col("doc_id").alias("b_id"), F.col("th").alias("b_th")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = _frames.meet_few(own, few, "left_anti")
        assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
        assert as_rows(got, "doc_id", "text") == sorted(((i, f"text {i % 40}") for i in range(91, 100)), key=str)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_copies_emit_their_parts_once(spark):
    """Forty copies of each text in forty tasks: next to one row of each goes on to the shuffle of parts."""
    r = random.Random(3)
    base = sentence(r, 60)
    texts = [f"{base} more{i % 2} {sentence(r, 2)}" for i in range(5)]
    rows = [(10 * c + i, t) for c in range(40) for i, t in enumerate(texts)]
    d = _frames.docs(frame(spark, rows, 40)).withColumn("th", F.xxhash64("text"))
    own = _frames.stored(jaccard_join.shingled(d, 3))
    classes = own.groupBy("node").agg(F.min("doc_id").alias("rep_id"), F.min("th").alias("rep_th"))
    assert jaccard_join._fewer(d, own, classes).count() == 5
    got = jaccard_join.near_components(frame(spark, rows), 3, 80)
    assert as_rows(got, "doc_id", "n_shingles", "component_id") == sorted(brute.near(rows, 3, 80), key=str)


def test_parts_and_sets_come_in_goes(spark, rows, monkeypatch):
    goes = []
    monkeypatch.setattr(jaccard_join, "stored", lambda df, real=jaccard_join.stored: goes.append(df.columns) or real(df))
    monkeypatch.setattr(jaccard_join, "PART_BYTES", 0)
    monkeypatch.setattr(jaccard_join, "SET_BYTES", 0)
    got = jaccard_join.near_components(frame(spark, rows), 3, 90)
    assert as_rows(got, "doc_id", "n_shingles", "component_id") == sorted(brute.near(rows, 3, 90), key=str)
    assert goes.count(["grp", "node"]) == len(jaccard_join.GOES)


def test_lots_have_each_part_once():
    rng = np.random.default_rng(5)
    sizes = [0, 1, 2, 7, 40, 300, 301]
    first = np.concatenate(([0], np.cumsum(sizes)))
    val = rng.integers(0, 2**63, first[-1]).astype(np.uint64)
    pairs = lambda lots: [(int(a), int(b)) for who, sig in jaccard_join.part_hashes(first, val, jaccard_join.Parts(80), lots) for a, b in zip(who, sig)]
    dealt = [p for lots in jaccard_join.GOES for p in pairs(lots)]
    assert sorted(dealt) == sorted(pairs(range(jaccard_join.LOTS))) and len(set(dealt)) == len(dealt)


def test_near_components_empty(spark):
    assert jaccard_join.near_components(empty(spark)).count() == 0


def batches_of(cols, names, size=50):
    n = len(cols[0])
    return [jaccard_join.pa.RecordBatch.from_arrays([c[i : i + size] for c in cols], names) for i in range(0, n, size)]


@pytest.mark.parametrize("n", [2, 49, 50, 51, 99, 130, 260])
def test_shared_parts_stream(monkeypatch, n):
    """Groups cut by batches stay whole, a large one leaves in pieces under one name, repeated rows count once, equal groups leave once."""
    monkeypatch.setattr(jaccard_join, "LARGE", 100)
    sig = np.r_[[1], [3, 3, 3], [7] * n, [8] * n, [9]]
    node = np.r_[[5], [1, 1, 2], np.arange(n), np.arange(n), [4]] + 10
    got: dict = {}
    for b in jaccard_join._shared(iter(batches_of((sig, node), ["sig", "node"]))):
        for r in b.to_pylist():
            got.setdefault(r["grp"], []).append(r["node"])
    groups = sorted(sorted(x) for x in got.values())
    family = list(range(10, 10 + n))
    assert groups == sorted([[11, 12], family] if n <= 51 else [[11, 12], family, family] if n > 100 else [[11, 12], family])


def test_groups_split_only_where_nothing_links():
    r = random.Random(8)
    for trial in range(30):
        percent, sets = r.choice([70, 80, 90]), []
        for _ in range(r.choice([10, 200])):
            s = set(r.choice(sets)) if sets and r.random() < 0.6 else {r.randrange(5000) for _ in range(r.randint(20, 60))}
            for _ in range(r.randint(0, 6)):
                s.add(r.randrange(5000))
            sets.append(s)
        first = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
        val = B.mix(np.array([x + 1 for s in sets for x in sorted(s)], np.uint64))
        edges = jaccard_join.split_group([len(s) for s in sets], jaccard_join.bitmaps(first, val), percent)
        assert len(edges) < len(sets)
        up = list(range(len(sets)))
        for a, b in edges:
            a, b = _root(up, a), _root(up, b)
            up[max(a, b)] = min(a, b)
        for i in range(len(sets)):
            for j in range(i):
                if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                    assert _root(up, i) == _root(up, j)


def family(r, n, drift):
    """Near copies of near copies: texts of which only some link with others."""
    rows, texts = [], [sentence(r, 60).split(" ") for _ in range(3)]
    for i in range(n):
        w = list(r.choice(texts[-12:] if drift else texts[:3]))
        for _ in range(r.randint(1, 4)):
            w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
        texts.append(w)
        rows.append((1000 + i, " ".join(w)))
    return rows


@pytest.mark.parametrize("drift,block", [(True, 150), (False, 2000), (True, 200_000)])
def test_large_families_in_sub_blocks(spark, monkeypatch, drift, block):
    """Leaders and clusters of several sub-blocks lose no link, with hundreds of different near copies and of null ids."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "MEET", 10 * block)
    rows = family(random.Random(block + drift), 500, drift)
    rows += [(None, t) for _, t in rows[:200]] + [(None, rows[0][1])] * 100
    got = jaccard_join.near_components(frame(spark, rows), 2, 80)
    assert as_rows(got, "doc_id", "n_shingles", "component_id") == sorted(brute.near(rows, 2, 80), key=str)


def test_clusters_meet_without_leaders_that_link():
    """Two parts whose only link is between followers."""
    base = list(range(100))
    far = lambda k, at: base[: 100 - k] + [1000 * at + i for i in range(k)]
    one, two = [base, far(8, 1)], [far(8, 1)[:84] + [5000 + i for i in range(16)], far(8, 1)[:92] + [7000 + i for i in range(8)]]
    sets = [np.sort(B.mix(np.array(x, np.uint64) + np.uint64(1))) for x in (*one, *two)]
    percent = 80
    links, lead, dist = jaccard_join.cluster(sets[:2], percent)
    assert links and lead == [0, 0]
    hit = jaccard_join.first_link(sets[:2], sets[2:], percent)
    assert hit is not None
    found, open_ = jaccard_join.meet([sets[0], sets[2]], [dist[1], 0.0], [0, 2], [0, 1], percent)
    linked = 100 * jaccard_join._common(sets[0], sets[2]) >= percent * (len(sets[0]) + len(sets[2]) - jaccard_join._common(sets[0], sets[2]))
    assert bool(found) == linked and bool(open_) != linked


def test_random_sets_lose_no_link():
    r = random.Random(3)
    for percent in (50, 70, 80, 90):
        sets = []
        for _ in range(60):
            if sets and r.random() < 0.7:
                s = set(r.choice(sets))
                for _ in range(r.randint(0, 4)):
                    s.discard(r.choice(sorted(s))) if len(s) > 1 and r.random() < 0.5 else s.add(r.randrange(200))
            else:
                s = {r.randrange(200) for _ in range(r.randint(1, 40))}
            sets.append(frozenset(s))
        sets = sorted(set(sets), key=sorted)
        first = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
        val = B.mix(np.array([x + 1 for s in sets for x in sorted(s)], np.uint64))
        want = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])}

        def roots(edges):
            up = list(range(len(sets)))
            for a, b in edges:
                a, b = _root(up, a), _root(up, b)
                up[max(a, b)] = min(a, b)
            return [_root(up, i) for i in range(len(sets))]

        assert roots(jaccard_join.link_block(first, val, percent)) == roots(want)
        # Every linked pair shares a part hash.
        sig = [set() for _ in sets]
        for who, s in jaccard_join.part_hashes(first, val, jaccard_join.Parts(percent)):
            for w, x in zip(who.tolist(), s.tolist()):
                sig[w].add(x)
        assert all(sig[i] & sig[j] for i, j in want)


def _root(up, x):
    while up[x] != x:
        x = up[x]
    return x


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5), (None, 4)], "a long, b long")
    assert as_rows(_graph.components(e), "node", "root") == sorted([(x, 1) for x in (1, 2, 3, 7, 8, 9)] + [(20, 20), (21, 20)], key=str)


@pytest.mark.parametrize("length", [40, 400])
def test_suffix_dedup(spark, rows, length):
    got = suffix_dedup.dedup_spans(frame(spark, rows), length, digest=True)
    assert as_rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.repeats(rows, length), key=str)


@pytest.mark.parametrize("bound", [1 << 20, -1])
def test_suffix_dedup_with_passages(spark, rows, monkeypatch, bound):
    monkeypatch.setattr(_frames, "BROADCAST_BYTES", bound)
    rows = rows + [(80, "left one " + "p q r s t u v w x y z " * 2 + "right one"), (81, "x y " + "p q r s t u v w x y z " * 2 + "other"), (80, "same id, nothing else")]
    got = suffix_dedup.dedup_spans(frame(spark, rows), 100, digest=True, passage=40)
    assert as_rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.repeats(rows, 100), key=str)
    assert as_rows(got, "doc_id", "n_bytes", "n_passage") == sorted([(d, n, lost) for d, n, lost, _, _ in brute.repeats(rows, 40)], key=str)
    assert suffix_dedup.dedup_spans(empty(spark), passage=40).count() == 0


def test_suffix_dedup_seeks_in_stretches_alone(spark, monkeypatch):
    """Copies inside different texts, cut in the middle of a character and twice in one text, end with their stretches: nothing is left to be sorted for the longer strings."""
    r = random.Random(4)
    text = lambda n: "".join(r.choice("abcdefghij éß") for _ in range(n))
    same, twice, short = text(230), text(150), text(60)
    rows = [(i, f"{text(90)}{'éè'[i % 2]}{same}{'ßà'[i % 2]}{text(80)}{short}{text(40)}") for i in range(6)]
    rows += [(7, twice + text(70) + twice + text(30) + same + text(9) + twice), (7, twice + text(70) + same), (None, text(20) + twice), (8, text(500)), (9, None)]
    rows += rows[:1] + [(10, rows[0][1])]
    sorts, plain = [], suffix_dedup.repeated_spans
    monkeypatch.setattr(suffix_dedup, "repeated_spans", lambda df, length: sorts.append((length, df.agg(F.sum(F.octet_length("text"))).first()[0])) or plain(df, length))
    got = suffix_dedup.dedup_spans(frame(spark, rows), 100, digest=True, passage=40)
    assert as_rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.repeats(rows, 100), key=str)
    assert as_rows(got, "doc_id", "n_bytes", "n_passage") == sorted([(d, n, lost) for d, n, lost, _, _ in brute.repeats(rows, 40)], key=str)
    (_, every), (length, sought) = sorts
    assert length == 100 and sought < 0.75 * every


def test_suffix_dedup_cuts_long_texts_and_hot_groups(spark, rows, monkeypatch):
    for name, v in (("STARTS", 700), ("SHARD_BYTES", 2000)):
        monkeypatch.setattr(suffix_dedup, name, v)
    got = suffix_dedup.dedup_spans(frame(spark, rows, 2), 60, digest=True)
    assert as_rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.repeats(rows, 60), key=str)
    assert suffix_dedup.dedup_spans(empty(spark)).count() == 0


def test_induced_sorting():
    r = random.Random(5)
    for _ in range(300):
        n, alpha = r.choice([2, 3, 5, 8, 20]), r.choice([b"a", b"ab", b"abc", bytes(range(256))])
        base = bytes(r.choice(alpha) for _ in range(r.randint(4, 60)))
        texts = [base[r.randrange(len(base)) :] + bytes(r.choice(alpha) for _ in range(r.randint(0, 9))) for _ in range(r.randint(1, 5))]
        seen, want, at = {}, set(), 0
        for x in texts:
            for i in range(len(x) - n + 1):
                seen.setdefault(x[i : i + n], []).append(at + i)
            at += len(x) + 1
        for p in seen.values():
            want |= set(p) if len(p) > 1 else set()
        got = _induced.repeated([np.frombuffer(x, np.uint8) for x in texts], n, memory=r.choice([1, 1 << 20]))
        assert set(got.tolist()) == want


def test_queues_of_an_ordinary_shard_go_to_disk(monkeypatch):
    """A shard of the size that tasks sort, with the default queues: they spill, and every repeated string is found."""
    rng = np.random.default_rng(3)
    spilled, real = [], _induced.Queue._spill
    monkeypatch.setattr(_induced.Queue, "_spill", lambda self: (spilled.append(self.held), real(self)) and None)
    base = rng.integers(97, 123, suffix_dedup.SHARD_BYTES // 2, dtype=np.uint8)
    copy = np.concatenate((rng.integers(97, 123, 1000, dtype=np.uint8), base[5000:250_000], rng.integers(97, 123, 200_000, dtype=np.uint8)))
    got = _induced.repeated([base, copy], 400)
    starts = np.arange(5000, 250_000 - 399)
    assert np.array_equal(got, np.concatenate((starts, len(base) + 1 + 1000 + np.arange(len(starts)))))
    assert len(spilled) > 1 and max(spilled) > _induced.QUEUE_BYTES


def tiktoken_ids():
    import tiktoken

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_byte_bpe(spark, rows):
    enc, args = tiktoken_ids(), (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    want = [(d, len(x := enc(t or "")), brute.sha(" ".join(map(str, x))), brute.sha(t or "")) for d, t in rows]
    assert as_rows(byte_bpe.round_trip(frame(spark, rows), *args), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)
    coded = byte_bpe.encode(frame(spark, rows), *args, with_offsets=True)
    for r in coded.collect():
        assert len(r.ids) == len(r.offsets) and all(a.start <= a.end for a in r.offsets)
    assert as_rows(byte_bpe.decode(coded, *args), "doc_id", "text") == sorted([(d, t or "") for d, t in rows], key=str)
    assert byte_bpe.encode(empty(spark), *args).count() == 0


def test_byte_bpe_split_characters():
    b = byte_bpe.tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = b.encode("a🎉b")
    assert b.decode(ids) == "a🎉b" and b.decode(ids[:2]).startswith("a�")
    assert b.offsets(ids)[0] == (0, 1) and b.offsets(ids)[-1] == (2, 3)
    r = random.Random(2)
    enc = tiktoken_ids()
    pool = [chr(i) for i in range(0x2100)] + list(" \n\t\r\x1c\x85\xa0　'st" * 40)
    for _ in range(500):
        s = "".join(r.choice(pool) for _ in range(30))
        assert b.encode(s) == enc(s)


def test_token_files(spark, rows, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = rows + [(70, "a <|endoftext|> b"), (71, "x<|startoftext|>y <|EndOfText|>"), (72, "<|endoftext|>"), (73, "a <| b |> <|endof text|> <"), (74, "|>plain"), (75, "<"), (76, "|endoftext|>")]
    ids = {t: tok.encode(t or "", add_special_tokens=False).ids + [1] for _, t in rows}
    m = token_binary.write_tokens(frame(spark, rows), f"file://{tmp_path}/o", path, end_id=1)
    got = token_binary.read_tokens(m, f"file://{tmp_path}/o").orderBy("start").collect()
    keys = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert keys == sorted(keys)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(d), ids[t]) for d, t in rows)
    crcs = token_binary.read_tokens(m, f"file://{tmp_path}/o", digest=True)
    assert sorted((str(r.doc_id), r.ids_crc32) for r in crcs.collect()) == sorted((str(d), brute.crc(ids[t])) for d, t in rows)
    m = token_binary.write_tokens(empty(spark), f"{tmp_path}/e", path, end_id=1)
    assert token_binary.read_tokens(m, f"{tmp_path}/e").count() == 0


def test_token_counts(spark, rows):
    path = public_tokenizers.path("piece_bpe_32k.model")
    score = token_trie.scores(path)
    longest = max(map(len, score))

    @functools.lru_cache(None)
    def count(word):
        s = token_trie.MARK + word
        best = [(0.0, 0)]
        for e in range(1, len(s) + 1):
            raw = len(s[e - 1].encode())
            options = [(best[e - 1][0] + raw * token_trie.BYTE_SCORE, best[e - 1][1] + raw)]
            options += [(best[b][0] + score[s[b:e]], best[b][1] + 1) for b in range(max(0, e - longest), e) if s[b:e] in score]
            best.append(min(options, key=lambda x: (-x[0], x[1])))
        return best[-1][1]

    own = rows
    split = token_trie.find_words
    want = [(d, len(w := split(t or "")), len(set(w)), sum(map(count, w))) for d, t in own]
    assert as_rows(token_trie.token_counts(frame(spark, own), path), "doc_id", "n_pretokens", "n_distinct", "n_tokens") == sorted(want, key=str)
    small = token_trie.Trie(score, stored=3)
    assert [small.counts({w})[w] for w in ("the", "then", "th", "over", "the")] == [count(w) for w in ("the", "then", "th", "over", "the")]
    assert token_trie.token_counts(empty(spark), path).count() == 0


def test_class_lm(spark, rows):
    fold = quality_fm.crc_fold(F.col("doc_id"), 7)
    got = class_lm.train_and_score(frame(spark, rows), F.coalesce(fold != 2, F.lit(True)))
    want = brute.unigrams(rows, lambda d: brute.fold(d, 7) == 2)
    mine = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got.collect()), key=lambda r: (str(r[0]), r[1], r[4]))
    want = sorted(((d, n, k, t, b) for d, _, n, k, t, b in want), key=lambda r: (str(r[0]), r[1], r[4]))
    assert [m[:4] for m in mine] == [w[:4] for w in want] and [m[4] for m in mine] == pytest.approx([w[4] for w in want])
    assert class_lm.train_and_score(empty(spark), F.lit(True)).count() == 0
    none = class_lm.train_and_score(frame(spark, rows), F.lit(False)).collect()
    assert len(none) == len(rows) and all(r.n_known == 0 and r.train_tokens == 0 and r.score < 0 for r in none)


def lm_tokens(t):
    raw = np.frombuffer((t or "").encode(), np.uint8)
    return class_lm.tokens(raw, np.array([0, len(raw)]))[1].view(np.int64).tolist()


@pytest.mark.parametrize("head", [1 << 20, -1])
def test_class_lm_scores_by_definition(spark, rows, monkeypatch, head):
    """The score from counts made here and the model's classes; a vocabulary too large for tasks gives the same model."""
    monkeypatch.setattr(class_lm, "HEAD", head)
    monkeypatch.setattr(class_lm, "LEADERS", 5)
    train = [r for r in rows if r[0] not in (8, 9)]
    model = class_lm.fit(class_lm.docs(frame(spark, train)))
    assert model.whole == (head > 0)
    group = {r.h: r.g for r in model.words.collect()}
    end = int(class_lm.END.view(np.int64))
    seen, table, size = {}, {}, {}
    of = lambda h: class_lm.STOP if h == end else group.get(h, class_lm.RARE)
    for _, t in train:
        last = end
        for h in lm_tokens(t):
            seen[h] = seen.get(h, 0) + 1
            table[of(last), of(h)] = table.get((of(last), of(h)), 0) + 1
            last = h
    assert {h for h, n in seen.items() if n >= class_lm.MIN_COUNT and h != end} == {h for h, g in group.items() if g < class_lm.RARE}
    assert all(group[h] == class_lm.RARE for h, n in seen.items() if n < class_lm.MIN_COUNT)
    n, k = class_lm.CLASSES, sum(seen.values())
    for h, c in seen.items():
        size.setdefault(of(h), []).append(c)
    total = lambda g: sum(size.get(g, []))
    after = [sum(c for (a, _), c in table.items() if a == g) for g in range(n)]

    def score(t):
        out, last = 0.0, end
        for h in lm_tokens(t):
            a, g = of(last), of(h)
            out += np.log10((table.get((a, g), 0) + n * (total(g) + 1) / (k + n)) / (after[a] + n))
            out += np.log10((seen.get(h, 0) + 1) / max(1, total(g) + len(size.get(g, [])) + (g == class_lm.RARE)))
            last = h
        return out

    got = class_lm.score(class_lm.docs(frame(spark, rows)), model).collect()
    assert sorted(r.score for r in got) == pytest.approx(sorted(score(t) for _, t in rows))
    assert all(r.perplexity >= 1 for r in got)
    # Over classes, transitions sum to 1.
    low = np.array([np.log10(max(1, total(g) + len(size.get(g, [])) + (g == class_lm.RARE))) for g in range(n)])
    assert (10 ** (model.step + low[None, :])).sum(1) == pytest.approx(np.ones(n))
    words = sorted((r.h, r.g) for r in model.words.collect())
    monkeypatch.setattr(class_lm, "HEAD", -head)
    assert words == sorted((r.h, r.g) for r in class_lm.fit(class_lm.docs(frame(spark, train, 2))).words.collect())


def test_class_lm_words_of_large_tables_stay_in_tasks():
    """Three million words are looked up in tasks; a word takes some 14 bytes there, not tens."""
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 64, 3_000_000, dtype=np.uint64))
    table = class_lm.Table(keys, (np.arange(len(keys)) % class_lm.MOVING).astype(np.int8))
    assert len(keys) <= class_lm.HEAD < 1 << 24
    asked = np.concatenate((keys[::7], keys[::7] + np.uint64(1), np.array([0, (1 << 64) - 1], np.uint64)))
    want = np.searchsorted(keys, asked)
    want = np.where((want < len(keys)) & (keys[np.minimum(want, len(keys) - 1)] == asked), want, -1)
    at, g = table.find(asked)
    assert (at == want).all() and (g == np.where(want >= 0, want % class_lm.MOVING, class_lm.RARE)).all()
    assert sum(x.nbytes for x in vars(table).values() if isinstance(x, np.ndarray)) < 16 * len(keys)
    none = class_lm.Table(keys[:0], np.zeros(0, np.int8))
    assert none.find(np.array([5, class_lm.END], np.uint64))[1].tolist() == [class_lm.RARE, class_lm.STOP]


def test_class_lm_ranges_and_packs_change_nothing(spark, rows, monkeypatch):
    train = class_lm.docs(frame(spark, rows))
    want = sorted((r.h, r.n, r.g) for r in class_lm.fit(train).words.collect())
    monkeypatch.setattr(class_lm, "PACKED", 5)
    monkeypatch.setattr(class_lm, "RANGE", 20)
    assert sorted((r.h, r.n, r.g) for r in class_lm.fit(train).words.collect()) == want


def test_exchange_raises_likelihood(monkeypatch):
    rng = np.random.default_rng(1)
    m = np.zeros((14, 14))
    for _ in range(3000):  # words 0-5 are followed by 6-11 and the other way round
        a = rng.integers(0, 12)
        m[a, (6 + rng.integers(0, 6)) if a < 6 else rng.integers(0, 6)] += 1
    m[:, 13] += 1
    g = class_lm.exchange(m, 4)
    assert len(set(g[:6])) == 1 and len(set(g[6:12])) == 1 and g[0] != g[6] and g[12] == 2 and g[13] == 3
    # A sweep over counts finds the class of a word that is in the wrong one, and of one that has none.
    monkeypatch.setattr(class_lm, "CLASSES", 4)
    monkeypatch.setattr(class_lm, "MOVING", 2)
    for easy in (8, 10_000):
        monkeypatch.setattr(class_lm, "EASY", easy)
        for own in (1 - g[0], 2):
            now = g.copy()
            now[0] = own
            one = np.eye(4)[now]
            x = np.concatenate((m[0] @ one, m[:, 0] @ one)).astype(np.int64)
            k = np.flatnonzero(x)
            assert class_lm.Gains(one.T @ m @ one).best(np.zeros(len(k), np.int64), k, x[k], np.array([own])).tolist() == [g[0]]


def test_clustering_settles_near_a_plain_exchange(spark, monkeypatch):
    """The likelihood rises from sweep to sweep until it has settled; the classes are as good as those of a plain exchange of all words one by one."""
    monkeypatch.setattr(class_lm, "LEADERS", 70)
    r = random.Random(11)
    kinds = [[f"w{k}x{j}" for j in range(12)] for k in range(8)]
    follow = [[r.random() ** 4 for _ in range(8)] for _ in range(8)]
    texts = []
    for _ in range(300):
        k, words = r.randrange(8), []
        for _ in range(30):
            words.append(r.choice(kinds[k]))
            k = r.choices(range(8), follow[k])[0]
        texts.append(" ".join(words))
    values = []
    monkeypatch.setattr(class_lm, "likelihood", lambda n, f=class_lm.likelihood: values.append(f(n)) or values[-1])
    train = class_lm.docs(frame(spark, list(enumerate(texts))))
    model = class_lm.fit(train)
    held = [values[1]]  # after sweeps that weren't undone
    held += [v for i, v in enumerate(values[2:]) if v >= max(values[1 : i + 2])]
    assert len(held) >= 2
    # The plain version.
    end = int(class_lm.END.view(np.int64))
    names = sorted({h for t in texts for h in lm_tokens(t)} - {end})
    at = {h: i for i, h in enumerate(names)} | {end: len(names) + 1}
    m = np.zeros((len(names) + 2, len(names) + 2))
    for t in texts:
        last = end
        for h in lm_tokens(t):
            m[at[last], at[h]] += 1
            last = h
    group = {x.h: x.g for x in model.words.collect()}


    def worth(g):
        one = np.eye(class_lm.CLASSES)[g]
        n = one.T @ m @ one
        return float(class_lm.xlogx(n).sum() - class_lm.xlogx(n.sum(0)).sum() - class_lm.xlogx(n.sum(1)).sum())

    mine = worth([*(group[h] for h in names), class_lm.RARE, class_lm.STOP])
    plain = worth(class_lm.exchange(m, class_lm.CLASSES))
    alone = worth([*(0 for _ in names), class_lm.RARE, class_lm.STOP])
    assert mine == pytest.approx(held[-1]) and mine - alone > 0.9 * (plain - alone)


def test_weak_rules(spark, rows):
    got = weak_rules.judged(frame(spark, rows))
    want = sorted([(d, *brute.measures(t)) for d, t in rows], key=str)
    assert as_rows(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == want
    assert got.filter("p_good < 0 or p_good > 1 or p_good is null").count() == 0
    assert weak_rules.judged(empty(spark)).count() == 0


def test_em_finds_accuracies():
    r = random.Random(4)
    counts = {}
    for _ in range(5000):
        good = r.random() < 0.85
        v = tuple((-1 if r.random() < 0.3 else int(good) if r.random() < 0.95 else int(not good)) for _ in range(5))
        counts[v] = counts.get(v, 0) + 1
    share, table = weak_rules.fit(sorted(counts.items()))
    assert share == pytest.approx(0.85, abs=0.03) and all(t[1][2] > t[1][1] and t[0][1] > t[0][2] for t in table)
    assert weak_rules.posterior((1,) * 5, share, table) > 0.99 > 0.05 > weak_rules.posterior((0,) * 5, share, table)


@pytest.mark.parametrize("bound", [1_000_000, -1])
def test_decontaminate(spark, monkeypatch, bound):
    monkeypatch.setattr(_frames, "BROADCAST_BYTES", bound)
    r = random.Random(9)
    item = [f"w{r.randrange(30)}" for _ in range(30)]
    other = [f"v{i}" for i in range(16)]
    items = [(0, " ".join(item)), (1, " ".join(other)), (2, None), (3, ""), (4, "tiny one"), (5, "a b c d e"), (None, "n0 n1 n2 n3 n4 n5 n6 n7 n8")]
    docs = [(1, "x " * 40 + " ".join(item) + " y" * 10), (2, None), (3, ""), (4, "so TINY one"), (5, "a b q d e"), (6, " ".join(other[:10])), (7, "n0 n1 n2 n3 n4 n5 n6 n7 n8"), (7, "n0 n1 n2 n3 n4 n5 n6 n7 n8"), (None, " ".join(item))]
    for i in range(20):
        c = list(item)
        for p in r.sample(range(30), r.randint(1, 8)):
            c[p] = "zz"
        docs.append((100 + i, "pre " * (i % 3) + " ".join(c)))
    b = spark.createDataFrame([(t, i, "x") for i, t in items], "text string, item_id long, doc_id string")
    got = {(x.doc_id, x.item_id): x.similarity for x in decontaminate.find_leaks(frame(spark, docs), b).collect()}
    want = brute.leaks(docs, items)
    assert (set(got) - set(want), set(want) - set(got)) == (set(), set())
    assert got == pytest.approx(want)
    assert decontaminate.find_leaks(empty(spark), b).count() == 0 and decontaminate.find_leaks(frame(spark, docs), b.limit(0)).count() == 0


def test_masks_meet_every_window():
    """Any 20 places of which at most 4 differ have a seed without a difference."""
    from itertools import combinations

    for gone in combinations(range(20), 4):
        left = ["0" if i in gone else "1" for i in range(20)]
        assert any(all(m[k] == "0" or left[s + k] == "1" for k in range(len(m))) for m in decontaminate.MASKS for s in range(20 - len(m) + 1)), gone


def test_masks_meet_every_length():
    """Any n places of which at least 80 % are left have a seed, by the masks and those added for n."""
    from itertools import combinations

    for n in range(1, 21):
        masks = [*decontaminate.MASKS, *decontaminate.own_masks(n, 80)]
        assert all(m[0] == m[-1] == "1" for m in masks)
        for gone in combinations(range(n), n * 20 // 100):
            left = ["0" if i in gone else "1" for i in range(n)]
            assert any(all(m[k] == "0" or left[s + k] == "1" for k in range(len(m))) for m in masks for s in range(n - len(m) + 1)), (n, gone)


@pytest.mark.parametrize("bound, lengths", [(1_000_000, (6, 7, 10, 11, 12, 15)), (0, (6, 7, 10, 11, 12, 15)), (1_000_000, (1, 3, 5))])
def test_decontaminate_short_items(spark, monkeypatch, bound, lengths):
    """Items shorter than the window with all places lost that the masks alone miss, and at a document's ends."""
    from itertools import combinations

    monkeypatch.setattr(_frames, "BROADCAST_BYTES", bound)
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in lengths]
    docs = []
    for n, t in items:
        for gone in combinations(range(n), n // 5) if n < 15 else [(5, 7, 9), (0, 1, 2), (2, 7, 14)]:
            w = ["zz" if k in gone else x for k, x in enumerate(t.split())]
            docs += [(len(docs), "so " + " ".join(w) + " on"), (len(docs) + 1, " ".join(w[min(set(range(n)) - set(gone)):]))]
        docs.append((len(docs), "so " + " ".join("zz" if k < n // 5 + 1 else x for k, x in enumerate(t.split()))))
    b = spark.createDataFrame([(t, i) for i, t in items], "text string, item_id long")
    got = {(x.doc_id, x.item_id): x.similarity for x in decontaminate.find_leaks(frame(spark, docs), b).collect()}
    want = brute.leaks(docs, items)
    assert (set(got) - set(want), set(want) - set(got)) == (set(), set())
    assert got == pytest.approx(want)


def test_line_dedup(spark, rows):
    got = line_dedup.dedup_lines(frame(spark, rows), min_docs=10)
    assert as_rows(got, "doc_id", "n_lines", "n_dropped", "text") == sorted(brute.drop_lines(rows), key=str)
    assert line_dedup.dedup_lines(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        line_dedup.keep_bitmaps(line_dedup.docs(frame(spark, rows)), drop="some")


def test_line_dedup_keeps_first(spark):
    docs = [(3, "a\nb\nb"), (1, "x\n B \nc"), (2, "c\na")]
    got = line_dedup.dedup_lines(frame(spark, docs), min_docs=2, drop="later")
    assert as_rows(got, "doc_id", "text") == [(1, "x\n B \nc"), (2, "a"), (3, "")]
    runs = {r.doc_id: r.keep_runs for r in got.collect()}
    assert runs == {1: None, 2: [0, 1], 3: [0, 3]}


def test_quality(spark):
    r = random.Random(1)
    docs = [(i, sentence(r, 60) if i % 4 else " ".join(w.upper() + "!!" for w in sentence(r, 60).split())) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(300)] + [(5, 0, 0), (5, 1, 1), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    df = frame(spark, docs + [(900, None), (None, ""), (901, "x" * 100_000)])
    m = quality_fm.train(df, labels, sample=200)
    got = {x.doc_id: x for x in quality_fm.score_documents(df, m).collect()}
    assert len(got) == 403 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got.values())
    assert sum(got[i].predicted == int(i % 4 > 0) for i in range(300, 400)) >= 97
    none = quality_fm.train(df, labels.limit(0))
    assert quality_fm.score_documents(df, none).filter("score = 0.5").count() == 403
    assert quality_fm.score_documents(empty(spark), m).count() == 0


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    m = quality_fm.Machine(0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    idx, val = np.array([1, 4, 7, 2]), rng.normal(size=4)
    pairs = sum((m.v[idx[a]] @ m.v[idx[b]]) * val[a] * val[b] for a in range(4) for b in range(a))
    assert m.raw(np.array([0, 4]), idx, val)[0] == pytest.approx(0.3 + m.w[idx] @ val + pairs)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_against_plain_version(spark):
    import corpus_pipeline as p
    from tidewater.llm._frames import stored, table

    docs = stored(table(spark, SF, "documents"))
    kept = stored(p.quality(spark, docs, SF))
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    lined = brute.drop_lines(rows)
    lines = stored(p.lines(spark, kept, SF))
    assert lines.columns == docs.columns
    assert as_rows(lines, "doc_id", "text") == sorted([(d, t) for d, _, _, t in lined], key=str)
    groups = brute.near([(d, t) for d, _, _, t in lined], 5, 80)
    rows = [(d, t) for (d, _, _, t), (_, _, c) in zip(lined, groups) if d == c]
    near = stored(p.near_copies(spark, lines, SF))
    assert as_rows(near, "doc_id", "text") == sorted(rows, key=str)
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    bad = {d for d, _ in brute.leaks(rows, items)}
    rows = [(d, t) for d, t in rows if d not in bad]
    clean = stored(p.leaks(spark, near, SF))
    assert as_rows(clean, "doc_id", "text") == sorted(rows, key=str)
    enc = tiktoken_ids()
    want = sorted([(d, len(x := enc(t)), brute.sha(" ".join(map(str, x))), brute.sha(t)) for d, t in rows], key=str)
    assert as_rows(p.tokens(spark, clean, SF), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert as_rows(p.run(spark, SF), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_quality_query_and_its_folds(spark):
    """Held-out labels change nothing; the fold, the score's range and the decision; accuracy on documents that it didn't see."""
    from tidewater.llm import queries
    from tidewater.llm._frames import stored, table

    sf = SF.replace("0.001", "0.01")
    got = queries.op1_quality_fm(spark, sf).collect()
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert all(r.held_out == (brute.fold(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    unseen = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in unseen) / len(unseen) > 0.9
    admit = quality_fm.crc_fold(F.col("doc_id"), 3) != 1
    held = quality_fm.crc_fold(F.col("doc_id"), 3) == 1
    flipped = stored(labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality"))))
    twice = docs.unionByName(docs)
    one, two = (quality_fm.train(d, y, admit, 300, ("n_chars",)) for d, y in ((docs, labels), (twice, flipped)))
    assert one.w0 == two.w0 and (one.w == two.w).all() and (one.v == two.v).all()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_rules_query(spark):
    from tidewater.llm import queries
    from tidewater.llm._frames import table

    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    got = queries.op7_weak_rules(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        m = brute.measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m
        assert r.base_failed == (m[0] < 50 or 100 * m[4] > 50 * m[0]) and r.kept == (not r.base_failed and r.p_good >= 0.5)
    assert 0 < sum(r.kept for r in got) < len(got)


CLASHES = ["th", "keep_runs", "b_id", "b_th", "TEXT", "DOC_ID", "id", "body", "s_bits", "c0", "score", "chars", "root", "n_chars_"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("bound", [1 << 20, -1])
def test_stages_decide_by_row(spark, rows, monkeypatch, bound):
    """Each stage with clashing extra columns, repeated and null ids, repeated rows, empty texts and an empty table."""
    import corpus_pipeline as p
    from tidewater.llm._frames import stored, table

    monkeypatch.setattr(_frames, "BROADCAST_BYTES", bound)
    item = table(spark, SF, "benchmark").filter("length(text) > 100").orderBy("item_id").first().text
    rows = [r for r in rows if r[0] not in (60, 61)] + [(None, "fine words " + item), (500, "fine words " + item), (500, "clean words, nothing else to see here"), (8, "other text under an id that has a copy")]
    docs = spark.createDataFrame([(d, t, len(t or ""), *range(len(CLASHES))) for d, t in rows], "doc_id long, text string, n_chars long, " + ", ".join(f"{c} int" for c in CLASHES)).repartition(3)
    key = lambda df: sorted(((r[0], r[1]) for r in df.collect()), key=str)
    for _, stage in p.STAGES[:-1]:
        got = stored(stage(spark, docs, SF))
        assert got.columns == docs.columns and got.dtypes == docs.dtypes
        assert stored(stage(spark, docs.limit(0), SF)).count() == 0
        if stage is p.lines:
            assert key(got) == sorted([(d, t or None) if t == "" and (d, "") not in rows else (d, t) for d, _, _, t in brute.drop_lines(rows)], key=str)
        elif stage is p.leaks:
            assert key(got) == sorted([r for r in rows if item not in (r[1] or "")], key=str)
        elif stage is p.near_copies:
            numbered = [(i, t) for i, (_, t) in enumerate(rows)]
            group = [c for _, _, c in brute.near(numbered, 5, 80)]
            best: dict = {}
            for i, (d, t) in enumerate(rows):
                if brute.shingles(t, 5):
                    best[group[i]] = min(best.get(group[i], (True, 1 << 62)), (d is None, d or 0))
            mine = key(got)
            assert sorted(((d is None, d or 0) for d, t in mine if brute.shingles(t, 5))) == sorted(best.values())
            assert [r for r in mine if not brute.shingles(r[1], 5)] == sorted([r for r in rows if not brute.shingles(r[1], 5)], key=str)
    assert p.tokens(spark, docs, SF).count() == len(rows) and p.tokens(spark, docs.limit(0), SF).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_queries_have_all_rows_and_equal_sql(spark):
    import oracle

    from tidewater.llm import queries

    duck = oracle.connect(SF)
    n = duck.execute("select count(*) from documents").fetchone()[0]
    for name, f in queries.QUERIES.items():
        if name in queries.ORACLE_SQL:
            assert oracle.differences(spark, SF, f, queries.ORACLE_SQL[name], duck) is None
        elif not name.startswith("op8"):
            assert f(spark, SF).count() == n, name
