"""The opN queries: each operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import byte_bpe, class_lm, conversation_repair, decontaminate, jaccard_join, line_dedup, merkle_manifest, pii_boost, quality_fm, suffix_dedup, token_binary, token_trie, weak_rules
from tidewater.llm._frames import shared_dir, table

Query = Callable[[SparkSession, str], DataFrame]


def quality_machine(spark: SparkSession, df: DataFrame, sf_dir: str, meta: tuple[str, ...] = ("n_chars",)) -> quality_fm.Machine:
    """Trained on a sample of at most 6000 labelled rows, none of a held-out document."""
    admit = quality_fm.crc_fold(F.col("doc_id"), 3) != 1
    return quality_fm.train(df, table(spark, sf_dir, "labels"), admit=admit, sample=6000, meta=meta)


def op1_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    held = F.coalesce(quality_fm.crc_fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out")
    return quality_fm.score_documents(d, quality_machine(spark, d, sf_dir), meta=("n_chars",)).select("doc_id", held, "score", "predicted")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = jaccard_join.near_components(table(spark, sf_dir, "documents"), k=3, percent=90)
    return got.select("doc_id", "n_shingles", "component_id")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_trie.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Over 50 words are 250 bytes or more, but often fewer than 400: n_passage shows them, the contract's columns don't.
    return suffix_dedup.dedup_spans(table(spark, sf_dir, "documents"), length=400, digest=True, passage=250)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as p

    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN)


def op6_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = quality_fm.crc_fold(F.col("doc_id"), 7)
    got = class_lm.train_and_score(table(spark, sf_dir, "documents"), F.coalesce(fold != 2, F.lit(True)))
    return got.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = weak_rules.judged(table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = (~failed & (F.col("p_good") >= 0.5)).alias("kept")
    return j.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept, "p_good")


def op8_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = shared_dir(spark)
    manifest = token_binary.write_tokens(table(spark, sf_dir, "documents"), out, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_binary.read_tokens(manifest, out, digest=True)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1, drop="all")
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op11_pii_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_boost.digest(pii_boost.detect(table(spark, sf_dir, "documents")))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_repair.turns(table(spark, sf_dir, "conversations"))
    return conversation_repair.repair(conversation_repair.damaged(rows), rows, digest=True)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_quality_fm": op1_quality_fm,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_token_counts": op3_token_counts,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_class_lm": op6_class_lm,
    "op7_weak_rules": op7_weak_rules,
    "op8_spaced_seeds": op8_spaced_seeds,
    "op9_token_files": op9_token_files,
    "op10_line_dedup": op10_line_dedup,
    "op11_pii_boost": op11_pii_boost,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_merkle_manifest": op13_merkle_manifest,
}

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"



def _crc_sql(ascii_text: str) -> str:
    """crc32 by its definition, eight steps a byte, as a fold over characters."""
    step = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    byte = "xor(x, y)"
    for _ in range(8):
        byte = f"list_reduce([{byte}::UBIGINT, 0::UBIGINT], lambda x, z: {step})"
    chars = f"list_transform(string_split({ascii_text}, ''), lambda c: ascii(c)::UBIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::UBIGINT], {chars}), lambda x, y: {byte}), 4294967295)"


def _repair_sql() -> str:
    """Row by row: for each role of the last retained row (e: none) the least (cost, audit) and its turns."""
    add = lambda state, price, letters, more: f"{{'c': {state}.c + {price}, 'a': {state}.a || {letters}, 't': {state}.t || {more}}}"
    nothing = "{'c': 1000000000, 'a': '', 't': []::VARCHAR[]}"
    deleted = lambda state: add(state, 3, "'D'", "[]::VARCHAR[]")

    def retained(state: str, letter: str, name: str, inserted: str) -> str:
        own = f"(CASE WHEN i = '{letter}' THEN 0 ELSE 2 END) + (CASE WHEN fault = 3 THEN 1 ELSE 0 END)"
        row = f"[CASE WHEN i = '{letter}' THEN role ELSE '{name}' END || ':' || text]"
        k = 1 if inserted else 0
        return add(state, f"{2 * k} + {own}", f"'{'I' * k}' || CASE WHEN i = '{letter}' THEN 'K' ELSE 'R' END", f"['{inserted}:'] || {row}" if k else row)

    stay = lambda options: f"CASE WHEN fault IN (1, 2) THEN {options[0]} ELSE list_min([{', '.join(options)}]) END"
    s = f"CASE WHEN i = 's' AND fault IN (0, 3) THEN list_min([{deleted('s')}, {add('e', '(CASE WHEN fault = 3 THEN 1 ELSE 0 END)', chr(39) + 'K' + chr(39), '[role || chr(58) || text]')}]) ELSE {deleted('s')} END"
    u = stay([deleted("u"), *(retained(x, "u", "user", "") for x in "esa"), retained("u", "u", "user", "assistant")])
    a = stay([deleted("a"), retained("u", "a", "assistant", ""), *(retained(x, "a", "assistant", "user") for x in "esa")])
    code = _crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")
    ends = ", ".join(["e", add("s", 4, "'II'", "['user:', 'assistant:']"), add("u", 2, "'I'", "['assistant:']"), "a"])
    return f"""
        WITH RECURSIVE x AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {code} % 20 AS code FROM conversations),
        y AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
              CASE WHEN code = 1 THEN '' WHEN code = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS nth FROM x WHERE code <> 0),
        z AS (SELECT *, left(role, 1) AS i, rtrim(text, {_SPACES}) AS bare, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), nth) AS p FROM y),
        f AS (SELECT conv_id, turn, role, text, i, p, CASE WHEN bare = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 THEN 2
              WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, lag(i) OVER (PARTITION BY conv_id ORDER BY p) AS before FROM z),
        dp AS (SELECT DISTINCT conv_id, 0::BIGINT AS p, {{'c': 0, 'a': '', 't': []::VARCHAR[]}} AS e, {nothing} AS s, {nothing} AS u, {nothing} AS a FROM conversations
              UNION ALL SELECT dp.conv_id, f.p, {deleted("e")}, {s}, {u}, {a} FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.p = dp.p + 1),
        best AS (SELECT conv_id, arg_max(list_min([{ends}]), p) AS b FROM dp GROUP BY conv_id),
        n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
              count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
        SELECT best.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               b.c::BIGINT AS cost, b.a AS audit, sha256(array_to_string(b.t, chr(10))) AS repaired_sha256
        FROM best LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM best.conv_id
    """


def _merkle_sql(levels: int = 8, arity: int = 16) -> str:
    """Trees level by level: a group with one node left stays as it is. ``levels`` of 16 hold 2**32 leaves a source and as many sources."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    row = lambda text: " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text))
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    def tree(name: str, first: str) -> str:
        parts = [f"{name}0 AS ({first})"]
        for k in range(levels):
            parts.append(f"{name}w{k} AS (SELECT g, p, n, h, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {name}{k}) WINDOW w AS (PARTITION BY g, p // {arity} ORDER BY p))")
            parts.append(f"{name}{k + 1} AS (SELECT g, p // {arity} AS p, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY p)) ELSE any_value(h) END AS h FROM {name}w{k} GROUP BY g, p // {arity})")
        return ", ".join(parts)

    def climb(name: str, key: str, g: str, p: str, joined: str) -> tuple[str, list[tuple[str, str]]]:
        for k in range(levels):
            joined += f" JOIN {name}w{k} {key}{k} ON {key}{k}.g IS NOT DISTINCT FROM {g} AND {key}{k}.p = {p} // {arity**k}"
        return joined, [(f"{key}{k}", f"{key}{k}.n > 1") for k in range(levels)]

    joined, inner = climb("a", "i", "d.g", "d.p", "d JOIN s ON s.g IS NOT DISTINCT FROM d.g")
    joined, outer = climb("b", "o", "NULL", "s.p", joined)
    proof = [f"CASE WHEN {alive} THEN {k}.l || {k}.r ELSE '' END" for k, alive in inner + outer]
    steps = ", ".join(f"CASE WHEN {alive} THEN {{'l': {k}.l, 'r': {k}.r}} END AS {k}" for k, alive in inner + outer)
    got = f"SELECT d.doc_id, d.h AS leaf, s.h AS subroot, (SELECT h FROM b{levels}) AS root, sha256({' || '.join(proof)}) AS proof_sha256, coalesce(d.t, d.h) AS f, {steps} FROM {joined}"
    for k, _ in inner + outer:
        got = f"SELECT * REPLACE (CASE WHEN {k} IS NULL THEN f ELSE sha256({k}.l || f || {k}.r) END AS f) FROM ({got})"
    return f"""
        WITH x AS (SELECT doc_id, source AS g, sha256({row("text")}) AS h, CASE WHEN {_crc_sql("doc_id::VARCHAR")} % 5 = 0 THEN sha256({row("text").replace("text", low)}) END AS t FROM documents),
        d AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS p FROM x),
        {tree("a", "SELECT g, p, h FROM d")},
        s AS (SELECT g, h, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS p FROM a{levels}),
        {tree("b", "SELECT NULL::VARCHAR AS g, p, h FROM s")}
        SELECT doc_id, leaf, subroot, root, proof_sha256, f AS folded_root, f = root AS verified FROM ({got})
    """


ORACLE_SQL: dict[str, str] = {
    "op2_jaccard_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS shingle FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 90 * (a.n + b.n - i)),
        e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT e.y, r FROM reach JOIN e ON reach.doc_id = e.x AND e.y > r)
        SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
    """,
    "op8_spaced_seeds": f"""
        WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark), d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        iw AS (SELECT item_id, len(w) AS n, least(len(w), 20) AS k, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM i),
        dw AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
        g AS (SELECT doc_id, item_id, n, k, dw.pos - iw.pos AS diagonal, list(iw.pos) AS spots FROM dw JOIN iw USING (word) GROUP BY ALL HAVING count(*) * 100 >= 80 * k),
        b AS (SELECT doc_id, item_id, k, list_max(list_transform(range(1, n - k + 2), lambda s: len(list_filter(spots, lambda p: p >= s AND p < s + k)))) AS best FROM g)
        SELECT doc_id, item_id, max(best / k) AS similarity, count(*) AS n_places FROM b WHERE best * 100 >= 80 * k GROUP BY 1, 2
    """,
    "op10_line_dedup": f"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
        k AS (SELECT *, translate(trim(line, {_SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
        FROM k LEFT JOIN f ON k.key = f.key GROUP BY doc_id
    """,
    "op12_conversation_repair": _repair_sql(),
    "op13_merkle_manifest": _merkle_sql(),
}
