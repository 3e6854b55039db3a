"""Named queries over the driver's tables, with the SQL that each must equal.

Word lists are parameters: these queries use a small Latin lexicon, since the tables hold no Han text. Strategies stand in for
event types, order priorities and embedding labels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import lexicon as lx
from tidewater.functions import math as mx
from tidewater.functions import text as tx
from tidewater.operators import analysis, density, game, network, observe, screening, strategy, temporal, terms, vectors
from tidewater.plans.storage import shared_path, stored
from tidewater.sources import readers, writers
from tidewater.sources.readers import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


LEX = lx.Lexicon.of({"核心词": ["the", "and", "in"], "产品词": ["token", "license", "the"], "反减肥词": ["mit", "apache", "license"]})
EXCLUDED = ["password", "xx"]
REMOVED = ["the end", "the", "of", "and"]
POSITIVE, NEGATIVE = ["the", "thing", "ver", "mente", "tion"], ["not", "worth", "idiot", "nicht", "sh"]
STOP = ["the", "of", "and", "die", "der", "les", "que"]
BEHAVIOUR = {
    "complex": ["tion", "ver", "mente"], "simple": ["the", "le"], "long_term": ["ing", "keit"], "short_term": ["er", "ou", "as"], "product": ["token", "license", "mit", "an"],
    "scientific": ["ver", "eau", "dad"], "unscientific": ["ion", "ich"], "positive": ["sh", "os"], "negative": ["nd", "ch"], "social": ["qu", "on"], "data": ["st", "re"], "guidance": ["ble", "ung"],
}
POLARITY = {"purchase": 1.0, "signup": 0.5, "click": 0.2, "view": 0.0, "error": -1.0}
PRIORITY = {"1-URGENT": 1.0, "2-HIGH": 0.5, "3-MEDIUM": 0.2, "4-NOT SPECIFIED": 0.0, "5-LOW": -1.0}

# SQL that several queries share.
WS = r"[\t-\r\x{1c}-\x{1f}\x{85}\p{Z}]"
_N = r"[^\t-\r\x{1c}-\x{1f}\x{85}\p{Z}]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_sum(words, text="t", one="1"):
    return "(" + " + ".join(f"(CASE WHEN contains({text}, {q(w)}) THEN {one} ELSE 0 END)" for w in words) + ")"


def sql_remove(c: str, words=REMOVED) -> str:
    out = f"coalesce({c}, '')"
    for w in sorted(words, key=len, reverse=True):
        out = f"replace({out}, {q(w)}, ' ')"
    return f"trim(regexp_replace({out}, '{WS}+', ' ', 'g'), ' ')"


def sql_clean(c: str) -> str:
    out = f"coalesce({c}, '')"
    for p in (rf"http[s]?://{_N}+", rf"@{_N}+", rf"#{_N}+#", r"\[[^\n]*?\]", r"<[^\n]*?>", r"""[^\x{4e00}-\x{9fa5}a-zA-Z0-9,。!?;:"\t-\r\x{1c}-\x{1f}\x{85}\p{Z}]"""):
        out = f"regexp_replace({out}, {q(p)}, '', 'g')"
    return f"regexp_replace({out}, '^{WS}+|{WS}+$', '', 'g')"


def sql_case(c: str, mapping: dict) -> str:
    return "CASE " + " ".join(f"WHEN {c} = {q(k)} THEN {v}" for k, v in mapping.items()) + " END"


SQL_FACTOR = "CASE WHEN length(t) < 20 THEN 1.1 WHEN length(t) < 50 THEN 1.05 WHEN length(t) < 200 THEN 1.0 WHEN length(t) < 500 THEN 0.9 ELSE 0.7 END"
SQL_WEIGHTS = "(" + " + ".join(f"(CASE WHEN contains(lower(t), {q(k)}) THEN {w} ELSE 0 END)" for k, w in zip(LEX.keywords, LEX.weights)) + ")"
SQL_OUT = "(" + " OR ".join(f"contains(lower(t), {q(w)})" for w in EXCLUDED) + ")"
SQL_CORE = sql_sum([k for k, w in zip(LEX.keywords, LEX.weights) if w >= 2.5], "lower(t)")
SQL_CONTRARY = sql_sum(LEX.contrary, "lower(t)")
SQL_DOCS = f"SELECT *, {sql_remove('text')} AS t FROM documents"
SQL_RELATED = f"""SELECT doc_id, CASE WHEN {SQL_OUT} THEN 0.0 ELSE {SQL_WEIGHTS} * ({SQL_FACTOR}) END AS score,
    CASE WHEN {SQL_OUT} THEN 0 ELSE {SQL_CORE} END AS n_core, CASE WHEN {SQL_OUT} THEN 0 ELSE {SQL_CONTRARY} END AS n_contrary FROM ({SQL_DOCS})"""
SQL_TOKENS = "SELECT doc_id, lang, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+')) AS word FROM documents"
SQL_WORDS = f"SELECT doc_id, lang, word FROM ({SQL_TOKENS}) WHERE length(word) >= 2 AND word NOT IN ({', '.join(map(q, STOP))})"
SQL_EVENTS = f"SELECT strftime(ts, '%Y-%m-%d') AS time_window, event_type AS meta_strategy, {sql_case('event_type', POLARITY)} AS sentiment FROM events"
SQL_ORDERS = f"SELECT strftime(o_orderdate, '%Y-%m') AS time_window, o_orderpriority AS meta_strategy, {sql_case('o_orderpriority', PRIORITY)} AS sentiment FROM orders"


def sql_obs(rows: str, least: int) -> str:
    return f"""SELECT time_window, meta_strategy, count(*) AS n, avg(sentiment) AS sentiment, count(*) / sum(count(*)) OVER (PARTITION BY time_window) AS popularity
        FROM ({rows}) WHERE time_window IN (SELECT time_window FROM ({rows}) GROUP BY 1 HAVING count(*) >= {least}) GROUP BY 1, 2"""


def sql_sim(obs: str) -> str:
    """WITH RECURSIVE ... game(time_window, meta_strategy, initial, final)."""
    return f"""WITH RECURSIVE obs AS ({obs}),
    init AS (SELECT time_window, list(meta_strategy ORDER BY meta_strategy) AS names, list(n / t ORDER BY meta_strategy) AS x0, list(0.45 * sentiment - 0.3 ORDER BY meta_strategy) AS b
        FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY time_window) AS DOUBLE) AS t FROM obs WHERE n > 0) GROUP BY 1),
    sim AS (
        SELECT time_window, 0 AS it, x0 AS x, b, false AS done FROM init
        UNION ALL
        SELECT time_window, it + 1, CASE WHEN d < 1e-4 THEN x ELSE xn END, b, d < 1e-4 FROM (
        SELECT *, sqrt(list_sum(list_transform(list_zip(xn, x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS d FROM (
        SELECT *, list_transform(raw, lambda v: v / list_sum(raw)) AS xn FROM (
        SELECT *, list_transform(list_zip(x, u), lambda p: greatest(0.0, p[1] + 0.01 * p[1] * (p[2] - av))) AS raw FROM (
        SELECT *, list_sum(list_transform(list_zip(x, u), lambda p: p[1] * p[2])) AS av FROM (
        SELECT *, list_transform(list_zip(x, b), lambda p: 0.45 * p[1] + p[2]) AS u FROM sim WHERE NOT done AND it < 1000)))))),
    ends AS (SELECT time_window, arg_max(x, it) AS x FROM sim GROUP BY 1),
    game AS (SELECT time_window, unnest(names) AS meta_strategy, unnest(x0) AS initial, unnest(ends.x) AS final FROM init JOIN ends USING (time_window)),
    eq AS (SELECT time_window, arg_max(meta_strategy, final) AS dominant_strategy, max(final) AS dominant_ratio, -sum(CASE WHEN final > 0 THEN final * ln(final) ELSE 0 END) AS diversity, count(*) AS k FROM game GROUP BY 1),
    typed AS (SELECT *, CASE WHEN dominant_ratio > 0.8 THEN '主导均衡' WHEN diversity > 0.8 THEN '混合均衡' ELSE '部分主导' END AS equilibrium_type FROM eq)"""


def documents(spark, d):
    return read_table(spark, d, "documents")


def r6(c):
    return F.round(c, 6)


# Text


@query(f"SELECT doc_id, {sql_clean('text')} AS text_clean FROM documents WHERE length({sql_clean('text')}) >= 5")
def clean_text(spark, d):
    return temporal.drop_short(documents(spark, d).select("doc_id", tx.clean_text(F.col("text")).alias("text_clean")), "text_clean")


@query(f"SELECT page_id, {sql_clean('html')} AS text_clean FROM pages")
def clean_html(spark, d):
    return read_table(spark, d, "pages").select("page_id", tx.clean_text(F.col("html")).alias("text_clean"))


@query(f"SELECT doc_id, {sql_remove('text')} AS t FROM documents")
def remove_words(spark, d):
    return documents(spark, d).select("doc_id", tx.remove_words(F.col("text"), REMOVED).alias("t"))


@query(f"SELECT doc_id, CAST({SQL_FACTOR} AS DOUBLE) AS factor FROM (SELECT doc_id, text AS t FROM documents)")
def length_factor(spark, d):
    return documents(spark, d).select("doc_id", tx.length_factor(F.col("text")).cast("double").alias("factor"))


@query(f"SELECT doc_id, round(score, 6) AS score FROM ({SQL_RELATED})")
def keyword_score(spark, d):
    return documents(spark, d).select("doc_id", r6(tx.keyword_score(F.col("text"), LEX, EXCLUDED, REMOVED)).alias("score"))


@query(f"""SELECT doc_id, array_to_string(list_filter([{', '.join(f"CASE WHEN contains(lower(t), {q(k)}) THEN {q(f'{k}({w})')} END" for k, w in zip(LEX.keywords, LEX.weights))}], lambda x: x IS NOT NULL), '; ') AS matches FROM ({SQL_DOCS})""")
def keyword_matches(spark, d):
    clean = tx.remove_words(F.col("text"), REMOVED)
    return documents(spark, d).select("doc_id", tx.render_matches(tx.keyword_matches(clean, LEX)).alias("matches"))


def _related(spark, d):
    return screening.with_relevance(documents(spark, d), ["text"], LEX, min_score=3.5, excluded=EXCLUDED, removed=REMOVED)


@query(f"SELECT doc_id, round(score, 6) AS score FROM ({SQL_RELATED}) WHERE (score >= 3.5 AND n_core >= 1) OR n_contrary >= 2")
def relevance_filter(spark, d):
    return screening.split_related(_related(spark, d))[0].select("doc_id", r6(F.col("relevance_score")).alias("score"))


@query(f"SELECT (score >= 3.5 AND n_core >= 1) OR n_contrary >= 2 AS is_related, count(*) AS n FROM ({SQL_RELATED}) GROUP BY 1")
def relevance_split_counts(spark, d):
    yes, no = screening.split_related(_related(spark, d))
    return yes.unionByName(no).groupBy("is_related").agg(F.count("*").alias("n"))


SQL_REASON = r"""CASE WHEN t = '' THEN 'empty' WHEN length(t) < 15 THEN 'short'
    WHEN coalesce(list_bool_or(list_transform(range(1, length(t) - 4), lambda i: t[i] <> chr(10) AND t[i:i+5] = repeat(t[i], 6))), false) THEN 'repeated'
    WHEN len(regexp_extract_all(t, 'http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*(),\\]|(?:%[0-9a-fA-F][0-9a-fA-F]))+')) > 3 THEN 'links'
    WHEN length(t) - length(regexp_replace(t, '[^\p{L}\p{M}\p{N}_\t-\r\x{1c}-\x{1f}\x{85}\p{Z}\x{4e00}-\x{9fff}]', '', 'g')) > 0.4 * length(t) THEN 'special' ELSE 'ok' END"""


@query(f"SELECT reason, count(*) AS n FROM (SELECT {SQL_REASON} AS reason FROM ({SQL_DOCS})) GROUP BY 1")
def quality_reason_counts(spark, d):
    return documents(spark, d).select(tx.quality_reason(F.col("text"), REMOVED).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"SELECT page_id, {SQL_REASON} AS reason FROM (SELECT page_id, {sql_remove('html', [])} AS t FROM pages)")
def quality_reasons_html(spark, d):
    return read_table(spark, d, "pages").select("page_id", tx.quality_reason(F.col("html"), []).alias("reason"))


@query(f"SELECT doc_id FROM ({SQL_DOCS}) WHERE {SQL_REASON} = 'ok'")
def quality_filter(spark, d):
    return documents(spark, d).filter(tx.quality_reason(F.col("text"), REMOVED) == "ok").select("doc_id")


SQL_P, SQL_G = sql_sum(POSITIVE), sql_sum(NEGATIVE)


@query(f"""SELECT doc_id, round(({SQL_P} - {SQL_G}) / greatest(1, {SQL_P} + {SQL_G}), 6) AS sentiment, round(least(1.0, ({SQL_P} + {SQL_G}) / greatest(1.0, CAST(length(t) AS DOUBLE) / 100)), 6) AS arousal
    FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)""")
def sentiment_arousal(spark, d):
    return documents(spark, d).select("doc_id", r6(tx.sentiment(F.col("text"), POSITIVE, NEGATIVE)).alias("sentiment"), r6(tx.arousal(F.col("text"), POSITIVE, NEGATIVE)).alias("arousal"))


@query(f"SELECT doc_id, trim(regexp_replace(text, '{WS}+', ' ', 'g'), ' ') AS line FROM documents WHERE length(trim(regexp_replace(text, '{WS}+', ' ', 'g'), ' ')) >= 20")
def corpus_lines(spark, d):
    return documents(spark, d).select("doc_id", tx.squeeze(F.col("text")).alias("line")).filter(F.char_length("line") >= 20)


@query(f"SELECT doc_id, {sql_remove('text')} AS text, {sql_remove('lang')} AS lang, {sql_remove('source')} AS source, n_chars FROM documents")
def clean_all_columns(spark, d):
    """Every text column without the removed words, the others as they are."""
    return screening.clean_columns(documents(spark, d).select("doc_id", "text", "lang", "source", "n_chars"), REMOVED)


# Trained vectors

SQL_PLACED = "SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: length(x) >= 2) AS w FROM documents)"


@query(f"""WITH t AS ({SQL_PLACED}), v AS (SELECT word FROM t GROUP BY 1 HAVING count(*) >= 5 ORDER BY count(*) DESC, word LIMIT 150), k AS (SELECT t.* FROM t JOIN v USING (word)),
    p AS (SELECT x.word AS word, y.word AS beside, count(*) AS n FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.i <> y.i AND abs(x.i - y.i) <= 2 GROUP BY 1, 2),
    s AS (SELECT word, sum(n) AS n FROM p GROUP BY 1)
    SELECT p.word, beside, p.n, round(ln(p.n * (SELECT sum(n) FROM p)::DOUBLE / (a.n::DOUBLE * b.n)), 6) AS information FROM p JOIN s a ON a.word = p.word JOIN s b ON b.word = beside WHERE p.n * (SELECT sum(n) FROM p)::DOUBLE > a.n::DOUBLE * b.n""")
def pair_information(spark, d):
    """Positive pointwise information of pairs of frequent words, what trained vectors are made of."""
    docs = documents(spark, d)
    words = [r["word"] for r in vectors.vocabulary(docs, "text", 5, 150).orderBy("place").collect()]  # 150 rows
    pairs = vectors.pair_counts(docs, "text", words, 2)
    name = lambda c: F.element_at(F.lit(words), F.col(c) + 1)
    met = vectors.information(pairs).join(pairs, ["a", "b"])
    return met.select(name("a").alias("word"), name("b").alias("beside"), "n", r6(F.col("x")).alias("information"))


# Deduplication and sources

SQL_PRINT = f"trim(regexp_replace(lower(text), '{WS}+', ' ', 'g'), ' ')"


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role NULLS FIRST, text NULLS FIRST) AS r FROM conversations WHERE conv_id IS NOT NULL) WHERE r = 1")
def dedup_id(spark, d):
    t = read_table(spark, d, "conversations")
    return screening.dedup_id(t.filter("conv_id is not null"), "conv_id", [F.desc("turn"), F.asc("role"), F.asc("text")]).select("conv_id", "turn", "role", "text")


SQL_POSTS = "SELECT doc_id, text, lang, source, ts, user_id, event_type, value FROM documents JOIN events ON doc_id = event_id"


def _posts(spark, d):
    e = read_table(spark, d, "events")
    return documents(spark, d).join(e, F.col("doc_id") == F.col("event_id")).select("doc_id", "text", "lang", "source", "ts", "user_id", "event_type", "value")


@query(f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY {SQL_PRINT} ORDER BY value DESC NULLS LAST, doc_id) AS r FROM ({SQL_POSTS})) WHERE r = 1")
def dedup_fingerprint(spark, d):
    return screening.dedup_content(_posts(spark, d), "text", "value", "doc_id").select("doc_id")


@query(f"SELECT count(*) AS n_rows, count(*) - count(DISTINCT {SQL_PRINT}) AS n_removed FROM documents WHERE text IS NOT NULL")
def dedup_counts(spark, d):
    t = documents(spark, d).filter("text is not null").select(tx.fingerprint(F.col("text")).alias("p"))
    per = t.groupBy("p").agg(F.count("*").alias("k"))
    return per.agg(F.sum("k").alias("n_rows"), F.sum(F.col("k") - 1).alias("n_removed"))


@query("SELECT doc_id AS id, text, lang, NULL AS role FROM documents UNION ALL SELECT conv_id, text, NULL, role FROM conversations")
def union_sources(spark, d):
    a = documents(spark, d).select(F.col("doc_id").alias("id"), "text", "lang")
    b = read_table(spark, d, "conversations").select(F.col("conv_id").alias("id"), "text", "role")
    return screening.union_sources([a, b])


@query(f"SELECT doc_id FROM ({SQL_RELATED}) WHERE NOT ((score >= 3.5 AND n_core >= 1) OR n_contrary >= 2) ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 1000")
def sample_unrelated(spark, d):
    return screening.sample(screening.split_related(_related(spark, d))[1], "doc_id", 1000).select("doc_id")


# Terms


@query("SELECT keyword, count(*) AS n FROM (SELECT unnest([" + ", ".join(f"CASE WHEN contains(lower(t), {q(k)}) THEN {q(k)} END" for k in LEX.keywords) + f"]) AS keyword FROM ({SQL_DOCS})) WHERE keyword IS NOT NULL GROUP BY 1 ORDER BY n DESC, keyword LIMIT 20")
def keyword_frequency_topk(spark, d):
    return screening.top(screening.keyword_counts(documents(spark, d), ["text"], LEX, REMOVED), "n", "keyword", 20)


@query(f"SELECT word, count(*) AS freq FROM ({SQL_WORDS}) GROUP BY 1 ORDER BY freq DESC, word LIMIT 50")
def term_topk(spark, d):
    return screening.top(terms.term_counts(documents(spark, d), "text", STOP), "freq", "word", 50)


@query(f"""WITH w AS ({SQL_WORDS}), tf AS (SELECT lang, word, count(*) AS tf FROM w GROUP BY 1, 2), f AS (SELECT word, sum(tf) AS f FROM tf GROUP BY 1), a AS (SELECT sum(tf) / count(DISTINCT lang) AS a FROM tf),
    s AS (SELECT lang, word, tf, tf * ln(1 + a / f) AS weight FROM tf JOIN f USING (word), a)
    SELECT lang, word, tf, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(weight, 9) DESC, word) AS r FROM s) WHERE r <= 10""")
def ctfidf_top_terms(spark, d):
    return terms.class_terms(documents(spark, d), "lang", "text", STOP, 10).select("lang", "word", "tf", r6(F.col("weight")).alias("weight"))


@query(f"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 2 AND x NOT IN ({', '.join(map(q, STOP))})) AS w FROM documents),
    g AS (SELECT doc_id, unnest(w) AS term FROM t UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM t)
    SELECT term, count(*) AS freq, count(DISTINCT doc_id) AS df FROM g GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3 ORDER BY freq DESC, term LIMIT 2000""")
def ngram_vocabulary(spark, d):
    return terms.ngram_vocabulary(documents(spark, d), "text", 2000, 3, 2, STOP)


# Time


@query("SELECT user_id, event_id FROM events WHERE user_id IS NULL OR user_id NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL GROUP BY 1 HAVING count(*) > 75)")
def bot_filter(spark, d):
    return temporal.drop_bots(read_table(spark, d, "events"), "user_id", 75).select("user_id", "event_id")


def _windows(spark, d, name, time_col, unit, least=1):
    return temporal.with_windows(read_table(spark, d, name), time_col, unit, least)


@query("SELECT strftime(o_orderdate, '%Y-%m') AS time_window, count(*) AS n FROM orders GROUP BY 1")
def windows_month(spark, d):
    return temporal.window_counts(_windows(spark, d, "orders", "o_orderdate", "M"))


@query("SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') || '/' || strftime(date_trunc('week', ts) + INTERVAL 6 DAY, '%Y-%m-%d') AS time_window, count(*) AS n FROM events GROUP BY 1")
def windows_week(spark, d):
    return temporal.window_counts(_windows(spark, d, "events", "ts", "W"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS time_window, count(*) AS n FROM events GROUP BY 1")
def windows_day(spark, d):
    return temporal.window_counts(_windows(spark, d, "events", "ts", "D"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS time_window FROM orders WHERE strftime(o_orderdate, '%Y-%m') IN (SELECT strftime(o_orderdate, '%Y-%m') FROM orders GROUP BY 1 HAVING count(*) >= 100)")
def window_having(spark, d):
    return _windows(spark, d, "orders", "o_orderdate", "M", 100).select("o_orderkey", "time_window")


@query("SELECT count(*) AS n_rows, count(try_cast(lang AS TIMESTAMP)) AS n_from_text, count(ts) AS n_times, count(*) FILTER (WHERE ts IS NOT NULL) AS n_kept FROM (SELECT d.lang, e.ts FROM documents d LEFT JOIN events e ON doc_id = event_id)")
def parse_dates_coerce(spark, d):
    e = read_table(spark, d, "events").select("event_id", F.col("ts").cast("string").alias("ts"))
    t = documents(spark, d).join(e, F.col("doc_id") == F.col("event_id"), "left")
    return t.agg(F.count("*").alias("n_rows"), F.count(mx.to_time(F.col("lang"))).alias("n_from_text"), F.count(mx.to_time(F.col("ts"))).alias("n_times"), F.sum(mx.to_time(F.col("ts")).isNotNull().cast("long")).alias("n_kept"))


# Observations


@query("SELECT doc_id, coalesce(CAST(quality AS VARCHAR), 'MS_Outlier') AS meta_strategy, coalesce(CASE WHEN quality = 1 THEN 'good' END, '异常') AS meta_strategy_name FROM documents LEFT JOIN (SELECT doc_id, any_value(quality) AS quality FROM labels GROUP BY 1) USING (doc_id)")
def strategy_map_join(spark, d):
    labels = read_table(spark, d, "labels").groupBy("doc_id").agg(F.first("quality").cast("string").alias("meta_strategy"))
    names = spark.createDataFrame([("1", "good")], "meta_strategy string, meta_strategy_name string")
    got = observe.map_strategies(documents(spark, d).select("doc_id"), labels, "doc_id")
    return observe.map_strategies(got, names, "meta_strategy", "meta_strategy_name", "异常").select("doc_id", "meta_strategy", "meta_strategy_name")


def _polar(c, mapping):
    out = F.lit(None).cast("double")
    for k, v in mapping.items():
        out = F.when(F.col(c) == k, v).otherwise(out)
    return out


def _event_obs(spark, d, least=1):
    rows = _windows(spark, d, "events", "ts", "D", least).select("time_window", F.col("event_type").alias("meta_strategy"), _polar("event_type", POLARITY).alias("sentiment"))
    return observe.observations(rows)


def _order_obs(spark, d, least=1):
    rows = _windows(spark, d, "orders", "o_orderdate", "M", least).select("time_window", F.col("o_orderpriority").alias("meta_strategy"), _polar("o_orderpriority", PRIORITY).alias("sentiment"))
    return observe.observations(rows)


@query(f"SELECT time_window, meta_strategy, n, round(sentiment, 6) AS sentiment, round(popularity, 6) AS popularity FROM ({sql_obs(SQL_EVENTS, 100)})")
def obs_long(spark, d):
    return _event_obs(spark, d, 100).select("time_window", "meta_strategy", "n", r6(F.col("sentiment")).alias("sentiment"), r6(F.col("popularity")).alias("popularity"))


@query(f"SELECT time_window, meta_strategy, round(popularity, 6) AS popularity FROM ({sql_obs(SQL_ORDERS, 1)})")
def popularity(spark, d):
    return _order_obs(spark, d).select("time_window", "meta_strategy", r6(F.col("popularity")).alias("popularity"))


EVENT_TYPES = list(POLARITY)


def _sql_pivot(value: str, rows: str) -> str:
    cells = ", ".join(f"coalesce(max(CASE WHEN meta_strategy = {q(s)} THEN {value} END), 0) AS {s}" for s in EVENT_TYPES)
    return f"SELECT time_window, {cells} FROM ({rows}) GROUP BY 1"


@query(_sql_pivot("n", sql_obs(SQL_EVENTS, 1)))
def obs_count_pivot(spark, d):
    return observe.matrix(_event_obs(spark, d), "n", EVENT_TYPES)


SQL_FELT = f"SELECT strftime(ts, '%Y-%m-%d') AS time_window, event_type AS meta_strategy, (({SQL_P}) - ({SQL_G})) / greatest(1, {SQL_P} + {SQL_G}) AS sentiment, least(1.0, ({SQL_P} + {SQL_G}) / greatest(1.0, CAST(length(t) AS DOUBLE) / 100)) AS arousal FROM (SELECT *, lower(coalesce(text, '')) AS t FROM ({SQL_POSTS}))"


def _felt(spark, d):
    p = _posts(spark, d).withColumns({"sentiment": tx.sentiment(F.col("text"), POSITIVE, NEGATIVE), "arousal": tx.arousal(F.col("text"), POSITIVE, NEGATIVE), "meta_strategy": F.col("event_type")})
    return temporal.with_windows(p, "ts", "D", 1)


@query(_sql_pivot("round(sentiment, 6)", f"SELECT time_window, meta_strategy, avg(sentiment) AS sentiment FROM ({SQL_FELT}) GROUP BY 1, 2"))
def obs_sentiment_pivot(spark, d):
    return observe.matrix(observe.observations(_felt(spark, d)).withColumn("sentiment", r6(F.col("sentiment"))), "sentiment", EVENT_TYPES)


@query(_sql_pivot("round(arousal, 6)", f"SELECT time_window, meta_strategy, avg(arousal) AS arousal FROM ({SQL_FELT}) GROUP BY 1, 2"))
def obs_arousal_pivot(spark, d):
    return observe.matrix(observe.observations(_felt(spark, d), arousal="arousal").withColumn("arousal", r6(F.col("arousal"))), "arousal", EVENT_TYPES)


@query(f"""WITH o AS ({sql_obs(SQL_EVENTS, 1)}) SELECT w.time_window, s.meta_strategy, coalesce(o.n, 0) AS n FROM (SELECT DISTINCT time_window FROM o) w CROSS JOIN (SELECT DISTINCT meta_strategy FROM o) s LEFT JOIN o ON o.time_window = w.time_window AND o.meta_strategy = s.meta_strategy""")
def obs_from_matrix(spark, d):
    return observe.from_matrix(observe.matrix(_event_obs(spark, d), "n", EVENT_TYPES), "n")


# Strategies


def _sql_behaviour() -> str:
    flags = {k: " + ".join(f"max(CASE WHEN contains(t, {q(w)}) THEN 1 ELSE 0 END)" for w in ws) for k, ws in BEHAVIOUR.items()}
    n = {k: f"CAST({v} AS DOUBLE)" for k, v in flags.items()}
    ratio = lambda a, b: f"{n[a]} / ({n[a]} + {n[b]} + 1)"
    cols = [ratio("complex", "simple"), ratio("long_term", "short_term"), f"least(1.0, {n['product']} / 10)", ratio("scientific", "unscientific"),
            f"(({n['positive']} - {n['negative']}) / ({n['positive']} + {n['negative']} + 1) + 1) / 2", f"{n['social']} / 10", f"{n['data']} / 10", f"{n['guidance']} / 10"]
    return "SELECT lang, " + ", ".join(f"round({c}, 6) AS {a}" for c, a in zip(cols, strategy.DIMS)) + " FROM (SELECT lang, coalesce(text, '') AS t FROM documents) GROUP BY 1"


@query(_sql_behaviour())
def behavior_features(spark, d):
    got = strategy.behaviour(documents(spark, d), "lang", "text", "doc_id", BEHAVIOUR)
    return got.select("lang", *[r6(F.col(c)).alias(c) for c in strategy.DIMS])


SQL_FLAT = "SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings"
SQL_CENTRES = f"SELECT label, list(m ORDER BY i) AS centre FROM (SELECT label, i, avg(x) AS m FROM ({SQL_FLAT}) GROUP BY 1, 2) GROUP BY 1"


def _embeddings(spark, d):
    return read_table(spark, d, "embeddings")


@query(f"SELECT label, i, round(m, 6) AS m FROM (SELECT label, i, avg(x) AS m FROM ({SQL_FLAT}) GROUP BY 1, 2)")
def strategy_centroid(spark, d):
    return strategy.centroids(_embeddings(spark, d), "label", "embedding").select("label", F.posexplode("centre").alias("i", "m")).select("label", F.col("i").cast("long").alias("i"), r6(F.col("m")).alias("m"))


SQL_Z = f"""SELECT label, list((x - m) / (s + 1e-8) ORDER BY i) AS z FROM (SELECT label, i, x, avg(x) OVER (PARTITION BY i) AS m, stddev_pop(x) OVER (PARTITION BY i) AS s FROM
    (SELECT label, unnest(centre) AS x, generate_subscripts(centre, 1) - 1 AS i FROM ({SQL_CENTRES}))) GROUP BY 1"""
SQL_MIXED = f"""SELECT label, list_transform(range(0, 64), lambda i: 0.2 * z[i + 1] + 0.6 * ([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8])[CAST(i // 13 AS INT) + 1] + 0.2 * ([label / 10.0, 0.5])[CAST(i // 33 AS INT) + 1]) AS mixed FROM ({SQL_Z})"""


def _mixed(spark, d):
    centre = strategy.centroids(_embeddings(spark, d), "label", "embedding")
    z = strategy.z_scores(centre, "label", "centre")
    acts = F.array(*[F.lit(x / 10) for x in range(1, 9)])
    return z.select("label", strategy.mixed_vector(F.col("z"), acts, F.array(F.col("label") / 10.0, F.lit(0.5)), 64).alias("mixed"))


@query(f"SELECT label, unnest(range(0, 64)) AS i, round(unnest(mixed), 6) AS x FROM ({SQL_MIXED})")
def mixed_vector(spark, d):
    return _mixed(spark, d).select("label", F.posexplode("mixed").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), r6(F.col("x")).alias("x"))


@query(f"""WITH m AS ({SQL_MIXED}) SELECT a.label AS topic_i, b.label AS topic_j, round(list_cosine_similarity(a.mixed, b.mixed), 6) AS similarity,
    round(CASE WHEN a.label = b.label THEN 0 ELSE greatest(0, 1 - list_cosine_similarity(a.mixed, b.mixed)) END, 6) AS distance FROM m a CROSS JOIN m b""")
def topic_similarity(spark, d):
    s = strategy.similarities(_mixed(spark, d), "label", "mixed")
    return s.select("topic_i", "topic_j", r6(F.col("similarity")).alias("similarity"), r6(F.col("distance")).alias("distance"))


@query(f"""WITH c AS ({SQL_CENTRES}), s AS (SELECT vec_id, c.label, round(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), centre), 12) AS sim FROM embeddings e CROSS JOIN c)
    SELECT vec_id, label, round(sim, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) AS r FROM s) WHERE r = 1""")
def outlier_reassign(spark, d):
    e = _embeddings(spark, d)  # every vector plays the outlier
    got = strategy.reassign(e, "vec_id", "embedding", strategy.centroids(e, "label", "embedding"), "label")
    return got.select("vec_id", "label", r6(F.col("similarity")).alias("similarity"))


SQL_ACTS = _sql_behaviour()
SQL_PROFILE = ", ".join(f"round(avg({a}), 5) AS {b}" for a, b in zip(strategy.DIMS, strategy.PROFILE))


@query(f"SELECT CASE WHEN lang IN ('en', 'de') THEN 'MS0' ELSE 'MS1' END AS meta_strategy, count(*) AS n_topics, array_to_string(list(lang ORDER BY lang), ',') AS members, {SQL_PROFILE} FROM ({SQL_ACTS}) GROUP BY 1")
def strategy_profile(spark, d):
    """Members and mean behaviour of strategies whose topics are languages."""
    docs = documents(spark, d)
    acts = stored(strategy.behaviour(docs, "lang", "text", "doc_id", BEHAVIOUR).withColumnRenamed("lang", "topic"))
    mapping = acts.select("topic", F.when(F.col("topic").isin("en", "de"), "MS0").otherwise("MS1").alias("meta_strategy"))
    words = terms.class_terms(docs.withColumnRenamed("lang", "topic"), "topic", "text")
    got = strategy.strategy_info(mapping, words, acts)
    return got.select("meta_strategy", "n_topics", F.array_join("member_topics", ",").alias("members"), *[F.round(f"profile.{p}", 5).alias(p) for p in strategy.PROFILE])


@query()
def hier_cluster(spark, d):
    """Strategies of topics from their distances (average linkage, silhouette): iterative, so no SQL."""
    return strategy.meta_strategies(strategy.similarities(_mixed(spark, d), "label", "mixed"))


@query()
def kmeans_split(spark, d):
    """Sizes after the split of large topics by k-means: iterative, so no SQL."""
    e = _embeddings(spark, d).withColumn("topic", F.when(F.col("label") < 6, 0).otherwise(1))
    return strategy.split_topic(e, "topic", "embedding").groupBy("topic").agg(F.count("*").alias("n"))


SQL_NAMES = {"创新方法型": ["an", "i"], "运动主导型": ["ar", "e", "ar"], "饮食控制型": ["in", "u"]}


@query("WITH c AS (SELECT n_name, " + ", ".join(f"{sql_sum(ws, 'lower(n_name)')} AS s{i}" for i, ws in enumerate(SQL_NAMES.values())) + " FROM nation) SELECT n_name, CASE WHEN greatest(s0, s1, s2) = 0 THEN '综合策略型' "
       + " ".join(f"WHEN s{i} = greatest(s0, s1, s2) THEN {q(k)}" for i, k in enumerate(SQL_NAMES)) + " END AS strategy FROM c")
def strategy_name_rules(spark, d):
    return read_table(spark, d, "nation").select("n_name", tx.strategy_name(F.col("n_name"), patterns=SQL_NAMES).alias("strategy"))


COSTS = [(["steel", "brass"], 0.5), (["tin"], 0.1), (["copper", "nickel"], 0.3), (["small"], 0.2), (["large", "promo"], 0.4)]


@query("SELECT p_partkey, CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(p_type), {q(w)})' for w in ws)} THEN {c}" for ws, c in COSTS) + " ELSE 0.3 END::DOUBLE AS cost FROM part")
def cost_rules(spark, d):
    return read_table(spark, d, "part").select("p_partkey", tx.strategy_cost(F.col("p_type"), COSTS).alias("cost"))


# Networks

SQL_NORM = "SELECT vec_id % 4 AS w, vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings"
SQL_EDGES = f"WITH RECURSIVE v AS ({SQL_NORM}), nodes AS (SELECT CAST(w AS VARCHAR) AS \"window\", id, CAST(label AS VARCHAR) AS strategy FROM v), edges AS (SELECT CAST(a.w AS VARCHAR) AS \"window\", a.id AS src, b.id AS dst, list_cosine_similarity(a.v, b.v) AS weight FROM v a JOIN v b ON a.w = b.w AND a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.30)"
SQL_ENDS = 'both_ AS (SELECT "window", src AS a, dst AS b FROM edges UNION ALL SELECT "window", dst, src FROM edges)'


def _network(spark, d):
    nodes = _embeddings(spark, d).select((F.col("vec_id") % 4).cast("string").alias("window"), F.col("vec_id").alias("id"), F.col("label").cast("string").alias("strategy"), "embedding")
    return nodes.withColumn("strategy", F.coalesce("strategy", F.lit("Unknown")))


@query(SQL_EDGES + ' SELECT "window", src, dst, round(weight, 6) AS weight FROM edges')
def similarity_edges(spark, d):
    return network.similarity_edges(_network(spark, d), 0.30).withColumn("weight", r6(F.col("weight")))


@query(SQL_EDGES + ' SELECT n."window", n_nodes, coalesce(n_edges, 0) AS n_edges, round(2.0 * coalesce(n_edges, 0) / (n_nodes * (n_nodes - 1)), 6) AS density FROM (SELECT "window", count(*) AS n_nodes FROM nodes GROUP BY 1) n LEFT JOIN (SELECT "window", count(*) AS n_edges FROM edges GROUP BY 1) e ON n."window" = e."window"')
def net_basic(spark, d):
    nodes = _network(spark, d)
    return network.basic_of(nodes, network.edge_counts(network.linked_blocks(nodes), 0.30)).withColumn("density", r6(F.col("density")))


@query(SQL_EDGES + ", " + SQL_ENDS + """, deg AS (SELECT "window", a, count(*) AS d FROM both_ GROUP BY 1, 2),
    tri AS (SELECT x."window", x.a, count(*) AS t FROM both_ x JOIN both_ y ON x."window" = y."window" AND x.a = y.a AND x.b < y.b JOIN edges e ON e."window" = x."window" AND e.src = x.b AND e.dst = y.b GROUP BY 1, 2)
    SELECT n."window", round(sum(CASE WHEN d >= 2 THEN 2.0 * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END) / count(*), 6) AS avg_clustering
    FROM nodes n LEFT JOIN deg ON n."window" = deg."window" AND n.id = deg.a LEFT JOIN tri ON n."window" = tri."window" AND n.id = tri.a GROUP BY 1""")
def net_clustering(spark, d):
    return network.vector_metrics(_network(spark, d).withColumn("m", F.lit(1)), 0.30, parts=False).select("window", "avg_clustering").withColumn("avg_clustering", r6(F.col("avg_clustering")))


@query(SQL_EDGES + ", " + SQL_ENDS + """, reach AS (SELECT "window", id, id AS r FROM nodes UNION SELECT reach."window", b, r FROM reach JOIN both_ ON reach."window" = both_."window" AND reach.id = both_.a AND both_.b > r),
    lab AS (SELECT "window", id, min(r) AS c FROM reach GROUP BY 1, 2) SELECT "window", count(*) AS n_components, max(k) AS largest_component_size FROM (SELECT "window", c, count(*) AS k FROM lab GROUP BY 1, 2) GROUP BY 1""")
def net_components(spark, d):
    nodes = _network(spark, d)
    return network.component_sizes(nodes, network.block_components(network.linked_blocks(nodes), 0.30))


@query('SELECT CAST(vec_id % 4 AS VARCHAR) AS "window", CAST(label AS VARCHAR) AS strategy, count(*) AS n FROM embeddings GROUP BY 1, 2')
def net_strategy_dist(spark, d):
    return network.strategy_distribution(_network(spark, d))


@query(SQL_EDGES + """, o AS (SELECT e."window", a.strategy AS strategy, (a.strategy = b.strategy)::INT AS inside FROM edges e JOIN nodes a ON e."window" = a."window" AND e.src = a.id JOIN nodes b ON e."window" = b."window" AND e.dst = b.id)
    SELECT s."window", s.strategy, coalesce(sum(inside), 0)::BIGINT AS internal, coalesce(sum(1 - inside), 0)::BIGINT AS external, round(coalesce(avg(inside), 0), 6) AS echo FROM (SELECT DISTINCT "window", strategy FROM nodes) s LEFT JOIN o ON s."window" = o."window" AND s.strategy = o.strategy GROUP BY 1, 2""")
def echo_chamber(spark, d):
    nodes = _network(spark, d)
    return network.echo_of(nodes, network.linked_strategies(network.linked_blocks(nodes, tag="strategy"), 0.30)).withColumn("echo", r6(F.col("echo")))


METRICS = ["density", "avg_clustering"]


def _sql_metrics(nodes: str) -> str:
    """Metrics of all pairs of ``nodes`` (window, id, strategy, v), as the quotient of equal vectors must give them."""
    return f"""WITH RECURSIVE nodes AS ({nodes}), edges AS (SELECT a."window", a.id AS src, b.id AS dst FROM nodes a JOIN nodes b ON a."window" = b."window" AND a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.30),
    {SQL_ENDS}, deg AS (SELECT "window", a, count(*) AS d FROM both_ GROUP BY 1, 2),
    tri AS (SELECT x."window", x.a, count(*) AS t FROM both_ x JOIN both_ y ON x."window" = y."window" AND x.a = y.a AND x.b < y.b JOIN edges e ON e."window" = x."window" AND e.src = x.b AND e.dst = y.b GROUP BY 1, 2),
    c AS (SELECT n."window", count(*) AS n_nodes, coalesce(sum(d), 0)::BIGINT // 2 AS n_edges, sum(CASE WHEN d >= 2 THEN 2.0 * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END) / count(*) AS avg_clustering
          FROM nodes n LEFT JOIN deg ON n."window" = deg."window" AND n.id = deg.a LEFT JOIN tri ON n."window" = tri."window" AND n.id = tri.a GROUP BY 1),
    reach AS (SELECT "window", id, id AS r FROM nodes UNION SELECT reach."window", b, r FROM reach JOIN both_ ON reach."window" = both_."window" AND reach.id = both_.a AND both_.b > r),
    lab AS (SELECT "window", id, min(r) AS c FROM reach GROUP BY 1, 2), parts AS (SELECT "window", count(*) AS n_components, max(k) AS largest_component_size FROM (SELECT "window", c, count(*) AS k FROM lab GROUP BY 1, 2) GROUP BY 1)
    SELECT c."window", n_nodes, n_edges, round(2.0 * n_edges / (n_nodes * (n_nodes - 1)), 6) AS density, round(avg_clustering, 6) AS avg_clustering, n_components, largest_component_size FROM c JOIN parts ON c."window" = parts."window\""""


#: Three signs of a vector: many vectors are equal, as copies of a post are.
SQL_COPIES = 'SELECT CAST(vec_id % 4 AS VARCHAR) AS "window", vec_id AS id, CAST(label AS VARCHAR) AS strategy, [sign(embedding[1])::DOUBLE, sign(embedding[2])::DOUBLE, sign(embedding[3])::DOUBLE] AS v FROM embeddings'


def _copies(spark, d):
    signs = F.array(*[F.signum(F.get("embedding", i).cast("double")) for i in range(3)])
    nodes = _embeddings(spark, d).select((F.col("vec_id") % 4).cast("string").alias("window"), F.col("vec_id").alias("id"), F.col("label").cast("string").alias("strategy"), signs.alias("embedding"))
    members = stored(network.classes(nodes))
    return members, stored(network.similarity_edges(network.class_sizes(members), 0.30))


@query(_sql_metrics(SQL_COPIES))
def net_copies(spark, d):
    members, edges = _copies(spark, d)
    got = network.class_metrics(stored(network.class_sizes(members)), edges)
    return got.withColumns({c: r6(F.col(c)) for c in METRICS})


@query(f"""WITH nodes AS ({SQL_COPIES}), e AS (SELECT a."window", a.strategy AS sa, b.strategy AS sb FROM nodes a JOIN nodes b ON a."window" = b."window" AND a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.30)
    SELECT s."window", s.strategy, count(*) FILTER (WHERE sa = sb) AS internal, count(*) FILTER (WHERE sa <> sb) AS external, round(coalesce(avg((sa = sb)::INT), 0), 6) AS echo
    FROM (SELECT DISTINCT "window", strategy FROM nodes) s LEFT JOIN e ON s."window" = e."window" AND s.strategy = sa GROUP BY 1, 2""")
def net_copies_echo(spark, d):
    return network.class_echo_chambers(*_copies(spark, d)).withColumn("echo", r6(F.col("echo")))


@query(_sql_metrics("SELECT 'all' AS \"window\", vec_id AS id, CAST(label AS VARCHAR) AS strategy, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings"))
def net_global(spark, d):
    nodes = _embeddings(spark, d).select(F.lit("all").alias("window"), F.col("vec_id").alias("id"), F.col("label").cast("string").alias("strategy"), "embedding")
    got = network.vector_metrics(stored(network.grouped(nodes)), 0.30)
    return got.withColumns({c: r6(F.col(c)) for c in METRICS})


# Density


@query("SELECT max(n) AS n, round(sum(v), 6) AS variance FROM (SELECT i, count(*) AS n, var_pop(x) AS v FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i)")
def reduced_variance(spark, d):
    """All axes together keep the variance; a table of (dimensions + 1)^2 numbers reaches the driver."""
    low = density.reduced(_embeddings(spark, d), "vec_id", "embedding", 64)
    flat = low.select("vec_id", F.posexplode("vector").alias("i", "x")).groupBy("i").agg(F.var_pop("x").alias("v"), F.count("*").alias("n"))
    return flat.agg(F.max("n").alias("n"), r6(F.sum("v")).alias("variance"))


def _points(spark, d):
    return stored(density.points(stored(density.reduced(_embeddings(spark, d), "vec_id", "embedding", 16)), "vec_id", "vector"))


@query()
def neighbour_lists(spark, d):
    """Ten nearest neighbours of every 50th vector among all: approximate, so no SQL; tests measure the recall."""
    near = density.neighbours(_points(spark, d), 10).filter("id % 50 = 0")
    return near.select("id", F.posexplode("near").alias("place", "x")).select("id", "place", F.col("x.id").alias("neighbour"), F.round("x.d", 9).alias("distance"))


@query()
def density_topics(spark, d):
    """Topics of all vectors by density: iterative, so no SQL; tests hold it against a plain version."""
    got = density.density_topics(_embeddings(spark, d), "vec_id", "embedding", least=10, k=5)
    return got.withColumn("topic_probability", F.round("topic_probability", 9))


# Competition

SQL_SIM_EVENTS, SQL_SIM_ORDERS = sql_sim(sql_obs(SQL_EVENTS, 1)), sql_sim(sql_obs(SQL_ORDERS, 1))


def _sim(obs):
    return stored(game.simulate(obs))


@query(SQL_SIM_EVENTS + " SELECT time_window, meta_strategy, round(initial, 6) AS initial, round(final, 6) AS final FROM game")
def replicator_final(spark, d):
    return _sim(_event_obs(spark, d)).select("time_window", "meta_strategy", r6(F.col("initial")).alias("initial"), r6(F.col("final")).alias("final"))


@query(SQL_SIM_ORDERS + " SELECT time_window, meta_strategy, round(initial, 6) AS initial, round(final, 6) AS final FROM game")
def replicator_orders(spark, d):
    return _sim(_order_obs(spark, d)).select("time_window", "meta_strategy", r6(F.col("initial")).alias("initial"), r6(F.col("final")).alias("final"))


def _eq(df):
    return df.select("time_window", "dominant_strategy", r6(F.col("dominant_ratio")).alias("dominant_ratio"), r6(F.col("diversity")).alias("diversity"), "equilibrium_type", F.col("n_active_strategies").alias("k"))


SQL_EQ = " SELECT time_window, dominant_strategy, round(dominant_ratio, 6) AS dominant_ratio, round(diversity, 6) AS diversity, equilibrium_type, k FROM typed"


@query(SQL_SIM_EVENTS + SQL_EQ)
def equilibrium_events(spark, d):
    return _eq(game.equilibria(_sim(_event_obs(spark, d))))


@query(SQL_SIM_ORDERS + SQL_EQ)
def equilibrium_orders(spark, d):
    return _eq(game.equilibria(_sim(_order_obs(spark, d))))


@query(SQL_SIM_ORDERS + " SELECT equilibrium_type, count(*) AS n FROM typed GROUP BY 1")
def equilibrium_type_counts(spark, d):
    return game.equilibria(_sim(_order_obs(spark, d))).groupBy("equilibrium_type").agg(F.count("*").alias("n"))


@query(SQL_SIM_EVENTS + " SELECT time_window, it AS iteration, unnest(names) AS meta_strategy, round(unnest(x), 6) AS share FROM (SELECT s.time_window, it, names, s.x FROM sim s JOIN init USING (time_window) WHERE it % 100 = 0 AND NOT done)")
def trajectory(spark, d):
    return game.trajectory(_event_obs(spark, d), every=100).withColumn("share", r6(F.col("share")))


# Analysis

SQL_GROWTH = f"""WITH o AS ({sql_obs(SQL_ORDERS, 1)}), g AS (SELECT w.time_window, s.meta_strategy, coalesce(o.n, 0) AS n FROM (SELECT DISTINCT time_window FROM o) w CROSS JOIN (SELECT DISTINCT meta_strategy FROM o) s LEFT JOIN o ON o.time_window = w.time_window AND o.meta_strategy = s.meta_strategy),
    l AS (SELECT *, lag(n) OVER (PARTITION BY meta_strategy ORDER BY time_window) AS prev FROM g),
    r AS (SELECT time_window, meta_strategy, n, CASE WHEN prev IS NULL THEN NULL WHEN prev = 0 AND n > 0 THEN 'inf'::DOUBLE WHEN prev = 0 THEN NULL ELSE n::DOUBLE / prev - 1 END AS growth FROM l)"""


@query(SQL_GROWTH + " SELECT time_window, meta_strategy, n, round(growth, 6) AS growth FROM r")
def growth_rates(spark, d):
    return analysis.growth(_order_obs(spark, d)).withColumn("growth", r6(F.col("growth")))


@query(SQL_GROWTH + " SELECT meta_strategy, round(avg(growth), 6) AS mean_growth FROM r GROUP BY 1 HAVING avg(growth) > -0.10 AND meta_strategy <> 'MS_Outlier'")
def snowball(spark, d):
    return analysis.snowball(_order_obs(spark, d), -0.10).withColumn("mean_growth", r6(F.col("mean_growth")))


@query("""WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS w, count(*) AS n_orders, avg(o_totalprice) AS mean_price FROM orders GROUP BY 1), p AS (SELECT *, row_number() OVER (ORDER BY w) - 1 AS x FROM m)
    SELECT 'n_orders' AS metric, round(regr_slope(n_orders, x), 6) AS slope FROM p UNION ALL SELECT 'mean_price', round(regr_slope(mean_price, x), 6) FROM p""")
def trend_slopes(spark, d):
    m = _windows(spark, d, "orders", "o_orderdate", "M").groupBy(F.col("time_window").alias("window")).agg(F.count("*").alias("n_orders"), F.avg("o_totalprice").alias("mean_price"))
    return analysis.trends(m, ["n_orders", "mean_price"]).withColumn("slope", r6(F.col("slope")))


@query("""WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS w, count(*) AS n_orders, avg(o_totalprice) AS mean_price FROM orders GROUP BY 1), p AS (SELECT *, row_number() OVER (ORDER BY w) - 1 AS x FROM m),
    s AS (SELECT regr_slope(n_orders, x) AS a, regr_slope(mean_price, x) AS b FROM p) SELECT round(a, 6) AS density_slope, round(b, 6) AS clustering_slope, a > 0 AND b > 0 AS is_homogenising FROM s""")
def homogenisation(spark, d):
    m = _windows(spark, d, "orders", "o_orderdate", "M").groupBy(F.col("time_window").alias("window")).agg(F.count("*").alias("n_orders"), F.avg("o_totalprice").alias("mean_price"))
    got = analysis.homogenisation(m, "n_orders", "mean_price")
    return got.select(r6(F.col("density_slope")).alias("density_slope"), r6(F.col("clustering_slope")).alias("clustering_slope"), "is_homogenising")


@query(SQL_SIM_EVENTS + " SELECT meta_strategy FROM game WHERE initial IS NOT NULL AND meta_strategy <> 'MS_Outlier' INTERSECT SELECT meta_strategy FROM game WHERE final IS NOT NULL")
def common_strategies(spark, d):
    return analysis.common_strategies(_sim(_event_obs(spark, d)))


@query(f"SELECT meta_strategy, count(*) AS n, round(avg(sentiment), 6) AS sentiment, round(avg(arousal), 6) AS arousal FROM ({SQL_FELT}) GROUP BY 1")
def emotion_by_strategy(spark, d):
    m = observe.strategy_means(_felt(spark, d))
    return m.select("meta_strategy", "n", r6(F.col("sentiment")).alias("sentiment"), r6(F.col("arousal")).alias("arousal"))


SQL_CLASSED = "CASE WHEN meta_strategy = 'purchase' THEN '科学 purchase' WHEN meta_strategy = 'signup' THEN '健康 signup' WHEN meta_strategy = 'click' THEN '快速 click' ELSE meta_strategy END"


@query(f"""WITH m AS (SELECT {SQL_CLASSED} AS s, avg(arousal) AS a FROM ({SQL_FELT}) GROUP BY 1)
    SELECT round(avg(a) FILTER (s LIKE '%科学%' OR s LIKE '%健康%'), 6) AS science, round(avg(a) FILTER (s LIKE '%快速%' OR s LIKE '%捷径%'), 6) AS shortcut,
    round(avg(a) FILTER (s LIKE '%快速%' OR s LIKE '%捷径%') - avg(a) FILTER (s LIKE '%科学%' OR s LIKE '%健康%'), 6) AS gap FROM m""")
def arousal_gap(spark, d):
    m = F.col("meta_strategy")
    named = F.when(m == "purchase", "科学 purchase").when(m == "signup", "健康 signup").when(m == "click", "快速 click").otherwise(m)
    got = analysis.arousal_gap(observe.strategy_means(_felt(spark, d).withColumn("meta_strategy", named)))
    return got.select(*[r6(F.col(c)).alias(c) for c in got.columns])


@query(SQL_SIM_EVENTS + """, v AS (SELECT var_pop(initial) AS vi, var_pop(final) AS vf FROM game GROUP BY time_window HAVING count(*) > 1), a AS (SELECT avg(vi) AS i, avg(vf) AS f FROM v)
    SELECT round(i, 6) AS initial_variance, round(f, 6) AS final_variance, round(f - i, 6) AS variance_change, CASE WHEN f > 1.1 * i THEN 'diverging' WHEN f < 0.9 * i THEN 'levelling' ELSE 'stable' END AS verdict FROM a""")
def variance_change(spark, d):
    got = analysis.variance_change(_sim(_event_obs(spark, d)))
    return got.select(*[r6(F.col(c)).alias(c) for c in ("initial_variance", "final_variance", "variance_change")], "verdict")


@query(SQL_SIM_ORDERS + " SELECT round(avg(diversity), 6) AS avg_diversity, CASE WHEN avg(diversity) < 0.5 THEN 'low' WHEN avg(diversity) < 0.8 THEN 'middle' ELSE 'high' END AS band FROM eq")
def diversity_band(spark, d):
    got = analysis.diversity_band(game.equilibria(_sim(_order_obs(spark, d))))
    return got.withColumn("avg_diversity", r6(F.col("avg_diversity")))


def _sql_describe(table: str, c: str) -> str:
    return f"SELECT '{c}' AS metric, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, max({c}) AS max FROM {table}"


@query(_sql_describe("events", "value") + " UNION ALL " + _sql_describe("(SELECT CAST(user_id AS DOUBLE) AS user_id FROM events)", "user_id"))
def describe_interactions(spark, d):
    got = analysis.describe(read_table(spark, d, "events"), ["value", "user_id"])
    return got.select("metric", "n", *[r6(F.col(c)).alias(c) for c in ("mean", "std")], "min", *[r6(F.col(c)).alias(c) for c in ("p25", "p50", "p75")], "max")


@query("SELECT CAST(least(30, floor((value - lo) / (hi - lo) * 30) + 1) AS INT) AS bin, count(*) AS n FROM (SELECT value::DOUBLE AS value, min(value) OVER () AS lo, max(value) OVER () AS hi FROM events) WHERE value IS NOT NULL GROUP BY 1")
def histogram30(spark, d):
    return analysis.histogram(read_table(spark, d, "events"), "value", 30)


@query("SELECT strftime(o_orderdate, '%Y-%m') AS time_window, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 LIMIT 12")
def month_head12(spark, d):
    return temporal.window_counts(_windows(spark, d, "orders", "o_orderdate", "M")).orderBy("time_window").limit(12)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def emotion_dist(spark, d):
    return read_table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"SELECT count(*) AS n_rows, count(DISTINCT time_window) AS n_windows, count(DISTINCT meta_strategy) AS n_strategies, count(DISTINCT meta_strategy) - 3 AS n_extra FROM ({SQL_EVENTS})")
def report_scalars(spark, d):
    rows = _windows(spark, d, "events", "ts", "D").select("time_window", F.col("event_type").alias("meta_strategy"))
    return analysis.report_scalars(rows)


@query(f"SELECT meta_strategy, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM ({SQL_EVENTS}) GROUP BY 1")
def strategy_shares(spark, d):
    counts = read_table(spark, d, "events").groupBy(F.col("event_type").alias("meta_strategy")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("meta_strategy", "n", r6(100.0 * F.col("n") / F.col("t")).alias("percent"))


# Sources and sinks: written, then read again.


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey, true AS has_source FROM nation")
def csv_round_trip(spark, d):
    path = shared_path(spark)
    writers.write_table(read_table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), path, "csv")
    return readers.read_posts(spark, f"{path}/*.csv").select("n_nationkey", "n_name", "n_regionkey", F.col("source_file").endswith(".csv").alias("has_source"))


@query("SELECT o_orderpriority AS source, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1")
def split_round_trip(spark, d):
    path = shared_path(spark)
    writers.write_table(read_table(spark, d, "orders").filter("o_orderpriority is not null").select("o_orderkey", "o_totalprice", F.col("o_orderpriority").alias("source")), path, by=["source"])
    return spark.read.parquet(path).groupBy("source").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"""WITH o AS ({sql_obs(SQL_ORDERS, 1)}) SELECT w.time_window, s.meta_strategy, coalesce(o.n, 0)::DOUBLE AS n FROM (SELECT DISTINCT time_window FROM o) w CROSS JOIN (SELECT DISTINCT meta_strategy FROM o) s
    LEFT JOIN o ON o.time_window = w.time_window AND o.meta_strategy = s.meta_strategy""")
def matrix_round_trip(spark, d):
    path = shared_path(spark)
    obs = _order_obs(spark, d)
    writers.write_matrices(obs if "arousal" in obs.columns else obs.withColumn("arousal", F.lit(0.0)), path)
    return readers.read_matrix(spark, f"{path}/n")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def json_round_trip(spark, d):
    path = shared_path(spark)
    r = read_table(spark, d, "region").join(read_table(spark, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    writers.write_json(r.groupBy("r_name").agg(F.sort_array(F.collect_list("n_name")).alias("nations")), path)  # one list a region
    return readers.read_document(spark, path, lines=True).select(F.explode("nations").alias("n_name"), "r_name")


@query(f"SELECT word, freq FROM (SELECT word, count(*) AS freq FROM ({SQL_WORDS}) GROUP BY 1 ORDER BY freq DESC, word LIMIT 50)")
def terms_round_trip(spark, d):
    path = shared_path(spark)
    writers.write_terms(screening.top(terms.term_counts(documents(spark, d), "text", STOP), "freq", "word", 50), path)
    return spark.read.schema("word string, freq long").option("sep", "\t").csv(path)
