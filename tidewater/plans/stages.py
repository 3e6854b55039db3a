"""Screening and the five stages over posts, and a runner for any of them.

Stages hand on DataFrames; each stage's tables are written to the output folder and read back, so a
later run can begin at any stage. Timing and totals are logged.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions import lexicon as lx
from tidewater.functions import text as tx
from tidewater.operators import analysis, density, game, network, observe, screening, segmentation, strategy, temporal, terms, vectors
from tidewater.plans.storage import stored
from tidewater.sources import writers

log = logging.getLogger("tidewater")
TEXT_COLUMNS = ("全文内容", "标题_微博内容", "原微博内容", "内容", "text")
USER_COLUMNS = ("用户ID", "user_id")
ID_COLUMNS = ("微博ID", "id", "ID", "文章ID")
INTERACTION_COLUMNS = ("点赞数", "评论数", "转发数", "阅读数_浏览热度")
EXTRA_COLUMNS = ("根微博标题", "话题", "用户简介", "图文识别")


@dataclass
class Settings:
    """What a run can be told."""

    text: Sequence[str] = TEXT_COLUMNS
    user: Sequence[str] = USER_COLUMNS
    time_col: str | None = None
    id_col: str = "post_id"
    unit: str = "M"
    min_docs: int = 100
    max_per_user: int = 100
    top_terms: int = 50
    topics: int = 15
    min_topic: int = 200
    similarity: float = 0.95
    #: "density": clusters by density of at least ``min_topic`` posts; "centres": ``topics`` clusters around centres.
    method: str = "density"
    vector: str | None = None
    #: Without a vector column: "trained" on the posts' words, or "hashed" counts of them.
    embedding: str = "trained"
    lexicon: lx.Lexicon | None = None
    min_score: float = 3.5
    unrelated: int = 1000
    #: Words that segmentation keeps whole; None: words are runs of letters and digits.
    words: Sequence[str] | None = tuple(lx.SEGMENT_WORDS)
    simulate: dict[str, Any] = field(default_factory=dict)


def known_words(s: Settings) -> list[str]:
    """Words that segmentation keeps whole: the settings' and the lexicon's, and those of the fixed lists."""
    lists = [s.words or (), s.lexicon.keywords if s.lexicon else (), lx.POSITIVE, lx.NEGATIVE, *lx.BEHAVIOUR.values(), *lx.STRATEGY_PATTERNS.values()]
    return sorted({w for ws in lists for w in ws})


def _split(s: Settings, words: DataFrame | None):
    """The segmenter of the settings; ``words`` (word, n) are those found in the posts, at most some ten thousand."""
    if s.words is None:
        return None
    found = {r["word"]: r["n"] for r in words.collect()} if words is not None else {}
    return segmentation.lattice_segmenter({w: 1 for w in known_words(s)} | found)


def screen(df: DataFrame, s: Settings) -> dict[str, DataFrame]:
    """related (relevant, of good quality, each id and content once), unrelated (a sample from each source), keywords (frequencies), screened (counts).

    All sources are screened together; rows meet by column, and ``source_file``, if there, says whose sample a row is in.
    """
    if s.lexicon is None:
        raise ValueError("screening needs a lexicon of keywords")
    column = screening.first_column(df.columns, s.text, required=True)
    searched = [column, *(c for c in EXTRA_COLUMNS if c in df.columns and c != column)]
    clean = screening.clean_columns(df)
    scored = stored(screening.with_relevance(clean, searched, s.lexicon, s.min_score))
    yes, no = screening.split_related(scored)
    good = screening.good_quality(yes, column)
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    by_interaction = screening.first_column(df.columns, INTERACTION_COLUMNS)
    placed = good.withColumn("_tie", tie)
    if by_interaction:
        placed = placed.withColumn("_interaction", F.col(by_interaction).cast("double"))
    id_col = screening.first_column(df.columns, (*ID_COLUMNS, s.id_col))
    if id_col:
        # Ids that cleaning left empty are no ids.
        placed = screening.dedup_id(placed.withColumn("_id", F.nullif(F.col(id_col).cast("string"), F.lit(""))), "_id", [F.asc("_tie")]).drop("_id")
    once = screening.dedup_content(placed, column, "_interaction" if by_interaction else None, "_tie")
    related = screening.good_quality(once, column).drop("_tie", "_interaction")
    source = "source_file" if "source_file" in df.columns else None
    order = [F.md5(F.col("_tie").cast("string")), F.col("_tie")]
    spread = Window.partitionBy(source or F.lit(0)).orderBy(*order)
    if source:
        rest = no.withColumn("_tie", tie).withColumn("_r", F.row_number().over(spread)).filter(F.col("_r") <= s.unrelated).drop("_tie", "_r")
    else:
        rest = no.withColumn("_tie", tie).orderBy(*order).limit(s.unrelated).drop("_tie")
    counts = scored.agg(F.count("*").alias("n_rows"), F.count_if("is_related").alias("n_related"))
    return {"related": related, "unrelated": rest, "keywords": screening.keyword_counts(clean, searched, s.lexicon, ()), "screened": counts}


def preprocess(df: DataFrame, s: Settings) -> dict[str, DataFrame]:
    """posts (text_clean, time_window), terms and words (those that segmentation found or knew, with frequencies)."""
    column = screening.first_column(df.columns, s.text, required=True)
    clean = temporal.drop_short(df.withColumn("text_clean", tx.clean_text(F.col(column))), "text_clean")
    user = screening.first_column(df.columns, s.user)
    people = temporal.drop_bots(clean, user, s.max_per_user) if user else clean
    timed = stored(temporal.with_windows(people, s.time_col, s.unit, s.min_docs))
    if s.words is None:
        return {"posts": timed, "terms": screening.top(terms.term_counts(timed, "text_clean"), "freq", "word", s.top_terms)}
    words = stored(segmentation.learn(timed, "text_clean", known_words(s)))
    top = screening.top(terms.term_counts(timed, "text_clean", split=_split(s, words)), "freq", "word", s.top_terms)
    return {"posts": timed, "terms": top, "words": words}


def _embedded(posts: DataFrame, s: Settings, split) -> DataFrame:
    """``posts`` with _vector, 64 numbers. Written, as topics are sought in many passes."""
    if s.embedding == "hashed":
        return stored(posts.withColumn("_vector", strategy.hashed_embedding("text_clean")))
    if s.embedding != "trained":
        raise ValueError(f"embedding is trained or hashed, not {s.embedding!r}")
    return stored(vectors.embed(posts, "text_clean", vectors.train(posts, "text_clean", 64, split=split), "_vector", split))


def _topics(posts: DataFrame, vector: str, s: Settings) -> DataFrame:
    """``posts`` with topic and topic_probability."""
    if s.method == "centres":
        return strategy.fit_topics(posts, vector, s.topics, s.min_topic)
    if s.method != "density":
        raise ValueError(f"method is density or centres, not {s.method!r}")
    # Ids may repeat: rows have numbers of their own while topics are sought.
    numbered = stored(posts.withColumn("_row", F.monotonically_increasing_id()))
    found = density.density_topics(numbered, "_row", vector, s.min_topic)
    return numbered.join(found, "_row").drop("_row")


def discover(posts: DataFrame, s: Settings, words: DataFrame | None = None) -> dict[str, DataFrame]:
    """posts with topic and strategy, the mapping, strategies, observations."""
    split = _split(s, words)
    v = posts if s.vector else _embedded(posts, s, split)
    vector = s.vector or "_vector"
    fitted = strategy.split_topic(_topics(v, vector, s), "topic", vector)
    # Much is derived from these rows and from the table of topics: both are made once.
    felt = stored(fitted.withColumns({"sentiment": tx.sentiment(F.col("text_clean")), "arousal": tx.arousal(F.col("text_clean"))}))
    valid = felt.filter("topic != -1")
    emotion = valid.groupBy("topic").agg(F.avg("sentiment").alias("ms"), F.avg("arousal").alias("ma"))
    centre = stored(strategy.centroids(valid, "topic", vector))
    z = strategy.z_scores(centre, "topic", "centre")
    acts = stored(strategy.behaviour(valid, "topic", "text_clean", s.id_col))
    dims = 64 if not s.vector else int(centre.select(F.max(F.size("centre"))).first()[0] or 0)
    mixed = z.join(acts, "topic").join(emotion, "topic").select("topic", strategy.mixed_vector(F.col("z"), F.array(*strategy.DIMS), F.array((F.col("ms") + 1) / 2, F.col("ma")), dims).alias("mixed"))
    mapping = strategy.meta_strategies(strategy.similarities(mixed, "topic", "mixed"))
    top = terms.class_terms(valid, "topic", "text_clean", split=split)
    info = stored(strategy.strategy_info(mapping, top, acts))
    named = observe.map_strategies(felt, mapping)
    centres = strategy.centroids(named.filter(F.col("meta_strategy") != observe.OUTLIER), "meta_strategy", vector)
    # An outlier's strategy is found on its own row: ids may repeat.
    placed = named.withColumn("meta_strategy", F.when(F.col("meta_strategy") == observe.OUTLIER, F.coalesce(strategy.most_alike(vector, centres, "meta_strategy")["name"], "meta_strategy")).otherwise(F.col("meta_strategy")))
    titles = info.select("meta_strategy", F.col("semantic_name").alias("meta_strategy_name"))
    full = stored(placed.join(titles, "meta_strategy", "left").withColumn("meta_strategy_name", F.coalesce("meta_strategy_name", F.lit("异常"))))
    return {"strategy_posts": full.drop("_vector") if s.vector else full, "mapping": mapping.join(titles, "meta_strategy", "left"), "strategies": info, "observations": observe.observations(full, arousal="arousal")}


def connect(posts: DataFrame, s: Settings) -> dict[str, DataFrame]:
    """nodes (window, node, id, strategy, rep), edges (between the representatives rep of equal vectors) and metrics of each window and of all together (window ``all``).

    Metrics count every post: what copies of a post add to them follows from their number.
    """
    vector = s.vector or "_vector"
    own = posts.select(F.col("time_window").alias("window"), F.col(s.id_col).cast("string").alias("name"), F.col("meta_strategy").alias("strategy"), F.transform(vector, lambda x: x.cast("double")).alias("embedding"))
    # Ids may repeat: nodes have numbers, written so that they don't change.
    numbered = stored(own.withColumn("id", F.monotonically_increasing_id()))
    members = stored(network.classes(numbered.unionByName(numbered.withColumn("window", F.lit("all")))))
    edges = stored(network.similarity_edges(network.class_sizes(members), s.similarity))
    nodes = members.select("window", F.col("id").alias("node"), F.col("name").alias("id"), "strategy", "rep")
    return {"nodes": nodes, "edges": edges, "network": network.class_network_metrics(members, edges)}


def compete(observations: DataFrame, s: Settings) -> dict[str, DataFrame]:
    sim = stored(game.simulate(observations, **s.simulate))
    return {"game": sim, "equilibria": game.equilibria(sim)}


def analyse(observations: DataFrame, posts: DataFrame, net: DataFrame, sim: DataFrame, eq: DataFrame) -> dict[str, DataFrame]:
    means = observe.strategy_means(posts)
    return {
        "snowball": analysis.snowball(observations),
        "trends": analysis.trends(net.filter("window != 'all'"), ["density", "avg_clustering"]),
        "homogenisation": analysis.homogenisation(net.filter("window != 'all'")),
        "common": analysis.common_strategies(sim),
        "emotion": means,
        "gap": analysis.arousal_gap(means.join(posts.select("meta_strategy", "meta_strategy_name").distinct(), "meta_strategy").drop("meta_strategy").withColumnRenamed("meta_strategy_name", "meta_strategy")),
        "variance": analysis.variance_change(sim),
        "diversity": analysis.diversity_band(eq),
        "equilibrium_types": eq.groupBy("equilibrium_type").agg(F.count("*").alias("n")),
        "scalars": analysis.report_scalars(posts),
    }


class Pipeline:
    """Runs stages 0 (screening) to 5 over posts; tables go to ``out`` as Parquet, what is read elsewhere also as CSV, JSON or GEXF, the report as Markdown."""

    def __init__(self, spark: SparkSession, out: str, settings: Settings | None = None):
        self.spark, self.out, self.settings = spark, out.rstrip("/"), settings or Settings()
        self.seconds: dict[str, float] = {}

    def _keep(self, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.out}/{name}")
        return {name: self.read(name) for name in tables}

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.out}/{name}")

    def _hand_out(self, k: int, tables: dict[str, DataFrame]) -> None:
        """Files for others: split screening results, terms, matrices, strategies, graphs."""
        if k == 0:
            by = ["source_file"] if "source_file" in tables["related"].columns else []
            writers.write_table(tables["related"], f"{self.out}/files/related", "csv", by)
            writers.write_table(tables["unrelated"], f"{self.out}/files/unrelated", "csv", by)
        elif k == 1:
            writers.write_terms(tables["terms"].select("word", "freq"), f"{self.out}/files/terms")
            writers.write_corpus(tables["posts"], "text_clean", f"{self.out}/files/corpus")
        elif k == 2:
            writers.write_matrices(tables["observations"], f"{self.out}/files/matrices")
            writers.write_json(tables["strategies"], f"{self.out}/files/strategies")
            writers.write_json(tables["mapping"], f"{self.out}/files/mapping")
        elif k == 3:
            writers.write_graphs(tables["nodes"].filter("window <> 'all'"), tables["edges"].filter("window <> 'all'"), f"{self.out}/files/graphs")

    def run(self, posts: DataFrame | None = None, stages: Sequence[int] = (1, 2, 3, 4, 5), skip: Sequence[int] = ()) -> dict[str, float]:
        """The chosen stages in order; a stage whose predecessor isn't run takes the tables that an earlier run left. Seconds a stage."""
        s = self.settings
        work: dict[int, Callable[[], dict[str, DataFrame]]] = {
            0: lambda: screen(posts, s),
            1: lambda: preprocess(self.read("related") if 0 in stages and 0 not in skip else posts, s),
            2: lambda: discover(self.read("posts"), s, self.read("words") if s.words is not None else None),
            3: lambda: connect(self.read("strategy_posts"), s),
            4: lambda: compete(self.read("observations"), s),
            5: lambda: analyse(self.read("observations"), self.read("strategy_posts"), self.read("network"), self.read("game"), self.read("equilibria")),
        }
        unknown = set(stages) - set(work)
        if unknown:
            raise ValueError(f"no such stages: {sorted(unknown)}")
        for k in sorted(set(stages) - set(skip)):
            if posts is None and (k == 0 or k == 1 and (0 not in stages or 0 in skip)):
                raise ValueError(f"stage {k} needs posts")
            began = time.monotonic()
            tables = self._keep(work[k]())
            self._hand_out(k, tables)
            if k == 5:
                text = writers.report("Opinion dynamics", tables, said=writers.findings(tables))
                self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.out}/report")
            self.seconds[f"stage{k}"] = time.monotonic() - began
            log.info("stage %d took %.1f s", k, self.seconds[f"stage{k}"])
        total = sum(self.seconds.values())
        for name, x in self.seconds.items():
            log.info("%s: %.1f s, %.0f %%", name, x, 100 * x / total if total else 0)
        return dict(self.seconds)
