"""Stage 1 kept up to date as files arrive: only the windows that new files touch are made again.

Folders under ``out``:

* ``store/time_window=W/batch=N``: cleaned rows of the files of batch N, those without a readable time in window ``none``;
* ``manifest/batch=N``: the files of batch N, written last: a batch without it never happened, and what it left is removed by the next run;
* ``posts/time_window=W`` and ``window_terms/time_window=W``: the stage's rows and its term counts, overwritten a window at a time;
* ``done/N``: posts and terms hold all batches up to N. A run that broke before it goes on from there.

A batch touches the windows of its rows, and those of users whom it makes suspected bots, as their rows elsewhere go. Results are those of one run over all files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import math as mx
from tidewater.functions import text as tx
from tidewater.operators import screening, segmentation, temporal, terms
from tidewater.plans.stages import Settings, known_words
from tidewater.plans.storage import stored
from tidewater.sources import readers

NONE = "none"


class Incremental:
    """Posts and term counts of the files of a glob."""

    def __init__(self, spark: SparkSession, out: str, settings: Settings | None = None):
        self.spark, self.out, self.settings = spark, out.rstrip("/"), settings or Settings()

    # Files

    def _path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.out, *names]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *names: str) -> list[str]:
        fs, path = self._fs(), self._path(*names)
        return [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []

    def batches(self) -> list[int]:
        """Numbers of the batches that were committed."""
        found = [int(x.removeprefix("batch=")) for x in self._names("manifest") if x.startswith("batch=")]
        return sorted(n for n in found if "_SUCCESS" in self._names("manifest", f"batch={n}"))

    def done(self) -> int:
        return max((int(x) for x in self._names("done") if x.isdigit()), default=-1)

    def _listed(self, glob: str) -> dict[str, int]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(glob)
        found = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(p) or []
        return {x.getPath().toString(): x.getLen() for x in found if x.isFile()}

    # Rows

    def _user(self, df: DataFrame) -> str | None:
        return screening.first_column(df.columns, self.settings.user)

    def _cleaned(self, df: DataFrame) -> DataFrame:
        """Rows of stage 1 before bots and small windows go, with time_window."""
        s = self.settings
        clean = temporal.drop_short(df.withColumn("text_clean", tx.clean_text(F.col(screening.first_column(df.columns, s.text, required=True)))), "text_clean")
        c = s.time_col if s.time_col in df.columns else screening.first_column(df.columns, temporal.TIME_COLUMNS)
        window = F.coalesce(mx.period(mx.to_time(F.col(c)), s.unit), F.lit(NONE)) if c else F.lit("0")
        return clean.withColumn("time_window", window)

    def store(self) -> DataFrame:
        """All rows of committed batches, with time_window and batch."""
        return self.spark.read.option("mergeSchema", True).parquet(f"{self.out}/store").withColumn("time_window", F.col("time_window").cast("string")).filter(F.col("batch").isin(self.batches()))

    def read(self, name: str) -> DataFrame:
        """posts or window_terms."""
        return self.spark.read.option("mergeSchema", True).parquet(f"{self.out}/{name}").withColumn("time_window", F.col("time_window").cast("string"))

    def terms(self) -> DataFrame:
        """word, freq: the most frequent words over all windows."""
        sums = self.read("window_terms").groupBy("word").agg(F.sum("freq").alias("freq"))
        return screening.top(sums, "freq", "word", self.settings.top_terms)

    # Steps

    def take(self, glob: str) -> int | None:
        """Stores the files of ``glob`` that no batch has as a new batch; its number, None if there are none."""
        files, known = self._listed(glob), {}
        for n in self.batches():
            known |= {r["path"]: r["size"] for r in self.spark.read.parquet(f"{self.out}/manifest/batch={n}").collect()}  # a row a file
        changed = sorted(p for p, size in files.items() if known.get(p, size) != size)
        if changed:
            raise ValueError(f"files changed after they were taken: {changed[:3]}")
        new = sorted(set(files) - set(known))
        if not new:
            return None
        n = max(self.batches(), default=-1) + 1
        fs = self._fs()
        for w in self._names("store"):  # what a broken run left of this batch
            fs.delete(self._path("store", w, f"batch={n}"), True)
        rows = self._cleaned(readers.read_posts(self.spark, new)).withColumn("batch", F.lit(n))
        rows.write.mode("append").partitionBy("time_window", "batch").parquet(f"{self.out}/store")
        self.spark.createDataFrame([(p, files[p]) for p in new], "path string, size long").coalesce(1).write.mode("overwrite").parquet(f"{self.out}/manifest/batch={n}")
        return n

    def touched(self) -> list[str]:
        """The windows that batches after the last done one have to do with."""
        rows, done = self.store(), self.done()
        own = rows.filter(F.col("batch") > done).select("time_window")
        user = self._user(rows)
        if user and done >= 0:
            counts = rows.groupBy(user).agg(F.count(user).alias("n"), F.count(F.when(F.col("batch") <= done, F.col(user))).alias("before"))
            fresh = counts.filter((F.col("n") > self.settings.max_per_user) & (F.col("before") <= self.settings.max_per_user)).select(user)
            own = own.unionByName(rows.join(fresh, user, "left_semi").select("time_window"))
        return sorted(r[0] for r in own.distinct().collect() if r[0] != NONE)  # windows

    def refresh(self) -> list[str]:
        """Makes posts and terms of the touched windows again; their names."""
        if not self.batches() or self.done() == self.batches()[-1]:
            return []
        s, last, windows = self.settings, self.batches()[-1], self.touched()
        rows = self.store()
        own = rows.filter(F.col("time_window").isin(windows))
        user = self._user(rows)
        if user:  # counts need the user column of all rows only
            busy = rows.groupBy(user).agg(F.count(user).alias("_n")).filter(F.col("_n") > s.max_per_user).select(user)
            own = own.join(busy, user, "left_anti")
        if windows != ["0"]:
            full = temporal.window_counts(own).filter(F.col("n") >= s.min_docs).select("time_window")
            own = own.join(full, "time_window", "left_semi")
        posts = stored(own.drop("batch"))
        split = segmentation.lattice_segmenter({w: 1 for w in known_words(s)}) if s.words is not None else None
        words = posts.select("time_window", terms.words_of("text_clean", terms.lx.STOP_WORDS, split=split).alias("w")).select("time_window", F.explode("w").alias("word"))
        counts = words.groupBy("time_window", "word").agg(F.count("*").alias("freq"))
        fs, left = self._fs(), {r[0] for r in posts.select("time_window").distinct().collect()}
        for name, df in (("posts", posts), ("window_terms", counts)):
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("time_window").parquet(f"{self.out}/{name}")
            for w in windows:  # a window that lost all its rows
                if w not in left:
                    escaped = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(w)
                    fs.delete(self._path(name, f"time_window={escaped}"), True)
        fs.create(self._path("done", str(last)), True).close()
        return windows

    def update(self, glob: str) -> list[str]:
        """Takes new files and brings posts and terms up to date; the windows that were made again."""
        self.take(glob)
        return self.refresh()
