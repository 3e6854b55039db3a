"""Growth, trends, emotion gaps, convergence, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import text as tx
from tidewater.operators.observe import OUTLIER, dense
from tidewater.plans.storage import stored


def growth(obs: DataFrame) -> DataFrame:
    """time_window, meta_strategy, n, growth on the dense grid: 0 -> n is infinite, 0 -> 0 and the first window null."""
    w = Window.partitionBy("meta_strategy").orderBy("time_window")
    d = dense(obs).select("time_window", "meta_strategy", "n").withColumn("prev", F.lag("n").over(w))
    change = F.when(F.col("prev").isNull(), None).when((F.col("prev") == 0) & (F.col("n") > 0), F.lit(float("inf"))).when(F.col("prev") == 0, None).otherwise(F.col("n") / F.when(F.col("prev") != 0, F.col("prev")) - 1)
    return d.withColumn("growth", change).drop("prev")


def snowball(obs: DataFrame, least: float = 0.10) -> DataFrame:
    """meta_strategy, mean_growth of strategies (outliers aside) that grow by more than ``least`` on average."""
    mean = growth(obs).groupBy("meta_strategy").agg(F.avg("growth").alias("mean_growth"))
    return mean.filter((F.col("mean_growth") > least) & (F.col("meta_strategy") != OUTLIER))


def trends(metrics: DataFrame, columns: list[str], order: str = "window") -> DataFrame:
    """metric, slope of the least-squares line over the windows in order; none for fewer than two windows."""
    # One row a window: the ordering window is as small as the table of windows.
    placed = metrics.withColumn("_x", (F.row_number().over(Window.orderBy(order)) - 1).cast("double"))
    flat = placed.unpivot(["_x"], [F.col(c).cast("double").alias(c) for c in columns], "metric", "value")
    return flat.groupBy("metric").agg(F.regr_slope("value", "_x").alias("slope"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")


def homogenisation(metrics: DataFrame, density: str = "density", clustering: str = "avg_clustering", order: str = "window") -> DataFrame:
    """density_slope, clustering_slope, is_homogenising (both rise): one row; nulls for fewer than two windows."""
    slope = lambda c: F.max(F.when(F.col("metric") == c, F.col("slope")))
    got = trends(metrics, [density, clustering], order).agg(slope(density).alias("density_slope"), slope(clustering).alias("clustering_slope"))
    return got.withColumn("is_homogenising", (F.col("density_slope") > 0) & (F.col("clustering_slope") > 0))


def common_strategies(sim: DataFrame) -> DataFrame:
    """meta_strategy: those (outliers aside) that have an initial and a final share."""
    named = sim.filter(F.col("meta_strategy") != OUTLIER)
    return named.filter("initial is not null").select("meta_strategy").intersect(named.filter("final is not null").select("meta_strategy"))


def arousal_gap(means: DataFrame) -> DataFrame:
    """science, shortcut, gap: unweighted mean arousal of the strategies of each class by name; null where there are none."""
    cls = tx.name_class(F.col("meta_strategy"))
    mean = lambda c: F.avg(F.when(cls == c, F.col("arousal")))
    return means.agg(mean("science").alias("science"), mean("shortcut").alias("shortcut")).withColumn("gap", F.col("shortcut") - F.col("science"))


def variance_change(sim: DataFrame) -> DataFrame:
    """initial_variance, final_variance, variance_change, verdict: mean over windows of more than one strategy of the population variance of shares."""
    per = sim.groupBy("time_window").agg(F.var_pop("initial").alias("vi"), F.var_pop("final").alias("vf"), F.count("*").alias("k")).filter("k > 1")
    got = per.agg(F.avg("vi").alias("initial_variance"), F.avg("vf").alias("final_variance")).withColumn("variance_change", F.col("final_variance") - F.col("initial_variance"))
    verdict = F.when(F.col("final_variance") > 1.1 * F.col("initial_variance"), "diverging").when(F.col("final_variance") < 0.9 * F.col("initial_variance"), "levelling").when(F.col("final_variance").isNotNull(), "stable")
    return got.withColumn("verdict", verdict)


def diversity_band(equilibria: DataFrame) -> DataFrame:
    """avg_diversity, band: low under 0.5, middle under 0.8, else high."""
    got = equilibria.agg(F.avg("diversity").alias("avg_diversity"))
    return got.withColumn("band", F.when(F.col("avg_diversity") < 0.5, "low").when(F.col("avg_diversity") < 0.8, "middle").when(F.col("avg_diversity").isNotNull(), "high"))


#: Bins of a round of ``order_statistics``, and values that are few enough to be looked at.
BINS, FEW = 1024, 4096


def order_statistics(flat: DataFrame, ranks: dict[str, list[int]]) -> dict[tuple[str, int], float]:
    """(metric, rank) -> the value with so many others before it in order; ``flat`` has metric and value without nulls, NaN is the greatest.

    Each round counts the values between the bounds of each rank's range in ``BINS`` equal bins, with the least and the greatest of each; the bin that holds the rank
    becomes its range. Ranges narrow until one value is left or few: those are then read. A round is one aggregation whose result is bins, so neither a task
    nor the driver holds a metric.
    """
    spark = flat.sparkSession
    ends = {r["metric"]: r for r in flat.groupBy("metric").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n")).collect()}
    out: dict[tuple[str, int], float] = {}
    # (metric, rank) -> least and greatest value of its range, values before it, values in it
    open_ = {(m, r): (ends[m]["lo"], ends[m]["hi"], 0, ends[m]["n"]) for m, rs in ranks.items() for r in rs}
    same = lambda lo, hi: lo == hi or lo != lo and hi != hi
    stalled: set[tuple[str, int]] = set()
    while open_:
        for k, (lo, hi, _, _) in list(open_.items()):
            if same(lo, hi):
                out[k] = lo
                del open_[k]
        wide = {k: v for k, v in open_.items() if v[3] > FEW and k not in stalled}
        if not wide:
            break
        # Half of each bound, so that the width is finite; infinite values and NaN have the bins at the ends.
        table = spark.createDataFrame([(m, r, lo, hi, max(lo, -1.7e308) / 2, ((1.7e308 if hi != hi else min(hi, 1.7e308)) / 2 - max(lo, -1.7e308) / 2) / BINS) for (m, r), (lo, hi, _, _) in wide.items()], "m string, r long, lo double, hi double, base double, width double")
        met = flat.join(F.broadcast(table), (F.col("metric") == F.col("m")) & F.col("value").between(F.col("lo"), F.col("hi")))
        place = F.floor(F.try_divide(F.greatest(F.least("value", F.lit(1.7e308)), F.lit(-1.7e308)) / 2 - F.col("base"), F.col("width")))
        bin_ = F.when(F.isnan("value"), BINS + 1).when(F.col("value") > 1.7e308, BINS).otherwise(F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.coalesce(place, F.lit(0)))))
        rows = met.groupBy("m", "r", bin_.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).collect()
        bins: dict[tuple[str, int], list] = {}
        for r in rows:
            bins.setdefault((r["m"], r["r"]), []).append((r["bin"], r["n"], r["lo"], r["hi"]))
        for k, (_, _, before, n) in wide.items():
            for _, held, lo, hi in sorted(bins[k], key=lambda x: x[0]):
                if k[1] < before + held:
                    if held == n:
                        stalled.add(k)
                    open_[k] = (lo, hi, before, held)
                    break
                before += held
    if open_:
        # Few values each; a range that bins don't divide has its different values counted.
        table = spark.createDataFrame([(m, r, lo, hi) for (m, r), (lo, hi, _, _) in open_.items()], "m string, r long, lo double, hi double")
        met = flat.join(F.broadcast(table), (F.col("metric") == F.col("m")) & F.col("value").between(F.col("lo"), F.col("hi")))
        counts = met.groupBy("m", "r", "value").agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("m", "r").orderBy("value"))
        before = spark.createDataFrame([(m, r, b) for (m, r), (_, _, b, _) in open_.items()], "m string, r long, before long")
        hit = counts.withColumn("upto", upto).join(F.broadcast(before), ["m", "r"]).filter((F.col("r") >= F.col("before") + F.col("upto") - F.col("n")) & (F.col("r") < F.col("before") + F.col("upto")))
        out |= {(x["m"], x["r"]): x["value"] for x in hit.collect()}
    return out


def describe(df: DataFrame, columns: list[str], accuracy: int | None = None) -> DataFrame:
    """metric, n, mean, std, min, p25, p50, p75, max; quartiles interpolate.

    Quartiles are exact (``order_statistics``). With ``accuracy`` they are values of the data whose rank is within n / accuracy of the
    right one, from sketches of bounded size, in one pass.
    """
    flat = df.unpivot([], [F.col(c).cast("double").alias(c) for c in columns], "metric", "value")
    v, shares = "value", (0.25, 0.5, 0.75)
    sums = [F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")]
    if accuracy is not None:
        return flat.groupBy("metric").agg(*sums[:4], *[F.percentile_approx(v, x, accuracy).alias(f"p{round(100 * x)}") for x in shares], sums[4])
    some = stored(flat.filter(F.col(v).isNotNull()))
    sizes = {r["metric"]: r["n"] for r in some.groupBy("metric").agg(F.count("*").alias("n")).collect()}  # a row a metric
    at = {m: [x * (n - 1) for x in shares] for m, n in sizes.items()}
    found = order_statistics(some, {m: sorted({int(p) for p in ps} | {min(int(p) + 1, sizes[m] - 1) for p in ps}) for m, ps in at.items()})

    def between(m: str, p: float) -> float:
        low, part = found[m, int(p)], p - int(p)
        return low if not part else low * (1 - part) + found[m, int(p) + 1] * part

    quartiles = df.sparkSession.createDataFrame([(m, *[between(m, p) for p in ps]) for m, ps in at.items()], "q_metric string, p25 double, p50 double, p75 double")
    got = flat.groupBy("metric").agg(*sums).join(F.broadcast(quartiles), F.col("metric") == F.col("q_metric"), "left")
    return got.select("metric", "n", "mean", "std", "min", "p25", "p50", "p75", "max")


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """bin (1 to ``bins``), n: equal widths from least to greatest value, which is in the last bin; all in bin 1 if they are equal."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    x = df.select(F.col(column).cast("double").alias("x")).filter("x is not null").crossJoin(F.broadcast(ends))  # one row
    width = F.col("hi") - F.col("lo")
    place = F.when(width == 0, 1).otherwise(F.least(F.lit(bins), F.floor((F.col("x") - F.col("lo")) / F.when(width != 0, width) * bins) + 1))
    return x.select(place.cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def report_scalars(df: DataFrame, window: str = "time_window", strategy: str = "meta_strategy") -> DataFrame:
    """n_rows, n_windows, n_strategies, n_extra (strategies less three)."""
    return df.agg(F.count("*").alias("n_rows"), F.countDistinct(window).alias("n_windows"), F.countDistinct(strategy).alias("n_strategies"), (F.countDistinct(strategy) - 3).alias("n_extra"))
