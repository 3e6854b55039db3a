"""Batches of files one after another give what one run over all gives."""

import pytest

from tidewater.plans import incremental
from tidewater.plans.incremental import Incremental
from tidewater.plans.stages import Settings

COLUMNS = ("time_window", "text", "user_id", "text_clean", "source_file")


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("text,time,user_id\n" + "".join(f"{t},{d},{u}\n" for t, d, u in rows))


def days(k):
    return f"2024-0{1 + k % 3}-1{k % 7} 00:00:00"


def state(inc):
    posts = sorted(tuple(r) for r in inc.read("posts").select(*COLUMNS).collect())
    return posts, sorted(tuple(r) for r in inc.read("window_terms").select("time_window", "word", "freq").collect()), [tuple(r) for r in inc.terms().select("word", "freq").collect()]


def fill(folder, batch):
    rows = [(f"some words of post {batch}x{k} again", days(k), f"u{k}") for k in range(30)]
    if batch == 0:  # eager posts in January and March, few enough so far
        rows += [(f"eager thing number {k}", days(2 * k), "eager") for k in range(4)] + [("lonely post in May", "2024-05-01 00:00:00", "x"), ("no time at all", "never", "y"), ("ab", days(1), "z")]
    if batch == 1:  # and is a suspected bot now, by posts in February alone; May becomes large enough
        rows = [(f"eager thing again {k}", days(1), "eager") for k in range(4)] + [(f"more posts in May {k}", "2024-05-02 00:00:00", f"m{k}") for k in range(9)]
    write(folder, f"b{batch}.csv", rows)


@pytest.fixture
def settings():
    return Settings(min_docs=5, max_per_user=6, top_terms=10)


def test_batches_equal_one_run(spark, tmp_path, settings):
    step = Incremental(spark, f"file://{tmp_path}/step", settings)
    folder = tmp_path / "in"
    fill(folder, 0)
    assert step.update(f"file://{folder}/*.csv") == ["2024-01", "2024-02", "2024-03", "2024-05"]
    assert step.update(f"file://{folder}/*.csv") == []
    assert {r[0] for r in step.read("posts").select("time_window").collect()} == {"2024-01", "2024-02", "2024-03"}
    fill(folder, 1)
    assert step.update(f"file://{folder}/*.csv") == ["2024-01", "2024-02", "2024-03", "2024-05"]  # eager's rows go everywhere
    write(folder, "b2.csv", [("one more thing in May", "2024-05-03 00:00:00", "q")])
    assert step.update(f"file://{folder}/*.csv") == ["2024-05"]
    whole = Incremental(spark, f"file://{tmp_path}/whole", settings)
    whole.update(f"file://{folder}/*.csv")
    assert state(step) == state(whole) and "eager" not in {r[2] for r in state(step)[0]}
    (folder / "b2.csv").write_text("text,time,user_id\nlonger than it was before,2024-05-03 00:00:00,q\n")
    with pytest.raises(ValueError):
        step.update(f"file://{folder}/*.csv")


def test_a_broken_run_goes_on(spark, tmp_path, settings, monkeypatch):
    folder = tmp_path / "in"
    fill(folder, 0)
    step = Incremental(spark, f"file://{tmp_path}/step", settings)
    step.update(f"file://{folder}/*.csv")
    fill(folder, 1)
    # Broken after rows were stored, before the batch was committed.
    real = step.spark
    rows = step._cleaned(incremental.readers.read_posts(real, [f"file://{folder}/b1.csv"]))
    rows.limit(3).withColumn("batch", incremental.F.lit(1)).write.mode("append").partitionBy("time_window", "batch").parquet(f"{step.out}/store")
    assert step.batches() == [0]
    # And again after the commit, before posts were made.
    assert step.take(f"file://{folder}/*.csv") == 1 and step.done() == 0
    again = Incremental(spark, step.out, settings)
    assert again.update(f"file://{folder}/*.csv") and again.done() == 1
    whole = Incremental(spark, f"file://{tmp_path}/whole", settings)
    whole.update(f"file://{folder}/*.csv")
    assert state(again) == state(whole)
