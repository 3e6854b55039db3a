"""python -m tidewater --input 'posts/*.csv' --output results [--stage 0,1,2] [--skip-stage 3] [--lexicon words.json]"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidewater.functions.lexicon import read_lexicon
from tidewater.plans.stages import Pipeline, Settings
from tidewater.sources.readers import read_posts


def numbers(text: str) -> list[int]:
    return [int(x) for x in text.split(",") if x.strip()]


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidewater", description=__doc__)
    p.add_argument("--input", help="glob of CSV files of posts (stages 0 and 1)")
    p.add_argument("--lexicon", help="JSON of keyword lists by category; stage 0 needs it")
    p.add_argument("--output", required=True)
    p.add_argument("--all", action="store_true", help="all stages, screening too if there is a lexicon")
    p.add_argument("--stage", type=numbers, default=[1, 2, 3, 4, 5])
    p.add_argument("--skip-stage", type=numbers, default=[])
    p.add_argument("--unit", choices=["M", "W", "D"], default="M")
    p.add_argument("--min-docs", type=int, default=100)
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(levelname)s %(message)s")
    spark = SparkSession.builder.getOrCreate()
    posts = None
    if a.input:
        posts = read_posts(spark, a.input)
        if "post_id" not in posts.columns:
            # An id from the row's content, the same in every attempt of a task.
            posts = posts.withColumn("post_id", F.xxhash64(*posts.columns))
    stages = ([0] if a.lexicon else []) + [1, 2, 3, 4, 5] if a.all else a.stage
    Pipeline(spark, a.output, Settings(unit=a.unit, min_docs=a.min_docs, lexicon=read_lexicon(a.lexicon) if a.lexicon else None)).run(posts, stages, a.skip_stage)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
