"""Wall time of the stages of a plan."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def stage_profile(spark: SparkSession, stages: list[tuple[str, Callable[[], DataFrame]]], runs: int = 3) -> DataFrame:
    """(stage, position int, ms, pct): the mean time to make all rows of each stage, and its share. A stage includes none of the others: give it inputs that are made already."""
    times = []
    for name, make in stages:
        began = time.perf_counter()
        for _ in range(runs):
            make().write.format("noop").mode("overwrite").save()
        times.append((name, 1000 * (time.perf_counter() - began) / runs))
    total = sum(t for _, t in times) or 1.0
    return spark.createDataFrame([(name, i, t, 100 * t / total) for i, (name, t) in enumerate(times)], "stage string, position int, ms double, pct double")
