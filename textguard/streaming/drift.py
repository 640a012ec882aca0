"""Drift of a stream of values against a fixed baseline, window by window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.operators import drift

KEYS = ["feature", "start", "bin"]


def windowed_bins(
    values: DataFrame, base: DataFrame, window: str = "1 hour", delay: str = "1 hour",
    feature: str = "feature", value: str = "value", ts: str = "ts",
) -> DataFrame:
    """Bin counts per feature and window, for update mode. A tumbling window is
    the reset after each check."""
    timed = values.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    placed = drift.binned(timed, base, feature, value).withColumn("bin", F.coalesce("bin", F.lit(-1)))
    counts = placed.groupBy("feature", F.window(ts, window).alias("w"), "bin").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("feature", F.col("w.start").alias("start"), "bin", "n")


def checks(base: DataFrame, counts: DataFrame) -> DataFrame:
    """Drift per feature and window from the latest bin counts."""
    return drift.check(base, counts, ("start",))
