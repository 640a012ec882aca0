"""Histograms of numeric features and drift of new values against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.session import written

# Bins, weight floor, level thresholds and history length.
BINS = 10
FLOOR = 0.0001
LEVELS = (("major", 0.5), ("significant", 0.25), ("minor", 0.1))
HISTORY = 1000


def baseline(df: DataFrame, feature: str = "feature", value: str = "value", bins: int = BINS) -> DataFrame:
    """One row per feature: size, mean, population deviation, the lower bounds of
    its equal-width bins and the count in each. Constant features get bins of
    width 1/n from 0.

    The values are read twice, once for the bounds and once for the counts, and the result is a
    written table that any number of checks start from. Bounds are a written table as well,
    so that Spark knows its size: values meet it in a broadcast join while it is small, and
    else in a sorted one that splits hot features.
    """
    v = F.col(value)
    values = df.where(v.isNotNull()).select(F.col(feature).alias("feature"), v.alias("v"))
    stats = values.groupBy("feature").agg(
        F.count(F.lit(1)).alias("count"), F.min("v").alias("low"), F.max("v").alias("high"),
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std_dev"),
    )
    width = (F.col("high") - F.col("low")) / F.lit(float(bins))
    ruled = stats.withColumn("width", width).withColumns(
        {
            "low": F.when(F.col("width") == 0, 0.0).otherwise(F.col("low")),
            "width": F.when(F.col("width") == 0, 1.0 / bins).otherwise(F.col("width")),
        }
    )
    ruled = written(ruled, "bounds")
    at = ((F.col("v") - F.col("low")) / F.col("width")).cast("long")
    placed = values.join(ruled.select("feature", "low", "width"), "feature").withColumn(
        "bin", F.greatest(F.least(at, F.lit(bins - 1)), F.lit(0)).cast("int")
    )
    counts = placed.groupBy("feature").agg(*[F.count_if(F.col("bin") == i).alias(f"b{i}") for i in range(bins)])
    index = F.sequence(F.lit(0), F.lit(bins - 1))
    whole = ruled.join(counts, "feature").select(
        "feature", "count", "mean", "std_dev", "low", "width",
        F.transform(index, lambda i: F.col("low") + i * F.col("width")).alias("lowers"),
        F.array(*[F.col(f"b{i}") for i in range(bins)]).alias("counts"),
    )
    return written(whole, "baseline")


def histogram(base: DataFrame) -> DataFrame:
    """Baseline rows as bins: bounds, count and weight; empty bins included."""
    zipped = F.arrays_zip("lowers", "counts")
    return base.select("feature", "low", "width", "count", F.posexplode(zipped).alias("bin", "b")).select(
        "feature",
        "bin",
        F.col("b.lowers").alias("lower"),
        (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("upper"),
        F.col("b.counts").alias("n"),
        (F.col("b.counts") / F.col("count")).alias("weight"),
    )


def bin_of(value: Column, lowers: Column) -> Column:
    """Bin of a new value under baseline bounds. The last bin takes everything
    above; a value below all bounds is read as a share of 0..1, and is null when
    that is no bin either."""
    n = F.size(lowers)
    inside = F.size(F.filter(lowers, lambda low: value >= low)) - 1
    share = (value * n).cast("long")
    below = F.when((share >= 0) & (share < n), share.cast("int"))
    return F.when(inside >= 0, inside).otherwise(below)


def binned(current: DataFrame, base: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """Current values with their baseline bin (null when dropped); features
    without a baseline drop out. The same for a table and for a stream."""
    rows = current.where(F.col(value).isNotNull()).withColumnRenamed(feature, "feature")
    joined = rows.join(base.select("feature", "lowers"), "feature")
    return joined.withColumn("bin", bin_of(F.col(value), F.col("lowers")))


def weights(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda c: F.greatest(c / total, F.lit(FLOOR)))


def psi(base: Column, current: Column) -> Column:
    """Population stability index of two weight arrays."""
    terms = F.zip_with(current, base, lambda c, b: (c - b) * F.log(c / b))
    return F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)


def kl_divergence(base: Column, current: Column) -> Column:
    """Divergence of the current weights from the baseline weights."""
    terms = F.zip_with(current, base, lambda c, b: c * F.log(c / b))
    return F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)


def level_of(value: Column) -> Column:
    chain = None
    for name, limit in LEVELS:
        chain = F.when(value >= limit, name) if chain is None else chain.when(value >= limit, name)
    return chain.otherwise("none")


def check(base: DataFrame, counted: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Drift per feature from binned counts (``feature, *by, bin, n``).

    Without ``by``, a feature with no current value stays, with index 0.
    """
    bins = F.map_from_entries(F.collect_list(F.struct("bin", "n")))
    # One entry per bin, so the list is bounded by the number of bins.
    per = counted.groupBy("feature", *by).agg(
        F.map_filter(bins, lambda k, _: k >= 0).alias("got"),
        F.coalesce(F.sum(F.when(F.col("bin") >= 0, F.col("n"))), F.lit(0)).alias("current_n"),
        F.coalesce(F.sum(F.when(F.col("bin") < 0, F.col("n"))), F.lit(0)).alias("dropped_n"),
    )
    joined = base.join(per, "feature", "inner" if by else "left")
    index = F.sequence(F.lit(0), F.size("counts") - 1)
    now = F.transform(index, lambda i: F.coalesce(F.try_element_at("got", i), F.lit(0)))
    empty = F.coalesce("current_n", F.lit(0)) == 0
    staged = joined.withColumns({"__b": weights(F.col("counts"), F.col("count")), "__c": weights(now, F.col("current_n"))})
    staged = staged.withColumn("psi", F.when(empty, 0.0).otherwise(psi(F.col("__b"), F.col("__c"))))
    return staged.select(
        "feature",
        *by,
        "psi",
        F.when(empty, 0.0).otherwise(kl_divergence(F.col("__b"), F.col("__c"))).alias("kl"),
        F.when(empty, "none").otherwise(level_of(F.col("psi"))).alias("level"),
        F.col("count").alias("baseline_n"),
        F.coalesce("current_n", F.lit(0)).alias("current_n"),
        F.coalesce("dropped_n", F.lit(0)).alias("dropped_n"),
    )


def bin_counts(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts per feature and bin of binned values; dropped ones go to bin -1."""
    return rows.groupBy("feature", *by, F.coalesce("bin", F.lit(-1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def record(base: DataFrame, rows: DataFrame, path: str, batch: int, feature: str = "feature", value: str = "value") -> None:
    """Writes the bin counts of one batch of values beside those of the others.

    Counts of batches add up, so no value is read again. A batch that is run again replaces
    what it wrote before.
    """
    counts = bin_counts(binned(rows, base, feature, value))
    counts.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def drift_so_far(base: DataFrame, path: str) -> DataFrame:
    """Drift of all recorded batches together, from their counts."""
    parts = base.sparkSession.read.schema("feature string, bin int, n long").option("recursiveFileLookup", "true").parquet(path)
    return check(base, parts.groupBy("feature", "bin").agg(F.sum("n").alias("n")))


def drift(base: DataFrame, current: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """Drift of current values against a baseline, one row per feature."""
    return check(base, bin_counts(binned(current, base, feature, value)))


def last_checks(history: DataFrame, n: int = HISTORY, ts: str = "ts") -> DataFrame:
    """The latest ``n`` checks; a top-k, not a full sort."""
    return history.orderBy(F.col(ts).desc(), "feature").limit(n)
