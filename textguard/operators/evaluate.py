"""Calibration and quality figures of scores against ground truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.operators.running import PART, above, running_totals, totals_within

# Margin above the highest benign score, and the least threshold.
MARGIN, FLOOR = 0.05, 0.5


def paired(scores: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Scores with their ground truth as ``actual``; unlabelled rows drop out."""
    truth = labels.select(key, (F.col(label) == 1).alias("actual"))
    return scores.join(truth, key, "inner")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _counts() -> list[Column]:
    p, a = F.col("is_threat"), F.col("actual")
    return [
        F.count(F.when(p & a, 1)).alias("tp"),
        F.count(F.when(~p & ~a, 1)).alias("tn"),
        F.count(F.when(p & ~a, 1)).alias("fp"),
        F.count(F.when(~p & a, 1)).alias("fn"),
    ]


def confusion_counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """True and false positives and negatives of ``is_threat`` vs ``actual``."""
    return df.groupBy(*by).agg(*_counts())


def with_rates(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1; zero where a denominator is zero."""
    precision = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    rated = counts.withColumns(
        {"precision": precision, "recall": recall, "total": F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")}
    )
    f1 = _ratio(F.col("precision") * 2 * F.col("recall"), F.col("precision") + F.col("recall"))
    return rated.withColumn("f1", f1)


def label_counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and the rows without a label, as partial counts that add up."""
    return df.groupBy(*by).agg(*_counts(), F.count(F.when(F.col("actual").isNull(), 1)).alias("unlabelled"))


def metrics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return with_rates(confusion_counts(df, by))


def _by_score(df: DataFrame, score: str, actual: str) -> DataFrame:
    return df.groupBy(F.col(score).alias("score")).agg(
        F.count(F.when(F.col(actual), 1)).alias("pos"), F.count(F.when(~F.col(actual), 1)).alias("neg")
    )


def roc_points(df: DataFrame, score: str = "score", actual: str = "actual") -> DataFrame:
    """Per distinct score: positives, negatives and both totals from the top."""
    return running_totals(_by_score(df, score, actual), "score", ["pos", "neg"])


def auroc(df: DataFrame, score: str = "score", actual: str = "actual") -> DataFrame:
    """Area under the ROC curve by trapezoids over the distinct scores."""
    return area(_by_score(df, score, actual))


def area(grouped: DataFrame) -> DataFrame:
    """Area under the curve of one row per score, with its ``pos`` and ``neg``.

    Each sorted partition gives the area under its own totals; the positives above it raise
    that by a rectangle, so one row per partition is all that meets. Areas are exact decimals.
    """
    wide = lambda c: c.cast("decimal(18,0)")
    own = F.sum(wide(F.col("neg")) * wide(F.col("cum_pos") * 2 - F.col("pos")))
    rows = totals_within(grouped, "score", ["pos"])
    parts = rows.groupBy(PART).agg(own.alias("own"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    raised = parts.select("p", "n", (F.col("own") + wide(above("p") * 2) * wide(F.col("n"))).alias("area"))
    sums = raised.agg(F.sum("area").cast("double").alias("area"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    p, n = F.coalesce("p", F.lit(0)), F.coalesce("n", F.lit(0))
    value = F.when(p == 0, 0.0).when(n == 0, 1.0).otherwise(F.col("area") / (p.cast("double") * n * 2.0))
    return sums.select(
        p.alias("positives"), n.alias("negatives"), F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0)).alias("auroc")
    )


def calibrate(benign: DataFrame, score: str = "score", threshold: float = 0.7) -> DataFrame:
    """Threshold with no false positive on benign scores, and what the old one
    would have let through. No rows give the least threshold and rate zero."""
    s = F.col(score)
    top = F.greatest(F.coalesce(F.max(s), F.lit(0.0)), F.lit(0.0))
    n, hits = F.count(F.lit(1)), F.count(F.when(s >= threshold, 1))
    return benign.agg(
        F.greatest(top + MARGIN, F.lit(FLOOR)).alias("threshold"),
        top.alias("max_benign_score"),
        F.lit(MARGIN).alias("margin"),
        n.alias("benign_samples"),
        hits.alias("false_positives"),
        _ratio(hits, n).alias("fpr"),
    )
