"""Continuous scan, routing and counting of traffic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.functions.text import fingerprint
from textguard.operators import audit, cache, evaluate, guard, policy, scan


def live_findings(traffic: DataFrame, keys: list[str]) -> DataFrame:
    """Rule findings of each body as it arrives; stateless, so append only."""
    return scan.findings(traffic, keys)


def live_decisions(traffic: DataFrame, rule: policy.Policy = policy.Policy()) -> DataFrame:
    """Traffic with its summary and block decision."""
    return policy.with_decision(guard.with_summary(traffic), rule, "direction")


def route(path: str) -> Callable[[DataFrame, int], None]:
    """Splits each micro-batch into allowed, blocked and audit tables.

    The decided rows are kept for the three writes, so they are scanned once.
    """

    def write(rows: DataFrame, batch: int) -> None:
        rows.persist()
        try:
            body = ["conv_id", "turn", "ts", "direction", "host", "path"]
            put = lambda df, name: df.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")
            put(rows.where(~F.col("decision.blocked")).select(*body, "text"), "allowed")
            put(rows.where("decision.blocked").select(*body, "decision.reason"), "blocked")
            put(audit.audit_rows(rows, ["conv_id", "turn"]), "audit")
        finally:
            rows.unpersist()

    return write


def minute_counts(decided: DataFrame, window: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Traffic counters per window, direction and host, for update mode."""
    timed = decided.withWatermark("ts", delay).withColumn("w", F.window("ts", window))
    counts = audit.traffic_counts(timed, ["w", "direction", "host"])
    return counts.select(F.col("w.start").alias("start"), *[c for c in counts.columns if c != "w"])


def running_confusion(predictions: DataFrame) -> DataFrame:
    """Confusion counts per model version, for update mode; rates follow with
    ``evaluate.with_rates`` on what was put out."""
    return evaluate.confusion_counts(predictions, ["model_version"])


def with_late_labels(
    predictions: DataFrame, labels: DataFrame, key: str, within: str = "72 hours", delay: str = "1 hour",
    ts: str = "ts", label: str = "toxic",
) -> DataFrame:
    """Predictions with the label that comes for them ``within`` a time, as ``actual``.

    A join of two streams: a prediction waits in the state until its label comes or both
    watermarks have passed its time, and is put out without one then. A label that comes
    before the prediction or too late is none. Several labels in time give a row each.
    """
    truth = labels.select(F.col(key).alias("__key"), F.col(ts).alias("__at"), (F.col(label) == 1).alias("actual"))
    early, late = F.col(ts), F.col(ts) + F.expr(f"INTERVAL {within}")
    inside = (F.col(key) == F.col("__key")) & (F.col("__at") >= early) & (F.col("__at") <= late)
    waiting, coming = predictions.withWatermark(ts, delay), truth.withWatermark("__at", delay)
    return waiting.join(coming, inside, "left_outer").drop("__key", "__at")


def batch_counts(path: str, by: list[str]) -> Callable[[DataFrame, int], None]:
    """Writes each micro-batch's partial confusion counts under its id; a batch run again replaces its own."""

    def write(rows: DataFrame, batch: int) -> None:
        evaluate.label_counts(rows, by).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def total_counts(parts: DataFrame, by: list[str]) -> DataFrame:
    """Confusion counts over all micro-batches, from their partial counts."""
    return parts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "tn", "fp", "fn", "unlabelled")])


def with_earlier_results(path: str, key: str, job: Callable[[DataFrame], DataFrame], version: str) -> Callable[[DataFrame, int], None]:
    """Handles each micro-batch: every delivery with the results of its text, which a repeat
    has from the first one, whatever the batch. Written to ``path/results``, kept in ``path/known``."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.persist()
        try:
            found = cache.with_results(rows, key, job, f"{path}/known", version, batch)
            found.write.mode("overwrite").parquet(f"{path}/results/batch={batch}")
        finally:
            rows.unpersist()

    return write


def first_deliveries(traffic: DataFrame, delay: str = "24 hours") -> DataFrame:
    """Traffic without repeats of the same text within the delay.

    The state holds a 32-character hash and a time for each different text of the delay.
    """
    marked = traffic.withColumn("input_hash", fingerprint(F.col("text")))
    return marked.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["input_hash"])
