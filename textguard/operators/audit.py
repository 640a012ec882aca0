"""Audit rows without any scanned text, export events and traffic counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from textguard.functions import masking
from textguard.sources import log

SOURCE, VERSION = "textguard", "1"


def audit_rows(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Audit entries of summarized traffic: needs ``ts, direction, host, path,
    summary`` and optionally ``decision``; rows without a finding leave none.

    ``blocked`` is the guard's verdict, ``policy_blocked`` the policy's.
    """
    s = F.col("summary")
    results = s["results"]
    changed = F.exists(results, lambda r: masking.audit_text(r["category"], r["text"]) != r["text"])
    policy = F.col("decision.blocked") if "decision" in df.columns else F.lit(False)
    rows = df.select(
        *keys,
        F.col("ts").alias("timestamp"),
        "direction",
        "host",
        "path",
        s["total_detections"].alias("total_detections"),
        s["blocked"].alias("blocked"),
        policy.alias("policy_blocked"),
        changed.alias("redacted"),
        s["pii_categories"].alias("pii_categories"),
        s["secret_types"].alias("secret_types"),
        F.transform(results, lambda r: r["category"]).alias("categories"),
        F.transform(results, lambda r: r["severity"]).alias("severities"),
        F.transform(results, lambda r: r["rule"]).alias("rules"),
        s["ml_score"].alias("ml_score"),
    )
    return rows.where(F.col("total_detections") > 0)


def export_events(audit: DataFrame, source: str = SOURCE, version: str = VERSION) -> DataFrame:
    """Audit entries as stamped JSON events for another system to pick up.

    Empty lists and a score of zero are left out.
    """
    fields = [f for f in audit.schema if f.name not in ("redacted", "policy_blocked")]

    def shown(field):
        value = F.col(field.name)
        if isinstance(field.dataType, ArrayType):
            value = F.when(F.size(value) > 0, value)
        return (F.nullif(value, F.lit(0.0)) if field.name == "ml_score" else value).alias(field.name)

    stamped = F.struct(
        F.lit(source).alias("source"), F.lit(version).alias("version"), *[shown(f) for f in fields]
    )
    return audit.select(F.to_json(stamped, {"ignoreNullFields": "true"}).alias("event"))


def write_audit(audit: DataFrame, path: str, batch: str | int | None = None, file_bytes: int = log.BYTES) -> DataFrame:
    """Appends the entries as one committed batch of the log at ``path``, and gives all of the log.

    The same ``batch`` again replaces its entries; files stop growing at ``file_bytes``.
    """
    dated = audit.withColumn("date", F.to_date("timestamp"))
    log.append(dated, path, batch, file_bytes)
    return log.read(audit.sparkSession, path, dated.schema)


def traffic_counts(df: DataFrame, by: Sequence[str] = ("direction",)) -> DataFrame:
    """Counters of summarized and decided traffic in one pass."""
    s = F.col("summary")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("intercepted"),
        F.count(F.when(s["total_detections"] > 0, 1)).alias("detections"),
        F.count(F.when(F.col("decision.blocked"), 1)).alias("blocked"),
        F.count(F.when((s["total_detections"] > 0) & (s["ml_score"] > 0), 1)).alias("scored_nonzero"),
        F.coalesce(F.sum(s["total_detections"].cast("long")), F.lit(0)).alias("findings"),
    )
