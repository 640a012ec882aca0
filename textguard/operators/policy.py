"""Block decisions, block reports and editor view over a ``summary`` column."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.functions import severity
from textguard.operators.fence import fenced

# Defaults of a block policy.
STATUS = 403
MESSAGE = "Request blocked by policy"
# Fixed values: "secrets" is accepted for the guard's own "secret".
ALIASES = {"secrets": "secret"}
# Icon of a finding by category, then by rule.
ICONS = {
    "pii": "🔐",
    "pii-us-core": "🔐",
    "pii-us-extended": "🔐",
    "pii-financial": "💳",
    "pii-international": "🔐",
    "credit_card": "💳",
    "xss": "⚔️",
    "secrets": "🔑",
    "secret": "🔑",
    "prompt_injection": "🧠",
    "compliance": "📋",
    "ml_threat": "🧠",
}


@dataclass(frozen=True)
class Policy:
    """What blocks: mode, least severity, categories (empty means all) and the
    direction, ``both``, ``request`` or ``response``."""

    mode: str = "block"
    threshold: str = "high"
    categories: Sequence[str] = ()
    direction: str = "both"
    status: int = STATUS
    message: str = MESSAGE
    include_detections: bool = True


def first_blocking(results: Column, policy: Policy) -> Column:
    """First result in order that meets severity and category, else null."""
    wanted = {ALIASES.get(c, c) for c in policy.categories} | set(policy.categories)
    hit = lambda r: (
        severity.meets(r["severity"], policy.threshold) & (r["category"].isin(*wanted) if wanted else F.lit(True))
    )
    return F.get(F.filter(results, hit), F.lit(0))


def with_decision(
    df: DataFrame, policy: Policy = Policy(), direction: str | None = None, summary: str = "summary"
) -> DataFrame:
    """Adds ``decision`` (blocked, reason). ``direction`` names the column that
    tells requests from responses; without it every row is in scope."""
    results = F.col(summary)["results"]
    first = first_blocking(results, policy)
    scope = F.lit(policy.mode == "block")
    if direction and policy.direction != "both":
        scope = scope & (F.col(direction) == policy.direction)
    blocked = F.coalesce(scope & first.isNotNull(), F.lit(False))
    reason = F.when(blocked, F.concat(first["category"], F.lit(": "), first["text"])).otherwise(F.lit(""))
    decided = df.withColumn("decision", F.struct(blocked.alias("blocked"), reason.alias("reason")))
    return fenced(decided, "decision")


def highest_severity(results: Column) -> Column:
    """Name of the highest level among the results, ``low`` when there is none."""
    top = F.coalesce(F.array_max(F.transform(results, lambda r: severity.level(r["severity"]))), F.lit(1))
    return F.element_at(F.array(*[F.lit(n) for n in severity.LEVELS]), F.greatest(top, F.lit(1)))


def block_reports(
    df: DataFrame, keys: Sequence[str], policy: Policy = Policy(), direction: str = "direction",
    host: str = "host", path: str = "path",
) -> DataFrame:
    """One report row, with its JSON body, per blocked row of a decided table."""
    results = F.col("summary")["results"]
    shown = F.transform(
        results, lambda r: F.struct(*[r[c].alias(c) for c in ("category", "severity", "rule", "text", "confidence")])
    )
    fields = [
        F.col(direction).alias("direction"),
        F.col(host).alias("host"),
        F.col(path).alias("path"),
        F.lit(True).alias("blocked"),
        F.col("decision.reason").alias("reason"),
        highest_severity(results).alias("severity"),
        F.lit(policy.message or MESSAGE).alias("message"),
    ]
    body = F.to_json(F.struct(*fields, *([shown.alias("results")] if policy.include_detections else [])))
    return df.select(
        *keys, *fields, F.lit(policy.status or STATUS).alias("status"), body.alias("body"),
        F.col("decision.blocked").alias("__blocked"),
    ).where("__blocked").drop("__blocked")


def editor_findings(results: Column, min_severity: str = "medium", mode: str = "monitor") -> Column:
    """Display rows of the findings an editor shows: level, rule and message."""
    icons = F.create_map(*[F.lit(x) for c, i in ICONS.items() for x in (c, i)])

    def row(r):
        icon = F.coalesce(F.try_element_at(icons, r["category"]), F.try_element_at(icons, r["rule"]), F.lit(""))
        body = F.when(r["text"] != "", r["text"]).otherwise(
            F.concat(r["category"], F.lit(" detection"))
        )
        message = F.trim(F.concat_ws(" ", F.when(icon != "", icon), body))
        blocked = (F.lit(mode) == "block") & r["severity"].isin("critical", "high")
        kind = (
            F.when(r["severity"].isin("critical", "high"), "error")
            .when(r["severity"].isin("low", "info"), "hint")
            .otherwise("warning")
        )
        return F.struct(
            kind.alias("level"),
            r["rule"].alias("rule"),
            F.when(blocked, F.concat(message, F.lit(" [BLOCKED]"))).otherwise(message).alias("message"),
        )

    return F.transform(F.filter(results, lambda r: severity.meets_in_editor(r["severity"], min_severity)), row)


def threat_summary(types: Column) -> Column:
    """First three threat types, with an ellipsis from three on."""
    return F.concat(
        F.array_join(F.slice(types, 1, 3), ","), F.when(F.size(types) >= 3, ",...").otherwise(F.lit(""))
    )


def scan_outcomes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Outcome row of each text with a threat or a block, from ``verdict``."""
    v = F.col("verdict")
    types = F.transform(v["threats"], lambda t: t["type"])
    rows = df.select(
        *keys,
        F.when(~v["allowed"], "high").otherwise("medium").alias("event_severity"),
        F.size(v["threats"]).alias("threats"),
        F.size(v["pii"]).alias("pii"),
        F.size(v["secrets"]).alias("secrets"),
        F.size(v["xss"]).alias("xss"),
        F.size(v["compliance"]).alias("compliance"),
        v["allowed"].alias("allowed"),
        threat_summary(types).alias("summary"),
    )
    return rows.where((F.col("threats") > 0) | ~F.col("allowed"))
