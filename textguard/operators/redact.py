"""Redaction of personal data and secrets, with an audit of what was replaced."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.functions import spans
from textguard.functions.dialect import to_java
from textguard.operators.fence import fenced
from textguard.operators.guard import with_pii, with_secrets

# Categories with a switch of their own; the rest share one.
SWITCHED = ("ssn", "credit_card", "email", "phone", "health_info")
# What value redaction covers, personal data and secrets.
VALUE_PII = ("ssn", "email", "phone", "credit_card")
VALUE_SECRETS = ("api_key", "aws_key", "password", "bearer_token", "jwt")
PLACEHOLDER, HASHED = "[REDACTED]", "[HASH]"


@dataclass(frozen=True)
class Redaction:
    """Span redaction by category; ``others`` covers categories without an own
    switch; ``replacements`` are extra pattern -> text rules."""

    categories: Sequence[str] = SWITCHED
    others: bool = False
    replacements: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class ValueRedaction:
    """Value redaction: ``strategy`` is placeholder, asterisks or hash unless a
    fixed ``replace_with`` is given."""

    strategy: str = "placeholder"
    replace_with: str = ""
    pii: Sequence[str] = VALUE_PII
    secrets: Sequence[str] = VALUE_SECRETS


def redact_spans(
    df: DataFrame, text: str = "text", policy: Redaction = Redaction(), into: str = "redacted",
    audit: str | None = None,
) -> DataFrame:
    """Adds the text with each enabled finding replaced by its masked form.

    Overlapping findings: the one that starts first, then the longer, wins.
    """
    found = with_pii(df, text, "__pii")
    chosen = F.filter(
        "__pii",
        lambda m: m["category"].isin(*policy.categories)
        | (F.lit(policy.others) & ~m["category"].isin(*SWITCHED)),
    )
    put = F.transform(chosen, _span(lambda m: m["redacted"]))
    out = fenced(found.withColumn("__kept", spans.disjoint(put)), "__kept").withColumn(
        into, spans.rebuilt(F.coalesce(F.col(text), F.lit("")), F.col("__kept"))
    )
    for pattern, replacement in policy.replacements.items():
        out = out.withColumn(into, F.regexp_replace(F.col(into), F.lit(to_java(pattern)), F.lit(replacement)))
    if audit:
        out = out.withColumn(audit, F.col("__kept"))
    return out.drop("__pii", "__kept")


def _span(put, category=lambda m: m["category"]):
    return lambda m: F.struct(
        m["start"].alias("start"), m["end"].alias("end"), put(m).alias("put"), category(m).alias("category")
    )


def mask_secrets(df: DataFrame, text: str = "text", into: str = "masked") -> DataFrame:
    """Adds the text with every secret replaced by its mask."""
    found = with_secrets(df, text, "__secrets")
    kept = spans.disjoint(F.transform("__secrets", _span(lambda m: m["value"])))
    return (
        fenced(found.withColumn("__kept", kept), "__kept")
        .withColumn(into, spans.rebuilt(F.coalesce(F.col(text), F.lit("")), F.col("__kept")))
        .drop("__secrets", "__kept")
    )


def _replacement(policy: ValueRedaction, length: Column) -> Column:
    if policy.replace_with:
        return F.lit(policy.replace_with)
    if policy.strategy == "asterisks":
        return F.repeat(F.lit("*"), length)
    return F.lit(HASHED if policy.strategy == "hash" else PLACEHOLDER)


def redact_values(
    df: DataFrame, text: str = "text", policy: ValueRedaction = ValueRedaction(), into: str = "redacted"
) -> DataFrame:
    """Adds the text with every occurrence of each found value replaced, then
    with the found secrets replaced where they stand."""
    start = F.coalesce(F.col(text), F.lit(""))
    if policy.pii:
        found = with_pii(df, text, "__pii")
        chosen = F.filter("__pii", lambda m: m["category"].isin(*policy.pii))
        values = F.array_distinct(F.transform(chosen, lambda m: m["value"]))
        put = lambda acc, v: F.replace(acc, v, _replacement(policy, F.octet_length(v).cast("int")))
        staged = fenced(found.withColumn("__body", F.aggregate(values, start, put)).drop("__pii"), "__body")
    else:
        staged = df.withColumn("__body", start)
    if not policy.secrets:
        return staged.withColumn(into, F.col("__body")).drop("__body")
    staged = with_secrets(staged, "__body", "__secrets")
    picked = F.filter("__secrets", lambda m: m["category"].isin(*policy.secrets))
    kept = spans.disjoint(F.transform(picked, _span(lambda m: _replacement(policy, m["end"] - m["start"]))))
    return (
        fenced(staged.withColumn("__kept", kept), "__kept")
        .withColumn(into, spans.rebuilt(F.col("__body"), F.col("__kept")))
        .drop("__body", "__secrets", "__kept")
    )


def redact_pii_only(df: DataFrame, text: str = "text", into: str = "redacted") -> DataFrame:
    return redact_values(df, text, ValueRedaction(secrets=()), into)


def redact_secrets_only(df: DataFrame, text: str = "text", into: str = "redacted") -> DataFrame:
    return redact_values(df, text, ValueRedaction(pii=()), into)


def redaction_audit(df: DataFrame, keys: Sequence[str], text: str = "text", policy: Redaction = Redaction()) -> DataFrame:
    """One row per replaced span: category, place and both lengths, no value."""
    from textguard.operators.scan import exploded

    rows = redact_spans(df, text, policy, "__out", "__audit").withColumn(
        "__audit",
        F.transform(
            "__audit",
            lambda m: F.struct(
                m["category"].alias("category"),
                m["start"].alias("position"),
                (m["end"] - m["start"]).alias("length"),
                F.length(m["put"]).alias("redacted_length"),
            ),
        ),
    )
    return exploded(rows, keys, "__audit")


def redaction_stats(audit: DataFrame) -> DataFrame:
    """Replaced spans and characters by category."""
    return audit.groupBy("category").agg(
        F.count(F.lit(1)).alias("total_redacted"), F.sum(F.col("length").cast("long")).alias("chars_redacted")
    )
