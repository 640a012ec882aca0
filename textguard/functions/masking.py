"""Redacted forms of values and of finding texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textguard.functions.validators import digits_of
from textguard.rules import secrets, validated

REDACTED = "[REDACTED]"


def prefix_of(category: Column) -> Column:
    table = F.create_map(*[F.lit(x) for c, (_, _, p) in validated.METADATA.items() for x in (c, p)])
    return F.coalesce(F.try_element_at(table, category), F.lit(REDACTED))


def pii_redaction(category: Column, value: Column) -> Column:
    """Category-specific redacted form of a personal value."""
    at = F.instr(value, "@")
    domain = F.substring(value, at + 1, F.length(value))
    digits, dialled = digits_of(value), F.regexp_replace(value, "[^0-9+]", "")
    return (
        F.when(
            category == "ssn",
            F.concat(prefix_of(category), F.when(F.length(value) >= 4, F.right(value, F.lit(4))).otherwise(F.lit("****"))),
        )
        .when(
            category == "credit_card",
            F.concat(
                F.lit("****-****-****-"),
                F.when(F.length(digits) >= 4, F.right(digits, F.lit(4))).otherwise(F.lit("****")),
            ),
        )
        .when(
            category == "email",
            F.when(at > 3, F.concat(F.left(value, F.lit(2)), F.lit("***@"), domain))
            .when(at > 1, F.concat(F.lit("***@"), domain))
            .otherwise(F.lit("***@***")),
        )
        .when(
            category == "phone",
            F.concat(
                prefix_of(category),
                F.when(F.length(dialled) >= 4, F.right(dialled, F.lit(4))).otherwise(F.lit("****")),
            ),
        )
        .otherwise(prefix_of(category))
    )


def provider_of(value: Column) -> Column:
    """Issuer of a credential, read off its upper-cased value."""
    upper = F.upper(value)
    chain = None
    for mark, provider in secrets.PROVIDERS:
        chain = F.when(upper.contains(mark), provider) if chain is None else chain.when(upper.contains(mark), provider)
    return chain.otherwise(secrets.UNKNOWN_PROVIDER)


def secret_mask(category: Column, provider: Column) -> Column:
    """Placeholder naming the kind of credential, never a part of it."""
    kind = F.when(provider.isin("Unknown", "JWT", "Private Key"), category).otherwise(provider)
    return F.concat(F.lit("[MASKED-"), F.upper(F.regexp_replace(kind, "[_ ]", "-")), F.lit("]"))


def audit_text(category: Column, text: Column) -> Column:
    """What an audit row may show of a finding's text."""
    low = F.lower(category)
    return (
        F.when(F.coalesce(text, F.lit("")) == "", F.lit(""))
        .when((low == "secrets") | low.startswith("secret_"), F.lit(REDACTED))
        .when(
            low.startswith("pii"),
            F.when(F.length(text) < 4, F.lit(REDACTED)).otherwise(
                F.concat(F.left(text, F.lit(2)), F.lit("***"), F.right(text, F.lit(2)))
            ),
        )
        .otherwise(text)
    )
