"""A table of what was found in each text, written once, and the rollups that start from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.functions import severity
from textguard.operators import evasion, guard
from textguard.operators.fence import fenced
from textguard.rules import validated

ROLLUPS = ("category", "severity", "framework", "provider", "technique")


def table_of(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """``keys`` and, per text, its personal data, secrets and evasion techniques without their values.

    One projection; the texts are read once and do not go on.
    """
    seen = evasion.with_evasion(guard.with_personal_and_secrets(df.select(*keys, text), text), text)
    part = lambda c, *names: F.transform(c, lambda x: F.struct(*[x[n].alias(n) for n in names])).alias(c)
    techniques = F.transform("evasion.matched", lambda x: F.struct(x["category"].alias("category"), x["name"].alias("name")))
    return seen.select(
        *keys, part("pii", "category", "severity"), part("secrets", "provider", "category", "severity"), techniques.alias("techniques")
    )


def _entries(corpus: str) -> Column:
    """All that a text counts for: (rollup, corpus, name), one entry for each finding and rollup."""
    frameworks = F.create_map(
        *[x for c, (_, fs, _) in validated.METADATA.items() for x in (F.lit(c), F.array(*[F.lit(f) for f in fs]))]
    )
    all_ = F.lit(None).cast("string")

    def entry(rollup, where, *parts):
        name = F.concat_ws("/", *[p.cast("string") for p in parts])
        return F.struct(F.lit(rollup).alias("rollup"), where.alias("corpus"), name.alias("name"))

    own = F.col(corpus)
    return F.concat(
        F.transform("pii", lambda m: entry("category", all_, m["category"])),
        F.transform("pii", lambda m: entry("severity", own, severity.name_of(m["severity"]))),
        F.transform(
            F.flatten(F.transform("pii", lambda m: F.coalesce(F.element_at(frameworks, m["category"]), F.array().cast("array<string>")))),
            lambda f: entry("framework", own, f),
        ),
        F.transform("secrets", lambda s: entry("provider", all_, s["provider"], s["category"], s["severity"])),
        F.transform("techniques", lambda t: entry("technique", all_, t["category"], t["name"])),
        F.transform("techniques", lambda t: entry("technique", all_, t["category"], F.lit("*"))),
    )


def rollups(found: DataFrame, corpus: str = "corpus") -> DataFrame:
    """``(rollup, corpus, name, n, texts)`` from a findings table: findings and texts with one, by personal
    data category, by severity and framework per corpus, by secret provider and by evasion technique.

    A text's entries are counted in place, so one partial row per name and task is shuffled,
    in one shuffle for all rollups. ``corpus`` is null where a rollup is over all of them.
    """
    seen = fenced(found.select(_entries(corpus).alias("entries")), "entries")
    counted = F.transform(
        F.array_distinct("entries"),
        lambda e: F.struct(e["rollup"], e["corpus"], e["name"], F.size(F.filter("entries", lambda x: x.eqNullSafe(e))).alias("k")),
    )
    rows = seen.select(F.inline(counted).alias("rollup", "corpus", "name", "k"))
    return rows.groupBy("rollup", "corpus", "name").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("texts"))
