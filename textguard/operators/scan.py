"""One-pass rule scan: text in, an array of matches per row out.

The scan is a chain of projections and never shuffles. Each rule's pattern runs
only on texts that it matches, as RE2 tells for all rules beforehand; the
offsets of all rules are computed by one shared array expression.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.functions import spans
from textguard.functions.dialect import java_of
from textguard.functions.text import cut, markless, quoted
from textguard.operators.fence import fenced
from textguard.operators.present import rules_in
from textguard.rules import GATES, PACKS, rules_of
from textguard.rules.model import Gate, Rule
from textguard.session import ship

VALUE_LIMIT = 200
_FOUND, _SAFE, _HITS = "__found", "__safe", "__hits"


def with_present(df: DataFrame, text: str, rules: Iterable[tuple[int, Rule]]) -> DataFrame:
    """Adds the safe text and the numbers of those of the numbered ``rules`` that match it."""
    ship(df.sparkSession)
    safe = df.withColumn(_SAFE, markless(F.coalesce(F.col(text), F.lit(""))))
    return fenced(safe.withColumn(_FOUND, rules_in(F.col(_SAFE), list(rules))), _FOUND)


def where_present(n: int, value: str, otherwise: str = "NULL") -> str:
    """SQL for ``value`` where rule ``n`` matches, else ``otherwise``."""
    return f"CASE WHEN array_contains({_FOUND}, {n}S) THEN {value} ELSE {otherwise} END"


def hits_of(rows: Iterable[str], keep: str) -> Column:
    """Array of the per-rule structs for which ``keep`` (over ``h``) holds."""
    return F.expr(f"filter(array({', '.join(rows)}), h -> {keep})")


def with_matches(
    df: DataFrame,
    rules: Sequence[Rule],
    text: str = "text",
    into: str = "matches",
    gates: dict[str, Gate] = GATES,
) -> DataFrame:
    """Adds ``into``: all matches of ``rules`` sorted by start, then rule order."""
    columns = [F.col(c) for c in df.columns]
    tested = [(i, r) for i, r in enumerate(rules) if r.name in gates]
    parts = {i: spans.marked_parts(_SAFE, java_of(r.name, r.regex)) for i, r in enumerate(rules)}
    parts.update({i: where_present(i, parts[i]) for i, _ in tested})
    marked = [f"named_struct('n', {i}, 'parts', {p})" for i, p in sorted(parts.items())]
    hits = hits_of(marked, "size(h.parts) > 1")
    found = F.flatten(F.transform(F.col(_HITS), lambda h: spans.located(h["n"], h["parts"])))
    own = F.when(
        F.col(text).contains(spans.MARK),
        F.transform(
            found,
            lambda m: m.withField("value", F.substring(F.col(text), m["start"] + 1, m["end"] - m["start"])),
        ),
    ).otherwise(found)
    found_in = with_present(df, text, tested).select(*columns, hits.alias(_HITS))
    return fenced(found_in.select(*columns, F.array_sort(own).cast(spans.MATCH_TYPE).alias(into)), into)


def lookup(values: Sequence[str | int], n: Column) -> Column:
    """Constant of a rule by its number."""
    listed = ", ".join(quoted(v) if isinstance(v, str) else str(v) for v in values)
    return F.element_at(F.expr(f"array({listed})"), n + 1)


def scan(df: DataFrame, packs: Sequence[str] = (), text: str = "text") -> DataFrame:
    """Rule-layer scan with named matches: rule, pack, severity, value, offsets."""
    pairs = rules_of(*packs)
    named = F.transform(
        F.col("matches"),
        lambda m: F.struct(
            lookup([r.name for _, r in pairs], m["n"]).alias("rule"),
            lookup([p for p, _ in pairs], m["n"]).alias("pack"),
            lookup([r.severity for _, r in pairs], m["n"]).alias("severity"),
            F.lit(1.0).alias("confidence"),
            cut(m["value"], VALUE_LIMIT).alias("value"),
            m["start"].alias("start"),
            m["end"].alias("end"),
        ),
    )
    return with_matches(df, [r for _, r in pairs], text).withColumn("matches", named)


def exploded(df: DataFrame, keys: Sequence[str], matches: str = "matches") -> DataFrame:
    """One row per match. The outer form keeps the optimizer from evaluating the
    scan a second time just to filter out empty arrays."""
    one = df.select(*keys, F.explode_outer(matches).alias("m"))
    return one.where(F.col("m").isNotNull()).select(*keys, "m.*")


def findings(df: DataFrame, keys: Sequence[str], packs: Sequence[str] = (), text: str = "text") -> DataFrame:
    """Findings table: one row per rule match, keyed by ``keys``."""
    return exploded(scan(df.select(*keys, text), packs, text), keys)


def catalogue(df: DataFrame, packs: Sequence[str] = ()) -> DataFrame:
    """The rules as a table: number, pack, rule, severity."""
    rows = [(i, p, r.name, r.severity) for i, (p, r) in enumerate(rules_of(*packs))]
    return df.sparkSession.createDataFrame(rows, "n int, pack string, rule string, severity string")


def rule_counts(df: DataFrame, packs: Sequence[str] = (), text: str = "text") -> DataFrame:
    """Texts and matches per rule, rules without a hit included. Counts need no
    offsets; only partial counts, one row per rule and task, are shuffled."""
    pairs = rules_of(*packs)
    counted = []
    for i, (_, r) in enumerate(pairs):
        matches = f"size(regexp_extract_all({_SAFE}, {quoted(java_of(r.name, r.regex))}, 0))"
        counted.append(f"named_struct('n', {i}, 'k', {where_present(i, matches, '0')})")
    hits = with_present(df.select(text), text, [(i, r) for i, (_, r) in enumerate(pairs)]).select(
        hits_of(counted, "h.k > 0").alias(_HITS)
    )
    per_rule = (
        hits.select(F.explode_outer(_HITS).alias("h"))
        .where(F.col("h").isNotNull())
        .groupBy("h.n")
        .agg(F.count(F.lit(1)).alias("texts"), F.sum(F.col("h.k").cast("long")).alias("matches"))
    )
    zero = F.lit(0).cast("long")
    # Both sides have one row per rule.
    return catalogue(df, packs).join(F.broadcast(per_rule), "n", "left").select(
        "pack", "rule", "severity", F.coalesce("texts", zero).alias("texts"), F.coalesce("matches", zero).alias("matches")
    )


def pack_counts(df: DataFrame, packs: Sequence[str] = (), text: str = "text") -> DataFrame:
    """Matches per pack with its number of patterns; packs without a hit stay."""
    names = list(packs or PACKS)
    sizes = F.create_map(*[F.lit(x) for p in names for x in (p, len(PACKS[p]))])
    return (
        rule_counts(df, names, text)
        .groupBy("pack")
        .agg(F.sum("matches").alias("matches"))
        .select("pack", sizes[F.col("pack")].alias("pattern_count"), "matches")
    )
