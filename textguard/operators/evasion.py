"""Evasion techniques found in texts, their score and their counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.functions.dialect import java_of
from textguard.functions.text import quoted
from textguard.operators import ruleset
from textguard.operators.fence import fenced
from textguard.operators.guard import check_patterns
from textguard.operators.scan import _SAFE, hits_of, where_present, with_present
from textguard.rules import phrases


def with_evasion(
    df: DataFrame, text: str = "text", into: str = "evasion",
    extra: Sequence[tuple[str, str, float, str]] = (),
) -> DataFrame:
    """Adds matched techniques (first match each) and their capped score.

    ``extra`` adds own techniques as (name, category, weight, pattern).
    """
    check_patterns(df, [p for *_, p in extra])
    columns = [F.col(c) for c in df.columns]
    known = len(phrases.EVASION)
    seen = with_present(df, text, enumerate(phrases.EVASION_RULES))

    def technique(i, name, category, weight, pattern):
        first = f"regexp_extract({_SAFE}, {quoted(java_of(name, pattern))}, 0)"
        found = where_present(i, first) if i < known else first
        return (
            f"named_struct('name', {quoted(name)}, 'category', {quoted(category)}, 'weight', {float(weight)}D, "
            f"'match', {found})"
        )

    matched = hits_of([technique(i, *row) for i, row in enumerate((*phrases.EVASION, *extra))], "coalesce(h.match, '') <> ''")
    score = F.aggregate("__matched", F.lit(0.0), lambda a, t: a + t["weight"])
    value = F.struct(
        (F.size("__matched") > 0).alias("detected"),
        F.least(F.lit(1.0), score).alias("score"),
        F.col("__matched").alias("matched"),
    )
    return fenced(seen.select(*columns, matched.alias("__matched")).select(*columns, value.alias(into)), into)


def with_rules(df: DataFrame, rules: DataFrame, keys: Sequence[str], text: str = "text", into: str = "evasion") -> DataFrame:
    """``keys`` and the evasion of each text, with own techniques from a table of any number.

    ``rules`` has ``place``, ``name``, ``category``, ``weight`` and ``pattern``; own techniques follow
    the known ones by ``place``. Only what was found is shuffled, not the texts.
    """
    named = rules.select(*[F.col(c).alias(f"_{c}") for c in ("place", "name", "category", "weight")], "pattern")
    found = ruleset.findings(df, named, keys, text)
    first = found.groupBy(*keys, "_place", "_name", "_category", "_weight").agg(F.min_by("value", "start").alias("_match"))
    own = first.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(
        F.sort_array(F.collect_list(F.struct("_place", "_name", "_category", "_weight", "_match"))).alias("_own")
    )
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    base = with_evasion(df, text, into).select(*keys, into)
    extra = F.transform("_own", lambda t: F.struct(*[t[f"_{c}"].alias(c) for c in ("name", "category", "weight", "match")]))
    none = F.slice(F.col(into)["matched"], 1, 0)
    matched = F.concat(F.col(into)["matched"], F.coalesce(extra, none))
    joined = base.join(own, same, "left").select(*keys, matched.alias("_all"))
    score = F.least(F.lit(1.0), F.aggregate("_all", F.lit(0.0), lambda a, t: a + t["weight"]))
    value = F.struct((F.size("_all") > 0).alias("detected"), score.alias("score"), F.col("_all").alias("matched"))
    return joined.select(*keys, value.alias(into))


def evasion_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Texts hit per technique and per category level: one pass, one small
    shuffle of partial counts. A text counts once per matched technique."""
    flat = with_evasion(df.select(text), text).select(F.explode_outer("evasion.matched").alias("m"))
    return (
        flat.where(F.col("m").isNotNull())
        .groupBy("m.category", "m.name")
        .agg(F.count(F.lit(1)).alias("texts"))
        .rollup("category", "name")
        .agg(F.sum("texts").alias("texts"))
        .where(F.col("category").isNotNull())
        .select("category", F.coalesce("name", F.lit("*")).alias("name"), "texts")
    )
