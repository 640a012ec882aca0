"""Overconfident wording, unattributed claims and statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.functions.dialect import SPACE, to_java
from textguard.functions.text import lowered
from textguard.operators.fence import fenced
from textguard.rules import phrases

EXPLANATION = "Potential overconfident claims detected without attribution"
# More than three phrases and two statistics flag a text.
PHRASES_OVER, CLAIMS_OVER = 3, 2
CONTEXT = 200
SENTENCE_MIN = 10


def stat_claims(text: Column) -> Column:
    """Number-and-unit claims of a text."""
    return F.regexp_extract_all(text, F.lit(to_java(phrases.STAT_CLAIM)), F.lit(0))


def phrase_count(text: Column) -> Column:
    """How many of the confident phrases occur."""
    low = lowered(text)
    return reduce(lambda a, b: a + b, [low.contains(p).cast("int") for p in phrases.CONFIDENT_PHRASES])


def with_overconfidence(df: DataFrame, text: str = "text", into: str = "claims") -> DataFrame:
    """Adds the simple analysis: phrases, claims, flag and explanation."""
    staged = df.withColumn("__stats", stat_claims(F.col(text))).withColumn("__phrases", phrase_count(F.col(text)))
    flagged = (F.col("__phrases") > PHRASES_OVER) & (F.size("__stats") > CLAIMS_OVER)
    value = F.struct(
        F.col("__phrases").alias("phrases"),
        F.size("__stats").alias("total_claims"),
        flagged.alias("flagged"),
        F.when(flagged, EXPLANATION).otherwise(F.lit("")).alias("explanation"),
    )
    return staged.withColumn(into, value).drop("__stats", "__phrases")


def sentences(text: Column) -> Column:
    """Parts between full stops, blanks trimmed, longer than ten bytes."""
    parts = F.split(text, "\\.", -1)
    blank = f"[{SPACE}\\x0B\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]"
    trimmed = F.transform(parts, lambda p: F.regexp_replace(p, f"^{blank}+|{blank}+\\z", ""))
    return F.filter(trimmed, lambda s: F.octet_length(s) > SENTENCE_MIN)


def with_unattributed(df: DataFrame, text: str, into: str) -> DataFrame:
    """Adds the statistics with no attribution word near their first place."""
    body = F.col(text)
    attribution = to_java(phrases.ATTRIBUTION)
    near = lambda s: F.substring(
        body,
        F.greatest(F.instr(body, s) - CONTEXT, F.lit(1)),
        F.length(s) + CONTEXT + F.least(F.instr(body, s) - 1, F.lit(CONTEXT)),
    )
    # Repeats of one statistic share its first place, so each is judged once.
    staged = df.withColumn("__quantities", F.regexp_extract_all(body, F.lit(to_java(phrases.QUANTITY)), F.lit(0)))
    staged = staged.withColumn(
        "__bare", F.filter(F.array_distinct("__quantities"), lambda s: ~near(s).rlike(attribution))
    )
    staged = fenced(staged, "__quantities", "__bare")
    bare = F.filter("__quantities", lambda s: F.array_contains("__bare", s))
    return staged.withColumn(into, bare).drop("__quantities", "__bare")


def with_claim_risk(df: DataFrame, text: str = "text", into: str = "risk") -> DataFrame:
    """Adds the extended analysis and the text-level figures drawn from it."""
    over, fact = to_java(phrases.OVERCONFIDENCE), to_java(phrases.FACTUAL_CLAIM)
    attribution = to_java(phrases.ATTRIBUTION)
    staged = with_overconfidence(df, text, "__base").withColumn("__sentences", sentences(F.col(text)))
    staged = with_unattributed(staged, text, "__stats").withColumns(
        {
            "__over": F.filter("__sentences", lambda s: s.rlike(over)),
            "__unverified": F.filter("__sentences", lambda s: s.rlike(fact) & ~s.rlike(attribution)),
        }
    )
    score = F.size("__over") + F.size("__unverified") * 2 + F.size("__stats")
    base = F.col("__base")
    value = F.struct(
        F.col("__over").alias("overconfident"),
        F.col("__unverified").alias("unverified"),
        F.col("__stats").alias("unquantified"),
        score.alias("score"),
        F.when(score > 5, "high").when(score > 2, "medium").otherwise("low").alias("level"),
        (base["flagged"] | (score > 5)).alias("flagged"),
        base["total_claims"].alias("claim_count"),
        F.when(base["total_claims"] > 0, phrases.STAT_CLAIM_CONFIDENCE).otherwise(1.0).alias("confidence"),
        ((base["total_claims"] == 0) | ~(base["flagged"] | (score > 5))).alias("valid"),
    )
    rated = staged.withColumn(into, value).drop("__base", "__sentences", "__over", "__unverified", "__stats")
    return fenced(rated, into)
