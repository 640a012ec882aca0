"""Heuristic threat scores, decisions and the shadow log."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from textguard.functions.text import fingerprint, lowered, quoted
from textguard.operators.fence import fenced
from textguard.rules.phrases import ATTACK_WORDS

THRESHOLD = 0.7
CAP = 0.9
# Fixed value: texts shorter than this score zero on the set-based path.
SHORT_BYTES = 32
#: Bytes of text that a user's model gets at a time.
SCORED_BYTES = 1_000_000


def swapped(word: str) -> list[str]:
    """The word with two neighbours exchanged, at each place."""
    return [word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)]


def without_vowels(word: str) -> str:
    return word[0] + "".join(c for c in word[1:] if c not in "aeiou")


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _any(text: Column, forms: Sequence[str]) -> Column:
    # Looking for some literals one by one is much faster than a pattern of them.
    return functools.reduce(Column.__or__, [text.contains(form) for form in forms])


def _total(parts: Sequence[tuple[Column, float]]) -> Column:
    """Weighted count in tenths, so that sums are exact, capped."""
    tenths = F.lit(0)
    for hit, weight in parts:
        tenths = tenths + hit.cast("int") * round(weight * 10)
    return F.least(tenths, F.lit(round(CAP * 10))) / F.lit(10.0)


def scored_body(text: Column) -> Column:
    """What the heuristic looks at: the whole text in lower case. Its words are of ASCII letters,
    so it finds the same with blanks collapsed and unknown characters replaced."""
    return lowered(text)


def body_score(body: Column) -> Column:
    """Weights of the disguised attack words in a body: a swap per word, dropped
    vowels and reversals."""
    parts = [(_any(body, swapped(w)), 0.4) for w in ATTACK_WORDS]
    parts += [(body.contains(without_vowels(w)), 0.3) for w in ATTACK_WORDS if without_vowels(w) != w]
    parts += [(body.contains(w[::-1]), 0.3) for w in ATTACK_WORDS]
    return _total(parts)


def heuristic_score(text: Column) -> Column:
    """Score of a text. The body is bound once and tested for every word."""
    return F.get(F.transform(F.array(scored_body(text)), body_score), F.lit(0))


def variant_sets(words: Sequence[str] = ATTACK_WORDS) -> dict[str, list[str]]:
    """Distinct disguised forms by kind, in checking order."""
    return {
        "direct_match": sorted(set(words)),
        "transposition": sorted({v for w in words for v in swapped(w)}),
        "vowel_deleted": sorted({without_vowels(w) for w in words if without_vowels(w) != w}),
        "reversed": sorted({w[::-1] for w in words if len(w) >= 4}),
    }


def with_set_score(df: DataFrame, text: str = "text", into: str = "set_score") -> DataFrame:
    """Adds the whole-text score that counts every form, the stage that decided
    and whether it is a threat. Short texts score zero."""
    sets = variant_sets()
    low = _ascii_lower(F.col(text))
    weights = {"direct_match": 4, "transposition": 4, "vowel_deleted": 3, "reversed": 3}

    def tenths(kind: str) -> Column:
        forms = ", ".join(quoted(form) for form in sets[kind])
        return F.expr(f"size(filter(array({forms}), f -> contains(__low, f))) * {weights[kind]}")

    # The sums read a column of their own, so the lower-casing runs once.
    staged = fenced(df.withColumn("__low", low), "__low")
    staged = staged.select("*", *[tenths(k).alias(f"__{k}") for k in sets])
    running, stage = F.lit(0), None
    for kind in sets:
        running = running + F.col(f"__{kind}")
        hit = running >= round(THRESHOLD * 10)
        stage = F.when(hit, kind) if stage is None else stage.when(hit, kind)
    score = F.least(running, F.lit(9)) / F.lit(10.0)
    short = F.octet_length(F.col(text)) < SHORT_BYTES
    value = F.struct(
        F.when(short, 0.0).otherwise(score).alias("score"),
        (~short & (running >= round(THRESHOLD * 10))).alias("is_threat"),
        F.when(short, "fast_path").otherwise(stage.otherwise("heuristic")).alias("variant"),
    )
    return fenced(staged.withColumn(into, value).drop("__low", *[f"__{k}" for k in sets]), into)


def decision(score: Column, threshold: float = THRESHOLD, shadow: bool = False, enabled: bool = True) -> Column:
    """Score, threat flag and mode label. Shadow mode keeps the score only."""
    on = enabled or shadow
    return F.struct(
        (score if on else F.lit(0.0)).alias("score"),
        ((score >= threshold) & F.lit(on and not shadow)).alias("is_threat"),
        F.lit(threshold).alias("threshold"),
        F.lit("original" if on else "disabled").alias("variant"),
    )


def best_variant(scores: Column, threshold: float = THRESHOLD) -> Column:
    """Best score over variants tried in order, stopping at the first at or
    above the threshold."""
    hits = F.filter(scores, lambda s: s >= threshold)
    return F.coalesce(F.get(hits, F.lit(0)), F.array_max(scores), F.lit(0.0))


def with_best_variant(
    df: DataFrame, variants: str, scorer: Callable[[Column], Column] = heuristic_score,
    threshold: float = THRESHOLD, shadow: bool = False, into: str = "best",
) -> DataFrame:
    """Adds the multi-variant decision over an array column of texts."""
    scored = df.withColumn("__scores", F.transform(variants, scorer))
    best = best_variant(F.col("__scores"), threshold)
    value = F.struct(
        best.alias("score"),
        ((best >= threshold) & F.lit(not shadow)).alias("is_threat"),
        F.lit("multi_variant" if shadow else "best_variant").alias("variant"),
    )
    return scored.withColumn(into, value).drop("__scores")


def shadow_log(
    df: DataFrame, score: Column, text: str = "text", keys: Sequence[str] = (), threshold: float = THRESHOLD,
    variant: str = "original", model_version: str = "heuristic", ts: Column | None = None,
) -> DataFrame:
    """Prediction rows for offline evaluation; the text is kept as a hash only."""
    return df.select(
        *keys,
        *([ts.alias("timestamp")] if ts is not None else []),
        fingerprint(F.col(text)).alias("input_hash"),
        score.alias("score"),
        F.lit(threshold).alias("threshold"),
        (score >= threshold).alias("is_threat"),
        F.lit(variant).alias("variant"),
        F.lit(model_version).alias("model_version"),
        F.octet_length(F.col(text)).alias("input_length"),
    )


def batch_scorer(load: Callable[[], Callable], batch_size: int = 1_000) -> Callable[[Column], Column]:
    """Adapter for a model that is loaded once per Python worker: ``load`` returns a function
    from an array of at most ``batch_size`` texts to an array of their scores. A null text is None."""
    return predict_batch_udf(load, return_type=DoubleType(), batch_size=batch_size)


def pandas_scorer(function: Callable) -> Callable[[Column], Column]:
    """Adapter for a user's own model: a function of one pandas Series. It gets texts of about
    ``SCORED_BYTES`` at a time, or one text, so that a worker's memory does not follow the batch."""

    def score(texts: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype("int64")
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // SCORED_BYTES)) + 1).tolist(), len(texts)]
        made = [
            pa.Array.from_pandas(pd.Series(function(texts.slice(a, b - a).to_pandas())), type=pa.float64())
            for a, b in zip(cuts, cuts[1:])
            if b > a
        ]
        return pa.concat_arrays([pa.array([], pa.float64()), *made])

    # The types are given by name, as annotations in this module are text.
    score.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(score, "double")
