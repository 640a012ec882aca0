"""Scan each distinct text once and hand the result to all its copies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.operators.skew import salted_join


def once_per_text(
    df: DataFrame, key: str, job: Callable[[DataFrame], DataFrame], text: str = "text"
) -> DataFrame:
    """Runs ``job`` on the distinct texts and joins its columns back to ``key``.

    ``job`` gets ``(text_id, text)`` and must keep ``text_id``. Only hashes are
    grouped: the row with the least ``key`` (unique in ``df``) stands for its
    text. Texts are hashed to that list, not sorted; results come back through a
    salted join.
    """
    named = df.select(key, F.sha2(F.col(text), 256).alias("text_id"), text)
    first = named.groupBy("text_id").agg(F.min(key).alias(key)).select(key).hint("shuffle_hash")
    results = job(named.join(first, key, "left_semi").select("text_id", text))
    return salted_join(named.select(key, "text_id"), results, "text_id", key).drop("text_id")
