"""Results kept by text over runs: a text is handed to a job once, whenever and however often it comes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.operators.skew import salted_join
from textguard.sources import log


def with_results(
    df: DataFrame, key: str, job: Callable[[DataFrame], DataFrame], path: str, version: str, batch: str | int, text: str = "text"
) -> DataFrame:
    """``(key, repeated, results)``: the rows of ``job`` for each row's text, without ``text_id``.

    ``job`` gets ``(text_id, text)`` of texts that the log at ``path`` does not hold for
    ``version``, each once, and keeps ``text_id``. What it finds is committed as ``batch``; a
    batch that is run again replaces its own and does not know it. ``repeated`` tells that
    the text came in another batch, or with a lesser ``key`` in this one. Another version
    starts anew and leaves the results of others. Null texts are one text; ``key`` is unique.

    Texts are shuffled by hash once, to find one row for each; results come back through a
    salted join, since a text may have very many copies.
    """
    spark = df.sparkSession
    named = df.select(key, F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("text_id"), F.col(text).alias("text"))
    shape = job(named.select("text_id", "text"))
    fields = [c for c in shape.columns if c != "text_id"]
    row = F.struct(*fields)
    none = F.array().cast(shape.select(F.array(row).alias("r")).schema["r"].dataType)
    first = named.groupBy("text_id").agg(F.min(key).alias(key))
    stored = shape.select("text_id", F.lit(version).alias("version"), F.array(row).alias("results")).schema
    known = log.read(spark, path, stored, skip=batch).where(F.col("version") == version)
    new = first.join(known.select("text_id"), "text_id", "left_anti")
    texts = named.join(new.select(key).hint("shuffle_hash"), key, "left_semi").select("text_id", "text")
    found = job(texts).groupBy("text_id").agg(F.collect_list(row).alias("results"))
    kept = new.select("text_id").join(found, "text_id", "left").select(
        "text_id", F.lit(version).alias("version"), F.coalesce("results", none).alias("results")
    )
    log.append(kept, path, batch)
    own = log.read(spark, path, stored).where(F.col("version") == version).select("text_id", "results")
    earlier = first.join(known.select("text_id", F.lit(True).alias("_known")), "text_id", "left")
    results = own.join(earlier.select("text_id", F.col(key).alias("_first"), "_known"), "text_id")
    joined = salted_join(named.select(key, "text_id"), results, "text_id", key)
    again = F.coalesce("_known", F.lit(False)) | (F.col(key) != F.col("_first"))
    return joined.select(key, again.alias("repeated"), "results")
