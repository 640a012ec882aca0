"""From raw documents to token ids: five stages, each written before the next reads it.

Every stage takes and returns a table with the columns of ``documents``; the last gives
the ids. A document leaves when the quality policy rejects it, when a near-duplicate
with a smaller id stays, or when it holds a benchmark item. Repeated lines leave the
text of all but the first document that holds them. Null ids: near-dedup and benchmark
know such a document by a hash of its text, so each is judged on its own, and of equal texts
without an id one stays. Of rows that repeat an id and its text one stays as well.

SQL can express neither the near-duplicate search nor the encoding, so there is no
``ORACLE_SQL``; a test holds the rows against a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.llm import decontaminate, lines, neardup, pieces, quality
from textguard.llm.store import stored

POLICY = "v1"


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_key``: the id, or a hash of the text where there is none."""
    return docs.withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit("no id"), "text")))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` but for the keys in ``gone``. Hashed, so that texts are not sorted."""
    return docs.join(gone.select(F.col("doc_id").alias("_key")).hint("shuffle_hash"), "_key", "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality policy."""
    return quality.ledger(docs).where(quality.passes(POLICY)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that earlier documents hold."""
    kept = lines.dedup_lines(docs).withColumns({"text": F.col("kept"), "n_chars": F.length("kept").cast("long")})
    return kept.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates."""
    keyed = _keyed(docs)
    kept = _without(keyed, neardup.near_classes(keyed, "_key").where("doc_id != class_id"))
    return kept.withColumn("_hash", F.xxhash64("text")).dropDuplicates(["_key", "_hash"]).select(*docs.columns)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    keyed = _keyed(docs)
    gone = decontaminate.contaminated(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "_key")
    return _without(keyed, gone).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, exact)``: ids of the text, and whether they decode to it."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = pieces.round_trip(docs.select("doc_id", "text"), model)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("exact"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_free", benchmark_free),
    ("token_ids", token_ids),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
