"""The registered queries of these operators, and the SQL of those that have one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.llm import (
    conversations, decontaminate, licences, lines, neardup, oracles, pieces, quality, resample, secretscan, shards, tokenfiles,
    toxicity, urls,
)
from textguard.session import shared_dir

#: Shards of the sharding query.
SHARDS = 40


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each document, and what they decode to, as digests."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = pieces.round_trip(_documents(spark, sf_dir).select("doc_id", "text"), model)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return docs.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of each document."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    model = secretscan.trained(secretscan.samples(docs))
    found = secretscan.scan_secrets(docs, model)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in ("assign", "access", "hex")],
        F.sha2(secretscan.span_text("base"), 256).alias("base_sha256"),
        secretscan.span_text("spans").alias("spans"),
    )


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of each document."""
    found = licences.scan_licences(_documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.array_join("sentences", ",").alias("sentences"),
        F.array_join("licences", ",").alias("licences"),
        "n_unknown",
    )


def op4_url_filter(spark: SparkSession, sf_dir: str, listed: DataFrame | None = None) -> DataFrame:
    """The verdict on each page's url. ``listed`` holds canonical URLs in the column ``url``;
    without a list it is made of the pages on hosts with ``urls.LISTED_LABELS``."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    judged = urls.filter_urls(pages, urls.listed_urls(pages) if listed is None else listed)
    return judged.select("page_id", "host", "path", "rule", "listed", "verdict")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a test item."""
    return decontaminate.contained(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of each document."""
    return neardup.near_classes(_documents(spark, sf_dir))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line dedup leaves of each document."""
    kept = lines.dedup_lines(_documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger of each document, with the verdicts of the base and the current policy."""
    rows = quality.ledger(_documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select(
        "doc_id", *quality.MEASURES,
        (~quality.passes("base")).alias("base_failed"),
        quality.passes("v1").alias("kept"),
        "failed",
    )


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the strict policy rejects, and what it alone rejects."""
    return quality.ablation(quality.ledger(_documents(spark, sf_dir).select("text")), "strict")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as read back from the token files."""
    files = f"{shared_dir(spark)}/tokens"
    tokenfiles.write_tokens(_documents(spark, sf_dir), files, public_tokenizers.path("word_bpe_49k.json"))
    return tokenfiles.read_tokens(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of each document."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.fit(toxicity.sample(docs, _table(spark, sf_dir, "labels")))
    return toxicity.grade_toxicity(docs, model).select("doc_id", "severity", "grade", "toxic")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of each damaged conversation, and its cheapest repair."""
    rows = conversations.damaged(_table(spark, sf_dir, "conversations"))
    return conversations.digests(rows, conversations.audits(rows))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight of each document towards the benchmark, and its place in the draw."""
    drawn = resample.resample(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of each document and its place there, in the balanced map and in one with a shard more."""
    rows = shards.placed(_documents(spark, sf_dir))
    history = shards.map_history(rows, SHARDS)
    here = shards.assign(rows, shards.version(history, 2))
    next_ = shards.version(history, 3).select("virtual_slot", "stripe", F.col("shard").alias("next_shard"))
    both = here.join(F.broadcast(next_), ["virtual_slot", "stripe"])
    return both.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "next_shard",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sentencepiece, op2_secret_scan, op3_licence_scan, op4_url_filter, op5_decontamination, op6_near_dedup,
        op7_line_dedup, op8_quality_rules, op9_token_files, op10_toxicity, op11_conversation_repair,
        op12_importance_resampling, op13_sharding, quality_ablation,
    )
}
ORACLES: dict[str, str] = dict(oracles.ORACLES)
