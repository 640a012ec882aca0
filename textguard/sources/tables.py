"""Input tables and corpora made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Unset, tables are read as they lie. A table in a single row group is read by one task, however many splits it has;
# set to a number, its rows are dealt out to that many tasks first.
DEAL = "spark.textguard.read.partitions"


def table(spark: SparkSession, sf_dir: str, name: str, partitions: int | None = None) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    partitions = partitions or int(spark.conf.get(DEAL, "0"))
    return rows.repartition(partitions) if partitions else rows


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts at hand as (corpus, id, text); the id of a turn is ``conv_id-turn``."""

    def texts(name, key, text="text"):
        return table(spark, sf_dir, name).select(
            F.lit(name).alias("corpus"), key.cast("string").alias("id"), F.col(text).alias("text")
        )

    docs = texts("documents", F.col("doc_id"))
    talk = texts("conversations", F.concat_ws("-", "conv_id", "turn"))
    pages = texts("pages", F.col("page_id"), "html")
    return docs.unionByName(talk).unionByName(pages).unionByName(texts("benchmark", F.col("item_id")))


def as_traffic(talk: DataFrame) -> DataFrame:
    """Conversation turns as request and response traffic with a host and time.

    System turns count as requests. Works on a table and on a stream.
    """
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    at = F.timestamp_micros(F.unix_micros(start) + (F.col("conv_id") * 600 + F.col("turn") * 20) * 1_000_000)
    return talk.select(
        "conv_id",
        "turn",
        at.alias("ts"),
        F.when(F.col("role") == "assistant", "response").otherwise("request").alias("direction"),
        F.concat(F.lit("host"), F.pmod(F.col("conv_id"), F.lit(7)).cast("string"), F.lit(".example.com")).alias("host"),
        F.concat(F.lit("/chat/"), F.col("conv_id").cast("string")).alias("path"),
        "text",
    )


def traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_traffic(table(spark, sf_dir, "conversations"))


def stream(spark: SparkSession, sf_dir: str, name: str, files: int = 64) -> DataFrame:
    """The files of a table as a stream, in the table's own schema; ``files`` of them a micro-batch."""
    schema = table(spark, sf_dir, name).schema
    # A pattern, as a stream's plain path must be a folder, and a table may be one file.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/{{{name}}}.parquet")


def traffic_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_traffic(stream(spark, sf_dir, "conversations"))
