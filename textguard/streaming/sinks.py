"""Stream outputs: append tables, changing tables and routed tables.

Each micro-batch writes its own ``batch=<id>`` folder, so that a batch run again
after a failure replaces what it wrote before.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textguard.session import shared_dir


def _by_batch(path: str) -> Callable[[DataFrame, int], None]:
    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def start(
    df: DataFrame, path: str, checkpoint: str, mode: str = "append", trigger: dict | None = None,
    handle: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Starts a query that hands each micro-batch to ``handle``, by default one
    that writes it under ``path``."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.foreachBatch(handle or _by_batch(path)).trigger(**(trigger or {"availableNow": True})).start()


def drain(
    spark: SparkSession, df: DataFrame, mode: str = "append",
    handle: Callable[[str], Callable[[DataFrame, int], None]] | None = None,
) -> str:
    """Runs a stream over all there is now and returns the folder it wrote."""
    base = shared_dir(spark)
    query = start(df, f"{base}/data", f"{base}/checkpoint", mode, handle=handle(f"{base}/data") if handle else None)
    query.awaitTermination()
    return f"{base}/data"


def drain_closed(
    spark: SparkSession, make: Callable[..., DataFrame], *streams: tuple[DataFrame, DataFrame],
    handle: Callable[[str], Callable[[DataFrame, int], None]] | None = None,
) -> str:
    """Runs ``make(*streams)`` over all there is, then once more from its checkpoint with the
    closing rows that come with each stream and move its watermark on. Returns the folder."""
    base = shared_dir(spark)
    whole = []
    for i, (rows, closing) in enumerate(streams):
        path = f"{base}/closing-{i}"
        spark.createDataFrame([], rows.schema).write.parquet(path)
        whole.append(rows.unionByName(spark.readStream.schema(rows.schema).parquet(path)))
    made = make(*whole)
    for last in (False, True):
        if last:
            for i, (_, closing) in enumerate(streams):
                closing.write.mode("append").parquet(f"{base}/closing-{i}")
        done = handle(f"{base}/data") if handle else None
        start(made, f"{base}/data", f"{base}/checkpoint", handle=done).awaitTermination()
    return f"{base}/data"


def appended(spark: SparkSession, df: DataFrame, mode: str = "append") -> DataFrame:
    """All rows a drained stream put out."""
    rows = spark.read.schema(df.schema).option("recursiveFileLookup", "true").parquet(drain(spark, df, mode))
    return rows


def latest(spark: SparkSession, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Last state of each key of a drained stream in update mode."""
    rows = spark.read.parquet(drain(spark, df, "update"))
    values = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*values), "batch").alias("v")
    return rows.groupBy(*keys).agg(last).select(*keys, "v.*")
