"""Session defaults and the shared folder jobs cut lineage in."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# CPU-bound scans want smaller splits than the 128 MB default.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "64m",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "textguard") -> SparkSession:
    """A local session for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder all executors reach, under ``spark.checkpoint.dir``.

    Only a local session may run without that setting; it gets a temporary one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor reaches")
        base = tempfile.mkdtemp(prefix="textguard-")
        spark.conf.set("spark.checkpoint.dir", base)
    spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once in the shared folder and read back: its lineage ends at the files."""
    path = f"{shared_dir(df.sparkSession)}/{name}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hands this package to the executors, once per application, for functions that run there."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        home = os.path.dirname(os.path.abspath(__file__))
        context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/textguard", "zip", os.path.dirname(home), "textguard"))
        _SHIPPED.add(context.applicationId)
