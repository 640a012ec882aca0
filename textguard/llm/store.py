"""What the jobs need beside DataFrames: written steps, and workers that know the package."""

from __future__ import annotations

import os
import shutil
import tempfile
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

import textguard
from textguard.session import shared_dir

_SHIPPED: set[str] = set()
#: In a worker: the tables that functions keep between tasks, and the module whose function ran last.
_TABLES: list[weakref.ref] = []
_LAST: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: its lineage ends at the files."""
    path = f"{shared_dir(df.sparkSession)}/{name}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _ship(spark: SparkSession) -> None:
    """Hands the package to the executors, once per application, as Spark's own files."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        home = os.path.dirname(os.path.dirname(os.path.abspath(textguard.__file__)))
        archive = shutil.make_archive(f"{tempfile.mkdtemp()}/textguard", "zip", home, "textguard")
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)


def keep(table: dict) -> None:
    """Names a table that a worker keeps for the next task."""
    _TABLES.append(weakref.ref(table))


def _lean(run: Callable, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What ``run`` makes of ``batches``, in a worker that outlives the job: tables kept by functions
    of other modules go first, and Arrow's free memory goes back in the end."""
    if _LAST != [run.__module__]:
        _LAST[:] = [run.__module__]
        for table in _TABLES:
            if (kept := table()) is not None:
                kept.clear()
    yield from run(batches)
    pa.default_memory_pool().release_unused()


def in_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with a function of this package."""
    _ship(df.sparkSession)

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _lean(run, batches)

    return df.mapInArrow(lean, schema)
