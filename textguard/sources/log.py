"""A log of rows in files that are committed batch by batch.

A data source for writing tables and streams. Tasks write Parquet files and start a new one
when a file has reached its size. Only when all tasks are done, the driver writes the batch's
manifest, which lists the files; readers look at manifests alone. So what a failed or repeated
task wrote is never seen, and a batch that is run again replaces its manifest: each row
is there once. ``abort`` deletes the files of a batch that failed.

Options: ``path`` (reached by driver and executors), ``batch`` (a table's batch id; a
stream has its own numbers), ``bytes`` (size at which a file is closed).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from textguard.session import ship

NAME = "textguard_log"
BYTES = 128 * 1024 * 1024


@dataclass
class Files(WriterCommitMessage):
    """What one task wrote: names below the path, and rows."""

    files: list[tuple[str, int]]


class _Log:
    def __init__(self, options: dict):
        self.path, self.most = options["path"].rstrip("/"), int(options.get("bytes", BYTES))
        self.batch, self.run = options.get("batch") or uuid.uuid4().hex, uuid.uuid4().hex[:12]

    def _at(self, name: str) -> tuple[fs.FileSystem, str]:
        # Spark writes ``file:/x`` for ``file:///x``.
        path = self.path.replace("file:/", "file:///", 1) if self.path.startswith("file:/") and self.path[6:7] != "/" else self.path
        system, root = fs.FileSystem.from_uri(path)
        return system, f"{root}/{name}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        task = TaskContext.get()
        files, writer, size, rows, name = [], None, 0, 0, ""
        for batch in iterator:
            if batch.num_rows == 0:
                continue
            if writer is None:
                name = f"data/{self.run}-{task.partitionId()}-{task.taskAttemptId()}-{len(files)}.parquet"
                system, path = self._at(name)
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                writer, size, rows = pq.ParquetWriter(path, batch.schema, filesystem=system), 0, 0
            writer.write_batch(batch)
            size, rows = size + batch.nbytes, rows + batch.num_rows
            if size >= self.most:
                writer.close()
                files.append((name, rows))
                writer = None
        if writer is not None:
            writer.close()
            files.append((name, rows))
        return Files(files)

    def _commit(self, messages: list, batch: str) -> None:
        lines = [{"batch": batch, "file": f, "rows": n} for m in messages if m is not None for f, n in m.files]
        system, path = self._at(f"manifest/batch={batch}.json")
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        hidden = path.replace("/batch=", f"/_{self.run}-")
        with system.open_output_stream(hidden) as out:
            out.write("".join(json.dumps(line) + "\n" for line in lines).encode())
        system.move(hidden, path)

    def _abort(self, messages: list) -> None:
        for message in messages:
            for name, _ in message.files if message is not None else ():
                system, path = self._at(name)
                system.delete_file(path)


class _TableLog(_Log, DataSourceArrowWriter):
    def commit(self, messages: list) -> None:
        self._commit(messages, self.batch)

    def abort(self, messages: list) -> None:
        self._abort(messages)


class _StreamLog(_Log, DataSourceStreamArrowWriter):
    def commit(self, messages: list, batchId: int) -> None:
        self._commit(messages, str(batchId))

    def abort(self, messages: list, batchId: int) -> None:
        self._abort(messages)


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> _TableLog:
        return _TableLog(dict(self.options))

    def streamWriter(self, schema: StructType, overwrite: bool) -> _StreamLog:
        return _StreamLog(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the source known to the session, and the package to the executors."""
    ship(spark)
    spark.dataSource.register(LogSource)


def append(df: DataFrame, path: str, batch: str | int | None = None, file_bytes: int = BYTES) -> None:
    """Appends ``df`` as one batch. The same ``batch`` again replaces its rows."""
    register(df.sparkSession)
    writer = df.write.format(NAME).option("path", path).option("bytes", file_bytes)
    (writer if batch is None else writer.option("batch", str(batch))).mode("append").save()


def append_stream(df: DataFrame, path: str, checkpoint: str, file_bytes: int = BYTES):
    """Starts a query that appends each micro-batch of ``df`` as a batch of the log."""
    register(df.sparkSession)
    options = {"path": path, "bytes": file_bytes, "checkpointLocation": checkpoint}
    return df.writeStream.format(NAME).options(**options).outputMode("append").trigger(availableNow=True).start()


def batches(spark: SparkSession, path: str) -> DataFrame:
    """``(batch, file, rows)`` of what is committed. A log that nobody wrote yet has none."""
    # A pattern may fit nothing, and batches without a file leave a manifest without a line.
    root = path.rstrip("/").rsplit("/", 1)
    found = f"{root[0]}/{{{root[1]}}}/manifest/*.json"
    schema = "batch string, file string, rows long"
    try:
        return spark.read.schema(schema).json(found)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, schema: StructType, skip: str | int | None = None) -> DataFrame:
    """The rows of all committed batches but ``skip``. The driver sees the files' names, as with
    any folder of files."""
    listed = batches(spark, path)
    if skip is not None:
        listed = listed.where(F.col("batch") != str(skip))
    names = [f"{path.rstrip('/')}/{r['file']}" for r in listed.select("file").collect()]
    return spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)
