"""Places of rows in a sorted order, without a one-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textguard.llm.store import stored

_LOW = 33  # bits of a row's number within its task, see monotonically_increasing_id


def numbered(df: DataFrame, group: Sequence[str], order: Sequence, name: str) -> DataFrame:
    """``df`` with ``name``: the place of each row in its group, from 0 and without gaps.

    Rows are range-partitioned and sorted by group and order, so a large group lies in
    several tasks. Each task numbers its rows; where a group starts in a task, and how many
    of its rows lie in the tasks before, comes from a table of one row per task and group
    in it (at most tasks plus groups), which is broadcast. Nulls are a group of their own.
    """
    keys = [F.col(g) for g in group] + list(order)
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = stored(rows.withColumn("_at", F.monotonically_increasing_id()), f"numbered-{name}")
    task = F.shiftright("_at", _LOW)
    heads = rows.groupBy(task.alias("_task"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)])
    heads = heads.agg(F.min("_at").alias("_head"), F.count(F.lit(1)).alias("_n"))
    inside = [f"_g{i}" for i in range(len(group))]
    earlier = (Window.partitionBy(*inside) if inside else Window.partitionBy()).orderBy("_task")
    before = F.coalesce(F.sum("_n").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = heads.select("_task", *inside, "_head", before.alias("_before"))
    same = task == F.col("_task")
    for i, g in enumerate(group):
        same = same & rows[g].eqNullSafe(F.col(f"_g{i}"))
    placed = rows.join(F.broadcast(heads), same)
    return placed.select(*df.columns, (F.col("_before") + F.col("_at") - F.col("_head")).alias(name))
