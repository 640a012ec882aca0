"""Running totals over a whole table without a one-task window."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textguard.session import ship, written

PART = "__part"


def _carry(values: Sequence[str]) -> Callable:
    """Adds the partition's number and the totals from its first row on, batch by batch."""

    def run(batches):
        part = TaskContext.get().partitionId()
        totals = [0] * len(values)
        for batch in batches:
            columns, names = list(batch.columns), list(batch.schema.names)
            for i, value in enumerate(values):
                kind = pa.float64() if pa.types.is_floating(batch.schema.field(value).type) else pa.int64()
                own = pc.fill_null(batch.column(value).cast(kind), 0)
                sums = pc.cumulative_sum_checked(own, start=pa.scalar(totals[i], kind))
                totals[i] = sums[-1].as_py() if len(sums) else totals[i]
                columns.append(sums)
                names.append(f"cum_{value}")
            columns.append(pa.array([part] * batch.num_rows, pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, PART])

    return run


def totals_within(df: DataFrame, order: str, values: Sequence[str]) -> DataFrame:
    """Adds ``cum_<value>``, totals from a partition's highest ``order`` down, and the partition as ``PART``.

    One shuffle deals the rows out to ranges of ``order``, the highest in partition 0; the sums
    run over each sorted partition with one number a value as state. Nulls add nothing.
    """
    ship(df.sparkSession)
    top = F.col(order).desc()
    sorted_ = df.repartitionByRange(top).sortWithinPartitions(top)
    kinds = dict(df.dtypes)
    added = [f"cum_{v} {'double' if kinds[v] in ('float', 'double') else 'bigint'}" for v in values]
    schema = ", ".join([*[f"`{c}` {t}" for c, t in df.dtypes], *added, f"{PART} int"])
    return sorted_.mapInArrow(_carry(values), schema)


def above(value: str):
    """Total of ``value`` over the partitions above, in a table of one row per partition."""
    return F.coalesce(F.sum(value).over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def running_totals(df: DataFrame, order: str, values: Sequence[str]) -> DataFrame:
    """Adds ``cum_<value>``: totals from the highest ``order`` down to each row.

    The rows are written with the totals of their partition, so that ranges stay what they
    were; what lies above a partition comes from one row each. ``order`` must be unique.
    """
    rows = written(totals_within(df, order, values), "running")
    sums = rows.groupBy(PART).agg(*[F.sum(v).alias(f"__{v}") for v in values])
    carried = sums.select(PART, *[above(f"__{v}").alias(f"__{v}") for v in values])
    # One row per shuffle partition on the right side.
    joined = rows.join(F.broadcast(carried), PART)
    return joined.select(*df.columns, *[(F.col(f"cum_{v}") + F.col(f"__{v}")).alias(f"cum_{v}") for v in values])
