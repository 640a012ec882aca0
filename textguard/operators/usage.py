"""Token usage per client: trailing totals and the sliding-window limiter.

Windows run per client and stretch of time, so that a client with a large share
of all events is spread over many tasks.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textguard.session import written

MICROS = 1_000_000
# Reasons in checking order.
TOKENS_REASON = "Token rate limit exceeded"
REQUESTS_REASON = "Request rate limit exceeded"
SIZE_REASON = "Response too large"
# One stretch is this many windows long; 1/16 of the rows is copied next door.
WINDOWS_PER_STRETCH = 16


@dataclass(frozen=True)
class Limits:
    """The default limits of one client."""

    max_tokens: int = 8192
    tokens_per_window: int = 100_000
    requests_per_window: int = 100
    window_seconds: int = 60


def _ranged(df: DataFrame, client: str, at: str, low: int, high: int, values: dict[str, Column]) -> DataFrame:
    """Adds sums of ``values`` over the rows of the client at ``at + low..high``.

    Each row goes to its own stretch and, when a row of a neighbouring stretch can see
    it, to that one too. It enters there when the first row can see it, and leaves
    after the last; sums run from the start of the stretch, so that a window of many
    rows costs no more than a small one.
    """
    reach = max(-low, high)
    width = reach * WINDOWS_PER_STRETCH
    here = F.col(at)
    own = F.floor(here / width).cast("long")
    edge = F.pmod(here, F.lit(width))

    def change(stretch: Column, time: Column, sign: int) -> Column:
        return F.struct(stretch.alias("s"), time.alias("time"), F.lit(sign).alias("sign"))

    def seen_in(stretch: Column) -> list[Column]:
        return [change(stretch, here - high, 1), change(stretch, here - low + 1, -1)]

    # The row itself, with sign 0, is where the sums are read.
    places = [change(own, here, 0), *seen_in(own)]
    if low < 0:
        places += [F.when(edge >= width + low, x) for x in seen_in(own + 1)]
    if high > 0:
        places += [F.when(edge < high, x) for x in seen_in(own - 1)]
    changes = df.withColumn("__p", F.explode(F.array_compact(F.array(*places)))).select("*", "__p.*").drop("__p")
    window = Window.partitionBy(client, "s").orderBy("time").rangeBetween(Window.unboundedPreceding, 0)
    sums = [F.sum(v * F.col("sign")).over(window).alias(k) for k, v in values.items()]
    return changes.select("*", *sums).where("sign = 0").drop("s", "time", "sign")


def trailing_usage(
    df: DataFrame, client: str, ts: str, tokens: str, window_seconds: int = 60
) -> DataFrame:
    """Adds tokens and requests of the client in (t - window, t]."""
    span = window_seconds * MICROS
    timed = df.withColumn("__at", F.unix_micros(F.col(ts).cast("timestamp")))
    values = {
        "used_tokens": F.col(tokens).cast("long"),
        "used_requests": F.lit(1),
    }
    return _ranged(timed, client, "__at", -(span - 1), 0, values).drop("__at")


_BLOCK = ["__client", "__run", "__stretch"]
_STATE = ["__ats", "__used"]
# Rounds of blocks replayed side by side before what still differs is replayed run by run.
ROUNDS = 6


def _replay(limits: Limits, rows_out: bool):
    """Batch iterator over blocks: first a block's entry (kind 0, with what is in its window), then
    its rows in order. Gives the rows with their reason, or what is in the window at each block's end.

    State is what the current block has in its window, so memory does not grow with the
    number of rows.
    """
    span = limits.window_seconds * MICROS

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, window, used = None, deque(), 0
        for batch in batches:
            reasons, ends = [], []
            columns = (batch[c] for c in (*_BLOCK, "__kind", "__at", "__tokens", "__safe", *_STATE))
            for client, run, stretch, kind, at, tokens, safe, ats, toks in zip(*columns):
                if kind == 0:
                    if block is not None:
                        ends.append((*block, [x for x, _ in window], [x for _, x in window]))
                    block, window, used = (client, run, stretch), deque(zip(ats, toks)), sum(toks)
                    reasons.append("")
                    continue
                while window and window[0][0] <= at - span:
                    used -= window.popleft()[1]
                if not safe and used + tokens > limits.tokens_per_window:
                    reasons.append(TOKENS_REASON)
                elif not safe and len(window) + 1 > limits.requests_per_window:
                    reasons.append(REQUESTS_REASON)
                elif tokens > limits.max_tokens:
                    reasons.append(SIZE_REASON)
                else:
                    window.append((int(at), int(tokens)))
                    used += tokens
                    reasons.append("")
            if rows_out:
                batch["__reason"] = reasons
                yield batch[batch["__kind"] == 1]
            elif ends:
                yield pd.DataFrame(ends, columns=[*_BLOCK, *_STATE])
        if not rows_out and block is not None:
            yield pd.DataFrame([(*block, [x for x, _ in window], [x for _, x in window])], columns=[*_BLOCK, *_STATE])

    return decide


def _by_block(entries: DataFrame, rows: DataFrame, seq: str) -> DataFrame:
    """Each block's entry and then its rows, in order."""
    both = entries.select(*_BLOCK, *_STATE, F.lit(0).alias("__kind")).unionByName(
        rows.withColumn("__kind", F.lit(1)), allowMissingColumns=True
    )
    filled = both.fillna({"__at": 0, "__tokens": 0, "__safe": False})
    return filled.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK, "__kind", "__at", seq)


def _ends(entries: DataFrame, rows: DataFrame, seq: str, limits: Limits) -> DataFrame:
    narrow = rows.select(*_BLOCK, "__at", "__tokens", "__safe", seq)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in _BLOCK), *(f"`{c}` array<bigint>" for c in _STATE)])
    return written(_by_block(entries, narrow, seq).mapInPandas(_replay(limits, False), schema), "ends")


def _entries(rows: DataFrame, seq: str, limits: Limits) -> tuple[DataFrame, DataFrame]:
    """What is in the window at the start of each block of ``rows``, and the runs for which that
    is still open.

    All blocks are replayed side by side, at first from an empty window. Where a block ends
    otherwise than the next one was started from, the next one is replayed again from there.
    A window forgets its past, so that after a round or two few blocks differ.
    """
    span = limits.window_seconds * MICROS
    empty = [F.array().cast("array<bigint>").alias(c) for c in _STATE]
    blocks = written(rows.groupBy(*_BLOCK).agg(F.min("__at").alias("__first")), "blocks")
    runs = ["__client", "__run"]
    several = blocks.groupBy(*runs).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*runs)
    entries, none = blocks.select(*_BLOCK, *empty), blocks.select(*runs).limit(0)
    if several.isEmpty():
        return entries, none
    chained = written(rows.join(several, runs, "left_semi"), "chained")
    heads = written(blocks.join(several, runs, "left_semi"), "heads")
    alone = entries.join(several, runs, "left_anti")
    entries = heads.select(*_BLOCK, *empty)
    ends = _ends(entries, chained, seq, limits)
    for _ in range(ROUNDS):
        # A run has no gap of a window, so its stretches follow each other.
        passed = ends.withColumn("__stretch", F.col("__stretch") + 1)
        pairs = F.filter(F.arrays_zip(*_STATE), lambda x: x["__ats"] > F.col("__first") - span)
        state = [F.coalesce(F.transform(pairs, lambda x: x[c]), empty[0]).alias(c) for c in _STATE]  # noqa: B023
        found = written(heads.join(passed, _BLOCK, "left").select(*_BLOCK, *state), "entries")
        old = entries.select(*_BLOCK, *[F.col(c).alias(f"{c}_old") for c in _STATE])
        same = (F.col("__ats") == F.col("__ats_old")) & (F.col("__used") == F.col("__used_old"))
        changed = written(found.join(old, _BLOCK).where(~same).select(*_BLOCK, *_STATE), "changed")
        entries = found
        if changed.isEmpty():
            return alone.unionByName(entries), none
        again = _ends(changed, chained.join(changed.select(*_BLOCK), _BLOCK, "left_semi"), seq, limits)
        ends = written(ends.join(again.select(*_BLOCK), _BLOCK, "left_anti").unionByName(again), "ends")
    return alone.unionByName(entries), changed.select(*runs).distinct()


def limit(
    df: DataFrame, client: str, ts: str, seq: str, tokens: str, limits: Limits = Limits()
) -> DataFrame:
    """Adds ``allowed`` and ``reason``; refused requests use up nothing.

    Most rows need no history: where even all requests of the trailing window
    together stay within the limits, the outcome follows from the row alone.
    Only rows beyond that (and the rows their windows see) are replayed in
    order, run by run; a gap of one window starts a new run. A run is cut into
    blocks, which are replayed side by side until each starts with what the one
    before ends with. A replay streams through sorted partitions with a window-sized state.
    """
    span = limits.window_seconds * MICROS
    t, at = F.col("__tokens"), F.col("__at")
    fits = t <= limits.max_tokens
    timed = df.withColumns(
        {
            "__at": F.unix_micros(F.col(ts).cast("timestamp")),
            "__tokens": F.col(tokens).cast("long"),
            "__client": F.col(client).cast("string"),
        }
    )
    at_most = {
        "__all_tokens": F.when(fits, t).otherwise(F.lit(0)),
        "__all_requests": F.when(fits, 1).otherwise(0),
    }
    bounded = _ranged(timed, "__client", "__at", -(span - 1), 0, at_most)
    alone = F.when(fits, 0).otherwise(1)
    safe = (F.col("__all_tokens") + t * alone <= limits.tokens_per_window) & (
        F.col("__all_requests") + alone <= limits.requests_per_window
    )
    marked = bounded.withColumn("__safe", safe)
    seen_by = {"__needed": F.when(F.col("__safe"), 0).otherwise(1)}
    marked = _ranged(marked, "__client", "__at", 0, span - 1, seen_by).withColumn("__needed", F.col("__needed") > 0)

    own = [F.col(c) for c in df.columns]
    settled = marked.where(~F.col("__needed")).select(*own, F.when(fits, "").otherwise(SIZE_REASON).alias("__reason"))

    active = marked.where("__needed")
    active = _ranged(active, "__client", "__at", -span, -1, {"__before": F.lit(1)})
    opens = F.when(F.col("__before") == 0, at)
    width = span * WINDOWS_PER_STRETCH
    active = active.withColumns({"__opens": opens, "__stretch": F.floor(at / width)})
    # A run is named by its first instant: the last opening so far, looked up
    # within the stretch, then over the earlier stretches of the client.
    here = Window.partitionBy("__client", "__stretch").orderBy("__at").rangeBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("__client").orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        active.groupBy("__client", "__stretch")
        .agg(F.max("__opens").alias("__last"))
        .select("__client", "__stretch", F.max("__last").over(earlier).alias("__carried"))
    )
    runs = (
        active.withColumn("__in", F.max("__opens").over(here))
        .join(carried, ["__client", "__stretch"])
        .withColumn("__run", F.coalesce("__in", "__carried"))
    )
    kept = [*df.columns, *_BLOCK, "__at", "__tokens", "__safe"]
    rows = written(runs.select(*kept), "contested")
    entries, open_ = _entries(rows, seq, limits)
    by_run = ["__client", "__run"]
    # What does not settle is replayed in order, a run being one block.
    rest = rows.join(open_, by_run, "left_semi").withColumn("__stretch", F.lit(None).cast("long"))
    rest_entries = rest.select(*_BLOCK).distinct().select(*_BLOCK, *[F.array().cast("array<bigint>").alias(c) for c in _STATE])
    every = rows.join(open_, by_run, "left_anti").unionByName(rest)
    ordered = _by_block(entries.join(open_, by_run, "left_anti").unionByName(rest_entries), every, seq)
    replayed = ordered.mapInPandas(_replay(limits, True), ordered.withColumn("__reason", F.lit("")).schema)
    decided = settled.unionByName(replayed.select(*own, "__reason"))
    return decided.select(*own, (F.col("__reason") == "").alias("allowed"), F.col("__reason").alias("reason"))
