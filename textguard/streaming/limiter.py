"""The sliding-window limiter on a stream, decided in event order.

A request waits in its client's state until the watermark has passed it: then no earlier one
can come, whatever the order of arrival, and it is decided as the batch job would decide it.
A timer per client fires at the first waiting request. A request that comes after the
watermark has passed it is not decided but put out at once with ``LATE``; the decisions
around it stand.

Defined cases: a null client is a client of its own; requests of the same instant are decided by
``seq``; requests without time, number or tokens are left out. What still waits when a stream ends is decided by a row
that moves the watermark, see ``decisions``.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from textguard.operators.usage import REQUESTS_REASON, SIZE_REASON, TOKENS_REASON, Limits
from textguard.session import shared_dir, ship
from textguard.streaming import sinks

OUTPUT = "client string, seq bigint, allowed boolean, reason string"
#: Reason of a request that came too late to be decided in order.
LATE = "Late request"
#: Keeps state in files, with timers; the default store knows no timers of this kind.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROWS = "at bigint, seq bigint, tokens bigint"
_COLUMNS = ["client", "seq", "allowed", "reason"]
_BATCH = 10_000


class _Limiter(StatefulProcessor):
    """State of a client: its waiting requests, and those that count in its window."""

    def __init__(self, limits: Limits):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _ROWS)
        self.window = handle.getListState("window", "at bigint, tokens bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        first = None
        for batch in rows:
            batch = batch.dropna(subset=["at", "seq", "tokens"])
            late = batch["at"] < passed
            if late.any():
                some = batch.loc[late, "seq"]
                yield pd.DataFrame({"client": key[0], "seq": some, "allowed": False, "reason": LATE}, columns=_COLUMNS)
            kept = batch[~late]
            if len(kept):
                self.waiting.appendList(list(zip(*(kept[c].astype("int64").tolist() for c in ("at", "seq", "tokens")))))
                first = min(int(kept["at"].min()), first or int(kept["at"].min()))
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        due, rest = [], []
        for row in self.waiting.get():
            (due if row[0] < passed else rest).append(tuple(row))
        due.sort()
        span = self.limits.window_seconds * 1_000_000
        window = deque(tuple(row) for row in self.window.get())
        used, out = sum(tokens for _, tokens in window), []
        for at, seq, tokens in due:
            while window and window[0][0] <= at - span:
                used -= window.popleft()[1]
            if used + tokens > self.limits.tokens_per_window:
                reason = TOKENS_REASON
            elif len(window) + 1 > self.limits.requests_per_window:
                reason = REQUESTS_REASON
            elif tokens > self.limits.max_tokens:
                reason = SIZE_REASON
            else:
                reason = ""
                window.append((at, tokens))
                used += tokens
            out.append((key[0], seq, reason == "", reason))
            if len(out) == _BATCH:
                yield pd.DataFrame(out, columns=_COLUMNS)
                out = []
        # A row that comes from now on is not before the watermark.
        while window and window[0][0] <= passed - span:
            window.popleft()
        self._put(self.waiting, rest)
        self._put(self.window, list(window))
        if rest:
            self.handle.registerTimer(min(rest)[0] // 1000 + 1)
        elif window:
            self.handle.registerTimer((window[-1][0] + span) // 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)

    @staticmethod
    def _put(state, rows: list) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def close(self) -> None:
        pass


def limit_stream(
    df: DataFrame, client: str, ts: str, seq: str, tokens: str, limits: Limits = Limits(), delay: str = "1 minute"
) -> DataFrame:
    """Decisions per request: client, seq, allowed, reason. Late requests have ``LATE``.

    Runs under the state store ``STORE``, which the session names in ``PROVIDER``. State is what
    a client has waiting within the watermark's delay, and what counts in its window.
    """
    ship(df.sparkSession)
    timed = df.select(
        F.col(client).cast("string").alias("client"),
        F.col(ts).cast("timestamp").alias("ts"),
        F.col(seq).cast("long").alias("seq"),
        F.col(tokens).cast("long").alias("tokens"),
    ).withWatermark("ts", delay)
    # Without the watched column in its input, the operator is handed late rows as well.
    rows = timed.select("client", F.unix_micros(F.col("ts")).alias("at"), "seq", "tokens")
    return rows.groupBy("client").transformWithStateInPandas(
        statefulProcessor=_Limiter(limits), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime"
    )


def _closing(last: DataFrame, like: DataFrame, ts: str, delay: str) -> DataFrame:
    """One row that is null but for a time that moves the watermark a year past the one in ``last``."""
    after = (F.col(ts).cast("timestamp") + F.expr(f"INTERVAL {delay}") + F.expr("INTERVAL 365 DAYS")).cast(like.schema[ts].dataType)
    return last.select(*[(after if c == ts else F.lit(None).cast(t)).alias(c) for c, t in like.dtypes])


def decisions(
    requests: DataFrame, last: DataFrame, client: str, ts: str, seq: str, tokens: str,
    limits: Limits = Limits(), delay: str = "1 minute",
) -> DataFrame:
    """All decisions on a stream that is run to its end; ``last`` is one row with its last ``ts``.

    The stream runs over all there is, then once more from its checkpoint with a row that
    moves the watermark past everything that waits.
    """
    spark = requests.sparkSession
    base = shared_dir(spark)
    like = requests.select(client, ts, seq, tokens)
    spark.createDataFrame([], like.schema).write.parquet(f"{base}/closing")
    whole = like.unionByName(spark.readStream.schema(like.schema).parquet(f"{base}/closing"))
    decided = limit_stream(whole, client, ts, seq, tokens, limits, delay)
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, STORE)
    try:
        sinks.start(decided, f"{base}/data", f"{base}/checkpoint").awaitTermination()
        _closing(last, like, ts, delay).write.mode("append").parquet(f"{base}/closing")
        sinks.start(decided, f"{base}/data", f"{base}/checkpoint").awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(decided.schema).option("recursiveFileLookup", "true").parquet(f"{base}/data")
