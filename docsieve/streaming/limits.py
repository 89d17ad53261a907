"""Stateful admission, failure windows and idempotent sinks, in batch and streaming form.

Batch folds sort each key's rows inside their partition and read them in a
stream, so a key with any number of rows needs the memory of its own window
only.  Streaming state is dropped by event time once a key has been silent for
its window and the allowed lateness.

Defined results: rows without a key or time aren't events; events of one time
follow their ids; a denied attempt leaves no trace.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


class SlidingLog:
    """Admits an attempt if fewer than ``limit`` admitted ones are younger than ``window``; denied ones aren't recorded."""

    def __init__(self, limit: int, window: float, kept: list[float] | None = None) -> None:
        self.limit, self.window, self.log = limit, window, deque(kept or [])

    def __call__(self, t: float) -> bool:
        while self.log and t - self.log[0] >= self.window:
            self.log.popleft()
        ok = len(self.log) < self.limit
        if ok:
            self.log.append(t)
        return ok


class FailureWindow:
    """Failures counted in a window that opens at the first; blocked from ``most`` on until it closes."""

    def __init__(self, most: int, window: float) -> None:
        self.most, self.window, self.opened, self.n = most, window, None, 0

    def __call__(self, t: float) -> tuple[int, bool, int]:
        """(failures in the window, blocked, seconds until it opens again) after a failure."""
        if self.opened is None or t - self.opened >= self.window:
            self.opened, self.n = t, 0
        self.n += 1
        blocked = self.n >= self.most
        return self.n, blocked, max(1, -int(-(self.opened + self.window - t) // 1)) if blocked else 0


def admit(times: list[float], limit: int, window: float, kept: list[float] | None = None) -> tuple[list[bool], list[float]]:
    """Which attempts a sliding log admits, and what it holds afterwards."""
    log = SlidingLog(limit, window, kept)
    return [log(t) for t in times], list(log.log)


def failure_counter(times: list[float], most: int, window: float) -> list[int]:
    """Failures counted in the window after each failure."""
    counter = FailureWindow(most, window)
    return [counter(t)[0] for t in times]


def _fold(events: DataFrame, key: str, at: str, event_id: str, start: Callable[[], Callable], columns: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    """(key, event_id, columns..) of every event, a key's events in order through one ``start()`` each."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    rows = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, event_id, F.unix_micros(F.col(at).cast("timestamp")).alias("_t"))
    ordered = rows.repartition(key).sortWithinPartitions(key, "_t", event_id)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step = None, None
        for b in batches:
            out = []
            for k, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if step is None or k != now:
                    now, step = k, start()
                x = step(t / 1e6)
                out.append(x if isinstance(x, tuple) else (x,))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array([o[i] for o in out], t) for i, (_, t, _) in enumerate(columns)]], names=[key, event_id, *[n for n, _, _ in columns]])

    return ordered.mapInArrow(work, ", ".join([f"`{key}` {kinds[key]}", f"`{event_id}` {kinds[event_id]}", *[f"{n} {s}" for n, _, s in columns]]))


def admissions(events: DataFrame, key: str, at: str, event_id: str, *, limit: int, seconds: float) -> DataFrame:
    """(key, event_id, admitted) of every attempt."""
    return _fold(events, key, at, event_id, lambda: SlidingLog(limit, seconds), [("admitted", pa.bool_(), "boolean")])


def failure_windows(events: DataFrame, key: str, at: str, event_id: str, *, most: int = 10, seconds: float = 600.0) -> DataFrame:
    """(key, event_id, failures, blocked, retry_after) after every failure event."""
    return _fold(events, key, at, event_id, lambda: FailureWindow(most, seconds), [("failures", pa.int32(), "int"), ("blocked", pa.bool_(), "boolean"), ("retry_after", pa.int32(), "int")])


def stream_admissions(events: DataFrame, *, limit: int, seconds: float, late: str = "1 hour") -> DataFrame:
    """Streaming form of ``admissions`` over (user_id bigint, event_id bigint, ts timestamp).

    State holds one window of admitted times of a key and is dropped when the
    watermark has passed its last one by the window.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = list(state.get[0]) if state.exists else []
        last = log[-1] if log else 0.0
        for pdf in batches:
            pdf = pdf.sort_values(["ts", "event_id"])
            times = [t.timestamp() for t in pdf["ts"]]
            ok, log = admit(times, limit, seconds, log)
            last = max([last, *times])
            yield pd.DataFrame({"user_id": pdf["user_id"], "event_id": pdf["event_id"], "admitted": ok})
        state.update((log,))
        state.setTimeoutTimestamp(max(int((last + seconds) * 1000), state.getCurrentWatermarkMs() + 1))

    marked = events.withWatermark("ts", late)
    return marked.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, event_id bigint, admitted boolean", "log array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def stream_upsert(stream: DataFrame, path: str, keys: list[str], order: list[str], checkpoint: str):
    """Idempotent sink: every micro-batch is merged into ``path`` by key, the first row by ``order`` of each key winning.

    A batch that is delivered again finds its keys there and changes nothing;
    the merged table replaces the old one by a rename.
    """
    from docsieve.operators.review import keep_first

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        jvm = spark.sparkContext._jvm
        where, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.next")
        fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        rows = batch.unionByName(spark.read.schema(batch.schema).parquet(path)) if fs.exists(where) else batch
        keep_first(rows, keys, order).write.mode("overwrite").parquet(f"{path}.next")
        fs.delete(where, True)
        fs.rename(new, where)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def windowed_counts(events: DataFrame, *, every: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Event-time counts per type with a watermark; the same plan serves batch and stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "event_type", "n")


def attempts(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Attempt number of every run of a key."""
    return events.withColumn("attempt", F.row_number().over(W.partitionBy(key).orderBy(*order)))
