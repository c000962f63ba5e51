"""Operators over event streams; each takes a stream or a batch and gives the same rows.

These are extras: late rows are dropped behind the watermark, state is bounded by
it, and windows that are closed are final (append mode).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from calyx import runtime


def timed(events: DataFrame, time: str) -> DataFrame:
    """The event time as a timestamp, which watermarks need."""
    return events.withColumn(time, F.col(time).cast("timestamp"))


def windowed(events: DataFrame, time: str, keys: list[str], size: str, slide: str | None = None, late: str = "10 minutes", value: str = "value") -> DataFrame:
    """Count, sum and greatest value per key and window (tumbling, or sliding with ``slide``)."""
    rows = timed(events, time).withWatermark(time, late)
    window = F.window(time, size, slide) if slide else F.window(time, size)
    out = rows.groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max(value).alias("greatest"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total", "greatest")


def sessions(events: DataFrame, time: str, keys: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions that end after a gap without an event."""
    rows = timed(events, time).withWatermark(time, late)
    out = rows.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def without_repeats(events: DataFrame, time: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark."""
    rows = timed(events, time)
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if rows.isStreaming else rows.dropDuplicates(keys)


def running_totals(events: DataFrame, key: str, value: str, idle_ms: int | None = None) -> DataFrame:
    """``key, n, total`` after every micro-batch; with ``idle_ms`` the state of an idle key is dropped."""

    def update(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, total = state.get if state.exists else (0, 0.0)
        for batch in batches:
            n, total = n + len(batch), total + float(batch[value].fillna(0).sum())
        state.update((n, total))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({key: [group[0]], "n": [n], "total": [total]})

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(
        update, f"{key} {kind}, n long, total double", "n long, total double", "update",
        GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout,
    )


def to_files(stream: DataFrame, path: str, checkpoint: str | None = None) -> StreamingQuery:
    """All that is available, appended to Parquet exactly once; the checkpoint lies in the shared folder."""
    place = checkpoint or f"{runtime.shared_dir(stream.sparkSession)}/stream-{hashlib.md5(path.encode()).hexdigest()}"
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", place).outputMode("append").trigger(availableNow=True).start()
