"""Streams of finished images: rates by window, late arrivals included up to a watermark, and cumulative progress."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(events: DataFrame, ts: str, keys: list[str], window: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events a second in each window: keys, start, end, n, rate. Works on a stream and on a table alike."""
    stream = events.withWatermark(ts, late) if events.isStreaming else events
    grouped = stream.groupBy(F.window(ts, window, slide or window).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    seconds = F.unix_seconds("w.end") - F.unix_seconds("w.start")
    return grouped.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", (F.col("n") / seconds).alias("rate"))


PROGRESS = "key STRING, first_us BIGINT, last_us BIGINT, n BIGINT"


def progress(events: DataFrame, key: str, ts: str, idle_ms: int = 86_400_000, late: str = "10 minutes") -> DataFrame:
    """Count and span of each key so far, updated as events arrive; state is three numbers a key.

    A key is forgotten when the watermark has passed its last event by `idle_ms`; if it comes again it starts anew.
    """

    def update(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first, last, n = state.get if state.exists else (None, None, 0)
        for frame in frames:
            if len(frame):
                low, high = int(frame["us"].min()), int(frame["us"].max())
                first, last = (low if first is None else min(first, low)), (high if last is None else max(last, high))
                n += len(frame)
        state.update((first, last, n))
        state.setTimeoutTimestamp(max(last // 1000 + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [keys[0]], "first_us": [first], "last_us": [last], "n": [n]})

    slim = events.withWatermark(ts, late).select(F.col(key).cast("string").alias("key"), ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    return slim.groupBy("key").applyInPandasWithState(update, PROGRESS, "first_us BIGINT, last_us BIGINT, n BIGINT", "update", GroupStateTimeout.EventTimeTimeout)
