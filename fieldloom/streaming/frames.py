"""Frames of a stream of events, and pairs of consecutive frames as they complete.

``frames`` is a windowed aggregate: late events are taken up to the watermark, and a frame comes out
once it has passed. ``pairs`` keeps one frame for each key as state, so it is bounded by the keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def frames(events: DataFrame, row: Column, col: Column, time: str = "ts", value: str = "value", length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """``start, i0, i1, value``: the greatest value of each cell in each window of ``length``. Events that are
    more than ``late`` behind the latest are dropped, as a stream's state must end."""
    rows = events.withWatermark(time, late).select(F.window(time, length).alias("w"), row.cast("int").alias("i0"), col.cast("int").alias("i1"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("w", "i0", "i1").agg(F.max("value").alias("value")).select(F.col("w.start").alias("start"), "i0", "i1", "value")


def pairs(summaries: DataFrame, key: str = "dataset", frame: str = "frame") -> DataFrame:
    """``key, src_frame, dst_frame`` of every frame (one row each, in the order of their arrival within a batch by
    number) and the one before it under its key; gaps are bridged. A frame that is not after the last one
    seen makes no pair."""

    def paired(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for number in sorted({int(x) for batch in batches for x in batch["frame"]}):
            if last is not None and number <= last:
                continue
            if last is not None:
                out.append((name[0], last, number))
            last = number
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["key", "src_frame", "dst_frame"])

    rows = summaries.select(F.col(key).cast("string").alias("key"), F.col(frame).cast("long").alias("frame"))
    return rows.groupBy("key").applyInPandasWithState(paired, "key string, src_frame long, dst_frame long", "last long", "append", GroupStateTimeout.NoTimeout)
