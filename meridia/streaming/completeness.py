"""Streaming additions over an event table: windowed completeness with late data, and gaps per user."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_completeness(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events, valid values and their share by window and type; state is dropped behind the watermark."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.count_if(F.col("value").isNotNull()).alias("n_valid"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n", "n_valid", (F.col("n_valid") / F.col("n")).alias("completeness"))
    )


def gaps(events: DataFrame, hours: float, late: str = "2 days") -> DataFrame:
    """Per user, gaps longer than `hours`: the last time seen is the state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        times = sorted(t for f in frames for t in f["ts"])
        for t in times:
            t = pd.Timestamp(t)
            if last is not None and (t - last).total_seconds() > hours * 3600:
                out.append((key[0], last, t, (t - last).total_seconds() / 3600))
            last = t if last is None or t > last else last
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["user_id", "gap_start", "gap_end", "gap_hours"])

    kept = events.withWatermark("ts", late).select("user_id", "ts")
    return kept.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, gap_start timestamp, gap_end timestamp, gap_hours double", "last timestamp", "append", GroupStateTimeout.NoTimeout)
