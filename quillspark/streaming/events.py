"""Structured Streaming over event tables: windows with watermarks, landed-row rate limits, first-row dedupe, idempotent batches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder; ts becomes a zoned timestamp, which watermarks need."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str, late: str) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, width: str, step: str, late: str) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step), "event_type").agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def dedupe_first(events: DataFrame, key: list[str], late: str) -> DataFrame:
    """The first row of each key that arrives within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def rate_limited(events: DataFrame, key: str, most: int, seconds: int, late: str = "10 days") -> DataFrame:
    """Rows with accepted: fewer than `most` accepted rows of the key in the `seconds` before. Rows are judged as they land: those of a batch in the order of time, a later batch after
    an earlier one, and rows behind the watermark not at all. State: the accepted times of a key, at most `most`; it goes when the watermark has passed the last of them by `seconds`."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        landed = json.loads(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for t in rows["ts"].astype("datetime64[us]").astype("int64").tolist():
            landed = [x for x in landed if x >= t - seconds * 1_000_000]
            out.append(len(landed) < most)
            if out[-1]:
                landed.append(t)
        ends = max(landed, default=0) // 1000 + seconds * 1000 + 1
        if landed and ends > state.getCurrentWatermarkMs():
            state.update((json.dumps(landed),))
            state.setTimeoutTimestamp(ends)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"event_id": rows["event_id"], key: k[0], "accepted": out})

    rows = events.withWatermark("ts", late).select("event_id", key, "ts").groupBy(key)
    return rows.applyInPandasWithState(step, f"event_id long, {key} long, accepted boolean", "landed string", "append", GroupStateTimeout.EventTimeTimeout)


def write_batches(events: DataFrame, path: str, checkpoint: str, key: str, late: str = "10 days"):
    """Each micro-batch written under its own id, so that a repeated batch replaces itself. A key that comes again within `late` is dropped by the stream's own state, so
    what was written is never read again."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
    return once.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
