"""Streams of sightings: collection windows, deduplicated sightings, the hourly ceiling, superseded readings.

Each function is a transformation of a streaming (or batch) DataFrame; the sinks are the caller's. State is
keyed by portal or address and bounded by watermarks wherever the reference behaviour allows it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ledgerloom.session import shared_dir


def sightings(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def collection_windows(stream: DataFrame, success: F.Column) -> DataFrame:
    """Each portal's first day, last success and last attempt: an aggregate with one row of state a portal."""
    return stream.groupBy("portal_code").agg(
        F.to_date(F.min("seen_at")).alias("collecting_since"),
        F.max(F.when(success, F.col("seen_at"))).alias("last_success_at"),
        F.max("seen_at").alias("last_checked_at"),
    )


def first_sightings(stream: DataFrame, key: str, time: str = "seen_at", late: str = "2 days") -> DataFrame:
    """Sightings whose key was not seen within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def trailing_ceiling(stream: DataFrame, key: str, time: str = "seen_at", most: int = 200, hours: int = 1, late: str = "1 hour") -> DataFrame:
    """Requests (key, id, time) with how many of the same key came in the trailing hours before them, and whether that pauses the intake.

    A request is judged once the watermark has passed it, so that those which come late but within the watermark count in
    their place; equal times don't count for each other. The count stops at the ceiling ("at least"), so that a key holds
    its last ``most`` judged times and the requests not yet judged, no more. A key that is silent for the span loses its
    state. Requests later than the watermark, and those without a time, are dropped by the engine or never judged.
    """
    span = hours * 3_600_000_000

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        judged, ids, times = (np.asarray(v, dtype="int64") for v in (state.get if state.exists else ([], [], [])))
        if not state.hasTimedOut:
            rows = pd.concat([b[["id", "_micros"]] for b in batches])
            ids, times = np.concatenate([ids, rows["id"].to_numpy("int64")]), np.concatenate([times, rows["_micros"].to_numpy("int64")])
        mark = state.getCurrentWatermarkMs() * 1000
        ready = times <= mark
        known = np.sort(np.concatenate([judged, times[ready]]))
        now = times[ready]
        recent = np.minimum(np.searchsorted(known, now) - np.searchsorted(known, now - span), most)
        judged, out = known[known > mark - span][-most:], pd.DataFrame({key: group[0], "id": ids[ready], "_micros": now, "recent": recent})
        ids, times = ids[~ready], times[~ready]
        if not len(times) and not len(judged):
            state.remove()
        else:
            state.update((judged.tolist(), ids.tolist(), times.tolist()))
            wake = times.min() if len(times) else judged.max() + span
            state.setTimeoutTimestamp(int(max(wake, mark) // 1000) + 1)
        yield out

    kind = stream.schema[key].dataType.simpleString()
    timed = stream.where(F.col(time).isNotNull()).select(key, "id", F.col(time).cast("timestamp").alias(time)).withColumn("_micros", F.unix_micros(time)).withWatermark(time, late)
    counted = timed.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, id bigint, _micros bigint, recent bigint", "judged array<bigint>, ids array<bigint>, times array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
    return counted.select(key, "id", F.timestamp_micros("_micros").alias(time), "recent", (F.col("recent") >= most).alias("paused"))


def superseded(stream: DataFrame, tracked: str = "stated") -> DataFrame:
    """Readings that a later one of the same portal changes: the state is the last reading of each portal."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["seen_at", "id"])
        out = []
        for r in rows.itertuples(index=False):
            value = getattr(r, tracked)
            if last is not None and last[1] != value:
                out.append((key[0], last[0], last[1], r.seen_at))
            last = (int(r.id), value)
        state.update(last)
        yield pd.DataFrame(out, columns=["portal_code", "id", tracked, "superseded_at"])

    kind = stream.schema[tracked].dataType.simpleString()
    return stream.groupBy("portal_code").applyInPandasWithState(step, f"portal_code string, id bigint, {tracked} {kind}, superseded_at timestamp", f"id bigint, {tracked} {kind}", "append", GroupStateTimeout.NoTimeout)


def append_sightings(stream: DataFrame, folder: str, checkpoint: str):
    """An append-only Parquet sink that takes what is there and stops."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream over what is there into a versioned folder of the shared directory and read the last version."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{name}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/v{number:06d}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    last = query.lastProgress["batchId"] if query.lastProgress else 0
    path = f"{base}/v*" if mode == "append" else f"{base}/v{last:06d}"
    return spark.read.schema(stream.schema).parquet(path)
