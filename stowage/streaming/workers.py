"""The periodic workers as Structured Streaming queries.

Input streams have event times as TIMESTAMP; files with times without a zone
are read through ``zoned``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def table_stream(spark: SparkSession, path: str, files_per_batch: int | None = None, bytes_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; the two limits throttle it."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if bytes_per_batch:
        reader = reader.option("maxBytesPerTrigger", bytes_per_batch)
    return reader.parquet(path)


def zoned(stream: DataFrame, column: str) -> DataFrame:
    """A time without a zone as a timestamp, which watermarks need."""
    return stream.withColumn(column, F.col(column).cast("timestamp"))


def session_dedup(stream: DataFrame, key: list[str], at: str, delay: str) -> DataFrame:
    """First row of each key; a key is remembered for ``delay`` of event time."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(key)


def windowed_reputation(stream: DataFrame, peer: str, status: str, at: str, delay: str, width: str = "7 days", slide: str = "1 day") -> DataFrame:
    """Challenge counts per peer in sliding windows."""
    kind = F.col(status)
    return (
        stream.withWatermark(at, delay)
        .groupBy(F.window(at, width, slide), peer)
        .agg(F.count("*").alias("made"), F.count_if(kind == "pass").alias("passed"), F.count_if(kind.isin("pass", "fail")).alias("attempts"))
        .select(F.col("window.start").alias("start"), peer, "made", "passed", "attempts")
    )


def in_flight(offers: DataFrame, arrivals: DataFrame, delay: str) -> DataFrame:
    """Offers (hash, offered_at) with their arrival (hash, arrived_at) within ``delay``, null if none came."""
    left = offers.withWatermark("offered_at", delay).alias("o")
    right = arrivals.withWatermark("arrived_at", delay).select(F.col("hash").alias("arrived_hash"), "arrived_at").alias("a")
    near = F.expr(f"hash = arrived_hash AND arrived_at >= offered_at AND arrived_at <= offered_at + INTERVAL {delay}")
    return left.join(right, near, "left_outer").select("hash", "offered_at", "arrived_at")


ADOPTION_EVENT = "peer_id long, at timestamp, kind string"
ADOPTION_OUT = "peer_id long, adoption_status string"
ADOPTION_STATE = "status string, started double, failures long"


def adoption_states(stream: DataFrame, period_seconds: float, delay: str = "1 hour") -> DataFrame:
    """Adoption status of each peer after each batch, and when its test ends: none, testing, completed, failed.

    Events (peer_id, at, kind): ``start``; ``retrieved`` or ``missing`` for a test piece. A test
    that has lasted the period ends with the peer's next event, or by a timer when the watermark passes its end:
    completed without a missing piece, else failed. Events may be late by ``delay``.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, started, failures = state.get if state.exists else ("none", 0.0, 0)
        if state.hasTimedOut:
            status = "failed" if failures else "completed"
            state.update((status, started, int(failures)))
            yield pd.DataFrame({"peer_id": [key[0]], "adoption_status": [status]})
            return
        for row in pd.concat(list(frames)).sort_values(["at", "kind"]).itertuples():
            now = row.at.timestamp()
            if status == "none" and row.kind == "start":
                status, started, failures = "testing", now, 0
            elif status == "testing":
                failures += row.kind == "missing"
                if now - started >= period_seconds:
                    status = "failed" if failures else "completed"
        state.update((status, started, int(failures)))
        if status == "testing":
            state.setTimeoutTimestamp(max(int((started + period_seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"peer_id": [key[0]], "adoption_status": [status]})

    return stream.withWatermark("at", delay).groupBy("peer_id").applyInPandasWithState(step, ADOPTION_OUT, ADOPTION_STATE, "update", GroupStateTimeout.EventTimeTimeout)


def run_worker(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """A worker: ``work`` on each micro-batch, periodically or, without a period, once over what is there."""
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Writes each micro-batch once: a batch that is tried again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
