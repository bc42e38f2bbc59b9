"""Structured Streaming forms of the batch operators: the same expressions under watermarks and state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"

from engramite.sources.versions import Table


def read_events(spark: SparkSession, folder: str, files_at_once: int = 1) -> DataFrame:
    """A stream of the Parquet files that come into a folder; the checkpoint remembers what was read."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def tumbling(events: DataFrame, length: str, late: str) -> DataFrame:
    """Counts and sums by window and type; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, length: str, step: str, late: str) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", length, step)).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Sessions of a user that end after a gap (the stale-session rule)."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))


def pair_results(uses: DataFrame, results: DataFrame, late: str, within: str) -> DataFrame:
    """Tool uses with their results (tool_id), kept open for a bounded time; a use without one comes out with null."""
    u = uses.withWatermark("ts", late).alias("u")
    r = results.withWatermark("ts", late).alias("r")
    on = F.expr(f"u.tool_id = r.tool_id and r.ts >= u.ts and r.ts <= u.ts + interval {within}")
    return u.join(r, on, "leftOuter").select(F.col("u.tool_id").alias("tool_id"), F.col("u.ts").alias("used_at"), F.col("r.ts").alias("done_at"))


def keep_latest(events: DataFrame, most: int = 50, idle: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(user_id, n, latest): a bounded fold of each user's events; the state holds a counter and the last few types, and goes when idle."""
    seconds = int(pd.Timedelta(idle).total_seconds() * 1000)

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, latest = state.get if state.exists else (0, [])
        latest = list(latest)
        for frame in frames:
            frame = frame.sort_values(["ts", "event_id"])
            n += len(frame)
            latest = (latest + frame["event_type"].tolist())[-most:]
        state.update((n, latest))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + seconds)
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "latest": [",".join(latest)]})

    grouped = events.withWatermark("ts", late).select("user_id", "ts", "event_id", "event_type").groupBy("user_id")
    return grouped.applyInPandasWithState(fold, "user_id long, n long, latest string", "n long, latest array<string>", "update", GroupStateTimeout.EventTimeTimeout)


def upsert_batches(stream: DataFrame, path: str, keys: list[str], at: str, checkpoint: str):
    """Commit the latest rows by key of each micro-batch to a table of versions, each batch once however often it is run; ``Table(...).read()`` has the newest of each key.

    A later batch's row replaces an earlier one's only if it is not older by ``at``.
    """
    table = Table(stream.sparkSession, path, keys)

    def write(batch: DataFrame, number: int) -> None:
        from engramite.operators.metrics import latest

        new, old = latest(batch, keys, F.desc(at)), table.read()
        if old is not None:
            known = old.select(*keys, F.col(at).alias("__at"))
            new = new.join(known, keys, "left").where(F.col("__at").isNull() | (F.col(at) >= F.col("__at"))).drop("__at")
        table.add(new, f"{checkpoint}#{number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
