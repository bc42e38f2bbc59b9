"""Scans and predicates of the survey as functions: periods, membership, containment, validity of times, fallbacks."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse_period(text: str) -> tuple[str, str]:
    """``A:B`` as the first and the last microsecond of the two days; an error where B is before A."""
    first, last = (datetime.date.fromisoformat(part.strip()) for part in text.split(":"))
    if last < first:
        raise ValueError(f"the period {text} ends before it starts")
    return f"{first} 00:00:00", f"{last} 23:59:59.999999"


def within(df: DataFrame, at: str, start: str | None = None, stop: str | None = None) -> DataFrame:
    """Rows from ``start`` to ``stop``, both included; either may be left out."""
    for bound, kept in ((start, F.col(at) >= F.lit(start).cast("timestamp_ntz")), (stop, F.col(at) <= F.lit(stop).cast("timestamp_ntz"))):
        df = df if bound is None else df.where(kept)
    return df


def json_contains(column: str, wanted: dict[str, str]) -> Column:
    """Whether a JSON object has all the keys with these values (as text)."""
    found = F.lit(True)
    for key, value in wanted.items():
        found = found & F.get_json_object(column, f"$.{key}").eqNullSafe(F.lit(value))
    return found


def json_has(column: str, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(column), key), F.lit(False))


def members(df: DataFrame, wanted: DataFrame, key: str, present: bool = True) -> DataFrame:
    """Rows whose key is in a list that is a frame (or is not); the list may be of any length."""
    return df.join(wanted.select(key).distinct(), key, "left_semi" if present else "left_anti")


def without_then_top(df: DataFrame, excluded: list, key: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows that are not excluded: as many more are fetched as are excluded, then dropped."""
    pool = df.orderBy(*order).limit(k + len(excluded))
    return pool.where(~F.col(key).isin(excluded)).orderBy(*order).limit(k) if excluded else pool


def source_time(raw: Column, now: str, earliest: str = "2024-01-01 00:00:00", skew_minutes: int = 5) -> Column:
    """A time read from text, or null if it cannot be read, is before the earliest plausible one or more than the skew after now. Times without a zone are UTC."""
    at = F.try_to_timestamp(raw)
    late = F.lit(now).cast("timestamp") + F.make_dt_interval(mins=F.lit(skew_minutes))
    return F.when((at >= F.lit(earliest).cast("timestamp")) & (at <= late), at)


def topic_match(df: DataFrame, topic: str, session: str, own: object, columns: list[str], listed: str) -> DataFrame:
    """Rows of other sessions that have the topic in one of the columns (any case), or as an element of an array."""
    hit = F.array_contains(listed, topic)
    for column in columns:
        hit = hit | F.contains(F.lower(column), F.lit(topic.lower()))
    return df.where((F.col(session) != F.lit(own)) & F.coalesce(hit, F.lit(False)))


def dominant_dimension(df: DataFrame, embedding: str) -> DataFrame:
    """Rows whose vector has the most frequent dimension (the smaller of equally frequent ones), with ``dimension`` and how many rows are ``skipped``."""
    counts = df.groupBy(F.size(embedding).alias("dimension")).agg(F.count("*").alias("n"))
    best = counts.agg(F.max(F.struct("n", (-F.col("dimension")).alias("d"))).alias("m"), F.sum("n").alias("all"))
    best = best.select((-F.col("m.d")).alias("dimension"), (F.col("all") - F.col("m.n")).alias("skipped"))
    return df.join(F.broadcast(best), F.size(embedding) == F.col("dimension"))


def first_level(legs: list[DataFrame], key: str) -> DataFrame:
    """Degradation ladder: the rows of the first leg that has any, with ``level``; all legs are declared, none is run twice."""
    ladder = None
    for level, leg in enumerate(legs):
        leg = leg.withColumn("level", F.lit(level))
        ladder = leg if ladder is None else ladder.unionByName(leg)
    reached = ladder.agg(F.min("level").alias("reached"))
    return ladder.join(F.broadcast(reached), F.col("level") == F.col("reached")).drop("reached")


def top_per_key(df: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key with their ``rank``; what is beyond is dropped before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def priority_union(frames: list[DataFrame], key: str, rank: str, k: int) -> DataFrame:
    """Each key once, from the first frame that has it; k in all, by frame and rank."""
    both = None
    for tier, frame in enumerate(frames):
        frame = frame.select(key, F.col(rank).alias("rank")).withColumn("tier", F.lit(tier))
        both = frame if both is None else both.unionByName(frame)
    first = both.groupBy(key).agg(F.min(F.struct("tier", "rank")).alias("at")).select(key, "at.tier", "at.rank")
    return first.orderBy("tier", "rank", key).limit(k)


def cache_is_stale(built: Column, now: str, count: Column, counted: Column, most_hours: float, most_drift: float) -> Column:
    """An index is stale from an age on, or when the number of rows has moved by more than a share of what it was (any row, where it was none)."""
    hours = F.timestamp_diff("SECOND", built, F.lit(now).cast("timestamp_ntz")) / 3600.0
    drift = F.when(counted == 0, (count > 0).cast("double")).otherwise(F.abs(count - counted) / counted)
    return built.isNull() | (hours >= most_hours) | (drift > most_drift)
