"""Health metrics over learnings: one pass of conditional aggregates for each report.

A frame of learnings has id, project, type, confidence, created_at, superseded_by, archived_at, recall_count and
last_recalled. Ages are counted from an explicit moment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moment(as_of: str) -> Column:
    return F.expr(f"timestamp_ntz'{as_of}'")


def days_before(as_of: str, days: int) -> Column:
    return F.expr(f"timestamp_ntz'{as_of}' - interval {int(days)} days")


def active(df: DataFrame, superseded: bool = True, archived: bool = True) -> DataFrame:
    """Rows in use; each of the two conditions can be left out, and is where its column does not exist."""
    for wanted, column in ((superseded, "superseded_by"), (archived, "archived_at")):
        if wanted and column in df.columns:
            df = df.where(F.col(column).isNull())
    return df


def share(part: Column, whole: Column, digits: int = 1) -> Column:
    """Percentage, 0.0 of nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(F.lit(100.0) * part / whole, digits))


def totals(df: DataFrame) -> DataFrame:
    gone, kept = F.col("superseded_by").isNotNull(), F.col("archived_at").isNotNull()
    return df.agg(F.count_if(~gone & ~kept).alias("active"), F.count_if(gone).alias("superseded"), F.count_if(kept & ~gone).alias("archived"), F.count("*").alias("total"))


def per_session(df: DataFrame, session: str, latest: int = 10) -> DataFrame:
    """Average, least and most rows of the latest sessions, and the overall average; zeros of nothing."""
    each = df.groupBy(session).agg(F.count("*").alias("n"), F.max("created_at").alias("last"))
    recent = each.orderBy(F.desc("last"), session).limit(latest).agg(F.coalesce(F.round(F.avg("n"), 1), F.lit(0.0)).alias("recent_avg"), F.coalesce(F.min("n"), F.lit(0)).alias("recent_min"), F.coalesce(F.max("n"), F.lit(0)).alias("recent_max"))
    overall = each.agg(F.coalesce(F.round(F.avg("n"), 1), F.lit(0.0)).alias("overall_avg"), F.count("*").alias("sessions"))
    return recent.crossJoin(overall)  # one row each


def distribution(df: DataFrame, key: str, missing: str = "unset") -> DataFrame:
    """Counts and percentages by a key, nulls under a name."""
    counts = df.groupBy(F.coalesce(key, F.lit(missing)).alias(key)).agg(F.count("*").alias("n"))
    # a window without keys would move all groups to one task; their total is one row
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(key, "n", share(F.col("n"), F.col("total")).alias("pct"))


def coverage(df: DataFrame, *columns: str) -> DataFrame:
    return df.agg(F.count("*").alias("total"), *[F.count(c).alias(f"with_{c}") for c in columns], *[share(F.count(c), F.count("*")).alias(f"{c}_pct") for c in columns])


def weekly_velocity(df: DataFrame, at: str, as_of: str, weeks: int = 4) -> DataFrame:
    """Rows by week (from Monday) of the last weeks, and their average over exactly that many weeks."""
    recent = df.where((F.col(at) >= days_before(as_of, 7 * weeks)) & (F.col(at) < moment(as_of)))
    counts = recent.groupBy(F.date_trunc("week", at).cast("date").alias("week")).agg(F.count("*").alias("n"))
    total = counts.agg(F.round(F.coalesce(F.sum("n"), F.lit(0)) / F.lit(float(weeks)), 2).alias("per_week"))
    return counts.crossJoin(F.broadcast(total))


def aged_never_recalled(df: DataFrame, as_of: str, days: int) -> DataFrame:
    return active(df, archived=False).where((F.col("recall_count") == 0) & (F.col("created_at") < days_before(as_of, days))).groupBy(F.coalesce("confidence", F.lit("unset")).alias("confidence")).agg(F.count("*").alias("n"))


def recall_frequency(df: DataFrame) -> DataFrame:
    used = F.when(F.col("recall_count") > 0, F.col("recall_count"))
    return active(df, archived=False).agg(F.count(used).alias("recalled"), F.coalesce(F.round(F.avg(used), 2), F.lit(0.0)).alias("avg_recalls"), F.coalesce(F.sum("recall_count"), F.lit(0)).alias("recalls"), F.coalesce(F.max("recall_count"), F.lit(0)).alias("most"))


def type_recall(df: DataFrame) -> DataFrame:
    return active(df, archived=False).groupBy("type").agg(F.count("*").alias("stored"), F.count_if(F.col("recall_count") > 0).alias("recalled"), share(F.count_if(F.col("recall_count") > 0), F.count("*")).alias("pct"))


def temporal(df: DataFrame, as_of: str, stale_days: int = 60) -> DataFrame:
    return df.agg(
        F.min("created_at").alias("first"), F.max("created_at").alias("last"),
        F.count_if(F.col("created_at") >= days_before(as_of, 7)).alias("last_7"), F.count_if(F.col("created_at") >= days_before(as_of, 30)).alias("last_30"),
        F.count_if(F.col("superseded_by").isNull() & (F.col("recall_count") == 0) & (F.col("created_at") < days_before(as_of, stale_days))).alias("stale"),
        share(F.count("superseded_by"), F.count("*")).alias("superseded_pct"),
    )


def stale_buckets(df: DataFrame, as_of: str) -> DataFrame:
    """Rows by how old they are and whether they were ever recalled."""
    old, never = F.col("created_at") < days_before(as_of, 30), F.col("recall_count") == 0
    bucket = F.when(never & (F.col("created_at") < days_before(as_of, 60)), "never recalled, over 60 days").when(never & old, "never recalled, 30 to 60 days").when(never, "never recalled, new").when(F.col("last_recalled") < days_before(as_of, 45), "recalled, long ago").otherwise("recalled")
    return active(df).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def top_groups(df: DataFrame, key: str, limit: int) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(limit)


def votes(feedback: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Of groups with at least ``least`` votes and no tie the verdict, most votes first in ties of evidence."""
    each = feedback.groupBy(*keys).agg(F.count_if("helpful").alias("yes"), F.count_if(~F.col("helpful")).alias("no"))
    return each.where((F.col("yes") != F.col("no")) & (F.col("yes") + F.col("no") >= least)).withColumn("verdict", F.col("yes") > F.col("no"))


def confusion(df: DataFrame, expected: str, predicted: str) -> DataFrame:
    """For each class: support, predicted, correct, precision and recall (three digits, 0.0 of nothing)."""
    cells = df.groupBy(F.col(expected).alias("e"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    rows = cells.groupBy(F.col("e").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("e") == F.col("p"), F.col("n")).otherwise(0)).alias("hits"))
    columns = cells.groupBy(F.col("p").alias("class")).agg(F.sum("n").alias("predicted"))
    both = rows.join(columns, "class", "full").na.fill(0)
    ratio = lambda a, b: F.when(F.col(b) == 0, F.lit(0.0)).otherwise(F.round(F.col(a) / F.col(b), 3))
    return both.select("class", "support", "predicted", "hits", ratio("hits", "predicted").alias("precision"), ratio("hits", "support").alias("recall"))


def loops(events: DataFrame, session: str, tool: str, most: int) -> DataFrame:
    """Sessions that call one tool more often than that."""
    return events.groupBy(session, tool).agg(F.count("*").alias("calls")).where(F.col("calls") > most)


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order that leaves no ties."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(by)).where("__rank = 1").drop("__rank")
