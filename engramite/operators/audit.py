"""Session audit: time attribution over intervals, candidates for judging, decisions, reports; jobs that are due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds that an inferred gap counts at most, in the central and in the inclusive estimate.
CENTRAL_CAP, INCLUSIVE_CAP = 300, 900


def _seconds(intervals: DataFrame, key: str) -> DataFrame:
    """(key, seconds) of the union of (start, end)."""
    by = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.withColumn("__new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    parts = marked.withColumn("__k", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0))).groupBy(key, "__k").agg(F.min("start").alias("a"), F.max("end").alias("b"))
    return parts.groupBy(key).agg(F.sum(F.timestamp_diff("MICROSECOND", "a", "b") / 1e6).alias("seconds"))


def attribution(intervals: DataFrame, key: str) -> DataFrame:
    """(key, low, central, high, missing, invalid, unrelated, idle) of intervals (kind, start, end, same_lineage, human).

    Kinds are observed (whole), affected (capped at 300 s) and ambiguous (capped at 900 s). Low is the union of the
    observed ones, central adds the affected, high the ambiguous ones. Intervals of another lineage or across a human
    turn are left out; one without both ends, or that ends before it starts, makes null what depends on it.
    """
    out = ~F.col("same_lineage") | F.col("human")
    missing = ~out & (F.col("start").isNull() | F.col("end").isNull())
    invalid = ~out & ~missing & (F.col("end") < F.col("start"))
    cap = F.when(F.col("kind") == "affected", CENTRAL_CAP).when(F.col("kind") == "ambiguous", INCLUSIVE_CAP)
    capped = F.when(cap.isNull(), F.col("end")).otherwise(F.least("end", F.col("start") + F.make_dt_interval(secs=cap.cast("decimal(18,6)"))))
    told = intervals.select(key, "kind", "start", capped.alias("end"), out.alias("out"), missing.alias("missing"), invalid.alias("invalid"), F.col("same_lineage").alias("same"))
    bad = lambda *kinds: F.count_if((F.col("missing") | F.col("invalid")) & F.col("kind").isin(*kinds)) == 0
    counts = told.groupBy(key).agg(
        bad("observed").alias("c0"), bad("observed", "affected").alias("c1"), bad("observed", "affected", "ambiguous").alias("c2"), F.count_if("missing").alias("missing"),
        F.count_if("invalid").alias("invalid"), F.count_if(~F.col("same")).alias("unrelated"), F.count_if(F.col("out") & F.col("same")).alias("idle"),
    )
    good = told.where(~F.col("out") & ~F.col("missing") & ~F.col("invalid"))
    for name, whole, kinds in (("low", "c0", ["observed"]), ("central", "c1", ["observed", "affected"]), ("high", "c2", ["observed", "affected", "ambiguous"])):
        sums = _seconds(good.where(F.col("kind").isin(kinds)), key).withColumnRenamed("seconds", name)
        counts = counts.join(sums, key, "left").withColumn(name, F.when(F.col(whole), F.coalesce(name, F.lit(0.0))))
    return counts.select(key, "low", "central", "high", "missing", "invalid", "unrelated", "idle")


def judge_candidates(episodes: DataFrame, key: str, order: list[Column], most: int, text: str, longest: int) -> DataFrame:
    """The first episodes in an order with bounded excerpts: what is sent to a judge. ``cut`` tells whether an excerpt was shortened."""
    top = episodes.orderBy(*order).limit(most)
    return top.withColumns({"excerpt": F.substring(text, 1, longest), "cut": F.length(text) > longest})


def apply_decisions(episodes: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """episodes (class, confidence) with a judge's decisions (class, confidence) where there are such: the confidence held between 0 and 1, classes that are not known ignored, and never a stronger class than was found."""
    rank = lambda c: F.when(c == "confirmed", 2).when(c == "probable", 1).when(c == "dismissed", 0)
    said = decisions.select(key, F.col("class").alias("__class"), F.col("confidence").alias("__sure"))
    joined = episodes.join(said, key, "left")
    taken = rank(F.col("__class")).isNotNull() & (rank(F.col("__class")) <= rank(F.col("class")))
    sure = F.least(F.greatest(F.col("__sure"), F.lit(0.0)), F.lit(1.0))
    return joined.withColumns({"class": F.when(taken, F.col("__class")).otherwise(F.col("class")), "confidence": F.when(taken, F.coalesce(sure, "confidence")).otherwise(F.col("confidence")), "judged": F.coalesce(taken, F.lit(False))}).drop("__class", "__sure")


def report(episodes: DataFrame, timing: DataFrame, key: str, excerpt: str, longest: int = 500) -> DataFrame:
    """(key, report): one JSON object for each session: its episodes in order with bounded excerpts, and its times."""
    each = F.struct("at", "class", F.when(F.length(excerpt) > longest, F.concat(F.substring(excerpt, 1, longest), F.lit("..."))).otherwise(F.col(excerpt)).alias("excerpt"))
    told = episodes.groupBy(key).agg(F.array_sort(F.collect_list(each)).alias("episodes"), F.count("*").alias("n"))
    return told.join(timing, key, "left").select(key, F.to_json(F.struct("n", "episodes", F.struct("low", "central", "high").alias("seconds")), {"ignoreNullFields": "false"}).alias("report"))


def jobs_due(jobs: DataFrame, now: str) -> DataFrame:
    """jobs (job, every_seconds, last_run, running) with ``due``: never run, or the interval is over; one that runs is not started again."""
    past = F.timestamp_diff("SECOND", F.col("last_run"), F.lit(now).cast("timestamp_ntz")) >= F.col("every_seconds")
    return jobs.withColumn("due", ~F.coalesce("running", F.lit(False)) & (F.col("last_run").isNull() | past))
