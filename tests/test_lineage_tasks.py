"""Lineages of small sessions, each in a task, against the rounds that do sessions of any size."""

import random

from pyspark.sql import functions as F

from engramite.operators import lineage
from engramite.plans.registry import Tables
from engramite.plans import lineage as plans
from engramite.session import written
from tests.test_lineage import SCHEMA, made


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_tasks_and_rounds_find_the_same(spark):
    frame = spark.createDataFrame(made(random.Random(31)), SCHEMA)
    found = {}
    for most in (lineage.tasks.SESSION_ROWS, 60, 0):  # all sessions in tasks, some, none
        marked = written(lineage.annotate(frame, "session", "id", "up", "line", F.col("turn"), F.col("side"), most_rows=most))
        events = written(marked.where("id is not null").withColumn("no", F.row_number().over(lineage.Window.partitionBy("session").orderBy("line", "id", "up", "turn", "side")).cast("long")))
        parents = written(lineage.event_parents(events, marked, "session", "id", "no", most_rows=most))
        signals = {"odd": (F.col("no") % 2).cast("long"), "best": F.when(F.col("no") % 3 == 0, F.col("no") % 10)}
        back = lineage.look_back(parents, "session", "no", "parent", 13, signals, {"odd": "sum", "best": "max"}, most_rows=most)
        asked = parents.where("no % 3 = 0").select(F.col("session").alias("s"), F.col("no").alias("u"))
        near = lineage.around(parents, "session", "no", "parent", 7, asked, most_rows=most)
        ahead = lineage.look_ahead(parents, "session", "no", "parent", 7, F.col("no") % 3 == 0, F.col("no") % 4 == 0, most_rows=most)
        found[most] = [rows_of(x) for x in (marked, parents, back, *near, ahead)]
    first, *others = found.values()
    assert all(len(x) > 100 for x in first)
    for other in others:
        assert [a == b for a, b in zip(first, other, strict=True)] == [True] * 6


def test_small_sessions_take_no_rounds(spark, sf):
    """Each round was a table of its own: some hundred jobs for any input."""
    for k, query in enumerate((plans.lineages, plans.lineage_counts, plans.tool_events, plans.lineage_back, plans.lineage_ahead)):
        spark.sparkContext.setJobGroup(f"few-{k}", "")
        assert query(Tables(spark, sf)).count() > 0
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"few-{k}")) < 60
    spark.sparkContext.setJobGroup("rest", "")
