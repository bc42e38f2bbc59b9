"""Running totals and Kendall's tau against plain loops."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from engramite.functions import numeric, ordered
from engramite.plans import library


def tau(rows):
    s = tx = ty = 0
    for i, (a, b) in enumerate(rows):
        for c, d in rows[:i]:
            s += ((a > c) - (a < c)) * ((b > d) - (b < d))
            tx, ty = tx + (a == c), ty + (b == d)
    pairs = len(rows) * (len(rows) - 1) / 2
    return s / math.sqrt((pairs - tx) * (pairs - ty)) if pairs > tx and pairs > ty else None


def test_kendall_is_its_definition(spark):
    draw = random.Random(9)
    groups = {
        "many": [(draw.randint(0, 40), draw.uniform(-5, 5)) for _ in range(400)], "ties": [(draw.randint(0, 3), draw.randint(0, 2)) for _ in range(200)], "up": [(k, k * k) for k in range(70)], "down": [(k, -k) for k in range(70)],
        "one": [(1, 1)], "flat": [(1, k) for k in range(5)], None: [(draw.random(), draw.random()) for _ in range(30)],
    }
    rows = [(g, float(x), float(y)) for g, values in groups.items() for x, y in values] + [("many", None, 1.0), ("many", 1.0, None), ("gone", None, None)]
    got = {r.g: (r.n, r.tau) for r in ordered.kendall(spark.createDataFrame(rows, "g string, x double, y double").repartition(5), "x", "y", "g").collect()}
    assert got.keys() == groups.keys()
    for g, values in groups.items():
        want = tau(values)
        assert got[g][0] == len(values) and (got[g][1] is None if want is None else got[g][1] == pytest.approx(want, abs=1e-12)), g
    assert ordered.kendall(spark.createDataFrame([], "g string, x double, y double"), "x", "y", "g").count() == 0


def test_running_totals_over_ranges(spark):
    frame = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 5).alias("v"))
    got = {r.k: r.total for r in ordered.running_totals(frame, ["k"], "v").collect()}
    values = {k * 7919 % 1000: k % 5 for k in range(1000)}
    total = 0
    for k in sorted(values):
        total += values[k]
        assert got[k] == total


def test_quantiles_and_ranks_gather_no_group(spark):
    """Ties, one row, equal rows, null keys and values, a group of nulls only; and no window or percentile over a whole group."""
    draw = random.Random(4)
    groups = {"a": [(draw.randint(0, 9), draw.randint(0, 400)) for _ in range(300)], "b": [(1, 2)], "c": [(3, k) for k in range(4)], None: [(draw.random(), draw.random()) for _ in range(21)]}
    rows = [(g, float(x), float(y)) for g, values in groups.items() for x, y in values]
    frame = spark.createDataFrame([*rows, ("a", 1.0, None), ("gone", 1.0, None)], "g string, x double, y double").repartition(5)
    made = numeric.describe(frame, "y", ["g"])
    assert "percentile" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = {r.g: r for r in made.collect()}
    for g, values in groups.items():
        low, median, high = np.quantile([y for _, y in values], [0.25, 0.5, 0.75])
        assert got[g]["n"] == len(values) and (got[g]["median"], got[g]["iqr"]) == (pytest.approx(median), pytest.approx(high - low, abs=1e-12))
    assert (got["gone"]["n"], got["gone"]["median"]) == (0, None)
    found = ordered.spearman(spark.createDataFrame(rows, "g string, x double, y double").repartition(3), "x", "y", ["g"])
    assert "windowspecdefinition(g#" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r.g: r.rho for r in found.collect()}
    for g, values in groups.items():
        x, y = (pd.Series(side).rank() for side in zip(*values, strict=True))
        want = x.corr(y) if len(values) > 1 and x.nunique() > 1 else None
        assert got[g] is None if want is None else got[g] == pytest.approx(want, abs=1e-9), g


def test_late_rows_of_one_place_stand_in_the_order_of_their_numbers(spark, tmp_path):
    """Three rounds of numbers that fall on the same places, in files of any order."""
    draw = random.Random(6)
    rows = [(k, datetime(2024, 1, 1) + timedelta(hours=draw.randint(0, 2000))) for k in range(30000)]
    draw.shuffle(rows)
    path = f"{tmp_path}/events.parquet"
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz").repartition(7).write.parquet(path)
    top, late = None, 0
    for _, _, ts in sorted((k * 7919 % 10007, k, ts) for k, ts in rows):
        late += top is not None and ts < top - timedelta(days=1)
        top = ts if top is None else max(top, ts)
    assert tuple(library.QUERIES["ST_late_rows"](spark, str(tmp_path)).first()) == (len(rows), late)
