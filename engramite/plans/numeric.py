"""Statistics queries over the star schema and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramite.functions import numeric as nm
from engramite.functions import ordered as od
from engramite.plans.registry import query


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("NUM_describe", """SELECT l_returnflag, count(l_extendedprice) AS n, min(l_extendedprice) AS low, max(l_extendedprice) AS high, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS std, round(var_pop(l_extendedprice), 2) AS var, round(var_samp(l_extendedprice), 2) AS var_samp,
round(median(l_extendedprice), 4) AS median, round(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25), 4) AS iqr, round(stddev_samp(l_extendedprice) / sqrt(count(*)), 4) AS sem FROM lineitem GROUP BY 1""")
def describe(t):
    made = nm.describe(t.lineitem, "l_extendedprice", ["l_returnflag"]).drop("skew", "kurtosis")
    return rounded(rounded(made, "mean", "std", "median", "iqr", "sem", digits=4), "var", "var_samp", digits=2)


@query("NUM_moments", """WITH m AS (SELECT event_type, avg(value) AS m FROM events GROUP BY 1), c AS (SELECT e.event_type, e.value - m.m AS d FROM events e JOIN m ON m.event_type = e.event_type)
SELECT event_type, round(avg(d * d * d) / power(avg(d * d), 1.5), 6) AS skew, round(avg(d * d * d * d) / power(avg(d * d), 2) - 3, 6) AS kurtosis FROM c GROUP BY 1""")
def moments(t):
    return rounded(nm.moments(t.events, "value", ["event_type"]).select("event_type", "skew", "kurtosis"), "skew", "kurtosis")


@query("NUM_weighted_mean", "SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS mean FROM lineitem GROUP BY 1")
def weighted(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.round(nm.weighted_mean(F.col("l_extendedprice"), F.col("l_quantity")), 4).alias("mean"))


@query("NUM_histogram", "SELECT CAST(least(floor((value - 0) / 5.0), 19) AS INTEGER) AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 100 GROUP BY 1")
def histogram(t):
    return nm.histogram(t.events, "value", 0.0, 100.0, 20)


@query("NUM_quantiles", "SELECT p_brand, round(quantile_cont(p_retailprice, 0.1), 6) AS p10, round(quantile_cont(p_retailprice, 0.5), 6) AS p50, round(quantile_cont(p_retailprice, 0.95), 6) AS p95 FROM part GROUP BY 1")
def quantiles(t):
    return rounded(od.quantiles(t.part, "p_retailprice", ["p_brand"], {"p10": 0.1, "p50": 0.5, "p95": 0.95}), "p10", "p50", "p95")


@query("NUM_entropy", "WITH c AS (SELECT event_type, count(*) / CAST((SELECT count(*) FROM events) AS DOUBLE) AS p FROM events GROUP BY 1) SELECT round(-sum(p * ln(p)), 9) AS entropy FROM c")
def entropy(t):
    return rounded(nm.entropy(t.events, "event_type"), "entropy", digits=9)


@query("NUM_running", """SELECT event_id, round(sum(value) OVER w, 4) AS cumsum, round(value - lag(value) OVER w, 6) AS diff, round(CASE WHEN lag(value) OVER w IS NULL THEN lead(value) OVER w - value WHEN lead(value) OVER w IS NULL THEN value - lag(value) OVER w ELSE (lead(value) OVER w - lag(value) OVER w) / 2 END, 6) AS gradient, round((value + lag(value) OVER w) / 2, 6) AS area,
list_sort([coalesce(lag(value) OVER w, 0), value, coalesce(lead(value) OVER w, 0)])[2] AS median3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def running(t):
    made = nm.running(t.events, "value", "user_id", ["ts", "event_id"])
    return rounded(rounded(made, "cumsum", digits=4), "diff", "gradient", "area").select("event_id", "cumsum", "diff", "gradient", "area", "median3")


@query("NUM_spearman", """WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS x, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS y FROM lineitem) SELECT l_returnflag, round(corr(x, y), 6) AS rho FROM r GROUP BY 1""")
def spearman(t):
    return rounded(od.spearman(t.lineitem, "l_quantity", "l_extendedprice", ["l_returnflag"]), "rho")


@query("NUM_kendall", """WITH p AS (SELECT a.p_brand, sign(a.p_size - b.p_size) * sign(a.p_retailprice - b.p_retailprice) AS s, a.p_size = b.p_size AS tx, a.p_retailprice = b.p_retailprice AS ty FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey)
SELECT p_brand, (SELECT count(*) FROM part q WHERE q.p_brand = p.p_brand) AS n, round(sum(s) / sqrt(CAST(count(*) - count(*) FILTER (tx) AS DOUBLE) * (count(*) - count(*) FILTER (ty))), 9) AS tau FROM p GROUP BY 1""")
def kendall(t):
    return od.kendall(t.part, "p_size", "p_retailprice", "p_brand").withColumn("tau", F.round("tau", 9))


@query("NUM_regression", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(corr(l_quantity, l_extendedprice), 6) AS r, round(covar_samp(l_quantity, l_extendedprice), 4) AS cov FROM lineitem GROUP BY 1")
def regression(t):
    made = nm.regression(t.lineitem, "l_extendedprice", "l_quantity", ["l_returnflag"])
    return rounded(rounded(made, "slope", "r2", "r"), "intercept", "cov", digits=4)


@query("NUM_welch", "WITH s AS (SELECT avg(value) FILTER (event_type = 'view') AS ma, avg(value) FILTER (event_type = 'click') AS mb, var_samp(value) FILTER (event_type = 'view') / count(*) FILTER (event_type = 'view') AS va, var_samp(value) FILTER (event_type = 'click') / count(*) FILTER (event_type = 'click') AS vb, count(*) FILTER (event_type = 'view') AS na, count(*) FILTER (event_type = 'click') AS nb FROM events) SELECT round((ma - mb) / sqrt(va + vb), 6) AS t, round((va + vb) * (va + vb) / (va * va / (na - 1) + vb * vb / (nb - 1)), 4) AS df FROM s")
def welch(t):
    return nm.welch(t.events, "value", "event_type", "view", "click").select(F.round("t", 6).alias("t"), F.round("df", 4).alias("df"))


@query("NUM_one_way", "WITH g AS (SELECT event_type, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1), a AS (SELECT avg(value) AS m, count(*) AS n FROM events) SELECT round((sum(g.n * (g.m - a.m) * (g.m - a.m)) / (count(*) - 1)) / (sum((g.n - 1) * g.v) / (any_value(a.n) - count(*))), 6) AS f FROM g, a")
def one_way(t):
    return rounded(nm.one_way(t.events, "value", "event_type"), "f")


@query("NUM_elementwise", "SELECT p_partkey, round(sin(p_size) + cos(p_size) + tanh(p_size / 50.0), 9) AS trig, round(ln(p_retailprice) + log2(p_retailprice) + log10(p_retailprice) + exp(-p_size / 10.0) + cbrt(p_retailprice), 9) AS logs, floor(p_retailprice) AS low, ceil(p_retailprice) AS high, CAST(sign(p_size - 25) AS INTEGER) AS side, round(degrees(atan2(p_size, 10.0)), 6) AS angle FROM part")
def elementwise(t):
    p, s = F.col("p_retailprice"), F.col("p_size")
    return t.part.select(
        "p_partkey", F.round(F.sin(s) + F.cos(s) + F.tanh(s / 50.0), 9).alias("trig"), F.round(F.ln(p) + F.log2(p) + F.log10(p) + F.exp(-s / 10.0) + F.cbrt(p), 9).alias("logs"),
        F.floor(p).cast("double").alias("low"), F.ceil(p).cast("double").alias("high"), F.sign(s - 25).cast("int").alias("side"), F.round(F.degrees(F.atan2(s, F.lit(10.0))), 6).alias("angle"),
    )


@query("NUM_extremes", "SELECT l_orderkey, arg_max(l_linenumber, {'p': l_extendedprice, 'l': -l_linenumber}) AS argmax, arg_min(l_linenumber, {'p': l_extendedprice, 'l': l_linenumber}) AS argmin, count(*) FILTER (l_discount > 0) AS nonzero, bool_and(l_tax >= 0) AS every, bool_or(l_discount > 0.09) AS some FROM lineitem GROUP BY 1")
def extremes(t):
    return t.lineitem.groupBy("l_orderkey").agg(
        F.max_by("l_linenumber", F.struct("l_extendedprice", -F.col("l_linenumber"))).alias("argmax"), F.min_by("l_linenumber", F.struct("l_extendedprice", "l_linenumber")).alias("argmin"),
        F.count_if(F.col("l_discount") > 0).alias("nonzero"), F.bool_and(F.col("l_tax") >= 0).alias("every"), F.bool_or(F.col("l_discount") > 0.09).alias("some"),
    )


@query("AGG_rollup", "SELECT coalesce(l_returnflag, 'all') AS flag, coalesce(l_linestatus, 'all') AS status, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(t):
    made = t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return made.select(F.coalesce("l_returnflag", F.lit("all")).alias("flag"), F.coalesce("l_linestatus", F.lit("all")).alias("status"), "n", "quantity")
