"""Statistics on columns and frames that the numeric library offers for arrays; NumPy's conventions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramite.functions.ordered import quantiles, same_keys
from engramite.session import cut_lineage


def moments(df: DataFrame, x: str, by: list[str]) -> DataFrame:
    c = F.col(x)
    return df.groupBy(*by).agg(
        F.count(c).alias("n"), F.min(c).alias("low"), F.max(c).alias("high"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.var_pop(c).alias("var"), F.var_samp(c).alias("var_samp"),
        F.skewness(c).alias("skew"), F.kurtosis(c).alias("kurtosis"), (F.stddev_samp(c) / F.sqrt(F.count(c))).alias("sem"),
    )


def describe(df: DataFrame, x: str, by: list[str]) -> DataFrame:
    """``moments`` with the exact median and quartile range."""
    quarters = quantiles(df, x, by, {"low_quarter": 0.25, "median": 0.5, "high_quarter": 0.75})
    joined = same_keys(moments(df, x, by), quarters, by, "left")
    names = ["n", "low", "high", "mean", "std", "var", "var_samp", "median", "iqr", "skew", "kurtosis", "sem"]
    return joined.withColumn("iqr", F.col("high_quarter") - F.col("low_quarter")).select(*by, *names)


def weighted_mean(x: Column, w: Column) -> Column:
    return F.try_divide(F.sum(x * w), F.sum(w))


def histogram(df: DataFrame, x: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): equal bins, the last one closed; values outside are left out."""
    inside = df.where((F.col(x) >= low) & (F.col(x) <= high))
    number = F.least(F.floor((F.col(x) - low) / ((high - low) / bins)), F.lit(bins - 1))
    return inside.groupBy(number.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def entropy(df: DataFrame, key: str) -> DataFrame:
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    p = F.col("n") / F.col("all")
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all")))).agg((-F.sum(p * F.ln(p))).alias("entropy"))


def running(df: DataFrame, x: str, by: str, order: list[str]) -> DataFrame:
    """cumsum, diff, gradient, trapezoid and median of three (zero beyond the ends) of each key's series."""
    w = Window.partitionBy(by).orderBy(*order)
    before, after = F.lag(x).over(w), F.lead(x).over(w)
    three = F.array_sort(F.array(F.coalesce(before, F.lit(0.0)), F.col(x), F.coalesce(after, F.lit(0.0))))
    gradient = F.when(before.isNull(), after - F.col(x)).when(after.isNull(), F.col(x) - before).otherwise((after - before) / 2)
    return df.withColumns({"cumsum": F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, 0)), "diff": F.col(x) - before, "gradient": gradient, "area": (F.col(x) + before) / 2, "median3": three[1]})


def regression(df: DataFrame, y: str, x: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.corr(x, y).alias("r"), F.covar_samp(x, y).alias("cov"))


def welch(df: DataFrame, x: str, group: str, one: str, two: str) -> DataFrame:
    """t statistic and degrees of freedom of two groups with unequal variances."""
    a, b = F.when(F.col(group) == one, F.col(x)), F.when(F.col(group) == two, F.col(x))
    s = df.agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"), (F.var_samp(a) / F.count(a)).alias("va"), (F.var_samp(b) / F.count(b)).alias("vb"), F.count(a).alias("na"), F.count(b).alias("nb"))
    v = F.col("va") + F.col("vb")
    return s.select(F.try_divide(F.col("ma") - F.col("mb"), F.sqrt(v)).alias("t"), F.try_divide(v * v, F.col("va") ** 2 / (F.col("na") - 1) + F.col("vb") ** 2 / (F.col("nb") - 1)).alias("df"))


def one_way(df: DataFrame, x: str, group: str) -> DataFrame:
    """F statistic of the one-way analysis of variance."""
    g = df.groupBy(group).agg(F.count("*").alias("n"), F.avg(x).alias("m"), F.var_samp(x).alias("v"))
    total = g.agg(F.sum(F.col("n") * F.col("m")).alias("s"), F.sum("n").alias("all"), F.count("*").alias("k"))
    j = g.crossJoin(F.broadcast(total))
    between = F.sum(F.col("n") * (F.col("m") - F.col("s") / F.col("all")) ** 2) / (F.first("k") - 1)
    within = F.sum((F.col("n") - 1) * F.col("v")) / (F.first("all") - F.first("k"))
    return j.agg((between / within).alias("f"))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """(row, col, v): the product of two matrices in (row, col, v) form; absent places are 0."""
    left, right = a.select("row", F.col("col").alias("__k"), F.col("v").alias("__a")), b.select(F.col("row").alias("__k"), "col", F.col("v").alias("__b"))
    return left.join(right, "__k").groupBy("row", "col").agg(F.sum(F.col("__a") * F.col("__b")).alias("v"))


def polyval(coefficients: list[float], x: Column) -> Column:
    """Highest power first, by Horner's rule."""
    value = F.lit(0.0)
    for c in coefficients:
        value = value * x + c
    return value


def polyder(coefficients: list[float]) -> list[float]:
    n = len(coefficients) - 1
    return [c * (n - k) for k, c in enumerate(coefficients[:-1])] or [0.0]


def polyint(coefficients: list[float], constant: float = 0.0) -> list[float]:
    n = len(coefficients)
    return [c / (n - k) for k, c in enumerate(coefficients)] + [constant]


def ranks(df: DataFrame, x: str) -> DataFrame:
    """(x, n, rank): distinct values with how many rows have them and the mean of their places from 1.

    Counts come first, so that the running sum sees distinct values only; it runs over ranges of them, then over the
    sums of the ranges, and no task sees all.
    """
    counts = df.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("x")).agg(F.count("*").alias("n"))
    placed = counts.repartitionByRange("x").withColumn("__p", F.spark_partition_id())
    placed = cut_lineage(placed)  # the ranges are drawn once
    before = placed.groupBy("__p").agg(F.sum("n").alias("s")).withColumn("__before", F.coalesce(F.sum("s").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    upto = F.sum("n").over(Window.partitionBy("__p").orderBy("x"))
    return placed.withColumn("__upto", upto).join(F.broadcast(before.select("__p", "__before")), "__p").select("x", "n", (F.col("__before") + F.col("__upto") - (F.col("n") - 1) / 2.0).alias("rank"))


def kruskal(df: DataFrame, x: str, group: str) -> DataFrame:
    """(h): the rank statistic of several groups, without a correction for ties."""
    rows = df.groupBy(group, F.col(x).alias("x")).agg(F.count("*").alias("c")).join(ranks(df, x).select("x", "rank"), "x")
    g = rows.groupBy(group).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("rank")).alias("s"))
    total = g.agg(F.sum("n").alias("all"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q"))
    return total.select((12.0 / (F.col("all") * (F.col("all") + 1)) * F.col("q") - 3 * (F.col("all") + 1)).alias("h"))


def mann_whitney(df: DataFrame, x: str, group: str, one: str, two: str) -> DataFrame:
    """(u) of the first group."""
    both = df.where(F.col(group).isin(one, two))
    rows = both.groupBy(group, F.col(x).alias("x")).agg(F.count("*").alias("c")).join(ranks(both, x).select("x", "rank"), "x").where(F.col(group) == one)
    return rows.agg(F.sum(F.col("c") * F.col("rank")).alias("s"), F.sum("c").alias("n")).select((F.col("s") - F.col("n") * (F.col("n") + 1) / 2.0).alias("u"))


def ks_two(df: DataFrame, x: str, group: str, one: str, two: str) -> DataFrame:
    """(d): the largest difference of two groups' distribution functions, over distinct values in ranges."""
    a, b = F.count_if(F.col(group) == one), F.count_if(F.col(group) == two)
    counts = df.where(F.col(group).isin(one, two) & F.col(x).isNotNull()).groupBy(F.col(x).alias("x")).agg(a.alias("a"), b.alias("b"))
    placed = cut_lineage(counts.repartitionByRange("x").withColumn("__p", F.spark_partition_id()))
    w = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("__p").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb")).select("__p", F.coalesce(F.sum("sa").over(w), F.lit(0)).alias("ba"), F.coalesce(F.sum("sb").over(w), F.lit(0)).alias("bb"))
    total = placed.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    inner = Window.partitionBy("__p").orderBy("x")
    told = placed.withColumns({"ua": F.sum("a").over(inner), "ub": F.sum("b").over(inner)}).join(F.broadcast(before), "__p").crossJoin(F.broadcast(total))
    return told.agg(F.max(F.abs((F.col("ba") + F.col("ua")) / F.col("na") - (F.col("bb") + F.col("ub")) / F.col("nb"))).alias("d"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """(chi2, df) of independence of two columns; the table of expected counts is of their distinct values."""
    seen = df.groupBy(a, b).agg(F.count("*").alias("n"))
    rows, columns = seen.groupBy(a).agg(F.sum("n").alias("r")), seen.groupBy(b).agg(F.sum("n").alias("c"))
    total = seen.agg(F.sum("n").alias("t"), F.count_distinct(a).alias("na"), F.count_distinct(b).alias("nb"), F.sum("n").alias("s"))
    # cells without rows add their expected count: all expected counts come to the total
    cells = seen.join(rows, a).join(columns, b).crossJoin(F.broadcast(total)).withColumn("x", F.col("r") * F.col("c") / F.col("t"))
    return cells.agg((F.sum((F.col("n") - F.col("x")) ** 2 / F.col("x")) + F.first("t") - F.sum("x")).alias("chi2"), ((F.first("na") - 1) * (F.first("nb") - 1)).alias("df"))


def interpolate(df: DataFrame, by: str, x: str, y: str, tie: str) -> DataFrame:
    """Rows of a series between known values with ``filled``, linear in x; rows outside of them are left out."""
    w = Window.partitionBy(by).orderBy(x, tie)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(y).isNotNull(), F.struct(F.col(x).alias("x"), F.col(y).alias("y")))
    rows = df.withColumns({"__a": F.last(known, ignorenulls=True).over(back), "__b": F.first(known, ignorenulls=True).over(ahead)}).where("__a is not null and __b is not null")
    wide = F.col("__b.x") - F.col("__a.x")
    filled = F.when(wide == 0, F.col("__a.y")).otherwise(F.col("__a.y") + (F.col("__b.y") - F.col("__a.y")) * F.try_divide(F.col(x) - F.col("__a.x"), wide))
    return rows.withColumn("filled", filled).drop("__a", "__b")
