"""Statistics of order over ranges: running totals of any length, and Kendall's rank correlation by a distributed merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramite.session import written


def running_totals(df: DataFrame, keys: list[str], value: str, total: str = "total") -> DataFrame:
    """``df`` with the running total of a whole number in the order of its distinct keys, this row included.

    Rows are dealt into ranges; each range is added up by itself and begins with what the ranges before come to. The
    ranges are drawn once and written.
    """
    placed = written(df.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()), "ranges")
    sums = placed.groupBy("__range").agg(F.sum(value).alias("__sum"))
    before = sums.select("__range", F.coalesce(F.sum("__sum").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.sum(value).over(Window.partitionBy("__range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return placed.withColumn("__inside", inside).join(F.broadcast(before), "__range").withColumn(total, F.col("__before") + F.col("__inside")).drop("__range", "__before", "__inside")


def greatest_before(df: DataFrame, keys: list[str], value: str, name: str = "before") -> DataFrame:
    """``df`` with the greatest value of the rows before in the order of keys that no two rows share, null for the first; over ranges as ``running_totals``."""
    placed = written(df.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()), "ranges")
    upto = Window.rowsBetween(Window.unboundedPreceding, -1)
    tops = placed.groupBy("__range").agg(F.max(value).alias("__top"))
    over = tops.select("__range", F.max("__top").over(upto.orderBy("__range")).alias("__over"))
    inside = F.max(value).over(upto.partitionBy("__range").orderBy(*keys))
    return placed.withColumn("__inside", inside).join(F.broadcast(over), "__range").withColumn(name, F.greatest("__over", "__inside")).drop("__range", "__over", "__inside")


def sums_in_groups(df: DataFrame, by: list[str], keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """``df`` with running sums of whole numbers in each group, in the order of keys that no two of its rows share, this row included; over ranges as ``running_totals``, so a group can be as large as it likes. Groups and keys are not null."""
    placed = written(df.repartitionByRange(*by, *keys).withColumn("__range", F.spark_partition_id()), "ranges")
    parts = placed.groupBy(*by, "__range").agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    sooner = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(*by, "__range", *[F.coalesce(F.sum(name).over(sooner), F.lit(0)).alias(f"__{name}") for name in sums])
    inside = Window.partitionBy("__range", *by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = placed.withColumns({name: F.sum(c).over(inside) for name, c in sums.items()}).join(before, [*by, "__range"])
    return summed.withColumns({name: F.col(name) + F.col(f"__{name}") for name in sums}).drop("__range", *[f"__{name}" for name in sums])


def same_keys(one: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys that may be null; the keys of the first frame stay."""
    other = other.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return one.join(other, on, how).drop(*[f"__{k}" for k in keys])


def _places(cells: DataFrame, x: str, by: list[str], count: str) -> DataFrame:
    """Distinct (by, x) with their count, ``__first``, how many rows of the group are before, and ``__all``, how many it has."""
    told = running_totals(cells, [*by, x], count, "__upto")
    groups = told.groupBy(*by).agg(F.min(F.col("__upto") - F.col(count)).alias("__start"), F.sum(count).alias("__all"))
    joined = same_keys(told, groups, by) if by else told.crossJoin(groups)
    return joined.withColumn("__first", F.col("__upto") - F.col(count) - F.col("__start")).drop("__upto", "__start")


def quantiles(df: DataFrame, x: str, by: list[str], wanted: dict[str, float]) -> DataFrame:
    """(by, names of ``wanted``): exact quantiles of each group, between two values in proportion; nulls are left out.

    Distinct values are counted and placed by running totals over ranges, so no task holds a group.
    """
    cells = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("__n"))
    placed = _places(cells, x, by, "__n")
    value, first = F.col(x).cast("double"), F.col("__first")
    at = {name: F.lit(p) * (F.col("__all") - 1) for name, p in wanted.items()}
    met = lambda place: F.max(F.when((first <= place) & (place < first + F.col("__n")), value))
    ends = [c for name, pos in at.items() for c in (met(F.floor(pos)).alias(f"__low_{name}"), met(F.ceil(pos)).alias(f"__high_{name}"))]
    found = placed.groupBy(*by).agg(F.max("__all").alias("__all"), *ends)
    between = lambda name, pos: F.col(f"__low_{name}") + (F.col(f"__high_{name}") - F.col(f"__low_{name}")) * (pos - F.floor(pos))
    return found.select(*by, *[between(name, pos).alias(name) for name, pos in at.items()])


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by, rho): correlation of the ranks in each group, ties at the mean of their places; null where x or y is the same in all rows.

    Rows are counted by group, x and y; ranks are given to distinct values over ranges and joined with the counts.
    """
    cells = written(df.groupBy(*by, F.col(x).alias("__x"), F.col(y).alias("__y")).agg(F.count("*").alias("__c")), "cells")
    off = cells
    for side in ("__x", "__y"):
        values = cells.groupBy(*by, side).agg(F.sum("__c").alias("__n"))
        # places less the mean place of the group
        rank = F.col("__first") + (F.col("__n") - F.col("__all")) / 2.0
        off = same_keys(off, _places(values, side, by, "__n").select(*by, side, rank.alias(f"{side}_off")), [*by, side])
    u, v, c = F.col("__x_off"), F.col("__y_off"), F.col("__c")
    made = off.groupBy(*by).agg(F.sum(c * u * v).alias("uv"), F.sum(c * u * u).alias("uu"), F.sum(c * v * v).alias("vv"))
    return made.select(*by, F.try_divide("uv", F.sqrt("uu") * F.sqrt("vv")).alias("rho"))


def kendall(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """(by, n, tau): Kendall's tau-b of each group; null where x or y is the same in all rows. Rows with a null x or y are left out.

    Pairs are not listed. Each value of y gets its place among all; two rows differ first, from the highest bit down, at
    one bit of their places. So for every bit a row is written once under the bits above it, and among the rows under
    the same bits those with the bit are compared by x with those without it, by running totals over the order of x.
    These are as many rows as n times the bits of the number of values; they are added up before each shuffle, and no
    group is gathered.
    """
    cells = written(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(by).alias("g"), F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("c")), "kendall")
    places = running_totals(cells.select("g", "y").distinct().withColumn("one", F.lit(1).cast("long")), ["g", "y"], "one", "place").drop("one")
    there = places.select(F.col("g").alias("h"), F.col("y").alias("v"), "place")
    placed = cells.join(there, F.col("g").eqNullSafe(F.col("h")) & (F.col("y") == F.col("v"))).select("g", "x", "place", "c")
    bits = (cells.count() or 1).bit_length()
    level = F.explode(F.sequence(F.lit(0), F.lit(bits)))
    each = placed.withColumn("bit", level).select("g", "bit", F.expr("shiftright(place, bit + 1)").alias("above"), "x", F.expr("shiftright(place, bit) & 1").alias("has"), "c")
    sides = each.groupBy("g", "bit", "above", "x").agg(F.sum(F.when(F.col("has") == 0, F.col("c")).otherwise(0)).alias("low"), F.sum(F.when(F.col("has") == 1, F.col("c")).otherwise(0)).alias("high"))
    told = running_totals(sides, ["g", "bit", "above", "x"], "low", "upto")
    wide = lambda c: c.cast("decimal(19,0)")
    # of a row with the bit: twice what is below it, less what is beside and above
    part = told.groupBy("g", "bit", "above").agg(
        F.sum(wide(F.col("high")) * wide(2 * F.col("upto") - F.col("low"))).alias("s"),
        (2 * F.min(F.col("upto") - F.col("low")) + F.sum("low")).alias("rest"), F.sum("high").alias("high"),
    )
    score = part.groupBy("g").agg(F.sum(F.col("s").cast("decimal(38,0)") - wide(F.col("high")) * wide(F.col("rest"))).alias("s"))

    def tied(column: str, name: str) -> DataFrame:
        same = cells.groupBy("g", column).agg(F.sum("c").cast("double").alias("t"))
        return same.groupBy("g").agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias(name))

    sizes = cells.groupBy("g").agg(F.sum("c").alias("n"))
    out = sizes
    for frame in (score, tied("x", "tx"), tied("y", "ty")):
        frame = frame.withColumnRenamed("g", "k")
        out = out.join(frame, F.col("g").eqNullSafe(F.col("k"))).drop("k")
    pairs = F.col("n") * (F.col("n") - 1) / 2.0
    tau = F.try_divide(F.col("s").cast("double"), F.sqrt((pairs - F.col("tx")) * (pairs - F.col("ty"))))
    return out.select(F.col("g").alias(by), "n", tau.alias("tau"))
