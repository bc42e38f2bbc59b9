"""Sequences of events: sessions, as-of joins, gaps, interval unions, workflow patterns, lineages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramite.session import cut_lineage


def sessions(events: DataFrame, key: str, at: str, gap_seconds: int, tie: str) -> DataFrame:
    """``events`` with a session number for each key: a longer gap starts a new one."""
    by = Window.partitionBy(key).orderBy(at, tie)
    late = F.expr(f"timestampdiff(MICROSECOND, __before, {at})") > gap_seconds * 1_000_000
    marked = events.withColumn("__before", F.lag(at).over(by)).withColumn("__new", F.when(F.col("__before").isNull() | late, 1).otherwise(0))
    return marked.withColumn("session", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("__before", "__new")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, back_seconds: int, left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id): for each left row the latest right row of its key at or before it, not further back than that.

    One pass over the union of both sides sorted by key and time; no pairs are formed.
    """
    sides = left.select(key, at, F.col(left_id).alias("l"), F.lit(None).cast("long").alias("r")).unionByName(right.select(key, at, F.lit(None).cast("long").alias("l"), F.col(right_id).alias("r")))
    order = Window.partitionBy(key).orderBy(F.col(at), F.col("l").isNotNull(), F.coalesce("r", F.lit(-1))).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("r").isNotNull(), F.struct("r", F.col(at).alias("t"))), ignorenulls=True).over(order)
    found = sides.withColumn("m", last).where("l is not null")
    near = F.expr(f"timestampdiff(MICROSECOND, m.t, {at})") <= back_seconds * 1_000_000
    return found.select(F.col("l").alias(left_id), F.when(near, F.col("m.r")).alias(right_id))


def gaps(events: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """``events`` with the seconds to the next event of the key."""
    by = Window.partitionBy(key).orderBy(at, tie)
    return events.withColumn("next_at", F.lead(at).over(by)).withColumn("gap", F.expr(f"timestampdiff(MICROSECOND, {at}, next_at)") / 1e6)


def union_seconds(intervals: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, islands, seconds): what the intervals of a key cover together; reversed ones are left out."""
    rows = intervals.where(F.col(end) >= F.col(start))
    before = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    reach = rows.withColumn("__reach", F.max(end).over(before))
    fresh = reach.withColumn("__new", F.when(F.col("__reach").isNull() | (F.col(start) > F.col("__reach")), 1).otherwise(0))
    island = fresh.withColumn("__island", F.sum("__new").over(Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)))
    parts = island.groupBy(key, "__island").agg(F.min(start).alias("a"), F.max(end).alias("b"))
    return parts.groupBy(key).agg(F.count("*").alias("islands"), F.round(F.sum(F.expr("timestampdiff(MICROSECOND, a, b)") / 1e6), 3).alias("seconds"))


def workflows(events: DataFrame, key: str, order: list[str], symbol: Column, patterns: dict[str, str]) -> DataFrame:
    """(key, pattern, n): how often each pattern occurs in the string of a key's symbols; longer patterns are counted first and consume."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, symbol.alias("s"))))
    rest = events.groupBy(key).agg(F.array_join(F.transform(ordered, lambda e: e["s"]), "").alias("symbols"))
    counts, left = [], F.col("symbols")
    for name in sorted(patterns, key=lambda p: (-len(patterns[p]), p)):
        counts.append(F.struct(F.lit(name).alias("pattern"), F.regexp_count(left, F.lit(patterns[name])).cast("long").alias("n")))
        left = F.regexp_replace(left, patterns[name], "_")
    return rest.select(key, F.explode(F.array(*counts)).alias("c")).select(key, "c.pattern", "c.n").where("n > 0")


def turn_pairs(turns: DataFrame, key: str, order: str, role: str, asked: str, answered: str) -> DataFrame:
    """Each asking turn with the first answering turn after it, before the next asking one; null if there is none."""
    by = Window.partitionBy(key).orderBy(order)
    grouped = turns.withColumn("__ask", F.sum(F.when(F.col(role) == asked, 1).otherwise(0)).over(by))
    pairs = grouped.where("__ask > 0").groupBy(key, "__ask").agg(F.min(F.when(F.col(role) == asked, F.col(order))).alias("asked_at"), F.min(F.when(F.col(role) == answered, F.col(order))).alias("answered_at"))
    return pairs.drop("__ask")


def ancestors(nodes: DataFrame, node: str, parent: str, most_rounds: int = 40) -> DataFrame:
    """(node, root, depth) in a forest, by pointer doubling; nodes on a cycle or below one, and duplicates, are left out.

    A parent that does not exist makes its child a root.
    """
    rows = nodes.groupBy(node).agg(F.count("*").alias("n"), F.first(parent).alias("p")).where("n = 1").select(F.col(node).alias("node"), "p")
    known = rows.select(F.col("node").alias("p"), F.lit(1).alias("there"))
    state = rows.join(known, "p", "left").select("node", F.when(F.col("there") == 1, F.col("p")).alias("up"))
    state = cut_lineage(state.select("node", F.coalesce("up", "node").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("up").isNull().alias("done")))
    for _ in range(most_rounds):
        above = state.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("done").alias("done2"))
        state = cut_lineage(state.join(above, "up").select("node", F.col("up2").alias("up"), F.when(F.col("done"), F.col("depth")).otherwise(F.col("depth") + F.col("d2")).alias("depth"), (F.col("done") | F.col("done2")).alias("done")))
        left = state.where("not done").count()
        if not left or state.where("not done and up = node").count() == left:
            break
    return state.where("done").select("node", F.col("up").alias("root"), "depth")


def merge_episodes(episodes: DataFrame, episode: str, shared: str, rank: str, at: str) -> DataFrame:
    """(merged, episodes, strongest, first, last): episodes that share an affected event are one, with the strongest class and the outer times.

    ``episodes`` has a row for each episode and affected event. The bipartite graph of both is cut into components;
    events are told from episodes by their sign.
    """
    from engramite.operators.components import connected_components

    edges = episodes.select(F.col(episode).alias("u"), (-1 - F.col(shared)).alias("v"))
    parts = connected_components(edges, "u", "v").where("node >= 0").select(F.col("node").alias(episode), "component")
    each = episodes.groupBy(episode).agg(F.max(rank).alias("r"), F.min(at).alias("first"), F.max(at).alias("last"))
    made = each.join(parts, episode).groupBy("component").agg(F.min(episode).alias("merged"), F.count("*").alias("episodes"), F.max("r").alias("strongest"), F.min("first").alias("first"), F.max("last").alias("last"))
    return made.drop("component")
