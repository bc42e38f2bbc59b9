"""Stores as frames: inserts, upserts, supersession, retention, curation plans. A write is a new frame made of the old one and a change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramite.operators.metrics import active, days_before, latest, moment


def insert_if_absent(store: DataFrame, new: DataFrame, key: str, *order: Column) -> DataFrame:
    """Of ``new`` the first row of each key that the store does not have."""
    return latest(new, [key], *order).join(store.select(key).distinct(), key, "left_anti")


def upsert(store: DataFrame, new: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The latest row of each key of both; of equal times the new one."""
    both = store.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return latest(both, keys, F.desc(at), F.desc("__new")).drop("__new")


def replace_children(children: DataFrame, fresh: DataFrame, parent: str) -> DataFrame:
    """All children of the parents that ``fresh`` has are replaced by its."""
    return children.join(fresh.select(parent).distinct(), parent, "left_anti").unionByName(fresh)


def reconcile(stored: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """Stored rows that were observed; all of them if nothing was (a missing root deletes nothing)."""
    return stored.join(observed.select(key).distinct(), key, "left_semi")


def supersede(store: DataFrame, plan: DataFrame, key: str, at: str) -> DataFrame:
    """Apply (loser, keeper) pairs: only to losers in use, only with keepers in use, only within one project."""
    alive = active(store).select(F.col(key).alias("keeper"), F.col("project").alias("keeper_project"))
    good = plan.join(alive, "keeper").select(F.col("loser").alias(key), "keeper", "keeper_project")
    joined = store.join(good, key, "left")
    apply = F.col("keeper").isNotNull() & F.col("superseded_by").isNull() & F.col("project").eqNullSafe(F.col("keeper_project"))
    return joined.withColumns({"superseded_by": F.when(apply, F.col("keeper")).otherwise(F.col("superseded_by")), "superseded_at": F.when(apply, moment(at))}).drop("keeper", "keeper_project")


def recall_counters(log: DataFrame, ids: str, at: str) -> DataFrame:
    """(id, recall_count, last_recalled) from a log of arrays of ids."""
    return log.select(F.explode(ids).alias("id"), F.col(at).alias("at")).groupBy("id").agg(F.count("*").alias("recall_count"), F.max("at").alias("last_recalled"))


def prune(log: DataFrame, at: str, as_of: str, days: int, batch: int, batches: int) -> DataFrame:
    """(deleted, complete): how much of what is too old a run of bounded batches takes."""
    old = log.where(F.col(at) < days_before(as_of, days)).agg(F.count("*").alias("n"))
    return old.select(F.least("n", F.lit(batch * batches)).alias("deleted"), (F.col("n") <= batch * batches).alias("complete"))


def union_capped(prior: Column, fresh: Column, cap: int) -> Column:
    """First occurrences of both in order, the newest ``cap`` of them."""
    both = F.filter(F.array_distinct(F.concat(prior, fresh)), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(both) > cap, F.slice(both, -cap, cap)).otherwise(both)


def keeper(groups: DataFrame, by: list[str], key: str = "id") -> DataFrame:
    """(loser, keeper) of each group in use: most recalled, then oldest, then smallest id stays."""
    best = F.min_by(key, F.struct(-F.col("recall_count"), "created_at", key))
    rows = active(groups)
    chosen = rows.groupBy(*by).agg(best.alias("keeper"), F.count("*").alias("n")).where("n > 1")
    return rows.join(chosen, by).where(F.col(key) != F.col("keeper")).select(F.col(key).alias("loser"), "keeper")


def promotions(df: DataFrame, types: dict[str, str], least: int) -> DataFrame:
    """Much recalled rows of the types that have a destination."""
    route = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
    return active(df).where((F.col("recall_count") >= least) & F.col("type").isin(list(types))).withColumn("destination", route[F.col("type")])


def push_candidates(patterns: DataFrame, stale: DataFrame, key: str, k: int) -> DataFrame:
    """Patterns first, then stale rows; each once, k in all. Both have ``rank``."""
    both = patterns.select(key, F.lit(0).alias("tier"), "rank").unionByName(stale.select(key, F.lit(1).alias("tier"), "rank"))
    first = both.groupBy(key).agg(F.min(F.struct("tier", "rank")).alias("place"))
    return first.orderBy("place.tier", "place.rank", key).limit(k).select(key, F.col("place.tier").alias("tier"), F.col("place.rank").alias("rank"))


def ingest_actions(observed: DataFrame, stored: DataFrame, key: str, most_bytes: int, most_chunks: int) -> DataFrame:
    """What to do with each file: observed (size, hash, supported, chunks), stored (stored_hash, stored_status)."""
    both = observed.join(stored, key, "full")
    gone, too_large = F.col("size").isNull(), F.col("size") > most_bytes
    same = (F.col("hash") == F.col("stored_hash")) & (F.col("stored_status") != "error")
    action = F.when(gone, "delete").when(too_large, F.when(F.col("stored_hash").isNotNull(), "delete").otherwise("skip_too_large")).when(F.coalesce(same, F.lit(False)), "unchanged").when(~F.col("supported"), "unsupported").when(F.col("chunks") > most_chunks, "error").when(F.col("stored_hash").isNull(), "insert").otherwise("update")
    return both.select(key, action.alias("action"))


def scope_gate(chunks: DataFrame, collection: str | None) -> DataFrame:
    """A named collection whatever its scope, else the global ones; there is no way to all."""
    return chunks.where(F.col("collection") == collection) if collection is not None else chunks.where(F.col("scope") == "global")


def importance_sample(spans: DataFrame, key: str, order: str, head: int, tail: int, score: Column, size: Column, budget: int) -> DataFrame:
    """First and last spans of a key, and of the middle the most important ones while their sizes fit the budget."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    rows = spans.withColumns({"__n": n, "__back": back, "__score": score, "__size": size})
    edge = (F.col("__n") <= head) | (F.col("__back") <= tail)
    middle = Window.partitionBy(key, edge).orderBy(F.desc("__score"), order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__used", F.sum("__size").over(middle))
    return rows.where(edge | (F.col("__used") <= budget)).drop("__n", "__back", "__score", "__size", "__used")


def apply_selection(rows: DataFrame, chosen: list, key: str, k: int) -> DataFrame:
    """Rows in the order of a selection; unknown ids go, k stay."""
    if not chosen:
        return rows.limit(0).withColumn("position", F.lit(0))
    order = rows.sparkSession.createDataFrame([(x, i) for i, x in enumerate(dict.fromkeys(chosen))], f"{key} {rows.schema[key].dataType.simpleString()}, position int")
    return rows.join(F.broadcast(order), key).orderBy("position").limit(k)


def review(rows: DataFrame, routes: dict[str, str], promote_from: int, demote_to: int, as_of: str, stale_days: int, by: list[str]) -> DataFrame:
    """(action, id): the plan of a dry run over active rows: promote, archive, supersede (all of a group but its keeper), unpromote."""
    live = active(rows)
    routed = F.col("type").isin(list(routes))
    stale = (F.col("recall_count") == 0) & (F.col("created_at") < days_before(as_of, stale_days)) & (F.coalesce("confidence", F.lit("low")) == "low")
    losers = keeper(rows, by).select(F.lit("supersede").alias("action"), F.col("loser").alias("id"))
    part = lambda name, kept: live.where(kept).select(F.lit(name).alias("action"), "id")
    out = part("promote", routed & (F.col("recall_count") >= promote_from)).unionByName(part("archive", stale)).unionByName(losers)
    return out.unionByName(part("unpromote", routed & F.col("recall_count").between(1, demote_to)))
