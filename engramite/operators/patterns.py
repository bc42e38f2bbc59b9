"""Patterns: clusters of learnings with a representative, a type, a label and how sure they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramite.functions import vectors as vc
from engramite.operators.graph import cluster_stats
from engramite.operators.rerank import centroids

#: Bounds of the types of patterns, and what their labels say.
ANTI, SOLUTION, EXPERT, TOOL, DAYS, CONTEXTS, SESSIONS = 0.6, 0.4, 0.6, 0.7, 30, 4, 3
TYPE_LABELS = {
    "tool_cluster": "patterns", "problem_solution": "problem-solution patterns", "cross_project": "cross-project patterns",
    "expertise": "emerging expertise", "anti_pattern": "anti-patterns",
}


def representatives(rows: DataFrame, cluster: str, key: str, embedding: str) -> DataFrame:
    """(cluster, representative, nearest, mean_distance): the row nearest the centroid by cosine distance, the smaller key of equal ones."""
    near = rows.join(centroids(rows, cluster, embedding), cluster).withColumn("__d", 1 - vc.cosine(F.col(embedding), F.col("centroid")))
    return near.groupBy(cluster).agg(F.min_by(key, F.struct("__d", key)).alias("representative"), F.min("__d").alias("nearest"), F.avg("__d").alias("mean_distance"))


def pattern_types(members: DataFrame, cluster: str, as_of: str) -> DataFrame:
    """(cluster, pattern) of members (type, context, session, created_at): the first type in a fixed order whose rule holds."""
    counted = members.groupBy(cluster, "type").agg(F.count("*").alias("n")).groupBy(cluster).agg(F.max("n").alias("most"))
    recent = F.col("created_at") >= F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(DAYS))
    kind = lambda name: F.count_if(F.col("type") == name)
    told = members.groupBy(cluster).agg(
        F.count("*").alias("n"), F.count_distinct("session").alias("sessions"), F.count_distinct("context").alias("contexts"), F.count_if(recent).alias("recent"),
        kind("FAILED_APPROACH").alias("failed"), kind("ERROR_FIX").alias("fixed"), kind("WORKING_SOLUTION").alias("solved"),
    )
    n = F.col("n")
    rules = (
        ("anti_pattern", F.col("failed") / n > ANTI),
        ("problem_solution", (F.col("fixed") > 0) & (F.col("solved") > 0) & ((F.col("fixed") + F.col("solved")) / n >= SOLUTION)),
        ("expertise", (F.col("recent") >= n * EXPERT) & (F.col("most") / n >= EXPERT) & (F.col("contexts") >= CONTEXTS) & (F.col("sessions") >= SESSIONS)),
        ("tool_cluster", (F.col("most") / n >= TOOL) & (F.col("contexts") <= 3)),
        ("cross_project", (F.col("contexts") >= CONTEXTS) | (n >= 5) & (F.col("sessions") / n > 0.7)),
    )
    return told.join(counted, cluster).select(cluster, F.coalesce(*[F.when(rule, F.lit(name)) for name, rule in rules], F.lit("tool_cluster")).alias("pattern"), "n", "sessions")


def pattern_labels(members: DataFrame, cluster: str, key: str, kinds: DataFrame) -> DataFrame:
    """(cluster, label): the three most frequent tags (of equal ones the one seen first), the type, the number of sessions; misc without tags."""
    each = members.select(cluster, key, F.posexplode(F.array_distinct("tags")).alias("pos", "tag"))
    counted = each.groupBy(cluster, "tag").agg(F.count("*").alias("n"), F.min(F.struct(key, "pos")).alias("seen"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("n"), "seen"))).where("rank <= 3")
    top = ranked.groupBy(cluster).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "tag"))), lambda s: s["tag"]), " + ").alias("tags"))
    sessions = members.groupBy(cluster).agg(F.count_distinct("session").alias("sessions"))
    named = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in TYPE_LABELS.items() for x in pair]), F.col("pattern")), F.lit("patterns"))
    return sessions.join(kinds.select(cluster, "pattern"), cluster).join(top, cluster, "left").select(cluster, F.concat(F.coalesce("tags", F.lit("misc")), F.lit(" "), named, F.lit(" across "), F.col("sessions").cast("string"), F.lit(" sessions")).alias("label"))


def pattern_run(members: DataFrame, cluster: str, key: str, embedding: str, as_of: str, run: str, least: float = 0.3) -> DataFrame:
    """(cluster, run_id, pattern, label, size, confidence, representative) of the clusters that are sure enough."""
    kinds = pattern_types(members, cluster, as_of).select(cluster, "pattern")
    day = F.unix_timestamp(F.col("created_at").cast("timestamp")) / 86400.0
    stats = cluster_stats(members, cluster, key, embedding, F.col("session"), day).select(cluster, "size", F.round("confidence", 6).alias("confidence"), "representative")
    made = stats.join(kinds, cluster).join(pattern_labels(members, cluster, key, kinds), cluster)
    return made.where(F.col("confidence") >= least).select(cluster, F.lit(run).alias("run_id"), "pattern", "label", "size", "confidence", "representative")
