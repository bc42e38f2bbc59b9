"""Similarity and co-occurrence graphs, clusters and what is told of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramite.functions import vectors as vc
from engramite.operators.components import connected_components
from engramite.operators.rerank import centroids
from engramite.session import written


#: Rows, and pairs, that one task counts on average.
TASK_ROWS = 1_000_000


def cooccurrence(members: DataFrame, group: str, item: str, weight: DataFrame | None = None) -> DataFrame:
    """(a, b, weight) for items that share groups: the number of groups, or the sum of the groups' weights.

    Meant for groups of bounded size (the lines of an order, the tags of a text). The tasks are as many as the rows and
    their pairs call for, so what one of them holds does not grow with the table.
    """
    least = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = lambda count: max(least, -(-int(count or 0) // TASK_ROWS))
    rows = written(members.select(group, item).repartition(parts(members.count()), group).distinct(), "members")
    n = F.col("count")
    size = rows.groupBy(group).count().agg(F.sum("count").alias("rows"), F.sum(n * (n - 1) / 2).alias("pairs")).first()
    rows = rows.repartition(parts(size["rows"]), group)
    if weight is not None:
        rows = rows.join(weight, group)
    else:
        rows = rows.withColumn("weight", F.lit(1.0))
    one, two = rows.select(group, F.col(item).alias("a"), "weight"), rows.select(F.col(group).alias(group), F.col(item).alias("b"))
    pairs = one.join(two, group).where("a < b").select("a", "b", "weight")
    return pairs.repartition(parts(size["pairs"]), "a", "b").groupBy("a", "b").agg(F.sum("weight").alias("weight"))


def clusters(edges: DataFrame, least: float, smallest: int) -> DataFrame:
    """(node, component) of the components of at least ``smallest`` nodes over edges of at least ``least``."""
    found = connected_components(edges.where(F.col("weight") >= least), "a", "b")
    kept = found.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") >= smallest)
    return found.join(kept, "component").select("node", "component", "size")


def split_large(edges: DataFrame, most: int, smallest: int, least: float, factor: float = 1.5, rounds: int = 10) -> DataFrame:
    """Clusters none of which is larger than ``most`` if raising the least weight by the factor up to so many times can do it."""
    # each round ends in a table, so that plans do not grow from round to round
    found = written(clusters(edges, least, smallest), "clusters")
    for _ in range(rounds):
        large = found.where(F.col("size") > most)
        if large.isEmpty():
            break
        least *= factor
        inside = edges.join(large.select(F.col("node").alias("a")), "a", "left_semi")
        parts = written(clusters(inside, least, smallest), "clusters")
        split = parts.join(large.select("node", F.col("component").alias("whole"), F.col("size").alias("was")), "node").where("size < was")
        gone = split.select(F.col("whole").alias("component")).distinct()
        if gone.isEmpty():
            break
        found = written(found.join(gone, "component", "left_anti").select("node", "component", "size").unionByName(split.select("node", "component", "size")), "clusters")
    return found


def fuse(tags: DataFrame, embeddings: DataFrame, least: float) -> DataFrame:
    """(tag_cluster, embedding_cluster, jaccard): for each tag cluster the embedding cluster most like it, if it is enough; ties go to the first."""
    size = lambda df, name: df.groupBy("cluster").agg(F.count("*").alias(name))
    common = tags.withColumnRenamed("cluster", "t").join(embeddings.withColumnRenamed("cluster", "e"), "node").groupBy("t", "e").agg(F.count("*").alias("c"))
    both = common.join(size(tags, "nt").withColumnRenamed("cluster", "t"), "t").join(size(embeddings, "ne").withColumnRenamed("cluster", "e"), "e")
    scored = both.withColumn("jaccard", F.col("c") / (F.col("nt") + F.col("ne") - F.col("c"))).where(F.col("jaccard") >= least)
    best = scored.withColumn("n", F.row_number().over(Window.partitionBy("t").orderBy(F.desc("jaccard"), "e"))).where("n = 1")
    return best.select(F.col("t").alias("tag_cluster"), F.col("e").alias("embedding_cluster"), "jaccard")


def cluster_stats(rows: DataFrame, cluster: str, key: str, embedding: str, session: Column, day: Column) -> DataFrame:
    """Size, cohesion, diversity, span, size score, confidence and representative (nearest the centroid, then smallest id) of each cluster."""
    means = centroids(rows, cluster, embedding)
    near = rows.join(means, cluster).withColumns({"__near": vc.cosine(F.col(embedding), F.col("centroid")), "__session": session, "__day": day})
    made = near.groupBy(cluster).agg(
        F.count("*").alias("size"), F.least(F.greatest(F.avg("__near"), F.lit(0.0)), F.lit(1.0)).alias("cohesion"), F.least(F.lit(1.0), F.count_distinct("__session") / 5.0).alias("diversity"),
        F.least(F.lit(1.0), (F.max("__day") - F.min("__day")) / 14.0).alias("span"), F.max_by(key, F.struct("__near", -F.col(key))).alias("representative"),
    )
    made = made.withColumn("size_score", F.least(F.lit(1.0), F.log2(F.col("size").cast("double")) / 4))
    return made.withColumn("confidence", 0.3 * F.col("cohesion") + 0.3 * F.col("diversity") + 0.2 * F.col("span") + 0.2 * F.col("size_score"))


def top_edges(edges: DataFrame, cap: int) -> DataFrame:
    """(node, other, weight, rank): the heaviest edges of each node."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other"), "weight").unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"), "weight"))
    by = Window.partitionBy("node").orderBy(F.desc("weight"), "other")
    return both.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= cap)
