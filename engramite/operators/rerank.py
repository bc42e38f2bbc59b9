"""Contextual reranking: calibrated retrieval scores blended with signals, weight sweeps, ranking quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramite.functions import vectors as vc
from engramite.session import written

#: Weights of the signals; what they leave goes to retrieval.
WEIGHTS = {"project": 0.09, "recency": 0.05, "confidence": 0.05, "recall": 0.02, "type": 0.05, "tag": 0.05, "pattern": 0.05, "graph": 0.05}
RECENCY_DAYS, RECALL_SCALE, RRF_SCALE, TEMPERATURE, TYPE_SLOPE = 45, 10, 25, 0.05, 1.5

#: How much an entity of a type tells, and one of any other type.
ENTITY_WEIGHTS = {"file": 1.0, "module": 1.0, "error": 0.9, "library": 0.8, "config": 0.7, "config_var": 0.7, "tool": 0.6, "concept": 0.5, "language": 0.4}
OTHER_ENTITY = 0.5

#: The ten configurations of the weight sweep, as weights of project, recency, confidence, recall, type, tag, pattern.
SWEEP_OF = ("project", "recency", "confidence", "recall", "type", "tag", "pattern")
SWEEPS = {
    "baseline": (0.15, 0.05, 0.05, 0.05, 0.05, 0.05, 0.05),
    "no-project": (0.0, 0.05, 0.05, 0.05, 0.05, 0.05, 0.05),
    "heavy-project": (0.30, 0.05, 0.05, 0.05, 0.05, 0.05, 0.05),
    "no-recency": (0.15, 0.0, 0.05, 0.05, 0.05, 0.05, 0.05),
    "heavy-recency": (0.15, 0.15, 0.05, 0.05, 0.05, 0.05, 0.05),
    "no-recall": (0.15, 0.05, 0.05, 0.0, 0.05, 0.05, 0.05),
    "tags-heavy": (0.10, 0.05, 0.05, 0.05, 0.05, 0.15, 0.05),
    "type-heavy": (0.10, 0.05, 0.05, 0.05, 0.15, 0.05, 0.05),
    "minimal-signals": (0.10, 0.0, 0.0, 0.0, 0.0, 0.05, 0.0),
    "retrieval-only": (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
}


def sweep_configs(base: dict[str, float]) -> dict[str, dict[str, float]]:
    """Each configuration of the sweep over the weights that it leaves as they are."""
    return {name: base | dict(zip(SWEEP_OF, weights, strict=True)) for name, weights in SWEEPS.items()}


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def calibrated(score: Column, mode: str, position: Column | None = None, total: Column | None = None) -> Column:
    """A retrieval score on 0 to 1: vector, rrf, text, or the position where the mode is unknown."""
    if mode == "vector":
        return clamp((score + 1) / 2)
    if mode == "rrf":
        return clamp(score * RRF_SCALE)
    if mode in ("text", "sqlite"):
        return clamp(score / (score + 1))
    return clamp(1 - position / total)


def project_match(own: Column, asked: str) -> Column:
    low, want = F.lower(own), F.lit(asked.lower())
    return F.when(low == want, 1.0).when(F.contains(low, want) | F.contains(want, low), 0.5).otherwise(0.0)


def recency(created: Column, as_of: str) -> Column:
    days = F.expr(f"timestampdiff(SECOND, created_at, timestamp_ntz'{as_of}')") / 86400.0
    return F.when(created.isNull(), 0.5).otherwise(F.exp(-days / RECENCY_DAYS))


def confidence(level: Column) -> Column:
    return F.when(level == "high", 1.0).when(level == "medium", 0.6).when(level == "low", 0.2).otherwise(0.5)


def recalled(count: Column) -> Column:
    return F.least(F.lit(1.0), F.log2(1.0 + count) / RECALL_SCALE)


def type_match(kind: Column, probabilities: dict[str, float] | None) -> Column:
    """How much more likely a row's type is than the average one, around 0.5; 0.5 where nothing is known of it."""
    if not probabilities:
        return F.lit(0.5)
    share = F.try_element_at(F.create_map(*[F.lit(x) for pair in probabilities.items() for x in pair]), kind)
    return F.when(share.isNull(), 0.5).otherwise(clamp(0.5 + TYPE_SLOPE * (share - 1.0 / len(probabilities))))


def tag_overlap(tags: Column, asked: list[str]) -> Column:
    """Jaccard likeness of a row's tags and those asked for; 0 where either has none."""
    wanted = F.array(*[F.lit(x) for x in dict.fromkeys(asked)]).cast("array<string>")
    both = F.size(F.array_union(tags, wanted))
    return F.when((F.size(tags) > 0) & (F.size(wanted) > 0), F.size(F.array_intersect(tags, wanted)) / both).otherwise(0.0)


def pattern_score(strength: Column, tags: Column, asked: list[str]) -> Column:
    """Strength of the row's pattern by the share of the tags asked for that the pattern has."""
    if not asked:
        return F.lit(0.0)
    wanted = F.array(*[F.lit(x) for x in dict.fromkeys(asked)])
    return F.coalesce(strength * F.least(F.lit(1.0), F.size(F.array_intersect(tags, wanted)) / F.size(wanted)), F.lit(0.0))


def _entity_weight(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in ENTITY_WEIGHTS.items() for x in pair]), kind), F.lit(OTHER_ENTITY))


def graph_overlap(entities: Column, asked: list[tuple[str, str]]) -> Column:
    """Weighted Jaccard likeness of a row's entities (name, type) and those of the query; 0 where either has none."""
    if not asked:
        return F.lit(0.0)
    key = lambda name, kind: F.struct(F.lower(name).alias("name"), kind.alias("type"))
    own = F.array_distinct(F.transform(entities, lambda e: key(e["name"], e["type"])))
    wanted = F.array_distinct(F.array(*[key(F.lit(n), F.lit(k)) for n, k in asked]))
    total = lambda keys: F.aggregate(keys, F.lit(0.0), lambda s, e: s + _entity_weight(e["type"]))
    return F.when(F.size(entities) > 0, F.try_divide(total(F.array_intersect(wanted, own)), total(F.array_union(wanted, own)))).otherwise(0.0)


def signals(rows: DataFrame, project: str, as_of: str, tags: list[str], types: dict[str, float] | None, entities: list[tuple[str, str]]) -> DataFrame:
    """``rows`` with cal and one column for each signal.

    They have rrf, project, created_at, confidence, recall_count, type, tags, pattern_strength, pattern_tags and
    entities (an array of name and type); what is null counts as absent.
    """
    none = F.array().cast("array<string>")
    return rows.withColumns(
        {
            "cal": calibrated(F.col("rrf"), "rrf"), "s_project": project_match(F.col("project"), project), "s_recency": recency(F.col("created_at"), as_of),
            "s_confidence": confidence(F.col("confidence")), "s_recall": recalled(F.coalesce("recall_count", F.lit(0))), "s_type": type_match(F.col("type"), types),
            "s_tag": tag_overlap(F.coalesce("tags", none), tags), "s_pattern": pattern_score(F.col("pattern_strength"), F.coalesce("pattern_tags", none), tags),
            "s_graph": graph_overlap(F.coalesce("entities", F.array().cast("array<struct<name:string,type:string>>")), entities),
        }
    )


def blend(weights: dict[str, float], active: Column | None = None) -> Column:
    """The calibrated score and the signals by weight. ``active`` tells whether the graph signal counts; else its weight goes back to retrieval."""
    total = sum(weights.values())
    if not 0 <= total <= 1 + 1e-12:
        raise ValueError("the weights of the signals must come to 0 to 1")
    score = (1 - total) * F.col("cal")
    for name, weight in weights.items():
        part = weight * F.col(f"s_{name}")
        score = score + (F.when(active, part).otherwise(weight * F.col("cal")) if name == "graph" and active is not None else part)
    return score


def _told(rows: DataFrame) -> DataFrame:
    """rows with ``graph_active``: whether any row has entities. The rows are candidates, bounded by the legs, and are written once: they are read twice here."""
    rows = written(rows)
    return rows.crossJoin(F.broadcast(rows.agg(F.coalesce(F.max(F.size("entities") > 0), F.lit(False)).alias("graph_active"))))


def rerank(rows: DataFrame, weights: dict[str, float], key: str, k: int) -> DataFrame:
    return _told(rows).withColumn("score", blend(weights, F.col("graph_active"))).orderBy(F.desc("score"), key).limit(k)


def sweep(rows: DataFrame, configs: dict[str, dict[str, float]], key: str, k: int) -> DataFrame:
    """(config, rank, key, score): the first k rows under each configuration, from one set of features."""
    scored = F.explode(F.array(*[F.struct(F.lit(name).alias("config"), blend(w, F.col("graph_active")).alias("score")) for name, w in configs.items()])).alias("s")
    each = _told(rows).select(key, scored).select("s.config", key, F.round("s.score", 9).alias("score"))
    by = Window.partitionBy("config").orderBy(F.desc("score"), key)
    return each.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("config", "rank", key, "score")


def ranking_quality(hits: DataFrame, golden: int, k: int) -> DataFrame:
    """Precision over what was returned, NDCG with the ideal of the golden set, reciprocal rank; of rows (rank, rel)."""
    from math import log2

    ideal = sum(1 / log2(i + 1) for i in range(1, min(k, golden) + 1))
    return hits.agg(
        F.round(F.coalesce(F.try_divide(F.sum("rel"), F.count("*")), F.lit(0.0)), 6).alias("precision"), F.round(F.coalesce(F.sum(F.col("rel") / F.log2(F.col("rank") + 1.0)), F.lit(0.0)) / (ideal or 1.0), 6).alias("ndcg"),
        F.round(F.coalesce(1.0 / F.min(F.when(F.col("rel") == 1, F.col("rank"))), F.lit(0.0)), 6).alias("mrr"),
    )


def centroids(df: DataFrame, label: str, embedding: str = "embedding") -> DataFrame:
    """(label, centroid): element-wise means; partial sums are combined before the shuffle."""
    each = df.select(label, F.posexplode(embedding).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("v"))
    return each.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("centroid"))


def type_probabilities(means: DataFrame, vector: list[float], label: str) -> DataFrame:
    """Softmax of the similarity of a vector to each centroid."""
    scored = means.select(label, (vc.cosine(F.col("centroid"), F.array(*[F.lit(float(x)) for x in vector])) / TEMPERATURE).alias("x"))
    most = scored.agg(F.max("x").alias("most"))
    parts = scored.crossJoin(F.broadcast(most)).select(label, F.exp(F.col("x") - F.col("most")).alias("p"))
    return parts.crossJoin(F.broadcast(parts.agg(F.sum("p").alias("all")))).select(label, (F.col("p") / F.col("all")).alias("probability"))


def tag_noise(tags: DataFrame, percent: int) -> DataFrame:
    """(tag, df, idf, noise): tags at or below the inverse document frequency at that place of the sorted list."""
    counts = tags.groupBy("tag").agg(F.count("*").alias("df"))
    total = tags.agg(F.count_distinct("doc_id").alias("docs"))
    scored = counts.crossJoin(F.broadcast(total)).select("tag", "df", F.ln(F.col("docs") / (1.0 + F.col("df"))).alias("idf"))
    # the value at one place: distinct values with their counts, added up in order (there are at most as many as counts of documents)
    values = scored.groupBy("idf").agg(F.count("*").alias("n"))
    upto = values.withColumn("upto", F.sum("n").over(Window.orderBy("idf"))).crossJoin(F.broadcast(values.agg(F.floor(F.sum("n") * percent / 100).alias("place"))))
    level = upto.where("upto > place").agg(F.min("idf").alias("level"))
    return scored.crossJoin(F.broadcast(level)).select("tag", "df", "idf", (F.col("idf") <= F.col("level")).alias("noise"))


def nearest_rank(counts: DataFrame, group: str, value: str, count: str, share: float) -> DataFrame:
    """(group, value): the smallest value that a share of a group's rows do not exceed, from distinct values with their counts."""
    whole = counts.groupBy(group).agg(F.sum(count).alias("all"))
    upto = counts.withColumn("upto", F.sum(count).over(Window.partitionBy(group).orderBy(value)))
    return upto.join(whole, group).where(F.col("upto") >= F.ceil(F.col("all") * share)).groupBy(group).agg(F.min(value).alias("value"))


def tuning(runs: DataFrame, config: str, slack: float = 1e-9, factor: float = 1.25, least: float = 1.0) -> DataFrame:
    """runs (config, ndcg, p95, signals) with ``keep``, against the first configuration by name."""
    base = runs.agg(F.min_by(F.struct("ndcg", "p95", "signals"), config).alias("base"))
    better = F.col("ndcg") > F.col("base.ndcg") + slack
    as_good = (F.abs(F.col("ndcg") - F.col("base.ndcg")) <= slack) & (F.col("signals") < F.col("base.signals"))
    return runs.crossJoin(F.broadcast(base)).withColumn("keep", (better | as_good) & (F.col("p95") <= F.greatest(F.col("base.p95") * factor, F.col("base.p95") + least)))
