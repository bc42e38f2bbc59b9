"""Graph, cluster and knowledge-graph queries. Order lines stand for tags: an order is a text, a part a tag."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramite.operators import graph as g
from engramite.operators import pairs as pr
from engramite.plans.registry import query
from engramite.session import written

COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
REACH = "e AS (SELECT a AS u, b AS v FROM k UNION ALL SELECT b, a FROM k), reach AS (SELECT DISTINCT u, u AS v FROM e UNION SELECT r.u, e.v FROM reach r JOIN e ON r.v = e.u), comp AS (SELECT u AS node, min(v) AS component FROM reach GROUP BY 1)"


def whole(t):
    return t.lineitem.select("l_orderkey", F.col("l_partkey").alias("item"))


def by_order(rows):
    """Co-occurrence in which an order counts for one over its number of parts."""
    rows = rows.distinct()
    weight = rows.groupBy("l_orderkey").agg((1.0 / F.count("*")).alias("weight"))
    return g.cooccurrence(rows, "l_orderkey", "item", weight).withColumn("weight", F.round("weight", 6))


@query("CLU2_cooccurrence", "WITH m AS (SELECT DISTINCT l_orderkey, l_partkey AS item FROM lineitem) SELECT x.item AS a, y.item AS b, CAST(count(*) AS DOUBLE) AS weight FROM m x JOIN m y ON x.l_orderkey = y.l_orderkey AND x.item < y.item GROUP BY 1, 2")
def cooccurrence(t):
    return g.cooccurrence(whole(t), "l_orderkey", "item")


@query("CLU2_weighted_cooccurrence", """WITH m AS (SELECT DISTINCT l_orderkey, l_partkey AS item FROM lineitem), w AS (SELECT l_orderkey, 1 / CAST(count(*) AS DOUBLE) AS weight FROM m GROUP BY 1)
SELECT x.item AS a, y.item AS b, round(sum(w.weight), 6) AS weight FROM m x JOIN m y ON x.l_orderkey = y.l_orderkey AND x.item < y.item JOIN w ON w.l_orderkey = x.l_orderkey GROUP BY 1, 2""")
def weighted(t):
    return by_order(whole(t))


@query("CLU3_components", f"""WITH RECURSIVE k AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a, embeddings b WHERE a.vec_id < b.vec_id AND {COS} >= 0.42), {REACH}
SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM comp QUALIFY size >= 3""")
def components(t):
    edges = pr.spanning_pairs(t.embeddings, 0.42).withColumnRenamed("similarity", "weight")
    return g.clusters(edges, 0.42, 3)


@query("CLU1_density_clusters", f"""WITH RECURSIVE s AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id AND {COS} >= 0.4), core AS (SELECT a AS id FROM s GROUP BY 1 HAVING count(*) >= 2),
k AS (SELECT a, b FROM s WHERE a < b AND a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)), {REACH} SELECT c.id AS node, coalesce(comp.component, c.id) AS component FROM core c LEFT JOIN comp ON comp.node = c.id""")
def density_clusters(t):
    """Components of the vectors that have two others near; vectors without are noise."""
    core = written(pr.near_counts(t.embeddings, 0.4).where("n >= 2").select("id"), "core")
    inside = pr.spanning_pairs(t.embeddings.join(core.withColumnRenamed("id", "vec_id"), "vec_id", "left_semi"), 0.4)
    found = g.connected_components(inside, "a", "b").withColumnRenamed("node", "id")
    return core.join(found, "id", "left").select(F.col("id").alias("node"), F.coalesce("component", "id").alias("component"))


@query("CLU5_fuse", """WITH t AS (SELECT doc_id AS node, source AS cluster FROM documents), e AS (SELECT vec_id AS node, label AS cluster FROM embeddings), c AS (SELECT t.cluster AS tc, e.cluster AS ec, count(*) AS c FROM t JOIN e USING (node) GROUP BY 1, 2),
j AS (SELECT tc, ec, c / CAST((SELECT count(*) FROM t WHERE cluster = tc) + (SELECT count(*) FROM e WHERE cluster = ec) - c AS DOUBLE) AS j FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY tc ORDER BY j DESC, ec) AS n FROM j WHERE j >= 0.03)
SELECT tc AS tag_cluster, ec AS embedding_cluster, round(j, 9) AS jaccard FROM r WHERE n = 1""")
def fuse(t):
    tags = t.documents.select(F.col("doc_id").alias("node"), F.col("source").alias("cluster"))
    return g.fuse(tags, t.embeddings.select(F.col("vec_id").alias("node"), F.col("label").alias("cluster")), 0.03).withColumn("jaccard", F.round("jaccard", 9))


@query("CLU6_cluster_stats", """WITH x AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS v FROM x GROUP BY 1, 2), m AS (SELECT label, list(v ORDER BY i) AS c FROM c GROUP BY 1),
n AS (SELECT e.label, e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), m.c) AS near FROM embeddings e JOIN m ON m.label = e.label), s AS (SELECT label, count(*) AS size, least(greatest(avg(near), 0), 1) AS cohesion, least(1.0, count(DISTINCT vec_id % 20) / CAST(5 AS DOUBLE)) AS diversity, least(1.0, (max(vec_id % 30) - min(vec_id % 30)) / CAST(14 AS DOUBLE)) AS span, arg_max(vec_id, {'n': near, 'v': -vec_id}) AS representative FROM n GROUP BY 1)
SELECT label, size, round(cohesion, 6) AS cohesion, diversity, span, representative, round(0.3 * cohesion + 0.3 * diversity + 0.2 * span + 0.2 * least(1, log2(size) / 4), 6) AS confidence FROM s""")
def cluster_stats(t):
    made = g.cluster_stats(t.embeddings, "label", "vec_id", "embedding", F.col("vec_id") % 20, F.col("vec_id") % 30)
    return made.select("label", "size", F.round("cohesion", 6).alias("cohesion"), "diversity", "span", "representative", F.round("confidence", 6).alias("confidence"))


@query("KG4_context_edges", """WITH m AS (SELECT DISTINCT l_orderkey, l_partkey AS item FROM lineitem), k AS (SELECT x.item AS a, y.item AS b, count(*) AS weight FROM m x JOIN m y ON x.l_orderkey = y.l_orderkey AND x.item < y.item GROUP BY 1, 2),
b AS (SELECT a AS node, b AS other, weight FROM k UNION ALL SELECT b, a, weight FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY weight DESC, other) AS rank FROM b) SELECT node, other, CAST(weight AS DOUBLE) AS weight, rank FROM r WHERE rank <= 5""")
def context(t):
    return g.top_edges(g.cooccurrence(whole(t), "l_orderkey", "item"), 5)
