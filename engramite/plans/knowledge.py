"""Queries of stems, approximate neighbours, clusters, patterns and the knowledge graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from engramite.functions import stems as st
from engramite.functions import vectors as vc
from engramite.operators import ann
from engramite.operators import density as de
from engramite.operators import graph as g
from engramite.operators import knowledge as kg
from engramite.operators import pairs as pr
from engramite.operators import patterns as pa
from engramite.operators import recall as rc
from engramite.plans.recall import COS, probe
from engramite.plans.registry import query
from engramite.session import written
from engramite.sources.tables import spread


@query("TXT6_stem_match")
def stem_match(t):
    """Texts with any, and with all, of the stems of a request."""
    asked = st.query_stems("the licensed tions and meritions")
    found = t.texts.select("doc_id", st.stems(F.col("text")).alias("s"))
    return found.select("doc_id", st.matches(F.col("s"), asked, False).alias("any"), st.matches(F.col("s"), st.query_stems("licensed under"), True).alias("every"))


@query("TXT7_and_rank")
def and_rank(t):
    asked = st.query_stems("licensed work")
    found = t.texts.select("doc_id", st.stems(F.col("text")).alias("s")).where(st.matches(F.col("s"), asked, True))
    return found.select("doc_id", F.round(st.and_rank(F.col("s"), asked), 9).alias("score")).orderBy(F.desc("score"), "doc_id").limit(50)


@query("VEC4_approximate")
def approximate(t):
    """Ten approximate neighbours of the probe, from as many of the nearest lists as the recall of 0.95 takes."""
    means = ann.fit(t.embeddings, "vec_id", "embedding", lists=16)
    listed = ann.index(t.embeddings, "vec_id", "embedding", means)
    return ann.search(listed, "vec_id", "embedding", means, probe(t), 10, ann.probes_for(t.embeddings, "vec_id", "embedding", means)).select("vec_id", F.round("similarity", 9).alias("similarity"))


@query("CLU1_hdbscan")
def hdbscan(t):
    return de.density_clusters(t.embeddings, "label", "vec_id", "embedding")


REACH = "e AS (SELECT a AS u, b AS v FROM k UNION ALL SELECT b, a FROM k), reach AS (SELECT DISTINCT u, u AS v FROM e UNION SELECT r.u, e.v FROM reach r JOIN e ON r.v = e.u), comp AS (SELECT u AS node, min(v) AS component FROM reach GROUP BY 1)"


@query("CLU4_split_large")
def split_large(t):
    edges = written(pr.spanning_pairs(t.embeddings, 0.3).withColumnRenamed("similarity", "weight"), "links")
    return g.split_large(edges, 20, 5, 0.3).select("node", "component", "size")


@query("CLU7_representatives", f"""WITH x AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS v FROM x GROUP BY 1, 2), m AS (SELECT label, list(v ORDER BY i) AS embedding FROM c GROUP BY 1),
n AS (SELECT a.label, a.vec_id, 1 - {COS} AS distance FROM embeddings a JOIN m b ON b.label = a.label) SELECT label, arg_min(vec_id, {{'d': distance, 'v': vec_id}}) AS representative, round(min(distance), 9) AS nearest, round(avg(distance), 9) AS mean_distance FROM n GROUP BY 1""")
def representatives(t):
    return pa.representatives(t.embeddings, "label", "vec_id", "embedding").select("label", "representative", F.round("nearest", 9).alias("nearest"), F.round("mean_distance", 9).alias("mean_distance"))


MEMBERS = "m AS (SELECT doc_id % 37 AS cluster, doc_id, CASE lang WHEN 'de' THEN 'FAILED_APPROACH' WHEN 'en' THEN 'ERROR_FIX' WHEN 'fr' THEN 'WORKING_SOLUTION' ELSE 'CODEBASE_PATTERN' END AS type, CASE WHEN doc_id % 4 > 0 THEN source END AS context, doc_id % 17 AS session, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 60 AS INTEGER)) AS created_at FROM documents)"


def members(t):
    kind = F.when(F.col("lang") == "de", "FAILED_APPROACH").when(F.col("lang") == "en", "ERROR_FIX").when(F.col("lang") == "fr", "WORKING_SOLUTION").otherwise("CODEBASE_PATTERN")
    made = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(doc_id % 60 as int))")
    return t.documents.select((F.col("doc_id") % 37).alias("cluster"), "doc_id", kind.alias("type"), F.when(F.col("doc_id") % 4 > 0, F.col("source")).alias("context"), (F.col("doc_id") % 17).alias("session"), made.alias("created_at"), F.array("lang", "source").alias("tags"))


@query("CLU8_pattern_types", f"""WITH {MEMBERS}, k AS (SELECT cluster, type, count(*) AS n FROM m GROUP BY 1, 2), s AS (SELECT cluster, count(*) AS n, count(DISTINCT session) AS sessions, count(DISTINCT context) AS contexts, count(*) FILTER (created_at >= TIMESTAMP '2024-02-15' - INTERVAL 30 DAY) AS recent, count(*) FILTER (type = 'FAILED_APPROACH') AS failed, count(*) FILTER (type = 'ERROR_FIX') AS fixed, count(*) FILTER (type = 'WORKING_SOLUTION') AS solved FROM m GROUP BY 1),
j AS (SELECT s.*, x.most FROM s JOIN (SELECT cluster, max(n) AS most FROM k GROUP BY 1) x USING (cluster))
SELECT cluster, CASE WHEN failed / CAST(n AS DOUBLE) > 0.6 THEN 'anti_pattern' WHEN fixed > 0 AND solved > 0 AND (fixed + solved) / CAST(n AS DOUBLE) >= 0.4 THEN 'problem_solution' WHEN recent >= n * 0.6 AND most / CAST(n AS DOUBLE) >= 0.6 AND contexts >= 4 AND sessions >= 3 THEN 'expertise'
WHEN most / CAST(n AS DOUBLE) >= 0.7 AND contexts <= 3 THEN 'tool_cluster' WHEN contexts >= 4 OR (n >= 5 AND sessions / CAST(n AS DOUBLE) > 0.7) THEN 'cross_project' ELSE 'tool_cluster' END AS pattern FROM j""")
def pattern_types(t):
    return pa.pattern_types(members(t), "cluster", "2024-02-15 00:00:00").select("cluster", "pattern")


@query("CLU9_labels", """WITH m AS (SELECT doc_id % 37 AS cluster, doc_id, lang, source, doc_id % 17 AS session FROM documents), x AS (SELECT cluster, doc_id, 0 AS pos, lang AS tag FROM m UNION ALL SELECT cluster, doc_id, 1, source FROM m), c AS (SELECT cluster, tag, count(*) AS n, min(doc_id * 2 + pos) AS seen FROM x GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, seen) AS rank FROM c), l AS (SELECT cluster, string_agg(tag, ' + ' ORDER BY rank) AS tags FROM r WHERE rank <= 3 GROUP BY 1), s AS (SELECT cluster, count(DISTINCT session) AS sessions FROM m GROUP BY 1)
SELECT l.cluster, tags || ' cross-project patterns across ' || sessions || ' sessions' AS label FROM l JOIN s USING (cluster)""")
def pattern_labels(t):
    kinds = t.documents.select((F.col("doc_id") % 37).alias("cluster")).distinct().withColumn("pattern", F.lit("cross_project"))
    return pa.pattern_labels(members(t), "cluster", "doc_id", kinds).select("cluster", "label")


@query("CLU10_pattern_run")
def pattern_run(t):
    """Density clusters of each label's vectors, with type, label, confidence and representative, under one run id."""
    found = de.density_clusters(t.embeddings, "label", "vec_id", "embedding").select((F.col("label") * 1000 + F.col("cluster")).alias("cluster"), F.col("vec_id").alias("doc_id"))
    found = written(found, "clusters")  # found once, read by each part of the run
    rows = found.join(members(t).drop("cluster"), "doc_id").join(t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    return pa.pattern_run(rows, "cluster", "doc_id", "embedding", "2024-02-15 00:00:00", "run-1", least=0.3)


NOTE = """concat('The module src/', replace(p_name, ' ', '_'), '.py uses pandas and `', p_brand, ' cache`. It fixes ', CASE WHEN p_size % 2 = 0 THEN 'ValueError' ELSE 'MAX_SIZE' END, ' in src/', p_brand, '.py now!', CASE WHEN p_size % 3 = 0 THEN ' We migrated from redis to postgresql.' ELSE '' END)"""


#: What the rules find in such a note, by how it is made.
NOTE_ENTITIES = """n AS (SELECT p_partkey, 'src/' || replace(p_name, ' ', '_') || '.py' AS f, p_brand || ' cache' AS c, CASE WHEN p_size % 2 = 0 THEN 'ValueError' ELSE 'MAX_SIZE' END AS x, p_brand AS b, p_size % 3 = 0 AS moved FROM part),
o AS (SELECT *, 11 + length(f) + 6 AS lib, 11 + length(f) + 6 + 12 AS con, 11 + length(f) + 6 + 12 + length(c) + 12 AS err FROM n), q AS (SELECT *, err + length(x) + 8 + length(b) + 8 + 18 AS mov FROM o),
e AS (SELECT p_partkey, 'file' AS type, lower(f) AS name, 11 AS start, 11 + length(f) AS stop FROM q UNION ALL SELECT p_partkey, 'library', 'pandas', lib, lib + 6 FROM q UNION ALL SELECT p_partkey, 'concept', lower(c), con, con + length(c) FROM q
UNION ALL SELECT p_partkey, CASE WHEN x = 'MAX_SIZE' THEN 'config' ELSE 'error' END, lower(x), err, err + length(x) FROM q UNION ALL SELECT p_partkey, 'module', 'redis', mov, mov + 5 FROM q WHERE moved
UNION ALL SELECT p_partkey, 'tool', 'redis', mov, mov + 5 FROM q WHERE moved UNION ALL SELECT p_partkey, 'tool', 'postgresql', mov + 9, mov + 19 FROM q WHERE moved)"""


def notes(t):
    return spread(t.part).select("p_partkey", F.expr(NOTE).alias("text"))


@query("KG1_entities", f"WITH {NOTE_ENTITIES} SELECT p_partkey, type, name, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM e")
def entities(t):
    return kg.entities(notes(t), "p_partkey", "text").select("p_partkey", "type", "name", "start", "stop")


@query("KG1_document_entities")
def document_entities(t):
    return kg.entities(t.texts, "doc_id", "text").select("doc_id", "type", "name", "start", "stop")


@query("KG2_sentences", r"""WITH m AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), '\n+', chr(1), 'g'), chr(1)) AS s FROM documents) SELECT doc_id, len(s) AS n, list_max(list_transform(s, lambda x: length(x))) AS longest FROM m""")
def sentences(t):
    s = kg.sentence_array(F.col("text"))
    return t.texts.select("doc_id", F.size(s).cast("long").alias("n"), F.array_max(F.transform(s, lambda x: F.length(x).cast("long"))).alias("longest"))


@query("KG3_relations", f"""WITH {NOTE_ENTITIES}, r AS (SELECT a.p_partkey, a.name AS source, a.type AS source_type, b.name AS target, b.type AS target_type, 'uses' AS relation, 0.7 AS confidence FROM e a JOIN e b ON a.p_partkey = b.p_partkey AND a.start < b.start
  WHERE a.type IN ('file', 'library') AND b.type IN ('library', 'concept') UNION ALL SELECT a.p_partkey, a.name, a.type, b.name, b.type, 'supersedes', 0.8 FROM e a JOIN e b ON a.p_partkey = b.p_partkey WHERE a.name = 'redis' AND b.name = 'postgresql') SELECT * FROM r""")
def relations(t):
    return kg.relations(notes(t), "p_partkey", "text")


@query("KG4_entity_rollup", f"WITH {NOTE_ENTITIES} SELECT type, name, count(DISTINCT p_partkey) AS mentions, min(p_partkey) AS first FROM e GROUP BY 1, 2")
def rollup(t):
    return kg.rollup(kg.entities(notes(t), "p_partkey", "text"), "p_partkey")


@query("KG5_backlog", "SELECT doc_id, n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND (n_chars, doc_id) > (300, 50) ORDER BY n_chars, doc_id LIMIT 40")
def kg_backlog(t):
    """A page of the texts that have no entities yet, after the last one of the page before."""
    after = F.struct("n_chars", "doc_id") > F.struct(F.lit(300).cast("long"), F.lit(50).cast("long"))
    return t.documents.join(t.labels, "doc_id", "left_anti").where(after).orderBy("n_chars", "doc_id").limit(40).select("doc_id", "n_chars")
