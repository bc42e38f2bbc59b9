"""Recall, vector and reranking queries. documents are the texts, embeddings the vectors (doc_id = vec_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramite.functions import text as tx
from engramite.functions import vectors as vc
from engramite.operators import ask
from engramite.operators import pairs as pr
from engramite.operators import recall as rc
from engramite.operators import rerank as rr
from engramite.operators import text_index as ix
from engramite.plans.registry import AS_OF, LEARNINGS, query
from engramite.session import scratch_path, written
from engramite.sources.tables import spread

#: The words and the vector that stand for a query.
WORDS, PROBE = ["thing", "ering", "tion"], 7

STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)
TOKENS = f"""list_filter(list_transform(string_split_regex(replace(lower({{c}}), '-', ' '), '[ \\t\\r\\n\\f\\x0B]+'), lambda w: regexp_replace(w, '[^a-z0-9]', '', 'g')), lambda w: length(w) > 2 AND w NOT IN ({STOP}))"""
IN = ", ".join(f"'{w}'" for w in WORDS)
COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


def probe(t) -> list[float]:
    """The query vector: the embedding of one known row."""
    return t.embeddings.where(F.col("vec_id") == PROBE).select("embedding").first()[0]


def texts(t) -> DataFrame:
    return t.texts.withColumnRenamed("text", "content")


def rank_terms(words: list[str]) -> str:
    one = "coalesce(list_sum(list_transform(range(1, len(list_filter(w, lambda x: x = '{q}')) + 1), lambda j: 1.0 / CAST(j * j AS DOUBLE))), 0)"
    return "(" + " + ".join(one.format(q=q) for q in words) + f") * 0.1 / CAST(1.64493406685 AS DOUBLE) / {len(words)}"


TEXT_LEG = f"""toks AS (SELECT doc_id, {TOKENS.format(c='text')} AS w FROM documents),
text_leg AS (SELECT doc_id, s, row_number() OVER (ORDER BY s DESC, doc_id) AS r FROM (SELECT doc_id, {rank_terms(WORDS)} AS s FROM toks) WHERE s > 0 ORDER BY s DESC, doc_id LIMIT 50)"""
VEC_LEG = f"""vec_leg AS (SELECT doc_id, s, row_number() OVER (ORDER BY s DESC, doc_id) AS r FROM (SELECT a.vec_id AS doc_id, {COS} AS s FROM embeddings a, embeddings b WHERE b.vec_id = {PROBE}) ORDER BY s DESC, doc_id LIMIT 80)"""
FUSED = f"""{TEXT_LEG}, {VEC_LEG}, fused AS (SELECT coalesce(t.doc_id, v.doc_id) AS doc_id, coalesce(1.0 / CAST(60 + t.r AS DOUBLE), 0) + coalesce(1.0 / CAST(60 + v.r AS DOUBLE), 0) AS rrf, t.r AS r_text, v.r AS r_vec, v.s AS sim FROM text_leg t FULL JOIN vec_leg v ON t.doc_id = v.doc_id)"""


def legs(t) -> tuple[DataFrame, DataFrame]:
    vectors = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    return rc.text_leg(texts(t), WORDS, "doc_id", 50), rc.vector_leg(vectors, probe(t), "doc_id", 10)


@query("TXT5_token_counts", f"SELECT doc_id, len(w) AS n, len(list_distinct(w)) AS n_distinct, coalesce(array_to_string(list_sort(list_distinct(w))[1:5], ' '), '') AS first FROM (SELECT doc_id, {TOKENS.format(c='text')} AS w FROM documents)")
def tokens(t):
    w = tx.words(F.col("text"))
    return t.texts.select("doc_id", F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"), F.array_join(F.slice(F.array_sort(F.array_distinct(w)), 1, 5), " ").alias("first"))


@query("TXT7_or_rank", f"WITH {TEXT_LEG} SELECT doc_id, r AS r_text, round(s, 9) AS text_score FROM text_leg")
def or_rank(t):
    return rc.text_leg(texts(t), WORDS, "doc_id", 50).withColumn("text_score", F.round("text_score", 9))


BM = """, st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM tf), sc AS (SELECT doc_id, {sum} AS score FROM tf, st)
SELECT doc_id, round(score, 6) AS score FROM sc WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20"""


def bm_sql(tf: list[str], dl: str, source: str) -> str:
    n = range(len(tf))
    rows = f"WITH b AS ({source}), tf AS (SELECT doc_id, {dl} AS dl, " + ", ".join(f"CAST({x} AS DOUBLE) AS tf{i}" for i, x in enumerate(tf)) + " FROM b)"
    each = " + ".join(f"ln(1 + (n - df{i} + 0.5) / CAST(df{i} + 0.5 AS DOUBLE)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in n)
    return rows + BM.format(df=", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in n), sum=each)


HITS = "len(list_filter({w}, lambda x: x = '{q}'))"


@query("TXT8_bm25", bm_sql([HITS.format(w="w", q=q) for q in WORDS], "len(w)", f"SELECT doc_id, {TOKENS.format(c='text')} AS w FROM documents"))
def bm25(t):
    return rc.bm25(texts(t), WORDS, "doc_id").orderBy(F.desc("score"), "doc_id").limit(20).withColumn("score", F.round("score", 6))


@query("TXT9_weighted_bm25", bm_sql([f"10 * {HITS.format(w='h', q=q)} + {HITS.format(w='w', q=q)}" for q in WORDS], "len(h) + len(w)", f"SELECT doc_id, {TOKENS.format(c='text')} AS w, {TOKENS.format(c='text[1:80]')} AS h FROM documents"))
def weighted_bm25(t):
    """The first 80 characters stand for a title that weighs ten times as much."""
    docs = texts(t).withColumn("head", F.substring("content", 1, 80))
    return rc.bm25(docs, WORDS, "doc_id", columns={"head": 10.0, "content": 1.0}).orderBy(F.desc("score"), "doc_id").limit(20).withColumn("score", F.round("score", 6))


@query("TXT9_index", bm_sql([f"10 * {HITS.format(w='h', q=q)} + {HITS.format(w='w', q=q)}" for q in WORDS], "len(h) + len(w)", f"SELECT doc_id, {TOKENS.format(c='text')} AS w, {TOKENS.format(c='lang || chr(32) || source')} AS h FROM documents"))
def indexed_bm25(t):
    """By an index of two segments, merged: language and source as a title that weighs ten times as much."""
    docs = spread(t.documents.select("doc_id", F.col("text").alias("content"), F.concat_ws(" ", "lang", "source").alias("head")))
    path = scratch_path(t.spark, "index")
    early = F.col("doc_id") < t.documents.agg(F.avg("doc_id")).first()[0]
    for part in (early, ~early):
        ix.add(docs.where(part), path, "doc_id", {"head": 10.0, "content": 1.0})
    ix.merge(t.spark, path)
    return ix.search(t.spark, path, WORDS, 20).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@query("TXT10_linear_hybrid", f"WITH {TEXT_LEG.replace('LIMIT 50', '')}, v AS (SELECT a.vec_id AS doc_id, {COS} AS sim FROM embeddings a, embeddings b WHERE b.vec_id = {PROBE}) SELECT v.doc_id, round(0.3 * coalesce(t.s, 0) + 0.7 * v.sim, 6) AS score FROM v LEFT JOIN text_leg t ON t.doc_id = v.doc_id ORDER BY 0.3 * coalesce(t.s, 0) + 0.7 * v.sim DESC, v.doc_id LIMIT 20")
def linear(t):
    both = rc.knn(t.embeddings.withColumnRenamed("vec_id", "doc_id"), probe(t)).select("doc_id", "similarity").join(rc.or_rank(texts(t), WORDS).select("doc_id", "text_score"), "doc_id", "left")
    scored = both.withColumn("score", 0.3 * F.coalesce("text_score", F.lit(0.0)) + 0.7 * F.col("similarity"))
    return scored.orderBy(F.desc("score"), "doc_id").limit(20).select("doc_id", F.round("score", 6).alias("score"))


@query("TXT11_query_expansion", f"""WITH {VEC_LEG}, near AS (SELECT doc_id FROM vec_leg WHERE r <= 20), w AS (SELECT doc_id, unnest(list_distinct({TOKENS.format(c='text')})) AS term FROM documents),
df AS (SELECT term, count(*) AS df FROM w GROUP BY 1), nb AS (SELECT term, count(*) AS near FROM w JOIN near USING (doc_id) GROUP BY 1),
s AS (SELECT term, near * ln((SELECT count(*) FROM documents) / CAST(1 + df AS DOUBLE)) AS score FROM nb JOIN df USING (term) WHERE term NOT IN ({IN}) AND ln((SELECT count(*) FROM documents) / CAST(1 + df AS DOUBLE)) >= 1)
SELECT term, round(score, 6) AS score FROM s ORDER BY s.score DESC, term LIMIT 5""")
def expansion(t):
    vectors = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    near = rc.vector_leg(vectors, probe(t), "doc_id", 10).where("r_vec <= 20").select("doc_id")
    return rc.expand_query(texts(t).join(F.broadcast(near), "doc_id"), texts(t), WORDS).withColumn("score", F.round("score", 6))


@query("AGG19_idf", f"""WITH w AS (SELECT doc_id, unnest(list_distinct({TOKENS.format(c='text')})) AS term FROM documents) SELECT term, count(*) AS df, round(ln((SELECT count(*) FROM documents) / CAST(1 + count(*) AS DOUBLE)), 9) AS idf FROM w GROUP BY 1""")
def idf(t):
    n = t.documents.agg(F.count("*").alias("n"))
    return rc.document_frequency(texts(t)).crossJoin(F.broadcast(n)).select("term", "df", F.round(F.ln(F.col("n") / (1.0 + F.col("df"))), 9).alias("idf"))


@query("AGG20_noise_tags", """WITH g AS (SELECT source AS tag, count(*) AS df FROM documents GROUP BY 1), i AS (SELECT tag, df, ln((SELECT count(*) FROM documents) / CAST(1 + df AS DOUBLE)) AS idf FROM g),
o AS (SELECT *, row_number() OVER (ORDER BY idf, tag) - 1 AS pos, count(*) OVER () AS n FROM i)
SELECT tag, df, round(idf, 9) AS idf, idf <= (SELECT idf FROM o WHERE pos = CAST(floor(n * 10 / 100) AS BIGINT)) AS noise FROM o""")
def noise(t):
    return rr.tag_noise(t.documents.select("doc_id", F.col("source").alias("tag")), 10).withColumn("idf", F.round("idf", 9))


@query("FLT9_substring_fallback", "SELECT doc_id, 0.1 AS similarity FROM documents WHERE contains(lower(text), 'thion') ORDER BY doc_id DESC LIMIT 20")
def fallback(t):
    """The first word of the query as a literal; newest (largest id) first, at a fixed similarity."""
    return t.documents.where(F.contains(F.lower("text"), F.lit("thion"))).orderBy(F.desc("doc_id")).limit(20).select("doc_id", F.lit(0.1).alias("similarity"))


@query("VEC2_knn", f"WITH {VEC_LEG} SELECT doc_id, round(s, 9) AS similarity, r AS r_vec FROM vec_leg")
def knn(t):
    return legs(t)[1].withColumn("similarity", F.round("similarity", 9))


@query("FLT14_threshold", f"SELECT a.vec_id, round({COS}, 9) AS similarity FROM embeddings a, embeddings b WHERE b.vec_id = {PROBE} AND {COS} >= 0.2")
def threshold(t):
    return rc.knn(t.embeddings, probe(t)).where("similarity >= 0.2").select("vec_id", F.round("similarity", 9).alias("similarity"))


@query("VEC3_recency_blend", f"WITH s AS (SELECT a.vec_id, 0.9 * {COS} + 0.1 * greatest(0, 1 - (a.vec_id % 60) / 30.0) AS score FROM embeddings a, embeddings b WHERE b.vec_id = {PROBE}) SELECT vec_id, round(score, 9) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 20")
def recency(t):
    blended = rc.recency_blend(rc.knn(t.embeddings, probe(t)), F.col("vec_id") % 60, 0.1)
    return blended.orderBy(F.desc("score"), "vec_id").limit(20).select("vec_id", F.round("score", 9).alias("score"))


@query("VEC5_hybrid_rrf", f"WITH {FUSED} SELECT doc_id, round(rrf, 9) AS rrf, r_text, r_vec FROM fused ORDER BY fused.rrf DESC, doc_id LIMIT 10")
def hybrid(t):
    fused = rc.fuse(*legs(t), "doc_id").orderBy(F.desc("rrf"), "doc_id").limit(10)
    return fused.select("doc_id", F.round("rrf", 9).alias("rrf"), "r_text", "r_vec")


@query("VEC5_boosted_rrf", LEARNINGS + f""", {FUSED}, b AS (SELECT f.doc_id, rrf + CASE WHEN recall_count > 0 THEN 0.002 * log2(1 + recall_count) ELSE 0 END AS boosted FROM fused f LEFT JOIN learnings l ON l.id = f.doc_id)
SELECT doc_id, round(boosted, 9) AS boosted FROM b ORDER BY b.boosted DESC, doc_id LIMIT 20""")
def boosted(t):
    recall = t.learnings.select(F.col("id").alias("doc_id"), "recall_count")
    return rc.fuse(*legs(t), "doc_id", recall).orderBy(F.desc("boosted"), "doc_id").limit(20).select("doc_id", F.round("boosted", 9).alias("boosted"))


@query("VEC7_fit_dimension", "SELECT vec_id, 100 AS size, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings")
def fit_dimension(t):
    fitted = vc.fit_dimension(F.col("embedding"), 100)
    return t.embeddings.select("vec_id", F.size(fitted).alias("size"), F.round(F.aggregate(fitted, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("VEC8_mock_embedding", """SELECT doc_id, round(list_sum(list_transform(range(0, 16), lambda i: ((CAST('0x' || substr(sha256(text), i * 2 + 1, 2) AS INTEGER) + i) % 256) / CAST(255 AS DOUBLE) * 2 - 1)), 9) AS total FROM documents""")
def mock(t):
    return t.documents.select("doc_id", F.round(F.aggregate(vc.mock_embedding(F.col("text"), 16), F.lit(0.0), lambda s, x: s + x), 9).alias("total"))


@query("JOI3_nearest_neighbours", f"""WITH p AS (SELECT a.vec_id AS id, b.vec_id AS other, {COS} AS s FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, other) AS rank FROM p)
SELECT id, other, round(s, 9) AS similarity, rank FROM r WHERE rank <= 5""")
def nearest(t):
    return pr.nearest(t.embeddings, 5).withColumn("similarity", F.round("similarity", 9))


@query("VEC20_merge_pairs", f"SELECT a.vec_id AS a, b.vec_id AS b, round({COS}, 9) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id < b.vec_id AND {COS} >= 0.35")
def merge_pairs(t):
    return pr.similar_pairs(t.embeddings, 0.35).withColumn("similarity", F.round("similarity", 9))


@query("AGG22_density", f"""WITH p AS (SELECT {COS} AS s FROM embeddings a, embeddings b WHERE a.vec_id < b.vec_id), l AS (SELECT unnest([0.3, 0.5, 0.7, 0.9]) AS level)
SELECT CAST(level AS DOUBLE) AS level, count(*) FILTER (s >= level) AS pairs, round(100.0 * CAST(count(*) FILTER (s >= level) AS DOUBLE) / count(*), 4) AS pct FROM p, l GROUP BY 1""")
def density(t):
    return pr.density(t.embeddings, [0.3, 0.5, 0.7, 0.9])


@query("AGG18_centroids", """WITH e AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) SELECT label, i AS pos, round(avg(CAST(x AS DOUBLE)), 6) AS value FROM e GROUP BY 1, 2""")
def centroids(t):
    return rr.centroids(t.embeddings, "label").select("label", F.posexplode("centroid").alias("p", "value")).select("label", (F.col("p") + 1).cast("long").alias("pos"), F.round("value", 6).alias("value"))


@query("VEC18_type_softmax", f"""WITH e AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS v FROM e GROUP BY 1, 2),
m AS (SELECT label, list(v ORDER BY i) AS embedding FROM c GROUP BY 1), s AS (SELECT a.label, {COS} / 0.05 AS x FROM m a, embeddings b WHERE b.vec_id = {PROBE}), q AS (SELECT label, exp(x - (SELECT max(x) FROM s)) AS p FROM s)
SELECT label, round(p / sum(p) OVER (), 6) AS probability FROM q""")
def softmax(t):
    return rr.type_probabilities(rr.centroids(t.embeddings, "label"), probe(t), "label").withColumn("probability", F.round("probability", 6))


TYPES, TAGS, ENTITIES = {"en": 0.4, "fr": 0.3, "de": 0.25, "xx": 0.05}, ["src0", "en"], [("SRC0", "module"), ("en", "language"), ("other", "error")]
SIGNALS = f"""sig AS (SELECT f.doc_id, rrf, least(1, greatest(0, rrf * 25)) AS cal, CASE WHEN project = 'src0' THEN 1.0 WHEN contains(project, 'src0') OR contains('src0', project) THEN 0.5 ELSE 0.0 END AS s_project,
exp(-(date_diff('second', created_at, TIMESTAMP '{AS_OF}') / 86400.0) / 45) AS s_recency, CASE confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.6 WHEN 'low' THEN 0.2 ELSE 0.5 END AS s_confidence,
least(1, log2(1 + recall_count) / 10) AS s_recall, CASE type WHEN 'en' THEN 0.5 + 1.5 * (0.4 - 0.25) WHEN 'fr' THEN 0.5 + 1.5 * (0.3 - 0.25) WHEN 'de' THEN 0.5 ELSE 0.5 END AS s_type,
((CASE WHEN project = 'src0' THEN 1 ELSE 0 END) + (CASE WHEN type = 'en' THEN 1 ELSE 0 END)) / CAST(4 - ((CASE WHEN project = 'src0' THEN 1 ELSE 0 END) + (CASE WHEN type = 'en' THEN 1 ELSE 0 END)) AS DOUBLE) AS s_tag,
CASE WHEN id % 3 = 0 THEN (id % 10) / CAST(10 AS DOUBLE) * ((CASE WHEN project = 'src0' THEN 1 ELSE 0 END) + (CASE WHEN type = 'en' THEN 1 ELSE 0 END)) / CAST(2 AS DOUBLE) ELSE 0 END AS s_pattern,
CASE WHEN id % 2 = 0 THEN ((CASE WHEN project = 'src0' THEN 1.0 ELSE 0 END) + (CASE WHEN type = 'en' THEN 0.4 ELSE 0 END)) / CAST(2.3 + (CASE WHEN project = 'src0' THEN 0 ELSE 1.0 END) + (CASE WHEN type = 'en' THEN 0 ELSE 0.4 END) AS DOUBLE) ELSE 0 END AS s_graph,
true AS graph_active FROM fused f JOIN learnings l ON l.id = f.doc_id)"""
SCORE = "(1 - wp - wr - wc - wn - wy - wt - wa - wg) * cal + wp * s_project + wr * s_recency + wc * s_confidence + wn * s_recall + wy * s_type + wt * s_tag + wa * s_pattern + wg * s_graph"


def described(rows: DataFrame) -> DataFrame:
    """Every third row has a pattern with its project and type as tags, every second one has them as entities."""
    known = F.array(F.struct(F.col("project").alias("name"), F.lit("module").alias("type")), F.struct(F.col("type").alias("name"), F.lit("language").alias("type")))
    return rows.withColumns(
        {
            "tags": F.array("project", "type"), "pattern_strength": F.when(F.col("doc_id") % 3 == 0, (F.col("doc_id") % 10) / 10.0), "pattern_tags": F.array("project", "type"),
            "entities": F.when(F.col("doc_id") % 2 == 0, known).otherwise(F.array().cast("array<struct<name:string,type:string>>")),
        }
    )


def features(t) -> DataFrame:
    rows = described(rc.fuse(*legs(t), "doc_id").join(t.learnings.withColumnRenamed("id", "doc_id"), "doc_id"))
    return rr.signals(rows, "src0", AS_OF, TAGS, TYPES, ENTITIES)


def signal_query(name: str, column: str) -> None:
    @query(name, LEARNINGS + f", {FUSED}, {SIGNALS} SELECT doc_id, round({column}, 9) AS signal FROM sig")
    def one(t):
        return features(t).select("doc_id", F.round(column, 9).alias("signal"))


for _name, _column in (("VEC10_project_match", "s_project"), ("VEC11_recency", "s_recency"), ("VEC12_confidence", "s_confidence"), ("VEC13_recall", "s_recall"), ("VEC14_type_match", "s_type"), ("VEC16_pattern_score", "s_pattern"), ("VEC17_graph_overlap", "s_graph")):
    signal_query(_name, _column)


@query("VEC9_calibrated", f"""WITH {VEC_LEG}, {TEXT_LEG}, a AS (SELECT 'vector' AS mode, doc_id, least(1, greatest(0, (s + 1) / 2)) AS score FROM vec_leg UNION ALL SELECT 'rrf', doc_id, least(1, greatest(0, 25.0 / CAST(60 + r AS DOUBLE))) FROM vec_leg UNION ALL SELECT 'text', doc_id, s / (s + 1) FROM text_leg
UNION ALL SELECT 'other', doc_id, 1 - (r - 1) / CAST((SELECT count(*) FROM vec_leg) AS DOUBLE) FROM vec_leg) SELECT mode, doc_id, round(score, 9) AS score FROM a""")
def calibrations(t):
    text, vector = legs(t)
    total = vector.agg(F.count("*").alias("total"))
    made = lambda df, mode, score: df.select(F.lit(mode).alias("mode"), "doc_id", F.round(score, 9).alias("score"))
    out = made(vector, "vector", rr.calibrated(F.col("similarity"), "vector")).unionByName(made(vector, "rrf", rr.calibrated(1.0 / (60 + F.col("r_vec")), "rrf")))
    out = out.unionByName(made(text, "text", rr.calibrated(F.col("text_score"), "text")))
    return out.unionByName(made(vector.crossJoin(F.broadcast(total)), "other", rr.calibrated(F.col("similarity"), "other", F.col("r_vec") - 1, F.col("total"))))


WEIGHED = ", ".join(f"{w} AS {n}" for n, w in zip("wp wr wc wn wy wt wa wg".split(), rr.WEIGHTS.values(), strict=True))


@query("VEC19_rerank", LEARNINGS + f", {FUSED}, {SIGNALS}, r AS (SELECT doc_id, {SCORE} AS score FROM sig, (SELECT {WEIGHED})) SELECT doc_id, round(score, 9) AS score FROM r ORDER BY r.score DESC, doc_id LIMIT 10")
def rerank(t):
    return rr.rerank(features(t), rr.WEIGHTS, "doc_id", 10).select("doc_id", F.round("score", 9).alias("score"))


POOLED = FUSED.replace("LIMIT 50)", "LIMIT 400)").replace("LIMIT 80)", "LIMIT 400)").replace("fused AS (", "fused0 AS (") + """, boosted0 AS (SELECT f.*, rrf + CASE WHEN recall_count > 0 THEN 0.002 * log2(1 + recall_count) ELSE 0 END AS raw FROM fused0 f LEFT JOIN learnings l ON l.id = f.doc_id),
twice AS (SELECT * FROM boosted0 ORDER BY raw DESC, doc_id LIMIT 104), pool AS (SELECT * FROM twice WHERE raw >= 0.002 ORDER BY raw DESC, doc_id LIMIT 52), fused AS (SELECT p.* FROM pool p WHERE doc_id NOT IN (3, 10) ORDER BY raw DESC, doc_id LIMIT 50)"""


@query("VEC19_recall", LEARNINGS + f", {POOLED}, {SIGNALS}, r AS (SELECT s.doc_id, {SCORE} AS score FROM sig s JOIN learnings l ON l.id = s.doc_id, (SELECT {WEIGHED}) WHERE l.project = 'src0' OR l.type = 'en'), o AS (SELECT *, row_number() OVER (ORDER BY r.score DESC, doc_id) AS rank FROM r) SELECT rank, doc_id AS id, round(score, 9) AS score FROM o WHERE rank <= 10")
def recall(t):
    """The whole recall: both legs, the boost, the threshold, two ids seen before, tags that a row must have one of, all signals."""
    asked = ask.Ask(" ".join(WORDS), probe(t), k=10, tags=tuple(TAGS), tags_strict=True, context="src0", exclude=(3, 10), as_of=AS_OF, types=TYPES, entities=tuple(ENTITIES))
    memories = described(t.learnings.drop("content").withColumnRenamed("id", "doc_id")).withColumnRenamed("doc_id", "id")
    memories = memories.join(t.embeddings.select(F.col("vec_id").alias("id"), "embedding"), "id", "left")
    return ask.recall(memories, asked, texts(t).withColumnRenamed("doc_id", "id")).select("rank", "id", F.round("score", 9).alias("score"))


CONFIGS = ", ".join(f"('{name}', {', '.join(map(str, w))}, 0.05)" for name, w in rr.SWEEPS.items())


@query("AGG32_weight_sweep", LEARNINGS + f""", {FUSED}, {SIGNALS}, cfg AS (SELECT * FROM (VALUES {CONFIGS}) v(config, wp, wr, wc, wn, wy, wt, wa, wg)),
r AS (SELECT config, doc_id, {SCORE} AS score FROM sig, cfg), o AS (SELECT *, row_number() OVER (PARTITION BY config ORDER BY round(score, 9) DESC, doc_id) AS rank FROM r)
SELECT config, rank, doc_id, round(score, 9) AS score FROM o WHERE rank <= 5""")
def sweep(t):
    return rr.sweep(features(t), rr.sweep_configs(rr.WEIGHTS), "doc_id", 5)


@query("AGG31_ranking_quality", f"""WITH {VEC_LEG}, rel AS (SELECT v.doc_id, v.r, CASE WHEN e.label = (SELECT label FROM embeddings WHERE vec_id = {PROBE}) THEN 1 ELSE 0 END AS rel FROM vec_leg v JOIN embeddings e ON e.vec_id = v.doc_id WHERE v.doc_id <> {PROBE}),
k AS (SELECT rel, row_number() OVER (ORDER BY r) AS rank FROM rel), t AS (SELECT * FROM k WHERE rank <= 10), g AS (SELECT count(*) - 1 AS n FROM embeddings WHERE label = (SELECT label FROM embeddings WHERE vec_id = {PROBE}))
SELECT round(sum(rel) / CAST(count(*) AS DOUBLE), 6) AS "precision", round(sum(rel / log2(rank + 1)) / (SELECT list_sum(list_transform(range(1, least(10, n) + 1), lambda i: 1 / log2(i + 1))) FROM g), 6) AS ndcg, round(coalesce(1.0 / min(rank) FILTER (rel = 1), 0), 6) AS mrr FROM t""")
def quality(t):
    label = t.embeddings.where(F.col("vec_id") == PROBE).select("label").first()[0]
    golden = t.embeddings.where((F.col("label") == label) & (F.col("vec_id") != PROBE)).select(F.col("vec_id").alias("doc_id"))
    found = legs(t)[1].where(F.col("doc_id") != PROBE)
    hits = rc.ranked(found, [F.col("r_vec")], 10, "rank").join(golden.withColumn("rel", F.lit(1)), "doc_id", "left")
    return rr.ranking_quality(hits.withColumn("rel", F.coalesce("rel", F.lit(0))), golden.count(), 10)


@query("SET1_project_first", """WITH d AS (SELECT doc_id, source, n_chars FROM documents), own AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM d WHERE source = 'src1'), everywhere AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM d),
u AS (SELECT doc_id, CASE WHEN rank <= 5 THEN 0 ELSE 2 END AS tier, rank FROM own WHERE rank <= 10 UNION ALL SELECT doc_id, 1, rank FROM everywhere WHERE rank <= 10), f AS (SELECT doc_id, min({'a': tier, 'b': rank}) AS place FROM u GROUP BY 1)
SELECT doc_id, row_number() OVER (ORDER BY place, doc_id) AS position FROM f ORDER BY position LIMIT 10""")
def project_first(t):
    order = [F.desc("n_chars"), F.col("doc_id")]
    own = rc.ranked(t.documents.where("source = 'src1'"), order, 10, "rank").select("doc_id", "rank")
    return rc.project_first(own, rc.ranked(t.documents, order, 10, "rank").select("doc_id", "rank"), "doc_id", 10)


@query("WIN5_keyset_page", "SELECT doc_id, n_chars FROM documents WHERE (n_chars, doc_id) > (500, 100) ORDER BY n_chars, doc_id LIMIT 25")
def keyset(t):
    after = F.struct("n_chars", "doc_id") > F.struct(F.lit(500).cast("long"), F.lit(100).cast("long"))
    return t.documents.where(after).orderBy("n_chars", "doc_id").limit(25).select("doc_id", "n_chars")


@query("AGG21_dominant_space", "WITH g AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT label, n, (SELECT sum(n) FROM g) - n AS skipped FROM g ORDER BY n DESC, label LIMIT 1")
def dominant(t):
    counts = t.embeddings.groupBy("label").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all")))).orderBy(F.desc("n"), "label").limit(1).select("label", "n", (F.col("all") - F.col("n")).alias("skipped"))


STORED = """o AS (SELECT id, list(other) AS others, row_number() OVER (ORDER BY id) AS n FROM p GROUP BY 1), r(n, gone) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
SELECT o.n, CASE WHEN len(list_filter(o.others, lambda x: NOT list_contains(r.gone, x))) > 0 THEN list_append(r.gone, o.id) ELSE r.gone END FROM r JOIN o ON o.n = r.n + 1), g AS (SELECT unnest(gone) AS id FROM (SELECT gone FROM r ORDER BY n DESC LIMIT 1))"""


@query("JOI20_store_time_duplicate", f"""WITH RECURSIVE p AS (SELECT a.vec_id AS id, b.vec_id AS other, {COS} AS s FROM embeddings a, embeddings b WHERE b.vec_id < a.vec_id AND {COS} >= 0.35), {STORED}
SELECT p.id, arg_max(other, {{'s': s, 'o': -other}}) AS kept, round(max(s), 9) AS similarity FROM p JOIN g ON g.id = p.id WHERE other NOT IN (SELECT id FROM g) GROUP BY 1""")
def store_time(t):
    """Rows refused for a stored earlier one, with the nearest such; refused rows refuse nothing."""
    return pr.nearest_stored(t.embeddings, 0.35).withColumn("similarity", F.round("similarity", 9))


@query("VEC21_semantic_dedup", f"""WITH RECURSIVE h AS (SELECT e.vec_id, e.embedding, row_number() OVER (PARTITION BY sha256(d.text) ORDER BY d.doc_id) AS n FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id), u AS (SELECT vec_id, embedding FROM h WHERE n = 1),
p AS (SELECT a.vec_id AS id, b.vec_id AS other FROM u a, u b WHERE b.vec_id < a.vec_id AND {COS} >= 0.35), {STORED}
SELECT vec_id AS id, CASE WHEN vec_id IN (SELECT id FROM g) THEN 'similar' ELSE 'stored' END AS outcome FROM u UNION ALL SELECT vec_id, 'same text' FROM h WHERE n > 1""")
def semantic_dedup(t):
    both = t.embeddings.join(t.documents.select("doc_id", F.sha2("text", 256).alias("hash")), F.col("vec_id") == F.col("doc_id"))
    both = written(both.select("vec_id", "embedding", F.row_number().over(Window.partitionBy("hash").orderBy("doc_id")).alias("n")), "texts")
    fresh = both.where("n = 1").select("vec_id", "embedding")
    late = pr.refused_rows(fresh, 0.35).select(F.col("id").alias("vec_id"), F.lit("similar").alias("outcome"))
    stored = fresh.join(late, "vec_id", "left").select(F.col("vec_id").alias("id"), F.coalesce("outcome", F.lit("stored")).alias("outcome"))
    return stored.unionByName(both.where("n > 1").select(F.col("vec_id").alias("id"), F.lit("same text").alias("outcome")))
