"""Queries of scans, predicates, joins, windows and sorts that have a function of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramite.functions import text as tx
from engramite.functions import vectors as vc
from engramite.operators import metrics as m
from engramite.operators import pairs as pr
from engramite.operators import recall as rc
from engramite.operators import scans as sc
from engramite.plans.recall import COS, FUSED, PROBE, STOP, TEXT_LEG, TOKENS, VEC_LEG, WORDS, bm_sql, HITS, legs, texts
from engramite.plans.registry import AS_OF, LEARNINGS, query


@query("SRC1_table_scan", "SELECT count(*) AS n, count(DISTINCT doc_id) AS ids, sum(n_chars) AS chars FROM documents")
def table_scan(t):
    return t.documents.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"), F.sum("n_chars").alias("chars"))


@query("SRC3_fallback_store", "SELECT doc_id, round(least(1, greatest(0, score / 25)), 6) AS score FROM (" + bm_sql([HITS.format(w="w", q=q) for q in WORDS], "len(w)", f"SELECT doc_id, {TOKENS.format(c='text')} AS w FROM documents") + ")")
def fallback_store(t):
    top = rc.bm25(texts(t), WORDS, "doc_id").orderBy(F.desc("score"), "doc_id").limit(20).withColumn("score", F.round("score", 6))
    return top.select("doc_id", F.round(rc.bounded(F.col("score") / 25), 6).alias("score"))


@query("SRC4_cursor_fold", f"WITH w AS (SELECT unnest(list_distinct({TOKENS.format(c='text')})) AS term FROM documents), d AS (SELECT term, count(*) AS df FROM w GROUP BY 1) SELECT count(*) AS terms, CAST(sum(df) AS BIGINT) AS postings, max(df) AS most, (SELECT count(*) FROM documents) AS docs FROM d")
def cursor_fold(t):
    n = t.documents.agg(F.count("*").alias("docs"))
    return rc.document_frequency(texts(t)).agg(F.count("*").alias("terms"), F.sum("df").alias("postings"), F.max("df").alias("most")).crossJoin(F.broadcast(n))


@query("SRC5_dominant_dimension", "WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 32 ELSE len(embedding) END AS dimension FROM embeddings), g AS (SELECT dimension, count(*) AS n FROM e GROUP BY 1) SELECT vec_id, e.dimension, (SELECT sum(n) FROM g) - g.n AS skipped FROM e JOIN g ON g.dimension = e.dimension WHERE g.dimension = (SELECT dimension FROM g ORDER BY n DESC, dimension LIMIT 1)")
def dominant_dimension(t):
    cut = t.embeddings.withColumn("embedding", F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")))
    return sc.dominant_dimension(cut, "embedding").select("vec_id", "dimension", "skipped")


@query("FLT3_is_distinct", LEARNINGS + "SELECT id, confidence FROM learnings WHERE confidence IS DISTINCT FROM 'high'")
def is_distinct(t):
    return t.learnings.where(~F.col("confidence").eqNullSafe("high")).select("id", "confidence")


@query("FLT5_period", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-07 23:59:59.999999'")
def period(t):
    return sc.within(t.events, "ts", *sc.parse_period("2024-01-05:2024-01-07")).select("event_id", "ts")


@query("FLT7_json_containment", "SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS INTEGER) = 42")
def containment(t):
    return t.events.where(sc.json_contains("props", {"k": "42"})).select("event_id")


@query("FLT8_key_exists", "WITH e AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '{\"promoted_to\": \"x\"}' WHEN event_id % 9 = 0 THEN NULL ELSE props END AS p FROM events) SELECT event_id FROM e WHERE coalesce(json_exists(p, '$.promoted_to'), false)")
def key_exists(t):
    p = F.when(F.col("event_id") % 4 == 0, '{"promoted_to": "x"}').when(F.col("event_id") % 9 == 0, None).otherwise(F.col("props"))
    return t.events.withColumn("p", p).where(sc.json_has("p", "promoted_to")).select("event_id")


@query("FLT10_membership", "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS member FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def membership(t):
    left = sc.members(t.documents.select("doc_id"), t.labels.where("toxic = 1"), "doc_id", present=False)
    good = t.labels.where("quality = 1").select("doc_id")
    return sc.members(left, good, "doc_id").withColumn("member", F.lit(True)).unionByName(sc.members(left, good, "doc_id", present=False).withColumn("member", F.lit(False)))


@query("FLT12_exclude_ids", "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 3) AND doc_id <> 5 ORDER BY n_chars DESC, doc_id LIMIT 10")
def exclude_ids(t):
    order = [F.desc("n_chars"), F.col("doc_id")]
    seen = [r["doc_id"] for r in t.documents.orderBy(*order).limit(3).collect()] + [5]
    return sc.without_then_top(t.documents.select("doc_id", "n_chars"), seen, "doc_id", order, 10)


@query("FLT16_topic_match", "SELECT conv_id, turn FROM conversations WHERE conv_id <> 3 AND (contains(lower(role), 'assist') OR contains(lower(text), 'assist') OR list_contains([role, 'x' || turn], 'assist'))")
def topic_match(t):
    turns = t.conversations.withColumn("relevant", F.array("role", F.concat(F.lit("x"), "turn")))
    return sc.topic_match(turns, "assist", "conv_id", 3, ["role", "text"], "relevant").select("conv_id", "turn")


@query("FLT17_source_time", """WITH s AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'no time' WHEN 1 THEN '2023-12-31 23:59:59' WHEN 2 THEN '2024-02-01 00:06:00' WHEN 3 THEN '2024-02-01 00:04:00' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS raw FROM events)
SELECT event_id, strftime(CASE WHEN try_cast(raw AS TIMESTAMP) >= TIMESTAMP '2024-01-01' AND try_cast(raw AS TIMESTAMP) <= TIMESTAMP '2024-02-01 00:05:00' THEN try_cast(raw AS TIMESTAMP) END, '%Y-%m-%d %H:%M:%S') AS at FROM s""")
def source_time(t):
    k = F.col("event_id") % 5
    raw = F.when(k == 0, "no time").when(k == 1, "2023-12-31 23:59:59").when(k == 2, "2024-02-01 00:06:00").when(k == 3, "2024-02-01 00:04:00").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return t.events.select("event_id", F.date_format(sc.source_time(raw, "2024-02-01 00:00:00"), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("PRJ2_parse_metadata", "SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN -1 ELSE CAST(json_extract(props, '$.k') AS INTEGER) END AS k FROM events")
def parse_metadata(t):
    raw = F.when(F.col("event_id") % 5 == 0, F.lit('{"k": ')).when(F.col("event_id") % 7 == 0, None).otherwise(F.col("props"))
    return t.events.select("event_id", F.coalesce(F.from_json(raw, "k int")["k"], F.lit(-1)).alias("k"))


@query("JOI1_full_outer", f"WITH {FUSED} SELECT doc_id, r_text, r_vec FROM fused")
def full_outer(t):
    text, vector = legs(t)
    return text.select("doc_id", "r_text").join(vector.select("doc_id", "r_vec"), "doc_id", "full")


@query("JOI2_ids_to_fact", f"WITH {VEC_LEG} SELECT d.doc_id, d.source, d.n_chars, v.r AS r_vec FROM vec_leg v JOIN documents d ON d.doc_id = v.doc_id WHERE v.r <= 10")
def ids_to_fact(t):
    return t.documents.select("doc_id", "source", "n_chars").join(F.broadcast(legs(t)[1].where("r_vec <= 10").select("doc_id", "r_vec")), "doc_id")


@query("JOI5_unnest", "WITH l AS (SELECT user_id, CAST(ts AS DATE) AS day, list(event_id) FILTER (event_type = 'click') AS ids FROM events GROUP BY 1, 2) SELECT user_id, unnest(ids) AS event_id FROM l")
def unnest(t):
    ids = F.collect_list(F.when(F.col("event_type") == "click", F.col("event_id")))
    return t.events.groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(ids.alias("ids")).select("user_id", F.explode("ids").alias("event_id"))


@query("JOI8_top_per_key", "WITH r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS n FROM lineitem), k AS (SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY n) AS top FROM r WHERE n <= 3 GROUP BY 1) SELECT o_orderkey, top FROM orders LEFT JOIN k ON l_orderkey = o_orderkey")
def top_per_key(t):
    lines = sc.top_per_key(t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_orderkey", [F.desc("l_extendedprice"), F.col("l_linenumber")], 3)
    top = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "l_linenumber"))), lambda s: s["l_linenumber"].cast("string")), ",").alias("top"))
    return t.orders.select("o_orderkey").join(top, "o_orderkey", "left")


@query("JOI15_orphans", "SELECT c_custkey, c_nationkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey WHERE o_orderkey IS NULL")
def orphans(t):
    return t.customer.join(t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_nationkey")


@query("JOI19_pairs", f"SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a, embeddings b WHERE a.vec_id < b.vec_id AND {COS} >= 0.45")
def all_pairs(t):
    return pr.similar_pairs(t.embeddings, 0.45).select("a", "b")


@query("AGG4_percentage", "SELECT user_id, count(*) FILTER (event_type = 'error') AS errors, CASE WHEN count(*) FILTER (event_type IN ('error', 'purchase')) = 0 THEN 0.0 ELSE round(CAST(100.0 AS DOUBLE) * count(*) FILTER (event_type = 'error') / count(*) FILTER (event_type IN ('error', 'purchase')), 1) END AS pct FROM events GROUP BY 1")
def percentage(t):
    errors, part = F.count_if(F.col("event_type") == "error"), F.count_if(F.col("event_type").isin("error", "purchase"))
    return t.events.groupBy("user_id").agg(errors.alias("errors"), m.share(errors, part).alias("pct"))


@query("WIN1_text_rank", f"WITH {TEXT_LEG} SELECT doc_id, r AS r_text FROM text_leg")
def text_rank(t):
    return legs(t)[0].select("doc_id", "r_text")


@query("WIN2_vector_rank", f"WITH {VEC_LEG} SELECT doc_id, r AS r_vec FROM vec_leg")
def vector_rank(t):
    return legs(t)[1].select("doc_id", "r_vec")


@query("WIN4_distinct_on", "SELECT DISTINCT ON (user_id, CAST(ts AS DATE)) user_id, strftime(ts, '%Y-%m-%d') AS day, event_id FROM events ORDER BY user_id, CAST(ts AS DATE), ts DESC, event_id DESC")
def distinct_on(t):
    return m.latest(t.events.select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts", "event_id"), ["user_id", "day"], F.desc("ts"), F.desc("event_id")).select("user_id", "day", "event_id")


@query("SRT4_overfetch_threshold", f"WITH {FUSED}, f AS (SELECT doc_id, rrf FROM fused ORDER BY rrf DESC, doc_id LIMIT 20) SELECT doc_id, round(rrf, 9) AS rrf FROM f WHERE rrf >= 0.2 * 0.01 * 7 ORDER BY f.rrf DESC, doc_id LIMIT 10")
def overfetch_threshold(t):
    return rc.overfetch(rc.fuse(*legs(t), "doc_id"), "rrf", "doc_id", 10, 0.2 * 0.01 * 7).select("doc_id", F.round("rrf", 9).alias("rrf"))


@query("SET2_priority_union", LEARNINGS + """, a AS (SELECT * FROM learnings WHERE superseded_by IS NULL AND archived_at IS NULL), p AS (SELECT id, row_number() OVER (ORDER BY recall_count DESC, id) AS rank FROM a ORDER BY rank LIMIT 8), s AS (SELECT id, row_number() OVER (ORDER BY created_at DESC, id) AS rank FROM a ORDER BY rank LIMIT 8),
u AS (SELECT id, 0 AS tier, rank FROM p UNION ALL SELECT id, 1, rank FROM s) SELECT id, min({'t': tier, 'r': rank}).t AS tier, min({'t': tier, 'r': rank}).r AS rank FROM u GROUP BY 1 ORDER BY tier, rank, id LIMIT 12""")
def priority_union(t):
    a = m.active(t.learnings)
    p = rc.ranked(a, [F.desc("recall_count"), F.col("id")], 8, "rank").select("id", "rank")
    return sc.priority_union([p, rc.ranked(a, [F.desc("created_at"), F.col("id")], 8, "rank").select("id", "rank")], "id", "rank", 12).select("id", "tier", "rank")


WHITE = r"[ \t\r\n\f\x0B]+"


@query("TXT1_sanitize", rf"SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split_regex(text, '{WHITE}'), lambda w: regexp_replace(w, '[^a-zA-Z0-9]', '', 'g')), lambda w: length(w) > 2), ' ') AS words FROM conversations")
def sanitize(t):
    return t.conversations.select("conv_id", "turn", F.array_join(tx.sanitized(F.split("text", WHITE)), " ").alias("words"))


CLEAN = rf"list_filter(string_split_regex(replace(lower(text), '-', ' '), '{WHITE}'), lambda w: w <> '' AND w NOT IN ({STOP}))"


@query("TXT2_clean_query", f"SELECT conv_id, turn, CASE WHEN len({CLEAN}) = 0 THEN text ELSE array_to_string({CLEAN}, ' ') END AS cleaned FROM conversations")
def clean_query(t):
    return t.conversations.select("conv_id", "turn", tx.cleaned_query(F.col("text")).alias("cleaned"))


@query("TXT3_or_query", f"SELECT conv_id, turn, coalesce(array_to_string({TOKENS.format(c='text')}, ' | '), '') AS query FROM conversations")
def or_query(t):
    return t.conversations.select("conv_id", "turn", F.array_join(tx.words(F.col("text")), " | ").alias("query"))


@query("TXT4_stopwords", rf"SELECT conv_id, turn, len(list_filter(string_split_regex(lower(text), '{WHITE}'), lambda w: w IN ({STOP}))) AS n FROM conversations")
def stopwords(t):
    return t.conversations.select("conv_id", "turn", F.size(F.filter(F.split(F.lower("text"), WHITE), lambda w: w.isin(tx.STOPWORDS))).cast("long").alias("n"))


@query("TXT12_cache_stale", """WITH c AS (SELECT source, count(*) AS n, count(*) FILTER (doc_id % 20 <> 3) AS counted, min(doc_id) AS first FROM documents GROUP BY 1)
SELECT source, date_diff('second', TIMESTAMP '2024-02-28' + to_hours(CAST(first * 7 % 40 AS INTEGER)), TIMESTAMP '2024-03-01') / CAST(3600 AS DOUBLE) >= 24 OR abs(n - counted) / CAST(counted AS DOUBLE) > 0.05 AS stale FROM c""")
def cache_stale(t):
    c = t.documents.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("doc_id") % 20 != 3).alias("counted"), F.min("doc_id").alias("first"))
    built = F.expr("timestamp_ntz'2024-02-28 00:00:00' + make_dt_interval(0, cast(first * 7 % 40 as int))")
    return c.select("source", sc.cache_is_stale(built, AS_OF, F.col("n"), F.col("counted"), 24, 0.05).alias("stale"))


@query("TXT22_outcome", """SELECT o_orderkey, CASE upper(raw) WHEN 'SUCCESS' THEN 'SUCCEEDED' WHEN 'SUCCEEDED' THEN 'SUCCEEDED' WHEN 'PARTIAL' THEN 'PARTIAL_PLUS' WHEN 'PARTIAL_PLUS' THEN 'PARTIAL_PLUS' WHEN 'PARTIAL_MINUS' THEN 'PARTIAL_MINUS' WHEN 'FAILED' THEN 'FAILED' WHEN 'FAILURE' THEN 'FAILED' ELSE 'UNKNOWN' END AS outcome
FROM (SELECT o_orderkey, list_extract(['success', 'Succeeded', 'partial', 'Partial_Plus', 'PARTIAL_MINUS', 'failed', 'Failure', 'unknown', 'odd', NULL], CAST(o_orderkey % 10 + 1 AS INTEGER)) AS raw FROM orders)""")
def outcome(t):
    raw = F.element_at(F.array(*[F.lit(x) for x in ("success", "Succeeded", "partial", "Partial_Plus", "PARTIAL_MINUS", "failed", "Failure", "unknown", "odd", None)]), (F.col("o_orderkey") % 10 + 1).cast("int"))
    return t.orders.select("o_orderkey", tx.outcome(raw).alias("outcome"))


@query("TXT24_core_filter", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'large ring set') OR contains('large ring set', lower(p_name))")
def core_filter(t):
    return tx.core_matches(t.part, "p_name", "Large Ring SET").select("p_partkey", "p_name")


@query("VEC1_cosine", f"SELECT a.vec_id, round(CASE WHEN a.vec_id % 50 = 0 THEN 0.0 ELSE {COS} END, 9) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine(t):
    """Each vector with the next one; every fiftieth is made all zeros, which is like nothing."""
    zero = F.transform("embedding", lambda x: x * 0)
    a = t.embeddings.select("vec_id", F.when(F.col("vec_id") % 50 == 0, zero).otherwise(F.col("embedding")).alias("one"))
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("two"))
    return a.join(b, "vec_id").select("vec_id", F.round(vc.cosine(F.col("one"), F.col("two")), 9).alias("similarity"))


@query("VEC6_ladder", f"WITH {TEXT_LEG.replace(chr(39) + 'thing' + chr(39), chr(39) + 'zzznone' + chr(39)).replace(chr(39) + 'ering' + chr(39), chr(39) + 'zzznone' + chr(39)).replace(chr(39) + 'tion' + chr(39), chr(39) + 'zzznone' + chr(39))}, p AS (SELECT doc_id, {HITS.format(w='w', q='tion')} AS n FROM toks), q AS (SELECT doc_id, 1 AS level FROM p WHERE n > 0), s AS (SELECT doc_id, 2 AS level FROM documents WHERE contains(lower(text), 'thion')), u AS (SELECT doc_id, 0 AS level FROM text_leg UNION ALL SELECT * FROM q UNION ALL SELECT * FROM s) SELECT doc_id, level FROM u WHERE level = (SELECT min(level) FROM u)")
def ladder(t):
    """An expanded query that finds nothing, then the plain one, then the substring; the first with rows answers."""
    expanded = rc.text_leg(texts(t), ["zzznone"], "doc_id", 50).select("doc_id")
    plain = t.texts.where(tx.word_count(F.col("text"), "tion") > 0).select("doc_id")
    return sc.first_level([expanded, plain, t.texts.where(F.contains(F.lower("text"), F.lit("thion"))).select("doc_id")], "doc_id").select("doc_id", "level")
