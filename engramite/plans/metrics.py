"""Metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramite.operators import metrics as m
from engramite.plans.registry import AS_OF, LEARNINGS, query

T = f"TIMESTAMP '{AS_OF}'"
PCT = "CASE WHEN {b} = 0 THEN 0.0 ELSE round(CAST(100.0 AS DOUBLE) * {a} / {b}, 1) END"


@query("AGG1_totals", LEARNINGS + """SELECT count(*) FILTER (superseded_by IS NULL AND archived_at IS NULL) AS active, count(superseded_by) AS superseded,
count(*) FILTER (archived_at IS NOT NULL AND superseded_by IS NULL) AS archived, count(*) AS total FROM learnings""")
def totals(t):
    return m.totals(t.learnings)


@query("AGG2_per_session", LEARNINGS + """, e AS (SELECT project, count(*) AS n, max(created_at) AS last FROM learnings WHERE superseded_by IS NULL GROUP BY 1)
SELECT * FROM (SELECT round(avg(n), 1) AS recent_avg, min(n) AS recent_min, max(n) AS recent_max FROM (SELECT * FROM e ORDER BY last DESC, project LIMIT 10)),
(SELECT round(avg(n), 1) AS overall_avg, count(*) AS sessions FROM e)""")
def per_session(t):
    return m.per_session(m.active(t.learnings, archived=False), "project")


@query("AGG3_confidence", LEARNINGS + f"""SELECT confidence, n, {PCT.format(a='n', b='(sum(n) OVER ())')} AS pct
FROM (SELECT coalesce(confidence, 'unset') AS confidence, count(*) AS n FROM learnings WHERE superseded_by IS NULL GROUP BY 1)""")
def confidence(t):
    return m.distribution(m.active(t.learnings, archived=False), "confidence")


@query("AGG5_coverage", LEARNINGS + f"""SELECT count(*) AS total, count(content_hash) AS with_content_hash, count(e.vec_id) AS with_vec_id,
{PCT.format(a='count(content_hash)', b='count(*)')} AS content_hash_pct, {PCT.format(a='count(e.vec_id)', b='count(*)')} AS vec_id_pct
FROM learnings l LEFT JOIN embeddings e ON e.vec_id = l.id""")
def coverage(t):
    joined = t.learnings.join(t.embeddings.select("vec_id"), F.col("id") == F.col("vec_id"), "left")
    return m.coverage(joined, "content_hash", "vec_id")


@query("AGG6_weekly_velocity", """WITH c AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS n FROM events
WHERE ts >= TIMESTAMP '2024-01-25' - INTERVAL 28 DAY AND ts < TIMESTAMP '2024-01-25' GROUP BY 1) SELECT strftime(week, '%Y-%m-%d') AS week, n, round(sum(n) OVER () / 4.0, 2) AS per_week FROM c""")
def velocity(t):
    return m.weekly_velocity(t.events, "ts", "2024-01-25 00:00:00").withColumn("week", F.col("week").cast("string"))


@query("AGG7_aged_never_recalled", LEARNINGS + f"""SELECT coalesce(confidence, 'unset') AS confidence, count(*) AS n FROM learnings
WHERE superseded_by IS NULL AND recall_count = 0 AND created_at < {T} - INTERVAL 30 DAY GROUP BY 1""")
def aged(t):
    return m.aged_never_recalled(t.learnings, AS_OF, 30)


@query("AGG8_recall_frequency", LEARNINGS + """SELECT count(*) FILTER (recall_count > 0) AS recalled, coalesce(round(avg(recall_count) FILTER (recall_count > 0), 2), 0.0) AS avg_recalls,
CAST(sum(recall_count) AS BIGINT) AS recalls, max(recall_count) AS most FROM learnings WHERE superseded_by IS NULL""")
def frequency(t):
    return m.recall_frequency(t.learnings)


@query("AGG9_type_recall", LEARNINGS + f"""SELECT type, count(*) AS stored, count(*) FILTER (recall_count > 0) AS recalled,
{PCT.format(a='count(*) FILTER (recall_count > 0)', b='count(*)')} AS pct FROM learnings WHERE superseded_by IS NULL GROUP BY 1""")
def type_recall(t):
    return m.type_recall(t.learnings)


@query("AGG10_extraction_funnel", """SELECT count(DISTINCT user_id) AS sessions, count(*) FILTER (event_type = 'signup') AS started, count(*) FILTER (event_type = 'error') AS failed,
count(*) FILTER (event_type IN ('view', 'click')) AS pending, count(*) FILTER (event_type = 'purchase') AS done FROM events""")
def funnel(t):
    kind = F.col("event_type")
    return t.events.agg(F.count_distinct("user_id").alias("sessions"), F.count_if(kind == "signup").alias("started"), F.count_if(kind == "error").alias("failed"), F.count_if(kind.isin("view", "click")).alias("pending"), F.count_if(kind == "purchase").alias("done"))


@query("AGG11_temporal", LEARNINGS + f"""SELECT min(created_at) AS first, max(created_at) AS last, count(*) FILTER (created_at >= {T} - INTERVAL 7 DAY) AS last_7,
count(*) FILTER (created_at >= {T} - INTERVAL 30 DAY) AS last_30, count(*) FILTER (superseded_by IS NULL AND recall_count = 0 AND created_at < {T} - INTERVAL 60 DAY) AS stale,
{PCT.format(a='count(superseded_by)', b='count(*)')} AS superseded_pct FROM learnings""")
def temporal(t):
    return m.temporal(t.learnings, AS_OF)


@query("AGG12_top_tags", "SELECT source AS tag, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, tag LIMIT 10")
def top_tags(t):
    return m.top_groups(t.documents.select(F.col("source").alias("tag")), "tag", 10)


@query("AGG13_feedback", """SELECT count(*) AS votes, count(DISTINCT doc_id) AS learnings, count(*) FILTER (quality = 1) AS helpful, count(DISTINCT doc_id) FILTER (quality = 0) AS unhelpful_learnings,
round(CAST(count(*) FILTER (quality = 1) AS DOUBLE) / count(*), 4) AS rate FROM labels""")
def feedback(t):
    bad = F.when(F.col("quality") == 0, F.col("doc_id"))
    return t.labels.agg(F.count("*").alias("votes"), F.count_distinct("doc_id").alias("learnings"), F.count_if(F.col("quality") == 1).alias("helpful"), F.count_distinct(bad).alias("unhelpful_learnings"), F.round(F.count_if(F.col("quality") == 1) / F.count("*"), 4).alias("rate"))


@query("AGG14_report", LEARNINGS + """, a AS (SELECT count(*) AS total, count(*) FILTER (superseded_by IS NULL AND archived_at IS NULL) AS active FROM learnings),
b AS (SELECT count(*) AS votes FROM labels), c AS (SELECT count(DISTINCT user_id) AS sessions FROM events WHERE event_type = 'purchase')
SELECT total, active, votes, sessions, round(CAST(total AS DOUBLE) / sessions, 2) AS learnings_per_extraction FROM a, b, c""")
def report(t):
    a = m.totals(t.learnings).select("total", "active")
    b = t.labels.agg(F.count("*").alias("votes"))
    c = t.events.where("event_type = 'purchase'").agg(F.count_distinct("user_id").alias("sessions"))
    return a.crossJoin(b).crossJoin(c).withColumn("learnings_per_extraction", F.round(F.try_divide("total", "sessions"), 2))


@query("AGG15_top_helpful", """SELECT d.source AS project, count(*) FILTER (quality = 1) AS helpful FROM labels JOIN documents d USING (doc_id) GROUP BY 1 ORDER BY helpful DESC, project LIMIT 5""")
def top_helpful(t):
    joined = t.labels.join(t.documents.select("doc_id", F.col("source").alias("project")), "doc_id")
    return joined.groupBy("project").agg(F.count_if(F.col("quality") == 1).alias("helpful")).orderBy(F.desc("helpful"), "project").limit(5)


@query("AGG16_pattern_strength", LEARNINGS + """SELECT project, coalesce(array_to_string(list_sort(list(DISTINCT confidence) FILTER (confidence IS NOT NULL)), ','), '') AS tags,
max(recall_count * greatest(1 - coalesce(CAST(id % 10 AS DOUBLE) / 5, 0), 0)) AS strength FROM learnings GROUP BY 1""")
def strength(t):
    distance = F.coalesce(F.col("id") % 10 / F.lit(5.0), F.lit(0.0))
    return t.learnings.groupBy("project").agg(F.array_join(F.array_sort(F.collect_set("confidence")), ",").alias("tags"), F.max(F.col("recall_count") * F.greatest(1 - distance, F.lit(0.0))).alias("strength"))


@query("AGG17_distinct_objects", """SELECT lang, array_to_string(list_sort(list(DISTINCT source || ':' || CAST(n_chars // 1000 AS VARCHAR))), ',') AS objects FROM documents GROUP BY 1""")
def objects(t):
    pair = F.struct("source", F.expr("n_chars div 1000").alias("size"))
    shown = F.array_join(F.array_sort(F.transform(F.collect_set(pair), lambda s: F.concat_ws(":", s["source"], s["size"]))), ",")
    return t.documents.groupBy("lang").agg(shown.alias("objects"))


@query("AGG23_tool_usage", """SELECT event_type AS tool, count(*) AS calls, count(DISTINCT json_extract(props, '$.k')) AS files, count(DISTINCT user_id) AS sessions FROM events GROUP BY 1""")
def tool_usage(t):
    return t.events.groupBy(F.col("event_type").alias("tool")).agg(F.count("*").alias("calls"), F.count_distinct(F.get_json_object("props", "$.k")).alias("files"), F.count_distinct("user_id").alias("sessions"))


@query("AGG24_handoff", """WITH e AS (SELECT user_id, event_id, ts, event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events)
SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS calls, array_to_string(list_sort(list(DISTINCT k) FILTER (event_type = 'view')), ',') AS files_read,
arg_max(k, event_id) FILTER (event_type = 'purchase') AS last_k, count(*) FILTER (back <= 50) AS kept,
array_to_string(list(event_type ORDER BY ts DESC, event_id DESC) FILTER (back <= 3), ',') AS latest FROM e GROUP BY 1""")
def handoff(t):
    from pyspark.sql import Window

    k = F.get_json_object("props", "$.k").cast("int")
    e = t.events.withColumn("k", k).withColumn("back", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))))
    recent = F.array_sort(F.collect_list(F.when(F.col("back") <= 3, F.struct("back", "event_type"))))
    return e.groupBy("user_id").agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("calls"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("event_type") == "view", F.col("k")))), ",").alias("files_read"),
        F.max_by(F.when(F.col("event_type") == "purchase", F.col("k")), F.when(F.col("event_type") == "purchase", F.col("event_id"))).alias("last_k"),
        F.count_if(F.col("back") <= 50).alias("kept"), F.array_join(F.transform(recent, lambda s: s["event_type"]), ",").alias("latest"),
    )


@query("AGG25_golden_votes", """WITH v AS (SELECT d.source, d.lang, count(*) FILTER (quality = 1) AS yes, count(*) FILTER (quality = 0) AS no FROM labels JOIN documents d USING (doc_id) GROUP BY 1, 2)
SELECT source, lang, yes, no, yes > no AS verdict FROM v WHERE yes <> no AND yes + no >= 3""")
def golden(t):
    feedback = t.labels.select("doc_id", (F.col("quality") == 1).alias("helpful")).join(t.documents.select("doc_id", "source", "lang"), "doc_id")
    return m.votes(feedback, ["source", "lang"], 3)


@query("AGG26_daily_traces", """SELECT strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT user_id) AS sessions, round(sum(value), 2) AS tokens, count(*) AS spans FROM events GROUP BY 1""")
def daily(t):
    return t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count_distinct("user_id").alias("sessions"), F.round(F.sum("value"), 2).alias("tokens"), F.count("*").alias("spans"))


@query("AGG26_loops", "SELECT user_id, event_type, count(*) AS calls FROM events GROUP BY 1, 2 HAVING count(*) > 15")
def loops(t):
    return m.loops(t.events, "user_id", "event_type", 15)


@query("AGG27_misscope", """WITH r AS (SELECT l_orderkey AS log_id, any_value(o.o_orderpriority) AS caller, list(p.p_brand) AS brands FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN part p ON p.p_partkey = l.l_partkey GROUP BY 1),
x AS (SELECT caller, unnest(brands) AS brand FROM r)
SELECT caller, count(*) AS recalled, count(*) FILTER (brand <> 'Brand#11') AS elsewhere, round(100.0 * CAST(count(*) FILTER (brand <> 'Brand#11') AS DOUBLE) / count(*), 2) AS pct FROM x GROUP BY 1""")
def misscope(t):
    items = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    log = items.groupBy("l_orderkey").agg(F.first("o_orderpriority").alias("caller"), F.collect_list("p_brand").alias("brands"))
    each = log.select("caller", F.explode("brands").alias("brand"))
    other = F.count_if(F.col("brand") != "Brand#11")
    return each.groupBy("caller").agg(F.count("*").alias("recalled"), other.alias("elsewhere"), F.round(100.0 * other / F.count("*"), 2).alias("pct"))


@query("AGG28_run_metadata", """WITH r AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS run, min(o_orderkey) AS first, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) SELECT * FROM r ORDER BY run DESC LIMIT 1""")
def run_metadata(t):
    runs = t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("run")).agg(F.min("o_orderkey").alias("first"), F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return runs.orderBy(F.desc("run")).limit(1)


@query("AGG29_context_totals", LEARNINGS + "SELECT count(*) AS learnings, count(DISTINCT project) AS sessions, count(*) FILTER (type = 'en') AS of_type FROM learnings WHERE superseded_by IS NULL AND archived_at IS NULL")
def context_totals(t):
    return m.active(t.learnings).agg(F.count("*").alias("learnings"), F.count_distinct("project").alias("sessions"), F.count_if(F.col("type") == "en").alias("of_type"))


@query("AGG30_confusion", """WITH c AS (SELECT quality AS e, toxic AS p, count(*) AS n FROM labels GROUP BY 1, 2), k AS (SELECT DISTINCT e AS class FROM c UNION SELECT DISTINCT p FROM c)
SELECT class, coalesce((SELECT CAST(sum(n) AS BIGINT) FROM c WHERE e = class), 0) AS support, coalesce((SELECT CAST(sum(n) AS BIGINT) FROM c WHERE p = class), 0) AS predicted, coalesce((SELECT CAST(sum(n) AS BIGINT) FROM c WHERE e = class AND p = class), 0) AS hits,
coalesce(round((SELECT CAST(sum(n) AS DOUBLE) FROM c WHERE e = class AND p = class) / (SELECT sum(n) FROM c WHERE p = class), 3), 0.0) AS "precision",
coalesce(round((SELECT CAST(sum(n) AS DOUBLE) FROM c WHERE e = class AND p = class) / (SELECT sum(n) FROM c WHERE e = class), 3), 0.0) AS recall FROM k""")
def confusion(t):
    return m.confusion(t.labels, "quality", "toxic")


@query("PRJ4_stale_buckets", LEARNINGS + f"""SELECT CASE WHEN recall_count = 0 AND created_at < {T} - INTERVAL 60 DAY THEN 'never recalled, over 60 days' WHEN recall_count = 0 AND created_at < {T} - INTERVAL 30 DAY THEN 'never recalled, 30 to 60 days'
WHEN recall_count = 0 THEN 'never recalled, new' WHEN last_recalled < {T} - INTERVAL 45 DAY THEN 'recalled, long ago' ELSE 'recalled' END AS bucket, count(*) AS n FROM learnings WHERE superseded_by IS NULL AND archived_at IS NULL GROUP BY 1""")
def stale_buckets(t):
    return m.stale_buckets(t.learnings, AS_OF)
