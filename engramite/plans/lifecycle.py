"""Store, curation, lookup and document queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from engramite.functions import text as tx
from engramite.operators import lifecycle as lc
from engramite.operators import metrics as m
from engramite.operators import scans
from engramite.operators import secrets as se
from engramite.plans.registry import AS_OF, LEARNINGS, query, sql_replaced
from engramite.sources import files

T = f"TIMESTAMP '{AS_OF}'"


@query("FLT1_active", LEARNINGS + "SELECT id, project FROM learnings WHERE superseded_by IS NULL AND archived_at IS NULL")
def active(t):
    return m.active(t.learnings).select("id", "project")


@query("FLT2_null_safe", LEARNINGS + "SELECT id, confidence FROM learnings WHERE confidence IS NOT DISTINCT FROM NULL OR type IS DISTINCT FROM 'en'")
def null_safe(t):
    return t.learnings.where(F.col("confidence").eqNullSafe(F.lit(None)) | ~F.col("type").eqNullSafe("en")).select("id", "confidence")


@query("FLT4_date_range", LEARNINGS + "SELECT id, created_at FROM learnings WHERE created_at >= TIMESTAMP '2024-01-10' AND created_at <= TIMESTAMP '2024-01-12 23:59:59.999999'")
def date_range(t):
    return t.learnings.where("created_at >= timestamp_ntz'2024-01-10 00:00:00' and created_at <= timestamp_ntz'2024-01-12 23:59:59.999999'").select("id", "created_at")


@query("FLT6_json_key", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS INTEGER) >= 50 AND json_exists(props, '$.k')")
def json_key(t):
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.where((k >= 50) & F.array_contains(F.json_object_keys("props"), "k")).select("event_id", k.alias("k"))


@query("FLT11_tag_overlap", "SELECT doc_id FROM documents WHERE list_has_any([source, lang], ['src1', 'de'])")
def tag_overlap(t):
    return t.documents.where(F.arrays_overlap(F.array("source", "lang"), F.array(F.lit("src1"), F.lit("de")))).select("doc_id")


@query("FLT13_scope_gate", "SELECT page_id, 'restricted' AS scope FROM pages WHERE page_id % 3 = 0 AND page_id % 2 = 1")
def scope_gate(t):
    chunks = t.pages.select("page_id", F.when(F.col("page_id") % 3 == 0, "secret").otherwise("docs").alias("collection"), F.when(F.col("page_id") % 2 == 0, "global").otherwise("restricted").alias("scope"))
    return lc.scope_gate(chunks, "secret").where("scope = 'restricted'").select("page_id", "scope")


@query("FLT15_row_validation", "SELECT count(*) AS rows, count(*) FILTER (len(embedding) = 64 AND label IS NOT NULL) AS valid, count(*) FILTER (len(embedding) <> 64 OR label IS NULL) AS rejected FROM embeddings")
def validation(t):
    good = (F.size("embedding") == 64) & F.col("label").isNotNull()
    return t.embeddings.agg(F.count("*").alias("rows"), F.count_if(good).alias("valid"), F.count_if(~good).alias("rejected"))


@query("PRJ1_overlay", LEARNINGS + "SELECT id, coalesce(confidence, type) AS value FROM learnings")
def overlay(t):
    return t.learnings.select("id", F.coalesce("confidence", "type").alias("value"))


@query("PRJ3_preview", r"SELECT doc_id, CASE WHEN length(f) > 60 THEN f[1:60] || '...' ELSE f END AS preview FROM (SELECT doc_id, regexp_replace(text, '\s+', ' ', 'g') AS f FROM documents)")
def preview(t):
    return t.texts.select("doc_id", tx.preview(F.col("text"), 60).alias("preview"))


@query("PRJ5_age", "SELECT event_id, CASE WHEN s >= 86400 THEN CAST(s // 86400 AS BIGINT) || 'd ago' WHEN s >= 3600 THEN CAST(s // 3600 AS BIGINT) || 'h ago' WHEN s >= 60 THEN CAST(s // 60 AS BIGINT) || 'm ago' ELSE 'just now' END AS age FROM (SELECT event_id, date_diff('microsecond', ts, TIMESTAMP '2024-02-01') // 1000000 AS s FROM events)")
def age(t):
    return t.events.select("event_id", tx.age(F.expr("timestampdiff(SECOND, ts, timestamp_ntz'2024-02-01 00:00:00')")).alias("age"))


@query("PRJ6_pair_order", "SELECT least(l_partkey, l_suppkey) AS lo, greatest(l_partkey, l_suppkey) AS hi, count(*) AS n FROM lineitem GROUP BY 1, 2")
def pair_order(t):
    return t.lineitem.groupBy(F.least("l_partkey", "l_suppkey").alias("lo"), F.greatest("l_partkey", "l_suppkey").alias("hi")).agg(F.count("*").alias("n"))


@query("SNK1_insert_if_absent", "WITH n AS (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS r FROM documents WHERE doc_id % 2 = 1) SELECT doc_id FROM n WHERE r = 1 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def insert_if_absent(t):
    docs = t.documents.select("doc_id", F.sha2("text", 256).alias("hash"))
    return lc.insert_if_absent(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "hash", F.col("doc_id")).select("doc_id")


@query("SNK2_upsert", "SELECT user_id, event_type, arg_max(event_id, {'t': ts, 'e': event_id}) AS event_id FROM events GROUP BY 1, 2")
def upsert(t):
    rows = m.latest(t.events.select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], F.desc("ts"), F.desc("event_id"))
    early, late = rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1")
    return lc.upsert(early, late, ["user_id", "event_type"], "ts").select("user_id", "event_type", "event_id")


@query("SNK3_entity_rollup", "SELECT source, lang, min(doc_id) AS first_seen, max(doc_id) AS last_seen, count(DISTINCT doc_id) AS mentions FROM documents GROUP BY 1, 2")
def entity_rollup(t):
    return t.documents.groupBy("source", "lang").agg(F.min("doc_id").alias("first_seen"), F.max("doc_id").alias("last_seen"), F.count_distinct("doc_id").alias("mentions"))


@query("SNK4_replace_children", "SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 5 = 0 THEN 'new' ELSE 'old' END AS version FROM lineitem WHERE l_orderkey % 5 <> 0 OR l_linenumber <= 2")
def replace_children(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.lit("old").alias("version"))
    every = t.lineitem.where("l_orderkey % 5 = 0").select("l_orderkey").distinct()
    fresh = t.lineitem.where("l_orderkey % 5 = 0 and l_linenumber <= 2").select("l_orderkey", "l_linenumber", F.lit("new").alias("version"))
    return lc.replace_children(rows.join(every, "l_orderkey", "left_anti"), fresh, "l_orderkey")


@query("SNK5_reconcile", "SELECT page_id FROM pages WHERE page_id IN (SELECT doc_id FROM documents WHERE doc_id % 4 <> 0)")
def reconcile(t):
    return lc.reconcile(t.pages.select("page_id"), t.documents.where("doc_id % 4 <> 0").select(F.col("doc_id").alias("page_id")), "page_id")


@query("SNK8_supersede", LEARNINGS + """, g AS (SELECT project, type, min(id) AS keeper FROM learnings WHERE superseded_by IS NULL AND archived_at IS NULL GROUP BY 1, 2)
SELECT l.id, CASE WHEN l.superseded_by IS NULL AND g.keeper IS NOT NULL AND l.id % 10 = 0 AND g.keeper <> l.id THEN g.keeper ELSE l.superseded_by END AS superseded_by FROM learnings l LEFT JOIN g ON g.project = l.project AND g.type = l.type""")
def supersede(t):
    rows = t.learnings
    heads = m.active(rows).groupBy("project", "type").agg(F.min("id").alias("keeper"))
    plan = rows.join(heads, ["project", "type"]).where("id % 10 = 0 and id <> keeper").select(F.col("id").alias("loser"), "keeper")
    return lc.supersede(rows, plan, "id", AS_OF).select("id", "superseded_by")


@query("SNK10_recall_counters", "WITH log AS (SELECT user_id, CAST(ts AS DATE) AS day, max(ts) AS ended, list(CAST(json_extract(props, '$.k') AS INTEGER)) AS ids FROM events GROUP BY 1, 2), x AS (SELECT unnest(ids) AS id, ended FROM log) SELECT id, count(*) AS recall_count, max(ended) AS last_recalled FROM x GROUP BY 1")
def recall_counters(t):
    log = t.events.groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.max("ts").alias("at"), F.collect_list(F.get_json_object("props", "$.k").cast("int")).alias("ids"))
    return lc.recall_counters(log, "ids", "at")


@query("SNK12_prune", "SELECT least(count(*), 50 * 40) AS deleted, count(*) <= 50 * 40 AS complete FROM events WHERE ts < TIMESTAMP '2024-01-31' - INTERVAL 20 DAY")
def prune(t):
    return lc.prune(t.events, "ts", "2024-01-31 00:00:00", 20, 50, 40)


@query("SNK13_union_capped", "WITH u AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS a FROM events GROUP BY 1), d AS (SELECT user_id, list_distinct_ordered(a) AS a FROM (SELECT user_id, list_filter(a, lambda x, i: list_position(a, x) = i) AS a FROM u)) SELECT user_id, array_to_string(CASE WHEN len(a) > 3 THEN a[-3:] ELSE a END, ',') AS kept FROM d".replace("list_distinct_ordered(a)", "a"))
def union_capped(t):
    ordered = t.events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("a"))
    names = F.transform("a", lambda e: e["event_type"])
    half = F.floor(F.size(names) / 2).cast("int")
    capped = lc.union_capped(F.slice(names, F.lit(1), half), F.slice(names, half + 1, F.size(names)), 3)
    return ordered.select("user_id", F.array_join(capped, ",").alias("kept"))


@query("SNK16_grouped_by_type", "SELECT lang, count(*) AS n, array_to_string(list(doc_id ORDER BY n_chars DESC, doc_id)[1:5], ',') AS ids FROM documents GROUP BY 1")
def grouped(t):
    by = Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")
    rows = t.documents.select("lang", "doc_id", F.row_number().over(by).alias("r"))
    first = F.array_sort(F.collect_list(F.when(F.col("r") <= 5, F.struct("r", "doc_id"))))
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.array_join(F.transform(first, lambda s: s["doc_id"]), ",").alias("ids"))


@query("SRT1_priority_sort", LEARNINGS + "SELECT id, confidence FROM learnings WHERE superseded_by IS NULL AND recall_count = 0 ORDER BY CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, created_at DESC, id LIMIT 30")
def priority_sort(t):
    first = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).otherwise(2)
    return m.active(t.learnings, archived=False).where("recall_count = 0").orderBy(first, F.desc("created_at"), "id").limit(30).select("id", "confidence")


@query("SRT5_keeper", LEARNINGS + """, a AS (SELECT * FROM learnings WHERE superseded_by IS NULL AND archived_at IS NULL), k AS (SELECT project, type, arg_min(id, {'r': -recall_count, 'c': created_at, 'i': id}) AS keeper, count(*) AS n FROM a GROUP BY 1, 2)
SELECT a.id AS loser, k.keeper FROM a JOIN k ON a.project = k.project AND a.type = k.type WHERE n > 1 AND a.id <> k.keeper""")
def keeper(t):
    return lc.keeper(t.learnings, ["project", "type"])


@query("CUR1_promotions", LEARNINGS + "SELECT id, CASE type WHEN 'en' THEN 'rules' ELSE 'notes' END AS destination FROM learnings WHERE superseded_by IS NULL AND archived_at IS NULL AND recall_count >= 10 AND type IN ('en', 'fr')")
def promotions(t):
    return lc.promotions(t.learnings, {"en": "rules", "fr": "notes"}, 10).select("id", "destination")


@query("CUR2_to_archive", LEARNINGS + f"SELECT id FROM learnings WHERE superseded_by IS NULL AND archived_at IS NULL AND recall_count = 0 AND created_at < {T} - INTERVAL 45 DAY AND coalesce(confidence, 'low') = 'low'")
def to_archive(t):
    return m.active(t.learnings).where((F.col("recall_count") == 0) & (F.col("created_at") < m.days_before(AS_OF, 45)) & (F.coalesce("confidence", F.lit("low")) == "low")).select("id")


@query("CUR4_push_candidates", LEARNINGS + """, p AS (SELECT id, row_number() OVER (ORDER BY recall_count DESC, id) AS rank FROM learnings WHERE recall_count > 0 AND superseded_by IS NULL AND archived_at IS NULL ORDER BY rank LIMIT 10),
s AS (SELECT id, row_number() OVER (ORDER BY created_at DESC, id) AS rank FROM learnings WHERE superseded_by IS NULL AND archived_at IS NULL AND recall_count = 0 AND confidence IN ('high', 'medium') ORDER BY rank LIMIT 20)
SELECT * FROM (SELECT id, 0 AS tier, rank FROM p UNION ALL SELECT id, 1, rank FROM s) ORDER BY tier, rank, id LIMIT 15""")
def push(t):
    rows = m.active(t.learnings)
    top = lambda df, order, n: df.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    p = top(rows.where("recall_count > 0"), [F.desc("recall_count"), F.col("id")], 10)
    s = top(rows.where("recall_count = 0 and confidence in ('high', 'medium')"), [F.desc("created_at"), F.col("id")], 20)
    return lc.push_candidates(p, s, "id", 15)


@query("CUR6_ingest_actions", """WITH o AS (SELECT page_id, length(html) AS size, sha256(html) AS hash, page_id % 11 <> 0 AS supported, length(html) // 100 AS chunks FROM pages WHERE page_id % 5 <> 0), s AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'old' ELSE sha256(html) END AS stored_hash, CASE WHEN page_id % 13 = 0 THEN 'error' ELSE 'ok' END AS stored_status FROM pages WHERE page_id % 4 <> 0)
SELECT coalesce(o.page_id, s.page_id) AS page_id, CASE WHEN size IS NULL THEN 'delete' WHEN size > 9000 THEN CASE WHEN stored_hash IS NOT NULL THEN 'delete' ELSE 'skip_too_large' END WHEN coalesce(hash = stored_hash AND stored_status <> 'error', false) THEN 'unchanged' WHEN NOT supported THEN 'unsupported' WHEN chunks > 60 THEN 'error' WHEN stored_hash IS NULL THEN 'insert' ELSE 'update' END AS action FROM o FULL JOIN s ON o.page_id = s.page_id""")
def ingest(t):
    pages = t.pages
    observed = pages.where("page_id % 5 <> 0").select("page_id", F.length("html").alias("size"), F.sha2("html", 256).alias("hash"), (F.col("page_id") % 11 != 0).alias("supported"), F.expr("length(html) div 100").alias("chunks"))
    stored = pages.where("page_id % 4 <> 0").select("page_id", F.when(F.col("page_id") % 3 == 0, "old").otherwise(F.sha2("html", 256)).alias("stored_hash"), F.when(F.col("page_id") % 13 == 0, "error").otherwise("ok").alias("stored_status"))
    return lc.ingest_actions(observed, stored, "page_id", 9000, 60)


@query("SRC11_html_text", r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g')) AS text FROM pages""")
def html_text(t):
    return t.pages.select("page_id", tx.plain_html(F.col("html")).alias("text"))


PATHS = "concat(list_extract(['/a/thoughts/shared/handoffs/', '/a/plans/', '/b/handoffs/old.d/', '/x/', '/y/CONTINUITY_CLAUDE-'], CAST(page_id % 5 + 1 AS INTEGER)), CAST(page_id AS VARCHAR), list_extract(['.md', '.yaml', '.yml', '.txt'], CAST(page_id % 4 + 1 AS INTEGER)))"


@query("SRC14_classify_path", f"SELECT page_id, CASE WHEN contains(p, 'handoffs') AND regexp_matches(p, '\\.ya?ml$') THEN 'handoff_yaml' WHEN contains(p, 'handoffs') AND p LIKE '%.md' THEN 'handoff' WHEN contains(p, 'plans') AND p LIKE '%.md' THEN 'plan' WHEN regexp_matches(p, '/CONTINUITY_CLAUDE-[^/]*$') THEN 'continuity' END AS kind FROM (SELECT page_id, {PATHS} AS p FROM pages)")
def classify(t):
    folder = F.element_at(F.array(*map(F.lit, ("/a/thoughts/shared/handoffs/", "/a/plans/", "/b/handoffs/old.d/", "/x/", "/y/CONTINUITY_CLAUDE-"))), (F.col("page_id") % 5 + 1).cast("int"))
    ending = F.element_at(F.array(*map(F.lit, (".md", ".yaml", ".yml", ".txt"))), (F.col("page_id") % 4 + 1).cast("int"))
    return t.pages.select("page_id", files.kind_of(F.concat(folder, F.col("page_id").cast("string"), ending)).alias("kind"))


@query("TXT17_chunks", r"""WITH s AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM documents), c AS (SELECT doc_id, s, unnest(range(0, CAST(greatest(ceil((length(s) - 200) / 1000.0) - 1, 0) AS BIGINT) + 1)) AS i FROM s WHERE length(s) > 0) SELECT doc_id, i AS chunk_index, length(s[i * 1000 + 1 : i * 1000 + 1200]) AS n, sha256(s[i * 1000 + 1 : i * 1000 + 1200]) AS hash FROM c""")
def chunks(t):
    each = t.texts.select("doc_id", F.posexplode(tx.chunks(F.col("text"))).alias("i", "c"))
    return each.select("doc_id", F.col("i").cast("long").alias("chunk_index"), F.length("c").cast("long").alias("n"), F.sha2("c", 256).alias("hash"))


@query("TXT18_slug", "SELECT doc_id, CASE WHEN s = '' THEN 'untitled' ELSE s END AS slug FROM (SELECT doc_id, regexp_replace((regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'))[1:40], '-+$', '', 'g') AS s FROM documents)")
def slug(t):
    return t.texts.select("doc_id", tx.slug(F.col("text")).alias("slug"))


@query("TXT19_project", "SELECT DISTINCT source, CASE WHEN lower(source) = 'src0' THEN 'main' ELSE lower(source) END AS project FROM documents")
def project(t):
    return t.documents.select("source").distinct().select("source", tx.canonical_project(F.concat(F.lit(" -users-ann-"), "source", F.lit("/ ")), {"src0": "main"}).alias("project"))


@query("TXT20_content_hash", r"SELECT doc_id, sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS hash FROM documents")
def content_hash(t):
    return t.texts.select("doc_id", tx.content_hash(F.col("text")).alias("hash"))


@query("TXT21_tags", "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(source || ', ' || lang || ' ,,', ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS tags FROM documents")
def tags(t):
    return t.documents.select("doc_id", F.array_join(tx.tags(F.concat("source", F.lit(", "), "lang", F.lit(" ,,"))), "|").alias("tags"))


def _dimension(patterns) -> str:
    return "least(1.0, " + " + ".join(f"CASE WHEN regexp_matches(lower(text), '{p.replace(chr(39), chr(39) * 2)}') THEN CAST({w} AS DOUBLE) ELSE 0 END" for p, w in patterns) + ")"


@query("TXT16_confidence", f"""WITH d AS (SELECT doc_id, {_dimension(tx.SPECIFIC)} AS s, {_dimension(tx.ACTIONABLE)} AS a, {_dimension(tx.EVIDENT)} AS e, {_dimension(tx.VAGUE)} AS v, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS n FROM documents),
c AS (SELECT doc_id, CAST(0.30 AS DOUBLE) * s + CAST(0.25 AS DOUBLE) * a + CAST(0.25 AS DOUBLE) * e + CAST(0.20 AS DOUBLE) * greatest(least(CAST(0.7 AS DOUBLE) - v + CASE WHEN n < 50 THEN CAST(0.1 AS DOUBLE) WHEN n > 200 THEN CAST(-0.1 AS DOUBLE) ELSE 0 END, 1.0), 0.0) AS x FROM d)
SELECT CASE WHEN x >= 0.30 THEN 'high' WHEN x >= 0.20 THEN 'medium' ELSE 'low' END AS level, count(*) AS n FROM c GROUP BY 1""")
def confidence(t):
    return t.texts.select(tx.confidence(F.col("text")).alias("level")).groupBy("level").agg(F.count("*").alias("n"))




@query("RED1_rules")
def secret_rules(t):
    return se.findings(t.texts, "doc_id", "text")


@query("RED9_rules")
def rule_audit(t):
    return se.audit(se.findings(t.texts, "doc_id", "text"), "doc_id")


@query("RED3_entropy", "WITH u AS (SELECT user_id, string_agg(event_type, '' ORDER BY ts, event_id) AS s FROM events GROUP BY 1), c AS (SELECT user_id, unnest(string_split(s, '')) AS ch, length(s) AS n FROM u), g AS (SELECT user_id, ch, count(*) / CAST(any_value(n) AS DOUBLE) AS p FROM c GROUP BY 1, 2) SELECT user_id, round(-sum(p * log2(p)), 6) AS bits FROM g GROUP BY 1")
def entropy(t):
    """Of each user's whole history; the order of the events does not matter, so no history is gathered."""
    names = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    chars = names.select("user_id", "n", F.explode(F.split("event_type", "")).alias("ch")).where("ch <> ''").groupBy("user_id", "ch").agg(F.sum("n").alias("n"))
    total = F.sum("n")
    return chars.groupBy("user_id").agg(F.round(F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total, 6).alias("bits"))


@query("RED4_mask", "SELECT DISTINCT c_name, CASE WHEN length(c_name) <= 8 THEN '****' ELSE c_name[1:4] || '****' || right(c_name, 4) END AS masked FROM customer")
def mask(t):
    return t.customer.select("c_name", tx.mask(F.col("c_name")).alias("masked")).distinct()


@query("RED6_redact", "SELECT doc_id, sha256(" + sql_replaced("text", tx.SECRET_RULES) + ") AS hash FROM documents")
def redact(t):
    return t.texts.select("doc_id", F.sha2(tx.replaced(F.col("text"), tx.SECRET_RULES), 256).alias("hash"))


SECRET_LINES = "concat('export ', CASE o_orderkey % 3 WHEN 0 THEN 'GH_TOKEN=' WHEN 1 THEN 'monkey=' ELSE 'MY_DB_PASSWORD=' END, md5(CAST(o_orderkey AS VARCHAR)), ' Bearer ', md5(CAST(o_custkey AS VARCHAR)), ' postgres://ann:', md5(CAST(o_orderkey AS VARCHAR)), '@host --token=''a b'' --key x --secret -v sk-', md5(CAST(o_custkey AS VARCHAR)), ' task-', o_orderstatus, ' ghp_', md5(CAST(o_orderkey AS VARCHAR)))"


def secret_lines(t):
    one, two = F.md5(F.col("o_orderkey").cast("string")), F.md5(F.col("o_custkey").cast("string"))
    name = F.when(F.col("o_orderkey") % 3 == 0, "GH_TOKEN=").when(F.col("o_orderkey") % 3 == 1, "monkey=").otherwise("MY_DB_PASSWORD=")
    line = F.concat(F.lit("export "), name, one, F.lit(" Bearer "), two, F.lit(" postgres://ann:"), one, F.lit("@host --token='a b' --key x --secret -v sk-"), two, F.lit(" task-"), "o_orderstatus", F.lit(" ghp_"), one)
    return t.orders.select("o_orderkey", line.alias("line"))


@query("RED5_commands", f"SELECT o_orderkey, {sql_replaced(SECRET_LINES, tx.COMMAND_RULES)} AS line FROM orders")
def redact_commands(t):
    return secret_lines(t).select("o_orderkey", tx.replaced(F.col("line"), tx.COMMAND_RULES).alias("line"))


@query("RED6_secret_lines", f"SELECT o_orderkey, {sql_replaced(SECRET_LINES, tx.SECRET_RULES)} AS line FROM orders")
def redact_lines(t):
    return secret_lines(t).select("o_orderkey", tx.replaced(F.col("line"), tx.SECRET_RULES).alias("line"))


VALUE_LINES = "concat('duplicate key \"orders_pk\" LINE 1: INSERT VALUES (', chr(39), o_orderstatus, chr(39), ', ', chr(39), CAST(o_custkey AS VARCHAR), chr(39), ')', chr(10), 'DETAIL: Key (o_orderkey)=(', CAST(o_orderkey AS VARCHAR), ' (x)) already exists.')"


@query("RED7_database_values", f"SELECT o_orderkey, {sql_replaced(VALUE_LINES, tx.VALUE_RULES)} AS line FROM orders")
def database_values(t):
    line = F.concat(F.lit('duplicate key "orders_pk" LINE 1: INSERT VALUES (\''), "o_orderstatus", F.lit("', '"), F.col("o_custkey").cast("string"), F.lit("')\nDETAIL: Key (o_orderkey)=("), F.col("o_orderkey").cast("string"), F.lit(" (x)) already exists."))
    return t.orders.select("o_orderkey", tx.replaced(line, tx.VALUE_RULES).alias("line"))


CODE = "unicode(substr(h, i, 1))"


@query("RED8_log_field", f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN text || chr(128512) || chr(155) || chr(10) ELSE right(text, 300) || chr(128512) || chr(155) END AS t FROM documents), s AS (SELECT doc_id, t, substr(t, 1, 500) AS h FROM d)
SELECT doc_id, sha256(coalesce(coalesce(array_to_string(list_transform(range(1, length(h) + 1), lambda i: CASE WHEN {CODE} = 9 OR {CODE} BETWEEN 32 AND 126 THEN substr(h, i, 1) WHEN {CODE} <= 255 THEN '\\x' || lpad(lower(to_hex({CODE})), 2, '0') WHEN {CODE} <= 65535 THEN '\\u' || lpad(lower(to_hex({CODE})), 4, '0') ELSE '\\U' || lpad(lower(to_hex({CODE})), 8, '0') END), ''), '')
|| CASE WHEN length(t) > 500 THEN '...[truncated ' || CAST(length(t) - 500 AS VARCHAR) || ' characters]' WHEN t IS NULL THEN NULL ELSE '' END, '<none>')) AS hash FROM s""")
def log_fields(t):
    text = F.when(F.col("doc_id") % 11 == 0, None).when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("\U0001f600\x9b\n"))).otherwise(F.concat(F.right("text", F.lit(300)), F.lit("\U0001f600\x9b")))
    return t.texts.select("doc_id", F.sha2(tx.log_field(text), 256).alias("hash"))


@query("LKP1_latest", "SELECT o_custkey, arg_max(o_orderkey, {'d': o_orderdate, 'p': o_totalprice, 'k': o_orderkey}) AS o_orderkey FROM orders GROUP BY 1")
def latest(t):
    return m.latest(t.orders, ["o_custkey"], F.desc("o_orderdate"), F.desc("o_totalprice"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey")


@query("LKP3_session_tags", "SELECT DISTINCT source, lang AS tag FROM documents WHERE lang <> 'es'")
def session_tags(t):
    return t.documents.select("source", F.col("lang").alias("tag")).where("tag <> 'es'").distinct()


@query("LKP6_delete_cascade", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def cascade(t):
    gone = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return t.lineitem.join(gone, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber")


@query("LKP7_feedback", "SELECT source, count(*) AS n, round(CAST(count(*) FILTER (quality = 1) AS DOUBLE) / count(*), 4) AS rate, array_to_string(list(doc_id ORDER BY doc_id)[1:10], ',') AS ids FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def feedback(t):
    """Counts of every group, and its first ten: ranked first, so that no group is gathered."""
    joined = t.labels.join(t.documents.select("doc_id", "source"), "doc_id")
    counts = joined.groupBy("source").agg(F.count("*").alias("n"), F.round(F.count_if(F.col("quality") == 1) / F.count("*"), 4).alias("rate"))
    first = scans.top_per_key(joined.select("source", "doc_id"), "source", [F.col("doc_id")], 10).groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("doc_id")), ",").alias("ids"))
    return counts.join(first, "source")


@query("LKP10_reembed_progress", "SELECT CASE WHEN e.vec_id IS NULL THEN 'missing' WHEN label < 5 THEN 'pending' ELSE 'done' END AS state, count(*) AS n FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY 1")
def reembed(t):
    joined = t.documents.select("doc_id").join(t.embeddings.select("vec_id", "label"), F.col("doc_id") == F.col("vec_id"), "left")
    return joined.groupBy(F.when(F.col("vec_id").isNull(), "missing").when(F.col("label") < 5, "pending").otherwise("done").alias("state")).agg(F.count("*").alias("n"))


@query("LKP12_project_inference", "SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN source END, CASE WHEN doc_id % 3 = 1 THEN 'p' || lang END, 'unresolved') AS project FROM documents")
def inference(t):
    return t.documents.select("doc_id", F.coalesce(F.when(F.col("doc_id") % 3 == 0, F.col("source")), F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("p"), "lang")), F.lit("unresolved")).alias("project"))


@query("LKP13_importance_sample", """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS b FROM events), g AS (SELECT *, n <= 10 OR b <= 20 AS edge, CASE event_type WHEN 'error' THEN 100 WHEN 'click' THEN 80 ELSE 10 END AS score, length(event_type) AS size FROM e),
u AS (SELECT *, sum(size) OVER (PARTITION BY user_id, edge ORDER BY score DESC, event_id ROWS UNBOUNDED PRECEDING) AS used FROM g) SELECT user_id, event_id FROM u WHERE edge OR used <= 60""")
def importance(t):
    score = F.when(F.col("event_type") == "error", 100).when(F.col("event_type") == "click", 80).otherwise(10)
    return lc.importance_sample(t.events, "user_id", "event_id", 10, 20, score, F.length("event_type"), 60).select("user_id", "event_id")


@query("LKP14_apply_selection", "SELECT doc_id, CAST(list_position([42, 7, 999999, 13, 5], doc_id) - 1 AS INTEGER) AS position FROM documents WHERE doc_id IN (42, 7, 13, 5) ORDER BY position LIMIT 3")
def selection(t):
    return lc.apply_selection(t.documents.select("doc_id"), [42, 7, 999999, 13, 5], "doc_id", 3)


@query("JOI4_explode_outer", LEARNINGS + ", a AS (SELECT id, CASE WHEN confidence IS NULL THEN [] ELSE [confidence, type] END AS tags FROM learnings) SELECT id, t.tag FROM a LEFT JOIN LATERAL (SELECT unnest(tags) AS tag) t ON true")
def explode_outer(t):
    tags = F.when(F.col("confidence").isNull(), F.array().cast("array<string>")).otherwise(F.array("confidence", "type"))
    return t.learnings.select("id", F.explode_outer(tags).alias("tag"))


@query("JOI7_members", "SELECT r_name, count(DISTINCT n_nationkey) AS nations, count(c_custkey) AS customers, round(coalesce(sum(c_acctbal), 0), 2) AS balance FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def members(t):
    per = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.sum("c_acctbal").alias("balance"))
    joined = t.region.join(t.nation, F.col("n_regionkey") == F.col("r_regionkey"), "left").join(per, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.groupBy("r_name").agg(F.count("n_nationkey").alias("nations"), F.coalesce(F.sum("customers"), F.lit(0)).alias("customers"), F.round(F.coalesce(F.sum("balance"), F.lit(0.0)), 2).alias("balance"))


@query("JOI10_all_tags", "SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 2")
def all_tags(t):
    wanted = t.lineitem.where(F.col("l_returnflag").isin("A", "N")).groupBy("l_orderkey").agg(F.count_distinct("l_returnflag").alias("n")).where("n = 2")
    return wanted.select("l_orderkey")


@query("JOI11_backlog", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)")
def backlog(t):
    return t.documents.join(t.labels, "doc_id", "left_anti").join(t.embeddings.withColumnRenamed("vec_id", "doc_id"), "doc_id", "left_anti").select("doc_id")


@query("JOI14_repair", "SELECT o_orderkey, CASE WHEN s.first < o.o_orderdate AND s.first >= TIMESTAMP '1992-01-01' THEN s.first ELSE o.o_orderdate END AS repaired FROM orders o LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS first FROM lineitem GROUP BY 1) s ON s.l_orderkey = o.o_orderkey")
def repair(t):
    first = t.lineitem.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first"))
    earlier = (F.col("first") < F.col("o_orderdate")) & (F.col("first") >= F.expr("timestamp_ntz'1992-01-01 00:00:00'"))
    return t.orders.join(first, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", F.when(earlier, F.col("first")).otherwise(F.col("o_orderdate")).alias("repaired"))


@query("SET3_tag_sets", "SELECT user_id, len(list_intersect(list(DISTINCT event_type) FILTER (event_id % 2 = 0), list(DISTINCT event_type) FILTER (event_id % 2 = 1))) AS both, len(list_distinct(list(event_type))) AS either FROM events GROUP BY 1")
def tag_sets(t):
    odd = F.col("event_id") % 2 == 1
    sets = t.events.groupBy("user_id").agg(F.collect_set(F.when(~odd, F.col("event_type"))).alias("a"), F.collect_set(F.when(odd, F.col("event_type"))).alias("b"))
    return sets.select("user_id", F.size(F.array_intersect("a", "b")).cast("long").alias("both"), F.size(F.array_union("a", "b")).cast("long").alias("either"))
