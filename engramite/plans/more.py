"""Further queries of the survey: joins with names, ordered sets, lookups, writes, scans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from engramite.functions import text as tx
from engramite.operators import lifecycle as lc
from engramite.operators import metrics as m
from engramite.operators import recall as rc
from engramite.operators import scans
from engramite.plans.registry import AS_OF, LEARNINGS, query, sql_replaced

T = f"TIMESTAMP '{AS_OF}'"


@query("JOI9_two_names", """SELECT a.n_name AS customer_nation, b.n_name AS supplier_nation, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_nationkey = s_nationkey GROUP BY 1, 2""")
def two_names(t):
    n = t.nation.select("n_nationkey", "n_name")
    lines = t.lineitem.select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    per = lines.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    small = per.groupBy("c_nationkey", "s_nationkey").agg(F.count("*").alias("n"), F.sum("r").alias("r"))
    named = small.join(n.withColumnsRenamed({"n_nationkey": "c_nationkey", "n_name": "customer_nation"}), "c_nationkey").join(n.withColumnsRenamed({"n_nationkey": "s_nationkey", "n_name": "supplier_nation"}), "s_nationkey")
    return named.select("customer_nation", "supplier_nation", "n", F.round("r", 2).alias("revenue"))


@query("JOI16_lookup", "SELECT c_custkey, coalesce(n_name, 'none') AS nation, c_nationkey % 5 AS k FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON n_nationkey = c_nationkey")
def lookup(t):
    even = t.nation.where("n_nationkey % 2 = 0").select("n_nationkey", "n_name")
    return t.customer.join(even, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.coalesce("n_name", F.lit("none")).alias("nation"), (F.col("c_nationkey") % 5).alias("k"))


@query("JOI6_lateral_json", "SELECT event_id, unnest(json_keys(props)) AS key FROM events")
def lateral_json(t):
    return t.events.select("event_id", F.explode(F.json_object_keys("props")).alias("key"))


@query("JOI12_exists_guard", "SELECT p_partkey FROM part p WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l_quantity >= 49) AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l_discount = 0)")
def exists_guard(t):
    many = t.lineitem.where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    plain = t.lineitem.where("l_discount = 0").select(F.col("l_partkey").alias("p_partkey"))
    return t.part.select("p_partkey").join(many, "p_partkey", "left_semi").join(plain, "p_partkey", "left_anti")


@query("WIN3_best_of_pair", "WITH p AS (SELECT least(l_partkey % 50, l_suppkey % 50) AS lo, greatest(l_partkey % 50, l_suppkey % 50) AS hi, l_orderkey, l_linenumber, l_extendedprice FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY lo, hi ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n FROM p) SELECT lo, hi, l_orderkey, l_linenumber FROM r WHERE n = 1")
def best_of_pair(t):
    a, b = F.col("l_partkey") % 50, F.col("l_suppkey") % 50
    rows = t.lineitem.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), "l_orderkey", "l_linenumber", "l_extendedprice")
    return m.latest(rows, ["lo", "hi"], F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")).drop("l_extendedprice")


@query("WIN9_position_score", "WITH r AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) - 1 AS pos, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) SELECT c_custkey, round(1 - CAST(pos AS DOUBLE) / n, 9) AS score FROM r")
def position_score(t):
    w = Window.partitionBy("c_nationkey")
    pos = F.row_number().over(w.orderBy(F.desc("c_acctbal"), "c_custkey")) - 1
    return t.customer.select("c_custkey", F.round(1 - pos / F.count("*").over(w), 9).alias("score"))


@query("SRT2_overfetch", "WITH f AS (SELECT p_partkey, p_retailprice, p_size FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50) SELECT p_partkey, p_size FROM f WHERE p_partkey NOT IN (5, 10, 15) ORDER BY p_size DESC, p_retailprice DESC, p_partkey LIMIT 10")
def overfetch(t):
    pool = t.part.orderBy(F.desc("p_retailprice"), "p_partkey").limit(50)
    return pool.where(~F.col("p_partkey").isin(5, 10, 15)).orderBy(F.desc("p_size"), F.desc("p_retailprice"), "p_partkey").limit(10).select("p_partkey", "p_size")


@query("SRT3_bounded_top", "SELECT o_orderkey FROM orders ORDER BY CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END DESC, o_totalprice DESC, o_orderdate, o_orderkey LIMIT 500")
def bounded_top(t):
    strength = F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "O", 1).otherwise(0)
    return t.orders.orderBy(F.desc(strength), F.desc("o_totalprice"), "o_orderdate", "o_orderkey").limit(500).select("o_orderkey")


@query("SET4_ordered_distinct", "WITH u AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS a FROM events GROUP BY 1) SELECT user_id, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), ',') AS first_seen FROM u")
def ordered_distinct(t):
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    return t.events.groupBy("user_id").agg(F.array_join(F.array_distinct(F.transform(ordered, lambda e: e["event_type"])), ",").alias("first_seen"))


@query("SET5_fan_out", "WITH d AS (SELECT DISTINCT text FROM documents), e AS (SELECT text, length(text) % 97 AS code FROM d) SELECT doc_id, code FROM documents JOIN e USING (text)")
def fan_out(t):
    """Each distinct text is worked on once, by its hash, and the result goes to every row that has it."""
    rows = t.documents.select("doc_id", "text", F.sha2("text", 256).alias("hash"))
    once = rows.groupBy("hash").agg((F.first(F.length("text")) % 97).alias("code"))
    return rows.select("doc_id", "hash").join(once, "hash").select("doc_id", "code")


@query("SNK6_conditional_update", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'global' ELSE 'restricted' END AS scope, (CASE WHEN page_id % 2 = 0 THEN 'global' ELSE 'restricted' END) <> (CASE WHEN page_id % 3 = 0 THEN 'global' ELSE 'restricted' END) AS changed FROM pages")
def conditional_update(t):
    scope = lambda n: F.when(F.col("page_id") % n == 0, "global").otherwise("restricted")
    return t.pages.select("page_id", scope(3).alias("scope"), (scope(2) != scope(3)).alias("changed"))


@query("SNK7_live_run", "WITH r AS (SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS run FROM orders GROUP BY 1) SELECT o.o_custkey, o.o_orderkey FROM orders o JOIN r ON r.o_custkey = o.o_custkey AND CAST(o.o_orderdate AS DATE) = r.run")
def live_run(t):
    day = F.col("o_orderdate").cast("date")
    live = t.orders.groupBy("o_custkey").agg(F.max(day).alias("run"))
    return t.orders.withColumn("run", day).join(live, ["o_custkey", "run"]).select("o_custkey", "o_orderkey")


@query("SNK9_archive_once", LEARNINGS + f"SELECT id, coalesce(archived_at, CASE WHEN recall_count = 0 AND superseded_by IS NULL AND created_at < {T} - INTERVAL 50 DAY THEN {T} END) AS archived_at FROM learnings")
def archive_once(t):
    old = (F.col("recall_count") == 0) & F.col("superseded_by").isNull() & (F.col("created_at") < m.days_before(AS_OF, 50))
    return t.learnings.select("id", F.coalesce("archived_at", F.when(old, m.moment(AS_OF))).alias("archived_at"))


@query("SNK14_series_upsert", "SELECT strftime(ts, '%Y-%m-%d') AS day, round(100.0 * CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) / count(*), 2) AS stale_pct FROM events GROUP BY 1")
def series(t):
    """The daily rate, written twice: the second half replaces the days that it has."""
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    rate = t.events.groupBy(day).agg(F.round(100.0 * F.count_if(F.col("event_type") == "error") / F.count("*"), 2).alias("stale_pct"), F.max("ts").alias("at"))
    before = rate.where("day < '2024-01-20'").withColumn("at", F.expr("timestamp_ntz'2023-01-01 00:00:00'"))
    return lc.upsert(before, rate, ["day"], "at").select("day", "stale_pct")


@query("SNK15_rejects", "WITH h AS (SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n, min(doc_id) OVER (PARTITION BY sha256(text)) AS kept FROM documents) SELECT doc_id, kept FROM h WHERE n > 1")
def rejects(t):
    rows = t.documents.select("doc_id", F.sha2("text", 256).alias("hash"))
    first = rows.groupBy("hash").agg(F.min("doc_id").alias("kept"))
    return rows.join(first, "hash").where("doc_id <> kept").select("doc_id", "kept")


@query("LKP2_mark_outcome", "SELECT o_orderkey, coalesce(u.outcome, o_orderstatus) AS outcome FROM orders LEFT JOIN (SELECT l_orderkey, 'SUCCEEDED' AS outcome FROM lineitem GROUP BY 1 HAVING min(l_linestatus) = 'O') u ON u.l_orderkey = o_orderkey")
def mark_outcome(t):
    done = t.lineitem.groupBy("l_orderkey").agg(F.min("l_linestatus").alias("s")).where("s = 'O'").select(F.col("l_orderkey").alias("o_orderkey"), F.lit("SUCCEEDED").alias("done"))
    return t.orders.join(done, "o_orderkey", "left").select("o_orderkey", F.coalesce("done", "o_orderstatus").alias("outcome"))


@query("LKP4_core_memory", "SELECT user_id, array_to_string(list(event_type || '=' || CAST(v AS VARCHAR) ORDER BY event_type), ';') AS blocks FROM (SELECT user_id, event_type, arg_max(CAST(json_extract(props, '$.k') AS INTEGER), {'t': ts, 'e': event_id}) AS v FROM events GROUP BY 1, 2) GROUP BY 1")
def core_memory(t):
    k = F.get_json_object("props", "$.k").cast("int")
    newest = t.events.groupBy("user_id", "event_type").agg(F.max_by(k, F.struct("ts", "event_id")).alias("v"))
    return newest.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_type", "v"))), lambda s: F.concat_ws("=", s["event_type"], s["v"])), ";").alias("blocks"))


@query("LKP8_browse", "SELECT doc_id, n_chars FROM documents WHERE lang = 'en' AND contains(lower(text), 'licensed') ORDER BY doc_id DESC LIMIT 20")
def browse(t):
    return t.documents.where((F.col("lang") == "en") & F.contains(F.lower("text"), F.lit("licensed"))).orderBy(F.desc("doc_id")).limit(20).select("doc_id", "n_chars")


@query("LKP9_turn_facts", "SELECT conv_id, turn, role FROM conversations WHERE turn <= 2")
def turn_facts(t):
    return rc.turn_facts(t.conversations, "conv_id", "turn", last=2).select("conv_id", "turn", "role")


@query("LKP11_backfill", "SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'done' WHEN e.vec_id IS NOT NULL THEN 'partial' ELSE 'new' END AS state, (row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) - 1) // 10 AS batch FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def backfill(t):
    done = t.labels.select("doc_id").distinct().withColumn("done", F.lit(True))
    part = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("part"))
    number = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    return t.documents.select("doc_id", "source").join(done, "doc_id", "left").join(part, "doc_id", "left").select("doc_id", F.when(F.col("done"), "done").when(F.col("part"), "partial").otherwise("new").alias("state"), F.floor(number / 10).alias("batch"))


@query("LKP17_first_of_value", "SELECT p_type, arg_min(p_partkey, {'s': p_size, 'k': p_partkey}) AS p_partkey FROM part GROUP BY 1")
def first_of_value(t):
    return t.part.groupBy("p_type").agg(F.min_by("p_partkey", F.struct("p_size", "p_partkey")).alias("p_partkey"))


@query("LKP18_upstream", "SELECT conv_id, turn, role FROM conversations WHERE turn < 3 ORDER BY turn, conv_id DESC LIMIT 40")
def upstream(t):
    return t.conversations.where("turn < 3").orderBy("turn", F.desc("conv_id")).limit(40).select("conv_id", "turn", "role")


@query("LKP19_artifact_upsert", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'new' || p_brand ELSE p_brand END AS body, coalesce(CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name END, p_type) AS name FROM part")
def artifact_upsert(t):
    fresh = t.part.where("p_partkey % 3 = 0").select("p_partkey", F.concat(F.lit("new"), "p_brand").alias("body"))
    name = F.coalesce(F.when(F.col("p_partkey") % 5 != 0, F.col("p_name")), F.col("p_type"))
    return t.part.join(fresh, "p_partkey", "left").select("p_partkey", F.coalesce("body", "p_brand").alias("body"), name.alias("name"))


@query("LKP20_saved_query", "SELECT source, '[' || array_to_string(list(doc_id ORDER BY doc_id)[1:5], ',') || ']' AS matches, substr(md5(source || 'tion'), 1, 12) AS query_id FROM documents WHERE contains(lower(text), 'tion') GROUP BY source")
def saved_query(t):
    """The first five matches of each source under an id made from what was asked."""
    hits = t.texts.where(F.contains(F.lower("text"), F.lit("tion"))).select("doc_id").join(t.documents.select("doc_id", "source"), "doc_id")
    first = scans.top_per_key(hits, "source", [F.col("doc_id")], 5)
    return first.groupBy("source").agg(F.to_json(F.array_sort(F.collect_list("doc_id"))).alias("matches")).withColumn("query_id", F.substring(F.md5(F.concat("source", F.lit("tion"))), 1, 12))


@query("TXT15_signals", "SELECT role, count(*) AS n, count(*) FILTER (regexp_matches(text, '(?i)" + "|".join(tx.SIGNALS).replace("'", "''") + "')) AS with_signal FROM conversations GROUP BY 1")
def signals(t):
    return t.conversations.groupBy("role").agg(F.count("*").alias("n"), F.count_if(tx.has_signal(F.col("text"))).alias("with_signal"))


LEAD_LIST, LEAD = ", ".join(f"'{w}'" for w in tx.LEADS), "|".join(tx.LEADS)
TURNS = "SELECT conv_id, turn, CASE (conv_id + turn) % 8 WHEN 0 THEN 'No:do that again!' WHEN 1 THEN 'yeah,  use the second option please' WHEN 2 THEN 'OK, sure' WHEN 3 THEN ' ' WHEN 4 THEN 'no, extend it another 7 business days' WHEN 5 THEN 'fix this function' ELSE text END AS text FROM conversations"


@query("TXT14_conversational", rf"""WITH c AS ({TURNS}), k AS (SELECT *, list_filter(list_transform(string_split_regex(regexp_replace(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '^({LEAD})\s*[,:;.-]+\s*', '\1 '), '\s+'), lambda w: regexp_replace(w, '^[^\w]+|[^\w]+$', '', 'g')), lambda w: w <> '') AS w FROM c),
r AS (SELECT *, array_to_string(CASE WHEN list_contains([{LEAD_LIST}], w[1]) THEN w[2:] ELSE w END, ' ') AS rest FROM k)
SELECT conv_id, turn, len(w) = 0 OR (len(w) <= 8 AND (len(list_filter(w, lambda x: NOT list_contains([{LEAD_LIST}], x))) = 0 OR regexp_matches(coalesce(rest, ''), '{tx.POINTING}') OR regexp_matches(coalesce(rest, ''), '{tx.CHOOSING}'))) AS gated FROM r""")
def conversational(t):
    kind = (F.col("conv_id") + F.col("turn")) % 8
    said = F.when(kind == 0, "No:do that again!").when(kind == 1, "yeah,  use the second option please").when(kind == 2, "OK, sure").when(kind == 3, " ").when(kind == 4, "no, extend it another 7 business days").when(kind == 5, "fix this function").otherwise(F.col("text"))
    return t.conversations.select("conv_id", "turn", tx.is_conversational(said).alias("gated"))


PLAIN = ", ".join(f"'{w}'" for w in tx.PLAIN_WORDS)
KEYS = r"list_filter(string_split_regex(regexp_replace(lower(text), '[^\w\s-]', ' ', 'g'), '\s+'), lambda w: length(w) > 2 AND w NOT IN (" + PLAIN + "))"
ASKED = "SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN 'Can you  show me ' || text[1:40] || ' please?' WHEN 1 THEN 'how do I do it?' WHEN 2 THEN 'Find the pg_pool leak in node-postgres thanks' ELSE text END AS text FROM conversations"


@query("TXT13_keywords", f"WITH a AS ({ASKED}), k AS (SELECT *, {KEYS} AS w FROM a), i AS (SELECT *, regexp_replace(" + sql_replaced(r"regexp_replace(text, '^\s+|\s+$', '', 'g')", [(p, "") for p in tx.ASKING]) + r", '^\s+|\s+$', '', 'g') AS kept FROM k) SELECT conv_id, turn, CASE WHEN length(kept) < 5 THEN coalesce(array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i)[1:5], ' '), '') ELSE kept END AS intent FROM i")
def keywords(t):
    kind = (F.col("conv_id") + F.col("turn")) % 4
    asked = F.when(kind == 0, F.concat(F.lit("Can you  show me "), F.substring("text", 1, 40), F.lit(" please?"))).when(kind == 1, "how do I do it?").when(kind == 2, "Find the pg_pool leak in node-postgres thanks").otherwise(F.col("text"))
    return t.conversations.select("conv_id", "turn", tx.intent(asked).alias("intent"))


@query("TXT23_file_mentions", r"""SELECT p_partkey, coalesce(array_to_string(list_concat(regexp_extract_all(t, '`([^`\n]+\.[a-z]+)(?::[^`\n]*)?`', 1), regexp_extract_all(t, '\*\*File\*\*:\s*`?([^\s`]+)`?', 1)), ','), '') AS files
FROM (SELECT p_partkey, '- `src/' || replace(p_name, ' ', '_') || '.py:' || CAST(p_size AS VARCHAR) || '` and `x y`' || chr(10) || '**File**: ' || CASE WHEN p_partkey % 2 = 0 THEN '`a/b' || CAST(p_partkey AS VARCHAR) || '`' ELSE 'c.ts' END AS t FROM part)""")
def file_mentions(t):
    named = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("`a/b"), F.col("p_partkey").cast("string"), F.lit("`"))).otherwise("c.ts")
    text = F.concat(F.lit("- `src/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".py:"), F.col("p_size").cast("string"), F.lit("` and `x y`\n**File**: "), named)
    return t.part.select("p_partkey", F.array_join(tx.file_mentions(text), ",").alias("files"))


@query("RED2_luhn", """WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\b[0-9]{16}\\b')) AS card FROM documents), s AS (SELECT doc_id, card, list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 1 THEN CASE WHEN CAST(card[i] AS INTEGER) * 2 > 9 THEN CAST(card[i] AS INTEGER) * 2 - 9 ELSE CAST(card[i] AS INTEGER) * 2 END ELSE CAST(card[i] AS INTEGER) END)) AS total FROM c)
SELECT doc_id, card, total % 10 = 0 AS valid FROM s""")
def luhn(t):
    return t.texts.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b[0-9]{16}\b"), F.lit(0))).alias("card")).select("doc_id", "card", F.expr("luhn_check(card)").alias("valid"))




@query("VEC22_ttl_jitter", "SELECT doc_id, round(0.9 + 0.2 * CAST('0x' || substr(sha256(text), 1, 4) AS INTEGER) / CAST(65535 AS DOUBLE), 9) AS factor FROM documents")
def jitter(t):
    part = F.conv(F.substring(F.sha2("text", 256), 1, 4), 16, 10).cast("double")
    return t.texts.select("doc_id", F.round(0.9 + 0.2 * part / 65535.0, 9).alias("factor"))


@query("VEC15_tag_jaccard", "WITH u AS (SELECT user_id, list(DISTINCT event_type) AS a, list(DISTINCT event_type) FILTER (value > 50) AS b FROM events GROUP BY 1) SELECT user_id, round(len(list_intersect(a, coalesce(b, []))) / CAST(len(list_distinct(list_concat(a, coalesce(b, [])))) AS DOUBLE), 9) AS jaccard FROM u")
def tag_jaccard(t):
    u = t.events.groupBy("user_id").agg(F.collect_set("event_type").alias("a"), F.collect_set(F.when(F.col("value") > 50, F.col("event_type"))).alias("b"))
    return u.select("user_id", F.round(F.try_divide(F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b"))), 9).alias("jaccard"))


@query("CUR5_scoped_search", """WITH c AS (SELECT a.vec_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM embeddings a, embeddings b WHERE b.vec_id = 7 AND a.label % 2 = 0) SELECT vec_id, round(s, 9) AS similarity FROM c ORDER BY s DESC, vec_id LIMIT 8""")
def scoped_search(t):
    """Nearest chunks among those of global collections; even labels stand for them."""
    from engramite.plans.recall import probe

    chunks = t.embeddings.withColumns({"collection": F.col("label").cast("string"), "scope": F.when(F.col("label") % 2 == 0, "global").otherwise("restricted")})
    return rc.knn(lc.scope_gate(chunks, None), probe(t)).orderBy(F.desc("similarity"), "vec_id").limit(8).select("vec_id", F.round("similarity", 9).alias("similarity"))


@query("LKP16_tuning_rule", """WITH c AS (SELECT p_brand AS config, avg(p_retailprice) / 2000 AS ndcg, quantile_disc(p_size, 0.95) AS p95, count(DISTINCT p_type) AS signals FROM part GROUP BY 1), b AS (SELECT * FROM c WHERE config = (SELECT min(config) FROM c)) SELECT c.config, (c.ndcg > b.ndcg + 1e-9 OR (abs(c.ndcg - b.ndcg) <= 1e-9 AND c.signals < b.signals)) AND c.p95 <= greatest(b.p95 * 1.25, b.p95 + 1) AS keep FROM c, b""")
def tuning_rule(t):
    """Kept if the quality is strictly better, or as good with fewer signals, and slow cases stay within the budget of the first configuration."""
    from engramite.operators import rerank as rr

    sizes = t.part.groupBy(F.col("p_brand").alias("config"), "p_size").agg(F.count("*").alias("n"))
    slow = rr.nearest_rank(sizes, "config", "p_size", "n", 0.95).withColumnRenamed("value", "p95")
    c = t.part.groupBy(F.col("p_brand").alias("config")).agg((F.avg("p_retailprice") / 2000).alias("ndcg"), F.count_distinct("p_type").alias("signals")).join(slow, "config")
    return rr.tuning(c, "config").select("config", "keep")


@query("LKP5_recall_text", "SELECT source, array_to_string(list('- ' || CAST(doc_id AS VARCHAR) || ': ' || CAST(n_chars AS VARCHAR) ORDER BY doc_id DESC)[1:3], chr(10)) AS context FROM documents GROUP BY 1")
def recall_text(t):
    by = Window.partitionBy("source").orderBy(F.desc("doc_id"))
    rows = t.documents.select("source", "doc_id", "n_chars", F.row_number().over(by).alias("r")).where("r <= 3")
    lines = F.array_sort(F.collect_list(F.struct("r", F.concat(F.lit("- "), "doc_id", F.lit(": "), "n_chars").alias("line"))))
    return rows.groupBy("source").agg(F.array_join(F.transform(lines, lambda s: s["line"]), "\n").alias("context"))


@query("SNK11_push_counts", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS id, count(*) AS push_count FROM events WHERE event_type = 'click' GROUP BY 1")
def push_counts(t):
    return t.events.where("event_type = 'click'").groupBy(F.get_json_object("props", "$.k").cast("long").alias("id")).agg(F.count("*").alias("push_count"))
