"""Event, session and streaming-window queries over events and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from engramite.functions import ordered as od
from engramite.operators import sequence as sq
from engramite.plans.registry import query

SYMBOL = {"view": "r", "click": "e", "purchase": "t", "error": "x", "signup": "s"}


@query("ST2_sessions", """WITH g AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), s AS (SELECT *, sum(CASE WHEN b IS NULL OR date_diff('microsecond', b, ts) > 21600 * 1000000::BIGINT THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(ts) AS first, max(ts) AS last FROM s GROUP BY 1, 2""")
def sessions(t):
    return sq.sessions(t.events, "user_id", "ts", 21600, "event_id").groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("ST_session_window", """WITH g AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events), s AS (SELECT *, sum(CASE WHEN b IS NULL OR ts - b >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""")
def session_window(t):
    w = F.session_window(F.col("ts").cast("timestamp"), "6 hours")
    made = t.events.groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return made.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("started"), "n", "total")


@query("ST_tumbling_window", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS started, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling(t):
    made = t.events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return made.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("started"), "event_type", "n", "total")


@query("ST_sliding_window", """WITH s AS (SELECT time_bucket(INTERVAL 1 DAY, ts) - to_days(CAST(i AS INTEGER)) AS w, value, ts FROM events, range(0, 7) r(i))
SELECT strftime(w, '%Y-%m-%d') AS started, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY 1""")
def sliding(t):
    made = t.events.groupBy(F.window(F.col("ts").cast("timestamp"), "7 days", "1 day").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return made.select(F.date_format("w.start", "yyyy-MM-dd").alias("started"), "n", "total")


@query("JOI13_as_of", """SELECT e.event_id, CASE WHEN date_diff('microsecond', c.ts, e.ts) <= 86400 * 1000000::BIGINT THEN c.click_id END AS click_id FROM (SELECT * FROM events WHERE event_type = 'error') e
ASOF LEFT JOIN (SELECT user_id, ts, event_id AS click_id FROM events WHERE event_type = 'click') c ON e.user_id = c.user_id AND e.ts >= c.ts""")
def as_of(t):
    clicks = t.events.where("event_type = 'click'").withColumnRenamed("event_id", "click_id")
    return sq.as_of(t.events.where("event_type = 'error'"), clicks, "user_id", "ts", 86400, "event_id", "click_id")


@query("WIN6_gaps", """WITH g AS (SELECT user_id, date_diff('microsecond', ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap FROM events)
SELECT user_id, round(max(gap), 3) AS longest, round(sum(least(gap, 300)) FILTER (gap IS NOT NULL), 3) AS capped_300, round(sum(least(gap, 900)) FILTER (gap IS NOT NULL), 3) AS capped_900 FROM g GROUP BY 1""")
def gaps(t):
    g = sq.gaps(t.events, "user_id", "ts", "event_id")
    cap = lambda n: F.round(F.sum(F.when(F.col("gap").isNotNull(), F.least("gap", F.lit(float(n))))), 3).alias(f"capped_{n}")
    return g.groupBy("user_id").agg(F.round(F.max("gap"), 3).alias("longest"), cap(300), cap(900))


@query("WIN7_look_back", """WITH w AS (SELECT event_id, event_type, count(*) FILTER (event_type = 'click') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 64 PRECEDING AND 1 PRECEDING) AS clicks,
max(event_id) FILTER (event_type = 'view') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 64 PRECEDING AND 1 PRECEDING) AS view_id FROM events) SELECT event_id, clicks, view_id FROM w WHERE event_type = 'error'""")
def look_back(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-64, -1)
    rows = t.events.withColumn("clicks", F.count(F.when(F.col("event_type") == "click", 1)).over(w)).withColumn("view_id", F.max(F.when(F.col("event_type") == "view", F.col("event_id"))).over(w))
    return rows.where("event_type = 'error'").select("event_id", "clicks", "view_id")


@query("WIN8_last_n", """WITH w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events) SELECT user_id, event_id, back FROM w WHERE back <= 5""")
def last_n(t):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return t.events.withColumn("back", F.row_number().over(w)).where("back <= 5").select("user_id", "event_id", "back")


@query("SEQ1_workflows", """WITH s AS (SELECT user_id, string_agg(CASE event_type WHEN 'view' THEN 'r' WHEN 'click' THEN 'e' WHEN 'purchase' THEN 't' WHEN 'error' THEN 'x' ELSE 's' END, '' ORDER BY ts, event_id) AS a FROM events GROUP BY 1),
b AS (SELECT user_id, a, regexp_replace(a, 'rre', '_', 'g') AS a2 FROM s), c AS (SELECT *, regexp_replace(a2, 'tet', '_', 'g') AS a3 FROM b),
u AS (SELECT user_id, 'search-read-edit' AS pattern, len(regexp_extract_all(a, 'rre')) AS n FROM c UNION ALL SELECT user_id, 'test-edit-test', len(regexp_extract_all(a2, 'tet')) FROM c UNION ALL SELECT user_id, 'read-edit', len(regexp_extract_all(a3, 're')) FROM c)
SELECT * FROM u WHERE n > 0""")
def workflows(t):
    kind = F.col("event_type")
    symbol = F.when(kind == "view", "r").when(kind == "click", "e").when(kind == "purchase", "t").when(kind == "error", "x").otherwise("s")
    return sq.workflows(t.events, "user_id", ["ts", "event_id"], symbol, {"search-read-edit": "rre", "test-edit-test": "tet", "read-edit": "re"})


@query("SEQ4_interval_union", """WITH i AS (SELECT user_id, ts AS a, ts + to_minutes(CAST(30 + json_extract(props, '$.k')::INTEGER AS INTEGER)) AS b FROM events), r AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM r), p AS (SELECT user_id, k, min(a) AS a, max(b) AS b FROM n GROUP BY 1, 2)
SELECT user_id, count(*) AS islands, round(sum(date_diff('microsecond', a, b) / 1e6), 3) AS seconds FROM p GROUP BY 1""")
def interval_union(t):
    k = F.get_json_object("props", "$.k").cast("int")
    spans = t.events.withColumn("end_at", F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), 30 + k, F.lit(0)))
    return sq.union_seconds(spans, "user_id", "ts", "end_at")


@query("JOI17_turn_pairs", """WITH g AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)
SELECT conv_id, min(turn) FILTER (role = 'user') AS asked_at, min(turn) FILTER (role = 'assistant') AS answered_at FROM g WHERE k > 0 GROUP BY conv_id, k""")
def turn_pairs(t):
    return sq.turn_pairs(t.conversations, "conv_id", "turn", "role", "user", "assistant")


@query("JOI18_lineage", """WITH RECURSIVE n AS (SELECT p_partkey AS node, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_partkey // 2 END AS up FROM part), f AS (SELECT node, CASE WHEN up IN (SELECT node FROM n) THEN up END AS up FROM n),
w AS (SELECT node, node AS root, CAST(0 AS BIGINT) AS depth FROM f WHERE up IS NULL UNION ALL SELECT f.node, w.root, w.depth + 1 FROM f JOIN w ON f.up = w.node) SELECT * FROM w""")
def lineage(t):
    """Parts stand for records: every seventh starts a tree, the others hang below half their number."""
    up = F.when(F.col("p_partkey") % 7 == 0, None).otherwise(F.expr("p_partkey div 2"))
    return sq.ancestors(t.part.select("p_partkey", up.alias("up")), "p_partkey", "up")


@query("ST6_active_sessions", """SELECT user_id, max(ts) AS last, arg_max(event_type, {'t': ts, 'e': event_id}) AS last_event, max(ts) > TIMESTAMP '2024-01-30' AS live FROM events GROUP BY 1""")
def active_sessions(t):
    return t.events.groupBy("user_id").agg(F.max("ts").alias("last"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_event"), (F.max("ts") > F.expr("timestamp_ntz'2024-01-30 00:00:00'")).alias("live"))


@query("ST5_work_claims", """WITH a AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS attempts, max(ts) AS beat FROM events GROUP BY 1), s AS (SELECT user_id, CASE WHEN attempts >= 20 THEN 'dead' WHEN beat < TIMESTAMP '2024-01-30' THEN 'stale' ELSE 'running' END AS status FROM a)
SELECT status, count(*) AS n FROM s GROUP BY 1""")
def work_claims(t):
    a = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("attempts"), F.max("ts").alias("beat"))
    status = F.when(F.col("attempts") >= 20, "dead").when(F.col("beat") < F.expr("timestamp_ntz'2024-01-30 00:00:00'"), "stale").otherwise("running")
    return a.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("ST_late_rows", """WITH m AS (SELECT event_id, ts, max(ts) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM (SELECT (event_id * 7919) % 10007 AS event_id, ts FROM events)) SELECT count(*) AS n, count(*) FILTER (ts < mark - INTERVAL 1 DAY) AS late FROM m""")
def late_rows(t):
    """Rows later than a day behind the watermark, if they came in a scrambled order; those that came at one place, which the SQL leaves open, in the order of their numbers."""
    scrambled = t.events.select(((F.col("event_id") * 7919) % 10007).alias("place"), "event_id", "ts")
    marked = od.greatest_before(scrambled, ["place", "event_id"], "ts", "mark")
    return marked.agg(F.count("*").alias("n"), F.count_if(F.col("ts") < F.col("mark") - F.expr("interval 1 day")).alias("late"))


@query("SEQ3_merged_episodes", """WITH e AS (SELECT event_id, user_id * 1000 + CAST(json_extract(props, '$.k') AS INTEGER) // 10 AS shared, CASE WHEN value > 80 THEN 2 WHEN value > 40 THEN 1 ELSE 0 END AS r, ts FROM events WHERE event_type = 'error')
SELECT min(event_id) AS merged, count(*) AS episodes, max(r) AS strongest, min(ts) AS first, max(ts) AS last FROM e GROUP BY shared""")
def merged_episodes(t):
    """Errors are episodes; those of one user on the same tenth of the files share an affected event."""
    k = F.get_json_object("props", "$.k").cast("int")
    rank = F.when(F.col("value") > 80, 2).when(F.col("value") > 40, 1).otherwise(0)
    rows = t.events.where("event_type = 'error'").select("event_id", (F.col("user_id") * 1000 + F.floor(k / 10)).alias("shared"), rank.alias("r"), "ts")
    return sq.merge_episodes(rows, "event_id", "shared", "r", "ts")
