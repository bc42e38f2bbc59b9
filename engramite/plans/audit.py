"""Queries of session audit, curation, renderings, markers and further statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from engramite.functions import numeric as nm
from engramite.functions import text as tx
from engramite.operators import audit as au
from engramite.operators import lifecycle as lc
from engramite.operators import metrics as m
from engramite.operators import scans as sc
from engramite.plans.registry import AS_OF, LEARNINGS, query

K = "CAST(json_extract(props, '$.k') AS INTEGER)"
SPANS = f"i AS (SELECT user_id, list_extract(['observed', 'affected', 'ambiguous'], CAST(event_id % 3 + 1 AS INTEGER)) AS kind, CASE WHEN event_id % 101 = 0 THEN NULL ELSE ts END AS a, CASE WHEN event_id % 211 = 0 THEN ts - INTERVAL 1 MINUTE ELSE ts + to_minutes({K}) END AS b, event_id % 13 <> 0 AS same, event_id % 17 = 0 AS human FROM events)"


def spans(t):
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.element_at(F.array(F.lit("observed"), F.lit("affected"), F.lit("ambiguous")), (F.col("event_id") % 3 + 1).cast("int"))
    end = F.when(F.col("event_id") % 211 == 0, F.col("ts") - F.expr("interval 1 minute")).otherwise(F.col("ts") + F.make_dt_interval(mins=k))
    return t.events.select("user_id", kind.alias("kind"), F.when(F.col("event_id") % 101 != 0, F.col("ts")).alias("start"), end.alias("end"), (F.col("event_id") % 13 != 0).alias("same_lineage"), (F.col("event_id") % 17 == 0).alias("human"))


def union_sql(name: str, kinds: str) -> str:
    return f"""{name}0 AS (SELECT user_id, a, b, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM g WHERE kind IN ({kinds})),
{name}1 AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM {name}0),
{name}2 AS (SELECT user_id, k, min(a) AS a, max(b) AS b FROM {name}1 GROUP BY 1, 2), {name} AS (SELECT user_id, sum(date_diff('microsecond', a, b) / 1e6) AS s FROM {name}2 GROUP BY 1)"""


ATTRIBUTION = f"""{SPANS}, s AS (SELECT *, NOT same OR human AS out, same AND NOT human AND (a IS NULL OR b IS NULL) AS missing, coalesce(same AND NOT human AND b < a, false) AS invalid FROM i),
g AS (SELECT user_id, kind, a, CASE kind WHEN 'affected' THEN least(b, a + INTERVAL 300 SECOND) WHEN 'ambiguous' THEN least(b, a + INTERVAL 900 SECOND) ELSE b END AS b FROM s WHERE NOT out AND NOT missing AND NOT invalid),
{union_sql('lo', "'observed'")}, {union_sql('ce', "'observed', 'affected'")}, {union_sql('hi', "'observed', 'affected', 'ambiguous'")},
c AS (SELECT user_id, count(*) FILTER ((missing OR invalid) AND kind = 'observed') AS b0, count(*) FILTER ((missing OR invalid) AND kind IN ('observed', 'affected')) AS b1, count(*) FILTER (missing OR invalid) AS b2, count(*) FILTER (missing) AS missing, count(*) FILTER (invalid) AS invalid, count(*) FILTER (NOT same) AS unrelated, count(*) FILTER (out AND same) AS idle FROM s GROUP BY 1),
att AS (SELECT c.user_id, CASE WHEN b0 = 0 THEN round(coalesce(lo.s, 0), 3) END AS low, CASE WHEN b1 = 0 THEN round(coalesce(ce.s, 0), 3) END AS central, CASE WHEN b2 = 0 THEN round(coalesce(hi.s, 0), 3) END AS high, missing, invalid, unrelated, idle FROM c LEFT JOIN lo USING (user_id) LEFT JOIN ce USING (user_id) LEFT JOIN hi USING (user_id))"""


@query("SEQ4_time_attribution", f"WITH {ATTRIBUTION} SELECT * FROM att")
def attribution(t):
    made = au.attribution(spans(t), "user_id")
    return made.withColumns({c: F.round(c, 3) for c in ("low", "central", "high")})


@query("SEQ5_judge_candidates", f"SELECT event_id, props[1:5] AS excerpt, length(props) > 5 AS cut FROM events WHERE event_type = 'error' ORDER BY value DESC, ts, event_id LIMIT 100")
def judge_candidates(t):
    errors = t.events.where("event_type = 'error'")
    return au.judge_candidates(errors, "event_id", [F.desc("value"), F.col("ts"), F.col("event_id")], 100, "props", 5).select("event_id", "excerpt", "cut")


@query("SEQ5_decisions", """WITH e AS (SELECT event_id, CASE WHEN value > 60 THEN 'confirmed' ELSE 'probable' END AS class, CAST(0.5 AS DOUBLE) AS confidence FROM events WHERE event_type = 'error'), d AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'dismissed' WHEN 2 THEN 'odd' ELSE 'probable' END AS dc, CAST(event_id % 7 AS DOUBLE) / 5 AS dq FROM events WHERE event_id % 3 = 0),
j AS (SELECT e.*, dc, dq, coalesce(CASE dc WHEN 'confirmed' THEN 2 WHEN 'probable' THEN 1 WHEN 'dismissed' THEN 0 END <= CASE class WHEN 'confirmed' THEN 2 ELSE 1 END, false) AS judged FROM e LEFT JOIN d USING (event_id)) SELECT event_id, CASE WHEN judged THEN dc ELSE class END AS class, round(CASE WHEN judged THEN least(greatest(dq, 0), 1) ELSE confidence END, 6) AS confidence, judged FROM j""")
def decisions(t):
    e = t.events.where("event_type = 'error'").select("event_id", F.when(F.col("value") > 60, "confirmed").otherwise("probable").alias("class"), F.lit(0.5).alias("confidence"))
    k = F.col("event_id") % 4
    d = t.events.where("event_id % 3 = 0").select("event_id", F.when(k == 0, "confirmed").when(k == 1, "dismissed").when(k == 2, "odd").otherwise("probable").alias("class"), ((F.col("event_id") % 7).cast("double") / 5).alias("confidence"))
    return au.apply_decisions(e, d, "event_id").withColumn("confidence", F.round("confidence", 6))


@query("SEQ6_report")
def audit_report(t):
    """One report for each user: errors as episodes, with what was said as excerpts, and the attributed times."""
    episodes = t.events.where("event_type = 'error'").select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), F.when(F.col("value") > 60, "confirmed").otherwise("probable").alias("class"), "props")
    return au.report(episodes, au.attribution(spans(t), "user_id"), "user_id", "props")


@query("ST1_jobs_due", f"""WITH j AS (SELECT user_id AS job, CASE user_id % 3 WHEN 0 THEN 60 WHEN 1 THEN 21600 ELSE 86400 END AS every_seconds, CASE WHEN user_id % 10 = 0 THEN NULL ELSE max(ts) END AS last_run, user_id % 7 = 0 AS running FROM events GROUP BY 1) SELECT job, NOT running AND (last_run IS NULL OR date_diff('microsecond', last_run, TIMESTAMP '2024-01-31 12:00:00') // 1000000 >= every_seconds) AS due FROM j""")
def jobs_due(t):
    every = F.when(F.col("job") % 3 == 0, 60).when(F.col("job") % 3 == 1, 21600).otherwise(86400)
    jobs = t.events.groupBy(F.col("user_id").alias("job")).agg(F.max("ts").alias("last"))
    jobs = jobs.select("job", every.alias("every_seconds"), F.when(F.col("job") % 10 != 0, F.col("last")).alias("last_run"), (F.col("job") % 7 == 0).alias("running"))
    return au.jobs_due(jobs, "2024-01-31 12:00:00").select("job", "due")


@query("ST3_fold", "WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events) SELECT user_id, count(*) AS n, string_agg(event_type, ',' ORDER BY back DESC) FILTER (back <= 50) AS latest FROM e GROUP BY 1")
def fold(t):
    """What the streaming fold holds of each user after all events: a counter and the last fifty types."""
    kept = sc.top_per_key(t.events.select("user_id", "ts", "event_id", "event_type"), "user_id", [F.desc("ts"), F.desc("event_id")], 50)
    latest = kept.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("o"), "event_type"))), lambda s: s["event_type"]), ",").alias("latest"))
    return t.events.groupBy("user_id").agg(F.count("*").alias("n")).join(latest, "user_id")


@query("ST4_pairs", f"""WITH u AS (SELECT event_id, user_id, {K} AS k, ts FROM events WHERE event_type = 'click'), r AS (SELECT user_id, {K} AS k, ts FROM events WHERE event_type = 'purchase') SELECT u.event_id, min(r.ts) AS done_at FROM u LEFT JOIN r ON r.user_id = u.user_id AND r.k = u.k AND r.ts >= u.ts AND r.ts <= u.ts + INTERVAL 5 DAY GROUP BY 1""")
def pairs(t):
    """Clicks with the first purchase of the same thing within five days: the bounded join of the streaming form."""
    k = F.get_json_object("props", "$.k").cast("int").alias("k")
    u = t.events.where("event_type = 'click'").select("event_id", "user_id", k, "ts")
    r = t.events.where("event_type = 'purchase'").select("user_id", k, F.col("ts").alias("done"))
    near = u.join(r, ["user_id", "k"]).where((F.col("done") >= F.col("ts")) & (F.col("done") <= F.col("ts") + F.expr("interval 5 day"))).groupBy("event_id").agg(F.min("done").alias("done_at"))
    return u.select("event_id").join(near, "event_id", "left")


@query("CUR3_review", LEARNINGS + f""", a AS (SELECT * FROM learnings WHERE superseded_by IS NULL AND archived_at IS NULL) SELECT 'promote' AS action, id FROM a WHERE recall_count >= 10 AND type IN ('en', 'fr') UNION ALL SELECT 'archive', id FROM a WHERE recall_count = 0 AND created_at < TIMESTAMP '{AS_OF}' - INTERVAL 45 DAY AND coalesce(confidence, 'low') = 'low'
UNION ALL SELECT 'supersede', id FROM (SELECT id, row_number() OVER (PARTITION BY project, type ORDER BY recall_count DESC, created_at, id) AS n FROM a) WHERE n > 1 UNION ALL SELECT 'unpromote', id FROM a WHERE type IN ('en', 'fr') AND recall_count BETWEEN 1 AND 2""")
def review(t):
    """The plan of a dry run: every action that would be taken on a row."""
    rows = t.learnings
    return lc.review(rows, {"en": "rules", "fr": "notes"}, 10, 2, AS_OF, 45, ["project", "type"])


@query("LKP15_reclassify", LEARNINGS + "SELECT id, type FROM learnings WHERE type = 'fr' AND superseded_by IS NULL ORDER BY created_at DESC, id LIMIT 25")
def reclassify(t):
    return m.active(t.learnings, archived=False).where("type = 'fr'").orderBy(F.desc("created_at"), "id").limit(25).select("id", "type")


@query("LKP21_transcript_summary", f"""WITH e AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS back FROM conversations) SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS asked, max(text) FILTER (role = 'user' AND back = 1) AS last_request, max(length(text)) FILTER (role = 'assistant' AND back = 1) AS last_answer_size FROM e GROUP BY 1""")
def transcript_summary(t):
    said = lambda role, what: F.max_by(F.when(F.col("role") == role, what), F.when(F.col("role") == role, F.col("turn")))
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("asked"), said("user", F.col("text")).alias("last_request"), said("assistant", F.length("text")).cast("long").alias("last_answer_size"))


@query("LKP22_unmarked", "SELECT doc_id FROM documents d WHERE NOT regexp_matches(text, '[0-9]{3,}') AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) ORDER BY doc_id LIMIT 50")
def unmarked(t):
    """Rows to mark as having no entities: none was found, and they are not marked yet."""
    found = t.texts.where(F.col("text").rlike("[0-9]{3,}")).select("doc_id")
    return t.documents.select("doc_id").join(found, "doc_id", "left_anti").join(t.labels, "doc_id", "left_anti").orderBy("doc_id").limit(50)


@query("SNK16_json", "SELECT doc_id, '{\"id\":' || doc_id || ',\"project\":\"' || source || '\",\"preview\":\"' || sha256(text)[1:8] || '\"}' AS line FROM documents")
def json_lines(t):
    shown = F.substring(F.sha2("text", 256), 1, 8)
    return t.documents.select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("id"), F.col("source").alias("project"), shown.alias("preview"))).alias("line"))


@query("SNK16_human", "SELECT source, string_agg('[' || lang || '] #' || doc_id || ' (' || n_chars || ')', chr(10) ORDER BY doc_id) AS shown FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 5 GROUP BY 1")
def human_lines(t):
    line = F.concat(F.lit("["), "lang", F.lit("] #"), F.col("doc_id").cast("string"), F.lit(" ("), F.col("n_chars").cast("string"), F.lit(")"))
    top = sc.top_per_key(t.documents.select("source", "doc_id", line.alias("line")), "source", [F.col("doc_id")], 5)
    return top.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda s: s["line"]), "\n").alias("shown"))


@query("SNK17_markers", "WITH p AS (SELECT p_partkey, p_name || chr(10) || '<!-- m' || (p_partkey % 3) || ' -->' || chr(10) || p_brand AS body FROM part) SELECT p_partkey, CASE WHEN contains(body, '<!-- m1 -->') THEN replace(body, chr(10) || '<!-- m1 -->', '') ELSE body || chr(10) || '<!-- m9 -->' END AS body FROM p")
def markers(t):
    """A block is spliced out where its marker is; a line is appended where it is absent."""
    body = F.concat("p_name", F.lit("\n<!-- m"), (F.col("p_partkey") % 3).cast("string"), F.lit(" -->\n"), "p_brand")
    rows = t.part.select("p_partkey", body.alias("body"))
    gone = tx.without_line(F.col("body"), "<!-- m1 -->")
    return rows.select("p_partkey", F.when(gone != F.col("body"), gone).otherwise(tx.with_line(F.col("body"), "<!-- m9 -->")).alias("body"))


@query("NUM_sorts", "SELECT user_id, array_to_string(list(event_id ORDER BY value, event_id)[1:5], ',') AS argsort, array_to_string(list_sort(list(value))[1:3], ',') AS smallest, count(*) FILTER (value < 50) AS searchsorted FROM events GROUP BY 1")
def sorts(t):
    first = sc.top_per_key(t.events.select("user_id", "event_id", "value"), "user_id", [F.col("value"), F.col("event_id")], 5).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rank", "event_id", "value"))).alias("a"))
    show = F.array_join(F.transform("a", lambda s: s["event_id"].cast("string")), ",")
    low = F.array_join(F.transform(F.slice("a", 1, 3), lambda s: F.regexp_replace(s["value"].cast("string"), r"\.0$", ".0")), ",")
    counts = t.events.groupBy("user_id").agg(F.count_if(F.col("value") < 50).alias("searchsorted"))
    return first.select("user_id", show.alias("argsort"), low.alias("smallest")).join(counts, "user_id")


@query("NUM_sums", "SELECT l_orderkey, round(sum(l_quantity), 4) AS total, round(product(1 + l_discount), 9) AS prod, round(sum(l_tax) FILTER (l_tax > 0), 6) AS nansum FROM lineitem GROUP BY 1")
def sums(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.round(F.sum("l_quantity"), 4).alias("total"), F.round(F.product(1 + F.col("l_discount")), 9).alias("prod"), F.round(F.sum(F.when(F.col("l_tax") > 0, F.col("l_tax"))), 6).alias("nansum"))


@query("NUM_cumprod", "SELECT l_orderkey, l_linenumber, round(product(1 + l_discount) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING), 9) AS cumprod FROM lineitem")
def cumprod(t):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(F.product(1 + F.col("l_discount")).over(w), 9).alias("cumprod"))


@query("NUM_sets", "WITH a AS (SELECT DISTINCT user_id AS x FROM events WHERE event_type = 'error' AND value > 90), b AS (SELECT DISTINCT user_id AS x FROM events WHERE event_type = 'click' AND value > 90) SELECT 'intersect' AS op, x FROM (SELECT x FROM a INTERSECT SELECT x FROM b) UNION ALL SELECT 'union', x FROM (SELECT x FROM a UNION SELECT x FROM b) UNION ALL SELECT 'diff', x FROM (SELECT x FROM a EXCEPT SELECT x FROM b) UNION ALL SELECT 'xor', x FROM ((SELECT x FROM a EXCEPT SELECT x FROM b) UNION (SELECT x FROM b EXCEPT SELECT x FROM a))")
def sets(t):
    one = lambda kind: t.events.where((F.col("event_type") == kind) & (F.col("value") > 90)).select(F.col("user_id").alias("x")).distinct()
    a, b = one("error"), one("click")
    parts = {"intersect": a.intersect(b), "union": a.union(b).distinct(), "diff": a.subtract(b), "xor": a.subtract(b).union(b.subtract(a))}
    out = None
    for name, part in parts.items():
        part = part.select(F.lit(name).alias("op"), "x")
        out = part if out is None else out.unionByName(part)
    return out


@query("NUM_products", "WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id < 20), m AS (SELECT a.vec_id AS row, b.vec_id AS col, sum(CAST(a.x AS DOUBLE) * b.x) AS v FROM e a JOIN e b ON a.i = b.i GROUP BY 1, 2) SELECT row, col, round(v, 6) AS v FROM m")
def products(t):
    """The matrix of all inner products of twenty vectors, as a join of (row, column, value) forms."""
    e = t.embeddings.where("vec_id < 20").select("vec_id", F.posexplode("embedding").alias("i", "x")).select("vec_id", "i", F.col("x").cast("double").alias("x"))
    return nm.matmul(e.select(F.col("vec_id").alias("row"), F.col("i").alias("col"), F.col("x").alias("v")), e.select(F.col("i").alias("row"), F.col("vec_id").alias("col"), F.col("x").alias("v"))).withColumn("v", F.round("v", 6))


@query("NUM_polynomials", "SELECT p_partkey, round(3.0 * p_size * p_size * p_size - 2.0 * p_size + 0.5, 6) AS value, round(9.0 * p_size * p_size - 2.0, 6) AS slope, round(0.75 * power(p_size, 4) - p_size * p_size + 0.5 * p_size, 6) AS area FROM part")
def polynomials(t):
    c = [3.0, 0.0, -2.0, 0.5]
    x = F.col("p_size").cast("double")
    return t.part.select("p_partkey", *[F.round(nm.polyval(p, x), 6).alias(name) for name, p in (("value", c), ("slope", nm.polyder(c)), ("area", nm.polyint(c)))])


@query("NUM_chi_square", "WITH o AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT a, sum(n) AS n FROM o GROUP BY 1), c AS (SELECT b, sum(n) AS n FROM o GROUP BY 1), t AS (SELECT sum(n) AS n FROM o), e AS (SELECT r.a, c.b, r.n * c.n / CAST(t.n AS DOUBLE) AS x FROM r, c, t) SELECT round(sum((coalesce(o.n, 0) - x) * (coalesce(o.n, 0) - x) / x), 6) AS chi2, CAST((SELECT count(*) - 1 FROM r) * (SELECT count(*) - 1 FROM c) AS BIGINT) AS df FROM e LEFT JOIN o ON o.a = e.a AND o.b = e.b")
def chi_square(t):
    return nm.chi_square(t.lineitem, "l_returnflag", "l_linestatus").withColumn("chi2", F.round("chi2", 6))


RANKED = "r AS (SELECT event_type, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS k FROM events)"


@query("NUM_rank_tests", f"WITH {RANKED}, g AS (SELECT event_type, count(*) AS c, sum(k) AS s FROM r GROUP BY 1), t AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM r) SELECT round(12.0 / (any_value(t.n) * (any_value(t.n) + 1)) * sum(s * s / c) - 3 * (any_value(t.n) + 1), 6) AS h FROM g, t")
def rank_tests(t):
    return nm.kruskal(t.events, "value", "event_type").select(F.round("h", 6).alias("h"))


@query("NUM_mann_whitney", "WITH e AS (SELECT event_type, value FROM events WHERE event_type IN ('click', 'error')), r AS (SELECT event_type, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS k FROM e) SELECT round(sum(k) FILTER (event_type = 'click') - count(*) FILTER (event_type = 'click') * (count(*) FILTER (event_type = 'click') + 1) / 2.0, 3) AS u FROM r")
def mann_whitney(t):
    return nm.mann_whitney(t.events, "value", "event_type", "click", "error").select(F.round("u", 3).alias("u"))


@query("NUM_ks", "WITH v AS (SELECT value AS x, count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (event_type = 'error') AS b FROM events WHERE event_type IN ('click', 'error') GROUP BY 1), c AS (SELECT sum(a) OVER (ORDER BY x) / CAST(sum(a) OVER () AS DOUBLE) AS fa, sum(b) OVER (ORDER BY x) / CAST(sum(b) OVER () AS DOUBLE) AS fb FROM v) SELECT round(max(abs(fa - fb)), 9) AS d FROM c")
def ks(t):
    return nm.ks_two(t.events, "value", "event_type", "click", "error").select(F.round("d", 9).alias("d"))


@query("NUM_interpolate", "WITH e AS (SELECT user_id, event_id, epoch(ts) AS x, CASE WHEN event_type = 'view' THEN value END AS y FROM events), w AS (SELECT *, last_value(CASE WHEN y IS NOT NULL THEN x END IGNORE NULLS) OVER b AS x0, last_value(y IGNORE NULLS) OVER b AS y0, first_value(CASE WHEN y IS NOT NULL THEN x END IGNORE NULLS) OVER f AS x1, first_value(y IGNORE NULLS) OVER f AS y1 FROM e WINDOW b AS (PARTITION BY user_id ORDER BY x, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY x, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT event_id, round(CASE WHEN x1 = x0 THEN y0 ELSE y0 + (y1 - y0) * (x - x0) / (x1 - x0) END, 5) AS y FROM w WHERE x0 IS NOT NULL AND x1 IS NOT NULL")
def interpolate(t):
    x = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = t.events.select("user_id", "event_id", x.alias("x"), F.when(F.col("event_type") == "view", F.col("value")).alias("y"))
    return nm.interpolate(rows, "user_id", "x", "y", "event_id").select("event_id", F.round("filled", 5).alias("y"))


@query("NUM_zscore", "SELECT event_id, round((value - avg(value) OVER (PARTITION BY event_type)) / stddev_pop(value) OVER (PARTITION BY event_type), 6) AS z FROM events")
def zscore(t):
    s = t.events.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return t.events.join(F.broadcast(s), "event_type").select("event_id", F.round((F.col("value") - F.col("m")) / F.col("s"), 6).alias("z"))


@query("NUM_bins", "SELECT CAST(floor(value / 10) AS BIGINT) AS x, CAST(json_extract(props, '$.k') AS INTEGER) // 20 AS y, count(*) AS n FROM events GROUP BY 1, 2")
def bins(t):
    return t.events.groupBy(F.floor(F.col("value") / 10).alias("x"), F.expr("cast(get_json_object(props, '$.k') as int) div 20").alias("y")).agg(F.count("*").alias("n"))


@query("NUM_functions", "SELECT p_partkey, round(tan(x) + asin(x / 100) + acos(x / 100) + atan(x) + sinh(x / 50) + cosh(x / 50) + asinh(x) + acosh(x + 1) + atanh(x / 100) + sqrt(x * x + 4), 6) AS trig, round(power(2, x / 10) + (exp(x / 1000) - 1) + ln(1 + x) + sqrt(x) + x * x + 1 / (x + 1), 6) AS logs, abs(x - 25) AS size, trunc(x / 3) AS trunc, round(radians(x), 9) AS rad FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x FROM part)")
def functions(t):
    x = F.col("p_size").cast("double")
    trig = F.tan(x) + F.asin(x / 100) + F.acos(x / 100) + F.atan(x) + F.sinh(x / 50) + F.cosh(x / 50) + F.asinh(x) + F.acosh(x + 1) + F.atanh(x / 100) + F.hypot(x, F.lit(2.0))
    logs = F.pow(F.lit(2.0), x / 10) + F.expm1(x / 1000) + F.log1p(x) + F.sqrt(x) + x * x + 1 / (x + 1)
    return t.part.select("p_partkey", F.round(trig, 6).alias("trig"), F.round(logs, 6).alias("logs"), F.abs(x - 25).alias("size"), (F.sign(x) * F.floor(F.abs(x / 3))).alias("trunc"), F.round(F.radians(x), 9).alias("rad"))
