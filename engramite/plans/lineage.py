"""Queries of lineages: events stand for the records of sessions that name the record they follow."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from engramite.operators import lineage as li
from engramite.plans.registry import query
from engramite.session import written

#: Events as records: a user is a session, their events stand in order, and each follows one of the five before it, as
#: its number k says; some start anew (k = 23), name a record that is not there (k = 29), stand twice under one id
#: (k = 31) or follow a later record (k = 37, 38), which makes circles. Signups are no turns, purchases are sidechains.
FOLLOWS = "CASE WHEN k = 23 THEN NULL WHEN k = 29 THEN -event_id WHEN k = 37 THEN a1 WHEN k = 38 THEN a2 WHEN k % 5 = 0 THEN b5 WHEN k % 5 = 1 THEN b1 WHEN k % 5 = 2 THEN b2 WHEN k % 5 = 3 THEN b3 ELSE b4 END"
RECORDS = f"""k AS MATERIALIZED (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k, row_number() OVER w AS line, lag(event_id) OVER w AS b1, lag(event_id, 2) OVER w AS b2, lag(event_id, 3) OVER w AS b3, lag(event_id, 4) OVER w AS b4,
  lag(event_id, 5) OVER w AS b5, lead(event_id) OVER w AS a1, lead(event_id, 2) OVER w AS a2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
rec AS MATERIALIZED (SELECT user_id AS s, event_id, line, event_type, ts, k, CASE WHEN k = 31 AND b1 IS NOT NULL THEN b1 ELSE event_id END AS u, event_type <> 'signup' AS sem, event_type = 'purchase' AS side,
  {FOLLOWS} AS p FROM k)"""


def _follows(near):
    k = F.col("k")
    parent = F.when(k == 23, None).when(k == 29, -F.col("event_id")).when(k == 37, near[-1]).when(k == 38, near[-2])
    for rest, n in ((0, 5), (1, 1), (2, 2), (3, 3)):
        parent = parent.when(k % 5 == rest, near[n])
    return parent.otherwise(near[4])


def records(t, follows=_follows):
    """Events as records; ``follows`` makes the parent of the ids near by."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    near = {n: (F.lag("event_id", n) if n > 0 else F.lead("event_id", -n)).over(w) for n in (1, 2, 3, 4, 5, -1, -2)}
    rows = t.events.select("user_id", "event_id", "event_type", "ts", k.alias("k"), F.row_number().over(w).cast("long").alias("line"), *[c.alias(f"near{n}") for n, c in near.items()])
    k, near = F.col("k"), {n: F.col(f"near{n}") for n in near}
    uuid = F.when((k == 31) & near[1].isNotNull(), near[1]).otherwise(F.col("event_id"))
    return rows.select("user_id", "event_id", "line", "event_type", "ts", "k", uuid.alias("uuid"), follows(near).alias("parent"))


def annotated(t):
    return li.annotate(records(t), "user_id", "uuid", "parent", "line", F.col("event_type") != "signup", F.col("event_type") == "purchase")


#: Circles by reachability, nearest turns by all steps up, branches from the roots down, intervals by the order of paths.
LINEAGES = RECORDS + """,
cnt AS MATERIALIZED (SELECT s, u, count(*) AS n FROM rec GROUP BY 1, 2),
nod AS MATERIALIZED (SELECT r.s, r.u, r.line AS o, r.sem, r.side, CASE WHEN q.n = 1 THEN r.p END AS p, r.p IS NOT NULL AND q.n IS NULL AS dangling, coalesce(q.n > 1, false) AS ambiguous
  FROM rec r JOIN cnt c ON c.s = r.s AND c.u = r.u AND c.n = 1 LEFT JOIN cnt q ON q.s = r.s AND q.u = r.p),
up AS MATERIALIZED (SELECT s, u, p AS a FROM nod WHERE p IS NOT NULL UNION SELECT r.s, r.u, x.p FROM up r JOIN nod x ON x.s = r.s AND x.u = r.a WHERE x.p IS NOT NULL),
cyc AS MATERIALIZED (SELECT s, u, min(least(u, m)) AS circle FROM (SELECT s, u, min(a) OVER (PARTITION BY s, u) AS m, a FROM up) WHERE a = u GROUP BY 1, 2),
fst AS MATERIALIZED (SELECT n.s, n.u, n.o, n.sem, n.side, CASE WHEN y.u IS NULL THEN n.p END AS p FROM nod n LEFT JOIN cyc c ON c.s = n.s AND c.u = n.u LEFT JOIN cyc y ON y.s = n.s AND y.u = n.p WHERE c.u IS NULL),
wlk AS MATERIALIZED (SELECT s, u, u AS a, sem, p AS nxt, 0 AS d FROM fst UNION ALL SELECT w.s, w.u, f.u, f.sem, f.p, w.d + 1 FROM wlk w JOIN fst f ON f.s = w.s AND f.u = w.nxt),
anc AS MATERIALIZED (SELECT s, u, arg_min(a, d) FILTER (sem) AS anchor, arg_min(a, d) FILTER (sem AND d > 0) AS above FROM wlk GROUP BY 1, 2),
trn AS MATERIALIZED (SELECT f.s, f.u, f.o, f.side, a.above AS p FROM fst f JOIN anc a ON a.s = f.s AND a.u = f.u WHERE f.sem),
kid AS MATERIALIZED (SELECT s, p, count(*) AS n FROM trn WHERE p IS NOT NULL GROUP BY 1, 2),
dwn AS MATERIALIZED (SELECT s, u, o, side, p, u AS root, CAST(0 AS BIGINT) AS depth, CAST(u AS VARCHAR) AS branch, CAST(0 AS BIGINT) AS bd, [o] AS path FROM trn WHERE p IS NULL UNION ALL
  SELECT t.s, t.u, t.o, t.side, t.p, d.root, d.depth + 1, CASE WHEN k.n > 1 THEN substr(sha256(d.branch || chr(0) || CAST(t.u AS VARCHAR)), 1, 16) ELSE d.branch END, d.bd + CASE WHEN k.n > 1 THEN 1 ELSE 0 END, list_append(d.path, t.o)
  FROM dwn d JOIN trn t ON t.s = d.s AND t.p = d.u JOIN kid k ON k.s = t.s AND k.p = t.p),
tup AS MATERIALIZED (SELECT s, u, u AS a, p AS nxt FROM trn UNION ALL SELECT w.s, w.u, t.u, t.p FROM tup w JOIN trn t ON t.s = w.s AND t.u = w.nxt),
siz AS MATERIALIZED (SELECT s, a AS u, count(*) AS n FROM tup GROUP BY 1, 2),
itv AS MATERIALIZED (SELECT d.*, row_number() OVER (PARTITION BY d.s ORDER BY path) - 1 AS enter, row_number() OVER (PARTITION BY d.s ORDER BY path) - 1 + z.n AS exit FROM dwn d JOIN siz z ON z.s = d.s AND z.u = d.u),
lst AS MATERIALIZED (SELECT s, root, arg_max(u, o) AS last FROM itv WHERE NOT side GROUP BY 1, 2),
way AS MATERIALIZED (SELECT l.s, x.a AS u FROM lst l JOIN tup x ON x.s = l.s AND x.u = l.last),
lab AS MATERIALIZED (SELECT i.*, NOT i.side AND l.last IS NOT NULL AND w.u IS NULL AS abandoned FROM itv i LEFT JOIN lst l ON l.s = i.s AND l.root = i.root LEFT JOIN way w ON w.s = i.s AND w.u = i.u),
frk AS MATERIALIZED (SELECT s, p AS u FROM fst WHERE p IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1),
ann AS MATERIALIZED (SELECT r.s AS user_id, r.event_id, r.line, r.event_type, r.ts, r.k, r.u AS uuid, r.p AS parent, CASE WHEN t.n > 1 THEN 'duplicate_uuid' WHEN c.u IS NOT NULL THEN 'cyclic_ancestry' WHEN a.anchor IS NULL THEN 'no_semantic_ancestor' ELSE 'ok' END AS status,
  coalesce(n.dangling, false) AS dangling_parent, coalesce(n.ambiguous, false) AS ambiguous_parent, c.circle, a.anchor, l.p AS above, l.root, l.depth, l.branch, l.bd AS branch_depth, f.u IS NOT NULL AS fork,
  CAST(l.enter AS BIGINT) AS enter, CAST(l.exit AS BIGINT) AS exit, coalesce(l.abandoned, false) AS abandoned
  FROM rec r JOIN cnt t ON t.s = r.s AND t.u = r.u LEFT JOIN nod n ON n.s = r.s AND n.u = r.u LEFT JOIN cyc c ON c.s = r.s AND c.u = r.u LEFT JOIN anc a ON a.s = r.s AND a.u = r.u
  LEFT JOIN lab l ON l.s = r.s AND l.u = a.anchor LEFT JOIN frk f ON f.s = r.s AND f.u = r.u)"""


@query("JOI18_lineages", f"WITH RECURSIVE {LINEAGES} SELECT user_id, event_id, uuid, status, dangling_parent, ambiguous_parent, circle, anchor, above, root, depth, branch, branch_depth, fork, enter, exit, abandoned FROM ann")
def lineages(t):
    return annotated(t).select(
        "user_id", "event_id", "uuid", "status", "dangling_parent", "ambiguous_parent", "circle", "anchor", "above", "root", "depth", "branch", "branch_depth", "fork", "enter", "exit", "abandoned"
    )


@query("JOI18_lineage_counts", f"""WITH RECURSIVE {LINEAGES} SELECT user_id, count(*) AS records, count(DISTINCT root) FILTER (status = 'ok') AS roots, count(DISTINCT uuid) FILTER (fork) AS forks, count(DISTINCT circle) AS circles,
count(*) FILTER (dangling_parent) AS dangling, count(*) FILTER (ambiguous_parent) AS ambiguous, count(DISTINCT uuid) FILTER (status = 'duplicate_uuid') AS duplicates, count(*) FILTER (status <> 'ok') AS invalid FROM ann GROUP BY 1""")
def lineage_counts(t):
    return li.counts(annotated(t), "user_id", "uuid")


#: Views and clicks use a tool, errors and purchases are results; the id is a twelfth of k.
ENDS = """ends AS MATERIALIZED (SELECT *, event_type IN ('view', 'click') AS used, CASE WHEN event_type <> 'signup' THEN 't' || CAST(k // 12 AS VARCHAR) END AS tool FROM ann),
prs AS MATERIALIZED (SELECT a.user_id, a.tool, a.line AS x, b.line AS y, a.ts > b.ts AS negative FROM ends a JOIN ends b ON a.user_id = b.user_id AND a.tool = b.tool AND a.used AND NOT b.used AND a.status = 'ok' AND b.status = 'ok' AND a.enter <= b.enter AND b.exit <= a.exit),
nx AS MATERIALIZED (SELECT user_id, tool, x, count(*) AS n, min(y) AS y FROM prs GROUP BY 1, 2, 3), ny AS MATERIALIZED (SELECT user_id, tool, y, count(*) AS n, min(x) AS x FROM prs GROUP BY 1, 2, 3),
amb AS MATERIALIZED (SELECT user_id, tool FROM nx GROUP BY 1, 2 HAVING max(n) > 1 UNION SELECT user_id, tool FROM ny GROUP BY 1, 2 HAVING max(n) > 1),
tls AS MATERIALIZED (SELECT user_id, tool, count(*) FILTER (used) > 1 OR count(*) FILTER (NOT used) > 1 AS twice FROM ends WHERE tool IS NOT NULL GROUP BY 1, 2),
cor AS MATERIALIZED (SELECT e.user_id, e.event_id, e.tool, e.used, CASE WHEN e.used AND nx.n = 1 AND py.n = 1 THEN nx.y WHEN NOT e.used AND ny.n = 1 AND px.n = 1 THEN ny.x END AS partner, coalesce(nx.n, ny.n, 0) AS candidates,
  coalesce(l.twice, false) AS duplicate_id, a.tool IS NOT NULL AS ambiguous_id, false AS oversize_id
  FROM ends e LEFT JOIN nx ON e.used AND nx.user_id = e.user_id AND nx.tool = e.tool AND nx.x = e.line LEFT JOIN ny py ON py.user_id = e.user_id AND py.tool = e.tool AND py.y = nx.y
  LEFT JOIN ny ON NOT e.used AND ny.user_id = e.user_id AND ny.tool = e.tool AND ny.y = e.line LEFT JOIN nx px ON px.user_id = e.user_id AND px.tool = e.tool AND px.x = ny.x
  LEFT JOIN tls l ON l.user_id = e.user_id AND l.tool = e.tool LEFT JOIN amb a ON a.user_id = e.user_id AND a.tool = e.tool),
res AS MATERIALIZED (SELECT c.*, coalesce(CASE WHEN c.used THEN o.ts < e.ts ELSE e.ts < o.ts END, false) AS negative FROM cor c JOIN ends e ON e.event_id = c.event_id LEFT JOIN ends o ON o.user_id = c.user_id AND o.line = c.partner)"""

def correlated(t):
    tool = F.when(F.col("event_type") != "signup", F.concat(F.lit("t"), F.expr("k div 12").cast("string")))
    return li.correlate(written(annotated(t)).withColumn("tool", tool), "user_id", "tool", F.col("event_type").isin("view", "click"), "line", "ts")


@query("JOI17_tool_events", f"WITH RECURSIVE {LINEAGES}, {ENDS} SELECT user_id, event_id, tool, partner, candidates, duplicate_id, ambiguous_id, oversize_id, negative FROM res")
def tool_events(t):
    return correlated(t).select("user_id", "event_id", "tool", "partner", "candidates", "duplicate_id", "ambiguous_id", "oversize_id", "negative")


@query("JOI17_correlation_counts", f"""WITH RECURSIVE {LINEAGES}, {ENDS} SELECT user_id, count(*) FILTER (tool IS NOT NULL AND partner IS NULL AND used) AS unmatched_uses, count(*) FILTER (tool IS NOT NULL AND partner IS NULL AND NOT used) AS orphan_results,
count(DISTINCT tool) FILTER (duplicate_id) AS duplicate_ids, count(DISTINCT tool) FILTER (ambiguous_id) AS ambiguous_ids, 0 AS oversize_ids, count(*) FILTER (negative AND used) AS negative_intervals, CAST(coalesce(sum(candidates) FILTER (used), 0) AS BIGINT) AS compatible_pairs FROM res GROUP BY 1""")
def correlation_counts(t):
    return li.correlation_counts(correlated(t), "user_id", "tool", F.col("event_type").isin("view", "click"))


#: The event before along a lineage: the one before of the same turn, or the last of the nearest turn above.
EVENTS = """evs AS MATERIALIZED (SELECT user_id AS s, line AS no, anchor, above, event_type FROM ann WHERE status = 'ok'), las AS MATERIALIZED (SELECT s, anchor, max(no) AS last FROM evs GROUP BY 1, 2),
par AS MATERIALIZED (SELECT e.s, e.no, e.event_type, coalesce(lag(e.no) OVER (PARTITION BY e.s, e.anchor ORDER BY e.no), l.last) AS p FROM evs e LEFT JOIN las l ON l.s = e.s AND l.anchor = e.above),
lin AS MATERIALIZED (SELECT s, no, p AS a, 1 AS d FROM par WHERE p IS NOT NULL UNION ALL SELECT l.s, l.no, x.p, l.d + 1 FROM lin l JOIN par x ON x.s = l.s AND x.no = l.a WHERE x.p IS NOT NULL)"""


def event_nodes(t):
    rows = written(annotated(t))
    parents = li.event_parents(rows, rows, "user_id", "uuid", "line")
    return written(parents.join(rows.select("user_id", "line", "event_type"), ["user_id", "line"]))


@query("WIN7_lineage_back", f"""WITH RECURSIVE {LINEAGES}, {EVENTS} SELECT p.s AS user_id, p.no AS line, count(l.a) AS seen, CAST(count(*) FILTER (x.event_type = 'click') AS BIGINT) AS clicks, max(l.a) FILTER (x.event_type = 'view') AS view_line
FROM par p LEFT JOIN lin l ON l.s = p.s AND l.no = p.no AND l.d <= 64 LEFT JOIN par x ON x.s = p.s AND x.no = l.a WHERE p.event_type = 'error' GROUP BY 1, 2""")
def lineage_back(t):
    nodes = event_nodes(t)
    kind = F.col("event_type")
    signals = {"clicks": F.when(kind == "click", 1).otherwise(0).cast("long"), "view_line": F.when(kind == "view", F.col("line"))}
    found = li.look_back(nodes, "user_id", "line", "parent", 64, signals, {"clicks": "sum", "view_line": "max"})
    return nodes.where("event_type = 'error'").select("user_id", "line").join(found, ["user_id", "line"])


@query("WIN7_lineage_ahead", f"""WITH RECURSIVE {LINEAGES}, {EVENTS}, blw AS MATERIALIZED (SELECT l.s, l.a AS no, l.no AS below, row_number() OVER (PARTITION BY l.s, l.a ORDER BY l.no) AS n FROM lin l JOIN par e ON e.s = l.s AND e.no = l.a AND e.event_type = 'error'
WHERE l.no > l.a) SELECT e.s AS user_id, e.no AS line, min(b.below) FILTER (x.event_type = 'purchase') AS after FROM par e LEFT JOIN blw b ON b.s = e.s AND b.no = e.no AND b.n <= 64 LEFT JOIN par x ON x.s = e.s AND x.no = b.below WHERE e.event_type = 'error' GROUP BY 1, 2""")
def lineage_ahead(t):
    kind = F.col("event_type")
    return li.look_ahead(event_nodes(t), "user_id", "line", "parent", 64, kind == "error", kind == "purchase")
