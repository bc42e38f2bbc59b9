"""The mistake detector over events told as a transcript."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramite.operators import lineage as li
from engramite.operators import mistakes as mi
from engramite.plans.lineage import ENDS, EVENTS, FOLLOWS, LINEAGES, records
from engramite.plans.registry import query
from engramite.session import written

SAID = ["I was wrong about src/m0.py.", "Sorry, here it is.", "You are right, I made a mistake in the edit.", "All done.", "I was wrong?", "All done."]
ASKED = ["You changed the wrong file.", "From now on use tabs.", "You ran the wrong command.", "Thanks."]
RUN = ["", "", "pytest tests", "uv run pytest -x", "git restore src/m1.py"]


def _pick(values: list[str], k):
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


def transcript(t):
    """Views are calls of tools (an id for every three events), errors their results, clicks what the assistant says or thinks, purchases what the user says, signups are of the system."""
    kind, k = F.col("event_type"), F.col("k")
    made = records(t, lambda near: F.when(k == 23, None).when(k % 20 == 0, near[3]).otherwise(near[1]))
    rows = written(li.annotate(made, "user_id", "uuid", "parent", "line", kind != "signup", kind == "purchase"))
    tool = F.when(kind.isin("view", "error"), F.concat(F.lit("t"), F.expr("line div 3").cast("string")))
    matched = li.correlate(rows.withColumn("tool", tool), "user_id", "tool", kind == "view", "line")
    use, say = kind == "view", kind == "click"
    name = F.when(use, F.element_at(F.array(*map(F.lit, ["Edit", "Write", "Bash", "Bash", "Bash"])), (k % 5 + 1).cast("int")))
    edits = use & (k % 5 < 2)
    fields = F.when(edits, F.create_map(F.lit("file_path"), F.concat(F.lit("src/m"), (k % 3).cast("string"), F.lit(".py")))).when(use, F.create_map(F.lit("command"), _pick(RUN, k))).otherwise(F.create_map().cast("map<string,string>"))
    failure = F.when(k % 7 == 0, F.lit("connection refused")).otherwise(F.concat(F.lit("FAILED src/m"), (k % 3).cast("string"), F.lit(".py")))
    text = F.when(say & (k == 51), "This check should fail first.").when(say, _pick(SAID, k)).when(kind == "purchase", _pick(ASKED, k)).when(kind == "error", failure)
    made = matched.select(
        F.col("user_id").alias("session"), F.col("line").alias("no"), "uuid", "status", "anchor", "enter", "exit", "partner",
        F.when(use | say, "assistant").when(kind == "purchase", "human").when(kind == "error", "tool").otherwise("system").alias("actor"),
        F.when(use, "tool_use").when(kind == "error", "tool_result").when(say & (k % 4 == 0), "thinking").when(say | (kind == "purchase"), "text").otherwise("metadata").alias("kind"),
        name.alias("name"), fields.alias("fields"), text.alias("text"), F.when(kind == "error", k % 2 == 0).alias("is_error"),
    )
    events = written(made.withColumns(mi.tool_columns(F.col("fields"))).drop("fields"))
    turns = rows.select(F.col("user_id").alias("session"), "uuid", "status", "anchor", "above")
    return events, li.event_parents(events, turns, "session", "uuid", "no")


_LINEAGES = LINEAGES.replace(FOLLOWS, "CASE WHEN k = 23 THEN NULL WHEN k % 20 = 0 THEN b3 ELSE b1 END")
_ENDS = ENDS.replace("k // 12", "line // 3").replace("event_type IN ('view', 'click')", "event_type = 'view'").replace("event_type <> 'signup'", "event_type IN ('view', 'error')")


def _share(a: str, b: str, at: str = "", bt: str = "") -> str:
    x, y, u, v = f"{a}.{at}enter", f"{a}.{at}exit", f"{b}.{bt}enter", f"{b}.{bt}exit"
    return f"(({x} <= {u} AND {v} <= {y}) OR ({u} <= {x} AND {y} <= {v}))"


DETECTED = f"""WITH RECURSIVE {_LINEAGES}, {_ENDS}, {EVENTS},
ev0 AS MATERIALIZED (SELECT a.user_id AS s, a.line AS no, a.uuid, a.event_type AS t, a.k, a.enter, a.exit, r.partner, a.event_type = 'error' AND a.k % 2 = 0 AS failed, a.event_type = 'view' AND a.k % 5 < 2 AS edits, a.event_type = 'view' AND a.k % 5 = 4 AS reverts,
  a.event_type = 'view' AND a.k % 5 IN (2, 3) AS checks, a.event_type = 'view' AND a.k % 5 >= 2 AS bash, CASE WHEN a.k % 5 < 2 THEN a.k % 5 * 10 + a.k % 3 ELSE 100 + a.k % 5 END AS call, a.k % 3 AS file,
  a.event_type = 'click' AND a.k % 6 IN (0, 2) AS admits, a.event_type = 'click' AND a.k % 4 = 0 AS thinks, a.event_type = 'purchase' AND a.k % 4 IN (0, 2) AS corrects FROM ann a JOIN res r ON r.event_id = a.event_id),
ev AS MATERIALIZED (SELECT e.*, e.partner IS NOT NULL AND NOT p.failed AS ok, p.enter AS penter, p.exit AS pexit FROM ev0 e LEFT JOIN ev0 p ON p.s = e.s AND p.no = e.partner),
bk AS MATERIALIZED (SELECT s, no, a AS o, d FROM lin WHERE d <= 64), fw AS MATERIALIZED (SELECT * FROM (SELECT s, a AS no, no AS o, row_number() OVER (PARTITION BY s, a ORDER BY no) AS n FROM lin WHERE no > a) WHERE n <= 64),
fl AS MATERIALIZED (SELECT c.*, f.no AS fno, f.checks AS fchecks, f.bash AS fbash, f.call AS fcall, f.k % 5 AS fk, f.enter AS fenter, f.exit AS fexit FROM ev c JOIN ev f ON f.s = c.s AND f.no = c.partner WHERE c.failed),
xp AS MATERIALIZED (SELECT DISTINCT c.s, c.no FROM fl c JOIN bk USING (s, no) JOIN ev o ON o.s = bk.s AND o.no = bk.o WHERE c.fchecks AND o.t = 'click' AND o.k = 51),
tr AS MATERIALIZED (SELECT DISTINCT c.s, c.no FROM fl c JOIN fw USING (s, no) JOIN ev e ON e.s = fw.s AND e.no = fw.o WHERE c.k % 7 = 0 AND e.t = 'view' AND e.call = c.fcall AND e.ok),
rt AS MATERIALIZED (SELECT c.s, c.no, arg_min(o.no, d) AS r FROM fl c JOIN bk USING (s, no) JOIN ev o ON o.s = bk.s AND o.no = bk.o WHERE c.fchecks AND (o.edits OR o.reverts) GROUP BY 1, 2),
ch AS MATERIALIZED (SELECT c.*, r.no AS r, r.edits AS redits, r.reverts AS rreverts, r.file AS rfile, r.call AS rcall FROM fl c JOIN rt ON rt.s = c.s AND rt.no = c.no JOIN ev r ON r.s = c.s AND r.no = rt.r
  WHERE r.ok AND r.no < r.partner AND r.partner < c.fno AND c.fno < c.no AND {_share('c', 'r')} AND {_share('c', 'r', '', 'p')} AND {_share('c', 'c', '', 'f')}),
fx AS MATERIALIZED (SELECT c.s, c.no, min(e.no) AS x FROM ch c JOIN fw USING (s, no) JOIN ev e ON e.s = fw.s AND e.no = fw.o WHERE (e.edits OR e.reverts) AND e.ok AND e.no < e.partner
  AND (e.call = c.rcall OR (c.redits AND e.edits AND e.file = c.rfile) OR (c.redits AND e.reverts AND c.rfile = 1) OR (c.rreverts AND e.edits AND e.file = 1)) AND (e.reverts OR (c.redits AND c.k % 7 <> 0 AND c.file = c.rfile)) GROUP BY 1, 2),
ob AS MATERIALIZED (SELECT c.s, c.no, min(c.r) AS onset, arg_min(e.partner, e.no) AS recovery FROM ch c JOIN fx ON fx.s = c.s AND fx.no = c.no JOIN ev x ON x.s = c.s AND x.no = fx.x JOIN fw ON fw.s = c.s AND fw.no = c.no JOIN ev e ON e.s = fw.s AND e.no = fw.o
  WHERE e.checks AND e.call = c.fcall AND e.ok AND x.no < e.no AND x.partner < e.no AND e.no < e.partner AND {_share('c', 'e', '', 'p')} AND {_share('c', 'x')} AND {_share('c', 'x', '', 'p')} GROUP BY 1, 2),
re AS MATERIALIZED (SELECT c.s, c.no, min(c.fno) AS onset, arg_min(e.partner, e.no) AS recovery FROM fl c JOIN fw USING (s, no) JOIN ev e ON e.s = fw.s AND e.no = fw.o WHERE c.fbash AND e.bash AND e.call <> c.fcall AND ((c.fk IN (2, 3) AND e.checks) OR (c.fk = 4 AND e.reverts)) AND e.ok
  AND {_share('c', 'e', '', 'p')} GROUP BY 1, 2),
wd AS MATERIALIZED (SELECT * FROM ev WHERE admits OR corrects),
bo AS MATERIALIZED (SELECT w.s, w.no, min(d) AS border FROM wd w JOIN bk USING (s, no) JOIN ev o ON o.s = bk.s AND o.no = bk.o WHERE o.t IN ('purchase', 'signup') GROUP BY 1, 2),
ar AS MATERIALIZED (SELECT w.s, w.no, w.t, o.no AS o, d, o.t = 'view' AND w.t = 'click' AND w.k % 6 = 0 AND o.edits AND o.file = 0 AS named,
  o.t = 'view' AND d < coalesce(border, 1000) AND CASE WHEN w.t = 'click' THEN w.k % 6 = 2 AND (o.edits OR o.reverts) ELSE w.k % 4 = 2 AND o.bash END AS pointed FROM wd w JOIN bk USING (s, no) JOIN ev o ON o.s = bk.s AND o.no = bk.o LEFT JOIN bo ON bo.s = w.s AND bo.no = w.no),
dr AS MATERIALIZED (SELECT s, no, CASE WHEN count(*) FILTER (named) = 1 THEN max(o) FILTER (named) WHEN count(*) FILTER (pointed) = 1 THEN max(o) FILTER (pointed AND d <= 9) END AS root FROM ar GROUP BY 1, 2),
pv AS MATERIALIZED (SELECT w.s, w.no, w.k, arg_min(o.no, d) AS via FROM wd w JOIN bk USING (s, no) JOIN ev o ON o.s = bk.s AND o.no = bk.o WHERE w.t = 'click' AND NOT (o.uuid = w.uuid AND o.t = 'click' AND o.thinks) GROUP BY 1, 2, 3),
br AS MATERIALIZED (SELECT p.s, p.no, d.root AS bridged FROM pv p JOIN ev v ON v.s = p.s AND v.no = p.via JOIN dr d ON d.s = p.s AND d.no = p.via JOIN ev o ON o.s = p.s AND o.no = d.root
  WHERE v.corrects AND CASE WHEN p.k % 6 = 0 THEN o.edits AND o.file = 0 ELSE true END),
ro AS MATERIALIZED (SELECT w.s, w.no, coalesce(d.root, b.bridged) AS root FROM wd w LEFT JOIN dr d ON d.s = w.s AND d.no = w.no LEFT JOIN br b ON b.s = w.s AND b.no = w.no),
md AS MATERIALIZED (SELECT w.s, w.no, arg_min(e.partner, e.no) AS mended FROM wd w JOIN ro ON ro.s = w.s AND ro.no = w.no JOIN ev r ON r.s = ro.s AND r.no = ro.root JOIN fw ON fw.s = w.s AND fw.no = w.no JOIN ev e ON e.s = fw.s AND e.no = fw.o
  WHERE w.thinks AND e.t = 'view' AND e.ok AND {_share('w', 'e', '', 'p')} AND (e.call = r.call OR (r.edits AND e.edits AND e.file = r.file) OR (r.edits AND e.reverts AND r.file = 1) OR (r.reverts AND e.edits AND e.file = 1)) GROUP BY 1, 2),
al AS MATERIALIZED (SELECT e.s AS session, e.no, CASE WHEN e.t = 'click' AND NOT thinks AND k % 6 IN (1, 4) THEN 1 WHEN e.t = 'purchase' AND k % 4 = 1 THEN 2 WHEN xp.no IS NOT NULL THEN 3 WHEN tr.no IS NOT NULL THEN 4 WHEN ob.no IS NOT NULL THEN 5 WHEN re.no IS NOT NULL THEN 6
  WHEN admits AND thinks AND mended IS NOT NULL THEN 7 WHEN admits AND thinks THEN 8 WHEN corrects THEN 9 WHEN admits AND root IS NOT NULL THEN 10 WHEN admits THEN 11 END AS rule, ob.onset AS o5, ob.recovery AS r5, re.onset AS o6, re.recovery AS r6, root, mended FROM ev e
  LEFT JOIN xp ON xp.s = e.s AND xp.no = e.no LEFT JOIN tr ON tr.s = e.s AND tr.no = e.no LEFT JOIN ob ON ob.s = e.s AND ob.no = e.no LEFT JOIN re ON re.s = e.s AND re.no = e.no LEFT JOIN ro ON ro.s = e.s AND ro.no = e.no LEFT JOIN md ON md.s = e.s AND md.no = e.no)
SELECT session, no, CASE WHEN rule <= 4 THEN 'suppressed' WHEN rule IN (5, 10) THEN 'confirmed' WHEN rule = 7 THEN 'probable' ELSE 'unconfirmed' END AS outcome,
CASE rule WHEN 1 THEN 'admission' WHEN 2 THEN 'requirement_change' WHEN 3 THEN 'expected_failure' WHEN 4 THEN 'transient_failure' WHEN 5 THEN 'incorrect_change' WHEN 6 THEN 'invalid_command' WHEN 9 THEN 'user_correction' ELSE 'wrong_assumption' END AS category,
CASE WHEN rule = 5 THEN o5 WHEN rule = 6 THEN o6 WHEN rule IN (7, 8, 9, 10) THEN root END AS onset, CASE rule WHEN 5 THEN r5 WHEN 6 THEN r6 WHEN 7 THEN mended END AS recovery FROM al WHERE rule IS NOT NULL"""


@query("SEQ2_mistakes", DETECTED)
def mistakes(t):
    return mi.detect(*transcript(t))
