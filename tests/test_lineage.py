"""Lineages against a walk over each session in plain Python."""

import hashlib
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from engramite.operators import lineage
from engramite.plans import library
from engramite.plans import lineage as plans
from engramite.plans.registry import Tables
from engramite.session import written
from tests.test_oracles import rows as plain_rows

SCHEMA = "session string, id string, up string, line long, turn boolean, side boolean, extra string, depth string"


def made(draw):
    """Sessions with forks, bridges, circles with tails, a long line, a star, and every defect."""
    rows = []
    for s in range(6):
        n = 40
        for i in range(n):
            up = None if i == 0 or draw.random() < 0.06 else f"{s}.{draw.randint(max(0, i - 4), i - 1)}"
            if draw.random() < 0.05:
                up = draw.choice([f"{s}.{min(n - 1, i + draw.randint(0, 6))}", "gone", f"{(s + 1) % 6}.1"])
            rows.append([f"s{s}", f"{s}.{i}", up, 1000 - i if s == 5 else i, draw.random() < 0.7, draw.random() < 0.2])
        for i in range(2):  # ids that stand twice, and children of one of them
            rows.append([f"s{s}", f"{s}.{draw.randint(0, n - 1)}", f"{s}.0", 50 + i, True, False])
        rows.append([f"s{s}", None, f"{s}.0", 60, True, False])
    rows += [["chain", f"c{i}", f"c{i - 1}" if i else None, i, i % 3 > 0, False] for i in range(150)]
    rows += [["star", f"t{i}", "t0" if i else None, i, True, i % 2 == 0] for i in range(120)]
    rows += [["comb", f"m{i}", f"m{(i - 1) // 2 * 2}" if i else None, i, True, False] for i in range(90)]  # a fork at every second
    rows += [["loop", f"l{i}", f"l{(i + 1) % 5}", i, True, False] for i in range(5)] + [["loop", "tail1", "l2", 6, True, False], ["loop", "tail2", "tail1", 7, False, False], ["loop", "self", "self", 8, True, False]]
    rows += [[None, "n", None, 0, True, False], [None, None, None, None, None, None], ["bridge", "b", None, 0, False, None], ["bridge", "b2", "b", 1, None, None]]
    draw.shuffle(rows)
    return [(*r, "x", "old") for r in rows]


def brute(rows):
    """(session, id) to the lineage of each id that stands once."""
    out, times = {}, Counter((s, u) for s, u, *_ in rows if s is not None and u is not None)
    one = {(s, u): (p, o, bool(turn), bool(side)) for s, u, p, o, turn, side, *_ in rows if times.get((s, u)) == 1}
    up = {k: (k[0], v[0]) if times.get((k[0], v[0])) == 1 else None for k, v in one.items()}
    circle = {}
    for k in up:
        seen, at = [], k
        while at is not None and at not in seen:
            seen.append(at)
            at = up[at]
        if at == k:
            circle[k] = min(u for _, u in seen)
    forest = {k: None if v is None or v in circle else v for k, v in up.items() if k not in circle}

    def nearest(k):
        while k is not None and not one[k][2]:
            k = forest[k]
        return k

    turns = {k: nearest(forest[k]) for k in forest if one[k][2]}
    kids = defaultdict(list)
    for k, v in turns.items():
        kids[k[0], v].append(k)
    for v in kids.values():
        v.sort(key=lambda k: (one[k][1], k[1]))
    info = {}
    for s in {k[0] for k in turns}:
        clock = 0
        stack = [(k, False, k, 0, k[1], 0) for k in reversed(kids[s, None])]
        while stack:
            k, leaving, root, depth, branch, b = stack.pop()
            if leaving:
                info[k]["exit"] = clock
                continue
            info[k] = {"root": root[1], "depth": depth, "branch": branch, "branch_depth": b, "enter": clock, "above": turns[k] and turns[k][1]}
            clock += 1
            stack.append((k, True, root, depth, branch, b))
            fork = len(kids[s, k]) > 1
            for c in reversed(kids[s, k]):
                stack.append((c, False, root, depth + 1, hashlib.sha256(f"{branch}\0{c[1]}".encode()).hexdigest()[:16] if fork else branch, b + fork))
    latest = {}
    for k in sorted(info, key=lambda k: one[k][1]):
        if not one[k][3]:
            latest[k[0], info[k]["root"]] = k
    on_way = set()
    for k in latest.values():
        while k is not None:
            on_way.add(k)
            k = turns[k]
    raw = Counter(v for v in forest.values() if v is not None)
    for k in one:
        a = nearest(k) if k in forest else None
        about = info.get(a, {})
        status = "cyclic_ancestry" if k in circle else "ok" if a else "no_semantic_ancestor"
        p = (k[0], one[k][0])
        out[k] = {
            "status": status, "circle": circle.get(k), "anchor": a and a[1], "dangling_parent": one[k][0] is not None and p not in times, "ambiguous_parent": times.get(p, 0) > 1, "fork": raw[k] > 1,
            "abandoned": bool(a) and not one[a][3] and (a[0], about["root"]) in latest and a not in on_way, **{c: about.get(c) for c in ("above", "root", "depth", "branch", "branch_depth", "enter", "exit")},
        }
    return out, times


def test_lineages_correlation_and_windows(spark, monkeypatch):
    monkeypatch.setattr(lineage, "CHAIN", 4)
    draw = random.Random(12)
    rows = made(draw)
    frame = spark.createDataFrame(rows, SCHEMA)
    marked = lineage.annotate(frame, "session", "id", "up", "line", F.col("turn"), F.col("side"))
    assert marked.columns[:7] == frame.columns[:7]
    from engramite.session import written

    marked = written(marked)
    got, (want, times) = marked.collect(), brute(rows)
    assert len(got) == len(rows)
    for r in got:
        if r.session is None or r.id is None:
            assert r.status == "no_uuid" and r.enter is None and not r.fork
        elif times[r.session, r.id] > 1:
            assert r.status == "duplicate_uuid" and r.anchor is None and r.circle is None
        else:
            expected = want[r.session, r.id]
            assert {k: r[k] for k in expected} == expected, (r, expected)
    assert max(r.depth or 0 for r in got) > 90 and max(r.branch_depth or 0 for r in got) > 30 and {r.circle for r in got} > {"l0", "self"}
    told = {r.session: r for r in lineage.counts(marked, "session", "id").collect()}
    assert told["loop"].circles == 2 and told["chain"].roots == 1 and told["s0"].duplicates >= 1

    # tool ids over the records: every id in every session, one of them more often than is allowed
    events = written(marked.withColumns({"no": F.row_number().over(lineage.Window.partitionBy("session").orderBy("line", "id")).cast("long")}))
    events = written(events.withColumns({"tool": F.when(F.col("session") == "star", F.lit("many")).when(F.col("no") % 11 > 0, (F.col("no") % 7).cast("string")), "at": F.when(F.col("no") % 5 == 0, -F.col("no")).otherwise(F.col("no"))}))
    use = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    for most in (lineage.MOST_ENDPOINTS, 100, None):
        matched = lineage.correlate(events, "session", "tool", use, "no", "at", most=most).withColumn("is_use", use).collect()
        assert len(matched) == len(rows)
        groups = defaultdict(list)
        for r in matched:
            if r.tool is not None and r.session is not None:
                groups[r.session, r.tool].append(r)
            else:
                assert r.partner is None and not r.ambiguous_id
        for ends in groups.values():
            uses, results = [r for r in ends if r.is_use], [r for r in ends if not r.is_use]
            over = most is not None and uses and results and len(ends) > most
            fits = {(u.no, r.no) for u in uses for r in results if not over and u.status == r.status == "ok" and u.enter <= r.enter and r.exit <= u.exit}
            of_use, of_result = Counter(u for u, _ in fits), Counter(r for _, r in fits)
            partner = {}
            for u, r in fits:
                if of_use[u] == of_result[r] == 1:
                    partner[u], partner[r] = r, u
            times_of = {r.no: r["at"] for r in ends}
            for r in ends:
                assert r.oversize_id == bool(over) and r.duplicate_id == (len(uses) > 1 or len(results) > 1)
                assert r.ambiguous_id == bool(over or max([0, *of_use.values(), *of_result.values()]) > 1)
                assert r.partner == partner.get(r.no) and r.candidates == (of_use if r.is_use else of_result)[r.no]
                if r.partner:
                    late = times_of[r.no] < times_of[r.partner]
                    assert r.negative == (times_of[r.no] != times_of[r.partner] and late != r.is_use)
    assert any(r.partner for r in matched) and any(r.negative for r in matched)

    # windows along lineages
    parents = written(lineage.event_parents(events, marked, "session", "id", "no"))
    up = {(r.session, r.no): r.parent for r in parents.collect()}
    ok = [r for r in events.collect() if r.status == "ok"]
    assert set(up) == {(r.session, r.no) for r in ok}
    turn_events = defaultdict(list)
    for r in sorted(ok, key=lambda r: r.no):
        turn_events[r.session, r.anchor].append(r.no)
    above = {(r.session, r.id): r.above for r in got if r.status == "ok" and r.id == r.anchor}
    for r in ok:
        own, at = turn_events[r.session, r.anchor], above[r.session, r.anchor]
        while at is not None and not turn_events.get((r.session, at)):
            at = above[r.session, at]
        before = own[own.index(r.no) - 1] if own[0] != r.no else at and turn_events[r.session, at][-1]
        assert up[r.session, r.no] == before
    for limit in (1, 5, 64):
        back = lineage.look_back(parents, "session", "no", "parent", limit, {"odd": (F.col("no") % 2).cast("long"), "best": F.col("no") % 10}, {"odd": "sum", "best": "max"})
        for r in back.collect():
            line, at = [], up[r.session, r.no]
            while at is not None and len(line) < limit:
                line.append(at)
                at = up[r.session, at]
            assert (r.seen, r.odd, r.best) == (len(line), sum(x % 2 for x in line), max((x % 10 for x in line), default=None))
    for limit in (1, 7):
        ahead = lineage.look_ahead(parents, "session", "no", "parent", limit, F.col("no") % 3 == 0, F.col("no") % 4 == 0)
        below = defaultdict(list)
        for s, no in up:
            at = up[s, no]
            while at is not None:
                if at < no:
                    below[s, at].append(no)
                at = up[s, at]
        found = {(r.session, r.no): r.after for r in ahead.collect()}
        assert set(found) == {k for k in up if k[1] % 3 == 0}
        for (s, no), after in found.items():
            if all(p is None or p < n for (x, n), p in up.items() if x == s):  # elsewhere some event precedes its parent
                assert after == min((x for x in sorted(below[s, no])[:limit] if x % 4 == 0), default=None)


def test_no_records(spark):
    none = lineage.annotate(spark.createDataFrame([], SCHEMA), "session", "id", "up", "line", F.col("turn"), F.col("side"))
    assert none.count() == 0 and lineage.counts(none, "session", "id").count() == 0


@pytest.fixture(scope="module")
def busy(spark, tmp_path_factory):
    """Events of long sessions, whose tool ids have some 250 endpoints each."""
    draw = random.Random(9)
    kinds = ["view", "click", "error", "purchase", "signup"]
    rows = [(n, datetime(2024, 1, 1) + timedelta(minutes=draw.randint(0, 9000)), n % 3, draw.choice(kinds), f'{{"k": {draw.randint(0, 39)}}}') for n in range(3600)]
    folder = tmp_path_factory.mktemp("busy")
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, props string").repartition(3).write.parquet(f"{folder}/events.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["JOI17_tool_events", "JOI17_correlation_counts"])
def test_tool_ids_with_many_endpoints_are_matched(spark, busy, name):
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{busy}/events.parquet/*.parquet'")
    most = con.sql("select max(n) from (select count(*) as n from events where event_type <> 'signup' group by user_id, cast(json_extract(props, '$.k') as integer) // 12)").fetchall()[0][0]
    assert most > lineage.MOST_ENDPOINTS
    assert plain_rows(library.QUERIES[name](spark, busy).toPandas()) == plain_rows(con.sql(library.ORACLES[name]).df())


def test_large_groups_are_summed_over_ranges(spark, busy):
    tool = F.when(F.col("event_type") != "signup", F.expr("k div 12"))
    rows = written(plans.annotated(Tables(spark, busy)).withColumn("tool", tool))
    use = F.col("event_type").isin("view", "click")
    # no group, some and all groups over ranges
    found = [sorted(map(tuple, lineage.correlate(rows, "user_id", "tool", use, "line", "ts", most_rows=most).collect()), key=repr) for most in (lineage.GROUP_ROWS, 200, 0)]
    assert found[0] == found[1] == found[2] and sum(r[-6] is not None for r in found[0]) > 100
