"""Lineages of one session in one task, for sessions that are small enough; the rounds of ``lineage`` do the larger ones.

Records are walked in plain Python, a session at a time, so a task holds one session of at most ``SESSION_ROWS`` rows
beside the stream of rows. What is found is what the rounds find, with one shuffle instead of two for each round.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

#: Rows of a session that one task walks.
SESSION_ROWS = 50_000

#: What a record is told, with the types; None is the type of its id.
TOLD = {"status": "string", "dangling_parent": "boolean", "ambiguous_parent": "boolean", "circle": None, "anchor": None, "above": None, "root": None, "depth": "long", "branch": "string", "branch_depth": "long", "fork": "boolean", "enter": "long", "exit": "long", "abandoned": "boolean"}
_ABOUT = ["above", "root", "depth", "branch", "branch_depth", "enter", "exit", "abandoned"]


def _circles(up: dict) -> dict:
    """Record to the least record of its circle, of those that are their own ancestors."""
    circle, seen = {}, {}
    for start in up:
        way, at = [], start
        while at is not None and at not in seen:
            seen[at] = start
            way.append(at)
            at = up[at]
        if at is not None and seen[at] == start:
            found = way[way.index(at) :]
            circle.update(dict.fromkeys(found, min(found)))
    return circle


def _anchors(up: dict, sem: dict) -> dict:
    """Record to the nearest semantic one at or above it."""
    anchor: dict = {None: None}
    for start in up:
        way, at = [], start
        while at not in anchor and not sem[at]:
            way.append(at)
            at = up[at]
        found = anchor[at] if at in anchor else at
        anchor[at] = found
        anchor.update(dict.fromkeys(way, found))
    return anchor


def _labels(turns: dict, order: dict, side: dict) -> dict:
    """Turn to its figures; ``turns`` gives the turn above each."""
    kids = defaultdict(list)
    for u, p in turns.items():
        kids[p].append(u)
    place = lambda u: (order[u] is not None, order[u] or 0, u)
    for of in kids.values():
        of.sort(key=place)
    info, clock, last = {}, 0, {}
    todo = [(u, u, 0, str(u), 0) for u in reversed(kids[None])]
    while todo:
        u, root, depth, branch, forks = todo.pop()
        if root is None:  # all below it are done
            info[u]["exit"] = clock
            continue
        info[u] = {"above": turns[u], "root": root, "depth": depth, "branch": branch, "branch_depth": forks, "enter": clock, "abandoned": False}
        if not side[u]:
            last[root] = max(last.get(root, ((False, 0), -1)), ((order[u] is not None, order[u] or 0), clock))
        clock += 1
        todo.append((u, None, 0, "", 0))
        below = kids.get(u, ())
        for c in reversed(below):
            named = hashlib.sha256(f"{branch}\0{c}".encode()).hexdigest()[:16] if len(below) > 1 else branch
            todo.append((c, root, depth + 1, named, forks + (len(below) > 1)))
    for u, x in info.items():
        x["abandoned"] = not side[u] and x["root"] in last and not x["enter"] <= last[x["root"]][1] < x["exit"]
    return info


def annotated(ids: list, parents: list, orders: list, sems: list, sides: list) -> dict[str, list]:
    """Columns of ``TOLD`` for the records of one session."""
    times = Counter(u for u in ids if u is not None)
    rows = {u: (p, o, sem, side) for u, p, o, sem, side in zip(ids, parents, orders, sems, sides, strict=True) if u is not None and times[u] == 1}
    up = {u: r[0] if times.get(r[0]) == 1 else None for u, r in rows.items()}
    circle = _circles(up)
    forest = {u: None if p in circle else p for u, p in up.items() if u not in circle}
    sem, order, side = ({u: r[k] for u, r in rows.items()} for k in (2, 1, 3))
    anchor = _anchors(forest, sem)
    info = _labels({u: anchor[p] for u, p in forest.items() if sem[u]}, order, side)
    children = Counter(p for p in forest.values() if p is not None)
    out: dict[str, list] = {c: [] for c in TOLD}
    for u in ids:
        row = rows.get(u) if u is not None else None
        at = anchor.get(u) if row and u in forest else None
        status = "no_uuid" if u is None else "duplicate_uuid" if row is None else "cyclic_ancestry" if u in circle else "no_semantic_ancestor" if at is None else "ok"
        known = {
            "status": status, "dangling_parent": bool(row) and row[0] is not None and row[0] not in times, "ambiguous_parent": bool(row) and times.get(row[0], 0) > 1,
            "circle": circle.get(u) if row else None, "anchor": at, "fork": bool(row) and children[u] > 1, "abandoned": False,
        }
        known |= {c: info[at][c] for c in _ABOUT} if at is not None else {}
        for c, column in out.items():
            column.append(known.get(c))
    return out


def annotate_table(types: dict[str, pa.DataType]):
    """A pass over one session: its columns but the last five (id, parent, order, semantic, sidechain), and what is told."""

    def run(table: pa.Table) -> pa.Table:
        *kept, ids, parents, orders, sems, sides = table.columns
        told = annotated(*[c.to_pylist() for c in (ids, parents, orders, sems, sides)])
        return pa.table([*kept, *[pa.array(told[c], types[c]) for c in TOLD]], names=[*table.column_names[:-5], *TOLD])

    return run


def parents_of(table: pa.Table) -> pa.Table:
    """(s, no, parent) of one session's rows (s, no, ok, own, u, anchor, above): the event before along the lineage."""
    s, nos, ok, own, ids, anchors, aboves = (c.to_pylist() for c in table.columns)
    above = {u: a for u, is_own, a in zip(ids, own, aboves, strict=True) if is_own}
    events = defaultdict(list)
    for no, placed, anchor in zip(nos, ok, anchors, strict=True):
        if placed and no is not None:
            events[anchor].append(no)
    rows, over = [], {}
    for anchor, found in events.items():
        found.sort()
        way, at = [], above.get(anchor)
        while at is not None and at not in events and at not in over:
            way.append(at)
            at = above.get(at)
        last = over[at] if at in over else max(events[at]) if at is not None else None
        over.update(dict.fromkeys(way, last))
        rows += zip(found, [last, *found[:-1]], strict=True)
    kind = table.schema.field(1).type
    return pa.table([pa.array([s[0]] * len(rows), table.schema.field(0).type), pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], kind)], names=["s", "no", "parent"])


def windows(limit: int, merge: list[str]):
    """A pass over one session's (s, u, p, signals): (s, u, seen, signals merged over the events before), by doubling."""

    def run(table: pa.Table) -> pa.Table:
        place = {u: i for i, u in enumerate(table.column(1).to_pylist())}
        n = len(place)  # the row after the last stands for none: it leads to itself and has nothing
        jump = np.array([*[place.get(p, n) for p in table.column(2).to_pylist()], n])
        least = np.iinfo(np.int64).min
        empty = [0 if how == "sum" else least for how in merge]
        step = [np.ones(n + 1, np.int64)] + [np.array([*[e if x is None else x for x in c.to_pylist()], e], np.int64) for c, e in zip(table.columns[3:], empty, strict=True)]
        step[0][n] = 0
        add = [np.add, *[np.add if how == "sum" else np.maximum for how in merge]]
        at, out = jump.copy(), [np.zeros(n + 1, np.int64), *[np.full(n + 1, e, np.int64) for e in empty]]
        for digit in range(limit.bit_length()):
            if limit >> digit & 1:
                out, at = [f(a, b[at]) for f, a, b in zip(add, out, step, strict=True)], jump[at]
            step, jump = [f(a, b[jump]) for f, a, b in zip(add, step, step, strict=True)], jump[jump]
        columns = [pa.array(c[:n], pa.int64(), mask=c[:n] == least) for c in out]
        return pa.table([table.column(0), table.column(1), *columns], names=["s", "u", "seen", *table.column_names[3:]])

    return run


def around(limit: int):
    """A pass over one session's (s, u, p, asked): (s, u, other, n, ahead) of the events before and after each asked one."""

    def run(table: pa.Table) -> pa.Table:
        s, ids, parents, asked = (c.to_pylist() for c in table.columns)
        up, is_asked, below = dict(zip(ids, parents, strict=True)), {u for u, a in zip(ids, asked, strict=True) if a}, Counter()
        rows = []
        for u in sorted(up):
            at, n, back = up[u], 0, u in is_asked
            while at is not None and n < limit:
                n += 1
                if back:
                    rows.append((u, at, n, False))
                if at < u and at in is_asked and below[at] < limit:
                    below[at] += 1
                    rows.append((at, u, below[at], True))
                at = up.get(at)
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((table.schema.field(1).type, table.schema.field(1).type, pa.int32(), pa.bool_()))]
        return pa.table([pa.array([s[0]] * len(rows), table.schema.field(0).type), *columns], names=["s", "u", "other", "n", "ahead"])

    return run
