"""Lineages of records: forests given by parent ids, their defects, interval labels, branches, and joins along them.

Records of a session name the record they follow. Nothing about the names is trusted: ids may be missing or stand
twice, parents may be missing, stand twice, or lead round in a circle. Every record keeps its row and gets its status.

All of it is done in rounds of grouped aggregates and equi-joins in which every row looks at one other row and then
takes over where that one looks (pointer doubling), so the number of rounds is logarithmic in the longest line of
descent or list, and no session is gathered. Each round ends in a table in the shared folder.

- Circles: looking 2, 4, 8 ... records up, rows whose line ends drop out; what stays leads into circles, and where the
  looks of that land, once they are no fewer than the round before, are the records of the circles.
- Interval labels: each record stands twice in the Euler tour of its forest, and list ranking counts how many records
  are entered before; a record's interval [enter, exit) holds those of its descendants and no others.
- Branches: a record below a fork starts a branch, whose id is a hash chained from the branch above; chains are taken
  ``CHAIN`` forks at a time.

Only siblings are put in order in one task each (the children of one record, rows of four values).

Sessions of at most ``most_rows`` rows (``lineage_tasks.SESSION_ROWS``) are walked whole in a task each, which takes one
shuffle in place of all rounds; the rounds are for the larger ones. Both find the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructType

from engramite.functions import ordered
from engramite.operators import lineage_tasks as tasks
from engramite.session import written

#: Forks whose branch ids are chained in one round.
CHAIN = 16
#: Endpoints of one tool id beyond which the surveyed code gives up; here a bound for those who ask for it.
MOST_ENDPOINTS = 128
#: Endpoints of one tool id in a session that are summed in one task; larger groups are summed over ranges.
GROUP_ROWS = 50_000


def _find(rows: DataFrame, pointer: str, there: DataFrame, names: dict[str, str], how: str = "inner") -> DataFrame:
    """rows with columns of the row of ``there`` whose u (in the same session) they point to, under new names."""
    looked = there.select(F.col("s").alias("s"), F.col("u").alias(pointer), *[F.col(a).alias(b) for a, b in names.items()])
    return rows.join(looked, ["s", pointer], how)


def _circles(raw: DataFrame) -> DataFrame | None:
    """(s, u, circle) of the records that are their own ancestors, with the least id of their circle; None if there are none."""
    live, before = raw.where("p is not null").select("s", "u", "p"), None
    while True:
        live = written(live)
        now = tuple(live.agg(F.count("*"), F.count_distinct("s", "p")).first())
        if not now[0]:
            return None
        if now == before:
            break
        before = now
        live = _find(live, "p", live, {"p": "q"}).select("s", "u", F.col("q").alias("p"))
    on = live.select("s", F.col("p").alias("u")).distinct()
    round_ = written(raw.join(on, ["s", "u"]).select("s", "u", "p", F.col("u").alias("circle")))
    while True:
        seen = _find(round_, "p", round_, {"circle": "c", "p": "q"})
        told = written(seen.select("s", "u", F.col("q").alias("p"), F.least("circle", "c").alias("circle"), (F.col("c") < F.col("circle")).alias("new")))
        settled = told.where("new").isEmpty()
        round_ = told.drop("new")
        if settled:
            return round_.select("s", "u", "circle")


def _anchors(forest: DataFrame) -> DataFrame:
    """(s, u, anchor): the nearest semantic record at or above each, or null."""
    state = forest.select("s", "u", F.when(F.col("sem"), F.col("u")).otherwise(F.col("p")).alias("anchor"), (F.col("sem") | F.col("p").isNull()).alias("done"))
    while True:
        state = written(state)
        waiting = state.where("not done")
        if waiting.isEmpty():
            return state.drop("done")
        moved = _find(waiting.select("s", "u", "anchor"), "anchor", state, {"anchor": "next", "done": "over"}).select("s", "u", F.col("next").alias("anchor"), F.col("over").alias("done"))
        state = state.where("done").unionByName(moved)


def _intervals(forest: DataFrame) -> DataFrame:
    """(s, u, enter, exit, depth) of a forest (s, u, p, o) in which children and roots stand in the order of o, by list ranking over its Euler tour."""
    order = Window.partitionBy("s", "p").orderBy("o", "u")
    linked = forest.withColumn("sibling", F.lead("u").over(order))
    first = forest.where("p is not null").groupBy("s", F.col("p").alias("u")).agg(F.min_by("u", F.struct("o", "u")).alias("child"))
    tour = linked.join(first, ["s", "u"], "left")
    child, sibling, up = F.col("child"), F.col("sibling"), F.col("p")
    enters = F.struct(F.lit(True).alias("inn"), F.coalesce(child, F.col("u")).alias("to"), child.isNotNull().alias("to_in"), F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("d"))
    leaves = F.struct(F.lit(False).alias("inn"), F.coalesce(sibling, up).alias("to"), sibling.isNotNull().alias("to_in"), F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("d"))
    state = written(tour.select("s", "u", F.explode(F.array(enters, leaves)).alias("e")).select("s", "u", "e.*"))
    while True:
        open_rows = state.where("to is not null")
        if open_rows.isEmpty():
            break
        there = state.select("s", F.col("u").alias("to"), F.col("inn").alias("to_in"), F.col("to").alias("then"), F.col("to_in").alias("then_in"), F.col("n").alias("more"), F.col("d").alias("deeper"))
        moved = open_rows.join(there, ["s", "to", "to_in"]).select("s", "u", "inn", F.col("then").alias("to"), F.col("then_in").alias("to_in"), (F.col("n") + F.col("more")).alias("n"), (F.col("d") + F.col("deeper")).alias("d"))
        state = written(state.where("to is null").unionByName(moved))
    # now n counts the records entered from here to the end of the session's tour, d how many more are entered than left
    both = state.groupBy("s", "u").agg(F.max(F.when(F.col("inn"), F.col("n"))).alias("a"), F.max(F.when(~F.col("inn"), F.col("n"))).alias("b"), F.max(F.when(F.col("inn"), -F.col("d"))).alias("depth"))
    total = forest.groupBy("s").agg(F.count("*").alias("all"))
    return both.join(total, "s").select("s", "u", (F.col("all") - F.col("a")).alias("enter"), (F.col("all") - F.col("b")).alias("exit"), "depth")


def _branches(forest: DataFrame) -> DataFrame:
    """(s, u, root, branch, branch_depth) of a forest (s, u, p)."""
    forks = forest.where("p is not null").groupBy("s", "p").agg(F.count("*").alias("children")).where("children > 1")
    split = forest.select("s", "u", "p").join(forks, ["s", "p"], "left")
    head = F.col("p").isNull() | F.col("children").isNotNull()
    state = split.select("s", "u", F.col("p").alias("up"), "p", F.when(F.col("p").isNull(), F.col("u")).alias("root"), F.when(head, F.col("u")).alias("head"), F.when(F.col("children").isNotNull(), 1).otherwise(0).cast("long").alias("b"))
    while True:
        state = written(state)
        open_rows = state.where("p is not null")
        if open_rows.isEmpty():
            break
        moved = _find(open_rows, "p", state, {"p": "p_", "root": "root_", "head": "head_", "b": "b_"})
        moved = moved.select("s", "u", "up", F.col("p_").alias("p"), F.col("root_").alias("root"), F.coalesce("head", "head_").alias("head"), (F.col("b") + F.col("b_")).alias("b"))
        state = state.where("p is null").unionByName(moved)
    nodes = state.drop("p")

    # heads of branches, each with the heads from it up to the next whose depth is a multiple of CHAIN
    heads = nodes.where("head = u and b > 0")
    tops = nodes.select("s", F.col("u").alias("up"), F.col("head").alias("above"))
    path = heads.join(tops, ["s", "up"]).select("s", "u", "b", F.col("above").alias("top"), F.array("u").alias("path"), (F.pmod(F.col("b") - 1, F.lit(CHAIN)) == 0).alias("done"))
    while True:
        path = written(path)
        open_rows = path.where("not done")
        if open_rows.isEmpty():
            break
        moved = _find(open_rows, "top", path, {"top": "t", "path": "before", "done": "over"}).select("s", "u", "b", F.col("t").alias("top"), F.concat("before", "path").alias("path"), F.col("over").alias("done"))
        path = path.where("done").unionByName(moved)

    def chained(start: Column) -> Column:
        return F.aggregate(F.transform("path", lambda x: x.cast("string")), start, lambda acc, x: F.substring(F.sha2(F.concat(acc, F.lit("\0"), x), 256), 1, 16))

    ids = nodes.where("head = u and b = 0").select("s", "u", F.col("u").cast("string").alias("branch"))
    deepest = path.agg(F.max("b")).first()[0] or 0
    found = [ids]
    for level in range(CHAIN, deepest + 1, CHAIN):
        ids = written(_find(path.where(F.col("b") == level), "top", ids, {"branch": "start"}).select("s", "u", chained(F.col("start")).alias("branch")))
        found.append(ids)
    base = found[0]
    for more in found[1:]:
        base = base.unionByName(more)
    rest = _find(path.where(F.pmod("b", F.lit(CHAIN)) != 0), "top", base, {"branch": "start"}).select("s", "u", chained(F.col("start")).alias("branch"))
    named = base.unionByName(rest)
    return _find(nodes, "head", named, {"branch": "branch"}).select("s", "u", "root", "branch", F.col("b").alias("branch_depth"))


def _parted(rows: DataFrame, session: str, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of sessions with ``most`` rows at most, and those of larger ones, if there are any; null sessions are in neither."""
    named = rows.where(F.col(session).isNotNull())
    large = named.groupBy(session).agg(F.count("*").alias("__n")).where(F.col("__n") > most).select(session)
    if most > 0 and large.isEmpty():
        return named, None
    return named.join(large, session, "left_anti"), named.join(large, session, "left_semi")


def annotate(records: DataFrame, session: str, uuid: str, parent: str, order: str, semantic: Column, sidechain: Column, most_rows: int = tasks.SESSION_ROWS) -> DataFrame:
    """Every record with its lineage: status, dangling_parent, ambiguous_parent, circle, anchor, above, root, depth, branch, branch_depth, fork, enter, exit, abandoned.

    ``semantic`` records (turns) are the nodes; others are bridges between them and take the nearest turn above as
    ``anchor``, whose figures they get; ``above`` is the turn above the anchor. ``status`` is ok, no_uuid (null id), duplicate_uuid, cyclic_ancestry or
    no_semantic_ancestor; only ok has a lineage. A parent that does not exist or stands twice makes a root; so does one
    in a circle. ``fork`` tells of several children in the forest of all records. A branch is ``abandoned`` if it is off
    the way from its root to the root's last turn that is no sidechain. All columns of ``records`` stay; the new ones
    replace those of their names. Null sessions have no lineage (no_uuid); an empty frame stays empty.
    """
    flag = lambda c: F.coalesce(c, F.lit(False))
    kind = records.schema[uuid].dataType
    if not isinstance(kind, (LongType, StringType)):  # others are written as text in ways of their own
        return _by_rounds(records, session, uuid, parent, order, semantic, sidechain)
    kept = records.drop(*tasks.TOLD)
    facts = [F.col(uuid), F.col(parent).cast(kind), F.col(order).cast("long"), flag(semantic), flag(sidechain)]
    rows = written(kept.select("*", *[c.alias(f"__{k}") for k, c in enumerate(facts)]), "lineage")
    small, large = _parted(rows, session, most_rows)
    types = {"string": StringType(), "boolean": BooleanType(), "long": LongType(), None: kind}
    told = {c: types[t] for c, t in tasks.TOLD.items()}
    schema = StructType(list(kept.schema.fields))
    for c, t in told.items():
        schema = schema.add(c, t)
    out = small.groupBy(session).applyInArrow(tasks.annotate_table({c: to_arrow_type(t) for c, t in told.items()}), schema)
    without = {"status": F.lit("no_uuid"), **{c: F.lit(False) for c, t in tasks.TOLD.items() if t == "boolean"}}
    nowhere = rows.where(F.col(session).isNull()).select(*kept.columns, *[without.get(c, F.lit(None)).cast(t).alias(c) for c, t in told.items()])
    out = out.unionByName(nowhere)
    if large is not None:
        out = out.unionByName(_by_rounds(large, session, uuid, "__1", order, F.col("__3"), F.col("__4")).select(*out.columns))
    return out


def _by_rounds(records: DataFrame, session: str, uuid: str, parent: str, order: str, semantic: Column, sidechain: Column) -> DataFrame:
    """``annotate`` for sessions of any size."""
    own = list(tasks.TOLD)
    flag = lambda c: F.coalesce(c, F.lit(False))
    base = records.select(F.col(session).alias("s"), F.col(uuid).alias("u"), F.col(parent).cast(records.schema[uuid].dataType).alias("p"), F.col(order).cast("long").alias("o"), flag(semantic).alias("sem"), flag(sidechain).alias("side")).where("s is not null and u is not null")
    known = written(base.groupBy("s", "u").agg(F.count("*").alias("times"), F.first("p").alias("p"), F.first("o").alias("o"), F.first("sem").alias("sem"), F.first("side").alias("side")))
    met = known.where("times = 1").drop("times").join(known.select("s", F.col("u").alias("p"), F.col("times").alias("there")), ["s", "p"], "left")
    named = F.col("p").isNotNull()
    nodes = written(met.select("s", "u", F.when(F.col("there") == 1, F.col("p")).alias("p"), "o", "sem", "side", (named & F.col("there").isNull()).alias("dangling"), flag(F.col("there") > 1).alias("ambiguous")))

    circles = _circles(nodes)
    forest = nodes
    if circles is not None:
        around = circles.select("s", "u", "circle")
        forest = nodes.join(around, ["s", "u"], "left_anti")
        forest = forest.join(around.select("s", F.col("u").alias("p"), F.col("circle").alias("up")), ["s", "p"], "left").withColumn("p", F.when(F.col("up").isNull(), F.col("p"))).drop("up")
        forest = written(forest)
    anchors = _anchors(forest)
    turns = forest.where("sem").select("s", "u", "p", "o", "side")
    turns = written(_find(turns, "p", anchors, {"anchor": "above"}, "left").select("s", "u", F.col("above").alias("p"), "o", "side"))
    labelled = turns.join(_intervals(turns), ["s", "u"]).join(_branches(turns), ["s", "u"])
    labelled = written(labelled)
    last = labelled.where("not side").groupBy("s", "root").agg(F.max_by("enter", F.struct("o", "enter")).alias("last"))
    on_way = (F.col("enter") <= F.col("last")) & (F.col("last") < F.col("exit"))
    labelled = labelled.join(last, ["s", "root"], "left").withColumn("abandoned", ~F.col("side") & F.col("last").isNotNull() & ~flag(on_way)).select("s", "u", F.col("p").alias("above"), "root", "depth", "branch", "branch_depth", "enter", "exit", "abandoned")
    raw_forks = forest.where("p is not null").groupBy("s", F.col("p").alias("u")).agg((F.count("*") > 1).alias("fork"))

    told = nodes.select("s", "u", "dangling", "ambiguous").join(anchors, ["s", "u"], "left").join(raw_forks, ["s", "u"], "left")
    told = told.join(circles, ["s", "u"], "left") if circles is not None else told.withColumn("circle", F.lit(None).cast(records.schema[uuid].dataType))
    told = _find(told, "anchor", labelled, {c: c for c in ("above", "root", "depth", "branch", "branch_depth", "enter", "exit", "abandoned")}, "left")
    told = known.select("s", "u", (F.col("times") > 1).alias("twice")).join(told, ["s", "u"], "left")
    status = F.when(F.col("__s").isNull(), "no_uuid").when(F.col("twice"), "duplicate_uuid").when(F.col("circle").isNotNull(), "cyclic_ancestry").when(F.col("anchor").isNull(), "no_semantic_ancestor").otherwise("ok")
    kept = records.drop(*own)
    new = {"dangling_parent": flag(F.col("dangling")), "ambiguous_parent": flag(F.col("ambiguous")), "fork": flag(F.col("fork")), "abandoned": flag(F.col("abandoned"))}
    joined = kept.join(told.withColumnsRenamed({"s": "__s", "u": "__u"}), (F.col(session) == F.col("__s")) & (F.col(uuid) == F.col("__u")), "left")
    return joined.select(*[kept[c] for c in kept.columns], status.alias("status"), *[new.get(c, F.col(c)).alias(c) for c in own[1:]])


def counts(annotated: DataFrame, session: str, uuid: str) -> DataFrame:
    """(session, records, roots, forks, circles, dangling, ambiguous, duplicates, invalid) of every session; ids that stand twice count once."""
    status = F.col("status")
    ok = status == "ok"
    return annotated.groupBy(session).agg(
        F.count("*").alias("records"), F.count_distinct(F.when(ok, F.col("root"))).alias("roots"), F.count_distinct(F.when(F.col("fork"), F.col(uuid))).alias("forks"),
        F.count_distinct("circle").alias("circles"), F.count_if("dangling_parent").alias("dangling"), F.count_if("ambiguous_parent").alias("ambiguous"),
        F.count_distinct(F.when(status == "duplicate_uuid", F.col(uuid))).alias("duplicates"), F.count_if(~ok).alias("invalid"),
    )


def correlate(endpoints: DataFrame, session: str, tool_id: str, is_use: Column, order: str, at: str | None = None, most: int | None = None, most_rows: int = GROUP_ROWS) -> DataFrame:
    """Tool uses and results with their partner: ``partner`` (the other's ``order``), ``duplicate_id``, ``ambiguous_id``, ``oversize_id``, ``candidates``, ``negative``.

    ``endpoints`` are annotated events (``enter``, ``exit``, ``status``) with a whole number ``order`` of their own in
    the session. A use and a result of one id can belong together if the use's record is the result's or above it. They
    are partners if the use has no other such result and the result no other such use. ``ambiguous_id`` tells of an id
    of which some endpoint has several candidates, ``duplicate_id`` of one used or answered twice. All are matched; only
    if ``most`` is given (``MOST_ENDPOINTS``, as surveyed), ids with more endpoints in a session are not, and are
    reported as ``oversize_id``. ``negative`` marks partners whose result's time (``at``) is before the use's. Null ids
    stay, without a partner.

    No pairs are made. Along a group's intervals, running sums of the uses that are open tell how many a result is
    under, and, if it is one, which one; the results counted between a use's enter and exit tell the same of the use.
    Groups of more than ``most_rows`` endpoints are summed over ranges, in many tasks.
    """
    own = ["partner", "candidates", "duplicate_id", "ambiguous_id", "oversize_id", "negative"]
    base = endpoints.drop(*own).withColumn("use", F.coalesce(is_use, F.lit(False)))
    named = base.where(F.col(tool_id).isNotNull() & F.col(session).isNotNull())
    sizes = named.groupBy(session, tool_id).agg(F.count_if("use").alias("uses"), F.count_if(~F.col("use")).alias("results"))
    sizes = sizes.withColumn("oversize_id", F.lit(False) if most is None else (F.col("uses") > 0) & (F.col("results") > 0) & (F.col("uses") + F.col("results") > most))
    sized = named.join(sizes, [session, tool_id])
    placed = sized.where(~F.col("oversize_id") & (F.col("status") == "ok")).select(session, tool_id, "use", F.col(order).alias("no"), "enter", "exit")
    mark = lambda pos, rank: F.struct(F.col(pos).alias("pos"), F.lit(rank).alias("rank"))
    steps = F.when(F.col("use"), F.array(mark("enter", 1), mark("exit", 0))).otherwise(F.array(mark("enter", 2)))
    walk = placed.withColumn("step", F.explode(steps)).select(session, tool_id, "use", "no", "step.pos", "step.rank")
    sign = F.when(F.col("rank") == 1, 1).when(F.col("rank") == 0, -1).otherwise(0)
    result = F.when(F.col("rank") == 2, 1).otherwise(0)
    sums = {"open": sign, "open_no": sign * F.col("no"), "met": result, "met_no": result * F.col("no")}
    along = Window.partitionBy(session, tool_id).orderBy("pos", "rank", "no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = lambda rows: rows.withColumns({name: F.sum(c).over(along) for name, c in sums.items()})
    large = sizes.where(~F.col("oversize_id") & (F.col("uses") + F.col("results") > most_rows)).select(session, tool_id)
    if large.isEmpty():
        summed = told(walk)
    else:
        by_ranges = ordered.sums_in_groups(walk.join(large, [session, tool_id], "left_semi"), [session, tool_id], ["pos", "rank", "no"], sums)
        summed = told(walk.join(large, [session, tool_id], "left_anti")).unionByName(by_ranges)
    side = F.when(F.col("rank") == 0, 1).when(F.col("rank") == 1, -1).otherwise(0)
    single = summed.groupBy(session, tool_id, "use", "no").agg(
        F.when(F.col("use"), F.sum(side * F.col("met"))).otherwise(F.max("open")).alias("candidates"), F.when(F.col("use"), F.sum(side * F.col("met_no"))).otherwise(F.max("open_no")).alias("other")
    )
    several = single.groupBy(session, tool_id).agg((F.max("candidates") > 1).alias("several"))
    sure = single.where("candidates = 1")
    back = sure.select(session, tool_id, (~F.col("use")).alias("use"), F.col("other").alias("no"), F.col("no").alias("partner"))
    partners = sure.join(back, [session, tool_id, "use", "no"]).where("partner = other").select(session, tool_id, F.col("no").alias(order), "use", "partner")
    found = single.select(session, tool_id, "use", F.col("no").alias(order), "candidates").join(partners, [session, tool_id, "use", order], "left")
    out = sized.join(found, [session, tool_id, "use", order], "left").join(several, [session, tool_id], "left")
    if at is not None:
        times = endpoints.select(F.col(session), F.col(order).alias("partner"), F.col(at).alias("__other"))
        out = out.join(times, [session, "partner"], "left").withColumn("negative", F.coalesce(F.when(F.col("use"), F.col("__other") < F.col(at)).otherwise(F.col(at) < F.col("__other")), F.lit(False)))
    else:
        out = out.withColumn("negative", F.lit(False))
    out = out.withColumns({
        "candidates": F.coalesce("candidates", F.lit(0).cast("long")), "duplicate_id": (F.col("uses") > 1) | (F.col("results") > 1),
        "ambiguous_id": F.coalesce("several", F.lit(False)) | F.col("oversize_id"),
    })
    columns = [*base.columns, *own]
    no = F.lit(False)
    unnamed = base.where(F.col(tool_id).isNull() | F.col(session).isNull()).withColumns({"partner": F.lit(None).cast("long"), "candidates": F.lit(0).cast("long"), "duplicate_id": no, "ambiguous_id": no, "oversize_id": no, "negative": no})
    return out.select(*columns).unionByName(unnamed.select(*columns)).drop("use")


def correlation_counts(correlated: DataFrame, session: str, tool_id: str, is_use: Column) -> DataFrame:
    """(session, unmatched_uses, orphan_results, duplicate_ids, ambiguous_ids, oversize_ids, negative_intervals, compatible_pairs) of every session."""
    alone = F.col(tool_id).isNotNull() & F.col("partner").isNull()
    ids = lambda c: F.count_distinct(F.when(F.col(c), F.col(tool_id)))
    return correlated.groupBy(session).agg(
        F.count_if(alone & is_use).alias("unmatched_uses"), F.count_if(alone & ~is_use).alias("orphan_results"), ids("duplicate_id").alias("duplicate_ids"), ids("ambiguous_id").alias("ambiguous_ids"),
        ids("oversize_id").alias("oversize_ids"), F.count_if(F.col("negative") & is_use).alias("negative_intervals"), F.coalesce(F.sum(F.when(is_use, F.col("candidates"))), F.lit(0)).alias("compatible_pairs"),
    )


def event_parents(events: DataFrame, annotated: DataFrame, session: str, uuid: str, order: str, most_rows: int = tasks.SESSION_ROWS) -> DataFrame:
    """(session, order, parent): for each event with a lineage the event before it along its lineage: of the same turn, else the last of the nearest turn above that has one.

    ``events`` have ``status`` and ``anchor`` of their record and a whole number ``order`` of their own in the session;
    ``annotated`` are all records. Events of a turn (and of the bridges below it) stand in the order of their number.
    """
    ok, own = F.col("status") == "ok", (F.col("status") == "ok") & (F.col(uuid) == F.col("anchor"))
    nothing = lambda c, of: F.lit(None).cast(of.schema[c].dataType).alias(c)
    both = events.where(ok).select(F.col(session).alias("s"), F.col(order).alias("no"), F.lit(True).alias("ok"), F.lit(False).alias("own"), nothing(uuid, annotated).alias("u"), "anchor", nothing("above", annotated))
    both = both.unionByName(annotated.where(own).select(F.col(session).alias("s"), nothing(order, events).alias("no"), F.lit(False).alias("ok"), F.lit(True).alias("own"), F.col(uuid).alias("u"), nothing("anchor", events), "above"))
    small, large = _parted(written(both), "s", most_rows)
    found = small.groupBy("s").applyInArrow(tasks.parents_of, StructType([small.schema["s"], small.schema["no"]]).add("parent", small.schema["no"].dataType)).toDF(session, order, "parent")
    if large is None:
        return found
    of = large.select(F.col("s").alias(session)).distinct()
    return found.unionByName(_parents_by_rounds(events.join(of, session, "left_semi"), annotated.join(of, session, "left_semi"), session, uuid, order))


def _parents_by_rounds(events: DataFrame, annotated: DataFrame, session: str, uuid: str, order: str) -> DataFrame:
    """``event_parents`` for sessions of any size."""
    placed = events.where("status = 'ok'").select(F.col(session).alias("s"), F.col("anchor").alias("u"), F.col(order).alias("no"))
    last = placed.groupBy("s", "u").agg(F.max("no").alias("last"))
    turns = annotated.where((F.col("status") == "ok") & (F.col(uuid) == F.col("anchor"))).select(F.col(session).alias("s"), F.col(uuid).alias("u"), F.col("above").alias("p"))
    turns = written(turns.join(last, ["s", "u"], "left"))
    nearest = _anchors(turns.select("s", "u", "p", F.col("last").isNotNull().alias("sem")))
    over = _find(turns.select("s", "u", "p"), "p", nearest, {"anchor": "at"}, "left").where("at is not null")
    over = _find(over.select("s", "u", "at"), "at", last, {"last": "over"}).select("s", "u", "over")
    rows = placed.withColumn("before", F.lag("no").over(Window.partitionBy("s", "u").orderBy("no"))).join(over, ["s", "u"], "left")
    return rows.select(F.col("s").alias(session), F.col("no").alias(order), F.coalesce("before", "over").alias("parent"))


def look_back(nodes: DataFrame, session: str, order: str, parent: str, limit: int, signals: dict[str, Column], merge: dict[str, str], most_rows: int = tasks.SESSION_ROWS) -> DataFrame:
    """(session, order, seen, signals): of each event, the signals of the events before it along its lineage, at most ``limit`` of them.

    ``signals`` are columns of an event, ``merge`` says how two of them become one: sum or max. Windows of 1, 2, 4 ...
    events are doubled by looking at the window where the pointer lands; those of the binary digits of ``limit`` are
    put together, so the rounds are as many as it has digits. Where order and signals are of type long, small sessions do so in their task.
    """
    names = list(signals)
    rows = written(nodes.select(F.col(session).alias("s"), F.col(order).alias("u"), F.col(parent).alias("p"), *[c.alias(n) for n, c in signals.items()]))
    if any(not isinstance(rows.schema[c].dataType, LongType) for c in ("u", "p", *names)):
        return _back_by_rounds(rows, limit, merge).toDF(session, order, "seen", *names)
    small, large = _parted(rows, "s", most_rows)
    schema = StructType([rows.schema["s"], rows.schema["u"]]).add("seen", LongType())
    for n in names:
        schema = schema.add(n, LongType())
    out = small.groupBy("s").applyInArrow(tasks.windows(limit, [merge[n] for n in names]), schema)
    return (out if large is None else out.unionByName(_back_by_rounds(large, limit, merge))).toDF(session, order, "seen", *names)


def _back_by_rounds(rows: DataFrame, limit: int, merge: dict[str, str]) -> DataFrame:
    """(s, u, seen, signals) of (s, u, p, signals), for sessions of any size."""
    join = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": lambda a, b: F.greatest(a, b)}
    names = rows.columns[3:]
    jump = written(rows.select("s", "u", "p", F.lit(1).cast("long").alias("seen"), *names))
    # windows begin at the event itself; what is asked for begins at its parent
    zero = [F.lit(0).cast("long").alias(n) if merge[n] == "sum" else F.lit(None).cast(jump.schema[n].dataType).alias(n) for n in names]
    out = jump.select("s", "u", F.col("p").alias("at"), F.lit(0).cast("long").alias("seen"), *zero)
    renamed = {n: f"{n}_" for n in ["seen", *names]}
    for digit in range(limit.bit_length()):
        if limit >> digit & 1:
            met = _find(out, "at", jump, {"p": "then", **renamed}, "left")
            out = met.select("s", "u", F.col("then").alias("at"), join["sum"](F.col("seen"), F.col("seen_")).alias("seen"), *[join[merge[n]](F.col(n), F.col(f"{n}_")).alias(n) for n in names])
            out = written(out)
        if limit >> digit + 1:
            met = _find(jump, "p", jump, {"p": "then", **renamed}, "left")
            jump = written(met.select("s", "u", F.col("then").alias("p"), join["sum"](F.col("seen"), F.col("seen_")).alias("seen"), *[join[merge[n]](F.col(n), F.col(f"{n}_")).alias(n) for n in names]))
    return out.select("s", "u", "seen", *names)


def around(nodes: DataFrame, session: str, order: str, parent: str, limit: int, asked: DataFrame, most_rows: int = tasks.SESSION_ROWS) -> tuple[DataFrame, DataFrame]:
    """``pairs_back`` and ``pairs_ahead`` of the asked events (s, u)."""
    rows = nodes.select(F.col(session).alias("s"), F.col(order).alias("u"), F.col(parent).alias("p"))
    rows = written(rows.join(asked.select("s", "u", F.lit(True).alias("asked")).distinct(), ["s", "u"], "left").select("s", "u", "p", F.col("asked").isNotNull().alias("asked")))
    small, large = _parted(rows, "s", most_rows)
    schema = StructType([rows.schema["s"], rows.schema["u"]]).add("other", rows.schema["u"].dataType).add("n", IntegerType()).add("ahead", BooleanType())
    pairs = written(small.groupBy("s").applyInArrow(tasks.around(limit), schema), "pairs")
    back, ahead = pairs.where("not ahead").drop("ahead"), pairs.where("ahead").drop("ahead")
    if large is not None:
        found = lines(large, "s", "u", "p", limit)
        back, ahead = back.unionByName(pairs_back(found, large.where("asked"))), ahead.unionByName(pairs_ahead(found, large.where("asked"), limit))
    return back, ahead


def lines(nodes: DataFrame, session: str, order: str, parent: str, limit: int) -> DataFrame:
    """(s, u, line): for each event the numbers of the ``limit`` events before it along its lineage, the nearest first; arrays are doubled."""
    up = written(nodes.select(F.col(session).alias("s"), F.col(order).alias("u"), F.col(parent).alias("p"), F.filter(F.array(F.col(parent)), lambda x: x.isNotNull()).alias("line")))
    reach = 1
    while reach < limit and not up.where("p is not null").isEmpty():
        met = _find(up, "p", up, {"p": "then", "line": "more"}, "left")
        up = written(met.select("s", "u", F.col("then").alias("p"), F.concat("line", F.coalesce("more", F.array().cast(up.schema["line"].dataType))).alias("line")))
        reach *= 2
    return up.select("s", "u", F.slice("line", 1, limit).alias("line"))


def pairs_back(found: DataFrame, asked: DataFrame) -> DataFrame:
    """(s, u, other, n): the events before each asked one (s, u), n = 1 for the nearest, from ``lines``."""
    return found.join(asked.select("s", "u").distinct(), ["s", "u"]).select("s", "u", F.posexplode("line").alias("n", "other")).withColumn("n", F.col("n") + 1)


def pairs_ahead(found: DataFrame, asked: DataFrame, limit: int) -> DataFrame:
    """(s, u, other, n): the ``limit`` next events of the branches below each asked one, in their order.

    An event follows its parent in this order, so the next ``limit`` are at most so many generations below: each event
    looks up that many, and each asked one keeps the first ``limit`` of those that name it.
    """
    named = found.select("s", F.col("u").alias("other"), F.explode("line").alias("u")).where("u < other").join(asked.select("s", "u").distinct(), ["s", "u"])
    return named.withColumn("n", F.row_number().over(Window.partitionBy("s", "u").orderBy("other"))).where(F.col("n") <= limit)


def look_ahead(nodes: DataFrame, session: str, order: str, parent: str, limit: int, asked: Column, wanted: Column, most_rows: int = tasks.SESSION_ROWS) -> DataFrame:
    """(session, order, after): for each ``asked`` event the first ``wanted`` one among the ``limit`` next events below it."""
    marks = nodes.select(F.col(session).alias("s"), F.col(order).alias("u"), asked.alias("asked"), wanted.alias("wanted"))
    _, near = around(nodes, session, order, parent, limit, marks.where("asked"), most_rows)
    found = near.join(marks.where("wanted").select("s", F.col("u").alias("other")), ["s", "other"]).groupBy("s", "u").agg(F.min("other").alias("after"))
    return marks.where("asked").select("s", "u").join(found, ["s", "u"], "left").select(F.col("s").alias(session), F.col("u").alias(order), "after")
