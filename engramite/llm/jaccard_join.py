"""N-gram Jaccard join: documents whose sets of word shingles are alike link, and links make classes.

Size-aware, heavy and light. A set of at most x shingles is light: two light sets link exactly when they have a
common subset of the size that their sizes demand, so all such fixed-size subsets are enumerated and equal ones meet.
A larger set is heavy: its rarest shingles (so many that any partner must share one) go to inverted lists, a list's
sets are candidates, and candidates are verified on their whole sets. x is where the summed cost of subsets and lists
over the sizes of all sets is least. Light sets that a heavy one can link with go to the lists too.

Nothing is done for each pair of a group. Equal sets are one node, and only the smallest id's row of a node is read
again. Only shingles that two nodes have are listed at all (``_runs``). At most a known number of a linked set's
shingles are its own, so a set with too few shared ones among its rarest links with nothing and is left out. Shingles that very many documents have are ordered last, so they are
among the rarest of hardly any set. In a list first the node that shares most is compared with all others; nodes
that are then of one class need no more comparisons, and each further round takes the next such node, until the
members of every list that are of different classes have been compared or ruled out: by their sizes, or by a bitmap of
the parities of their hashed elements, which differs in at most as many bits as the sets differ in elements.

Edge cases: null and empty texts have no shingles and link with nothing; with fewer words than a shingle has, the
whole sequence is one; rows with a null id are not linked and have a null class; repeated ids
are classed by their own texts; an empty table gives an empty result; other columns are ignored. Sets are told apart by a 64-bit hash.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramite.llm import _runs, _words
from engramite.llm._batches import let_go, short_batches, slices, tidy
from engramite.operators.components import connected_components, join_hot
from engramite.session import cut_lineage

#: Bytes of text in a run and of packed shingles in a part: small, as a run's sets are held together.
RUN_BYTES, PART_BYTES = 2 << 20, 1 << 20
#: The light sets have at most this many shingles, whatever the cost model says.
MOST_LIGHT = 24
#: Shingles known to be frequent, for the order of the inverted lists; the order of the others is by hash.
FREQUENT, FREQUENT_IN, COUNT_AT = 20_000, 4, 1_000_000
#: Rows shuffled for a listed shingle and for a verification, in units of one subset row.
LIST_COST, VERIFY_COST = 2, 30

_FACTORS = np.random.default_rng(271828).integers(0, 1 << 63, 64, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles."""
    _, _, _, words, border = _words.words_of(texts)
    n = len(words)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled[: max(0, n - k)] += words[k:] * _FACTORS[k]
    rolled = _words.mix(rolled)
    out = []
    for a, b in zip(border[:-1].tolist(), border[1:].tolist(), strict=True):
        if b - a >= width:
            own = np.sort(rolled[a : b - width + 1])  # much faster than numpy's unique
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            out.append(_words.mix(np.array([(words[a:b] * _FACTORS[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def node_of(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


#: Words of 64 bits in the bitmap of a set.
BITMAP = 64


def parities(tokens: np.ndarray) -> np.ndarray:
    """Bit i tells whether an odd number of elements hash to i."""
    odd = np.bincount((tokens & np.uint64(64 * BITMAP - 1)).astype(np.int64), minlength=64 * BITMAP) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


class Threshold:
    """Links at num * union <= den * intersection; all in whole numbers."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den

    def need(self, s: int, t: int) -> int:
        """Least common elements of linked sets of these sizes."""
        return -(-self.num * (s + t) // (self.num + self.den))

    def low(self, s: int) -> int:
        return -(-self.num * s // self.den)

    def high(self, s: int) -> int:
        return self.den * s // self.num

    def prefix(self, s: int) -> int:
        """So many elements of a set that a linked set lacks at least one fewer."""
        return s - self.low(s) + 1

    def extra(self, s: int) -> int:
        """So many more of the rarest elements are looked up. Of them all a linked set shares one more than that with its partner, so it need be listed under all its shared ones but that many."""
        return -(-s // 4)

    def subsets(self, s: int) -> int:
        return sum(comb(s, self.need(s, t)) for t in range(self.low(s), self.high(s) + 1))


def light_bound(sizes: dict[int, int], at: Threshold) -> int:
    """The x that costs least: sets up to x enumerate subsets, the others list and verify."""
    heavy = lambda s: at.prefix(s) * LIST_COST + VERIFY_COST
    best, cost, least = 0, 0, 0
    for x in range(1, MOST_LIGHT + 1):
        cost += sizes.get(x, 0) * (at.subsets(x) - heavy(x)) if at.subsets(x) < 1 << 20 else 1 << 60
        if cost <= least:
            best, least = x, cost
    return best


def _summarise(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(kind, id, node, n, bytes): kind 0 a row of the documents; kind 1 a shingle (node) that n documents of a task have."""
    schema = pa.schema([("kind", pa.int8()), ("id", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("bytes", pa.int64())])

    def frequent(parts: list[np.ndarray]) -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate(parts), return_counts=True)
        of = counts >= FREQUENT_IN
        m = int(of.sum())
        return pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int8)), pa.nulls(m, pa.int64()), pa.array(tokens[of].view(np.int64)), pa.array(counts[of]), pa.array(np.zeros(m, np.int64))], schema=schema)

    def run(batches):
        held, seen, size = [], set(), 0
        for batch in batches:
            for part in slices(batch):
                raws = [(t or "").encode("utf-8") for t in part.column(1).to_pylist()]
                sets = shingle_sets(raws, width)
                nodes = [node_of(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(raws), np.int8)), part.column(0), pa.array(nodes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([len(r) for r in raws], pa.int64())], schema=schema)
                for node, tokens in zip(nodes, sets, strict=True):
                    if node is not None and node not in seen:
                        seen.add(node)
                        held.append(tokens)
                        size += len(tokens)
                if size >= COUNT_AT:
                    yield frequent(held)
                    held, seen, size = [], set(), 0
        if held:
            yield frequent(held)

    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "kind byte, id long, node long, n long, bytes long")


class Order:
    """The order in which shingles count as rare: unknown ones by hash, then the frequent ones by their count."""

    def __init__(self, frequent: list[tuple[int, int]]) -> None:
        pairs = sorted((np.int64(t).view(np.uint64), c) for t, c in frequent)
        self.tokens = np.array([t for t, _ in pairs], np.uint64)
        self.counts = np.array([c for _, c in pairs], np.int64)

    def rarest(self, tokens: np.ndarray, k: int) -> np.ndarray:
        if not len(self.tokens):
            return tokens[:k]
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        count = np.where(self.tokens[at] == tokens, self.counts[at], 0)
        return tokens[np.lexsort((tokens, count))[:k]]


def _listed(table: pa.Table, reps: set[int], width: int, order: Order, at: Threshold, light: int) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], list[tuple[int, np.ndarray]]]:
    """Of the rows of a run that stand for a node: (node, set, rarest shingles) of those that go to lists, (node, set) of the light ones."""
    heavy, small, seen = [], [], set()
    for part in table.filter(pa.array([i in reps for i in table.column("id").to_pylist()], pa.bool_())).combine_chunks().to_batches():
        for piece in slices(part):
            for tokens in shingle_sets([t.encode("utf-8") for t in piece.column("text").to_pylist()], width):
                n = len(tokens)
                if n and (node := node_of(tokens)) not in seen:
                    seen.add(node)
                    if n <= light:
                        small.append((node, tokens))
                    if at.high(n) > light:
                        heavy.append((node, tokens, order.rarest(tokens, at.prefix(n) + at.extra(n))))
    return heavy, small


_POSTINGS = pa.schema([("kind", pa.int8()), ("token", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("m", pa.int64()), ("set", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])
_POSTINGS_DDL = "kind byte, token long, node long, n long, m long, set array<long>, bits array<long>"


def _subset_rows(node: int, tokens: np.ndarray, at: Threshold, light: int) -> list[tuple[int, int, int, int]]:
    """(key, node, n, least size of the key) for each fixed-size subset that a linked light set would share."""
    n, items, rows = len(tokens), tokens.tolist(), []
    for t in range(at.low(n), min(at.high(n), light) + 1):
        low, high = min(n, t), max(n, t)
        for chosen in combinations(items, at.need(low, high)):
            key = xxhash.xxh3_64_intdigest(np.array([low, high, *chosen], np.uint64).tobytes()) - (1 << 63)
            rows.append((key, node, n, low))
    return rows


def link(docs: DataFrame, width: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id): the size of each row's set and the smallest id of its class.

    Documents link when den * |intersection| >= num * |union| of their sets of distinct shingles of ``width`` words
    (runs of anything but ASCII white space, A-Z lower-cased).
    """
    at = Threshold(num, den)
    summary = cut_lineage(_summarise(docs, width, id_col, text_col))
    rows = summary.where("kind = 0")
    linkable = rows.where("node is not null and id is not null")
    frequent = summary.where("kind = 1").groupBy("node").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "node").limit(FREQUENT).collect()
    order = Order([(r["node"], r["n"]) for r in frequent])
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("rows")).first()
    sizes = {r["n"]: r["count"] for r in linkable.where(F.col("n") <= MOST_LIGHT).groupBy("n").count().collect()}
    light = light_bound(sizes, at)

    runs, bits = _runs.runs_for(total["b"], RUN_BYTES), _runs.part_bits(float(total["n"]) * (1.25 - num / den), PART_BYTES)
    texts = _runs.by_run(docs, runs, id_col, text_col)

    def sent(table: pa.Table, reps: pa.Table) -> pa.Table:
        if not table.num_rows or not reps.num_rows:
            return pa.table([[]] * 3, schema=_runs.SCHEMA)
        heavy, _ = _listed(table, set(reps.column("ids")[0].as_py()), width, order, at, light)
        tokens = np.concatenate([k for _, _, k in heavy]) if heavy else np.zeros(0, np.uint64)
        return _runs.send(table.column("run")[0].as_py(), tokens, np.repeat(np.arange(len(heavy)), [len(k) for _, _, k in heavy]), bits)

    def posted(table: pa.Table, back: pa.Table) -> pa.Table:
        lead = [x for x in back.column("ids").to_pylist() if x is not None]
        if not table.num_rows or not lead:
            return pa.table([[]] * 7, schema=_POSTINGS)
        heavy, small = _listed(table, set(lead[0]), width, order, at, light)
        out = [(2, key, node, n, low, None, None) for node, tokens in small for key, node, n, low in _subset_rows(node, tokens, at, light)]
        if heavy:
            tokens = np.concatenate([k for _, _, k in heavy])
            keep, edge = _runs.surviving(tokens, back, bits), 0
            for node, whole, listed in heavy:
                n, shared = len(whole), listed[keep[edge : edge + len(listed)]]
                edge += len(listed)
                if (needed := len(shared) - at.extra(n)) > 0:
                    # m: what is shared of the rarest, in thousandths
                    out += [(0, token, node, n, 1000 * len(shared) // len(listed), None, None) for token in shared[:needed].view(np.int64).tolist()]
                    out.append((1, None, node, n, None, whole.view(np.int64), parities(whole)))
        return pa.table([pa.array([r[k] for r in out], f.type) for k, f in enumerate(_POSTINGS)], schema=_POSTINGS)

    reps = linkable.groupBy("node").agg(F.min("id").alias("id")).groupBy(_runs.run_of("id", runs).alias("run")).agg(F.collect_list("id").alias("ids"))
    back = _runs.survivors(texts.groupBy("run").cogroup(reps.groupBy("run")).applyInArrow(tidy(sent), _runs.SENT))
    back = back.withColumn("ids", F.lit(None).cast("array<long>")).unionByName(reps.select(F.lit(-1).alias("part"), "run", F.lit(None).cast("binary").alias("tokens"), "ids"))
    made = cut_lineage(texts.groupBy("run").cogroup(back.groupBy("run")).applyInArrow(tidy(posted), _POSTINGS_DDL))
    del texts, back, reps
    let_go(docs.sparkSession)  # the texts by run are not needed any more
    links = _light_links(made.where("kind = 2")).unionByName(_heavy_links(made, at))
    classes = connected_components(links, "a", "b")
    let_go(docs.sparkSession)

    smallest = linkable.groupBy("node").agg(F.min("id").alias("id"))
    placed = cut_lineage(smallest.join(classes, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "id"))
    named = placed.join(placed.groupBy("component").agg(F.min("id").alias("component_id")), "component").select("node", "component_id")
    named = cut_lineage(named)  # two short plans in place of one that says all three times
    # all copies of a text are rows of one node
    found = join_hot(rows, named, "node", total["rows"], "left").select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
    return found.select(F.col("id").alias(id_col), "n_shingles", "component_id")


def _light_links(keys: DataFrame) -> DataFrame:
    """Sets with a subset key link with one of the key's least size: to it any other is near enough."""
    heads = keys.where("n = m").groupBy("token").agg(F.min("node").alias("a"))
    return keys.join(heads, "token").where("node <> a").select("a", F.col("node").alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, at: Threshold) -> DataFrame:
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    both = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("common"), (F.size("sa") + F.size("sb")).alias("sizes"))
    return both.where(F.lit(at.den) * F.col("common") >= F.lit(at.num) * (F.col("sizes") - F.col("common"))).select("a", "b")


#: Rounds in which one node of each list is compared with the rest, before what is left is compared pair by pair.
STAR_ROUNDS = 2


def _heavy_links(made: DataFrame, at: Threshold) -> DataFrame:
    posted = made.where("kind = 0").select("token", "node", "n", F.col("m").alias("shared"))
    sets = made.where("kind = 1").select("node", "set")
    near = lambda x, y: (F.lit(at.den) * F.least(x, y) >= F.lit(at.num) * F.greatest(x, y))
    # lists with the same nodes give the same pairs: one of them is enough
    same = F.count("*").alias("members"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64("node", F.lit(7))).alias("xor")
    links, done, lists = None, None, posted.withColumn("class", F.col("node"))
    for _ in range(STAR_ROUNDS):
        mixed = lists.groupBy("token").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.min(F.struct((-F.col("shared")).alias("s"), "node", "n", "class")).alias("head"), *same).where("low < high")
        mixed = mixed.groupBy("members", "sum", "xor").agg(F.min_by(F.struct("token", "head"), "token").alias("one")).select("one.token", "one.head")
        live = cut_lineage(lists.join(mixed, "token"))
        star = live.where((F.col("class") != F.col("head.class")) & near(F.col("n"), F.col("head.n")))
        pairs = star.select(F.least("node", "head.node").alias("a"), F.greatest("node", "head.node").alias("b")).distinct()
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = cut_lineage(pairs)
        found = cut_lineage(_verified(pairs, sets, at))
        done = pairs if done is None else done.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        classes = connected_components(links, "a", "b").withColumnRenamed("component", "joined")
        tried = done.select(F.col("a").alias("node")).unionByName(done.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("times"))
        # a node that has been compared often steps back as a head
        lists = live.join(classes, "node", "left").join(tried, "node", "left").withColumns({"class": F.coalesce("joined", "node"), "shared": F.col("shared") - 1000 * F.least(F.coalesce("times", F.lit(0)), F.lit(1000))})
        lists = cut_lineage(lists.select("token", "node", "n", "shared", "class"))
        del mixed, live, star, pairs, found, classes, tried
        let_go(made.sparkSession)
    mixed = lists.groupBy("token").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("token")
    live = lists.join(mixed, "token").join(made.where("kind = 1").select("node", "bits"), "node").select("token", "node", "n", "class", "bits")
    other = live.select("token", *[F.col(c).alias(f"{c}_2") for c in live.columns if c != "token"])
    differ = F.aggregate(F.zip_with("bits", "bits_2", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    open_ = (F.col("node") < F.col("node_2")) & (F.col("class") != F.col("class_2")) & near(F.col("n"), F.col("n_2"))
    open_ &= F.lit(at.num + at.den) * differ <= F.lit(at.den - at.num) * (F.col("n") + F.col("n_2"))
    pairs = live.join(other, "token").where(open_).select(F.col("node").alias("a"), F.col("node_2").alias("b")).distinct()
    return links.unionByName(_verified(pairs.join(done, ["a", "b"], "left_anti"), sets, at))
