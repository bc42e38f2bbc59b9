"""Exact pairwise similarity of vectors by blocks.

Rows are dealt into blocks by a hash; each pair of blocks is one task that multiplies two matrices, ``TILE_ROWS`` rows
at a time. What a task holds is two blocks and the product of a tile, whatever the number of rows; what is kept of a
pair of blocks is decided inside the task. A row is shuffled once for each block, so blocks are large.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engramite.operators.components import connected_components
from engramite.session import scratch_path, written

#: Rows in a block, on average, and rows of one side that are multiplied at once.
BLOCK_ROWS, TILE_ROWS = 8192, 1024

#: A tile: ids of its rows and of its columns, the place of its first row and column, and the cosines.
Tile = tuple[np.ndarray, np.ndarray, int, int, np.ndarray]


def _unit(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and their vectors at unit length."""
    ids = table.column("id").combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)
    lists = table.column("v").combine_chunks()
    sizes = np.unique(lists.value_lengths().to_numpy(zero_copy_only=False))
    if len(sizes) > 1:
        raise ValueError(f"vectors of several lengths: {sizes[:9].tolist()}")
    rows = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), int(sizes[0]) if len(sizes) else 0)
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return ids, np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids in their order and their vectors at unit length."""
    ids, rows = _unit(table)
    order = np.argsort(ids, kind="stable")
    return ids[order], rows[order]


def block_pairs(df: DataFrame, key: str, embedding: str, pick: Callable[[Iterator[Tile], bool], pa.Table], schema: str, square: bool = False) -> DataFrame:
    """Apply ``pick(tiles, same)`` to each two blocks (and each with itself, then ``same``); with ``square`` tiles have as many columns as rows, else all columns."""
    blocks = max(1, -(-df.count() // BLOCK_ROWS))
    tile = TILE_ROWS
    rows = df.where(F.col(key).isNotNull() & F.col(embedding).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(embedding).alias("v"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"))
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    left = rows.select("id", "v", "block", F.explode(F.filter(every, lambda o: o >= F.col("block"))).alias("other"))
    # a block with itself is sent once
    right = rows.selectExpr("id as id2", "v as v2", f"explode(filter(sequence(0, {blocks - 1}), o -> o < block)) as block2", "block as other2").toDF("id", "v", "block", "other")

    def multiply(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        same = key[0].as_py() == key[1].as_py()
        ia, ma = _matrix(a)
        ib, mb = (ia, ma) if same else _matrix(b)

        def tiles() -> Iterator[Tile]:
            wide = tile if square else max(1, len(ib))
            for i in range(0, len(ia), tile):
                for j in range(0, len(ib), wide):
                    yield ia[i : i + tile], ib[j : j + wide], i, j, ma[i : i + tile] @ mb[j : j + wide].T

        return pick(tiles(), same)

    return left.groupBy("block", "other").cogroup(right.groupBy("block", "other")).applyInArrow(multiply, schema)


def _joined(parts: list[tuple], kinds: tuple) -> list[np.ndarray]:
    return [np.concatenate([p[k] for p in parts]).astype(kind) if parts else np.zeros(0, kind) for k, kind in enumerate(kinds)]


def _near(tiles: Iterator[Tile], same: bool, least: float) -> list[np.ndarray]:
    """a, b, similarity of the pairs of different ids at ``least`` or more, each once: those of two ids are all in one pair of blocks."""
    parts = []
    for ia, ib, first, _, cosine in tiles:
        i, j = np.nonzero(cosine >= least)
        if same:
            kept = first + i < j
            i, j = i[kept], j[kept]
        a, b = np.minimum(ia[i], ib[j]), np.maximum(ia[i], ib[j])
        kept = a < b
        parts.append((a[kept], b[kept], cosine[i, j][kept]))
    a, b, similarity = _joined(parts, (np.int64, np.int64, np.float64))
    order = np.lexsort((b, a))
    a, b, similarity = a[order], b[order], similarity[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return [a[fresh], b[fresh], similarity[fresh]]


def similar_pairs(df: DataFrame, least: float, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(a, b, similarity) with a < b for all pairs at ``least`` or more."""

    def pick(tiles, same):
        return pa.table(dict(zip(("a", "b", "similarity"), _near(tiles, same, least), strict=True)))

    return block_pairs(df, key, embedding, pick, "a long, b long, similarity double")


def near_counts(df: DataFrame, least: float, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, n): how many other ids are at ``least`` or more, of the ids that have any; counted inside the tasks."""

    def pick(tiles, same):
        a, b, _ = _near(tiles, same, least)
        ids, n = np.unique(np.concatenate([a, b]), return_counts=True)
        return pa.table({"id": ids, "n": n.astype(np.int64)})

    return block_pairs(df, key, embedding, pick, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _forest(cosine: np.ndarray, least: float) -> list[tuple]:
    """(row, column, similarity) of a heaviest spanning forest of the links between rows and columns, by Prim's algorithm."""
    rows, other = len(cosine), np.ascontiguousarray(cosine.T)
    n = rows + len(other)
    best, link, done, edges, fresh = np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n, bool), [], 0
    for _ in range(n):
        at = int(best.argmax())
        if best[at] >= least:
            edges.append((at, int(link[at]) - rows, best[at]) if at < rows else (int(link[at]), at - rows, best[at]))
        else:
            while done[fresh]:
                fresh += 1
            at = fresh
        done[at], best[at] = True, -np.inf
        over, part = (cosine[at], slice(rows, n)) if at < rows else (other[at - rows], slice(0, rows))
        closer = (over > best[part]) & ~done[part]
        best[part][closer], link[part][closer] = over[closer], at
    return edges


def _thinned(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which links a heaviest spanning forest of them has, by Kruskal's algorithm."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    root, kept = list(range(len(nodes))), np.zeros(len(a), bool)
    left, right = ends[: len(a)].tolist(), ends[len(a) :].tolist()
    for k in np.argsort(-weight, kind="stable").tolist():
        u, v = left[k], right[k]
        while root[u] != u:
            root[u] = u = root[root[u]]
        while root[v] != v:
            root[v] = v = root[root[v]]
        if u != v:
            root[u], kept[k] = v, True
    return kept


def spanning_pairs(df: DataFrame, least: float, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(a, b, similarity): as many of the pairs at ``least`` or more as tell the components at that and every higher level.

    Of each pair of blocks a heaviest spanning forest is kept, so there are fewer links than rows of the two blocks. A
    link left out has a way round it of links that are no lighter, so the components at any level are those of all pairs.
    """

    def pick(tiles, same):
        parts, held = [], 0
        for ia, ib, first, at, cosine in tiles:
            if same and at + len(ib) <= first:
                continue
            cosine = np.where(ia[:, None] == ib[None, :], -np.inf, cosine) if same else cosine
            near = cosine >= least
            if near.sum() <= 4 * (len(ia) + len(ib)):
                i, j = np.nonzero(near)
                weight = cosine[i, j]
            else:
                i, j, weight = _joined([tuple(np.array(c) for c in zip(*_forest(cosine, least), strict=True))], (np.int64, np.int64, np.float64))
            parts.append((ia[i], ib[j], weight))
            held += len(i)
            if held > 1 << 18:
                parts = [_joined(parts, (np.int64, np.int64, np.float64))]
                kept = _thinned(*parts[0])
                parts, held = [tuple(c[kept] for c in parts[0])], int(kept.sum())
        a, b, weight = _joined(parts, (np.int64, np.int64, np.float64))
        kept = _thinned(a, b, weight)
        return pa.table({"a": np.minimum(a, b)[kept], "b": np.maximum(a, b)[kept], "similarity": weight[kept]})

    return block_pairs(df, key, embedding, pick, "a long, b long, similarity double", square=True)


def density(df: DataFrame, levels: list[float], key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(level, pairs, pct): how many of all pairs are at each level or above; counted inside the tasks."""

    def pick(tiles, same):
        pairs, total = [0] * len(levels), 0
        for ia, ib, first, _, cosine in tiles:
            if same:  # each two rows once
                cosine = np.where(first + np.arange(len(ia))[:, None] < np.arange(len(ib))[None, :], cosine, -np.inf)
            pairs = [n + int((cosine >= x).sum()) for n, x in zip(pairs, levels, strict=True)]
            total += int(np.isfinite(cosine).sum())
        return pa.table({"level": levels, "pairs": pairs, "total": [total] * len(levels)})

    counts = block_pairs(df, key, embedding, pick, "level double, pairs long, total long").groupBy("level").agg(F.sum("pairs").alias("pairs"), F.sum("total").alias("total"))
    return counts.select("level", "pairs", F.round(F.lit(100.0) * F.try_divide(F.col("pairs"), F.col("total")), 4).alias("pct"))


def _first(own: np.ndarray, other: np.ndarray, value: np.ndarray, k: int) -> tuple:
    """The k greatest values of each own one, ties to the smallest other."""
    order = np.lexsort((other, -value, own))
    own, other, value = own[order], other[order], value[order]
    starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    place = np.arange(len(own)) - np.repeat(starts, np.diff(np.append(starts, len(own))))
    return own[place < k], other[place < k], value[place < k]


def _top(cosine: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the finite values that are no less than the k-th greatest of their row."""
    if cosine.shape[1] > k:
        bound = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, cosine.shape[1] - k]
        return np.nonzero((cosine >= bound[:, None]) & np.isfinite(cosine))
    return np.nonzero(np.isfinite(cosine))


def nearest(df: DataFrame, k: int, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, other, similarity, rank): the k nearest others of each row. A task keeps k of each row, so the shuffle grows with rows and blocks, not pairs."""

    def pick(tiles, same):
        parts = []
        for ia, ib, _, _, cosine in tiles:
            if same:
                cosine = np.where(ia[:, None] == ib[None, :], -np.inf, cosine)
            i, j = _top(cosine, k)
            own, other, value = _first(i, j, cosine[i, j], k)
            parts.append((ia[own], ib[other], value))
            if not same:
                j, i = _top(np.ascontiguousarray(cosine.T), k)
                own, other, value = _first(j, i, cosine[i, j], k)
                parts.append((ib[own], ia[other], value))
        own, other, value = _first(*_joined(parts, (np.int64, np.int64, np.float64)), k)
        return pa.table({"id": own, "other": other, "similarity": value})

    found = block_pairs(df, key, embedding, pick, "id long, other long, similarity double")
    by = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


#: Links that one task settles; rows of two ids.
FEW_LINKS = 200_000


def _settle(table: pa.Table) -> pa.Table:
    """The rows that are not stored, of all links of some components: in order of the later row, one goes if an earlier one that stays is linked to it."""
    gone: set = set()
    for b, a in sorted(zip(table["b"].to_pylist(), table["a"].to_pylist(), strict=True)):
        if a not in gone:
            gone.add(b)
    return pa.table({"id": pa.array(sorted(gone), table.schema.field("b").type)})


def refused(links: DataFrame, first: str = "a", second: str = "b", few: int = FEW_LINKS) -> DataFrame:
    """(id): in order of ids a row is stored unless a stored earlier one is linked to it; those that are not stored.

    Up to ``few`` links are settled in one task. Of more, each component with so many at most is settled in a task of
    its own. Larger ones go by rounds: a round settles the rows without an unsettled earlier neighbour and drops their
    links, until what is left is few or falls into small components.
    """
    live = written(links.select(F.col(first).alias("a"), F.col(second).alias("b")).where("a < b").distinct())
    schema = f"id {live.schema['b'].dataType.simpleString()}"
    gone = live.select(F.col("b").alias("id")).limit(0)
    while live.count() > few:
        component = connected_components(live, "a", "b").withColumnRenamed("node", "a")
        member = written(live.join(component, "a"))
        small = member.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") <= few)
        gone = gone.unionByName(written(member.join(small, "component").groupBy("component").applyInArrow(_settle, schema)))
        live = member.join(small, "component", "left_anti").select("a", "b")
        stored = written(live.select(F.col("a").alias("id")).distinct().join(live.select(F.col("b").alias("id")), "id", "left_anti"))
        out = written(live.join(stored.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct())
        gone = gone.unionByName(out)
        for settled, side in ((stored, "a"), (out, "a"), (out, "b")):
            live = live.join(settled.withColumnRenamed("id", side), side, "left_anti").select("a", "b")
        live = written(live)
    rest = live.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_settle, schema)
    return gone.unionByName(rest)


#: Rows that a round of ``stored_rows`` settles in one task; no more vectors are sent to all tasks at once.
ROUND_ROWS = 8192


def _vectors(df: DataFrame, key: str, embedding: str) -> DataFrame:
    return df.where(F.col(key).isNotNull() & F.col(embedding).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(embedding).alias("v"))


def stored_rows(df: DataFrame, least: float, key: str = "vec_id", embedding: str = "embedding") -> list[str]:
    """Paths of (id, v), one for each round: in order of ids a row is stored unless a stored earlier one is at ``least`` or more; those stored, at unit length.

    Ids are unique. A round settles the first ``ROUND_ROWS`` of what is left in one task and drops all later rows that
    are near to one of those it stored, where they are. So a row is multiplied with stored rows only, and no pair is
    written. With few near rows there are as many rounds as blocks of rows.
    """
    spark = df.sparkSession
    paths, rest = [], written(_vectors(df, key, embedding), "vectors")

    def settle(table: pa.Table) -> pa.Table:
        ids, rows = _matrix(table)
        gone = np.zeros(len(ids), bool)
        for at in range(0, len(ids), TILE_ROWS):
            near = rows[at : at + TILE_ROWS] @ rows[at:].T >= least
            for i in range(len(near)):
                if not gone[at + i]:
                    gone[at + i + 1 :] |= near[i, i + 1 :]
        kept = rows[~gone]
        edges = np.arange(len(kept) + 1, dtype=np.int32) * rows.shape[1]
        return pa.table({"id": ids[~gone], "v": pa.ListArray.from_arrays(edges, kept.ravel())})

    while True:
        first = rest.select("id").orderBy("id").limit(ROUND_ROWS).agg(F.count("*").alias("n"), F.max("id").alias("last")).first()
        head = rest.where(F.col("id") <= F.lit(first["last"]))
        paths.append(scratch_path(spark, "stored"))
        head.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(settle, "id long, v array<double>").write.parquet(paths[-1])
        if first["n"] < ROUND_ROWS:
            return paths
        sent = _sent(spark, paths[-1])

        def far(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            stored = sent.value[1].T
            for batch in (whole.slice(at, TILE_ROWS) for whole in batches for at in range(0, whole.num_rows, TILE_ROWS)):
                yield batch.filter(pa.array(~(_unit(pa.Table.from_batches([batch]))[1] @ stored >= least).any(axis=1)))

        rest = written(rest.where(F.col("id") > F.lit(first["last"])).mapInArrow(far, rest.schema), "vectors")
        sent.destroy()


def _ids(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.schema("id long").parquet(*paths)


def _sent(spark: SparkSession, path: str):
    """A round's stored ids and rows, sent to all tasks."""
    table = spark.read.schema("id long, v array<double>").parquet(path).toArrow()
    ids, lists = table["id"].combine_chunks().to_numpy(), table["v"].combine_chunks()
    return spark.sparkContext.broadcast((ids, lists.flatten().to_numpy().reshape(len(ids), -1)))


def _unique(df: DataFrame, key: str, embedding: str) -> bool:
    return df.where(F.col(key).isNotNull() & F.col(embedding).isNotNull()).groupBy(key).count().where("count > 1").isEmpty()


def refused_rows(df: DataFrame, least: float, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id): the rows refused in order of ids, those at ``least`` or more to a stored earlier one. Ids that repeat are settled by the list of all pairs."""
    if not _unique(df, key, embedding):
        return refused(similar_pairs(df, least, key, embedding))
    return _vectors(df, key, embedding).select("id").join(_ids(df.sparkSession, stored_rows(df, least, key, embedding)), "id", "left_anti")


def nearest_stored(df: DataFrame, least: float, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, kept, similarity): the refused rows, each with the nearest stored earlier one, ties to the smaller id."""
    by = (F.max_by("a", F.struct("similarity", -F.col("a"))).alias("kept"), F.max("similarity").alias("similarity"))
    if not _unique(df, key, embedding):
        close = written(similar_pairs(df, least, key, embedding), "links")
        gone = refused(close).withColumnRenamed("id", "b")
        held = close.join(gone, "b", "left_semi").join(gone.withColumnRenamed("b", "a"), "a", "left_anti")
        return held.groupBy(F.col("b").alias("id")).agg(*by)
    spark, rows = df.sparkSession, written(_vectors(df, key, embedding), "vectors")
    if rows.isEmpty():
        return rows.select("id", F.col("id").alias("kept"), F.lit(0.0).alias("similarity"))
    paths, path = stored_rows(rows, least, "id", "v"), scratch_path(spark, "nearest")
    for stored in paths:
        sent = _sent(spark, stored)

        def best(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            other, vectors = sent.value
            for batch in (whole.slice(at, TILE_ROWS) for whole in batches for at in range(0, whole.num_rows, TILE_ROWS)):
                ids, unit = _unit(pa.Table.from_batches([batch]))
                cosine = np.where(other[None, :] < ids[:, None], unit @ vectors.T, -np.inf)
                at = cosine.argmax(axis=1)
                value = cosine[np.arange(len(ids)), at]
                near = value >= least
                yield pa.RecordBatch.from_pydict({"b": ids[near], "a": other[at][near], "similarity": value[near]})

        rows.mapInArrow(best, "b long, a long, similarity double").write.mode("append").parquet(path)
        sent.destroy()
    found = spark.read.schema("b long, a long, similarity double").parquet(path).join(_ids(spark, paths).withColumnRenamed("id", "b"), "b", "left_anti")
    return found.groupBy(F.col("b").alias("id")).agg(*by)
