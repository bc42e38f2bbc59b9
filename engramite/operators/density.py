"""Density clusters within blocks: hierarchical clustering by mutual reachability (HDBSCAN, Campello et al. 2013).

A block (a project, a type) is worked on whole by one task: core distances, the minimum spanning tree of the mutual
reachability graph (memory grows with the block's rows, not with their square), the condensed tree, and the clusters of
greatest stability. Rows that belong to none are noise and are left out. Blocks are bounded by ``MOST_ROWS``; a larger
one is refused, not cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MOST_ROWS = 50_000
#: Distances that are held at once.
CELLS = 1 << 22


def _distances(x: np.ndarray, rows: np.ndarray | slice, squares: np.ndarray) -> np.ndarray:
    out = (-2 * x[rows]) @ x.T
    out += squares[rows][:, None]
    out += squares
    return np.sqrt(np.maximum(out, 0.0, out=out), out=out)


def core_distances(x: np.ndarray, samples: int) -> np.ndarray:
    """Distance of each row to its ``samples``-th nearest one, itself counted."""
    out, k, squares, step = np.empty(len(x)), min(samples, len(x)) - 1, (x**2).sum(1), max(1, CELLS // len(x))
    for a in range(0, len(x), step):
        near = _distances(x, slice(a, a + step), squares)
        near.partition(k, axis=1)
        out[a : a + step] = near[:, k]
    return out


def spanning_tree(x: np.ndarray, core: np.ndarray) -> np.ndarray:
    """Edges (a, b, weight) of the minimum spanning tree of the mutual reachability graph, by Prim's algorithm a row at a time."""
    n = len(x)
    # only rows outside the tree are held: they are packed again whenever a tenth of them has gone in
    left, part, squares, reached = np.arange(1, n), x[1:], (x[1:] ** 2).sum(1), core[1:]
    nearest, link, gone, now, edges = np.full(n - 1, np.inf), np.zeros(n - 1, np.int64), np.zeros(n - 1, bool), 0, []
    for k in range(n - 1):
        reach = part @ (-2 * x[now])
        reach += squares
        reach += (x[now] ** 2).sum()
        np.sqrt(np.maximum(reach, 0.0, out=reach), out=reach)
        np.maximum(np.maximum(reach, reached, out=reach), core[now], out=reach)
        closer = (reach < nearest) & ~gone
        nearest[closer], link[closer] = reach[closer], now
        at = int(np.argmin(nearest))
        now = int(left[at])
        edges.append((link[at], now, nearest[at]))
        gone[at], nearest[at] = True, np.inf
        if 10 * (n - 2 - k) < 9 * len(left):
            kept = ~gone
            left, part, squares, reached, nearest, link, gone = (v[kept] for v in (left, part, squares, reached, nearest, link, gone))
    return np.array(edges).reshape(-1, 3)


def labels(x: np.ndarray, smallest: int = 5, samples: int = 3) -> np.ndarray:
    """Cluster of each row, -1 of noise; clusters are numbered by their first row."""
    n = len(x)
    if n < max(2, smallest):
        return np.full(n, -1)
    tree = spanning_tree(x, core_distances(x, samples))
    # single linkage: nodes n.. join two, in order of weight
    root, size, left, right, weight = list(range(2 * n - 1)), [1] * (2 * n - 1), {}, {}, {}

    def top(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for k, (a, b, w) in enumerate(tree[np.argsort(tree[:, 2], kind="stable")]):
        a, b, new = top(int(a)), top(int(b)), n + k
        left[new], right[new], weight[new], size[new] = a, b, w, size[a] + size[b]
        root[a] = root[b] = new

    def leaves(node: int) -> list[int]:
        out, todo = [], [node]
        while todo:
            one = todo.pop()
            if one < n:
                out.append(one)
            else:
                todo += [left[one], right[one]]
        return out

    # condensed tree: a split counts where both parts are large enough; else rows fall out of the cluster
    parent, born, stable, fallen, todo = {0: None}, {0: 0.0}, {0: 0.0}, {0: []}, [(2 * n - 2, 0)]
    while todo:
        node, cluster = todo.pop()
        if node < n:
            continue
        level = 1 / weight[node] if weight[node] > 0 else 1e12
        a, b = left[node], right[node]
        if size[a] >= smallest and size[b] >= smallest:
            for part in (a, b):
                new = len(parent)
                parent[new], born[new], stable[new], fallen[new] = cluster, level, 0.0, []
                stable[cluster] += size[part] * (level - born[cluster])
                todo.append((part, new))
        else:
            for part in (a, b):
                if size[part] >= smallest:
                    todo.append((part, cluster))
                else:
                    stable[cluster] += size[part] * (level - born[cluster])
                    fallen[cluster] += leaves(part)
    children: dict[int, list[int]] = {c: [] for c in parent}
    for c, p in parent.items():
        if p is not None:
            children[p].append(c)
    chosen, best = {}, dict(stable)
    for c in sorted(parent, reverse=True):  # children have larger numbers
        below = sum(best[d] for d in children[c])
        chosen[c] = c != 0 and (not children[c] or stable[c] >= below)
        best[c] = stable[c] if chosen[c] else below
    out = np.full(n, -1)
    todo = [(0, None)]
    while todo:
        c, within = todo.pop()
        within = c if within is None and chosen[c] else within
        if within is not None:
            out[fallen[c]] = within
        todo += [(d, within) for d in children[c]]
    first = {}
    for c in out.tolist():
        if c >= 0:
            first.setdefault(c, len(first))
    return np.array([first.get(c, -1) for c in out.tolist()])


def density_clusters(df: DataFrame, block: str, key: str, embedding: str, smallest: int = 5, samples: int = 3) -> DataFrame:
    """(block, key, cluster): rows by cluster of their block, vectors taken at unit length (none at zero). Null vectors are noise."""
    schema = pa.schema([(block, pa.int64()), (key, pa.int64()), ("cluster", pa.int64())])

    def work(table: pa.Table) -> pa.Table:
        if table.num_rows > MOST_ROWS:
            raise ValueError(f"a block of {table.num_rows} rows is over {MOST_ROWS}; choose smaller blocks")
        own = table.column(block)[0].as_py()
        table = table.filter(table.column(embedding).is_valid()).sort_by(key)
        rows, vectors = table.column(key).to_pylist(), table.column(embedding).combine_chunks()
        if len(vectors) and len(np.unique(vectors.value_lengths().to_numpy())) > 1:
            raise ValueError("vectors of several lengths")
        x = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), -1) if len(rows) else np.zeros((0, 0))
        del table, vectors
        length = np.linalg.norm(x, axis=1, keepdims=True)
        found = labels(np.where(length > 0, x / np.where(length > 0, length, 1), x), smallest, samples) if len(rows) else np.zeros(0, int)
        kept = [(own, k, int(c)) for k, c in zip(rows, found, strict=True) if c >= 0]
        return pa.table([pa.array([r[i] for r in kept], pa.int64()) for i in range(3)], schema=schema)

    return df.select(df[block].cast("long").alias(block), df[key].cast("long").alias(key), embedding).groupBy(block).applyInArrow(work, f"`{block}` long, `{key}` long, cluster long")
