"""Connected components of an undirected graph given as pairs, by alternating large-star and small-star rounds.

Every round is a grouped minimum (combined before the shuffle) and a join with it. A hub of more than ``HUB_EDGES``
edges is joined where its edges are (``join_hot``); the edges of smaller ones, rows of two ids, meet in one task. The
number of rounds is logarithmic in the longest path. Each round is written to the shared checkpoint folder, which bounds the lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramite.session import cut_lineage

#: A key is hot with more rows than one in ``MOST_HOT`` of all, so there are at most ``MOST_HOT`` hot keys.
MOST_HOT = 10_000
#: Edges of a node that one task can well hold.
HUB_EDGES = 1_000_000


def join_hot(rows: DataFrame, small: DataFrame, key: str, total: int, how: str = "inner", most: int = 1000) -> DataFrame:
    """rows joined with a frame that has one row for each key, without gathering the rows of a key that has over ``most``.

    ``total`` is the number of ``rows`` (or more), and bounds the number of hot keys and so what is broadcast for them:
    their rows stay where they are. The rows of all other keys are shuffled. Rows with a null key match nothing.
    """
    if total <= most:
        return rows.join(small, key, how)
    least = max(most, total // MOST_HOT)
    hot = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > least).select(key)
    there = F.broadcast(small.join(F.broadcast(hot), key, "left_semi"))
    apart = rows.join(F.broadcast(hot), key, "left_anti").join(small, key, how)
    return rows.join(F.broadcast(hot), key, "left_semi").join(there, key, how).unionByName(apart)


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def connected_components(pairs: DataFrame, left: str = "u", right: str = "v", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that occurs in a pair; the component is its smallest node.

    Null ends and self loops are ignored for linking (a node that has only a self loop is its own component).
    """
    pairs = pairs.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u is not null and v is not null")
    edges = cut_lineage(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(edges)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = join_hot(both.where("v > u"), low, "u", state[0], most=HUB_EDGES).select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").distinct()
        if state[0] > HUB_EDGES:
            down = cut_lineage(down)
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = join_hot(down, low, "u", state[0], most=HUB_EDGES).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = cut_lineage(small.where("u <> v").distinct())
        new = _state(edges)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components have not settled")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    alone = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    return alone.join(nodes, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
