"""Approximate nearest neighbours by inverted lists: centroids are fitted on a bounded sample, every row is listed.

A query reads the lists of the nearest centroids and ranks their rows by exact cosine similarity. Rows without a vector
(null, or of no length) are in no list.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramite.functions import vectors as vc

#: Rows that the centroids are fitted on at most; they only decide how good the lists are.
SAMPLE = 20_000


def fit(df: DataFrame, key: str, embedding: str, lists: int = 16, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Centroids of unit length, by k-means on the sample with the least hashes."""
    sample = df.where(F.col(embedding).isNotNull()).select(F.xxhash64(key).alias("h"), embedding).orderBy("h").limit(SAMPLE).collect()
    x = np.array([r[1] for r in sample], float)
    if not len(x):
        return np.zeros((0, 0))
    x = x[np.linalg.norm(x, axis=1) > 0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    draw = np.random.default_rng(seed)
    means = x[draw.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.argmax(x @ means.T, axis=1)
        for k in range(len(means)):
            if (own == k).any():
                means[k] = x[own == k].sum(0)
        means /= np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
    return means


def probes_for(df: DataFrame, key: str, embedding: str, centroids: np.ndarray, k: int = 10, recall: float = 0.95, asked: int = 100) -> int:
    """The fewest lists to read that find the share ``recall`` of the k nearest rows, measured with some rows of the sample as queries against all of it."""
    sample = df.where(F.col(embedding).isNotNull()).select(F.xxhash64(key).alias("h"), embedding).orderBy("h").limit(SAMPLE).collect()
    x = np.array([r[1] for r in sample], float)
    if not len(x) or not len(centroids):
        return 1
    x = x[np.linalg.norm(x, axis=1) > 0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    own, need = np.argmax(x @ centroids.T, axis=1), []
    for query in x[:: max(1, len(x) // asked)]:
        nearest = np.argsort(-(x @ query), kind="stable")[:k]
        place = np.argsort(np.argsort(-(centroids @ query), kind="stable"))
        need += (place[own[nearest]] + 1).tolist()
    return int(np.sort(need)[min(len(need), -(-int(recall * 1000) * len(need) // 1000)) - 1])


def index(df: DataFrame, key: str, embedding: str, centroids: np.ndarray) -> DataFrame:
    """(key, embedding, list) of every row with a vector."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            keys, vectors = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = [k for k, v in enumerate(vectors) if v is not None and any(v)]
            own = np.argmax(np.array([vectors[k] for k in rows], float) @ centroids.T, axis=1) if rows else []
            yield pa.RecordBatch.from_arrays([pa.array([keys[k] for k in rows], batch.schema.field(0).type), pa.array([vectors[k] for k in rows], batch.schema.field(1).type), pa.array(own, pa.int32())], names=[key, embedding, "list"])

    return df.select(key, embedding).mapInArrow(run, f"`{key}` {kind}, `{embedding}` {df.schema[embedding].dataType.simpleString()}, list int")


def search(listed: DataFrame, key: str, embedding: str, centroids: np.ndarray, vector: list[float], k: int, probes: int) -> DataFrame:
    """(key, similarity) of the k most similar rows in the lists of the ``probes`` nearest centroids."""
    near = np.argsort(-(centroids @ np.array(vector, float)), kind="stable")[:probes].tolist()
    query = F.array(*[F.lit(float(v)) for v in vector])
    scored = listed.where(F.col("list").isin(near)).select(key, vc.cosine(F.col(embedding), query).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), key).limit(k)
