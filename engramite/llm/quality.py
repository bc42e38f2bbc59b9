"""Quality classifier: gated-attention multiple-instance learning over passages.

A text is a bag of passages of ``PASSAGE_WORDS`` words. A passage is described by the shares of its character classes,
hashed pairs of classes, and how its words repeat. An encoder turns each passage into a hidden vector; a gated
attention (tanh times sigmoid) weighs the passages of a bag; the weighted sum gives the score. Encoder, attention and
score are trained together, from document labels only.

Training takes all labelled rows with all their passages. Passages are made where the texts are; a hash of the id deals
them and the labels over shards of about ``SHARD_ROWS`` labelled rows, where they meet, so no text is shuffled. Each epoch every shard is learned from in a task of its own, from the same weights, and the weights
and moments that come out are averaged by rows, in whole numbers, so that they don't depend on the order of the tasks.
Few rows are one shard, learned in one task. The driver holds weights only. Scoring encodes every passage of every text.

Edge cases: a null or empty text has one passage without words and is scored like any other; rows without a label or
with a null one, or with a null text, are not learned from; without labels every score is 0.5, with one label only it is that label; a
document with contradicting labels is learned with both; repeated rows give repeated results; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramite.llm import _words
from engramite.llm._batches import filter_texts, give_back, id_type, map_texts

PASSAGE_WORDS, SHARD_ROWS = 64, 2400
HIDDEN, EPOCHS, RATE, DECAY, BATCH = 24, 10, 0.01, 1e-4, 64

#: Steps of the training at least, however few the labels are.
LEAST_STEPS = 300
#: Weights are added up in units of one in so many.
UNIT = 1 << 24

#: Classes of bytes: each ASCII sign its own; digits, lower case, upper case and lead bytes beyond ASCII one each.
_CLASS = np.zeros(256, np.int64)
_CLASS[ord("0") : ord("9") + 1], _CLASS[ord("a") : ord("z") + 1], _CLASS[ord("A") : ord("Z") + 1], _CLASS[128:] = 1, 2, 3, 4
_CLASS[[32, 9, 10, 13]] = [5, 6, 7, 7]
for _k, _sign in enumerate("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    _CLASS[ord(_sign)] = 8 + _k
CLASSES, PAIRS, EXTRA = 40, 128, 8
WIDTH = CLASSES + PAIRS + EXTRA


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features, border): ``border[i]:border[i + 1]`` are the passages of text i, one at least."""
    raw, starts, ends, hashed, border = _words.words_of(texts, lower=False)
    words = np.diff(border)
    counts = np.maximum(1, -(-words // PASSAGE_WORDS))
    edges = np.concatenate([[0], np.cumsum(counts)])
    owner = np.repeat(np.arange(len(texts)), words)
    group = edges[owner] + (np.arange(len(owner)) - border[owner]) // PASSAGE_WORDS
    total = int(edges[-1])
    # each byte belongs to the passage of the last word that began, bytes before the first word to the first passage
    sizes = np.array([len(t) + 1 for t in texts])
    begun = np.cumsum(np.bincount(starts, minlength=len(raw))) - 1
    text_of = np.repeat(np.arange(len(texts)), sizes)
    at = np.where(begun >= border[text_of], group[np.maximum(begun, 0)] if len(group) else 0, edges[text_of])
    kind = _CLASS[raw]
    last = np.cumsum(sizes) - 1  # the border after each text
    inside = np.ones(len(raw), bool)
    inside[last] = False
    out = np.zeros((total, WIDTH))
    length = np.maximum(np.bincount(at[inside], minlength=total), 1)[:, None]
    out[:, :CLASSES] = np.bincount(at[inside] * CLASSES + kind[inside], minlength=total * CLASSES).reshape(total, CLASSES) / length
    pair = (kind[:-1] * 64 + kind[1:]) * 2654435761 % (1 << 32) >> 25
    both = inside[:-1] & inside[1:]
    out[:, CLASSES : CLASSES + PAIRS] = np.bincount(at[:-1][both] * PAIRS + pair[both], minlength=total * PAIRS).reshape(total, PAIRS) / length
    out[:, : CLASSES + PAIRS] = np.sqrt(out[:, : CLASSES + PAIRS])
    if len(group):
        n = np.bincount(group, minlength=total)
        many = np.maximum(n, 1)
        same = np.zeros(len(group))
        same[1:] = (hashed[1:] == hashed[:-1]) & (group[1:] == group[:-1])
        order = np.lexsort((hashed, group))
        fresh = np.ones(len(group))
        fresh[1:] = (hashed[order][1:] != hashed[order][:-1]) | (group[order][1:] != group[order][:-1])
        size = ends - starts
        shouted = np.add.reduceat((kind == 3).astype(np.int64), starts) if len(starts) else np.zeros(0)
        tail = kind[ends - 1]
        for k, value in enumerate((same, size / 16, np.minimum(size, 64) ** 2 / 256, shouted >= np.maximum(2, size / 2), tail >= 8, size == 1)):
            out[:, CLASSES + PAIRS + k] = np.bincount(group, weights=value, minlength=total) / many
        out[:, CLASSES + PAIRS + 6] = np.bincount(group[order], weights=fresh, minlength=total) / many
        out[:, CLASSES + PAIRS + 7] = np.log1p(n) / 4
    return out.astype(np.float32), edges


class AttentionNet:
    """h = tanh(x E + e); weight = softmax over the bag of w . (tanh(h V) * sigmoid(h U)); score = sigmoid(c . sum(weight h) + d)."""

    def __init__(self, seed: int = 11) -> None:
        draw = np.random.default_rng(seed)
        self.p = {
            "E": draw.normal(0, 0.3, (WIDTH, HIDDEN)), "e": np.zeros(HIDDEN), "V": draw.normal(0, 0.3, (HIDDEN, HIDDEN)), "U": draw.normal(0, 0.3, (HIDDEN, HIDDEN)),
            "w": draw.normal(0, 0.3, HIDDEN), "c": draw.normal(0, 0.3, HIDDEN), "d": np.zeros(1),
        }
        self.mean, self.scale = np.zeros(WIDTH), np.ones(WIDTH)
        self.m, self.v, self.step = {k: np.zeros_like(w) for k, w in self.p.items()}, {k: np.zeros_like(w) for k, w in self.p.items()}, 0

    def forward(self, x: np.ndarray, edges: np.ndarray) -> dict:
        p, starts, sizes = self.p, edges[:-1], np.diff(edges)
        h = np.tanh(x @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        s = (t * g) @ p["w"]
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), sizes))
        a = s / np.repeat(np.add.reduceat(s, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "y": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))}

    def gradient(self, x: np.ndarray, edges: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict:
        p, f, starts, sizes = self.p, self.forward(x, edges), edges[:-1], np.diff(edges)
        dy = (f["y"] - label) * weight / len(label)
        dz = np.repeat(dy, sizes)[:, None] * p["c"]
        da = (dz * f["h"]).sum(1)
        ds = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, starts), sizes))
        dt, dg = ds[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2), ds[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
        return {"E": x.T @ dh, "e": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ ds, "c": f["z"].T @ dy, "d": np.array([dy.sum()])}

    def learn(self, bags: list[np.ndarray], labels: np.ndarray, first: int, stop: int, epochs: int) -> None:
        """Epochs ``first`` to ``stop`` of ``epochs``, by Adam; the moments stay for the next ones."""
        edges = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
        x = ((np.concatenate(bags) - self.mean) / self.scale).astype(np.float32)
        for epoch in range(first, stop):
            order = np.random.default_rng((5, epoch)).permutation(len(bags))
            for at in range(0, len(bags), BATCH):
                rows = order[at : at + BATCH]
                taken = np.concatenate([np.arange(edges[i], edges[i + 1]) for i in rows])
                border = np.concatenate([[0], np.cumsum(edges[rows + 1] - edges[rows])])
                found, self.step = self.gradient(x[taken], border, labels[rows], np.ones(len(rows))), self.step + 1
                for k, g in found.items():
                    g = g + DECAY * self.p[k]
                    self.m[k] = 0.9 * self.m[k] + 0.1 * g
                    self.v[k] = 0.99 * self.v[k] + 0.01 * g * g
                    self.p[k] = self.p[k] - RATE * (1 - epoch / epochs) * (self.m[k] / (1 - 0.9**self.step)) / (np.sqrt(self.v[k] / (1 - 0.99**self.step)) + 1e-8)

    def state(self) -> np.ndarray:
        return np.concatenate([part[k].ravel() for part in (self.p, self.m, self.v) for k in self.p])

    def restore(self, flat: np.ndarray, step: int) -> None:
        at, self.step = 0, step
        for part in (self.p, self.m, self.v):
            for k, old in self.p.items():
                part[k] = flat[at : at + old.size].reshape(old.shape)
                at += old.size

    def score(self, x: np.ndarray, edges: np.ndarray) -> np.ndarray:
        return self.forward((x - self.mean) / self.scale, edges)["y"]


def fit(docs: DataFrame, labels: DataFrame, learn_from, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> AttentionNet | float:
    """Train on the labels of ids where ``learn_from`` holds; a constant score where there is nothing to tell apart."""
    known = labels.where(learn_from).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label is not null")
    known = docs.select(F.col(id_col).alias("id")).distinct().join(known, "id").distinct()
    shares = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(shares) < 2:
        return float(next(iter(shares), 0.5))
    shards = max(1, sum(shares.values()) // SHARD_ROWS)
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard")
    texts = docs.where(learn_from).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")

    def make():
        def work(keys: list, texts: list) -> dict:
            x, edges = passages([t.encode("utf-8", "surrogatepass") for t in texts])
            packed = [zlib.compress(x[a:b].tobytes(), 1) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            return {"id": [k["id"] for k in keys], "shard": [k["shard"] for k in keys], "x": packed}

        return work

    # passages and labels are dealt once and meet in the shards; every epoch reads what the shuffle wrote
    bags = map_texts(texts.select(F.struct("id", shard).alias("k"), "text"), make, f"id {id_type(texts, 'id')}, shard int, x binary", "k", "text")
    both = bags.rdd.map(lambda r: (r[1], (r[0], bytes(r[2])))).union(known.select("id", shard, "label").rdd.map(lambda r: (r[1], (r[0], r[2]))))
    rows = both.partitionBy(shards, int).mapPartitions(_matched)
    count, passages_, total, squares = rows.mapPartitions(_sums).treeReduce(lambda a, b: tuple(u + v for u, v in zip(a, b, strict=True)))
    if not count:
        return 0.5
    net = AttentionNet()
    net.mean = total / UNIT / passages_
    net.scale = np.sqrt(np.maximum(0.0, squares / UNIT / passages_ - net.mean**2)) + 1e-3
    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH * shards // count))
    for first in range(epochs) if shards > 1 else [0]:
        found = rows.mapPartitions(_learned(net, first, first + 1 if shards > 1 else epochs, epochs))
        taken, steps, state = found.treeReduce(lambda a, b: (a[0] + b[0], max(a[1], b[1]), a[2] + b[2]))
        net.restore(state / float(UNIT) / taken, steps)
    net.m = net.v = {}
    give_back()
    return net


def _matched(part: Iterable[tuple]) -> Iterator[tuple]:
    """(label, passages) of a shard's rows that have a label, for each of their labels."""
    texts, labels = [], {}
    for _, (key, value) in part:
        if isinstance(value, bytes):
            texts.append((key, value))
        else:
            labels.setdefault(key, []).append(value)
    return ((label, x) for key, x in texts for label in labels.get(key, ()))


def _bags(part: Iterable[tuple]) -> tuple[list[np.ndarray], np.ndarray]:
    """Passages and labels of a shard's rows, in an order of their own."""
    rows = sorted((k, zlib.decompress(x)) for k, x in part)
    return [np.frombuffer(x, np.float32).reshape(-1, WIDTH) for _, x in rows], np.array([k for k, _ in rows], float)


def _sums(part: Iterable[tuple]) -> Iterator[tuple]:
    """(rows, passages, sums, sums of squares) of a shard, the sums in units."""
    count, passages_, total, squares = 0, 0, np.zeros(WIDTH, np.int64), np.zeros(WIDTH, np.int64)
    for _, packed in part:
        x = np.frombuffer(zlib.decompress(packed), np.float32).reshape(-1, WIDTH).astype(float)
        count, passages_ = count + 1, passages_ + len(x)
        total, squares = total + np.rint(x.sum(0) * UNIT).astype(np.int64), squares + np.rint((x * x).sum(0) * UNIT).astype(np.int64)
    yield count, passages_, total, squares


def _learned(net: AttentionNet, first: int, stop: int, epochs: int):
    """A pass over a shard: (rows, steps, weights and moments times rows, in units)."""

    def run(part: Iterable[tuple]) -> Iterator[tuple]:
        bags, labels = _bags(part)
        if bags:
            net.learn(bags, labels, first, stop, epochs)
        yield len(bags), net.step, np.rint(net.state() * (len(bags) * UNIT)).astype(np.int64)

    return run


def score(docs: DataFrame, model: AttentionNet | float, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score, predicted) of every whole text; ``predicted`` is 1 where the score reaches the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(keys: list, texts: list) -> dict:
            net = sent.value
            if isinstance(net, float):
                scores = [net] * len(texts)
            else:
                scores = net.score(*passages([(t or "").encode("utf-8", "surrogatepass") for t in texts])).tolist()
            return {id_col: keys, "score": scores, "predicted": [int(s >= threshold) for s in scores]}

        return work

    return map_texts(docs, make, f"`{id_col}` {id_type(docs, id_col)}, score double, predicted int", id_col, text_col)


def keep_good(docs: DataFrame, model: AttentionNet | float, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def keep(texts: list) -> list:
            net = sent.value
            if isinstance(net, float):
                return [net >= threshold] * len(texts)
            return (net.score(*passages([(t or "").encode("utf-8", "surrogatepass") for t in texts])) >= threshold).tolist()

        return keep

    return filter_texts(docs, make, text_col)
