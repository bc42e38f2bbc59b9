"""Language identification in two levels: the family first, then the languages within it.

Every whole text becomes a histogram of hashed byte 1- to 3-grams (lower case, ASCII characters other than letters
count as blanks), logarithmic and of unit length. Linear support vector machines, trained here by dual coordinate
descent, tell each two families apart; within a family one machine for each two of its languages votes. The score is
the product of the logistic confidence of the family and of the language.

The machines are fitted on a sample of labelled rows of every language: at most ``PER_LANGUAGE`` of each, and about
``LABELLED`` in all, chosen by a hash of the id; counts of languages and predictions cover all rows.

Edge cases: a null text, an empty one or one without a letter is ``und`` with score 0; without labelled rows all
are ``und``; with one language only it is predicted with score 1; rows with a null lang are not learned from; repeated
rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramite.llm._batches import id_type, map_texts

#: Bounds of the training sample, in rows of a language and in all; bins of the histogram.
PER_LANGUAGE, LABELLED, BINS = 500, 16_000, 4096
#: Picked ids that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

#: Families of languages by code; any other language is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz"],
    "indo-aryan": ["hi", "bn", "ur", "mr", "ne", "gu", "pa"],
}

_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[[b for b in range(128) if not chr(b).isalpha()]] = 32
_LIKELY_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    """Whether a text has a letter by Unicode category; the pattern also takes numbers such as a half or a Roman numeral sign."""
    return any(m[0].isalpha() for m in _LIKELY_LETTER.finditer(text or ""))


def histograms(texts: list[str]) -> np.ndarray:
    """One row of BINS values for each text."""
    raws = [b" " + t.lower().encode("utf-8", "surrogatepass") for t in texts]
    raw = _BLANK[np.frombuffer(b"  ".join(raws) + b"   ", np.uint8)].astype(np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(r) + 2 for r in raws])
    n = len(owner)
    grams = [raw[:n] | 1 << 24, raw[:n] << 8 | raw[1 : n + 1] | 2 << 24, raw[:n] << 16 | raw[1 : n + 1] << 8 | raw[2 : n + 2] | 3 << 24] if n + 2 <= len(raw) else []
    if not grams:
        raw = np.concatenate([raw, np.full(3, 32, np.uint32)])
        grams = [raw[:n] | 1 << 24, raw[:n] << 8 | raw[1 : n + 1] | 2 << 24, raw[:n] << 16 | raw[1 : n + 1] << 8 | raw[2 : n + 2] | 3 << 24]
    ends = np.cumsum([len(r) + 2 for r in raws])
    inside = np.ones(n, bool)
    inside[ends - 1] = inside[ends - 2] = False  # what stands between texts starts no gram
    inside &= raw[:n] + (raw[1 : n + 1] << 8) != 32 + (32 << 8)  # nor do blanks in a row
    base = (owner[inside] * BINS).astype(np.int64)
    out = np.zeros(len(texts) * BINS)
    for gram in grams:
        out += np.bincount(base + ((gram[inside] * np.uint32(2654435761)) >> np.uint32(20)), minlength=len(out))
    out = np.log1p(out.reshape(len(texts), BINS))
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 4.0, epochs: int = 12) -> np.ndarray:
    """Weights (last one the bias) of a linear machine with squared hinge loss; y is +1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    weights, alpha, square = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(1) + 0.5 / cost
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(x)):
            gradient = y[i] * (x[i] @ weights) - 1 + alpha[i] * 0.5 / cost
            new = max(alpha[i] - gradient / square[i], 0.0)
            if new != alpha[i]:
                weights += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return weights


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


class Machines:
    """Pairwise machines over named classes; predict() gives each row's class by votes, then margins, and a confidence."""

    def __init__(self, x: np.ndarray, labels: np.ndarray) -> None:
        self.names = sorted(set(labels.tolist()))
        self.pairs = [(a, b) for a in range(len(self.names)) for b in range(a + 1, len(self.names))]
        self.weights = np.zeros((x.shape[1] + 1, len(self.pairs)))
        for k, (a, b) in enumerate(self.pairs):
            of = np.isin(labels, [self.names[a], self.names[b]])
            self.weights[:, k] = fit_svm(x[of], np.where(labels[of] == self.names[a], 1.0, -1.0))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        margins = x @ self.weights[:-1] + self.weights[-1]
        votes, sums = np.zeros((len(x), len(self.names))), np.full((len(x), len(self.names)), np.inf)
        for k, (a, b) in enumerate(self.pairs):
            votes[:, a] += margins[:, k] >= 0
            votes[:, b] += margins[:, k] < 0
            sums[:, a], sums[:, b] = np.minimum(sums[:, a], margins[:, k]), np.minimum(sums[:, b], -margins[:, k])
        best = np.argmax(votes + 1e-3 * np.tanh(np.where(np.isinf(sums), 0, sums)), axis=1)
        worst = sums[np.arange(len(x)), best]
        return best, 1 / (1 + np.exp(-3 * np.clip(worst, -20, 20)))


class Model:
    def __init__(self, x: np.ndarray, langs: np.ndarray) -> None:
        families = np.array([family_of(v) for v in langs.tolist()], dtype=object)
        self.top = Machines(x, families)
        self.within = {f: Machines(x[families == f], langs[families == f]) for f in self.top.names}

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        family, sure = self.top.predict(x)
        langs = np.empty(len(x), object)
        for k, name in enumerate(self.top.names):
            rows = np.flatnonzero(family == k)
            if len(rows):
                best, own = self.within[name].predict(x[rows])
                langs[rows] = [self.within[name].names[b] for b in best]
                sure[rows] *= own
        return langs.tolist(), sure


def training_sample(docs: DataFrame, labelled: DataFrame, per_class: int, in_all: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, label) of at most ``per_class`` rows of each label of ``labelled`` (id, label), fewer where all labels would come to more than ``in_all``, but one of each.

    Ids are picked by a hash, before any text is read. The counts of the labels give the share of hashes to take, so
    only about as many rows as are picked are ranked. Counts and picked ids are broadcast while their number, which is
    known before, is small.
    """
    labelled = labelled.where(F.col("label").isNotNull() & F.col("id").isNotNull()).distinct()
    kept = labelled.groupBy("label").count()
    classes = kept.count()
    per_class = max(1, min(per_class, in_all // max(1, classes)))
    small = F.broadcast if classes * per_class <= BROADCAST_IDS else lambda frame: frame
    by = Window.partitionBy("label").orderBy("draw", "id")
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 32))
    thinned = labelled.join(small(kept), "label").withColumn("draw", draw).where(F.col("draw") * F.col("count") <= F.lit(float(max(1.5 * per_class, per_class + 20) * (1 << 32))))
    picked = thinned.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= per_class).select("id", "label")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null").join(small(picked), "id").select("id", "text", "label")


def fit(docs: DataFrame, learn_from, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fit the machines on the rows where the condition ``learn_from`` holds; None without such rows."""
    labelled = docs.where(learn_from).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("label"))
    sample = training_sample(docs, labelled, PER_LANGUAGE, LABELLED, id_col, text_col)
    key = sample.select(F.col("label").alias("k"), F.col("text"))

    def make():
        def work(keys: list, texts: list) -> dict:
            kept = [i for i, t in enumerate(texts) if has_letter(t)]
            x = histograms([texts[i] for i in kept]) if kept else np.zeros((0, BINS), np.float32)
            return {"k": [keys[i] for i in kept], "x": [r.tobytes() for r in x]}

        return work

    rows = map_texts(key, make, "k string, x binary", "k", "text").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["k"], bytes(r["x"])))  # the same machines in whatever order the rows come
    return Model(np.stack([np.frombuffer(r["x"], np.float32) for r in rows]), np.array([r["k"] for r in rows], dtype=object))


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(keys: list, texts: list) -> dict:
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            rows = [i for i, t in enumerate(texts) if has_letter(t)] if sent.value else []
            if rows:
                found, sure = sent.value.predict(histograms([texts[i] for i in rows]))
                for i, lang, p in zip(rows, found, sure.tolist(), strict=True):
                    langs[i], scores[i] = lang, p
            return {id_col: keys, "lang_pred": langs, "score": scores}

        return work

    return map_texts(docs, make, f"`{id_col}` {id_type(docs, id_col)}, lang_pred string, score double", id_col, text_col)


def held_out(id_col: str = "doc_id"):
    """The rows kept from learning: crc32 of the id as text leaves 2 when divided by 4 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
