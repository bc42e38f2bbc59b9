"""One recall: legs, fusion, thresholds, fallbacks and reranking under one set of flags.

The steps are those of the parts: a text leg and a vector leg of bounded candidates, reciprocal rank fusion with the boost of
earlier recalls, twice the wanted rows by that score, the threshold, the cut; where nothing is left, one step down the
ladder; then ids that the asker has seen, tags, and the reranking. A recall whose first leg finds nothing runs two
small jobs to know it; nothing else is collected.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramite.functions import stems as st
from engramite.functions import text as tx
from engramite.operators import recall as rc
from engramite.operators import rerank as rr
from engramite.session import written

# The pool before reranking, its least size, how a threshold is scaled for fused ranks.
POOL, LEAST_POOL, RRF_THRESHOLD = 3, 50, 0.01
#: What a row found by a literal word counts.
LITERAL = 0.1


@dataclass(frozen=True)
class Ask:
    """A question and its flags.

    ``mode`` is hybrid, text or vector; without a vector hybrid is text. ``threshold`` is on the similarity of vectors
    and, times ``RRF_THRESHOLD``, on fused scores; ``recency`` is the share of recency in vector scores. ``tags`` weigh in the
    reranking and, with ``tags_strict``, a row must have one of them. ``project`` restricts the rows, or with ``project_first`` leads;
    ``context`` is the project that the signal of the reranking goes by, ``project`` if it is not given.
    ``exclude`` are ids seen already. ``expand`` are further words for the text leg. Nothing is reranked with ``rerank`` off.
    """

    words: str
    vector: list[float] | None = None
    k: int = 5
    mode: str = "hybrid"
    threshold: float = 0.2
    recency: float = 0.1
    tags: tuple[str, ...] = ()
    tags_strict: bool = False
    project: str | None = None
    project_first: bool = False
    context: str | None = None
    exclude: tuple = ()
    expand: tuple[str, ...] = ()
    rerank: bool = True
    as_of: str = "2024-01-01 00:00:00"
    types: dict[str, float] | None = None
    entities: tuple[tuple[str, str], ...] = ()
    weights: dict[str, float] = field(default_factory=lambda: rr.WEIGHTS)

    def pool(self) -> int:
        """Rows that go into the reranking."""
        return (max(POOL * self.k, LEAST_POOL) if self.rerank else self.k) + len(self.exclude)


def _cut(rows: DataFrame, score: str, pool: int, least: float) -> DataFrame:
    return rc.overfetch(rows, score, "id", pool, least)


def candidates(rows: DataFrame, ask: Ask, texts: DataFrame | None = None) -> DataFrame:
    """(id, raw, base, step): at most ``ask.pool()`` rows; raw ranks them, base is what the reranking calibrates, step is where on the ladder they were found.

    Null texts and null embeddings are in no leg. ``texts`` (id, content) stand for the content of ``rows``.
    """
    pool, near = ask.pool(), rc.CANDIDATES * ask.pool()
    plain = tx.query_words(ask.words)
    wanted = list(dict.fromkeys([*plain, *ask.expand]))
    texts = (rows if texts is None else texts).where("content is not null").select("id", "content")
    vectors = rows.where("embedding is not null").select("id", "embedding", "created_at")

    def of(words: list[str]) -> DataFrame:
        if words:
            return rc.text_leg(texts, words, "id", near)
        return texts.select("id", F.lit(1).alias("r_text"), F.lit(0.0).alias("text_score")).limit(0)

    if ask.mode == "vector":
        found = rc.knn(vectors, ask.vector).where(F.col("similarity") >= ask.threshold)
        days = F.expr(f"timestampdiff(SECOND, created_at, timestamp_ntz'{ask.as_of}')") / 86400.0
        found = rc.recency_blend(found, F.coalesce(days, F.lit(30.0)), ask.recency)
        first = _cut(found.select("id", F.col("score").alias("raw"), F.col("similarity").alias("base")), "raw", pool, float("-inf"))
    elif ask.mode == "text" or ask.vector is None:
        first = _cut(of(wanted).select("id", F.col("text_score").alias("raw"), F.col("text_score").alias("base")), "raw", pool, float("-inf"))
    else:
        fused = rc.fuse(of(wanted), rc.vector_leg(vectors, ask.vector, "id", ask.pool()), "id", rows)
        first = _cut(fused.select("id", F.col("boosted").alias("raw"), F.col("rrf").alias("base")), "raw", pool, ask.threshold * RRF_THRESHOLD)
    first = written(first.withColumn("step", F.lit("first")), "recall")
    if not first.isEmpty() or ask.mode == "vector" or not plain:
        return first
    # every stem of the plain question, in order of closeness; then its first word as a literal, the newest first
    stems = st.query_stems(ask.words)
    every = texts.select("id", st.stems(F.col("content")).alias("stems")).where(st.matches(F.col("stems"), stems, True)).select("id", st.and_rank(F.col("stems"), stems).alias("raw"))
    second = written(_cut(every.withColumn("base", F.col("raw")), "raw", pool, float("-inf")).withColumn("step", F.lit("every word")), "recall")
    if not second.isEmpty():
        return second
    literal = texts.where(F.contains(F.lower("content"), F.lit(plain[0]))).orderBy(F.desc("id")).limit(pool)
    return literal.select("id", F.lit(LITERAL).alias("raw"), F.lit(LITERAL).alias("base"), F.lit("literal").alias("step"))


def _seen(ids: Column, ask: Ask) -> Column:
    return F.coalesce(~ids.isin(list(ask.exclude)), F.lit(True)) if ask.exclude else F.lit(True)


def recall(memories: DataFrame, ask: Ask, texts: DataFrame | None = None) -> DataFrame:
    """(rank, id, score, step): the ``k`` best memories.

    ``memories``: id, content, embedding, project, created_at, confidence, recall_count, type, tags, pattern_strength, pattern_tags,
    entities (name, type); those that are superseded or archived are left out by the caller. Ties go to the smaller id.
    Fewer rows than ``k`` come back where no more are found; with no question and no vector none. Content may be given
    apart, as ``texts`` (id, content) of the same ids: then it goes through no join that the memories are made by.
    """

    def of_project() -> tuple[DataFrame, DataFrame | None]:
        rows = memories.where(F.col("project") == ask.project)
        return rows, None if texts is None else texts.join(rows.select("id"), "id", "left_semi")

    found = candidates(memories, ask, texts) if ask.project is None or ask.project_first else candidates(of_project()[0], ask, of_project()[1])
    if ask.project is not None and ask.project_first:
        own = candidates(of_project()[0], ask, of_project()[1])
        best = lambda df: df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("raw"), "id")))  # noqa: E731  # at most a pool of rows
        order = rc.project_first(best(own), best(found), "id", ask.pool())
        both = own.unionByName(found).groupBy("id").agg(F.max(F.struct("raw", "base", "step")).alias("b")).select("id", "b.*")
        found = both.join(F.broadcast(order), "id")
    kept = found.where(_seen(F.col("id"), ask)).orderBy(F.desc("raw"), "id").limit(ask.pool() - len(ask.exclude))
    rows = F.broadcast(kept.select("id", "raw", "base", "step")).join(memories, "id")
    if ask.tags and ask.tags_strict:
        rows = rows.where(F.arrays_overlap(F.coalesce("tags", F.array().cast("array<string>")), F.array(*map(F.lit, ask.tags))))
    if ask.rerank:
        mode = "vector" if ask.mode == "vector" else "text" if ask.mode == "text" or ask.vector is None else "rrf"
        told = rr.signals(rows.withColumn("rrf", F.col("base")), ask.context or ask.project or "", ask.as_of, list(ask.tags), ask.types, list(ask.entities))
        told = told.withColumn("cal", F.when(F.col("step") == "first", rr.calibrated(F.col("base"), mode)).otherwise(rr.calibrated(F.col("base"), "text")))
        scored = rr.rerank(told, ask.weights, "id", ask.k)
    else:
        scored = rows.withColumn("score", F.col("raw"))
    top = scored.orderBy(F.desc("score"), "id").limit(ask.k).select("id", "score", "step")
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).select("rank", "id", "score", "step")
