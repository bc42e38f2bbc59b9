"""Hybrid recall: ranked text and vector legs, reciprocal rank fusion, blends and fallbacks.

Legs end in a bounded top-k before any global rank, so a rank without keys sees only the candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramite.functions import text as tx
from engramite.functions import vectors as vc
from engramite.session import written

RRF_K, BOOST, CANDIDATES = 60, 0.002, 8


def ranked(df: DataFrame, order: list[Column], limit: int, name: str) -> DataFrame:
    """The first rows in an order, numbered from 1."""
    return df.orderBy(*order).limit(limit).withColumn(name, F.row_number().over(Window.orderBy(*order)))


def or_score(df: DataFrame, query: list[str], text: str = "content") -> DataFrame:
    """``df`` with text_score, 0 of rows without any of the words: 0.1 times the sum of 1/j**2 over each word's occurrences, over pi**2/6 and the number of words."""
    score = F.lit(0.0)
    df = df.withColumns({f"__tf{i}": tx.word_count(F.col(text), word) for i, word in enumerate(query)})
    for i in range(len(query)):
        count = F.col(f"__tf{i}")
        score = score + F.aggregate(F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, j: s + 1.0 / (j * j))
    return df.withColumn("text_score", score * 0.1 / 1.64493406685 / len(query)).drop(*[f"__tf{i}" for i in range(len(query))])


def or_rank(df: DataFrame, query: list[str], text: str = "content") -> DataFrame:
    return or_score(df, query, text).where("text_score > 0")


def knn(df: DataFrame, vector: list[float], embedding: str = "embedding") -> DataFrame:
    """``df`` with similarity to a query vector."""
    query = F.array(*[F.lit(float(x)) for x in vector])
    return df.withColumn("similarity", vc.cosine(F.col(embedding), query))


def text_leg(df: DataFrame, query: list[str], key: str, limit: int) -> DataFrame:
    # rows without a word rank last, so they can go after the limit; before it the filter would compute each score twice
    return ranked(or_score(df, query), [F.desc("text_score"), F.col(key)], limit, "r_text").where("text_score > 0").select(key, "r_text", "text_score")


def vector_leg(df: DataFrame, vector: list[float], key: str, k: int) -> DataFrame:
    return ranked(knn(df, vector).select(key, "similarity"), [F.desc("similarity"), F.col(key)], CANDIDATES * k, "r_vec")


def fuse(text: DataFrame, vector: DataFrame, key: str, recall: DataFrame | None = None) -> DataFrame:
    """Reciprocal rank fusion of two legs; an absent leg counts 0; with recall counts a logarithmic boost."""
    both = text.join(vector, key, "full")
    part = lambda c: F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0))
    fused = both.withColumn("rrf", part("r_text") + part("r_vec"))
    if recall is not None:
        n = F.coalesce("recall_count", F.lit(0))
        fused = fused.join(recall.select(key, "recall_count"), key, "left").withColumn("boosted", F.col("rrf") + F.when(n > 0, BOOST * F.log2(1.0 + n)).otherwise(0.0))
    return fused


def bm25(df: DataFrame, query: list[str], key: str, text: str = "content", k1: float = 1.2, b: float = 0.75, columns: dict[str, float] | None = None) -> DataFrame:
    """(key, score) of rows with any of the words; with several columns each weighs its occurrences.

    Document frequencies and the average length are one aggregate over all rows. The counts of each row, a few numbers,
    are written once, so that every text is gone through once.
    """
    weights = columns or {text: 1.0}
    tf = [sum(w * tx.word_count(F.col(c), q) for c, w in weights.items()) for q in query]
    length = sum(F.size(tx.words(F.col(c))) for c in weights)
    rows = written(df.select(key, length.alias("dl"), *[x.cast("double").alias(f"tf{i}") for i, x in enumerate(tf)]))
    stats = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(query))])
    score = F.lit(0.0)
    for i in range(len(query)):
        idf = F.ln(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score = score + idf * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return rows.crossJoin(F.broadcast(stats)).withColumn("score", score).where("score > 0").select(key, "score")


def bounded(score: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def overfetch(df: DataFrame, score: str, key: str, k: int, least: float) -> DataFrame:
    """Twice k rows, of those the ones that reach a threshold, of those k."""
    order = [F.desc(score), F.col(key)]
    return df.orderBy(*order).limit(2 * k).where(F.col(score) >= least).orderBy(*order).limit(k)


def recency_blend(df: DataFrame, days: Column, weight: float) -> DataFrame:
    return df.withColumn("score", (1 - weight) * F.col("similarity") + weight * F.greatest(F.lit(0.0), 1 - days / 30.0))


def expand_query(neighbours: DataFrame, corpus: DataFrame, query: list[str], terms: int = 5, least_idf: float = 1.0, text: str = "content") -> DataFrame:
    """(term, score): words of the nearest documents by how many of those have them times their inverse document frequency in the corpus."""
    near = neighbours.select(F.explode(F.array_distinct(tx.words(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("near"))
    near = near.where(~F.col("term").isin(query)) if query else near
    df = document_frequency(corpus, text)
    n = corpus.agg(F.count("*").alias("n"))
    scored = near.join(df, "term").crossJoin(F.broadcast(n)).withColumn("idf", F.ln(F.col("n") / (1.0 + F.col("df"))))
    return scored.where(F.col("idf") >= least_idf).select("term", (F.col("near") * F.col("idf")).alias("score")).orderBy(F.desc("score"), "term").limit(terms)


def document_frequency(df: DataFrame, text: str = "content") -> DataFrame:
    return df.select(F.explode(F.array_distinct(tx.words(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def project_first(own: DataFrame, everywhere: DataFrame, key: str, k: int) -> DataFrame:
    """Own rows up to half of k, then rows from everywhere, then own ones left over, each row once, k in all. Both sides are ranked by ``rank``."""
    lead = own.where(F.col("rank") <= (k + 1) // 2).withColumn("tier", F.lit(0))
    rest = own.where(F.col("rank") > (k + 1) // 2).withColumn("tier", F.lit(2))
    both = lead.unionByName(everywhere.withColumn("tier", F.lit(1))).unionByName(rest)
    first = both.groupBy(key).agg(F.min(F.struct("tier", "rank")).alias("at"))
    return ranked(first, [F.col("at.tier"), F.col("at.rank"), F.col(key)], k, "position").select(key, "position")


def turn_facts(turns: DataFrame, session: str, turn: str, of: object = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """The turns of one session, or of all, from the ``first`` to the ``last`` one asked for."""
    for bound, kept in ((of, F.col(session) == of), (first, F.col(turn) >= first), (last, F.col(turn) <= last)):
        turns = turns if bound is None else turns.where(kept)
    return turns
