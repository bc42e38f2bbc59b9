"""The corpus pipeline: quality, near duplicates, benchmark contamination, secrets, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's documents. All but the last keep the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engramite.llm import byte_bpe, decontaminate, jaccard_join, language_id, quality, secret_scan
from engramite.session import cut_lineage, scratch_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from the labels of these documents, gives 0.7 or more.

    Null and empty texts are scored as one passage without words; labels that are null or of no document teach nothing;
    rows with a null id have no label but are scored; repeated rows are scored alike; without labels every score is 0.5
    and nothing stays; an empty table stays empty; further columns are kept as they are.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~language_id.held_out())
    return quality.keep_good(docs, model, threshold=0.7)


def _keyed(docs: DataFrame, key: str) -> DataFrame:
    """The rows with an id, one of each id and text, with a key of their own: the id, or for a further text of one id a hash above all ids."""
    docs = docs.where("doc_id is not null")
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs.withColumn(key, F.col("doc_id").cast("long"))
    text, others = F.coalesce(F.col("text"), F.lit("")), [c for c in docs.columns if c not in ("doc_id", "text")]
    texts = Window.partitionBy("doc_id").orderBy(text)
    copies = Window.partitionBy("doc_id", text).orderBy(*others)
    further = F.pmod(F.xxhash64("doc_id", text), F.lit(1 << 61)) + F.lit(1 << 62)
    keyed = docs.withColumn(key, F.when(F.rank().over(texts) == 1, F.col("doc_id").cast("long")).otherwise(further))
    return cut_lineage(keyed.withColumn(f"{key}_", F.row_number().over(copies)).where(F.col(f"{key}_") == 1).drop(f"{key}_"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents with a Jaccard likeness of 0.8 or more on shingles of five words the one with the smallest id.

    Null and empty texts are like nothing and stay; of rows with the same id and text one stays; different texts of one
    id are documents of their own, the first by text under the id and the others after all ids; rows with a null id are
    not compared and stay; an empty table stays empty; further columns are kept as they are.
    """
    key = "__key"
    while any(c.startswith(key) for c in docs.columns):
        key += "_"
    keyed = _keyed(docs, key)
    linked = jaccard_join.link(keyed, width=5, num=80, den=100, id_col=key)
    kept = keyed.join(linked.where(F.col("component_id") == F.col(key)).select(key), key, "left_semi")
    return kept.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item, verbatim or as a paraphrase.

    Null and empty texts hold no item and stay, as do rows with a null id that hold none; repeated rows are judged
    alike; items that are null or have no word match nothing; with an empty benchmark all stay; an empty table stays
    empty; further columns are kept as they are.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret in the text replaced by a mark and n_chars brought up to date.

    A null text stays null, with n_chars null; empty texts, null ids and repeated rows stay as they are; an empty table
    stays empty; further columns are kept as they are.
    """
    spans = secret_scan.free_name(docs, "spans")
    scanned = secret_scan.redact(secret_scan.scan(docs, spans_col=spans), spans_col=spans)
    return scanned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document.

    A null text counts as empty and has no ids; null ids and repeated rows have a row each; an empty table gives an
    empty result; further columns are not read.
    """
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(docs, path, public_tokenizers.PATTERN), path))


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", not_in_benchmark),
    ("secret scans", without_secrets),
    ("byte-level BPE", token_ids),
]

#: The classifier and the latent search have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = scratch_path(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
