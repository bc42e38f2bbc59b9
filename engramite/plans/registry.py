"""Queries over the driver's tables: a name, a function of (session, folder), and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramite.sources.tables import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The moment that all ages are counted from; no operator looks at the clock.
AS_OF = "2024-03-01 00:00:00"


class Tables:
    """The tables of a folder, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def texts(self) -> DataFrame:
        """(doc_id, text) of documents over all cores, for work on every character."""
        return spread(self.documents.select("doc_id", "text"))

    @property
    def learnings(self) -> DataFrame:
        """documents as learnings: exact copies are superseded by the first, toxic ones archived, recalls are view events."""
        docs = self.documents.withColumn("content_hash", F.sha2(F.trim("text"), 256))
        first = docs.groupBy("content_hash").agg(F.min("doc_id").alias("first"))
        views = self.events.where("event_type = 'view'").select(F.get_json_object("props", "$.k").cast("long").alias("doc_id"), "ts").groupBy("doc_id").agg(F.count("*").alias("recall_count"), F.max("ts").alias("last_recalled"))
        toxic = self.labels.where("toxic = 1").select("doc_id", F.lit(True).alias("toxic")).distinct()
        out = docs.join(first, "content_hash").join(views, "doc_id", "left").join(toxic, "doc_id", "left")
        created = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(doc_id % 1440 as int))")
        superseded = F.when(F.col("first") < F.col("doc_id"), F.col("first"))
        return out.select(
            F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("source").alias("project"), F.col("lang").alias("type"), "content_hash",
            created.alias("created_at"), F.when(F.col("doc_id") % 4 == 0, "high").when(F.col("doc_id") % 4 == 1, "medium").when(F.col("doc_id") % 4 == 2, "low").alias("confidence"),
            superseded.alias("superseded_by"), F.when(superseded.isNull() & F.col("toxic"), created + F.expr("interval 10 days")).alias("archived_at"),
            F.coalesce("recall_count", F.lit(0)).cast("long").alias("recall_count"), "last_recalled",
        )


#: The same view in SQL; other views may follow it.
LEARNINGS = """
WITH learnings AS (
  SELECT d.doc_id AS id, d.text AS content, d.source AS project, d.lang AS type, sha256(trim(d.text)) AS content_hash,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(d.doc_id % 1440 AS INTEGER)) AS created_at,
    CASE d.doc_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END AS confidence,
    CASE WHEN f.first < d.doc_id THEN f.first END AS superseded_by,
    CASE WHEN NOT f.first < d.doc_id AND t.doc_id IS NOT NULL THEN TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(d.doc_id % 1440 AS INTEGER)) + INTERVAL 10 DAY END AS archived_at,
    coalesce(v.n, 0) AS recall_count, v.last AS last_recalled
  FROM documents d
  JOIN (SELECT sha256(trim(text)) AS h, min(doc_id) AS first FROM documents GROUP BY 1) f ON f.h = sha256(trim(d.text))
  LEFT JOIN (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, max(ts) AS last FROM events WHERE event_type = 'view' GROUP BY 1) v ON v.k = d.doc_id
  LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) t ON t.doc_id = d.doc_id
)
"""


def query(name: str, sql: str | None = None):
    """Register a function of Tables under a name, with its SQL."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLES[name] = sql
        return f

    return add


def sql_replaced(column: str, rules: list[tuple[str, str]]) -> str:
    """The SQL of text.replaced."""
    for pattern, kept in rules:
        pattern, kept = pattern.replace("'", "''"), kept.replace("'", "''").replace("$", "\\")
        column = f"regexp_replace({column}, '{pattern}', '{kept}', 'g')"
    return column
