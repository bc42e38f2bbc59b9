"""A table of versions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramite.plans.registry import query
from engramite.session import scratch_path
from engramite.sources.versions import Table


@query("SRC2_versions", """SELECT doc_id, source, CASE WHEN lang = 'de' THEN n_chars + 1 ELSE n_chars END AS n_chars, CAST(3 AS BIGINT) AS version FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def versions(t):
    """All documents, then new rows for those of one language, then the toxic ones deleted; read as of the third version."""
    table = Table(t.spark, scratch_path(t.spark, "versions"), ["doc_id"])
    rows = t.documents.select("doc_id", "source", "n_chars", "lang")
    table.add(rows)
    table.add(rows.where("lang = 'de'").withColumn("n_chars", F.col("n_chars") + 1))
    table.delete(t.labels.where("toxic = 1"))
    return table.read(3).select("doc_id", "source", "n_chars", F.lit(table.version().number).cast("long").alias("version"))
