"""Arrow plumbing shared by the operators: whole rows, small slices, one id and one text column."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that an operator works on at a time; one longer text is a slice of its own.
SLICE_BYTES = 1 << 19
#: Rows and bytes that Spark sends to Python at a time.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts come to about ``limit`` bytes."""
    if not batch.num_rows:
        return
    lengths = batch.column(batch.schema.get_field_index(text)).to_pylist()
    start = size = 0
    for row, value in enumerate(lengths):
        size += len(value) if value is not None else 0
        if size >= limit:
            yield batch.slice(start, row + 1 - start)
            start, size = row + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def give_back() -> None:
    """Return freed memory to the system; Python workers are kept from task to task, and would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def let_go(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that nothing refers to any more; it notices them when the driver collects garbage, which on a quiet driver may be late."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    give_back()


def tidy(work: Callable) -> Callable:
    """A grouped function that gives freed memory back after each group."""

    def one(table: pa.Table) -> pa.Table:
        try:
            return work(table)
        finally:
            give_back()

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return work(left, right)
        finally:
            give_back()

    return one if work.__code__.co_argcount == 1 else two  # Spark looks at the number of arguments


def short_batches(spark: SparkSession) -> None:
    """Let Spark send at most ``BATCH_ROWS`` rows and ``BATCH_BYTES`` bytes at a time; its defaults are made for short rows.

    The settings are read when a plan runs, which is after an operator has returned, so they stay; they are only ever
    lowered.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int("".join(c for c in spark.conf.get(key) if c.isdigit()) or 0)
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def map_texts(docs: DataFrame, make: Callable[[], Callable[[list, list], dict]], schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Apply a per-slice function to (ids, texts) of every row.

    ``make`` runs once in each Python worker task and returns a function from the two lists to a dict of output
    columns. A null text is passed as None. Columns of ``docs`` other than the two are not read.
    """
    short_batches(docs.sparkSession)
    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_pydict(work(part.column(0).to_pylist(), part.column(1).to_pylist()), schema=arrow)
            del batch
            give_back()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return frame.mapInArrow(run, schema)


def filter_texts(docs: DataFrame, make: Callable[[], Callable[[list], list]], text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text the function of a slice's texts says to keep."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for batch in batches:
            for part in slices(batch, text_col):
                yield part.filter(pa.array(keep(part.column(part.schema.get_field_index(text_col)).to_pylist()), pa.bool_()))
            del batch
            give_back()

    return docs.mapInArrow(run, docs.schema)


def id_type(docs: DataFrame, id_col: str = "doc_id") -> str:
    return docs.schema[id_col].dataType.simpleString()


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
