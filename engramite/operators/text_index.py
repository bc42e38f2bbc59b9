"""A text index that stays: postings of weighted fields in blocks with bounds, segments that are added and merged.

A segment is a table of postings in buckets by term: a row holds a term's postings of one block of documents (key,
weighted occurrences) with their number, the most occurrences and the least length, so the best score that a
document of the block can get is known without reading its list. Rows without a term, in buckets of their own, hold the
lengths of a block's documents in place of occurrences; beside the postings stand the first two and three letters of the terms. A search reads
the rows of its terms only: bounds first, then lists of the blocks with the best bounds, which give a score to beat, then
lists of the blocks whose bound is not below it. Results are those of a scan.

A block is made in the task that counts its documents' words, so that lists, not words, are shuffled, once. A merge
shuffles lists once: superseded documents are taken out of them, and lists of small blocks are put together.

Segments are never changed. A manifest names those that are live at each version; a version is one appended row group,
so a reader sees the old segments or the new ones. A document that comes again in a later segment replaces the earlier.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from engramite.functions import text as tx
from engramite.session import written

#: Documents of a block at most, where it is made; buckets of terms, and of rows without one; parts that a bucket is sorted in.
BLOCK_DOCS, BUCKETS, DOC_BUCKETS, PARTS = 4096, 64, 16, 8
#: Documents whose words are counted at a time.
ROWS = 100
#: Blocks whose documents are scored to get a score to beat.
FIRST_BLOCKS = 8


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _live(spark: SparkSession, path: str) -> tuple[int, list[tuple[str, int]]]:
    """(version, [(segment, its number)]) of the latest version."""
    rows = spark.read.parquet(f"{path}/manifest")
    last = rows.agg(F.max("version")).first()[0]
    return last, sorted(((r["segment"], r["number"]) for r in rows.where(F.col("version") == last).collect()), key=lambda x: x[1])


def _commit(spark: SparkSession, path: str, version: int, segments: list[tuple[str, int]]) -> None:
    rows = [(version, s, n) for s, n in segments]
    spark.createDataFrame(rows, "version long, segment string, number long").coalesce(1).write.mode("append").parquet(f"{path}/manifest")


LISTS = ("key", "tf")


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each term of a batch once; files are in order of terms, so few are left twice."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0).unique()], schema=batch.schema)


def _dealt(lists: DataFrame) -> DataFrame:
    """Lists (term, block, least_dl, key, tf) in their buckets, a bucket in parts of its terms."""
    bucket = F.when(F.col("term").isNull(), BUCKETS + F.pmod(F.xxhash64("block"), F.lit(DOC_BUCKETS))).otherwise(_bucket(F.col("term"))).cast("int")
    part = F.pmod(F.xxhash64("term", F.lit(1)), F.lit(PARTS))
    return lists.select("term", "block", "least_dl", *LISTS, bucket.alias("bucket")).repartition("bucket", part).sortWithinPartitions("bucket", "term", "block")


def _write(dealt: DataFrame, path: str) -> None:
    """Lists that are in their buckets and sorted there as a segment."""
    spark = dealt.sparkSession
    made = dealt.select("term", "block", *LISTS, F.size("key").cast("long").alias("n"), F.array_max("tf").alias("top_tf"), "least_dl", "bucket")
    made.write.partitionBy("bucket").parquet(f"{path}/postings")
    terms = spark.read.schema(made.schema).parquet(f"{path}/postings").where(F.col("bucket") < BUCKETS).select("term").mapInArrow(_apart, "term string")
    prefix = F.explode(F.array_distinct(F.array(*[F.substring("term", 1, n) for n in (2, 3)]))).alias("prefix")
    terms.select(prefix, "term").repartition("prefix").sortWithinPartitions("prefix", "term").write.parquet(f"{path}/prefixes")


def _blocks(weights: list[float], schema: pa.Schema, most: int):
    """A pass over (key, words of each field): the lists of each block of documents; that with a null term has the documents' lengths."""

    def lists(held: list[pa.RecordBatch], block: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        term = table["term"].combine_chunks().dictionary_encode()
        codes = term.indices.fill_null(len(term.dictionary)).to_numpy()
        order, edges = np.argsort(codes, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(term.dictionary) + 1))])
        size = table["dl"].to_numpy()[order]
        starts, full = edges[:-1], np.diff(edges) > 0
        least = np.zeros(len(starts), np.int32)
        least[full] = np.minimum.reduceat(size, starts[full])
        columns = [pa.array([*term.dictionary.to_pylist(), None], pa.string()), pa.array(np.full(len(starts), block), pa.int64()), pa.array(least)]
        for name in LISTS:
            columns.append(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), table[name].combine_chunks().take(pa.array(order)), type=schema.field(name).type))
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = pa.schema([("term", pa.string()), *[(name, schema.field(name).type.value_type) for name in LISTS], ("dl", pa.int32())])
        held, docs, block, step = [], 0, TaskContext.get().partitionId() << 24, min(ROWS, most)
        for batch in (whole.slice(at, step) for whole in batches for at in range(0, whole.num_rows, step)):
            keys, fields = batch.column(0).to_pylist(), [c.to_pylist() for c in batch.columns[1:]]
            out: tuple[list, list, list, list] = ([], [], [], [])
            for row, key in enumerate(keys):
                found: dict[str, float] = {}
                for weight, words in zip(weights, fields, strict=True):
                    for word, n in Counter(words[row]).items():
                        found[word] = found.get(word, 0.0) + weight * n
                size = sum(len(words[row]) for words in fields)
                for column, values in zip(out, ([None, *found], [key] * (len(found) + 1), [float(size), *found.values()], [size] * (len(found) + 1)), strict=True):
                    column.extend(values)
            held.append(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, flat, strict=True)], schema=flat))
            docs += len(keys)
            if docs + step > most:
                yield lists(held, block)
                held, docs, block = [], 0, block + 1
        if held:
            yield lists(held, block)

    return run


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of one term and block that follow each other as one; those of two batches stay apart, and bounds add up."""
    for batch in batches:
        if batch.num_rows:
            term = batch.column(0).dictionary_encode().indices.fill_null(-1).to_numpy()
            block = batch.column(1).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])]))
            columns = [c.take(pa.array(starts)) for c in batch.columns]
            for k, name in enumerate(batch.schema.names):
                if name == "least_dl":
                    columns[k] = pa.array(np.minimum.reduceat(batch.column(k).to_numpy(), starts))
                elif name in LISTS:
                    whole = batch.column(k)
                    edges = np.append(whole.offsets.to_numpy()[starts], whole.offsets[-1].as_py())
                    columns[k] = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), whole.values, type=whole.type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)


def add(docs: DataFrame, path: str, key: str, fields: dict[str, float], words=tx.words) -> None:
    """Add documents as a segment; the first call makes the index. Null texts have no words; of rows with one key one counts, null keys are left out."""
    spark = docs.sparkSession
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"t{i}") for i, c in enumerate(fields)])
    if not rows.groupBy("key").count().where("count > 1").isEmpty():
        rows = rows.dropDuplicates(["key"])
    split = rows.select("key", *[words(F.col(f"t{i}")).alias(f"w{i}") for i in range(len(fields))])
    ddl = StructType.fromDDL(f"term string, block long, least_dl int, key array<{rows.schema['key'].dataType.simpleString()}>, tf array<double>")
    segment = f"segment-{uuid.uuid4().hex}"
    _write(_dealt(split.mapInArrow(_blocks([float(w) for w in fields.values()], to_arrow_schema(ddl), BLOCK_DOCS), ddl)), f"{path}/{segment}")
    try:
        version, segments = _live(spark, path)
    except Exception as gone:  # no manifest yet: the index begins here
        if "PATH_NOT_FOUND" not in str(gone):
            raise
        version, segments = 0, []
    _commit(spark, path, version + 1, [*segments, (segment, max((n for _, n in segments), default=0) + 1)])


def _read(spark: SparkSession, path: str, segments: list[tuple[str, int]], table: str) -> DataFrame:
    out = None
    for segment, number in segments:
        rows = spark.read.parquet(f"{path}/{segment}/{table}").withColumn("number", F.lit(number))
        out = rows if out is None else out.unionByName(rows)
    return out


def _postings(spark: SparkSession, path: str, segments: list[tuple[str, int]]) -> DataFrame:
    return _read(spark, path, segments, "postings").withColumn("list", F.arrays_zip(*LISTS))


def _documents(spark: SparkSession, path: str, segments: list[tuple[str, int]]) -> DataFrame:
    """(key, dl, number, block) of the documents of all segments."""
    rows = _postings(spark, path, segments).where(F.col("bucket") >= BUCKETS)
    return rows.select("number", "block", F.explode("list").alias("p")).select("p.key", F.col("p.tf").cast("long").alias("dl"), "number", "block")


def _current(spark: SparkSession, path: str, segments: list[tuple[str, int]]) -> DataFrame:
    """(key, dl, number) of the live documents: the latest segment of each key."""
    rows = _documents(spark, path, segments).select("key", "dl", "number")
    return rows if len(segments) == 1 else rows.groupBy("key").agg(F.max_by(F.struct("dl", "number"), "number").alias("d")).select("key", "d.*")


def merge(spark: SparkSession, path: str) -> None:
    """Write the live postings of all segments as one; blocks of fewer than ``BLOCK_DOCS`` documents are put together."""
    version, segments = _live(spark, path)
    rows, documents = _postings(spark, path, segments), _documents(spark, path, segments)
    last = documents.groupBy("key").agg(F.count("*").alias("n"), F.max("number").alias("last")).where("n > 1").select("key", "last")
    dead = written(documents.join(last, "key").where("number < last").groupBy("number", "block").agg(F.collect_list("key").alias("dead")), "dead")
    if not dead.isEmpty():
        live = F.filter("list", lambda p: ~F.array_contains("dead", p.key))
        rows = rows.join(dead, ["number", "block"], "left").withColumn("list", F.when(F.col("dead").isNull(), F.col("list")).otherwise(live)).where(F.size("list") > 0)
        rows = rows.select("term", "number", "block", "bucket", "least_dl", "list", *[F.col(f"list.{name}").alias(name) for name in LISTS])
    order, small = Window.orderBy("number", "block"), F.col("n") < BLOCK_DOCS  # over blocks, not rows
    before = F.sum(F.when(small, F.col("n")).otherwise(0)).over(order) - F.col("n")
    sizes = rows.where(F.col("bucket") >= BUCKETS).groupBy("number", "block").agg(F.sum(F.size("list")).alias("n"))
    joined = written(sizes.select("number", "block", F.when(small, -1 - F.floor(before / BLOCK_DOCS)).otherwise(F.row_number().over(order)).cast("long").alias("new")), "blocks")
    dealt = _dealt(rows.join(joined, ["number", "block"]).select("term", F.col("new").alias("block"), "least_dl", *LISTS))
    segment = f"segment-{uuid.uuid4().hex}"
    _write(dealt.mapInArrow(_together, dealt.schema).sortWithinPartitions("bucket", "term", "block"), f"{path}/{segment}")
    _commit(spark, path, version + 1, [(segment, segments[-1][1] + 1)])


def terms_with(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """(term): terms of the index that begin with two letters or more."""
    _, segments = _live(spark, path)
    rows = _read(spark, path, segments, "prefixes").where((F.col("prefix") == prefix[:3]) & F.col("term").startswith(prefix))
    return rows.select("term").distinct()


def search(spark: SparkSession, path: str, terms: list[str], k: int, k1: float = 1.2, b: float = 0.75, first: int = FIRST_BLOCKS) -> DataFrame:
    """(key, score): the k best documents by BM25 for any of the terms; ties go to the smaller key."""
    terms = sorted(set(terms))
    _, segments = _live(spark, path)
    current = _current(spark, path, segments)
    size = current.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avgdl")).first()
    found = _postings(spark, path, segments).where(F.col("bucket").isin(sorted(_buckets_of(spark, terms))) & F.col("term").isin(terms))
    single = len(segments) == 1
    if single:
        counts = found.groupBy("term").agg(F.sum("n").alias("df"))
    else:
        live = found.select("term", "number", F.explode("list.key").alias("key")).join(current.select("key", "number"), ["key", "number"])
        counts = live.groupBy("term").agg(F.count("*").alias("df"))
    idf = {r["term"]: math.log(1 + (size["n"] - r["df"] + 0.5) / (r["df"] + 0.5)) for r in counts.collect()}  # a row for each term asked
    if not idf:
        return current.select("key", F.lit(0.0).alias("score")).limit(0)
    weight = F.element_at(F.create_map(*[F.lit(x) for pair in idf.items() for x in pair]), F.col("term"))
    found = found.where(F.col("term").isin(sorted(idf)))

    def impact(tf: Column, dl: Column) -> Column:
        return weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.lit(size["avgdl"])))

    bounds = found.groupBy("number", "block").agg(F.sum(impact(F.col("top_tf"), F.col("least_dl"))).alias("bound"))

    def scored(blocks: DataFrame) -> DataFrame:
        each = found.join(F.broadcast(blocks.select("number", "block")), ["number", "block"]).select("term", "number", F.explode("list").alias("p"))
        each = each.select("term", "number", "p.key", "p.tf").join(current, ["key", "number"])
        each = each.select("key", impact(F.col("tf"), F.col("dl")).alias("score"))
        return each.groupBy("key").agg(F.sum("score").alias("score")).orderBy(F.desc("score"), "key").limit(k)

    best = scored(bounds.orderBy(F.desc("bound"), "number", "block").limit(first)).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
    beat = best["least"] if best["n"] == k else 0.0
    return scored(bounds.where(F.col("bound") >= beat * (1 - 1e-12)))


def _buckets_of(spark: SparkSession, terms: list[str]) -> set[int]:
    return {r[0] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(_bucket(F.col("term"))).collect()}
