"""Document fingerprints from content-defined chunks.

A gear hash rolls over the UTF-8 bytes of a text; a chunk ends where the hash meets a mask, with a strict mask before
the normal size and a lax one after it (normalised chunking), between a smallest and a largest size. Borders depend on
the bytes near them only, so an insertion shifts borders without moving those further on. The fingerprint is the set
of chunk digests, each with its chunk's length; containment of one text in another is the length of the chunks that
both have over the length of the first one's chunks.

``next_documents`` pairs each row with the following one in id order without a global sort in one task: split points
of the ids give buckets, the first row of each bucket is copied into the bucket before it, and one shuffle brings the
rows of a bucket together, where they are sorted.

Edge cases: a null text counts as empty; the fingerprint of an empty text is empty, two empty fingerprints have
likeness 1, one empty and one not have 0; rows with the same id are ordered by their text; rows with a null id come
first; an empty table gives an empty result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramite.llm._batches import SLICE_BYTES, id_type, map_texts, short_batches

#: Smallest, normal and largest chunk in bytes, and the bits of the strict and the lax mask.
SMALLEST, NORMAL, LARGEST, STRICT_BITS, LAX_BITS = 8, 16, 64, 5, 3
#: Bytes that the rolling hash looks back on.
WINDOW = 8

#: Bits of a chunk digest: sets are compared two at a time, so few are enough.
DIGEST_BITS = 36
#: Fixed value: the signs of a fingerprint's text, in order of their six bits.
SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
_TWO = [a + b for a in SIGNS for b in SIGNS]

#: Random 32-bit value of each byte, from a fixed seed.
GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hashes(raw: np.ndarray) -> np.ndarray:
    """At each byte the gear hash of the last WINDOW bytes: sum of GEAR[b] << age, by doubling."""
    value, span = GEAR[raw], 1
    while span < WINDOW:
        value[span:] += value[:-span] << np.uint32(span)
        span *= 2
    return value


def chunk_ends(hashes: np.ndarray) -> list[int]:
    """Ends of the chunks of one text, from the hash at each byte."""
    n = len(hashes)
    lax = np.flatnonzero((hashes >> np.uint32(32 - LAX_BITS)) == 0)
    strict = lax[(hashes[lax] >> np.uint32(32 - STRICT_BITS)) == 0].tolist()
    lax = lax.tolist()
    ends, start, a, b, na, nb = [], 0, 0, 0, len(strict), len(lax)
    while n - start > SMALLEST:
        low, normal, high = start + SMALLEST, start + NORMAL, min(start + LARGEST, n)
        while a < na and strict[a] + 1 < low:
            a += 1
        if a < na and strict[a] + 1 <= min(normal, high):
            end = strict[a] + 1
        else:
            while b < nb and lax[b] + 1 <= normal:
                b += 1
            end = lax[b] + 1 if b < nb and lax[b] + 1 <= high else high
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def chunk_sets(texts: list[bytes]) -> list[dict[int, int]]:
    """For each text its chunk digests with their lengths in bytes."""
    out = []
    digest = xxhash.xxh3_64_intdigest
    for text in texts:
        chunks, start = {}, 0
        if text:
            for end in chunk_ends(gear_hashes(np.frombuffer(text, np.uint8))):
                chunks[digest(text[start:end]) >> (64 - DIGEST_BITS)] = end - start
                start = end
        out.append(chunks)
    return out


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """Share of a's distinct chunks, by length, that b has too."""
    if not a or not b:
        return float(not a and not b)
    return sum(a[k] for k in a.keys() & b.keys()) / sum(a.values())


def render(chunks: dict[int, int]) -> str:
    """Seven signs a chunk in ascending order of digests: six for the digest, one for the length less one."""
    return "".join([f"{_TWO[k >> 24]}{_TWO[k >> 12 & 4095]}{_TWO[k & 4095]}{SIGNS[chunks[k] - 1]}" for k in sorted(chunks)])


def parse(text: str) -> dict[int, int]:
    """The chunk set that ``render`` wrote."""
    value = {c: k for k, c in enumerate(SIGNS)}
    out = {}
    for at in range(0, len(text), 7):
        digest = 0
        for sign in text[at : at + 6]:
            digest = digest << 6 | value[sign]
        out[digest] = value[text[at + 6]] + 1
    return out


def bucket_of(column: Column, points: list[int]) -> Column:
    """How many of the ascending points are at most the value, by bisection; 0 for null."""
    if not points:
        return F.lit(0)
    steps, held = F.array(*[F.lit(1 << k) for k in reversed(range(len(points).bit_length()))]), F.array(*map(F.lit, points))
    found = F.aggregate(steps, F.lit(0), lambda n, s: F.when((n + s <= len(points)) & (F.get(held, n + s - 1) <= column), n + s).otherwise(n))
    return F.when(column.isNull(), 0).otherwise(found)


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, chunks): the chunk set of every whole text as an array of (digest, length)."""

    def make():
        def work(keys: list, texts: list) -> dict:
            sets = chunk_sets([(t or "").encode("utf-8") for t in texts])
            return {id_col: keys, "chunks": [[{"digest": f"{k:09x}", "length": c[k]} for k in sorted(c)] for c in sets]}

        return work

    return map_texts(docs, make, f"`{id_col}` {id_type(docs, id_col)}, chunks array<struct<digest:string,length:int>>", id_col, text_col)


def next_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> tuple[DataFrame, int]:
    """(bucket, copy, id, text) with every bucket's rows and, as ``copy`` 1, the row that follows its last one.

    Split points are at most four a partition, from a quantile sketch of the ids; they only decide how even the
    buckets are. The rows copied are one for each bucket.
    """
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    count = 4 * partitions
    points = docs.stat.approxQuantile(id_col, [i / count for i in range(1, count)], 0.1 / count) if docs.schema[id_col].dataType.typeName() != "string" else []
    points = sorted({int(p) for p in points})
    rows = rows.withColumn("bucket", bucket_of(F.col("id"), points))
    # the first row of each bucket, by (id, text); its text is fetched for the smallest id only
    heads = rows.groupBy("bucket").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id")).alias("first")).select("bucket", "first.id").collect()
    order = sorted(heads, key=lambda r: r["bucket"])
    follows = {r["bucket"]: order[k - 1]["bucket"] for k, r in enumerate(order)}  # the first follows the last
    first = spark.createDataFrame([(r["bucket"], r["id"], follows[r["bucket"]]) for r in order], f"b int, i {id_type(docs, id_col)}, to int")
    copies = (
        rows.join(F.broadcast(first), (F.col("bucket") == F.col("b")) & F.col("id").eqNullSafe(F.col("i")), "inner")
        .groupBy("to")
        .agg(F.min(F.struct("id", "text")).alias("row"))
        .select(F.col("to").alias("bucket"), F.lit(1).alias("copy"), "row.id", "row.text")
    )
    both = rows.select("bucket", F.lit(0).alias("copy"), "id", "text").unionByName(copies)
    return both.repartition(partitions, "bucket").sortWithinPartitions("bucket", "copy", F.col("id").asc_nulls_first(), "text"), partitions


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and the likeness (containment of the text in the other) of the edited and the next text.

    (id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_chunks). A task holds
    one slice of rows at a time; after the last row comes the first.
    """
    schema = f"`{id_col}` {id_type(docs, id_col)}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_chunks long"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def compare(rows: list[tuple]) -> pa.RecordBatch:
        """rows: (bucket, copy, id, text); the last one is only what follows."""
        raw = [r[3].encode("utf-8") for r in rows]
        other = [edited(a[3], b[3]) for a, b in zip(rows, rows[1:], strict=False)]
        other_raw = [t.encode("utf-8") for t in other]
        own, changed = chunk_sets(raw), chunk_sets(other_raw)
        kept = [k for k in range(len(rows) - 1) if not rows[k][1] and rows[k][0] == rows[k + 1][0]]
        return pa.RecordBatch.from_pydict(
            {
                id_col: [rows[k][2] for k in kept],
                "n_chars": [len(rows[k][3]) for k in kept],
                "edited_sha256": [hashlib.sha256(other_raw[k]).hexdigest() for k in kept],
                "fingerprint": [render(own[k]) for k in kept],
                "edited_fingerprint": [render(changed[k]) for k in kept],
                "near_edited": [containment(own[k], changed[k]) for k in kept],
                "near_next": [containment(own[k], own[k + 1]) for k in kept],
                "n_chunks": [len(own[k]) for k in kept],
            },
            schema=arrow,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                size += len(row[3])
                if size > SLICE_BYTES and len(held) > 1:
                    yield compare(held)
                    held, size = held[-1:], len(row[3])
        if len(held) > 1:
            yield compare(held)

    short_batches(docs.sparkSession)
    return next_documents(docs, id_col, text_col)[0].mapInArrow(run, schema)
