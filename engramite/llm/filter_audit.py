"""Filter interaction audit: what each filter removes, alone and after others, in every order of the filters.

Method: sort-based duplicates and additive counters. Documents are range-sorted by (fingerprint of the text, full text,
id): the ranges are cut by (fingerprint, id), so that a group of copies of any size lies over as many ranges as it
needs and the cut points are narrow, and each range is sorted by all three. One pass over a range judges every document
(a mask with a bit for each filter it fails) and compares it with its predecessors of the same text. Only what stands
first in a range can have a copy in an earlier one: a range gives the runs of its first and last fingerprint with their
least ids, and the least id of a text over all of these tells the open documents. Then documents are merged into
counters of (part, mask, good, toxic), a few rows a part, from which every order and step is a sum.

Edge cases: a null text is empty; a null part is ''; documents with a null id are no copies and make none; rows of one
id are not each other's copies, whatever their texts; a label counts for every row of its id, one of several labels of
an id is enough, labels of no document and null labels count for nothing; an empty table has no part and gives no row;
further columns are not read, whatever their names. Without labels good and toxic counts are 0.
"""

from __future__ import annotations

import itertools
import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from engramite.llm._batches import give_back, id_type, short_batches, slices
from engramite.session import scratch_path

_CAPITALS, _SYMBOLS = string.ascii_uppercase.encode(), b"#$%&*|"


@dataclass(frozen=True)
class Audit:
    """The thresholds of the filters.

    A: fewer than ``words`` words. B: distinct words under ``distinct`` percent of the words. C: A to Z over
    ``capitals`` percent of the characters. D: any of ``#$%&*|``. E: the text of a document with a smaller id.
    """

    words: int = 100
    distinct: int = 80
    capitals: int = 10

    def mask(self, text: str) -> int:
        """The filters A to D that a text fails, as bits 0 to 3."""
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.split()  # of bytes: space and 0x09 to 0x0D
        failed = len(words) < self.words
        failed |= (100 * len(set(words)) < self.distinct * len(words)) << 1
        failed |= (100 * (len(raw) - len(raw.translate(None, _CAPITALS))) > self.capitals * len(text)) << 2
        return failed | (len(raw.translate(None, _SYMBOLS)) < len(raw)) << 3


FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")


class _Runs:
    """The runs of equal texts that a sorted range goes through: id and least id of each, those of the first and of the present fingerprint kept."""

    def __init__(self) -> None:
        self.mark = None
        self.first = True
        self.runs: dict[str, list] = {}
        self.edges: list[tuple] = []

    def enter(self, mark: int, text: str, key) -> tuple[bool, int | None]:
        """(is a copy, run whose earlier ranges decide): of the next row."""
        if mark != self.mark:
            if self.mark is not None:
                self._close(self.first)
                self.first = False
            self.mark, self.runs = mark, {}
        if key is None:
            return False, None
        run = self.runs.get(text)
        if run is None:
            run = self.runs[text] = [len(self.runs), key]
        if key != run[1]:
            return True, None
        return False, run[0] if self.first else None

    def _close(self, wanted: bool) -> None:
        if wanted:
            self.edges += [(self.mark, text, run, least) for text, (run, least) in self.runs.items()]

    def end(self) -> list[tuple]:
        if self.mark is not None:
            self._close(True)
        return self.edges


def _judge(audit: Callable[[str], int], out: pa.Schema) -> Callable:
    """A pass over sorted ranges: a row for each document, then one for each run at an edge of the range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, place = _Runs(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch):
                marks, texts, ids = (part.column(k).to_pylist() for k in range(3))
                masks, open_runs = [], []
                for mark, text, key in zip(marks, texts, ids):
                    copy, decides = runs.enter(mark, text, key)
                    masks.append(audit(text) | copy * COPY)
                    open_runs.append(None if decides is None else place + decides)
                none = [None] * len(ids)
                yield pa.RecordBatch.from_pydict({"id": ids, "part": part.column(3), "mask": masks, "open_run": open_runs, "mark": none, "text": none}, schema=out)
            del batch
            give_back()
        edges, first = runs.end(), runs.edges[0][0] if runs.edges else None
        for mark, text, run, least in edges:  # runs of the last fingerprint alone decide nothing here: their number is left out
            number = place + run if mark == first else None
            yield pa.RecordBatch.from_pydict({"id": [least], "part": [None], "mask": [None], "open_run": [number], "mark": [mark], "text": [text]}, schema=out)

    return run


def masks(docs: DataFrame, audit: Callable[[str], int] | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, mask) of every document: the filters it fails as bits, A the lowest; bit 4 for copies of a smaller id's text.

    ``audit`` gives the bits of a text alone and stands for ``Audit().mask``. The sorted pass is written once to the shared folder.
    """
    spark = docs.sparkSession
    short_batches(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.xxhash64(text).alias("mark"), text.alias("text"), F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    ranged = rows.repartitionByRange("mark", "id").sortWithinPartitions("mark", "text", "id")
    schema = f"id {id_type(docs, id_col)}, part string, mask int, open_run long, mark long, text string"
    path = scratch_path(spark, "filter-audit")
    ranged.mapInArrow(_judge(audit or Audit().mask, to_arrow_schema(StructType.fromDDL(schema))), schema).write.parquet(path)

    judged = spark.read.parquet(path)
    edges = judged.where("mark is not null")
    least = edges.groupBy("mark", "text").agg(F.min("id").alias("least"))
    opened = edges.where("open_run is not null").join(least, ["mark", "text"]).where("least < id").select("open_run", F.lit(COPY).alias("late"))
    rows = judged.where("mark is null").select("id", "part", "mask", "open_run")
    waiting = rows.where("open_run is not null").join(opened, "open_run", "left")
    return rows.where("open_run is null").select("id", "part", "mask").unionAll(
        waiting.select("id", "part", (F.col("mask") + F.coalesce("late", F.lit(0))).alias("mask"))
    )


def counters(judged: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, good, toxic, n): the documents of each kind."""
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    flags = (F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic"))
    return judged.join(known, "id", "left").groupBy("part", "mask", *flags).agg(F.count("*").alias("n"))


def _orders() -> list[tuple[str, int, int, int]]:
    """(order, step, bit of the step's filter, bits of the filters before it) of all orders of the filters."""
    out = []
    for order in itertools.permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            out.append(("".join(order), step, bit, before))
            before |= bit
    return out


def report(counts: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every part, order and step.

    A step's counts depend on its filter and on the set of those before it, not on their order, so sums are taken for
    the 80 pairs of filter and set and then written under the 600 steps.
    """
    steps = _orders()
    pairs = sorted({(bit, before) for _, _, bit, before in steps})
    pair = F.explode(F.array(*[F.struct(F.lit(b).alias("bit"), F.lit(s).alias("before")) for b, s in pairs]))
    rows = counts.select("*", pair.alias("p")).select("part", "mask", "good", "toxic", "n", "p.bit", "p.before")
    mask, bit, before, n = (F.col(c) for c in ("mask", "bit", "before", "n"))
    fails, gone = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(before) != 0
    # of all orders, the filter is the first of a document's failures in this share of them
    turns = F.lit(len(steps) // len(FILTERS)) / F.bit_count(mask)

    def total(when, value=n):
        return F.sum(F.when(when, value).otherwise(0)).cast("long")

    sums = rows.groupBy("part", "bit", "before").agg(
        total(~gone & ~fails).alias("kept"),
        total(~gone & fails).alias("removed"),
        total(gone & fails).alias("redundant"),
        total(mask == bit).alias("unique_fails"),
        total(~gone & fails & (F.col("good") == 1)).alias("good_lost"),
        total(~gone & fails & (F.col("toxic") == 1)).alias("toxic_lost"),
        total(fails, n * turns.cast("long")).alias("shapley"),
    )
    named = counts.sparkSession.createDataFrame(steps, "filter_order string, step int, bit int, before int")
    return sums.join(F.broadcast(named), ["bit", "before"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
