"""Which hashed tokens occur in two documents or more, found without a row for each token.

Documents form runs (buckets of ids of about equal size). A run sends its distinct tokens, packed, to the parts of the
token space; a part sends back to each run those that another run has too or that the run itself has in two
documents. A token is 39 bits within its part, so a chance match can survive; those who use the survivors check them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramite.llm._batches import tidy

#: Bytes of text in a run, and bytes of packed tokens in a part.
RUN_BYTES, PART_BYTES = 4 << 20, 4 << 20
SENT = "part int, run int, tokens binary"
SCHEMA = pa.schema([("part", pa.int32()), ("run", pa.int32()), ("tokens", pa.binary())])


def runs_for(total_bytes: int, run_bytes: int = RUN_BYTES) -> int:
    return max(1, -(-total_bytes // run_bytes))


def part_bits(total_tokens: float, part_bytes: int = PART_BYTES) -> int:
    return max(3, int(total_tokens * 5 // part_bytes).bit_length())


def run_of(id_col: str, runs: int) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(runs)).cast("int")


def by_run(docs: DataFrame, runs: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(run, id, text) of the rows with an id, null texts as empty ones."""
    rows = docs.where(F.col(id_col).isNotNull())
    return rows.select(run_of(id_col, runs).alias("run"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def pack(values: np.ndarray) -> bytes:
    """Integers below 2**40 as five bytes each."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def send(run: int, tokens: np.ndarray, owners: np.ndarray, bits: int) -> pa.Table:
    """Rows of SENT: the distinct tokens of a run, each with a bit that tells whether two owners have it."""
    order = np.lexsort((owners, tokens))
    tokens, owners = tokens[order], owners[order]
    first = np.ones(len(tokens), bool)
    first[1:] = tokens[1:] != tokens[:-1]
    changed = ~first
    changed[1:] &= owners[1:] != owners[:-1]
    starts = np.flatnonzero(first)
    shared = np.add.reduceat(changed.astype(np.int64), starts) > 0 if len(starts) else np.zeros(0, bool)
    tokens = tokens[starts]
    part = (tokens >> np.uint64(64 - bits)).astype(np.int64)
    value = ((tokens >> np.uint64(64 - bits - 39)) & np.uint64((1 << 39) - 1)) << np.uint64(1) | shared.astype(np.uint64)
    cuts = np.searchsorted(part, np.arange((1 << bits) + 1))
    rows = [(p, pack(value[a:b])) for p, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b > a]
    return pa.table([[p for p, _ in rows], [run] * len(rows), [t for _, t in rows]], schema=SCHEMA)


def survivors(sent: DataFrame) -> DataFrame:
    """SENT again: of the tokens of each run those that occur in two documents."""

    def pick(table: pa.Table) -> pa.Table:
        runs, blobs = table.column("run").to_pylist(), [unpack(t) for t in table.column("tokens").to_pylist()]
        values = np.concatenate(blobs)
        order = np.argsort(values >> np.uint64(1), kind="stable")
        key = values[order] >> np.uint64(1)
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        group = np.cumsum(first) - 1
        many = (np.bincount(group) > 1) | (np.bincount(group, weights=(values[order] & np.uint64(1)).astype(float)) > 0)
        keep = np.zeros(len(values), bool)
        keep[order] = many[group]
        edges = np.concatenate([[0], np.cumsum([len(b) for b in blobs])])
        out = [pack(values[a:b][keep[a:b]] >> np.uint64(1)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.table([table.column("part").to_pylist(), runs, out], schema=SCHEMA)

    return sent.groupBy("part").applyInArrow(tidy(pick), SENT).where(F.length("tokens") > 0)


def surviving(tokens: np.ndarray, table: pa.Table, bits: int) -> np.ndarray:
    """Which of a run's tokens are among the survivors that came back."""
    got = [unpack(b) | np.uint64(p << 39) for p, b in zip(table.column("part").to_pylist(), table.column("tokens").to_pylist(), strict=True) if b is not None]
    back = np.concatenate(got) if got else np.zeros(0, np.uint64)
    return np.isin(tokens >> np.uint64(64 - bits - 39), back)
