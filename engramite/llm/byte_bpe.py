"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each match of the split pattern is encoded on its own. The pending pairs of a match lie in one bucket per merge
rank; a two-level bitmap over the ranks gives the lowest non-empty bucket by find-first-set, and a bucket gives its
leftmost position first. Parts form a linked list, so a merge touches two neighbours only. Entries whose pair has
changed since are stale and skipped. The cost of a match of n bytes is O(n log n) at worst, however long it is.
Matches are independent, so all new matches of a slice of texts share one queue.

Edge cases: a null text counts as empty; an empty text has no ids; repeated rows give repeated results; an empty
table gives an empty result; a null id is kept; other columns are ignored. Matches are memoised in each
Python worker, in two generations of about ``MEMO_ENTRIES`` each; what the older one alone has goes with it.
"""

from __future__ import annotations

import base64
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramite.llm._batches import id_type, map_texts

#: Entries of a generation of the memo of a Python worker.
MEMO_ENTRIES = 300_000

#: The white space of Unicode, for split patterns whose ``\\s`` means White_Space.
WHITE_SPACE = r"\t-\r\x20\x85\xa0  -     　"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class RankQueue:
    """Buckets of positions by rank; a summary bitmap over words of ``1 << SHIFT`` ranks finds the first one."""

    SHIFT = 8

    def __init__(self) -> None:
        self.summary = 0
        self.words: dict[int, int] = {}
        self.buckets: dict[int, list[int]] = {}

    def put(self, rank: int, bucket: list[int]) -> None:
        """Add positions under a rank that has none."""
        self.buckets[rank] = bucket
        high = rank >> self.SHIFT
        self.words[high] = self.words.get(high, 0) | 1 << (rank & 255)
        self.summary |= 1 << high

    def take(self) -> tuple[int, list[int]]:
        """Remove and return the lowest rank and its positions; the queue has something."""
        high = (self.summary & -self.summary).bit_length() - 1
        word = self.words[high]
        rank = (high << self.SHIFT) + (word & -word).bit_length() - 1
        word &= word - 1
        if word:
            self.words[high] = word
        else:
            del self.words[high]
            self.summary &= self.summary - 1
        return rank, self.buckets.pop(rank)


class Merger:
    """Encodes many matches with one queue; a merge never crosses the border of a match."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.pairs = np.full(65536, -1, np.int64)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.pairs[token[0] << 8 | token[1]] = rank

    def __call__(self, pieces: list[bytes]) -> list[bytes]:
        """For each non-empty match its ids, as little-endian unsigned 32-bit integers."""
        if not pieces:
            return []
        ranks, look, queue, data = self.ranks, self.ranks.get, RankQueue(), b"".join(pieces)
        n, raw, sizes = len(data), np.frombuffer(data, np.uint8), np.array([len(p) for p in pieces])
        starts = np.cumsum(sizes) - sizes
        first = np.zeros(n + 1, np.uint8)
        first[starts], first[n] = 1, 1
        found = np.append(np.where(first[1:n], -1, self.pairs[raw[:-1].astype(np.int64) << 8 | raw[1:]]), -1)
        whole = [ranks.get(p, -1) for p in pieces]
        for start, size, rank in zip(starts.tolist(), sizes.tolist(), whole, strict=True):
            if rank >= 0:
                found[start : start + size] = -1
        order = np.argsort(found, kind="stable")[int((found < 0).sum()) :]
        kinds, cuts = np.unique(found[order], return_index=True)
        for rank, bucket in zip(kinds.tolist(), np.split(order, cuts[1:]), strict=False):
            queue.put(rank, bucket.tolist())
        first, pending = first.tobytes(), array("i", found.astype(np.int32).tobytes())
        ids = array("i", self.single[raw].astype(np.int32).tobytes())
        after, before = array("i", range(1, n + 1)), array("i", range(-1, n))
        buckets = queue.buckets
        while queue.summary:
            rank, bucket = queue.take()
            bucket.sort(reverse=True)
            while bucket:
                i = bucket.pop()
                if pending[i] != rank:
                    continue
                gone = after[i]
                after[i] = end = after[gone]
                pending[gone], ids[gone], ids[i] = -1, -1, rank
                changed = []
                if first[end]:
                    pending[i] = -1
                else:
                    before[end] = i
                    pending[i] = new = look(data[i : after[end]], -1)
                    if new >= 0:
                        changed.append((new, i))
                if not first[i]:
                    left = before[i]
                    pending[left] = new = look(data[left:end], -1)
                    if new >= 0:
                        changed.append((new, left))
                again = False
                for new, position in changed:
                    if new == rank:
                        bucket.append(position)
                        bucket.sort(reverse=True)
                    elif new in buckets:
                        buckets[new].append(position)
                        again |= new < rank
                    else:
                        queue.put(new, [position])
                        again |= new < rank
                if again and bucket:  # a lower rank came up: it goes first
                    if rank in buckets:
                        buckets[rank] += bucket
                    else:
                        queue.put(rank, bucket)
                    break
        made = np.frombuffer(ids, np.int32).copy()
        for start, size, rank in zip(starts.tolist(), sizes.tolist(), whole, strict=True):
            if rank >= 0:
                made[start], made[start + 1 : start + size] = rank, -1
        live = made >= 0
        blob, ends = made[live].astype("<u4").tobytes(), np.cumsum(np.add.reduceat(live.astype(np.int64), starts)) * 4
        return [blob[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


class Encoder:
    """Splits texts by the pattern and encodes each match; ids come as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        white = pattern.replace(r"[^\s", f"[^{WHITE_SPACE}").replace(r"\S", f"[^{WHITE_SPACE}]").replace(r"\s", f"[{WHITE_SPACE}]")
        self.find, self.merge, self.memo, self.older = regex.compile(white).findall, Merger(ranks), {}, {}

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        found = [self.find(t) if t else [] for t in texts]
        matches = set().union(*found)
        if len(self.memo) + len(matches) > MEMO_ENTRIES:
            self.memo, self.older = {}, self.memo
        new = matches - self.memo.keys()
        known = new & self.older.keys()
        self.memo.update(zip(known, map(self.older.__getitem__, known), strict=True))
        new = list(new - known)
        self.memo.update(zip(new, self.merge([p.encode("utf-8") for p in new]), strict=True))
        look = self.memo.__getitem__
        return [b"".join(map(look, x)) for x in found]


#: One encoder for each (file, pattern) in a Python worker, kept from task to task.
_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(ranks_path: str, pattern: str) -> Encoder:
    if (ranks_path, pattern) not in _ENCODERS:
        _ENCODERS[ranks_path, pattern] = Encoder(load_ranks(ranks_path), pattern)
    return _ENCODERS[ranks_path, pattern]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids): the ids of every whole text as a binary of little-endian unsigned 32-bit integers."""

    def make():
        encode_texts = encoder(ranks_path, pattern)

        def work(keys: list, texts: list) -> dict:
            ids = encode_texts(texts)
            return {id_col: keys, "n_tokens": [len(x) // 4 for x in ids], "ids": ids}

        return work

    return map_texts(docs, make, f"`{id_col}` {id_type(docs, id_col)}, n_tokens long, ids binary", id_col, text_col)


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_tokens, ids, decoded): the bytes that the ids of each row stand for."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = f"`{id_col}` {id_type(encoded, id_col)}, n_tokens long, ids binary, decoded binary"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        ranks = load_ranks(ranks_path)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                out = [b"".join(map(tokens.__getitem__, np.frombuffer(x or b"", "<u4").tolist())) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], schema=arrow)

    return encoded.select(id_col, "n_tokens", "ids").mapInArrow(run, schema)


def digests(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return decoded.select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
