"""Removal of long repeated byte strings, by a common-prefix-aware distributed merge sort of suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller id. Strings are
judged on the input and never cross documents.

1. Anchors. Of the ``GRAM``-byte grams in a window of ``length`` bytes those with the least hash are anchors, so equal
   windows have equal anchors wherever they stand. Only anchors that two documents have go on (``_runs``).
2. Runs. A run (a bucket of documents) cuts out, for each such anchor, the suffix from the anchor on and, reversed,
   the bytes before it, as far as a window with the anchor reaches. It sorts them, keeps each one once with its
   smallest id, front-codes them (common prefix with the one before, and the rest), and deals them by splitters to the
   merge tasks. Only these are exchanged.
3. Merge. A loser tree combines the sorted runs. It knows for each player the common prefix with the last winner and
   compares on from there, so no known prefix is read again. Entries of one anchor come out side by side; for each
   window of an entry the smallest id that has it is sent back to the run.
4. Marks. A run marks the windows of its documents whose smallest id is another, smaller one, and cuts them out.

What is exchanged for a frequent string is one entry for each run, however many documents of the run have it.

Edge cases: null texts count as empty; texts shorter than ``length`` lose nothing; rows with a null id are not
compared and lose nothing; rows with the same id are one document, so they take nothing from each other; an empty
table gives an empty result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramite.llm import _runs, _words
from engramite.llm._batches import tidy

#: Bytes of the grams that anchors are chosen from; bytes of a long text looked at together; documents sampled for splitters.
GRAM, PIECE, SAMPLED = 24, 1 << 18, 400
#: Bytes hashed together, and anchors whose entries are cut out together.
TOGETHER, CUT = 1 << 19, 1 << 14

_HUGE = np.uint64((1 << 64) - 1)


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over each ``width`` successive values, by doubling; len(values) - width + 1 results."""
    span, now = 1, values
    while span * 2 <= width:
        now = pick(now[:-span], now[span:])
        span *= 2
    return pick(now[: len(values) - width + 1], now[width - span :]) if span < width else now


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, hash) of the anchors of each text, in order."""
    width = length - GRAM + 1
    pieces = [(k, at, t[at : at + PIECE + length - 1]) for k, t in enumerate(texts) if len(t) >= length for at in range(0, max(1, len(t) - length + 1), PIECE)]
    owners, places, found, group, size = [], [], [], [], 0
    for piece in [*pieces, None]:
        if group and (piece is None or size + len(piece[2]) > TOGETHER):
            raw = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
            n, ends = len(raw), np.cumsum([len(p) for _, _, p in group])
            power, inverse = _words._powers(n)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_words._VALUE[raw] * power, out=sums[1:])
            hashed = np.full(n, _HUGE)
            hashed[: n - GRAM + 1] = _words.mix((sums[GRAM:] - sums[: n - GRAM + 1]) * inverse[: n - GRAM + 1]) | np.uint64(1)
            window = np.ones(n, bool)
            for end in ends.tolist():
                hashed[max(0, end - GRAM + 1) : end] = _HUGE
                window[max(0, end - length + 1) : end] = False
            least = np.zeros(n + width - 1, np.uint64)
            least[width - 1 :][: n - width + 1] = _slide(hashed, width, np.minimum)
            least[width - 1 :][~window] = 0
            at = np.flatnonzero((_slide(least, width, np.maximum) == hashed) & (hashed != _HUGE))
            part = np.searchsorted(ends, at, "right")
            owners.append(np.array([k for k, _, _ in group])[part])
            places.append(at - (ends - [len(p) for _, _, p in group])[part] + np.array([o for _, o, _ in group])[part])
            found.append(hashed[at])
            group, size = [], 0
        if piece is not None:
            group.append(piece)
            size += len(piece[2])
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    owner, place, hashed = np.concatenate(owners), np.concatenate(places), np.concatenate(found)
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (place[1:] > place[:-1])  # pieces of a text overlap
    again = np.flatnonzero(~fresh)
    if len(again):
        order = np.lexsort((place, owner))
        owner, place, hashed = owner[order], place[order], hashed[order]
        fresh = np.ones(len(owner), bool)
        fresh[1:] = (owner[1:] != owner[:-1]) | (place[1:] != place[:-1])
    return owner[fresh], place[fresh], hashed[fresh]


class Layout:
    """An entry: the suffix from the anchor, its length + 1, the bytes before the anchor from right to left, their number + 1. Missing bytes are 0."""

    def __init__(self, length: int) -> None:
        self.right, self.left = length, length - GRAM
        self.width = self.right + self.left + 2

    def entries(self, texts: list[bytes], owner: np.ndarray, place: np.ndarray) -> np.ndarray:
        """A row of bytes for each anchor."""
        sizes = np.array([len(t) for t in texts], np.int64)
        pad = b"\0" * self.right
        raw = np.frombuffer(pad + b"".join(texts) + pad, np.uint8)
        base = np.cumsum(sizes) - sizes + len(pad)
        after, before = np.minimum(sizes[owner] - place, self.right), np.minimum(place, self.left)
        out = np.zeros((len(owner), self.width), np.uint8)
        out[:, self.right], out[:, -1] = after + 1, before + 1
        ahead, back = np.arange(self.right), np.arange(self.left)
        for a in range(0, len(owner), CUT):
            some = slice(a, a + CUT)
            at = (base[owner[some]] + place[some])[:, None]
            out[some, : self.right] = np.where(ahead < after[some, None], raw[at + ahead], 0)
            out[some, self.right + 1 : -1] = np.where(back < before[some, None], raw[at - 1 - back], 0)
        return out


def front_code(rows: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Common prefix of each sorted distinct row with the one before, and what follows it."""
    common = np.zeros(len(rows), np.uint8)
    if len(rows) > 1:
        common[1:] = (rows[1:] != rows[:-1]).argmax(axis=1)
    return common, rows[np.arange(rows.shape[1]) >= common[:, None]].tobytes()


class Run:
    """Reads a front-coded run: the current entry, its common prefix with the last one read, and its value."""

    def __init__(self, common: bytes, tails: bytes, values: list[int], width: int) -> None:
        self.common, self.tails, self.values, self.width = common, tails, values, width
        self.at, self.offset, self.entry = 0, 0, b""

    def read(self) -> int:
        """Go to the next entry and return the common prefix; -1 at the end."""
        if self.at == len(self.common):
            return -1
        common = self.common[self.at]
        end = self.offset + self.width - common
        self.entry = self.entry[:common] + self.tails[self.offset : end]
        self.offset, self.at = end, self.at + 1
        return common


def merge(runs: list[Run]):
    """Yields (run number, entry, common prefix with the entry yielded before) in ascending order."""
    k = 1 << max(0, len(runs) - 1).bit_length()
    prefix = [-1] * k
    for i, run in enumerate(runs):
        prefix[i] = min(run.read(), 0)
    losers = [0] * k
    from_bytes = int.from_bytes

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's prefix becomes the one with the winner."""
        x, y = prefix[a], prefix[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        s, t = runs[a].entry, runs[b].entry
        if s == t:
            prefix[b] = len(s)
            return a, b
        differ = (from_bytes(s[x:]) ^ from_bytes(t[x:])).bit_length()
        common = len(s) - (differ + 7 >> 3)
        if s < t:
            prefix[b] = common
            return a, b
        prefix[a] = common
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1)
    while prefix[winner] >= 0:
        run = runs[winner]
        yield winner, run.entry, prefix[winner]
        prefix[winner] = run.read()
        node = winner + k >> 1
        while node:
            other = losers[node]
            x, y = prefix[winner], prefix[other]
            if x < y:
                losers[node], winner = winner, other
            elif x == y and x >= 0:
                winner, losers[node] = play(winner, other)
            node >>= 1


def _answer(group: list[tuple[bytes, int]], layout: Layout) -> list[int | list[int]]:
    """For each distinct entry (with its smallest id) of an anchor: the smallest id for all its windows, or one for each number of bytes before the anchor (-1: no such window)."""
    if len(group) == 1:
        return [group[0][1]]
    right, left = layout.right, layout.left
    out = [[-1] * (left + 1) for _ in group]
    for back in range(left + 1):
        ahead, least, keys = right - back, {}, []
        for k, (entry, doc) in enumerate(group):
            if entry[right] > ahead and entry[-1] > back:
                key = entry[:ahead] + entry[right + 1 : right + 1 + back]
                keys.append((k, key))
                if doc < least.get(key, doc + 1):
                    least[key] = doc
        for k, key in keys:
            out[k][back] = least[key]
    return [max(a) if len({x for x in a if x >= 0}) <= 1 else a for a in out]


_DEALT = "part int, run int, kind int, data binary"
_DEALT_SCHEMA = pa.schema([("part", pa.int32()), ("run", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])


def _write(*arrays: np.ndarray | bytes) -> bytes:
    parts = [a if isinstance(a, bytes) else a.tobytes() for a in arrays]
    return zlib.compress(np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts), 1)


def _parse(data: bytes, count: int) -> list[bytes]:
    data = zlib.decompress(data)
    cuts = np.cumsum([8 * count, *np.frombuffer(data[: 8 * count], np.int64)]).tolist()
    return [data[a:b] for a, b in pairwise(cuts)]


def _texts(table: pa.Table) -> tuple[list[int], list[bytes]]:
    """Ids and texts of a run in ascending order, so that a row has the same number each time the run is read.

    Spark does not fix the order of rows within a group: blocks come from several executors in any order, and anew
    after a retry. Rows with the same id and text are alike in all that is computed.
    """
    raw = (t.encode("utf-8", "surrogatepass") for t in table.column("text").to_pylist())
    rows = sorted(zip(table.column("id").to_pylist(), raw, strict=True))
    return [i for i, _ in rows], [t for _, t in rows]


def find_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, spans, kept): the removed runs of bytes as array of (start, stop), and the remaining bytes."""
    if length <= GRAM or length > 250:
        raise ValueError(f"length must be over {GRAM} and at most 250")
    layout = Layout(length)
    total = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    runs, bits = _runs.runs_for(total["b"]), _runs.part_bits(total["b"] * 2 / (length - GRAM + 2))
    texts = _runs.by_run(docs, runs, id_col, text_col)

    # splitters: grams of anchors of a bounded number of documents; they only decide how even the merge tasks are
    every = max(1, total["n"] // SAMPLED)

    def grams(batches):
        for batch in batches:
            raw = [t.encode("utf-8", "surrogatepass")[: PIECE] for t in batch.column(0).to_pylist()]
            owner, place, _ = anchors(raw, length)
            for k in np.unique(owner).tolist():
                own = place[owner == k]
                own = own[:: max(1, len(own) // 32)].tolist()
                yield pa.RecordBatch.from_arrays([pa.array([raw[k][p : p + GRAM] for p in own], pa.binary())], names=["gram"])

    sample = texts.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(every)) == 0).select("text").mapInArrow(grams, "gram binary")
    sample = sorted(bytes(r["gram"]) for r in sample.limit(SAMPLED * 64).collect())
    parts = max(8, runs)
    splitters = sorted({sample[i * len(sample) // parts] for i in range(1, parts)}) if sample else []

    def sent(table: pa.Table) -> pa.Table:
        ids, raw = _texts(table)
        owner, _, hashed = anchors(raw, length)
        return _runs.send(table.column("run")[0].as_py(), hashed, np.array(ids, np.int64)[owner], bits)

    def deal(table: pa.Table, back: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([[]] * 4, schema=_DEALT_SCHEMA)
        run = table.column("run")[0].as_py()
        ids, raw = _texts(table)
        owner, place, hashed = anchors(raw, length)
        keep = _runs.surviving(hashed, back, bits)
        owner, place = owner[keep], place[keep]
        if not len(owner):
            return pa.table([[]] * 4, schema=_DEALT_SCHEMA)
        rows = layout.entries(raw, owner, place)
        flat = rows.view(f"S{layout.width}").ravel()
        docs_of = np.array(ids, np.int64)[owner]
        order = np.lexsort((docs_of, flat))
        fresh = np.ones(len(order), bool)
        fresh[1:] = flat[order][1:] != flat[order][:-1]
        entry = np.empty(len(order), np.int64)
        entry[order] = np.cumsum(fresh) - 1
        first = order[fresh]
        rows, least = rows[first], docs_of[first]
        cuts = np.searchsorted(rows[:, :GRAM].copy().view(f"S{GRAM}").ravel(), np.array(splitters, f"S{GRAM}")) if splitters else []
        out = []
        for part, (a, b) in enumerate(pairwise([0, *(int(c) for c in cuts), len(rows)])):
            if b > a:
                out.append((part, run, 0, _write(*front_code(rows[a:b]), least[a:b])))
        # where the run's own entries stand comes along, to be there when the answers are
        out.append((-1 - run, run, 1, _write(owner.astype(np.int32), place.astype(np.int64), entry.astype(np.int32))))
        return pa.table([pa.array([r[k] for r in out], f.type) for k, f in enumerate(_DEALT_SCHEMA)], schema=_DEALT_SCHEMA)

    def combine(table: pa.Table) -> pa.Table:
        if table.column("part")[0].as_py() < 0:
            return table.select(["part", "run", "kind", "data"])
        numbers = table.column("run").to_pylist()
        players = []
        for data in table.column("data").to_pylist():
            common, tails, least = _parse(data, 3)
            players.append(Run(common, tails, np.frombuffer(least, np.int64).tolist(), layout.width))
        answers = [[] for _ in players]
        group, members = [], []

        def finish() -> None:
            for found, of in zip(_answer(group, layout), members, strict=True):
                for player in of:
                    answers[player].append(found)

        for player, entry, common in merge(players):
            doc = players[player].values[players[player].at - 1]
            if common < GRAM and group:
                finish()
                group, members = [], []
            if common == layout.width and group:
                members[-1].append(player)
                if doc < group[-1][1]:
                    group[-1] = entry, doc
            else:
                group.append((entry, doc))
                members.append([player])
        if group:
            finish()
        out = []
        for number, found in zip(numbers, answers, strict=True):
            mixed = [k for k, a in enumerate(found) if isinstance(a, list)]
            same = np.array([-2 if isinstance(a, list) else a for a in found], np.int64)
            out.append((table.column("part")[0].as_py(), number, 0, _write(same, np.array(mixed, np.int64), np.array([found[k] for k in mixed], np.int64))))
        return pa.table([pa.array([r[k] for r in out], f.type) for k, f in enumerate(_DEALT_SCHEMA)], schema=_DEALT_SCHEMA)

    result_ddl = "id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary"
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    result = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("spans", span_type), ("kept", pa.binary())])

    def mark(table: pa.Table, back: pa.Table) -> pa.Table:
        ids, raw = _texts(table)
        if not ids:
            return pa.table([[]] * 4, schema=result)
        sizes = np.array([len(t) for t in raw], np.int64)
        base = np.cumsum(sizes + 1) - sizes - 1
        step = np.zeros(int((sizes + 1).sum()) + 1, np.int32)
        pieces = sorted(zip(back.column("kind").to_pylist(), back.column("part").to_pylist(), back.column("data").to_pylist(), strict=True))
        own = [d for kind, _, d in pieces if kind == 1]
        if own:
            owner, place, entry = (np.frombuffer(x, t).astype(np.int64) for x, t in zip(_parse(own[0], 3), (np.int32, np.int64, np.int32), strict=True))
            same, table_of, mixed = [], [], []
            for kind, _, data in pieces:
                if kind == 0:
                    a, b, c = (np.frombuffer(x, np.int64) for x in _parse(data, 3))
                    table_of.append(np.full(len(a), -1, np.int64))
                    table_of[-1][b] = sum(len(m) for m in mixed) + np.arange(len(b))
                    mixed.append(c.reshape(-1, layout.left + 1))
                    same.append(a)
            same, table_of, mixed = np.concatenate(same)[entry], np.concatenate(table_of)[entry], np.concatenate(mixed)
            doc, at = np.array(ids, np.int64)[owner], base[owner] + place
            after, before = np.minimum(sizes[owner] - place, layout.right), np.minimum(place, layout.left)
            hit = (table_of < 0) & (same < doc) & (after + before >= length)
            low, high = at - before, at - np.maximum(0, length - after) + length
            np.add.at(step, low[hit], 1)
            np.add.at(step, high[hit], -1)
            some = np.flatnonzero(table_of >= 0)
            least = mixed[table_of[some]]
            for back_by in range(layout.left + 1):
                hit = some[(least[:, back_by] != -1) & (least[:, back_by] < doc[some]) & (before[some] >= back_by) & (after[some] >= length - back_by)]
                np.add.at(step, at[hit] - back_by, 1)
                np.add.at(step, at[hit] - back_by + length, -1)
        covered = np.cumsum(step) > 0
        out = []
        for doc, text, start in zip(ids, raw, base.tolist(), strict=True):
            edge = np.flatnonzero(np.diff(np.concatenate([[False], covered[start : start + len(text)], [False]]).astype(np.int8)))
            spans = [{"start": a, "stop": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
            kept = b"".join(text[a:b] for a, b in zip([0, *edge[1::2].tolist()], [*edge[::2].tolist(), len(text)], strict=True))
            out.append((doc, len(text), spans, kept))
        return pa.table([pa.array([r[k] for r in out], f.type) for k, f in enumerate(result)], schema=result)

    back = _runs.survivors(texts.groupBy("run").applyInArrow(tidy(sent), _runs.SENT))
    dealt = texts.groupBy("run").cogroup(back.groupBy("run")).applyInArrow(tidy(deal), _DEALT)
    answers = dealt.groupBy("part").applyInArrow(tidy(combine), _DEALT)
    found = texts.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(tidy(mark), result_ddl)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lone = docs.where(F.col(id_col).isNull()).select(F.col(id_col).cast("long").alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), F.array().cast("array<struct<start:long,stop:long>>").alias("spans"), text.cast("binary").alias("kept"))
    return found.unionByName(lone).withColumnRenamed("id", id_col)


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select(id_col, "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
