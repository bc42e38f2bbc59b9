"""Token files: the ids of a shard of documents as a wavelet matrix.

Documents are ordered by id, dealt by ranges of ids, and each range is cut into shards by bytes as it is read; shard
numbers ascend with the ids. Plane k of a shard's matrix holds bit 15 - k (for 16-bit ids) of
every id, in the order in which the earlier planes have sorted them; with counts of ones before each block of 512 bits
an id is read, counted up to a place, or found by its number in one step a plane, without unpacking the file.

The file format: under the target folder one folder ``shard=N`` each with one Parquet file (zstd), one row, and
columns ``n`` (ids), ``width`` (bits an id), ``docs`` and ``sizes`` (64-bit little-endian: document ids and ids a
document), ``known`` (a byte a document: 0 if its id is null), ``zeros`` (zero bits of each plane), and for each plane
k ``plane_k`` (bits, least first) and ``ones_k`` (32-bit counts). Reading a few planes reads those columns only.

Edge cases: a null text counts as empty; an empty one has the end id alone; rows with the same id are ordered by their
text; rows with a null id come first; an empty table writes no shard and reads as an empty result; columns other than
the id and the text are ignored.
"""

from __future__ import annotations

import json
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engramite.llm import _words
from engramite.llm._batches import give_back, short_batches
from engramite.llm.token_counts import BORDER, CONTRACTIONS, LETTER, NUMBER, OTHER, byte_alphabet, character_classes
from engramite.session import scratch_path

#: Bytes of text in a shard (one longer text is a shard of its own); entries of the table of words; bits in a block of the counts.
SHARD_BYTES, MEMO_ENTRIES, BLOCK = 6 << 20, 400_000, 512

#: Characters split together.
TOGETHER = 1 << 18

#: Fixed value: the split pattern that is compiled here.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WaveletMatrix:
    def __init__(self, n: int, zeros: list[int], planes: list[np.ndarray], ones: list[np.ndarray]) -> None:
        self.n, self.zeros, self.planes, self.ones, self.width = n, zeros, planes, ones, len(planes)

    @classmethod
    def build(cls, values: np.ndarray, width: int) -> WaveletMatrix:
        zeros, planes, ones, now = [], [], [], values
        for k in range(width):
            bit = (now & values.dtype.type(1 << (width - 1 - k))) != 0
            flat = ~bit
            packed = np.packbits(bit, bitorder="little")
            padded = np.zeros(-(-len(packed) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
            padded[: len(packed)] = packed
            counts = np.bitwise_count(padded.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1, dtype=np.uint32)
            low = np.compress(flat, now)
            now = np.concatenate([low, np.compress(bit, now)])
            zeros.append(len(low))
            planes.append(packed)
            ones.append(np.concatenate([[0], np.cumsum(counts)]).astype(np.uint32))
        return cls(len(values), zeros, planes, ones)

    def _ones_before(self, plane: int, at: int) -> int:
        block = at // BLOCK
        start = block * BLOCK // 8
        bits = self.planes[plane][start : -(-at // 8)]
        inside = int(np.bitwise_count(bits).sum())
        if at % 8 and len(bits):
            inside -= (int(bits[-1]) >> at % 8).bit_count()
        return int(self.ones[plane][block]) + inside

    def _bit(self, plane: int, at: int) -> int:
        return int(self.planes[plane][at >> 3]) >> (at & 7) & 1

    def access(self, at: int) -> int:
        """The id at a place."""
        value = 0
        for k in range(self.width):
            bit = self._bit(k, at)
            value = value << 1 | bit
            before = self._ones_before(k, at)
            at = self.zeros[k] + before if bit else at - before
        return value

    def _path(self, value: int, low: int, high: int) -> tuple[int, int, list[int]]:
        lows = []
        for k in range(self.width):
            lows.append(low)
            a, b = self._ones_before(k, low), self._ones_before(k, high)
            if value >> (self.width - 1 - k) & 1:
                low, high = self.zeros[k] + a, self.zeros[k] + b
            else:
                low, high = low - a, high - b
        return low, high, lows

    def rank(self, value: int, at: int | None = None) -> int:
        """How often an id occurs before a place (in all, without one)."""
        low, high, _ = self._path(value, 0, self.n if at is None else at)
        return high - low

    def _select_bit(self, plane: int, bit: int, number: int) -> int:
        """Place of the numbered (from 0) one or zero of a plane."""
        before = self.ones[plane].astype(np.int64) if bit else np.minimum(np.arange(len(self.ones[plane])) * BLOCK, self.n) - self.ones[plane]
        block = int(np.searchsorted(before, number, "right")) - 1
        start = block * BLOCK // 8
        bits = np.unpackbits(self.planes[plane][start : start + BLOCK // 8], bitorder="little")[: self.n - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(bits == bit)[number - int(before[block])])

    def select(self, value: int, number: int) -> int:
        """Place of the numbered (from 0) occurrence of an id; -1 if there are not so many."""
        low, high, _ = self._path(value, 0, self.n)
        if number >= high - low:
            return -1
        at = low + number
        for k in range(self.width - 1, -1, -1):
            bit = value >> (self.width - 1 - k) & 1
            at = self._select_bit(k, bit, at - self.zeros[k] if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """All ids, by undoing the planes from the last one on."""
        now = np.zeros(self.n, np.uint16 if self.width <= 16 else np.uint32)
        for k in range(self.width - 1, -1, -1):
            bit = np.unpackbits(self.planes[k], count=self.n, bitorder="little").view(bool)
            out = np.empty_like(now)
            np.place(out, ~bit, now[: self.zeros[k]])
            if self.zeros[k] < self.n:
                np.place(out, bit, now[self.zeros[k] :] | now.dtype.type(1 << (self.width - 1 - k)))
            now = out
        return now


class WordTable:
    """Indexes of words by their 64-bit hash: direct tables over some bits, each taking what finds its slot used in the one before; a dict takes the rest."""

    SHAPES = ((0, 21), (24, 18), (44, 16))

    def __init__(self) -> None:
        self.hashes = np.zeros(1 << 16, np.uint64)
        self.count, self.rest = 0, {}
        self.tables = [np.full(1 << bits, -1, np.int32) for _, bits in self.SHAPES]

    def find(self, hashed: np.ndarray) -> np.ndarray:
        """Index of each word, -1 if it is not there."""
        out = np.full(len(hashed), -1, np.int32)
        for k, ((shift, bits), table) in enumerate(zip(self.SHAPES, self.tables, strict=True)):
            left = slice(None) if not k else np.flatnonzero(out < 0)
            words = hashed[left]
            at = table[((words >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)]
            out[left] = np.where((at >= 0) & (self.hashes[at] == words), at, -1)
        if self.rest:
            for i in np.flatnonzero(out < 0).tolist():
                out[i] = self.rest.get(int(hashed[i]), -1)
        return out

    def add(self, hashed: np.ndarray) -> None:
        """Words that are not there yet, each once; they get the next indexes in order."""
        first, self.count = self.count, self.count + len(hashed)
        while len(self.hashes) < self.count:
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        self.hashes[first : self.count] = hashed
        left = np.arange(first, self.count)
        for (shift, bits), table in zip(self.SHAPES, self.tables, strict=True):
            slot = ((self.hashes[left] >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)
            free = table[slot] < 0
            table[slot[free]] = left[free]
            left = left[table[slot] != left]
        self.rest.update(zip(self.hashes[left].tolist(), left.tolist(), strict=True))


class WordEncoder:
    """A lower-casing word BPE file through its library: texts are normalised and split here, for a slice of texts at a time; each new word goes through the library's model once."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]], [x["type"] for x in spec["pre_tokenizer"]["pretokenizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or split["behavior"] != "Removed" or not split["invert"] or split["pattern"]["Regex"] != PATTERN:
            raise ValueError("only files that normalise by NFC and lower case and split off matches of the usual pattern are read")
        self.library = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.width = max(max(spec["model"]["vocab"].values()), *(t["id"] for t in spec["added_tokens"])).bit_length()
        self.kind = np.dtype("<u2") if self.width <= 16 else np.dtype("<u4")
        shown = {b: c for c, b in byte_alphabet().items()}
        self.letters = [shown[b] for b in range(256)]
        self.classes = character_classes()
        self.reset()

    def reset(self) -> None:
        self.table, self.ids, self.sizes = WordTable(), np.zeros(1 << 18, self.kind), np.zeros(1 << 16, np.int64)
        self.starts, self.used = np.zeros(1 << 16, np.int64), 0

    def _learn(self, words: list[str], hashed: np.ndarray) -> None:
        tokenize, letters, first = self.library.model.tokenize, self.letters, self.table.count
        found = [[t.id for t in tokenize("".join([letters[b] for b in w.encode("utf-8", "surrogatepass")]))] for w in words]
        self.table.add(hashed)
        sizes = np.array([len(f) for f in found], np.int64)
        flat = np.array([i for f in found for i in f], self.kind)
        while len(self.ids) < self.used + len(flat):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.sizes) < self.table.count:
            self.sizes, self.starts = np.concatenate([self.sizes, np.zeros_like(self.sizes)]), np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.sizes[first : self.table.count] = sizes
        self.starts[first : self.table.count] = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)

    def _words(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(joined texts, starts, ends and hashes of the words, border of each text's words)."""
        joined = "\0" + "\0".join(texts) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        kinds = self.classes[codes]
        borders = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        kinds[borders] = BORDER
        solid = (kinds == LETTER) | (kinds == NUMBER) | (kinds == OTHER)
        start = solid.copy()
        start[1:] &= (kinds[1:] != kinds[:-1]) | (kinds[1:] == NUMBER)
        marks = np.flatnonzero((codes == ord("'")) & start)
        if len(marks):
            padded = np.append(codes, np.zeros(3, codes.dtype))
            for tail in CONTRACTIONS:
                hit = marks
                for k, letter in enumerate(tail):
                    hit = hit[padded[hit + 1 + k] == ord(letter)]
                start[hit + 1] = False
                after = hit + 1 + len(tail)
                start[after[kinds[after] == LETTER]] = True
        cuts = np.flatnonzero(start | ~solid)
        opening = np.flatnonzero(start[cuts])
        starts, ends = cuts[opening], cuts[opening + 1]
        power, inverse = _words._powers(len(codes))
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(0x1F123BB5)) * np.uint64(0xD6E8FEB86659FD93) * power, out=sums[1:])
        hashed = _words.mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return joined, starts, ends, hashed, np.searchsorted(starts, borders)

    def _slice(self, texts: list[str]) -> list[np.ndarray]:
        joined, starts, ends, hashed, border = self._words(texts)
        if self.table.count > MEMO_ENTRIES:
            self.reset()
        at = self.table.find(hashed)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            fresh, where = np.unique(hashed[missing], return_index=True)
            self._learn([joined[a:b] for a, b in zip(starts[missing[where]].tolist(), ends[missing[where]].tolist(), strict=True)], fresh)
            at[missing] = self.table.find(hashed[missing])
        sizes = self.sizes[at]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(self.starts[at] - total[:-1], sizes) + np.arange(int(total[-1]))]
        cuts = total[border]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list[np.ndarray] = [np.zeros(0, self.kind)] * len(texts)
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        group, owner, size = [], [], 0

        def work() -> None:
            for i, ids in zip(owner, self._slice(group), strict=True):
                parts[i].append(ids)

        for i, text in enumerate(texts):
            if not text:
                continue
            if any(s in text for s in self.special) or "Σ" in text or "İ" in text:  # lower case depends on what is around
                parts[i].append(np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind))
                continue
            text, at = unicodedata.normalize("NFC", text).lower(), 0
            while at < len(text):
                end = at + TOGETHER
                while end < len(text) and not text[end].isspace():  # a long text is cut where no word is
                    end += 1
                group.append(text[at:end])
                owner.append(i)
                size += len(group[-1])
                at = end
                if size >= TOGETHER:
                    work()
                    group, owner, size = [], [], 0
        if group:
            work()
        for i, found in enumerate(parts):
            if found:
                out[i] = found[0] if len(found) == 1 else np.concatenate(found)
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _columns(width: int) -> list[tuple[str, str]]:
    fixed = [("shard", "long"), ("n", "long"), ("width", "int"), ("docs", "binary"), ("sizes", "binary"), ("known", "binary"), ("zeros", "binary")]
    return fixed + [(f"{name}_{k}", "binary") for k in range(width) for name in ("plane", "ones")]


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode every whole text, append ``end_id`` to each, and write the shards under ``path``."""
    width = encoder(tokenizer_path).width
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    # as many ranges as shuffles have partitions: each is cut into as many shards as its bytes need
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # rows with one id may be many: the head of the text, in whose order they stand, parts them
    keys = [F.col("id").asc_nulls_first(), F.substring("text", 1, 32)]
    rows = rows.repartitionByRange(ranges, *keys).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    names = _columns(width)
    schema = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[t]) for n, t in names])

    def build(shard: int, ids: list, texts: list) -> pa.RecordBatch:
        encode = encoder(tokenizer_path)
        end = np.array([end_id], encode.kind)
        parts = [x for ids_of in encode(texts) for x in (ids_of, end)]
        counts = [len(p) + 1 for p in parts[::2]]
        matrix = WaveletMatrix.build(np.concatenate(parts), width)
        row = {
            "shard": shard, "n": matrix.n, "width": width, "docs": np.array([i or 0 for i in ids], "<i8").tobytes(),
            "sizes": np.array(counts, "<i8").tobytes(), "known": bytes(i is not None for i in ids), "zeros": np.array(matrix.zeros, "<i8").tobytes(),
        }
        for k in range(width):
            row[f"plane_{k}"], row[f"ones_{k}"] = matrix.planes[k].tobytes(), matrix.ones[k].astype("<u4").tobytes()
        return pa.RecordBatch.from_pylist([row], schema=schema)

    def run(batches):
        first, ids, texts, size, made = TaskContext.get().partitionId() << 32, [], [], 0, 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(text)
                size += len(text)
                if size >= SHARD_BYTES:
                    yield build(first + made, ids, texts)
                    ids, texts, size, made = [], [], 0, made + 1
                    give_back()
        if ids:
            yield build(first + made, ids, texts)
        give_back()

    short_batches(docs.sparkSession)
    made = rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in names))
    made.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return path


def load(row: dict) -> WaveletMatrix:
    """The matrix of a shard's row."""
    width = row["width"]
    planes = [np.frombuffer(row[f"plane_{k}"], np.uint8) for k in range(width)]
    return WaveletMatrix(row["n"], np.frombuffer(row["zeros"], "<i8").tolist(), planes, [np.frombuffer(row[f"ones_{k}"], "<u4") for k in range(width)])


def read(spark: SparkSession, path: str, width: int, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32[, ids]) of each document in the files, ``start`` counting the ids before it over all shards."""
    schema = ", ".join(f"{n} {t}" for n, t in _columns(width) if n != "shard") + ", shard long"
    shards = spark.read.schema(schema).parquet(path)
    ddl = "shard long, id long, at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    arrow = pa.schema([("shard", pa.int64()), ("id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                matrix = load(row)
                values = matrix.decode().astype("<u4")
                ends = np.cumsum(np.frombuffer(row["sizes"], "<i8"))
                last = int(values[-1])  # the end id: found again by rank and select, at the place where the last document ends
                if matrix.select(last, matrix.rank(last) - 1) != ends[-1] - 1 or matrix.access(int(ends[0]) - 1) != last:
                    raise ValueError(f"shard {row['shard']} is damaged")
                starts = ends - np.frombuffer(row["sizes"], "<i8")
                whole = memoryview(values.tobytes())
                cuts = list(zip(starts.tolist(), ends.tolist(), strict=True))
                docs = [d if k else None for d, k in zip(np.frombuffer(row["docs"], "<i8").tolist(), row["known"], strict=True)]
                columns = [[row["shard"]] * len(docs), docs, starts, ends - starts, [zlib.crc32(whole[4 * a : 4 * b]) for a, b in cuts]]
                if with_ids:
                    columns.append([values[a:b].astype(np.int64) for a, b in cuts])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    short_batches(spark)
    found = shards.mapInArrow(run, ddl)
    # ids before a shard: sums within blocks of shards, and of the blocks before
    sizes = shards.select("shard", "n", F.shiftright("shard", 40).alias("block"))
    blocks = sizes.groupBy("block").agg(F.sum("n").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("block", before(Window.orderBy("block")).alias("first"))
    starts = sizes.withColumn("inner", before(Window.partitionBy("block").orderBy("shard"))).join(blocks, "block").select("shard", (F.col("first") + F.col("inner")).alias("first"))
    found = found.join(starts, "shard")
    return found.select(F.col("id").alias(id_col), (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def roundtrip(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files to the shared folder and read them back."""
    path = write(docs, scratch_path(docs.sparkSession, "token-files"), tokenizer_path, end_id, id_col, text_col)
    return read(docs.sparkSession, path, encoder(tokenizer_path).width, id_col)
