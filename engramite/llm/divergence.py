"""Source divergence audit: how the words of each source of a language differ from those of its other sources.

Method: byte-level tokenizer, CSR matrices, reduceat. The UTF-8 bytes of a batch of texts lie in one buffer, as Arrow
has them; a numpy lookup table tells letters (A to Z, a to z and every byte from 0x80 on) from the rest, and where the
table's answer changes a word begins or ends. xxhash groups the words, and each word is compared byte for byte with the
first of its group. Words of documents make a CSR matrix (documents by terms), which reduceat adds up to
(language, source, term) counts; Spark adds those up over batches. Terms of too few documents go, and what stays is
cut into blocks of terms; in a block, each source is a CSR row, and the divergence of a pair of sources is a reduceat
over the terms that either holds, all other terms giving one equal value. Pairs of languages of many sources are made
by pairs of blocks of sources, so no group grows with the corpus: it holds two blocks of sources and one of terms.

Edge cases: null texts, languages and sources are ''; a group without a term, or of a language without a kept term, has
its pairs with value 0; repeated rows and ids are documents of their own; a language with one source has no pair; an
empty table gives no row; words of any length and texts of any length are counted whole, long texts piece by piece;
bytes that are no UTF-8 are letters like any byte from 0x80; further columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from engramite.llm._batches import give_back, short_batches, slices, tidy
from engramite.session import scratch_path

#: Shares are in units of one in SCALE.
SCALE = 1_000_000_000
#: Bytes of a text that are cut into words at a time; the cut is made where a word ends.
PIECE = 4 << 20
#: Bytes of texts that are counted together; one longer text is by itself.
SLICE = 2 << 20
#: Counts, and bytes of terms, that a task keeps before it hands them on.
HELD, HELD_BYTES = 500_000, 64 << 20
#: Terms and sources of a block.
BLOCK_TERMS, BLOCK_SOURCES = 2048, 128

LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def find_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a buffer; ``offsets[i]:offsets[i + 1]`` is text i, and no word crosses texts."""
    if not len(raw):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    letter = LETTER[raw]
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1]
    last[:-1] &= ~letter[1:]
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    first[inner] |= letter[inner]
    last[inner - 1] |= letter[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _same(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, likes: np.ndarray) -> np.ndarray:
    """Whether each word equals, byte for byte, the word that begins at its place in ``likes`` and is as long; eight bytes at a time."""
    eights = np.ndarray(len(raw) + 1, "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,))  # the eight bytes from every place on
    equal, at, rest = np.ones(len(starts), bool), 0, np.arange(len(starts))
    while len(rest):
        differ = eights[starts[rest] + at] ^ eights[likes[rest] + at]
        unused = (8 * (8 - np.minimum(lengths[rest] - at, 8))).astype(np.uint64)
        equal[rest] &= (differ << unused) == 0
        at += 8
        rest = rest[(lengths[rest] > at) & equal[rest]]
    return equal


def number_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(number of each word's term, terms): words of one hash are one term once their bytes are found to be equal."""
    data, lengths = raw.tobytes(), ends - starts
    marks = np.fromiter(map(xxhash.xxh3_64_intdigest, map(data.__getitem__, map(slice, starts.tolist(), ends.tolist()))), np.uint64, len(starts))
    _, first, number = np.unique(marks, return_index=True, return_inverse=True)
    likes = first[number]
    sure = lengths == lengths[likes]
    sure[sure] = _same(raw, starts[sure], lengths[sure], starts[likes[sure]])
    terms = [data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
    further: dict[bytes, int] = {}
    for k in np.flatnonzero(~sure).tolist():  # another word of the same hash
        word = data[starts[k] : ends[k]]
        number[k] = further.setdefault(word, len(terms) + len(further))
    return number, terms + list(further)


def matrix(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(indptr, indices, data, terms): the CSR matrix of word counts, a row for each text."""
    starts, ends = find_words(raw, offsets)
    number, terms = number_words(raw, starts, ends)
    cells, data = np.unique((np.searchsorted(offsets, starts, "right") - 1) * max(1, len(terms)) + number, return_counts=True)
    row, indices = np.divmod(cells, max(1, len(terms)))
    return np.searchsorted(row, np.arange(len(offsets))), indices, data, terms


def _pieces(raw: np.ndarray) -> Iterator[np.ndarray]:
    """A text in pieces of about ``PIECE`` bytes that end where no word does; one word that is longer stays whole."""
    at = 0
    while len(raw) - at > PIECE:
        end = at + PIECE
        while end < len(raw):
            gap = np.flatnonzero(~LETTER[raw[end : end + PIECE]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(len(raw), end + PIECE)
        yield raw[at:end]
        at = end
    yield raw[at:]


class _Counts:
    """(language, source, term) to (occurrences, documents): numbered groups and terms, cells added up by sorting and reduceat, handed on when there are many."""

    def __init__(self) -> None:
        self.groups, self.terms, self.size, self.cells = {}, {}, 0, np.empty((3, 0), np.int64)
        self.fresh: list[np.ndarray] = []

    def add(self, group: np.ndarray | int, term: np.ndarray, terms: list[bytes], n: np.ndarray, docs: np.ndarray) -> None:
        """``term`` numbers ``terms``."""
        known, before = self.terms, len(self.terms)
        number = np.array([known.setdefault(t, len(known)) for t in terms], np.int64)
        if len(known) > before:
            self.size += sum(map(len, terms))
        self.fresh.append(np.array([(group << 32) + number[term], n, docs]))

    def merge(self) -> int:
        """Add up equal cells; how many there are."""
        cells = np.concatenate([self.cells, *self.fresh], axis=1)
        cells = cells[:, np.argsort(cells[0])]
        begin = np.flatnonzero(np.concatenate([[True], cells[0, 1:] != cells[0, :-1]])) if cells.shape[1] else np.empty(0, np.int64)
        self.cells = np.concatenate([cells[:1, begin], np.add.reduceat(cells[1:], begin, axis=1)]) if len(begin) else cells
        self.fresh = []
        return len(begin)

    def full(self) -> bool:
        return sum(f.shape[1] for f in self.fresh) >= HELD and self.merge() >= HELD or self.size >= HELD_BYTES

    def take(self) -> pa.RecordBatch:
        self.merge()
        group, term = pa.array(self.cells[0] >> 32), pa.array(self.cells[0] & 0xFFFFFFFF)
        langs, sources = (pa.array([g[k] for g in self.groups], pa.string()).take(group) for k in range(2))
        out = [langs, sources, pa.array(list(self.terms), pa.binary()).take(term), pa.array(self.cells[1]), pa.array(self.cells[2])]
        self.__init__()
        return pa.RecordBatch.from_arrays(out, names=["lang", "source", "term", "n", "docs"])

    def batch(self, langs: list, sources: list, raw: np.ndarray, offsets: np.ndarray) -> None:
        """Count the texts of a slice."""
        groups = [self.groups.setdefault(g, len(self.groups)) for g in zip(langs, sources)]
        if len(langs) == 1 and len(raw) > PIECE:
            whole: dict[bytes, int] = {}
            for piece in _pieces(raw):
                _, indices, data, terms = matrix(piece, np.array([0, len(piece)]))
                for k, n in zip(indices.tolist(), data.tolist()):
                    whole[terms[k]] = whole.get(terms[k], 0) + n
            one = np.ones(len(whole), np.int64)
            self.add(groups[0], np.arange(len(whole)), list(whole), np.array(list(whole.values()), np.int64), one)
            return
        indptr, indices, data, terms = matrix(raw, offsets)
        if len(indices):
            place = np.repeat(np.array(groups), np.diff(indptr)) * len(terms) + indices
            order = np.argsort(place)
            place = place[order]
            begin = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            group, term = np.divmod(place[begin], len(terms))
            self.add(group, term, terms, np.add.reduceat(data[order], begin), np.diff(np.append(begin, len(place))))


def count_terms(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term; one row with a null term for every group, with a term or not."""
    short_batches(docs.sparkSession)
    empty = F.lit("")
    frame = docs.select(F.coalesce(F.col(text_col).cast("string"), empty).cast("binary").alias("text"), *[F.coalesce(F.col(c).cast("string"), empty).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                texts = part.column(0)
                offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
                data = texts.buffers()[2]
                raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
                counts.batch(part.column(1).to_pylist(), part.column(2).to_pylist(), LOWER[raw], offsets - offsets[0])
                if counts.full():
                    yield counts.take()
            del batch
            give_back()
        yield counts.take()

    found = frame.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    sums = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).withColumn("term", F.col("term").cast("string"))
    none = F.lit(0).cast("long")
    return sums.unionByName(frame.select("lang", "source", F.lit(None).cast("string").alias("term"), none.alias("n"), none.alias("docs")).distinct())


def _per(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * count / total), in three steps of a thousand, so that no product leaves 64 bits."""
    done, rest = F.lit(0).cast("long"), count
    for _ in range(3):
        rest = rest * 1000
        done, rest = done * 1000 + _div(rest, total), rest % total
    return done + 1


def _div(a: Column, b: Column) -> Column:
    """Whole quotient of longs that are not negative."""
    return F.call_function("div", a, b)


def _shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """As ``_per``, in numpy."""
    done, rest = np.zeros(np.broadcast_shapes(counts.shape, totals.shape), np.int64), counts
    for _ in range(3):
        rest = rest * 1000
        done, rest = done * 1000 + rest // totals, rest % totals
    return done + 1


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _block_sums(left: pa.Table, right: pa.Table) -> pa.Table:
    """Divergence of the pairs of two blocks of sources over the terms of one block.

    ``left``: (lang, rows, cols, part, source, term, n); ``right``: the sources of the two blocks with their totals and
    the number of terms of the language's block.
    """
    sources, row = np.unique(np.array(right["source"].to_pylist(), object), return_index=True)
    totals, blocks = right["total"].to_numpy()[row], right["of"].to_numpy()[row]
    key = [right[c][0].as_py() for c in ("lang", "rows", "cols", "part")]
    number = {s: k for k, s in enumerate(sources.tolist())}
    terms, column = np.unique(np.array(left["term"].to_pylist(), object), return_inverse=True) if left.num_rows else (np.empty(0, object), np.empty(0, np.int64))
    of_row = np.array([number[s] for s in left["source"].to_pylist()], np.int64)
    n = left["n"].to_numpy()
    order = np.lexsort((column, of_row))
    of_row, column, n = of_row[order], column[order], n[order]
    indptr = np.searchsorted(of_row, np.arange(len(sources) + 1))
    base = _shares(np.full(len(sources), 2), totals)
    share = _shares(n + 2, totals[of_row]) if len(n) else np.empty(0, np.int64)

    first, second, value = [], [], []
    dense = np.zeros(len(terms), np.int64)
    for i in range(len(sources)):
        later = np.arange(i + 1, len(sources)) if key[1] == key[2] else (np.flatnonzero(blocks == key[2]) if blocks[i] == key[1] else np.empty(0, np.int64))
        if not len(later):
            continue
        own = slice(indptr[i], indptr[i + 1])
        dense[:] = base[i]
        dense[column[own]] = share[own]
        # what it is where the other source lacks the term, at each of this source's terms; the other's terms are then set right
        alone = _apart(share[own][None, :], base[later][:, None]).sum(axis=1)
        nothing = _apart(base[i], base[later])
        total = alone + nothing * (len(terms) - (indptr[i + 1] - indptr[i]))
        picked = np.concatenate([np.arange(indptr[j], indptr[j + 1]) for j in later])
        sizes = indptr[later + 1] - indptr[later]
        if len(picked):
            at = dense[column[picked]]
            change = _apart(at, share[picked]) - _apart(at, np.repeat(base[later], sizes))
            filled = np.flatnonzero(sizes)
            total[filled] += np.add.reduceat(change, (np.cumsum(sizes) - sizes)[filled])
        first += [sources[i]] * len(later)
        second += sources[later].tolist()
        value += total.tolist()
    return pa.table({"lang": pa.array([key[0]] * len(first), pa.string()), "source": pa.array(first, pa.string()), "item": pa.array(second, pa.string()), "value": pa.array(value, pa.int64())})


def audit(counts: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank) from ``count_terms``: pairs of sources and each source's own terms.

    The counts are written once to the shared folder.
    """
    spark, path = counts.sparkSession, scratch_path(counts.sparkSession, "divergence")
    counts.write.parquet(f"{path}/counts")
    counts = spark.read.parquet(f"{path}/counts")
    terms = counts.where("term is not null")
    kept = terms.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("everywhere")).where(F.col("docs") >= least_docs).drop("docs")
    terms.select("lang", "source", "term", "n").join(kept, ["lang", "term"]).write.parquet(f"{path}/cells")
    cells = spark.read.parquet(f"{path}/cells")

    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("everywhere").alias("all"))
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("sum"))
    zero = F.lit(0).cast("long")
    sources = counts.where("term is null").select("lang", "source").join(sums, ["lang", "source"], "left").join(sizes, "lang", "left")
    v = F.coalesce("v", zero)
    sources.select("lang", "source", v.alias("v"), (F.coalesce("sum", zero) + 2 * v).alias("total"), (F.coalesce("all", zero) + 2 * v).alias("all")).write.parquet(f"{path}/sources")
    sources = spark.read.parquet(f"{path}/sources")
    return own_terms(cells, sources, top).unionByName(source_pairs(cells, sources))


def own_terms(cells: DataFrame, sources: DataFrame, top: int = 10) -> DataFrame:
    """The terms that a source has more of than its language, by divergence, ranks to ``top``."""
    p, q = _per(F.col("n") + 2, F.col("total")), _per(F.col("everywhere") + 2, F.col("all"))
    rows = cells.join(sources, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    value = _div((F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("p") + F.col("q"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = rows.select("lang", "source", F.lit("term").alias("part"), "item", value.alias("value")).withColumn("rank", F.row_number().over(by))
    return ranked.where(F.col("rank") <= top)


def source_pairs(cells: DataFrame, sources: DataFrame) -> DataFrame:
    """The divergence of every source from every other of its language, ranked."""
    blocks = sources.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK_SOURCES).cast("int").alias("blocks"))
    numbered = sources.join(blocks, "lang").withColumn("of", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    numbered = numbered.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("v") / BLOCK_TERMS)).cast("int"))
    # every pair of blocks that a source's block is in
    with_blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    there = numbered.withColumn("other", with_blocks).withColumn("rows", F.least("of", "other")).withColumn("cols", F.greatest("of", "other"))
    keys = ["lang", "rows", "cols", "part"]
    right = there.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*[F.col(k).alias(k) for k in keys], "source", F.greatest("total", F.lit(1)).alias("total"), "of")
    part = F.pmod(F.xxhash64("term"), F.col("parts")).cast("int").alias("part")
    left = cells.join(there.select("lang", "source", "rows", "cols", "parts"), ["lang", "source"]).select("lang", "rows", "cols", part, "source", "term", "n")
    schema = "lang string, source string, item string, value long"
    halves = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(tidy(_block_sums), schema).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rows = halves.select("lang", "value", both.alias("x")).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    return rows.withColumn("rank", F.row_number().over(by))
