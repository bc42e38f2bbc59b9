"""Token counts by a tokenizer compiled to finite-state transducers, over chunk maps and a parallel prefix scan.

Two deterministic transducers stand for a byte-level BPE tokenizer file. The first reads symbols (the class of a
character, whether a character that is not white follows, the length of a contraction that an apostrophe may start) and
marks where a match of the split pattern starts; it has eight states. The second reads the bytes of a match, from
state 0 at each mark. Its state is the longest suffix read that may still grow into a token, with the last token and
the relative token count at each position where such a token could start; a transition emits the change of the token
count. That state is all that later transitions depend on, so the automaton is finite; states are compiled when first
reached and the table is emptied beyond ``MAX_STATES``.

Every text is cut into chunks of ``CHUNK`` characters, whatever its length; the cuts fall anywhere, inside matches too.

1. The first transducer's map of a chunk is a table from each of the eight entry states to the exit state. All chunks
   are stepped together; the tables compose, and a scan by doubling gives the entry state of each chunk, hence its marks.
2. The second transducer's map of a chunk is constant from the chunk's first mark on: the tokens emitted from there and
   the exit state. Before that mark it is a map from entry state to exit state and emitted tokens, tabulated for the
   entry states that occur. These maps compose associatively; a scan by pairs gives the entry state of each chunk.
3. With its entry state known, the bytes before a chunk's first mark emit their tokens; all parts add up for each text.

Counts of parts that start at a mark are remembered, at most ``MEMO_ENTRIES`` in a Python worker. Texts are worked on in
blocks of ``BLOCK`` characters, each of which takes over the states that the one before ends in, so memory is bounded
for any length.

Edge cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows give repeated results; an empty table
gives an empty result; a null id is kept; columns other than the id and the text are ignored. Special strings of the
file that occur in a text count as one token each, as is the library's default.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from engramite.llm._batches import id_type, map_texts

CHUNK, BLOCK, MAX_STATES, MEMO_ENTRIES = 1024, 1 << 19, 500_000, 800_000

#: Code points that are white space, and the letters that may follow an apostrophe as a match.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]

#: Classes of characters; BORDER stands between texts.
BORDER, LETTER, NUMBER, SPACE, BLANK, OTHER = range(6)


def character_classes() -> np.ndarray:
    kinds = np.full(0x110000, OTHER, np.uint8)
    initial = np.frombuffer("".join(unicodedata.category(chr(i))[0] for i in range(0x110000)).encode(), np.uint8)
    kinds[initial == ord("L")], kinds[initial == ord("N")] = LETTER, NUMBER
    kinds[WHITE], kinds[32] = BLANK, SPACE
    return kinds


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where it is printable, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class MatchTransducer:
    """Counts the BPE tokens of a match, byte by byte. Tokens are numbered bytes first, then in the order of merges."""

    def __init__(self, merges: list[tuple[bytes, bytes]]) -> None:
        self.number = {bytes([b]): b for b in range(256)}
        self.made: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for left, right in merges:
            pair = self.number[left], self.number[right]
            new = self.number.setdefault(left + right, 256 + len(self.made))
            self.made[pair] = new
            self.parts.setdefault(new, pair)
        self.growing = {token[:k] for token in self.number for k in range(len(token))}
        self.reset()

    def reset(self) -> None:
        """State 0: nothing read, so only a token that starts here is possible."""
        self.states: list[tuple[bytes, tuple[tuple[int, int], ...]]] = [(b"", ((-1, 0),))]
        self.index = {self.states[0]: 0}
        self.steps: dict[int, tuple[int, int]] = {}
        self.allowed: dict[tuple[int, int], bool] = {}

    def adjacent(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two tokens side by side: undo the merges at the border, latest first, and look for a merge across it that would have come before."""
        before = 1 << 60
        while True:
            if self.made.get((left, right), before) < before:
                return False
            if left > right and left in self.parts or right not in self.parts:
                if left not in self.parts:
                    return True
                before, left = left, self.parts[left][1]
            else:
                before, right = right + 1, self.parts[right][0]

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """Compile the transition: the next state and the change of the token count."""
        suffix, ends = self.states[state]
        read = suffix + bytes([byte])
        for back in range(len(ends)):
            token = self.number.get(read[len(read) - back - 1 :])
            if token is None:
                continue
            last, count = ends[back]
            if last >= 0:
                pair = last, token
                if pair not in self.allowed:
                    self.allowed[pair] = self.adjacent(last, token)
                if not self.allowed[pair]:
                    continue
            break
        else:
            raise ValueError("a byte has no token")
        emitted = count + 1
        while read not in self.growing:
            read = read[1:]
        ends = ((token, 0), *((t, c - emitted) for t, c in ends[: len(read)]))
        key = read, ends
        if key not in self.index:
            self.index[key] = len(self.states)
            self.states.append(key)
        self.steps[state << 8 | byte] = found = self.index[key], emitted
        return found

    def run(self, state: int, data: bytes) -> tuple[int, int]:
        """Exit state and emitted tokens from an entry state over some bytes."""
        total, steps = 0, self.steps
        for byte in data:
            found = steps.get(state << 8 | byte)
            if found is None:
                found = self.step(state, byte)
            state = found[0]
            total += found[1]
        return state, total

    def keep_small(self, state: int) -> int:
        """Empty the table if it has grown beyond its bound; the number that the state has from then on."""
        if len(self.states) <= MAX_STATES:
            return state
        key = self.states[state]
        self.reset()
        if key not in self.index:
            self.index[key] = len(self.states)
            self.states.append(key)
        return self.index[key]


#: States of the transducer of the split pattern: a match may start with anything; in letters, numbers, others; after a blank (32), after other white space; one or two letters of a contraction to come.
FRESH, LETTERS, NUMBERS, OTHERS, AFTER_BLANK, AFTER_WHITE, ONE_MORE, TWO_MORE = range(8)
STATES, MARK = 8, 8


def symbols(codes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Twice the class, and one more if a character that is not white follows; 12 or 13 for an apostrophe before the rest of a contraction of two or three characters. The last two characters only look ahead."""
    solid = (kinds == LETTER) | (kinds == NUMBER) | (kinds == OTHER)
    out = kinds[:-2] * 2 + solid[1:-1]
    marks = np.flatnonzero((codes[:-2] == ord("'")) & (kinds[:-2] != BORDER))
    for tail in CONTRACTIONS:
        hit = marks
        for k, letter in enumerate(tail):
            hit = hit[(codes[hit + 1 + k] == ord(letter)) & (kinds[hit + 1 + k] == LETTER)]
        out[hit] = 11 + len(tail)
    return out


def split_table() -> np.ndarray:
    """For state * 16 + symbol: the next state, plus MARK if a match starts."""
    inside = {LETTER: LETTERS, NUMBER: NUMBERS, OTHER: OTHERS}
    table = np.zeros(STATES * 16, np.uint8)
    for state in range(STATES):
        for symbol in range(14):
            kind, ahead = (OTHER, True) if symbol > 11 else divmod(symbol, 2)
            if kind == BORDER:
                new, start = FRESH, False
            elif state in (ONE_MORE, TWO_MORE):
                new, start = (FRESH, False) if state == ONE_MORE else (ONE_MORE, False)
            elif kind in (SPACE, BLANK):
                new, start = AFTER_BLANK if kind == SPACE else AFTER_WHITE, bool(ahead) or state not in (AFTER_BLANK, AFTER_WHITE)
            else:
                new, start = inside[kind], state not in (inside[kind], AFTER_BLANK)
                if start and symbol > 11:
                    new = ONE_MORE if symbol == 12 else TWO_MORE
            table[state * 16 + symbol] = new + MARK * start
    return table


class SplitTransducer:
    def __init__(self) -> None:
        self.table = split_table()
        self.next = self.table & 7

    def chunk_maps(self, columns: np.ndarray) -> np.ndarray:
        """The exit state of each chunk for each entry state; ``columns`` holds the symbols by place in the chunk and chunk."""
        states = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], columns.shape[1], axis=1)
        for symbol in columns:
            states = self.next[states << 4 | symbol]
        return states.T.copy()

    @staticmethod
    def prefix_scan(maps: np.ndarray) -> np.ndarray:
        """The composition of each map with all before it, by doubling."""
        span = 1
        while span < len(maps):
            maps = np.concatenate([maps[:span], np.take_along_axis(maps[span:], maps[:-span], axis=1)])
            span *= 2
        return maps

    def marks(self, symbol: np.ndarray, state: int) -> tuple[np.ndarray, int]:
        """Where matches start, and the exit state."""
        chunks = -(-len(symbol) // CHUNK)
        columns = np.zeros(chunks * CHUNK, np.uint8)
        columns[: len(symbol)] = symbol
        columns = np.ascontiguousarray(columns.reshape(chunks, CHUNK).T)
        after = self.prefix_scan(self.chunk_maps(columns).astype(np.intp))[:, state]
        now = np.concatenate([[state], after[:-1]]).astype(np.uint8)
        out = np.empty_like(columns)
        for k, row in enumerate(columns):
            found = self.table[now << 4 | row]
            out[k], now = found >> 3, found & 7
            if (chunks - 1) * CHUNK + k == len(symbol) - 1:
                state = int(now[-1])
        return out.T.ravel()[: len(symbol)].astype(bool), state


class StateMap:
    """A map from entry state to exit state and emitted tokens, tabulated for the entry states that occur."""

    __slots__ = ("known", "work")

    def __init__(self, work: Callable[[int], tuple[int, int]]) -> None:
        self.work, self.known = work, {}

    def __call__(self, state: int) -> tuple[int, int]:
        found = self.known.get(state)
        if found is None:
            found = self.known[state] = self.work(state)
        return found

    def then(self, other: StateMap) -> StateMap:
        def work(state: int) -> tuple[int, int]:
            middle, first = self(state)
            last, second = other(middle)
            return last, first + second

        return StateMap(work)


@dataclass(frozen=True, slots=True)
class ChunkMap:
    """The match transducer's map of a chunk: ``head`` up to the first mark (None where the chunk starts with one), then a constant: ``tokens`` emitted and the exit state ``tail`` (None where there is no mark)."""

    head: StateMap | None
    tokens: int
    tail: int | None

    def __call__(self, state: int) -> tuple[int, int]:
        out, tokens = self.head(state) if self.head else (state, 0)
        return (out if self.tail is None else self.tail), tokens + self.tokens

    def then(self, other: ChunkMap) -> ChunkMap:
        """Both maps one after the other; associative."""
        if self.tail is None:
            head = self.head.then(other.head) if self.head and other.head else self.head or other.head
            return ChunkMap(head, self.tokens + other.tokens, other.tail)
        out, tokens = other(self.tail)
        return ChunkMap(self.head, self.tokens + tokens, out)


def prefix_scan(maps: list[ChunkMap]) -> list[ChunkMap]:
    """Inclusive scan by pairs: the number of compositions is linear, their depth logarithmic."""
    if len(maps) < 2:
        return maps
    pairs = prefix_scan([maps[i].then(maps[i + 1]) for i in range(0, len(maps) - 1, 2)])
    out = [maps[0]]
    for i in range(1, len(maps)):
        out.append(pairs[i // 2] if i % 2 else pairs[i // 2 - 1].then(maps[i]))
    return out


class TokenCounter:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only byte-level BPE files without prefix space or normalizer are compiled")
        alphabet = byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.matches, self.split = MatchTransducer([(raw(a), raw(b)) for a, b in pairs]), SplitTransducer()
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", [])):
            raise ValueError("special strings that strip or need word borders are not compiled")
        self.kinds = character_classes()
        self.memo: dict[str, int] = {}

    def count_plain(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text, none of which has special strings."""
        joined = "\0" + "\0".join(texts) + "\0"
        borders = np.concatenate([[0], np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))])
        totals = np.zeros(len(texts) + 1, np.int64)
        split, match = FRESH, 0
        for at in range(0, len(joined), BLOCK):
            end = min(len(joined), at + BLOCK)
            within = borders[np.searchsorted(borders, at) : np.searchsorted(borders, end + 2)] - at
            split, match = self.block(joined[at : end + 2].ljust(end - at + 2, "\0"), within, split, match, at, borders, totals)
        return totals[:-1]

    def block(self, text: str, borders: np.ndarray, split: int, match: int, at: int, all_borders: np.ndarray, totals: np.ndarray) -> tuple[int, int]:
        """Add the tokens of a block, whose last two characters only look ahead, to its texts' totals; both exit states."""
        match = self.matches.keep_small(match)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        kinds = self.kinds[codes]
        kinds[borders] = BORDER
        n = len(text) - 2
        start, split = self.split.marks(symbols(codes, kinds), split)
        solid = kinds[:n] != BORDER
        cut = start | ~solid
        cut[::CHUNK] = True
        cuts = np.flatnonzero(cut)
        ends = np.append(cuts[1:], n)
        real = solid[cuts]
        cuts, ends = cuts[real], ends[real]
        if not len(cuts):
            return split, 0
        # parts that start at a mark are counted from state 0; the others stand for nothing until their entry state is known
        marked = start[cuts]
        pieces = [text[a:b] for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)]
        unmarked = {k: pieces[k] for k in np.flatnonzero(~marked).tolist()}
        for k in unmarked:
            pieces[k] = ""
        run, memo = self.matches.run, self.memo
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        found = list(map(memo.get, pieces))
        for k in [k for k, known in enumerate(found) if known is None]:
            piece = pieces[k]
            known = memo.get(piece)  # it may be the second one of the block
            found[k] = memo[piece] = run(0, piece.encode("utf-8", "surrogatepass"))[1] if known is None else known
        tokens = np.array(found, np.int64)
        # the map of each chunk that has parts: an unmarked part at its start is the head
        chunk = cuts // CHUNK
        first = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1]))
        last = np.append(first[1:], len(chunk)) - 1
        sums = np.add.reduceat(tokens, first).tolist()
        heads: dict[str, StateMap] = {}
        tails: dict[str, int] = {}
        maps = []
        open_end = np.append(~marked[1:], True) & (np.append(cuts[1:], n) == ends)
        for a, b, total, headed, opened in zip(first.tolist(), last.tolist(), sums, (~marked[first]).tolist(), open_end[last].tolist(), strict=True):
            head = tail = None
            if headed:
                piece = unmarked[a]
                head = heads.get(piece)
                if head is None:
                    raw = piece.encode("utf-8", "surrogatepass")
                    head = heads[piece] = StateMap(lambda state, raw=raw: run(state, raw))
            if b > a or not headed:
                # where the next part starts at a mark or a border, the exit state is never read
                tail = 0
                if opened:
                    piece = pieces[b]
                    tail = tails.get(piece)
                    if tail is None:
                        tail = tails[piece] = run(0, piece.encode("utf-8", "surrogatepass"))[0]
            maps.append(ChunkMap(head, total, tail))
        scanned = prefix_scan(maps)
        entry = [match, *(before(match)[0] for before in scanned[:-1])]
        for k in np.flatnonzero(~marked[first]).tolist():
            tokens[first[k]] = maps[k].head(entry[k])[1]
        owner = np.searchsorted(all_borders, cuts + at) - 1
        totals += np.bincount(owner, tokens, len(totals)).astype(np.int64)
        return split, scanned[-1](match)[0]

    def __call__(self, texts: list[str | None]) -> list[int]:
        totals, parts, owner = [0] * len(texts), [], []
        for row, text in enumerate(texts):
            segments = [text or ""]
            for special in self.special:
                cut = [s.split(special) for s in segments]
                totals[row] += sum(len(c) - 1 for c in cut)
                segments = [s for c in cut for s in c]
            for segment in segments:
                if segment:
                    parts.append(segment)
                    owner.append(row)
        if parts:
            for row, n in zip(owner, self.count_plain(parts).tolist(), strict=True):
                totals[row] += n
        return totals


_COUNTERS: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """The compiled tokenizer of a Python worker, kept from task to task."""
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) of every whole text."""

    def make():
        count = counter(tokenizer_path)

        def work(keys: list, texts: list) -> dict:
            tokens = count(texts)
            return {id_col: keys, "n_bytes": [len(t.encode("utf-8")) if t else 0 for t in texts], "n_tokens": tokens, "over_limit": [n > limit for n in tokens]}

        return work

    return map_texts(docs, make, f"`{id_col}` {id_type(docs, id_col)}, n_bytes long, n_tokens long, over_limit boolean", id_col, text_col)
