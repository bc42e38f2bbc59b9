"""Words of texts and their 64-bit hashes, vectorised over a slice of texts."""

from __future__ import annotations

import numpy as np

#: Bytes hashed at a time; a longer word is a block of its own.
BLOCK = 1 << 20

_RANDOM = np.random.default_rng(8675309)
_VALUE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Space, tab, newline, vertical tab, form feed, carriage return.
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
#: Every ASCII sign but letters and digits.
SIGNS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: A to Z to a to z; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            step = np.full(size, base)
            step[0] = 1
            _POWERS[k] = np.cumprod(step)
    return _POWERS[0][:n], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(raw: np.ndarray, apart: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes that do not keep words apart)."""
    solid = np.zeros(len(raw) + 2, np.int8)
    solid[1:-1] = ~apart[raw]
    step = np.diff(solid)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the same wherever it stands."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + BLOCK, "right")))
        low, high = int(starts[first]), int(ends[last - 1])
        power, inverse = _powers(high - low)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_VALUE[raw[low:high]] * power, out=sums[1:])
        a, b = starts[first:last] - low, ends[first:last] - low
        out[first:last] = mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        first = last
    return out


def words_of(texts: list[bytes], lower: bool = True, apart: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(raw bytes, starts, ends, hashes, border): ``border[i]:border[i + 1]`` are the words of text i."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    if lower:
        raw = LOWER[raw]
    starts, ends = spans(raw, apart)
    edges = np.concatenate([[0], np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))])
    return raw, starts, ends, hashes(raw, starts, ends), np.searchsorted(starts, edges)
