"""A batch of texts as one byte buffer, with hashes of its words and windows.

All hashes are polynomial in random byte values modulo 2**64, so the hash of any
stretch is the difference of two prefix sums: every window of a batch is hashed
by a handful of array operations instead of a loop over texts.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: Odd, so that it has an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Characters of a batch where six tasks share an executor with a heap of much of its memory.
MOST_CHARS = 900_000
#: Buffers above this are cut by the callers' batches; powers are kept for one buffer.
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, so that their order and low bits look random."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _UNBASE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


class Prefix:
    """Hashes of stretches of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        up, self._down = _powers(len(values) + 1)
        self._sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:-1], out=self._sums[1:])

    def stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of ``values[start:end]``, equal for equal stretches; lengths count too."""
        h = (self._sums[end] - self._sums[start]) * self._down[start]
        return mix(h + (end - start).astype(np.uint64) * U64(0xD6E8FEB86659FD93))

    def windows(self, width: int, starts: np.ndarray | None = None) -> np.ndarray:
        """Hash of each ``values[i:i+width]``, or of those at ``starts``."""
        n = len(self._sums) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        if starts is not None:
            return mix((self._sums[starts + width] - self._sums[starts]) * self._down[starts])
        return mix((self._sums[width:] - self._sums[:n]) * self._down[:n])


class TextBlock:
    """Texts as bytes end to end: ``data``, and ``offsets`` of each text in it."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.raw = raw
        self.offsets = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(t) for t in raw], out=self.offsets[1:])
        self.data = np.frombuffer(b"".join(raw), np.uint8)

    def bytes_prefix(self) -> Prefix:
        return Prefix(_VALUES[self.data])

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each lower-cased word, index of the first word of each text, plus the end)."""
        data = _LOWER[self.data]
        inside = ~_SPACE[data]
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        first = np.zeros(len(data) + 1, bool)
        first[self.offsets] = True
        starts = np.flatnonzero(inside & (~before | first[:-1]))
        after = np.ones(len(data), bool)
        after[:-1] = ~inside[1:] | first[1:-1]
        ends = np.flatnonzero(inside & after) + 1
        hashes = Prefix(_VALUES[data]).stretch(starts, ends)
        return hashes, np.searchsorted(starts, self.offsets)


def batches(frames, column: str, most: int = 1_900_000):
    """Parts of pandas frames whose texts hold about ``most`` characters, one text at least."""
    for frame in frames:
        sizes = frame[column].str.len().fillna(0).to_numpy(np.int64)
        if not len(sizes):
            continue
        group = (np.cumsum(sizes) - sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(sizes)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield frame.iloc[a:b]


def slices(parts, column: str, most: int = MOST_CHARS):
    """Parts of Arrow batches whose texts hold about ``most`` bytes, one text at least, without a copy of a batch.

    A batch has up to 10,000 texts; made into Python objects at once, they would take its size again.
    """
    import pyarrow.compute as pc

    for part in parts:
        sizes = pc.fill_null(pc.binary_length(part.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(sizes):
            continue
        group = (np.cumsum(sizes) - sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield part.slice(a, b - a)
        del part
