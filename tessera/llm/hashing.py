"""Substring hashes in numpy, and Arrow batches cut to a size in bytes."""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc

#: Bytes of text that a Python worker looks at in one step.
STEP_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_tables: list = []


def _powers(n: int):
    """A random odd number for each byte value, and the powers of the base and of its inverse, modulo 2^64."""
    if not _tables or len(_tables[1]) < n:
        size = max(n, STEP_BYTES + (1 << 16))
        inverse = pow(_BASE, -1, 1 << 64)
        steps = lambda x: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, x, np.uint64)]))
        values = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        _tables[:] = [values, steps(_BASE), steps(inverse)]
    return tuple(_tables)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX[0]
    h = (h ^ (h >> np.uint64(29))) * _MIX[1]
    return h ^ (h >> np.uint64(32))


class Hashes:
    """Hashes of any substrings of some bytes; `fold` may map byte values to others first."""

    def __init__(self, data: np.ndarray, fold: np.ndarray | None = None):
        values, powers, self.inverse = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((values if fold is None else values[fold])[data] * powers[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:n]) * self.inverse[:n])


def by_bytes(batches, column: str = "text", limit: int = STEP_BYTES):
    """The batches cut into slices of about `limit` bytes of a binary column (one row at least)."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        step = np.cumsum(sizes.astype(np.int64)) // limit
        cuts = np.flatnonzero(np.diff(step)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
            if hi > lo:
                yield batch.slice(int(lo), int(hi - lo))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _hashed_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    blank = np.concatenate([[True], _BLANK[data], [True]])
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = edge[::2], edge[1::2]
    return start, mixed(Hashes(data, _FOLD).of(start, end) + (end - start).astype(np.uint64))


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """For each text, the 64-bit hashes of its words with A-Z in lower case."""
    if sum(map(len, texts)) <= 2 * STEP_BYTES:
        start, h = _hashed_words(np.frombuffer(b"\n".join(texts), np.uint8))
        ends = np.cumsum([len(t) + 1 for t in texts])
        return np.split(h, np.searchsorted(start, ends[:-1])) if texts else []
    out = []
    for text in texts:  # a long text goes in parts that end at a blank
        parts, at = [np.zeros(0, np.uint64)], 0
        data = np.frombuffer(text, np.uint8)
        while at < len(data):
            end = at + STEP_BYTES
            while end < len(data) and not (found := np.flatnonzero(_BLANK[data[end : end + STEP_BYTES]])[:1]).size:
                end += STEP_BYTES
            end = end + int(found[0]) if end < len(data) else len(data)
            parts.append(_hashed_words(data[at:end])[1])
            at = end
        out.append(np.concatenate(parts))
    return out
