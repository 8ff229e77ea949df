"""NumPy helpers for tasks: texts of an Arrow batch as one byte array, their words, and hashes.

Everything works on blocks of a few megabytes of text (a longer text is a block of its own),
so a task's memory follows the block and not the partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that a task handles at once.
BLOCK = 2 << 20

_rng = np.random.default_rng(20_240_601)
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: Words longer than this are hashed one by one.
LONG_WORD = 48


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of an Arrow string column (null: empty), and their offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return flat_bytes(column.fill_null("").cast(pa.large_string()).cast(pa.large_binary()))


def flat_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values of an Arrow binary column (null: empty), and their offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null(b"").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches, text_col: str, size: int = BLOCK):
    """Record batches cut so that each holds about ``size`` bytes of text, one row at least."""
    for batch in batches:
        sizes = np.diff(text_bytes(batch.column(text_col))[1])
        row = 0
        ends = np.cumsum(sizes)
        while row < len(sizes):
            done = ends[row - 1] if row else 0
            to = max(row + 1, int(np.searchsorted(ends, done + size, "right")))
            yield batch.slice(row, to - row)
            row = to


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the first word of each text (with the total at the end)."""
    inside = IS_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1])))
    last = inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    sizes = ends - starts
    out = np.full(len(starts), 0x1234567, np.uint64)
    alive, k = np.flatnonzero(sizes <= LONG_WORD), 0
    while len(alive):
        x = (out[alive] ^ BYTE_VALUE[data[starts[alive] + k]]) * _M1
        out[alive] = x ^ (x >> np.uint64(29))
        k += 1
        alive = alive[sizes[alive] > k]
    for i in np.flatnonzero(sizes > LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return mixed(out)


def windows(values: np.ndarray, firsts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every ``k`` consecutive values of one text, and where each text's windows begin (with the total)."""
    n = len(values)
    counts = np.maximum(np.diff(firsts) - k + 1, 0)
    bounds = np.concatenate(([0], np.cumsum(counts)))
    if not bounds[-1]:
        return np.zeros(0, np.uint64), bounds
    acc = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        acc = (acc + values[i : n - k + 1 + i]) * _M1
        acc ^= acc >> np.uint64(32)
    keep = np.repeat(firsts[:-1] - bounds[:-1], counts) + np.arange(bounds[-1])
    return acc[keep], bounds


def slid(x: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` (np.minimum or np.maximum) over every ``width`` consecutive values."""
    have, out = 1, x
    while have * 2 <= width:
        out = op(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = op(out[: len(x) - width + 1], out[width - have : width - have + len(x) - width + 1])
    return out


class Strings:
    """Byte strings by number, joined by numbers without a loop."""

    def __init__(self, strings: list[bytes]):
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        self.sizes = np.array([len(x) for x in strings], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))[:-1].astype(np.int64)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the strings with these numbers, one after another."""
        return np.concatenate([self._joined(ids[at : at + 65_536]) for at in range(0, len(ids), 65_536)] or [self.data[:0]])

    def _joined(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        shift = self.starts[ids] - (np.cumsum(sizes) - sizes)
        return self.data[np.repeat(shift, sizes) + np.arange(sizes.sum())]
