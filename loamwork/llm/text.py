"""Words of Arrow text batches as numpy arrays: byte ranges and 64-bit hashes, without a Python object a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from loamwork.llm import worker

#: Bytes of text that are worked on at once; a longer single text makes a longer piece.
PIECE_BYTES = 1 << 19
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)


class Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, grown when a longer piece asks for them."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(16, (n - 1).bit_length())
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, b, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        return self.up[:n], self.down[:n]


_BYTE_POWERS, WORD_POWERS, GRAM_POWERS = Powers(0xD6E8FEB86659FD93), Powers(0xA0761D6478BD642F), Powers(0xE7037ED1A0B428DB)


class Piece:
    """Consecutive texts of a batch.

    rows: index in the batch of the first text. first: for each text its first word, then the total.
    start, end: byte range of each word in data. hash: 64 mixed bits of each word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, row: int, lower: bool):
        self.row, self.n, self.data, self.offsets = row, len(offsets) - 1, data, offsets
        size = len(data)
        white = _WHITE[data]
        edge = np.zeros(size + 1, bool)
        edge[offsets] = True
        before, after = edge.copy(), edge
        before[1:] |= white
        after[:-1] |= white
        after[size] = True
        self.start = np.flatnonzero(~white & before[:-1])
        self.end = np.flatnonzero(~white & after[1:]) + 1
        self.first = np.searchsorted(self.start, offsets)
        up, down = _BYTE_POWERS.upto(size + 1)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_BYTE[_LOWER[data] if lower else data] * up[:size], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start])

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def pieces(column: pa.Array, lower: bool = False) -> Iterator[Piece]:
    """Cut a text column (null: empty) into pieces of about PIECE_BYTES, whole texts each."""
    worker.free()
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE_BYTES, side="right")) - 1)
        to = min(to, n)
        yield Piece(raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at, lower)
        at = to


def grams(hashes: np.ndarray, k: int, powers: Powers = WORD_POWERS) -> np.ndarray:
    """Unmixed hash of each run of k consecutive words (none if there are fewer)."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = powers.upto(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up[:n], out=sums[1:])
    return (sums[k:] - sums[: n - k + 1]) * down[: n - k + 1]


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of each k consecutive values, by doubling."""
    width = 1
    while width * 2 <= k:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    rest = k - width
    return np.minimum(x[:-rest], x[rest:]) if rest else x
