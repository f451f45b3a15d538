"""Words of whole texts, their positions and 64-bit hashes, computed for many rows at once with numpy.

All functions work on the UTF-8 bytes of an Arrow string column. Separators are ASCII in both word
definitions, so a byte is enough to tell a separator and multi-byte characters stay in their word.
Null texts count as empty. Nothing is cut: a slice holds whole texts, and one that is longer than the
slice bound is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 4 << 20

_b = np.arange(256)
#: `[^\x20\x09-\x0D]+`
SPACED = ~((_b == 0x20) | ((_b >= 0x09) & (_b <= 0x0D)))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z have become a-z
ALNUM = ((_b >= 0x30) & (_b <= 0x39)) | ((_b >= 0x41) & (_b <= 0x5A)) | ((_b >= 0x61) & (_b <= 0x7A)) | (_b >= 0x80)
_FOLD = np.where((_b >= 0x41) & (_b <= 0x5A), _b + 32, _b).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_TABLE = mix((np.arange(1, 257, dtype=U64)) * U64(0x9E3779B97F4A7C15))
_TABLE_FOLD = _TABLE[_FOLD]
_P = 0xD6E8FEB86659FD93
_Q = 0xA0761D6478BD642F
_powers = np.ones(1, U64)


def _powers_of_p(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 64)
        grown = np.full(size, U64(_P))
        grown[0] = U64(1)
        _powers = np.cumprod(grown, dtype=U64)
    return _powers[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another, and where each begins (one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch between rows into parts of at most `limit` bytes of text, or one row."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    begin, total = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > begin and total + n > limit:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if len(size) > begin:
        yield batch.slice(begin)


class Words:
    """`h` hash, `start` and `end` byte bounds of each word; `first[i]:first[i + 1]` are row i's words."""

    def __init__(self, column: pa.Array, kind: np.ndarray, fold: bool, prefixes: bool = False) -> None:
        self.data, self.off = utf8(column)
        n = len(self.data)
        inside = kind[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.off] = True
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | edge[:n]))
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, self.off)
        length = self.end - self.start
        if len(length):
            at = np.cumsum(length) - length
            place = np.arange(int(length.sum())) - np.repeat(at, length)
            value = (_TABLE_FOLD if fold else _TABLE)[self.data[inside]] * _powers_of_p(int(length.max()))[place]
            self.h = mix(np.add.reduceat(value, at) + length.astype(U64) * U64(0x9E3779B97F4A7C15))
            if prefixes:
                self._at, self._sum = at, np.concatenate([np.zeros(1, U64), np.cumsum(value, dtype=U64)])
        else:
            self.h = np.zeros(0, U64)

    @property
    def rows(self) -> int:
        return len(self.off) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(self.rows), self.counts())

    def left(self) -> np.ndarray:
        """How many words each word has from itself to the end of its text."""
        return np.repeat(self.first[1:], self.counts()) - np.arange(len(self.h))

    def prefix(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of more than `size` bytes, and hashes of their first `size`; needs prefixes=True."""
        long = np.flatnonzero(self.end - self.start > size)
        if not len(long):
            return long, np.zeros(0, U64)
        at = self._at[long]
        return long, mix((self._sum[at + size] - self._sum[at]) ^ U64(0xC2B2AE3D27D4EB4F + size))

    def text(self, i: int) -> bytes:
        """Word i as it stands."""
        return self.data[self.start[i] : self.end[i]].tobytes()


def _shift(a: np.ndarray, k: int) -> np.ndarray:
    return np.concatenate([a[k:], np.zeros(min(k, len(a)), a.dtype)])


def rolling(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` values from each one on; those that run over the end are not meaningful."""
    out, have, block, width, q = np.zeros(len(h), U64), 0, h, 1, _Q
    while True:
        if size & width:
            out = out + _shift(block, have) * U64(pow(_Q, have, 1 << 64))
            have += width
        if 2 * width > size:
            return mix(out + U64(size))
        block = block + _shift(block, width) * U64(q)
        q = q * q % (1 << 64)
        width *= 2


def hash_word(word: str, fold: bool = True) -> int:
    """The hash that `Words` gives this single word."""
    return int(Words(pa.array([word]), np.ones(256, bool), fold).h[0])


def pack(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def ragged(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column of `kind` from its values and lengths."""
    off = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, kind))
