"""Words of whole Arrow batches, by arrays over their UTF-8 bytes.

A word is a run of bytes other than ASCII white space inside one text. Word hashes are polynomials over the
bytes, taken from running sums: hash = sum(symbol[byte] * BASE ** place) / BASE ** start, modulo 2 ** 64, so no
word becomes a Python object. Words over LONG bytes are hashed by themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK, LONG = 1 << 18, 1 << 12
#: Texts are taken together up to so many bytes.
SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


#: For bytes.translate: lower-cases A-Z and nothing else.
ASCII_LOW = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, base % 2**64, np.uint64)]), dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, BLOCK + LONG + 1), _powers(pow(_BASE, -1, 2**64), BLOCK + LONG + 1)
_SYMBOL = np.random.default_rng(5).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOW_SYMBOL = _SYMBOL.copy()
_LOW_SYMBOL[65:91] = _SYMBOL[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its len + 1 offsets into them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about SLICE_BYTES of text each; a longer text is a part of its own."""
    _, offsets = column_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        yield batch.slice(at, upto - at)
        at = upto


class Words:
    """starts, ends (byte places), hashes, and doc (index of the text) of all words; first[i]:first[i + 1] are those of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, breaks: np.ndarray | None = None):
        """``breaks``: places where a new word begins whatever stands before."""
        self.data, self.offsets = data, offsets
        n = len(data)
        full = ~_SPACE[data]
        begins, ends = full.copy(), full.copy()
        begins[1:] &= ~full[:-1]
        ends[:-1] &= ~full[1:]
        edges = offsets[(offsets > 0) & (offsets < n)]
        if breaks is not None and len(breaks):
            edges = np.concatenate([edges, breaks])
        edges = edges[full[edges] & full[edges - 1]] if len(edges) else edges
        begins[edges], ends[edges - 1] = True, True
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.hashes = self._hashed(_LOW_SYMBOL if lower else _SYMBOL, lower)

    def _hashed(self, symbol: np.ndarray, lower: bool) -> np.ndarray:
        out = np.empty(len(self.starts), np.uint64)
        lo = 0
        while lo < len(self.starts):
            at = self.starts[lo]
            hi = int(np.searchsorted(self.starts, at + BLOCK))
            stop = min(self.ends[hi - 1], at + BLOCK + LONG)
            terms = symbol[self.data[at:stop]] * _UP[: stop - at]
            total = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
            a, b = self.starts[lo:hi] - at, np.minimum(self.ends[lo:hi], stop) - at
            out[lo:hi] = (total[b] - total[a]) * _DOWN[a]
            lo = hi
        for i in np.flatnonzero(self.ends - self.starts > LONG).tolist():
            word = self.data[self.starts[i] : self.ends[i]].tobytes()
            out[i] = xxhash.xxh3_64_intdigest(word.translate(ASCII_LOW) if lower else word)
        return mixed(out)


def least_of(values: np.ndarray, window: int, pick=np.minimum) -> np.ndarray:
    """The least (or as ``pick`` says) of each ``window`` neighbouring values."""
    out, reach = values, 1
    while reach < window:
        step = min(reach, window - reach)
        out = pick(out[:-step], out[step:]) if len(out) > step else out[:0]
        reach += step
    return out


def window_minima(values: np.ndarray, of: np.ndarray, window: int, usable: int = 0) -> np.ndarray:
    """Places of the values that are the least of some window of neighbours with one ``of``.

    ``usable``: how many places behind its last one a window must still be inside the same ``of``.
    """
    least = least_of(values, window)
    if not len(least):
        return np.zeros(0, np.int64)
    reach = window - 1 + usable
    inside = np.zeros(len(least), dtype=bool)
    m = max(0, min(len(least), len(of) - reach))
    inside[:m] = of[:m] == of[reach : reach + m]
    least = np.where(inside, least, np.uint64(0))
    around = np.zeros(len(least) + 2 * (window - 1), np.uint64)
    around[window - 1 : window - 1 + len(least)] = least
    most = least_of(around, window, np.maximum)
    return np.flatnonzero((most == values) & (values > 0))
