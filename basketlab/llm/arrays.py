"""Numpy helpers on the bytes of Arrow string columns.

All of them work on a block of texts at once: ``flat`` gives the bytes and
the row offsets, ``words`` the word ranges, ``range_hashes`` a 64-bit hash of
any byte ranges (differences of one prefix sum). ``row_blocks`` cuts a record
batch into blocks of bounded bytes, so temporary arrays stay bounded however
large the batch is; a text longer than the bound is a block of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
ROW_BYTES = 128
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}

# Separators of words: space and the control characters 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
# Anything that is not an ASCII letter, a digit or a byte of a non-ASCII character.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[128:] = False
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    NOT_ALNUM[_lo:_hi] = False


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def uniform(x: np.ndarray) -> np.ndarray:
    """[0, 1) from a mixed 64-bit hash."""
    return (x >> U(11)).astype(np.float64) * 2.0 ** -53


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        base = np.full(size, _BASE if kind == "up" else _INVERSE, U)
        base[0] = 1
        have = _powers[kind] = np.multiply.accumulate(base)
    return have[:n]


def release() -> None:
    """Give freed memory back to the system, and drop the cached powers."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(work):
    """The mapInArrow function ``work``, calling ``release`` when a partition
    ends: Spark's Python workers live on and serve later stages."""
    def run(batches):
        try:
            yield from work(batches)
        finally:
            release()
    return run


def row_blocks(batch: pa.RecordBatch, column: str, max_bytes: int,
               max_rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """Consecutive row slices whose ``column`` holds at most ``max_bytes``
    bytes each, a row counting ROW_BYTES more than its text (one longer text
    makes a slice of its own), and at most ``max_rows`` rows."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64) + ROW_BYTES)
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
        if max_rows:
            stop = min(stop, start + max_rows)
        yield batch.slice(start, stop - start)
        start = stop


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    _, offsets, data = column.buffers()
    if offsets is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def words(raw: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE):
    """(starts, ends, row of each word): maximal runs of non-separators that
    do not cross rows."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~separator[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside
    ends[:-1] = inside[:-1] & (separator[raw[1:]] | edge[1:-1])
    s = np.flatnonzero(starts)
    return s, np.flatnonzero(ends) + 1, np.searchsorted(offsets, s, side="right") - 1


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    out = np.zeros(len(raw) + 1, U)
    terms = raw.astype(U)
    terms += U(1)
    terms *= _power("up", len(raw))
    np.cumsum(terms, out=out[1:])
    return out


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each range, the same wherever it stands."""
    h = (sums[ends] - sums[starts]) * _power("down", len(sums))[starts]
    return mix(h + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def block_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """``range_hashes`` of consecutive ranges, with prefix sums over about
    ``block`` bytes at a time."""
    out = np.empty(len(starts), U)
    cuts = np.append(np.flatnonzero(np.diff(starts // block, prepend=-1)), len(starts))
    for a, b in zip(cuts[:-1], cuts[1:]):
        lo = starts[a]
        out[a:b] = range_hashes(prefix_sums(raw[lo:ends[b - 1]]), starts[a:b] - lo, ends[a:b] - lo)
    return out


def word_hashes(raw, offsets, separator: np.ndarray = SPACE):
    """(hash, row) of each word in order."""
    s, e, row = words(raw, offsets, separator)
    return range_hashes(prefix_sums(raw), s, e), row


def by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, its places in order) of every shard that occurs: one sort,
    however many shards there are."""
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order], prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], len(order))):
        yield int(shard[order[a]]), order[a:b]


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
