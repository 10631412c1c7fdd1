"""Word shingles of a block of texts as 64-bit elements.

Words are runs of non-separators of the lower-cased text. A text with fewer
than ``width`` words has one shingle of all its words; a text without words
has none. The n-th occurrence of a shingle in a text is an element of its
own, so the Jaccard similarity of two element sets is the weighted Jaccard
similarity of the shingle counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from basketlab.llm.arrays import U, flat, mix, word_hashes

WIDTH = 5
_STEP = U(0xC2B2AE3D27D4EB4F)


def elements(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(elements, element offsets per text)."""
    h, row, _ = _words(texts)
    return _elements(h, row, len(texts), width)


def _words(texts: pa.Array):
    raw, offsets = flat(pc.utf8_lower(texts.cast(pa.large_string())))
    h, row = word_hashes(raw, offsets)
    return h, row, len(offsets) - 1


def _elements(h: np.ndarray, row: np.ndarray, n: int, width: int):
    first = np.searchsorted(row, np.arange(n + 1))
    count = np.diff(first)
    size = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    offs = np.append(0, np.cumsum(size))
    of = np.repeat(np.arange(n), size)
    at = np.arange(offs[-1]) - offs[of] + first[of]
    s = np.zeros(len(at), U)
    for j in range(width):
        s *= _STEP
        ok = at + j < first[of + 1]
        s[ok] += h[at[ok] + j]
    s = mix(s)
    key = mix(s ^ (of.astype(U) * U(0x9E3779B97F4A7C15)))
    ordered = np.sort(key)
    repeated = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if len(repeated):
        at = np.searchsorted(repeated, key)
        again = np.flatnonzero(repeated[np.minimum(at, len(repeated) - 1)] == key)
        order = again[np.argsort(key[again], kind="stable")]
        k = key[order]
        start = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        nth = np.arange(len(k)) - np.repeat(start, np.diff(np.append(start, len(k))))
        s[order] = np.where(nth > 0, mix(s[order] + nth.astype(U) * U(0xA0761D6478BD642F)), s[order])
    return s, offs


def word_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's word sequence and its word count."""
    h, row, n = _words(texts)
    return _sequence_keys(h, row, n)


def _sequence_keys(h, row, n):
    first = np.searchsorted(row, np.arange(n + 1))
    place = (np.arange(len(h)) - first[row]).astype(U)
    out = []
    for salt in (U(0x8EBC6AF09C88C6E3), U(0x589965CC75374CC3)):
        sums = np.append(U(0), np.cumsum(mix(h ^ mix(place * U(2) + salt)), dtype=U))
        out.append(mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(U)))
    return out[0], out[1], np.diff(first)
