"""Word and shingle hashes of whole Arrow text columns with numpy, without a Python object per word.

A word is a maximal run of ASCII letters, ASCII digits and bytes of non-ASCII characters; ASCII
letters are folded to lower case. Everything else (blanks, ASCII punctuation, control characters)
separates words. A text in a script without blanks is therefore few, long words.

A shingle is ``SHINGLE`` consecutive words. A text with fewer words, but at least one, has one
shingle made of all its words; a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
BLOCK = 1 << 19          # bytes hashed at once; the working set stays in the cache
SLICE_BYTES = 4 << 20    # text bytes of a batch slice

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True

_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_P_INV = pow(_P, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_P, BLOCK + 1), _powers(_P_INV, BLOCK + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (in a new array)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and ``n + 1`` byte offsets of a text column; a null text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice holds about ``limit`` bytes of text, at least one row."""
    _, offsets = text_buffers(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < len(offsets) - 1:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), len(offsets) - 1)
        yield batch.slice(at, end - at)
        at = end


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of every word, and ``n + 1`` word offsets of the texts."""
    is_word = _WORD[raw]
    begins, ends = is_word.copy(), is_word.copy()
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    before = is_word[:-1].copy()
    before[cut - 1] = False
    begins[1:] &= ~before
    after = is_word[1:].copy()
    after[cut - 1] = False
    ends[:-1] &= ~after
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = np.empty(len(first), dtype=np.uint64)
    at = 0
    while at < len(first):
        base = first[at]
        upto = max(int(np.searchsorted(last, base + BLOCK, side="right")), at + 1)
        size = int(last[upto - 1] - base)
        up, down = (_UP, _DOWN) if size <= BLOCK else (_powers(_P, size + 1), _powers(_P_INV, size + 1))
        folded = _FOLD[raw[base:base + size]].astype(np.uint64)
        folded += np.uint64(1)
        folded *= up[:size]
        sums = np.empty(size + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(folded, out=sums[1:])
        a, b = first[at:upto] - base, last[at:upto] - base
        hashes[at:upto] = (sums[b] - sums[a]) * down[a]
        at = upto
    return mix(hashes), first, last, np.searchsorted(first, offsets)


def shingle_hashes(hashes: np.ndarray, word_offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every shingle in text order and ``n + 1`` shingle offsets of the texts."""
    counts = np.diff(word_offsets)
    out_counts = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_offsets = np.concatenate([[0], np.cumsum(out_counts)])
    total = len(hashes)
    if not total:
        return np.zeros(0, np.uint64), out_offsets
    # rolling[i] covers words i .. i + size - 1; words beyond the end of the column count as 0
    rolling = np.zeros(total, dtype=np.uint64)
    for j in range(size):
        rolling[:total - j] += hashes[j:] * np.uint64(pow(_P, j + 1, 1 << 64))
    keep = np.ones(total, dtype=bool)
    long = counts >= size
    for j in range(1, size):
        keep[word_offsets[1:][long] - j] = False
    for d in np.flatnonzero((counts > 0) & ~long):
        a, b = word_offsets[d], word_offsets[d + 1]
        keep[a + 1:b] = False
        powers = np.array([pow(_P, j + 1, 1 << 64) for j in range(b - a)], dtype=np.uint64)
        rolling[a] = (hashes[a:b] * powers).sum(dtype=np.uint64)
    return mix(rolling[keep]), out_offsets
