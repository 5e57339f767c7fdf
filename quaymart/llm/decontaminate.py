"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

An item matches a document where some window of the document, as many words long as the item, has a
weighted-shingle similarity of at least ``SIMILARITY`` with it: the sum over shingles of the smaller
number of uses times weight, divided by the sum of the larger. A shingle weighs the bytes of its words.

A window that shares no shingle with an item has similarity 0, so fingerprints are taken of the
windows around shared shingles only. The 64-bit SimHash of a window looks up the items of its size
whose fingerprint is within ``BLOCK_RADIUS`` bits in one of ``BLOCKS`` blocks; if two fingerprints
differ in at most ``RADIUS`` bits, that holds for at least one block, so no item within the radius
is missed. Items within the radius are then compared exactly.

Items of fewer words than a shingle are one shingle and match the same words in a row; items without
words match nothing. A document shorter than an item is one window. Null or empty texts have no
matches. Items that repeat a text are reported each. The benchmark is read in blocks of bounded
rows and bytes, each with its own pass over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import SHINGLE, mix, shingle_hashes, slices, text_buffers, word_hashes

SIMILARITY = 0.8
BLOCKS, BLOCK_RADIUS = 8, 2
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
BLOCK_ROWS, BLOCK_BYTES = 20_000, 64 << 20
FILTER_BITS = 24
_SHIFTS = np.arange(64, dtype=np.uint64)
_NEAR = [[v ^ m for m in range(256) if m.bit_count() <= BLOCK_RADIUS] for v in range(256)]


def simhash(hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of the windows ``starts .. starts + size - 1`` of a run of shingles."""
    signs = ((hashes[:, None] >> _SHIFTS) & np.uint64(1)).astype(np.float64)
    signs = (2 * signs - 1) * weights[:, None]
    sums = np.concatenate([np.zeros((1, 64)), np.cumsum(signs, axis=0)])
    bits = (sums[starts + size] - sums[starts]) > 0
    return (bits.astype(np.uint64) << _SHIFTS).sum(axis=1, dtype=np.uint64)


def _shingled(raw: np.ndarray, offsets: np.ndarray):
    """Shingle hashes, weights, shingle offsets, word hashes and word offsets of a column."""
    words, first, end, word_offsets = word_hashes(raw, offsets)
    hashes, shingle_offsets = shingle_hashes(words, word_offsets)
    sizes = np.concatenate([[0], np.cumsum(end - first)])
    counts, word_counts = np.diff(shingle_offsets), np.diff(word_offsets)
    owner = np.repeat(np.arange(len(counts)), counts)
    begin = np.arange(len(hashes)) - shingle_offsets[owner] + word_offsets[owner]
    return hashes, (sizes[begin + np.minimum(SHINGLE, word_counts[owner])] - sizes[begin]).astype(float), shingle_offsets, words, word_offsets


class _Size:
    """Items of one number of shingles, with their Hamming blocks."""

    def __init__(self, prints: list[int], items: list[int]):
        self.prints, self.items = np.array(prints, np.uint64), np.array(items)
        self.tables = []
        for b in range(BLOCKS):
            lists: list[list[int]] = [[] for _ in range(256)]
            for k, value in enumerate(((self.prints >> np.uint64(8 * b)) & np.uint64(255)).tolist()):
                for near in _NEAR[value]:
                    lists[near].append(k)
            self.tables.append((np.concatenate([[0], np.cumsum([len(x) for x in lists])]), np.array([k for x in lists for k in x], np.int64)))

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window number, item and distance of all pairs within the radius."""
        pairs = []
        for b, (cuts, members) in enumerate(self.tables):
            value = ((prints >> np.uint64(8 * b)) & np.uint64(255)).astype(np.int64)
            counts = cuts[value + 1] - cuts[value]
            window = np.repeat(np.arange(len(prints)), counts)
            place = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(cuts[value], counts)
            pairs.append(window * len(self.prints) + members[place])
        pairs = np.unique(np.concatenate(pairs))
        window, k = pairs // len(self.prints), pairs % len(self.prints)
        distance = np.bitwise_count(prints[window] ^ self.prints[k])
        near = distance <= RADIUS
        return window[near], self.items[k[near]], distance[near]


class Benchmark:
    """Index of one block of items; ``ids`` are kept as given."""

    def __init__(self, ids: list, texts: list[str | None]):
        self.ids = ids
        hashes, weights, offsets, words, word_offsets = _shingled(*text_buffers(pa.array(texts, pa.large_string())))
        self.bags, self.short, sizes, shared = [], {}, {}, {}
        for k in range(len(ids)):
            a, b = offsets[k], offsets[k + 1]
            n_words = int(word_offsets[k + 1] - word_offsets[k])
            if 0 < n_words < SHINGLE:
                self.short.setdefault(n_words, {}).setdefault(int(hashes[a]), []).append(k)
                self.bags.append(None)
                continue
            own, at, counts = np.unique(hashes[a:b], return_index=True, return_counts=True)
            self.bags.append((own, counts, weights[a:b][at], float(weights[a:b].sum())))
            if b > a:
                fingerprint = simhash(hashes[a:b], weights[a:b], np.array([0]), int(b - a))[0]
                prints, items = sizes.setdefault(int(b - a), ([], []))
                prints.append(int(fingerprint))
                items.append(k)
                for h in own.tolist():
                    shared.setdefault(h, set()).add(int(b - a))
        self.sizes = {m: _Size(*x) for m, x in sizes.items()}
        self.shared = shared
        self.keys = np.array(sorted(shared), np.uint64)
        self.filter = None

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """Places whose shingle is one of an item: a bit table first, then a search."""
        if self.filter is None:
            self.filter = np.zeros(1 << FILTER_BITS, bool)
            self.filter[(self.keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        some = np.flatnonzero(self.filter[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        if not len(some) or not len(self.keys):
            return some[:0]
        place = np.minimum(np.searchsorted(self.keys, hashes[some]), len(self.keys) - 1)
        return some[self.keys[place] == hashes[some]]

    def matches(self, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, float, int, int, int]]:
        """(text, item, similarity, first word, words, distance): the best window of each text and item."""
        hashes, weights, shingle_offsets, words, word_offsets = _shingled(raw, offsets)
        best: dict[tuple[int, int], tuple] = {}
        found = self.hits(hashes)
        owner = np.searchsorted(shingle_offsets, found, side="right") - 1
        cuts = np.flatnonzero(np.diff(owner)) + 1
        for places in np.split(found, cuts) if len(found) else []:
            doc = int(np.searchsorted(shingle_offsets, places[0], side="right") - 1)
            a, b = int(shingle_offsets[doc]), int(shingle_offsets[doc + 1])
            by_size: dict[int, list[int]] = {}
            for p in places.tolist():
                for m in self.shared[int(hashes[p])]:
                    by_size.setdefault(m, []).append(p - a)
            for m, hit in by_size.items():
                size = min(m, b - a)
                reach = np.unique((np.array(hit)[:, None] - np.arange(size)).ravel())
                reach = reach[(reach >= 0) & (reach <= b - a - size)]
                for run in np.split(reach, np.flatnonzero(np.diff(reach) > 1) + 1):
                    low, high = int(run[0]), int(run[-1]) + size
                    h, w = hashes[a + low:a + high], weights[a + low:a + high]
                    starts = run - low
                    window, item, distance = self.sizes[m].within(simhash(h, w, starts, size))
                    sums = np.concatenate([[0.0], np.cumsum(w)])
                    for k in np.unique(item).tolist():
                        own, counts, own_weights, total = self.bags[k]
                        local = np.searchsorted(own, h)
                        local = np.where(own[np.minimum(local, len(own) - 1)] == h, local, len(own))
                        for i in np.flatnonzero(item == k).tolist():
                            s = int(starts[window[i]])
                            used = np.bincount(local[s:s + size], minlength=len(own) + 1)[:-1]
                            common = float((np.minimum(used, counts) * own_weights).sum())
                            similarity = common / (total + float(sums[s + size] - sums[s]) - common)
                            entry = (similarity, -(low + s), -int(distance[i]), size + SHINGLE - 1)
                            if similarity >= SIMILARITY and entry > best.get((doc, k), (0.0,)):
                                best[doc, k] = entry
        for n, items in self.short.items():
            self._short(n, items, words, word_offsets, best)
        return [(doc, k, e[0], -e[1], e[3], -e[2]) for (doc, k), e in sorted(best.items())]

    def _short(self, n: int, items: dict[int, list[int]], words: np.ndarray, word_offsets: np.ndarray, best: dict) -> None:
        if len(words) < n:
            return
        rolling = np.zeros(len(words) - n + 1, np.uint64)
        for j in range(n):
            rolling += words[j:len(words) - n + 1 + j] * np.uint64(pow(0x9E3779B97F4A7C15, j + 1, 1 << 64))
        rolling = mix(rolling)
        for p in np.flatnonzero(np.isin(rolling, np.array(list(items), np.uint64))).tolist():
            doc = int(np.searchsorted(word_offsets, p, side="right") - 1)
            if p + n <= word_offsets[doc + 1]:
                for k in items[int(rolling[p])]:
                    best.setdefault((doc, k), (1.0, -(p - int(word_offsets[doc])), 0, n))


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[Benchmark]:
    """The benchmark in blocks of bounded rows and, on average, bytes."""
    rows = benchmark.select(F.col(item).alias("item"), F.col(text).alias("text"))
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    n = max(1, -(-size["n"] // BLOCK_ROWS), -(-size["b"] // BLOCK_BYTES))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        table = part.orderBy("item", "text").toArrow()
        yield Benchmark(table["item"].to_pylist(), table["text"].to_pylist())


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item found in it: both ids, ``similarity`` and the best window's
    ``start_word``, ``n_words`` and SimHash ``distance``. Documents without a match have no row."""
    types = f"{key} {dict(docs.dtypes)[key]}, {item} {dict(benchmark.dtypes)[item]}, similarity double, start_word long, n_words long, distance long"
    rows = docs.select(key, text)
    key_type, item_type = (rows.schema[key].dataType, benchmark.schema[item].dataType)
    from pyspark.sql.pandas.types import to_arrow_type
    arrow = [to_arrow_type(key_type), to_arrow_type(item_type), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
    parts = []
    for block in _blocks(benchmark, item, item_text):
        shipped = docs.sparkSession.sparkContext.broadcast(block)

        def find(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            index = shipped.value
            for whole in batches:
                for batch in slices(whole, text):
                    found = index.matches(*text_buffers(batch.column(1)))
                    if found:
                        ids = batch.column(0).take(pa.array([x[0] for x in found]))
                        rest = [pa.array([index.ids[x[1]] for x in found], arrow[1])]
                        rest += [pa.array([x[i] for x in found], arrow[i]) for i in range(2, 6)]
                        yield pa.RecordBatch.from_arrays([ids.cast(arrow[0]), *rest], [key, item, "similarity", "start_word", "n_words", "distance"])

        parts.append(rows.mapInArrow(find, types))
    return reduce(DataFrame.unionAll, parts)


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns unchanged."""
    columns = docs.columns
    place = columns.index(text)
    for block in _blocks(benchmark, item, item_text):
        shipped = docs.sparkSession.sparkContext.broadcast(block)

        def keep(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            index = shipped.value
            for whole in batches:
                for batch in slices(whole, text):
                    clean = np.ones(len(batch), bool)
                    clean[[x[0] for x in index.matches(*text_buffers(batch.column(place)))]] = False
                    yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
