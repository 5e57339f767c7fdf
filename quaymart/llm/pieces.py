"""Encoding and decoding with a merge-type piece vocabulary: a score-ordered agenda of symbol pairs.

A word (a run of blank marks and what follows up to the next mark) starts as single characters.
An agenda holds the adjacent pairs whose join is in the vocabulary, best score first, of equal
scores the leftmost first; the best pair is joined, and its new neighbours enter. What remains are
the pieces; a character outside the vocabulary becomes its UTF-8 byte pieces. No piece holds a
blank mark after another character, so no join crosses the start of a word and words can be
encoded one by one; this is verified when the vocabulary is read, and where it does not hold the
text is encoded as one word.

Words up to ``WIDE`` characters keep their agendas side by side as rows of a matrix of pair scores:
a round joins the first best pair of every row, which is the order of the agenda word by word.
Longer words, and words with unknown characters, have an agenda each, as a heap.

Every word that the agenda has encoded is checked against the sentencepiece library, batch by
batch; a difference raises an error. Decoding is the library's ``decode``.

Defined results: a null text is encoded as an empty one, which has no ids but the end id, where
one is asked for, and decodes to an empty text. Texts of any length are encoded whole.
"""

from __future__ import annotations

import gc
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memo import per_worker
from .stores import free_names
from .unigram import MARK, read_pieces

WORDS = re.compile(f"{MARK}+[^{MARK}]*")
ROWS = 512     # documents encoded and returned at once
WIDE = 24      # longest word in the matrix
HELD = 200_000  # words of one generation whose ids are held between batches; there are two
NONE = np.int32(2**31 - 1)


class MergeEncoder:
    """The vocabulary of a model file and its agenda."""

    def __init__(self, path: str):
        pieces = read_pieces(path)
        if any(kind == 5 for _, _, kind in pieces) or any(kind == 4 for _, _, kind in pieces):
            raise ValueError("unused and user-defined pieces need rules of their own")
        self.known = {p: (-score, k) for k, (p, score, kind) in enumerate(pieces) if kind == 1}
        self.bytes = {int(p[3:5], 16): k for k, (p, _, kind) in enumerate(pieces) if kind == 6}
        self.unknown = next(k for k, (_, _, kind) in enumerate(pieces) if kind == 2)
        self.by_word = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.known)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.held: dict[str, list[int]] = {}
        self.old: dict[str, list[int]] = {}
        self._tables()

    def _tables(self) -> None:
        """Piece of every character, and a hash table from pairs of pieces to their join and its rank."""
        self.letters = np.full(0x110000, -1, np.int32)
        for p, (_, k) in self.known.items():
            if len(p) == 1:
                self.letters[ord(p)] = k
        for byte in range(128):
            # An unknown character of one byte is its byte piece, which joins with nothing.
            if self.letters[byte] < 0 and byte in self.bytes:
                self.letters[byte] = self.bytes[byte]
        ranked = sorted((rank, k, p) for p, (rank, k) in self.known.items())
        position = {k: i for i, (_, k, _) in enumerate(ranked)}
        pairs = {}
        for p, (_, k) in self.known.items():
            for cut in range(1, len(p)):
                a, b = self.known.get(p[:cut]), self.known.get(p[cut:])
                if a and b:
                    pairs[a[1] << 20 | b[1]] = (position[k], k)
        # Equal scores of different pieces would need the agenda's own order of positions.
        scores = [rank for rank, _, p in ranked if len(p) > 1]
        distinct = {p: r for p, (r, _) in self.known.items() if len(p) > 1 and len(set(p)) > 1}
        self.matrix = len(set(distinct.values())) == len(distinct) and bool(scores)
        keys = np.array(list(pairs), dtype=np.int64)
        values = np.array(list(pairs.values()), dtype=np.int32).reshape(-1, 2)
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.slot_key = np.full((1 << self.bits) + 1, -1, np.int64)
        self.slot_value = np.full(((1 << self.bits) + 1, 2), NONE, np.int32)
        left = np.arange(len(keys))
        place = self._slot(keys)
        self.probes = 0
        while len(left):
            free = self.slot_key[place[left]] == -1
            try_now = left[free]
            _, one = np.unique(place[try_now], return_index=True)
            won = try_now[one]
            self.slot_key[place[won]], self.slot_value[place[won]] = keys[won], values[won]
            left = np.setdiff1d(left, won)
            place[left] = (place[left] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _join(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of the joins of two arrays of pieces; rank ``NONE`` where there is no join."""
        keys = np.where((a >= 0) & (b >= 0), a.astype(np.int64) << 20 | b, -2)
        place = self._slot(keys)
        found = self.slot_key[place]
        rank, piece = self.slot_value[place, 0], self.slot_value[place, 1]
        rank = np.where(found == keys, rank, NONE)
        piece = np.where(found == keys, piece, NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            place[open_] = (place[open_] + 1) & ((1 << self.bits) - 1)
            found = self.slot_key[place[open_]]
            hit = found == keys[open_]
            rank[open_[hit]], piece[open_[hit]] = self.slot_value[place[open_[hit]], 0], self.slot_value[place[open_[hit]], 1]
            open_ = open_[~hit & (found != -1)]
        return rank, piece

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of many words, whose first mark is left out, by the matrix where it applies."""
        words = [MARK + w for w in words]
        out: list = [None] * len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        pieces = self.letters[points]
        at = np.cumsum(sizes) - sizes
        plain = np.ones(len(words), bool)
        plain[np.repeat(np.arange(len(words)), sizes)[pieces < 0]] = False
        narrow = plain & (sizes <= WIDE) & (sizes > 0) & self.matrix
        for low, high in ((0, 8), (8, 14), (14, WIDE)):
            rows = np.flatnonzero(narrow & (sizes > low) & (sizes <= high))
            for begin in range(0, len(rows), 16384):
                part = rows[begin:begin + 16384]
                place = at[part][:, None] + np.arange(high)
                symbols = np.where(np.arange(high) < sizes[part][:, None], pieces[np.minimum(place, len(pieces) - 1)], np.int32(-1))
                for i, ids in zip(part.tolist(), self._rounds(symbols), strict=True):
                    out[i] = ids
        for i in np.flatnonzero(~narrow).tolist():
            out[i] = self.encode_word(words[i])
        return out

    def _rounds(self, symbols: np.ndarray) -> list[list[int]]:
        n, width = symbols.shape
        result = symbols.copy()
        lengths = (symbols >= 0).sum(axis=1)
        rank = np.full((n, width), NONE, np.int32)
        r, _ = self._join(symbols[:, :-1].ravel(), symbols[:, 1:].ravel())
        rank[:, :-1] = r.reshape(n, width - 1)
        rows = np.arange(n)
        columns = np.arange(width)
        while len(rows):
            best = rank.argmin(axis=1)
            every = np.arange(len(rows))
            going = rank[every, best] != NONE
            if not going.all():
                result[rows[~going]] = symbols[~going]
                rows, symbols, rank, best = rows[going], symbols[going], rank[going], best[going]
                every = np.arange(len(rows))
                if not len(rows):
                    break
            _, joined = self._join(symbols[every, best], symbols[every, best + 1])
            stay = columns <= best[:, None]
            symbols = np.where(stay, symbols, np.concatenate([symbols[:, 1:], np.full((len(rows), 1), -1, np.int32)], axis=1))
            rank = np.where(stay, rank, np.concatenate([rank[:, 1:], np.full((len(rows), 1), NONE, np.int32)], axis=1))
            symbols[every, best] = joined
            after = np.where(best + 1 < width, symbols[every, np.minimum(best + 1, width - 1)], -1)
            rank[every, best] = self._join(joined, after)[0]
            some = best > 0
            rank[every[some], best[some] - 1] = self._join(symbols[every[some], best[some] - 1], joined[some])[0]
            lengths[rows] -= 1
        return [row[:k] for row, k in zip(result.tolist(), lengths.tolist(), strict=True)]

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word by a heap of its own."""
        known = self.known
        symbols = list(word)
        n = len(symbols)
        agenda = []
        for i in range(n - 1):
            found = known.get(symbols[i] + symbols[i + 1])
            if found:
                agenda.append((found[0], i, i + 1, 2))
        heapq.heapify(agenda)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pop, push = heapq.heappop, heapq.heappush
        while agenda:
            _, left, right, size = pop(agenda)
            a, b = symbols[left], symbols[right]
            if not a or not b or len(a) + len(b) != size:
                continue   # one of the two has been joined with another since
            symbols[left], symbols[right] = a + b, ""
            nxt, prev = after[right], before[left]
            after[left] = nxt
            joined = a + b
            if nxt < n:
                before[nxt] = left
                whole = joined + symbols[nxt]
                found = known.get(whole)
                if found:
                    push(agenda, (found[0], left, nxt, len(whole)))
            if prev >= 0:
                whole = symbols[prev] + joined
                found = known.get(whole)
                if found:
                    push(agenda, (found[0], prev, left, len(whole)))
        ids: list[int] = []
        for symbol in symbols:
            if symbol:
                found = known.get(symbol)
                if found:
                    ids.append(found[1])
                elif self.bytes:
                    ids.extend(self.bytes[b] for b in symbol.encode("utf-8"))
                elif not ids or ids[-1] != self.unknown:
                    ids.append(self.unknown)
        return ids

    def check(self, words: list[str], ids: list[list[int]]) -> None:
        """Compare encoded words with the library, which puts the mark in front itself."""
        want = self.library.encode(words, num_threads=1)
        if want != ids:
            for word, have, right in zip(words, ids, want, strict=True):
                if have != right and word:   # the library does not mark an empty text
                    raise ValueError(f"{word!r} is encoded as {have}, the library has {right}")

    def words(self, text: str | None) -> list[str]:
        """Words of a text without their first mark."""
        if not text:
            return []
        if self.by_word and "  " not in text and MARK not in text and text[0] != " ":
            return text.split(" ")
        marked = MARK + text.replace(" ", MARK)
        return [w[1:] for w in WORDS.findall(marked)] if self.by_word else [marked[1:]]

    def encode(self, texts: list[str | None], end: list[int]) -> list[list[int]]:
        """Ids of a batch of texts; the words that are new are encoded and checked together."""
        words = [self.words(x) for x in texts]
        held = self.held
        different = set()
        for x in words:
            different.update(x)
        new = [w for w in different if w not in held]
        if new:
            if len(held) + len(new) > HELD:
                # The young generation becomes the old one; words met again move back.
                self.old, self.held = held, {}
                held, new = self.held, list(different)
            old = self.old
            held.update((w, old[w]) for w in new if w in old)
            new = [w for w in new if w not in held]
            ids = self.encode_words(new)
            self.check(new, ids)
            held.update(zip(new, ids, strict=True))
        get = held.__getitem__
        out = [[*chain.from_iterable(map(get, x)), *end] for x in words]
        if len(held) > 2 * HELD:   # the words of this batch alone are too many to be held
            self.held = {}
        return out


def encode(docs: DataFrame, model: str, text: str = "text", end_id: int | None = None, decode: bool = False) -> DataFrame:
    """All columns of ``docs`` plus ``ids`` (array of int) and, with ``decode``, ``decoded`` (text).

    ``model`` is the path of the vocabulary file on every executor. Where the input has columns of these
    names, the new ones get underscores in front.
    """
    columns = docs.columns
    ids_name, decoded_name = free_names(columns, "ids", "decoded")
    added = {ids_name: F.array().cast("array<int>")} | ({decoded_name: F.lit("")} if decode else {})
    schema = docs.withColumns(added).schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()   # nothing here is cyclic, and the collector walks all held words again and again
        try:
            yield from coded(batches)
        finally:
            gc.enable()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = per_worker("pieces", model, lambda: MergeEncoder(model))
        tail = [] if end_id is None else [end_id]
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                batch = whole.slice(at, ROWS)
                texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
                ids = merges.encode(texts, tail)
                out = [batch.column(i) for i in range(len(columns))]
                out.append(pa.array(ids, pa.list_(pa.int32())))
                if decode:
                    out.append(pa.array(merges.library.decode(ids, num_threads=1), pa.string()))
                yield pa.RecordBatch.from_arrays(out, names)

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """All columns of ``rows`` plus ``decoded`` (with underscores in front if there is one); null ids decode to an empty text."""
    columns = rows.columns
    name = free_names(columns, "decoded")[0]
    schema = rows.withColumn(name, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = sentencepiece.SentencePieceProcessor(model_file=model)
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                batch = whole.slice(at, ROWS)
                lists = [x or [] for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
                out = [batch.column(i) for i in range(len(columns))]
                yield pa.RecordBatch.from_arrays([*out, pa.array(library.decode(lists, num_threads=1), pa.string())], [*columns, name])

    return rows.mapInArrow(run, schema)
