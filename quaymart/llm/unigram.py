"""Token counts under a unigram vocabulary without building tokens: count-only Viterbi.

An Aho-Corasick automaton enumerates all vocabulary pieces inside a word; dynamic programming over
the end positions carries the best score and the number of pieces of the best path, nothing else.
Words start at each blank, which becomes the vocabulary's blank mark; one mark is put in front of
a text that does not begin with a blank. This is the segmentation of the tokenizers library's
unigram model with its blank-mark splitter, and its rules are kept exactly:

* scores are summed in double precision in text order; of equal scores the longest piece, that is
  the path met first, stays;
* a character that no single-character piece covers may be crossed with the lowest score less 10;
  neighbouring unknown characters are fused to one unknown piece, which counts its UTF-8 bytes if
  the vocabulary has all of them as byte pieces, else 1.

Defined results: a null or empty text has 0 tokens. Texts of any length are read whole.
"""

from __future__ import annotations

import gc
import hashlib
import math
import struct
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memo import Memo, per_worker
from .stores import free_names

MARK = "▁"
UNKNOWN_PENALTY = 10.0


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 2:
            size, at = _varint(data, at)
            yield key >> 3, data[at:at + size]
            at += size
        elif key & 7 == 5:
            yield key >> 3, data[at:at + 4]
            at += 4
        elif key & 7 == 1:
            yield key >> 3, data[at:at + 8]
            at += 8
        else:
            value, at = _varint(data, at)
            yield key >> 3, value


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """Piece, score and type (1 normal, 2 unknown, 3 control, 4 user, 6 byte) of a piece model file."""
    out = []
    with open(path, "rb") as file:
        for field, value in _fields(file.read()):
            if field == 1:
                piece, score, kind = "", 0.0, 1
                for f, v in _fields(value):
                    if f == 1:
                        piece = v.decode("utf-8")
                    elif f == 2:
                        score = struct.unpack("<f", v)[0]
                    elif f == 3:
                        kind = v
                out.append((piece, score, kind))
    return out


def rank_vocabulary(path: str) -> list[tuple[str, float]]:
    """Unigram vocabulary over the pieces of a merge-type file.

    Merge scores are minus the rank of the merge, no log probabilities; by Zipf's law a piece of
    rank r gets log(1 / (r + 1)) less the log of the sum over all pieces. Byte, control and unknown
    marks keep score 0, as in the file; a text that spells one out gets it, as in the library.
    """
    pieces = read_pieces(path)
    ranks = {p: -s for p, s, kind in pieces if kind in (1, 4) and s > -1e8}
    total = math.log(sum(1 / (r + 1) for r in ranks.values()))
    return [(p, -math.log(ranks[p] + 1) - total if p in ranks else 0.0) for p, _, kind in pieces]


class UnigramCounter:
    """Counts of one vocabulary; ``vocabulary`` is a list of (piece, score)."""

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True):
        self.lowest = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        names = {p for p, _ in vocabulary}
        self.bytes_known = byte_fallback and all(f"<0x{b:02X}>" in names for b in range(256))
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()

    def count_word(self, word: str) -> int:
        """Pieces of one word that already carries its blank mark."""
        n = len(word)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        crossed: dict[int, int] = {}   # ends whose best path crosses an unknown character last
        at, top, pieces, single = 0, -math.inf, 0, False
        # Matches come in order of their end; of one end the longest comes first, so of equal paths
        # the one that starts earlier stays.
        for end, (size, score) in self.automaton.iter(word):
            while at < end:
                if not single:
                    top, pieces = self._cross(word, at, top, pieces, best, count, crossed)
                at += 1
                best[at], count[at] = top, pieces
                top, single = -math.inf, False
            before = end + 1 - size
            value = best[before] + score
            if value > top:
                top, pieces = value, count[before] + 1
            if size == 1:
                single = True
        while at < n:
            if not single:
                top, pieces = self._cross(word, at, top, pieces, best, count, crossed)
            at += 1
            best[at], count[at] = top, pieces
            top, single = -math.inf, False
        return count[n]

    def _cross(self, word: str, at: int, top: float, pieces: int, best: list, count: list, crossed: dict[int, int]) -> tuple[float, int]:
        """The path over an unknown character, where it is better than the best match."""
        value = best[at] + self.lowest
        if not value > top:
            return top, pieces
        run = crossed.get(at, 0)
        crossed[at + 1] = 1
        if self.bytes_known:
            return value, count[at] + len(word[at].encode("utf-8", "surrogatepass"))
        return value, count[at] + (0 if run else 1)

    def counter(self, limit: int = 150_000):
        """Function from a text to its token count, with a bounded memo of words."""
        memo = Memo(lambda word: self.count_word(MARK + word), limit)
        get = memo.__getitem__

        def count(text: str | None) -> int:
            if not text:
                return 0
            # A mark in the text is a blank to the library.
            words = (text.replace(MARK, " ") if MARK in text else text).split(" ")
            if not words[0]:
                del words[0]
            return sum(map(get, words))

        return count


def token_counts(docs: DataFrame, vocabulary: list[tuple[str, float]], text: str = "text",
                 byte_fallback: bool = True) -> DataFrame:
    """All columns of ``docs`` plus ``n_tokens`` (with underscores in front if there is one).

    The vocabulary is a file of fixed size, never the data.
    """
    columns = docs.columns
    name = free_names(columns, "n_tokens")[0]
    schema = docs.withColumn(name, F.lit(0).cast("bigint")).schema
    key = hashlib.md5(repr((vocabulary, byte_fallback)).encode("utf-8", "surrogatepass")).hexdigest()
    shipped = docs.sparkSession.sparkContext.broadcast((vocabulary, byte_fallback))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()   # nothing here is cyclic, and the collector walks all held words again and again
        try:
            yield from counted(batches)
        finally:
            gc.enable()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = per_worker("unigram", key, lambda: UnigramCounter(*shipped.value).counter())
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))   # one Python text at a time
            out = [batch.column(i) for i in range(len(columns))]
            counts = pa.array([counter(x.as_py()) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*out, counts], [*columns, name])

    return docs.mapInArrow(count, schema)


