"""Line dedup by pairwise alignment.

Documents that overlap are found through shared lines, a pair of an earlier and a later document is
aligned line by line with patience diff, and the lines of aligned blocks are deleted from the later
one. Earlier means a smaller id.

* Exact copies of a text are found by its hash; the first keeps its lines, the others lose them.
* Every line that several different texts hold is credited to its first holder, and each other
  text is aligned with that holder: as many pairs at most as lines, however many texts share one.
  Holders that many texts point to are dealt out in slots of about ``SLOT`` texts.
* What decides is the pair alone, never how many texts there are or how many of them hold a line.
* A line is deleted only where an earlier text holds it, and the first holder of a line never
  loses it, so no line disappears from the corpus.

Defined results: blank lines are never evidence and go only with a block that holds another line;
a null text stays null, with 0 lines; a text of blank lines loses nothing. Rows that repeat both id
and text count as one and get the same result. Null ids come last. Lines are compared without
surrounding blanks. Texts with one id are ordered by their hash.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stores import attach, free_names, stored, text_key

SLOT = 2000
BLANK = None


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs, sorted by the first number, that increases in the second."""
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        if at == len(tails):
            tails.append(j)
            ends.append(k)
        else:
            tails[at], ends[at] = j, k
        back[k] = ends[at - 1] if at else -1
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _anchors(a: Sequence, b: Sequence, a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Lines that are unique on both sides; where there are none, equal lines in order of their use."""
    places: dict = {}
    for i in range(a0, a1):
        if a[i] is not BLANK:
            places.setdefault(a[i], ([], []))[0].append(i)
    for j in range(b0, b1):
        if b[j] in places and b[j] is not BLANK:
            places[b[j]][1].append(j)
    unique = [(x[0], y[0]) for x, y in places.values() if len(x) == len(y) == 1]
    if not unique:
        unique = [pair for x, y in places.values() for pair in zip(x, y)]
    return _increasing(sorted(unique))


def aligned(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Patience diff: matched places of two line lists, in order."""
    out: list[tuple[int, int]] = []
    open_ = [(0, len(a), 0, len(b))]
    while open_:
        a0, a1, b0, b1 = open_.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        ends = _anchors(a, b, a0, a1, b0, b1)
        if not ends:
            continue
        out.extend(ends)
        before = (a0 - 1, b0 - 1)
        for i, j in [*ends, (a1, b1)]:
            if i > before[0] + 1 and j > before[1] + 1:
                open_.append((before[0] + 1, i, before[1] + 1, j))
            before = (i, j)
    return sorted(out)


def common_blocks(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Runs ``[start, end)`` of lines of ``b`` that are aligned with as long a run of ``a`` and are not all blank."""
    blocks, last = [], (-2, -2)
    for i, j in aligned(a, b):
        if (i, j) == (last[0] + 1, last[1] + 1):
            blocks[-1][1] = j + 1
        else:
            blocks.append([j, j + 1])
        last = (i, j)
    return [(x, y) for x, y in blocks if any(b[j] is not BLANK for j in range(x, y))]


def _blocks_of_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        uids, starts, ends = [], [], []
        uid, earlier, later = (batch.column(i) for i in range(3))
        for k in range(len(batch)):
            for x, y in common_blocks(earlier[k].as_py(), later[k].as_py()):
                uids.append(uid[k].as_py())
                starts.append(x)
                ends.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(uids, pa.binary()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["uid", "a", "b"])


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs``, the text without the deleted lines, plus ``n_lines``, ``n_removed``
    and ``n_left`` (lines that are kept and not blank)."""
    line = lambda x: F.when(F.trim(x) != "", F.xxhash64(F.trim(x)))
    # Hashes only: the texts are read again at the end, and what is in between is an order smaller.
    order = F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"))
    hashed = docs.where(F.col(text).isNotNull()).select(
        order.alias("id"), text_key(text).alias("uid"), F.transform(F.split(F.col(text), "\n"), line).alias("lines"))
    texts = stored(hashed.groupBy("uid").agg(F.min(F.struct("id", "lines")).alias("first"), F.count("*").alias("n"))
                   .select("uid", F.col("first.id").alias("id"), F.col("first.lines").alias("lines"), "n"))

    different = F.filter(F.array_distinct("lines"), lambda x: x.isNotNull())
    held = stored(texts.select("uid", "id", F.explode(different).alias("line")))
    lines = held.groupBy("line").agg(F.count("*").alias("n"), F.min(F.struct("id", "uid")).alias("holder")).where("n > 1")
    shared = attach(held, lines, "line").where(F.col("holder.uid") != F.col("uid")).select(F.col("holder.uid").alias("earlier"), "uid", F.col("n").alias("texts"))
    met = shared.groupBy("earlier", "uid").agg(F.max("texts").alias("texts"))
    slots = F.ceil(F.col("texts") / SLOT)
    pairs = stored(met.select("earlier", "uid", F.struct(slots.alias("of"), F.pmod(F.xxhash64("uid"), slots).alias("nth")).alias("slot")))
    firsts = pairs.select("earlier", "slot").distinct().join(texts.select(F.col("uid").alias("earlier"), F.col("lines").alias("a")), "earlier")
    later = pairs.join(texts.select("uid", F.col("lines").alias("b")), "uid")
    both = later.join(firsts, ["earlier", "slot"]).select("uid", "a", "b")
    blocks = both.mapInArrow(_blocks_of_pairs, "uid binary, a long, b long")
    cut = blocks.groupBy("uid").agg(F.collect_set(F.struct("a", "b")).alias("cut"))
    copied = texts.where((F.col("n") > 1) & F.exists("lines", lambda x: x.isNotNull())).select("uid", F.col("id").alias("keeper"))
    decided = stored(copied.join(cut, "uid", "full_outer"))

    uid, keeper, gone, rows, kept = free_names(docs.columns, "_uid", "_keeper", "_gone", "_rows", "_kept")
    n_lines, n_removed, n_left = free_names(docs.columns, "n_lines", "n_removed", "n_left")
    marked = docs.withColumn(uid, F.when(F.col(text).isNotNull(), text_key(text)))
    # Decisions grow with the corpus; a merge join costs the same share of it at every size.
    cuts = decided.select(F.col("uid").alias(uid), F.col("keeper").alias(keeper), F.col("cut").alias(gone))
    joined = marked.join(cuts.hint("merge"), uid, "left")
    joined = joined.withColumn(rows, F.split(F.col(text), "\n"))
    is_copy = F.col(keeper).isNotNull() & ~F.col(keeper).eqNullSafe(order)
    inside = lambda i: F.coalesce(F.exists(F.col(gone), lambda g: (i >= g["a"]) & (i < g["b"])), F.lit(False))
    left = F.when(is_copy, F.array().cast("array<string>")).when(F.col(gone).isNull(), F.col(rows)) \
        .otherwise(F.filter(F.col(rows), lambda x, i: ~inside(i)))
    joined = joined.withColumn(kept, left)
    named = {text: F.when(F.col(text).isNotNull(), F.array_join(F.col(kept), "\n"))}
    return joined.select(*[named[c].alias(c) if c == text else F.col(c) for c in docs.columns],
                         F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(rows)).cast("bigint").alias(n_lines),
                         F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(rows) - F.size(kept)).cast("bigint").alias(n_removed),
                         F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(F.filter(F.col(kept), lambda x: F.trim(x) != ""))).cast("bigint").alias(n_left))
