"""Hard negatives: rows of another label whose score with an anchor lies in a band below that of a positive.

Components are whole numbers, ``floor(scale * x)``, and a score is their exact inner product. It is computed as a
matrix product in a residue number system: modulo each of a few small primes the components are centred residues in
float32, a product over at most ``CHUNK`` of them stays below 2 ** 24 and is therefore exact, and the signed score is put
together from its residues by Chinese remaindering with centred mixed-radix digits. As many primes are taken as the
largest possible score needs.

Anchors meet all rows in blocks: about ``ANCHORS`` of them, a bounded number of bytes, go out by broadcast, and a map over
the rows keeps the best of each anchor in its task; windows over these few rows make the final choice. One such pass finds
the positives of a block, a second one the negatives, whose bands the positives' scores set. A label held by a third of
all rows costs no more than any other, since no group of rows is ever brought together.

Defined results: rows with a null id or label, or whose vector is null, empty, of another length than the most frequent
one, or holds null or non-finite entries take no part; neither do rows with a component so large that a hundred
times a score might not be a long. Rows that repeat an id count once, as the one with the smallest label and then vector.
Ties go to the smaller id. An anchor without another row of its label has no positive and gives no rows; a
positive whose band holds nothing gives none either. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .neighbours import matrix
from .stores import stored

CHUNK = 256            # components multiplied before their sum is reduced
ANCHORS = 4096         # mean number of anchors in a block
CELLS = 1 << 21        # scores held at once
LARGEST = 1 << 56      # of a score, so that a hundred times as much is a long
NONE = -(1 << 62)       # below every score, and its negative is a long


def moduli(width: int, bound: int) -> list[int]:
    """Primes whose product exceeds twice ``bound``, each so small that ``CHUNK`` products of centred residues sum up exactly in float32."""
    at = isqrt(4 * (1 << 24) // min(max(width, 1), CHUNK))
    found, product = [], 1
    while product <= 2 * bound + 1:
        while any(at % q == 0 for q in range(2, isqrt(at) + 1)):
            at -= 1
        found.append(at)
        product *= at
        at -= 1
    return found


def _reduced(x: np.ndarray, p: int) -> np.ndarray:
    """Centred residues of whole float32 numbers below 2 ** 24, in place."""
    x -= np.rint(x * np.float32(1 / p)) * np.float32(p)
    half = np.float32(p // 2)
    x[x > half] -= np.float32(p)
    x[x < -half] += np.float32(p)
    return x


def residues(components: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """Centred residues of whole numbers modulo each prime, as float32."""
    out = []
    for p in primes:
        r = np.mod(components, p)
        out.append(np.where(r > p // 2, r - p, r).astype(np.float32))
    return out


def scores(left: list[np.ndarray], right: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact inner products of all rows of ``left`` with all rows of ``right``, from their residues."""
    digits: list[np.ndarray] = []
    total, place = None, 1
    for k, p in enumerate(primes):
        digit = np.zeros((len(left[k]), len(right[k])), np.float32)
        for at in range(0, left[k].shape[1], CHUNK):
            digit = _reduced(digit + _reduced(left[k][:, at:at + CHUNK] @ right[k][:, at:at + CHUNK].T, p), p)
        for known, q in zip(digits, primes, strict=False):
            inverse = pow(q, -1, p)
            digit = _reduced(digit - known, p)
            digit = _reduced(digit * np.float32(inverse if inverse <= p // 2 else inverse - p), p)
        digits.append(digit)
        total = digit.astype(np.int64) if total is None else total + digit.astype(np.int64) * place
        place *= p
    return total


def first_of(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` highest entries of each row that are not ``NONE``, ties to the left."""
    if score.shape[1] > k:
        edge = -np.partition(-score, k - 1, axis=1)[:, k - 1:k] if k else np.full((len(score), 1), np.iinfo(np.int64).max)
        above, level = score > edge, score == edge
        left = k - above.sum(axis=1, keepdims=True)
        score = np.where(above | (level & (np.cumsum(level, axis=1, dtype=np.int32) <= left)), score, NONE)
    return np.nonzero(score != NONE)


class Best:
    """The best ``k`` candidates of each list, kept while batches pass by."""

    def __init__(self, k: int):
        self.k, self.list, self.score, self.id = k, *(np.zeros(0, np.int64) for _ in range(3))

    def add(self, which: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        which, score, ids = (np.concatenate(z) for z in ((self.list, which), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, which))
        which = which[order]
        rank = np.arange(len(which)) - np.searchsorted(which, which)
        order = order[rank < self.k]
        self.list, self.score, self.id = which[rank < self.k], score[order], ids[order]


def _met(batches: Iterator[pa.RecordBatch], anchors: dict, primes: list[int]) -> Iterator[tuple]:
    """For pieces of the rows and of the anchors: first anchor, scores, ids, and whether ids and labels are equal."""
    tall = len(anchors["id"])
    mine = residues(anchors["x"], primes)
    for batch in batches:
        order = np.argsort(batch.column(0).to_numpy(), kind="stable")
        batch = batch.take(pa.array(order))
        wide = max(1, min(len(batch), 4096))
        step = max(1, CELLS // wide)
        for c in range(0, len(batch), wide):
            part = batch.slice(c, wide)
            ids, labels = part.column(0).to_numpy(), part.column(1).to_numpy()
            theirs = residues(matrix(part.column(2)).astype(np.int64), primes)
            for a in range(0, tall, step):
                s = scores([r[a:a + step] for r in mine], theirs, primes)
                yield a, s, ids, anchors["id"][a:a + step, None] == ids[None], anchors["label"][a:a + step, None] == labels[None]


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: str = "label", key: str = "vec_id", vector: str = "embedding", scale: int = 256,
                   positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and ``negative_score``.

    ``label`` is a whole number, or anything that ``xxhash64`` tells apart. For each of an anchor's first ``positives`` rows of its own
    label, the first ``negatives`` rows of other labels with ``low * positive <= 100 * negative <= high * positive``.
    """
    spark = vectors.sparkSession
    code = F.col(label).cast("bigint") if isinstance(vectors.schema[label].dataType, IntegralType) else F.xxhash64(label)
    usable = F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) \
        & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    rows = vectors.where(usable).select(F.col(key).cast("bigint").alias("id"), code.alias("l"), F.col(vector).cast("array<double>").alias("v"),
                                        F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    width = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    result = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not width:
        return spark.createDataFrame([], result)
    width = width[0]["n"]
    largest = isqrt(LARGEST // width)
    # floor() of a double is a long, which has no room for the largest ones; those rows go first.
    rows = rows.where((F.size("v") == width) & F.forall("v", lambda x: F.abs(x) * scale < float(largest))) \
        .withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("bigint")))
    once = rows.groupBy("id").agg(F.min(F.struct("l", "v", "anchor")).alias("r"))
    rows = stored(once.select("id", "r.l", "r.v", "r.anchor", F.array_max(F.transform("r.v", F.abs)).alias("top")))
    size = rows.agg(F.max("top").alias("top"), F.sum(F.col("anchor").cast("int")).alias("n")).first()
    if not size["n"]:
        return spark.createDataFrame([], result)
    primes = moduli(width, width * size["top"] ** 2)
    blocks = -(-size["n"] // ANCHORS)
    chosen = rows.where("anchor").select("id", "l", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    chosen = stored(chosen) if blocks > 1 else chosen
    offered = rows.select("id", "l", "v")
    found = None
    for block in range(blocks):
        part = _of_block(chosen.where(F.col("block") == block), offered, primes, positives, negatives, low, high)
        found = part if found is None else found.unionAll(part)
    return found


def _of_block(chosen: DataFrame, offered: DataFrame, primes: list[int], positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """The result rows of one block of anchors; the block is small by construction."""
    context = offered.sparkSession.sparkContext
    table = chosen.select("id", "l", "v").orderBy("id").toArrow()
    anchors = {"id": table["id"].to_numpy(), "label": table["l"].to_numpy(), "x": matrix(table["v"]).astype(np.int64)}
    shipped = context.broadcast(anchors)

    def same_label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(positives)
        for a, s, ids, same_row, same in _met(batches, shipped.value, primes):
            r, c = first_of(np.where(same & ~same_row, s, NONE), positives)
            best.add(r + a, s[r, c], ids[c])
        yield pa.RecordBatch.from_arrays([pa.array(shipped.value["id"][best.list]), pa.array(best.id), pa.array(best.score)], ["anchor_id", "id", "score"])

    tops = offered.mapInArrow(same_label, "anchor_id long, id long, score long")
    chain = _first(tops, ["anchor_id"], positives).orderBy("anchor_id", "rank").toArrow()
    pairs = {"anchor": np.searchsorted(anchors["id"], chain["anchor_id"].to_numpy()), "nth": chain["rank"].to_numpy() - 1,
             "id": chain["id"].to_numpy(), "score": chain["score"].to_numpy()}
    wanted = np.full((len(anchors["id"]), positives), NONE)
    wanted[pairs["anchor"], pairs["nth"]] = pairs["score"]
    names = np.zeros((len(anchors["id"]), positives), np.int64)
    names[pairs["anchor"], pairs["nth"]] = pairs["id"]
    bands = context.broadcast((wanted, names))

    def in_band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, (aim, who) = Best(negatives), bands.value
        for a, s, ids, _, same in _met(batches, shipped.value, primes):
            other, hundred = ~same, 100 * s
            for nth in range(positives):
                goal = aim[a:a + len(s), nth:nth + 1]
                real = np.where(goal == NONE, 0, goal)
                fits = other & (goal != NONE) & (low * real <= hundred) & (hundred <= high * real)
                r, c = first_of(np.where(fits, s, NONE), negatives)
                best.add((r + a) * positives + nth, s[r, c], ids[c])
        anchor, nth = best.list // max(positives, 1), best.list % max(positives, 1)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (shipped.value["id"][anchor], who[anchor, nth], aim[anchor, nth], best.id, best.score)],
                                         ["anchor_id", "positive_id", "positive_score", "id", "score"])

    lists = offered.mapInArrow(in_band, "anchor_id long, positive_id long, positive_score long, id long, score long")
    return _first(lists, ["anchor_id", "positive_id"], negatives) \
        .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _first(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
