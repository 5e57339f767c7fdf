"""Approximate nearest neighbours by shifted space-filling curves.

Every vector gets a place on ``CURVES`` Hilbert curves, each through its own random projection to
``DIMENSIONS`` coordinates with its own shift. Spark range-partitions each ordering; a query looks at the
vectors within a window of places around its own on every curve, block by block, and the nearest of all
windows, by exact Euclidean distance in double precision, are merged.

The window is measured, not set: for a bounded sample of queries the true neighbours are found by
brute force over all vectors, and the window is the distance in places that ``TARGET`` of these pairs
keep on their best curve. Vectors in groups give short windows; vectors without any structure
need wide ones, at the cost of a share of all pairs of queries and vectors.

Equal vectors share a place, so a vector repeated a million times is one entry with its smallest
``k + 1`` ids, which are all that ``k`` neighbours can ask for.

Defined results: vectors that are null, empty, zero, of another length than the most frequent one,
or that hold null or non-finite numbers take no part, nor do rows with a null id. Fewer than ``k``
candidates give as many rows. Ties go to the smaller id. Rows that repeat an id count once if they
are equal; else each of its vectors is a candidate, and a query asks with its smallest one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hilbert import hilbert_keys
from .stores import stored

CURVES, DIMENSIONS, BITS = 20, 8, 6
TARGET = 0.96
FIT_ROWS = 8192        # bound of the vectors that centre and scale the projections
MEASURED = 192         # bound of the queries whose true neighbours set the window
BLOCK = 2048           # places of a curve that are compared at once
LEAST_WINDOW = 32


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long lists as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


class Curves:
    """Projections, scales and shifts of all curves."""

    def __init__(self, sample: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        width = sample.shape[1]
        self.dims = min(DIMENSIONS, width)
        self.turns, self.middle, self.scale, self.shift = [], [], [], []
        for _ in range(CURVES):
            turn = np.linalg.qr(rng.normal(size=(width, width)))[0][:, :self.dims]
            seen = sample @ turn
            spread = seen.std(axis=0)
            self.turns.append(turn)
            self.middle.append(seen.mean(axis=0))
            self.scale.append(np.where(spread > 0, spread, 1.0))
            self.shift.append(rng.uniform(-0.5, 0.5, self.dims))

    def keys(self, vectors: np.ndarray, curve: int) -> np.ndarray:
        z = (vectors @ self.turns[curve] - self.middle[curve]) / self.scale[curve] + self.shift[curve]
        cells = np.clip((z / 6 + 0.5) * (1 << BITS), 0, (1 << BITS) - 1)
        return hilbert_keys(cells.astype(np.int64), BITS)


def _distances(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact differences, squared and summed, a few queries at a time."""
    out = np.empty((len(queries), len(vectors)))
    step = max(1, (1 << 21) // max(vectors.size, 1))
    for at in range(0, len(queries), step):
        gap = queries[at:at + step, None, :] - vectors[None]
        np.einsum("qvd,qvd->qv", gap, gap, out=out[at:at + step])
    return np.sqrt(out)


def _nearest(distance: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` nearest finite entries of each row, ties to the smaller id."""
    rows, columns = [], []
    for r, row in enumerate(distance):
        some = np.flatnonzero(np.isfinite(row))
        if len(some) > k:
            edge = np.partition(row[some], k - 1)[k - 1]
            some = some[row[some] <= edge]
        order = some[np.lexsort((ids[some], row[some]))][:k]
        rows.append(np.full(len(order), r))
        columns.append(order)
    return np.concatenate(rows or [np.zeros(0, int)]), np.concatenate(columns or [np.zeros(0, int)])


def _top(pairs: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    return pairs.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def nearest(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``key`` and ``score`` (Euclidean distance) of every query's nearest others."""
    spark = vectors.sparkSession
    usable = F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & F.exists(vector, lambda x: x != 0) \
        & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(usable).select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    empty = f"query_id bigint, rank int, {key} bigint, score double"
    if not sizes:
        return spark.createDataFrame([], empty)
    rows = rows.where(F.size("v") == sizes[0]["n"])
    hashed = stored(rows.withColumn("h", F.xxhash64("v")).withColumn("g", F.xxhash64(F.lit(1), "v")))

    # Equal vectors: the smallest ids of each, at most k + 1 of them.
    few = _top(hashed.select("h", "g", "id").distinct(), ["h", "g"], [F.col("id")], k + 1)
    listed = few.groupBy("h", "g").agg(F.min("id").alias("first"), F.sort_array(F.collect_list("id")).alias("ids"))
    # One id can have several vectors, so the place of a vector is its hash.
    asked = hashed.where("q").groupBy("id").agg(F.min(F.struct("h", "g")).alias("x")).select("id", F.col("x.h").alias("h"), F.col("x.g").alias("g"))
    asked = stored(asked)
    heads = hashed.join(listed.select("h", "g", "first", "ids"), ["h", "g"]).where(F.col("id") == F.col("first")).dropDuplicates(["h", "g"])
    units = stored(heads.select("h", "g", "first", "ids", "v").join(asked.select("h", "g", F.lit(True).alias("q")).distinct(), ["h", "g"], "left")
                   .withColumn("q", F.coalesce("q", F.lit(False))))
    total = units.count()

    fitted = matrix(units.orderBy(F.xxhash64(F.lit(2), "h", "g")).limit(FIT_ROWS).select("v").toArrow()["v"])
    curves = spark.sparkContext.broadcast(Curves(fitted))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = matrix(batch.column(2))
            for c in range(CURVES):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), c, np.int32)), pa.array(curves.value.keys(points, c)), batch.column(0), batch.column(1)],
                                                 ["curve", "key", "h", "g"])

    keyed = units.select("h", "g", "v").mapInArrow(place, "curve int, key long, h long, g long")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), keyed.rdd.getNumPartitions())
    ordered = keyed.repartitionByRange(parts, "curve", "key", "h", "g").sortWithinPartitions("curve", "key", "h", "g")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 2, 3)), pa.array(np.full(len(batch), part, np.int64)), pa.array(np.arange(at, at + len(batch)))],
                                             ["curve", "h", "g", "part", "nth"])
            at += len(batch)

    numbered = stored(ordered.mapInArrow(number, "curve int, h long, g long, part long, nth long"))
    # One row per partition, not per vector; every curve holds all vectors, so places start at curve * total.
    before = numbered.groupBy("part").agg(F.count("*").alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = stored(numbered.join(F.broadcast(before.select("part", "before")), "part")
                    .select("curve", "h", "g", (F.col("before") + F.col("nth") - F.col("curve") * total).alias("place")))

    window = _window(units, placed, total, k)
    query = placed.join(units.where("q").select("h", "g", "v", "first"), ["h", "g"])
    low, high = F.greatest(F.col("place") - window, F.lit(0)), F.least(F.col("place") + window, F.lit(total - 1))
    reach = F.sequence(F.floor(low / BLOCK), F.floor(high / BLOCK))
    asking = query.select("curve", F.explode(reach).alias("block"), "place", F.lit(True).alias("q"), "first", "h", "g", "v")
    offered = placed.join(units.select("h", "g", "v", "first"), ["h", "g"]) \
        .select("curve", F.floor(F.col("place") / BLOCK).alias("block"), "place", F.lit(False).alias("q"), "first", "h", "g", "v")

    def compare(group: pa.Table) -> pa.Table:
        q = group["q"].to_numpy(zero_copy_only=False).astype(bool)
        asks, offers = group.filter(pa.array(q)), group.filter(pa.array(~q))
        at, to = asks["place"].to_numpy(), offers["place"].to_numpy()
        found_q, found_c, score = [], [], []
        if len(asks) and len(offers):
            x, ids = matrix(offers["v"]), offers["first"].to_numpy()
            for s in range(0, len(asks), 256):
                d = _distances(matrix(asks["v"].slice(s, 256)), x)
                d[np.abs(at[s:s + 256, None] - to[None]) > window] = np.inf
                r, c = _nearest(d, ids, k + 1)
                found_q.append(r + s)
                found_c.append(c)
                score.append(d[r, c])
        r, c = (np.concatenate(z) if z else np.zeros(0, int) for z in (found_q, found_c))
        s = np.concatenate(score) if score else np.zeros(0)
        left, right = asks.take(pa.array(r)), offers.take(pa.array(c))
        return pa.table([left["h"], left["g"], right["h"], right["g"], right["first"], pa.array(s)], names=["qh", "qg", "h", "g", "first", "score"])

    blocks = asking.unionAll(offered).groupBy("curve", "block").applyInArrow(compare, "qh long, qg long, h long, g long, first long, score double")
    best = _top(blocks.dropDuplicates(["qh", "qg", "h", "g"]), ["qh", "qg"], [F.col("score"), F.col("first"), F.col("h"), F.col("g")], k + 1, "_r").drop("_r")
    named = best.join(units.select("h", "g", "ids"), ["h", "g"]).select("qh", "qg", "score", F.explode("ids").alias("c"))
    # Of one id with several vectors the nearest counts.
    named = named.groupBy("qh", "qg", "c").agg(F.min("score").alias("score"))
    nearby = stored(_top(named, ["qh", "qg"], [F.col("score"), F.col("c")], k + 1, "_r").drop("_r"))
    pairs = asked.join(nearby, (F.col("h") == F.col("qh")) & (F.col("g") == F.col("qg"))).where(F.col("id") != F.col("c"))
    lists = _top(pairs, ["id"], [F.col("score"), F.col("c")], k)
    return lists.select(F.col("id").alias("query_id"), "rank", F.col("c").alias(key), "score")


def _window(units: DataFrame, placed: DataFrame, total: int, k: int) -> int:
    """Places that ``TARGET`` of the true neighbours of sampled queries are away on their best curve."""
    some = units.where("q").orderBy(F.xxhash64(F.lit(4), "h", "g")).limit(MEASURED).select("h", "g", "v").toArrow()
    if not len(some) or total <= 2 * LEAST_WINDOW:
        return max(total, 1)
    shipped = units.sparkSession.sparkContext.broadcast((matrix(some["v"]), some["h"].to_numpy(), some["g"].to_numpy()))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, hs, gs = shipped.value
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                d = _distances(points, matrix(part.column(2)))
                r, c = _nearest(d, part.column(3).to_numpy(), k + 1)
                pick = pa.array(c)
                yield pa.RecordBatch.from_arrays([pa.array(hs[r]), pa.array(gs[r]), part.column(0).take(pick), part.column(1).take(pick), pa.array(d[r, c])],
                                                 ["qh", "qg", "h", "g", "score"])

    found = units.select("h", "g", "v", "first").mapInArrow(search, "qh long, qg long, h long, g long, score double")
    true = _top(found, ["qh", "qg"], [F.col("score"), F.col("h"), F.col("g")], k + 1)
    true = true.where((F.col("h") != F.col("qh")) | (F.col("g") != F.col("qg"))).select("qh", "qg", "h", "g")
    mine = placed.select("curve", F.col("h").alias("qh"), F.col("g").alias("qg"), F.col("place").alias("p"))
    away = true.join(placed, ["h", "g"]).join(mine, ["curve", "qh", "qg"]).groupBy("qh", "qg", "h", "g").agg(F.min(F.abs(F.col("place") - F.col("p"))).alias("w"))
    need = away.agg(F.percentile("w", F.lit(TARGET)).alias("w")).first()["w"]
    return max(LEAST_WINDOW, int(np.ceil(need or 0)))
