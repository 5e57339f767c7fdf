"""A regression forest for more rows than a machine can keep with a weight for every tree.

The method is that of Spark ML's regressor with its default settings: ``BINS`` bins a feature cut at the middle between
values, bootstrap weights of every row from a Poisson distribution of mean 1 for each tree, a third of the features tried
at a node, splits by variance, means as predictions. Spark keeps every row with its weights, four bytes a tree, and visits
rows one by one. Here a row is one byte a feature beside its label; its weights are drawn again from the same seeds in each
pass, and one pass a level adds up the sums of all open nodes of all trees over blocks of rows. The draws, and so the
trees, are others than Spark's. They depend on how the rows are stored, as Spark's do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..session import delete_folder, release_shuffles, scratch_folder

BINS = 32
BLOCK = 65_536       # rows of a block
POINTS = 4096        # a task keeps values of a feature by themselves up to here, then half as many ranks
# Weight of a 16-bit draw: the shares of a Poisson distribution of mean 1.
WEIGHTS = np.searchsorted(np.cumsum(np.exp(-1) / np.cumprod([1, 1, 2, 3, 4, 5, 6, 7])) * 65536, np.arange(65536), side="right").astype(np.uint8)


def _merged(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different values with their counts; of more than ``POINTS`` those at even ranks, each for its share."""
    values, at = np.unique(values, return_inverse=True)
    counts = np.bincount(at, counts, len(values))
    if len(values) > POINTS:
        upto, total = np.cumsum(counts), counts.sum()
        share = POINTS // 2
        return _merged(values[np.searchsorted(upto, (np.arange(share) + 0.5) * total / share)], np.full(share, total / share))
    return values, counts


def cuts(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Where a feature with these values is cut, as Spark does it: between all values if they are few, else at even ranks."""
    if len(values) <= BINS:
        return (values[1:] + values[:-1]) / 2
    stride, target, out = counts.sum() / BINS, counts.sum() / BINS, []
    upto = np.cumsum(counts).tolist()
    for i in range(1, len(values)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            out.append((values[i - 1] + values[i]) / 2)
            target += stride
    return np.array(out)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of ``BLOCK`` rows at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(len(x) for x in held) >= BLOCK:
            table = pa.Table.from_batches(held)
            full = len(table) // BLOCK * BLOCK
            for i in range(0, full, BLOCK):
                yield [c.to_numpy() for c in table.slice(i, BLOCK).columns]
            held = table.slice(full).combine_chunks().to_batches()
    if sum(len(x) for x in held):
        yield [c.to_numpy() for c in pa.Table.from_batches(held).columns]


def _thresholds(rows: DataFrame, n_features: int) -> list[np.ndarray]:
    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [(np.zeros(0), np.zeros(0))] * n_features
        for block in _blocks(batches):
            for f, column in enumerate(block[1:]):
                if np.isnan(column).any():
                    raise ValueError("a feature is not a number")
                values, counts = np.unique(column, return_counts=True)
                kept[f] = _merged(np.concatenate([kept[f][0], values]), np.concatenate([kept[f][1], counts]))
        for f, (values, counts) in enumerate(kept):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), f, np.int32)), pa.array(values), pa.array(counts.astype(float))], ["f", "v", "n"])

    def cut(table: pa.Table) -> pa.Table:
        values, at = np.unique(table["v"].to_numpy(), return_inverse=True)
        # Whole counts of values, or equal shares of ranks; sums in order of value and count are the same in any order of rows.
        order = np.lexsort((table["n"].to_numpy(), at))
        found = cuts(values, np.bincount(at[order], table["n"].to_numpy()[order], len(values)))
        return pa.table({"f": pa.array(np.full(len(found), table["f"][0].as_py(), np.int32)), "v": pa.array(found, pa.float64())})

    out: list[list[float]] = [[] for _ in range(n_features)]
    for r in rows.mapInArrow(ranks, "f int, v double, n double").groupBy("f").applyInArrow(cut, "f int, v double").collect():
        out[r["f"]].append(r["v"])
    return [np.array(sorted(x)) for x in out]


def _binned(rows: DataFrame, thresholds: list[np.ndarray], active: list[int], middle: float) -> DataFrame:
    """Blocks of rows: one byte for every active feature, feature by feature, and the labels less ``middle``."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for i, (label, *features) in enumerate(_blocks(batches)):
            bins = np.concatenate([np.searchsorted(thresholds[f], features[f], side="left").astype(np.uint8) for f in active])
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([i], pa.int32()), pa.array([bins.tobytes()], pa.binary()),
                                              pa.array([(label - middle).tobytes()], pa.binary())], ["part", "block", "bins", "label"])

    return rows.mapInArrow(pack, "part int, block int, bins binary, label binary")


@dataclass
class Forest:
    """Trees as arrays with the children of node ``i`` at ``2 i + 1`` and ``2 i + 2``; a node without a feature (-1) is a leaf."""
    thresholds: list[np.ndarray]   # of the active features
    active: list[int]
    feature: np.ndarray            # trees x nodes
    cut: np.ndarray                # bins up to this one go left
    value: np.ndarray              # mean of the label

    def predict(self, columns: list[np.ndarray]) -> np.ndarray:
        """Mean prediction of the trees for rows whose features are ``columns``."""
        n = len(columns[0]) if columns else 0
        bins = np.stack([np.searchsorted(t, columns[f], side="left") for t, f in zip(self.thresholds, self.active)]) if self.active else np.zeros((1, n), int)
        total, at = np.zeros(n), np.arange(n)
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(n, np.int64)
            for _ in range(int(np.log2(len(feature) + 1)) - 1):
                f = feature[node]
                node = np.where(f < 0, node, 2 * node + 1 + (bins[f, at] > cut[node]))
            total += value[node]
        return total / len(self.feature)

    def transform(self, frame: DataFrame, columns: list[str], name: str) -> DataFrame:
        names = [*frame.columns, name]
        places = [names.index(c) for c in columns]

        def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = self.predict([batch.column(i).cast(pa.float64()).to_numpy() for i in places])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names)

        return frame.mapInArrow(told, StructType([*frame.schema.fields, StructField(name, DoubleType())]))


def _sums(block: dict, seed: int, feature: np.ndarray, cut: np.ndarray, tried: list[np.ndarray], level: int, sums: list[np.ndarray]) -> None:
    """Add the weights and weighted labels of a block to ``sums``: of each tree by node of the level, feature tried and bin."""
    label, bins = np.frombuffer(block["label"]), np.frombuffer(block["bins"], np.uint8)
    n, first = len(label), 2 ** level - 1
    for tree in range(len(feature)):
        if not len(tried[tree]):
            continue
        draws = np.random.Generator(np.random.SFC64([seed, block["part"], block["block"], tree])).integers(0, 65536, n, np.uint16)
        weight = WEIGHTS.take(draws)
        rows = np.flatnonzero(weight)
        node = np.zeros(len(rows), np.int64)
        of, upto = feature[tree], cut[tree]
        start = np.maximum(of, 0) * n
        for depth in range(level):
            if depth and (of[2 ** depth - 1:2 ** (depth + 1) - 1] < 0).any():
                open_ = of.take(node) >= 0
                rows, node = rows[open_], node[open_]
            at = start.take(node)
            at += rows
            right = bins.take(at) > upto.take(node)
            node *= 2
            node += 1
            node += right
        slot = np.full(2 ** level, -1)
        slot[tried[tree][:, 0]] = np.arange(len(tried[tree]))
        place = slot.take(node - first)
        if (slot < 0).any():
            open_ = place >= 0
            rows, place = rows[open_], place[open_]
        w = weight.take(rows).astype(float)
        wy = w * label.take(rows)
        base, size = place * BINS, len(tried[tree]) * BINS
        for j in range(1, tried[tree].shape[1]):
            at = (np.maximum(tried[tree][:, j], 0) * n).take(place)
            at += rows
            key = bins.take(at).astype(np.int64)
            key += base
            sums[tree][j - 1, 0] += np.bincount(key, w, size)
            sums[tree][j - 1, 1] += np.bincount(key, wy, size)


def _best(tried: np.ndarray, sums: np.ndarray, ends: np.ndarray) -> list[tuple]:
    """Of every node: number, feature and cut (or -1), weight and sum of labels on the left and of all."""
    out = []
    for i, (node, *features) in enumerate(tried.tolist()):
        weight, total = sums[0, 0, i * BINS:(i + 1) * BINS].sum(), sums[0, 1, i * BINS:(i + 1) * BINS].sum()
        best = (node, -1, 0, 0.0, 0.0, float(weight), float(total))
        most = 0.0
        for j, f in enumerate(features):
            if f < 0:
                continue
            n, s = (np.cumsum(sums[j, k, i * BINS:i * BINS + ends[f]]) for k in (0, 1))
            fits = np.flatnonzero((n >= 1) & (weight - n >= 1))
            if len(fits):
                n, s = n[fits], s[fits]
                gain = s * s / n + (total - s) ** 2 / (weight - n) - total * total / weight
                k = int(np.argmax(gain))
                if gain[k] > most:
                    most, best = gain[k], (node, f, int(fits[k]), float(n[k]), float(s[k]), float(weight), float(total))
        out.append(best)
    return out


def fit(train: DataFrame, label: str, columns: list[str], trees: int, middle: float, depth: int = 6, seed: int = 42) -> Forest:
    """A forest over the rows of ``train``, none of which may be null; ``middle`` is about the mean of the label."""
    spark = train.sparkSession
    folders = [scratch_folder(spark) for _ in range(2)]
    train.select(F.col(label).cast("double"), *[F.col(c).cast("double") for c in columns]).write.option("compression", "zstd").parquet(folders[0])
    rows = spark.read.parquet(folders[0])
    release_shuffles(rows)
    thresholds = _thresholds(rows, len(columns))
    active = [f for f, t in enumerate(thresholds) if len(t)]
    _binned(rows, thresholds, active, middle).write.option("compression", "zstd").parquet(folders[1])
    delete_folder(spark, folders[0])
    blocks = spark.read.parquet(folders[1])
    ends = np.array([len(thresholds[f]) for f in active], np.int64)
    number = {f: i for i, f in enumerate(active)}
    feature, cut = np.full((trees, 2 ** (depth + 1) - 1), -1), np.zeros((trees, 2 ** (depth + 1) - 1), np.uint8)
    value = np.full(feature.shape, float(middle))
    open_ = [[0] for _ in range(trees)]
    for level in range(depth):
        first, tried = 2 ** level - 1, []
        for tree, nodes in enumerate(open_):
            own = [[node - first, *(number.get(int(f), -1) for f in np.random.default_rng([seed, tree, node]).choice(len(columns), ceil(len(columns) / 3) if trees > 1 else len(columns), False))]
                   for node in nodes]
            tried.append(np.array([x for x in own if level == 0 or max(x[1:]) >= 0], np.int64).reshape(-1, len(own[0]) if own else 1))
        if not any(len(x) for x in tried):
            break

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            sums = [np.zeros((max(x.shape[1] - 1, 0), 2, len(x) * BINS)) for x in tried]
            for batch in batches:
                for i in range(len(batch)):
                    _sums(batch.slice(i, 1).to_pylist()[0], seed, feature, cut, tried, level, sums)
            for tree, own in enumerate(sums):
                if own.size:
                    yield pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), pa.array([part], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["tree", "part", "sums"])

        def decide(table: pa.Table) -> pa.Table:
            tree, shape = table["tree"][0].as_py(), tried[table["tree"][0].as_py()].shape
            total = np.zeros((shape[1] - 1, 2, shape[0] * BINS))
            for _, own in sorted(zip(table["part"].to_pylist(), table["sums"].to_pylist())):
                total += np.frombuffer(own).reshape(total.shape)
            found = list(zip(*_best(tried[tree], total, ends)))
            return pa.table([pa.array([tree] * shape[0], pa.int32()), *(pa.array(x, pa.int32()) for x in found[:3]), *(pa.array(x, pa.float64()) for x in found[3:])],
                            ["tree", "node", "feature", "cut", "n", "s", "weight", "total"])

        chosen = blocks.mapInArrow(add_up, "tree int, part int, sums binary").groupBy("tree") \
            .applyInArrow(decide, "tree int, node int, feature int, cut int, n double, s double, weight double, total double").collect()
        open_ = [[] for _ in range(trees)]
        for r in sorted(chosen, key=lambda r: (r["tree"], r["node"])):
            tree, node = r["tree"], r["node"] + first
            if level == 0 and r["weight"]:
                value[tree, 0] = middle + r["total"] / r["weight"]
            if r["feature"] >= 0:
                feature[tree, node], cut[tree, node] = r["feature"], r["cut"]
                value[tree, 2 * node + 1] = middle + r["s"] / r["n"]
                value[tree, 2 * node + 2] = middle + (r["total"] - r["s"]) / (r["weight"] - r["n"])
                open_[tree] += [2 * node + 1, 2 * node + 2]
        release_shuffles(blocks)
    delete_folder(spark, folders[1])
    return Forest([thresholds[f] for f in active], active, feature, cut, value)
