"""Whitening of embeddings: principal components of the whole table, each scaled to variance one.

Entries become whole numbers ``x = floor(scale * c) + shift``, so sums and products are exact: the sums of ``x`` give a whole
number near each mean, products of the numbers centred there are summed as whole numbers (float64 products of short runs
of rows, each sum below 2 ** 53), and the covariance is one exact fraction per entry, the same for every partitioning.

**Eigenvectors.** A float32 solver gives a first set. Ogita-Aishima iterations correct it by matrix products in extended
precision: with ``R = I - X'X`` and ``S = X'AX``, the eigenvalues are ``s_ii / (1 - r_ii)`` and ``X + XE`` takes
``e_ij = (s_ij + l_j r_ij) / (l_j - l_i)`` where two eigenvalues are told apart, else ``r_ij / 2``. Eigenvalues that are not told
apart form a cluster, whose block ``X_k'(A - mI)X_k``, scaled by its own size, is solved anew and turns these columns; so
each round tells apart what the one before could not. Equal eigenvalues keep any orthonormal vectors.

Defined results: vectors that are null, empty, of another length than the most frequent one, or that hold null or
non-finite entries or ones of ``LARGEST`` or more in size take no part. Rows that repeat an id, and rows with a null id, are rows like
others. Components without variance (constant dimensions, fewer rows than dimensions) cannot be scaled and are
not given, so equal vectors give no components. A deviation too large for a long is null. Input columns keep their
names; new ones that would clash get underscores in front. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .neighbours import matrix
from .stores import free_names

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
LARGEST = float(1 << 40)
LEAST_SHARE = 1e-15     # of the largest eigenvalue: less counts as no variance
ROUNDS = 40


def usable(vector: str, width: int | None = None) -> Column:
    fit = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < LARGEST))
    return fit if width is None else fit & (F.size(vector) == width)


def refined(exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix of extended precision."""
    n = len(exact)
    size = np.abs(exact).max() if n else 0
    if not size:
        return np.zeros(n, exact.dtype), np.eye(n, dtype=exact.dtype)
    a = exact / size
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(exact.dtype)
    whole = np.sqrt((a * a).sum())
    eye = np.eye(n, dtype=exact.dtype)
    noise = 4 * n * whole * np.finfo(exact.dtype).eps
    for _ in range(ROUNDS):
        r = eye - x.T @ x
        s = x.T @ (a @ x)
        s = (s + s.T) / 2      # rounding that differs across the diagonal would tilt vectors of close eigenvalues
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        apart = 2 * (np.sqrt((off * off).sum()) + whole * np.sqrt((r * r).sum()))
        gap = values[None, :] - values[:, None]
        told = np.abs(gap) > apart
        e = np.where(told, (s + values[None, :] * r) / np.where(told, gap, 1), r / 2)
        x = x + x @ e
        if (np.abs(e) < 1e-15 + np.where(told, noise / np.where(told, np.abs(gap), 1), 0)).all():
            break
        order = np.argsort(-values, kind="stable")
        x, values = x[:, order], values[order]
        edges = np.flatnonzero(values[:-1] - values[1:] > apart) + 1
        for cluster in np.split(np.arange(n), edges):
            if len(cluster) > 1:
                part = x[:, cluster]
                block = part.T @ (a @ part) - values[cluster].mean() * (part.T @ part)
                top = np.abs(block).max()
                if top:
                    block = (block / top).astype(np.float64)
                    x[:, cluster] = part @ np.linalg.eigh((block + block.T) / 2)[1][:, ::-1]
    for _ in range(2):
        x = x + x @ (eye - x.T @ x) / 2
    x = x / np.sqrt((x * x).sum(axis=0))
    values = (x * (a @ x)).sum(axis=0) * size
    order = np.argsort(-values, kind="stable")
    x = x[:, order]
    return values[order], x * np.where(x[np.abs(x).argmax(axis=0), np.arange(n)] < 0, -1, 1)


class Products:
    """Exact sums of ``y' y`` over batches of whole numbers held as doubles."""

    def __init__(self, width: int):
        self.total, self.bound = np.zeros((width, width), np.int64), 0

    def add(self, y: np.ndarray) -> None:
        top = int(np.abs(y).max()) if y.size else 0
        self.bound += len(y) * top * top
        if self.bound >= 1 << 62:
            self.total = self.total.astype(object)
        if top > 1 << 24:
            z = y.astype(np.int64).astype(object)
            self.total = self.total.astype(object) + z.T @ z
            return
        run = max(1, (1 << 53) // max(top * top, 1))
        for at in range(0, len(y), run):
            self.total = self.total + (y[at:at + run].T @ y[at:at + run]).astype(np.int64)


@dataclass
class Whitening:
    """A fitted transformation: ``rows`` fitted on, exact sums, and the kept components."""

    rows: int
    sums: list[int]              # of x by dimension
    pivot: np.ndarray            # whole numbers near the means of floor(scale * c)
    values: np.ndarray           # eigenvalues of the kept components, falling
    vectors: np.ndarray          # their unit eigenvectors, as columns
    explained: np.ndarray        # shares of the trace
    scale: int = SCALE

    @property
    def width(self) -> int:
        return len(self.sums)

    def centred(self, column: pa.Array) -> np.ndarray:
        """Whole numbers less their pivot, exact doubles."""
        return np.floor(matrix(column) * self.scale) - self.pivot


def fit(rows: DataFrame, vector: str = "embedding", scale: int = SCALE, shift: int = SHIFT, components: int = COMPONENTS) -> Whitening | None:
    """Means, exact covariance and refined components of all usable vectors; None if there is none.

    To the driver come one row per dimension and one per pair of dimensions.
    """
    width = rows.where(usable(vector)).groupBy(F.size(vector).alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    if not width:
        return None
    width, n = width[0]["n"], width[0]["c"]
    points = rows.where(usable(vector, width)).select(F.col(vector).cast("array<double>").alias("v"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, object)
        for batch in batches:
            total = total + np.floor(matrix(batch.column(0)) * scale).astype(np.int64).astype(object).sum(axis=0) if len(batch) else total
        yield _entries(range(width), [0] * width, total)

    found = _summed(points.mapInArrow(sums, ENTRIES))
    plain = [found.get((i, 0), 0) for i in range(width)]
    pivot = np.array([round(t / n) for t in plain], np.float64)
    rest = [t - n * int(p) for t, p in zip(plain, pivot, strict=True)]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Products(width)
        for batch in batches:
            sums.add(np.floor(matrix(batch.column(0)) * scale) - pivot if len(batch) else np.zeros((0, width)))
        i, j = np.tril_indices(width)
        yield _entries(i, j, sums.total[i, j])

    moments = _summed(points.mapInArrow(products, ENTRIES))
    exact = np.zeros((width, width), np.longdouble)
    for (i, j), value in moments.items():
        exact[i, j] = exact[j, i] = np.longdouble(str(n * value - rest[i] * rest[j])) / np.longdouble(str(n * n))
    values, vectors = refined(exact)
    trace = np.trace(exact)
    kept = int((values[:components] > values[0] * LEAST_SHARE).sum()) if width and values[0] > 0 else 0
    share = values[:kept] / trace if kept else values[:0]
    return Whitening(n, [t + n * shift for t in plain], pivot, values[:kept].astype(np.float64), vectors[:, :kept].astype(np.float64), share.astype(np.float64), scale)


ENTRIES = "i int, j int, value decimal(38,0)"


def _entries(i, j, values) -> pa.RecordBatch:
    exact = pa.array([Decimal(int(x)) for x in values], pa.decimal128(38, 0))
    return pa.RecordBatch.from_arrays([pa.array(list(i), pa.int32()), pa.array(list(j), pa.int32()), exact], ["i", "j", "value"])


def _summed(entries: DataFrame) -> dict[tuple[int, int], int]:
    """Exact sums by cell; their number is bounded by the dimensions."""
    found = entries.groupBy("i", "j").agg(F.sum("value").alias("value")).toArrow().to_pydict()
    return {(i, j): int(x) for i, j, x in zip(found["i"], found["j"], found["value"], strict=True)}


def whiten(rows: DataFrame, net: Whitening, vector: str = "embedding", shift: int = SHIFT) -> DataFrame:
    """Usable rows with ``whitened`` (array of doubles, one per component) and ``deviation`` (exact sum of ``(n x - S) ** 2``, null beyond a long)."""
    white, off = free_names(rows.columns, "whitened", "deviation")
    n = net.rows
    left = [s - n * (int(p) + shift) for s, p in zip(net.sums, net.pivot, strict=True)]   # sums of the centred numbers
    rest = np.array([t / n for t in left])
    far = max([abs(t) for t in left], default=0)
    turn = net.vectors / np.sqrt(net.values)
    given = rows.where(usable(vector, net.width))
    names = given.columns
    spot = names.index(vector)

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            y = net.centred(batch.column(spot))
            z = (y - rest) @ turn
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel()))
            most = n * int(np.abs(y).max()) + far
            whole = y.astype(np.int64)
            if net.width * most * most < 1 << 62:
                d = ((n * whole - np.array(left, np.int64)) ** 2).sum(axis=1).tolist()
            else:
                d = [int(t) for t in ((n * whole.astype(object) - np.array(left, object)) ** 2).sum(axis=1)]
            d = pa.array([t if t < 1 << 63 else None for t in d], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, d], [*names, white, off])

    kinds = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in given.schema)
    return given.mapInArrow(turned, f"{kinds}, `{white}` array<double>, `{off}` long")


def identity_error(whitened: DataFrame, column: str, components: int, n: int) -> float:
    """Largest entry, in size, of the covariance of ``column`` (arrays of ``components`` doubles, ``n`` rows) less the identity."""
    if not components:
        return 0.0

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((components + 1, components))
        for batch in batches:
            if len(batch):
                z = matrix(batch.column(0))
                total[1:] += z.T @ z
                total[0] += z.sum(axis=0)
        i, j = np.indices(total.shape).reshape(2, -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "value"])

    found = whitened.select(column).mapInArrow(moments, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).toArrow()
    total = np.zeros((components + 1, components))
    total[found["i"].to_numpy(), found["j"].to_numpy()] = found["value"].to_numpy()
    mean = total[0] / n   # zero but for rounding, so the products were centred ones
    return float(np.abs(total[1:] / n - np.outer(mean, mean) - np.eye(components)).max())
