"""Clusters of one number, without random starts.

Values are folded into cells of equal width between their extremes; each cell keeps its exact count, sum and sum of squares. Over the
cells that hold rows, dynamic programming finds the cuts with the smallest sum of squared distances to the cluster means, so
the result is the optimum over all cuts between cells and the same on every run. The table of cells is
bounded by their number, whatever the number of rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scale import one_row, with_scalars

CELLS = 512


def _cell(value: Column, low: Column, high: Column, cells: int) -> Column:
    place = F.floor((value - low) / F.when(high > low, high - low).otherwise(F.lit(1.0)) * cells)
    return F.least(place, F.lit(cells - 1)).cast("int")


def best_cuts(count: np.ndarray, total: np.ndarray, square: np.ndarray, k: int) -> list[int]:
    """First cell of each cluster but the first; fewer than ``k`` cells are a cluster each. Ties take the earliest cut."""
    n = len(count)
    if n <= k:
        return list(range(1, n))
    c, s, q = (np.concatenate([[0.0], np.cumsum(x)]) for x in (count, total, square))

    def cost(begin, end):
        """Of cells ``begin`` to ``end - 1`` as one cluster, for an array of begins."""
        return np.maximum(q[end] - q[begin] - (s[end] - s[begin]) ** 2 / (c[end] - c[begin]), 0.0)

    best = np.array([np.inf, *[cost(np.array([0]), e)[0] for e in range(1, n + 1)]])
    choices = []
    for layer in range(2, k + 1):
        new, pick = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        for end in range(layer, n + 1):
            begins = np.arange(layer - 1, end)
            options = best[begins] + cost(begins, end)
            pick[end] = begins[options.argmin()]
            new[end] = options.min()
        choices.append(pick)
        best = new
    cuts, end = [], n
    for pick in reversed(choices):
        end = int(pick[end])
        cuts.append(end)
    return cuts[::-1]


def clustered(df: DataFrame, column: str, k: int = 5, cells: int = CELLS, name: str = "cluster") -> DataFrame:
    """``df`` without rows that lack ``column``, plus the cluster from 0, in ascending order of the values."""
    number = F.col(column).cast("double")
    rows = df.where(number.isNotNull() & ~F.isnan(number))
    ends = one_row(rows, F.min(number).alias("_low"), F.max(number).alias("_high"))
    placed = with_scalars(rows, ends).withColumn("_cell", _cell(number, F.col("_low"), F.col("_high"), cells))
    # Centred on the middle of the range, so that squares keep their digits.
    middle = (F.col("_low") + F.col("_high")) / 2
    folded = placed.groupBy("_cell").agg(F.count("*").alias("n"), F.sum(number - middle).alias("s"), F.sum((number - middle) * (number - middle)).alias("q")) \
        .orderBy("_cell").toPandas()   # at most ``cells`` rows
    cuts = best_cuts(folded["n"].to_numpy(float), folded["s"].to_numpy(float), folded["q"].to_numpy(float), k)
    first = [int(folded["_cell"][c]) for c in cuts]
    cluster = F.lit(0)
    for cell in first:
        cluster = cluster + (F.col("_cell") >= F.lit(cell)).cast("int")
    return placed.withColumn(name, cluster.cast("int")).select(*df.columns, name)
