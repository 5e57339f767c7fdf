"""Least squares with an absolute-value penalty, solved on the moments of one aggregate.

The data are read once: means and co-moments of all pairs of columns. The descent then runs on that small matrix, so it is
deterministic, needs no further pass, and can be checked by its optimality conditions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Moments:
    """Population covariances of features with each other (``gram``) and with the target (``cross``)."""

    features: tuple[str, ...]
    rows: int
    means: np.ndarray
    target_mean: float
    gram: np.ndarray
    cross: np.ndarray


def moments(df: DataFrame, target: str, features: Sequence[str]) -> Moments:
    """Rows with a gap in any of the columns are left out."""
    features = list(features)
    number = {c: F.col(c).cast("double") for c in [*features, target]}
    rows = df.select(*[F.nanvl(v, F.lit(None).cast("double")).alias(c) for c, v in number.items()]).dropna()
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    sums = rows.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in [*features, target]],
                    *[F.covar_pop(features[i], features[j]).alias(f"g{i}_{j}") for i, j in pairs], *[F.covar_pop(f, target).alias(f"x{i}") for i, f in enumerate(features)]).first()
    gram = np.zeros((len(features), len(features)))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = sums[f"g{i}_{j}"] or 0.0
    return Moments(tuple(features), sums["n"], np.array([sums[f"m_{c}"] or 0.0 for c in features]), sums[f"m_{target}"] or 0.0, gram,
                   np.array([sums[f"x{i}"] or 0.0 for i in range(len(features))]))


def descend(m: Moments, penalty: float, sweeps: int = 10_000, tolerance: float = 1e-13) -> np.ndarray:
    """Coefficients that minimise half the mean squared error plus ``penalty`` times the sum of their sizes.

    Coordinates are taken in the order of the features; a feature without variance keeps coefficient 0.
    """
    w = np.zeros(len(m.features))
    scale = np.sqrt(np.maximum(np.diag(m.gram), 0))
    for _ in range(sweeps):
        moved = 0.0
        for j in np.flatnonzero(np.diag(m.gram) > 0):
            pull = m.cross[j] - m.gram[j] @ w + m.gram[j, j] * w[j]
            new = np.sign(pull) * max(abs(pull) - penalty, 0.0) / m.gram[j, j]
            moved = max(moved, abs(new - w[j]) * scale[j])
            w[j] = new
        if moved <= tolerance:
            break
    return w


def slack(m: Moments, w: np.ndarray, penalty: float) -> float:
    """How far the optimality conditions are missed: 0 at the minimum.

    The gradient of the error is the penalty's size with the coefficient's sign where there is a coefficient, and not larger elsewhere.
    """
    gradient = m.cross - m.gram @ w
    varied = np.diag(m.gram) > 0
    miss = np.where(w != 0, np.abs(gradient - penalty * np.sign(w)), np.maximum(np.abs(gradient) - penalty, 0.0))
    return float(np.max(miss[varied], initial=0.0))


def penalised(df: DataFrame, target: str, features: Sequence[str], penalty: float = 0.2) -> dict[str, float]:
    m = moments(df, target, features)
    return dict(zip(m.features, map(float, descend(m, penalty)), strict=True))
