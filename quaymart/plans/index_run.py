"""Index per feature category: score, link to the outcome, and what an improvement would take."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import correlation
from ..operators.index_score import Goal, improvement_targets


def category_run(scored: DataFrame, score_columns: Mapping[str, str], outcome: str, value: str, feature_counts: Mapping[str, int],
                 goal: Goal, min_features: int = 2) -> DataFrame:
    """One row per category from one pass over the scored rows.

    ``outcome`` is the class the index is correlated with, ``value`` the continuous outcome the
    targets refer to. Categories with fewer than ``min_features`` features are marked as skipped.
    """
    y, v = F.col(outcome).cast("double"), F.col(value).cast("double")
    cells = []
    for k, c in score_columns.items():
        x = F.col(c).cast("double")
        cells.append(F.struct(
            F.lit(k).alias("category"), F.lit(int(feature_counts[k])).alias("feature_count"), F.count(x).alias("row_count"),
            correlation(x, y).alias("target_correlation"), F.regr_slope(v, x).alias("_slope"), F.regr_intercept(v, x).alias("_icept"),
            F.avg(v).alias("current_outcome"), F.avg(x).alias("current_score"), F.min(x).alias("score_min"), F.max(x).alias("score_max")))
    rows = scored.agg(F.array(*cells).alias("_a")).select(F.inline("_a"))
    lines = rows.withColumns({"slope": F.coalesce(F.nanvl("_slope", F.lit(0.0)), F.lit(0.0)), "intercept": F.coalesce("_icept", "current_outcome")})
    targets = improvement_targets(lines, goal, ["category"])
    goals = targets.select("category", *[F.col(f"{t}_score") for t in ("immediate", "midterm", "longterm")])
    out = lines.join(F.broadcast(goals), "category")
    gap = lambda t: F.round(F.col(f"{t}_score") - F.col("current_score"), 4).alias(f"gap_{t}")
    return out.select("category", "feature_count", "row_count", "current_score", "target_correlation", "slope", "current_outcome",
                      "immediate_score", "midterm_score", "longterm_score", gap("immediate"), gap("midterm"), gap("longterm"),
                      F.when(F.col("feature_count") < min_features, "skipped").otherwise("completed").alias("status"))
