"""Correlation and mutual information, and the feature choices made from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import correlation

PAIRS_AT_ONCE = 100   # terms of one aggregate
SPREAD_NOISE = 1e-12   # spread relative to the size of the values below which a column counts as constant


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise Pearson correlations in long form (left before right in the given order).

    Rows where either value is missing are left out per pair. All correlations are terms of one aggregate over the rows, or of one for every
    ``PAIRS_AT_ONCE`` pairs. A pair with a constant column, within rounding, has no correlation.
    """
    columns = list(columns)
    schema = "left string, right string, i int, j int, corr double"
    numbers = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"c{k}") for k, c in enumerate(columns)])
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    out = None
    for at in range(0, len(pairs), PAIRS_AT_ONCE):
        part = pairs[at:at + PAIRS_AT_ONCE]
        varied = {k: F.var_pop(f"c{k}") > F.pow(F.lit(SPREAD_NOISE) * F.avg(f"c{k}"), F.lit(2.0)) for k in {k for pair in part for k in pair}}
        cells = [F.struct(F.lit(columns[i]).alias("left"), F.lit(columns[j]).alias("right"), F.lit(i).alias("i"), F.lit(j).alias("j"),
                          F.when(varied[i] & varied[j], correlation(F.col(f"c{i}"), F.col(f"c{j}"))).alias("corr")) for i, j in part]  # noqa: B023
        found = numbers.agg(F.array(*cells).alias("_c")).select(F.inline("_c"))
        out = found if out is None else out.unionAll(found)
    return df.sparkSession.createDataFrame([], schema) if out is None else out


def target_correlations(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """Correlation of every column with the target, one row each, from one pass; NULL where one of the two does not vary."""
    y = F.col(target).cast("double")
    cells = [F.struct(F.lit(c).alias("feature"), correlation(F.col(c).cast("double"), y).alias("corr"),
                      F.count_if(F.col(c).isNotNull() & y.isNotNull()).alias("n"))
             for c in columns]
    return df.agg(F.array(*cells).alias("_c")).select(F.inline("_c"))


def weak_features(df: DataFrame, target: str, columns: Sequence[str], limit: float = 0.01) -> list[str]:
    """Columns whose correlation with the target is below the limit; undefined ones are kept."""
    rows = target_correlations(df, target, columns).where(F.abs("corr") < limit).select("feature").collect()
    found = {r["feature"] for r in rows}
    return [c for c in columns if c in found]


def target_proxies(df: DataFrame, target: str, columns: Sequence[str], limit: float = 0.90) -> list[str]:
    rows = target_correlations(df, target, columns).where(F.abs("corr") >= limit).select("feature").collect()
    found = {r["feature"] for r in rows}
    return [c for c in columns if c in found]


def redundant_features(df: DataFrame, columns: Sequence[str], limit: float = 0.90) -> list[str]:
    """Columns that correlate above the limit with an earlier column."""
    rows = correlation_pairs(df, columns).where(F.abs("corr") > limit).select("right").distinct().collect()
    found = {r["right"] for r in rows}
    return [c for c in columns if c in found]


def leaking_correlations(df: DataFrame, target: str, columns: Sequence[str], limit: float = 0.99) -> DataFrame:
    """Columns so close to the target that they must have been derived from it; needs three rows."""
    return target_correlations(df, target, columns).where((F.abs("corr") >= limit) & (F.col("n") >= 3)).drop("n")


def mutual_information(df: DataFrame, target: str, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """Mutual information of each binned column with a class target, in nats.

    Columns are cut into equal-width bins between their extremes; the long table of (column, bin,
    class) counts is folded on the map side, so its size does not depend on the rows.
    """
    from .scale import one_row, with_scalars

    ends = one_row(df, *[F.min(F.col(c).cast("double")).alias(f"_lo_{c}") for c in columns],
                   *[F.max(F.col(c).cast("double")).alias(f"_hi_{c}") for c in columns])

    def place(c):
        low, high = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        step = (F.col(c).cast("double") - low) / F.when(high > low, high - low).otherwise(F.lit(1.0))
        return F.least(F.floor(step * bins), F.lit(bins - 1)).cast("int")

    rows = with_scalars(df.where(F.col(target).isNotNull()), ends)
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), place(c).alias("bin")) for c in columns])
    counts = rows.select(F.col(target).cast("string").alias("_y"), F.inline(cells)).where("bin IS NOT NULL") \
        .groupBy("feature", "bin", "_y").agg(F.count("*").cast("double").alias("_n"))
    # From here on the table has bins x classes rows per feature.
    total = F.sum("_n").over(Window.partitionBy("feature"))
    by_bin = F.sum("_n").over(Window.partitionBy("feature", "bin"))
    by_class = F.sum("_n").over(Window.partitionBy("feature", "_y"))
    part = F.col("_n") / total * F.log(F.col("_n") * total / (by_bin * by_class))
    return counts.select("feature", part.alias("_p")).groupBy("feature").agg(F.sum("_p").alias("mutual_information"))


def correlated_regressors(df: DataFrame, target: str, columns: Sequence[str], limit: float = 0.05) -> list[str]:
    """Regressors worth feeding to a lagged model: those that move with the target."""
    rows = target_correlations(df, target, columns).where(F.abs("corr") >= limit).select("feature").collect()
    found = {r["feature"] for r in rows}
    return [c for c in columns if c in found]
