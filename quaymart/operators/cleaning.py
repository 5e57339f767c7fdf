"""Imputation, outliers, scaling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clip
from .columns import is_numeric
from .scale import column_quantiles, exact_quantiles, one_row, with_scalars


def column_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls, mean, skewness (with the small-sample correction) and distinct extremes, one row per column."""
    cells = []
    for c in columns:
        numeric = is_numeric(df, c)
        v = F.col(c).cast("double") if numeric else F.lit(None).cast("double")
        n = F.count(v)
        adjust = F.when(n > 2, F.sqrt(n * (n - 1.0)) / (n - 2.0))
        cells.append(F.struct(
            F.lit(c).alias("column"), F.lit(int(numeric)).alias("is_numeric"), F.count("*").alias("n_rows"),
            F.count_if(F.col(c).isNull()).alias("nulls"), F.avg(v).alias("mean_value"), (F.skewness(v) * adjust).alias("skew"),
            F.min(v).alias("min_value"), F.max(v).alias("max_value")))
    return df.agg(F.array(*cells).alias("_a")).select(F.inline("_a"))


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Most frequent value per text column; ties by value. One pass over (column, value) counts."""
    if not columns:
        return {}
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    counts = df.select(F.inline(cells)).where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))
    best = counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"))
    return {r["column"]: r["value"] for r in best.collect()}


@dataclass(frozen=True)
class Imputation:
    """What to do per column: names to drop and values to fill."""
    dropped: list[str]
    fills: dict[str, object]

    def apply(self, df: DataFrame) -> DataFrame:
        kept = df.drop(*self.dropped)
        return kept.select(*[F.coalesce(F.col(c), F.lit(self.fills[c]).cast(t)).alias(c) if c in self.fills else F.col(c)
                             for c, t in self._typed(kept)])

    def _typed(self, df):
        # A whole-number column filled with a mean becomes fractional.
        return [(c, "double" if c in self.fills and isinstance(self.fills[c], float) else t) for c, t in df.dtypes]


def imputation(df: DataFrame, protected: Sequence[str] = (), drop_above: float = 0.80, skew_limit: float = 0.5,
               always_mean: bool = False) -> Imputation:
    """Columns with too many nulls go; texts take the mode, numbers the median if skewed, else the mean."""
    columns = [c for c in df.columns if c not in protected]
    stats = {r["column"]: r for r in column_stats(df, columns).collect()}
    dropped = [c for c in columns if stats[c]["n_rows"] and stats[c]["nulls"] / stats[c]["n_rows"] > drop_above]
    open_columns = [c for c in columns if c not in dropped and stats[c]["nulls"] > 0]
    fills: dict[str, object] = dict(modes(df, [c for c in open_columns if not stats[c]["is_numeric"]]))
    def is_skewed(c):
        s = stats[c]
        varied = s["min_value"] is not None and s["min_value"] != s["max_value"]
        return not always_mean and varied and s["skew"] is not None and abs(s["skew"]) > skew_limit

    numeric = [c for c in open_columns if stats[c]["is_numeric"]]
    skewed = [c for c in numeric if is_skewed(c)]
    medians = {r["column"]: r["m"] for r in column_quantiles(df, skewed, {"m": 0.5}).collect()} if skewed else {}
    for c in numeric:
        value = medians.get(c, stats[c]["mean_value"])
        if value is not None:
            fills[c] = float(value)
    return Imputation(dropped, fills)


def outlier_bounds(df: DataFrame, columns: Sequence[str], limit: float = 0.5, z: float = 3.0) -> DataFrame:
    """Bounds per column: mean +- 3 deviations for steady columns, the same on a shifted log scale
    for heavy-tailed ones. Columns with fewer than three values or only two distinct ones get none."""
    def values(c):
        v = F.col(c).cast("double")
        return F.when(~F.isnan(v), v)

    first = df.agg(*[e.alias(n) for c in columns for n, e in {
        f"n_{c}": F.count(values(c)), f"mean_{c}": F.avg(values(c)), f"std_{c}": F.stddev_samp(values(c)),
        f"lo_{c}": F.min(values(c)), f"hi_{c}": F.max(values(c))}.items()])
    offset = lambda c: F.when(F.col(f"lo_{c}") <= 0, F.abs(F.col(f"lo_{c}")) + 1.0).otherwise(F.lit(0.0))
    rows = with_scalars(df.select(*[values(c).alias(c) for c in columns]),
                        first.select(*[F.col(f"lo_{c}") for c in columns], *[F.col(f"hi_{c}") for c in columns]))
    logs = rows.agg(*[e.alias(n) for c in columns for n, e in {
        f"lmean_{c}": F.avg(F.log(F.col(c) + offset(c) + 1.0)), f"lstd_{c}": F.stddev_samp(F.log(F.col(c) + offset(c) + 1.0)),
        # A third distinct value is one that is neither the smallest nor the largest.
        f"more_{c}": F.max(((F.col(c) > F.col(f"lo_{c}")) & (F.col(c) < F.col(f"hi_{c}"))).cast("int"))}.items()])
    both = with_scalars(first, logs)
    cells = []
    for c in columns:
        mean, std = F.col(f"mean_{c}"), F.col(f"std_{c}")
        ratio = F.when(F.abs(mean) >= 1e-9, std / F.abs(mean))
        heavy = ratio.isNull() | (ratio >= limit)
        back = lambda sign: F.exp(F.col(f"lmean_{c}") + F.lit(sign * z) * F.col(f"lstd_{c}")) - offset(c) - 1.0
        used = (F.col(f"n_{c}") >= 3) & (F.col(f"more_{c}") == 1)
        cells.append(F.struct(
            F.lit(c).alias("column"), ratio.alias("variation"),
            F.when(~used, "skipped").when(heavy, "log z-score").otherwise("3 deviations").alias("method"),
            F.when(used, F.when(heavy, back(-1)).otherwise(mean - z * std)).alias("lower"),
            F.when(used, F.when(heavy, back(1)).otherwise(mean + z * std)).alias("upper")))
    return both.select(F.inline(F.array(*cells)))


def without_outliers(df: DataFrame, columns: Sequence[str], mode: str = "single_pass",
                     report: list | None = None) -> DataFrame:
    """Drop rows outside the bounds, then clamp the rest to the 1st and 99th percentile.

    ``sequential`` goes column by column, each on the rows the earlier ones left, as the rule is
    defined. ``single_pass`` takes all bounds from the input and filters once. ``report`` receives one entry per column.
    """
    if not columns:
        return df
    if mode == "single_pass":
        bounds = outlier_bounds(df, columns).where("method <> 'skipped'").collect()
        keep = F.lit(True)
        for b in bounds:
            keep = keep & F.coalesce(F.col(b["column"]).cast("double").between(b["lower"], b["upper"]), F.lit(True))
        flags = [F.count_if(~F.coalesce(F.col(b["column"]).cast("double").between(b["lower"], b["upper"]), F.lit(True))).alias(b["column"]) for b in bounds]
        if report is not None and bounds:
            counts = df.agg(*flags).first()
            report.extend({**b.asDict(), "flagged": counts[b["column"]]} for b in bounds)
        return winsorised(df.where(keep), [b["column"] for b in bounds])
    out = df
    for c in columns:
        bound = outlier_bounds(out, [c]).first()
        if bound["method"] == "skipped":
            continue
        inside = F.coalesce(F.col(c).cast("double").between(bound["lower"], bound["upper"]), F.lit(True))
        if report is not None:
            counts = out.agg(F.count("*").alias("n"), F.count_if(~inside).alias("flagged")).first()
            report.append({**bound.asDict(), "flagged": counts["flagged"], "rows_before": counts["n"]})
        out = out.where(inside)
        # Two numbers come back, so the plan stays a chain of filters and projections over the input.
        marks = exact_quantiles(out, c, {"low": 0.01, "high": 0.99}).first()
        out = out.withColumn(c, clip(F.col(c).cast("double"), marks["low"], marks["high"]))
    return out


def winsorised(df: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Clamp columns to two of their own quantiles; no row is lost."""
    if not columns:
        return df
    marks = column_quantiles(df, columns, {"lo": low, "hi": high})
    row = marks.agg(*[F.max(F.when(F.col("column") == c, F.col(side))).alias(f"_{side}_{c}") for c in columns for side in ("lo", "hi")])
    rows = with_scalars(df, row)
    inside = {c: F.greatest(F.least(F.col(c).cast("double"), F.col(f"_hi_{c}")), F.col(f"_lo_{c}")) for c in columns}
    return rows.select(*[F.when(F.col(c).isNotNull(), inside[c]).alias(c) if c in inside else F.col(c) for c in df.columns])


def min_max_scaled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scale to [0, 1]; columns with at most two distinct values stay, constant ones become 0.

    With extremes ``lo`` and ``hi``, a third value exists exactly if some value lies between them.
    """
    ends = one_row(df, *[F.min(F.col(c).cast("double")).alias(f"_lo_{c}") for c in columns],
                   *[F.max(F.col(c).cast("double")).alias(f"_hi_{c}") for c in columns])
    rows = with_scalars(df, ends)
    value = lambda c: F.col(c).cast("double")
    wide = with_scalars(df.select(*columns), ends).agg(*[
        F.coalesce(F.max(((value(c) > F.col(f"_lo_{c}")) & (value(c) < F.col(f"_hi_{c}"))).cast("int")), F.lit(0)).alias(f"_w_{c}") for c in columns])
    rows = with_scalars(rows, wide)
    scaled = {c: F.when(F.col(f"_w_{c}") == 0, value(c))
              .otherwise((value(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}"))) for c in columns}
    return rows.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])


def z_scored(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Centre and scale by the population deviation (1 where it is 0)."""
    moments = one_row(df, *[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(F.col(c).cast("double")).alias(f"_s_{c}") for c in columns])
    rows = with_scalars(df, moments)
    def scaled(c: str) -> Column:
        spread = F.when(F.col(f"_s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_s_{c}"))
        return (F.col(c).cast("double") - F.col(f"_m_{c}")) / spread
    return rows.select(*[scaled(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def z_restored(df: DataFrame, column: str, mean: float, std: float) -> DataFrame:
    return df.withColumn(column, F.col(column) * F.lit(std if std else 1.0) + F.lit(mean))


def filled_with_medians(df: DataFrame, columns: Sequence[str], medians: Mapping[str, float] | None = None) -> tuple[DataFrame, dict[str, float]]:
    """Fill numbers by medians taken from this frame or handed in from the training part."""
    if medians is None:
        found = {r["column"]: r["m"] for r in column_quantiles(df, columns, {"m": 0.5}).collect()}
        medians = {c: found.get(c) or 0.0 for c in columns}
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c])) for c in columns}), dict(medians)
