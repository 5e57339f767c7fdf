"""Nearest-neighbour mutual information of numeric features with a class target.

For a row of a class with ``n_c`` rows, the radius is the distance to its k-th nearest other row of the same class (at most ``n_c - 1``
of them), feature by feature, and ``m`` is the number of rows of all classes that are nearer than the radius, itself included (with radius
0: that have the same value). The estimate is ``psi(n) + mean psi(k) - mean psi(n_c) - mean psi(m)``, and at least 0. Classes of one row
are left out, as they have no neighbour.

Equal values of a class are folded first. Radii come from the up to k different values on either side (``scans.around``); counts from one
running total over the values and the ends of all intervals (``scans.scanned``), so nothing is compared pairwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .scale import attach_group_stats
from .scans import around, scanned


def digamma(x: Column) -> Column:
    """psi of a positive whole number or fraction: recurrence up to 10, then the asymptotic series."""
    lift = F.lit(0.0)
    for step in range(10):
        at = x + F.lit(float(step))
        lift = lift + F.when(at < 10, F.lit(1.0) / at).otherwise(F.lit(0.0))
    z = F.when(x >= 10, x.cast("double")).otherwise(x + F.ceil(F.lit(10.0) - x))
    w = F.lit(1.0) / (z * z)
    series = w * (F.lit(1 / 12) - w * (F.lit(1 / 120) - w * (F.lit(1 / 252) - w * (F.lit(1 / 240) - w * F.lit(1 / 132)))))
    return F.log(z) - F.lit(0.5) / z - series - lift


def neighbour_information(df: DataFrame, target: str, columns: Sequence[str], k: int = 3) -> DataFrame:
    """``feature`` and ``mutual_information`` in nats; rows where the feature or the target is missing are left out per feature."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])
    long = df.where(F.col(target).isNotNull()).select(F.col(target).cast("string").alias("c"), F.inline(cells)).where("x IS NOT NULL AND NOT isnan(x)")
    folded = written(long.groupBy("feature", "c", "x").agg(F.count("*").alias("n")))
    classes = folded.groupBy("feature", "c").agg(F.sum("n").alias("n_c"), F.count("*").alias("_w")).where("n_c > 1")
    rows = attach_group_stats(folded, classes, ["feature", "c"], "_w").where("n_c IS NOT NULL")
    rows = rows.withColumn("k", F.least(F.lit(k), F.col("n_c") - 1))
    sides = around(rows, ["x"], F.struct("x", "n"), k, by=["feature", "c"])
    away = lambda side: F.transform(F.col(side), lambda s: F.struct(F.abs(s["x"] - F.col("x")).alias("d"), s["n"].alias("n")))
    own = F.array(F.struct(F.lit(0.0).alias("d"), (F.col("n") - 1).alias("n")))
    near = F.array_sort(F.concat(own, away("before"), away("after")))
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("double").alias("d"))
    step = lambda s, e: F.struct((s["seen"] + e["n"]).alias("seen"), F.when(s["d"].isNull() & (s["seen"] + e["n"] >= F.col("k")), e["d"]).otherwise(s["d"]).alias("d"))
    radii = written(sides.select("feature", "c", "x", "n", "n_c", "k", F.aggregate(near, start, step)["d"].alias("r")))

    # Points and interval ends in one order: an end "from" stands before the points it counts from, an end "to" behind those it counts up to.
    # Within a positive radius the points at its very distance are not counted.
    positive = F.col("r") > 0
    point = F.struct(F.col("x").alias("at"), F.lit(1).alias("rank"), F.col("n").alias("count"), F.lit(0).alias("sign"))
    low = F.struct((F.col("x") - F.col("r")).alias("at"), F.when(positive, 2).otherwise(0).alias("rank"), F.lit(0).cast("bigint").alias("count"), F.lit(-1).alias("sign"))
    high = F.struct((F.col("x") + F.col("r")).alias("at"), F.when(positive, 0).otherwise(2).alias("rank"), F.lit(0).cast("bigint").alias("count"), F.lit(1).alias("sign"))
    marks = radii.select("feature", "c", "x", F.inline(F.array(point, low, high)))
    run = scanned(marks, ["at", "rank"], {"_upto": ("sum", F.col("count"))}, by=["feature"]).where("sign != 0")
    inside = run.groupBy("feature", "c", "x").agg(F.sum(F.col("sign") * F.coalesce("_upto", F.lit(0))).alias("m"))
    both = radii.join(inside, ["feature", "c", "x"])
    mean = lambda what: F.sum(F.col("n") * digamma(what.cast("double"))) / F.sum("n")
    sums = both.groupBy("feature").agg(F.sum("n").alias("_n"), mean(F.col("k")).alias("_k"), mean(F.col("n_c")).alias("_c"), mean(F.greatest(F.col("m"), F.lit(1))).alias("_m"))
    value = digamma(F.col("_n").cast("double")) + F.col("_k") - F.col("_c") - F.col("_m")
    return sums.select("feature", F.greatest(value, F.lit(0.0)).alias("mutual_information"))
