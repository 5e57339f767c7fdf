"""Building blocks that stay exact when one key or value holds a large share of all rows.

* ``attach_group_stats`` brings per-key results back to rows without a row-level window: the few
  heavy keys (their number is bounded by ``1 / heavy_share``) are broadcast, the others are joined.
* ``prefix_sums`` is a running total over a global or per-key order. Rows are dealt to ranges of the
  real values, range totals are summed first, and only rows of one range meet in one task.
* ``exact_quantiles`` finds interpolated quantiles from a sketch that only narrows the search;
  exact counts decide.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared, written

HEAVY_SHARE = 0.001
SPREAD = 1024
SMALL_GROUP = 20_000   # up to here neighbouring ranks may lie outside the sketch's bracket, so all values are kept
SLOTS = 1024


def one_row(df: DataFrame, *aggregates: Column) -> DataFrame:
    """Global aggregate as a one-row frame, ready to be cross-joined."""
    return df.agg(*aggregates)


def with_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Attach a one-row frame, always a global aggregate, to every row by broadcasting that row.

    Nested scalar subqueries say the same but multiply the plan each time a projection is merged.
    """
    return df.join(F.broadcast(scalars))


def attach_group_stats(df: DataFrame, stats: DataFrame, keys: Sequence[str], weight: str | None = None,
                       heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """Left join of per-key ``stats`` to ``df``.

    ``weight`` names the row count per key inside ``stats``. With it, keys that hold at least
    ``heavy_share`` of all rows go by broadcast, which bounds that side at ``1 / heavy_share``
    rows, and their rows are spread over tasks. Without it the join is a plain left join.
    """
    keys = list(keys)
    added = [c for c in stats.columns if c not in keys and c != weight]
    if weight is None:
        return df.join(stats.select(*keys, *added), keys, "left")
    # Read three times below: one folded row per key, never the rows themselves.
    stats = shared(stats)
    total = stats.agg(F.sum(weight).alias("_total"))
    marked = with_scalars(stats, total).withColumn("_heavy", F.col(weight) >= F.col("_total") * F.lit(heavy_share))
    heavy = marked.where("_heavy").select(*[F.col(k).alias(f"_h_{k}") for k in keys],
                                          *[F.col(c).alias(f"_h_{c}") for c in added], F.lit(True).alias("_hit"))
    light = marked.where("NOT _heavy").select(*[F.col(k).alias(f"_l_{k}") for k in keys],
                                              *[F.col(c).alias(f"_l_{c}") for c in added],
                                              F.lit(0).alias("_l_spread"))
    on_heavy = [F.col(k) == F.col(f"_h_{k}") for k in keys]
    out = df.join(F.broadcast(heavy), on_heavy, "left")
    aside = F.col("_hit").isNotNull()
    for k in keys:
        aside = aside | F.col(k).isNull()
    # The spread of a row only balances tasks; it never decides a match. As an int the sum overflows for hashes near the largest.
    ticket = F.hash(*df.columns).cast("bigint") + F.spark_partition_id()
    out = out.withColumn("_spread", F.when(aside, F.pmod(ticket, F.lit(SPREAD)).cast("int") + 1).otherwise(F.lit(0)))
    on_light = [F.when(F.col("_spread") == 0, F.col(k)) == F.col(f"_l_{k}") for k in keys]
    out = out.join(light, [*on_light, F.col("_spread") == F.col("_l_spread")], "left")
    return out.select(*df.columns, *[F.coalesce(F.col(f"_h_{c}"), F.col(f"_l_{c}")).alias(c) for c in added])


def prefix_sums(df: DataFrame, order: Sequence[str], sums: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Running totals (current row included) of ``sums`` in ascending ``order`` within ``by``, NULLs first.

    Rows equal in all of ``order`` are taken in any sequence. Spark cuts the rows into ranges of the
    real values of ``by`` and ``order``; a row number settles ties, so rows that are equal in all of
    them still spread over ranges. Every range is summed by itself, and the totals of earlier ranges,
    one row per range and key, are added. The dealt rows are written once, because both readings
    must see the same ranges.
    """
    by = list(by)
    measured = df.withColumns({f"_m_{name}": expression for name, expression in sums.items()}).withColumn("_tie", F.monotonically_increasing_id())
    ascending = [F.col(c).asc_nulls_first() for c in [*by, *order]]
    dealt = written(measured.repartitionByRange(*ascending, F.col("_tie")).withColumn("_part", F.spark_partition_id()))
    totals = dealt.groupBy(*by, "_part").agg(*[F.sum(f"_m_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(c).alias(f"_o_{c}") for c in [*by, "_part"]],
                            *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_p_{n}") for n in sums])
    joined = dealt.join(offsets if by else F.broadcast(offsets), [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in [*by, "_part"]])
    inside = Window.partitionBy(*by, "_part").orderBy(*[F.col(c).asc_nulls_first() for c in order], "_tie").rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(*df.columns, *[(F.col(f"_p_{n}") + F.sum(f"_m_{n}").over(inside)).alias(n) for n in sums])


def numbered(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "row_no") -> DataFrame:
    """Dense 1-based row number in ascending ``order`` within ``by``."""
    out = prefix_sums(df, order, {name: F.lit(1).cast("bigint")}, by)
    return out.withColumn(name, F.col(name).cast("bigint"))


def bounded_quantiles(df: DataFrame, column: str, probs: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Interpolated quantiles of a column with a bounded domain (days, flags, small counts).

    Equal values are counted first, so the state per key is the number of distinct values.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    return counts.groupBy(*by).agg(*[F.percentile(F.col("_v").cast("double"), F.lit(p), F.col("_n")).alias(name)
                                     for name, p in probs.items()])


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Mapping[str, float], accuracy: int = 10000) -> DataFrame:
    """Interpolated quantiles of several columns in the passes of one: ``column`` and one field per quantile."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    return exact_quantiles(df.select(F.inline(cells)), "value", probs, ["column"], accuracy, few_groups=True)


def quantile_row(df: DataFrame, columns: Sequence[str], prob: float, prefix: str) -> DataFrame:
    """One quantile of several columns as a one-row frame with fields ``prefix + column``."""
    long = column_quantiles(df, columns, {"_q": prob})
    return long.agg(*[F.max(F.when(F.col("column") == c, F.col("_q"))).alias(f"{prefix}{c}") for c in columns])


def exact_quantiles(df: DataFrame, column: str, probs: Mapping[str, float], by: Sequence[str] = (),
                    accuracy: int = 10000, few_groups: bool = False) -> DataFrame:
    """Interpolated quantiles of any numeric column, exact at any size, in two passes.

    A sketch brackets each quantile; the second pass counts equal values inside the brackets and
    folds everything between them, so about a thousandth of the values is ever ordered. Groups of
    up to ``SMALL_GROUP`` rows are counted whole. A rank outside its bracket would break the
    sketch's error bound and raises an error instead of giving a near value.
    ``few_groups`` promises a number of groups that the schema fixes, such as one per column; their
    cut points are then broadcast.
    """
    by = list(by)

    def attach(rows, stats):
        if not by:
            return with_scalars(rows, stats.drop("_w"))
        if few_groups:
            return rows.join(F.broadcast(stats.drop("_w")), by)
        return attach_group_stats(rows, stats, by, "_w")

    value = F.col(column).cast("double")
    base = df.select(*by, value.alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    margin = 5.0 / accuracy
    sides = {name: (max(0.0, p - margin), min(1.0, p + margin)) for name, p in probs.items()}
    wanted = sorted({x for pair in sides.values() for x in pair})
    cuts = base.groupBy(*by).agg(F.percentile_approx("_v", wanted, accuracy).alias("_c"), F.count("*").alias("_w"), F.count("*").alias("_n"))
    placed = attach(base, cuts)
    v, cut = F.col("_v"), lambda x: F.col("_c")[wanted.index(x)]
    zone: Column = F.lit(0)
    for x in wanted:
        zone = zone + (v > cut(x)).cast("int")
    kept = F.col("_n") <= SMALL_GROUP
    for low, high in sides.values():
        kept = kept | ((v >= cut(low)) & (v <= cut(high)))
    # Kept values of a zone are spread over SLOTS slots of equal width, so that no task has to order a
    # whole zone. Values that are not kept lie below a kept one, which can only be the zone's upper cut.
    placed = placed.withColumn("_z", zone)
    low_cut, high_cut = F.get("_c", F.col("_z") - 1), F.get("_c", F.col("_z"))
    slot = F.coalesce(F.floor(F.try_divide(v - low_cut, high_cut - low_cut) * SLOTS), F.lit(0))
    folded = placed.groupBy(*by, "_z", F.when(kept, slot).otherwise(-1).alias("_s"), F.when(kept, v).alias("_v")).agg(F.count("*").alias("_k"))
    # At most SLOTS rows per group and zone.
    group = Window.partitionBy(*(by or [F.lit(0)]))
    slots = folded.groupBy(*by, "_z", "_s").agg(F.sum("_k").alias("_t"))
    slots = slots.select(*[F.col(c).alias(f"_o{c}") for c in [*by, "_z", "_s"]],
                         (F.sum("_t").over(group.orderBy("_z", "_s")) - F.col("_t")).alias("_before"), F.sum("_t").over(group).alias("_n"))
    inside = folded.join(slots, [F.col(c).eqNullSafe(F.col(f"_o{c}")) for c in [*by, "_z", "_s"]])
    run = inside.select(*by, "_v", (F.col("_before") + F.sum("_k").over(Window.partitionBy(*by, "_z", "_s").orderBy(F.asc_nulls_first("_v")))).alias("_upto"), "_n")
    spot = {name: (F.col("_n") - 1) * F.lit(float(p)) for name, p in probs.items()}
    entry = F.struct("_upto", "_v")
    found = run.groupBy(*by).agg(F.max("_n").alias("_n"), *[
        F.min(F.when(F.col("_upto") > side(spot[name]), entry)).alias(f"_{tag}_{name}") for name in probs for tag, side in (("a", F.floor), ("b", F.ceil))])
    lost = F.raise_error(F.lit("quantile rank outside its bracket")).cast("double")

    def solved(name):
        low, high = F.col(f"_a_{name}")["_v"], F.col(f"_b_{name}")["_v"]
        between = low + (high - low) * (spot[name] - F.floor(spot[name]))
        return F.when(F.col("_n").isNull(), F.lit(None).cast("double")).when(low.isNull() | high.isNull(), lost).otherwise(between).alias(name)

    return found.select(*by, *[solved(name) for name in probs])
