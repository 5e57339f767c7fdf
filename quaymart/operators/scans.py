"""Ordered work on series of any length: running combinations, neighbours in order, and the m smallest.

A window over one key meets in one task, however long the series of that key is. Here Spark cuts the rows into
ranges of the real values instead; a range is worked on by itself and then gets what lies beyond its borders,
which is one row per range (``scanned``) or a few rows per border (``around``). The dealt rows are written once,
because both readers must see the same ranges. ``with_ranks_below`` needs no order at all: it narrows
down the value that cuts off the wanted number of rows by counting, and then filters.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .scale import numbered

# How a range is summed up, how the sums of ranges are combined, and how the two sides meet.
KINDS = ("sum", "max", "min", "last")


def _dealt(df: DataFrame, by: Sequence[str], order: Sequence[str], descending: bool = False) -> DataFrame:
    """Rows with their range ``_part`` and a row number ``_tie`` that settles equal rows, written to the shared folder."""
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    way = (lambda c: F.col(c).desc_nulls_last()) if descending else (lambda c: F.col(c).asc_nulls_first())
    ranges = [*[F.col(c).asc_nulls_first() for c in by], *[way(c) for c in order], F.col("_tie")]
    return written(tied.repartitionByRange(*ranges).withColumn("_part", F.spark_partition_id()))


def _same(by: Sequence[str], prefix: str) -> list[Column]:
    return [F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in by]


def scanned(df: DataFrame, order: Sequence[str], scans: Mapping[str, tuple[str, Column]], by: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """Running combination (current row included) of each ``(kind, column)`` in ``order`` within ``by``.

    ``kind`` is an associative combiner: ``sum``, ``max``, ``min``, or ``last``, the last value that is not null. Nulls come first in
    ascending and last in descending order; rows equal in all of ``order`` are taken in any sequence. Nothing seen yet gives null.
    """
    if unknown := {kind for kind, _ in scans.values()} - set(KINDS):
        raise ValueError(f"unknown combiner {sorted(unknown)}")
    by, plain = list(by), {"sum": F.sum, "max": F.max, "min": F.min}
    dealt = _dealt(df.withColumns({f"_m_{n}": c for n, (_, c) in scans.items()}), by, order, descending)
    way = (lambda c: F.col(c).desc_nulls_last()) if descending else (lambda c: F.col(c).asc_nulls_first())
    sequence = [*[way(c) for c in order], F.col("_tie")]
    inside = Window.partitionBy(*by, "_part").orderBy(*sequence).rowsBetween(Window.unboundedPreceding, 0)

    def over(kind, column, window):
        return F.last(column, ignorenulls=True).over(window) if kind == "last" else plain[kind](column).over(window)

    run = dealt.withColumns({f"_r_{n}": over(kind, f"_m_{n}", inside) for n, (kind, _) in scans.items()})
    # The running value of a range's last row sums up the range; ties of the order are settled by _tie, so it is one row.
    whole = Window.partitionBy(*by, "_part").orderBy(*sequence).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = dealt.withColumns({f"_t_{n}": F.last(f"_m_{n}", ignorenulls=True).over(whole) if kind == "last" else plain[kind](f"_m_{n}").over(whole)
                                for n, (kind, _) in scans.items()}) \
        .groupBy(*by, "_part").agg(*[F.first(f"_t_{n}").alias(f"_t_{n}") for n in scans])
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*[F.col(c).alias(f"_o_{c}") for c in [*by, "_part"]],
                            *[over(kind, f"_t_{n}", before).alias(f"_p_{n}") for n, (kind, _) in scans.items()])
    joined = run.join(carried if by else F.broadcast(carried), _same([*by, "_part"], "_o_"))

    def met(name, kind):
        earlier, here = F.col(f"_p_{name}"), F.col(f"_r_{name}")
        if kind == "sum":
            return F.when(earlier.isNull(), here).otherwise(earlier + F.coalesce(here, F.lit(0)))
        return {"max": F.greatest, "min": F.least, "last": lambda a, b: F.coalesce(b, a)}[kind](earlier, here)

    return joined.select(*df.columns, *[met(n, kind).alias(n) for n, (kind, _) in scans.items()])


def filled(series: DataFrame, column: str = "y", day: str = "ds", keys: Sequence[str] = ("sku_id",)) -> DataFrame:
    """``column`` with gaps filled by the last known value, and gaps at the start by the first one; a series without any value stays empty."""
    names = series.columns
    forward = scanned(series, [day], {"_fill": ("last", F.col(column))}, keys)
    if forward.where("_fill IS NULL").limit(1).count():
        forward = scanned(forward, [day], {"_back": ("last", F.col(column))}, keys, descending=True)
        return forward.select(*[F.coalesce("_fill", "_back").alias(column) if c == column else F.col(c) for c in names])
    return forward.select(*[F.col("_fill").alias(column) if c == column else F.col(c) for c in names])


def around(df: DataFrame, order: Sequence[str], value: Column, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Arrays ``before`` and ``after``: ``value`` of the up to ``k`` rows on either side in ``order`` within ``by``, nearest first.

    Rows at the border of a range take the missing ones from the border rows of other ranges, at most ``k`` per range and side.
    """
    by = list(by)
    dealt = _dealt(df.withColumn("_v", value), by, order)
    up, down = [F.col(c).asc_nulls_first() for c in order], [F.col(c).desc_nulls_last() for c in order]
    part = Window.partitionBy(*by, "_part")
    group = Window.partitionBy(*(by or [F.lit(0)]))
    rising, falling = [*up, F.col("_tie")], [*down, F.col("_tie").desc()]
    tails = dealt.withColumn("_n", F.row_number().over(part.orderBy(*falling))).where(F.col("_n") <= k)
    heads = dealt.withColumn("_n", F.row_number().over(part.orderBy(*rising))).where(F.col("_n") <= k)

    def borders(rows, sequence, name):
        """Per range the ``k`` border rows of the ranges before it in ``sequence``."""
        ordered = group.orderBy(*sequence).rowsBetween(-k, -1)
        seen = rows.withColumn("_list", F.reverse(F.collect_list("_v").over(ordered)))
        first = rows.select(*by, "_part").distinct().select(*[F.col(c).alias(f"_{name}_{c}") for c in [*by, "_part"]])
        outer = seen.groupBy(*by, "_part").agg(F.max(F.struct("_n", "_list"))["_list"].alias(f"_{name}"))
        return outer.join(first, _same([*by, "_part"], f"_{name}_")).drop(*by, "_part")

    # The farthest border row of a range (largest _n) is the first of its range's tail, so what precedes it belongs to other ranges.
    earlier = borders(tails, [F.col("_part"), *rising], "b")
    later = borders(heads, [F.col("_part").desc(), *falling], "a")
    inner = part.orderBy(*rising)
    own = dealt.withColumns({"_before": F.reverse(F.collect_list("_v").over(inner.rowsBetween(-k, -1))), "_after": F.collect_list("_v").over(inner.rowsBetween(1, k))})
    joined = own.join(earlier if by else F.broadcast(earlier), _same([*by, "_part"], "_b_"), "left").join(
        later if by else F.broadcast(later), _same([*by, "_part"], "_a_"), "left")
    none = F.array().cast(dealt.select(F.array("_v")).schema[0].dataType)
    more = lambda mine, far: F.slice(F.concat(F.col(mine), F.coalesce(F.col(far), none)), 1, k)
    return joined.select(*df.columns, more("_before", "_b").alias("before"), more("_after", "_a").alias("after"))


STEPS = (48, 24, 0)   # bits that a round of counting leaves open


def with_ranks_below(df: DataFrame, ticket: Column, tie: Sequence[str], wanted: DataFrame, cuts: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``df`` with ``_below_<cut>`` for each of ``cuts``: whether a row is among the ``<cut>`` smallest tickets of its group.

    ``wanted`` has one row per group, groups being classes, with the numbers of rows to cut off. The ticket is a 64-bit hash.
    Its leading 16 bits are counted per group, then the next 24 bits inside the one cell that each cut falls into, and so on; after three rounds of
    counting the cutting tickets are known exactly, and a filter does the rest. Only rows that share a cutting ticket with others of which
    some are wanted, such as repeated keys, are put in order, by ``tie``.
    """
    by, flip = list(by), F.lit(-(1 << 63))
    rows = df.withColumn("_u", ticket.cast("bigint").bitwiseXOR(flip))   # unsigned order of these bits is the signed order of the tickets
    goals = wanted.select(*by, F.inline(F.array(*[F.struct(F.lit(c).alias("_cut"), F.col(c).cast("bigint").alias("_left")) for c in cuts]))).where("_left > 0")
    found = None
    for shift in STEPS:
        cell = F.shiftrightunsigned("_u", shift) if shift else F.col("_u")
        if found is None:
            counts = rows.groupBy(*by, cell.alias("_cell")).agg(F.count("*").alias("_n"))
            group = by
        else:
            # One row per group and cut; groups are classes.
            side = F.broadcast(found.select(*[F.col(c).alias(f"_f_{c}") for c in by], "_cut", "_prefix"))
            inside = rows.join(side, [*_same(by, "_f_"), F.shiftrightunsigned("_u", before) == F.col("_prefix")])
            counts = inside.groupBy(*by, "_cut", cell.alias("_cell")).agg(F.count("*").alias("_n"))
            group = [*by, "_cut"]
            goals = found.select(*by, "_cut", "_left")
        in_order = Window.partitionBy(*(group or [F.lit(0)])).orderBy(F.col("_cell").bitwiseXOR(flip) if not shift else F.col("_cell"))
        run = counts.withColumn("_upto", F.sum("_n").over(in_order))
        keys = [c for c in group if c != "_cut"]
        aim = F.broadcast(goals.select(*[F.col(c).alias(f"_a_{c}") for c in keys], F.col("_cut").alias("_a_cut"), "_left"))
        match = [*_same(keys, "_a_"), (F.col("_upto") >= F.col("_left")) & (F.col("_upto") - F.col("_n") < F.col("_left"))]
        if "_cut" in group:
            match.append(F.col("_cut") == F.col("_a_cut"))
        found = written(run.join(aim, match).select(*by, F.col("_a_cut").alias("_cut"), (F.col("_left") - F.col("_upto") + F.col("_n")).alias("_left"),
                                                    F.col("_cell").alias("_prefix"), F.col("_n").alias("_same")))
        before = shift
    # The cutting ticket, how many rows with it are wanted, and how many there are; one row per group, and a null group is one too.
    facts = {"t": "_prefix", "l": "_left", "s": "_same"}
    wide = found.groupBy(*[F.col(c).alias(f"_g_{c}") for c in by]).agg(*[F.max(F.when(F.col("_cut") == c, F.col(v))).alias(f"_{k}_{c}") for c in cuts for k, v in facts.items()])
    placed = rows.join(F.broadcast(wide), _same(by, "_g_"), "left")
    lower = lambda c: F.col("_u").bitwiseXOR(flip) < F.col(f"_t_{c}").bitwiseXOR(flip)
    level = lambda c: F.col("_u") == F.col(f"_t_{c}")
    split = F.lit(False)
    for c in cuts:   # some, but not all, of the rows with the cutting ticket are wanted
        split = split | (level(c) & (F.col(f"_l_{c}") < F.col(f"_s_{c}")))
    split = F.coalesce(split, F.lit(False))
    sure = placed.where(~split).withColumns({f"_below_{c}": F.coalesce(lower(c) | level(c), F.lit(False)) for c in cuts})
    out = [*df.columns, *[f"_below_{c}" for c in cuts]]
    if not found.where("_left < _same").limit(1).count():
        return sure.select(*out)
    ties = numbered(placed.where(split), [*tie], by=[*by, "_u"], name="_nth")
    ties = ties.withColumns({f"_below_{c}": F.coalesce(lower(c) | (level(c) & (F.col("_nth") <= F.col(f"_l_{c}"))), F.lit(False)) for c in cuts})
    return sure.select(*out).unionByName(ties.select(*out))
