"""Splits, undersampling and synthetic minority rows. Randomness is a hash of the row key and a seed,
so a lost task recomputes the same choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .scale import numbered, with_scalars
from .scans import with_ranks_below


def _ticket(keys: Sequence[str], seed: int):
    return F.xxhash64(F.lit(seed), *[F.col(k) for k in keys])


def stratified_split(df: DataFrame, target: str, keys: Sequence[str], shares: Sequence[float] = (0.7, 0.1, 0.2), seed: int = 42,
                     name: str = "part") -> DataFrame:
    """Exact shares per class in hash order. Parts are numbered from 0; rank ``r`` of ``n`` lies below an edge if ``(r - 0.5) / n`` does.

    Nothing is ordered: ``scans.with_ranks_below`` finds the tickets that cut a class, however large, by counting.
    """
    sizes = df.groupBy(target).agg(F.count("*").alias("_size"))
    edges = [sum(shares[: i + 1]) for i in range(len(shares) - 1)]
    near = lambda edge: F.floor(F.col("_size") * F.lit(float(edge)) + 0.5).cast("bigint")
    exact = lambda edge: near(edge) - F.when((near(edge) - 0.5) / F.col("_size") < F.lit(float(edge)), 0).otherwise(1)
    wanted = sizes.select(target, "_size", *[exact(edge).alias(f"_c{i}") for i, edge in enumerate(edges)])
    rows = with_ranks_below(df, _ticket(keys, seed), keys, wanted, [f"_c{i}" for i in range(len(edges))], [target])
    part = F.lit(len(edges))
    for i in reversed(range(len(edges))):
        part = F.when(F.col(f"_below__c{i}"), F.lit(i)).otherwise(part)
    return rows.select(*df.columns, part.cast("int").alias(name))


def chronological_split(df: DataFrame, day: str, keys: Sequence[str], test_share: float = 0.2, name: str = "is_test") -> DataFrame:
    """The earliest rows train and the latest test; ``keys`` settle rows of one day."""
    dated = df.where(F.col(day).isNotNull())
    ranked = numbered(dated, [day, *keys], name="_rank")
    size = dated.agg(F.count("*").alias("_size"))
    rows = with_scalars(ranked, size)
    cut = F.least(F.greatest(F.lit(1), F.floor(F.col("_size") * F.lit(1.0 - test_share))), F.col("_size") - 1)
    return rows.withColumn(name, (F.col("_rank") > cut).cast("int")).select(*df.columns, name)


def split_bounds(split: DataFrame, day: str, name: str = "is_test") -> DataFrame:
    return split.groupBy(name).agg(F.count("*").alias("n_rows"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def undersampled(df: DataFrame, target: str, keys: Sequence[str], ratio: int = 4, seed: int = 42) -> DataFrame:
    """All rows of the other classes and at most ``ratio`` times as many of the largest one."""
    counts = df.groupBy(target).agg(F.count("*").alias("_n"))
    sizes = counts.agg(F.max(F.struct(F.col("_n"), F.col(target).alias("_c"))).alias("_big"), F.sum("_n").alias("_all"))
    rows = with_scalars(df, sizes.select(F.col("_big._c").alias("_major"), (F.lit(ratio) * (F.col("_all") - F.col("_big._n"))).alias("_quota"),
                                         F.col("_big._n").alias("_size")))
    major = F.col(target) == F.col("_major")
    rest = rows.where(~major | (F.col("_size") <= F.col("_quota")) | F.col(target).isNull()).select(*df.columns)
    large = rows.where(major & (F.col("_size") > F.col("_quota"))).select(*df.columns)
    quota = sizes.select(F.col("_big._c").alias(target), F.col("_big._n").alias("_size"), (F.lit(ratio) * (F.col("_all") - F.col("_big._n"))).alias("_quota")) \
        .where(F.col("_size") > F.col("_quota"))
    kept = with_ranks_below(large, _ticket(keys, seed), keys, quota, ["_quota"], [target]).where("_below__quota")
    return rest.unionByName(kept.select(*df.columns))


BLOCK, BITS = 64, 8


def _gap(low, high, features: Sequence[str]):
    """Squared distance of two boxes; ``low`` and ``high`` give the bounds of a feature on either side."""
    apart = lambda f: F.greatest(low(0, f) - high(1, f), low(1, f) - high(0, f), F.lit(0.0))
    return sum((apart(f) * apart(f) for f in features), F.lit(0.0))


def near_rows(points: DataFrame, features: Sequence[str], k: int, rows: int) -> DataFrame:
    """``_place``, ``_peer``, ``_nth`` and ``_found``: the ``k`` nearest other rows; equal distances go by ``_peer``.

    ``points`` has a unique ``_place`` and the features as doubles. Rows are ordered by the interleaved
    bits of their quantile bins and cut into blocks of ``BLOCK`` to twice as many rows, so equal rows
    spread over blocks too. The k-th distance within the own block bounds the search: every block whose
    bounding box is not farther away is searched, so no nearest row is missed. The fewer features, the
    fewer blocks that are; with many features a row may have to be compared with most blocks.
    """
    bits = max(1, min(BITS, 60 // len(features)))
    cuts = points.agg(*[F.percentile_approx(f, [i / 2 ** bits for i in range(1, 2 ** bits)], 10_000).alias(f) for f in features]).first()
    passed = lambda f: F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts[f] or [0.0])))), lambda c: c <= F.col(f)))
    code = F.lit(0).cast("bigint")
    for bit in reversed(range(bits)):
        for f in features[:60 // bits]:
            code = F.shiftleft(code, 1).bitwiseOR(F.shiftright(F.col(f"_n_{f}"), bit).bitwiseAND(F.lit(1)).cast("bigint"))
    binned = points.select("*", *[passed(f).alias(f"_n_{f}") for f in features]).select(*points.columns, code.cast("double").alias("_code"))
    blocks = max(1, rows // max(BLOCK, k + 1))
    placed = numbered(binned, ["_code", features[0], "_place"], name="_at")
    cells = written(placed.select("_place", *features, F.floor((F.col("_at") - 1) * blocks / rows).alias("_b")))

    peers = cells.select(F.col("_b").alias("_pb"), F.col("_place").alias("_peer"), *[F.col(f).alias(f"_p_{f}") for f in features])
    gap = sum(((F.col(f) - F.col(f"_p_{f}")) * (F.col(f) - F.col(f"_p_{f}")) for f in features), F.lit(0.0))
    own = Window.partitionBy("_place")
    nth = F.row_number().over(own.orderBy("_d", "_peer"))
    inside = cells.join(peers, (F.col("_b") == F.col("_pb")) & (F.col("_place") != F.col("_peer"))).select("_place", "_peer", gap.alias("_d"))
    inside = written(inside.withColumn("_nth", nth).where(F.col("_nth") <= k).drop("_nth"))
    reach = cells.join(inside.groupBy("_place").agg(F.max("_d").alias("_reach")), "_place")
    # A bound that is no number is left out: such a row is at no distance from any other.
    box = written(reach.groupBy("_b").agg(F.max("_reach").alias("_far"), *[F.min(f).alias(f"_l_{f}") for f in features],
                                          *[F.max(F.when(~F.isnan(f), F.col(f))).alias(f"_h_{f}") for f in features]))
    other = box.select(F.col("_b").alias("_pb"), *[F.col(f"_{x}_{f}").alias(f"_p{x}_{f}") for f in features for x in "lh"])
    side = lambda x: lambda i, f: F.col(f"_p{x}_{f}" if i else f"_{x}_{f}")
    asked = box.join(other, (F.col("_b") != F.col("_pb")) & (_gap(side("l"), side("h"), features) <= F.col("_far"))).select("_b", *other.columns)
    point = lambda x: lambda i, f: F.col(f"_p{x}_{f}" if i else f)
    near_blocks = reach.join(asked, "_b").where(_gap(point("l"), point("h"), features) <= F.col("_reach")).select("_place", *features, "_reach", "_pb")
    outside = near_blocks.join(peers, "_pb").where(gap <= F.col("_reach")).select("_place", "_peer", gap.alias("_d"))
    near = inside.unionAll(outside).withColumn("_nth", nth).where(F.col("_nth") <= k)
    return near.withColumn("_found", F.count("*").over(own)).select("_place", "_peer", "_nth", "_found")


def smote(df: DataFrame, target: str, features: Sequence[str], keys: Sequence[str], minority, target_share: float = 0.1,
          neighbours: int = 5, seed: int = 42) -> DataFrame:
    """Add synthetic minority rows on the lines between minority rows and one of their nearest
    minority rows until they make up ``target_share`` of all rows. An opt-in; nothing else in the
    library calls it. Nearest is exact, see ``near_rows``.
    """
    small = df.where(F.col(target) == F.lit(minority))
    sizes = df.agg(F.count("*").alias("all"), F.count_if(F.col(target) == F.lit(minority)).alias("few")).first()
    missing = int(target_share * (sizes["all"] - sizes["few"]) / (1 - target_share)) - sizes["few"]
    if missing <= 0 or sizes["few"] < 2:
        return df
    ticketed = small.withColumn("_ticket", _ticket(keys, seed))
    points = numbered(ticketed, ["_ticket", *keys], name="_place").select("_place", *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])
    points = written(points)
    near = near_rows(points, features, min(neighbours, sizes["few"] - 1), sizes["few"])
    copies, more = divmod(missing, sizes["few"])
    wanted = F.lit(copies) + (F.col("_place") <= more).cast("int")
    seeds = points.where(wanted > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), wanted)))
    draw = lambda salt: F.pmod(F.xxhash64(F.lit(seed + salt), F.col("_place"), F.col("_copy")), F.lit(1_000_003))
    peers = points.select(F.col("_place").alias("_peer"), *[F.col(f).alias(f"_p_{f}") for f in features])
    lines = seeds.join(near, "_place").where(F.col("_nth") == F.pmod(draw(1), F.col("_found")) + 1).withColumn("_part", draw(2) / F.lit(1_000_003.0)).join(peers, "_peer")
    made = lines.select(*[(F.col(f) + (F.col(f"_p_{f}") - F.col(f)) * F.col("_part")).alias(f) for f in features],
                        F.lit(minority).cast(dict(df.dtypes)[target]).alias(target), F.lit(1).alias("is_synthetic"))
    original = df.withColumns({f: F.col(f).cast("double") for f in features}).withColumn("is_synthetic", F.lit(0))
    return original.unionByName(made, allowMissingColumns=True)
