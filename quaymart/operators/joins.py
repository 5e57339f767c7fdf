"""Merges of uploads and row stacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scale import numbered


def stacked(frames: Sequence[DataFrame]) -> DataFrame:
    """Row stack over the union of columns."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def merged(frames: Sequence[DataFrame], keys: Sequence[str] = (), suffix: str = "_dup") -> DataFrame:
    """Full outer merge on the keys both sides have; a side without any of them is stacked below."""
    if not keys:
        return stacked(frames)
    out = frames[0]
    for frame in frames[1:]:
        common = [k for k in keys if k in out.columns and k in frame.columns]
        if not common:
            out = out.unionByName(frame, allowMissingColumns=True)
            continue
        clash = {c: f"{c}{suffix}" for c in frame.columns if c in out.columns and c not in common}
        out = out.join(frame.withColumnsRenamed(clash), common, "full_outer")
    return out


def merged_over_baseline(baseline: DataFrame, upload: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer merge where the upload's value wins and the baseline fills what it leaves empty."""
    common = [k for k in keys if k in baseline.columns and k in upload.columns]
    if not common:
        raise ValueError("no common key; use merged_by_position with an explicit order")
    twins = [c for c in baseline.columns if c in upload.columns and c not in common]
    out = baseline.withColumnsRenamed({c: f"_old_{c}" for c in twins}).join(upload, common, "full_outer")
    columns = [*baseline.columns, *[c for c in upload.columns if c not in baseline.columns]]
    return out.select(*[F.coalesce(F.col(c), F.col(f"_old_{c}")).alias(c) if c in twins else F.col(c) for c in columns])


def merged_by_position(baseline: DataFrame, upload: DataFrame, baseline_order: Sequence[str], upload_order: Sequence[str]) -> DataFrame:
    """Merge the n-th row of one side with the n-th row of the other, in explicit orders."""
    if not baseline_order or not upload_order:
        raise ValueError("rows of a distributed table have no position; name the order columns")
    left = numbered(baseline, baseline_order, name="position")
    right = numbered(upload, upload_order, name="position")
    return merged_over_baseline(left, right, ["position"])


def latest_per_key(df: DataFrame, keys: Sequence[str], order: str, tie: str) -> DataFrame:
    """Latest record per key. A maximum folds on the map side, so a key with very many records
    costs one row per task."""
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(F.col(order).alias("_o"), F.col(tie).alias("_t"), *[F.col(c).alias(f"_c_{c}") for c in rest])
    best = df.groupBy(*keys).agg(F.max(ranked).alias("_best"))
    return best.select(*keys, *[F.col(f"_best._c_{c}").alias(c) for c in rest])


def members(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(other.select(*keys), list(keys), "left_semi")


def non_members(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(other.select(*keys), list(keys), "left_anti")


# Columns of a user roll-up that are taken at their largest or smallest value.
ROLLUP_MAX = {"is_buyer", "target", "purchased"}
ROLLUP_MIN = {"date", "eventdate", "event_date", "event_timestamp", "order_timestamp", "order_date", "transactionid",
              "transaction_id", "days_until_next_purchase", "event_observed", "_event_observed"}


def rolled_up(df: DataFrame, user: str, order: str) -> DataFrame:
    """One row per user: outcomes by maximum, dates and ids by minimum, numbers by sum, texts by the
    first in ``order``. Rows without a user pass through."""
    aggregates = []
    for name, kind in df.dtypes:
        lowered = name.strip().lower()
        if name == user:
            continue
        if name in ROLLUP_MAX:
            agg = F.max(name)
        elif lowered in ROLLUP_MIN or "timestamp" in lowered or kind in ("date", "timestamp", "timestamp_ntz"):
            agg = F.min(name)
        elif kind == "boolean":
            agg = F.sum(F.col(name).cast("int"))
        elif kind in ("bigint", "int", "double", "float", "smallint") or kind.startswith("decimal"):
            agg = F.sum(name)
        else:
            # The first non-empty text; the value breaks ties so that the pick is stable.
            agg = F.min_by(name, F.when(F.col(name).isNotNull(), F.struct(F.col(order), F.col(name))))
        aggregates.append(agg.alias(name))
    known = df.where(F.col(user).isNotNull()).groupBy(user).agg(*aggregates)
    return known.unionByName(df.where(F.col(user).isNull()).select(*known.columns), allowMissingColumns=True)
