"""Daily demand per item and the per-item statistics the plan needs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cents, clip
from .scale import attach_group_stats


def daily_demand(sales: DataFrame, keys: Sequence[str] = ("sku_id",)) -> DataFrame:
    """Units per item and day, with the day's flags (any) and rates (mean)."""
    flags = [c for c in ("promo_flag", "is_holiday", "stock_out_flag") if c in sales.columns]
    rates = [c for c in ("discount_pct", "temperature", "rain_mm") if c in sales.columns]
    return sales.groupBy(*keys, F.col("date").alias("ds")).agg(
        F.sum("units_sold").cast("bigint").alias("y"),
        *[F.max(c).alias(c) for c in flags], *[F.avg(c).alias(c) for c in rates])


def split_at(series: DataFrame, cutoff: str, day: str = "ds") -> tuple[DataFrame, DataFrame]:
    """History before the cut-off day and hold-out from it on."""
    edge = F.lit(cutoff).cast("date")
    return series.where(F.col(day) < edge), series.where(F.col(day) >= edge)


def trend_momentum(daily: DataFrame, keys: Sequence[str] = ("sku_id",), low: float = 0.90,
                   high: float = 1.15) -> DataFrame:
    """Mean of the last 30 active days against the last 90; neutral below 90 days of history.

    The window runs over one row per item and day, so its size is the number of days.
    """
    latest = Window.partitionBy(*keys).orderBy(F.desc("ds"))
    ranked = daily.select(*keys, "y", F.row_number().over(latest).alias("_age"))
    means = ranked.groupBy(*keys).agg(
        F.count("*").alias("active_days"), F.avg("y").alias("_all"),
        F.avg(F.when(F.col("_age") <= 30, F.col("y"))).alias("_m30"),
        F.avg(F.when(F.col("_age") <= 90, F.col("y"))).alias("_m90"))
    long = F.col("active_days") >= 90
    ratio = F.when(long & (F.col("_m90") > 0), F.col("_m30") / F.col("_m90")).otherwise(F.lit(1.0))
    return means.select(
        *keys, "active_days",
        F.when(long, F.col("_m30")).otherwise(F.col("_all")).alias("recent_30_mean"),
        F.when(long, F.col("_m90")).otherwise(F.col("_all")).alias("recent_90_mean"),
        F.round(ratio, 4).alias("trend_ratio"),
        F.round(clip(ratio, low, high), 4).alias("trend_adjustment"))


def _counted(frame: DataFrame) -> DataFrame:
    """Sales lines in the columns of a supply cube, each line counted once; a cube and folded lines stay as they are."""
    if "orders" in frame.columns:
        return frame
    money = lambda c: cents(c).cast("decimal(18,0)") if c in frame.columns else F.lit(None).cast("decimal(18,0)")
    units, days = F.col("units_sold").cast("bigint"), F.col("lead_time_days").cast("bigint") if "lead_time_days" in frame.columns else F.lit(None).cast("bigint")
    return frame.withColumns({
        "lead_rows": F.when(days.isNotNull(), F.lit(1).cast("bigint")), "lead_sum": days, "lead_squares": days * days,
        "orders": F.lit(1).cast("bigint"), "stock_outs": F.col("stock_out_flag").cast("bigint"), "units": units,
        "value": (cents("list_price") * units).cast("decimal(18,0)"), "price_sum": money("list_price"), "cost_sum": money("purchase_cost"),
        "margin_sum": F.col("margin_pct") if "margin_pct" in frame.columns else F.lit(None).cast("double")})


SUPPLY_SUMS = ("orders", "stock_outs", "units", "value", "price_sum", "cost_sum", "margin_sum", "lead_rows", "lead_sum", "lead_squares")


def supply_cube(sales: DataFrame, keys: Sequence[str] = ("sku_id",)) -> DataFrame:
    """Sales lines summed per item and supplier in one pass; money in cents.

    Lead times enter by their number, sum and sum of squares, so a cube has one row per pair. What
    vendors are told apart by reads either a cube or plain lines; a cube pays when several of them
    are wanted. Quantiles of lead times need the lines.
    """
    return _counted(sales).groupBy(*keys, "supplier_id").agg(*[F.sum(c).alias(c) for c in SUPPLY_SUMS])


def _lead_time_columns() -> list[Column]:
    days = F.col("lead_time_days").cast("double")
    dated = F.when(days.isNotNull(), F.col("orders"))
    return [F.percentile(days, F.lit(0.5), F.col("orders")).alias("lead_time_median"),
            (F.sum(F.col("lead_time_days") * F.col("orders")) / F.sum(dated)).alias("lead_time_mean"),
            F.percentile(days, F.lit(0.9), F.col("orders")).alias("lead_time_p90")]


def _list_price_column() -> Column:
    ratio = lambda a, b: F.round(F.try_divide(F.sum(a).cast("decimal(30,0)"), F.sum(b).cast("decimal(18,0)")), 0)
    price = F.when(F.sum("units") > 0, ratio("value", "units")).otherwise(ratio("price_sum", "orders"))
    return (price.cast("bigint") / 100).alias("weightage_list_price")


def _by_lead_time(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sales lines summed per item and lead time: lead times are whole days, so few rows of an item leave the first shuffle."""
    sums = ("orders", "units", "value", "price_sum")
    return _counted(lines).groupBy(*keys, "lead_time_days").agg(*[F.sum(c).alias(c) for c in sums])


def lead_time_statistics(lines: DataFrame, keys: Sequence[str] = ("sku_id",)) -> DataFrame:
    """Median, mean and 90th percentile of lead time per item. The state of a quantile is one count
    per distinct number of days."""
    return _counted(lines).groupBy(*keys).agg(*_lead_time_columns())


def weighted_list_price(lines: DataFrame, keys: Sequence[str] = ("sku_id",)) -> DataFrame:
    """Volume-weighted price; the plain mean where nothing was sold."""
    return _counted(lines).groupBy(*keys).agg(_list_price_column())


def item_statistics(lines: DataFrame, keys: Sequence[str] = ("sku_id",)) -> DataFrame:
    """Lead time and price of each item, from its lines counted by lead time."""
    return _by_lead_time(lines, keys).groupBy(*keys).agg(*_lead_time_columns(), _list_price_column())


def vendor_profile(lines: DataFrame, keys: Sequence[str] = ("sku_id",), min_orders: int = 10) -> DataFrame:
    """Per item and supplier: supplier count of the item and estimated defect rate.

    A supplier with fewer than ``min_orders`` orders takes the item's stock-out rate and a
    volatility of 1.
    """
    pair = _counted(lines).groupBy(*keys, "supplier_id").agg(
        F.sum("orders").alias("orders"), F.sum("stock_outs").alias("_out"),
        F.sum("lead_rows").alias("_n"), F.sum("lead_sum").alias("_s"), F.sum("lead_squares").alias("_ss"))
    n = F.col("_n")
    spread = F.sqrt(F.greatest(F.try_divide(F.col("_ss") - F.col("_s") * F.col("_s") / n, n - 1), F.lit(0.0)))
    # An item can have very many suppliers, so its totals come back to the pairs without a window over them.
    items = pair.groupBy(*keys).agg(F.count("*").alias("vendor_count"), (F.sum("_out") / F.sum("orders")).alias("_item_rate"), F.count("*").alias("_w"))
    both = attach_group_stats(pair.withColumn("_volatility", spread), items, list(keys), "_w")
    own = F.col("orders") >= min_orders
    volatility = F.when(own, F.col("_volatility") / 2.0).otherwise(F.lit(1.0))
    stock_out = F.when(own, F.col("_out") / F.col("orders")).otherwise(F.col("_item_rate"))
    defect = F.lit(0.012) + F.lit(0.004) * F.least(volatility, F.lit(2.0)) + F.lit(0.008) * stock_out
    return both.select(*keys, "supplier_id", "orders", "vendor_count", F.round(defect, 4).alias("vendor_defect_rate"))


def vendor_facts(lines: DataFrame, keys: Sequence[str] = ("sku_id",), candidates: DataFrame | None = None,
                 limit: int = 5, prices: DataFrame | None = None) -> DataFrame:
    """Cost, lead time, reliability and margin of the candidate suppliers of each item.

    Without ``candidates`` these are the ``limit`` suppliers with most orders. ``prices`` (keys,
    supplier_id, predicted_price) replaces the mean cost where it has one.
    """
    pair = _counted(lines).groupBy(*keys, "supplier_id").agg(
        F.sum("orders").alias("orders"), F.sum("stock_outs").alias("_out"), F.sum("cost_sum").alias("_cost"),
        F.sum("margin_sum").alias("_margin"), F.sum("lead_sum").alias("_lead"), F.sum("lead_rows").alias("_dated"))
    if candidates is None:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("orders"), "supplier_id"))
        pair = pair.withColumn("_r", rank).where(F.col("_r") <= limit)
    else:
        pair = pair.join(candidates.select(*keys, "supplier_id"), [*keys, "supplier_id"], "left_semi")
    n = F.col("orders")
    price = F.round(F.col("_cost").cast("decimal(28,0)") / n.cast("decimal(18,0)"), 0).cast("bigint") / 100
    if prices is not None:
        told = prices.select(*keys, "supplier_id", F.col("predicted_price").alias("_told"))
        pair, price = pair.join(told, [*keys, "supplier_id"], "left"), F.coalesce("_told", price)
    return pair.select(
        *keys, "supplier_id", price.alias("predicted_price"),
        F.round(F.col("_lead") / F.col("_dated"), 2).alias("lead_time"),
        F.round(F.lit(1.0) - F.col("_out") / n, 4).alias("reliability"), F.round(F.col("_margin") / n, 4).alias("margin_pct"))


def main_vendor(profile: DataFrame, keys: Sequence[str] = ("sku_id",)) -> DataFrame:
    """Supplier with most orders of each item, with the item's supplier count and its defect rate."""
    best = F.min_by(F.struct("supplier_id", "vendor_count", "vendor_defect_rate"), F.struct(-F.col("orders"), F.col("supplier_id")))
    picked = profile.groupBy(*keys).agg(best.alias("_best"))
    return picked.select(*keys, F.col("_best.supplier_id").alias("main_supplier_id"), "_best.vendor_count", "_best.vendor_defect_rate")


def top_suppliers(sales: DataFrame, keys: Sequence[str] = ("sku_id",), limit: int = 5) -> DataFrame:
    """Suppliers with most orders per item; ties go to the smaller id.

    Orders are counted before ranking, so the window holds one row per item and supplier.
    """
    counts = sales.groupBy(*keys, "supplier_id").agg(F.count("*").alias("orders"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("orders"), "supplier_id"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= limit)


def head_rows(series: DataFrame, n: int, keys: Sequence[str] = ("sku_id",), last: bool = False) -> DataFrame:
    """First or last ``n`` rows of a daily series per item."""
    order = F.desc("ds") if last else F.asc("ds")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return series.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")
