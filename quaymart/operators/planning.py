"""Sales and operations plan: consensus demand, lead time, safety stock, replenishment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def consensus_days(forecast: DataFrame, trend: DataFrame, keys: Sequence[str] = ("sku_id",), horizon: int = 30,
                   buffer: float = 0.05) -> DataFrame:
    """Planned units per day: forecast x trend adjustment x (1 + buffer), rounded up.

    The first ``horizon`` forecast days of each item count; pass only days after the last actual.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("ds"))
    days = forecast.where(F.col("yhat").isNotNull()).withColumn("day_no", place).where(F.col("day_no") <= horizon)
    lifted = days.join(trend.select(*keys, "trend_ratio", "trend_adjustment"), list(keys), "left")
    adjusted = F.ceil(F.col("yhat") * F.coalesce(F.col("trend_adjustment"), F.lit(1.0)) * F.lit(1.0 + buffer))
    return lifted.withColumn("adjusted_plan", adjusted.cast("bigint"))


def consensus_demand(days: DataFrame, keys: Sequence[str] = ("sku_id",)) -> DataFrame:
    return days.groupBy(*keys).agg(
        F.round(F.sum("yhat"), 2).alias("raw_forecast_demand_quantity"),
        F.sum("adjusted_plan").cast("bigint").alias("global_plan_demand_quantity"),
        F.round(F.avg("adjusted_plan"), 2).alias("mean_daily_forecast_demand"),
        F.first("trend_ratio").alias("trend_ratio_30_90"), F.first("trend_adjustment").alias("trend_adjustment"))


def chosen_lead_time(manual=None, predicted=None, median=None) -> tuple[Column, Column]:
    """Lead time and its source: a manual value, else the model, else the median in whole days."""
    none = F.lit(None).cast("double")
    manual, predicted, median = (none if c is None else c.cast("double") for c in (manual, predicted, median))
    value = F.coalesce(manual, predicted, F.ceil(F.greatest(median, F.lit(1.0))).cast("double"))
    source = (F.when(manual.isNotNull(), "manual").when(predicted.isNotNull(), "model")
              .when(median.isNotNull(), "historical median").otherwise("unknown"))
    return value, source


def inventory_plan(days: DataFrame, facts: DataFrame, keys: Sequence[str] = ("sku_id",), z: float = 1.65) -> DataFrame:
    """Lead-time demand, safety stock, reorder point and replenishment per item.

    ``facts`` has one row per item: ``lead_time``, ``vendor_defect_rate``, ``weightage_list_price``,
    ``stock_on_hand`` and optionally ``in_transit`` and ``backorders``; the forecast error is its
    ``rmse_error`` or, without one, the fit error that came with the forecast. A missing fact gives
    a NULL result for what depends on it.
    """
    for name in ("in_transit", "backorders"):
        if name not in facts.columns:
            facts = facts.withColumn(name, F.lit(0).cast("bigint"))
    carried = "rmse_error" not in facts.columns
    error = [F.round(F.max("fit_rmse"), 2).alias("rmse_error")] if carried else []
    # The days of one item are at most the planning horizon, so they fit in an array.
    totals = days.groupBy(*keys).agg(
        F.sum("adjusted_plan").cast("bigint").alias("global_plan_demand_quantity"),
        F.round(F.avg("adjusted_plan"), 2).alias("mean_daily_forecast_demand"),
        F.collect_list(F.struct("day_no", "adjusted_plan")).alias("_days"), *error)
    plan = totals.join(facts, list(keys), "left")
    plan = plan.withColumn("lead_days", F.ceil(F.greatest(F.col("lead_time"), F.lit(1.0))).cast("int"))
    soon = F.filter("_days", lambda d: d["day_no"] <= F.col("lead_days"))
    plan = plan.withColumn("lead_time_demand", F.aggregate(soon, F.lit(0).cast("bigint"), lambda acc, d: acc + d["adjusted_plan"]))
    safety = F.ceil(F.lit(z) * F.col("rmse_error") * F.sqrt(F.col("lead_days").cast("double"))).cast("bigint")
    plan = plan.withColumn("safety_stock", safety)
    plan = plan.withColumn("reorder_point", F.col("lead_time_demand") + F.col("safety_stock"))
    plan = plan.withColumn("inventory_position", (F.col("stock_on_hand") + F.col("in_transit") - F.col("backorders")).cast("bigint"))
    plan = plan.withColumn("net_replenishment_quantity",
                           F.greatest(F.col("reorder_point") - F.col("inventory_position"), F.lit(0)).cast("bigint"))
    defect, need = F.col("vendor_defect_rate"), F.col("net_replenishment_quantity")
    plan = plan.withColumn("quality_adjusted_nrq", F.when((defect < 1.0) & (need > 0), F.ceil(need / (F.lit(1.0) - defect)))
                           .otherwise(need).cast("bigint"))
    daily = F.col("mean_daily_forecast_demand")
    return plan.select(
        *keys, "global_plan_demand_quantity", "mean_daily_forecast_demand",
        F.col("lead_days").alias("lead_time_days"), "lead_time_demand", "safety_stock", "reorder_point",
        F.col("stock_on_hand").cast("bigint").alias("stock_on_hand"), "inventory_position", "net_replenishment_quantity",
        "quality_adjusted_nrq", "weightage_list_price", "vendor_defect_rate",
        F.round(F.col("global_plan_demand_quantity") * F.col("weightage_list_price"), 2).alias("global_plan_valuation"),
        F.when(daily > 0, F.round(F.col("stock_on_hand") / daily, 2)).otherwise(F.lit(0.0)).alias("days_of_supply"),
        (F.col("inventory_position") <= F.col("reorder_point")).cast("int").alias("reorder_triggered"))
