"""From sales history to audited purchase orders, for all items in one set of jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import demand, forecasting, planning, predictors, procurement
from ..session import shared, written

PLAN_COLUMNS = ("date", "supplier_id", "units_sold", "lead_time_days", "stock_out_flag", "list_price", "purchase_cost", "margin_pct")


def sales_table(sales: DataFrame, keys: Sequence[str] = ("sku_id",), more: Sequence[str] = ()) -> DataFrame:
    """The columns of the sales lines that a plan and its orders read, and ``more``, as a table: joins behind them run once."""
    return written(sales.select(*keys, *[c for c in PLAN_COLUMNS if c in sales.columns], *more))


def plan_facts(sales: DataFrame, cube: DataFrame, inventory: DataFrame, keys: Sequence[str] = ("sku_id",),
               predicted_lead_time: DataFrame | None = None) -> DataFrame:
    """Per-item inputs of the plan. The defect rate is that of the item's main supplier.

    ``predicted_lead_time`` takes precedence over the median. With a ``supplier_id`` its rows are of
    pairs, and the one of the item's main supplier counts.
    """
    keys = list(keys)
    vendor = demand.main_vendor(demand.vendor_profile(cube, keys), keys)
    facts = demand.item_statistics(sales, keys).join(vendor, keys).join(inventory, keys, "left")
    predicted = None
    if predicted_lead_time is not None:
        told = predicted_lead_time
        if "supplier_id" in told.columns:
            told = told.select(*keys, F.col("supplier_id").alias("main_supplier_id"), "predicted_lead_time")
            facts = facts.join(told, [*keys, "main_supplier_id"], "left")
        else:
            facts = facts.join(told.select(*keys, "predicted_lead_time"), keys, "left")
        predicted = F.col("predicted_lead_time")
    value, source = planning.chosen_lead_time(None, predicted, F.col("lead_time_median"))
    return facts.withColumn("lead_time", value).withColumn("lead_time_source", source)


def demand_plan(sales: DataFrame, inventory: DataFrame, keys: Sequence[str] = ("sku_id",), horizon: int = 30,
                predicted_lead_time: DataFrame | None = None, cube: DataFrame | None = None,
                lines: DataFrame | None = None) -> DataFrame:
    """Plan per item. Raw lines are read three times: for the daily panel, the supply cube and the lead times.

    Lines that cost a join should therefore be a table; ``sales_table`` makes one of what is needed.
    ``lines`` may give the sales lines of the daily panel without lead times.
    """
    daily = shared(demand.daily_demand((sales if lines is None else lines).select(*keys, "date", "units_sold"), keys))
    cube = shared(demand.supply_cube(sales, keys)) if cube is None else cube
    ahead = forecasting.seasonal_baseline(daily, horizon, keys).where(F.col("y").isNull())
    ahead = ahead.withColumn("yhat", F.round("yhat", 2))
    days = planning.consensus_days(ahead, demand.trend_momentum(daily, keys), keys, horizon)
    facts = plan_facts(sales, cube, inventory, keys, predicted_lead_time)
    return shared(planning.inventory_plan(days, facts, keys))


def procure(cube: DataFrame, plan: DataFrame, as_of: str, keys: Sequence[str] = ("sku_id",), moq: int = 500,
            batch: int = 50, prices: DataFrame | None = None) -> dict[str, DataFrame]:
    """Supplier ranking, allocations, audit and purchase orders for a plan; ``prices`` as in ``vendor_facts``."""
    keys = list(keys)
    quantity = procurement.order_quantity(F.col("quality_adjusted_nrq"), moq, batch)
    orders = plan.select(
        *keys, quantity.alias("order_quantity"), F.col("weightage_list_price").alias("list_price"),
        procurement.order_gate(F.col("inventory_position"), F.col("reorder_point"), quantity).alias("order_validation_flag"))
    ranked = procurement.vendor_scores(demand.vendor_facts(cube, keys, prices=prices), keys)
    allocations = shared(procurement.allocate(ranked, orders, keys, moq, batch))
    audit = procurement.audit(allocations, orders, keys, moq)
    return {"gate": orders, "ranked": ranked, "allocations": allocations, "audit": audit,
            "orders": procurement.purchase_orders(allocations, audit, orders, as_of, keys)}


def order_execution(sales: DataFrame, inventory: DataFrame, as_of: str, keys: Sequence[str] = ("sku_id",),
                    lines: DataFrame | None = None, predicted_lead_time: DataFrame | None = None, prices: DataFrame | None = None) -> DataFrame:
    """One row per item: plan, gate and resulting order."""
    keys = list(keys)
    cube = shared(demand.supply_cube(sales, keys))
    plan = demand_plan(sales, inventory, keys, predicted_lead_time=predicted_lead_time, cube=cube, lines=lines)
    bought = procure(cube, plan, as_of, keys, prices=prices)
    order = bought["orders"].select(*keys, "po_id", "order_quantity", "total_order_cost", "po_status", "expected_delivery_date")
    gate = bought["gate"].select(*keys, "order_validation_flag")
    return plan.join(gate, keys).join(order, keys, "left").fillna({"order_quantity": 0, "total_order_cost": 0.0})


def learned_execution(sales: DataFrame, inventory: DataFrame, as_of: str, lines: DataFrame | None = None) -> DataFrame:
    """The order run on learned lead times and learned supplier prices, per ``sku_id``. The lines are made a table first."""
    sales = sales_table(sales, more=("promo_flag", "discount_pct"))
    return order_execution(sales, inventory, as_of, lines=lines, predicted_lead_time=shared(predictors.lead_time_predictions(sales, kept=True)),
                           prices=shared(predictors.unit_cost_predictions(sales, kept=True)))
