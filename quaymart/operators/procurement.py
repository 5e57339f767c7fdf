"""Supplier scoring, order split, audit and purchase-order roll-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import batch_ceiling

SCORE_WEIGHTS = {"price": 0.40, "lead_time": 0.30, "reliability": 0.20, "margin": 0.10}


def order_quantity(need: Column, moq: int = 500, batch: int = 50) -> Column:
    """Required units, at least the minimum order, in whole batches; 0 where nothing is needed."""
    return F.when(need > 0, batch_ceiling(F.greatest(need.cast("double"), F.lit(float(moq))), batch)).otherwise(F.lit(0)).cast("bigint")


def order_gate(position: Column, reorder_point: Column, quantity: Column) -> Column:
    return ((position <= reorder_point) & (quantity > 0)).cast("int")


def vendor_scores(facts: DataFrame, keys: Sequence[str] = ("sku_id",)) -> DataFrame:
    """Weighted score of min-max scaled criteria and the rank it gives.

    ``facts`` holds a few candidates per item, so the windows are small.
    """
    item = Window.partitionBy(*keys)

    def scaled(name: str, lower_is_better: bool) -> Column:
        low, high = F.min(name).over(item), F.max(name).over(item)
        share = (F.col(name) - low) / F.when(high == low, F.lit(1.0)).otherwise(high - low)
        return F.lit(1.0) - share if lower_is_better else share

    scored = facts.select(
        "*", scaled("predicted_price", True).alias("score_price"), scaled("lead_time", True).alias("score_lead_time"),
        scaled("reliability", False).alias("score_reliability"), scaled("margin_pct", False).alias("score_margin"))
    w = SCORE_WEIGHTS
    total = (F.lit(w["price"]) * F.col("score_price") + F.lit(w["lead_time"]) * F.col("score_lead_time")
             + F.lit(w["reliability"]) * F.col("score_reliability") + F.lit(w["margin"]) * F.col("score_margin"))
    scored = scored.withColumn("composite_score", F.round(total, 6))
    rank = F.row_number().over(item.orderBy(F.desc("composite_score"), "supplier_id"))
    return scored.withColumn("rank", rank)


def allocate(ranked: DataFrame, quantities: DataFrame, keys: Sequence[str] = ("sku_id",), moq: int = 500,
             batch: int = 50, primary_share: float = 0.70) -> DataFrame:
    """Split each item's order over its two best suppliers; a single supplier takes all of it.

    ``quantities`` has the item keys and ``order_quantity``.
    """
    item = Window.partitionBy(*keys)
    top = (ranked.where(F.col("rank") <= 2).withColumn("_sources", F.count("*").over(item))
           .join(quantities.select(*keys, "order_quantity"), list(keys)).where(F.col("order_quantity") > 0))
    total = F.col("order_quantity")
    main = F.greatest(batch_ceiling(total * F.lit(primary_share), batch), F.lit(moq))
    rest = total - main
    # A second share below the minimum order is lifted to it when the order can carry that.
    lifted = batch_ceiling(rest, batch)
    short = (rest < moq) & (total > moq)
    second = F.when(short, F.greatest(lifted, F.lit(moq))).otherwise(rest)
    first = F.when(short & (lifted < moq), F.greatest(F.lit(moq), total - F.lit(moq))).otherwise(main)
    units = (F.when(F.col("_sources") == 1, total).when(F.col("rank") == 1, first).otherwise(second)).cast("bigint")
    out = top.withColumn("allocated_quantity", units)
    return out.select(
        *keys, "supplier_id", "rank", "composite_score", "predicted_price", "lead_time", "reliability", "order_quantity",
        "allocated_quantity", F.round(F.col("allocated_quantity") / total * 100, 1).alias("allocation_share_percent"),
        F.round(F.col("allocated_quantity") * F.col("predicted_price"), 2).alias("order_cost"))


def audit(allocations: DataFrame, orders: DataFrame, keys: Sequence[str] = ("sku_id",), moq: int = 500,
          longest_lead_time: float = 12.0) -> DataFrame:
    """Five checks per purchase order. ``orders`` has ``order_validation_flag`` and ``list_price`` per item."""
    joined = orders.select(*keys, "order_validation_flag", "list_price").join(allocations, list(keys), "left")
    # An order without a supplier has nothing to fail on except the supplier check itself.
    every = lambda test: F.coalesce(F.bool_and(test), F.lit(True))
    checks = joined.groupBy(*keys).agg(
        F.bool_and(F.col("order_validation_flag") == 1).alias("check_order_trigger"),
        every(F.col("allocated_quantity") >= moq).alias("check_quantity_moq"),
        ((F.count("supplier_id") > 0) & every(F.col("composite_score") > 0)).alias("check_vendor_eligibility"),
        every(F.col("predicted_price") < F.col("list_price")).alias("check_price_profitability"),
        every(F.col("lead_time") <= longest_lead_time).alias("check_lead_time_compliance"))
    names = [c for c in checks.columns if c.startswith("check_")]
    passed = F.lit(True)
    for n in names:
        passed = passed & F.col(n)
    return checks.select(*keys, *[F.when(F.col(n), "PASS").otherwise("FAIL").alias(n) for n in names],
                         passed.cast("int").alias("procurement_validation_flag"),
                         F.when(passed, "VALID").otherwise("INVALID").alias("procurement_validation_status"))


def purchase_orders(allocations: DataFrame, audits: DataFrame, prices: DataFrame, as_of: str,
                    keys: Sequence[str] = ("sku_id",)) -> DataFrame:
    """Order totals, blended cost, projected profit, status and delivery date per item.

    ``prices`` has ``list_price`` per item; ``as_of`` is the order date.
    """
    main_lead = F.max(F.when(F.col("rank") == 1, F.col("lead_time")))
    totals = allocations.groupBy(*keys).agg(
        F.sum("allocated_quantity").cast("bigint").alias("order_quantity"),
        F.round(F.sum("order_cost"), 2).alias("total_order_cost"), main_lead.alias("_lead"))
    out = totals.join(audits.select(*keys, "procurement_validation_flag"), list(keys)).join(
        prices.select(*keys, "list_price"), list(keys), "left")
    day = F.lit(as_of).cast("date")
    key_text = F.concat_ws("-", *[F.col(k).cast("string") for k in keys])
    return out.select(
        *keys, F.concat(F.lit("PO-MULTI-"), key_text, F.lit("-"), F.date_format(day, "yyyyMMdd")).alias("po_id"),
        day.alias("po_date"), F.date_add(day, F.bround("_lead").cast("int")).alias("expected_delivery_date"),
        "order_quantity", "total_order_cost",
        F.when(F.col("order_quantity") > 0, F.round(F.col("total_order_cost") / F.col("order_quantity"), 2))
         .otherwise(F.lit(0.0)).alias("blended_unit_cost"),
        F.round(F.col("order_quantity") * F.col("list_price") - F.col("total_order_cost"), 2).alias("projected_gross_profit"),
        F.when(F.col("procurement_validation_flag") == 1, "PURCHASE_ORDER_ISSUED").otherwise("HOLD_FOR_REVIEW").alias("po_status"))
