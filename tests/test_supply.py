"""The worked plan as a golden vector, and the edges of planning and procurement."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quaymart.operators import demand, diagnostics, forecasting, planning, procurement


@pytest.fixture(scope="module")
def plan(spark):
    """44,096 planned units over 30 days of which 12,027 fall into the first 7."""
    daily = [1718] * 6 + [1719] + [1394] * 22 + [1401]
    days = spark.createDataFrame([("SKU0001", i + 1, d) for i, d in enumerate(daily)], "sku_id string, day_no int, adjusted_plan long")
    facts = spark.createDataFrame([("SKU0001", 6.65, 260.10, 0.0164, 6.24, 248)],
                                  "sku_id string, lead_time double, rmse_error double, vendor_defect_rate double, weightage_list_price double, stock_on_hand long")
    return planning.inventory_plan(days, facts).cache()


def test_worked_plan(plan):
    row = plan.first()
    assert row["global_plan_demand_quantity"] == 44096
    assert row["mean_daily_forecast_demand"] == 1469.87
    assert (row["lead_time_days"], row["lead_time_demand"]) == (7, 12027)
    assert (row["safety_stock"], row["reorder_point"]) == (1136, 13163)
    assert (row["net_replenishment_quantity"], row["quality_adjusted_nrq"]) == (12915, 13131)
    assert row["global_plan_valuation"] == 275159.04
    assert row["days_of_supply"] == 0.17 and row["reorder_triggered"] == 1


VENDORS = [("SKU0001", "S055", 3.88, 6.34, 0.9713, 0.3725), ("SKU0001", "S028", 3.80, 6.48, 0.9591, 0.3589),
           ("SKU0001", "S015", 3.77, 6.59, 0.9776, 0.3691), ("SKU0001", "S057", 3.85, 6.53, 0.9813, 0.3429), ("SKU0001", "S014", 3.75, 6.52, 0.9690, 0.3649)]
FACTS = "sku_id string, supplier_id string, predicted_price double, lead_time double, reliability double, margin_pct double"


def test_worked_order(spark, plan):
    orders = plan.select("sku_id", procurement.order_quantity(F.col("quality_adjusted_nrq")).alias("order_quantity"), F.lit(1).alias("order_validation_flag"),
                         F.col("weightage_list_price").alias("list_price"))
    assert orders.first()["order_quantity"] == 13150
    ranked = procurement.vendor_scores(spark.createDataFrame(VENDORS, FACTS))
    best = [(r["supplier_id"], round(r["composite_score"], 4)) for r in ranked.orderBy("rank").collect()]
    assert best == [("S014", 0.6475), ("S015", 0.5936), ("S055", 0.5099), ("S028", 0.4322), ("S057", 0.3643)]
    split = procurement.allocate(ranked, orders)
    assert {r["supplier_id"]: r["allocated_quantity"] for r in split.collect()} == {"S014": 9250, "S015": 3900}
    checked = procurement.audit(split, orders)
    assert checked.first()["procurement_validation_status"] == "VALID"
    po = procurement.purchase_orders(split, checked, orders, "2026-09-12").first()
    assert (po["total_order_cost"], po["blended_unit_cost"], po["projected_gross_profit"]) == (49390.5, 3.76, 32665.5)
    assert po["po_status"] == "PURCHASE_ORDER_ISSUED" and po["expected_delivery_date"] == dt.date(2026, 9, 19)
    assert po["po_id"] == "PO-MULTI-SKU0001-20260912"


def _quantities(spark, q):
    return spark.createDataFrame([("a", q)], "sku_id string, order_quantity long")


def test_one_vendor_takes_the_whole_order(spark):
    ranked = procurement.vendor_scores(spark.createDataFrame([("a", "s1", 1.0, 5.0, 0.9, 0.3)], FACTS))
    rows = procurement.allocate(ranked, _quantities(spark, 700)).collect()
    assert [(r["supplier_id"], r["allocated_quantity"], r["allocation_share_percent"]) for r in rows] == [("s1", 700, 100.0)]


@pytest.mark.parametrize("quantity,want", [(0, []), (600, [500, 500]), (1000, [500, 500]), (1600, [1100, 500]), (2000, [1400, 600])])
def test_minimum_order_repair(spark, quantity, want):
    ranked = procurement.vendor_scores(spark.createDataFrame([("a", "s1", 1.0, 5.0, 0.9, 0.3), ("a", "s2", 2.0, 6.0, 0.8, 0.2)], FACTS))
    rows = procurement.allocate(ranked, _quantities(spark, quantity)).orderBy("rank").collect()
    assert [r["allocated_quantity"] for r in rows] == want


def test_order_without_vendor_is_invalid(spark):
    orders = spark.createDataFrame([("a", 1, 5.0)], "sku_id string, order_validation_flag int, list_price double")
    none = procurement.allocate(procurement.vendor_scores(spark.createDataFrame([], FACTS)), _quantities(spark, 900))
    row = procurement.audit(none, orders).first()
    assert row["check_vendor_eligibility"] == "FAIL" and row["procurement_validation_flag"] == 0


def test_missing_fact_gives_null_not_a_guess(spark):
    days = spark.createDataFrame([("a", 1, 10)], "sku_id string, day_no int, adjusted_plan long")
    facts = spark.createDataFrame([("a", 3.0, None, 0.01, 2.0, 5)],
                                  "sku_id string, lead_time double, rmse_error double, vendor_defect_rate double, weightage_list_price double, stock_on_hand long")
    assert planning.inventory_plan(days, facts).first()["safety_stock"] is None


def _daily(spark, values, start=dt.date(2024, 1, 1)):
    return spark.createDataFrame([("a", start + dt.timedelta(days=i), v) for i, v in enumerate(values) if v is not None], "sku_id string, ds date, y long")


def test_short_history_has_no_trend(spark):
    row = demand.trend_momentum(_daily(spark, [5] * 89)).first()
    assert (row["trend_ratio"], row["trend_adjustment"]) == (1.0, 1.0)
    row = demand.trend_momentum(_daily(spark, [10] * 60 + [5] * 30)).first()
    assert row["trend_ratio"] == 0.6 and row["trend_adjustment"] == 0.9


def test_demand_classes(spark):
    cases = {"Smooth": [5] * 20, "Intermittent": [5, 0] * 10, "Erratic": [1, 20] * 10, "Lumpy": [1, 0, 0, 30] * 6}
    for name, values in cases.items():
        assert diagnostics.demand_class(_daily(spark, values)).first()["demand_class"] == name


def test_baseline_needs_no_luck(spark):
    flat = forecasting.seasonal_baseline(_daily(spark, [10] * 30), 5).where("y IS NULL").collect()
    assert len(flat) == 5 and all(r["yhat"] == pytest.approx(10) and r["yhat_lower"] == pytest.approx(10) for r in flat)
    single = forecasting.seasonal_baseline(_daily(spark, [4]), 3).where("y IS NULL").collect()
    assert [r["yhat"] for r in single] == [4.0, 4.0, 4.0]
    falling = forecasting.seasonal_baseline(_daily(spark, [10 - i for i in range(10)]), 60).collect()
    assert min(r["yhat"] for r in falling) == 0.0


def test_regressor_model_finds_the_promotion(spark):
    rows = [("a", dt.date(2024, 1, 1) + dt.timedelta(days=i), 100 + (40 if i % 5 == 0 else 0), int(i % 5 == 0)) for i in range(200)]
    frame = spark.createDataFrame(rows, "sku_id string, ds date, y long, promo_flag int")
    fit = forecasting.regressor_forecast(frame, ["promo_flag"], 14).toPandas()
    known = fit[fit["y"].notna()]
    assert (known["y"] - known["yhat"]).abs().max() < 2
    assert fit[fit["y"].isna()]["yhat"].between(90, 110).all()


def test_gap_filling(spark):
    out = forecasting.regularised(_daily(spark, [10, None, None, 16])).orderBy("ds").collect()
    assert [r["y"] for r in out] == [10.0, 12.0, 14.0, 16.0] and [r["filled"] for r in out] == [0, 1, 1, 0]


def test_accuracy_edges(spark):
    pairs = spark.createDataFrame([("m", 0.0, 1.0), ("m", 10.0, 8.0), ("m", None, 3.0)], "model string, y double, yhat double")
    row = forecasting.accuracy(pairs, ["model"]).first()
    assert (row["n_days"], row["mae"], row["mape_percent"], row["wmape_percent"], row["bias"]) == (2, 1.5, 20.0, 30.0, -0.5)


def test_predictions_cover_every_pair(spark):
    from quaymart.operators.predictors import lead_time_predictions, unit_cost_predictions

    day = "2024-01-0"
    rows = [("a", "s1", f"{day}{i % 9 + 1}", float(4 + i % 3), 10.0, 5, 0, 0.0) for i in range(30)] + [("a", "s2", f"{day}1", None, None, 5, 0, None), ("b", "s2", f"{day}2", 9.0, 20.0, None, None, 0.1)]
    sales = spark.createDataFrame(rows, "sku_id string, supplier_id string, date string, lead_time_days double, purchase_cost double, units_sold int, promo_flag int, discount_pct double") \
        .withColumn("date", F.col("date").cast("date"))
    days = {(r["sku_id"], r["supplier_id"]): r["predicted_lead_time"] for r in lead_time_predictions(sales).collect()}
    cost = {(r["sku_id"], r["supplier_id"]): r["predicted_price"] for r in unit_cost_predictions(sales).collect()}
    assert set(days) == set(cost) == {("a", "s1"), ("a", "s2"), ("b", "s2")}
    assert all(4 <= x <= 9 for x in days.values()) and all(10 <= x <= 20 for x in cost.values())


def test_learned_run_uses_the_models(spark):
    import __spark_entry__ as entry

    rows = entry.queries()["k11_learned_execution"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(1 <= r["lead_time_days"] <= 14 for r in rows)


def _lines(spark, rows):
    return spark.createDataFrame(rows, "sku_id string, supplier_id long, date string, lead_time_days int, purchase_cost double, list_price double, margin_pct double, "
                                       "units_sold int, stock_out_flag int, promo_flag int, discount_pct double").withColumn("date", F.col("date").cast("date"))


SALES = [("ab"[i % 2] if i % 11 else None, i % 3 if i % 7 else None, f"2024-01-{i % 28 + 1:02}", 1 + i % 14 if i % 5 else None, 3.0 + i % 4, 9.0 + i % 5, 0.1 * (i % 4), 1 + i % 6,
          i % 2, i % 3 % 2, 0.01 * (i % 8)) for i in range(300)]


def test_cube_has_a_row_per_pair_and_says_what_the_lines_say(spark):
    lines = _lines(spark, SALES)
    cube = demand.supply_cube(lines)
    assert cube.count() == lines.select("sku_id", "supplier_id").distinct().count()
    for told in (demand.vendor_profile, demand.vendor_facts):
        one, other = told(lines).toPandas(), told(cube).toPandas()
        order = ["sku_id", "supplier_id"]
        one, other = (x.sort_values(order).reset_index(drop=True) for x in (one, other))
        assert len(one) and one.equals(other)
    frame = lines.toPandas()
    got = {r["sku_id"]: r for r in demand.item_statistics(lines).collect()}
    for sku, group in frame.groupby("sku_id"):
        days = group["lead_time_days"].dropna()
        assert (got[sku]["lead_time_median"], got[sku]["lead_time_mean"]) == (days.median(), pytest.approx(days.mean()))
        assert got[sku]["lead_time_p90"] == pytest.approx(days.quantile(0.9))


def _counted_lines(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def passing(units):
        seen.add(1)
        return units

    return _lines(spark, SALES).withColumn("units_sold", passing.asNondeterministic()("units_sold")), seen


def test_sales_lines_are_made_once(spark):
    from quaymart.operators.predictors import unit_cost_predictions
    from quaymart.plans.order_execution import learned_execution

    sales, seen = _counted_lines(spark)
    assert unit_cost_predictions(sales, trees=2).count() == 6 and seen.value == len(SALES)
    sales, seen = _counted_lines(spark)
    stock = spark.createDataFrame([("a", 10), ("b", 10)], "sku_id string, stock_on_hand long")
    assert learned_execution(sales, stock, "2026-01-05").where("sku_id IS NOT NULL").count() == 2 and seen.value == len(SALES)


def test_means_leave_the_own_label_out_and_missing_keys_keep_the_other_history(spark):
    from quaymart.operators import predictors
    from quaymart.operators.scale import attach_group_stats

    lines = _lines(spark, SALES).withColumn("_pair", F.struct("sku_id", "supplier_id"))
    found = predictors._histories(lines, "purchase_cost").withColumn("_pair", F.struct("sku_id", "supplier_id")).drop("sku_id", "supplier_id", "_usual")
    out = predictors._with_means(attach_group_stats(lines, found, ["_pair"], "_rows"), 5.0, F.col("purchase_cost")).toPandas()
    assert len(out) == len(SALES)
    for _, row in out.iterrows():
        want = {}
        for name, keys in (("supplier_mean", ["supplier_id"]), ("item_mean", ["sku_id"]), ("pair_mean", ["sku_id", "supplier_id"])):
            same = out if all(row[k] == row[k] and row[k] is not None for k in keys) else out[:0]
            for k in keys:
                same = same[same[k] == row[k]]
            left = (same["purchase_cost"].sum() - row["purchase_cost"]) / (len(same) - 1) if len(same) > 1 else None
            want[name] = left if left is not None else want["supplier_mean"] if name == "pair_mean" else 5.0
        assert all(row[k] == pytest.approx(v) for k, v in want.items())
