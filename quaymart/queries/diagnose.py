"""Diagnostic and profile queries."""

from pyspark.sql import functions as F

from ..functions.naming import detect_roles, primary_key_guess, readiness_scores
from ..operators import columns, demand, diagnostics, selection
from ..sources import bindings, readers
from .registry import query
from .sqlbase import SALES, USER_DAYS, with_ctes

r = F.round
ITEM_DAILY = "daily AS (SELECT sku_id, date AS ds, CAST(sum(units_sold) AS DOUBLE) AS y FROM sales GROUP BY 1, 2)"
BRAND_DAILY = "daily AS (SELECT brand AS sku_id, date AS ds, CAST(sum(units_sold) AS DOUBLE) AS y FROM sales GROUP BY 1, 2)"


def _items(spark, sf):
    return demand.daily_demand(bindings.sales(spark, sf))


def _brands(spark, sf):
    return demand.daily_demand(bindings.brand_lines(spark, sf))


@query("a8_supplier_concentration", with_ctes(SALES, """
c AS (SELECT brand, supplier_id, count(*) AS n FROM sales GROUP BY 1, 2),
g AS (SELECT brand, count(*) AS k, max(n) * 100.0::DOUBLE / sum(n) AS top, CAST(round(sum(CAST(n AS DOUBLE) * n) / (CAST(sum(n) AS DOUBLE) * sum(n)) * 10000) AS BIGINT) AS hhi FROM c GROUP BY 1)""", """
SELECT brand, k AS active_suppliers, round(top, 1) AS top_supplier_share_pct, hhi AS hhi_index,
  CASE WHEN k >= 3 AND top <= 50 THEN 'Resilient Multi-Vendor Ecosystem' WHEN k >= 2 AND top <= 80 THEN 'Moderate Vendor Concentration'
       ELSE 'High Single-Source Vulnerability' END AS vendor_resilience_rating FROM g"""))
def a8(spark, sf):
    return diagnostics.supplier_concentration(bindings.sales(spark, sf, parts=True), ["brand"])


@query("a9_cost_margin", with_ctes(SALES, """
g AS (SELECT sku_id, min(cost_cents) / 100.0::DOUBLE AS lo, max(cost_cents) / 100.0::DOUBLE AS hi, sum(cost_cents) / CAST(count(*) AS DOUBLE) / 100 AS mc,
             sum(list_cents) / CAST(count(*) AS DOUBLE) / 100 AS mp, sum(list_cents * units_sold) / 100.0::DOUBLE AS rev FROM sales GROUP BY 1),
h AS (SELECT *, CASE WHEN mp > 0 THEN (mp - mc) / mp * 100 END AS margin FROM g)""", """
SELECT sku_id, lo AS min_cost, mc AS mean_cost, hi AS max_cost, round(hi / greatest(0.0001::DOUBLE, lo), 1) AS cost_spread_ratio,
  round(margin, 2) AS avg_gross_margin_pct, CASE WHEN margin > 40 THEN 'Robust Enterprise Margin Cushion' WHEN margin > 20 THEN 'Healthy Operational Margin'
  ELSE 'Compressed Margin' END AS margin_health_rating, round(rev, 0) AS total_revenue FROM h"""))
def a9(spark, sf):
    return diagnostics.cost_and_margin(bindings.sales(spark, sf), ["sku_id"])


@query("a10_weekday_pattern", with_ctes(SALES, """
d AS (SELECT sku_id, dayname(date) AS dow, sum(units_sold) AS u, count(*) AS n FROM sales GROUP BY 1, 2),
g AS (SELECT sku_id, arg_min(dow, row(-u / CAST(n AS DOUBLE), dow)) AS peak_dow, arg_min(dow, row(u / CAST(n AS DOUBLE), dow)) AS trough_dow,
   sum(u) FILTER (dow IN ('Saturday', 'Sunday')) / CAST(sum(n) FILTER (dow IN ('Saturday', 'Sunday')) AS DOUBLE) AS we,
   sum(u) FILTER (dow NOT IN ('Saturday', 'Sunday')) / CAST(sum(n) FILTER (dow NOT IN ('Saturday', 'Sunday')) AS DOUBLE) AS wd FROM d GROUP BY 1)""", """
SELECT sku_id, peak_dow, trough_dow, CAST(CASE WHEN we > 0 AND wd > 0 THEN round((we - wd) / wd * 100, 1) ELSE 0 END AS DOUBLE) AS weekend_lift_pct FROM g"""))
def a10(spark, sf):
    return diagnostics.weekday_pattern(bindings.sales(spark, sf))


@query("a11_month_pattern", with_ctes(SALES, """
m AS (SELECT sku_id, monthname(date) AS mon, avg(units_sold) AS a FROM sales GROUP BY 1, 2)""", """
SELECT sku_id, arg_min(mon, row(-a, mon)) AS peak_month, arg_min(mon, row(a, mon)) AS trough_month,
  round(max(a) / greatest(0.0001::DOUBLE, min(a)), 6) AS monthly_amplitude_ratio FROM m GROUP BY 1 HAVING count(*) >= 2"""))
def a11(spark, sf):
    return diagnostics.month_pattern(bindings.sales(spark, sf)).withColumn("monthly_amplitude_ratio", r("monthly_amplitude_ratio", 6))


@query("a12_linear_trend", with_ctes(SALES, BRAND_DAILY, """
ix AS (SELECT sku_id, y, CAST(row_number() OVER (PARTITION BY sku_id ORDER BY ds) - 1 AS DOUBLE) AS x FROM daily),
f AS (SELECT sku_id, count(*) AS n, avg(y) AS m, regr_slope(y, x) AS s, regr_r2(y, x) AS r2, var_pop(y) AS v FROM ix GROUP BY 1 HAVING count(*) >= 4),
g AS (SELECT sku_id, CASE WHEN m > 0 THEN s * n / m * 100 ELSE 0 END AS pace, CASE WHEN v > 0 THEN greatest(r2, 0) ELSE 0 END AS r2 FROM f)""", """
SELECT sku_id, round(pace, 1) AS trend_slope_pct, round(r2, 3) AS trend_r2, CASE WHEN pace > 15 AND r2 >= 0.2 THEN 'Strong Upward Growth'
  WHEN pace > 5 THEN 'Moderate Upward Pace' WHEN pace < -15 AND r2 >= 0.2 THEN 'Steep Downward Contraction' WHEN pace < -5 THEN 'Moderate Downward Pace'
  ELSE 'Stable / Stationary Demand' END AS trend_direction FROM g"""))
def a12(spark, sf):
    return diagnostics.linear_trend(_brands(spark, sf))


@query("a13_demand_class", with_ctes(SALES, ITEM_DAILY, """
g AS (SELECT sku_id, count(*) / CAST(greatest(count(*) FILTER (y > 0), 1) AS DOUBLE) AS adi, coalesce(pow(stddev_pop(y) FILTER (y > 0) / avg(y) FILTER (y > 0), 2), 0) AS cv2 FROM daily GROUP BY 1)""", """
SELECT sku_id, round(adi, 2) AS adi, round(cv2, 3) AS cv2, CASE WHEN adi < 1.32 AND cv2 < 0.49 THEN 'Smooth' WHEN adi >= 1.32 AND cv2 < 0.49 THEN 'Intermittent'
  WHEN adi < 1.32 THEN 'Erratic' ELSE 'Lumpy' END AS demand_class FROM g"""))
def a13(spark, sf):
    return diagnostics.demand_class(_items(spark, sf))


@query("a14_cadence", with_ctes(SALES, BRAND_DAILY, """
g AS (SELECT sku_id, min(ds) AS a, max(ds) AS b, count(DISTINCT ds) AS k FROM daily GROUP BY 1)""", """
SELECT sku_id, a AS first_day, b AS last_day, k AS active_days, CAST(date_diff('day', a, b) + 1 AS INTEGER) AS calendar_days,
  CASE WHEN date_diff('day', a, b) + 1 > 1 AND k / CAST(date_diff('day', a, b) + 1 AS DOUBLE) > 0.65 THEN 'Daily Intervals'
       WHEN k > 4 AND k / greatest(1.0, (date_diff('day', a, b) + 1) / 7.0) > 0.5 THEN 'Weekly Cadence' ELSE 'Irregular / Batch Cadence' END AS cadence FROM g"""))
def a14(spark, sf):
    return diagnostics.cadence(_brands(spark, sf))


@query("a15_inventory_exposure", with_ctes(SALES, ITEM_DAILY, """
m AS (SELECT sku_id, round(avg(y), 1) AS dm FROM daily GROUP BY 1),
g AS (SELECT sku_id, count(*) AS n, sum(stock_out_flag) AS so, CAST(max(row(date, stock_on_hand))[2] AS DOUBLE) AS cs, avg(stock_on_hand) AS ms, avg(units_sold) AS um FROM sales GROUP BY 1),
h AS (SELECT g.*, cs / greatest(1.0, CASE WHEN dm > 0 THEN dm WHEN ms > 0 THEN ms / 30 ELSE 1 END) AS ds, so / CAST(n AS DOUBLE) * 100 AS pct FROM g JOIN m USING (sku_id))""", """
SELECT sku_id, cs AS current_stock, round(ms, 4) AS mean_stock, round(ds, 1) AS days_of_supply, CAST(so AS BIGINT) AS stockout_rows, round(pct, 2) AS stockout_rate_pct,
  CAST(round(so * um) AS BIGINT) AS estimated_lost_units, CASE WHEN ds < 7 OR pct > 8 THEN 'Critical Stockout Exposure (Underbuffered)'
  WHEN ds > 60 THEN 'Excess Working Capital Locked (Overbuffered)' ELSE 'Balanced S&OP Inventory Health' END AS buffer_health_rating FROM h"""))
def a15(spark, sf):
    s = bindings.sales(spark, sf, parts=True)
    return diagnostics.inventory_exposure(s, demand.daily_demand(s))


@query("a16_diagnostic_reorder", with_ctes(SALES, ITEM_DAILY, """
m AS (SELECT sku_id, round(avg(y), 1) AS dm, round(stddev_pop(y), 1) AS sd FROM daily GROUP BY 1),
l AS (SELECT sku_id, round(avg(lead_time_days), 1) AS lt FROM sales GROUP BY 1),
h AS (SELECT *, 1.65::DOUBLE * CASE WHEN sd > 0 THEN sd ELSE dm * 0.25 END * sqrt(greatest(1.0, lt)) AS ss FROM m JOIN l USING (sku_id))""", """
SELECT sku_id, dm AS daily_mean_demand, sd AS daily_std_demand, lt AS mean_lead_time, CAST(round(ss) AS BIGINT) AS recommended_safety_stock,
  CAST(round(dm * lt + ss) AS BIGINT) AS recommended_reorder_point FROM h"""))
def a16(spark, sf):
    s = bindings.sales(spark, sf, orders=True)
    lead = s.groupBy("sku_id").agg(F.avg("lead_time_days").alias("mean_lead_time"))
    return diagnostics.diagnostic_reorder(demand.daily_demand(s), lead)


@query("a17_readiness")
def a17(spark, sf):
    s = bindings.sales(spark, sf, orders=True, parts=True)
    roles = detect_roles(s.columns)
    scores = readiness_scores(roles)
    return s.agg(F.count("*").alias("n_rows")).select("n_rows", *[F.lit(v).alias(k) for k, v in scores.items()])


@query("c2_detected_roles")
def c2(spark, sf):
    s = bindings.sales(spark, sf, orders=True, parts=True)
    cells = [F.struct(F.lit(role).alias("role"), F.lit(c).alias("column"), F.count(c).alias("filled")) for role, c in detect_roles(s.columns).items() if c]
    return s.agg(F.array(*cells).alias("_a")).select(F.inline("_a"))


@query("c17_key_guess", """
SELECT count(*) AS n_rows, count(DISTINCT (o_orderkey, o_custkey)) AS n_keys, CASE WHEN count(*) = count(DISTINCT (o_orderkey, o_custkey)) THEN 1 ELSE 0 END AS is_unique FROM orders""")
def c17(spark, sf):
    o = readers.table(spark, sf, "orders")
    return columns.key_is_unique(o, primary_key_guess(o.columns))


@query("a18_table_profile", """
SELECT (SELECT count(*) FROM orders) AS n_rows, 6 AS n_columns, (SELECT count(*) FILTER (o_orderkey IS NULL) + count(*) FILTER (o_custkey IS NULL) + count(*) FILTER (o_orderstatus IS NULL)
  + count(*) FILTER (o_totalprice IS NULL) + count(*) FILTER (o_orderdate IS NULL) + count(*) FILTER (o_orderpriority IS NULL) FROM orders) AS missing_cells,
  (SELECT count(*) FROM orders) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders)) AS duplicate_rows""")
def a18(spark, sf):
    return diagnostics.table_profile(readers.table(spark, sf, "orders"))


@query("a18_profile_with_copies", """
SELECT count(*) AS n_rows, 3 AS n_columns, CAST(0 AS BIGINT) AS missing_cells, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey, l_quantity FROM lineitem)) AS duplicate_rows FROM lineitem""")
def a18b(spark, sf):
    return diagnostics.table_profile(readers.table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_quantity"))


NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("a19_findings", """
WITH p AS (SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, corr(l_quantity, l_extendedprice) AS c FROM lineitem
 UNION ALL SELECT 'l_quantity', 'l_discount', corr(l_quantity, l_discount) FROM lineitem UNION ALL SELECT 'l_quantity', 'l_tax', corr(l_quantity, l_tax) FROM lineitem
 UNION ALL SELECT 'l_extendedprice', 'l_discount', corr(l_extendedprice, l_discount) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_tax', corr(l_extendedprice, l_tax) FROM lineitem
 UNION ALL SELECT 'l_discount', 'l_tax', corr(l_discount, l_tax) FROM lineitem),
t AS (SELECT l_returnflag AS f, count(*) AS n FROM lineitem GROUP BY 1)
SELECT (SELECT CASE WHEN skewness(l_quantity) > 0 THEN 'right' ELSE 'left' END FROM lineitem) AS skew_direction, (SELECT arg_min(f, row(-n, f)) FROM t) AS top_category,
 (SELECT a FROM p ORDER BY abs(c) DESC, a, b LIMIT 1) AS pair_left, (SELECT b FROM p ORDER BY abs(c) DESC, a, b LIMIT 1) AS pair_right, (SELECT round(max(abs(c)), 6) FROM p) AS pair_corr""")
def a19(spark, sf):
    line = readers.table(spark, sf, "lineitem")
    best = selection.correlation_pairs(line, NUM).orderBy(F.desc(F.abs("corr")), "left", "right").limit(1)
    skew = line.agg(F.when(F.skewness("l_quantity") > 0, "right").otherwise("left").alias("skew_direction"))
    top = diagnostics.top_categories(line, "l_returnflag", 1)
    return skew.join(F.broadcast(top.select(F.col("category").alias("top_category")))).join(F.broadcast(best.select(
        F.col("left").alias("pair_left"), F.col("right").alias("pair_right"), r(F.abs("corr"), 6).alias("pair_corr"))))


@query("a20_top_categories", """
SELECT * FROM (SELECT p_name AS category, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) ORDER BY n DESC, category LIMIT 20""")
def a20(spark, sf):
    line = readers.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    return diagnostics.top_categories(line.join(readers.table(spark, sf, "part"), "p_partkey"), "p_name", 20)


@query("a21_class_histogram", """
WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
b AS (SELECT o_orderstatus, lo, (hi - lo) / 50 AS w, least(CAST(floor((o_totalprice - lo) / ((hi - lo) / 50)) AS INTEGER), 49) AS bin FROM orders, e)
SELECT o_orderstatus, bin, count(*) AS n, round(min(lo + bin * w), 4) AS bin_start FROM b GROUP BY 1, 2""")
def a21(spark, sf):
    return diagnostics.histogram(readers.table(spark, sf, "orders"), "o_totalprice", "o_orderstatus").withColumn("bin_start", r("bin_start", 4))


@query("a23_class_balance", """
WITH c AS (SELECT l_returnflag || l_linestatus AS k, count(*) AS n FROM lineitem GROUP BY 1)
SELECT arg_min(k, row(-n, k)) AS majority_class, max(n) AS majority_count, arg_max(k, row(-n, k)) AS minority_class, min(n) AS minority_count,
  round(min(n) * 100.0::DOUBLE / sum(n), 2) AS minority_pct, round(max(n) / CAST(min(n) AS DOUBLE), 2) AS imbalance_ratio, CASE WHEN min(n) * 100.0 / sum(n) < 10 THEN 1 ELSE 0 END AS is_imbalanced FROM c""")
def a23(spark, sf):
    return diagnostics.class_balance(readers.table(spark, sf, "lineitem").withColumn("k", F.concat("l_returnflag", "l_linestatus")), "k")


@query("a24_numeric_summary", "UNION ALL ".join(f"""
SELECT '{c}' AS "column", min({c}) AS min_value, max({c}) AS max_value, round(avg({c}), 4) AS mean_value, round(stddev_samp({c}), 4) AS std_value FROM lineitem """ for c in NUM))
def a24(spark, sf):
    return diagnostics.numeric_summary(readers.table(spark, sf, "lineitem"), NUM).withColumns({"mean_value": r("mean_value", 4), "std_value": r("std_value", 4)})


@query("a25_quantile_buckets", with_ctes(USER_DAYS, """
q AS (SELECT quantile_cont(other_value, [0.2, 0.4, 0.6, 0.8, 0.9]) AS e FROM ud),
e AS (SELECT CASE WHEN e[1] > 0 THEN list_concat([0.0::DOUBLE], e) ELSE e END AS e FROM q),
b AS (SELECT other_value AS s, outcome AS y, e, len(list_filter(e, lambda x: x <= other_value)) AS bucket FROM ud, e WHERE other_value >= e[1] AND other_value < e[-1])""", """
SELECT CAST(bucket AS INTEGER) AS bucket, round(max(e[bucket + 1]), 6) AS upper_edge, count(*) AS n, round(avg(y), 6) AS mean_outcome FROM b GROUP BY 1"""))
def a25(spark, sf):
    out = diagnostics.quantile_bucket_means(bindings.user_days(spark, sf), "other_value", "outcome")
    return out.withColumns({"upper_edge": r("upper_edge", 6), "mean_outcome": r("mean_outcome", 6)})


@query("a26_outcome_rate", with_ctes(USER_DAYS, "SELECT round(avg(CASE WHEN outcome = 1 THEN 1.0 ELSE 0 END) * 100, 6) AS current_outcome, round(avg(spend), 6) AS current_mean FROM ud"))
def a26(spark, sf):
    ud = bindings.user_days(spark, sf)
    share = diagnostics.outcome_rate(ud, "outcome", "1.0").select(r("current_outcome", 6).alias("current_outcome"))
    return share.join(F.broadcast(diagnostics.outcome_rate(ud, "spend").select(r("current_outcome", 6).alias("current_mean"))))


@query("w6_lag_correlation", with_ctes(SALES, BRAND_DAILY, """
l AS (SELECT sku_id, y, lag(y, 1) OVER w AS a, lag(y, 7) OVER w AS b FROM daily WINDOW w AS (PARTITION BY sku_id ORDER BY ds))""", """
SELECT sku_id, round(coalesce(corr(y, a), 0), 6) AS lag_1_autocorr, round(coalesce(corr(y, b), 0), 6) AS lag_7_autocorr FROM l GROUP BY 1 HAVING count(*) >= 14"""))
def w6(spark, sf):
    return diagnostics.lag_correlation(_brands(spark, sf)).withColumns({"lag_1_autocorr": r("lag_1_autocorr", 6), "lag_7_autocorr": r("lag_7_autocorr", 6)})
