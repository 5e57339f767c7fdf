"""Demand, planning and procurement queries."""

from pyspark.sql import functions as F

from ..functions.scalars import batch_ceiling
from ..operators import demand, forecasting, planning, procurement
from ..sources import bindings, readers, writers
from .registry import query
from .sqlbase import SALES, with_ctes

r = F.round

BRAND_DAILY = """
daily AS (SELECT brand AS sku_id, date AS ds, sum(units_sold) AS y, max(promo_flag) AS promo_flag,
                 avg(discount_pct) AS discount_pct FROM sales GROUP BY 1, 2)"""


@query("s3_pruned_scan", """
SELECT CAST(l_shipdate AS DATE) AS date, l_partkey AS sku_id, CAST(l_quantity AS BIGINT) AS units_sold FROM lineitem""")
def s3(spark, sf):
    line = readers.pruned(readers.table(spark, sf, "lineitem"), ["l_shipdate", "l_partkey", "l_quantity", "not_there"])
    return line.select(F.to_date("l_shipdate").alias("date"), F.col("l_partkey").alias("sku_id"),
                       F.col("l_quantity").cast("bigint").alias("units_sold"))


@query("s4_parquet_scan", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def s4(spark, sf):
    return readers.table(spark, sf, "part")


def _written(spark, frame, write):
    """Write a frame to a fresh folder of the shared scratch space and return the folder."""
    from ..session import scratch_folder

    folder = f"{scratch_folder(spark)}/table"
    write(frame, folder)
    return folder


@query("s1_csv_scan", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def s1(spark, sf):
    """The customers written with semicolons and read back; the reader finds the delimiter itself."""
    c = readers.table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    folder = _written(spark, c, lambda f, path: f.write.option("header", True).option("sep", ";").csv(path))
    return readers.csv(spark, folder, c.schema)


@query("s1_mixed_encodings", "SELECT c_custkey, 'Ünit né ' || c_name AS c_name FROM customer")
def s1b(spark, sf):
    """The customers in files of two encodings in one folder, told apart while they are read."""
    c = readers.table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("Ünit né "), "c_name").alias("c_name"))

    def write(frame, path):
        for k, charset in enumerate(("UTF-8", "ISO-8859-1")):
            frame.where(F.col("c_custkey") % 2 == k).write.mode("append").option("header", True).option("sep", ";").option("encoding", charset).csv(path)

    return readers.csv(spark, _written(spark, c, write), c.schema)


@query("s2_json_scan", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def s2(spark, sf):
    o = readers.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return readers.json(spark, _written(spark, o, writers.write_json), o.schema)


@query("s5_partitioned_sink", with_ctes(SALES, BRAND_DAILY, "SELECT sku_id, ds, CAST(y AS BIGINT) AS y, CAST(year(ds) AS INTEGER) AS year FROM daily"))
def s5(spark, sf):
    daily = _brand_daily(spark, sf).select("sku_id", "ds", "y", F.year("ds").alias("year"))
    folder = _written(spark, daily, lambda f, path: writers.write_table(f, path, partition_by=["year"]))
    return spark.read.parquet(folder)


@query("s7_category_summary", "SELECT c_mktsegment AS category, count(*) AS n, round(avg(c_acctbal), 4) AS mean_balance, 'run-1' AS run_id FROM customer GROUP BY 1")
def s7(spark, sf):
    c = readers.table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("category")).agg(
        F.count("*").alias("n"), r(F.avg("c_acctbal"), 4).alias("mean_balance"))
    folder = _written(spark, c, lambda f, path: writers.write_category_summary(f, f, path, "run-1"))
    return spark.read.parquet(f"{folder}/summary")


@query("p1_item_store_filter", with_ctes(SALES, """
SELECT date, sku_id, store_id, supplier_id, units_sold FROM sales WHERE sku_id = 42 OR (store_id = 7 AND supplier_id = 12)"""))
def p1(spark, sf):
    s = bindings.sales(spark, sf, stores=True)
    return s.where("sku_id = 42 OR (store_id = 7 AND supplier_id = 12)").select(
        "date", "sku_id", "store_id", "supplier_id", "units_sold")


@query("a1_daily_demand", with_ctes(SALES, """
SELECT sku_id, date AS ds, CAST(sum(units_sold) AS BIGINT) AS y, max(promo_flag) AS promo_flag,
       max(stock_out_flag) AS stock_out_flag, round(avg(discount_pct), 6) AS discount_pct
FROM sales GROUP BY 1, 2"""))
def a1(spark, sf):
    return demand.daily_demand(bindings.sales(spark, sf)).withColumn("discount_pct", r("discount_pct", 6))


@query("p2_date_split", with_ctes(SALES, """
SELECT CASE WHEN date < DATE '2000-07-01' THEN 'train' ELSE 'test' END AS part, count(*) AS n_rows,
       CAST(sum(y) AS BIGINT) AS units, min(date) AS first_day, max(date) AS last_day
FROM (SELECT sku_id, date, sum(units_sold) AS y FROM sales GROUP BY 1, 2) GROUP BY 1"""))
def p2(spark, sf):
    train, test = demand.split_at(demand.daily_demand(bindings.sales(spark, sf)), "2000-07-01")
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(F.count("*").alias("n_rows"), F.sum("y").cast("bigint").alias("units"),
                                    F.min("ds").alias("first_day"), F.max("ds").alias("last_day"))


TREND = """
aged AS (SELECT *, row_number() OVER (PARTITION BY sku_id ORDER BY ds DESC) AS age FROM daily),
tr0 AS (SELECT sku_id, count(*) AS active_days, avg(y) AS m_all, avg(CASE WHEN age <= 30 THEN y END) AS m30,
               avg(CASE WHEN age <= 90 THEN y END) AS m90 FROM aged GROUP BY 1),
trend AS (SELECT sku_id, active_days, CASE WHEN active_days >= 90 THEN m30 ELSE m_all END AS recent_30_mean,
                 CASE WHEN active_days >= 90 THEN m90 ELSE m_all END AS recent_90_mean,
                 round(CASE WHEN active_days >= 90 AND m90 > 0 THEN m30 / m90 ELSE 1.0 END, 4) AS trend_ratio,
                 round(least(1.15, greatest(0.90, CASE WHEN active_days >= 90 AND m90 > 0 THEN m30 / m90 ELSE 1.0 END)), 4) AS trend_adjustment
          FROM tr0)"""


def _brand_daily(spark, sf):
    return demand.daily_demand(bindings.brand_lines(spark, sf))


@query("w1_trend_momentum", with_ctes(SALES, BRAND_DAILY, TREND, """
SELECT sku_id, active_days, round(recent_30_mean, 2) AS recent_30_mean, round(recent_90_mean, 2) AS recent_90_mean,
       CAST(trend_ratio AS DOUBLE) AS trend_ratio, CAST(trend_adjustment AS DOUBLE) AS trend_adjustment FROM trend"""))
def w1(spark, sf):
    t = demand.trend_momentum(_brand_daily(spark, sf))
    return t.withColumn("recent_30_mean", r("recent_30_mean", 2)).withColumn("recent_90_mean", r("recent_90_mean", 2))


@query("w1_trend_short_history", with_ctes(SALES, BRAND_DAILY.replace("brand AS sku_id", "sku_id"), TREND, """
SELECT sku_id, active_days, round(recent_30_mean, 4) AS recent_30_mean, CAST(trend_ratio AS DOUBLE) AS trend_ratio,
       CAST(trend_adjustment AS DOUBLE) AS trend_adjustment FROM trend"""))
def w1_short(spark, sf):
    t = demand.trend_momentum(demand.daily_demand(bindings.sales(spark, sf)))
    return t.withColumn("recent_30_mean", r("recent_30_mean", 4)).drop("recent_90_mean")


@query("a5_lead_time_stats", with_ctes(SALES, """
SELECT sku_id, median(lead_time_days) AS lead_time_median, round(avg(lead_time_days), 6) AS lead_time_mean,
       quantile_cont(CAST(lead_time_days AS DOUBLE), 0.9) AS lead_time_p90 FROM sales GROUP BY 1"""))
def a5(spark, sf):
    s = demand.lead_time_statistics(bindings.sales(spark, sf, orders=True))
    return s.withColumn("lead_time_mean", r("lead_time_mean", 6))


PRICE = """
price AS (SELECT sku_id, ((2 * sum(list_cents * units_sold) + sum(units_sold)) // (2 * sum(units_sold))) / 100.0 AS p
          FROM sales GROUP BY 1)"""


@query("a6_weighted_list_price", with_ctes(SALES, PRICE, """
SELECT sku_id, CAST(p AS DOUBLE) AS weightage_list_price FROM price"""))
def a6(spark, sf):
    return demand.weighted_list_price(bindings.sales(spark, sf))


BRAND = "bs AS (SELECT * REPLACE (brand AS sku_id) FROM (SELECT * EXCLUDE (sku_id), CAST(NULL AS VARCHAR) AS sku_id FROM sales))"

VENDOR = """
pair AS (SELECT sku_id, supplier_id, count(*) AS orders, sum(stock_out_flag) AS outs, stddev_samp(lead_time_days) AS sd
         FROM bs GROUP BY 1, 2),
itm AS (SELECT sku_id, count(DISTINCT supplier_id) AS vendor_count, avg(stock_out_flag) AS out_rate FROM bs GROUP BY 1),
vendor AS (SELECT sku_id, supplier_id, orders, vendor_count,
   round(0.012::DOUBLE + 0.004::DOUBLE * least(CASE WHEN orders >= 10 THEN sd / 2 ELSE 1 END, 2)
         + 0.008::DOUBLE * CASE WHEN orders >= 10 THEN CAST(outs AS DOUBLE) / orders ELSE out_rate END, 4) AS vendor_defect_rate
   FROM pair JOIN itm USING (sku_id))"""


@query("a7_vendor_profile", with_ctes(SALES, BRAND, VENDOR, """
SELECT sku_id, supplier_id, orders, vendor_count, vendor_defect_rate FROM vendor"""))
def a7(spark, sf):
    return demand.vendor_profile(bindings.brand_sales(spark, sf))


TOP5 = """
cnt AS (SELECT sku_id, supplier_id, count(*) AS orders FROM bs GROUP BY 1, 2),
top5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sku_id ORDER BY orders DESC, supplier_id) AS rank FROM cnt)
         WHERE rank <= 5)"""


@query("t3_top_suppliers", with_ctes(SALES, BRAND, TOP5, """
SELECT sku_id, supplier_id, orders, CAST(rank AS INTEGER) AS rank FROM top5"""))
def t3(spark, sf):
    return demand.top_suppliers(bindings.brand_sales(spark, sf))


@query("t1_series_order", with_ctes(SALES, BRAND_DAILY, """
SELECT sku_id, ds, CAST(y AS BIGINT) AS y, CAST(row_number() OVER (PARTITION BY sku_id ORDER BY ds) AS INTEGER) AS place FROM daily"""))
def t1(spark, sf):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("sku_id").orderBy("ds"))
    return _brand_daily(spark, sf).select("sku_id", "ds", "y", place.alias("place"))


@query("t2_first_last_days", with_ctes(SALES, BRAND_DAILY, """
SELECT sku_id, ds, CAST(y AS BIGINT) AS y, 'first' AS edge FROM (SELECT *, row_number() OVER (PARTITION BY sku_id ORDER BY ds) AS i FROM daily) WHERE i <= 30
UNION ALL
SELECT sku_id, ds, CAST(y AS BIGINT) AS y, 'last' AS edge FROM (SELECT *, row_number() OVER (PARTITION BY sku_id ORDER BY ds DESC) AS i FROM daily) WHERE i <= 30"""))
def t2(spark, sf):
    d = _brand_daily(spark, sf).select("sku_id", "ds", "y")
    return demand.head_rows(d, 30).withColumn("edge", F.lit("first")).unionByName(
        demand.head_rows(d, 30, last=True).withColumn("edge", F.lit("last")))


# Baseline forecast of the brands, 30 days ahead, in SQL.
BASELINE = """
st AS (SELECT sku_id, min(ds) AS start, max(ds) AS lastd, count(*) AS n, date_diff('day', min(ds), max(ds)) AS span FROM daily GROUP BY 1),
gp AS (SELECT sku_id, median(g) AS gap FROM (SELECT sku_id, date_diff('day', lag(ds) OVER (PARTITION BY sku_id ORDER BY ds), ds) AS g FROM daily) GROUP BY 1),
fr AS (SELECT st.*, coalesce(gap, 1) AS gap, CASE WHEN coalesce(gap, 1) <= 8 AND span >= 14 THEN 1 ELSE 0 END AS wk,
              CASE WHEN span >= 365 THEN 1 ELSE 0 END AS yr FROM st LEFT JOIN gp USING (sku_id)),
dx AS (SELECT d.sku_id, ds, CAST(y AS DOUBLE) AS y, CAST(date_diff('day', start, ds) AS DOUBLE) AS x FROM daily d JOIN fr USING (sku_id)),
ln AS (SELECT sku_id, coalesce(regr_slope(y, x), 0) AS sl, coalesce(regr_intercept(y, x), avg(y)) AS ic FROM dx GROUP BY 1),
al AS (SELECT sku_id, ds, y, x FROM dx
       UNION ALL SELECT sku_id, CAST(lastd + i AS DATE), NULL, CAST(date_diff('day', start, CAST(lastd + i AS DATE)) AS DOUBLE)
       FROM fr, (SELECT unnest(generate_series(1, 30))::INTEGER AS i)),
tr AS (SELECT al.*, ic + sl * x AS trend, greatest(ic + sl * x, 0) AS pos, isodow(ds) AS dow, month(ds) AS mon, wk, yr
       FROM al JOIN ln USING (sku_id) JOIN fr USING (sku_id)),
wi AS (SELECT sku_id, dow, sum(y) / nullif(sum(pos), 0) AS w FROM tr WHERE y IS NOT NULL GROUP BY 1, 2),
t2 AS (SELECT tr.*, CASE WHEN wk = 1 THEN coalesce(w, 1) ELSE 1 END AS w FROM tr LEFT JOIN wi USING (sku_id, dow)),
mi AS (SELECT sku_id, mon, sum(y) / nullif(sum(pos * w), 0) AS m FROM t2 WHERE y IS NOT NULL GROUP BY 1, 2),
t3 AS (SELECT t2.*, CASE WHEN yr = 1 THEN coalesce(m, 1) ELSE 1 END AS m FROM t2 LEFT JOIN mi USING (sku_id, mon)),
t4 AS (SELECT *, pos * w * m AS f FROM t3),
sp AS (SELECT sku_id, sqrt(avg((y - f) * (y - f))) AS fit_rmse FROM t4 WHERE y IS NOT NULL GROUP BY 1),
fc AS (SELECT sku_id, ds, y, trend, w - 1 AS weekly, m - 1 AS yearly, f AS yhat, greatest(f - 1.96 * fit_rmse, 0) AS yhat_lower,
              f + 1.96 * fit_rmse AS yhat_upper, fit_rmse FROM t4 JOIN sp USING (sku_id))"""

DAYS = """
cons AS (SELECT f.sku_id, ds, round(yhat, 2) AS yhat, row_number() OVER (PARTITION BY f.sku_id ORDER BY ds) AS day_no,
                trend_ratio, trend_adjustment,
                CAST(ceil(round(yhat, 2) * trend_adjustment * 1.05::DOUBLE) AS BIGINT) AS adjusted_plan
         FROM fc f JOIN trend USING (sku_id) WHERE y IS NULL)"""


def _brand_forecast(spark, sf, horizon=30):
    return forecasting.seasonal_baseline(_brand_daily(spark, sf), horizon)


def _consensus(spark, sf):
    daily = _brand_daily(spark, sf)
    ahead = forecasting.seasonal_baseline(daily, 30).where("y IS NULL").withColumn("yhat", r("yhat", 2))
    return planning.consensus_days(ahead, demand.trend_momentum(daily))


@query("k1_consensus_demand", with_ctes(SALES, BRAND_DAILY, TREND, BASELINE, DAYS, """
SELECT sku_id, round(sum(yhat), 2) AS raw_forecast_demand_quantity, CAST(sum(adjusted_plan) AS BIGINT) AS global_plan_demand_quantity,
       round(avg(adjusted_plan), 2) AS mean_daily_forecast_demand, CAST(max(trend_ratio) AS DOUBLE) AS trend_ratio_30_90,
       CAST(max(trend_adjustment) AS DOUBLE) AS trend_adjustment
FROM cons GROUP BY 1"""))
def k1(spark, sf):
    return planning.consensus_demand(_consensus(spark, sf))


@query("k2_lead_time_choice", with_ctes(SALES, "lt AS (SELECT brand AS sku_id, median(lead_time_days) AS med FROM sales GROUP BY 1)", """
SELECT sku_id, CAST(CASE WHEN sku_id = 'Brand#1' THEN 9.5 ELSE ceil(greatest(med, 1)) END AS DOUBLE) AS lead_time,
       CASE WHEN sku_id = 'Brand#1' THEN 'manual' ELSE 'historical median' END AS lead_time_source,
       CAST(ceil(greatest(CASE WHEN sku_id = 'Brand#1' THEN 9.5 ELSE ceil(greatest(med, 1)) END, 1)) AS INTEGER) AS lead_time_days
FROM lt"""))
def k2(spark, sf):
    stats = demand.lead_time_statistics(bindings.brand_sales(spark, sf))
    value, source = planning.chosen_lead_time(F.when(F.col("sku_id") == "Brand#1", F.lit(9.5)), None, F.col("lead_time_median"))
    return stats.select("sku_id", value.alias("lead_time"), source.alias("lead_time_source"),
                        F.ceil(F.greatest(value, F.lit(1.0))).cast("int").alias("lead_time_days"))


FACTS = """
lt AS (SELECT sku_id, ceil(greatest(median(lead_time_days), 1)) AS lead_days FROM bs GROUP BY 1),
pr AS (SELECT sku_id, ((2 * sum(list_cents * units_sold) + sum(units_sold)) // (2 * sum(units_sold))) / CAST(100 AS DOUBLE) AS p FROM bs GROUP BY 1),
vb AS (SELECT sku_id, vendor_defect_rate FROM (SELECT *, row_number() OVER (PARTITION BY sku_id ORDER BY orders DESC, supplier_id) AS i FROM vendor) WHERE i = 1),
inv AS (SELECT p_brand AS sku_id, CAST(floor(avg(p_size * 10)) AS BIGINT) AS soh FROM part GROUP BY 1),
rm AS (SELECT sku_id, round(max(fit_rmse), 2) AS rmse FROM fc GROUP BY 1),
pl0 AS (SELECT c.sku_id, CAST(sum(adjusted_plan) AS BIGINT) AS total, round(avg(adjusted_plan), 2) AS daily_mean,
               CAST(sum(CASE WHEN day_no <= lead_days THEN adjusted_plan ELSE 0 END) AS BIGINT) AS dlt, max(lead_days) AS lead_days
        FROM cons c JOIN lt USING (sku_id) GROUP BY 1),
pl1 AS (SELECT *, CAST(ceil(1.65::DOUBLE * rmse * sqrt(lead_days)) AS BIGINT) AS ss FROM pl0 JOIN rm USING (sku_id) JOIN inv USING (sku_id)
        JOIN pr USING (sku_id) JOIN vb USING (sku_id)),
pl2 AS (SELECT *, dlt + ss AS rop, CAST(greatest(dlt + ss - soh, 0) AS BIGINT) AS nrq FROM pl1),
plan AS (SELECT sku_id, total AS global_plan_demand_quantity, daily_mean AS mean_daily_forecast_demand, CAST(lead_days AS INTEGER) AS lead_time_days,
        dlt AS lead_time_demand, ss AS safety_stock, rop AS reorder_point, CAST(soh AS BIGINT) AS stock_on_hand,
        CAST(soh AS BIGINT) AS inventory_position, nrq AS net_replenishment_quantity,
        CAST(CASE WHEN nrq > 0 THEN ceil(nrq / (1.0::DOUBLE - vendor_defect_rate)) ELSE nrq END AS BIGINT) AS quality_adjusted_nrq,
        p AS weightage_list_price, vendor_defect_rate, round(total * p, 2) AS global_plan_valuation,
        CASE WHEN daily_mean > 0 THEN round(soh / daily_mean, 2) ELSE 0 END AS days_of_supply,
        CASE WHEN soh <= rop THEN 1 ELSE 0 END AS reorder_triggered FROM pl2)"""

PLAN = (SALES, BRAND_DAILY, TREND, BASELINE, DAYS, BRAND, VENDOR, FACTS)


def plan_of(spark, sf):
    """Inventory plan of every brand from the sales history, the part stock and the forecast."""
    from ..plans.order_execution import demand_plan, sales_table

    return demand_plan(sales_table(bindings.brand_sales(spark, sf)), bindings.brand_inventory(spark, sf), lines=bindings.brand_lines(spark, sf))


@query("k3_reorder_point", with_ctes(*PLAN, """
SELECT sku_id, lead_time_days, lead_time_demand, safety_stock, reorder_point, inventory_position, net_replenishment_quantity,
       quality_adjusted_nrq FROM plan"""))
def k3(spark, sf):
    return plan_of(spark, sf).select(
        "sku_id", "lead_time_days", "lead_time_demand", "safety_stock", "reorder_point", "inventory_position",
        "net_replenishment_quantity", "quality_adjusted_nrq")


@query("k4_valuation_supply", with_ctes(*PLAN, """
SELECT sku_id, global_plan_demand_quantity, weightage_list_price, global_plan_valuation, mean_daily_forecast_demand, days_of_supply,
       reorder_triggered FROM plan"""))
def k4(spark, sf):
    return plan_of(spark, sf).select("sku_id", "global_plan_demand_quantity", "weightage_list_price", "global_plan_valuation",
                                     "mean_daily_forecast_demand", "days_of_supply", "reorder_triggered")


@query("k5_order_quantity", """
SELECT o_orderkey, CAST(CASE WHEN need <= 0 THEN 0 ELSE ceil(greatest(need, 500) / 50.0) * 50 END AS BIGINT) AS order_quantity
FROM (SELECT o_orderkey, CAST(floor(o_totalprice / 100) AS BIGINT) - 300 AS need FROM orders)""")
def k5(spark, sf):
    need = F.floor(F.col("o_totalprice") / 100).cast("bigint") - 300
    return readers.table(spark, sf, "orders").select("o_orderkey", procurement.order_quantity(need).alias("order_quantity"))


@query("z6_batch_ceiling", """
SELECT o_orderkey, CAST(ceil(floor(o_totalprice) / 24.0) * 24 AS BIGINT) AS q FROM orders""")
def z6(spark, sf):
    return readers.table(spark, sf, "orders").select("o_orderkey", batch_ceiling(F.floor("o_totalprice"), 24).alias("q"))


ORDERQ = """
oq AS (SELECT sku_id, weightage_list_price AS list_price, inventory_position, reorder_point,
        CAST(CASE WHEN quality_adjusted_nrq <= 0 THEN 0 ELSE ceil(greatest(quality_adjusted_nrq, 500) / 50.0) * 50 END AS BIGINT) AS oqty FROM plan),
gate AS (SELECT *, CASE WHEN inventory_position <= reorder_point AND oqty > 0 THEN 1 ELSE 0 END AS flag FROM oq)"""

SCORES = """
vf AS (SELECT b.sku_id, b.supplier_id, ((2 * sum(cost_cents) + count(*)) // (2 * count(*))) / CAST(100 AS DOUBLE) AS pp, round(avg(lead_time_days), 2) AS lt,
              round(1 - avg(stock_out_flag), 4) AS rel, round(avg(margin_pct), 4) AS mg
       FROM bs b JOIN top5 USING (sku_id, supplier_id) GROUP BY 1, 2),
mm AS (SELECT sku_id, min(pp) AS p0, max(pp) AS p1, min(lt) AS l0, max(lt) AS l1, min(rel) AS r0, max(rel) AS r1, min(mg) AS g0, max(mg) AS g1 FROM vf GROUP BY 1),
sc AS (SELECT sku_id, supplier_id, pp, lt, rel, mg,
   1 - (pp - p0) / CASE WHEN p1 = p0 THEN 1 ELSE p1 - p0 END AS sp, 1 - (lt - l0) / CASE WHEN l1 = l0 THEN 1 ELSE l1 - l0 END AS sl,
   (rel - r0) / CASE WHEN r1 = r0 THEN 1 ELSE r1 - r0 END AS sr, (mg - g0) / CASE WHEN g1 = g0 THEN 1 ELSE g1 - g0 END AS sg FROM vf JOIN mm USING (sku_id)),
sc2 AS (SELECT *, round(0.4::DOUBLE * sp + 0.3::DOUBLE * sl + 0.2::DOUBLE * sr + 0.1::DOUBLE * sg, 6) AS score FROM sc),
ranked AS (SELECT *, row_number() OVER (PARTITION BY sku_id ORDER BY score DESC, supplier_id) AS rank FROM sc2)"""


@query("k6_order_gate", with_ctes(*PLAN, ORDERQ, "SELECT sku_id, oqty AS order_quantity, flag AS order_validation_flag FROM gate"))
def k6(spark, sf):
    p = plan_of(spark, sf)
    q = procurement.order_quantity(F.col("quality_adjusted_nrq"))
    return p.select("sku_id", q.alias("order_quantity"),
                    procurement.order_gate(F.col("inventory_position"), F.col("reorder_point"), q).alias("order_validation_flag"))


@query("k7_vendor_scores", with_ctes(SALES, BRAND, TOP5, SCORES, """
SELECT sku_id, supplier_id, pp AS predicted_price, lt AS lead_time, rel AS reliability, mg AS margin_pct, round(sp, 6) AS score_price,
       round(sl, 6) AS score_lead_time, round(sr, 6) AS score_reliability, round(sg, 6) AS score_margin, score AS composite_score,
       CAST(rank AS INTEGER) AS rank FROM ranked"""))
def k7(spark, sf):
    s = procurement.vendor_scores(demand.vendor_facts(bindings.brand_sales(spark, sf)))
    return s.withColumns({c: r(c, 6) for c in s.columns if c.startswith("score_")})


@query("w9_rank_by_score", with_ctes(SALES, BRAND, TOP5, SCORES, "SELECT sku_id, supplier_id, CAST(rank AS INTEGER) AS rank FROM ranked"))
def w9(spark, sf):
    return procurement.vendor_scores(demand.vendor_facts(bindings.brand_sales(spark, sf))).select("sku_id", "supplier_id", "rank")


SPLIT = """
al0 AS (SELECT r.*, oqty, list_price, flag, count(*) OVER (PARTITION BY r.sku_id) AS ns, CAST(greatest(ceil(oqty * 0.7::DOUBLE / 50.0) * 50, 500) AS BIGINT) AS main
        FROM ranked r JOIN gate g ON r.sku_id = g.sku_id WHERE rank <= 2 AND oqty > 0),
al1 AS (SELECT *, oqty - main AS rest, CAST(ceil((oqty - main) / 50.0) * 50 AS BIGINT) AS lifted, (oqty - main < 500 AND oqty > 500) AS short FROM al0),
al2 AS (SELECT *, CAST(CASE WHEN ns = 1 THEN oqty WHEN rank = 1 THEN CASE WHEN short AND lifted < 500 THEN greatest(500, oqty - 500) ELSE main END
                       ELSE CASE WHEN short THEN greatest(lifted, 500) ELSE rest END END AS BIGINT) AS units FROM al1)"""


def _procure(spark, sf):
    from ..plans.order_execution import demand_plan, procure, sales_table
    from ..session import shared

    sales = sales_table(bindings.brand_sales(spark, sf))
    cube = shared(demand.supply_cube(sales))
    return procure(cube, demand_plan(sales, bindings.brand_inventory(spark, sf), cube=cube, lines=bindings.brand_lines(spark, sf)), as_of="2026-01-05")


@query("k8_order_split", with_ctes(*PLAN, ORDERQ, TOP5, SCORES, SPLIT, """
SELECT sku_id, supplier_id, CAST(rank AS INTEGER) AS rank, oqty AS order_quantity, units AS allocated_quantity,
       round(CAST(units AS DOUBLE) / oqty * 100, 1) AS allocation_share_percent, round(units * pp, 2) AS order_cost FROM al2"""))
def k8(spark, sf):
    return _procure(spark, sf)["allocations"].select(
        "sku_id", "supplier_id", "rank", "order_quantity", "allocated_quantity", "allocation_share_percent", "order_cost")


AUDIT = """
au AS (SELECT g.sku_id, g.flag, g.list_price, g.flag = 1 AS c1, coalesce(bool_and(units >= 500), true) AS c2,
              count(supplier_id) > 0 AND coalesce(bool_and(score > 0), true) AS c3, coalesce(bool_and(pp < g.list_price), true) AS c4,
              coalesce(bool_and(lt <= 12), true) AS c5
       FROM gate g LEFT JOIN al2 ON g.sku_id = al2.sku_id GROUP BY 1, 2, 3)"""


@query("k9_order_audit", with_ctes(*PLAN, ORDERQ, TOP5, SCORES, SPLIT, AUDIT, """
SELECT sku_id, CASE WHEN c1 THEN 'PASS' ELSE 'FAIL' END AS check_order_trigger, CASE WHEN c2 THEN 'PASS' ELSE 'FAIL' END AS check_quantity_moq,
  CASE WHEN c3 THEN 'PASS' ELSE 'FAIL' END AS check_vendor_eligibility, CASE WHEN c4 THEN 'PASS' ELSE 'FAIL' END AS check_price_profitability,
  CASE WHEN c5 THEN 'PASS' ELSE 'FAIL' END AS check_lead_time_compliance, CASE WHEN c1 AND c2 AND c3 AND c4 AND c5 THEN 1 ELSE 0 END AS procurement_validation_flag,
  CASE WHEN c1 AND c2 AND c3 AND c4 AND c5 THEN 'VALID' ELSE 'INVALID' END AS procurement_validation_status FROM au"""))
def k9(spark, sf):
    return _procure(spark, sf)["audit"]


@query("k10_purchase_orders", with_ctes(*PLAN, ORDERQ, TOP5, SCORES, SPLIT, AUDIT, """
SELECT a.sku_id, 'PO-MULTI-' || a.sku_id || '-20260105' AS po_id, DATE '2026-01-05' AS po_date,
  CAST(DATE '2026-01-05' + CAST(round_even(max(CASE WHEN rank = 1 THEN lt END), 0) AS INTEGER) AS DATE) AS expected_delivery_date,
  CAST(sum(units) AS BIGINT) AS order_quantity, round(sum(round(units * pp, 2)), 2) AS total_order_cost,
  round(round(sum(round(units * pp, 2)), 2) / CAST(sum(units) AS DOUBLE), 2) AS blended_unit_cost,
  round(sum(units) * max(au.list_price) - round(sum(round(units * pp, 2)), 2), 2) AS projected_gross_profit,
  CASE WHEN max(CASE WHEN c1 AND c2 AND c3 AND c4 AND c5 THEN 1 ELSE 0 END) = 1 THEN 'PURCHASE_ORDER_ISSUED' ELSE 'HOLD_FOR_REVIEW' END AS po_status
FROM al2 a JOIN au ON a.sku_id = au.sku_id GROUP BY 1"""))
def k10(spark, sf):
    return _procure(spark, sf)["orders"]


@query("k11_order_execution", with_ctes(*PLAN, ORDERQ, TOP5, SCORES, SPLIT, """
SELECT p.sku_id, p.global_plan_demand_quantity, p.safety_stock, p.reorder_point, p.quality_adjusted_nrq, g.flag AS order_validation_flag,
       CAST(coalesce(sum(units), 0) AS BIGINT) AS order_quantity, CAST(coalesce(round(sum(round(units * pp, 2)), 2), 0) AS DOUBLE) AS total_order_cost
FROM plan p JOIN gate g ON p.sku_id = g.sku_id LEFT JOIN al2 a ON a.sku_id = p.sku_id GROUP BY 1, 2, 3, 4, 5, 6"""))
def k11(spark, sf):
    from ..plans.order_execution import order_execution, sales_table

    return order_execution(sales_table(bindings.brand_sales(spark, sf)), bindings.brand_inventory(spark, sf), as_of="2026-01-05",
                           lines=bindings.brand_lines(spark, sf)).select(
        "sku_id", "global_plan_demand_quantity", "safety_stock", "reorder_point", "quality_adjusted_nrq",
        "order_validation_flag", "order_quantity", "total_order_cost")


@query("k11_learned_execution")
def k11_learned(spark, sf):
    from ..plans.order_execution import learned_execution

    return learned_execution(bindings.brand_sales(spark, sf), bindings.brand_inventory(spark, sf), as_of="2026-01-05", lines=bindings.brand_lines(spark, sf)).select(
        "sku_id", "lead_time_days", "global_plan_demand_quantity", "safety_stock", "reorder_point", "quality_adjusted_nrq",
        "order_validation_flag", "order_quantity", "total_order_cost")


@query("k12_lead_time_model")
def k12(spark, sf):
    from ..operators.predictors import lead_time_predictions

    return lead_time_predictions(bindings.brand_sales(spark, sf))


@query("k13_unit_cost_model")
def k13(spark, sf):
    from ..operators.predictors import unit_cost_predictions

    return unit_cost_predictions(bindings.brand_sales(spark, sf))
