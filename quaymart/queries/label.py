"""Queries of behaviour features, labels and the item-day panel."""

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import labels
from ..plans import contracts
from ..sources import bindings
from .registry import query
from .sqlbase import EVENTS, SALES, WEB, with_ctes

r = F.round


def item_rows(spark, sf):
    e = bindings.item_events(spark, sf)
    return e.withColumn("revenue", (F.col("revenue_cents") / 100).cast("decimal(18,2)"))


DAYS = """
it AS (SELECT CAST(k AS VARCHAR) AS item_id, day, 'cat_' || (k % 8) AS item_category, (event_type = 'view')::BIGINT AS v, (event_type = 'click')::BIGINT AS c, (event_type = 'purchase')::BIGINT AS p,
   CASE WHEN event_type = 'purchase' THEN cents ELSE 0 END AS rc FROM ev),
dy AS (SELECT item_id, day, min(item_category) AS item_category, CAST(sum(v) AS DOUBLE) AS views, CAST(sum(c) AS DOUBLE) AS carts, CAST(sum(p) AS DOUBLE) AS purchases, CAST(sum(rc) AS BIGINT) AS rc FROM it GROUP BY 1, 2)"""


@query("a3_item_day_totals", with_ctes(EVENTS, DAYS, "SELECT item_id, day, item_category, views, carts, purchases, rc / 100.0::DOUBLE AS revenue FROM dy"))
def a3(spark, sf):
    return labels.item_days(item_rows(spark, sf))


@query("a4_item_fallback", with_ctes(EVENTS, DAYS, """
g AS (SELECT item_id, sum(views) AS v, sum(carts) AS c, sum(purchases) AS p, sum(rc) / 100.0::DOUBLE AS rv FROM dy GROUP BY 1),
h AS (SELECT *, CASE WHEN v > 0 THEN c / v ELSE 0 END AS cv, CASE WHEN v > 0 THEN p / v ELSE 0 END AS pv FROM g),
m AS (SELECT max(cv) AS a, max(pv) AS b, max(v) AS c0 FROM h)""", """
SELECT item_id, v AS "itemsViewed", c AS "itemsAddedToCart", p AS history_purchases, round(rv, 2) AS history_revenue, round(cv, 6) AS "cartToViewRate", round(pv, 6) AS "purchaseToViewRate",
 round(CASE WHEN p > 0 THEN rv / p ELSE 0 END, 6) AS unit_price, p AS "itemsPurchased_future", 'proxy' AS target_source,
 round((CASE WHEN a > 0 THEN cv / a ELSE 0 END + CASE WHEN b > 0 THEN pv / b ELSE 0 END + CASE WHEN c0 > 0 THEN v / c0 ELSE 0 END) / 3, 6) AS demand_score FROM h, m"""))
def a4(spark, sf):
    out = labels.item_fallback(item_rows(spark, sf))
    return out.withColumns({c: r(c, 6) for c in ("cartToViewRate", "purchaseToViewRate", "unit_price", "demand_score")}).withColumn("history_revenue", r("history_revenue", 2))


ROLL = ", ".join(f"sum({c}) OVER (PARTITION BY item_id ORDER BY day ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS {n}_roll_{w}"
                 for c, n in (("purchases", "purchases"), ("views", "views"), ("carts", "atc")) for w in labels.ROLLS)
ROLLED = f"rl AS (SELECT *, {ROLL}, sum(rc) OVER (PARTITION BY item_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) / 100.0::DOUBLE AS revenue_roll_7 FROM dy)"
ROLL_NAMES = [f"{n}_roll_{w}" for n in ("purchases", "views", "atc") for w in labels.ROLLS]


@query("w2_trailing_sums", with_ctes(EVENTS, DAYS, ROLLED, f"SELECT item_id, day, {', '.join(ROLL_NAMES)}, round(revenue_roll_7, 2) AS revenue_roll_7 FROM rl"))
def w2(spark, sf):
    out = labels.rolling_sums(labels.item_days(item_rows(spark, sf)))
    return out.select("item_id", "day", *ROLL_NAMES, r("revenue_roll_7", 2).alias("revenue_roll_7"))


@query("w3_expanding_baseline", with_ctes(EVENTS, DAYS, """
SELECT item_id, day, round(avg(purchases) OVER (PARTITION BY item_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * 7, 6) AS sku_demand_baseline FROM dy"""))
def w3(spark, sf):
    return labels.expanding_baseline(labels.item_days(item_rows(spark, sf))).select("item_id", "day", r("sku_demand_baseline", 6).alias("sku_demand_baseline"))


FORWARD = """
fw AS (SELECT a.item_id, a.day, coalesce(sum(b.purchases), 0) AS future_units_raw, CAST(coalesce(sum(b.rc), 0) AS DOUBLE) / 100 AS future_revenue,
  CASE WHEN a.day <= (SELECT max(day) FROM dy) - 7 THEN 1 ELSE 0 END AS future_target_complete
  FROM dy a LEFT JOIN dy b ON a.item_id = b.item_id AND b.day > a.day AND b.day <= a.day + 7 GROUP BY 1, 2)"""


@query("w4_forward_7d_sum", with_ctes(EVENTS, DAYS, FORWARD, "SELECT item_id, day, future_units_raw, round(future_revenue, 2) AS future_revenue, future_target_complete FROM fw"))
def w4(spark, sf):
    out = labels.forward_sums(labels.item_days(item_rows(spark, sf)))
    return out.select("item_id", "day", "future_units_raw", r("future_revenue", 2).alias("future_revenue"), "future_target_complete")


@query("w5_rolled_lags", with_ctes(EVENTS, DAYS, ROLLED, """
SELECT item_id, day, coalesce(lag(purchases_roll_7, 1) OVER w, 0) AS purchases_lag_1, coalesce(lag(purchases_roll_7, 7) OVER w, 0) AS purchases_lag_7 FROM rl WINDOW w AS (PARTITION BY item_id ORDER BY day)"""))
def w5(spark, sf):
    return labels.rolled_lags(labels.rolling_sums(labels.item_days(item_rows(spark, sf)))).select("item_id", "day", "purchases_lag_1", "purchases_lag_7")


PANEL = """
pa AS (SELECT rl.*, future_units_raw, future_target_complete,
  coalesce(lag(purchases_roll_7, 1) OVER w, 0) AS l1, avg(purchases) OVER (PARTITION BY rl.item_id ORDER BY rl.day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * 7 AS base,
  CASE WHEN views_roll_7 > 0 THEN atc_roll_7 / views_roll_7 ELSE 0 END AS cv, CASE WHEN views_roll_7 > 0 THEN purchases_roll_7 / views_roll_7 ELSE 0 END AS pv,
  CASE WHEN purchases_roll_7 > 0 THEN revenue_roll_7 / purchases_roll_7 ELSE 0 END AS price
  FROM rl JOIN fw USING (item_id, day) WINDOW w AS (PARTITION BY rl.item_id ORDER BY rl.day)),
mx AS (SELECT max(cv) AS m1, max(pv) AS m2, max(views_roll_7) AS m3, max(purchases_roll_14) AS m4, quantile_cont(future_units_raw, 0.95) AS cap FROM pa)"""


@query("b6_item_day_panel", with_ctes(EVENTS, DAYS, ROLLED, FORWARD, PANEL, """
SELECT item_id, day, round(cv, 6) AS "cartToViewRate", round(pv, 6) AS "purchaseToViewRate", round(price, 6) AS unit_price, round(purchases_roll_7 / (purchases_roll_28 / 4 + 0.000001::DOUBLE), 6) AS purchase_momentum,
 round((cv / m1 + pv / m2 + views_roll_7 / m3 + purchases_roll_14 / m4) / 4, 6) AS demand_score, future_units_raw, l1 AS purchases_lag_1, CAST(isodow(day) - 1 AS DOUBLE) AS day_of_week,
 round(0.7::DOUBLE * CASE WHEN cap > 0 THEN least(cap, future_units_raw) ELSE future_units_raw END + 0.3::DOUBLE * greatest(base, 0), 6) AS "itemsPurchased_future",
 CAST(dense_rank() OVER (ORDER BY item_id) - 1 AS DOUBLE) AS item_id_enc, CAST(dense_rank() OVER (ORDER BY item_category) - 1 AS DOUBLE) AS item_category_enc FROM pa, mx"""))
def b6(spark, sf):
    p = labels.item_day_panel(item_rows(spark, sf))
    return p.select("item_id", "day", *[r(c, 6).alias(c) for c in ("cartToViewRate", "purchaseToViewRate", "unit_price", "purchase_momentum", "demand_score", "itemsPurchased_future")],
                    "future_units_raw", "purchases_lag_1", "day_of_week", "item_id_enc", "item_category_enc")


@query("j7_panel_inventory", with_ctes(EVENTS, DAYS, """
iv AS (SELECT CAST(p_partkey % 100 AS VARCHAR) AS item_id, CAST(sum(p_size * 10) AS BIGINT) AS stock_units, round(avg(p_retailprice), 4) AS unit_cost, max(p_size) AS lead_time_days FROM part GROUP BY 1)""", """
SELECT dy.item_id, dy.day, CAST(stock_units AS DOUBLE) AS stock_units, unit_cost, CASE WHEN iv.item_id IS NULL THEN 0 ELSE 1 END AS erp_inventory_available FROM dy LEFT JOIN iv ON iv.item_id = dy.item_id"""))
def j7(spark, sf):
    out = labels.with_inventory(labels.item_days(item_rows(spark, sf)), bindings.item_inventory(spark, sf))
    return out.select("item_id", "day", F.col("stock_units").cast("double").alias("stock_units"), "unit_cost", "erp_inventory_available")


HIST = """
od AS (SELECT user_pseudo_id, day, count(*) AS day_orders FROM ev WHERE event_type = 'purchase' GROUP BY 1, 2),
hs AS (SELECT *, lead(day) OVER w AS nx, lag(day) OVER w AS pr, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_pseudo_id) AS n, (SELECT max(day) FROM od) AS e FROM od WINDOW w AS (PARTITION BY user_pseudo_id ORDER BY day)),
ph AS (SELECT *, date_diff('day', day, nx) AS gap FROM hs)"""


def _history(spark, sf):
    return labels.purchase_days(bindings.events(spark, sf), bought=F.col("event_type") == "purchase")


@query("w13_purchase_gaps", with_ctes(EVENTS, HIST, """
SELECT user_pseudo_id, day, day_orders, CAST(i AS INTEGER) AS order_no, n AS n_orders, pr AS previous_purchase_date, nx AS next_purchase_date, CAST(gap AS DOUBLE) AS days_until_next_purchase,
 CASE WHEN gap IS NULL THEN 0 ELSE 1 END AS event_observed, CAST(coalesce(gap, date_diff('day', day, e)) AS INTEGER) AS time_to_event,
 CASE WHEN gap <= 30 THEN 1 ELSE 0 END AS repeat_purchase_30d, CASE WHEN gap <= 60 THEN 1 ELSE 0 END AS repeat_purchase_60d, CASE WHEN gap <= 90 THEN 1 ELSE 0 END AS repeat_purchase_90d FROM ph"""))
def w13(spark, sf):
    return _history(spark, sf)


@query("w13_customer_order_gaps", """
WITH od AS (SELECT CAST(o_custkey AS VARCHAR) AS user_pseudo_id, CAST(o_orderdate AS DATE) AS day, count(*) AS day_orders FROM orders GROUP BY 1, 2)
SELECT user_pseudo_id, day, day_orders, CAST(date_diff('day', day, lead(day) OVER (PARTITION BY user_pseudo_id ORDER BY day)) AS DOUBLE) AS days_until_next_purchase, count(*) OVER (PARTITION BY user_pseudo_id) AS n_orders FROM od""")
def w13b(spark, sf):
    from ..sources.readers import table

    o = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("user_pseudo_id"), F.to_date("o_orderdate").alias("day"))
    return labels.purchase_days(o).select("user_pseudo_id", "day", "day_orders", "days_until_next_purchase", "n_orders")


@query("w16_recency", with_ctes(WEB, """
g AS (SELECT *, CAST(date_diff('day', day, (SELECT max(day) FROM web)) AS DOUBLE) AS rec FROM web)""", """
SELECT user_pseudo_id, day, rec AS recency_days, strftime(day, '%Y-%m-%d') AS last_activity_date, CAST(purchases AS DOUBLE) AS purchase_frequency,
 CAST(CASE WHEN sessionCampaign <> '(not set)' THEN 1 ELSE 0 END AS DOUBLE) AS promo_exposure, (SELECT median(rec) FROM g) AS activity_label_threshold_days,
 CASE WHEN rec > (SELECT median(rec) FROM g) THEN 1 ELSE 0 END AS is_low_activity FROM g"""))
def w16(spark, sf):
    out = labels.quiet_traffic(labels.retention_signals(bindings.web_rows(spark, sf)))
    return out.select("user_pseudo_id", "day", "recency_days", "last_activity_date", "purchase_frequency", "promo_exposure", "activity_label_threshold_days", "is_low_activity")


CODE = lambda c: f"CAST(dense_rank() OVER (ORDER BY lower(trim({c}))) - 1 AS DOUBLE)"
BEHAVIOUR = f"""
bh AS (SELECT *, CAST(sessions AS DOUBLE) AS total_sessions, userEngagementDuration / CASE WHEN (SELECT median(userEngagementDuration) FROM web) > 1000 THEN 1000 ELSE 1 END AS engagement_time,
 percentScrolled AS scroll_depth, CASE WHEN addToCarts > 0 AND checkouts <= 0 THEN 1 ELSE 0 END AS cart_abandonment, CAST(addToCarts AS DOUBLE) AS add_to_carts, CAST(1 AS DOUBLE) AS promo_clicks,
 CAST(CASE WHEN searchTerm IS NOT NULL THEN 1 ELSE 0 END AS DOUBLE) AS search_clicks, (least(1, greatest(0, bounceRate)) + (1 - least(1, greatest(0, engagementRate)))) / 2 AS churn_risk,
 {CODE('itemCategory')} AS first_item_category_enc, {CODE('firstUserPrimaryChannelGroup')} AS acq_channel_enc, {CODE('age')} AS age_group_enc, {CODE('gender')} AS gender_enc, {CODE('deviceCategory')} AS device_enc,
 CASE WHEN purchases > 0 THEN 1 ELSE 0 END AS is_buyer FROM web)"""
PACK = ["first_item_category_enc", "total_sessions", "engagement_time", "scroll_depth", "cart_abandonment", "promo_clicks", "search_clicks", "churn_risk", "add_to_carts", "acq_channel_enc",
        "age_group_enc", "gender_enc", "device_enc"]


def _behaviour(spark, sf):
    w = labels.behaviour_pack(bindings.web_rows(spark, sf))
    return w.withColumn("is_buyer", (F.col("purchases") > 0).cast("int"))


@query("b0_behaviour_pack", with_ctes(WEB, BEHAVIOUR, "SELECT user_pseudo_id, day, " + ", ".join(c if c not in ("churn_risk", "engagement_time") else f"round({c}, 6) AS {c}" for c in PACK) + " FROM bh"))
def b0(spark, sf):
    return _behaviour(spark, sf).select("user_pseudo_id", "day", *[r(c, 6).alias(c) if c in ("churn_risk", "engagement_time") else c for c in PACK])


@query("b1_full_price_buyers", with_ctes(WEB, BEHAVIOUR, """
SELECT user_pseudo_id, day, CASE WHEN sessionCampaign = 'Summer Sale' THEN 1 ELSE 0 END AS bought_with_discount, CASE WHEN sessionCampaign = 'Summer Sale' THEN 0 ELSE 1 END AS is_full_price_buyer,
 'derived:campaign:sessionCampaign' AS target_source FROM bh WHERE is_buyer = 1"""))
def b1(spark, sf):
    out = labels.full_price_buyers(bindings.web_rows(spark, sf).withColumn("is_buyer", (F.col("purchases") > 0).cast("int")))
    return out.select("user_pseudo_id", "day", "bought_with_discount", "is_full_price_buyer", "target_source")


@query("b1_both_classes", with_ctes(WEB, """
SELECT count(*) FILTER (sessionCampaign <> 'Summer Sale') AS positives, count(*) FILTER (sessionCampaign = 'Summer Sale') AS negatives, 1 AS "both" FROM web WHERE purchases > 0"""))
def b1b(spark, sf):
    out = labels.full_price_buyers(bindings.web_rows(spark, sf).withColumn("is_buyer", (F.col("purchases") > 0).cast("int")))
    return labels.has_both_classes(out, "is_full_price_buyer")


@query("b2_repeat_buyers", with_ctes(WEB, HIST, """
us AS (SELECT user_pseudo_id, CASE WHEN count(*) >= 2 THEN 1 ELSE 0 END AS rep FROM od GROUP BY 1)""", """
SELECT web.user_pseudo_id, web.day, coalesce(rep, 0) AS is_repeat_buyer, CAST(itemsViewed AS DOUBLE) AS views_per_user, round(least(1, greatest(0, engagementRate)), 6) AS session_engaged_rate,
 CAST(month(web.day) AS DOUBLE) AS order_month, CAST(CASE WHEN isodow(web.day) >= 6 THEN 1 ELSE 0 END AS DOUBLE) AS is_weekend, CAST(dense_rank() OVER (ORDER BY itemCategory2) - 1 AS DOUBLE) AS item_category2_enc, 'longitudinal' AS target_source
FROM web LEFT JOIN us ON us.user_pseudo_id = web.user_pseudo_id"""))
def b2(spark, sf):
    w = labels.evaluation_pack(bindings.web_rows(spark, sf))
    out = labels.repeat_buyers(w, _history(spark, sf))
    return out.select("user_pseudo_id", "day", "is_repeat_buyer", "views_per_user", r("session_engaged_rate", 6).alias("session_engaged_rate"), "order_month", "is_weekend", "item_category2_enc", "target_source")


@query("b2_repeat_proxy", with_ctes(WEB, "SELECT user_pseudo_id, day, CASE WHEN purchases > 0 AND checkouts > 0 THEN 1 ELSE 0 END AS is_repeat_buyer, 'proxy' AS target_source FROM web"))
def b2b(spark, sf):
    w = bindings.web_rows(spark, sf).withColumns({"is_buyer": (F.col("purchases") > 0).cast("int"), "returningUsers": F.col("checkouts")})
    return labels.repeat_buyers(w).select("user_pseudo_id", "day", "is_repeat_buyer", "target_source")


@query("b3_high_value_buyers", with_ctes(WEB, """
SELECT user_pseudo_id, day, CASE WHEN purchases > 0 AND totalRevenue >= (SELECT quantile_cont(totalRevenue, 0.75) FROM web WHERE purchases > 0) THEN 1 ELSE 0 END AS is_high_ltv FROM web"""))
def b3(spark, sf):
    w = bindings.web_rows(spark, sf).withColumn("is_buyer", (F.col("purchases") > 0).cast("int"))
    return labels.high_value_buyers(w, "totalRevenue").select("user_pseudo_id", "day", "is_high_ltv")


NEXT = """
px AS (SELECT *, CAST(purchases AS DOUBLE) AS freq, greatest(CAST(sessions AS DOUBLE), 0.1) AS sess, least(1, greatest(0, engagementRate)) AS eng FROM web),
py AS (SELECT *, 150.0::DOUBLE / (1 + freq * 3 + freq * 1.5 + eng * 0.8::DOUBLE + 1 / sess) AS raw FROM px),
pz AS (SELECT py.*, CASE WHEN freq > 0 THEN least(120, greatest(7, raw)) ELSE least(180, greatest(120, greatest(raw, 120))) END AS proxy, CAST(ph.gap AS DOUBLE) AS gap FROM py LEFT JOIN ph ON ph.user_pseudo_id = py.user_pseudo_id AND ph.day = py.day),
pd AS (SELECT *, coalesce(gap, proxy) AS days FROM pz),
cs AS (SELECT itemCategory, sum(days) AS sd, count(*) AS nd, stddev_samp(days) AS st FROM pd GROUP BY 1)"""


@query("b4_days_to_next_purchase", with_ctes(WEB, HIST, NEXT, """
SELECT user_pseudo_id, day, round(days, 6) AS days_until_next_purchase, CASE WHEN gap IS NOT NULL THEN 'longitudinal' ELSE 'proxy' END AS target_source, round((sd - days) / (nd - 1), 6) AS cat_mean_target, round(st, 6) AS cat_std_target,
 CASE WHEN round(days, 6) <= round(greatest((sd - days) / (nd - 1) * 0.85::DOUBLE, 1), 6) THEN 1 ELSE 0 END AS is_repurchase_ready FROM pd JOIN cs USING (itemCategory)"""))
def b4(spark, sf):
    w = bindings.web_rows(spark, sf).select("user_pseudo_id", "day", "itemCategory", F.col("purchases").alias("purchase_frequency"), F.col("purchases").alias("previous_purchases"),
                                            F.col("sessions").alias("sessionsPerUser"), F.col("engagementRate").alias("session_engaged"))
    out = labels.days_to_next_purchase(w, _history(spark, sf), category="itemCategory")
    return out.select("user_pseudo_id", "day", r("days_until_next_purchase", 6).alias("days_until_next_purchase"), "target_source",
                      r("cat_mean_target", 6).alias("cat_mean_target"), r("cat_std_target", 6).alias("cat_std_target"), "is_repurchase_ready")


SCORES = """
rs AS (SELECT *, CAST(sessions AS DOUBLE) AS a1, purchases / CAST(greatest(sessions, 1) AS DOUBLE) AS a2, totalRevenue AS a3, userEngagementDuration * (1 + percentScrolled) / greatest(sessions, 1) AS a4,
  bounceRate + (1 - least(1, greatest(0, engagementRate))) AS a5, CAST(1 AS DOUBLE) / CASE WHEN purchases = 0 THEN 1 ELSE purchases END AS a6 FROM web),
mx AS (SELECT max(a1) AS m1, max(a2) AS m2, max(a3) AS m3, max(a4) AS m4, max(a5) AS m5, max(a6) AS m6 FROM rs)"""


@query("b5_activity_scores", with_ctes(WEB, SCORES, """
SELECT user_pseudo_id, day, round(a1 / m1, 6) AS session_volume_score, round(a2 / m2, 6) AS frequency_score, round(a3 / m3, 6) AS monetary_score, round(a4 / m4, 6) AS engagement_depth,
 round(a5 / m5, 6) AS behavioral_degradation, round(a6 / m6, 6) AS promo_sensitivity, CAST(0 AS DOUBLE) AS cart_abandon_severity, round(a2 / m2, 6) AS conversion_efficiency FROM rs, mx"""))
def b5(spark, sf):
    out = labels.activity_scores(bindings.web_rows(spark, sf))
    names = ["session_volume_score", "frequency_score", "monetary_score", "engagement_depth", "behavioral_degradation", "promo_sensitivity", "cart_abandon_severity", "conversion_efficiency"]
    return out.select("user_pseudo_id", "day", *[r(c, 6).alias(c) for c in names])


@query("b7_inactivity_churn", with_ctes(WEB, """
us AS (SELECT user_pseudo_id, max(day) AS la FROM web GROUP BY 1)""", """
SELECT web.user_pseudo_id, day, la AS last_active_date, CAST(date_diff('day', la, (SELECT max(day) FROM web)) AS DOUBLE) AS days_inactive,
 CASE WHEN date_diff('day', la, (SELECT max(day) FROM web)) > 1 THEN 1 ELSE 0 END AS is_churned FROM web JOIN us USING (user_pseudo_id)"""))
def b7(spark, sf):
    return labels.inactivity_churn(bindings.web_rows(spark, sf), threshold=1).select("user_pseudo_id", "day", "last_active_date", "days_inactive", "is_churned")


@query("b7_customer_churn_60d", """
WITH us AS (SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS la FROM orders GROUP BY 1)
SELECT o_orderkey, CAST(date_diff('day', la, (SELECT max(la) FROM us)) AS DOUBLE) AS days_inactive, CASE WHEN date_diff('day', la, (SELECT max(la) FROM us)) > 60 THEN 1 ELSE 0 END AS is_churned, 'inactivity_60d' AS target_source FROM orders JOIN us USING (o_custkey)""")
def b7b(spark, sf):
    from ..sources.readers import table

    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("user_pseudo_id"), F.to_date("o_orderdate").alias("day"))
    return labels.inactivity_churn(o).select("o_orderkey", "days_inactive", "is_churned", "target_source")


SENS = """
sn AS (SELECT user_pseudo_id, sum(purchases + addToCarts) AS a, sum(CASE WHEN sessionCampaign <> '(not set)' THEN purchases + addToCarts ELSE 0 END) AS p FROM web GROUP BY 1),
ss AS (SELECT user_pseudo_id, CASE WHEN a > 0 THEN p / CAST(a AS DOUBLE) ELSE 0 END AS s FROM sn)"""


@query("b8_promotion_sensitivity", with_ctes(WEB, SENS, """
SELECT web.user_pseudo_id, day, round(s, 6) AS promotion_sensitivity, CASE WHEN s >= 0.7::DOUBLE THEN 1 ELSE 0 END AS is_promo_sensitive, CAST(0.7 AS DOUBLE) AS promo_label_threshold FROM web JOIN ss USING (user_pseudo_id)"""))
def b8(spark, sf):
    out = labels.promotion_sensitivity(bindings.web_rows(spark, sf))
    return out.select("user_pseudo_id", "day", r("promotion_sensitivity", 6).alias("promotion_sensitivity"), "is_promo_sensitive", "promo_label_threshold")


@query("b9_buyer_churn_proxy", with_ctes(WEB, SCORES, """
fb AS (SELECT user_pseudo_id, day, purchases, CAST(date_diff('day', day, (SELECT max(day) FROM web)) AS DOUBLE) AS rec, CAST(purchases AS DOUBLE) AS freq, round(a5 / m5, 6) AS bd FROM rs, mx),
ct AS (SELECT median(rec) AS r0, median(freq) AS f0, median(bd) AS b0 FROM fb WHERE purchases > 0)""", """
SELECT user_pseudo_id, day, CASE WHEN purchases > 0 AND rec > r0 AND (freq <= f0 OR bd > b0) THEN 1 ELSE 0 END AS churn_proxy FROM fb, ct"""))
def b9(spark, sf):
    w = labels.activity_scores(labels.retention_signals(bindings.web_rows(spark, sf)))
    w = w.withColumns({"is_buyer": (F.col("purchases") > 0).cast("int"), "behavioral_degradation": r("behavioral_degradation", 6)})
    return labels.buyer_churn_proxy(w.select("user_pseudo_id", "day", "is_buyer", "recency_days", "purchase_frequency", "behavioral_degradation", "engagementRate")).select("user_pseudo_id", "day", "churn_proxy")


@query("b10_label_provenance", with_ctes(WEB, HIST, """
SELECT CASE WHEN ph.gap IS NOT NULL THEN 'longitudinal' ELSE 'proxy' END AS target_source, count(*) AS n FROM web LEFT JOIN ph ON ph.user_pseudo_id = web.user_pseudo_id AND ph.day = web.day GROUP BY 1"""))
def b10(spark, sf):
    out = labels.days_to_next_purchase(bindings.web_rows(spark, sf), _history(spark, sf))
    return out.groupBy("target_source").agg(F.count("*").alias("n"))


@query("b11_feature_master", with_ctes(WEB, BEHAVIOUR, "SELECT " + ", ".join(
    f"round({c}, 6) AS {c}" if c in ("churn_risk", "engagement_time") else f"CAST({c} AS DOUBLE) AS {c}" for c in PACK if c != "promo_clicks")
    + ", CASE WHEN sessionCampaign = 'Summer Sale' THEN 0 ELSE 1 END AS is_full_price_buyer FROM bh WHERE is_buyer = 1"))
def b11(spark, sf):
    result = contracts.build(1, bindings.web_rows(spark, sf))
    master = contracts.feature_master(result)
    return master.select(*[r(c, 6).alias(c) if c in ("churn_risk", "engagement_time") else F.col(c).cast("double").alias(c) for c in result.features], result.contract.target)


@query("b12_contract_results")
def b12(spark, sf):
    """Rows, features and label rate of every contract, on the web rows or, for the demand of items, on the item events."""
    from ..session import written

    web, out = written(bindings.web_rows(spark, sf)), None
    pack = written(contracts.behaviour(web))
    for number in sorted(contracts.CONTRACTS):
        result = contracts.build(number, item_rows(spark, sf) if number == 6 else web, pack=pack)
        row = result.frame.agg(F.lit(number).alias("contract"), F.lit(len(result.features)).alias("n_features"), F.count("*").alias("n_rows"), F.avg(result.contract.target).alias("target_mean"))
        out = row if out is None else out.unionByName(row)
    return out


@query("x15_master_set", with_ctes(SALES, """
m AS (SELECT l_orderkey, l_linenumber, units_sold, discount_pct, promo_flag, stock_out_flag, channel, row_number() OVER (ORDER BY l_orderkey, l_linenumber, units_sold, discount_pct) AS i FROM sales)""", """
SELECT count(*) AS n_rows, CAST(min(i) AS BIGINT) AS first_id, CAST(max(i) AS BIGINT) AS last_id, round(avg((units_sold - (SELECT min(units_sold) FROM sales)) / CAST((SELECT max(units_sold) - min(units_sold) FROM sales) AS DOUBLE)), 6) AS mean_units,
 round(avg(CASE WHEN channel = '1-URGENT' THEN 1.0 ELSE 0 END), 6) AS urgent_share FROM m"""))
def x15(spark, sf):
    from ..plans.master_set import build_master

    s = bindings.sales(spark, sf, orders=True).select("l_orderkey", "l_linenumber", "units_sold", "discount_pct", "stock_out_flag", "channel")
    result = build_master(s, None, protected=["l_orderkey", "l_linenumber"], order=["l_orderkey", "l_linenumber", "units_sold", "discount_pct"], outliers=None)
    return result.frame.agg(F.count("*").alias("n_rows"), F.min("master_id").alias("first_id"), F.max("master_id").alias("last_id"), r(F.avg("units_sold"), 6).alias("mean_units"),
                            r(F.avg("channel_1_URGENT"), 6).alias("urgent_share"))


@query("x15_master_set_full")
def x15b(spark, sf):
    from ..plans.master_set import build_master

    ud = bindings.user_days(spark, sf).withColumn("device", F.concat(F.lit("d"), F.pmod(F.col("user_pseudo_id").cast("int"), F.lit(9))))
    return build_master(ud.drop("spend"), "outcome", protected=["user_pseudo_id", "day"], order=["user_pseudo_id", "day"]).frame


@query("z1_root_and_ceiling", "SELECT o_orderkey, CAST(ceil(1.65::DOUBLE * sqrt(o_totalprice)) AS BIGINT) AS v FROM orders")
def z1(spark, sf):
    from ..sources.readers import table

    return table(spark, sf, "orders").select("o_orderkey", F.ceil(F.lit(1.65) * F.sqrt("o_totalprice")).cast("bigint").alias("v"))


@query("c3_fuzzy_columns", with_ctes(WEB, "SELECT user_pseudo_id, day, addToCarts AS carts, totalRevenue AS revenue FROM web"))
def c3(spark, sf):
    from ..functions.naming import find_column

    w = bindings.web_rows(spark, sf)
    carts, revenue = find_column(w.columns, "ADD_TO_CARTS"), find_column(w.columns, "no such", "revenue")
    return w.select("user_pseudo_id", "day", F.col(carts).alias("carts"), F.col(revenue).alias("revenue"))
