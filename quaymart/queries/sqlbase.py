"""Common table expressions of the checking SQL, written independently of the Spark bindings."""

SALES = """
priced AS (
  SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS ext_cents, CAST(l_quantity AS BIGINT) AS q,
         CAST(round(l_tax * 100) AS BIGINT) AS tax100
  FROM lineitem),
priced2 AS (SELECT *, (2 * ext_cents + q) // (2 * q) AS lp FROM priced),
priced3 AS (SELECT *, (2 * lp * (90 - tax100) + 100) // 200 AS pc FROM priced2),
sales AS (
  SELECT CAST(l_shipdate AS DATE) AS date, l_partkey AS sku_id, l_suppkey AS supplier_id, q AS units_sold,
         lp AS list_cents, pc AS cost_cents, (lp - pc) / CAST(lp AS DOUBLE) AS margin_pct,
         l_discount AS discount_pct, CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END AS promo_flag,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS stock_out_flag, l_orderkey, l_linenumber,
         o_orderpriority AS channel, CAST(o_orderdate AS DATE) AS order_date, o_custkey AS customer_id,
         1 + (((date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) % 14) + 14) % 14) AS lead_time_days,
         p_brand AS brand, p_type AS category, p_size * 10 AS stock_on_hand, s_nationkey AS store_id
  FROM priced3 JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
       JOIN supplier ON l_suppkey = s_suppkey)
"""

EVENTS = """
ev AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS user_pseudo_id, user_id AS uid, ts, CAST(ts AS DATE) AS day, event_type,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(round(value * 100) AS BIGINT) AS cents
  FROM events)
"""

WEB = EVENTS + """,
wd AS (
  SELECT user_pseudo_id, uid, day, count(*) AS eventCount,
         count(*) FILTER (event_type = 'view') AS itemsViewed, count(*) FILTER (event_type = 'click') AS addToCarts,
         count(*) FILTER (event_type = 'signup') AS checkouts, count(*) FILTER (event_type = 'purchase') AS purchases,
         count(*) FILTER (event_type = 'error') AS errs, count(DISTINCT extract(hour FROM ts)) AS sessions,
         sum(CASE WHEN event_type = 'purchase' THEN cents ELSE 0 END) AS rev,
         sum(CASE WHEN event_type = 'purchase' THEN 0 ELSE cents END) AS eng, min(k) AS lo, max(k) AS hi
  FROM ev GROUP BY 1, 2, 3),
web AS (
  SELECT user_pseudo_id, uid, day, CAST(strftime(day, '%Y%m%d') AS INTEGER) AS date, sessions, eventCount, itemsViewed,
         addToCarts, checkouts, purchases, CAST(rev AS DOUBLE) / 100 AS totalRevenue,
         CAST(eng AS DOUBLE) / 100 AS userEngagementDuration, errs / CAST(eventCount AS DOUBLE) AS bounceRate,
         (itemsViewed + addToCarts) / CAST(eventCount AS DOUBLE) AS engagementRate, CAST(hi AS DOUBLE) AS percentScrolled,
         'cat_' || (lo % 8) AS itemCategory, 'type_' || (hi % 12) AS itemCategory2,
         CASE uid % 3 WHEN 0 THEN 'desktop' WHEN 1 THEN 'mobile' ELSE 'tablet' END AS deviceCategory,
         CASE lo % 3 WHEN 0 THEN 'Summer Sale' WHEN 1 THEN 'Newsletter' ELSE '(not set)' END AS sessionCampaign,
         CASE WHEN hi % 5 = 0 THEN 'term' || hi END AS searchTerm,
         'channel_' || (uid % 5) AS firstUserPrimaryChannelGroup, 'age_' || (uid % 6) AS age,
         'gender_' || (uid % 2) AS gender, 'city_' || (uid % 7) AS city
  FROM wd)
"""

USER_DAYS = EVENTS + """,
ud AS (
  SELECT user_pseudo_id, day,
         CAST(count(*) FILTER (event_type = 'view') AS DOUBLE) AS views,
         CAST(count(*) FILTER (event_type = 'click') AS DOUBLE) AS carts,
         CAST(count(*) FILTER (event_type = 'signup') AS DOUBLE) AS signups,
         CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) AS errors,
         CAST(count(DISTINCT extract(hour FROM ts)) AS DOUBLE) AS hours,
         CAST(sum(CASE WHEN event_type = 'purchase' THEN 0 ELSE cents END) AS DOUBLE) / 100 AS other_value,
         max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS outcome,
         CAST(sum(CASE WHEN event_type = 'purchase' THEN cents ELSE 0 END) AS DOUBLE) / 100 AS spend
  FROM ev GROUP BY 1, 2)
"""


def with_ctes(*parts: str) -> str:
    """Join CTE blocks and the final SELECT, which is the last part."""
    return "WITH " + ", ".join(p.strip().rstrip(",") for p in parts[:-1]) + " " + parts[-1]
