"""Queries of schema, merge, cleaning, encoding, selection and sampling operators."""

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import cleaning, columns, diagnostics, encoding, joins, sampling, selection
from ..sources import bindings, readers, writers
from .registry import query
from .sqlbase import SALES, USER_DAYS, WEB, with_ctes

r = F.round
FEATURES = bindings.INDEX_FEATURES


def table(spark, sf, name):
    return readers.table(spark, sf, name)


@query("c1_normalised_names", "SELECT c_custkey AS customer_key, c_mktsegment AS market_segment, c_acctbal AS account_balance FROM customer")
def c1(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias(" Customer Key"), F.col("c_mktsegment").alias("Market Segment "),
                                            F.col("c_acctbal").alias("ACCOUNT_balance"))
    return columns.normalised(c)


@query("c4_alias_mapping", with_ctes(WEB, """
SELECT user_pseudo_id, day, CAST(itemsViewed AS DOUBLE) AS items_viewed, CAST(addToCarts AS DOUBLE) AS items_added_to_cart, bounceRate AS bounce_rate,
 CAST(checkouts AS DOUBLE) AS checkouts_per_user FROM web"""))
def c4(spark, sf):
    w = columns.aliased(bindings.web_rows(spark, sf), {
        "items_viewed": ["items_viewed", "itemsViewed"], "items_added_to_cart": ["items_added_to_cart", "itemsAddedToCart", "addToCarts"],
        "bounce_rate": ["bounce_rate", "bounceRate"], "checkouts_per_user": ["checkouts_per_user", "checkoutsPerUser", "checkouts"]})
    return w.select("user_pseudo_id", "day", "items_viewed", "items_added_to_cart", "bounce_rate", "checkouts_per_user")


TEXTED = """CASE WHEN l_linenumber = 1 THEN 'n/a' WHEN l_linenumber = 2 THEN '' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ',000 units' END"""


def _texted(line):
    units = F.concat(F.col("l_quantity").cast("bigint").cast("string"), F.lit(",000 units"))
    return line.withColumn("amount", F.when(F.col("l_linenumber") == 1, "n/a").when(F.col("l_linenumber") == 2, "").otherwise(units))


@query("c5_numeric_text", f"""
SELECT l_linenumber, count(*) AS n, CAST(sum(CASE WHEN l_linenumber > 2 THEN CAST(l_quantity AS BIGINT) * 1000 END) AS DOUBLE) AS total FROM (SELECT *, {TEXTED} AS amount FROM lineitem) GROUP BY 1""")
def c5(spark, sf):
    line = _texted(table(spark, sf, "lineitem"))
    return line.withColumn("v", scalars.number_in_text("amount")).groupBy("l_linenumber").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("c5_coercion_gate", """
SELECT 'amount' AS "column", count(*) AS given, count(*) FILTER (l_linenumber > 2) AS kept, CASE WHEN count(*) FILTER (l_linenumber > 2) / CAST(count(*) AS DOUBLE) >= 0.8 THEN 1 ELSE 0 END AS numeric FROM lineitem
UNION ALL SELECT 'l_returnflag', count(l_returnflag), 0, 0 FROM lineitem""")
def c5b(spark, sf):
    return columns.coercion_report(_texted(table(spark, sf, "lineitem")), ["amount", "l_returnflag"])


TIME_CASES = """
SELECT event_id, CAST(ts AS DATE) AS day, kind FROM events, (SELECT unnest(['ymd', 's', 'ms', 'us', 'text']) AS kind)"""


@query("c6_mixed_timestamps", TIME_CASES)
def c6(spark, sf):
    o = table(spark, sf, "events").select("event_id", F.to_date("ts").alias("d"))
    moment = F.unix_timestamp(F.col("d").cast("timestamp"))
    cases = {"ymd": F.date_format("d", "yyyyMMdd").cast("bigint"), "s": moment, "ms": moment * 1000, "us": moment * 1000000,
             "text": F.date_format("d", "yyyy-MM-dd HH:mm:ss")}
    out = None
    for kind, raw in cases.items():
        part = columns.parsed_time(o.select("event_id", raw.alias("raw")), "raw").select(
            "event_id", F.to_date("event_time").alias("day"), F.lit(kind).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out


@query("c7_stable_ids", "SELECT event_id, CAST(CAST(user_id AS HUGEINT) * 10000000000000 AS VARCHAR) AS user_pseudo_id, CAST(event_id AS VARCHAR) AS text_id FROM events")
def c7(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("user_id").cast("double") * 1e13).alias("uid"),
                                          F.concat(F.col("event_id").cast("string"), F.lit(".0")).alias("eid"))
    return columns.with_stable_id(columns.with_stable_id(e, "uid"), "eid", "text_id").select("event_id", "user_pseudo_id", "text_id")


@query("c8_forbidden_columns", with_ctes(WEB, "SELECT user_pseudo_id, day, sessions, addToCarts FROM web"))
def c8(spark, sf):
    w = bindings.web_rows(spark, sf).select("user_pseudo_id", "day", "sessions", "addToCarts", "totalRevenue", "purchases", "sessionCampaign")
    return columns.without(w, ["total_revenue", "Purchases", "session campaign", "not there"])


@query("c9_empty_columns", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem")
def c9(spark, sf):
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.lit(None).cast("double").alias("empty"), F.col("l_partkey"))
    return columns.without_empty(line)


@query("c10_row_ids", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS row_id FROM orders")
def c10(spark, sf):
    return columns.with_row_id(table(spark, sf, "orders"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "row_id")


@query("c11_merge_report", """
SELECT 'l_tax' AS "column", CAST(0 AS BIGINT) AS nulls, count(*) AS n_rows, 0 AS only_flags, 0 AS name_clash, 0 AS mostly_null FROM lineitem
UNION ALL SELECT 'flag', count(*) FILTER (l_linenumber = 1), count(*), 1, 0, 0 FROM lineitem
UNION ALL SELECT 'rare', count(*) FILTER (l_quantity < 50), count(*), 0, 0, CASE WHEN count(*) FILTER (l_quantity < 50) / CAST(count(*) AS DOUBLE) > 0.95 THEN 1 ELSE 0 END FROM lineitem""")
def c11(spark, sf):
    line = table(spark, sf, "lineitem")
    return columns.merge_report(line.select("l_tax", F.when(F.col("l_linenumber") > 1, (F.col("l_discount") > 0.05).cast("int")).alias("flag"),
                                            F.when(F.col("l_quantity") >= 50, F.col("l_quantity")).alias("rare")))


@query("c12_target_verdict", """
SELECT 'o_orderstatus' AS target, count(*) AS n_rows, count(*) AS valid_rows, 'ok' AS verdict FROM orders
UNION ALL SELECT 'constant', count(*), count(*), 'only one class' FROM orders
UNION ALL SELECT 'sparse', count(*), count(*) FILTER (o_orderstatus = 'P'), 'too many missing values' FROM orders
UNION ALL SELECT 'empty', count(*), 0, 'no usable values' FROM orders""")
def c12(spark, sf):
    o = table(spark, sf, "orders").withColumns({"constant": F.lit(1), "empty": F.lit(None).cast("int"),
                                                "sparse": F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey"))})
    out = None
    for target in ("o_orderstatus", "constant", "sparse", "empty"):
        v = columns.target_verdict(o, target).withColumn("target", F.lit(target))
        out = v if out is None else out.unionByName(v)
    return out


@query("c13_task_type")
def c13(spark, sf):
    from ..functions.naming import task_type

    c = table(spark, sf, "customer")
    n = c.agg(F.approx_count_distinct("c_acctbal").alias("n")).first()["n"]
    return c.agg(F.count_distinct("c_acctbal").alias("distinct_values")).withColumn("task", F.lit(task_type(n, True)))


@query("c14_coded_outcome", "SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS DOUBLE) AS code FROM orders")
def c14(spark, sf):
    return columns.coded_outcome(table(spark, sf, "orders"), "o_orderstatus", "F", "O", name="code").select("o_orderkey", F.col("code").cast("double").alias("code"))


@query("c14_unmapped_outcomes", "SELECT o_orderstatus AS value, count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('F', 'O') GROUP BY 1")
def c14b(spark, sf):
    return columns.unmapped_outcomes(table(spark, sf, "orders"), "o_orderstatus", "F", "O")


@query("c15_binary_target", """
SELECT c_custkey, CASE WHEN c_acctbal >= (SELECT median(c_acctbal) FROM customer) THEN 1 ELSE 0 END AS rich, CASE WHEN c_nationkey > 12 THEN 1 ELSE 0 END AS flag,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END AS word FROM customer""")
def c15(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("rich"), (F.col("c_nationkey") > 12).cast("int").alias("flag"),
                                            F.when(F.col("c_mktsegment") == "MACHINERY", " Yes").otherwise("no").alias("word"))
    for column in ("rich", "flag", "word"):
        c = columns.binary_target(c, column)
    return c


@query("c16_buyer_flag", with_ctes(WEB, "SELECT user_pseudo_id, day, CASE WHEN purchases > 0 THEN 1 ELSE 0 END AS is_buyer FROM web"))
def c16(spark, sf):
    return columns.with_buyer_flag(bindings.web_rows(spark, sf).select("user_pseudo_id", "day", "purchases"))


@query("c16_buyer_flag_from_id", "SELECT event_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS is_buyer FROM events")
def c16b(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "purchase", F.col("event_id").cast("string"))
                                          .when(F.col("event_type") == "view", " NULL ").alias("transaction_id"))
    return columns.with_buyer_flag(e)


@query("p3_filled_values", with_ctes(WEB, """
SELECT user_pseudo_id, day, CASE WHEN sessionCampaign <> '(not set)' THEN 1 ELSE 0 END AS has_campaign, CASE WHEN searchTerm IS NOT NULL THEN 1 ELSE 0 END AS has_term FROM web"""))
def p3(spark, sf):
    return bindings.web_rows(spark, sf).select("user_pseudo_id", "day", scalars.is_filled("sessionCampaign", scalars.UNSET_CAMPAIGN_TEXTS).cast("int").alias("has_campaign"),
                                               scalars.is_filled("searchTerm").cast("int").alias("has_term"))


@query("p4_discount_campaign", with_ctes(WEB, "SELECT user_pseudo_id, day, CASE WHEN sessionCampaign ILIKE '%sale%' THEN 1 ELSE 0 END AS discounted FROM web"))
def p4(spark, sf):
    return bindings.web_rows(spark, sf).select("user_pseudo_id", "day", scalars.looks_discounted("sessionCampaign").cast("int").alias("discounted"))


@query("p5_clip_range", "SELECT c_custkey, greatest(0, least(5000, c_acctbal)) AS clipped, CASE WHEN c_acctbal BETWEEN 1000 AND 2000 THEN 1 ELSE 0 END AS inside FROM customer")
def p5(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", scalars.clip("c_acctbal", 0.0, 5000.0).alias("clipped"), F.col("c_acctbal").between(1000, 2000).cast("int").alias("inside"))


@query("p7_membership", """
SELECT c_custkey, 'member' AS side FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)
UNION ALL SELECT c_custkey, 'other' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)""")
def p7(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey")
    big = table(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.members(c, big, ["c_custkey"]).withColumn("side", F.lit("member")).unionByName(
        joins.non_members(c, big, ["c_custkey"]).withColumn("side", F.lit("other")))


@query("j1_outer_merge", """
SELECT coalesce(a.k, b.k) AS k, a.spend, a.note, b.lines, b.note AS note_dup FROM (SELECT o_custkey AS k, CAST(count(*) AS BIGINT) AS spend, 'orders' AS note FROM orders GROUP BY 1) a
FULL JOIN (SELECT c_custkey AS k, c_acctbal AS lines, c_mktsegment AS note FROM customer) b ON a.k = b.k""")
def j1(spark, sf):
    a = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("spend")).withColumn("note", F.lit("orders"))
    b = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("lines"), F.col("c_mktsegment").alias("note"))
    return joins.merged([a, b], ["k", "unknown"])


@query("j2_baseline_merge", """
SELECT coalesce(b.k, u.k) AS k, coalesce(u.seg, b.seg) AS seg, b.bal, u.nation FROM (SELECT c_custkey AS k, c_mktsegment AS seg, c_acctbal AS bal FROM customer) b
FULL JOIN (SELECT s_suppkey * 2 AS k, CASE WHEN s_acctbal < 0 THEN NULL ELSE lower(s_name) END AS seg, s_nationkey AS nation FROM supplier) u ON b.k = u.k""")
def j2(spark, sf):
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    base = c.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("bal"))
    up = s.select((F.col("s_suppkey") * 2).alias("k"), F.when(F.col("s_acctbal") >= 0, F.lower("s_name")).alias("seg"), F.col("s_nationkey").alias("nation"))
    return joins.merged_over_baseline(base, up, ["k"])


@query("j3_positional_merge", """
SELECT coalesce(a.position, b.position) AS position, a.c_custkey, b.s_suppkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS position FROM customer) a
FULL JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS position FROM supplier) b ON a.position = b.position""")
def j3(spark, sf):
    out = joins.merged_by_position(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"),
                                   ["c_acctbal", "c_custkey"], ["s_acctbal", "s_suppkey"])
    return out.select("position", "c_custkey", "s_suppkey")


@query("j8_score_to_rows", with_ctes(WEB, """
g AS (SELECT user_pseudo_id, CASE WHEN sum(purchases + addToCarts) > 0 THEN sum(CASE WHEN sessionCampaign <> '(not set)' THEN purchases + addToCarts ELSE 0 END) / CAST(sum(purchases + addToCarts) AS DOUBLE) ELSE 0 END AS s FROM web GROUP BY 1)""",
      "SELECT web.user_pseudo_id, day, round(s, 6) AS promotion_sensitivity FROM web JOIN g USING (user_pseudo_id)"))
def j8(spark, sf):
    from ..operators.labels import promotion_sensitivity

    return promotion_sensitivity(bindings.web_rows(spark, sf)).select("user_pseudo_id", "day", r("promotion_sensitivity", 6).alias("promotion_sensitivity"))


@query("j9_latest_record", "SELECT * FROM (SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)")
def j9(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    return joins.latest_per_key(e, ["user_id"], "ts", "event_id").drop("ts")


@query("u1_row_stack", "SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier")
def u1(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return joins.stacked([c, s])


@query("u3_recombine", "SELECT o_orderstatus, count(*) AS n, CAST(count(DISTINCT o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1")
def u3(spark, sf):
    o = table(spark, sf, "orders")
    parts = [o.where(F.col("o_orderstatus") == s) for s in ("F", "O")] + [o.where(~F.col("o_orderstatus").isin("F", "O"))]
    return joins.stacked(parts).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("keys"))


@query("a2_user_rollup", with_ctes(WEB, """
SELECT user_pseudo_id, min(date) AS date, CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(purchases) AS BIGINT) AS purchases, round(sum(bounceRate), 6) AS bounceRate,
  max(CASE WHEN purchases > 0 THEN 1 ELSE 0 END) AS is_buyer, arg_min(itemCategory, row(day, itemCategory)) AS itemCategory, min(day) AS day FROM web GROUP BY 1"""))
def a2(spark, sf):
    w = bindings.web_rows(spark, sf).select("user_pseudo_id", "date", "sessions", "purchases", "bounceRate", (F.col("purchases") > 0).cast("int").alias("is_buyer"), "itemCategory", "day")
    return joins.rolled_up(w, "user_pseudo_id", "day").withColumn("bounceRate", r("bounceRate", 6))


@query("a22_group_transform", """
SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_orderpriority), 4) AS mean_value, round(stddev_samp(o_totalprice) OVER (PARTITION BY o_orderpriority), 4) AS std_value, n AS n_status
FROM orders JOIN (SELECT o_orderpriority, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY 1) USING (o_orderpriority)""")
def a22(spark, sf):
    from ..operators.labels import group_transform

    out = group_transform(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice", "o_orderstatus")
    return out.select("o_orderkey", r("group_mean", 4).alias("mean_value"), r("group_std", 4).alias("std_value"), F.col("group_distinct").alias("n_status"))


# Orders with holes: a missing price for every seventh key, a missing status for every fifth, a nearly empty column.
HOLES = """
h AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice * o_totalprice END AS skewed,
   CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 50 = 0 THEN 1 END AS sparse, CASE WHEN o_orderkey % 10 < 7 THEN o_custkey END AS cust FROM orders)"""


def _holes(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.when(k % 7 != 0, F.col("o_totalprice")).alias("price"), F.when(k % 7 != 0, F.col("o_totalprice") * F.col("o_totalprice")).alias("skewed"),
        F.when(k % 5 != 0, F.col("o_orderstatus")).alias("status"), F.when(k % 50 == 0, F.lit(1)).alias("sparse"), F.when(k % 10 < 7, F.col("o_custkey")).alias("cust"))


FILL = "CASE WHEN abs(skewness({c})) > 0.5 THEN median({c}) ELSE avg({c}) END"


@query("x1_imputation", with_ctes(HOLES, f"""
f AS (SELECT {FILL.format(c='price')} AS p, {FILL.format(c='skewed')} AS s, {FILL.format(c='cust')} AS c FROM h),
m AS (SELECT status AS st FROM h WHERE status IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)""", """
SELECT o_orderkey, round(coalesce(price, p), 4) AS price, round(coalesce(skewed, s), 2) AS skewed, coalesce(status, st) AS status, round(coalesce(cust, c), 6) AS cust FROM h, f, m"""))
def x1(spark, sf):
    h = _holes(spark, sf)
    out = cleaning.imputation(h, ["o_orderkey"]).apply(h)
    return out.withColumns({"price": r("price", 4), "skewed": r("skewed", 2), "cust": r("cust", 6)})


@query("x1b_imputation_mean", with_ctes(HOLES, """
f AS (SELECT avg(price) AS p, avg(skewed) AS s, avg(cust) AS c FROM h), m AS (SELECT status AS st FROM h WHERE status IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)""", """
SELECT o_orderkey, round(coalesce(price, p), 4) AS price, round(coalesce(skewed, s) / 1000000, 4) AS skewed, coalesce(status, st) AS status, round(coalesce(cust, c), 6) AS cust FROM h, f, m"""))
def x1b(spark, sf):
    h = _holes(spark, sf)
    out = cleaning.imputation(h, ["o_orderkey"], drop_above=0.40, always_mean=True).apply(h)
    return out.withColumns({"price": r("price", 4), "skewed": r(F.col("skewed") / 1000000, 4), "cust": r("cust", 6)})


def _bounds_sql(source, cols):
    parts = [f"""SELECT '{c}' AS col, count({c}) AS n, count(DISTINCT {c}) AS d, avg({c}) AS m, stddev_samp({c}) AS s, CASE WHEN min({c}) <= 0 THEN abs(min({c})) + 1.0 ELSE 0.0 END AS o FROM {source}""" for c in cols]
    logs = [f"""SELECT '{c}' AS col, avg(ln({c} + o + 1)) AS lm, stddev_samp(ln({c} + o + 1)) AS ls FROM {source}, b0 WHERE col = '{c}'""" for c in cols]
    return f"""
b0 AS ({' UNION ALL '.join(parts)}), b1 AS ({' UNION ALL '.join(logs)}),
bd AS (SELECT col, CASE WHEN abs(m) >= 1e-9 THEN s / abs(m) END AS variation, CASE WHEN n < 3 OR d <= 2 THEN 'skipped' WHEN abs(m) < 1e-9 OR s / abs(m) >= 0.5 THEN 'log z-score' ELSE '3 deviations' END AS method,
  CASE WHEN n < 3 OR d <= 2 THEN NULL WHEN abs(m) < 1e-9 OR s / abs(m) >= 0.5 THEN exp(lm - 3 * ls) - o - 1 ELSE m - 3 * s END AS lower,
  CASE WHEN n < 3 OR d <= 2 THEN NULL WHEN abs(m) < 1e-9 OR s / abs(m) >= 0.5 THEN exp(lm + 3 * ls) - o - 1 ELSE m + 3 * s END AS upper FROM b0 JOIN b1 USING (col))"""


OUT_COLS = ["views", "carts", "errors", "other_value"]
BOUNDS = _bounds_sql("ud", [*OUT_COLS, "outcome"])


@query("x3_outlier_report", with_ctes(USER_DAYS, BOUNDS, """
SELECT col AS "column", method, round(variation, 6) AS variation, round(lower, 6) AS lower, round(upper, 6) AS upper FROM bd"""))
def x3(spark, sf):
    out = cleaning.outlier_bounds(bindings.user_days(spark, sf), [*OUT_COLS, "outcome"])
    return out.withColumns({c: r(c, 6) for c in ("variation", "lower", "upper")})


WITHIN = " AND ".join(f"({c} BETWEEN (SELECT lower FROM bd WHERE col = '{c}') AND (SELECT upper FROM bd WHERE col = '{c}'))" for c in OUT_COLS)


@query("x2_outlier_rows", with_ctes(USER_DAYS, BOUNDS, f"""
kp AS (SELECT * FROM ud WHERE {WITHIN}),
q AS (SELECT {', '.join(f"quantile_cont({c}, 0.01) AS {c}_a, quantile_cont({c}, 0.99) AS {c}_b" for c in OUT_COLS)} FROM kp)""", f"""
SELECT user_pseudo_id, day, outcome, {', '.join(f"round(greatest({c}_a, least({c}_b, {c})), 6) AS {c}" for c in OUT_COLS)} FROM kp, q"""))
def x2(spark, sf):
    out = cleaning.without_outliers(bindings.user_days(spark, sf).select("user_pseudo_id", "day", "outcome", *OUT_COLS), OUT_COLS)
    return out.withColumns({c: r(c, 6) for c in OUT_COLS})


def _sequential_sql():
    steps, source = [], "ud"
    for i, c in enumerate(OUT_COLS):
        block = _bounds_sql(source, [c]).replace("b0", f"b0_{i}").replace("b1", f"b1_{i}").replace("bd AS", f"bd_{i} AS").strip()
        steps.append(block)
        steps.append(f"k{i} AS (SELECT {source}.* FROM {source}, bd_{i} WHERE {c} BETWEEN lower AND upper)")
        steps.append(f"w{i} AS (SELECT k{i}.* REPLACE (greatest(a, least(b, {c})) AS {c}) FROM k{i}, (SELECT quantile_cont({c}, 0.01) AS a, quantile_cont({c}, 0.99) AS b FROM k{i}))")
        source = f"w{i}"
    return steps, source


SEQ, SEQ_LAST = _sequential_sql()


@query("x2_outlier_rows_sequential", with_ctes(USER_DAYS, *SEQ, f"""
SELECT user_pseudo_id, day, outcome, {', '.join(f"round({c}, 6) AS {c}" for c in OUT_COLS)} FROM {SEQ_LAST}"""))
def x2b(spark, sf):
    from ..session import durable

    # The user-day table is folded once and written, because every column takes a pass of its own.
    rows = durable(bindings.user_days(spark, sf).select("user_pseudo_id", "day", "outcome", *OUT_COLS))
    return cleaning.without_outliers(rows, OUT_COLS, mode="sequential").withColumns({c: r(c, 6) for c in OUT_COLS})


@query("x4_five_plus_one", """
WITH t AS (SELECT p_type, row_number() OVER (ORDER BY count(*) DESC, p_type) AS i FROM part GROUP BY 1),
b AS (SELECT p_brand, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS i FROM part GROUP BY 1),
e AS (SELECT p_partkey, coalesce(tt.i, 99) AS ti, coalesce(bb.i, 99) AS bi FROM part LEFT JOIN t tt ON tt.p_type = part.p_type LEFT JOIN b bb ON bb.p_brand = part.p_brand)
SELECT 'p_type' AS base, CASE WHEN ti <= 5 THEN (SELECT p_type FROM t WHERE i = ti) ELSE 'Others' END AS category, count(*) AS n FROM e GROUP BY 2
UNION ALL SELECT 'p_brand', CASE WHEN bi <= 5 THEN (SELECT p_brand FROM b WHERE i = bi) ELSE 'Others' END, count(*) FROM e GROUP BY 2""")
def x4(spark, sf):
    out, meta = encoding.one_hot(table(spark, sf, "part").select("p_partkey", "p_type", "p_brand"), ["p_type", "p_brand"])
    cells = [F.struct(F.lit(b).alias("base"), F.lit(c).alias("category"), F.sum(e).cast("bigint").alias("n")) for e, (b, c) in meta.mapping.items()]
    return out.agg(F.array(*cells).alias("_a")).select(F.inline("_a")).where("n > 0")


@query("x5_code_or_one_hot", """
SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY lower(o_orderdate_txt)) - 1 AS DOUBLE) AS month_text, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS o_orderstatus_F,
 CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS o_orderstatus_O, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS o_orderstatus_P FROM (SELECT *, strftime(o_orderdate, '%m') AS o_orderdate_txt FROM orders)""")
def x5(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "MM").alias("month_text"), "o_orderstatus")
    return encoding.coded_or_one_hot(o, ["month_text", "o_orderstatus"])


@query("w10_ordinal_codes", """
SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY lower(trim(p_name))) - 1 AS DOUBLE) AS name_code FROM part""")
def w10(spark, sf):
    return columns.ordinal_codes(table(spark, sf, "part").select("p_partkey", "p_name"), {"p_name": "name_code"}).select("p_partkey", "name_code")


ALL = [*FEATURES, "outcome"]
PAIRS = [(a, b) for i, a in enumerate(ALL) for b in ALL[i + 1:]]


@query("x6_target_correlation", with_ctes(USER_DAYS, " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(corr({c}, outcome), 6) AS corr, count(*) AS n, CASE WHEN abs(corr({c}, outcome)) < 0.01 THEN 1 ELSE 0 END AS weak FROM ud" for c in FEATURES)))
def x6(spark, sf):
    out = selection.target_correlations(bindings.user_days(spark, sf), "outcome", FEATURES)
    return out.select("feature", r("corr", 6).alias("corr"), "n", (F.abs("corr") < 0.01).cast("int").alias("weak"))


@query("x7_correlation_pairs", with_ctes(USER_DAYS, " UNION ALL ".join(
    f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(corr({a}, {b}), 6) AS corr FROM ud" for a, b in PAIRS)))
def x7(spark, sf):
    return selection.correlation_pairs(bindings.user_days(spark, sf), ALL).select("left", "right", r("corr", 6).alias("corr"))


@query("x7_redundant_dropped", with_ctes(USER_DAYS, "SELECT user_pseudo_id, day, views, carts, signups, errors, hours, other_value FROM ud"))
def x7b(spark, sf):
    ud = bindings.user_days(spark, sf).select("user_pseudo_id", "day", *FEATURES, (F.col("views") * 2 + 1).alias("views_again"))
    return ud.drop(*selection.redundant_features(ud, [*FEATURES, "views_again"]))


@query("x8_target_proxies", with_ctes(USER_DAYS, "SELECT user_pseudo_id, day, outcome, views, carts FROM ud"))
def x8(spark, sf):
    ud = bindings.user_days(spark, sf).select("user_pseudo_id", "day", "outcome", "views", "carts", (F.col("outcome") * 3.0).alias("leak"))
    return ud.drop(*selection.target_proxies(ud, "outcome", ["views", "carts", "leak"]))


@query("m9_leaking_columns", with_ctes(USER_DAYS, "SELECT 'leak' AS feature, CAST(1 AS DOUBLE) AS corr"))
def m9(spark, sf):
    ud = bindings.user_days(spark, sf).withColumn("leak", F.col("outcome") * 3.0 + 1)
    return selection.leaking_correlations(ud, "outcome", [*FEATURES, "leak"]).withColumn("corr", r("corr", 6))


@query("x9_min_max", with_ctes(USER_DAYS, "e AS (SELECT min(views) AS v0, max(views) AS v1, min(other_value) AS o0, max(other_value) AS o1 FROM ud)", """
SELECT user_pseudo_id, day, round((views - v0) / (v1 - v0), 6) AS views, round((other_value - o0) / (o1 - o0), 6) AS other_value, CAST(outcome AS DOUBLE) AS outcome FROM ud, e"""))
def x9(spark, sf):
    out = cleaning.min_max_scaled(bindings.user_days(spark, sf).select("user_pseudo_id", "day", "views", "other_value", "outcome"), ["views", "other_value", "outcome"])
    return out.withColumns({"views": r("views", 6), "other_value": r("other_value", 6)})


@query("x10_z_scores", with_ctes(USER_DAYS, "e AS (SELECT avg(views) AS vm, stddev_pop(views) AS vs FROM ud)", """
SELECT user_pseudo_id, day, round((views - vm) / vs, 6) AS views, CAST(0 AS DOUBLE) AS constant FROM ud, e"""))
def x10(spark, sf):
    out = cleaning.z_scored(bindings.user_days(spark, sf).select("user_pseudo_id", "day", "views", F.lit(5.0).alias("constant")), ["views", "constant"])
    return out.withColumn("views", r("views", 6))


@query("x11_undersample")
def x11(spark, sf):
    ud = bindings.user_days(spark, sf).withColumn("rare", (F.col("signups") >= 2).cast("int"))
    return sampling.undersampled(ud, "rare", ["user_pseudo_id", "day"], ratio=4)


@query("x11_undersample_sizes", with_ctes(USER_DAYS, """
c AS (SELECT CASE WHEN signups >= 2 THEN 1 ELSE 0 END AS rare, count(*) AS n FROM ud GROUP BY 1), t AS (SELECT sum(n) AS a, max(n) AS b FROM c)""", """
SELECT rare, CAST(CASE WHEN n = b THEN least(n, 4 * (a - b)) ELSE n END AS BIGINT) AS n FROM c, t WHERE CASE WHEN n = b THEN least(n, 4 * (a - b)) ELSE n END > 0"""))
def x11_sizes(spark, sf):
    return x11(spark, sf).groupBy("rare").agg(F.count("*").alias("n"))


@query("x12_minority_synthesis")
def x12(spark, sf):
    ud = bindings.user_days(spark, sf).withColumn("rare", ((F.col("views") >= 3) & (F.col("carts") >= 1)).cast("int"))
    return sampling.smote(ud.select("user_pseudo_id", "day", *FEATURES, "rare"), "rare", FEATURES, ["user_pseudo_id", "day"], 1, target_share=0.1)


def _split_sql(*edges):
    place = " ".join(f"WHEN (i - 0.5::DOUBLE) / n < {edge!r}::DOUBLE THEN {part}" for part, edge in enumerate(edges))
    return with_ctes(USER_DAYS, "ix AS (SELECT outcome, row_number() OVER (PARTITION BY outcome ORDER BY user_pseudo_id, day) AS i, count(*) OVER (PARTITION BY outcome) AS n FROM ud)",
                     f"SELECT outcome, CAST(CASE {place} ELSE {len(edges)} END AS INTEGER) AS part, count(*) AS n FROM ix GROUP BY 1, 2")


@query("x13_stratified_split", _split_sql(0.7, 0.7 + 0.1))
def x13(spark, sf):
    split = sampling.stratified_split(bindings.user_days(spark, sf), "outcome", ["user_pseudo_id", "day"])
    return split.groupBy("outcome", "part").agg(F.count("*").alias("n"))


@query("x14_stratified_holdout", _split_sql(0.8))
def x14(spark, sf):
    split = sampling.stratified_split(bindings.user_days(spark, sf), "outcome", ["user_pseudo_id", "day"], (0.8, 0.2))
    return split.groupBy("outcome", "part").agg(F.count("*").alias("n"))


@query("w15_chronological_split", """
WITH i AS (SELECT CAST(o_orderdate AS DATE) AS d, row_number() OVER (ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS i, count(*) OVER () AS n FROM orders)
SELECT CASE WHEN i > least(greatest(1, CAST(floor(n * 0.8::DOUBLE) AS BIGINT)), n - 1) THEN 1 ELSE 0 END AS is_test, count(*) AS n_rows, min(d) AS first_day, max(d) AS last_day FROM i GROUP BY 1""")
def w15(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return sampling.split_bounds(sampling.chronological_split(o, "d", ["o_orderkey"]), "d")


def _mi_sql():
    parts = [f"""SELECT '{c}' AS feature, outcome AS y, least(CAST(floor(({c} - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END * 10) AS INTEGER), 9) AS bin
      FROM ud, (SELECT min({c}) AS lo, max({c}) AS hi FROM ud)""" for c in FEATURES]
    return f"""lg AS ({' UNION ALL '.join(parts)}), n AS (SELECT feature, bin, y, CAST(count(*) AS DOUBLE) AS n FROM lg GROUP BY 1, 2, 3),
t AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature) AS a, sum(n) OVER (PARTITION BY feature, bin) AS b, sum(n) OVER (PARTITION BY feature, y) AS c FROM n)"""


@query("x17_mutual_information", with_ctes(USER_DAYS, _mi_sql(), "SELECT feature, round(sum(n / a * ln(n * a / (b * c))), 6) AS mutual_information FROM t GROUP BY 1"))
def x17(spark, sf):
    return selection.mutual_information(bindings.user_days(spark, sf), "outcome", FEATURES).withColumn("mutual_information", r("mutual_information", 6))


def _near_sql():
    """Radius to the third nearest row of the class, rows of all classes within it, and psi from harmonic numbers."""
    long = " UNION ALL ".join(f"SELECT '{c}' AS feature, outcome AS c, CAST({c} AS DOUBLE) AS x, row_number() OVER () AS id FROM ud WHERE {c} IS NOT NULL" for c in FEATURES)
    sides = ", ".join(f"abs(x - {way}(x, {i}) OVER w)" for way in ("lag", "lead") for i in (1, 2, 3))
    return [f"lg AS ({long})", "cl AS (SELECT feature, c, count(*) AS nc FROM lg GROUP BY 1, 2 HAVING count(*) > 1)", "rw AS (SELECT lg.*, nc, least(3, nc - 1) AS k FROM lg JOIN cl USING (feature, c))",
            f"nb AS (SELECT feature, c, x, nc, k, list_sort([d FOR d IN [{sides}] IF d IS NOT NULL])[k] AS r FROM rw WINDOW w AS (PARTITION BY feature, c ORDER BY x, id))",
            "pt AS (SELECT feature, x, count(*) AS n FROM rw GROUP BY 1, 2)", "qs AS (SELECT feature, x, nc, k, r, count(*) AS n FROM nb GROUP BY 1, 2, 3, 4, 5)",
            """ct AS (SELECT q.feature, q.x, q.nc, q.k, q.r, q.n, sum(p.n) AS m FROM qs q JOIN pt p ON p.feature = q.feature AND q.r > 0 AND p.x > q.x - q.r AND p.x < q.x + q.r GROUP BY ALL
       UNION ALL SELECT q.feature, q.x, q.nc, q.k, q.r, q.n, p.n FROM qs q JOIN pt p ON p.feature = q.feature AND p.x = q.x WHERE q.r = 0)""",
            "hn AS (SELECT i, coalesce(sum(1.0::DOUBLE / i) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS psi FROM (SELECT unnest(generate_series(1, (SELECT count(*) FROM ud))) AS i))",
            "sm AS (SELECT feature, sum(n) AS nn, sum(n * a.psi) / sum(n) AS pk, sum(n * b.psi) / sum(n) AS pc, sum(n * d.psi) / sum(n) AS pm "
            "FROM ct JOIN hn a ON a.i = k JOIN hn b ON b.i = nc JOIN hn d ON d.i = m GROUP BY 1)"]


@query("x17_neighbour_information", with_ctes(USER_DAYS, *_near_sql(), "SELECT feature, round(greatest(psi + pk - pc - pm, 0), 6) AS mutual_information FROM sm JOIN hn ON i = nn"))
def x17b(spark, sf):
    from ..operators.information import neighbour_information

    return neighbour_information(bindings.user_days(spark, sf), "outcome", FEATURES).withColumn("mutual_information", r("mutual_information", 6))


@query("x16_correlated_regressors", with_ctes(SALES, """
d AS (SELECT brand AS sku_id, date AS ds, CAST(sum(units_sold) AS DOUBLE) AS y, max(promo_flag) AS promo_flag, avg(discount_pct) AS discount_pct, max(stock_out_flag) AS stock_out_flag FROM sales GROUP BY 1, 2),
c AS (SELECT 'promo_flag' AS feature, corr(promo_flag, y) AS c FROM d UNION ALL SELECT 'discount_pct', corr(discount_pct, y) FROM d UNION ALL SELECT 'stock_out_flag', corr(stock_out_flag, y) FROM d)""",
      "SELECT feature, round(c, 6) AS corr FROM c WHERE abs(c) >= 0.05"))
def x16(spark, sf):
    from ..operators.demand import daily_demand

    daily = daily_demand(bindings.brand_lines(spark, sf))
    out = selection.target_correlations(daily, "y", ["promo_flag", "discount_pct", "stock_out_flag"])
    # A regressor that never varies stays in the table with NaN, as the SQL has it; ``correlated_regressors`` leaves it out.
    out = out.withColumn("corr", F.coalesce("corr", F.when(F.col("n") > 0, F.lit(float("nan")))))
    return out.where(F.abs("corr") >= 0.05).select("feature", r("corr", 6).alias("corr"))


@query("s6_json_rows", "SELECT s_suppkey, '{\"s_suppkey\":' || s_suppkey || ',\"gap\":null}' AS value FROM supplier")
def s6(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.lit(float("nan")).alias("gap"))
    return writers.json_rows(s).withColumn("s_suppkey", F.get_json_object("value", "$.s_suppkey").cast("bigint"))


@query("z3_log_transforms", """
SELECT c_custkey, round(ln(c_acctbal + o + 1), 6) AS shifted, round(exp(ln(c_acctbal + o + 1)) - o - 1, 4) + 0.0 AS restored, round(ln(1 + abs(c_acctbal)), 6) AS log1p_value, round(exp(ln(1 + abs(c_acctbal))) - 1, 4) AS expm1_value
FROM customer, (SELECT CASE WHEN min(c_acctbal) <= 0 THEN abs(min(c_acctbal)) + 1 ELSE 0 END AS o FROM customer)""")
def z3(spark, sf):
    from ..operators.scale import with_scalars

    c = table(spark, sf, "customer")
    rows = with_scalars(c, c.agg(F.min("c_acctbal").alias("lo")))
    log, offset = scalars.shifted_log("c_acctbal", "lo")
    big = F.abs("c_acctbal")
    return rows.select("c_custkey", r(log, 6).alias("shifted"), (r(F.exp(log) - offset - 1.0, 4) + 0.0).alias("restored"),
                       r(F.log1p(big), 6).alias("log1p_value"), r(F.expm1(F.log1p(big)), 4).alias("expm1_value"))


@query("z4_sigmoid", "SELECT c_custkey, round(1 / (1 + exp(-greatest(-12, least(12, c_acctbal / 1000)))), 6) AS p FROM customer")
def z4(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", r(scalars.sigmoid(F.col("c_acctbal") / 1000), 6).alias("p"))


@query("z5_half_even", "SELECT o_orderkey, round_even(o_orderkey / 2.0::DOUBLE, 0) AS v FROM orders")
def z5(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", scalars.half_even(F.col("o_orderkey") / 2.0, 0).alias("v"))


@query("z10_guarded_ratio", with_ctes(WEB, "SELECT user_pseudo_id, day, CASE WHEN itemsViewed = 0 THEN 0 ELSE addToCarts / CAST(itemsViewed AS DOUBLE) END AS rate FROM web"))
def z10(spark, sf):
    return bindings.web_rows(spark, sf).select("user_pseudo_id", "day", scalars.guarded_ratio("addToCarts", "itemsViewed").alias("rate"))


@query("z11_scale_by_max", with_ctes(WEB, "m AS (SELECT max(totalRevenue) AS m FROM web)", "SELECT user_pseudo_id, day, round(CASE WHEN m <= 0 THEN 0 ELSE totalRevenue / m END, 6) AS monetary_score FROM web, m"))
def z11(spark, sf):
    from ..operators.labels import scaled_by_max

    return scaled_by_max(bindings.web_rows(spark, sf), {"monetary_score": F.col("totalRevenue")}).select("user_pseudo_id", "day", r("monetary_score", 6).alias("monetary_score"))


@query("z12_text_tidy", "SELECT p_partkey, lower(trim(p_name)) AS tidy, replace(p_name, ' ', '-') AS dashed, regexp_extract(p_brand, '([0-9]+)', 1) AS number FROM part")
def z12(spark, sf):
    return table(spark, sf, "part").select("p_partkey", scalars.tidy_text("p_name").alias("tidy"), F.regexp_replace("p_name", " ", "-").alias("dashed"),
                                           F.regexp_extract("p_brand", "([0-9]+)", 1).alias("number"))


@query("z13_category_tokens", "SELECT p_partkey, replace(p_brand, '#', '_') || '_' || replace(p_name, ' ', '_') AS token FROM part")
def z13(spark, sf):
    return table(spark, sf, "part").select("p_partkey", scalars.category_token(F.concat("p_brand", F.lit("#"), F.col("p_name"))).alias("token"))


@query("z14_humanised", """
SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Automobile Part' WHEN 'BUILDING' THEN 'Building Part' WHEN 'FURNITURE' THEN 'Furniture Part' WHEN 'HOUSEHOLD' THEN 'Household Part' WHEN 'MACHINERY' THEN 'Machinery Part' ELSE upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' Part' END AS label FROM customer""")
def z14(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", scalars.humanised(F.concat("c_mktsegment", F.lit("_part"))).alias("label"))


@query("z15_same_label", "SELECT l_linenumber, count(*) AS n, count(*) FILTER (l_linenumber = 3) AS threes, CAST(0 AS BIGINT) AS texts FROM lineitem GROUP BY 1")
def z15(spark, sf):
    line = table(spark, sf, "lineitem")
    return line.groupBy("l_linenumber").agg(
        F.count("*").alias("n"), F.count_if(scalars.same_label(F.col("l_linenumber").cast("double"), F.lit(" 3"))).alias("threes"),
        F.count_if(scalars.same_label("l_returnflag", F.lit("3"))).alias("texts"))


@query("z16_display_values")
def z16(spark, sf):
    from ..functions.naming import display_unit

    o = table(spark, sf, "orders")
    return o.groupBy("o_orderstatus").agg(F.concat(F.lit(display_unit("total_price")), F.format_number(F.avg("o_totalprice"), 2)).alias("shown"))


@query("z17_metric_share", "SELECT l_linenumber, round(avg(CASE WHEN l_quantity > 1 THEN l_quantity / 100 ELSE l_quantity END), 6) AS share FROM lineitem GROUP BY 1")
def z17(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_linenumber").agg(r(F.avg(scalars.metric_share("l_quantity")), 6).alias("share"))


@query("z18_finite_values", "SELECT l_linenumber, count(*) FILTER (l_discount <> 0) AS finite, count(*) AS n FROM lineitem GROUP BY 1")
def z18(spark, sf):
    line = table(spark, sf, "lineitem").withColumn("v", F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.col("l_discount")))
    return line.groupBy("l_linenumber").agg(F.count(scalars.finite_or_null("v")).alias("finite"), F.count("*").alias("n"))
