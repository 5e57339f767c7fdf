"""Role bindings: the star-schema tables seen as the inputs the operators expect.

The bindings are stand-ins that give each operator an input of the right shape; they carry no
business meaning. Joins are added only for the columns that are asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import table

def sales(spark: SparkSession, folder: str, *, orders: bool = False, parts: bool = False,
          stores: bool = False) -> DataFrame:
    """Sales lines. ``orders`` adds channel and lead time, ``parts`` brand and stock, ``stores`` the store."""
    line = table(spark, folder, "lineitem")
    # Half-up rounding in whole cents: (2a + b) div 2b.
    price = F.expr("(2 * cast(round(l_extendedprice * 100) AS bigint) + units_sold) div (2 * units_sold)")
    cost = F.expr("(2 * _price * (90 - cast(round(l_tax * 100) AS bigint)) + 100) div 200")
    out = (line
           .withColumn("date", F.to_date("l_shipdate"))
           .withColumn("units_sold", F.col("l_quantity").cast("bigint"))
           .withColumn("_price", price)
           .withColumn("_cost", cost)
           .withColumn("list_price", F.col("_price") / 100)
           .withColumn("purchase_cost", F.col("_cost") / 100)
           .withColumn("margin_pct", (F.col("_price") - F.col("_cost")) / F.col("_price"))
           .withColumn("promo_flag", (F.col("l_discount") >= 0.05).cast("int"))
           .withColumn("stock_out_flag", (F.col("l_returnflag") == "R").cast("int"))
           .withColumnsRenamed({"l_partkey": "sku_id", "l_suppkey": "supplier_id", "l_discount": "discount_pct"}))
    columns = ["date", "sku_id", "supplier_id", "units_sold", "list_price", "purchase_cost", "margin_pct",
               "discount_pct", "promo_flag", "stock_out_flag", "l_orderkey", "l_linenumber"]
    if orders:
        order = table(spark, folder, "orders").select(
            F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("channel"),
            F.to_date("o_orderdate").alias("order_date"), F.col("o_custkey").alias("customer_id"))
        out = out.join(order, "l_orderkey").withColumn(
            "lead_time_days", (F.lit(1) + F.pmod(F.datediff("date", "order_date"), F.lit(14))).cast("int"))
        columns += ["channel", "lead_time_days", "order_date", "customer_id"]
    if parts:
        part = table(spark, folder, "part").select(
            F.col("p_partkey").alias("sku_id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"),
            (F.col("p_size") * 10).alias("stock_on_hand"))
        out = out.join(part, "sku_id")
        columns += ["brand", "category", "stock_on_hand"]
    if stores:
        store = table(spark, folder, "supplier").select(
            F.col("s_suppkey").alias("supplier_id"), F.col("s_nationkey").alias("store_id"))
        out = out.join(store, "supplier_id")
        columns += ["store_id"]
    return out.select(*columns)


def brand_sales(spark: SparkSession, folder: str) -> DataFrame:
    """Sales lines with the brand as the planned item, which gives every vendor enough orders."""
    return sales(spark, folder, orders=True, parts=True).drop("sku_id").withColumnRenamed("brand", "sku_id")


def brand_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The same lines without the order columns: what demand needs takes no join with the orders."""
    return sales(spark, folder, parts=True).drop("sku_id").withColumnRenamed("brand", "sku_id")


def brand_inventory(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    return part.groupBy(F.col("p_brand").alias("sku_id")).agg(
        F.floor(F.avg(F.col("p_size") * 10)).cast("bigint").alias("stock_on_hand"))


def item_inventory(spark: SparkSession, folder: str, brand: str | None = None) -> DataFrame:
    """Stock position per event item, of all brands or of one: parts folded onto the item codes of the events."""
    part = table(spark, folder, "part").withColumn("item_id", F.pmod("p_partkey", F.lit(100)).cast("string"))
    if brand is not None:
        part = part.where(F.col("p_brand") == brand)
    return part.groupBy("item_id").agg(
        F.sum(F.col("p_size") * 10).cast("bigint").alias("stock_units"),
        F.round(F.avg("p_retailprice"), 4).alias("unit_cost"),
        F.max("p_size").cast("int").alias("lead_time_days"))


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Event rows with day, item code and value in cents."""
    raw = table(spark, folder, "events")
    return raw.select(
        "event_id", F.col("user_id").cast("string").alias("user_pseudo_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.to_date("ts").alias("day"), "event_type",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"))


def item_events(spark: SparkSession, folder: str) -> DataFrame:
    """Event rows in the shape of an item export: views, carts, purchases and revenue per row."""
    e = events(spark, folder)
    flag = lambda kind: (F.col("event_type") == kind).cast("bigint")
    return e.select(
        F.col("k").cast("string").alias("item_id"), "day", "user_pseudo_id", "event_id",
        F.concat(F.lit("cat_"), F.pmod("k", F.lit(8))).alias("item_category"),
        flag("view").alias("views"), flag("click").alias("carts"), flag("purchase").alias("purchases"),
        F.when(F.col("event_type") == "purchase", F.col("cents")).otherwise(0).cast("bigint").alias("revenue_cents"))


def web_rows(spark: SparkSession, folder: str) -> DataFrame:
    """One row per user and day in the shape of a web-analytics export."""
    e = events(spark, folder)
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    buys = F.col("event_type") == "purchase"
    day = e.groupBy("user_pseudo_id", "day").agg(
        F.count("*").alias("eventCount"), n("view").alias("itemsViewed"), n("click").alias("addToCarts"),
        n("signup").alias("checkouts"), n("purchase").alias("purchases"), n("error").alias("_errors"),
        F.count_distinct(F.hour("ts")).alias("sessions"),
        F.sum(F.when(buys, F.col("cents")).otherwise(0)).alias("_rev"),
        F.sum(F.when(buys, 0).otherwise(F.col("cents"))).alias("_eng"),
        F.min("k").alias("_lo"), F.max("k").alias("_hi"))
    uid = F.col("user_pseudo_id").cast("bigint")
    return day.select(
        "user_pseudo_id", "day", F.date_format("day", "yyyyMMdd").cast("int").alias("date"),
        "sessions", "eventCount", "itemsViewed", "addToCarts", "checkouts", "purchases",
        (F.col("_rev") / 100).alias("totalRevenue"), (F.col("_eng") / 100).alias("userEngagementDuration"),
        (F.col("_errors") / F.col("eventCount")).alias("bounceRate"),
        ((F.col("itemsViewed") + F.col("addToCarts")) / F.col("eventCount")).alias("engagementRate"),
        F.col("_hi").cast("double").alias("percentScrolled"),
        F.concat(F.lit("cat_"), F.pmod("_lo", F.lit(8))).alias("itemCategory"),
        F.concat(F.lit("type_"), F.pmod("_hi", F.lit(12))).alias("itemCategory2"),
        F.element_at(F.array(*map(F.lit, ["desktop", "mobile", "tablet"])), F.pmod(uid, F.lit(3)).cast("int") + 1).alias("deviceCategory"),
        F.element_at(F.array(*map(F.lit, ["Summer Sale", "Newsletter", "(not set)"])), F.pmod("_lo", F.lit(3)) + 1).alias("sessionCampaign"),
        F.when(F.pmod("_hi", F.lit(5)) == 0, F.concat(F.lit("term"), F.col("_hi"))).alias("searchTerm"),
        F.concat(F.lit("channel_"), F.pmod(uid, F.lit(5))).alias("firstUserPrimaryChannelGroup"),
        F.concat(F.lit("age_"), F.pmod(uid, F.lit(6))).alias("age"),
        F.concat(F.lit("gender_"), F.pmod(uid, F.lit(2))).alias("gender"),
        F.concat(F.lit("city_"), F.pmod(uid, F.lit(7))).alias("city"))


INDEX_FEATURES = ["views", "carts", "signups", "errors", "hours", "other_value"]


def user_days(spark: SparkSession, folder: str) -> DataFrame:
    """Features and outcome of the index: behaviour per user and day, and whether it ended in a purchase."""
    w = events(spark, folder)
    n = lambda kind: F.count_if(F.col("event_type") == kind).cast("double")
    return w.groupBy("user_pseudo_id", "day").agg(
        n("view").alias("views"), n("click").alias("carts"), n("signup").alias("signups"), n("error").alias("errors"),
        F.count_distinct(F.hour("ts")).cast("double").alias("hours"),
        (F.sum(F.when(F.col("event_type") == "purchase", 0).otherwise(F.col("cents"))) / 100).alias("other_value"),
        F.max((F.col("event_type") == "purchase").cast("int")).alias("outcome"),
        (F.sum(F.when(F.col("event_type") == "purchase", F.col("cents")).otherwise(0)) / 100).alias("spend"))
