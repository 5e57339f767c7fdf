"""Learned lead time and unit cost. One model is fitted over all items, with the item's own history
as features, instead of one model per item."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared, written
from . import forest
from .scale import attach_group_stats

ROWS_AT_ONCE = 500_000   # training rows of a task
SPARK_ROWS = 5_000_000   # most lines for Spark's forest, which keeps each with a count for every tree
HISTORY_COLUMNS = ("pair_mean", "supplier_mean", "item_mean")


def _histories(sales: DataFrame, column: str) -> DataFrame:
    """One row per pair with the sum and count of the known values of ``column``, and beside them those of its supplier and of its item.

    The lines are read once; suppliers and items are summed from the pairs. Pairs with a missing key are there, too, for the history of
    the key they have. A missing key has no history of its own.
    """
    known = F.col(column).cast("double")
    pairs = shared(sales.groupBy("sku_id", "supplier_id").agg(
        F.sum(known).alias("_s_pair_mean"), F.count(known).alias("_n_pair_mean"), F.count("*").alias("_rows"),
        F.sum(F.col("units_sold").cast("double")).alias("_units"), F.count("units_sold").alias("_sized")))
    out = pairs
    for name, key in (("supplier_mean", "supplier_id"), ("item_mean", "sku_id")):
        wider = pairs.groupBy(key).agg(F.sum("_s_pair_mean").alias(f"_s_{name}"), F.sum("_n_pair_mean").alias(f"_n_{name}"), F.count("*").alias("_pairs"),
                                       F.try_divide(F.sum("_units"), F.sum("_sized").cast("double")).alias(f"_u_{name}"))
        # Pairs of suppliers with many items, and of items with many suppliers, are spread over tasks.
        out = attach_group_stats(out, wider, [key], "_pairs")
    whole = F.col("sku_id").isNotNull() & F.col("supplier_id").isNotNull()
    return out.select("sku_id", "supplier_id", *[F.when(whole, F.col(f"_{x}_pair_mean")).alias(f"_{x}_pair_mean") for x in "sn"],
                      *[f"_{x}_{name}" for name in HISTORY_COLUMNS[1:] for x in "sn"], "_rows", F.col("_u_item_mean").alias("_usual"))


def _with_means(frame: DataFrame, overall: float, own: Column | None = None) -> DataFrame:
    """Mean of the label per pair, supplier and item from the histories beside each row, without the row's own label where ``own`` gives it.

    A history without other labels falls back to the wider one: pair to supplier, supplier and
    item to the mean of all.
    """
    mine, one = (F.coalesce(own, F.lit(0.0)), own.isNotNull().cast("int")) if own is not None else (F.lit(0.0), F.lit(0))
    out = frame.withColumns({name: F.try_divide(F.col(f"_s_{name}") - mine, (F.col(f"_n_{name}") - one).cast("double")) for name in HISTORY_COLUMNS})
    wide = F.lit(float(overall))
    return out.withColumn("supplier_mean", F.coalesce("supplier_mean", wide)).withColumn("item_mean", F.coalesce("item_mean", wide)) \
        .withColumn("pair_mean", F.coalesce("pair_mean", "supplier_mean")).withColumn("pair_orders", F.coalesce("_n_pair_mean", F.lit(0)))


def _filled(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Numbers without gaps: a missing one becomes 0 and says so in a column of its own."""
    for c in columns:
        frame = frame.withColumn(f"no_{c}", F.col(c).isNull().cast("double")).withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    return frame


def _calendar(frame: DataFrame) -> DataFrame:
    return frame.withColumn("month", F.month("date")).withColumn("weekday", F.weekday("date"))


def _predictions(sales: DataFrame, label: str, features: list[str], fixed: dict[str, float], trees: int, name: str, kept: bool) -> DataFrame:
    """One forest over all items and suppliers; one prediction per pair, for an order of the item's usual size.

    The supplier enters by the mean label of its other rows, the same way at any number of
    suppliers. Rows without a label are not learned from; no row is left out of the predictions.
    Unless the sales are ``kept`` as a table already, the needed columns are written once.
    """
    value = F.col(label).cast("double")
    sales = sales.select("sku_id", "supplier_id", "date", *features, label)
    if not kept:
        sales = written(sales)
    histories = shared(_histories(sales, label))
    pairs = histories.where(F.col("sku_id").isNotNull() & F.col("supplier_id").isNotNull())
    size = sales.agg(F.avg(value).alias("m"), F.count(value).alias("n")).first()
    overall = size["m"]
    if overall is None:
        return pairs.select("sku_id", "supplier_id", F.lit(None).cast("double").alias(name))
    inputs = [*features, "month", "weekday"]
    columns = [*inputs, *[f"no_{c}" for c in inputs], *HISTORY_COLUMNS, "pair_orders"]
    # A missing key finds its pair, too: the key is one struct. Lines of very frequent pairs are spread over tasks.
    pair = F.struct("sku_id", "supplier_id")
    rows = attach_group_stats(sales.where(value.isNotNull()).withColumn("_pair", pair),
                              histories.withColumn("_pair", pair).drop("sku_id", "supplier_id", "_usual"), ["_pair"], "_rows")
    train = _filled(_with_means(_calendar(rows).withColumn("_label", value), overall, F.col("_label")), inputs)
    ask = pairs.withColumnRenamed("_usual", "units_sold").withColumns({c: F.lit(v) for c, v in fixed.items()})
    ask = _filled(_with_means(ask, overall), inputs)
    if size["n"] > SPARK_ROWS:
        model = forest.fit(train.select("_label", *columns), "_label", columns, trees, overall)
        return model.transform(ask.select("sku_id", "supplier_id", *columns), columns, "_p").select("sku_id", "supplier_id", F.round("_p", 2).alias(name))
    # Even parts, whatever the sizes of the pairs: the forest deals rows to tasks as they come and keeps them with a count for every tree.
    parts = max(2 * sales.sparkSession.sparkContext.defaultParallelism, -(-size["n"] // ROWS_AT_ONCE))
    train = train.select("_label", *columns).repartition(parts)
    model = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="_features"),
                             RandomForestRegressor(labelCol="_label", featuresCol="_features", predictionCol="_p", numTrees=trees, maxDepth=6, seed=42)]).fit(train)
    return model.transform(ask).select("sku_id", "supplier_id", F.round("_p", 2).alias(name))


def lead_time_predictions(sales: DataFrame, month: int = 7, weekday: int = 0, trees: int = 60, kept: bool = False) -> DataFrame:
    """Expected lead time per item and supplier for a non-promoted order of the item's usual size."""
    return _predictions(sales, "lead_time_days", ["promo_flag", "discount_pct", "units_sold"],
                        {"promo_flag": 0, "discount_pct": 0.0, "month": month, "weekday": weekday}, trees, "predicted_lead_time", kept)


def unit_cost_predictions(sales: DataFrame, month: int = 9, weekday: int = 5, trees: int = 50, kept: bool = False) -> DataFrame:
    """Expected unit cost per item and supplier for an order of the item's usual size."""
    return _predictions(sales, "purchase_cost", ["units_sold"], {"month": month, "weekday": weekday}, trees, "predicted_price", kept)
