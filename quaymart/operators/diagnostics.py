"""Dataset diagnostics: demand pattern, seasonality, inventory exposure, supplier concentration, profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cents, correlation
from .scale import exact_quantiles, one_row, with_scalars


def cadence(daily: DataFrame, keys: Sequence[str] = ("sku_id",)) -> DataFrame:
    """Daily, weekly or irregular, from active days against calendar days."""
    spans = daily.groupBy(*keys).agg(F.min("ds").alias("first_day"), F.max("ds").alias("last_day"),
                                     F.count_distinct("ds").alias("active_days"))
    calendar = F.datediff("last_day", "first_day") + 1
    active = F.col("active_days")
    # The texts of this rating and the bounds between them.
    label = (F.when((calendar > 1) & (active / calendar > 0.65), "Daily Intervals")
             .when((active > 4) & (active / F.greatest(F.lit(1.0), calendar / 7) > 0.5), "Weekly Cadence")
             .otherwise("Irregular / Batch Cadence"))
    return spans.select("*", calendar.cast("int").alias("calendar_days"), label.alias("cadence"))


def linear_trend(daily: DataFrame, keys: Sequence[str] = ("sku_id",)) -> DataFrame:
    """Slope over the whole series as percent of its mean, R2 and a label; needs four days."""
    place = (F.row_number().over(Window.partitionBy(*keys).orderBy("ds")) - 1).cast("double")
    rows = daily.select(*keys, F.col("y").cast("double").alias("y"), place.alias("_x"))
    fit = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.avg("y").alias("_mean"),
                                  F.regr_slope("y", "_x").alias("_slope"), F.regr_r2("y", "_x").alias("_r2"),
                                  F.var_pop("y").alias("_var")).where("_n >= 4")
    pace = F.when(F.col("_mean") > 0, F.col("_slope") * F.col("_n") / F.col("_mean") * 100).otherwise(F.lit(0.0))
    r2 = F.when(F.col("_var") > 0, F.greatest(F.coalesce(F.col("_r2"), F.lit(0.0)), F.lit(0.0))).otherwise(F.lit(0.0))
    # The texts of this rating and the bounds between them.
    label = (F.when((pace > 15) & (r2 >= 0.2), "Strong Upward Growth").when(pace > 5, "Moderate Upward Pace")
             .when((pace < -15) & (r2 >= 0.2), "Steep Downward Contraction").when(pace < -5, "Moderate Downward Pace")
             .otherwise("Stable / Stationary Demand"))
    return fit.select(*keys, F.round(pace, 1).alias("trend_slope_pct"), F.round(r2, 3).alias("trend_r2"), label.alias("trend_direction"))


def weekday_pattern(sales: DataFrame, keys: Sequence[str] = ("sku_id",), units: str = "units_sold") -> DataFrame:
    """Best and worst weekday by mean units per line and the weekend lift; ties go to the first name."""
    dow = sales.groupBy(*keys, F.date_format("date", "EEEE").alias("dow")).agg(
        F.sum(units).alias("_u"), F.count(units).alias("_n"))
    mean = F.col("_u") / F.col("_n")
    weekend = F.col("dow").isin("Saturday", "Sunday")
    agg = dow.withColumn("_m", mean).groupBy(*keys).agg(
        F.min_by("dow", F.struct(-F.col("_m"), F.col("dow"))).alias("peak_dow"),
        F.min_by("dow", F.struct(F.col("_m"), F.col("dow"))).alias("trough_dow"),
        F.try_divide(F.sum(F.when(weekend, F.col("_u"))), F.sum(F.when(weekend, F.col("_n")))).alias("_we"),
        F.try_divide(F.sum(F.when(~weekend, F.col("_u"))), F.sum(F.when(~weekend, F.col("_n")))).alias("_wd"))
    lift = F.when((F.col("_we") > 0) & (F.col("_wd") > 0), (F.col("_we") - F.col("_wd")) / F.col("_wd") * 100).otherwise(F.lit(0.0))
    return agg.select(*keys, "peak_dow", "trough_dow", F.round(lift, 1).alias("weekend_lift_pct"))


def month_pattern(sales: DataFrame, keys: Sequence[str] = ("sku_id",), units: str = "units_sold") -> DataFrame:
    """Best and worst calendar month by mean units per line and their ratio; needs two months."""
    months = sales.groupBy(*keys, F.date_format("date", "MMMM").alias("month")).agg(F.avg(units).alias("_m"))
    agg = months.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.max("_m").alias("_hi"), F.min("_m").alias("_lo"),
        F.min_by("month", F.struct(-F.col("_m"), F.col("month"))).alias("peak_month"),
        F.min_by("month", F.struct(F.col("_m"), F.col("month"))).alias("trough_month"))
    ratio = F.col("_hi") / F.greatest(F.lit(1e-4), F.col("_lo"))
    return agg.where("_n >= 2").select(*keys, "peak_month", "trough_month", ratio.alias("monthly_amplitude_ratio"))


def lag_correlation(daily: DataFrame, lags: Sequence[int] = (1, 7), keys: Sequence[str] = ("sku_id",)) -> DataFrame:
    """Pearson correlation of a daily series with its own past; 0 where undefined, needs 14 days."""
    order = Window.partitionBy(*keys).orderBy("ds")
    y = F.col("y").cast("double")
    rows = daily.select(*keys, y.alias("y"), *[F.lag(y, k).over(order).alias(f"_l{k}") for k in lags])
    corr = lambda k: F.coalesce(correlation(F.col("y"), F.col(f"_l{k}")), F.lit(0.0))
    return rows.groupBy(*keys).agg(F.count("*").alias("_n"), *[corr(k).alias(f"lag_{k}_autocorr") for k in lags]) \
        .where("_n >= 14").drop("_n")


def demand_class(daily: DataFrame, keys: Sequence[str] = ("sku_id",)) -> DataFrame:
    """Smooth, Intermittent, Erratic or Lumpy from demand interval and size variation.

    Rows are the days of the series; a day without demand counts through a zero.
    """
    y = F.col("y").cast("double")
    sold = F.when(y > 0, y)
    agg = daily.groupBy(*keys).agg(F.count("*").alias("_n"), F.count(sold).alias("_k"), F.avg(sold).alias("_m"), F.stddev_pop(sold).alias("_s"))
    adi = F.col("_n") / F.greatest(F.col("_k"), F.lit(1))
    ratio = F.try_divide(F.col("_s"), F.col("_m"))
    cv2 = F.coalesce(ratio * ratio, F.lit(0.0))
    # The texts of this rating and the bounds between them.
    label = (F.when((adi < 1.32) & (cv2 < 0.49), "Smooth").when((adi >= 1.32) & (cv2 < 0.49), "Intermittent")
             .when((adi < 1.32) & (cv2 >= 0.49), "Erratic").otherwise("Lumpy"))
    return agg.select(*keys, F.round(adi, 2).alias("adi"), F.round(cv2, 3).alias("cv2"), label.alias("demand_class"))


def daily_moments(daily: DataFrame, keys: Sequence[str] = ("sku_id",)) -> DataFrame:
    return daily.groupBy(*keys).agg(F.sum("y").cast("double").alias("total_demand"), F.round(F.avg("y"), 1).alias("daily_mean_demand"),
                                    F.round(F.stddev_pop(F.col("y").cast("double")), 1).alias("daily_std_demand"))


def inventory_exposure(sales: DataFrame, daily: DataFrame, keys: Sequence[str] = ("sku_id",)) -> DataFrame:
    """Stock-outs, lost units and days of supply. The current stock is that of the latest day (the
    largest of that day where several are given)."""
    rows = sales.groupBy(*keys).agg(
        F.count("*").alias("_rows"), F.sum("stock_out_flag").cast("bigint").alias("stockout_rows"),
        F.max(F.struct("date", "stock_on_hand"))["stock_on_hand"].cast("double").alias("current_stock"),
        F.avg("stock_on_hand").alias("mean_stock"), F.avg("units_sold").alias("_unit_mean"))
    both = rows.join(daily_moments(daily, keys).select(*keys, "daily_mean_demand"), list(keys), "left")
    mean = F.col("daily_mean_demand")
    rate = F.when(mean > 0, mean).when(F.col("mean_stock") > 0, F.col("mean_stock") / 30.0).otherwise(F.lit(1.0))
    supply = F.col("current_stock") / F.greatest(F.lit(1.0), rate)
    share = F.col("stockout_rows") / F.col("_rows") * 100
    # The texts of this rating and the bounds between them.
    rating = (F.when((supply < 7) | (share > 8), "Critical Stockout Exposure (Underbuffered)")
              .when(supply > 60, "Excess Working Capital Locked (Overbuffered)").otherwise("Balanced S&OP Inventory Health"))
    return both.select(
        *keys, "current_stock", F.round("mean_stock", 4).alias("mean_stock"), F.round(supply, 1).alias("days_of_supply"), "stockout_rows",
        F.round(share, 2).alias("stockout_rate_pct"), F.round(F.col("stockout_rows") * F.col("_unit_mean")).cast("bigint").alias("estimated_lost_units"),
        rating.alias("buffer_health_rating"))


def diagnostic_reorder(daily: DataFrame, lead: DataFrame, keys: Sequence[str] = ("sku_id",), z: float = 1.65) -> DataFrame:
    """Safety stock and reorder point of the diagnostic, from daily mean, spread and mean lead time.

    ``lead`` has ``mean_lead_time`` per item.
    """
    both = daily_moments(daily, keys).join(lead.select(*keys, F.round("mean_lead_time", 1).alias("mean_lead_time")), list(keys), "left")
    mean, std, days = F.col("daily_mean_demand"), F.col("daily_std_demand"), F.coalesce(F.col("mean_lead_time"), F.lit(7.0))
    safety = F.lit(z) * F.when(std > 0, std).otherwise(mean * 0.25) * F.sqrt(F.greatest(F.lit(1.0), days))
    return both.select(*keys, "daily_mean_demand", "daily_std_demand", days.alias("mean_lead_time"),
                       F.round(safety).cast("bigint").alias("recommended_safety_stock"),
                       F.round(mean * days + safety).cast("bigint").alias("recommended_reorder_point"))


def supplier_concentration(sales: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Number of suppliers, share of the largest, Herfindahl index and its reading."""
    counts = sales.where("supplier_id IS NOT NULL").groupBy(*keys, "supplier_id").agg(F.count("*").alias("_n"))
    agg = counts.groupBy(*keys).agg(F.count("*").alias("active_suppliers"), F.max("_n").alias("_top"), F.sum("_n").alias("_all"),
                                    F.sum(F.col("_n").cast("double") * F.col("_n")).alias("_sq"))
    top = F.col("_top") / F.col("_all") * 100
    hhi = F.round(F.col("_sq") / (F.col("_all").cast("double") * F.col("_all")) * 10000).cast("bigint")
    n = F.col("active_suppliers")
    # The texts of this rating and the bounds between them.
    rating = (F.when((n >= 3) & (top <= 50), "Resilient Multi-Vendor Ecosystem")
              .when((n >= 2) & (top <= 80), "Moderate Vendor Concentration").otherwise("High Single-Source Vulnerability"))
    return agg.select(*keys, "active_suppliers", F.round(top, 1).alias("top_supplier_share_pct"), hhi.alias("hhi_index"),
                      rating.alias("vendor_resilience_rating"))


def cost_and_margin(sales: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Cost range and spread, gross margin with its reading, and revenue."""
    agg = sales.groupBy(*keys).agg(
        F.min("purchase_cost").cast("double").alias("min_cost"), F.max("purchase_cost").cast("double").alias("max_cost"),
        (F.sum(cents("purchase_cost")) / F.count("*") / 100).alias("mean_cost"),
        (F.sum(cents("list_price")) / F.count("*") / 100).alias("_price"),
        (F.sum((cents("list_price") * F.col("units_sold")).cast("decimal(18,0)")).cast("double") / 100).alias("_revenue"))
    margin = F.when(F.col("_price") > 0, (F.col("_price") - F.col("mean_cost")) / F.col("_price") * 100)
    # The texts of this rating and the bounds between them.
    rating = (F.when(margin > 40, "Robust Enterprise Margin Cushion").when(margin > 20, "Healthy Operational Margin")
              .otherwise("Compressed Margin"))
    return agg.select(*keys, "min_cost", "mean_cost", "max_cost",
                      F.round(F.col("max_cost") / F.greatest(F.lit(1e-4), F.col("min_cost")), 1).alias("cost_spread_ratio"),
                      F.round(margin, 2).alias("avg_gross_margin_pct"), rating.alias("margin_health_rating"),
                      F.round("_revenue", 0).alias("total_revenue"))


def table_profile(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells and rows that repeat an earlier one.

    Equal rows are counted under a shuffle by all columns with map-side folding, so any number of
    copies of one row costs one row per task.
    """
    missing = [F.count_if(F.col(c).isNull()) for c in df.columns]
    basic = df.agg(F.count("*").alias("n_rows"), sum(missing[1:], missing[0]).alias("missing_cells"))
    kinds = df.groupBy(*df.columns).agg(F.lit(1).alias("_one")).agg(F.count("*").alias("_distinct"))
    return with_scalars(basic, kinds).select("n_rows", F.lit(len(df.columns)).alias("n_columns"), "missing_cells",
                                             (F.col("n_rows") - F.col("_distinct")).alias("duplicate_rows"))


def top_categories(df: DataFrame, column: str, limit: int, keys: Sequence[str] = ()) -> DataFrame:
    """Most frequent values; ties by name. Counts are folded before ranking."""
    counts = df.groupBy(*keys, F.col(column).alias("category")).agg(F.count("*").alias("n"))
    if not keys:
        return counts.orderBy(F.desc("n"), F.asc("category")).limit(limit)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), F.asc("category")))
    return counts.withColumn("_r", rank).where(F.col("_r") <= limit).drop("_r")


def histogram(df: DataFrame, column: str, class_column: str, bins: int = 50) -> DataFrame:
    """Equal-width counts per class between the smallest and the largest value; the last bin is closed."""
    value = F.col(column).cast("double")
    ends = one_row(df, F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    flat = F.abs(F.col("_hi") - F.col("_lo")) < 1e-9
    ends = ends.select(F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
                       F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"))
    rows = with_scalars(df.select(class_column, value.alias("_v")).where("_v IS NOT NULL"), ends)
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    return rows.groupBy(F.col(class_column), place.alias("bin")).agg(F.count("*").alias("n"), F.min(F.col("_lo") + place * width).alias("bin_start"))


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Share of the smallest class, ratio of largest to smallest, and whether that is imbalanced."""
    counts = df.where(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("_c")).agg(F.count("*").alias("_n"))
    agg = counts.agg(
        F.min_by("_c", F.struct(-F.col("_n"), F.col("_c"))).alias("majority_class"), F.max("_n").alias("majority_count"),
        F.max_by("_c", F.struct(-F.col("_n"), F.col("_c"))).alias("minority_class"), F.min("_n").alias("minority_count"), F.sum("_n").alias("_all"))
    all_rows = df.agg(F.count("*").alias("_rows"))
    share = F.col("minority_count") / F.col("_rows") * 100
    return with_scalars(agg, all_rows).select(
        "majority_class", "majority_count", "minority_class", "minority_count",
        F.round(share, 2).alias("minority_pct"), F.round(F.col("majority_count") / F.col("minority_count"), 2).alias("imbalance_ratio"),
        (share < 10).cast("int").alias("is_imbalanced"))


def numeric_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Minimum, maximum, mean and sample deviation per column, one row each, from one pass."""
    aggs = [F.struct(F.lit(c).alias("column"), F.min(F.col(c).cast("double")).alias("min_value"), F.max(F.col(c).cast("double")).alias("max_value"),
                     F.avg(F.col(c).cast("double")).alias("mean_value"), F.stddev_samp(F.col(c).cast("double")).alias("std_value"))
            for c in columns]
    return df.agg(F.array(*aggs).alias("_a")).select(F.inline("_a"))


def outcome_rate(df: DataFrame, target: str, selected=None) -> DataFrame:
    """Percent of rows with the selected class, or the mean of a continuous outcome."""
    from ..functions.scalars import same_label

    if selected is None:
        return df.agg(F.avg(F.col(target).cast("double")).alias("current_outcome"))
    return df.agg((F.avg(same_label(target, F.lit(selected)).cast("double")) * 100).alias("current_outcome"))


def quantile_bucket_means(df: DataFrame, score: str, outcome: str, percents: Sequence[int] = (20, 40, 60, 80, 90)) -> DataFrame:
    """Mean outcome in left-closed score buckets cut at percentiles (and at 0 below them)."""
    names = [f"p{p}" for p in percents]
    cuts = exact_quantiles(df, score, {n: p / 100 for n, p in zip(names, percents)})
    edges = F.array(*names)
    edges = F.when(F.col(names[0]) > 0, F.concat(F.array(F.lit(0.0)), edges)).otherwise(edges)
    rows = with_scalars(df.select(F.col(score).cast("double").alias("_s"), F.col(outcome).cast("double").alias("_y")),
                        cuts.select(edges.alias("_e")))
    inside = (F.col("_s") >= F.element_at("_e", 1)) & (F.col("_s") < F.element_at("_e", -1))
    place = F.size(F.filter("_e", lambda e: e <= F.col("_s")))
    return rows.where(inside).groupBy(place.alias("bucket"), F.element_at("_e", place + 1).alias("upper_edge")).agg(
        F.count("*").alias("n"), F.avg("_y").alias("mean_outcome"))


def corr_columns(pairs: Sequence[tuple[str, str]]) -> list[Column]:
    return [correlation(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}~{b}") for a, b in pairs]
