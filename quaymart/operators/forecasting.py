"""Forecasts, calendars and accuracy for all items at once.

The estimators are a seasonal baseline and a least-squares model with regressors. Everything that
grows with the data is an aggregate; Python only solves one small system per item.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scale import bounded_quantiles

Z95 = 1.96


def accuracy(pairs: DataFrame, keys: Sequence[str], actual: str = "y", predicted: str = "yhat") -> DataFrame:
    """MAE, RMSE, MAPE over non-zero actuals, weighted MAPE, bias, R2 and totals per group."""
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    rows = pairs.where(y.isNotNull() & p.isNotNull()).select(*keys, y.alias("_y"), p.alias("_p"))
    y, p = F.col("_y"), F.col("_p")
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("n_days"), F.sum(F.abs(y - p)).alias("_abs"), F.sum((y - p) * (y - p)).alias("_sq"),
        F.avg(F.when(y != 0, F.abs((y - p) / y))).alias("_ape"), F.sum(y).alias("_sy"), F.sum(p).alias("_sp"),
        F.var_pop(y).alias("_var"))
    n, total_var = F.col("n_days"), F.col("_var") * F.col("n_days")
    return sums.select(
        *keys, "n_days", (F.col("_abs") / n).alias("mae"), F.sqrt(F.col("_sq") / n).alias("rmse"),
        (F.coalesce(F.col("_ape"), F.lit(0.0)) * 100).alias("mape_percent"),
        F.when(F.col("_sy") > 0, F.col("_abs") / F.col("_sy") * 100).otherwise(F.lit(0.0)).alias("wmape_percent"),
        ((F.col("_sp") - F.col("_sy")) / n).alias("bias"),
        F.when(total_var > 0, F.lit(1.0) - F.col("_sq") / total_var)
         .when(F.col("_sq") == 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("r2"),
        F.col("_sy").alias("total_actual"), F.col("_sp").alias("total_forecast"))


def compare_models(metrics: DataFrame, keys: Sequence[str], model: str = "model") -> DataFrame:
    """Best model per metric: lowest error, highest R2; ties go to the first name."""
    low = ["mae", "rmse", "mape_percent", "wmape_percent"]
    return metrics.groupBy(*keys).agg(
        *[F.min_by(model, F.struct(F.col(m), F.col(model))).alias(f"best_{m}") for m in low],
        F.min_by(model, F.struct(-F.col("r2"), F.col(model))).alias("best_r2"))


def series_frequency(series: DataFrame, keys: Sequence[str] = ("sku_id",)) -> DataFrame:
    """Frequency of each series from its median gap, and the season length that goes with it."""
    step = F.datediff("ds", F.lag("ds").over(Window.partitionBy(*keys).orderBy("ds")))
    gaps = series.select(*keys, step.alias("gap"))
    median = bounded_quantiles(gaps, "gap", {"median_gap": 0.5}, keys)
    span = series.groupBy(*keys).agg(F.datediff(F.max("ds"), F.min("ds")).alias("span_days"), F.count("*").alias("n_points"))
    both = span.join(median, list(keys), "left")
    gap = F.coalesce(F.col("median_gap"), F.lit(1.0))
    label = F.when(gap <= 1, "D").when(gap <= 8, "W").when(gap <= 32, "M").otherwise("unknown")
    season = F.when(gap <= 1, 7).when(gap <= 8, 52).when(gap <= 32, 12).otherwise(4)
    return both.select(*keys, "n_points", "span_days", gap.alias("median_gap"), label.alias("frequency"),
                       F.when(F.col("n_points") < 2, 7).otherwise(season).cast("int").alias("season_length"))


def adaptive_choices(frequency: DataFrame, keys: Sequence[str] = ("sku_id",)) -> DataFrame:
    """Which seasonal parts a series supports and how long its lookback window is."""
    lookback = F.lit(7)
    for width in (7, 30, 21, 14):
        lookback = F.when(F.col("n_points") - width >= 200, F.lit(width)).otherwise(lookback)
    return frequency.select(
        *keys, "frequency", "span_days", "n_points",
        (F.col("frequency").isin("D", "W") & (F.col("span_days") >= 14)).cast("int").alias("weekly"),
        (F.col("span_days") >= 365).cast("int").alias("yearly"), lookback.cast("int").alias("lookback"))


def future_calendar(series: DataFrame, days: int, keys: Sequence[str] = ("sku_id",)) -> DataFrame:
    """The ``days`` days after each series' last day."""
    ends = series.groupBy(*keys).agg(F.max("ds").alias("_last"))
    step = F.sequence(F.date_add("_last", 1), F.date_add("_last", days))
    return ends.select(*keys, F.explode(step).alias("ds"))


def is_flag_name(name: str) -> bool:
    return any(part in name for part in ("flag", "is_", "promo", "holiday"))


def regressor_baseline(series: DataFrame, regressors: Sequence[str], keys: Sequence[str] = ("sku_id",),
                       last_rows: int = 30) -> DataFrame:
    """Value assumed for an unknown future regressor: 0 for flags, else the mean of the last rows."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ds")))
    recent = series.select(*keys, *regressors, place.alias("_age")).where(F.col("_age") <= last_rows)
    return recent.groupBy(*keys).agg(*[
        (F.lit(0.0) if is_flag_name(r) else F.avg(F.col(r).cast("double"))).alias(f"_base_{r}") for r in regressors])


def future_regressors(calendar: DataFrame, series: DataFrame, regressors: Sequence[str],
                      keys: Sequence[str] = ("sku_id",)) -> DataFrame:
    """Calendar days with known regressor values where there are any, else the baseline."""
    known = series.select(*keys, "ds", *[F.col(r).cast("double").alias(r) for r in regressors])
    base = regressor_baseline(series, regressors, keys)
    joined = calendar.join(known, [*keys, "ds"], "left").join(base, list(keys), "left")
    return joined.select(*calendar.columns, *[F.coalesce(F.col(r), F.col(f"_base_{r}")).alias(r) for r in regressors])


def seasonal_baseline(series: DataFrame, horizon: int | str, keys: Sequence[str] = ("sku_id",)) -> DataFrame:
    """Linear trend times weekday and month indices, with a 95% interval, all clipped at 0.

    Returns fitted history and ``horizon`` future days, or all days up to a date that is given as text: ds, y (NULL in the future), trend, weekly,
    yearly (relative effects), yhat, yhat_lower, yhat_upper. The input has one row per item and
    day, so every window holds at most the days of one item; all of them share one shuffle by item.
    """
    keys = list(keys)
    item = Window.partitionBy(*keys)
    in_time = item.orderBy("ds")
    base = series.select(*keys, "ds", F.col("y").cast("double").alias("y"))
    base = base.withColumn("_gap", F.datediff("ds", F.lag("ds").over(in_time)).cast("double"))
    base = base.withColumns({"_start": F.min("ds").over(item), "_last": F.max("ds").over(item),
                             "_gap": F.coalesce(F.percentile("_gap", 0.5).over(item), F.lit(1.0))})
    base = base.withColumn("_x", F.datediff("ds", "_start").cast("double"))
    base = base.withColumns({"_slope": F.coalesce(F.regr_slope("y", "_x").over(item), F.lit(0.0)),
                             "_icept": F.coalesce(F.regr_intercept("y", "_x").over(item), F.avg("y").over(item))})
    ahead = F.date_add("_last", horizon) if isinstance(horizon, int) else F.greatest(F.lit(horizon).cast("date"), F.col("_last"))
    # The last known day also brings the future days, so history and future stay side by side.
    days = F.when(F.col("ds") == F.col("_last"), F.sequence(F.col("_last"), ahead)).otherwise(F.array("ds"))
    grown = base.withColumn("_day", F.explode(days)).withColumn("y", F.when(F.col("_day") == F.col("ds"), F.col("y")))
    grown = grown.drop("ds", "_x").withColumnRenamed("_day", "ds")
    span = F.datediff("_last", "_start")
    trend = F.col("_icept") + F.col("_slope") * F.datediff("ds", "_start").cast("double")
    grown = grown.withColumns({"trend": trend, "_dow": F.weekday("ds"), "_mon": F.month("ds"),
                               "_wk": (F.col("_gap") <= 8) & (span >= 14), "_yr": span >= 365})
    level = F.greatest(F.col("trend"), F.lit(0.0))

    def index(part, base_level, used):
        group = Window.partitionBy(*keys, part)
        known = F.sum(F.when(F.col("y").isNotNull(), base_level)).over(group)
        ratio = F.coalesce(F.try_divide(F.sum("y").over(group), known), F.lit(1.0))
        return F.when(F.col(used), ratio).otherwise(F.lit(1.0))

    grown = grown.withColumn("_w", index("_dow", level, "_wk"))
    grown = grown.withColumn("_m", index("_mon", level * F.col("_w"), "_yr"))
    grown = grown.withColumn("_f", level * F.col("_w") * F.col("_m"))
    miss = F.col("y") - F.col("_f")
    grown = grown.withColumn("fit_rmse", F.sqrt(F.avg(miss * miss).over(item)))
    band = F.lit(Z95) * F.col("fit_rmse")
    return grown.select(
        *keys, "ds", "y", "trend", (F.col("_w") - 1.0).alias("weekly"), (F.col("_m") - 1.0).alias("yearly"),
        F.col("_f").alias("yhat"), F.greatest(F.col("_f") - band, F.lit(0.0)).alias("yhat_lower"),
        (F.col("_f") + band).alias("yhat_upper"), "fit_rmse")


def _design(frame: DataFrame, regressors: Sequence[str], start: str = "_start") -> tuple[DataFrame, list[str]]:
    """Columns of the regressor model: intercept, trend, three weekly and two yearly waves, regressors."""
    t = F.datediff("ds", start).cast("double")
    cols = {"_one": F.lit(1.0), "_trend": t / 365.25}
    for period, waves in ((7.0, 3), (365.25, 2)):
        for k in range(1, waves + 1):
            angle = F.lit(2 * np.pi * k / period) * F.unix_date("ds").cast("double")
            cols[f"_sin{int(period)}_{k}"] = F.sin(angle)
            cols[f"_cos{int(period)}_{k}"] = F.cos(angle)
    for r in regressors:
        cols[f"_r_{r}"] = F.coalesce(F.col(r).cast("double"), F.lit(0.0))
    return frame.withColumns(cols), list(cols)


def regressor_forecast(series: DataFrame, regressors: Sequence[str], horizon: int, keys: Sequence[str] = ("sku_id",),
                       ridge: float = 1e-3) -> DataFrame:
    """Least squares per item on trend, seasonal waves and regressors.

    The normal equations of every item are plain sums; each item then contributes one row with a
    few hundred numbers, which is all the grouped Python step sees.
    """
    keys = list(keys)
    start = series.groupBy(*keys).agg(F.min("ds").alias("_start"))
    history = series.select(*keys, "ds", F.col("y").cast("double").alias("y"), *regressors).join(start, keys)
    frame, names = _design(history, regressors)
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = frame.groupBy(*keys).agg(
        F.array(*[F.sum(F.col(names[i]) * F.col(names[j])) for i, j in pairs]).alias("xx"),
        F.array(*[F.sum(F.col(n) * F.col("y")) for n in names]).alias("xy"),
        F.sum(F.col("y") * F.col("y")).alias("yy"), F.count("*").alias("n"), F.first("_start").alias("_start"))
    size = len(names)

    def solve(batches):
        for pdf in batches:
            coefs, spreads = [], []
            for xx, xy, yy, n in zip(pdf["xx"], pdf["xy"], pdf["yy"], pdf["n"]):
                gram = np.zeros((size, size))
                rows, cols = zip(*pairs)
                gram[rows, cols] = xx
                gram[cols, rows] = xx
                moment = np.asarray(xy, dtype=float)
                beta = np.linalg.solve(gram + ridge * np.eye(size), moment)
                error = yy - 2 * beta @ moment + beta @ gram @ beta
                coefs.append(beta.tolist())
                spreads.append(float(np.sqrt(max(error, 0.0) / max(n, 1))))
            out = pdf.drop(columns=["xx", "xy", "yy", "n"])
            yield out.assign(coef=coefs, fit_rmse=spreads)

    kept = [f for f in sums.schema.fields if f.name in (*keys, "_start")]
    schema = T.StructType([*kept, T.StructField("coef", T.ArrayType(T.DoubleType())), T.StructField("fit_rmse", T.DoubleType())])
    models = sums.select(*[f.name for f in kept], "xx", "xy", "yy", "n").mapInPandas(solve, schema)
    ahead = future_regressors(future_calendar(series, horizon, keys), series, regressors, keys)
    every = series.select(*keys, "ds", F.col("y").cast("double").alias("y"), *[F.col(r).cast("double").alias(r) for r in regressors]) \
        .unionByName(ahead.withColumn("y", F.lit(None).cast("double")))
    scored, names = _design(every.join(models, keys), regressors)
    fit = sum((F.col("coef")[i] * F.col(n) for i, n in enumerate(names)), F.lit(0.0))
    band = F.lit(Z95) * F.col("fit_rmse")
    return scored.withColumn("_f", fit).select(
        *keys, "ds", "y", F.greatest(F.col("_f"), F.lit(0.0)).alias("yhat"),
        F.greatest(F.col("_f") - band, F.lit(0.0)).alias("yhat_lower"),
        F.greatest(F.col("_f") + band, F.lit(0.0)).alias("yhat_upper"))


def lookback_windows(series: DataFrame, width: int, column: str = "y", keys: Sequence[str] = ("sku_id",)) -> DataFrame:
    """The ``width`` values before each day, for days that have that many."""
    past = Window.partitionBy(*keys).orderBy("ds").rowsBetween(-width, -1)
    out = series.withColumn("lookback", F.collect_list(F.col(column).cast("double")).over(past))
    return out.where(F.size("lookback") == width)


def lagged_forecaster(series: DataFrame, cutoff: str, width: int = 14, keys: Sequence[str] = ("sku_id",), seed: int = 42,
                      rounds: int = 20) -> DataFrame:
    """Boosted trees over the lookback window and calendar waves; predicts the days from ``cutoff`` on."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    from ..functions.scalars import calendar_waves

    frame = lookback_windows(series, width, keys=keys)
    waves = calendar_waves("ds")
    lags = {f"lag_{i + 1}": F.col("lookback")[width - 1 - i] for i in range(width)}
    frame = frame.withColumns({**waves, **lags}).withColumn("label", F.col("y").cast("double"))
    packed = VectorAssembler(inputCols=[*lags, *waves], outputCol="features").transform(frame)
    edge = F.lit(cutoff).cast("date")
    model = GBTRegressor(maxIter=rounds, maxDepth=5, seed=seed, stepSize=0.1).fit(packed.where(F.col("ds") < edge))
    return model.transform(packed.where(F.col("ds") >= edge)).select(
        *keys, "ds", F.col("label").alias("y"), F.greatest(F.col("prediction"), F.lit(0.0)).alias("yhat"))


def forecast_insights(forecast: DataFrame, keys: Sequence[str] = ("sku_id",)) -> DataFrame:
    """Trend change, seasonal strength, interval width and its direction per item."""
    width = F.col("yhat_upper") - F.col("yhat_lower")
    ends = forecast.groupBy(*keys).agg(
        F.min_by("trend", "ds").alias("trend_start"), F.max_by("trend", "ds").alias("trend_end"),
        F.avg(F.abs("weekly")).alias("weekly_strength"), F.avg(F.abs("yearly")).alias("yearly_strength"),
        F.avg(width).alias("avg_uncertainty_width"), F.max(width).alias("max_uncertainty_width"),
        F.min_by(width, "ds").alias("_w0"), F.max_by(width, "ds").alias("_w1"))
    change = F.try_divide(F.col("trend_end") - F.col("trend_start"), F.abs("trend_start")) * 100
    return ends.select(
        *keys, "trend_start", "trend_end", change.alias("trend_change_percent"),
        F.when(change > 0, "increasing").otherwise("decreasing").alias("trend_direction"),
        "weekly_strength", "yearly_strength", "avg_uncertainty_width", "max_uncertainty_width",
        F.when(F.col("_w1") > F.col("_w0"), "increasing").otherwise("stable/decreasing").alias("uncertainty_trend"))


def forecast_deviation(actual: DataFrame, forecast: DataFrame, keys: Sequence[str] = ("sku_id",)) -> DataFrame:
    """Error of a forecast on the days it shares with the actuals."""
    both = actual.select(*keys, "ds", F.col("y").cast("double").alias("_y")).join(
        forecast.select(*keys, "ds", "yhat"), [*keys, "ds"])
    error = F.col("_y") - F.col("yhat")
    return both.groupBy(*keys).agg(
        F.avg(error).alias("mean_error"), F.min(error).alias("max_overprediction"),
        F.max(error).alias("max_underprediction"), F.stddev_samp(error).alias("error_volatility"))


def _correlated(series: DataFrame, column: str, keys: Sequence[str], result: str, read) -> DataFrame:
    """One row per series with ``read(acf, n)`` of the autocorrelations at lags 0 to n - 1 (empty where the series is constant).

    A series is an array of its days in order; its autocovariance is the inverse transform of its power spectrum, padded so that nothing
    wraps around. Spark partitions the series, and Arrow hands over batches of them.
    """
    keys = list(keys)
    rows = series.where(F.col(column).isNotNull()).select(*keys, "ds", F.col(column).cast("double").alias("_v"))
    lists = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ds", "_v")))["_v"].alias("_values"))

    def transform(batches):
        for batch in batches:
            values = batch.column(len(keys))
            flat, ends = values.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.concatenate([[0], values.value_lengths().to_numpy(zero_copy_only=False)]))
            out = []
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                x = flat[a:b] - flat[a:b].mean()
                power = float(x @ x)
                spectrum = np.fft.rfft(x, 1 << (2 * len(x) - 1).bit_length())
                acf = np.fft.irfft(spectrum.real ** 2 + spectrum.imag ** 2)[:len(x)] / power if power > 0 else np.zeros(0)
                out.append(read(acf, len(x)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keys)], pa.array(out, T_ARROW[result])], [*keys, "_out"])

    kinds = T.StructType([*[lists.schema[k] for k in keys], *T.StructType.fromDDL(f"_out {result}").fields])
    return lists.mapInArrow(transform, kinds)


T_ARROW = {"array<double>": pa.list_(pa.float64()), "int": pa.int32()}


def autocorrelations(series: DataFrame, max_lag: int, column: str = "y", keys: Sequence[str] = ("sku_id",)) -> DataFrame:
    """Autocorrelation of a daily series at lags 1..``max_lag`` (at most half its length); null for a constant series."""
    keys = list(keys)

    def read(acf, n):
        top = min(max_lag, n // 2)
        return acf[1:top + 1].tolist() if len(acf) else [None] * top

    found = _correlated(series, column, keys, "array<double>", read)
    return found.select(*keys, F.posexplode("_out").alias("_p", "acf")).select(*keys, (F.col("_p") + 1).alias("lag"), "acf")


def seasonal_peaks(series: DataFrame, threshold: float = 0.3, least: int = 24, column: str = "y", keys: Sequence[str] = ("sku_id",)) -> DataFrame:
    """``seasonal_peak``: 1 if the autocorrelation has a local maximum above the threshold at any inner lag; 0 for series of fewer than ``least`` days."""

    def read(acf, n):
        a = np.round(acf, 9)
        peak = (a[1:-1] > a[:-2]) & (a[1:-1] > a[2:]) & (a[1:-1] > threshold)
        return int(n >= least and bool(peak.any()))

    return _correlated(series, column, keys, "int", read).withColumnRenamed("_out", "seasonal_peak")


def seasonality(acf: DataFrame, threshold: float = 0.3, min_period: int = 2, keys: Sequence[str] = ("sku_id",)) -> DataFrame:
    """Lag of the highest autocorrelation above the threshold, if there is one."""
    fit = (F.col("acf") > threshold) & (F.col("lag") >= min_period)
    best = F.max_by(F.when(fit, F.col("lag")), F.when(fit, F.struct(F.col("acf"), -F.col("lag"))))
    return acf.groupBy(*keys).agg(best.cast("double").alias("season_lag"), F.max(fit.cast("int")).alias("seasonal"))


def residual_diagnostics(fitted: DataFrame, max_lag: int = 30, limit: float = 0.2, keys: Sequence[str] = ("sku_id",)) -> DataFrame:
    """Mean, spread and leftover autocorrelation of the residuals of a fit."""
    rows = fitted.where(F.col("y").isNotNull()).withColumn("_res", F.col("y") - F.col("yhat"))
    basic = rows.groupBy(*keys).agg(F.avg("_res").alias("residual_mean"), F.stddev_samp("_res").alias("residual_std"))
    leak = autocorrelations(rows, max_lag, "_res", keys).groupBy(*keys).agg(
        F.max((F.abs("acf") > limit).cast("int")).alias("autocorrelation_leakage"))
    return basic.join(leak, list(keys), "left")


def regularised(series: DataFrame, keys: Sequence[str] = ("sku_id",)) -> DataFrame:
    """Every calendar day of each series; gaps filled by a straight line between the known days.

    ``scans.filled`` fills by the last known value instead.
    """
    keys = list(keys)
    known = series.select(*keys, "ds", F.col("y").cast("double").alias("y"))
    following = Window.partitionBy(*keys).orderBy("ds")
    spans = known.select("*", F.lead("ds").over(following).alias("_next"), F.lead("y").over(following).alias("_ynext"))
    until = F.when(F.col("_next").isNull(), F.col("ds")).otherwise(F.date_sub("_next", 1))
    days = spans.select(*keys, "y", "_ynext", F.col("ds").alias("_from"), "_next",
                        F.explode(F.sequence(F.col("ds"), until)).alias("ds"))
    part = F.try_divide(F.datediff("ds", "_from").cast("double"), F.datediff("_next", "_from").cast("double"))
    return days.select(*keys, "ds", F.coalesce(F.col("y") + (F.col("_ynext") - F.col("y")) * part, F.col("y")).alias("y"),
                       (F.col("ds") != F.col("_from")).cast("int").alias("filled"))


def monthly(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Actuals and forecasts summed per calendar month."""
    return pairs.groupBy(*keys, F.trunc("ds", "month").alias("month")).agg(
        F.sum("y").cast("double").alias("y"), F.sum("yhat").alias("yhat"))


def half_split_stationarity(series: DataFrame, keys: Sequence[str] = ("sku_id",)) -> DataFrame:
    """Whether mean and spread of the first half stay within 10% in the second."""
    keys = list(keys)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("ds"))
    count = series.groupBy(*keys).agg(F.count("*").alias("_n"))
    rows = series.select(*keys, F.col("y").cast("double").alias("y"), place.alias("_i")).join(count, keys)
    first = F.col("_i") <= F.floor(F.col("_n") / 2)
    stats = rows.groupBy(*keys).agg(
        F.avg(F.when(first, F.col("y"))).alias("mean_first"), F.avg(F.when(~first, F.col("y"))).alias("mean_second"),
        F.stddev_pop(F.when(first, F.col("y"))).alias("std_first"), F.stddev_pop(F.when(~first, F.col("y"))).alias("std_second"))
    steady = lambda a, b: F.abs(F.col(a) - F.col(b)) < F.lit(0.1) * F.col(a)
    both = steady("mean_first", "mean_second") & steady("std_first", "std_second")
    return stats.withColumn("is_stationary", F.coalesce(both, F.lit(False)).cast("int"))
