"""Forecast, accuracy and series-diagnostic queries."""

from pyspark.sql import functions as F

from ..functions.scalars import calendar_parts, calendar_waves
from ..operators import demand, forecasting, scans
from ..operators.scale import with_scalars
from ..sources import bindings, readers
from .registry import query
from .sqlbase import SALES, with_ctes
from .supply import BASELINE, BRAND_DAILY, _brand_daily

r = F.round
CUT = "2001-01-01"
# The daily series shortened at the cut-off, for fitting; BASELINE_CUT is the baseline fitted on it.
TRAIN = BRAND_DAILY + """,
full_daily AS (SELECT * FROM daily)"""


def rounded(df, digits, *columns):
    return df.withColumns({c: r(c, digits) for c in columns})


def _backtest(spark, sf):
    """Hold-out days with two forecasts: the seasonal baseline and a naive copy of the last 30-day mean."""
    daily = _brand_daily(spark, sf)
    train, test = demand.split_at(daily, CUT)
    last = test.agg(F.max("ds").cast("string")).first()[0] or CUT   # the horizon is the last hold-out day
    base = forecasting.seasonal_baseline(train, last).where("y IS NULL").select("sku_id", "ds", "yhat", F.lit("seasonal").alias("model"))
    recent = demand.trend_momentum(train).select("sku_id", F.col("recent_30_mean").alias("yhat"))
    flat = test.select("sku_id", "ds").join(recent, "sku_id").select("sku_id", "ds", "yhat", F.lit("flat").alias("model"))
    return test.select("sku_id", "ds", F.col("y").cast("double").alias("y")).join(base.unionByName(flat), ["sku_id", "ds"])


BACKTEST = (SALES, BRAND_DAILY.replace("daily AS", "everyday AS"),
            f"daily AS (SELECT * FROM everyday WHERE ds < DATE '{CUT}')", BASELINE.replace("generate_series(1, 30)", "generate_series(1, 4000)"), f"""
ag AS (SELECT sku_id, ds, y, row_number() OVER (PARTITION BY sku_id ORDER BY ds DESC) AS age, count(*) OVER (PARTITION BY sku_id) AS n FROM daily),
rc AS (SELECT sku_id, CASE WHEN max(n) >= 90 THEN avg(CASE WHEN age <= 30 THEN y END) ELSE avg(y) END AS m FROM ag GROUP BY 1),
tst AS (SELECT sku_id, ds, CAST(y AS DOUBLE) AS y FROM everyday WHERE ds >= DATE '{CUT}'),
bt AS (SELECT t.sku_id, t.ds, t.y, f.yhat, 'seasonal' AS model FROM tst t JOIN fc f ON t.sku_id = f.sku_id AND t.ds = f.ds AND f.y IS NULL
       UNION ALL SELECT t.sku_id, t.ds, t.y, m, 'flat' FROM tst t JOIN rc USING (sku_id)),
acc AS (SELECT model, sku_id, count(*) AS n_days, avg(abs(y - yhat)) AS mae, sqrt(avg((y - yhat) * (y - yhat))) AS rmse,
        coalesce(avg(CASE WHEN y <> 0 THEN abs((y - yhat) / y) END), 0) * 100 AS mape_percent,
        CASE WHEN sum(y) > 0 THEN sum(abs(y - yhat)) / sum(y) * 100 ELSE 0 END AS wmape_percent, avg(yhat - y) AS bias,
        1 - sum((y - yhat) * (y - yhat)) / nullif(var_pop(y) * count(*), 0) AS r2, sum(y) AS total_actual, sum(yhat) AS total_forecast
        FROM bt GROUP BY 1, 2)""")

ACC = ("mae", "rmse", "mape_percent", "wmape_percent", "bias", "r2", "total_actual", "total_forecast")
ACC_SQL = ", ".join(f"round({c}, 6) AS {c}" for c in ACC)


@query("f1_forecast_accuracy", with_ctes(*BACKTEST, f"SELECT model, sku_id, n_days, {ACC_SQL} FROM acc"))
def f1(spark, sf):
    return rounded(forecasting.accuracy(_backtest(spark, sf), ["model", "sku_id"]), 6, *ACC)


@query("f2_model_comparison", with_ctes(*BACKTEST, """
SELECT sku_id, arg_min(model, row(round(mae, 6), model)) AS best_mae, arg_min(model, row(round(rmse, 6), model)) AS best_rmse,
       arg_min(model, row(round(mape_percent, 6), model)) AS best_mape_percent, arg_min(model, row(round(wmape_percent, 6), model)) AS best_wmape_percent,
       arg_min(model, row(-round(r2, 6), model)) AS best_r2 FROM acc GROUP BY 1"""))
def f2(spark, sf):
    metrics = forecasting.accuracy(_backtest(spark, sf), ["model", "sku_id"])
    return forecasting.compare_models(rounded(metrics, 6, "mae", "rmse", "mape_percent", "wmape_percent", "r2"), ["sku_id"])


@query("f3_seasonal_baseline", with_ctes(SALES, BRAND_DAILY, BASELINE, """
SELECT sku_id, ds, y, round(trend, 4) AS trend, round(weekly, 4) AS weekly, round(yearly, 4) AS yearly, round(yhat, 4) AS yhat,
       round(yhat_lower, 4) AS yhat_lower, round(yhat_upper, 4) AS yhat_upper FROM fc"""))
def f3(spark, sf):
    f = forecasting.seasonal_baseline(_brand_daily(spark, sf), 30)
    return rounded(f.drop("fit_rmse"), 4, "trend", "weekly", "yearly", "yhat", "yhat_lower", "yhat_upper")


@query("f4_regressor_forecast")
def f4(spark, sf):
    return forecasting.regressor_forecast(_brand_daily(spark, sf), ["promo_flag", "discount_pct"], 90)


REGR = """
ld AS (SELECT sku_id, max(ds) AS lastd FROM daily GROUP BY 1),
cal AS (SELECT sku_id, CAST(lastd + i AS DATE) AS ds FROM ld, (SELECT unnest(generate_series(1, 90))::INTEGER AS i)),
bs0 AS (SELECT sku_id, avg(discount_pct) AS base FROM (SELECT *, row_number() OVER (PARTITION BY sku_id ORDER BY ds DESC) AS i FROM daily) WHERE i <= 30 GROUP BY 1)"""


@query("f5_future_calendar", with_ctes(SALES, BRAND_DAILY, REGR, """
SELECT sku_id, ds, CAST(0 AS DOUBLE) AS promo_flag, round(base, 6) AS discount_pct FROM cal JOIN bs0 USING (sku_id)"""))
def f5(spark, sf):
    daily = _brand_daily(spark, sf)
    ahead = forecasting.future_regressors(forecasting.future_calendar(daily, 90), daily, ["promo_flag", "discount_pct"])
    return rounded(ahead, 6, "discount_pct")


@query("j4_known_regressors", with_ctes(SALES, BRAND_DAILY, """
kn AS (SELECT sku_id, max(ds) AS lastd FROM daily WHERE ds < DATE '2001-01-01' GROUP BY 1),
cal AS (SELECT sku_id, CAST(lastd + i AS DATE) AS ds FROM kn, (SELECT unnest(generate_series(1, 60))::INTEGER AS i)),
bs0 AS (SELECT sku_id, avg(discount_pct) AS base FROM (SELECT *, row_number() OVER (PARTITION BY sku_id ORDER BY ds DESC) AS i FROM daily) WHERE i <= 30 GROUP BY 1)""", """
SELECT c.sku_id, c.ds, CAST(coalesce(promo_flag, 0) AS DOUBLE) AS promo_flag, round(coalesce(discount_pct, base), 6) AS discount_pct
FROM cal c LEFT JOIN daily d ON c.sku_id = d.sku_id AND c.ds = d.ds JOIN bs0 b ON c.sku_id = b.sku_id"""))
def j4(spark, sf):
    daily = _brand_daily(spark, sf)
    calendar = forecasting.future_calendar(demand.split_at(daily, CUT)[0], 60)
    return rounded(forecasting.future_regressors(calendar, daily, ["promo_flag", "discount_pct"]), 6, "discount_pct")


@query("f6_lagged_forecaster")
def f6(spark, sf):
    return forecasting.lagged_forecaster(_brand_daily(spark, sf), CUT)


@query("f7_forecast_insights", with_ctes(SALES, BRAND_DAILY, BASELINE, "fx AS (SELECT *, round(yhat_upper - yhat_lower, 6) AS wd FROM fc)", """
SELECT sku_id, round(arg_min(trend, ds), 4) AS trend_start, round(arg_max(trend, ds), 4) AS trend_end,
  round((arg_max(trend, ds) - arg_min(trend, ds)) / abs(arg_min(trend, ds)) * 100, 4) AS trend_change_percent,
  CASE WHEN arg_max(trend, ds) > arg_min(trend, ds) THEN 'increasing' ELSE 'decreasing' END AS trend_direction,
  round(avg(abs(weekly)), 4) AS weekly_strength, round(avg(abs(yearly)), 4) AS yearly_strength,
  round(avg(wd), 4) AS avg_uncertainty_width, round(max(wd), 4) AS max_uncertainty_width,
  CASE WHEN arg_max(wd, ds) > arg_min(wd, ds) THEN 'increasing' ELSE 'stable/decreasing' END AS uncertainty_trend
FROM fx GROUP BY 1"""))
def f7(spark, sf):
    f = forecasting.seasonal_baseline(_brand_daily(spark, sf), 30)
    f = f.withColumn("yhat_upper", r(F.col("yhat_upper") - F.col("yhat_lower"), 6)).withColumn("yhat_lower", F.lit(0.0))
    out = forecasting.forecast_insights(f)
    return rounded(out, 4, *[c for c, t in out.dtypes if t == "double"])


@query("f7_forecast_deviation", with_ctes(*BACKTEST, """
SELECT sku_id, round(avg(y - yhat), 4) AS mean_error, round(min(y - yhat), 4) AS max_overprediction, round(max(y - yhat), 4) AS max_underprediction,
       round(stddev_samp(y - yhat), 4) AS error_volatility FROM bt WHERE model = 'seasonal' GROUP BY 1"""))
def f7b(spark, sf):
    b = _backtest(spark, sf).where("model = 'seasonal'")
    out = forecasting.forecast_deviation(b.select("sku_id", "ds", "y"), b.select("sku_id", "ds", "yhat"))
    return rounded(out, 4, *out.columns[1:])


@query("f7_residual_diagnostics", with_ctes(SALES, BRAND_DAILY, BASELINE, """
rs AS (SELECT sku_id, row_number() OVER (PARTITION BY sku_id ORDER BY ds) AS i, y - yhat AS e FROM fc WHERE y IS NOT NULL),
rm AS (SELECT sku_id, avg(e) AS m, stddev_samp(e) AS s, count(*) AS n FROM rs GROUP BY 1),
rd AS (SELECT rs.sku_id, i, e - m AS d FROM rs JOIN rm USING (sku_id)),
ac AS (SELECT a.sku_id, b.i - a.i AS lag, sum(a.d * b.d) AS c FROM rd a JOIN rd b ON a.sku_id = b.sku_id AND b.i - a.i BETWEEN 1 AND 30 GROUP BY 1, 2),
pw AS (SELECT sku_id, sum(d * d) AS p FROM rd GROUP BY 1)""", """
SELECT rm.sku_id, round(m, 4) + 0.0 AS residual_mean, round(s, 4) AS residual_std, lk AS autocorrelation_leakage
FROM rm LEFT JOIN (SELECT ac.sku_id, max(CASE WHEN abs(c / p) > 0.2 THEN 1 ELSE 0 END) AS lk FROM ac JOIN pw USING (sku_id) GROUP BY 1) USING (sku_id)"""))
def f7c(spark, sf):
    out = forecasting.residual_diagnostics(forecasting.seasonal_baseline(_brand_daily(spark, sf), 1))
    return rounded(out, 4, "residual_mean", "residual_std")


@query("f8_monthly_accuracy", with_ctes(*BACKTEST, """
mo AS (SELECT model, sku_id, date_trunc('month', ds) AS month, sum(y) AS y, sum(yhat) AS yhat FROM bt GROUP BY 1, 2, 3)""", """
SELECT model, count(*) AS n_days, round(avg(abs(y - yhat)), 4) AS mae, round(sqrt(avg((y - yhat) * (y - yhat))), 4) AS rmse,
  round(sum(abs(y - yhat)) / sum(y) * 100, 4) AS wmape_percent, round(1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*)), 4) AS r2
FROM mo GROUP BY 1"""))
def f8(spark, sf):
    months = forecasting.monthly(_backtest(spark, sf), ["model", "sku_id"])
    out = forecasting.accuracy(months, ["model"]).select("model", "n_days", "mae", "rmse", "wmape_percent", "r2")
    return rounded(out, 4, "mae", "rmse", "wmape_percent", "r2")


FREQ = """
sp AS (SELECT sku_id, count(*) AS n, date_diff('day', min(ds), max(ds)) AS span FROM daily GROUP BY 1),
gp AS (SELECT sku_id, median(g) AS gap FROM (SELECT sku_id, date_diff('day', lag(ds) OVER (PARTITION BY sku_id ORDER BY ds), ds) AS g FROM daily) GROUP BY 1),
fq AS (SELECT sku_id, n AS n_points, CAST(span AS INTEGER) AS span_days, coalesce(gap, 1.0) AS gap FROM sp LEFT JOIN gp USING (sku_id))"""
ITEM_DAILY = "daily AS (SELECT sku_id, date AS ds, sum(units_sold) AS y FROM sales GROUP BY 1, 2)"


@query("w8_series_frequency", with_ctes(SALES, ITEM_DAILY, FREQ, """
SELECT sku_id, n_points, span_days, CAST(gap AS DOUBLE) AS median_gap,
  CASE WHEN gap <= 1 THEN 'D' WHEN gap <= 8 THEN 'W' WHEN gap <= 32 THEN 'M' ELSE 'unknown' END AS frequency,
  CAST(CASE WHEN n_points < 2 THEN 7 WHEN gap <= 1 THEN 7 WHEN gap <= 8 THEN 52 WHEN gap <= 32 THEN 12 ELSE 4 END AS INTEGER) AS season_length FROM fq"""))
def w8(spark, sf):
    return forecasting.series_frequency(demand.daily_demand(bindings.sales(spark, sf)))


@query("f9_adaptive_choices", with_ctes(SALES, BRAND_DAILY, FREQ, """
SELECT sku_id, CASE WHEN gap <= 1 THEN 'D' WHEN gap <= 8 THEN 'W' WHEN gap <= 32 THEN 'M' ELSE 'unknown' END AS frequency, span_days, n_points,
  CASE WHEN gap <= 8 AND span_days >= 14 THEN 1 ELSE 0 END AS weekly, CASE WHEN span_days >= 365 THEN 1 ELSE 0 END AS yearly,
  CAST(CASE WHEN n_points - 14 >= 200 THEN 14 WHEN n_points - 21 >= 200 THEN 21 WHEN n_points - 30 >= 200 THEN 30 ELSE 7 END AS INTEGER) AS lookback FROM fq"""))
def f9(spark, sf):
    return forecasting.adaptive_choices(forecasting.series_frequency(_brand_daily(spark, sf)))


@query("w12_lookback_windows", with_ctes(SALES, BRAND_DAILY, """
lb AS (SELECT sku_id, ds, CAST(y AS BIGINT) AS y, list(y) OVER (PARTITION BY sku_id ORDER BY ds ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS w FROM daily)""", """
SELECT sku_id, ds, y, array_to_string(list_transform(w, lambda v: CAST(CAST(v AS BIGINT) AS VARCHAR)), ',') AS lookback FROM lb WHERE len(w) = 14"""))
def w12(spark, sf):
    out = forecasting.lookback_windows(_brand_daily(spark, sf).select("sku_id", "ds", "y"), 14)
    return out.withColumn("lookback", F.array_join(F.col("lookback").cast("array<bigint>").cast("array<string>"), ","))


@query("w14_regularised", with_ctes(SALES, BRAND_DAILY, """
nx AS (SELECT sku_id, ds, CAST(y AS DOUBLE) AS y, lead(ds) OVER w AS nd, CAST(lead(y) OVER w AS DOUBLE) AS ny FROM daily WINDOW w AS (PARTITION BY sku_id ORDER BY ds)),
ex AS (SELECT sku_id, y, ny, ds AS d0, nd, CAST(ds + i AS DATE) AS ds, i FROM nx, LATERAL (SELECT unnest(generate_series(0, coalesce(date_diff('day', ds, nd), 1) - 1))::INTEGER AS i))""", """
SELECT sku_id, ds, round(CASE WHEN nd IS NULL THEN y ELSE y + (ny - y) * (CAST(i AS DOUBLE) / date_diff('day', d0, nd)) END, 6) AS y, CASE WHEN i > 0 THEN 1 ELSE 0 END AS filled FROM ex"""))
def w14(spark, sf):
    return rounded(forecasting.regularised(_brand_daily(spark, sf)), 6, "y")


GAPS = """
ct AS (SELECT category, date AS ds, CAST(sum(units_sold) AS DOUBLE) AS y FROM sales GROUP BY 1, 2),
cal AS (SELECT category, CAST(d AS DATE) AS ds FROM (SELECT DISTINCT category FROM ct), (SELECT unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS d FROM ct)),
gp AS (SELECT category, ds, y FROM cal LEFT JOIN ct USING (category, ds))"""


@query("w14_last_known_value", with_ctes(SALES, GAPS, """
SELECT category, ds, coalesce(last_value(y IGNORE NULLS) OVER (PARTITION BY category ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(y IGNORE NULLS) OVER (PARTITION BY category ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS y FROM gp"""))
def w14b(spark, sf):
    """Every category on every day of the table; days without a sale take the last known total, and days before the first sale the first one."""
    sales = bindings.sales(spark, sf, parts=True).select("category", F.col("date").alias("ds"), "units_sold")
    daily = sales.groupBy("category", "ds").agg(F.sum("units_sold").cast("double").alias("y"))
    span = sales.agg(F.min("ds").alias("a"), F.max("ds").alias("b"))
    every = with_scalars(daily.select("category").distinct(), span).select("category", F.explode(F.sequence("a", "b")).alias("ds"))
    return scans.filled(every.join(daily, ["category", "ds"], "left"), keys=["category"])


@query("w17_half_stationarity", with_ctes(SALES, BRAND_DAILY, """
ix AS (SELECT sku_id, CAST(y AS DOUBLE) AS y, row_number() OVER (PARTITION BY sku_id ORDER BY ds) AS i, count(*) OVER (PARTITION BY sku_id) AS n FROM daily),
hs AS (SELECT sku_id, avg(y) FILTER (i <= n // 2) AS a, avg(y) FILTER (i > n // 2) AS b, stddev_pop(y) FILTER (i <= n // 2) AS c, stddev_pop(y) FILTER (i > n // 2) AS d FROM ix GROUP BY 1)""", """
SELECT sku_id, round(a, 6) AS mean_first, round(b, 6) AS mean_second, round(c, 6) AS std_first, round(d, 6) AS std_second,
  CASE WHEN abs(a - b) < 0.1::DOUBLE * a AND abs(c - d) < 0.1::DOUBLE * c THEN 1 ELSE 0 END AS is_stationary FROM hs"""))
def w17(spark, sf):
    out = forecasting.half_split_stationarity(_brand_daily(spark, sf))
    return rounded(out, 6, "mean_first", "mean_second", "std_first", "std_second")


ACF = """
ix AS (SELECT sku_id, CAST(y AS DOUBLE) AS y, row_number() OVER (PARTITION BY sku_id ORDER BY ds) AS i FROM daily),
mn AS (SELECT sku_id, avg(y) AS m, count(*) AS n FROM ix GROUP BY 1),
dv AS (SELECT ix.sku_id, i, n, y - m AS d FROM ix JOIN mn USING (sku_id)),
pw AS (SELECT sku_id, sum(d * d) AS p FROM dv GROUP BY 1),
acf AS (SELECT a.sku_id, CAST(b.i - a.i AS INTEGER) AS lag, sum(a.d * b.d) / max(p) AS acf FROM dv a JOIN dv b ON a.sku_id = b.sku_id AND b.i - a.i BETWEEN 1 AND 365
        AND b.i - a.i <= a.n // 2 JOIN pw ON pw.sku_id = a.sku_id GROUP BY 1, 2)"""


@query("w7_autocorrelation", with_ctes(SALES, BRAND_DAILY, ACF, "SELECT sku_id, lag, round(acf, 6) AS acf FROM acf"))
def w7(spark, sf):
    return rounded(forecasting.autocorrelations(_brand_daily(spark, sf), 365), 6, "acf")


@query("w7_seasonality_lag", with_ctes(SALES, BRAND_DAILY, ACF, """
SELECT sku_id, CAST(arg_max(lag, row(round(acf, 9), -lag)) FILTER (acf > 0.3 AND lag >= 2) AS DOUBLE) AS season_lag,
       max(CASE WHEN acf > 0.3 AND lag >= 2 THEN 1 ELSE 0 END) AS seasonal FROM acf GROUP BY 1"""))
def w7b(spark, sf):
    acf = rounded(forecasting.autocorrelations(_brand_daily(spark, sf), 365), 9, "acf")
    return forecasting.seasonality(acf, threshold=0.3)


@query("w7_seasonal_peak", with_ctes(SALES, BRAND_DAILY, ACF.replace("BETWEEN 1 AND 365", "BETWEEN 0 AND 100000").replace("AND b.i - a.i <= a.n // 2 ", "AND b.i - a.i <= a.n - 1 "), """
pk AS (SELECT sku_id, round(acf, 9) AS a, round(lag(acf) OVER w, 9) AS b, round(lead(acf) OVER w, 9) AS c, lag FROM acf WINDOW w AS (PARTITION BY sku_id ORDER BY lag))""", """
SELECT sku_id, CAST(CASE WHEN any_value(n) >= 24 AND bool_or(coalesce(a > b AND a > c AND a > 0.3, false)) THEN 1 ELSE 0 END AS INTEGER) AS seasonal_peak
FROM pk JOIN mn USING (sku_id) GROUP BY 1"""))
def w7c(spark, sf):
    return forecasting.seasonal_peaks(_brand_daily(spark, sf))


@query("j5_actual_forecast_join", with_ctes(SALES, BRAND_DAILY, BASELINE, """
SELECT d.sku_id, d.ds, CAST(d.y AS BIGINT) AS y, round(f.yhat, 4) AS yhat FROM daily d JOIN fc f ON d.sku_id = f.sku_id AND d.ds = f.ds"""))
def j5(spark, sf):
    daily = _brand_daily(spark, sf)
    both = daily.select("sku_id", "ds", "y").join(forecasting.seasonal_baseline(daily, 30).select("sku_id", "ds", "yhat"), ["sku_id", "ds"])
    return rounded(both, 4, "yhat")


@query("j6_forecast_export", with_ctes(SALES, BRAND_DAILY, BASELINE, """
SELECT f.sku_id, f.ds, round(f.yhat, 4) AS yhat, CAST(d.y AS DOUBLE) AS y FROM fc f LEFT JOIN daily d ON d.sku_id = f.sku_id AND d.ds = f.ds"""))
def j6(spark, sf):
    daily = _brand_daily(spark, sf)
    export = forecasting.seasonal_baseline(daily, 30).select("sku_id", "ds", "yhat").join(
        daily.select("sku_id", "ds", F.col("y").cast("double").alias("y")), ["sku_id", "ds"], "left")
    return rounded(export, 4, "yhat")


@query("u2_history_future", with_ctes(SALES, BRAND_DAILY, REGR, """
SELECT sku_id, ds, CAST(y AS DOUBLE) AS y, 0 AS is_future FROM daily UNION ALL SELECT sku_id, ds, NULL, 1 FROM cal"""))
def u2(spark, sf):
    daily = _brand_daily(spark, sf)
    past = daily.select("sku_id", "ds", F.col("y").cast("double").alias("y"), F.lit(0).alias("is_future"))
    ahead = forecasting.future_calendar(daily, 90).withColumn("is_future", F.lit(1))
    return past.unionByName(ahead, allowMissingColumns=True)


@query("z7_calendar_waves", """
SELECT o_orderkey, round(sin(2 * pi() * (isodow(d) - 1) / 7), 6) AS sin_dow, round(cos(2 * pi() * (isodow(d) - 1) / 7), 6) AS cos_dow,
  round(sin(2 * pi() * day(d) / 31), 6) + 0.0 AS sin_dom, round(cos(2 * pi() * day(d) / 31), 6) AS cos_dom,
  round(sin(2 * pi() * month(d) / 12), 6) + 0.0 AS sin_month, round(cos(2 * pi() * month(d) / 12), 6) + 0.0 AS cos_month
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def z7(spark, sf):
    o = readers.table(spark, sf, "orders").withColumn("d", F.to_date("o_orderdate"))
    return o.select("o_orderkey", *[(r(c, 6) + 0.0).alias(n) for n, c in calendar_waves("d").items()])


@query("z8_calendar_parts", """
SELECT o_orderkey, CAST(month(d) AS DOUBLE) AS order_month, CAST(quarter(d) AS DOUBLE) AS order_quarter, CAST(isodow(d) - 1 AS DOUBLE) AS order_dayofweek,
  CAST(CASE WHEN isodow(d) >= 6 THEN 1 ELSE 0 END AS DOUBLE) AS is_weekend FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def z8(spark, sf):
    o = readers.table(spark, sf, "orders").withColumn("d", F.to_date("o_orderdate"))
    return o.select("o_orderkey", *[c.alias(n) for n, c in calendar_parts("d").items()])


@query("z9_date_arithmetic", with_ctes(SALES, """
SELECT l_orderkey, l_linenumber, sku_id, date, CAST(date_diff('day', order_date, date) AS INTEGER) AS days_open,
  CAST(date + CAST(lead_time_days AS INTEGER) AS DATE) AS due, strftime(date, '%Y-%m-%d') AS day_text FROM sales"""))
def z9(spark, sf):
    return bindings.sales(spark, sf, orders=True).select(
        "l_orderkey", "l_linenumber", "sku_id", "date", F.datediff("date", "order_date").alias("days_open"),
        F.date_add("date", F.col("lead_time_days")).alias("due"), F.date_format("date", "yyyy-MM-dd").alias("day_text"))
