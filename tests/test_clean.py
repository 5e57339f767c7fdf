"""Edges of readers, coercion, cleaning, encoding, selection and sampling."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaymart.functions import naming, scalars
from quaymart.operators import cleaning, columns, encoding, joins, sampling
from quaymart.plans.master_set import build_master
from quaymart.sources import readers, writers


def test_csv_delimiters_and_encodings(spark, tmp_path):
    for i, (sep, enc) in enumerate([(",", "utf-8"), (";", "utf-8"), ("\t", "utf-8-sig"), ("|", "cp1252"), (";", "latin1")]):
        path = tmp_path / f"f{i}.csv"
        word = "café ’x" if enc != "latin1" else "café"
        path.write_bytes(f"id{sep}name\n1{sep}{word}\n".encode(enc))
        rows = readers.csv(spark, str(path)).collect()
        assert rows[0].asDict() == {"id": "1", "name": word}


def test_json_round_trip(spark, tmp_path):
    frame = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 1.5)], "id long, v double")
    writers.write_json(frame, str(tmp_path / "j"))
    back = readers.json(spark, str(tmp_path / "j"), "id long, v double").orderBy("id").collect()
    assert [r["v"] for r in back] == [None, None, 1.5]
    assert '"v":null' in writers.json_rows(frame).orderBy("value").first()["value"]


def test_table_sinks(spark, tmp_path):
    frame = spark.createDataFrame([("a", 1), ("b", 2)], "sku_id string, v int")
    writers.write_table(frame, str(tmp_path / "p"), partition_by=["sku_id"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    writers.write_table(frame, str(tmp_path / "c"), form="csv")
    assert readers.csv(spark, str(tmp_path / "c")).count() == 2
    writers.write_category_summary(frame, frame, str(tmp_path / "s"), "run1")
    assert spark.read.parquet(str(tmp_path / "s" / "features")).columns == ["sku_id", "v", "run_id"]


def test_numbers_in_text(spark):
    cases = [("1,200 units", 1200.0), ("", None), ("nan", None), ("-3.5%", -3.5), ("n/a", None), (None, None), ("$ .5", 0.5)]
    frame = spark.createDataFrame([(c,) for c, _ in cases], "t string")
    assert [r[0] for r in frame.select(scalars.number_in_text("t")).collect()] == [v for _, v in cases]


def test_coercion_gate(spark):
    good = spark.createDataFrame([("1",), ("2 x",), ("3",), ("4",), ("five",)], "t string")
    assert dict(columns.coerced_numeric(good, "t").dtypes)["t"] == "double"
    bad = spark.createDataFrame([("1",), ("two",), ("three",)], "t string")
    assert dict(columns.coerced_numeric(bad, "t").dtypes)["t"] == "string"


@pytest.mark.parametrize("values,kind", [([20240131, 20240231, None], "ymd"), ([1706659200, 1706659200], "s"), ([1706659200000], "ms"),
                                         ([1706659200000000], "us")])
def test_time_units(spark, values, kind):
    frame = spark.createDataFrame([(v,) for v in values], "t long")
    out = [r[0] for r in columns.parsed_time(frame, "t").select(F.to_date("event_time")).collect()]
    assert str(out[0]) == "2024-01-31"
    if kind == "ymd":
        assert out[1:] == [None, None]


def test_best_time_column(spark):
    frame = spark.createDataFrame([("x", 1706659200), ("20240131", 1706659200)], "date string, event_timestamp long")
    assert columns.best_event_time(frame).where("event_time IS NULL").count() == 0


def test_labels_are_compared_by_meaning(spark):
    frame = spark.createDataFrame([("1.0", "1", True), ("Yes", " yes", True), ("1", "2", False), (None, "1", False)], "a string, b string, same boolean")
    assert frame.where(scalars.same_label("a", "b") != F.col("same")).count() == 0


def test_names():
    assert naming.detect_roles(["Order_Date", "qty", "vendor_name", "unit_cost"])["supplier"] == "vendor_name"
    assert naming.find_column(["itemCategory2", "Item Category"], "item_category") == "Item Category"
    assert naming.encoded_names("c", ["a b", "a-b", " "]) == {"a b": "c_a_b", "a-b": "c_a_b_2", " ": "c_blank"}
    assert naming.primary_key_guess(["a", "id"]) == ["id"] and naming.primary_key_guess(["a", "b", "c"]) == ["a", "b"]
    assert naming.readiness_scores({"date": "d", "demand": "q"}) == {"order_readiness": 60, "overall_readiness": 76}
    assert naming.display_unit("unit_price") == "$" and naming.display_unit("x", "Categorical") == "%" and naming.display_unit("age") == " years"
    assert naming.task_type(2, True) == "classification" and naming.task_type(9, True) == "regression"
    audit = naming.audit_leakage(["user_id", "is_buyer_score", "n_orders", "date", "composite_index", "views", "paid_total"], "is_buyer")
    assert audit.suspected == ["composite_index", "is_buyer_score", "n_orders", "user_id"] and audit.time_like == ["date"]
    assert naming.outcome_polarity("0", 1, 0, change="decrease").score_moves_up


def test_all_null_constant_and_empty(spark):
    frame = spark.createDataFrame([(1, None, 5.0, "x"), (2, None, 5.0, None), (3, None, 5.0, "x")], "id long, gone double, flat double, t string")
    assert columns.without_empty(frame).columns == ["id", "flat", "t"]
    plan = cleaning.imputation(frame, ["id"])
    assert plan.dropped == ["gone"] and plan.fills == {"t": "x"}
    bounds = {r["column"]: r["method"] for r in cleaning.outlier_bounds(frame, ["id", "flat"]).collect()}
    assert bounds == {"id": "log z-score", "flat": "skipped"}
    assert cleaning.min_max_scaled(frame, ["flat"]).first()["flat"] == 5.0
    empty = frame.limit(0)
    assert cleaning.min_max_scaled(empty, ["flat"]).count() == 0
    assert columns.target_verdict(empty, "t").first()["verdict"] == "no rows"
    assert columns.target_verdict(frame, "t").first()["verdict"] == "too few valid rows"


def test_skew_decides_the_fill(spark):
    values = [1.0] * 8 + [100.0, None]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double")
    assert cleaning.imputation(frame, ["id"]).fills["v"] == 1.0
    assert cleaning.imputation(frame, ["id"], always_mean=True).fills["v"] == pytest.approx(12.0)


def test_outlier_modes_agree_on_one_column(spark):
    frame = spark.createDataFrame([(float(v),) for v in list(range(100, 140)) + [10_000]], "v double")
    report = []
    one = sorted(r[0] for r in cleaning.without_outliers(frame, ["v"], report=report).collect())
    two = sorted(r[0] for r in cleaning.without_outliers(frame, ["v"], mode="sequential").collect())
    assert one == pytest.approx(two) and len(one) == 40 and report[0]["flagged"] == 1


def test_ties_in_top_categories(spark):
    frame = spark.createDataFrame([(c,) for c in "ggffeeddccbbaa"] + [(None,), ("",)], "c string")
    out, meta = encoding.one_hot(frame, ["c"])
    assert meta.top["c"] == ["Missing", "a", "b", "c", "d"]
    assert out.agg(F.sum("c_Others")).first()[0] == 6 and len(out.columns) == 6


def test_ten_values_stay_unencoded(spark):
    frame = spark.createDataFrame([(str(i % 10), str(i % 2)) for i in range(40)], "ten string, two string")
    out = encoding.coded_or_one_hot(frame, ["ten", "two"])
    assert dict(out.dtypes) == {"ten": "string", "two": "double"}


def test_codes_of_a_large_dictionary(spark):
    frame = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("a",)], "t string")
    small = {r["t"]: r["code"] for r in columns.ordinal_codes(frame, {"t": "code"}).collect()}
    large = {r["t"]: r["code"] for r in columns.ordinal_codes(frame, {"t": "code"}, broadcast_rows=0).collect()}
    assert small == large == {"a": 0.0, "b": 1.0, "c": 2.0, None: 3.0}


def test_splits_are_exact_and_repeatable(spark):
    frame = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    split = sampling.stratified_split(frame, "y", ["id"])
    counts = {(r["y"], r["part"]): r["count"] for r in split.groupBy("y", "part").count().collect()}
    assert counts == {(0, 0): 630, (0, 1): 90, (0, 2): 180, (1, 0): 70, (1, 1): 10, (1, 2): 20}
    again = sampling.stratified_split(frame.repartition(7), "y", ["id"])
    assert split.exceptAll(again).count() == 0


def test_undersampling_keeps_the_minority(spark):
    frame = spark.range(1000).select("id", (F.col("id") < 30).cast("int").alias("y"))
    out = sampling.undersampled(frame, "y", ["id"])
    assert {r["y"]: r["count"] for r in out.groupBy("y").count().collect()} == {0: 120, 1: 30}
    assert out.select("id").distinct().count() == 150


def test_synthetic_rows_lie_between_minority_rows(spark):
    frame = spark.range(400).select("id", (F.col("id") < 20).cast("int").alias("y"), (F.col("id") * 1.0).alias("a"), (F.col("id") * 2.0).alias("b"))
    out = sampling.smote(frame, "y", ["a", "b"], ["id"], 1, 0.2)
    made = out.where("is_synthetic = 1").toPandas()
    assert len(made) == 75 and made["a"].between(0, 19).all() and np.allclose(made["b"], 2 * made["a"])


def test_merges(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    b = spark.createDataFrame([(2, None, 5), (3, "z", 6)], "k long, v string, n int")
    out = {r["k"]: (r["v"], r["n"]) for r in joins.merged_over_baseline(a, b, ["k"]).collect()}
    assert out == {1: ("x", None), 2: ("y", 5), 3: ("z", 6)}
    with pytest.raises(ValueError):
        joins.merged_by_position(a, b, [], [])
    assert joins.merged([a, b], ["other"]).count() == 4


def test_user_rollup_passes_unknown_users(spark):
    rows = [("u", "2024-01-02", 1, 0, None), ("u", "2024-01-01", 2, 1, "b"), (None, "2024-01-01", 5, 0, "c"), (None, "2024-01-01", 6, 0, "d")]
    frame = spark.createDataFrame(rows, "user string, date string, n int, is_buyer int, t string")
    out = joins.rolled_up(frame, "user", "date")
    assert out.count() == 3
    u = out.where("user = 'u'").first()
    assert (u["date"], u["n"], u["is_buyer"], u["t"]) == ("2024-01-01", 3, 1, "b")


def test_master_set_drops_and_scales(spark):
    n = F.col("id")
    frame = spark.range(400).select(n, (n % 2).cast("int").alias("y"), (n % 2 * 10.0).alias("leak"), (n % 7 + n % 2).cast("double").alias("a"), ((n % 7 + n % 2) * 2.0).alias("a2"),
                                    F.lit(None).cast("double").alias("gone"), F.concat(F.lit("c"), n % 8).alias("c"))
    result = build_master(frame, "y", ["id"], ["id"])
    assert "leak" not in result.frame.columns and "gone" not in result.frame.columns
    assert "a" in result.frame.columns and "a2" not in result.frame.columns
    assert result.frame.agg(F.max("master_id")).first()[0] == result.frame.count()


def test_synthetic_rows_do_not_bridge_far_groups(spark):
    rows = [(i, float(i % 7) / 10, float(i % 5) / 10, 1) for i in range(150)] + [(1000 + i, 50 + float(i % 7) / 10, 80 + float(i % 5) / 10, 1) for i in range(150)]
    rows += [(5000 + i, 20.0, 20.0, 0) for i in range(4000)]
    made = sampling.smote(spark.createDataFrame(rows, "id int, a double, b double, y int"), "y", ["a", "b"], ["id"], 1, target_share=0.2).where("is_synthetic = 1").toPandas()
    assert len(made) == 700 and ((made["a"] < 1) & (made["b"] < 1) | (made["a"] > 49) & (made["b"] > 79)).all()


@pytest.mark.parametrize("dimensions", [1, 4])
def test_nearest_rows_are_those_of_brute_force(spark, dimensions):
    rng = np.random.default_rng(dimensions)
    x = rng.random((1500, dimensions)) ** 2
    x[:200] = x[0]
    x[200:500] = np.round(x[200:500], 1)
    names = [f"f{i}" for i in range(dimensions)]
    points = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "_place long, " + ", ".join(f"{n} double" for n in names))
    found = sampling.near_rows(points, names, 5, len(x)).toPandas()
    away = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(away, np.inf)
    want = np.sort(away, axis=1)[:, :5]
    assert len(found) == 5 * len(x) and (found["_found"] == 5).all() and not found.duplicated(["_place", "_peer"]).any()
    got = np.full(want.shape, np.nan)
    got[found["_place"], found["_nth"] - 1] = away[found["_place"], found["_peer"]]
    assert np.allclose(got, want, rtol=1e-12, atol=0)


def test_constant_columns_have_no_correlation(spark):
    from quaymart.operators import selection

    rows = spark.createDataFrame([(1, float(i % 7), 2.0 * i + i % 3, None if i % 2 else 3) for i in range(50)], "flag int, x double, y double, gap int")
    found = {r["feature"]: r["corr"] for r in selection.target_correlations(rows, "y", ["flag", "x", "gap"]).collect()}
    assert found["flag"] is None and found["gap"] is None and found["x"] == pytest.approx(rows.toPandas()["x"].corr(rows.toPandas()["y"]))
    assert selection.correlated_regressors(rows, "y", ["flag", "y"]) == ["y"]


def test_regressors_that_never_vary_are_listed_with_nan(spark, tmp_path):
    import __spark_entry__ as entry

    for t, sql in (("lineitem", "SELECT id AS l_orderkey, 1L AS l_partkey, 1L AS l_suppkey, 1 AS l_linenumber, double(1 + id % 5) AS l_quantity, double(10 + id) AS l_extendedprice, 0.06D AS l_discount, 0.01D AS l_tax, "
                    "CASE WHEN id % 5 > 2 THEN 'R' ELSE 'N' END AS l_returnflag, 'O' AS l_linestatus, timestamp(date_add(date '2000-01-01', int(id))) AS l_shipdate FROM range(40)"),
                   ("part", "SELECT 1L AS p_partkey, 'p' AS p_name, 'Brand#1' AS p_brand, 't' AS p_type, 1 AS p_size, 1.0D AS p_retailprice")):
        spark.sql(sql).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    found = {r["feature"]: r["corr"] for r in entry.queries()["x16_correlated_regressors"](spark, str(tmp_path)).collect()}
    assert found["promo_flag"] != found["promo_flag"] and abs(found["stock_out_flag"]) > 0.5
