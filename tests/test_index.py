"""Edges of labels, contracts, index, evaluation, attribution and streaming."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaymart.operators import attribution, evaluation, index_score, labels, models, selection
from quaymart.plans import contracts
from quaymart.sources import bindings
from quaymart.streaming import rollups

SF = "/root/testdata/sf0.001"


def test_panel_counts_rows_back_and_days_ahead(spark):
    days = [(dt.date(2024, 1, d), p) for d, p in ((1, 1), (2, 2), (9, 4), (10, 8))]
    rows = spark.createDataFrame([("i", d, 1, 1, p, 1.0, "c") for d, p in days],
                                 "item_id string, day date, views int, carts int, purchases int, revenue double, item_category string")
    panel = labels.item_day_panel(rows).orderBy("day").collect()
    assert [r["purchases_roll_3"] for r in panel] == [1, 3, 7, 14]
    assert [r["future_units_raw"] for r in panel] == [2, 4, 8, 0]
    assert [r["future_target_complete"] for r in panel] == [1, 1, 0, 0]
    assert [r["purchases_lag_1"] for r in panel] == [0, 1, 3, 7]


def test_heavy_user_history_is_folded_by_day(spark):
    rows = spark.range(5000).select(F.lit("u").alias("user_pseudo_id"), F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 3 * 10).cast("int")).alias("day"))
    out = labels.purchase_days(rows).orderBy("day").collect()
    assert [r["days_until_next_purchase"] for r in out] == [10.0, 10.0, None]
    assert [r["time_to_event"] for r in out] == [10, 10, 0] and out[0]["n_orders"] == 3


def test_churn_without_dates_is_zero(spark):
    rows = spark.createDataFrame([("a", dt.date(2024, 1, 1)), ("b", dt.date(2024, 3, 2)), ("c", dt.date(2024, 3, 1)), ("d", None)], "user_pseudo_id string, day date")
    out = {r["user_pseudo_id"]: r["is_churned"] for r in labels.inactivity_churn(rows).collect()}
    assert out == {"a": 1, "b": 0, "c": 0, "d": 0}


def test_leave_one_out_mean(spark):
    rows = spark.createDataFrame([("g", 1.0), ("g", 3.0), ("h", 5.0)], "k string, v double")
    out = {r["v"]: r["group_mean"] for r in labels.group_transform(rows, "k", "v", leave_one_out=True).collect()}
    assert out == {1.0: 3.0, 3.0: 1.0, 5.0: None}


@pytest.mark.parametrize("number", sorted(contracts.CONTRACTS))
def test_contracts(spark, number):
    contract = contracts.CONTRACTS[number]
    if number == 6:
        e = bindings.item_events(spark, SF).withColumn("revenue", F.col("revenue_cents") / 100)
        result = contracts.build(6, e)
    else:
        history = labels.purchase_days(bindings.events(spark, SF), bought=F.col("event_type") == "purchase") if number in (2, 4) else None
        result = contracts.build(number, bindings.web_rows(spark, SF), history)
    assert result.features and set(result.features) <= set(contract.features)
    assert not set(contract.forbidden) & set(result.features)
    gaps = result.frame.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in [*result.features, contract.target]]).first()
    assert all(v == 0 for v in gaps)
    assert contracts.feature_master(result).columns == [*result.features, contract.target]


def test_contract_names_what_is_missing(spark):
    rows = spark.createDataFrame([("u", 1, "Sale")], "user_pseudo_id string, purchases int, sessionCampaign string")
    with pytest.raises(contracts.FeatureGap) as gap:
        contracts.build(1, rows)
    assert "first_item_category_enc" in gap.value.missing


def test_score_at_the_mean_is_not_above_it(spark):
    rows = spark.createDataFrame([(1.0, 1), (2.0, 0), (3.0, 1)], "s double, y int")
    assert [r["l"] for r in index_score.with_label(rows, "s", "l").orderBy("s").collect()] == [1, 1, 0]
    q = index_score.quadrants(rows, "s", "y").first()
    assert (q["good_above"], q["bad_above"], q["good_below"], q["bad_below"], q["n_rows"]) == (1, 0, 1, 0, 3)
    assert index_score.movement(index_score.quadrants(rows, "s", "y")).first()["smaller_class"] == "bad"


def test_pruning_and_blending():
    means = {"a": 0.5, "b": 0.5, "c": 0.1}
    assert index_score.pruned_weights({"a": 1.0, "b": 1.0, "c": 0.5}, means, 35.0) == {"a": 1.0, "b": 1.0, "c": 0.0}
    assert index_score.pruned_weights({"a": 1.0, "b": 0.0, "c": 0.0}, means, 1.0) == {"a": 1.0, "b": 0.0, "c": 0.0}
    assert index_score.blended_weights([{"a": 1.0, "b": 0.0}, {"a": 0.5, "b": 0.0}]) == {"a": pytest.approx(0.825), "b": 0.0}


def test_curve_lookup(spark):
    curve = spark.createDataFrame([(10.0, 1.0), (20.0, 3.0), (30.0, 1.0)], "mean_score double, outcome_rate double")
    wanted = spark.createDataFrame([("up", 2.0, 12.0, True), ("down", 2.0, 26.0, False), ("far", 9.0, 12.0, True)], "goal string, wanted_outcome double, current_score double, score_up boolean")
    assert {r["goal"]: r["score"] for r in index_score.curve_scores(curve, wanted).collect()} == {"up": 15.0, "down": 25.0, "far": 20.0}


def test_flat_line_and_targets(spark):
    line = index_score.outcome_line(spark.createDataFrame([(5.0, 1.0), (5.0, 3.0)], "s double, y double"), "s", "y")
    row = line.first()
    assert (row["slope"], row["intercept"], row["current_outcome"]) == (0.0, 2.0, 2.0)
    assert index_score.improvement_targets(line, index_score.Goal(10)).first()["immediate_score"] == 5.0


def test_auc_with_ties(spark):
    rows = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1)], "y int, p double")
    assert evaluation.auc(rows, "y", "p").first()[0] == pytest.approx(0.625)
    assert evaluation.auc(rows.where("y = 1"), "y", "p").first()[0] == 0.0


def test_threshold_is_inclusive(spark):
    rows = spark.createDataFrame([(1, 0.5), (0, 0.499)], "y int, p double")
    at = evaluation.threshold_search(rows, "y", "p").where("threshold = 0.5").first()
    assert (at["tp"], at["fp"], at["tn"], at["fn"]) == (1, 0, 1, 0)


def test_path_rules(spark):
    c = attribution.Condition
    ways = [attribution.Path(0, (c("a", "<=", 5.0), c("a", "<=", 3.0), c("a", ">", 1.0), c("t_x", ">", 0.5)), 3.0, 5),
            attribution.Path(1, (c("a", "<=", 1.0), c("a", ">", 2.0)), 99.0, 5), attribution.Path(2, (c("a", "<=", 1.0),), 1.0, 5), attribution.Path(3, (c("a", ">", 1.0),), 9.0, 5)]
    table = attribution.path_table(spark, ways)
    codes = spark.createDataFrame([("t_x", "t", "x")], "feature string, base string, category string")
    bounds = attribution.tightest_bounds(table, codes)
    assert {(r["feature"], r["operator"], r["threshold"], r["category"]) for r in bounds.where("leaf = 0").collect()} == {("a", ">", 1.0, None), ("a", "<=", 3.0, None), ("t", "=", None, "x")}
    assert [tuple(r) for r in attribution.contradictions(bounds).collect()] == [(1, "a", "empty interval")]
    ends = attribution.extreme_leaves(table).first()
    assert (ends["low"], ends["high"], ends["similarity"]) == (2, 3, 0.0)
    scores = {r["leaf"]: r["region_score"] for r in attribution.region_scores(table, 10).collect()}
    assert scores[3] > scores[2] and scores[1] == pytest.approx(99 + 1.0 - 0.15 - 0.4 - 2.0)


def test_streams_match_batch(spark, tmp_path):
    events = bindings.events(spark, SF)
    folder, marks = str(tmp_path / "in"), str(tmp_path / "marks")
    events.write.parquet(folder)
    stream = spark.readStream.schema(events.schema).parquet(folder)
    for name, plan in (("days", rollups.item_day_totals), ("visits", rollups.user_sessions)):
        run = plan(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{marks}/{name}").trigger(availableNow=True).start()
        run.awaitTermination(120)
        closed = spark.table(name)
        # What the watermark has closed equals the batch result; the last windows are still open.
        assert closed.count() > 0 and closed.exceptAll(plan(events)).count() == 0


def test_correlations_do_not_depend_on_the_number_of_columns(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=200)
    data = {"a": 1 + base * 1e-9, "b": base + rng.normal(size=200), "same": np.full(200, 0.1)} | {f"x{i}": rng.normal(size=200) for i in range(30)}
    wide = spark.createDataFrame([tuple(float(v[i]) for v in data.values()) for i in range(200)], ", ".join(f"{c} double" for c in data))
    few = {(r["left"], r["right"]): r["corr"] for r in selection.correlation_pairs(wide, ["a", "b", "same"]).collect()}
    many = {(r["left"], r["right"]): r["corr"] for r in selection.correlation_pairs(wide, list(data)).collect()}
    assert few[("a", "b")] == pytest.approx(np.corrcoef(data["a"], data["b"])[0, 1], abs=1e-5) and few[("a", "same")] is None
    assert all(many[k] == pytest.approx(v) for k, v in few.items() if v is not None) and many[("b", "same")] is None


def test_models_compute_their_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def passing(x):
        seen.add(1)
        return x

    def rows():
        seen.value = 0
        x = F.col("id").cast("double")
        made = spark.range(120).select(F.col("id").cast("string").alias("k"), x.alias("a"), (x % 7).alias("b"), (F.col("id") % 3 == 0).cast("int").alias("bought"))
        return made.withColumn("a", passing.asNondeterministic()("a"))

    report, fitted = models.compare_classifiers(rows(), "bought", ["a", "b"], ["k"], names=["logistic_balanced"])
    assert [r["model"] for r in report.collect()] == list(fitted) == ["logistic_balanced"] and seen.value == 120
    scored, _ = models.safe_logistic(rows(), "bought", ["a", "b"], ["k"])
    assert scored.count() == 24 and seen.value == 120
