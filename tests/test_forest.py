"""The forest for many rows against brute force, Spark's forest and planted effects."""

import datetime as dt
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor

from quaymart.operators import forest, predictors

BRANDS, SUPPLIERS = ("a", "b", "c"), (1, 2, 3, 4)


def test_cuts_are_between_few_values_and_at_even_ranks_of_many():
    assert forest.cuts(np.array([0.0, 1.0, 5.0]), np.array([9.0, 1.0, 1.0])).tolist() == [0.5, 3.0]
    assert forest.cuts(np.array([2.0]), np.array([3.0])).tolist() == []
    found = forest.cuts(np.arange(3200.0), np.ones(3200))
    assert len(found) == forest.BINS - 1 and abs(found - 100 * np.arange(1, 32)).max() <= 1


def test_merged_values_keep_counts_and_ranks():
    values, counts = forest._merged(np.array([3.0, 1.0, 3.0]), np.array([1.0, 2.0, 4.0]))
    assert values.tolist() == [1.0, 3.0] and counts.tolist() == [2.0, 5.0]
    values, counts = forest._merged(np.arange(50_000.0), np.ones(50_000))
    assert len(values) <= forest.POINTS and abs(counts.sum() - 50_000) < 1e-3
    assert abs(np.interp(25_000, np.cumsum(counts), values) - 25_000) < 50


def test_weights_have_the_shares_of_a_poisson_distribution():
    shares = np.bincount(forest.WEIGHTS) / 65536
    assert abs(shares[:4] - np.exp(-1) / np.array([1, 1, 2, 6])).max() < 2e-5 and abs((shares * np.arange(len(shares))).sum() - 1) < 2e-4


@pytest.mark.parametrize("level", [0, 1])
def test_sums_and_splits_are_those_of_brute_force(level):
    rng, n = np.random.default_rng(5), 400
    bins, label = rng.integers(0, 6, (3, n)).astype(np.uint8), rng.normal(size=n)
    label += 2.0 * (bins[1] > 2) + 3.0 * (bins[0] > 4)
    block = {"part": 3, "block": 1, "bins": bins.tobytes(), "label": label.tobytes()}
    feature, cut = np.full((1, 7), -1), np.zeros((1, 7), np.uint8)
    feature[0, 0], cut[0, 0] = 1, 2
    tried = np.array([[0, 0, 2, 1]] if level == 0 else [[1, 2, -1, 0]])   # of level 1 the left node is a leaf
    sums = [np.zeros((3, 2, forest.BINS))]
    forest._sums(block, 42, feature, cut, [tried], level, sums)
    weight = forest.WEIGHTS[np.random.Generator(np.random.SFC64([42, 3, 1, 0])).integers(0, 65536, n, np.uint16)].astype(float)
    inside = np.ones(n, bool) if level == 0 else bins[1] > 2
    node, f, at, left_n, left_s, all_n, all_s = forest._best(tried, sums[0], np.array([5, 5, 5]))[0]
    error = lambda m: (weight[m] * (label[m] - np.average(label[m], weights=weight[m])) ** 2).sum()
    errors = {(g, b): error(inside & (bins[g] <= b)) + error(inside & (bins[g] > b)) for g in tried[0, 1:].tolist() if g >= 0 for b in range(5)}
    assert node == tried[0, 0] and (f, at) == min(errors, key=errors.get)
    left = inside & (bins[f] <= at)
    assert np.allclose([left_n, left_s, all_n, all_s], [weight[left].sum(), (weight * label)[left].sum(), weight[inside].sum(), (weight * label)[inside].sum()])


def test_pure_and_tiny_nodes_stay_leaves():
    sums = np.zeros((1, 2, forest.BINS))
    sums[0, 0, 3] = 5.0
    assert forest._best(np.array([[0, 0]]), sums, np.array([4]))[0][1] == -1


def test_forest_is_as_good_as_sparks(spark):
    rng, n = np.random.default_rng(3), 6000
    x = np.column_stack([rng.integers(1, 51, n).astype(float), rng.integers(1, 13, n).astype(float), np.zeros(n), rng.normal(size=n), (rng.random(n) < 0.03).astype(float)])
    y = 100 + x[:, 0] / 2 + 10 * np.sin(x[:, 1]) + 8 * x[:, 3] + 20 * x[:, 4] + rng.normal(size=n)
    names = [f"x{i}" for i in range(5)]
    rows = spark.createDataFrame(pa.table({"y": y, **dict(zip(names, x.T))})).repartition(4).cache()
    own = forest.fit(rows, "y", names, 20, float(y.mean()))
    vectors = VectorAssembler(inputCols=names, outputCol="f").transform(rows)
    model = RandomForestRegressor(labelCol="y", featuresCol="f", predictionCol="p", numTrees=20, maxDepth=6, seed=42).fit(vectors)
    error = lambda found: np.sqrt(np.mean([(r["y"] - r["p"]) ** 2 for r in found.select("y", "p").collect()]))
    mine, theirs = error(own.transform(rows, names, "p")), error(model.transform(vectors))
    assert own.active == [0, 1, 3, 4] and mine < 1.1 * theirs < y.std()
    again = forest.fit(rows, "y", names, 20, float(y.mean()))
    assert (own.feature == again.feature).all() and np.allclose(own.value, again.value)
    assert len(own.feature) == 20 and ((own.feature >= 0).sum(axis=1) > 20).all()
    rows.unpersist()


def sales(spark, missing=True):
    """Lines whose lead time is 2 days a supplier and whose cost is 10 a brand, some without label or key."""
    rows = []
    for i in range(2400):
        brand, supplier = i % 3, i // 3 % 4
        rows.append((BRANDS[brand], SUPPLIERS[supplier], dt.date(2024, 1, 1) + dt.timedelta(i % 300), 1 + i % 7, i % 2, 0.1 * (i % 5), 2 * supplier + 3, 10.0 * brand + 20, 40.0, 0.2, 0))
    if missing:
        rows += [("a", None, dt.date(2024, 1, 1), 1, 0, None, 4, 20.0, 40.0, 0.2, 0), (None, 1, None, None, 1, 0.1, None, None, 40.0, 0.2, 0)]
    return spark.createDataFrame(rows, "sku_id string, supplier_id int, date date, units_sold long, promo_flag int, discount_pct double, lead_time_days int,"
                                       " purchase_cost double, list_price double, margin_pct double, stock_out_flag int")


def refused(**_):
    raise AssertionError("Spark's forest keeps every row with a count for every tree")


def test_unit_costs_of_many_lines_take_the_forest_of_passes(spark, monkeypatch):
    monkeypatch.setattr(predictors, "SPARK_ROWS", 100)
    monkeypatch.setattr(predictors, "RandomForestRegressor", refused)
    folders, plain = [], forest.scratch_folder
    monkeypatch.setattr(forest, "scratch_folder", lambda s: folders.append(plain(s)) or folders[-1])
    found = {(r.sku_id, r.supplier_id): r.predicted_price for r in predictors.unit_cost_predictions(sales(spark)).collect()}
    assert found.keys() == {(b, s) for b in BRANDS for s in SUPPLIERS}
    # A forest shrinks towards the mean; every cost is still nearest to that of its brand.
    assert all(abs(v - 10 * BRANDS.index(b) - 20) < 5 for (b, _), v in found.items()), found
    assert len(folders) == 2 and not any(os.path.exists(f) for f in folders)


def test_lead_times_of_many_lines_take_the_forest_of_passes(spark, monkeypatch):
    monkeypatch.setattr(predictors, "SPARK_ROWS", 100)
    monkeypatch.setattr(predictors, "RandomForestRegressor", refused)
    found = {(r.sku_id, r.supplier_id): r.predicted_lead_time for r in predictors.lead_time_predictions(sales(spark)).collect()}
    assert found.keys() == {(b, s) for b in BRANDS for s in SUPPLIERS}
    # Suppliers need 3, 5, 7 and 9 days; a forest shrinks towards the mean and keeps their order.
    days = [np.mean([found[b, s] for b in BRANDS]) for s in SUPPLIERS]
    assert days == sorted(days) and days[-1] - days[0] > 3, days


def test_learned_orders_of_many_lines_leave_no_rows_of_the_forests_on_disk(spark, monkeypatch):
    from quaymart.plans.order_execution import learned_execution

    monkeypatch.setattr(predictors, "SPARK_ROWS", 100)
    monkeypatch.setattr(predictors, "RandomForestRegressor", refused)
    folders, plain = [], forest.scratch_folder
    monkeypatch.setattr(forest, "scratch_folder", lambda s: folders.append(plain(s)) or folders[-1])
    stock = spark.createDataFrame([(b, 50) for b in BRANDS], "sku_id string, stock_on_hand long")
    rows = learned_execution(sales(spark, missing=False), stock, as_of="2026-01-05").collect()
    assert sorted(r.sku_id for r in rows) == list(BRANDS) and all(r.lead_time_days is not None for r in rows)
    assert len(folders) == 4 and not any(os.path.exists(f) for f in folders)
