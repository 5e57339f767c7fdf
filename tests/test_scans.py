"""Scans, neighbours in order, selection by counting, neighbour information, descent and clusters against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaymart.operators import clusters, forecasting, information, labels, penalised, sampling, scans, selection
from quaymart.sources import readers


def series(seed, groups=("hot", "cold", None), n=400):
    rng = random.Random(seed)
    return [(rng.choices(groups, [8, 1, 1])[0], rng.choice([None, *range(60)]), rng.choice([None, rng.randrange(-50, 50)]), i) for i in range(n)]


@pytest.mark.parametrize("descending", [False, True])
def test_scans_are_those_of_one_window(spark, descending):
    frame = spark.createDataFrame(series(1), "g string, at int, v int, i int").repartition(7)
    kinds = {"total": ("sum", F.col("v")), "top": ("max", F.col("v")), "low": ("min", F.col("v")), "known": ("last", F.col("v"))}
    got = scans.scanned(frame, ["at", "i"], kinds, ["g"], descending).collect()
    assert len(got) == 400
    for g in ("hot", "cold", None):
        order = lambda r: (r["at"] is not None, r["at"] or 0, r["i"] if r["i"] is not None else -1)
        rows = sorted((r for r in got if r["g"] == g), key=order, reverse=descending)
        seen = []
        for r in rows:
            seen += [r["v"]] if r["v"] is not None else []
            want = (sum(seen), max(seen), min(seen), seen[-1]) if seen else (None,) * 4
            assert (r["total"], r["top"], r["low"], r["known"]) == want


def test_unknown_combiner_is_refused(spark):
    with pytest.raises(ValueError, match="median"):
        scans.scanned(spark.range(3), ["id"], {"m": ("median", F.col("id"))})


def test_filled_takes_the_last_then_the_first_value(spark):
    rows = [("a", d, None if d % 5 else float(d)) for d in range(3, 40)] + [("b", 1, None), ("b", 2, None), ("c", 7, 1.5), ("c", 9, None)]
    frame = spark.createDataFrame(rows, "sku_id string, ds int, y double").repartition(5)
    got = {(r["sku_id"], r["ds"]): r["y"] for r in scans.filled(frame).collect()}
    assert got[("a", 3)] == got[("a", 4)] == 5.0 and got[("a", 39)] == 35.0 and got[("a", 10)] == 10.0
    assert got[("b", 1)] is None and got[("c", 9)] == 1.5 and len(got) == len(rows)
    assert scans.filled(frame.limit(0)).count() == 0


@pytest.mark.parametrize("k", [1, 3, 50])
def test_neighbours_across_ranges(spark, k):
    rng = random.Random(k)
    rows = [(rng.choice("ab"), rng.randrange(1000), i) for i in range(300)]
    frame = spark.createDataFrame(rows, "g string, x int, i int").repartition(6)
    got = scans.around(frame, ["x", "i"], F.struct("x", "i"), k, ["g"]).collect()
    for g in "ab":
        order = sorted((x, i) for h, x, i in rows if h == g)
        for r in (r for r in got if r["g"] == g):
            at = order.index((r["x"], r["i"]))
            assert [tuple(v) for v in r["before"]] == order[max(0, at - k):at][::-1]
            assert [tuple(v) for v in r["after"]] == order[at + 1:at + 1 + k]


def test_smallest_tickets_with_ties(spark):
    rng = random.Random(4)
    rows = [(rng.choice("xy"), rng.choice([-(1 << 63), (1 << 63) - 1, 0, -1, 5, 6, 7, *[rng.getrandbits(63) - (1 << 62) for _ in range(9)]]), i) for i in range(500)]
    frame = spark.createDataFrame(rows, "g string, t long, i int").repartition(4)
    size = Counter(g for g, _, _ in rows)
    wanted = spark.createDataFrame([("x", size["x"], 0, 100), ("y", size["y"], 37, size["y"])], "g string, size long, few long, many long")
    got = scans.with_ranks_below(frame, F.col("t"), ["i"], wanted, ["few", "many"], ["g"]).collect()
    assert len(got) == 500
    for g, few, many in (("x", 0, 100), ("y", 37, size["y"])):
        order = sorted((t, i) for h, t, i in rows if h == g)
        assert {(r["t"], r["i"]) for r in got if r["g"] == g and r["_below_few"]} == set(order[:few])
        assert {(r["t"], r["i"]) for r in got if r["g"] == g and r["_below_many"]} == set(order[:many])


def test_selection_needs_no_order(spark):
    frame = spark.range(2000).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"))
    split = sampling.stratified_split(frame, "y", ["id"])
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" not in plan and "Window" not in plan and plan.count("RepartitionByExpression") == 0
    assert {(r["y"], r["part"]): r["count"] for r in split.groupBy("y", "part").count().collect()} == {(0, 0): 1050, (0, 1): 150, (0, 2): 300, (1, 0): 350, (1, 1): 50, (1, 2): 100}
    again = {r["id"] for r in sampling.stratified_split(frame.repartition(9), "y", ["id"]).where("part = 1").collect()}
    assert again == {r["id"] for r in split.where("part = 1").collect()}


def test_splits_of_equal_keys_and_odd_classes(spark):
    frame = spark.createDataFrame([(1, "a")] * 30 + [(2, "b")] + [(3, None)] * 10, "id int, y string")
    counts = {(r["y"], r["part"]): r["count"] for r in sampling.stratified_split(frame, "y", ["id"]).groupBy("y", "part").count().collect()}
    assert counts == {("a", 0): 21, ("a", 1): 3, ("a", 2): 6, ("b", 0): 1, (None, 0): 7, (None, 1): 1, (None, 2): 2}
    assert sampling.stratified_split(frame.limit(0), "y", ["id"]).count() == 0
    assert sampling.undersampled(frame, "y", ["id"], ratio=1).groupBy("y").count().where("y = 'a'").first()["count"] == 11


def psi(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def plain_information(rows, k):
    x, c = np.array([r[0] for r in rows]), [r[1] for r in rows]
    size = Counter(c)
    keep = [i for i in range(len(x)) if size[c[i]] > 1]
    ks, ms, cs = [], [], []
    for i in keep:
        own = sorted(abs(x[i] - x[j]) for j in keep if j != i and c[j] == c[i])
        near = min(k, len(own))
        r = own[near - 1]
        ks.append(near)
        cs.append(size[c[i]])
        ms.append(sum(x[j] == x[i] if r == 0 else x[i] - r < x[j] < x[i] + r for j in keep))
    mean = lambda v: sum(psi(n) for n in v) / len(v)
    return max(0.0, psi(len(keep)) + mean(ks) - mean(cs) - mean(ms))


def test_neighbour_information_is_that_of_brute_force(spark):
    rng = np.random.default_rng(5)
    y = rng.choice(["a", "b", "c"], 240, p=[0.6, 0.3, 0.1])
    shift = {"a": 0.0, "b": 1.5, "c": 3.0}
    rows = [(float(rng.normal() + shift[v]), float(rng.integers(0, 4)), float(rng.normal()), str(v)) for v in y] + [(1.0, 2.0, 3.0, "alone"), (None, None, float("nan"), "a"), (1.0, 1.0, 1.0, None)]
    frame = spark.createDataFrame(rows, "near double, few double, noise double, y string").repartition(5)
    got = {r["feature"]: r["mutual_information"] for r in information.neighbour_information(frame, "y", ["near", "few", "noise"]).collect()}
    for place, name in enumerate(("near", "few", "noise")):
        real = [(r[place], r[3]) for r in rows if r[3] is not None and r[place] is not None and not math.isnan(r[place])]
        assert got[name] == pytest.approx(plain_information(real, 3), abs=1e-6)
    assert got["near"] > got["noise"] + 0.2


def test_digamma(spark):
    got = spark.createDataFrame([(float(n),) for n in (1, 2, 3, 9, 10, 11, 1000)], "n double").select(information.digamma(F.col("n"))).collect()
    assert [r[0] for r in got] == pytest.approx([psi(n) for n in (1, 2, 3, 9, 10, 11, 1000)], abs=1e-10)


@pytest.mark.parametrize("penalty", [0.2, 0.01, 0.0])
def test_descent_meets_the_optimality_conditions(spark, penalty):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 4)) * [1, 5, 0.3, 2]
    x[:, 3] = x[:, 0] * 0.9 + x[:, 3] * 0.1
    y = x @ [0.8, -0.3, 0.0, 0.2] + rng.normal(size=300) * 0.1
    frame = spark.createDataFrame([(*map(float, r), 2.0, float(t)) for r, t in zip(x, y)] + [(None, 1.0, 1.0, 1.0, 2.0, 1.0)], "a double, b double, c double, d double, same double, y double")
    names = ["a", "b", "c", "d", "same"]
    m = penalised.moments(frame, "y", names)
    w = penalised.descend(m, penalty)
    assert m.rows == 300 and penalised.slack(m, w, penalty) < 1e-9 and w[4] == 0
    if penalty == 0:
        centred = x - x.mean(axis=0)
        assert w[:4] == pytest.approx(np.linalg.lstsq(centred, y - y.mean(), rcond=None)[0], abs=1e-8)


def test_clusters_are_the_best_cuts(spark):
    rng = np.random.default_rng(7)
    values = np.concatenate([rng.normal(m, 0.4, 12) for m in (0, 4, 9)])
    count, total, square = np.ones(36), np.sort(values), np.sort(values) ** 2

    def loss(cuts):
        return sum(((part - part.mean()) ** 2).sum() for part in np.split(np.sort(values), cuts))

    best = min(loss([i, j]) for i in range(1, 35) for j in range(i + 1, 36))
    assert loss(clusters.best_cuts(count, total, square, 3)) == pytest.approx(best)
    frame = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
    got = clusters.clustered(frame, "v", 3).groupBy("cluster").agg(F.count("*").alias("n"), F.max("v").alias("top")).orderBy("cluster").collect()
    assert [r["n"] for r in got] == [12, 12, 12]
    equal = spark.createDataFrame([(2.0,)] * 5, "v double")
    assert {r["cluster"] for r in clusters.clustered(equal, "v", 3).collect()} == {0}
    assert clusters.clustered(frame.limit(0), "v").count() == 0


def test_autocorrelation_by_transform(spark):
    rng = np.random.default_rng(8)
    wave = np.sin(np.arange(90) * 2 * np.pi / 7) + rng.normal(size=90) * 0.2
    rows = [("wave", i, float(v)) for i, v in enumerate(wave)] + [("same", i, 3.0) for i in range(30)] + [("short", i, float(i % 2)) for i in range(10)]
    frame = spark.createDataFrame(rows, "sku_id string, i int, y double").select("sku_id", F.date_add(F.lit("2024-01-01").cast("date"), F.col("i")).alias("ds"), "y")
    got = {(r["sku_id"], r["lag"]): r["acf"] for r in forecasting.autocorrelations(frame, 20).collect()}
    d = wave - wave.mean()
    for lag in range(1, 21):
        assert got[("wave", lag)] == pytest.approx((d[:-lag] * d[lag:]).sum() / (d * d).sum(), abs=1e-9)
    assert {k: v for k, v in got.items() if k[0] == "same"} == {("same", k): None for k in range(1, 16)} and max(k for s, k in got if s == "short") == 5
    assert {r["sku_id"]: r["seasonal_peak"] for r in forecasting.seasonal_peaks(frame).collect()} == {"wave": 1, "same": 0, "short": 0}


def test_encodings_are_told_apart_line_by_line(spark, tmp_path):
    path = tmp_path / "mixed.csv"
    path.write_bytes(b"\xef\xbb\xbfid;n\xc3\xa4me\n" + "1;café ’x\n".encode() + "2;café ’x\n".encode("cp1252") + b"3;caf\xe9 \x81\n4;plain\n")
    rows = {r["id"]: r["näme"] for r in readers.csv(spark, str(path)).collect()}
    assert rows == {"1": "café ’x", "2": "café ’x", "3": "café \x81", "4": "plain"}


def test_undated_items_take_one_row_each(spark):
    schema = "item_id string, day date, item_category string, views long, carts long, purchases long, revenue double, revenue_cents long"
    frame = spark.createDataFrame([("a", None, "c", 4, 2, 1, 10.0, 1000), ("a", None, "c", 1, 0, 0, 0.0, 0), ("b", None, "c", 2, 1, 1, 3.0, 300)], schema)
    out, source = labels.item_demand(frame)
    assert source == "proxy" and out.count() == 2


def test_correlations_of_many_pairs(spark, monkeypatch):
    rng = np.random.default_rng(9)
    data = rng.normal(size=(100, 5))
    frame = spark.createDataFrame([tuple(None if rng.random() < 0.1 else float(v) for v in r) for r in data], "a double, b double, c double, d double, e double")
    one = selection.correlation_pairs(frame, list("abcde")).collect()
    monkeypatch.setattr(selection, "PAIRS_AT_ONCE", 3)
    assert sorted(one) == sorted(selection.correlation_pairs(frame, list("abcde")).collect()) and len(one) == 10
    assert selection.correlation_pairs(frame, ["a"]).count() == 0


def test_streamed_sessions_hold_every_event_once(spark, tmp_path):
    import datetime as dt

    from quaymart.streaming import sessions

    def event(user, minute, kind="view", cents=0):
        return (user, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute), kind, cents)

    schema = "user_pseudo_id string, ts timestamp, event_type string, cents long"
    batches = [[event("a", 0), event("a", 10), event("b", 5, "purchase", 700), event("a", 100)], [event("a", 125, "click"), event("b", 300)], [],
               [event("a", 20), event("b", 320), event("b", 320), (None, None, "view", 1)]]
    tables = sessions.SessionTables(str(tmp_path / "s"))
    for number, rows in enumerate(batches):
        for _ in range(2):   # a batch that runs again changes nothing
            tables.fold(spark.createDataFrame(rows, schema), number)
    start = dt.datetime(2024, 1, 1)
    got = sorted((r["user_pseudo_id"], (r["first"] - start).seconds // 60, (r["last"] - start).seconds // 60, r["events"], r["purchases"], r["revenue_cents"], r["late"])
                 for r in tables.sessions(spark, 3).collect())
    # The event at minute 20 comes when its session is closed, so it is one of its own and marked.
    assert got == [("a", 0, 10, 2, 0, 0, 0), ("a", 20, 20, 1, 0, 0, 1), ("a", 100, 125, 2, 0, 0, 0), ("b", 5, 5, 1, 1, 700, 0), ("b", 300, 320, 3, 0, 0, 0)]
    assert tables.sessions(spark, None).count() == 0
