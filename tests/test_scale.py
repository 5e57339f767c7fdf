"""Exactness of the building blocks under heavy keys, heavy values and gaps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaymart.operators import scale


@pytest.fixture(scope="module")
def skewed(spark):
    """60,000 rows; a third belong to key 0 and a third of all values are equal."""
    base = spark.range(60_000, numPartitions=6)
    return base.select(
        F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).cast("bigint").alias("k"),
        F.when(F.col("id") % 3 == 1, F.lit(7.0)).otherwise(F.pmod(F.xxhash64("id"), F.lit(100_000)) / 10.0).alias("v")).cache()


def test_global_quantiles(skewed):
    pdf = skewed.toPandas()
    probs = {"a": 0.01, "b": 0.25, "c": 0.5, "d": 0.95}
    got = scale.exact_quantiles(skewed, "v", probs).first()
    for name, p in probs.items():
        assert got[name] == pytest.approx(np.quantile(pdf["v"], p), abs=1e-9)


@pytest.mark.parametrize("kept", [0, 20_000, 10**9])
def test_quantiles_do_not_depend_on_what_is_kept(spark, monkeypatch, kept):
    monkeypatch.setattr(scale, "SMALL_GROUP", kept)
    values = np.concatenate([np.random.default_rng(1).lognormal(0, 3, 70_000), np.full(30_000, 7.0)])
    frame = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = scale.exact_quantiles(frame, "v", {"a": 0.001, "b": 0.5, "c": 0.9, "d": 0.9999}).first()
    assert list(got) == pytest.approx(list(np.quantile(values, [0.001, 0.5, 0.9, 0.9999])), rel=1e-12)


def test_grouped_quantiles_with_a_heavy_group(skewed, monkeypatch):
    monkeypatch.setattr(scale, "SMALL_GROUP", 500)
    pdf = skewed.toPandas()
    want = pdf.groupby("k")["v"].quantile(0.9)
    got = {r["k"]: r["q"] for r in scale.exact_quantiles(skewed, "v", {"q": 0.9}, ["k"]).collect()}
    assert got == pytest.approx(want.to_dict(), abs=1e-9)


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([], "v double")
    assert scale.exact_quantiles(empty, "v", {"q": 0.5}).first()["q"] is None
    nulls = spark.createDataFrame([(None,), (float("nan"),)], "v double")
    assert scale.exact_quantiles(nulls, "v", {"q": 0.5}).first()["q"] is None
    assert scale.exact_quantiles(spark.createDataFrame([(3.0,)], "v double"), "v", {"q": 0.9}).first()["q"] == 3.0


@pytest.mark.parametrize("n", [2, 3, 7, 10, 101])
def test_small_quantiles(spark, n):
    values = [float((i * 37) % 11) for i in range(n)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    got = scale.exact_quantiles(frame, "v", {"a": 0.1, "b": 0.5, "c": 0.9}).first()
    assert list(got) == pytest.approx(list(np.quantile(values, [0.1, 0.5, 0.9])))


def test_column_quantiles(skewed):
    pdf = skewed.toPandas()
    got = {r["column"]: r["m"] for r in scale.column_quantiles(skewed, ["v", "k", "id"], {"m": 0.5}).collect()}
    assert got == pytest.approx({c: float(np.median(pdf[c])) for c in ("v", "k", "id")})


def test_row_numbers_are_dense_and_ordered(skewed):
    out = scale.numbered(skewed, ["v", "id"]).toPandas().sort_values("row_no")
    assert out["row_no"].tolist() == list(range(1, 60_001))
    want = skewed.toPandas().sort_values(["v", "id"])
    assert out["id"].tolist() == want["id"].tolist()


def test_row_numbers_per_key(skewed):
    out = scale.numbered(skewed, ["v", "id"], by=["k"]).toPandas()
    want = skewed.toPandas().sort_values(["k", "v", "id"])
    want["row_no"] = want.groupby("k").cumcount() + 1
    both = out.merge(want, on="id")
    assert len(both) == 60_000 and (both["row_no_x"] == both["row_no_y"]).all()


def _largest_range(spark, monkeypatch, rows, order):
    """Share of the rows in the largest range, with 8 ranges."""
    seen = []
    plain = scale.written
    monkeypatch.setattr(scale, "written", lambda df: seen.append(plain(df)) or seen[-1])
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbers = sorted(r[0] for r in scale.numbered(rows, order).select("row_no").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert numbers == list(range(1, len(numbers) + 1))
    return seen[0].groupBy("_part").count().agg(F.max("count")).first()[0] / len(numbers)


def test_equal_rows_spread_over_ranges(spark, monkeypatch):
    same = spark.range(8000, numPartitions=5).select(F.lit(1.0).alias("v"))
    assert _largest_range(spark, monkeypatch, same, ["v"]) < 0.3


def test_texts_with_a_common_beginning_spread_over_ranges(spark, monkeypatch):
    names = spark.range(8000, numPartitions=5).select(F.format_string("Customer#%09d", F.col("id")).alias("t"))
    assert _largest_range(spark, monkeypatch, names, ["t"]) < 0.3


def test_coarse_columns_spread_over_ranges(spark, monkeypatch):
    coarse = spark.range(8000, numPartitions=5).select((F.col("id") % 3).alias("a"), (F.col("id") % 5).alias("b"), (F.col("id") % 2).alias("c"))
    assert _largest_range(spark, monkeypatch, coarse, ["a", "b", "c"]) < 0.3


def test_numbers_over_text_and_nulls(spark):
    rows = [(None,), ("b",), ("abcdefgh",), ("abcdefgz",), ("",), ("é",), ("z",)]
    out = scale.numbered(spark.createDataFrame(rows, "t string"), ["t"]).orderBy("row_no").collect()
    assert [r["t"] for r in out] == [None, "", "abcdefgh", "abcdefgz", "b", "z", "é"]


def test_prefix_sums(skewed):
    run = scale.prefix_sums(skewed, ["v", "id"], {"run": F.col("k")}).toPandas().sort_values(["v", "id"])
    assert run["run"].tolist() == run["k"].cumsum().tolist()


def test_group_stats_reach_every_row(spark, skewed):
    rows = skewed.unionByName(spark.createDataFrame([(-1, None, 1.0)], "id long, k long, v double"))
    stats = rows.groupBy("k").agg(F.count("*").alias("w"), F.avg("v").alias("m"))
    out = scale.attach_group_stats(rows, stats, ["k"], "w", heavy_share=0.05).toPandas()
    assert len(out) == 60_001
    pdf = skewed.toPandas()
    want = pdf["k"].map(pdf.groupby("k")["v"].mean())
    got = out[out["id"] >= 0].sort_values("id")["m"].to_numpy()
    assert got == pytest.approx(want.to_numpy())
    assert out[out["id"] == -1]["m"].isna().all()


def test_no_row_level_shuffle_of_the_heavy_keys(skewed):
    """Rows of heavy keys are spread: no partition of the second join holds them all."""
    stats = skewed.groupBy("k").agg(F.count("*").alias("w"), F.max("v").alias("m"))
    plan = scale.attach_group_stats(skewed, stats, ["k"], "w", heavy_share=0.05)._jdf.queryExecution().optimizedPlan().toString()
    assert "_spread" in plan


def test_spread_of_the_largest_hashes(spark):
    """The hash of this row is the largest int but one, so that any later partition number takes the sum out of range."""
    rows = spark.range(0, 8, numPartitions=8).select(F.lit("k").alias("k"), F.lit(139504142).cast("bigint").alias("v"))
    assert rows.select(F.hash("k", "v")).first()[0] == 2 ** 31 - 2
    stats = rows.groupBy("k").agg(F.count("*").alias("w"), F.max("v").alias("m"))
    assert [r["m"] for r in scale.attach_group_stats(rows, stats, ["k"], "w").collect()] == [139504142] * 8


def test_scratch_folder_needs_a_shared_place_on_a_cluster(spark):
    from types import SimpleNamespace

    from quaymart.session import scratch_folder

    unset = SimpleNamespace(get=lambda key, default: None)
    assert scratch_folder(SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="local[4]"))).endswith("/data")
    with pytest.raises(ValueError):
        scratch_folder(SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="spark://host:7077")))
    named = SimpleNamespace(get=lambda key, default: "hdfs://x/shared/")
    assert scratch_folder(SimpleNamespace(conf=named, sparkContext=None)).startswith("hdfs://x/shared/quaymart-")
