"""Numbering by ranges, correlations side by side and bins by place, against windows and joins."""

import numpy as np
from conftest import SMALL
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark import catalogue, series
from tidemark.operators import causal, statistics
from tidemark.operators.spread import row_numbers


def test_row_numbers_equal_a_window(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 10 < 9, "a").when(F.col("id") % 100 < 99, "b").alias("k"), F.pmod(F.xxhash64("id"), F.lit(700)).alias("v"), "id")
    got = row_numbers(rows.withColumn("i", F.col("id")), ["k"], ["v", "i"], "at")
    want = rows.withColumn("at", F.row_number().over(Window.partitionBy("k").orderBy("v", "id")) - 1)
    assert {(r.k, r.id, r["at"]) for r in got.collect()} == {(r.k, r.id, r["at"]) for r in want.collect()}
    assert row_numbers(rows.filter("id < 0").withColumn("i", F.col("id")), ["k"], ["v", "i"]).count() == 0


def test_measures_are_numbered_by_ranges_as_by_a_window(spark):
    li = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    keys = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    want = series.ordered(li, F.col("l_returnflag"), keys, q=F.col("l_quantity").cast("double"), tax=F.col("l_tax").cast("double"))
    got = series.ordered_by_ranges(li, F.col("l_returnflag"), keys, q=F.col("l_quantity").cast("double"), tax=F.col("l_tax").cast("double"))
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = catalogue._measures(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan


def test_wide_correlations_equal_the_join(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [("s", i, f, None if rng.random() < 0.2 else float(rng.normal())) for i in range(200) for f in ("a", "b", "c") if rng.random() < 0.8]
    long = spark.createDataFrame([*rows, ("s", 999, "d", 1.0)], "series_id string, seq long, feature string, value double")
    got = sorted((r.feature_a, r.feature_b, r.n, round(r.r, 9)) for r in statistics.pair_correlations(long).collect())
    monkeypatch.setattr(statistics, "WIDE", 1)
    assert got == sorted((r.feature_a, r.feature_b, r.n, round(r.r, 9)) for r in statistics.pair_correlations(long).collect())


def test_binned_information_deals_bins_as_ntile(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 9, 203)
    long = spark.createDataFrame([("s", i, "a", float(v)) for i, v in enumerate(x)], "series_id string, seq long, feature string, value double")
    target = spark.createDataFrame([("s", i, float(v + rng.integers(0, 4))) for i, v in enumerate(x)], "series_id string, seq long, target double")
    place = lambda c: F.ntile(16).over(Window.orderBy(c, "series_id", "seq"))
    cells = long.join(target, ["series_id", "seq"]).withColumns({"bx": place("value"), "by": place("target")}).groupBy("bx", "by").count().toPandas()
    n, k = 203, cells["count"]
    bx, by = k.groupby(cells.bx).transform("sum"), k.groupby(cells.by).transform("sum")
    want = float((k / n * np.log(k * n / (bx * by))).sum())
    assert abs(causal.binned_information(long, target).first().information - want) < 1e-12
