"""The smaller queries against DuckDB, and alignment and selection on small cases."""

import duckdb
import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from test_core import compared

from tidemark import lesser
from tidemark.functions import scalars as X
from tidemark.operators import alignment
from tidemark.plans import selecting


@pytest.mark.parametrize("name", ["x9_gk_stats", "x11_hurst_adaptive", "x12_adaptive_windows", "x18_uids", "x22_has_feature", "a3_batch", "j2_stacked", "j3_from_tail", "k4_prepared", "t5_arg_extremes"])
def test_query_equals_its_twin(spark, name):
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    mine, theirs = compared(lesser.queries()[name](spark, SMALL).toPandas()), compared(con.execute(lesser.oracle_sql()[name]).df())
    assert list(mine.columns) == list(theirs.columns) and len(mine) == len(theirs)
    for c in mine.columns:
        if mine[c].dtype == object:
            assert mine[c].tolist() == theirs[c].tolist(), c
        else:
            np.testing.assert_allclose(mine[c].to_numpy(float), theirs[c].to_numpy(float), atol=2e-6)


def test_every_oracle_has_a_query():
    assert set(lesser.oracle_sql()) <= set(lesser.queries())


def test_all_bounded_refuses_missing_and_nan(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.5, None), (0.5, float("nan")), (1.5, 0.5)], "a double, b double")
    assert [r[0] for r in df.select(X.all_bounded(F.col("a"), F.col("b"))).collect()] == [True, False, False, False]


def test_alignment_from_the_tail(spark):
    rows = spark.createDataFrame([("a", i, float(i)) for i in range(5)], "series_id string, seq long, nav double")
    labels = spark.createDataFrame([("a", i, f"l{i}") for i in range(3)], "series_id string, seq long, label string")
    got = alignment.joined_from_tail(labels, rows).orderBy("seq").collect()
    assert [(r.seq, r.label) for r in got] == [(2, "l0"), (3, "l1"), (4, "l2")]


def test_subsample_is_the_same_for_any_partitioning(spark):
    df = spark.range(1000)
    one, other = (sorted(r.id for r in alignment.subsample(df.repartition(n), "id", 20).collect()) for n in (1, 7))
    assert one == other and len(one) == 20


def test_stacked_frames_keep_missing_places(spark):
    a = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0)], "series_id string, seq long, value double")
    b = a.filter("seq = 1")
    got = alignment.stacked({"x": a, "y": b}).orderBy("seq").collect()
    assert [(r.x, r.y) for r in got] == [(1.0, None), (2.0, 2.0)]


def test_selection_drops_flat_and_tied_features(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=400)
    made = {"near": x + rng.normal(size=400) * 0.01, "own": x, "noise": rng.normal(size=400), "flat": np.full(400, 0.5)}
    long = spark.createDataFrame([("a", i, f, float(v)) for f, vs in made.items() for i, v in enumerate(vs)], "series_id string, seq long, feature string, value double")
    target = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "series_id string, seq long, target double")
    got = {r.feature: r for r in selecting.select_subset(long, target, 1).collect()}
    assert not got["flat"].variance_kept and got["near"].place == 1 and not got["own"].correlation_kept and got["noise"].place is None
    tied = {r.feature: r.redundant for r in selecting.redundant_features(long.filter("feature <> 'flat'")).collect()}
    assert tied["own"] and not tied["noise"]


def test_bootstrap_query_takes_all_replicates(spark):
    from conftest import SMALL

    from tidemark import catalogue
    from tidemark.operators import resampling, selection

    got = catalogue.queries()["m21_bootstrap"](spark, SMALL)
    want = resampling.bootstrap_importance(catalogue._measures(spark, SMALL).filter("feature <> 'price'"), catalogue._target(spark, SMALL), replicates=100)
    key = lambda df: sorted((r.feature, round(r.mean_importance, 9), round(r.std_importance, 9)) for r in df.collect())
    assert key(got) == key(want) and len(key(got)) == 3
