"""Queries that don't depend on the order of line items number and join none; ranks and percentiles come from counted values."""

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from tidemark import catalogue, series
from tidemark.operators import attributions, causal, measures, statistics

ORDER_FREE = ("m4_target_correlation", "m10_summary", "m10_dependence", "a28_audit", "a26_describe", "m18_tree_importance", "m18_shapley")


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ORDER_FREE)
def test_no_line_item_is_numbered(spark, monkeypatch, name):
    def refuse(*_, **__):
        raise AssertionError("numbered")

    monkeypatch.setattr(series, "ordered_by_ranges", refuse)
    assert catalogue.queries()[name](spark, SMALL).count() > 0


def test_target_rides_along(spark):
    assert "Join" not in plan(catalogue.queries()["m4_target_correlation"](spark, SMALL))
    long, target = catalogue._explained(spark, SMALL)
    key = lambda df: sorted((r.feature, round(r.r, 9)) for r in df.collect())
    assert statistics.with_target(long, target) is long
    assert key(statistics.correlation_with_target(long)) == key(statistics.correlation_with_target(long.drop("target"), target))


def test_audit_percentiles_are_not_gathered(spark):
    rng = np.random.default_rng(8)
    made = {"a": rng.normal(size=1003), "b": rng.integers(0, 5, 40).astype(float), "one": [3.0], "two": [1.0, float("inf")], "none": []}
    rows = [(k, float(x)) for k, v in made.items() for x in v] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    found = measures.audit_statistics(df, ["k"], "v")
    assert "percentile" not in plan(found)
    got = {r.k: r for r in found.collect()}
    want = {r.k: r for r in df.groupBy("k").agg(F.countDistinct("v").alias("n_distinct"), *(F.expr(f"percentile(v, {p})").alias(f"p{int(p * 100):02d}") for p in (0.05, 0.25, 0.5, 0.75, 0.95))).collect()}
    assert set(got) == set(want) == set(made)
    for k, r in want.items():
        for c in ("n_distinct", "p05", "p25", "p50", "p75", "p95"):
            assert got[k][c] == r[c] or got[k][c] == pytest.approx(r[c], rel=1e-14), (k, c)


def test_rank_effects_join_no_rows(spark):
    rows = [("f", g, v) for g, vs in {"x": [1.0, 2.0, 2.0, 5.0], "y": [2.0, 3.0, None], "z": [9.0]}.items() for v in vs]
    found = statistics.rank_effects(spark.createDataFrame(rows, "feature string, g string, value double"), F.col("g"), "x", "y")
    assert plan(found).count("LeftOuter") == 0
    r = found.first()
    # Of the eight pairs, x is larger in two (5 over 2 and 3) and equal in two.
    assert (r.n1, r.n2, r.u, r.cliffs_delta) == (4, 2, 3.0, 1 - 2 * 3.0 / 8)


def test_forests_take_points_side_by_side(spark):
    rng = np.random.default_rng(9)
    pairs = [(f"{i % 2}", i, float(a), float(b), float(3 * a + b)) for i, (a, b) in enumerate(rng.normal(size=(300, 2)))]
    points = spark.createDataFrame(pairs, "series_id string, seq long, a double, b double, target double")
    for f in (causal.point_tree_importance, attributions.point_shapley_importance):
        got = {r.feature: r.importance for r in f(points, ["a", "b"], trees=5).collect()}
        assert got["a"] > got["b"] > 0
