"""Shapley values of trees against sums over all subsets, and their sum against the forest's predictions."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from tidemark.operators import attributions

NAMES = ["a", "b", "c"]


def plain_value(found, x, known):
    """The forest's value when only ``known`` features are: other splits send a row both ways, by their shares."""
    total = 0.0
    for leaf in found:
        w = 1.0
        for (f, at, below), share in zip(leaf.splits, leaf.shares, strict=True):
            w *= float((x[f] <= at) == below) if f in known else share
        total += w * leaf.value
    return total / len({leaf.tree for leaf in found})


def test_attributions_equal_sums_over_subsets_and_add_to_the_prediction(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (400, 3)).round(1)
    y = np.where(x[:, 0] > 0, x[:, 1], -x[:, 1]) + 0.1 * rng.normal(size=400)
    rows = spark.createDataFrame([("s", i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "series_id string, seq long, a double, b double, c double, target double")
    data = VectorAssembler(inputCols=NAMES, outputCol="x").transform(rows)
    model = RandomForestRegressor(featuresCol="x", labelCol="target", numTrees=4, maxDepth=4, seed=1).fit(data)
    found = attributions.with_shares(rows, NAMES, attributions.leaves(model.toDebugString))
    assert len({leaf.tree for leaf in found}) == 4 and max(len(leaf.splits) for leaf in found) == 4
    assert sum(1 for t in range(4) if abs(sum(np.prod(leaf.shares) for leaf in found if leaf.tree == t) - 1) < 1e-12) == 4
    predicted = {r.seq: r.prediction for r in model.transform(data).select("seq", "prediction").collect()}
    made = {r.seq: r for r in attributions.attributions(rows, NAMES, found).collect()}
    for i in range(400):
        assert made[i].base + sum(made[i][n] for n in NAMES) == pytest.approx(predicted[i], abs=1e-9)
    for i in range(0, 400, 40):
        for j, n in enumerate(NAMES):
            want = 0.0
            for size in range(3):
                for s in combinations([k for k in range(3) if k != j], size):
                    want += factorial(size) * factorial(2 - size) / 6 * (plain_value(found, x[i], {*s, j}) - plain_value(found, x[i], set(s)))
            assert made[i][n] == pytest.approx(want, abs=1e-9)


def test_importance_finds_what_the_target_follows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (500, 3))
    long = spark.createDataFrame([("s", i, n, float(v)) for j, n in enumerate(NAMES) for i, v in enumerate(x[:, j])], "series_id string, seq long, feature string, value double")
    target = spark.createDataFrame([("s", i, float(3 * r[1] + r[2])) for i, r in enumerate(x)], "series_id string, seq long, target double")
    got = {r.feature: r.importance for r in attributions.shapley_importance(long, target, NAMES, trees=5).collect()}
    assert got["b"] > 1.5 * got["c"] > 3 * got["a"]


def test_a_forest_of_one_leaf(spark):
    rows = spark.createDataFrame([("s", i, 1.0, 2.0) for i in range(5)], "series_id string, seq long, a double, b double")
    only = attributions.leaves("RandomForest\n  Tree 0 (weight 1.0):\n    Predict: 7.5\n")
    assert [(r.base, r.a) for r in attributions.attributions(rows, ["a", "b"], attributions.with_shares(rows, ["a", "b"], only)).collect()] == [(7.5, 0.0)] * 5
