"""Pairs of many short series: compared together instead of a block at a time."""

import numpy as np

from tidemark.operators import neighbours


def plain(points, w, r, before):
    near = (np.abs(points[:, None] - points[None]) <= r).all(2)
    for b in before:
        near &= ~np.outer(b, b)
    return int(np.triu(near * np.outer(w, w), 1).sum())


def test_groups_against_all_pairs():
    rng = np.random.default_rng(3)
    for axes in (1, 2, 3):
        group = rng.permutation(np.repeat(np.arange(40), rng.integers(1, 30, 40)))
        points, w = rng.integers(0, 12, (len(group), axes)) / 10, rng.integers(1, 4, len(group))
        r = np.array([0.1, 0.3, 0.25])[group % 3]
        before = [rng.random(len(group)) < 0.4 for _ in range(min(axes, 2))]
        want = [plain(points[m], w[m], r[m][0], [b[m] for b in before]) for m in (group == g for g in range(40))]
        assert neighbours.pairs_of_groups(group, points, w, r, before).tolist() == want


def test_series_of_all_lengths(spark):
    rng = np.random.default_rng(4)
    made = {f"s{k}": np.round(rng.exponential(20, (n, 3)), 1) for k, n in enumerate([*rng.integers(1, 40, 60), 1500, 2600])}
    rows = [(k, 6.5, *map(float, p)) for k, v in made.items() for p in v]
    found = neighbours.matching_pairs(spark.createDataFrame(rows, "series_id string, r double, a double, b double, c double"), "series_id", ["a", "b", "c"], "r")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInPandas" in plan
    want = {k: plain(v, np.ones(len(v), int), 6.5, []) for k, v in made.items()}
    assert {x.series_id: x.pairs for x in found.collect()} == {k: n for k, n in want.items() if n}
