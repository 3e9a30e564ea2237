"""Pairs of near points by blocks: equal to comparing all, with as many rows sent as points, not cells."""

import numpy as np
import pytest

from tidemark.operators import neighbours


@pytest.mark.parametrize("axes", [1, 2, 3, 4])
def test_pairs_within_against_all_pairs(axes):
    rng = np.random.default_rng(axes)
    for points, r in ((rng.normal(size=(130, axes)), 0.7), (rng.integers(0, 12, (130, axes)) / 10, 0.3), (np.arange(40.0)[:, None].repeat(axes, 1) / 10, 0.3)):
        points = np.unique(points, axis=0)
        w = rng.integers(1, 4, len(points))
        near = (np.abs(points[:, None] - points[None]) <= r).all(2)
        assert neighbours.pairs_within(points, w, r) == int(np.triu(near * np.outer(w, w), 1).sum())
    assert neighbours.pairs_within(points[:1], w[:1], r) == 0
