"""Shapley values of a forest's predictions, by the paths of its trees (Lundberg and others, 2020).

A leaf's value counts for a subset of features by the shares of rows that follow its path at the splits on the others.
How many rows reach each leaf is counted by Spark; then a leaf with d features on its path has one table of 2**d rows, what
each of them gets for each pattern of conditions that a row meets. A row's attributions are lookups, one a leaf, so rows
are mapped and nothing is shuffled. Trees times leaves bound what is sent to the tasks.
"""

import re
from collections.abc import Iterator
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .causal import beside_target, grown_forest

_LINE = re.compile(r"^( *)(If|Else|Predict:) *(?:\(feature (\d+) (<=|>) (\S+)\)|(\S+))")


class Leaf:
    """A leaf: its tree, value, the splits on its path as (feature, threshold, whether at most), and the rows that reach each split's side."""

    def __init__(self, tree: int, value: float, splits: list[tuple[int, float, bool]]):
        self.tree, self.value, self.splits = tree, value, splits
        self.shares = [1.0] * len(splits)

    def bounds(self) -> dict[int, tuple[float, float]]:
        """The interval (low, high] of each feature on the path."""
        out: dict[int, tuple[float, float]] = {}
        for f, at, below in self.splits:
            low, high = out.get(f, (-np.inf, np.inf))
            out[f] = (low, min(high, at)) if below else (max(low, at), high)
        return out

    def table(self) -> tuple[list[int], np.ndarray, float]:
        """The features of the path, their attributions for each pattern of met conditions, and what the leaf adds to the base."""
        features = list(self.bounds())
        d = len(features)
        z = np.array([np.prod([s for (f, _, _), s in zip(self.splits, self.shares, strict=True) if f == g]) for g in features])
        met = (np.arange(1 << d)[:, None] >> np.arange(d)) & 1
        out = np.zeros((1 << d, d))
        for j in range(d):
            poly = np.zeros((1 << d, d))
            poly[:, 0] = 1.0
            for i in (i for i in range(d) if i != j):
                poly[:, 1:] = poly[:, 1:] * z[i] + poly[:, :-1] * met[:, i : i + 1]
                poly[:, 0] *= z[i]
            weight = np.array([factorial(s) * factorial(d - s - 1) / factorial(d) for s in range(d)])
            out[:, j] = self.value * (met[:, j] - z[j]) * (poly @ weight)
        return features, out, self.value * float(np.prod(z))


def leaves(description: str) -> list[Leaf]:
    """The leaves of all trees of a forest, from its description."""
    out: list[Leaf] = []
    tree, path = -1, []
    for line in description.splitlines():
        if line.strip().startswith("Tree "):
            tree, path = tree + 1, []
        elif m := _LINE.match(line):
            depth = len(m[1]) - 4
            if m[2] == "Predict:":
                out.append(Leaf(max(tree, 0), float(m[6]), [s for _, s in path if _ < depth]))
            else:
                path = [p for p in path if p[0] < depth] + [(depth, (int(m[3]), float(m[5]), m[4] == "<="))]
    return out


def _met(x: np.ndarray, leaf: Leaf) -> np.ndarray:
    """For each row, the pattern of the leaf's conditions that it meets, one bit a feature."""
    code = np.zeros(len(x), np.int64)
    for k, (f, (low, high)) in enumerate(leaf.bounds().items()):
        code |= ((x[:, f] > low) & (x[:, f] <= high)).astype(np.int64) << k
    return code


def with_shares(rows: DataFrame, names: list[str], found: list[Leaf]) -> list[Leaf]:
    """The leaves with the share of the rows before each split of their path that go their way; a half where none comes."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(found), np.int64)
        for pdf in batches:
            x = pdf[names].to_numpy(np.float64)
            for k, leaf in enumerate(found):
                total[k] += int((_met(x, leaf) == (1 << len(leaf.bounds())) - 1).sum())
        yield pd.DataFrame({"leaf": np.arange(len(found)), "n": total})

    at = rows.select(*(F.col(f"`{n}`").cast("double").alias(n) for n in names)).mapInPandas(count, "leaf int, n long").groupBy("leaf").agg(F.sum("n").alias("n"))
    reached = {r["leaf"]: r["n"] for r in at.collect()}
    sums: dict[tuple, int] = {}
    for k, leaf in enumerate(found):
        for depth in range(len(leaf.splits) + 1):
            key = (leaf.tree, tuple(leaf.splits[:depth]))
            sums[key] = sums.get(key, 0) + reached.get(k, 0)
    for leaf in found:
        parts = [(sums[leaf.tree, tuple(leaf.splits[: i + 1])], sums[leaf.tree, tuple(leaf.splits[:i])]) for i in range(len(leaf.splits))]
        leaf.shares = [a / b if b else 0.5 for a, b in parts]
    return found


def attributions(rows: DataFrame, names: list[str], found: list[Leaf], keys: tuple[str, ...] = ("series_id", "seq")) -> DataFrame:
    """(keys, base, names): what each feature adds to a row's prediction, the mean over trees; base and these sum to it."""
    trees = len({leaf.tree for leaf in found})
    tables = [leaf.table() for leaf in found]
    base = sum(t[2] for t in tables) / trees
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[names].to_numpy(np.float64)
            out = np.zeros_like(x)
            for leaf, (features, table, _) in zip(found, tables, strict=True):
                if features:
                    out[:, features] += table[_met(x, leaf)]
            made = pdf[list(keys)].copy()
            made["base"] = base
            for k, n in enumerate(names):
                made[n] = out[:, k] / trees
            yield made

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "base double", *(f"`{n}` double" for n in names)])
    return rows.select(*keys, *(F.col(f"`{n}`").cast("double").alias(n) for n in names)).mapInPandas(run, schema)


def shapley_importance(long: DataFrame, target: DataFrame, names: list[str], trees: int = 20, depth: int = 5, seed: int = 42) -> DataFrame:
    """``point_shapley_importance`` of a long table and its target."""
    return point_shapley_importance(beside_target(long, target, names), names, trees, depth, seed)


def point_shapley_importance(points: DataFrame, names: list[str], trees: int = 20, depth: int = 5, seed: int = 42) -> DataFrame:
    """(feature, importance) of points (*names, target): mean absolute Shapley value of each feature over all of them, of a forest fitted to the target."""
    whole = points.select(*names, "target").na.drop()
    found = with_shares(whole, names, leaves(grown_forest(whole, names, trees, depth, seed).toDebugString))
    made = attributions(whole, names, found, ())
    means = made.agg(*(F.avg(F.abs(F.col(f"`{n}`"))).alias(n) for n in names))
    return means.unpivot([], [F.col(f"`{n}`") for n in names], "feature", "importance")
