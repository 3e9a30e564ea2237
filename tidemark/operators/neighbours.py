"""Near neighbours of points, counted in blocks without comparing all of them.

A point goes to the blocks of the first two axes, two radii wide, in which a pair that it is the lower one of may have its
larger coordinates: 2.25 blocks on average, whatever the number of points; the points of a short series are one block. A block counts its
pairs from sorted arrays, in n log n steps on two axes and one more factor log n for each further axis; blocks of few points, which are
most blocks, are compared together, many in one step. Equal points are one row with a weight, so ties cost nothing.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written

#: Distinct points up to which a key is one block and a block is compared with others in one step, and rows that are compared at once.
FEW, TOGETHER = 1024, 1 << 17
#: Distinct points of a key from which blocks are one radius wide instead of two.
SALTED = 4_000_000
#: Blocks are at least this part of the largest value in size, so that their numbers stay exact.
_LEAST = 1e-9
#: By how much a point's reach is widened, relatively, when blocks are found for it; above all rounding.
_SURE = 1e-6


def _reach(values: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rank, first, end): each value's rank among the distinct ones, and the ranks whose values differ from it by ``r`` at most."""
    distinct, rank = np.unique(values, return_inverse=True)
    last = len(distinct) - 1
    first = np.searchsorted(distinct, distinct - r)
    end = np.searchsorted(distinct, distinct + r, "right") - 1
    # The sums above are rounded; the difference itself decides.
    while (more := (first > 0) & (distinct - distinct[np.maximum(first - 1, 0)] <= r)).any():
        first -= more
    while (less := distinct - distinct[np.minimum(first, last)] > r).any():
        first += less
    while (more := (end < last) & (distinct[np.minimum(end + 1, last)] - distinct <= r)).any():
        end += more
    while (less := distinct[end] - distinct > r).any():
        end -= less
    return rank, first[rank], end[rank] + 1


class _Below:
    """Sums of weights in a stretch of a sequence over the numbers below a bound, by a wavelet matrix."""

    def __init__(self, numbers: np.ndarray, weights: np.ndarray, bits: int):
        self.levels = []
        for bit in reversed(range(bits)):
            zero = numbers >> bit & 1 == 0
            places = np.r_[0, np.cumsum(zero)]
            self.levels.append((bit, places, np.r_[0, np.cumsum(np.where(zero, weights, 0))]))
            order = np.r_[np.flatnonzero(zero), np.flatnonzero(~zero)]
            numbers, weights = numbers[order], weights[order]

    def sums(self, a: np.ndarray, b: np.ndarray, bound: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        for bit, places, weights in self.levels:
            one = bound >> bit & 1 == 1
            out += np.where(one, weights[b] - weights[a], 0)
            a, b = (np.where(one, places[-1] + k - places[k], places[k]) for k in (a, b))
        return out


def _near(block: np.ndarray, columns: list[np.ndarray], w: np.ndarray, asked: np.ndarray, ranges: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray) -> int:
    """For each question, its weight times the weights of the rows of its block whose ranks lie in its ranges, all added up."""
    wide = int(columns[0].max()) + 2
    key = block * wide + columns[0]
    by = np.argsort(key, kind="stable")
    a, b = (np.searchsorted(key[by], asked * wide + end) for end in ranges[0])
    if len(columns) == 1:
        total = np.r_[0, np.cumsum(w[by])]
        return int((weights * (total[b] - total[a])).sum())
    rest = [c[by] for c in columns[1:]]
    if len(columns) == 2:
        sums = _Below(rest[0], w[by], int(rest[0].max() + 1).bit_length())
        return int((weights * (sums.sums(a, b, ranges[1][1]) - sums.sums(a, b, ranges[1][0]))).sum())
    return _between(rest, w[by], a, b, ranges[1:], weights)


def _between(columns: list[np.ndarray], w: np.ndarray, start: np.ndarray, stop: np.ndarray, ranges: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray) -> int:
    """The same for rows from place ``start`` to before ``stop``: the rows before a place are blocks of 2^level rows, one for each bit of the place."""
    found, at = 0, np.arange(len(w))
    for level in range(len(w).bit_length()):
        for places, sign in ((stop, 1), (start, -1)):
            q = np.flatnonzero(places >> level & 1)
            if len(q):
                found += sign * _near(at >> level, columns, w, (places[q] >> level) - 1, [(lo[q], hi[q]) for lo, hi in ranges], weights[q])
    return found


def pairs_within(points: np.ndarray, w: np.ndarray, r: float) -> int:
    """The sum of products of weights over pairs of different rows that differ by ``r`` at most in every column."""
    if len(points) < 2:
        return 0
    order = np.argsort(points[:, 0], kind="stable")
    points, w = points[order], w[order]
    rank, _, end = _reach(points[:, 0], r)
    # Of the rows in order of the first column, those after this one and before ``stop``.
    stop, start = np.searchsorted(rank, end), np.arange(1, len(w) + 1)
    if points.shape[1] == 1:
        total = np.r_[0, np.cumsum(w)]
        return int((w * (total[stop] - total[start])).sum())
    reach = [_reach(c, r) for c in points.T[1:]]
    return _between([c for c, _, _ in reach], w, start, stop, [(lo, hi) for _, lo, hi in reach], w)


def pairs_of_groups(group: np.ndarray, points: np.ndarray, w: np.ndarray, r: np.ndarray, before: list[np.ndarray]) -> np.ndarray:
    """``pairs_within`` of each group, which are numbered from 0, without pairs whose points are both ``before`` on an axis.

    In order of group and first column, each row meets the one after it, then the one after that, as long as that is near enough.
    """
    total = np.zeros(int(group.max()) + 1 if len(group) else 0, np.int64)
    order = np.lexsort((points[:, 0], group))
    group, points, w, r, before = group[order], points[order], w[order], r[order], [b[order] for b in before]
    i, step = np.arange(len(group) - 1), 1
    with np.errstate(invalid="ignore"):
        while len(i):
            j = i + step
            i = i[(group[j] == group[i]) & (points[j, 0] - points[i, 0] <= r[i])]
            j = i + step
            near = np.ones(len(i), bool)
            for c in points.T[1:]:
                near &= np.abs(c[j] - c[i]) <= r[i]
            for b in before:
                near &= ~(b[i] & b[j])
            np.add.at(total, group[i[near]], w[i[near]] * w[j[near]])
            step += 1
            i = i[i + step < len(group)]
    return total


def starts(pdf: pd.DataFrame, names: list[str]) -> np.ndarray:
    """Where the groups of sorted rows begin."""
    of = np.column_stack([pd.factorize(pdf[c], use_na_sentinel=False)[0] for c in names])
    return np.flatnonzero(np.r_[True, (of[1:] != of[:-1]).any(1)])


def whole_groups(batches: Iterator[pd.DataFrame], names: list[str]) -> Iterator[pd.DataFrame]:
    """Sorted rows in stretches of many groups, none of which is cut."""
    held, rows, enough = [], 0, TOGETHER
    for pdf in batches:
        held.append(pdf)
        rows += len(pdf)
        if rows >= enough:
            pdf = pd.concat(held, ignore_index=True)
            end = starts(pdf, names)[-1]
            if end:
                yield pdf.iloc[:end]
            # A group that goes on is not looked at again before it has doubled.
            held, rows = [pdf.iloc[end:]], len(pdf) - end
            enough = max(TOGETHER, 2 * rows)
    if rows:
        yield pd.concat(held, ignore_index=True)


def matching_pairs(points: DataFrame, key: str, axes: list[str], radius: str, fine: int | None = None) -> DataFrame:
    """(key, pairs): of each key, the unordered pairs of rows that differ by at most ``radius`` on every axis.

    ``radius`` is positive and the same in all rows of a key. ``fine`` is the number of blocks in a radius; by default, a
    block is two radii wide. Rows with a null or NaN on an axis match none. Keys without a pair are absent. A task holds the distinct
    points of a block and of the radius before it.
    """
    whole = points.filter(" and ".join(f"`{a}` is not null and not isnan(`{a}`)" for a in axes))
    weighed = written(whole.groupBy(key, radius, *axes).agg(F.count(F.lit(1)).alias("w")))
    # Written, so that its join knows its size: few keys are broadcast, many aren't.
    size = written(weighed.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(F.greatest(*(F.abs(a) for a in axes), F.lit(0.0))).alias("largest")))
    blocks = F.lit(float(fine)) if fine else F.when(F.col("n") > SALTED, 1.0).otherwise(0.5)
    sized = weighed.join(size, key).withColumn("width", F.greatest(F.col(radius) / blocks, F.col("largest") * _LEAST))
    cut = axes[:2]
    place = lambda at: F.floor(at / F.col("width")) if fine else F.when(F.col("n") <= FEW, F.lit(0).cast("long")).otherwise(F.floor(at / F.col("width")))
    home = {f"home{k}": place(F.col(a)) for k, a in enumerate(cut)}
    last = [place(F.col(a) + F.col(radius) * (1 + _SURE)) for a in cut]
    sent = sized.withColumns(home).select(key, F.col(radius).alias("_r"), "w", *axes, *home, *(v.alias(f"last{k}") for k, v in enumerate(last)))
    for k in range(len(cut)):
        # Blocks as steps from the point's own: 0 where the point lies in it.
        sent = sent.withColumn(f"step{k}", F.explode(F.sequence(F.lit(0), (F.col(f"last{k}") - F.col(f"home{k}")).cast("int"))))
    sent = sent.select(key, "_r", "w", *axes, *(F.col(f"step{k}") for k in range(len(cut))), *((F.col(f"home{k}") + F.col(f"step{k}")).alias(f"block{k}") for k in range(len(cut))))
    name = [f"block{k}" for k in range(len(cut))]

    def of_large(pdf: pd.DataFrame) -> int:
        at, w, r = pdf[axes].to_numpy(np.float64), pdf["w"].to_numpy(np.int64), float(pdf["_r"].iloc[0])
        before = [pdf[f"step{k}"].to_numpy() > 0 for k in range(len(cut))]
        # Pairs whose larger coordinates lie in the block: all, less those with both points before it on an axis.
        found = pairs_within(at, w, r)
        for b in before:
            found -= pairs_within(at[b], w[b], r)
        if len(before) == 2:
            b = before[0] & before[1]
            found += pairs_within(at[b], w[b], r)
        return found

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        first = starts(pdf, [key, *name])
        sizes = np.diff(np.r_[first, len(pdf)])
        group, large = np.arange(len(first)).repeat(sizes), sizes > FEW
        some = pdf[~large[group]]
        found = np.zeros(len(first), np.int64)
        of_few = pairs_of_groups(group[~large[group]], some[axes].to_numpy(np.float64), some["w"].to_numpy(np.int64), some["_r"].to_numpy(np.float64), [some[f"step{k}"].to_numpy() > 0 for k in range(len(cut))])
        found[: len(of_few)] = of_few
        for g in np.flatnonzero(large):
            found[g] = of_large(pdf.iloc[first[g] : first[g] + sizes[g]])
        return pd.DataFrame({key: pdf[key].to_numpy()[first], "pairs": found})[found > 0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from map(count, whole_groups(batches, [key, *name]))

    kind = points.schema[key].dataType.simpleString()
    unequal = sent.repartition(key, *name).sortWithinPartitions(key, *name).mapInPandas(run, f"`{key}` {kind}, pairs long")
    equal = weighed.filter("w > 1").select(key, (F.col("w") * (F.col("w") - 1) / 2).cast("long").alias("pairs"))
    return unequal.unionByName(equal).groupBy(key).agg(F.sum("pairs").alias("pairs")).filter("pairs > 0")
