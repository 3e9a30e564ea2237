"""Mutual information by nearest neighbours (Kraskov, Stögbauer and Grassberger, 2004).

A feature's points are cut into strips of the target, and each strip is one task's. There a point's distance to its k-th
neighbour is bounded by those beside it in columns of several widths, and the points in a square of that size are compared; a point whose
square leaves its strip asks the strips that it touches, which take part with their points near enough. How many points
lie nearer on each axis alone follows from ranges of that axis: a point is counted in its own range, and only ends
that fall among another range's points ask there. So points are shuffled once for the plane and once for each axis.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import written
from .distribution import digamma
from .statistics import with_target

#: Points of a strip and of a range of an axis, about, and relative size of the noise that breaks ties. The last is a fixed value of the definition.
ROWS, RANGE, NOISE = 200_000, 1_000_000, 1e-10
#: Rows that a feature needs. Fixed value of the definition.
LEAST = 30
#: Columns of a plane grow by this factor; a square is looked up in so many at most; pairs that are compared at once.
FINER, SPAN, PAIRS = 4, 4, 1 << 21
#: Relative widening of squares, above all rounding.
_SURE = 1e-9


def _noise(*seeds: Column | str) -> Column:
    """A number from -1 to 1 that follows from a row's place."""
    return F.pmod(F.xxhash64(*seeds), F.lit(1 << 40)) / F.lit(float(1 << 39)) - 1


def scaled_points(long: DataFrame, target: DataFrame) -> DataFrame:
    """(feature, series_id, seq, n, x, y): feature and target, from their means in deviations, ties broken by noise far below them.

    Rows with a null on either side are left out; NaN and infinite values count as 0.
    """
    clean = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(F.col(c).cast("double"))
    rows = with_target(long.filter("value is not null"), target).filter("target is not null").select("feature", "series_id", "seq", clean("value").alias("x"), clean("target").alias("y"))
    sizes = rows.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{n}{c}") for c in ("x", "y") for n, f in (("m", F.avg), ("s", F.stddev_pop))), *(F.avg(F.abs(c)).alias(f"a{c}") for c in ("x", "y")))
    joined = rows.join(F.broadcast(sizes), "feature")

    def scaled(c: str) -> Column:
        unit = F.when(F.col(f"s{c}") > 0, F.col(f"s{c}")).otherwise(F.lit(1.0))
        wide = F.greatest(F.lit(1.0), F.col(f"a{c}") / unit)
        return (F.col(c) - F.col(f"m{c}")) / unit + F.lit(NOISE) * wide * _noise(F.lit(c), "feature", "series_id", "seq")

    return joined.select("feature", "series_id", "seq", "n", scaled("x").alias("x"), scaled("y").alias("y"))


class _Plane:
    """Points in columns of equal counts, from one column to as many as points, each sorted by y."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y, self.n = x, y, len(x)
        self.sorted_y = np.sort(y)
        by_y = np.argsort(y, kind="stable")
        place, by_x = np.empty(self.n, np.int64), np.argsort(x, kind="stable")
        rank_x = np.empty(self.n, np.int64)
        place[by_y], rank_x[by_x] = np.arange(self.n), np.arange(self.n)
        self.cuts = []
        columns = 1
        while True:
            of = rank_x * columns // max(self.n, 1)
            keys = of * self.n + place
            order = np.argsort(keys)
            firsts = x[by_x[(np.arange(columns) * self.n + columns - 1) // columns]] if self.n else np.zeros(1)
            self.cuts.append((of[order], keys[order], order, firsts))
            columns *= FINER
            if columns * 4 > self.n:
                break

    def reach(self, k: int) -> np.ndarray:
        """An upper bound of each point's distance to its k-th neighbour; infinite where no column has so many points."""
        best = np.full(self.n, np.inf)
        for of, _, order, _ in self.cuts:
            x, y = self.x[order], self.y[order]
            far = np.full((self.n, 2 * k), np.inf)
            for j in range(1, k + 1):
                d = np.where(of[j:] == of[:-j], np.maximum(np.abs(x[j:] - x[:-j]), np.abs(y[j:] - y[:-j])), np.inf)
                far[j:, 2 * j - 2], far[: max(self.n - j, 0), 2 * j - 1] = d, d
            best[order] = np.minimum(best[order], np.partition(far, k - 1, axis=1)[:, k - 1])
        return best

    def nearest(self, x: np.ndarray, y: np.ndarray, reach: np.ndarray, k: int, own: bool = False) -> np.ndarray:
        """The k smallest distances within ``reach`` of each asked point, infinite where there are fewer; ``own`` asks for the plane's points themselves."""
        best, todo = np.full((len(x), k), np.inf), np.arange(len(x)) if self.n else np.arange(0)
        wide = reach * (1 + _SURE)
        low, high = (np.searchsorted(self.sorted_y, v, side) for v, side in ((y - wide, "left"), (y + wide, "right")))
        for _, keys, order, firsts in reversed(self.cuts):
            begin = np.maximum(np.searchsorted(firsts, x[todo] - wide[todo]) - 1, 0)
            end = np.maximum(np.searchsorted(firsts, x[todo] + wide[todo], "right") - 1, 0)
            fits = (end - begin < SPAN) | (len(firsts) == 1)
            asked, begin, end, todo = todo[fits], begin[fits], end[fits], todo[~fits]
            if not len(asked):
                continue
            columns = np.minimum(begin[:, None] + np.arange(min(SPAN, len(firsts))), len(firsts) - 1)
            starts = np.searchsorted(keys, columns * self.n + low[asked][:, None])
            sizes = np.maximum(np.searchsorted(keys, columns * self.n + high[asked][:, None]) - starts, 0)
            sizes[begin[:, None] + np.arange(columns.shape[1]) > end[:, None]] = 0
            total = np.cumsum(sizes.sum(1))
            at = 0
            while at < len(asked):
                to = max(int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")), at + 1)
                self._compare(asked[at:to], starts[at:to], sizes[at:to], order, (x, y, wide), best, own)
                at = to
        return best

    def _compare(self, asked: np.ndarray, starts: np.ndarray, sizes: np.ndarray, order: np.ndarray, of: tuple, best: np.ndarray, own: bool) -> None:
        x, y, wide = of
        flat = sizes.ravel()
        q = np.repeat(np.repeat(asked, sizes.shape[1]), flat)
        p = order[np.arange(flat.sum()) + np.repeat(starts.ravel() - (np.cumsum(flat) - flat), flat)]
        far = np.maximum(np.abs(x[q] - self.x[p]), np.abs(y[q] - self.y[p]))
        kept = far <= wide[q]
        if own:
            kept &= p != q
        q, far = q[kept], far[kept]
        by = np.lexsort((far, q))
        q, far = q[by], far[by]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        few = nth < best.shape[1]
        best[q[few], nth[few]] = far[few]


class _Ranges:
    """Ranges of an axis for each feature, numbered over all features; their bounds are approximate percentiles, which any result is free of."""

    def __init__(self, points: DataFrame, axis: str, rows: int, between: bool = False):
        sizes = {r["feature"]: r["n"] for r in points.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}
        parts = max([-(-n // rows) for n in sizes.values()], default=1)
        shares = [i / parts for i in range(1, parts)]
        found = points.groupBy("feature").agg(F.percentile_approx(axis, shares, max(10_000, 20 * parts)).alias("b")).collect() if shares else []
        self.bounds = {f: np.zeros(0) for f in sizes}
        for r in found:
            own = -(-sizes[r["feature"]] // rows)
            cut = np.unique([r["b"][i * parts // own - 1] for i in range(1, own)])
            # Between two, as a range that holds the ends of two heaps of values would be asked by all of both.
            self.bounds[r["feature"]] = np.unique(np.r_[cut, (cut[1:] + cut[:-1]) / 2]) if between else cut
        self.first, self.count = {}, 0
        for f in sorted(self.bounds, key=str):
            self.first[f] = self.count
            self.count += len(self.bounds[f]) + 1

    def place(self, feature: str, v: np.ndarray) -> np.ndarray:
        return self.first[feature] + np.searchsorted(self.bounds[feature], v, "right")

    def ends(self, key: int) -> tuple[str, float, float]:
        """A range's feature, lower and upper end; values are at least the former and below the latter."""
        feature = max((f for f in self.first if self.first[f] <= key), key=lambda f: self.first[f])
        cut = np.r_[-np.inf, self.bounds[feature], np.inf]
        return feature, cut[key - self.first[feature]], cut[key - self.first[feature] + 1]

    def tasks(self) -> int:
        return max(1, min(self.count, 8192))


def _by_feature(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    """The rows of each feature of a batch, whose first column it is."""
    codes = batch.column(0).dictionary_encode()
    index = codes.indices.to_numpy(zero_copy_only=False)
    for k, f in enumerate(codes.dictionary.to_pylist()):
        yield f, batch.filter(pa.array(index == k))


def _numbers(batch: pa.RecordBatch | pa.Table, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy() if isinstance(batch, pa.Table) else batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def _mapped(work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from work(b)

    return run


def _lists(best: np.ndarray, given: np.ndarray) -> pa.Array:
    return pa.array([row if g else None for row, g in zip(best.tolist(), given.tolist(), strict=True)] if given.any() else [None] * len(best), pa.list_(pa.float64()))


def neighbour_distances(points: DataFrame, k: int = 3, rows: int | None = None) -> DataFrame:
    """(feature, id, x, y, distance): of each point (feature, id, n, x, y), the k-th smallest distance on the larger axis to another of its feature.

    ``id`` is carried along and need not tell points apart. ``rows`` is about how many points a strip has. Points without so many others are left out.
    """
    strips = _Ranges(points, "y", rows or ROWS)
    if not strips.first:
        return points.select("feature", "id", "x", "y", F.lit(None).cast("double").alias("distance")).limit(0)
    kind = "feature string, key int, id long, x double, y double, distance double, at int, best array<double>"

    def deal(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for f, b in _by_feature(batch):
            key = strips.place(f, b.column("y").to_numpy(zero_copy_only=False)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(key), b.column("id"), b.column("x"), b.column("y")], names=["key", "id", "x", "y"])

    def within(table: pa.Table) -> pa.Table:
        ids, x, y = _numbers(table, "id", "x", "y")
        key = table.column("key")[0].as_py()
        feature, low, high = strips.ends(key)
        plane = _Plane(x, y)
        best = plane.nearest(x, y, plane.reach(k), k, own=True)
        far = best[:, -1]
        out = ~((y - low > far * (1 + _SURE)) & (high - y > far * (1 + _SURE))) & ((low > -np.inf) | (high < np.inf))
        return pa.table({"feature": pa.array([feature] * len(x), pa.string()), "key": pa.array([key] * len(x), pa.int32()), "id": ids, "x": x, "y": y, "distance": far, "at": pa.array(np.arange(len(x), dtype=np.int32), mask=~out), "best": _lists(best, out)})

    dealt = points.select("feature", "id", "x", "y").mapInArrow(_mapped(deal), "key int, id long, x double, y double")
    first = written(dealt.repartition(strips.tasks(), "key").groupBy("key").applyInArrow(within, kind))
    done = first.filter("best is null").select("feature", "id", "x", "y", "distance")
    open_ = first.filter("best is not null")

    def ask(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for f, b in _by_feature(batch):
            own, ids, x, y, far = _numbers(b, "key", "at", "x", "y", "distance")
            begin, end = strips.place(f, y - far * (1 + 2 * _SURE)), strips.place(f, y + far * (1 + 2 * _SURE))
            for i in range(0, len(x), 4096):
                part = slice(i, i + 4096)
                n = end[part] - begin[part] + 1
                row = np.repeat(np.arange(len(n)) + i, n)
                key = np.repeat(begin[part], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                row, key = row[key != own[row]], key[key != own[row]]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (key.astype(np.int32), own[row].astype(np.int32), ids[row].astype(np.int32), x[row], y[row], far[row])], names=["key", "own", "at", "x", "y", "reach"])

    asks = written(open_.select("feature", "key", "at", "x", "y", "distance").mapInArrow(_mapped(ask), "key int, own int, at int, x double, y double, reach double"))
    # Of an asked strip, only points as near as the furthest reaches from below and from above take part.
    up, down = (F.when(c, v) for c, v in ((F.col("own") < F.col("key"), F.col("y") + F.col("reach") * (1 + 2 * _SURE)), (F.col("own") > F.col("key"), F.col("y") - F.col("reach") * (1 + 2 * _SURE))))
    zones = asks.groupBy("key").agg(F.max(up).alias("up"), F.min(down).alias("down"))
    near = first.select("key", "x", "y").join(F.broadcast(zones), "key").filter(F.coalesce(F.col("y") <= F.col("up"), F.lit(False)) | F.coalesce(F.col("y") >= F.col("down"), F.lit(False)))
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("own", "int"), ("at", "int"), ("reach", "double"))]
    both = asks.select("key", "x", "y", "own", "at", "reach").unionByName(near.select("key", "x", "y", *nothing))

    def answer(table: pa.Table) -> pa.Table:
        given = table.column("own").is_valid().to_numpy()
        own, other = table.filter(pa.array(~given)), table.filter(pa.array(given))
        x, y, reach = _numbers(other, "x", "y", "reach")
        best = _Plane(*_numbers(own, "x", "y")).nearest(x, y, reach, k)
        return pa.table({"key": other.column("own"), "at": other.column("at"), "best": _lists(best, np.ones(len(x), bool))})

    found = both.repartition(strips.tasks(), "key").groupBy("key").applyInArrow(answer, "key int, at int, best array<double>")
    every = open_.select("key", "at", "best", "feature", "id", "x", "y").unionByName(found, allowMissingColumns=True)
    kth = F.get(F.array_sort(F.flatten(F.collect_list("best"))), F.lit(k - 1))
    merged = written(every.groupBy("key", "at").agg(F.max("feature").alias("feature"), F.max("id").alias("id"), F.max("x").alias("x"), F.max("y").alias("y"), kth.alias("distance")))
    return done.unionByName(merged.select("feature", "id", "x", "y", "distance")).filter("distance < double('infinity')")


def mean_psi(reached: DataFrame, axis: str, rows: int | None = None) -> DataFrame:
    """(feature, p): the mean of psi(count + 1), count being how many other points (feature, axis, distance) lie strictly nearer than ``distance`` on the axis."""
    ranges = _Ranges(reached, axis, rows or RANGE, between=True)

    def keyed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for f, b in _by_feature(batch):
            v = b.column("v").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(ranges.place(f, v).astype(np.int32)), b.column("v")], names=["key", "v"])

    values = reached.select("feature", F.col(axis).alias("v"), "distance")
    spans = values.select("feature", "v").mapInArrow(_mapped(keyed), "key int, v double").groupBy("key").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n")).collect()
    low, high, sizes = np.full(ranges.count, np.inf), np.full(ranges.count, -np.inf), np.zeros(ranges.count, np.int64)
    for r in spans:
        low[r["key"]], high[r["key"]], sizes[r["key"]] = r["low"], r["high"], r["n"]
    before = np.cumsum(sizes) - sizes

    def known(key: np.ndarray, end: np.ndarray, upper: bool) -> tuple[np.ndarray, np.ndarray]:
        """Which ends fall beside all points of their range, and how many points of all features lie before them then."""
        under = end < low[key] if upper else end <= low[key]
        over = end >= high[key] if upper else end > high[key]
        return under | over, before[key] + np.where(under, 0, sizes[key])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        point = TaskContext.get().partitionId() << 33
        for batch in batches:
            for f, b in _by_feature(batch):
                v, far = _numbers(b, "v", "distance")
                inside = far * (1 - 1e-9)
                own = ranges.place(f, v)
                parts, whole, rest = [], np.ones(len(v), bool), np.zeros(len(v))
                for upper, end in ((False, v - inside), (True, v + inside)):
                    key = ranges.place(f, end)
                    sure, count = known(key, end, upper)
                    whole &= sure | (key == own)
                    rest += np.where(sure, count if upper else -count, 0)
                    parts.append((upper, end, key, sure))
                ids = point + np.arange(len(v))
                point += len(v)
                rows_ = [(own, v, np.where(whole, inside, np.nan), np.full(len(v), -1))]
                owed = rest.copy()
                for upper, end, key, sure in parts:
                    at = np.flatnonzero(~whole & ~sure)
                    rows_.append((key[at], end[at], owed[at], ids[at] * 2 + upper))
                    owed[at] = 0
                columns = [np.concatenate(c) for c in zip(*rows_, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0].astype(np.int32)), pa.array(columns[1]), pa.array(columns[2]), pa.array(columns[3].astype(np.int64))], names=["key", "v", "d", "ask"])

    def count(table: pa.Table) -> pa.Table:
        v, d, ask = _numbers(table, "v", "d", "ask")
        key = table.column("key")[0].as_py()
        feature = ranges.ends(key)[0]
        data = ask < 0
        points = np.sort(v[data])
        mine = data & ~np.isnan(d)
        sums = np.zeros(0)
        if mine.any():
            n = np.full(int(mine.sum()), -1, np.int64)
            for upper, end in ((False, v[mine] - d[mine]), (True, v[mine] + d[mine])):
                at = ranges.place(feature, end)
                there = before[key] + np.searchsorted(points, end, "right" if upper else "left")
                total = np.where(at == key, there, known(at, end, upper)[1])
                n += total if upper else -total
            sums = digamma((n + 1).astype(np.float64))
        q, upper = ask[~data], ask[~data] % 2 == 1
        there = before[key] + np.where(upper, np.searchsorted(points, v[~data], "right"), np.searchsorted(points, v[~data], "left"))
        answers = np.where(upper, there, -there) + d[~data].astype(np.int64)
        size = len(q) + 1
        return pa.table({
            "feature": pa.array([feature] * size, pa.string()), "point": pa.array([None, *(q // 2).tolist()], pa.int64()), "n": pa.array(np.r_[len(sums), answers].astype(np.int64)),
            "p": pa.array([float(sums.sum()), *[None] * len(q)], pa.float64()),
        })

    @F.pandas_udf("double")
    def psi(v: pd.Series) -> pd.Series:
        return pd.Series(digamma(v.to_numpy(np.float64)))

    if not ranges.first:
        return reached.groupBy("feature").agg(F.avg("distance").alias("p"))
    found = written(values.mapInArrow(deal, "key int, v double, d double, ask long").repartition(ranges.tasks(), "key").groupBy("key").applyInArrow(count, "feature string, point long, n long, p double"))
    local = found.filter("point is null").select("feature", "n", "p")
    asked = found.filter("point is not null").groupBy("feature", "point").agg(F.sum("n").alias("n")).select("feature", F.lit(1).cast("long").alias("n"), psi(F.col("n").cast("double")).alias("p"))
    return local.unionByName(asked).groupBy("feature").agg(F.try_divide(F.sum("p"), F.sum("n")).alias("p"))


def neighbour_information(long: DataFrame, target: DataFrame, k: int = 3, rows: int | None = None) -> DataFrame:
    """(feature, information) in nats, 0 at least; NULL below ``LEAST`` rows with both values.

    From the points that lie strictly nearer on each axis than the k-th neighbour in the plane: psi(n) + psi(k) less the
    means of psi(count + 1) on both axes.
    """
    points = scaled_points(long, target).filter(F.col("n") >= LEAST).withColumn("id", F.lit(0).cast("long"))
    reached = neighbour_distances(points, k, rows)
    means = mean_psi(reached, "x", rows).withColumnRenamed("p", "px").join(mean_psi(reached, "y", rows).withColumnRenamed("p", "py"), "feature")
    sizes = points.groupBy("feature").agg(F.max("n").alias("n"))

    @F.pandas_udf("double")
    def psi(v: pd.Series) -> pd.Series:
        return pd.Series(digamma(v.to_numpy(np.float64)))

    known = means.join(sizes, "feature").select("feature", F.greatest(psi(F.col("n").cast("double")) + float(digamma(np.array([float(k)]))[0]) - F.col("px") - F.col("py"), F.lit(0.0)).alias("information"))
    return long.select("feature").distinct().join(known, "feature", "left")
