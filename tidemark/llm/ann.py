"""Approximate nearest neighbours with a robust-pruned directed graph in each shard (Subramanya et al., 2019).

1. Equal vectors collapse to one point that keeps its smallest ids, as many as an answer can need, so a
   vector that a third of the rows share is one point and ties still resolve exactly.
2. Points are dealt to shards of about ``SHARD`` points by a hash. In each shard a graph is built: greedy
   searches from the medoid propose neighbours for a batch of points at a time, and robust pruning keeps
   a candidate unless one already kept is nearer to it by the factor ``ALPHA``; reverse edges are pruned
   the same way. Two passes, the first with factor one. Graphs are built once and written as rows.
3. Every query runs a beam search in every shard: each pair of a shard and a block of about
   ``QUERY_BLOCK`` queries is one row of work, whose size does not grow with the data. The answers of all
   shards are ranked by exact distances in double precision.

All rows are indexed; queries are a stated set.

Defined results: vectors that are null, empty, zero or that hold null or non-finite components take no
part, nor do rows without an id; vectors of another length than most are left out; repeated ids are
candidates of their own; with fewer candidates than asked for, all are returned; an empty table gives none.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialise

SHARD = 4096
DEGREE = 32
BUILD_BEAM = 64
SEARCH_BEAM = 96
ALPHA = 1.2
QUERY_BLOCK = 512
_BATCH = 256


def beam_search(graph: np.ndarray, points: np.ndarray, norms: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy beam search of all queries at a time: (ids, squared distances), the nearest first.

    In each round every query expands its nearest point not yet expanded; neighbours that its beam
    holds already are dropped, the others are merged in by distance.
    """
    q, n = len(queries), len(points)
    own = (queries * queries).sum(1)
    ids = np.full((q, beam), n, np.int64)
    dist = np.full((q, beam), np.inf, np.float32)
    done = np.ones((q, beam), bool)
    ids[:, 0], done[:, 0] = start, False
    dist[:, 0] = norms[start] + own - 2 * queries @ points[start]
    live = np.arange(q)
    while len(live):
        at = np.argmin(done[live], axis=1)
        open_ = ~done[live, at]
        live, at = live[open_], at[open_]
        if not len(live):
            break
        done[live, at] = True
        near = graph[ids[live, at]]
        real = near < n
        safe = np.where(real, near, 0)
        d = norms[safe] + own[live, None] - 2 * np.einsum("qrd,qd->qr", points[safe], queries[live])
        held = (near[:, :, None] == ids[live][:, None, :]).any(2)
        d = np.where(real & ~held, d, np.inf).astype(np.float32)
        all_d = np.concatenate([dist[live], d], 1)
        order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        take = np.take_along_axis
        dist[live] = take(all_d, order, 1)
        ids[live] = np.where(np.isinf(dist[live]), n, take(np.concatenate([ids[live], near], 1), order, 1))
        done[live] = take(np.concatenate([done[live], np.isinf(d)], 1), order, 1) | np.isinf(dist[live])
    return ids, dist


def robust_prune(point: np.ndarray, cand: np.ndarray, points: np.ndarray, norms: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """For rows of candidate ids (``len(points)`` for none): up to ``degree`` diverse ones, the nearest first.

    The nearest candidate left is kept, and those that it is nearer to, by the factor alpha, than the
    point is, go. All rows advance together.
    """
    n, rows = len(points), len(point)
    safe = np.where(cand < n, cand, 0)
    vectors = points[safe]
    base = points[point]
    d = norms[safe] + norms[point][:, None] - 2 * np.einsum("bcd,bd->bc", vectors, base)
    d = np.where((cand < n) & (cand != point[:, None]), d, np.inf)
    alive, out, row = np.isfinite(d), np.full((rows, degree), n, np.int64), np.arange(rows)
    for k in range(degree):
        best = np.argmin(np.where(alive, d, np.inf), axis=1)
        any_left = alive[row, best]
        if not any_left.any():
            break
        out[any_left, k] = cand[row, best][any_left]
        chosen = vectors[row, best]
        to_chosen = norms[safe] + (chosen * chosen).sum(1)[:, None] - 2 * np.einsum("bcd,bd->bc", vectors, chosen)
        alive &= alpha * alpha * np.maximum(to_chosen, 0) > d
        alive[row, best] = False
        alive &= any_left[:, None]
        alive &= cand != cand[row, best][:, None]
    return out


def build_graph(points: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray, int]:
    """(graph, squared norms, medoid): neighbours' ids by row, ``len(points)`` where there is none."""
    n, rng = len(points), np.random.default_rng(seed)
    norms = (points * points).sum(1)
    medoid = int(np.argmin(((points - points.mean(0)) ** 2).sum(1)))
    degree = min(DEGREE, max(1, n - 1))
    graph = np.full((n + 1, degree), n, np.int64)
    for row in range(n):
        drawn = rng.choice(n, min(degree, n), replace=False)
        drawn = drawn[drawn != row]
        graph[row, : len(drawn)] = drawn[:degree]
    for alpha in (1.0, ALPHA):
        turns = rng.permutation(n)
        for i in range(0, n, _BATCH):
            who = turns[i : i + _BATCH]
            found, _ = beam_search(graph, points, norms, medoid, points[who], min(BUILD_BEAM, n))
            graph[who] = robust_prune(who, np.concatenate([found, graph[who]], 1), points, norms, alpha, degree)
            source = np.repeat(who, degree)
            target = graph[who].ravel()
            ok = target < n
            source, target = source[ok], target[ok]
            order = np.argsort(target, kind="stable")
            source, target = source[order], target[order]
            heads, starts, counts = np.unique(target, return_index=True, return_counts=True)
            place = np.arange(len(target)) - np.repeat(starts, counts)
            extra = np.full((len(heads), int(counts.max()) if len(counts) else 0), n, np.int64)
            extra[np.repeat(np.arange(len(heads)), counts), place] = source
            have = graph[heads]
            extra = np.where((extra[:, :, None] == have[:, None, :]).any(2), n, extra)
            free, fresh = (have >= n).sum(1), (extra < n).sum(1)
            fits = fresh <= free
            merged = np.sort(np.concatenate([have, extra], 1), axis=1)
            graph[heads[fits]] = merged[fits][:, :degree]
            if (~fits).any():
                graph[heads[~fits]] = robust_prune(heads[~fits], merged[~fits], points, norms, alpha, degree)
    return graph, norms, medoid


def _packed(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null or empty, all components finite, not all zero."""
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & (F.size(v) > 0) & F.exists(v, lambda x: x != 0.0), F.lit(False))


def nearest(df: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD) -> DataFrame:
    """The ``k`` nearest rows of ``df`` for each row of ``queries``, but for the row with the query's id.

    Returns query_id, rank (from 1), ``id_col`` and score, the Euclidean distance; ties go to the smaller id.
    """
    v = F.transform(F.col(vector_col).cast("array<double>"), lambda x: F.when(x == 0.0, F.lit(0.0)).otherwise(x))
    rows = df.filter(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    asked = queries.filter(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("query_id"), v.alias("qv"))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not lengths:
        return df.sparkSession.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    size = lengths[0].n
    keyed = rows.filter(F.size("v") == size).withColumn("key", F.xxhash64("v", F.lit(1)))
    first = Window.partitionBy("key", "v").orderBy("id")
    bounded = keyed.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k + 1)
    points = materialise(bounded.groupBy("key", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "points")
    shards = max(1, math.ceil(points.count() / shard))
    dealt = points.withColumn("shard", F.pmod("key", F.lit(shards))).repartition(4 * shards, "shard")
    graphs = materialise(_graphs(dealt), "graphs")
    asked = materialise(asked.filter(F.size("qv") == size).groupBy("query_id").agg(F.min("qv").alias("qv")), "queries")
    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    in_block = asked.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("query_id", "qv")).alias("asked"))
    every = graphs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    pairs = every.join(in_block, "block").repartition(shards * blocks, "shard", "block")
    found = pairs.mapInArrow(_searcher(size, k + 1), "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "id")
    ranked = found.filter("id != query_id").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def _graphs(points: DataFrame) -> DataFrame:
    """A row for each shard: its points, their ids and its graph, as packed arrays."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(least=[ids[0] for ids in pdf["ids"]]).sort_values("least")
        x = np.stack(pdf["v"].to_list())
        graph, _, medoid = build_graph(_scaled(x))
        counts = np.array([len(i) for i in pdf["ids"]], np.int32)
        ids = np.concatenate(pdf["ids"].to_list()).astype(np.int64)
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "medoid": [medoid], "x": [_packed(x)], "counts": [_packed(counts)], "ids": [_packed(ids)], "graph": [_packed(graph.astype(np.int32))]})

    by_shard = points.select("shard", "v", "ids").groupBy("shard")
    return by_shard.applyInPandas(build, "shard long, medoid long, x binary, counts binary, ids binary, graph binary")


def _scaled(x: np.ndarray) -> np.ndarray:
    """Vectors for the graph: single precision, about the mean's origin and of a size that can't overflow."""
    scale = float(np.abs(x).max()) or 1.0
    return (x / scale).astype(np.float32)


def _searcher(size: int, k: int):
    """Over rows of (shard, query block): the ids of each query's ``k`` nearest points there, with exact distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1).to_pylist()[0]
                x = np.frombuffer(row["x"], np.float64).reshape(-1, size)
                counts, ids = np.frombuffer(row["counts"], np.int32), np.frombuffer(row["ids"], np.int64)
                graph = np.frombuffer(row["graph"], np.int32).astype(np.int64).reshape(len(x) + 1, -1)
                asked = np.array([a["query_id"] for a in row["asked"]], np.int64)
                q = np.array([a["qv"] for a in row["asked"]], np.float64)
                scale = float(np.abs(x).max()) or 1.0
                points = (x / scale).astype(np.float32)
                norms = (points * points).sum(1)
                beam = min(SEARCH_BEAM, len(x))
                ask32 = np.clip(q / scale, -1e15, 1e15).astype(np.float32)
                near = [beam_search(graph, points, norms, row["medoid"], ask32[i : i + _BATCH], beam)[0] for i in range(0, len(q), _BATCH)]
                found = np.concatenate(near)[:, :k]
                who, col = np.nonzero(found < len(x))
                at = found[who, col]
                score = np.sqrt(((x[at] - q[who]) ** 2).sum(1))
                many, first = counts[at], np.r_[0, np.cumsum(counts)][at]
                step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                arrays = [np.repeat(asked[who], many), ids[np.repeat(first, many) + step], np.repeat(score, many)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in arrays], ["query_id", "id", "score"])

    return run
