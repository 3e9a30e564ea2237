"""k-means over integer vectors with Drake's adaptive bounds (Drake and Hamerly, 2012), exact to the last bit.

Vectors are rounded down to multiples of 1 / ``scale`` and kept as integers, so distances, sums and means are exact and
don't depend on the order of the rows. They are packed into blocks, a row each, which also hold for each vector: its
centroid and an upper bound of its distance; its next centroids, several of them, with a lower bound each; and one
lower bound for all others. A round moves the bounds by how far the centroids went. A vector whose upper bound lies
below all lower ones keeps its centroid without any distance; otherwise its own distance is taken, then those to the
listed centroids that the bounds can't rule out, and to all if the remainder bound can't be ruled out. Only strict
inequalities, with a margin for rounding, rule out, so ties are always decided by exact distances. A block
drops bounds that its last round didn't need.

A block's row also has its counts, distances and sums by centroid: a round is one map over blocks and an aggregate
of ``k * (dim + 2)`` numbers, which is all that the driver sees. Blocks are written to the shared folder after
every round, and those of the round before go then.

Defined results: vectors of another length, null, or with a null or non-finite component are left out; a null id is
hashed as the text ``null``; rows that repeat an id are vectors of their own; with fewer than k vectors there are as many
centroids; an empty table gives an empty result; a component of 2**27 / scale or more in size is an error, as its
distances exceed a long; other columns are ignored, whatever their names.
"""

import hashlib
from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, materialise

#: Largest size of an integer component: sums of squared differences over 2**6 of them fit a long.
LARGEST = 1 << 27
#: Relative margin of the bounds, far above what rounding of a double can do.
MARGIN = 1e-9

_STATE = "ids array<{id}>, vectors binary, wide boolean, near binary, bounds binary, listed int, totals array<long>"


class Bounds:
    """The state of a block: vectors, centroid and listed centroids (first column: its own), their bounds, the last for all others."""

    def __init__(self, vectors: np.ndarray, near: np.ndarray, bounds: np.ndarray):
        self.vectors, self.near, self.bounds = vectors, near, bounds

    @property
    def listed(self) -> int:
        return self.near.shape[1] - 1

    @staticmethod
    def _distance(vectors: np.ndarray, centre: np.ndarray) -> np.ndarray:
        off = vectors - centre
        return np.einsum("ij,ij->i", off, off)

    @classmethod
    def fresh(cls, vectors: np.ndarray, centres: np.ndarray, listed: int) -> "Bounds":
        """All distances; the nearest ``listed`` centroids besides the first are listed."""
        exact = np.stack([cls._distance(vectors, c) for c in centres], axis=1)
        order = np.argsort(exact, axis=1, kind="stable")
        far = np.sqrt(np.take_along_axis(exact, order, 1).astype(np.float64))
        rest = far[:, listed + 1] if far.shape[1] > listed + 1 else np.full(len(far), np.inf)
        bounds = np.column_stack([far[:, : listed + 1], rest]) * (1 - MARGIN)
        bounds[:, 0] = far[:, 0] * (1 + MARGIN)
        return cls(vectors, order[:, : listed + 1].astype(np.int32), bounds)

    def own_distance(self, centres: np.ndarray) -> np.ndarray:
        return self._distance(self.vectors, centres[self.near[:, 0]])

    def moved(self, centres: np.ndarray, moves: np.ndarray) -> int:
        """Follow the centroids to where they are now; the most listed bounds that a vector needed."""
        near, bounds = self.near, self.bounds
        bounds[:, 0] = (bounds[:, 0] + moves[near[:, 0]]) * (1 + MARGIN)
        lower = np.column_stack([moves[near[:, 1:]], np.full(len(near), moves.max(initial=0.0))])
        bounds[:, 1:] -= lower + MARGIN * (np.where(np.isfinite(bounds[:, 1:]), np.abs(bounds[:, 1:]), 0) + lower)
        open_ = np.flatnonzero(bounds[:, 0] >= bounds[:, 1:].min(1))
        if not len(open_):
            return 0
        own = self._distance(self.vectors[open_], centres[near[open_, 0]])
        bounds[open_, 0] = np.sqrt(own.astype(np.float64)) * (1 + MARGIN)
        still = bounds[open_, 0] >= bounds[open_, 1:].min(1)
        open_, own = open_[still], own[still]
        whole = bounds[open_, 0] >= bounds[open_, -1]
        self._among_listed(open_[~whole], own[~whole], centres)
        redo = open_[whole]
        if len(redo):
            again = Bounds.fresh(self.vectors[redo], centres, self.listed)
            near[redo], bounds[redo] = again.near, again.bounds
            return self.listed
        return int(self._wanted) if len(open_) else 0

    def _among_listed(self, rows: np.ndarray, own: np.ndarray, centres: np.ndarray) -> None:
        """Decide between a vector's centroid and the listed ones whose bounds don't rule them out; all others are farther."""
        near, bounds, upper = self.near, self.bounds, self.bounds[rows, 0].copy()
        best, at, wanted = own.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for j in range(1, near.shape[1]):
            asked = np.flatnonzero(bounds[rows, j] <= upper)
            if not len(asked):
                continue
            found = self._distance(self.vectors[rows[asked]], centres[near[rows[asked], j]])
            bounds[rows[asked], j] = np.sqrt(found.astype(np.float64)) * (1 - MARGIN)
            wanted[asked] += 1
            nearer = (found < best[asked]) | ((found == best[asked]) & (near[rows[asked], j] < near[rows[asked], at[asked]]))
            best[asked] = np.where(nearer, found, best[asked])
            at[asked] = np.where(nearer, j, at[asked])
        changed = np.flatnonzero(at > 0)
        r, j = rows[changed], at[changed]
        near[r, 0], near[r, j] = near[r, j], near[r, 0]
        bounds[r, j] = np.sqrt(own[changed].astype(np.float64)) * (1 - MARGIN)
        bounds[rows, 0] = np.sqrt(best.astype(np.float64)) * (1 + MARGIN)
        self._wanted = wanted.max(initial=0)

    def narrowed(self, listed: int) -> "Bounds":
        """With the ``listed`` smallest of the listed bounds; what goes joins the remainder."""
        if listed >= self.listed:
            return self
        order = np.argsort(self.bounds[:, 1:-1], axis=1, kind="stable")
        near, lower = np.take_along_axis(self.near[:, 1:], order, 1), np.take_along_axis(self.bounds[:, 1:-1], order, 1)
        rest = np.minimum(self.bounds[:, -1], lower[:, listed])
        return Bounds(self.vectors, np.column_stack([self.near[:, 0], near[:, :listed]]).astype(np.int32), np.column_stack([self.bounds[:, 0], lower[:, :listed], rest]))

    def row(self, ids: pa.Array, k: int, exact: np.ndarray) -> dict:
        own = self.near[:, 0]
        totals = []
        for j in range(k):
            mine = own == j
            totals += [int(mine.sum()), int(exact[mine].sum()), *self.vectors[mine].sum(0, dtype=np.int64).tolist()]
        wide = bool(np.abs(self.vectors).max(initial=0) > np.iinfo(np.int16).max)
        return {"ids": ids, "vectors": self.vectors.astype(np.int32 if wide else np.int16).tobytes(), "wide": wide, "near": self.near.tobytes(), "bounds": self.bounds.tobytes(), "listed": self.listed, "totals": totals}

    @classmethod
    def of(cls, row: dict, dim: int) -> "Bounds":
        vectors = np.frombuffer(row["vectors"], np.int32 if row["wide"] else np.int16).reshape(-1, dim).astype(np.int64)
        near = np.frombuffer(row["near"], np.int32).reshape(len(vectors), -1).copy()
        return cls(vectors, near, np.frombuffer(row["bounds"], np.float64).reshape(len(vectors), -1).copy())


def _batch(rows: list[dict], ids: list[pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    lengths = np.cumsum([0, *(len(x) for x in ids)])
    listed = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.concat_arrays(ids))
    return pa.RecordBatch.from_arrays([listed.cast(schema.field("ids").type), *(pa.array([r[f.name] for r in rows], f.type) for f in list(schema)[1:])], schema=schema)


def _schema(id_type: pa.DataType) -> pa.Schema:
    kinds = {"ids": pa.list_(id_type), "vectors": pa.binary(), "wide": pa.bool_(), "near": pa.binary(), "bounds": pa.binary(), "listed": pa.int32(), "totals": pa.list_(pa.int64())}
    return pa.schema(list(kinds.items()))


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """(id, vector) of the rows whose vector has ``dim`` finite components, as doubles."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.select(F.col(id_col).alias("id"), v.alias("vector")).filter((F.size(vector_col) == dim) & F.col("vector").isNotNull()).filter(F.coalesce(finite.cast("boolean"), F.lit(False)))


def _integers(flat: np.ndarray, dim: int, scale: float) -> np.ndarray:
    out = np.floor(flat.reshape(-1, dim) * scale)
    if np.abs(out).max(initial=0) >= LARGEST:
        raise ValueError(f"a component of {LARGEST / scale} or more: its squared distances don't fit a long")
    return out.astype(np.int64)


def _first(vectors: DataFrame, centres: np.ndarray, dim: int, scale: float, state: str) -> DataFrame:
    """Blocks of vectors with their bounds from all distances; a quarter of the centroids is listed at first."""
    listed = min(max(1, -(-len(centres) // 4)), len(centres) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            found = Bounds.fresh(_integers(b.column(1).flatten().to_numpy(zero_copy_only=False), dim, scale), centres, listed)
            ids = b.column(0)
            yield _batch([found.row(ids, len(centres), found.own_distance(centres))], [ids], _schema(ids.type))

    return vectors.mapInArrow(run, state)


def _next(blocks: DataFrame, before: np.ndarray, centres: np.ndarray, dim: int, exact: bool, state: str) -> DataFrame:
    """Blocks after the centroids went from ``before`` to ``centres``; distances are summed only where ``exact``."""
    moves = np.sqrt(((centres - before) ** 2).sum(1).astype(np.float64)) * (1 + MARGIN)
    least = -(-len(centres) // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = {n: b.column(n)[k].as_py() for n in ("vectors", "wide", "near", "bounds")}
                found, ids = Bounds.of(row, dim), b.column("ids")[k].values
                needed = found.moved(centres, moves)
                found = found.narrowed(max(least, needed))
                far = found.own_distance(centres) if exact else np.zeros(len(ids), np.int64)
                yield _batch([found.row(ids, len(centres), far)], [ids], _schema(ids.type))

    return blocks.mapInArrow(run, state)


def _totals(blocks: DataFrame, k: int, dim: int) -> list[list[int]]:
    """Of each centroid: count, summed distance and summed components; k (dim + 2) numbers."""
    at = blocks.select(F.posexplode("totals").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    out = [0] * (k * (dim + 2))
    for r in at.collect():
        out[r["at"]] = int(r["x"])
    return [out[j * (dim + 2) : (j + 1) * (dim + 2)] for j in range(k)]


def clusters(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8, rounds: int = 10, dim: int = 64, scale: float = 1024.0, seed: str = "3") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) after ``rounds`` rounds and one more assignment.

    The first centroids are the k vectors whose ids, behind the seed, have the smallest SHA-256. Rounds end early when
    no centroid moves, as all further ones would be the same.
    """
    vectors = whole_vectors(df, id_col, vector_col, dim)
    kind = df.select(F.col(id_col)).schema[0].dataType.simpleString()
    state = _STATE.format(id=kind)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))).cast("binary"), 256)
    chosen = vectors.orderBy(order, "vector").limit(k).collect()
    result = f"{id_col} {kind}, cluster int, distance long"
    if not chosen:
        return df.sparkSession.createDataFrame([], f"{result}, cluster_inertia long, inertia long, centroid_sha256 string")
    centres = _integers(np.array([r["vector"] for r in chosen], np.float64), dim, scale)
    spark, k, blocks = df.sparkSession, len(chosen), None
    with ExitStack() as held:
        blocks = held.enter_context(Scratch(spark))(_first(vectors, centres, dim, scale, state), "blocks")
        for done in range(1, rounds + 1):
            means = [[s // count for s in sums] if count else centres[j].tolist() for j, (count, _, *sums) in enumerate(_totals(blocks, k, dim))]
            before, centres = centres, np.array(means, np.int64)
            last = done == rounds or bool((before == centres).all())
            moved = _next(blocks, before, centres, dim, last, state)
            if last:
                blocks = materialise(moved, "clusters")
                break
            with held.pop_all():
                blocks = held.enter_context(Scratch(spark))(moved, "blocks")
        else:
            blocks = materialise(_next(blocks, centres, centres, dim, True, state), "clusters")
    found = _totals(blocks, k, dim)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                row = {n: b.column(n)[r].as_py() for n in ("vectors", "wide", "near", "bounds")}
                block, ids = Bounds.of(row, dim), b.column("ids")[r].values
                yield pa.RecordBatch.from_arrays([ids, pa.array(block.near[:, 0], pa.int32()), pa.array(block.own_distance(centres), pa.int64())], names=[id_col, "cluster", "distance"])

    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    at = F.col("cluster") + 1
    return blocks.mapInArrow(unpack, result).select(
        id_col, "cluster", "distance",
        F.element_at(F.array(*(F.lit(t[1]).cast("long") for t in found)), at).alias("cluster_inertia"), F.lit(sum(t[1] for t in found)).cast("long").alias("inertia"),
        F.element_at(F.array(*map(F.lit, digests)), at).alias("centroid_sha256"),
    )
