"""Centroid clustering (12): Lloyd's rounds in whole numbers, most scans saved by Hamerly's bounds.

1. Components become whole numbers, so sums, means and distances are exact and a
   result does not depend on how rows are dealt out.
2. Each vector carries one upper bound of the distance to its own centroid and one
   lower bound of that to any other.  When centroids have moved, the upper bound
   grows by the drift of its own and the lower falls by the greatest of the others.
   A vector whose upper bound stays below the lower (or below half the way from
   its centroid to the next) keeps its cluster unseen; else the upper bound is made
   tight, and if that does not settle it all centroids are compared in whole numbers.
3. Sums and counts per centroid are kept and changed by those vectors that moved,
   which are added up in their partitions before anything is shuffled.

The state is a table of vectors and bounds in the shared folder, written anew each
round; a lost executor costs its tasks of one round.  Only centroids, their sums and
counts reach the driver: their number is a parameter.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

CLUSTERS, ROUNDS, DIM, SCALE = 40, 5, 64, 256
#: Distances whose parts stay below this are exact in doubles.
_EXACT = 2.0 ** 52
#: More than the rounding of a bound can amount to, as a share of it.
_SLACK = 1e-9
_ROWS = 8192


def to_whole(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component x as double; only vectors of ``dim`` finite components stay."""
    e = F.col("embedding")
    fine = F.coalesce(F.size(e) == dim, F.lit(False)) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    # a double keeps every floor exactly; past 2**53 all doubles are whole
    def whole(x: Column) -> Column:
        y = x.cast("double") * float(scale)
        return F.when(F.abs(y) < 2.0 ** 53, F.floor(y).cast("double")).otherwise(y)
    return vectors.where(fine).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(e, whole).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of whole-numbered rows, each with each: exact in doubles while those suffice, else in whole numbers of any size."""
    most = 4.0 * x.shape[1] * max(np.abs(x).max(initial=0.0), np.abs(c).max(initial=0.0)) ** 2
    if most < _EXACT:
        return (x ** 2).sum(1)[:, None] - 2.0 * (x @ c.T) + (c ** 2).sum(1)
    return np.stack([_own(x, np.broadcast_to(row, x.shape)) for row in c], axis=1)


def _own(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distance of each row to the row beside it, exact."""
    if 4.0 * x.shape[1] * max(np.abs(x).max(initial=0.0), np.abs(c).max(initial=0.0)) ** 2 < _EXACT:
        return ((x - c) ** 2).sum(1)
    return np.array([sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for p, q in zip(x, c)], object)


def _root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the nearest centroid (ties: the smallest), and the distances to it and to the next."""
    d = squares(x, c)
    best = d.argmin(1)
    rows = np.arange(len(x))
    first = _root(d[rows, best])
    rest = d.astype(np.float64)
    rest[rows, best] = np.inf
    return best, first * (1 + _SLACK), np.sqrt(rest.min(1)) * (1 - _SLACK)


def step(x: np.ndarray, own: np.ndarray, up: np.ndarray, low: np.ndarray, old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Clusters and bounds after the centroids went from ``old`` to ``new``, and how many rows were compared with all."""
    drift = _root(_own(old, new)) * (1 + _SLACK)
    order = np.argsort(drift, kind="stable")
    top, second = drift[order[-1]], drift[order[-2]] if len(drift) > 1 else 0.0
    up = (up + drift[own]) * (1 + _SLACK)
    low = low - np.where(own == order[-1], second, top)
    low = np.where(np.isfinite(low), low - np.abs(low) * _SLACK, low)
    gap = squares(new, new).astype(np.float64)
    np.fill_diagonal(gap, np.inf)
    half = np.sqrt(gap.min(1)) * (0.5 - _SLACK)
    safe = np.maximum(low, half[own])
    open_ = np.flatnonzero(up >= safe)
    if len(open_):
        up = up.copy()
        up[open_] = _root(_own(x[open_], new[own[open_]])) * (1 + _SLACK)
        open_ = open_[up[open_] >= safe[open_]]
    if len(open_):
        own, low = own.copy(), low.copy()
        own[open_], up[open_], low[open_] = nearest(x[open_], new)
    return own, up, low, len(open_)


_STATE = "vec_id bigint, v array<double>, cluster int, was int, up double, low double"


def _first(c: np.ndarray):
    """mapInArrow function: (vec_id, v) to the state after the first comparison with all centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), _ROWS):
                part = batch.slice(i, _ROWS)
                own, up, low = nearest(_matrix(part.column(1), c.shape[1]), c)
                yield _state(part, own, np.full(len(own), -1), up, low)

    return run


def _next(old: np.ndarray, new: np.ndarray):
    """mapInArrow function: the state to the one after the centroids moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), _ROWS):
                part = batch.slice(i, _ROWS)
                was = part.column(2).to_numpy().astype(np.int64)
                low = part.column(5).to_numpy()
                own, up, new_low, _ = step(_matrix(part.column(1), new.shape[1]), was, part.column(4).to_numpy(), low, old, new)
                yield _state(part, own, was, up, new_low)

    return run


def _state(part: pa.RecordBatch, own: np.ndarray, was: np.ndarray, up: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
    cols = [part.column(0), part.column(1), pa.array(own.astype(np.int32)), pa.array(was.astype(np.int32)), pa.array(up), pa.array(low)]
    return pa.RecordBatch.from_arrays(cols, ["vec_id", "v", "cluster", "was", "up", "low"])


def _distances(c: np.ndarray):
    """mapInArrow function: (vec_id, v, cluster) to (vec_id, cluster, distance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), _ROWS):
                part = batch.slice(i, _ROWS)
                d = _own(_matrix(part.column(1), c.shape[1]), c[part.column(2).to_numpy()])
                if d.dtype == object and any(v >= 2 ** 63 for v in d):
                    raise OverflowError("a squared distance is beyond 64 bits")
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(d.astype(np.int64))], ["vec_id", "cluster", "distance"])

    return run


def _moves(k: int, dim: int):
    """mapInArrow function: (v, cluster, was) of moved vectors to what they change in counts (place 0) and sums, once a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 1), object)
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            # sums of so many rows are exact in doubles, or else in whole numbers of any size
            small = np.abs(x).max(initial=0.0) * len(x) < _EXACT
            x = np.hstack([np.ones((len(x), 1)), x]) if small else np.array([[1, *map(int, r)] for r in x], object)
            for ids, sign in ((batch.column(1).to_numpy(), 1), (batch.column(2).to_numpy(), -1)):
                for c in np.unique(ids[ids >= 0]):
                    total[c] += [sign * int(v) for v in x[ids == c].sum(0)]
        c, i = np.nonzero(total)
        values = pa.array([Decimal(int(v)) for v in total[c, i]], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(i.astype(np.int32)), values], ["c", "i", "x"])

    return run


def _changes(state: DataFrame, k: int, dim: int) -> list[tuple[int, int, int]]:
    """(centroid, place, change) of counts and sums; at most k * (dim + 1) rows reach the driver."""
    moved = state.where("cluster <> was").select("v", "cluster", "was").mapInArrow(_moves(k, dim), "c int, i int, x decimal(38,0)")
    return [(r["c"], r["i"], int(r["x"])) for r in moved.groupBy("c", "i").agg(F.sum("x").alias("x")).collect()]


def starts(vectors: DataFrame, clusters: int, salt: str) -> np.ndarray:
    """The vectors with the smallest sha256 of ``salt`` and vec_id, in that order; rows of one id in the order of their components."""
    key = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    rows = vectors.where("vec_id is not null").select(key.alias("h"), "v").orderBy("h", "v").limit(clusters).collect()
    return np.array([r["v"] for r in rows], float)


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, salt: str = "2:") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row per row of ``vectors``.

    ``vectors`` has ``vec_id`` and ``v``, ``dim`` whole numbers as doubles (see
    ``to_whole``); other columns are ignored.  Each round assigns every vector to the
    nearest centroid (ties: the smaller number) and moves centroids to the floored
    mean of theirs; empty ones stay.  Rows that share an id are vectors each; a null
    vec_id is assigned but is no start.  With fewer vectors than ``clusters`` each is a
    start.  An empty table, or one without any start, gives no
    rows.  Distances and
    inertias beyond 64 bits raise OverflowError.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "centroids")
    path = scratch.path(vectors.select("vec_id", "v"))
    base = spark.read.schema("vec_id bigint, v array<double>").parquet(path)
    c = starts(base, clusters, salt)
    if not len(c):
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    sums = np.zeros((len(c), dim + 1), object)
    now = scratch.path(base.mapInArrow(_first(c), _STATE))
    scratch.drop(path)
    for _ in range(rounds):
        state = spark.read.schema(_STATE).parquet(now)
        for i, place, change in _changes(state, len(c), dim):
            sums[i, place] += change
        new = np.array([[float(v // s[0]) for v in s[1:]] if s[0] else row for s, row in zip(sums, c)])
        then = scratch.path(state.mapInArrow(_next(c, new), _STATE))
        scratch.drop(now)
        now, c = then, new
    state = spark.read.schema(_STATE).parquet(now)
    out = scratch.table(state.select("vec_id", "v", "cluster").mapInArrow(_distances(c), "vec_id bigint, cluster int, distance bigint"))
    per = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"))
    inertia = {r["cluster"]: int(r["d"]) for r in per.collect()}  # a row a centroid
    if sum(inertia.values()) >= 2 ** 63:
        raise OverflowError("the inertia is beyond 64 bits")
    scratch.drop(now)

    def of_cluster(values: list[Column]) -> Column:
        return F.element_at(F.array(*values), F.col("cluster") + 1)

    digests = [F.sha2(F.lit(",".join(str(int(v)) for v in row)), 256) for row in c]
    return out.select("vec_id", "cluster", "distance", of_cluster([F.lit(inertia.get(i, 0)).cast("bigint") for i in range(len(c))]).alias("cluster_inertia"),
                      F.lit(sum(inertia.values())).cast("bigint").alias("inertia"), of_cluster(digests).alias("centroid_sha256"))
