"""Exact top-k search (10): a Voronoi join on the inner product.

1. Pivots are a bounded sample of rows.  Every vector goes to the cell of its
   nearest pivot; a cell's summary is its size, radius (greatest distance to the
   pivot) and greatest norm.  For a query q and a cell with pivot p, radius r and
   norm m, no product is above q.p + |q| r, nor above |q| m.
2. Each query is solved in the cell where it lies.  Its k-th score is a bound: only
   cells whose summary allows as much are visited, and the query is copied to
   those alone.
3. Cells are stored in chunks of bounded size; a cell that holds a third of all
   rows is many tasks.  The queries that visit a cell come in blocks of bounded
   size, and a cell's rows are sent once for each of its own blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, apart

K, CHUNK, BLOCK, PIVOTS = 5, 8192, 16_384, 256
#: Sums of products below this are exact in doubles.
_EXACT = 2.0 ** 53


def to_integers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x), x as double; vectors null or with a null or non-finite component go."""
    e = F.col("embedding")
    fine = e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(fine & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(e, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, padded with zeros to ``dim``."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim))
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes]) if len(sizes) else []] = flat
    return out


def _assign(pivots: np.ndarray):
    """mapInArrow function: row, vec_id, v, q to those with cell, distance to the pivot and norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares = (pivots ** 2).sum(1)
        for batch in batches:
            x = _matrix(batch.column(2), pivots.shape[1])
            cell, far = np.empty(len(x), np.int32), np.empty(len(x))
            for i in range(0, len(x), 4096):
                y = x[i:i + 4096]
                cell[i:i + 4096] = (squares - 2 * (y @ pivots.T)).argmin(1)
                far[i:i + 4096] = np.sqrt(((y - pivots[cell[i:i + 4096]]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far), pa.array(np.sqrt((x ** 2).sum(1)))], ["row", "vec_id", "v", "q", "cell", "far", "norm"])

    return run


def _visits(pivots: np.ndarray, radius: np.ndarray, norm: np.ndarray):
    """mapInArrow function: row, v, own cell, bound to (row, cell) of other cells that may hold as much."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), pivots.shape[1])
            mine, bound = batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
            size = np.sqrt((x ** 2).sum(1))[:, None]
            top = np.minimum(x @ pivots.T + size * radius, size * norm)
            top += 1e-9 * (size * (norm + radius)) + 1e-6  # more than rounding can take away
            hit = (top >= bound[:, None]) & (radius >= 0)[None, :]
            hit[np.arange(len(x)), mine] = False
            rows, cells = np.nonzero(hit)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(cells.astype(np.int32))], ["row", "cell"])

    return run


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers: in doubles while they are exact there, else in whole numbers; OverflowError beyond 64 bits."""
    most = np.abs(q).sum(1).max(initial=0.0) * np.abs(x).max(initial=0.0)
    if most < _EXACT:
        return q @ x.T
    whole = np.array([[int(v) for v in r] for r in q], object) @ np.array([[int(v) for v in r] for r in x], object).T
    if any(not -2 ** 63 <= v < 2 ** 63 for v in whole.flat):
        raise OverflowError("an inner product is beyond 64 bits")
    return whole


def _solve(k: int, dim: int):
    """Cogrouped function: the best of a chunk for each query of a block."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(queries: pa.Table, chunk: pa.Table) -> pa.Table:
        if not len(queries) or not len(chunk):
            return schema.empty_table()
        ids = chunk.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], _matrix(chunk.column("v").combine_chunks(), dim)[order]
        q_ids, q = queries.column("query_id").to_numpy(), _matrix(queries.column("w").combine_chunks(), dim)
        out = []
        for i in range(0, len(q), 512):
            s, mine = products(q[i:i + 512], x), q_ids[i:i + 512]
            own = mine[:, None] == ids[None, :]
            # ties stay in order of vec_id, own rows go last
            best = np.lexsort((-s, own), axis=1)[:, :k] if s.dtype != object else np.array(
                [sorted(range(len(ids)), key=lambda j: (o[j], -r[j]))[:k] for r, o in zip(s, own)])
            keep = ~np.take_along_axis(own, best, 1)
            out.append((np.broadcast_to(mine[:, None], best.shape)[keep], ids[best][keep], np.take_along_axis(s, best, 1)[keep].astype(np.int64)))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=schema)

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("*", F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query, k: int = K, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` greatest inner products, ties to smaller ids.

    ``vectors`` has vec_id and v (array of whole numbers as double); ``is_query``
    is a condition on it.  A row is no candidate for queries of its own vec_id.
    Rows that share an id are candidates each; queries that share one have one
    list.  Shorter vectors are padded with zeros.  Scores beyond 64 bits raise.
    Queries without candidates give no rows; an empty table gives an empty table;
    other columns are ignored.  At most ``pivots`` rows are collected.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "knn")
    base = scratch.table(vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", F.coalesce(is_query, F.lit(False)).alias("q")))
    n, dim = base.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    dim = max(dim, 1)
    m = int(max(1, min(pivots, round(n ** 0.5 / 4))))
    # the sample of pivots: the rows with the smallest hashes, at most ``pivots``; equal vectors once
    some = [r["row"] for r in base.select("row", F.xxhash64("v").alias("h")).orderBy("h", "row").limit(m).collect()]
    sample = base.where(F.col("row").isin(some)).select("v").collect()
    centres = np.unique(np.array([np.pad(np.asarray(r["v"], float), (0, dim - len(r["v"]))) for r in sample]), axis=0)
    cells = scratch.table(base.mapInArrow(_assign(centres), "row bigint, vec_id bigint, v array<double>, q boolean, cell int, far double, norm double"))
    summary = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("r"), F.max("norm").alias("m"), F.count_if("q").alias("nq")).collect()
    radius, norm, parts = np.full(len(centres), -1.0), np.zeros(len(centres)), np.ones(len(centres), int)
    for s in summary:
        radius[s["cell"]], norm[s["cell"]], parts[s["cell"]] = s["r"], s["m"], -(-s["n"] // CHUNK)

    def of_cell(values) -> Column:
        return F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("cell") + 1)

    key = ["cell", "chunk", "block"]

    def solved(asked: DataFrame, counts: dict[int, int]) -> DataFrame:
        """The best of the cells asked; ``asked`` has row, vec_id, v, cell."""
        blocks = [-(-counts.get(c, 0) // BLOCK) for c in range(len(centres))]
        q = asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("w"), F.col("cell").alias("cell"), F.pmod(F.xxhash64("row", F.lit(3)), F.greatest(of_cell(blocks), F.lit(1))).cast("int").alias("block"),
                         F.explode(F.sequence(F.lit(0), of_cell(parts) - 1)).alias("chunk"))
        data = cells.where(of_cell(blocks) > 0).select("vec_id", "v", "cell", F.pmod(F.xxhash64("row"), of_cell(parts)).cast("int").alias("chunk"),
                                                       F.explode(F.sequence(F.lit(0), of_cell(blocks) - 1)).alias("block"))
        return scratch.table(q.groupBy(*key).cogroup(data.groupBy(*key)).applyInArrow(_solve(k, dim), "query_id bigint, vec_id bigint, score bigint"))

    queries = cells.where("q").select("row", "vec_id", "v", "cell")
    first = solved(queries, {s["cell"]: s["nq"] for s in summary})
    bound = _best(first, k).where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("bound"))
    asked = queries.join(apart(bound), F.col("vec_id") == F.col("query_id"), "left").select("row", "v", "cell", F.coalesce("bound", F.lit(float("-inf"))).alias("bound"))
    visits = scratch.table(asked.mapInArrow(_visits(centres, radius, norm), "row bigint, cell int"))
    counts = {r["cell"]: r["n"] for r in visits.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a cell
    more = solved(visits.join(queries.drop("cell"), "row"), counts)
    return _best(first.unionByName(more), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
