"""Exact top-k search by inner product as a Voronoi join.

Pivots drawn from the data, more of them for a larger table, cut it into cells (nearest pivot); queries are dealt to
the same cells. From summaries alone - the k + 1 ids nearest to each pivot with their
distances, the radius of a cell's queries - follow, for the queries of
cell i, a lower bound of the k-th best score and, for every data cell j, the least
distance from pivot j from which a vector can still reach it:

    q.x <= p_i.p_j + r_i |p_j| + f (|p_i| + r_i)

(r_i: radius of the queries of i, f: distance of x from p_j). The k-th best score is
taken from the bounds of k + 1 different ids, as one of them may be the query's own.
Only such vectors are
sent to the query blocks of cell i. A block holds up to ``QUERIES`` queries, its
data are dealt to slices, each slice is solved exactly, and the slices'
best k are merged. In high dimensions the bounds let most vectors through; then
every block still meets every vector just once, slice by slice.

Vectors are integer arrays. Null vectors, those with null components, and empty
ones take no part; only vectors of equal length meet; ties go to the smaller id; a
query meets every row but those of its own id; repeated rows are candidates as often as
they occur; a query row that occurs several times is one query, rows of one id with different
vectors are queries of their own; queries with fewer candidates return all; scores beyond
64 bits are cut off at the largest and smallest long; extra columns are ignored; without
vectors or queries the result is empty.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

#: Least and greatest number of pivots, queries of a block, vectors of a slice.
PIVOTS, QUERIES, SLICE = (16, 512), 4096, 20_000


def quantise(column: str, scale: int = 1024) -> Column:
    """floor(scale * x) of each component as long; null if the vector is null or has a null or non-finite component."""
    odd = F.exists(column, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(F.col(column).isNotNull() & ~F.coalesce(odd, F.lit(False)), F.transform(column, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: through floating point where every sum fits its mantissa, through big integers where one may not fit a long."""
    x, y = a.astype(float), b.astype(float)
    most = np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * a.shape[1]
    if most < 2**53:
        return (x @ y.T).astype(np.int64)
    if most < 2**62:
        return a @ b.T
    low, high = np.iinfo(np.int64).min + 1, np.iinfo(np.int64).max
    return np.clip(a.astype(object) @ b.T.astype(object), low, high).astype(np.int64)


def _nearest(v: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v, p = v.astype(float), pivots.astype(float)
    d = (v**2).sum(1)[:, None] - 2 * v @ p.T + (p**2).sum(1)[None, :]
    cell = d.argmin(1)
    return cell, np.sqrt(((v - p[cell]) ** 2).sum(1))


def _bounds(pivots: np.ndarray, near: list[tuple[int, object, float]], radius: dict[int, float], k: int) -> np.ndarray:
    """least[i, j]: vectors of cell j nearer to their pivot than this cannot be among the k best of a query of cell i; inf where i has no queries. near: (cell, id, distance)."""
    p = pivots.astype(float)
    norm, dots = np.sqrt((p**2).sum(1)), p @ p.T
    least = np.full((len(p), len(p)), np.inf)
    for i, r in radius.items():
        low: dict = {}
        for j, x, f in near:
            low[x] = max(low.get(x, -np.inf), dots[i, j] - r * norm[j] - f * (norm[i] + r))
        floor = sorted(low.values(), reverse=True)[k] if len(low) > k else -np.inf
        slack = 1e-9 * (1 + abs(floor) + norm[i] * norm.max() if np.isfinite(floor) else 1) + 1e-6
        least[i] = (floor - dots[i] - r * norm) / max(norm[i] + r, 1e-12) - slack
    return least


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 10) -> DataFrame:
    """vectors and queries: vec_id, v (array of long). Per query and rank: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    ok = F.col("v").isNotNull() & (F.size("v") > 0) & F.col("vec_id").isNotNull() & ~F.coalesce(F.exists("v", lambda x: x.isNull()), F.lit(False))
    vectors = written(vectors.where(ok).select("vec_id", "v"), "vectors")
    queries = written(queries.where(ok).select("vec_id", "v").distinct().withColumn("qh", F.xxhash64("v")), "queries")
    kind = vectors.schema["vec_id"].dataType.simpleString()
    dims = [r["d"] for r in queries.select(F.size("v").alias("d")).distinct().collect()]
    found = [_one_length(spark, vectors.where(F.size("v") == d), queries.where(F.size("v") == d), k, kind) for d in sorted(dims)]
    if not found:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score long")
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    order = Window.partitionBy("query_id", "qh").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _one_length(spark, vectors: DataFrame, queries: DataFrame, k: int, kind: str) -> DataFrame:
    rows = vectors.count()
    some = min(max(math.isqrt(rows) // 4, PIVOTS[0]), PIVOTS[1])
    drawn = vectors.dropDuplicates(["vec_id"]).orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").limit(some).collect()
    pivots = np.unique(np.array([r["v"] for r in drawn], np.int64).reshape(len(drawn), -1), axis=0) if drawn else np.zeros((0, 0), np.int64)
    if not len(pivots):
        return spark.createDataFrame([], f"query_id {kind}, qh long, vec_id {kind}, score long")

    def place(batches):
        for batch in batches:
            cell, far = _nearest(_matrix(batch.column(1)), pivots) if batch.num_rows else (np.zeros(0, int), np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far)], [*batch.schema.names, "cell", "far"])

    data = written(vectors.mapInArrow(place, f"vec_id {kind}, v array<long>, cell int, far double"), "cells")
    asked = written(queries.mapInArrow(place, f"vec_id {kind}, v array<long>, qh long, cell int, far double"), "asked")
    order = Window.partitionBy("cell").orderBy("far")
    near = [(r["cell"], r["vec_id"], r["far"]) for r in data.groupBy("cell", "vec_id").agg(F.min("far").alias("far")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).collect()]
    groups = {r["cell"]: (r["r"], r["n"]) for r in asked.groupBy("cell").agg(F.max("far").alias("r"), F.count("*").alias("n")).collect()}
    least = _bounds(pivots, near, {i: r for i, (r, _) in groups.items()}, k)
    # Query blocks: neighbouring small cells share one, a large cell is split.
    block_of, limits, room = {}, [], 0
    for i in sorted(groups):
        n = groups[i][1]
        split = -(-n // QUERIES)
        if split > 1 or room < n:
            block_of[i] = (len(limits), split)
            limits += [least[i]] * split
            room = QUERIES - n if split == 1 else 0
        else:
            block_of[i] = (len(limits) - 1, 1)
            limits[-1] = np.minimum(limits[-1], least[i])
            room -= n
    table = np.array(limits)
    slices = max(12, -(-rows // SLICE))
    slot = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(slices)).cast("int")

    def replicate(batches):
        for batch in batches:
            cell, far = np.asarray(batch.column(2)), np.asarray(batch.column(3))
            row, block = np.nonzero(far[:, None] >= table[:, cell].T)
            pick = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), pa.array(block.astype(np.int32)), batch.column(4).take(pick)], ["vec_id", "v", "block", "slice"])

    spread = data.withColumn("slice", slot).mapInArrow(replicate, f"vec_id {kind}, v array<long>, block int, slice int")
    first = F.create_map(*[F.lit(x) for i, b in block_of.items() for x in (i, b[0])])[F.col("cell")]
    split = F.create_map(*[F.lit(x) for i, b in block_of.items() for x in (i, b[1])])[F.col("cell")]
    asked = asked.withColumn("block", (first + F.pmod(F.xxhash64("vec_id", "qh"), split)).cast("int")).select("vec_id", "v", "qh", "block", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", left.schema.field("vec_id").type), ("qh", pa.int64()), ("vec_id", left.schema.field("vec_id").type), ("score", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        q_ids, qh, ids = np.asarray(left.column("vec_id")), np.asarray(left.column("qh")), np.asarray(right.column("vec_id"))
        q, x = _matrix(left.column("v")), _matrix(right.column("v"))
        out = []
        for lo in range(0, len(q_ids), 256):
            s = _inner(q[lo : lo + 256], x)
            own = q_ids[lo : lo + 256, None] == ids[None, :]
            lowest = np.iinfo(np.int64).min
            s[own] = lowest
            cut = np.partition(s, max(len(ids) - k, 0), axis=1)[:, max(len(ids) - k, 0)]
            row, col = np.nonzero((s >= cut[:, None]) & ~own)
            best = np.lexsort((ids[col], -s[row, col], row))
            row, col = row[best], col[best]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            row, col = row[rank < k], col[rank < k]
            out.append((q_ids[lo + row], qh[lo + row], ids[col], s[row, col]))
        return pa.table([pa.array(np.concatenate([o[i] for o in out])) for i in range(4)], schema=schema)

    return asked.groupBy("block", "slice").cogroup(spread.groupBy("block", "slice")).applyInArrow(solve, f"query_id {kind}, qh long, vec_id {kind}, score long")
