"""Nearest neighbours by inner product: a block matrix join over int8 tiles with error bounds, and exact scores of what survives."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table

NEAREST = 20
#: Vectors in a tile, on the average at most. The grid sends 2 x queries x candidates / TILE vectors, and a cell holds 2 x TILE.
TILE = 4096
#: Rows of a tile that are multiplied at a time, and columns: sums of so many products of whole numbers up to 127 are exact in float32.
ROWS = 256
COLUMNS = 1024
HEAP = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vector (doubles) of the rows whose vector is neither null nor zero and holds neither nulls nor non-finite numbers."""
    vector = F.col("vector")
    frame = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("vector"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return frame.where(F.col("vec_id").isNotNull() & vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0))


def is_query(vec_id: Column) -> Column:
    return vec_id % 20 == 0


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows as whole numbers of at most 127 in absolute value, their scales, the lengths of what rounding leaves off, and those of the rows themselves.

    The numbers are kept as float32, in which products of int8 tiles of COLUMNS columns come out exact.
    """
    scale = np.abs(vectors).max(axis=1) / 127
    whole = np.rint(vectors / scale[:, None])
    return whole.astype(np.float32), scale, np.linalg.norm(vectors - whole * scale[:, None], axis=1), np.linalg.norm(vectors, axis=1)


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products row by row, summed in the order of the components."""
    total = np.zeros(len(left))
    for i in range(left.shape[1]):
        total += left[:, i] * right[:, i]
    return total


def thinned(ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Without repeated rows, and without those copies of a vector that k + 1 others of smaller ids precede: ties go to smaller ids, so no query can want them."""
    _, group = np.unique(vectors, axis=0, return_inverse=True)
    group = group.reshape(-1)
    by = np.lexsort((ids, group))
    by = by[np.concatenate([[True], (np.diff(group[by]) != 0) | (np.diff(ids[by]) != 0)])] if len(by) else by
    place = np.arange(len(by)) - np.searchsorted(group[by], group[by])
    keep = by[place <= k]
    return ids[keep], vectors[keep]


def tile_nearest(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its k nearest of the tile: query id, ids and scores, best first.

    |q.v - q'.v'| <= |q - q'| |v| + |q'| |v - v'|, with q' and v' as rounded. What is below the k-th greatest lower bound
    (k + 1-th, as a query may meet itself) by its own upper bound cannot be among the nearest; all else is computed anew in doubles.
    """
    ids, vectors = thinned(ids, vectors, k)
    q8, q_scale, q_off, q_norm = quantised(queries)
    v8, v_scale, v_off, v_norm = quantised(vectors)
    slack = 1 + 1e-9
    for first in range(0, len(queries), ROWS):
        part = slice(first, first + ROWS)
        near = sum((q8[part, i : i + COLUMNS] @ v8[:, i : i + COLUMNS].T).astype(np.float64) for i in range(0, v8.shape[1], COLUMNS)) * q_scale[part, None] * v_scale
        bound = (q_off[part, None] * v_norm + (q_norm[part] + q_off[part])[:, None] * v_off) * slack + 1e-12 * q_norm[part, None] * v_norm
        low, high = near - bound, near + bound
        if len(ids) > k + 1:
            least = np.partition(low, len(ids) - k - 1, axis=1)[:, len(ids) - k - 1]
            rows, columns = np.nonzero(high >= least[:, None])
        else:
            rows, columns = np.nonzero(np.ones_like(low, bool))
        other = query_ids[part][rows] != ids[columns]
        rows, columns = rows[other], columns[other]
        scores = np.concatenate([products(queries[part][rows[i : i + 65536]], vectors[columns[i : i + 65536]]) for i in range(0, len(rows), 65536)] or [np.zeros(0)])
        order = np.lexsort((ids[columns], -scores, rows))
        rows, columns, scores = rows[order], columns[order], scores[order]
        starts = np.searchsorted(rows, np.arange(len(queries[part]) + 1))
        for i in range(len(queries[part])):
            own = slice(starts[i], min(starts[i] + k, starts[i + 1]))
            yield int(query_ids[first + i]), ids[columns[own]], scores[own]


def nearest(vectors: DataFrame, query: Column, k: int = NEAREST, id_col: str = "vec_id", vector_col: str = "embedding", tile: int = TILE) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest of every row for which `query` (over vec_id) holds, exactly.

    Queries and candidates are dealt by hash over a grid of tiles whose number follows from the counts; each query goes to
    every column of the grid and each candidate to every row, so a cell's work and memory are bounded, and all rows meet
    all queries. The k best of each cell go to heaps, at most k rows for each query and column of the grid.
    Vectors that are null, zero, or hold nulls or non-finite numbers take no part, nor do rows without an id. Vectors of
    different lengths have no inner product: each length is searched by itself. Repeated rows count
    once. Queries that share an id answer together, and are not candidates of each other. An empty table gives an empty result.
    """
    rows = usable(vectors, id_col, vector_col)
    n, queries = rows.agg(F.count("*"), F.count_if(query)).first()
    down, across = max(1, -(-queries // tile)), max(1, -(-n // tile))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, ends = batch.column(1).flatten().to_numpy().astype("<f8"), np.cumsum(pc.list_value_length(batch.column(1)).to_numpy())
            parts = [x.tobytes() for x in np.split(flat, ends[:-1])] if len(ends) else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.binary())], names=["vec_id", "packed"])

    packed = rows.select("vec_id", "vector").mapInArrow(pack, "vec_id long, packed binary").withColumn("size", F.octet_length("packed"))
    place = lambda parts: F.pmod(F.xxhash64("vec_id", "packed"), F.lit(parts)).cast("int")
    spread = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = packed.where(query).withColumn("y", place(down)).withColumn("x", spread(across)).select("size", "y", "x", "vec_id", "packed", F.lit(True).alias("query"))
    right = packed.withColumn("x", place(across)).withColumn("y", spread(down)).select("size", "y", "x", "vec_id", "packed", F.lit(False).alias("query"))

    def cell(batch: pa.Table) -> pa.Table:
        asks, size = batch.column("query").combine_chunks(), batch.column("size")[0].as_py() // 8
        sides = []
        for side in (batch.filter(asks), batch.filter(pc.invert(asks))):
            ids = side.column("vec_id").to_numpy()
            sides += [ids, np.frombuffer(b"".join(side.column("packed").to_pylist()), "<f8").reshape(len(ids), size)]
        found = list(tile_nearest(*sides, k)) if len(sides[0]) and len(sides[2]) else []
        out = [np.concatenate([np.full(len(v), q) for q, v, _ in found] or [[]]).astype(np.int64), np.concatenate([v for _, v, _ in found] or [[]]).astype(np.int64), np.concatenate([s for _, _, s in found] or [[]]).astype(np.float64)]
        return pa.table([pa.array(c) for c in out], names=["query_id", "vec_id", "score"])

    grid = left.unionAll(right).groupBy("size", "y", "x").applyInArrow(cell, HEAP)

    def heaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A heap of k for each query of the partition, its worst on top."""
        held: dict[int, list[tuple[float, int]]] = {}
        for batch in batches:
            for q, v, score in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                heap, own = held.setdefault(q, []), (score, -v)
                if len(heap) < k:
                    if own not in heap:
                        heapq.heappush(heap, own)
                elif own > heap[0] and own not in heap:
                    heapq.heapreplace(heap, own)
        rows = [(q, i, -v, score) for q, heap in held.items() for i, (score, v) in enumerate(sorted(heap, reverse=True), 1)]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["query_id", "rank", "vec_id", "score"])

    return grid.repartition("query_id").mapInArrow(heaps, "query_id long, rank int, vec_id long, score double")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row whose id is divisible by 20, among all others; rows without a usable vector take no part."""
    return nearest(table(spark, sf_dir, "embeddings"), is_query(F.col("vec_id")))


OP7_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
