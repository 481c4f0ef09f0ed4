"""Approximate nearest neighbours by collision counting over query-centred windows.

The index of a block of vectors is one sorted array per random projection.  A query opens a window around
its own projection in every array; a vector inside the window of a projection collides there.  The radius grows by a
factor (virtual rehashing: nothing is built again, the windows just open further).  A vector whose collisions
reach the threshold is a candidate; a query stops growing once it has ``wanted`` candidates and
``share`` of the block, or has the whole block.  All candidates are verified on the
original vectors in double precision.

Largest inner product becomes least distance: vectors get one more coordinate that brings them all to the
largest norm of their block, queries get 0 there and the same norm (order by distance is then order by inner product).  A block
holds vectors of one norm class, a power of two wide, so that the lift does not make all distances alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .registry import query, table

PROJECTIONS = 128
#: Part of the projections in whose windows a candidate lies.
THRESHOLD = 0.7
GROWTH = 1.15
#: Part of a block inside the first window of each projection.
FIRST = 0.4
#: Part of a block that a query verifies, besides the neighbours it wants.
SHARE = 0.15
#: At most 65,535, as places are 16 bits wide.
BLOCK, QUERY_BLOCK = 16384, 4096


class Block:
    """Sorted projections of some vectors."""

    def __init__(self, vectors: np.ndarray, seed: int):
        self.vectors = vectors.astype(np.float64)
        # the search sees vectors of about unit size; scores are taken from the original ones
        unit = self.vectors / np.abs(self.vectors).max()
        squares = np.einsum("ij,ij->i", unit, unit)
        self.norm = float(np.sqrt(squares.max()))
        lift = np.sqrt(np.maximum(squares.max() - squares, 0.0))
        self.axes = np.random.default_rng(seed).standard_normal((vectors.shape[1] + 1, PROJECTIONS))
        projected = np.column_stack([unit, lift]) @ self.axes
        order = np.argsort(projected, axis=0, kind="stable")
        self.sorted = np.take_along_axis(projected, order, axis=0).T.copy()
        self.place = np.argsort(order, axis=0).T.astype(np.uint16).copy()  # of each vector in each sorted array

    def search(self, queries: np.ndarray, wanted: int, share: float = SHARE) -> list[np.ndarray]:
        """Row numbers of the candidates of each query."""
        n, need = len(self.vectors), int(np.ceil(THRESHOLD * PROJECTIONS))
        enough = min(n, wanted + int(np.ceil(share * n)))
        unit = queries / np.abs(queries).max(axis=1, keepdims=True)
        scaled = unit * (self.norm / np.linalg.norm(unit, axis=1, keepdims=True))
        centre = scaled @ self.axes[:-1]
        where = np.stack([np.searchsorted(s, c) for s, c in zip(self.sorted, centre.T, strict=True)], axis=1)
        reach = max(1, int(FIRST * n / 2))
        axis = np.arange(PROJECTIONS)
        ends = self.sorted[axis, np.minimum(where + reach, n - 1)] - centre, centre - self.sorted[axis, np.maximum(where - reach, 0)]
        radius = np.maximum(np.median((ends[0] + ends[1]) / 2, axis=1), 1e-9 * max(self.norm, 1e-300))
        widest = 4 * max(np.abs(self.sorted).max(), np.abs(centre).max(initial=0.0))
        found: list[np.ndarray] = [np.empty(0, np.int64)] * len(queries)
        growing = np.arange(len(queries))
        while growing.size:
            low = np.empty((growing.size, PROJECTIONS), np.int64)
            high = np.empty_like(low)
            for j in range(PROJECTIONS):
                low[:, j] = np.searchsorted(self.sorted[j], centre[growing, j] - radius[growing], side="left")
                high[:, j] = np.searchsorted(self.sorted[j], centre[growing, j] + radius[growing], side="right")
            width, low = (high - low).astype(np.uint16), low.astype(np.uint16)
            still = []
            for i, q in enumerate(growing):
                # A place is inside the window when it is less than the width away from its low end (unsigned).
                inside = (self.place - low[i][:, None]) < width[i][:, None]
                hits = np.flatnonzero(inside.view(np.uint8).sum(axis=0, dtype=np.uint8) >= need)
                if hits.size >= enough:
                    found[q] = hits
                elif not radius[q] < widest:
                    # every window holds the whole block
                    found[q] = np.arange(n)
                else:
                    still.append(q)
            growing = np.array(still, np.int64)
            radius[growing] *= GROWTH
        return found


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def search_block(vectors: pa.Table, queries: pa.Table, k: int, seed: int) -> pa.Table:
    """The best ``k`` of one block of vectors for one block of queries."""
    out = {"query_id": [], "vec_id": [], "score": []}
    if vectors.num_rows and queries.num_rows:
        block = Block(_matrix(vectors.column("v")), seed)
        ids = vectors.column("vec_id").to_numpy()
        asked, asked_ids = _matrix(queries.column("v")).astype(np.float64), queries.column("vec_id").to_numpy()
        for start in range(0, len(asked), 256):  # the counts of so many queries are held at a time
            some = asked[start : start + 256]
            # One more than wanted, as the query's own row takes part in the windows.
            for q, q_id, rows in zip(some, asked_ids[start : start + 256], block.search(some, k + 1), strict=True):
                rows = rows[ids[rows] != q_id]
                scores = np.einsum("ij,j->i", block.vectors[rows], q)
                best = np.lexsort((ids[rows], -scores))[:k]
                out["query_id"].append(np.full(len(best), q_id, np.int64))
                out["vec_id"].append(ids[rows][best])
                out["score"].append(scores[best])
    kinds = {"query_id": np.int64, "vec_id": np.int64, "score": np.float64}
    return pa.table({c: np.concatenate(v) if v else np.empty(0, kinds[c]) for c, v in out.items()})


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): rows that can take part, once each.

    Without part: null ids, null or empty vectors, null, infinite or NaN components, and vectors of zeros only.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    good = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & good)


def norm_class(vector: str) -> Column:
    """The power of two next to the norm; components are scaled first, so that no square is lost or overflows."""
    largest = F.array_max(F.transform(vector, F.abs))
    squares = F.aggregate(F.transform(vector, lambda x: x / largest), F.lit(0.0), lambda a, x: a + x * x)
    return F.round(F.log2(largest) + F.log2(squares) / 2).cast("int")


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 20, seed: int = 5, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found, by inner product, ties to the smaller id.

    Both inputs are (vec_id, v) as ``usable`` returns them.  A row never is its own query's
    neighbour, nor is another row with the same id; of queries with one id the least vector is asked.  Vectors meet only
    vectors of their own length.  Blocks are bounded and of one norm class; every block of queries meets every block of vectors, and
    per query and block only ``k`` rows leave a task.  No queries or no vectors give no rows.
    """
    asked = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    classed = vectors.withColumn("c", norm_class("v"))
    # one row per norm class: the exponents of doubles are some two thousand
    sizes = {r.c: r.n for r in classed.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = [(c, i) for c, n in sorted(sizes.items()) for i in range(max(1, -(-n // block)))]
    if not blocks:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    query_blocks = max(1, -(-asked.count() // query_block))
    per_class = F.create_map(*[F.lit(x) for c, n in sizes.items() for x in (c, max(1, -(-n // block)))])
    left = classed.withColumn("d", F.size("v")).withColumn("vb", F.pmod(F.xxhash64(F.lit(seed), "vec_id", "v"), per_class[F.col("c")]).cast("int"))
    left = left.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = asked.withColumn("d", F.size("v")).withColumn("qb", F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(query_blocks)).cast("int"))
    right = right.withColumn("__b", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(i).alias("vb")) for c, i in blocks])))
    right = right.select("vec_id", "v", "d", "qb", "__b.c", "__b.vb")
    found = left.groupBy("d", "c", "vb", "qb").cogroup(right.groupBy("d", "c", "vb", "qb")).applyInArrow(
        lambda a, b: search_block(a, b, k, seed), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query("op2_collision_counting")
def op2_collision_counting(spark, folder):
    vectors = usable(table(spark, folder, "embeddings"))
    return nearest(vectors.filter("vec_id % 20 = 0"), vectors)
