"""Nearest neighbours by a block matrix join on int8 tiles (operator 1).

Queries are the rows whose id is divisible by `every`; candidates are all rows but the query's own. Both
are dealt into blocks, and every pair of a query block and a candidate block is one cell, worked by one
task. In a cell each vector x is held as s * q with q in int8, and the length of what that leaves out,
e(x), is kept. An int8 tile product gives every inner product up to |x| e(y) + e(x) (|y| + e(y)), hence a lower
and an upper bound of every squared distance. A pair goes on only if its lower bound does not exceed the
k-th least upper bound of its query so far; these are recomputed from the original components in double
precision and kept in a heap of k per query. The heaps of a query's cells are merged by a window. The
bounds hold for every pair, so no neighbour is lost: recall is 1 by construction.

Vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do null ids.
Vectors of different lengths are not compared. A row repeated with the same id and vector counts once;
rows with one id and different vectors are different rows. Ties go to the smaller id. Other columns are not read.

A block holds about BLOCK_BYTES of components, so its rows follow from the longest vector; there are at least as
many candidate blocks as shuffle partitions, if that leaves LEAST rows in each. The work grows as queries times rows,
which is what the query asks; a candidate travels once per query block, so larger blocks move less.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from figshelf.llm.common import bounded_batches, col, parts, written

K, EVERY, BLOCK_BYTES, LEAST, TILE = 10, 100, 32 << 20, 1024, 2048


class Quantised:
    """Vectors as int8 with a scale each, and how far off that is."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.scale = np.abs(x).max(1) / 127.0
        self.scale[self.scale == 0] = 1.0  # a subnormal maximum
        self.q = np.clip(np.rint(x / self.scale[:, None]), -127, 127).astype(np.int8)
        self.norm = np.sqrt((x * x).sum(1))
        off = x - self.q * self.scale[:, None]
        self.off = np.sqrt((off * off).sum(1)) * (1 + 1e-9)


def bounds(a: Quantised, b: Quantised, rows: slice, cols: slice) -> tuple[np.ndarray, np.ndarray]:
    """A lower and an upper bound of each squared distance of a tile."""
    # sums of products of int8 are integers below 2**24 up to 1,040 components: float32 is exact there
    kind = np.float32 if a.q.shape[1] <= 1040 else np.float64
    dot = (a.q[rows].astype(kind) @ b.q[cols].astype(kind).T).astype(np.float64)
    dot *= a.scale[rows, None] * b.scale[None, cols]
    an, bn = a.norm[rows, None], b.norm[None, cols]
    slack = an * b.off[None, cols] + a.off[rows, None] * (bn + b.off[None, cols])
    size = an * an + bn * bn
    middle, slack = size - 2 * dot, 2 * slack + 1e-9 * size
    return middle - slack, middle + slack


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of pairs of rows, summed component by component."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        step = a[:, k] - b[:, k]
        total += step * step
    return np.sqrt(total)


def nearest_in_cell(queries: tuple[np.ndarray, np.ndarray, np.ndarray], rows: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> list[tuple[int, float, int]]:
    """(query number, distance, id) of each query's k nearest. queries, rows: ids, vector hashes, vectors."""
    (qid, qhash, q), (cid, chash, c) = queries, rows
    a, b = Quantised(q), Quantised(c)
    heaps: list[list[tuple[float, int]]] = [[] for _ in qid]
    for top in range(0, len(qid), TILE):
        r = slice(top, top + TILE)
        least = np.full((len(qid[r]), k), np.inf)  # the k least upper bounds of each query so far
        for left in range(0, len(cid), TILE):
            s = slice(left, left + TILE)
            low, high = bounds(a, b, r, s)
            own = (qid[r, None] == cid[None, s]) & (qhash[r, None] == chash[None, s])
            high[own] = np.inf
            least = np.partition(np.concatenate((least, np.where(np.isnan(high), np.inf, high)), 1), k - 1, axis=1)[:, :k]
            i, j = np.nonzero(~(low > least.max(1)[:, None]) & ~own)
            for n, d, v in zip((i + top).tolist(), distance(q[i + top], c[j + left]).tolist(), cid[j + left].tolist()):
                heap = heaps[n]
                if len(heap) < k:
                    heapq.heappush(heap, (-d, -v))
                elif (-d, -v) > heap[0]:
                    heapq.heapreplace(heap, (-d, -v))
    return [(n, -d, -v) for n, heap in enumerate(heaps) for d, v in heap]


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding", block: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of every row whose id is divisible by `every`."""
    bounded_batches(vectors.sparkSession)
    v = col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    good = vectors.where(col(id_col).isNotNull() & v.isNotNull() & fine).select(col(id_col).cast("long").alias("id"), v.alias("v"))
    rows = written(good.withColumn("h", F.xxhash64("v")).groupBy("id", "h").agg(F.first("v").alias("v")).withColumn("dim", F.size("v")), "vectors")
    asked = rows.where(F.col("id") % every == 0)
    n_rows, n_asked, longest = rows.agg(F.count(F.lit(1)), F.count_if(F.col("id") % every == 0), F.max("dim")).first()
    wide = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = block or max(LEAST, BLOCK_BYTES // (8 * (longest or 1)))
    n_cand, n_query = max(parts(n_rows, most), min(wide, parts(n_rows, LEAST))), parts(n_asked, most)
    here = F.pmod(F.xxhash64("id", "h"), F.lit(n_cand))
    cands = rows.withColumn("cb", here).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_query - 1).cast("long"))))
    asks = asked.withColumn("qb", F.pmod(F.xxhash64("id", "h"), F.lit(n_query))).withColumn("cb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_cand - 1).cast("long"))))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        def arrays(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            flat = np.asarray(t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64)
            return t["id"].to_numpy(), t["h"].to_numpy(), flat.reshape(t.num_rows, -1)

        if not left.num_rows or not right.num_rows:
            found = []
        else:
            queries = arrays(left)
            found = nearest_in_cell(queries, arrays(right), k)
        n = [x[0] for x in found]
        ids, hashes = (queries[0][n], queries[1][n]) if found else ([], [])
        return pa.table({"query_id": pa.array(ids, pa.int64()), "h": pa.array(hashes, pa.int64()), "vec_id": pa.array([x[2] for x in found], pa.int64()), "score": pa.array([x[1] for x in found], pa.float64())})

    key = ["dim", "qb", "cb"]
    found = asks.groupBy(key).cogroup(cands.groupBy(key)).applyInArrow(cell, "query_id long, h long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "h").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP1_SQL = """
WITH e AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, q.v AS qv, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i])), lambda a, b: a + b)) AS score FROM e q JOIN e c ON len(q.v) = len(c.v)
    AND (q.vec_id <> c.vec_id OR q.v <> c.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, qv ORDER BY score, vec_id) AS n FROM p)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10
"""
