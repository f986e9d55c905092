"""Exact top-k search by inner product over an impact-ordered index (operator 12).

Vectors are lists of integers; the score of a candidate is its inner product with the query. The query's k best candidates are wanted, ties to the
smaller id.

The index: candidates are dealt into blocks. In a block each component has a list of postings, ordered by the component's value and cut
into at most LEVELS segments of equal width of values: the quantised impact. Counted from the component's least value (where the query's number is
negative: from its greatest), what a posting adds to a score is never negative, and its segment says between which two numbers it lies.

The search is score-at-a-time: the segments of all components are processed by descending quantised impact (the query's number times the
segment's), each adding its lower bound to the accumulators of its postings. Queries of a block go through it together (ACCUMULATORS rows times queries at once): a
segment's impact is the greatest that it has for one of them, and a posting adds to the accumulators of all in one row. At any time a candidate's score lies between its accumulator and
that plus, for each component, the most that is still to come: the greatest impact not yet processed, or the width of a segment where that is more. Candidates
whose upper bound is below the k-th greatest accumulator are proved to be no members. Processing stops when the possible members
are few (FEW for each of k, over the queries that go together) or when no segment is left; then the possible members, however many, are rescored from their whole
integers. So results are exact at any number of segments and wherever it stops. Each query's best of all blocks are merged by a window.

Vectors that are null or hold a null or non-finite component take no part, nor do null ids. Vectors of different lengths are not compared; empty ones
compare with each other, with score 0. A row repeated with the same id and numbers counts once; rows with one id and different numbers are
different rows. Scores beyond 63 bits end at the greatest or least long (of
more than k such candidates, which ones are named is not defined). Other columns, of any name, are not read. An empty table gives no rows.

A block has about BLOCK_BYTES of numbers; there are at least as many as shuffle partitions, if that leaves LEAST rows in each. Copies of one vector are
different candidates and are dealt out by their ids as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from figshelf.llm.common import bounded_batches, col, parts, written

K, EVERY, LEVELS, FEW, BLOCK_BYTES, LEAST = 10, 100, 64, 8, 4 << 20, 4096
#: Accumulators that a task holds at once (rows of a block times queries), postings that are added at once, and accumulators of which one stands for all in a bar.
ACCUMULATORS, POSTINGS, GROUP = 2 << 20, 512, 16
SCALE = 1024
LONG = np.iinfo(np.int64)
INDEX = "dim int, cb long, component int, postings array<int>, ends array<int>, values array<long>"
#: Rows of the index that are no component's: the ids and hashes of a block's rows, in values.
IDS, HASHES = -1, -2


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """Each component x as floor(scale * x), in double precision."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))


@dataclass
class Component:
    """One component's postings in a block: local row numbers by value, the ends of the segments, all rows' values."""

    postings: np.ndarray
    ends: np.ndarray
    values: np.ndarray

    @property
    def least(self) -> int:
        return int(self.values[self.postings[0]])

    @property
    def most(self) -> int:
        return int(self.values[self.postings[-1]])

    @property
    def width(self) -> int:
        return segment_width(self.least, self.most, len(self.ends))


def segment_width(least: int, most: int, levels: int) -> int:
    return -(-(most - least + 1) // levels)


def postings_of(values: np.ndarray, levels: int = LEVELS) -> Component:
    order = np.argsort(values, kind="stable")
    least, most = int(values[order[0]]), int(values[order[-1]])
    levels = min(levels, most - least + 1)
    width = segment_width(least, most, levels)
    edges = [min(least + (k + 1) * width, LONG.max) for k in range(levels)]
    ends = np.searchsorted(values[order], np.array(edges, np.int64)).astype(np.int32)
    ends[-1] = len(values)
    return Component(order.astype(np.int32), ends, values)


def block_index(rows: pa.Table, levels: int) -> pa.Table:
    """The rows of INDEX of one block of rows (dim, cb, id, h, v)."""
    dim, cb = rows["dim"][0].as_py(), rows["cb"][0].as_py()
    flat = rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(rows.num_rows, dim)
    made = [(IDS, [], [], rows["id"].to_numpy()), (HASHES, [], [], rows["h"].to_numpy())]
    for c in range(dim):
        x = postings_of(np.ascontiguousarray(flat[:, c]), levels)
        made.append((c, x.postings, x.ends, x.values))
    n, lists = len(made), list(zip(*made))
    ints = [pa.array(list(x), pa.list_(pa.int32())) for x in lists[1:3]]
    return pa.table([pa.array([dim] * n, pa.int32()), pa.array([cb] * n, pa.int64()), pa.array(lists[0], pa.int32()), *ints, pa.array(list(lists[3]), pa.list_(pa.int64()))], ["dim", "cb", "component", "postings", "ends", "values"])


def impact_index(rows: DataFrame, n_blocks: int, levels: int = LEVELS) -> DataFrame:
    """The index of rows (id, h, v, dim) in n_blocks blocks, a row a component."""
    dealt = rows.withColumn("cb", F.pmod(F.xxhash64("id", "h"), F.lit(n_blocks)).cast("long"))
    return dealt.select("dim", "cb", "id", "h", "v").groupBy("dim", "cb").applyInArrow(lambda block: block_index(block, levels), INDEX)


class Block:
    """A block's index, as a query sees it."""

    def __init__(self, index: pa.Table):
        at = {c: k for k, c in enumerate(index["component"].to_pylist())}
        numbers = lambda name, k: index[name][k].values.to_numpy()
        self.ids, self.hashes = numbers("values", at[IDS]), numbers("values", at[HASHES])
        self.components = [Component(*(numbers(name, at[c]) for name in ("postings", "ends", "values"))) for c in range(len(at) - 2)]
        self.by_id = np.argsort(self.ids, kind="stable")
        self.least = [c.least for c in self.components]
        self.most = [c.most for c in self.components]
        self.width = [c.width for c in self.components]

    def rows_of(self, i: int, h: int) -> np.ndarray:
        """The rows with this id and hash."""
        a, b = (np.searchsorted(self.ids, i, side, sorter=self.by_id) for side in ("left", "right"))
        rows = self.by_id[a:b]
        return rows[self.hashes[rows] == h]

    def greatest(self, query: list[int]) -> int:
        """No accumulator, bound or score of this query exceeds this."""
        return sum(2 * abs(q) * max(abs(a), abs(b), 1) + abs(q) * w for q, a, b, w in zip(query, self.least, self.most, self.width))

    def best(self, query: list[int], k: int, own: np.ndarray, few: int = FEW) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows and scores of the k best but for own, best first, and how many rows were rescored."""
        return next(iter(self.best_of_many([query], k, [own], few)))[1:]

    def best_of_many(self, queries: list[list[int]], k: int, own: list[np.ndarray], few: int = FEW) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """(place of the query, then what `best` gives) for each query. Queries go together that have numbers of one kind, as many as ACCUMULATORS allow."""
        greatest = [self.greatest(q) for q in queries]
        for kind, over, limit in ((np.int32, -1, 1 << 30), (np.int64, 1 << 30, LONG.max // 2), (object, LONG.max // 2, None)):
            places = [j for j, g in enumerate(greatest) if g >= over and (limit is None or g < limit)]
            step = max(1, ACCUMULATORS // (len(self.ids) * (1 if kind is not object else 8)))
            for at in range(0, len(places), step):
                here = places[at : at + step]
                found = self._batch([queries[j] for j in here], k, [own[j] for j in here], few, kind, max(greatest[j] for j in here))
                yield from ((j, *x) for j, x in zip(here, found))

    def _batch(self, queries: list[list[int]], k: int, own: list[np.ndarray], few: int, kind: type, greatest: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """What `best` gives for some queries: a posting's impact is the greatest that it has for one of them, and a segment adds to the accumulators of all."""
        n, m, whole = len(self.ids), len(queries), object if kind is object else np.int64
        acc = np.zeros((n, m), kind)
        for j, rows in enumerate(own):
            acc[rows, j] = -1 - greatest  # it stays negative; others never are
        used = [SharedList(x, [q[c] for q in queries], kind) for c, x in enumerate(self.components) if self.most[c] > self.least[c] and any(q[c] for q in queries)]
        top, added = max((int(max(x.impact)) for x in used), default=0), 0
        while True:
            for x in used:  # all segments of an impact of top or more that are left
                added += x.add(acc, top)
            last = top <= 1
            if last or 4 * added >= n * len(used):
                added = 0
                bars = best_bars(acc, min(k, n))
                mask = acc >= np.maximum(bars - sum((x.to_come() for x in used), np.zeros(m, kind)), 0)
                if last or np.count_nonzero(mask) <= few * k * m:
                    break
            top //= 2
        at, rows = np.nonzero(mask.T)
        numbers = np.array(queries, whole).reshape(m, -1)
        scores = np.zeros(len(rows), whole)
        for c, x in enumerate(self.components):
            scores += x.values[rows].astype(whole) * numbers[at, c]
        ends = np.searchsorted(at, np.arange(m + 1))
        for a, b in zip(ends, ends[1:]):
            possible, s = rows[a:b], scores[a:b]
            order = np.lexsort((self.ids[possible], -s))[:k] if whole is not object else np.array(sorted(range(b - a), key=lambda i: (-s[i], self.ids[possible[i]]))[:k], np.int64)
            yield possible[order], s[order], int(b - a)


class SharedList:
    """One component's postings as several queries go through them: from the greatest value down and, for queries whose number is negative, from the least up."""

    def __init__(self, x: Component, numbers: list[int], kind: type):
        self.list, self.segments, span = x, len(x.ends), x.most - x.least
        exact = object if kind is object else np.int64
        q = np.array(numbers, exact)
        up, down = np.maximum(q, 0), np.maximum(-q, 0)
        # the least and most that a segment's values lie above the least value, and below the greatest
        above = [(s * x.width, min(span, (s + 1) * x.width - 1)) for s in range(self.segments)]
        column = lambda values: np.array(values, exact)[:, None]
        low_up, high_up = (column([a[i] for a in above]) for i in (0, 1))
        low_down, high_down = (column([max(0, span - a[i]) for a in above]) for i in (1, 0))
        self.low = (low_up * up + low_down * down).astype(kind)
        self.high = (high_up * up + high_down * down).astype(kind)
        self.slack = ((x.width - 1) * np.abs(q)).astype(kind)
        self.impact = self.low.max(axis=1)
        self.level = np.repeat(np.arange(self.segments), np.diff(np.append(0, x.ends)))
        self.left = (0, self.segments)  # the segments that are not processed are neighbours: impact falls and then rises

    def add(self, acc: np.ndarray, top: int) -> int:
        """Add to the accumulators what the segments of an impact of top or more are sure to add; how many postings they have."""
        a, b = self.left
        under = a + np.flatnonzero(self.impact[a:b] < max(top, 1))
        first, end = (int(under[0]), int(under[-1]) + 1) if len(under) else (b, b)
        self.left, at, added = (first, end), np.append(0, self.list.ends), 0
        for lo, hi in ((at[a], at[first]), (at[end], at[b])):
            added += int(hi - lo)
            for k in range(lo, hi, POSTINGS):
                until = min(k + POSTINGS, hi)
                acc[self.list.postings[k:until]] += self.low[self.level[k:until]]
        return added

    def to_come(self) -> np.ndarray:
        """The most that this component can still add to each query's accumulators."""
        a, b = self.left
        return np.maximum(self.slack, np.maximum(self.high[a], self.high[b - 1])) if a < b else self.slack


def best_bars(acc: np.ndarray, wanted: int) -> np.ndarray:
    """For each query a number that at least `wanted` accumulators reach: of whole accumulators or, where there are many, of the greatest of every GROUP."""
    n, m = acc.shape
    if n >= GROUP * wanted * 8:
        acc = acc[: n // GROUP * GROUP].reshape(-1, GROUP, m).max(axis=1)
    return np.partition(acc, len(acc) - wanted, axis=0)[len(acc) - wanted]


def search_block(queries: pa.Table, index: pa.Table, k: int) -> pa.Table:
    """The k best of one block for each of the queries (id, h, v)."""
    ids, hashes, found, scores = [], [], [], []
    if queries.num_rows and index.num_rows:
        block = Block(index)
        asked = list(zip(queries["id"].to_pylist(), queries["h"].to_pylist()))
        for j, rows, s, _ in block.best_of_many(queries["v"].to_pylist(), k, [block.rows_of(*x) for x in asked]):
            ids += [asked[j][0]] * len(rows)
            hashes += [asked[j][1]] * len(rows)
            found += block.ids[rows].tolist()
            scores += [min(max(int(x), LONG.min), LONG.max) for x in s]
    return pa.table({"query_id": pa.array(ids, pa.int64()), "h": pa.array(hashes, pa.int64()), "vec_id": pa.array(found, pa.int64()), "score": pa.array(scores, pa.int64())})


def top_scores(vectors: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, block: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of greatest inner product of every row whose id is divisible by `every`.

    Components are taken as floor(scale * x). block: rows a block, if not by BLOCK_BYTES.
    """
    bounded_batches(vectors.sparkSession)
    v = col(vector_col)
    good = vectors.where(col(id_col).isNotNull() & usable(v)).select(col(id_col).cast("long").alias("id"), whole_numbers(v, scale).alias("v"))
    rows = written(good.withColumn("h", F.xxhash64("v")).groupBy("id", "h").agg(F.first("v").alias("v")).withColumn("dim", F.size("v")), "impact-rows")
    n_rows, n_asked, longest = rows.agg(F.count(F.lit(1)), F.count_if(F.col("id") % every == 0), F.max("dim")).first()
    wide = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = block or max(LEAST, BLOCK_BYTES // (8 * (longest or 1)))
    n_blocks, n_query = max(parts(n_rows, most), min(wide, parts(n_rows, LEAST))), parts(n_asked, most)
    index = written(impact_index(rows, n_blocks), "impact-index")
    cells = index.withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_query - 1).cast("long"))))
    asked = rows.where(F.col("id") % every == 0).withColumn("qb", F.pmod(F.xxhash64("id", "h"), F.lit(n_query)).cast("long"))
    asks = asked.withColumn("cb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    key = ["dim", "qb", "cb"]
    found = asks.groupBy(key).cogroup(cells.groupBy(key)).applyInArrow(lambda a, b: search_block(a, b, k), "query_id long, h long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "h").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_exact_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_scores(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP12_SQL = """
WITH e AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE vec_id IS NOT NULL
    AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (SELECT q.vec_id AS query_id, q.v AS qv, c.vec_id, coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), 0) AS score FROM e q JOIN e c ON len(q.v) = len(c.v)
    AND (q.vec_id <> c.vec_id OR q.v <> c.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, qv ORDER BY score DESC, vec_id) AS n FROM p)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE n <= 10
"""
