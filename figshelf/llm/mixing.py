"""Mixing sources to target weights by a splitting tree of hypergeometric draws (operator 4).

Sizes count words `[^\\x20\\x09-\\x0D]+`. Sources in code-point order, null last, weigh 1, 2, 3, 1, ...
and share 100 % of all words; a target stops at MOST_EPOCHS times its source's size and the excess is
shared again by weight until none is above.

1. Each source's documents are dealt, by a hash of their ids, into blocks of about BLOCK_WORDS words;
   whole epochs go through them in an order of their own, by a keyed permutation. A source's quota is a number of block draws: its
   whole epochs, the blocks that fit into the rest, and one block of which only some documents fit.
2. A binary tree over the output shards splits the vector of all quotas: a node gives its left half a
   multivariate hypergeometric draw and its right half the rest, so the leaves add up exactly. A draw
   depends on the seed and the node only, so each task follows just the paths that its blocks need.
3. A source's draws go to the leaves in order: disjoint ranges of permuted blocks. Inside a shard the
   documents are ordered by a hash.
4. In the last block documents are taken largest first while they fit, and one more if that comes
   nearer: a source's words miss its target by at most half of the smallest document left there.

Null and empty texts have size 0 and are taken with their block, at no words. Rows with the same id, text and
source share a block and are one row with a count until the end, so a third of all rows may be alike. With no
words at all every target is 0. Documents are ordered by size, hash of the text and id, never by arrival, so reruns
agree whatever the partitioning. Blocks grow beyond BLOCK_WORDS where there would be more than MAX_BLOCKS of
them. Counts of sources (not of documents) go through the driver; more than MAX_SOURCES is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from figshelf.llm.common import bounded_batches, col, documents, free_names, parts, working_tables, written
from figshelf.llm.words import mix

MOST_EPOCHS, BLOCK_WORDS, BLOCK_DOCS, BLOCKS_PER_SHARD, SEED, MAX_SOURCES = 3, 20_000, 2_000, 64, 20_240_501, 100_000
MAX_BLOCKS = 200_000_000  # numpy's multivariate hypergeometric takes sums below 10**9, and a block has up to MOST_EPOCHS draws
WORDS = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[int], most: int = MOST_EPOCHS) -> list[Fraction]:
    """Shares of sum(sizes) in proportion to weights, none above most * size; exact."""
    left, open_, out = Fraction(sum(sizes)), set(range(len(sizes))), [Fraction(0)] * len(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if unit * weights[i] > most * sizes[i]}
        if not over:
            for i in open_:
                out[i] = unit * weights[i]
            return out
        for i in over:
            out[i] = Fraction(most * sizes[i])
            left -= out[i]
        open_ -= over
    return out


def split_quotas(quotas: np.ndarray, shards: int, seed: int, draws: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """The leaf of every wanted draw. draws: source -> sorted numbers of its draws, below its quota."""
    out = {s: np.empty(len(x), np.int64) for s, x in draws.items()}

    def descend(node: int, lo: int, hi: int, left: np.ndarray, begin: np.ndarray, want: dict[int, tuple[int, int]]) -> None:
        if not want:
            return
        if hi - lo == 1:
            for s, (a, b) in want.items():
                out[s][a:b] = lo
            return
        mid, total = (lo + hi) // 2, int(left.sum())
        rng = np.random.default_rng([seed, node])
        first = rng.multivariate_hypergeometric(left, total * (mid - lo) // (hi - lo), method="marginals")
        cut = {s: a + int(np.searchsorted(draws[s][a:b], begin[s] + first[s])) for s, (a, b) in want.items()}
        descend(2 * node, lo, mid, first, begin, {s: (a, cut[s]) for s, (a, b) in want.items() if a < cut[s]})
        descend(2 * node + 1, mid, hi, left - first, begin + first, {s: (cut[s], b) for s, (a, b) in want.items() if cut[s] < b})

    descend(1, 0, shards, np.asarray(quotas, np.int64), np.zeros(len(quotas), np.int64), {s: (0, len(x)) for s, x in draws.items() if len(x)})
    return out


def permuted(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place of each x below n in the order that its key gives: for each n and key a bijection of 0 ... n - 1.

    A Feistel network of four rounds on an even number of bits, repeated while its value is not below n.
    """
    u = np.uint64
    half = np.array([max(1, (int(k) - 1).bit_length() + 1 >> 1) for k in n], u)
    low = (u(1) << half) - u(1)

    def network(y: np.ndarray, at: np.ndarray) -> np.ndarray:
        left, right = y >> half[at], y & low[at]
        for turn in range(4):
            left, right = right, left ^ mix(right + mix(key[at].astype(u) + u(turn))) & low[at]
        return left << half[at] | right

    out, open_ = np.asarray(x, u), np.arange(len(x))
    while len(open_):
        out[open_] = network(out[open_], open_)
        open_ = open_[out[open_] >= n[open_].astype(u)]
    return out.astype(np.int64)


def fits(size: np.ndarray, count: np.ndarray, room: int) -> np.ndarray:
    """How many of each kind of document fit into room words, in order, and one more of the last left out if that comes nearer."""
    taken, left = np.zeros(len(size), np.int64), room
    for i, (n, c) in enumerate(zip(size.tolist(), count.tolist())):
        taken[i] = c if n == 0 else min(c, left // n)
        left -= n * int(taken[i])
    out = np.flatnonzero(taken < count)
    if len(out) and size[out[-1]] - left < left:
        taken[out[-1]] += 1
    return taken


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MOST_EPOCHS, block_words: int = BLOCK_WORDS, block_docs: int = BLOCK_DOCS, blocks_per_shard: int = BLOCKS_PER_SHARD, seed: int = SEED) -> DataFrame:
    """(id, r, source, size, source_size, target, shards): per row the shard of each time that it is taken.

    r is a hash of the row's text: ids may repeat.
    """
    bounded_batches(docs.sparkSession)
    text = col(text_col)
    rows = docs.select(col(id_col).alias("id"), F.xxhash64(text).alias("r"), col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long").alias("size"))
    with working_tables(docs.sparkSession) as written_here:
        sized = written_here(rows, "sizes")
        found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
        if len(found) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        found.sort(key=lambda x: (x["source"] is None, x["source"] or ""))
        spark = docs.sparkSession
        sizes = [x["size"] for x in found]
        goals = targets(sizes, [1 + i % 3 for i in range(len(found))], most)
        block_words = max(block_words, parts(sum(sizes), MAX_BLOCKS))
        block_docs = max(block_docs, parts(sum(x["n"] for x in found), MAX_BLOCKS))
        n_blocks = [max(parts(x["size"], block_words), parts(x["n"], block_docs)) for x in found]
        epochs = [int(g // s) if s else 0 for g, s in zip(goals, sizes)]
        rest = [int(g - e * s) for g, e, s in zip(goals, epochs, sizes)]
        plan = [(i, x["source"], x["size"], float(g), n, e, r) for i, (x, g, n, e, r) in enumerate(zip(found, goals, n_blocks, epochs, rest))]
        sources = spark.createDataFrame(plan, "s int, source string, source_size long, target double, n_blocks long, epochs long, rest long")
        # at most MAX_SOURCES rows of some 60 bytes
        known = F.broadcast(sources)
        alike = sized.groupBy("source", "id", "r", "size").agg(F.count(F.lit(1)).alias("count"))
        blocked = written_here(alike.join(known, alike["source"].eqNullSafe(known["source"])).select("s", "id", "r", "size", "count", F.pmod(F.xxhash64(F.lit(seed), "id", "r"), F.col("n_blocks")).alias("block")), "blocked", keep=True)

    # words before each block: sums over runs of RUN blocks, then within the run, so that no window is long
    run = 1024
    blocks = blocked.groupBy("s", "block").agg(F.sum(F.col("size") * F.col("count")).alias("words")).withColumn("run", F.floor(F.col("block") / run))
    runs = blocks.groupBy("s", "run").agg(F.sum("words").alias("run_words"))
    before = Window.partitionBy("s").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("run_before", F.coalesce(F.sum("run_words").over(before), F.lit(0))).drop("run_words")
    within = Window.partitionBy("s", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = blocks.join(runs, ["s", "run"]).withColumn("end", F.col("run_before") + F.sum("words").over(within))
    placed = written(ends.join(F.broadcast(sources.select("s", "rest", "epochs", "n_blocks")), "s").select(
        "s", "block", "epochs", "n_blocks", (F.col("end") <= F.col("rest")).alias("whole"),
        F.when((F.col("end") > F.col("rest")) & (F.col("end") - F.col("words") < F.col("rest")), F.col("rest") - F.col("end") + F.col("words")).alias("room"),
    ), "blocks")
    # the quota of a source: whole epochs, blocks that fit whole, and the block cut short
    counts = {x["s"]: x["n"] for x in placed.groupBy("s").agg(F.count(F.when(F.col("whole") | F.col("room").isNotNull(), 1)).alias("n")).collect()}
    quotas = np.array([counts.get(i, 0) + e * n for i, (e, n) in enumerate(zip(epochs, n_blocks))], np.int64)
    n_shards = parts(int(quotas.sum()), blocks_per_shard)

    def to_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds to each block the shards of its draws: one for each epoch, and one more if it is in the rest."""
        for batch in batches:
            s, block, whole_epochs, n, again = (np.asarray(batch.column(k).to_numpy(zero_copy_only=False), np.int64) for k in (0, 1, 2, 3, 4))
            again = again.astype(bool) | np.asarray(batch.column(5).is_valid())
            # a source's blocks have an order of their own in each epoch but the last, which ends at the rest
            row = np.repeat(np.arange(len(s)), whole_epochs + again)
            epoch = np.arange(len(row)) - np.repeat(np.cumsum(whole_epochs + again) - (whole_epochs + again), whole_epochs + again)
            place, whole = block[row], np.flatnonzero(epoch < whole_epochs[row])
            place[whole] = permuted(place[whole], n[row][whole], mix((seed + 1000 * s[row] + epoch).astype(np.uint64))[whole])
            at = epoch * n[row] + place
            shard = np.empty(len(row), np.int64)
            order = np.lexsort((at, s[row]))
            edges = np.searchsorted(s[row][order], np.arange(len(quotas) + 1))
            wanted = {i: at[order[a:b]] for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) if a < b}
            for i, x in split_quotas(quotas, n_shards, seed, wanted).items():
                shard[order[edges[i] : edges[i + 1]]] = x
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(whole_epochs + again))), pa.int32()), pa.array(shard))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(5), lists], ["s", "block", "room", "shards"])

    dealt = placed.repartition("s", F.floor(F.col("block") / run)).mapInArrow(to_shards, "s int, block long, room long, shards array<long>")
    taken = blocked.join(dealt, ["s", "block"])

    def fit(table: pa.Table) -> pa.Table:
        """Of the one block of a source that is cut short: its documents, largest first, while they fit."""
        table = table.take(pc.sort_indices(table, [("size", "descending"), ("r", "ascending"), ("id", "ascending")]))
        full = fits(table["size"].to_numpy(), table["count"].to_numpy(), table["room"][0].as_py())
        return table.drop_columns(["room"]).append_column("full", pa.array(full))

    each = "s int, id {}, r long, size long, count long, shards array<long>".format(sized.dtypes[0][1])
    cut = taken.where("room IS NOT NULL").select("s", "id", "r", "size", "count", "room", "shards").groupBy("s").applyInArrow(fit, each + ", full long")
    all_ = taken.where("room IS NULL").select("s", "id", "r", "size", "count", "shards", F.col("count").alias("full")).unionByName(cut)
    # full of the rows alike take the last draw too
    rows = all_.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"))))
    shards = F.when(F.col("copy") <= F.col("full"), F.col("shards")).otherwise(F.slice("shards", F.lit(1), F.size("shards") - 1))
    return rows.join(F.broadcast(sources.select("s", "source", "source_size", "target")), "s").select("id", "r", "source", "size", "source_size", "target", shards.alias("shards"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """The mix: rows of docs, each as often as it is taken, shard by shard and shuffled within each."""
    # equal rows of a source share a block, so their plans differ at most by the last draw, in the block cut short
    plan = mix_plan(docs, id_col, text_col, source_col, seed=seed).groupBy("id", "r", "source").agg(F.max("shards").alias("most"), F.min("shards").alias("least"), F.count(F.lit(1)).alias("n"), F.sum(F.size("shards")).alias("draws"))
    key_id, key_r, key_source, most, least, full, shards, epoch, shard = free_names(docs, "id", "r", "source", "most", "least", "full", "shards", "epoch", "shard")
    names = {"id": key_id, "r": key_r, "source": key_source, "most": most, "least": least}
    in_full = F.col("draws") - F.col("n") * F.size("least")
    plan = written(plan.where(F.size("most") > 0).select(*(F.col(c).alias(name) for c, name in names.items()), in_full.alias(full)), "plan")
    same = col(id_col).eqNullSafe(F.col(key_id)) & (F.xxhash64(col(text_col)) == F.col(key_r)) & col(source_col).cast("string").eqNullSafe(F.col(key_source))
    columns = [col(c) for c in docs.columns]
    even = docs.join(plan.where(F.col(most) == F.col(least)), same)
    taken = even.select(*columns, key_id, key_r, F.col(most).alias(shards))
    uneven = written(plan.where(F.col(most) != F.col(least)), "uneven")
    if not uneven.isEmpty():  # repeated rows of a block cut short: as many of them as planned get the last draw
        others = F.to_json(F.struct(*columns))
        copy = F.row_number().over(Window.partitionBy(key_id, key_r, key_source).orderBy(F.xxhash64(others)))
        mine = F.when(copy <= F.col(full), F.col(most)).otherwise(F.col(least))
        taken = taken.unionByName(docs.join(uneven, same).select(*columns, key_id, key_r, mine.alias(shards)))
    taken = taken.select(*columns, key_id, key_r, F.posexplode(shards).alias(epoch, shard))
    # by text too, as ids may be null or repeated
    local = F.xxhash64(F.lit(seed), key_id, key_r, epoch)
    return taken.repartition(shard).sortWithinPartitions(shard, local).select(*columns)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(documents(spark, sf_dir))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.size("shards")).cast("long").alias("taken"))
