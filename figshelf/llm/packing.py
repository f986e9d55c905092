"""Packing token sequences by swap-based local search (operator 8).

A document is its token ids and an end id. One of more than `capacity` ids is cut into pieces of
capacity ids, the first of them shorter if need be; others are one piece. Pieces of capacity ids are
sequences by themselves. The others are dealt by a hash into groups of about GROUP pieces, and each
group is packed in one task of bounded size:

1. the pieces are laid into sequences as they come (next fit), which wastes a good part of each;
2. bins that are not full exchange documents: a donor, the emptiest bin left, gives a document to a fuller
   bin (move), trades one of its documents for a smaller one (one for one), two of its documents for a smaller
   one, or one for two smaller ones (two for one). Every step makes the fuller bin fuller, so the sum of
   squared fills rises and the search ends; a donor that has nothing left is a bin saved;
3. where no pass saves a bin, the emptiest bins and some others, SHAKEN for each bin above the lower bound and
   as many again, are poured out, laid as in 1 and searched again; the better packing stays. It stops where the bound
   is met, after ROUNDS such rounds, or when they have gone through EFFORT documents for each document of the group: those in bins
   that are not full or poured out. So the most that a document costs is the same in groups of any size.

Sizes are small numbers, so the search keeps its books by size: bins by their room, and for each size the
most room beside a document of it. Pairs are listed once a pass, one for each two sizes of a bin, and are
looked at again before they are used.

Null and empty texts are the end id alone. Repeated rows are packed each; ids may be null. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figshelf.llm.common import bounded_batches, col, documents, parts, written
from figshelf.llm.tokens import Encoder

CAPACITY, GROUP, END_ID = 2048, 16_384, 0
FEW = 16  # documents of a donor whose pairs are listed one by one
SHAKEN, ROUNDS, EFFORT = 16, 80, 20  # bins poured out for each one too many; most rounds; documents that rounds go through, for each one there is


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece of a document of n ids."""
    first = n % capacity or capacity
    return [(0, min(n, first)), *((at, capacity) for at in range(first, n, capacity))]


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: largest first, each into the fullest bin that has room."""
    with_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins, used = 0, [], []  # mask: bit f is set where some bin has f free
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        if fits := mask >> size:
            free = size + (fits & -fits).bit_length() - 1
            b = with_free[free].pop()
            if not with_free[free]:
                mask &= ~(1 << free)
        else:
            b, free = len(bins), capacity
            bins.append([])
            used.append(0)
        bins[b].append(i)
        if rest := free - size:
            with_free[rest].append(b)
            mask |= 1 << rest
    return bins


def fewest(sizes: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing goes below."""
    return max(-(-int(sizes.sum()) // capacity), int((2 * sizes > capacity).sum()))


def pairs_in(group: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of items of one group, one for each two sizes that it has: first, second, both sizes.

    A group within a capacity has fewer than sqrt(2 * capacity) sizes.
    """
    order = np.lexsort((sizes, group))
    g, s = group[order], sizes[order]
    again = np.zeros(len(order), bool)
    again[1:] = (g[1:] == g[:-1]) & (s[1:] == s[:-1])
    twice = np.flatnonzero(again & ~np.concatenate(([False], again))[:-1])  # the second item of a size
    first, second = [order[twice - 1]], [order[twice]]
    order, g = order[~again], g[~again]
    k = 1
    while len(same := np.flatnonzero(g[k:] == g[:-k])):
        first.append(order[same])
        second.append(order[same + k])
        k += 1
    i, j = np.concatenate(first), np.concatenate(second)
    return i, j, sizes[i] + sizes[j]


def next_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: each into the last bin if it has room, else into a new one."""
    bins, free = [], -1
    for i, size in enumerate(sizes):
        if size > free:
            bins.append([])
            free = capacity
        bins[-1].append(i)
        free -= size
    return bins


class Search:
    """The local search over the bins that are not full."""

    def __init__(self, bins: list[list[int]], sizes: np.ndarray, capacity: int):
        self.sizes, self.capacity = sizes.astype(np.int64), capacity
        self.size, self.bins = self.sizes.tolist(), [list(b) for b in bins]
        self.fill = [sum(self.size[i] for i in b) for b in self.bins]
        self.n_bins, self.least = sum(f > 0 for f in self.fill), fewest(self.sizes, capacity)
        self.steps = {"move": 0, "one for one": 0, "two for one": 0, "one for two": 0}

    def open(self) -> None:
        """Books of the bins that may still be filled up in this pass: all that have something and are not full."""
        self.room = [0] * len(self.fill)
        self.with_room: list[dict[int, None]] = [{} for _ in range(self.capacity + 1)]
        self.mask = 0  # bit r is set where some bin has room r
        self.reach = np.full(self.capacity + 1, -1, np.int64)  # of each size: itself and the most room beside it, or more than that
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in range(self.capacity + 1)]  # (-room, bin), some of them outdated
        self.pairs: dict[int, tuple[int, int, int]] | None = None
        for b, fill in enumerate(self.fill):
            if 0 < fill < self.capacity:
                self._enter(b, self.capacity - fill)

    def _enter(self, b: int, room: int) -> None:
        self.room[b] = room
        if room:
            self.with_room[room][b] = None
            self.mask |= 1 << room
            for i in self.bins[b]:
                heappush(self.heaps[n := self.size[i]], (-room, b))
                if n + room > self.reach[n]:
                    self.reach[n] = n + room

    def close(self, b: int) -> None:
        room = self.room[b]
        if room:
            del self.with_room[room][b]
            if not self.with_room[room]:
                self.mask &= ~(1 << room)
        self.room[b] = 0

    def run(self) -> list[list[int]]:
        self.search()
        rng = np.random.default_rng(len(self.size))
        self.effort = 0
        for _ in range(ROUNDS):
            if self.n_bins <= self.least or self.effort >= EFFORT * len(self.size):
                break
            before = self.n_bins, [list(b) for b in self.bins], list(self.fill)
            self.effort += self.shake(rng) + sum(len(b) for b, fill in zip(self.bins, self.fill) if fill < self.capacity)
            self.search()
            if self.n_bins > before[0]:
                self.n_bins, self.bins, self.fill = before
        return [b for b in self.bins if b]

    def search(self) -> None:
        """Passes over all donors, as long as they save bins."""
        better = True
        while better and self.n_bins > self.least:
            before = self.n_bins
            self.open()
            for donor in sorted(range(len(self.fill)), key=self.fill.__getitem__):
                if self.n_bins <= self.least:
                    break
                if 0 < self.fill[donor] < self.capacity:
                    self.close(donor)  # those after it are at least as full, so each step makes the fuller one fuller
                    while self.fill[donor] and self.step(donor):
                        pass
            better = self.n_bins < before

    def shake(self, rng: np.random.Generator) -> int:
        """Pour out the emptiest bins and some others, and lay their documents anew as they come; how many these are."""
        used = sorted((b for b, f in enumerate(self.fill) if f), key=self.fill.__getitem__)
        n = SHAKEN * (self.n_bins - self.least)
        chosen = list(dict.fromkeys([*used[:n], *(used[k] for k in rng.choice(len(used), min(len(used), n), replace=False).tolist())]))
        items = [i for b in chosen for i in self.bins[b]]
        items = [items[k] for k in rng.permutation(len(items)).tolist()]
        for b in chosen:
            self.bins[b], self.fill[b] = [], 0
        for laid in next_fit([self.size[i] for i in items], self.capacity):
            self.bins.append([items[k] for k in laid])
            self.fill.append(sum(self.size[i] for i in self.bins[-1]))
        left = [b for b, f in enumerate(self.fill) if f]
        self.bins, self.fill, self.n_bins = [self.bins[b] for b in left], [self.fill[b] for b in left], len(left)
        return len(items)

    def step(self, donor: int) -> bool:
        """Take the step that moves most ids out of the donor; False if there is none."""
        own = sorted(self.bins[donor], key=lambda i: (-self.size[i], i))
        for i in own:
            if fits := self.mask >> self.size[i]:
                room = self.size[i] + (fits & -fits).bit_length() - 1
                return self._do("move", donor, next(iter(self.with_room[room])), [i], [])
        singles = {self.size[i]: [i] for i in own}
        if len(own) <= FEW:
            doubles = {self.size[i] + self.size[j]: [i, j] for k, i in enumerate(own) for j in own[k + 1 :]}
        else:
            i, j, both = pairs_in(np.zeros(len(own), np.int64), self.sizes[own])
            doubles = {n: [own[a], own[b]] for a, b, n in zip(i.tolist(), j.tolist(), both.tolist())}
        return self._trade(donor, doubles | singles) or self._trade_pairs(donor, singles)

    def _beside(self, n: int) -> int:
        """The bin with most room that holds a document of size n, and books put right; -1 if there is none."""
        heap = self.heaps[n]
        while heap:
            room, b = -heap[0][0], heap[0][1]
            if self.room[b] == room and any(self.size[i] == n for i in self.bins[b]):
                self.reach[n] = n + room
                return b
            heappop(heap)
        self.reach[n] = -1
        return -1

    @staticmethod
    def _best(sizes: np.ndarray, reach: np.ndarray) -> tuple[int, int]:
        """Of given sizes and returned ones (smaller, and with enough room beside them) the two that differ most."""
        back = np.maximum.accumulate(reach).searchsorted(sizes)
        gain = sizes - back
        k = gain.argmax()
        return (int(sizes[k]), int(back[k])) if gain[k] > 0 else (0, 0)

    def _trade(self, donor: int, give: dict[int, list[int]]) -> bool:
        """Something in give for a single smaller document, such that most ids leave."""
        sizes = np.array(list(give), np.int64)
        while True:
            size, n = self._best(sizes, self.reach)
            if not size:
                return False
            b = self._beside(n)
            if b >= 0 and n + self.room[b] >= size:
                return self._do("one for one" if len(give[size]) == 1 else "two for one", donor, b, give[size], [next(i for i in self.bins[b] if self.size[i] == n)])

    def _trade_pairs(self, donor: int, give: dict[int, list[int]]) -> bool:
        """A document in give for two smaller ones of one bin, such that most ids leave."""
        if self.pairs is None:
            self.pairs, self.pair_reach = self._list_pairs()
        sizes = np.array(list(give), np.int64)
        while True:
            size, n = self._best(sizes, self.pair_reach)
            if not size:
                return False
            b, i, j = self.pairs[n]
            if self.room[b] and i in self.bins[b] and j in self.bins[b]:
                if n + self.room[b] >= size:
                    return self._do("one for two", donor, b, give[size], [i, j])
                self.pair_reach[n] = n + self.room[b]
            else:
                self.pair_reach[n] = -1

    def _list_pairs(self) -> tuple[dict[int, tuple[int, int, int]], np.ndarray]:
        """For each sum of two sizes of an open bin: the bin with most room, and the pair; and the sum with that room."""
        reach = np.full(self.capacity + 1, -1, np.int64)
        open_ = [(i, b) for b, items in enumerate(self.bins) if self.room[b] for i in items]
        if not open_:
            return {}, reach
        item, bin_ = np.array(open_).T
        i, j, both = pairs_in(bin_, self.sizes[item])
        space = np.array(self.room)[bin_[i]]
        order = np.lexsort((i, -space, both))
        first = order[np.unique(both[order], return_index=True)[1]]
        reach[both[first]] = both[first] + space[first]
        return {n: (b, x, y) for n, b, x, y in zip(both[first].tolist(), bin_[i[first]].tolist(), item[i[first]].tolist(), item[j[first]].tolist())}, reach

    def _do(self, kind: str, donor: int, b: int, out: list[int], back: list[int]) -> bool:
        gain = sum(self.size[i] for i in out) - sum(self.size[i] for i in back)
        room = self.room[b] - gain
        self.close(b)
        self.bins[donor] = [i for i in self.bins[donor] if i not in out] + back
        self.bins[b] = [i for i in self.bins[b] if i not in back] + out
        self.fill[donor] -= gain
        self.fill[b] += gain
        self._enter(b, room)
        self.n_bins -= not self.fill[donor]
        self.steps[kind] += 1
        return True


def pack(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers, none over capacity."""
    return Search(next_fit(sizes.tolist(), capacity), sizes, capacity).run()


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str, keep_ids: bool) -> DataFrame:
    """(id, row, piece, start, length, crc, ids): the pieces of each row of docs; ids only if asked for."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            row, made = [], {"piece": [], "start": [], "length": [], "crc": []}
            ids = []
            for k, found in enumerate(encoder.encode_column(batch.column(1))):
                payload = found.astype("<u4").tobytes() + end
                for piece, (at, n) in enumerate(cuts(len(payload) // 4, capacity)):
                    part = payload[4 * at : 4 * (at + n)]
                    row.append(k)
                    ids.append(part if keep_ids else None)
                    for name, value in (("piece", piece), ("start", at), ("length", n), ("crc", zlib.crc32(part))):
                        made[name].append(value)
            which = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(2).take(which), *(pa.array(made[x], t) for x, t in (("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64()))), pa.array(ids, pa.binary())], ["id", "row", *made, "ids"])

    three = docs.select(col(id_col).alias("id"), col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    return three.mapInArrow(cut, f"id {three.dtypes[0][1]}, row long, piece int, start long, length long, crc long, ids binary")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP, keep_ids: bool = False) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset[, ids]): the place of every piece.

    ids: with keep_ids, the piece's ids as little-endian unsigned 32-bit integers.
    """
    bounded_batches(docs.sparkSession)
    pieces = written(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col, keep_ids), "pieces")
    part = pieces.where(F.col("length") < capacity)
    n_groups = parts(part.count(), group)

    def solve(table: pa.Table) -> pa.Table:
        sizes = table["length"].to_numpy()
        g = table["g"][0].as_py()
        order = np.lexsort((table["piece"].to_numpy(), table["row"].to_numpy()))  # whatever order the rows came in
        sequence, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
        for k, bin_ in enumerate(pack(sizes[order], capacity)):
            at = 0
            for i in order[bin_].tolist():
                sequence[i], offset[i] = k * n_groups + g, at
                at += int(sizes[i])
        return table.drop_columns(["g", "row"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    id_type = pieces.dtypes[0][1]
    out = f"id {id_type}, piece int, start long, length long, crc long, ids binary, sequence_id long, offset long"
    packed = part.withColumn("g", F.pmod(F.xxhash64("row", "piece"), F.lit(n_groups))).groupBy("g").applyInArrow(solve, out)
    # a full piece is a sequence of its own, numbered below 0
    whole = pieces.where(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    both = packed.unionByName(whole.drop("row"))
    columns = [F.col("id").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset"]
    return both.select(*columns, *(["ids"] if keep_ids else []))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
