"""Near duplicates by a chosen-path set similarity join (operator 6).

A text's set: its distinct SHINGLE-word shingles, A-Z lower-cased; with fewer words, the sequence as one;
without words, nothing, and it is linked with nothing. Two texts are linked if their Jaccard similarity
is at least PER_CENT / 100. A component's id is the smallest document id in it.

1. Texts with one and the same set are one class, shown by its smallest id.
2. Trees: a class enters a node for each root token, the least of its shingles in one of TOKENS random
   orders (TREES trees of TOKENS / TREES roots). A node of more than about SMALL classes branches: each of its
   classes goes on to FAN children, chosen by its next minwise tokens; so do nodes of over LARGE, DEPTH levels down.
3. A small node is compared exhaustively, first by sketches of a byte for each token: a class stays if
   another agrees with it in at least AGREE bytes. (At similarity 0.75 a pair fails that with
   probability 4e-8.) What stays is compared by whole sets, and a link counts only if these confirm it.
4. The first tree's links make components. All trees after it compare only classes of different
   components, and no pair that the first tree has compared. Within a node links that join nothing new
   are neither looked for nor written.

A pair with similarity 0.75 shares each root with probability 0.75, so where no node branches it misses all
TOKENS = 24 with 4e-15. A node that branches keeps it with 1 - 0.25 ** FAN = 0.94 a level: with every root
branching at all DEPTH - 1 levels below it, a miss has some 1.5e-4. tests/llm measures the share of pairs found.
A node of more than LARGE classes on the last level is cut into blocks: the first tree compares each block
with itself and with the first block; the other trees all pairs of blocks that still hold different
components. So no bucket is capped, and no task holds more than about LARGE sets.

Shingles are 64-bit hashes. Repeated ids are separate rows. Rows with a null id take part and have the id
null, which counts as larger than any. Very long texts are one (long) set. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figshelf.llm.common import CHUNK_BYTES, Writer, bounded_batches, col, documents, free_names, likely_in, row_chunks, text_bytes, working_tables, written
from figshelf.llm.components import components
from figshelf.llm.words import U, Words, mix, stretches, words_of

SHINGLE, PER_CENT = 5, 75
TOKENS, TREES, FAN, DEPTH = 24, 8, 2, 4
SMALL, LARGE, LARGE_SHINGLES, AGREE = 1024, 4096, 4_000_000, 6
ROOTS = TOKENS // TREES


def shingle_sets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, end to end, and the n + 1 offsets of the texts."""
    hashes = words.hashes()
    at, grams = words.windows(SHINGLE, hashes)
    text = words.text[at]
    short = np.flatnonzero((words.per_text > 0) & (words.per_text < SHINGLE))
    if len(short):
        whole = [U(xxhash.xxh3_64_intdigest(words.span(words.first[t], words.first[t + 1]))) for t in short.tolist()]
        text, grams = np.concatenate((text, short)), np.concatenate((grams, np.array(whole, U)))
    order = np.lexsort((grams, text))
    text, grams = text[order], grams[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (grams[1:] != grams[:-1])
    text, grams = text[new], grams[new]
    return grams, np.searchsorted(text, np.arange(len(words.first)))


def long_set(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """shingle_sets() of one long text, a stretch of it at a time."""
    found, n_words = [], 0
    for number, words in stretches(data, SHINGLE - 1, lower=True):
        found.append(np.unique(words.windows(SHINGLE, words.hashes())[1]))
        n_words = number + len(words)
    if n_words < SHINGLE:
        return shingle_sets(words_of(data, np.array([0, len(data)]), lower=True))
    grams = np.unique(np.concatenate(found))
    return grams, np.array([0, len(grams)])


def _sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    data, offsets = text_bytes(column)
    for lo, hi in row_chunks(offsets):
        part = data[offsets[lo] : offsets[hi]]
        yield lo, *(shingle_sets(words_of(part, offsets[lo : hi + 1] - offsets[lo], lower=True)) if len(part) <= CHUNK_BYTES else long_set(part))


def signatures(rows: DataFrame) -> DataFrame:
    """(id, r, n, cls, tokens) of rows (id, text, r): set size, hash of the set, minwise tokens."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, cls, tokens = [], [], []
            for _, sets, edge in _sets(batch.column(1)):
                size = np.diff(edge)
                full = np.flatnonzero(size)
                least = np.zeros((len(size), TOKENS), U)
                for k in range(TOKENS if len(full) else 0):
                    least[full, k] = np.minimum.reduceat(mix(sets ^ mix(np.array([k + 1], U))), edge[full])
                raw = sets.tobytes()
                cls += [xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) if a < b else None for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
                n += size.tolist()
                tokens.append(least.view(np.int64).ravel())
            flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, TOKENS), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), lists], ["id", "r", "n", "cls", "tokens"])

    return rows.mapInArrow(sign, f"id {rows.dtypes[0][1]}, r long, n long, cls binary, tokens array<long>")


def leaves(members: DataFrame, roots: int, written: Writer) -> tuple[DataFrame, DataFrame]:
    """Classes by the nodes where they are compared, (t, v, label, sketch, n), and (v, flags).

    members: (v, tokens, label, flags). Nodes of one label have nothing to join and go. A node is small if
    its pairs of different labels are: with n classes, m of the commonest label, at most SMALL * SMALL of
    n * (n - m). Below the roots LARGE takes the place of SMALL: classes still together after two tokens are
    alike, and branching parts them no more. flags tells for each root of the first tree how its node was compared:
    0 as a whole, 1 in its children, 2 in another way.
    """
    first = members.select("v", "label", F.posexplode(F.slice("tokens", 1, roots)).alias("k", "token"))
    level = first.select("v", "label", "k", F.col("k").alias("root"), F.xxhash64("k", "token").alias("t"))
    out, how = None, None
    for depth in range(DEPTH):
        small = SMALL if depth == 0 else LARGE
        by_label = level.groupBy("t", "label").agg(F.count(F.lit(1)).alias("c"))
        sized = by_label.groupBy("t").agg(F.sum("c").alias("n"), F.max("c").alias("m"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
        sized = written(sized, "node-sizes")  # both sides of the join come straight from a shuffle: a hot node's rows are split
        known = written(level.join(sized.select("t", "n", (F.col("n") * (F.col("n") - F.col("m")) > small * small).alias("big")), "t"), "nodes")
        done = depth == DEPTH - 1 or known.where("big").isEmpty()
        here = known if done else known.where("NOT big")
        out = here if out is None else out.unionByName(here)
        parted = known.where(F.col("big") | (F.col("n") > LARGE)).select("v", "root", F.when((F.col("n") > LARGE) & (F.lit(done) | ~F.col("big")), 2).otherwise(min(depth + 1, 2)).alias("how"))
        how = parted if how is None else how.unionByName(parted)
        if done:
            break
        on = known.where("big").select("t", "v", "label", "root", "k", F.explode(F.sequence(F.lit(1), F.lit(FAN))).alias("step"))
        on = on.withColumn("k", F.pmod(F.col("k") + F.col("step"), F.lit(TOKENS)))
        level = on.join(members.select("v", "tokens"), "v").select("v", "label", "k", "root", F.xxhash64("t", "k", F.get("tokens", F.col("k"))).alias("t"))
    mine = [F.coalesce(F.max(F.when(F.col("root") == j, F.col("how"))), F.lit(0)) for j in range(ROOTS)]
    flags = how.groupBy("v").agg(F.concat(*(F.lpad(F.hex(x), 2, "0") for x in mine)).alias("flags"))
    # a byte of each token, then four of each that a pair of the first tree meets by, then the flags
    parts = [F.lpad(F.hex(x.bitwiseAND(mask)), 2 * n, "0") for n, mask, last in ((1, 255, TOKENS), (4, 0xFFFFFFFF, ROOTS + FAN)) for x in (F.get("tokens", F.lit(j)) for j in range(last))]
    sketch = F.to_binary(F.concat(*parts, "flags"), F.lit("hex"))
    return out.join(members.select("v", sketch.alias("sketch")), "v").select("t", "v", "label", "sketch", "n"), flags


def _node_batches(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[pa.Table]:
    """Tables that hold whole nodes, from batches sorted by the node's key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = batch.column(key).to_numpy()
        if held and held[-1].column(key)[held[-1].num_rows - 1].as_py() != t[0]:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        last = int(np.searchsorted(t, t[-1]))
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks()
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _edges(t: np.ndarray) -> list[int]:
    return np.concatenate(([0], np.flatnonzero(t[1:] != t[:-1]) + 1, [len(t)])).tolist()


def likely(sketches: np.ndarray, labels: np.ndarray, second: bool) -> np.ndarray:
    """Which sketches agree in at least AGREE bytes with one of another label.

    second: not counting pairs that the first tree has compared. These have a root of it in common and, if that
    root's node was compared in its children, a child as well.
    """
    n, near = len(sketches), sketches[:, :TOKENS]
    token = np.ascontiguousarray(sketches[:, TOKENS : TOKENS + 4 * (ROOTS + FAN)]).view(np.uint32)
    flags = sketches[:, TOKENS + 4 * (ROOTS + FAN) :]
    found = np.zeros(n, bool)
    for lo in range(0, n, 64):
        todo = lo + np.flatnonzero(~found[lo : lo + 64])
        if not len(todo):
            continue
        same = (near[todo, None, :] == near[None, :, :]).sum(2, dtype=np.uint8) >= AGREE
        same &= labels[todo, None] != labels[None, :]
        if second and same.any():
            meets = token[todo, None, :] == token[None, :, :]
            for j in range(ROOTS):
                how = flags[todo, j][:, None]
                same &= ~(meets[:, :, j] & ((how == 0) | (how == 1) & meets[:, :, j + 1 : j + 1 + FAN].any(2)))
        found[todo] |= same.any(1)
        found |= same.any(0)
    return found


def sketch_survivors(leaf: DataFrame, second: bool) -> DataFrame:
    """(t, v, label, n): the classes that have a likely partner in their node; all of a node of over LARGE."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _node_batches(batches):
            sketches = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(table.num_rows, -1)
            found, label = np.ones(table.num_rows, bool), table["label"].to_numpy()
            edge = _edges(table["t"].to_numpy())
            for a, b in zip(edge[:-1], edge[1:]):
                found[a:b] = likely(sketches[a:b], label[a:b], second)
            yield from table.drop_columns(["sketch"]).filter(pa.array(found)).to_batches()

    fits = F.col("n") <= LARGE
    small = leaf.where(fits).select("t", "v", "label", "n", "sketch").repartition("t").sortWithinPartitions("t")
    return small.mapInArrow(keep, "t long, v long, label long, n long").unionByName(leaf.where(~fits).select("t", "v", "label", "n"))


def link_node(ids: np.ndarray, labels: np.ndarray, codes: np.ndarray, edge: np.ndarray, n_codes: int) -> list[tuple[int, int]]:
    """Links that join the components of one node. codes[edge[i]:edge[i + 1]]: the set of ids[i]."""
    n, size = len(ids), np.diff(edge)
    group = np.unique(labels, return_inverse=True)[1]
    mark = np.zeros(n_codes, np.uint8)
    out = []
    for i in range(n):
        other = (group != group[i]) & (np.arange(n) > i) & (100 * np.minimum(size, size[i]) >= PER_CENT * np.maximum(size, size[i]))
        if not other.any():
            continue
        mark[codes[edge[i] : edge[i + 1]]] = 1
        both = np.add.reduceat(mark[codes], edge[:-1], dtype=np.int64)
        mark[codes[edge[i] : edge[i + 1]]] = 0
        for j in np.flatnonzero(other & (100 * both >= PER_CENT * (size + size[i] - both))).tolist():
            if group[j] != group[i]:
                group[group == group[j]] = group[i]
                out.append((int(ids[i]), int(ids[j])))
    return out


def _links(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): pairs of different labels that a confirmed link of their classes joins. nodes: (t, v, label)."""
    mixed = nodes.groupBy("t").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("v")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(1), "v")).alias("s2")).where("x < y")
    # nodes with the very same classes are compared once
    once = mixed.groupBy("n", "s1", "s2").agg(F.min("t").alias("t")).select("t")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _node_batches(batches):
            found, label = [], table["label"].to_numpy()
            column = table["shingles"].combine_chunks()
            data, offsets = text_bytes(column)
            edge = _edges(table["t"].to_numpy())
            for a, b in zip(edge[:-1], edge[1:]):
                codes = np.unique(data[offsets[a] : offsets[b]].view(U) if (offsets[a] % 8 == 0 and data.ctypes.data % 8 == 0) else np.frombuffer(data[offsets[a] : offsets[b]].tobytes(), U), return_inverse=True)
                found += link_node(label[a:b], label[a:b], codes[1], (offsets[a : b + 1] - offsets[a]) // 8, len(codes[0]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    rows = nodes.select("t", "v", "label").join(once, "t").join(sets, "v").select("t", "v", "label", "shingles")
    return rows.repartition("t").sortWithinPartitions("t").mapInArrow(compare, "a long, b long")


def _blocks(nodes: DataFrame, star: bool) -> DataFrame:
    """Nodes too large for a task cut into pairs of blocks; star: only block with itself and with block 0."""
    of = F.greatest(F.ceil(2 * F.col("n") / LARGE), F.ceil(2 * F.col("weight") / LARGE_SHINGLES))
    own = nodes.withColumn("of", of).withColumn("own", F.pmod(F.xxhash64("v"), F.col("of")))
    if star:  # the classes of block 0 go to every block
        others = F.when(F.col("own") == 0, F.sequence(F.lit(0).cast("long"), F.col("of") - 1)).otherwise(F.array(F.lit(0).cast("long"), F.col("own")))
    else:
        others = F.sequence(F.lit(0).cast("long"), F.col("of") - 1)
    pair = own.withColumn("other", F.explode(others))
    return pair.select(F.xxhash64("t", F.least("own", "other"), F.greatest("own", "other")).alias("t"), "v", "label")


def _collect_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = []
        for _, sets, edge in _sets(batch.column(1)):
            raw = sets.tobytes()
            made += [raw[8 * a : 8 * b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["v", "shingles"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, r, n_shingles, label, component_id, kept): one row per row of docs; r is a hash of its text.

    label tells components apart, as unrelated texts may share an id or have none; it is null without words.
    kept marks the row that stays of each component: the one whose id is the component's.
    """
    bounded_batches(docs.sparkSession)
    with working_tables(docs.sparkSession) as written:
        text = col(text_col)
        rows = docs.select(col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("r"))
        signed = written(signatures(rows), "signatures", keep=True)
        first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("r").alias("r")))
        classes = written(signed.where("n > 0").groupBy("cls").agg(first.alias("f"), F.first("n").alias("n"), F.first("tokens").alias("tokens")).select("cls", F.col("f.id").alias("id"), F.col("f.r").alias("r"), "n", "tokens", F.monotonically_increasing_id().alias("v")), "classes")

        def sets_of(wanted: DataFrame) -> DataFrame:
            """(v, shingles) of classes, from the text of the row that shows each. Few other texts travel."""
            ids = written(classes.select("v", F.col("id").alias("id_"), F.col("r").alias("r_")).join(wanted, "v"), "wanted")
            texts = likely_in(rows, ids.select(F.col("r_").alias("r")), "r")
            shown = texts.join(ids, texts["id"].eqNullSafe(F.col("id_")) & (texts["r"] == F.col("r_"))).select("v", "text")
            return written(shown.mapInArrow(_collect_sets, "v long, shingles binary"), "sets").dropDuplicates(["v"])

        def links_of(alive: DataFrame, sets: DataFrame, star: bool) -> DataFrame:
            weight = alive.join(classes.select("v", F.col("n").alias("size")), "v").groupBy("t").agg(F.sum("size").alias("weight"))
            nodes = written(alive.join(weight, "t"), "weighed")
            fits = (F.col("n") <= LARGE) & (F.col("weight") <= LARGE_SHINGLES)
            small, large = nodes.where(fits).select("t", "v", "label"), nodes.where(~fits)
            if star:  # nodes of few, long sets are compared whole in the first tree too
                cut = _blocks(large.where(F.col("n") <= LARGE), False).unionByName(_blocks(large.where(F.col("n") > LARGE), True))
            else:
                cut = _blocks(large, False)
            return written(_links(small.unionByName(cut), sets), "links")

        tokens, fresh = classes.select("v", "tokens"), F.lit("00" * ROOTS)
        leaf, flags = leaves(tokens.withColumn("label", F.col("v")).withColumn("flags", fresh), ROOTS, written)
        alive = written(sketch_survivors(leaf, False), "survivors")
        sets = sets_of(alive.select("v").distinct())
        one = links_of(alive, sets, True)
        label = components(one, written)
        tokens = tokens.join(label, "v", "left").join(flags, "v", "left")
        tokens = tokens.withColumns({"label": F.coalesce("label", "v"), "flags": F.coalesce("flags", fresh)})
        alive = written(sketch_survivors(leaves(written(tokens, "labelled"), TOKENS, written)[0], True), "survivors")
        more = sets_of(alive.select("v").distinct().join(sets.select("v"), "v", "left_anti"))
        # the links that are left join labels; a class without a link so far is its own label
        rest = components(links_of(alive, sets.unionByName(more), False), written).select(F.col("v").alias("old"), F.col("label").alias("new"))
        joined = label.join(rest, label["label"] == rest["old"], "left").select("v", F.coalesce("new", "label").alias("label"))
        label = joined.unionByName(rest.join(label.select("v"), rest["old"] == label["v"], "left_anti").select(F.col("old").alias("v"), F.col("new").alias("label")))

        joined = written(label.join(classes.select("v", "cls", "id"), "v"), "joined")
        least = written(joined.groupBy("label").agg(F.min("id").alias("component")), "least")
        grown = joined.join(least, "label").select("cls", "component", "label")
        of_class = classes.select("cls", "id", "v").join(grown, "cls", "left").select("cls", F.coalesce("label", "v").alias("label"), F.coalesce("component", "id").alias("component_id"))
        of_class = written(of_class, "of-class", keep=True)
    linked = signed.where("n > 0").join(of_class, "cls").select("id", "r", F.col("n").alias("n_shingles"), "label", "component_id")
    alone = signed.where("n = 0").select("id", "r", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("label"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: one of each component, and every text without words."""
    bounded_batches(docs.sparkSession)
    found = near_duplicates(docs, id_col, text_col).where("kept")
    # ids may repeat inside a component: one row of them stays; and across components: one row of each
    each = found.where("n_shingles > 0").groupBy("label", "component_id", "r").agg(F.count(F.lit(1)).alias("n"))
    some = each.groupBy("label").agg(F.min(F.struct("r", "component_id", "n")).alias("m")).select("m.component_id", "m.r", "m.n")
    none = found.where("n_shingles = 0").select("component_id", "r").distinct().withColumn("n", F.lit(1).cast("long"))
    key_id, key_r, key_n = free_names(docs, "id", "r", "n")
    keep = written(some.unionByName(none).select(F.col("component_id").alias(key_id), F.col("r").alias(key_r), F.col("n").alias(key_n)), "keep")
    columns = [col(c) for c in docs.columns]

    def matched(rows: DataFrame, keys: DataFrame) -> DataFrame:
        return rows.join(keys, col(id_col).eqNullSafe(F.col(key_id)) & (F.xxhash64(col(text_col)) == F.col(key_r)))

    kept = matched(docs, keep.where(F.col(key_n) == 1)).select(*columns)
    again = keep.where(F.col(key_n) > 1)
    if not again.isEmpty():  # equal rows of one id and text: one of them, by partial aggregates
        (hashed,) = free_names(docs, "hash")
        likely = likely_in(docs.withColumn(hashed, F.xxhash64(col(text_col))), again.select(F.col(key_r).alias(hashed)), hashed)
        kept = kept.unionByName(matched(likely, again).dropDuplicates([key_id, key_r]).select(*columns))
    return kept


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


#: Links are looked for among all pairs that share a shingle, as a Jaccard similarity above 0 needs one.
OP6_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + 4], ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS p FROM d WHERE len(ws) > 0) z),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT x, y FROM p JOIN n nx ON p.x = nx.doc_id JOIN n ny ON p.y = ny.doc_id WHERE 100 * common >= 75 * (nx.n + ny.n - common)),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id),
c AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN c ON d.doc_id = c.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""
