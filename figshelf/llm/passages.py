"""Substring dedup by super-k-mer partitioning (operator 5).

A window is WINDOW consecutive words of one text. A word is removed if a window covers it whose word
sequence also starts in a document with a smaller id; windows are judged on the input.

1. Exact copies: of the rows with one and the same word sequence only the smallest id goes on. In the
   others every window has a smaller holder, so all their words go (or none, below WINDOW words).
2. A window's minimiser is the least hash of its MINIMISER-word grams. Consecutive windows that share
   it form a super-k-mer. First only the minimisers travel; those met in one document are dropped.
3. The super-k-mers of the other minimisers travel, each as one packed string, to their minimiser's
   bucket. There windows are compared word by word: equal ones are numbered, sorted and counted, and
   those with a smaller holder are sent back to their document as spans.
4. A minimiser with more than HOT super-k-mers (a passage that very many documents hold) would make one
   task long. Its windows travel singly, as 128-bit hashes, and are reduced on the map side.

Null and empty texts have no words. Rows with one id are one document: they never take words from
each other. Rows with a null id take no part and keep their words. Very long texts are cut nowhere.
Other columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figshelf.llm.common import CHUNK_BYTES, bounded_batches, col, documents, free_names, map_batches, quoted, row_chunks, text_bytes, working_tables
from figshelf.llm.words import U, Words, stretches, words_of

WINDOW, MINIMISER, HOT = 50, 20, 5000


def window_minimisers(words: Words, window: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first words of all windows, and the least hash of each one's `size`-word grams."""
    if len(words) < window:
        return np.zeros(0, np.int64), np.zeros(0, U)
    at, grams = words.windows(size, words.hashes())
    least = np.full(len(words), np.iinfo(U).max, U)
    least[at] = grams
    width, span = window - size + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    n = len(words) - window + 1
    at = np.flatnonzero(words.text[:n] == words.text[window - 1 :])
    return at, least[at]


def super_kmers(words: Words, window: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of one text with one minimiser: first word, number of windows, minimiser."""
    at, least = window_minimisers(words, window, size)
    if not len(at):
        return at, at, least
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at))), least[first]


def _chunks(column: pa.Array, window: int) -> Iterator[tuple[int, int, Words]]:
    """Runs of words: the first row of each, the place of its first word in that row's text, and the words.

    A long text comes in several runs, each window in one of them; so a super-k-mer may come in two parts.
    """
    data, offsets = text_bytes(column)
    for lo, hi in row_chunks(offsets):
        part = data[offsets[lo] : offsets[hi]]
        if len(part) <= CHUNK_BYTES:
            yield lo, 0, words_of(part, offsets[lo : hi + 1] - offsets[lo])
        else:
            for number, words in stretches(part, window - 1):
                yield lo, number, words


def minimisers(rows: DataFrame, window: int, size: int) -> DataFrame:
    """(id, r, m, n): each row's minimisers and how many super-k-mers have them."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, words in _chunks(batch.column(1), window):
                at, _, least = super_kmers(words, window, size)
                text = words.text[at]
                order = np.lexsort((least, text))
                t, m = text[order], least[order]
                first = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (m[1:] != m[:-1])))) if len(t) else np.zeros(0, np.int64)
                which = pa.array(lo + t[first])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(2).take(which), pa.array(m[first].view(np.int64)), pa.array(np.diff(np.append(first, len(t))), pa.int64())], ["id", "r", "m", "n"])

    return rows.mapInArrow(emit, f"id {rows.dtypes[0][1]}, r long, m long, n long")


def _travelling(marked: DataFrame, window: int, size: int) -> DataFrame:
    """(id, r, m, start, packed, h): super-k-mers with a shared minimiser, packed; the windows of hot ones by hash."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cold, hot = batch.column(3), batch.column(4)
            for lo, before, words in _chunks(batch.column(1), window):
                at, n, least = super_kmers(words, window, size)
                row, ms, starts, packed, hashes = [], [], [], [], []
                least = least.view(np.int64)
                text = words.text[at]
                edges = np.searchsorted(text, np.arange(len(words.first)))
                for t in range(len(words.first) - 1):
                    a, b = edges[t], edges[t + 1]
                    c, h = (np.asarray(x[lo + t].values, np.int64) for x in (cold, hot))
                    first = int(words.first[t]) - before
                    for i in (a + np.flatnonzero(np.isin(least[a:b], c))).tolist():
                        row.append(lo + t)
                        ms.append(int(least[i]))
                        starts.append(int(at[i]) - first)
                        packed.append(words.span(int(at[i]), int(at[i] + n[i]) + window - 1))
                        hashes.append(None)
                    for i in (a + np.flatnonzero(np.isin(least[a:b], h))).tolist():
                        for j in range(int(at[i]), int(at[i] + n[i])):
                            row.append(lo + t)
                            ms.append(int(least[i]))
                            starts.append(j - first)
                            packed.append(None)
                            hashes.append(xxhash.xxh3_128_digest(words.span(j, j + window)))
                which = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(2).take(which), pa.array(ms, pa.int64()), pa.array(starts, pa.int64()), pa.array(packed, pa.binary()), pa.array(hashes, pa.binary())], ["id", "r", "m", "start", "packed", "h"])

    return marked.mapInArrow(emit, f"id {marked.dtypes[0][1]}, r long, m long, start long, packed binary, h binary")


def lost_windows(ids: np.ndarray, packed: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of whole buckets: rows, and first and last window (excluded) of the runs with a smaller holder."""
    data, offsets = text_bytes(packed)
    words = words_of(data, offsets)
    raw = data.tobytes()
    at = np.flatnonzero(words.text[: len(words) - window + 1] == words.text[window - 1 :]) if len(words) >= window else np.zeros(0, np.int64)
    number: dict[bytes, int] = {}
    code = np.array([number.setdefault(raw[s:e], len(number)) for s, e in zip(words.start[at].tolist(), words.end[at + window - 1].tolist())], np.int64)
    row = words.text[at]
    order = np.lexsort((ids[row], code))
    first = np.concatenate(([True], code[order][1:] != code[order][:-1])) if len(order) else np.zeros(0, bool)
    holder = np.empty(len(number), ids.dtype)
    holder[code[order][first]] = ids[row][order][first]
    lost = np.flatnonzero(ids[row] > holder[code])
    if not len(lost):
        return lost, lost, lost
    fresh = np.concatenate(([True], (at[lost][1:] != at[lost][:-1] + 1) | (row[lost][1:] != row[lost][:-1])))
    begin, end = lost[fresh], lost[np.append(fresh[1:], True)]
    return row[begin], at[begin] - words.first[row[begin]], at[end] - words.first[row[begin]] + 1


def _bucket_spans(travelling: DataFrame, window: int) -> DataFrame:
    """(id, r, lo, hi): spans of words to remove, from the packed super-k-mers of each bucket."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held and (table := pa.Table.from_batches(held).combine_chunks()).num_rows:
                ids, start = table["id"].to_numpy(), table["start"].to_numpy()
                row, lo, hi = lost_windows(ids, table["packed"].combine_chunks(), window)
                which = pa.array(row)
                yield pa.RecordBatch.from_arrays([table["id"].combine_chunks().take(which), table["r"].combine_chunks().take(which), pa.array(start[row] + lo), pa.array(start[row] + hi + window - 1)], ["id", "r", "lo", "hi"])
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            m = batch.column(2).to_numpy()
            whole = int(np.searchsorted(m, m[-1]))  # sorted by m: the last bucket may go on in the next batch
            if whole or held and held[-1].column(2)[held[-1].num_rows - 1].as_py() != m[0]:
                held.append(batch.slice(0, whole))
                yield from flush()
            held.append(batch.slice(whole))
        yield from flush()

    by_bucket = travelling.where("packed IS NOT NULL").select("id", "r", "m", "start", "packed").repartition("m").sortWithinPartitions("m")
    return by_bucket.mapInArrow(solve, f"id {by_bucket.dtypes[0][1]}, r long, lo long, hi long")


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, size: int = MINIMISER, hot: int = HOT) -> DataFrame:
    """(id, r, spans): of each row that loses words, the spans of words to remove.

    r is a hash of the row's text, as ids may repeat; null spans: all words go, if there is a window.
    """
    with working_tables(docs.sparkSession) as written:
        rows = docs.select(col(id_col).alias("id"), col(text_col).alias("text"), F.xxhash64(col(text_col)).alias("r")).where("id IS NOT NULL AND text IS NOT NULL")
        whole = written(rows.select("id", "r", F.xxhash64(F.lit(1), "text").alias("q")), "text-hashes")
        first = whole.groupBy("r", "q").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
        copies = written(whole.join(first, ["r", "q"]).where("id > least").select("id", "r").distinct(), "copies", keep=True)
        minis = written(minimisers(rows, window, size).join(copies, ["id", "r"], "left_anti"), "minimisers")
        shared = minis.groupBy("m").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.sum("n").alias("total")).where("a < b").select("m", (F.col("total") > hot).alias("is_hot"))
        shared = written(shared, "shared-minimisers")  # both sides of the join come straight from a shuffle, so Spark splits a hot key
        lists = minis.join(shared, "m").groupBy("id", "r").agg(F.collect_set(F.when(~F.col("is_hot"), F.col("m"))).alias("cold"), F.collect_set(F.when(F.col("is_hot"), F.col("m"))).alias("hot"))
        marked = rows.join(lists, ["id", "r"]).select("id", "text", "r", "cold", "hot")
        travelling = written(_travelling(marked, window, size), "super-k-mers", keep=True)
        windows = travelling.where("h IS NOT NULL").select("id", "r", "start", "h")
        least = windows.groupBy("h").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("h", "least")
        least = written(least, "shared-windows", keep=True)
    single = windows.join(least, "h").where("id > least").select("id", "r", F.col("start").alias("lo"), (F.col("start") + window).alias("hi"))
    spans = _bucket_spans(travelling, window).unionByName(single)
    lists = spans.groupBy("id", "r").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    none = copies.withColumn("spans", F.lit(None).cast(lists.schema["spans"].dataType))
    return lists.unionByName(none).select("id", "r", "spans")


def kept_words(text: bytes, hit: bool, spans: list[dict] | None, window: int) -> tuple[list[bytes], int, int]:
    """The words that stay, the number before, the number removed."""
    words = text.split()  # bytes: only ASCII white space
    n = len(words)
    if not hit or n < window:
        return words, n, 0
    if spans is None:
        return [], n, n
    out, at = [], 0
    for lo, hi in sorted((x["lo"], x["hi"]) for x in spans):
        out += words[at:lo] if lo > at else []
        at = max(at, hi)
    out += words[at:]
    return out, n, n - len(out)


def _with_removals(docs: DataFrame, id_col: str, text_col: str, window: int, size: int, hot: int) -> DataFrame:
    """docs with two more columns at the end: spans, and whether the row loses words."""
    key_id, key_r, spans, hit = free_names(docs, "id", "r", "spans", "hit")
    found = removals(docs, id_col, text_col, window, size, hot).toDF(key_id, key_r, spans).withColumn(hit, F.lit(True))
    same = (col(id_col) == F.col(key_id)) & (F.xxhash64(col(text_col)) == F.col(key_r))
    return docs.join(found, same, "left").drop(key_id, key_r)


def _texts(column: pa.Array) -> Iterator[bytes]:
    data, offsets = text_bytes(column)
    raw, ends = data.tobytes(), offsets.tolist()
    return (raw[s:e] for s, e in zip(ends[:-1], ends[1:]))


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, size: int = MINIMISER, hot: int = HOT) -> DataFrame:
    """docs; of texts that lose words the rest is joined by one space, other texts stay as they are."""
    bounded_batches(docs.sparkSession)
    names = docs.columns
    place = names.index(text_col)

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, out = list(batch.columns), []
            for text, old, spans, hit in zip(_texts(columns[place]), columns[place], columns[-2].to_pylist(), columns[-1].to_pylist()):
                words, _, gone = kept_words(text, bool(hit), spans, window)
                out.append(b" ".join(words).decode() if gone else old.as_py())
            columns[place] = pa.array(out, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns[:-2], names)

    return map_batches(_with_removals(docs, id_col, text_col, window, size, hot), rebuild, docs.schema)


def passage_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, size: int = MINIMISER, hot: int = HOT) -> DataFrame:
    """Per row: its id, n_words, n_removed, and the SHA-256 of the kept words joined by one space."""
    bounded_batches(docs.sparkSession)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(n, gone, hashlib.sha256(b" ".join(words)).hexdigest()) for words, n, gone in (kept_words(t, bool(h), s, window) for t, s, h in zip(_texts(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()))]
            columns = list(zip(*made)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], [id_col, "n_words", "n_removed", "kept_sha256"])

    two = docs.select(col(id_col), col(text_col))
    return map_batches(_with_removals(two, id_col, text_col, window, size, hot), report, f"{quoted(id_col)} {two.dtypes[0][1]}, n_words long, n_removed long, kept_sha256 string")


def op5_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_report(documents(spark, sf_dir))


OP5_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (SELECT r, doc_id, p, array_to_string(ws[p:p + 49], ' ') AS win
    FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM d WHERE len(ws) >= 50) z),
c AS (SELECT win, min(doc_id) AS least FROM w GROUP BY win HAVING min(doc_id) < max(doc_id)),
lost AS (SELECT r, p FROM w JOIN c ON w.win = c.win WHERE doc_id > least),
words AS (SELECT d.r, doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM d),
m AS (SELECT words.*, coalesce(max(lost.p) OVER (PARTITION BY words.r ORDER BY words.p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) > 0 AS gone
    FROM words LEFT JOIN lost ON words.r = lost.r AND words.p = lost.p),
s AS (SELECT r, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
    sha256(coalesce(string_agg(word, ' ' ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY r)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM d LEFT JOIN s ON d.r = s.r
"""
