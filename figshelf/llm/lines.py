"""Line dedup: lines that many documents share stay in one of them (operator 7).

Every text is split at \\n; a line's key is the line with `[\\x20\\x09-\\x0D]` stripped at both ends
and A-Z lower-cased. Keys are exploded as 128-bit hashes, distinct documents are counted per hash, and
keys of at least MIN_CHARS code points found in at least MIN_DOCS documents lose all their lines except
in the largest document id that holds them. The other lines are put back in their order.

Null and empty texts are one empty line. Rows with the same id are one document in the count and are
each treated alike; rows with a null id are no document: they count for nothing and keep their lines.
A text that loses every line becomes empty. Other columns pass through unchanged, whatever their names.

Shuffled are 16-byte hashes with ids, never lines; the count combines on the map side, so a line that
a third of all documents hold is no hot group; texts move once, to meet their own list of hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figshelf.llm.common import bounded_batches, col, documents, free_names, map_batches, quoted, text_bytes, written

MIN_CHARS, MIN_DOCS = 40, 5


def line_key(line: bytes) -> bytes:
    return line.strip().lower()  # bytes: only ASCII white space and only A-Z


def long_key_hash(line: bytes, min_chars: int) -> bytes | None:
    key = line_key(line)
    if len(key) < min_chars or not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def _texts(column: pa.Array) -> Iterator[bytes]:
    data, offsets = text_bytes(column)
    view, ends = data.tobytes(), offsets.tolist()
    return (view[s:e] for s, e in zip(ends[:-1], ends[1:]))


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, h): the distinct hashes of each row's long keys."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hashes = [], []
            for row, text in enumerate(_texts(batch.column(1))):
                own = {h for line in text.split(b"\n") if len(line) >= min_chars and (h := long_key_hash(line, min_chars))}
                hashes += own
                rows += [row] * len(own)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(hashes, pa.binary())], ["id", "h"])

    two = docs.select(col(id_col), col(text_col)).where(col(id_col).isNotNull())
    return map_batches(two, explode, f"id {two.dtypes[0][1]}, h binary")


def dropped_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """(id, drops): for each document that loses lines, the hashes of their keys."""
    lines = written(line_hashes(docs, id_col, text_col, min_chars), "line-hashes")
    common = lines.groupBy("h").agg(F.count_distinct("id").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs)
    # as a table, so that both sides of the join come straight from a shuffle: Spark splits the rows of a hot line
    common = written(common.select("h", "keeper"), "common-lines")
    lost = lines.join(common, "h").where(F.col("id") < F.col("keeper"))
    return lost.groupBy("id").agg(F.collect_set("h").alias("drops"))


def without(text: bytes, drops: list[bytes] | None, min_chars: int) -> tuple[bytes, int, int]:
    """The text without the lines whose keys hash into drops, its lines before, and the lines dropped."""
    lines = text.split(b"\n")
    if not drops:
        return text, len(lines), 0
    gone = set(drops)
    kept = [line for line in lines if len(line) < min_chars or long_key_hash(line, min_chars) not in gone]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def _with_drops(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """docs with one more column at the end: the hashes of the keys whose lines go."""
    key, hashes = free_names(docs, "id", "drops")
    drops = dropped_hashes(docs, id_col, text_col, min_chars, min_docs).toDF(key, hashes)
    return docs.join(drops, col(id_col) == F.col(key), "left").drop(key)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with the shared lines gone; a column n_chars, if there is one of type long, follows the text."""
    bounded_batches(docs.sparkSession)
    names = docs.columns
    place, chars = names.index(text_col), names.index("n_chars") if dict(docs.dtypes).get("n_chars") == "bigint" else None
    schema = docs.schema

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns[:-1])
            lists = batch.column(len(names)).to_pylist()
            new = [without(t, d, min_chars)[0].decode() if d else None for t, d in zip(_texts(columns[place]), lists)]
            changed = pa.array([d is not None for d in lists])
            text = pa.array(new, columns[place].type)
            columns[place] = pc.if_else(changed, text, columns[place])
            if chars is not None:
                columns[chars] = pc.if_else(changed, pc.utf8_length(text).cast(pa.int64()), columns[chars])
            yield pa.RecordBatch.from_arrays(columns, names)

    return map_batches(_with_drops(docs, id_col, text_col, min_chars, min_docs), rebuild, schema)


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Per row: its id, n_lines before, n_dropped, and the SHA-256 of the text that dedup_lines leaves."""
    bounded_batches(docs.sparkSession)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(n, gone, hashlib.sha256(text).hexdigest()) for text, n, gone in (without(t, d, min_chars) for t, d in zip(_texts(batch.column(1)), batch.column(2).to_pylist()))]
            columns = list(zip(*made)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], [id_col, "n_lines", "n_dropped", "kept_sha256"])

    two = docs.select(col(id_col), col(text_col))
    return map_batches(_with_drops(two, id_col, text_col, min_chars, min_docs), report, f"{quoted(id_col)} {two.dtypes[0][1]}, n_lines long, n_dropped long, kept_sha256 string")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(documents(spark, sf_dir))


OP7_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(range(1, len(ls) + 1)) AS p, unnest(ls) AS line FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, coalesce(doc_id < keeper, false) AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""
