"""What the corpus operators share: written tables, names of columns and Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from figshelf.sources.storage import new_folder, remove

#: Arrow batches handed to Python, where the session does not say otherwise: rows hold whole texts.
BATCH_CONF = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("2000", "-1"), "spark.sql.execution.arrow.maxBytesPerBatch": ("8m", "1b")}
CHUNK_BYTES = 1 << 20  # text handled by numpy at once inside a task


#: In DuckDB, the unsigned CRC-32 of an integer's decimal digits: a byte at a time, and each of its bits.
CRC32_SQL = (
    "CASE WHEN {0} IS NULL THEN NULL ELSE xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),"
    " lambda acc, b: list_reduce(list_prepend(xor(acc, b), range(8)), lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)), 4294967295) END"
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes that Python gets at once, by those settings of BATCH_CONF that the session has not set."""
    for key, (value, unset) in BATCH_CONF.items():
        if spark.conf.get(key, unset) == unset:
            spark.conf.set(key, value)


Writer = Callable[..., DataFrame]


def written(df: DataFrame, name: str, keep: bool = True) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives a lost executor. Removed when the driver's Python ends."""
    return written_to(df, new_folder(df.sparkSession, name))


def written_to(df: DataFrame, path: str) -> DataFrame:
    """df as a Parquet table in a folder of the caller's."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def working_tables(spark: SparkSession) -> Iterator[Writer]:
    """A `written` whose tables are removed at the end of the block, but for those to keep: results read these later on."""
    made = []

    def write(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
        path = new_folder(spark, name)
        if not keep:
            made.append(path)
        return written_to(df, path)

    try:
        yield write
    finally:
        for path in made:
            remove(spark, path)


def parts(n_rows: int, per_part: int) -> int:
    return max(1, -(-n_rows // per_part))


def quoted(name: str) -> str:
    """A column's name as SQL takes it, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that no column of df has, in either case of letters."""
    taken, mark = {c.lower() for c in df.columns}, "__fs"
    while any(c.startswith(mark) for c in taken):
        mark += "_"
    return [f"{mark}{n}" for n in names]


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """df.mapInArrow(f, schema) by the columns' places, as mapInArrow takes no names with dots or backticks in them."""
    made = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = [f"c{k}" for k in range(len(made))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in f(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names)

    numbered = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    return numbered.mapInArrow(run, StructType([StructField(n, x.dataType) for n, x in zip(names, made)])).toDF(*made.fieldNames())


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end and its n+1 row offsets; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes each; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi
        lo = hi


#: Bits of each of MAPS bitmaps, as bitmap_construct_agg makes them: 4 KB each, 4 MB in all at any size of input.
MAP_BITS, MAPS = 32_768, 1024


def likely_in(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """rows whose hash `key` (a long) may be among those of wanted: all that are, and few others while wanted is small.

    A filter of at most MAPS bitmaps is broadcast; it keeps rows without a partner out of the shuffle that follows.
    """
    number, place, bits = free_names(rows, "map", "bit", "bits")
    bit = F.pmod(F.col(key), F.lit(MAP_BITS * MAPS))
    maps = wanted.select((bit / MAP_BITS).cast("long").alias(number), (bit % MAP_BITS).alias(place)).groupBy(number).agg(F.bitmap_construct_agg(place).alias(bits))
    marked = rows.withColumns({number: (bit / MAP_BITS).cast("long"), place: (bit % MAP_BITS).cast("int")})
    byte = F.conv(F.hex(F.substr(bits, (F.col(place) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return marked.join(F.broadcast(maps), number).where(F.getbit(byte, F.col(place) % 8) == 1).select(*(col(c) for c in rows.columns))
