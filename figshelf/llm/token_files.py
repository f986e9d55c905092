"""Token-ID files with a minimal perfect hash index (operator 2).

A data set is a folder:

* `shard-PPPPP-SSS.ids`: the magic word, the width of an id in bytes (2 or 4), then nothing but ids,
  little-endian, documents in ascending id order (null ids first), each ended by the end id. Tasks take ranges of
  about TASK_BYTES of text, or more where there would be over MAX_TASKS of them; a shard is closed at
  SHARD_BYTES, so long texts and large tasks make more shards, not larger ones.
* `keys/`: Parquet with the document ids of each shard, and which index file holds them.
* `index-NNNNN.npz`: for the keys of one hash bucket (about KEYS_PER_INDEX), a minimal perfect hash
  function and, at each key's number, a 32-bit fingerprint, shard, offset and length. A look-up hashes
  the key, opens one index file of bounded size, compares the fingerprint and reads one byte range.

The key is the document id and its occurrence (0, 1, ... where ids repeat), so repeated rows and null
ids keep entries of their own. Null and empty texts hold the end id alone; an empty table makes a data
set without shards. Columns other than the id and the text are not read.

Files are streamed under a name of the task attempt and then renamed, so a retried task replaces its own
files. They go through pyarrow's file systems (file, hdfs, s3, s3a, gs), as Spark has no writer of raw bytes.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from figshelf.llm.common import bounded_batches, col, documents, parts, written
from figshelf.llm.tokens import Encoder
from figshelf.llm.words import U, mix
from figshelf.sources.storage import attempt_name, new_folder, open_folder

MAGIC, HEADER = b"FIGSIDS", 8
TASK_BYTES, MAX_TASKS, SHARD_BYTES, KEYS_PER_INDEX, END_ID = 32 << 20, 20_000, 64 << 20, 50_000, 2


class Shards:
    """Writes the shards of one task, one after the other."""

    def __init__(self, folder: str, part: int, width: int, most: int):
        self.system, self.path = open_folder(folder)
        self.part, self.width, self.most = part, width, most
        self.shard, self.size, self.out = 0, 0, None

    def add(self, payload: bytes) -> tuple[int, int]:
        """The shard that payload goes to, and how many ids stand before it there."""
        if self.size and self.size + len(payload) > self.most:
            self.close()
        if self.out is None:
            self.name = f"{self.path}/{shard_name(self.part, self.shard)}"
            self.attempt = attempt_name(self.name)
            self.out = self.system.open_output_stream(self.attempt)
            self.out.write(MAGIC + bytes([self.width]))
        self.out.write(payload)
        self.size += len(payload)
        return self.shard, (self.size - len(payload)) // self.width

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.system.move(self.attempt, self.name)
            self.shard, self.size, self.out = self.shard + 1, 0, None


def shard_name(part: int, shard: int) -> str:
    return f"shard-{part:05d}-{shard:03d}.ids"


def key_hashes(ids: list, occurrences: list[int]) -> np.ndarray:
    """Two 64-bit hashes for each (id, occurrence)."""
    made = b"".join(xxhash.xxh3_128_digest(repr((i, int(k))).encode()) for i, k in zip(ids, occurrences))
    return np.frombuffer(made, U).reshape(-1, 2)


class PerfectHash:
    """Minimal perfect hash of distinct keys: at each level the keys that are alone in their slot stay
    there, the others go on to a smaller level; a key's number is the rank of its slot among full ones."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.begin = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        self.rank = np.cumsum(bits) - bits

    @staticmethod
    def _slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys[:, 0] + U(level)) ^ mix(keys[:, 1] * U(2 * level + 1))) % U(size)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, bits = [], []
        while len(keys):
            if len(sizes) > 500:
                raise ValueError("two keys have the same 128-bit hash")
            size = max(1, len(keys) * 3 // 2)
            slot = cls._slots(keys, len(sizes), size).astype(np.int64)
            alone = np.bincount(slot, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            keys = keys[~alone[slot]]
        return cls(np.array(sizes, np.int64), np.concatenate(bits) if bits else np.zeros(0, bool))

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number; of a key that was not there when built, any number or -1."""
        found = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            slot = self.begin[level] + self._slots(keys[todo], level, size).astype(np.int64)
            here = self.bits[slot]
            found[todo[here]] = self.rank[slot[here]]
            todo = todo[~here]
        return found


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys[:, 0] ^ U(0xA5A5A5A5)) >> U(32)).astype(np.uint32)


def bucket_of(keys: np.ndarray, n_index: int) -> np.ndarray:
    return (keys[:, 1] % U(n_index)).astype(np.int64)


def _index_bytes(keys: np.ndarray, part: np.ndarray, shard: np.ndarray, offset: np.ndarray, length: np.ndarray) -> bytes:
    function = PerfectHash.build(keys)
    number = function.numbers(keys)
    place = np.empty(len(keys), np.int64)
    place[number] = np.arange(len(keys))
    out = io.BytesIO()
    np.savez(out, sizes=function.sizes, bits=np.packbits(function.bits), fingerprint=fingerprints(keys)[place], part=part[place], shard=shard[place], offset=offset[place], length=length[place])
    return out.getvalue()


class IndexFile:
    def __init__(self, data: bytes):
        x = np.load(io.BytesIO(data))
        self.function = PerfectHash(x["sizes"], np.unpackbits(x["bits"])[: x["sizes"].sum()].astype(bool))
        self.fingerprint, self.part, self.shard, self.offset, self.length = (x[k] for k in ("fingerprint", "part", "shard", "offset", "length"))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of keys, and whether each one's fingerprint is the stored one."""
        number = self.function.numbers(keys)
        known = number >= 0
        known[known] = self.fingerprint[number[known]] == fingerprints(keys[known])
        return number, known


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", task_bytes: int = TASK_BYTES, shard_bytes: int = SHARD_BYTES, keys_per_index: int = KEYS_PER_INDEX) -> int:
    """Write docs as a data set into folder (new or empty); the number of index files."""
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    two = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    n_docs, n_bytes = two.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n_index, n_tasks = parts(n_docs, keys_per_index), min(MAX_TASKS, parts(n_bytes, task_bytes))
    system, path = open_folder(folder)
    system.create_dir(path, recursive=True)
    id_type = two.dtypes[0][1]
    ordered = two.repartitionByRange(n_tasks, F.asc_nulls_first("id"), F.xxhash64("text")).sortWithinPartitions(F.asc_nulls_first("id"), F.xxhash64("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        part, end = TaskContext.get().partitionId(), np.array([end_id], encoder.dtype).tobytes()
        shards = Shards(folder, part, encoder.width, shard_bytes)
        for batch in batches:
            shard, offset, length = [], [], []
            for ids in encoder.encode_column(batch.column(1)):
                payload = ids.tobytes() + end
                at = shards.add(payload)
                shard.append(at[0])
                offset.append(at[1])
                length.append(len(payload) // encoder.width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([part] * batch.num_rows, pa.int32()), *(pa.array(x, pa.int64()) for x in (shard, offset, length))], ["id", "part", "shard", "offset", "length"])
        shards.close()

    entries = written(ordered.mapInArrow(write, f"id {id_type}, part int, shard long, offset long, length long"), "token-entries")
    # an id's rows stand together: they are numbered within each shard, then by the shards that the id goes over
    placed = entries.withColumn("here", F.row_number().over(Window.partitionBy("id", "part", "shard").orderBy("offset")) - 1)
    runs = entries.groupBy("id", "part", "shard").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("id").orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1))
    later = runs.withColumn("before", earlier).where("before > 0").select(F.col("id").alias("id_"), F.col("part").alias("part_"), F.col("shard").alias("shard_"), "before")
    same = placed["id"].eqNullSafe(F.col("id_")) & (placed["part"] == F.col("part_")) & (placed["shard"] == F.col("shard_"))
    placed = placed.join(later, same, "left").select("id", "part", "shard", "offset", "length", (F.col("here") + F.coalesce("before", F.lit(0))).alias("occurrence"))

    def with_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = key_hashes(batch.column(0).to_pylist(), batch.column(5).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket_of(keys, n_index))], [*batch.schema.names, "bucket"])

    def index(table: pa.Table) -> pa.Table:
        system, path = open_folder(folder)
        keys = key_hashes(table["id"].to_pylist(), table["occurrence"].to_pylist())
        columns = (table[x].to_numpy() for x in ("part", "shard", "offset", "length"))
        name = f"{path}/index-{table['bucket'][0].as_py():05d}.npz"
        with system.open_output_stream(attempt := attempt_name(name)) as out:
            out.write(_index_bytes(keys, *columns))
        system.move(attempt, name)
        return table.select(["id", "occurrence", "bucket", "part", "shard"])

    bucketed = placed.mapInArrow(with_bucket, f"id {id_type}, part int, shard long, offset long, length long, occurrence long, bucket long")
    keys = bucketed.groupBy("bucket").applyInArrow(index, f"id {id_type}, occurrence long, bucket long, part int, shard long")
    keys.write.parquet(f"{folder}/keys")
    return n_index


class TokenFiles:
    """Keyed access to a data set: get(id) reads one index file (kept) and one range of a shard."""

    def __init__(self, folder: str, n_index: int):
        self.system, self.path = open_folder(folder)
        self.n_index, self.files = n_index, {}

    def index(self, bucket: int) -> IndexFile:
        if bucket not in self.files:
            with self.system.open_input_file(f"{self.path}/index-{bucket:05d}.npz") as f:
                self.files[bucket] = IndexFile(f.read())
        return self.files[bucket]

    def get(self, doc_id, occurrence: int = 0) -> np.ndarray | None:
        """The ids of a document, its end id included; None if there is no such key."""
        keys = key_hashes([doc_id], [occurrence])
        try:
            found = self.index(int(bucket_of(keys, self.n_index)[0]))
        except FileNotFoundError:
            return None
        number, known = found.find(keys)
        if not known[0]:
            return None
        i = int(number[0])
        with self.system.open_input_file(f"{self.path}/{shard_name(int(found.part[i]), int(found.shard[i]))}") as f:
            width = f.read_at(HEADER, 0)[7]
            return np.frombuffer(f.read_at(int(found.length[i]) * width, HEADER + int(found.offset[i]) * width), f"<u{width}")


def read_token_files(spark: SparkSession, folder: str, n_index: int) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the index and the shards."""
    bounded_batches(spark)
    keys = spark.read.parquet(f"{folder}/keys")
    id_type = keys.dtypes[0][1]

    def look_up(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        found = TokenFiles(folder, n_index).index(bucket)
        number, known = found.find(key_hashes(table["id"].to_pylist(), table["occurrence"].to_pylist()))
        if not known.all():
            raise ValueError(f"index {bucket} does not know {int((~known).sum())} of its keys")
        return pa.table({"id": table["id"], "part": found.part[number], "shard": found.shard[number], "offset": found.offset[number], "length": found.length[number]})

    found = written(keys.groupBy("bucket").applyInArrow(look_up, f"id {id_type}, part int, shard long, offset long, length long"), "found")
    by_shard = found.repartition("part", "shard").sortWithinPartitions("part", "shard", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        now, f, width = None, None, 2
        for batch in batches:
            crc = []
            for part, shard, offset, length in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4))):
                if now != (part, shard):
                    now, f = (part, shard), system.open_input_file(f"{path}/{shard_name(part, shard)}")
                    head = f.read_at(HEADER, 0)
                    if head[:7] != MAGIC:
                        raise ValueError(f"{shard_name(part, shard)} is not a shard of token ids")
                    width = head[7]
                crc.append(zlib.crc32(np.frombuffer(f.read_at(length * width, HEADER + offset * width), f"<u{width}").astype("<u4")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(crc, pa.int64())], [*batch.schema.names, "crc"])

    each = by_shard.mapInArrow(read, f"id {id_type}, part int, shard long, offset long, length long, crc long")
    # ids before each shard: sums over the tasks, of which there are at most MAX_TASKS, and over the shards of each
    sums = written(found.groupBy("part", "shard").agg(F.sum("length").alias("n")), "shard-sizes")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tasks = sums.groupBy("part").agg(F.sum("n").alias("n")).withColumn("base", before(Window.orderBy("part"))).drop("n")
    base = sums.join(tasks, "part").withColumn("base", F.col("base") + before(Window.partitionBy("part").orderBy("shard"))).drop("n")
    return each.join(base, ["part", "shard"]).select("id", (F.col("base") + F.col("offset")).alias("start"), F.col("length").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_folder(spark, "token-files")
    n_index = write_token_files(documents(spark, sf_dir), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, folder, n_index).withColumnRenamed("id", "doc_id")
