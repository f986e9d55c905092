"""A store of images by what they hold: each different image is one file, named by its digest.

Tasks write and read the files themselves, so no image goes through a shuffle to be stored, and rows carry digests instead of images.
A file is written under its attempt's name and then renamed, and an image that is there already is left alone: retried tasks, further
runs and other writers do no harm. Files are never changed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figshelf.sources.storage import attempt_name, new_folder, open_folder

INLINE = "data:image/png"  # how a render_url that is an image itself begins


class ImageStore:
    """Images below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def put(self, images: DataFrame) -> DataFrame:
        """Store images (path, content); (path, digest) of those that have content, as a written table."""
        root = self.path

        def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, folder = open_folder(root)
            there: set[str] = set()  # the digests that this task has seen to, 64 bytes each
            for batch in batches:
                digests = []
                for content in batch.column(1):
                    data = content.as_buffer()
                    digests.append(digest := hashlib.sha256(data).hexdigest())
                    if digest not in there:
                        _save(system, _file(folder, digest), data)
                        there.add(digest)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string())], ["path", "digest"])

        made = images.where("content IS NOT NULL").select("path", "content").mapInArrow(save, "path string, digest string")
        names = new_folder(self.spark, "image-names")
        made.write.parquet(names)  # once: what a plan of it would do again is writing files
        return self.spark.read.parquet(names)

    def get(self, digests: DataFrame) -> DataFrame:
        """(digest, content) for each row of digests (its first column); content is null where there is no such image. Only these files are read."""
        root = self.path

        def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, folder = open_folder(root)
            for batch in batches:
                for digest in batch.column(0).to_pylist():  # one image a batch, as it may be large
                    yield pa.RecordBatch.from_arrays([pa.array([digest], pa.string()), pa.array([_load(system, _file(folder, digest))], pa.binary())], ["digest", "content"])

        name = digests.columns[0]
        return digests.where(F.col(name).isNotNull()).select(name).mapInArrow(load, "digest string, content binary")


def with_digests(figures: DataFrame, names: DataFrame) -> DataFrame:
    """figures with image_digest, by their render_url; null for inline images and those that were not found.

    names: (path, digest); of a path with two images the least digest counts.
    """
    one = names.groupBy(F.col("path").alias("__path")).agg(F.min("digest").alias("image_digest"))
    # an inline image is no name of a file, and is kept out of the join's key
    url = F.when(~F.col("render_url").startswith(INLINE), F.col("render_url"))
    return figures.withColumn("__url", url).join(one, F.col("__url") == F.col("__path"), "left").drop("__url", "__path")


def _file(folder: str, digest: str) -> str:
    """Folders by the first two digits, so that none has all files."""
    return f"{folder}/{digest[:2]}/{digest}.png"


def _save(system: fs.FileSystem, name: str, data: pa.Buffer) -> None:
    if system.get_file_info(name).type != fs.FileType.NotFound:
        return
    system.create_dir(name.rpartition("/")[0], recursive=True)
    attempt = attempt_name(name)
    try:
        with system.open_output_stream(attempt) as out:
            out.write(data)
    except BaseException:
        if system.get_file_info(attempt).type != fs.FileType.NotFound:
            system.delete_file(attempt)
        raise
    system.move(attempt, name)


def _load(system: fs.FileSystem, name: str) -> bytes | None:
    try:
        with system.open_input_stream(name) as file:
            return file.read()
    except FileNotFoundError:
        return None
