"""Folders that all tasks share, and files that Spark has no writer for."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hadoop's names of stores that pyarrow knows by another name.
SAME_STORE = {"s3a": "s3", "s3n": "s3"}


def pyarrow_uri(uri: str) -> str:
    """A URI as Hadoop writes it, as pyarrow writes it."""
    scheme, parted, rest = uri.partition("://")
    if parted and scheme in SAME_STORE:
        return f"{SAME_STORE[scheme]}://{rest}"
    if not parted and uri.startswith("file:/"):
        return "file:///" + uri.removeprefix("file:").lstrip("/")
    return uri


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system of a folder (file, hdfs, viewfs, s3, s3a, gs), and the path in it."""
    system, path = fs.FileSystem.from_uri(pyarrow_uri(uri))
    return system, path.rstrip("/")


def attempt_name(path: str) -> str:
    """A name of its own for the file that a task attempt writes, to be renamed to path when it is whole."""
    folder, _, name = path.rpartition("/")
    context = TaskContext.get()
    return f"{folder}/.{name}.{context.taskAttemptId() if context else 0}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (local mode without one) one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="figshelf-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """The name of a fresh folder under the shared one, removed when the driver's Python ends (or by remove)."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove_quietly, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    system, at = _hadoop(spark, path)
    system.delete(at, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives a lost executor."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Names, files and bytes that a task hands on at once.
NAMES, FILES, FILE_BYTES = 10_000, 1_000, 8 << 20


def _hidden(name: str) -> bool:
    """Names that Spark's readers leave out."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _open_path(path: str) -> tuple[fs.FileSystem, str]:
    """As open_folder, of a path as Hadoop writes it: nothing in it stands for another letter."""
    return (fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")) if path.startswith("file:/") else open_folder(path)


def _entries(path: str) -> Iterator[tuple[str, bool]]:
    """(path, is a folder) of what is in a folder; of a file the file itself. A local folder is gone through, elsewhere a folder's list is held."""
    system, at = _open_path(path)
    if system.get_file_info(at).type == fs.FileType.File:
        yield path, False
    elif isinstance(system, fs.LocalFileSystem):
        with os.scandir(at) as found:
            yield from ((f"{path}/{x.name}", x.is_dir()) for x in found if not _hidden(x.name))
    else:
        yield from ((f"{path}/{x.base_name}", x.type == fs.FileType.Directory) for x in system.get_file_info(fs.FileSelector(at)) if not _hidden(x.base_name))


def _list_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            entries = _entries(folder)
            while rows := list(islice(entries, NAMES)):
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.string()), pa.array([x for _, x in rows], pa.bool_())], ["path", "folder"])


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made = lambda paths, contents: pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])
    last = None
    for batch in batches:
        paths, contents, size = [], [], 0
        for path in batch.column(0).to_pylist():
            folder, _, name = path.rpartition("/")
            if folder != last:
                (system, at), last = _open_path(folder), folder
            with system.open_input_stream(f"{at}/{name}", compression=None) as file:
                content = file.read()
            if not content:
                continue
            paths.append(path)
            contents.append(content)
            size += len(content)
            if len(paths) >= FILES or size >= FILE_BYTES:
                yield made(paths, contents)
                paths, contents, size = [], [], 0
        if paths:
            yield made(paths, contents)


def files_below(spark: SparkSession, path: str, ending: str) -> DataFrame:
    """(path, content) of every file below a folder whose name ends so, as Spark's binaryFile gives them: but empty and hidden ones.

    Names are listed by tasks, a folder in one, and kept as a table, and files are read by tasks: Spark's reader holds every file's name and status in the driver.
    """
    system, at = _hadoop(spark, path)
    parts, found = int(spark.conf.get("spark.sql.shuffle.partitions")), []
    folders = spark.createDataFrame([(system.makeQualified(at).toString(),)], "path string")
    while True:
        listed = stored(folders.repartition(parts, "path").mapInArrow(_list_folders, "path string, folder boolean"), "names")
        found.append(listed.where(~F.col("folder") & F.endswith("path", F.lit(ending))).select("path"))
        folders = listed.where("folder").select("path")
        if folders.isEmpty():
            break
    return reduce(DataFrame.unionByName, found).repartition(parts, "path").mapInArrow(_read_files, "path string, content binary")


#: What opening a file counts for, in bytes, where Spark deals files to tasks (its own 4 MB make a task of every 32 small files), and the tasks that look up
#: a list of files (by Spark's own setting one for each of up to 10,000).
SMALL_FILES = {"spark.sql.files.openCostInBytes": (("4194304", "4194304b", "4MB"), "65536"), "spark.sql.sources.parallelPartitionDiscovery.parallelism": (("10000",), "64")}


def many_small_files(spark: SparkSession) -> None:
    """Let a task read, or look up, some hundred or thousand small files, where the session has not set that. Holds for the session, as readers have no option for it."""
    for key, (usual, value) in SMALL_FILES.items():
        if spark.conf.get(key) in usual:
            spark.conf.set(key, value)


def _hadoop(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it wants it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def list_names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if it isn't there."""
    system, at = _hadoop(spark, path)
    return [x.getPath().getName() for x in system.listStatus(at)] if system.exists(at) else []


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A small file, through Hadoop's file systems."""
    system, at = _hadoop(spark, path)
    stream = system.open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def put_if_absent(spark: SparkSession, path: str, content: bytes) -> bool:
    """Make a small file whole and at once, unless it is there already; whether it was made.

    The content goes to a name of its own first. A local file is then linked, elsewhere Hadoop renames without overwriting, which HDFS does
    in one step; stores whose renames are copies are not for this.
    """
    system, at = _hadoop(spark, path)
    folder = at.getParent()
    system.mkdirs(folder)
    draft = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, f".{at.getName()}.{uuid.uuid4().hex}")
    out = system.create(draft, False)
    out.write(bytearray(content))
    out.close()
    try:
        if system.getScheme() == "file":
            os.link(draft.toUri().getPath(), at.toUri().getPath())
            return True
        jvm = spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(draft, at, none)
        return True
    except FileExistsError:
        return False
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
            raise
        return False
    finally:
        system.delete(draft, False)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session has ended already; the folder is the cluster's to clear
        pass
