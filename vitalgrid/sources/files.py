"""Files and folders on whatever file system Spark reads: the same paths serve driver and executors."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame, SparkSession


class Files:
    """A few operations of the Hadoop file system that a path belongs to."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        where = self._jvm.org.apache.hadoop.fs.Path(str(path))
        return where.getFileSystem(self._conf), where

    def exists(self, path: str) -> bool:
        fs, where = self._at(path)
        return fs.exists(where)

    def names(self, path: str) -> list[str]:
        """Names of what is in a folder; none if there is no such folder."""
        fs, where = self._at(path)
        return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []

    def below(self, path: str) -> list[tuple[str, int]]:
        """(path, bytes) of a file, or of every file below a folder, hidden ones left out; empty files count."""
        fs, where = self._at(path)
        out, found = [], fs.listFiles(where, True)
        while found.hasNext():
            s = found.next()
            if not s.getPath().getName().startswith((".", "_")):
                out.append((s.getPath().toString(), s.getLen()))
        return out

    def make_folder(self, path: str) -> None:
        fs, where = self._at(path)
        fs.mkdirs(where)

    def rename(self, old: str, new: str) -> None:
        fs, where = self._at(old)
        if not fs.rename(where, self._jvm.org.apache.hadoop.fs.Path(str(new))):
            raise OSError(f"{old} could not be renamed to {new}")

    def remove(self, path: str) -> None:
        fs, where = self._at(path)
        fs.delete(where, True)

    def write_text(self, path: str, text: str) -> None:
        fs, where = self._at(path)
        out = fs.create(where, True)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()

    def read_text(self, path: str) -> str:
        fs, where = self._at(path)
        data = fs.open(where)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(data, "UTF-8")
        finally:
            data.close()


    def digest(self, path: str) -> str:
        """SHA-256 of a file, streamed by this JVM."""
        fs, where = self._at(path)
        data = fs.open(where)
        try:
            return self._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(data)
        finally:
            data.close()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share, spark.checkpoint.dir; below a local one only where all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="scratch-")
    return join_path(root, f"{name}-{uuid.uuid4().hex}")


def join_path(folder: str, *names: str) -> str:
    return "/".join([str(folder).rstrip("/"), *names])


#: A file is read in pieces of so many bytes.
CHUNK = 8 << 20


def file_hashes(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """(path, bytes, sha256) of a file, or of each file below a folder, by as many tasks as there are files.

    A task streams a file through the digest and holds ``chunk`` bytes at a
    time, so files of any size take constant memory. Stores that only the JVM
    can open are streamed by the driver's, one file after another.
    """
    schema, found = "path string, bytes long, sha256 string", Files(spark).below(path)
    if found and found[0][0].split(":")[0] not in _STREAMED:
        files = Files(spark)
        return spark.createDataFrame([(p, n, files.digest(p)) for p, n in found], schema)
    rows = spark.createDataFrame(found, "path string, bytes long").repartition(max(1, len(found)), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [stream_digest(p, chunk) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], names=["path", "bytes", "sha256"])

    return rows.mapInArrow(run, schema)


#: Schemes that executors open by themselves.
_STREAMED = ("file", "hdfs", "s3", "gs")


def open_store(uri: str) -> tuple[pa_fs.FileSystem, str]:
    """The file system of a path as tasks open it, and the path in it."""
    if uri.startswith("file:") or uri.startswith("/"):  # such a path may have characters that no URI has
        return pa_fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pa_fs.FileSystem.from_uri(uri)


def stream_digest(uri: str, chunk: int = CHUNK) -> str:
    """SHA-256 of a file, read in pieces."""
    store, path = open_store(uri)
    digest = hashlib.sha256()
    with store.open_input_stream(path) as data:
        while piece := data.read(chunk):
            digest.update(piece)
    return digest.hexdigest()


def file_hash(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file; of a folder, that of its files' hashes in the order of their names."""
    found = sorted((r["path"], r["sha256"]) for r in file_hashes(spark, path).collect())  # a row per file
    if not found:
        raise FileNotFoundError(path)
    return found[0][1] if len(found) == 1 else hashlib.sha256("".join(h for _, h in found).encode()).hexdigest()
