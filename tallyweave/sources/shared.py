"""The folder that the driver and all executors see, with checkpoints and files there, and the memory of Python workers."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where that is unset, a temporary one serves a
    session without other machines; on a cluster it is an error, as executors don't see the driver's folders."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return os.path.dirname(known.rstrip("/"))
    if not (spark.sparkContext.master or "").startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
    own = "file://" + tempfile.mkdtemp(prefix="tallyweave-")
    spark.conf.set("spark.checkpoint.dir", own) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    spark.sparkContext.setCheckpointDir(own)
    return own


def checkpoint(df: DataFrame) -> DataFrame:
    """The rows as files in the shared folder; their lineage ends there, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def fresh_folder(spark: SparkSession, kind: str) -> str:
    """A new folder name in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this run has made in the shared folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def remove_at_end(spark: SparkSession, path: str) -> None:
    """Delete a folder when the driver ends: what reads it is run later, and perhaps again."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def release() -> None:
    """Give freed memory back to the system, which a worker would else keep between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def released(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same work on batches, after which the worker gives its freed memory back."""

    @functools.wraps(work)
    def wrapped(batches: Iterator) -> Iterator:
        yield from work(batches)
        release()

    return wrapped


# Files in the shared folder. Local schemes are opened as such; any other goes through the file systems of Arrow.


def _local(path: str) -> str | None:
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if "://" not in path else None


def make_folder(path: str) -> None:
    local = _local(path)
    if local is not None:
        os.makedirs(local, exist_ok=True)
        return
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    store.create_dir(inner, recursive=True)


class SharedWriter:
    """Bytes for one file of the shared folder. It appears under its name only when closed without an error, so a task that is run again, or twice at once, leaves one whole file."""

    def __init__(self, path: str):
        self.path, self.draft = path, f"{path}.{uuid.uuid4().hex}.draft"
        self.size = 0
        local = _local(self.draft)
        if local is not None:
            self.store, self.out = None, open(local, "wb")  # noqa: SIM115
        else:
            from pyarrow import fs

            self.store, self.inner = fs.FileSystem.from_uri(self.draft)
            self.out = self.store.open_output_stream(self.inner)

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def __enter__(self) -> SharedWriter:
        return self

    def __exit__(self, kind, *_) -> None:
        self.out.close()
        if self.store is None:
            draft, final = _local(self.draft), _local(self.path)
            os.replace(draft, final) if kind is None else os.remove(draft)
        elif kind is None:
            self.store.move(self.inner, self.inner.removesuffix(self.draft[len(self.path) :]))
        else:
            self.store.delete_file(self.inner)


def open_shared(path: str):
    """A seekable binary file of the shared folder."""
    local = _local(path)
    if local is not None:
        return open(local, "rb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)
