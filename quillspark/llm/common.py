"""Shared helpers: reading tables, writing intermediate tables to the shared folder, slicing Arrow batches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_OWN_FOLDERS: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset (local runs)."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _OWN_FOLDERS:
        _OWN_FOLDERS.append(tempfile.mkdtemp(prefix="quillspark-"))
        atexit.register(shutil.rmtree, _OWN_FOLDERS[0], True)
    return f"file://{_OWN_FOLDERS[0]}"


def new_folder(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        drop_folder(spark, path)
    except Exception:  # the JVM may be gone by now; the cluster clears its checkpoint folder
        if urlparse(path).scheme in ("", "file"):
            shutil.rmtree(urlparse(path).path, ignore_errors=True)


def drop_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def unused(df: DataFrame, name: str) -> str:
    """The name, lengthened until the frame has no column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read back. A lost executor costs a reread, not a recompute."""
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove what materialize wrote, once nothing that is still to run reads it."""
    for df in frames:
        if path := df.__dict__.get("_folder"):
            drop_folder(df.sparkSession, path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of frames that are no longer referenced."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Return freed memory to the system: workers live on between tasks, and an executor counts what they hold."""
    import ctypes

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def tidied(run):
    """The function over batches, giving memory back when a task ends: more workers than tasks may be waiting for the next."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return task


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about `most` bytes of text (a longer text stands alone): memory stays bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(column)
        length = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(length, dtype=np.int64) // most
        cut = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
            yield batch.slice(a, b - a)


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def words_of(text: bytes) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z: what bytes.lower and bytes.split do."""
    return text.lower().split()


class Memo(dict):
    """A dict that computes missing values and empties itself when it holds `most` entries."""

    def __init__(self, make, most: int = 400_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value
