"""Shared helpers: the folder all executors see, materialised tables, and Arrow plumbing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shared_dir(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`. Only a local-mode session without the setting gets one of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="tessella-")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


ARROW_ROWS, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 500
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once a session: they need not have it installed.

    Arrow batches of whole texts are held outside the heap on both sides, so the session's rows a batch are lowered, too.
    """
    sc = spark.sparkContext
    if int(spark.conf.get(ARROW_ROWS)) > BATCH_ROWS:
        spark.conf.set(ARROW_ROWS, str(BATCH_ROWS))
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    made = Path(tempfile.mkdtemp(prefix="tessella-ship-")) / f"{root.name}_code.zip"
    with zipfile.ZipFile(made, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(made))  # Spark serves it from the driver to every executor
    _shipped.add(sc.applicationId)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: the table outlives any executor, and later plans see its true size.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessella/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _stored[id(out)] = weakref.ref(out), path
    return out


_stored: dict[int, tuple] = {}


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing will read again: what was made of them has been written itself."""
    for df in tables:
        held, path = _stored.pop(id(df), (None, None))
        if held is not None and held() is df:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def spare(name: str, taken: Iterable[str]) -> str:
    """A column name like `name` that clashes with none of those taken."""
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name += "_"
    return name


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, a null as none."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def bounded(column: pa.Array, limit: int = 8 << 20) -> Iterator[slice]:
    """Slices of a batch whose texts have about `limit` bytes; one very long text is a slice of its own."""
    sizes = [0 if x is None else x for x in pc.binary_length(column).to_pylist()]
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def release() -> None:
    """Give freed memory back to the system: Python workers are kept for later tasks beside the JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def released(run: Callable) -> Callable:
    """A function of Arrow batches that releases memory when its task is over."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return over
