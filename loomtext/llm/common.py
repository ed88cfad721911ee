"""Shared plumbing of the training-data operators.

``Workspace`` is where an operator cuts lineage: a table written under the
folder the cluster names in ``spark.checkpoint.dir`` (shared by the driver and
all executors) and read back.  A lost executor then costs one task's re-read,
never a recomputation of everything upstream.
"""

from __future__ import annotations

import ctypes
import gc
import inspect
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker works on at a time.
SLICE_BYTES = 4 << 20


class Workspace:
    """A folder for the intermediate tables of one operator call, deleted when the application ends.

    It lies under ``spark.checkpoint.dir``.  Where that is unset a folder of this machine is
    taken if driver and executors are one process, as in tests; a cluster must name one.
    """

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="loomtext-")
        small_batches(spark)
        self.spark, self.kept = spark, False
        self.path = f"{base.rstrip('/')}/loomtext/{name}-{uuid.uuid4().hex}"

    def _files(self, path: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and return the table as read back."""
        target = f"{self.path}/{name}"
        df.write.parquet(target)
        schema = df.schema
        del df
        self.keep()
        release(self.spark)
        return self.spark.read.schema(schema).parquet(target)

    def keep(self) -> None:
        """Have the folder, which exists by now, deleted when the application ends."""
        if not self.kept:
            fs, path = self._files(self.path)
            self.kept = fs.deleteOnExit(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more; without names, all of them."""
        for name in names or ("",):
            fs, path = self._files(f"{self.path}/{name}".rstrip("/"))
            fs.delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Have whole texts cross to Python 1,000 rows at a time, unless the session names a number: Spark's own would be held by each task several times over."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


def release(spark: SparkSession) -> None:
    """Let Spark's context cleaner drop shuffle files that nothing refers to.

    They go when the driver's JVM finds their plans unreachable, which without
    a nudge may be long after the table that replaced them was written.
    """
    gc.collect()
    if (jvm := getattr(spark.sparkContext, "_jvm", None)) is not None:
        jvm.System.gc()


@cache
def _c_library():
    """The C library, told to take large arrays from the system one by one, so that they go back when freed; None where there is none like it."""
    try:
        library = ctypes.CDLL(None)
        library.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
        library.malloc_trim(0)
        return library
    except (AttributeError, OSError):
        return None


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    if (library := _c_library()) is not None:
        library.malloc_trim(0)


def lean(run: Callable) -> Callable:
    """A function for Arrow batches, a table or two tables, after which a worker, which goes on to other tasks, holds only what is in use."""
    if inspect.isgeneratorfunction(run):

        def wrapped(it):
            _c_library()
            yield from run(it)
            _give_back()

    elif len(inspect.signature(run).parameters) == 2:

        def wrapped(left, right):
            _c_library()
            out = run(left, right)
            _give_back()
            return out

    else:

        def wrapped(table):
            _c_library()
            out = run(table)
            _give_back()
            return out

    return wrapped


def text_of(column: str = "text"):
    """The text, with null as the empty string."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def texts(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, UTF-8 texts) of slices of about ``limit`` bytes; null is empty.

    Texts are never cut: a longer one makes a slice of its own.
    """
    values = batch.column(batch.schema.get_field_index(column))
    values = values.cast(pa.large_binary()) if not pa.types.is_large_binary(values.type) else values
    start, held, size = 0, [], 0
    for i in range(len(values)):
        t = values[i].as_py() or b""
        if held and size + len(t) > limit:
            yield start, held
            start, held, size = i, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield start, held


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def batches(rows: Iterable[dict], schema: pa.Schema, size: int = 8192) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``size`` rows from a stream of dicts."""
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


class BoundedCache(dict):
    """A dict that computes what is missing, in two generations of at most ``most`` entries each.

    When the young one is full it becomes the old one, from which what is asked for again
    comes back; forgetting changes speed only, never a result.
    """

    def __init__(self, make, most: int = 150_000, longest: int = 48):
        super().__init__()
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, key):
        if (value := self.old.get(key)) is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def lowered(spaces: bytes, breaks: bytes = b"") -> bytes:
    """A table for ``bytes.translate``: A-Z lower-cased, ``spaces`` made blanks and ``breaks`` line feeds."""
    table = bytearray(range(256))
    for c in range(0x41, 0x5B):
        table[c] = c + 32
    for c in spaces:
        table[c] = 0x20
    for c in breaks:
        table[c] = 0x0A
    return bytes(table)


def tokens(data: bytes) -> pa.LargeBinaryArray:
    """The words of ``data`` between blanks, and each line feed as a word of its own, found without a Python object a word."""
    chars = np.frombuffer(data, np.uint8)
    kept, line = chars != 0x20, chars == 0x0A
    first = kept.copy()
    first[1:] &= ~kept[:-1] | line[:-1] | line[1:]
    starts = np.flatnonzero(first[kept])
    chars = chars[kept]
    offsets = np.append(starts, len(chars)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(chars)])
