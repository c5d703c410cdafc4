"""Shared pieces: staged tables, batch limits, words, compact blobs."""

from __future__ import annotations

import atexit
import ctypes
import json
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

#: White space of every contract here: space and U+0009 to U+000D.
WORD_RE = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

_staged: list[tuple[SparkSession, str]] = []
_tables: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a local session gets a temporary folder,
    as in tests, and a cluster a folder under the warehouse.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = found.get() if found.isDefined() else None
    if not path:
        if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
            path = "file://" + tempfile.mkdtemp(prefix="sylvan-shared-")
            _staged.append((spark, path))
        else:
            path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.sparkContext.setCheckpointDir(path)
    return path


def stage(spark: SparkSession, df: DataFrame, tag: str, buckets: tuple[str, int] | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts lineage: a lost executor costs no recomputation beyond tasks
    that read these files. They are removed when the driver exits. With
    ``buckets`` (a column and their number) the files are a table bucketed
    by it, which joins and groups by that column read without a shuffle.
    """
    name = f"{tag}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/sylvan/{name}"
    _staged.append((spark, path))
    if not buckets:
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    table = f"sylvan_{name}"
    df.write.option("compression", "zstd").format("parquet").option("path", path).bucketBy(buckets[1], buckets[0]).saveAsTable(table)
    _tables.append((spark, table))
    return spark.table(table)


@atexit.register
def _drop_staged() -> None:
    for spark, table in _tables:
        try:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        except Exception:  # the session may be gone already
            break
    for spark, path in _staged:
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may be gone already
            return


def ready_python(spark: SparkSession, mb: int = 24) -> None:
    """Before any Python operator: functions of this package travel to the
    executors by value, so nothing need be installed there, and one Arrow
    batch is bounded by bytes, however long the texts are."""
    cloudpickle.register_pickle_by_value(sys.modules[__package__])
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def give_back() -> None:
    """Free memory goes back to the system: workers live on from task to
    task, and what they held at most would add up beside the JVM's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run):
    """A function for mapInArrow that gives its memory back in the end."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def lean_group(run):
    """The same for a function of one group."""

    def wrapped(table: pa.Table) -> pa.Table:
        out = run(table)
        give_back()
        return out

    return wrapped


def lean_pair(run):
    """The same for a function of two cogroups."""

    def wrapped(left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(left, right)
        give_back()
        return out

    return wrapped


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Shared:
    """A value that executors read, of a size that the caller bounds. It is
    pickled by value, as the functions are."""

    def __init__(self, spark: SparkSession, value):
        ready_python(spark)
        self._bytes = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self._value = None

    def __getstate__(self):
        return {"_bytes": self._bytes, "_value": None}

    @property
    def value(self):
        if self._value is None:
            self._value = cloudpickle.loads(self._bytes.value)
        return self._value


def pack(**arrays: np.ndarray | bytes) -> bytes:
    """Named arrays (or bytes) as one zstd blob."""
    head, body = [], []
    for name, a in arrays.items():
        if isinstance(a, (bytes, bytearray, memoryview)):
            a = np.frombuffer(a, np.uint8)
        a = np.ascontiguousarray(a)
        head.append((name, a.dtype.str, list(a.shape)))
        body.append(a.tobytes())
    top = json.dumps(head).encode()
    return zstandard.ZstdCompressor(level=1).compress(len(top).to_bytes(4, "little") + top + b"".join(body))


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    at, out = 4 + n, {}
    for name, dtype, shape in json.loads(raw[4 : 4 + n]):
        count = int(np.prod(shape))
        out[name] = np.frombuffer(raw, dtype, count, at).reshape(shape)
        at += count * np.dtype(dtype).itemsize
    return out


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, vectorised."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x
