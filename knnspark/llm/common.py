"""Pieces that several operators share: shared scratch tables, Arrow text access, hashing."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads one Parquet table; lets Python workers find this package."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch at most: whole texts and sets are large rows, and a batch is held several times over.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Lets workers find this package, and bounds what an Arrow batch holds."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is named."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        at = tempfile.mkdtemp(prefix="knnspark-")
        spark.sparkContext.setCheckpointDir(at)
    return at


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
        self.n = 0

    def path(self) -> str:
        self.n += 1
        return f"{self.root}/t{self.n}"

    def keep(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        at = self.path()
        df.write.option("compression", codec).parquet(at)
        self.release()
        out = self.spark.read.schema(df.schema).parquet(at)
        out._scratch = at  # noqa: SLF001
        return out

    def release(self) -> None:
        """Lets Spark's cleaner remove the shuffle files of finished jobs, which go once the driver's JVM collects their handles."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            delete(self.spark, df._scratch)  # noqa: SLF001

    def close(self) -> None:
        delete(self.spark, self.root)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and where each row begins; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, at, data = col.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 500_000) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and odd multipliers), element by element."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_BASE = 0x5851F42D4C957F2D
_POWERS: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            step = np.full(size, U64(base))
            step[0] = 1
            _POWERS[k] = np.cumprod(step, dtype=U64)
    return _POWERS[0], _POWERS[1]


def prefix_sums(buf: np.ndarray, lower: bool = False) -> np.ndarray:
    """h[j] - h[i], times base**-i, is the hash of bytes i to j wherever they stand."""
    up, _ = powers(len(buf) + 1)
    h = np.zeros(len(buf) + 1, U64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[buf] * up[: len(buf)], out=h[1:])
    return h


def span_hash(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the spans a to b of the text whose prefix sums are h."""
    _, down = powers(len(h))
    return mix((h[b] - h[a]) * down[a] + (b - a).astype(U64) * U64(0xD6E8FEB86659FD93))


_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of the concatenated rows, and the first word of each row."""
    is_word = ~_SEPARATOR[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    starts = is_word.copy()
    starts[1:] &= ~is_word[:-1] | edge[1 : len(buf)]
    ends = is_word.copy()
    ends[:-1] &= ~is_word[1:] | edge[1 : len(buf)]
    a, b = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return a, b, np.searchsorted(a, offsets)


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
