"""Helpers that the operators share: tables in the shared folder, Arrow text buffers, rolling hashes."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: Text bytes that one vectorised step handles; bounds a Python worker's memory, never the text.
CHUNK_BYTES = 1 << 19
#: With more partitions than that, what the driver keeps of a plan's tasks goes after each table, not after large ones only.
MANY_PARTITIONS = 100


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local one is made only for a local master that sets none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(folder)
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="tessera-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", folder)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


class Workspace:
    """Tables that cut lineage, in a folder of their own below the shared one."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/tessera-{uuid.uuid4().hex}"
        self.large = False
        """Whether what was saved last left shuffle files worth removing."""

    def save(self, df: DataFrame, name: str, large: bool = False) -> DataFrame:
        if self.large or conf_partitions(self.spark) > MANY_PARTITIONS:
            self.release()
        df.write.option("compression", "zstd").parquet(path := f"{self.root}/{name}")
        self.large = large
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Let Spark's cleaner remove the shuffle files of plans that nobody holds any more, and the driver's heap shrink to
        a multiple of what it still holds."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a string or binary column without copying; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Consecutive row ranges of at most ``limit`` bytes each, or a single longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
    trim()


def trim() -> None:
    """Give freed memory back to the system, which idle Python workers would otherwise keep."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix, on a uint64 array."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BASE = 0x9E3779B97F4A7C15 | 1
_powers = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def powers(n: int, down: bool = False) -> np.ndarray:
    """BASE**i mod 2**64 for i < n; ``down``: of its inverse."""
    key = "down" if down else "up"
    if len(_powers[key]) < n:
        base = pow(BASE, -1, 1 << 64) if down else BASE
        out = np.full(max(n, 1 << 16), base, U64)
        out[0] = 1
        _powers[key] = np.cumprod(out, dtype=U64)
    return _powers[key][:n]


BYTE_CODES = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of codes[k] * BASE**k over i <= k < j, mod 2**64."""
    out = np.zeros(len(codes) + 1, U64)
    np.cumsum(codes * powers(len(codes)), dtype=U64, out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Position-independent 64-bit hashes of the spans [start, end)."""
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix), True)[starts] + (ends - starts).astype(U64) * U64(0xA0761D6478BD642F))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... of each range, one after the other."""
    total = int(lengths.sum())
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return shift + np.arange(total)


def binary_array(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Rows of bytes out of a flat uint8 array and byte offsets."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


def zip_array(a: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(a).tobytes(), "zstd", asbytes=True) if a.size else b""


def unzip_array(raw: bytes, dtype, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, n * np.dtype(dtype).itemsize, "zstd"), dtype) if n else np.zeros(0, dtype)


def conf_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spare(columns: list[str], name: str) -> str:
    """``name``, longer by underscores until none of ``columns`` has it, in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
