"""Helpers shared by the training-data operators: table access, written
intermediate tables, packed key blocks and the fixed hash functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millstone.session import materialize, ship_package, shuffle_partitions

__all__ = ["prepare_session", "read", "materialize", "shuffle_partitions", "pick", "texts", "chunk_label",
           "pack_sorted", "unpack_sorted", "pack_ints", "unpack_ints", "mix64", "arrow_rows", "n_buckets", "key_bucket"]

ARROW_ROWS = 1000  # rows of one Arrow batch: texts of a batch are held in memory


def prepare_session(spark: SparkSession) -> None:
    """Ship the package to Python workers and keep Arrow batches small."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns, under the operator's own names (extra columns
    of any name never reach the operator)."""
    return df.select(*[F.col(f"`{src}`").alias(name) for name, src in cols.items()])


def texts(batch: pa.RecordBatch, i: int) -> list[str]:
    """Texts of a batch column; null reads as the empty text."""
    return [t or "" for t in batch.column(i).to_pylist()]


def chunk_label() -> str:
    """Label prefix of the running task: the same for every attempt of it."""
    return str(TaskContext.get().partitionId())


def n_buckets(spark: SparkSession, rows: int, per_bucket: int) -> int:
    """Buckets for ``rows`` keys of at most about ``per_bucket`` each, and at
    least one per shuffle partition so that every core has work."""
    return max(shuffle_partitions(spark), -(-int(rows) // per_bucket))


def key_bucket(keys: np.ndarray, n: int) -> np.ndarray:
    """Bucket of 64-bit keys by their leading bits: sorted keys give runs."""
    return ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def _planes(a: np.ndarray) -> bytes:
    width = a.dtype.itemsize
    return zstandard.ZstdCompressor(level=1).compress(
        np.ascontiguousarray(a.view(np.uint8).reshape(-1, width).T).tobytes())


def _unplane(b: bytes, dtype: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(dtype).ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    """Sorted uint64 keys as compressed differences."""
    d = np.empty(len(a), "<u8")
    if len(a):
        d[0] = a[0]
        np.subtract(a[1:], a[:-1], out=d[1:])
    return _planes(d)


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(_unplane(b, "<u8"), dtype=np.uint64)


def pack_ints(a: np.ndarray) -> bytes:
    """Non-negative integers in the narrowest width, byte planes compressed."""
    a = np.asarray(a)
    top = int(a.max()) if len(a) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([width]) + _planes(a.astype(f"<u{width}"))


def unpack_ints(b: bytes) -> np.ndarray:
    return _unplane(b[1:], f"<u{b[0]}")


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (multiply and xor-shift)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def arrow_rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema)], schema=schema)


def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str]]:
    """(id, text) of two-column batches, null text as empty."""
    for b in batches:
        yield from zip(b.column(0).to_pylist(), texts(b, 1))
