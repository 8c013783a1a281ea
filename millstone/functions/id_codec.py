"""Lists of ids in few bytes, for tables and exchanges that only carry them.

An id takes four bytes in a row of Spark's, whatever its value. Here it takes the bytes that the largest id of its list needs;
the first bytes of all ids come first, then the second ones, and zstd compresses them: code points of text take about half a
byte each. Null lists and null ids stay what they are.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

_HEAD = struct.Struct("<IBB")  # how many ids; 1 if some are null; bytes of an id
_ZSTD = pa.Codec("zstd", compression_level=1)


def zip_ids(ids: pa.Array) -> bytes:
    """One list of fixed-width numbers as bytes."""
    n, null = len(ids), bool(ids.null_count)
    if not n:
        return _HEAD.pack(0, 0, 0)
    values = (ids.fill_null(0) if null else ids).to_numpy(zero_copy_only=False)
    if values.dtype.kind == "i" and values.min() >= 0:
        narrow = np.min_scalar_type(values.max())
        values = values.astype(narrow) if narrow.itemsize < values.itemsize else values
    width = values.itemsize
    planes = values.tobytes() if width == 1 else values.view(np.uint8).reshape(n, width).T.tobytes()
    if null:
        planes += ids.is_null().to_numpy(zero_copy_only=False).tobytes()
    return _HEAD.pack(n, null, width) + _ZSTD.compress(planes, asbytes=True)


def unzip_ids(data: bytes, kind: pa.DataType) -> pa.Array:
    """The list that ``zip_ids`` made bytes of; ``kind`` is the type of an id."""
    n, null, width = _HEAD.unpack_from(data)
    if not n:
        return pa.array([], kind)
    full = np.dtype(kind.to_pandas_dtype())
    planes = np.frombuffer(_ZSTD.decompress(memoryview(data)[_HEAD.size:], n * (width + null), asbytes=True), np.uint8)
    values = planes[:n] if width == 1 else np.ascontiguousarray(planes[:n * width].reshape(width, n).T).ravel()
    values = values.view(full) if width == full.itemsize else values.view(f"u{width}").astype(full)
    return pa.array(values, kind, mask=planes[n * width:].astype(bool) if null else None)


def _zip_lists(lists: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Sizes and bytes of a column of lists; null where the list is null."""
    at, values = lists.offsets.to_numpy(), lists.values
    sizes = pa.array(np.diff(at), pa.int64(), mask=lists.is_null().to_numpy(zero_copy_only=False))
    return sizes, pa.array([zip_ids(values[a:b]) if ok else None for a, b, ok in zip(at, at[1:], lists.is_valid().to_pylist())], pa.binary())


def unzip_lists(data: pa.Array | pa.ChunkedArray, kind: pa.DataType) -> pa.Array:
    """The column of lists; null where there are no bytes."""
    parts = [None if x is None else unzip_ids(x, kind) for x in data.to_pylist()]
    at = np.cumsum([0, *(0 if p is None else len(p) for p in parts)])
    values = pa.concat_arrays([pa.array([], kind), *(p for p in parts if p is not None)])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), values, mask=pa.array([p is None for p in parts], pa.bool_()))


def zipped(df: DataFrame, ids_col: str, size: str = "_n", data: str = "_zip") -> DataFrame:
    """``df`` with the lists of ``ids_col`` as two columns: their sizes and their bytes."""
    rest = [c for c in df.columns if c != ids_col]

    def zip_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), *_zip_lists(b.column(ids_col))], [*rest, size, data])

    kept = [T.StructField(c, df.schema[c].dataType) for c in rest]
    return df.mapInArrow(zip_batches, T.StructType([*kept, T.StructField(size, T.LongType()), T.StructField(data, T.BinaryType())]))


def unzipped(data_col: str, element: T.DataType | None = None) -> Column:
    """The lists again; ``element`` is the type of an id (int if not given)."""
    element = element or T.IntegerType()
    kind = to_arrow_type(element)

    @F.arrow_udf(T.ArrayType(element))
    def lists(data: pa.Array) -> pa.Array:
        return unzip_lists(data, kind)

    return lists(F.col(data_col))
