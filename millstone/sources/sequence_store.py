"""Packed sequences as a table of their own, through Spark's Python data source API.

    write_store(seqs, path)                          # or seqs.write.format("packed_sequences")
    read_store(spark, path, first=1000, last=1999)   # or spark.read.format("packed_sequences")

A training reader wants sequences in order, any range of them, and no half-written output. Every task
attempt writes one Arrow file of a name of its own, in blocks of consecutive sequences, and reports the ``seq_id`` range of every
block. Only when all tasks are done, the commit writes a new manifest beside the old one and puts it in its place by one rename;
files of failed or repeated attempts are in no manifest and so never read. A reader takes files and blocks from the manifest:
no folder is listed, and a range of ``seq_id`` opens just the blocks that overlap it.

``overwrite`` replaces the manifest (files of the earlier one stay for readers that hold it), ``append`` adds
ranges and refuses ones that overlap. Paths are anything that pyarrow's file systems open.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from millstone.functions.id_codec import unzip_lists, zipped
from millstone.session import materialize_last, shuffles_freed, tables_dropped

BLOCK_ROWS = 512
RANGE_IDS = 1 << 24  # 64 MB of ids for one task
SCHEMA = "seq_id bigint, ids array<int>"
#: Blocks are compressed; what reads Arrow files reads them as they are.
_OPTIONS = pa.ipc.IpcWriteOptions(compression="zstd")
_ARROW = pa.schema([("seq_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
MANIFEST = "manifest.json"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def read_manifest(path: str) -> list[dict]:
    """Files of a store in order of ``seq_id``, each with the (first, last) ids of its blocks; empty without a store."""
    fs, root = _open(path)
    if fs.get_file_info(f"{root}/{MANIFEST}").type == pafs.FileType.NotFound:
        return []
    with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())["files"]


def _write_manifest(path: str, files: list[dict]) -> None:
    files = sorted((f for f in files if f["blocks"]), key=lambda f: tuple(f["blocks"][0]))
    ranges = [b for f in files for b in f["blocks"]]
    if any(a[1] >= b[0] for a, b in zip(ranges, ranges[1:])):
        raise ValueError("sequences must be sorted by seq_id, and no two files may hold overlapping ranges")
    fs, root = _open(path)
    fs.create_dir(root, recursive=True)
    new = f"{root}/{MANIFEST}.{uuid.uuid4().hex}"
    with fs.open_output_stream(new) as f:
        f.write(json.dumps({"files": files}).encode())
    fs.move(new, f"{root}/{MANIFEST}")


@dataclass
class Written(ds.WriterCommitMessage):
    """What one task attempt has written."""

    file: str
    blocks: list[tuple[int, int]]
    rows: int


class SequenceWriter(ds.DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """One attempt: a file of blocks; the task's rows come sorted."""
        fs, root = _open(self.path)
        fs.create_dir(f"{root}/data", recursive=True)
        name, blocks, rows = f"data/{uuid.uuid4().hex}.arrow", [], 0
        with fs.open_output_stream(f"{root}/{name}") as f, pa.ipc.new_file(f, _ARROW, options=_OPTIONS) as out:
            for b in _in_blocks(batches):
                ids = b.column(0)
                if ids.null_count:
                    raise ValueError("a sequence without seq_id")
                blocks.append((ids[0].as_py(), ids[-1].as_py()))
                rows += b.num_rows
                out.write_batch(b)
        return Written(name, blocks, rows)

    def commit(self, messages: list[Written | None]) -> None:
        files = [] if self.overwrite else read_manifest(self.path)
        _write_manifest(self.path, files + [{"file": m.file, "blocks": m.blocks, "rows": m.rows} for m in messages if m])

    def abort(self, messages: list[Written | None]) -> None:
        """The manifest stays as it was; files of finished tasks are removed."""
        fs, root = _open(self.path)
        for m in messages:
            if m and fs.get_file_info(f"{root}/{m.file}").type != pafs.FileType.NotFound:
                fs.delete_file(f"{root}/{m.file}")


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of BLOCK_ROWS rows, the last one shorter."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        while n + b.num_rows >= BLOCK_ROWS:
            k = BLOCK_ROWS - n
            yield _block([*held, b.slice(0, k)])
            held, n, b = [], 0, b.slice(k)
        if b.num_rows:
            held.append(b)
            n += b.num_rows
    if held:
        yield _block(held)


def _block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One block of sequences, whose ids come as lists or as bytes."""
    block = pa.Table.from_batches(parts).combine_chunks()
    if "_zip" in block.column_names:
        block = pa.table([block["seq_id"], unzip_lists(block["_zip"], pa.int32())], ["seq_id", "ids"])
    return block.select(["seq_id", "ids"]).cast(_ARROW).combine_chunks().to_batches()[0]


@dataclass
class FilePart(ds.InputPartition):
    """Blocks of one file."""

    file: str
    blocks: list[int]


class SequenceReader(ds.DataSourceReader):
    def __init__(self, path: str):
        self.path, self.low, self.high = path, None, None

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        """Bounds of ``seq_id`` choose blocks; Spark still filters the rows."""
        for f in filters:
            if getattr(f, "attribute", None) == ("seq_id",) and isinstance(getattr(f, "value", None), int):
                if isinstance(f, (ds.EqualTo, ds.GreaterThan, ds.GreaterThanOrEqual)):
                    self.low = f.value if self.low is None else max(self.low, f.value)
                if isinstance(f, (ds.EqualTo, ds.LessThan, ds.LessThanOrEqual)):
                    self.high = f.value if self.high is None else min(self.high, f.value)
            yield f

    def partitions(self) -> list[FilePart]:
        parts = []
        for f in read_manifest(self.path):
            blocks = [k for k, (a, b) in enumerate(f["blocks"])
                      if (self.low is None or b >= self.low) and (self.high is None or a <= self.high)]
            if blocks:
                parts.append(FilePart(f["file"], blocks))
        return parts or [FilePart("", [])]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        if not partition.blocks:
            return
        fs, root = _open(self.path)
        with fs.open_input_file(f"{root}/{partition.file}") as f:
            table = pa.ipc.open_file(f)
            for k in partition.blocks:
                yield table.get_batch(k)


class SequenceStore(ds.DataSource):
    """Format ``packed_sequences``: (seq_id, ids)."""

    @classmethod
    def name(cls) -> str:
        return "packed_sequences"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SequenceReader:
        return SequenceReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> SequenceWriter:
        return SequenceWriter(self.options["path"], overwrite)


def register_store(spark: SparkSession) -> None:
    """Make the format known to the session, and the package to its Python workers."""
    from millstone.session import ship_package

    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SequenceStore)


def range_count(seqs: DataFrame, size: Column | None = None) -> int:
    """Ranges of at most about ``RANGE_IDS`` ids each, and one per core at least. ``size`` is a row's number of ids."""
    size = F.size("ids") if size is None else size
    ids = seqs.agg(F.sum(size.cast("bigint"))).first()[0] or 0
    return max(1, seqs.sparkSession.sparkContext.defaultParallelism, -(-ids // RANGE_IDS))


def write_store(seqs: DataFrame | Callable[[], DataFrame], path: str, mode: str = "overwrite", partitions: int | None = None) -> str:
    """Write ``(seq_id, ids)``, or ``(seq_id, _n, _zip)`` as ``pack`` gives with ``as_bytes``, as a store at ``path``:
    range-partitioned and sorted, one file per task. Sequences are made once, for the number and the bounds of the ranges
    and for the files, and are bytes until a file's blocks are made. Of a function that makes the sequences the tables on
    the way are removed as soon as the sequences are written."""
    def made() -> DataFrame:
        rows = seqs() if callable(seqs) else seqs
        register_store(rows.sparkSession)
        if "_zip" in rows.columns:
            return rows.select("seq_id", "_n", "_zip")
        return zipped(rows.select("seq_id", F.col("ids").cast("array<int>").alias("ids")), "ids")

    with tables_dropped():
        rows = materialize_last(made, "sequences")
        with shuffles_freed(rows.sparkSession):
            (rows.repartitionByRange(partitions or range_count(rows, F.col("_n")), "seq_id").sortWithinPartitions("seq_id")
             .select("seq_id", "_zip").write.format("packed_sequences").mode(mode).save(path))
    return path


def read_store(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """A store's sequences in order, or those from ``first`` to ``last``, both included."""
    register_store(spark)
    out = spark.read.format("packed_sequences").load(path)
    if first is not None:
        out = out.where(out["seq_id"] >= first)
    return out if last is None else out.where(out["seq_id"] <= last)
