"""The lazy pipeline on arriving files, with Structured Streaming.

J1 is stateless: the same Column expressions as the batch job plus fixed
thresholds (a map literal), so each micro-batch is a plain projection and
filter. J2 carries the open group's rows of a shard, appended as they come, across micro-batches with
``transformWithState`` in RocksDB. J3 packs each micro-batch as a table and carries the token
remainder shorter than one sequence in a small table per batch.

Order precondition: inside a micro-batch rows are sorted by the order key;
across micro-batches the order is file arrival order.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from millstone import settings as S
from millstone.functions.id_codec import unzipped
from millstone.operators.packing import cut, gather, starts, unfinished
from millstone.operators.quality import quality_filter
from millstone.plans.prepare import clean_and_score
from millstone.session import (materialize, materialize_last, path_exists, scratch_path, ship_package, shuffles_freed, single_file,
                               tables_dropped)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_filter(stream: DataFrame, thresholds: dict[str, float], prof: S.LangProfile | str = S.HANGUL,
                  synthetic_sources: list[str] | tuple = (), partitions: int | None = None) -> DataFrame:
    """Clean + score + keep score >= the source's (fixed) threshold.

    ``partitions`` spreads each micro-batch round-robin over that many tasks
    before cleaning (CPU-bound) when batches arrive as a few large files."""
    syn = F.col("source").isin(list(synthetic_sources)) if synthetic_sources else False
    if partitions:
        stream = stream.repartition(partitions)
    return quality_filter(clean_and_score(stream, syn, prof), thresholds)


def run_to_table(df: DataFrame | PackedStream, name: str, output_mode: str = "append") -> DataFrame:
    """Run a stream over everything available
    (``trigger(availableNow=True)``) into Parquet under the shared checkpoint
    folder, with its own checkpoint location, and return the written table."""
    spark = (df.rows if isinstance(df, PackedStream) else df).sparkSession
    name = f"{name}-{uuid.uuid4().hex[:12]}"  # a second run must not add to the first one's table
    out = scratch_path(spark, f"millstone/stream-{name}")
    ckpt = scratch_path(spark, f"millstone/stream-{name}-ckpt")
    if isinstance(df, PackedStream):
        return df.run(out, f"{out}-state", ckpt)
    q = (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
         .outputMode(output_mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)


# ------------------------------------------------------------------ J2

_G_OUT = "shard long, group_id long, text string, n_rows long, first_ord long"


class GroupProcessor(StatefulProcessor):
    """Open group of a shard: its rows as list state, appended row by row; counters as value state."""

    def __init__(self, sep: str, end_marker: str, idle_ms: int | None):
        self.sep, self.end_marker, self.idle_ms = sep, end_marker, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "text string")
        self.counts = handle.getValueState("counts", "next_gid long, first_ord long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        next_gid, first, n = self.counts.get() if self.counts.exists() else (0, None, 0)
        new: list = []  # rows of the open group that are not in the state yet
        for r in sorted(rows, key=lambda r: r.ord):
            marker = r.text == self.end_marker  # end of input for this shard: flush
            if not marker:
                first = r.ord if not n else first
                new.append(r.text)
                n += 1
            if (marker and n) or (r.ends and not marker):
                yield self._group(key, next_gid, first, n, new)
                next_gid, first, n, new = next_gid + 1, None, 0, []
        if new:
            self.rows.appendList([(t,) for t in new])
        self.counts.update((next_gid, first, n))
        if self.idle_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if n:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """The shard was idle: its open group is complete."""
        next_gid, first, n = self.counts.get()
        if n:
            yield self._group(key, next_gid, first, n, [])
            self.counts.update((next_gid + 1, None, 0))

    def _group(self, key, gid: int, first, n: int, new: list) -> Row:
        # a null text counts as a row and adds no words
        texts = [r[0] for r in self.rows.get()] + new if n > len(new) else new
        self.rows.clear()
        return Row(shard=key[0], group_id=gid, text=self.sep.join(t for t in texts if t is not None), n_rows=n, first_ord=first)

    def close(self) -> None:
        pass


def _with_state(rows: DataFrame, keys: list[str], processor: StatefulProcessor, out: str, mode: str) -> DataFrame:
    """``transformWithState`` on RocksDB, whose state need not fit in memory."""
    spark = rows.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return rows.groupBy(*keys).transformWithState(processor, out, "append", mode)


def group_stream(stream: DataFrame, shard: str, order: str, text_col: str = "text",
                 ends: Column | None = None, delimiter: str = S.EOS_TOKEN, sep: str = " ",
                 end_marker: str = "\u0000<end-of-input>", idle_ms: int | None = None) -> DataFrame:
    """J2 = G1 per shard on a stream. A row whose text equals ``end_marker``
    flushes the shard's open group (the batch operator emits the open tail
    at end of input; a stream needs to be told where input ends). With ``idle_ms`` a timer flushes it instead
    when a shard has had no rows for that long (for queries that keep running: under ``availableNow`` a query
    with processing-time timers does not end)."""
    flag = ends if ends is not None else F.col(text_col).contains(delimiter)
    x = stream.select(F.col(shard).cast("long").alias("shard"), F.col(order).cast("long").alias("ord"),
                      F.col(text_col).alias("text"), F.coalesce(flag, F.lit(False)).alias("ends"))
    return _with_state(x, ["shard"], GroupProcessor(sep, end_marker, idle_ms), _G_OUT, "none" if idle_ms is None else "processingTime")


# ------------------------------------------------------------------ J3

_KEYS = ["shard", "sub_shard"]
_P_STATE = "shard long, sub_shard int, next_seq long, carry array<int>"
_P_OUT = "shard long, sub_shard int, seq_id long, ids array<int>"


@dataclass(frozen=True)
class PackedStream:
    """A stream of (shard, sub_shard, ord, ids) to be packed batch by batch.

    A micro-batch is packed like a table: token offsets from a prefix sum within the shard, sequences cut in order ranges and their border
    pieces gathered, so neither a shard nor its tokens meet in one task. Each batch writes its sequences and, per shard, the remainder and
    the next number as tables of its own; a batch that is run again writes the same tables again. What it writes on the way is removed."""

    rows: DataFrame
    context_len: int
    eos_id: int
    sub_shards: int

    def run(self, out: str, state: str, checkpoint: str) -> DataFrame:
        spark = self.rows.sparkSession
        (self.rows.writeStream.foreachBatch(self.pack_into(out, state)).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start()).awaitTermination()
        done = spark.read.schema(f"{_P_OUT}, batch long").parquet(out) if path_exists(spark, out) else spark.createDataFrame([], _P_OUT)
        return done.drop("batch", *([] if self.sub_shards > 1 else ["sub_shard"]))

    def pack_into(self, out: str, state: str):
        """A ``foreachBatch`` function that packs a batch after the remainders of the batch before."""
        L = self.context_len

        def pack_batch(batch: DataFrame, n: int) -> None:
            spark, before = batch.sparkSession, f"{state}/batch-{n - 1:09d}"
            held = spark.read.schema(_P_STATE).parquet(before) if n and path_exists(spark, before) else spark.createDataFrame([], _P_STATE)
            tok = F.array_append(F.coalesce("ids", F.array().cast("array<int>")), F.lit(self.eos_id).cast("int"))
            docs = batch.select(*_KEYS, "ord", tok.alias("_tok"))
            # a row's place counts from the shard's first sequence of this batch, the remainder's first token
            at = held.select(F.col("shard").alias("_s"), F.col("sub_shard").alias("_d"), "next_seq", F.size("carry").alias("_c"))
            same = F.col("shard").eqNullSafe(F.col("_s")) & F.col("sub_shard").eqNullSafe(F.col("_d"))
            placed = F.col("_start") + F.coalesce("_c", F.lit(0)) + F.coalesce("next_seq", F.lit(0)) * L

            def pieces() -> DataFrame:
                x = starts(docs, ["ord"], _KEYS).join(F.broadcast(at), same, "left").withColumn("_start", placed)
                return cut(x, _KEYS, L, T.IntegerType())

            first = held.select(*_KEYS, F.col("next_seq").alias("seq_id"),
                                F.struct(F.lit(-1).cast("bigint").alias("lo"), F.col("carry").alias("piece")).alias("_pc"))
            with tables_dropped(), shuffles_freed(spark):
                done = materialize_last(pieces, "pieces")
                whole = done.where(F.col("_n") == L).select(*_KEYS, "seq_id", unzipped("_zip").alias("ids"))
                rest = materialize(gather(unfinished(done, _KEYS, L, T.IntegerType()).unionByName(first), _KEYS), "packed")
                full = F.size("ids") == L
                whole.unionByName(rest.where(full)).write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/batch={n}")
                last = done.where(F.col("_n") == L).select(*_KEYS, (F.col("seq_id") + 1).alias("next_seq"), F.lit(None).cast("array<int>").alias("carry"))
                ends = rest.select(*_KEYS, (F.col("seq_id") + full.cast("int")).alias("next_seq"), F.when(~full, F.col("ids")).alias("carry"))
                (last.unionByName(ends).groupBy(*_KEYS).agg(F.max("next_seq").alias("next_seq"), F.flatten(F.collect_list("carry")).alias("carry"))
                 .write.mode("overwrite").parquet(f"{state}/batch-{n:09d}"))
        return pack_batch


def pack_stream(stream: DataFrame, shard: str, order: str, ids_col: str,
                context_len: int, eos_id: int, sub_shards: int = 1) -> PackedStream:
    """J3 = G2 per shard on a stream; the remainder (< context_len tokens)
    waits in state for the shard's next documents. With ``sub_shards`` the documents of a shard are dealt by the hash of
    their order key to that many independent packers. ``run_to_table`` runs it."""
    x = stream.select(F.col(shard).cast("long").alias("shard"), F.pmod(F.xxhash64(order), F.lit(int(sub_shards))).cast("int").alias("sub_shard"),
                      F.col(order).cast("long").alias("ord"), F.col(ids_col).cast("array<int>").alias("ids"))
    return PackedStream(x, int(context_len), int(eos_id), int(sub_shards))


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    """A2 (lazy scan) for streams: files under ``path`` as they arrive."""
    r = spark.readStream.schema(schema).format(fmt)
    if (file := single_file(spark, path)) is not None:
        # a single file: stream its folder, restricted to that file name
        path, name = file
        r = r.option("pathGlobFilter", name)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)
