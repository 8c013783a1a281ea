"""The sequence store: attempts, commits, ranges."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millstone.sources import sequence_store as store


def _seqs(spark, lo, hi):
    return spark.range(lo, hi).select(F.col("id").alias("seq_id"), F.array(F.col("id").cast("int"), F.lit(7)).alias("ids"), F.lit("x").alias("blocks"))


def test_round_trip_in_order_and_by_range(spark, tmp_path):
    path = str(tmp_path / "s")
    store.write_store(_seqs(spark, 0, 5000).repartition(7), path, partitions=4)
    got = store.read_store(spark, path).collect()
    assert [r.seq_id for r in got] == list(range(5000)) and all(list(r.ids) == [r.seq_id, 7] for r in got)
    some = store.read_store(spark, path, 1300, 1310)
    assert [r.seq_id for r in some.collect()] == list(range(1300, 1311))
    # only the blocks that overlap the range are opened
    reader = store.SequenceReader(path)
    reader.low, reader.high = 1300, 1310
    assert sum(len(p.blocks) for p in reader.partitions()) <= 2
    assert store.read_store(spark, path, 9000).count() == 0
    store.write_store(_seqs(spark, 5000, 5100), path, "append")
    assert store.read_store(spark, path).count() == 5100
    with pytest.raises(Exception, match="overlapping"):
        store.write_store(_seqs(spark, 10, 20), path, "append")
    assert store.read_store(spark, path).count() == 5100  # a failed commit changes nothing
    store.write_store(_seqs(spark, 0, 3), path)
    assert [r.seq_id for r in store.read_store(spark, path).collect()] == [0, 1, 2]
    store.write_store(_seqs(spark, 0, 0), path)
    assert store.read_store(spark, path).count() == 0 and store.read_manifest(str(tmp_path / "none")) == []


def test_failed_attempts_leave_no_rows(tmp_path):
    path = str(tmp_path / "s")
    batch = lambda a, b: pa.record_batch([pa.array(range(a, b), pa.int64()), pa.array([[i] for i in range(a, b)], pa.list_(pa.int32()))],
                                         names=["seq_id", "ids"])
    w = store.SequenceWriter(path, True)

    def fails():
        yield batch(0, 2000)
        raise OSError("executor lost")

    with pytest.raises(OSError):
        w.write(fails())
    assert store.read_manifest(path) == []
    first, twice, second = w.write(iter([batch(0, 2000)])), w.write(iter([batch(0, 2000)])), w.write(iter([batch(2000, 2600)]))
    assert first.blocks[0] == (0, store.BLOCK_ROWS - 1) and first.rows == 2000
    w.commit([second, first])  # the repeated attempt is in no message
    reader = store.SequenceReader(path)
    rows = [i for p in reader.partitions() for b in reader.read(p) for i in b.column(0).to_pylist()]
    assert rows == list(range(2600)) and os.path.exists(f"{path}/{twice.file}")
    w2 = store.SequenceWriter(path, False)
    lost = w2.write(iter([batch(3000, 3010)]))
    w2.abort([lost, None])
    assert not os.path.exists(f"{path}/{lost.file}") and len(store.read_manifest(path)) == 2


def test_ranges_of_a_store_grow_with_its_ids(spark, tmp_path, monkeypatch):
    """A task writes a bounded number of ids, whatever the size of the store."""
    from pyspark.sql import functions as F

    from millstone.sources import sequence_store

    monkeypatch.setattr(sequence_store, "RANGE_IDS", 100)
    seqs = spark.range(500).select(F.col("id").alias("seq_id"), F.array_repeat(F.lit(7), 10).alias("ids"))
    path = sequence_store.write_store(seqs, str(tmp_path / "store"))
    files = sequence_store.read_manifest(path)
    assert len(files) > 3 * spark.sparkContext.defaultParallelism and sum(f["rows"] for f in files) == 500
    assert sequence_store.read_store(spark, path).count() == 500


def test_a_store_keeps_its_ids_in_few_bytes(spark, tmp_path):
    """Ids of text take less than four bytes each; tables on the way to a store are removed, those of the caller's function too."""
    from millstone.operators.packing import pack
    from millstone.session import checkpoint_dir

    docs = spark.range(60).select("id", F.transform(F.sequence(F.lit(1), F.lit(4000)), lambda i: F.pmod(F.hash("id", i), F.lit(26)) + 97).alias("tok"))
    folder = f"{checkpoint_dir(spark).removeprefix('file:')}/millstone"
    tables = lambda: set(os.listdir(folder)) if os.path.isdir(folder) else set()
    before = tables()
    path = store.write_store(lambda: pack(docs, "tok", ["id"], 512, 0, as_bytes=True), str(tmp_path / "s"))
    assert tables() == before
    got, want = store.read_store(spark, path).collect(), pack(docs, "tok", ["id"], 512, 0).orderBy("seq_id").collect()
    assert [(r.seq_id, r.ids) for r in got] == [(r.seq_id, r.ids) for r in want] and len(got) == 60 * 4001 // 512
    assert sum(os.path.getsize(f"{path}/{f['file']}") for f in store.read_manifest(path)) < 2 * 60 * 4001


def test_null_ids_pass_through_a_store(spark, tmp_path):
    rows = [(0, [1, None]), (1, None), (2, []), (3, [4])]
    path = store.write_store(spark.createDataFrame(rows, "seq_id long, ids array<int>"), str(tmp_path / "s"), partitions=2)
    assert [(r.seq_id, r.ids) for r in store.read_store(spark, path).collect()] == rows
