"""Streams equal their batch operators, across several micro-batches."""

import os
import time

from pyspark.sql import functions as F

from millstone.operators.grouping import group_until_delimiter
from millstone.operators.packing import pack
from millstone.streaming.stream import file_stream, group_stream, pack_stream, run_to_table, stream_filter


def _write_parts(spark, df, d, n):
    """Write ``df`` as n files arriving one after another (ordered by doc order)."""
    rows = df.collect()
    step = -(-len(rows) // n)
    for i in range(n):
        part = rows[i * step:(i + 1) * step]
        if not part:
            continue
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(d)
        time.sleep(1.1)


def test_stream_group_and_pack_equal_batch(spark, tmp_path):
    rows = [(s, k, f"s{s}t{k}" + (" <|endoftext|>" if (s + k) % 4 == 0 else ""), [s, k, s + k])
            for s in range(3) for k in range(40)]
    df = spark.createDataFrame(rows, "shard long, ord long, text string, ids array<int>")
    end = spark.createDataFrame([(s, 1000, "\u0000<end-of-input>", []) for s in range(3)], df.schema)
    d = str(tmp_path / "in")
    _write_parts(spark, df.orderBy("ord", "shard").unionByName(end), d, 3)
    st = file_stream(spark, d, df.schema, max_files_per_trigger=1)
    g = run_to_table(group_stream(st, "shard", "ord"), "t-group")
    want = group_until_delimiter(df, ["ord"], partition_cols=["shard"])
    assert sorted((r.shard, r.group_id, r.text) for r in g.collect()) == \
        sorted((r.shard, r.group_id, r.text) for r in want.collect())
    st2 = file_stream(spark, d, df.schema, max_files_per_trigger=1).where(F.col("ord") < 1000)
    p = run_to_table(pack_stream(st2, "shard", "ord", "ids", 7, 99), "t-pack")
    wantp = pack(df, "ids", ["ord"], 7, 99, partition_cols=["shard"])
    assert sorted((r.shard, r.seq_id, list(r.ids)) for r in p.collect()) == \
        sorted((r.shard, r.seq_id, list(r.ids)) for r in wantp.collect())


def test_stream_filter_equals_batch(spark, tmp_path):
    from millstone.operators.quality import quality_filter
    from millstone.plans.prepare import clean_and_score

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "source", "text")
    th = {f"src{i}": 0.05 * (i % 5) for i in range(20)}
    d = str(tmp_path / "docs")
    _write_parts(spark, docs, d, 2)
    out = run_to_table(stream_filter(file_stream(spark, d, docs.schema, max_files_per_trigger=1), th, "latin"),
                       "t-filter")
    want = quality_filter(clean_and_score(docs, False, "latin"), th)
    assert sorted((r.doc_id, r.text, r.score) for r in out.collect()) == \
        sorted((r.doc_id, r.text, r.score) for r in want.collect())
    assert os.path.isdir(d)


def test_thresholds_of_a_stream_equal_the_batch(spark, tmp_path):
    """Samples merged over micro-batches, run again as files arrive, and a batch repeated."""
    import random

    from millstone.operators.quality import source_thresholds
    from millstone.streaming.thresholds import merge_into, sample_stream, stream_thresholds

    rnd = random.Random(3)
    rows = [(f"s{rnd.choice([0, 0, 0, 1, 2])}", i, rnd.random() if i % 13 else None) for i in range(900)]
    df = spark.createDataFrame(rows, "source string, doc_id long, score double")
    src, state = str(tmp_path / "in"), str(tmp_path / "state")
    want = lambda d: sorted(map(tuple, source_thresholds(d, {"s1": 0.5}, 0.3, 40).collect()))
    last = None
    for lo, hi in ((0, 400), (400, 900)):
        df.where(f"doc_id >= {lo} AND doc_id < {hi}").repartition(3).write.mode("append").parquet(src)
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
        last = sample_stream(stream, state, 40)
        got = sorted(map(tuple, stream_thresholds(spark, state, last, {"s1": 0.5}, 0.3, 40).collect()))
        assert got == want(df.where(f"doc_id < {hi}"))
    assert last == 5
    again = spark.read.parquet(f"{state}/batch-{last:09d}").collect()
    merge_into(state, 40)(df.where("doc_id < 0"), last + 1)
    assert sorted(spark.read.parquet(f"{state}/batch-{last + 1:09d}").collect()) == sorted(again) and len(again) == 120


def test_idle_shards_are_flushed_by_a_timer(spark, tmp_path):
    """Without a marker row: the open group comes out when its shard has been idle."""
    d, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(1, 0, "a <|endoftext|>"), (1, 1, "b"), (1, 2, None), (2, 0, "c")]
    spark.createDataFrame(rows, "shard long, ord long, text string").coalesce(1).write.parquet(d)
    st = file_stream(spark, d, "shard long, ord long, text string")
    query = (group_stream(st, "shard", "ord", idle_ms=500).writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(processingTime="300 milliseconds").start())
    want = {(1, 0, "a <|endoftext|>", 1), (1, 1, "b", 2), (2, 0, "c", 1)}
    got, until = set(), time.time() + 60
    while got != want and time.time() < until:
        time.sleep(0.5)
        if os.path.isdir(f"{out}/_spark_metadata"):
            got = {(r.shard, r.group_id, r.text, r.n_rows) for r in spark.read.schema("shard long, group_id long, text string, n_rows long").parquet(out).collect()}
    query.stop()
    assert got == want


def test_sub_shards_pack_what_one_packer_packs(spark, tmp_path):
    """Every document of a dealt shard is packed once, by the packer of its hash."""
    rows = [(1, k, [k] * (k % 5 + 1)) for k in range(120)]
    df = spark.createDataFrame(rows, "shard long, ord long, ids array<int>")
    d = str(tmp_path / "in")
    _write_parts(spark, df.orderBy("ord"), d, 2)
    st = file_stream(spark, d, df.schema, max_files_per_trigger=1)
    got = run_to_table(pack_stream(st, "shard", "ord", "ids", 6, 999, sub_shards=4), "t-sub").collect()
    dealt = df.withColumn("sub_shard", F.pmod(F.xxhash64("ord"), F.lit(4)).cast("int"))
    want = pack(dealt, "ids", ["ord"], 6, 999, partition_cols=["shard", "sub_shard"]).collect()
    key = lambda r: (r.sub_shard, r.seq_id, list(r.ids))
    assert sorted(map(key, got)) == sorted(map(key, want)) and len({r.sub_shard for r in got}) == 4


def test_packing_a_batch_needs_no_shard_in_one_task(spark, tmp_path):
    """Remainders pass from batch to batch, shards without new rows and null shards included; null ids are an empty document."""
    first = [(1, 0, [1, 2, 3]), (1, 1, None), (2, 0, [7]), (None, 5, [8, 8])]
    second = [(1, 2, [4] * 9), (None, 6, [9])]
    d, kind = str(tmp_path / "in"), "shard long, ord long, ids array<int>"
    for rows in (first, second, [(2, 1, [6, 6])]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(d)
        time.sleep(1.1)
    st = file_stream(spark, d, kind, max_files_per_trigger=1)
    packed = pack_stream(st, "shard", "ord", "ids", 4, 0)
    assert not hasattr(packed, "collect")  # no stateful Python operator that takes a whole shard of a batch
    got = run_to_table(packed, "t-batches").collect()
    assert sorted(((r.shard or 0, r.seq_id, list(r.ids)) for r in got)) == [
        (0, 0, [8, 8, 0, 9]), (1, 0, [1, 2, 3, 0]), (1, 1, [0, 4, 4, 4]), (1, 2, [4, 4, 4, 4]), (2, 0, [7, 0, 6, 6])]


def test_a_packed_stream_leaves_only_its_tables(spark, tmp_path):
    """Tokens cross one exchange, as bytes; tables on the way and shuffle files are gone when the stream ends."""
    import gc

    from millstone.session import checkpoint_dir

    rows = [(k % 3, k, [97 + (k * i) % 26 for i in range(2000)]) for k in range(90)]
    df = spark.createDataFrame(rows, "shard long, ord long, ids array<int>")
    d = str(tmp_path / "in")
    df.coalesce(1).write.parquet(d)
    folder = f"{checkpoint_dir(spark).removeprefix('file:')}/millstone"
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    shuffled = lambda: {x for x in blocks.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}
    gc.collect()
    tables, files = set(os.listdir(folder)) if os.path.isdir(folder) else set(), shuffled()
    got = run_to_table(pack_stream(file_stream(spark, d, df.schema), "shard", "ord", "ids", 64, 0), "t-left")
    assert {t.split("-")[0] for t in set(os.listdir(folder)) - tables} == {"stream"}
    assert not shuffled() - files
    want = pack(df, "ids", ["ord"], 64, 0, partition_cols=["shard"])
    assert sorted(map(tuple, got.collect())) == sorted((r.shard, r.seq_id, r.ids) for r in want.collect())


def test_a_single_file_is_found_by_sparks_file_system(spark, tmp_path):
    """A path with a scheme, which os.path does not know, streams like a plain one; other files of the folder stay out."""
    for k in range(2):
        spark.range(k, k + 1).coalesce(1).write.parquet(str(tmp_path / f"d{k}"))
        part = next(f for f in os.listdir(tmp_path / f"d{k}") if f.startswith("part"))
        (tmp_path / f"one{k}.parquet").write_bytes((tmp_path / f"d{k}" / part).read_bytes())
    for n, path in enumerate((str(tmp_path / "one1.parquet"), f"file:{tmp_path}/one1.parquet")):
        assert [r.id for r in run_to_table(file_stream(spark, path, "id long"), f"t-file{n}").collect()] == [1]
