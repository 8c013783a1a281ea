"""Grouping, packing, mixture, shuffle and batch layout against plain loops."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millstone.operators.export import batch_plan, shift
from millstone.operators.grouping import group_until_delimiter
from millstone.operators.mixture import interleave
from millstone.operators.order import row_ordinal
from millstone.operators.packing import pack
from millstone.operators.shuffle import block_shuffle, shuffle_rank


def _groups(spark, texts, **kw):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "ord long, text string")
    return [r.text for r in group_until_delimiter(df, ["ord"], **kw).orderBy("group_id").collect()]


def test_group_of_two_and_three_rows(spark):
    g = _groups(spark, ["p", "q <|endoftext|>", "r", "s", "t <|endoftext|>"])
    assert g == ["p q <|endoftext|>", "r s t <|endoftext|>"]


@pytest.mark.parametrize("nb", [1, 4, 16])
def test_null_keys_and_texts(spark, nb):
    """Null group keys are a group, null order keys sort first, null texts add no words."""
    rows = [(None if i % 2 else "k", None if i < 2 else i, None if i in (4, 5) else f"w{i}") for i in range(10)]
    df = spark.createDataFrame(rows, "k string, ord long, text string")
    got = {(r.k, r.ord): r.ordinal for r in row_ordinal(df, ["ord"], "ordinal", ["k"], n_buckets=nb).collect()}
    assert got == {(None if i % 2 else "k", None if i < 2 else i): i // 2 for i in range(10)}
    g = group_until_delimiter(df, ["ord"], partition_cols=["k"]).collect()
    assert {r.k: r.text for r in g} == {"k": "w0 w2 w6 w8", None: "w1 w3 w7 w9"}
    assert [r.n_rows for r in g] == [5, 5]


def test_string_order_key(spark):
    df = spark.createDataFrame([(f"{i:03d}",) for i in range(200)], "k string")
    got = {r.k: r.ordinal for r in row_ordinal(df, ["k"], n_buckets=7).collect()}
    assert got == {f"{i:03d}": i for i in range(200)}


def test_many_buckets(spark):
    from millstone.operators.order import range_bucket

    df = spark.range(100_000).select((F.col("id") * 3).alias("k"))
    assert df.select(range_bucket(df, "k", 2000).alias("b")).distinct().count() >= 1800


def test_group_tail_and_text_after_delimiter(spark):
    assert _groups(spark, ["a", "b <|endoftext|> c", "d"]) == ["a b <|endoftext|> c", "d"]
    assert _groups(spark, ["x <|endoftext|>", "y"]) == ["x <|endoftext|>", "y"]
    df = spark.createDataFrame([], "ord long, text string")
    assert group_until_delimiter(df, ["ord"]).count() == 0


@pytest.mark.parametrize("nb", [1, 3, 16])
def test_group_random_vs_loop(spark, nb):
    rnd = random.Random(nb)
    texts = [("w%d" % i) + (" <|endoftext|>" if rnd.random() < 0.2 else "") for i in range(300)]
    ends = [i for i, t in enumerate(texts) if "<|" in t]
    cuts = [0, *[i + 1 for i in ends], len(texts)]
    want = [" ".join(texts[a:b]) for a, b in zip(cuts, cuts[1:]) if a < b]
    spark.conf.set("spark.sql.shuffle.partitions", str(nb))
    try:
        assert _groups(spark, texts) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def _cut(docs, eos, L):
    """Concatenate everything, then cut whole sequences by position."""
    flat = [x for d in docs for x in [*d, eos]]
    return [flat[k * L:(k + 1) * L] for k in range(len(flat) // L)]


def _pack(spark, docs, eos, L):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "doc_id long, tok array<int>")
    return [list(r.ids) for r in pack(df, "tok", ["doc_id"], L, eos).orderBy("seq_id").collect()]


@pytest.mark.parametrize("docs,eos,L,want", [
    ([[10, 20, 30]], 99, 2, [[10, 20], [30, 99]]),
    ([[1, 2], [3]], 9, 3, [[1, 2, 9]]),
    ([[1], [], [2, 3, 4, 5, 6]], 9, 4, [[1, 9, 9, 2], [3, 4, 5, 6]]),
])
def test_pack_golden(spark, docs, eos, L, want):
    assert _pack(spark, docs, eos, L) == want


def test_pack_random_vs_cut(spark):
    rnd = random.Random(3)
    docs = [[rnd.randrange(1000) for _ in range(rnd.randrange(0, 40))] for _ in range(300)]
    for L in (1, 7, 64):
        assert _pack(spark, docs, 5, L) == _cut(docs, 5, L)


def test_row_ordinal_partitions(spark):
    rnd = random.Random(5)
    rows = [(i * 7 + rnd.randrange(7), rnd.choice("abc")) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, g string")
    got = {(r.g, r.k): r.ordinal for r in row_ordinal(df, ["k"], "ordinal", ["g"], n_buckets=5).collect()}
    for g in "abc":
        ks = sorted(k for k, gg in rows if gg == g)
        assert [got[(g, k)] for k in ks] == list(range(len(ks)))


def _loop_interleave(sizes, probs, seed):
    names = list(probs)
    cum, acc = [], 0.0
    for n in names:
        acc += probs[n]
        cum.append(acc)
    idx = {n: 0 for n in names}
    out, slot = [], 0
    while True:
        u = int(hashlib.md5(f"{seed}:{slot}".encode()).hexdigest()[:8], 16) / 2 ** 32
        s = next((n for n, c in zip(names[:-1], cum[:-1]) if u < c), names[-1])
        out.append((slot, s, idx[s]))
        idx[s] += 1
        slot += 1
        if idx[s] == sizes[s]:
            return out


def test_interleave_fixture_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    i = F.substring("source", 4, 10).cast("int")
    m = docs.select("doc_id", F.when(i < 5, "wiki").when(i < 10, "namu").when(i < 15, "culturax")
                    .otherwise("stories").alias("source"))
    out = interleave(m, {"wiki": 0.2, "namu": 0.2, "culturax": 0.4, "stories": 0.2}, 42)
    counts = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert out.count() == 601
    assert counts == {"culturax": 250, "wiki": 119, "stories": 119, "namu": 113}


def test_interleave_vs_loop(spark):
    sizes = {"a": 30, "b": 5, "c": 70}
    probs = {"a": 0.3, "b": 0.1, "c": 0.6}
    rows = [(s * 1000 + k, s_name) for s, s_name in enumerate(sizes) for k in range(sizes[s_name])]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    got = sorted((r.slot, r.source, r.ordinal) for r in interleave(df, probs, 7).collect())
    assert got == _loop_interleave(sizes, probs, 7)
    with pytest.raises(ValueError):
        interleave(df.where("source != 'b'"), probs, 7)


def test_shuffles(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"))
    got = {r.doc_id: r.shuffle_rank for r in shuffle_rank(df, "doc_id", 42).collect()}
    order = sorted(range(500), key=lambda d: (hashlib.md5(f"42:{d}".encode()).hexdigest(), d))
    assert [got[d] for d in order] == list(range(500))
    s = spark.range(250).select(F.col("id").alias("slot"))
    pos = {r.slot: r.position for r in block_shuffle(s, "slot", 64, 42).collect()}
    assert sorted(pos.values()) == list(range(250))
    assert all(abs(pos[k] - k) < 64 and pos[k] // 64 == k // 64 for k in pos)


def test_shift_and_batch_plan(spark):
    seqs = spark.createDataFrame([(i, [i, i + 1, i + 2]) for i in range(10)], "seq_id long, ids array<int>")
    r = shift(seqs).orderBy("seq_id").first()
    assert list(r.inputs) == [0, 1] and list(r.targets) == [1, 2]
    plan = batch_plan(seqs, 10, steps=3, grad_acc=2, batch_size=4).collect()
    # M = 3 micro-batches per pass (4, 4, 2 sequences); 6 global micro-batches
    by_g = {}
    for p in plan:
        by_g.setdefault((p.step, p.micro_batch), []).append((p.row, p.seq_id, p["pass"]))
    assert sorted(by_g[(0, 0)]) == [(0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0)]
    assert sorted(by_g[(1, 0)]) == [(0, 8, 0), (1, 9, 0)]
    assert sorted(by_g[(1, 1)]) == [(0, 0, 1), (1, 1, 1), (2, 2, 1), (3, 3, 1)]
    assert len(plan) == 4 + 4 + 2 + 4 + 4 + 2


def test_write_sequences_roundtrip(spark, tmp_path):
    from millstone.sources.sinks import write_sequences

    seqs = spark.createDataFrame([(i, [i, i + 1]) for i in range(50)], "seq_id long, ids array<int>")
    p = write_sequences(seqs, str(tmp_path / "seqs"), max_records_per_file=7, partitions=3)
    back = spark.read.parquet(p)
    assert sorted((r.seq_id, list(r.ids)) for r in back.collect()) == [(i, [i, i + 1]) for i in range(50)]
    import glob
    assert len(glob.glob(p + "/*.parquet")) >= 8


def test_composite_order_key_with_hot_leading_value(spark):
    """A third of the rows share the leading key: buckets still split them."""
    from millstone.operators.order import BUCKET, running_sum

    rows = [(0 if i % 3 == 0 else i, i) for i in range(900)]
    df = spark.createDataFrame(rows, "a long, b long")
    out = running_sum(df, ["a", "b"], "pos", n_buckets=6, keep_bucket=True).collect()
    want = {r: k for k, r in enumerate(sorted(rows))}
    assert all(r.pos == want[(r.a, r.b)] for r in out)
    hot_buckets = {r[BUCKET] for r in out if r.a == 0}
    assert len(hot_buckets) >= 2


@pytest.mark.parametrize("n,buffer", [(500, 16), (40, 64), (64, 64), (300, 1), (0, 8), (1, 8)])
def test_buffer_shuffle_equals_a_loop(spark, n, buffer):
    """A list of places, one draw a row, the rest by hash."""
    import hashlib

    from millstone.operators.shuffle import buffer_shuffle

    md5 = lambda k: hashlib.md5(f"42:shuffle:{k}".encode()).hexdigest()
    places, want = [], []
    for slot in range(n):
        if slot < buffer:
            places.append(slot)
        else:
            i = int(md5(slot)[:8], 16) % buffer
            want.append(places[i])
            places[i] = slot
    want += [places[i] for i in sorted(range(len(places)), key=lambda i: (md5(f"tail:{i}"), i))]
    df = spark.range(n).select(F.col("id").alias("slot"), F.lit("x").alias("place")).repartition(5)
    got = {r.position: r.slot for r in buffer_shuffle(df, "slot", buffer, 42).collect()}
    assert got == dict(enumerate(want))


def test_ten_thousand_buckets(spark):
    """Bucket borders are one literal: plans stay small, and equal a search on the driver."""
    import bisect
    import time

    from millstone.operators.order import boundary_array, bucket_of, range_bucket, running_sum
    from pyspark.sql import types as T

    splits = [k * 3 + 0.5 for k in range(10_000)]
    df = spark.range(0, 40_000, 7).select("id", F.when(F.col("id") % 5 > 0, F.col("id")).alias("k"))
    t = time.time()
    out = df.withColumn("b", bucket_of(F.col("k").cast("double"), boundary_array(splits, T.DoubleType(), True), len(splits)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert time.time() - t < 1 and len(plan) < 100_000
    for r in out.collect():
        assert r.b == (bisect.bisect_right(splits, r.k) if r.k is not None else 0)
    rows = [(i % 3, None if i % 11 == 0 else f"s{i % 17}", i) for i in range(2000)]
    d = spark.createDataFrame(rows, "a int, s string, i long")
    got = {r.i: r.n for r in running_sum(d, ["a", "s", "i"], "n", n_buckets=500).collect()}
    key = lambda r: (r[0], r[1] is not None, r[1] or "", r[2])
    assert got == {r[2]: n for n, r in enumerate(sorted(rows, key=key))}
    assert d.select(range_bucket(d, ["a", "s", "i"], 500).alias("b")).distinct().count() > 300


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 17, 1000, 5003])
def test_feistel_is_a_permutation(spark, n):
    from millstone.operators.shuffle import permuted

    x = spark.range(n).select("id", permuted(F.col("id"), n, 1).alias("p"), permuted(F.col("id"), n, 2).alias("q")).collect()
    assert sorted(r.p for r in x) == sorted(r.q for r in x) == list(range(n))
    if n > 100:
        assert sum(r.p == r.q for r in x) < n / 20 and sum(r.p == r.id for r in x) < n / 20
        assert abs(np.corrcoef([r.id for r in x], [r.p for r in x])[0, 1]) < 0.1


def test_running_sum_moves_a_row_once(spark):
    """The rows cross the exchange of the window and no other, with a group or without."""
    from millstone.operators.order import running_sum

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(None if k % 3 == 0 else k % 3, k, k % 5) for k in range(300)]
        df = spark.createDataFrame(rows, "g long, o long, w long").withColumn("wide", F.col("o"))
        for keys in ([], ["g"]):
            x = running_sum(df, ["o"], "at", keys, weight=F.col("w"))
            plan = x._jdf.queryExecution().explainString(x._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
            moved = [p for p in plan.split("\n\n") if ") Exchange" in p and "wide#" in p]
            assert len(moved) == 1, plan
            same = lambda a, b: not keys or a[0] == b[0]
            assert sorted(r["at"] for r in x.collect()) == sorted(sum(b[2] for b in rows if same(a, b) and b[1] < a[1]) for a in rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_pack_cuts_ranges_and_gathers_their_borders(spark):
    """Sequences within a range and over many documents or ranges; null lists have no tokens, null ids stay."""
    docs = [(g, k, None if k % 11 == 5 else [k, None, g or 9] * (k % 7 if k != 40 else 300)) for g in (None, 1, 2) for k in range(80)]
    df = spark.createDataFrame(docs, "g long, k long, tok array<int>").repartition(5)
    for L in (3, 50, 5000):
        want = []
        for g in (None, 1, 2):
            flat = [x for d in docs if d[0] == g and d[2] is not None for x in (*d[2], 77)]
            want += [(g or 0, s, flat[s * L:(s + 1) * L]) for s in range(len(flat) // L)]
        got = pack(df, "tok", ["k"], L, 77, partition_cols=["g"])
        assert sorted(((r.g or 0, r.seq_id, r.ids) for r in got.collect()), key=lambda r: r[:2]) == want
