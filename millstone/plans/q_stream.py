"""Queries J1-J3: streams over the supplied tables, run to completion
(``availableNow``) and read back; oracles are the batch operators' SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millstone import settings as S
from millstone.operators.packing import codepoint_tokens
from millstone.operators.quality import collect_thresholds, min_length, sample_per_source, source_thresholds
from millstone.plans import q_order
from millstone.plans.prepare import clean_and_score, prepare
from millstone.plans.registry import ORACLES, register
from millstone.session import materialize, scratch_path
from millstone.sources.tables import read_table
from millstone.streaming.thresholds import sample_stream, stream_thresholds
from millstone.streaming.stream import file_stream, group_stream, pack_stream, run_to_table, stream_filter

END = "\u0000<end-of-input>"


def _j1(spark, sf):
    # thresholds need a full sample: a batch job, fixed before the stream runs. A text has a score unless it is null, so the
    # sample is drawn first and only its rows are cleaned and scored.
    docs = read_table(spark, sf, "documents").select("doc_id", "source", "text").where("text IS NOT NULL")
    sample = sample_per_source(docs, S.SAMPLE_SIZE, S.SEED).drop("sample_rank")
    prepared = prepare(materialize(sample, "sample"), (), "latin")
    th = collect_thresholds(source_thresholds(prepared, None, 0.3, S.SAMPLE_SIZE, S.SEED))
    src = f"{sf}/documents.parquet"
    schema = spark.read.parquet(src).schema
    stream = file_stream(spark, src, schema).select("doc_id", "source", "text")
    spread = spark.sparkContext.defaultParallelism * 2
    out = run_to_table(stream_filter(stream, th, "latin", partitions=spread), f"j1-{uuid.uuid4().hex[:8]}")
    return out.select("doc_id", "source", "text", "score")


register("j1_stream_filter", ORACLES["c2_quality_filter"])(_j1)


def _j2(spark, sf):
    conv = spark.read.parquet(f"{sf}/conversations.parquet")
    ends = (conv.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn"))
            .select("conv_id", "turn", F.lit(None).cast("string").alias("role"), F.lit(END).alias("text")))
    d = scratch_path(spark, f"millstone/j2-in-{uuid.uuid4().hex[:8]}")
    conv.select("conv_id", "turn", "role", "text").unionByName(ends).write.parquet(d)
    stream = file_stream(spark, d, spark.read.parquet(d).schema)
    g = group_stream(stream, "conv_id", "turn", ends=F.col("role") == "assistant", end_marker=END)
    out = run_to_table(g, f"j2-{uuid.uuid4().hex[:8]}")
    return out.select(F.col("shard").alias("conv_id"), "group_id", "text", "n_rows",
                      F.col("first_ord").alias("first_turn"))


register("j2_stream_group", ORACLES["g1_group_by_key"])(_j2)


def _shard(col="source"):
    return F.substring(F.col(col), 4, 10).cast("long")


def _j3(spark, sf):
    src = f"{sf}/documents.parquet"
    stream = file_stream(spark, src, spark.read.parquet(src).schema)
    d = min_length(stream).select(_shard().alias("shard"), "doc_id", codepoint_tokens("text").alias("tok"))
    p = pack_stream(d, "shard", "doc_id", "tok", q_order.PACK_L, q_order.CP_EOS)
    out = run_to_table(p, f"j3-{uuid.uuid4().hex[:8]}")
    return out.select("shard", "seq_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


_L = q_order.PACK_L
register("j3_stream_pack", f"""
WITH d AS (SELECT CAST(substr(source, 4) AS BIGINT) AS shard, doc_id,
                  list_transform(string_split(text, ''), lambda c: unicode(c)) || [{q_order.CP_EOS}] AS tok
           FROM documents WHERE length(text) >= {S.DOC_MIN_LENGTH}),
s AS (SELECT shard, doc_id, tok, coalesce(sum(len(tok)) OVER (PARTITION BY shard ORDER BY doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d),
t AS (SELECT shard, start, unnest(tok) AS id, unnest(generate_series(1, len(tok))) AS i FROM s),
p AS (SELECT shard, CAST((start + i - 1) // {_L} AS BIGINT) AS seq_id, start + i - 1 AS pos, id FROM t),
packed AS (SELECT shard, seq_id, list(id ORDER BY pos) AS ids FROM p GROUP BY shard, seq_id HAVING count(*) = {_L})
SELECT shard, seq_id, array_to_string(ids, ' ') AS ids FROM packed""")(_j3)


def _e2_stream(spark, sf):
    """Documents that arrive as files, cleaned and scored on the way; thresholds after the last batch."""
    d = scratch_path(spark, f"millstone/e2-in-{uuid.uuid4().hex[:8]}")
    cores = max(2, spark.sparkContext.defaultParallelism)  # three batches, a file for every core in each
    read_table(spark, sf, "documents").select("doc_id", "source", "text").repartition(3 * cores, "doc_id").write.parquet(d)
    stream = file_stream(spark, d, spark.read.parquet(d).schema, max_files_per_trigger=cores)
    state = scratch_path(spark, f"millstone/e2-{uuid.uuid4().hex[:8]}")
    return stream_thresholds(spark, state, sample_stream(clean_and_score(stream, False, "latin"), state))


register("e2_stream_thresholds", ORACLES["e2_all_thresholds"])(_e2_stream)
