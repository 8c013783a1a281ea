"""Queries G1, G2, M1, M2: ordered grouping, packing, batch layout."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millstone import settings as S
from millstone.operators.export import batch_plan, shift
from millstone.operators.grouping import group_until_delimiter
from millstone.operators.packing import codepoint_tokens, pack
from millstone.operators.quality import min_length
from millstone.plans.registry import register
from millstone.session import scratch_path
from millstone.sources.sequence_store import read_store, write_store
from millstone.sources.tables import SourceSpec, read_source, read_table

# ------------------------------------------------------------------ G1
_G1_BASE = "SELECT conv_id, turn, text, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS e FROM conversations"


def _g1(spark, sf):
    c = read_table(spark, sf, "conversations")
    return group_until_delimiter(c, ["conv_id", "turn"], ends=F.col("role") == "assistant")


register("g1_group_until_delim", f"""
WITH c AS ({_G1_BASE}),
g AS (SELECT *, CAST(coalesce(sum(e) OVER (ORDER BY conv_id, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS group_id FROM c)
SELECT group_id, string_agg(text, ' ' ORDER BY conv_id, turn) AS text, count(*) AS n_rows, min(conv_id) AS first_conv_id
FROM g GROUP BY group_id""")(_g1)


def _g1_text(spark, sf):
    c = read_table(spark, sf, "conversations")
    c = c.withColumn("text", F.when(F.col("role") == "assistant", F.concat("text", F.lit(" " + S.EOS_TOKEN)))
                     .otherwise(F.col("text")))
    return group_until_delimiter(c, ["conv_id", "turn"])


register("g1_group_until_delim_text", f"""
WITH c0 AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN text || ' {S.EOS_TOKEN}' ELSE text END AS text FROM conversations),
c AS (SELECT *, CASE WHEN contains(text, '{S.EOS_TOKEN}') THEN 1 ELSE 0 END AS e FROM c0),
g AS (SELECT *, CAST(coalesce(sum(e) OVER (ORDER BY conv_id, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS group_id FROM c)
SELECT group_id, string_agg(text, ' ' ORDER BY conv_id, turn) AS text, count(*) AS n_rows, min(conv_id) AS first_conv_id
FROM g GROUP BY group_id""")(_g1_text)


def _g1_key(spark, sf):
    c = read_table(spark, sf, "conversations")
    return group_until_delimiter(c, ["turn"], ends=F.col("role") == "assistant", partition_cols=["conv_id"])


register("g1_group_by_key", f"""
WITH c AS ({_G1_BASE}),
g AS (SELECT *, CAST(coalesce(sum(e) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS group_id FROM c)
SELECT conv_id, group_id, string_agg(text, ' ' ORDER BY turn) AS text, count(*) AS n_rows, min(turn) AS first_turn
FROM g GROUP BY conv_id, group_id""")(_g1_key)


def _g1_file_order(spark, sf):
    """A1 + G1 on a source with no id column: rows are grouped in file order."""
    spec = SourceSpec("stories", f"{sf}/conversations.parquet", columns={"text": "text"}, ends="role = 'assistant'")
    return group_until_delimiter(read_source(spark, spec), ["doc_id"], ends=F.col("_end"))


# the rows of the file are in (conv_id, turn) order
register("g1_group_file_order", f"""
WITH c AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS n FROM ({_G1_BASE})),
g AS (SELECT *, CAST(coalesce(sum(e) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS group_id FROM c)
SELECT group_id, string_agg(text, ' ' ORDER BY n) AS text, count(*) AS n_rows, min(n) AS first_doc_id
FROM g GROUP BY group_id""")(_g1_file_order)

# ------------------------------------------------------------------ G2, M1, M2
PACK_L = S.CONTEXT_LEN
CP_EOS = 0  # code point 0 never occurs in text


def packed_codepoints(spark, sf, as_bytes=False):
    d = min_length(read_table(spark, sf, "documents").select("doc_id", "text"))
    d = d.select("doc_id", codepoint_tokens("text").alias("tok"))
    return pack(d, "tok", ["doc_id"], PACK_L, CP_EOS, as_bytes=as_bytes)


_PACK_SQL = f"""
d AS (SELECT doc_id, list_transform(string_split(text, ''), lambda c: unicode(c)) || [{CP_EOS}] AS tok
      FROM documents WHERE length(text) >= {S.DOC_MIN_LENGTH}),
s AS (SELECT doc_id, tok, coalesce(sum(len(tok)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d),
t AS (SELECT start, unnest(tok) AS id, unnest(generate_series(1, len(tok))) AS i FROM s),
p AS (SELECT CAST((start + i - 1) // {PACK_L} AS BIGINT) AS seq_id, start + i - 1 AS pos, id FROM t),
packed AS (SELECT seq_id, list(id ORDER BY pos) AS ids FROM p GROUP BY seq_id HAVING count(*) = {PACK_L})"""


def _ids_str(c):
    return F.array_join(F.col(c).cast("array<string>"), " ")


register("g2_pack", f"WITH {_PACK_SQL} SELECT seq_id, array_to_string(ids, ' ') AS ids FROM packed")(
    lambda spark, sf: packed_codepoints(spark, sf).select("seq_id", _ids_str("ids").alias("ids")))



def _a6(spark, sf):
    """The packed sequences written to a store and read back."""
    path = scratch_path(spark, f"millstone/sequences-{uuid.uuid4().hex[:12]}")
    return read_store(spark, write_store(lambda: packed_codepoints(spark, sf, as_bytes=True), path)).select("seq_id", _ids_str("ids").alias("ids"))


register("a6_write_sequences", f"WITH {_PACK_SQL} SELECT seq_id, array_to_string(ids, ' ') AS ids FROM packed")(_a6)

register("m1_shift", f"""WITH {_PACK_SQL}
SELECT seq_id, array_to_string(ids[1:{PACK_L - 1}], ' ') AS inputs, array_to_string(ids[2:{PACK_L}], ' ') AS targets FROM packed""")(
    lambda spark, sf: shift(packed_codepoints(spark, sf)).select("seq_id", _ids_str("inputs").alias("inputs"),
                                                                _ids_str("targets").alias("targets")))


def _m2(spark, sf):
    seqs = packed_codepoints(spark, sf).select("seq_id")
    from millstone.session import materialize
    seqs = materialize(seqs, "m2_seqs")
    return batch_plan(seqs, seqs.count())


_B, _A, _ST = S.BATCH_SIZE, S.GRAD_ACC_STEPS, S.MAX_STEPS
register("m2_batch_plan", f"""WITH {_PACK_SQL},
n AS (SELECT CAST((count(*) + {_B - 1}) // {_B} AS BIGINT) AS m FROM packed),
g AS (SELECT range AS g FROM range(0, {_ST * _A}))
SELECT CAST(g // {_A} AS BIGINT) AS step, CAST(g % {_A} AS BIGINT) AS micro_batch, CAST(seq_id % {_B} AS BIGINT) AS row,
       CAST(g // n.m AS BIGINT) AS pass, seq_id
FROM g CROSS JOIN n JOIN packed ON g % n.m = packed.seq_id // {_B}""")(_m2)
