"""Queries I1, H3, H5, T2 and L1-L3 on the test mapping of ``documents``."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import functions as F

from millstone import settings as S
from millstone.operators.inspect import inspect_samples, near_threshold, threshold_report
from millstone.operators.mixture import interleave
from millstone.operators.quality import source_thresholds
from millstone.operators.shuffle import block_shuffle, buffer_shuffle, tokenizer_training_docs
from millstone.plans import sqlfrag as Q
from millstone.plans.fixtures import mapped_source, mapped_source_sql
from millstone.plans.corpus import MixtureConfig, build_mixture
from millstone.plans.prepare import prepare
from millstone.plans.q_text import sql_thresholds
from millstone.plans.registry import register
from millstone.sources.tables import read_table

SEED = S.SEED
PROBS = S.MIX_RATIOS
CFG = MixtureConfig(profile="latin")


def mapped_docs(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", mapped_source().alias("source"), "text")


def _sql_draw_source(slot: str) -> str:
    names = list(PROBS)
    cum = list(accumulate(float(PROBS[n]) for n in names))
    u = Q.uniform_draw(slot, SEED)
    whens = " ".join(f"WHEN {u} < {Q.d(c)} THEN '{n}'" for n, c in zip(names[:-1], cum[:-1]))
    return f"(CASE {whens} ELSE '{names[-1]}' END)"


def sql_mixture(kept: str) -> str:
    """CTEs ending in ``mix(slot, source, ordinal, <kept columns>)``."""
    return f"""
sizes AS (SELECT source, count(*) AS size FROM {kept} GROUP BY source),
rws AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS ordinal FROM {kept}),
nsl AS (SELECT CAST(sum(size) * 20 + 1000 AS BIGINT) AS n FROM sizes),
slots AS (SELECT unnest(range(0, (SELECT n FROM nsl))) AS slot),
sd AS (SELECT slot, {_sql_draw_source('slot')} AS source FROM slots),
so AS (SELECT slot, source, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS ordinal FROM sd),
stp AS (SELECT min(slot) AS stop FROM so JOIN sizes USING (source) WHERE ordinal = size - 1),
mix AS (SELECT so.slot, rws.* FROM so JOIN rws USING (source, ordinal) WHERE so.slot <= (SELECT stop FROM stp))"""


def sql_block_shuffle(src: str, block: int) -> str:
    return (f"SELECT *, (slot // {block}) * {block} + row_number() OVER (PARTITION BY slot // {block} "
            f"ORDER BY md5('{SEED}:shuffle:' || CAST(slot AS VARCHAR)), slot) - 1 AS position FROM {src}")


def sql_buffer_shuffle(src: str, buffer: int) -> str:
    """A row leaves the buffer when its place is drawn the next time, the last ones by the hash of the place."""
    draw = f"CAST('0x' || substr(md5('{SEED}:shuffle:' || CAST(slot AS VARCHAR)), 1, 8) AS BIGINT) % {buffer}"
    size = f"(SELECT count(*) FROM {src})"
    return f"""SELECT * EXCLUDE (place, nxt, tail), CAST(coalesce(nxt - {buffer}, tail + {size} - least({size}, {buffer})) AS BIGINT) AS position
FROM (SELECT *, lead(slot) OVER (PARTITION BY place ORDER BY slot) AS nxt
      FROM (SELECT *, CASE WHEN slot < {buffer} THEN slot ELSE {draw} END AS place FROM {src}))
JOIN (SELECT place, row_number() OVER (ORDER BY md5('{SEED}:shuffle:tail:' || CAST(place AS VARCHAR)), place) - 1 AS tail
      FROM (SELECT unnest(range(0, least({size}, {buffer}))) AS place)) USING (place)"""


_RAW_MAPPED = f"SELECT doc_id, {mapped_source_sql()} AS source FROM documents"

# ------------------------------------------------------------------ I1, H3


def _i1(spark, sf):
    return interleave(mapped_docs(spark, sf).select("doc_id", "source"), PROBS, SEED).select(
        "slot", "source", "doc_id")


register("i1_interleave", f"""WITH kept AS ({_RAW_MAPPED}), {sql_mixture('kept')}
SELECT slot, source, doc_id FROM mix""")(_i1)

register("i1_mixture_counts", f"""WITH kept AS ({_RAW_MAPPED}), {sql_mixture('kept')}
SELECT source, count(*) AS n_docs FROM mix GROUP BY source""")(
    lambda spark, sf: _i1(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("n_docs")))

for _name, _buf in [("h3_shuffle_buffer", S.SHUFFLE_BUFFER), ("h3_shuffle_buffer_b64", 64)]:
    register(_name, f"""WITH kept AS ({_RAW_MAPPED}), {sql_mixture('kept')}, sh AS ({sql_buffer_shuffle('mix', _buf)})
SELECT position, slot, doc_id FROM sh""")(
        (lambda b: lambda spark, sf: buffer_shuffle(_i1(spark, sf), "slot", b, SEED).select("position", "slot", "doc_id"))(_buf))

for _name, _blk in [("h3_block_shuffle", S.SHUFFLE_BUFFER), ("h3_block_shuffle_b64", 64)]:
    register(_name, f"""WITH kept AS ({_RAW_MAPPED}), {sql_mixture('kept')}, sh AS ({sql_block_shuffle('mix', _blk)})
SELECT position, slot, doc_id FROM sh""")(
        (lambda b: lambda spark, sf: block_shuffle(_i1(spark, sf), "slot", b, SEED).select("position", "slot", "doc_id"))(_blk))

# ------------------------------------------------------------------ T2 and what reads it

_SQL_SCORED = f"""
m AS (SELECT doc_id, {mapped_source_sql()} AS source, text FROM documents),
clean AS (SELECT doc_id, source, {Q.clean_text('text', "source = 'stories'", 'latin')} AS text FROM m),
scored AS (SELECT doc_id, source, text, {Q.quality_score('text', 'latin')} AS score FROM clean),
tsrc AS (SELECT * FROM scored WHERE source IN ('wiki', 'namu', 'culturax')),
{sql_thresholds('tsrc', Q.d(0.3), S.SAMPLE_SIZE)}"""

SQL_PIPE = f"""{_SQL_SCORED},
kept AS (SELECT s.* FROM scored s LEFT JOIN th USING (source) WHERE th.threshold IS NULL OR s.score >= th.threshold),
{sql_mixture('kept')}, sh AS ({sql_buffer_shuffle('mix', S.SHUFFLE_BUFFER)})"""


def mixture(spark, sf):
    return build_mixture(mapped_docs(spark, sf), CFG)


register("t2_mixture", f"""WITH {SQL_PIPE}
SELECT position, slot, source, doc_id, text, score FROM sh""")(
    lambda spark, sf: mixture(spark, sf).select("position", "slot", "source", "doc_id", "text", "score"))

register("l1_inspect", f"""WITH {SQL_PIPE}
SELECT position, source, doc_id, CAST(length(text) AS BIGINT) AS length, {Q.preview('text')} AS preview
FROM sh WHERE position < {S.INSPECT_SAMPLES}""")(lambda spark, sf: inspect_samples(mixture(spark, sf)))

register("h5_train_sample", f"""WITH {SQL_PIPE}
SELECT position, doc_id, CAST(length(text) AS BIGINT) AS n_chars FROM sh
WHERE position <= {S.TOKENIZER_TRAIN_LIMIT + 1} AND length(text) >= {S.DOC_MIN_LENGTH}""")(
    lambda spark, sf: tokenizer_training_docs(mixture(spark, sf), S.TOKENIZER_TRAIN_LIMIT).select(
        "position", "doc_id", F.length("text").cast("bigint").alias("n_chars")))


def _scored_and_thresholds(spark, sf):
    scored = prepare(mapped_docs(spark, sf), CFG.synthetic, CFG.profile)
    th = source_thresholds(scored, CFG.cut_ratios, CFG.default_cut_ratio, CFG.sample_size, SEED,
                           sources=list(CFG.thresholded))
    return scored, th


def _l2(spark, sf):
    scored, th = _scored_and_thresholds(spark, sf)
    return near_threshold(scored.where(F.col("source").isin(list(CFG.thresholded))), th)


register("l2_near_threshold", f"""WITH {_SQL_SCORED},
band AS (SELECT t.*, th.threshold FROM tsrc t JOIN th USING (source)
         WHERE t.score >= th.threshold - {Q.d(0.05)} AND t.score <= th.threshold + {Q.d(0.05)}),
rk AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {Q.hash_key('doc_id', SEED)}, doc_id) AS sample FROM band)
SELECT source, sample, doc_id, score, {Q.near_preview('text')} AS preview FROM rk WHERE sample <= {S.NEAR_THRESHOLD_SAMPLES}""")(_l2)


def _l3(spark, sf):
    scored, th = _scored_and_thresholds(spark, sf)
    return threshold_report(scored, th)


register("l3_threshold_report", f"""WITH {_SQL_SCORED},
cnt AS (SELECT source, count(*) AS n_docs, CAST(sum(CASE WHEN t.score >= th.threshold THEN 1 ELSE 0 END) AS BIGINT) AS n_kept
        FROM tsrc t JOIN th USING (source) GROUP BY source)
SELECT source, cut_ratio, threshold, n_sample, n_docs, n_kept FROM th JOIN cnt USING (source)""")(_l3)


# ------------------------------------------------------------------ T2 from source definitions
TEST_URL_EXCLUDE = ("cheap-pills", "example.org")


def _src(lo, hi):
    return "(" + ", ".join(f"'src{i}'" for i in range(lo, hi)) + ")"


def test_sources(sf):
    """Four sources; wiki and namu share the twenty sources of documents."""
    from millstone.plans.corpus import CorpusSource
    from millstone.sources.tables import SourceSpec

    def docs(name, lo, hi):
        return SourceSpec(name, f"{sf}/documents.parquet", where=f"source IN {_src(lo, hi)}")

    return [
        CorpusSource(docs("wiki", 0, 10), S.MIX_RATIOS["wiki"], S.CUT_RATIOS["wiki"]),
        CorpusSource(docs("namu", 10, 20), S.MIX_RATIOS["namu"], S.CUT_RATIOS["namu"]),
        CorpusSource(SourceSpec("culturax", f"{sf}/pages.parquet",
                                columns={"doc_id": "page_id", "text": "html", "url": "url"}),
                     S.MIX_RATIOS["culturax"], S.CUT_RATIOS["culturax"], url_exclude=TEST_URL_EXCLUDE),
        CorpusSource(SourceSpec("stories", f"{sf}/conversations.parquet",
                                columns={"doc_id": "conv_id * 1000000 + turn", "text": "text"},
                                synthetic=True, ends="role = 'assistant'"),
                     S.MIX_RATIOS["stories"], None, group=True),
    ]


def _t2_sources(spark, sf):
    from millstone.plans.corpus import corpus_mixture

    return corpus_mixture(spark, test_sources(sf), "latin").select("position", "slot", "source", "doc_id", "text",
                                                                   "score")


_SQL_SOURCES = f"""
conv AS (SELECT conv_id * 1000000 + turn AS doc_id, text, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS e FROM conversations),
convg AS (SELECT *, coalesce(sum(e) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gid FROM conv),
stories AS (SELECT min(doc_id) AS doc_id, 'stories' AS source, string_agg(text, ' ' ORDER BY doc_id) AS text FROM convg GROUP BY gid),
m AS (SELECT doc_id, 'wiki' AS source, text FROM documents WHERE source IN {_src(0, 10)}
      UNION ALL SELECT doc_id, 'namu' AS source, text FROM documents WHERE source IN {_src(10, 20)}
      UNION ALL SELECT page_id AS doc_id, 'culturax' AS source, html AS text FROM pages
                WHERE NOT coalesce(contains(url, 'cheap-pills') OR contains(url, 'example.org'), false)
      UNION ALL SELECT doc_id, source, text FROM stories),
clean AS (SELECT doc_id, source, {Q.clean_text('text', "source = 'stories'", 'latin')} AS text FROM m),
scored AS (SELECT doc_id, source, text, {Q.quality_score('text', 'latin')} AS score FROM clean),
tsrc AS (SELECT * FROM scored WHERE source IN ('wiki', 'namu', 'culturax')),
{sql_thresholds('tsrc', Q.d(0.3), S.SAMPLE_SIZE)},
kept AS (SELECT s.* FROM scored s LEFT JOIN th USING (source) WHERE th.threshold IS NULL OR s.score >= th.threshold),
{sql_mixture('kept')}, sh AS ({sql_buffer_shuffle('mix', S.SHUFFLE_BUFFER)})"""


register("t2_sources_mixture", f"""WITH {_SQL_SOURCES}
SELECT position, slot, source, doc_id, text, score FROM sh""")(_t2_sources)


# ------------------------------------------------------------------ G3, H4, C4 on their own
from millstone.operators.order import first_n_per_group  # noqa: E402
from millstone.operators.shuffle import first_rows  # noqa: E402

G3_N = 3
register("g3_first_n_per_source", f"""
SELECT source, doc_id, n_chars, rk AS "rank" FROM (SELECT source, doc_id, n_chars,
  row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rk FROM documents) WHERE rk <= {G3_N}""")(
    lambda spark, sf: first_n_per_group(read_table(spark, sf, "documents").select("source", "doc_id", "n_chars"),
                                        ["source"], [F.desc("n_chars"), F.col("doc_id")], G3_N))

H4_N = 100
register("h4_first_rows", f"""WITH kept AS ({_RAW_MAPPED}), {sql_mixture('kept')}
SELECT slot, source, doc_id FROM mix WHERE slot < {H4_N}""")(
    lambda spark, sf: first_rows(_i1(spark, sf), H4_N, "slot"))


def _c4(spark, sf):
    scored, th = _scored_and_thresholds(spark, sf)
    t = th.select("source", "threshold")
    tol = S.NEAR_THRESHOLD_TOLERANCE
    return (scored.join(F.broadcast(t), "source")
            .where(F.col("score").between(F.col("threshold") - tol, F.col("threshold") + tol))
            .select("source", "doc_id", "score"))


register("c4_threshold_band", f"""WITH {_SQL_SCORED}
SELECT t.source, t.doc_id, t.score FROM tsrc t JOIN th USING (source)
WHERE t.score >= th.threshold - {Q.d(0.05)} AND t.score <= th.threshold + {Q.d(0.05)}""")(_c4)
