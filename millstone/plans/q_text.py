"""Queries A-E, H1/H2: scans, projections, filters, text scalars, thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from millstone import settings as S
from millstone.functions import text as T
from millstone.operators.quality import (
    collect_thresholds,
    min_length,
    quality_filter,
    sample_per_source,
    source_thresholds,
)
from millstone.operators.order import row_ordinal
from millstone.operators.shuffle import permuted, shuffle_rank
from millstone.plans import sqlfrag as Q
from millstone.plans.fixtures import mapped_source, mapped_source_sql
from millstone.plans.prepare import clean_and_score, prepare
from millstone.plans.registry import register
from millstone.sources.blocklist import exclude_listed
from millstone.sources.tables import SourceSpec, exclude_urls, read_source, read_table, union_sources

SEED = S.SEED


def _docs(spark, sf):
    return read_table(spark, sf, "documents")


def _spec(sf, name, where):
    return SourceSpec(name, f"{sf}/documents.parquet", where=where)


def _src_in(lo, hi):
    return "source IN (" + ", ".join(f"'src{i}'" for i in range(lo, hi)) + ")"


MAPPING = [("wiki", 0, 5), ("namu", 5, 10), ("culturax", 10, 15), ("stories", 15, 20)]

# --------------------------------------------------------------------- A, B
register("a1_scan_source", f"""
SELECT doc_id, 'wiki' AS source, text FROM documents WHERE {_src_in(0, 5)}
""")(lambda spark, sf: read_source(spark, _spec(sf, "wiki", _src_in(0, 5))))


def _a3(spark, sf):
    parts = [read_source(spark, _spec(sf, n, _src_in(lo, hi))) for n, lo, hi in MAPPING]
    pages = read_source(spark, SourceSpec("pages", f"{sf}/pages.parquet",
                                          columns={"doc_id": "page_id", "text": "html", "url": "url"}))
    return union_sources(*parts, pages).select("doc_id", "source", "url",
                                                F.length("text").cast("bigint").alias("n_chars"))


register("a3_union_sources", " UNION ALL ".join(
    f"SELECT doc_id, '{n}' AS source, CAST(NULL AS VARCHAR) AS url, CAST(length(text) AS BIGINT) AS n_chars "
    f"FROM documents WHERE {_src_in(lo, hi)}" for n, lo, hi in MAPPING)
    + " UNION ALL SELECT page_id AS doc_id, 'pages' AS source, url, CAST(length(html) AS BIGINT) AS n_chars FROM pages"
)(_a3)

register("b1_project", "SELECT text FROM documents")(
    lambda spark, sf: _docs(spark, sf).select("text"))

# --------------------------------------------------------------------- C
URL_TEST_LIST = ["cheap-pills", "example.org"]


def _c1(spark, sf):
    pages = read_source(spark, SourceSpec("pages", f"{sf}/pages.parquet",
                                          columns={"doc_id": "page_id", "text": "html", "url": "url"}))
    return exclude_urls(pages, URL_TEST_LIST).select("doc_id", "source", "text")


register("c1_url_exclude", """
SELECT page_id AS doc_id, 'pages' AS source, html AS text FROM pages
WHERE NOT coalesce(contains(url, 'cheap-pills') OR contains(url, 'example.org'), false)
""")(_c1)


def _listed(spark, sf):
    """A list from the table itself: hosts of five and more pages, and the fragments of URLs (short patterns)."""
    pages = read_table(spark, sf, "pages").select("url")
    host = pages.select(F.regexp_extract("url", "://([^/]+)", 1).alias("host")).groupBy("host").count().where("count >= 5 AND host <> ''")
    part = pages.select(F.regexp_extract("url", "(#.+)$", 1).alias("pattern")).where("pattern <> ''")
    return host.select(F.concat("host", F.lit("/")).alias("pattern")).union(part).distinct()


def _c1_listed(spark, sf):
    spec = SourceSpec("pages", f"{sf}/pages.parquet", columns={"doc_id": "page_id", "text": "html", "url": "url"})
    return exclude_listed(read_source(spark, spec), _listed(spark, sf))


register("c1_url_blocklist", """
WITH h AS (SELECT regexp_extract(url, '://([^/]+)', 1) AS host, count(*) AS n FROM pages WHERE url IS NOT NULL GROUP BY 1),
p AS (SELECT host || '/' AS pattern FROM h WHERE n >= 5 AND host <> ''
      UNION SELECT regexp_extract(url, '(#.+)$', 1) FROM pages WHERE regexp_extract(url, '(#.+)$', 1) <> '')
SELECT page_id AS doc_id, 'pages' AS source, html AS text FROM pages
WHERE NOT EXISTS (SELECT 1 FROM p WHERE contains(url, pattern))""")(_c1_listed)


def _clean_docs(spark, sf, prof="latin"):
    return clean_and_score(_docs(spark, sf).select("doc_id", "source", "text"), False, prof)


def _sql_clean_docs(prof="latin"):
    return (f"clean AS (SELECT doc_id, source, {Q.clean_text('text', False, prof)} AS text FROM documents), "
            f"scored AS (SELECT doc_id, source, text, {Q.quality_score('text', prof)} AS score FROM clean)")


def sql_thresholds(scored: str, ratio_sql: str, sample_size: int, seed: int = SEED,
                   key: str = "doc_id") -> str:
    """CTE bodies computing ``th(source, cut_ratio, n_sample, threshold)``."""
    return f"""
smp AS (SELECT source, score FROM (SELECT source, score, row_number() OVER (PARTITION BY source
        ORDER BY {Q.hash_key(key, seed)}, {key}) AS rk FROM {scored}) WHERE rk <= {sample_size}),
qr AS (SELECT source, score, {ratio_sql} AS cut_ratio,
       row_number() OVER (PARTITION BY source ORDER BY score) - 1 AS r,
       count(*) OVER (PARTITION BY source) AS n FROM smp),
qg AS (SELECT source, cut_ratio, n AS n_sample, (n - 1) * cut_ratio AS h, floor((n - 1) * cut_ratio) AS lo,
       max(CASE WHEN r = floor((n - 1) * cut_ratio) THEN score END) AS vlo,
       max(CASE WHEN r = least(floor((n - 1) * cut_ratio) + 1, n - 1) THEN score END) AS vhi
       FROM qr GROUP BY source, cut_ratio, n),
th AS (SELECT source, cut_ratio, n_sample,
       CASE WHEN h - lo >= {Q.d(0.5)} THEN vhi - (vhi - vlo) * ({Q.d(1.0)} - (h - lo))
            ELSE vlo + (vhi - vlo) * (h - lo) END AS threshold FROM qg)"""


def _c2(spark, sf):
    # clean + score once into a written table; thresholds and filter read it
    docs = prepare(_docs(spark, sf).select("doc_id", "source", "text"), (), "latin")
    th = collect_thresholds(source_thresholds(docs, None, 0.3, S.SAMPLE_SIZE, SEED))
    return quality_filter(docs, th).select("doc_id", "source", "text", "score")


register("c2_quality_filter", f"""
WITH {_sql_clean_docs()}, {sql_thresholds('scored', Q.d(0.3), S.SAMPLE_SIZE)}
SELECT s.doc_id, s.source, s.text, s.score FROM scored s LEFT JOIN th USING (source)
WHERE th.threshold IS NULL OR s.score >= th.threshold
""")(_c2)

register("c3_min_length", f"""
WITH {_sql_clean_docs()}
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars FROM clean WHERE length(text) >= {S.DOC_MIN_LENGTH}
""")(lambda spark, sf: min_length(_clean_docs(spark, sf)).select(
    "doc_id", F.length("text").cast("bigint").alias("n_chars")))

# --------------------------------------------------------------------- D


def _marked(spark, sf):
    return _docs(spark, sf).select("doc_id", "source", T.marked_text("text", "doc_id").alias("text"))


MARKED_SQL = f"SELECT doc_id, source, {Q.marked_text('text', 'doc_id')} AS text FROM documents"

for _name, _fn, _sql in [
    ("d1_remove_refs", T.remove_references, Q.remove_references),
    ("d2_replace_urls", T.replace_urls, Q.replace_urls),
    ("d3_strip_delim", T.strip_delimiters, Q.strip_delimiters),
    ("d4_normalize_ws", T.normalize_whitespace, Q.normalize_whitespace),
]:
    register(_name, f"WITH m AS ({MARKED_SQL}) SELECT doc_id, {_sql('text')} AS text FROM m")(
        (lambda f: lambda spark, sf: _marked(spark, sf).select("doc_id", f("text").alias("text")))(_fn))

register("d2_replace_urls_pages", f"SELECT page_id, {Q.replace_urls('html')} AS html FROM pages")(
    lambda spark, sf: read_table(spark, sf, "pages").select("page_id", T.replace_urls("html").alias("html")))

for _p in ("hangul", "latin"):
    register(f"d5_quality_score_{_p}", f"SELECT doc_id, {Q.quality_score('text', _p)} AS score FROM documents")(
        (lambda p: lambda spark, sf: _docs(spark, sf).select("doc_id", T.quality_score("text", p).alias("score")))(_p))


def _d5_parts(spark, sf):
    parts = T.score_parts("text", "latin")
    return _docs(spark, sf).select(
        "doc_id", *[parts[k].cast("bigint").alias(k) for k in ("n", "lang_chars", "num_chars", "newlines", "sentences")],
        *[parts[k].alias(k) for k in ("lang_ratio", "num_ratio", "newline_ratio", "sentence_density")])


_t = Q.score_terms("text", "latin")
register("d5_score_parts", f"""
SELECT doc_id, CAST({_t['n']} AS BIGINT) AS n, CAST({_t['lang']} AS BIGINT) AS lang_chars,
       CAST({_t['nums']} AS BIGINT) AS num_chars, CAST({_t['nl']} AS BIGINT) AS newlines,
       CAST({_t['sent']} AS BIGINT) AS sentences,
       CASE WHEN {_t['n']} = 0 THEN {Q.d(0.0)} ELSE {_t['lang']} / {_t['nd']} END AS lang_ratio,
       CASE WHEN {_t['n']} = 0 THEN {Q.d(0.0)} ELSE {_t['nums']} / {_t['nd']} END AS num_ratio,
       CASE WHEN {_t['n']} = 0 THEN {Q.d(0.0)} ELSE {_t['nl']} / {_t['nd']} END AS newline_ratio,
       CASE WHEN {_t['n']} = 0 THEN {Q.d(0.0)} ELSE {_t['sent']} / ({_t['nd']} / {Q.d(50.0)}) END AS sentence_density
FROM documents""")(_d5_parts)

for _p in ("hangul", "latin"):
    register(f"d6_filter_lines_{_p}", f"SELECT doc_id, {Q.filter_lines('text', _p)} AS text FROM documents")(
        (lambda p: lambda spark, sf: _docs(spark, sf).select("doc_id", T.filter_lines("text", p).alias("text")))(_p))

register("d7_clean_text", f"WITH m AS ({MARKED_SQL}) SELECT doc_id, {Q.clean_text('text', False, 'latin')} AS text FROM m")(
    lambda spark, sf: _marked(spark, sf).select("doc_id", T.clean_text("text", False, "latin").alias("text")))


def _d7_syn(spark, sf):
    m = _marked(spark, sf)
    syn = mapped_source() == "stories"
    return m.select("doc_id", syn.alias("is_synthetic"), T.clean_text("text", syn, "latin").alias("text"))


register("d7_clean_text_synthetic", f"""
WITH m AS ({MARKED_SQL}), f AS (SELECT *, {mapped_source_sql()} = 'stories' AS is_synthetic FROM m)
SELECT doc_id, is_synthetic, {Q.clean_text('text', 'is_synthetic', 'latin')} AS text FROM f""")(_d7_syn)

register("b3_preview", f"SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, {Q.preview('text')} AS preview FROM documents")(
    lambda spark, sf: _docs(spark, sf).select("doc_id", F.length("text").cast("bigint").alias("n_chars"),
                                             T.preview("text").alias("preview")))

register("b4_near_preview", f"SELECT doc_id, {Q.near_preview('text')} AS preview FROM documents")(
    lambda spark, sf: _docs(spark, sf).select("doc_id", T.near_preview("text").alias("preview")))

# --------------------------------------------------------------------- E, H1, H2
def _e1(spark, sf):
    docs = _clean_docs(spark, sf).withColumn("source", mapped_source())
    return source_thresholds(docs, {"culturax": S.CUT_RATIOS["culturax"]}, S.DEFAULT_CUT_RATIO, S.SAMPLE_SIZE, SEED,
                             sources=["culturax"])


register("e1_source_threshold", f"""
WITH {_sql_clean_docs()}, m AS (SELECT doc_id, {mapped_source_sql()} AS source, score FROM scored),
f AS (SELECT * FROM m WHERE source = 'culturax'), {sql_thresholds('f', Q.d(0.3), S.SAMPLE_SIZE)}
SELECT source, cut_ratio, n_sample, threshold FROM th""")(_e1)


def _e2(spark, sf):
    return source_thresholds(_clean_docs(spark, sf), None, S.DEFAULT_CUT_RATIO, S.SAMPLE_SIZE, SEED)


register("e2_all_thresholds", f"""
WITH {_sql_clean_docs()}, {sql_thresholds('scored', Q.d(0.3), S.SAMPLE_SIZE)}
SELECT source, cut_ratio, n_sample, threshold FROM th""")(_e2)


def _e2_mapped(spark, sf):
    docs = _clean_docs(spark, sf).withColumn("source", mapped_source())
    return source_thresholds(docs, dict(S.CUT_RATIOS), S.DEFAULT_CUT_RATIO, S.SAMPLE_SIZE, SEED,
                             sources=["wiki", "namu", "culturax"])


register("e2_mapped_thresholds", f"""
WITH {_sql_clean_docs()}, m AS (SELECT doc_id, {mapped_source_sql()} AS source, score FROM scored),
f AS (SELECT * FROM m WHERE source IN ('wiki', 'namu', 'culturax')), {sql_thresholds('f', Q.d(0.3), S.SAMPLE_SIZE)}
SELECT source, cut_ratio, n_sample, threshold FROM th""")(_e2_mapped)

H2_K = 20
register("h2_sample_per_source", f"""
SELECT source, doc_id, sample_rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source
  ORDER BY {Q.hash_key('doc_id', SEED)}, doc_id) AS sample_rank FROM documents) WHERE sample_rank <= {H2_K}
""")(lambda spark, sf: sample_per_source(_docs(spark, sf).select("source", "doc_id"), H2_K, SEED))

register("h1_shuffle_rank", f"""
SELECT doc_id, row_number() OVER (ORDER BY {Q.hash_key('doc_id', SEED)}, doc_id) - 1 AS shuffle_rank FROM documents
""")(lambda spark, sf: shuffle_rank(_docs(spark, sf).select("doc_id"), "doc_id", SEED))


def _h1_permuted(spark, sf):
    d = row_ordinal(_docs(spark, sf).select("doc_id"), ["doc_id"])
    return d.select("doc_id", "ordinal", permuted(F.col("ordinal"), d.count()).alias("position"))


def _h(i: int, v: str) -> str:
    return f"CAST('0x' || substr(md5('{SEED}:{i}:' || CAST({v} AS VARCHAR)), 1, 8) AS BIGINT)"


def _sql_turn(src: str) -> str:
    """One pass of the network over ``y`` of ``src``."""
    return f"""SELECT doc_id, ordinal, n, a, b, r4 * a + l3 AS y FROM (
      SELECT *, (r2 + {_h(3, 'l3')}) % b AS r4 FROM (SELECT *, (l1 + {_h(2, 'r2')}) % a AS l3 FROM (
      SELECT *, (r0 + {_h(1, 'l1')}) % b AS r2 FROM (SELECT *, (y % a + {_h(0, 'y // a')}) % a AS l1, y // a AS r0 FROM {src}))))"""


register("h1_feistel_permutation", f"""
WITH RECURSIVE o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, count(*) OVER () AS n FROM documents),
e AS (SELECT *, CAST(ceil(sqrt(n)) AS BIGINT) AS a, CAST(ceil(n / ceil(sqrt(n))) AS BIGINT) AS b, ordinal AS y FROM o),
w AS ({_sql_turn('e')} UNION ALL (WITH more AS (SELECT * FROM w WHERE y >= n) {_sql_turn('more')}))
SELECT doc_id, ordinal, CAST(y AS BIGINT) AS position FROM w WHERE y < n""")(_h1_permuted)
