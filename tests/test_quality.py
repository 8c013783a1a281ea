"""Thresholds (quantile rule, sample), quality filter, URL exclusion."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millstone.operators.quality import (
    quality_filter,
    quantile_per_group,
    sample_per_source,
    source_thresholds,
)
from millstone.sources.tables import exclude_urls


def test_threshold_of_given_scores(spark):
    df = spark.createDataFrame([(i, "s", v) for i, v in enumerate([0.2, 0.4, 0.8, 0.9, 1.0])], "doc_id long, source string, score double")
    th = source_thresholds(df, {"s": 0.5}, sample_size=5).first()
    assert th.threshold == pytest.approx(0.8) and th.n_sample == 5


def test_null_source_and_null_score(spark):
    """A null source has its own threshold; rows without a score count nowhere and are dropped."""
    rows = [(i, None if i % 2 else "a", None if i < 4 else i / 10) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, source string, score double")
    th = source_thresholds(df, {"a": 0.5}, 0.5, sample_size=100)
    got = {r.source: (r.n_sample, r.threshold) for r in th.collect()}
    assert got["a"] == (4, pytest.approx(0.7)) and got[None] == (4, pytest.approx(0.8))
    by_frame = sorted(r.doc_id for r in quality_filter(df, th).collect())
    by_dict = sorted(r.doc_id for r in quality_filter(df, {k: v for k, (_, v) in got.items()}).collect())
    assert by_frame == by_dict == [8, 9, 10, 11]
    assert quality_filter(df, {}).count() == 8


@pytest.mark.parametrize("vals,q,want", [([0, 1, 2, 10], 0.3, 0.9), ([0, 1, 2, 10], 0.9, 7.6), ([3.5], 0.3, 3.5)])
def test_quantile_golden(spark, vals, q, want):
    df = spark.createDataFrame([("g", float(v)) for v in vals], "g string, v double")
    got = quantile_per_group(df, "v", F.lit(q), ["g"]).first().quantile
    assert got == pytest.approx(want, abs=1e-12)


def test_quantile_equals_numpy_bitwise(spark):
    rng = np.random.default_rng(7)
    rows, want = [], {}
    for g in range(30):
        n = int(rng.integers(1, 60))
        vals = rng.normal(size=n).round(int(rng.integers(1, 6))).tolist()
        q = float(rng.choice([0.1, 0.25, 0.3, 0.5, 0.7, 0.95]))
        rows += [(g, v, q) for v in vals]
        want[g] = float(np.quantile(vals, q))
    df = spark.createDataFrame(rows, "g int, v double, q double")
    got = {r.g: r.quantile for r in quantile_per_group(df, "v", F.col("q"), ["g"]).collect()}
    assert got == want


def test_sample_per_source_is_first_k_of_hash_order(spark):
    import hashlib

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source")
    got = sample_per_source(docs, 7, 42).select("source", "doc_id", "sample_rank").collect()
    rows = docs.collect()
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r.doc_id)
    want = set()
    for s, ids in by.items():
        ids.sort(key=lambda d: (hashlib.md5(f"42:{d}".encode()).hexdigest(), d))
        want |= {(s, d, i + 1) for i, d in enumerate(ids[:7])}
    assert {(r.source, r.doc_id, r.sample_rank) for r in got} == want


def test_quality_filter_dict_and_frame_agree(spark):
    df = spark.createDataFrame([(1, "a", 0.1), (2, "a", 0.5), (3, "b", -1.0), (4, "c", 0.2)],
                               "doc_id long, source string, score double")
    th = {"a": 0.3, "b": 0.0}
    thdf = spark.createDataFrame(list(th.items()), "source string, threshold double")
    a = sorted(r.doc_id for r in quality_filter(df, th).collect())
    b = sorted(r.doc_id for r in quality_filter(df, thdf).collect())
    assert a == b == [2, 4]


def test_url_exclusion(spark):
    df = spark.createDataFrame([(1, "https://ko.wikipedia.org/x", "a"), (2, "https://namu.wiki/y", "b"),
                                (3, "https://other.org", "c"), (4, None, "d")], "doc_id long, url string, text string")
    out = exclude_urls(df)
    assert "url" not in out.columns
    assert sorted(r.doc_id for r in out.collect()) == [3, 4]


def test_full_source_threshold_is_the_one_t2_applies(spark):
    from millstone.plans.catalog import queries

    sf = "/root/testdata/sf0.01"
    got = queries()["e1_source_threshold"](spark, sf).collect()
    want = queries()["e2_mapped_thresholds"](spark, sf).where("source = 'culturax'").collect()
    assert [(r.source, r.n_sample, r.threshold) for r in got] == [(r.source, r.n_sample, r.threshold) for r in want]
    assert got[0].n_sample > 100


def test_the_band_is_not_dealt_by_source(spark):
    """Thresholds go to the rows: a source with much of the table is not one task of a shuffle join."""
    from millstone.operators.inspect import near_threshold, threshold_report
    from millstone.operators.quality import sample_per_source

    docs = spark.createDataFrame([("a", k, k / 10, "t") for k in range(10)] + [("b", 1, 0.5, "u")],
                                 "source string, doc_id long, score double, text string")
    th = spark.createDataFrame([("a", 0.3, 0.5, 10)], "source string, cut_ratio double, threshold double, n_sample long")
    on = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        band, report, sample = near_threshold(docs, th), threshold_report(docs, th), sample_per_source(docs, 3)
        for df in (band, sample):
            assert "SortMergeJoin" not in df._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in report._jdf.queryExecution().sparkPlan().toString()
        assert {(r.source, r.doc_id) for r in band.collect()} == {("a", 5)} and sample.count() == 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", on)
