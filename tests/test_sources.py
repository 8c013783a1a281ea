"""Source scans (A1-A3) across formats."""

import pytest
from pyspark.sql import functions as F

from millstone.operators.packing import pack
from millstone.plans.corpus import CorpusSource, MixtureConfig, build_mixture, load_corpus
from millstone.sources.tables import SourceSpec, read_source, union_sources


def test_parquet_without_id_gets_stable_ids(spark):
    spec = SourceSpec("d", "/root/testdata/sf0.001/documents.parquet", columns={"text": "text"})
    a = read_source(spark, spec)
    ids = [r.doc_id for r in a.collect()]
    assert len(ids) == len(set(ids)) == spark.read.parquet(spec.path).count()
    b = sorted(r.doc_id for r in read_source(spark, spec).collect())
    assert b == sorted(ids)


def test_json_and_text_sources(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(30)
    docs.write.json(str(tmp_path / "j"))
    j = read_source(spark, SourceSpec("j", str(tmp_path / "j"), format="json"))
    assert sorted((r.doc_id, r.text) for r in j.collect()) == sorted((r.doc_id, r.text) for r in docs.collect())
    docs.select(F.regexp_replace("text", "\n", " ").alias("value")).write.text(str(tmp_path / "t"))
    t = read_source(spark, SourceSpec("t", str(tmp_path / "t"), format="text", columns={"text": "value"}))
    assert t.count() == 30 and t.select("doc_id").distinct().count() == 30
    u = union_sources(j, t)
    assert u.count() == 60 and set(r.source for r in u.select("source").distinct().collect()) == {"j", "t"}


def test_missing_text_column_fails(spark):
    with pytest.raises(ValueError):
        read_source(spark, SourceSpec("x", "/root/testdata/sf0.001/documents.parquet", columns={"text": "body"}))


def _stories(spark, folder, fmt):
    """Three stories of four lines over two files, no id column; each story closes with the same line."""
    lines = [f"line {i} of story {k}" if i < 3 else "the end <|endoftext|>" for k in range(3) for i in range(4)]
    name = "value" if fmt == "text" else "text"
    for k, part in enumerate((lines[:5], lines[5:])):
        spark.createDataFrame([(x,) for x in part], f"{name} string").coalesce(1).write.format(fmt).save(f"{folder}/{k}")
    spec = SourceSpec("stories", f"{folder}/*", format=fmt, columns={"text": name}, synthetic=True)
    want = [" ".join(lines[4 * k:4 * k + 4]) for k in range(3)]
    return spec, want


@pytest.mark.parametrize("fmt", ["parquet", "json", "text"])
def test_group_without_id_keeps_file_order(spark, tmp_path, fmt):
    spec, want = _stories(spark, tmp_path, fmt)
    assert sorted(r.doc_id for r in read_source(spark, spec).collect()) == list(range(12))  # repeated lines stay apart
    got = load_corpus(spark, [CorpusSource(spec, 1.0, None, group=True)]).orderBy("doc_id").collect()
    assert [r.text for r in got] == want


def test_pack_tokenises_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<int>")
    def tokens(n):
        seen.add(1)
        return list(range(n % 7))

    docs = spark.range(200, numPartitions=4).withColumn("ids", tokens("id"))
    assert pack(docs, "ids", ["id"], 8, 0).count() == sum(n % 7 + 1 for n in range(200)) // 8
    assert seen.value == 200


def test_mixture_moves_text_once_and_keeps_repeated_rows(spark):
    rows = [(k // 2, s, f"A sentence about topic {k} of {s}, long enough to stay here. And one more of them.")
            for s in ("a", "b") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    cfg = MixtureConfig(probs={"a": 0.5, "b": 0.5}, thresholded=(), synthetic=("a", "b"), profile="latin")
    got = build_mixture(docs, cfg).collect()
    assert sorted(r.position for r in got) == list(range(len(got)))
    assert len({(r.source, r.text) for r in got}) == len(got) >= 40


def test_every_document_has_a_source(spark):
    """The sources of t2_sources_mixture over documents hold each document once."""
    from millstone.plans.q_mix import test_sources as sources_of

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    read = [docs.where(s.spec.where).select("doc_id") for s in sources_of("/root/testdata/sf0.001") if s.spec.path.endswith("documents.parquet")]
    got = sorted(r.doc_id for d in read for r in d.collect())
    assert got == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_long_blocklist_equals_contains(spark):
    """100,000 patterns against a string matcher; short, empty and null patterns, null URLs, clashing names."""
    import random

    import ahocorasick

    from millstone.sources.blocklist import exclude_listed
    from millstone.sources.tables import exclude_urls

    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abcdehtw.-/") for _ in range(n))
    urls = [f"https://{word(12)}/{word(rnd.randrange(1, 30))}" for _ in range(800)] + ["https://é漢/x", "", None, "a"]
    patterns = [word(rnd.randrange(6, 14)) for _ in range(99_000)] + [u[9:20] for u in urls[:80]] + ["é漢", "wc-", "d.d.", None] + ["https:/x"] * 3
    find = ahocorasick.Automaton()
    for p in patterns:
        if p:
            find.add_word(p, p)
    find.make_automaton()
    want = {i for i, u in enumerate(urls) if u is None or not any(find.iter(u))}
    df = spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls)], "doc_id long, url string, pattern string")
    table = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    got = exclude_listed(df, table)
    assert got.columns == ["doc_id", "pattern"] and {r.doc_id for r in got.collect()} == want and 80 <= len(urls) - len(want) < 700
    few = ["c-", "https://a", "é漢", "."]
    chain = {r.doc_id for r in exclude_urls(df, few).collect()}
    assert {r.doc_id for r in exclude_listed(df, spark.createDataFrame([(p,) for p in few], "pattern string")).collect()} == chain
    assert {r.doc_id for r in exclude_listed(df, spark.createDataFrame([("",)], "pattern string")).collect()} == {urls.index(None)}
    assert exclude_listed(df, table.limit(0)).count() == len(urls)
