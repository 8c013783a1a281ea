"""Properties of cleaning and score on random text, and invariance of the whole pipeline under different partition counts."""

import random
import re

import pytest

from millstone.functions.text import clean_text, quality_score

# pieces that exercise every rule: letters of both profiles, digits (incl. a
# non-ASCII decimal digit), every kind of whitespace, marks, URLs, delimiter
PIECES = ["가", "나", "한국어", "문장", "a", "Zé", "ÿ", "×", "0", "7", "١", "12", " ", "  ", "\n", "\r", "\t",
          "\x1c", "\xa0", "　", " ", "\x85", ".", "..", ",", "?", "!", "(", ")", "'", '"', "[3]", "[١٢]",
          "[x]", "http://a.b/c", "https://x", "www.q", "awww.z", "<|endoftext|>", "😀", "-", ":"]


def _texts(seed, n=300):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randrange(0, 80))) for _ in range(n)]


@pytest.mark.parametrize("prof", ["hangul", "latin"])
def test_score_properties(spark, prof):
    """More digits or blank lines never raise a score; a score never exceeds 1."""
    texts = _texts(11)
    rows = [(i, t, t + "7" * 9, t + "\n" * 9) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, t string, d string, n string")
    for r in df.select("i", *[quality_score(c, prof).alias(c) for c in "tdn"]).collect():
        assert r.t <= 1.0 + 1e-12
        if r.t > 0:
            assert r.d < r.t and r.n < r.t, texts[r.i]


@pytest.mark.parametrize("prof", ["hangul", "latin"])
def test_clean_properties(spark, prof):
    """Clean text holds no mark, URL, delimiter or run of blanks."""
    texts = _texts(12)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", clean_text("t", False, prof).alias("c"), clean_text("t", True, prof).alias("y")).collect():
        for out in (r.c, r.y):
            assert out == out.strip() and "  " not in out and "\n" not in out
            assert not re.search(r"https?://\S", out) and not re.search(r"\[\d+\]", out) or "<|" in texts[r.i]
        assert len(r.c) <= len(r.y)


def test_mixture_invariant_to_partitioning(spark):
    from millstone.plans.q_mix import mixture

    outs = []
    for n in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            m = mixture(spark, "/root/testdata/sf0.001")
            outs.append(sorted((r.position, r.slot, r.source, r.doc_id, r.text, r.score) for r in m.collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert outs[0] == outs[1] and len(outs[0]) > 0
