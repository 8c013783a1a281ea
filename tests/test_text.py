"""Cleaning and score: literal fixtures (golden values computed from the formulas)."""

import random
import re

import pytest
from pyspark.sql import functions as F

from millstone import settings as S
from millstone.functions.text import _sentence_pattern, clean_text, filter_lines, normalize_whitespace, quality_score, score_parts

# (text, score by hand)
SCORES = [
    ("강물이 흐른다. 바람이 분다. 별이 뜬다.", 1.0),
    ("90 81 72 63 54", 4 / 14 - 10 / 14 - 0.15),  # four blanks, ten digits, no sentence end
    ("", 0.0),
    ("강", 0.85),
    ("가나다라\n마바사아.", 0.6),
    ("가 . 나.. 다　.", 0.9090909090909091),
    ("Plain English text here.", 0.016666666666666663),
]

CLEAN = [
    ("강가의 나무[7]는 http://river.example/a 봄마다 새로운 잎을 틔우며 자라납니다.<|endoftext|>",
     "강가의 나무 는 봄마다 새로운 잎을 틔우며 자라납니다.", "강가의 나무 는 봄마다 새로운 잎을 틔우며 자라납니다."),
    ("이것은 http://a/[1]b 주소가 깨지는 경우를 보는 문장입니다.",
     "이것은 b 주소가 깨지는 경우를 보는 문장입니다.", "이것은 b 주소가 깨지는 경우를 보는 문장입니다."),
    ("링크 https://x<|endoftext|>꼬리는 사라집니다 그리고 문장이 이어집니다.",
     "링크 사라집니다 그리고 문장이 이어집니다.", "링크 사라집니다 그리고 문장이 이어집니다."),
    ("awww.x 라는 말은 조심해야 하는 경우이며 문장입니다.",
     "a 라는 말은 조심해야 하는 경우이며 문장입니다.", "a 라는 말은 조심해야 하는 경우이며 문장입니다."),
    ("앞말<|endoftext|>뒷말이 붙어 버리는 경우를 확인하는 문장입니다.",
     "앞말뒷말이 붙어 버리는 경우를 확인하는 문장입니다.", "앞말뒷말이 붙어 버리는 경우를 확인하는 문장입니다."),
    ("짧은 줄.\n이 줄은 스무 글자가 넘고 마침표로 끝나는 좋은 줄입니다.\n1234567890 1234567890 1234567890\n",
     "이 줄은 스무 글자가 넘고 마침표로 끝나는 좋은 줄입니다.",
     "짧은 줄. 이 줄은 스무 글자가 넘고 마침표로 끝나는 좋은 줄입니다. 1234567890 1234567890 1234567890"),
    (" 공백　여러  공백이 섞여 있는 문장이며 정리되어야 합니다.\u001c ",
     "공백 여러 공백이 섞여 있는 문장이며 정리되어야 합니다.", "공백 여러 공백이 섞여 있는 문장이며 정리되어야 합니다."),
    ("가" * 19, "", "가" * 19),
    ("가" * 19 + ".", "가" * 19 + ".", "가" * 19 + "."),
    ("[١] 아라비아 숫자 참조 표시도 사라져야 하는 문장입니다.",
     "아라비아 숫자 참조 표시도 사라져야 하는 문장입니다.", "아라비아 숫자 참조 표시도 사라져야 하는 문장입니다."),
    ("", "", ""),
    ("\n\n", "", ""),
]


def test_quality_score_golden(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SCORES)], "i int, t string")
    got = {r.i: r.s for r in df.select("i", quality_score("t", "hangul").alias("s")).collect()}
    for i, (_, want) in enumerate(SCORES):
        assert got[i] == pytest.approx(want, abs=1e-12), SCORES[i][0]


def test_clean_text_golden(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CLEAN)], "i int, t string")
    rows = df.select("i", clean_text("t", False, "hangul").alias("a"),
                     clean_text("t", True, "hangul").alias("b"),
                     clean_text("t", F.lit(True), "hangul").alias("c")).collect()
    for r in rows:
        _, filt, syn = CLEAN[r.i]
        assert r.a == filt, CLEAN[r.i][0]
        assert r.b == syn and r.c == syn


def test_filter_lines_keeps_whole_good_lines(spark):
    """Kept lines are input lines, stripped, of twenty characters or more, in input order."""
    good = ["첫 줄은 충분히 길고 아주 좋은 문장입니다.", "둘째 줄도 충분히 길고 아주 좋은 문장입니다."]
    text = "짧다.\n" + good[0] + "\n1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7\n  " + good[1] + " \n"
    got = spark.createDataFrame([(text,)], "t string").select(filter_lines("t").alias("f")).first().f
    assert got == "\n".join(good)


@pytest.mark.parametrize("prof", ["latin", "hangul"])
def test_counts_are_those_of_the_plain_patterns(spark, prof):
    """Sentence ends, characters and whitespace runs at every mix of letters, blanks and full stops; no lookup per code point."""
    rnd = random.Random(15)
    some = S.WS_CHARS * 2 + "aZ\u00e9\u00d7\uac00\ud7a3.. ..  \n0 9,'\"?!(|\\^]&\u0130\U0001F600"
    rows = [(i, "".join(rnd.choice(some) for _ in range(rnd.randint(0, 60)))) for i in range(3000)]
    p = S.profile(prof)
    sentence, lang = re.compile(f"[{re.escape(p.letter_chars)}][{S.WS_CHARS}]*\\."), set(p.letter_chars + S.LANG_PUNCT)
    part = score_parts("t", prof)
    df = spark.createDataFrame(rows, "i int, t string").select(
        "i", part["sentences"].alias("s"), part["lang_chars"].alias("l"), part["num_chars"].alias("d"), normalize_whitespace("t").alias("w"),
        F.regexp_count("t", F.lit(_sentence_pattern(p))).alias("plain"))
    got = {r.i: r for r in df.collect()}
    for i, t in rows:
        want = (len(sentence.findall(t)), sum(c in lang for c in t), sum(c in "0123456789" for c in t), re.sub(f"[{S.WS_CHARS}]+", " ", t).strip(" "))
        assert (got[i].s, got[i].l, got[i].d, got[i].w) == want and got[i].plain == got[i].s, repr(t)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(" not in plan
