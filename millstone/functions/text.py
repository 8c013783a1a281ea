"""Column -> Column text functions: cleaning and the quality score.

Every function is a native Spark expression (regexp / higher-order array
functions), so it stays in the JVM and needs no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millstone import settings as S
from millstone.settings import LangProfile, profile

REF_PATTERN = r"\[\p{Nd}+\]"
URL_PATTERN = rf"https?://{S.NON_WS_CLASS}+|www\.{S.NON_WS_CLASS}+"
WS_RUN_PATTERN = S.WS_CLASS + "+"


def _one_of(chars: str) -> str:
    """Body of a Java character class: single characters below 256, which Java looks up in a table, ranges above."""
    points = sorted(map(ord, chars))
    return "".join(f"\\x{{{x:x}}}" for x in points if x < 256) + S._class_body([x for x in points if x > 255])


# Java forms of the patterns above and below, with the same matches or as many. Most characters are printable ASCII: one
# comparison tells that such a character is no whitespace, before the class of whitespace is asked.
_WS = f"[{_one_of(S.WS_CHARS)}]"
_ODD_WS = f"[[^!-~]&&{_WS}]"
#: Whitespace runs other than a single blank, which stays as it is.
_WS_CHANGED = f"[[^ -~]&&{_WS}]{_WS}*+| {_WS}++"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def remove_references(c: Column | str) -> Column:
    """Reference marks such as ``[12]`` (any decimal digits) -> one space."""
    return F.regexp_replace(_col(c), REF_PATTERN, " ")


def replace_urls(c: Column | str) -> Column:
    """``http(s)://...`` and ``www....`` runs up to whitespace -> one space."""
    return F.regexp_replace(_col(c), URL_PATTERN, " ")


def strip_delimiters(c: Column | str, delimiter: str = S.EOS_TOKEN) -> Column:
    """Remove the document delimiter literal (no space is left behind)."""
    return F.replace(_col(c), F.lit(delimiter), F.lit(""))


def strip_ws(c: Column | str) -> Column:
    """Strip leading/trailing whitespace (Python ``str.strip()`` semantics)."""
    return F.btrim(_col(c), F.lit(S.WS_CHARS))


def normalize_whitespace(c: Column | str) -> Column:
    """Collapse whitespace runs to one space, then strip.

    After the collapse the only whitespace left is U+0020, so a plain
    ``trim`` is an exact strip.
    """
    return F.trim(F.regexp_replace(_col(c), _WS_CHANGED, " "))


def _lang_class(p: LangProfile) -> str:
    return f"[{p.letters}{_punct_body()}]"


def _punct_body() -> str:
    # every char of LANG_PUNCT is literal inside a class in Java and RE2
    return "".join(S.LANG_PUNCT)


def _sentence_pattern(p: LangProfile) -> str:
    return f"[{p.letters}]{S.WS_CLASS}*\\."


def _sentence_ends(p: LangProfile) -> str:
    """Matches once for every match of ``_sentence_pattern``: at a full stop behind a letter or behind whitespace
    behind a letter. It starts at the full stop or the whitespace, so letters are passed over at once."""
    letter = f"[{_one_of(p.letter_chars)}]"
    return f"\\.(?<={letter}\\.)|{_ODD_WS}(?<={letter}{_ODD_WS}){_WS}*+\\."


def _count_chars(c: Column, chars: str) -> Column:
    """Number of code points of ``c`` that are in ``chars``: length minus the
    length after deleting them run by run (about 4x faster than ``translate``,
    which looks up every code point as a string of its own)."""
    return F.length(c) - F.length(F.regexp_replace(c, f"[{_one_of(chars)}]+", ""))


DIGITS = "0123456789"


def score_parts(c: Column | str, prof: LangProfile | str = S.HANGUL) -> dict[str, Column]:
    """The four terms of the quality score plus the raw counts."""
    p = profile(prof)
    c = _col(c)
    n = F.length(c)
    nd = n.cast("double")
    lang = _count_chars(c, p.letter_chars + S.LANG_PUNCT)
    nums = _count_chars(c, DIGITS)
    nl = n - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    sent = F.regexp_count(c, F.lit(_sentence_ends(p)))
    zero = F.lit(0.0)
    return {
        "n": n,
        "lang_chars": lang,
        "num_chars": nums,
        "newlines": nl,
        "sentences": sent,
        "lang_ratio": F.when(n == 0, zero).otherwise(lang / nd),
        "num_ratio": F.when(n == 0, zero).otherwise(nums / nd),
        "newline_ratio": F.when(n == 0, zero).otherwise(nl / nd),
        "sentence_density": F.when(n == 0, zero).otherwise(sent / (nd / S.SENTENCE_UNIT)),
    }


def quality_score(c: Column | str, prof: LangProfile | str = S.HANGUL) -> Column:
    """Quality score; operation order kept so doubles are bit-equal to the
    plain-Python formula: lang - nl*3 - nums - max(0, 0.3 - density)*0.5."""
    p = profile(prof)
    c = _col(c)
    n = F.length(c)
    nd = n.cast("double")
    lang = _count_chars(c, p.letter_chars + S.LANG_PUNCT)
    nums = _count_chars(c, DIGITS)
    nl = n - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    sent = F.regexp_count(c, F.lit(_sentence_ends(p)))
    density = sent / (nd / S.SENTENCE_UNIT)
    penalty = F.greatest(F.lit(0.0), F.lit(S.DENSITY_THRESHOLD) - density) * S.DENSITY_WEIGHT
    raw = lang / nd - (nl / nd) * S.NEWLINE_PENALTY - nums / nd - penalty
    return F.when(n == 0, F.lit(0.0)).otherwise(raw)


def filter_lines(c: Column | str, prof: LangProfile | str = S.HANGUL,
                 min_len: int = S.MIN_LINE_LEN,
                 min_score: float = S.LINE_SCORE_THRESHOLD) -> Column:
    """Split on ``\\n``, strip each line, keep lines with length >= min_len
    and score >= min_score, rejoin with ``\\n``. Pure array expression: no
    explode, no shuffle."""
    lines = F.transform(F.split(_col(c), "\n", -1), strip_ws)
    kept = F.filter(lines, lambda x: (F.length(x) >= min_len) & (quality_score(x, prof) >= min_score))
    return F.array_join(kept, "\n")


def clean_text(c: Column | str, synthetic: bool | Column = False,
               prof: LangProfile | str = S.HANGUL) -> Column:
    """references -> URLs -> delimiter -> (line filter unless synthetic) ->
    whitespace. ``synthetic`` may be a Python bool (folded at plan time) or
    a boolean Column (per-row switch)."""
    t = strip_delimiters(replace_urls(remove_references(c)))
    if isinstance(synthetic, bool):
        body = t if synthetic else filter_lines(t, prof)
    else:
        body = F.when(synthetic, t).otherwise(filter_lines(t, prof))
    return normalize_whitespace(body)


def preview(c: Column | str, n: int = S.PREVIEW_CHARS) -> Column:
    """First n code points, newlines shown as spaces (cut first, then replace)."""
    return F.replace(F.substring(_col(c), 1, n), F.lit("\n"), F.lit(" "))


def near_preview(c: Column | str, n: int = S.NEAR_PREVIEW_CHARS) -> Column:
    """First n code points, stripped."""
    return strip_ws(F.substring(_col(c), 1, n))


def marked_text(text: Column | str, key: Column | str) -> Column:
    """Test helper: append a reference mark, URLs and a delimiter to a text so
    every cleaning rule has something to act on (the supplied tables carry
    none). Same construction as ``sql.marked_text``."""
    k = _col(key).cast("string")
    return F.concat(_col(text), F.lit(" [1"), k, F.lit("] https://h"), k,
                    F.lit(".example/y?a=1 tail www.w"), k,
                    F.lit(".org/x<|endoftext|>end. "), F.lit("<|endoftext|>"),
                    F.lit("\n[x] closing line of the marked text, long enough."))
