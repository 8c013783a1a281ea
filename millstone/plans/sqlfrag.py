"""DuckDB SQL fragments that mirror ``millstone.functions`` for the oracle.

Same patterns and constants as the Spark expressions; only dialect details
differ (``'g'`` flag for global replace, list lambdas, explicit DOUBLE
literals since DuckDB reads ``0.2`` as DECIMAL).
"""

from __future__ import annotations

from millstone import settings as S
from millstone.functions.text import REF_PATTERN, URL_PATTERN, WS_RUN_PATTERN, _punct_body, _sentence_pattern
from millstone.settings import LangProfile, profile


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def d(x: float) -> str:
    """DOUBLE literal."""
    return f"CAST({x!r} AS DOUBLE)"


WS_SQL = "(" + " || ".join(f"chr({c})" for c in S.WS_CODEPOINTS) + ")"


def remove_references(e: str) -> str:
    return f"regexp_replace({e}, {q(REF_PATTERN)}, ' ', 'g')"


def replace_urls(e: str) -> str:
    return f"regexp_replace({e}, {q(URL_PATTERN)}, ' ', 'g')"


def strip_delimiters(e: str, delimiter: str = S.EOS_TOKEN) -> str:
    return f"replace({e}, {q(delimiter)}, '')"


def strip_ws(e: str) -> str:
    return f"trim({e}, {WS_SQL})"


def normalize_whitespace(e: str) -> str:
    return f"trim(regexp_replace({e}, {q(WS_RUN_PATTERN)}, ' ', 'g'), ' ')"


def _count_class(e: str, body: str) -> str:
    return f"length(regexp_replace({e}, {q('[^' + body + ']')}, '', 'g'))"


def score_terms(e: str, prof: LangProfile | str = S.HANGUL) -> dict[str, str]:
    p = profile(prof)
    n = f"length({e})"
    nd = f"CAST(length({e}) AS DOUBLE)"
    return {
        "n": n,
        "nd": nd,
        "lang": _count_class(e, p.letters + _punct_body()),
        "nums": _count_class(e, "0-9"),
        "nl": f"(length({e}) - length(replace({e}, chr(10), '')))",
        "sent": f"len(regexp_extract_all({e}, {q(_sentence_pattern(p))}))",
    }


def quality_score(e: str, prof: LangProfile | str = S.HANGUL) -> str:
    t = score_terms(e, prof)
    nd = t["nd"]
    density = f"({t['sent']} / ({nd} / {d(float(S.SENTENCE_UNIT))}))"
    penalty = f"greatest({d(0.0)}, {d(S.DENSITY_THRESHOLD)} - {density}) * {d(S.DENSITY_WEIGHT)}"
    raw = (f"{t['lang']} / {nd} - ({t['nl']} / {nd}) * {d(float(S.NEWLINE_PENALTY))}"
           f" - {t['nums']} / {nd} - {penalty}")
    return f"(CASE WHEN {t['n']} = 0 THEN {d(0.0)} ELSE {raw} END)"


def filter_lines(e: str, prof: LangProfile | str = S.HANGUL) -> str:
    lines = f"list_transform(string_split({e}, chr(10)), lambda x: {strip_ws('x')})"
    pred = f"length(x) >= {S.MIN_LINE_LEN} AND {quality_score('x', prof)} >= {d(S.LINE_SCORE_THRESHOLD)}"
    return f"array_to_string(list_filter({lines}, lambda x: {pred}), chr(10))"


def clean_text(e: str, synthetic: bool | str = False, prof: LangProfile | str = S.HANGUL) -> str:
    t = strip_delimiters(replace_urls(remove_references(e)))
    if synthetic is True:
        body = t
    elif synthetic is False:
        body = filter_lines(t, prof)
    else:
        body = f"(CASE WHEN {synthetic} THEN {t} ELSE {filter_lines(t, prof)} END)"
    return normalize_whitespace(body)


def preview(e: str, n: int = S.PREVIEW_CHARS) -> str:
    return f"replace(substring({e}, 1, {n}), chr(10), ' ')"


def near_preview(e: str, n: int = S.NEAR_PREVIEW_CHARS) -> str:
    return strip_ws(f"substring({e}, 1, {n})")


def marked_text(text: str, key: str) -> str:
    k = f"CAST({key} AS VARCHAR)"
    return (f"({text} || ' [1' || {k} || '] https://h' || {k} || '.example/y?a=1 tail www.w' || {k}"
            f" || '.org/x<|endoftext|>end. ' || '<|endoftext|>'"
            f" || chr(10) || '[x] closing line of the marked text, long enough.')")


def hash_key(key: str, seed: int) -> str:
    return f"md5('{seed}:' || CAST({key} AS VARCHAR))"


def hash_prefix(key: str, seed: int) -> str:
    return f"CAST(('0x' || substr({hash_key(key, seed)}, 1, 8)) AS BIGINT)"


def uniform_draw(key: str, seed: int) -> str:
    return f"({hash_prefix(key, seed)} / CAST(4294967296.0 AS DOUBLE))"
