"""Byte-level symbols of BPE.

Fixed values: the pre-token pattern and the byte -> glyph rule of the
public GPT-2 byte-level scheme, which the original tokenizer uses.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: pre-token pattern (Java syntax; (?U) makes \s, \p classes Unicode).
PRETOKEN_PATTERN = r"(?U)('s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+)"


def byte_glyphs() -> list[str]:
    """Glyph of every byte value. Rule: bytes 33-126, 161-172 and 174-255 are
    their own code point; the remaining bytes, in increasing order, take
    code points 256, 257, ..."""
    keep = set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256))
    out, extra = [], 0
    for b in range(256):
        if b in keep:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


GLYPHS = byte_glyphs()
GLYPH_TO_BYTE = {g: b for b, g in enumerate(GLYPHS)}


def pretokens(text: Column | str) -> Column:
    """K1: pre-tokens of a text (no prefix space added)."""
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(t, F.lit(PRETOKEN_PATTERN), 1)


def utf8_bytes(word: Column | str) -> Column:
    """UTF-8 byte values (0-255) of a string as array<int>."""
    w = F.col(word) if isinstance(word, str) else word
    hx = F.hex(F.encode(w, "UTF-8"))
    n = (F.length(hx) / 2).cast("int")
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(
        F.transform(F.sequence(F.lit(0), n - 1),
                    lambda i: F.conv(F.substring(hx, i * 2 + 1, 2), 16, 10).cast("int")))


def glyph_word(word: Column | str) -> Column:
    """The byte-level form of a pre-token: one glyph per UTF-8 byte."""
    table = F.array(*[F.lit(g) for g in GLYPHS])
    return F.array_join(F.transform(utf8_bytes(word), lambda b: F.element_at(table, b + 1)), "")

# Unicode White_Space (what ``(?U)\s`` matches in Java), for engines whose
# ``\s`` is ASCII-only.
UNICODE_WS_BODY = r"\t\n\x{b}\x{c}\r\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
