"""Settings of the corpus-preparation engine.

Fixed values: these equal the settings of the original pipeline and decide
its results, so they are stated here plainly, in one place.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Fixed values (must equal the original pipeline's settings)
# ---------------------------------------------------------------------------
VOCAB_SIZE = 32_000
CONTEXT_LEN = 2048
BATCH_SIZE = 4
GRAD_ACC_STEPS = 32
MAX_STEPS = 8000

MIX_RATIOS = {"wiki": 0.2, "namu": 0.2, "culturax": 0.4, "stories": 0.2}
SAMPLE_SIZE = 10_000
CUT_RATIOS = {"wiki": 0.3, "namu": 0.3, "culturax": 0.3}
DEFAULT_CUT_RATIO = 0.3
DOC_MIN_LENGTH = 50
MIN_LINE_LEN = 20
LINE_SCORE_THRESHOLD = 0.2
SHUFFLE_BUFFER = 10_000
SEED = 42

SENTENCE_UNIT = 50
NEWLINE_PENALTY = 3
DENSITY_THRESHOLD = 0.3
DENSITY_WEIGHT = 0.5

TOKENIZER_TRAIN_LIMIT = 100_000
EOS_TOKEN = "<|endoftext|>"
SPECIAL_TOKENS = ["[UNK]", "[CLS]", "[SEP]", "[PAD]", "[MASK]", "<|endoftext|>"]
UNK_TOKEN = "[UNK]"

# URL substrings excluded from the web-crawl source.
URL_EXCLUDE = ["ko.wikipedia.org", "namu.wiki"]

# Inspection defaults.
INSPECT_SAMPLES = 100
NEAR_THRESHOLD_SAMPLES = 10
NEAR_THRESHOLD_TOLERANCE = 0.05
PREVIEW_CHARS = 150
NEAR_PREVIEW_CHARS = 500

# Characters that count as "language" besides the letter range.
LANG_PUNCT = ".(),?! '\""

# Whitespace exactly as Python's `\s` / `str.strip()`: code points
# 0x09-0x0D, 0x1C-0x20, 0x85, 0xA0, 0x1680, 0x2000-0x200A, 0x2028, 0x2029,
# 0x202F, 0x205F, 0x3000.
WS_CODEPOINTS = (
    list(range(0x09, 0x0E)) + list(range(0x1C, 0x21)) + [0x85, 0xA0, 0x1680]
    + list(range(0x2000, 0x200B)) + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
# ---------------------------------------------------------------------------

WS_CHARS = "".join(chr(c) for c in WS_CODEPOINTS)


def _class_body(codepoints: list[int]) -> str:
    """Regex character-class body (Java and RE2 syntax) for sorted code points."""
    parts, i = [], 0
    while i < len(codepoints):
        j = i
        while j + 1 < len(codepoints) and codepoints[j + 1] == codepoints[j] + 1:
            j += 1
        lo, hi = codepoints[i], codepoints[j]
        parts.append(f"\\x{{{lo:x}}}" if lo == hi else f"\\x{{{lo:x}}}-\\x{{{hi:x}}}")
        i = j + 1
    return "".join(parts)


WS_CLASS_BODY = _class_body(WS_CODEPOINTS)
WS_CLASS = f"[{WS_CLASS_BODY}]"
NON_WS_CLASS = f"[^{WS_CLASS_BODY}]"


@dataclass(frozen=True)
class LangProfile:
    """Letter class used by the quality score (language chars and sentences).

    ``letters`` is a regex character-class body valid in Java and RE2;
    ``ranges`` lists the same letters as inclusive code-point ranges.
    """

    name: str
    letters: str
    ranges: tuple = ()

    @property
    def letter_chars(self) -> str:
        return "".join(chr(c) for lo, hi in self.ranges for c in range(lo, hi + 1))


HANGUL = LangProfile("hangul", r"\x{ac00}-\x{d7a3}", ((0xAC00, 0xD7A3),))
LATIN = LangProfile("latin", r"A-Za-z\x{c0}-\x{ff}", ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xFF)))
PROFILES = {p.name: p for p in (HANGUL, LATIN)}


def profile(p: LangProfile | str) -> LangProfile:
    return PROFILES[p] if isinstance(p, str) else p
