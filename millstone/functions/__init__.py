from millstone.functions.text import (  # noqa: F401
    clean_text,
    filter_lines,
    marked_text,
    near_preview,
    normalize_whitespace,
    preview,
    quality_score,
    remove_references,
    replace_urls,
    score_parts,
    strip_delimiters,
    strip_ws,
)
from millstone.functions.draws import hash_key, uniform_draw  # noqa: F401
