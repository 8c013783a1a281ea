"""Document preparation job: sources -> clean -> score, written once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millstone import settings as S
from millstone.functions.text import clean_text, quality_score
from millstone.session import ensure_parallelism, materialize


def computed_once(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """Add/replace column ``name`` = ``expr`` behind a one-element explode.

    A later filter on the column cannot be pushed below a Generate, so Catalyst
    cannot substitute the (regex-heavy) expression into the predicate and
    evaluate it once for the filter and again for the output; without this,
    a filter on the score inlines the whole cleaning expression into the
    predicate once per reference to the cleaned text."""
    keep = [c for c in df.columns if c != name]
    return df.select(*keep, F.explode(F.array(expr)).alias(name))


def clean_and_score(docs: DataFrame, synthetic: bool | Column = False,
                    prof: S.LangProfile | str = S.HANGUL) -> DataFrame:
    """B2 + D7 + D5: replace ``text`` by its cleaned form and add ``score``
    computed on the cleaned text; each evaluated once per row."""
    cleaned = computed_once(docs, "text", clean_text("text", synthetic, prof))
    return computed_once(cleaned, "score", quality_score("text", prof))


def prepare(docs: DataFrame, synthetic_sources: list[str] | tuple = (),
            prof: S.LangProfile | str = S.HANGUL, write: bool = True) -> DataFrame:
    """Clean and score every document once; ``synthetic_sources`` skip the
    line filter. Written to the shared checkpoint folder so thresholds,
    filter and inspection read the result instead of re-running the regexes."""
    syn = F.col("source").isin(list(synthetic_sources)) if synthetic_sources else False
    out = clean_and_score(ensure_parallelism(docs), syn, prof)
    return materialize(out, "prepared") if write else out
