"""The whole preparation pipeline as a chain of Spark jobs.

prepare (clean + score, written once) -> thresholds (sampled, small) ->
quality filter (map literal, no join) -> weighted interleave -> shuffle
buffer. Each stage boundary is a written table or a tiny collected dict,
so nothing is recomputed from raw text and a lost executor only reruns the
stage it was in.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from millstone import settings as S
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from millstone.operators.grouping import group_until_delimiter
from millstone.operators.mixture import interleave
from millstone.operators.quality import collect_thresholds, quality_filter, source_thresholds
from millstone.operators.shuffle import buffer_shuffle
from millstone.plans.prepare import prepare
from millstone.session import materialize
from millstone.sources.tables import SourceSpec, exclude_urls, read_source, union_sources


@dataclass
class MixtureConfig:
    probs: dict = field(default_factory=lambda: dict(S.MIX_RATIOS))
    cut_ratios: dict = field(default_factory=lambda: dict(S.CUT_RATIOS))
    default_cut_ratio: float = S.DEFAULT_CUT_RATIO
    thresholded: tuple = ("wiki", "namu", "culturax")
    synthetic: tuple = ("stories",)
    sample_size: int = S.SAMPLE_SIZE
    seed: int = S.SEED
    shuffle_buffer: int = S.SHUFFLE_BUFFER
    profile: str = "hangul"


def build_mixture(docs: DataFrame, cfg: MixtureConfig | None = None, write: bool = True) -> DataFrame:
    """``docs(doc_id, source, text)`` -> mixture
    ``(position, slot, source, ordinal, doc_id, text, score)``; ``position``
    is dense from 0 and is the training order."""
    cfg = cfg or MixtureConfig()
    prepared = prepare(docs, cfg.synthetic, cfg.profile, write=write)
    th = source_thresholds(prepared, cfg.cut_ratios, cfg.default_cut_ratio, cfg.sample_size, cfg.seed,
                           sources=list(cfg.thresholded))
    if not write:
        kept = quality_filter(prepared, collect_thresholds(th))
        return buffer_shuffle(interleave(kept, cfg.probs, cfg.seed), "slot", cfg.shuffle_buffer, cfg.seed)
    # slots and positions are found on (source, doc_id, row) alone; the text is moved once, by the last join. A row is
    # named by its place in the written table, so repeated or null ids stay apart.
    kept = quality_filter(prepared.withColumn("_row", F.struct("_metadata.file_name", "_metadata.row_index")),
                          collect_thresholds(th))
    mixed = interleave(kept.select("source", "doc_id", "_row"), cfg.probs, cfg.seed)
    placed = buffer_shuffle(mixed, "slot", cfg.shuffle_buffer, cfg.seed).select("_row", "position", "slot", "ordinal")
    out = placed.join(kept, "_row").drop("_row")
    return materialize(out, "mixture")


@dataclass
class CorpusSource:
    """One corpus source of the mixture and how it is prepared."""

    spec: SourceSpec
    mix_prob: float
    cut_ratio: float | None = None      # None: no quality threshold (passes)
    url_exclude: tuple = ()             # C1 on the ``url`` column
    group: bool = False                 # G1: merge rows until a delimiter row


def load_corpus(spark: SparkSession, sources: list[CorpusSource]) -> DataFrame:
    """A1 + C1 + G1 + A3: every source as ``(doc_id, source, text)``.

    Grouped sources get the group's first row id as ``doc_id``; the group end
    is the source's ``ends`` predicate, else "text contains the delimiter"."""
    parts = []
    for cs in sources:
        df = read_source(spark, cs.spec)
        if cs.url_exclude:
            df = exclude_urls(df, list(cs.url_exclude))
        if cs.group:
            ends = F.col("_end") if "_end" in df.columns else None
            df = group_until_delimiter(df, ["doc_id"], ends=ends).select(
                F.col("first_doc_id").alias("doc_id"), F.lit(cs.spec.name).alias("source"), "text")
        parts.append(df.select("doc_id", "source", "text"))
    return union_sources(*parts)


def corpus_mixture(spark: SparkSession, sources: list[CorpusSource], profile: str = "hangul",
                   seed: int = S.SEED, sample_size: int = S.SAMPLE_SIZE,
                   shuffle_buffer: int = S.SHUFFLE_BUFFER, write: bool = True) -> DataFrame:
    """T2 from source definitions: load, group, clean, threshold, filter,
    interleave, shuffle."""
    cfg = MixtureConfig(
        probs={cs.spec.name: cs.mix_prob for cs in sources},
        cut_ratios={cs.spec.name: cs.cut_ratio for cs in sources if cs.cut_ratio is not None},
        thresholded=tuple(cs.spec.name for cs in sources if cs.cut_ratio is not None),
        synthetic=tuple(cs.spec.name for cs in sources if cs.spec.synthetic),
        sample_size=sample_size, seed=seed, shuffle_buffer=shuffle_buffer, profile=profile)
    return build_mixture(load_corpus(spark, sources), cfg, write=write)
