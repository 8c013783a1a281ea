"""L1-L3: inspection reports as DataFrames (the original prints them)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millstone import settings as S
from millstone.functions.draws import hash_key
from millstone.functions.text import near_preview, preview
from millstone.operators.order import first_n_per_group
from millstone.operators.shuffle import first_rows


def inspect_samples(mixture: DataFrame, n: int = S.INSPECT_SAMPLES) -> DataFrame:
    """L1: first n documents of the shuffled mixture: position, length, preview."""
    return first_rows(mixture, n).select(
        "position", "source", "doc_id", F.length("text").cast("bigint").alias("length"),
        preview("text").alias("preview"))


def near_threshold(scored: DataFrame, thresholds: DataFrame, n: int = S.NEAR_THRESHOLD_SAMPLES,
                   tolerance: float = S.NEAR_THRESHOLD_TOLERANCE, seed: int = S.SEED,
                   key: str = "doc_id") -> DataFrame:
    """L2: up to n documents per source whose score lies in
    [threshold - tol, threshold + tol] (closed), first in the seeded shuffle
    order. One query for all sources; the per-source top-n is a
    WindowGroupLimit (partial top-n before the shuffle)."""
    t = thresholds.select("source", "threshold")
    band = (scored.join(F.broadcast(t), "source")  # one row per source: texts are not dealt by source
            .where((F.col("score") >= F.col("threshold") - tolerance)
                   & (F.col("score") <= F.col("threshold") + tolerance)))
    ranked = first_n_per_group(band, ["source"], [hash_key(key, seed), F.col(key)], n, "sample")
    return ranked.select("source", "sample", key, "score", near_preview("text").alias("preview"))


def threshold_report(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """L3: per source: ratio, threshold, sample size, documents and kept documents."""
    counts = (scored.join(F.broadcast(thresholds), "source", "inner")
              .groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"),
                                     F.sum((F.col("score") >= F.col("threshold")).cast("bigint")).alias("n_kept")))
    return thresholds.join(counts, "source").select("source", "cut_ratio", "threshold", "n_sample",
                                                     "n_docs", "n_kept")
