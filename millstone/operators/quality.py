"""Per-source quality thresholds and filters.

Threshold of a source = linear-interpolated quantile (numpy's default rule)
of the quality scores of a seeded sample of ``min(k, n)`` of its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millstone import settings as S
from millstone.functions.draws import hash_key, hash_prefix

HIST_BITS = 16  # histogram resolution of the sample cutoff


def literal_map(d: dict) -> Column:
    """A map literal from a small parameter dict (no join needed)."""
    kv = []
    for k, v in d.items():
        if k is not None:
            kv += [F.lit(k), F.lit(v)]
    return F.create_map(*kv)


def lookup(d: dict, key: Column) -> Column:
    """Value of ``key`` in a small parameter dict, a null key included; null where absent."""
    some = literal_map(d)[key] if any(k is not None for k in d) else F.lit(None)
    return F.when(key.isNull(), F.lit(d.get(None))).otherwise(some)


def sample_per_source(df: DataFrame, k: int = S.SAMPLE_SIZE, seed: int = S.SEED,
                      key: str = "doc_id", source_col: str = "source") -> DataFrame:
    """H1 + H2: per source, the first ``min(k, n)`` rows of the seeded hash order
    ``(md5(seed:key), key)``; adds ``sample_rank`` (1-based).

    Exact and bounded: a histogram of the top hash bits per source (partial
    aggregate, at most 2^16 rows per source) gives the smallest hash bin at
    which the running count reaches k. Only rows at or below that bin reach
    the final per-source ranking, about ``k + n/2^16`` rows per source, so
    a source holding a third of the table never lands whole in one task.
    """
    shift = 32 - HIST_BITS
    x = df.withColumn("_hp", hash_prefix(key, seed)).withColumn("_bin", F.shiftright("_hp", shift))
    hist = x.groupBy(source_col, "_bin").agg(F.count(F.lit(1)).alias("_c"))
    cw = Window.partitionBy(source_col).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    cut = (hist.withColumn("_cum", F.sum("_c").over(cw))
           .withColumn("_prev", F.col("_cum") - F.col("_c"))
           .where(F.col("_prev") < k)            # bins needed to reach k rows
           .groupBy(source_col).agg(F.max("_bin").alias("_cut")))
    cut = cut.withColumnRenamed(source_col, "_src")
    kept = (x.join(F.broadcast(cut), F.col(source_col).eqNullSafe(F.col("_src")) & (F.col("_bin") <= F.col("_cut")))
            .drop("_cut", "_src"))
    rw = Window.partitionBy(source_col).orderBy(hash_key(key, seed), F.col(key))
    return (kept.withColumn("sample_rank", F.row_number().over(rw))
            .where(F.col("sample_rank") <= k)
            .drop("_hp", "_bin"))


def quantile_per_group(df: DataFrame, value_col: str, q: Column, group_cols: list[str],
                       out: str = "quantile") -> DataFrame:
    """Linear-interpolated quantile per group, numpy's rule exactly:
    h = (n-1)q, lo = floor(h), t = h - lo,
    value = v_lo + (v_hi - v_lo) t   if t < 0.5
            v_hi - (v_hi - v_lo)(1-t) otherwise.
    Groups must be bounded (here: samples of at most k rows)."""
    w = Window.partitionBy(*group_cols).orderBy(value_col)
    x = (df.withColumn("_q", q)
         .withColumn("_r", F.row_number().over(w) - 1)
         .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*group_cols))))
    h = (F.col("_n") - 1) * F.col("_q")
    x = (x.withColumn("_h", h)
         .withColumn("_lo", F.floor("_h"))
         .withColumn("_hi", F.least(F.col("_lo") + 1, F.col("_n") - 1)))
    g = x.groupBy(*group_cols).agg(
        F.first("_h").alias("_h"), F.first("_lo").alias("_lo"), F.first("_n").alias("n_sample"),
        F.max(F.when(F.col("_r") == F.col("_lo"), F.col(value_col))).alias("_vlo"),
        F.max(F.when(F.col("_r") == F.col("_hi"), F.col(value_col))).alias("_vhi"))
    t = F.col("_h") - F.col("_lo")
    diff = F.col("_vhi") - F.col("_vlo")
    val = F.when(t >= 0.5, F.col("_vhi") - diff * (F.lit(1.0) - t)).otherwise(F.col("_vlo") + diff * t)
    return g.select(*group_cols, "n_sample", val.alias(out))


def source_thresholds(scored: DataFrame, ratios: dict | None = None,
                      default_ratio: float = S.DEFAULT_CUT_RATIO,
                      sample_size: int = S.SAMPLE_SIZE, seed: int = S.SEED,
                      sources: list[str] | None = None, key: str = "doc_id",
                      score_col: str = "score") -> DataFrame:
    """``(source, cut_ratio, n_sample, threshold)`` for every source
    (or the listed ones). ``scored`` needs ``source``, ``key`` and the score
    column; if the score is an expression it is evaluated on sampled rows only.
    Sources without rows get no threshold row (nothing to filter)."""
    df = scored if sources is None else scored.where(F.col("source").isin(list(sources)))
    df = df.where(F.col(score_col).isNotNull())  # a row without a score is in no sample
    sample = sample_per_source(df.select("source", key, score_col), sample_size, seed, key)
    ratio = F.coalesce(lookup(ratios or {}, F.col("source")), F.lit(float(default_ratio)))
    th = quantile_per_group(sample.withColumn("cut_ratio", ratio), score_col, F.col("cut_ratio"),
                            ["source", "cut_ratio"], out="threshold")
    return th.select("source", "cut_ratio", "n_sample", "threshold")


def collect_thresholds(thresholds: DataFrame) -> dict[str, float]:
    """Thresholds as a dict, one float per source: for source lists that fit
    the driver. ``quality_filter`` takes the DataFrame as well."""
    return {r["source"]: r["threshold"] for r in thresholds.select("source", "threshold").toLocalIterator()}


def quality_filter(df: DataFrame, thresholds: dict | DataFrame, score_col: str = "score") -> DataFrame:
    """Keep rows with score >= their source's threshold; sources with no
    threshold pass, rows without a score never do. A dict becomes a map
    literal (plain filter, no join); a DataFrame is joined."""
    df = df.where(F.col(score_col).isNotNull())
    if isinstance(thresholds, dict):
        thr = lookup(thresholds, F.col("source"))
        return df.where(thr.isNull() | (F.col(score_col) >= thr))
    t = thresholds.select(F.col("source").alias("_src"), F.col("threshold").alias("_thr"))
    return (df.join(t, F.col("source").eqNullSafe(F.col("_src")), "left")
            .where(F.col("_thr").isNull() | (F.col(score_col) >= F.col("_thr")))
            .drop("_thr", "_src"))


def min_length(df: DataFrame, n: int = S.DOC_MIN_LENGTH, text_col: str = "text") -> DataFrame:
    """Documents with at least ``n`` code points."""
    return df.where(F.length(text_col) >= n)
