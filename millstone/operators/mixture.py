"""Weighted interleave of sources with reproducible draws.

Output slot s draws a source with the given probabilities from
``md5(seed:s)``; it takes that source's next row (rows in source order);
the mixture stops right after some source's last row has been taken.

As a set computation:
* slots ``0..N-1`` (``spark.range``) get their source by comparing the draw
  with cumulative probabilities (computed once in Python, used as literals);
* a slot's ordinal = number of earlier slots of the same source (prefix
  count, buckets = dense slot ranges);
* stop slot = the smallest slot whose ordinal is its source's size - 1;
* rows get per-source ordinals in source order; slots join rows on
  ``(source, ordinal)``: an equi-join with unique keys, no hot key even
  when one source holds most rows.
N starts at ``ceil(min(size/p) * 1.1) + 1000`` and doubles until some
source runs out inside it.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millstone import settings as S
from millstone.functions.draws import uniform_draw
from millstone.operators.order import dense_bucket, running_sum
from millstone.operators.quality import literal_map
from millstone.session import shuffle_partitions


def draw_source(slot: Column | str, probs: dict[str, float], seed: int = S.SEED) -> Column:
    names = list(probs)
    cum = list(accumulate(float(probs[n]) for n in names))
    u = uniform_draw(slot, seed)
    expr = F.lit(names[-1])
    for n, c in reversed(list(zip(names[:-1], cum[:-1]))):
        expr = F.when(u < F.lit(c), F.lit(n)).otherwise(expr)
    return expr


def source_sizes(df: DataFrame, sources: list[str], source_col: str = "source") -> dict[str, int]:
    rows = (df.where(F.col(source_col).isin(sources)).groupBy(source_col).count().collect())
    sizes = {s: 0 for s in sources}
    sizes.update({r[source_col]: r["count"] for r in rows})
    return sizes


def slot_plan(spark, n_slots: int, probs: dict[str, float], seed: int = S.SEED) -> DataFrame:
    """``(slot, source, ordinal)`` for slots 0..n_slots-1."""
    nb = max(1, shuffle_partitions(spark))
    width = max(1, -(-n_slots // nb))
    slots = spark.range(n_slots).select(F.col("id").alias("slot"))
    slots = slots.withColumn("source", draw_source("slot", probs, seed))
    return running_sum(slots, ["slot"], "ordinal", ["source"], bucket=dense_bucket("slot", width))


def interleave(df: DataFrame, probs: dict[str, float] = S.MIX_RATIOS, seed: int = S.SEED,
               order_cols: list[str] = ("doc_id",), source_col: str = "source",
               n_slots: int | None = None) -> DataFrame:
    """Return df's columns plus ``slot`` (dense 0..stop) and ``ordinal``."""
    spark = df.sparkSession
    names = list(probs)
    if abs(sum(probs.values()) - 1.0) > 1e-9:
        raise ValueError("probabilities must sum to 1")
    sizes = source_sizes(df, names, source_col)
    empty = [s for s, n in sizes.items() if n == 0]
    if empty:
        raise ValueError(f"empty sources in the mixture: {empty}")
    n = n_slots or math.ceil(min(sizes[s] / probs[s] for s in names if probs[s] > 0) * 1.1) + 1000
    size_of = literal_map({s: int(v) for s, v in sizes.items()})
    while True:
        slots = slot_plan(spark, n, probs, seed)
        stop = (slots.where(F.col("ordinal") == size_of[F.col("source")] - 1)
                .agg(F.min("slot")).first()[0])
        if stop is not None:
            break
        n *= 2
    # ordinals of slots <= stop do not depend on later slots: reuse the plan
    picked = slots.where(F.col("slot") <= stop).withColumnRenamed("source", source_col)
    rows = df.where(F.col(source_col).isin(names))
    rows = running_sum(rows, list(order_cols), "ordinal", [source_col])
    return picked.join(rows, on=[source_col, "ordinal"], how="inner")
