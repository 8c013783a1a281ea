"""M1/M2: training-batch layout of packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millstone import settings as S


def shift(df: DataFrame, ids_col: str = "ids") -> DataFrame:
    """M1: inputs = all ids but the last, targets = all but the first."""
    n = F.size(ids_col) - 1
    return (df.withColumn("inputs", F.slice(ids_col, F.lit(1), n))
            .withColumn("targets", F.slice(ids_col, F.lit(2), n)))


def batch_plan(seqs: DataFrame, n_sequences: int, steps: int = S.MAX_STEPS,
               grad_acc: int = S.GRAD_ACC_STEPS, batch_size: int = S.BATCH_SIZE,
               seq_col: str = "seq_id") -> DataFrame:
    """M2: which sequence fills which (step, micro_batch, row).

    Sequences are dense ``0..N-1``. A pass holds ``M = ceil(N / batch_size)``
    micro-batches (the last may be short); the data restarts when a pass
    ends. Global micro-batch g = step * grad_acc + micro_batch;
    pass = g div M; it takes sequences with ``seq_id div batch_size = g mod M``.
    Equi-join of the micro-batch range with the sequences on that key.
    """
    if n_sequences <= 0:
        raise ValueError("no sequences to batch")
    M = -(-n_sequences // batch_size)
    spark = seqs.sparkSession
    g = spark.range(steps * grad_acc).select(F.col("id").alias("g"))
    g = g.select("g", (F.col("g") % M).alias("_mb"))
    s = seqs.select(F.col(seq_col).alias("seq_id"), F.floor(F.col(seq_col) / batch_size).alias("_mb"))
    return (g.join(s, "_mb")
            .select(F.floor(F.col("g") / grad_acc).alias("step"), (F.col("g") % grad_acc).alias("micro_batch"),
                    (F.col("seq_id") % batch_size).alias("row"), F.floor(F.col("g") / M).alias("pass"),
                    "seq_id"))
