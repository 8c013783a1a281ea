"""E1/E2 on a stream: per-source thresholds of documents that keep arriving.

The sample of a source is its first ``k`` rows in the seeded hash order (H2). Such samples merge: the first k of all rows are among the
first k of every part. So each micro-batch merges its rows with the sample so far and writes the new
sample, bounded by k rows per source, as a table of its own in a shared folder; a batch that is run again writes the same table
again. Thresholds at any time are the quantiles of the last sample, the same as those of a batch job over all rows so far.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millstone import settings as S
from millstone.operators.quality import sample_per_source, source_thresholds
from millstone.session import materialize, path_exists

COLUMNS = ["source", "doc_id", "score"]


def _batch(state: str, n: int) -> str:
    return f"{state}/batch-{n:09d}"


def merge_into(state: str, sample_size: int = S.SAMPLE_SIZE, seed: int = S.SEED):
    """A ``foreachBatch`` function that keeps the samples of a scored stream (source, doc_id, score) under ``state``."""
    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rows = materialize(batch.select(COLUMNS).where("score IS NOT NULL"), "scores")  # cleaned and scored once
        if n and path_exists(spark, _batch(state, n - 1)):
            rows = rows.unionByName(spark.read.parquet(_batch(state, n - 1)))
        sample_per_source(rows, sample_size, seed).select(COLUMNS).write.mode("overwrite").parquet(_batch(state, n))
    return merge


def sample_stream(scored: DataFrame, state: str, sample_size: int = S.SAMPLE_SIZE, seed: int = S.SEED) -> int:
    """Run over everything available (``availableNow``); returns the number of the last batch. Called again with the same ``state``, it
    goes on with what has arrived since."""
    query = (scored.writeStream.foreachBatch(merge_into(state, sample_size, seed))
             .option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    done = [p["batchId"] for p in query.recentProgress]
    return max(done, default=-1)


def stream_thresholds(spark: SparkSession, state: str, last: int, ratios: dict | None = None, default_ratio: float = S.DEFAULT_CUT_RATIO,
                      sample_size: int = S.SAMPLE_SIZE, seed: int = S.SEED, sources: list[str] | None = None) -> DataFrame:
    """(source, cut_ratio, n_sample, threshold) of the sample after batch ``last``."""
    while last > 0 and not path_exists(spark, _batch(state, last)):
        last -= 1  # a batch without rows writes nothing
    return source_thresholds(spark.read.parquet(_batch(state, last)), ratios, default_ratio, sample_size, seed, sources)
