"""Write packed sequences (and other outputs) as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame

from millstone.session import materialize
from millstone.sources.sequence_store import range_count


def write_sequences(seqs: DataFrame, path: str, max_records_per_file: int = 100_000,
                    order_col: str = "seq_id", partitions: int | None = None) -> str:
    """Write ``(seq_id, ids)`` range-partitioned by ``seq_id`` and sorted inside
    files, so files hold consecutive sequences in training order and a reader
    can stream them back in order by file name and offset."""
    seqs = materialize(seqs, "sequences")
    (seqs.repartitionByRange(partitions or range_count(seqs), order_col).sortWithinPartitions(order_col)
     .write.mode("overwrite").option("maxRecordsPerFile", max_records_per_file).parquet(path))
    return path
