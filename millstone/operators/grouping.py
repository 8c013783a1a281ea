"""G1: merge consecutive rows into documents until a row closes the group.

A row closes its group when it contains the delimiter (or when a given
boolean column is true); that row belongs to the group it closes, text after
the delimiter included. An unfinished last group is emitted too.

group id = number of closing rows strictly before the row (prefix sum,
``operators.order.running_sum``). Texts are concatenated in two levels:
first per (group, order bucket), then the bucket pieces per group, so a group
that spans much of the table is concatenated by many tasks and only the
final join of its pieces happens in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millstone import settings as S
from millstone.operators.order import BUCKET, running_sum


def group_until_delimiter(df: DataFrame, order_cols: list[str], text_col: str = "text",
                          ends: Column | None = None, delimiter: str = S.EOS_TOKEN,
                          partition_cols: list[str] | tuple = (), sep: str = " ",
                          out_text: str = "text") -> DataFrame:
    """Return ``(*partition_cols, group_id, <out_text>, n_rows, first_<order_cols[0]>)``."""
    pcols = list(partition_cols)
    flag = ends if ends is not None else F.col(text_col).contains(delimiter)
    x = df.withColumn("_end", F.coalesce(flag, F.lit(False)).cast("int"))
    x = running_sum(x, order_cols, "group_id", pcols, weight=F.col("_end"), keep_bucket=True)
    first = f"first_{order_cols[0]}"
    rows = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order_cols], F.col(text_col).alias("_t"))))
    part = (x.groupBy(*pcols, "group_id", BUCKET)
            .agg(rows.alias("_rows"), F.count(F.lit(1)).alias("_n"))
            .select(*pcols, "group_id", BUCKET, "_n",
                    F.col("_rows")[0][order_cols[0]].alias("_first"),
                    # a bucket of null texts adds no piece
                    F.when(F.exists("_rows", lambda r: r["_t"].isNotNull()),
                           F.array_join(F.transform("_rows", lambda r: r["_t"]), sep)).alias("_piece")))
    pieces = F.array_sort(F.collect_list(F.struct(F.col(BUCKET), F.col("_piece"))))
    return (part.groupBy(*pcols, "group_id")
            .agg(pieces.alias("_p"), F.sum("_n").alias("n_rows"), F.min("_first").alias(first))
            .select(*pcols, "group_id", F.array_join(F.transform("_p", lambda r: r["_piece"]), sep).alias(out_text),
                    "n_rows", first))
