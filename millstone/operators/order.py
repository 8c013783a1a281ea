"""Ordered operators without single-partition windows.

``running_sum`` is the shared core of row ordinals (I1), group ids (G1) and
token offsets (G2). A window with no ``partitionBy`` pulls the whole table
into one task, so instead:

1. every row gets a deterministic *bucket* from its leading order key
   (range boundaries from ``approxQuantile``, or a caller-given expression
   such as ``slot div B`` for dense keys);
2. per (group, bucket) totals are aggregated (map-side partial aggregate),
   and a running sum over that small table gives each bucket its base;
3. a window over (group, bucket) sums within the bucket, and a join where
   that window has put the rows adds the base.

Buckets are derived from key values only, never from partition ids, so a
recomputed task after an executor loss gets the same answer.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millstone.session import shuffle_partitions

BUCKET = "_bucket"


_JSON_TYPES = {"tinyint", "smallint", "int", "bigint", "double", "string", "boolean"}


def boundary_array(splits: list, dtype: T.DataType, plain: bool) -> Column:
    """Sorted boundaries as one constant array. Values that JSON carries exactly come as a single literal,
    which the optimiser reads once; others as one literal each."""
    if plain:
        return F.from_json(F.lit(json.dumps(splits)), T.ArrayType(dtype))
    if isinstance(dtype, T.StructType):
        return F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(t, dtype)]) for t in splits])
    return F.array(*[F.lit(v).cast(dtype) for v in splits])


def bucket_of(key: Column, bounds: Column, n: int) -> Column:
    """How many of ``n`` sorted boundaries are at or below ``key``: a binary search, in steps of falling powers of two.
    The plan has one literal and one expression for any number of boundaries; a null key is in bucket 0."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) <= key, at + step).otherwise(at))


def range_bucket(df: DataFrame, key: str | list[str], n_buckets: int | None = None,
                 rel_err: float = 0.001, sample_per_bucket: int = 32) -> Column:
    """Range bucket of the order key with roughly equal row counts per bucket.

    One numeric column: boundaries from ``approxQuantile``. Any other key
    (e.g. ``(conv_id, turn)``) is split on the whole tuple, so one hot value
    of the leading column still spreads over many buckets: boundaries are
    taken from a seeded sample of about ``sample_per_bucket`` rows per bucket
    (bounded) and compared as structs."""
    n = n_buckets or shuffle_partitions(df.sparkSession)
    keys = [key] if isinstance(key, str) else list(key)
    if n <= 1:
        return F.lit(0)
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    if len(keys) == 1 and dict(df.dtypes)[keys[0]] in numeric:
        rel_err = min(rel_err, 0.25 / n)  # finer than the buckets asked for
        probs = [i / n for i in range(1, n)]
        splits = sorted(set(x for x in df.approxQuantile(keys[0], probs, rel_err) if x is not None))
        if not splits:
            return F.lit(0)
        bounds = boundary_array([float(s) for s in splits], T.DoubleType(), True)
        return bucket_of(F.col(keys[0]).cast("double"), bounds, len(splits))
    total = df.count()
    if total == 0:
        return F.lit(0)
    frac = min(1.0, sample_per_bucket * n / total)
    sample = df.select(*keys).dropna().sample(False, frac, seed=17).collect()
    rows = sorted(tuple(r) for r in sample)
    splits = []
    for i in range(1, n):
        if rows:
            t = rows[(i * len(rows)) // n]
            if not splits or t > splits[-1]:
                splits.append(t)
    if not splits:
        return F.lit(0)
    fields = [df.schema[k] for k in keys]
    plain = all(f.dataType.simpleString() in _JSON_TYPES for f in fields)
    kind = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    bounds = boundary_array([dict(zip(keys, t)) for t in splits] if plain else splits, kind, plain)
    return bucket_of(F.struct(*[F.col(k).alias(k) for k in keys]), bounds, len(splits))


def dense_bucket(key: str, width: int) -> Column:
    """Bucket of a dense integer key (e.g. a slot number): ``key div width``."""
    return F.floor(F.col(key) / F.lit(width)).cast("bigint")


def running_sum(df: DataFrame, order_cols: list[str], out: str,
                partition_cols: list[str] | tuple = (), weight: Column | None = None,
                inclusive: bool = False, bucket: Column | None = None,
                n_buckets: int | None = None, keep_bucket: bool = False) -> DataFrame:
    """Add ``out`` = running sum of ``weight`` (default 1, giving 0-based row
    ordinals) within ``partition_cols`` in ``order_cols`` order.

    ``order_cols`` must order rows totally within a group (ties make the
    result depend on the sort). ``inclusive=False`` sums strictly earlier rows.
    """
    pcols = list(partition_cols)
    w = (weight if weight is not None else F.lit(1)).cast("bigint")
    b = bucket if bucket is not None else range_bucket(df, order_cols, n_buckets)
    x = df.withColumn(BUCKET, b).withColumn("_w", w)
    if pcols:  # one struct for the group: a null group key is a group, and the join finds the rows where the window has put them
        x = x.withColumn("_g", F.struct(*pcols))
    keys = ["_g", BUCKET] if pcols else [BUCKET]
    totals = x.groupBy(*keys).agg(F.sum("_w").alias("_tot"))
    bw = Window.partitionBy(*keys[:-1]).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*[F.col(k).alias(f"_on{k}") for k in keys], F.coalesce(F.sum("_tot").over(bw), F.lit(0)).cast("bigint").alias("_base"))
    rw = Window.partitionBy(*keys).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_in", F.sum("_w").over(rw))
    x = x.join(base, [F.col(k) == F.col(f"_on{k}") for k in keys]).drop("_g", *[f"_on{k}" for k in keys])
    incl = F.col("_base") + F.col("_in")
    x = x.withColumn(out, incl if inclusive else incl - F.col("_w"))
    drop = ["_w", "_in", "_base"] + ([] if keep_bucket else [BUCKET])
    return x.drop(*drop)


def row_ordinal(df: DataFrame, order_cols: list[str], out: str = "ordinal",
                partition_cols: list[str] | tuple = (), **kw) -> DataFrame:
    """0-based row number within groups, computed without a one-task window."""
    return running_sum(df, order_cols, out, partition_cols, **kw)


def first_n_per_group(df: DataFrame, group_cols: list[str], order: list[Column], n: int,
                      rank_col: str = "rank") -> DataFrame:
    """First ``n`` rows per group by ``order`` (``rank`` is 1-based).

    ``row_number() <= n`` over a group window becomes a WindowGroupLimit:
    each map task keeps only its top n per group before the shuffle.
    """
    w = Window.partitionBy(*group_cols).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)
