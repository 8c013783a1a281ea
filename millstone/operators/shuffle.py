"""Seeded shuffles and caps (H1, H3, H4, H5).

The permutation of a seeded shuffle is the order of ``md5(seed:key)`` (ties
by key), which any engine can reproduce. Positions are assigned without a
global single-task window: H1 buckets rows by the leading hash bits (uniform
by construction); H3 follows the places of a shuffle buffer, or shuffles inside fixed blocks
of a dense slot number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millstone import settings as S
from millstone.functions.draws import hash_key, hash_prefix
from millstone.operators.order import running_sum
from millstone.session import shuffle_partitions


def shuffle_rank(df: DataFrame, key: str = "doc_id", seed: int = S.SEED, out: str = "shuffle_rank",
                 n_buckets: int | None = None, salt: str = "") -> DataFrame:
    """H1: 0-based position of every row in the seeded full shuffle."""
    nb = n_buckets or shuffle_partitions(df.sparkSession)
    width = -(-(1 << 32) // max(1, nb))
    k = F.concat(F.lit(salt), F.col(key).cast("string")) if salt else F.col(key)
    x = df.withColumn("_hk", hash_key(k, seed))
    bucket = F.floor(hash_prefix(k, seed) / F.lit(width)).cast("bigint")
    return running_sum(x, ["_hk", key], out, bucket=bucket).drop("_hk")


def block_shuffle(df: DataFrame, slot_col: str = "slot", block: int = S.SHUFFLE_BUFFER,
                  seed: int = S.SEED, out: str = "position", salt: str = "shuffle:") -> DataFrame:
    """H3, block form: bounded-displacement shuffle of a dense slot sequence 0..N-1.

    Slots are cut into blocks of ``block`` consecutive slots; inside a block
    rows are ordered by a seeded hash. A row moves less than ``block``
    places, like a shuffle buffer of that size, and each block is one
    window partition, so the work is spread over N/block tasks."""
    blk = F.floor(F.col(slot_col) / F.lit(block)).cast("bigint")
    hk = hash_key(F.concat(F.lit(salt), F.col(slot_col).cast("string")), seed)
    w = Window.partitionBy("_blk").orderBy(hk, F.col(slot_col))
    return (df.withColumn("_blk", blk)
            .withColumn(out, F.col("_blk") * block + F.row_number().over(w) - 1)
            .drop("_blk"))


def buffer_shuffle(df: DataFrame, slot_col: str = "slot", buffer: int = S.SHUFFLE_BUFFER,
                   seed: int = S.SEED, out: str = "position", salt: str = "shuffle:") -> DataFrame:
    """H3: the shuffle buffer over a dense slot sequence 0..N-1.

    A buffer of ``buffer`` places is filled with the first rows. Every later row draws a
    place, the row in it leaves, and the new one takes the place; at the end the rows still
    in the buffer leave in random order. So a row leaves when its place is drawn the next time:
    the next slot in the order of (place, slot), one window partition of about N / buffer
    rows per place. The rows left at the end, one per place, go by the hash of the place."""
    n = df.count()
    here = min(n, buffer)
    slot = F.col(slot_col)
    draw = hash_prefix(F.concat(F.lit(salt), slot.cast("string")), seed) % buffer
    x = df.withColumn("_place", F.when(slot < buffer, slot).otherwise(draw).cast("bigint"))
    x = x.withColumn("_next", F.lead(slot_col).over(Window.partitionBy("_place").orderBy(slot_col)))
    # at most ``buffer`` rows: one window over them is bounded
    places = df.sparkSession.range(here).withColumnRenamed("id", "_p")
    by_hash = Window.orderBy(hash_key(F.concat(F.lit(f"{salt}tail:"), F.col("_p").cast("string")), seed), "_p")
    places = places.withColumn("_tail", F.row_number().over(by_hash) - 1)
    x = x.join(places, F.col("_place") == F.col("_p"))
    return (x.withColumn(out, F.coalesce(F.col("_next") - buffer, F.col("_tail") + (n - here)).cast("bigint"))
            .drop("_place", "_next", "_p", "_tail"))


def permuted(x: Column, n: int, seed: int = S.SEED, rounds: int = 4) -> Column:
    """H1 without a sort: place of ordinal ``x`` (0..n-1) in a keyed permutation of 0..n-1.

    A Feistel network on pairs (x % a, x div a) with a * b just over n: every round adds a hash of one half
    to the other one, which can be undone, so it permutes 0..a*b-1; places of n and above are sent
    through again (cycle walking), fewer than a of them in all. Any row finds its place alone."""
    a = math.isqrt(max(n, 1) - 1) + 1
    b = -(-max(n, 1) // a)
    draw = lambda i, v: hash_prefix(F.concat(i.cast("string"), F.lit(":"), v.cast("string")), seed)

    def half_turn(acc: Column, i: Column) -> Column:
        left, right = acc["l"], acc["r"]
        return F.struct(F.when(i % 2 == 0, (left + draw(i, right)) % a).otherwise(left).alias("l"),
                        F.when(i % 2 == 1, (right + draw(i, left)) % b).otherwise(right).alias("r"))

    def once(v: Column) -> Column:
        start = F.struct((v % a).cast("bigint").alias("l"), ((v - v % a) / a).cast("bigint").alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, half_turn, lambda acc: acc["r"] * a + acc["l"])

    # a walk visits each place over n once; beyond 64 steps its chance is under 64^-64
    walk = F.sequence(F.lit(1), F.lit(max(1, min(a * b - n, 64))))
    return F.aggregate(walk, once(x.cast("bigint")), lambda acc, _: F.when(acc < n, acc).otherwise(once(acc)))


def first_rows(df: DataFrame, n: int, position_col: str = "position") -> DataFrame:
    """H4: the first ``n`` rows of a dense positional order: a plain filter."""
    return df.where(F.col(position_col) < n)


def tokenizer_training_docs(df: DataFrame, limit: int | None = None,
                            min_length: int = S.DOC_MIN_LENGTH, position_col: str = "position",
                            text_col: str = "text") -> DataFrame:
    """H5 + C3: the documents a tokenizer is trained on: those of at least
    ``min_length`` code points, of all rows or, with a ``limit``, of the first
    ``limit + 2`` rows of the shuffled mixture (the original loop checks its
    cap after taking a row)."""
    df = df.where(F.length(text_col) >= min_length)
    return df if limit is None else df.where(F.col(position_col) <= limit + 1)
