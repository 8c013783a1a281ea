"""G2 + K9: append EOS to every document's tokens, concatenate in document
order, cut into sequences of exactly ``context_len`` tokens, drop the
unfinished tail.

Token offsets come from a prefix sum of token counts (no single-task
window). The exchange of that sum brings the documents of an order range
together in order, so their sequences are cut there; only sequences that
reach over the border of a range are gathered from pieces, and a sequence
gathers at most ``context_len`` tokens. Between steps tokens are bytes
(``functions.id_codec``): they are written and exchanged once each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from millstone.functions.id_codec import unzip_ids, unzipped, zip_ids, zipped
from millstone.operators.order import running_sum
from millstone.session import materialize, materialize_last, shuffles_freed, ship_package

ROWS = 512  # sequences and pieces that a task gives away at once


def append_eos(tokens_col: str, eos_id: int):
    """K9: ids + [eos]."""
    return F.array_append(F.col(tokens_col), F.lit(eos_id).cast("int"))


def pack(df: DataFrame, tokens_col: str, order_cols: list[str], context_len: int,
         eos_id: int, partition_cols: list[str] | tuple = (), as_bytes: bool = False) -> DataFrame:
    """Return ``(*partition_cols, seq_id, ids array<int>)``; seq_id is dense from 0. With ``as_bytes`` the ids are
    ``(_n, _zip)``, their number and bytes, for what stores them."""
    L = int(context_len)
    pcols = list(partition_cols)
    x = df.select(*pcols, *order_cols, append_eos(tokens_col, eos_id).alias("_tok"))
    element = x.schema["_tok"].dataType.elementType
    with shuffles_freed(df.sparkSession):
        done = materialize_last(lambda: cut(starts(x, order_cols, pcols), pcols, L, element), "pieces")
    whole = done.where(F.col("_n") == L).select(*pcols, "seq_id", "_n", "_zip")
    rest = gather(unfinished(done, pcols, L, element), pcols).where(F.size("ids") == L)
    if as_bytes:
        return whole.unionByName(zipped(rest, "ids"))
    return whole.select(*pcols, "seq_id", unzipped("_zip", element).alias("ids")).unionByName(rest)


def starts(x: DataFrame, order_cols: list[str], keys: list[str]) -> DataFrame:
    """``(*keys, *order_cols, _tok)`` as ``(..., _n, _zip, _start)``: size, bytes and offset within ``keys`` of every list that is not null."""
    ship_package(x.sparkSession)
    x = materialize(zipped(x, "_tok"), "pack")  # the prefix sum reads its input several times: tokenise once
    return running_sum(x.where("_n IS NOT NULL"), order_cols, "_start", keys, weight=F.col("_n"))


def cut(x: DataFrame, keys: list[str], L: int, element: T.DataType) -> DataFrame:
    """Documents ``(*keys, _n, _zip, _start)`` as the sequences they fill and the pieces of others, ``(*keys, seq_id, _lo, _n, _zip)``.
    Documents that follow each other are cut as one; in any other order of the rows there are more pieces."""
    kept = [T.StructField(k, x.schema[k].dataType) for k in keys]
    out = T.StructType([*kept, T.StructField("seq_id", T.LongType()), T.StructField("_lo", T.LongType()),
                        T.StructField("_n", T.LongType()), T.StructField("_zip", T.BinaryType())])
    kind, names = to_arrow_type(element), out.names

    def cut_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        rows: list[tuple] = []
        held: list[pa.Array] = []  # of the open piece of ``key``, from ``lo`` up to ``at``
        key, lo, at = (), 0, 0

        def close() -> None:
            if held:
                rows.append((*key, lo // L, lo, at - lo, zip_ids(pa.concat_arrays(held))))
                held.clear()

        def made() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for b in batches:
            types = [*(b.column(k).type for k in range(len(keys))), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            for *k, data, start in zip(*(c.to_pylist() for c in b.columns)):
                ids = unzip_ids(data, kind)
                if k != key or start != at:
                    close()
                    key, lo, at = k, start, start
                while at < start + len(ids):
                    upto = min((at // L + 1) * L, start + len(ids))
                    held.append(ids[at - start:upto - start])
                    at = upto
                    if at % L == 0:
                        close()
                        lo = at
                    if len(rows) >= ROWS:
                        yield made()
        close()
        if rows:
            yield made()

    return x.select(*keys, "_zip", "_start").mapInArrow(cut_batches, out)


def unfinished(done: DataFrame, keys: list[str], L: int, element: T.DataType) -> DataFrame:
    """The pieces of ``cut`` that are not whole sequences: ``(*keys, seq_id, _pc)``."""
    piece = F.struct(F.col("_lo").alias("lo"), unzipped("_zip", element).alias("piece"))
    return done.where(F.col("_n") < L).select(*keys, "seq_id", piece.alias("_pc"))


def gather(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, seq_id, ids)`` of slices, unfinished sequences included."""
    g = pieces.groupBy(*keys, "seq_id").agg(F.array_sort(F.collect_list("_pc")).alias("_pcs"))
    return g.select(*keys, "seq_id", F.flatten(F.transform("_pcs", lambda s: s["piece"])).alias("ids"))


def codepoint_tokens(text_col: str = "text"):
    """A tokenizer any SQL engine can reproduce: one id per code point."""
    return F.transform(F.split(F.col(text_col), "", -1), lambda c: F.ascii(c))
