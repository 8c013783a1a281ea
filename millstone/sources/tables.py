"""Scans (A1-A3) and the URL exclusion filter.

A source is a file-backed table with a text column. It is read with an
explicit schema subset, so Parquet reads only the named columns, and is
normalised to ``(doc_id, source, text[, url])``.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millstone import settings as S
from millstone.operators.order import running_sum
from millstone.session import materialize, scratch_path

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One supplied table: ``{sf_dir}/{name}.parquet``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@dataclass(frozen=True)
class SourceSpec:
    """How to read one corpus source.

    ``columns`` maps output names (doc_id, text, optional url) to input column
    names (``doc_id`` may be a SQL expression over the input); ``where`` is an optional row predicate (SQL string) applied at the
    scan so it reaches Parquet as a pushed filter where possible.
    """

    name: str
    path: str
    format: str = "parquet"
    columns: dict = field(default_factory=lambda: {"doc_id": "doc_id", "text": "text"})
    where: str | None = None
    synthetic: bool = False
    options: dict = field(default_factory=dict)
    ends: str | None = None  # SQL predicate marking rows that close a group (G1)


def in_file_order(spark: SparkSession, df: DataFrame, spec: SourceSpec) -> DataFrame:
    """``df`` with ``_id``, the row's number in file order (path, then place in the file), from 0.

    Parquet rows know their number in the file. Other formats do not, so those are written to the shared folder
    once: a task writes a piece of a file (``file_block_start``) in order, so the written row numbers give the
    place in the piece. A row's number is then the piece's base plus its place: no sort, and identical rows
    get different numbers. Pieces are few; their table is joined as adaptive execution sees fit."""
    piece = [F.col("_metadata.file_path").alias("_file")]
    if spec.format == "parquet":
        x = df.select("*", *piece, F.lit(0).cast("bigint").alias("_at"), F.col("_metadata.row_index").alias("_row"))
    else:
        path = scratch_path(spark, f"millstone/source-{uuid.uuid4().hex[:12]}")
        (df.select("*", *piece, F.col("_metadata.file_block_start").alias("_at"))
         .write.option("maxRecordsPerFile", 0).parquet(path))
        x = spark.read.parquet(path)
        x = x.select("*", F.col("_metadata.row_index").alias("_row"))
    same = ["_file", "_at"]
    pieces = materialize(x.groupBy(*same).agg(F.min("_row").alias("_first"), F.count("*").alias("_n")), "pieces")
    base = running_sum(pieces, same, "_offset", weight=F.col("_n")).drop("_n")
    return x.join(base, same).withColumn("_id", F.col("_offset") + F.col("_row") - F.col("_first"))


def read_source(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    """A1: load a named source as ``(doc_id, source, text[, url])``.

    Fails if the text column is missing. A source without an id column is
    numbered in file order (``in_file_order``), before ``where`` is applied.
    """
    r = spark.read.format(spec.format)
    for k, v in spec.options.items():
        r = r.option(k, v)
    df = r.load(spec.path)
    cols = dict(spec.columns)
    if cols.get("text") not in df.columns:
        raise ValueError(f"source {spec.name}: text column {cols.get('text')!r} missing")
    has_id = "doc_id" in cols and (cols["doc_id"] in df.columns or not cols["doc_id"].isidentifier())
    if not has_id:
        df = in_file_order(spark, df, spec)
    if spec.where:
        df = df.where(spec.where)
    out = [(F.expr(cols["doc_id"]).cast("bigint") if has_id else F.col("_id")).alias("doc_id")]
    out.append(F.lit(spec.name).alias("source"))
    out.append(F.col(cols["text"]).cast("string").alias("text"))
    if "url" in cols:
        out.append(F.col(cols["url"]).cast("string").alias("url"))
    if spec.ends:
        out.append(F.coalesce(F.expr(spec.ends), F.lit(False)).alias("_end"))
    return df.select(*out)


def union_sources(*dfs: DataFrame) -> DataFrame:
    """A3: sources side by side as one table (``source`` column tells them apart)."""
    if not dfs:
        raise ValueError("no sources")
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def url_excluded(url: Column | str, substrings: list[str] = S.URL_EXCLUDE) -> Column:
    """True when the URL contains any of the substrings (case-sensitive)."""
    u = F.col(url) if isinstance(url, str) else url
    cond = F.lit(False)
    for s in substrings:
        cond = cond | u.contains(s)
    return cond


def exclude_urls(df: DataFrame, substrings: list[str] = S.URL_EXCLUDE, url_col: str = "url",
                 drop: bool = True) -> DataFrame:
    """Drop rows whose URL contains any listed substring, then drop the URL.

    A null URL contains nothing, so its row is kept."""
    out = df.where(~F.coalesce(url_excluded(url_col, substrings), F.lit(False)))
    return out.drop(url_col) if drop else out
