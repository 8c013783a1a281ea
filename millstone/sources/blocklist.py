"""C1 for long lists: URLs that contain any of many patterns.

A chain of ``contains`` compares every URL with every pattern. Here a pattern is found by one of its q-grams: the one
that is rarest in URLs becomes its key (a pattern shorter than ``q`` is its own key), the distinct URLs are cut into their q-grams, an equi-join
brings a URL together with the patterns whose key it holds, and only these are compared. A plan of one join for a list of any
length; the keys are broadcast when adaptive execution finds them small enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millstone.session import materialize

Q = 5
RARITY_SAMPLE = 100_000  # URLs whose q-grams are counted; decides which key a pattern takes, never what matches


def grams(text: Column, n: int) -> Column:
    """Distinct substrings of ``n`` characters; none for a shorter text."""
    starts = F.sequence(F.lit(1), F.length(text) - n + 1)
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(n))))).otherwise(
        F.array().cast("array<string>"))


def pattern_keys(patterns: DataFrame, urls: DataFrame, q: int = Q) -> DataFrame:
    """(pattern, key): every pattern with its rarest q-gram."""
    p = F.col("pattern")
    own = F.when(F.length(p) < q, F.array(p)).otherwise(grams(p, q))
    some = urls.limit(RARITY_SAMPLE).select(F.explode(grams(F.col("url"), q)).alias("g")).groupBy("g").agg(F.count("*").alias("n"))
    cut = patterns.select("pattern", F.explode(own).alias("key"))
    rated = cut.join(some, cut["key"] == some["g"], "left")
    return rated.groupBy("pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("k")).select("pattern", "k.key")


def matching_urls(urls: DataFrame, patterns: DataFrame, q: int = Q) -> DataFrame:
    """The distinct ``url`` of ``urls`` that contain some ``pattern`` of ``patterns`` (case-sensitive). Nulls match nothing,
    the empty pattern is in every URL."""
    pats = materialize(patterns.select("pattern").where("pattern IS NOT NULL").distinct(), "patterns")
    urls = urls.select("url").where("url IS NOT NULL").distinct()
    sizes = sorted(r[0] for r in pats.select(F.least(F.length("pattern"), F.lit(q))).distinct().collect())  # at most q + 1 values
    if 0 in sizes:
        return urls
    if not sizes:
        return urls.limit(0)
    pieces = urls.select("url", F.explode(F.concat(*[grams(F.col("url"), n) for n in sizes])).alias("piece"))
    keys = pattern_keys(pats, urls, q)
    return pieces.join(keys, pieces["piece"] == keys["key"]).where(F.col("url").contains(F.col("pattern"))).select("url").distinct()


def exclude_listed(df: DataFrame, patterns: DataFrame, url_col: str = "url", pattern_col: str = "pattern", drop: bool = True,
                   q: int = Q) -> DataFrame:
    """Drop rows whose URL contains any pattern of a table, then drop the URL. A null URL contains nothing."""
    hits = matching_urls(df.select(F.col(f"`{url_col}`").alias("url")), patterns.select(F.col(f"`{pattern_col}`").alias("pattern")), q)
    out = df.join(hits, df[url_col] == hits["url"], "left_anti")
    return out.drop(url_col) if drop else out
