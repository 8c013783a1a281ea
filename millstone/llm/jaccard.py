"""Operator 6: n-gram Jaccard join with Bayesian candidate pruning.

Documents are compared as sets of five-word shingles; a link is a pair with Jaccard
similarity of at least ``THRESHOLD``. Result: one row per document with the id of its class
(connected component of links) and its number of links.

1. Equal sets collapse: every further step works on distinct sets, so exact copies never form pairs.
2. Banding of the MinHash values (``BANDS`` x ``ROWS``) makes candidates. A pair at the threshold shares no
   band with probability (1 - 0.8^5)^40 = 1.3e-7. Bucket members are linked to the
   bucket's smallest set only (linear); components of these links are the candidate groups.
3. Groups are compared in blocks of at most ``BLOCK`` sets: small groups share tasks, a larger
   group is cut into blocks and each pair of blocks is a task of its own; so a task is
   bounded, and pairs exist only inside a task, never as rows.
4. In a task, pairs are compared MinHash by MinHash, ``STEP`` values at a time: with m agreements of n and a uniform
   prior, a pair is dropped when the posterior probability of reaching the threshold,
   P(Binomial(n + 1, t) <= m), falls below ``TOLERANCE``. The rest is verified exactly.
5. A task returns the link count of each set and a spanning forest of its links; components of the forests
   are the classes.

Defined results: null and empty texts have no shingles and no links, each is its own class; a
text of one to four words is one shingle; words are runs without white space, compared as they are;
class ids are the smallest doc_id of the class (null when all its ids are null); repeated rows link like
copies. Shingles are compared by 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millstone.llm.common import flat, materialize, mix64, n_buckets, pick, prepare_session

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 40, 5
STEP = 20
TOLERANCE = 1e-9
BLOCK = 512
SETS_PER_TASK = 1000
HUBS, HUB_EDGES, SALTS = 200, 1000, 32
SEEN = 500_000  # sets a task remembers to have sent
_RNG = np.random.default_rng(20240613)
_MUL = (_RNG.integers(1, 1 << 31, BANDS * ROWS, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_ADD = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)


def shingle_hashes(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles."""
    w = text.split()
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(" ".join(w).encode("utf-8", "surrogatepass"))], np.uint64)
    seen: dict[str, int] = {}
    at = np.fromiter((seen.setdefault(x, len(seen)) for x in w), np.int64, len(w))
    h = np.fromiter((xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in seen), np.uint64, len(seen))[at]
    out = np.zeros(len(w) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):  # order-sensitive: mixed after every word
        out = mix64(out + h[k:len(w) - SHINGLE + 1 + k])
    return np.unique(out)


def minhash(s: np.ndarray) -> np.ndarray:
    """MinHash values of a set of hashes, uint32; long sets in slices."""
    x = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    best = np.full(len(_MUL), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        h = x[i:i + 1024, None] * _MUL + _ADD
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(12)
        np.minimum(best, h.min(0), out=best)
    return best


def band_keys(m: np.ndarray) -> np.ndarray:
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        out = mix64(out + m[k::ROWS].astype(np.uint64))
    return out.view(np.int64)


def least_agreement(threshold: float, tolerance: float) -> np.ndarray:
    """For n = STEP, 2 STEP, ...: the fewest agreements with posterior P(J >= t) of at least the tolerance."""
    out = []
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        p = [comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m) for m in range(n + 2)]
        out.append(int(np.searchsorted(np.cumsum(p), tolerance)))
    return np.array(out)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document; the bands and the text only at a task's first document of a set."""
    z, seen = zstandard.ZstdCompressor(level=3), set()
    for b in batches:
        ids, sets, bands, packed = [], [], [], []
        for doc_id, text in flat([b]):
            s = shingle_hashes(text)
            key = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
            new = key is not None and key not in seen
            if len(seen) >= SEEN:
                seen.clear()  # a set sent twice is dropped when sets are made distinct
            seen.add(key)
            ids.append(doc_id)
            sets.append(key)
            bands.append(band_keys(minhash(s)) if new else None)
            packed.append(z.compress(text.encode("utf-8", "surrogatepass")) if new else None)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
                                          pa.array(packed, pa.binary())], names=["doc_id", "set_id", "bands", "text"])


def components(edges: DataFrame, name: str, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): connected components, root the smallest node. Alternating
    large-star and small-star steps; each is a partial minimum and a join, and
    is written out, so that no lineage builds up. The edges of a node with very many of them
    are joined in ``SALTS`` parts."""
    e = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), name)
    mark = _fingerprint(e)
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _with_lowest(both.where("v > u"), low, _hubs(e, mark[0])).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                 .unionAll(low.select("u", F.col("m").alias("v"))).distinct())
        e = materialize(small, name)
        before, mark = mark, _fingerprint(e)
        if mark == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _hubs(e: DataFrame, n_edges: int) -> list[int]:
    """Nodes that are the smaller end of more than one in ``HUBS`` of all edges (and of ``HUB_EDGES``): at most HUBS of them."""
    many = e.groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") > max(HUB_EDGES, n_edges // HUBS))
    return sorted(r["v"] for r in many.select("v").collect())


def _with_lowest(edges: DataFrame, low: DataFrame, hubs: list[int]) -> DataFrame:
    """Edges (u, v) with the m of their u. Edges of hubs are dealt into parts, their rows of ``low`` copied to each."""
    if not hubs:
        return edges.join(low, "u")
    dealt = edges.withColumn("part", F.when(F.col("u").isin(hubs), F.pmod(F.xxhash64("v"), F.lit(SALTS))).otherwise(0).cast("int"))
    parts = F.when(F.col("w").isin(hubs), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copies = low.select(F.col("u").alias("w"), "m").select("w", "m", F.explode(parts).alias("p"))
    return dealt.join(copies, (F.col("u") == F.col("w")) & (F.col("part") == F.col("p"))).select("u", "v", "m")


def _fingerprint(e: DataFrame) -> tuple:
    """Count and hash sum of an edge table: equal when nothing changed."""
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


class _Sets:
    """Sets of a task with dense shingle numbers and MinHash values."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        _, at = np.unique(np.concatenate(sets), return_inverse=True)
        self.starts = np.cumsum(self.size) - self.size
        self.ids, self.n_ids = at, int(at.max()) + 1
        self.sketch = np.stack([minhash(s) for s in sets])

    def links(self, i: int, other: np.ndarray, least: np.ndarray, threshold: float) -> np.ndarray:
        """Members of ``other`` linked to set ``i``: pruned by posterior, verified exactly."""
        agree = np.zeros(len(other), np.int64)
        for k, need in enumerate(least):
            cols = slice(k * STEP, (k + 1) * STEP)
            agree += (self.sketch[other, cols] == self.sketch[i, cols]).sum(1)
            keep = agree >= need
            other, agree = other[keep], agree[keep]
            if not len(other):
                return other
        mark = np.zeros(self.n_ids, bool)
        mark[self.ids[self.starts[i]:self.starts[i] + self.size[i]]] = True
        common = np.array([mark[self.ids[self.starts[j]:self.starts[j] + self.size[j]]].sum() for j in other])
        return other[common >= threshold * (common * -1 + self.size[i] + self.size[other]) - 1e-9]


def _forest(n: int):
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(a: int, b: int) -> bool:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
        return a != b

    return join


_TASK_OUT = "rep bigint, links bigint, other bigint"


def _compare(threshold: float, tolerance: float):
    least = least_agreement(threshold, tolerance)

    def run(table: pa.Table) -> pa.Table:
        """Groups of one task: (rep, links) counts and forest edges (rep, 0, other)."""
        cols = {n: table.column(n).to_pylist() for n in ("root", "rep", "copies", "part", "text")}
        groups: dict[int, list[int]] = {}
        for i, r in enumerate(cols["root"]):
            groups.setdefault(r, []).append(i)
        rep, links, other = [], [], []
        inflate = zstandard.ZstdDecompressor().decompress
        for rows in groups.values():
            sets = _Sets([shingle_hashes(inflate(cols["text"][i]).decode("utf-8", "surrogatepass")) for i in rows])
            copies = np.array([cols["copies"][i] for i in rows], np.int64)
            part = np.array([cols["part"][i] for i in rows])
            join, count = _forest(len(rows)), np.zeros(len(rows), np.int64)
            two = part.max() > 0  # a pair of blocks: only pairs across them
            for i in range(len(rows)):
                later = np.arange(i + 1, len(rows))
                got = sets.links(i, later[part[later] != part[i]] if two else later, least, threshold)
                count[i] += copies[got].sum()
                count[got] += copies[i]
                for j in got:
                    if join(i, int(j)):
                        rep.append(cols["rep"][rows[i]])
                        links.append(0)
                        other.append(cols["rep"][rows[int(j)]])
            for i in np.flatnonzero(count):
                rep.append(cols["rep"][rows[i]])
                links.append(int(count[i]))
                other.append(None)
        return pa.table({"rep": pa.array(rep, pa.int64()), "links": pa.array(links, pa.int64()), "other": pa.array(other, pa.int64())})
    return run


def similar_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
                    tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """(doc_id, set_id, class_id, n_links), one row per input row."""
    spark = docs.sparkSession
    prepare_session(spark)
    d = pick(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    base = materialize(d.mapInArrow(_sketch, "doc_id bigint, set_id binary, bands array<bigint>, text binary"), "sim-sketch")
    # distinct sets, numbered by a hash of the set
    number = F.xxhash64("set_id")
    sets = materialize(base.where("set_id IS NOT NULL").groupBy("set_id").agg(
        F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.first("bands", ignorenulls=True).alias("bands")).withColumn("num", number), "sim-sets")
    banded = sets.select("num", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("num").alias("low"), F.max("num").alias("high")).where("low < high").select("band", "low")
    near = banded.join(shared, "band").select(F.col("num").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
    groups = components(near, "sim-groups")
    sizes = groups.groupBy("root").agg(F.count("*").alias("size"))
    member = materialize(groups.join(sizes, "root"), "sim-members").withColumnRenamed("node", "num")

    # one text per distinct set of a candidate group; a task has sent each set once
    want = member.join(sets.select("num", "set_id", "copies"), "num")
    t = (base.where("text IS NOT NULL").select("set_id", "text").join(want, "set_id")
         .select("root", "size", F.col("num").alias("rep"), "copies", "text").dropDuplicates(["rep"]))

    tasks = n_buckets(spark, member.count(), SETS_PER_TASK)
    blocks = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    t = t.withColumn("n", blocks).withColumn("own", own)
    small = t.where("n = 1").select(F.concat(F.lit("s"), F.pmod(F.xxhash64("root"), F.lit(tasks)).cast("string")).alias("task"),
                                    "root", "rep", "copies", F.lit(0).alias("part"), "text")
    big = t.where("n > 1").select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("with"))
    lo, hi = F.least("own", "with"), F.greatest("own", "with")
    big = big.select(F.concat_ws("-", F.lit("b"), F.col("root").cast("string"), lo.cast("string"), hi.cast("string")).alias("task"),
                     "root", "rep", "copies", F.when(F.col("own") == F.col("with"), 0).when(F.col("own") == lo, 1).otherwise(2).alias("part"), "text")
    got = materialize(small.unionAll(big).groupBy("task").applyInArrow(_compare(threshold, tolerance), _TASK_OUT), "sim-links")

    counts = got.where("other IS NULL").groupBy(F.col("rep").alias("num")).agg(F.sum("links").alias("links"))
    classes = components(got.where("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b")), "sim-classes")
    ids = sets.join(classes, sets["num"] == classes["node"], "left").join(counts, "num", "left").select(
        "set_id", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("root", "num").alias("root"))
    low = ids.groupBy("root").agg(F.min("first").alias("class"))
    ids = ids.join(low, "root").select(F.col("set_id").alias("s"), "links", "class")
    out = base.select("doc_id", "set_id").join(ids, F.col("set_id") == F.col("s"), "left")
    return out.select("doc_id", "set_id", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("class")).alias("class_id"),
                      F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"))
