"""Operator 5: benchmark decontamination by BM25 retrieval with block maxima.

Test items are cut into segments of at most ``SEGMENT`` words and indexed as an inverted
index with BM25 impacts, each segment's impacts divided by its own full score, so a
passage's score is the share of the segment's BM25 mass that it covers. Every passage
of every document (windows of ``SEGMENT`` + ``STRIDE`` words, one every ``STRIDE``) is a
query, and all segments scoring at least ``THRESHOLD`` are retrieved, exactly:

1. WAND bound: the sum of the largest impacts of the passage's distinct terms must reach the threshold;
2. block-max bound: the same with the maxima of blocks of segments leaves a few blocks;
3. only postings in those blocks are scored.

A retrieved segment is verified in the words around the passage: what is found there of its words of the question
(all but the last sentence) and of its words of the answer (the last sentence) must both reach ``OVERLAP``. Found is the
share of five-word shingles or, where that is too little, one less the word edits to the nearest place per word, so an
edited word costs itself and not the shingles over it. An item longer than a segment is cut into equal ones, and one of
them is enough.

Statistics are those of the whole benchmark: segments, their mean length and the document frequency of every term come from Spark
aggregates over all segments. The index is built in tasks, in shards of about ``SHARD`` segments that all use these statistics, so scores and
results do not depend on how items fall into shards. A shard reaches the executors as a file; a worker holds one shard
at a time (at most about 100 MB, if all of its words were different), whatever the size of the benchmark. Documents are read once, with no shuffle.

Defined results: null or empty texts match nothing; items without words are never found; an item with a null id is
found like any other and reported with a null id; an item of one
sentence has its last third of words as answer; a text of fewer than five words is one shingle; repeated items with
the same id are indexed each; repeated rows and null ids of documents are reported row by row.
"""

from __future__ import annotations

import os
import pickle
import tempfile
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millstone.llm.common import arrow_rows, chunk_label, flat, materialize, pick, prepare_session

SEGMENT, STRIDE = 96, 32
K1, B = 1.2, 0.75
THRESHOLD = 0.6
BLOCK, BLOCKS = 16, 64   # least segments of a block, most blocks of a shard
POSTINGS = 1 << 18       # postings scored at once, more only for a single passage
OVERLAP = 0.8
SHINGLE = 5
SHARD = 4_000

_words = regex.compile(r"[\p{L}\p{M}\p{N}]+").findall
_BLANKED = bytes(i if _words(chr(i)) else 32 for i in range(256))  # Latin-1 without what is no part of a word
_sentence = regex.compile(r"(?<=[.!?。！？])\s+|\n+").split
_OUT = "doc_id bigint, item_id bigint, n_passages bigint, score double, question_overlap double, answer_overlap double"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_passages", pa.int64()), ("score", pa.float64()),
                     ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])


def words(text: str) -> list[str]:
    text = text.lower()
    try:  # the same words by a table of bytes where the text has Latin-1 characters only
        return text.encode("latin-1").translate(_BLANKED).decode("latin-1").split()
    except UnicodeEncodeError:
        return _words(text)


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer."""
    parts = [w for s in _sentence(text) if (w := words(s))]
    if not parts:
        return [], []
    if len(parts) == 1:
        cut = len(parts[0]) - max(1, len(parts[0]) // 3)
        return parts[0][:cut], parts[0][cut:]
    return [w for s in parts[:-1] for w in s], parts[-1]


def shingles(w: list[str]) -> set:
    return {tuple(w[i:i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set()


def _found(want: set, at: list[str]) -> float:
    """Share of the shingles ``want`` found in the words ``at``; 1 when there are none."""
    if not want:
        return 1.0
    size = {len(x) for x in want}
    have = {tuple(at[i:i + n]) for n in size for i in range(len(at) - n + 1)}
    return len(want & have) / len(want)


def _edits(want: list[str], at: list[str]) -> int:
    """Least word edits (Myers' bit vectors) that make ``want`` a run of the words ``at``."""
    bits: dict[str, int] = {}
    for i, x in enumerate(want):
        bits[x] = bits.get(x, 0) | 1 << i
    full, last = (1 << len(want)) - 1, 1 << len(want) - 1
    up, down, now = full, 0, len(want)
    best = now
    for x in at:
        eq = bits.get(x, 0)
        d0 = (((eq & up) + up) ^ up | eq | down) & full
        more, less = down | ~(d0 | up) & full, up & d0
        now += 1 if more & last else -1 if less & last else 0
        best = min(best, now)
        more, less = more << 1 & full, less << 1 & full
        up, down = less | ~(d0 | more) & full, more & d0
    return best


def _overlap(want: list[str], at: list[str], enough: float) -> float:
    """Share of the words ``want`` found in the words ``at``; 1 when there are none."""
    share = _found(shingles(want), at)
    return share if share >= enough else max(share, 1 - _edits(want, at) / len(want))


def segments_of(text: str) -> list[tuple[list[str], list[str]]]:
    """(question words, answer words) of the equal segments that an item is cut into."""
    question, answer = question_answer(text)
    w, q = question + answer, len(question)
    many = -(-len(w) // SEGMENT)
    cuts = [j * len(w) // many for j in range(many + 1)] if many else []
    return [(w[a:min(b, q)], w[max(a, q):b]) for a, b in zip(cuts, cuts[1:])]


class Index:
    """Impact-ordered facts of segments: postings, block maxima, term maxima.

    ``segs`` are (item, item id, question words, answer words); ``stats`` are the number of segments, their mean length and the
    document frequency by term of the whole benchmark."""

    def __init__(self, segs: list[tuple], stats: tuple[int, float, dict[str, int]], block: int = BLOCK):
        total, mean, frequency = stats
        self.parts = [(q, a) for _, _, q, a in segs]
        number: dict = {}
        self.item_of = np.array([number.setdefault(item, len(number)) for item, _, _, _ in segs], np.int64)
        ids = dict(zip(self.item_of.tolist(), (i for _, i, _, _ in segs)))
        self.ids = [ids[k] for k in range(len(number))]
        segs = [(k, q + a) for k, (q, a) in enumerate(self.parts)]
        self.terms: dict[str, int] = {}
        seg, term, tf = [], [], []
        for s, (_, w) in enumerate(segs):
            count: dict[int, int] = {}
            for x in w:
                t = self.terms.setdefault(x, len(self.terms) + 1)  # 0: no term
                count[t] = count.get(t, 0) + 1
            seg += [s] * len(count)
            term += count
            tf += count.values()
        seg, term, tf = np.array(seg, np.int64), np.array(term, np.int64), np.array(tf, np.float64)
        size, n = np.array([len(w) for _, w in segs] or [1], np.float64), len(segs)
        df = np.array([total, *(frequency[x] for x in self.terms)], np.float64)
        idf = np.log1p((total - df + 0.5) / (df + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[seg] / mean)) if n else np.zeros(0)
        impact = impact / np.bincount(seg, impact, max(n, 1))[seg] if n else impact
        o = np.lexsort((seg, term))
        self.seg, self.impact = seg[o], impact[o]
        self.at = np.searchsorted(term[o], np.arange(len(self.terms) + 2))
        self.top = np.zeros(len(self.terms) + 1)
        np.maximum.at(self.top, term, impact)
        # blocks of segments, few enough for a dense table of maxima
        self.block = max(block, -(-n // BLOCKS))
        self.block_top = np.zeros((len(self.terms) + 1, n // self.block + 1), np.float32)
        np.maximum.at(self.block_top, (term, seg // self.block), impact)
        self.block_at = self.seg // self.block
        self.n = n

    def retrieve(self, terms: np.ndarray, good: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """(segment, score) of one passage, as ``scored``."""
        return [(seg, s) for _, seg, s in self.scored(terms[None], good[None], threshold)]

    def scored(self, terms: np.ndarray, good: np.ndarray, threshold: float) -> Iterator[tuple[int, int, float]]:
        """(passage, segment, score) of the segments in a passage's good blocks that score at least ``threshold`` against
        its distinct terms; ``terms`` and ``good`` have a row per passage, term 0 counts for nothing."""
        size = self.at[terms + 1] - self.at[terms]
        ends = np.cumsum(size.sum(1))
        a, most = 0, max(1, POSTINGS // self.n)
        while a < len(terms):
            # the passages of at most POSTINGS postings and scores together, one at least
            b = max(a + 1, min(a + most, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + POSTINGS, "right"))))
            many = size[a:b].ravel()
            p = np.arange(int(many.sum())) + np.repeat(self.at[terms[a:b]].ravel() - np.cumsum(many) + many, many)
            row = np.repeat(np.arange(b - a), size[a:b].sum(1))
            some = good[a:b][row, self.block_at[p]]
            p, row = p[some], row[some]
            s = np.bincount(row * self.n + self.seg[p], self.impact[p], (b - a) * self.n)
            for i in np.flatnonzero(s >= threshold - 1e-9).tolist():
                yield a + i // self.n, i % self.n, float(s[i])
            a = b

    def passages(self, t: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(start, distinct terms, good blocks) of one passage after another, as ``candidates``."""
        for starts, terms, good in self.candidates(t, threshold):
            yield from ((int(s), x[x > 0], g) for s, x, g in zip(starts, terms, good))

    def candidates(self, t: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(starts, distinct terms, good blocks), a row each per passage that passes the WAND and the block-max bound."""
        width = SEGMENT + STRIDE
        starts = np.arange(0, max(1, len(t) - SEGMENT + STRIDE - 1), STRIDE)
        c = np.concatenate([[0.0], np.cumsum(self.top[t])])
        starts = starts[c[np.minimum(starts + width, len(t))] - c[starts] >= threshold - 1e-6]
        if not len(starts):
            return
        pad = np.concatenate([t, np.zeros(width, t.dtype)])
        for i in range(0, len(starts), 256):
            m = np.sort(np.lib.stride_tricks.sliding_window_view(pad, width)[starts[i:i + 256]], 1)
            m[:, 1:][m[:, 1:] == m[:, :-1]] = 0
            some = np.flatnonzero(self.top[m].sum(1) >= threshold - 1e-9)
            good = self.block_top[m[some]].sum(1) >= threshold - 1e-4
            k = np.flatnonzero(good.any(1))
            yield starts[i + some[k]], m[some[k]], good[k]

    def matches(self, text: str, threshold: float, overlap: float) -> list[tuple]:
        """(item id, passages, best score, question overlap, answer overlap) verified in ``text``."""
        w = words(text)
        if not w or not self.n:
            return []
        t = np.fromiter(map(self.terms.get, w, repeat(0)), np.int64, len(w))
        hits: dict[int, dict[tuple[int, int], float]] = {}
        for starts, terms, good in self.candidates(t, threshold):
            for k, seg, score in self.scored(terms, good, threshold):
                hits.setdefault(int(self.item_of[seg]), {})[int(starts[k]), seg] = score
        out = []
        for k, at in sorted(hits.items()):
            best = (-1.0, 0.0, 0.0)
            for start, seg in at:
                question, answer = self.parts[seg]
                size = len(question) + len(answer)
                near = w[max(0, start - size):start + SEGMENT + STRIDE + size]
                q, a = _overlap(question, near, overlap), _overlap(answer, near, overlap)
                best = max(best, (min(q, a), q, a))
            if best[0] >= overlap:
                out.append((self.ids[k], len({start for start, _ in at}), round(max(at.values()), 9), best[1], best[2]))
        return out


SEGS = "item string, place int, item_id bigint, question array<string>, answer array<string>"
_SEGS = pa.schema([("item", pa.string()), ("place", pa.int32()), ("item_id", pa.int64()), ("question", pa.list_(pa.string())), ("answer", pa.list_(pa.string()))])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of a task's items; every row of the benchmark is an item of its own."""
    label, k = chunk_label(), 0
    for b in batches:
        rows = []
        for item_id, text in flat([b]):
            rows += [(f"{label}-{k}", j, item_id, q, a) for j, (q, a) in enumerate(segments_of(text))]
            k += 1
        yield arrow_rows(_SEGS, rows)


def _build(total: int, mean: float):
    def run(segs: pa.Table, terms: pa.Table) -> pa.Table:
        """One shard's index, pickled."""
        frequency = dict(zip(terms.column("term").to_pylist(), terms.column("df").to_pylist()))
        rows = sorted(zip(*(segs.column(c).to_pylist() for c in ("item", "place", "item_id", "question", "answer"))), key=lambda r: r[:2])
        index = Index([(item, i, q, a) for item, _, i, q, a in rows], (total, mean, frequency))
        return pa.table({"shard": segs.column("shard").slice(0, 1), "index": pa.array([pickle.dumps(index)], pa.binary())})
    return run


def publish(spark, items: DataFrame, item_id: str = "item_id", text: str = "text", shard: int = SHARD) -> list[str]:
    """Build the index of a benchmark and hand its shards to all executors, one file each; returns their names."""
    prepare_session(spark)
    it = pick(items, item_id=item_id, text=text).select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("text IS NOT NULL")
    segs = materialize(it.mapInArrow(_cut, SEGS), "benchmark-segments")
    total, mean = segs.agg(F.count("*"), F.avg(F.size("question") + F.size("answer"))).first()
    if not total:
        return []
    segs = segs.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(-(-total // shard))).cast("int"))
    term = segs.select("shard", F.explode(F.array_distinct(F.concat("question", "answer"))).alias("term"))
    df = term.groupBy("term").agg(F.count("*").alias("df"))
    used = term.distinct().join(df, "term").select(F.col("shard").alias("of"), "term", "df")
    built = segs.groupBy("shard").cogroup(used.groupBy("of")).applyInArrow(_build(total, mean), "shard int, index binary")
    names, folder = [], tempfile.mkdtemp(prefix="millstone-index-")
    for r in materialize(built, "benchmark-index").toLocalIterator():  # a shard at a time
        names.append(f"index-{uuid.uuid4().hex[:12]}")
        with open(os.path.join(folder, names[-1]), "wb") as f:
            f.write(r["index"])
        spark.sparkContext.addFile(os.path.join(folder, names[-1]))
    return names


_LOADED: dict[str, Index] = {}


def _shard(name: str) -> Index:
    """A published shard; the worker forgets the one before."""
    if name not in _LOADED:
        _LOADED.clear()
        with open(SparkFiles.get(name), "rb") as f:
            _LOADED[name] = pickle.load(f)
    return _LOADED[name]


def _match(names: list[str], threshold: float, overlap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in names:
                rows = [(doc_id, *m) for doc_id, text in flat([b]) for m in _shard(name).matches(text, threshold, overlap)]
                yield arrow_rows(_SCHEMA, rows)
    return run


def contaminated_column(spark, items: DataFrame, text: str, item_id: str = "item_id", item_text: str = "text",
                        threshold: float = THRESHOLD, overlap: float = OVERLAP, shard: int = SHARD) -> Column:
    """True where a text column holds a verified match."""
    names = publish(spark, items, item_id, item_text, shard)

    @F.pandas_udf("boolean")
    def match(t: pd.Series) -> pd.Series:
        out = np.zeros(len(t), bool)
        for name in names:
            for i in np.flatnonzero(~out):
                out[i] = bool(_shard(name).matches(t.iloc[i] or "", threshold, overlap))
        return pd.Series(out)

    return match(F.col(text))


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                 item_text: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, shard: int = SHARD) -> DataFrame:
    """(doc_id, item_id, n_passages, score, question_overlap, answer_overlap): verified matches only."""
    names = publish(docs.sparkSession, items, item_id, item_text, shard)
    d = pick(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return d.mapInArrow(_match(names, threshold, overlap), _OUT)
