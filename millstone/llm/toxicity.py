"""Operator 4: class-conditional Kneser-Ney models.

Two models, one of toxic and one of ordinary text, differ only where the sample says so. Both rest on counts that they share:

    shared words  P(w)      continuation counts of both classes (distinct words before w), plus one half
    class words   P_c(w)    = (n_c(w) - D - EXCESS * N_c (n_o(w) + 1/2) / N_o)+ / N_c + g_c P(w)
                              n_c(w), N_c: continuation counts of class c and their sum; o: the other class
    class pairs   P_c(w|v)  = (c(vw) - D)+ / c(v) + g(v) P_c(w)        c: token counts of both classes; D = 1 where c(vw) = 1

g are the weights that make each a distribution. The discounts D of every order follow from its counts of counts (one each for counts of 1, 2, and 3 or
more). Of its words a class keeps what goes beyond the discount and beyond a multiple of the other class's share; the rest falls
back on the shared counts, so a rare expression, or one that is frequent in both, says nothing about the class. Counts of pairs are shared
altogether: pairs seen often say what follows in either class, other pairs leave it to the class's words. (Pairs counted by class were tried:
passages that are copied over and over then decide; held out on the check table, the area under the curve fell from 0.997 to 0.83.)

A text's evidence is the difference of its two log-likelihoods by these bigram models, length-normalised over the whole text.
The score is a logistic curve of it (rising, so the order of scores is that of the evidence), fitted on texts scored by a model that did
not see them (two folds); the curve carries the label frequency as its prior.

Fitting uses a bounded sample of labelled rows: by hash order at most ``PER_CLASS`` documents and ``CLASS_BYTES`` of text of
each class, so the model has a size bound. All words and pairs of the sample count, however rare; they are held by 64-bit keys in
sorted arrays, never as strings. The arrays reach the executors as files; the workers of an executor map the same one.
Scoring reads every document once, whole, with no shuffle. Only the text is
an input of a score.

Defined results: null text is empty; an empty text has no evidence, so it gets what the curve gives a text of length zero;
labels other than 0 and 1 are ignored, a document with both labels counts as toxic, as does a text that has both;
with either class unlabelled every score is 0; a document longer than the rest of the byte bound is left out of the sample; repeated rows and null ids
are scored row by row (a null id counts as id text '' for the split).
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pandas.util import hash_array
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millstone.llm.common import arrow_rows, flat, materialize, mix64, pack_ints, pack_sorted, pick, prepare_session, unpack_ints, unpack_sorted

PER_CLASS = 4000
CLASS_BYTES = 16_000_000
EXCESS = 6.0
FOLDS, HELD_OUT = 5, 0
CELLS = ["c0", "c1", "c2", "c3"]
BEGIN_KEY = hash_array(np.array(["\x02"], dtype=object), categorize=False)
RIDGE = 1e-2
_find = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:['’][\p{L}\p{M}]+)*").findall


def tokens(text: str) -> list[str]:
    return _find(text.lower())


def held_out_of(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD_OUT


def labelled_sample(labels: DataFrame, per_class: int, doc_id: str = "doc_id", toxic: str = "toxic") -> tuple[DataFrame, dict]:
    """(doc_id, toxic, fold, order) of at most ``per_class`` training documents of each class, and the class counts."""
    lab = pick(labels, doc_id=doc_id, toxic=toxic).where("toxic IN (0, 1) AND doc_id IS NOT NULL")
    lab = lab.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != HELD_OUT)
    lab = lab.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    many = {r["toxic"]: r["count"] for r in lab.groupBy("toxic").count().collect()}
    order = F.xxhash64("doc_id")
    one = [lab.where(F.col("toxic") == c).orderBy(order, "doc_id").limit(per_class) for c in (0, 1)]
    fold = F.crc32(F.concat(F.lit("fold"), F.col("doc_id").cast("string")).cast("binary")) % 2
    return one[0].unionAll(one[1]).withColumn("fold", fold.cast("int")).withColumn("order", order), many


def word_keys(words: list[str]) -> np.ndarray:
    """64-bit keys of words, the same in every process."""
    return hash_array(np.array(words, dtype=object), categorize=False) if words else np.zeros(0, np.uint64)


def pair_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix64(v) + w


def _spelled(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the words of a text, and of the words before them."""
    w = word_keys(tokens(text))
    return np.concatenate([BEGIN_KEY, w[:-1]]) if len(w) else w, w


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, w, c0..c3): pair counts of a task by word keys; the cell is 2 * fold + class."""
    held: list[tuple] = []
    size = 0

    def out():
        v, w, cell = (np.concatenate(c) for c in zip(*held))
        held.clear()
        _, first, which = np.unique(pair_keys(v, w), return_index=True, return_inverse=True)
        n = np.bincount(4 * which + cell, minlength=4 * len(first)).reshape(-1, 4)
        return pa.RecordBatch.from_arrays([pa.array(v[first].view(np.int64)), pa.array(w[first].view(np.int64)),
                                           *[pa.array(n[:, c].astype(np.int64)) for c in range(4)]],
                                          names=["v", "w", *CELLS])

    for batch in batches:
        for text, c, f in zip(*(batch.column(i).to_pylist() for i in range(3))):
            v, w = _spelled(text or "")
            held.append((v, w, np.full(len(w), 2 * f + c)))
            size += len(w)
            if size > 1_000_000:
                yield out()
                size = 0
    if held:
        yield out()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pair counts of a task as one row of packed columns."""
    parts = [[b.column(i).to_numpy() for i in range(6)] for b in batches]
    if parts:
        v, w, *n = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(v.view(np.uint64))
        yield arrow_rows(PACKED, [(pack_sorted(v.view(np.uint64)[order]), w[order].tobytes(), *[pack_ints(c[order]) for c in n])])


PACKED = pa.schema([("v", pa.binary()), ("w", pa.binary()), *[(c, pa.binary()) for c in CELLS]])


def discounts(counts: np.ndarray) -> np.ndarray:
    """Discounts of counts of 0, 1, 2, and 3 or more, from the counts of counts."""
    n = [int((counts == i).sum()) for i in (1, 2, 3, 4)]
    out = [0.0]
    for i in (1, 2, 3):  # a value that does not occur takes the discount of the one before
        y = n[0] / max(n[0] + 2 * n[1], 1)
        out.append(min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.0), i) if n[i - 1] else out[-1])
    return np.array(out)


def _left(counts: np.ndarray) -> np.ndarray:
    """Counts less their discount."""
    return np.maximum(counts - discounts(counts)[np.minimum(counts, 3)], 0)


class Counts:
    """Counts of the sample: sorted keys of ``words`` (the first word's context among them) and of the pairs; per pair the numbers of its words
    and its counts by cell (2 * fold + class)."""

    def __init__(self, v: np.ndarray, w: np.ndarray, pair_counts: np.ndarray):
        self.words = np.unique(np.concatenate([w, BEGIN_KEY]))
        self.keys = pair_keys(v, w)
        order = np.argsort(self.keys)
        self.keys, self.pair_counts = self.keys[order], pair_counts[order]
        self.v, self.w = (np.searchsorted(self.words, a[order]).astype(np.int32) for a in (v, w))

    def model(self, folds: tuple[int, ...] = (0, 1)) -> "Model":
        """Differences between the class models of these folds."""
        n, v, w = len(self.words), self.v, self.w
        pairs = [sum(self.pair_counts[:, 2 * f + k] for f in folds) for k in (0, 1)]
        cont = [np.bincount(w[c > 0], minlength=n) for c in pairs]
        both = pairs[0] + pairs[1]
        context = np.bincount(v, both, n)
        shared = np.append(np.bincount(w[both > 0], minlength=n), 0) + 0.5
        shared = shared / shared.sum()
        # a pair seen once says nothing, or the documents of the sample would be told apart by their own pairs
        top = np.where(both == 1, 0, _left(both)) / np.maximum(context, 1)[v]
        rest = 1 - np.minimum(np.bincount(v, top, n), 1 - 1e-6)
        word, pair = np.zeros(n + 1), np.zeros(len(v))
        for k, sign in ((0, -1), (1, 1)):
            size, other = (max(int(cont[c].sum()), 1) for c in (k, 1 - k))
            own = np.maximum(_left(cont[k]) - EXCESS * size * (cont[1 - k] + 0.5) / other, 0) / size
            p = np.append(own, 0) + (1 - own.sum()) * shared
            word += sign * np.log(p)
            pair += sign * np.log(top + rest[v] * p[w])
        return Model(self.words, self.keys, word.astype(np.float32), pair.astype(np.float32))


def _number(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of ``x`` in sorted keys; their number stands for what is not there."""
    if not len(keys):
        return np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[at] == x, at, len(keys))


class Model:
    """Differences between the log-probabilities of the class models: of words (the last one is the unknown word), and of the pairs
    of the sample. Other pairs differ as their second word does."""

    PARTS = ("words", "keys", "word", "pair")

    def __init__(self, words: np.ndarray, keys: np.ndarray, word: np.ndarray, pair: np.ndarray):
        self.words, self.keys, self.word, self.pair = words, keys, word, pair

    def evidence(self, text: str) -> float:
        """Length-normalised difference of the log-likelihoods; 0 for a text without words."""
        v, w = _spelled(text)
        if not len(w):
            return 0.0
        p = self.word[_number(self.words, w)]
        pair = _number(self.keys, pair_keys(v, w))
        hit = pair < len(self.keys)
        p[hit] = self.pair[pair[hit]]
        return float(p.mean(dtype=np.float64))

    def publish(self, spark) -> str:
        """Hand the arrays to all executors, one file each; returns their common name."""
        name, folder = f"toxic-{uuid.uuid4().hex[:12]}", tempfile.mkdtemp(prefix="millstone-model-")
        for part in self.PARTS:
            np.save(os.path.join(folder, f"{name}-{part}.npy"), getattr(self, part))
            spark.sparkContext.addFile(os.path.join(folder, f"{name}-{part}.npy"))
        return name


_MAPPED: dict[str, Model] = {}


def _mapped(name: str) -> Model:
    """A published model: its files are mapped, not read, so the workers of an executor hold one copy."""
    if name not in _MAPPED:
        _MAPPED.clear()
        _MAPPED[name] = Model(*(np.load(SparkFiles.get(f"{name}-{part}.npy"), mmap_mode="r") for part in Model.PARTS))
    return _MAPPED[name]


class Curve:
    """A rising logistic curve of the evidence, on a scale that evens out its long tails."""

    def __init__(self, x: np.ndarray, y: np.ndarray, prior: float = 0.0):
        """Newton steps on at most 2 * PER_CLASS rows; ``prior`` is added to the log odds."""
        self.unit = max(float(np.median(np.abs(x))), 1e-9)
        a = np.column_stack([np.ones(len(x)), np.arcsinh(x / self.unit)])
        b = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
            h = (a * (p * (1 - p))[:, None]).T @ a + RIDGE * np.eye(2)
            step = np.linalg.solve(h, a.T @ (y - p) - RIDGE * b)
            b = b + step
            if np.abs(step).max() < 1e-8:
                break
        self.start, self.slope = float(b[0]) + prior, max(float(b[1]), 1e-6)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.start + self.slope * np.arcsinh(evidence / self.unit), -30, 30)))


def _evidence(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Evidence of the sample, each fold by the model of the other one."""
        for b in batches:
            text, y, fold = (b.column(i).to_pylist() for i in range(3))
            x = np.zeros(len(text))
            for f in (0, 1):
                mine = [i for i, g in enumerate(fold) if g == f]
                if mine:
                    x[mine] = [shared.value[1 - f].evidence(text[i] or "") for i in mine]
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y, pa.int32())], names=["x", "y"])
    return run


def _scores(fitted, text: list[str]) -> np.ndarray:
    if fitted is None or not len(text):
        return np.zeros(len(text))
    name, curve = fitted
    model = _mapped(name)
    return curve.score(np.array([model.evidence(t) for t in text]))


def _score(fitted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, text = zip(*flat([b])) if b.num_rows else ((), ())
            s = _scores(fitted, list(text))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([held_out_of(i) for i in ids], pa.bool_()),
                                              pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])
    return run


def score_column(fitted, text: str) -> Column:
    """Score of a text column under a fitted (published) model; 0 without one."""
    @F.pandas_udf("double")
    def score(t: pd.Series) -> pd.Series:
        return pd.Series(_scores(fitted, [x or "" for x in t]))

    return score(F.col(text))


def counted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic",
            per_class: int = PER_CLASS, class_bytes: int = CLASS_BYTES) -> tuple[Counts, DataFrame, dict] | None:
    """Counts of the bounded labelled sample, its rows (text, toxic, fold) and the class sizes, or None when a class has no document."""
    sample, many = labelled_sample(labels, per_class, doc_id, toxic)
    if len(many) < 2:
        return None
    d = pick(docs, d=doc_id, text=text)
    # the sample has at most 2 * per_class rows; equal texts count once
    rows = (d.join(F.broadcast(sample), F.col("d") == F.col("doc_id")).groupBy("text")
            .agg(F.max("toxic").alias("toxic"), F.min("fold").alias("fold"), F.min("order").alias("order")))
    # bytes up to a row, in hash order, over at most per_class small rows a class
    sizes = rows.select("toxic", "order", F.xxhash64("text").alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("toxic").orderBy("order", "h").rowsBetween(Window.unboundedPreceding, 0))
    # a document that alone is over the bound takes no room from the rest
    within = sizes.where(F.col("n") <= class_bytes).withColumn("upto", upto).where(F.col("upto") <= class_bytes).select("h", "n")
    rows = rows.join(F.broadcast(within.distinct()), (F.xxhash64("text") == F.col("h")) & (F.coalesce(F.octet_length("text"), F.lit(0)) == F.col("n")))
    rows = materialize(rows.select("text", "toxic", "fold"), "toxic-sample")
    got = rows.groupBy("toxic", "fold").count().collect()
    if len({r["toxic"] for r in got}) < 2:
        return None
    cells = rows.mapInArrow(_pairs, ", ".join(f"{c} bigint" for c in ("v", "w", *CELLS)))
    cells = cells.groupBy("v", "w").agg(*[F.sum(c).alias(c) for c in CELLS])
    packed = cells.mapInArrow(_packed, ", ".join(f"{f.name} binary" for f in PACKED)).collect()
    part = lambda unpack, c, kind: np.concatenate([unpack(bytes(r[c])).astype(kind) for r in packed] or [np.zeros(0, kind)])
    return Counts(part(unpack_sorted, "v", np.uint64), part(lambda b: np.frombuffer(b, np.uint64), "w", np.uint64),
                  np.column_stack([part(unpack_ints, c, np.int32) for c in CELLS])), rows, many


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic",
        per_class: int = PER_CLASS, class_bytes: int = CLASS_BYTES) -> tuple[str, Curve] | None:
    """(name of the published model, curve) from the bounded labelled sample, or None when a class has no document."""
    spark = docs.sparkSession
    got = counted(docs, labels, doc_id, text, toxic, per_class, class_bytes)
    if got is None:
        return None
    counts, rows, many = got
    halves = spark.sparkContext.broadcast([counts.model((f,)) for f in (0, 1)])  # bounded as the sample is, and gone afterwards
    x = rows.mapInArrow(_evidence(halves), "x double, y int").toPandas()
    halves.destroy()
    y = x["y"].to_numpy(np.float64)
    # the sample is balanced by its bound, the labels are not
    odds = lambda a, b: np.log(max(a, 1) / max(b, 1))
    prior = odds(many.get(1, 0), many.get(0, 0)) - odds(y.sum(), len(y) - y.sum())
    return counts.model().publish(spark), Curve(x["x"].to_numpy(), y, prior)


def toxicity_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    toxic: str = "toxic", per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    spark = docs.sparkSession
    prepare_session(spark)
    fitted = fit(docs, labels, doc_id, text, toxic, per_class)
    d = pick(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return d.mapInArrow(_score(fitted), "doc_id bigint, held_out boolean, score double, predicted int")
