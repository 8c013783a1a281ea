"""Operator 13: embedding whitening by Chebyshev-filtered subspace iteration.

Entries c become integers x = floor(scale * c) + offset. With n vectors and their exact sums S the wanted components are the leading
eigenvectors of V = 1/n * sum of (x - S/n)(x - S/n)'. V is never formed: one pass over the vectors gives V Q for a
block Q of ``components`` and some guard vectors, as the sum of Xc'(Xc Q) over the tasks, rows centred before they are
multiplied (integers are centred by the integer part of the mean first, so nothing is lost to the offset).

1. A short Lanczos run bounds the spectrum from below; a Rayleigh-Ritz step on the start block gives its upper edge.
2. A filter of degree m damps the unwanted spectrum [low, edge]: Y(j+1) = 2 (V - centre)/half Y(j) - Y(j-1), one pass a degree.
   Degrees follow from the residuals still to be won, and are kept where double precision can tell the columns apart.
3. QR of the filtered block, Rayleigh-Ritz on it (one pass), and a new edge, its smallest Ritz value.
4. Certified when |V q - e q| <= ``TOLERANCE`` * e_1 for every wanted component; the residuals reached are returned as well.

With no more dimensions than block columns the block spans the space, and the first Rayleigh-Ritz step is exact.

Shape of the job: vectors are packed once into blocks of rows in the shared folder; a pass reads these,
every task returns one partial sum of dimensions x block columns, and partial sums are added
in a tree of tasks in the order of their labels (a repeated task gives the same sum). The driver holds matrices of dimensions x block columns
only. The result is a further pass with no shuffle.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries are left out, as are vectors of another length than
the most frequent one (of equally frequent ones the longest); null ids and repeated rows are rows like others; no rows give
no rows; directions without variance (under ``RANK`` of the largest eigenvalue, as for equal vectors or few rows) have null ``whitened`` and take no part in
``identity_error``; without any variance ``explained`` is 0; a ``deviation`` beyond 64 bits is null; |scale * c| must stay under 2^40.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millstone.llm.common import materialize, pick, prepare_session

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
BLOCK_ROWS = 4096       # vectors of a packed row
FOLD = 64               # partial sums added by a task
LANCZOS = 12            # passes for the lower end of the spectrum
TOLERANCE = 2e-14       # residual of a certified component, of the largest eigenvalue
ROUNDS = 40
SPREAD = 1e8            # largest ratio of damping between wanted columns in one filter
RANK = 1e-12
LIMIT = 1 << 63

_PACKED = "rows int, ids array<bigint>, x binary"
_PART = "label array<int>, part binary"
PART = pa.schema([("label", pa.list_(pa.int32())), ("part", pa.binary())])


def integer_vectors(vectors: DataFrame, vec_id: str, embedding: str, scale: int, offset: int) -> DataFrame:
    """(vec_id, x): the rows that take part, of one length."""
    v = pick(vectors, vec_id=vec_id, e=embedding).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("e").cast("array<double>").alias("e"))
    ok = (F.size("e") > 0) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(ok)
    most = v.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return v.where(F.size("e") == (most["d"] if most else 0)).select(
        "vec_id", F.transform("e", lambda x: F.floor(x * F.lit(float(scale))) + F.lit(offset)).alias("x"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a task in blocks of at most BLOCK_ROWS."""
    ids, parts, rows = [], [], 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array([rows], pa.int32()), pa.array([ids], pa.list_(pa.int64())),
                                           pa.array([np.concatenate(parts).tobytes()], pa.binary())], names=["rows", "ids", "x"])

    for b in batches:
        for k in range(0, b.num_rows, BLOCK_ROWS):
            s = b.slice(k, BLOCK_ROWS)
            if rows and rows + s.num_rows > BLOCK_ROWS:
                yield out()
                ids, parts, rows = [], [], 0
            ids += s.column(0).to_pylist()
            parts.append(s.column(1).flatten().to_numpy().astype("<i8"))
            rows += s.num_rows
    if rows:
        yield out()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray]]:
    for b in batches:
        for rows, ids, x in zip(*(b.column(i).to_pylist() for i in range(3))):
            yield ids, np.frombuffer(x, "<i8").reshape(rows, -1)


def tree_sum(table: DataFrame, part: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """Sum over all blocks of ``part(block)``, arrays of one shape and dtype ``kind``; None without blocks."""

    def first(batches):
        total = None
        for _, x in _blocks(batches):
            p = part(x)
            total = p if total is None else total + p
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([[TaskContext.get().partitionId()]], pa.list_(pa.int32())),
                                              pa.array([np.ascontiguousarray(total, kind).tobytes()], pa.binary())], schema=PART)

    def add(batches):
        got = sorted((tuple(label), p) for b in batches for label, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        if got:
            total = sum(np.frombuffer(p, kind) for _, p in got)
            yield pa.RecordBatch.from_arrays([pa.array([got[0][0]], pa.list_(pa.int32())), pa.array([total.tobytes()], pa.binary())], schema=PART)

    parts = table.mapInArrow(first, _PART)
    n = table.rdd.getNumPartitions()
    while n > 1:
        n = -(-n // FOLD)
        # by label, so that a sum always has the same terms
        parts = parts.repartition(n).mapInArrow(add, _PART) if n == 1 else (
            parts.withColumn("home", F.pmod(F.element_at("label", 1), F.lit(n))).repartition(n, "home").drop("home").mapInArrow(add, _PART))
    got = sorted((tuple(r["label"]), bytes(r["part"])) for r in parts.collect())
    return sum(np.frombuffer(p, kind) for _, p in got) if got else None


@dataclass
class Whitening:
    """A fitted whitening: exact sums, components as columns, their eigenvalues and how far they are certified."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    residuals: np.ndarray
    passes: int
    identity_error: float = 0.0

    @property
    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean as integer part and rest."""
        whole = [s // self.n for s in self.sums]
        return np.array(whole, np.int64), np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole)])

    @property
    def scales(self) -> np.ndarray:
        """1 / sqrt(e); NaN for directions without variance."""
        good = self.eigenvalues > RANK * max(self.eigenvalues.max(initial=0.0), 0.0)
        return np.where(good, 1 / np.sqrt(np.where(good, self.eigenvalues, 1.0)), np.nan)

    @property
    def explained(self) -> np.ndarray:
        return self.eigenvalues.clip(0) / self.trace if self.trace > 0 else np.zeros(len(self.eigenvalues))


def _centred(x: np.ndarray, centre: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return (x - centre[0]).astype(np.float64) - centre[1]


def _filter_plan(ritz: np.ndarray, k: int, low: float, worst: float) -> tuple[float, float, int]:
    """Centre, half width and degree of the filter for the Ritz values of a block."""
    edge = float(ritz[-1])
    half = max((edge - low) / 2, 1e-6 * abs(float(ritz[0])))
    centre = edge - half
    growth = lambda e: math.acosh(max((e - centre) / half, 1 + 1e-9))
    slow, fast = growth(float(ritz[k - 1])), growth(float(ritz[0]))
    want = math.log(max(worst / TOLERANCE, 10.0) * 4) / max(slow, 1e-3)
    most = math.log(SPREAD) / max(fast - slow, 1e-3)
    return centre, half, int(min(max(min(want, most), 2), 32))


def fit(table: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Leading components of a packed table (see ``packed``); None without rows."""
    first = tree_sum(table, lambda x: np.append(x.sum(0), len(x)), "<i8")
    if first is None:
        return None
    sums, n = [int(s) for s in first[:-1]], int(first[-1])
    d = len(sums)
    k = min(components, d)
    width = min(d, k + max(8, k // 2))
    model = Whitening(n, sums, np.zeros((d, k)), np.zeros(k), 0.0, np.zeros(k), 1)
    centre = model.centre

    def times(q: np.ndarray) -> np.ndarray:
        """V q by one pass."""
        def part(x):
            c = _centred(x, centre)
            return c.T @ (c @ q)
        model.passes += 1
        return tree_sum(table, part, "<f8").reshape(d, -1) / n

    def rayleigh_ritz(q):
        y = times(q)
        h = q.T @ y
        e, u = np.linalg.eigh((h + h.T) / 2)
        e, u = e[::-1], u[:, ::-1]
        return q @ u, y @ u, e

    model.trace = float(tree_sum(table, lambda x: np.array([(_centred(x, centre) ** 2).sum()]), "<f8")[0]) / n
    model.passes += 1
    rnd = np.random.default_rng(7)
    q, y, e = rayleigh_ritz(np.linalg.qr(rnd.standard_normal((d, width)))[0] if width < d else np.eye(d))
    if width < d and model.trace > 0:
        low = _lowest(times, rnd.standard_normal(d))
        for _ in range(ROUNDS):
            r = np.sqrt(((y - q * e) ** 2).sum(0))[:k] / e[0]
            if r.max() <= TOLERANCE:
                break
            low = min(low, max(float(e[-1]), 0.0))
            mid, half, degree = _filter_plan(e, k, low, float(r.max()))
            a, b = q, (y - mid * q) / half
            for _ in range(degree - 1):
                a, b = b, 2 * (times(b) - mid * b) / half - a
                grown = np.sqrt((b ** 2).sum(0))
                a, b = a / grown, b / grown
            # columns stay in the order of their Ritz values: QR takes the stronger ones out of the weaker
            best, at = r.max(), (q, y, e)
            q, y, e = rayleigh_ritz(np.linalg.qr(b)[0])
            now = (np.sqrt(((y - q * e) ** 2).sum(0))[:k] / e[0]).max()
            if now > best / 2 and best < 1e-12:  # as far as rounding lets it go
                if now > best:
                    q, y, e = at
                break
    e = e.clip(0)
    model.residuals = np.sqrt(((y - q * e) ** 2).sum(0))[:k] / max(e[0], 1e-300)
    sign = np.where(q[np.abs(q).argmax(0), np.arange(q.shape[1])] < 0, -1.0, 1.0)
    model.components, model.eigenvalues = (q * sign)[:, :k], e[:k]
    return model


def _lowest(times, v: np.ndarray) -> float:
    """Lower end of the spectrum by a short Lanczos run: smallest Ritz value less its residual, at least 0."""
    v = v / np.linalg.norm(v)
    basis, alpha, beta = [v], [], []
    for _ in range(min(LANCZOS, len(v))):
        w = times(basis[-1][:, None])[:, 0]
        alpha.append(float(w @ basis[-1]))
        for b in basis + basis:
            w = w - (w @ b) * b
        beta.append(float(np.linalg.norm(w)))
        if beta[-1] <= 1e-12 * abs(alpha[0]):
            break
        basis.append(w / beta[-1])
    off = beta[:len(alpha) - 1]
    e, u = np.linalg.eigh(np.diag(alpha) + np.diag(off, 1) + np.diag(off, -1))
    return max(float(e[0]) - beta[-1] * abs(float(u[-1, 0])), 0.0)


def packed(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """The rows that take part, as a written table of blocks."""
    return materialize(integer_vectors(vectors, vec_id, embedding, scale, offset).mapInArrow(_pack, _PACKED), "whitening-rows")


def _transform(model: Whitening):
    centre, matrix = model.centre, model.components * np.nan_to_num(model.scales)
    none, n, sums = np.isnan(model.scales), model.n, model.sums
    k = matrix.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches):
            w = _centred(x, centre) @ matrix
            values = pa.array(w.ravel(), mask=np.broadcast_to(none, w.shape).ravel())
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(_deviations(x, n, sums), pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * k), values)], names=["vec_id", "deviation", "w"])
    return run


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None] | np.ndarray:
    """Sum of (n x - S)^2 of every row, exact."""
    reach = max(max(abs(n * int(a) - s), abs(n * int(b) - s)) for a, b, s in zip(x.min(0), x.max(0), sums))
    if reach * reach * len(sums) < LIMIT:  # n x - S itself is small; its two parts may pass through 64 bits
        d = x * np.int64(n) - np.array(sums, np.int64)
        return (d * d).sum(1)
    got = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return [v if v < LIMIT else None for v in got]


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS,
           scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, residual) of every row and component."""
    spark = vectors.sparkSession
    prepare_session(spark)
    table = packed(vectors, vec_id, embedding, scale, offset)
    model = fit(table, components)
    if model is None:
        return spark.createDataFrame([], "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, "
                                         "identity_error double, residual double")
    centre, good = model.centre, ~np.isnan(model.scales)
    matrix = (model.components * model.scales)[:, good]
    if good.any():
        def moments(x):
            w = _centred(x, centre) @ matrix
            return np.vstack([w.T @ w, w.sum(0)])
        m = tree_sum(table, moments, "<f8").reshape(-1, matrix.shape[1]) / model.n
        model.identity_error = float(np.abs(m[:-1] - np.outer(m[-1], m[-1]) - np.eye(len(m) - 1)).max())
    doubles = lambda a: F.array(*[F.lit(float(v)) for v in a])
    out = table.mapInArrow(_transform(model), "vec_id bigint, deviation bigint, w array<double>")
    out = out.select("vec_id", "deviation", F.posexplode("w").alias("place", "whitened"))
    return out.select("vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened",
                      doubles(model.explained)[F.col("place")].alias("explained"), F.lit(model.identity_error).alias("identity_error"),
                      doubles(model.residuals)[F.col("place")].alias("residual"))
