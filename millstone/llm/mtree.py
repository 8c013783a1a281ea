"""Operator 9: exact top-k by inner product with paged M-trees.

Integer vectors (floor(1024 x)) are lifted to a metric space: with
L >= max |x|^2, the point (x, sqrt(L - |x|^2)) has squared distance
|q|^2 + L - 2 q.x to (q, 0), so the nearest points are the highest scores.

Every input task groups its vectors into M-trees of bounded size: leaf pages of
up to ``PAGE`` vectors and inner nodes up to ``FAN`` children; a node stores
its routing vector, covering radius and distance to the parent's routing
vector. A query walks the nodes best-first by the largest score they can
hold; a child is skipped without a distance computation when the parent's
distance and the stored parent distance already rule it out (triangle
inequality), and the walk ends when the best remaining bound is below the k-th score.
Scores are exact integers; bounds carry a margin for rounding.

Shape of the job: the trees are built once and written to the shared folder, a row per tree: its vectors in page order and the pages
of its nodes. Queries are a stated set (ids divisible by 100). They are dealt into blocks and trees into groups, both of bounded
size; a cell (group, block) is one cogrouped task that returns k rows per query, and a query's best k over
its cells is a partial top-k. The plan is the same for any number of queries and vectors, and only counts reach the driver.

Defined results: vectors that are null or hold null or non-finite components
take no part, as queries or candidates; empty vectors neither; a query only meets
vectors of its own length; a query's own row (same vec_id) is no candidate;
repeated rows with the same vec_id are candidates each; a null vec_id never takes part;
of several rows with a query's id the smallest vector asks; ties go to the smaller vec_id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millstone.llm.common import materialize, pick, prepare_session, shuffle_partitions

SCALE = 1024
K = 10
TREE = 8192          # vectors of one tree, in memory of a task
PAGE = 64            # vectors of a leaf page
FAN = 16             # children of an inner node
CELL_TREES = 8       # trees of a cell
QUERY_BLOCK = 2048   # queries of a cell, about

# the written form: vectors in page order, then a page entry per node in the order of ``children`` runs
VECTORS = {"ids": "<i8", "vecs": "<i8"}
PAGES = {"route": "<i4", "radius": "<f8", "to_parent": "<f8", "begin": "<i4", "end": "<i4", "child": "<i4", "children": "<i4"}
TREES = pa.schema([("tree", pa.string()), ("dim", pa.int32()), *[(c, pa.binary()) for c in (*VECTORS, *PAGES)]])
_TREES = "tree string, dim int, " + ", ".join(f"{c} binary" for c in (*VECTORS, *PAGES))
_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def build(x: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Page order of the lifted points ``x``, and the nodes of an M-tree over them, split around FAN routing points per level."""
    table: list[list] = []   # route, radius, to_parent, begin, end, child, children
    order: list[np.ndarray] = []

    def node(rows: np.ndarray, parent: np.ndarray | None) -> list:
        pts = x[rows]
        route = int(rows[int(np.argmin(((pts - pts.mean(0)) ** 2).sum(1)))])
        radius = float(np.sqrt(((pts - x[route]) ** 2).sum(1).max()))
        return [route, radius, float(np.sqrt(((x[route] - parent) ** 2).sum())) if parent is not None else 0.0, 0, 0, 0, 0]

    table.append(node(np.arange(len(x)), None))
    work, size = [(0, np.arange(len(x)))], 0
    while work:
        k, rows = work.pop()
        if len(rows) <= PAGE:
            table[k][3:5] = size, size + len(rows)
            order.append(rows)
            size += len(rows)
            continue
        pts = x[rows]
        pivots = pts[np.linspace(0, len(rows) - 1, FAN).astype(int)]
        near = ((pivots ** 2).sum(1)[None] - 2 * pts @ pivots.T).argmin(1)
        if table[k][1] == 0 or np.bincount(near).max() == len(rows):  # equal points: even pages
            near = np.arange(len(rows)) * FAN // len(rows)
        parts = [rows[near == p] for p in range(FAN) if (near == p).any()]
        table[k][5:7] = len(table), len(parts)
        for part in parts:
            work.append((len(table), part))
            table.append(node(part, x[table[k][0]]))
    place = np.concatenate(order)
    to = np.empty(len(place), np.int64)
    to[place] = np.arange(len(place))
    columns = list(zip(*table))
    columns[0] = to[np.array(columns[0])]
    return place, {c: np.array(v, t) for (c, t), v in zip(PAGES.items(), columns)}


class Tree:
    """One M-tree with its integer vectors and ids, in page order."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, pages: dict[str, np.ndarray] | None = None):
        norm = (vecs.astype(np.float64) ** 2).sum(1)
        self.lift = float(norm.max())
        lifted = np.column_stack([vecs.astype(np.float64), np.sqrt(self.lift - norm)])
        if pages is None:
            place, pages = build(lifted)
            ids, vecs, lifted = ids[place], vecs[place], lifted[place]
        self.ids, self.vecs, self.pages = ids, vecs, pages
        self.routes = lifted[pages["route"]]
        self.node = list(zip(*(pages[c].tolist() for c in PAGES)))

    def packed(self, name: str) -> tuple:
        return (name, self.vecs.shape[1], *[np.ascontiguousarray(a.astype(t)).tobytes() for a, t in zip((self.ids, self.vecs), VECTORS.values())],
                *[self.pages[c].tobytes() for c in PAGES])

    @staticmethod
    def unpacked(row: dict) -> "Tree":
        got = {c: np.frombuffer(row[c], t) for c, t in (VECTORS | PAGES).items()}
        return Tree(got["ids"], got["vecs"].reshape(-1, row["dim"]), {c: got[c] for c in PAGES})

    def search(self, query_id: int, q: np.ndarray, best: list, k: int) -> None:
        """Offer the tree's rows to ``best``, a heap of (score, -vec_id) with at most k rows."""
        point = np.append(q.astype(np.float64), 0.0)
        full = float(point @ point) + self.lift
        slack = 1e-6 * (1.0 + np.sqrt(full))
        node, routes = self.node, self.routes

        def highest(reach: float) -> float:
            """Largest score of a row at distance ``reach`` or more."""
            reach = max(0.0, reach - slack)
            return (full - reach * reach) / 2 + 0.5

        floor = lambda: best[0][0] if len(best) >= k else -np.inf
        d = float(np.sqrt(((routes[0] - point) ** 2).sum()))
        heap = [(-highest(d - node[0][1]), 0, d)]
        while heap:
            bound, n, d = heapq.heappop(heap)
            if -bound < floor():
                break
            _, _, _, begin, end, child, children = node[n]
            if not children:
                s, ids = self.vecs[begin:end] @ q, self.ids[begin:end]
                for i in np.flatnonzero((s >= floor()) & (ids != query_id)):
                    item = (int(s[i]), -int(ids[i]))
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
                continue
            # ruled out by the stored parent distance alone, or else by the distance itself
            left = [c for c in range(child, child + children) if highest(abs(d - node[c][2]) - node[c][1]) >= floor()]
            for c, dc in zip(left, np.sqrt(((routes[left] - point) ** 2).sum(1)).tolist() if left else ()):
                b = highest(dc - node[c][1])
                if b >= floor():
                    heapq.heappush(heap, (-b, c, dc))


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trees over the rows of a task, per vector length, at most TREE rows each."""
    held: dict[int, list] = {}
    task, made = TaskContext.get().partitionId(), 0

    def out(group: list) -> pa.RecordBatch:
        ids, vecs = zip(*group)
        row = Tree(np.array(ids, np.int64), np.array(vecs, np.int64)).packed(f"{task}-{made}")
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, TREES)], schema=TREES)

    for b in batches:
        for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            group = held.setdefault(len(row[1]), [])
            group.append(row)
            if len(group) == TREE:
                yield out(held.pop(len(row[1])))
                made += 1
    for group in held.values():
        yield out(group)
        made += 1


def _cell(k: int):
    def run(trees: pa.Table, queries: pa.Table) -> pa.Table:
        """Searches a block of queries in a group of trees."""
        asked = [(i, np.array(v, np.int64), []) for i, v in zip(queries.column("vec_id").to_pylist(), queries.column("v").to_pylist())]
        for t in range(trees.num_rows if asked else 0):
            tree = Tree.unpacked(trees.slice(t, 1).to_pylist()[0])
            for i, q, best in asked:
                if len(q) == tree.vecs.shape[1]:
                    tree.search(i, q, best, k)
        rows = [(i, -minus, score) for i, _, best in asked for score, minus in best]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 3, _OUT)], schema=_OUT)
    return run


def integer_vectors(vectors: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """(vec_id, v): the rows that take part, components as floor(scale * x)."""
    v = pick(vectors, vec_id=vec_id, e=embedding).select("vec_id", F.col("e").cast("array<double>").alias("e"))
    ok = F.col("vec_id").isNotNull() & (F.size("e") > 0) & F.forall(
        "e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(ok).select(F.col("vec_id").cast("bigint").alias("vec_id"),
                              F.transform("e", lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))


def top_k(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, scale: int = SCALE,
          every: int = 100, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for the queries whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    prepare_session(spark)
    rows = integer_vectors(vectors, vec_id, embedding, scale)
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = materialize(queries, "mtree-queries")
    trees = materialize(rows.mapInArrow(_trees, _TREES), "mtree-trees")
    groups, n = max(1, -(-trees.count() // CELL_TREES)), queries.count()
    # as many cells as the session has shuffle partitions, as far as there are queries
    blocks = max(1, -(-n // query_block), min(n, -(-shuffle_partitions(spark) // groups)))
    left = (trees.withColumn("g", F.pmod(F.xxhash64("tree"), F.lit(groups)).cast("int"))
            .withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    right = (queries.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
             .withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))))
    found = left.groupBy("g", "b").cogroup(right.groupBy("g", "b")).applyInArrow(_cell(k), "query_id bigint, vec_id bigint, score bigint")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
