"""Operator 12: hard negatives by cover trees over norm-augmented candidates.

Integer vectors x (floor(scale * component)) become points (x, sqrt(L - |x|^2)) of
one sphere, L the largest |x|^2 of a tree, so the points nearest to (q, 0) have the highest inner
products with q. Every task groups its rows into cover trees of bounded size:

* a node covers its rows within a radius around its routing point, a row of its own;
* its children are a net of its rows, found farthest point first and starting with the node's own
  routing point: they lie at least r apart and every row is within r of one of them. The net ends when
  r has fallen to half of the node's radius or at ``FAN`` children, and r is the level's covering radius;
* a node of at most ``PAGE`` rows, or of radius 0, is a leaf; its rows lie side by side.

From the score s of a node's routing point, its distance d = sqrt(|q|^2 + L - 2s) and radius r follow bounds of
all scores below it: s - |q|r to s + |q|r, and (|q|^2 + L - (d +- r)^2) / 2. A block of queries walks a tree best-first by the
upper bound; a query passes nodes whose bounds lie outside of all its windows or under the k-th score found there, and
the rows of leaves are verified by exact integer scores.

Mining is two searches by the same trees: an anchor's positives (k best rows of its label), then one window
of scores for each distinct positive score, in the rows of other labels.

Shape of the job: trees are built once and written to the shared folder as packed rows. Queries are dealt into blocks and trees into groups
of bounded size; a cell (group, block) is one cogrouped task that returns k rows per query and window, whose best are taken by a
partial top-k. Nothing passes through the driver but counts; no vector meets a vector outside a cell's search.

Defined results: rows with a null label, a null or empty vector, or any null or non-finite component take no part, nor do rows with a null
vec_id; vectors only meet vectors of their own length; of several rows with an anchor's id the smallest (label, vector)
asks, and none of them is a candidate of that anchor; other repeated rows are candidates each; an anchor without positives, or
whose window is empty (negative positive score), gives no rows; ties go to the smaller vec_id; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millstone.llm.common import materialize, pick, prepare_session, shuffle_partitions

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
LOW, HIGH = 80, 100       # per cent of the positive score
TREE = 8192               # rows of one tree
PAGE = 64                 # rows of a leaf
FAN = 16                  # children of a node
CELL_TREES = 8            # trees of a cell
CELL_QUERIES = 2048       # queries of a cell, about
STEP = 1024               # rows of a leaf verified at once (a leaf of equal rows may hold a whole tree)
EXACT = 1 << 52
ABSENT = 1 << 62

# the packed form of a tree: rows in leaf order, then nodes in depth first order
ROWS = {"ids": "<i8", "labels": "<i8", "vecs": "<i4"}
NODES = {"route": "<i4", "radius": "<f8", "begin": "<i4", "end": "<i4", "child": "<i4", "children": "<i4"}
TREE_SCHEMA = pa.schema([("tree", pa.string()), ("dim", pa.int32()), *[(c, pa.binary()) for c in (*ROWS, *NODES)]])
_TREE = "tree string, dim int, " + ", ".join(f"{c} binary" for c in (*ROWS, *NODES))
FOUND = pa.schema([(c, pa.int64()) for c in ("anchor_id", "low", "high", "vec_id", "score")])
_FOUND = ", ".join(f"{f.name} bigint" for f in FOUND)


class CoverTree:
    """One tree over integer vectors, with ids and labels."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vecs: np.ndarray, nodes: dict[str, np.ndarray] | None = None):
        self.ids, self.labels, self.vecs = ids, labels, vecs.astype(np.float64)
        norm = (self.vecs ** 2).sum(1)
        self.lift = float(norm.max())
        if nodes is None:
            nodes = self._grow(np.column_stack([self.vecs, np.sqrt(self.lift - norm)]))
        self.nodes = nodes
        self.top = float(np.abs(vecs).max())
        self.whole = vecs.astype(np.int64)

    def _grow(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """Nodes over the points ``x``; rows are put into leaf order."""
        order: list[np.ndarray] = []
        # a node: routing point, radius, first and last row, first child, number of children
        table: list[list] = [[0, 0.0, 0, 0, 0, 0]]
        d = np.sqrt(((x - x[0]) ** 2).sum(1))
        table[0][1] = float(d.max())
        work = [(0, np.arange(len(x)), d)]
        size = 0
        leaves: list[tuple[int, np.ndarray]] = []
        while work:
            k, rows, d = work.pop()
            radius = table[k][1]
            if len(rows) <= PAGE or radius == 0:
                leaves.append((k, rows))
                continue
            near, dist = np.zeros(len(rows), np.int64), d.copy()
            centres = [table[k][0]]
            while len(centres) < FAN and dist.max() > radius / 2:
                c = int(rows[dist.argmax()])
                to = np.sqrt(((x[rows] - x[c]) ** 2).sum(1))
                closer = to < dist
                near[closer], dist[closer] = len(centres), to[closer]
                centres.append(c)
            table[k][4], table[k][5] = len(table), len(centres)
            for i, c in enumerate(centres):
                mine = near == i
                work.append((len(table), rows[mine], dist[mine]))
                table.append([c, float(dist[mine].max()), 0, 0, 0, 0])
        for k, rows in leaves:
            rows = rows[np.argsort(self.ids[rows], kind="stable")]
            table[k][2:4] = size, size + len(rows)
            order.append(rows)
            size += len(rows)
        place = np.concatenate(order)
        to = np.empty(len(place), np.int64)
        to[place] = np.arange(len(place))
        self.ids, self.labels, self.vecs = self.ids[place], self.labels[place], self.vecs[place]
        columns = list(zip(*table))
        columns[0] = to[np.array(columns[0])]
        return {c: np.array(v, t) for (c, t), v in zip(NODES.items(), columns)}

    def packed(self, name: str) -> tuple:
        rows = (self.ids, self.labels, self.vecs)
        return (name, self.vecs.shape[1], *[np.ascontiguousarray(v.astype(t)).tobytes() for v, t in zip(rows, ROWS.values())],
                *[self.nodes[c].tobytes() for c in NODES])

    @staticmethod
    def unpacked(row: dict) -> "CoverTree":
        got = {c: np.frombuffer(row[c], t) for c, t in (ROWS | NODES).items()}
        return CoverTree(got["ids"], got["labels"], got["vecs"].reshape(-1, row["dim"]), {c: got[c] for c in NODES})

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest and smallest score of a row below each node, for each query of ``q``."""
        s = q @ self.vecs[self.nodes["route"]].T
        norm = (q ** 2).sum(1)[:, None]
        full, r = norm + self.lift, self.nodes["radius"][None]
        d = np.sqrt(np.maximum(full - 2 * s, 0))
        slack = 1 + 1e-9 * full
        reach = np.sqrt(norm) * r
        high = np.minimum(s + reach, (full - np.maximum(d - r, 0) ** 2) / 2) + slack
        low = np.maximum(s - reach, (full - (d + r) ** 2) / 2) - slack
        return high, low

    def search(self, block: "Block", k: int, same: bool) -> None:
        """Offer the tree's rows to the windows of a block of queries.

        Every query begins with the leaf of its highest bound. Then the block walks down best-first: the node with the highest
        bound of any query that still wants it comes next, and only those queries go on below it."""
        high, low = self.bounds(block.points)
        child, children, begin, end = (self.nodes[c].tolist() for c in ("child", "children", "begin", "end"))
        leaves = np.flatnonzero(self.nodes["children"] == 0)
        first = leaves[high[:, leaves].argmax(1)]
        for n in np.unique(first).tolist():
            self._verify(block, np.flatnonzero((first == n) & block.wants(high[:, n], low[:, n])), begin[n], end[n], k, same)
        heap = [(-np.inf, 0)]
        while heap:
            n = heapq.heappop(heap)[1]
            want = block.wants(high[:, n], low[:, n])
            if not want.any():
                continue
            for c in range(child[n], child[n] + children[n]):
                if (go := want & block.wants(high[:, c], low[:, c])).any():
                    heapq.heappush(heap, (-float(high[go, c].max()), c))
            if not children[n]:
                self._verify(block, np.flatnonzero(want & (first != n)), begin[n], end[n], k, same)

    def _verify(self, block: "Block", asking: np.ndarray, begin: int, end: int, k: int, same: bool) -> None:
        """Exact scores of a leaf's rows for the queries ``asking``."""
        if not len(asking):
            return
        exact = self.top * block.top * self.vecs.shape[1] < EXACT
        for i in range(begin, end, STEP):
            j = min(end, i + STEP)
            s = (block.points[asking] @ self.vecs[i:j].T).astype(np.int64) if exact else block.vecs[asking] @ self.whole[i:j].T
            ok = (self.labels[i:j][None] == block.labels[asking][:, None]) == same
            block.offer(asking, s, self.ids[i:j], ok & (self.ids[i:j][None] != block.anchors[asking][:, None]), k)


class Block:
    """Queries of one length with their windows of scores (low, high), and the best rows found so far."""

    def __init__(self, queries: list[dict]):
        self.anchors = np.array([r["vec_id"] for r in queries], np.int64)
        self.labels = np.array([r["label"] for r in queries], np.int64)
        self.vecs = np.array([r["v"] for r in queries], np.int64)
        self.points = self.vecs.astype(np.float64)
        self.top = float(np.abs(self.points).max())
        self.windows = [[(None, None)] if r["lows"] is None else list(zip(r["lows"], r["highs"])) for r in queries]
        most = max(map(len, self.windows))
        # scores stay far from the ends of 64 bits; an absent window is one that nothing reaches
        self.floor, self.ceil = np.full((len(queries), most), ABSENT), np.full((len(queries), most), -ABSENT)
        for q, ws in enumerate(self.windows):
            for w, (lo, hi) in enumerate(ws):
                self.floor[q, w], self.ceil[q, w] = (-ABSENT, ABSENT) if lo is None else (lo, hi)
        self.best: list[list[list[tuple[int, int]]]] = [[[] for _ in ws] for ws in self.windows]

    def wants(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Queries with a window that rows between these bounds may enter."""
        return ((high[:, None] >= self.floor) & (low[:, None] <= self.ceil)).any(1)

    def offer(self, asking: np.ndarray, s: np.ndarray, ids: np.ndarray, ok: np.ndarray, k: int) -> None:
        """Rows of a leaf, in order of id, with their scores by query."""
        for w in range(self.floor.shape[1]):
            m = ok & (s >= self.floor[asking, w][:, None]) & (s <= self.ceil[asking, w][:, None])
            many = np.flatnonzero(m.sum(1) > k)
            if len(many):  # the k best of each; a stable order keeps the smaller id
                some = np.argsort(np.where(m[many], -s[many], ABSENT), axis=1, kind="stable")[:, :k]
                m[many] = False
                m[many[:, None], some] = True
            for q, r in zip(*(a.tolist() for a in np.nonzero(m))):
                best, item = self.best[asking[q]][w], (int(s[q, r]), -int(ids[r]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
                if len(best) == k:
                    self.floor[asking[q], w] = best[0][0]

    def rows(self) -> Iterator[tuple]:
        """(anchor, low, high, vec_id, score) of what was found."""
        for anchor, windows, found in zip(self.anchors.tolist(), self.windows, self.best):
            for (lo, hi), best in zip(windows, found):
                for score, minus in best:
                    yield anchor, lo, hi, -minus, score


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows as packed trees, per vector length."""
    from pyspark import TaskContext

    held: dict[int, list] = {}
    name, made = TaskContext.get().partitionId(), 0

    def tree(group):
        ids, labels, vecs = zip(*group)
        t = CoverTree(np.array(ids, np.int64), np.array(labels, np.int64), np.array(vecs, np.int64))
        cols = zip(t.packed(f"{name}-{made}"), TREE_SCHEMA)
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in cols], schema=TREE_SCHEMA)

    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(3))):
            group = held.setdefault(len(row[2]), [])
            group.append(row)
            if len(group) == TREE:
                yield tree(held.pop(len(row[2])))
                made += 1
    for group in held.values():
        yield tree(group)
        made += 1


def _cell(k: int, same: bool):
    def run(trees: pa.Table, queries: pa.Table) -> pa.Table:
        """Searches a block of queries in a group of trees."""
        by_length: dict[int, list[dict]] = {}
        for r in queries.to_pylist():
            by_length.setdefault(len(r["v"]), []).append(r)
        blocks = {d: Block(rows) for d, rows in by_length.items()}
        for i in range(trees.num_rows if blocks else 0):
            tree = CoverTree.unpacked(trees.slice(i, 1).to_pylist()[0])
            if block := blocks.get(tree.vecs.shape[1]):
                tree.search(block, k, same)
        rows = [r for b in blocks.values() for r in b.rows()]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 5, FOUND)], schema=FOUND)
    return run


def labelled_vectors(vectors: DataFrame, vec_id: str, embedding: str, label: str, scale: int) -> DataFrame:
    """(vec_id, label, v): the rows that take part, components as floor(scale * x)."""
    v = pick(vectors, vec_id=vec_id, e=embedding, label=label).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("e").cast("array<double>").alias("e"))
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("e") > 0) & F.forall(
        "e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(ok).select("vec_id", "label", F.transform("e", lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))


class Forest:
    """The written trees of a table of (vec_id, label, v), dealt into groups."""

    def __init__(self, rows: DataFrame, cell_trees: int = CELL_TREES):
        self.trees = materialize(rows.mapInArrow(_trees, _TREE), "cover-trees")
        self.groups = max(1, -(-self.trees.count() // cell_trees))
        self.trees = self.trees.withColumn("g", F.pmod(F.xxhash64("tree"), F.lit(self.groups)).cast("int"))

    def best(self, queries: DataFrame, k: int, same: bool, cell_queries: int = CELL_QUERIES) -> DataFrame:
        """(anchor_id, low, high, vec_id, score, rank): the k best rows of every query (vec_id, label, v, lows, highs) and window;
        the window is null where there was none."""
        n = queries.count()
        # at least as many cells as the session has shuffle partitions, as far as there are queries
        blocks = max(1, -(-n // cell_queries), min(n, -(-shuffle_partitions(queries.sparkSession) // self.groups)))
        block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
        left = self.trees.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        right = queries.withColumn("b", block).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(self.groups - 1))))
        found = left.groupBy("g", "b").cogroup(right.groupBy("g", "b")).applyInArrow(_cell(k, same), _FOUND)
        w = Window.partitionBy("anchor_id", "low", "high").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
                   scale: int = SCALE, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). Anchors are the rows whose id is divisible by
    ``every``; a negative's score lies between ``low`` and ``high`` per cent of the positive's."""
    prepare_session(vectors.sparkSession)
    rows = labelled_vectors(vectors, vec_id, embedding, label, scale)
    forest = Forest(rows)
    anchors = materialize(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id")
                          .agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v"), "anchors")
    none = F.lit(None).cast("array<bigint>")
    liked = forest.best(anchors.withColumns({"lows": none, "highs": none}), positives, True)
    liked = materialize(liked.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # integer scores s with low * p <= 100 * s <= high * p
    per_cent = lambda c: ((c - F.pmod(c, F.lit(100))) / 100).cast("bigint")
    lows, highs = -per_cent(-F.col("positive_score") * low), per_cent(F.col("positive_score") * high)
    windows = (liked.select("anchor_id", lows.alias("lo"), highs.alias("hi")).where("lo <= hi").distinct()
               .groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("w"))
               .select(F.col("anchor_id").alias("a"), "w.lo", "w.hi"))
    asked = anchors.join(windows, F.col("vec_id") == F.col("a")).select("vec_id", "label", "v", F.col("lo").alias("lows"), F.col("hi").alias("highs"))
    got = forest.best(materialize(asked, "windows"), negatives, False).select(
        F.col("anchor_id").alias("a"), F.col("low").alias("l"), F.col("high").alias("h"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return (liked.join(got, (F.col("anchor_id") == F.col("a")) & (lows == F.col("l")) & (highs == F.col("h")))
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
