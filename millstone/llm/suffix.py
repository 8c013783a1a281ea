"""Operator 3: removal of repeated 400-byte strings by prefix-free parsing.

Texts are parsed with a rolling hash over ``W`` bytes: where it hits a trigger, a phrase ends
(one position in 2^``period_bits``, so that a string of the wanted length holds six or more on average). Triggers depend on the bytes alone, so equal strings are parsed
alike. All 400-byte strings that start between two changes of the surrounding phrase ends form a
*run*; a run has

* an inner string: from its first to its last trigger, whole phrases of the dictionary that all its strings contain, and
* an outer string: everything its strings cover, with the partial phrases at both ends.

Equal strings lie in runs with equal inner strings. A first round sorts the runs of the corpus by (inner, outer): a run
whose inner string is alone has no repeats; runs with equal outer strings are repeated altogether; only in classes where
some run's outer string is alone, at the ends of repeats, a second round sorts string by string. So the sort is
over phrase sequences, about two per phrase, and hardly over bytes. Runs with fewer than two triggers go
to the second round.

Order: suffixes of dictionary and parse, cut at the length that matters, are ordered by 64-bit fingerprints
(prefix sums of a polynomial hash) rather than by bytes: only adjacency of equal strings is used, and any order with
that property gives the same result. Fingerprints are range-partitioned by their leading bits and sorted within each range.

Shape of the job: bounded chunks of whole documents are written once to the shared folder. A chunk sends its sorted distinct
fingerprints with counts (capped at 2) to the ranges and gets a bit per fingerprint back; a passage shared by many documents
is one entry per chunk, so no range is hot. Texts never meet in one task. A document of any
length is handled in slabs.

Defined results: null text is empty (0 bytes); strings are judged on the input, matches never cross documents, overlapping
occurrences in one document count; repeated rows are separate documents, so both lose what they share; null ids are kept;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millstone.llm.common import (arrow_rows, chunk_label, flat, key_bucket, materialize, mix64, n_buckets, pack_ints,
                                  pack_sorted, pick, prepare_session, unpack_ints, unpack_sorted)

LENGTH = 400
W = 16
CHUNK_BYTES = 8 << 20
SLAB = 1 << 20
KEYS_PER_RANGE = 4_000_000

_RNG = np.random.default_rng(20240521)
_T32 = _RNG.integers(1, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
_T64 = _RNG.integers(1, (1 << 63) - 1, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x2545F4914F6CDD1D
_POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}

CHUNK = "chunk string, ids array<bigint>, lens binary, text binary, n_bytes bigint"
_CHUNK = pa.schema([("chunk", pa.string()), ("ids", pa.list_(pa.int64())), ("lens", pa.binary()), ("text", pa.binary()), ("n_bytes", pa.int64())])
BLOCK = "range bigint, chunk string, round int, keys binary, outer binary, counts binary"
_BLOCK = pa.schema([("range", pa.int64()), ("chunk", pa.string()), ("round", pa.int32()), ("keys", pa.binary()), ("outer", pa.binary()), ("counts", pa.binary())])
BACK = "chunk string, round int, range bigint, verdicts binary"
_BACK = pa.schema([("chunk", pa.string()), ("round", pa.int32()), ("range", pa.int64()), ("verdicts", pa.binary())])
OUT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if "p" not in _POWERS or len(_POWERS["p"][0]) < n:
        def row(b: int) -> np.ndarray:
            p = np.full(max(n, 1 << 17), b, np.uint64)
            p[0] = 1
            return np.cumprod(p, dtype=np.uint64)

        _POWERS["p"] = row(_BASE), row(pow(_BASE, -1, 1 << 64))
    return _POWERS["p"]


def period_bits(length: int) -> int:
    """Triggers are one in 2^bits positions: 64 for strings of 400 bytes, 32 for 250."""
    return max(1, (length // 6).bit_length() - 1)


def phrase_ends(b: np.ndarray, bits: int) -> np.ndarray:
    """Positions of the last byte of every trigger."""
    if len(b) < W:
        return np.zeros(0, np.int64)
    h, step, base = _T32[b], 1, 0x9E3779B1
    while step < W:
        h = h[:-step] * np.uint32(base) + h[step:]
        step, base = step * 2, base * base % (1 << 32)
    h *= np.uint32(0x85EBCA6B)
    return np.flatnonzero(h >> np.uint32(32 - bits) == 0) + W - 1


class Slab:
    """The strings starting in [lo, hi) of a document, as runs with equal first and last triggers."""

    def __init__(self, doc: np.ndarray, lo: int, hi: int, length: int):
        self.length, self.off = length, lo
        self.b = b = doc[lo:hi + length - 1]
        sums = self._sums()  # eight bytes a byte: not kept, the slabs of a whole chunk are held at once
        e, last = phrase_ends(b, period_bits(length)), hi - lo
        cuts = np.concatenate([[0], e - W + 2, e - length + 1])
        self.start = s = np.unique(cuts[(cuts >= 0) & (cuts < last)])
        self.end = np.append(s[1:], last)
        first = np.searchsorted(e, s + W - 1, "left")
        final = np.searchsorted(e, s + length - 1, "right") - 1
        self.inner = first < final
        self.at = np.flatnonzero(self.inner)
        f, z = e[first[self.at]], e[final[self.at]]
        self.inner_keys = self._hash(sums, f - W + 1, z + 1, 1)
        self.outer_keys = self._hash(sums, s[self.at], self.end[self.at] - 1 + length, 2)

    def _sums(self) -> np.ndarray:
        """Prefix sums of the polynomial hash."""
        sums = np.zeros(len(self.b) + 1, np.uint64)
        np.cumsum(_T64[self.b] * _powers(len(self.b))[0][:len(self.b)], out=sums[1:])
        return sums

    def _hash(self, sums: np.ndarray, s: np.ndarray, e: np.ndarray, kind: int) -> np.ndarray:
        h = (sums[e] - sums[s]) * _powers(len(self.b))[1][s]
        return mix64(mix64(h + np.uint64(kind)) ^ (e - s).astype(np.uint64))

    def strings(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, keys) of every string of the marked runs."""
        if not runs.any():
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        size = (self.end - self.start)[runs]
        first = np.cumsum(size) - size
        at = np.arange(int(size.sum())) + np.repeat(self.start[runs] - first, size)
        return at, self._hash(self._sums(), at, at + self.length, 3)


def slabs(doc: np.ndarray, length: int) -> Iterator[Slab]:
    for lo in range(0, max(0, len(doc) - length + 1), SLAB):
        yield Slab(doc, lo, min(lo + SLAB, len(doc) - length + 1), length)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    label, k, held, ids, size = chunk_label(), 0, [], [], 0
    z = zstandard.ZstdCompressor(level=3)

    def out():
        return arrow_rows(_CHUNK, [(f"{label}-{k}", ids, pack_ints(np.array([len(x) for x in held])), z.compress(b"".join(held)), size)])

    for doc_id, text in flat(batches):
        held.append(text.encode("utf-8", "surrogatepass"))
        ids.append(doc_id)
        size += len(held[-1])
        if size >= CHUNK_BYTES:
            yield out()
            held, ids, size, k = [], [], 0, k + 1
    if ids:
        yield out()


def _docs(row: dict) -> Iterator[np.ndarray]:
    text = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["text"]), np.uint8)
    at = 0
    for n in unpack_ints(row["lens"]).tolist():
        yield text[at:at + n]
        at += n


def _distinct(keys: np.ndarray, outer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of one row per distinct pair, sorted; number of every row's pair)."""
    o = np.lexsort((outer, keys))
    k, x = keys[o], outer[o]
    new = np.append(True, (k[1:] != k[:-1]) | (x[1:] != x[:-1])) if len(o) else np.zeros(0, bool)
    at = np.empty(len(o), np.int64)
    at[o] = np.cumsum(new) - 1
    return o[new], at


def _blocks(chunk: str, round_: int, keys: np.ndarray, outer: np.ndarray, n: int) -> list[tuple]:
    """Sorted distinct keys with counts capped at 2, one block per range."""
    first, at = _distinct(keys, outer)
    keys, outer, total = keys[first], outer[first], np.minimum(np.bincount(at, minlength=len(first)), 2)
    r = key_bucket(keys, n)
    cut = np.flatnonzero(np.diff(r, prepend=r[0] + np.uint64(1))) if len(r) else []
    return [(int(r[i]), chunk, round_, pack_sorted(keys[i:j]), pack_ints(outer[i:j]), pack_ints(total[i:j]))
            for i, j in zip(cut, [*cut[1:], len(r)])]


def _joined(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *arrays])


def _first_round(n: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                all_ = [s for doc in _docs(row) for s in slabs(doc, length)]
                yield arrow_rows(_BLOCK, _blocks(row["chunk"], 1, _joined([s.inner_keys for s in all_]),
                                                 _joined([s.outer_keys for s in all_]), n))
    return run


def _meet(table: pa.Table) -> pa.Table:
    """One range: a verdict for every (key, outer) pair of every block. Bit 0: the pair occurs at least twice in
    the corpus; bit 1: the key does, and with it some pair that occurs once."""
    rows = table.to_pylist()
    keys = [unpack_sorted(r["keys"]) for r in rows]
    key, outer = np.concatenate(keys), np.concatenate([unpack_ints(r["outer"]) for r in rows])
    first, at = _distinct(key, outer)
    pairs = np.bincount(at, np.concatenate([unpack_ints(r["counts"]) for r in rows]), len(first))
    _, class_ = np.unique(key[first], return_inverse=True)
    open_ = (np.bincount(class_, pairs) >= 2) & (np.bincount(class_, pairs == 1) > 0)
    verdict = ((pairs >= 2) + 2 * open_[class_]).astype(np.uint8)[at]
    out, i = [], 0
    for r, k in zip(rows, keys):
        out.append((r["chunk"], r["round"], r["range"], pack_ints(verdict[i:i + len(k)])))
        i += len(k)
    return pa.Table.from_batches([arrow_rows(_BACK, out)])


def _verdicts(back: list[dict], round_: int) -> np.ndarray:
    got = sorted((r for r in back if r["round"] == round_), key=lambda r: r["range"])
    return np.concatenate([np.zeros(0, np.uint8), *[unpack_ints(r["verdicts"]) for r in got]])


def _judged(row: dict, back: list[dict], length: int) -> Iterator[list[tuple[Slab, np.ndarray, np.ndarray]]]:
    """Per document its slabs with the runs that are repeated altogether and the runs to look up string by string."""
    docs = [list(slabs(d, length)) for d in _docs(row)]
    all_ = [s for d in docs for s in d]
    at = _distinct(_joined([s.inner_keys for s in all_]), _joined([s.outer_keys for s in all_]))[1]
    bits, i = _verdicts(back, 1)[at], 0
    for d in docs:
        out = []
        for s in d:
            got = bits[i:i + len(s.at)]
            i += len(s.at)
            repeated, open_ = np.zeros(len(s.start), bool), ~s.inner
            repeated[s.at], open_[s.at] = got & 1 > 0, got & 2 > 0
            out.append((s, repeated, open_))
        yield out


def _second_round(n: int, length: int):
    def run(chunk: pa.Table, back: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return pa.Table.from_batches([arrow_rows(_BLOCK, [])])
        row = chunk.to_pylist()[0]
        keys = _joined([s.strings(open_)[1] for d in _judged(row, back.to_pylist(), length) for s, _, open_ in d])
        return pa.Table.from_batches([arrow_rows(_BLOCK, _blocks(row["chunk"], 2, keys, np.zeros_like(keys), n))])
    return run


def _result(length: int):
    def run(chunk: pa.Table, back: pa.Table) -> pa.Table:
        row, got, out = chunk.to_pylist()[0], back.to_pylist(), []
        docs = list(_docs(row))
        judged = list(_judged(row, got, length))
        opened = [[s.strings(o) for s, _, o in d] for d in judged]
        keys = _joined([k for d in opened for _, k in d])
        bits, i = _verdicts(got, 2)[_distinct(keys, np.zeros_like(keys))[1]] > 0, 0
        for doc_id, doc, d, o in zip(row["ids"], docs, judged, opened):
            edge = np.zeros(len(doc) + 1, np.int64)
            for (s, repeated, _), (at, k) in zip(d, o):
                np.add.at(edge, s.start[repeated] + s.off, 1)
                np.add.at(edge, s.end[repeated] - 1 + length + s.off, -1)
                hit = at[bits[i:i + len(k)]] + s.off
                i += len(k)
                np.add.at(edge, hit, 1)
                np.add.at(edge, hit + length, -1)
            gone = np.cumsum(edge[:-1]) > 0
            turn = np.flatnonzero(np.diff(gone, prepend=False, append=False))
            spans = turn.reshape(-1, 2).tolist()
            out.append((doc_id, len(doc), int(gone.sum()), len(spans), hashlib.sha256(doc[~gone].tobytes()).hexdigest(),
                        [{"start": a, "end": b} for a, b in spans]))
        cols = list(zip(*out))
        return pa.table({"doc_id": pa.array(cols[0], pa.int64()), "n_bytes": pa.array(cols[1], pa.int64()),
                         "n_removed": pa.array(cols[2], pa.int64()), "n_spans": pa.array(cols[3], pa.int64()), "kept_sha256": pa.array(cols[4]),
                         "spans": pa.array(cols[5], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})
    return run


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every document; spans are byte ranges."""
    spark = docs.sparkSession
    prepare_session(spark)
    d = pick(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    chunks = materialize(d.mapInArrow(_chunks, CHUNK), "pfp-chunks")
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    n = n_buckets(spark, total >> (period_bits(length) - 1), KEYS_PER_RANGE)  # about two runs a phrase
    first = chunks.mapInArrow(_first_round(n, length), BLOCK)
    first = materialize(first.groupBy("range").applyInArrow(_meet, BACK), "pfp-first")
    by = chunks.groupBy("chunk")
    second = by.cogroup(first.groupBy("chunk")).applyInArrow(_second_round(n, length), BLOCK)
    second = materialize(second.groupBy("range").applyInArrow(_meet, BACK), "pfp-second")
    return by.cogroup(first.unionAll(second).groupBy("chunk")).applyInArrow(_result(length), OUT)


def cut_spans(text: str | None, spans: list[dict] | None) -> str | None:
    """The text without the byte ranges; characters cut in two are dropped."""
    if spans is None:
        return text
    b, at, out = text.encode("utf-8", "surrogatepass"), 0, []
    for s in spans:
        out.append(b[at:s["start"]])
        at = s["end"]
    return b"".join([*out, b[at:]]).decode("utf-8", "ignore")
