"""Operator 2: deleted-interpolation bigram model.

P(w | v) = l2[b] c(vw)/c(v) + l1[b] c(w)/N + l0[b] / (V + 1), where b is the
frequency bucket of the context v (bit length of its count) and the weights of
each bucket are learned by expectation-maximisation: one fold of the training
documents is *deleted* from the counts and its tokens are explained by the
counts of the other folds. The final counts use all training documents.

Words never get ids from a corpus-wide dictionary. Documents are tokenised
once into chunk rows (bounded token count, written to the shared folder) that
hold word hashes; each chunk sends its distinct words and word pairs, sorted,
to range buckets of the 64-bit key, where all chunks' counts are summed and
sent back to the chunks that asked. A frequent word or pair is one entry per
chunk, so no key is hot; the bucket count follows the number of keys.
Equality of words and pairs is equality of 64-bit hashes (among n distinct
keys the chance of any clash is about n^2 / 2^65).

Defined results: null text is empty (one end token); repeated rows are
scored alike and count as often as they occur; a null id counts as id text ''
for the split; an empty table gives no rows; without training tokens every
probability is 1 / (V + 1) = 1.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millstone.llm.common import (arrow_rows, chunk_label, flat, key_bucket, materialize, mix64, n_buckets, pack_ints,
                                  pack_sorted, pick, prepare_session, unpack_ints, unpack_sorted)

CHUNK_TOKENS = 1_000_000
KEYS_PER_BUCKET = 3_000_000
SPLIT, HELD_OUT, DELETED = 7, 2, 5
EM_ROUNDS, EM_STOP = 12, 1e-3
MAX_BUCKET = 40
BEGIN, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
TRAIN, TEST, FOLD = 0, 1, 2

CHUNK = pa.schema([("chunk", pa.string()), ("fold", pa.bool_()), ("ids", pa.list_(pa.int64())), ("roles", pa.binary()),
                   ("lens", pa.binary()), ("words", pa.binary()), ("tokens", pa.binary()),
                   ("n_keys", pa.int64()), ("n_train", pa.int64()), ("n_docs", pa.int64())])
BLOCK = pa.schema([("bucket", pa.int64()), ("chunk", pa.string()), ("kind", pa.int32()), ("keys", pa.binary()),
                   ("kept", pa.binary()), ("deleted", pa.binary())])
BACK = pa.schema([("chunk", pa.string()), ("kind", pa.int32()), ("bucket", pa.int64()), ("kept", pa.binary()),
                  ("deleted", pa.binary()), ("types", pa.int64()), ("kept_types", pa.int64())])
EVENT = pa.schema([("pair", pa.int64()), ("context", pa.int64()), ("word", pa.int64()), ("n", pa.int64())])
SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                    ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def ddl(schema: pa.Schema) -> str:
    names = {pa.string(): "string", pa.bool_(): "boolean", pa.binary(): "binary", pa.int64(): "bigint",
             pa.int32(): "int", pa.float64(): "double", pa.list_(pa.int64()): "array<bigint>",
             pa.list_(pa.int32()): "array<int>"}
    return ", ".join(f"`{f.name}` {names[f.type]}" for f in schema)


def split_of(doc_id) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % SPLIT


def words_of(text: str) -> list[bytes]:
    """ASCII lower case, words between the bytes 0x20 and 0x09-0x0D."""
    return text.encode("utf-8", "surrogatepass").lower().split()


class _Chunk:
    def __init__(self, fold: bool):
        self.fold = fold
        self.clear()

    def clear(self):
        self.ids, self.roles, self.lens, self.tokens, self.vocab, self.size = [], [], [], [], {}, 0

    def add(self, doc_id, role: int, words: list[bytes]):
        vocab = self.vocab
        self.tokens.append(np.fromiter((vocab.setdefault(w, len(vocab)) for w in words), np.uint32, len(words)))
        self.ids.append(doc_id)
        self.roles.append(role)
        self.lens.append(len(words))
        self.size += len(words) + 1

    def row(self, label: str) -> tuple:
        h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.vocab), np.uint64, len(self.vocab))
        words, place = np.unique(h, return_inverse=True)
        tokens = place.astype(np.uint32)[np.concatenate(self.tokens)] if self.vocab else np.zeros(0, np.uint32)
        lens, roles = np.array(self.lens, np.int64), np.array(self.roles, np.uint8)
        out = (label, self.fold, self.ids, roles.tobytes(), pack_ints(lens), pack_sorted(words), pack_ints(tokens),
               self.size + len(words), int((lens + 1)[roles != TEST].sum()), int((roles != TEST).sum()))
        self.clear()
        return out


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    label, n = chunk_label(), 0
    parts = [_Chunk(False), _Chunk(True)]
    for doc_id, text in flat(batches):
        s = split_of(doc_id)
        role = TEST if s == HELD_OUT else FOLD if s == DELETED else TRAIN
        c = parts[role == FOLD]
        c.add(doc_id, role, words_of(text))
        if c.size >= CHUNK_TOKENS:
            yield arrow_rows(CHUNK, [c.row(f"{label}-{n}")])
            n += 1
    for c in parts:
        if c.ids:
            yield arrow_rows(CHUNK, [c.row(f"{label}-{n}")])
            n += 1


class _Doc:
    """A chunk row unpacked: per token (end tokens included) the word and pair keys."""

    def __init__(self, row: dict):
        self.chunk, self.fold, self.ids = row["chunk"], row["fold"], row["ids"]
        self.roles = np.frombuffer(row["roles"], np.uint8)
        lens = unpack_ints(row["lens"]).astype(np.int64)
        self.sizes = lens + 1
        self.starts = np.cumsum(self.sizes) - self.sizes
        vocab = unpack_sorted(row["words"])
        total = int(self.sizes.sum())
        is_end = np.zeros(total, bool)
        is_end[self.starts + lens] = True
        word = np.empty(total, np.uint64)
        word[is_end] = END
        word[~is_end] = vocab[unpack_ints(row["tokens"])] if len(vocab) else 0
        prev = np.empty(total, np.uint64)
        prev[1:] = word[:-1]
        prev[self.starts] = BEGIN
        self.role = np.repeat(self.roles, self.sizes)
        self.word_keys, self.word_at = np.unique(word, return_inverse=True)
        # the context of a token is the word before it; BEGIN is its own key
        self.ctx_at = np.empty(total, np.int64)
        self.ctx_at[1:] = self.word_at[:-1]
        self.ctx_at[self.starts] = len(self.word_keys)
        self.pair_keys, self.pair_at = np.unique(mix64(mix64(prev) + word), return_inverse=True)

    def blocks(self, n: int) -> Iterator[tuple]:
        for kind, keys, at in ((0, self.word_keys, self.word_at), (1, self.pair_keys, self.pair_at)):
            counts = [np.bincount(at[self.role == r], minlength=len(keys)) for r in (TRAIN, FOLD)]
            b = key_bucket(keys, n)
            cut = np.flatnonzero(np.diff(b, prepend=b[0] + np.uint64(1))) if len(b) else []
            for i, j in zip(cut, [*cut[1:], len(b)]):
                yield (int(b[i]), self.chunk, kind, pack_sorted(keys[i:j]), pack_ints(counts[0][i:j]), pack_ints(counts[1][i:j]))


def _emit(n: int):
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                for out in _batched(_Doc(row).blocks(n), 64):
                    yield arrow_rows(BLOCK, out)
    return run


def _batched(it, n):
    out = []
    for x in it:
        out.append(x)
        if len(out) == n:
            yield out
            out = []
    if out:
        yield out


def _sum_bucket(table: pa.Table) -> pa.Table:
    """All blocks of a key range: sum the counts of equal keys, answer every block."""
    rows, out = table.to_pylist(), []
    for kind in (0, 1):
        own = [r for r in rows if r["kind"] == kind]
        if not own:
            continue
        keys = [unpack_sorted(r["keys"]) for r in own]
        sizes = [len(k) for k in keys]
        uniq, at = np.unique(np.concatenate(keys), return_inverse=True)
        kept = np.bincount(at, np.concatenate([unpack_ints(r["kept"]) for r in own]), len(uniq)).astype(np.int64)
        gone = np.bincount(at, np.concatenate([unpack_ints(r["deleted"]) for r in own]), len(uniq)).astype(np.int64)
        at = np.split(at, np.cumsum(sizes)[:-1])
        for i, (r, a) in enumerate(zip(own, at)):
            first = i == 0 and kind == 0
            out.append((r["chunk"], kind, r["bucket"], pack_ints(kept[a]), pack_ints(gone[a]),
                        int((kept + gone > 0).sum()) if first else 0, int((kept > 0).sum()) if first else 0))
    return pa.Table.from_batches([arrow_rows(BACK, out)])


class _Counted(_Doc):
    """A chunk with the corpus counts of its words and pairs."""

    def __init__(self, chunk: pa.Table, back: pa.Table):
        super().__init__(chunk.to_pylist()[0])
        got = back.select(["kind", "bucket", "kept", "deleted"]).sort_by("bucket").to_pylist()
        for kind, name in ((0, "word"), (1, "pair")):
            own = [r for r in got if r["kind"] == kind]
            setattr(self, f"{name}_kept", np.concatenate([unpack_ints(r["kept"]) for r in own]).astype(np.int64))
            setattr(self, f"{name}_gone", np.concatenate([unpack_ints(r["deleted"]) for r in own]).astype(np.int64))


def _events(totals: dict):
    def run(chunk: pa.Table, back: pa.Table) -> pa.Table:
        """Distinct (pair, context, word) counts without the deleted fold, for the fold's tokens."""
        if not chunk.num_rows:
            return pa.Table.from_batches([arrow_rows(EVENT, [])])
        d = _Counted(chunk, back)
        ctx = np.append(d.word_kept, totals["kept_docs"])[d.ctx_at]
        x = np.stack([d.pair_kept[d.pair_at], ctx, d.word_kept[d.word_at]], 1)
        x, n = np.unique(x, axis=0, return_counts=True) if len(x) else (x, np.zeros(0, np.int64))
        return pa.Table.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(x[:, 2]), pa.array(n.astype(np.int64))], schema=EVENT)
    return run


def _scores(totals: dict, weights: np.ndarray):
    def run(chunk: pa.Table, back: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return pa.Table.from_batches([arrow_rows(SCORED, [])])
        d = _Counted(chunk, back)
        n, v = totals["tokens"], totals["types"]
        words = d.word_kept + d.word_gone
        c = words[d.word_at].astype(np.float64)
        ctx = np.append(words, totals["docs"])[d.ctx_at].astype(np.float64)
        pair = (d.pair_kept + d.pair_gone)[d.pair_at]
        lam = weights[bucket_of(ctx)]
        p = lam[:, 0] / (v + 1) + lam[:, 1] * (c / n if n else 0) + lam[:, 2] * np.divide(pair, ctx, out=np.zeros(len(ctx)), where=ctx > 0)
        add = lambda x: np.add.reduceat(x, d.starts)
        return pa.Table.from_arrays([
            pa.array(d.ids, pa.int64()), pa.array(d.roles == TEST), pa.array(d.sizes.astype(np.int64)),
            pa.array(add((c > 0).astype(np.int64))), pa.array(np.full(len(d.ids), n, np.int64)),
            pa.array(add(np.log10((c + 1) / (n + v + 1)))), pa.array(add(np.log10(p)))], schema=SCORED)
    return run


def bucket_of(context_count: np.ndarray) -> np.ndarray:
    """Frequency bucket of a context: 0 unseen, else its bit length."""
    return np.minimum(np.frexp(context_count)[1], MAX_BUCKET)


def learn_weights(events: DataFrame, tokens: int, types: int) -> np.ndarray:
    """Mixture weights (uniform, word, pair) per context bucket by EM on the
    deleted fold's events. One small aggregate per round; only the bucket sums
    (at most ``MAX_BUCKET`` + 1 rows) reach the driver."""
    b = F.when(F.col("context") == 0, 0).otherwise(
        F.least(F.lit(MAX_BUCKET), F.floor(F.log2(F.col("context").cast("double"))).cast("int") + 1))
    e = events.select(b.alias("b"), F.col("n").cast("double").alias("n"),
                      (F.col("word") / F.lit(float(max(tokens, 1)))).alias("f1"),
                      F.when(F.col("context") > 0, F.col("pair") / F.col("context")).otherwise(0.0).alias("f2"))
    w = np.full((MAX_BUCKET + 1, 3), 1 / 3)
    w[0] = (0.5, 0.5, 0)
    last = None
    for _ in range(EM_ROUNDS):
        col = [F.element_at(F.array(*[F.lit(float(x)) for x in w[:, k]]), F.col("b") + 1) for k in range(3)]
        parts = e.select("b", "n", (col[0] / (types + 1)).alias("a0"), (col[1] * F.col("f1")).alias("a1"), (col[2] * F.col("f2")).alias("a2"))
        parts = parts.withColumn("p", F.col("a0") + F.col("a1") + F.col("a2"))
        got = parts.groupBy("b").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log("p")).alias("ll"),
                                     *[F.sum(F.col("n") * F.col(f"a{k}") / F.col("p")).alias(f"s{k}") for k in range(3)]).collect()
        if not got:
            break
        for r in got:
            # a small share for every component keeps unseen events possible
            s = np.array([r["s0"], r["s1"], r["s2"] if r["b"] else 0.0]) + np.array([1e-3, 1e-3, 1e-3 if r["b"] else 0])
            w[r["b"]] = s / s.sum()
        ll = sum(r["ll"] for r in got) / sum(r["n"] for r in got)
        if last is not None and ll - last < EM_STOP:
            break
        last = ll
    seen = sorted(r["b"] for r in got)
    for i in range(1, MAX_BUCKET + 1):  # a bucket without events takes the nearest bucket's weights
        if seen and i not in seen and (near := [s for s in seen if s]):
            w[i] = w[min(near, key=lambda s: (abs(s - i), s))]
    return w


def interpolated_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: base_score (add-one unigram) and score, log10 of the
    interpolated model's probability of the text."""
    spark = docs.sparkSession
    prepare_session(spark)
    d = pick(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    chunks = materialize(d.mapInArrow(_tokenise, ddl(CHUNK)), "lm-chunks")
    t = chunks.agg(F.sum("n_keys").alias("k"), F.sum("n_train").alias("n"), F.sum("n_docs").alias("d"),
                   F.sum(F.when(~F.col("fold"), F.col("n_docs"))).alias("kd"),
                   F.sum(F.when(~F.col("fold"), F.col("n_train"))).alias("kn")).first()
    buckets = n_buckets(spark, t["k"] or 0, KEYS_PER_BUCKET)
    blocks = chunks.mapInArrow(_emit(buckets), ddl(BLOCK))
    back = materialize(blocks.groupBy("bucket").applyInArrow(_sum_bucket, ddl(BACK)), "lm-counts")
    v = back.agg(F.sum("types").alias("v"), F.sum("kept_types").alias("kv")).first()
    totals = {"tokens": t["n"] or 0, "docs": t["d"] or 0, "kept_docs": t["kd"] or 0, "types": v["v"] or 0}
    fold = chunks.where("fold")
    asked = back.join(fold.select("chunk"), "chunk", "left_semi")
    events = (fold.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(_events(totals), ddl(EVENT))
              .groupBy("pair", "context", "word").agg(F.sum("n").alias("n")))
    weights = learn_weights(materialize(events, "lm-events"), t["kn"] or 0, v["kv"] or 0)
    return chunks.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(_scores(totals, weights), ddl(SCORED))
