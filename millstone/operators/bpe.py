"""K1-K9: byte-level BPE as Spark jobs.

Training (K4) works on the distinct-word table, one row per distinct
pre-token with its frequency (one shuffle with map-side partial counts). A round
counts adjacent pairs (partial and final aggregate), takes the most frequent ones as
candidates, and cuts the words to *fragments*: runs of symbols in which all adjacent pairs are
candidates. What sequential training does next depends on the distinct fragments alone for as long as the best pair
is no worse than the last candidate, so a round learns hundreds or thousands of merges, exactly those of one merge
after another. Candidates and fragments are bounded, whatever the corpus.

Ids: specials first (list order), then the byte glyphs seen in training
sorted by code point, then merges in order; a merge that makes an existing
string reuses its id. Ties go to the smaller (left id, right id).
"""

from __future__ import annotations

import heapq
import time
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millstone import settings as S
from millstone.functions.bpe_codec import SHORT, Codec, merge_word
from millstone.functions.bytelevel import GLYPHS, pretokens


@dataclass
class BpeModel:
    vocab: list[str]                      # id -> token string (glyph form)
    merges: list[tuple[int, int, int]]    # rank -> (left id, right id, new id)
    specials: list[str] = field(default_factory=lambda: list(S.SPECIAL_TOKENS))
    unk: str = S.UNK_TOKEN
    rounds: int = 0                       # Spark rounds of the training that made it

    def token_id(self, tok: str) -> int | None:
        try:
            return self.vocab.index(tok)
        except ValueError:
            return None

    @property
    def eos_id(self) -> int:
        i = self.token_id(S.EOS_TOKEN)
        if i is None:
            raise ValueError("EOS token not in vocabulary")
        return i

    def codec(self) -> Codec:
        return Codec(self.vocab, self.merges, self.specials, self.unk)


# ------------------------------------------------------------------ K1-K3

def word_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """``(word, freq)`` over all pre-tokens of all texts (partial
    counts per task before the shuffle; a thin input is spread first since
    the pre-token regex is CPU-bound)."""
    from millstone.session import ensure_parallelism

    return (ensure_parallelism(texts).select(F.explode(pretokens(text_col)).alias("word"))
            .groupBy("word").agg(F.count(F.lit(1)).alias("freq")))


def byte_pair_counts(words: DataFrame) -> DataFrame:
    """K3 (round 0): counts of adjacent byte pairs, ``(left, right, pair_count)``."""
    b = words.where(F.col("word").isNotNull()).select(F.col("word").cast("binary").alias("word"), F.col("freq").cast("bigint").alias("freq"))
    p = b.mapInArrow(_byte_pairs, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("pair_count"))
    return p.select(F.shiftright("pair", PAIR_BITS).cast("int").alias("left"),
                    F.col("pair").bitwiseAND(F.lit((1 << PAIR_BITS) - 1)).cast("int").alias("right"), "pair_count")


# ------------------------------------------------------------------ K4

# A word is (freq, ids): one row of the distinct-word table with its current segmentation.
_WORD, _WORDS = pa.schema([("freq", pa.int64()), ("ids", pa.list_(pa.int32()))]), "freq bigint, ids array<int>"
PAIR_BITS = 32


def _adjacent(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of words: all symbols in a row, the word of each, the pair that begins at each place
    (left id in the upper bits) and whether both of its symbols are of one word."""
    ids = batch.column(1)
    flat = ids.flatten().to_numpy()
    word = np.repeat(np.arange(batch.num_rows), ids.value_lengths().to_numpy())
    return flat, word, flat[:-1].astype(np.int64) << PAIR_BITS | flat[1:], word[:-1] == word[1:]


def _among(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of ``keys`` are in the sorted array ``some``."""
    if not len(some):
        return np.zeros(len(keys), bool)
    return some[np.minimum(np.searchsorted(some, keys), len(some) - 1)] == keys


def _bytes_seen(batches):
    """Distinct byte values of a batch of words."""
    for b in batches:
        raw = "".join(b.column(0).to_pylist()).encode()
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.frombuffer(raw, np.uint8)).astype(np.int32))], names=["b"])


def _start(byte_ids: np.ndarray):
    def run(batches):
        """Words as byte symbols; words of one byte only feed the alphabet."""
        for b in batches:
            raw = [w.encode() for w in b.column(0).to_pylist()]
            rows = [(f, byte_ids[np.frombuffer(w, np.uint8)]) for w, f in zip(raw, b.column(1).to_pylist()) if len(w) > 1]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()),
                                              pa.array([r[1] for r in rows], pa.list_(pa.int32()))], schema=_WORD)
    return run


def _count_pairs(batches):
    """(pair, n): adjacent pairs of a batch with their frequencies, summed per batch."""
    for b in batches:
        _, word, pair, inside = _adjacent(b)
        keys, which = np.unique(pair[inside], return_inverse=True)
        n = np.bincount(which, b.column(0).to_numpy()[word[:-1][inside]], len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["pair", "n"])


def _byte_pairs(batches):
    """(pair, n) of words as UTF-8 bytes, summed per batch."""
    def symbols():
        for b in batches:
            raw = b.column(0).to_pylist()
            flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.int32)
            ids = pa.ListArray.from_arrays(np.cumsum([0, *map(len, raw)], dtype=np.int32), flat)
            yield pa.RecordBatch.from_arrays([b.column(1), ids], schema=_WORD)
    yield from _count_pairs(symbols())


def _fragments(candidates: np.ndarray):
    def run(batches):
        """(fragment, n): longest runs of symbols in which every adjacent pair is a candidate."""
        for b in batches:
            flat, word, pair, inside = _adjacent(b)
            ok = np.concatenate([[False], inside & _among(pair, candidates), [False]]).astype(np.int8)
            edge = np.diff(ok)
            at, size = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1) + 1
            ends = np.cumsum(size)
            symbols = flat[np.arange(int(size.sum())) + np.repeat(at - (ends - size), size)].astype(np.int32)
            offsets = np.append(0, ends * 4).astype(np.int32)
            found = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(symbols)])
            freq = pa.array(b.column(0).to_numpy()[word[at]], pa.int64())
            total = pa.table({"fragment": found, "n": freq}).group_by("fragment").aggregate([("n", "sum")])
            yield from total.select(["fragment", "n_sum"]).rename_columns(["fragment", "n"]).combine_chunks().to_batches()
    return run


def _apply(merges: list[tuple[int, int, int]]):
    ranks = {(a, b): (r, c) for r, (a, b, c) in enumerate(merges)}
    pairs = np.array([a << PAIR_BITS | b for a, b, _ in merges], np.int64)
    rank = np.argsort(pairs)
    pairs, new = pairs[rank], np.array([c for _, _, c in merges], np.int32)[rank]

    def run(batches):
        """Words after a round's merges; a word without a merged pair stays, one of a single token is done."""
        for b in batches:
            flat, word, pair, inside = _adjacent(b)
            hit = np.zeros(b.num_rows, bool)
            hit[word[:-1][inside & _among(pair, pairs)]] = True
            size = b.column(1).value_lengths().to_numpy()
            changed = b.filter(pa.array(hit & (size > SHORT)))
            rows = [(f, w) for f, ids in zip(*(changed.column(i).to_pylist() for i in range(2)))
                    if len(w := merge_word(ids, ranks)) > 1]
            yield b.filter(pa.array(~hit))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()),
                                              pa.array([r[1] for r in rows], pa.list_(pa.int32()))], schema=_WORD)
            changed = b.filter(pa.array(hit & (size <= SHORT)))
            freq = changed.column(0).to_numpy()
            for which, flat, size in merge_words(changed.column(1).flatten().to_numpy(), changed.column(1).value_lengths().to_numpy(), pairs, rank, new):
                some = size > 1
                ids = pa.ListArray.from_arrays(np.append(0, np.cumsum(size[some])).astype(np.int32),
                                               flat[np.repeat(some, size)].astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(freq[which[some]]), ids], schema=_WORD)
    return run


def merge_words(flat: np.ndarray, size: np.ndarray, pairs: np.ndarray, rank: np.ndarray, new: np.ndarray):
    """``merge_word`` of many words at once: (numbers of words, their symbols, their sizes) of the words that are done, step by
    step. In a step every word merges its pair of the lowest rank wherever it occurs, the leftmost first. ``pairs`` is sorted,
    ``rank`` and ``new`` belong to it."""
    which, none = np.arange(len(size)), len(pairs)
    while len(which):
        first = np.cumsum(size) - size
        word = np.repeat(np.arange(len(size)), size)
        here, inside = np.full(len(flat), none), word[:-1] == word[1:]
        key = flat[:-1].astype(np.int64) << PAIR_BITS | flat[1:]
        at = np.minimum(np.searchsorted(pairs, key), none - 1)
        here[:-1] = np.where(inside & (pairs[at] == key), rank[at], none)
        best = np.minimum.reduceat(here, first)
        done = best == none
        if done.any():
            yield which[done], flat[done[word]], size[done]
        take = (here == best[word]) & (here < none)
        places = np.arange(len(flat))
        run = np.maximum.accumulate(np.where(take & ~np.append(False, take[:-1]), places, 0))
        take &= (places - run) % 2 == 0  # of a run of equal symbols every second pair
        flat = flat.copy()
        spot = np.flatnonzero(take)
        flat[spot] = new[at[spot]]
        stay = ~done[word] & ~np.append(False, take[:-1])
        flat, size = flat[stay], np.bincount(word[stay], minlength=len(size))[~done]
        which = which[~done]


def settle(fragments: list[tuple[list[int], int]], last: tuple[int, int, int], vocab: list[str], tok2id: dict[str, int],
           vocab_size: int) -> list[tuple[int, int, int]]:
    """The merges that sequential training makes next, as far as the fragments of the candidate pairs tell.

    ``last`` is the place of the last candidate, (-count, left, right). A pair that is no candidate, or that
    comes to lie across the end of a fragment, is and stays behind it: its occurrences are among those of one pair
    that was left out, and a new token has a higher id than all earlier ones. So the best pair within the fragments is
    the best of all while it is not behind ``last``. A merge whose string is in the vocabulary already adds to
    another token's pairs and ends the round. ``vocab`` and ``tok2id`` grow."""
    parts, weight = [p for p, _ in fragments], [n for _, n in fragments]
    counts: dict[tuple[int, int], int] = {}
    where: dict[tuple[int, int], set[int]] = {}
    for k, p in enumerate(parts):
        for pair in zip(p, p[1:]):
            counts[pair] = counts.get(pair, 0) + weight[k]
            where.setdefault(pair, set()).add(k)
    heap = [(-n, *pair) for pair, n in counts.items()]
    heapq.heapify(heap)
    merges: list[tuple[int, int, int]] = []
    while heap and len(vocab) < vocab_size:
        best = heapq.heappop(heap)
        pair = best[1:]
        if counts.get(pair) != -best[0]:
            continue  # counted anew since
        if best > last:
            break
        token = vocab[pair[0]] + vocab[pair[1]]
        new = tok2id.get(token)
        merges.append((*pair, len(vocab) if new is None else new))
        if new is not None:
            break
        new = tok2id[token] = len(vocab)
        vocab.append(token)
        rank, was = {pair: (0, new)}, {}
        for k in where.pop(pair):
            for p in zip(parts[k], parts[k][1:]):
                was.setdefault(p, counts.get(p, 0))
                counts[p] -= weight[k]
            parts[k] = merge_word(parts[k], rank)
            for p in zip(parts[k], parts[k][1:]):
                was.setdefault(p, counts.get(p, 0))
                counts[p] = counts.get(p, 0) + weight[k]
                where.setdefault(p, set()).add(k)
        del counts[pair]
        for p, n in was.items():
            if counts.get(p, 0) > 0 and counts[p] != n:
                heapq.heappush(heap, (-counts[p], *p))
    return merges


def train_bpe(words: DataFrame, vocab_size: int = S.VOCAB_SIZE, specials: list[str] | None = None, *, candidates: int = 8192,
              fragment_symbols: int = 500_000, max_rounds: int | None = None, state: str | None = None,
              verbose: bool = False, rows_per_part: int = 250_000) -> BpeModel:
    """K4: train on ``words(word, freq)``; returns the model (bounded by ``vocab_size``).

    The word table stays in Spark. A round takes up to ``candidates`` of the most frequent pairs, cuts the words to
    the fragments that these pairs hold together, and learns from the distinct fragments (at most ``fragment_symbols``
    symbols; with more, half as many candidates are taken) all merges that are certain, see ``settle``. Then the merges are applied to the
    words that hold one of them, and the table is written. With ``state``, a folder that all executors share, tables and merges stay there, and
    training goes on from the last complete round when called again."""
    from millstone.session import drop_path, scratch_path

    spark = words.sparkSession
    specials = list(specials if specials is not None else S.SPECIAL_TOKENS)
    base = state or scratch_path(spark, f"millstone/bpe-{uuid.uuid4().hex[:12]}")
    log = _TrainingLog(spark, base)
    done = log.read() if state else None
    t0 = time.time()
    if done is None:
        # counted once: the alphabet, the number of words and the first table are read from it
        counted = f"{base}/counted-{uuid.uuid4().hex[:12]}"
        words.where(F.col("word").isNotNull() & (F.length("word") > 0)).select("word", "freq").write.parquet(counted)
        w = spark.read.parquet(counted)
        seen = sorted(r["b"] for r in w.mapInArrow(_bytes_seen, "b int").distinct().collect())  # <= 256 values
        vocab = list(specials)
        for g in sorted(GLYPHS[b] for b in seen):
            if g not in vocab:
                vocab.append(g)
        byte_ids = np.zeros(256, np.int32)
        byte_ids[seen] = [vocab.index(GLYPHS[b]) for b in seen]
        parts = max(spark.sparkContext.defaultParallelism, -(-words.count() // rows_per_part))
        w.repartition(parts).mapInArrow(_start(byte_ids), _WORDS).write.parquet(log.words(0))
        drop_path(spark, counted)
        if state:
            log.add(0, [(-1, -1, i) for i in range(len(vocab))], vocab)
        done = vocab, [], 0
    vocab, merges, rounds = done
    tok2id = {t: i for i, t in reversed(list(enumerate(vocab)))}
    first, take = rounds, min(candidates, 128)
    while len(vocab) < vocab_size and (max_rounds is None or rounds - first < max_rounds):
        cur = spark.read.schema(_WORDS).parquet(log.words(rounds))
        pairs = cur.mapInArrow(_count_pairs, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
        top = [(-r["n"], r["pair"] >> PAIR_BITS, r["pair"] & (1 << PAIR_BITS) - 1)
               for r in pairs.orderBy(F.desc("n"), "pair").limit(candidates).collect()]
        if not top:
            break
        batch, take = _learn(cur, top, take, fragment_symbols, vocab, tok2id, vocab_size)
        rounds += 1
        cur.mapInArrow(_apply(batch), _WORDS).write.parquet(log.words(rounds))
        if state:
            log.add(rounds, batch, vocab)
        merges += batch
        if rounds > 1 and state is None:
            drop_path(spark, log.words(rounds - 2))
        if verbose:
            print(f"round {rounds}: +{len(batch)} merges, vocab {len(vocab)}, {take} candidates, {time.time() - t0:.1f}s", flush=True)
    return BpeModel(vocab, merges, specials, rounds=rounds - first)


def _learn(cur: DataFrame, top: list[tuple[int, int, int]], take: int, most: int, vocab: list[str], tok2id: dict[str, int],
           vocab_size: int) -> tuple[list[tuple[int, int, int]], int]:
    """A round's merges, and how many candidates to take next."""
    while True:
        some = top[:take]
        keys = np.sort(np.array([a << PAIR_BITS | b for _, a, b in some], np.int64))
        found = (cur.mapInArrow(_fragments(keys), "fragment binary, n bigint").groupBy("fragment").agg(F.sum("n").alias("n"))
                 .persist())
        try:
            size = found.agg(F.sum(F.length("fragment"))).first()[0] // 4
            if size <= most:
                got = [(np.frombuffer(r["fragment"], np.int32).tolist(), r["n"]) for r in found.collect()]
                return settle(got, some[-1], vocab, tok2id, vocab_size), min(take * 4, max(len(top), 1)) if 3 * size < most else take
        finally:
            found.unpersist()
        if take == 1:  # runs of one symbol in very many lengths: the first pair is certain without them
            (_, a, b), = some
            new = tok2id.setdefault(vocab[a] + vocab[b], len(vocab))
            if new == len(vocab):
                vocab.append(vocab[a] + vocab[b])
            return [(a, b, new)], 1
        take = max(1, take // 2)


class _TrainingLog:
    """State of a training: a word table per round, and the tokens and merges of all rounds in one small table."""

    def __init__(self, spark, base: str):
        self.spark, self.base = spark, base

    def words(self, n: int) -> str:
        return f"{self.base}/words-{n:05d}"

    def add(self, n: int, merges: list[tuple[int, int, int]], vocab: list[str]) -> None:
        rows = [(n, k, a, b, c, vocab[c]) for k, (a, b, c) in enumerate(merges)]
        (self.spark.createDataFrame(rows, "round int, place int, left_id int, right_id int, new_id int, token string")
         .coalesce(1).write.mode("append").parquet(f"{self.base}/merges"))

    def read(self) -> tuple[list[str], list[tuple[int, int, int]], int] | None:
        from millstone.session import path_exists

        if not path_exists(self.spark, f"{self.base}/merges"):
            return None
        rows = self.spark.read.parquet(f"{self.base}/merges").orderBy("round", "place").collect()
        vocab: list[str] = []
        for r in rows:
            if r["new_id"] == len(vocab):
                vocab.append(r["token"])
        return vocab, [(r["left_id"], r["right_id"], r["new_id"]) for r in rows if r["round"]], rows[-1]["round"]


# ------------------------------------------------------------------ K5-K9

def _codec_udfs(model: BpeModel):
    from pyspark.sql import SparkSession

    from millstone.session import ship_package

    active = SparkSession.getActiveSession()
    if active is not None:
        ship_package(active)
    spark_ctx = None
    try:
        from pyspark import SparkContext
        spark_ctx = SparkContext._active_spark_context
    except Exception:  # noqa: BLE001
        pass
    payload = (model.vocab, model.merges, model.specials, model.unk)
    bc = spark_ctx.broadcast(payload) if spark_ctx is not None else None
    import hashlib

    key = hashlib.md5(repr(payload).encode()).hexdigest()  # of the whole model

    def codec() -> Codec:
        from millstone.functions.bpe_codec import shared_codec

        return shared_codec(key, (lambda: bc.value) if bc is not None else payload)

    @F.arrow_udf(T.ArrayType(T.IntegerType(), containsNull=False))
    def encode_udf(words: pa.Array) -> pa.Array:
        return codec().encode_column(words)

    @F.arrow_udf(T.StringType())
    def decode_udf(ids: pa.Array) -> pa.Array:
        return codec().decode_column(ids)

    @F.arrow_udf(T.StringType())
    def decode_raw_udf(ids: pa.Array) -> pa.Array:
        return codec().raw_column(ids)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def tokens_udf(ids: pa.Array) -> pa.Array:
        return codec().tokens_column(ids)

    return encode_udf, decode_udf, decode_raw_udf, tokens_udf


class Tokenizer:
    """Column functions of a trained model (K5-K7, K9)."""

    def __init__(self, model: BpeModel):
        self.model = model
        self._enc, self._dec, self._raw, self._tok = _codec_udfs(model)
        import re
        self._special_re = "|".join(re.escape(s) for s in model.specials)

    def split_specials(self, text: Column) -> Column:
        """Pre-tokens with special-token literals kept whole (matched first)."""
        seg = F.regexp_extract_all(text, F.lit(f"({self._special_re})|((?:(?!{self._special_re})[\\s\\S])+)"), 0)
        specials = F.array(*[F.lit(s) for s in self.model.specials])
        segmented = F.flatten(F.transform(seg, lambda s: F.when(F.array_contains(specials, s), F.array(s))
                                          .otherwise(pretokens(s))))
        has = F.lit(False)
        for s in self.model.specials:
            has = has | text.contains(s)
        return F.when(has, segmented).otherwise(pretokens(text))

    def encode(self, text: Column | str) -> Column:
        """K5: text -> ids (no special tokens added)."""
        t = F.col(text) if isinstance(text, str) else text
        return self._enc(self.split_specials(t))

    def decode(self, ids: Column | str, raw: bool = False) -> Column:
        """K6: ids -> text (true byte decoding); ``raw`` joins glyph tokens with spaces."""
        c = F.col(ids) if isinstance(ids, str) else ids
        return (self._raw if raw else self._dec)(c)

    def ids_to_tokens(self, ids: Column | str) -> Column:
        """K7: ids -> token strings."""
        return self._tok(F.col(ids) if isinstance(ids, str) else ids)

    def with_eos(self, ids: Column | str) -> Column:
        """K9: ids + [eos id read from the vocabulary]."""
        c = F.col(ids) if isinstance(ids, str) else ids
        return F.array_append(c, F.lit(self.model.eos_id))

    def encode_docs(self, df: DataFrame, text_col: str = "text", out: str = "ids") -> DataFrame:
        """K5 on a table: adds ``out``; a thin input is spread over the
        cluster's cores first (encoding is CPU-bound). Texts are encoded once, however
        many columns are made of the ids."""
        from millstone.plans.prepare import computed_once
        from millstone.session import ensure_parallelism

        return computed_once(ensure_parallelism(df), out, self.encode(text_col))

    def roundtrip(self, df: DataFrame, text_col: str = "text", key: str = "doc_id") -> DataFrame:
        """K8: ``(key, ids, subwords, decoded, ok)`` per input text."""
        x = self.encode_docs(df.select(key, text_col), text_col)
        return x.select(key, "ids", self.ids_to_tokens("ids").alias("subwords"),
                        self.decode("ids").alias("decoded"),
                        (self.decode("ids") == F.col(text_col)).alias("ok"))
