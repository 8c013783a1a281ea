"""Operator 8: token counts from pre-token frequencies.

The pieces of a pre-token are counted once per distinct pre-token of the
corpus; a document's token count is the sum over its pre-tokens of pieces
times frequency. Ids are never kept.

Shape of the job: each input task cuts its documents into pre-tokens and sends,
per bucket of the pre-token hash, the distinct pre-tokens of a bounded chunk
of documents with their per-document frequencies. A bucket counts the pieces
of each distinct pre-token once, joins the frequencies and returns one
partial sum per document, packed per chunk; the chunk adds the sums of all
buckets. A frequent pre-token is one entry per chunk, never one row per
occurrence, so no key is hot. Nothing but the shuffles is stored.

The vocabulary file reaches the executors with Spark's own file distribution.

Defined results: null text is empty (0 tokens); repeated rows and null ids are
counted row by row; an empty table gives no rows. Added tokens of the file (such
as the end-of-text mark) inside a text count one each, as the library does.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millstone.llm.common import (arrow_rows, chunk_label, flat, pack_ints, pick, prepare_session, shuffle_partitions,
                                  unpack_ints)

CHUNK_TOKENS = 2_000_000
LIMIT = 1024

# Fixed value: the split pattern of byte-level BPE files with use_regex, with
# white space spelled out as the tokenizer's regex engine defines it.
_S = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+")

PART = pa.schema([("bucket", pa.int64()), ("chunk", pa.string()), ("ids", pa.list_(pa.int64())), ("bytes", pa.binary()),
                  ("marks", pa.binary()), ("words", pa.list_(pa.string())), ("many", pa.binary()), ("docs", pa.binary()),
                  ("counts", pa.binary())])
SUMS = pa.schema([("chunk", pa.string()), ("ids", pa.list_(pa.int64())), ("bytes", pa.binary()), ("sums", pa.binary())])
OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
_PART = ("bucket bigint, chunk string, ids array<bigint>, bytes binary, marks binary, words array<string>, "
         "many binary, docs binary, counts binary")


def added_tokens(file: str) -> list[str]:
    with open(file, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f)["added_tokens"]]


@lru_cache(maxsize=2)
def load_counter(file: str):
    """pieces(list of pre-tokens) -> list of piece counts; the library splits nothing further."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    t = Tokenizer.from_file(file)
    t.no_truncation()
    t.no_padding()
    t.encode_special_tokens = True
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return lambda words: [len(e) for e in t.encode_batch_fast(words, add_special_tokens=False)]


def _local(file: str) -> str:
    return SparkFiles.get(os.path.basename(file))


def _frequencies(file: str, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks_of = added_tokens(_local(file))
        cut = regex.compile("|".join(map(regex.escape, sorted(marks_of, key=len, reverse=True)))) if marks_of else None
        find = regex.compile(PATTERN).findall
        label, k = chunk_label(), 0
        vocab, ids, sizes, marks, freq, total = {}, [], [], [], [], 0

        def flush():
            words = list(vocab)
            bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % n for w in words), np.int64, len(words))
            place = np.argsort(bucket, kind="stable")
            rank = np.empty(len(words), np.int64)
            rank[place] = np.arange(len(words))
            docs = np.repeat(np.arange(len(ids)), [len(f[0]) for f in freq])
            word = rank[np.concatenate([f[0] for f in freq])] if words else np.zeros(0, np.int64)
            count = np.concatenate([f[1] for f in freq]) if words else np.zeros(0, np.int64)
            o = np.argsort(word, kind="stable")
            docs, word, count = docs[o], word[o], count[o]
            at = np.searchsorted(word, np.arange(len(words) + 1))
            home = xxhash.xxh3_64_intdigest(f"{label}-{k}") % n
            rows = [(home, f"{label}-{k}", ids, pack_ints(np.array(sizes)), pack_ints(np.array(marks)), None, None, None, None)]
            for b, run_ in groupby(range(len(words)), key=lambda i: bucket[place[i]]):
                run_ = list(run_)
                i, j = run_[0], run_[-1] + 1
                rows.append((int(b), f"{label}-{k}", None, None, None, [words[x] for x in place[i:j]],
                             pack_ints(np.diff(at[i:j + 1])), pack_ints(docs[at[i]:at[j]]), pack_ints(count[at[i]:at[j]])))
            return arrow_rows(PART, rows)

        for doc_id, text in flat(batches):
            tokens, m = find(text), 0
            if cut is not None and (inside := cut.findall(text)):
                m = len(inside)
                tokens = [t for piece in cut.split(text) for t in find(piece)]
            c = Counter(tokens)
            freq.append((np.fromiter((vocab.setdefault(w, len(vocab)) for w in c), np.int64, len(c)),
                         np.fromiter(c.values(), np.int64, len(c))))
            ids.append(doc_id)
            sizes.append(len(text.encode("utf-8", "surrogatepass")))
            marks.append(m)
            total += len(tokens) + 1
            if total >= CHUNK_TOKENS:
                yield flush()
                vocab, ids, sizes, marks, freq, total, k = {}, [], [], [], [], 0, k + 1
        if ids:
            yield flush()
    return run


def _pieces(file: str):
    def run(table: pa.Table) -> pa.Table:
        """A bucket: pieces once per distinct pre-token, joined to the frequencies of every chunk."""
        pieces, out = load_counter(_local(file)), []
        rows = table.to_pylist()
        words = list({w: None for r in rows for w in r["words"] or ()})
        n = {w: c for i in range(0, len(words), 4096) for w, c in zip(words[i:i + 4096], pieces(words[i:i + 4096]))}
        for r in rows:
            if r["words"] is None:
                out.append((r["chunk"], r["ids"], r["bytes"], r["marks"]))
                continue
            per = np.repeat(np.fromiter((n[w] for w in r["words"]), np.int64, len(r["words"])), unpack_ints(r["many"]))
            sums = np.bincount(unpack_ints(r["docs"]), per * unpack_ints(r["counts"])).astype(np.int64)
            out.append((r["chunk"], None, None, pack_ints(sums)))
        return pa.Table.from_batches([arrow_rows(SUMS, out)])
    return run


def _add(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    head = next(r for r in rows if r["ids"] is not None)
    total = np.zeros(len(head["ids"]), np.int64)
    for r in rows:
        s = unpack_ints(r["sums"])
        total[:len(s)] += s.astype(np.int64)
    return pa.Table.from_arrays([pa.array(head["ids"], pa.int64()), pa.array(unpack_ints(head["bytes"]).astype(np.int64)),
                                 pa.array(total)], schema=OUT)


def token_counts(docs: DataFrame, tokenizer_file: str, doc_id: str = "doc_id", text: str = "text",
                 limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for a byte-level BPE ``tokenizers`` file."""
    spark = docs.sparkSession
    prepare_session(spark)
    spark.sparkContext.addFile(tokenizer_file)
    d = pick(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    parts = d.mapInArrow(_frequencies(tokenizer_file, shuffle_partitions(spark)), _PART)
    sums = parts.groupBy("bucket").applyInArrow(_pieces(tokenizer_file), "chunk string, ids array<bigint>, bytes binary, sums binary")
    out = sums.groupBy("chunk").applyInArrow(_add, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
