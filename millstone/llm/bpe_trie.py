"""Operator 11: byte-level BPE encoding and decoding by prefix-sharing trie traversal.

The distinct pre-tokens of a bounded chunk of documents are inserted into a trie over
their bytes. Node numbers follow depth first order, so one walk over the nodes
sees every prefix once, after all of its own prefixes. What a prefix hands on is the
last token of its encoding:

    the last token t of a prefix p is the one vocabulary suffix of p for which
    (last token of p without t, t) is a *stable* pair

where a pair is stable when merging its bytes on their own ends in exactly these two
tokens. The encoding of p is then that of p without t, and t: a link to a shorter
prefix of the same path. Words with a common beginning share these states, and the ids
of a word are read by following the links from its node.

Vocabulary suffixes of a prefix come from an automaton over the tokens
(longest first, with suffix links), so the work is linear in the bytes of the trie. Stability
of a pair is decided by walking the right edge of the one merge tree against the left edge of the
other in order of merge rank.

Shape of the job: one pass over the documents with no shuffle. A task holds
the word numbers of a chunk, never more; encodings of short words are kept between
chunks in a store of bounded size. Ids leave as little-endian 32-bit integers,
the form in which token files hold them; ``decode`` gathers the bytes of the tokens.

Handled files: byte-level BPE of the ``tokenizers`` JSON form where every merge makes a token of its own
and no text is normalised; any other file raises ValueError. Added tokens inside a text are cut out first, as the library does.

Defined results: null text is empty (no ids, empty text); an empty table gives no rows;
repeated rows and null ids are encoded row by row; texts and words may have any length.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millstone.functions.bytelevel import GLYPH_TO_BYTE
from millstone.llm.common import flat, pick, prepare_session
from millstone.llm.tokens import PATTERN

CHUNK_WORDS = 1_000_000   # pre-tokens of a chunk
STORE_WORDS = 300_000     # encodings kept between chunks
STORE_BYTES = 64          # only of words up to this length
PAIRS = 2_000_000         # verdicts kept per worker
BATCH_BYTES = 16_000_000  # of one Arrow batch out
NEVER = 1 << 30


class Bpe:
    """Merge trees, token automaton and stable pairs of one tokenizer file."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
        if (model.get("type") != "BPE" or odd or model.get("ignore_merges") or spec.get("normalizer") or pre.get("type") != "ByteLevel"
                or pre.get("add_prefix_space") or not pre.get("use_regex", True)):
            raise ValueError(f"not a plain byte-level BPE file: {file} {odd}")
        vocab = model["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take neighbouring text are not handled")
        size = max([*vocab.values(), *added.values()]) + 1
        self.raw: list[bytes] = [b""] * size
        for w, i in vocab.items():
            self.raw[i] = bytes(GLYPH_TO_BYTE[g] for g in w) if w not in added else w.encode()
        for w, i in added.items():
            self.raw[i] = w.encode()
        self.added = added
        self.cut = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.pair: dict[tuple[int, int], int] = {}
        self.rank = [-1] * size             # of the merge that makes a token; bytes have none
        self.left, self.right = [-1] * size, [-1] * size
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            c, a, b = vocab[a + b], vocab[a], vocab[b]
            if self.rank[c] >= 0 or max(self.rank[a], self.rank[b]) >= r:
                raise ValueError("merges must make a token each, after its parts")
            self.pair[a, b], self.rank[c], self.left[c], self.right[c] = r, r, a, b
        byte_ids = [i for w, i in vocab.items() if len(w) == 1 and w in GLYPH_TO_BYTE]
        if len(byte_ids) < 256:
            raise ValueError("every byte needs a token")
        self.length = [len(b) for b in self.raw]
        self.verdicts: dict[int, bool] = {}
        whole = set(byte_ids)
        for c in sorted((i for i in range(size) if self.rank[i] >= 0), key=self.rank.__getitem__):
            a, b = self.left[c], self.right[c]
            if a in whole and b in whole and not self._joins(a, b, self.rank[c]):
                whole.add(c)
        self._automaton(whole)
        self.token_at = np.concatenate([[0], np.cumsum(self.length)])
        self.token_bytes = np.frombuffer(b"".join(self.raw), np.uint8)

    def _edge(self, t: int, side: list[int]) -> list[int]:
        out = [t]
        while side[t] >= 0:
            t = side[t]
            out.append(t)
        return out

    def _joins(self, a: int, b: int, before: int = NEVER) -> bool:
        """A merge of rank under ``before`` joins the tokens ``a`` and ``b`` somewhere across their border."""
        xs, ys, rank = self._edge(a, self.right), self._edge(b, self.left), self.rank
        i, j = len(xs) - 1, len(ys) - 1
        while True:
            grown_x, grown_y = rank[xs[i - 1]] if i else NEVER, rank[ys[j - 1]] if j else NEVER
            m = self.pair.get((xs[i], ys[j]))
            # of equal pairs in a row the leftmost merges first
            if m is not None and m < before and m < grown_x and m <= grown_y:
                return True
            if not i and not j:
                return False
            if grown_x <= grown_y:
                i -= 1
            else:
                j -= 1

    def stable(self, a: int, b: int) -> bool:
        key = a << 32 | b
        got = self.verdicts.get(key)
        if got is None:
            if len(self.verdicts) >= PAIRS:
                self.verdicts.clear()
            got = self.verdicts[key] = not self._joins(a, b)
        return got

    def _automaton(self, tokens: set[int]) -> None:
        """Arcs (state, byte) -> state, failure links, and per state the longest token that ends there;
        ``shorter`` leads from a token to the next shorter one that ends in the same place."""
        arc: dict[int, int] = {}
        at, own = [0], {}  # byte length of the states is implied by their order of discovery
        for t in sorted(tokens, key=lambda t: self.length[t]):
            s = 0
            for b in self.raw[t]:
                n = arc.get(s << 8 | b)
                if n is None:
                    n = arc[s << 8 | b] = len(at)
                    at.append(s)
                s = n
            own[s] = t
        below: dict[int, list[tuple[int, int]]] = {}
        for key, n in arc.items():
            below.setdefault(key >> 8, []).append((key & 255, n))
        fail, ends, shorter = [0] * len(at), [-1] * len(at), [-1] * len(self.raw)
        level = [0]
        while level:
            deeper = []
            for s in level:
                for b, n in below.get(s, ()):
                    f = fail[s]
                    while f and f << 8 | b not in arc:
                        f = fail[f]
                    fail[n] = arc.get(f << 8 | b, 0) if s else 0
                    t = own.get(n)
                    if t is None:
                        ends[n] = ends[fail[n]]
                    else:
                        ends[n], shorter[t] = t, ends[fail[n]]
                    deeper.append(n)
            level = deeper
        self.arc, self.fail, self.ends, self.shorter = arc, fail, ends, shorter

    # ---------------------------------------------------------------- trie

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and where each word begins (one place more than words)."""
        depth, byte, home = insert(words)
        last, back = self._propagate(depth, byte)
        many = [0] * len(last)
        for node in range(1, len(last)):
            many[node] = many[back[node]] + 1
        many, last, back = np.array(many), np.array(last, np.uint32), np.array(back)
        starts = np.concatenate([[0], np.cumsum(many[home])]).astype(np.int64)
        ids, node, end = np.empty(starts[-1], np.uint32), home, starts[1:].copy()
        while len(node):
            alive = node > 0
            node, end = node[alive], end[alive] - 1
            ids[end] = last[node]
            node = back[node]
        return ids, starts

    def _propagate(self, depth: list[int], byte: list[int]) -> tuple[list[int], list[int]]:
        """Last token of every prefix, and the node of the prefix before that token."""
        arc, fail, ends, shorter, length, verdicts, stable = self.arc, self.fail, self.ends, self.shorter, self.length, self.verdicts, self.stable
        top = max(depth) + 1
        state, token, path = [0] * top, [-1] * top, [0] * top  # of the walk's current path, by depth
        last, back = [0] * len(depth), [0] * len(depth)
        for node in range(1, len(depth)):
            d, b = depth[node], byte[node]
            s = state[d - 1]
            while (n := arc.get(s << 8 | b)) is None and s:
                s = fail[s]
            state[d] = s = n or 0
            t = ends[s]
            while True:
                e = d - length[t]
                before = token[e]
                if before < 0:
                    break
                good = verdicts.get(before << 32 | t)
                if good is None:
                    good = stable(before, t)
                if good:
                    break
                t = shorter[t]
            token[d] = last[node] = t
            path[d] = node
            back[node] = path[e]
        return last, back

    def decode(self, ids: np.ndarray) -> str:
        n = self.token_at[ids + 1] - self.token_at[ids]
        ends = np.cumsum(n)
        at = np.repeat(self.token_at[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        return self.token_bytes[at].tobytes().decode("utf-8", "replace")


def insert(words: list[bytes]) -> tuple[list[int], list[int], np.ndarray]:
    """Trie of words: depth and byte of the nodes in depth first order (node 0 is the root), and the node of every word."""
    depth, byte, home = [0], [0], np.zeros(len(words), np.int64)
    path, before = [0], b""
    for i in sorted(range(len(words)), key=words.__getitem__):
        w = words[i]
        k, most = 0, min(len(before), len(w))
        while k < most and before[k] == w[k]:
            k += 1
        del path[k + 1:]
        for d in range(k, len(w)):
            path.append(len(depth))
            depth.append(d + 1)
            byte.append(w[d])
        home[i], before = path[-1], w
    return depth, byte, home


_LOADED: dict[str, Bpe] = {}


def load(file: str) -> Bpe:
    """The model of this worker process."""
    if file not in _LOADED:
        _LOADED.clear()
        _LOADED[file] = Bpe(file)
    return _LOADED[file]


class Encoder:
    """Word numbers of documents, chunk by chunk, and the store of encodings."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.find = bpe, regex.compile(PATTERN).findall
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {w: k for k, w in enumerate(self.bpe.added)}
        self.ids = np.fromiter(self.bpe.added.values(), np.uint32, len(self.number))
        self.starts = np.arange(len(self.number) + 1)
        self.long = False

    def words(self, text: str) -> np.ndarray:
        """Numbers of the pre-tokens of a text; added tokens stand for themselves."""
        number, cut = self.number, self.bpe.cut
        if cut is None or not cut.search(text):
            tokens = self.find(text)
        else:
            tokens, at = [], 0
            for m in cut.finditer(text):
                tokens += [*self.find(text[at:m.start()]), m.group()]
                at = m.end()
            tokens += self.find(text[at:])
        self.long = self.long or any(len(w) > STORE_BYTES for w in tokens)
        return np.fromiter((number.setdefault(w, len(number)) for w in tokens), np.int32, len(tokens))

    def finish(self) -> None:
        """Encode the words that came since the last call."""
        known = len(self.starts) - 1
        new = [w.encode("utf-8", "surrogatepass") for w in list(self.number)[known:]]
        if new:
            ids, starts = self.bpe.encode_words(new)
            self.ids = np.concatenate([self.ids, ids])
            self.starts = np.concatenate([self.starts, self.starts[-1] + starts[1:]])

    def ids_of(self, words: np.ndarray) -> np.ndarray:
        n = self.starts[words + 1] - self.starts[words]
        ends = np.cumsum(n)
        return self.ids[np.repeat(self.starts[words] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


def _code(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(SparkFiles.get(name))
        enc, held, total = Encoder(bpe), [], 0

        def out():
            enc.finish()
            rows, size = [], 0
            for doc_id, words in held:
                ids = enc.ids_of(words)
                rows.append((doc_id, len(ids), ids.astype("<u4").tobytes(), bpe.decode(ids.astype(np.int64))))
                size += 5 * len(ids) + len(rows[-1][3])
                if size >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)
            held.clear()
            if len(enc.number) > STORE_WORDS or enc.long:
                enc.clear()

        for doc_id, text in flat(batches):
            held.append((doc_id, enc.words(text)))
            total += len(held[-1][1]) + 1
            if total >= CHUNK_WORDS:
                yield from out()
                total = 0
        yield from out()
    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    ids, n, packed, text = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(packed, pa.binary()),
                                       pa.array(text, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])


def encode_documents(docs: DataFrame, tokenizer_file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids as little-endian unsigned 32-bit integers, and the text they decode to."""
    spark = docs.sparkSession
    prepare_session(spark)
    spark.sparkContext.addFile(tokenizer_file)
    d = pick(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return d.mapInArrow(_code(os.path.basename(tokenizer_file)), "doc_id bigint, n_tokens bigint, ids binary, decoded string")
