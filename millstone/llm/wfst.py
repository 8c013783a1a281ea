"""Operator 7: SentencePiece encoding and decoding by weighted transduction.

A model file is compiled into machines whose states and arcs lie in arrays:

* the normaliser: white space to the piece marker, runs of it to one, dummy prefix (two states, run by string functions);
* the lexicon: the closure of the piece trie (any number of pieces in a row), made deterministic by failure arcs: a state stands for
  all trie states that a prefix may be in, and knows the longest piece that ends there; ``shorter`` leads to
  the next one. A final arc writes the piece's id and costs minus its score;
* byte fallback: a character that is no piece of its own has an arc that writes its byte pieces (or the unknown piece) at the penalty;
* for BPE models a context machine, which reads consecutive pieces and gives weight 0 when the two, merged on
  their own, stay as they are, and infinity otherwise. A sequence of pieces is the model's own segmentation exactly when every neighbouring pair
  passes, and every prefix of an input has one such sequence; so one state per prefix keeps a finite weight. Unigram models
  have none: every sequence is allowed, weights are costs.

Inputs are composed with the machines lazily. The distinct segments of a chunk of documents form one input automaton, a trie, so
common beginnings are composed once; its nodes are taken depth first, which is a topological order of the composition, and
each keeps the least weight in the tropical semiring (min, +) with a link to the node its last piece begins at. Of equal weights the longer piece
wins, as in the library. The path of a segment is read off its links.

No piece of the lexicon of a BPE model holds a marker after another character (checked when
compiling), so arcs never cross from a word into the next one's marker, and texts are cut there into segments. Unigram models
take a text as one segment. Segments may be of any length; the work is linear in it.

Decoding writes the bytes of the pieces. Every distinct segment is decoded and compared once; a text comes back exactly when all its segments do.

Defined results: null text is empty and has no ids; an empty table gives no rows;
repeated rows and null ids are encoded row by row. ``round_trip`` compares the decoded
text with the text as the normaliser leaves it. Models with a precompiled character map, with white space as suffix or with user-defined pieces raise ValueError.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millstone.llm.common import flat, pick, prepare_session

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNK_PENALTY = 10.0
CHUNK_SEGMENTS = 500_000   # segments of a chunk of documents
CHUNK_CHARS = 8_000_000    # and characters
STORE_SEGMENTS = 200_000   # encodings kept between chunks
PAIRS = 400_000            # context verdicts kept per worker
CHAR_BITS = 21
INF = float("inf")


def _varint(b: bytes, i: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[i]
        i += 1
        n |= (x & 127) << shift
        shift += 7
        if x < 128:
            return n, i


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            v, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            v, i = b[i:i + n], i + n
        else:
            n = 4 if kind == 5 else 8
            v, i = struct.unpack("<f" if kind == 5 else "<d", b[i:i + n])[0], i + n
        yield key >> 3, v


class Transducer:
    """The compiled machines of one model file."""

    def __init__(self, model: bytes):
        pieces, trainer, normaliser = [], {}, {}
        for n, v in _fields(model):
            if n == 1:
                p = dict(_fields(v))
                pieces.append((p[1].decode(), p.get(2, 0.0), p.get(3, NORMAL)))
            elif n == 2:
                trainer = dict(_fields(v))
            elif n == 3:
                normaliser = dict(_fields(v))
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE) or normaliser.get(2) or trainer.get(24):
            raise ValueError("only unigram and BPE models with an identity character map and prefix markers")
        if any(kind == USER for _, _, kind in pieces):
            raise ValueError("models with user-defined pieces are not handled")
        self.dummy, self.squeeze, self.escape = normaliser.get(3, 1), normaliser.get(4, 1), normaliser.get(5, 1)
        self.unk = [k for _, _, k in pieces].index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.size = len(pieces)
        raw = [b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else bytes([int(p[3:5], 16)]) if k == BYTE
               else p.encode() for p, _, k in pieces]
        self.raw_at = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        # symbols of paths: pieces by id, then characters outside the lexicon as they are met
        self.ids = {p: i for i, (p, _, k) in enumerate(pieces) if k == NORMAL}
        self.text = [p for p, _, _ in pieces]
        self.length = [len(p) for p in self.text]
        self.cost = {p: -s for p, s, k in pieces if k == NORMAL}
        self.weight = [np.float32(-s) for _, s, _ in pieces]
        self.penalty = np.float32(max(self.cost.values(), default=0.0) + UNK_PENALTY)
        self.emits: list[tuple[int, ...]] = [(i,) for i in range(self.size)]
        self.chars: dict[str, int] = {p: i for p, i in self.ids.items() if len(p) == 1}
        self.verdicts: dict[int, bool] = {}
        words = all(MARK not in p.lstrip(MARK) for p in self.ids)
        self.cut = regex.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall if words and self.kind == BPE else lambda t: [t] if t else []
        self._lexicon()

    def _lexicon(self) -> None:
        """The piece trie with failure arcs: arcs by (state, character), and by state the longest piece that ends there."""
        arc: dict[int, int] = {}
        below: list[list[tuple[int, int]]] = [[]]
        own: dict[int, int] = {}
        for p, i in self.ids.items():
            if self.kind == BPE and not self._whole(p):
                continue  # the context machine gives it no finite weight anywhere
            s = 0
            for c in map(ord, p):
                n = arc.get(s << CHAR_BITS | c)
                if n is None:
                    n = arc[s << CHAR_BITS | c] = len(below)
                    below[s].append((c, n))
                    below.append([])
                s = n
            own[s] = i
        fail, ends, self.shorter = [0] * len(below), [-1] * len(below), [-1] * self.size
        level = [0]
        while level:
            deeper = []
            for s in level:
                for c, n in below[s]:
                    f = fail[s]
                    while f and f << CHAR_BITS | c not in arc:
                        f = fail[f]
                    fail[n] = arc.get(f << CHAR_BITS | c, 0) if s else 0
                    i = own.get(n)
                    if i is None:
                        ends[n] = ends[fail[n]]
                    else:
                        ends[n], self.shorter[i] = i, ends[fail[n]]
                    deeper.append(n)
            level = deeper
        self.arc, self.fail, self.ends = arc, fail, ends

    def _char(self, c: str) -> int:
        """Symbol of a single character: its piece, or a byte-fallback arc."""
        got = self.chars.get(c)
        if got is None:
            got = self.chars[c] = len(self.text)
            self.text.append(c)
            self.length.append(1)
            self.weight.append(self.penalty)
            self.emits.append(tuple(self.bytes[b] for b in c.encode("utf-8", "surrogatepass")) if self.bytes else (self.unk,))
        return got

    # normaliser machine
    def normalise(self, text: str) -> str:
        if not text:
            return ""
        if self.squeeze:
            text = regex.sub(" +", " ", text).strip(" ")
            if not text:
                return ""
        if self.dummy:
            text = " " + text
        return text.replace(" ", MARK) if self.escape else text

    # context machine
    def stays(self, a: int, b: int) -> bool:
        """Weight 0 (True) when merging the two symbols' characters on their own ends in exactly these two."""
        key = a << 32 | b
        got = self.verdicts.get(key)
        if got is None:
            if len(self.verdicts) >= PAIRS:
                self.verdicts.clear()
            got = self.verdicts[key] = self._merge(self.text[a], self.text[b])
        return got

    def _merge(self, a: str, b: str) -> bool:
        s, left, get = list(a + b), len(a), self.cost.get
        costs = [get(x + y, INF) for x, y in zip(s, s[1:])]
        while costs:
            c = min(costs)
            if c == INF:
                break
            k = costs.index(c)
            if k == left - 1:
                return False  # the merge joins the two pieces
            left -= k < left
            s[k:k + 2] = [s[k] + s[k + 1]]
            del costs[k]
            if k:
                costs[k - 1] = get(s[k - 1] + s[k], INF)
            if k < len(costs):
                costs[k] = get(s[k] + s[k + 1], INF)
        return left == 1 and len(s) == 2

    def _whole(self, p: str) -> bool:
        """A piece stands alone when merging its characters gives it back."""
        s, get = list(p), self.cost.get
        while len(s) > 1:
            c, k = min((get(s[i] + s[i + 1], INF), i) for i in range(len(s) - 1))
            if c == INF:
                return False
            s[k:k + 2] = [s[k] + s[k + 1]]
        return True

    # composition and shortest path
    def encode_segments(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments one after another, and where each begins (one place more than segments)."""
        depth, char, home = insert(segments)
        last, back = (self._context_paths if self.kind == BPE else self._cheapest_paths)(depth, char)
        steps = [0] * len(last)
        for n in range(1, len(last)):
            steps[n] = steps[back[n]] + 1
        last, back = np.array(last), np.array(back)
        starts = np.concatenate([[0], np.cumsum(np.array(steps)[home])]).astype(np.int64)
        path, node, end = np.empty(starts[-1], np.int64), home, starts[1:].copy()
        while len(node):
            alive = node > 0
            node, end = node[alive], end[alive] - 1
            path[end] = last[node]
            node = back[node]
        # symbols to ids: characters may write several
        used, at = np.unique(path, return_inverse=True)
        lens = np.array([len(self.emits[u]) for u in used.tolist()], np.int64)
        table = np.array([i for u in used.tolist() for i in self.emits[u]], np.int32)
        n = lens[at]
        ends = np.cumsum(n)
        first = (np.cumsum(lens) - lens)[at]
        total = int(ends[-1]) if len(ends) else 0
        ids = table[np.repeat(first - (ends - n), n) + np.arange(total)]
        return ids, np.concatenate([[0], ends])[starts]

    def _context_paths(self, depth: list[int], char: list[str]) -> tuple[list[int], list[int]]:
        """BPE: the symbol that the one path of finite weight ends with at every node, and the node where it begins."""
        arc, fail, ends, shorter, length, verdicts, stays, one = (
            self.arc, self.fail, self.ends, self.shorter, self.length, self.verdicts, self.stays, self.chars)
        top = max(depth) + 1
        state, symbol, path = [0] * top, [-1] * top, [0] * top
        last, back = [0] * len(depth), [0] * len(depth)
        for node in range(1, len(depth)):
            d, c = depth[node], char[node]
            s, o = state[d - 1], ord(c)
            while (n := arc.get(s << CHAR_BITS | o)) is None and s:
                s = fail[s]
            state[d] = s = n or 0
            t = ends[s]
            while t >= 0:
                e = d - length[t]
                before = symbol[e]
                if before < 0:
                    break
                good = verdicts.get(before << 32 | t)
                if good is None:
                    good = stays(before, t)
                if good:
                    break
                t = shorter[t]
            if t < 0:  # no piece ends here: the fallback arc of the character
                t, e = one.get(c), d - 1
                if t is None:
                    t = self._char(c)
            symbol[d] = last[node] = t
            path[d] = node
            back[node] = path[e]
        return last, back

    def _cheapest_paths(self, depth: list[int], char: list[str]) -> tuple[list[int], list[int]]:
        """Unigram: the last symbol of the cheapest path to every node, and the node where it begins. Weights are added in
        single precision, as the library does."""
        arc, fail, ends, shorter, length, weight = self.arc, self.fail, self.ends, self.shorter, self.length, self.weight
        top = max(depth) + 1
        state, best, path = [0] * top, [np.float32(0)] * top, [0] * top
        last, back = [0] * len(depth), [0] * len(depth)
        for node in range(1, len(depth)):
            d, c = depth[node], char[node]
            s, o = state[d - 1], ord(c)
            while (n := arc.get(s << CHAR_BITS | o)) is None and s:
                s = fail[s]
            state[d] = s = n or 0
            t, least, alone = ends[s], None, False
            while t >= 0:
                w = best[d - length[t]] + weight[t]
                if least is None or w < least:
                    least, last[node] = w, t
                alone = alone or length[t] == 1
                t = shorter[t]
            if not alone:
                u = self._char(c)
                w = best[d - 1] + weight[u]
                if least is None or w < least:
                    least, last[node] = w, u
            best[d] = least
            path[d] = node
            back[node] = path[d - length[last[node]]]
        return last, back

    def encode(self, text: str) -> list[int]:
        e = Encoder(self)
        n = e.segments(text)
        e.finish()
        return e.ids_of(n).tolist()

    def raw_of(self, ids: np.ndarray) -> bytes:
        """The bytes of pieces one after another."""
        n = self.raw_at[ids + 1] - self.raw_at[ids]
        ends = np.cumsum(n)
        return self.raw[np.repeat(self.raw_at[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()

    def decode(self, ids: list[int]) -> str:
        """Pieces back to text: bytes joined as UTF-8, marker to blank, dummy prefix removed."""
        text = self.raw_of(np.array(ids, np.int64)).decode("utf-8", "replace")
        if self.escape:
            text = text.replace(MARK, " ")
        return text[1:] if self.dummy and text.startswith(" ") else text


def insert(segments: list[str]) -> tuple[list[int], list[str], np.ndarray]:
    """The input automaton: depth and character of the nodes of a trie in depth first order (node 0 is the start), and
    the node of every segment."""
    depth, char, home = [0], [""], np.zeros(len(segments), np.int64)
    path, before = [0], ""
    for i in sorted(range(len(segments)), key=segments.__getitem__):
        w = segments[i]
        k, most = 0, min(len(before), len(w))
        while k < most and before[k] == w[k]:
            k += 1
        del path[k + 1:]
        for d in range(k, len(w)):
            path.append(len(depth))
            depth.append(d + 1)
            char.append(w[d])
        home[i], before = path[-1], w
    return depth, char, home


class Encoder:
    """Segment numbers of documents, chunk by chunk, and the store of encodings with their round trips."""

    def __init__(self, t: Transducer):
        self.t = t
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.starts, self.back = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, bool)

    def segments(self, text: str) -> np.ndarray:
        number = self.number
        cut = self.t.cut(self.t.normalise(text))
        return np.fromiter((number.setdefault(s, len(number)) for s in cut), np.int32, len(cut))

    def finish(self) -> None:
        """Encode the segments that came since the last call, and decode them again."""
        new = list(self.number)[len(self.back):]
        if new:
            ids, starts = self.t.encode_segments(new)
            raw, at = self.t.raw_of(ids.astype(np.int64)), np.concatenate([[0], np.cumsum(self.t.raw_at[ids + 1] - self.t.raw_at[ids])])[starts].tolist()
            # a piece of a text is exact when its bytes are
            back = np.array([raw[i:j] == s.encode("utf-8", "surrogatepass") for s, i, j in zip(new, at, at[1:])])
            self.ids = np.concatenate([self.ids, ids])
            self.starts = np.concatenate([self.starts, self.starts[-1] + starts[1:]])
            self.back = np.concatenate([self.back, back])

    def ids_of(self, segments: np.ndarray) -> np.ndarray:
        n = self.starts[segments + 1] - self.starts[segments]
        ends = np.cumsum(n)
        ids = self.ids[np.repeat(self.starts[segments] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        if self.t.bytes or not len(ids):
            return ids
        unknown = ids == self.t.unk  # a run of unknown characters is one unknown piece
        return ids[~unknown | np.append(True, ~unknown[:-1])]


_LOADED: dict[str, Transducer] = {}


def transducer(file: str) -> Transducer:
    """The compiled model of this worker process."""
    if file not in _LOADED:
        _LOADED.clear()
        with open(file, "rb") as f:
            _LOADED[file] = Transducer(f.read())
    return _LOADED[file]


def _code(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, held, total, chars = Encoder(transducer(SparkFiles.get(name))), [], 0, 0

        def out():
            enc.finish()
            ids = [enc.ids_of(s) for _, s in held]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            batch = pa.RecordBatch.from_arrays([
                pa.array([i for i, _ in held], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))),
                pa.array([bool(enc.back[s].all()) for _, s in held])], names=["doc_id", "ids", "round_trip"])
            held.clear()
            if len(enc.number) > STORE_SEGMENTS or chars >= CHUNK_CHARS:
                enc.clear()
            return batch

        for doc_id, text in flat(batches):
            held.append((doc_id, enc.segments(text)))
            total += len(held[-1][1]) + 1
            chars += len(text)
            if total >= CHUNK_SEGMENTS or chars >= CHUNK_CHARS:
                yield out()
                total = chars = 0
        if held:
            yield out()
    return run


def encode_documents(docs: DataFrame, model_file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip) of every document."""
    spark = docs.sparkSession
    prepare_session(spark)
    spark.sparkContext.addFile(model_file)
    d = pick(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    out = d.mapInArrow(_code(os.path.basename(model_file)), "doc_id bigint, ids array<int>, round_trip boolean")
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "round_trip")
