"""BPE encode/decode helpers (run inside Arrow UDF batches).

Small by design: the model (vocabulary + ranked merges) is trained by
Spark jobs in ``operators.bpe``; this only applies it. Encoding merges each distinct
pre-token of a slice of rows once; ids, token strings and decoded bytes of the rows are then
gathered by Arrow and numpy from tables, so no Python object is made per token.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from millstone.functions.bytelevel import GLYPH_TO_BYTE, GLYPHS

SHORT = 32  # symbols up to which a plain scan beats the heap
SLICE = 1 << 18  # pre-tokens or ids that are worked on at a time, whatever the size of an Arrow batch


def merge_word(syms: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Apply merges ``(left, right) -> (rank, new)`` to a word, lowest rank first and
    leftmost first among equal ones, until none applies."""
    if len(syms) > SHORT:
        return _merge_long(syms, ranks)
    syms = list(syms)
    while len(syms) > 1:
        best = min((m for m in map(ranks.get, zip(syms, syms[1:])) if m is not None), default=None)
        if best is None:
            break
        out, i, new = [], 0, best[1]
        while i < len(syms):
            if i + 1 < len(syms) and ranks.get((syms[i], syms[i + 1])) == best:
                out.append(new)
                i += 2
            else:
                out.append(syms[i])
                i += 1
        syms = out
    return syms


def _merge_long(syms: list[int], ranks: dict) -> list[int]:
    """The same with a heap of (rank, place) over a linked list: n log n for a word of n symbols."""
    n = len(syms)
    syms, after, before = list(syms), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(*m, i) for i in range(n - 1) if (m := ranks.get((syms[i], syms[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        rank, new, i = heapq.heappop(heap)
        j = after[i]
        if syms[i] < 0 or j >= n or ranks.get((syms[i], syms[j])) != (rank, new):
            continue  # the pair is gone
        syms[i], syms[j] = new, -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            if (m := ranks.get((new, syms[after[i]]))) is not None:
                heapq.heappush(heap, (*m, i))
        if before[i] >= 0 and (m := ranks.get((syms[before[i]], new))) is not None:
            heapq.heappush(heap, (*m, before[i]))
    return [s for s in syms if s >= 0]


class Codec:
    def __init__(self, vocab: list[str], merges: list[tuple[int, int, int]], specials: list[str],
                 unk: str = "[UNK]", cache_size: int = 200_000):
        self.vocab = vocab
        self.tok2id: dict[str, int] = {}
        for i, t in enumerate(vocab):
            self.tok2id.setdefault(t, i)
        self.ranks = {(a, b): (r, c) for r, (a, b, c) in enumerate(merges)}
        self.specials = {s: self.tok2id[s] for s in specials if s in self.tok2id}
        self.special_ids = set(self.specials.values())
        self.unk = self.tok2id.get(unk, 0)
        self.cache: dict[str, list[int]] = {}
        self.cache_size = cache_size
        self._tables = None

    def encode_word(self, word: str) -> list[int]:
        hit = self.cache.get(word)
        if hit is not None:
            return hit
        sp = self.specials.get(word)
        if sp is not None:
            return [sp]
        syms = [self.tok2id.get(GLYPHS[b], self.unk) for b in word.encode("utf-8")]
        syms = merge_word(syms, self.ranks)
        if len(self.cache) >= self.cache_size:
            self.cache.clear()
        self.cache[word] = syms
        return syms

    def encode(self, words) -> list[int]:
        out: list[int] = []
        for w in words:
            out.extend(self.encode_word(w))
        return out

    def tokens(self, ids) -> list[str]:
        return [self.vocab[i] if 0 <= i < len(self.vocab) else self.vocab[self.unk] for i in ids]

    def decode(self, ids, raw: bool = False, skip_special: bool = False) -> str:
        toks = self.tokens(ids)
        if skip_special:
            toks = [t for i, t in zip(ids, toks) if i not in self.special_ids]
        if raw:
            return " ".join(toks)
        buf = bytearray()
        parts: list[str] = []
        for i, t in zip(ids, toks):
            if i in self.special_ids or t not in self.tok2id or any(c not in GLYPH_TO_BYTE for c in t):
                if buf:
                    parts.append(buf.decode("utf-8", errors="replace"))
                    buf = bytearray()
                parts.append(t)
            else:
                buf.extend(GLYPH_TO_BYTE[c] for c in t)
        if buf:
            parts.append(buf.decode("utf-8", errors="replace"))
        return "".join(parts)

    # -------------------------------------------------------------- Arrow columns

    def encode_column(self, words: pa.ListArray) -> pa.Array:
        """Pre-tokens (list<string>) -> ids (list<int32>)."""
        return _sliced(words, self._encode_slice, pa.list_(pa.int32()))

    def tokens_column(self, ids: pa.ListArray) -> pa.Array:
        """Ids -> token strings (list<string>)."""
        return _sliced(ids, self._tokens_slice, pa.list_(pa.string()))

    def raw_column(self, ids: pa.ListArray) -> pa.Array:
        """Ids -> token strings joined by blanks."""
        return _sliced(ids, lambda x: pc.binary_join(self._tokens_slice(x), " "), pa.string())

    def decode_column(self, ids: pa.ListArray) -> pa.Array:
        """Ids -> text."""
        return _sliced(ids, self._decode_slice, pa.string())

    def _encode_slice(self, words: pa.ListArray) -> pa.Array:
        d = words.flatten().dictionary_encode()
        found = [self.encode_word(w) for w in d.dictionary.to_pylist()]
        size = np.fromiter(map(len, found), np.int64, len(found))
        first = np.cumsum(size) - size
        table = np.fromiter((i for f in found for i in f), np.int32, int(size.sum()))
        which = d.indices.to_numpy()
        n = size[which]
        ends = np.cumsum(n)
        vals = table[np.arange(int(n.sum())) + np.repeat(first[which] - (ends - n), n)]
        return _lists(np.append(0, ends)[_ends(words)], pa.array(vals), words)

    def _table(self) -> tuple[pa.Array, pa.Array]:
        """Token strings and their bytes by id."""
        if self._tables is None:
            raw = [t.encode() if i in self.special_ids or any(c not in GLYPH_TO_BYTE for c in t)
                   else bytes(GLYPH_TO_BYTE[c] for c in t) for i, t in enumerate(self.vocab)]
            self._tables = pa.array(self.vocab, pa.string()), pa.array(raw, pa.binary())
        return self._tables

    def _known(self, ids: pa.ListArray) -> np.ndarray:
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        return np.where((flat >= 0) & (flat < len(self.vocab)), flat, self.unk)

    def _tokens_slice(self, ids: pa.ListArray) -> pa.Array:
        return _lists(_ends(ids), self._table()[0].take(pa.array(self._known(ids))), ids)

    def _decode_slice(self, ids: pa.ListArray) -> pa.Array:
        """The bytes of a row's tokens lie side by side in the gathered ones. A row whose bytes are no UTF-8 is decoded
        token by token, as special tokens end a run of bytes."""
        got = self._table()[1].take(pa.array(self._known(ids)))
        at = np.frombuffer(got.buffers()[1], np.int32)[got.offset:got.offset + len(got) + 1] if len(got) else np.zeros(1, np.int32)
        out = _texts(at[_ends(ids)], got.buffers()[2] if len(got) else pa.py_buffer(b""), ids)
        try:
            return out.cast(pa.string())
        except pa.ArrowInvalid:
            def text(b: bytes, row: list[int]) -> str:
                try:
                    return b.decode()
                except UnicodeDecodeError:
                    return self.decode(row)
            return pa.array([None if b is None else text(b, ids[k].as_py()) for k, b in enumerate(out.to_pylist())], pa.string())


def _ends(lists: pa.ListArray) -> np.ndarray:
    """0 and the end of every row among the flattened values; a null row has none."""
    return np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy()))


def _mask(rows: pa.Array) -> pa.Array | None:
    return rows.is_null() if rows.null_count else None


def _lists(ends: np.ndarray, values: pa.Array, rows: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=_mask(rows))


def _texts(ends: np.ndarray, data: pa.Buffer, rows: pa.Array) -> pa.Array:
    valid = None
    if rows.null_count:
        valid = pa.py_buffer(np.packbits(rows.is_valid().to_numpy(zero_copy_only=False), bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(rows), [valid, pa.py_buffer(ends.astype(np.int32).tobytes()), data])


def _sliced(lists: pa.ListArray, work, kind: pa.DataType) -> pa.Array:
    """``work`` over runs of rows of about ``SLICE`` values: what it holds besides its results is bounded."""
    group = _ends(lists)[:-1] // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(lists)]
    parts = [work(lists.slice(a, b - a)) for a, b in zip(cuts, cuts[1:]) if b > a]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


_CODECS: dict = {}


def shared_codec(key: str, payload) -> Codec:
    """One codec per model per Python worker process, kept across tasks
    (workers are reused), so the merge table is built once and the word
    cache stays warm."""
    c = _CODECS.get(key)
    if c is None:
        vocab, merges, specials, unk = payload() if callable(payload) else payload
        c = Codec(vocab, [tuple(m) for m in merges], specials, unk)
        if len(_CODECS) > 4:
            _CODECS.clear()
        _CODECS[key] = c
    return c
