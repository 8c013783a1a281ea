"""Byte-level BPE against the public `tokenizers` library."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millstone import settings as S
from millstone.functions.bytelevel import pretokens
from millstone.functions.bpe_codec import _merge_long, merge_word
from millstone.operators.bpe import Tokenizer, settle, train_bpe, word_counts
from millstone.sources.tokenizer_store import (load_tokenizer, load_tokenizer_file, model_of_json, save_tokenizer,
                                               save_tokenizer_file, tokenizer_json)

tokenizers = pytest.importorskip("tokenizers")


def _hf(texts, vocab_size, specials):
    from tokenizers import Tokenizer as HT
    from tokenizers import models, pre_tokenizers, trainers

    t = HT(models.BPE(unk_token="[UNK]"))
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    t.train_from_iterator(texts, trainer=trainers.BpeTrainer(vocab_size=vocab_size, special_tokens=specials,
                                                              show_progress=False))
    return t


def test_fixture_vocab_and_encode(spark):
    texts = ["abab ab ab", "low lower lowest"]
    specials = ["[UNK]", "[CLS]", "<|endoftext|>"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    m = train_bpe(word_counts(df), 40, specials=specials)
    assert m.vocab[:3] == specials
    assert m.vocab[3:13] == list("abelorstw") + ["Ġ"]
    assert m.vocab[13:] == ["ab", "lo", "low", "Ġab", "Ġlow", "Ġlowe", "st", "abab", "Ġlower", "Ġlowest"]
    tok = Tokenizer(m)
    r = spark.createDataFrame([("ab lowz q",)], "t string").select(
        tok.encode("t").alias("ids")).first()
    assert list(r.ids) == [13, 17, 0, 12, 0]
    raw = spark.createDataFrame([([13, 17, 0, 12, 0],)], "ids array<int>").select(
        tok.decode("ids", raw=True).alias("d")).first().d
    assert raw == "ab Ġlow [UNK] Ġ [UNK]"


def test_pretokens_fixture(spark):
    got = spark.createDataFrame([("it's 12  가나 x!\n\n y",)], "t string").select(pretokens("t").alias("p")).first().p
    assert got == ["it", "'s", " 12", " ", " 가나", " x", "!", "\n\n", " y"]


def test_train_and_encode_equal_tokenizers(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(12)
    texts = [r.text for r in docs.collect()]
    hf = _hf(texts, 3000, S.SPECIAL_TOKENS)
    hv = hf.get_vocab()
    m = train_bpe(word_counts(docs), 3000)
    assert m.vocab == sorted(hv, key=hv.get)
    hm = json.loads(hf.to_str())["model"]["merges"]
    hm = [x if isinstance(x, list) else x.split(" ") for x in hm]
    assert [[m.vocab[a], m.vocab[b]] for a, b, _ in m.merges] == hm
    tok = Tokenizer(m)
    enc = docs.select("text", tok.encode("text").alias("ids"), tok.decode(tok.encode("text")).alias("dec")).collect()
    for r in enc:
        assert list(r.ids) == hf.encode(r.text).ids
        assert r.dec == r.text
    s = "x <|endoftext|> [UNK]y"
    got = spark.createDataFrame([(s,)], "t string").select(tok.encode("t").alias("i")).first().i
    assert list(got) == hf.encode(s).ids
    assert tok.model.eos_id == 5


def test_settle_stops_at_the_last_candidate():
    def run(last, size=20, vocab=("a", "b", "c", "d")):
        vocab = list(vocab)
        return settle([([0, 1, 0, 1], 5), ([2, 3], 7)], last, vocab, {t: i for i, t in enumerate(vocab)}, size)

    # (a, b) 10 times, then (c, d) 7, then (ab, ab) 5, which only the fragments know
    assert run((-5, 9, 9)) == [(0, 1, 4), (2, 3, 5), (4, 4, 6)]
    assert run((-7, 2, 3)) == [(0, 1, 4), (2, 3, 5)]
    assert run((-7, 2, 2)) == [(0, 1, 4)]          # (c, d) lies behind the last candidate
    assert run((-5, 9, 9), 5) == [(0, 1, 4)]       # the vocabulary is full
    # a string that is a token already keeps its id and ends the round
    assert run((-1, 0, 0), 9, ("a", "b", "c", "d", "ab")) == [(0, 1, 4)]


def _one_by_one(words, vocab_size, specials):
    """Merge after merge, every pair counted anew."""
    from millstone.functions.bytelevel import GLYPHS

    vocab = specials + sorted({GLYPHS[b] for w in words for b in w.encode()})
    segs = {w: [vocab.index(GLYPHS[b]) for b in w.encode()] for w in words}
    merges = []
    while len(vocab) < vocab_size:
        c = Counter()
        for w, s in segs.items():
            for p in zip(s, s[1:]):
                c[p] += words[w]
        if not c:
            break
        a, b = min(c, key=lambda p: (-c[p], p))
        t = vocab[a] + vocab[b]
        if t not in vocab:
            vocab.append(t)
        merges.append((a, b, vocab.index(t)))
        segs = {w: merge_word(s, {(a, b): (0, vocab.index(t))}) for w, s in segs.items()}
    return vocab, merges


@pytest.mark.parametrize("bounds", [{}, {"candidates": 5}, {"fragment_symbols": 12}])
def test_rounds_equal_one_merge_after_another(spark, bounds):
    """Few letters, many ties, runs of one letter, merges that meet an existing string."""
    rnd = random.Random(len(bounds) + 4)
    words = {"".join(rnd.choice("aab") for _ in range(rnd.randrange(1, 14))): rnd.randrange(1, 5) for _ in range(60)}
    words |= {"a" * 40: 3, "ab" * 25: 2, "é漢": 1, "cab": 9, "bca": 9, "abc": 9}
    df = spark.createDataFrame(list(words.items()), "word string, freq long")
    m = train_bpe(df, 90, specials=["[UNK]", "ab"], **bounds)
    vocab, merges = _one_by_one(words, 90, ["[UNK]", "ab"])
    assert m.vocab == vocab and m.merges == merges


def test_training_resumes(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(10)
    words = word_counts(docs).cache()
    whole = train_bpe(words, 1200, candidates=300)
    state = str(tmp_path / "state")
    part = train_bpe(words, 1200, candidates=300, state=state, max_rounds=2)
    assert len(part.vocab) < 1200 and part.merges == whole.merges[:len(part.merges)]
    rest = train_bpe(words, 1200, candidates=300, state=state)
    assert rest.vocab == whole.vocab and rest.merges == whole.merges and rest.rounds == whole.rounds - 2
    assert train_bpe(words.limit(0), 50, specials=["x"]).vocab == ["x"]


def test_long_words_merge_like_short_ones():
    rnd = random.Random(2)
    ranks = {}
    for r in range(60):
        ranks.setdefault((rnd.randrange(4 + r), rnd.randrange(4 + r)), (r, 4 + r))
    for n in (0, 1, 2, 5, 30):
        for _ in range(50):
            w = [rnd.randrange(4) for _ in range(n)]
            assert _merge_long(w, ranks) == merge_word(w, ranks)


def test_tokenizer_store_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([("abab ab ab",), ("low lower lowest",)], "text string")
    m = train_bpe(word_counts(df), 30)
    assert load_tokenizer(spark, str(tmp_path / "missing")) is None
    save_tokenizer(spark, m, str(tmp_path / "tok"))
    m2 = load_tokenizer(spark, str(tmp_path / "tok"))
    assert m2.vocab == m.vocab and m2.merges == m.merges and m2.specials == m.specials


def test_tokenizer_file_of_the_library(spark, tmp_path):
    from tokenizers import Tokenizer as HT

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(10)
    m = train_bpe(word_counts(docs), 900)
    path = str(tmp_path / "new" / "tokenizer.json")
    assert load_tokenizer_file(spark, path) is None
    save_tokenizer_file(spark, m, path)
    hf, back = HT.from_file(path), load_tokenizer_file(spark, path)
    assert (back.vocab, back.merges, back.specials, back.unk) == (m.vocab, m.merges, m.specials, m.unk)
    tok = Tokenizer(m)
    for r in docs.select("text", tok.encode("text").alias("ids")).collect():
        assert list(r.ids) == hf.encode(r.text).ids
        assert hf.decode(list(r.ids)) == r.text
    # files that the library writes are read
    hf.save(path)
    assert load_tokenizer_file(spark, path).merges == m.merges
    glyphs = spark.createDataFrame([([20, 30],)], "i array<int>").select(tok.decode("i", raw=True)).first()[0]
    assert HT.from_str(tokenizer_json(m, decoder=False)).decode([20, 30]) == glyphs
    with pytest.raises(ValueError):
        model_of_json('{"model": {"type": "WordPiece"}}')


def test_columns_of_a_codec_equal_its_words_and_rows(monkeypatch):
    """Arrow columns in slices give what the plain helpers give, and a repeated word is merged once."""
    import random

    import pyarrow as pa

    from millstone.functions import bpe_codec
    from millstone.functions.bytelevel import GLYPHS

    monkeypatch.setattr(bpe_codec, "SLICE", 7)
    vocab = ["[UNK]", "<|e|>", *sorted(GLYPHS), "th"]
    codec = bpe_codec.Codec(vocab, [(vocab.index("t"), vocab.index("h"), len(vocab) - 1)], ["[UNK]", "<|e|>"])
    rnd = random.Random(1)
    rows = [None if k % 11 == 0 else [rnd.choice(["the", "<|e|>", " é", "q", "", "thth"]) for _ in range(rnd.randrange(9))] for k in range(150)]
    ids = codec.encode_column(pa.array(rows, pa.list_(pa.string())))
    assert ids.to_pylist() == [None if r is None else codec.encode(r) for r in rows]
    assert codec.decode_column(ids).to_pylist() == [None if r is None else "".join(r) for r in rows]
    odd = ids.to_pylist() + [[rnd.randrange(-2, len(vocab) + 3) for _ in range(rnd.randrange(9))] for _ in range(150)]
    col = pa.array(odd, pa.list_(pa.int32()))
    for got, plain in ((codec.decode_column, codec.decode), (codec.tokens_column, codec.tokens),
                       (codec.raw_column, lambda r: codec.decode(r, raw=True))):
        assert got(col).to_pylist() == [None if r is None else plain(r) for r in odd]
    seen = []
    plain = codec.encode_word
    monkeypatch.setattr(codec, "encode_word", lambda w: seen.append(w) or plain(w))
    monkeypatch.setattr(bpe_codec, "SLICE", 1000)
    codec.encode_column(pa.array([["the"] * 50] * 10, pa.list_(pa.string())))
    assert seen == ["the"]


def test_texts_are_encoded_once_in_a_roundtrip(spark):
    """One evaluation of the encoder, whatever is made of the ids."""
    m = train_bpe(word_counts(spark.createDataFrame([("the other then",)], "text string")), 30)
    r = Tokenizer(m).roundtrip(spark.createDataFrame([(1, "the then"), (2, None)], "doc_id int, text string"))
    assert r._jdf.queryExecution().optimizedPlan().toString().count("encode_udf(") == 1
    assert {(x.doc_id, x.decoded, x.ok) for x in r.collect()} == {(1, "the then", True), (2, None, None)}


def test_merging_many_words_equals_one_by_one():
    import random

    import numpy as np

    from millstone.operators.bpe import PAIR_BITS, merge_words

    rnd = random.Random(5)
    merges = [(1, 1, 5), (1, 2, 6), (5, 5, 7), (6, 1, 8), (3, 3, 9), (9, 3, 10), (7, 1, 11), (2, 2, 1)]
    ranks = {(a, b): (r, c) for r, (a, b, c) in enumerate(merges)}
    words = [[rnd.randrange(1, 5) for _ in range(rnd.randrange(1, 30))] for _ in range(300)] + [[1] * 31, [3] * 9]
    pairs = np.array([a << PAIR_BITS | b for a, b, _ in merges], np.int64)
    o = np.argsort(pairs)
    got = [None] * len(words)
    for which, flat, size in merge_words(np.array([s for w in words for s in w], np.int32), np.array([len(w) for w in words]),
                                         pairs[o], o, np.array([c for *_, c in merges], np.int32)[o]):
        for k, part in zip(which.tolist(), np.split(flat, np.cumsum(size)[:-1])):
            got[k] = part.tolist()
    assert got == [merge_word(w, ranks) for w in words]
