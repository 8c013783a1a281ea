"""Queries K1-K9, A4-A6 and BPE packing."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millstone import settings as S
from millstone.functions.bytelevel import GLYPHS, UNICODE_WS_BODY, pretokens
from millstone.operators.bpe import Tokenizer, byte_pair_counts, train_bpe, word_counts
from millstone.operators.packing import pack
from millstone.operators.shuffle import tokenizer_training_docs
from millstone.plans.q_mix import SQL_PIPE, mixture
from millstone.plans.sqlfrag import q
from millstone.plans.registry import register
from millstone.sources.tables import read_table
from millstone.session import scratch_path
from millstone.sources.tokenizer_store import load_tokenizer, load_tokenizer_file, save_tokenizer, save_tokenizer_file

_MODELS: dict = {}


def _docs(spark, sf):
    return read_table(spark, sf, "documents")


# Queries from K4 on train to the whole vocabulary (32,000 tokens). SQL takes one recursive step a merge, too slow for
# that, so they have no oracle; tests/test_bpe_sql.py compares them with that SQL at 320 tokens, tests/test_bpe.py with
# the ``tokenizers`` library.

# RE2 has no lookahead: the oracle drops the ``\s+(?!\S)`` branch and spells
# Unicode whitespace out.
_WS = f"[{UNICODE_WS_BODY}]"
_PRE_SQL = (f"('s|'t|'re|'ve|'m|'ll|'d| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{UNICODE_WS_BODY}\\p{{L}}\\p{{N}}]+|{_WS}+)")


def _k1(spark, sf):
    d = _docs(spark, sf).select("doc_id", F.posexplode(pretokens("text")).alias("pos", "token"))
    return d.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "token")


register("k1_pretokens", f"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, {q(_PRE_SQL)}, 1) AS toks FROM documents)
SELECT doc_id, CAST(generate_subscripts(toks, 1) - 1 AS BIGINT) AS pos, unnest(toks) AS token FROM t""")(_k1)

_WC_SQL = f"""wc AS (SELECT word, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(text, {q(_PRE_SQL)}, 1)) AS word
         FROM documents) GROUP BY word)"""

register("k2_word_counts", f"WITH {_WC_SQL} SELECT word, freq FROM wc")(
    lambda spark, sf: word_counts(_docs(spark, sf)))

register("k3_pair_counts", f"""WITH {_WC_SQL},
hx AS (SELECT hex(encode(word)) AS h, freq FROM wc WHERE length(hex(encode(word))) >= 4),
pr AS (SELECT h, freq, unnest(range(0, length(h) // 2 - 1)) AS i FROM hx)
SELECT CAST(('0x' || substr(h, 2 * i + 1, 2)) AS INTEGER) AS "left", CAST(('0x' || substr(h, 2 * i + 3, 2)) AS INTEGER) AS "right",
       sum(freq) AS pair_count FROM pr GROUP BY 1, 2""")(
    lambda spark, sf: byte_pair_counts(word_counts(_docs(spark, sf))))


def trained_model(spark, sf, vocab_size: int = S.VOCAB_SIZE, mixed=None):
    """K4 on the tokenizer training documents of the mixture (H5 + C3).

    Trained from the documents; queries of one session share the model as long
    as the input files are the same ones (names, sizes and times). ``mixed`` is the mixture where the caller has written it."""
    files = (spark.read.format("binaryFile").load(_docs(spark, sf).inputFiles())
             .agg(F.count("*"), F.sum("length"), F.max("modificationTime"), F.sum(F.xxhash64("path", "modificationTime").cast("decimal(38,0)"))))
    key = (sf, vocab_size, id(spark.sparkContext._jsc), tuple(files.first()))
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = train_bpe(word_counts(tokenizer_training_docs(mixture(spark, sf) if mixed is None else mixed)), vocab_size)
    return _MODELS[key]


def _a4(spark, sf, vocab_size=S.VOCAB_SIZE):
    """A4 + A5: the trained tokenizer, saved to the shared folder and loaded again."""
    m = trained_model(spark, sf, vocab_size)
    back = load_tokenizer(spark, save_tokenizer(spark, m, scratch_path(spark, f"millstone/tokenizer-{uuid.uuid4().hex[:12]}")))
    return _loaded(spark, m, back)


def _loaded(spark, m, back):
    rows = [(i, t, t == m.vocab[i], t in back.specials, t == back.unk) for i, t in enumerate(back.vocab)]
    return spark.createDataFrame(rows, "token_id int, token string, same boolean, is_special boolean, is_unk boolean")


register("a4_a5_tokenizer_store")(_a4)


def _a4_file(spark, sf, vocab_size=S.VOCAB_SIZE):
    """A4 + A5 through the library's file form."""
    m = trained_model(spark, sf, vocab_size)
    back = load_tokenizer_file(spark, save_tokenizer_file(spark, m, scratch_path(spark, f"millstone/tokenizer-{uuid.uuid4().hex[:12]}.json")))
    return _loaded(spark, m, back)


register("a4_a5_tokenizer_file")(_a4_file)


def _k4(spark, sf, vocab_size=S.VOCAB_SIZE):
    m = trained_model(spark, sf, vocab_size)
    rows = [(r, a, b, c, m.vocab[c]) for r, (a, b, c) in enumerate(m.merges)]
    return spark.createDataFrame(rows, "rank int, left_id int, right_id int, new_id int, token string")


register("k4_train_bpe")(_k4)


def _k4_vocab(spark, sf, vocab_size=S.VOCAB_SIZE):
    m = trained_model(spark, sf, vocab_size)
    return spark.createDataFrame([(i, t) for i, t in enumerate(m.vocab)], "token_id int, token string")


register("k4_vocab")(_k4_vocab)


def _encoded(spark, sf, vocab_size=S.VOCAB_SIZE):
    mx = mixture(spark, sf).select("position", "doc_id", "text")
    tok = Tokenizer(trained_model(spark, sf, vocab_size, mx))
    return tok, tok.encode_docs(mx)


def _ids_str(c):
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(c.cast("array<string>"), " ")


def _k5(spark, sf, vocab_size=S.VOCAB_SIZE):
    _, e = _encoded(spark, sf, vocab_size)
    return e.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), _ids_str("ids").alias("ids"))


register("k5_encode")(_k5)


def _k6(spark, sf, vocab_size=S.VOCAB_SIZE):
    tok, e = _encoded(spark, sf, vocab_size)
    return e.select("doc_id", tok.decode("ids").alias("decoded"),
                    (tok.decode("ids") == F.col("text")).alias("ok"))


register("k6_decode", f"WITH {SQL_PIPE} SELECT doc_id, text AS decoded, true AS ok FROM sh")(_k6)


def _k6_raw(spark, sf, vocab_size=S.VOCAB_SIZE):
    tok, e = _encoded(spark, sf, vocab_size)
    return e.select("doc_id", tok.decode("ids", raw=True).alias("decoded_raw"))


register("k6_decode_raw")(_k6_raw)


def _k7(spark, sf, vocab_size=S.VOCAB_SIZE):
    tok, e = _encoded(spark, sf, vocab_size)
    return e.select("doc_id", F.array_join(tok.ids_to_tokens("ids"), " ").alias("subwords"))


register("k7_ids_to_tokens")(_k7)


def _k8(spark, sf, vocab_size=S.VOCAB_SIZE):
    mx = mixture(spark, sf).select("position", "doc_id", "text")
    tok = Tokenizer(trained_model(spark, sf, vocab_size, mx))
    r = tok.roundtrip(mx.select("doc_id", "text"))
    return r.select("doc_id", _ids_str("ids").alias("ids"), F.array_join("subwords", " ").alias("subwords"),
                    "decoded", "ok")


register("k8_roundtrip")(_k8)


def _k9(spark, sf, vocab_size=S.VOCAB_SIZE):
    tok, e = _encoded(spark, sf, vocab_size)
    return e.select("doc_id", _ids_str(tok.with_eos("ids")).alias("ids"))


register("k9_append_eos")(_k9)


def packed_bpe(spark, sf, context_len: int = S.CONTEXT_LEN, vocab_size: int = S.VOCAB_SIZE):
    """G2 with the trained BPE: mixture in training order, documents of at
    least DOC_MIN_LENGTH code points, EOS id read from the vocabulary."""
    tok, e = _encoded(spark, sf, vocab_size)
    e = e.where(F.length("text") >= S.DOC_MIN_LENGTH)
    return pack(e.select("position", "ids"), "ids", ["position"], context_len, tok.model.eos_id)


register("g2_pack_bpe")(lambda spark, sf: packed_bpe(spark, sf).select("seq_id", _ids_str("ids").alias("ids")))
