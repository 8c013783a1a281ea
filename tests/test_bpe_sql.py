"""The tokenizer queries against DuckDB at a small vocabulary.

SQL trains a tokenizer by one recursive step a merge, so the comparison is made at ``VOCAB`` tokens on the
smallest tables; the registered queries train to the whole vocabulary by the same functions."""

import duckdb
import pytest

from millstone import settings as S
from millstone.functions.bytelevel import GLYPHS
from millstone.plans import q_bpe
from millstone.plans.q_bpe import _PRE_SQL, _ids_str
from millstone.plans.q_mix import SQL_PIPE
from millstone.plans.sqlfrag import q

SF = "/root/testdata/sf0.001"
VOCAB = 320

#
# ``w``: distinct pre-tokens of the mixture with their count in the training documents. ``bpe``: one step per merge. A word is
# ``<id><id>...``, so a plain left-to-right replace of ``<l><r>`` is a merge; the row of kind 1 holds the vocabulary. ``fin`` is the last step.
_SPECIAL_SQL = "[" + ", ".join(q(t) for t in S.SPECIAL_TOKENS) + "]"
_GLYPH_SQL = "[" + ", ".join(q(g) for g in GLYPHS) + "]"


def _bpe_sql(vocab_size: int = VOCAB) -> str:
    return f"""{SQL_PIPE},
tok AS MATERIALIZED (SELECT doc_id, position, text, regexp_extract_all(text, {q(_PRE_SQL)}, 1) AS words FROM sh),
w AS MATERIALIZED (SELECT word, sum(n) AS freq FROM
      (SELECT unnest(words) AS word, CASE WHEN length(text) >= {S.DOC_MIN_LENGTH} THEN 1 ELSE 0 END AS n FROM tok) GROUP BY word),
hx AS MATERIALIZED (SELECT word, freq, list_transform(range(0, length(hex(encode(word))) // 2),
             lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i + 1, 2) AS INTEGER)) AS b FROM w),
alpha AS (SELECT list({_GLYPH_SQL}[b + 1] ORDER BY unicode({_GLYPH_SQL}[b + 1])) AS glyphs
          FROM (SELECT DISTINCT unnest(b) AS b FROM hx WHERE freq > 0)),
v0 AS MATERIALIZED (SELECT list_concat({_SPECIAL_SQL}, glyphs) AS vocab FROM alpha),
ids AS MATERIALIZED (SELECT list_transform({_GLYPH_SQL}, lambda g: coalesce(list_position(vocab, g), 1) - 1) AS id FROM v0),
bpe AS (SELECT 0 AS step, 0 AS kind, word, freq, array_to_string(list_transform(b, lambda x: '<' || id[x + 1] || '>'), '') AS seg,
        CAST(NULL AS VARCHAR[]) AS vocab, 0 AS l, 0 AS r, 0 AS c FROM hx, ids
  UNION ALL SELECT 0, 1, NULL, NULL, NULL, vocab, 0, 0, 0 FROM v0
  UNION ALL
  (WITH arr AS (SELECT freq, string_split(substr(seg, 2, length(seg) - 2), '><') AS a FROM bpe WHERE kind = 0 AND freq > 0 AND contains(seg, '><')),
        pr AS (SELECT freq, a, unnest(range(1, len(a))) AS i FROM arr),
        best AS (SELECT CAST(a[i] AS INTEGER) AS l, CAST(a[i + 1] AS INTEGER) AS r FROM pr GROUP BY 1, 2 ORDER BY sum(freq) DESC, 1, 2 LIMIT 1),
        nv AS (SELECT vocab, best.l, best.r, coalesce(list_position(vocab, vocab[best.l + 1] || vocab[best.r + 1]) - 1, len(vocab)) AS c
                FROM bpe, best WHERE kind = 1 AND len(vocab) < {vocab_size}),
        m AS (SELECT l, r, CAST(c AS INTEGER) AS c, CASE WHEN c = len(vocab) THEN list_append(vocab, vocab[l + 1] || vocab[r + 1]) ELSE vocab END AS vocab FROM nv)
   SELECT step + 1, kind, word, freq, replace(seg, '<' || m.l || '><' || m.r || '>', '<' || m.c || '>'),
          CASE WHEN kind = 1 THEN m.vocab END, m.l, m.r, m.c FROM bpe, m)),
last AS (SELECT max(step) AS step FROM bpe WHERE kind = 1),
merges AS (SELECT CAST(step - 1 AS INTEGER) AS "rank", l AS left_id, r AS right_id, c AS new_id, vocab[c + 1] AS token FROM bpe WHERE kind = 1 AND step > 0),
voc AS MATERIALIZED (SELECT vocab FROM bpe WHERE kind = 1 AND step = (SELECT step FROM last)),
fin AS (SELECT word, string_split(substr(seg, 2, length(seg) - 2), '><') AS ids FROM bpe
        WHERE kind = 0 AND step = (SELECT step FROM last)),
wid AS (SELECT doc_id, unnest(words) AS word, unnest(range(0, len(words))) AS i FROM tok),
enc AS MATERIALIZED (SELECT tok.doc_id, position, text, coalesce(e.ids, []) AS ids FROM tok LEFT JOIN
       (SELECT doc_id, flatten(list(ids ORDER BY i)) AS ids FROM wid JOIN fin USING (word) GROUP BY doc_id) e ON tok.doc_id = e.doc_id),
sub AS (SELECT doc_id, text, ids, list_transform(ids, lambda x: vocab[CAST(x AS INTEGER) + 1]) AS tokens FROM enc, voc)"""


def _bpe(select: str) -> str:
    return f"WITH RECURSIVE {_bpe_sql()}\n{select}"


_EOS_SQL = f"CAST(list_position({_SPECIAL_SQL}, {q(S.EOS_TOKEN)}) - 1 AS VARCHAR)"

_L = S.CONTEXT_LEN
CASES = {
    "k4": (q_bpe._k4, "SELECT * FROM merges"),
    "k4_vocab": (q_bpe._k4_vocab, """SELECT CAST(i - 1 AS INTEGER) AS token_id, vocab[i] AS token
FROM (SELECT vocab, unnest(range(1, len(vocab) + 1)) AS i FROM voc)"""),
    "a4_a5": (q_bpe._a4, f"""SELECT CAST(i - 1 AS INTEGER) AS token_id, vocab[i] AS token, true AS same,
    list_contains({_SPECIAL_SQL}, vocab[i]) AS is_special, vocab[i] = {q(S.UNK_TOKEN)} AS is_unk
FROM (SELECT vocab, unnest(range(1, len(vocab) + 1)) AS i FROM voc)"""),
    "a4_a5_file": (q_bpe._a4_file, f"""SELECT CAST(i - 1 AS INTEGER) AS token_id, vocab[i] AS token, true AS same,
    list_contains({_SPECIAL_SQL}, vocab[i]) AS is_special, vocab[i] = {q(S.UNK_TOKEN)} AS is_unk
FROM (SELECT vocab, unnest(range(1, len(vocab) + 1)) AS i FROM voc)"""),
    "k5": (q_bpe._k5, "SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_tokens, array_to_string(ids, ' ') AS ids FROM enc"),
    "k6_raw": (q_bpe._k6_raw, "SELECT doc_id, array_to_string(tokens, ' ') AS decoded_raw FROM sub"),
    "k7": (q_bpe._k7, "SELECT doc_id, array_to_string(tokens, ' ') AS subwords FROM sub"),
    "k8": (q_bpe._k8, """SELECT doc_id, array_to_string(ids, ' ') AS ids, array_to_string(tokens, ' ') AS subwords,
    text AS decoded, true AS ok FROM sub"""),
    "k9": (q_bpe._k9, f"SELECT doc_id, array_to_string(list_append(ids, {_EOS_SQL}), ' ') AS ids FROM enc"),
    "g2": (lambda spark, sf, n: q_bpe.packed_bpe(spark, sf, vocab_size=n).select("seq_id", _ids_str("ids").alias("ids")),
           f"""SELECT seq_id, array_to_string(ids, ' ') AS ids FROM (
    SELECT CAST(pos // {_L} AS BIGINT) AS seq_id, list(id ORDER BY pos) AS ids FROM (
        SELECT start + unnest(range(0, len(t))) AS pos, unnest(t) AS id FROM (
            SELECT t, CAST(coalesce(sum(len(t)) OVER (ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
            FROM (SELECT position, list_append(ids, {_EOS_SQL}) AS t FROM enc WHERE length(text) >= {S.DOC_MIN_LENGTH})))
    GROUP BY 1 HAVING count(*) = {_L})"""),
}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    # the tables of the one recursion, used by all cases
    for t in ("merges", "voc", "enc", "sub"):
        c.execute(f"CREATE TABLE t_{t} AS " + _bpe(f"SELECT * FROM {t}"))
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM t_{t}")
    return c


@pytest.mark.parametrize("name", CASES)
def test_tokenizer_queries_equal_sql(spark, con, name):
    build, sql = CASES[name]
    got = build(spark, SF, VOCAB)
    want = con.execute(sql)
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = want.fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(repr, rows)) and rows
