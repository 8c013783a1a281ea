"""Training-data operators against brute force, and on nulls, empty, repeated and very long rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millstone.llm import bpe_trie, chat, cover, decontam, jaccard, lm, mtree, suffix, tokens, toxicity, warc, wfst, whiten
from millstone.llm.queries import BYTE_BPE, PIECE_BPE, vocabulary

DOCS = "doc_id long, text string, chunk string, bucket int"  # extra columns clash with internal names


def _words(rnd, n, pool=400):
    return " ".join(f"w{rnd.randrange(pool)}x" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    base = [_words(rnd, rnd.randrange(20, 300)) for _ in range(25)]
    passage = _words(rnd, 120, 10 ** 6)
    near = [" ".join(w if rnd.random() > 0.01 else "zz" for w in base[0].split()) for _ in range(12)]
    odd = ["", None, " ", "a", "a b c d", "x" * 1500, "ab" * 900, "é漢😀 \n\t ok", "tail<|endoftext|>more", _words(rnd, 20000)]
    return base + base[:5] + base[:1] * 3 + near + [passage + " " + b for b in base[5:9]] + odd


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(texts)] + [(None, "no id here at all", "c", 1)], DOCS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def test_chat(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo <|im_end|>"), (1, 2, "bob", "yo <|im_end|>"),
            (1, 300, None, None), (None, None, "cy", "alone"), (2, 0, "system", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("x"))
    got = chat.rotate(df).collect()
    assert {(r.conv_id, r.perspective) for r in got} == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "cy")}
    for r in got:
        own = [r.text[m.start:m.end] for m in r.mask]
        assert len(own) == r.n_assistant == r.text.count("<|im_start|>assistant\n")
    bob = next(r for r in got if r.perspective == "bob" and r.part == 0)
    assert bob.n_turns == 5 and [bob.text[m.start:m.end] for m in bob.mask] == ["yo <| im_end|>"] * 2
    assert "<|im_start|>user name=ann\nhi<|im_end|>\n" in bob.text
    assert chat.rotate(df.limit(0)).count() == 0


def test_chat_parts_are_bounded(spark):
    """Many turns with one number, without one, repeated, or without conversation: parts of equal size, in order."""
    rnd = random.Random(7)
    rows = ([(1, None, "ann", f"t{k % 50}") for k in range(300)] + [(1, 3, rnd.choice(["ann", "bob"]), f"u{k}") for k in range(300)]
            + [(None, 0, "cy", "same")] * 400 + [(2, k * 1000, "dee", None) for k in range(20)])
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    got = chat.rotate(df, part_turns=16).collect()
    assert all(r.n_turns <= 16 for r in got)
    for conv, who in ((1, "ann"), (1, "bob"), (None, "cy"), (2, "dee")):
        view = sorted((r for r in got if (r.conv_id, r.perspective) == (conv, who)), key=lambda r: r.part)
        turns = sorted(((n is not None, n or 0, s, t or "") for c, n, s, t in rows if c == conv))
        assert [r.part for r in view] == list(range(-(-len(turns) // 16))) and all(r.n_turns == 16 for r in view[:-1])
        assert "".join(r.text for r in view) == "".join(
            f"<|im_start|>{'assistant' if s == who else f'user name={s}'}\n{t}<|im_end|>\n" for _, _, s, t in turns)


def test_lm_base_and_bounds(docs, texts, nothing):
    got = {r.doc_id: r for r in lm.interpolated_scores(docs).collect()}
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id here at all")]
    split = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7
    toks = {i: [*(t or "").encode().lower().split(), None] for i, t in rows}
    c = Counter(w for i, w_ in toks.items() if split(i) != 2 for w in w_)
    n, v = sum(c.values()), len(c)
    for i, w in toks.items():
        r = got[i]
        assert r.held_out == (split(i) == 2) and (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in c for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
        assert r.score <= 0
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())
    assert lm.interpolated_scores(nothing).count() == 0


def test_lm_buckets():
    assert lm.bucket_of(np.array([0, 1, 2, 3, 4, 1 << 20])).tolist() == [0, 1, 2, 2, 3, 21]


def test_lm_score_brute_force(spark):
    """Counts, expectation-maximisation on the deleted fold and scores, with plain dictionaries."""
    rnd = random.Random(21)
    rows = [(i, " ".join(rnd.choice("abcdefghij")[:1] * rnd.randrange(1, 3) if rnd.random() < 0.8 else f"r{rnd.randrange(60)}"
                         for _ in range(rnd.randrange(1, 60)))) for i in range(150)] + [(200, None), (201, "A  b\tnever-seen")]
    got = {r.doc_id: r for r in lm.interpolated_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    role = lambda i: zlib.crc32(str(i).encode()) % 7
    toks = {i: [*(t or "").lower().split(), "</s>"] for i, t in rows}

    def counts(keep):
        word, pair, docs = Counter(), Counter(), 0
        for i, w in toks.items():
            if keep(role(i)):
                docs += 1
                word.update(w)
                pair.update(zip(["<s>", *w], w))
        return word, pair, docs, sum(word.values()), len(word)

    def parts(c, v, w):
        """(context bucket, uniform, word and pair estimates)"""
        word, pair, docs, n, types = c
        context = docs if v == "<s>" else word[v]
        return context.bit_length(), 1 / (types + 1), word[w] / n, pair[v, w] / context if context else 0.0

    kept = counts(lambda r: r not in (2, 5))
    events = [parts(kept, v, w) for i, t in toks.items() if role(i) == 5 for v, w in zip(["<s>", *t], t)]
    weights = {b: (0.5, 0.5, 0) if b == 0 else (1 / 3, 1 / 3, 1 / 3) for b in range(41)}
    last = None
    for _ in range(lm.EM_ROUNDS):
        shares, ll = {}, 0.0
        for b, *f in events:
            a = [x * y for x, y in zip(weights[b], f)]
            ll += math.log(sum(a))
            shares[b] = [x + y / sum(a) for x, y in zip(shares.get(b, [0, 0, 0]), a)]
        for b, s in shares.items():
            s = [x + 1e-3 if b or k < 2 else 0.0 for k, x in enumerate(s)]
            weights[b] = [x / sum(s) for x in s]
        ll /= len(events)
        if last is not None and ll - last < lm.EM_STOP:
            break
        last = ll
    seen = sorted(shares)
    for b in range(1, 41):
        if b not in seen:
            weights[b] = weights[min((x for x in seen if x), key=lambda x: (abs(x - b), x))]
    assert all(sum(w) == pytest.approx(1) for w in weights.values()) and len(seen) > 3
    every = counts(lambda r: r != 2)
    for i, t in toks.items():
        want = 0.0
        for v, w in zip(["<s>", *t], t):
            b, *f = parts(every, v, w)
            want += math.log10(sum(x * y for x, y in zip(weights[b], f)))
        assert got[i].score == pytest.approx(want, rel=1e-9), i


def _brute_spans(rows, length):
    seen = Counter(b[i:i + length] for b in rows for i in range(len(b) - length + 1))
    for b in rows:
        m = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                m[i:i + length] = b"\1" * length
        yield m


@pytest.mark.parametrize("slab", [700, 2 << 20])
def test_suffix_brute_force(spark, docs, texts, nothing, slab, monkeypatch):
    rows = {i: (t or "").encode() for i, t in enumerate(texts)} | {None: b"no id here at all"}
    got = {r.doc_id: r for r in suffix.repeated_spans(docs).collect()}
    for (i, b), m in zip(rows.items(), _brute_spans(rows.values(), 400)):
        kept = bytes(x for x, y in zip(b, m) if not y)
        spans = sum(1 for k, y in enumerate(m) if y and (not k or not m[k - 1]))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (
            len(b), sum(m), spans, hashlib.sha256(kept).hexdigest()), i
    assert suffix.repeated_spans(nothing).count() == 0
    # slabs of one document cover the same strings
    monkeypatch.setattr(suffix, "SLAB", slab)
    b = np.frombuffer(rows[0] * 3, np.uint8)
    at = np.concatenate([s.strings(np.ones(len(s.start), bool))[0] + s.off for s in suffix.slabs(b, 400)])
    assert at.tolist() == list(range(len(b) - 399))


def test_toxicity_held_out_accuracy(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(600):
        bad = i % 4 == 0
        w = _words(rnd, 60, 200).split()
        for _ in range(3 if bad else 0):
            w.insert(rnd.randrange(len(w)), rnd.choice(["vile1", "vile2"]))
        rows.append((i, " ".join(w), int(bad)))
    d = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(600, None), (None, "w1x")], "doc_id long, text string")
    lab = spark.createDataFrame([(i, y) for i, _, y in rows] + [(601, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_scores(d, lab).collect()}
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert len(held) > 80 and sum(p == y for p, y in held) >= 0.97 * len(held)
    assert 0 <= got[600].score <= 1 and got[None].predicted == 0
    none = toxicity.toxicity_scores(d, lab.where("toxic = 0")).agg(F.max("score")).first()[0]
    assert none == 0.0
    assert toxicity.toxicity_scores(d.limit(0), lab).count() == 0


def test_toxicity_counts_every_word_of_the_sample(spark):
    """The models against the formulas in plain Python, with words and pairs seen once; scores follow the evidence."""
    rnd = random.Random(6)
    rows = [(i, _words(rnd, 30, 150) + f" once{i}" + (" vile1" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(120)]
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    lab = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    counts, kept, _ = toxicity.counted(d, lab)
    model = counts.model()
    sample = [(toxicity.tokens(t), y) for i, t, y in rows if not toxicity.held_out_of(i)]
    assert kept.count() == len(sample)
    pair = [Counter(), Counter()]
    for t, y in sample:
        pair[y].update(zip(["\x02", *t], t))
    both = pair[0] + pair[1]
    shared = Counter(w for _, w in both)
    cont = [Counter(w for _, w in p) for p in pair]
    assert len(model.words) == len(shared) + 1 and toxicity.word_keys([t for t in shared if t.startswith("once")])[0] in model.words

    def cut(counts):
        n = [0, *(sum(c == i for c in counts.values()) for i in (1, 2, 3, 4))]
        y, disc = n[1] / max(n[1] + 2 * n[2], 1), [0]
        for i in (1, 2, 3):
            disc.append(min(max(i - (i + 1) * y * n[i + 1] / n[i], 0), i) if n[i] else disc[-1])
        return lambda c: max(c - disc[min(c, 3)], 0)

    total, size = sum(shared.values()) + 0.5 * (len(shared) + 2), [sum(c.values()) for c in cont]  # the start and the unknown word
    cuts, most = [cut(c) for c in cont], cut(both)
    both_cut = lambda c: most(c) if c > 1 else 0
    own = [{w: max(cuts[y](cont[y][w]) - toxicity.EXCESS * size[y] * (cont[1 - y][w] + 0.5) / size[1 - y], 0) / size[y] for w in shared} for y in (0, 1)]
    after = Counter()
    for (v, _), c in both.items():
        after[v] += c

    def evidence(t):
        out = []
        for y in (0, 1):
            low = lambda w: own[y].get(w, 0) + (1 - sum(own[y].values())) * (shared[w] + 0.5) / total
            p = []
            for v, w in zip(["\x02", *t], t):
                if (v, w) in both:
                    rest = 1 - min(sum(both_cut(c) / after[v] for (a, _), c in both.items() if a == v), 1 - 1e-6)
                    p.append(both_cut(both[v, w]) / after[v] + rest * low(w))
                else:
                    p.append(low(w))  # the weight after v is the same in both classes
            out.append(sum(map(math.log, p)) / len(t))
        return out[1] - out[0]

    probes = [sample[0][0], sample[1][0][::-1], ["vile1", "nowhere"], sample[2][0][-2:]]
    assert [model.evidence(" ".join(t)) for t in probes] == pytest.approx([evidence(t) for t in probes], abs=1e-6)
    assert model.evidence("") == 0
    # the order of scores is that of the evidence
    name, curve = toxicity.fit(d, lab)
    got = {r.doc_id: r.score for r in toxicity.toxicity_scores(d, lab).collect()}
    e = {i: toxicity._mapped(name).evidence(t) for i, t, _ in rows}
    assert [i for i in sorted(e, key=e.get)] == [i for i in sorted(got, key=lambda i: (got[i], e[i]))]
    assert curve.slope > 0 and got == {i: pytest.approx(float(curve.score(np.array(x)))) for i, x in e.items()}
    # bounds of the sample: rows of a class, and bytes
    assert {tuple(r) for r in toxicity.counted(d, lab, per_class=7)[1].groupBy("toxic").count().collect()} == {(0, 7), (1, 7)}
    small = toxicity.counted(d, lab, class_bytes=2000)[1].groupBy("toxic").agg(F.sum(F.length("text"))).collect()
    assert len(small) == 2 and all(0 < n <= 2000 for _, n in small)


def test_decontamination(spark):
    rnd = random.Random(2)
    items = [(k, _words(rnd, 30, 10 ** 6) + ". " + _words(rnd, 8, 10 ** 6) + ".") for k in range(40)] + [(40, _words(rnd, 400, 10 ** 6)), (41, None), (42, "")]
    clean = [_words(rnd, 500, 10 ** 6) for _ in range(20)]
    leak = [(100 + k, clean[k % 20] + " " + t.upper().replace(" ", ",  ") + " " + clean[(k + 1) % 20], k) for k, t in items[:41]]
    half = [(200 + k, clean[k] + " " + " ".join(items[k][1].split()[:12])) for k in range(20)]
    d = spark.createDataFrame([*enumerate(clean), *[x[:2] for x in leak], *half, (300, None), (301, "")], "doc_id long, text string")
    it = spark.createDataFrame(items, "item_id long, text string")
    want = {(i, k) for i, _, k in leak}
    whole = sorted(tuple(r) for r in decontam.contaminated(d, it).collect())
    assert {r[:2] for r in whole} == want
    # every number is the same however the items fall into shards
    assert sorted(tuple(r) for r in decontam.contaminated(d, it.repartition(3), shard=10).collect()) == whole
    assert len(decontam.publish(spark, it, shard=10)) > 3
    assert decontam.contaminated(d, it.limit(0)).count() == 0 and decontam.contaminated(d.limit(0), it).count() == 0
    # the bounds lose nothing: every passage against every segment
    segs = [(k, k, q, a) for k, t in items for q, a in decontam.segments_of(t or "")]
    size = [len(q) + len(a) for _, _, q, a in segs]
    ix = decontam.Index(segs, (len(segs), sum(size) / len(size), Counter(x for _, _, q, a in segs for x in {*q, *a})))
    w = decontam.words(leak[3][1])
    t = np.array([ix.terms.get(x, 0) for x in w])
    got = {(s, g) for s, terms, good in ix.passages(t, 0.3) for g, _ in ix.retrieve(terms, good, 0.3)}
    brute = set()
    for s in range(0, max(1, len(t) - decontam.SEGMENT + decontam.STRIDE - 1), decontam.STRIDE):
        terms = set(t[s:s + decontam.SEGMENT + decontam.STRIDE].tolist()) - {0}
        score = Counter()
        for x in terms:
            for p in range(ix.at[x], ix.at[x + 1]):
                score[int(ix.seg[p])] += ix.impact[p]
        brute |= {(s, g) for g, v in score.items() if v >= 0.3}
    assert got == brute


def test_decontamination_edited_and_partial_items(spark):
    rnd = random.Random(8)
    items = [(k, _words(rnd, 30, 10 ** 6) + ". " + _words(rnd, 8, 10 ** 6) + ".") for k in range(10)] + [
        (20, _words(rnd, 400, 10 ** 6)), (21, _words(rnd, 97, 10 ** 6) + ".")]
    rows = []
    for k, t in items[:10]:  # one word of the answer edited
        w = t.split()
        w[30 + k % 7] = "edited"
        rows.append((k, _words(rnd, 200, 10 ** 6) + " " + " ".join(w) + " " + _words(rnd, 200, 10 ** 6)))
    long = items[10][1].split()
    rows += [(20, _words(rnd, 200, 10 ** 6) + " " + " ".join(long[50:350]) + " tail"), (30, " ".join(long[:40]) + " " + _words(rnd, 200, 10 ** 6)),
             (31, _words(rnd, 200, 10 ** 6) + " " + items[11][1].split()[-1]), (32, " ".join(reversed(items[3][1].split())))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontam.contaminated(d, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(k, k) for k in range(10)} | {(20, 20)}
    # edits against the plain table
    for _ in range(300):
        a, b = ([rnd.choice("abc") for _ in range(rnd.randrange(1, 9))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        assert decontam._edits(a, b) == min(row), (a, b)


def test_decontamination_scores_the_passages_of_a_text_together(monkeypatch):
    rnd = random.Random(12)
    items = [_words(rnd, 60, 400) for _ in range(50)]
    segs = [(k, k, q, a) for k, t in enumerate(items) for q, a in decontam.segments_of(t)]
    size = [len(q) + len(a) for _, _, q, a in segs]
    ix = decontam.Index(segs, (len(segs), sum(size) / len(size), Counter(x for _, _, q, a in segs for x in {*q, *a})))
    text = " ".join([_words(rnd, 900, 400), items[7], _words(rnd, 900, 400)])
    t = np.array([ix.terms.get(x, 0) for x in decontam.words(text)])
    one = [(s, *m) for s, terms, good in ix.passages(t, 0.2) for m in ix.retrieve(terms, good, 0.2)]
    batches = list(ix.candidates(t, 0.2))
    assert len(batches) == 1 and len(batches[0][0]) > 40 and len({s for s, *_ in one}) > 20  # one call for all passages
    want = ix.matches(text, 0.2, 0.8)
    for most in (1, 300, decontam.POSTINGS):  # the same numbers in pieces of any size
        monkeypatch.setattr(decontam, "POSTINGS", most)
        starts, terms, good = batches[0]
        assert [(int(starts[k]), seg, s) for k, seg, s in ix.scored(terms, good, 0.2)] == one
        assert ix.matches(text, 0.2, 0.8) == want and 7 in {m[0] for m in want}
    for c in [*map(chr, range(0x500)), "\u2019", "\u4e2d", "\u0301", "\U0001F600"]:  # words by a table and by the pattern
        assert decontam.words(f"A{c}b {c}{c}1") == decontam._words(f"A{c}b {c}{c}1".lower())


def test_decontamination_item_without_id(spark):
    rnd = random.Random(9)
    item = _words(rnd, 30, 10 ** 6) + ". " + _words(rnd, 8, 10 ** 6) + "."
    d = spark.createDataFrame([(1, "before " + item), (2, _words(rnd, 80, 10 ** 6))], "doc_id long, text string")
    it = spark.createDataFrame([(None, item), (None, None), (7, "other words here")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.contaminated(d, it).collect()] == [(1, None)]
    assert [r.doc_id for r in d.where(decontam.contaminated_column(spark, it, "text")).collect()] == [1]


@pytest.mark.parametrize("block", [3, 512])
def test_jaccard_brute_force(docs, texts, nothing, block):
    def shingles(t):
        w = (t or "").split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t in enumerate(texts)} | {None: shingles("no id here at all")}
    ids = list(sets)
    links, root = Counter(), {i: i for i in ids}

    def find(i):
        return i if root[i] == i else find(root[i])

    for x, a in enumerate(ids):
        for b in ids[:x]:
            if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.similar_classes(docs, block=block).collect()}
    low = {}
    for i in ids:
        low[find(i)] = min([x for x in (low.get(find(i)), i) if x is not None], default=None)
    assert got == {i: (low[find(i)], links[i]) for i in ids}
    assert jaccard.similar_classes(nothing).count() == 0


def test_components_with_hubs(spark):
    """Chains, rings and stars of more edges than a part takes."""
    rnd = random.Random(8)
    edges = [(0, k) for k in range(1, 1500)] + [(5000, k) for k in range(5001, 7000)] + [(k, k + 1) for k in range(8000, 8060)] + [(6999, 9000)]
    edges += [(rnd.randrange(10_000, 10_400), rnd.randrange(10_000, 10_400)) for _ in range(250)]
    name = list(range(11_000))
    rnd.shuffle(name)
    edges = [(name[a], name[b]) for a, b in edges]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r.node: r.root for r in jaccard.components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert got == {i: find(i) for i in list(root)}


def test_posterior_table():
    least = jaccard.least_agreement(0.8, 1e-9)
    assert (np.diff(least) > 0).all() and least[0] < 16


def test_wfst_equals_library(docs, texts, nothing):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECE_BPE))
    t = wfst.transducer(vocabulary(PIECE_BPE))
    rnd = random.Random(9)
    hostile = ["".join(rnd.choice("  \n\tabcdeé漢字😀▁<s>0\x00") for _ in range(rnd.randrange(40))) for _ in range(400)]
    for x in hostile + [x or "" for x in texts]:
        assert t.encode(x) == sp.encode(x) and t.decode(t.encode(x)) == sp.decode(sp.encode(x)), x[:50]
    got = {r.doc_id: r for r in wfst.encode_documents(docs, vocabulary(PIECE_BPE)).collect()}
    assert all(list(got[i].ids) == sp.encode(x or "") and got[i].round_trip for i, x in enumerate(texts))
    assert wfst.encode_documents(nothing, vocabulary(PIECE_BPE)).count() == 0


@pytest.mark.parametrize("fallback", [False, True])
def test_wfst_unigram_equals_library(fallback):
    """A unigram model written by hand, with ties and characters outside of it."""
    import struct

    import sentencepiece

    def field(n, v):
        key = lambda kind: bytes([n << 3 & 127 | 128, n >> 4]) if n > 15 else bytes([n << 3 | kind])
        if isinstance(v, int):
            return (bytes([n << 3 & 127 | 128, n >> 4]) if n > 15 else key(0)) + bytes([v])
        if isinstance(v, float):
            return key(5) + struct.pack("<f", v)
        assert len(v) < 128
        return key(2) + bytes([len(v)]) + v

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + ([(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if fallback else [])
    pieces += [(p, w, 1) for p, w in (("▁", -2.5), ("a", -3.0), ("b", -3.1), ("ab", -4.2), ("▁a", -4.0), ("ba", -4.7), ("aba", -6.1), ("bb", -6.2),
                                      ("▁ab", -5.3), ("c", -5.0), ("abc", -7.25), ("cab", -7.2), ("é", -4.5), ("aa", -6.0), ("b▁a", -6.05))]
    model = b"".join(field(1, field(1, p.encode()) + field(2, w) + field(3, k)) for p, w, k in pieces)
    model += field(2, field(3, 1) + (field(35, 1) if fallback else b"")) + field(3, field(1, b"identity"))
    sp, t, rnd = sentencepiece.SentencePieceProcessor(model_proto=model), wfst.Transducer(model), random.Random(3)
    for _ in range(600):
        x = "".join(rnd.choice("aaabbbc  é漢😀z") for _ in range(rnd.randrange(30)))
        assert t.encode(x) == sp.encode(x) and t.decode(t.encode(x)) == sp.decode(sp.encode(x)), x


def test_token_counts_equal_library(docs, texts, nothing):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(BYTE_BPE))
    got = {r.doc_id: r for r in tokens.token_counts(docs, vocabulary(BYTE_BPE)).collect()}
    for i, x in enumerate(texts):
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((x or "").encode()), n, n > 1024), i
    assert got[None].n_tokens > 0 and tokens.token_counts(nothing, vocabulary(BYTE_BPE)).count() == 0


def test_topk_brute_force(spark):
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(700, 8)), 1)  # many ties
    v[100:300] = v[0]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [
        (800, None), (900, [1.0, None] + [0.0] * 6), (1000, [float("nan")] * 8), (1100, []), (1200, [1.0, 2.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    ints = np.floor(1024 * v).astype(np.int64)
    want = set()
    for q in range(0, 700, 100):
        s = ints @ ints[q]
        best = sorted((i for i in range(700) if i != q), key=lambda i: (-s[i], i))[:10]
        want |= {(q, k + 1, i, int(s[i])) for k, i in enumerate(best)}
    assert {tuple(r) for r in mtree.top_k(df).collect()} == want
    assert {tuple(r) for r in mtree.top_k(df.repartition(9), query_block=2).collect()} == want
    assert mtree.top_k(df.limit(0)).count() == 0


def test_bpe_trie_equals_library(spark, docs, texts, nothing):
    import json

    from tokenizers import Tokenizer

    file = vocabulary(BYTE_BPE)
    t, rnd = Tokenizer.from_file(file), random.Random(12)
    bpe = bpe_trie.load(file)
    hostile = ["".join(rnd.choice("aabcdeth \n'sré漢0123-_=.\x1c\x85\u200b😀") for _ in range(rnd.randrange(300))) for _ in range(500)]
    hostile += ["a" * 4000, "ab" * 2000, " " * 600 + "x", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "\n\n  \t"]
    enc = bpe_trie.Encoder(bpe)
    words = [enc.words(x) for x in hostile]
    enc.finish()
    for x, w, e in zip(hostile, words, t.encode_batch(hostile, add_special_tokens=False)):
        ids = enc.ids_of(w)
        assert ids.tolist() == e.ids and bpe.decode(ids.astype(np.int64)) == t.decode(e.ids, skip_special_tokens=False), x[:40]
    got = {r.doc_id: r for r in bpe_trie.encode_documents(docs, file).collect()}
    for i, x in [*enumerate(texts), (None, "no id here at all")]:
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, np.frombuffer(got[i].ids, "<u4").tolist()) == (len(ids), ids), i
        assert got[i].decoded == t.decode(ids, skip_special_tokens=False)
    assert bpe_trie.encode_documents(nothing, file).count() == 0
    spec = json.load(open(file, encoding="utf-8"))
    for change in ({"normalizer": {"type": "Lowercase"}}, {"model": {**spec["model"], "ignore_merges": True}}, {"pre_tokenizer": None}):
        with pytest.raises(ValueError):
            bad = f"/tmp/{rnd.random()}.json"
            with open(bad, "w", encoding="utf-8") as f:
                json.dump(spec | change, f)
            bpe_trie.Bpe(bad)


def test_bpe_trie_shares_prefixes():
    """Nodes are prefixes, each once, parents first."""
    words = [b"low", b"lower", b"lowest", b"lot", b"", b"x", b"lower"]
    depth, byte, home = bpe_trie.insert(words)
    assert len(depth) == len({w[:k] for w in words for k in range(len(w) + 1)})
    path = [b""]
    for node in range(1, len(depth)):
        path.append(path[max(n for n in range(node) if depth[n] == depth[node] - 1)] + bytes([byte[node]]))
    assert [path[n] for n in home] == words


def _negatives(rows, every=100, scale=256, low=80, high=100):
    """(anchor, positive, rank, negative, scores) by the definition."""
    ok = [(i, y, np.floor(scale * np.array(v, float)).astype(np.int64)) for i, y, v in rows
          if i is not None and y is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a in sorted({i for i, _, _ in ok if i % every == 0}):
        label, q = min((y, v.tolist()) for i, y, v in ok if i == a)
        s = sorted((-int(np.dot(q, v)), i, y) for i, y, v in ok if i != a and len(v) == len(q))
        for p, i, _ in [x for x in s if x[2] == label][:5]:
            fit = [x for x in s if x[2] != label and low * -p <= 100 * -x[0] <= high * -p][:5]
            out += [(a, i, k + 1, j, -p, -n) for k, (n, j, _) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("high", [100, 90])
def test_hard_negatives_brute_force(spark, high):
    rng = np.random.default_rng(4)
    v = np.round(rng.normal(size=(900, 6)) + 0.6, 1)  # many ties
    v[200:500] = v[7]                                   # one vector in a third of the rows
    y = rng.integers(0, 4, 900)
    rows = [(i, int(c), [float(x) for x in r]) for i, (c, r) in enumerate(zip(y, v))] + [
        (1000, 1, None), (1100, None, [1.0] * 6), (1200, 2, [1.0, None] + [0.0] * 4), (1300, 1, [float("inf")] * 6), (1400, 0, []),
        (1500, 3, [1.0, 2.0]), (1501, 3, [1.5, 2.0]), (1502, 1, [1.0, 1.9]), (None, 1, [1.0] * 6), (300, 2, [9.0] * 6), (5, 0, [0.3] * 6)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, score string").repartition(5)
    got = sorted(tuple(r) for r in cover.hard_negatives(df, high=high).collect())
    assert got == _negatives(rows, high=high) and len(got) > 100
    assert cover.hard_negatives(df.limit(0)).count() == 0


def test_cover_tree_invariants():
    """Children lie apart and cover their rows; bounds hold for every row."""
    rng = np.random.default_rng(9)
    x = rng.integers(-300, 300, (3000, 5))
    x[500:900] = x[3]
    tree = cover.CoverTree(np.arange(3000), np.zeros(3000, np.int64), x)
    again = cover.CoverTree.unpacked(dict(zip(cover.TREE_SCHEMA.names, tree.packed("t"))))
    assert sorted(tree.ids.tolist()) == list(range(3000)) and (again.vecs == tree.vecs).all()
    n = tree.nodes
    points = np.column_stack([tree.vecs, np.sqrt(tree.lift - (tree.vecs ** 2).sum(1))])
    q = rng.integers(-300, 300, (4, 5)).astype(float)
    high, low = tree.bounds(q)

    def rows(k):
        kids = range(n["child"][k], n["child"][k] + n["children"][k])
        return [r for c in kids for r in rows(c)] if n["children"][k] else list(range(n["begin"][k], n["end"][k]))

    for k in range(len(n["route"])):
        mine = rows(k)
        assert np.sqrt(((points[mine] - points[n["route"][k]]) ** 2).sum(1)).max() <= n["radius"][k] + 1e-6
        s = q @ tree.vecs[mine].T
        assert (s <= high[:, k][:, None]).all() and (s >= low[:, k][:, None]).all()
        kids = np.arange(n["child"][k], n["child"][k] + n["children"][k])
        if len(kids) > 1:
            c = points[n["route"][kids]]
            apart = np.sqrt(((c[:, None] - c[None]) ** 2).sum(2))[np.triu_indices(len(c), 1)].min()
            assert n["route"][k] == n["route"][kids[0]] and apart >= n["radius"][kids].max() - 1e-6


def _whitened(x, k):
    """Eigenvectors, eigenvalues and whitened rows by a dense solver."""
    n, total = len(x), x.sum(0)
    mean = total // n
    c = (x - mean) - (total - mean * n) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return c, e, u, [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, total)) for r in x]


@pytest.mark.parametrize("dim,rows", [(5, 40), (64, 600), (90, 300)])
def test_whitening_equals_a_dense_solver(spark, dim, rows):
    rng = np.random.default_rng(dim)
    v = rng.normal(size=(rows, dim)) @ rng.normal(size=(dim, dim)) + 3
    data = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [
        (7000, None), (7001, [1.0] * (dim - 1) + [None]), (7002, [float("nan")] * dim), (7003, []), (7004, [1.0, 2.0]), (None, [float(x) for x in v[0]])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("component", F.lit(1)).repartition(4)
    x = np.floor(64 * np.vstack([v, v[:1]])).astype(np.int64) + 1_000_000
    c, e, u, deviation = _whitened(x, min(32, dim))
    got = whiten.whiten(df).toPandas()
    ids = [*range(rows), -1]
    assert len(got) == len(ids) * min(32, dim) and set(got.n) == {rows + 1}
    w = got.assign(vec_id=got.vec_id.fillna(-1)).pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    want = c @ u / np.sqrt(e)
    sign = np.sign((w * want).sum(0))
    assert np.abs(w * sign - want).max() < 1e-7
    per = got.groupby("component").first()
    assert np.allclose(per.explained, e / (c ** 2).sum() * len(x), rtol=1e-9) and got.identity_error.max() < 1e-9 and got.residual.max() < 1e-12
    assert dict(zip(got.vec_id.fillna(-1), got.deviation)) == dict(zip(ids, deviation))


def test_whitening_without_variance(spark):
    flat = [(i, [1.0, float(i % 2), 2.0]) for i in range(6)]
    df = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whiten.whiten(df(flat)).toPandas()
    first = got[got.component == 1]
    assert np.allclose(first.whitened.abs(), 1) and set(first.explained) == {1.0} and got[got.component > 1].whitened.isna().all()
    assert got.identity_error.max() < 1e-9
    one = whiten.whiten(df(flat[:1])).toPandas()
    assert len(one) == 3 and one.whitened.isna().all() and set(one.explained) == {0.0} and set(one.deviation) == {0} and set(one.identity_error) == {0.0}
    empty = whiten.whiten(df(flat).limit(0))
    assert empty.count() == 0 and empty.columns == got.columns.tolist()
    # exact past 64 bits: null, never wrong
    x = np.array([[0], [1 << 40]])
    assert whiten._deviations(x, 2, [1 << 40]) == [None, None] and whiten._deviations(x[:1], 3, [9])[0] == 81


def test_warc(spark):
    big, other = "é" * 600, "z" * 5000
    rows = [(1, "http://a/ b", big), (2, None, big), (3, "u", big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", other),
            (None, "u", other), (8, "u", "x\r\n\r\nWARC/1.1\r\n" * 200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    got = {r.page_id: r for r in warc.write_and_read(df).collect()}
    assert len(got) == 9 and all(r.digest_ok for r in got.values())
    for i, _, t in rows:
        b = (t or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(b), hashlib.sha1(b).hexdigest())
    assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {1: 3, 2: 3, None: 7}
    assert warc.write_and_read(df.limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    """Toxic, copied, repeated and leaked texts go; clean documents stay as they are."""
    import corpus_pipeline as p

    rnd = random.Random(4)
    clean = [_words(rnd, 150, 10 ** 6) for _ in range(60)]
    passage, item = _words(rnd, 150, 10 ** 6), _words(rnd, 40, 10 ** 6) + ". " + _words(rnd, 6, 10 ** 6) + "."
    bad = [c + " vile1 and vile2 vile1" for c in (_words(rnd, 80, 10 ** 6) for _ in range(40))]
    rows = [*enumerate(clean), *[(100 + k, t) for k, t in enumerate(bad)], *[(200 + k, clean[k]) for k in range(10)],
            *[(300 + k, _words(rnd, 200, 10 ** 6) + " " + passage) for k in range(3)], (400, clean[0] + " " + item + " tail"), (500, None), (500, None)]
    short = _words(rnd, 51, 900)  # a passage of 51 words, about 300 bytes, in two documents
    rows += [(310 + k, " ".join([_words(rnd, 150, 10 ** 6), short, _words(rnd, 150, 10 ** 6)])) for k in range(2)]
    # extra columns of any name are carried along
    out = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x", 2.0) for i, t in rows],
                                "doc_id long, text string, lang string, source string, n_chars long, k int, key string, cuts double")
    sf = str(tmp_path)
    out.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, int(100 <= i < 200)) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (_, stage) in enumerate(p.STAGES):
        got = stage(spark, docs, sf)
        if k < 4:
            assert got.columns == docs.columns
            got.write.parquet(f"{sf}/{k}")
            docs = spark.read.parquet(f"{sf}/{k}")
    rest = {r.doc_id: r for r in docs.collect()}
    assert set(range(1, 60)) <= set(rest) and not {i for i in rest if 100 <= i < 300 or i == 400}
    assert all(rest[i].text == clean[i] and rest[i].n_chars == len(clean[i]) for i in range(1, 60)) and docs.where("doc_id = 500").count() == 1
    assert all(passage[30:] not in rest[300 + k].text and rest[300 + k].n_chars == len(rest[300 + k].text) for k in range(3))
    assert all(short[7:-7] not in rest[310 + k].text and len(rest[310 + k].text) > 2000 for k in range(2))
    assert {(r.k, r.key, r.cuts) for r in rest.values()} == {(1, "x", 2.0)}
    assert {r.doc_id for r in p.run(spark, sf).collect()} == set(rest)


def test_pipeline_stages_leave_no_tables(spark):
    """Tables that a stage has written on the way to its last one are gone: they would count as disk of all later stages."""
    import os

    import corpus_pipeline as p
    from millstone.session import scratch_path

    rnd = random.Random(6)
    passage = _words(rnd, 150, 10 ** 6)
    rows = [(k, _words(rnd, 60, 10 ** 6) + (" " + passage if k < 3 else "")) for k in range(20)] + [(20, None), (21, None)]
    rows += [(30 + k, rows[5][1]) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    base = scratch_path(spark, "millstone")
    for stage, left in ((p.one_of_each_group, "pipeline-kept"), (p.without_repeats, "pipeline-spans")):
        before = set(os.listdir(base)) if os.path.exists(base) else set()
        out = stage(spark, docs, "")
        assert out.count() and sorted(map(repr, out.collect())) == sorted(map(repr, out.collect()))
        new = set(os.listdir(base)) - before
        assert len(new) == 1 and new.pop().startswith(left)
