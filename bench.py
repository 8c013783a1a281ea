"""Benchmark of the headline jobs.

Runs on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` and prints one JSON line. Every job is forced with
the ``noop`` sink (full computation, nothing collected) or a write, timed
after one warm-up run; the median of ``$BENCH_REPEAT`` runs (default 1) is
reported.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from millstone import settings as S  # noqa: E402
from millstone.operators.bpe import Tokenizer, train_bpe, word_counts  # noqa: E402
from millstone.operators.mixture import interleave  # noqa: E402
from millstone.operators.packing import pack  # noqa: E402
from millstone.operators.quality import collect_thresholds, quality_filter, source_thresholds  # noqa: E402
from millstone.operators.shuffle import buffer_shuffle, tokenizer_training_docs  # noqa: E402
from millstone.plans.fixtures import mapped_source  # noqa: E402
from millstone.plans.prepare import prepare  # noqa: E402
from millstone.session import checkpoint_dir, get_spark, materialize  # noqa: E402


def noop(df):
    df.write.format("noop").mode("overwrite").save()


def timed(fn, repeat):
    fn()  # warm-up
    ts = []
    for _ in range(repeat):
        t = time.time()
        out = fn()
        ts.append(time.time() - t)
    return statistics.median(ts), out


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    spark = get_spark("millstone-bench", f"local[{cpus}]", int(cpus) * 2, extra={"spark.driver.memory": "16g"})
    checkpoint_dir(spark)  # the session's spark.checkpoint.dir; a scratch folder only when unset
    docs = (spark.read.parquet(f"{sf_dir}/documents.parquet")
            .select("doc_id", mapped_source().alias("source"), "text"))
    n_docs = docs.count()
    q, info = {}, {}

    # clean + score every document once, written
    q["clean_score"], prepared = timed(lambda: prepare(docs, ["stories"], "latin"), repeat)
    info["clean_score_docs_per_s"] = round(n_docs / q["clean_score"], 1)

    # per-source thresholds (E2) on the written table
    def thresholds():
        return collect_thresholds(source_thresholds(prepared, S.CUT_RATIOS, S.DEFAULT_CUT_RATIO, S.SAMPLE_SIZE,
                                                    S.SEED, sources=["wiki", "namu", "culturax"]))
    q["thresholds"], th = timed(thresholds, repeat)

    # quality filter
    q["quality_filter"], _ = timed(lambda: noop(quality_filter(prepared, th)), repeat)
    kept = materialize(quality_filter(prepared, th), "bench-kept")

    # weighted interleave + shuffle buffer (I1, H3), written
    def mixture():
        return materialize(buffer_shuffle(interleave(kept, S.MIX_RATIOS, S.SEED), "slot", S.SHUFFLE_BUFFER, S.SEED),
                           "bench-mix")
    q["interleave_shuffle"], mix = timed(mixture, repeat)
    info["mixture_docs"] = mix.count()

    # word counts (K2) of the tokenizer training documents (H5)
    train_docs = tokenizer_training_docs(mix)
    q["word_counts"], _ = timed(lambda: noop(word_counts(train_docs)), repeat)
    words = materialize(word_counts(train_docs), "bench-words")
    info["distinct_words"] = words.count()

    # BPE training to the whole vocabulary (K4)
    t = time.time()
    model = train_bpe(words, S.VOCAB_SIZE)
    q["bpe_train"] = time.time() - t
    info["bpe_rounds"], info["bpe_merges"], info["bpe_vocab"] = model.rounds, len(model.merges), len(model.vocab)
    info["bpe_s_per_1000_merges"] = round(1000 * q["bpe_train"] / max(1, len(model.merges)), 3)

    # encode (K5) and pack at L = 2048
    tok = Tokenizer(model)
    q["encode"], enc = timed(lambda: materialize(tok.encode_docs(mix).select("position", "ids", F.length("text").alias("n")),
                                                 "bench-enc"), repeat)
    info["encode_docs_per_s"] = round(info["mixture_docs"] / q["encode"], 1)
    enc = enc.where(F.col("n") >= S.DOC_MIN_LENGTH)
    q["pack"], _ = timed(lambda: noop(pack(enc, "ids", ["position"], S.CONTEXT_LEN, model.eos_id)), repeat)
    n_tokens = enc.select(F.sum(F.size("ids") + 1)).first()[0] or 0
    info["pack_tokens_per_s"] = round(n_tokens / q["pack"], 1)

    q = {k: round(v, 3) for k, v in q.items()}
    print(json.dumps({"metric": "corpus_prep_total_sec", "value": round(sum(q.values()), 3), "unit": "sec",
                      "queries": q, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
                      "cpus": int(cpus), "docs": n_docs, "info": info}))
    spark.stop()


if __name__ == "__main__":
    main()
