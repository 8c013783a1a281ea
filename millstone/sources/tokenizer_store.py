"""A4/A5: save and load a trained tokenizer, as two Parquet tables or as the one JSON file
that the public ``tokenizers`` library reads and writes.

``vocab(token_id int, token string, is_special boolean, is_unk boolean)`` and
``merges(rank int, left_id int, right_id int, new_id int)``; both are
bounded by the vocabulary size.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from millstone.operators.bpe import BpeModel
from millstone.session import read_text, write_text

# Fixed value: settings of a byte-level part in the library's file form.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


def save_tokenizer(spark: SparkSession, model: BpeModel, path: str) -> str:
    """A4: write (overwrite) ``{path}/vocab`` and ``{path}/merges``; the folder
    is created if missing."""
    specials = set(model.specials)
    vocab = spark.createDataFrame([(i, t, t in specials, t == model.unk) for i, t in enumerate(model.vocab)],
                                  "token_id int, token string, is_special boolean, is_unk boolean")
    merges = spark.createDataFrame([(r, a, b, c) for r, (a, b, c) in enumerate(model.merges)],
                                   "rank int, left_id int, right_id int, new_id int")
    vocab.coalesce(1).write.mode("overwrite").parquet(f"{path}/vocab")
    merges.coalesce(1).write.mode("overwrite").parquet(f"{path}/merges")
    return path


def load_tokenizer(spark: SparkSession, path: str) -> BpeModel | None:
    """A5: the saved model, or ``None`` when nothing is saved at ``path``."""
    try:
        v = spark.read.parquet(f"{path}/vocab").orderBy("token_id").collect()
        m = spark.read.parquet(f"{path}/merges").orderBy("rank").collect()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    vocab = [r["token"] for r in v]
    specials = [r["token"] for r in v if r["is_special"]]
    unk = [r["token"] for r in v if r["is_unk"]]
    return BpeModel(vocab, [(r["left_id"], r["right_id"], r["new_id"]) for r in m], specials, *unk)


def tokenizer_json(model: BpeModel, decoder: bool = True) -> str:
    """The model in the library's file form. Without ``decoder`` the library decodes to glyphs joined by blanks."""
    ids = {}
    for i, t in enumerate(model.vocab):
        ids.setdefault(t, i)
    added = [{"id": ids[t], "content": t, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
             for t in model.specials]
    bpe = {"type": "BPE", "dropout": None, "unk_token": model.unk, "continuing_subword_prefix": None, "end_of_word_suffix": None,
           "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": ids,
           "merges": [[model.vocab[a], model.vocab[b]] for a, b, _ in model.merges]}
    return json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": added, "normalizer": None,
                       "pre_tokenizer": BYTE_LEVEL, "post_processor": None, "decoder": BYTE_LEVEL if decoder else None, "model": bpe},
                      ensure_ascii=False)


def model_of_json(text: str) -> BpeModel:
    """A model from the library's file form; raises ValueError for another kind of tokenizer."""
    spec = json.loads(text)
    bpe = spec["model"]
    pre = spec.get("pre_tokenizer") or {}
    if (bpe.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True)
            or spec.get("normalizer") or any(bpe.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))):
        raise ValueError("not a byte-level BPE tokenizer without normaliser")
    ids = dict(bpe["vocab"]) | {t["content"]: t["id"] for t in spec["added_tokens"]}
    vocab = sorted(ids, key=ids.get)
    if [ids[t] for t in vocab] != list(range(len(vocab))):
        raise ValueError("ids must be 0, 1, 2 and so on")
    pairs = [m if isinstance(m, list) else m.split(" ") for m in bpe["merges"]]
    return BpeModel(vocab, [(ids[a], ids[b], ids[a + b]) for a, b in pairs],
                    [t["content"] for t in sorted(spec["added_tokens"], key=lambda t: t["id"]) if t["special"]],
                    *([bpe["unk_token"]] if bpe.get("unk_token") else []))


def save_tokenizer_file(spark: SparkSession, model: BpeModel, path: str, decoder: bool = True) -> str:
    """A4: write (overwrite) ``path`` in the library's file form; folders are created if missing."""
    write_text(spark, path, tokenizer_json(model, decoder))
    return path


def load_tokenizer_file(spark: SparkSession, path: str) -> BpeModel | None:
    """A5: the model of a file in the library's form, or ``None`` when there is none at ``path``."""
    text = read_text(spark, path)
    return None if text is None else model_of_json(text)
