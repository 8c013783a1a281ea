"""The corpus pipeline: documents in, token ids of the kept and cleaned documents out.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read back as the next stage's documents. All stages but the last keep the columns of
``documents``. Shared tables (labels, benchmark) come from ``sf_dir``.

Defined results: null texts are kept as they are unless a repeated row; documents whose text loses every byte stay as
empty texts; empty inputs give empty outputs; extra columns of documents are carried along.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millstone.llm import decontam, jaccard, suffix, toxicity, wfst
from millstone.llm.common import prepare_session, read
from millstone.llm.queries import PIECE_BPE, vocabulary
from millstone.session import materialize_last, scratch_path

#: run()'s rows come from learned models, sequence sorts and a tokenizer: no SQL form; tests compare with brute force.
ORACLE_SQL = None


#: A passage of more than 50 words counts as one when it repeats: bytes of 50 words of five bytes with their blanks.
PASSAGE_BYTES = 250


def _free(docs: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    return [next(n for n in (f"{w}{'_' * k}" for k in range(len(taken) + 1)) if n.lower() not in taken) for w in wanted]


def _own(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def _keyed(docs: DataFrame, key: str) -> DataFrame:
    """Rows with a key of id and text: repeated rows share it, other rows with the same id do not."""
    return docs.withColumn(key, F.xxhash64("doc_id", "text"))


def without_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents predicted toxic go. Filtered where they are read, with no shuffle."""
    prepare_session(spark)
    fitted = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return docs.where(toxicity.score_column(fitted, "text") < 0.5)


def one_of_each_group(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of each class of near-duplicates the document with the smallest id stays (one without an
    id only when the class has no other)."""
    key, k = _free(docs, "key", "k")
    keyed = _keyed(docs, key)

    def firsts():
        classes = jaccard.similar_classes(keyed, doc_id=key).select(F.col("doc_id").alias(k), "class_id").distinct()
        rows = keyed.select(F.col("doc_id").alias("id"), F.col(key).alias("row"))
        first = F.struct(F.col("id").isNull().alias("none"), "id", "row")
        return (rows.join(classes, F.col("row") == F.col(k))
                .groupBy("class_id").agg(F.min(first).alias("first")).select(F.col("first.row").alias(k)))

    kept = materialize_last(firsts, "pipeline-kept")
    return keyed.join(kept, F.col(key) == F.col(k), "left_semi").dropDuplicates([key]).select(_own(docs))


def without_repeats(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: strings of ``PASSAGE_BYTES`` that occur more than once are cut out of the texts."""
    key, k, cuts = _free(docs, "key", "k", "cuts")
    keyed = _keyed(docs, key)
    spans = materialize_last(lambda: suffix.repeated_spans(keyed, doc_id=key, length=PASSAGE_BYTES).where("n_removed > 0")
                             .select(F.col("doc_id").alias(k), F.col("spans").alias(cuts)).dropDuplicates([k]), "pipeline-spans")
    cut = F.udf(suffix.cut_spans, "string", useArrow=True)
    joined = keyed.join(spans, F.col(key) == F.col(k), "left")
    changed = F.col(cuts).isNotNull()
    joined = joined.withColumn("text", F.when(changed, cut("text", cuts)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        n = F.length("text").cast(docs.schema["n_chars"].dataType)
        joined = joined.withColumn("n_chars", F.when(changed, n).otherwise(F.col("n_chars")))
    return joined.select(_own(docs))


def without_benchmark(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that hold a benchmark item go. Filtered where they are read, with no shuffle."""
    prepare_session(spark)
    return docs.where(~decontam.contaminated_column(spark, read(spark, sf_dir, "benchmark"), "text"))


def encoded(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: SentencePiece ids of what is left."""
    return wfst.encode_documents(docs, vocabulary(PIECE_BPE))


STAGES = [("toxicity", without_toxic), ("near_duplicates", one_of_each_group), ("repeated_passages", without_repeats),
          ("decontamination", without_benchmark), ("sentencepiece", encoded)]


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read back."""
    prepare_session(spark)
    docs = read(spark, sf_dir, "documents")
    base = scratch_path(spark, f"millstone/pipeline-{uuid.uuid4().hex[:12]}")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
