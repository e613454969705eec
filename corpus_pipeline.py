"""The corpus pipeline: five stages over ``documents``, each written and read again.

Each stage works on all that its predecessor kept and returns the columns of ``documents``,
but for the last, which returns the packed pieces.

* Language ID: the model learns from the labelled rows of its input (all folds); documents
  that are ``und`` (null, or without a letter) go.
* Line dedup: repeated lines go from the texts; a document all of whose words stood in
  repeated lines goes.
* MinHash near-dedup: of each class the document with the smallest id stays, in one row.
* Mixing: documents come as often as the mix takes them, so rows may repeat; their quality
  comes from the table ``labels``.
* Packing: every piece of every row gets its place.

Defined cases: rows with a null doc_id stay documents of their own, but for a null text, which
goes with the other ``und``; rows that share a doc_id leave the near-dedup as one; empty
tables give an empty result.

No stage can be written in SQL (a fitted classifier, a tokenizer), so there is no oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coreloom.llm import language_id, line_dedup, minhash, mixing, packing, util


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    filters = language_id.learn(docs.select("doc_id", "lang", "text"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")  # so that no name clashes
    return language_id.predict(rows, filters).where("lang_pred <> 'und'").select("row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(docs, exact_chars=line_dedup.EXACT_CHARS)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.kept_rows(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs, labels=util.read_table(spark, sf_dir, "labels") if sf_dir else None)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", dedup_near),
    ("mix_sources", mix),
    ("best_fit_packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents`` of ``sf_dir``."""
    docs = util.read_table(spark, sf_dir, "documents")
    run_dir = f"{util.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES[:-1]):
        out = f"{run_dir}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return STAGES[-1][1](spark, docs, sf_dir)
