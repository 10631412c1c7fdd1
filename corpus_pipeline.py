"""Corpus pipeline over ``documents``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and reread as the next stage's ``docs``. All stages but
the last return the columns of documents; the last returns them too, each
document as often as the mix takes it.

1. toxicity: documents above their language's threshold go.
2. near_duplicates: of each class of near copies the smallest doc_id stays.
3. decontamination: documents that hold a benchmark passage go.
4. secrets: secrets are replaced by their kind in brackets; n_chars follows.
5. mixing: sources are repeated or thinned to their target weights.

Defined results: null texts count as empty and are kept as null; documents
with a null id are never near duplicates or contaminated, and stay; repeated rows
count as near duplicates of each other, one stays; a null source is a source of its
own; an empty table gives an empty result; further columns of the documents
travel through all stages, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basketlab.llm.decontaminate import drop_contaminated
from basketlab.llm.mixing import mix_documents
from basketlab.llm.neardup import drop_near_duplicates
from basketlab.llm.secrets import redact
from basketlab.llm.store import read
from basketlab.llm.toxicity import fit_toxicity, keep_clean, train_rows
from basketlab.session import materialize


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, fit_toxicity(docs, read(spark, sf_dir, "labels"), train_rows()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs, length_col="n_chars")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("secrets", secrets), ("mixing", mixing)]

# The classifier, MinHash and regular expressions with code-point offsets are
# not expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order on the table ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
