"""Labelled rows for fitting a classifier, all of them or a bounded sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, modulus: int) -> F.Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the
    empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")),
                  F.lit(modulus)).cast("int")


def labelled_ids(labels: DataFrame, label_col: str, train, id_col: str = "doc_id") -> DataFrame:
    """(id, label) of the labelled training rows. ``train`` is a condition on
    the id. Labels that are null or not 0/1, and ids with contradicting
    labels, are left out."""
    return (labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
            .where("id is not null and label in (0, 1)").groupBy("id")
            .agg(F.min("label").alias("label"), F.max("label").alias("other"))
            .where("label = other").select("id", "label").withColumnRenamed("id", id_col).where(train))


def fit_sample(docs: DataFrame, labels: DataFrame, label_col: str, train, max_rows: int,
               id_col: str = "doc_id", text_col: str = "text", more: tuple = ()) -> DataFrame:
    """(label, text, *more) of at most ``max_rows`` labelled training rows:
    at most half of it for each label, in the order of a hash of the
    id, out of ``labelled_ids``."""
    known = labelled_ids(labels, label_col, train, id_col)
    halves = [known.where(F.col("label") == x).orderBy(F.xxhash64(id_col), id_col).limit(max_rows // 2)
              for x in (0, 1)]
    picked = halves[0].unionByName(halves[1]).select(F.col(id_col).alias("_id"), "label")
    rows = docs.select(F.col(id_col).alias("_did"), F.col(text_col).cast("string").alias("text"),
                       *[F.col(c) for c in more])
    return rows.join(picked, F.col("_did") == F.col("_id")).select("_id", "label", "text", *more)
