"""Labelled rows for learning: folds, one label a document, and a bounded sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HELD_OUT, FOLDS = 0, 5


def held_out(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 5, is 0; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def label_sample(labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(doc_id, label) outside the held-out fold: at most ``limit`` documents, by a hash of doc_id.

    Null ids and labels are left out; a document with several labels has their
    majority, 1 on a tie.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    each = known.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    return each.orderBy(F.xxhash64("doc_id", F.lit("labels")), "doc_id").limit(limit)
