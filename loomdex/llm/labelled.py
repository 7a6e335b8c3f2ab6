"""Bounded, repeatable samples of labelled documents for models that are trained here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int) -> DataFrame:
    """(doc_id, text, label) of up to ``rows`` labelled documents of each class 0 and 1.

    The rows are those of the smallest md5 of doc_id among the ``usable`` ones, so
    reruns agree. The chosen ids, at most twice ``rows``, are broadcast: no text
    is shuffled. Labels other than 0 and 1 and null ids are skipped.
    """
    known = labels.where(usable & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    drawn = [
        known.where(F.col("label") == c).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(rows) for c in (0, 1)
    ]
    chosen = drawn[0].union(drawn[1]).groupBy("doc_id").agg(F.max("label").alias("label"))
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
