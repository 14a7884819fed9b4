"""Bounded samples of labelled texts, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, seed: int = 1, where: Column | None = None) -> DataFrame:
    """doc_id, text, label (0 or 1) of at most ``rows`` labelled documents, the least by a hash of
    doc_id. Labels other than 0 and 1 and null ids are left out, repeated ones count once. The
    sampled ids are bounded by ``rows``, so they are broadcast and texts stay where they are."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    if where is not None:
        chosen = chosen.filter(where)
    chosen = chosen.distinct().orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "label").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")
