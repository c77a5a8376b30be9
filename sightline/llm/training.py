"""Folds and bounded labelled samples for the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_fold(doc_id: str, parts: int) -> Column:
    """Whether crc32(doc_id as text) mod parts is 0; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts == 0


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, label, rank, text) of at most `most` training documents, chosen by a hash of doc_id.

    A document counts as labelled 1 if any of its label rows says so; a label row
    without doc_id or label says nothing. Rows that repeat a doc_id count as one
    document, with the text of smallest hash; a null text is empty. At most `most`
    label rows are broadcast, so the texts are joined where they lie. Without
    labels, or without documents, there are no rows.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~in_fold("doc_id", 5))
    known = known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    chosen = known.withColumn("rank", F.xxhash64("doc_id", F.lit(17))).orderBy("rank", "doc_id").limit(most)
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "label", "rank").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def within(df: DataFrame, size: str, most: int) -> DataFrame:
    """The first rows of a bounded sample by rank whose summed size stays within `most`; one at least."""
    held = df.select("rank", size).toPandas().sort_values("rank")
    if not len(held):
        return df
    fits = max(1, int(np.searchsorted(np.cumsum(held[size].to_numpy()), most, side="right")))
    return df.where(F.col("rank") <= int(held["rank"].iloc[fits - 1]))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))
