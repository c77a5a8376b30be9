"""The corpus pipeline: toxic documents go, lines and documents are deduplicated, benchmark passages go, sources are mixed.

Every stage works on all rows of the one before. Null and empty texts pass the
first four stages as documents without sentences, lines, words and passages, and
are not drawn by the last, as they have no tokens. Rows that repeat a doc_id and
its text share their lot; of them the third stage keeps one. Extra columns are
carried along, whatever their names but for those that begin with __sl_. An empty
table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sightline.llm import decontaminate, line_dedup, mixing, ngram_join, toxicity
from sightline.llm.cluster import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; learned from the labelled documents among docs, without any nothing goes."""
    return toxicity.without_toxic(docs, _table(spark, sf_dir, "labels"), cut=0.5)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of like lines the occurrence of smallest doc_id stays; documents that lose their last line go."""
    return line_dedup.without_repeated_lines(docs, least_words=5, distance=3, similarity=0.9)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents of an n-gram similarity of 0.8 that of smallest doc_id stays."""
    return ngram_join.deduplicate(docs, size=5, threshold=0.8, recall=0.99)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.without_contaminated(docs, _table(spark, sf_dir, "benchmark"), q=12, edits=0.07)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of half the tokens, raked to the flattened margins of source, language and topic; the same one each time."""
    return mixing.sampled(docs, power=0.5, fraction=0.5)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", dedup_documents),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("mixing", mix),
]

#: The stages' classifier and similarity searches have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and reread as the next one's."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
