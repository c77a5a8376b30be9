"""Queries of the text operators: thin wrappers that name the production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, embedding_dedup, language, language_model, line_dedup, mixing, ngram_join, pii, quality, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its weight, calibrated probability and whether it is drawn."""
    drawn = mixing.mixed(table(spark, sf_dir, "documents"), power=0.5, fraction=0.5, keep=["doc_id", "source", "lang"])
    return drawn.selectExpr("doc_id", "source", "lang", "topic", "n_tokens", "round(weight, 6) AS weight", "round(chance, 6) AS chance", "drawn")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its score and the sentences that it comes from."""
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predicted(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"), least_words=5, distance=3, similarity=0.9).drop("row_key")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scored(table(spark, sf_dir, "documents"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: class_id, its number of links and whether it stays."""
    found = ngram_join.ngram_groups(table(spark, sf_dir, "documents"), size=5, threshold=0.8, recall=0.99)
    return found.selectExpr("doc_id", "class_id", "copy_id", "n_copies", "n_links", "doc_id = class_id AS kept")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents")).drop("row_key", "found")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each benchmark passage stands in documents."""
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), q=12, edits=0.07)
    return found.drop("row_key")


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_toxicity": op2_toxicity,
    "op3_language_id": op3_language_id,
    "op4_line_dedup": op4_line_dedup,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_pii": op8_pii,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
}

#: Word 5-grams of every document, all pairs that share one, and the groups by reachability.
NGRAM_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '(?:[a-z0-9]|[^\x00-\x7F])+') AS ws FROM documents),
c AS (SELECT doc_id, ws, len(ws) AS n, array_to_string(ws, ' ') AS whole FROM w),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN n >= 5 THEN list_transform(range(1, n - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN n > 0 THEN [whole] ELSE [] END) AS gram FROM c),
z AS (SELECT doc_id, count(*) AS z FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE shared >= 0.8 * (x.z + y.z - shared) - 1e-9),
r AS (SELECT doc_id, doc_id AS near FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.near),
k AS (SELECT doc_id, min(near) AS class_id FROM r GROUP BY doc_id), n AS (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY a),
q AS (SELECT whole, min(doc_id) AS copy_id, count(*) AS n_copies FROM c WHERE n > 0 GROUP BY whole)
SELECT doc_id, class_id, coalesce(copy_id, doc_id) AS copy_id, coalesce(n_copies, 1) AS n_copies, coalesce(n_links, 0) AS n_links, doc_id = class_id AS kept FROM c JOIN k USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN q USING (whole)"""

#: All pairs of a label by cosine, and the groups by reachability.
EMBEDDING_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS size FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, label, list_transform(e, lambda x: x / size) AS e FROM g WHERE size > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) >= 0.98),
r AS (SELECT vec_id, vec_id AS near FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.near),
k AS (SELECT vec_id, min(near) AS component_id FROM r GROUP BY vec_id), n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN k USING (vec_id) LEFT JOIN n USING (vec_id)"""

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": mixing.oracle("documents", power=0.5, fraction=0.5),
    "op7_ngram_jaccard_join": NGRAM_SQL,
    "op10_embedding_near_dedup": EMBEDDING_SQL,
}
