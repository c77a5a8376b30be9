"""Camera data derived from the generated star schema, as the same SQL on Spark and DuckDB.

Boxes have whole-number corners; a camera's frame holds a few of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import synthetic

FRAMES = 5000

#: One box a line item. The order in a frame is total.
DETECTIONS = f"""SELECT l_suppkey % 4 AS camera, l_orderkey % {FRAMES} AS frame_id,
  row_number() OVER (PARTITION BY l_suppkey % 4, l_orderkey % {FRAMES} ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS det_idx,
  CAST(l_partkey % 200 AS DOUBLE) AS x1, CAST((l_suppkey * 7) % 100 AS DOUBLE) AS y1, CAST(l_partkey % 200 + 40 + l_quantity AS DOUBLE) AS x2, CAST((l_suppkey * 7) % 100 + 80 + l_quantity AS DOUBLE) AS y2,
  CAST(1 - 5 * l_discount AS DOUBLE) AS score, ascii(l_returnflag) AS class_id, l_orderkey FROM lineitem"""

#: Ground truth, and predictions that are shifted and partly missing.
TRUTH = "SELECT camera, frame_id, det_idx AS id, x1, y1, x2, y2 FROM det"
PREDICTIONS = "SELECT camera, frame_id, det_idx + 100 AS id, x1 + l_orderkey % 5 AS x1, y1, x2 + l_orderkey % 5 AS x2, y2 FROM det WHERE l_orderkey % 7 <> 0"

#: Appearance vectors with an identity and a camera; queries are every twentieth.
GALLERY = "SELECT vec_id AS entry_id, CAST(embedding AS {doubles}) AS vector, label AS identity, vec_id % 5 AS camera_id FROM embeddings"
QUERIES = "SELECT vec_id AS query_id, CAST(embedding AS {doubles}) AS vector, label AS identity, vec_id % 5 AS camera_id FROM embeddings WHERE vec_id % 20 = 0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _of(source: DataFrame, name: str, sql: str) -> DataFrame:
    return source.sparkSession.sql(sql.replace(f"FROM {name}", "FROM {src}"), src=source)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of DETECTIONS; boxes are numbered before their columns are made, so that only the table's columns are shuffled."""
    number = DETECTIONS[DETECTIONS.index("row_number()") : DETECTIONS.index(" AS det_idx")]
    source = _of(table(spark, sf_dir, "lineitem"), "lineitem", f"SELECT *, {number} AS det_idx FROM lineitem")
    return _of(source, "lineitem", DETECTIONS.replace(f"{number} AS det_idx", "det_idx"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(detections(spark, sf_dir), "det", TRUTH).withColumn("sequence", F.concat(F.lit("cam"), "camera")).drop("camera")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(detections(spark, sf_dir), "det", PREDICTIONS).withColumn("sequence", F.concat(F.lit("cam"), "camera")).drop("camera")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truth(spark, sf_dir).select("sequence").distinct().withColumn("length", F.lit(FRAMES))


def gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(table(spark, sf_dir, "embeddings"), "embeddings", GALLERY.format(doubles="ARRAY<DOUBLE>"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(table(spark, sf_dir, "embeddings"), "embeddings", QUERIES.format(doubles="ARRAY<DOUBLE>"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per frame of every camera, empty ones included."""
    det = detections(spark, sf_dir)
    item = F.struct(*[F.col(c).cast("float").alias(c) for c in ("x1", "y1", "x2", "y2", "score")], F.col("class_id").cast("int").alias("class_id"), F.lit(None).cast("array<float>").alias("embedding"), "det_idx")
    packed = det.groupBy("camera", "frame_id").agg(F.array_sort(F.collect_list(F.struct("det_idx", item.alias("i")))).alias("a"))
    packed = packed.select("camera", "frame_id", F.transform("a", lambda x: x["i"]).alias("items"))
    every = det.select("camera").distinct().crossJoin(spark.range(FRAMES).select(F.col("id").alias("frame_id")))
    out = every.join(packed, ["camera", "frame_id"], "left")
    return out.select(F.concat(F.lit("cam"), "camera").alias("camera_id"), "frame_id", F.lit(400).alias("height"), F.lit(400).alias("width"), "items")


def walkers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cameras and frames of the boxes, with synthetic objects that move through them."""
    seen = detections(spark, sf_dir).select(F.concat(F.lit("cam"), "camera").alias("camera_id"), "frame_id").distinct()
    return synthetic.detections(seen.select("*", F.lit(480).alias("height"), F.lit(640).alias("width")), objects=6, jitter=2.0, speed=0.004, seed=7)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appearance vectors seen by two cameras each, in instants of a group of ten: the second view is turned a little."""
    e = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL")
    base = e.select(F.concat(F.lit("g"), F.col("vec_id") % 7).alias("group_id"), F.floor(F.col("vec_id") / 70).alias("block"), "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    views = base.withColumn("view", F.explode(F.array(F.lit(0), F.lit(1))))
    turned = F.transform("v", lambda x, k: x + F.when((F.col("view") == 1) & (k % 8 == F.col("vec_id") % 8), 0.03).otherwise(0.0))
    views = views.withColumn("v", turned)
    from ..functions import vectors

    seen = views.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return seen.select(
        "group_id", (F.col("block") * 5 + F.col("t")).cast("long").alias("instant"), F.concat(F.lit("cam"), F.col("view")).alias("camera_id"), F.col("vec_id").alias("track_id"),
        *[F.lit(x).cast("float").alias(c) for c, x in (("x1", 100), ("y1", 300), ("x2", 200), ("y2", 700))], vectors.normalised(F.col("v")).cast("array<float>").alias("embedding"), F.lit(1080).alias("frame_h"), F.lit(1920).alias("frame_w"),
    )
