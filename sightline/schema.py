"""Schemas of the tables, and guards that refuse bad rows when a query runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOX = T.StructType([T.StructField(c, T.FloatType()) for c in ("x1", "y1", "x2", "y2")])
VECTOR = T.ArrayType(T.FloatType())
DETECTION = T.StructType([*BOX.fields, T.StructField("score", T.FloatType()), T.StructField("class_id", T.IntegerType()), T.StructField("embedding", VECTOR)])
FRAME_KEY = [T.StructField("camera_id", T.StringType()), T.StructField("frame_id", T.LongType())]
#: One row per frame; an empty frame is a row with no items.
FRAMES = T.StructType([*FRAME_KEY, T.StructField("ts", T.TimestampType()), T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("items", T.ArrayType(DETECTION))])
TRACK_STATES = ["tentative", "confirmed", "lost", "removed"]
TRACKS = T.StructType([
    *FRAME_KEY, T.StructField("track_id", T.LongType()), *BOX.fields, T.StructField("state", T.StringType()), T.StructField("score", T.FloatType()),
    T.StructField("class_id", T.IntegerType()), T.StructField("age", T.IntegerType()), T.StructField("hits", T.IntegerType()), T.StructField("time_since_update", T.IntegerType()), T.StructField("embedding", VECTOR),
])
EMBEDDINGS = T.StructType([T.StructField("entry_id", T.LongType()), T.StructField("vector", VECTOR), T.StructField("identity", T.StringType()), T.StructField("camera_id", T.StringType()), T.StructField("frame_id", T.LongType()), T.StructField("quality", T.FloatType())])
OBSERVATIONS = T.StructType([
    T.StructField("group_id", T.StringType()), T.StructField("instant", T.LongType()), T.StructField("camera_id", T.StringType()), T.StructField("track_id", T.LongType()),
    *BOX.fields, T.StructField("embedding", VECTOR), T.StructField("frame_h", T.IntegerType()), T.StructField("frame_w", T.IntegerType()), T.StructField("hits", T.IntegerType()),
])
OBJECTS = T.StructType([T.StructField("sequence", T.StringType()), T.StructField("frame_id", T.LongType()), T.StructField("id", T.LongType()), *BOX.fields])
HOMOGRAPHIES = T.StructType([
    T.StructField("camera_id", T.StringType()), T.StructField("matrix", T.ArrayType(T.DoubleType())), *[T.StructField(c, T.IntegerType()) for c in ("camera_width", "camera_height", "map_width", "map_height")], T.StructField("max_error", T.DoubleType()),
])


def refuse(value: Column, bad: Column, message: str) -> Column:
    """value, or an error where bad holds."""
    return F.when(bad, F.raise_error(F.lit(message))).otherwise(value)


def not_finite(value: Column) -> Column:
    return F.isnan(value) | (F.abs(value) == float("inf"))


def finite(value: Column, what: str) -> Column:
    """value, or an error where it is NaN or infinite; null passes."""
    return refuse(value, not_finite(value), f"{what} must be finite")


def finite_array(value: Column, what: str) -> Column:
    """An array, or an error that names the first index that is not finite."""
    bad = F.transform(value, lambda v: F.coalesce(not_finite(v.cast("double")), F.lit(False)))
    at = F.array_position(bad, True)
    return F.when(at > 0, F.raise_error(F.concat(F.lit(f"{what} must be finite, index "), (at - 1).cast("string")))).otherwise(value)


def checked_boxes(df: DataFrame) -> DataFrame:
    """df with its corners refused unless finite and in order."""
    out = df.withColumns({c: finite(F.col(c), f"box corner {c}") for c in ("x1", "y1", "x2", "y2")})
    message = "box corners must satisfy x2 >= x1 and y2 >= y1"
    return out.withColumns({"x2": refuse(F.col("x2"), F.col("x2") < F.col("x1"), message), "y2": refuse(F.col("y2"), F.col("y2") < F.col("y1"), message)})


def one_width(df: DataFrame, vector: str) -> DataFrame:
    """df unless its vectors have several widths or some are missing; the check is one aggregation joined back."""
    width = df.agg(F.count_if(F.col(vector).isNull()).alias("__none"), F.min(F.size(vector)).alias("__low"), F.max(F.size(vector)).alias("__high"))
    bad = (F.col("__none") > 0) | (F.col("__low") != F.col("__high"))
    ok = width.select(F.when(bad, F.raise_error(F.lit(f"every {vector} must be there and of one width"))).otherwise(F.lit(True)).cast("boolean").alias("__ok"))
    return df.crossJoin(F.broadcast(ok)).where("__ok").drop("__ok")


def unique(df: DataFrame, keys: list[str], message: str) -> DataFrame:
    """df, or an error where keys repeat."""
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("__n", n).where(refuse(F.lit(True), F.col("__n") > 1, message)).drop("__n")
