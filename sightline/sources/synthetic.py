"""A deterministic detector for tests and load: objects that move on reflecting lines, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import require


def reflected(value: Column, limit: Column) -> Column:
    """A coordinate folded into [0, limit] like light between mirrors."""
    turn = F.pmod(value, 2 * limit)
    return F.when(turn > limit, 2 * limit - turn).otherwise(turn)


def _share(*parts: Column) -> Column:
    """A number in [0, 1) that the parts fix."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) / float(1 << 30)


def detections(frames: DataFrame, *, objects: int = 3, classes: tuple[int, ...] = (0,), jitter: float = 0.0, speed: float = 0.01, scores: tuple[float, float] = (0.55, 0.95), sizes: tuple[float, float] = (0.08, 0.25), aspect: float = 0.5, seed: int = 0) -> DataFrame:
    """frames (camera_id, frame_id, height, width) with items: each object's box, by falling score.

    An object's size, start, direction and score come from hashes of seed, camera
    and number; its place is that start moved by speed times the frame's number,
    plus jitter that the frame's number fixes.
    """
    require(objects >= 0 and len(classes) > 0, "objects must be 0 or more, and one class at least")
    one = frames.withColumn("o", F.explode(F.sequence(F.lit(1), F.lit(objects)))) if objects else frames.withColumn("o", F.lit(1)).where("false")
    key = (F.lit(seed), F.col("camera_id"), F.col("o"))
    extent = F.least("height", "width").cast("double")
    h = extent * (sizes[0] + (sizes[1] - sizes[0]) * _share(*key, F.lit("size")))
    w = h * aspect
    moved = lambda axis, room: reflected(_share(*key, F.lit(axis)) * room + (2 * _share(*key, F.lit(axis + "v")) - 1) * 2 * speed * extent * F.col("frame_id"), room)
    shake = lambda axis: jitter * (2 * _share(*key, F.col("frame_id"), F.lit(axis)) - 1)
    x = F.least(F.greatest(moved("x", F.col("width") - w) + shake("x"), F.lit(0.0)), F.col("width") - w)
    y = F.least(F.greatest(moved("y", F.col("height") - h) + shake("y"), F.lit(0.0)), F.col("height") - h)
    score = scores[0] + (scores[1] - scores[0]) * _share(*key, F.col("frame_id"), F.lit("score"))
    kinds = F.array(*[F.lit(c) for c in classes])
    kind = kinds[(F.pmod(F.xxhash64(*key, F.lit("class")), F.lit(len(classes)))).cast("int")]
    item = F.struct(x.cast("float").alias("x1"), y.cast("float").alias("y1"), (x + w).cast("float").alias("x2"), (y + h).cast("float").alias("y2"), score.cast("float").alias("score"), kind.alias("class_id"), F.lit(None).cast("array<float>").alias("embedding"))
    packed = one.select("camera_id", "frame_id", "o", item.alias("i")).groupBy("camera_id", "frame_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("i.score")).alias("s"), "o", "i"))).alias("a"))
    out = frames.join(packed.select("camera_id", "frame_id", F.transform("a", lambda v: v["i"]).alias("items")), ["camera_id", "frame_id"], "left")
    return out.withColumn("items", F.coalesce("items", F.array().cast("array<struct<x1:float,y1:float,x2:float,y2:float,score:float,class_id:int,embedding:array<float>>>")))
