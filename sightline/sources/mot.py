"""MOTChallenge folders as tables: scans of annotations, detections and sequence data, and the submission sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ParameterError
from ..schema import refuse

ANNOTATIONS = "frame_id INT, id LONG, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE, conf DOUBLE, cls INT, visibility DOUBLE"
DETECTIONS = "frame_id INT, id LONG, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE, score DOUBLE"
#: Classes of distractors, whose predictions neither help nor harm.
IGNORED_CLASSES = [2, 7, 8, 12]
PEDESTRIAN = 1


def discover(spark: SparkSession, root: str, pattern: str = "MOT*") -> list[str]:
    """The names of sequence folders that hold seqinfo.ini, sorted; none is an error. Listed by Spark's file system."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{pattern}/seqinfo.ini")
    found = path.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(path)
    names = sorted(f.getPath().getParent().getName() for f in (found or []))
    if not names:
        raise ParameterError(f"no sequence like {pattern} with a seqinfo.ini under {root}")
    return names


def _exists(spark: SparkSession, path: str) -> bool:
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return bool(place.getFileSystem(context._jsc.hadoopConfiguration()).exists(place))


def files(spark: SparkSession, root: str, names: list[str]) -> list[dict]:
    """Where each sequence's three files are, and which exist."""
    out = []
    for name in names:
        paths = {"seqinfo": f"{root}/{name}/seqinfo.ini", "ground_truth": f"{root}/{name}/gt/gt.txt", "detections": f"{root}/{name}/det/det.txt"}
        out.append({"sequence": name, **paths, **{f"has_{k}": _exists(spark, p) for k, p in paths.items() if k != "seqinfo"}})
    return out


def _paths(root: str, names: list[str], file: str) -> list[str]:
    return [f"{root.rstrip('/')}/{n}/{file}" for n in names]


def _sequence(depth: int):
    """The name of the sequence folder that a row's file lies in."""
    return F.element_at(F.split(F.input_file_name(), "/"), -depth)


def sequences(spark: SparkSession, root: str, names: list[str] | None = None) -> DataFrame:
    """One row per sequence: name, length, frame_rate, width, height, image_dir, extension; a length below 1 is refused."""
    names = names or discover(spark, root)
    lines = spark.read.text(_paths(root, names, "seqinfo.ini")).select(_sequence(2).alias("name"), F.split("value", "=", 2).alias("kv"))
    kept = lines.where("size(kv) = 2").groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct(F.lower(F.trim(F.col("kv")[0])), F.trim(F.col("kv")[1])))).alias("m"))
    get = lambda key, kind, other: F.coalesce(F.try_element_at("m", F.lit(key)).cast(kind), F.lit(other))
    out = kept.select(
        F.url_decode("name").alias("name"), get("seqlength", "int", 0).alias("length"), get("framerate", "double", 0.0).alias("frame_rate"), get("imwidth", "int", 0).alias("width"), get("imheight", "int", 0).alias("height"),
        get("imdir", "string", "img1").alias("image_dir"), get("imext", "string", ".jpg").alias("extension"),
    )
    return out.withColumn("length", refuse(F.col("length"), F.col("length") < 1, "seqLength must be 1 or more"))


def image_path(root, image_dir, frame_id, extension):
    """Path of a frame's image: its number from 1 in six digits."""
    return F.concat_ws("/", root, image_dir, F.concat(F.lpad(frame_id.cast("string"), 6, "0"), extension))


def annotations(spark: SparkSession, root: str, names: list[str], *, min_visibility: float = 0.0) -> DataFrame:
    """gt.txt rows as objects with a role: scored, ignored or unscored, from one scan.

    Pedestrians that count and are visible enough are scored; distractor classes
    are ignored; the rest still claims predictions but is not scored.
    """
    raw = spark.read.schema(ANNOTATIONS).option("mode", "FAILFAST").csv(_paths(root, names, "gt/gt.txt")).withColumn("sequence", F.url_decode(_sequence(3)))
    scored = (F.coalesce("cls", F.lit(PEDESTRIAN)) == PEDESTRIAN) & (F.coalesce("conf", F.lit(1.0)) != 0) & (F.coalesce("visibility", F.lit(1.0)) >= min_visibility)
    role = F.when(scored, "scored").when(F.col("cls").isin(IGNORED_CLASSES), "ignored").otherwise("unscored")
    return raw.select("sequence", F.col("frame_id").cast("long").alias("frame_id"), "id", *_corners(), role.alias("role"))


def _corners() -> list:
    return [F.col("x").cast("float").alias("x1"), F.col("y").cast("float").alias("y1"), (F.col("x") + F.col("w")).cast("float").alias("x2"), (F.col("y") + F.col("h")).cast("float").alias("y2")]


def detections(spark: SparkSession, root: str, names: list[str], *, min_score: float = 0.0) -> DataFrame:
    """det.txt as frames: one row for each frame 1 to length, empty ones included; scores outside [0, 1] are refused."""
    raw = spark.read.schema(DETECTIONS).option("mode", "FAILFAST").csv(_paths(root, names, "det/det.txt")).withColumn("sequence", F.url_decode(_sequence(3)))
    score = F.coalesce("score", F.lit(1.0))
    score = refuse(score, (score < 0) | (score > 1) | F.isnan(score), "detection scores must lie in [0, 1]")
    rows = raw.select("sequence", "frame_id", *_corners(), score.cast("float").alias("score"), F.lit(0).alias("class_id"), F.lit(None).cast("array<float>").alias("embedding"))
    rows = rows.where(F.col("score") >= min_score)
    item = F.struct("x1", "y1", "x2", "y2", "score", "class_id", "embedding")
    packed = rows.groupBy("sequence", F.col("frame_id").cast("long").alias("frame_id")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    info = sequences(spark, root, names)
    every = info.select(F.col("name").alias("sequence"), "height", "width", "frame_rate", F.explode(F.sequence(F.lit(1).cast("long"), F.col("length").cast("long"))).alias("frame_id"))
    out = every.join(packed, ["sequence", "frame_id"], "left")
    empty = F.array().cast(packed.schema["items"].dataType)
    ts = F.when(F.col("frame_rate") > 0, F.timestamp_micros((F.col("frame_id") / F.col("frame_rate") * 1_000_000).cast("long")))
    return out.select(F.col("sequence").alias("camera_id"), "frame_id", ts.alias("ts"), "height", "width", F.coalesce("items", empty).alias("items"))


def case(spark: SparkSession, root: str, names: list[str] | None = None, *, min_score: float = 0.0, min_visibility: float = 0.0, frames: int = 0) -> dict[str, DataFrame]:
    """frames, truth, ignored, unscored and sequences of some or all sequences, cut to the first `frames` if above 0."""
    known = discover(spark, root)
    unknown = sorted(set(names or []) - set(known))
    if unknown:
        raise ParameterError(f"no sequences {unknown}; there are {known}")
    names = names or known
    marked = annotations(spark, root, names, min_visibility=min_visibility)
    out = {"frames": detections(spark, root, names, min_score=min_score), "sequences": sequences(spark, root, names).withColumnRenamed("name", "sequence")}
    out |= {role: marked.where(F.col("role") == name).drop("role") for role, name in (("truth", "scored"), ("ignored", "ignored"), ("unscored", "unscored"))}
    return truncated(out, frames) if frames else out


def truncated(tables: dict[str, DataFrame], frames: int) -> dict[str, DataFrame]:
    """The first `frames` frames of every table of a case alike."""
    out = {k: t.where(F.col("frame_id") <= frames) if k != "sequences" else t.withColumn("length", F.least("length", F.lit(frames))) for k, t in tables.items()}
    return out


def write_submission(tracks: DataFrame, path: str) -> None:
    """tracks as frame,id,x,y,w,h,1,-1,-1,-1 with two decimals, sorted by frame and id; one file a camera.

    A submission file is of one sequence, so each is sorted in one task.
    """
    two = lambda c: F.format_string("%.2f", c.cast("double"))
    line = F.concat_ws(",", "frame_id", "track_id", two(F.col("x1")), two(F.col("y1")), two(F.col("x2") - F.col("x1")), two(F.col("y2") - F.col("y1")), F.lit("1,-1,-1,-1"))
    rows = tracks.select("camera_id", "frame_id", "track_id", line.alias("value"))
    rows.repartition("camera_id").sortWithinPartitions("camera_id", "frame_id", "track_id").select("camera_id", "value").write.mode("overwrite").partitionBy("camera_id").text(path)
