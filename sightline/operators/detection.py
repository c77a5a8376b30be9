"""From a detector's output tensors to detections per frame."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DetectorError, MissingBackendError, require
from ..functions import boxes, imaging
from ..schema import refuse
from . import nms


def candidates(tensors: DataFrame, *, conf_threshold: float = 0.25) -> DataFrame:
    """Rows of end-to-end output: frame_id, row, corners in the letterbox, score, class_id, coefficients.

    tensors holds (frame_id, values), values an array of rows of six or more
    numbers: corners, confidence, class, then mask coefficients. Inside-out boxes
    are emptied, non-finite corners refused, class ids rounded half away from zero.
    """
    rows = tensors.select("frame_id", *[c for c in tensors.columns if c not in ("frame_id", "values")], F.posexplode("values").alias("row", "v"))
    v = refuse(F.col("v"), F.size("v") < 6, "a detector's rows need six numbers")
    rows = rows.withColumn("v", v).where(F.col("v")[4] >= conf_threshold)
    corner = lambda k: refuse(F.col("v")[k], F.isnan(F.col("v")[k]) | (F.abs(F.col("v")[k]) == float("inf")), "box corners must be finite")
    b = boxes.widened(boxes.Box(*[corner(k).cast("double") for k in range(4)]))
    return rows.withColumns({**dict(zip(("x1", "y1", "x2", "y2"), b)), "score": boxes.checked_score(F.col("v")[4].cast("double")), "class_id": boxes.rounded_class(F.col("v")[5]), "coefficients": F.slice("v", 7, F.greatest(F.size("v") - 6, F.lit(0)))}).drop("v")


def suppressed(found: DataFrame, *, method: str = "none", iou_threshold: float = 0.45, class_agnostic: bool = False, max_detections: int = 300, **options) -> DataFrame:
    """The best max_detections of each frame after suppression, within classes unless class_agnostic."""
    keys = ["frame_id"] if class_agnostic else ["frame_id", "class_id"]
    kept = nms.suppress(found, keys, "row", iou_threshold=iou_threshold, method=method, **options)
    kept = kept.select("frame_id", "row", F.col("score").alias("__score"))
    out = found.join(kept, ["frame_id", "row"]).withColumn("score", F.col("__score")).drop("__score")
    order = Window.partitionBy("frame_id").orderBy(F.desc("score"), "row")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_detections)


def decode(tensors: DataFrame, frames: DataFrame, target: tuple[int, int], *, conf_threshold: float = 0.25, **suppression) -> DataFrame:
    """Frames with items in source pixels, best first; frames without detections keep an empty array.

    frames has (camera_id, frame_id, height, width). A tensor without its frame is an error.
    """
    found = suppressed(candidates(tensors, conf_threshold=conf_threshold), **suppression)
    met = found.join(frames.select("camera_id", "frame_id", "height", "width"), "frame_id", "left")
    met = met.withColumn("height", refuse(F.col("height"), F.col("height").isNull(), "a tensor's frame is not in frames"))
    back = boxes.Letterbox.plan(F.col("height"), F.col("width"), *target).invert(boxes.Box.of())
    item = F.struct(*[v.cast("float").alias(c) for c, v in zip(("x1", "y1", "x2", "y2"), back)], F.col("score").cast("float").alias("score"), "class_id", F.lit(None).cast("array<float>").alias("embedding"))
    packed = met.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("rank", item.alias("i")))).alias("a")).select("frame_id", F.transform("a", lambda x: x["i"]).alias("items"))
    out = frames.join(packed, "frame_id", "left")
    return out.withColumn("items", F.coalesce("items", F.array().cast(packed.schema["items"].dataType)))


def masks(found: DataFrame, prototypes: DataFrame, frames: DataFrame, target: tuple[int, int], *, threshold: float = 0.5, binarise: bool = True) -> DataFrame:
    """Found rows with a mask in source pixels: (frame_id, row, height, width, mask).

    prototypes has (frame_id, planes, count, ph, pw), planes flat; a frame's planes
    are joined to its few detections and worked on in Arrow batches.
    """
    met = found.select("frame_id", "row", "coefficients").join(prototypes, "frame_id").join(frames.select("frame_id", "height", "width"), "frame_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                planes = np.asarray(r.planes, dtype=np.float32).reshape(int(r.count_), int(r.ph), int(r.pw))
                logits = imaging.mask_logits(np.asarray(r.coefficients, dtype=np.float32)[None], planes)[0]
                m = imaging.unpadded_mask(logits, (int(r.height), int(r.width)), target)
                out.append((r.frame_id, r.row, r.height, r.width, (m > threshold).astype(np.float32).ravel() if binarise else m.astype(np.float32).ravel()))
            yield pd.DataFrame(out, columns=["frame_id", "row", "height", "width", "mask"])

    return met.withColumnRenamed("count", "count_").mapInPandas(run, "frame_id long, row int, height int, width int, mask array<float>")


HEADS = {(3,): "yolo26", (3, 4): "yolo26_seg"}


def head_for(shapes: list[tuple[int, ...]], name: str | None = None) -> str:
    """The head that fits the ranks of a model's outputs."""
    fits = HEADS.get(tuple(len(s) for s in shapes))
    require(fits is not None or name is not None, f"no head for outputs of shapes {shapes}; heads take ranks {list(HEADS)}")
    if name is not None and fits is not None and name != fits:
        raise DetectorError(f"head {name} does not fit outputs of shapes {shapes}")
    return name or str(fits)


def scripted_detector(path: str) -> None:
    """Model runtimes are not part of this library; a model is applied by a UDF of the user's between letterbox and decode."""
    raise MissingBackendError(f"no model runtime is installed to load {path}")


def with_extent(frames: DataFrame, declared: tuple[str, str] = ("height", "width"), measured: tuple[str, str] = ("pixel_height", "pixel_width")) -> DataFrame:
    """frames with the declared size, else the measured one; a disagreement is refused."""
    out = frames
    for d, m in zip(declared, measured):
        both = F.coalesce(F.nullif(F.col(d), F.lit(0)), F.col(m))
        out = out.withColumn(d, refuse(both, (F.col(d) > 0) & F.col(m).isNotNull() & (F.col(d) != F.col(m)), "a frame's declared size is not that of its pixels"))
    return out
