"""A seam for models: a user's detector or extractor is built once a task and applied to Arrow batches.

The runtimes themselves (torch, TensorRT) are not part of this library. Whatever
can turn an array into an array can stand behind `make`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contracts import Detector, Extractor, checked_hw, checked_pad, checked_rows
from ..errors import require
from ..functions import imaging
from . import detection

TENSORS = "frame_id long, values array<array<double>>"


def _image(row) -> np.ndarray:
    return np.frombuffer(row.content, dtype=np.uint8).reshape(int(row.height), int(row.width), 3)


def run_detector(images: DataFrame, make: Callable[[], Detector], *, batch: int = 16, pad: int = 114, mean=None, std=None) -> DataFrame:
    """(frame_id, values) for detection.decode, from images (frame_id, content, height, width) of BGR bytes.

    Images are letterboxed and run `batch` at a time; a detector that gives another
    number of results than inputs, or rows too short, is an error.
    """
    require(batch >= 1, f"batch must be 1 or more, got {batch}")
    checked_pad(pad)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        target = checked_hw(model.input_hw)
        for pdf in parts:
            for a in range(0, len(pdf), batch):
                rows = pdf.iloc[a : a + batch]
                made = np.stack([imaging.letterbox(_image(r), target, pad=pad, mean=mean, std=std) for r in rows.itertuples()])
                found = checked_rows(model.execute(made), len(rows), 6, "the detector")
                yield pd.DataFrame({"frame_id": rows["frame_id"].to_numpy(), "values": [[list(map(float, r)) for r in one] for one in found]})

    return images.select(F.col("frame_id").cast("long"), "content", "height", "width").mapInPandas(run, TENSORS)


def detected(images: DataFrame, make: Callable[[], Detector], target: tuple[int, int], *, batch: int = 16, **options) -> DataFrame:
    """Images to frames with items: letterbox, model, decode. images also has camera_id; options go to detection.decode."""
    tensors = run_detector(images, make, batch=batch)
    return detection.decode(tensors, images.select("camera_id", F.col("frame_id").cast("long").alias("frame_id"), "height", "width"), checked_hw(target), **options)


def run_extractor(crops: DataFrame, make: Callable[[], Extractor], size: tuple[int, int], *, batch: int = 64, mean=None, std=None) -> DataFrame:
    """(crop_id, vector) from crops (crop_id, content, height, width, x1, y1, x2, y2) of BGR images; vectors are of unit length."""
    require(batch >= 1, f"batch must be 1 or more, got {batch}")
    size = checked_hw(size)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in parts:
            for a in range(0, len(pdf), batch):
                rows = pdf.iloc[a : a + batch]
                made = np.concatenate([imaging.crops(_image(r), np.array([[r.x1, r.y1, r.x2, r.y2]], dtype=np.float32), size, mean=mean, std=std) for r in rows.itertuples()])
                found = checked_rows(model.extract(made), len(rows), model.dim, "the extractor").astype(float)
                found /= np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)
                yield pd.DataFrame({"crop_id": rows["crop_id"].to_numpy(), "vector": [list(map(float, v)) for v in found]})

    return crops.select(F.col("crop_id").cast("long"), "content", "height", "width", "x1", "y1", "x2", "y2").mapInPandas(run, "crop_id long, vector array<float>")
