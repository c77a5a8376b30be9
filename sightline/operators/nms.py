"""Non-maximum suppression inside a key."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import require
from ..functions.arrays import iou as iou_matrix
from ..functions.boxes import Box, iou
from ..plans.grouping import chunked_map

METHODS = ["none", "classic", "linear", "gauss", "neighborhood"]


def _checked() -> Column:
    return F.when(F.isnan(F.col("score")), F.raise_error(F.lit("NMS scores must not be NaN"))).otherwise(F.col("score"))


def ranked(df: DataFrame, keys: list[str], row: str, score_threshold: float) -> DataFrame:
    """Rows that score the threshold or more, with their rank by falling score, ties by row; NaN is refused."""
    score = _checked()
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), row)
    return df.withColumn("score", score).where(F.col("score") >= score_threshold).withColumn("__rank", F.row_number().over(order))


def _box(c: Column) -> Box:
    return Box(c["x1"].cast("double"), c["y1"].cast("double"), c["x2"].cast("double"), c["y2"].cast("double"))


def _sorted_items(df: DataFrame, keys: list[str], row: str, score_threshold: float) -> DataFrame:
    score = _checked()
    item = F.struct((-score).alias("neg"), F.col(row).alias("row"), score.alias("score"), *[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    return df.where(F.col("score") >= score_threshold).groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))


def _classic(items: Column, iou_threshold: float) -> Column:
    """The kept items of a sorted array: an item stays if it overlaps no kept one above the threshold."""
    none = F.filter(items, lambda x: F.lit(False))

    def step(kept: Column, x: Column) -> Column:
        return F.when(F.exists(kept, lambda k: iou(_box(k), _box(x)) > iou_threshold), kept).otherwise(F.concat(kept, F.array(x)))

    return F.aggregate(items, none, step)


def decay(overlaps: np.ndarray, method: str, sigma: float) -> np.ndarray:
    """What is left of the scores of overlapping boxes: nothing, 1 - IoU, or exp(-IoU^2 / sigma)."""
    return np.zeros_like(overlaps) if method == "classic" else 1 - overlaps if method == "linear" else np.exp(-(overlaps**2) / sigma)


def _soft(boxes: np.ndarray, scores: np.ndarray, iou_threshold: float, method: str, sigma: float, score_threshold: float) -> tuple[list[int], np.ndarray]:
    """Rows kept, best first, of rows in falling order, and what the scores became."""
    scores = scores.copy()
    alive = np.ones(len(scores), dtype=bool)
    kept = []
    while alive.any():
        best = int(np.where(alive, scores, -np.inf).argmax())
        alive[best] = False
        kept.append(best)
        rest = np.flatnonzero(alive)
        if not len(rest):
            break
        over = iou_matrix(boxes[best : best + 1], boxes[rest])[0]
        hit = np.ones(len(rest), dtype=bool) if method == "gauss" else over > iou_threshold
        scores[rest[hit]] *= decay(over[hit], method, sigma)
        alive[rest] = scores[rest] >= max(score_threshold, 1e-12)
    return kept, scores


def _backed(boxes: np.ndarray, scores: np.ndarray, iou_threshold: float, min_neighbors: int, min_score_sum: float) -> list[int]:
    """Rows of the classic survivors, of rows in falling order, that suppressed enough others; a box counts for the first that drops it."""
    alive = np.arange(len(scores))
    kept = []
    while len(alive):
        best = alive[0]
        near = iou_matrix(boxes[best : best + 1], boxes[alive])[0] > iou_threshold
        near[0] = True
        # summed one by one, best first
        if near.sum() - 1 >= min_neighbors and np.cumsum(scores[alive[near]])[-1] >= min_score_sum:
            kept.append(int(best))
        alive = alive[~near]
    return kept


def suppress(df: DataFrame, keys: list[str], row: str, *, iou_threshold: float, method: str = "classic", sigma: float = 0.5, score_threshold: float = 0.0, min_neighbors: int = 0, min_score_sum: float = 0.0, max_output: int | None = None) -> DataFrame:
    """The survivors of each key: keys, row, score and rank, best first.

    classic drops what overlaps a kept box by more than the threshold; linear and
    gauss lower scores instead; neighborhood keeps a classic survivor only if it
    suppressed min_neighbors boxes whose scores, its own included, sum to
    min_score_sum; none only ranks. Ties go to the lower row.
    """
    require(method in METHODS, f"method must be one of {METHODS}, got {method!r}")
    require(0 <= iou_threshold <= 1, f"iou_threshold must be in [0, 1], got {iou_threshold}")
    require(sigma > 0, f"sigma must be above 0, got {sigma}")
    require(max_output is None or max_output >= 0, f"max_output must be None or 0 or more, got {max_output}")
    slim = df.select(*keys, row, "score", "x1", "y1", "x2", "y2")
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), row)
    if method == "none":
        out = ranked(slim, keys, row, score_threshold).select(*keys, row, "score", F.col("__rank").alias("rank"))
    elif method == "classic":
        kept = _sorted_items(slim, keys, row, score_threshold).withColumn("kept", _classic(F.col("items"), iou_threshold))
        out = kept.select(*keys, F.posexplode("kept").alias("rank", "k")).select(*keys, F.col("k.row").alias(row), F.col("k.score").alias("score"), (F.col("rank") + 1).alias("rank"))
    else:
        kinds = dict(slim.dtypes)
        if method == "neighborhood":
            slim = slim.where("score IS NOT NULL").withColumn("score", _checked())
        else:
            kinds["score"] = "double"

        def each(pdf: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
            boxes, scores = pdf[["x1", "y1", "x2", "y2"]].to_numpy(dtype=float), pdf["score"].to_numpy(dtype=float)
            order = np.lexsort((pdf[row].to_numpy(), -scores, np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))))
            at, left = [], []
            for a, b in zip(cuts[:-1], cuts[1:]):
                own = order[a:b]
                own = own[scores[own] >= score_threshold]
                if method == "neighborhood":
                    kept, now = _backed(boxes[own], scores[own], iou_threshold, min_neighbors, min_score_sum), scores[own]
                else:
                    kept, now = _soft(boxes[own], scores[own], iou_threshold, method, sigma, score_threshold)
                at.append(own[kept])
                left.append(now[kept])
            at = np.concatenate(at)
            return pdf.iloc[at] if method == "neighborhood" else pdf.iloc[at].assign(score=np.concatenate(left))

        schema = ", ".join(f"`{c}` {kinds[c]}" for c in slim.columns)
        out = chunked_map(slim, keys, each, schema).select(*keys, row, "score").withColumn("rank", F.row_number().over(order))
    return out if max_output is None else out.where(F.col("rank") <= max_output)
