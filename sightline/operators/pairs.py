"""Pairwise joins inside a key: overlaps of boxes, similarities of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import boxes, vectors
from ..functions.arrays import worst_overlap
from ..plans.grouping import arrow_map

CORNERS = ["x1", "y1", "x2", "y2"]


def _side(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(f"{prefix}{c}") for c in df.columns if c not in keys])


def within(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """All pairs of rows of equal keys; other columns get the prefixes a_ and b_.

    An equi join: rows are dealt by the keys, so no key's pairs are made anywhere
    but where its rows are, and adaptive execution splits heavy keys.
    """
    return _side(left, keys, "a_").join(_side(right, keys, "b_"), keys)


def iou_pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs with iou and giou."""
    a, b = boxes.Box.of("a_"), boxes.Box.of("b_")
    return within(left, right, keys).withColumns({"iou": boxes.iou(a, b), "giou": boxes.giou(a, b)})


def overlapping_pairs(left: DataFrame, right: DataFrame, keys: list[str], cell: float = 256.0) -> DataFrame:
    """Only the pairs whose boxes share area, found through the grid cells that both cover.

    Each pair is made in the one cell that holds the corner of its intersection,
    so the join grows with overlaps and not with the square of a frame.
    """

    def dealt(df: DataFrame, prefix: str) -> DataFrame:
        at = lambda c: F.floor(F.col(c) / cell).cast("int")
        out = df.withColumn("__cx", F.explode(F.sequence(at("x1"), at("x2")))).withColumn("__cy", F.explode(F.sequence(at("y1"), at("y2"))))
        return _side(out, [*keys, "__cx", "__cy"], prefix)

    a, b = boxes.Box.of("a_"), boxes.Box.of("b_")
    met = dealt(left, "a_").join(dealt(right, "b_"), [*keys, "__cx", "__cy"])
    here = (F.floor(F.greatest(a.x1, b.x1) / cell) == F.col("__cx")) & (F.floor(F.greatest(a.y1, b.y1) / cell) == F.col("__cy"))
    return met.where(here & (boxes.overlap(a, b) > 0)).withColumns({"iou": boxes.iou(a, b), "giou": boxes.giou(a, b)}).drop("__cx", "__cy")


def isolation(df: DataFrame, keys: list[str], row: str) -> DataFrame:
    """df with isolation: 1 less the highest IoU with another box of its keys; 1 for a lone box, or one without a corner.

    Boxes of equal keys are compared over arrays; pairs are never rows. row tells
    the boxes of a key apart.
    """
    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)

    def each(table: pa.Table, cuts: np.ndarray) -> pa.Table:
        corners = np.column_stack([table.column(c).cast(pa.float64()).to_numpy() for c in CORNERS])
        whole = np.logical_and.reduce([table.column(c).is_valid().to_numpy() for c in (*CORNERS, row)])
        out = np.ones(len(corners))
        for a, b in zip(cuts[:-1], cuts[1:]):
            own = a + np.flatnonzero(whole[a:b])
            out[own] = np.maximum(0.0, 1 - worst_overlap(corners[own]))
        return table.append_column("isolation", pa.array(out))

    return arrow_map(df, keys, each, f"{kinds}, isolation double")


def cosine_pairs(left: DataFrame, right: DataFrame, keys: list[str], vector: str = "vector") -> DataFrame:
    """Pairs of equal keys with the dot product of their unit vectors as similarity."""
    sim = vectors.dot(F.col(f"a_{vector}"), F.col(f"b_{vector}"))
    return within(left, right, keys).withColumn("similarity", sim)


def candidate_kinds(pairs: DataFrame, keys: list[str], row: str, column: str, cost: str, most: float) -> DataFrame:
    """pairs with clear and ambiguous: the only affordable pair of its row and column, or one with rivals."""
    from pyspark.sql import Window

    fits = F.col(cost) <= most
    in_row = F.count_if(fits).over(Window.partitionBy(*keys, row))
    in_column = F.count_if(fits).over(Window.partitionBy(*keys, column))
    out = pairs.withColumns({"__r": in_row, "__c": in_column})
    return out.withColumns({"clear": fits & (F.col("__r") == 1) & (F.col("__c") == 1), "ambiguous": fits & ((F.col("__r") > 1) | (F.col("__c") > 1))}).drop("__r", "__c")
