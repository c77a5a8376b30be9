"""Costs of pairing a track with a detection, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .boxes import Box, giou, iou
from .vectors import dot

#: Cost of a pair that may not match; finite, so that solvers can sum it.
FORBIDDEN = 1e5
#: 95th percentile of chi-square with four degrees of freedom.
CHI2_95 = 9.4877


def iou_cost(track: Box, detection: Box) -> Column:
    return 1 - iou(track, detection)


def giou_cost(track: Box, detection: Box) -> Column:
    return 1 - giou(track, detection)


def appearance_cost(track: Column, detection: Column) -> Column:
    """Cosine distance of unit vectors, clipped to [0, 2]."""
    return F.least(F.greatest(1 - dot(track, detection), F.lit(0.0)), F.lit(2.0))


def direction_cost(heading: tuple[Column, Column], origin: Box, detection: Box) -> Column:
    """Angle between a heading and the way to a detection, as a share of pi; 0 where either is unknown."""
    ox, oy = origin.centre()
    dx, dy = detection.centre()
    way = F.sqrt((dx - ox) ** 2 + (dy - oy) ** 2)
    cosine = ((dx - ox) * heading[0] + (dy - oy) * heading[1]) / F.greatest(way, F.lit(1e-6))
    angle = F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))) / F.pi()
    unknown = (F.sqrt(heading[0] ** 2 + heading[1] ** 2) < 1e-6) | (way < 1e-6)
    return F.when(unknown, F.lit(0.0)).otherwise(angle)


def fuse_score(cost: Column, score: Column) -> Column:
    return 1 - (1 - cost) * score


def gate(cost: Column, distance: Column | None, threshold: float = CHI2_95, weight: float = 0.0) -> Column:
    """FORBIDDEN where the distance is above the threshold; else the cost, blended with the distance by weight."""
    if distance is None:
        return cost
    return F.when(distance > threshold, F.lit(FORBIDDEN)).otherwise((1 - weight) * cost + weight * distance if weight else cost)


def min_fuse(motion: Column, appearance: Column, *, motion_gate: float, appearance_gate: float, appearance_weight: float = 0.5) -> Column:
    """The lower of motion and weighed appearance, each 1 outside its gate; appearance needs both gates."""
    by_motion = F.when(motion <= motion_gate, motion).otherwise(1.0)
    by_looks = F.when((appearance <= appearance_gate) & (motion <= motion_gate), appearance_weight * appearance).otherwise(1.0)
    return F.least(by_motion, by_looks)


def fused_geometry(geometry: Column, appearance: Column, *, weight: float, appearance_gate: float, geometry_gate: float) -> Column:
    """Appearance and geometry weighed together; FORBIDDEN outside either gate, geometry alone without appearance."""
    fused = F.when((geometry > geometry_gate) | (appearance > appearance_gate), F.lit(FORBIDDEN)).otherwise(weight * appearance + (1 - weight) * geometry)
    return F.when(appearance.isNull(), geometry).otherwise(fused)


def vetoed(cost: Column, appearance: Column, appearance_gate: float) -> Column:
    """FORBIDDEN where the appearance is known and outside its gate."""
    return F.when(appearance > appearance_gate, F.lit(FORBIDDEN)).otherwise(cost)


def ramp(value: Column, low: float, high: float) -> Column:
    return (F.least(F.greatest(value, F.lit(low)), F.lit(high)) - low) / (high - low)


def appearance_momentum(score: Column, isolation: Column, *, least: float = 0.9, most: float = 0.95, scores: tuple[float, float] = (0.5, 0.8), isolations: tuple[float, float] = (0.5, 0.8)) -> Column:
    """How much of a track's appearance is kept: more for unsure or crowded detections."""
    span = 1 - least
    by_score = least + span * (1 - ramp(score, *scores))
    by_space = least + span * (1 - ramp(isolation, *isolations))
    return F.least(F.greatest(by_score, by_space), F.lit(most))


def score_tier(score: Column, low: float, track: float) -> Column:
    """'high', 'low', or null for what is dropped."""
    return F.when(score >= track, "high").when(score >= low, "low")
