"""Box geometry as Column expressions, all in double precision."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-9


class Box(NamedTuple):
    """Four corner columns: left, top, right, bottom in pixels."""

    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*[F.col(f"{prefix}{c}").cast("double") for c in ("x1", "y1", "x2", "y2")])

    def width(self) -> Column:
        return self.x2 - self.x1

    def height(self) -> Column:
        return self.y2 - self.y1

    def area(self) -> Column:
        return F.greatest(F.lit(0.0), self.width()) * F.greatest(F.lit(0.0), self.height())

    def centre(self) -> tuple[Column, Column]:
        return (self.x1 + self.x2) / 2, (self.y1 + self.y2) / 2


def to_cxcyah(b: Box) -> tuple[Column, Column, Column, Column]:
    """Centre, aspect (width over height, the height at least 1e-6) and height."""
    return (*b.centre(), b.width() / F.greatest(b.height(), F.lit(1e-6)), b.height())


def from_cxcyah(cx: Column, cy: Column, aspect: Column, height: Column) -> Box:
    half = aspect * height / 2
    return Box(cx - half, cy - height / 2, cx + half, cy + height / 2)


def to_cxcywh(b: Box) -> tuple[Column, Column, Column, Column]:
    return (*b.centre(), b.width(), b.height())


def from_cxcywh(cx: Column, cy: Column, width: Column, height: Column) -> Box:
    return Box(cx - width / 2, cy - height / 2, cx + width / 2, cy + height / 2)


def overlap(a: Box, b: Box) -> Column:
    width = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    height = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    return F.greatest(F.lit(0.0), width) * F.greatest(F.lit(0.0), height)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union, the union at least 1e-9."""
    shared = overlap(a, b)
    return shared / F.greatest(a.area() + b.area() - shared, F.lit(EPSILON))


def giou(a: Box, b: Box) -> Column:
    """IoU less the share of the hull that neither box covers; in [-1, 1]."""
    shared = overlap(a, b)
    union = a.area() + b.area() - shared
    hull = Box(F.least(a.x1, b.x1), F.least(a.y1, b.y1), F.greatest(a.x2, b.x2), F.greatest(a.y2, b.y2)).area()
    return shared / F.greatest(union, F.lit(EPSILON)) - (hull - union) / F.greatest(hull, F.lit(EPSILON))


def widened(b: Box) -> Box:
    """Inside-out boxes become empty ones at their first corner."""
    return Box(b.x1, b.y1, F.greatest(b.x1, b.x2), F.greatest(b.y1, b.y2))


def clamped(b: Box, height: Column, width: Column) -> Box:
    """Corners inside [0, extent - 1]."""
    inside = lambda v, extent: F.least(F.greatest(v, F.lit(0.0)), extent.cast("double") - 1)
    return Box(inside(b.x1, width), inside(b.y1, height), inside(b.x2, width), inside(b.y2, height))


def crop_bounds(b: Box, height: Column, width: Column, tolerance: float = 1e-3) -> tuple[Column, Column, Column, Column]:
    """Whole pixels that cover a box, at least one, with edges a tolerance off a pixel not counted: (left, top, right, bottom)."""

    def span(low: Column, high: Column, extent: Column) -> tuple[Column, Column]:
        first = F.least(F.greatest(F.floor(low + tolerance), F.lit(0)), extent - 1)
        return first, F.least(F.greatest(F.ceil(high - tolerance), first + 1), extent)

    (left, right), (top, bottom) = span(b.x1, b.x2, width), span(b.y1, b.y2, height)
    return left, top, right, bottom


def off_border(b: Box, height: Column, width: Column, fraction: float) -> Column:
    """Whether a box keeps a margin of fraction of the shorter side from all edges; true where the frame's size is unknown."""
    margin = F.least(height, width) * fraction
    inside = (b.x1 >= margin) & (b.y1 >= margin) & (width - b.x2 >= margin) & (height - b.y2 >= margin)
    return F.when((F.coalesce(height, F.lit(0)) <= 0) | (F.coalesce(width, F.lit(0)) <= 0), F.lit(True)).otherwise(inside)


def foot_point(b: Box, frame_height: Column, foot_ratio: float = 1.0, aspect_ratio: float = 0.25) -> tuple[Column, Column]:
    """Where an object touches the ground: below the centre at foot_ratio of the height; if the frame's bottom cuts the box, of the height its width implies."""
    full = F.greatest(b.height(), b.width() / aspect_ratio)
    drop = F.when(b.y2 >= frame_height - 1, full).otherwise(b.height() * foot_ratio)
    return (b.x1 + b.x2) / 2, b.y1 + drop


def project(x: Column, y: Column, matrix: Column) -> tuple[Column, Column]:
    """A point through a 3x3 map given as an array of nine, rows first; the divisor stays 1e-12 away from 0."""
    m = [matrix[k] for k in range(9)]
    w = m[6] * x + m[7] * y + m[8]
    w = F.when(F.abs(w) < 1e-12, F.lit(1e-12)).otherwise(w)
    return (m[0] * x + m[1] * y + m[2]) / w, (m[3] * x + m[4] * y + m[5]) / w


def to_calibration(x: Column, y: Column, frame: tuple[Column, Column], calibration: tuple[Column, Column]) -> tuple[Column, Column]:
    """Live pixels scaled to the (width, height) of the calibration; unchanged where a size is 0."""
    scaled = lambda v, live, cal: F.when((live > 0) & (cal > 0), v * cal / live).otherwise(v)
    return scaled(x, frame[0], calibration[0]), scaled(y, frame[1], calibration[1])


class Letterbox(NamedTuple):
    """A resize into a target with bars: scale, resized extents, bars before and after; whole numbers but the scale."""

    scale: Column
    resized_height: Column
    resized_width: Column
    top: Column
    left: Column
    bottom: Column
    right: Column
    source_height: Column
    source_width: Column

    @classmethod
    def plan(cls, source_height: Column, source_width: Column, target_height: int, target_width: int) -> Letterbox:
        """The largest scale that fits, in single precision; sizes round half up, an odd bar pixel goes below or right."""
        h, w = source_height.cast("float"), source_width.cast("float")
        scale = F.least(F.lit(float(target_height)).cast("float") / h, F.lit(float(target_width)).cast("float") / w).cast("float")
        size = lambda v, most: F.least(F.greatest(F.floor((v * scale).cast("float") + F.lit(0.5).cast("float")), F.lit(1)), F.lit(most)).cast("int")
        rh, rw = size(h, target_height), size(w, target_width)
        top, left = F.floor((F.lit(target_height) - rh) / 2).cast("int"), F.floor((F.lit(target_width) - rw) / 2).cast("int")
        return cls(scale, rh, rw, top, left, F.lit(target_height) - rh - top, F.lit(target_width) - rw - left, source_height, source_width)

    def invert(self, b: Box) -> Box:
        """A box of the target in source pixels, clipped to the source."""
        back = lambda v, bar, extent: F.least(F.greatest((v - bar) / self.scale.cast("double"), F.lit(0.0)), extent.cast("double"))
        return Box(back(b.x1, self.left, self.source_width), back(b.y1, self.top, self.source_height), back(b.x2, self.left, self.source_width), back(b.y2, self.top, self.source_height))

    def invert_points(self, points: Column) -> Column:
        """An array of [x, y, ...] points in source pixels, clipped; further entries of a point stay."""
        back = lambda v, bar, extent: F.least(F.greatest((v - bar) / self.scale.cast("double"), F.lit(0.0)), extent.cast("double"))
        return F.transform(points, lambda p: F.concat(F.array(back(p[0], self.left, self.source_width), back(p[1], self.top, self.source_height)), F.slice(p, 3, F.greatest(F.size(p) - 2, F.lit(0)))))


def resize_centres(source: int, resized: int) -> Column:
    """Source positions of the centres of a resized axis."""
    return F.transform(F.sequence(F.lit(0), F.lit(resized - 1)), lambda i: (i + 0.5) * (source / resized) - 0.5)


def crop_centres(low: Column, high: Column, target: int) -> Column:
    """Positions of target centres spread over [low, high], kept inside it."""
    return F.transform(F.sequence(F.lit(0), F.lit(target - 1)), lambda i: F.least(F.greatest(low + (i + 0.5) * (high - low) / target - 0.5, low), high))


def nchw_bytes(count: int, height: int, width: int) -> int:
    """Bytes of a batch of three-channel float images."""
    return count * 3 * height * width * 4


def rounded_class(value: Column) -> Column:
    """A class id given as a float, rounded half away from zero."""
    return (F.signum(value) * F.floor(F.abs(value) + 0.5)).cast("int")


def checked_score(value: Column, slack: float = 1e-3) -> Column:
    """A score clipped to [0, 1], or an error where it is NaN or above 1 by more than the slack."""
    bad = F.isnan(value) | (value > 1 + slack)
    return F.when(bad, F.raise_error(F.lit("detector scores must lie in [0, 1]"))).otherwise(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))
