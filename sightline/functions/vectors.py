"""Vector functions on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import not_finite


def dot(a: Column, b: Column, width: int | None = None) -> Column:
    """The sum of products; null if either vector is, or holds a null.

    With a width, the length that all vectors have, it is compiled without a loop
    over arrays, for joins of many pairs; vectors of another length are refused.
    """
    if width is not None:
        other = (F.array_size(a) != width) | (F.array_size(b) != width)
        total = sum((F.get(a, F.lit(k)).cast("double") * F.get(b, F.lit(k)).cast("double") for k in range(width)), F.lit(0.0))
        return F.when(other, F.raise_error(F.lit(f"vectors must have {width} places"))).otherwise(total)
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0).cast("double"), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def scaled(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") * by)


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))


def normalised(a: Column, floor: float = 1e-12) -> Column:
    """A vector of unit length; a zero vector stays zero, a NaN is refused."""
    bad = F.exists(a, lambda x: F.isnan(x.cast("double")))
    size = F.greatest(norm(a), F.lit(floor))
    return F.when(bad, F.raise_error(F.lit("cannot normalise a vector with NaN"))).otherwise(F.transform(a, lambda x: x.cast("double") / size))


def unit(a: Column, what: str = "vector") -> Column:
    """A vector of unit length; an empty, zero or non-finite one is refused."""
    bad = (F.size(a) == 0) | F.exists(a, lambda x: not_finite(x.cast("double"))) | (norm(a) == 0)
    return F.when(bad, F.raise_error(F.lit(f"{what} must be finite and not zero"))).otherwise(normalised(a))


def is_normalised(a: Column, tolerance: float = 1e-4) -> Column:
    """Whether the length is 1 within the tolerance; a zero vector counts."""
    n = norm(a)
    return (F.abs(n - 1) <= tolerance) | (n == 0)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b)


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), dot(a, a) + dot(b, b) - 2 * dot(a, b)))


def blended(current: Column, incoming: Column, momentum: float) -> Column:
    """A moving average of unit vectors; current where nothing comes in or the mean vanishes."""
    mean = added(scaled(current, F.lit(momentum)), scaled(incoming, F.lit(1 - momentum)))
    size = norm(mean)
    return F.when(incoming.isNull(), current).when(current.isNull(), incoming.cast("array<double>")).when(size > 1e-9, F.transform(mean, lambda x: x / size)).otherwise(current)
