"""What a user's own components must offer, and running aggregates and camera motions that need no model."""

from __future__ import annotations

import abc
from collections.abc import Sequence

import numpy as np

from .errors import ExecutionError, ParameterError, WidthError, require


def _unit(v: np.ndarray) -> np.ndarray:
    v = np.asarray(v, dtype=float).reshape(-1)
    require(bool(np.isfinite(v).all()), "a vector must be finite")
    return v / max(float(np.linalg.norm(v)), 1e-12)


class Extractor(abc.ABC):
    """Crops in, one unit vector each out."""

    @property
    @abc.abstractmethod
    def dim(self) -> int:
        """Width of the vectors."""

    @abc.abstractmethod
    def extract(self, crops: np.ndarray) -> np.ndarray:
        """(n, 3, h, w) float crops to (n, dim) vectors of unit length."""

    def extract_one(self, crop: np.ndarray) -> np.ndarray:
        return self.extract(np.asarray(crop)[None])[0]


class Aggregator(abc.ABC):
    """Several vectors of an identity as one."""

    @abc.abstractmethod
    def aggregate(self, vectors: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """One unit vector of all rows."""

    @abc.abstractmethod
    def update(self, current: np.ndarray | None, vector: np.ndarray, *, weight: float = 1.0) -> np.ndarray:
        """The vector after one more observation."""


def _weights(weights: np.ndarray | None, n: int) -> np.ndarray:
    w = np.ones(n) if weights is None else np.asarray(weights, dtype=float)
    require(len(w) == n and n > 0, f"{n} vectors need as many weights, one at least")
    require(bool((w >= 0).all()), "weights must not be negative")
    return w


class RunningMean(Aggregator):
    """The weighted mean of all observations so far; of weight 0 alone, the last one."""

    def __init__(self) -> None:
        self.total: np.ndarray | None = None
        self.weight = 0.0

    def aggregate(self, vectors: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        w = _weights(weights, len(vectors))
        require(bool((w > 0).any()), "one weight must be above 0")
        return _unit(w @ np.asarray(vectors, dtype=float))

    def update(self, current: np.ndarray | None, vector: np.ndarray, *, weight: float = 1.0) -> np.ndarray:
        require(weight >= 0, f"weight must not be negative, got {weight}")
        v = np.asarray(vector, dtype=float).reshape(-1)
        if current is None or self.total is None or self.total.shape != v.shape:
            self.total, self.weight = np.zeros_like(v), 0.0
        self.total, self.weight = self.total + weight * v, self.weight + weight
        return _unit(self.total if self.weight > 0 else v)


class MovingAverage(Aggregator):
    """v <- unit(e * v + (1 - e) * x) with e = 1 - (1 - alpha) * weight."""

    def __init__(self, alpha: float = 0.9) -> None:
        require(0 <= alpha <= 1, f"alpha must be in [0, 1], got {alpha}")
        self.alpha = alpha

    def aggregate(self, vectors: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        out = None
        for v, w in zip(vectors, _weights(weights, len(vectors))):
            out = self.update(out, v, weight=float(w))
        return out

    def update(self, current: np.ndarray | None, vector: np.ndarray, *, weight: float = 1.0) -> np.ndarray:
        require(0 <= weight <= 1, f"weight must lie in [0, 1], got {weight}")
        if current is None:
            return _unit(vector)
        keep = 1 - (1 - self.alpha) * weight
        return _unit(keep * np.asarray(current, dtype=float) + (1 - keep) * np.asarray(vector, dtype=float))


class CameraMotion(abc.ABC):
    """The camera's own motion from frame to frame as a 2x3 affine."""

    @abc.abstractmethod
    def estimate(self, image: np.ndarray | None) -> np.ndarray:
        """From the last frame's coordinates to this one's; the identity on the first. Without the pixels it needs, an error."""

    def reset(self) -> None:
        """Forget the last frame."""


IDENTITY = np.array([[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]])


class FixedCamera(CameraMotion):
    """A camera that does not move."""

    def estimate(self, image: np.ndarray | None) -> np.ndarray:
        return IDENTITY.copy()


class Telemetry(CameraMotion):
    """Affines that are pushed in, each used once; the identity where none waits."""

    def __init__(self) -> None:
        self.next: np.ndarray | None = None

    def push(self, affine: Sequence) -> None:
        affine = np.asarray(affine, dtype=float)
        require(affine.size == 6 and bool(np.isfinite(affine).all()), "an affine has six finite numbers")
        self.next = affine.reshape(2, 3)

    def estimate(self, image: np.ndarray | None) -> np.ndarray:
        given, self.next = self.next, None
        return IDENTITY.copy() if given is None else given

    def reset(self) -> None:
        self.next = None


class Detector(abc.ABC):
    """A model behind `operators.models.run_detector`: a batch of letterboxed images to rows of boxes."""

    @property
    @abc.abstractmethod
    def input_hw(self) -> tuple[int, int]:
        """Height and width that the model takes."""

    @abc.abstractmethod
    def execute(self, batch: np.ndarray) -> np.ndarray:
        """(n, 3, h, w) floats to (n, rows, 6 or more) numbers: corners, confidence, class, mask coefficients."""


def checked_hw(target: Sequence[int]) -> tuple[int, int]:
    """Two positive whole numbers, height first."""
    values = tuple(int(v) for v in target)
    require(len(values) == 2, f"a target is (height, width), got {target!r}")
    require(min(values) > 0, f"a target must be positive, got {values}")
    return values[0], values[1]


def checked_pad(value: int) -> int:
    """A whole fill level in 0..255."""
    whole = not isinstance(value, bool) and isinstance(value, (int, float, np.integer, np.floating)) and int(value) == value
    if not whole or not 0 <= int(value) <= 255:
        raise ParameterError(f"pad must be a whole number in 0..255, got {value!r}")
    return int(value)


def checked_rows(made: np.ndarray, n: int, width: int, what: str) -> np.ndarray:
    """A model's output for n inputs, or an error that says what does not fit."""
    made = np.asarray(made)
    if len(made) != n:
        raise ExecutionError(f"{what} gave {len(made)} results for {n} inputs")
    if made.ndim < 2 or made.shape[-1] < width:
        raise WidthError(f"{what} gave rows of {made.shape[-1] if made.ndim else 0} numbers, {width} are needed")
    return made
