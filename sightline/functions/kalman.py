"""The constant-velocity filter of boxes (centre, aspect, height), for many tracks at once."""

from __future__ import annotations

import numpy as np

#: Standard deviations as shares of a box's height.
POSITION, VELOCITY = 1 / 20, 1 / 160
STEP = np.eye(8) + np.eye(8, k=4)


def _noise(height: np.ndarray, position: float, aspect: float, velocity: float | None = None, aspect_velocity: float = 0.0) -> np.ndarray:
    """Diagonal covariances (n, d, d), scaled by height but for the aspect."""
    p = position * height
    parts = [p, p, np.full_like(p, aspect), p]
    if velocity is not None:
        v = velocity * height
        parts += [v, v, np.full_like(v, aspect_velocity), v]
    std = np.stack(parts, axis=1)
    return np.einsum("ni,ij->nij", std**2, np.eye(std.shape[1]))


def initiate(measured: np.ndarray, position: float = POSITION, velocity: float = VELOCITY) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([measured, np.zeros_like(measured)], axis=1), _noise(measured[:, 3], 2 * position, 1e-2, 10 * velocity, 1e-5)


def predict(mean: np.ndarray, cov: np.ndarray, position: float = POSITION, velocity: float = VELOCITY) -> tuple[np.ndarray, np.ndarray]:
    grown = _noise(mean[:, 3], position, 1e-2, velocity, 1e-5)
    return mean @ STEP.T, STEP @ cov @ STEP.T + grown


def project(mean: np.ndarray, cov: np.ndarray, position: float = POSITION) -> tuple[np.ndarray, np.ndarray]:
    return mean[:, :4], cov[:, :4, :4] + _noise(mean[:, 3], position, 1e-1)


def update(mean: np.ndarray, cov: np.ndarray, measured: np.ndarray, position: float = POSITION) -> tuple[np.ndarray, np.ndarray]:
    seen, spread = project(mean, cov, position)
    gain = np.linalg.solve(spread, cov[:, :4, :]).transpose(0, 2, 1)
    return mean + np.einsum("nij,nj->ni", gain, measured - seen), cov - gain @ spread @ gain.transpose(0, 2, 1)


def distance(mean: np.ndarray, cov: np.ndarray, measured: np.ndarray) -> np.ndarray:
    """Squared Mahalanobis distances, tracks by measurements."""
    seen, spread = project(mean, cov)
    delta = measured[None, :, :] - seen[:, None, :]
    return np.einsum("nmi,nij,nmj->nm", delta, np.linalg.inv(spread), delta)


def warp(mean: np.ndarray, cov: np.ndarray, affine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States seen by a camera that moved by a 2x3 affine; heights scale by the root of its determinant."""
    block = np.eye(4)
    block[:2, :2] = affine[:, :2]
    block[3, 3] = np.sqrt(abs(np.linalg.det(affine[:, :2])))
    whole = np.kron(np.eye(2), block)
    mean = mean @ whole.T
    mean[:, :2] += affine[:, 2]
    return mean, whole @ cov @ whole.T
