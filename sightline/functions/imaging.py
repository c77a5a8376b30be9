"""Pixel work in numpy: half-pixel bilinear resizing, letterboxes, crops and NV12, and their UDF forms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import require

PAD = 114
# BT.601 limited range, from (Y - 16, U - 128, V - 128) to RGB.
YUV_TO_RGB = np.array([[1.164383, 0.0, 1.596027], [1.164383, -0.391762, -0.812968], [1.164383, 2.017232, 0.0]])
# From RGB to (Y - 16, U - 128, V - 128).
RGB_TO_YUV = np.array([[0.256788, 0.504129, 0.097906], [-0.148223, -0.290993, 0.439216], [0.439216, -0.367788, -0.071427]])


def checked_image(image: np.ndarray) -> np.ndarray:
    require(image.dtype == np.uint8 and image.ndim == 3 and image.shape[2] == 3 and min(image.shape) > 0, f"an image is uint8 (h, w, 3), got {image.dtype} {image.shape}")
    return image


def checked_boxes(boxes: np.ndarray) -> np.ndarray:
    boxes = np.asarray(boxes, dtype=np.float32)
    require(boxes.ndim == 2 and boxes.shape[1] == 4 and bool(np.isfinite(boxes).all()), "boxes are finite rows of four")
    return boxes


def normalisation(mean=None, std=None) -> tuple[np.ndarray, np.ndarray]:
    """Channel means and deviations; 0 and 255 by default."""
    m, s = (np.asarray(d if v is None else v, dtype=np.float32).reshape(-1, 1, 1) for v, d in ((mean, [0.0] * 3), (std, [255.0] * 3)))
    require(bool(np.isfinite(m).all() and np.isfinite(s).all() and (s > 0).all()), "mean and std must be finite, std above 0")
    return m, s


def sampled(source: np.ndarray, ys: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """Bilinear values of a plane or image at the grid of rows ys and columns xs, its border held."""
    source = source.astype(np.float32)

    def along(values: np.ndarray, extent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip(values, 0, extent - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, extent - 1), (at - low).astype(np.float32)

    y0, y1, fy = along(ys, source.shape[0])
    x0, x1, fx = along(xs, source.shape[1])
    fy, fx = fy.reshape(-1, *[1] * (source.ndim - 1)), fx.reshape(1, -1, *[1] * (source.ndim - 2))
    rows = source[y0] * (1 - fy) + source[y1] * fy
    return rows[:, x0] * (1 - fx) + rows[:, x1] * fx


def centres(source: int, resized: int) -> np.ndarray:
    return (np.arange(resized) + 0.5) * (source / resized) - 0.5


def resized(plane: np.ndarray, height: int, width: int) -> np.ndarray:
    return sampled(plane, centres(plane.shape[0], height), centres(plane.shape[1], width))


def plan(height: int, width: int, target: tuple[int, int]) -> tuple[float, int, int, int, int]:
    """(scale, resized height, resized width, bar above, bar left) of a letterbox, in single precision."""
    scale = np.float32(min(np.float32(target[0]) / np.float32(height), np.float32(target[1]) / np.float32(width)))
    rh, rw = (int(min(max(np.floor(np.float32(v) * scale + np.float32(0.5)), 1), t)) for v, t in ((height, target[0]), (width, target[1])))
    return float(scale), rh, rw, (target[0] - rh) // 2, (target[1] - rw) // 2


def letterbox(image: np.ndarray, target: tuple[int, int], *, pad: int = PAD, mean=None, std=None, swap: bool = True) -> np.ndarray:
    """A (3, h, w) float image resized into target with bars, BGR turned to RGB if swap, normalised."""
    require(isinstance(pad, int) and 0 <= pad <= 255, f"pad must be a whole number in 0..255, got {pad}")
    image = checked_image(image)
    _, rh, rw, top, left = plan(*image.shape[:2], target)
    out = np.full((*target, 3), float(pad), dtype=np.float32)
    out[top : top + rh, left : left + rw] = resized(image, rh, rw)
    return _finished(out, mean, std, swap)


def _finished(image: np.ndarray, mean, std, swap: bool) -> np.ndarray:
    m, s = normalisation(mean, std)
    return ((image[..., ::-1] if swap else image).transpose(2, 0, 1) - m) / s


def crops(image: np.ndarray, boxes: np.ndarray, target: tuple[int, int], *, mean=None, std=None, swap: bool = True) -> np.ndarray:
    """(n, 3, h, w) crops of boxes clamped to the image; a box without area gives what zero pixels give."""
    image, boxes = checked_image(image), checked_boxes(boxes)
    h, w = image.shape[:2]
    out = np.zeros((len(boxes), 3, *target), dtype=np.float32)
    for k, (x1, y1, x2, y2) in enumerate(np.clip(boxes, 0, np.array([w - 1, h - 1, w - 1, h - 1], dtype=np.float32))):
        if x2 > x1 and y2 > y1:
            ys = np.clip(y1 + (np.arange(target[0]) + 0.5) * (y2 - y1) / target[0] - 0.5, y1, y2)
            xs = np.clip(x1 + (np.arange(target[1]) + 0.5) * (x2 - x1) / target[1] - 0.5, x1, x2)
            patch = sampled(image, ys, xs)
        else:
            patch = np.zeros((*target, 3), dtype=np.float32)
        out[k] = _finished(patch, mean, std, swap)
    return out


def nv12_rows(height: int) -> int:
    require(height > 0 and height % 2 == 0, f"NV12 needs an even height, got {height}")
    return height * 3 // 2


def nv12_height(rows: int) -> int:
    require(rows > 0 and rows % 3 == 0, f"NV12 rows come in threes, got {rows}")
    return rows * 2 // 3


def nv12_planes(frame: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Luma (h, w) and chroma (h/2, w/2, 2) of a packed frame, cut to its visible width."""
    require(frame.dtype == np.uint8 and frame.ndim == 2 and 0 < width <= frame.shape[1] and width % 2 == 0, "an NV12 frame is uint8 (rows, stride) with an even visible width inside the stride")
    h = nv12_height(frame.shape[0])
    return frame[:h, :width], frame[h:, :width].reshape(h // 2, width // 2, 2)


def nv12_to_rgb(frame: np.ndarray, width: int) -> np.ndarray:
    """RGB in 0..255 as floats; chroma is repeated over its 2x2 pixels."""
    luma, chroma = nv12_planes(frame, width)
    wide = chroma.repeat(2, axis=0).repeat(2, axis=1).astype(np.float32) - 128
    yuv = np.dstack([luma.astype(np.float32) - 16, wide])
    return np.clip(yuv @ YUV_TO_RGB.T.astype(np.float32), 0, 255)


def bgr_to_nv12(image: np.ndarray, stride: int | None = None) -> np.ndarray:
    """A packed NV12 frame; chroma is the mean of its 2x2 pixels."""
    image = checked_image(image)
    h, w = image.shape[:2]
    require(h % 2 == 0 and w % 2 == 0, "NV12 needs even extents")
    stride = stride or w
    require(stride >= w, f"stride {stride} is below the width {w}")
    yuv = image[..., ::-1].astype(np.float32) @ RGB_TO_YUV.T.astype(np.float32)
    out = np.zeros((nv12_rows(h), stride), dtype=np.uint8)
    out[:h, :w] = np.clip(np.rint(yuv[..., 0] + 16), 0, 255)
    mean = yuv[..., 1:].reshape(h // 2, 2, w // 2, 2, 2).mean(axis=(1, 3)) + 128
    out[h:, :w] = np.clip(np.rint(mean), 0, 255).reshape(h // 2, w)
    return out


def nv12_letterbox(frame: np.ndarray, width: int, target: tuple[int, int], *, pad: int = PAD, mean=None, std=None, swap: bool = True) -> np.ndarray:
    """letterbox of an NV12 frame."""
    rgb = nv12_to_rgb(frame, width)
    _, rh, rw, top, left = plan(*rgb.shape[:2], target)
    out = np.full((*target, 3), float(pad), dtype=np.float32)
    out[top : top + rh, left : left + rw] = resized(rgb, rh, rw)
    return _finished(out if swap else out[..., ::-1], mean, std, False)


def mask_logits(coefficients: np.ndarray, prototypes: np.ndarray) -> np.ndarray:
    """(k, c) coefficients by (c, h, w) prototypes as (k, h, w) logits."""
    require(coefficients.shape[1] == prototypes.shape[0], f"{coefficients.shape[1]} coefficients for {prototypes.shape[0]} prototypes")
    return np.tensordot(coefficients, prototypes, axes=1)


def unpadded_mask(logits: np.ndarray, source: tuple[int, int], target: tuple[int, int]) -> np.ndarray:
    """A mask in source pixels: sigmoid, resized to the canvas, bars cut off, resized to the source."""
    canvas = resized(1 / (1 + np.exp(-np.clip(logits, -60, 60))), *target)
    _, rh, rw, top, left = plan(*source, target)
    return resized(canvas[top : top + rh, left : left + rw], *source)


def letterbox_column(content: Column, height: Column, width: Column, target: tuple[int, int], **options) -> Column:
    """Raw BGR bytes as a letterboxed float array, in Arrow batches."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for data, h, w in batches:
            yield pd.Series([letterbox(np.frombuffer(d, dtype=np.uint8).reshape(int(a), int(b), 3), target, **options).ravel() for d, a, b in zip(data, h, w)])

    return run(content, height, width)


def embedding_column(content: Column, height: Column, width: Column, *, dim: int = 512, grid: int = 8, bandwidth: float = 0.15, seed: int = 0) -> Column:
    """A stand-in for a learned extractor: random Fourier features of block means, of unit length."""
    rng = np.random.default_rng(seed)
    weights = rng.normal(scale=1 / bandwidth, size=(grid * grid * 3, dim)) / grid
    phase = rng.uniform(0, 2 * np.pi, dim)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for data, h, w in batches:
            out = []
            for d, a, b in zip(data, h, w):
                image = checked_image(np.frombuffer(d, dtype=np.uint8).reshape(int(a), int(b), 3))
                v = np.cos(resized(image, grid, grid).ravel() / 255 @ weights + phase)
                out.append((v / max(np.linalg.norm(v), 1e-12)).astype(np.float32))
            yield pd.Series(out)

    return run(content, height, width)


def fixed_batches(images: Iterator[np.ndarray], size: int, limit: int | None = None) -> Iterator[np.ndarray]:
    """Batches of exactly `size` images, as calibration wants them; the last one is filled by repeating its own."""
    require(size >= 1, f"size must be 1 or more, got {size}")
    held: list[np.ndarray] = []
    given = 0
    for image in images:
        held.append(image)
        if len(held) == size:
            yield np.stack(held)
            held, given = [], given + 1
            if limit is not None and given >= limit:
                return
    if held:
        yield np.stack([held[k % len(held)] for k in range(size)])
