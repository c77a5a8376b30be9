"""numpy forms of the box and cost functions, for the operators that keep state."""

from __future__ import annotations

import numpy as np

from .costs import CHI2_95, FORBIDDEN


def corners(state: np.ndarray) -> np.ndarray:
    """(centre x, centre y, aspect, height) rows as corner rows."""
    half = np.stack([state[:, 2] * state[:, 3], state[:, 3]], axis=1) / 2
    return np.concatenate([state[:, :2] - half, state[:, :2] + half], axis=1)


def centres(boxes: np.ndarray) -> np.ndarray:
    """Corner rows as (centre x, centre y, aspect, height) rows."""
    size = boxes[:, 2:] - boxes[:, :2]
    return np.column_stack([(boxes[:, :2] + boxes[:, 2:]) / 2, size[:, 0] / np.maximum(size[:, 1], 1e-6), size[:, 1]])


def _shared(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.minimum(a[:, None, 2:], b[None, :, 2:]) - np.maximum(a[:, None, :2], b[None, :, :2])
    overlap = np.clip(size, 0, None).prod(axis=2)
    area = [np.clip(x[:, 2:] - x[:, :2], 0, None).prod(axis=1) for x in (a, b)]
    return overlap, area[0][:, None] + area[1][None, :] - overlap


def iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    overlap, union = _shared(a, b)
    return overlap / np.maximum(union, 1e-9)


def giou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    overlap, union = _shared(a, b)
    hull = (np.maximum(a[:, None, 2:], b[None, :, 2:]) - np.minimum(a[:, None, :2], b[None, :, :2])).clip(0, None).prod(axis=2)
    return overlap / np.maximum(union, 1e-9) - (hull - union) / np.maximum(hull, 1e-9)


def gate(cost: np.ndarray, distance: np.ndarray | None) -> np.ndarray:
    return cost if distance is None else np.where(distance > CHI2_95, FORBIDDEN, cost)


def direction(headings: np.ndarray, origins: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """Angles between headings and the ways to boxes as shares of pi; 0 where unknown."""
    way = ((boxes[:, :2] + boxes[:, 2:]) / 2)[None] - ((origins[:, :2] + origins[:, 2:]) / 2)[:, None]
    length = np.linalg.norm(way, axis=2)
    cosine = (way * headings[:, None]).sum(axis=2) / np.maximum(length, 1e-6)
    out = np.arccos(np.clip(cosine, -1, 1)) / np.pi
    out[np.linalg.norm(headings, axis=1) < 1e-6] = 0
    out[length < 1e-6] = 0
    return out


#: Boxes on one side of a tile of overlaps.
TILE = 256


def worst_overlap(boxes: np.ndarray) -> np.ndarray:
    """The highest IoU of each box with another, 0 for a lone one; each pair is made once, in tiles that stay in the cache."""
    x1, y1, x2, y2 = np.ascontiguousarray(boxes.T)
    area = np.maximum(x2 - x1, 0) * np.maximum(y2 - y1, 0)
    out = np.zeros(len(boxes))
    for a in range(0, len(boxes), TILE):
        row = np.s_[a : a + TILE, None]
        for b in range(a, len(boxes), TILE):
            column = np.s_[None, b : b + TILE]
            shared = np.minimum(x2[row], x2[column])
            shared -= np.maximum(x1[row], x1[column])
            np.maximum(shared, 0, out=shared)
            height = np.minimum(y2[row], y2[column])
            height -= np.maximum(y1[row], y1[column])
            np.maximum(height, 0, out=height)
            shared *= height
            union = np.add(area[row], area[column], out=height)
            union -= shared
            np.maximum(union, 1e-9, out=union)
            shared /= union
            if a == b:
                np.fill_diagonal(shared, 0)
            else:
                out[b : b + TILE] = np.maximum(out[b : b + TILE], shared.max(axis=0))
            out[a : a + TILE] = np.maximum(out[a : a + TILE], shared.max(axis=1))
    return out


def iou_block(a: np.ndarray, b: np.ndarray, absent: np.ndarray | None = None, absent_b: np.ndarray | None = None) -> np.ndarray:
    """iou with few temporaries, and as SQL has it where corners are absent (null, here NaN): least and greatest pass over them."""
    low, high = (np.minimum, np.maximum) if absent is None and absent_b is None else (np.fmin, np.fmax)
    (ax1, ay1, ax2, ay2), (bx1, by1, bx2, by2) = np.ascontiguousarray(a.T)[:, :, None], np.ascontiguousarray(b.T)
    shared = low(ax2, bx2)
    shared -= high(ax1, bx1)
    high(shared, 0, out=shared)
    height = low(ay2, by2)
    height -= high(ay1, by1)
    high(height, 0, out=height)
    shared *= height
    union = np.add(high(ax2 - ax1, 0) * high(ay2 - ay1, 0), high(bx2 - bx1, 0) * high(by2 - by1, 0), out=height)
    union -= shared
    high(union, 1e-9, out=union)
    shared /= union
    if low is np.fmin:
        # a NaN that is not an absent corner is passed on
        for side, none, out in ((a, absent, shared), (b, absent_b, shared.T)):
            out[(np.isnan(side) if none is None else np.isnan(side) & ~none).any(axis=1)] = np.nan
    return shared


def distinct_boxes(boxes: np.ndarray, absent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of each box among the boxes of different corners, a row of each of these, and how often it occurs."""
    # few boxes, or some without a corner, stay as they are
    if len(boxes) < 128 or absent is not None:
        return np.arange(len(boxes)), np.arange(len(boxes)), np.ones(len(boxes))
    order = np.lexsort(boxes.T)
    first = np.append(True, (np.diff(boxes[order], axis=0) != 0).any(axis=1))
    number = np.empty(len(boxes), dtype=np.int64)
    number[order] = np.cumsum(first) - 1
    return number, order[first], np.bincount(number).astype(np.float64)


def isolation(boxes: np.ndarray) -> np.ndarray:
    """1 less the highest IoU with another box; a lone box has 1."""
    if len(boxes) < 2:
        return np.ones(len(boxes))
    other = iou(boxes, boxes)
    np.fill_diagonal(other, 0)
    return np.clip(1 - other.max(axis=1), 0, 1)


def momentum(boxes: np.ndarray, scores: np.ndarray, least: float, most: float) -> np.ndarray:
    """How much appearance to keep, by score and isolation between 0.5 and 0.8."""
    ramp = lambda v: (np.clip(v, 0.5, 0.8) - 0.5) / 0.3
    keep = np.maximum(1 - ramp(scores), 1 - ramp(isolation(boxes)))
    return np.minimum(least + (1 - least) * keep, most)
