"""One-to-one assignment of rows to columns at least total cost, in numpy."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

Solved = tuple[list[tuple[int, int]], list[int], list[int]]


def least_cost(cost: np.ndarray) -> np.ndarray:
    """The column of each row (-1: none) in an assignment of min(rows, columns) pairs of least sum.

    Rows enter one by one; each finds its cheapest alternating path under the
    dual prices, all columns relaxed at once. Among equal paths the lowest column
    is taken, so earlier rows and lower columns win ties.
    """
    cost = np.ascontiguousarray(cost, dtype=np.float64)
    n, m = cost.shape
    if n > m:
        of_row = np.full(n, -1)
        by_column = least_cost(cost.T)
        of_row[by_column] = np.arange(m)
        return of_row
    price_row, price_col = np.zeros(n), np.zeros(m)
    holder = np.full(m, -1)
    offer, better = np.empty(m), np.empty(m, dtype=bool)
    for start in range(n):
        distance = np.full(m, np.inf)
        # the distances of columns that are not done, and what an offer must beat
        left, beaten = distance.copy(), distance.copy()
        came = np.full(m, -1)
        done = np.zeros(m, dtype=bool)
        row, column, reached = start, -1, 0.0
        while True:
            np.add(cost[row], reached, out=offer)
            offer -= price_row[row]
            offer -= price_col
            np.less(offer, beaten, out=better)
            for kept in (left, beaten):
                np.copyto(kept, offer, where=better)
            np.copyto(came, column, where=better)
            column = int(left.argmin())
            reached = distance[column] = left[column]
            done[column] = True
            left[column], beaten[column] = np.inf, -np.inf
            if holder[column] < 0:
                break
            row = holder[column]
        seen = np.flatnonzero(done)
        slack = reached - distance[seen]
        price_col[seen] -= slack
        price_row[start] += reached
        held = holder[seen] >= 0
        price_row[holder[seen[held]]] += slack[held]
        while column >= 0:
            before = came[column]
            holder[column] = holder[before] if before >= 0 else start
            column = before
    out = np.full(n, -1)
    taken = np.flatnonzero(holder >= 0)
    out[holder[taken]] = taken
    return out


def associate(cost: np.ndarray, most: float) -> Solved:
    """Pairs of the best assignment that cost `most` or less, and the rows and columns left over.

    Dear pairs go after the solution, not before: they still shape the optimum.
    """
    n, m = cost.shape
    of_row = least_cost(cost) if n and m else np.full(n, -1)
    pairs = [(r, int(c)) for r, c in enumerate(of_row) if c >= 0 and cost[r, c] <= most]
    rows, columns = {r for r, _ in pairs}, {c for _, c in pairs}
    return pairs, [r for r in range(n) if r not in rows], [c for c in range(m) if c not in columns]


Build = Callable[[list[int], list[int]], np.ndarray]


def associate_subset(build: Build, most: float, rows: Sequence[int], columns: Sequence[int], solve: Callable[[np.ndarray, float], Solved] = associate) -> Solved:
    """associate over some rows and columns, told in their own numbers."""
    rows, columns = list(rows), list(columns)
    if not rows or not columns:
        return [], rows, columns
    pairs, left, right = solve(build(rows, columns), most)
    return [(rows[r], columns[c]) for r, c in pairs], [rows[r] for r in left], [columns[c] for c in right]


def cascade(build: Build, most: float, rows: Sequence[int], columns: Sequence[int], ages: np.ndarray, stride: int, depth: int) -> Solved:
    """Bands of `stride` ages, the youngest first, each taking columns from what is left."""
    pairs: list[tuple[int, int]] = []
    left = list(columns)
    for low in range(0, max(depth, 1), stride):
        band = [r for r in rows if low <= ages[r] < low + stride]
        if band and left:
            found, _, left = associate_subset(build, most, band, left)
            pairs += found
    matched = {r for r, _ in pairs}
    return pairs, [r for r in rows if r not in matched], left


def clear_pairs(cost: np.ndarray, most: float) -> list[tuple[int, int]]:
    """Pairs that are the only affordable one of both their row and their column."""
    fits = np.asarray(cost) <= most
    alone = fits & (fits.sum(axis=1, keepdims=True) == 1) & (fits.sum(axis=0, keepdims=True) == 1)
    return [(int(r), int(c)) for r, c in zip(*np.nonzero(alone))]


def ambiguous(cost: np.ndarray, most: float) -> np.ndarray:
    """Affordable pairs with a rival in their row or column."""
    fits = np.asarray(cost) <= most
    return fits & ((fits.sum(axis=1, keepdims=True) > 1) | (fits.sum(axis=0, keepdims=True) > 1))


def isolated(iou_cost: np.ndarray, most: float) -> np.ndarray:
    """Pairs that overlap nothing else, and are too dear all the same."""
    meets = np.asarray(iou_cost) < 1
    return meets & (np.asarray(iou_cost) > most) & (meets.sum(axis=1, keepdims=True) == 1) & (meets.sum(axis=0, keepdims=True) == 1)


def associate_locked(cost: np.ndarray, most: float) -> Solved:
    """Clear pairs first, then the best assignment of the rest."""
    locked = clear_pairs(cost, most)
    if not locked:
        return associate(cost, most)
    rows = sorted(set(range(cost.shape[0])) - {r for r, _ in locked})
    columns = sorted(set(range(cost.shape[1])) - {c for _, c in locked})
    pairs, left, right = associate_subset(lambda r, c: cost[np.ix_(r, c)], most, rows, columns)
    if not rows or not columns:
        left, right = rows, columns
    return sorted(locked + pairs), left, right


def best_score(score: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs of the assignment of the highest total score, those above `least`."""
    if not score.size:
        return []
    return [(r, int(c)) for r, c in enumerate(least_cost(-score)) if c >= 0 and score[r, c] > least]
