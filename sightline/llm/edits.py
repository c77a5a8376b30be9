"""Edit distance under a bound: one pair by whole bit vectors, many pairs at once by bands of bit vectors."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: Pairs that are worth one run over bands, pairs in a run, and 64-bit words of the widest band.
FEW, MANY, MOST_WORDS = 40, 2048, 16
#: Steps after which pairs that are beyond their bound are put aside.
STRIDE = 32


def _trimmed(a: str, b: str) -> tuple[str, str]:
    """a and b without their common beginning and end."""
    n = min(len(a), len(b))
    k, step = 0, 64
    while k < n and a[k : k + step] == b[k : k + step]:
        k += step
    k = min(k, n)
    while k < n and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    n, k = min(len(a), len(b)), 0
    while k + step <= n and a[len(a) - k - step : len(a) - k] == b[len(b) - k - step : len(b) - k]:
        k += step
    while k < n and a[-1 - k] == b[-1 - k]:
        k += 1
    return (a[:-k], b[:-k]) if k else (a, b)


def _at_once(a: str, b: str, most: int) -> bool | None:
    """What lengths alone tell of trimmed texts; None if they do not."""
    if abs(len(a) - len(b)) > most:
        return False
    if max(len(a), len(b)) <= most:
        return True
    return False if not a or not b else None


def _by_columns(a: str, b: str, most: int) -> bool:
    """One pair: the band of _by_bands in one integer of as many bits as it has diagonals."""
    if len(a) > len(b):
        a, b = b, a
    apart = len(b) - len(a)
    beyond = (most - apart) // 2
    width = apart + 2 * beyond + 1
    full = (1 << width) - 1
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    up, down, score = full >> width - 1 - beyond << width - 1 - beyond, 0, apart
    for j, c in enumerate(b):
        at = where.get(c, 0)
        shift = j + beyond - width + 1
        equal = (at >> shift if shift >= 0 else at << -shift) & full
        zero = ((((equal & up) + up) ^ up) | equal | down) & full
        if j >= apart and not zero >> beyond & 1:
            score += 1
            if score > most:
                return False
        rise = down | full ^ (zero | up)
        moved = zero >> 1
        up, down = zero & up | full ^ (moved | rise), moved & rise
    return True


def edits_within(a: str, b: str, most: int) -> bool:
    """Whether at most `most` insertions, deletions and substitutions turn a into b."""
    if abs(len(a) - len(b)) > most:
        return False
    a, b = _trimmed(a, b)
    told = _at_once(a, b, most)
    return _by_columns(a, b, most) if told is None else told


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _spans(pairs: list[tuple[str, str]], most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(apart, beyond): by how much the lengths of each pair differ, and how far past either end of that a path of `most` edits can stray."""
    apart = np.array([len(b) - len(a) for a, b in pairs], dtype=np.int64)
    return apart, (most - apart) // 2


def _by_bands(pairs: list[tuple[str, str]], most: np.ndarray) -> np.ndarray:
    """edits_within for pairs (shorter, longer) of like lengths, side by side.

    64-bit words hold the vertical steps in a band of diagonals that moves down with
    the columns (Hyyro 2003). What lies outside the band counts as one more than
    inside, which no path within the bound needs. The score follows the diagonal
    that ends in the last cell, and never falls.
    """
    n = len(pairs)
    apart, beyond = _spans(pairs, most)
    words = int((apart + 2 * beyond).max()) // 64 + 1
    band = 64 * words
    rows, columns = (np.array([len(p[s]) for p in pairs]) for s in (0, 1))
    flat = [_points("".join(p[s] for p in pairs)) for s in (0, 1)]
    top = max(int(f.max()) for f in flat)
    kind = np.uint8 if top < 0xFE else np.uint16 if top < 0xFFFE else np.uint32
    steps = int(columns.max())
    down = np.full((n, band + steps), np.iinfo(kind).max, dtype=kind)
    across = np.full((n, steps), np.iinfo(kind).max - 1, dtype=kind)
    for into, values, size, shift in ((down, flat[0], rows, band - 1 - beyond), (across, flat[1], columns, np.zeros(n, dtype=np.int64))):
        owner = np.repeat(np.arange(n), size)
        place = np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)
        into[owner, place + shift[owner]] = values
    across = np.ascontiguousarray(across.T)[:, :, None]
    # the rows from the first on lie one above the other at the start
    first = band - 1 - beyond
    up = np.stack([np.where(first >= 64 * (w + 1), U64(0), ~U64(0) << np.clip(first - 64 * w, 0, 63).astype(U64)) for w in range(words)])
    down_steps = np.zeros((words, n), dtype=U64)
    last = band - 1 - apart - beyond
    word, bit = last >> 6, (last & 63).astype(U64)
    active, score = np.arange(n), apart.copy()
    out = np.zeros(n, dtype=bool)
    met, total, rise, fall = (np.empty_like(up) for _ in range(4))
    one, high = U64(1), U64(63)
    late, early = int(apart.max()), int(columns.min())
    for j in range(steps):
        equal = np.packbits(down[:, j : j + band] == across[j], axis=1, bitorder="little").view(U64).T
        np.bitwise_and(equal, up, out=met)
        np.add(met, up, out=total)
        if words > 1:
            over = total < up
            for w in range(1, words):
                total[w] += over[w - 1]
                over[w] |= over[w - 1] & (total[w] == 0)
        total ^= up
        total |= equal
        total |= down_steps
        # total: where the step along the diagonal is free
        free = ((total[0] if words == 1 else total[word, np.arange(len(active))]) >> bit) & one
        if late <= j < early:
            score += 1 - free.astype(np.int64)
        else:
            score += ((j >= apart) & (j < columns)) & (free == 0)
        np.bitwise_or(total, up, out=rise)
        np.invert(rise, out=rise)
        rise |= down_steps
        np.bitwise_and(total, up, out=fall)
        moved = total >> one
        if words > 1:
            moved[:-1] |= total[1:] << high
        np.bitwise_or(moved, rise, out=up)
        np.invert(up, out=up)
        up |= fall
        np.bitwise_and(moved, rise, out=down_steps)
        if j % STRIDE == STRIDE - 1 or j == steps - 1:
            done = columns <= j + 1
            out[active[done]] = score[done] <= most[done]
            left = ~done & (score <= most)
            if not left.any():
                break
            if 4 * left.sum() < 3 * len(left):
                active, down, across, columns, most, score, apart, word, bit = active[left], down[left], across[:, left], columns[left], most[left], score[left], apart[left], word[left], bit[left]
                up, down_steps = np.ascontiguousarray(up[:, left]), np.ascontiguousarray(down_steps[:, left])
                met, total, rise, fall = (np.empty_like(up) for _ in range(4))
                late, early = int(apart.max()), int(columns.min())
    return out


def many_within(pairs: list[tuple[str, str]], most: np.ndarray) -> np.ndarray:
    """edits_within of each pair; pairs of like lengths are taken side by side."""
    out = np.zeros(len(pairs), dtype=bool)
    left, trimmed = [], []
    for k, (a, b) in enumerate(pairs):
        if abs(len(a) - len(b)) > most[k]:
            continue
        a, b = _trimmed(a, b)
        told = _at_once(a, b, most[k])
        if told is None:
            left.append(k)
            trimmed.append((a, b) if len(a) <= len(b) else (b, a))
        else:
            out[k] = told
    if not left:
        return out
    at, bound = np.array(left), most[left]
    shorter = np.array([len(a) for a, _ in trimmed])
    # runs of twice the length and the width at most: there are few, and each has many pairs
    words = np.ceil(np.log2(bound // 64 + 1)).astype(np.int64)
    order = np.lexsort((shorter, words))
    start = 0
    while start < len(order):
        head = order[start]
        alike = (words[order[start:]] == words[head]) & (shorter[order[start:]] <= 2 * shorter[head])
        stop = start + min(MANY, int(np.argmin(alike)) if not alike.all() else len(alike))
        own = order[start:stop]
        start = stop
        narrow = bound[own] // 64 < MOST_WORDS
        if narrow.sum() >= FEW:
            some = own[narrow]
            out[at[some]] = _by_bands([trimmed[k] for k in some], bound[some].astype(np.int64))
            own = own[~narrow]
        for k in own:
            out[at[k]] = _by_columns(*trimmed[k], int(bound[k]))
    return out
