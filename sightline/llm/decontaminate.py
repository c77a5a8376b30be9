"""Benchmark decontamination: the q-gram lemma on diagonal bands, then banded alignment."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import each_text, written
from .textkit import BASE, MIX_2, U64, fold, points_before, qgrams8, text_slices, word_table

#: Bits of the table that tells which q-grams can occur at all.
FILTER_BITS = 22


def normalise(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters, digits and non-ASCII bytes with single blanks for all else; and each kept byte's place.

    The newline that ends each text in a slice stays, so texts do not run together.
    """
    folded = fold(raw, word_table())
    folded[folded == 0] = 32
    folded[raw == 10] = 32
    keep = np.ones(len(folded), dtype=bool)
    keep[1:] = (folded[1:] != 32) | (folded[:-1] != 32)
    return folded[keep], np.flatnonzero(keep)


def grams(text: np.ndarray, q: int) -> np.ndarray:
    """A hash of every q successive bytes, q from 8 to 16: of the first 8 and the last 8 of them."""
    eight = qgrams8(text)
    n = len(text) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    value = eight[:n] * U64(BASE)
    value ^= value >> U64(29)
    value += eight[q - 8 : q - 8 + n]
    value *= U64(MIX_2)
    return value ^ (value >> U64(32))


@dataclass(frozen=True)
class Items:
    """Benchmark passages with their edit budgets, and an index of their q-grams.

    hashes takes 8 bytes and begins, item and place 4 each for a byte of text, at most.
    """

    ids: list
    texts: list[np.ndarray]
    budgets: np.ndarray
    needed: np.ndarray
    q: int
    hashes: np.ndarray
    begins: np.ndarray
    item: np.ndarray
    place: np.ndarray
    table: np.ndarray


def budget(length: int, q: int, edits: float) -> tuple[int, int]:
    """(k, t): the most edits, up to the share `edits`, that leave at least t = length + 1 - q * (k + 1) >= 1 common q-grams."""
    k = min(int(edits * length), (length - q) // q)
    return k, length + 1 - q * (k + 1)


def index(rows: list[tuple[object, str]], q: int, edits: float) -> Items:
    """Index the passages of at least q normalised bytes; shorter ones cannot be searched."""
    ids, texts, budgets, needed = [], [], [], []
    for item_id, text in rows:
        clean = normalise(np.frombuffer(text.encode(), dtype=np.uint8))[0].tobytes().strip()
        if len(clean) >= q:
            k, t = budget(len(clean), q, edits)
            ids.append(item_id)
            texts.append(np.frombuffer(clean, dtype=np.uint8))
            budgets.append(k)
            needed.append(t)
    found = [grams(t, q) for t in texts]
    flat = np.concatenate([np.zeros(0, dtype=U64), *found])
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(f) for f in found])
    place = np.concatenate([np.zeros(0, dtype=np.int32), *[np.arange(len(f), dtype=np.int32) for f in found]])
    order = np.argsort(flat, kind="stable")
    hashes, begins = np.unique(flat[order], return_index=True)
    begins = begins.astype(np.int32)
    table = np.zeros(1 << FILTER_BITS, dtype=bool)
    table[(hashes >> U64(64 - FILTER_BITS)).astype(np.int64)] = True
    return Items(ids, texts, np.array(budgets, dtype=np.int64), np.array(needed, dtype=np.int64), q, hashes, np.append(begins, np.int32(len(flat))), owner[order], place[order], table)


def aligned(pattern: np.ndarray, region: np.ndarray, most: int, shift: int) -> tuple[int, int, int] | None:
    """The best alignment of pattern inside region with at most `most` edits: (edits, start, end), or None.

    Only diagonals 0 to shift of region against pattern, widened by the budget,
    are filled: row by row over the pattern, each row by numpy.
    """
    exact = region.tobytes().find(pattern.tobytes())
    if exact >= 0:
        return 0, exact, exact + len(pattern)
    if most == 0:
        return None
    big = 1 << 20
    width = shift + 2 * most + 1
    # cell x of row i stands for region position i + x - most
    columns = np.arange(width) - most
    cost = np.where((columns >= 0) & (columns <= len(region)), 0, big).astype(np.int64)
    start = np.clip(columns, 0, len(region)).astype(np.int64)
    ramp = np.arange(width)
    for i, c in enumerate(pattern, 1):
        at = i + columns
        legal = (at >= 0) & (at <= len(region))
        letter = region[np.clip(at - 1, 0, max(len(region) - 1, 0))] if len(region) else np.zeros(width, dtype=np.uint8)
        change = np.where((at >= 1) & legal, cost + (letter != c), big)
        drop = np.append(cost[1:], big) + 1
        took = np.where(drop < change, np.append(start[1:], 0), start)
        new = np.where(legal, np.minimum(change, drop), big)
        level = np.minimum.accumulate(new - ramp)
        source = np.maximum.accumulate(np.where(new - ramp == level, ramp, 0))
        cost, start = np.minimum(level + ramp, big), took[source]
        cost[~legal] = big
        if cost.min() > most:
            return None
    end = len(pattern) + columns
    best = int(np.lexsort((end - start, cost))[0])
    return (int(cost[best]), int(start[best]), int(end[best])) if cost[best] <= most else None


def _search(text: np.ndarray, items: Items, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(text number, item, edits, start, end) in the normalised slice; offsets part the texts."""
    value = grams(text, items.q)
    at = np.flatnonzero(items.table[(value >> U64(64 - FILTER_BITS)).astype(np.int64)])
    if not len(at):
        return
    slot = np.minimum(np.searchsorted(items.hashes, value[at]), len(items.hashes) - 1)
    real = items.hashes[slot] == value[at]
    at, slot = at[real], slot[real]
    counts = items.begins[slot + 1] - items.begins[slot]
    which = np.repeat(np.arange(len(at)), counts)
    posting = np.repeat(items.begins[slot], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    where = at[which]
    item, place = items.item[posting], items.place[posting]
    doc = np.searchsorted(offsets, where, side="right") - 1
    inside = where + items.q <= offsets[doc + 1]
    where, item, place, doc = where[inside], item[inside], place[inside], doc[inside]
    # a match with k edits keeps its q-grams on k + 1 neighbouring diagonals, so in one of two overlapping bands of width 2(k + 1)
    wide = items.budgets[item] + 1
    diagonal = where - place - offsets[doc] + len(text)
    band = diagonal // wide
    keys = np.concatenate([np.stack([doc, item, band]), np.stack([doc, item, band - 1])], axis=1)
    spots = np.concatenate([where, where])
    order = np.lexsort((spots, keys[2], keys[1], keys[0]))
    keys, spots = keys[:, order], spots[order]
    new = np.ones(len(spots), dtype=bool)
    new[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
    # a q-gram of the text counts once in a band, however often it is in the item
    fresh = new.copy()
    fresh[1:] |= spots[1:] != spots[:-1]
    begin = np.flatnonzero(new)
    hits = np.add.reduceat(fresh.astype(np.int64), begin) if len(begin) else np.zeros(0, dtype=np.int64)
    regions: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for b in begin[hits >= items.needed[keys[1, begin]]]:
        d, i, line = (int(v) for v in keys[:, b])
        k, m = int(items.budgets[i]), len(items.texts[i])
        first = line * (k + 1) - len(text) + int(offsets[d]) - k
        low, high = max(int(offsets[d]), first), min(int(offsets[d + 1]), first + 2 * (k + 1) + m + 3 * k)
        if high - low >= m - k:
            regions.setdefault((d, i), []).append((low, high))
    for (d, i), own in regions.items():
        for edits, a, b in occurrences(text, items.texts[i], int(items.budgets[i]), own):
            yield d, i, edits, a, b


class Taken:
    """Spans that do not overlap, and what they leave free."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.spans: list[tuple[int, int, int]] = []

    def add(self, edits: int, a: int, b: int) -> bool:
        """Keep a span unless it overlaps one that is kept."""
        at = bisect_left(self.starts, b)
        if at and self.spans[at - 1][2] > a:
            return False
        self.starts.insert(at, a)
        self.spans.insert(at, (edits, a, b))
        return True

    def free(self, a: int, b: int) -> Iterator[tuple[int, int]]:
        """The parts of a span between the kept ones."""
        at = max(0, bisect_left(self.starts, a) - 1)
        while a < b:
            while at < len(self.spans) and self.spans[at][2] <= a:
                at += 1
            stop = min(b, self.starts[at]) if at < len(self.spans) else b
            if stop > a:
                yield a, stop
            a = self.spans[at][2] if at < len(self.spans) else b


def occurrences(text: np.ndarray, pattern: np.ndarray, most: int, regions: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(edits, start, end) of the pattern in regions of text, by start; no two overlap.

    Exact ones come first, from left to right. Then, again and again, the best of
    each free part of a region, those of fewest edits and smallest start first,
    until no free part holds one.
    """
    taken, m = Taken(), len(pattern)
    whole, reach = pattern.tobytes(), 0
    for low, high in sorted(regions):
        low = max(low, reach)
        raw = text[low:high].tobytes()
        at = raw.find(whole)
        while at >= 0:
            taken.add(0, low + at, low + at + m)
            at = raw.find(whole, at + m)
        # an occurrence may begin before this region ends and end in the next
        reach = max(low, high - m + 1, taken.spans[-1][2] if taken.spans else 0)
    tried: dict[tuple[int, int], tuple[int, int, int] | None] = {}
    new = most > 0
    while new:
        proposed = set()
        for region in regions:
            for a, b in taken.free(*region):
                if b - a >= m - most:
                    if (a, b) not in tried:
                        tried[a, b] = aligned(pattern, text[a:b], most, max(0, b - a - m + most))
                    if got := tried[a, b]:
                        proposed.add((got[0], a + got[1], a + got[2]))
        new = [x for x in sorted(proposed) if taken.add(*x)]
    return taken.spans


def _passages(batch: pa.RecordBatch, items: Items) -> Iterator[pa.RecordBatch]:
    for at, _, raw, offsets in text_slices(batch.column("text")):
        clean, source = normalise(raw)
        edges = np.searchsorted(source, offsets)
        points = points_before(raw)
        rows = []
        for d, i, edits, a, b in _search(clean, items, edges):
            lo = points[offsets[d]]
            rows.append((at + d, items.ids[i], edits, points[source[a]] - lo, points[source[b - 1] + 1] - lo))
        if rows:
            take = pa.array([r[0] for r in rows])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column("row_key").take(take), *[pa.array([r[k] for r in rows], type=t) for k, t in ((1, pa.int64()), (2, pa.int32()), (3, pa.int32()), (4, pa.int32()))]],
                names=["doc_id", "row_key", "item_id", "edits", "start", "end"],
            )


def _clean(batch: pa.RecordBatch, items: Items) -> Iterator[pa.RecordBatch]:
    kept = np.ones(batch.num_rows, dtype=bool)
    for at, _, raw, offsets in text_slices(batch.column("text")):
        clean, source = normalise(raw)
        for d, *_ in _search(clean, items, np.searchsorted(source, offsets)):
            kept[at + d] = False
    if kept.any():
        yield batch.filter(pa.array(kept))


#: Bytes of an index for each byte of benchmark text, at most, and of its table of what can occur.
INDEX_BYTES, TABLE_BYTES = 21, 1 << FILTER_BITS


def blocks(benchmark: DataFrame, q: int, edits: float, most_bytes: int) -> Iterator[tuple[Items, bool]]:
    """The benchmark in blocks whose index takes about most_bytes, one held at a time, and whether it is the only one."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(size * INDEX_BYTES / most_bytes))
    for part in range(parts):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part) if parts > 1 else rows
        found = index([(r["item_id"], r["text"]) for r in own.orderBy("item_id", "text").collect()], q, edits)
        if found.ids:
            yield found, parts == 1


def contaminated(docs: DataFrame, benchmark: DataFrame, *, q: int = 12, edits: float = 0.07, most_bytes: int = 64 << 20) -> DataFrame:
    """Where benchmark passages stand in documents: (doc_id, row_key, item_id, edits, start, end).

    Texts are compared as lower-case letters and digits with single blanks, by
    bytes. A passage of m bytes is found with up to min(edits * m, (m - q) / q)
    edits, the number for which the q-gram lemma still asks for a common q-gram;
    passages under q bytes are not searched. Every occurrence is a row: those of
    one passage in one text never overlap, exact ones are taken first, then those
    of fewest edits, and of equal ones the leftmost; different passages may
    overlap. start and end are code points of the text.

    The benchmark is read in blocks whose index takes about most_bytes (about 21
    bytes a byte of text, and 4 MB), one block at a time on the driver and in the
    tasks; the documents are scanned once a block and never shuffled. With several
    blocks each block's rows are written before the next is read. A null text is
    empty, a null or empty passage is skipped, rows that repeat give their rows as
    often, an empty table on either side gives no rows, and other columns are not
    read, whatever their names.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", F.xxhash64(text).alias("row_key"), text.alias("text"))
    schema = "doc_id long, row_key long, item_id long, edits int, start int, end int"
    out = keyed.sparkSession.createDataFrame([], schema)
    for items, alone in blocks(benchmark, q, edits, most_bytes):
        found = keyed.mapInArrow(each_text(_passages, items), schema)
        out = out.unionByName(found if alone else written(found))
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, *, q: int = 12, edits: float = 0.07, most_bytes: int = 64 << 20) -> DataFrame:
    """docs without those that hold a benchmark passage; the other rows are unchanged.

    Texts that are null or empty stay; rows that repeat stay or go together; an
    empty table on either side changes nothing.
    """
    for items, alone in blocks(benchmark, q, edits, most_bytes):
        docs = docs.mapInArrow(each_text(_clean, items), docs.schema)
        docs = docs if alone else written(docs)
    return docs
