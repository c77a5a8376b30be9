"""Vectorised text kernels over Arrow batches.

Texts of a batch are laid end to end as UTF-8 bytes in slices of about a
megabyte, and words, shingles and q-grams are found and hashed by numpy over the
whole slice, so no Python code runs per word. Memory is bounded by the slice and
the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
U64 = np.uint64
#: Odd multipliers of the polynomial and of the 64-bit finalisers.
BASE = 0x9E3779B97F4A7C15
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB

_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every output bit depends on every input bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(MIX_1)
    x ^= x >> U64(27)
    x *= U64(MIX_2)
    x ^= x >> U64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse modulo 2**64."""
    if "p" not in _powers or len(_powers["p"]) < n:
        size = max(n, 2 * SLICE_BYTES)
        for name, base in (("p", BASE), ("i", pow(BASE, -1, 1 << 64))):
            row = np.full(size, base, dtype=U64)
            row[0] = 1
            _powers[name] = np.cumprod(row, dtype=U64)
    return _powers["p"][:n], _powers["i"][:n]


def word_table(extra: bytes = b"") -> np.ndarray:
    """Byte to folded byte; 0 separates words. Letters, digits and non-ASCII bytes make words."""
    table = np.zeros(256, dtype=np.uint8)
    for b in range(256):
        if b >= 128 or chr(b).isalnum() or bytes([b]) in [bytes([x]) for x in extra]:
            table[b] = ord(chr(b).lower()) if b < 128 else b
    return table


def text_slices(column: pa.Array, limit: int = SLICE_BYTES, most_rows: int = 1 << 14) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a text column into (first row, rows, bytes, offsets) slices.

    Each text is followed by one newline byte; offsets has rows + 1 entries and
    text k is bytes[offsets[k]:offsets[k + 1] - 1]. A null counts as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    lengths = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    ends = np.cumsum(lengths)
    binary = column.cast(pa.large_binary())
    first = 0
    while first < len(column):
        before = ends[first - 1] if first else 0
        last = min(max(first + 1, int(np.searchsorted(ends, before + limit, side="right"))), first + most_rows)
        rows = last - first
        joined = b"\n".join([*binary.slice(first, rows).to_pylist(), b""])
        offsets = np.zeros(rows + 1, dtype=np.int64)
        np.cumsum(lengths[first:last], out=offsets[1:])
        yield first, rows, np.frombuffer(joined, dtype=np.uint8), offsets
        first = last


def points_before(raw: np.ndarray) -> np.ndarray:
    """Code points that begin before each byte, and in all."""
    return np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])


def fold(raw: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The table's byte for each byte, with the two-byte Latin-1 capitals lower-cased; every byte keeps its place."""
    out = table[raw]
    after = np.flatnonzero(raw[:-1] == 0xC3) + 1
    if len(after):
        b = raw[after]
        out[after[(b >= 0x80) & (b <= 0x9E) & (b != 0x97)]] += 32
    return out


def find_words(folded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of non-zero bytes."""
    inside = np.zeros(len(folded) + 2, dtype=np.int8)
    inside[1:-1] = folded != 0
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def hash_spans(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, from one prefix sum over the slice."""
    power, inverse = powers(len(folded) + 1)
    prefix = np.zeros(len(folded) + 1, dtype=U64)
    np.cumsum((folded.astype(U64) + U64(1)) * power[: len(folded)], out=prefix[1:])
    value = (prefix[ends] - prefix[starts]) * inverse[starts]
    return mix64(value + (ends - starts).astype(U64) * U64(MIX_2))


def words_of(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a slice: folded bytes, starts, ends, hashes, and for each text the first word's index."""
    folded = fold(raw, table)
    starts, ends = find_words(folded)
    return folded, starts, ends, hash_spans(folded, starts, ends), np.searchsorted(starts, offsets)


def shingles_of(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of each text, text after text, and where each text's begin.

    A text of fewer words than size but of one at least has one shingle of all its words.
    """
    counts = np.diff(first)
    n = len(words)
    if n == 0:
        return np.zeros(0, dtype=U64), np.zeros(len(first), dtype=np.int64)
    made = np.maximum(counts - size + 1, (counts > 0).astype(np.int64))
    begins = np.zeros(len(first), dtype=np.int64)
    np.cumsum(made, out=begins[1:])
    owner = np.repeat(np.arange(len(counts)), made)
    at = first[owner] + (np.arange(begins[-1]) - begins[owner])
    left = np.minimum(first[owner + 1] - at, size)
    value = np.zeros(len(at), dtype=U64)
    padded = np.concatenate([words, np.zeros(size, dtype=U64)])
    for j in range(size):
        part = padded[at + j] * U64(pow(BASE, 2 * j + 3, 1 << 64))
        value += np.where(left > j, part, U64(0)) if (counts < size).any() else part
    return mix64(value), begins


def sums_by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values over each text's index range, 0 where it is empty."""
    total = np.concatenate([np.zeros(1, dtype=values.dtype), np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def qgrams8(raw: np.ndarray) -> np.ndarray:
    """Every 8 successive bytes as one integer."""
    if len(raw) < 8:
        return np.zeros(0, dtype=U64)
    two = raw[:-1].astype(np.uint16) | (raw[1:].astype(np.uint16) << np.uint16(8))
    four = two[:-2].astype(np.uint32) | (two[2:].astype(np.uint32) << np.uint32(16))
    return four[:-4].astype(U64) | (four[4:].astype(U64) << U64(32))


def as_long(x: np.ndarray) -> pa.Array:
    """Unsigned 64-bit hashes as Spark longs."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def ragged(values: np.ndarray, begins: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and where each row's begin."""
    return pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(values, type=kind))
