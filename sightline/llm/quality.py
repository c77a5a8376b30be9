"""Quality by histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import each_text
from .textkit import U64, sums_by_text, text_slices, word_table, words_of
from .training import in_fold, labelled, sigmoid

STATISTICS = [
    "log_words", "log_bytes", "word_length", "letters", "digits", "symbols", "bars", "marks", "lines", "capitals",
    "non_ascii", "spaces", "brackets", "distinct", "adjacent", "top_share", "sentence_words", "short_words", "long_words", "capital_words",
]


def _classes() -> np.ndarray:
    """Byte to the class that the statistics count."""
    kind = np.zeros(256, dtype=np.uint8)
    for b in range(256):
        c = chr(b)
        kind[b] = 10 if b >= 128 else 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if c in ".,;:!?'-" else 5 if c == "|" else 6 if c == "\n" else 7 if c.isspace() else 8 if c in "()[]{}<>\"" else 9
    return kind


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text of a slice; zeros for a text without words."""
    n = len(offsets) - 1
    kind = _classes()[raw]
    inner = offsets[1:] - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(owner * 11 + kind, minlength=n * 11).reshape(n, 11).astype(np.float64)
    counts[:, 6] -= 1  # the newline that ends each text in the slice
    size = np.maximum(inner - offsets[:-1], 1).astype(np.float64)
    _, starts, ends, words, first = words_of(raw, offsets, word_table())
    n_words = np.diff(first).astype(np.float64)
    some = np.maximum(n_words, 1)
    length = (ends - starts).astype(np.float64)
    doc = np.repeat(np.arange(n), np.diff(first))
    same = np.zeros(len(words))
    same[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    key = np.sort((doc.astype(U64) << U64(44)) | (words >> U64(20)))
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    begin = np.flatnonzero(new)
    run = np.diff(np.append(begin, len(key)))
    whose = (key[begin] >> U64(44)).astype(np.int64)
    distinct = np.bincount(whose, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, whose, run)
    stops = np.isin(raw, np.frombuffer(b".!?\n", dtype=np.uint8)).astype(np.float64)
    sentences = np.maximum(sums_by_text(stops, offsets), 1)
    capital = ((raw[starts] >= 65) & (raw[starts] <= 90)).astype(np.float64)
    out = np.column_stack([
        np.log1p(n_words), np.log1p(size), sums_by_text(length, first) / some, (counts[:, 1] + counts[:, 2]) / size, counts[:, 3] / size, counts[:, 9] / size, counts[:, 5] / some, counts[:, 4] / some, counts[:, 6] / some, counts[:, 2] / size,
        counts[:, 10] / size, counts[:, 7] / size, counts[:, 8] / size, distinct / some, sums_by_text(same, first) / some, top / some, n_words / sentences, sums_by_text((length <= 3).astype(np.float64), first) / some, sums_by_text((length >= 10).astype(np.float64), first) / some, sums_by_text(capital, first) / some,
    ])
    out[n_words == 0] = 0
    return out


@dataclass(frozen=True)
class Trees:
    """Every tree's nodes in one set of arrays; a leaf points at itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The chance of label 1 of each row: all rows step down each tree together."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return sigmoid(total)


def grow(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.1, least: int = 20, smooth: float = 1.0) -> Trees:
    """Boost trees on the logistic loss, splitting on per-node gradient histograms."""
    mean = float(np.clip(y.mean() if len(y) else 0.5, 1e-4, 1 - 1e-4))
    base = float(np.log(mean / (1 - mean)))
    nodes: list[list[float]] = []
    roots: list[int] = []
    if len(y) >= 2 * least and 0 < y.mean() < 1:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        code = np.column_stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(x.shape[1])])
        total = np.full(len(y), base)
        for _ in range(trees):
            p = sigmoid(total)
            grad, hess = y - p, p * (1 - p)
            place = np.zeros(len(y), dtype=np.int64)  # which open node each row is in, -1 once in a leaf
            roots.append(len(nodes))
            nodes.append([0, 0, len(nodes), len(nodes), 0])
            open_nodes = [roots[-1]]
            for level in range(depth + 1):
                m = len(open_nodes)
                live = place >= 0
                g = np.bincount(place[live], weights=grad[live], minlength=m)
                h = np.bincount(place[live], weights=hess[live], minlength=m)
                gain, best = np.zeros(m), [(-1, 0)] * m
                for f in range(x.shape[1]) if level < depth else ():
                    slot = place[live] * bins + code[live, f]
                    gl, hl, cl = (np.cumsum(np.bincount(slot, weights=v, minlength=m * bins).reshape(m, bins), axis=1) for v in (grad[live], hess[live], None))
                    gr, hr, cr = g[:, None] - gl, h[:, None] - hl, cl[:, -1:] - cl
                    got = gl**2 / (hl + smooth) + gr**2 / (hr + smooth) - (g**2 / (h + smooth))[:, None]
                    got[(cl < least) | (cr < least)] = 0
                    at = got.argmax(axis=1)
                    for k in np.flatnonzero(got[np.arange(m), at] > gain + 1e-9):
                        gain[k], best[k] = got[k, at[k]], (f, int(at[k]))
                to = np.full(place.shape, -1)
                opened: list[int] = []
                for k, node in enumerate(open_nodes):
                    rows = np.flatnonzero(place == k)
                    f, cut = best[k]
                    if f < 0 or cut >= len(edges[f]):
                        nodes[node][4] = rate * g[k] / (h[k] + smooth)
                        total[rows] += nodes[node][4]
                        continue
                    kids = [len(nodes), len(nodes) + 1]
                    nodes.extend([[0, 0, kid, kid, 0] for kid in kids])
                    nodes[node][:4] = [f, edges[f][cut], *kids]
                    to[rows] = len(opened) + (code[rows, f] > cut)
                    opened.extend(kids)
                place, open_nodes = to, opened
                if not opened:
                    break
    flat = np.array(nodes).reshape(-1, 5)
    return Trees(np.array(roots, dtype=np.int64), flat[:, 0].astype(np.int64), flat[:, 1], flat[:, 2].astype(np.int64), flat[:, 3].astype(np.int64), flat[:, 4], depth, base)


def _sampled(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at, n, raw, offsets in text_slices(batch.column("text")):
        x = statistics(raw, offsets)
        yield pa.RecordBatch.from_arrays([batch.column("label").slice(at, n), batch.column("rank").slice(at, n), *[pa.array(np.ascontiguousarray(c)) for c in x.T]], names=["label", "rank", *STATISTICS])


def fit(docs: DataFrame, labels: DataFrame, *, most_docs: int = 20_000, **parameters) -> Trees:
    """Trees grown on at most most_docs labelled training documents."""
    sample = labelled(docs, labels, "quality", most_docs).select("label", "rank", "text")
    got = sample.mapInArrow(each_text(_sampled), "label int, rank long, " + ", ".join(f"{c} double" for c in STATISTICS)).toPandas().sort_values(["rank", *STATISTICS])
    return grow(got[STATISTICS].to_numpy(dtype=np.float64), got["label"].to_numpy(dtype=np.float64), **parameters)


def _score(batch: pa.RecordBatch, model: Trees) -> Iterator[pa.RecordBatch]:
    for at, n, raw, offsets in text_slices(batch.column("text")):
        x = statistics(raw, offsets)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, n), pa.array(model.predict(x)), pa.array(np.rint(np.expm1(x[:, 0])).astype(np.int64))], names=["doc_id", "score", "n_words"])


def scored(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """Fit on the training rows and score every text: doc_id, held_out, score, predicted, n_words.

    predicted is 1 from a score of 0.3. A null or empty text has all statistics 0
    and is scored like any other; one row comes out per row in; without labels
    every score is 0.5; columns other than doc_id and text are not read.
    """
    model = fit(docs, labels, **parameters)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = texts.mapInArrow(each_text(_score, model), "doc_id long, score double, n_words long")
    return out.select("doc_id", in_fold("doc_id", 5).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_words")
