"""Toxicity by multiple-instance learning: noisy-or over sentences, learned from document labels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import each_text, written
from .textkit import U64, hash_spans, mix64, points_before, ragged, sums_by_text, text_slices, word_table, words_of
from .training import in_fold, labelled, sigmoid, within

#: Bytes that end a sentence.
BREAKS = b".!?\n"
#: Lengths in bytes of the word beginnings that are features.
PREFIXES = (4, 5, 6, 7, 8)
#: Features are hashed to this many bits.
BITS = 20


@dataclass(frozen=True)
class ToxicModel:
    """weights by hashed word, the bias of a sentence, and the chance of a label with no cause in the text."""

    weights: np.ndarray
    bias: float
    leak: float


def _sentences(raw: np.ndarray, offsets: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray, np.ndarray]:
    """Features, the first word of each text, each word's sentence, and the sentences ended up to each byte.

    A feature group is (hashes, indices of the words that have one): whole words,
    and the leading bytes of the words that are longer.
    """
    folded, starts, ends, words, first = words_of(raw, offsets, word_table())
    stops = np.zeros(256, dtype=bool)
    stops[list(BREAKS)] = True
    before = np.cumsum(stops[raw])
    sentence = before[starts] if len(starts) else np.zeros(0, dtype=np.int64)
    groups = [(words, np.arange(len(words)))]
    for size in PREFIXES:
        longer = np.flatnonzero(ends - starts > size)
        groups.append((mix64(hash_spans(folded, starts[longer], starts[longer] + size) + U64(size)), longer))
    return [((h >> U64(64 - BITS)).astype(np.int64), at) for h, at in groups], first, sentence, before


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents of each label each feature occurs, summed over a partition."""
    held = np.zeros((2, 1 << BITS), dtype=np.int64)
    for batch in batches:
        for at, n, raw, offsets in text_slices(batch.column("text")):
            label = batch.column("label").to_numpy(zero_copy_only=False)[at : at + n]
            groups, first, _, _ = _sentences(raw, offsets)
            doc = np.repeat(np.arange(n), np.diff(first))
            pairs = np.unique(np.concatenate([doc[which] << BITS | slot for slot, which in groups]))
            for k in (0, 1):
                held[k] += np.bincount(pairs[label[pairs >> BITS] == k] & ((1 << BITS) - 1), minlength=1 << BITS)
    some = np.flatnonzero(held.sum(axis=0))
    if len(some):
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[0][some]), pa.array(held[1][some])], names=["slot", "clean", "toxic"])


def _examples(batch: pa.RecordBatch, column: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of each document the sentences, and the chosen features in them."""
    for at, n, raw, offsets in text_slices(batch.column("text")):
        groups, first, sentence, _ = _sentences(raw, offsets)
        doc = np.repeat(np.arange(n), np.diff(first))
        bags = np.unique(doc << 40 | sentence)
        inside = np.searchsorted(bags >> 40, np.arange(n + 1))
        slot = np.concatenate([column[s] for s, _ in groups])
        word = np.concatenate([w for _, w in groups])
        slot, word = slot[slot >= 0], word[slot >= 0]
        order = np.argsort(word, kind="stable")
        slot, word = slot[order], word[order]
        bag = np.searchsorted(bags, doc[word] << 40 | sentence[word])
        begins = np.searchsorted(doc[word], np.arange(n + 1))
        yield pa.RecordBatch.from_arrays(
            [batch.column("rank").slice(at, n), batch.column("label").slice(at, n), pa.array(np.diff(inside)), ragged(slot, begins, pa.int32()), ragged(bag - inside[doc[word]], begins, pa.int32())],
            names=["rank", "label", "sentences", "slots", "bags"],
        )


def fit(docs: DataFrame, labels: DataFrame, *, most_docs: int = 16_000, most_sentences: int = 2_000_000, most_features: int = 8192, least_gain: float = 12.0, rounds: int = 150, shrink: float = 2e-5) -> ToxicModel:
    """Learn sentence weights from document labels of training rows.

    The sample holds at most most_docs documents of at most most_sentences
    sentences in all. A document is toxic if any sentence is:
    P = 1 - (1 - leak) * prod(1 - p). Features whose presence tells the labels
    apart by a likelihood ratio of least_gain are weighed, most_features at most.
    Without both labels in the sample the model knows the rate of label 1 alone.
    """
    sample = written(labelled(docs, labels, "toxic", most_docs).select("rank", "label", "text"))
    totals = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    clean, toxic = totals.get(0, 0), totals.get(1, 0)
    weights = np.zeros(1 << BITS, dtype=np.float32)
    rate = float(np.clip(toxic / max(1, clean + toxic), 1e-4, 1 - 1e-4))
    if not clean or not toxic:
        return ToxicModel(weights, -12.0, rate)
    counts = sample.mapInArrow(_presence, "slot long, clean long, toxic long").groupBy("slot").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    both = F.col("c") + F.col("t")
    share = (F.col("t") + 0.5) / (toxic + 1) / ((F.col("c") + 0.5) / (clean + 1))
    gain = 2 * (F.col("t") * F.log(F.greatest(F.col("t"), F.lit(0.5)) / (both * rate)) + F.col("c") * F.log(F.greatest(F.col("c"), F.lit(0.5)) / (both * (1 - rate))))
    chosen = counts.where((gain >= least_gain) & (share > 1)).orderBy(gain.desc(), "slot").limit(most_features).select("slot").toPandas()["slot"].to_numpy(dtype=np.int64)
    column = np.full(1 << BITS, -1, dtype=np.int32)
    column[np.sort(chosen)] = np.arange(len(chosen))
    schema = "rank long, label int, sentences long, slots array<int>, bags array<int>"
    made = written(sample.mapInArrow(each_text(_examples, column), schema))
    got = within(made, "sentences", most_sentences).toArrow().combine_chunks().sort_by("rank")
    y = got.column("label").to_numpy().astype(np.float64)
    sentences = got.column("sentences").to_numpy()
    owner = np.repeat(np.arange(len(y)), sentences)
    lists = [got.column(c).combine_chunks() for c in ("slots", "bags")]
    slot, bag = (np.asarray(x.flatten()).astype(np.int64) for x in lists)
    bag = bag + np.repeat(np.cumsum(sentences) - sentences, np.diff(np.asarray(lists[1].offsets)))
    w, tail = np.zeros(len(chosen)), np.array([-8.0, -6.0])
    state = [[np.zeros_like(v), np.zeros_like(v)] for v in (w, tail)]
    for step in range(1, rounds + 1):
        s = np.bincount(bag, weights=w[slot], minlength=len(owner)) + tail[0]
        total = np.bincount(owner, weights=np.logaddexp(0, s), minlength=len(y)) + np.logaddexp(0, tail[1])
        push = (1 - y) - y * np.exp(-total) / -np.expm1(-total)
        slope = push[owner] * sigmoid(s)
        grads = [np.bincount(slot, weights=slope[bag], minlength=len(chosen)) / len(y) + shrink * w]
        grads.append(np.array([slope.sum(), (push * sigmoid(tail[1])).sum()]) / len(y))
        for value, grad, (mean, square) in zip((w, tail), grads, state):
            mean *= 0.9
            mean += 0.1 * grad
            square *= 0.99
            square += 0.01 * grad**2
            value -= 0.15 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    weights[np.sort(chosen)] = w
    return ToxicModel(weights, float(tail[0]), float(sigmoid(tail[1])))


def _noisy_or(raw: np.ndarray, offsets: np.ndarray, model: ToxicModel) -> tuple[np.ndarray, ...]:
    """Scores of the texts of a slice, and of their sentences: logits, owners, marks, counts, break counts."""
    n = len(offsets) - 1
    groups, first, sentence, before = _sentences(raw, offsets)
    weight = np.zeros(len(sentence), dtype=np.float32)
    for slot, which in groups:
        weight[which] += model.weights[slot]
    doc = np.repeat(np.arange(n), np.diff(first))
    new = np.ones(len(weight), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (sentence[1:] != sentence[:-1])
    begin = np.flatnonzero(new)
    logit = np.add.reduceat(weight, begin).astype(np.float64) + model.bias if len(begin) else np.zeros(0)
    owner = doc[begin]
    inside = np.searchsorted(owner, np.arange(n + 1))
    score = 1 - (1 - model.leak) * np.exp(-sums_by_text(np.logaddexp(0, logit), inside))
    return np.clip(score, 0.0, 1.0), logit, owner, sentence[begin], np.diff(inside), before


def _score(batch: pa.RecordBatch, model: ToxicModel, cut: float) -> Iterator[pa.RecordBatch]:
    for at, n, raw, offsets in text_slices(batch.column("text")):
        score, logit, owner, mark, sentences, before = _noisy_or(raw, offsets, model)
        spans: list[list[dict]] = [[] for _ in range(n)]
        stops = np.flatnonzero(np.diff(before, prepend=0) > 0)
        points = points_before(raw)
        for k in np.flatnonzero(logit >= np.log(cut / (1 - cut))):
            lo, hi = int(offsets[owner[k]]), int(offsets[owner[k] + 1]) - 1
            a = max(lo, int(stops[mark[k] - 1]) + 1) if mark[k] > 0 else lo
            b = min(hi, int(stops[mark[k]]) + 1) if mark[k] < len(stops) else hi
            spans[owner[k]].append({"start": int(points[a] - points[lo]), "end": int(points[b] - points[lo]), "score": float(sigmoid(logit[k]))})
        offending = pa.array(spans, type=pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))
        yield pa.RecordBatch.from_arrays(
            [batch.column("__sl_doc").slice(at, n), batch.column("__sl_key").slice(at, n), pa.array(score), pa.array(sentences), offending],
            names=["doc_id", "row_key", "score", "n_sentences", "offending"],
        )


def score(docs: DataFrame, model: ToxicModel, *, cut: float = 0.5) -> DataFrame:
    """doc_id, row_key (xxhash64 of the text), score, n_sentences and the offending sentences' spans.

    The score is the noisy-or of the sentences; offending holds each sentence of
    `cut` or more with its code point span. A null or empty text has no sentence
    and scores the leak; one row comes out per row in; other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.col("doc_id").alias("__sl_doc"), F.xxhash64(text).alias("__sl_key"), text.alias("text"))
    schema = "doc_id long, row_key long, score double, n_sentences long, offending array<struct<start:int,end:int,score:double>>"
    return keyed.mapInArrow(each_text(_score, model, cut), schema)


def scored(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """Fit on the training rows and score every text: doc_id, held_out, score, predicted and more.

    n_sentences, n_offending and offending, the spans and scores of the sentences
    that reach 0.5, tell where the score comes from. A null or empty text has no
    sentence; one row comes out per row in, so rows that repeat get equal rows;
    without labels of both kinds every score is that of a text without sentences;
    an empty table gives no rows.
    """
    out = score(docs, fit(docs, labels, **parameters))
    return out.select("doc_id", in_fold("doc_id", 5).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", F.size("offending").cast("long").alias("n_offending"), "offending")


def _clean(batch: pa.RecordBatch, model: ToxicModel, cut: float) -> Iterator[pa.RecordBatch]:
    scores = [_noisy_or(raw, offsets, model)[0] for _, _, raw, offsets in text_slices(batch.column("text"))]
    kept = np.concatenate(scores) < cut
    if kept.any():
        yield batch.filter(pa.array(kept))


def without_toxic(docs: DataFrame, labels: DataFrame, *, cut: float = 0.5, **parameters) -> DataFrame:
    """docs without those that score `cut` or more; rows and columns of the others are unchanged.

    A null or empty text scores the chance of a label without cause, and stays if
    that is under `cut`; a score of `cut` itself goes; rows that repeat go or stay
    together. Columns of docs may have any name.
    """
    model = fit(docs, labels, **parameters)
    return docs.mapInArrow(each_text(_clean, model, cut), docs.schema)
