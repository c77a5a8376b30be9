"""Language by nearest centroid: cosine of TF-IDF n-gram vectors with clustered centroids."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import each_text
from .textkit import BASE, U64, fold, qgrams8, text_slices
from .training import in_fold


#: Rows whose dense vectors are held together.
ROWS_AT_ONCE = 512


@dataclass(frozen=True)
class Centroids:
    """Unit centroids, the language of each, its rejection floor, and the weights of the n-grams."""

    vectors: np.ndarray
    languages: list[str]
    floors: np.ndarray
    idf: np.ndarray


def _letters() -> np.ndarray:
    """Byte to itself, lower-cased, if it can be part of a letter, else to a blank."""
    table = np.full(256, 32, dtype=np.uint8)
    for b in range(256):
        if b >= 128 or chr(b).isalpha():
            table[b] = ord(chr(b).lower()) if b < 128 else b
    return table


def term_counts(raw: np.ndarray, offsets: np.ndarray, bits: int) -> np.ndarray:
    """Counts of hashed 2-, 3- and 4-byte n-grams of the letters of each text, one row for each."""
    n = len(offsets) - 1
    folded = fold(raw, _letters())
    # runs of blanks become one, so that layout does not count
    keep = np.ones(len(folded), dtype=bool)
    keep[1:] = (folded[1:] != 32) | (folded[:-1] != 32)
    owner = np.repeat(np.arange(n), np.diff(offsets))[keep]
    folded = folded[keep]
    grams = qgrams8(np.concatenate([folded, np.full(7, 32, dtype=np.uint8)]))
    out = np.zeros((n, 1 << bits), dtype=np.float32)
    for size in (2, 3, 4):
        at = np.flatnonzero(owner[: len(owner) - size + 1] == owner[size - 1 :]) if len(owner) >= size else np.zeros(0, dtype=np.int64)
        value = (grams[at] & U64((1 << (8 * size)) - 1)) * U64(BASE) + U64(size)
        slot = ((value * U64(BASE)) >> U64(64 - bits)).astype(np.int64)
        out += np.bincount(owner[at] * (1 << bits) + slot, minlength=n << bits).reshape(n, 1 << bits)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _sampled(batch: pa.RecordBatch, bits: int) -> Iterator[pa.RecordBatch]:
    for at, n, raw, offsets in text_slices(batch.column("text"), most_rows=ROWS_AT_ONCE):
        x = np.minimum(term_counts(raw, offsets, bits), 65535).astype(np.uint16)
        yield pa.RecordBatch.from_arrays([batch.column("lang").slice(at, n), batch.column("rank").slice(at, n), pa.array([row.tobytes() for row in x], type=pa.binary())], names=["lang", "rank", "counts"])


def _frequencies(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """In how many texts of a task each n-gram stands; slot -1 counts the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = np.zeros(1 << bits, dtype=np.int64), 0
        for batch in batches:
            for _, n, raw, offsets in text_slices(batch.column("text"), most_rows=ROWS_AT_ONCE) if batch.num_rows else ():
                held += (term_counts(raw, offsets, bits) > 0).sum(axis=0)
                total += n
        if total:
            some = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(held[some], total))], names=["slot", "n"])

    return run


def weights(texts: DataFrame, bits: int) -> np.ndarray:
    """Inverse document frequencies over all texts, summed on the executors; 2 ** bits + 1 rows come to the driver."""
    got = texts.select("text").mapInArrow(_frequencies(bits), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    held = np.zeros((1 << bits) + 1)
    held[got["slot"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=np.float64)
    return (np.log((1 + held[-1]) / (1 + held[:-1])) + 1).astype(np.float32)


def fit(docs: DataFrame, *, bits: int = 12, each: int = 400, most: int = 4000, clusters: int = 4, rounds: int = 8, reject: float = 0.01) -> Centroids:
    """Cluster about `each` training documents of every language, about `most` in all.

    The n-grams' weights come from all training documents. The sample takes those
    of lowest hash of doc_id and text, one of each language at least, by a rate for
    each language; rows that repeat both count once, and of more than 2 * most rows
    the lowest by hash and language are taken. Beyond `most` languages the
    commonest are learned. Each language's vectors are grouped into `clusters` by
    spherical k-means; a centroid's floor is the cosine that the share `reject` of
    its own sample falls below.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~in_fold("doc_id", 5)).select("lang", "text", F.xxhash64("doc_id", "text", F.lit(23)).alias("rank"))
    spread = F.pmod("rank", F.lit(1 << 30)) / float(1 << 30)
    found = known.groupBy("lang").agg(F.count("*").alias("n"), F.min(spread).alias("low")).orderBy(F.desc("n"), "lang").limit(most).collect()
    nothing = Centroids(np.zeros((0, 1 << bits)), [], np.zeros(0), np.ones(1 << bits))
    if not found:
        return nothing
    share = max(1, min(each, most // len(found)))
    rate = F.create_map(*[F.lit(v) for r in found for v in (r["lang"], max(share / r["n"], r["low"]))])
    rows = known.where(spread <= rate[F.col("lang")]).dropDuplicates(["lang", "rank"]).orderBy("rank", "lang").limit(2 * most)
    got = rows.mapInArrow(each_text(_sampled, bits), "lang string, rank long, counts binary").toPandas().sort_values(["rank", "counts"])
    if not len(got):
        return nothing
    raw = np.stack([np.frombuffer(x, dtype=np.uint16) for x in got["counts"]]).astype(np.float32)
    idf = weights(known, bits)
    x = _unit(np.log1p(raw) * idf)
    vectors, names, floors = [], [], []
    for lang in sorted(set(got["lang"])):
        own = x[(got["lang"] == lang).to_numpy()]
        k = min(clusters, len(own))
        centre = own[np.linspace(0, len(own) - 1, k).astype(int)].copy()
        for _ in range(rounds):
            near = (own @ centre.T).argmax(axis=1)
            centre = np.stack([own[near == c].sum(axis=0) if (near == c).any() else centre[c] for c in range(k)])
            centre = _unit(centre)
        cosine = own @ centre.T
        near = cosine.argmax(axis=1)
        for c in range(k):
            vectors.append(centre[c])
            names.append(lang)
            floors.append(np.quantile(cosine[near == c, c], reject) if (near == c).any() else 0.0)
    return Centroids(np.stack(vectors).astype(np.float32), names, np.array(floors), idf)


def _lettered(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter."""
    ascii_letter = ((raw | 32) >= 97) & ((raw | 32) <= 122)
    found = np.add.reduceat(ascii_letter.astype(np.int64), offsets[:-1]) > 0
    for k in np.flatnonzero(~found):
        found[k] = any(c.isalpha() for c in raw[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace"))
    return found


def _score(batch: pa.RecordBatch, model: Centroids) -> Iterator[pa.RecordBatch]:
    bits = int(np.log2(len(model.idf)))
    for at, n, raw, offsets in text_slices(batch.column("text"), most_rows=ROWS_AT_ONCE):
        found = _lettered(raw, offsets) & bool(model.languages)
        best, score, rejected = np.zeros(n, dtype=np.int64), np.zeros(n), np.ones(n, dtype=bool)
        if model.languages:
            cosine = _unit(np.log1p(term_counts(raw, offsets, bits)) * model.idf) @ model.vectors.T
            best = cosine.argmax(axis=1)
            score = np.where(found, np.clip(cosine[np.arange(n), best].astype(np.float64), 0, 1), 0.0)
            rejected = ~found | (score < model.floors[best])
        names = [model.languages[b] if f else "und" for b, f in zip(best, found)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, n), pa.array(names, type=pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])


def predicted(docs: DataFrame, **parameters) -> DataFrame:
    """Fit on the training rows and predict every text: doc_id, held_out, lang_pred, score, rejected.

    score is the cosine with the nearest centroid; rejected tells that it lies
    below that centroid's floor. lang_pred is `und`, with score 0, for a text that
    is null or has no letter, and for every text if nothing could be learned. Of
    equally near centroids the first wins, languages in alphabetical order. One row
    comes out per row in, so rows that repeat get equal rows, and an empty table
    gives none; other columns are not read, whatever their names.
    """
    model = fit(docs, **parameters)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = texts.mapInArrow(each_text(_score, model), "doc_id long, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", in_fold("doc_id", 5).alias("held_out"), "lang_pred", "score", "rejected")
