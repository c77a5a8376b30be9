"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets decide."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import Bloom, Forest, Recent, by_block, components, each_text, grouped, written
from .textkit import BASE, MIX_1, MIX_2, U64, as_long, mix64, ragged, shingles_of, sums_by_text, text_slices, word_table, words_of


def choose_bands(threshold: float, recall: float, most: int) -> tuple[int, int]:
    """(bands, rows): the most rows whose needed bands stay within `most` hashes.

    With r rows a pair of similarity s shares one band with probability s**r, so
    ceil(log(1 - recall) / log(1 - threshold**r)) bands reach the recall.
    """
    best = (math.ceil(math.log(1 - recall) / math.log(1 - threshold)), 1)
    for rows in range(2, 33):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def _band_keys(shingles: np.ndarray, begins: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The hash of each band of each text's MinHash signature; texts without shingles get zeros."""
    full = np.flatnonzero(np.diff(begins) > 0)
    out = np.zeros((len(begins) - 1, bands), dtype=U64)
    if not len(full):
        return out
    low = (shingles ^ (shingles >> U64(32))).astype(np.uint32)
    odd = (mix64(np.arange(1, bands * rows + 1, dtype=U64)) | U64(1)).astype(np.uint32)
    add = mix64(np.arange(10_000, 10_000 + bands * rows, dtype=U64)).astype(np.uint32)
    work = np.empty_like(low)
    at = begins[full]
    for b in range(bands):
        key = np.full(len(full), b + 1, dtype=U64)
        for r in range(rows):
            k = b * rows + r
            np.multiply(low, odd[k], out=work)
            work ^= add[k]
            work ^= work >> np.uint32(15)
            key = mix64(key * U64(BASE) + np.minimum.reduceat(work, at).astype(U64))
        out[full, b] = key
    return out


def _contents(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each text's sequence of words."""
    place = np.arange(len(words), dtype=U64) - np.repeat(first[:-1], np.diff(first)).astype(U64)
    made = []
    for seed in (MIX_1, MIX_2):
        made.append(mix64(sums_by_text(mix64(words ^ (place * U64(seed) + U64(seed))), first) + np.diff(first).astype(U64)))
    return made[0], made[1]


def _sketch(size: int, bands: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each text's hashes, and its band keys where the task has not given them lately for a text of the same words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, recent = word_table(), Recent()
        for batch in batches:
            for at, n, raw, offsets in text_slices(batch.column("text")) if batch.num_rows else ():
                _, _, _, words, first = words_of(raw, offsets, table)
                shingles, begins = shingles_of(words, first, size)
                h1, h2 = _contents(words, first)
                keys = _band_keys(shingles, begins, bands, rows)
                some = np.zeros(n, dtype=bool)
                some[recent.fresh(h1)] = True
                some &= np.diff(first) > 0
                lists = ragged(keys[some].view(np.int64).ravel(), np.concatenate([[0], np.cumsum(some * bands)]), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, n), batch.column("row_key").slice(at, n), as_long(h1), as_long(h2), pa.array(np.diff(first)), lists],
                    names=["doc_id", "row_key", "h1", "h2", "n_words", "bands"],
                )

    return run


def _sets(batch: pa.RecordBatch, size: int, wanted: Bloom) -> Iterator[pa.RecordBatch]:
    """The sorted distinct shingles of the texts that may be wanted."""
    table = word_table()
    for at, _, raw, offsets in text_slices(batch.column("text")):
        _, _, _, words, first = words_of(raw, offsets, table)
        shingles, begins = shingles_of(words, first, size)
        h1, _ = _contents(words, first)
        picked = np.flatnonzero(wanted.has(h1) & (np.diff(first) > 0))
        if len(picked):
            sets = [np.unique(shingles[begins[k] : begins[k + 1]]) for k in picked]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(picked + at)), as_long(h1[picked]), pa.array([len(s) for s in sets], type=pa.int64()), pa.array([s.tobytes() for s in sets], type=pa.binary())],
                names=["doc_id", "node", "n_shingles", "shingles"],
            )


COLUMNS_AT_ONCE = 4096
ROWS_IN_BLOCK = 512


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many members each left set has in common with each right set."""
    rows = np.concatenate([left, right]) if left is not right else left
    owner = np.repeat(np.arange(len(rows)), [len(sets[k]) for k in rows])
    member = np.concatenate([sets[k] for k in rows])
    order = np.argsort(member, kind="stable")
    member, owner = member[order], owner[order]
    new = np.ones(len(member), dtype=bool)
    new[1:] = member[1:] != member[:-1]
    column = np.cumsum(new) - 1
    held = np.bincount(column) > 1
    rank = np.cumsum(held) - 1
    keep = held[column]
    column, owner = rank[column[keep]], owner[keep]
    split = len(left)
    out = np.zeros((split, len(right)), dtype=np.float64)
    for c in range(0, int(rank[-1]) + 1 if len(rank) else 0, COLUMNS_AT_ONCE):
        a, b = np.searchsorted(column, (c, c + COLUMNS_AT_ONCE))
        dense = np.zeros((len(rows), COLUMNS_AT_ONCE), dtype=np.float32)
        dense[owner[a:b], column[a:b] - c] = 1
        out += dense[:split] @ (dense if left is right else dense[split:]).T
    return out


def _verify(group: pa.Table, threshold: float) -> Iterator[pa.RecordBatch]:
    """Links of one pair of blocks: for each class its linked rows and classes, and a forest."""
    group = group.combine_chunks()
    n = group.num_rows
    if n < 2:
        return
    node = group.column("node").to_numpy()
    copies = group.column("copies").to_numpy()
    part = group.column("part").to_numpy()
    same = group.column("lo")[0].as_py() == group.column("hi")[0].as_py()
    sets = [np.frombuffer(x.as_buffer(), dtype=U64) for x in group.column("shingles").combine_chunks()]
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    lo = np.arange(n) if same else np.flatnonzero(part == group.column("lo")[0].as_py())
    hi = lo if same else np.flatnonzero(part == group.column("hi")[0].as_py())
    if not len(lo) or not len(hi):
        return
    common = _shared(sets, lo, hi)
    linked = common >= threshold * (sizes[lo][:, None] + sizes[hi][None, :] - common) - 1e-9
    if same:
        np.fill_diagonal(linked, False)
    rows_linked, classes_linked = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    rows_linked[lo] += linked @ copies[hi]
    classes_linked[lo] += linked.sum(axis=1)
    if not same:
        rows_linked[hi] += linked.T @ copies[lo]
        classes_linked[hi] += linked.sum(axis=0)
    forest = Forest(n)
    for i in range(len(lo)):
        for j in np.flatnonzero(linked[i]):
            forest.join(int(lo[i]), int(hi[j]))
    up = np.array([forest.root(k) for k in range(n)])
    some = np.flatnonzero(rows_linked)
    if len(some):
        yield pa.RecordBatch.from_arrays(
            [pa.array(node[some]), pa.array(node[up[some]]), pa.array(rows_linked[some]), pa.array(classes_linked[some])],
            names=["node", "up", "rows_linked", "classes_linked"],
        )


def ngram_groups(docs: DataFrame, *, size: int = 5, threshold: float = 0.8, recall: float = 0.99, most_hashes: int = 160, block: int = 400_000) -> DataFrame:
    """Group documents whose word n-gram sets have a Jaccard similarity of threshold or more.

    Words are maximal runs of ASCII letters and digits and non-ASCII characters,
    lower-cased; a text of fewer words than `size` has one n-gram of all of them,
    and one without words is linked with nothing. Equal word sequences are one
    class; classes that share a MinHash band are compared on their full n-gram
    sets, inside blocks of about `block` n-grams, together with all else that is
    connected with them through bands. The bands reach `recall` at the threshold.

    Returns one row for each distinct (doc_id, text): doc_id, row_key (xxhash64 of
    the text), copy_id (smallest doc_id of the class), n_copies, n_links (other
    documents linked directly, copies included), class_id (smallest doc_id of the
    connected group) and n_words. A null text counts as empty; rows that repeat a
    doc_id and its text are one document; a null doc_id is a document of its own
    text; other columns are not read, whatever their names; an empty table gives an
    empty result. The smallest doc_id is the representative, so there are no ties.
    """
    spark = docs.sparkSession
    bands, rows = choose_bands(threshold, recall, most_hashes)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = texts.select("doc_id", F.xxhash64("text").alias("row_key"), "text")
    schema = "doc_id long, row_key long, h1 long, h2 long, n_words long, bands array<long>"
    sketched = written(keyed.mapInArrow(_sketch(size, bands, rows), schema))
    owners = sketched.select("doc_id", "row_key", "h1", "h2", "n_words").dropDuplicates(["doc_id", "row_key"])
    classes = owners.where("n_words > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("copy_id"), F.count("*").alias("n_copies"))
    classes = written(classes)

    band = sketched.select(F.col("h1").alias("node"), F.explode("bands").alias("key"))
    met = band.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    stars = band.join(met.select("key", "low"), "key").where("node <> low")
    candidates = components(stars.select(F.col("node").alias("a"), F.col("low").alias("b")), spark)
    candidates = written(candidates.join(classes.select(F.col("h1").alias("node"), "copy_id", F.col("n_copies").alias("copies")), "node"))

    wanted = Bloom.of(candidates, "node")
    sets = texts.mapInArrow(each_text(_sets, size, wanted), "doc_id long, node long, n_shingles long, shingles binary")
    # one copy of each class is compared; joined on both keys, so that a class of many copies is dealt out
    sets = sets.withColumnRenamed("node", "h").join(candidates, (F.col("h") == F.col("node")) & F.col("doc_id").eqNullSafe(F.col("copy_id"))).dropDuplicates(["node", "doc_id"])
    sets = written(sets.select("node", "root", "copies", "n_shingles", "shingles"))
    weight = F.greatest("n_shingles", F.lit(block // ROWS_IN_BLOCK))
    dealt = by_block(sets, "root", F.col("node"), weight, block)

    def verify(group: pa.Table) -> Iterator[pa.RecordBatch]:
        yield from _verify(group, threshold)

    found = written(grouped(dealt, ["root", "lo", "hi"], verify, "node long, up long, rows_linked long, classes_linked long"))
    links = found.groupBy("node").agg(F.sum("rows_linked").alias("rows_linked"), F.sum("classes_linked").alias("classes_linked"))
    groups = components(found.select(F.col("node").alias("a"), F.col("up").alias("b")), spark)

    placed = classes.withColumnRenamed("h1", "node").join(links, "node", "left").join(groups, "node", "left")
    placed = placed.withColumn("root", F.coalesce("root", "node"))
    named = placed.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    placed = placed.join(named, "root").select(F.col("node").alias("h1"), "h2", "copy_id", "n_copies", "class_id", F.coalesce("rows_linked", F.lit(0)).alias("rows_linked"))
    # texts without words are all alike, and stay out of the join
    out = owners.where("n_words > 0").join(placed, ["h1", "h2"], "left").unionByName(owners.where("n_words = 0"), allowMissingColumns=True)
    return out.select(
        "doc_id",
        "row_key",
        F.coalesce("copy_id", "doc_id").alias("copy_id"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
        (F.coalesce("n_copies", F.lit(1)) - 1 + F.coalesce("rows_linked", F.lit(0))).alias("n_links"),
        F.coalesce("class_id", "doc_id").alias("class_id"),
        "n_words",
    )


def deduplicate(docs: DataFrame, **parameters) -> DataFrame:
    """docs without all but one document of each group of ngram_groups.

    The smallest doc_id of a group stays, once. Documents without words, null and
    empty texts among them, all stay, rows that repeat doc_id and text once. Names
    that begin with __sl_ are taken.
    """
    found = ngram_groups(docs, **parameters)
    first = found.withColumn("keep", (F.col("doc_id") == F.col("class_id")) | F.col("class_id").isNull() | (F.col("n_words") == 0))
    # of texts that share the kept doc_id, the group keeps one
    once = first.where("keep").groupBy("class_id", "doc_id", F.when((F.col("n_words") == 0) | F.col("class_id").isNull(), F.col("row_key")).alias("bare")).agg(F.min("row_key").alias("row_key"))
    chosen = once.select(F.col("doc_id").alias("__sl_doc"), F.col("row_key").alias("__sl_key"))
    keyed = docs.withColumn("__sl_own", F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = keyed.join(chosen, keyed["doc_id"].eqNullSafe(chosen["__sl_doc"]) & (F.col("__sl_own") == F.col("__sl_key")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__sl_own"]).drop("__sl_own")
