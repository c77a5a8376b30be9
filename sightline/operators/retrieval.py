"""Appearance retrieval: top-k search, ranking metrics, bounded galleries, re-ranking."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import Aggregator, MovingAverage
from ..errors import require
from ..functions import vectors
from ..schema import finite_array

#: Rows of a query side that may be sent to every task.
MOST_BROADCAST = 20_000


def small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """df with a broadcast hint if it has at most `most` rows; the count reads at most one more."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def similarities(queries: DataFrame, gallery: DataFrame, *, vector: str = "vector", round_to: int | None = None) -> DataFrame:
    """All (query_id, entry_id) pairs with their cosine; vectors are of unit length.

    The query side is broadcast while it is small, so the gallery stays where it
    lies; beyond that Spark deals both sides into a grid of blocks.
    """
    q = queries.select("query_id", F.col(vector).alias("__q"), *[F.col(c).alias(f"query_{c}") for c in ("identity", "camera_id") if c in queries.columns])
    g = gallery.select("entry_id", F.col(vector).alias("__g"), *[c for c in ("identity", "camera_id", "frame_id") if c in gallery.columns])
    score = vectors.dot(F.col("__q"), F.col("__g"))
    return g.crossJoin(small(q)).withColumn("score", F.round(score, round_to) if round_to is not None else score).drop("__q", "__g")


def excluded_camera(query_camera: str, camera: str) -> Column:
    """Whether a row may answer: its camera differs, or either is unknown."""
    return ~F.coalesce(F.col(query_camera) == F.col(camera), F.lit(False))


def top_k(scored: DataFrame, k: int, *, threshold: float | None = None, exclude_camera: bool = False) -> DataFrame:
    """The k best entries of each query, best first, ties to the lower entry.

    accepted tells whether a query's best reaches the threshold; it is null without
    one and below rank 1. Each task keeps k rows a query before the shuffle.
    """
    require(k >= 1, f"k must be 1 or more, got {k}")
    rows = scored.where(excluded_camera("query_camera_id", "camera_id")) if exclude_camera else scored
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "entry_id"))
    out = rows.withColumn("rank", rank).where(F.col("rank") <= k)
    accepted = F.lit(None).cast("boolean") if threshold is None else F.when(F.col("rank") == 1, F.col("score") >= threshold)
    return out.withColumn("accepted", accepted)


#: Rows of queries and entries of one product.
TILE = (512, 8192)


class _Best:
    """The k best entries of each query so far: scores fall along a row, ties go to the lower entry."""

    def __init__(self, queries: int, k: int) -> None:
        self.scores, self.entries = np.full((queries, k), -np.inf), np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, at: slice, scores: np.ndarray, entries: np.ndarray) -> None:
        k = self.scores.shape[1]
        scores = np.concatenate([self.scores[at], scores], axis=1)
        entries = np.concatenate([self.entries[at], np.broadcast_to(entries, (len(scores), len(entries)))], axis=1)
        if scores.shape[1] > 4 * k:
            # what lies below the k-th best goes before the rest is sorted; equals of it stay
            cut = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
            keep = scores >= cut
            wide = int(keep.sum(axis=1).max())
            first = np.argsort(~keep, axis=1, kind="stable")[:, :wide]
            scores, entries = np.where(np.take_along_axis(keep, first, 1), np.take_along_axis(scores, first, 1), -np.inf), np.take_along_axis(entries, first, 1)
        order = np.lexsort((entries, -scores))[:, :k]
        self.scores[at], self.entries[at] = np.take_along_axis(scores, order, 1), np.take_along_axis(entries, order, 1)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def search(queries: DataFrame, gallery: DataFrame, k: int, *, threshold: float | None = None, exclude_camera: bool = False, vector: str = "vector", round_to: int | None = None, most_bytes: int = 32 << 20) -> DataFrame:
    """top_k of similarities by blocked products: query_id, entry_id, score, rank, accepted.

    Query vectors travel in blocks of most_bytes, one scan of the gallery each;
    a task multiplies them with its entries and keeps k rows a query, so pairs are
    never rows. Vectors are of unit length and one width; rows without one, or
    without an id, are neither asked nor found. Ids are longs.
    """
    require(k >= 1, f"k must be 1 or more, got {k}")
    camera = exclude_camera and "camera_id" in queries.columns and "camera_id" in gallery.columns
    name = F.col("camera_id").cast("string") if camera else F.lit(None).cast("string")
    pick = lambda df, key: df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), name.alias("camera"))
    asked, held = pick(queries, "query_id"), pick(gallery, "entry_id")
    n, width = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = max(1, math.ceil(8 * n * (width or 0) / most_bytes))
    found = None
    for block in range(blocks):
        own = (asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block) if blocks > 1 else asked).toArrow()
        if not own.num_rows:
            continue
        part = held.mapInArrow(_searcher(own, k, round_to, camera), "query_id long, entry_id long, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = asked.sparkSession.createDataFrame([], "query_id long, entry_id long, score double")
    return top_k(found, k, threshold=threshold)


def _searcher(asked: pa.Table, k: int, round_to: int | None, camera: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = asked.column("id").to_numpy(), _matrix(asked.column("v"))
        views = np.array(asked.column("camera").to_pylist(), dtype=object)
        best = _Best(len(ids), k)
        for batch in batches:
            for b in range(0, batch.num_rows, TILE[1]):
                own = batch.slice(b, TILE[1])
                x, entries = _matrix(own.column("v")), own.column("id").to_numpy()
                cameras = np.array(own.column("camera").to_pylist(), dtype=object)
                for a in range(0, len(ids), TILE[0]):
                    at = slice(a, a + TILE[0])
                    scores = q[at] @ x.T
                    scores = scores if round_to is None else np.round(scores, round_to)
                    if camera:
                        same = (views[at][:, None] == cameras[None, :]) & np.array([c is not None for c in cameras])
                        scores = np.where(same.astype(bool), -np.inf, scores)
                    best.add(at, scores, entries)
        row, place = np.nonzero(best.scores > -np.inf)
        if len(row):
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(best.entries[row, place]), pa.array(best.scores[row, place])], names=["query_id", "entry_id", "score"])

    return run


def ranking(scored: DataFrame) -> DataFrame:
    """scored without rows of the query's own identity and camera, with rank, hit and the hits so far."""
    same = F.col("query_identity") == F.col("identity")
    if "query_camera_id" in scored.columns and "camera_id" in scored.columns:
        same_view = F.coalesce(same & (F.col("query_camera_id") == F.col("camera_id")), F.lit(False))
        scored = scored.where(~same_view)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "entry_id")
    out = scored.withColumns({"rank": F.row_number().over(order), "hit": same.cast("int")})
    return out.withColumn("hits", F.sum("hit").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def per_query(scored: DataFrame) -> DataFrame:
    """query_id, first (rank of the first hit) and ap (average precision over the whole ranking) of queries with a match."""
    hits = ranking(scored).where("hit = 1")
    return hits.groupBy("query_id").agg(F.min("rank").alias("first"), F.avg(F.col("hits") / F.col("rank")).alias("ap"))


#: Pairs of a query and an entry that one task ranks, about, and scores it holds at once.
PAIRS_A_TASK, SCORES_AT_ONCE = 16_000_000, 1 << 21


def rank_queries(queries: DataFrame, gallery: DataFrame, *, vector: str = "vector", round_to: int | None = None, most_bytes: int = 128 << 20) -> DataFrame:
    """per_query of similarities by products: pairs are never rows while the gallery's vectors take up to most_bytes.

    The gallery goes to every task, the queries are dealt; each query's scores are
    sorted where they are made. A larger gallery is ranked over pairs as rows, with
    the same result. A missing vector ranks last. Ids are longs, and tell queries apart.
    """
    width = gallery.agg(F.max(F.size(vector))).first()[0] or 1
    n_queries, n_entries = queries.count(), gallery.count()
    if not n_entries:
        return queries.sparkSession.createDataFrame([], "query_id long, first int, ap double")
    if 8 * width * n_entries > most_bytes:
        return per_query(similarities(queries, gallery, vector=vector, round_to=round_to))
    camera = "camera_id" in queries.columns and "camera_id" in gallery.columns
    name = F.col("camera_id").cast("string") if camera else F.lit(None).cast("string")
    none = F.array_repeat(F.lit(0.0), width)

    def pick(df: DataFrame, key: str) -> DataFrame:
        v = F.col(vector).cast("array<double>")
        return df.select(F.col(key).cast("long").alias("id"), F.coalesce(v, none).alias("v"), v.isNull().alias("absent"), F.col("identity").cast("string").alias("identity"), name.alias("camera"))

    held = pick(gallery, "entry_id").toArrow().sort_by("id")
    x = _matrix(held.column("v"))
    slim = x.astype(np.float32)
    x = slim if (slim == x).all() else x
    absent = held.column("absent").to_numpy()
    names, views = (held.column(c).combine_chunks().dictionary_encode() for c in ("identity", "camera"))
    tasks = max(1, min(1024, n_queries * n_entries // PAIRS_A_TASK))
    return pick(queries, "query_id").repartition(tasks, "id").mapInArrow(_ranker(x, absent, names, views, round_to), "query_id long, first int, ap double")


def _codes(column: pa.DictionaryArray) -> tuple[np.ndarray, dict[str, int]]:
    """A number for each row, -1 without a value, and the numbers of the values."""
    return column.indices.fill_null(-1).to_numpy(), {v: k for k, v in enumerate(column.dictionary.to_pylist())}


def _ranker(x: np.ndarray, absent: np.ndarray, names: pa.DictionaryArray, views: pa.DictionaryArray, round_to: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = x.astype(np.float64).T
        (identity, known), (camera, places) = _codes(names), _codes(views)
        rows = max(1, SCORES_AT_ONCE // max(1, len(absent)))
        for batch in batches:
            out: list[tuple[int, int, float]] = []
            for a in range(0, batch.num_rows, rows):
                own = batch.slice(a, rows)
                scores = _matrix(own.column("v")) @ held
                scores = scores if round_to is None else np.round(scores, round_to)
                scores[:, absent] = -np.inf
                for row, q in enumerate(own.select(["id", "absent", "identity", "camera"]).to_pylist()):
                    match = identity == known.get(q["identity"], -2)
                    counts = ~(match & (camera == places.get(q["camera"], -2)))
                    # entries stand in the order of their ids, which breaks ties
                    order = np.arange(len(match)) if q["absent"] else np.argsort(-scores[row], kind="stable")
                    order = order[counts[order]]
                    ranks = np.flatnonzero(match[order]) + 1
                    if len(ranks):
                        out.append((q["id"], int(ranks[0]), float(np.mean(np.arange(1, len(ranks) + 1) / ranks))))
            if out:
                ids, first, ap = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(first, pa.int32()), pa.array(ap, pa.float64())], names=["query_id", "first", "ap"])

    return run


def evaluate_ranking(scored: DataFrame, max_rank: int = 50) -> DataFrame:
    """One row: cmc (share of queries with a hit by rank k), map, evaluated, skipped.

    Queries without a match left are skipped and do not count. The curve ends at
    max_rank or the gallery's size.
    """
    queries = scored.select("query_id").distinct().count()
    length = min(max_rank, scored.select("entry_id").distinct().count())
    return _summed(per_query(scored), queries, length)


def evaluate_search(queries: DataFrame, gallery: DataFrame, max_rank: int = 50, *, vector: str = "vector", round_to: int | None = None) -> DataFrame:
    """evaluate_ranking of the similarities of queries and gallery, by rank_queries."""
    entries = gallery.select("entry_id").distinct().count()
    asked = queries.select("query_id").distinct().count() if entries else 0
    return _summed(rank_queries(queries, gallery, vector=vector, round_to=round_to), asked, min(max_rank, entries))


def _summed(found: DataFrame, queries: int, length: int) -> DataFrame:
    at = [F.avg((F.col("first") <= k).cast("double")) for k in range(1, length + 1)]
    out = found.agg(F.array(*at).alias("cmc"), F.avg("ap").alias("map"), F.count("*").alias("evaluated"))
    return out.withColumn("skipped", F.lit(queries) - F.col("evaluated"))


def rank_at(result: DataFrame, k: int) -> DataFrame:
    """rank-k accuracy, k held to the curve's end."""
    return result.select(F.element_at("cmc", F.least(F.lit(k), F.size("cmc"))).alias(f"rank_{k}"))


def retained(entries: DataFrame, per_identity: int, capacity: int, order: str = "entry_id") -> DataFrame:
    """A bounded gallery: the newest per_identity entries of each identity, then the newest `capacity` in all.

    The global cut is a threshold from a top-k, so no task sorts the whole table.
    """
    newest = Window.partitionBy("identity").orderBy(F.desc(order))
    kept = entries.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= per_identity).drop("__n")
    last = kept.select(F.col(order).alias("__o")).orderBy(F.desc("__o")).limit(capacity).agg(F.min("__o").alias("__cut"))
    return kept.crossJoin(F.broadcast(last)).where(F.col(order) >= F.col("__cut")).drop("__cut")


def without_identity(entries: DataFrame, gone: DataFrame) -> DataFrame:
    """entries of identities that are not in gone."""
    return entries.join(gone.select("identity").distinct(), "identity", "left_anti")


def centroids(entries: DataFrame, *, alpha: float = 0.9, order: str = "entry_id", capacity: int = 10_000) -> DataFrame:
    """One EMA vector an identity, with its count, last camera and last entry; the most recently seen identities stay."""
    from .aggregate import ema

    made = ema(entries, ["identity"], order, alpha=alpha)
    last = entries.groupBy("identity").agg(F.count("*").alias("observations"), F.max(order).alias("last_seen"), F.max_by("camera_id", order).alias("camera_id"))
    out = made.join(last, "identity").withColumn("entry_id", F.col("last_seen"))
    cut = out.select(F.col("last_seen").alias("__o")).orderBy(F.desc("__o")).limit(capacity).agg(F.min("__o").alias("__cut"))
    return out.crossJoin(F.broadcast(cut)).where(F.col("last_seen") >= F.col("__cut")).drop("__cut")


class OnlineCentroids:
    """A bounded gallery of one vector an identity, fed one observation at a time.

    Each identity's vector is folded by an aggregator of its own; a new identity
    beyond the capacity takes the place of the one seen longest ago.
    """

    def __init__(self, capacity: int = 10_000, make: Callable[[], Aggregator] = MovingAverage) -> None:
        require(capacity >= 1, f"capacity must be 1 or more, got {capacity}")
        self.capacity, self.make = capacity, make
        self.clear()

    def clear(self) -> None:
        self.held: dict[str, dict] = {}  # by identity, the one seen longest ago first

    def __len__(self) -> int:
        return len(self.held)

    def add(self, identity: str, vector: np.ndarray, camera_id: str | None = None, *, weight: float = 1.0) -> None:
        """Fold one observation; one that is refused leaves the gallery as it was."""
        require(identity is not None, "an entry needs an identity")
        vector = np.asarray(vector, dtype=float).reshape(-1)
        require(len(vector) > 0 and bool(np.isfinite(vector).all()), "a vector must be finite")
        width = next((len(e["vector"]) for e in self.held.values()), len(vector))
        require(len(vector) == width, f"vectors must have {width} places, got {len(vector)}")
        entry = self.held.get(identity) or {"folder": self.make(), "vector": None, "observations": 0}
        made = entry["folder"].update(entry["vector"], vector / max(float(np.linalg.norm(vector)), 1e-12), weight=weight)
        if identity not in self.held and len(self.held) >= self.capacity:
            del self.held[next(iter(self.held))]
        self.held.pop(identity, None)
        self.held[identity] = {**entry, "vector": made, "observations": entry["observations"] + 1, "camera_id": camera_id}

    def remove_identity(self, identity: str) -> int:
        return int(self.held.pop(identity, None) is not None)

    def observations(self, identity: str) -> int:
        return self.held[identity]["observations"] if identity in self.held else 0

    def query(self, vector: np.ndarray, k: int = 1, *, threshold: float | None = None, exclude_camera: str | None = None) -> list[tuple[str, float]]:
        """The k best (identity, cosine), those last seen by exclude_camera left out, none if the best is below the threshold."""
        require(k >= 1, f"k must be 1 or more, got {k}")
        names = [n for n, e in self.held.items() if exclude_camera is None or e["camera_id"] != exclude_camera]
        if not names:
            return []
        v = np.asarray(vector, dtype=float)
        dots = np.stack([self.held[n]["vector"] for n in names]) @ (v / max(float(np.linalg.norm(v)), 1e-12))
        best = np.argsort(-dots, kind="stable")[:k]
        return [] if threshold is not None and dots[best[0]] < threshold else [(names[b], float(dots[b])) for b in best]


def camera_codes(entries: DataFrame, most: int = 4096) -> DataFrame:
    """(camera_id, code): cameras numbered from 0 by name; more than `most` are refused."""
    names = entries.select("camera_id").distinct()
    require(names.limit(most + 1).count() <= most, f"there are more than {most} cameras")
    return names.coalesce(1).withColumn("code", (F.row_number().over(Window.orderBy("camera_id")) - 1).cast("long"))


def rerank_size(queries: int, gallery: int, k1: int, k2: int, width: int) -> dict[str, int]:
    """About how many bytes each part of rerank takes on all executors together.

    Pairs are the distances, made block by block for neighbours, weights and the
    result and never held as a whole; lists of neighbours and weights are far
    smaller for all but tiny tables.
    """
    n = queries + gallery
    reach = max(k1, k2 - 1) + 1
    return {"vectors": 8 * width * n, "pairs": 48 * n * n, "neighbours": 48 * n * reach, "weights": 48 * n * reach * (1 + k2), "result": 24 * queries * gallery}


def rerank(queries: DataFrame, gallery: DataFrame, *, k1: int = 20, k2: int = 6, lambda_value: float = 0.3, vector: str = "vector", max_entries: int | None = 20_000) -> DataFrame:
    """k-reciprocal re-ranking: (query_id, entry_id, distance), lower is closer.

    Vectors go to every task, which makes the distances of its rows block by block;
    every step keeps only neighbour lists, so the data is rows * k1. Distances are divided by each row's largest; a row's
    neighbours are its first k1 + 1 in both directions, itself included, widened
    by neighbours whose own half-size lists overlap them by more than two thirds;
    their weights exp(-d) are averaged over k2 neighbours, and the Jaccard
    distance of the weights is blended with the plain one.

    All pairs of queries and entries are compared, so more than max_entries of them
    are refused, unless it is None: re-rank a set of candidates from a plain search then. A vector
    that is missing or not finite is refused too, as is a k1 that leaves no entry out.
    """
    require(0 <= lambda_value <= 1, f"lambda_value must be in [0, 1], got {lambda_value}")
    require(k1 >= 1 and k2 >= 1, f"k1 and k2 must be positive, got {k1} and {k2}")
    q = queries.select(F.struct(F.lit(0).alias("side"), F.col("query_id").cast("long").alias("id")).alias("n"), F.col(vector).alias("v"))
    g = gallery.select(F.struct(F.lit(1).alias("side"), F.col("entry_id").cast("long").alias("id")).alias("n"), F.col(vector).alias("v"))
    counted = {r["side"]: r for r in q.unionByName(g).groupBy(F.col("n.side").alias("side")).agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).collect()}
    n_query, n_gallery = (counted[side]["n"] if side in counted else 0 for side in (0, 1))
    total = n_query + n_gallery
    require(total == 0 or k1 < total, f"k1 = {k1} needs more than {total} entries")
    if max_entries is not None and total > max_entries:
        parts = rerank_size(n_query, n_gallery, k1, k2, max(r["width"] or 0 for r in counted.values()))
        told = ", ".join(f"{name} {size / 1e9:.1f} GB" for name, size in parts.items())
        require(False, f"re-ranking {n_query} queries against {n_gallery} entries takes {told}; raise max_entries, or re-rank candidates only")
    spark = queries.sparkSession
    if not total:
        return spark.createDataFrame([], "query_id long, entry_id long, distance double")
    rows = q.unionByName(g).withColumn("v", finite_array(F.when(F.col("v").isNull(), F.raise_error(F.lit("re-ranking needs a vector of every row"))).otherwise(F.col("v")), "vector"))
    held = rows.select("n.side", "n.id", "v").toArrow().sort_by([("side", "ascending"), ("id", "ascending")])
    # equal vectors have one column of the products, so that their distances are equal to the last bit
    known, place = np.unique(_matrix(held.column("v")), axis=0, return_inverse=True)
    far = _Far(known, place.reshape(-1))
    ids = held.column("id").to_numpy()
    tasks = max(1, min(1024, total * total // PAIRS_A_TASK))
    # rows go by their numbers, queries first, in the order of their ids
    # kept, as what follows reads these lists and the weights several times and all distances would be made anew each time
    near = spark.range(0, total, 1, tasks).mapInArrow(_neighbours(far, max(k1, k2 - 1)), "i long, j long, r int").persist()

    def reciprocal(k: int) -> DataFrame:
        own = near.where(F.col("r") <= k)
        back = own.select(F.col("j").alias("i"), F.col("i").alias("j"))
        return own.join(back, ["i", "j"]).groupBy("i").agg(F.collect_set("j").alias("set"))

    full = reciprocal(k1)
    half = reciprocal(round(k1 / 2)).select(F.col("i").alias("c"), F.col("set").alias("half"))
    widened = full.select("i", "set", F.explode("set").alias("c")).join(half, "c")
    joins = widened.where(F.size(F.array_intersect("half", "set")) * 3 > F.size("half") * 2)
    more = joins.groupBy("i").agg(F.array_distinct(F.flatten(F.collect_list("half"))).alias("more"))
    sets = full.join(more, "i", "left").select("i", F.array_union("set", F.coalesce("more", F.array().cast("array<bigint>"))).alias("set"))
    weights = sets.repartition(tasks, "i").mapInArrow(_weights(far), "i long, j long, w double").persist()
    if k2 > 1:
        first = near.where(F.col("r") < k2).select(F.col("i").alias("of"), F.col("j").alias("i"))
        weights = first.join(weights, "i").groupBy(F.col("of").alias("i"), "j").agg((F.sum("w") / k2).alias("w"))
    left = weights.where(F.col("i") < n_query).select(F.col("i").alias("q"), "j", F.col("w").alias("wq"))
    right = weights.where(F.col("i") >= n_query).select(F.col("i").alias("g"), "j", F.col("w").alias("wg"))
    shared = left.join(right, "j").groupBy("q", "g").agg(F.sum(F.least("wq", "wg")).alias("s"))
    # a query's shares travel as one row, and meet its distances where these are made
    shared = shared.groupBy("q").agg(F.collect_list(F.struct("g", "s")).alias("a")).select("q", F.col("a.g").alias("g"), F.col("a.s").alias("s"))
    asked = spark.range(0, n_query, 1, max(1, min(n_query, tasks))).withColumnRenamed("id", "q").join(shared, "q", "left")
    # so few rows that a shuffle by size would leave one task
    return asked.repartition(max(1, min(n_query, tasks)), "q").mapInArrow(_blended(far, ids, n_query, lambda_value), "query_id long, entry_id long, distance double")


class _Far:
    """Distances of rows to all rows, divided by each row's largest; of a row's vector there is one in known, at its place."""

    def __init__(self, known: np.ndarray, place: np.ndarray) -> None:
        self.known, self.place = known, place

    def blocks(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, their distances), a bounded number at a time."""
        step = max(1, SCORES_AT_ONCE // len(self.place))
        for a in range(0, len(rows), step):
            own = rows[a : a + step]
            d = 1 - self.known[self.place[own]] @ self.known.T
            yield own, (d / np.maximum(d.max(axis=1, keepdims=True), 1e-12))[:, self.place]


def _first(row: np.ndarray, k: int) -> np.ndarray:
    """Places of the k lowest values, lowest first, ties to the lower place."""
    if len(row) > 4 * k:
        at = np.flatnonzero(row <= np.partition(row, k - 1)[k - 1])
        return at[np.argsort(row[at], kind="stable")[:k]]
    return np.argsort(row, kind="stable")[:k]


def _neighbours(far: _Far, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(i, j, r) of the `most` + 1 nearest rows of each, ties to the lower."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, d in far.blocks(batch.column(0).to_numpy()):
                first = np.stack([_first(row, most + 1) for row in d])
                rank = np.broadcast_to(np.arange(first.shape[1], dtype=np.int32), first.shape)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, first.shape[1])), pa.array(first.ravel()), pa.array(rank.ravel())], names=["i", "j", "r"])

    return run


def _weights(far: _Far) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """exp(-d) of the rows of each set as shares of their sum, from (i, set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = iter(batch.column("set").to_pylist())
            for own, d in far.blocks(batch.column("i").to_numpy()):
                picked = [np.array(next(sets), dtype=np.int64) for _ in own]
                made = [np.exp(-row[j]) for row, j in zip(d, picked)]
                w = np.concatenate([m / m.sum() for m in made])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, [len(j) for j in picked])), pa.array(np.concatenate(picked)), pa.array(w)], names=["i", "j", "w"])

    return run


def _blended(far: _Far, ids: np.ndarray, n_query: int, lambda_value: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each query's re-ranked distances to all entries, from (q, g, s): the rows of entries it shares weights with, and how much."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = ids[n_query:]
        for batch in batches:
            pairs = zip(batch.column("g").to_pylist(), batch.column("s").to_pylist())
            for own, d in far.blocks(batch.column("q").to_numpy()):
                for q, row in zip(own.tolist(), d) if len(entries) else ():
                    at, shares = next(pairs)
                    s = np.zeros(len(entries))
                    if at is not None:
                        s[np.array(at, dtype=np.int64) - n_query] = shares
                    distance = (1 - s / (2 - s)) * (1 - lambda_value) + row[n_query:] * lambda_value
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(entries), ids[q])), pa.array(entries), pa.array(distance)], names=["query_id", "entry_id", "distance"])

    return run
