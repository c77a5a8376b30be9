"""Embedding near-duplicates: spherical k-means cells, blocked cosine products within them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import by_block, components, each_text, grouped, smallest_roots, written

#: What rounding may add to a distance; pairs are compared again in double precision.
SLACK = 1e-6
#: Rows and columns of one product.
TILE = (512, 4096)


def _vectors(column: pa.Array) -> np.ndarray:
    """Unit vectors in double precision of a list column whose lists are of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """k unit centroids of unit vectors, started from rows spread over the input."""
    centre = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = (x @ centre.T).argmax(axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centre = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centre)
    return centre


def _cells(batch: pa.RecordBatch, centroids: dict, reach: float) -> Iterator[pa.RecordBatch]:
    """Each vector in its home cell, and in each cell where a vector within reach of it may be at home.

    A vector within distance reach of x is nearer to centroid B than to x's own A
    only if x lies within reach of the plane between them, that is
    x.(A - B) <= reach * |A - B|.
    """
    group = batch.column("grp").to_numpy(zero_copy_only=False)
    for g in np.unique(group):
        rows = np.flatnonzero(group == g)
        own = batch.take(pa.array(rows))
        centre = centroids.get(int(g))
        at, cell, home = np.arange(len(rows)), np.zeros(len(rows), dtype=np.int32), np.ones(len(rows), dtype=bool)
        if centre is not None:
            dots = _vectors(own.column("embedding")) @ centre.T
            best = dots.argmax(axis=1)
            apart = np.linalg.norm(centre[:, None, :] - centre[None, :, :], axis=2)
            near = dots[np.arange(len(rows)), best][:, None] - dots <= reach * apart[best] + SLACK
            near[np.arange(len(rows)), best] = True
            at, cell = np.nonzero(near)
            home = cell == best[at]
        picked = own.take(pa.array(at))
        yield pa.RecordBatch.from_arrays(
            [picked.column("grp"), pa.array(cell.astype(np.int32)), pa.array(home), picked.column("node"), picked.column("copies"), picked.column("embedding")],
            names=["grp", "cell", "home", "node", "copies", "embedding"],
        )


def _compare(table: pa.Table, threshold: float) -> Iterator[pa.RecordBatch]:
    """Links of one pair of blocks of a cell; a pair counts where its smaller node is at home."""
    if table.num_rows < 2:
        return
    table = table.combine_chunks()
    node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
    home, part = table.column("home").to_numpy(), table.column("part").to_numpy()
    low, high = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
    x = _vectors(table.column("embedding").combine_chunks())
    left = np.flatnonzero(part == low)
    right = left if low == high else np.flatnonzero(part == high)
    met = np.zeros(len(node), dtype=np.int64)
    label = np.arange(len(node))
    for i in range(0, len(left), TILE[0]):
        for j in range(i // TILE[1] * TILE[1] if low == high else 0, len(right), TILE[1]):
            rows, columns = left[i : i + TILE[0]], right[j : j + TILE[1]]
            linked = x[rows] @ x[columns].T >= threshold
            if not linked.any():
                continue
            smaller = node[rows][:, None] < node[columns][None, :]
            linked &= np.where(smaller, home[rows][:, None], home[columns][None, :]) & (node[rows][:, None] != node[columns][None, :])
            if low == high:
                linked &= rows[:, None] < columns[None, :]
            met[rows] += linked @ copies[columns]
            met[columns] += linked.T @ copies[rows]
            a, b = np.nonzero(linked & (label[rows][:, None] != label[columns][None, :]))
            if len(a):
                label = smallest_roots(len(label), label[rows[a]], label[columns[b]])[label]
    some = np.flatnonzero(met)
    if len(some):
        yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[label[some]]), pa.array(met[some])], names=["node", "up", "met"])


def near_vectors(vectors: DataFrame, *, threshold: float = 0.98, target: int = 2000, most_cells: int = 4096, sample: int = 64, block: int = 16 << 20, most_bytes: int = 64 << 20) -> DataFrame:
    """Link vectors of equal label whose cosine is threshold or more.

    Equal vectors are one class. Each label with more than `target` classes is
    cut into cells by spherical k-means, fitted on about `sample` vectors a cell
    and at most `most_cells` cells in all; the sample and the centroids, which are
    broadcast, take at most `most_bytes` each, with fewer cells for long vectors.
    Vectors near a border are also compared in the cells beyond it, which loses no
    link. A cell is compared whole up to `block` bytes of double precision, beyond
    that in pairs of blocks, and its products are taken tile by tile.

    Returns vec_id, n_links, component_id (smallest linked vec_id) and kept, one
    row per row. Components are floats or doubles, compared as doubles; other
    numbers are cast to double. A vector that is null, empty, zero or has a null or
    non-finite component, and one without label, links with nothing; vectors of
    different lengths do not link; repeated rows count as separate vectors; a pair
    at the threshold links; an empty table gives no rows; other columns are not
    read, whatever their names.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["embedding"].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    vectors = vectors.select("vec_id", "label", F.col("embedding").cast(kind).alias("embedding"))
    e = F.col("embedding")
    size = F.aggregate(e, F.lit(0.0).cast("double"), lambda a, v: a + v.cast("double") * v.cast("double"))
    sound = F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0)
    sound = sound & ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & (size > 0) & (size < float("inf"))
    rows = vectors.select("vec_id", "label", F.col("embedding"))
    rows = rows.withColumn("node", F.when(F.coalesce(sound, F.lit(False)), F.xxhash64("label", "embedding")))
    classes = rows.where("node IS NOT NULL").groupBy("node").agg(
        F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.any_value("label").alias("label"), F.any_value("embedding").alias("embedding")
    )
    classes = written(classes.withColumn("grp", F.xxhash64("label", F.size("embedding"))))

    # groups above target: fewer than classes / target of them; their cells share most_cells
    total, longest = classes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    most_cells = max(1, min(most_cells, most_bytes // (8 * (longest or 1))))
    cell_size = max(target, math.ceil(2 * total / most_cells))
    sample = min(sample, max(1, most_bytes // (8 * (longest or 1) * most_cells)))
    large = {r["grp"]: r["n"] for r in classes.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > cell_size).collect()}
    centroids: dict[int, np.ndarray] = {}
    if large:
        rate = F.create_map(*[F.lit(v) for g, n in large.items() for v in (g, min(1.0, sample * math.ceil(n / cell_size) / n))])
        spread = F.pmod(F.xxhash64("node", F.lit(29)), F.lit(1 << 30)) / float(1 << 30)
        picked = classes.where(spread < rate[F.col("grp")]).select("grp", "node", "embedding").toArrow().sort_by("node")
        owner = picked.column("grp").to_numpy()
        for g, n in large.items():
            own = picked.filter(pa.array(owner == g))
            if own.num_rows:
                x = _vectors(own.column("embedding").combine_chunks())
                centroids[int(g)] = spherical_kmeans(x, min(len(x), math.ceil(n / cell_size)))
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))
    schema = f"grp long, cell int, home boolean, node long, copies long, embedding {kind}"
    placed = classes.select("grp", "node", "copies", "embedding").mapInArrow(each_text(_cells, centroids, reach), schema)
    placed = placed.withColumn("at", F.xxhash64("grp", "cell"))
    dealt = by_block(placed, "at", F.col("node"), 8 * F.size("embedding"), block)

    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        yield from _compare(table, threshold)

    found = written(grouped(dealt, ["at", "lo", "hi"], compare, "node long, up long, met long"))
    links = found.groupBy("node").agg(F.sum("met").alias("met"))
    groups = components(found.select(F.col("node").alias("a"), F.col("up").alias("b")), spark)
    named = classes.select("node", "first", "copies").join(links, "node", "left").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = named.join(named.groupBy("root").agg(F.min("first").alias("component_id")), "root")
    out = rows.select("vec_id", "node").join(named.select("node", "copies", "met", "component_id"), "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("met", F.lit(0))).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
