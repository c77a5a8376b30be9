"""What several operators share: shared folders, splits of hot groups, connected groups.

Everything here is linear in its input: a group is cut into blocks of bounded
size, pairs of blocks are compared where their rows meet, and what comes out are
counts and forests of links, never all pairs.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; one of our own only where none is set and all runs on this machine."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = context._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="sightline-"))
            held = context._jsc.sc().getCheckpointDir()
        found = held.get()
    return found.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/sightline-{spark.sparkContext.applicationId}"


def _path(spark: SparkSession, path: str) -> tuple:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: its lineage is cut, and any executor can read it.

    The files go with forget(), or when the session's file system handle closes.
    """
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    system, place = _path(spark, path)
    system.deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Delete all that written() has left in this session; results that still read it must have been written elsewhere."""
    system, place = _path(spark, _own_folder(spark))
    system.delete(place, True)


def each_text(fn: Callable, *fixed) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow over batches: fn(batch, *fixed) yields batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch, *fixed)

    return run


def by_block(df: DataFrame, key: str, unit: Column, weight: Column, limit: int, unlike: str | None = None, count: str | None = None) -> DataFrame:
    """Deal the rows of each key into pairs of blocks of about limit in weight.

    Adds lo, hi and part. Rows of one (key, lo, hi) meet; where lo = hi all of
    them are of that block, else part tells the block. A key below the limit has
    the one pair (0, 0); a heavier one has n blocks and each of its rows n copies.
    With `unlike`, rows of keys that have one value of that column alone go; with
    `count`, a column of that name tells n.
    """
    if unlike:
        # one window, so that the rows are made, dealt and sorted once
        own = Window.partitionBy(key)
        dealt = df.withColumns({"__w": F.sum(weight).over(own), "__a": F.min(unlike).over(own), "__b": F.max(unlike).over(own)}).where("__a <> __b")
        dealt = dealt.withColumn("__n", F.ceil(F.col("__w") / limit).cast("int")).drop("__w", "__a", "__b")
    else:
        heavy = df.groupBy(key).agg(F.sum(weight).alias("__w")).where(F.col("__w") > limit)
        heavy = heavy.select(key, F.ceil(F.col("__w") / limit).cast("int").alias("__n"))
        dealt = df.join(heavy, key, "left").withColumn("__n", F.coalesce("__n", F.lit(1)))
    dealt = dealt.withColumn("part", F.when(F.col("__n") == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64(unit), F.col("__n")).cast("int")))
    dealt = dealt.withColumn("__j", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    dealt = dealt.withColumns({"lo": F.least("part", "__j"), "hi": F.greatest("part", "__j")}).drop("__j")
    return dealt.withColumnRenamed("__n", count) if count else dealt.drop("__n")


def grouped(df: DataFrame, keys: list[str], fn: Callable, schema: str, *fixed) -> DataFrame:
    """fn over the rows of each key, group after group in one pass over sorted partitions.

    fn takes a group and yields batches. With `fixed`, fn(*fixed) is called once a
    task and gives (take, end): take gets each group and end is called last, so
    small groups can be gathered. by_block bounds the size of a group.
    """
    out = df.repartition(*keys).sortWithinPartitions(*keys)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take, end = fn(*fixed) if fixed else (fn, lambda: ())
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            change = np.zeros(batch.num_rows, dtype=bool)
            for c in codes:
                change[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                now = tuple(c[a] for c in codes)
                if held and now != last:
                    yield from take(pa.Table.from_batches(held))
                    held = []
                last = now
                held.append(batch.slice(a, b - a))
        if held:
            yield from take(pa.Table.from_batches(held))
        yield from end()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[pa.RecordBatch] = []
        for batch in each(batches):
            made.append(batch)
            if len(made) >= 512 or batch.num_rows >= 4096:
                yield from pa.Table.from_batches(made).combine_chunks().to_batches()
                made = []
        if made:
            yield from pa.Table.from_batches(made).combine_chunks().to_batches()

    return out.mapInArrow(run, schema)


class Forest:
    """Union-find over 0..n-1; join tells whether two trees became one."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


#: Links that one task takes whole; it holds two numbers for each.
MOST_ALONE = 1_000_000


def smallest_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest row connected with each of n rows, by repeated minima."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        was = root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if (root == was).all():
            return root


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if b.num_rows]
    if held:
        nodes, at = np.unique(np.concatenate(held, axis=1), return_inverse=True)
        at = at.reshape(2, -1)
        root = nodes[smallest_roots(len(nodes), at[0], at[1])]
        for k in range(0, len(nodes), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[k : k + 100_000]), pa.array(root[k : k + 100_000])], names=["node", "root"])


def components(links: DataFrame, spark: SparkSession, most_alone: int = MOST_ALONE) -> DataFrame:
    """(node, root) for every node of links(a, b), root the smallest node of its group.

    Up to most_alone links, by their count, one task joins them. Beyond, the
    large-star and small-star steps of Kiveris et al. (2014) alternate until the
    links stand still; each round is written to the shared folder. Both give the
    same rows.
    """
    now = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    if now.count() <= most_alone:
        return now.coalesce(1).mapInArrow(_alone, "node long, root long")
    was = None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v"))).first()
        if tuple(mark) == was:
            break
        was = tuple(mark)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


class Recent:
    """Which hashes a task has met lately: a table of fixed size, which forgets and never invents."""

    def __init__(self, bits: int = 16) -> None:
        self.slots = np.zeros(1 << bits, dtype=np.uint64)
        self.shift = np.uint64(64 - bits)

    def fresh(self, hashes: np.ndarray) -> np.ndarray:
        """Rows whose hash is the first of its kind here and not in the table, which then holds it."""
        _, once = np.unique(hashes, return_index=True)
        slot = (hashes[once] >> self.shift).astype(np.int64)
        once = once[self.slots[slot] != hashes[once]]
        self.slots[(hashes[once] >> self.shift).astype(np.int64)] = hashes[once]
        return np.sort(once)


#: Words of a piece of a bit table as a power of two (64 kB), and tasks that make pieces.
PIECE_BITS, PIECE_TASKS = 13, 32


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(piece, words) of the bits at p; a task holds its own pieces of the table."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        at = batch.column("p").to_numpy()
        for piece in np.unique(at >> 6 + PIECE_BITS).tolist():
            own = at[at >> 6 + PIECE_BITS == piece]
            words = held.setdefault(piece, np.zeros(1 << PIECE_BITS, dtype=np.uint64))
            np.bitwise_or.at(words, own >> 6 & (1 << PIECE_BITS) - 1, np.uint64(1) << (own & 63).astype(np.uint64))
    for piece, words in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([piece]), pa.array([words.tobytes()], type=pa.binary())], names=["piece", "words"])


class Bloom:
    """A set of well-mixed longs as a bit table: no member is missed, few others pass."""

    def __init__(self, words: np.ndarray, bits: int) -> None:
        self.words, self.bits = words, bits

    @classmethod
    def of(cls, df: DataFrame, column: str, least_bits: int = 23, most_bits: int = 28) -> Bloom:
        """Or the bits of all rows together on the executors; the table comes back in pieces, 2**(bits - 3) bytes in all.

        The table has about 16 bits a row, from 2**least_bits up to 2**most_bits (32
        MB); with far more rows than that it lets most pass, which costs time and
        changes no result.
        """
        bits = min(most_bits, max(least_bits, (16 * df.count()).bit_length()))
        mask = (1 << bits) - 1
        at = [F.col(column).bitwiseAND(F.lit(mask)), F.shiftrightunsigned(column, 64 - bits)]
        rows = df.select(F.explode(F.array(*at)).alias("p"))
        dealt = rows.repartition(PIECE_TASKS, F.shiftright("p", 6 + PIECE_BITS))
        words = np.zeros(1 << (bits - 6), dtype=np.uint64)
        # never as rows of Python: a word would take a hundred times its size
        for batch in dealt.mapInArrow(_pieces, "piece long, words binary").toArrow().to_batches():
            for piece, held in zip(batch.column("piece").to_pylist(), batch.column("words")):
                words[piece << PIECE_BITS : piece + 1 << PIECE_BITS] = np.frombuffer(held.as_buffer(), dtype=np.uint64)
        return cls(words, bits)

    def has(self, x: np.ndarray) -> np.ndarray:
        """Whether each of the hashes may be a member."""
        x = x.astype(np.uint64, copy=False)
        found = np.ones(len(x), dtype=bool)
        for at in (x & np.uint64((1 << self.bits) - 1), x >> np.uint64(64 - self.bits)):
            found &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0
        return found
