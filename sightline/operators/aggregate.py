"""Aggregates over vectors: weighted means and moving averages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import require
from ..functions import vectors
from ..plans.grouping import changes


def mean(df: DataFrame, keys: list[str], *, vector: str = "vector", weight: str | None = None) -> DataFrame:
    """The normalised weighted sum of each key's vectors: keys and vector.

    Sums are taken place by place with map-side partial aggregation. Weights must
    not be negative, and one of a key must be above 0.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    w = F.when(w < 0, F.raise_error(F.lit("weights must not be negative"))).otherwise(w)
    spread = df.withColumn("__w", w).select(*keys, "__w", F.posexplode(vector).alias("__p", "__x"))
    sums = spread.groupBy(*keys, "__p").agg(F.sum(F.col("__w") * F.col("__x").cast("double")).alias("__s"), F.sum("__w").alias("__t"))
    total = F.when(F.max("__t") <= 0, F.raise_error(F.lit("one weight must be above 0"))).otherwise(F.array_sort(F.collect_list(F.struct("__p", "__s"))))
    packed = sums.groupBy(*keys).agg(total.alias("__a"))
    return packed.select(*keys, vectors.normalised(F.transform("__a", lambda x: x["__s"])).alias("vector"))


def ema(df: DataFrame, keys: list[str], order: str, *, alpha: float = 0.9, vector: str = "vector", weight: str | None = None) -> DataFrame:
    """Each key's vectors folded oldest first: v <- unit(e * v + (1 - e) * x) with e = 1 - (1 - alpha) * weight.

    The order matters, so a key's vectors are dealt to one task, sorted, and folded
    as they come: the task holds one vector, however many the key has. Ties of
    `order` go by the vector.
    """
    require(0 <= alpha <= 1, f"alpha must be in [0, 1], got {alpha}")
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    w = F.when((w < 0) | (w > 1), F.raise_error(F.lit("weights must lie in [0, 1]"))).otherwise(w)
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")))
    v = F.when(bad, F.raise_error(F.lit("cannot normalise a vector with NaN"))).otherwise(F.col(vector).cast("array<double>"))
    rows = df.select(*keys, F.col(order).alias("__o"), v.alias("__v"), w.alias("__w"))
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "vector array<double>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for batch in batches:
            if not len(batch):
                continue
            done = []
            starts = set(changes(batch, keys).tolist())
            vectors_, weights = batch["__v"].tolist(), batch["__w"].to_numpy()
            for r in range(len(batch)):
                if r in starts:
                    now = tuple(None if pd.isna(batch[k].iat[r]) else batch[k].iat[r] for k in keys)
                    if state is not None and now != last:
                        done.append((*last, state))
                        state = None
                    last = now
                x = np.asarray(vectors_[r])
                keep = 1 - (1 - alpha) * weights[r]
                mean = x if state is None else keep * state + (1 - keep) * x
                state = mean / max(float(np.sqrt(mean @ mean)), 1e-12)
            if done:
                yield pd.DataFrame(done, columns=[*keys, "vector"])
        if state is not None:
            yield pd.DataFrame([(*last, state)], columns=[*keys, "vector"])

    return rows.repartition(*keys).sortWithinPartitions(*keys, "__o", "__v").mapInPandas(run, schema)
