"""Grouped maps and folds over sorted partitions: cheaper than one call per group, and one group is held at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def changes(batch: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Rows that begin a key; nulls of a key are one."""
    change = np.zeros(len(batch), dtype=bool)
    change[:1] = True
    for k in keys:
        v, none = batch[k].to_numpy(), batch[k].isna().to_numpy()
        change[1:] |= (v[1:] != v[:-1]) & ~(none[1:] & none[:-1])
    return np.flatnonzero(change)


def chunks(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches of whole keys, and where each key's rows begin and the last one's end, from batches sorted by key."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        # the last key so far may go on
        joint = pd.concat([held[-1].iloc[-1:], batch]) if held else batch
        begins = changes(joint, keys) - (1 if held else 0)
        last = int(begins[-1])
        if held and last < 0 or not held and last == 0:
            held.append(batch)
            continue
        held.append(batch.iloc[:last])
        whole = _joined([h for h in held if len(h)])
        yield whole, np.append(changes(whole, keys), len(whole))
        held = [batch.iloc[last:]]
    if held:
        whole = _joined(held)
        yield whole, np.append(changes(whole, keys), len(whole))


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of each key in turn, from batches sorted by key."""
    for whole, cuts in chunks(batches, keys):
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield whole if len(cuts) == 2 else whole.iloc[a:b].reset_index(drop=True)


def _joined(parts: list[pd.DataFrame]) -> pd.DataFrame:
    return (parts[0] if len(parts) == 1 else pd.concat(parts)).reset_index(drop=True)


#: Rows gathered before they are handed back.
ROWS_AT_ONCE = 4096


def _together(made: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    size = 0
    for part in made:
        if len(part):
            held.append(part)
            size += len(part)
        if size >= ROWS_AT_ONCE:
            yield _joined(held)
            held, size = [], 0
    if held:
        yield _joined(held)


def grouped_map(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """fn over the rows of each key in turn; rows are dealt by key and sorted, and one group is held at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _together(fn(rows) for rows in runs(batches, keys))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def chunked_map(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """fn over batches of whole keys and their cuts, for work that numpy can do on many small groups at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _together(fn(whole, cuts) for whole, cuts in chunks(batches, keys))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def arrow_chunks(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """chunks() of Arrow batches: columns stay as they came."""
    held: list[pa.Table] = []
    cuts: list[int] = []  # where keys begin in what is held
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        joint = pa.concat_tables([held[-1].slice(held[-1].num_rows - 1), table]) if held else table
        begins = changes(joint.select(keys).to_pandas(), keys)
        begins = begins[1:] - 1 if held else begins
        cuts += (begins + size).tolist()
        held.append(table)
        size += table.num_rows
        if len(cuts) > 1:
            whole = pa.concat_tables(held)
            yield whole.slice(0, cuts[-1]).combine_chunks(), np.array(cuts)
            held, size, cuts = [whole.slice(cuts[-1])], size - cuts[-1], [0]
    if held:
        yield pa.concat_tables(held).combine_chunks(), np.array([*cuts, size])


def arrow_schema(schema: str) -> pa.Schema:
    """The Arrow form of a schema told as text."""
    return to_arrow_schema(StructType.fromDDL(schema))


def arrow_map(df: DataFrame, keys: list[str], fn: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """chunked_map over Arrow tables, for rows that pass through with their types and nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, cuts in arrow_chunks(batches, keys):
            yield from fn(whole, cuts).to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def folded(df: DataFrame, key: str, order: str, start: Callable[[], object], step: Callable[[object, pd.DataFrame], list[dict]], schema: str) -> DataFrame:
    """A fold of each key's rows in order, one value of `order` at a time.

    start() makes a key's state; step(state, rows) takes the rows of one value of
    `order` and returns rows without the key, which is put before them. A key is
    one task; it holds its state and the rows of one step, however long the key is.
    """
    names = [part.split()[0] for part in schema.split(", ")]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, last = None, None
        for rows in runs(batches, [key, order]):
            now = None if pd.isna(rows[key].iloc[0]) else rows[key].iloc[0]
            if state is None or now != last:
                state, last = start(), now
            made = step(state, rows)
            if made:
                yield pd.DataFrame([{key: now, **r} for r in made], columns=names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _together(each(batches))

    return df.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, schema)
