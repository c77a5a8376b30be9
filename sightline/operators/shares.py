"""How far whole tracks overlap, summed frame by frame over arrays: pairs of boxes are never rows."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import distinct_boxes, iou_block
from ..plans.grouping import arrow_chunks, arrow_schema, changes
from .frames import FRAME, Boxes, both_packed, unpacked

#: The tasks among which a sequence's frames are dealt; each sums the pairs of tracks it meets.
PARTS = 3
#: The tasks among which a sequence's truth tracks are dealt when the sums meet.
STRIPES = 16
#: Pairs of tracks that a task sums at a time; more are handed over and summed again later.
TABLE = 1 << 24
#: Pairs of boxes that are weighed at a time, and of a frame's different boxes that are held between its two passes.
BLOCK, HELD = 1 << 18, 1 << 23
#: Predicted tracks in a row that is handed over.
WIDTH = 512
EPSILON = float(np.finfo(np.float64).eps)


def shares(a: Boxes, b: Boxes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The share that each pair's IoU has of all IoU of its two boxes, some rows of a at a time: (rows, shares).

    Boxes with the same corners are weighed once. IoUs beyond HELD are made a second time.
    """
    (of_a, first_a, n_a), (of_b, first_b, n_b) = distinct_boxes(a.corners, a.absent), distinct_boxes(b.corners, b.absent)
    a, b = a.at(first_a), b.at(first_b)
    step = max(1, BLOCK // len(n_b))
    held: dict[int, np.ndarray] = {}

    def made(k: int) -> np.ndarray:
        some = a.at(slice(k, k + step))
        return iou_block(some.corners, b.corners, some.absent, b.absent)

    by_a, by_b = np.empty(len(n_a)), np.zeros(len(n_b))
    for k in range(0, len(n_a), step):
        iou = made(k)
        by_a[k : k + step] = iou @ n_b
        by_b += n_a[k : k + step] @ iou
        if len(n_a) * len(n_b) <= HELD:
            held[k] = iou
    order = np.argsort(of_a, kind="stable")
    for k in range(0, len(n_a), step):
        iou = held.pop(k) if held else made(k)
        rest = by_a[k : k + step, None] + by_b
        rest -= iou
        # so that a NaN is passed on
        rest[rest <= EPSILON] = np.inf
        iou /= rest
        rows = order[slice(*np.searchsorted(of_a[order], [k, k + step]))]
        at_once = max(1, BLOCK // len(of_b))
        for r in range(0, len(rows), at_once):
            own = rows[r : r + at_once]
            yield own, iou[(of_a[own] - k)[:, None], of_b]


class Sums:
    """Sums over pairs of tracks of one sequence, in a table of the ids met so far. Pairs not met hold -0.0, which no sum is."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.ids: tuple[dict, dict] = ({}, {})
        self.table = np.full((0, 0), -0.0)

    def fits(self, rows: list, columns: list) -> bool:
        sizes = [len(known) + len(set(new).difference(known)) for known, new in zip(self.ids, (rows, columns))]
        return sizes[0] * sizes[1] <= TABLE

    def slots(self, rows: list, columns: list) -> tuple[np.ndarray, np.ndarray]:
        """Where ids stand in the table, which grows to hold them."""
        at = [np.array([known.setdefault(n, len(known)) for n in new]) for known, new in zip(self.ids, (rows, columns))]
        need = [max(has, -(-len(known) // 64) * 64) for has, known in zip(self.table.shape, self.ids)]
        if need != list(self.table.shape):
            was, self.table = self.table, np.full(need, -0.0)
            self.table[: was.shape[0], : was.shape[1]] = was
        return at[0], at[1]

    def add(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, apart: bool) -> None:
        """values at rows and columns, of which some may be the same unless they are apart."""
        if apart:
            self.table[rows[:, None], columns] += values
        else:
            np.add.at(self.table, (rows[:, None], columns), values)

    def told(self) -> Iterator[tuple[object, list, np.ndarray]]:
        """Each truth track with the predicted tracks it met and their sums, WIDTH at a time."""
        names = list(self.ids[1])
        for name, slot in self.ids[0].items():
            row = self.table[slot, : len(names)]
            met = np.flatnonzero(~np.signbit(row) | np.isnan(row))
            for k in range(0, len(met), WIDTH):
                some = met[k : k + WIDTH]
                yield name, [names[i] for i in some], row[some]


def _rows(frames: Iterator[tuple[tuple, Boxes | None, Boxes | None, pa.Table | None]]) -> Iterator[tuple]:
    """(sequence, gt, preds, sums, n): sums of shares; then the boxes of each truth track, and those of the predicted ones without a gt."""
    sums, counts, last = Sums(), (Counter(), Counter()), None

    def pairs() -> Iterator[tuple]:
        # an id that is null names no track
        yield from ((last, name, others, values, 0) for name, others, values in sums.told() if name is not None)
        sums.clear()

    def done() -> Iterator[tuple]:
        yield from pairs()
        yield from ((last, name, [], [], n) for name, n in counts[0].items() if name is not None)
        names = list(counts[1])
        for k in range(0, len(names), WIDTH):
            some = names[k : k + WIDTH]
            yield last, None, some, [float(counts[1][n]) for n in some], 0
        counts[0].clear(), counts[1].clear()

    for (sequence, frame), truth, predictions, _ in frames:
        if sequence != last:
            yield from done()
            last = sequence
        for count, side in zip(counts, (truth, predictions)):
            count.update(side.ids if side else ())
        if frame is None or truth is None or predictions is None:
            continue
        apart = all(len(set(side.ids)) == len(side.ids) for side in (truth, predictions))
        whole = len(truth.ids) * len(predictions.ids) <= TABLE
        if whole:
            if not sums.fits(truth.ids, predictions.ids):
                yield from pairs()
            rows, columns = sums.slots(truth.ids, predictions.ids)
        for own, values in shares(truth, predictions):
            if whole:
                here = rows[own]
            else:
                # a frame beyond the table goes through it in pieces
                some = [truth.ids[k] for k in own]
                if not sums.fits(some, predictions.ids):
                    yield from pairs()
                here, columns = sums.slots(some, predictions.ids)
            sums.add(here, columns, values, apart)
    yield from done()


def _told(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in _rows(unpacked(batches, FRAME)):
        held.append(row)
        if len(held) >= 256:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _met(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The sums of each pair of tracks and the boxes of both, from the rows of stripes: those without a gt come first."""
    stripe, boxes = None, None
    for table, cuts in arrow_chunks(batches, ["sequence", "stripe", "gt"]):
        starts = changes(table.select(["sequence", "stripe"]).to_pandas(), ["sequence", "stripe"])
        for a, b in zip(starts, [*starts[1:], table.num_rows]):
            part = table.slice(a, b - a).combine_chunks()
            begins = cuts[(cuts >= a) & (cuts < b)] - a
            track = np.repeat(begins, np.diff([*begins, b - a]))  # the first row of each row's truth track
            sizes = pc.list_value_length(part.column("preds")).to_numpy()
            flat = pa.table({"track": np.repeat(track, sizes), "pred": pc.list_flatten(part.column("preds")), "value": pc.list_flatten(part.column("sums"))})
            flat = flat.filter(pc.is_valid(flat.column("pred")))
            head = pc.less(flat.column("track"), part.column("gt").null_count)
            now = part.column("sequence")[0].as_py(), part.column("stripe")[0].as_py()
            if now != stripe:
                stripe, boxes = now, flat.filter(head).group_by("pred", use_threads=False).aggregate([("value", "sum")])
            met = flat.filter(pc.invert(head)).group_by(["track", "pred"], use_threads=False).aggregate([("value", "sum")]).combine_chunks()
            at = met.column("track").to_numpy()
            n_gt = np.bincount(track, weights=part.column("n").to_numpy(), minlength=len(track)).astype(np.int64)
            n_pred = boxes.column("value_sum").take(pc.index_in(met.column("pred"), value_set=boxes.column("pred").combine_chunks())).cast(pa.int64())
            columns = [part.column("sequence").take(at), part.column("gt").take(at), met.column("pred"), met.column("value_sum"), pa.array(n_gt[at]), n_pred]
            yield from pa.Table.from_arrays(columns, schema=schema).to_batches(max_chunksize=1 << 16)


def potentials(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """(sequence, gt, pred, potential, n_gt, n_pred) of all tracks that share a frame: summed shares, and the boxes of both.

    Frames are dealt among PARTS tasks a sequence, each of which sums into one
    table; the tables meet by truth track, where the boxes of the predicted
    tracks come along, so that no table of tracks is broadcast.
    """
    frames = both_packed(truth, predictions)
    sequence, gt, pred = dict(frames.dtypes)["sequence"], dict(truth.dtypes)["id"], dict(predictions.dtypes)["id"]
    wide = f"sequence {sequence}, gt {gt}, preds array<{pred}>, sums array<double>, n bigint"
    slim = f"sequence {sequence}, gt {gt}, pred {pred}, potential double, n_gt bigint, n_pred bigint"
    as_told, as_met = arrow_schema(wide), arrow_schema(slim)
    dealt = frames.repartition("sequence", F.pmod(F.hash("frame_id"), F.lit(PARTS))).sortWithinPartitions(*FRAME)
    told = dealt.mapInArrow(lambda batches: _told(batches, as_told), wide)
    stripes = F.when(F.col("gt").isNull(), F.sequence(F.lit(0), F.lit(STRIPES - 1))).otherwise(F.array(F.pmod(F.hash("gt"), F.lit(STRIPES))))
    striped = told.withColumn("stripe", F.explode(stripes)).repartition("sequence", "stripe").sortWithinPartitions("sequence", "stripe", "gt")
    return striped.mapInArrow(lambda batches: _met(batches, as_met), slim)


class Alignments:
    """The alignment of each pair of a sequence's tracks, 0 for pairs that share no frame: as a table where a fair part of it is filled, else as sorted keys."""

    def __init__(self, pairs: pa.Table) -> None:
        slots = []
        self.ids: list[dict] = []
        for c in ("gt", "pred"):
            coded = pc.dictionary_encode(pairs.column(c).combine_chunks())
            slots.append(coded.indices.to_numpy().astype(np.int64))
            self.ids.append({name: k for k, name in enumerate(coded.dictionary.to_pylist())})
        values = pairs.column("alignment").to_numpy()
        shape = [len(known) for known in self.ids]
        self.table, self.keys = None, None
        if shape[0] * shape[1] <= 4 * len(values):
            self.table = np.zeros(shape)
            self.table[slots[0], slots[1]] = values
        else:
            keys = slots[0] * shape[1] + slots[1]
            order = np.argsort(keys)
            self.keys, self.values = keys[order], values[order]

    def of(self, rows: list, columns: list) -> np.ndarray:
        """The alignments of tracks by tracks; all of them are known by name."""
        r, c = (np.array([known[n] for n in names]) for known, names in zip(self.ids, (rows, columns)))
        if self.table is not None:
            return self.table[r[:, None], c]
        keys = r[:, None] * len(self.ids[1]) + c
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], 0)
