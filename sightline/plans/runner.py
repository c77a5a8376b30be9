"""Run a tracker over cases, score it, and report."""

from __future__ import annotations

import time

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import require
from ..operators import evaluation, tracking
from . import grouping

COLUMNS = ["HOTA", "DetA", "AssA", "MOTA", "MOTP", "IDF1", "FP", "FN", "IDSW"]
COUNTS = {"FP", "FN", "IDSW", "TP", "MT", "PT", "ML", "Frag"}


def objects(tracks: DataFrame) -> DataFrame:
    """Tracks as objects of the sequence that their camera is."""
    return tracks.select(F.col("camera_id").alias("sequence"), "frame_id", F.col("track_id").alias("id"), "x1", "y1", "x2", "y2")


def run(frames: DataFrame, tracker: str, **parameters) -> DataFrame:
    """Published tracks with the seconds that the camera's frames took so far, in the column seconds."""
    tracking.build(tracker, **parameters)
    columns = [c for c in ("camera_id", "frame_id", "height", "width", "items", "affine") if c in frames.columns]
    schema = "camera_id string, frame_id long, track_id long, x1 float, y1 float, x2 float, y2 float, seconds double"
    names = [part.split()[0] for part in schema.split(", ")][1:-1]

    def start() -> list:
        return [tracking.build(tracker, **parameters), 0.0]

    def step(state: list, rows: pd.DataFrame) -> list[dict]:
        began = time.perf_counter()
        made = tracking.stepped(state[0], rows)
        state[1] += time.perf_counter() - began
        return [{**{n: r[n] for n in names}, "seconds": state[1]} for r in made]

    return grouping.folded(frames.select(*columns), "camera_id", "frame_id", start, step, schema)


def evaluate(case: dict[str, DataFrame], tracker: str, *, threshold: float = 0.5, **parameters) -> DataFrame:
    """All metrics of a tracker on a case (frames, truth, sequences, and ignored and unscored if there are any)."""
    tracks = run(case["frames"], tracker, **parameters).persist()
    scores = evaluation.score(case["truth"], objects(tracks), case["sequences"], ignored=case.get("ignored"), unscored=case.get("unscored"), threshold=threshold)
    took = tracks.groupBy(F.col("camera_id").alias("sequence")).agg(F.max("seconds").alias("seconds")).join(case["sequences"], "sequence")
    speed = took.select("sequence", (1000 * F.col("seconds") / F.col("length")).alias("ms_per_frame"))
    return scores.join(speed, "sequence", "left").withColumn("tracker", F.lit(tracker))


def cells(results: DataFrame, columns: list[str] = COLUMNS) -> DataFrame:
    """Results as text: shares as percentages, counts as whole numbers; COMBINED last."""
    shown = [F.format_string("%d", F.col(c).cast("long")) if c in COUNTS else F.format_string("%.2f", F.col(c) * 100) for c in columns]
    keys = [c for c in ("tracker", "sequence") if c in results.columns]
    return results.select(*keys, *[s.alias(c) for s, c in zip(shown, columns)]).orderBy(*[c for c in keys if c != "sequence"], F.col("sequence") == evaluation.COMBINED, "sequence")


def table(results: DataFrame, columns: list[str] = COLUMNS, title: str = "") -> str:
    """A fixed-width table: one row a sequence (and tracker)."""
    pdf = cells(results, columns).toPandas().astype(str)
    widths = [max(len(c), *(len(v) for v in pdf[c])) if len(pdf) else len(c) for c in pdf.columns]
    line = lambda values: "  ".join(v.ljust(w) if k == 0 else v.rjust(w) for k, (v, w) in enumerate(zip(values, widths)))
    return "\n".join([*([title] if title else []), line(pdf.columns), *(line(r) for r in pdf.itertuples(index=False))])


def comparison(results: list[DataFrame], columns: list[str] = COLUMNS, title: str = "") -> str:
    """One table of several trackers; they must have run on the same sequences."""
    require(len(results) > 0, "nothing to compare")
    together = results[0]
    for r in results[1:]:
        together = together.unionByName(r)
    seen = together.groupBy("tracker").agg(F.array_sort(F.collect_set("sequence")).alias("s")).select("s").distinct().count()
    require(seen == 1, "trackers that are compared must have run on the same sequences")
    return table(together, columns, title)
