"""Structured Streaming forms: the batch operators' own objects, kept as state between micro-batches.

Rows of a key come in any order inside a micro-batch and are sorted by frame or
instant. What comes after a later one has been handled is late: it is dropped, or
refused if strict. The state is the tracker's arrays and numbers, so batch and
stream share their steps.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..contracts import MovingAverage
from ..errors import TrackError
from ..operators import crosscamera, retrieval, tracking
from ..schema import TRACKS

STATE = "blob binary"


def track_stream(frames: DataFrame, name: str = "bytetrack", *, strict: bool = False, **parameters) -> DataFrame:
    """track over a stream of frames, keyed by camera; empty frames must be in the stream, as tracks age on them."""
    tracking.build(name, **parameters)
    columns = [f.name for f in TRACKS.fields]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker = tracking.build(name, **parameters)
        if state.exists:
            tracker.restored(pickle.loads(state.get[0]))
        out: list[dict] = []
        for row in pd.concat(list(batches)).sort_values("frame_id").to_dict("records"):
            if tracker.last_frame is not None and row["frame_id"] <= tracker.last_frame:
                if strict:
                    raise TrackError(f"frame {row['frame_id']} of {key[0]} is late")
                continue
            affine = row.get("affine")
            moved = None if affine is None else np.asarray(list(affine), dtype=float).reshape(2, 3)
            out += [{"camera_id": key[0], **t} for t in tracker.step(int(row["frame_id"]), tracking.Detections.of(row["items"]), int(row.get("height") or 0), int(row.get("width") or 0), moved)]
        state.update((pickle.dumps(tracker.state()),))
        yield pd.DataFrame(out, columns=columns)

    return frames.groupBy("camera_id").applyInPandasWithState(step, tracking.TRACK_SCHEMA, STATE, "append", GroupStateTimeout.NoTimeout)


def global_tracks_stream(observations: DataFrame, *, strict: bool = False, **parameters) -> DataFrame:
    """global_tracks over a stream of observations, keyed by camera group.

    An instant is handled when a row of a later one has come, as its cameras may
    be spread over micro-batches; the last one waits in the state.
    """
    crosscamera.CrossCamera(**parameters)
    names = [c.split()[0] for c in crosscamera.OUT_SCHEMA.split(", ")]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker = crosscamera.CrossCamera(**parameters)
        held, waiting, done = pickle.loads(state.get[0]) if state.exists else (None, [], -1)
        if held is not None:
            tracker.restored(held)
        rows = waiting + pd.concat(list(batches)).to_dict("records")
        late = [r for r in rows if r["instant"] <= done]
        if late and strict:
            raise TrackError(f"instant {late[0]['instant']} of {key[0]} is late")
        rows = [r for r in rows if r["instant"] > done]
        last = max((r["instant"] for r in rows), default=done)
        out: list[dict] = []
        for instant in sorted({r["instant"] for r in rows if r["instant"] < last}):
            out += [{"group_id": key[0], "instant": instant, **r} for r in tracker.step([r for r in rows if r["instant"] == instant])]
            done = instant
        state.update((pickle.dumps((tracker.state(), [r for r in rows if r["instant"] == last], done)),))
        yield pd.DataFrame(out, columns=names).astype({"global_id": "Int64", "cluster": "Int32"})

    return observations.groupBy("group_id").applyInPandasWithState(step, crosscamera.OUT_SCHEMA, STATE, "append", GroupStateTimeout.NoTimeout)


def instants(observations: DataFrame, width: str = "60 milliseconds", ts: str = "ts", delay: str = "1 second") -> DataFrame:
    """observations with the number of their tumbling window, behind a watermark; ts may lack a time zone."""
    out = observations.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return out.withColumn("instant", F.unix_micros(F.window(ts, width)["start"]))


def counts_stream(events: DataFrame, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Events by type and window, appended when the watermark has passed it."""
    out = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return out.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def centroids_stream(entries: DataFrame, *, alpha: float = 0.9) -> DataFrame:
    """The moving-average vector of each identity after each micro-batch: identity, vector, observations, camera_id.

    entries has identity, entry_id, camera_id and a unit vector; a micro-batch's
    entries are folded in the order of entry_id.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        vector, n = pickle.loads(state.get[0]) if state.exists else (None, 0)
        camera = None
        for row in pd.concat(list(batches)).sort_values("entry_id").to_dict("records"):
            incoming = np.asarray(list(row["vector"]), dtype=float)
            mean = incoming if vector is None else alpha * vector + (1 - alpha) * incoming
            vector, n, camera = mean / max(np.linalg.norm(mean), 1e-12), n + 1, row["camera_id"]
        state.update((pickle.dumps((vector, n)),))
        yield pd.DataFrame({"identity": [key[0]], "vector": [vector], "observations": [n], "camera_id": [camera]})

    kinds = dict(entries.dtypes)
    schema = f"identity {kinds['identity']}, vector array<double>, observations long, camera_id {kinds['camera_id']}"
    return entries.groupBy("identity").applyInPandasWithState(step, schema, STATE, "update", GroupStateTimeout.NoTimeout)


def gallery_stream(entries: DataFrame, *, group: str = "group_id", capacity: int = 10_000, alpha: float = 0.9) -> DataFrame:
    """A bounded centroid gallery for each group over a stream: the entries of a micro-batch and how many identities are held after it.

    entries has the group, identity, entry_id, camera_id, a vector and, if there
    is one, quality, which weighs it. The state of a group is its gallery, so the
    least recently seen identity of the group goes when the capacity is reached.
    """
    columns = [group, "identity", "entry_id", "camera_id", "vector", *(["quality"] if "quality" in entries.columns else [])]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = retrieval.OnlineCentroids(capacity, _Folder(alpha))
        if state.exists:
            held.held = pickle.loads(state.get[0])
        seen: dict = {}
        for row in pd.concat(list(batches)).sort_values("entry_id").to_dict("records"):
            held.add(row["identity"], np.asarray(list(row["vector"]), dtype=float), row["camera_id"], weight=float(row.get("quality", 1.0)))
            seen[row["identity"]] = None
        state.update((pickle.dumps(held.held),))
        kept = [n for n in seen if n in held.held]
        yield pd.DataFrame({group: key[0], "identity": kept, "vector": [held.held[n]["vector"] for n in kept], "observations": [held.observations(n) for n in kept], "camera_id": [held.held[n]["camera_id"] for n in kept], "held": len(held)})

    kinds = dict(entries.dtypes)
    schema = f"{group} {kinds[group]}, identity {kinds['identity']}, vector array<double>, observations long, camera_id {kinds['camera_id']}, held long"
    return entries.select(*columns).groupBy(group).applyInPandasWithState(step, schema, STATE, "update", GroupStateTimeout.NoTimeout)


class _Folder:
    """Makes the moving averages of a gallery; a class, so that a state that holds them can be pickled."""

    def __init__(self, alpha: float) -> None:
        self.alpha = alpha

    def __call__(self) -> MovingAverage:
        return MovingAverage(self.alpha)
