"""Contracts, the model seam, bounded galleries, guards, the camera roster and parameter search."""

import numpy as np
import pytest

from sightline import contracts, registry
from sightline.errors import ExecutionError, ParameterError, WidthError
from sightline.functions import kalman
from sightline.operators import crosscamera, models, retrieval, tracking
from sightline.plans import grouping, tuning


def test_running_aggregates():
    mean, rows = contracts.RunningMean(), np.eye(3)
    v = None
    for row, w in zip(rows, (1, 2, 1)):
        v = mean.update(v, row, weight=w)
    assert np.allclose(v, np.array([1, 2, 1]) / np.sqrt(6)) and np.allclose(v, contracts.RunningMean().aggregate(rows, np.array([1, 2, 1])))
    assert np.allclose(contracts.RunningMean().update(None, [3, 4], weight=0), [0.6, 0.8])
    ema = contracts.MovingAverage(0.9)
    assert np.allclose(ema.aggregate(rows[:2]), np.array([0.9, 0.1, 0]) / np.hypot(0.9, 0.1))
    with pytest.raises(ParameterError):
        mean.update(v, rows[0], weight=-1)
    with pytest.raises(ParameterError):
        contracts.RunningMean().aggregate(rows, np.zeros(3))


def test_camera_motion():
    told = registry.MOTIONS.build("external")
    assert np.array_equal(told.estimate(None), contracts.IDENTITY)
    told.push([1, 0, 5, 0, 1, -2])
    assert told.estimate(None)[0, 2] == 5 and np.array_equal(told.estimate(None), contracts.IDENTITY)
    with pytest.raises(ParameterError):
        told.push([1, 2])
    assert tracking.build("botsort", cmc="none").motion.estimate(None).shape == (2, 3)
    with pytest.raises(ParameterError):
        tracking.build("botsort", cmc="sparse_flow")


def test_checks():
    assert contracts.checked_hw([640, 480.0]) == (640, 480) and contracts.checked_pad(114.0) == 114
    for bad in ((640,), (0, 3), (1, -1)):
        with pytest.raises(ParameterError):
            contracts.checked_hw(bad)
    for bad in (256, -1, 1.5, True, "7"):
        with pytest.raises(ParameterError):
            contracts.checked_pad(bad)
    assert registry.TRACKERS.backends("byte") == ["spark"] and registry.TRACKERS.backends("x") == []


def test_kalman_weights_scale_the_noise():
    box = np.array([[10.0, 10, 0.5, 100]])
    _, plain = kalman.initiate(box)
    _, wide = kalman.initiate(box, position=1 / 10, velocity=1 / 80)
    assert np.allclose(wide[0, 0, 0], 4 * plain[0, 0, 0]) and np.allclose(wide[0, 4, 4], 4 * plain[0, 4, 4])


def user_models():
    """A user's classes; made here so that they travel to the workers by value."""

    class Flat(contracts.Detector):
        input_hw = (32, 32)

        def execute(self, batch):
            """One box a picture, its score the mean of the picture."""
            return np.stack([[[8, 8, 24, 24, float(min(1, abs(x).mean())), 1.0]] for x in batch])

    class Short(Flat):
        def execute(self, batch):
            return np.zeros((len(batch), 1, 4))

    class Lost(Flat):
        def execute(self, batch):
            return np.zeros((0, 1, 6))

    class Mean(contracts.Extractor):
        dim = 3

        def extract(self, crops):
            return crops.mean(axis=(2, 3)) + 1e-3

    return Flat, Short, Lost, Mean


def pictures(spark):
    rows = [(k, "cam", bytes([40 * k + 30]) * (16 * 16 * 3), 16, 16) for k in range(5)]
    return spark.createDataFrame(rows, "frame_id long, camera_id string, content binary, height int, width int")


def test_models_run_in_batches(spark):
    Flat, Short, Lost, Mean = user_models()
    got = models.detected(pictures(spark), Flat, (32, 32), batch=2, conf_threshold=0.0).collect()
    assert len(got) == 5 and all(len(r["items"]) == 1 for r in got)
    assert [tuple(r["items"][0])[:4] for r in got] == [(4.0, 4.0, 12.0, 12.0)] * 5
    for kind, error in ((Short, WidthError), (Lost, ExecutionError)):
        with pytest.raises(Exception, match=error.__name__):
            models.run_detector(pictures(spark), kind).collect()
    crops = pictures(spark).selectExpr("frame_id AS crop_id", "content", "height", "width", "1D AS x1", "1D AS y1", "9D AS x2", "12D AS y2")
    vectors = models.run_extractor(crops, Mean, (8, 4), batch=2).collect()
    assert len(vectors) == 5 and all(abs(np.linalg.norm(r["vector"]) - 1) < 1e-6 for r in vectors)


def test_online_centroids_forget_the_one_seen_longest_ago():
    held = retrieval.OnlineCentroids(2)
    held.add("a", [1, 0], "cam0")
    held.add("b", [0, 1], "cam1")
    held.add("a", [1, 0], "cam1")
    held.add("c", [1, 1], "cam0")
    assert set(held.held) == {"a", "c"} and held.observations("a") == 2 and held.observations("b") == 0
    assert [n for n, _ in held.query([1, 0], 5)] == ["a", "c"] and [n for n, _ in held.query([1, 0], 5, exclude_camera="cam1")] == ["c"]
    assert held.query([-1, 0], threshold=0.5) == [] and held.remove_identity("a") == 1 and held.remove_identity("a") == 0
    with pytest.raises(ParameterError):
        held.add("d", [np.nan, 1])
    with pytest.raises(ParameterError):
        held.add("d", [1, 2, 3])
    assert len(held) == 1


def test_rerank_guards(spark):
    q = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(3)], "query_id long, vector array<double>")
    g = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(6)], "entry_id long, vector array<double>")
    for options, message in (({"k1": 9, "k2": 1}, "k1 = 9"), ({"k1": 2, "k2": 1, "max_entries": 8}, "GB")):
        with pytest.raises(ParameterError, match=message):
            retrieval.rerank(q, g, **options)
    for bad in (None, [float("nan"), 1.0]):
        odd = spark.createDataFrame([(9, bad)], "entry_id long, vector array<double>")
        with pytest.raises(Exception, match="vector"):
            retrieval.rerank(q, g.union(odd), k1=2, k2=1).collect()
    parts = retrieval.rerank_size(10, 90, 20, 6, 64)
    assert parts["pairs"] == 48 * 100**2 and set(parts) == {"vectors", "pairs", "neighbours", "weights", "result"}


def seen(instants, absent=()):
    look = [1.0, 0.0]
    return [("g", t, "c0", 1, 0.0, 0.0, 50.0, 400.0, look, 480, 640) for t in instants if t not in absent]


OBSERVATIONS = "group_id string, instant long, camera_id string, track_id long, x1 float, y1 float, x2 float, y2 float, embedding array<float>, frame_h int, frame_w int"


def test_roster_tells_an_empty_view_from_an_absent_camera(spark):
    rows = seen(range(1, 7), absent=(3,))
    observations = spark.createDataFrame(rows, OBSERVATIONS)
    roster = spark.createDataFrame([("g", t, "c0") for t in range(1, 7)], "group_id string, instant long, camera_id string")
    hits = lambda out: [r["hits"] for r in out.orderBy("instant").collect()]
    assert hits(crosscamera.global_tracks(observations)) == [1, 2, 3, 4, 5]
    assert hits(crosscamera.global_tracks(observations, roster=roster)) == [1, 2, 1, 2, 3]


def test_runs_hold_one_group_across_batches():
    import pandas as pd

    parts = [pd.DataFrame({"k": ["a", "a"], "v": [1, 2]}), pd.DataFrame({"k": ["a", "b"], "v": [3, 4]}), pd.DataFrame({"k": [], "v": []}), pd.DataFrame({"k": ["b", None, None], "v": [5, 6, 7]})]
    assert [(g["k"].iloc[0], g["v"].tolist()) for g in grouping.runs(iter(parts), ["k"])] == [("a", [1, 2, 3]), ("b", [4, 5]), (None, [6, 7])]


def test_fold_restarts_for_each_key(spark):
    rows = spark.createDataFrame([("a", 2, 1), ("a", 1, 1), ("b", 1, 5), (None, 1, 2), ("a", 2, 3)], "k string, t long, v long")

    def step(state, group):
        state.append(int(group["v"].sum()))
        return [{"t": int(group["t"].iloc[0]), "total": sum(state)}]

    got = grouping.folded(rows, "k", "t", list, step, "k string, t long, total long").collect()
    assert sorted((str(r["k"]), r["t"], r["total"]) for r in got) == [("None", 1, 2), ("a", 1, 1), ("a", 2, 5), ("b", 1, 5)]


def test_a_study_is_stored_and_taken_up_again(tmp_path, monkeypatch):
    calls = []

    class Row:
        def where(self, _):
            return self

        def first(self):
            return {"HOTA": calls[-1].get("iou_threshold", 0.3)}

    def evaluate(case, tracker, *, threshold, **parameters):
        calls.append(parameters)
        return Row()

    monkeypatch.setattr(tuning, "evaluate", evaluate)
    store = str(tmp_path / "study.jsonl")
    first = tuning.run_study("sort", {}, trials=6, store=store)
    n = len(calls)
    again = tuning.run_study("sort", {}, trials=6, store=store)
    assert n == 7 and len(calls) == n and again.best_params == first.best_params and first.best >= first.baseline and first.trials == 6
    assert tuning.run_study("sort", {}, trials=6, timeout=0.0).trials == 0
    for name in tracking.TRACKERS:
        tuning.space_for(name)


@pytest.mark.parametrize("most_bytes", [32 << 20, 400])
def test_search_is_brute_force(spark, most_bytes):
    rng = np.random.default_rng(4)
    unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.integers(-2, 3, (n, 4)) + np.array([0.5, 0, 0, 0]))
    q, g = unit(23), unit(300)
    asked = spark.createDataFrame([(k, v.tolist(), ["a", "b", None][k % 3]) for k, v in enumerate(q)] + [(99, None, "a"), (None, q[0].tolist(), "a")], "query_id long, vector array<double>, camera_id string")
    held = spark.createDataFrame([(k, v.tolist(), ["a", "b", None][k % 3]) for k, v in enumerate(g)] + [(999, None, "b")], "entry_id long, vector array<double>, camera_id string").repartition(3)
    got = retrieval.search(asked, held, 7, threshold=0.9, exclude_camera=True, round_to=6, most_bytes=most_bytes).collect()
    want = set()
    for k, v in enumerate(q):
        own = ["a", "b", None][k % 3]
        may = [(-round(float(v @ x), 6), e) for e, x in enumerate(g) if own is None or ["a", "b", None][e % 3] != own]
        want |= {(k, e, -s, r + 1, (-s >= 0.9) if r == 0 else None) for r, (s, e) in enumerate(sorted(may)[:7])}
    assert sorted((r[0], r[1], round(r[2], 5), r[3], r[4]) for r in got) == sorted((a, b, round(s, 5), r, c) for a, b, s, r, c in want)
    assert retrieval.search(asked.limit(0), held, 3).count() == 0 and retrieval.search(asked, held.limit(0), 3).count() == 0


def test_chunks_hold_whole_keys():
    import pandas as pd

    rng = np.random.default_rng(1)
    for _ in range(200):
        keys = np.sort(rng.integers(0, 6, rng.integers(0, 30)))
        pdf = pd.DataFrame({"k": keys, "v": np.arange(len(keys))})
        edges = np.sort(rng.integers(0, len(keys) + 1, 4))
        parts = [pdf.iloc[a:b] for a, b in zip([0, *edges], [*edges, len(keys)])]
        got = list(grouping.chunks(iter(parts), ["k"]))
        assert [v for whole, _ in got for v in whole["v"]] == list(range(len(keys)))
        groups = [whole["k"].iloc[a:b].tolist() for whole, cuts in got for a, b in zip(cuts[:-1], cuts[1:])]
        assert groups == [[k] * int((keys == k).sum()) for k in np.unique(keys)]
