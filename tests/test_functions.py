"""Plain numpy parts: assignment, filter, clustering, pixels, ranges, registries."""

import itertools

import numpy as np
import pytest

from sightline.errors import ParameterError, TrackError
from sightline.functions import arrays, imaging, kalman
from sightline.functions.assignment import ambiguous, associate, associate_locked, cascade, clear_pairs, isolated, least_cost
from sightline.operators import crosscamera, nms, tracking
from sightline.plans import tuning
from sightline.registry import TRACKERS, Registry


def brute(cost):
    n, m = cost.shape
    if n > m:
        return brute(cost.T)
    return min(sum(cost[r, c] for r, c in enumerate(p)) for p in itertools.permutations(range(m), n))


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(300):
        cost = rng.normal(size=(rng.integers(1, 6), rng.integers(1, 6))).round(1)
        found = least_cost(cost)
        taken = [c for c in found if c >= 0]
        assert len(taken) == len(set(taken)) == min(cost.shape)
        assert np.isclose(sum(cost[r, c] for r, c in enumerate(found) if c >= 0), brute(cost))


def test_assignment_thresholds_after_solving_and_prefers_low_ties():
    cost = np.array([[0.1, 0.2], [0.15, 9.0]])
    assert associate(cost, 0.5) == ([(0, 1), (1, 0)], [], [])
    assert associate(np.array([[0.1, 0.9], [0.9, 0.8]]), 0.5) == ([(0, 0)], [1], [1])
    assert associate(np.zeros((2, 3)), 1.0)[0] == [(0, 0), (1, 1)]
    assert associate(np.zeros((0, 2)), 1.0) == ([], [], [0, 1])


def test_clear_ambiguous_and_isolated_pairs():
    cost = np.array([[0.1, 0.9, 0.9], [0.9, 0.2, 0.3], [0.9, 0.3, 0.9]])
    assert clear_pairs(cost, 0.5) == [(0, 0)]
    assert ambiguous(cost, 0.5).sum() == 3
    assert associate_locked(cost, 0.5)[0] == [(0, 0), (1, 2), (2, 1)]
    assert associate_locked(np.array([[0.1]]), 0.5) == ([(0, 0)], [], [])
    assert isolated(np.array([[0.9, 1.0], [1.0, 1.0]]), 0.5).tolist() == [[True, False], [False, False]]


def test_cascade_serves_young_tracks_first():
    cost = np.array([[0.1], [0.2]])
    build = lambda r, c: cost[np.ix_(r, c)]
    assert cascade(build, 0.5, [0, 1], [0], np.array([6, 0]), 5, 31) == ([(1, 0)], [0], [])


def test_filter_equals_four_small_filters():
    """Without camera motion x, y, aspect and height do not mix."""
    rng = np.random.default_rng(2)
    mean, cov = kalman.initiate(np.array([[100.0, 50, 0.5, 80]]))
    for k in range(60):
        mean, cov = kalman.predict(mean, cov)
        mean, cov = kalman.update(mean, cov, np.array([[100 + 2 * k, 50 - k, 0.5, 80]]) + rng.normal(size=(1, 4)) * [1, 1, 0.01, 1])
        off = cov[0].copy()
        for a in range(4):
            off[np.ix_([a, a + 4], [a, a + 4])] = 0
        assert np.abs(off).max() < 1e-9
    assert np.allclose(mean[0, 4:6], [2, -1], atol=0.3)
    assert np.allclose(kalman.distance(mean, cov, mean[:, :4]), 0)


def scenario(positions, score=0.9, gap=()):
    """Frames of detections whose centres are given, 40 by 100 pixels."""
    for frame, centres in enumerate(positions, 1):
        boxes = np.array([[x - 20, y - 50, x + 20, y + 50] for x, y in centres if frame not in gap], dtype=float).reshape(-1, 4)
        yield frame, tracking.Detections(boxes, np.full(len(boxes), score), np.zeros(len(boxes), dtype=int), [None] * len(boxes))


@pytest.mark.parametrize("name", sorted(tracking.TRACKERS))
def test_trackers_keep_two_walkers_apart(name):
    tracker = tracking.build(name)
    positions = [[(100 + 5 * k, 200), (600 - 5 * k, 500)] for k in range(30)]
    out = [t for frame, found in scenario(positions, gap=(12, 13)) for t in tracker.step(frame, found, 1080, 1920)]
    ids = {}
    for t in out:
        ids.setdefault(t["track_id"], []).append(t["y1"])
    assert len(ids) == 2 and all(np.ptp(v) < 20 for v in ids.values())
    assert min(t["frame_id"] for t in out) == 3 and not any(t["frame_id"] in (12, 13) for t in out)
    assert {t["state"] for t in out} == {"confirmed"}


def test_trackers_refuse_frames_out_of_order_and_bad_parameters():
    tracker = tracking.build("sort")
    nothing = tracking.Detections.of([])
    tracker.step(5, nothing)
    with pytest.raises(TrackError):
        tracker.step(5, nothing)
    tracker.reset()
    tracker.step(1, nothing)
    for name, bad in (("sort", {"iou_threshold": 0}), ("bytetrack", {"low_threshold": 0.6}), ("botsort", {"appearance_gate": 0}), ("ocsort", {"delta_t": 0}), ("deepsortv2", {"border_fraction": 0.5}), ("none", {})):
        with pytest.raises(ParameterError):
            tracking.build(name, **bad)


def test_tentative_tracks_die_at_once_and_lost_ones_after_max_age():
    tracker = tracking.build("sort", max_age=3)
    walk = [[(100, 100)]] * 2 + [[]] + [[(100, 100)]] * 4 + [[]] * 4 + [[(100, 100)]] * 4
    out = [t for frame, found in scenario(walk) for t in tracker.step(frame, found)]
    assert [t["frame_id"] for t in out] == [6, 7, 14, 15]
    assert len({t["track_id"] for t in out}) == 2


def test_low_scores_continue_tracks_but_start_none():
    positions = [[(100 + 3 * k, 200)] for k in range(12)]
    for name, seen in (("bytetrack", 10), ("sort", 3)):
        tracker = tracking.build(name)
        out = []
        for frame, found in scenario(positions):
            found.scores[:] = 0.9 if frame <= 5 else 0.3
            out += tracker.step(frame, found)
        assert len(out) == seen
    tracker = tracking.build("bytetrack", min_hits=1)
    assert [t for frame, found in scenario(positions, score=0.3) for t in tracker.step(frame, found)] == []


def test_camera_motion_carries_tracks():
    tracker = tracking.build("botsort", min_hits=1, gate=False)
    ids = set()
    for frame, found in scenario([[(200 + 60 * k, 200)] for k in range(8)]):
        moved = np.array([[1.0, 0, 60], [0, 1, 0]]) if frame > 1 else None
        ids |= {t["track_id"] for t in tracker.step(frame, found, affine=moved)}
    assert len(ids) == 1


def test_appearance_tells_crossing_walkers_apart():
    rng = np.random.default_rng(3)
    looks = [v / np.linalg.norm(v) for v in rng.normal(size=(2, 32))]
    tracker = tracking.build("deepsortv2", min_hits=1)
    owner = {}
    for k in range(40):
        xs = (200 + 10 * k, 590 - 10 * k)
        boxes = np.array([[x - 20, 100, x + 20, 200] for x in xs], dtype=float)
        found = tracking.Detections(boxes, np.array([0.9, 0.9]), np.zeros(2, dtype=int), looks)
        for t in tracker.step(k + 1, found, 1080, 1920):
            owner.setdefault(t["track_id"], set()).add(int(np.argmax([np.dot(t["embedding"], v) for v in looks])))
    assert len(owner) == 2 and all(len(v) == 1 for v in owner.values())


def test_average_linkage_cuts_inclusively_and_numbers_by_appearance():
    d = np.array([[0, 0.1, 0.5], [0.1, 0, 0.7], [0.5, 0.7, 0]], dtype=float)
    assert crosscamera.average_linkage(d, 0.05).tolist() == [0, 1, 2]
    assert crosscamera.average_linkage(d, 0.1).tolist() == [0, 0, 1]
    assert crosscamera.average_linkage(d, 0.6).tolist() == [0, 0, 0]
    assert crosscamera.average_linkage(d[::-1, ::-1], 0.1).tolist() == [0, 1, 1]
    with pytest.raises(ParameterError):
        crosscamera.average_linkage(np.array([[0, np.nan], [np.nan, 0]]), 0.1)


def seen(camera, track, vector, y2=700.0):
    return {"camera_id": camera, "track_id": track, "x1": 100.0, "y1": 300.0, "x2": 200.0, "y2": y2, "embedding": vector, "frame_h": 1080, "frame_w": 1920}


def test_cross_camera_identity_over_instants():
    rng = np.random.default_rng(4)
    a, b = np.eye(64)[0], np.eye(64)[1]
    near = lambda v: (lambda w: w / np.linalg.norm(w))(v + 0.02 * rng.normal(size=64))
    tracker = crosscamera.CrossCamera()
    last = []
    for _ in range(6):
        last = tracker.step([seen("q", 1, near(a)), seen("q", 2, near(b)), seen("r", 7, near(a)), seen("r", 8, near(b)), seen("r", 9, near(b), 310.0)])
        tracker.ids.check()
    ids = {(r["camera_id"], r["track_id"]): r["global_id"] for r in last}
    assert ids["q", 1] == ids["r", 7] != ids["q", 2] == ids["r", 8] and ids["r", 9] is None
    # a new track number takes the place of one that is gone
    for _ in range(4):
        last = tracker.step([seen("q", 1, near(a)), seen("r", 17, near(a))])
        tracker.ids.check()
    assert {r["global_id"] for r in last} == {ids["q", 1]}


def test_gate_streaks_wait_for_absent_cameras_only():
    gate = crosscamera.Gate(min_hits=3, max_absent=2)
    row = seen("q", 1, None)
    assert gate.admit([row], {"q"}) == [] and gate.admit([row], {"q"}) == []
    assert gate.admit([], {"r"}) == [] and gate.admit([row], {"q"}) == [row]
    assert gate.admit([], {"q"}) == [] and gate.admit([row], {"q"}) == []


def test_identities_are_bounded():
    ids = crosscamera.Identities(max_age=2, capacity=3, max_tracks=4)
    for k in range(20):
        ids.assign([seen("q", k, np.eye(4)[k % 4])], [0])
        ids.check()
        assert len(ids.owner) <= 4 and len(ids.members) <= 3
    assert ids.issued == 20


def test_homography_is_recovered():
    rng = np.random.default_rng(5)
    m = np.array([[0.9, 0.1, 5], [-0.05, 1.1, 3], [1e-4, 2e-4, 1]])
    src = rng.uniform(0, 1000, (12, 2))
    h = np.column_stack([src, np.ones(12)]) @ m.T
    assert np.allclose(crosscamera.mapped(src, h[:, :2] / h[:, 2:]), m, atol=1e-6)
    with pytest.raises(ParameterError):
        crosscamera.mapped(np.column_stack([np.arange(5.0), np.arange(5.0)]), src[:5])


def test_soft_suppression_weights():
    v = np.array([0.5])
    assert nms.decay(v, "classic", 0.5)[0] == 0 and nms.decay(v, "linear", 0.5)[0] == 0.5 and np.isclose(nms.decay(v, "gauss", 0.5)[0], np.exp(-0.5))


def test_isolation_and_momentum():
    boxes = np.array([[0, 0, 10, 10], [0, 0, 10, 10], [50, 50, 60, 60.0]])
    assert arrays.isolation(boxes).tolist() == [0, 0, 1] and arrays.isolation(boxes[:1]).tolist() == [1]
    assert np.allclose(arrays.momentum(boxes[2:], np.array([0.9]), 0.9, 0.95), 0.9)
    assert np.allclose(arrays.momentum(boxes[:2], np.array([0.9, 0.9]), 0.9, 0.95), 0.95)


@pytest.mark.parametrize("shape", [(1080, 1920), (1083, 1919), (5, 3), (640, 640)])
def test_letterbox_keeps_constant_images_and_bars(shape):
    image = np.full((*shape, 3), 200, dtype=np.uint8)
    out = imaging.letterbox(image, (64, 96))
    _, rh, rw, top, left = imaging.plan(*shape, (64, 96))
    inside = out[:, top : top + rh, left : left + rw]
    assert out.shape == (3, 64, 96) and np.allclose(inside, 200 / 255, atol=1e-6)
    assert np.isclose(out.sum(), inside.sum() + 3 * (64 * 96 - rh * rw) * 114 / 255, rtol=1e-4)


def test_crops_and_nv12():
    rng = np.random.default_rng(6)
    image = np.repeat(np.repeat(rng.integers(0, 255, (8, 8, 3), dtype=np.uint8), 8, axis=0), 8, axis=1)
    whole = imaging.crops(image, np.array([[0, 0, 63, 63], [5, 5, 5, 9]]), (16, 16))
    assert whole.shape == (2, 3, 16, 16) and np.all(whole[1] == 0)
    packed = imaging.bgr_to_nv12(image, stride=70)
    assert packed.shape == (96, 70)
    back = imaging.nv12_to_rgb(packed, 64)[..., ::-1]
    inner = np.abs(back - image)[2::8, 2::8]
    assert np.median(inner) < 4
    grey = np.full((64, 64, 3), 90, dtype=np.uint8)
    assert np.allclose(imaging.nv12_letterbox(imaging.bgr_to_nv12(grey), 64, (32, 32)), 90 / 255, atol=0.01)
    with pytest.raises(ParameterError):
        imaging.nv12_rows(63)


def test_masks_come_back_to_source_pixels():
    logits = imaging.mask_logits(np.array([[1.0, 0.0]]), np.stack([np.full((16, 16), 8.0), np.zeros((16, 16))]))[0]
    mask = imaging.unpadded_mask(logits, (90, 160), (64, 64))
    assert mask.shape == (90, 160) and mask.min() > 0.99


def test_fixed_batches_fill_the_last_one():
    got = list(imaging.fixed_batches(iter(np.arange(5).reshape(5, 1)), 3))
    assert [b.ravel().tolist() for b in got] == [[0, 1, 2], [3, 4, 3]]
    assert len(list(imaging.fixed_batches(iter(np.arange(9).reshape(9, 1)), 2, limit=2))) == 2


def test_ranges_and_spaces():
    assert tuning.FloatRange(1, 100, log=True).at(0.5) == pytest.approx(10)
    assert tuning.FloatRange(0, 1, step=0.25).at(0.6) == 0.5
    assert {tuning.IntRange(1, 5, 2).at(s) for s in (0, 0.4, 0.99)} == {1, 3, 5}
    assert tuning.Choice(("a", "b")).at(0.7) == "b"
    for name in tracking.TRACKERS:
        tracking.build(name, **tuning.space_for(name).middle())
    assert tuning.direction_of("IDSW") == "minimize" and tuning.direction_of("HOTA") == "maximize"
    with pytest.raises(ParameterError):
        tuning.Space("sort", {"nonsense": tuning.FloatRange(0, 1)})


def test_registry():
    family = Registry("thing")
    family.add("one", dict, ("uno",))
    assert family.build("uno", a=1) == {"a": 1} and family.names() == ["one"]
    with pytest.raises(ParameterError):
        family.add("uno", list)
    with pytest.raises(ParameterError):
        family.get("two")
    assert TRACKERS.get("byte") is tracking.ByteTrack
