"""DataFrame operators against DuckDB, brute force and hand-made scenes."""

import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sightline import catalog, schema
from sightline.functions import boxes, vectors
from sightline.operators import aggregate, assign, crosscamera, detection, evaluation, nms, pairs, retrieval, tracking
from sightline.plans import runner, tuning, views
from sightline.plans.grouping import grouped_map
from sightline.sources import mot, synthetic
from sightline.streaming import processors

SMALL = "/root/testdata/sf0.001"
TABLES = ["lineitem", "embeddings"]


def plain(df: pd.DataFrame) -> list:
    """Rows as text, columns by name, numbers to five places."""

    def cell(v):
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        if v is None or str(v) in ("nan", "<NA>", "NaN"):
            return None
        return round(float(v), 5) + 0.0 if isinstance(v, (int, float, np.integer, np.floating)) else str(v)

    return sorted([repr([cell(v) for v in r]) for r in df[sorted(df.columns)].itertuples(index=False)])


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, SMALL).toPandas()
    want = con.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) > 0
    assert plain(got) == plain(want)


def objects(spark, rows):
    """(sequence, frame, id, x) rows as 30 by 60 boxes."""
    return spark.createDataFrame([(s, f, i, float(x), 0.0, float(x) + 30, 60.0) for s, f, i, x in rows], "sequence string, frame_id long, id long, x1 float, y1 float, x2 float, y2 float")


def scores(spark, gt, pred, length=4, **extra):
    lengths = spark.createDataFrame([("s", length)], "sequence string, length int")
    out = evaluation.score(objects(spark, gt), objects(spark, pred), lengths, **extra)
    return out.where("sequence = 's'").first().asDict()


def test_perfect_tracking(spark):
    gt = [("s", f, i, 100 * i + f) for f in range(1, 5) for i in (1, 2)]
    got = scores(spark, gt, [(s, f, i + 10, x) for s, f, i, x in gt])
    assert all(got[m] == pytest.approx(1) for m in ("HOTA", "MOTA", "MOTP", "IDF1", "DetA", "AssA", "LocA"))
    assert (got["IDSW"], got["Frag"], got["MT"]) == (0, 0, 2)


def test_one_switch_and_a_split_track(spark):
    gt = [("s", f, 1, 0) for f in range(1, 5)]
    got = scores(spark, gt, [("s", 1, 7, 0), ("s", 2, 7, 0), ("s", 3, 8, 0), ("s", 4, 8, 0)])
    assert got["IDSW"] == 1 and got["MOTA"] == pytest.approx(0.75) and got["IDF1"] == pytest.approx(0.5)
    assert got["AssA"] == pytest.approx(0.5) and got["HOTA"] == pytest.approx(np.sqrt(0.5))
    lost = scores(spark, gt + [("s", f, 2, 500) for f in range(1, 5)], [("s", f, 9, 500) for f in range(1, 5)] + [("s", f, 7, 0) for f in (1, 2, 4)])
    assert lost["Frag"] == 1 and lost["FN"] == 1 and lost["IDSW"] == 0


def test_overlap_below_the_threshold_is_no_match(spark):
    gt = [("s", 1, 1, 0)]
    got = scores(spark, gt, [("s", 1, 1, 20)], length=1)
    assert (got["TP"], got["FP"], got["FN"]) == (0, 1, 1) and got["MOTA"] == -1
    assert scores(spark, [], [("s", 1, 1, 0)], length=1)["MOTA"] == -1


def test_clear_keeps_a_pair_though_another_is_nearer(spark):
    gt = [("s", 1, 1, 0), ("s", 2, 1, 0)]
    got = scores(spark, gt, [("s", 1, 5, 4), ("s", 2, 5, 6), ("s", 2, 6, 0)])
    assert got["IDSW"] == 0 and got["FP"] == 1


def test_ignored_boxes_take_predictions_away(spark):
    gt = [("s", 1, 1, 0)]
    pred = [("s", 1, 1, 0), ("s", 1, 2, 300)]
    ignored = objects(spark, [("s", 1, 9, 300)])
    assert scores(spark, gt, pred, length=1, ignored=ignored)["FP"] == 0
    competing = objects(spark, [("s", 1, 8, 300)])
    assert scores(spark, gt, pred, length=1, ignored=objects(spark, [("s", 1, 9, 306)]), unscored=competing)["FP"] == 1


def test_boxes_of_one_id_in_a_frame_match_on_their_own(spark):
    gt = [("s", f, i, 300 * i) for f in (1, 2) for i in (1, 2, 3)]
    pred = [("s", f, 7, 300 * i) for f in (1, 2) for i in (1, 2)] + [("s", 1, 8, 900)]
    got = scores(spark, gt, pred)
    assert (got["TP"], got["FP"], got["FN"], got["IDSW"]) == (5, 0, 1, 0)
    # tracks 1 and 2: 2 boxes shared of 4 in the union each; track 3: 1 of 2
    assert got["DetA"] == pytest.approx(5 / 6) and got["AssA"] == pytest.approx((2 * 2 / 4 + 2 * 2 / 4 + 1 / 2) / 5)


def test_ignored_boxes_take_every_box_of_an_id(spark):
    truth = objects(spark, [("s", 1, i, 300 * i) for i in (1, 2, 3)])
    predicted = objects(spark, [("s", 1, 7, 300), ("s", 1, 7, 603), ("s", 1, 8, 900)])
    left = evaluation.without_ignored(predicted, truth.where("id = 2"), truth.where("id <> 2")).collect()
    assert [(r["frame_id"], r["id"]) for r in left] == [(1, 8)]


def test_combined_sums_counts_before_it_divides(spark):
    gt = objects(spark, [("a", 1, 1, 0), ("b", 1, 1, 0), ("b", 2, 1, 0), ("b", 3, 1, 0)])
    pred = objects(spark, [("b", f, 1, 0) for f in (1, 2, 3)])
    lengths = spark.createDataFrame([("a", 1), ("b", 3)], "sequence string, length int")
    got = {r["sequence"]: r["MOTA"] for r in evaluation.score(gt, pred, lengths).collect()}
    assert got == {"a": 0.0, "b": 1.0, "COMBINED": 0.75}
    curve = evaluation.hota_at(evaluation.hota_counts(gt, pred, lengths), 0.5).where("sequence = 'b'").first()
    assert curve["alpha"] == pytest.approx(0.5) and curve["HOTA"] == 1


def test_assigned_joins_one_to_one_with_leftovers(spark):
    rows = [("k", 1, 1, 0.1), ("k", 1, 2, 0.2), ("k", 2, 1, 0.15), ("k", 3, None, None), ("l", 5, 6, 0.9)]
    df = spark.createDataFrame(rows, "key string, row long, col long, cost double")
    got = {(r["key"], r["row"], r["col"]) for r in assign.assigned(df, ["key"], "row", "col", "cost", 0.5).collect()}
    assert got == {("k", 1, 2), ("k", 2, 1), ("k", 3, None), ("l", 5, None), ("l", None, 6)}


def test_grouped_map_sees_each_group_once(spark):
    df = spark.range(5000).select((F.col("id") % 37).alias("k"), "id")
    got = grouped_map(df, ["k"], lambda p: pd.DataFrame({"k": [p["k"].iloc[0]], "n": [len(p)]}), "k long, n long").collect()
    assert sorted((r["k"], r["n"]) for r in got) == [(k, len(range(k, 5000, 37))) for k in range(37)]


def greedy(b, s, t):
    order, kept = sorted(range(len(s)), key=lambda k: (-s[k], k)), []
    for k in order:
        if all(iou_of(b[k], b[j]) <= t for j in kept):
            kept.append(k)
    return kept


def iou_of(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(w, 0) * max(h, 0)
    return inter / max((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter, 1e-9)


def test_suppression_methods(spark):
    rng = np.random.default_rng(7)
    xy = rng.integers(0, 40, (60, 2))
    b = np.hstack([xy, xy + rng.integers(5, 30, (60, 2))]).astype(float)
    s = rng.integers(1, 100, 60) / 100
    df = spark.createDataFrame([("f", k, float(s[k]), *map(float, b[k])) for k in range(60)], "key string, row long, score double, x1 double, y1 double, x2 double, y2 double")
    run = lambda **o: [(r["row"], r["score"]) for r in nms.suppress(df, ["key"], "row", iou_threshold=0.3, **o).orderBy("rank").collect()]
    kept = greedy(b, s, 0.3)
    assert [k for k, _ in run()] == kept and [k for k, _ in run(max_output=3)] == kept[:3]
    members = {k: [k] for k in kept}
    for k in set(range(60)) - set(kept):
        members[next(j for j in kept if iou_of(b[j], b[k]) > 0.3)].append(k)
    backed = [k for k in kept if len(members[k]) > 2 and sum(s[j] for j in members[k]) >= 1.2]
    assert [k for k, _ in run(method="neighborhood", min_neighbors=2, min_score_sum=1.2)] == backed
    soft = run(method="linear", score_threshold=0.05)
    assert soft[0] == (kept[0], s[kept[0]]) and {k for k, _ in soft} >= set(kept) - {k for k in kept if s[k] < 0.05}
    assert [v for _, v in soft] == sorted((v for _, v in soft), reverse=True)
    with pytest.raises(Exception, match="NaN"):
        nms.suppress(df.withColumn("score", F.lit(float("nan"))), ["key"], "row", iou_threshold=0.3).collect()


def test_neighborhood_suppression_of_a_crowd_is_quick():
    rng = np.random.default_rng(9)
    xy = rng.integers(0, 9000, (20_000, 2)).astype(float)
    b, s = np.hstack([xy, xy + 60]), np.sort(rng.random(20_000))[::-1]
    b[1::2] = b[::2] + 1
    began = time.process_time()
    kept = nms._backed(b, s, 0.4, 1, 0.0)
    assert 8_000 < len(kept) <= 10_000 and time.process_time() - began < 60


def neighbours(rank, i, k):
    return [j for j in rank[i][: k + 1] if i in rank[j][: k + 1]]


def rerank_plainly(q, g, k1, k2, lam):
    x = np.concatenate([q, g])
    d = 1 - x @ x.T
    d = d / np.maximum(d.max(axis=1, keepdims=True), 1e-12)
    rank = np.argsort(d, axis=1, kind="stable").tolist()
    v = np.zeros_like(d)
    for i in range(len(x)):
        own = set(neighbours(rank, i, k1))
        wide = set(own)
        for c in own:
            half = neighbours(rank, c, round(k1 / 2))
            if len(own & set(half)) > 2 / 3 * len(half):
                wide |= set(half)
        at = sorted(wide)
        v[i, at] = np.exp(-d[i, at]) / np.exp(-d[i, at]).sum()
    v = np.stack([v[rank[i][:k2]].mean(axis=0) for i in range(len(x))])
    low = np.minimum(v[: len(q), None], v[None, len(q) :]).sum(axis=2)
    return (1 - low / (2 - low)) * (1 - lam) + d[: len(q), len(q) :] * lam


def unit_rows(rng, n, dim=16, groups=5):
    centre = rng.normal(size=(groups, dim))
    x = centre[np.arange(n) % groups] + 0.6 * rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_rerank_equals_the_dense_form(spark):
    rng = np.random.default_rng(8)
    q, g = unit_rows(rng, 8), unit_rows(rng, 30)
    frame = lambda x, name: spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], f"{name} long, vector array<double>")
    got = retrieval.rerank(frame(q, "query_id"), frame(g, "entry_id"), k1=6, k2=3, lambda_value=0.3).collect()
    want = rerank_plainly(q, g, 6, 3, 0.3)
    assert len(got) == 240 and all(abs(r["distance"] - want[r["query_id"], r["entry_id"]]) < 1e-9 for r in got)


def test_rerank_of_copies_makes_no_pairs(spark):
    rng = np.random.default_rng(12)
    x = unit_rows(rng, 12).round(6)
    frame = lambda rows, name: spark.createDataFrame([(100 + k, [float(v) for v in x[k % 12]]) for k in rows], f"{name} long, vector array<double>")
    made = retrieval.rerank(frame(range(0, 6), "query_id"), frame(range(6, 42), "entry_id"), k1=4, k2=2)
    plan = made._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    got = {(r["query_id"], r["entry_id"]): r["distance"] for r in made.collect()}
    want = rerank_plainly(x[:6], x[np.arange(6, 42) % 12], 4, 2, 0.3)
    assert len(got) == want.size and all(got[100 + a, 106 + b] == pytest.approx(want[a, b], abs=1e-9) for a in range(6) for b in range(36))


def test_the_rerank_query_takes_tables_of_any_size(spark, tmp_path, monkeypatch):
    from sightline import catalog

    rng = np.random.default_rng(13)
    x = unit_rows(rng, 60)
    spark.createDataFrame([(k, [float(v) for v in r], k % 4) for k, r in enumerate(x)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    # the default guard of the operator, as if the table were beyond it
    monkeypatch.setitem(retrieval.rerank.__kwdefaults__, "max_entries", 50)
    made = catalog.QUERIES["retrieval_rerank"](spark, str(tmp_path))
    want = rerank_plainly(x[::20], x, 10, 3, 0.3)
    got = {(r["query_id"], r["entry_id"]): r["distance"] for r in made.collect()}
    assert len(got) == 180 and all(got[20 * a, b] == pytest.approx(want[a, b], abs=1e-6) for a in range(3) for b in range(60))


def test_the_lowest_values_of_a_row_are_those_of_a_stable_sort():
    rng = np.random.default_rng(14)
    for row in (rng.integers(0, 9, 300) / 8, rng.normal(size=300), np.zeros(300), rng.normal(size=5)):
        assert retrieval._first(row, 11).tolist() == np.argsort(row, kind="stable")[:11].tolist()


def test_ranking_by_products_equals_ranking_over_pairs(spark):
    rng = np.random.default_rng(10)
    x = unit_rows(rng, 60).round(2)  # ties
    rows = [(k, None if k in (7, 20) else [float(v) for v in x[k]], None if k == 9 else f"p{k % 5}", None if k == 11 else k % 3) for k in range(60)]
    g = spark.createDataFrame(rows, "entry_id long, vector array<double>, identity string, camera_id int")
    q = g.where("entry_id % 2 = 1 OR entry_id = 20").withColumnRenamed("entry_id", "query_id")
    scored = retrieval.similarities(q, g, round_to=2)
    order = lambda df: sorted((r["query_id"], r["first"], round(r["ap"], 9)) for r in df.collect())
    want = order(retrieval.per_query(scored))
    assert len(want) >= 25 and order(retrieval.rank_queries(q, g, round_to=2)) == want
    assert order(retrieval.rank_queries(q, g, round_to=2, most_bytes=10)) == want
    assert retrieval.evaluate_search(q, g, round_to=2).first()["skipped"] == retrieval.evaluate_ranking(scored).first()["skipped"]
    assert order(retrieval.rank_queries(q, g.limit(0))) == []
    # pairs are not rows: no plan holds a product of the two tables
    assert "CartesianProduct" not in (plan := retrieval.rank_queries(q, g)._jdf.queryExecution().toString()) and "NestedLoop" not in plan


def test_ema_is_an_ordered_fold(spark):
    rng = np.random.default_rng(9)
    x = unit_rows(rng, 12)
    rows = [(k % 2, k, [float(v) for v in r], 0.5 + 0.5 * (k % 3 == 0)) for k, r in enumerate(x)]
    got = {r["g"]: np.array(r["vector"]) for r in aggregate.ema(spark.createDataFrame(rows, "g int, t long, vector array<double>, w double"), ["g"], "t", alpha=0.8, weight="w").collect()}
    for g in (0, 1):
        state = x[g]
        for k in range(g + 2, 12, 2):
            keep = 1 - 0.2 * rows[k][3]
            state = keep * state + (1 - keep) * x[k]
            state /= np.linalg.norm(state)
        assert np.allclose(got[g], state)
    with pytest.raises(Exception, match="negative"):
        aggregate.mean(spark.createDataFrame([(0, [1.0], -1.0)], "g int, vector array<double>, w double"), ["g"], weight="w").collect()


def test_guards_refuse_bad_values(spark):
    one = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [1.0, float("nan")])], "a array<double>, z array<double>, n array<double>")
    got = one.select(vectors.unit(F.col("a")).alias("u"), vectors.normalised(F.col("z")).alias("z"), vectors.is_normalised(F.col("z")).alias("ok")).first()
    assert got["u"] == [0.6, 0.8] and got["z"] == [0, 0] and got["ok"]
    for bad in (vectors.unit(F.col("z")), vectors.unit(F.col("n")), vectors.normalised(F.col("n")), schema.finite_array(F.col("n"), "vector")):
        with pytest.raises(Exception, match="finite|NaN"):
            one.select(bad).collect()
    crooked = spark.createDataFrame([(5.0, 0.0, 1.0, 2.0)], "x1 double, y1 double, x2 double, y2 double")
    with pytest.raises(Exception, match="corners"):
        schema.checked_boxes(crooked).collect()
    assert boxes.Box.of() and crooked.select(*boxes.widened(boxes.Box.of())).first()[2] == 5
    with pytest.raises(Exception, match="one width"):
        schema.one_width(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "v array<double>"), "v").collect()


def test_homographies_and_spatial_matching(spark):
    points = [("a", float(x), float(y), float(2 * x + 1), float(2 * y)) for x, y in ((0, 0), (100, 0), (0, 100), (100, 120), (50, 70))]
    fitted = crosscamera.fit_homographies(spark.createDataFrame(points, "camera_id string, x double, y double, u double, v double"))
    row = fitted.first()
    assert np.allclose(np.array(row["matrix"]).reshape(3, 3), [[2, 0, 1], [0, 2, 0], [0, 0, 1]], atol=1e-6) and row["max_error"] < 1e-6
    maps = fitted.select("camera_id", "matrix", F.lit(0).alias("camera_width"), F.lit(0).alias("camera_height"))
    maps = maps.unionByName(maps.withColumn("camera_id", F.lit("b")))
    base = spark.createDataFrame([("g", 1, c, t, float(x), 100.0, float(x) + 50, 300.0, [1.0, 0.0], 1080, 1920) for c, t, x in (("a", 1, 0), ("b", 1, 10), ("b", 2, 400), ("c", 3, 0))], "group_id string, instant long, camera_id string, track_id long, x1 double, y1 double, x2 double, y2 double, embedding array<double>, frame_h int, frame_w int")
    got = {(r["a_track_id"], r["b_camera_id"], r["b_track_id"]): r for r in crosscamera.distances(base, maps, matcher="spatial").where("a_camera_id = 'a'").collect()}
    assert got[1, "b", 1]["similarity"] == pytest.approx(1 - 20 / 280) and got[1, "b", 2]["distance"] == 1e5 and got[1, "c", 3]["similarity"] == 0
    gated = {(r["b_camera_id"], r["b_track_id"]): r["similarity"] for r in crosscamera.distances(base, maps, matcher="gated").where("a_camera_id = 'a'").collect()}
    assert gated == {("b", 1): 1, ("b", 2): 0, ("c", 3): 1}


def test_batch_clusters_equal_the_stepwise_ones(spark):
    seen = views.observations(spark, SMALL).where("instant < 10")
    tracks = {(r["group_id"], r["instant"], r["camera_id"], r["track_id"]): r["cluster"] for r in crosscamera.clusters(seen).collect()}
    stepwise = crosscamera.global_tracks(seen, min_hits=1).collect()
    for r in stepwise:
        assert tracks[r["group_id"], r["instant"], r["camera_id"], r["track_id"]] == r["cluster"]


def written_sequence(folder, name, frames):
    place = folder / name
    for d in ("gt", "det"):
        (place / d).mkdir(parents=True)
    (place / "seqinfo.ini").write_text(f"[Sequence]\nname={name}\nimDir=img1\nframeRate=25\nseqLength={frames}\nimWidth=640\nimHeight=480\nimExt=.jpg\n")
    gt, det = [], []
    for f in range(1, frames + 1):
        gt += [f"{f},1,{10 + 4 * f},20,40,100,1,1,1.0", f"{f},2,{300 - 4 * f},200,40,100,1,1,0.1", f"{f},3,500,300,50,50,0,1,1", f"{f},4,100,300,40,90,1,8,1"]
        if f != 4:
            det += [f"{f},-1,{10 + 4 * f},20,40,100,0.9", f"{f},-1,{300 - 4 * f},200,40,100,0.8"]
    (place / "gt" / "gt.txt").write_text("\n".join(gt) + "\n")
    (place / "det" / "det.txt").write_text("\n".join(det) + "\n")


def test_mot_folders_are_read_tracked_scored_and_written(spark, tmp_path):
    for name in ("MOT-A", "MOT-B"):
        written_sequence(tmp_path, name, 12)
    root = str(tmp_path)
    assert mot.discover(spark, root) == ["MOT-A", "MOT-B"]
    assert all(f["has_ground_truth"] and f["has_detections"] for f in mot.files(spark, root, ["MOT-A"]))
    case = mot.case(spark, root)
    assert {r["role"]: r["count"] for r in mot.annotations(spark, root, ["MOT-A"], min_visibility=0.5).groupBy("role").count().collect()} == {"scored": 12, "unscored": 24, "ignored": 12}
    frames = {(r["camera_id"], r["frame_id"]): r for r in case["frames"].collect()}
    assert len(frames) == 24 and len(frames["MOT-A", 4]["items"]) == 0 and len(frames["MOT-B", 5]["items"]) == 2
    assert (frames["MOT-A", 5]["height"], frames["MOT-A", 5]["ts"].microsecond) == (480, 200_000)
    results = runner.evaluate(case, "bytetrack", min_hits=1)
    got = {r["sequence"]: r for r in results.collect()}
    assert set(got) == {"MOT-A", "MOT-B", "COMBINED"} and got["COMBINED"]["IDF1"] > 0.9 and got["MOT-A"]["FN"] == 2
    assert "COMBINED" in runner.table(results) and "sort" in runner.comparison([results, runner.evaluate(case, "sort", min_hits=1)])
    tracks = tracking.track(case["frames"], "sort", min_hits=1)
    mot.write_submission(tracks, f"{root}/out")
    lines = spark.read.text(f"{root}/out/camera_id=MOT-A").collect()
    assert len(lines) == tracks.where("camera_id = 'MOT-A'").count() and lines[0][0].startswith("1,1,") and lines[0][0].endswith(",1,-1,-1,-1")
    short = mot.case(spark, root, ["MOT-A"], frames=5)
    assert short["frames"].count() == 5 and short["sequences"].first()["length"] == 5
    with pytest.raises(Exception, match="no sequences"):
        mot.case(spark, root, ["MOT-Z"])
    study = tuning.run_study("sort", short, space=tuning.Space("sort", {"min_hits": tuning.IntRange(1, 2)}, {"max_age": 5}), metric="MOTA", trials=2)
    assert study.best >= study.baseline and study.trials == 2 and "sort MOTA" in study.summary()


def synthetic_frames(spark, n=12):
    base = spark.range(1, n + 1).select(F.lit("q").alias("camera_id"), F.col("id").alias("frame_id"), F.lit(480).alias("height"), F.lit(640).alias("width"))
    return synthetic.detections(base.unionByName(base.withColumn("camera_id", F.lit("r"))), objects=4, seed=3)


def test_synthetic_detections_repeat_and_stay_inside(spark):
    a, b = (sorted(map(str, synthetic_frames(spark).collect())) for _ in range(2))
    assert a == b
    for r in synthetic_frames(spark, 60).collect():
        s = [i["score"] for i in r["items"]]
        assert len(s) == 4 and s == sorted(s, reverse=True)
        assert all(0 <= i["x1"] <= i["x2"] <= 640 and 0 <= i["y1"] <= i["y2"] <= 480 for i in r["items"])


def run_stream(df, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    query.processAllAvailable()
    query.stop()


def test_streams_equal_batches(spark, tmp_path):
    frames = synthetic_frames(spark).select("camera_id", "frame_id", "height", "width", "items")
    for k in range(3):
        frames.where((F.col("frame_id") - 1) / 4 < k + 1).where((F.col("frame_id") - 1) / 4 >= k).coalesce(1).write.mode("append").parquet(str(tmp_path / "f"))
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "f"))
    run_stream(processors.track_stream(stream, "ocsort", min_hits=2), "tracks")
    pick = ["camera_id", "frame_id", "track_id", "x1", "hits"]
    want = tracking.track(frames, "ocsort", min_hits=2).select(*pick)
    assert sorted(map(tuple, spark.table("tracks").select(*pick).collect())) == sorted(map(tuple, want.collect()))

    seen = views.observations(spark, SMALL).where("instant < 6 AND group_id IN ('g0', 'g1')")
    for low in (0, 2, 4):
        seen.where((F.col("instant") >= low) & (F.col("instant") < low + 2)).coalesce(1).write.mode("append").parquet(str(tmp_path / "o"))
    stream = spark.readStream.schema(seen.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "o"))
    run_stream(processors.global_tracks_stream(stream, min_hits=2), "globals")
    want = crosscamera.global_tracks(seen, min_hits=2).where("instant < 5")
    assert sorted(map(str, spark.table("globals").collect())) == sorted(map(str, want.collect()))


def test_centroid_stream_ends_at_the_batch_fold(spark, tmp_path):
    entries = views.gallery(spark, SMALL).where("entry_id < 100")
    entries.where("entry_id < 50").coalesce(1).write.parquet(str(tmp_path / "g"))
    entries.where("entry_id >= 50").coalesce(1).write.mode("append").parquet(str(tmp_path / "g"))
    stream = spark.readStream.schema(entries.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "g"))
    query = processors.centroids_stream(stream, alpha=0.8).writeStream.format("memory").queryName("centres").outputMode("update").start()
    query.processAllAvailable()
    query.stop()
    last = {}
    for r in sorted(spark.table("centres").collect(), key=lambda r: r["observations"]):
        last[r["identity"]] = r
    want = {r["identity"]: r for r in retrieval.centroids(entries, alpha=0.8).collect()}
    assert set(last) == set(want)
    assert all(np.allclose(last[k]["vector"], want[k]["vector"]) and last[k]["observations"] == want[k]["observations"] for k in want)


def test_event_windows_close_behind_the_watermark(spark):
    events = spark.readStream.schema(spark.read.parquet(f"{SMALL}/events.parquet").schema).parquet(f"{SMALL}/events.parque[t]")
    run_stream(processors.counts_stream(events, "1 day"), "counts")
    assert spark.table("counts").count() > 0


def test_detector_output_becomes_frames(spark):
    values = [[[10.0, 10.0, 50.0, 60.0, 0.9, 0.0], [12.0, 10.0, 50.0, 60.0, 0.8, 0.4], [100.0, 100.0, 90.0, 160.0, 0.5, 1.0], [0.0, 0.0, 5.0, 5.0, 0.1, 0.0]], []]
    tensors = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "frame_id long, values array<array<double>>")
    frames = spark.createDataFrame([("q", k, 1280, 1280) for k in range(3)], "camera_id string, frame_id long, height int, width int")
    got = {r["frame_id"]: r["items"] for r in detection.decode(tensors, frames, (640, 640)).collect()}
    assert [len(got[k]) for k in range(3)] == [3, 0, 0]
    assert [round(got[0][0][c], 3) for c in ("x1", "y1", "x2", "y2", "score")] == [20, 20, 100, 120, 0.9] and got[0][2]["x1"] == got[0][2]["x2"]
    kept = {r["frame_id"]: len(r["items"]) for r in detection.decode(tensors, frames, (640, 640), method="classic").collect()}
    assert kept[0] == 2
    assert detection.head_for([(1, 300, 6)]) == "yolo26" and detection.head_for([(1, 300, 38), (1, 32, 160, 160)]) == "yolo26_seg"
    with pytest.raises(Exception, match="scores"):
        detection.decode(tensors.withColumn("values", F.expr("array(array(0D, 0D, 1D, 1D, 7D, 0D))")), frames, (640, 640)).collect()


def test_isolation_is_brute_force_and_makes_no_pairs(spark):
    rng = np.random.default_rng(11)
    xy = rng.integers(0, 300, (700, 2))
    b = np.hstack([xy, xy + rng.integers(1, 40, (700, 2))]).astype(float)
    rows = [(None if k % 7 == 3 else k % 7, k, *map(float, b[k]), None if k % 2 else k) for k in range(700)] + [(1, 700, None, 0.0, 9.0, 9.0, 1)]
    rows += [(9, k, 10.0 * k, 0.0, 10.0 * k + 12, 9.0, k) for k in range(701, 1301)]
    df = spark.createDataFrame(rows, "key long, row long, x1 double, y1 double, x2 double, y2 double, extra long")
    made = pairs.isolation(df, ["key"], "row")
    assert "Join" not in made._jdf.queryExecution().toString()
    got = {r["row"]: (r["isolation"], r["extra"]) for r in made.collect()}
    assert len(got) == len(rows) and all(got[r[1]][1] == r[6] for r in rows)
    assert got[700][0] == 1.0
    for k in range(0, 700, 13):
        others = [j for j in range(k % 7, 700, 7) if j != k]
        assert got[k][0] == pytest.approx(1 - max(iou_of(b[k], b[j]) for j in others), abs=1e-12)
    assert got[1000][0] == pytest.approx(1 - 2 / 22)


def test_isolation_of_a_lone_box(spark):
    df = spark.createDataFrame([("f", 1, 0.0, 0.0, 10.0, 10.0), ("g", 1, 0.0, 0.0, 10.0, 10.0), ("g", 2, 5.0, 0.0, 15.0, 10.0)], "key string, row long, x1 double, y1 double, x2 double, y2 double")
    got = {(r["key"], r["row"]): round(r["isolation"], 6) for r in pairs.isolation(df, ["key"], "row").collect()}
    assert got == {("f", 1): 1.0, ("g", 1): round(2 / 3, 6), ("g", 2): round(2 / 3, 6)}


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
