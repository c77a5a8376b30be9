"""More registered queries: scalar functions, detector output, cross-camera pairs, and scenes whose tracks and scores have a closed form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import DET, FRAME, IOU, ORACLE_SQL, OVER, REID, SIM, det, query, rounded, rounded_pairs
from .functions import boxes, costs, vectors
from .operators import crosscamera, detection, evaluation, pairs, retrieval, tracking
from .plans import views

# boxes and vectors


@query(
    "box_round_trips",
    f"""WITH {DET}, c AS (SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, (x2 - x1) / greatest(y2 - y1, 1e-6) AS aspect, y2 - y1 AS h, x2 - x1 AS w FROM det)
SELECT camera, frame_id, det_idx, round(cx - aspect * h / 2, 6) AS ax1, round(cy - h / 2, 6) AS ay1, round(cx + aspect * h / 2, 6) AS ax2, round(cy + h / 2, 6) AS ay2,
  cx - w / 2 AS wx1, cy - h / 2 AS wy1, cx + w / 2 AS wx2, cy + h / 2 AS wy2 FROM c""",
)
def box_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes.Box.of()
    by_aspect, by_size = boxes.from_cxcyah(*boxes.to_cxcyah(b)), boxes.from_cxcywh(*boxes.to_cxcywh(b))
    made = [F.round(v, 6).alias(f"{p}{c}") for p, box in (("a", by_aspect), ("w", by_size)) for c, v in zip(pairs.CORNERS, box)]
    return det(spark, sf_dir).select(*FRAME, "det_idx", *made)


@query(
    "box_repairs",
    f"""WITH {DET} SELECT camera, frame_id, det_idx, x1 AS sx1, greatest(x1, x2 - 70) AS sx2, y1 AS sy1, greatest(y1, y2 - 110) AS sy2, round(least(greatest(score * 1.0005, 0), 1), 6) AS checked,
  (sign(10 * (score - 0.8)) * floor(abs(10 * (score - 0.8)) + 0.5))::INT AS class_rounded, round((least(greatest(score, 0.6), 0.9) - 0.6) / 0.3, 6) AS ramp FROM det""",
)
def box_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes.Box.of()
    mended = boxes.widened(boxes.Box(b.x1, b.y1, b.x2 - 70, b.y2 - 110))
    score = F.col("score")
    return det(spark, sf_dir).select(
        *FRAME, "det_idx", mended.x1.alias("sx1"), mended.x2.alias("sx2"), mended.y1.alias("sy1"), mended.y2.alias("sy2"), F.round(boxes.checked_score(score * 1.0005), 6).alias("checked"),
        boxes.rounded_class(10 * (score - 0.8)).alias("class_rounded"), F.round(costs.ramp(score, 0.6, 0.9), 6).alias("ramp"),
    )


@query(
    "crop_pixels",
    f"""WITH {DET}, f AS (SELECT *, least(greatest(floor(x1 / 3 + 0.001), 0), 119)::BIGINT AS l, least(greatest(floor(y1 / 3 + 0.001), 0), 89)::BIGINT AS t FROM det)
SELECT camera, frame_id, det_idx, l AS crop_left, t AS crop_top, least(greatest(ceil(x2 / 3 - 0.001)::BIGINT, l + 1), 120) AS crop_right, least(greatest(ceil(y2 / 3 - 0.001)::BIGINT, t + 1), 90) AS crop_bottom FROM f""",
)
def crop_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes.Box.of()
    found = boxes.crop_bounds(boxes.Box(*[v / 3 for v in b]), F.lit(90).cast("long"), F.lit(120).cast("long"))
    return det(spark, sf_dir).select(*FRAME, "det_idx", *[v.alias(f"crop_{n}") for n, v in zip(("left", "top", "right", "bottom"), found)])


@query(
    "sample_positions",
    """WITH p AS (SELECT p_partkey, p_size::DOUBLE AS lo, (p_size + 5 + p_partkey % 7)::DOUBLE AS hi, unnest(range(6)) AS pos FROM part)
SELECT p_partkey, pos::INT AS pos, round(least(greatest(lo + (pos + 0.5) * (hi - lo) / 6 - 0.5, lo), hi), 6) AS crop_centre, round((pos + 0.5) * (15.0 / 6) - 0.5, 6) AS resize_centre FROM p""",
)
def sample_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = views.table(spark, sf_dir, "part").withColumns({"lo": F.col("p_size").cast("double"), "hi": (F.col("p_size") + 5 + F.col("p_partkey") % 7).cast("double")})
    both = F.arrays_zip(boxes.crop_centres(F.col("lo"), F.col("hi"), 6).alias("c"), boxes.resize_centres(15, 6).alias("r"))
    rows = part.select("p_partkey", F.posexplode(both).alias("pos", "v"))
    return rows.select("p_partkey", "pos", F.round("v.c", 6).alias("crop_centre"), F.round("v.r", 6).alias("resize_centre"))


@query(
    "letterbox_points",
    f"""WITH {DET}, s AS (SELECT *, least(640::FLOAT / 1083::FLOAT, 640::FLOAT / 1920::FLOAT)::FLOAT AS scale FROM det),
r AS (SELECT *, floor((1083::FLOAT * scale)::FLOAT + 0.5::FLOAT)::INT AS rh, floor((1920::FLOAT * scale)::FLOAT + 0.5::FLOAT)::INT AS rw FROM s), p AS (SELECT *, (640 - rh) // 2 AS top, (640 - rw) // 2 AS lft FROM r),
u AS (SELECT camera, frame_id, det_idx, k, CASE k WHEN 0 THEN x1 ELSE x2 END AS x, CASE k WHEN 0 THEN y1 ELSE y2 END AS y, score, scale, top, lft FROM p, (SELECT unnest([0, 1]) AS k))
SELECT camera, frame_id, det_idx, k, round(least(greatest((x - lft) / scale::DOUBLE, 0), 1920), 3) AS px, round(least(greatest((y - top) / scale::DOUBLE, 0), 1083), 3) AS py, round(score, 6) AS visible FROM u""",
)
def letterbox_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = boxes.Letterbox.plan(F.lit(1083), F.lit(1920), 640, 640)
    points = plan.invert_points(F.array(*[F.array(F.col(f"x{k}"), F.col(f"y{k}"), F.col("score")) for k in (1, 2)]))
    rows = det(spark, sf_dir).select(*FRAME, "det_idx", F.posexplode(points).alias("k", "p"))
    return rows.select(*FRAME, "det_idx", "k", F.round(F.col("p")[0], 3).alias("px"), F.round(F.col("p")[1], 3).alias("py"), F.round(F.col("p")[2], 6).alias("visible"))


@query(
    "calibrated_points",
    f"""WITH {DET}, f AS (SELECT *, (x1 + x2) / 2 AS x, y2 AS y, CASE WHEN det_idx % 5 = 0 THEN 0 ELSE 640 END AS live FROM det)
SELECT camera, frame_id, det_idx, round(CASE WHEN live > 0 THEN x * 1920 / live ELSE x END, 6) AS cx, round(y * 1080 / 480, 6) AS cy FROM f""",
)
def calibrated_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foot points scaled to the calibration's frame; an unknown extent leaves them."""
    x, y = boxes.foot_point(boxes.Box.of(), F.lit(10_000))
    live = F.when(F.col("det_idx") % 5 == 0, 0).otherwise(640)
    cx, cy = boxes.to_calibration(x, y, (live, F.lit(480)), (F.lit(1920), F.lit(1080)))
    return det(spark, sf_dir).select(*FRAME, "det_idx", F.round(cx, 6).alias("cx"), F.round(cy, 6).alias("cy"))


@query(
    "unit_vectors",
    f"""WITH {REID}, n AS (SELECT entry_id, vector, list_transform(vector, lambda x: 3 * x) AS far, sqrt(list_dot_product(vector, vector)) AS size FROM gallery WHERE vector IS NOT NULL)
SELECT entry_id, round(size, 6) AS size, abs(size - 1) <= 1e-4 AS is_unit, abs(3 * size - 1) <= 1e-4 AS far_is_unit, round(far[1] / (3 * size), 6) AS first, round(far[len(far)] / (3 * size), 6) AS last FROM n""",
)
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = views.gallery(spark, sf_dir).where("vector IS NOT NULL")
    far = vectors.scaled(F.col("vector"), F.lit(3.0))
    made = g.select("entry_id", F.round(vectors.norm(F.col("vector")), 6).alias("size"), vectors.is_normalised(F.col("vector")).alias("is_unit"), vectors.is_normalised(far).alias("far_is_unit"), vectors.unit(far).alias("u"))
    return made.select("entry_id", "size", "is_unit", "far_is_unit", F.round(F.element_at("u", 1), 6).alias("first"), F.round(F.element_at("u", -1), 6).alias("last"))


@query(
    "appearance_costs",
    f"""WITH {REID}, s AS (SELECT q.query_id, g.entry_id, least(greatest(1 - list_dot_product(q.vector, g.vector), 0), 2) AS a, (g.entry_id % 20) / 20.0::DOUBLE AS geometry FROM queries q JOIN gallery g ON q.camera_id = g.camera_id)
SELECT query_id, entry_id, round(a, 6) AS appearance, round(CASE WHEN geometry > 0.8 OR a > 0.9 THEN 1e5 ELSE 0.9::DOUBLE * a + (1 - 0.9::DOUBLE) * geometry END, 6) AS fused, round(CASE WHEN a > 0.9 THEN 1e5 ELSE geometry END, 6) AS vetoed,
  round(CASE WHEN geometry > 0.5 THEN 1e5 ELSE 0.75 * a + 0.25 * geometry END, 6) AS blended FROM s""",
)
def appearance_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = views.queries(spark, sf_dir).select("query_id", "camera_id", F.col("vector").alias("q"))
    met = views.gallery(spark, sf_dir).join(F.broadcast(q), "camera_id")
    looks, geometry = costs.appearance_cost(F.col("q"), F.col("vector")), (F.col("entry_id") % 20) / 20.0
    fused = costs.fused_geometry(geometry, looks, weight=0.9, appearance_gate=0.9, geometry_gate=0.8)
    out = met.select("query_id", "entry_id", looks.alias("appearance"), fused.alias("fused"), costs.vetoed(geometry, looks, 0.9).alias("vetoed"), costs.gate(looks, geometry, 0.5, weight=0.25).alias("blended"))
    return rounded(out)


# retrieval

CENTROIDS = """m AS (SELECT identity, list(vector ORDER BY entry_id) AS vs, max(entry_id) AS last_seen, max_by(camera_id, entry_id) AS camera_id FROM gallery GROUP BY identity),
f AS (SELECT identity, last_seen, camera_id, list_reduce(vs, lambda a, x: list_transform(range(1, len(x) + 1), lambda i: (0.9::DOUBLE * a[i] + 0.1::DOUBLE * x[i]) / sqrt(0.81::DOUBLE * list_dot_product(a, a) + 0.18::DOUBLE * list_dot_product(a, x) + 0.01::DOUBLE * list_dot_product(x, x)))) AS v FROM m)"""


@query(
    "centroid_topk",
    f"""WITH {REID}, {CENTROIDS}, s AS (SELECT q.query_id, f.identity, f.last_seen, round(list_dot_product(q.vector, f.v), 6) AS score FROM queries q JOIN f ON q.camera_id <> f.camera_id)
SELECT query_id, identity, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, last_seen) AS rank FROM s QUALIFY rank <= 3""",
)
def centroid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query against one vector an identity, those last seen by the query's own camera left out."""
    middle = retrieval.centroids(views.gallery(spark, sf_dir))
    out = retrieval.top_k(retrieval.similarities(views.queries(spark, sf_dir), middle, round_to=6), 3, exclude_camera=True)
    return out.select("query_id", "identity", "score", "rank")


@query(
    "centroid_capacity",
    f"WITH {REID}, s AS (SELECT identity, max(entry_id) AS last_seen, count(*) AS observations, max_by(camera_id, entry_id) AS camera_id FROM gallery GROUP BY identity) SELECT * FROM s ORDER BY last_seen DESC LIMIT 4",
)
def centroid_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bounded centroid gallery keeps the identities seen last."""
    return retrieval.centroids(views.gallery(spark, sf_dir), capacity=4).select("identity", "last_seen", "observations", "camera_id")


@query(
    "ranking_at",
    f"""WITH {REID}, s AS (SELECT q.query_id, g.entry_id, {SIM} AS score, (q.identity = g.identity)::INT AS hit FROM queries q CROSS JOIN gallery g WHERE NOT (q.identity = g.identity AND q.camera_id = g.camera_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS rank FROM s), p AS (SELECT query_id, min(rank) AS first FROM r WHERE hit = 1 GROUP BY query_id)
SELECT round(avg((first <= 10)::INT), 6) AS rank_10 FROM p""",
)
def ranking_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(retrieval.rank_at(retrieval.evaluate_search(views.queries(spark, sf_dir), views.gallery(spark, sf_dir), round_to=6), 10))


NODES = """n AS (SELECT 0 AS side, query_id AS id, vector AS v FROM queries UNION ALL SELECT 1, entry_id, vector FROM gallery),
p0 AS (SELECT a.side AS si, a.id AS i, b.side AS sj, b.id AS j, 1 - list_dot_product(a.v, b.v) AS d FROM n a CROSS JOIN n b),
p AS MATERIALIZED (SELECT si, i, sj, j, d / greatest(max(d) OVER (PARTITION BY si, i), 1e-12) AS d FROM p0),
near AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY si, i ORDER BY d, sj, j) - 1 AS r FROM p QUALIFY r <= 10),
full_ AS MATERIALIZED (SELECT a.si, a.i, a.sj, a.j FROM near a JOIN near b ON a.sj = b.si AND a.j = b.i AND b.sj = a.si AND b.j = a.i),
half AS MATERIALIZED (SELECT a.si, a.i, a.sj, a.j FROM near a JOIN near b ON a.sj = b.si AND a.j = b.i AND b.sj = a.si AND b.j = a.i WHERE a.r <= 5 AND b.r <= 5),
size AS (SELECT si, i, count(*) AS n FROM half GROUP BY ALL),
met AS (SELECT f.si, f.i, f.sj AS sc, f.j AS c, count(*) AS m FROM full_ f JOIN half h ON h.si = f.sj AND h.i = f.j JOIN full_ g ON g.si = f.si AND g.i = f.i AND g.sj = h.sj AND g.j = h.j GROUP BY ALL),
more AS (SELECT met.si, met.i, h.sj, h.j FROM met JOIN size ON size.si = met.sc AND size.i = met.c JOIN half h ON h.si = met.sc AND h.i = met.c WHERE met.m * 3 > size.n * 2),
sets AS (SELECT * FROM full_ UNION SELECT * FROM more),
w0 AS (SELECT si, i, sj, j, exp(-d) AS w FROM sets JOIN p USING (si, i, sj, j)), w1 AS MATERIALIZED (SELECT si, i, sj, j, w / sum(w) OVER (PARTITION BY si, i) AS w FROM w0),
w AS MATERIALIZED (SELECT f.si, f.i, w1.sj, w1.j, sum(w) / 3 AS w FROM near f JOIN w1 ON w1.si = f.sj AND w1.i = f.j WHERE f.r < 3 GROUP BY ALL),
s AS (SELECT a.i AS q, b.i AS g, sum(least(a.w, b.w)) AS s FROM w a JOIN w b ON a.sj = b.sj AND a.j = b.j WHERE a.si = 0 AND b.si = 1 GROUP BY ALL)"""


#: k-reciprocal re-ranking of k1 = 10, k2 = 3 by windows over all pairs.
RERANK_SQL = f"""WITH {REID}, {NODES}
SELECT p.i AS query_id, p.j AS entry_id, round((1 - coalesce(s, 0) / (2 - coalesce(s, 0))) * 0.7 + p.d * 0.3, 6) AS distance FROM p LEFT JOIN s ON s.q = p.i AND s.g = p.j WHERE p.si = 0 AND p.sj = 1"""


# suppression

KEPT = f"""o AS (SELECT *, row_number() OVER (PARTITION BY camera, frame_id ORDER BY score DESC, det_idx) AS k FROM det),
n AS (SELECT camera, frame_id, k, det_idx, [k] AS kept FROM o WHERE k = 1
  UNION ALL SELECT b.camera, b.frame_id, b.k, b.det_idx, CASE WHEN EXISTS (SELECT 1 FROM o a WHERE a.camera = b.camera AND a.frame_id = b.frame_id AND list_contains(n.kept, a.k) AND {OVER} > 0.4) THEN n.kept ELSE list_append(n.kept, b.k) END
  FROM n JOIN o b ON b.camera = n.camera AND b.frame_id = n.frame_id AND b.k = n.k + 1)"""

NEIGHBORHOOD_SQL = f"""WITH RECURSIVE {DET}, {KEPT}, kept AS (SELECT o.* FROM n JOIN o USING (camera, frame_id, k) WHERE list_contains(kept, k)),
owner AS (SELECT b.camera, b.frame_id, b.k, b.score, min(a.k) AS own FROM o b JOIN kept a ON a.camera = b.camera AND a.frame_id = b.frame_id AND (a.k = b.k OR {OVER} > 0.4) GROUP BY ALL),
backed AS (SELECT camera, frame_id, own AS k, count(*) - 1 AS neighbours, sum(score) AS total FROM owner GROUP BY ALL)
SELECT camera, frame_id, det_idx, score, (row_number() OVER (PARTITION BY camera, frame_id ORDER BY k))::INT AS rank FROM kept JOIN backed USING (camera, frame_id, k) WHERE neighbours >= 1 AND total >= 1.5"""

_Z = """greatest(0, least(b.x2, z.x2) - greatest(b.x1, z.x1)) * greatest(0, least(b.y2, z.y2) - greatest(b.y1, z.y1))"""
_ZOVER = f"({_Z}) / greatest((b.x2 - b.x1) * (b.y2 - b.y1) + (z.x2 - z.x1) * (z.y2 - z.y1) - {_Z}, 1e-9)"
SOFT_SQL = f"""WITH RECURSIVE {DET}, s AS (SELECT camera, frame_id, list({{'d': det_idx, 's': score, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY score DESC, det_idx) AS items FROM det WHERE score >= 0.2 GROUP BY ALL),
n AS (SELECT camera, frame_id, NULL::BIGINT AS d, NULL::DOUBLE AS s, items FROM s
  UNION ALL SELECT camera, frame_id, b.d, b.s, list_filter(list_transform(rest, lambda z: {{'d': z.d, 's': z.s * exp(-pow({_ZOVER}, 2) / 0.5), 'x1': z.x1, 'y1': z.y1, 'x2': z.x2, 'y2': z.y2}}), lambda z: z.s >= 0.2)
  FROM (SELECT camera, frame_id, items[best] AS b, list_concat(items[1:best - 1], items[best + 1:len(items)]) AS rest FROM (SELECT *, list_position(list_transform(items, lambda z: z.s), list_max(list_transform(items, lambda z: z.s))) AS best FROM n WHERE len(items) > 0)))
SELECT camera, frame_id, d AS det_idx, round(s, 6) AS score, row_number() OVER (PARTITION BY camera, frame_id ORDER BY s DESC, d) AS rank FROM n WHERE d IS NOT NULL"""


ORACLE_SQL |= {"retrieval_rerank": RERANK_SQL, "nms_neighborhood": NEIGHBORHOOD_SQL, "nms_soft": SOFT_SQL}


# detector output

TENSOR = f"{DET}, t AS (SELECT camera * {views.FRAMES} + frame_id AS frame_id, det_idx - 1 AS row, x1, y1, x2, y2, score, class_id FROM det)"


def tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame's boxes as a detector's end-to-end output."""
    row = F.struct("det_idx", F.array(*[F.col(c).cast("double") for c in (*pairs.CORNERS, "score", "class_id")]).alias("v"))
    out = det(spark, sf_dir).groupBy((F.col("camera") * views.FRAMES + F.col("frame_id")).alias("frame_id")).agg(F.array_sort(F.collect_list(row)).alias("a"))
    return out.select("frame_id", F.transform("a", lambda x: x["v"]).alias("values"))


@query(
    "detector_candidates",
    f"WITH {TENSOR} SELECT frame_id, row::INT AS row, x1, y1, x2, y2, round(score, 6) AS score, class_id::INT AS class_id FROM t WHERE score >= 0.65",
)
def detector_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detection.candidates(tensors(spark, sf_dir), conf_threshold=0.65)
    return found.select("frame_id", "row", *pairs.CORNERS, F.round("score", 6).alias("score"), "class_id")


@query(
    "detector_suppressed",
    f"""WITH RECURSIVE {TENSOR}, o AS (SELECT *, row_number() OVER (PARTITION BY frame_id, class_id ORDER BY score DESC, row) AS k FROM t WHERE score >= 0.65),
n AS (SELECT frame_id, class_id, k, row, score, [k] AS kept FROM o WHERE k = 1
  UNION ALL SELECT b.frame_id, b.class_id, b.k, b.row, b.score, CASE WHEN EXISTS (SELECT 1 FROM o a WHERE a.frame_id = b.frame_id AND a.class_id = b.class_id AND list_contains(n.kept, a.k) AND {OVER} > 0.45) THEN n.kept ELSE list_append(n.kept, b.k) END
  FROM n JOIN o b ON b.frame_id = n.frame_id AND b.class_id = n.class_id AND b.k = n.k + 1)
SELECT frame_id, row::INT AS row, class_id::INT AS class_id, round(score, 6) AS score, row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, row) AS rank FROM n WHERE list_contains(kept, k) QUALIFY rank <= 4""",
)
def detector_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detection.suppressed(detection.candidates(tensors(spark, sf_dir), conf_threshold=0.65), method="classic", max_detections=4)
    return found.select("frame_id", "row", "class_id", F.round("score", 6).alias("score"), "rank")


@query(
    "detector_decode",
    f"""WITH {TENSOR}, k AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, row) AS rank FROM t WHERE score >= 0.65 QUALIFY rank <= 3),
s AS (SELECT *, least(640::FLOAT / 1080::FLOAT, 640::FLOAT / 1920::FLOAT)::FLOAT AS scale FROM k)
SELECT frame_id, (rank - 1)::INT AS pos, round((least(greatest(x1 / scale::DOUBLE, 0), 1920)::FLOAT)::DOUBLE, 2) AS x1, round((least(greatest((y1 - 140) / scale::DOUBLE, 0), 1080)::FLOAT)::DOUBLE, 2) AS y1,
  round((least(greatest(x2 / scale::DOUBLE, 0), 1920)::FLOAT)::DOUBLE, 2) AS x2, round((least(greatest((y2 - 140) / scale::DOUBLE, 0), 1080)::FLOAT)::DOUBLE, 2) AS y2, class_id::INT AS class_id FROM s""",
)
def detector_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = tensors(spark, sf_dir)
    frames = made.select(F.lit("cam").alias("camera_id"), "frame_id", F.lit(1080).alias("height"), F.lit(1920).alias("width"))
    items = detection.decode(made, frames, (640, 640), conf_threshold=0.65, max_detections=3).select("frame_id", F.posexplode("items").alias("pos", "d"))
    return items.select("frame_id", "pos", *[F.round(F.col(f"d.{c}").cast("double"), 2).alias(c) for c in pairs.CORNERS], "d.class_id")


# cross-camera pairs on the map

SEEN = f"""{DET}, seen AS (SELECT 'g' AS group_id, frame_id AS instant, 'cam' || camera AS camera_id, det_idx AS track_id, score, (x1 + x2) / 2 * 2 + 10 * camera AS gx, y2 * 1.5 + 5 * camera AS gy FROM det),
met AS (SELECT a.instant, a.camera_id AS a_camera, a.track_id AS a_track, b.camera_id AS b_camera, b.track_id AS b_track, sqrt(pow(a.gx - b.gx, 2) + pow(a.gy - b.gy, 2)) AS d,
  a.score * b.score + sqrt(1 - a.score * a.score) * sqrt(1 - b.score * b.score) AS s FROM seen a JOIN seen b USING (group_id, instant) WHERE a.camera_id < b.camera_id)"""


def seen_on_map(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Boxes as observations with a vector of two places, and a map for each camera."""
    s = F.col("score")
    look = F.array(s, F.sqrt(1 - s * s))
    seen = det(spark, sf_dir).select(F.lit("g").alias("group_id"), F.col("frame_id").alias("instant"), F.concat(F.lit("cam"), "camera").alias("camera_id"), F.col("det_idx").alias("track_id"), *pairs.CORNERS, look.alias("embedding"), F.lit(400).alias("frame_h"), F.lit(400).alias("frame_w"))
    rows = [(f"cam{k}", [1.0, 0.0, 10.0 * k, 0.0, 1.0, 5.0 * k, 0.0, 0.0, 1.0], 800, 600) for k in range(4)]
    return seen, spark.createDataFrame(rows, "camera_id string, matrix array<double>, camera_width int, camera_height int")


def map_query(name: str, similarity: str, **parameters) -> None:
    sql = f"""WITH {SEEN}, v AS (SELECT *, {similarity} AS v FROM met)
SELECT instant, a_camera, a_track, b_camera, b_track, round(d, 5) AS ground, round(v, 5) AS similarity, round(CASE WHEN v > 0 THEN 1 - v ELSE 1e5 END, 5) AS distance FROM v"""

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        seen, maps = seen_on_map(spark, sf_dir)
        out = crosscamera.distances(seen, maps, **parameters).withColumn("ground", crosscamera.ground_distance())
        out = out.select("instant", F.col("a_camera_id").alias("a_camera"), F.col("a_track_id").alias("a_track"), F.col("b_camera_id").alias("b_camera"), F.col("b_track_id").alias("b_track"), "ground", "similarity", "distance")
        return rounded_pairs(out, 5)


map_query("mtmc_spatial_pairs", "CASE WHEN d < 120 THEN 1 - d / 120 ELSE 0 END", matcher="spatial", spatial_threshold=120.0)
map_query("mtmc_gated_pairs", "CASE WHEN d < 150 AND s > 0.97 THEN s ELSE 0 END", matcher="gated", spatial_threshold=150.0, appearance_threshold=0.97, width=2)


# evaluation on lanes: an object overlaps its own prediction alone, so every match is forced

LANES = f"""{DET}, gt AS (SELECT camera, frame_id, det_idx AS id, 100.0 * det_idx AS x1, 0.0 AS y1, 100.0 * det_idx + 40 AS x2, 80.0 AS y2, l_orderkey FROM det),
pred AS (SELECT camera, frame_id, id + 100 * (1 + (frame_id + 31 * id) // 700 % 3) AS id, x1 + 4 * (l_orderkey % 5) AS x1, y1, x2 + 4 * (l_orderkey % 5) AS x2, y2 FROM gt WHERE l_orderkey % 7 <> 0),
pairs AS (SELECT camera, frame_id, a.id AS gt, b.id AS pred, {OVER} AS iou FROM gt a JOIN pred b USING (camera, frame_id) WHERE {IOU} > 0),
sizes AS (SELECT camera, frame_id, coalesce(g, 0) AS g, coalesce(p, 0) AS p FROM (SELECT camera, frame_id, count(*) AS g FROM gt GROUP BY ALL) FULL JOIN (SELECT camera, frame_id, count(*) AS p FROM pred GROUP BY ALL) USING (camera, frame_id)),
totals AS (SELECT camera, sum(g) AS g, sum(p) AS p FROM sizes GROUP BY camera)"""


def lanes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    d = det(spark, sf_dir).select(F.concat(F.lit("cam"), "camera").alias("sequence"), "frame_id", F.col("det_idx").alias("id"), "l_orderkey")
    left = 100.0 * F.col("id")
    truth = d.withColumns({"x1": left, "y1": F.lit(0.0), "x2": left + 40, "y2": F.lit(80.0)})
    shift = 4 * (F.col("l_orderkey") % 5)
    name = F.col("id") + 100 * (1 + F.floor((F.col("frame_id") + 31 * F.col("id")) / 700) % 3)
    predicted = truth.where("l_orderkey % 7 <> 0").withColumns({"x1": F.col("x1") + shift, "x2": F.col("x2") + shift, "id": name})
    sequences = d.select("sequence").distinct().withColumn("length", F.lit(views.FRAMES))
    return truth.drop("l_orderkey"), predicted.drop("l_orderkey"), sequences


def with_total(sql: str, names: list[str]) -> str:
    """A table of counts named counts, with a row that sums all sequences."""
    return f"{sql}, every AS (SELECT * FROM counts UNION ALL SELECT 'COMBINED', {', '.join(f'sum({n})' for n in names)} FROM counts)"


CLEAR_COUNTS = ["tp", "fp", "fn", "idsw", "overlap_sum", "num_frames", "num_gt_ids", "mt", "pt", "ml", "frag"]
CLEAR_SQL = with_total(
    f"""WITH {LANES}, both_ AS (SELECT camera, frame_id, row_number() OVER (PARTITION BY camera ORDER BY frame_id) AS n FROM sizes WHERE g > 0 AND p > 0),
m AS (SELECT camera, n, gt, pred, iou, lag(pred) OVER w AS was, lag(n) OVER w AS before FROM pairs JOIN both_ USING (camera, frame_id) WHERE iou >= 0.5 - 2.220446049250313e-16 WINDOW w AS (PARTITION BY camera, gt ORDER BY n)),
h AS (SELECT camera, count(*) AS tp, sum(iou) AS overlap_sum, sum((was IS NOT NULL AND was <> pred)::INT) AS idsw, sum((before IS NULL OR before < n - 1)::INT) AS segments, count(DISTINCT gt) AS tracked FROM m GROUP BY camera),
r AS (SELECT camera, id, count(*) AS n FROM gt GROUP BY ALL), c AS (SELECT camera, gt AS id, count(*) AS k FROM m GROUP BY ALL),
q AS (SELECT camera, count(*) AS num_gt_ids, sum((coalesce(k, 0) / n > 0.8)::INT) AS mt, sum((coalesce(k, 0) / n BETWEEN 0.2 AND 0.8)::INT) AS pt, sum((coalesce(k, 0) / n < 0.2)::INT) AS ml FROM r LEFT JOIN c USING (camera, id) GROUP BY camera),
counts AS (SELECT 'cam' || camera AS sequence, tp, p - tp AS fp, g - tp AS fn, idsw, overlap_sum, {views.FRAMES} AS num_frames, num_gt_ids, mt, pt, ml, segments - tracked AS frag FROM totals JOIN h USING (camera) JOIN q USING (camera))""",
    CLEAR_COUNTS,
)


@query("eval_clear_lanes", CLEAR_SQL + """ SELECT sequence, round(1 - (fn + fp + idsw) / (tp + fn), 6) AS "MOTA", round(overlap_sum / tp, 6) AS "MOTP", round(tp / (tp + fn), 6) AS "Recall", round(tp / (tp + fp), 6) AS "Precision", round(fp / num_frames, 6) AS "FPPF",
  tp::BIGINT AS "TP", fp::BIGINT AS "FP", fn::BIGINT AS "FN", idsw::BIGINT AS "IDSW", mt::BIGINT AS "MT", pt::BIGINT AS "PT", ml::BIGINT AS "ML", frag::BIGINT AS "Frag" FROM every""")
def eval_clear_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.clear_scores(evaluation.combined(evaluation.clear_counts(*lanes(spark, sf_dir)))))


IDENTITY_SQL = with_total(
    f"""WITH {LANES}, c AS (SELECT camera, gt, pred, count(*) AS n FROM pairs WHERE iou >= 0.5 - 2.220446049250313e-16 GROUP BY ALL), b AS (SELECT camera, sum(n) AS idtp FROM (SELECT camera, gt, max(n) AS n FROM c GROUP BY ALL) GROUP BY camera),
counts AS (SELECT 'cam' || camera AS sequence, idtp, p - idtp AS idfp, g - idtp AS idfn FROM totals JOIN b USING (camera))""",
    ["idtp", "idfp", "idfn"],
)


@query("eval_identity_lanes", IDENTITY_SQL + ' SELECT sequence, round(2 * idtp / (2 * idtp + idfp + idfn), 6) AS "IDF1", round(idtp / (idtp + idfp), 6) AS "IDP", round(idtp / (idtp + idfn), 6) AS "IDR" FROM every')
def eval_identity_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.identity_scores(evaluation.combined(evaluation.identity_counts(*lanes(spark, sf_dir)))))


HOTA_SQL = f"""WITH {LANES}, alphas AS (SELECT unnest([{', '.join(repr(a) for a in evaluation.ALPHAS)}]::DOUBLE[]) AS alpha),
n_gt AS (SELECT camera, id AS gt, count(*) AS a FROM gt GROUP BY ALL), n_pred AS (SELECT camera, id AS pred, count(*) AS b FROM pred GROUP BY ALL),
ok AS (SELECT camera, alpha, gt, pred, iou FROM pairs, alphas WHERE iou >= alpha - 2.220446049250313e-16), h AS (SELECT camera, alpha, count(*) AS tp, sum(iou) AS overlap FROM ok GROUP BY ALL),
t AS (SELECT camera, alpha, gt, pred, count(*)::DOUBLE AS n FROM ok GROUP BY ALL),
s AS (SELECT camera, alpha, sum(n * n / (a + b - n)) AS ass, sum(n * n / a) AS ass_re, sum(n * n / b) AS ass_pr FROM t JOIN n_gt USING (camera, gt) JOIN n_pred USING (camera, pred) GROUP BY ALL),
counts AS (SELECT 'cam' || camera AS sequence, alpha, coalesce(tp, 0)::DOUBLE AS tp, g - coalesce(tp, 0) AS fn, p - coalesce(tp, 0) AS fp, coalesce(ass, 0) AS ass, coalesce(ass_re, 0) AS ass_re, coalesce(ass_pr, 0) AS ass_pr, coalesce(overlap, 0) AS overlap
  FROM totals CROSS JOIN alphas LEFT JOIN h USING (camera, alpha) LEFT JOIN s USING (camera, alpha)),
every AS (SELECT * FROM counts UNION ALL SELECT 'COMBINED', alpha, sum(tp), sum(fn), sum(fp), sum(ass), sum(ass_re), sum(ass_pr), sum(overlap) FROM counts GROUP BY alpha),
x AS (SELECT sequence, alpha, tp / greatest(1, tp + fn + fp) AS "DetA", ass / greatest(1, tp) AS "AssA", tp / greatest(1, tp + fn) AS "DetRe", tp / greatest(1, tp + fp) AS "DetPr", ass_re / greatest(1, tp) AS "AssRe", ass_pr / greatest(1, tp) AS "AssPr", greatest(1e-10, overlap) / greatest(1e-10, tp) AS "LocA" FROM every),
curves AS (SELECT *, sqrt("DetA" * "AssA") AS "HOTA" FROM x)"""
HOTA_NAMES = ["HOTA", "DetA", "AssA", "DetRe", "DetPr", "AssRe", "AssPr", "LocA"]


@query("eval_hota_lanes", HOTA_SQL + " SELECT sequence, " + ", ".join(f'round(avg("{n}"), 6) AS "{n}"' for n in HOTA_NAMES) + " FROM curves GROUP BY sequence")
def eval_hota_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.hota_scores(evaluation.combined(evaluation.hota_counts(*lanes(spark, sf_dir)), ["alpha"])))


@query("eval_hota_at", HOTA_SQL + " SELECT sequence, " + ", ".join(f'round("{n}", 6) AS "{n}"' for n in HOTA_NAMES) + " FROM curves WHERE abs(alpha - 0.5) < 1e-9")
def eval_hota_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = evaluation.combined(evaluation.hota_counts(*lanes(spark, sf_dir)), ["alpha"])
    return rounded(evaluation.hota_at(counts, 0.51).select("sequence", *HOTA_NAMES))


@query(
    "eval_without_ignored",
    f"""WITH {LANES}, gone AS (SELECT camera, frame_id, pred FROM pairs WHERE gt % 3 = 0 AND iou >= 0.5 - 2.220446049250313e-16)
SELECT 'cam' || camera AS sequence, frame_id, id FROM pred LEFT JOIN gone ON gone.camera = pred.camera AND gone.frame_id = pred.frame_id AND gone.pred = pred.id WHERE gone.pred IS NULL""".replace("SELECT 'cam' || camera", "SELECT 'cam' || pred.camera").replace("sequence, frame_id, id", "sequence, pred.frame_id, pred.id"),
)
def eval_without_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions on ignored objects do not count."""
    truth, predicted, _ = lanes(spark, sf_dir)
    return evaluation.without_ignored(predicted, truth.where("id % 3 = 0"), truth.where("id % 3 <> 0")).select("sequence", "frame_id", "id")


# trackers on a still scene: objects stand apart, miss a frame now and then, and look unlike one another

STILL = f"""{DET}, f AS (SELECT DISTINCT camera, frame_id FROM det), g AS (SELECT *, row_number() OVER (PARTITION BY camera ORDER BY frame_id) AS n FROM f),
o AS (SELECT camera, frame_id, n, k, n <= 5 OR (n + 7 * k) % 11 <> 0 AS here FROM g, (SELECT unnest(range(1, 7)) AS k)),
h AS (SELECT *, sum(here::INT) OVER (PARTITION BY camera, k ORDER BY n) AS hits FROM o)"""


def still_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = det(spark, sf_dir).select("camera", "frame_id").distinct()
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("camera").orderBy("frame_id"))
    numbered = seen.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(6))))
    here = numbered.where("n <= 5 OR (n + 7 * k) % 11 <> 0")
    k = F.col("k")
    corners = {"x1": 90.0 * k, "y1": 50.0 + 10 * k, "x2": 90.0 * k + 40, "y2": 150.0 + 10 * k}
    look = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda j: (j == F.col("k")).cast("float"))
    item = F.struct(*[v.cast("float").alias(c) for c, v in corners.items()], (0.95 - 0.05 * k).cast("float").alias("score"), (k % 3).cast("int").alias("class_id"), look.alias("embedding"))
    packed = here.groupBy("camera", "frame_id").agg(F.array_sort(F.collect_list(F.struct("k", item.alias("i")))).alias("a"))
    return packed.select(F.concat(F.lit("cam"), "camera").alias("camera_id"), "frame_id", F.lit(480).alias("height"), F.lit(640).alias("width"), F.transform("a", lambda x: x["i"]).alias("items"))


def still_query(name: str) -> None:
    sql = f"""WITH {STILL} SELECT 'cam' || camera AS camera_id, frame_id, k AS track_id, 90.0 * k AS x1, 50.0 + 10 * k AS y1, 90.0 * k + 40 AS x2, 150.0 + 10 * k AS y2, 'confirmed' AS state, round(0.95 - 0.05 * k, 3) AS score,
  (k % 3)::INT AS class_id, n::INT AS age, hits::INT AS hits, 0 AS time_since_update FROM h WHERE here AND hits >= 3"""

    @query(f"track_{name}_still", sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = tracking.track(still_scene(spark, sf_dir), name)
        doubles = [F.round(F.col(c).cast("double"), 3).alias(c) for c in (*pairs.CORNERS, "score")]
        return out.select("camera_id", "frame_id", "track_id", *doubles, "state", "class_id", "age", "hits", "time_since_update")


for _name in tracking.TRACKERS:
    still_query(_name)


# cross-camera identity on a still scene: three objects in the views of two cameras, one of which is away now and then

PLACED = f"""{DET}, f AS (SELECT DISTINCT camera, frame_id FROM det), g AS (SELECT *, row_number() OVER (PARTITION BY camera ORDER BY frame_id) AS n FROM f),
o AS (SELECT 'g' || camera AS group_id, frame_id AS instant, 'c' || v AS camera_id, 10 * v + k AS track_id, k, n FROM g, (SELECT unnest([1, 2, 3]) AS k), (SELECT unnest([0, 1]) AS v) WHERE v = 0 OR n <= 5 OR n % 7 <> 0),
h AS (SELECT *, count(*) OVER (PARTITION BY group_id, camera_id, track_id ORDER BY n) AS hits FROM o)"""


def placed_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("camera").orderBy("frame_id"))
    seen = det(spark, sf_dir).select("camera", "frame_id").distinct().withColumn("n", n)
    seen = seen.withColumn("k", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)]))).withColumn("v", F.explode(F.array(F.lit(0), F.lit(1)))).where("v = 0 OR n <= 5 OR n % 7 <> 0")
    look = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda j: (j == F.col("k")).cast("float"))
    corners = {"x1": 100 * F.col("k"), "y1": F.lit(50), "x2": 100 * F.col("k") + 50, "y2": F.lit(300)}
    return seen.select(
        F.concat(F.lit("g"), "camera").alias("group_id"), F.col("frame_id").alias("instant"), F.concat(F.lit("c"), "v").alias("camera_id"), (10 * F.col("v") + F.col("k")).cast("long").alias("track_id"),
        *[c.cast("float").alias(name) for name, c in corners.items()], look.alias("embedding"), F.lit(480).alias("frame_h"), F.lit(640).alias("frame_w"),
    )


@query("mtmc_clusters_still", f"WITH {PLACED} SELECT group_id, instant, camera_id, track_id::BIGINT AS track_id, (k - 1)::INT AS cluster FROM o")
def mtmc_clusters_still(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosscamera.clusters(placed_scene(spark, sf_dir))


@query(
    "mtmc_global_tracks_still",
    f"WITH {PLACED} SELECT group_id, instant, camera_id, track_id::BIGINT AS track_id, CASE WHEN hits >= 3 THEN k - 1 END::BIGINT AS global_id, CASE WHEN hits >= 3 THEN k - 1 END::INT AS cluster, hits::INT AS hits FROM h",
)
def mtmc_global_tracks_still(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosscamera.global_tracks(placed_scene(spark, sf_dir))
