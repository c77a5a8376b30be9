"""Registered queries and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import boxes, costs, vectors
from .functions.rounding import nearest
from .operators import aggregate, crosscamera, evaluation, nms, pairs, retrieval, tracking
from .plans import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

DET = f"det AS ({views.DETECTIONS})"
GT = f"{DET}, gt AS ({views.TRUTH}), pred AS ({views.PREDICTIONS})"
REID = f"gallery AS ({views.GALLERY.format(doubles='DOUBLE[]')}), queries AS ({views.QUERIES.format(doubles='DOUBLE[]')})"
FRAME = ["camera", "frame_id"]
IOU = """greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"""
AREA = "greatest(0, {0}.x2 - {0}.x1) * greatest(0, {0}.y2 - {0}.y1)"
OVER = f"({IOU}) / greatest({AREA.format('a')} + {AREA.format('b')} - {IOU}, 1e-9)"
HULL = "(greatest(a.x2, b.x2) - least(a.x1, b.x1)) * (greatest(a.y2, b.y2) - least(a.y1, b.y1))"
GIOU = f"({OVER}) - ({HULL} - ({AREA.format('a')} + {AREA.format('b')} - {IOU})) / greatest({HULL}, 1e-9)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def rounded_pairs(df: DataFrame, digits: int = 6) -> DataFrame:
    """rounded() by arithmetic, for queries that answer with all pairs."""
    return df.select(*[nearest(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def det(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.detections(spark, sf_dir)


# retrieval

SIM = "round(list_dot_product(q.vector, g.vector), 6)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.similarities(views.queries(spark, sf_dir), views.gallery(spark, sf_dir), round_to=6)


@query(
    "retrieval_topk",
    f"""WITH {REID}, s AS (SELECT q.query_id, g.entry_id, {SIM} AS score FROM queries q JOIN gallery g ON q.camera_id <> g.camera_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS rank FROM s)
SELECT query_id, entry_id, score, rank, CASE WHEN rank = 1 THEN score >= 0.3 END AS accepted FROM r WHERE rank <= 5""",
)
def retrieval_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search by blocked products."""
    return retrieval.search(views.queries(spark, sf_dir), views.gallery(spark, sf_dir), 5, threshold=0.3, exclude_camera=True, round_to=6)


@query("retrieval_topk_pairs", ORACLE_SQL["retrieval_topk"])
def retrieval_topk_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search over pairs as rows."""
    out = retrieval.top_k(scored(spark, sf_dir), 5, threshold=0.3, exclude_camera=True)
    return out.select("query_id", "entry_id", "score", "rank", "accepted")


RANKED = f"""s AS (SELECT q.query_id, g.entry_id, {SIM} AS score, (q.identity = g.identity)::INT AS hit FROM queries q CROSS JOIN gallery g WHERE NOT (q.identity = g.identity AND q.camera_id = g.camera_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS rank, sum(hit) OVER (PARTITION BY query_id ORDER BY score DESC, entry_id ROWS UNBOUNDED PRECEDING) AS hits FROM s),
p AS (SELECT query_id, min(rank) AS first, round(avg(hits / rank), 6) AS ap FROM r WHERE hit = 1 GROUP BY query_id)"""


@query("ranking_per_query", f"WITH {REID}, {RANKED} SELECT query_id, first, ap FROM p")
def ranking_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(retrieval.rank_queries(views.queries(spark, sf_dir), views.gallery(spark, sf_dir), round_to=6))


@query("ranking_cmc_map", f"""WITH {REID}, {RANKED}, n AS (SELECT count(*) AS q FROM queries), m AS (SELECT avg(ap) AS map, count(*) AS evaluated FROM p)
SELECT round((SELECT avg((first <= 1)::INT) FROM p), 6) AS rank_1, round((SELECT avg((first <= 5)::INT) FROM p), 6) AS rank_5, round((SELECT avg((first <= 20)::INT) FROM p), 6) AS rank_20, round(map, 5) AS map, evaluated, q - evaluated AS skipped FROM m, n""")
def ranking_cmc_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = retrieval.evaluate_search(views.queries(spark, sf_dir), views.gallery(spark, sf_dir), round_to=6)
    return out.select(*[F.round(F.col("cmc")[k - 1], 6).alias(f"rank_{k}") for k in (1, 5, 20)], F.round("map", 5).alias("map"), "evaluated", "skipped")


@query("gallery_retention", f"WITH {REID}, k AS (SELECT entry_id, identity, row_number() OVER (PARTITION BY identity ORDER BY entry_id DESC) AS n FROM gallery) SELECT entry_id, identity FROM k WHERE n <= 16 QUALIFY row_number() OVER (ORDER BY entry_id DESC) <= 120")
def gallery_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.retained(views.gallery(spark, sf_dir), 16, 120).select("entry_id", "identity")


@query("gallery_remove_identity", f"WITH {REID} SELECT entry_id, identity FROM gallery WHERE identity NOT IN (SELECT identity FROM queries WHERE query_id % 60 = 0 AND identity IS NOT NULL)")
def gallery_remove_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = views.queries(spark, sf_dir).where("query_id % 60 = 0")
    return retrieval.without_identity(views.gallery(spark, sf_dir), gone).select("entry_id", "identity")


@query("gallery_mean_vectors", f"""WITH {REID}, x AS (SELECT identity, unnest(vector) AS v, generate_subscripts(vector, 1) AS p, 1.0 / (1 + entry_id % 3) AS w FROM gallery), s AS (SELECT identity, p, sum(v * w) AS v FROM x GROUP BY ALL),
n AS (SELECT identity, sqrt(sum(v * v)) AS n FROM s GROUP BY identity) SELECT identity, p - 1 AS pos, round(v / n, 6) AS value FROM s JOIN n USING (identity)""")
def gallery_mean_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighed = views.gallery(spark, sf_dir).withColumn("w", 1.0 / (1 + F.col("entry_id") % 3))
    out = aggregate.mean(weighed, ["identity"], weight="w")
    return rounded(out.select("identity", F.posexplode("vector").alias("pos", "value")))


@query("gallery_centroids", f"""WITH {REID}, m AS (SELECT identity, list(vector ORDER BY entry_id) AS vs, count(*) AS observations, max(entry_id) AS last_seen FROM gallery GROUP BY identity),
f AS (SELECT identity, observations, last_seen, list_reduce(vs, lambda a, x: list_transform(range(1, len(x) + 1), lambda i: (0.9::DOUBLE * a[i] + 0.1::DOUBLE * x[i]) / sqrt(0.81::DOUBLE * list_dot_product(a, a) + 0.18::DOUBLE * list_dot_product(a, x) + 0.01::DOUBLE * list_dot_product(x, x)))) AS v FROM m)
SELECT identity, observations, last_seen, generate_subscripts(v, 1) - 1 AS pos, round(unnest(v), 6) AS value FROM f""")
def gallery_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(retrieval.centroids(views.gallery(spark, sf_dir)).select("identity", "observations", "last_seen", F.posexplode("vector").alias("pos", "value")))


@query("retrieval_rerank")
def retrieval_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(retrieval.rerank(views.queries(spark, sf_dir), views.gallery(spark, sf_dir), k1=10, k2=3, max_entries=None))


@query("vector_distances", f"WITH {REID} SELECT q.query_id, g.entry_id, round(list_dot_product(q.vector, g.vector), 6) AS cosine, round(1 - list_dot_product(q.vector, g.vector), 6) AS cosine_distance, round(sqrt(greatest(0, list_dot_product(q.vector, q.vector) + list_dot_product(g.vector, g.vector) - 2 * list_dot_product(q.vector, g.vector))), 5) AS euclidean FROM queries q JOIN gallery g ON q.identity = g.identity WHERE q.query_id <> g.entry_id")
def vector_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = views.queries(spark, sf_dir).select("identity", "query_id", F.col("vector").alias("a"))
    g = views.gallery(spark, sf_dir).select("identity", "entry_id", F.col("vector").alias("b"))
    a, b = F.col("a"), F.col("b")
    met = q.join(g, "identity").where("query_id <> entry_id")
    return met.select("query_id", "entry_id", F.round(vectors.dot(a, b), 6).alias("cosine"), F.round(vectors.cosine_distance(a, b), 6).alias("cosine_distance"), F.round(vectors.euclidean_distance(a, b), 5).alias("euclidean"))


# boxes


@query("box_conversions", f"WITH {DET} SELECT camera, frame_id, det_idx, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, round((x2 - x1) / greatest(y2 - y1, 1e-6), 6) AS aspect, x2 - x1 AS width, y2 - y1 AS height, (x2 - x1) * (y2 - y1) AS area FROM det")
def box_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes.Box.of()
    cx, cy, aspect, height = boxes.to_cxcyah(b)
    return det(spark, sf_dir).select(*FRAME, "det_idx", cx.alias("cx"), cy.alias("cy"), F.round(aspect, 6).alias("aspect"), b.width().alias("width"), height.alias("height"), b.area().alias("area"))


@query("iou_pairs", f"WITH {DET} SELECT camera, frame_id, a.det_idx AS a_det, b.det_idx AS b_det, round({OVER}, 6) AS iou, round({GIOU}, 6) AS giou FROM det a JOIN det b USING (camera, frame_id) WHERE a.det_idx < b.det_idx")
def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = det(spark, sf_dir).select(*FRAME, "det_idx", *pairs.CORNERS)
    out = pairs.iou_pairs(d, d, FRAME).where("a_det_idx < b_det_idx")
    return rounded_pairs(out.select(*FRAME, F.col("a_det_idx").alias("a_det"), F.col("b_det_idx").alias("b_det"), "iou", "giou"))


@query("iou_overlapping", f"WITH {DET} SELECT camera, frame_id, a.det_idx AS a_det, b.det_idx AS b_det, round({OVER}, 6) AS iou FROM det a JOIN det b USING (camera, frame_id) WHERE a.det_idx < b.det_idx AND {IOU} > 0")
def iou_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = det(spark, sf_dir).select(*FRAME, "det_idx", *pairs.CORNERS)
    out = pairs.overlapping_pairs(d, d, FRAME).where("a_det_idx < b_det_idx")
    return rounded_pairs(out.select(*FRAME, F.col("a_det_idx").alias("a_det"), F.col("b_det_idx").alias("b_det"), "iou"))


ISOLATION = f"""w AS (SELECT camera, frame_id, a.det_idx, max({OVER}) AS worst FROM det a JOIN det b USING (camera, frame_id) WHERE a.det_idx <> b.det_idx GROUP BY ALL),
i AS (SELECT det.*, greatest(0, 1 - coalesce(worst, 0)) AS isolation FROM det LEFT JOIN w USING (camera, frame_id, det_idx))"""


@query("isolation_momentum", f"""WITH {DET}, {ISOLATION} SELECT camera, frame_id, det_idx, round(isolation, 6) AS isolation,
  round(least(greatest(0.9 + 0.1 * (1 - (least(greatest(score, 0.5), 0.8) - 0.5) / 0.3), 0.9 + 0.1 * (1 - (least(greatest(isolation, 0.5), 0.8) - 0.5) / 0.3)), 0.95), 5) AS momentum FROM i""")
def isolation_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pairs.isolation(det(spark, sf_dir).select(*FRAME, "det_idx", "score", *pairs.CORNERS), FRAME, "det_idx")
    keep = costs.appearance_momentum(F.col("score"), F.col("isolation"))
    return out.select(*FRAME, "det_idx", F.round("isolation", 6).alias("isolation"), F.round(keep, 5).alias("momentum"))


COST_SQL = f"""round(1 - ({OVER}), 9) AS iou_cost, round(1 - ({GIOU}), 9) AS giou_cost, round(1 - ({OVER}) * b.score, 9) AS fused,
  round(CASE WHEN abs(a.x1 - b.x1) > 30 THEN 1e5 ELSE 1 - ({OVER}) END, 9) AS gated, round(least(CASE WHEN 1 - ({OVER}) <= 0.8 THEN 1 - ({OVER}) ELSE 1 END, CASE WHEN abs(a.score - b.score) <= 0.25 AND 1 - ({OVER}) <= 0.8 THEN 0.5 * abs(a.score - b.score) ELSE 1 END), 9) AS min_fused"""


@query("association_costs", f"WITH {DET} SELECT camera, frame_id, a.det_idx AS a_det, b.det_idx AS b_det, {COST_SQL} FROM det a JOIN det b USING (camera, frame_id) WHERE a.det_idx <> b.det_idx")
def association_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = det(spark, sf_dir).select(*FRAME, "det_idx", "score", *pairs.CORNERS)
    a, b = boxes.Box.of("a_"), boxes.Box.of("b_")
    iou, looks = costs.iou_cost(a, b), F.abs(F.col("a_score") - F.col("b_score"))
    out = pairs.within(d, d, FRAME).where("a_det_idx <> b_det_idx").select(
        *FRAME, F.col("a_det_idx").alias("a_det"), F.col("b_det_idx").alias("b_det"), iou.alias("iou_cost"), costs.giou_cost(a, b).alias("giou_cost"), costs.fuse_score(iou, F.col("b_score")).alias("fused"),
        costs.gate(iou, F.abs(a.x1 - b.x1), 30.0).alias("gated"), costs.min_fuse(iou, looks, motion_gate=0.8, appearance_gate=0.25).alias("min_fused"),
    )
    return rounded_pairs(out, 9)


@query("direction_costs", f"""WITH {DET}, d AS (SELECT camera, frame_id, a.det_idx AS a_det, b.det_idx AS b_det, (b.x1 + b.x2 - a.x1 - a.x2) / 2 AS dx, (b.y1 + b.y2 - a.y1 - a.y2) / 2 AS dy FROM det a JOIN det b USING (camera, frame_id) WHERE a.det_idx < b.det_idx)
SELECT camera, frame_id, a_det, b_det, round(CASE WHEN sqrt(dx * dx + dy * dy) < 1e-6 THEN 0 ELSE acos(least(greatest((dx * 0.6 + dy * 0.8) / greatest(sqrt(dx * dx + dy * dy), 1e-6), -1), 1)) / pi() END, 6) AS direction FROM d""")
def direction_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = det(spark, sf_dir).select(*FRAME, "det_idx", *pairs.CORNERS)
    cost = costs.direction_cost((F.lit(0.6), F.lit(0.8)), boxes.Box.of("a_"), boxes.Box.of("b_"))
    return rounded_pairs(pairs.within(d, d, FRAME).where("a_det_idx < b_det_idx").select(*FRAME, F.col("a_det_idx").alias("a_det"), F.col("b_det_idx").alias("b_det"), cost.alias("direction")))


@query("candidate_kinds", f"""WITH {GT}, p AS (SELECT camera, frame_id, a.id AS gt, b.id AS pred, 1 - ({OVER}) AS cost FROM gt a JOIN pred b USING (camera, frame_id)),
k AS (SELECT *, count(*) FILTER (cost <= 0.5) OVER (PARTITION BY camera, frame_id, gt) AS r, count(*) FILTER (cost <= 0.5) OVER (PARTITION BY camera, frame_id, pred) AS c FROM p)
SELECT camera, frame_id, gt, pred, cost <= 0.5 AND r = 1 AND c = 1 AS clear, cost <= 0.5 AND (r > 1 OR c > 1) AS ambiguous FROM k""")
def candidate_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.candidate_kinds(views.truth(spark, sf_dir), views.predictions(spark, sf_dir), 0.5)
    return out.select(F.substring("sequence", 4, 9).cast("long").alias("camera"), "frame_id", "gt", "pred", "clear", "ambiguous")


@query("score_tiers", f"WITH {DET} SELECT camera, frame_id, det_idx, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.6 THEN 'low' END AS tier, x1 >= 20 AND y1 >= 20 AND 400 - x2 >= 20 AND 400 - y2 >= 20 AS off_border FROM det")
def score_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    away = boxes.off_border(boxes.Box.of(), F.lit(400), F.lit(400), 0.05)
    return det(spark, sf_dir).select(*FRAME, "det_idx", costs.score_tier(F.col("score"), 0.6, 0.8).alias("tier"), away.alias("off_border"))


@query("frame_filter", f"""WITH {DET}, f AS (SELECT * FROM (SELECT DISTINCT camera FROM det) CROSS JOIN (SELECT unnest(range({views.FRAMES})) AS frame_id)), n AS (SELECT camera, frame_id, count(*) AS n, count(*) FILTER (score::FLOAT >= 0.75::FLOAT AND class_id IN (65, 82)) AS kept FROM det GROUP BY ALL)
SELECT 'cam' || camera AS camera_id, frame_id, coalesce(n, 0) AS n, coalesce(kept, 0) AS kept FROM f LEFT JOIN n USING (camera, frame_id)""")
def frame_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested filtering keeps empty frames."""
    items = F.coalesce("items", F.array().cast("array<struct<score:float,class_id:int>>"))
    kept = F.filter("items", lambda d: (d["score"] >= F.lit(0.75).cast("float")) & d["class_id"].isin(65, 82))
    f = views.frames(spark, sf_dir)
    return f.select("camera_id", "frame_id", F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n"), F.when(F.col("items").isNull(), 0).otherwise(F.size(kept)).cast("long").alias("kept"))


@query("letterbox_inverse", f"""WITH {DET}, g AS (SELECT *, 1080 AS h, 1920 + (det_idx % 3) AS w FROM det), s AS (SELECT *, least(640::FLOAT / h::FLOAT, 640::FLOAT / w::FLOAT)::FLOAT AS scale FROM g),
r AS (SELECT *, least(greatest(floor((h::FLOAT * scale)::FLOAT + 0.5::FLOAT), 1), 640)::INT AS rh, least(greatest(floor((w::FLOAT * scale)::FLOAT + 0.5::FLOAT), 1), 640)::INT AS rw FROM s), p AS (SELECT *, (640 - rh) // 2 AS top, (640 - rw) // 2 AS lft FROM r)
SELECT camera, frame_id, det_idx, rh AS resized_height, rw AS resized_width, top, lft AS "left", 640 - rh - top AS bottom, 640 - rw - lft AS "right", round(least(greatest((x1 - lft) / scale::DOUBLE, 0), w), 4) AS bx1, round(least(greatest((y1 - top) / scale::DOUBLE, 0), h), 4) AS by1, round(least(greatest((x2 - lft) / scale::DOUBLE, 0), w), 4) AS bx2, round(least(greatest((y2 - top) / scale::DOUBLE, 0), h), 4) AS by2 FROM p""")
def letterbox_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = boxes.Letterbox.plan(F.lit(1080), (1920 + F.col("det_idx") % 3).cast("int"), 640, 640)
    back = plan.invert(boxes.Box.of())
    return det(spark, sf_dir).select(*FRAME, "det_idx", plan.resized_height.alias("resized_height"), plan.resized_width.alias("resized_width"), plan.top.alias("top"), plan.left.alias("left"), plan.bottom.alias("bottom"), plan.right.alias("right"), *[F.round(v, 4).alias(f"b{c}") for c, v in zip(pairs.CORNERS, back)])


MAP = [0.9, 0.1, 5.0, -0.05, 1.1, 3.0, 0.0001, 0.0002, 1.0]


@query("ground_projection", f"""WITH {DET}, f AS (SELECT camera, frame_id, det_idx, (x1 + x2) / 2 AS x, y1 + CASE WHEN y2 >= 199 THEN greatest(y2 - y1, (x2 - x1) / 0.25) ELSE y2 - y1 END AS y FROM det), w AS (SELECT *, 0.0001 * x + 0.0002 * y + 1.0 AS w FROM f)
SELECT camera, frame_id, det_idx, round((0.9 * x + 0.1 * y + 5.0) / w, 5) AS gx, round((-0.05 * x + 1.1 * y + 3.0) / w, 5) AS gy FROM w""")
def ground_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = boxes.foot_point(boxes.Box.of(), F.lit(200))
    gx, gy = boxes.project(x, y, F.array(*[F.lit(v) for v in MAP]))
    return det(spark, sf_dir).select(*FRAME, "det_idx", F.round(gx, 5).alias("gx"), F.round(gy, 5).alias("gy"))


@query("box_clamps", f"WITH {DET} SELECT camera, frame_id, det_idx, least(greatest(x1, 0), 149) AS cx1, least(greatest(y2, 0), 119) AS cy2, floor((x1 - 100) / 3 + 0.001)::BIGINT >= 0 AS inside, (sign(score - 0.8) * floor(abs(10 * (score - 0.8)) + 0.5))::INT AS class_rounded FROM det")
def box_clamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = boxes.clamped(boxes.Box.of(), F.lit(120), F.lit(150))
    left = F.floor((F.col("x1") - 100) / 3 + 0.001)
    sign = F.signum(F.col("score") - 0.8) * F.floor(F.abs(10 * (F.col("score") - 0.8)) + 0.5)
    return det(spark, sf_dir).select(*FRAME, "det_idx", c.x1.alias("cx1"), c.y2.alias("cy2"), (left >= 0).alias("inside"), sign.cast("int").alias("class_rounded"))


# suppression


@query("nms_classic", f"""WITH RECURSIVE {DET}, o AS (SELECT *, row_number() OVER (PARTITION BY camera, frame_id ORDER BY score DESC, det_idx) AS k FROM det),
n AS (SELECT camera, frame_id, k, det_idx, score, [k] AS kept FROM o WHERE k = 1
  UNION ALL SELECT b.camera, b.frame_id, b.k, b.det_idx, b.score, CASE WHEN EXISTS (SELECT 1 FROM o a WHERE a.camera = b.camera AND a.frame_id = b.frame_id AND list_contains(n.kept, a.k) AND {OVER} > 0.4) THEN n.kept ELSE list_append(n.kept, b.k) END
  FROM n JOIN o b ON b.camera = n.camera AND b.frame_id = n.frame_id AND b.k = n.k + 1)
SELECT camera, frame_id, det_idx, score, len(kept)::INT AS rank FROM n WHERE list_contains(kept, k)""")
def nms_classic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nms.suppress(det(spark, sf_dir), FRAME, "det_idx", iou_threshold=0.4)


@query("nms_neighborhood")
def nms_neighborhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nms.suppress(det(spark, sf_dir), FRAME, "det_idx", iou_threshold=0.4, method="neighborhood", min_neighbors=1, min_score_sum=1.5)


@query("nms_soft")
def nms_soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(nms.suppress(det(spark, sf_dir), FRAME, "det_idx", iou_threshold=0.4, method="gauss", score_threshold=0.2))


@query("nms_topk", f"WITH {DET} SELECT camera, frame_id, det_idx, score, row_number() OVER (PARTITION BY camera, frame_id ORDER BY score DESC, det_idx) AS rank FROM det WHERE score >= 0.6 QUALIFY rank <= 3")
def nms_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking without suppression, the best three of a frame."""
    return nms.suppress(det(spark, sf_dir), FRAME, "det_idx", iou_threshold=0.4, method="none", score_threshold=0.6, max_output=3)


# evaluation


def both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return views.truth(spark, sf_dir), views.predictions(spark, sf_dir), views.sequences(spark, sf_dir)


@query("eval_pairs", f"WITH {GT} SELECT 'cam' || camera AS sequence, frame_id, a.id AS gt, b.id AS pred, round({OVER}, 6) AS iou FROM gt a JOIN pred b USING (camera, frame_id)")
def eval_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_pairs(evaluation.pairs_of(*both(spark, sf_dir)[:2]))


@query("eval_alignment", f"""WITH {GT}, p AS (SELECT camera, frame_id, a.id AS gt, b.id AS pred, {OVER} AS iou FROM gt a JOIN pred b USING (camera, frame_id)),
s AS (SELECT *, sum(iou) OVER (PARTITION BY camera, frame_id, gt) + sum(iou) OVER (PARTITION BY camera, frame_id, pred) - iou AS rest FROM p), t AS (SELECT camera, gt, pred, sum(CASE WHEN rest > 2.220446049250313e-16 THEN iou / rest ELSE 0 END) AS potential FROM s GROUP BY ALL),
g AS (SELECT camera, id AS gt, count(*) AS n_gt FROM gt GROUP BY ALL), h AS (SELECT camera, id AS pred, count(*) AS n_pred FROM pred GROUP BY ALL)
SELECT 'cam' || camera AS sequence, gt, pred, round(potential, 5) AS potential, round(potential / greatest(1e-10, n_gt + n_pred - potential), 5) AS alignment, n_gt, n_pred FROM t JOIN g USING (camera, gt) JOIN h USING (camera, pred)""")
def eval_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.alignment(*both(spark, sf_dir)[:2]), 5)


@query("eval_sequence_sizes", f"WITH {GT}, a AS (SELECT camera, count(*) AS detections, count(DISTINCT id) AS ids, count(DISTINCT frame_id) AS frames FROM gt GROUP BY camera), s AS (SELECT 'cam' || camera AS sequence, detections, ids, frames FROM a) SELECT * FROM s UNION ALL SELECT 'COMBINED', sum(detections)::BIGINT, sum(ids)::BIGINT, sum(frames)::BIGINT FROM s")
def eval_sequence_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = views.truth(spark, sf_dir).groupBy("sequence").agg(F.count("*").alias("detections"), F.count_distinct("id").alias("ids"), F.count_distinct("frame_id").alias("frames"))
    return evaluation.combined(sizes)


@query("eval_clear")
def eval_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.clear_scores(evaluation.combined(evaluation.clear_counts(*both(spark, sf_dir)))))


@query("eval_identity")
def eval_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.identity_scores(evaluation.combined(evaluation.identity_counts(*both(spark, sf_dir)))))


@query("eval_hota")
def eval_hota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.hota_scores(evaluation.combined(evaluation.hota_counts(*both(spark, sf_dir)), ["alpha"])))


# tracking


def tracker_query(name: str) -> None:
    @query(f"track_{name}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = tracking.track(views.walkers(spark, sf_dir), name)
        return rounded(out.drop("embedding"), 3)


for _name in tracking.TRACKERS:
    tracker_query(_name)


@query("synthetic_detections")
def synthetic_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = views.walkers(spark, sf_dir).select("camera_id", "frame_id", F.posexplode("items").alias("rank", "d"))
    return rounded(items.select("camera_id", "frame_id", "rank", "d.x1", "d.y1", "d.x2", "d.y2", "d.score"), 3)


@query("camera_codes", "SELECT DISTINCT 'cam' || (l_suppkey % 4) AS camera_id, l_suppkey % 4 AS code FROM lineitem")
def camera_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cameras numbered in the order of their names."""
    return retrieval.camera_codes(det(spark, sf_dir).select(F.concat(F.lit("cam"), "camera").alias("camera_id")))


# cross-camera

VIEW = """WITH e AS (SELECT 'g' || (vec_id % 7) AS group_id, floor(vec_id / 70) AS block, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
u AS (SELECT group_id, block, vec_id, view, list_transform(v, lambda x, k: x + CASE WHEN view = 1 AND (k - 1) % 8 = vec_id % 8 THEN 0.03 ELSE 0.0 END) AS v FROM e, (SELECT unnest([0, 1]) AS view)),
n AS (SELECT group_id, block, vec_id, view, list_transform(v, lambda x: (x / greatest(sqrt(list_dot_product(v, v)), 1e-12))::FLOAT::DOUBLE) AS v FROM u),
o AS (SELECT *, (block * 5 + t)::BIGINT AS instant FROM n, (SELECT unnest(range(5)) AS t))"""


@query("mtmc_pair_distances", VIEW + """, p AS (SELECT group_id, instant, a.vec_id AS a_track, b.vec_id AS b_track, list_dot_product(a.v, b.v) AS s FROM o a JOIN o b USING (group_id, instant) WHERE a.view = 0 AND b.view = 1)
SELECT group_id, instant, a_track, b_track, round(CASE WHEN s > 0.86 THEN s ELSE 0 END, 5) AS similarity, round(CASE WHEN s > 0.86 THEN 1 - s ELSE 1e5 END, 5) AS distance FROM p""")
def mtmc_pair_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = crosscamera.distances(views.observations(spark, sf_dir))
    return rounded(out.select(*crosscamera.INSTANT, F.col("a_track_id").alias("a_track"), F.col("b_track_id").alias("b_track"), "similarity", "distance"), 5)


@query("mtmc_clusters")
def mtmc_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosscamera.clusters(views.observations(spark, sf_dir))


@query("mtmc_global_tracks")
def mtmc_global_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosscamera.global_tracks(views.observations(spark, sf_dir))
