"""Queries that answer with all pairs."""

import re

import duckdb
import numpy as np
import pytest

from sightline import catalog, catalog_more  # noqa: F401
from sightline.functions.rounding import nearest
from sightline.functions.vectors import dot

SMALL = "/root/testdata/sf0.001"
PAIRS = ["eval_pairs", "iou_pairs", "association_costs", "iou_overlapping", "direction_costs", "mtmc_gated_pairs", "mtmc_spatial_pairs"]


@pytest.mark.parametrize("digits", [5, 6, 9])
def test_nearest_rounds_as_duckdb_does(spark, digits):
    rng = np.random.default_rng(5)
    odd = [1 / 128, -1 / 128, 0.0, -0.0, 1e5, float("inf"), float("-inf"), None, 0.5, -0.5]
    ties = [(int(k) + 0.5) / 10**digits for k in rng.integers(-(10**digits), 10**digits, 2000)]
    values = [*odd, *ties, *rng.uniform(-1, 1, 2000).tolist()]
    df = spark.createDataFrame(list(enumerate(values)), "n long, x double")
    got = [r[1] for r in df.select("n", nearest(df.x, digits)).sort("n").collect()]
    told = duckdb.execute(f"SELECT [round(x, {digits}) FOR x IN $1::DOUBLE[]]", [values]).fetchone()[0]
    assert got == told
    assert np.isnan(spark.range(1).select(nearest(catalog.F.lit(float("nan")), digits)).first()[0])


@pytest.mark.parametrize("name", PAIRS)
def test_pairs_are_rounded_by_arithmetic(spark, name):
    plan = catalog.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "round(" not in plan and "rint(" in plan.lower()


def test_cosines_of_known_width_are_compiled(spark):
    rows = [(1, [0.6, 0.8], [1.0, 0.0]), (2, [0.1, 0.3], [0.7, -0.2]), (3, [0.1, None], [0.7, -0.2]), (4, None, [0.7, -0.2])]
    df = spark.createDataFrame(rows, "n int, a array<double>, b array<double>")
    known = df.select("n", dot(df.a, df.b, 2).alias("s"))
    assert "aggregate(" not in known._jdf.queryExecution().executedPlan().toString()
    assert known.collect() == df.select("n", dot(df.a, df.b).alias("s")).collect()
    with pytest.raises(Exception, match="must have 3 places"):
        df.select(dot(df.a, df.b, 3)).collect()
    plan = catalog.QUERIES["mtmc_gated_pairs"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" not in plan


@pytest.mark.parametrize("name", PAIRS)
def test_code_of_pairs_is_short_enough_to_be_compiled(spark, name):
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        plan = catalog.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan()
        code = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$").__getattr__("MODULE$").codegenString(plan)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    # HotSpot leaves methods beyond 8000 bytes to the interpreter
    assert max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)) < 8000
