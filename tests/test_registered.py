"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from sightline import catalog, catalog_more  # noqa: F401

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    yield con
    con.close()


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return float("%.10g" % (float(v) + 0.0))
    return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else v


#: One or two of each family; all of them are compared by the driver.
NAMES = ["box_round_trips", "box_repairs", "crop_pixels", "sample_positions", "letterbox_points", "calibrated_points", "unit_vectors", "appearance_costs", "centroid_topk", "centroid_capacity", "retrieval_topk", "retrieval_rerank"]
NAMES += ["nms_soft", "nms_neighborhood", "detector_candidates", "detector_suppressed", "detector_decode", "mtmc_spatial_pairs", "mtmc_gated_pairs", "eval_clear_lanes", "eval_identity_lanes", "eval_hota_lanes", "eval_without_ignored"]


@pytest.mark.parametrize("name", NAMES)
def test_registered_query(spark, duck, name):
    found = catalog.QUERIES[name](spark, SMALL)
    columns = sorted(found.columns)
    told = duck.execute(catalog.ORACLE_SQL[name])
    at = [d[0] for d in told.description]
    assert sorted(at) == columns
    got = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    want = sorted((tuple(plain(r[at.index(c)]) for c in columns) for r in told.fetchall()), key=repr)
    assert got == want
