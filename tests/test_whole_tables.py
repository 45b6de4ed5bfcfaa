"""Queries over whole tables, where SQL names a part of one."""

import pytest

from cadastra.plans import catalog

SF = "/root/testdata/sf0.01"
catalog.load()
GRIDS = {
    "planar_arrangement": lambda i, k: {"edges": 2 * k * (k + 1), "nodes": (k + 1) ** 2},
    "planar_faces": lambda i, k: {"faces": k * k, "area": 10000.0, "legs": 4},
    "face_closure": lambda i, k: {"rings": k * k, "passed": k * k - 1, "theta": 12.0},
    "link_validation": lambda i, k: {"status": "not_evaluable", "reason": "invalid_edge_99999", "misclosure": None} if i % 2 else {"status": "evaluated", "reason": None, "misclosure": 0.0},
    "course_flags": lambda i, k: {"courses": 2 * k * (k + 1), "clean": 2 * k * (k + 1) - 1, "flagged": 1},
}


@pytest.mark.parametrize("name", GRIDS)
def test_grids_of_all_suppliers(spark, name):
    keys = [r.s_suppkey for r in spark.read.parquet(f"{SF}/supplier.parquet").select("s_suppkey").collect()]
    got = {r.sheet: r.asDict() for r in catalog.QUERIES[name](spark, SF).collect()}
    assert max(keys) >= 40 and got == {i: {"sheet": i, **GRIDS[name](i, 2 + i % 3)} for i in keys}


def test_every_event_is_paired(spark):
    rows = catalog.QUERIES["pair_by_position"](spark, SF)
    got = rows.selectExpr("count(b) + count(d) AS n").first().n
    assert got == spark.read.parquet(f"{SF}/events.parquet").where("event_id is not null and user_id is not null and value is not null").count()


def test_every_curve_is_recovered(spark):
    sf = "/root/testdata/sf0.001"
    v = catalog.QUERIES["curve_recovery"](spark, sf).collect()
    parts = spark.read.parquet(f"{sf}/part.parquet").where("p_size * 1.5 >= 15 and p_retailprice > 0").selectExpr("p_partkey % 5 AS s", "p_retailprice AS r").distinct().collect()
    assert {(r.sheet, r.radius) for r in v} == {(p.s, p.r) for p in parts} and len(parts) > 60
    assert all(r.status != "NOT FOUND" for r in v)


def test_every_part_is_fitted(spark):
    got = {r.k: r for r in catalog.QUERIES["circle_fits"](spark, SF).collect()}
    n = spark.read.parquet(f"{SF}/part.parquet").where("p_retailprice > 0").count()
    assert sorted(got) == list(range(50)) and sum(r.n for r in got.values()) == 6 * n
    assert all((r.cx, r.cy, r.r) == (10.0, -5.0, 50.0 + k) for k, r in got.items())


def test_urls_with_a_plus_have_names(spark, tmp_path):
    spark.createDataFrame([(1, "http://a.b/c+d%20e/"), (2, "http://a.b/x")], "page_id bigint, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.name for r in catalog.QUERIES["url_names"](spark, str(tmp_path)).collect()}
    assert got == {1: "c+d e", 2: "x"}
