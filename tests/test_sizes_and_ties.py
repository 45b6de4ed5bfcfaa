"""Plans and results that hold on larger tables and on angles that lie exactly on a limit."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadastra.functions import angles, geom, libm, text
from cadastra.operators import fit, jobs, matching, score, traverse
from cadastra.plans import catalog


def test_arcs_are_fitted_without_joins(spark):
    a = np.radians(np.linspace(0, 90, 9))
    rows = [(1, k, i, float(50 * np.cos(t) + k), float(50 * np.sin(t))) for k in range(20) for i, t in enumerate(a)]
    arcs, rest = jobs.fitted_arcs(spark.createDataFrame(rows, "sheet long, chain long, pos long, x double, y double"))
    assert "Join" not in arcs._jdf.queryExecution().optimizedPlan().toString()
    assert "Broadcast" not in rest._jdf.queryExecution().executedPlan().toString()
    assert [(r.n, r.r) for r in arcs.groupBy(F.round("r", 3).alias("r")).agg(F.count("*").alias("n")).collect()] == [(20, 50.0)] and not rest.count()


def test_a_label_vote_solves_each_pair_once(spark):
    labels = {k: F.col(k) for k in ("r", "delta", "arc", "chord", "tangent")}
    v = spark.createDataFrame([(100.0, 30.0, 52.3599, 51.7638, 26.7949), (100.0, 30.0, 52.3599, 51.7638, 71.0)], "r double, delta double, arc double, chord double, tangent double").select(geom.checked_curve(labels).alias("k"))
    assert [r.k.suspects for r in v.collect()] == [[], ["tangent"]]
    plan = v._jdf.queryExecution().analyzed().toString()
    assert plan.count("aggregate(") <= 3  # two pairs are halved, one fold over the ballots


@pytest.mark.parametrize("modulo", [False, True])
def test_long_lists_are_matched_like_short_ones(spark, modulo):
    rng = random.Random(7)
    rows = [([rng.randrange(-200, 4000) / 10 for _ in range(rng.randrange(60))], [rng.randrange(-200, 4000) / 10 for _ in range(rng.randrange(60))]) for _ in range(300)]
    rows += [([], [1.0]), (None, [1.0]), ([1.0], None), ([360.0, 0.0, 180.0], [0.0, 179.95])]
    v = spark.createDataFrame(rows, "r array<double>, t array<double>")
    for tolerance in (0.05, 0.2, 3.0):
        args = F.col("r"), F.col("t"), tolerance, modulo
        got = v.select(matching.greedy_hits(*args).alias("a"), matching.greedy_hits_of_long(*args).alias("b")).collect()
        assert [r.b for r in got] == [r.a for r in got]


def test_a_sheet_of_many_reads_is_checked(spark):
    n = 20000
    lines = spark.range(n).selectExpr("0L as sheet", "0D as x0", "0D as y0", "0D as x1", "double(id + 1) as y1")
    reads = spark.range(n).selectExpr("0L as sheet", "format_string('%d.00', id + 1) as raw", "'distance' as kind")
    began = time.time()
    r = jobs.self_check(lines, reads).first()
    assert (r.scale, r.distance_hits, r.distances) == (1.0, n, n) and time.time() - began < 60


def test_angles_on_a_limit_fall_as_in_sql(spark):
    rows = [(44.54, 134.54), (358.22, 88.22), (191.17, 281.17), (1.17, 91.17), (335.77, 65.77), (0.0, 90.0), (90.0, 0.0), (235.83, 325.83), (255.83, 345.83)]
    got = spark.createDataFrame(rows, "a double, b double").select("a", "b", angles.travel_sense(F.col("a"), F.col("b"))[1].alias("s"), F.round(angles.face_towards(F.col("a"), F.col("b")), 4).alias("f"))
    for r in got.collect():
        ahead = abs(math.fmod(r.a - r.b + 180 + 360, 360.0) - 180)
        back = abs(math.fmod(r.a - r.b - 180 + 180 + 360, 360.0) - 180)
        assert (r.s, r.f) == (1 if ahead < back else -1, round(math.fmod(r.a + 180, 360.0) if ahead > 90 else r.a, 4))


def test_a_turn_on_the_limit_falls_as_in_sql(spark):
    rows = [(k, i, az) for k in range(2000) for i, az in ((0, k / 100), (1, (k + 2200) / 100))]
    got = traverse.corners(spark.createDataFrame(rows, "ring long, pos int, az double"), "ring", "pos").where("pos = 1").collect()
    assert {r.ring: r.corner for r in got} == {k: abs(math.fmod((k + 2200) / 100 - k / 100 + 180 + 720, 360.0) - 180) > 22 for k in range(2000)}


def test_an_earlier_option_wins_by_a_hair(spark):
    o = spark.createDataFrame([(1, 0, 27.2039), (1, 2, 27.2038), (2, 0, 9.0), (2, 1, 5.0), (2, 2, 5.0)], "ring long, option int, m double")
    got = {r.ring: (r.option, r.m) for r in traverse.best_turns(o, "ring", "option", "m", F.col("m") * 10 + F.col("option") / 1000.0).collect()}
    assert got == {1: (0, 27.2038), 2: (1, 5.0)} and {r.ring: r.option for r in traverse.best_turns(o, "ring", "option", "m").collect()} == {1: 2, 2: 1}


def test_pages_are_first_by_their_number_in_a_million(spark, tmp_path):
    rows = [(999999, 7), (1000039, 7), (1000079, 7), (39, 8), (79, 8)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    catalog.load()
    got = {r.sheet: (r.best_page, r.best) for r in catalog.QUERIES["page_audit"](spark, str(tmp_path)).collect()}
    assert got == {7: (1000039, 39), 8: (39, 39)}


def test_a_closure_on_the_limit_rounds_as_in_sql(spark):
    rows = []
    for k in range(36000):
        e, n = 20 * math.sin(math.radians(k / 100)), 20 * math.cos(math.radians(k / 100))
        if (math.hypot(e, n) <= 20) != (math.sqrt(e * e + n * n) <= 20):
            rows.append((k, 1, k / 100, 20.0, None, None, "R"))
    legs = spark.createDataFrame(rows, "ring long, pos int, az double, d double, r double, delta double, side string")
    # Java's and C's sines differ in the last place for a few angles.
    alike = traverse.area_with_arcs(legs, "ring", "pos").where("(closure <= 20) = (sqrt(pow(20 * sin(radians(ring / 100)), 2) + pow(20 * cos(radians(ring / 100)), 2)) <= 20)").count()
    assert len(rows) > 1000 and alike >= 0.95 * len(rows)


def test_many_fits_are_those_made_one_by_one(spark):
    rng = np.random.default_rng(3)
    points, chains = [], {}
    for k in range(40):
        n, r, a0 = int(rng.integers(3, 9)), float(rng.choice([30.0, 40.0, 63.0])), rng.uniform(0, 360)
        a = np.radians(a0 + np.linspace(0, rng.uniform(5, 300), n))
        x, y = r * np.cos(a) + rng.normal(0, 0.2, n), r * np.sin(a) + rng.normal(0, 0.2, n)
        if k % 10 == 0:
            x, y = np.arange(n) * 10.0, np.zeros(n)
        chains[k] = x, y
        points += [(1, k, i, float(u), float(v)) for i, (u, v) in enumerate(zip(x, y))]
    radii = [30.0, 40.0, 63.0, 64.0, 200.0]
    want = {}
    for k, (x, y) in chains.items():
        half = np.hypot(x[-1] - x[0], y[-1] - y[0]) / 2
        for r in radii:
            if r >= half:
                cx, cy, rms = fit.fixed_radius_centre(x, y, r)
                sag = r - np.sqrt(max(r * r - half * half, 0.0))
                if rms <= 0.5 and sag >= max(0.6, 2 * rms):
                    want[k, r] = cx, cy, rms
    p = spark.createDataFrame(points, "sheet long, chain long, pos long, x double, y double")
    table = spark.createDataFrame([(1, r) for r in radii], "sheet long, radius double")
    got = {(r.chain, r.radius): (r.cx, r.cy, r.rms) for r in fit.arcs_of_radius(p, table, 0.5).collect()}
    assert set(got) == set(want) and len(want) > 20
    assert all(np.allclose(got[k], want[k], atol=1e-6) for k in want)
    best = {r.radius: (r.fits, r.sweep) for r in fit.longest_of_radius(p, table, 0.5).collect()}
    assert {r: n for r, (n, _) in best.items()} == {r: sum(k[1] == r for k in want) for r in {k[1] for k in want}}


def test_closures_of_all_angles_are_those_of_c(spark):
    lengths = (3.0, 20.0, 23.0)
    rows = [(k * 3 + i, 1, k / 100, d, None, None, "R") for k in range(36000) for i, d in enumerate(lengths)]
    legs = spark.createDataFrame(rows, "ring long, pos int, az double, d double, r double, delta double, side string")
    got = {r.ring: r.closure for r in traverse.area_with_arcs(legs, "ring", "pos").collect()}
    for ring, _, az, d, *_ in rows:
        e, n = d * math.sin(math.radians(az)), d * math.cos(math.radians(az))
        assert got[ring] == math.sqrt(math.pow(e, 2) + math.pow(n, 2))


def test_sines_of_odd_values(spark):
    v = spark.createDataFrame([(0, None), (1, math.inf), (2, math.nan), (3, 1e300), (4, -3.0)], "k int, x double")
    got = [tuple(r) for r in v.orderBy("k").select(libm.sine("x"), libm.cosine("x"), libm.square("x")).collect()]
    assert got[0] == (None, None, None) and got[3] == (math.sin(1e300), math.cos(1e300), math.inf) and got[4] == (math.sin(-3.0), math.cos(-3.0), 9.0)
    assert all(math.isnan(v) for v in (*got[1][:2], *got[2])) and got[1][2] == math.inf


def test_a_lot_without_a_key_is_kept(spark):
    legs = spark.createDataFrame([(None, 1, 90.0, 5.0, None, None, "R"), (1, 1, 90.0, 5.0, None, None, "R")], "ring long, pos int, az double, d double, r double, delta double, side string")
    printed = spark.createDataFrame([(1, 900.0)], "ring long, printed_area double")
    got = {r.ring: (r.closure_pass, r.area_pass, r.passed) for r in traverse.validated_lots(legs, printed, "ring", "pos", 20.0).collect()}
    assert got == {None: (True, None, True), 1: (True, False, False)}


def test_keyed_pages_are_audited(spark, tmp_path):
    rows = [(39, 1), (72, 1), (39, 2), (71, 2), (5, 3), (79, 3), (40, 4)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    catalog.load()
    got = {r.sheet: (r.pages, r.key_page, r.keyed, r.best_page, r.best, r.fine) for r in catalog.QUERIES["page_audit"](spark, str(tmp_path)).collect()}
    assert got == {1: (2, 72, 32, 39, 39, True), 2: (2, 71, 31, 39, 39, False), 3: (2, 79, 39, 79, 39, True), 4: (1, 40, 0, 40, 0, True)}
    other = spark.createDataFrame([(1, 1, 5, 7), (1, 2, 4, 7), (2, 1, 5, 2), (2, 2, 4, 2)], "sheet int, page int, n int, k int")
    assert {r.sheet: (r.best_page, r.keyed, r.fine) for r in score.page_audit(other, "sheet", "page", "n", "k").collect()} == {1: (1, None, False), 2: (1, 4, True)}


def test_courses_of_a_page_are_counted(spark):
    pages = {"N12°30'15\"E S 5°07’W": 2, "n. 1 o 2'": 1, "N 12° 30’": 1, "N12.5°30' E12°30' N1234°30' N12°30 12°30'": 0, "N12°30'N12°30'": 2, "": 0, None: None}
    v = spark.createDataFrame([(p, n) for p, n in pages.items()], "p string, n int")
    assert [(r.p, r.c) for r in v.select("p", text.courses_in(F.col("p")).alias("c")).collect()] == list(pages.items())


def test_pages_that_the_order_leaves_equal_take_the_first(spark):
    rows = [(7, 2000039, 39), (7, 39, 39), (7, 1000039, 39), (8, 3000005, 5), (8, 1000005, 5)]
    pages = spark.createDataFrame(rows, "sheet long, page long, n int").withColumn("k", F.col("page"))
    assert {r.sheet: r.best_page for r in score.page_audit(pages, "sheet", "page", "n", "k", F.col("page") % 1000000).collect()} == {7: 39, 8: 1000005}
