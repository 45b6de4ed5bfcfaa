"""Graphs, matching and tolerance joins against plain loops and worked examples."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadastra.operators import fit, graph, joins, matching, ordered, score


def greedy(reads, truth, tol, mod=False):
    pool, hit = list(truth), 0
    for r in reads:
        best, at = tol, None
        for i, q in enumerate(pool):
            d = abs(q - r)
            d = min(d % 180, 180 - d % 180) if mod else d
            if d <= best:
                best, at = d, i
        if at is not None:
            hit += 1
            pool.pop(at)
    return hit


@pytest.mark.parametrize("mod", [False, True])
def test_greedy_is_the_loop(spark, mod):
    rng = random.Random(4)
    rows = [(i, sorted(round(rng.uniform(0, 180), 1) for _ in range(rng.randint(0, 12))), sorted(round(rng.uniform(0, 180), 1) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, r array<double>, t array<double>")
    got = {r.i: r.h for r in df.select("i", matching.greedy_hits(F.col("r"), F.col("t"), 3.0, modulo=mod).alias("h")).collect()}
    assert got == {i: greedy(r, t, 3.0, mod) for i, r, t in rows}


def test_candidates_use_a_read_once(spark):
    df = spark.createDataFrame([([10.0, 10.0, 200.0], [[10.0, 170.0], [20.0], []])], "t array<double>, c array<array<double>>")
    assert df.select(matching.greedy_candidate_hits(F.col("t"), F.col("c"), 0.05)).first()[0] == 2
    assert df.select(matching.greedy_candidate_hits(F.col("t"), F.col("c"), 25.0)).first()[0] == 2


def test_pairs_by_position(spark):
    df = spark.createDataFrame([([(1.0,), (5.0,)], [(4.0,), (0.5,), (9.0,)])], "b array<struct<pos:double>>, d array<struct<pos:double>>")
    got = df.select(matching.paired_by_position(F.col("b"), F.col("d"))).first()[0]
    assert [tuple(x) for x in got] == [(0, 1), (1, 0), (None, 2)]


def test_strict_takes_the_first(spark):
    df = spark.createDataFrame([([5.0], [4.0, 6.0])], "r array<double>, t array<double>")
    assert df.select(matching.greedy_hits(F.col("r"), F.col("t"), 1.0, strict=True)).first()[0] == 0
    assert df.select(matching.greedy_hits(F.col("r"), F.col("t"), 1.0)).first()[0] == 1


def test_links(spark):
    edges = spark.createDataFrame([(1, 0, 0.0, 0.0, 100.0, 0.0), (1, 1, 100.0, 0.0, 100.0, -100.0)], "sheet long, edge int, ax double, ay double, bx double, by double")

    def run(azimuths, distances, segs=((0, True), (1, True))):
        courses = spark.createDataFrame([(1, i, a, d, [] if d is not None else ["partial_course"]) for i, (a, d) in enumerate(zip(azimuths, distances))], "sheet long, edge int, azimuth double, distance double, flags array<string>")
        links = spark.createDataFrame([(1, "l", 0.0, 0.0, 100.0, 100.0, [tuple(s) for s in segs])], "sheet long, id string, start_e double, start_n double, end_e double, end_n double, segs array<struct<edge:int,forward:boolean>>")
        return graph.validated_links(links, edges, courses, F.lit(0.0)).first()

    exact = run([90.0, 0.0], [100.0, 100.0])
    assert exact.status == "evaluated" and exact.misclosure < 1e-9 and exact.precision == "exact" and not exact.beyond_tolerance
    wrong = run([90.0, 10.0], [100.0, 100.0])
    assert wrong.misclosure > 10 and wrong.beyond_tolerance
    missing = run([90.0, 0.0], [100.0, None])
    assert missing.status == "not_evaluable" and missing.reason == "edge_1_needs_one_complete_course"
    assert run([90.0, 0.0], [100.0, 100.0], ((7, True),)).reason == "invalid_edge_7"


def test_components_do_not_depend_on_order(spark):
    rng = random.Random(9)
    edges = [(rng.randint(0, 2), rng.randint(0, 80), rng.randint(0, 80)) for _ in range(110)] + [(5, i, i + 1) for i in range(60)]
    nodes = sorted({(s, n) for s, a, b in edges for n in (a, b)})
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for s, a, b in edges:
        x, y = sorted((top((s, a)), top((s, b))))
        root[y] = x
    rng.shuffle(edges)
    got = graph.connected_components(spark.createDataFrame(nodes, "sheet long, node long"), spark.createDataFrame(edges, "sheet long, a long, b long")).collect()
    assert {(r.sheet, r.node): r.component for r in got} == {n: top(n)[1] for n in nodes}


def test_faces_of_a_grid_with_spurs_and_a_triangle(spark):
    lines = [(1, i, 0.0, 100.0 * i, 400.0, 100.0 * i) for i in range(5)] + [(1, 5 + i, 100.0 * i, 0.0, 100.0 * i, 400.0) for i in range(5)]
    lines += [(1, 10, 50.0, 100.0, 50.0, 150.0), (1, 11, 400.0, 200.0, 450.0, 230.0), (1, 12, 600.0, 0.0, 700.0, 0.0), (1, 13, 700.0, 0.0, 650.0, 80.0), (1, 14, 650.0, 80.0, 600.0, 0.0)]
    segs = spark.createDataFrame(lines, "sheet long, seg int, x0 double, y0 double, x1 double, y1 double")
    legs = graph.face_legs(graph.planar_edges(segs, joins.crossings(segs))).collect()
    faces = {}
    for r in legs:
        faces.setdefault(r.face, []).append(r)
    areas = sorted(round(abs(f[0].area)) for f in faces.values())
    assert areas == [4000] + [10000] * 16
    for f in faces.values():
        f.sort(key=lambda r: r.pos)
        assert [r.pos for r in f] == list(range(len(f)))
        assert all((a.dx, a.dy) == (b.ox, b.oy) for a, b in zip(f, f[1:] + f[:1]))


def test_t_junction_with_a_gap(spark):
    segs = spark.createDataFrame([(1, 0, 0.0, 0.0, 100.0, 0.0), (1, 1, 50.0, 3.0, 50.0, 90.0)], "sheet long, seg int, x0 double, y0 double, x1 double, y1 double")
    assert sorted((r.seg, round(r.t, 6)) for r in joins.crossings(segs).collect()) == [(0, 50.0), (1, 0.0)]
    far = segs.withColumn("y0", F.when(F.col("seg") == 1, 30.0).otherwise(F.col("y0")))
    assert joins.crossings(far).count() == 0


def test_chains_end_where_three_meet(spark):
    edges = spark.createDataFrame([(1, 0, 0, 1), (1, 1, 1, 2), (1, 2, 2, 3), (1, 3, 2, 4), (1, 4, 4, 5)], "sheet long, edge int, a int, b int")
    assert {r.edge: r.chain for r in graph.chains(edges).collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3}


def test_circles_by_sums_and_by_least_squares(spark):
    a = np.linspace(0.2, 1.9, 12)
    x, y = 1000 + 63 * np.cos(a), -500 + 63 * np.sin(a)
    rows = spark.createDataFrame([(1, i, float(p), float(q)) for i, (p, q) in enumerate(zip(x, y))], "k int, i int, x double, y double")
    got = fit.circle_sums(rows, ["k"])
    c = got.first()
    assert abs(c.r - 63) < 1e-6 and abs(c.cx - 1000) < 1e-6
    assert fit.radial_residuals(rows, got, ["k"]).first().rms < 1e-6
    assert abs(fit.fit_circle(x, y)[2] - 63) < 1e-6
    cx, cy, rms = fit.fixed_radius_centre(x, y, 63.0)
    assert rms < 1e-6 and abs(cy + 500) < 1e-5
    table = spark.createDataFrame([(1, 63.0), (1, 90.0)], "sheet long, radius double")
    points = rows.select(F.lit(1).cast("long").alias("sheet"), F.lit(4).cast("long").alias("chain"), F.col("i").alias("pos"), "x", "y")
    assert [(r.chain, r.radius) for r in fit.arcs_of_radius(points, table, 0.05).collect()] == [(4, 63.0)]


def test_alignment_keeps_order_and_drops_what_does_not_fit():
    mids, lengths = np.array([25.0, 75.0, 125.0]), np.array([50.0, 50.0, 50.0])
    got = fit.align(np.array([0.0, 50.0, 100.0]), np.array([50.0, 50.0, 50.0]), mids, lengths, 1.0, 25.0)
    assert got == [(0, 0), (1, 1), (2, 2)]
    got = fit.align(np.array([0.0, 50.0, 100.0, 110.0]), np.array([50.0, 500.0, np.nan, 50.0]), mids, lengths, 1.0, 25.0)
    assert (2, 2) in got or (3, 2) in got
    assert len({j for _, j in got}) == len(got)
    assert fit.align(np.array([]), np.array([]), mids, lengths, 1.0, 25.0) == []


def test_snap_and_merge(spark):
    segs = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 0.0), (1, 1, 10.5, 0.2, 20.0, 5.0)], "sheet long, seg long, x0 double, y0 double, x1 double, y1 double")
    got = {r.seg: r for r in fit.snapped_ends(segs, 1.0).collect()}
    assert np.hypot(got[0].x1 - got[1].x0, got[0].y1 - got[1].y0) < 1e-9
    a = np.linspace(0, 2, 30)
    rows = [(1, k, i, float(50 * np.cos(t)), float(50 * np.sin(t))) for k, part in enumerate((a[:15], a[14:])) for i, t in enumerate(part)]
    rows += [(1, 9, i, 500.0 + i, 0.0) for i in range(4)]
    merged = fit.merged_chains(spark.createDataFrame(rows, "sheet long, chain long, pos long, x double, y double"), 0.5, 0.1)
    assert {r.chain: r.arc for r in merged.collect()} == {0: 0, 1: 0, 9: 9}


def test_windows_and_rings(spark):
    one = spark.range(1)
    starts = lambda n: one.select(ordered.windows_along(F.lit(n), 100, 20)).first()[0]
    assert starts(50) == [0] and starts(100) == [0] and starts(101) == [0, 80] and starts(260) == [0, 80, 160]
    v = F.array(*(F.lit(float(x)) for x in (1, 2, 3, 1)))
    pairs = lambda f: [tuple(p) for p in one.select(f(v)).first()[0]]
    assert pairs(ordered.pairs) == [(1.0, 2.0), (2.0, 3.0), (3.0, 1.0)]
    assert pairs(ordered.ring_pairs) == [(1.0, 2.0), (2.0, 3.0), (3.0, 1.0)]
    rows = spark.createDataFrame([("a", 1, 0.1), ("a", 2, 0.5), ("a", 3, 0.9)], "s string, y int, r double")
    assert ordered.first_passing(rows, ["s"], F.col("r") >= 0.3, F.col("y")).first().y == 2
    assert score.admitted(rows, "s", "r", "y").first().y == 3


def test_votes_count_samples_once(spark):
    reads = spark.createDataFrame([("s", k, "bearing", raw) for k, raw in [(0, "a"), (0, " a"), (1, "a"), (2, "b")]], "sheet string, sample int, kind string, raw string")
    assert {r.raw: r.votes for r in score.votes(reads, ["sheet"], "sample").collect()} == {"a": 2, "b": 1}
    got = {r.option: r.n for r in score.frontier(reads, ["sheet"], "sample", [("u1", 1, 1), ("u3", 3, 1), ("m2", 3, 2)]).collect()}
    assert got == {"u1": 1, "u3": 2, "m2": 1}


def test_labels_reach_as_far_as_their_size(spark):
    """Against a loop over all pairs: sizes whose reach goes over many cells, upright, level and slanting lines."""
    rng = np.random.default_rng(4)
    segs = [(1, k, *map(float, rng.uniform(-900, 900, 4))) for k in range(40)] + [(1, 40, 0.0, -500.0, 0.0, 700.0), (1, 41, -300.0, 100.0, 650.0, 100.0)]
    labels = [(1, k, *map(float, rng.uniform(-900, 900, 2)), float(rng.uniform(0, 180)), float(rng.choice([1.0, 10.0, 40.0, 120.0]))) for k in range(80)]
    got = joins.bind_labels(
        spark.createDataFrame(labels, "sheet long, label long, cx double, cy double, angle double, size double"),
        spark.createDataFrame(segs, "sheet long, seg long, x0 double, y0 double, x1 double, y1 double"),
    ).collect()
    want = {}
    for _, label, cx, cy, angle, size in labels:
        best = []
        for _, seg, x0, y0, x1, y1 in segs:
            dx, dy = x1 - x0, y1 - y0
            t = ((cx - x0) * dx + (cy - y0) * dy) / (dx * dx + dy * dy)
            d = np.hypot(cx - x0 - t * dx, cy - y0 - t * dy)
            axis = np.degrees(np.arctan2(dx, -dy)) % 180
            gap = abs(angle - axis) % 180
            if min(gap, 180 - gap) <= 20 and -0.15 <= t <= 1.15 and d < max(12.0, 4 * size):
                best.append((d, seg))
        if best:
            want[label] = min(best)[1]
    assert {r.label: r.seg for r in got} == want and len(want) > 20


def test_arcs_take_in_only_curved_neighbours(spark):
    def chains(*parts):
        rows = [(1, k, i, float(x), float(y)) for k, part in enumerate(parts) for i, (x, y) in enumerate(part)]
        return spark.createDataFrame(rows, "sheet long, chain long, pos long, x double, y double")

    turn = lambda a, b, r, n=12: [(r * np.cos(t), r * np.sin(t)) for t in np.linspace(a, b, n)]
    line = [(50.0, -y) for y in (0.0, 5.0, 10.0, 15.0)]
    got = fit.merged_chains(chains(turn(0, 0.5, 50), turn(1.0, 0.5, 50), line), 0.5, 0.1).collect()
    assert {r.chain: r.arc for r in got} == {0: 0, 1: 0, 2: 2}
    flat = fit.merged_chains(chains(turn(0, 0.02, 900, 6), turn(0.02, 0.04, 900, 6)), 0.5, 0.35).collect()
    assert {r.chain: r.arc for r in flat} == {0: 0, 1: 1}  # nearly straight: the radius is beyond the greatest
    assert fit.merged_chains(chains([(0.0, 0.0)])).count() == 0


def test_snapping_is_strict_and_drops_what_collapses(spark):
    schema = "sheet long, seg long, x0 double, y0 double, x1 double, y1 double"
    rows = [(1, 0, 0.0, 0.0, 10.0, 0.0), (1, 1, 12.0, 0.0, 20.0, 0.0), (1, 2, 5.0, 0.3, 5.0, 0.8), (1, 3, 40.0, 40.0, 40.0, 40.0), (1, 4, 41.0, 40.0, 60.0, 40.0)]
    got = {r.seg: r for r in fit.snapped_ends(spark.createDataFrame(rows, schema), 2.0).collect()}
    assert set(got) == {0, 1, 4} and got[1].x0 == 12.0 and got[4].x0 == 41.0


def test_radii_snap_to_those_of_their_sheet(spark):
    rows = spark.createDataFrame([(1, 52.0), (2, 52.0), (3, 52.0)], "sheet long, r double")
    table = spark.createDataFrame([(1, 50.0), (1, 60.0), (2, 100.0)], "sheet long, p double")
    got = {r.sheet: r.snapped for r in joins.nearest_value(rows, "r", table, "p", ["sheet"]).collect()}
    assert got == {1: 50.0, 2: None, 3: None}


def test_inline_curves_are_known_to_one_place(spark):
    schema = "sheet long, radius double, length double"
    table = spark.createDataFrame([(1, 50.01, 12.02), (1, 80.0, None)], schema)
    inline = spark.createDataFrame([(1, 50.04, 11.98), (1, 80.0, 0.0), (1, 80.0, 3.0), (2, 50.01, 12.02)], schema)
    got = sorted((r.sheet, r.radius, r.length or 0) for r in score.curve_rows(inline, table).collect())
    assert got == [(1, 50.01, 12.02), (1, 80.0, 0), (1, 80.0, 3.0), (2, 50.01, 12.02)]
