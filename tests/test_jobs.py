"""Whole-sheet jobs on small drawings."""

import numpy as np
from pyspark.sql import functions as F

from cadastra.operators import jobs

SEGMENT = "sheet long, {} long, x0 double, y0 double, x1 double, y1 double"


def test_pieces_of_one_line_are_chained(spark):
    rows = [(1, 0, 0.0, 0.0, 10.0, 0.0), (1, 1, 30.0, 0.0, 14.0, 0.0), (1, 2, 60.0, 0.1, 90.0, 0.1), (1, 3, 0.0, 50.0, 5.0, 50.0), (1, 4, 5.0, 0.0, 5.0, 40.0), (1, 5, 0.0, 0.0, 0.2, 0.0), (2, 0, 0.0, 0.0, 0.0, 25.0)]
    got = jobs.chained_segments(spark.createDataFrame(rows, SEGMENT.format("piece")), gap=6, least=20).collect()
    assert sorted((r.sheet, *sorted((round(r.x0), round(r.x1))), *sorted((round(r.y0), round(r.y1)))) for r in got) == [(1, 0, 30, 0, 0), (1, 5, 5, 0, 40), (1, 60, 90, 0, 0), (2, 0, 0, 0, 25)]


def test_fragments_of_an_edge_are_merged(spark):
    bits = [x * 0.8 for x in range(125)]
    rows = [(1, i, x, 0.05 * (i % 2), x + 0.7, 0.05 * (i % 2)) for i, x in enumerate(bits)] + [(1, 500 + i, 0.0, x, 0.0, x + 0.7) for i, x in enumerate(bits) if not 40 < x < 44]
    got = jobs.merged_lines(spark.createDataFrame(rows, SEGMENT.format("line"))).collect()
    long = sorted(round(np.hypot(r.x1 - r.x0, r.y1 - r.y0)) for r in got if np.hypot(r.x1 - r.x0, r.y1 - r.y0) > 5)
    assert long == [41, 56, 100]


def arc(sheet, chain, r, a0, a1, n=20, cx=0.0, cy=0.0):
    return [(sheet, chain, i, float(cx + r * np.cos(a)), float(cy + r * np.sin(a))) for i, a in enumerate(np.radians(np.linspace(a0, a1, n)))]


POINTS = "sheet long, chain long, pos long, x double, y double"


def test_arcs_and_straight_chains_part(spark):
    rows = arc(1, 0, 50, 10, 80) + arc(1, 1, 50, 170, 200) + [(1, 2, i, float(i * 10), 3.0) for i in range(5)] + [(1, 3, 0, 0.0, 0.0), (1, 3, 1, 5.0, 5.0)]
    arcs, rest = jobs.fitted_arcs(spark.createDataFrame(rows, POINTS))
    got = {r.chain: r for r in arcs.collect()}
    assert set(got) == {0, 1} and abs(got[0].r - 50) < 1e-3 and (got[0].start_deg, got[0].end_deg) == (10.0, 80.0)
    assert abs(got[1].end_deg - got[1].start_deg - 30) < 1e-3
    assert {r.chain for r in rest.collect()} == {2, 3}


def test_arcs_take_their_published_lengths(spark):
    rows = arc(1, 0, 63, 0, 30) + arc(1, 1, 63, 30, 60) + arc(1, 2, 63, 0, 45, cx=500)
    table = spark.createDataFrame([(1, 63.0, 66.0), (1, 63.0, 49.5), (1, 200.0, 5.0)], "sheet long, radius double, length double")
    got = jobs.refined_arcs(spark.createDataFrame(rows, POINTS), table, near=40).orderBy("arc").collect()
    assert [(round(r.length, 1), r.published) for r in got] == [(66.0, 66.0), (49.5, 49.5)]
    found = {r.radius: r.status for r in jobs.recovered_curves(spark.createDataFrame(rows, POINTS), table).collect()}
    assert found == {63.0: "FULL", 200.0: "NOT FOUND"}


def test_one_scale_for_all_lots(spark):
    faces = spark.createDataFrame([(1, i, a) for i, a in enumerate((100.0, 200.0, 300.0))], "sheet long, face long, area double")
    printed = spark.createDataFrame([(1, 0, 401.0), (1, 1, 800.0), (1, 2, 1500.0)], "sheet long, face long, printed double")
    lots, sheets = jobs.reconciled_lots(faces, printed)
    assert {r.face: r.validated for r in lots.collect()} == {0: True, 1: True, 2: False}
    assert round(sheets.first().spread, 3) == 0.25


def test_labels_by_table_or_course(spark):
    reads = spark.createDataFrame([(1, 0, 0, "??"), (1, 0, 1, "L 4"), (1, 1, 0, "N12°30'00\"E 45.67"), (1, 2, 0, "C9")], "sheet long, edge long, ordinal int, raw string")
    lines = spark.createDataFrame([(1, "L4", 12.5)], "sheet long, id string, distance double")
    curves = spark.createDataFrame([(1, "C1")], "sheet long, id string")
    assert {r.edge: r.distance for r in jobs.boundary_labels(reads, lines, curves).collect()} == {0: 12.5, 1: 45.67}


def test_recall_and_self_check(spark):
    reads = spark.createDataFrame([("s", "N45°00'00\"E", "bearing"), ("s", "S 26°40'58\"", "bearing"), ("s", "100.1", "distance"), ("s", "50", None)], "sheet string, raw string, kind string")
    keys = spark.createDataFrame([("s", "bearing", "N45°00'00\"E", None), ("s", "bearing", "S26°40'58\"E", None), ("s", "distance", None, 100.0), ("s", "distance", None, 49.0)], "sheet string, kind string, raw string, value double")
    got = {r.kind: (r.hits, r.total, r.strict_hits) for r in jobs.recall_of(reads, keys).collect()}
    assert got == {"bearing": (2, 2, 1), "distance": (1, 2, 1)}
    lines = spark.createDataFrame([("s", 0.0, 0.0, 10.0, 10.0), ("s", 0.0, 0.0, 0.0, 7.0)], "sheet string, x0 double, y0 double, x1 double, y1 double")
    check = jobs.self_check(lines, reads).first()
    assert (check.bearing_hits, check.bearings, check.distances) == (1, 2, 2)


def test_pages_and_listings(spark):
    pages = spark.createDataFrame([(1, "E. Bdy. of T. 28 N., R. 80 W."), (2, "N. Bdy. of T. 27 N., R. 80 W."), (3, "nothing")], "page long, text string")
    targets = spark.createDataFrame([("p", 28, 80)], "sheet string, t int, r int")
    got = {r.side: (r.pages, r.missing) for r in jobs.located_pages(pages, targets).collect()}
    assert got == {"E": ([1], ["N", "W"]), "S": ([2], ["N", "W"])}
    far = jobs.located_pages(pages, spark.createDataFrame([("q", 1, 1)], "sheet string, t int, r int")).collect()
    assert [(r.sheet, r.side, r.pages, r.missing) for r in far] == [("q", None, None, ["E", "N", "S", "W"])]
    listing = spark.createDataFrame([("a", "top\nPLATS\n1985 and 1990\nx\nhttp://q/1.pdf\nhttp://q/2.pdf\nEND\nhttp://q/3.pdf")], "sheet string, text string")
    assert sorted((r.year, r.url) for r in jobs.listed_plats(listing, "PLATS", "END").collect()) == [(1990, "http://q/1.pdf"), (1990, "http://q/2.pdf")]
    c = spark.createDataFrame([("a", "n1", 1960, 10, 5, 9, 10), ("a", "n2", 1980, 10, 5, 9, 10), ("a", "n3", 1990, 10, 5, 1, 10), ("a", "n_s", 1995, 10, 5, 9, 10)], "sheet string, name string, year int, bearings int, distances int, hits int, total int")
    assert jobs.curated(c).first().name == "n2"


def test_scores_of_plans(spark):
    labels = spark.createDataFrame([("a", "distance", 10.0), ("a", "distance", 20.3), ("a", "bearing", 5.0)], "sheet string, kind string, value double")
    published = spark.createDataFrame([("a", "distance", 10.01), ("a", "distance", 20.0), ("a", "bearing", 5.05)], "sheet string, kind string, value double")
    got = jobs.label_recall(labels, published, {"distance": 0.05, "bearing": 0.09})
    assert {r.kind: (r.hits, r.total) for r in got.collect()} == {"distance": (1, 2), "bearing": (1, 1)}
    legs = spark.createDataFrame([("a", 10.0, 5.0, 10.2, 5.0), ("a", 10.0, 5.0, None, None)], "sheet string, az double, d double, label_az double, label_d double")
    flags = jobs.leg_flags(legs)
    assert sorted(str(r.over) for r in flags.collect()) == ["None", "True"]
    closures = spark.createDataFrame([("a", True)], "sheet string, closure_pass boolean")
    plans = spark.createDataFrame([("a",), ("b",)], "sheet string")
    scored = jobs.plan_score(closures, got, flags, plans)
    assert {r.sheet: r.result for r in scored.collect()} == {"a": "scored", "b": "pending"}
    assert {r.result: r.n for r in jobs.fragments_summary(scored, F.col("result")).collect()} == {"scored": 1, "pending": 1}
    results = spark.createDataFrame([("a", "m1", 1, 2), ("a", "m2", 2, 2)], "sheet string, model string, hits int, total int")
    assert tuple(jobs.model_comparison(results, "sheet", "model", ["m1", "m2"]).first()) == ("a", 0.5, 1.0)
    truths = spark.createDataFrame([("a", 0, "closure", "g0"), ("a", 1, "area", None)], "sheet string, pos int, type string, golden string")
    assert tuple(jobs.merged_modes(truths).first()) == ("a", "closure+area", "g0")
    lines = spark.createDataFrame([("a", 0.0, 0.0, 3.0, 4.0)], "sheet string, x0 double, y0 double, x1 double, y1 double")
    assert jobs.geometry_profile(lines).first().total == 5.0


def test_a_plat_is_assembled(spark):
    rows = [(1, i, 0.0, 100.0 * i, 200.0, 100.0 * i) for i in range(3)] + [(1, 3 + i, 100.0 * i, 0.0, 100.0 * i, 200.0) for i in range(3)]
    segments = spark.createDataFrame(rows, SEGMENT.format("seg"))
    edges = [(r.edge, r.ax, r.ay, r.bx, r.by) for r in jobs.assembled(segments, spark.createDataFrame([], "sheet long, edge int, win int, kind string, raw string"))["edges"].collect()]
    reads = []
    for e, ax, ay, bx, by in edges:
        axis = np.degrees(np.arctan2(bx - ax, ay - by)) % 180 + 3
        d, m = divmod(round(axis * 60), 60)
        reads += [(1, e, 0, "bearing", f"{d}°{m:02d}'"), (1, e, 0, "distance", "250.00"), (1, e, 1, "distance", "250.00")]
    got = jobs.assembled(segments, spark.createDataFrame(reads, "sheet long, edge int, win int, kind string, raw string"))
    rings = got["rings"].collect()
    assert len(rings) == 4 and all(r.passed and abs(r.perimeter - 1000) < 1e-6 for r in rings)
    report = got["report"].first()
    assert (report.courses, report.clean, report.rings_passed) == (12, 12, 4)


def test_lots_of_a_scan(spark):
    g = np.full((140, 140), 255, np.uint8)
    for k in (10, 70, 130):
        g[k - 1 : k + 1, 9:131] = 0
        g[9:131, k - 1 : k + 1] = 0
    images = spark.createDataFrame([(1, 140, 140, bytearray(g.tobytes()))], "sheet long, height int, width int, pixels binary")
    areas = sorted(r.area for r in jobs.raster_faces(images).collect())
    assert len(areas) == 4 and all(3000 < a < 3900 for a in areas)
