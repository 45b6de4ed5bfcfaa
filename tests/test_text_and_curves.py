"""Worked examples of reading text, bearings, curves and traverses."""

import math

import pytest
from pyspark.sql import functions as F

from cadastra.functions import angles, fieldnotes, geom, text
from cadastra.operators import traverse


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x if values else spark.range(1).select(column.alias("x")).first().x


def each(spark, f, values, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r.x for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


PAGE = """N12°34'56"E   7.23
S05°00'00"W   25.0
N89°59'59"W   43.44
S45°30'15"E   100.0
N0°38'32"E   152.31
N7°15'51"W   1319.61
DISTANCES IN FEET
R=15.500
L=12.778
A=29.047
Δ=14.400
Area = 929.9 m2
12345.6 SF
Lot 12
Plan EPP12345
2018
Scale 1:250
Segment# 7: Line
Course: N12°00'00"E
Length: 333.33'
North: 702,613.8799'
East: 324,308.5163'"""


def test_page_harvest(spark):
    got = spark.createDataFrame([(PAGE,)], "p string").select(text.bearings_in(F.col("p")), text.distances_in(F.col("p")), text.unit_vote(F.col("p"))).first()
    assert got[0] == ["N12°34'56\"E", "S05°00'00\"W", "N89°59'59\"W", "S45°30'15\"E", "N0°38'32\"E", "N7°15'51\"W", "N12°00'00\"E"]
    assert got[1] == sorted([7.23, 25.0, 43.44, 100.0, 152.31, 1319.61, 333.33])
    assert got[2] == "ft"
    assert each(spark, text.distances_in, ["FOUND 3.25\" CAP 12.5'", "RADIUS 50.0 and 60.0", "1 2 3", None]) == [[12.5], [60.0], [], None]


def test_loose_bearings(spark):
    got = each(spark, angles.loose_azimuth, ["N.88°52'W.", "98°15'", "90°", "N10'", "S 26°40'58\"", "N0°0'0\"W", "", "°", "S0°37'55.4\"E"])
    want = [360 - (88 + 52 / 60), 98.25, 90.0, None, 26 + 40 / 60 + 58 / 3600, 360.0, None, None, 180 - (37 / 60 + 55 / 3600)]
    assert [g is None if w is None else abs(g - w) < 1e-9 for g, w in zip(got, want)] == [True] * len(want)
    got = each(spark, angles.azimuth_candidates, ["S 26°40'58\"", "N10°W", "45°", "12", "5°0'E"])
    assert [[round(x, 4) for x in g] for g in got] == [[153.3172, 206.6828], [350.0], [45.0], [], [5.0, 175.0]]


def test_strict_bearings(spark):
    got = each(spark, angles.strict_degrees, ["152°20'38\"", "92°31'", "N56°09'E", "S33°51'W", "N5", "S", "12W", "E12", "x", "", "10.5", "N0°0'0\"W"])
    want = [152 + 20 / 60 + 38 / 3600, 92 + 31 / 60, 56.15, 213.85, 5.0, None, 270.0, None, None, None, 10.5, 0.0]
    assert [g is None if w is None else g is not None and abs(g - w) < 1e-9 for g, w in zip(got, want)] == [True] * len(want)
    assert each(spark, angles.to_dms, [152.34388888, 359.9999999, -0.5, 12.0], "double") == ["152°20'38\"", "360°00'00\"", "359°30'00\"", "12°00'00\""]


def test_angle_algebra_keeps_its_ranges(spark):
    assert each(spark, angles.wrap180, [-30.0, 90.0, 270.0, -90.0], "double") == [-30.0, -90.0, -90.0, -90.0]
    assert each(spark, angles.wrap360, [180.0, -181.0, 539.0], "double") == [-180.0, 179.0, 179.0]


def test_small_readers(spark):
    assert each(spark, text.last_number, ["East 237.16", "12'", "R= 5", "?", "L.C. 4", "no", "3.5\" 8"]) == [237.16, 12.0, None, None, None, None, 8.0]
    assert each(spark, text.station, ["2+327.076", "x"]) == [2327.076, None]
    assert each(spark, text.page_list, ["5-9,12-14", "3"]) == [[5, 6, 7, 8, 9, 12, 13, 14], [3]]
    assert each(spark, text.square_feet, ["1,234.5 sq ft", "2 acres", "none"]) == [1234.5, 87120.0, None]
    assert each(spark, text.range_label, [75, 3, 100], "int") == ["050-099", "000-049", "100-149"]
    assert each(spark, text.lookalike_number, ["2O", "l7", "x1"]) == [20, 17, None]
    assert each(spark, text.slug, ["  A/B c--D!"]) == ["a_b_c_d"]
    assert each(spark, lambda c: text.course_of(c)["distance"], ["N12°30'00\"E 45.67", "N12°30'00\"E"]) == [45.67, None]
    assert each(spark, lambda c: F.size(text.json_items(c)), ['```json\n[{"raw":"a"},{"kind":"b"}]\n```', "no [1", 'x [{"raw":"q"}] y', "[]"]) == [1, 0, 1, 0]
    assert one(spark, text.prompt("read {tile} of {n}", tile=F.lit("t1"), n=F.lit(3))) == "read t1 of 3"
    assert one(spark, text.without_flags(F.array(F.lit("bearing_residual_1"), F.lit("partial")), "bearing_residual")) == ["partial"]


def test_field_notes(spark):
    got = each(spark, fieldnotes.page_title, ["E. Bdy. of T. 28 N., R. 8O W.", "North boundary of Township l2 N, Range 7 W", "T. 28 N., R. 80 W.", "north of nothing", "E. Bdy. of T. 99 N., R. 80 W."])
    assert [g and tuple(g) for g in got] == [("E", 28, 80), ("N", 12, 7), None, None, None]
    notes = "N. 89° 15' W. 12.50 chs\nA pine bears S. 81 10 E., 23.00\nS. 0 30 E 40.00, 99.123 and 0.01"
    assert [list(map(list, r)) for r in each(spark, fieldnotes.note_courses, [notes])] == [[[179.5, 270.75], [12.5, 40.0]]]
    assert each(spark, fieldnotes.parallel_range, ["Third Standard Parallel North through Range 8O W"]) == [80]


def test_curve_text(spark):
    body = "x\nCURVE TABLE\nCURVE\nC1\nC2\nRADIUS\n100.00'\n200.5\nLENGTH\n50.00\n60\nDELTA\n28°38'52\"\nLEGEND\n5\nTANGENT\n25.1'\n"
    pages = spark.createDataFrame([(1, body), (2, "no table C1"), (3, "R=50.0' L=20.25 Δ=23°12'18\" CHD=N10°00'00\"E 20.1' and R = 7 L = 3")], "sheet long, text string")
    assert sorted(map(tuple, fieldnotes.table_curves(pages).collect())) == [(1, "C1", 100.0, "28°38'52\"", 50.0, None, None, 25.1), (1, "C2", 200.5, None, 60.0, None, None, None)]
    assert sorted(map(tuple, fieldnotes.inline_curves(pages).collect())) == [(3, 7.0, 3.0, None, None, None), (3, 50.0, 20.25, "23°12'18\"", "N10°00'00\"E", 20.1)]


def test_published_curves(spark):
    lit = lambda **k: {n: F.lit(float(v)) for n, v in k.items()}
    a = one(spark, geom.curve_from(lit(r=300, delta=71 + 42 / 60 + 12 / 3600)))
    assert [round(a[k], 3) for k in ("tangent", "arc", "chord")] == [216.778, 375.438, 351.413]
    b = one(spark, geom.curve_from(lit(r=150, delta=81 + 47 / 60 + 52 / 3600)))
    assert [round(b[k], 3) for k in ("tangent", "arc")] == [129.929, 214.146]
    c = one(spark, geom.curve_from(lit(arc=375.438, chord=351.413)))
    assert abs(c.delta - 71.70333) < 2e-3 and abs(c.r - 300) < 0.01
    assert one(spark, geom.curve_from(lit(r=10, chord=50))).delta is None


def test_label_vote(spark):
    labels = {"r": 300.0, "delta": 71.703333, "arc": 375.438, "chord": 351.413, "tangent": 216.778}
    vote = lambda d: one(spark, geom.checked_curve({k: F.lit(v) for k, v in d.items()}))
    assert vote(labels).suspects == []
    assert vote({**labels, "tangent": 261.778}).suspects == ["tangent"]
    assert vote({"chord": 5.0, "external": 3.0}) is None


def legs(spark, rows):
    return spark.createDataFrame([(g, i, *r) for g, rs in rows.items() for i, r in enumerate(rs)], "lot string, pos int, az double, d double, r double, delta double, side string")


SQUARE = [(90.0, 20.0, None, None, None), (0.0, 20.0, 10.0, 180.0, "R"), (270.0, 20.0, None, None, None), (180.0, 20.0, None, None, None)]


def test_lots_with_an_arc(spark):
    # A 20 m square whose east side is a half circle of radius 10; a misread length; the curve flipped.
    lots = {"good": SQUARE, "short": [(90.0, 21.0, None, None, None), *SQUARE[1:]], "flipped": [SQUARE[0], (0.0, 20.0, 10.0, 180.0, "L"), *SQUARE[2:]]}
    area = 400 + 50 * math.pi
    printed = spark.createDataFrame([(k, area) for k in lots], "lot string, printed_area double")
    got = {r.lot: r for r in traverse.validated_lots(legs(spark, lots), printed, "lot", "pos").collect()}
    assert abs(got["good"].area - area) < 1e-6 and got["good"].passed
    assert not got["short"].closure_pass
    assert got["flipped"].closure_pass and not got["flipped"].area_pass


def test_tangent_arc_takes_its_direction_from_the_leg_before(spark):
    rows = {"x": [(0.0, 10.0, None, None, None), (None, None, 5.0, 90.0, "R"), (None, None, 5.0, 90.0, "L")]}
    got = traverse.chords(legs(spark, rows), "lot", "pos").orderBy("pos").collect()
    assert [round(r.chord_az, 9) for r in got] == [0.0, 45.0, 45.0]
    assert [round(r.tangent_after, 9) for r in got] == [0.0, 90.0, 0.0]
    assert abs(got[1].chord_d - 5 * math.sqrt(2)) < 1e-9


def test_worked_areas(spark):
    rings = {"lot 1": [(200, 100), (203.181, 136.361), (245.241, 138.197), (243.347, 102.145)], "lot 2": [(500, 200), (635, 155), (740, 175), (715, 335), (620, 310)]}
    rows = spark.createDataFrame([(k, i, float(e), float(n)) for k, ps in rings.items() for i, (e, n) in enumerate(ps)], "g string, i int, e double, n double")
    got = {r.g: abs(r.signed_area) for r in traverse.signed_area(rows, "g", "i").collect()}
    assert round(got["lot 1"], 1) == 1541.1 and round(got["lot 2"]) == 26325


def test_turns_are_tried_in_order(spark):
    rows = spark.createDataFrame([("a", 0, False, "R"), ("a", 1, True, None), ("a", 2, True, None)], "lot string, pos int, unknown boolean, side string")
    got = traverse.turn_options(rows, "lot", "pos").orderBy("option", "pos").collect()
    assert ["".join(r.side for r in got if r.option == k) for k in range(4)] == ["RRR", "RRL", "RLR", "RLL"]


@pytest.mark.parametrize("turn", [0.0, 33.0])
def test_misclosure_does_not_change_with_rotation(spark, turn):
    rows = [("r", i, az + turn, d) for i, (az, d) in enumerate([(10.0, 5.0), (100.0, 7.0), (200.0, 4.0)])]
    got = traverse.misclosure(spark.createDataFrame(rows, "g string, i int, az double, d double"), "g").first().misclosure
    e = sum(d * math.sin(math.radians(a)) for a, d in [(10, 5), (100, 7), (200, 4)])
    n = sum(d * math.cos(math.radians(a)) for a, d in [(10, 5), (100, 7), (200, 4)])
    assert abs(got - math.hypot(e, n)) < 1e-9
