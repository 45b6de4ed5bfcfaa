"""Small steps on sheets, on worked examples."""

from pyspark.sql import functions as F

from cadastra.operators import sheet


def test_tags_of_labels(spark):
    rows = spark.createDataFrame([("L4 N45", "10+", "", 1), ("Lot 4", "= ", "' LT", 2), ("C 12 x", "", " rt", 3), ("12", "", " feet", 4)], "t string, before string, behind string, k int")
    got = rows.select("k", sheet.table_row(F.col("t")).alias("row"), sheet.station_or_offset(F.col("before"), F.col("behind")).alias("no")).orderBy("k").collect()
    assert [(r.row, r.no) for r in got] == [(True, True), (False, True), (True, True), (False, False)]


def test_unbound_labels_say_why(spark):
    labels = spark.createDataFrame([(1, 1, True), (1, 2, False), (1, 3, False)], "sheet int, label int, table boolean")
    got = sheet.unbound_labels(labels, spark.createDataFrame([(1, 3)], "sheet int, label int")).collect()
    assert {r.label: r.why for r in got} == {1: "table_row", 2: "no_segment_in_range"}


def test_names_and_texts(spark):
    files = spark.createDataFrame([("a", "x_fieldnotes.pdf"), ("a", "a_much_longer_name.pdf"), ("a", "ext.pdf"), ("b", "p.pdf"), ("b", "longer.pdf")], "k string, name string")
    got = {r.k: r.name for r in sheet.longest_name(files, ["k"], "name", "(?i)fieldnote|ext").collect()}
    assert got == {"a": "x_fieldnotes.pdf", "b": "longer.pdf"}
    runs = spark.createDataFrame([("N1", 5, 0.2), ("N1", 2, 0.9), ("S", 1, 0.0)], "t string, pos int, v double")
    assert sorted(map(tuple, sheet.first_by_text(runs, "t", "pos").collect())) == [("N1", 2, 0.9), ("S", 1, 0.0)]


def test_sets_and_rectangles(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "v int") for v in ([1, 2, 2], [2, 1, 2]))
    assert sheet.same_rows(a, b) and not sheet.same_rows(a, b.distinct())
    lots = spark.createDataFrame([(100.0, 10.0, [1500.0, 1500.0], [600.0, 600.0]), (100.0, 11.0, [1500.0, 1490.0], [600.0, 600.0])], "side_az double, end_az double, sides array<double>, ends array<double>")
    got = [(r.perpendicular, r.equal_sides, r.equal_ends) for r in sheet.rectangle_checks(lots).collect()]
    assert got == [(True, True, True), (False, False, True)]
    plan = sheet.one_plan(spark.createDataFrame([(1, 2.0)], "id int, r double"), spark.createDataFrame([(2, "l")], "id int, layer string"))
    assert sorted((r.id, r.r, r.layer) for r in plan.collect()) == [(1, 2.0, None), (2, None, "l")]
    assert [r.v for r in sheet.largest(a, "v", 2).collect()] == [2, 2]
