"""Files in and out, arrival, adapters and rasters."""

import json

import numpy as np
from pyspark.sql import functions as F

from cadastra.operators import raster
from cadastra.sources import adapters, readers, sinks
from cadastra.streaming import intake


def put(folder, name, value):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(value if isinstance(value, str) else json.dumps(value))
    return str(folder)


def test_plan_round_trip(spark, tmp_path):
    plan = {"lines": [[0, 0, 10.5, 0, "LOT"], [1, "x", 3, 4, "LOT"]], "arcs": [[1, 2, 3, 0, 90, "ARC"]], "circles": [], "texts": [], "polylines": [[[0, 0], [1, 0, 0.5], [1, 1], "ROAD"], [[0, 0], "ROAD"]]}
    plans = readers.json_files(spark, put(tmp_path / "p", "a.plan.json", plan), readers.PLAN)
    lines = readers.plan_lines(plans).orderBy("line")
    assert [(r.sheet, r.x1, r.y0, r.layer) for r in lines.collect()] == [("a", 10.5, 0.0, "LOT"), ("a", 3.0, None, "LOT")]
    assert readers.plan_arcs(plans).first().r == 3.0
    v = readers.plan_vertices(plans, least=3)
    assert [(r.x, r.y, r.bulge, r.layer) for r in v.orderBy("pos").collect()] == [(0.0, 0.0, None, "ROAD"), (1.0, 0.0, 0.5, "ROAD"), (1.0, 1.0, None, "ROAD")]
    out = tmp_path / "out"
    sinks.write_json(sinks.plan_rows(lines, readers.plan_arcs(plans), v), str(out))
    again = spark.read.schema("sheet string, " + readers.PLAN).json(str(out))
    assert readers.plan_vertices(again).select("x", "y", "bulge").collect() == v.select("x", "y", "bulge").collect()
    assert [(r.x0, r.x1) for r in sinks.flattened(v).orderBy("pos").collect()] == [(0.0, 1.0), (1.0, 1.0)]


def test_keys_reads_tables(spark, tmp_path):
    keys = tmp_path / "k"
    put(keys, "one.key.json", {"bearings_dms": ["N1°E"], "distances_m": [10.5], "unit": "ft"})
    put(keys, "two.key.json", {"bearings_az": [12.5], "gt_legs_m": [3.0, 4.0]})
    got = readers.golden_values(readers.json_files(spark, str(keys), readers.KEY)).collect()
    assert sorted((r.sheet, r.kind, r.raw or r.value) for r in got) == sorted([("one", "bearing", "N1°E"), ("one", "distance", 10.5), ("two", "bearing", 12.5), ("two", "distance", 3.0), ("two", "distance", 4.0)], key=str) or len(got) == 5
    reads = spark.createDataFrame([("s", {"seg_0007_w1": [("5.5", "distance", None)], "bad": [("1", "x", None)]})], f"sheet string, reads {readers.READS}")
    assert [tuple(r)[:4] for r in readers.crop_reads(reads).collect()] == [("s", 7, 1, "5.5")]
    tables = readers.json_files(spark, put(tmp_path / "t", "c.json", {"curves": [{"id": "C1", "radius": 5.0}], "lines": [{"id": "L1", "bearing": "N1°E", "distance": 2.0}]}), readers.TABLES)
    assert readers.curve_table(tables).first().radius == 5.0 and readers.line_table(tables).first().id == "L1"
    plans, tolerances = readers.manifest(spark, put(tmp_path / "m", "m.json", {"plans": [{"id": "a"}, {"id": "b"}], "tolerances": {"dist_m": 0.05}}))
    assert plans.count() == 2 and tolerances.first().dist_m == 0.05
    put(tmp_path / "x", "l.txt", "a/b/ms12\n\n c \n")
    assert sorted(r.name for r in readers.items(spark, str(tmp_path / "x")).collect()) == ["c", "ms12"]
    assert readers.page_text(spark, str(tmp_path / "x")).first().text.startswith("a/b")
    assert [r.label for r in readers.probe_ids(spark, 49, 51).orderBy("n").collect()] == ["000-049", "050-099", "050-099"]
    put(tmp_path / "v", "r.tsv", "name\tmineral\na\t1\nb\t0\n")
    assert [r.name for r in readers.tsv(spark, str(tmp_path / "v"), "name string, mineral int", "mineral = 1").collect()] == ["a"]
    assert readers.files(spark, str(tmp_path / "v"), "*.tsv").first().name == "r.tsv"


def test_results_are_appended(spark, tmp_path):
    rows = spark.createDataFrame([("a", 3, 4)], "sheet string, hits int, total int")
    for _ in range(2):
        sinks.append_tsv(rows, str(tmp_path / "r"))
    assert readers.tsv(spark, str(tmp_path / "r"), rows.schema.simpleString()[7:-1].replace(":", " ")).count() == 2


def test_files_are_taken_in_once(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    spark.range(3).write.parquet(source)
    for n, more in ((3, 4), (7, 0), (7, 0)):
        intake.take_in(intake.arriving(spark, source, "id long"), target, mark, lambda df: df.withColumn("x", F.col("id") * 2)).awaitTermination()
        assert spark.read.parquet(target).count() == n
        if more:
            spark.range(more).write.mode("append").parquet(source)


def test_windows_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type", "value")
    events.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "e"))
    stream = intake.windowed_counts(intake.arriving(spark, str(tmp_path / "e"), events.schema), "ts", "event_type", "value", "1 day", "40 days")
    q = stream.writeStream.format("memory").queryName("arrivals").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda r: (r.start, r.event_type)
    batch = intake.windowed_counts(events, "ts", "event_type", "value", "1 day").collect()
    assert {key(r): r.n for r in spark.table("arrivals").collect()} == {key(r): r.n for r in batch}


def test_adapter_isolates_failures_and_resumes(spark):
    items = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", "3")], "k string, p string")
    first = adapters.call_each(items, "k", "p", lambda p: str(int(p) * 2))
    got = {r.key: (r.content, r.error is None) for r in first.collect()}
    assert got == {"a": ("2", True), "b": (None, False), "c": ("6", True)}
    assert [r.key for r in adapters.call_each(items, "k", "p", str, done=first, parallel=2).collect()] == ["b"]
    assert adapters.decode_pgm(b"P5\n# c\n2 1\n255\n\x00\xff") == (1, 2, b"\x00\xff")


def drawing():
    g = np.full((80, 120), 255, np.uint8)
    g[20:22, 10:100] = 0
    g[20:70, 54:56] = 0
    g[5:9, 5:8] = 0
    return g


def test_rasters(spark):
    g = drawing()
    mask = raster.ink(g)
    assert mask.sum() == (g == 0).sum() and raster.otsu(g) < 255
    labels, stats = raster.components(mask)
    assert len(stats) == raster.flood_count(mask) == 2 and stats[:, 4].sum() == mask.sum() and labels.max() == 2
    rng = np.random.default_rng(2)
    for _ in range(5):
        noise = rng.random((20, 23)) < 0.4
        assert len(raster.components(noise)[1]) == raster.flood_count(noise)
    lines = raster.linework(mask, 20)
    assert lines[5:9, 5:8].sum() == 0 and raster.linework(mask, 20, glyphs=True).sum() == 12
    assert raster.erase(mask, [(5, 5, 7, 8)]).sum() == mask.sum() - 12
    gap = lines.copy()
    gap[:, 30:32] = False
    assert len(raster.components(raster.close(gap, 5))[1]) == 1
    thin = raster.skeleton(lines)
    assert thin.sum() < lines.sum() / 1.5 and len(raster.components(thin)[1]) == 1
    paths = raster.traced(thin, 1.5, 3)
    assert 3 <= len(paths) <= 6
    assert len(raster.simplified(np.array([(0.0, 0), (1, 0.1), (2, 0), (3, 5)]), 0.5)) == 3
    x0, y0, x1, y1 = raster.parcel_box(lines)
    assert x0 <= 10 and x1 >= 100 and y1 >= 70
    assert raster.band(g, 10, 21, 100, 21, 4).shape == (4, 90) and raster.band(g, 10, 21, 100, 21, 4).min() == 0
    images = spark.createDataFrame([(1, 80, 120, bytearray(g.tobytes()))], "sheet long, height int, width int, pixels binary")
    assert raster.traced_sheets(images).count() > 4
    tiles = raster.tile_ink(images, 60, 10, least=30, share=0.01).collect()
    assert tiles and all(t.ink >= 0.01 for t in tiles)
