"""Queries: small steps on sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastra.operators import sheet
from cadastra.plans.bridge import view
from cadastra.plans.catalog import query


@query("SELECT sheet, seg FROM v_segments WHERE sqrt(power(x1-x0,2)+power(y1-y0,2)) >= 120")
def long_edges(spark, sf_dir):
    return sheet.long_edges(view(spark, sf_dir, "v_segments"), 120.0).select("sheet", "seg")


@query("SELECT sheet, seg FROM v_segments WHERE x0 >= 20 AND x0 < 150 AND y0 >= 10 AND y0 < 190")
def region_of_interest(spark, sf_dir):
    p = view(spark, sf_dir, "v_segments").select("sheet", "seg", F.col("x0").alias("x"), F.col("y0").alias("y"))
    return sheet.cropped(p, F.lit(200.0), F.lit(200.0), (0.1, 0.05, 0.75, 0.95)).select("sheet", "seg")


@query("SELECT ring, min(az) AS least, max(az) AS greatest, count(DISTINCT round_even(az/10.0e0, 0)) AS buckets FROM v_legs GROUP BY ring")
def azimuth_buckets(spark, sf_dir):
    return sheet.azimuth_buckets(view(spark, sf_dir, "v_legs"), ["ring"], "az", 10.0)


@query("""WITH g AS (SELECT sheet, list_sort(list(2.0e0 + label % 40)) AS v FROM v_labels GROUP BY sheet) SELECT sheet, greatest(6, v[len(v)//2+1])*2.0e0 AS glyph, least(greatest(greatest(6, v[len(v)//2+1])*2.0e0*4, 80), 280) AS band FROM g""")
def crop_band(spark, sf_dir):
    v = view(spark, sf_dir, "v_labels").withColumn("size", 2.0 + F.col("label") % 40)
    return sheet.crop_band(v, "sheet", "size", 4.0, 144.0)


@query("SELECT ring AS sheet, count(*) AS bearings, printf('only %d bearings', count(*)) AS why FROM v_legs GROUP BY ring HAVING count(*) < 4")
def refused_sheets(spark, sf_dir):
    v = view(spark, sf_dir, "v_legs").select(F.col("ring").alias("sheet"), F.lit("bearing").alias("kind"))
    return sheet.refused(v, "sheet", 4)[1]


@query("""WITH c AS (SELECT DISTINCT sheet, seg FROM v_segments WHERE seg % 3 = 0), r AS (SELECT DISTINCT sheet, label AS seg FROM v_labels WHERE label % 2 = 0)
    SELECT c.sheet, count(*) AS controls, count(r.seg) AS spurious FROM c LEFT JOIN r ON r.sheet = c.sheet AND r.seg = c.seg GROUP BY c.sheet""")
def spurious_controls(spark, sf_dir):
    controls = view(spark, sf_dir, "v_segments").where("seg % 3 = 0")
    reads = view(spark, sf_dir, "v_labels").select("sheet", F.col("label").alias("seg"), F.when(F.col("label") % 2 == 0, F.col("v")).alias("value"))
    return sheet.spurious_controls(controls, reads, "sheet", "seg")


@query("SELECT sheet, round(avg(x0), 6) AS x, round(avg(y0), 6) AS y FROM v_segments GROUP BY sheet")
def vertex_means(spark, sf_dir):
    p = view(spark, sf_dir, "v_segments").select("sheet", F.col("x0").alias("x"), F.col("y0").alias("y"))
    return sheet.vertex_means(p, ["sheet"]).select("sheet", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("SELECT sheet, round(min(total*10.0e0/hits), 6) AS worst FROM v_results WHERE hits > 0 GROUP BY sheet")
def worst_precision(spark, sf_dir):
    r = view(spark, sf_dir, "v_results").where("hits > 0").select("sheet", (F.col("total") * 10.0).alias("perimeter"), F.col("hits").alias("misclosure"))
    return sheet.worst_precision(r, "sheet").withColumn("worst", F.round("worst", 6))


@query("""SELECT curve, CASE curve % 3 WHEN 0 THEN 45.0e0 ELSE 90.0e0 END AS az, CASE curve % 3 WHEN 0 THEN r ELSE r/2 END AS dist, round(CASE WHEN curve % 2 = 0 THEN delta ELSE degrees(radians(delta)) END, 6) AS delta FROM v_curves""")
def legs_of_courses(spark, sf_dir):
    chord = F.col("curve") % 3 == 0
    c = view(spark, sf_dir, "v_curves").select(
        "curve", "r", (F.col("r") * F.radians("delta")).alias("arc"), F.when(F.col("curve") % 2 == 0, F.col("delta")).alias("delta"),
        F.lit("N90°00'00\"E").alias("bearing"), (F.col("r") / 2).alias("dist"), F.when(chord, F.lit("N45°00'00\"E")).alias("chord_bearing"), F.when(chord, F.col("r")).alias("chord"),
    )
    return sheet.legs_of(c).select("curve", "az", "dist", F.round("delta", 6).alias("delta"))


@query("SELECT event_type FROM (SELECT DISTINCT event_type FROM events WHERE user_id % 2 = 0) INTERSECT SELECT event_type FROM events WHERE user_id % 2 = 1")
def leaked_values(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return sheet.leaked(e.where("user_id % 2 = 0").select("event_type"), e.where("user_id % 2 = 1").select("event_type"))
