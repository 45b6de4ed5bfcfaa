"""Queries: one-to-one matching, votes, recall, tolerance joins, set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadastra.functions import text
from cadastra.operators import fit, joins, matching, score
from cadastra.plans.bridge import view
from cadastra.plans.catalog import query

LISTS = "l AS (SELECT sheet, list_sort(list_distinct(list(truth))) AS t, list_sort(list_distinct(list(got))) AS g FROM v_truth GROUP BY sheet)"
GREEDY = """g0 AS (SELECT sheet, t AS pool, g AS a, 0 AS i, 0 AS hit FROM l), rec AS (SELECT * FROM g0 UNION ALL
    SELECT sheet, CASE WHEN b IS NULL THEN pool ELSE list_concat(pool[1:b-1], pool[b+1:]) END, a, i+1, hit + CASE WHEN b IS NULL THEN 0 ELSE 1 END FROM (SELECT *, list_max(list_filter(range(1, len(pool)+1), j -> abs(pool[j]-a[i+1]) = list_min(list_transform(pool, q -> abs(q-a[i+1]))) AND abs(pool[j]-a[i+1]) <= {tol})) AS b FROM rec WHERE i < len(a)))"""


def _lists(spark, sf_dir):
    v = view(spark, sf_dir, "v_truth")
    return v.groupBy("sheet").agg(F.array_sort(F.collect_set("truth")).alias("t"), F.array_sort(F.collect_set("got")).alias("g"))


@query(f"WITH RECURSIVE {LISTS}, {GREEDY.format(tol=0.2)} SELECT sheet, CAST(max(hit) AS INT) AS hits, CAST(len(any_value(a)) AS INT) AS total FROM rec GROUP BY sheet")
def greedy_recall(spark, sf_dir):
    return _lists(spark, sf_dir).select("sheet", matching.greedy_hits(F.col("g"), F.col("t"), 0.2).alias("hits"), F.size("g").alias("total"))


STRICT = GREEDY.replace("list_max(list_filter", "list_min(list_filter").replace("<= {tol}", "< {tol}")


@query(f"WITH RECURSIVE {LISTS}, {STRICT.format(tol=0.15)} SELECT sheet, CAST(max(hit) AS INT) AS hits FROM rec GROUP BY sheet")
def greedy_recall_strict(spark, sf_dir):
    return _lists(spark, sf_dir).select("sheet", matching.greedy_hits(F.col("g"), F.col("t"), 0.15, strict=True).alias("hits"))


@query(f"WITH RECURSIVE {LISTS}, {STRICT.replace('<= {tol}', '<= {tol}').replace('< {tol}', '<= greatest(0.1, 0.01*a[i+1])').format(tol=0)} SELECT sheet, CAST(max(hit) AS INT) AS hits, CAST(len(any_value(a)) AS INT) AS total FROM rec GROUP BY sheet")
def greedy_lengths_relative(spark, sf_dir):
    pairs = matching.greedy_pairs(F.col("g"), F.col("t"), lambda w: F.greatest(F.lit(0.1), 0.01 * w))
    return _lists(spark, sf_dir).select("sheet", F.size(F.filter(pairs, lambda p: p["hit"])).alias("hits"), F.size(pairs).alias("total"))


@query()
def greedy_bearing_candidates(spark, sf_dir):
    from cadastra.functions.angles import azimuth_candidates

    v = view(spark, sf_dir, "v_bearings")
    g = v.groupBy("ring").agg(F.array_sort(F.collect_set(F.round(F.col("h") / 100.0, 5))).alias("t"), F.transform(F.array_sort(F.collect_list(F.struct("pos", azimuth_candidates(F.col("raw")).alias("c")))), lambda s: s["c"]).alias("c"))
    return g.select("ring", matching.greedy_candidate_hits(F.col("t"), F.col("c"), 0.05).alias("hits"), F.size("t").alias("total"))


@query("""WITH RECURSIVE l AS (SELECT sheet, list(v ORDER BY event_id) AS a FROM v_reads GROUP BY sheet), rec AS (SELECT sheet, a, 0 AS i, CAST([] AS DOUBLE[]) AS kept FROM l UNION ALL SELECT sheet, a, i+1, CASE WHEN len(list_filter(kept, u -> abs(u-a[i+1]) <= 5)) > 0 THEN kept ELSE list_append(kept, a[i+1]) END FROM rec WHERE i < len(a))
    SELECT sheet, CAST(len(arg_max(kept, i)) AS INT) AS n, round(list_sum(arg_max(kept, i)), 2) AS total FROM rec GROUP BY sheet""")
def dedupe_within_tolerance(spark, sf_dir):
    v = view(spark, sf_dir, "v_reads").groupBy("sheet").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "v"))), lambda s: s["v"]).alias("a"))
    kept = matching.distinct_within(F.col("a"), 5.0)
    return v.select("sheet", F.size(kept).alias("n"), F.round(F.aggregate(kept, F.lit(0.0), lambda s, x: s + x), 2).alias("total"))


@query("""WITH RECURSIVE l AS (SELECT sheet, list(v ORDER BY v) AS a FROM v_reads GROUP BY sheet), rec AS (SELECT sheet, a, 0 AS i, CAST([] AS DOUBLE[]) AS kept FROM l UNION ALL SELECT sheet, a, i+1, CASE WHEN len(kept) = 0 OR a[i+1] - kept[-1] > 3 THEN list_append(kept, a[i+1]) ELSE kept END FROM rec WHERE i < len(a)) SELECT sheet, CAST(len(arg_max(kept, i)) AS INT) AS n FROM rec GROUP BY sheet""")
def thin_cut_points(spark, sf_dir):
    v = view(spark, sf_dir, "v_reads").groupBy("sheet").agg(F.collect_list("v").alias("a"))
    return v.select("sheet", F.size(matching.thinned(F.col("a"), 3.0)).alias("n"))


@query("SELECT sheet, list_sort(list(v))[len(list(v))//2 + 1] AS upper_median, median(v) AS true_median FROM v_reads GROUP BY sheet")
def medians(spark, sf_dir):
    return view(spark, sf_dir, "v_reads").groupBy("sheet").agg(matching.upper_median(F.collect_list("v")).alias("upper_median"), F.median("v").alias("true_median"))


@query("""WITH r AS (SELECT sheet, label, (v*7) % 180.0e0 - 90 AS res FROM v_labels), n AS (SELECT a.sheet, a.label, a.res, count(*) AS n FROM r a JOIN r b ON a.sheet=b.sheet AND abs((b.res-a.res+90+360) % 180.0e0 - 90) <= 5 GROUP BY a.sheet, a.label, a.res),
    best AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY n DESC, label) AS k FROM n), i AS (SELECT best.sheet, best.res AS c, best.n, list_sort(list((r.res-best.res+90+360) % 180.0e0 - 90)) AS d FROM best JOIN r ON r.sheet=best.sheet AND abs((r.res-best.res+90+360) % 180.0e0 - 90) <= 5 WHERE k=1 GROUP BY best.sheet, best.res, best.n)
    SELECT sheet, n AS inliers, round((c + d[len(d)//2+1] + 90 + 360) % 180.0e0 - 90, 3) AS theta FROM i""")
def rotation_mode(spark, sf_dir):
    r = view(spark, sf_dir, "v_labels").select("sheet", "label", (F.col("v") * 7 % 180.0 - 90).alias("res"))
    return matching.circular_mode(r, "sheet", "res", "label", 5.0).select("sheet", F.col("inliers").cast("bigint").alias("inliers"), F.round("theta", 3).alias("theta"))


@query("""WITH a AS (SELECT sheet, truth, row_number() OVER (PARTITION BY sheet ORDER BY truth DESC) AS k FROM v_truth), b AS (SELECT sheet, got, row_number() OVER (PARTITION BY sheet ORDER BY got DESC) AS k FROM v_truth) SELECT a.sheet, round(median(truth/got), 9) AS scale FROM a JOIN b ON a.sheet=b.sheet AND a.k=b.k AND a.k<=8 GROUP BY a.sheet""")
def scale_by_ranks(spark, sf_dir):
    v = view(spark, sf_dir, "v_truth")
    return matching.ratio_scale(v.select("sheet", F.col("truth").alias("x")), v.select("sheet", F.col("got").alias("x")), "sheet", "x").select("sheet", F.round("scale", 9).alias("scale"))


@query()
def pair_by_position(spark, sf_dir):
    r = view(spark, sf_dir, "v_reads")
    side = lambda even: F.array_sort(F.collect_list(F.when((F.col("event_id") % 2 == 0) == even, F.struct(F.col("v").alias("pos"), "event_id"))))
    g = r.groupBy("sheet").agg(side(True).alias("b"), side(False).alias("d"))
    return g.select("sheet", F.inline(matching.paired_by_position(F.col("b"), F.col("d"))))


@query("SELECT sheet, kind, raw, count(DISTINCT sample) AS votes FROM v_reads GROUP BY sheet, kind, raw HAVING count(DISTINCT sample) >= 2".replace("raw, count", "trim(raw) AS raw, count"))
def consensus_votes(spark, sf_dir):
    return score.consensus(view(spark, sf_dir, "v_reads"), ["sheet"], "sample", 2)


OPTIONS = [("union1", 1, 1), ("union3", 3, 1), ("union5", 5, 1), ("maj2of5", 5, 2), ("maj3of5", 5, 3)]


@query(" UNION ALL ".join(f"SELECT sheet, '{n}' AS option, count(*) AS n FROM (SELECT sheet, kind, raw FROM v_reads WHERE sample < {k} GROUP BY sheet, kind, raw HAVING count(DISTINCT sample) >= {v}) GROUP BY sheet" for n, k, v in OPTIONS))
def precision_frontier(spark, sf_dir):
    return score.frontier(view(spark, sf_dir, "v_reads"), ["sheet"], "sample", OPTIONS)


@query("SELECT coalesce(sheet, -1) AS sheet, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(total) AS BIGINT) AS total, round(sum(hits)/sum(total), 6) AS recall FROM v_results GROUP BY GROUPING SETS ((sheet), ())")
def recall_pooled(spark, sf_dir):
    return score.pooled(view(spark, sf_dir, "v_results"), "sheet", "hits", "total").withColumns({"sheet": F.coalesce("sheet", F.lit(-1)), "recall": F.round("recall", 6)})


@query("SELECT count(*) AS sheets, round(sum(hits)/sum(total), 6) AS micro, round(avg(hits/total), 6) AS macro_mean, round(median(hits/total), 6) AS macro_median, max(seconds) AS max_seconds, round(corr(seconds, total), 6) AS correlation FROM v_results")
def recall_summary(spark, sf_dir):
    s = score.summary(view(spark, sf_dir, "v_results"), "hits", "total", "seconds")
    return s.select("sheets", *(F.round(c, 6).alias(c) for c in ("micro", "macro_mean", "macro_median", "correlation")), "max_seconds")


@query(r"""WITH c AS (SELECT sheet, variant, CAST(len(regexp_extract_all(body, '(?i)[NS]\s*\.?\s*\d{1,3}\s*[°o]\s*\d{1,2}\s*[''’]')) AS INT) AS hits, max(variant) OVER (PARTITION BY sheet) AS key_page FROM v_sheet_pages)
    SELECT sheet, arg_max(variant, hits*1000000.0 - variant % 1000000) AS best_page, max(hits) AS best, count(*) AS pages, max(key_page) AS key_page, max(hits) FILTER (variant = key_page) AS keyed, coalesce(max(hits) FILTER (variant = key_page), 0) >= 0.8e0 * max(hits) AS fine FROM c GROUP BY sheet""")
def page_audit(spark, sf_dir):
    v = view(spark, sf_dir, "v_sheet_pages").select("sheet", "variant", text.courses_in(F.col("body")).alias("hits"))
    # The stand-in for a sheet's key is of its last page.
    v = v.withColumn("key_page", F.max("variant").over(Window.partitionBy("sheet")))
    return score.page_audit(v, "sheet", "variant", "hits", "key_page", F.col("variant") % 1000000)


@query("""SELECT sheet, round((degrees(atan2(2*covar_pop(x0,y0), var_pop(x0)-var_pop(y0))/2) + 360) % 180.0e0, 3) AS angle, round(sqrt((var_pop(x0)+var_pop(y0))/2 + sqrt(power((var_pop(x0)-var_pop(y0))/2,2)+power(covar_pop(x0,y0),2))), 3) AS along FROM v_segments GROUP BY sheet""")
def orientation(spark, sf_dir):
    return score.orientation(view(spark, sf_dir, "v_segments"), ["sheet"], "x0", "y0").select("sheet", F.round("angle", 3).alias("angle"), F.round("along", 3).alias("along"))


@query("""WITH big AS (SELECT * REPLACE (2.0e0 + label % 60 AS size) FROM v_labels), p AS (SELECT s.sheet, l.label, l.size, s.seg, least(abs(l.angle - a) % 180.0e0, 180 - abs(l.angle - a) % 180.0e0) AS da, ((l.cx-x0)*(x1-x0)+(l.cy-y0)*(y1-y0))/(power(x1-x0,2)+power(y1-y0,2)) AS t, abs((l.cx-x0)*(y1-y0)-(l.cy-y0)*(x1-x0))/sqrt(power(x1-x0,2)+power(y1-y0,2)) AS dist
    FROM (SELECT *, (degrees(atan2(x1-x0, y0-y1)) + 360) % 180.0e0 AS a FROM v_segments WHERE x0<>x1 OR y0<>y1) s JOIN big l ON l.sheet = s.sheet), r AS (SELECT *, row_number() OVER (PARTITION BY sheet, label ORDER BY dist, seg) AS k FROM p WHERE da <= 20 AND t BETWEEN -0.15 AND 1.15 AND dist < greatest(12, 4*size)) SELECT sheet, label, seg, round(dist, 3) AS dist FROM r WHERE k = 1""")
def bind_labels(spark, sf_dir):
    labels = view(spark, sf_dir, "v_labels").withColumn("size", 2.0 + F.col("label") % 60)
    return joins.bind_labels(labels, view(spark, sf_dir, "v_segments")).withColumn("dist", F.round("dist", 3))


@query("""WITH a AS (SELECT sheet, label, v FROM v_labels), b AS (SELECT DISTINCT sheet, label % 7 AS seg, v FROM v_labels WHERE label % 2 = 1) SELECT sheet, seg, v, coalesce(bool_or(own), false) AS on_segment, coalesce(bool_or(any_), false) AS anywhere FROM (SELECT DISTINCT x.sheet, x.label % 7 AS seg, x.v, b.seg = x.label % 7 AS own, b.v IS NOT NULL AS any_ FROM a x LEFT JOIN b ON b.sheet = x.sheet AND abs(b.v - x.v) <= 0.205) GROUP BY sheet, seg, v""")
def scoped_and_global_matches(spark, sf_dir):
    v = view(spark, sf_dir, "v_labels").select("sheet", (F.col("label") % 7).alias("seg"), "v", "label")
    return joins.matched_anywhere(v.drop("label"), v.where("label % 2 = 1"), "sheet", "seg", "v", 0.205)


@query("""WITH u AS (SELECT * FROM (VALUES ('N',0,0,'N'),('S',0,0,'S'),('E',0,0,'E'),('W',0,0,'W'),('S',1,0,'N'),('N',-1,0,'S'),('W',0,-1,'E'),('E',0,1,'W')) x(dir,dt,dr,side)) SELECT s.sheet, p.page, u.side FROM v_townships p JOIN u ON u.dir=p.dir JOIN v_targets s ON s.t = p.t - u.dt AND s.r = p.r - u.dr""")
def township_neighbours(spark, sf_dir):
    return joins.neighbour_rule(view(spark, sf_dir, "v_townships"), view(spark, sf_dir, "v_targets"))


@query("""WITH p AS (SELECT DISTINCT curve % 20 AS sheet, round(r, -2) AS p FROM v_curves), j AS (SELECT v.curve, p.p, row_number() OVER (PARTITION BY v.curve ORDER BY abs(p.p - v.r*1.2e0), p.p) AS k FROM v_curves v JOIN p ON p.sheet = v.curve % 20 AND abs(p.p - v.r*1.2e0) <= 0.25*p.p) SELECT v.curve, j.p AS snapped FROM v_curves v LEFT JOIN j ON j.curve = v.curve AND j.k = 1""")
def nearest_published_radius(spark, sf_dir):
    v = view(spark, sf_dir, "v_curves").withColumns({"sheet": F.col("curve") % 20, "read": F.col("r") * 1.2})
    return joins.nearest_value(v, "read", v.select("sheet", F.round("r", -2).alias("p")), "p", ["sheet"]).select("curve", "snapped")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 10)")
def resume_unfinished(spark, sf_dir):
    o, li = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    return joins.rest_of(o.select("o_orderkey"), li.where("l_quantity > 10").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("""WITH lab AS (SELECT DISTINCT l_suppkey AS sheet, l_partkey AS seg FROM lineitem WHERE l_linenumber = 1), n AS (SELECT sheet, ceil(count(*)*0.5) AS n FROM lab GROUP BY sheet), free AS (SELECT sheet, count(*) AS f FROM (SELECT DISTINCT l_suppkey AS sheet, l_partkey AS seg FROM lineitem EXCEPT SELECT * FROM lab) GROUP BY sheet) SELECT sheet, CAST(least(n, f) AS BIGINT) AS controls FROM n JOIN free USING (sheet)""")
def control_sample_sizes(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    every = li.select(F.col("l_suppkey").alias("sheet"), F.col("l_partkey").alias("seg")).distinct()
    lab = li.where("l_linenumber = 1").select(F.col("l_suppkey").alias("sheet"), F.col("l_partkey").alias("seg")).distinct()
    return joins.sampled_controls(every, lab, "sheet", "seg", 0.5).groupBy("sheet").agg(F.count("*").alias("controls"))


@query("""WITH t AS (SELECT p_partkey // 2 % 40 AS sheet, round((p_partkey*37 % 101)/25.0e0, 2) AS radius, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) % 5 END AS length, 'table' AS src FROM part WHERE p_partkey % 2 = 0), i AS (SELECT p_partkey // 2 % 40 AS sheet, round((p_partkey*37 % 101)/25.0e0, 2) AS radius, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) % 5 END AS length, 'inline' AS src FROM part WHERE p_partkey % 2 = 1)
    SELECT * FROM t UNION ALL SELECT * FROM i WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.sheet = i.sheet AND round_even(t.radius, 1) = round_even(i.radius, 1) AND round_even(coalesce(t.length, 0), 1) = round_even(coalesce(i.length, 0), 1))""")
def curve_table_union(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    k, length = F.col("p_partkey"), F.col("p_size").cast("double") % 5

    def side(odd, without, src):
        known = F.when(k % without != 0, length)
        return p.where(k % 2 == odd).select(F.expr("p_partkey div 2 % 40").alias("sheet"), F.round(k * 37 % 101 / 25.0, 2).alias("radius"), known.alias("length"), F.lit(src).alias("src"))

    return score.curve_rows(side(1, 5, "inline"), side(0, 7, "table"))


@query("WITH c AS (SELECT sheet, variant, hits/total AS rec FROM v_results) SELECT sheet, variant FROM (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY variant DESC) AS k FROM c WHERE rec >= 0.3) WHERE k = 1")
def admission_gate(spark, sf_dir):
    return score.admitted(view(spark, sf_dir, "v_results").withColumn("rec", F.try_divide("hits", "total")), "sheet", "rec", "variant").select("sheet", "variant")


@query("SELECT sheet, round(max(total/seconds)/min(total/seconds) - 1, 6) AS spread FROM v_results GROUP BY sheet")
def area_ratio_spread(spark, sf_dir):
    return score.area_spread(view(spark, sf_dir, "v_results").withColumn("q", F.try_divide("total", "seconds")), ["sheet"], "q").withColumn("spread", F.round("spread", 6))


@query("""WITH p AS (SELECT curve % 50 AS k, cos(radians(x*17+curve))*(50 + curve % 50) + 10 AS x, sin(radians(x*17+curve))*(50 + curve % 50) - 5 AS y FROM (SELECT curve, unnest(range(0,6)) AS x FROM v_curves)) SELECT k, 10.0 AS cx, -5.0 AS cy, CAST(50 + k AS DOUBLE) AS r, count(*) AS n FROM p GROUP BY k""".replace("10.0 AS cx, -5.0 AS cy", "10.0e0 AS cx, -5.0e0 AS cy"))
def circle_fits(spark, sf_dir):
    v = view(spark, sf_dir, "v_curves").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(5))))
    a, r = F.radians(F.col("i") * 17 + F.col("curve")), 50 + F.col("curve") % 50
    p = v.select((F.col("curve") % 50).alias("k"), (F.cos(a) * r + 10).alias("x"), (F.sin(a) * r - 5).alias("y"))
    return fit.circle_sums(p, ["k"]).select("k", *(F.round(c, 4).alias(c) for c in ("cx", "cy", "r")), "n")

