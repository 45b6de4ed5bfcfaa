"""Whole-sheet jobs, composed from the operators; all sheets go through one plan."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.functions import angles, fieldnotes, geom, text
from cadastra.operators import fit, graph, joins, matching, ordered, score


def chained_segments(raw: DataFrame, gap: float = 6.0, least: float = 20.0, angle_bin: float = 0.75, offset_bin: float = 1.0, short: float = 1.0) -> DataFrame:
    """(sheet, seg, x0, y0, x1, y1): pieces raw(sheet, piece, x0, y0, x1, y1) on one line joined over gaps.

    Pieces whose line hashes (angle and offset bins) are neighbours are collinear; their components are order-free.
    Along the longest piece of a component, the pieces' intervals merge across at most gap; results under least go.
    """
    r = raw.where(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) >= short)
    flip = (F.col("x1") < F.col("x0")) | ((F.col("x1") == F.col("x0")) & (F.col("y1") < F.col("y0")))
    turn = lambda a, b: F.when(flip, F.col(b)).otherwise(F.col(a))
    r = r.select("sheet", "piece", *(turn(a, b).alias(f"_{a}") for a, b in (("x0", "x1"), ("y0", "y1"), ("x1", "x0"), ("y1", "y0"))))
    dx, dy = F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0")
    length = F.hypot(dx, dy)
    r = r.withColumns({"l": length, "ka": F.bround(F.degrees(F.atan2(dy, dx)) / angle_bin).cast("long"), "kr": F.bround((F.col("_y0") * dx - F.col("_x0") * dy) / length / offset_bin).cast("long")})
    # Components of occupied bins, not of pieces: a bin's pieces belong together anyway.
    bins = r.groupBy("sheet", "ka", "kr").agg(F.min("piece").alias("node"))
    spread = bins.select("sheet", F.col("node").alias("b"), F.explode(F.array(*(F.struct((F.col("ka") + i).alias("ka"), (F.col("kr") + j).alias("kr")) for i in (-1, 0, 1) for j in (-1, 0, 1)))).alias("k")).select("sheet", "b", "k.ka", "k.kr")
    edges = bins.join(spread, ["sheet", "ka", "kr"]).where("node < b").select("sheet", F.col("node").alias("a"), "b")
    of = graph.connected_components(bins.select("sheet", "node"), edges)
    grouped = r.join(bins, ["sheet", "ka", "kr"]).join(of, ["sheet", "node"])
    axis = grouped.groupBy("sheet", "component").agg(F.max_by(F.struct("_x0", "_y0", "_x1", "_y1", "l"), F.struct("l", -F.col("piece"))).alias("g"))
    p = grouped.join(axis, ["sheet", "component"])
    ux, uy = (F.col("g._x1") - F.col("g._x0")) / F.col("g.l"), (F.col("g._y1") - F.col("g._y0")) / F.col("g.l")
    t = lambda x, y: (F.col(x) - F.col("g._x0")) * ux + (F.col(y) - F.col("g._y0")) * uy
    a, b = t("_x0", "_y0"), t("_x1", "_y1")
    runs = ordered.islands(p.select("sheet", "component", F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")), ["sheet", "component"], "lo", "hi", gap).where(F.col("hi") - F.col("lo") >= least)
    out = runs.join(axis, ["sheet", "component"]).select("sheet", "component", "island", *((F.col(f"g._{c}0") + F.col(e) * u).alias(f"{c}{k}") for k, e in ((0, "lo"), (1, "hi")) for c, u in (("x", ux), ("y", uy))))
    return out.withColumn("seg", F.row_number().over(Window.partitionBy("sheet").orderBy("component", "island")) - 1).select("sheet", "seg", "x0", "y0", "x1", "y1")


def merged_lines(lines: DataFrame) -> DataFrame:
    """(sheet, x0, y0, x1, y1): fragments lines(sheet, line, x0, y0, x1, y1) of one straight edge joined.

    Buckets take the first line that opens them (1.5 degrees, 0.4 % of the sheet's span), so lines of a sheet are
    dealt out in order, together; points of a bucket part where they lie more than 1 % of the span apart.
    """
    def run(page: pd.DataFrame) -> pd.DataFrame:
        s = page.sort_values("line")[["x0", "y0", "x1", "y1"]].to_numpy(float)
        span = max(np.ptp(s[:, [0, 2]]), np.ptp(s[:, [1, 3]])) or 1.0
        theta = np.mod(np.arctan2(s[:, 3] - s[:, 1], s[:, 2] - s[:, 0]), np.pi)
        rho = s[:, 1] * np.cos(theta) - s[:, 0] * np.sin(theta)
        heads: list[int] = []
        bucket = np.zeros(len(s), int)
        for i in range(len(s)):
            d = np.abs(theta[i] - theta[heads])
            ok = np.flatnonzero((np.minimum(d, np.pi - d) < math.radians(1.5)) & (np.abs(rho[i] - rho[heads]) < 0.004 * span)) if heads else []
            if len(ok):
                bucket[i] = ok[0]
            else:
                bucket[i] = len(heads)
                heads.append(i)
        out = []
        for k, h in enumerate(heads):
            p = s[bucket == k].reshape(-1, 2)
            t = p @ [np.cos(theta[h]), np.sin(theta[h])]
            order = np.argsort(t, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(t[order]) > 0.01 * span) + 1):
                a, b = p[part[0]], p[part[-1]]
                if len(part) > 1 and np.hypot(*(b - a)) > 1e-9:
                    out.append((page["sheet"].iloc[0], *a, *b))
        return pd.DataFrame(out, columns=["sheet", "x0", "y0", "x1", "y1"])

    return lines.select(F.col("sheet").cast("long").alias("sheet"), "line", "x0", "y0", "x1", "y1").groupBy("sheet").applyInPandas(run, "sheet long, x0 double, y0 double, x1 double, y1 double")


def fitted_arcs(points: DataFrame, resid: float = 0.6, least_r: float = 3.0, most_r: float = 2000.0, least_sweep: float = 12.0) -> tuple[DataFrame, DataFrame]:
    """(arcs, chains): chains points(sheet, chain, pos, x, y) of at least four points that lie on a circle, as arcs
    (sheet, chain, cx, cy, r, start_deg, end_deg, bulge), and the chains that don't, as their points.

    One shuffle and sort by chain; nothing is joined back to the points for the arcs."""
    keys = ["sheet", "chain"]
    about = fit.with_circles(points.select(*keys, "pos", "x", "y"), keys, "pos").withColumns({"a": F.degrees(F.atan2(F.col("y") - F.col("cy"), F.col("x") - F.col("cx"))), "_d": F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"))})
    turned = ordered.unwrapped(about, keys, "pos", "a")
    ends = {"from": F.min_by("unwrapped", "pos"), "to": F.max_by("unwrapped", "pos"), "spread": F.stddev_pop("_d")} | {c: F.first(c) for c in ("cx", "cy", "r", "n")}
    good = turned.groupBy(*keys).agg(*(v.alias(c) for c, v in ends.items())).withColumn("sweep", F.abs(F.col("to") - F.col("from")))
    good = good.where((F.col("n") >= 4) & (F.col("spread") <= resid) & F.col("r").between(least_r, most_r) & F.col("sweep").between(least_sweep, 350.0))
    arcs = good.select(*keys, *(F.round(c, 4).alias(c) for c in ("cx", "cy", "r")), F.round(F.least("from", "to"), 3).alias("start_deg"), F.round(F.greatest("from", "to"), 3).alias("end_deg"))
    arcs = arcs.withColumn("bulge", F.round(geom.bulge(F.col("end_deg") - F.col("start_deg")), 6))
    # As many keys as chains, which sizes of files don't tell: a merge join, so that they don't pass through the driver.
    return arcs, points.join(good.select(*keys).hint("merge"), keys, "left_anti")


def refined_arcs(points: DataFrame, table: DataFrame, near: float = 12.0) -> DataFrame:
    """(sheet, arc, r, cx, cy, start_deg, end_deg, length, published): curved chains of one published radius close to each
    other as one arc, with the nearest published length of that radius that no earlier arc has taken.

    table(sheet, radius, length). A cluster's centre moves as chains join it, so a sheet's chains are taken in order.
    """
    held = points.groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("chain", "pos", "x", "y"))).alias("p")).join(table.groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("radius", "length"))).alias("t")), "sheet")
    rows = held.select(F.col("sheet").cast("long").alias("sheet"), *(F.col(f"p.{c}").alias(c) for c in ("chain", "x", "y")), F.col("t.radius").alias("radius"), F.col("t.length").alias("published"))

    def run(it):
        for pdf in it:
            out = []
            for r in pdf.itertuples():
                chain, xy = np.asarray(r.chain), np.stack([np.asarray(r.x, float), np.asarray(r.y, float)], 1)
                radii, left = np.asarray(r.radius, float), list(zip(r.radius, r.published))
                clusters: list[list] = []
                for k in dict.fromkeys(chain.tolist()):
                    p = xy[chain == k]
                    if len(p) < 4:
                        continue
                    _, _, found, spread = fit.fit_circle(*p.T)
                    snapped = radii[np.abs(radii - found).argmin()]
                    if spread > 0.6 or abs(found - snapped) > 0.25 * snapped:
                        continue
                    centre = p.mean(0)
                    home = next((c for c in clusters if c[0] == snapped and np.hypot(*(c[1].mean(0) - centre)) < near), None)
                    if home:
                        home[1] = np.concatenate([home[1], p])
                    else:
                        clusters.append([snapped, p])
                for n, (radius, p) in enumerate(clusters):
                    cx, cy, _, _ = fit.fit_circle(*p.T)
                    a = np.degrees(np.arctan2(p[:, 1] - cy, p[:, 0] - cx))
                    if np.ptp(a) > 300:
                        a = np.mod(a, 360)
                    length = radius * math.radians(np.ptp(a))
                    of = [t for t in left if t[0] == radius]
                    best = min(of, key=lambda t: abs(t[1] - length)) if of else None  # noqa: B023
                    if best:
                        left.remove(best)
                    out.append((r.sheet, n, radius, cx, cy, a.min(), a.max(), length, best[1] if best else None))
            yield pd.DataFrame(out, columns=["sheet", "arc", "r", "cx", "cy", "start_deg", "end_deg", "length", "published"])

    return rows.mapInPandas(run, "sheet long, arc long, r double, cx double, cy double, start_deg double, end_deg double, length double, published double")


def recovered_curves(points: DataFrame, curves: DataFrame, fit_tolerance: float = 0.5, length_tolerance: float = 1.0) -> DataFrame:
    """(sheet, radius, status, sweep, length, published, fits): each published radius curves(sheet, radius, length) as
    FULL, PARTIAL or NOT FOUND, by the longest chain that confirms it."""
    keys = ["sheet", "radius"]
    best = fit.longest_of_radius(points, curves, fit_tolerance)
    table = curves.groupBy(*keys).agg(F.array_sort(F.collect_list("length")).alias("lengths"))
    out = table.join(best, keys, "left").withColumn("length", F.col("radius") * F.radians("sweep"))
    nearest = F.array_min(F.transform("lengths", lambda v: F.struct(F.abs(v - F.col("length")).alias("g"), v.alias("v"))))
    out = out.withColumn("_b", nearest)
    status = F.when(F.col("fits").isNull(), "NOT FOUND").when(F.col("_b.g") <= length_tolerance, "FULL").otherwise("PARTIAL")
    return out.select(*keys, status.alias("status"), "sweep", "length", F.when(F.col("fits").isNotNull(), F.col("_b.v")).alias("published"), F.coalesce("fits", F.lit(0)).alias("fits"))


def reconciled_lots(faces: DataFrame, printed: DataFrame, tolerance: float = 0.03) -> tuple[DataFrame, DataFrame]:
    """(lots, sheets): face areas(sheet, face, area) against printed areas(sheet, face, printed): one scale a sheet, the
    upper median of the ratios, must bring every lot within the tolerance; the spread of the ratios tells how well it can."""
    both = faces.join(printed, ["sheet", "face"], "left").withColumn("ratio", F.when(F.col("area") > 0, F.try_divide("printed", "area")))
    sheets = both.where("ratio is not null").groupBy("sheet").agg(matching.upper_median(F.collect_list("ratio")).alias("scale2"), (F.max("ratio") / F.min("ratio") - 1).alias("spread"), F.count("*").alias("printed_lots"))
    lots = both.join(sheets.select("sheet", "scale2"), "sheet").withColumn("scaled", F.col("area") * F.col("scale2"))
    lots = lots.withColumn("validated", F.coalesce(F.abs(F.col("scaled") - F.col("printed")) / F.col("printed") < tolerance, F.lit(False)))
    return lots.select("sheet", "face", "area", "printed", "scaled", "validated"), sheets.withColumn("scale", F.sqrt("scale2"))


def boundary_labels(reads: DataFrame, lines: DataFrame, curves: DataFrame) -> DataFrame:
    """(sheet, edge, label, distance): the first read of an edge that says something: a course, or a tag of the sheet's
    line or curve table. reads(sheet, edge, ordinal, raw), lines(sheet, id, distance), curves(sheet, id)."""
    c = text.course_of(F.col("raw"))
    tag = F.nullif(F.regexp_replace(F.regexp_extract("raw", r"^\s*([LC]\s?\d+)", 1), r"\s", ""), F.lit(""))
    r = reads.select("sheet", "edge", "ordinal", "raw", tag.alias("id"), c.alias("c"))
    known = lines.select("sheet", "id", F.col("distance").alias("_d"), F.lit(True).alias("_k")).unionByName(curves.select("sheet", "id", F.lit(None).cast("double").alias("_d"), F.lit(True).alias("_k")))
    r = r.join(known, ["sheet", "id"], "left")
    good = r.withColumns({"label": F.when(F.col("_k"), F.col("id")).when(F.col("c.distance").isNotNull(), F.trim("raw")), "distance": F.when(F.col("_k"), F.col("_d")).otherwise(F.col("c.distance"))}).where("label is not null")
    return good.groupBy("sheet", "edge").agg(F.min_by(F.struct("label", "distance"), "ordinal").alias("b")).select("sheet", "edge", "b.label", "b.distance")


def self_check(lines: DataFrame, reads: DataFrame) -> DataFrame:
    """(sheet, scale, bearing_hits, bearings, distance_hits, distances): a sheet's reads against its own drawing.

    lines(sheet, x0, y0, x1, y1) north up, reads(sheet, raw, kind). The scale is the median ratio of the longest reads
    to the longest lines; then bearings match line azimuths (mod 180) and distances scaled lengths, one to one.
    """
    az, num = angles.loose_azimuth(F.col("raw")), text.last_number(F.col("raw"))
    r = reads.withColumns({"_az": az, "_num": num})
    values = lambda kind, v, places: F.array_sort(F.collect_set(F.when(score.kind_gate(F.col("kind"), kind, F.col(v)), F.round(v, places))))
    mine = r.groupBy("sheet").agg(values("bearing", "_az", 5).alias("vb"), values("distance", "_num", 3).alias("vd"))
    c = [F.col(x) for x in ("x0", "y0", "x1", "y1")]
    drawn = lines.select("sheet", F.pmod(F.degrees(F.atan2(c[2] - c[0], c[3] - c[1])), F.lit(180.0)).alias("a"), F.hypot(c[2] - c[0], c[3] - c[1]).alias("l"))
    scale = matching.ratio_scale(mine.select("sheet", F.explode("vd").alias("v")), drawn.select("sheet", F.col("l").alias("v")), "sheet", "v")
    order = drawn.groupBy("sheet").agg(F.collect_list("a").alias("ga"), F.sort_array(F.collect_list("l"), asc=False).alias("gl"))
    j = mine.join(order, "sheet").join(scale, "sheet", "left")
    scaled = F.transform("gl", lambda x: x * F.col("scale"))
    return j.select("sheet", "scale", matching.greedy_hits_of_long(F.col("vb"), F.col("ga"), 0.05, modulo=True).alias("bearing_hits"), F.size("vb").alias("bearings"), matching.greedy_hits_of_long(F.col("vd"), scaled, 0.2).alias("distance_hits"), F.size("vd").alias("distances"))


def recall_of(reads: DataFrame, keys: DataFrame) -> DataFrame:
    """(sheet, kind, hits, total, strict_hits): reads(sheet, raw, kind) against keys(sheet, kind, raw, value), one to one.

    Key bearings are read from their text or given as azimuths; azimuth 0 of a text counts as unread, as in published
    figures. Bearings match quadrant-tolerantly (0.05 degrees mod 180), distances within 0.2.
    """
    az = angles.loose_azimuth(F.col("raw"))
    truth = keys.withColumn("v", F.when(F.col("kind") == "bearing", F.coalesce(F.round(F.nullif(az, F.lit(0.0)), 5), F.round("value", 5))).otherwise(F.round("value", 3)))
    t = truth.groupBy("sheet").agg(*(F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("v")))).alias(n) for k, n in (("bearing", "tb"), ("distance", "td"))))
    r = reads.withColumns({"_az": az, "_num": text.last_number(F.col("raw")), "_o": F.monotonically_increasing_id()})
    isb, isd = score.kind_gate(F.col("kind"), "bearing", F.col("_az")), score.kind_gate(F.col("kind"), "distance", F.col("_num"))
    mine = r.groupBy("sheet").agg(
        F.array_sort(F.collect_set(F.when(isb, F.round("_az", 5)))).alias("vb"), F.array_sort(F.collect_set(F.when(isd, F.round("_num", 3)))).alias("vd"),
        F.transform(F.array_sort(F.collect_list(F.when(isb & F.col("_az").isNotNull(), F.struct("_o", angles.azimuth_candidates(F.col("raw")).alias("c"))))), lambda s: s["c"]).alias("vc"),
    )
    j = t.join(mine, "sheet", "left")
    out = j.select("sheet", F.inline(F.array(
        F.struct(F.lit("bearing").alias("kind"), matching.greedy_candidate_hits(F.col("tb"), F.col("vc"), 0.05).alias("hits"), F.size("tb").alias("total"), matching.greedy_hits(F.col("tb"), F.col("vb"), 0.05, modulo=True).alias("strict_hits")),
        F.struct(F.lit("distance").alias("kind"), matching.greedy_hits(F.col("td"), F.col("vd"), 0.2).alias("hits"), F.size("td").alias("total"), matching.greedy_hits(F.col("td"), F.col("vd"), 0.2).alias("strict_hits")),
    )))
    return out.where("total > 0")


def located_pages(pages: DataFrame, targets: DataFrame) -> DataFrame:
    """(sheet, side, pages, missing): field-note pages(page, text) that describe each side of targets(sheet, t, r), and
    the sides without any; a target without a page on any side has one row, with a null side and all four missing."""
    named = pages.select("page", fieldnotes.page_title(F.col("text")).alias("h")).where("h is not null").select("page", "h.dir", "h.t", "h.r")
    sides = joins.neighbour_rule(named, targets).groupBy("sheet", "side").agg(F.array_sort(F.collect_set("page")).alias("pages"))
    all_sides = F.array(*(F.lit(s) for s in "NSEW"))
    every = targets.select("sheet").distinct().join(sides, "sheet", "left")
    missing = every.groupBy("sheet").agg(F.array_sort(F.array_except(all_sides, F.collect_set("side"))).alias("missing"))
    return every.join(missing, "sheet")


def curated(candidates: DataFrame, least: float = 0.3, first_year: int = 1970) -> DataFrame:
    """The admitted candidate of each sheet: candidates(sheet, name, year, bearings, distances, hits, total), the latest whose key is sane and whose recall reaches least."""
    ok = (F.col("year") >= first_year) & ~F.col("name").contains("_s") & ~F.col("name").contains("_bnd") & score.sane_key(F.col("bearings"), F.col("distances")) & (F.coalesce(F.try_divide("hits", "total"), F.lit(0.0)) >= least)
    return ordered.first_passing(candidates, ["sheet"], ok, F.col("year").desc(), F.col("name").desc())


def listed_plats(pages: DataFrame, first: str, second: str) -> DataFrame:
    """(sheet, year, url): links to PDF files between two headings of a listing, each with the greatest year in the
    nearest of the three lines before it that has one."""
    rows = pages.select("sheet", F.posexplode(text.lines_in(text.between_headings(F.col("text"), first, second))).alias("pos", "line"))
    rows = rows.withColumn("_y", F.nullif(text.max_year(F.col("line")), F.lit(0)))
    back = rows.withColumn("year", F.coalesce(ordered.look_back(rows, ["sheet"], "pos", "_y"), F.lit(0)))
    return back.where(F.col("line").startswith("http") & F.col("line").endswith(".pdf")).select("sheet", "year", F.col("line").alias("url"))


def label_recall(labels: DataFrame, published: DataFrame, tolerances: dict[str, float]) -> DataFrame:
    """(sheet, kind, hits, total): labels(sheet, kind, value) against published(sheet, kind, value) by kind, one to one; bearings mod 360."""
    lists = lambda df, n: df.where("value is not null").groupBy("sheet", "kind").agg(F.array_sort(F.collect_list("value")).alias(n))
    j = lists(published, "t").join(lists(labels, "v"), ["sheet", "kind"], "left")
    hits = F.lit(None).cast("int")
    for kind, tolerance in tolerances.items():
        n = F.size(F.filter(matching.greedy_pairs(F.col("t"), F.col("v"), lambda w, tol=tolerance: F.lit(tol)), lambda p: p["hit"]))
        hits = F.when(F.col("kind") == kind, n).otherwise(hits)
    return j.select("sheet", "kind", hits.alias("hits"), F.size("t").alias("total"))


def leg_flags(legs: DataFrame, arcmin: float = 5.0, metres: float = 0.05) -> DataFrame:
    """legs(az, d, label_az, label_d) with the differences from their labels and whether either is beyond tolerance; null without a label."""
    da, dd = angles.angle_between(F.col("az"), F.col("label_az")) * 60, F.abs(F.col("d") - F.col("label_d"))
    over = F.coalesce(da > arcmin, F.lit(False)) | F.coalesce(dd > metres, F.lit(False))
    return legs.withColumns({"d_az_arcmin": F.round(da, 2), "d_dist": F.round(dd, 4), "over": F.when(F.col("label_az").isNotNull() | F.col("label_d").isNotNull(), over)})


def geometry_profile(lines: DataFrame) -> DataFrame:
    """(sheet, n, total, width, height, least, most, over_1m) of a bag of lines."""
    x = lambda f: f(F.greatest("x0", "x1")) if f is F.max else f(F.least("x0", "x1"))
    y = lambda f: f(F.greatest("y0", "y1")) if f is F.max else f(F.least("y0", "y1"))
    size = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return lines.groupBy("sheet").agg(F.count("*").alias("n"), F.sum(size).alias("total"), (x(F.max) - x(F.min)).alias("width"), (y(F.max) - y(F.min)).alias("height"), F.min(size).alias("least"), F.max(size).alias("most"), F.count_if(size > 1).alias("over_1m"))


def plan_score(closures: DataFrame, labels: DataFrame, flags: DataFrame, manifest: DataFrame) -> DataFrame:
    """(sheet, result, closure_pass, label_hits, label_total, flagged): what can be scored of each plan of the manifest; plans without any input are pending."""
    c = closures.select("sheet", "closure_pass")
    k = labels.groupBy("sheet").agg(F.sum("hits").alias("label_hits"), F.sum("total").alias("label_total"))
    f = flags.groupBy("sheet").agg(F.count_if("over").alias("flagged"))
    j = manifest.select("sheet").join(c, "sheet", "left").join(k, "sheet", "left").join(f, "sheet", "left")
    any_ = F.col("closure_pass").isNotNull() | F.col("label_total").isNotNull() | F.col("flagged").isNotNull()
    return j.withColumn("result", F.when(any_, "scored").otherwise("pending"))


def model_comparison(results: DataFrame, sheet: str, model: str, models: list[str]) -> DataFrame:
    """(sheet, a column of recall for each model) of results(sheet, model, hits, total)."""
    return results.groupBy(sheet).pivot(model, models).agg(F.try_divide(F.sum("hits"), F.sum("total")))


def assembled(segments: DataFrame, reads: DataFrame) -> dict[str, DataFrame]:
    """A plat put together: planar edges, courses by edge, closed faces and the sheet report.

    segments(sheet, seg, x0..y1) page space; reads(sheet, edge, win, kind, raw): crops of edges, whose number is the
    edge's, so no label has to be bound. Rotation is the circular mode of bearing less axis, scale the upper median of
    printed distance over length on edges with a single distance.
    """
    edges = graph.cut_lineage(graph.planar_edges(segments, joins.crossings(segments)))
    value = F.when(F.col("kind") == "bearing", angles.loose_azimuth(F.col("raw"))).when(F.col("kind") == "distance", text.last_number(F.col("raw")))
    r = reads.withColumn("v", value).where("v is not null")
    per = r.groupBy("sheet", "edge", "kind").agg(F.array_sort(F.collect_list(F.struct("win", "raw", "v"))).alias("s"))
    kept = F.when(F.col("kind") == "bearing", matching.distinct_within(F.transform("s", lambda x: x["v"]), 0.01)).otherwise(matching.distinct_within(F.transform("s", lambda x: x["v"]), 0.005))
    per = per.withColumn("k", kept)
    one = per.groupBy("sheet", "edge").agg(*(F.max(F.when(F.col("kind") == kind, F.col("k"))).alias(n) for kind, n in (("bearing", "_brg"), ("distance", "_dst"))))
    bound = edges.join(one, ["sheet", "edge"])
    axis = angles.axis_of(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    turned = bound.select("sheet", "edge", F.posexplode("_brg").alias("i", "az"), axis.alias("axis")).select("sheet", (F.col("edge") * 1000 + F.col("i")).alias("o"), angles.wrap180(F.col("az") - F.col("axis")).alias("res"))
    theta = matching.circular_mode(turned, "sheet", "res", "o", 1.0)
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    scale = bound.where((F.size("_dst") == 1) & (length > 1)).groupBy("sheet").agg(matching.upper_median(F.collect_list(F.get("_dst", F.lit(0)) / length)).alias("scale"))
    fitted = bound.join(theta.select("sheet", "theta", "inliers", F.col("total").alias("votes")), "sheet", "left").join(scale, "sheet", "left")
    flat = fitted.select("sheet", "edge", "ax", "ay", "bx", "by", F.get("_brg", F.lit(0)).alias("azimuth"), F.get("_dst", F.lit(0)).alias("distance"), "theta", "scale", "inliers", "votes")
    courses = graph.built_courses(flat, F.coalesce("theta", F.lit(0.0)), F.col("scale")).withColumn("ordinal", F.lit(0))
    rings = graph.closed_faces(graph.face_legs(edges), courses)
    return {"edges": edges, "courses": courses, "rings": rings, "report": score.sheet_report(rings, courses)}


def raster_faces(images: DataFrame, overshoot: float = 3.0, snap: float = 4.0, long_side: int = 20, least_area: float = 25.0) -> DataFrame:
    """(sheet, face, area): lots of scanned sheets(sheet, height, width, pixels): traced, overshot, snapped, planarized, walked."""
    from cadastra.operators.raster import traced_sheets

    w = Window.partitionBy("sheet", "line").orderBy("pos")
    p = traced_sheets(images, long_side, least=3.0).withColumns({"x1": F.lead("x").over(w), "y1": F.lead("y").over(w)}).where("x1 is not null")
    s = p.select("sheet", F.row_number().over(Window.partitionBy("sheet").orderBy("line", "pos")).alias("seg"), F.col("x").alias("x0"), F.col("y").alias("y0"), "x1", "y1")
    ends = geom.extended(*(F.col(c) for c in ("x0", "y0", "x1", "y1")), F.lit(overshoot))
    s = fit.snapped_ends(s.select("sheet", "seg", *(e.alias(n) for e, n in zip(ends, ("x0", "y0", "x1", "y1")))).where("x0 is not null"), snap)
    legs = graph.face_legs(graph.planar_edges(s, joins.crossings(s, snap), snap), least_area)
    return legs.groupBy("sheet", "face").agg(F.abs(F.first("area")).alias("area"))


def fragments_summary(results: DataFrame, result: Column) -> DataFrame:
    """(result, n) of plans."""
    return results.groupBy(result.alias("result")).agg(F.count("*").alias("n"))


def merged_modes(truths: DataFrame) -> DataFrame:
    """(sheet, type, golden): several ground truths of a plan as one; types joined by +, the last golden named."""
    w = truths.groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("pos", "type", "golden"))).alias("g"))
    return w.select("sheet", F.concat_ws("+", F.transform("g", lambda x: x["type"])).alias("type"), F.try_element_at(F.array_compact(F.transform("g", lambda x: x["golden"])), F.lit(-1)).alias("golden"))

