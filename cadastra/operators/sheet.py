"""Small steps on sheets: crops, tags, refusals, spreads, invariants, comparisons of sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.functions.angles import strict_degrees

# A row of a line or curve table, what stands before a station's and behind an offset's number.
TABLE_ROW = r"^\s*[LC]\s?\d+\b"
STATION_BEFORE = r"\+\s?$"
OFFSET_BEHIND = r"(?i)^\s*['′]?\s*[LR]T\b"


def table_row(text: Column) -> Column:
    """Whether a run of text is a row of a line or curve table."""
    return text.rlike(TABLE_ROW)


def station_or_offset(before: Column, behind: Column) -> Column:
    """Whether the text around a number makes it a station (2+10.5) or an offset (50.00' LT), no distance."""
    return before.rlike(STATION_BEFORE) | behind.rlike(OFFSET_BEHIND)


def unbound_labels(labels: DataFrame, bound: DataFrame) -> DataFrame:
    """labels(sheet, label, table, ...) without a segment in bound(sheet, label), with why: table_row or no_segment_in_range."""
    why = F.when(F.col("table"), "table_row").otherwise("no_segment_in_range")
    return labels.join(bound.select("sheet", "label"), ["sheet", "label"], "left_anti").withColumn("why", why)


def cropped(points: DataFrame, width: Column, height: Column, roi: tuple[float, float, float, float]) -> DataFrame:
    """points(x, y) inside the fractions (x0, y0, x1, y1) of a sheet's size, cut to whole units, upper ends left out."""
    x0, y0, x1, y1 = (F.floor(F.lit(float(v)) * size) for v, size in zip(roi, (width, height, width, height)))
    return points.where((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1))


def long_edges(segments: DataFrame, least: float) -> DataFrame:
    """Segments (x0, y0, x1, y1) at least so long."""
    return segments.where(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) >= least)


def refused(keys: DataFrame, sheet: str, least: int) -> tuple[DataFrame, DataFrame]:
    """(rows of sheets with at least so many bearings, refusals (sheet, bearings, why)); keys has a kind column."""
    n = keys.groupBy(sheet).agg(F.count_if(F.col("kind") == "bearing").alias("bearings"))
    few = n.where(F.col("bearings") < least).withColumn("why", F.format_string("only %d bearings", "bearings"))
    return keys.join(few, sheet, "left_anti"), few


def spurious_controls(controls: DataFrame, reads: DataFrame, sheet: str, segment: str) -> DataFrame:
    """(sheet, controls, spurious): segments without a label, and those of them that reads(sheet, segment, value) with
    a value name all the same."""
    read = reads.where("value is not null").select(F.col(sheet).alias("_s"), F.col(segment).alias("_g")).distinct()
    both = controls.select(sheet, segment).distinct().join(read, (F.col(sheet) == F.col("_s")) & (F.col(segment) == F.col("_g")), "left")
    return both.groupBy(sheet).agg(F.count("*").alias("controls"), F.count("_g").alias("spurious"))


def azimuth_buckets(rows: DataFrame, keys: list[str], azimuth: str, width: float = 1.0) -> DataFrame:
    """(keys, least, greatest, buckets): spread of azimuths and how many buckets of a width, centred on its multiples,
    they fill; halves go to the even one."""
    bucket = F.bround(F.col(azimuth) / width)
    return rows.groupBy(*keys).agg(F.min(azimuth).alias("least"), F.max(azimuth).alias("greatest"), F.count_distinct(bucket).alias("buckets"))


def crop_band(labels: DataFrame, sheet: str, size: str, band: float, dpi: float) -> DataFrame:
    """(sheet, glyph, band): the upper median glyph size in pixels, at least that of 6 points, and the band around a
    segment, from 80 to 280 pixels."""
    sizes = F.array_sort(F.collect_list(size))
    g = labels.groupBy(sheet).agg(sizes.alias("_v")).withColumn("glyph", F.greatest(F.lit(6.0), F.get("_v", F.floor(F.size("_v") / 2).cast("int"))) * (dpi / 72))
    return g.select(sheet, "glyph", F.least(F.greatest(F.col("glyph") * band, F.lit(80.0)), F.lit(280.0)).alias("band"))


def worst_precision(rings: DataFrame, sheet: str) -> DataFrame:
    """(sheet, worst): the least precision (length over misclosure) of its rings(perimeter, misclosure); perfect ones have none."""
    return rings.groupBy(sheet).agg(F.min(F.try_divide("perimeter", "misclosure")).alias("worst"))


def legs_of(courses: DataFrame) -> DataFrame:
    """courses(bearing, dist, chord_bearing, chord, r, arc, delta, side) as legs (az, dist, r, arc, delta, side): a chord
    gives an arc's direction and distance, its turn is the printed one, else arc over radius."""
    az = F.coalesce(strict_degrees(F.col("chord_bearing")), strict_degrees(F.col("bearing")))
    turn = F.coalesce(F.col("delta"), F.degrees(F.try_divide("arc", "r")))
    rest = [c for c in courses.columns if c not in ("bearing", "dist", "chord_bearing", "chord", "delta")]
    return courses.select(*rest, az.alias("az"), F.coalesce("chord", "dist").alias("dist"), turn.alias("delta"))


def vertex_means(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x, y): the mean of a face's vertices."""
    return points.groupBy(*keys).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def rectangle_checks(lots: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """lots(side_az, end_az, sides, ends), the last two arrays of printed lengths, with whether sides are square to
    ends, and whether opposite sides and ends are equal."""
    square = F.abs(F.pmod(F.col("side_az") - F.col("end_az"), F.lit(180.0)) - 90) <= tolerance
    equal = lambda c: F.array_max(c) - F.array_min(c) <= tolerance
    return lots.withColumns({"perpendicular": square, "equal_sides": equal("sides"), "equal_ends": equal("ends")})


def largest(rows: DataFrame, by: str, n: int = 16) -> DataFrame:
    """The n greatest rows, a report."""
    return rows.orderBy(F.col(by).desc()).limit(n)


def longest_name(files: DataFrame, keys: list[str], name: str, wanted: str) -> DataFrame:
    """(keys, name): the longest of the names that match a pattern, or of all where none does; ties go to the first."""
    rank = F.struct(F.col(name).rlike(wanted).alias("w"), F.length(name).alias("n"))
    best = files.withColumn("_r", rank).groupBy(*keys).agg(F.max("_r").alias("_b"))
    return files.withColumn("_r", rank).join(best, keys).where(F.col("_r") == F.col("_b")).groupBy(*keys).agg(F.min(name).alias(name))


def first_by_text(runs: DataFrame, text: str, order: str) -> DataFrame:
    """One run for each text, the first by order."""
    every = F.struct(F.col(order), *(c for c in runs.columns if c != order))
    return runs.groupBy(F.col(text).alias("_t")).agg(F.min(every).alias("_f")).select(*(F.col(f"_f.{c}").alias(c) for c in runs.columns))


def leaked(found: DataFrame, decoys: DataFrame) -> DataFrame:
    """Values that both hold, once each."""
    return found.intersect(decoys)


def same_rows(one: DataFrame, other: DataFrame) -> bool:
    """Whether two tables hold the same rows, each as often."""
    return one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()


def one_plan(*parts: DataFrame) -> DataFrame:
    """Polylines, lines and arcs of plans as one table; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
