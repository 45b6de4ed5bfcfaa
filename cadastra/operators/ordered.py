"""Operators on ordered rows: islands, runs, carried state, circular neighbours, tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, keys: list[str], lo: str, hi: str, gap: float) -> DataFrame:
    """Merged intervals (keys, island, lo, hi, n): an interval joins the island before it when it begins at most gap behind its end."""
    w = Window.partitionBy(*keys).orderBy(lo, hi)
    before = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = rows.withColumn("_new", (before.isNull() | (F.col(lo) > before + gap)).cast("int"))
    numbered = fresh.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "island").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"), F.count("*").alias("n"))


def point_islands(rows: DataFrame, keys: list[str], at: str, gap: float) -> DataFrame:
    """Adds island: a new one begins where a point lies more than gap behind the one before."""
    w = Window.partitionBy(*keys).orderBy(at)
    jump = F.col(at) - F.lag(at).over(w)
    return rows.withColumn("_new", (jump.isNull() | (jump > gap)).cast("int")).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def page_runs(rows: DataFrame, keys: list[str], page: str) -> DataFrame:
    """Runs of consecutive distinct pages (keys, first, last, n)."""
    once = rows.select(*keys, page).distinct()
    w = Window.partitionBy(*keys).orderBy(page)
    runs = once.withColumn("_g", F.col(page) - F.row_number().over(w))
    return runs.groupBy(*keys, "_g").agg(F.min(page).alias("first"), F.max(page).alias("last"), F.count("*").alias("n")).drop("_g")


def carried(rows: DataFrame, keys: list[str], order: str, value: Column, name: str) -> DataFrame:
    """Adds the last value that isn't null, so far, under the name."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def look_back(rows: DataFrame, keys: list[str], order: str, value: str, steps: int = 3) -> Column:
    """The nearest of the values up to steps rows before that isn't null."""
    w = Window.partitionBy(*keys).orderBy(order)
    return F.coalesce(*(F.lag(value, k).over(w) for k in range(1, steps + 1)))


def top_by_distance(rows: DataFrame, segment: str, kind: str, distance: str, length: str, per: float = 150.0, short: float = 60.0) -> DataFrame:
    """The nearest labels of each segment and kind, one for each per of its length but two at least; a short segment with three or more keeps none."""
    w = Window.partitionBy(segment, kind)
    ranked = rows.withColumns({"_r": F.row_number().over(w.orderBy(distance)), "_n": F.count("*").over(w)})
    cap = F.greatest(F.lit(2), F.floor(F.col(length) / per).cast("int"))
    crowded = (F.col(length) < short) & (F.col("_n") >= 3)
    return ranked.where(~crowded & (F.col("_r") <= cap)).drop("_r", "_n")


def unwrapped(rows: DataFrame, keys: list[str], order: str, angle: str) -> DataFrame:
    """Adds unwrapped: angles in degrees continued without jumps of more than 180 from the first one."""
    w = Window.partitionBy(*keys).orderBy(order)
    step = F.pmod(F.col(angle) - F.lag(angle).over(w) + 180, F.lit(360.0)) - 180
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_s", F.coalesce(step, F.lit(0.0))).withColumn("unwrapped", F.first(angle).over(run) + F.sum("_s").over(run)).drop("_s")


def coverage(rows: DataFrame, keys: list[str], angle: str) -> DataFrame:
    """(keys, coverage): 360 less the greatest gap around the circle; a single angle covers nothing."""
    w = Window.partitionBy(*keys).orderBy(angle)
    whole = Window.partitionBy(*keys)
    gap = F.coalesce(F.lead(angle).over(w), F.min(angle).over(whole) + 360) - F.col(angle)
    return rows.withColumn("_g", gap).groupBy(*keys).agg((360 - F.max("_g")).alias("coverage"))


def path_length(rows: DataFrame, keys: list[str], order: str, x: str = "x", y: str = "y") -> DataFrame:
    """(keys, length): the sum of the steps between consecutive points."""
    w = Window.partitionBy(*keys).orderBy(order)
    step = F.hypot(F.lead(x).over(w) - F.col(x), F.lead(y).over(w) - F.col(y))
    return rows.withColumn("_d", step).groupBy(*keys).agg(F.coalesce(F.sum("_d"), F.lit(0.0)).alias("length"))


def pairs(vertices: Column) -> Column:
    """Consecutive pairs of an array as structs (a, b)."""
    n = F.size(vertices)
    return F.when(n > 1, F.transform(F.slice(vertices, F.lit(1), n - 1), lambda a, i: F.struct(a.alias("a"), F.get(vertices, i + 1).alias("b")))).otherwise(F.array())


def ring_pairs(vertices: Column) -> Column:
    """Consecutive pairs around a ring, the last with the first; a repeated last vertex counts once."""
    open_ring = F.when((F.size(vertices) > 1) & (F.get(vertices, F.lit(0)) == F.element_at(vertices, -1)), F.slice(vertices, F.lit(1), F.size(vertices) - 1)).otherwise(vertices)
    return F.transform(open_ring, lambda a, i: F.struct(a.alias("a"), F.get(open_ring, F.pmod(i + 1, F.size(open_ring)).cast("int")).alias("b")))


def windows_along(length: Column, width: int, overlap: int) -> Column:
    """Starts of overlapped windows along a strip; the last one begins no later than needed to reach its end."""
    step = max(1, width - overlap)
    last = F.greatest(F.lit(0), F.ceil((length - width) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: i * step)


def tiles(sheets: DataFrame, width: str, height: str, size: int, overlap: int, least: int = 400) -> DataFrame:
    """Overlapped tiles (x0, y0, x1, y1) of each sheet, cut at its edges; tiles smaller than least either way are left out."""
    xs = sheets.withColumn("x0", F.explode(windows_along(F.col(width), size, overlap))).withColumn("y0", F.explode(windows_along(F.col(height), size, overlap)))
    cut = xs.withColumns({"x1": F.least(F.col("x0") + size, F.col(width)), "y1": F.least(F.col("y0") + size, F.col(height))})
    return cut.where((F.col("x1") - F.col("x0") >= least) & (F.col("y1") - F.col("y0") >= least))


def first_passing(rows: DataFrame, keys: list[str], passing: Column, *order: Column) -> DataFrame:
    """The first row of each key, in the order, that passes."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.where(passing).withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")
