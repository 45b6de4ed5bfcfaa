"""Scores of reads against keys: votes, recall by sheet and pooled, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def votes(reads: DataFrame, keys: list[str], sample: str, raw: str = "raw", kind: str = "kind") -> DataFrame:
    """(keys, kind, raw, votes): how many samples hold each trimmed read; a sample votes once."""
    return reads.groupBy(*keys, kind, F.trim(raw).alias(raw)).agg(F.count_distinct(sample).alias("votes"))


def consensus(reads: DataFrame, keys: list[str], sample: str, least: int) -> DataFrame:
    """Reads that at least so many samples hold."""
    return votes(reads, keys, sample).where(F.col("votes") >= least)


def frontier(reads: DataFrame, keys: list[str], sample: str, options: list[tuple[str, int, int]]) -> DataFrame:
    """(keys, option, n): reads left by each (name, samples used, least votes), all options in one aggregation."""
    cases = F.array(*(F.struct(F.lit(n).alias("option"), F.lit(k).alias("used"), F.lit(v).alias("least")) for n, k, v in options))
    many = reads.withColumn("_o", F.explode(cases)).where(F.col(sample) < F.col("_o.used"))
    v = many.groupBy(*keys, "_o", "kind", F.trim("raw").alias("raw")).agg(F.count_distinct(sample).alias("votes")).where(F.col("votes") >= F.col("_o.least"))
    return v.groupBy(*keys, F.col("_o.option").alias("option")).agg(F.count("*").alias("n"))


def pooled(results: DataFrame, sheet: str, hits: str, total: str) -> DataFrame:
    """(sheet, hits, total, recall): each sheet and, with a null sheet, all of them together, in one pass of grouping sets."""
    s = results.groupingSets([[F.col(sheet)], []], F.col(sheet)).agg(F.sum(hits).alias("hits"), F.sum(total).alias("total"))
    return s.withColumn("recall", F.try_divide("hits", "total"))


def summary(results: DataFrame, hits: str, total: str, seconds: str) -> DataFrame:
    """One row: pooled and macro recall, and how run time goes with size."""
    r = F.try_divide(hits, total)
    return results.agg(F.count("*").alias("sheets"), F.try_divide(F.sum(hits), F.sum(total)).alias("micro"), F.avg(r).alias("macro_mean"), F.median(r).alias("macro_median"), F.max(seconds).alias("max_seconds"), F.corr(seconds, total).alias("correlation"))


def sheet_report(rings: DataFrame, courses: DataFrame) -> DataFrame:
    """(sheet, ...) counts of courses, flags and rings; sheets without rings have zeros."""
    c = courses.groupBy("sheet").agg(F.count("*").alias("courses"), F.count_if(F.size("flags") == 0).alias("clean"), F.count_if(F.size("flags") > 0).alias("flagged"))
    r = rings.groupBy("sheet").agg(F.count("*").alias("rings"), F.count_if("passed").alias("rings_passed"), F.max("misclosure").alias("worst"))
    return c.join(r, "sheet", "left").select("sheet", "courses", "clean", "flagged", F.coalesce("rings", F.lit(0)).alias("rings"), F.coalesce("rings_passed", F.lit(0)).alias("rings_passed"), "worst")


def page_audit(pages: DataFrame, sheet: str, page: str, count: str, keyed: str, order: Column | None = None) -> DataFrame:
    """(sheet, best_page, best, pages, key_page, keyed, fine): the page with most finds, the first of equals by order (by
    default, and where that is equal too, the page itself), the finds of the keyed page, and whether they are at least
    0.8 of the most. A keyed page that the sheet doesn't have counts as none."""
    first = F.struct(F.col(count), -(F.col(page) if order is None else order), -F.col(page))
    g = pages.groupBy(sheet).agg(
        F.max_by(F.col(page), first).alias("best_page"), F.max(count).alias("best"), F.count("*").alias("pages"),
        F.max(keyed).alias("key_page"), F.max(F.when(F.col(page) == F.col(keyed), F.col(count))).alias("keyed"),
    )
    return g.withColumn("fine", F.coalesce(F.col("keyed"), F.lit(0)) >= 0.8 * F.col("best"))


def orientation(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, angle, along, across): principal direction in degrees mod 180 and the standard deviations along and across it."""
    g = rows.groupBy(*keys).agg(F.var_pop(x).alias("a"), F.var_pop(y).alias("b"), F.covar_pop(x, y).alias("c"))
    mean, half = (F.col("a") + F.col("b")) / 2, F.hypot((F.col("a") - F.col("b")) / 2, F.col("c"))
    return g.select(*keys, F.pmod(F.degrees(F.atan2(2 * F.col("c"), F.col("a") - F.col("b")) / 2), F.lit(180.0)).alias("angle"), F.sqrt(mean + half).alias("along"), F.sqrt(F.greatest(mean - half, F.lit(0.0))).alias("across"))


def kind_gate(kind: Column, wanted: str, value: Column) -> Column:
    """Whether a read counts as of the wanted kind: by its kind, or, where that is missing, by whether it can be parsed."""
    return (kind == wanted) | (kind.isNull() & value.isNotNull())


def admitted(candidates: DataFrame, sheet: str, recall: str, year: str, least: float = 0.3) -> DataFrame:
    """The latest candidate of each sheet whose recall reaches the gate."""
    w = Window.partitionBy(sheet).orderBy(F.col(year).desc())
    return candidates.where(F.col(recall) >= least).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def sane_key(n_bearings: Column, n_distances: Column) -> Column:
    return (n_bearings >= 8) & (n_distances >= 3) & (n_distances <= 4 * n_bearings) & (n_bearings <= 80)


def area_spread(rows: DataFrame, keys: list[str], ratio: str) -> DataFrame:
    """(keys, spread): greatest over least ratio, less one."""
    return rows.groupBy(*keys).agg((F.try_divide(F.max(ratio), F.min(ratio)) - 1).alias("spread"))


def curve_rows(inline: DataFrame, table: DataFrame) -> DataFrame:
    """Curves of the table and those inline ones that it doesn't have: a curve is the same if radius and length agree
    to one decimal place, a missing length counting as 0."""
    one = lambda c: F.bround(F.coalesce(F.col(c), F.lit(0.0)).cast("double"), 1)
    key = lambda df: df.withColumns({"_r": one("radius"), "_l": one("length")})
    extra = key(inline).join(key(table).select("sheet", "_r", "_l").distinct(), ["sheet", "_r", "_l"], "left_anti").drop("_r", "_l")
    return table.unionByName(extra.select(*table.columns))
