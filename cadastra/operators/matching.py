"""One-to-one tolerance matching of lists, one row a sheet: folds over arrays, and a search in Python for long ones."""

from __future__ import annotations

import bisect
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.functions.angles import axis_between


def greedy_hits(reads: Column, truth: Column, tolerance: float, modulo: bool = False, strict: bool = False) -> Column:
    """Number of reads, in order, that take the nearest truth not taken yet within the tolerance.

    Of equally near ones the last is taken; strict: the tolerance is exclusive and the first is taken.
    """
    def near(q, r):
        return axis_between(q, r) if modulo else F.abs(q - r)

    def step(s, r):
        d = F.transform(s["pool"], lambda q: near(q, r))
        least = F.array_min(d)
        ok = F.coalesce(least < tolerance if strict else least <= tolerance, F.lit(False))
        at = F.array_position(d, least).cast("int") if strict else (F.size(d) - F.array_position(F.reverse(d), least).cast("int") + 1)
        rest = F.filter(s["pool"], lambda q, i: i != at - 1)
        return F.struct(F.when(ok, rest).otherwise(s["pool"]).alias("pool"), (s["hit"] + F.when(ok, 1).otherwise(0)).alias("hit"))

    start = F.struct(F.coalesce(truth, F.array().cast("array<double>")).alias("pool"), F.lit(0).alias("hit"))
    return F.aggregate(F.coalesce(reads, F.array().cast("array<double>")), start, step, lambda s: s["hit"])


def _taken(reads: np.ndarray, truth: np.ndarray, tolerance: float, modulo: bool) -> int:
    """greedy_hits of one row by a search in the sorted distinct truths; those used up are skipped by links that shorten
    themselves."""
    places: dict[float, list[int]] = {}
    for i, v in enumerate(truth.tolist()):
        places.setdefault(v, []).append(i)
    held = sorted(places, key=lambda v: math.fmod(math.fmod(v, 180.0) + 180.0, 180.0)) if modulo else sorted(places)
    at = [math.fmod(math.fmod(v, 180.0) + 180.0, 180.0) for v in held] if modulo else held
    own, n, hit = [places[v] for v in held], len(held), 0
    ups, downs = list(range(n + 1)), list(range(n + 1))  # downs are one place up: downs[i + 1] is about place i

    def free(link, i):
        top = i
        while link[top] != top:
            top = link[top]
        while link[i] != top:
            link[i], i = top, link[i]
        return top

    for r in reads.tolist():
        m = math.fmod(math.fmod(r, 180.0) + 180.0, 180.0) if modulo else r
        best = None
        for lap in (0.0, -180.0, 180.0) if modulo else (0.0,):
            k = bisect.bisect_left(at, m + lap)
            for link, i, step in ((ups, k, 1), (downs, k, -1)):
                near = None
                while True:
                    i = free(link, i)
                    j = i if step > 0 else i - 1
                    # Rounding may bring places that differ by it to one distance, so all of those are looked at.
                    if not 0 <= j < n or near is not None and abs(at[j] - m - lap) > near + 1e-9:
                        break
                    near = abs(at[j] - m - lap) if near is None else near
                    if near > tolerance + 1e-9:
                        break
                    d = abs(held[j] - r)
                    if modulo:
                        d = math.fmod(d, 180.0)
                        d = min(d, 180.0 - d)
                    if d <= tolerance and (best is None or (d, -own[j][-1]) < best[0]):
                        best = (d, -own[j][-1]), j
                    i += step
        if best:
            j, hit = best[1], hit + 1
            own[j].pop()
            if not own[j]:
                ups[j], downs[j + 1] = j + 1, j
    return hit


def greedy_hits_of_long(reads: Column, truth: Column, tolerance: float, modulo: bool = False) -> Column:
    """greedy_hits for lists of any length: a search for each read, not a pass over all truths that are left."""

    @F.pandas_udf("int")
    def hits(r: pd.Series, t: pd.Series) -> pd.Series:
        array = lambda v: np.zeros(0) if v is None else np.asarray([x for x in v if x is not None and x == x], float)
        return pd.Series([_taken(array(a), array(b), tolerance, modulo) for a, b in zip(r, t)], dtype="int32")

    return hits(reads, truth)


def greedy_candidate_hits(truth: Column, candidates: Column, tolerance: float) -> Column:
    """Number of truths, in order, matched by a read that is still free; a read is a list of azimuths (mod 180).

    The nearest read wins, by the first of its azimuths within what is best so far; of equals the last.
    """
    empty = F.array().cast("array<array<double>>")

    def step(s, w):
        def scan(b, c_i):
            d = F.aggregate(c_i["c"], F.lit(None).cast("double"), lambda m, a: F.coalesce(m, F.when(axis_between(a, w) <= b["d"], axis_between(a, w))))
            return F.when(d.isNotNull(), F.struct(d.alias("d"), c_i["i"].alias("i"))).otherwise(b)

        start = F.struct(F.lit(float(tolerance)).alias("d"), F.lit(-1).alias("i"))
        numbered = F.transform(s["pool"], lambda c, i: F.struct(c.alias("c"), i.alias("i")))
        best = F.aggregate(numbered, start, scan)
        return F.struct(F.filter(s["pool"], lambda _, i: i != best["i"]).alias("pool"), (s["hit"] + F.when(best["i"] >= 0, 1).otherwise(0)).alias("hit"))

    pool = F.filter(F.coalesce(candidates, empty), lambda c: F.size(c) > 0)
    return F.aggregate(F.coalesce(truth, F.array().cast("array<double>")), F.struct(pool.alias("pool"), F.lit(0).alias("hit")), step, lambda s: s["hit"])


def greedy_pairs(wants: Column, pool: Column, tolerance) -> Column:
    """Array of struct(want, got, hit): each want, in order, takes the nearest free value; hit when within tolerance(want).

    A want whose nearest free value lies outside takes nothing and has a null got; of equals the first is taken.
    """
    kind = "array<struct<want:double,got:double,hit:boolean>>"

    def step(s, w):
        d = F.transform(s["pool"], lambda q: F.abs(q - w))
        at = F.array_position(d, F.array_min(d)).cast("int")
        ok = F.coalesce(F.array_min(d) <= tolerance(w), F.lit(False))
        got = F.when(ok, F.get(s["pool"], at - 1))
        row = F.struct(w.alias("want"), got.alias("got"), ok.alias("hit"))
        return F.struct(F.when(ok, F.filter(s["pool"], lambda q, i: i != at - 1)).otherwise(s["pool"]).alias("pool"), F.array_append(s["out"], row).alias("out"))

    start = F.struct(F.coalesce(pool, F.array().cast("array<double>")).alias("pool"), F.array().cast(kind).alias("out"))
    return F.aggregate(F.coalesce(wants, F.array().cast("array<double>")), start, step, lambda s: s["out"])


def paired_by_position(bearings: Column, distances: Column) -> Column:
    """Each bearing (struct with pos) with the nearest free distance by position, the first of equals; leftovers alone.

    Array of struct(b, d), b and d being places in the two arrays or null.
    """
    kind = "array<struct<b:int,d:int>>"
    numbered = lambda a: F.transform(a, lambda x, i: F.struct(x["pos"].cast("double").alias("pos"), i.alias("i")))

    def step(s, b):
        gaps = F.transform(s["free"], lambda d: F.struct(F.abs(d["pos"] - b["pos"]).alias("g"), d["i"].alias("i")))
        best = F.array_min(gaps)
        return F.struct(F.filter(s["free"], lambda d: ~F.coalesce(d["i"] == best["i"], F.lit(False))).alias("free"), F.array_append(s["out"], F.struct(b["i"].alias("b"), best["i"].alias("d"))).alias("out"))

    start = F.struct(numbered(distances).alias("free"), F.array().cast(kind).alias("out"))
    rest = lambda s: F.concat(s["out"], F.transform(s["free"], lambda d: F.struct(F.lit(None).cast("int").alias("b"), d["i"].alias("d"))))
    return F.aggregate(numbered(bearings), start, step, rest)


def distinct_within(values: Column, tolerance: float) -> Column:
    """Values, in order, that differ by more than the tolerance from every value kept before."""
    none = F.array().cast("array<double>")
    return F.aggregate(values, none, lambda kept, v: F.when(F.exists(kept, lambda u: F.abs(v - u) <= tolerance), kept).otherwise(F.array_append(kept, v)))


def thinned(values: Column, tolerance: float) -> Column:
    """Sorted values that lie more than the tolerance beyond the last one kept."""
    none = F.array().cast("array<double>")
    return F.aggregate(F.array_sort(values), none, lambda kept, v: F.when((F.size(kept) == 0) | (v - F.try_element_at(kept, F.lit(-1)) > tolerance), F.array_append(kept, v)).otherwise(kept))


def upper_median(values: Column) -> Column:
    """The middle one of the sorted values, the upper of two."""
    s = F.array_sort(F.array_compact(values))
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


def recall(hits: Column, total: Column) -> Column:
    return F.try_divide(hits, total)


def ratio_scale(left: DataFrame, right: DataFrame, key: str, value: str, size: int = 8) -> DataFrame:
    """(key, scale): the median of left over right among the size greatest of each, paired by rank; ranks are limited before the join."""
    def ranked(df, name):
        w = Window.partitionBy(key).orderBy(F.col(value).desc())
        return df.select(key, value, F.row_number().over(w).alias("_r")).where(F.col("_r") <= size).select(key, "_r", F.col(value).alias(name))

    both = ranked(left, "_a").join(ranked(right, "_b"), [key, "_r"])
    return both.groupBy(key).agg(F.median(F.try_divide("_a", "_b")).alias("scale"))


def circular_mode(rows: DataFrame, key: str, residual: str, ordinal: str, tolerance: float = 1.0) -> DataFrame:
    """(key, theta, inliers, total): the residual (mod 180) that most residuals of its key lie around, the first by
    ordinal of equals, moved by the upper median of its inliers. One row a key as arrays, so no self-join."""
    from cadastra.functions.angles import wrap180

    held = rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.col(residual).alias("v")))), lambda s: s["v"]).alias("_v"))
    votes = F.transform("_v", lambda c, i: F.struct(F.size(F.filter("_v", lambda r: F.abs(wrap180(r - c)) <= tolerance)).alias("n"), (-i).alias("o"), c.alias("c")))
    best = held.withColumn("_b", F.array_max(votes))
    inside = F.filter(F.transform("_v", lambda r: wrap180(r - F.col("_b.c"))), lambda d: F.abs(d) <= tolerance)
    return best.select(key, wrap180(F.col("_b.c") + upper_median(inside)).alias("theta"), F.col("_b.n").alias("inliers"), F.size("_v").alias("total"))
