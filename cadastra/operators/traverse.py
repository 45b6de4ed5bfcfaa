"""Traverses: ordered legs in groups. All windows are partitioned by the group, so rings of any number spread out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.functions import libm
from cadastra.functions.geom import segment_area


def _ordered(group: str, order: str):
    return Window.partitionBy(group).orderBy(order)


def misclosure(legs: DataFrame, group: str, azimuth: str = "az", distance: str = "d", least: int = 1) -> DataFrame:
    """(group, legs, perimeter, misclosure) by a vector sum; one map-side combined aggregation."""
    a = F.radians(F.col(azimuth))
    sums = legs.groupBy(group).agg(F.count("*").alias("legs"), F.sum(distance).alias("perimeter"), F.sum(F.col(distance) * F.sin(a)).alias("_e"), F.sum(F.col(distance) * F.cos(a)).alias("_n"))
    return sums.where(F.col("legs") >= least).select(group, "legs", "perimeter", F.hypot("_e", "_n").alias("misclosure"))


def precision(perimeter: Column, miss: Column, rounded: bool = False, zero: float = 1e-6) -> Column:
    """1:N, truncated or rounded; 'exact' when the misclosure is no more than zero."""
    ratio = F.try_divide(perimeter, miss)
    whole = F.bround(ratio) if rounded else F.floor(ratio)
    return F.when(miss > zero, F.concat(F.lit("1:"), whole.cast("bigint").cast("string"))).otherwise("exact")


def vindicated(perimeter: Column, miss: Column) -> Column:
    """Whether a ring closes: a ratio of at most 1e-4 or a misclosure of at most 0.05."""
    return (F.coalesce(F.try_divide(miss, perimeter), F.lit(1.0)) <= 1e-4) | (miss <= 0.05)


def beyond_tolerance(perimeter: Column, miss: Column, legs: Column) -> Column:
    return (miss > 0.02 * F.sqrt(legs)) & (F.coalesce(F.try_divide(miss, perimeter), F.lit(1.0)) > 1e-4)


def points(legs: DataFrame, group: str, order: str, azimuth: str = "az", distance: str = "d", sine=F.sin, cosine=F.cos) -> DataFrame:
    """Adds e and n, the point that each leg reaches from the origin."""
    w = _ordered(group, order).rowsBetween(Window.unboundedPreceding, 0)
    a = F.radians(F.col(azimuth))
    legs = legs.withColumns({"_e": F.col(distance) * sine(a), "_n": F.col(distance) * cosine(a)})
    return legs.withColumns({"e": F.sum("_e").over(w), "n": F.sum("_n").over(w)}).drop("_e", "_n")


def chords(legs: DataFrame, group: str, order: str, azimuth: str = "az", distance: str = "d", r: str = "r", delta: str = "delta", side: str = "side", sine=F.sin) -> DataFrame:
    """Replaces tangent arc legs (r and delta, no azimuth) by their chords: adds chord_az, chord_d and the tangent after the leg.

    A leg with an azimuth resets the tangent (by its chord and half its angle if it is an arc); tangent arcs turn it
    further. The running turn since the last reset is a window sum, so no loop is needed.
    """
    turn = F.when(F.col(r).isNotNull(), F.when(F.coalesce(F.col(side), F.lit("R")) == "R", 1.0).otherwise(-1.0) * F.col(delta)).otherwise(0.0)
    resets = F.col(azimuth).isNotNull() & F.col(distance).isNotNull()
    legs = legs.withColumns({"_turn": turn, "_run": F.count(F.when(resets, 1)).over(_ordered(group, order).rowsBetween(Window.unboundedPreceding, 0))})
    inside = Window.partitionBy(group, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    base = F.first(F.when(resets, F.col(azimuth) + F.col("_turn") / 2), ignorenulls=True).over(inside)
    turned = F.sum(F.when(resets, 0.0).otherwise(F.col("_turn"))).over(inside)
    tangent = base + turned
    chord_az = F.when(resets, F.col(azimuth)).otherwise(F.col("_tangent") - F.col("_turn") / 2)
    chord = F.when(resets, F.col(distance)).otherwise(2 * F.col(r) * sine(F.radians(F.abs(F.col(delta))) / 2))
    return legs.withColumn("_tangent", tangent).withColumns({"chord_az": chord_az, "chord_d": chord}).withColumnRenamed("_tangent", "tangent_after").drop("_turn", "_run")


def _crosses(group: str, order: str, e: str, n: str) -> Column:
    """Cross product of each corner and the next one of its group, the first following the last."""
    w = _ordered(group, order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    e2, n2 = (F.coalesce(F.lead(c).over(w), F.first(c).over(whole)) for c in (e, n))
    return F.col(e) * n2 - e2 * F.col(n)


def signed_area(corners: DataFrame, group: str, order: str, e: str = "e", n: str = "n") -> DataFrame:
    """(group, signed_area) by coordinates, counter-clockwise positive; the last corner joins the first."""
    return corners.select(group, _crosses(group, order, e, n).alias("_x")).groupBy(group).agg((F.sum("_x") / 2).alias("signed_area"))


def area_with_arcs(legs: DataFrame, group: str, order: str) -> DataFrame:
    """(group, perimeter, closure, area) of lots whose legs (az, d, r, delta, side) may be arcs: chord polygon, and each
    arc's segment added where it bows outward, subtracted where it bows inward. All sums are of one aggregation.

    Sines and squares are the C library's, so that a closure that lies on a limit falls as in SQL."""
    run = points(chords(legs, group, order, sine=libm.sine), group, order, "chord_az", "chord_d", libm.sine, libm.cosine)
    bow = segment_area(F.col("r"), F.radians(F.abs(F.col("delta"))))
    right = F.coalesce(F.col("side"), F.lit("R")) == "R"
    out = run.withColumn("_x", _crosses(group, order, "e", "n")).groupBy(group).agg(
        F.max_by(F.struct("e", "n"), order).alias("_last"), F.sum("d").alias("perimeter"), (F.sum("_x") / 2).alias("signed_area"),
        F.sum(F.when(right, bow)).alias("_right"), F.sum(F.when(F.col("side") == "L", bow)).alias("_left"),
    )
    none = F.lit(0.0)
    net = (F.coalesce("_right", none) - F.coalesce("_left", none)) * F.when(F.col("signed_area") > 0, 1.0).otherwise(-1.0)
    out = out.withColumns({"_e2": libm.square("_last.e"), "_n2": libm.square("_last.n")})
    return out.select(group, "perimeter", F.sqrt(F.col("_e2") + F.col("_n2")).alias("closure"), (F.abs("signed_area") + net).alias("area"))


def validated_lots(legs: DataFrame, printed: DataFrame, group: str, order: str, closure_m: float = 0.05) -> DataFrame:
    """Lots against their own geometry and the printed area (printed: group, printed_area): both tests and whether all pass."""
    lots = area_with_arcs(legs, group, order).join(printed, group, "left")
    tolerance = F.greatest(F.lit(0.5), 0.002 * F.col("printed_area"))
    lots = lots.withColumns({"closure_pass": F.col("closure") <= closure_m, "area_diff": F.col("area") - F.col("printed_area")})
    lots = lots.withColumn("area_pass", F.abs("area_diff") <= tolerance)
    return lots.withColumns({"passed": F.col("closure_pass") & F.coalesce("area_pass", F.lit(True)), "precision_1_in": F.when(F.col("closure") > 1e-12, F.bround(F.col("perimeter") / F.col("closure")).cast("bigint"))})


def block_tiling(lots: DataFrame, block: str, parents: DataFrame) -> DataFrame:
    """(block, n_lots, n_pass, total, parent_area, tiles): lots and road sum to the parent within max(1, 0.2 %)."""
    sums = lots.groupBy(block).agg(F.count("*").alias("n_lots"), F.count_if("passed").alias("n_pass"), F.sum(F.coalesce("area", F.lit(0.0))).alias("_lots"))
    out = sums.join(parents, block).withColumn("total", F.col("_lots") + F.coalesce("road_area", F.lit(0.0)))
    return out.select(block, "n_lots", "n_pass", "total", "parent_area", (F.abs(F.col("total") - F.col("parent_area")) <= F.greatest(F.lit(1.0), 0.002 * F.col("parent_area"))).alias("tiles"))


def corners(ring: DataFrame, group: str, order: str, azimuth: str = "az", turn: float = 22.0) -> DataFrame:
    """Adds corner: whether the edge turns by more than turn degrees from the one before it around the ring."""
    w = _ordered(group, order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag(azimuth).over(w), F.last(azimuth).over(whole))
    # Two turns are added before the rest is taken, as in SQL: a turn that lies on the limit then rounds to the same side.
    return ring.withColumn("corner", F.abs(F.pmod(F.col(azimuth) - before + 180 + 720, F.lit(360.0)) - 180) > turn)


def spans(ring: DataFrame, group: str, order: str) -> DataFrame:
    """Adds span: number of the run between corners around the ring; edges before the first corner belong to the last run.
    A ring without a corner is one span. Needs the column corner."""
    w = _ordered(group, order)
    n = F.sum(F.col("corner").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(F.col("corner").cast("int")).over(Window.partitionBy(group))
    return ring.withColumn("span", F.when(n == 0, total).otherwise(n))


def best_turns(options: DataFrame, group: str, option: str, miss: str, rank: Column | None = None) -> DataFrame:
    """(group, option, misclosure): the option of least rank, by itself its misclosure, the first of equals, and the
    least misclosure."""
    ranked = F.struct((F.col(miss) if rank is None else rank).alias("m"), F.col(option).alias("o"))
    return options.groupBy(group).agg(F.min(ranked).alias("_b"), F.min(miss).alias("_m")).select(group, F.col("_b.o").alias(option), F.col("_m").alias(miss))


def turn_options(legs: DataFrame, group: str, order: str, unknown: str = "unknown") -> DataFrame:
    """Each group once for every choice of turns (left or right) of its legs with an unknown side: adds option, replaces side.

    Option numbers count in binary, the first unknown leg being the highest bit, right before left."""
    w = Window.partitionBy(group).orderBy(order)
    k = F.sum(F.col(unknown).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(F.col(unknown).cast("int")).over(Window.partitionBy(group))
    many = legs.withColumns({"_k": k, "_t": total}).withColumn("option", F.explode(F.sequence(F.lit(0), (F.pow(F.lit(2), F.col("_t")) - 1).cast("int"))))
    bit = F.expr("shiftright(option, _t - _k) & 1")
    return many.withColumn("side", F.when(F.col(unknown), F.when(bit == 0, "R").otherwise("L")).otherwise(F.col("side"))).drop("_k", "_t")
