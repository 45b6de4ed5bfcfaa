"""Writers of plan files and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plan_rows(lines: DataFrame, arcs: DataFrame, polylines: DataFrame) -> DataFrame:
    """(sheet, lines, arcs, circles, texts, polylines) as positional lists, from lines(sheet, line, x0..y1, layer),
    arcs(sheet, arc, cx, cy, r, start_deg, end_deg, layer), polylines(sheet, polyline, pos, x, y, bulge, layer)."""
    text = lambda *c: F.array(*(F.round(x, 4).cast("string") if x != "layer" else F.col(x) for x in c))
    gather = lambda df, order, *c: df.groupBy("sheet").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, text(*c).alias("v")))), lambda s: s["v"]).alias("v"))
    vertex = F.when(F.col("bulge").isNull(), F.array(F.round("x", 4), F.round("y", 4))).otherwise(F.array(F.round("x", 4), F.round("y", 4), F.round("bulge", 6)))
    p = polylines.groupBy("sheet", "polyline").agg(F.array_sort(F.collect_list(F.struct("pos", F.to_json(vertex).alias("j")))).alias("q"), F.first("layer").alias("layer"))
    p = p.select("sheet", "polyline", F.array_append(F.transform("q", lambda s: s["j"]), F.col("layer")).alias("v"))
    polys = p.groupBy("sheet").agg(F.transform(F.array_sort(F.collect_list(F.struct("polyline", "v"))), lambda s: s["v"]).alias("polylines"))
    out = gather(lines, "line", "x0", "y0", "x1", "y1", "layer").withColumnRenamed("v", "lines").join(gather(arcs, "arc", "cx", "cy", "r", "start_deg", "end_deg", "layer").withColumnRenamed("v", "arcs"), "sheet", "full").join(polys, "sheet", "full")
    empty = F.array().cast("array<array<string>>")
    return out.select("sheet", *(F.coalesce(c, empty).alias(c) for c in ("lines", "arcs")), empty.alias("circles"), empty.alias("texts"), F.coalesce("polylines", empty).alias("polylines"))


def write_json(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object a sheet; a folder of part files, dealt by sheet."""
    rows.write.mode(mode).json(path)


def append_tsv(rows: DataFrame, path: str) -> None:
    """Appends result rows; every part file has a header, which the reader expects."""
    rows.write.mode("append").csv(path, sep="\t", header=True)


def flattened(polylines: DataFrame) -> DataFrame:
    """(sheet, polyline, pos, x0, y0, x1, y1, bulge): polylines restated as single pieces, from the same rounded values."""
    from pyspark.sql import Window

    w = Window.partitionBy("sheet", "polyline").orderBy("pos")
    v = polylines.withColumns({"x0": F.round("x", 4), "y0": F.round("y", 4)})
    return v.withColumns({"x1": F.lead("x0").over(w), "y1": F.lead("y0").over(w)}).where("x1 is not null").select("sheet", "polyline", "pos", "x0", "y0", "x1", "y1", "bulge")
