"""Readers of plan files: explicit schemas, one normaliser for each shape, columns keyed by sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cadastra.functions.text import crop_of

#: Fixed field names of the plan files.
PLAN = "lines array<array<string>>, arcs array<array<string>>, circles array<array<string>>, texts array<array<string>>, polylines array<array<string>>"
KEY = "bearings_dms array<string>, bearings_az array<double>, distances_m array<double>, gt_legs_m array<double>, unit string, page int, note string"
TABLES = "lines array<struct<id:string,bearing:string,distance:double>>, curves array<struct<id:string,src:string,radius:double,delta:string,length:double,chord_brg:string,chord_len:double,tangent:double>>, note string"
MANIFEST = "plans array<struct<id:string,title:string,reads:string,results:string>>, tolerances struct<dist_m:double,bearing_arcmin:double,shape_m:double,shape_frac:double,closure_m:double,area_m2:double>"
READS = "map<string,array<struct<raw:string,kind:string,rotated:boolean>>>"
READPLAN = "slug string, tiles array<struct<r:int,c:int,x0:int,y0:int,x1:int,y1:int,content:double>>"


def sheet_of(path: Column) -> Column:
    """A sheet's name from a file's: the last path segment up to the first dot."""
    return F.element_at(F.split(F.element_at(F.split(path, "/"), -1), r"\."), 1)


def json_files(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Whole JSON files with a sheet column; files that can't be parsed give nulls."""
    return spark.read.schema(schema).json(path, multiLine=True).withColumn("sheet", sheet_of(F.input_file_name()))


def plan_lines(plans: DataFrame) -> DataFrame:
    """(sheet, line, x0, y0, x1, y1, layer) of positional line lists; malformed numbers are null."""
    at = lambda i: F.get("l", F.lit(i))
    rows = plans.select("sheet", F.posexplode("lines").alias("line", "l"))
    return rows.select("sheet", "line", *(at(i).try_cast("double").alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))), at(4).alias("layer"))


def plan_arcs(plans: DataFrame) -> DataFrame:
    at = lambda i: F.get("l", F.lit(i))
    rows = plans.select("sheet", F.posexplode("arcs").alias("arc", "l"))
    return rows.select("sheet", "arc", *(at(i).try_cast("double").alias(n) for i, n in enumerate(("cx", "cy", "r", "start_deg", "end_deg"))), at(5).alias("layer"))


def plan_vertices(plans: DataFrame, least: int = 1) -> DataFrame:
    """(sheet, polyline, pos, x, y, bulge) of ragged polylines, whose last entry is the layer's name; those with fewer than least vertices go."""
    rows = plans.select("sheet", F.posexplode("polylines").alias("polyline", "p")).where(F.size("p") - 1 >= least)
    v = rows.select("sheet", "polyline", F.element_at("p", -1).alias("layer"), F.posexplode(F.slice("p", F.lit(1), F.size("p") - 1)).alias("pos", "v"))
    n = F.from_json("v", "array<double>")
    return v.select("sheet", "polyline", "pos", F.get(n, F.lit(0)).alias("x"), F.get(n, F.lit(1)).alias("y"), F.get(n, F.lit(2)).alias("bulge"), "layer")


def golden_values(keys: DataFrame) -> DataFrame:
    """(sheet, kind, raw, value): bearings as printed or as azimuths, distances of either name."""
    b = keys.select("sheet", F.explode("bearings_dms").alias("raw")).select("sheet", F.lit("bearing").alias("kind"), "raw", F.lit(None).cast("double").alias("value"))
    none = F.coalesce(F.size("bearings_dms"), F.lit(0)) <= 0
    a = keys.where(none).select("sheet", F.explode("bearings_az").alias("value")).select("sheet", F.lit("bearing").alias("kind"), F.lit(None).cast("string").alias("raw"), "value")
    d = keys.select("sheet", F.explode(F.coalesce("distances_m", "gt_legs_m")).alias("value")).select("sheet", F.lit("distance").alias("kind"), F.lit(None).cast("string").alias("raw"), "value")
    return b.unionByName(a).unionByName(d)


def crop_reads(rows: DataFrame, reads: str = "reads") -> DataFrame:
    """(sheet, seg, win, raw, kind, rotated) of a map from crop names to read items; malformed names are left out."""
    e = rows.select("sheet", F.explode(reads).alias("crop", "items")).select("sheet", "crop", F.explode("items").alias("i"))
    seg, win = crop_of(F.col("crop"))
    return e.select("sheet", seg.alias("seg"), win.alias("win"), "i.raw", "i.kind", "i.rotated").where("seg is not null and win is not null")


def curve_table(tables: DataFrame) -> DataFrame:
    return tables.select("sheet", F.inline("curves"))


def line_table(tables: DataFrame) -> DataFrame:
    return tables.select("sheet", F.inline("lines"))


def manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(plans, tolerances)."""
    m = spark.read.schema(MANIFEST).json(path, multiLine=True)
    return m.select(F.inline("plans")), m.select("tolerances.*")


def page_text(spark: SparkSession, path: str) -> DataFrame:
    """(sheet, text) of pages extracted as text files."""
    return spark.read.text(path, wholetext=True).select(sheet_of(F.input_file_name()).alias("sheet"), F.col("value").alias("text"))


def tsv(spark: SparkSession, path: str, schema: str, where: str = "true") -> DataFrame:
    return spark.read.schema(schema).csv(path, sep="\t", header=True).where(where)


def items(spark: SparkSession, path: str) -> DataFrame:
    """(item, name): lines of a list, and what follows the last slash."""
    return spark.read.text(path).select(F.trim("value").alias("item")).where("item <> ''").withColumn("name", F.substring_index("item", "/", -1))


def files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, name, length) of files, without reading their content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def probe_ids(spark: SparkSession, first: int, last: int, width: int = 50) -> DataFrame:
    """(n, label, name): numbered records to probe, with the label of their range."""
    from cadastra.functions.text import range_label

    return spark.range(first, last + 1).select(F.col("id").alias("n"), range_label(F.col("id"), width).alias("label"), F.format_string("ms%03d", F.col("id")).alias("name"))
