"""Stand-in survey inputs derived from the general tables, one text for Spark and DuckDB.

The tables hold no plats; these deterministic views give the operators rows of the right shape. They prove operators,
not accuracy on plats. DIV is whole division, PRINTF formats, EL(a,i) is the i-th entry, from 1.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    # rings of courses: az in hundredths of a degree, d in whole units
    "v_legs": """SELECT l_orderkey AS ring, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos,
        ((l_partkey*37 + l_linenumber*61) % 36000) AS h, ((l_partkey*37 + l_linenumber*61) % 36000)/100.0e0 AS az, l_quantity AS d, l_partkey AS pk, l_linenumber AS ln FROM lineitem""",
    # printed bearings: one in 7 without E or W, one in 11 without a degree sign
    "v_quadrant": """SELECT ring, pos, pk, h, CASE WHEN h < 9000 OR h >= 27000 THEN 'N' ELSE 'S' END AS ns, CASE WHEN h < 18000 THEN 'E' ELSE 'W' END AS ew,
        (CASE WHEN h < 9000 THEN h WHEN h < 18000 THEN 18000 - h WHEN h < 27000 THEN h - 18000 ELSE 36000 - h END) * 36 AS secs FROM v_legs""",
    "v_bearings": """SELECT ring, pos, pk, h, PRINTF('%s%d%s%02d''%02d"%s', ns, CAST(secs DIV 3600 AS INT), CASE WHEN pk % 11 = 0 THEN ' ' ELSE '°' END, CAST((secs % 3600) DIV 60 AS INT), CAST(secs % 60 AS INT), CASE WHEN pk % 7 = 0 THEN '' ELSE ew END) AS raw FROM v_quadrant""",
    "v_segments": """SELECT CAST(label AS BIGINT) AS sheet, vec_id AS seg, round(CAST(EL(embedding,1) AS DOUBLE)*1000, 3) AS x0, round(CAST(EL(embedding,2) AS DOUBLE)*1000, 3) AS y0,
        round(CAST(EL(embedding,3) AS DOUBLE)*1000, 3) AS x1, round(CAST(EL(embedding,4) AS DOUBLE)*1000, 3) AS y1 FROM embeddings""",
    "v_labels": """SELECT CAST(label AS BIGINT) AS sheet, vec_id AS label, round(CAST(EL(embedding,5) AS DOUBLE)*1000, 3) AS cx, round(CAST(EL(embedding,6) AS DOUBLE)*1000, 3) AS cy,
        round(CAST(EL(embedding,7) AS DOUBLE)*500 + 500, 2) % 180.0e0 AS angle, 8.0e0 AS size, round(CAST(EL(embedding,8) AS DOUBLE)*100 + 200, 2) AS v FROM embeddings""",
    "v_reads": """SELECT user_id AS sheet, CAST(event_id % 5 AS INT) AS sample, event_type AS kind, CAST(CAST(round(value) AS INT) AS STRING) AS raw, round(value, 2) AS v, event_id FROM events""",
    "v_truth": """SELECT l_orderkey AS sheet, round(l_quantity + (l_partkey % 5)/10.0e0, 2) AS truth, round(l_quantity + (l_suppkey % 7)/20.0e0, 2) AS got, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk FROM lineitem""",
    "v_curves": """SELECT p_partkey AS curve, p_retailprice AS r, p_size*1.5e0 AS delta FROM part WHERE p_retailprice > 0""",
    "v_results": """SELECT o_custkey AS sheet, o_orderkey AS variant, CAST(o_orderkey % 40 AS INT) AS hits, CAST(40 + o_orderkey % 60 AS INT) AS total, CAST(30 + (o_orderkey*7) % 200 AS INT) AS seconds FROM orders""",
    # pages of a sheet's document with 0 to 39 courses, printed in two ways, and texts that are none
    "v_sheet_pages": """SELECT o_custkey AS sheet, o_orderkey AS variant, 'S 5 ft of N 12.5 E, 12° 30’ ' || repeat('N 12°30’15"E 100.00 ', CAST(o_orderkey % 40 AS INT) DIV 2)
        || repeat('s. 5 o 07' || chr(39) || ' W ', CAST(o_orderkey % 40 AS INT) - CAST(o_orderkey % 40 AS INT) DIV 2) || 'N°30’ E45°' AS body FROM orders""",
    "v_pages": """SELECT doc_id AS page, concat('Course: N', CAST(doc_id % 89 AS STRING), '°', PRINTF('%02d', CAST(doc_id % 60 AS INT)), '''', PRINTF('%02d', CAST((doc_id*7) % 60 AS INT)), '"E ', 'Length: ', CAST(100 + doc_id % 700 AS STRING), '.', PRINTF('%02d', CAST(doc_id % 100 AS INT)),
        ''' R=15.500 S05°00''00"W ', CAST(doc_id % 50 + 1 AS STRING), ',', PRINTF('%03d', CAST(doc_id % 1000 AS INT)), '.25 Area = 929.90 m2 12345.60 SF, rec. ', CAST(1900 + doc_id % 120 AS STRING), ' and ', CAST(1990 + doc_id % 30 AS STRING)) AS body FROM documents""",
    "v_townships": """SELECT c_custkey AS page, CASE c_nationkey % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'S' WHEN 2 THEN 'E' ELSE 'W' END AS dir, CAST(c_custkey % 20 AS INT) AS t, CAST((c_custkey DIV 20) % 15 AS INT) AS r FROM customer""",
    "v_targets": """SELECT s_suppkey AS sheet, CAST(s_suppkey % 20 AS INT) AS t, CAST((s_suppkey*3) % 15 AS INT) AS r FROM supplier""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _spark(sql: str) -> str:
    sql = re.sub(r"EL\((\w+),(\d+)\)", r"element_at(\1,\2)", sql).replace("PRINTF(", "format_string(").replace(" DIV ", " div ")
    return sql.replace("''%02d\"%s'", "\\'%02d\"%s'").replace("''''", "\"'\"").replace("''' R=15.500 S05°00''00\"W '", "\"' R=15.500 S05°00'00\\\"W \"")


def _duck(sql: str) -> str:
    return re.sub(r"EL\((\w+),(\d+)\)", r"\1[\2]", sql).replace("PRINTF(", "printf(").replace(" DIV ", " // ").replace(" AS STRING)", " AS VARCHAR)")


def _lambdas(sql: str) -> str:
    """x -> f(x), which Spark and older DuckDB read, as DuckDB wants it now."""
    return re.sub(r"\b([a-z]) -> ", r"lambda \1: ", sql)


def _needs(name: str) -> list[str]:
    """Views that a view stands on, then itself."""
    out: list[str] = []
    for other in VIEWS:
        if other != name and re.search(rf"\b{other}\b", VIEWS[name]):
            out += [x for x in _needs(other) if x not in out]
    return [*out, name]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in as a DataFrame; only what it needs is read."""
    known = {}
    for v in _needs(name):
        text = _spark(VIEWS[v])
        for t in TABLES:
            if re.search(rf"\bFROM {t}\b", text):
                known[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        known[v] = spark.sql(re.sub(r"\bFROM (\w+)\b", r"FROM {\1}", text), **{k: d for k, d in known.items() if re.search(rf"\bFROM {k}\b", text)})
    return known[name]


def duck(sql: str) -> str:
    """An oracle over the views: those it names are put in front of it."""
    wanted: list[str] = []
    for v in VIEWS:
        if re.search(rf"\b{v}\b", sql):
            wanted += [x for x in _needs(v) if x not in wanted]
    parts = ", ".join(f"{v} AS ({_duck(VIEWS[v])})" for v in wanted)
    body = _lambdas(sql.strip())
    if not parts:
        return body
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(head):
            return f"{head}{parts}, {body[len(head):]}"
    return f"WITH {parts} {body}"
