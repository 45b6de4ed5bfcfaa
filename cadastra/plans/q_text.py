"""Queries: reading bearings, numbers and page text."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastra.functions import angles, text
from cadastra.plans.bridge import view
from cadastra.plans.catalog import query

LOOSE = """d AS (SELECT *, contains(raw, '°') AS ok, regexp_extract_all(raw, '[0-9]+') AS g, CASE WHEN upper(raw)[1] IN ('N','S') THEN upper(raw)[1] END AS rns, CASE WHEN contains(upper(raw)[2:], 'E') THEN 'E' WHEN contains(upper(raw)[2:], 'W') THEN 'W' END AS rew FROM v_bearings),
    a AS (SELECT *, CASE WHEN ok THEN CAST(g[1] AS DOUBLE) + CAST(g[2] AS DOUBLE)/60 + CAST(g[3] AS DOUBLE)/3600 END AS ang FROM d)"""
QAZ = "CASE {ns}||{ew} WHEN 'NE' THEN ang WHEN 'SE' THEN 180 - ang WHEN 'SW' THEN 180 + ang WHEN 'NW' THEN 360 - ang END"


@query(f"WITH {LOOSE} SELECT ring, pos, raw, round(coalesce({QAZ.format(ns='rns', ew='rew')}, ang), 5) AS az FROM a")
def bearing_loose(spark, sf_dir):
    v = view(spark, sf_dir, "v_bearings")
    return v.select("ring", "pos", "raw", F.round(angles.loose_azimuth(F.col("raw")), 5).alias("az"))


@query(f"WITH {LOOSE} SELECT ring, pos, CASE WHEN ang IS NULL THEN '' WHEN rew IS NULL THEN array_to_string(list_sort(list_distinct([round(({QAZ.format(ns='rns', ew=chr(39) + 'E' + chr(39))}) % 360.0e0, 4), round(({QAZ.format(ns='rns', ew=chr(39) + 'W' + chr(39))}) % 360.0e0, 4)])), ',') ELSE CAST(round(({QAZ.format(ns='rns', ew='rew')}) % 360.0e0, 4) AS VARCHAR) END AS candidates FROM a")
def bearing_candidates(spark, sf_dir):
    v = view(spark, sf_dir, "v_bearings")
    c = F.array_distinct(F.transform(angles.azimuth_candidates(F.col("raw")), lambda a: F.round(a, 4)))
    return v.select("ring", "pos", F.array_join(F.transform(c, lambda a: a.cast("string")), ",").alias("candidates"))


STRICT = r"""m AS (SELECT ring, pos, raw, regexp_extract(raw, '^\s*([NSns])?\s*(\d+(?:\.\d+)?)\s*[°º]?\s*(?:(\d+(?:\.\d+)?)\s*[''’′]\s*)?(?:(\d+(?:\.\d+)?)\s*["”″]\s*)?([EWew])?\s*$', ['ns','deg','mi','se','ew']) AS p FROM v_bearings),
    a AS (SELECT *, upper(p.ns) AS sns, upper(p.ew) AS sew, CASE WHEN p.deg <> '' THEN CAST(p.deg AS DOUBLE) + coalesce(TRY_CAST(p.mi AS DOUBLE),0)/60 + coalesce(TRY_CAST(p.se AS DOUBLE),0)/3600 END AS ang FROM m)"""


@query(f"WITH {STRICT} SELECT ring, pos, round(CASE WHEN ang IS NULL THEN NULL WHEN sns = '' AND sew = '' THEN ang ELSE (CASE sns||sew WHEN 'NE' THEN ang WHEN 'SE' THEN 180-ang WHEN 'SW' THEN 180+ang WHEN 'NW' THEN 360-ang WHEN 'N' THEN ang WHEN 'S' THEN 180 WHEN 'E' THEN 90 ELSE 270 END) % 360.0e0 END, 5) AS az FROM a")
def bearing_strict(spark, sf_dir):
    return view(spark, sf_dir, "v_bearings").select("ring", "pos", F.round(angles.strict_degrees(F.col("raw")), 5).alias("az"))


@query("SELECT ring, pos, CASE WHEN pk % 11 = 0 OR pk % 7 = 0 THEN NULL ELSE round((h/100.0e0) % 360.0e0, 4) END AS az FROM v_bearings")
def bearing_full_quadrant(spark, sf_dir):
    return view(spark, sf_dir, "v_bearings").select("ring", "pos", F.round(angles.full_quadrant(F.col("raw")), 4).alias("az"))


@query("SELECT ring, pos, printf('%d°%02d''%02d\"', CAST((h*36) // 3600 AS INT), CAST((h*36) % 3600 // 60 AS INT), CAST((h*36) % 60 AS INT)) AS dms, upper(replace(raw, ' ', '')) AS plain FROM v_bearings")
def bearing_format(spark, sf_dir):
    return view(spark, sf_dir, "v_bearings").select("ring", "pos", angles.to_dms(F.col("h") / 100.0).alias("dms"), angles.plain_bearing(F.col("raw")).alias("plain"))


@query("""SELECT ring, pos, CASE CAST(pk % 5 AS INT) WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN d + 0.25 ELSE d END AS v FROM v_legs""")
def distance_numbers(spark, sf_dir):
    v = view(spark, sf_dir, "v_legs")
    whole = F.col("d").cast("int").cast("string")
    raw = F.when(F.col("pk") % 5 == 0, F.concat(F.lit("R = "), whole)).when(F.col("pk") % 5 == 1, F.concat(whole, F.lit("?"))).when(F.col("pk") % 5 == 2, F.concat(F.lit("East 12 "), whole, F.lit(".25'"))).otherwise(F.concat(whole, F.lit('"')))
    return v.select("ring", "pos", text.last_number(raw).alias("v"))


@query("""SELECT page, array_to_string(list_distinct_ordered, ',') AS bearings FROM (SELECT page, CASE WHEN b1 = b2 THEN [b1] ELSE [b1, b2] END AS list_distinct_ordered FROM (SELECT page, regexp_extract(body, 'N[0-9]+°[0-9]+''[0-9]+"E') AS b1, 'S05°00''00"W' AS b2 FROM v_pages))""")
def page_bearings(spark, sf_dir):
    return view(spark, sf_dir, "v_pages").select("page", F.array_join(text.bearings_in(F.col("body")), ",").alias("bearings"))


@query("""SELECT page, array_to_string(list_transform(list_sort(list_distinct([100 + page % 700 + (page % 100)/100.0e0, CAST((page % 50 + 1)*1000 + page % 1000 AS DOUBLE) + 0.25])), x -> printf('%.2f', x)), ',') AS distances FROM v_pages""")
def page_distances(spark, sf_dir):
    d = text.distances_in(F.col("body"))
    return view(spark, sf_dir, "v_pages").select("page", F.array_join(F.transform(d, lambda x: F.format_string("%.2f", x)), ",").alias("distances"))


@query("SELECT page, CAST(list_max(list_transform(regexp_extract_all(body, '(?:18|19|20)[0-9][0-9]'), x -> CAST(x AS INT))) AS INT) AS year, CASE WHEN page % 3 = 0 THEN 'm' ELSE 'ft' END AS unit FROM v_pages")
def page_years_and_units(spark, sf_dir):
    v = view(spark, sf_dir, "v_pages")
    words = F.when(F.col("page") % 3 == 0, F.lit("12 metres and 5 hectares, 3 feet")).otherwise(F.lit("feet and metres"))
    return v.select("page", text.max_year(F.col("body")).alias("year"), text.unit_vote(words).alias("unit"))


@query(r"""SELECT page_id, left(trim(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')), 80) AS title, array_to_string(regexp_extract_all(html, '(?i)href\s*=\s*["'']([^"'']*)["'']', 1), ' ') AS links,
    left(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 40) AS slug FROM pages""")
def html_scrape(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", text.title_of(F.col("html")).alias("title"), F.array_join(text.links_of(F.col("html")), " ").alias("links"), text.slug(F.col("url")).alias("slug"))


@query("""SELECT page_id, url_decode(replace(list_last(string_split(regexp_replace(url, '/+$', ''), '/')), '+', '%2B')) AS name FROM pages""".replace("list_last(string_split(regexp_replace(url, '/+$', ''), '/'))", "string_split(regexp_replace(url, '/+$', ''), '/')[-1]"))
def url_names(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", text.last_segment(F.col("url")).alias("name"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size * 43560.0e0 WHEN 1 THEN p_size * 1000.0e0 END AS sqft, 2000.0e0 + p_size*100 + 0.5 AS station, printf('%03d-%03d', CAST(p_partkey - p_partkey % 50 AS INT), CAST(p_partkey - p_partkey % 50 + 49 AS INT)) AS label,
    CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS INT) ELSE -1 END AS seg, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE -1 END AS win, CAST(10 + p_size % 10 AS INT) AS look, p_size + 3 AS n_pages FROM part""")
def labels_and_names(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    size, k = F.col("p_size").cast("string"), F.col("p_partkey")
    area = F.when(k % 3 == 0, F.concat(size, F.lit(" acres"))).when(k % 3 == 1, F.concat(size, F.lit(",000 sq. ft."))).otherwise("none")
    chain = F.concat((20 + F.col("p_size")).cast("string"), F.lit("+00.5"))
    crop = F.when(k % 2 == 0, F.concat(F.lit("seg_"), F.lpad(size, 4, "0"), F.lit("_w1"))).otherwise(F.lit("seg_x_1"))
    seg, win = text.crop_of(crop)
    look = F.concat(F.lit("I"), F.translate((F.col("p_size") % 10).cast("string"), "08", "OS"))
    pages = F.concat(F.lit("1-"), size, F.lit(", 90,92-93"))
    return p.select("p_partkey", text.square_feet(area).alias("sqft"), text.station(chain).alias("station"), text.range_label(k).alias("label"), F.coalesce(seg, F.lit(-1)).alias("seg"), F.coalesce(F.when(seg.isNotNull(), win), F.lit(-1)).alias("win"), text.lookalike_number(look).alias("look"), F.size(text.page_list(pages)).alias("n_pages"))


@query("""SELECT conv_id, turn, role AS raw, CASE WHEN turn % 2 = 0 THEN '' ELSE 'bearing' END AS kind, turn % 3 = 0 AS rotated FROM conversations""")
def model_replies(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    item = F.concat(F.lit('{"raw":"'), "role", F.lit('"'), F.when(F.col("turn") % 2 == 0, F.lit("")).otherwise(',"kind":"bearing"'), F.when(F.col("turn") % 3 == 0, F.lit(',"rotated":true')).otherwise(""), F.lit("}"))
    reply = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("```json\n["), item, F.lit(',{"kind":"x"}]\n```'))).otherwise(F.concat(F.lit("Here it is: ["), item, F.lit("] done")))
    return c.select("conv_id", "turn", F.inline(text.json_items(reply)))


@query("""SELECT doc_id, len(list_filter(list_transform(string_split(text, chr(10)), x -> trim(x)), x -> x <> '')) AS n_lines FROM documents""")
def page_lines(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.size(text.lines_in(F.col("text"))).cast("bigint").alias("n_lines"))


@query("""SELECT page, concat('A', CAST(page AS VARCHAR)) AS section FROM v_pages""")
def text_between_headings(spark, sf_dir):
    v = view(spark, sf_dir, "v_pages")
    body = F.concat(F.lit("x LEGAL:A"), F.col("page").cast("string"), F.lit("NOTES: y"))
    return v.select("page", text.between_headings(body, "LEGAL:", "NOTES:").alias("section"))
