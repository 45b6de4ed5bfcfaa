"""One query for each operator, over its whole table, with the columns that its users compare."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.llm.common import table


def op1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadastra.llm.tokens import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadastra.llm.toxicity import grade_toxicity

    return grade_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadastra.llm.decontam import find_leaks

    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", F.array_sort("items")), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadastra.llm.pii import find_personal_data

    found = find_personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", F.array_max(F.transform("found", lambda s: s["score"])).alias("top_score"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadastra.llm.linededup import drop_recurring_lines

    return drop_recurring_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_recurring", "n_dropped", "text")


def op6_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadastra.llm.repair import token_ids

    return token_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadastra.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadastra.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadastra.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadastra.llm.hnsw import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_tokens, op2_toxicity, op3_decontamination, op4_pii, op5_line_dedup, op6_repair, op7_packing, op8_langid, op9_simhash, op10_hnsw, pipeline)}

_LOW = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOW + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
LEAKS_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {_WORDS.format(text="text")} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i+n-1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w)-n+2)) AS i FROM b)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, greatest(1, len(w)-n+2))) AS i FROM d, (SELECT DISTINCT n FROM bw))),
h AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
p AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i+n)) AS place FROM h) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
"""
_SOLID = r"[\x{0E00}-\x{0FFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"
_OPEN = "path || chr(0) || '{v}' || chr(0) || array_to_string(r[1 : len(r)*{v}//5], ' ') || chr(0) || array_to_string(r[len(r)*({v}+2)//5+1 : len(r)], ' ')"
_VARIED = "".join(
    f" UNION ALL SELECT doc_id, text, i, 'V' || {_OPEN.format(v=v)} FROM f WHERE n >= 6 AND len(r)*{v}//5 < len(r)*({v}+2)//5" for v in range(4)
)
LINES_SQL = rf"""
WITH s AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text <> ''),
l AS (SELECT doc_id, text, i, ls[i+1] AS line FROM (SELECT *, unnest(range(0, len(ls))) AS i FROM s)),
t AS (SELECT *, list_filter(string_split_regex(regexp_replace(line, '({_SOLID})', ' \1 ', 'g'), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS tok FROM l),
m AS (SELECT *, len(tok) AS n, array_to_string(tok, ' ') AS own,
    list_transform(tok, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS mt FROM t WHERE len(tok) > 0),
q AS (SELECT *, CAST(n AS VARCHAR) || ' ' || array_to_string(mt[1:2], ' ') AS path, mt[3:] AS r FROM m),
f AS (SELECT *, lag(own) OVER w AS before, lead(own) OVER w AS after FROM q WINDOW w AS (PARTITION BY doc_id, text ORDER BY i)),
k AS (SELECT doc_id, text, i, 'L' || path || chr(0) || array_to_string(r, ' ') AS key FROM f WHERE n >= 3{_VARIED}
    UNION ALL SELECT doc_id, text, i, '0' || before || chr(0) || own FROM f WHERE n < 3 AND before IS NOT NULL
    UNION ALL SELECT doc_id, text, i, '1' || own || chr(0) || after FROM f WHERE n < 3 AND after IS NOT NULL),
c AS (SELECT key, min(doc_id) AS first FROM k GROUP BY key HAVING count(DISTINCT doc_id) > 1),
g AS (SELECT doc_id, text, i, max(doc_id <> first) AS later FROM k JOIN c USING (key) GROUP BY doc_id, text, i),
h AS (SELECT doc_id, count(*) AS n_recurring, count(*) FILTER (later) AS n_dropped FROM g GROUP BY doc_id),
o AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS kept
    FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.i = l.i WHERE g.later IS NULL OR NOT g.later GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines,
    coalesce(h.n_recurring, 0) AS n_recurring, coalesce(h.n_dropped, 0) AS n_dropped,
    CASE WHEN coalesce(h.n_dropped, 0) > 0 THEN coalesce(o.kept, '') ELSE d.text END AS text
FROM documents d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN o ON o.doc_id = d.doc_id
"""
#: SQL of the queries that it can express. Tokenizers, XXH64, fitted models and a graph's own choice of neighbours it can't.
ORACLE_SQL: dict[str, str] = {"op3_decontamination": LEAKS_SQL, "op5_line_dedup": LINES_SQL}
