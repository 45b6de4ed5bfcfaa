"""The pipeline by a plain loop over stages, and every registered query over its whole table."""

import math
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from cadastra.llm import decontam, queries
from cadastra.llm.langid import identify

from test_text_operators import plain_dedup

SF = "/root/testdata/sf0.001"


def plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    want = c.sql(queries.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    order = [want.columns.index(x) for x in columns]
    assert sorted(tuple(map(plain, r)) for r in df.select(*columns).collect()) == sorted(tuple(plain(r[i]) for i in order) for r in want.fetchall())


@pytest.mark.parametrize("name", ["op1_tokens", "op2_toxicity", "op4_pii", "op6_repair", "op7_packing", "op8_langid", "op9_simhash"])
def test_queries_cover_every_document(spark, name):
    got = {r.doc_id for r in queries.QUERIES[name](spark, SF).select("doc_id").collect()}
    assert got == {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}


def shingle_set(t):
    w = re.findall(r"[^\x09-\x0d\x20]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_pipeline(spark):
    """Each stage by the plain rule of its operator, on what the stage before kept."""
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    known = {r.doc_id for r in identify(documents).collect() if r.lang_pred != "und" and r.confidence >= corpus_pipeline.LEAST_CONFIDENCE}
    docs = {r.doc_id: r.text for r in documents.collect() if r.doc_id in known}
    cleaned = {i: t for i, t in plain_dedup(list(docs.items())).items() if t == docs[i] or t.strip()}
    kept, sets = {}, {}
    for i in sorted(cleaned):
        own = shingle_set(cleaned[i])
        if not any(own == s or len(own & s) >= 0.8 * len(own | s) for s in sets.values()):
            kept[i], sets[i] = cleaned[i], own
    windows = decontam.WindowSet([(str(r.item_id), r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    import pyarrow as pa

    want = {}
    for i, t in kept.items():
        number, spans, _ = windows.scan(pa.array([t]))
        s = decontam.merged(spans[0])
        hit = sum(s[1::2]) - sum(s[::2])
        if not hit or hit < 0.5 * number[0]:
            want[i] = decontam.drop_spans(t, s)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(want) and len(want) < len(docs)
    for i, t in want.items():
        x = np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(x[at : at + r.length].tobytes())
            at += r.length
        assert at == len(x)


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("source", "component_id")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
    assert all(stage(spark, docs.limit(0), SF).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_stages_with_odd_rows(spark):
    """Null ids and texts, empty and very long texts, repeated rows, columns with the operators' own names."""
    long = " ".join(f"the word number w{i} of it" for i in range(9000))
    rows = [(1, None, "en"), (1, None, "en"), (None, "the word of the day is good here", "en"), (2, "", None), (3, long, "en"), (3, long, "en"), (4, "12 ½", None)]
    rows += [(10 + i, f"the day of the house number x{i} was a good one for them all", "en" if i % 2 else None) for i in range(20)]
    names = ["n_lines", "n_dropped", "__own0", "__hash", "_key", "s", "confidence", "start"]
    docs = spark.createDataFrame([(*r, *range(8)) for r in rows], "doc_id bigint, text string, lang string, " + ", ".join(f"{c} int" for c in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got and all([r[c] for c in names] == list(range(8)) for r in got), name
        ids = [r.doc_id for r in got]
        assert ids.count(3) == (1 if name == "near_dedup" else 2), name
        assert all(r.text == long for r in got if r.doc_id == 3), name
        assert (1 in ids) == (name != "language_id") and (4 in ids) == (name != "language_id"), name
    assert {r.doc_id for r in corpus_pipeline.packing(spark, docs, SF).collect()} == {r[0] for r in rows}
