"""A training corpus from raw documents: language ID, line dedup, near-dedup, decontamination, packing."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.llm.common import free_names, release, shared_dir, table
from cadastra.llm.decontam import remove_leaks
from cadastra.llm.langid import keep_known
from cadastra.llm.linededup import drop_recurring_lines
from cadastra.llm.nearcopies import first_of_near_copies
from cadastra.llm.packing import pack

#: Mean posterior that a text's words must give their own best language; a word with letters that no labelled text has
#: counts as 0. Of the texts of the sf0.1 table, mixed ones included, none is under 0.63 and 99.5 % are above 0.97.
LEAST_CONFIDENCE = 0.6
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in languages that can be learned here, code-switched ones included; a null lang is filled in. Texts
    without a letter (null and empty ones too) go, and those whose words belong to none of the languages."""
    return keep_known(docs, LEAST_CONFIDENCE)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that recur across documents, but for the first place; documents that keep no text go.
    Null and empty texts stay. Columns stay as they are, whatever their names; n_chars follows the text."""
    counts = ("n_lines", "n_recurring", "n_dropped")
    held = free_names(docs, len(counts))
    clash = {c: h for c, h in zip(counts, held) if c in docs.columns}
    out = drop_recurring_lines(docs.withColumnsRenamed(clash)).where((F.col("n_dropped") == 0) | F.col("text").rlike(r"\S"))
    return out.drop(*counts).withColumnsRenamed({h: c for c, h in clash.items()}).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without near copies of earlier ones: five-word shingles, Jaccard similarity of 0.8 or more. Null and
    empty texts count as copies of each other; of rows with equal doc_id and text one stays."""
    return first_of_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; those that mostly consist of them go. Null and empty texts stay."""
    return remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens; null and empty texts have their end id alone."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet in the shared folder and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        out.write.parquet(path)
        release(spark)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
