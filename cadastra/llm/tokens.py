"""Token counts by rank-synchronous merging (operator 1)."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from cadastra.llm.common import batches, bound_batches, narrow, texts
from cadastra.llm.wordbpe import word_counter


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of docs(doc_id, text).

    Narrow: no shuffle, one pass. Null and empty texts have 0 bytes and 0 tokens; repeated rows give
    repeated results; an empty table gives an empty one; extra columns are ignored; null ids stay null.
    Texts of any length are counted whole. Memos of chunks and pre-tokens are bounded in each worker.
    tokenizer: path of a lower-casing word-level BPE file on every machine.
    """
    bound_batches(docs.sparkSession)

    def run(it):
        counter = word_counter(tokenizer)
        for b in batches(it):
            text = b.column(1)
            n = counter.count(texts(text))
            size = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return narrow(docs, {"doc_id": "bigint", "text": "string"}).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
