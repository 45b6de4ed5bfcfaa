"""Sequence packing by lexical retrieval (operator 7)."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from cadastra.llm.bytebpe import byte_encoder
from cadastra.llm.common import batches, bound_batches, narrow, texts

WINDOW = 2048
#: A shard, which has an index of its own, is closed at so many documents or ids.
SHARD_DOCS, SHARD_IDS = 4096, 1 << 21
#: BM25's constants; neighbours of one retrieval.
K1, B, NEIGHBOURS = 1.2, 0.75, 16
#: Terms of so many of a shard's documents (a share, and a number) have their impacts as a full row, whose sum is quicker than a list's.
DENSE, DENSE_LEAST = 0.06, 16
#: Sequence numbers: partition, then shard, then sequence.
PART_BITS, SHARD_BITS = 40, 20


class Bm25:
    """An inverted index of a shard's documents; terms are token ids."""

    def __init__(self, docs: list[np.ndarray], vocabulary: int):
        n = len(docs)
        size = np.fromiter(map(len, docs), np.int64, n)
        self.n = n
        counts = [np.unique(d, return_counts=True) for d in docs]
        term = np.concatenate([t for t, _ in counts]).astype(np.int64) if n else np.zeros(0, np.int64)
        tf = np.concatenate([c for _, c in counts]).astype(np.float32) if n else np.zeros(0, np.float32)
        of = np.repeat(np.arange(n), [len(t) for t, _ in counts])
        df = np.bincount(term, minlength=vocabulary)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5)).astype(np.float32)
        norm = (K1 * (1 - B + B * size / max(size.mean(), 1)))[of].astype(np.float32) if n else tf
        weight = idf[term] * tf * (K1 + 1) / (tf + norm)
        self.own = np.concatenate([[0], np.cumsum([len(t) for t, _ in counts])]).astype(np.int64)
        self.term, self.weight = term, weight
        order = np.argsort(term, kind="stable")
        self.doc, self.impact = of[order].astype(np.int32), weight[order]
        self.start = np.concatenate([[0], np.cumsum(df)]).astype(np.int64)
        often = np.flatnonzero(df > max(DENSE * n, DENSE_LEAST))
        self.row = np.full(vocabulary, -1, np.int32)
        self.row[often] = np.arange(len(often))
        self.full = np.zeros((len(often), n), np.float32)
        for i, t in enumerate(often):
            at = slice(self.start[t], self.start[t + 1])
            self.full[i, self.doc[at]] = self.impact[at]

    def neighbours(self, doc: int, used: np.ndarray) -> list[int]:
        """Unused documents by the score of all terms of the document, best first; ties by place."""
        terms = self.term[self.own[doc] : self.own[doc + 1]]
        row = self.row[terms]
        score = self.full[row[row >= 0]].sum(axis=0).astype(np.float64)
        if len(rare := terms[row < 0]):
            lo, size = self.start[rare], self.start[rare + 1] - self.start[rare]
            at = np.arange(size.sum()) + np.repeat(lo - np.cumsum(size) + size, size)
            score += np.bincount(self.doc[at], self.impact[at], self.n)
        score[used] = 0
        found = np.flatnonzero(score)
        if len(found) > NEIGHBOURS:
            found = found[np.argpartition(-score[found], NEIGHBOURS)[:NEIGHBOURS]]
        return found[np.argsort(-score[found], kind="stable")].tolist()


def plan(docs: list[np.ndarray], vocabulary: int, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one shard.

    A seed opens a window; unused neighbours of the seed follow, best first, and the one that crosses the window's
    end is cut there and seeds the next window. Without a neighbour left, the next unused document goes on. What
    remains at the end is dealt to sequences of powers of two, which need no padding.
    """
    index = Bm25(docs, vocabulary)
    used = np.zeros(len(docs), bool)
    pieces, room, sequence, queue, following = [], window, 0, [], 0
    seed = None
    while True:
        while queue and used[queue[0]]:
            queue.pop(0)
        if not queue and seed is not None and room < window:
            queue = index.neighbours(seed, used)
        if queue:
            doc = queue.pop(0)
        else:
            while following < len(docs) and used[following]:
                following += 1
            if following == len(docs):
                break
            doc = seed = following
        if room == window:
            seed, queue = doc, []
        used[doc] = True
        start, left = 0, len(docs[doc])
        while left:
            n = min(left, room)
            pieces.append((doc, start, n, sequence, window - room))
            start, left, room = start + n, left - n, room - n
            if not room:
                sequence, room, seed, queue = sequence + 1, window, doc, []
    last = [p for p in pieces if p[3] == sequence]
    if (fill := sum(p[2] for p in last)) & (fill - 1):
        pieces = [p for p in pieces if p[3] != sequence]
        size = [1 << b for b in range(fill.bit_length() - 1, -1, -1) if fill >> b & 1]
        at = 0
        for doc, start, n, _, _ in last:
            while n:
                m = min(n, size[0] - at)
                pieces.append((doc, start, m, sequence, at))
                start, n, at = start + m, n - m, at + m
                if at == size[0]:
                    size.pop(0)
                    sequence, at = sequence + 1, 0
    return pieces


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 1) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all rows of docs(doc_id, text).

    Narrow: each input partition is cut into shards of bounded size in the order of its rows, and a shard is packed
    with an index of its own, so no shuffle is needed and a lost task is simply repeated. Null and empty texts have
    the end id alone; repeated rows are documents of their own; an empty table gives an empty one; extra columns are
    ignored. A document longer than a shard makes the shard longer. Sequences have window ids, except that a shard's
    last ones have powers of two: no padding at all.
    """
    bound_batches(docs.sparkSession)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(it):
        encoder = byte_encoder(tokenizer)
        vocabulary = max(encoder.size, end_id + 1)
        end = np.array([end_id], encoder.dtype)
        first, shard = TaskContext.get().partitionId() << PART_BITS, 0

        def close(ids, parts):
            docs = parts
            pieces = np.array(plan(docs, vocabulary, window), np.int64).reshape(-1, 5)
            crc, held, wide = [], None, b""
            for doc, start, n, _, _ in pieces.tolist():
                if doc != held:
                    held, wide = doc, memoryview(docs[doc].astype("<u4").tobytes())
                crc.append(zlib.crc32(wide[4 * start : 4 * (start + n)]))
            size = np.fromiter(map(len, docs), np.int64, len(docs))
            doc, start, n, sequence, offset = pieces.T
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()).take(pa.array(doc)), pa.array(start), pa.array(n), pa.array(crc, pa.int64()), pa.array(size[doc]), pa.array(first + (shard << SHARD_BITS) + sequence), pa.array(offset)], names)

        ids, parts, size = [], [], 0
        for b in batches(it):
            for name, p in zip(b.column(0).to_pylist(), encoder.encode(texts(b.column(1)))):
                ids.append(name)
                parts.append(np.append(p, end))
                size += len(p) + 1
                if size >= SHARD_IDS or len(ids) >= SHARD_DOCS:
                    yield close(ids, parts)
                    ids, parts, size, shard = [], [], 0, shard + 1
        if ids:
            yield close(ids, parts)

    return narrow(docs, {"doc_id": "bigint", "text": "string"}).mapInArrow(run, ", ".join(f"{c} bigint" for c in names))
