"""Benchmark decontamination by a broadcast hash set of word n-grams (operator 3)."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.llm.common import batches, bound_batches, free_names, narrow, shared_table, utf8_buffers

SIZE = 10
#: Windows of so many bytes of test items (or of one longer item) are held at once; more items take more passes.
PART_BYTES = 4 << 20
PRIME = np.uint64(0x9E3779B97F4A7C15 | 1)
STEP = np.uint64(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts that lie end to end: (lower-cased bytes, starts, ends, hashes, number in each text)."""
    low = _LOWER[data]
    inside = np.zeros(len(low) + 1, bool)
    inside[:-1] = _WORD[low]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    begins[cuts] = inside[cuts]  # a word ends where its text ends
    starts = np.flatnonzero(begins)
    stops = np.zeros(len(low) + 1, bool)
    stops[1:] = inside[:-1] & (~inside[1:] | begins[1:])
    ends = np.flatnonzero(stops)
    if not len(starts):
        return low, starts, ends, np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    size = ends - starts
    # A word's hash: its bytes as digits, so that equal words agree wherever they stand.
    total = np.zeros(len(starts), np.uint64)
    for k in range(int(min(size.max(), 24))):
        on = size > k if k else slice(None)
        total[on] = (total[on] + low[starts[on] + k] + np.uint64(1)) * PRIME
    for i in np.flatnonzero(size > 24):
        total[i] ^= np.frombuffer(hashlib.blake2b(low[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), np.uint64)[0]
    total ^= total >> np.uint64(29)
    total *= STEP
    total ^= total >> np.uint64(32)
    number = np.diff(np.searchsorted(starts, offsets))
    return low, starts, ends, total, number


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of size words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += hashes[k : k + n]
        out *= PRIME
    return out ^ (out >> np.uint64(31))


class WindowSet:
    """Windows of test items: hashes for the search, words for the proof."""

    def __init__(self, items: list[tuple[str, bytes]], size: int = SIZE):
        """items: (id, text). A window is size words; a shorter item with words is one window."""
        self.ids = [k for k, _ in items]
        found: dict[int, dict[bytes, set[int]]] = {}
        for at, (_, text) in enumerate(items):
            low, starts, ends, _, _ = words(np.frombuffer(text, np.uint8), np.array([0, len(text)], np.int64))
            own = [low[a:b].tobytes() for a, b in zip(starts, ends)]
            n = min(size, len(own))
            for i in range(len(own) - n + 1 if n else 0):
                found.setdefault(n, {}).setdefault(b" ".join(own[i : i + n]), set()).add(at)
        self.tables = {}
        for n, windows in found.items():
            keys = list(windows)
            flat = np.frombuffer(b"".join(keys), np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int64)
            hashes = words(flat, offsets)[3].reshape(-1, n)
            value = np.zeros(len(keys), np.uint64)
            for k in range(n):
                value += hashes[:, k]
                value *= PRIME
            value ^= value >> np.uint64(31)
            order = np.argsort(value, kind="stable")
            small = np.zeros(1 << 20, bool)
            small[value >> np.uint64(44)] = True
            self.tables[n] = value[order], [keys[i] for i in order], [tuple(sorted(windows[keys[i]])) for i in order], small

    def scan(self, column: pa.Array) -> tuple[np.ndarray, list[list[int]], list[set[int]]]:
        """For each text: its number of words, the hit word spans as flat [from, to, ...], the items found."""
        data, offsets = utf8_buffers(column)
        low, starts, ends, hashes, number = words(data, offsets)
        first = np.cumsum(number) - number
        spans: list[list[int]] = [[] for _ in number]
        items: list[set[int]] = [set() for _ in number]
        for n, (values, keys, owners, small) in self.tables.items():
            value = grams(hashes, n)
            maybe = np.flatnonzero(small[value >> np.uint64(44)])
            lo = np.searchsorted(values, value[maybe])
            ok = lo < len(values)
            maybe, lo = maybe[ok], lo[ok]
            ok = values[lo] == value[maybe]
            maybe, lo = maybe[ok], lo[ok]
            doc = np.searchsorted(first, maybe, side="right") - 1
            ok = maybe + n <= first[doc] + number[doc]
            for i, at, d in zip(maybe[ok].tolist(), lo[ok].tolist(), doc[ok].tolist()):
                own = b" ".join(low[a:b].tobytes() for a, b in zip(starts[i : i + n], ends[i : i + n]))
                while at < len(keys) and values[at] == value[i]:  # verified word by word
                    if keys[at] == own:
                        spans[d] += (i - int(first[d]), i - int(first[d]) + n)
                        items[d].update(owners[at])
                        break
                    at += 1
        return number, spans, items


def merged(spans: list[int]) -> list[int]:
    """Spans [from, to, ...] without overlaps, in order."""
    out: list[int] = []
    for a, b in sorted(zip(spans[::2], spans[1::2])):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _tests(benchmark: DataFrame) -> DataFrame:
    return narrow(benchmark, {"item_id": "string", "text": "string"}).where("item_id is not null and text is not null")


def _parts(benchmark: DataFrame) -> int:
    """Passes that a benchmark takes, by its bytes, which are summed before anything is gathered."""
    total = _tests(benchmark).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-int(total) // PART_BYTES))


def _windows(benchmark: DataFrame, size: int, part: int = 0, parts: int = 1) -> WindowSet:
    """The windows of one part of the items, by hash of id and text, so that no id makes a part large."""
    tests = _tests(benchmark)
    mine = tests if parts == 1 else tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
    return WindowSet([(r[0], r[1].encode()) for r in mine.toLocalIterator()], size)


def _pass(docs: DataFrame, windows: WindowSet) -> DataFrame:
    """(doc_id, text, n_words, spans, items) of docs(doc_id, text) against a set of windows, which is sent once."""
    held = docs.sparkSession.sparkContext.broadcast(windows)
    names = ["doc_id", "text", "n_words", "spans", "items"]

    def run(it):
        windows = held.value
        for b in batches(it):
            number, spans, found = windows.scan(b.column(1))
            merged_spans = pa.array([merged(s) for s in spans], pa.list_(pa.int64()))
            items = pa.array([sorted({windows.ids[i] for i in f}) for f in found], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(number), merged_spans, items], names)

    return docs.mapInArrow(run, "doc_id bigint, text string, n_words bigint, spans array<bigint>, items array<string>")


def _in_parts(numbered: DataFrame, benchmark: DataFrame, size: int, parts: int) -> DataFrame:
    """(row, n_words, spans, items) of written rows numbered(doc_id, text), doc_id being the row's number: one pass for
    each part of the benchmark, then each row's results together."""
    held = [_pass(numbered, _windows(benchmark, size, p, parts)).drop("text") for p in range(parts)]
    every = functools.reduce(DataFrame.unionByName, held)
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items"))))
    both = every.groupBy(F.col("doc_id").alias("row")).agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), items.alias("items"))

    def run(it):
        for b in batches(it):
            yield b.set_column(2, "spans", pa.array([merged(s) for s in b.column(2).to_pylist()], pa.list_(pa.int64())))

    return both.mapInArrow(run, "row bigint, n_words bigint, spans array<bigint>, items array<string>")


def find_leaks(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, spans) of each row of docs(doc_id, text) against benchmark(item_id, text).

    spans: hit word positions as flat [from, to, ...]. One narrow pass over docs when the test items fit in one part
    (checked by their bytes before anything is gathered). A larger benchmark goes in parts, one pass each; the rows
    are then written once with their numbers, by which each row's results meet.
    Null texts have no words, in docs and benchmark; an item without words has no window; items without an id are
    left out; repeated items count by id, and an item that occurs several times once; repeated rows of docs give
    repeated results; texts of any length are scanned whole; empty tables give empty results or no hits; extra
    columns are ignored.
    """
    bound_batches(docs.sparkSession)
    docs, parts = narrow(docs, {"doc_id": "bigint", "text": "string"}), _parts(benchmark)
    if parts == 1:
        out = _pass(docs, _windows(benchmark, size))
    else:
        numbered = shared_table(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
        found = _in_parts(numbered.select(F.col("_row").alias("doc_id"), "text"), benchmark, size, parts)
        out = numbered.drop("text").join(found, F.col("_row") == F.col("row"))
    hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), "items", "spans")


def drop_spans(text: str, spans: list[int]) -> str:
    """The text without the given word spans; what stands between words outside a span stays."""
    if not spans:
        return text
    raw = text.encode()
    _, starts, ends, _, _ = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)], np.int64))
    out, at = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        out.append(raw[at : starts[a]])
        at = int(ends[b - 1])
    return b"".join([*out, raw[at:]]).decode()


def _cut(b: pa.RecordBatch, at: int, number: np.ndarray, spans: list[list[int]], drop_share: float) -> pa.RecordBatch:
    """The rows of a batch that stay, their text (column at) without the hit spans."""
    hit = np.array([sum(s[1::2]) - sum(s[::2]) for s in spans], np.int64)
    stay = np.flatnonzero((hit == 0) | (hit < drop_share * number))
    old = b.column(at).to_pylist()
    new = pa.array([old[i] if old[i] is None else drop_spans(old[i], spans[i]) for i in stay], b.schema.field(at).type)
    b = b.take(pa.array(stay))
    return pa.RecordBatch.from_arrays([new if i == at else b.column(i) for i in range(b.num_columns)], schema=b.schema)


def remove_leaks(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, drop_share: float = 0.5) -> DataFrame:
    """docs(doc_id, text, ...) without leaked passages.

    A document is dropped when at least drop_share of its words are hit; otherwise the hit spans are cut out of its
    text. Documents without a hit stay as they are, null and empty ones too; repeated rows get the same decision; texts
    of any length are scanned whole; an empty table gives an empty one. Other columns stay, whatever their names;
    n_chars, if present, follows the new text.
    """
    spark, at, parts = docs.sparkSession, docs.columns.index("text"), _parts(benchmark)
    bound_batches(spark)
    if parts == 1:
        held = spark.sparkContext.broadcast(_windows(benchmark, size))

        def run(it):
            for b in batches(it):
                number, spans, _ = held.value.scan(b.column(at).cast(pa.string()))
                yield _cut(b, at, number, [merged(s) for s in spans], drop_share)

        out = docs.mapInArrow(run, docs.schema)
    else:
        row, same, words_, spans_ = free_names(docs, 4)
        numbered = shared_table(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
        found = _in_parts(numbered.select(F.col(row).alias("doc_id"), F.col("text").cast("string").alias("text")), benchmark, size, parts)
        found = found.select(F.col("row").alias(same), F.col("n_words").alias(words_), F.col("spans").alias(spans_))
        joined = numbered.join(found, F.col(row) == F.col(same)).select(*docs.columns, words_, spans_)
        width = len(docs.columns)

        def run(it):
            for b in batches(it):
                number, spans = b.column(width).to_numpy(zero_copy_only=False), b.column(width + 1).to_pylist()
                yield _cut(b.select(list(range(width))), at, number, spans, drop_share)

        out = joined.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("bigint")) if "n_chars" in docs.columns else out
