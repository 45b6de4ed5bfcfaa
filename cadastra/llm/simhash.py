"""SimHash near-duplicates linked by covering locality-sensitive hashing (operator 9)."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from cadastra.llm.common import batches, bound_batches, cut, free_names

BITS, RADIUS = 64, 3
#: A bucket of more distinct fingerprints is split again by masks on the bits that its own mask left open.
BUCKET = 8192
SHINGLES = 1 << 16


def fingerprint(text: bytes, size: int = 3) -> int:
    """64-bit majority of the XXH64 (seed 42) of all word shingles, repeats included."""
    w = text.lower().split()
    if not w:
        return 0
    if len(w) < size:
        return xxh64_intdigest(b" ".join(w), 42)
    joined = b" ".join(w)
    ends = list(accumulate(len(x) + 1 for x in w))
    n = len(w) - size + 1
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, n, SHINGLES):
        hi = min(n, lo + SHINGLES)
        starts = [0, *ends[: hi - 1]][lo:hi] if lo == 0 else ends[lo - 1 : hi - 1]
        h = np.array([xxh64_intdigest(joined[a : b - 1], 42) for a, b in zip(starts, ends[lo + size - 1 : hi + size - 1])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def covering_masks(bits: list[int], radius: int = RADIUS) -> list[int]:
    """2^(radius+1) - 1 masks over the given bits. Bit number i gets a non-zero vector of radius + 1 bits; mask v
    holds the bits whose vector has odd overlap with v. Any radius bits leave some v orthogonal to all of their
    vectors, so every pair that differs in at most radius of these bits agrees under that mask."""
    count = (1 << (radius + 1)) - 1
    return [sum(1 << b for i, b in enumerate(bits) if ((1 + i % count) & v).bit_count() % 2) for v in range(1, count + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


MASKS = covering_masks(list(range(BITS)))
INNER = [[m | inner for inner in covering_masks([b for b in range(BITS) if not m >> b & 1])] for m in MASKS]


def stars(members: np.ndarray) -> list[tuple[int, int]]:
    """Links (leader, member) that span the components of one bucket's distinct fingerprints at the radius.

    Breadth first over those not yet reached, so a dense bucket shrinks with each step."""
    left, out = members, []
    while len(left):
        leader, left = left[0], left[1:]
        queue = [leader]
        while queue and len(left):
            near = np.bitwise_count(left ^ queue.pop()) <= RADIUS
            if near.any():
                new = left[near]
                left = left[~near]
                queue.extend(new)
                out += [(leader, x) for x in new]
    return out


def _linked(buckets: DataFrame, split: bool) -> DataFrame:
    """Streams rows (table, key, fp), sorted by bucket: links of small buckets, and the rows of oversized ones for the next masks."""

    def rows(again, a, b):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), again)), pa.array(np.asarray(a, np.uint64).view(np.int64)), pa.array(np.asarray(b, np.uint64).view(np.int64))], ["again", "a", "b"])

    def run(it):
        empty = np.zeros(0, np.uint64)
        at, held, over, found, again = None, empty, False, [], []

        def add(own):
            """Rows of the bucket that is open; it may go on in the next batch."""
            nonlocal held, over
            held = np.concatenate([held, own]) if len(held) else own
            over = over or split and len(held) > BUCKET
            if over:
                again.append((at[0], held))
                held = empty

        def close():
            nonlocal held, over
            if len(held) > 1:
                found.extend(stars(held))
            held, over = empty, False

        def out():
            if found:
                a, b = np.array(found, np.uint64).T
                yield rows(False, a, b)
            for table, fps in again:
                yield rows(True, np.full(len(fps), table), fps)
            found.clear()
            again.clear()

        for batch in batches(it):
            t, k, f = (batch.column(i).to_numpy() for i in range(3))
            f = f.view(np.uint64)
            edge = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
            starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(t)]])
            for i in sorted({0, len(starts) - 1, *np.flatnonzero(ends - starts > 1).tolist()}):
                key = int(t[starts[i]]), int(k[starts[i]])
                if key != at:
                    close()
                    at = key
                add(f[starts[i] : ends[i]])
            yield from out()
        close()
        yield from out()

    return buckets.mapInArrow(run, "again boolean, a bigint, b bigint")


def links(fps: DataFrame, partitions: int | None = None) -> DataFrame:
    """Links (a, b) among the distinct values of fps(fp) that span every component at the radius; none is lost."""
    count = partitions or int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tables = F.explode(F.array(*(F.struct(F.lit(v).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("k")) for v, m in enumerate(MASKS))))
    keyed = fps.select("fp", tables.alias("x")).select(F.col("x.t").alias("t"), F.col("x.k").alias("k"), "fp")
    level = cut(_linked(keyed.repartition(count, "t", "k").sortWithinPartitions("t", "k"), split=True))
    again = level.where("again").select(F.col("a").alias("t"), F.col("b").alias("fp"))
    inner = F.lit(None)
    for v, masks in enumerate(INNER):
        each = F.array(*(F.struct(F.lit(v * len(masks) + j).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("k")) for j, m in enumerate(masks)))
        inner = F.when(F.col("t") == v, each).otherwise(inner)
    deeper = again.select("fp", F.explode(inner).alias("x")).select(F.col("x.t").alias("t"), F.col("x.k").alias("k"), "fp")
    second = _linked(deeper.repartition(count, "t", "k").sortWithinPartitions("t", "k"), split=False)
    return level.where("not again").select("a", "b").union(second.where("not again").select("a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, by alternating large-star and small-star steps."""
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.select(F.col("u").alias("c"), "m"), F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = cut(small)
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == seen:
            break
        seen = now
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


def _components(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, doc, fp), doc being the text's hash, and for each distinct fp (_fp) the first document of its component."""
    bound_batches(docs.sparkSession)

    def run(it):
        for b in batches(it):
            raw = b.column(2).cast(pa.binary()).to_pylist()
            fp = np.array([fingerprint(x, size) if x else 0 for x in raw], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["doc_id", "doc", "fp"])

    keyed = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), F.xxhash64(docs["text"]).alias("doc"), docs["text"].cast("string").alias("text"))
    rows = cut(keyed.mapInArrow(run, "doc_id bigint, doc bigint, fp bigint"))
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("doc").alias("d"))
    distinct = cut(rows.groupBy("fp").agg(F.min(order).alias("least")))
    roots = components(links(distinct.select("fp")))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    of = named.groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("first"))
    return rows, named.join(of, F.col("root") == F.col("_root")).select(F.col("fp").alias("_fp"), "first")


def near_duplicates(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of docs(doc_id, text).

    Fingerprints link at RADIUS or fewer differing bits; component_id is the smallest doc_id of all rows reachable
    over links. Null, empty and white-space texts have fingerprint zero, which links like any other. Repeated rows
    stay and share a component. Rows without a doc_id link as others do but give no component its name (a component
    of such rows only has a null one). An empty table gives an empty one; extra columns are ignored.
    Copies meet in a map-side aggregation, so only distinct fingerprints (8 bytes each) enter the tables. A bucket
    holds at most BUCKET of them in memory; a larger one is split by a second covering whose buckets leave about
    16 bits open, which bounds them whatever the input.
    """
    rows, component = _components(docs, size)
    return rows.join(component, F.col("fp") == F.col("_fp")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.i").alias("component_id"))


def first_of_each(docs: DataFrame, size: int = 3) -> DataFrame:
    """One document of each component of docs(doc_id, text, ...), that of the smallest doc_id (then text hash; nulls
    last), with all its columns; of rows with equal doc_id and text one stays."""
    _, component = _components(docs, size)
    return only_rows(docs, component.select(F.col("first.i").alias("i"), F.col("first.d").alias("d")).distinct())


def only_rows(docs: DataFrame, stay: DataFrame) -> DataFrame:
    """Rows of docs named by stay(i, d), doc_id and text hash, with all their columns; of equal ones that of the
    smallest hash over all columns stays (maps, which have none, aside)."""
    hash_, own, place, i, d, turn = free_names(docs, 6)
    plain = [docs[f.name] for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    keyed = docs.withColumns({hash_: F.xxhash64(docs["text"]), own: docs["doc_id"].cast("bigint"), turn: F.xxhash64(*plain)})
    stay = stay.select(stay["i"].alias(i), stay["d"].alias(d))
    kept = keyed.join(stay, F.col(own).eqNullSafe(F.col(i)) & (F.col(hash_) == F.col(d)), "left_semi")
    one = Window.partitionBy(own, hash_).orderBy(turn)
    return kept.withColumn(place, F.row_number().over(one)).where(F.col(place) == 1).select(*docs.columns)
