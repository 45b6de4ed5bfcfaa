"""Near copies by Jaccard similarity of word shingles, found by SimHash and covering LSH (the pipeline's near-dedup stage)."""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from cadastra.llm.common import batches, bound_batches, cut, release
from cadastra.llm.simhash import components, covering_masks, only_rows

SIZE, LEAST = 5, 0.8
#: A SimHash of PARTS * WIDTH bits; masks cover each part at a radius of NEAR bits. A pair that differs in less than
#: PARTS * (NEAR + 1) bits agrees under some mask (else each part had more than NEAR). At LEAST a bit differs with
#: probability acos(8/9) / pi = 0.152, and a pair agrees under none with probability 1.0e-7 (sets of 4 and 5 shingles,
#: the smallest that can be alike without being equal: 0.1875 and 1.9e-5).
PARTS, WIDTH, NEAR = 24, 13, 1
MASKS = covering_masks(list(range(WIDTH)), NEAR)
WORDS = -(-PARTS * WIDTH // 64)
#: Texts of a bucket link if they differ in at most so many bits of the first word and of the first TOLD words. A pair
#: at LEAST differs in more with probability 2e-7 and 3e-9.
FIRST, TOLD, FAR = 26, 3, 60
#: Shingles hashed at once: as many as a counter of one byte counts.
CHUNK = 255
ENTRY = np.dtype([("key", "<u4"), ("size", "<u4"), ("s", "<i8"), ("fp", "<u8", TOLD)])
#: Entries that one cell, the unit of a task's memory, holds on average; a bucket of more than DENSE links a text is
#: searched breadth first, others pair by pair, so many pairs at once.
CELL, DENSE, AT_ONCE = 500_000, 32, 1 << 18
#: The pairs of a component of up to so many texts are rows; those of larger ones meet again by their rare shingles.
CROWD = 8
#: Counters of shingles by hash, one array.
COUNTERS = 1 << 18
#: Rounds in which a crowded component's first text is compared with the others.
STARS = 2
#: Bytes of leaders' sets that are broadcast; beyond, a leader's comparisons are dealt to so many tasks.
LIGHT, SALT = 16 << 20, 8
ORDER = "struct<n:boolean,i:bigint,d:bigint>"

_R = np.random.default_rng(20)
_TIMES, _PLUS = (_R.integers(0, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(k) for k in (1, 0))
_PLACE = _R.integers(0, 1 << 63, SIZE, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the runs of SIZE words; a shorter text is one run, a text without words has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(w) - SIZE + 1)
    run = np.full(n, min(len(w), SIZE), np.uint64)
    for k in range(min(len(w), SIZE)):
        run = _mixed(run + w[k : k + n] * _PLACE[k])
    return np.unique(run)


def fingerprint(runs: np.ndarray) -> np.ndarray:
    """The SimHash of a set of shingles, WORDS numbers: each bit is that of most of the shingles' hashes. A second hash
    has a say that fades as sets grow, so that small sums, which are often in balance, tip alike in like sets; in the
    largest sets, where balance is rare, the least shingle tips it."""
    n, sums = len(runs), np.zeros(64 * WORDS, np.int64)
    for at in range(0, n, CHUNK):
        hashes = _mixed(runs[at : at + CHUNK, None] * _TIMES + _PLUS)
        own, first = _sums(hashes)
        if at == 0:
            least = first
        sums += own
    if n <= CHUNK:
        most = sums * max(n, 8) + 4 * _sums(_mixed(hashes + _PLUS))[0] > 0 if n else sums > 0
    else:
        most = np.where(sums == 0, least, sums > 0)
    return np.packbits(most).view(np.uint64)


def _sums(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each bit how often more it is set than not, eight counters of a byte being added at once, and the bits of
    the first hash."""
    bits = np.unpackbits(hashes.view(np.uint8), axis=1)
    ones = bits.view(np.uint64).sum(axis=0).view(np.uint8).astype(np.int64)
    return 2 * ones - len(bits), bits[0]


def covering_keys(fps: np.ndarray) -> np.ndarray:
    """One key for each mask of each part: the number of the mask, then the part's bits under it."""
    bits = np.unpackbits(fps.view(np.uint8), axis=1)[:, : PARTS * WIDTH].reshape(-1, PARTS, WIDTH)
    part = (bits * (1 << np.arange(WIDTH, dtype=np.uint32))).sum(axis=2, dtype=np.uint32)
    number = np.arange(PARTS * len(MASKS), dtype=np.uint32) << np.uint32(WIDTH)
    return (part[:, :, None] & np.array(MASKS, np.uint32)).reshape(len(fps), -1) | number


def _by_pairs(fp: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The least place that each text of a bucket is linked to, over any number of links; texts ascend by size."""
    found, held, n = [], 0, len(fp)
    top = np.searchsorted(size, size / LEAST + 1e-6)
    step = max(1, min(128, AT_ONCE // n))
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        a, b = np.nonzero(np.bitwise_count(fp[lo:hi, :1] ^ fp[lo : top[hi - 1], 0]) <= FIRST)
        a, b = a + lo, b + lo
        fit = (b > a) & (b < top[a])
        a, b = a[fit], b[fit]
        alike = np.bitwise_count(fp[a] ^ fp[b]).sum(axis=1) <= FAR
        found.append((a[alike], b[alike]))
        held += len(found[-1][0])
        if held > DENSE * n:
            return _by_breadth(fp, size)
    a, b = (np.concatenate(x) for x in zip(*found))
    least = np.arange(n)
    while (at := np.flatnonzero(least[a] != least[b])).size:
        x, y = least[a[at]], least[b[at]]
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while (least[least] != least).any():
            least = least[least]
    return least


def _by_breadth(fp: np.ndarray, size: np.ndarray) -> np.ndarray:
    """As _by_pairs: breadth first over those not yet reached, so that a dense bucket shrinks with each step."""
    least, left = np.arange(len(fp)), np.arange(len(fp))
    own, sizes = fp, size
    while len(left):
        leader = left[0]
        left, own, sizes = left[1:], own[1:], sizes[1:]
        queue = [leader]
        while queue and len(left):
            x = queue.pop()
            lo, hi = np.searchsorted(sizes, [_fewest(size[x]), size[x] / LEAST + 1e-6])
            at = np.flatnonzero(np.bitwise_count(own[lo:hi, 0] ^ fp[x, 0]) <= FIRST) + lo
            if len(at):
                at = at[np.bitwise_count(own[at] ^ fp[x]).sum(axis=1) <= FAR]
            if len(at):
                queue.extend(left[at].tolist())
                least[left[at]] = leader
                stay = np.ones(len(left), bool)
                stay[at] = False
                left, own, sizes = left[stay], own[stay], sizes[stay]
    return least


def _fewest(size: int) -> float:
    return LEAST * size - 1e-6


def spanning(entries: np.ndarray) -> np.ndarray:
    """Links (text, least text), two columns, that span the components of each bucket of entries."""
    order = np.argsort((entries["key"].astype(np.uint64) << np.uint64(32)) | entries["size"], kind="stable")
    entries = entries[order]
    key, size, s, fp = entries["key"], entries["size"].astype(np.int64), entries["s"], np.ascontiguousarray(entries["fp"])
    edge = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
    out = [np.zeros((0, 2), np.int64)]
    for lo, hi in zip(edge, edge[1:]):
        if hi - lo < 2:
            continue
        least = _by_pairs(fp[lo:hi], size[lo:hi])
        name = s[lo:hi].copy()
        np.minimum.at(name, least, s[lo:hi])
        name = name[least]
        linked = np.flatnonzero(name != s[lo:hi])
        out.append(np.stack([s[lo:hi][linked], name[linked]], 1))
    return np.unique(np.concatenate(out), axis=0)


def links(texts: DataFrame, partitions: int | None = None) -> DataFrame:
    """Links (a, b) of texts(s, size, fp) that span all components of texts that share a bucket, fit in size and differ
    in few bits. A batch's entries travel packed, one row for each cell of buckets. Sets that are too small to be alike
    without being equal have none."""
    texts = texts.where(F.col("size") >= LEAST / (1 - LEAST) - 1e-6)
    count = partitions or int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = max(count, texts.count() * PARTS * len(MASKS) // CELL + 1)

    def deal(it):
        for b in batches(it):
            fps = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint64).reshape(-1, WORDS)
            keys = covering_keys(fps).ravel()
            cell = (_mixed(keys.astype(np.uint64)) % np.uint64(cells)).astype(np.int64)
            order = np.argsort(cell, kind="stable")
            of, cell = order // (PARTS * len(MASKS)), cell[order]
            entries = np.empty(len(keys), ENTRY)
            entries["key"], entries["size"] = keys[order], b.column(1).to_numpy()[of]
            entries["s"], entries["fp"] = b.column(0).to_numpy()[of], fps[of, :TOLD]
            edge = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
            held = [entries[lo:hi].tobytes() for lo, hi in zip(edge, edge[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(cell[edge[:-1]]), pa.array(held, pa.binary())], ["cell", "held"])

    def run(it):
        at, held = None, []

        def close():
            a, b = spanning(np.frombuffer(b"".join(held), ENTRY)).T
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a)), pa.array(np.ascontiguousarray(b))], ["a", "b"])

        for b in batches(it):
            for cell, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if cell != at and held:
                    yield close()
                at = cell
                held.append(raw)
        if held:
            yield close()

    dealt = texts.select("s", "size", "fp").mapInArrow(deal, "cell bigint, held binary")
    return dealt.repartition(cells, "cell").sortWithinPartitions("cell").mapInArrow(run, "a bigint, b bigint")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1)


def _similar(pairs: DataFrame, sets: DataFrame, leaders: bool = False) -> DataFrame:
    """Those of pairs(a, b) whose sets(s, runs) have a similarity of LEAST or more. Where side a are leaders, few texts
    with very many partners, their sets are broadcast up to LIGHT bytes, which is checked; beyond, they are repeated
    SALT times, so that one text's partners are not one task's work."""

    def run(it):
        for b in batches(it):
            two = zip(b.column(2).to_pylist(), b.column(3).to_pylist())
            alike = [jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= LEAST for x, y in two]
            yield b.select([0, 1]).filter(pa.array(alike, pa.bool_()))

    one, other = (sets.select(F.col("s").alias(f"_{c}"), F.col("runs").alias(f"of_{c}")) for c in "ab")
    both = pairs.join(other, F.col("b") == F.col("_b"))
    if not leaders:
        both = both.join(one, F.col("a") == F.col("_a"))
    else:
        one = cut(one.join(pairs.select(F.col("a").alias("_s")).distinct(), F.col("_a") == F.col("_s"), "left_semi"))
        if (one.agg(F.sum(F.octet_length("of_a"))).first()[0] or 0) <= LIGHT:
            both = both.join(F.broadcast(one), F.col("a") == F.col("_a"))
        else:
            one = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
            both = both.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALT)).cast("int"))
            both = both.join(one, (F.col("a") == F.col("_a")) & (F.col("salt") == F.col("_salt")))
    return both.select("a", "b", "of_a", "of_b").mapInArrow(run, "a bigint, b bigint")


def _frequent(sets: DataFrame) -> np.ndarray:
    """Counters of shingles by the top bits of their hash, over all sets: COUNTERS numbers, whatever the input. Only
    the order of shingles depends on them, no result."""

    def run(it):
        count = np.zeros(COUNTERS, np.int64)
        for b in batches(it):
            for raw in b.column(0):
                np.add.at(count, (np.frombuffer(raw.as_buffer(), np.uint64) >> np.uint64(64 - 18)).astype(np.int64), 1)
        slot = np.flatnonzero(count)
        if len(slot):
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(count[slot])], ["slot", "n"])

    out = np.zeros(COUNTERS, np.int64)
    for slot, n in sets.select("runs").mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n")).collect():
        out[slot] = n
    return out


def _rare(sets: DataFrame) -> DataFrame:
    """(key, s, o, size, at): each set's rarest shingles, at being their place in its order, as many as two sets of a
    similarity of LEAST must share one of: with n shingles they share LEAST * n of them at least, so all but that
    many, and one more, hold a common one."""
    held = sets.sparkSession.sparkContext.broadcast(_frequent(sets))

    def run(it):
        for b in batches(it):
            of, key, size, place = [], [], [], []
            for at, raw in enumerate(b.column(2)):
                runs = np.frombuffer(raw.as_buffer(), np.uint64)
                count = held.value[(runs >> np.uint64(64 - 18)).astype(np.int64)]
                rare = runs[np.lexsort((runs, count))][: len(runs) - math.ceil(LEAST * len(runs) - 1e-9) + 1]
                of.append(np.full(len(rare), at))
                key.append(rare)
                size.append(np.full(len(rare), len(runs)))
                place.append(np.arange(len(rare)))
            of = pa.array(np.concatenate(of).astype(np.int64))
            one, *two = (pa.array(np.concatenate(v).view(np.int64)) for v in (key, size, place))
            yield pa.RecordBatch.from_arrays([one, b.column(0).take(of), b.column(1).take(of), *two], ["key", "s", "o", "size", "at"])

    return sets.select("s", "o", "runs").where(F.octet_length("runs") > 0).mapInArrow(run, f"key bigint, s bigint, o {ORDER}, size bigint, at bigint")


def _shared(members: DataFrame) -> DataFrame:
    """Rows of members(key, s, ...) whose key holds more than one text."""
    of = members.groupBy("key").agg(F.min("s").alias("x"), F.max("s").alias("y")).where("x <> y").select(F.col("key").alias("_key"))
    return members.join(of, F.col("key") == F.col("_key"), "left_semi")


def _round(open_: DataFrame, runs: DataFrame, leaders: int) -> tuple[DataFrame, DataFrame]:
    """Compares the first texts of each bucket of open_(key, s, o, size, at) with all later ones: (texts alike to one
    of them, rows that are left). Left are texts that are neither alike nor compared with all of their bucket.

    Of two sets whose first common shingle stands at places i and j at most min(n - i, m - j) are common; pairs for
    which that is too few aren't made. At later common places the test fails sooner, which loses none: the first one
    decides.
    """
    place = F.row_number().over(Window.partitionBy("key").orderBy("o"))
    first = open_.withColumn("_r", place).where(F.col("_r") <= leaders)
    lead = first.select(F.col("key").alias("_key"), F.col("s").alias("a"), F.col("o").alias("p"), F.col("size").alias("m"), F.col("at").alias("j"))
    common = F.least(F.col("m") - F.col("j"), F.col("size") - F.col("at"))
    fits = common >= LEAST / (1 + LEAST) * (F.col("m") + F.col("size")) - 1e-6
    pairs = open_.join(lead, (F.col("key") == F.col("_key")) & (F.col("p") < F.col("o")) & fits).select("a", F.col("s").alias("b")).distinct()
    gone = cut(_similar(cut(pairs), runs, leaders=True).select("b").distinct())
    last = lead.groupBy("_key").agg(F.max("p").alias("p"))
    after = open_.join(last, (F.col("key") == F.col("_key")) & (F.col("o") > F.col("p"))).select("key", "s", "o", "size", "at")
    return gone, cut(_shared(after.join(gone, F.col("s") == F.col("b"), "left_anti")))


def _crowded(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(b): texts of crowded components members(key, s, o) that are near copies of an earlier one in theirs, with
    no bound on the size of a group. sets: (s, o, runs) of these texts.

    At first a component's first text is compared with all others, which settles groups of copies: a few rounds of that.
    Texts still left meet by their rare shingles, which loses none and keeps passages that very many texts share out
    of it; each round takes four times as many first texts of a bucket, until none is left that wasn't compared.
    """
    runs = sets.select("s", "runs")
    size = sets.select(F.col("s").alias("_s"), (F.octet_length("runs") / 8).cast("bigint").alias("size"))
    open_ = cut(members.join(size, F.col("s") == F.col("_s")).select("key", "s", "o", "size", F.lit(0).cast("bigint").alias("at")))
    gone = []
    for _ in range(STARS):
        found, open_ = _round(open_, runs, 1)
        gone.append(found)
    release(members.sparkSession)
    left = sets.join(open_.select(F.col("s").alias("_s")).distinct(), F.col("s") == F.col("_s"), "left_semi")
    open_, leaders = cut(_shared(_rare(left))), 1
    while open_.head(1):
        found, open_ = _round(open_, runs, leaders)
        gone.append(found)
        leaders *= 4
    return functools.reduce(DataFrame.union, gone)


def first_of_near_copies(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) without near copies, with all columns.

    Of those that stay no two have a similarity of LEAST or more over runs of SIZE words, and each that goes has it
    with an earlier one (by doc_id, then text hash; nulls last). Texts without words count as equal; of rows with
    equal doc_id and text one stays, that of the smallest hash over all columns. Null texts are texts without words;
    texts of any length are taken whole; an empty table gives an empty one; columns of any names stay as they are.
    SimHashes linked by covering LSH only propose components; their pairs are settled by the two sets themselves.
    Equal sets meet as aggregated rows. The pairs of small components are compared as rows; the texts of crowded ones
    meet again by their rare shingles.
    """
    bound_batches(docs.sparkSession)

    def run(it):
        for b in batches(it):
            runs = [shingles(x or b"") for x in b.column(2).cast(pa.binary()).to_pylist()]
            name = np.array([xxh3_64_intdigest(r.tobytes()) for r in runs], np.uint64).view(np.int64)
            size = pa.array(list(map(len, runs)), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(name), size, pa.array([fingerprint(r).tobytes() for r in runs], pa.binary())], ["i", "d", "s", "size", "fp"])

    def sets_of(it):
        for b in batches(it):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(x or b"").tobytes() for x in b.column(1).cast(pa.binary()).to_pylist()], pa.binary())], ["s", "runs"])

    keyed = docs.select(docs["doc_id"].cast("bigint").alias("i"), F.xxhash64(docs["text"]).alias("d"), docs["text"].cast("string").alias("text"))
    rows = keyed.mapInArrow(run, "i bigint, d bigint, s bigint, size bigint, fp binary")
    order = F.struct(F.col("i").isNull().alias("n"), "i", "d")
    firsts = cut(rows.groupBy("s").agg(F.min(order).alias("o"), F.any_value("size").alias("size"), F.any_value("fp").alias("fp")))
    named = components(links(firsts))
    named = cut(named.union(named.select(F.col("root").alias("node"), "root").distinct()))
    release(docs.sparkSession)
    firsts = firsts.select("s", "o")
    members = cut(firsts.join(named, F.col("s") == F.col("node")).select(F.col("root").alias("key"), "s", "o"))
    text = keyed.withColumnsRenamed({"i": "ti", "d": "td"})
    sets = text.join(members.select("s", "o"), F.col("ti").eqNullSafe(F.col("o.i")) & (F.col("td") == F.col("o.d"))).select("s", "text").dropDuplicates(["s"]).mapInArrow(sets_of, "s bigint, runs binary")
    sets = cut(sets)
    sizes = cut(members.groupBy("key").agg(F.count("*").alias("n")).withColumnRenamed("key", "_key"))
    small, large = (members.join(sizes.where(c), F.col("key") == F.col("_key"), "left_semi") for c in (f"n <= {CROWD}", f"n > {CROWD}"))
    other = small.select(F.col("key").alias("_key"), F.col("s").alias("b"), F.col("o").alias("p"))
    pairs = small.join(other, (F.col("key") == F.col("_key")) & (F.col("o") < F.col("p"))).select(F.col("s").alias("a"), "b")
    crowd = large.select("s", "o").join(sets.withColumnRenamed("s", "_s"), F.col("s") == F.col("_s")).select("s", "o", "runs")
    gone = cut(_similar(pairs, sets).select("b").union(_crowded(large, cut(crowd))).distinct())
    release(docs.sparkSession)
    firsts = firsts.join(gone, F.col("s") == F.col("b"), "left_anti")
    return only_rows(docs, firsts.select(F.col("o.i").alias("i"), F.col("o.d").alias("d")))
