"""Token ids in shards compressed by a Re-Pair grammar (operator 6).

A block's payload, little-endian: magic "RPG2"; header of six unsigned 64-bit numbers (documents, tokens, symbols,
rules, base, width); the rules' two symbols, all left ones, then all right ones, rule k being symbol base + k; the
rules' expansion lengths (unsigned 32-bit); for each document the number of its first symbol (unsigned 64-bit, one
more at the end); the symbols. Numbers of `width` bits are stored as their low 16 bits (unsigned 16-bit), then one
plane of bits for each higher one. A document's symbols are its own, so each is decoded without the others; expansion
lengths lead to any position inside it.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadastra.llm.bytebpe import byte_encoder
from cadastra.llm.common import batches, bound_batches, narrow, shared_table, texts

MAGIC, HEAD = b"RPG2", struct.Struct("<4s6Q")
#: A block is closed when it holds so many ids; a single longer document makes a block of its own.
BLOCK = 1 << 20
#: Uses from which a rule pays: it takes two symbols of some 17 bits and a length of 32, a use saves one symbol.
LEAST = 4
#: Bits of the hashed count that leaves out pairs which can't be frequent, before the exact one.
SLOTS = 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: It goes first where so many places are open; rare pairs that have a rule are then left until fewer are.
MANY = 1 << 15
#: Rules of longer expansions are unfolded step by step; shorter ones lie ready.
FLAT = 256


def _second_ones(joined: np.ndarray) -> np.ndarray:
    """Of runs in joined (ascending numbers, each a repetition of the one before it) the first, third, ... one."""
    fresh = np.ones(len(joined), bool)
    fresh[1:] = joined[1:] != joined[:-1] + 1
    place = np.arange(len(joined))
    return joined[(place - np.maximum.accumulate(np.where(fresh, place, 0))) % 2 == 0] if len(joined) else joined


def _possible(keys: np.ndarray) -> np.ndarray:
    """Keys that may occur LEAST times: a slot's count is at least that of each of its keys."""
    slot = ((keys * GOLDEN) >> np.uint64(64 - SLOTS)).view(np.int64)
    return (np.bincount(slot, minlength=1 << SLOTS) >= LEAST).take(slot)


class Grammar:
    """Re-Pair on documents that lie end to end, on linked places, so that a step costs what it changes.

    Each step counts the pairs at all open places exactly, makes a rule of every pair that has LEAST uses left after
    more frequent neighbours took theirs, and opens the places that changed. A pair below LEAST is closed, since its
    places only become fewer; when no place is open, one more count over all places confirms that none was missed.
    """

    def __init__(self, ids: np.ndarray, starts: np.ndarray, base: int):
        n = len(ids)
        self.end = n
        self.sym = np.append(ids.astype(np.uint32), np.uint32(0))
        self.after, self.before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        ends = np.append(starts[1:], n)
        full = ends > starts
        self.after[ends[full] - 1] = n
        self.after[n] = n
        self.before[starts[full]] = n
        self.alive = np.ones(n + 1, bool)
        self.alive[n] = False
        # Work space, all zero between steps.
        self.weight, self.open = np.zeros(n + 1, np.int32), np.zeros(n + 1, bool)
        self.base, self.rules = base, []
        self.keys, self.symbols = np.zeros(0, np.uint64), np.zeros(0, np.uint32)

    def run(self) -> None:
        at, made = self._first(), -1
        while made < len(self.rules):
            made = len(self.rules)
            while len(at):
                at = self._step(at)
            at = np.flatnonzero(self.alive[:-1] & (self.after[:-1] < self.end))

    def _pairs(self, at: np.ndarray) -> np.ndarray:
        return (self.sym.take(at).astype(np.uint64) << np.uint64(32)) | self.sym.take(self.after.take(at))

    def _rule_of(self, keys: np.ndarray) -> np.ndarray:
        """The symbol of each pair that has a rule, else 0."""
        if not len(self.keys):
            return np.zeros(len(keys), np.uint32)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[place] == keys, self.symbols[place], 0)

    def _first(self) -> np.ndarray:
        """The step over all places at first, which still lie side by side; returns the open places."""
        n = self.end
        if n < 2:
            return np.zeros(0, np.int64)
        sym = self.sym[:-1]
        if self.base <= 1 << 16:
            keys = (sym[:-1] << np.uint32(16)) | sym[1:]
        else:
            keys = (sym[:-1].astype(np.uint64) << np.uint64(32)) | sym[1:]
        coded = pa.array(keys).dictionary_encode()
        code, pair = coded.indices.to_numpy(), coded.dictionary.to_numpy().astype(np.uint64)
        if self.base <= 1 << 16:
            pair = ((pair >> np.uint64(16)) << np.uint64(32)) | (pair & np.uint64(0xFFFF))
        over = np.flatnonzero(self.after[: n - 1] == n)  # these pairs would reach over the end of a document
        joined = np.flatnonzero(code[1:] == code[:-1]) + 1
        shut = np.union1d(over, _second_ones(joined))
        rank, known = self._ranks(code, pair, shut, many=True)
        own = rank.take(code)
        held = own.copy()
        own[shut] = 0
        pick = np.ones(n - 1, bool)
        pick[1:] &= own[1:] > own[:-1]
        pick[:-1] &= own[:-1] > own[1:]
        pick &= own > 0
        held[over] = 0
        at = np.flatnonzero(held)
        return self._rewrite(at, code.take(at), pair, known, pick.take(at))

    def _ranks(self, code: np.ndarray, pair: np.ndarray, shut: np.ndarray, many: bool) -> tuple[np.ndarray, np.ndarray]:
        """For each pair its rank (more frequent pairs are greater, ties by the pair; 0: not frequent, without a rule)
        and its rule's symbol (0: none)."""
        count = np.bincount(code, minlength=len(pair)) - np.bincount(code[shut], minlength=len(pair))
        often = np.flatnonzero(count >= LEAST)
        known = np.zeros(len(pair), np.uint32)
        if many:
            known[often] = self._rule_of(pair[often])
        else:
            known = self._rule_of(pair)
            often = np.flatnonzero((count >= LEAST) | (known > 0))
        rank = np.zeros(len(pair), np.int32)
        rank[often[np.lexsort((pair[often], count[often]))]] = np.arange(1, len(often) + 1, dtype=np.int32)
        return rank, known

    def _step(self, at: np.ndarray) -> np.ndarray:
        keys, many = self._pairs(at), len(at) > MANY
        if many:
            ok = np.flatnonzero(_possible(keys))
            at, keys = at.take(ok), keys.take(ok)
        coded = pa.array(keys).dictionary_encode()
        code, pair = coded.indices.to_numpy(), coded.dictionary.to_numpy()
        joined = np.flatnonzero(code[1:] == code[:-1]) + 1
        shut = _second_ones(joined[self.before[at[joined]] == at[joined - 1]])
        rank, known = self._ranks(code, pair, shut, many)
        own = rank.take(code)
        open_ = np.flatnonzero(own)
        own[shut] = 0
        at, code, own = at.take(open_), code.take(open_), own.take(open_)
        self.weight[at] = own
        pick = (own > self.weight.take(self.before.take(at))) & (own > self.weight.take(self.after.take(at)))
        self.weight[at] = 0
        return self._rewrite(at, code, pair, known, pick)

    def _rewrite(self, at, code, pair, known, pick) -> np.ndarray:
        """Makes the rules of the pairs picked at LEAST places, if they have none, and puts them in."""
        pick = np.flatnonzero(pick)
        uses = np.bincount(code.take(pick), minlength=len(pair))
        known = np.where(uses > 0, known, 0)
        fresh = np.flatnonzero((uses >= LEAST) & (known == 0))
        known[fresh] = self.base + len(self.rules) + np.arange(len(fresh), dtype=np.uint32)
        self.rules += pair[fresh].tolist()
        if len(fresh):
            keys, symbols = np.concatenate([self.keys, pair[fresh]]), np.concatenate([self.symbols, known[fresh]])
            order = np.argsort(keys)
            self.keys, self.symbols = keys[order], symbols[order]
        symbol = known.take(code.take(pick))
        ruled = np.flatnonzero(symbol)
        pick, symbol = pick.take(ruled), symbol.take(ruled)
        return self._replace(at.take(pick), symbol, at)

    def _replace(self, place: np.ndarray, symbol: np.ndarray, held: np.ndarray) -> np.ndarray:
        """Puts symbols in place of the pairs there; returns the open places after that, held being those before."""
        gone = self.after.take(place)
        follow = self.after.take(gone)
        self.sym[place] = symbol
        self.after[place] = follow
        self.before[follow] = place
        self.alive[gone] = False
        self.open[held] = True
        self.open[self.before.take(place)] = True
        self.open &= self.alive
        at = np.flatnonzero(self.open)
        self.open[at] = False
        return at.take(np.flatnonzero(self.after.take(at) < self.end))


def packed(numbers: np.ndarray, width: int) -> bytes:
    planes = [np.packbits((numbers >> b & 1).astype(bool)).tobytes() for b in range(16, width)]
    return b"".join([(numbers & 0xFFFF).astype("<u2").tobytes(), *planes])


class Packed:
    """Numbers packed in a buffer, read by ranges."""

    def __init__(self, raw: bytes, at: int, count: int, width: int):
        self.low = np.frombuffer(raw, "<u2", count, at)
        plane = -(-count // 8)
        self.planes = [np.frombuffer(raw, np.uint8, plane, at + 2 * count + plane * i) for i in range(max(0, width - 16))]
        self.stop = at + 2 * count + plane * len(self.planes)

    def read(self, lo: int, hi: int) -> np.ndarray:
        out = self.low[lo:hi].astype(np.uint32)
        for i, plane in enumerate(self.planes):
            bits = np.unpackbits(plane[lo // 8 : -(-hi // 8)])[lo % 8 : lo % 8 + hi - lo]
            out |= bits.astype(np.uint32) << np.uint32(16 + i)
        return out


def compress(ids: np.ndarray, starts: np.ndarray, base: int) -> bytes:
    """The payload of a block: ids of documents that lie end to end, starts their first places."""
    grammar = Grammar(ids, starts, base)
    grammar.run()
    table = np.array(grammar.rules, np.uint64)
    table = np.stack([table >> np.uint64(32), table & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)
    length = lengths(table, base)
    place = np.flatnonzero(grammar.alive)
    sym = grammar.sym[place]
    first = np.searchsorted(place, np.append(starts, len(ids)), side="left")
    width = max(16, (base + len(table) - 1).bit_length())
    head = HEAD.pack(MAGIC, len(starts), len(ids), len(sym), len(table), base, width)
    rules = packed(table[:, 0], width) + packed(table[:, 1], width)
    return b"".join([head, rules, length.astype("<u4").tobytes(), first.astype("<u8").tobytes(), packed(sym, width)])


def lengths(table: np.ndarray, base: int) -> np.ndarray:
    """Expansion lengths of rules, each of which uses earlier symbols only."""
    out = [1] * base
    for a, b in zip(table[:, 0].tolist(), table[:, 1].tolist()):
        out.append(out[a] + out[b])
    return np.array(out[base:], np.int64)


class Block:
    """A payload, opened for random access."""

    def __init__(self, payload: bytes):
        magic, docs, self.tokens, symbols, rules, self.base, width = HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a block of this format")
        left = Packed(payload, HEAD.size, rules, width)
        right = Packed(payload, left.stop, rules, width)
        self.rules = np.stack([left.read(0, rules), right.read(0, rules)], 1)
        self.length = np.frombuffer(payload, "<u4", rules, right.stop).astype(np.int64)
        self.first = np.frombuffer(payload, "<u8", docs + 1, right.stop + 4 * rules).astype(np.int64)
        self.sym = Packed(payload, right.stop + 4 * rules + 8 * (docs + 1), symbols, width)
        # Expansions of terminals and of short rules lie in one array.
        self.size = np.concatenate([np.ones(self.base, np.int64), self.length])
        ready = np.where(self.size <= FLAT, self.size, 0)
        self.where = np.cumsum(ready) - ready
        short = self.rules[self.length <= FLAT].ravel()
        while (open_ := short >= self.base).any():
            short = self._unfolded(short, open_)
        self.flat = np.concatenate([np.arange(self.base, dtype=np.uint32), short]).astype("<u4")

    def _unfolded(self, sym: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Symbols with those marked replaced by the two of their rule."""
        size = 1 + which
        at = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.uint32)
        out[at[~which]] = sym[~which]
        pair = self.rules[sym[which] - self.base]
        out[at[which]], out[at[which] + 1] = pair[:, 0], pair[:, 1]
        return out

    def expand(self, sym: np.ndarray) -> np.ndarray:
        while (long := self.size[sym] > FLAT).any():
            sym = self._unfolded(sym, long)
        size = self.size.take(sym)
        shift = self.where.take(sym) - (np.cumsum(size) - size)
        place = np.repeat(shift, size)
        place += np.arange(len(place))
        return self.flat.take(place)

    def doc(self, i: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids of document i from start up to stop; only the symbols in between are expanded."""
        sym = self.sym.read(int(self.first[i]), int(self.first[i + 1]))
        if start or stop is not None:
            ends = np.cumsum(self.size[sym])
            lo = int(np.searchsorted(ends, start, side="right"))
            hi = len(sym) if stop is None else int(np.searchsorted(ends, stop, side="left")) + 1
            skipped = int(ends[lo - 1]) if lo else 0
            return self.expand(sym[lo:hi])[start - skipped : None if stop is None else stop - skipped]
        return self.expand(sym)

    def docs(self):
        """All documents' ids, some hundred documents at a time."""
        n = len(self.first) - 1
        for lo in range(0, n, 256):
            hi = min(n, lo + 256)
            sym = self.sym.read(int(self.first[lo]), int(self.first[hi]))
            place = np.concatenate([[0], np.cumsum(self.size[sym])])[self.first[lo : hi + 1] - self.first[lo]]
            ids = self.expand(sym)
            for a, b in zip(place[:-1].tolist(), place[1:].tolist()):
                yield ids[a:b]


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Rows (shard, block, n_docs, n_tokens, doc_ids, payload), written as Parquet in the shared folder and read back.

    Documents are dealt by ranges of (doc_id, text hash, place in the input), so that shard after shard, block after
    block, they stand in ascending doc_id order (nulls first, repeated ids together) and a row that is repeated very
    often is spread too; a shard is a range, compressed in blocks that hold BLOCK ids or one longer document.
    """
    bound_batches(docs.sparkSession)
    order = [F.col("doc_id").asc_nulls_first(), F.col("_h"), F.col("_place")]
    keyed = narrow(docs, {"doc_id": "bigint", "text": "string"}).withColumns({"_h": F.xxhash64("text"), "_place": F.monotonically_increasing_id()})
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(it):
        encoder = byte_encoder(tokenizer)
        shard, block = TaskContext.get().partitionId(), 0
        base = max(encoder.size, end_id + 1)
        end = np.array([end_id], encoder.dtype)
        names, parts, size = [], [], 0

        def close():
            held = np.fromiter(map(len, parts), np.int64, len(parts)).reshape(-1, 2).sum(axis=1)
            payload = compress(np.concatenate(parts), np.cumsum(held) - held, base)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int64()), pa.array([block], pa.int64()), pa.array([len(names)], pa.int64()), pa.array([int(held.sum())], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([payload], pa.binary())],
                ["shard", "block", "n_docs", "n_tokens", "doc_ids", "payload"],
            )

        for b in batches(it):
            for name, ids in zip(b.column(0).to_pylist(), encoder.encode(texts(b.column(1)))):
                names.append(name)
                parts += ids, end
                size += len(ids) + 1
                if size >= BLOCK:
                    yield close()
                    names, parts, size, block = [], [], 0, block + 1
        if parts:
            yield close()

    return shared_table(dealt.mapInArrow(run, "shard bigint, block bigint, n_docs bigint, n_tokens bigint, doc_ids array<bigint>, payload binary"), "repair")


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in written shards, decoded from them.

    start counts the ids of all documents before; block totals, a few numbers for a million ids, give each block's own start.
    """

    def run(it):
        for b in batches(it):
            for names, payload, base in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                ids = [(len(x), zlib.crc32(x)) for x in Block(payload.as_py()).docs()]
                size = np.array([n for n, _ in ids], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(np.cumsum(size) - size + base), pa.array(size), pa.array([c for _, c in ids], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    totals = shards.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = totals.select(F.col("shard").alias("_shard"), (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("_before"))
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = shards.select("shard", "block", inside.alias("_inside")).join(before, F.col("shard") == F.col("_shard")).select(F.col("shard").alias("_s"), F.col("block").alias("_b"), (F.col("_inside") + F.col("_before")).alias("base"))
    placed = shards.join(F.broadcast(starts) if _few(shards) else starts, (F.col("shard") == F.col("_s")) & (F.col("block") == F.col("_b")))
    return placed.select("doc_ids", "payload", "base").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _few(shards: DataFrame, limit: int = 100_000) -> bool:
    """Whether the block table (three numbers a row) is small enough to broadcast; counted from the files' metadata."""
    return shards.count() <= limit


def token_ids(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): docs(doc_id, text) written as compressed shards and read back from them.

    Null and empty texts have the end id alone. Repeated rows are documents of their own, next to each other;
    an empty table gives an empty one; extra columns are ignored. Whole texts, whatever their length.
    """
    return read_shards(write_shards(docs, tokenizer, end_id))
