"""Nearest neighbours over sharded hierarchical navigable small-world graphs (operator 10)."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadastra.llm.common import batches, bound_batches, narrow, shared_table

#: Vectors of a shard, about; links a vector chooses; links it keeps (twice that on the lowest layer).
SHARD, LINKS = 16_384, 20
#: Beam of the search for a new vector's links; vectors inserted together at most; entry places of a layer.
BUILD_BEAM, BATCH, ENTRIES = 96, 256, 16
#: Beam of a query's search; vectors expanded in a step; queries searched together.
BEAM, STEP, TOGETHER = 200, 4, 256
#: Queries that one copy of the index serves; more queries get copies that work side by side.
QUERY_GROUP = 1 << 16
#: Pairs of query and vector that are scored at once.
PAIRS = 1 << 16


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-mixed 64-bit hashes of integers."""
    x = x.astype(np.uint64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def chosen(x: np.ndarray, own: np.ndarray, candidates: np.ndarray, links: int) -> np.ndarray:
    """For each vector of own the candidates (places in x, -1: none; no place twice) that it links to, at most links,
    -1 where there are fewer: from the nearest on those that no chosen one is nearer to, then the nearest others."""
    out = np.full((len(own), links), -1, np.int32)
    for lo in range(0, len(own), 128):
        near = candidates[lo : lo + 128]
        v = x[np.maximum(near, 0)]
        like = np.where(near >= 0, np.einsum("rcd,rd->rc", v, own[lo : lo + 128]), -np.inf)
        order = np.argsort(-like, axis=1, kind="stable")
        near, like, v = (np.take_along_axis(a, o, 1) for a, o in ((near, order), (like, order), (v, order[:, :, None])))
        among = v @ v.transpose(0, 2, 1)
        picked, count = np.zeros(near.shape, bool), np.zeros(len(near), np.int64)
        closest = np.full(near.shape, -np.inf, np.float32)  # likeness to the nearest chosen one
        for j in range(near.shape[1]):
            go = (like[:, j] > closest[:, j]) & (count < links)
            picked[:, j] = go
            count += go
            np.maximum(closest, among[:, j], out=closest, where=go[:, None])
        rank = np.where(near >= 0, np.where(picked, 0, near.shape[1]), 2 * near.shape[1]) + np.arange(near.shape[1])
        first = np.argsort(rank, axis=1)[:, :links]
        out[lo : lo + 128, : first.shape[1]] = np.take_along_axis(near, first, 1)
    return out


class Graph:
    """One shard: unit vectors, and for each layer its members and their flat neighbour array."""

    def __init__(self, vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.x, self.layers = vectors, layers

    @classmethod
    def build(cls, x: np.ndarray, seeds: np.ndarray) -> Graph:
        """x: distinct unit vectors; seeds: integers that decide each one's highest layer and its turn.

        Vectors are inserted from the highest layer down, some together: each is searched for in the layers above and
        in what its layer holds already, chooses its links among what is found and among those inserted with it, and
        those it links to link back, choosing anew where they have too many.
        """
        x = x.astype(np.float32)
        turn = mixed(seeds)
        u = (turn >> np.uint64(11)).astype(np.float64) / (1 << 53)
        top = np.floor(-np.log(np.maximum(u, 1e-18)) / np.log(LINKS)).astype(int)
        highest = 0
        while (top > highest).sum() > 1:
            highest += 1
        graph = cls(x, [])
        for level in range(highest, -1, -1):
            members = np.flatnonzero(top >= level)
            links = np.full((len(members), LINKS * 2 if level == 0 else LINKS), -1, np.int32)
            graph.layers.insert(0, (members, links))
            order = np.lexsort((turn[members], -top[members]))
            at = 0
            while at < len(order):
                new = order[at : at + min(BATCH, max(at, ENTRIES))]
                graph._insert(members, links, order[:at], new)
                at += len(new)
        return graph

    def _insert(self, members: np.ndarray, links: np.ndarray, held: np.ndarray, new: np.ndarray) -> None:
        """Inserts places new into the lowest layer there is so far, which holds the places held."""
        q = self.x[members[new]]
        mates = np.broadcast_to(new, (len(new), len(new))).copy()
        np.fill_diagonal(mates, -1)
        if len(new) > BUILD_BEAM:  # of those inserted with it, the nearest ones
            like = q @ q.T
            np.fill_diagonal(like, -np.inf)
            mates = new[np.argpartition(-like, LINKS, axis=1)[:, :LINKS]]
        found = mates
        if len(held):
            entry = np.broadcast_to(held[:ENTRIES], (len(new), min(ENTRIES, len(held))))
            ready = np.zeros(len(members) + 1, bool)
            ready[held] = True
            above = self._entries(q, 0)
            if above is not None:
                above = np.where(ready[above], above, -1)
                above[(above[:, :, None] == entry[:, None, :]).any(axis=2)] = -1
                entry = np.concatenate([entry, above], 1)
            found = np.concatenate([self._layer(q, members, links, entry, BUILD_BEAM), mates], 1)
        local = self.x[members]
        mine = chosen(local, q, found, min(LINKS, links.shape[1]))
        links[new, : mine.shape[1]] = mine
        a, place = np.nonzero(mine >= 0)
        source, target = new[a], mine[a, place]
        like = np.einsum("nd,nd->n", local[source], local[target])
        order = np.lexsort((-like, target))
        source, target = source[order], target[order]
        ok = ~(links[target] == source[:, None]).any(axis=1)
        source, target = source[ok], target[ok]
        back, first = np.unique(target, return_index=True)
        nth = np.arange(len(target)) - np.repeat(first, np.diff(np.append(first, len(target))))
        source, row, nth = (v[nth < links.shape[1]] for v in (source, np.searchsorted(back, target), nth))
        wide = np.full((len(back), links.shape[1] + (int(nth.max()) + 1 if len(nth) else 0)), -1, np.int32)
        wide[:, : links.shape[1]] = links[back]
        wide[row, links.shape[1] + nth] = source
        links[back] = chosen(local, local[back], wide, links.shape[1])

    def dump(self) -> bytes:
        f = io.BytesIO()
        np.savez(f, x=self.x, **{f"{kind}{i}": a for i, layer in enumerate(self.layers) for kind, a in zip("mn", layer)})
        return f.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Graph:
        f = np.load(io.BytesIO(raw))
        return cls(f["x"], [(f[f"m{i}"], f[f"n{i}"]) for i in range((len(f.files) - 1) // 2)])

    def search(self, queries: np.ndarray, k: int, beam: int = BEAM) -> np.ndarray:
        """(q, k) places of near vectors for unit queries, nearest first, -1 where there are fewer."""
        out = np.full((len(queries), k), -1, np.int64)
        members, links = self.layers[0]
        for lo in range(0, len(queries), TOGETHER):
            q = queries[lo : lo + TOGETHER].astype(np.float32)
            entry = self._entries(q, 0)
            if entry is None:
                entry = np.tile(np.arange(min(len(members), ENTRIES)), (len(q), 1))
            got = self._layer(q, members, links, entry, max(beam, k))[:, :k]
            out[lo : lo + len(q), : got.shape[1]] = np.where(got >= 0, members[np.maximum(got, 0)], -1)
        return out

    def _entries(self, q: np.ndarray, level: int) -> np.ndarray | None:
        """Places of a layer, -1 for none, that a search of the layers above leads to; None for the highest layer."""
        entry = None
        for above in range(len(self.layers) - 1, level, -1):
            members, links = self.layers[above]
            if entry is None:
                entry = np.tile(np.arange(min(len(members), ENTRIES)), (len(q), 1))
            found = self._layer(q, members, links, entry, 24)[:, :8]
            entry = np.where(found >= 0, np.searchsorted(self.layers[above - 1][0], members[np.maximum(found, 0)]), -1)
        return entry

    def _layer(self, q: np.ndarray, members: np.ndarray, links: np.ndarray, entry: np.ndarray, beam: int) -> np.ndarray:
        """Best-first search of all queries side by side on one layer; places among its members, nearest first."""
        rows = np.arange(len(q))[:, None]
        beam = min(beam, len(members))
        seen = np.zeros((len(q), len(members) + 1), bool)  # one more place, for -1
        seen[:, -1] = True

        def likeness(at):
            s = np.einsum("qcd,qd->qc", self.x[members[np.maximum(at, 0)]], q)
            return np.where(at >= 0, s, -np.inf).astype(np.float32)

        at = np.full((len(q), beam), -1, np.int64)
        width = min(entry.shape[1], beam)
        at[:, :width] = entry[:, :width]
        score = np.full((len(q), beam), -np.inf, np.float32)
        score[:, :width] = likeness(at[:, :width])
        seen[rows, at] = True
        done = at < 0
        live = np.arange(len(q))
        while len(live):
            s, d, a = score[live], done[live], at[live]
            open_score = np.where(d, -np.inf, s)
            pick = np.argpartition(-open_score, min(STEP, beam) - 1, axis=1)[:, :STEP]
            go = np.take_along_axis(open_score, pick, 1) > -np.inf
            if not go.any(axis=1).all():
                live = live[go.any(axis=1)]
                continue
            one = np.arange(len(live))[:, None]
            d[one, pick] = True
            new = np.where(go[:, :, None], links[np.maximum(np.take_along_axis(a, pick, 1), 0)], -1).reshape(len(live), -1)
            new = np.where(seen[live[:, None], new], -1, new)
            new = np.sort(new, axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            seen[live[:, None], new] = True
            vector = self.x[members[np.maximum(new, 0)]]
            t = np.where(new >= 0, np.einsum("qcd,qd->qc", vector, q[live]), -np.inf).astype(np.float32)
            s, a, d = np.concatenate([s, t], 1), np.concatenate([a, new], 1), np.concatenate([d, new < 0], 1)
            top = np.argpartition(-s, beam - 1, axis=1)[:, :beam]
            score[live], at[live], done[live] = (np.take_along_axis(v, top, 1) for v in (s, a, d))
        order = np.argsort(-score, axis=1, kind="stable")
        return np.take_along_axis(at, order, 1)


def _usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part: finite, not zero, with an id."""
    v = narrow(vectors, {"vec_id": "bigint", "embedding": "array<double>"}).select("vec_id", F.col("embedding").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))


def unit(x: np.ndarray) -> np.ndarray:
    """Directions; large or small components don't overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def build_index(vectors: DataFrame, k: int) -> DataFrame:
    """(shard, dims, ids, owner, exact, graph), written in the shared folder: a graph of each shard's directions.

    Of the ids of equal vectors the k + 1 smallest are kept, which are all that can be among anyone's k nearest with
    ties to smaller ids. The limit works before the shuffle (a window group limit), so a group of copies of any size
    stays small. All vectors of a direction (multiples) share a place of the graph; a shard holds them all, since
    their exact scores decide. ids: the ids kept; owner: the place of each one; exact: its vector.
    """
    bound_batches(vectors.sparkSession)
    v = _usable(vectors)
    count = max(1, -(-v.count() // SHARD))
    copies = Window.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id")
    rows = v.distinct().withColumn("_n", F.row_number().over(copies)).where(F.col("_n") <= k + 1)
    shard = F.pmod(F.xxhash64(F.xxhash64("v")), F.lit(count))
    dealt = rows.select("vec_id", "v", F.size("v").alias("dims"), shard.alias("shard"))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id")
        x = np.array(group["v"].tolist(), np.float64)
        direction = np.ascontiguousarray(unit(x).astype(np.float32) + np.float32(0))
        raw = direction.view(np.dtype((np.void, 4 * x.shape[1]))).ravel()
        _, first, owner = np.unique(raw, return_index=True, return_inverse=True)
        ids = group["vec_id"].to_numpy()
        graph = Graph.build(direction[first], ids[first])
        return pd.DataFrame(
            {
                "shard": [int(group["shard"].iloc[0])],
                "dims": [x.shape[1]],
                "ids": [ids.astype("<i8").tobytes()],
                "owner": [owner.astype("<i4").tobytes()],
                "exact": [x.astype("<f8").tobytes()],
                "graph": [graph.dump()],
            }
        )

    held = "shard bigint, dims int, ids binary, owner binary, exact binary, graph binary"
    return shared_table(dealt.groupBy("dims", "shard").applyInPandas(one, held), "hnsw")


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows in double precision; large or small components don't overflow."""
    a, b = a / np.abs(a).max(axis=-1, keepdims=True), b / np.abs(b).max(axis=-1, keepdims=True)
    return (a * b).sum(axis=-1) / (np.sqrt((a * a).sum(axis=-1)) * np.sqrt((b * b).sum(axis=-1)))


class Shard:
    """A row of the index, opened for search."""

    def __init__(self, row: dict):
        self.graph = Graph.load(row["graph"])
        self.ids, owner = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["owner"], "<i4")
        self.exact = np.frombuffer(row["exact"], "<f8").reshape(-1, row["dims"])
        self.by = np.argsort(owner, kind="stable")
        self.start = np.searchsorted(owner[self.by], np.arange(len(self.graph.x) + 1))

    def nearest(self, names: np.ndarray, x: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vector, score) of each query's k best among all vectors of the directions that a beam found."""
        near = self.graph.search(unit(x), beam, beam)
        at = np.maximum(near, 0)
        size = np.where(near >= 0, self.start[at + 1] - self.start[at], 0)
        out, lo = [], 0
        while lo < len(x):
            pairs = np.cumsum(size[lo:].sum(axis=1))
            hi = lo + max(1, int(np.searchsorted(pairs, PAIRS, side="right")))
            n = size[lo:hi].ravel()
            query = np.repeat(np.arange(lo, hi).repeat(near.shape[1]), n)
            vec = self.by[np.repeat(self.start[at[lo:hi].ravel()] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            other = names[query] != self.ids[vec]
            query, vec = query[other], vec[other]
            value = np.concatenate([np.zeros(0)] + [cosine(x[query[a : a + PAIRS]], self.exact[vec[a : a + PAIRS]]) for a in range(0, len(query), PAIRS)])
            order = np.lexsort((self.ids[vec], -value, query))
            query, vec, value = query[order], self.ids[vec[order]], value[order]
            best = np.arange(len(query)) - np.searchsorted(query, query) < k
            out.append((names[query[best]], vec[best], value[best]))
            lo = hi
        return tuple(np.concatenate(v) for v in zip(*out))


def _blocks(queries: DataFrame) -> DataFrame:
    """(dims, ids, exact): queries(vec_id, v) packed into rows of at most TOGETHER queries of one length."""

    def run(it):
        of: dict[int, tuple[list, list]] = {}

        def row(dims):
            ids, values = of.pop(dims)
            packed = [[dims], [np.array(ids, "<i8").tobytes()], [np.array(values, "<f8").tobytes()]]
            types = pa.int32(), pa.binary(), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(packed, types)], ["dims", "ids", "exact"])

        for b in batches(it):
            for name, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids, values = of.setdefault(len(v), ([], []))
                ids.append(name)
                values.append(v)
                if len(ids) == TOGETHER:
                    yield row(len(v))
        for dims in list(of):
            yield row(dims)

    return queries.mapInArrow(run, "dims int, ids binary, exact binary")


def search_index(index: DataFrame, queries: DataFrame, k: int, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found, from the merged results of all shards.

    Queries (vec_id, embedding) travel as blocks to every shard of their length: a shard's row comes first in its
    partition, its blocks stream by, so a worker holds one shard and one block. Nothing passes through the driver.
    """
    spark = index.sparkSession
    bound_batches(spark)
    q = _usable(queries).distinct()
    groups = max(1, -(-q.count() // QUERY_GROUP))
    keys = ["dims", "shard", "grp"]
    none = F.lit(None).cast("binary")
    graphs = index.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(*keys, F.lit(0).alias("kind"), "ids", "owner", "exact", "graph")
    blocks = _blocks(q).join(F.broadcast(index.groupBy("dims").agg(F.max("shard").alias("last"))), "dims")
    dealt = blocks.withColumns({"shard": F.explode(F.sequence(F.lit(0).cast("bigint"), "last")), "grp": F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int")})
    both = graphs.unionByName(dealt.select(*keys, F.lit(1).alias("kind"), "ids", none.alias("owner"), "exact", none.alias("graph")))

    def run(it):
        at, shard = None, None
        for b in batches(it):
            for row in b.to_pylist():
                key = row["dims"], row["shard"], row["grp"]
                if row["kind"] == 0:
                    at, shard = key, Shard(row)
                elif key == at:
                    x = np.frombuffer(row["exact"], "<f8").reshape(-1, row["dims"])
                    found = shard.nearest(np.frombuffer(row["ids"], "<i8"), x, k, beam)
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in found], ["query_id", "vec_id", "score"])

    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    streams = both.repartition(count, *keys).sortWithinPartitions(*keys, "kind")
    found = streams.mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, beam: int = BEAM) -> DataFrame:
    """Each query's k nearest rows of vectors(vec_id, embedding) by cosine, without rows of its own id; ties to the smaller id.

    Rows without an id or with a null, empty, zero or non-finite vector take no part, as candidate or query. Repeated
    rows count once. Vectors of different lengths are never compared. Empty tables give an empty result; extra columns
    are ignored. With fewer candidates than k all are returned.
    """
    return search_index(build_index(vectors, k), queries, k, beam)
