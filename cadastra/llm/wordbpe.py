"""Byte-pair merging of many pre-tokens at once, on ragged numpy arrays."""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

from cadastra.llm.common import TwoGenerations

#: Sequences of more symbols than this are merged one by one, by rank with position lists.
LONG = 4096
NONE = np.int64(1) << 40
#: Fixed values of the tokenizer file's split pattern, on lower-case printable ASCII.
ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class RankMerger:
    """Rank-synchronous merging: in each step every sequence merges all places of its own lowest-rank pair."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = (left << 20) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made
        letters = byte_alphabet()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a << 20) | b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank[at], NONE)

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Number of symbols that survive in each non-empty piece."""
        out = np.zeros(len(pieces), np.int64)
        short = [i for i, p in enumerate(pieces) if len(p) <= LONG]
        if short:
            out[short] = self._together([pieces[i] for i in short])
        for i, p in enumerate(pieces):
            if len(p) > LONG:
                out[i] = self._long(p)
        return out

    def _symbols(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        sym = self.inner[np.frombuffer(b"".join(pieces), np.uint8)]
        end = np.cumsum(size)
        sym[end - 1] = self.last[np.frombuffer(b"".join(p[-1:] for p in pieces), np.uint8)]
        return sym, size

    def _together(self, pieces: list[bytes]) -> np.ndarray:
        sym, size = self._symbols(pieces)
        out, live = size.copy(), np.arange(len(pieces))
        while len(live):
            start = np.cumsum(size) - size
            last = np.zeros(len(sym), bool)
            last[start + size - 1] = True
            rank = np.full(len(sym), NONE)
            inside = np.flatnonzero(~last)
            rank[inside] = self.ranks(sym[inside], sym[inside + 1])
            least = np.minimum.reduceat(rank, start)
            out[live] = size
            go = least < NONE
            if not go.any():
                break
            if not go.all():  # finished sequences leave the arrays
                keep = np.repeat(go, size)
                sym, rank, size, live, least = sym[keep], rank[keep], size[go], live[go], least[go]
                start = np.cumsum(size) - size
            hit = rank == np.repeat(least, size)
            at = np.flatnonzero(hit)
            fresh = np.ones(len(at), bool)  # of neighbouring places (aaa) every second one is merged, from the left
            fresh[1:] = at[1:] != at[:-1] + 1
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            sym[at] = self.made[rank[at]]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            size = size - np.bincount(np.searchsorted(start, at, side="right") - 1, minlength=len(size))
            sym = sym[stay]
        return out

    def _long(self, piece: bytes) -> int:
        """The same rule on one long sequence: the places of a rank wait in a list, linked neighbours are updated."""
        sym = self._symbols([piece])[0].tolist()
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        places: dict[int, list[int]] = {}
        for i, r in enumerate(self.ranks(np.array(sym[:-1]), np.array(sym[1:])).tolist()):
            if r < NONE:
                places.setdefault(r, []).append(i)
        heap = list(places)
        heapq.heapify(heap)
        rank_of = {int(k): int(r) for k, r in zip(self.keys.tolist(), self.rank.tolist())}
        left = n
        while heap:
            r = heapq.heappop(heap)
            for i in sorted(places.pop(r, ())):
                j = after[i]
                if sym[i] < 0 or j >= n or rank_of.get(sym[i] << 20 | sym[j]) != r:
                    continue
                sym[i], sym[j] = int(self.made[r]), -1
                after[i] = k = after[j]
                left -= 1
                if k < n:
                    before[k] = i
                for a, b in ((before[i], i), (i, k)):
                    if a >= 0 and b < n and (q := rank_of.get(sym[a] << 20 | sym[b])) is not None:
                        if q not in places:
                            places[q] = []
                            heapq.heappush(heap, q)
                        places[q].append(a)
        return left


class WordCounter:
    """Token counts of whole texts under a lower-casing word-level BPE file (word ends marked by a suffix)."""

    def __init__(self, path: str, chunks: int = 300_000, pieces: int = 300_000):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.specials = sorted((t["content"] for t in held["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        self.merger = RankMerger(held["model"]["vocab"], held["model"]["merges"], held["model"]["end_of_word_suffix"] or "")
        self.letters = {c: b for b, c in enumerate(byte_alphabet())}
        self.chunks, self.pieces = TwoGenerations(chunks), TwoGenerations(pieces)

    def _split(self, chunk: str) -> tuple[int, list[bytes]]:
        """(special tokens, pre-tokens as bytes) of a chunk without spaces."""
        if chunk.isascii() and chunk.isprintable() and "<|" not in chunk:
            return 0, [p.encode() for p in ASCII_PIECES.findall(chunk.lower())]
        found, parts = 0, [chunk]
        if self.special and self.special.search(chunk):
            parts = self.special.split(chunk)
            found = len(parts) - 1
        out = []
        for part in parts:
            if part:
                for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part)):
                    out.append(bytes(map(self.letters.__getitem__, piece)))
        return found, [p for p in out if p]

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text. White space never lies inside a token, so a text is the sum of its chunks."""
        split = [t.replace("\n", " ").split(" ") for t in texts]
        new = self.chunks.missing(set().union(*split)) if split else []
        if new:
            cut = [self._split(c) for c in new]
            unknown = self.pieces.missing({p for _, ps in cut for p in ps})
            if unknown:
                self.pieces.young.update(zip(unknown, self.merger.counts(unknown).tolist()))
            of = self.pieces.young
            self.chunks.young.update((c, s + sum([of[p] for p in ps])) for c, (s, ps) in zip(new, cut))
        get = self.chunks.young.__getitem__
        out = np.fromiter((sum(map(get, c)) for c in split), np.int64, len(split))
        self.pieces.settle()
        self.chunks.settle()
        return out


@lru_cache(maxsize=2)
def word_counter(path: str) -> WordCounter:
    """The process's counter for a file: a worker's memos outlive its tasks."""
    return WordCounter(path)
