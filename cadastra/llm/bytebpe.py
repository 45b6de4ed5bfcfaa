"""Ids of whole texts under a byte-level BPE file of the tokenizers library."""

from __future__ import annotations

import json
import os
from functools import cached_property, lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from cadastra.llm.wordbpe import byte_alphabet

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
#: Fixed value: the split pattern of a ByteLevel pre-tokenizer that uses its own expression.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What a file must say so that merging by rank of the merged token is the whole of its model.
PLAIN_SPLIT = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
PLAIN_MODEL = {
    "type": "BPE",
    "dropout": None,
    "unk_token": None,
    "continuing_subword_prefix": None,
    "end_of_word_suffix": None,
    "byte_fallback": False,
    "ignore_merges": False,
}


def _is(held: dict | None, wanted: dict) -> bool:
    return held is not None and all((held.get(k) or None) == (v or None) for k, v in wanted.items())


def rank_table(held: dict) -> dict[bytes, int] | None:
    """Byte strings with their ids, or None where the file does more than merge bytes in the order of those ids."""
    model, special = held["model"], {t["content"] for t in held["added_tokens"]}
    if held["normalizer"] is not None or not _is(held["pre_tokenizer"], PLAIN_SPLIT) or not _is(model, PLAIN_MODEL):
        return None
    byte_of = {c: b for b, c in enumerate(byte_alphabet())}
    vocab = {k: v for k, v in model["vocab"].items() if k not in special}
    pairs = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in model["merges"]]
    letters = len(vocab) - len(pairs)
    if letters != 256 or any(vocab.get(made) != letters + i for i, made in enumerate(pairs)):
        return None
    return {bytes(byte_of[c] for c in k): v for k, v in vocab.items()}


#: Classes of bytes: white space, letters (all bytes of the two-byte Latin letters too), digits, others.
SPACE, LETTER, DIGIT, OTHER = range(4)
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[[*range(0x09, 0x0E), 0x20]] = SPACE
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = LETTER
_CLASS[0x30:0x3A] = DIGIT
#: Texts with a byte of other characters are split by the library.
_FOREIGN = np.zeros(256, bool)
_FOREIGN[[*range(0xC0, 0xC3), *range(0xCA, 0x100)]] = True
#: Bytes that are split at once (arrays stay in a core's cache), pieces remembered.
CHUNK, KNOWN = 1 << 17, 1_000_000
SLOTS = 21
_R = np.random.default_rng(6)
_BYTE = _R.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int) -> np.ndarray:
    out = np.full(CHUNK, base, np.uint64)
    out[0] = 1
    return out.cumprod()


_POWER, _INVERSE = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def starts_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where the split pattern begins a piece, in texts of known characters that lie end to end."""
    n = len(data)
    kind = _CLASS[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    space = kind == SPACE
    begin = first[:-1].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    # The last of several white spaces before something else stands alone; a blank joins what follows it.
    begin[:-1] |= space[:-1] & ~space[1:] & ~first[1:-1]
    begin[1:] &= space[1:] | (data[:-1] != 0x20) | first[1:-1]
    # An apostrophe that begins a piece takes s, t, m, d, re, ve or ll with it.
    at = np.flatnonzero((data == 0x27) & begin)
    at = at[at + 1 < n]
    at = at[(kind[at + 1] == LETTER) & ~first[at + 1]]
    one = data[at + 1]
    single = (one == 0x73) | (one == 0x74) | (one == 0x6D) | (one == 0x64)
    room = np.flatnonzero(~single & (at + 2 < n))
    room = room[~first[at[room] + 2]]
    two = data[at[room] + 2]
    double = room[((one[room] == 0x72) | (one[room] == 0x76)) & (two == 0x65) | (one[room] == 0x6C) & (two == 0x6C)]
    size = np.where(single, 2, 0)
    size[double] = 3
    at, size = at[size > 0], size[size > 0]
    begin[at + 1] = False
    stop = (at + size)[at + size < n]
    begin[stop] |= kind[stop] == LETTER
    return np.flatnonzero(begin)


class Pieces:
    """A bounded memo of pieces and their ids, in flat arrays. A piece is found by hash and proved by a second word:
    its first eight bytes, which with the length (a part of the hash) are all of a short piece."""

    def __init__(self, dtype: np.dtype):
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self.slot = np.zeros(1 << SLOTS, np.int32)
        self.n, self.used = 1, 0
        self.key, self.head = np.zeros(KNOWN + 1, np.uint64), np.zeros(KNOWN + 1, np.uint64)
        self.start, self.size = np.zeros(KNOWN + 1, np.int32), np.zeros(KNOWN + 1, np.int32)
        self.ids = np.zeros(1 << 16, self.dtype)

    def slots(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64((1 << SLOTS) - 1)
        return (key & mask).astype(np.int64), (key >> np.uint64(64 - SLOTS)).astype(np.int64)

    def find(self, key: np.ndarray, head: np.ndarray) -> np.ndarray:
        """Number of each piece, 0 if unknown."""
        one, two = self.slots(key)
        number = self.slot.take(one)
        number[(self.key.take(number) != key) | (self.head.take(number) != head)] = 0
        miss = np.flatnonzero(number == 0)
        if len(miss):
            other = self.slot.take(two.take(miss))
            other[(self.key.take(other) != key.take(miss)) | (self.head.take(other) != head.take(miss))] = 0
            number[miss] = other
        return number

    def add(self, key: np.ndarray, head: np.ndarray, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Numbers of new pieces, whose ids lie end to end."""
        number = np.arange(self.n, self.n + len(key))
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), self.dtype)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.key[number], self.head[number], self.size[number] = key, head, size
        self.start[number] = self.used + np.cumsum(size) - size
        self.n, self.used = self.n + len(key), self.used + len(ids)
        one, two = self.slots(key)
        self.slot[np.where(self.slot[one] == 0, one, two)] = number
        return number


class ByteEncoder:
    """Encodes texts as little-endian 16-bit ids (32-bit for larger vocabularies), exactly as the library does.

    A file that only merges bytes in the order of its ids, which is read from the file itself, runs on the merge loop
    of a second library; both split alike at every code point (tested). Texts of ASCII and Latin letters are split
    here by numpy, many at a time, so that a piece which the bounded memo holds costs a few array places; new pieces
    go to the merge loop together. Other files, and texts that hold a special token, go to the tokenizers library whole.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        self.path = path
        self.specials = [t["content"].encode() for t in held["added_tokens"]]
        self.size = 1 + max([*held["model"]["vocab"].values(), *(t["id"] for t in held["added_tokens"])])
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        ranks = rank_table(held)
        self.merger = tiktoken.Encoding("file", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}) if ranks else None
        self.feed = ranks[b"\n"] if ranks else None
        self.pieces = Pieces(self.dtype)

    @cached_property
    def library(self) -> Tokenizer:
        library = Tokenizer.from_file(self.path)
        library.no_truncation()
        library.no_padding()
        return library

    def _whole(self, raw: bytes) -> np.ndarray:
        text = raw.decode()
        if self.merger is None or any(s in raw for s in self.specials):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype)
        return self.merger.encode_to_numpy(text, disallowed_special=()).astype(self.dtype)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        raw = [t.encode() for t in texts]
        out: list[np.ndarray] = [np.zeros(0, self.dtype)] * len(raw)
        group, held = [], 0
        for i, r in enumerate(raw):
            if not r:
                continue
            if self.merger is None or len(r) > CHUNK or any(s in r for s in self.specials):
                out[i] = self._whole(r)
                continue
            if held + len(r) > CHUNK:
                self._together(raw, group, out)
                group, held = [], 0
            group.append(i)
            held += len(r)
        if group:
            self._together(raw, group, out)
        return out

    def _together(self, raw: list[bytes], group: list[int], out: list[np.ndarray]) -> None:
        joined = b"".join([raw[i] for i in group])
        data = np.frombuffer(joined, np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(raw[i]) for i in group])])
        if not joined.isascii():
            foreign = _FOREIGN[data]
            # Two signs among the two-byte Latin letters, and what follows the last of them.
            foreign[:-1] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
            foreign[:-1] |= (data[:-1] == 0xC9) & (data[1:] >= 0x90)
            if foreign.any():
                odd = np.logical_or.reduceat(foreign, offsets[:-1])
                for i, o in zip(group, odd.tolist()):
                    if o:
                        out[i] = self._whole(raw[i])
                group = [i for i, o in zip(group, odd.tolist()) if not o]
                return self._together(raw, group, out) if group else None
        starts = starts_of(data, offsets)
        size = np.diff(starts, append=len(data))
        if self.pieces.n + len(starts) > KNOWN:
            self.pieces.clear()
        number = self._numbers(joined, data, starts, size)
        count = self.pieces.size.take(number)
        ends = np.cumsum(count, dtype=np.int64)
        place = np.repeat(self.pieces.start.take(number) - ends + count, count)
        place += np.arange(len(place))
        flat = self.pieces.ids.take(place)
        stop = np.concatenate([[0], ends])[np.searchsorted(starts, offsets)].tolist()
        for i, a, b in zip(group, stop, stop[1:]):
            out[i] = flat[a:b]

    def _numbers(self, joined: bytes, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The memo's number of each piece; new ones are learned."""
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _POWER[: len(data)], out=total[1:])
        key = (total.take(starts + size) - total.take(starts)) * _INVERSE.take(starts)
        key ^= key >> np.uint64(32)
        key = (key + size.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(29)
        padded = np.frombuffer(joined + bytes(8), np.uint8)
        words = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(data),), (1,))
        head = words[starts] & _MASK.take(size, mode="clip")
        number = self.pieces.find(key, head)
        new = np.flatnonzero(number == 0)
        if len(new):
            _, at, back = np.unique(key[new], return_index=True, return_inverse=True)
            at = new[at]
            ids, count = self._learn([joined[a : a + n] for a, n in zip(starts[at].tolist(), size[at].tolist())])
            number[new] = self.pieces.add(key[at], head[at], ids, count).astype(np.int32)[back]
        return number

    def _learn(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, end to end, and each one's number of ids. Pieces without white space, but for a blank in
        front, go into one text with line feeds between them: a line feed before a blank or another character is a
        piece and an id of its own, and no such piece holds one."""
        plain = [p for p in new if len(p.split()) == 1 and p[0] not in b"\t\n\v\f\r"]
        known: dict[bytes, np.ndarray] = {}
        if plain:
            ids = self.merger.encode_to_numpy(b"\n".join(plain).decode(), disallowed_special=()).astype(self.dtype)
            stop = np.flatnonzero(ids == self.feed).tolist()
            known = {p: ids[a + 1 : b] for p, a, b in zip(plain, [-1, *stop], [*stop, len(ids)], strict=True)}
        out = [known[p] if p in known else self._whole(p) for p in new]
        return np.concatenate(out), np.fromiter(map(len, out), np.int64, len(out))

@lru_cache(maxsize=2)
def byte_encoder(path: str) -> ByteEncoder:
    """The process's encoder for a file: it outlives a worker's tasks."""
    return ByteEncoder(path)
