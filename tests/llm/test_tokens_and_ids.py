"""Token counts, id shards and packing against the tokenizers library itself."""

import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cadastra.llm.bytebpe import ByteEncoder
from cadastra.llm.packing import K1, NEIGHBOURS, B, Bm25, pack, plan
from cadastra.llm.repair import FLAT, LEAST, Block, compress, read_shards, token_ids, write_shards
from cadastra.llm.tokens import count_tokens
from cadastra.llm.wordbpe import LONG, WordCounter

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "  ", "\n", "a", " a", "a ", "Hello  World", "tab\there \n\n x", "it's we'll I'VE", "naïve Σίσυφος ΣΑΣ", "日本語 テスト",
    "İstanbul ß ﬁ ²½", "é ́x", "x<|endoftext|>y <|startoftext|>", "<|endoftext|>", "<|", "aaaaaaaaaa" * 9, "123 4567.89", "\x1c a\x1cb  z 　",
    "2×3 ÷ ɐ ɏ x¬y", "'s 'S ''s x'ved 'llama 'l 'r 're", "\n's \n 's  't", "it'sé don'té", "'", "a'", "'v", "x" * 200, "x'll", "x'l", "x're're",
    "emoji 👍🏽 x", "\r\n\r\nq", " \n y", "a \n  b", "!!!???", "don't<|endoftext|>", "​ zero", "café CAFÉ", "İ İ",
]
SCHEMA = "extra string, doc_id bigint, text string, n_chars bigint, text2 string"


def rows(texts):
    return [("e", i, t, 1, None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def byte():
    return Tokenizer.from_file(BYTE)


def ids(t, text):
    return t.encode(text, add_special_tokens=False).ids


def test_word_counts_of_odd_texts(word):
    got = WordCounter(WORD).count(ODD)
    assert got.tolist() == [len(ids(word, t)) for t in ODD]


def test_long_sequence_has_the_same_merges(word):
    rng = np.random.default_rng(5)
    text = ["".join(rng.choice(list("abcehinorst"), LONG + 500)), "a" * (LONG * 2 + 1), "abab" * LONG]
    assert WordCounter(WORD).count(text).tolist() == [len(ids(word, t)) for t in text]


def test_small_memo_gives_the_same_counts(word):
    texts = [f"w{i % 7}x{i} The {i}" for i in range(60)]
    counter = WordCounter(WORD, 8, 8)
    got = [n for lo in range(0, 60, 5) for n in counter.count(texts[lo : lo + 5])]
    assert got == [len(ids(word, t)) for t in texts]


@settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.one_of(st.characters(), st.sampled_from(" \n\t'sStTéß<|>endoftx0-")), max_size=40), max_size=6))
def test_any_text_is_encoded_as_the_library_does(word, byte, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert WordCounter(WORD).count(texts).tolist() == [len(ids(word, t)) for t in texts]
    got = ByteEncoder(BYTE).encode(texts)
    assert [b.tolist() for b in got] == [ids(byte, t) for t in texts]


def test_byte_ids_of_odd_texts(byte):
    encoder = ByteEncoder(BYTE)
    assert encoder.merger is not None
    want = [ids(byte, t) for t in ODD]
    assert [b.tolist() for b in encoder.encode(ODD)] == want
    encoder.merger = None  # as for a file that does more than merge bytes
    assert [b.tolist() for b in encoder.encode(ODD)] == want


def test_every_code_point_is_split_as_the_library_does(byte):
    encoder = ByteEncoder(BYTE)
    for lo in range(0, 0x110000, 1 << 14):
        texts = [f"a{c}1{c} {c}.{c}  {c}{c}'s{c}" for c in map(chr, range(lo, lo + (1 << 14))) if not "\ud800" <= c <= "\udfff"]
        want = byte.encode_batch_fast(texts, add_special_tokens=False)
        assert all(b.tolist() == w.ids for b, w in zip(encoder.encode(texts), want))


def test_files_that_do_more_than_merge_go_to_the_library():
    assert ByteEncoder(WORD).merger is None


def test_count_tokens_rows(spark, word):
    texts = [*ODD, None, "word " * 3000, "same", "same"]
    got = count_tokens(spark.createDataFrame(rows(texts), SCHEMA), WORD).collect()
    want = [(i, len((t or "").encode()), n := len(ids(word, t or "")), n > 2048) for i, t in enumerate(texts)]
    assert sorted(map(tuple, got)) == want
    assert count_tokens(spark.createDataFrame([], SCHEMA), WORD).count() == 0


def test_counts_of_the_table(spark, word):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in count_tokens(docs, WORD).collect()}
    assert got == {r.doc_id: (len(r.text.encode()), len(ids(word, r.text))) for r in docs.collect()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=60), min_size=1, max_size=8), st.integers(1, 30))
def test_grammar_round_trip(docs, times):
    docs = [d * times for d in docs]
    flat = np.array([x for d in docs for x in d], np.uint16)
    starts = np.cumsum([0, *map(len, docs)])[:-1]
    block = Block(compress(flat, starts, 4))
    assert [x.tolist() for x in block.docs()] == docs
    for i, d in enumerate(docs):
        assert block.doc(i).tolist() == d
        a, b = len(d) // 3, len(d) // 3 + len(d) // 2
        assert block.doc(i, a, b).tolist() == d[a:b]


def test_no_pair_that_pays_is_left():
    rng = np.random.default_rng(7)
    words = [rng.integers(0, 50, rng.integers(2, 9)) for _ in range(40)]
    docs = [np.concatenate([words[i] for i in rng.integers(0, 40, 60)]) for _ in range(12)] + [np.zeros(900, np.int64)]
    flat, size = np.concatenate(docs).astype(np.uint16), np.array(list(map(len, docs)))
    block = Block(compress(flat, np.cumsum(size) - size, 50))
    assert [x.tolist() for x in block.docs()] == [d.tolist() for d in docs]
    left = {}
    for i in range(len(docs)):  # a plain count of what the symbols still hold, every second place of aaa
        sym, last = block.sym.read(int(block.first[i]), int(block.first[i + 1])).tolist(), None
        for at, pair in enumerate(zip(sym, sym[1:])):
            if last != (at - 1, pair):
                left[pair] = left.get(pair, 0) + 1
                last = (at, pair)
    assert max(left.values(), default=0) < LEAST
    assert naive_repair([d.tolist() for d in docs]) >= 0.8 * (len(block.sym.low) + 2 * len(block.rules))


def naive_repair(docs):
    """Symbols and rules that Re-Pair leaves when it takes one most frequent pair at a time."""
    rules, fresh = 0, 50
    while True:
        count = {}
        for d in docs:
            i = 0
            for i in range(len(d) - 1):
                count.setdefault((d[i], d[i + 1]), []).append(i)
        pair = max(sorted(count), key=lambda p: len(count[p]), default=None)
        if pair is None or len(count[pair]) < LEAST:
            return sum(map(len, docs)) + 2 * rules
        used, out = 0, []
        for d in docs:
            new, i = [], 0
            while i < len(d):
                if tuple(d[i : i + 2]) == pair:
                    new.append(fresh)
                    used, i = used + 1, i + 2
                else:
                    new.append(d[i])
                    i += 1
            out.append(new)
        if used < LEAST:
            return sum(map(len, docs)) + 2 * rules
        docs, rules, fresh = out, rules + 1, fresh + 1


def test_long_expansions_are_unfolded():
    flat = np.tile(np.arange(3, dtype=np.uint16), 5000)
    block = Block(compress(flat, np.array([0]), 3))
    assert block.length.max() > FLAT
    assert block.doc(0).tolist() == flat.tolist()
    assert block.doc(0, 7001, 7020).tolist() == flat[7001:7020].tolist()


def test_grammar_compresses_repeats():
    flat = np.tile(np.arange(64, dtype=np.uint16), 400)
    raw = compress(flat, np.array([0]), 64)
    assert len(raw) < flat.nbytes // 4
    assert Block(raw).doc(0).tolist() == flat.tolist()


def expected_ids(byte, docs, end):
    start, out = 0, []
    for i, t in docs:
        x = np.array([*ids(byte, t or ""), end], "<u4")
        out.append((i, start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    return out


def test_token_ids_rows(spark, byte):
    texts = [*ODD, None, "word " * 3000, "same", "same"]
    docs = spark.createDataFrame(rows(texts), SCHEMA).repartition(5)
    assert sorted(map(tuple, token_ids(docs, BYTE).collect())) == expected_ids(byte, list(enumerate(texts)), 0)
    assert token_ids(spark.createDataFrame([], SCHEMA), BYTE).count() == 0


def test_token_ids_of_the_table(spark, byte):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    shards = write_shards(docs, BYTE)
    want = expected_ids(byte, sorted((r.doc_id, r.text) for r in docs.collect()), 0)
    assert sorted(map(tuple, read_shards(shards).collect())) == want
    assert sum(len(r.payload) for r in shards.collect()) < 2 * sum(n for _, _, n, _ in want)


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "b"), (3, "x y"), (3, "x y"), (3, "a"), (None, None)], "doc_id bigint, text string")
    got = token_ids(docs, BYTE).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 3, 3, 3]
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()


def check_pieces(byte, docs, pieces, window=2048):
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == {i for i, _ in docs}
    for i, t in docs:
        x = np.array([*ids(byte, t or ""), 1], "<u4")
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(x)
            assert p.ids_crc32 == zlib.crc32(x[at : at + p.length].tobytes())
            at += p.length
        assert at == len(x)
    padding = 0
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_pack_rows(spark, byte):
    texts = [*ODD, None, "word " * 5000, "same", "same"]
    pieces = pack(spark.createDataFrame(rows(texts), SCHEMA).repartition(3), BYTE).collect()
    assert check_pieces(byte, list(enumerate(texts)), pieces) == 0
    assert pack(spark.createDataFrame([], SCHEMA), BYTE).count() == 0


def test_pack_table(spark, byte):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert check_pieces(byte, [(r.doc_id, r.text) for r in docs.collect()], pack(docs, BYTE).collect()) == 0


def test_neighbours_are_lexical():
    from cadastra.llm.packing import Bm25

    docs = [np.array(x) for x in ([1, 2, 3, 9], [4, 5, 6, 9], [1, 2, 7, 9], [4, 5, 8, 9], [9])]
    index = Bm25(docs, 10)
    used = np.zeros(5, bool)
    used[0] = True
    assert index.neighbours(0, used)[0] == 2
    used[1] = True
    assert index.neighbours(1, used)[0] == 3


def test_repeated_ids_are_packed_as_documents_of_their_own(spark):
    got = pack(spark.createDataFrame([(7, "a b c"), (7, "a b c"), (None, "z")], "doc_id bigint, text string"), BYTE).collect()
    assert sum(p.length for p in got) == 4 + 4 + 2
    assert sorted({(p.sequence_id, p.offset + k) for p in got for k in range(p.length)}) == sorted((p.sequence_id, p.offset + k) for p in got for k in range(p.length))


@pytest.mark.parametrize("dense", [0.06, 2.0])
def test_neighbours_are_the_best_by_all_terms(monkeypatch, dense):
    from cadastra.llm import packing

    monkeypatch.setattr(packing, "DENSE", dense)
    r = np.random.default_rng(1)
    docs = [np.minimum(r.zipf(1.3, r.integers(30, 300)), 999) for _ in range(400)]
    index = packing.Bm25(docs, 1000)
    used = r.random(400) < 0.3
    for seed in range(40):
        mine = set(docs[seed].tolist())
        score = np.zeros(400)
        for d in range(400):
            at = slice(index.own[d], index.own[d + 1])
            score[d] = sum(float(w) for t, w in zip(index.term[at].tolist(), index.weight[at]) if t in mine)
        score[used] = 0
        got = index.neighbours(seed, used)
        assert len(got) == packing.NEIGHBOURS and not used[got].any()
        np.testing.assert_allclose(score[got], np.sort(score)[::-1][: packing.NEIGHBOURS], rtol=1e-4)


def naive_scores(docs, seed):
    """BM25 of every document for the distinct terms of one, from the formula."""
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    out = [0.0] * n
    for term in set(docs[seed]):
        df = sum(term in d for d in docs)
        idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
        for i, d in enumerate(docs):
            tf = d.count(term)
            out[i] += idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(d) / mean))
    return out


def naive_plan(docs, window):
    """Order of documents, step by step as packing states it: a seed's unused neighbours, best first, fill its window."""
    order, used, room, seed, queue = [], set(), window, None, []
    while len(used) < len(docs):
        queue = [i for i in queue if i not in used]
        if not queue and seed is not None and room < window:
            scores = naive_scores(docs, seed)
            queue = sorted((i for i in range(len(docs)) if i not in used and scores[i] > 0), key=lambda i: (-scores[i], i))[:NEIGHBOURS]
        if queue:
            doc = queue.pop(0)
        else:
            doc = seed = min(set(range(len(docs))) - used)
        if room == window:
            seed = doc
        order.append(doc)
        used.add(doc)
        left = len(docs[doc])
        if left < room:
            room -= left
        else:
            left -= room
            room = window - left % window
            seed, queue = doc, []
    return order


@pytest.mark.parametrize("seed", range(6))
def test_packing_follows_a_naive_bm25(seed):
    rng = np.random.default_rng(seed)
    docs = [(rng.integers(0, 12, rng.integers(3, 40)) + 25 * (i % 4) + rng.integers(0, 20)).tolist() for i in range(60)]
    index = Bm25([np.array(d, np.uint16) for d in docs], 200)
    used = rng.random(60) < 0.3
    for i in range(60):
        want, got = naive_scores(docs, i), index.neighbours(i, used)
        free = [j for j in range(60) if not used[j] and want[j] > 0]
        assert len(got) == min(NEIGHBOURS, len(free)) and set(got) <= set(free)
        scores = [want[j] for j in got]
        assert scores == pytest.approx(sorted(scores, reverse=True), abs=1e-4)
        assert all(want[j] <= scores[-1] + 1e-4 for j in set(free) - set(got))
    order = list(dict.fromkeys(p[0] for p in sorted(plan([np.array(d, np.uint16) for d in docs], 200, 64), key=lambda p: p[3:])))
    assert order == naive_plan(docs, 64)
