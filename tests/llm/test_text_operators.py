"""Decontamination, personal data, line dedup, SimHash, nearest neighbours, language and toxicity against plain loops."""

import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from cadastra.llm import decontam, hnsw, langid, linededup, pii, simhash, toxicity

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "extra string, doc_id bigint, text string, n_chars bigint, items string"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def frame(spark, texts):
    return spark.createDataFrame([("e", i, t, 1, None) for i, t in enumerate(texts)], SCHEMA)


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- decontamination


def leaks(docs, items):
    out = {}
    held = []
    for k, t in items:
        w = WORDS.findall(lower(t))
        n = min(10, len(w))
        held += [(k, tuple(w[i : i + n])) for i in range(len(w) - n + 1)] if n else []
    for i, t in docs:
        w = WORDS.findall(lower(t))
        hit, found = set(), set()
        where = {}
        for n in {len(x) for _, x in held}:
            for a in range(len(w) - n + 1):
                where.setdefault(tuple(w[a : a + n]), []).append(a)
        for k, x in held:
            for a in where.get(x, ()):
                hit.update(range(a, a + len(x)))
                found.add(k)
        out[i] = (len(w), len(hit), sorted(map(str, found)))
    return out


def found(spark, docs, items):
    return {r.doc_id: (r.n_words, r.n_hit, sorted(r["items"])) for r in decontam.find_leaks(docs, items).collect()}


def test_leaks_of_the_table(spark):
    docs, items = table(spark, "documents", "/root/testdata/sf0.01"), table(spark, "benchmark", "/root/testdata/sf0.01")
    want = leaks([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert any(h for _, h, _ in want.values())
    assert found(spark, docs, items) == want


EDGE = ["", None, "one", "ONE two, three", "é日本 one-two", "a b c d e f g h i j k l", "x " * 50, "zero a b c d e f g h i", "pneumonoultramicroscopicsilicovolcanoconiosis" * 2 + " end", "j one two\x7fthree 9"]
ITEMS = [(1, "one two"), (2, "a b c d e f g h i j k"), (3, ""), (4, None), (5, "x x x x x x x x x x x"), (6, "É"), (7, "é日本"), (2, "one two"), (None, "zero"), (8, "pneumonoultramicroscopicsilicovolcanoconiosis" * 2)]


def test_leaks_of_odd_texts(spark):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    want = leaks(list(enumerate(EDGE)), [x for x in ITEMS if x[0] is not None])
    assert found(spark, frame(spark, EDGE), items) == want
    assert found(spark, frame(spark, []), items) == {}
    assert all(h == 0 for _, h, _ in found(spark, frame(spark, EDGE), items.limit(0)).values())


def test_leaks_in_parts_are_the_same(spark, monkeypatch):
    monkeypatch.setattr(decontam, "PART_BYTES", 32)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert found(spark, frame(spark, EDGE), items) == leaks(list(enumerate(EDGE)), [x for x in ITEMS if x[0] is not None])
    kept = decontam.remove_leaks(frame(spark, EDGE), items)
    assert kept.columns == frame(spark, EDGE).columns


def test_leaks_are_removed(spark):
    item = " ".join(f"q{i}" for i in range(12))
    docs = frame(spark, [f"start, {item}! " + "clean words stand here " * 9, item, "clean", None, ""])
    got = {r.doc_id: (r.text, r.n_chars) for r in decontam.remove_leaks(docs, spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()}
    text = "start, ! " + "clean words stand here " * 9
    assert got == {0: (text, len(text)), 2: ("clean", 5), 3: (None, 0), 4: ("", 0)}


# --- personal data


def base_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


PRIVATE = [
    "a@b.c@d.e x.y+z%1@mail-1.example.co.uk.", "@a.b a@b a@.b a@b..c a@b.c.", "1.2.3.4.5 256.1.1.1 001.002.3.4 1.2.3 1.2.3.4", "12.34.56.78.90.12.34.56",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112, 4111  1111", "0000000000000", "+1 (499) 555-6503 +49.30.1234567 +1-2 +123456789012345678 ++44 20 7946 0958((", "IBAN GB82 WEST 1234 5698 7654 32 THE",
    "DE89370400440532013000 DE89370400440532013001", "my social security number is 123-45-6789", "no context 123-45-6789 here", "é@ü.de ünï@code.org", "9" * 5000, "a" * 5000 + "@", "+1" + "(" * 3000, "1.1.1." * 999,
]


def test_base_spans_are_those_of_the_plain_patterns():
    for t in PRIVATE:
        assert [s[:3] for s in pii.find_spans(t) if s[0] in pii.KINDS[:4]] == base_spans(t), t[:80]


def test_added_kinds():
    kinds = lambda t: [s[0] for s in pii.find_spans(t) if s[0] in ("iban", "ssn")]
    assert kinds(PRIVATE[7]) == ["iban"] and kinds(PRIVATE[8]) == ["iban"]
    assert kinds(PRIVATE[9]) == ["ssn"] and kinds(PRIVATE[10]) == []
    assert pii.masked("mail a@b.org now", pii.find_spans("mail a@b.org now")) == "mail <email> now"
    near, far = pii.find_spans("call +1 499 555 6503")[0], pii.find_spans("zzzz +1 499 555 6503")[0]
    assert near[3] > far[3]


def test_personal_data_rows(spark):
    texts = [*PRIVATE, None, "", PRIVATE[0]]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, spans string")
    got = {r.doc_id: r for r in pii.find_personal_data(docs, with_masked=True).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS[:4]] == [sum(s[0] == k for s in want) for k in pii.KINDS[:4]]
    assert pii.find_personal_data(docs.limit(0)).count() == 0


def test_personal_data_of_the_table(spark):
    docs = table(spark, "documents", "/root/testdata/sf0.01").collect()
    for r in docs:
        assert [s[:3] for s in pii.find_spans(r.text) if s[0] in pii.KINDS[:4]] == base_spans(r.text)


# --- line dedup


PASSAGE = "the old mill by the river stands where seven roads meet and nobody asks why"


def test_recurring_lines_go(spark):
    texts = [
        f"own words of the first text\n{PASSAGE}\nmore of it here again", f"second text has other words\n{PASSAGE}", None, "", "single", "a line on its own stands here\nOf.",
        "user 17 logged in from host 4 at noon sharp today", "user 99 logged in from host 8 at noon sharp today", f"{PASSAGE}\nOf.\nsomething else entirely stands here", f"{PASSAGE}\nOf.\nand yet another line of words",
        "the brown fox jumps over some lazy dog near our big farm", "the brown fox jumps over some lazy dog near our red barn",
    ]
    got = {r.doc_id: r for r in linededup.drop_recurring_lines(frame(spark, texts)).collect()}
    assert got[0].text == texts[0] and got[0].n_recurring == 1 and got[0].n_dropped == 0
    assert got[1].text == "second text has other words" and got[1].n_chars == len(got[1].text)
    assert got[2].text is None and got[2].n_lines == 0 and got[3].text == "" and got[4].text == "single"
    assert got[5].text == texts[5]
    assert got[6].n_dropped == 0 and got[7].text == ""
    assert got[8].text == "Of.\nsomething else entirely stands here" and got[9].text == "and yet another line of words"
    assert got[10].n_dropped == 0 and got[11].text == ""
    every = {r.doc_id: r for r in linededup.drop_recurring_lines(frame(spark, texts), keep_first=False).collect()}
    assert every[0].n_dropped == 1 and PASSAGE not in every[0].text
    assert linededup.drop_recurring_lines(frame(spark, [])).count() == 0


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, PASSAGE), (1, PASSAGE), (None, PASSAGE), (None, "clean words of its own here")]
    got = linededup.drop_recurring_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id is None, r.text) for r in got) == [(False, PASSAGE), (False, PASSAGE), (True, ""), (True, "clean words of its own here")]


def test_clashing_columns_stay(spark):
    rows = [(1, PASSAGE, 5, 6, 7, 8), (2, PASSAGE, 5, 6, 7, 8), (3, "quite another text of words", 5, 6, 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, __own0 int, doc int, n_lines int, first int")
    out = linededup.drop_recurring_lines(docs)
    assert out.columns == ["doc_id", "text", "__own0", "doc", "first", "n_lines", "n_recurring", "n_dropped"]
    assert {tuple(r)[2:5] for r in out.collect()} == {(5, 6, 8)}
    kept = simhash.first_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
    items = spark.createDataFrame([(1, "something else")], "item_id bigint, text string")
    assert sorted(map(tuple, decontam.remove_leaks(docs, items).collect())) == rows
    assert langid.keep_known(docs.withColumn("lang", docs["text"]), 0.0).columns == [*docs.columns, "lang"]


def plain_keys(text):
    """(line number, templates) by the rules in the docstrings, on strings."""
    lines = []
    for i, line in enumerate(text.split("\n")):
        line = re.sub("([\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff])", r" \1 ", line)
        if tokens := re.findall(r"[^\x09-\x0d\x20]+", line):
            lines.append((i, tokens))
    out = []
    for at, (i, tokens) in enumerate(lines):
        if len(tokens) < 3:
            keys = [("before", tuple(lines[at - 1][1]), tuple(tokens))] * (at > 0)
            keys += [("after", tuple(tokens), tuple(lines[at + 1][1]))] if at + 1 < len(lines) else []
        else:
            masked = ["*" if re.search("[0-9]", t) else t for t in tokens]
            rest, keys = masked[2:], [("whole", *masked)]
            for v in range(4) if len(masked) >= 6 else ():
                a, b = len(rest) * v // 5, len(rest) * (v + 2) // 5
                if a < b:
                    keys.append((v, len(masked), *masked[:2], tuple(rest[:a]), tuple(rest[b:])))
        out.append((i, keys))
    return out


def plain_dedup(docs):
    """Texts without the lines that have a template in an earlier document."""
    first = {}
    for i, t in sorted(docs):
        for _, keys in plain_keys(t):
            for k in keys:
                first.setdefault(k, i)
    out = {}
    for i, t in docs:
        gone = {n for n, keys in plain_keys(t) if any(first[k] != i for k in keys)}
        out[i] = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone)
    return out


def test_lines_against_a_loop(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, "documents").collect()]
    got = {r.doc_id: r.text for r in linededup.drop_recurring_lines(table(spark, "documents")).collect()}
    assert got == plain_dedup(docs)


def test_variable_words_and_short_lines(spark):
    texts = [
        "the sum paid to John Smith was nine pounds\nown line of the first one", "the sum paid to Anna Jones was nine pounds\nother words stand here now",
        "Posted by John in General News\nAll rights reserved.", "Posted by Anna in General News\nsome text between\nAll rights reserved.",
        "milk\nred wine\nbread\nsalt", "my list\nmilk\nred wine\nbread\nsalt\nthe end of it", "yes\nI think so too", "yes\nno it is not",
        "昔々ある所にお爺さんがいました", "別の話\n昔々ある所にお婆さんがいました", "a\u00a0b c\u0085d", "1 \u0661 x\n\n \t\n", "2 \u0662 x", "\r\n\x0b\n", "it is a long time now", "it is a short time then",
        "word " * 30000 + "\n" + "line of text here\n" * 20000, "line of text here",
    ]
    got = {r.doc_id: r.text for r in linededup.drop_recurring_lines(frame(spark, texts)).collect()}
    assert got == plain_dedup(list(enumerate(texts)))
    assert got[1] == "other words stand here now" and got[3] == "some text between" and got[5] == "my list\nthe end of it"
    assert got[7] == texts[7] and got[9] == "別の話" and got[15] == texts[15] and got[17] == ""


def test_hot_lines_go_by_broadcast(spark, monkeypatch):
    texts = [f"{PASSAGE}\nown words of text number {chr(97 + i % 26)}{chr(97 + i // 26)} alone" for i in range(80)]
    want = plain_dedup(list(enumerate(texts)))
    for hot in (1, 4096):  # none is hot, then all that recur are
        monkeypatch.setattr(linededup, "HOT", hot)
        assert {r.doc_id: r.text for r in linededup.drop_recurring_lines(frame(spark, texts)).collect()} == want


# --- SimHash


def plain_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    if not w:
        return 0
    h = [xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps):
    """Smallest place reachable over links of at most three bits, by a loop over all pairs."""
    v = np.array(fps, np.uint64)
    root = list(range(len(v)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v[i + 1 :] ^ v[i]) <= 3) + i + 1:
            a, b = sorted((top(i), top(j)))
            root[b] = a
    return [top(i) for i in range(len(v))]


def test_simhash_of_the_table(spark):
    docs = table(spark, "documents", "/root/testdata/sf0.01")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    fps = [plain_fingerprint(t) for _, t in rows]
    want = {i: (f"{fp:016x}", rows[c][0]) for (i, _), fp, c in zip(rows, fps, classes(fps))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()} == want


def test_simhash_of_odd_texts(spark):
    texts = ["", None, " \t\n", "one", "One", "one two", "a b c", "A  b\tc", "x " * 40, "é b c d", "w" * 9000 + " v u", "a\x1cb c d"]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    assert got == {i: (f"{fp:016x}", c) for i, (fp, c) in enumerate(zip(fps, classes(fps)))}
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    nulls = simhash.near_duplicates(spark.createDataFrame([(None, "a b c"), (5, "a b c"), (None, "z")], "doc_id bigint, text string")).collect()
    assert sorted(str(r.component_id) for r in nulls) == ["5", "5", "None"]


@pytest.mark.parametrize("bucket", [8192, 2])
def test_links_of_chains_and_crowds(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = np.random.default_rng(3)
    fps = [int(x) for x in rng.integers(0, 2**63, 60)]
    for _ in range(300):
        x = fps[int(rng.integers(0, len(fps)))]
        for b in rng.choice(64, int(rng.integers(1, 5)), replace=False):
            x ^= 1 << int(b)
        fps.append(x)
    fps = sorted(set(fps))
    frame = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp bigint")
    roots = {r.node: r.root for r in simhash.components(simhash.links(frame)).collect()}
    groups, want = {}, {}
    for i, (x, c) in enumerate(zip(fps, classes(fps))):
        groups.setdefault(roots.get(simhash.signed(x), simhash.signed(x)), []).append(i)
        want.setdefault(c, []).append(i)
    assert sorted(groups.values()) == sorted(want.values())


def test_long_text_in_blocks(monkeypatch):
    text = " ".join(f"w{i * i % 977}" for i in range(700))
    want = plain_fingerprint(text)
    monkeypatch.setattr(simhash, "SHINGLES", 37)
    assert simhash.fingerprint(text.encode()) == want


def test_one_of_each_group_stays(spark):
    rows = [(5, "a b c d"), (2, "a b c d"), (2, "a b c d"), (9, "quite another text"), (None, "a b c d")]
    got = simhash.first_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(2, "a b c d"), (9, "quite another text")]


# --- nearest neighbours


def exact(rows, queries, k):
    out = {}
    for q, v in queries:
        v = np.array(v, np.float64)
        best = sorted((-(np.dot(v, w) / np.sqrt(np.dot(v, v)) / np.sqrt(np.dot(w, w))), i) for i, w in rows if i != q)
        out[q] = [(i, -s) for s, i in best[:k]]
    return out


def test_recall_and_scores(spark):
    data = table(spark, "embeddings", "/root/testdata/sf0.1")
    rows = [(r.vec_id, np.array(r.embedding, np.float64)) for r in data.collect()]
    by = dict(rows)
    queries = [(i, v) for i, v in rows if i % 50 == 0]
    want = exact(rows, queries, 5)
    got = {}
    for r in hnsw.nearest(data, data.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append(r)
        v, w = by[r.query_id], by[r.vec_id]
        assert abs(r.score - v @ w / np.sqrt(v @ v) / np.sqrt(w @ w)) < 1e-12
    assert set(got) == set(want)
    hits = sum(len({r.vec_id for r in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.95
    for rs in got.values():
        rs.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rs] == [1, 2, 3, 4, 5]
        assert [(-r.score, r.vec_id) for r in rs] == sorted((-r.score, r.vec_id) for r in rs)


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, [1.0, 0.0, 0.0]), (8, []), (None, [1.0, 0.0]), (9, [1e-300, 1e-300]), (10, [1.0, 0.0]), (11, [1.0, 0.0]), (1, [1.0, 0.1])]
    rows += [(i, [1.0, 0.0]) for i in range(20, 40)]
    data = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<double>, score string")
    got = {}
    for r in hnsw.nearest(data, data.where("vec_id < 10")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {0: [10, 11, 20, 21, 22], 1: [0, 10, 11, 20, 21], 9: [1, 0, 10, 11, 20]}
    assert hnsw.nearest(data.limit(0), data).count() == 0


def brute_nearest(rows, query, k=5):
    """(-score, id) of the k nearest by double cosine, ties to smaller ids."""
    q = dict(rows)[query]
    found = [(-float(hnsw.cosine(q, v)), i) for i, v in rows if i != query]
    return sorted(found)[:k]


def test_multiples_of_a_vector_tie_by_id(spark):
    rng = np.random.default_rng(3)
    base, ids = rng.normal(size=16), rng.permutation(700).tolist()
    rows = [(ids[i], base * 2.0 ** (i - 150)) for i in range(300)] + [(ids[i], rng.normal(size=16)) for i in range(300, 700)]
    data = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id bigint, embedding array<double>")
    queries = sorted([ids[0], ids[7], ids[299]])
    got = hnsw.nearest(data, data.where(F.col("vec_id").isin(queries))).orderBy("query_id", "rank").collect()
    for q in queries:
        assert [r.vec_id for r in got if r.query_id == q] == [i for _, i in brute_nearest(rows, q)]


def test_recall_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD", 400)
    data = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    index = hnsw.build_index(data, 5)
    assert index.count() >= 4
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in data.collect()]
    got = {}
    for r in hnsw.search_index(index, data.where("vec_id % 50 = 0"), 5).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    x, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q, found in got.items():
        like = u @ u[ids == q][0]
        like[ids == q] = -2
        hits += len(set(found) & set(ids[np.argsort(-like)[:5]].tolist()))
    assert len(got) == sum(i % 50 == 0 for i in ids.tolist()) and hits >= 0.95 * 5 * len(got)


def test_inserted_links_lead_everywhere():
    rng = np.random.default_rng(11)
    x = hnsw.unit(np.repeat(rng.normal(size=(40, 12)), 30, axis=0) + 0.05 * rng.normal(size=(1200, 12))).astype(np.float32)
    graph = hnsw.Graph.build(x, np.arange(1200))
    for members, links in graph.layers:
        assert ((links >= -1) & (links < len(members))).all()
        assert all(len(set(r[r >= 0])) == (r >= 0).sum() and i not in r for i, r in enumerate(links))
    near = graph.search(x[::10], 5)
    true = np.argsort(-(x[::10] @ x.T), axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(near.tolist(), true.tolist())]) >= 4.75


# --- language


def test_language_is_learned_and_held_out_rows_are_predicted(spark):
    docs = table(spark, "documents", "/root/testdata/sf0.01")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    rows = docs.collect()
    import zlib

    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    out = [got[r.doc_id].lang_pred == r.lang for r in rows if got[r.doc_id].held_out]
    assert sum(out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_odd_texts_have_no_language(spark):
    docs = spark.createDataFrame([(3, None, "en"), (4, "", "en"), (5, "12 !?", "en"), (6, "the word of the day is good", "en"), (6, "the word of the day is good", None), (None, "le mot du jour est bon", "fr")], "doc_id bigint, text string, lang string")
    got = [(r.doc_id, r.lang_pred) for r in langid.identify(docs).collect()]
    assert [x for x in got if x[0] in (3, 4, 5)] == [(3, "und"), (4, "und"), (5, "und")]
    assert len(got) == 6 and len({y for x, y in got if x == 6}) == 1
    assert langid.identify(docs.limit(0)).count() == 0
    kept = langid.keep_known(docs, 0.0)
    assert kept.columns == docs.columns and all(r.text and any(c.isalpha() for c in r.text) for r in kept.collect())


def test_other_languages_go_and_null_lang_is_filled(spark):
    docs = table(spark, "documents", "/root/testdata/sf0.01").select("doc_id", "text", "lang")
    mixed = [r.text for r in docs.where("lang in ('en', 'fr') and length(text) > 400").orderBy("doc_id").limit(40).collect()]
    odd = [(10**6, "привет мир это русский текст о погоде", "ru?"), (10**6 + 1, "½ ² ① 12", None), (10**6 + 2, "λόγος και πράξη στην πόλη", None)]
    odd += [(10**6 + 10 + i, " ".join([*a.split()[:40], *b.split()[:40]]), None) for i, (a, b) in enumerate(zip(mixed[::2], mixed[1::2]))]
    rows = docs.union(spark.createDataFrame([(i, t, None) for i, t, _ in odd], docs.schema))
    kept = {r.doc_id: r.lang for r in langid.keep_known(rows, 0.6).collect()}
    assert not {10**6, 10**6 + 1, 10**6 + 2} & set(kept)
    assert all(kept.get(i) in ("en", "fr", "de", "es") for i, _, _ in odd[3:])
    assert {r.doc_id for r in docs.where("text rlike '[a-z]'").collect()} <= set(kept)
    got = {r.doc_id: r.lang_pred for r in langid.identify(rows).collect()}
    assert got[10**6 + 1] == "und"


def test_marginals_are_those_of_all_paths():
    from itertools import product

    rng = np.random.default_rng(0)
    crf = langid.Crf(["a", "b", "c"])
    crf.move, crf.begin = rng.normal(size=(3, 3)).astype(np.float32), rng.normal(size=3).astype(np.float32)
    score = rng.normal(size=(2, 4, 3)).astype(np.float32)
    valid = np.array([[1, 1, 1, 1], [1, 1, 0, 0]], bool)
    post, _ = crf.marginals(score, valid)
    for i, n in enumerate((4, 2)):
        total = np.zeros((n, 3))
        for path in product(range(3), repeat=n):
            w = np.exp(crf.begin[path[0]] + sum(score[i, t, y] for t, y in enumerate(path)) + sum(crf.move[a, b] for a, b in zip(path, path[1:])))
            for t, y in enumerate(path):
                total[t, y] += w
        assert np.allclose(post[i, :n], total / total.sum(axis=1, keepdims=True), atol=1e-5)


def test_words_of_two_languages():
    crf = langid.Crf(["de", "en"])
    chains = [("der hund und die katze sind nicht hier".split(), [0] * 8), ("the dog and the cat are not here".split(), [1] * 8), ("der hund und die katze the dog and".split(), [0] * 5 + [1] * 3)] * 20
    crf.fit(chains)
    assert [y for _, y in langid.label_words(crf, "die katze und der hund the cat and the dog")] == ["de"] * 5 + ["en"] * 5


# --- toxicity


def test_toxic_documents_stand_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, "documents", sf), table(spark, "labels", sf)
    got = {r.doc_id: r for r in toxicity.grade_toxicity(docs, labels).collect()}
    rows = labels.collect()
    bad, good = [got[r.doc_id].toxic for r in rows if r.toxic], [got[r.doc_id].toxic for r in rows if not r.toxic]
    assert sum(bad) / len(bad) > 0.95 and sum(good) / len(good) < 0.01
    assert all(0 <= r.severity <= 2 for r in got.values())
    assert {r.grade for r in got.values()} == {0, 1, 2}


def test_odd_toxicity_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a fool"), (None, "x"), (3, "a fool")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1, 1), (3, 0, 1), (None, 1, 1), (2, 0, None)], "doc_id bigint, quality int, toxic int")
    got = toxicity.grade_toxicity(docs, labels).collect()
    assert len(got) == 5 and all(r.severity == 0 for r in got)
    assert toxicity.grade_toxicity(docs.limit(0), labels).count() == 0


def test_cuts_are_ordered_and_likelihood_is_right():
    docs = [["bad", "worse"], ["bad"], ["good"], ["good", "day"]] * 10
    m = toxicity.Ordinal.fit(docs, [2, 1, 0, 0] * 10, 3)
    assert (np.diff(m.cuts) > 0).all()
    z = np.array([m.weight[[m.vocabulary[w] for w in d]].sum() for d in docs[:4]])
    assert (m.above(z).sum(axis=1).round().astype(int) == [2, 1, 0, 0]).all()


def test_held_out_toxicity(spark):
    """Fitted on two thirds of the labels, judged on the rest."""
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, "documents", sf), table(spark, "labels", sf)
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    model = toxicity.train(docs, labels.where(fold != 0))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    rows = [r for r in labels.where(fold == 0).collect() if r.doc_id in got]
    bad, good = [got[r.doc_id].p_toxic for r in rows if r.toxic], [got[r.doc_id].p_toxic for r in rows if not r.toxic]
    assert len(bad) > 20 and np.mean(np.array(bad) >= 0.5) > 0.85 and np.mean(np.array(good) >= 0.5) < 0.01
    loss = -np.mean([np.log(np.clip(p, 1e-6, 1)) for p in bad]) / 2 - np.mean([np.log(np.clip(1 - p, 1e-6, 1)) for p in good]) / 2
    assert loss < 0.25  # 0.69 is a coin's


def test_fit_is_the_most_likely_model():
    """No change of a weight or a cut makes the grades, each counted alike, more likely under the decay."""
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(6)]
    docs = [[w for w in words if rng.random() < 0.5] for _ in range(240)]
    grades = [int(np.clip(sum(w in ("w0", "w1") for w in d) + (rng.random() < 0.2), 0, 2)) for d in docs]
    m = toxicity.Ordinal.fit(docs, grades, 3)

    def value(weight, cuts):
        total, each = 0.0, [grades.count(g) for g in range(3)]
        for d, g in zip(docs, grades):
            z = sum(weight[m.vocabulary[w]] for w in d if w in m.vocabulary)
            above = [1.0, *(1 / (1 + np.exp(c - z)) for c in cuts), 0.0]
            total += np.log(above[g] - above[g + 1]) / each[g] / 3
        return total - toxicity.DECAY / 2 * float(weight @ weight)

    best = value(m.weight, m.cuts)
    for k in range(len(m.weight)):
        for step in (-0.5, 0.5):
            assert value(m.weight + step * np.eye(len(m.weight))[k], m.cuts) < best
    for k in range(2):
        for step in (-0.4, 0.4):
            assert value(m.weight, m.cuts + step * np.eye(2)[k]) < best


def test_odd_documents_for_every_operator(spark):
    """Ties, long texts and columns with the operators' own names."""
    own = ["severity", "grade", "p_toxic", "toxic", "n_tokens", "over_limit", "lang_pred", "score", "held_out", "found", "spans", "start", "length"]
    texts = ["fool and liar " * 20000, "a b c", "a b c", None, ""]
    docs = spark.createDataFrame([(i, t, "en", *range(len(own))) for i, t in enumerate(texts)] + [(1, "a b c", "en", *range(len(own)))], "doc_id bigint, text string, lang string, " + ", ".join(f"{c} int" for c in own))
    labels = spark.createDataFrame([(0, 1, 1), (1, 0, 1)], "doc_id bigint, toxic int, grade int")
    from cadastra.llm.packing import pack
    from cadastra.llm.repair import token_ids
    from cadastra.llm.tokens import count_tokens

    word, byte = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
    frames = [toxicity.grade_toxicity(docs, labels), count_tokens(docs, word), token_ids(docs, byte), pii.find_personal_data(docs), langid.identify(docs), simhash.near_duplicates(docs)]
    for f in frames:
        got = sorted(r.doc_id for r in f.collect())
        assert got == [0, 1, 1, 2, 3, 4], f.columns
    assert {r.doc_id for r in pack(docs, byte).collect()} == {0, 1, 2, 3, 4}
