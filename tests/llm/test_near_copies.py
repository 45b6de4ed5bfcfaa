"""The pipeline's near-dedup against exact similarities."""

import random

import corpus_pipeline
import numpy as np
import pytest

from cadastra.llm import nearcopies


def sets(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    a, b = sets(a), sets(b)
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("crowd", [8, 1])
def test_near_copies_go(spark, monkeypatch, crowd):
    """Copies with a few changed words, at 0.8 to 0.95 and just below 0.8, of 60 texts."""
    monkeypatch.setattr(nearcopies, "CROWD", crowd)
    r = random.Random(3)
    rows, near = [], {}
    for k in range(60):
        w = [f"w{r.randrange(5000)}" for _ in range(r.randrange(150, 400))]
        base = " ".join(w)
        rows.append((k, base))
        for j in range(3):
            v = list(w)
            for _ in range(r.randrange(1, 12)):
                v[r.randrange(len(v))] = f"x{r.randrange(10**6)}"
            rows.append((1000 + 10 * k + j, " ".join(v)))
            near[1000 + 10 * k + j] = similarity(base, " ".join(v))
    rows += [(5000, ""), (5001, None), (5002, "two words"), (5003, "Two  words"), (None, "two words"), (5002, "two words")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = [(x.doc_id, x.text) for x in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    ids = {i for i, _ in kept}
    assert set(range(60)) <= ids and {5000, 5002} <= ids and not {5001, 5003, None} & ids and len(kept) == len(ids)
    assert sum(0.8 <= x <= 0.95 for x in near.values()) > 40 and any(x < 0.8 for x in near.values())
    assert not {i for i, x in near.items() if x >= 0.8} & ids
    text = dict(rows)
    for i in set(near) - ids:
        assert any(similarity(text[i], text[j]) >= 0.8 for j in text if j is not None and j < i and j not in (5000, 5001) and text[j])


def test_texts_stay_where_no_language_can_be_learned(spark):
    docs = spark.createDataFrame([(1, "plain words here", None), (2, "12 34 !", None), (3, None, None)], "doc_id bigint, text string, lang string")
    assert [r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()] == [1]


@pytest.mark.parametrize("light", [16 << 20, 0])
def test_groups_of_any_size_and_a_common_passage(spark, monkeypatch, light):
    """120 near copies of one text, and 150 texts of their own that share a passage of two thirds of their length."""
    monkeypatch.setattr(nearcopies, "LIGHT", light)
    r = random.Random(5)
    word = lambda: f"w{r.randrange(10**6)}"
    base, passage = [word() for _ in range(200)], [word() for _ in range(120)]
    rows = [(0, " ".join(base))]
    for k in range(1, 121):
        v = list(base)
        for at in r.sample(range(200), 3):
            v[at] = word()
        rows.append((k, " ".join(v)))
    rows += [(1000 + k, " ".join([*passage, *(word() for _ in range(60))])) for k in range(150)]
    kept = {x.doc_id for x in nearcopies.first_of_near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    alike = {k for k in range(1, 121) if similarity(rows[0][1], rows[k][1]) >= 0.8}
    assert not kept & alike and len(alike) > 100
    assert {0, *range(1000, 1150)} <= kept


def test_masks_cover_the_radius_of_all_parts():
    """Fingerprints with up to PARTS * (NEAR + 1) - 1 other bits agree under a mask; few of those with a third do."""
    rng = np.random.default_rng(1)
    bits = nearcopies.PARTS * nearcopies.WIDTH

    def agree(count):
        one = rng.integers(0, 2, (300, 64 * nearcopies.WORDS), np.uint8)
        other = one.copy()
        for row in other:
            row[rng.choice(bits, count, replace=False)] ^= 1
        a, b = (nearcopies.covering_keys(np.packbits(x, axis=1).view(np.uint64)) for x in (one, other))
        return (a == b).any(axis=1).mean()

    assert agree(nearcopies.PARTS * (nearcopies.NEAR + 1) - 1) == 1
    assert agree(bits // 2) < 0.5


def plain_fingerprint(runs):
    """A loop over bits: that of most hashes, a second hash having a say of 4 to max(n, 8) in sets of up to 255; in
    balance, that of the least shingle in larger sets."""

    def bits(hashes):
        raw = [b"".join(int(x).to_bytes(8, "little") for x in h) for h in hashes]
        return [[byte >> 7 - k & 1 for byte in h for k in range(8)] for h in raw]

    n = len(runs)
    one = [nearcopies._mixed(r * nearcopies._TIMES + nearcopies._PLUS) for r in runs]
    first, second = bits(one), bits([nearcopies._mixed(h + nearcopies._PLUS) for h in one])
    out = []
    for x, y in zip(zip(*first), zip(*second)):
        total = 2 * sum(x) - n
        score = total * max(n, 8) + 4 * (2 * sum(y) - n) if n <= 255 else total or 2 * x[0] - 1
        out.append(int(score > 0))
    return out


@pytest.mark.parametrize("words", [1, 6, 9, 30, 700])
def test_fingerprint_by_a_loop_over_bits(words):
    runs = nearcopies.shingles(" ".join(f"w{k}" for k in range(words)).encode())
    assert np.unpackbits(nearcopies.fingerprint(runs).view(np.uint8)).tolist() == plain_fingerprint(runs)


@pytest.mark.parametrize("dense, at_once", [(32, 1 << 18), (32, 300), (0, 1 << 18)])
def test_buckets_are_spanned_as_by_a_loop_over_pairs(monkeypatch, dense, at_once):
    monkeypatch.setattr(nearcopies, "DENSE", dense)
    monkeypatch.setattr(nearcopies, "AT_ONCE", at_once)
    rng = np.random.default_rng(2)
    entries = np.zeros(900, nearcopies.ENTRY)
    entries["key"], entries["size"], entries["s"] = rng.integers(0, 4, 900), rng.integers(30, 60, 900), rng.permutation(900) - 450
    for i in range(900):  # chains, whose ends are far apart
        entries["fp"][i] = entries["fp"][i - 1] if i % 6 else rng.integers(0, 1 << 63, 3, np.uint64)
        for k in rng.integers(0, 192, 20):
            entries["fp"][i][k // 64] ^= np.uint64(1) << np.uint64(k % 64)
    names = list(range(900))
    for i in range(900):
        for j in range(i):
            x, y = entries[i], entries[j]
            far = np.bitwise_count(x["fp"] ^ y["fp"])
            fit = min(x["size"], y["size"]) >= 0.8 * max(x["size"], y["size"]) - 1e-6
            if x["key"] == y["key"] and fit and far[0] <= nearcopies.FIRST and far.sum() <= nearcopies.FAR:
                a, b = sorted((names[i], names[j]))
                names = [a if n == b else n for n in names]
    groups = {}
    for i, n in enumerate(names):
        groups.setdefault(n, []).append(int(entries["s"][i]))
    want = sorted((s, min(g)) for g in groups.values() for s in g if s != min(g))
    assert len(want) > 100 and [tuple(x) for x in nearcopies.spanning(entries).tolist()] == want


@pytest.mark.parametrize("words", [8, 9, 24, 84, 404])
def test_pairs_at_the_limit_link(words):
    """Pairs of sets with a similarity of 0.8 to 0.82, small and large: nearly every one agrees under a mask and is near enough."""
    r, missed = random.Random(words), 0
    for k in range(400):
        both = [nearcopies.shingles(" ".join(f"{k}.{j}.{r.random()}" for j in range(words)).encode())] * 2
        n = len(both[0])
        if n < 9:
            both[1] = both[0][: -(-4 * n // 5)]
        else:
            cut = n // 9
            fresh = nearcopies.shingles(" ".join(f"x{k}.{r.random()}" for _ in range(cut + 4)).encode())
            both[1] = np.unique(np.concatenate([both[0][cut:], fresh]))
        assert nearcopies.jaccard(*both) >= 0.8
        fps = np.array([nearcopies.fingerprint(x) for x in both])
        keys = nearcopies.covering_keys(fps)
        far = np.bitwise_count(fps[0, :3] ^ fps[1, :3])
        missed += not ((keys[0] == keys[1]).any() and far[0] <= nearcopies.FIRST and far.sum() <= nearcopies.FAR)
    assert missed == 0
