"""Severity of toxicity by cumulative-link ordinal regression on sparse words (operator 2)."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.llm.common import batches, bound_batches, narrow, texts

#: The model is fitted on at most so many labelled documents of each label, chosen by hash, with at most so many
#: distinct words each: some 140 MB of words at most reach the driver.
DOCS, DOC_WORDS = 4000, 2000
#: Words enter the model from so many documents on, and from a difference of so many standard errors on.
LEAST_DOCS, LEAST_Z = 5, 2.5
STEPS, RATE, DECAY = 150, 0.1, 2e-4
MEMORY, LONGEST = 300_000, 256
WORD = re.compile(r"[^\W\d_]+")


def words_of(chunk: str) -> tuple[str, ...]:
    """A chunk's runs of letters, lower case."""
    low = chunk.lower()
    return (low,) if low.isalpha() else tuple(WORD.findall(low))


def words_in(text: str) -> set[str]:
    return {w for c in set(text.split()) for w in words_of(c)}


def telling_words(docs: list[list[str]], marked: list[bool]) -> list[str]:
    """Words in LEAST_DOCS documents or more whose shares of marked and of other documents differ by LEAST_Z standard
    errors or more. The many words that tell nothing would outweigh the few that do in long documents."""
    count = [Counter(w for d, m in zip(docs, marked) if m == side for w in d) for side in (True, False)]
    n = [max(1, sum(marked)), max(1, len(marked) - sum(marked))]
    words = sorted(w for w in set(count[0]) | set(count[1]) if count[0][w] + count[1][w] >= LEAST_DOCS)
    a, b = (np.array([c[w] for w in words], float) for c in count)
    p = (a + b) / sum(n)
    error = np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n[0] + 1 / n[1]))
    return [w for w, z in zip(words, np.abs(a / n[0] - b / n[1]) / error) if z >= LEAST_Z]


class Ordinal:
    """P(grade > j) = sigmoid(w.x - cut[j]) with one weight vector and ascending cuts."""

    def __init__(self, vocabulary: dict[str, int], weight: np.ndarray, cuts: np.ndarray):
        self.vocabulary, self.weight, self.cuts = vocabulary, weight, cuts

    def above(self, activation: np.ndarray) -> np.ndarray:
        """P(grade > j) for each cut j."""
        return 1 / (1 + np.exp(-np.clip(activation[:, None] - self.cuts, -50, 50)))

    @classmethod
    def fit(cls, docs: list[list[str]], grades: list[int], levels: int) -> Ordinal:
        """Maximum likelihood (Adam) with decay; x holds a 1 for each word of the vocabulary that a document has: of the
        words whose share of documents differs between grade 0 and the others by more than chance."""
        kept = telling_words(docs, [g > 0 for g in grades])
        vocabulary = {w: i for i, w in enumerate(kept)}
        at = [[vocabulary[w] for w in d if w in vocabulary] for d in docs]
        index = np.array([i for a in at for i in a], np.int64)
        row = np.repeat(np.arange(len(at)), [len(a) for a in at])
        y = np.array(grades)
        share = np.array([(y > j).mean() for j in range(levels - 1)]).clip(1e-3, 1 - 1e-3)
        first = -np.log(share / (1 - share))
        # The first cut is free; the later ones lie above it by exponentials, so the order holds.
        free = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 0.1))])
        weight = np.zeros(len(kept))
        scale = 1 / np.bincount(y, minlength=levels).clip(1)[y]
        scale *= len(y) / scale.sum() / len(y)
        held = [(weight, np.zeros_like(weight), np.zeros_like(weight)), (free, np.zeros_like(free), np.zeros_like(free))]
        for step in range(1, STEPS + 1):
            cuts = np.concatenate([free[:1], free[:1] + np.cumsum(np.exp(free[1:]))])
            z = np.bincount(row, weight[index], len(y)) if len(index) else np.zeros(len(y))
            s = np.pad(1 / (1 + np.exp(-np.clip(z[:, None] - cuts, -50, 50))), ((0, 0), (1, 1)), constant_values=((0, 0), (1, 0)))
            hi, lo = s[np.arange(len(y)), y], s[np.arange(len(y)), y + 1]
            p = np.maximum(hi - lo, 1e-12)
            d_hi, d_lo = hi * (1 - hi), lo * (1 - lo)
            dz = scale * (d_hi - d_lo) / p
            d_cut = np.zeros((len(y), levels + 1))
            d_cut[np.arange(len(y)), y] -= scale * d_hi / p
            d_cut[np.arange(len(y)), y + 1] += scale * d_lo / p
            g_cut = d_cut[:, 1:levels].sum(axis=0)
            g_free = np.concatenate([[g_cut.sum()], [g_cut[j:].sum() * np.exp(free[j]) for j in range(1, levels - 1)]])
            g_weight = (np.bincount(index, dz[row], len(weight)) if len(index) else weight * 0) - DECAY * weight
            for (x, m, v), g in zip(held, (g_weight, g_free)):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return cls(vocabulary, weight, np.concatenate([free[:1], free[:1] + np.cumsum(np.exp(free[1:]))]))


def severity_grades(docs: list[list[str]], toxic: list[bool]) -> list[int]:
    """Grades 0 (clean), 1 (mild), 2 (severe) from a yes-or-no label. How plainly a document is toxic is told by a
    scorer that hasn't seen it: each half of the documents is scored by a two-grade model of the other half, and the
    toxic ones above the median toxic score of their half are severe. Without toxic and clean ones in both halves, or
    with equal scores, none is severe."""
    out = [int(t) for t in toxic]
    halves = [range(h, len(docs), 2) for h in (0, 1)]
    for own, other in (halves, halves[::-1]):
        known = [toxic[i] for i in other]
        bad = [i for i in own if toxic[i]]
        if not bad or not any(known) or all(known):
            return [int(t) for t in toxic]
        scorer = Ordinal.fit([docs[i] for i in other], [int(t) for t in known], 2)
        z = {i: sum(scorer.weight[scorer.vocabulary[w]] for w in docs[i] if w in scorer.vocabulary) for i in bad}
        middle = sorted(z.values())[len(z) // 2]
        for i in bad:
            out[i] += z[i] > middle
    return out


def train(docs: DataFrame, labels: DataFrame, docs_limit: int = DOCS) -> Ordinal | None:
    """A model from labelled documents: of docs(doc_id, text) joined with labels(doc_id, toxic), about docs_limit of
    either label, those of the least hash, each with at most DOC_WORDS of its distinct words (by hash), reach the
    driver. Several labels of a document count by their greatest, several texts of an id by that of the least hash, so
    that the sample is the same in each run. None if either label is missing."""
    one = narrow(labels, {"doc_id": "bigint", "toxic": "int"}).where("doc_id is not null and toxic is not null")
    one = one.groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    part = F.xxhash64("doc_id", F.lit("severity"))
    least = [one.where(F.col("toxic") == t).orderBy(part, "doc_id").limit(docs_limit) for t in (True, False)]
    picked = least[0].union(least[1])

    def run(it):
        for b in batches(it):
            found = [sorted(words_in(t), key=hash_of)[:DOC_WORDS] for t in texts(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([" ".join(f) for f in found], pa.string())], ["doc_id", "toxic", "words"])

    rows = narrow(docs, {"doc_id": "bigint", "text": "string"}).where("text is not null").join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text"))).alias("t"))
    found = rows.select("doc_id", "toxic", "t.text").mapInArrow(run, "doc_id bigint, toxic boolean, words string").collect()
    found.sort(key=lambda r: (hash_of(str(r[0])), r[0]))
    toxic, split = [r[1] for r in found], [r[2].split(" ") if r[2] else [] for r in found]
    if not any(toxic) or all(toxic):
        return None
    grades = severity_grades(split, toxic)
    levels = 3 if 2 in grades and 1 in grades else 2
    return Ordinal.fit(split, [min(g, levels - 1) for g in grades], levels)


def hash_of(word: str) -> int:
    """A fixed mixing of a word's letters, the same in every process."""
    h = 0
    for c in word[:24]:
        h = (h * 1_000_003 ^ ord(c)) & 0xFFFFFFFFFFFFFFFF
    return (h * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF


def score(docs: DataFrame, model: Ordinal | None) -> DataFrame:
    """(doc_id, severity, grade, p_toxic, toxic) of each row of docs: expected grade, most probable grade, P(grade > 0),
    and whether that is at least a half."""
    bound_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(it):
        m = held.value
        known: dict[str, tuple[int, ...]] = {}
        for b in batches(it):
            split = [set(t.split()) for t in texts(b.column(1))]
            activation = np.zeros(len(split))
            if m:
                if len(known) > MEMORY:
                    known = {}
                get, weight = m.vocabulary.get, m.weight
                new = [c for c in set().union(*split) if c not in known]
                for c in new:
                    known[c] = tuple(i for w in words_of(c) if (i := get(w)) is not None)
                none = ()
                activation[:] = [weight[list({i for k in c if (x := known[k]) is not none for i in x})].sum() for c in split]
                for c in new:
                    if len(c) > LONGEST:  # the memo's bound on chunks is one on bytes too
                        del known[c]
            above = m.above(activation) if m else np.zeros((len(split), 1))
            p = np.concatenate([np.ones((len(split), 1)), above], 1) - np.concatenate([above, np.zeros((len(split), 1))], 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(above.sum(axis=1)), pa.array(p.argmax(axis=1)), pa.array(above[:, 0]), pa.array(above[:, 0] >= 0.5)], ["doc_id", "severity", "grade", "p_toxic", "toxic"])

    return narrow(docs, {"doc_id": "bigint", "text": "string"}).mapInArrow(run, "doc_id bigint, severity double, grade bigint, p_toxic double, toxic boolean")


def grade_toxicity(docs: DataFrame, labels: DataFrame, docs_limit: int = DOCS) -> DataFrame:
    """train, then score every row of docs over its whole text.

    Null and empty texts have no words and get the model's base rate; without both labels every severity is 0.
    Labels with null doc_id or null toxic aren't learned from; of ties, the lower grade is named. Repeated rows give
    repeated results; an empty table gives an empty one; extra columns are ignored, whatever their names. Texts of any
    length are scored whole.
    """
    bound_batches(docs.sparkSession)
    return score(docs, train(docs, labels, docs_limit))
