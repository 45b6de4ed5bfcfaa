"""Language identification by a linear-chain conditional random field over words (operator 8)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.llm.common import batches, bound_batches, narrow, texts

#: The model is fitted on at most so many labelled documents, from each at most so many segments of so many words.
DOCS, SEGMENTS, WORDS = 3000, 4, 48
#: Hashed features; n-grams of marked words; words of a chain; steps of the fit.
SIZE, GRAMS, CHAIN, STEPS = 1 << 17, (2, 3, 4), 64, 30
#: Chunks whose scores a worker remembers, and the longest that it does.
MEMORY, LONGEST = 300_000, 256
UNKNOWN = "und"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def word_of(chunk: str) -> str:
    """A chunk's letters (Unicode category L) in lower case."""
    return chunk.lower() if chunk.isalpha() else "".join(filter(str.isalpha, chunk)).lower()


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashed features, -1 where a place has none; word number of each place; hashed lexicon entry of each word).

    Places are the characters of ^word$; at each one begin n-grams, so those with a mark are affixes. Shape (places, grams).
    """
    code = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 2
    start = np.cumsum(length) - length
    word = np.repeat(np.arange(len(words)), length)
    left = np.repeat(start + length, length) - np.arange(len(code))
    out = np.full((len(code), len(GRAMS)), -1, np.int64)
    total = np.zeros(len(code), np.uint64)
    for g in range(max(GRAMS)):
        total[: len(code) - g] = (total[: len(code) - g] ^ code[g:]) * MULTIPLIER
        total ^= total >> np.uint64(29)
        if g + 1 in GRAMS:
            ok = left > g
            out[ok, GRAMS.index(g + 1)] = ((total[ok] * MULTIPLIER + np.uint64(g)) >> np.uint64(64 - 17)).astype(np.int64)
    place = (np.arange(len(code)) - np.repeat(start, length)).astype(np.uint64)
    mixed = (code + place * np.uint64(0x632BE59BD9B4E019)) * MULTIPLIER
    mixed ^= mixed >> np.uint64(31)
    whole = np.add.reduceat(mixed, start) * MULTIPLIER
    return out, word, (whole >> np.uint64(64 - 17)).astype(np.int64)


class Crf:
    def __init__(self, labels: list[str]):
        k = len(labels)
        self.labels = labels
        self.weight = np.zeros((SIZE, k), np.float32)
        self.move, self.begin = np.zeros((k, k), np.float32), np.zeros(k, np.float32)
        self.letters: set[str] = set()  # of the words that it was fitted on

    def emissions(self, words: list[str]) -> np.ndarray:
        """Label scores of each word: the sum of its features' weights."""
        if not words:
            return np.zeros((0, len(self.labels)), np.float32)
        out = []
        for lo in range(0, len(words), 20_000):
            part = words[lo : lo + 20_000]
            grams, word, whole = features(part)
            start = np.searchsorted(word, np.arange(len(part)))
            total = self.weight[whole].copy()
            for g in range(grams.shape[1]):
                at = grams[:, g]
                total += np.add.reduceat(np.where((at >= 0)[:, None], self.weight[np.maximum(at, 0)], 0), start)
            out.append(total)
        return np.concatenate(out)

    def marginals(self, score: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward on chains side by side. score: (chains, places, labels); valid: (chains, places), from the
        left. Returns posterior label shares and the expected moves, summed."""
        s, n, k = score.shape
        e = np.exp(score - score.max(axis=2, keepdims=True))
        top = self.move.max()
        a = np.exp(self.move - top)
        forward, backward = np.zeros((n, s, k), np.float32), np.ones((n, s, k), np.float32)
        now = np.exp(self.begin - self.begin.max()) * e[:, 0]
        forward[0] = now / now.sum(axis=1, keepdims=True)
        for t in range(1, n):
            now = (forward[t - 1] @ a) * e[:, t]
            forward[t] = now / now.sum(axis=1, keepdims=True)
        moves = np.zeros((k, k))
        for t in range(n - 2, -1, -1):
            follow = e[:, t + 1] * backward[t + 1]
            follow /= follow.sum(axis=1, keepdims=True)
            on = valid[:, t + 1]
            if self.counting:
                joint = forward[t][on][:, :, None] * a * follow[on][:, None, :]
                moves += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            back = follow @ a.T
            backward[t] = np.where(on[:, None], back / back.sum(axis=1, keepdims=True), 1)
        post = forward * backward
        post /= post.sum(axis=2, keepdims=True)
        return post.transpose(1, 0, 2), moves

    counting = False

    def fit(self, chains: list[tuple[list[str], list[int]]]) -> None:
        """Likelihood ascent (Adam) on chains of (words, label numbers)."""
        k = len(self.labels)
        unique: dict[str, int] = {}
        n = max(len(w) for w, _ in chains)
        at, gold = np.full((len(chains), n), -1, np.int64), np.zeros((len(chains), n), np.int64)
        for i, (w, y) in enumerate(chains):
            at[i, : len(w)] = [unique.setdefault(x, len(unique)) for x in w]
            gold[i, : len(y)] = y
        valid = at >= 0
        words = list(unique)
        self.letters = set().union(*words)
        grams, word, whole = features(words)
        start = np.searchsorted(word, np.arange(len(words)))
        parts = [(grams[grams[:, g] >= 0, g], word[grams[:, g] >= 0]) for g in range(grams.shape[1])] + [(whole, np.arange(len(words)))]
        del grams
        total = valid.sum()
        target = np.zeros((len(words), k))
        np.add.at(target, (at[valid], gold[valid]), 1)
        both = valid[:, 1:]
        gold_moves = np.bincount((gold[:, :-1] * k + gold[:, 1:])[both], minlength=k * k).reshape(k, k)
        gold_begin = np.bincount(gold[:, 0], minlength=k)
        self.counting = True
        held = [(p, np.zeros(p.shape, np.float32), np.zeros(p.shape, np.float32)) for p in (self.weight, self.move, self.begin)]
        for step in range(1, STEPS + 1):
            score = np.zeros((len(words), k), np.float32)
            for index, owner in parts:
                for c in range(k):
                    score[:, c] += np.bincount(owner, self.weight[index, c], len(words))
            chained = np.where(valid[:, :, None], score[np.maximum(at, 0)], 0)
            post, moves = self.marginals(chained, valid)
            expected = np.stack([np.bincount(at[valid], post[valid][:, c], len(words)) for c in range(k)], 1)
            slope = target - expected
            grad = np.zeros_like(self.weight)
            for index, owner in parts:
                for c in range(k):
                    grad[:, c] += np.bincount(index, slope[owner, c], SIZE)
            gradients = (grad, gold_moves - moves, gold_begin - post[:, 0].sum(axis=0))
            for (p, m, v), g in zip(held, gradients):
                g = (g / total - 1e-6 * p).astype(np.float32)
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p += 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        del start
        self.counting = False


def _held_out() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1


def train(docs: DataFrame, docs_limit: int = DOCS) -> Crf | None:
    """A model from the labelled documents that aren't held out: docs_limit of them, chosen by hash, and from each
    SEGMENTS runs of WORDS words spread over its whole text, so that what reaches the driver is bounded. One chain in
    four joins the halves of two documents, from which moves between languages are learned. None without labels."""

    def run(it):
        for b in batches(it):
            lang, out = b.column(0).to_pylist(), []
            for text in texts(b.column(1)):
                words = [w for w in map(word_of, text.split()) if w]
                step = max(WORDS, -(-len(words) // SEGMENTS))
                out.append([" ".join(words[i : i + WORDS]) for i in range(0, len(words), step)][:SEGMENTS])
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(out, pa.list_(pa.string()))], ["lang", "segments"])

    known = narrow(docs, {"doc_id": "bigint", "text": "string", "lang": "string"}).where("lang is not null and text is not null").where(~F.coalesce(_held_out(), F.lit(True)))
    sampled = _by_hash(known, docs_limit).select("lang", "text").mapInArrow(run, "lang string, segments array<string>")
    rows = [(r[0], s.split(" ")[:WORDS]) for r in sampled.limit(docs_limit + docs_limit * 3 // 10).collect() for s in r[1] if s]
    if not rows:
        return None
    rows.sort(key=lambda r: (" ".join(r[1][:4]), r[0]))
    labels = sorted({lang for lang, _ in rows})
    number = {lang: i for i, lang in enumerate(labels)}
    chains = []
    for i, (lang, words) in enumerate(rows):
        if i % 4 == 3:
            other, more = rows[(i * 7919) % len(rows)]
            a, b = words[: WORDS // 2], more[: WORDS // 2]
            chains.append((a + b, [number[lang]] * len(a) + [number[other]] * len(b)))
        else:
            chains.append((words, [number[lang]] * len(words)))
    model = Crf(labels)
    model.fit(chains)
    return model


def _by_hash(known: DataFrame, limit: int) -> DataFrame:
    """About limit rows: those whose hash lies under a threshold set by the table's count."""
    n = known.count()
    share = min(1.0, limit / max(n, 1))
    return known if share == 1.0 else known.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("train")), F.lit(1 << 30)) < int(share * (1 << 30)))


class Labeller:
    """Document labels by a model, with a memo of words' scores."""

    def __init__(self, crf: Crf | None):
        self.crf, self.known = crf, {}
        self.table = np.zeros((0, len(crf.labels) if crf else 0), np.float32)
        self.plain = np.zeros(0, bool)  # words of letters that the model has seen

    def label(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, confidence) of each text: the language of the greatest mean posterior share, that share,
        and the mean over words of the posterior of each word's own best language, a word with a letter that no
        labelled text has counting as 0. Of ties the first label wins."""
        crf, known = self.crf, self.known
        split = [t.split() for t in texts]
        if len(known) > MEMORY:
            known.clear()
            self.table, self.plain = self.table[:0], self.plain[:0]
        new = [c for c in set().union(*split) if c not in known]
        if new:
            words = list(map(word_of, new))
            distinct = {w: i for i, w in enumerate(sorted(set(words) - {""}))}
            known.update((c, len(self.table) + distinct[w] if w else -1) for c, w in zip(new, words))
            if crf:
                self.table = np.concatenate([self.table, crf.emissions(list(distinct))])
                self.plain = np.concatenate([self.plain, np.array([crf.letters.issuperset(w) for w in distinct], bool)])
        at = [np.fromiter(map(known.__getitem__, c), np.int64, len(c)) for c in split]
        at = [a[a >= 0] for a in at]
        size = np.fromiter(map(len, at), np.int64, len(at))
        for c in new:
            if len(c) > LONGEST:  # the memo's bound on chunks is one on bytes too
                del known[c]
        if not crf:
            return [UNKNOWN] * len(at), np.zeros(len(at)), np.zeros(len(at))
        share, sure = shares(crf, self.table, self.plain, at)
        best = share.argmax(axis=1)
        name = [crf.labels[i] if n else UNKNOWN for i, n in zip(best.tolist(), size.tolist())]
        score = np.where(size > 0, share[np.arange(len(at)), best], 0.0)
        return name, np.clip(score, 0, 1).astype(np.float64), np.clip(sure, 0, 1)


def predict(docs: DataFrame, model: Crf | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, confidence) of each row of docs(doc_id, text), see Labeller.label."""
    bound_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "held_out", "lang_pred", "score", "confidence"]

    def run(it):
        labeller = Labeller(held.value)
        for b in batches(it):
            name, score, sure = labeller.label(texts(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(name, pa.string()), pa.array(score), pa.array(sure)], names)

    rows = narrow(docs, {"doc_id": "bigint", "text": "string"}).select("doc_id", "text", F.coalesce(_held_out(), F.lit(False)).alias("held_out"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double, confidence double")


def shares(crf: Crf, table: np.ndarray, plain: np.ndarray, at: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Mean posterior label shares of each document's words, and the mean of each word's greatest posterior (0
    for words that aren't plain); documents are cut into chains of CHAIN words."""
    out, sure = np.zeros((len(at), len(crf.labels))), np.zeros(len(at))
    todo: list[tuple[int, np.ndarray]] = []
    held = 0

    def flush():
        chains = [(d, w[i : i + CHAIN]) for d, w in todo for i in range(0, len(w), CHAIN)]
        for lo in range(0, len(chains), 4096):
            part = chains[lo : lo + 4096]
            size = np.array([len(w) for _, w in part])
            place = np.arange(max(size))
            valid = place < size[:, None]
            score = np.zeros((*valid.shape, len(crf.labels)), np.float32)
            word = np.concatenate([w for _, w in part])
            score[valid] = table[word]
            seen = np.zeros(valid.shape, bool)
            seen[valid] = plain[word]
            post, _ = crf.marginals(score, valid)
            of = [d for d, _ in part]
            np.add.at(out, of, np.where(valid[:, :, None], post, 0).sum(axis=1))
            np.add.at(sure, of, np.where(seen, post.max(axis=2), 0).sum(axis=1))
        todo.clear()

    for d, w in enumerate(at):
        todo.append((d, w))
        held += len(w)
        if held > 1 << 18:
            flush()
            held = 0
    flush()
    size = np.maximum(np.fromiter(map(len, at), np.int64, len(at)), 1)
    return out / size[:, None], sure / size


def label_words(crf: Crf, text: str) -> list[tuple[str, str]]:
    """(word, language) for each word of a text, code-switched or not."""
    words = [w for w in map(word_of, text.split()) if w]
    out = []
    for i in range(0, len(words), CHAIN):
        part = words[i : i + CHAIN]
        post, _ = crf.marginals(crf.emissions(part)[None], np.ones((1, len(part)), bool))
        out += [(w, crf.labels[j]) for w, j in zip(part, post[0].argmax(axis=1))]
    return out


def identify(docs: DataFrame, docs_limit: int = DOCS) -> DataFrame:
    """train on docs(doc_id, text, lang), then predict every row of it. Only text is an input of a prediction.

    Null texts and texts without a letter (Unicode category L) give `und`, score 0; so do all texts when nothing is
    labelled. Rows
    without a doc_id count as not held out and aren't learned from. Repeated rows give repeated results; an empty
    table gives an empty one; extra columns are ignored. Long texts are labelled whole, in chains of CHAIN words.
    """
    bound_batches(docs.sparkSession)
    return predict(docs, train(docs, docs_limit))


def keep_known(docs: DataFrame, least_confidence: float, docs_limit: int = DOCS) -> DataFrame:
    """Rows of docs(doc_id, text, lang, ...) whose words are of languages that the model knows, with all their columns;
    a null lang becomes the predicted one.

    A text goes if it has no letter, or if its words' own best languages have a mean posterior under
    least_confidence, where words with letters that no labelled text has count as 0: words in another script, or of
    which the model can't tell the language. A text that mixes known languages stays: each word is sure of its own. Null texts go; repeated rows get the same decision; texts of
    any length are taken whole; an empty table gives an empty one; columns of any names stay as they are. Where no
    row has a language to learn from, texts with a letter stay, as they are.
    """
    bound_batches(docs.sparkSession)
    model = train(docs, docs_limit)
    if model is None:
        return docs.where(docs["text"].rlike(r"\p{L}"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    at, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(it):
        labeller = Labeller(held.value)
        for b in batches(it):
            name, _, sure = labeller.label(texts(b.column(at).cast(pa.string())))
            own = b.column(lang)
            filled = pc.coalesce(own, pa.array(name, pa.string()).cast(own.type)) if own.null_count else own
            b = b.set_column(lang, b.schema.field(lang), filled)
            yield b.filter(pa.array((sure >= least_confidence) & np.array([n != UNKNOWN for n in name])))

    return docs.mapInArrow(run, docs.schema)
