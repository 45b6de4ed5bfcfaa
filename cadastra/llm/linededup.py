"""Recurring lines by a fixed-depth tree of line templates (operator 5)."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from cadastra.llm.common import batches, bound_batches, free_names, shared_table

#: Leading tokens that make up the tree's inner levels, below the token count.
DEPTH = 2
#: Lines of fewer tokens recur only together with a neighbouring line; from VARIED tokens on, a stretch may vary.
SHORT, VARIED = 3, 6
#: The tokens behind the leading ones are cut in FIFTHS; a template leaves two neighbouring ones open.
FIFTHS = 5
#: A key that makes up this share of all rows or more is hot; there are fewer than HOT of them.
HOT = 4096
DIGIT = re.compile(rb"[0-9]")
#: Scripts without blanks: each letter is a token of its own (Thai to Tibetan, Myanmar, Khmer, Kana, Han).
SOLID = re.compile("([\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff])")


def templates(tokens: list[bytes]) -> list[bytes]:
    """Template keys, 16 bytes each, of a line's tokens. The tree's path is the token count, then the leading tokens,
    with tokens that hold digits as a wildcard. At a leaf stands the template of the whole line, and for longer lines
    four more, each with two neighbouring fifths of the remaining tokens variable: lines of one template agree in the
    leading tokens and in the other three fifths, at whatever places they differ inside the open stretch."""
    masked = [b"<*>" if DIGIT.search(t) else t for t in tokens]
    n = len(masked)
    path = b"%d %s" % (n, b" ".join(masked[:DEPTH]))
    rest = masked[DEPTH:]
    keys = [xxh3_128_digest(path + b"\0" + b" ".join(rest))]
    if n >= VARIED:
        cut = [len(rest) * b // FIFTHS for b in range(FIFTHS + 1)]
        for v in range(FIFTHS - 1):
            a, b = cut[v], cut[v + 2]
            if a < b:
                keys.append(xxh3_128_digest(b"%s\0%d\0%s\0%s" % (path, v, b" ".join(rest[:a]), b" ".join(rest[b:]))))
    return keys


def tokens_of(line: bytes, solid: bool = False) -> list[bytes]:
    """Tokens between ASCII white space; letters of scripts without blanks stand alone."""
    return (SOLID.sub(r" \1 ", line.decode()).encode() if solid else line).split()


def parsed(text: str) -> list[tuple[int, list[bytes]]]:
    """(line number, template keys) of the lines that hold a token. A line of fewer than SHORT tokens has no template
    of its own; it has one with the line before it and one with the line after it (lines without tokens aside)."""
    solid = not text.isascii() and SOLID.search(text) is not None
    raw = text.encode()
    lines = [(i, t) for i, line in enumerate(raw.split(b"\n")) if (t := tokens_of(line, solid))]
    out: list[tuple[int, list[bytes]]] = []
    for at, (i, tokens) in enumerate(lines):
        if len(tokens) >= SHORT:
            out.append((i, templates(tokens)))
            continue
        both = []
        for a, b in ((at - 1, at), (at, at + 1)):
            if a >= 0 and b < len(lines):
                both.append(xxh3_128_digest(b"%d\0%s\0%s" % (a == at, b" ".join(lines[a][1]), b" ".join(lines[b][1]))))
        if both:
            out.append((i, both))
    return out


def _longs(keys: list[bytes]) -> tuple[pa.Array, pa.Array]:
    both = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
    return pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())


def recurring_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, line, later): lines of docs(doc_id, text) whose template recurs in two documents or more.

    later: whether an earlier document (by doc_id, then text hash, nulls last) has the template too. A document is a
    pair of doc_id and text hash (32 bits), so rows repeated in full count once. Keys of 128 bits, not texts, are
    shuffled; counts and firsts of a template are combined before the shuffle. Only recurring templates are joined
    back: the few hot ones, whose number is bounded by their share of all rows, as a broadcast table, so that a line
    of a third of all documents stays where its rows are; the rest by shuffle.
    """
    bound_batches(docs.sparkSession)

    def run(it):
        for b in batches(it):
            rows, line, key = [], [], []
            for r, text in enumerate(b.column(2).to_pylist()):
                for i, keys in parsed(text) if text else ():
                    rows += [r] * len(keys)
                    line += [i] * len(keys)
                    key += keys
            at = pa.array(rows, pa.int64())
            one, two = _longs(key)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(line, pa.int32()), one, two], names)

    names = ["doc_id", "doc", "line", "k1", "k2"]
    keyed = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), F.hash(docs["text"]).alias("doc"), docs["text"].cast("string").alias("text"))
    lines = shared_table(keyed.mapInArrow(run, "doc_id bigint, doc int, line int, k1 bigint, k2 bigint"), "lines")
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("doc").alias("d"))
    of = lines.groupBy("k1", "k2").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))
    recurs = shared_table(of.where(~F.col("first").eqNullSafe(F.col("last"))).select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "first", "n"), "templates")
    total = lines.count()  # from the files' footers
    hot = F.broadcast(recurs.where(F.col("n") * HOT > total).drop("n"))
    rest = recurs.where(F.col("n") * HOT <= total).drop("n")
    same = (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2"))
    hit = lines.join(hot, same).unionByName(lines.join(hot, same, "left_anti").join(rest, same))
    return hit.groupBy("doc_id", "doc", "line").agg(F.max(~order.eqNullSafe(F.col("first"))).alias("later"))


def drop_recurring_lines(docs: DataFrame, keep_first: bool = True) -> DataFrame:
    """docs(doc_id, text, ...) without recurring lines, with n_lines, n_recurring and n_dropped added.

    A line whose template recurs across documents is dropped, except, if keep_first, in the first document that has
    it; of equal documents (same doc_id and text) all count as one, so ties can't arise. Other lines stay, in order.
    Null texts stay null and have no lines; an empty text has none; repeated rows get the same decision; an empty
    table gives an empty one; all other columns pass through unchanged, whatever their names (n_chars, if present,
    follows the new text; columns named as the three counts give way to them). Texts of any length are taken whole;
    the work on a text grows with its length. Lines of fewer than SHORT tokens go only with a neighbouring line.
    """
    own, other, doc, recurring, gone, hash_ = free_names(docs, 6)
    hits = recurring_lines(docs)
    dropped = F.when(F.col("later") if keep_first else F.lit(True), F.col("line"))
    per = hits.groupBy(F.col("doc_id").alias(own), F.col("doc").alias(doc)).agg(F.count("*").alias(recurring), F.array_sort(F.collect_list(dropped)).alias(gone))
    keyed = docs.withColumns({hash_: F.hash(docs["text"]), other: docs["doc_id"].cast("bigint")})
    joined = keyed.join(per, F.col(other).eqNullSafe(F.col(own)) & (F.col(hash_) == F.col(doc)), "left")
    text = joined["text"].cast("string")
    n_lines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    # The lines between those that go, slice by slice; both arrays are made once: linear in the number of lines.
    both = F.struct(F.split(text, "\n").alias("l"), F.concat(F.col(gone), F.array(n_lines)).alias("stop"))
    kept = F.get(F.transform(F.array(both), lambda b: F.flatten(F.transform(b["stop"], lambda stop, i: _between(b, stop, i)))), 0)
    n_dropped = F.coalesce(F.size(F.coalesce(F.col(gone), F.array().cast("array<int>"))), F.lit(0))
    new_text = F.when(n_dropped > 0, F.array_join(kept, "\n")).otherwise(text)
    counts = {
        "n_lines": F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(n_lines).cast("bigint"),
        "n_recurring": F.coalesce(F.col(recurring), F.lit(0)),
        "n_dropped": n_dropped.cast("bigint"),
    }
    new = {"text": new_text, "n_chars": F.when(text.isNotNull(), F.length(new_text)).otherwise(0).cast("bigint")}
    same = [c for c in docs.columns if c not in counts]
    return joined.select(*(new[c].alias(c) if c in new else joined[c] for c in same), *(v.alias(k) for k, v in counts.items()))


def _between(both: F.Column, stop: F.Column, i: F.Column) -> F.Column:
    """The lines after the stop before number i up to that stop, both left out."""
    before = F.when(i > 0, F.get(both["stop"], i - 1)).otherwise(-1)
    return F.slice(both["l"], before + 2, stop - before - 1)
