"""Places where programs outside Spark come in: renderers, text recognisers, vision models, downloads.

None of them is part of this package. Each is a plain function that the caller hands over; what it returns is kept as
a table, and items already in that table are not asked for again. A failing item becomes a row with an error.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

READ = "key string, content string, error string"


def call_each(items: DataFrame, key: str, payload: str, client: Callable[[object], str], done: DataFrame | None = None, parallel: int | None = None) -> DataFrame:
    """(key, content, error): client(payload) for each item that isn't done; parallel sets the number of calls at a time."""
    todo = items.select(F.col(key).cast("string").alias("key"), F.col(payload).alias("payload"))
    if done is not None:
        todo = todo.join(done.where("error is null").select("key").distinct(), "key", "left_anti")
    if parallel:
        todo = todo.repartition(parallel)

    def run(it):
        for pdf in it:
            out = []
            for k, p in zip(pdf["key"], pdf["payload"]):
                try:
                    out.append((k, client(p), None))
                except Exception as e:  # one bad item must not end the others
                    out.append((k, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(out, columns=["key", "content", "error"])

    return todo.mapInPandas(run, READ)


def rendered(files: DataFrame, renderer: Callable[[bytes], tuple[int, int, bytes]]) -> DataFrame:
    """(path, height, width, pixels) of binaryFile rows, by a renderer of gray images."""
    def run(it):
        for pdf in it:
            rows = [(p, *renderer(c)) for p, c in zip(pdf["path"], pdf["content"])]
            yield pd.DataFrame(rows, columns=["path", "height", "width", "pixels"])

    return files.select("path", "content").mapInPandas(run, "path string, height int, width int, pixels binary")


def decode_pgm(raw: bytes) -> tuple[int, int, bytes]:
    """A binary 8-bit PGM image; a renderer that needs no library."""
    fields, at = [], 2
    if raw[:2] != b"P5":
        raise ValueError("not a binary PGM file")
    while len(fields) < 3:
        while raw[at : at + 1].isspace():
            at += 1
        if raw[at : at + 1] == b"#":
            at = raw.index(b"\n", at)
            continue
        end = at
        while not raw[end : end + 1].isspace():
            end += 1
        fields.append(int(raw[at:end]))
        at = end
    width, height, most = fields
    if most > 255:
        raise ValueError("only 8-bit images")
    return height, width, raw[at + 1 : at + 1 + width * height]
