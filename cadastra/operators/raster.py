"""Raster operators on uint8 arrays, and their use on a table of images (sheet, height, width, pixels)."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def otsu(gray: np.ndarray) -> int:
    """The threshold of greatest variance between the classes up to it and above."""
    hist = np.bincount(gray.ravel(), minlength=256).astype(float)
    w = np.cumsum(hist)
    m = np.cumsum(hist * np.arange(256))
    total, mean = w[-1], m[-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mean * w - m * total) ** 2 / (w * (total - w))
    return int(np.argmax(np.nan_to_num(between, nan=0, posinf=0)))


def ink(gray: np.ndarray, threshold: int | None = None) -> np.ndarray:
    """Dark pixels: at most Otsu's threshold, or below a fixed one."""
    return gray <= otsu(gray) if threshold is None else gray < threshold


def components(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(labels, stats) of 8-connected components, numbered from 1 in reading order; stats rows: x, y, w, h, area.

    Runs of each row are united with those they touch in the row above."""
    parent: list[int] = []

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    above: list[tuple[int, int, int]] = []
    runs = []
    for y, row in enumerate(mask):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
        now = []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            k = len(parent)
            parent.append(k)
            for c, d, j in above:
                if c <= b and a <= d:
                    p, q = sorted((top(j), top(k)))
                    parent[q] = p
            now.append((a, b, k))
        runs += [(y, *r) for r in now]
        above = now
    labels, number, stats = np.zeros(mask.shape, np.int32), {}, []
    for y, a, b, k in runs:
        n = number.setdefault(top(k), len(number) + 1)
        labels[y, a:b] = n
        if n > len(stats):
            stats.append([a, y, b, y + 1, 0])
        s = stats[n - 1]
        s[0], s[2], s[3], s[4] = min(s[0], a), max(s[2], b), y + 1, s[4] + b - a
    out = np.array(stats, int).reshape(-1, 5)
    out[:, 2:4] -= out[:, :2]
    return labels, out


def linework(mask: np.ndarray, long_side: int, glyphs: bool = False, border: float = 0.9, least_area: int = 6) -> np.ndarray:
    """Pixels of components longer than long_side that aren't the page's border; glyphs: those of the small ones instead."""
    labels, s = components(mask)
    long = (np.maximum(s[:, 2], s[:, 3]) > long_side) & (s[:, 4] >= least_area)
    page = (s[:, 2] > border * mask.shape[1]) & (s[:, 3] > border * mask.shape[0])
    keep = np.concatenate([[False], ~long if glyphs else long & ~page])
    return keep[labels]


def erase(mask: np.ndarray, boxes: list[tuple[float, float, float, float]], pad: int = 2) -> np.ndarray:
    """The mask without boxes (x0, y0, x1, y1), padded."""
    out = mask.copy()
    for x0, y0, x1, y1 in boxes:
        out[max(0, int(y0) - pad) : int(y1) + pad + 1, max(0, int(x0) - pad) : int(x1) + pad + 1] = False
    return out


def parcel_box(mask: np.ndarray, margin: float = 0.04) -> tuple[int, int, int, int]:
    """(x0, y0, x1, y1) of the largest component with a margin, inside the image."""
    _, s = components(mask)
    if not len(s):
        return 0, 0, mask.shape[1], mask.shape[0]
    x, y, w, h, _ = s[np.argmax(s[:, 4])]
    m = int(margin * max(w, h))
    return max(0, x - m), max(0, y - m), min(mask.shape[1], x + w + m), min(mask.shape[0], y + h + m)


def _shifted(mask: np.ndarray, dy: int, dx: int) -> np.ndarray:
    out = np.zeros_like(mask)
    h, w = mask.shape
    out[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)] = mask[max(0, -dy) : h + min(0, -dy), max(0, -dx) : w + min(0, -dx)]
    return out


def disc(size: int) -> list[tuple[int, int]]:
    r = size // 2
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dx * dx + dy * dy <= r * r + r * 0.5]


def dilate(mask: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros_like(mask)
    for dy, dx in disc(size):
        out |= _shifted(mask, dy, dx)
    return out


def erode(mask: np.ndarray, size: int) -> np.ndarray:
    return ~dilate(~np.pad(mask, size), size)[size:-size, size:-size]


def close(mask: np.ndarray, size: int) -> np.ndarray:
    """Gaps narrower than the disc are filled."""
    return erode(dilate(np.pad(mask, size), size), size)[size:-size, size:-size]


def skeleton(mask: np.ndarray) -> np.ndarray:
    """Thin lines of a mask (Zhang-Suen), all pixels of a pass at once."""
    img = np.pad(mask.astype(np.uint8), 1)
    while True:
        changed = False
        for first in (True, False):
            p = [img[:-2, 1:-1], img[:-2, 2:], img[1:-1, 2:], img[2:, 2:], img[2:, 1:-1], img[2:, :-2], img[1:-1, :-2], img[:-2, :-2]]
            count = sum(x.astype(int) for x in p)
            turns = sum(((a == 0) & (b == 1)).astype(int) for a, b in zip(p, p[1:] + p[:1]))
            n, e, s, w = p[0], p[2], p[4], p[6]
            corner = (n * e * s == 0) & (e * s * w == 0) if first else (n * e * w == 0) & (n * s * w == 0)
            go = (img[1:-1, 1:-1] == 1) & (count >= 2) & (count <= 6) & (turns == 1) & corner
            if go.any():
                img[1:-1, 1:-1][go] = 0
                changed = True
        if not changed:
            return img[1:-1, 1:-1].astype(bool)


def simplified(points: np.ndarray, eps: float) -> np.ndarray:
    """Douglas-Peucker, without recursion."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d = points[b] - points[a]
        rel = points[a + 1 : b] - points[a]
        size = np.hypot(*d)
        gap = np.abs(rel[:, 0] * d[1] - rel[:, 1] * d[0]) / size if size else np.hypot(*rel.T)
        k = int(gap.argmax())
        if gap[k] > eps:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[keep]


def traced(skel: np.ndarray, eps: float = 1.5, least: float = 0.0) -> list[np.ndarray]:
    """Polylines (x, y) of a skeleton: paths between pixels that don't have exactly two neighbours, then closed loops."""
    on = set(zip(*(a.tolist() for a in np.nonzero(skel))))
    around = lambda p: [q for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and (q := (p[0] + dy, p[1] + dx)) in on]
    near = {p: around(p) for p in on}
    used: set[frozenset] = set()
    paths = []

    def walk(a, b):
        path = [a, b]
        used.add(frozenset((a, b)))
        while len(near[path[-1]]) == 2:
            step = next((q for q in near[path[-1]] if frozenset((path[-1], q)) not in used), None)
            if step is None:
                break
            used.add(frozenset((path[-1], step)))
            path.append(step)
        paths.append(path)

    for odd in (True, False):
        for p in sorted(on):
            if (len(near[p]) != 2) == odd:
                for q in near[p]:
                    if frozenset((p, q)) not in used:
                        walk(p, q)
    out = []
    for path in paths:
        xy = np.array([(x, y) for y, x in path], float)
        if np.hypot(*np.diff(xy, axis=0).T).sum() >= least:
            out.append(simplified(xy, eps))
    return out


def band(gray: np.ndarray, x0: float, y0: float, x1: float, y1: float, height: int) -> np.ndarray:
    """The strip of the given height along a segment, turned so that the segment runs to the right; white outside the image."""
    length = int(round(np.hypot(x1 - x0, y1 - y0)))
    ux, uy = (x1 - x0) / max(length, 1e-9), (y1 - y0) / max(length, 1e-9)
    t, s = np.meshgrid(np.arange(length), np.arange(height) - height / 2)
    x, y = np.rint(x0 + t * ux - s * uy).astype(int), np.rint(y0 + t * uy + s * ux).astype(int)
    ok = (x >= 0) & (x < gray.shape[1]) & (y >= 0) & (y < gray.shape[0])
    return np.where(ok, gray[np.clip(y, 0, gray.shape[0] - 1), np.clip(x, 0, gray.shape[1] - 1)], 255).astype(np.uint8)


def flood_count(mask: np.ndarray) -> int:
    """Number of 8-connected components by flooding; a plain check of `components`."""
    left = set(zip(*(a.tolist() for a in np.nonzero(mask))))
    n = 0
    while left:
        n += 1
        queue = deque([left.pop()])
        while queue:
            y, x = queue.popleft()
            for q in ((y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)):
                if q in left:
                    left.remove(q)
                    queue.append(q)
    return n


def traced_sheets(images: DataFrame, long_side: int = 20, eps: float = 1.5, least: float = 0.0) -> DataFrame:
    """(sheet, line, pos, x, y): linework of images(sheet, height, width, pixels binary), thinned and traced; an image is one row."""
    def run(it):
        for pdf in it:
            out = []
            for r in pdf.itertuples():
                gray = np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width)
                for k, line in enumerate(traced(skeleton(linework(ink(gray), long_side)), eps, least)):
                    out += [(r.sheet, k, i, x, y) for i, (x, y) in enumerate(line)]
            yield pd.DataFrame(out, columns=["sheet", "line", "pos", "x", "y"])

    return images.select("sheet", "height", "width", "pixels").mapInPandas(run, "sheet long, line long, pos long, x double, y double")


def tile_ink(images: DataFrame, size: int, overlap: int, least: int = 400, share: float = 0.002) -> DataFrame:
    """(sheet, x0, y0, x1, y1, ink): overlapped tiles, at least least either way, whose share of dark pixels is at least share."""
    def run(it):
        step = max(1, size - overlap)
        for pdf in it:
            out = []
            for r in pdf.itertuples():
                dark = ink(np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width), 200)
                for y in range(0, max(1, r.height - overlap), step):
                    for x in range(0, max(1, r.width - overlap), step):
                        tile = dark[y : y + size, x : x + size]
                        if min(tile.shape) >= least and tile.mean() >= share:
                            out.append((r.sheet, x, y, x + tile.shape[1], y + tile.shape[0], float(tile.mean())))
            yield pd.DataFrame(out, columns=["sheet", "x0", "y0", "x1", "y1", "ink"])

    return images.select("sheet", "height", "width", "pixels").mapInPandas(run, "sheet long, x0 long, y0 long, x1 long, y1 long, ink double")
