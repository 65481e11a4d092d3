"""Quadrangles from segmentation masks: contours, polygon approximation, and three strategies."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.images import sliding

Point = tuple[float, float]


@dataclass(frozen=True)
class Options:
    """Area bounds in percent of the frame, factors of the perimeter, the kernel of erosion, the least height to width."""

    base: bool = True
    base_bound: float = 7.0
    factors: tuple[float, ...] = (0.1, 0.01)
    erosion: bool = False
    erosion_bound: float = 5.0
    kernel: int = 80
    split: bool = False
    ratio: float = 0.7


def regions(mask: np.ndarray) -> Iterator[np.ndarray]:
    """The 8-connected parts of a mask, each as a mask: runs of rows joined with those above they touch."""
    runs, parent, above = [], [], []

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for y, row in enumerate(mask):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
        here = []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            n = len(runs)
            runs.append((y, a, b))
            parent.append(n)
            for m in above:
                if runs[m][1] <= b and a <= runs[m][2]:
                    parent[top(n)] = top(m)
            here.append(n)
        above = here
    groups: dict[int, list] = {}
    for n, run in enumerate(runs):
        groups.setdefault(top(n), []).append(run)
    for group in groups.values():
        part = np.zeros(mask.shape, bool)
        for y, a, b in group:
            part[y, a:b] = True
        yield part


def contour(part: np.ndarray) -> list[Point]:
    """The outer border pixels of one region in order, by following its edge."""
    ys, xs = np.nonzero(part)
    steps = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]
    start = (int(xs[0]), int(ys[0]))
    here, came, out = start, 4, [start]
    solid = lambda x, y: 0 <= x < part.shape[1] and 0 <= y < part.shape[0] and part[y, x]
    first = None
    while True:
        for k in range(1, 9):
            d = (came + k) % 8
            nxt = (here[0] + steps[d][0], here[1] + steps[d][1])
            if solid(*nxt):
                break
        else:
            return out
        if (here, d) == first:
            return out[:-1] if len(out) > 1 and out[-1] == start else out
        first = first or (here, d)
        here, came = nxt, (d + 4) % 8
        out.append(here)


def perimeter(points: list[Point]) -> float:
    return sum(float(np.hypot(a[0] - b[0], a[1] - b[1])) for a, b in zip(points, points[1:] + points[:1], strict=True))


def simplify(points: list[Point], eps: float) -> list[Point]:
    """A closed outline with fewer points, none further than eps from it (Douglas-Peucker on the two halves)."""
    p = np.array(points, float)
    if len(p) < 3:
        return points
    far = int(np.argmax(((p - p[0]) ** 2).sum(1)))
    keep = {0, far}
    work = [(0, far), (far, len(p))]
    closed = np.vstack([p, p[:1]])
    while work:
        a, b = work.pop()
        if b - a < 2:
            continue
        (x0, y0), (x1, y1) = closed[a], closed[b]
        rest = closed[a + 1 : b]
        length = np.hypot(x1 - x0, y1 - y0)
        d = np.abs((x1 - x0) * (rest[:, 1] - y0) - (y1 - y0) * (rest[:, 0] - x0)) / length if length else np.hypot(rest[:, 0] - x0, rest[:, 1] - y0)
        if d.max() > eps:
            mid = a + 1 + int(d.argmax())
            keep.add(mid)
            work += [(a, mid), (mid, b)]
    return [points[i] for i in sorted(keep)]


def convex(points: list[Point]) -> bool:
    n = len(points)
    turns = [(points[(i + 1) % n][0] - points[i][0]) * (points[(i + 2) % n][1] - points[(i + 1) % n][1]) - (points[(i + 1) % n][1] - points[i][1]) * (points[(i + 2) % n][0] - points[(i + 1) % n][0]) for i in range(n)]
    return all(t > 0 for t in turns) or all(t < 0 for t in turns)


def corners(points: list[Point]) -> dict[str, Point]:
    """Names for four points: least and largest x + y, and the ones furthest up right and down left."""
    top, right = max(p[1] for p in points), max(p[0] for p in points)
    return {"tl": min(points, key=lambda p: p[0] + p[1]), "tr": max(points, key=lambda p: top - p[1] + p[0]), "bl": max(points, key=lambda p: right - p[0] + p[1]), "br": max(points, key=lambda p: p[0] + p[1])}


def quadrangles(mask: np.ndarray, bound: float, factors: tuple[float, ...]) -> list[dict[str, Point]]:
    """Of each region over bound percent of the mask, the first approximation by a factor that is convex with four points."""
    found = []
    for part in regions(mask):
        if not bound < 100 * part.sum() / part.size:
            continue
        outline = contour(part)
        for factor in factors:
            shape = simplify(outline, factor * perimeter(outline))
            if len(shape) == 4 and convex(shape):
                found.append(corners(shape))
                break
    return found


def detect(mask: np.ndarray, o: Options = Options()) -> list[dict[str, Point]]:
    """Screens of a mask, from left to right: the base strategy, erosion where it finds strictly more, then splitting."""
    found = quadrangles(mask, o.base_bound, o.factors) if o.base else []
    if o.erosion:
        parts = [sliding(p, o.kernel, False) for p in regions(sliding(mask, o.kernel, True))]
        other = [q for p in parts for q in quadrangles(p, o.erosion_bound, o.factors)]
        found = other if len(other) > len(found) else found
    if o.split and (o.base or o.erosion):
        halves = []
        for q in found:
            width = max(np.hypot(*np.subtract(q["tl"], q["tr"])), np.hypot(*np.subtract(q["bl"], q["br"])))
            height = max(np.hypot(*np.subtract(q["tl"], q["bl"])), np.hypot(*np.subtract(q["tr"], q["br"])))
            if height / width > o.ratio:
                halves.append(q)
            else:
                top, low = (tuple(np.add(q[a], q[b]) / 2) for a, b in (("tl", "tr"), ("bl", "br")))
                halves += [{"tl": q["tl"], "tr": top, "bl": q["bl"], "br": low}, {"tl": top, "tr": q["tr"], "bl": low, "br": q["br"]}]
        found = halves
    return sorted(found, key=lambda q: q["tl"])


def detect_screens(masks: DataFrame, o: Options = Options()) -> DataFrame:
    """video, frame_no, screen_ix from 0 and quad of each screen in masks (video, frame_no, width, height, mask bits)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for r in part.itertuples():
                mask = np.unpackbits(np.frombuffer(r.mask, np.uint8))[: r.width * r.height].reshape(r.height, r.width).astype(bool)
                rows += [(r.video, r.frame_no, i, {c: {"x": float(p[0]), "y": float(p[1])} for c, p in q.items()}) for i, q in enumerate(detect(mask, o))]
            yield pd.DataFrame(rows, columns=["video", "frame_no", "screen_ix", "quad"])

    from ..functions.geometry import QUAD

    return masks.mapInPandas(run, f"video long, frame_no long, screen_ix int, quad {QUAD}")
