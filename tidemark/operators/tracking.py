"""Following screens from frame to frame."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import overlap

TRACKED = "video long, frame_no long, ix long, track long, state string"


def placed(screens: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """Adds at, the place of a screen's frame among the processed frames of its video, and next_frame, the number of the one
    after it (null at the end).

    Processed frames are those of screens, where a row without quad is a frame that shows none, and those of frames (video,
    frame_no). A scene filter leaves gaps between their numbers, which don't matter. One shuffle by video.
    """
    rows = screens.drop("at", "next_frame")
    rows = rows if frames is None else rows.unionByName(frames.select("video", "frame_no"), allowMissingColumns=True)
    rows = rows.withColumn("at", F.dense_rank().over(Window.partitionBy("video").orderBy("frame_no")))
    after = Window.partitionBy("video").orderBy("at").rangeBetween(1, 1)
    return rows.withColumn("next_frame", F.min("frame_no").over(after)).where("quad is not null")


def track_single(screens: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """Adds track (from 1 in each video), new, at and next_frame to videos with at most one screen a frame.

    A track goes on while each processed frame (see placed) shows a quadrangle that overlaps the last: gaps and islands.
    """
    order = Window.partitionBy("video").orderBy("at")
    rows = placed(screens, frames).withColumn("_before", F.lag("at").over(order)).withColumn("_quad", F.lag("quad").over(order))
    goes_on = (F.col("_before") == F.col("at") - 1) & ((F.col("_quad") == F.col("quad")) | (overlap("_quad", "quad") > 1e-9))
    rows = rows.withColumn("new", ~F.coalesce(goes_on, F.lit(False)))
    return rows.withColumn("track", F.sum(F.col("new").cast("long")).over(order)).drop("_before", "_quad")


Quad = tuple[tuple[float, float], ...]


def clip_area(a: Quad, b: Quad) -> float:
    """Area that two convex outlines share, corner after corner: b's sides cut a down. One without area shares nothing."""

    def area(p: list) -> float:
        return sum(p[i - 1][0] * p[i][1] - p[i][0] * p[i - 1][1] for i in range(len(p))) / 2

    if not area(list(a)) or not area(list(b)):
        return 0.0
    a, b = (list(x) if area(list(x)) >= 0 else list(x)[::-1] for x in (a, b))
    for (px, py), (qx, qy) in zip(b, b[1:] + b[:1], strict=True):
        if (px, py) == (qx, qy):
            continue
        side = [(qx - px) * (y - py) - (qy - py) * (x - px) for x, y in a]
        cut = []
        for i, (x, y) in enumerate(a):
            before, here = side[i - 1], side[i]
            if (before < 0 < here) or (here < 0 < before):
                t = before / (before - here)
                cut.append((a[i - 1][0] + t * (x - a[i - 1][0]), a[i - 1][1] + t * (y - a[i - 1][1])))
            if here >= 0:
                cut.append((x, y))
        a = cut
        if len(a) < 3:
            return 0.0
    return area(a)


class Tracker:
    """State of one video: the last outline of each living track."""

    def __init__(self):
        self.alive: dict[int, Quad] = {}
        self.issued = 0

    def update(self, quads: list[Quad]) -> tuple[dict[int, int], set[int], list[int]]:
        """(track of each quadrangle by place, places that appeared, tracks that disappeared).

        First those that did not move keep their tracks; the others, in their order, each take the free track they share most
        with by Jaccard index, the oldest on ties, or a new one. A track is used once in a frame. A lost track ends.
        """
        given, free = {}, dict(self.alive)
        for i, q in enumerate(quads):
            if (same := next((t for t, old in free.items() if old == q), None)) is not None:
                given[i] = same
                del free[same]
        appeared = set()
        for i, q in enumerate(quads):
            if i in given:
                continue
            best, found = 0.0, None
            for t, old in sorted(free.items()):
                shared = clip_area(old, q)
                if shared > 1e-9 and (index := shared / (clip_area(old, old) + clip_area(q, q) - shared)) > best:
                    best, found = index, t
            if found is None:
                self.issued += 1
                found = self.issued
                appeared.add(i)
            free.pop(found, None)
            given[i] = found
        self.alive = {t: quads[i] for i, t in given.items()}
        return given, appeared, sorted(free)


def outline(q: dict) -> Quad:
    return tuple((q[c]["x"], q[c]["y"]) for c in ("tl", "tr", "br", "bl"))


def track_many(screens: DataFrame, make: Callable[[], Tracker] = Tracker) -> DataFrame:
    """video, frame_no, ix, track, state (appeared, existing or disappeared) for any number of screens a frame (TRACKED).

    Frames are processed in order of their numbers, whatever the gaps; a row without quad is a frame that shows none. Only this
    fold is sequential, one task for a video; a disappeared track has no ix and the number of the frame that lacks it.
    """

    def fold(video: pd.DataFrame) -> pd.DataFrame:
        tracker, rows, name = make(), [], int(video["video"].iloc[0])
        for frame, part in video.sort_values(["frame_no", "ix"]).groupby("frame_no", sort=True):
            part = part[part["quad"].notna()]
            given, new, gone = tracker.update([outline(q) for q in part["quad"]])
            rows += [(name, frame, None, t, "disappeared") for t in gone]
            rows += [(name, frame, ix, given[i], "appeared" if i in new else "existing") for i, ix in enumerate(part["ix"])]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in TRACKED.split(", ")]).astype({"ix": "Int64"})

    return screens.select("video", "frame_no", F.col("ix").cast("long"), "quad").groupBy("video").applyInPandas(fold, TRACKED)


def history(tracks: DataFrame, n: int = 2) -> DataFrame:
    """Adds past: the last n quadrangles of the track, oldest first. At least two are kept."""
    if n < 2:
        raise ValueError("a history holds at least two positions")
    back = Window.partitionBy("video", "track").orderBy("frame_no").rowsBetween(1 - n, 0)
    return tracks.withColumn("past", F.collect_list("quad").over(back))
