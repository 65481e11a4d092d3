"""The event detector over a stream of frames: tracker, ids and matched pages as state of each video."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.geometry import QUAD
from ..operators.tracking import Tracker, outline

EVENTS = "video long, frame_no long, phase int, kind string, screen_id string, page long"
STATE = "data binary"


class Detector:
    """Events of one video, frame after frame; its state is as large as one frame's screens."""

    def __init__(self):
        self.tracker, self.pages, self.quads, self.ids, self.issued = Tracker(), {}, {}, {}, 0

    def frame(self, number: int, screens: list[tuple[tuple, int | None]]) -> list[tuple[int, int, str, str, int | None]]:
        """screens: (outline, page or None) in the detector's order. Gives (frame, phase, kind, id, page)."""
        unique = dict(screens)  # of equal outlines the last counts
        quads = list(unique)
        given, _, gone = self.tracker.update(quads)
        out = [(number, 0, "disappeared", self.ids[t], None) for t in gone if self.pages.get(t) is not None]
        for t in gone:
            for held in (self.pages, self.quads, self.ids):
                held.pop(t, None)
        for i, quad in enumerate(quads):
            t, page = given[i], unique[quad]
            was, old = self.pages.get(t), self.quads.get(t)
            if page is not None and was is None:
                self.issued += 1
                self.ids[t] = f"screen-{self.issued}"
                out.append((number, 1, "appeared", self.ids[t], page))
            elif page is not None:
                if page != was:
                    out.append((number, 1, "changed-content", self.ids[t], page))
                if quad != old:
                    out.append((number, 2, "moved", self.ids[t], None))
            elif was is not None:
                out.append((number, 1, "disappeared", self.ids[t], None))
            self.pages[t], self.quads[t] = page, quad
        return out


def _screens(rows: pd.DataFrame) -> list[tuple[tuple, int | None]]:
    """Outline and page of a frame's screens, in the detector's order: by ix where there is one, else by outline."""
    found = [(outline(q), None if pd.isna(p) else int(p)) for q, p in zip(rows["quad"], rows["page"], strict=True) if q is not None]
    return found if "ix" in rows else sorted(found, key=lambda s: s[0])


def _table(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=[x.split()[0] for x in EVENTS.split(", ")]).astype({"page": "Int64"})


def _placed(video: int, detector: Detector, events: list[tuple]) -> list[tuple]:
    """The events with video in front and, where a screen appeared or moved, its quadrangle behind."""
    tracks = {name: track for track, name in detector.ids.items()}
    out = []
    for event in events:
        quad = None
        if event[2] in ("appeared", "moved"):
            tl, tr, br, bl = ({"x": x, "y": y} for x, y in detector.quads[tracks[event[3]]])
            quad = {"tl": tl, "tr": tr, "bl": bl, "br": br}
        out.append((video, *event, quad))
    return out


def detect_batch(frames: DataFrame) -> DataFrame:
    """Events (EVENTS) and quad of rows (video, frame_no, quad or null, page or null, perhaps ix), any number of screens a frame.

    Frames are processed in order of their numbers, whatever the gaps; a row without quad is a frame that shows none. A video is
    one task, as each frame depends on the one before, but only one frame's screens are held.
    """
    order = ["video", "frame_no", *(["ix"] if "ix" in frames.columns else [])]
    rows = frames.select(*order, "quad", F.col("page").cast("long").alias("page"))
    names = [*(x.split()[0] for x in EVENTS.split(", ")), "quad"]

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector, open_ = Detector(), None

        def frame(own: pd.DataFrame) -> list[tuple]:
            return _placed(int(own["video"].iloc[0]), detector, detector.frame(int(own["frame_no"].iloc[0]), _screens(own)))

        for part in parts:
            rows = part if open_ is None else pd.concat([open_, part])
            last, out = rows["frame_no"].iloc[-1], []
            for _, own in rows[rows["frame_no"] != last].groupby("frame_no", sort=True):
                out += frame(own)
            open_ = rows[rows["frame_no"] == last]
            yield pd.DataFrame(out, columns=names).astype({"page": "Int64"})
        if open_ is not None:
            yield pd.DataFrame(frame(open_), columns=names).astype({"page": "Int64"})

    return rows.repartition("video").sortWithinPartitions(*order).groupBy("video").applyInPandas(fold, f"{EVENTS}, quad {QUAD}")


def detect_events(frames: DataFrame, delay: int = 0) -> DataFrame:
    """Events (EVENTS) of a stream of rows (video, frame_no, quad or null, page or null), a row for each screen.

    A frame without screens is a row without quad. Each frame is whole in one micro-batch, and rows within a batch may be in any
    order. A frame waits until one ``delay`` numbers later has come, so frames may be out of order by that much; what comes
    still later, after a frame behind it was processed, is dropped. The state holds the frames that wait.
    """

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        detector, waiting, done = pickle.loads(state.get[0]) if state.exists else (Detector(), {}, None)
        for number, part in pd.concat(list(parts)).groupby("frame_no", sort=True):
            if done is None or number > done:
                waiting[int(number)] = _screens(part)
        out, latest = [], max(waiting, default=0)
        for number in sorted(n for n in waiting if n <= latest - delay):
            out += [(key[0], *e) for e in detector.frame(number, waiting.pop(number))]
            done = number
        state.update((pickle.dumps((detector, waiting, done)),))
        yield _table(out)

    return frames.groupBy("video").applyInPandasWithState(fold, EVENTS, STATE, "append", GroupStateTimeout.NoTimeout)
