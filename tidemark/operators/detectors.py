"""Detectors by name: functions from DataFrame to DataFrame, to which a user adds their own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import neighbours, positions, postprocess, scenes, tracking

Detector = Callable[..., DataFrame]


def sigmoid_distance(slope: float, intercept: float, threshold: float) -> float:
    """The distance below which a logistic score stays under the threshold; the score grows with the distance."""
    return float((np.log(threshold / (1 - threshold)) - intercept) / slope)


def siamese(screens: DataFrame, pages: DataFrame, below: float | None = None, slope: float | None = None, intercept: float = 0.0, threshold: float = 0.42857142857142855) -> DataFrame:
    """Nearest page whose distance is below ``below``, or gives a logistic score (slope, intercept as trained) below threshold."""
    if below is None and slope is None:
        raise ValueError("a distance, or the slope and intercept of the trained score, is asked for")
    return neighbours.best_or_none(screens, pages, "euclidean", below if below is not None else sigmoid_distance(slope, intercept, threshold))


SCREENS: dict[str, Detector] = {"masks": postprocess.detect_screens, "annotated": positions.annotated_screens}
PAGES: dict[str, Detector] = {
    "imagehash": lambda screens, pages, below=22.0: neighbours.best_or_none(screens, pages, "hamming", below),
    "vgg16": lambda screens, pages, below=0.8979591836734693: neighbours.best_or_none(screens, pages, "angular", below),
    "siamese": siamese,
}
SCENES: dict[str, Detector] = {"none": lambda frames, threshold=0.0: frames, "distance": scenes.scene_filter, "images": scenes.scene_filter_images}
TRACKERS: dict[str, Detector] = {"windows": tracking.track_single, "fold": tracking.track_many}


def extracted(rows: DataFrame, model: Callable[[], Callable[[np.ndarray], np.ndarray]], image: str = "image", size: int = 80) -> DataFrame:
    """id and vec: features of images by an injected model, made once a task and called on at most ``size`` rows."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = model()
        for part in parts:
            for k in range(0, len(part), size):
                some = part.iloc[k : k + size]
                yield pd.DataFrame({"id": some["id"], "vec": list(call(np.array(some[image].tolist(), float)).astype(float))})

    return rows.select("id", F.col(image)).mapInPandas(run, "id long, vec array<double>")
