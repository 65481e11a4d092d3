"""The scene filter: a frame stays if it differs enough from the last one that stayed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import images

THRESHOLD, WIDTH, HEIGHT = 0.15, 320, 240


def fold_frames(frames: DataFrame, columns: list[str], differs: Callable[[object, object], bool], value: str) -> DataFrame:
    """The rows (columns) of frames that stay, going by the frames of each video in order.

    Each comparison depends on the ones before, so a video is one task; its rows stream through in batches, and only the value
    of the last frame that stayed is held.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, any_ = None, False
        for batch in batches:
            stay = []
            for x in batch.column(value):
                x = x.as_py()
                if not any_ or differs(x, kept):
                    kept, any_ = x, True
                    stay.append(True)
                else:
                    stay.append(False)
            yield batch.select(columns).filter(pa.array(stay, pa.bool_()))

    rows = frames.select(*dict.fromkeys([*columns, "video", "frame_no", value]))
    ordered = rows.repartition("video").sortWithinPartitions("video", "frame_no")
    return ordered.groupBy("video").applyInArrow(fold, rows.select(*columns).schema)


def scene_filter(frames: DataFrame, threshold: float = THRESHOLD, wrap: bool = False, value: str = "value") -> DataFrame:
    """frames' video, frame_no and value where ((value - kept) / 255) squared is over the threshold; each first frame stays.

    With ``wrap``, values are whole numbers below 256 and their difference is taken modulo 256.
    """

    def differs(x: float, kept: float) -> bool:
        gap = (x - kept) % 256.0 if wrap else x - kept
        return (gap / 255.0) * (gap / 255.0) > threshold

    return fold_frames(frames, ["video", "frame_no", value], differs, value).withColumnRenamed(value, "value")


def thumbnails(frames: DataFrame, width: int = WIDTH, height: int = HEIGHT) -> DataFrame:
    """video, frame_no and small: frames (height, width, image as RGBA bytes) in a box of that size, in Lab, row by row."""

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # one image at a time is held
                row = batch.slice(k, 1).to_pylist()[0]
                image = np.frombuffer(row["image"], np.uint8).reshape(row["height"], row["width"], -1)
                small = images.lab(images.render(image, width, height)[..., :3]).tobytes()
                yield pa.RecordBatch.from_arrays([batch.column("video").slice(k, 1), batch.column("frame_no").slice(k, 1), pa.array([small], pa.binary())], ["video", "frame_no", "small"])

    rows = frames.select("video", "frame_no", F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"), "image")
    return rows.mapInArrow(shrink, rows.select("video", "frame_no").withColumn("small", F.lit(None).cast("binary")).schema)


def scene_filter_images(frames: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, height: int = HEIGHT, wrap: bool = False) -> DataFrame:
    """video and frame_no of the frames whose image, small and in Lab, has a mean squared error over the threshold to the last
    one that stayed. Images are shrunk where they lie; only the small ones are shuffled and folded."""

    def differs(x: bytes, kept: bytes) -> bool:
        return images.mean_squared_error(np.frombuffer(x, np.uint8), np.frombuffer(kept, np.uint8), wrap) > threshold

    return fold_frames(thumbnails(frames, width, height), ["video", "frame_no"], differs, "small")
