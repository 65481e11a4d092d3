"""Aligns screens with pages: reads detected screens and page features, writes the event log.

    python -m tidemark --screens SCREENS --pages PAGES --output EVENTS [--scene-detector distance] [--page-detector vgg16]

SCREENS holds Parquet rows (video, frame_no, quad, vec, perhaps ix and, for the scene filter, value); a row without quad is a
frame that shows no screen. PAGES holds rows (id, vec). With --positions, SCREENS holds frames (video, frame_no, at, vec) and
the quadrangles come from the annotated positions of a room's screens. Detectors are looked up by name in operators.detectors.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .configuration import Configuration, load
from .operators import detectors
from .operators.events import screen_events
from .sources.xml_io import read_positions, write_events
from .streaming.detector import detect_batch

#: Page detectors of these metrics, for --metric.
METRICS = {"hamming": "imagehash", "angular": "vgg16", "euclidean": "siamese"}


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("screens", "pages", "output"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--configuration", help="INI file whose values come before the defaults")
    parser.add_argument("--page-detector", choices=sorted(detectors.PAGES))
    parser.add_argument("--metric", choices=sorted(METRICS), default="angular", help="names the page detector by its metric")
    parser.add_argument("--threshold", type=float)
    parser.add_argument("--slope", type=float, help="of a trained score of distances, instead of a threshold")
    parser.add_argument("--intercept", type=float, default=0.0)
    parser.add_argument("--scene-detector", choices=sorted(detectors.SCENES), default="none")
    parser.add_argument("--tracker", choices=sorted(detectors.TRACKERS), default="windows", help="fold takes several screens a frame")
    parser.add_argument("--positions", help="XML of the screens of institutions")
    for name in ("institution", "room", "camera"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--beyond-bounds", action="store_true", help="keeps annotated screens that leave the picture")
    parser.add_argument("--video-uri", help="of the one video; else videos are named by their key")
    parser.add_argument("--document-uri", default="document")
    parser.add_argument("--fps", type=int, default=25)
    parser.add_argument("--overwrite", action="store_true")
    parser.add_argument("--quiet", action="store_true")
    return parser


def matched(screens: DataFrame, pages: DataFrame, given: argparse.Namespace, options: Configuration) -> DataFrame:
    """screens with page, by the page detector asked for."""
    name = given.page_detector or METRICS[given.metric]
    defaults = {"imagehash": float(options.hash_threshold), "vgg16": options.angular_threshold}
    below = given.threshold if given.threshold is not None else defaults.get(name)
    extra = {"slope": given.slope, "intercept": given.intercept, "threshold": options.sigmoid_threshold} if name == "siamese" and below is None and given.slope is not None else {}
    if name == "siamese" and below is None and not extra:
        below = float("inf")
    place = ["video", "frame_no", *(["ix"] if "ix" in screens.columns else [])]
    keyed = screens.withColumn("id", F.xxhash64(*place, "quad"))
    best = detectors.PAGES[name](keyed.where("quad is not null").select("id", "vec"), pages, **({"below": below} if not extra else extra))
    return keyed.join(best.select("id", "page"), "id", "left").drop("id")


def main(args: list[str] | None = None) -> None:
    given = arguments().parse_args(args)
    options = load(given.configuration)
    spark = SparkSession.builder.getOrCreate()
    screens, pages = spark.read.parquet(given.screens), spark.read.parquet(given.pages)
    if given.scene_detector != "none":
        frames = screens.dropDuplicates(["video", "frame_no"])
        kept = detectors.SCENES[given.scene_detector](frames, options.scene_threshold)
        screens = screens.join(kept.select("video", "frame_no"), ["video", "frame_no"], "left_semi")
    if given.positions:
        found = detectors.SCREENS["annotated"](screens.drop("quad"), read_positions(spark, given.positions), given.institution, given.room, given.camera, given.beyond_bounds)
        found = found.withColumn("ix", F.xxhash64("screen"))
        screens = found.unionByName(screens.select("video", "frame_no").distinct(), allowMissingColumns=True)
    rows = matched(screens, pages, given, options)
    log = detect_batch(rows) if given.tracker == "fold" else screen_events(detectors.TRACKERS[given.tracker](rows))
    uris = rows.select("video").distinct().withColumn("video_uri", F.lit(given.video_uri)) if given.video_uri else None
    write_events(log, given.fps, given.output, uris, given.document_uri, "overwrite" if given.overwrite else "errorifexists")
    if not given.quiet:
        print(f"wrote {given.output}")


if __name__ == "__main__":
    main()
