"""Annotations and events as XML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import quad
from ..functions.scalars import xsd_duration

_SIDES = "".join(f", _{k}{i} double" for i in range(4) for k in "xy").replace(", ", "", 1)
_KEYREFS = "keyrefs struct<keyref: array<struct<_VALUE: string, _similarity: string>>>"
_SCREEN = f"struct<{_SIDES.replace(' double', ': double')}, `_aspect-width`: int, `_aspect-height`: int, _condition: string, _vgg256: string, {_KEYREFS.replace(' struct', ': struct', 1)}>"
#: One row for each video. Lists are declared, as a single child would be read as no list.
VIDEOS = (
    "_uri string, _dirname string, _datetime string, _frames int, _fps int, _width int, _height int, "
    "documents struct<document: array<struct<_filename: string, page: array<struct<_key: string, _number: int, _filename: string, _vgg256: string>>>>>, "
    f"frames struct<frame: array<struct<_filename: string, _number: int, _vgg256: string, screens: struct<screen: array<{_SCREEN}>>>>>"
)
#: One row for each institution.
INSTITUTIONS = (
    "_id string, rooms struct<room: array<struct<_id: string, cameras: struct<camera: array<struct<_id: string, _name: string, _width: int, _height: int>>>, "
    "screens: struct<screen: array<struct<_id: string, _name: string, _from: string, _until: string, `_aspect-width`: int, `_aspect-height`: int, "
    f"positions: array<struct<_camera: string, position: array<struct<{_SIDES.replace(' double', ': double')}, _datetime: string>>>>>>>>>>"
)


def _quad(at: str) -> F.Column:
    c = lambda k, i: F.col(f"{at}._{k}{i}")
    return quad(*[(c("x", i), c("y", i)) for i in range(4)])


def _rows(df: DataFrame, path: str, name: str, *keep) -> DataFrame:
    return df.select(*keep, F.posexplode_outer(path).alias(f"{name}_ix", name)).where(F.col(name).isNotNull())


def read_annotations(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """videos, pages, frames, screens and keyrefs of annotated video files."""
    raw = spark.read.format("xml").schema(VIDEOS).option("rowTag", "video").load(path)
    vectors = lambda c: F.from_json(c, "array<array<double>>")
    docs = _rows(raw, "documents.document", "d", F.col("_uri").alias("video_uri"))
    pages = _rows(docs, "d.page", "p", "video_uri", F.col("d._filename").alias("document"))
    frames = _rows(raw, "frames.frame", "f", F.col("_uri").alias("video_uri"))
    screens = _rows(frames, "f.screens.screen", "s", "video_uri", F.col("f._number").alias("frame_no"))
    refs = _rows(screens, "s.keyrefs.keyref", "k", "video_uri", "frame_no", F.col("s_ix").alias("screen_ix"))
    return {
        "videos": raw.select(F.col("_uri").alias("uri"), F.col("_dirname").alias("dirname"), F.to_timestamp("_datetime").alias("captured_at"), F.col("_frames").alias("frames"), F.col("_fps").alias("fps"), F.col("_width").alias("width"), F.col("_height").alias("height")),
        "pages": pages.select("video_uri", "document", F.col("p._key").alias("key"), F.col("p._number").alias("number"), F.col("p._filename").alias("filename"), vectors("p._vgg256").alias("vgg256")),
        "frames": frames.select("video_uri", F.col("f._number").alias("number"), F.col("f._filename").alias("filename"), vectors("f._vgg256").alias("vgg256")),
        "screens": screens.select("video_uri", "frame_no", F.col("s_ix").alias("screen_ix"), _quad("s").alias("quad"), F.col("s.`_aspect-width`").alias("aspect_w"), F.col("s.`_aspect-height`").alias("aspect_h"), F.col("s._condition").alias("condition"), vectors("s._vgg256").alias("vgg256")),
        "keyrefs": refs.select("video_uri", "frame_no", "screen_ix", F.col("k._VALUE").alias("page_key"), F.col("k._similarity").alias("similarity")),
    }


def read_positions(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """cameras, screens and positions of the rooms of institutions."""
    raw = spark.read.format("xml").schema(INSTITUTIONS).option("rowTag", "institution").load(path)
    rooms = _rows(raw, "rooms.room", "r", F.col("_id").alias("institution")).withColumn("room", F.col("r._id"))
    cameras = _rows(rooms, "r.cameras.camera", "c", "institution", "room")
    screens = _rows(rooms, "r.screens.screen", "s", "institution", "room").withColumn("screen", F.col("s._id"))
    lists = _rows(screens, "s.positions", "l", "institution", "room", "screen").withColumn("camera", F.col("l._camera"))
    found = _rows(lists, "l.position", "p", "institution", "room", "screen", "camera")
    return {
        "cameras": cameras.select("institution", "room", F.col("c._id").alias("camera"), F.col("c._name").alias("name"), F.col("c._width").alias("width"), F.col("c._height").alias("height")),
        "screens": screens.select("institution", "room", "screen", F.col("s._name").alias("name"), F.to_timestamp("s._from").alias("installed_from"), F.to_timestamp("s._until").alias("installed_until"), F.col("s.`_aspect-width`").alias("aspect_w"), F.col("s.`_aspect-height`").alias("aspect_h")),
        "positions": found.select("institution", "room", "screen", "camera", F.to_timestamp("p._datetime").alias("at"), _quad("p").alias("quad")),
    }


def event_elements(log: DataFrame, fps: int, document: str = "document") -> DataFrame:
    """video, frame_no, phase and element: the text of one event's XML element, attributes in a fixed order.

    The document's uri is the log's column document_uri if it has one, else ``document``.
    """
    from ..functions.scalars import elapsed_micros

    text = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), '"', "&quot;")
    attribute = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f' {name}="'), text(value.cast("string")), F.lit('"'))).otherwise("")
    corners = [attribute(k + str(i), F.col(f"quad.{c}.{k}")) for i, c in enumerate(("tl", "tr", "bl", "br")) for k in "xy"]
    placed = F.when(F.col("kind").isin("appeared", "moved"), F.concat(*corners)).otherwise("")
    uri = F.col("document_uri") if "document_uri" in log.columns else F.lit(document)
    paged = F.when(F.col("page").isNotNull(), F.concat(attribute("document-uri", uri), attribute("page-number", F.col("page")))).otherwise("")
    name = F.concat(F.lit("screen-"), F.col("kind"), F.lit("-event"))
    head = [attribute("screen-id", F.col("screen_id")), attribute("frame-number", F.col("frame_no")), attribute("frame-duration", xsd_duration(elapsed_micros(F.col("frame_no"), fps)))]
    return log.select("video", "frame_no", "phase", "screen_id", "kind", F.concat(F.lit("<"), name, *head, paged, placed, F.lit("/>")).alias("element"))


def event_documents(log: DataFrame, fps: int, uris: DataFrame | None = None, document: str = "document") -> DataFrame:
    """video and xml: one whole document for each video, its events in order.

    uris (video, video_uri) names the videos; without it a video's uri is its key.
    """
    lines = F.array_sort(F.collect_list(F.struct("frame_no", "phase", "screen_id", "kind", "element")))
    body = F.array_join(F.transform(lines, lambda e: e["element"]), "\n")
    rows = event_elements(log, fps, document).groupBy("video").agg(body.alias("body"))
    rows = rows.withColumn("uri", F.col("video").cast("string")) if uris is None else rows.join(uris.select("video", F.col("video_uri").alias("uri")), "video", "left")
    uri = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce("uri", F.col("video").cast("string")), "&", "&amp;"), "<", "&lt;"), '"', "&quot;")
    return rows.select("video", F.concat(F.lit('<events video-uri="'), uri, F.lit('">\n'), F.col("body"), F.lit("\n</events>")).alias("xml"))


def write_events(log: DataFrame, fps: int, path: str, uris: DataFrame | None = None, document: str = "document", mode: str = "errorifexists") -> None:
    """One text file part for each partition of videos; a document is never split between files."""
    event_documents(log, fps, uris, document).select("xml").write.mode(mode).text(path)
