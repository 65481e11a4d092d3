"""Screens from annotated positions: where a room's screens are seen by one of its cameras at a frame's time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import beyond
from .asof import valid_positions


def require(rows: DataFrame, key: dict[str, str], what: str) -> None:
    """Raises KeyError where no row has these values."""
    found = rows
    for name, value in key.items():
        found = found.where(F.col(name) == value)
    if found.isEmpty():
        raise KeyError(f"{what} {key} is not annotated")


def annotated_screens(frames: DataFrame, tables: dict[str, DataFrame], institution: str, room: str, camera: str, beyond_bounds: bool = True) -> DataFrame:
    """frames' columns with screen, quad, aspect_w and aspect_h: a row for each screen that is there at the frame's time (at).

    tables: what ``read_positions`` gives. A screen is there from its installation, or its first position by any camera of the
    room, until before its removal, at the last position known to the camera. Without ``beyond_bounds``, screens with a corner
    outside the camera's picture are left out. Unknown institutions, rooms and cameras raise KeyError.
    """
    place = {"institution": institution, "room": room}
    require(tables["cameras"], {"institution": institution}, "institution")
    require(tables["cameras"], place, "room")
    require(tables["cameras"], {**place, "camera": camera}, "camera")
    here = lambda rows: rows.where((F.col("institution") == institution) & (F.col("room") == room))
    positions = here(tables["positions"])
    first = positions.groupBy("screen").agg(F.min("at").alias("_known"))
    installed = here(tables["screens"]).join(first, "screen", "left").select("screen", "aspect_w", "aspect_h", F.coalesce("installed_from", "_known").alias("_since"), F.col("installed_until").alias("_until"))
    times = frames.crossJoin(F.broadcast(installed))  # the screens of one room
    seen = positions.where(F.col("camera") == camera)
    found = valid_positions(times, seen, ["screen"], "at", F.col("quad"), "quad", until="_until", since="_since").drop("_since", "_until")
    if not beyond_bounds:
        size = here(tables["cameras"]).where(F.col("camera") == camera).select(F.col("width").alias("_w"), F.col("height").alias("_h")).limit(1)
        found = found.crossJoin(F.broadcast(size)).where(~beyond(F.col("quad"), F.col("_w"), F.col("_h"))).drop("_w", "_h")
    return found
