"""Change events of tracked screens: appeared, changed content, moved, disappeared."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tracking import placed

KINDS = ("disappeared", "appeared", "changed-content", "moved")


def screen_events(tracked: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """video, frame_no, phase, kind, screen_id, page, quad of every change in videos with at most one screen a frame.

    tracked: video, frame_no, track, page (null: no match), quad and next_frame, as track_single gives it; where the processed
    frames were not known to it, frames has them. One pass over one sort by video gives the none to three events of a row: an
    event of a lost track carries the number of the next processed frame, if there is one, and comes first in it. A match after
    none gets a new id, also on the same track.
    """
    order = Window.partitionBy("video").orderBy("frame_no")
    rows = tracked if frames is None else placed(tracked, frames)
    same = F.lag("track").over(order) == F.col("track")
    rows = rows.withColumn("_page", F.when(same, F.lag("page").over(order))).withColumn("_quad", F.when(same, F.lag("quad").over(order)))
    rows = rows.withColumn("_lost", ~F.coalesce(F.lead("track").over(order) == F.col("track"), F.lit(False)) & F.col("next_frame").isNotNull())
    rows = rows.withColumn("_on", F.col("page").isNotNull()).withColumn("_was", F.col("_page").isNotNull())
    rows = rows.withColumn("_no", F.sum((F.col("_on") & ~F.col("_was")).cast("long")).over(order))
    on, was = F.col("_on"), F.col("_was")
    no_page, no_quad = F.lit(None).cast("long"), F.lit(None).cast(dict(tracked.dtypes)["quad"])

    def event(when, kind: str, frame=F.col("frame_no"), phase: int = 1, page=no_page, quad=no_quad):
        return F.when(when, F.struct(frame.alias("frame_no"), F.lit(phase).alias("phase"), F.lit(kind).alias("kind"), page.alias("page"), quad.alias("quad")))

    made = F.array(
        event(on & ~was, "appeared", page=F.col("page"), quad=F.col("quad")),
        event(on & was & (F.col("page") != F.col("_page")), "changed-content", page=F.col("page")),
        event(on & was & (F.col("quad") != F.col("_quad")), "moved", phase=2, quad=F.col("quad")),
        event(~on & was, "disappeared", quad=F.col("_quad")),
        event(on & F.col("_lost"), "disappeared", F.col("next_frame"), 0, quad=F.col("quad")),
    )
    flat = rows.select("video", F.concat(F.lit("screen-"), F.col("_no").cast("string")).alias("screen_id"), F.inline(F.filter(made, lambda e: e.isNotNull())))
    return flat.select("video", "frame_no", "phase", "kind", "screen_id", "page", "quad")


def collapse_equal(screens: DataFrame) -> DataFrame:
    """Of a frame's screens with equal quadrangles, the last by ix stays."""
    best = screens.groupBy("video", "frame_no", "quad").agg(F.max("ix").alias("ix"))
    return screens.join(best.select("video", "frame_no", "ix"), ["video", "frame_no", "ix"], "left_semi")


def contract_violations(events: DataFrame) -> DataFrame:
    """Rules an event log keeps, and how often it breaks each."""
    per = events.groupBy("video", "screen_id", "frame_no").agg(F.count("*").alias("n"), F.max(F.col("kind").isin("appeared", "disappeared").cast("int")).alias("alone"))
    twice = events.where(F.col("kind").isin("appeared", "disappeared")).groupBy("video", "screen_id", "kind").agg(F.count("*").alias("n"))
    count = lambda df, rule: df.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")
    return count(per.where("alone = 1 and n > 1"), "exclusive").union(count(twice.where("kind = 'appeared' and n > 1"), "appeared once")).union(count(twice.where("kind = 'disappeared' and n > 1"), "disappeared once"))


def validity(events: DataFrame) -> DataFrame:
    """video, screen_id, page, shown_from, shown_until (exclusive, null: to the end) from a log; moves don't count."""
    order = Window.partitionBy("video", "screen_id").orderBy("frame_no", "phase")
    rows = events.where("kind <> 'moved'").withColumn("shown_until", F.lead("frame_no").over(order))
    return rows.where("kind <> 'disappeared'").select("video", "screen_id", "page", F.col("frame_no").alias("shown_from"), "shown_until")
