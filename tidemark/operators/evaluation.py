"""Scores an event log, and detected screens, against annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import jaccard


#: Frames of a stretch in which frames and intervals meet.
STRETCH = 64


def shown_pages(log: DataFrame, at: DataFrame) -> DataFrame:
    """at's rows (video, frame_no) with shown: the sorted set of pages on display there, from a table of validity intervals.

    Frames and intervals meet by video and stretch of frames, so a long video is not a product of both; an interval without an
    end goes on to the last frame asked for.
    """
    keys = at.select("video", "frame_no").distinct().withColumn("_s", F.expr(f"frame_no div {STRETCH}"))
    last = keys.groupBy(F.col("video").alias("_v")).agg(F.max("frame_no").alias("_last"))
    spans = log.select(F.col("video").alias("_v"), "page", "shown_from", (F.col("shown_until") - 1).alias("_until")).join(last, "_v")
    spans = spans.withColumn("_until", F.least("_last", F.coalesce("_until", "_last"))).where("shown_from <= _until")
    spans = spans.withColumn("_t", F.explode(F.expr(f"sequence(shown_from div {STRETCH}, _until div {STRETCH})")))
    hits = keys.join(spans, (F.col("video") == F.col("_v")) & (F.col("_s") == F.col("_t")), "left")
    inside = (F.col("shown_from") <= F.col("frame_no")) & (F.col("frame_no") <= F.col("_until"))
    found = hits.groupBy("video", "frame_no").agg(F.array_sort(F.collect_set(F.when(inside, F.col("page")))).alias("shown"))
    return at.join(found, ["video", "frame_no"])


def evaluate_events(log: DataFrame, annotated: DataFrame) -> DataFrame:
    """video, frame_no, success of each annotated frame.

    annotated: video, frame_no, condition, closest (array of pages), one row for each screen. A frame succeeds if each
    pristine screen with closest pages shows one of them, and no more other pages are shown than screens aren't pristine.
    """
    rows = shown_pages(log, annotated)
    pristine = F.col("condition") == "pristine"
    met = ~pristine | (F.size("closest") == 0) | F.arrays_overlap("closest", "shown")
    frames = rows.groupBy("video", "frame_no").agg(
        F.bool_and(F.coalesce(met, F.lit(False))).alias("met"), F.first("shown").alias("shown"), F.count_if(~pristine).alias("others"),
        F.array_distinct(F.flatten(F.collect_list(F.when(pristine, F.col("closest"))))).alias("expected"),
    )
    return frames.select("video", "frame_no", (F.col("met") & (F.size(F.array_except("shown", "expected")) <= F.col("others"))).alias("success"))


def evaluate_strictly(log: DataFrame, annotated: DataFrame) -> DataFrame:
    """A frame (video, frame_no, page or null) succeeds if exactly its page is shown, or nothing where it has none."""
    rows = shown_pages(log, annotated)
    expected = F.when(F.col("page").isNull(), F.array().cast("array<bigint>")).otherwise(F.array(F.col("page").cast("long")))
    return rows.select("video", "frame_no", (F.col("shown") == expected).alias("success"))


def closest_pages(matches: DataFrame) -> DataFrame:
    """screen with the sorted pages full, incremental, and closest: the full ones if there are any, else the incremental."""
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("similarity") == kind, F.col("page"))))
    rows = matches.groupBy("screen").agg(of("full").alias("full"), of("incremental").alias("incremental"))
    return rows.withColumn("closest", F.when(F.size("full") > 0, F.col("full")).otherwise(F.col("incremental")))


def iou_by_frame(expected: DataFrame, found: DataFrame) -> DataFrame:
    """video, frame_no, iou (mean over screens paired from left to right, null if their numbers differ or are 0) and wrong."""

    def numbered(rows: DataFrame, name: str) -> DataFrame:
        order = Window.partitionBy("video", "frame_no").orderBy("quad.tl.x", "quad.tl.y")
        return rows.select("video", "frame_no", F.row_number().over(order).alias("at"), F.col("quad").alias(name))

    both = numbered(expected, "a").join(numbered(found, "b"), ["video", "frame_no", "at"], "full")
    wrong = F.max((F.col("a").isNull() | F.col("b").isNull()).cast("int"))
    scored = both.withColumn("_iou", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), jaccard("a", "b")))
    return scored.groupBy("video", "frame_no").agg(F.avg("_iou").alias("_iou"), wrong.alias("wrong")).select("video", "frame_no", F.when(F.col("wrong") == 0, F.col("_iou")).alias("iou"), (F.col("wrong") == 1).alias("wrong"))
