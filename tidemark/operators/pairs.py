"""Labelled, weighted pairs of screens and pages for training, and moments of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def training_pairs(screens: DataFrame, pages: DataFrame, matches: DataFrame) -> DataFrame:
    """screen, page, label (0 match, 1 not) and weight of each screen with each page of its video.

    screens: video, screen; pages: video, document, page; matches: screen, document, page, similarity (full or incremental). A
    page of a document with a match weighs 5, one of another document 2; full matches share 1 + the others' sum among all
    matches, and incremental ones are left out. In the end weights average 1. Screens and pages meet by video; without that
    column all are of one.
    """
    if "video" not in screens.columns:
        screens, pages = screens.withColumn("video", F.lit(0)), pages.withColumn("video", F.lit(0))
    hits = matches.groupBy("screen", "document", "page").agg(F.max(F.when(F.col("similarity") == "full", 2).otherwise(1)).alias("hit"))
    near = matches.select("screen", "document").distinct().withColumn("near", F.lit(True))
    every = screens.join(pages, "video").drop("video").join(hits, ["screen", "document", "page"], "left").join(near, ["screen", "document"], "left")
    of_screen = Window.partitionBy("screen")
    other = F.when(F.col("hit").isNull(), F.when(F.col("near"), 5.0).otherwise(2.0))
    every = every.withColumn("_sum", F.coalesce(F.sum(other).over(of_screen), F.lit(0.0))).withColumn("_n", F.count("hit").over(of_screen))
    pairs = every.where("hit is null or hit = 2").select("screen", "page", F.when(F.col("hit") == 2, 0).otherwise(1).cast("long").alias("label"), F.when(F.col("hit") == 2, (1 + F.col("_sum")) / F.col("_n")).otherwise(other).alias("weight"))
    scale = pairs.agg((F.count("*") / F.sum("weight")).alias("scale"))
    return pairs.crossJoin(F.broadcast(scale)).select("screen", "page", "label", (F.col("weight") * F.col("scale")).alias("weight"))


def moments(vectors: DataFrame, column: str = "vec") -> DataFrame:
    """pos, mean and inverse standard deviation (0 where it is infinite) of each element."""
    flat = vectors.select(F.posexplode(column).alias("pos", "x"))
    sums = flat.groupBy("pos").agg(F.avg("x").alias("mean"), F.avg(F.col("x") * F.col("x")).alias("square"))
    spread = F.col("square") - F.col("mean") * F.col("mean")
    return sums.select("pos", "mean", F.when(spread > 1e-15, 1 / F.sqrt(spread)).otherwise(0.0).alias("inverse_std"))


def standardize(vectors: DataFrame, own: DataFrame, column: str = "vec") -> DataFrame:
    """vectors with the column's elements less their mean, by their standard deviation; the moments are one small row."""
    packed = own.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean", "inverse_std"))), lambda m: m).alias("_m"))
    scaled = F.zip_with(column, F.col("_m"), lambda x, m: (x - m["mean"]) * m["inverse_std"])
    return vectors.crossJoin(F.broadcast(packed)).withColumn(column, scaled).drop("_m")
