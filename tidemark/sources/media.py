"""Media sources: videos, page documents and image directories as DataFrames. Decoders are callables, as none is bundled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FRAMES = "video_uri string, frame_no long, elapsed_us long, width int, height int, image binary"
PAGES = "document_uri string, page_no int, title string, author string, width int, height int, image binary"


def routed(paths: DataFrame, path: str = "path") -> DataFrame:
    """Adds reader: pdf for names that end so in any case, else images."""
    return paths.withColumn("reader", F.when(F.lower(path).endswith(".pdf"), "pdf").otherwise("images"))


def _decoded(spark: SparkSession, folder: str, glob: str, decode: Callable, schema: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                rows = [(path, *row) for row in decode(bytes(content))]
                if not rows:
                    raise ValueError(f"{path} has nothing that can be read")
                yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, schema)


def videos(spark: SparkSession, folder: str, decode: Callable[[bytes], Iterator[tuple]], glob: str = "*") -> DataFrame:
    """Frames (FRAMES) of every file; decode yields (frame_no from 1, elapsed_us, width, height, RGBA bytes)."""
    return _decoded(spark, folder, glob, decode, FRAMES)


def documents(spark: SparkSession, folder: str, decode: Callable[[bytes], Iterator[tuple]], glob: str = "*.[pP][dD][fF]") -> DataFrame:
    """Pages (PAGES) of every file; decode yields (page_no, title, author, width, height, RGBA bytes). No page is an error."""
    return _decoded(spark, folder, glob, decode, PAGES)


#: Names of files that an image directory takes for pages.
IMAGES = r"(?i)\.(png|jpe?g|gif|bmp|tiff?|webp)$"


def image_directory(spark: SparkSession, folder: str, pattern: str = IMAGES) -> DataFrame:
    """document_uri, page_no from 1 by path, path and content of a directory's images: each directory is a document.

    Files of other names are passed over; ValueError where no image is left.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.col("path").rlike(pattern))
    if files.select("path").isEmpty():
        raise ValueError(f"{folder} has no images")
    rows = files.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("document_uri"), "path", "content")
    return numbered(rows, "document_uri", F.col("path"))


def numbered(rows: DataFrame, document: str, order: Column) -> DataFrame:
    """Adds page_no from 1 within each document."""
    return rows.withColumn("page_no", F.row_number().over(Window.partitionBy(document).orderBy(order)))
