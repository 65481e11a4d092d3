"""What training leaves behind: moments with a version, model bytes in chunks, and parameters as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT_VERSION = 1


def save_moments(moments: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Writes pos, mean, inverse_std with the version of the format."""
    moments.select("pos", "mean", "inverse_std", F.lit(FORMAT_VERSION).alias("format_version")).write.mode(mode).parquet(path)


def load_moments(spark: SparkSession, path: str) -> DataFrame:
    """Moments as saved; ValueError where another version wrote any of them."""
    rows = spark.read.parquet(path)
    if "format_version" not in rows.columns or not rows.where(~F.col("format_version").eqNullSafe(F.lit(FORMAT_VERSION))).isEmpty():
        raise ValueError(f"{path} has another format than version {FORMAT_VERSION}")
    return rows.select("pos", "mean", "inverse_std")


def numbers(text: str) -> list[float]:
    """Numbers separated by a comma and a blank."""
    return [float(x) for x in text.split(", ")] if text else []


def learning_rates(text: str) -> tuple[float, float]:
    """One rate, or the least and the largest of a range."""
    found = numbers(text)
    if len(found) not in (1, 2):
        raise ValueError("one or two learning rates are asked for")
    return found[0], found[-1]


def methods(text: str, names: tuple[str, ...] = ("base", "erosion_dilation", "ratio_split")) -> dict[str, bool]:
    """Which methods are on: as many on/off words as there are methods."""
    words = [x.strip().lower() for x in text.split(",")]
    known = {"on": True, "true": True, "1": True, "yes": True, "off": False, "false": False, "0": False, "no": False}
    if len(words) != len(names) or any(w not in known for w in words):
        raise ValueError(f"an on or off is asked for each of {', '.join(names)}")
    return {n: known[w] for n, w in zip(names, words, strict=True)}
