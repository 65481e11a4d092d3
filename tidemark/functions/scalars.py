"""Scalar expressions: clocks, durations, sizes, intervals."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def elapsed_micros(frame_no: Column, fps: int) -> Column:
    """Microseconds from the start of a video to a frame, frames counted from 1; half to even."""
    return F.bround((frame_no - 1) * F.lit(1_000_000.0) / fps, 0).cast("long")


def upscale_aspect(width: Column, height: Column, aspect_w: Column, aspect_h: Column) -> Column:
    """Makes one side longer so that the sides have the aspect ratio; half to even. A side or ratio of 0 is an error."""
    wide = width * aspect_h < height * aspect_w
    w = F.when(wide, F.bround(height * aspect_w / aspect_h, 0)).otherwise(width).cast("long")
    h = F.when(wide, height).otherwise(F.bround(width * aspect_h / aspect_w, 0)).cast("long")
    bad = (width <= 0) | (height <= 0) | (aspect_w <= 0) | (aspect_h <= 0)
    checked = lambda x: F.when(bad, F.raise_error(F.lit("sides and aspect ratio must be positive")).cast("long")).otherwise(x)
    return F.struct(checked(w).alias("width"), checked(h).alias("height"))


def rescale_box(width: Column, height: Column, new_width: Column, new_height: Column) -> Column:
    """Size within a box of the same aspect ratio, and margins; one null side follows the other, cut; both null change nothing."""
    ratio = F.least(new_width / width, new_height / height)
    w, h = F.bround(width * ratio, 0), F.bround(height * ratio, 0)
    both, none = new_width.isNotNull() & new_height.isNotNull(), new_width.isNull() & new_height.isNull()
    only_h = new_width.isNull()
    out_w = F.when(both, w).when(none, width).when(only_h, F.floor(new_height * width / height)).otherwise(new_width).cast("long")
    out_h = F.when(both, h).when(none, height).when(only_h, new_height).otherwise(F.floor(new_width * height / width)).cast("long")
    margin = lambda box, side, cut: F.when(both, cut((box - side) / 2)).otherwise(0).cast("long")
    return F.struct(
        out_w.alias("width"), out_h.alias("height"), margin(new_height, h, F.floor).alias("top"), margin(new_height, h, F.ceil).alias("bottom"),
        margin(new_width, w, F.floor).alias("left"), margin(new_width, w, F.ceil).alias("right"),
    )


def xsd_duration(micros: Column, padded: bool = True) -> Column:
    """P{days}DT{seconds}.{microseconds}S; unpadded, the microseconds lose their leading zeros."""
    rest = (micros % 1_000_000).cast("string")
    return F.concat(F.lit("P"), F.floor(micros / 86_400_000_000).cast("string"), F.lit("DT"), F.floor(micros % 86_400_000_000 / 1_000_000).cast("string"), F.lit("."), F.lpad(rest, 6, "0") if padded else rest, F.lit("S"))


def duration_micros(text: Column) -> Column:
    """Reads what xsd_duration writes unpadded or padded to six digits."""
    part = lambda i: F.regexp_extract(text, r"^P(\d+)DT(\d+)\.(\d+)S$", i).cast("long")
    return part(1) * 86_400_000_000 + part(2) * 1_000_000 + part(3)


def wald_interval(successes: Column, trials: Column, alpha: float = 0.05) -> Column:
    """Share of successes, and the bounds of the adjusted Wald interval at error rate alpha, within 0 and 1."""
    z = NormalDist().inv_cdf(1 - alpha / 2)
    bad = (trials <= 0) | (successes > trials)
    k = F.when(bad, F.raise_error(F.lit("successes must be at most trials, and trials positive")).cast("double")).otherwise(successes.cast("double"))
    n = trials + z * z
    p = (k + z * z / 2) / n
    radius = z * F.sqrt(p * (1 - p) / n)
    return F.struct((k / trials).alias("share"), F.greatest(F.lit(0.0), p - radius).alias("low"), F.least(F.lit(1.0), p + radius).alias("high"))


def batch_no(ordinal: Column, size: int) -> Column:
    """Number from 0 of the batch that holds an ordinal from 1."""
    return F.floor((ordinal - 1) / size)


def bigger_than(area: Column, bound: float, width: int = 720, height: int = 576) -> Column:
    """Whether an area is more than bound percent of the configured frame."""
    return F.lit(bound) < area * 100 / (width * height)


def path_tail(path: Column) -> Column:
    """The last two parts of a path."""
    parts = F.split(path, "/")
    return F.concat_ws("/", F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(-1)))


def uri_parts(uri: Column) -> Column:
    """Scheme, domain under the host, section and name of a page address."""
    part = lambda i: F.regexp_extract(uri, r"^(https?)://([^/?#]+)/([a-z]+)/([^?#]*)", i)
    return F.struct(part(1).alias("scheme"), part(2).alias("host"), part(3).alias("section"), part(4).alias("name"))
