"""Spatial join of quadrangles by overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.geometry import CORNERS, bounds

#: Quadrangles of one side of a row of the join, and pairs that are measured at once.
CHUNK, PAIRS = 128, 65_536


class _Rings:
    """Quadrangles of a list column, as outlines that run counter-clockwise, with boxes and areas."""

    def __init__(self, column: pa.ListArray):
        quads = column.flatten()
        self.ids, self.counts = quads.field("id"), np.diff(column.offsets.to_numpy())
        x, y = (np.array([quads.field(c + k).to_numpy(zero_copy_only=False) for c in ("tl", "tr", "br", "bl")], float).reshape(4, len(quads)) for k in "xy")
        self.left, self.right, self.top, self.bottom = x.min(0), x.max(0), y.min(0), y.max(0)
        cross = x * np.roll(y, -1, 0) - np.roll(x, -1, 0) * y
        signed = (cross[0] + cross[1] + cross[2] + cross[3]) / 2
        self.area = np.abs(signed)
        self.x, self.y = (np.where(signed < 0, v[::-1], v) for v in (x, y))


def _inside(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, second: bool) -> np.ndarray:
    """Sums over the parts of a's sides inside b of half the cross product of their ends; see geometry.overlap."""
    total = np.zeros(ax.shape[1])
    for e in range(4):
        px, py, ex, ey = ax[e], ay[e], ax[(e + 1) % 4] - ax[e], ay[(e + 1) % 4] - ay[e]
        qx, qy = ax[(e + 1) % 4], ay[(e + 1) % 4]
        t0, t1, gone = np.zeros(len(px)), np.ones(len(px)), np.zeros(len(px), bool)
        for c in range(4):
            cx, cy, dx, dy = bx[c], by[c], bx[(c + 1) % 4] - bx[c], by[(c + 1) % 4] - by[c]
            d0, d1 = dx * (py - cy) - dy * (px - cx), dx * (qy - cy) - dy * (qx - cx)
            cut, on = d0 / (d0 - d1), (d0 == 0) & (d1 == 0)
            t0 = np.where((d0 < 0) & (d1 > d0), np.maximum(t0, cut), t0)
            t1 = np.where((d1 < 0) & (d0 > d1), np.minimum(t1, cut), t1)
            out = (d0 <= 0) & (d1 <= 0) & ~on | on & (second | (ex * dx + ey * dy < 0))
            gone |= out & ((dx != 0) | (dy != 0))
        part = ((px + t0 * ex) * (py + t1 * ey) - (px + t1 * ex) * (py + t0 * ey)) / 2
        total += np.where(~gone & (t1 > t0), part, 0)
    return total


def _pairs(a: _Rings, b: _Rings, cells: tuple[np.ndarray, np.ndarray], cell: float, first: int, last: int) -> tuple[np.ndarray, ...]:
    """Row, place in a, place in b, inter and jaccard of the pairs that overlap in the rows from first up to last."""
    counts = a.counts[first:last] * b.counts[first:last]
    row = np.repeat(np.arange(first, last), counts)
    k = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    i, j = (np.cumsum(x.counts) - x.counts for x in (a, b))
    i, j = i[row] + k // b.counts[row], j[row] + k % b.counts[row]
    x, y = np.maximum(a.left[i], b.left[j]), np.maximum(a.top[i], b.top[j])
    near = (x < np.minimum(a.right[i], b.right[j])) & (y < np.minimum(a.bottom[i], b.bottom[j])) & (np.floor(x / cell) == cells[0][row]) & (np.floor(y / cell) == cells[1][row])
    row, i, j = row[near], i[near], j[near]
    with np.errstate(all="ignore"):
        ax, ay, bx, by = a.x[:, i], a.y[:, i], b.x[:, j], b.y[:, j]
        inter = _inside(ax, ay, bx, by, False) + _inside(bx, by, ax, ay, True)
        some = (inter > 0) & (a.area[i] > 0) & (b.area[j] > 0)
        row, i, j, inter = row[some], i[some], j[some], inter[some]
        return row, i, j, inter, inter / (a.area[i] + b.area[j] - inter)


def jaccard_join(left: DataFrame, right: DataFrame, keys: list[str], cell: float = 64.0) -> DataFrame:
    """Pairs (id, other, keys, inter, jaccard) of quadrangles that overlap; both sides have id and quad.

    Boxes are put into the cells of a grid that they touch, which gives an equi-join; a pair that shares several cells is
    taken in the one that holds the upper left corner of the boxes' intersection, so there is nothing to make distinct. A
    cell's quadrangles travel in chunks, a row of the join holds a chunk of either side, and the pairs of a row are measured
    at once.
    """
    place = [*keys, "_cx", "_cy"]

    def chunked(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.withColumn("_box", bounds(F.col("quad")))
        spans = [F.explode(F.sequence(F.floor(F.col(f"_box.{a}") / cell), F.floor(F.col(f"_box.{b}") / cell))) for a, b in (("left", "right"), ("top", "bottom"))]
        corners = [F.col(f"quad.{c}.{k}").cast("double").alias(c + k) for c in CORNERS for k in "xy"]
        rows = rows.withColumn("_cx", spans[0]).withColumn("_cy", spans[1]).select(*place, F.struct("id", *corners).alias("one"))
        chunk = F.floor((F.row_number().over(Window.partitionBy(*place).orderBy("one.id")) - 1) / CHUNK)
        return rows.withColumn("_chunk", chunk).groupBy(*place, "_chunk").agg(F.collect_list("one").alias(name)).drop("_chunk")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _Rings(batch.column("_a")), _Rings(batch.column("_b"))
            cells = tuple(batch.column(c).to_numpy() for c in ("_cx", "_cy"))
            ends = np.cumsum(a.counts * b.counts)
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS, "right")))
                row, i, j, inter, jaccard = _pairs(a, b, cells, cell, first, last)
                columns = [*[batch.column(k).take(pa.array(row)) for k in keys], a.ids.take(pa.array(i)), b.ids.take(pa.array(j)), pa.array(inter), pa.array(jaccard)]
                yield pa.RecordBatch.from_arrays(columns, [*keys, "id", "other", "inter", "jaccard"])
                first = last

    found = [*[left.schema[k] for k in keys], left.schema["id"], StructField("other", right.schema["id"].dataType), StructField("inter", DoubleType()), StructField("jaccard", DoubleType())]
    return chunked(left, "_a").join(chunked(right, "_b"), place).mapInArrow(measure, StructType(found))


class QuadSet:
    """A set of quadrangles within keys, as rows (keys, id, quad), and what overlaps in it: an index by grid cells."""

    def __init__(self, rows: DataFrame, keys: list[str]):
        self.keys = keys
        self.rows = rows.select(*keys, "id", "quad").dropDuplicates([*keys, "quad"])

    def add(self, rows: DataFrame) -> QuadSet:
        """With those rows that it doesn't hold yet."""
        new = rows.select(*self.keys, "id", "quad").join(self.rows.select(*self.keys, "quad"), [*self.keys, "quad"], "left_anti")
        return QuadSet(self.rows.unionByName(new), self.keys)

    def discard(self, rows: DataFrame) -> QuadSet:
        """Without the quadrangles of these rows; what it doesn't hold is passed over."""
        return QuadSet(self.rows.join(rows.select(*self.keys, "quad"), [*self.keys, "quad"], "left_anti"), self.keys)

    def holds(self, rows: DataFrame) -> DataFrame:
        """The rows whose quadrangle it holds."""
        return rows.join(self.rows.select(*self.keys, "quad"), [*self.keys, "quad"], "left_semi")

    def overlapping(self, rows: DataFrame) -> DataFrame:
        """keys, id of a row, other (the id here), inter and jaccard of all that overlap."""
        return jaccard_join(rows, self.rows, self.keys)
