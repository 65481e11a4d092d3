"""Packing: documents become sequences of a fixed number of tokens with little padding (minimum bin slack).

Each document is cut at multiples of the window; what remains is shorter than a window. The plan for the
remaining lengths needs only how many there are of each length, so it is made on the driver from at most
``window`` counts, whatever the number of documents. One window at a time: the longest remaining length opens it, a
subset-sum dynamic programme over the multiset of the other lengths (bits of one integer, a bit for each
reachable sum) finds the fill closest to the window, and backtracking through the stored bit sets gives the counts
that make it. The same fill is used as often as the counts allow, so the plan has few lines.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, give_back, runs
from .tokens import encoder, vocabulary_path

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, ordinal long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def padding(length: int, window: int) -> int:
    """Tokens added to a sequence: it is filled to the window, but one whose length is a power of two stays as it is."""
    return 0 if length & (length - 1) == 0 else window - length


def best_fill(counts: dict[int, int], room: int, cost) -> dict[int, int]:
    """The multiset of lengths, each at most as often as counted, whose sum s has the least cost(s), then is largest.

    Bounded counts are split into powers of two, so a length with count c takes about log2(c) shifts.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left > 0:
            k = min(k, left)
            steps.append((reach, length, k))
            reach |= (reach << (length * k)) & mask
            left -= k
            k *= 2
        if reach >> room & 1:
            break
    if reach >> room & 1 and not cost(room):
        total = room
    else:
        total = min((s for s in range(room, -1, -1) if reach >> s & 1), key=lambda s: (cost(s), -s))
    fill: dict[int, int] = {}
    for before, length, k in reversed(steps):
        if not before >> total & 1:
            fill[length] = fill.get(length, 0) + k
            total -= length * k
    return fill


def plan_windows(counts: dict[int, int], window: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: how often it lies in each}) until all counts are used up."""
    counts, plan = {k: v for k, v in counts.items() if v > 0}, []
    while counts:
        longest = max(counts)
        rest = counts | {longest: counts[longest] - 1}
        fill = best_fill({k: v for k, v in rest.items() if v}, window - longest, lambda s, x=longest: padding(x + s, window))
        fill[longest] = fill.get(longest, 0) + 1
        times = min(counts[k] // n for k, n in fill.items())
        for k, n in fill.items():
            counts[k] -= times * n
            if not counts[k]:
                del counts[k]
        plan.append((times, fill))
    return plan


def plan_table(plan: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first rank, how often in each window, first sequence, offset), by length and first rank."""
    rows, used, sequence = [], {}, 0
    for times, fill in plan:
        offset = 0
        for length, n in sorted(fill.items(), reverse=True):
            rows.append((length, used.get(length, 0), n, sequence, offset))
            used[length] = used.get(length, 0) + times * n
            offset += length * n
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def cut_documents(docs: DataFrame, window: int, end_id: int, path: str) -> DataFrame:
    """One row for each piece; ``ordinal`` counts the pieces of the same length within the task ``part``."""
    end = np.array([end_id], "<u4").tobytes()

    def cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, seen = encoder(path), TaskContext.get().partitionId(), {}
        for batch in batches:
            for run in runs(batch, "text"):
                rows = []
                for doc_id, text in zip(run.column("doc_id").to_pylist(), run.column("text").to_pylist(), strict=True):
                    ids = code.encode(text) + end
                    total = len(ids) // 4
                    for start in range(0, total, window):
                        length = min(window, total - start)
                        ordinal = seen.get(length, 0)
                        seen[length] = ordinal + 1
                        rows.append((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total, part, ordinal))
                names = [x.split()[0] for x in PIECES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names)
        code.clear()  # the worker may go on to other work
        give_back()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut_batches, PIECES)


def pack(docs: DataFrame, window: int = 2048, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Packs every document (columns doc_id, text) and returns one row for each piece (PACKED).

    Null and empty texts are a document of the end id alone. A repeated row is packed again as a document of its own. A
    null doc_id stays null. Other columns are ignored. An empty table gives an empty result. Sequences are numbered from
    0; within one, offsets run from 0 without gaps.

    Texts are read and encoded once and never shuffled: the pieces (seven numbers each) are written to the shared folder,
    counted by length, and ranked within their length by adding the counts of the tasks before theirs.
    """
    pieces = cut(cut_documents(docs, window, end_id, path or vocabulary_path()))
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most window rows
    table = plan_table(plan_windows(counts, window))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranked = pieces.join(by_part.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"), ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("ordinal"))
    key = table[:, 0] << 48 | table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(x).to_numpy() for x in ("length", "rank"))
            line = table[np.searchsorted(key, length << 48 | rank, "right") - 1]
            nth, slot = np.divmod(rank - line[:, 1], line[:, 2])
            placed = {"sequence_id": pa.array(line[:, 3] + nth), "offset": pa.array(line[:, 4] + slot * length)}
            yield pa.RecordBatch.from_arrays([placed[x] if x in placed else batch.column(x) for x in names], names)

    names = [x.split()[0] for x in PACKED.split(", ")]
    return ranked.mapInArrow(place, PACKED)
