"""Token counts: documents in flat token files that have no index, found by their end-of-document ids.

A file is a stream of 16-bit ids cut into blocks of fixed size, wherever that falls. Each block is searched by itself, all at
once: the places of the separators, and how many tokens stand after the last.
A prefix scan over one line for each block adds the tokens that reach across, and numbers the documents; it runs within groups
of blocks, and over one line for each group, so a large file is no large task.

Spark has no writer for raw bytes, so a file's blocks are rows of Parquet files in the shared folder, each block numbered;
nothing tells where a document lies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, runs
from .tokens import encoder, vocabulary_path

#: Ids in a block.
BLOCK = 1 << 18
#: Blocks of a group are 2 to the power of this.
GROUP = 12
STREAM = "file long, block long, ids binary, doc_id long, document long"


def token_files(docs: DataFrame, end_id: int = 50_256, path: str | None = None) -> DataFrame:
    """Writes flat files: rows (file, block, ids) of blocks, and beside them (file, doc_id, document) in the order written.

    One file for each task; a text's ids, then the end id. Null and empty texts are the end id alone. Texts that hold the
    separator's own words don't make that id. The vocabulary must fit 16 bits; an id that doesn't raises an error.
    """
    path = path or vocabulary_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, file, block, document, rest = encoder(path, plain=True), TaskContext.get().partitionId(), 0, 0, np.zeros(0, np.uint16)
        end = np.array([end_id], np.uint16)

        def rows(blocks: list[bytes], ids: list) -> pa.RecordBatch:
            none_b, none_d = [None] * len(blocks), [None] * len(ids)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([file] * (len(blocks) + len(ids)), pa.int64()), pa.array([*range(block, block + len(blocks)), *none_d], pa.int64()), pa.array([*blocks, *none_d], pa.binary()),
                    pa.array([*none_b, *ids], pa.int64()), pa.array([*none_b, *range(document, document + len(ids))], pa.int64()),
                ],
                [x.split()[0] for x in STREAM.split(", ")],
            )

        for batch in batches:
            for run in runs(batch, "text"):
                parts = [rest]
                for text in run.column("text").to_pylist():
                    ids = np.frombuffer(code.encode(text), "<u4")
                    if len(ids) and int(ids.max()) >= 1 << 16:
                        raise ValueError("an id doesn't fit 16 bits")
                    parts += [ids.astype(np.uint16), end]
                flat = np.concatenate(parts)
                whole = len(flat) // BLOCK
                blocks = [flat[k * BLOCK : (k + 1) * BLOCK].astype("<u2").tobytes() for k in range(whole)]
                rest = flat[whole * BLOCK :].copy()
                ids = run.column("doc_id").to_pylist()
                yield rows(blocks, ids)
                block, document = block + whole, document + len(ids)
        if len(rest):
            yield rows([rest.astype("<u2").tobytes()], [])

    return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(write, STREAM))


def scan_blocks(blocks: DataFrame, end_id: int = 50_256) -> DataFrame:
    """file, block, tokens, ends, tail (ids after the last end) and places (of the ends) of each block."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column("ids"):
                ids = np.frombuffer(data.as_buffer(), "<u2")
                at = np.flatnonzero(ids == end_id)
                rows.append((len(ids), len(at), len(ids) - int(at[-1]) - 1 if len(at) else len(ids), at))
            tokens, ends, tail, places = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), *[pa.array(x, pa.int64()) for x in (tokens, ends, tail)], pa.array(places, pa.list_(pa.int64()))], ["file", "block", "tokens", "ends", "tail", "places"])

    return blocks.select("file", "block", "ids").mapInArrow(scan, "file long, block long, tokens long, ends long, tail long, places array<long>")


def stitched(scans: DataFrame) -> DataFrame:
    """file, document (from 0), start and tokens (its end id not counted) of each document that ends in the files.

    The scan runs over one line for each block: how many ends and ids stand before, and where the last end stood. Ids after a
    file's last end are no document. The places of ends stay out of the sorts.
    """
    inside = Window.partitionBy("file", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    lines = scans.drop("places").withColumn("group", F.shiftright("block", GROUP))
    lines = lines.withColumn("e", F.coalesce(F.sum("ends").over(inside), F.lit(0))).withColumn("i", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    own = F.when(F.col("ends") > 0, F.col("i") + F.col("tokens") - F.col("tail"))
    lines = lines.withColumn("own", own).withColumn("last", F.max("own").over(inside))
    groups = lines.groupBy("file", "group").agg(F.sum("ends").alias("ge"), F.sum("tokens").alias("gi"), F.max("own").alias("gl"))
    before = Window.partitionBy("file").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("e0", F.coalesce(F.sum("ge").over(before), F.lit(0))).withColumn("i0", F.coalesce(F.sum("gi").over(before), F.lit(0)))
    groups = groups.withColumn("l0", F.coalesce(F.max(F.col("i0") + F.col("gl")).over(before), F.lit(0))).select("file", "group", "e0", "i0", "l0")
    lines = lines.where("ends > 0").join(groups, ["file", "group"]).select("file", "block", (F.col("e0") + F.col("e")).alias("ends_before"), (F.col("i0") + F.col("i")).alias("ids_before"), F.coalesce(F.col("i0") + F.col("last"), "l0").alias("open_from"))
    found = lines.join(scans.select("file", "block", "places"), ["file", "block"])
    found = found.select("file", "ends_before", "ids_before", "open_from", F.posexplode("places").alias("k", "at"), "places")
    start = F.when(F.col("k") == 0, F.col("open_from")).otherwise(F.col("ids_before") + F.get("places", F.col("k") - 1) + 1)
    return found.select("file", (F.col("ends_before") + F.col("k")).alias("document"), start.alias("start"), (F.col("ids_before") + F.col("at") - start).alias("tokens"))


def token_counts(docs: DataFrame, end_id: int = 50_256, path: str | None = None) -> DataFrame:
    """doc_id, tokens, file, document and start of every row of docs, counted in the files its text was written to.

    Null and empty texts have 0 tokens. Rows with one doc_id, null ids and repeated rows are documents of their own. A text is
    whole in one task, its ids cut into blocks; an empty table gives an empty result. Other columns are ignored.
    """
    stream = token_files(docs, end_id, path)
    counted = stitched(cut(scan_blocks(stream.where("block is not null"), end_id)))
    names = stream.where("block is null").select("file", "document", "doc_id")
    return names.join(counted, ["file", "document"]).select("doc_id", "tokens", "file", "document", "start")
