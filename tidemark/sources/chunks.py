"""Binary artefacts in numbered chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split(rows: DataFrame, name: str, data: str, size: int) -> DataFrame:
    """name, chunk from 0 and part: at most ``size`` bytes each; empty data is one empty chunk."""
    count = F.greatest(F.lit(1), F.ceil(F.octet_length(data) / size)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substr(F.col(data), i * size + 1, F.lit(size)))
    return rows.select(name, F.posexplode(parts).alias("chunk", "part"))


def join(chunks: DataFrame, name: str) -> DataFrame:
    """name and data from the chunks, in any order."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk", F.hex("part").alias("part"))))
    return chunks.groupBy(name).agg(F.unhex(F.array_join(F.transform(ordered, lambda c: c["part"]), "")).alias("data"))
