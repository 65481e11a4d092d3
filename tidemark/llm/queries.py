"""One query for each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import jpeg, language, mixing, nearjoin, packing, private, separators, sketch, toolcalls, urls
from .shared import table


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict(table(spark, sf_dir, "documents"))


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearjoin.near_groups(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.media_digest(table(spark, sf_dir, "documents"))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprints(table(spark, sf_dir, "documents"))


def op8_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.digest(table(spark, sf_dir, "documents"))


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.token_counts(table(spark, sf_dir, "documents"))


def op10_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.formatted(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_language": op1_language, "op2_urls": op2_urls, "op3_mix": op3_mix, "op4_pack": op4_pack, "op5_near": op5_near, "op6_media": op6_media, "op7_fingerprint": op7_fingerprint, "op8_private": op8_private, "op9_tokens": op9_tokens, "op10_toolcalls": op10_toolcalls}
ORACLES: dict[str, str] = {"op5_near": nearjoin.SQL, "op10_toolcalls": toolcalls.FORMATTED_SQL}
