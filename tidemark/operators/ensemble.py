"""Weighted votes of page detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vote(ballots: DataFrame, quorum: float = 0.0) -> DataFrame:
    """screen, page and votes: the page with most weight, the earliest member's on ties; null below the quorum.

    ballots: screen, member (order in the ensemble), weight, page. No page is a candidate as well. Members without a positive
    weight don't vote.
    """
    sums = ballots.where("weight > 0").groupBy("screen", "page").agg(F.sum("weight").alias("votes"), F.min("member").alias("first"))
    best = sums.groupBy("screen").agg(F.max_by(F.struct("page", "votes"), F.struct(F.round("votes", 9), -F.col("first"))).alias("b"))
    return best.select("screen", F.when(F.col("b.votes") >= quorum, F.col("b.page")).alias("page"), F.col("b.votes").alias("votes"))
