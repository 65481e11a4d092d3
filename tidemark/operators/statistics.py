"""Statistics over grouped rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def benjamini_hochberg(rows: DataFrame, p: str, ties: str, keys: list[str]) -> DataFrame:
    """Adds q: the false-discovery rate at which a p-value counts within its group, p times n by rank, from the largest down."""
    own = Window.partitionBy(*keys)
    rank = F.row_number().over(own.orderBy(p, ties))
    rows = rows.withColumn("_rank", rank).withColumn("_n", F.count("*").over(own))
    down = own.orderBy(F.col("_rank").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    q = F.min(F.col(p) * F.col("_n") / F.col("_rank")).over(down)
    return rows.withColumn("q", F.least(F.lit(1.0), F.greatest(F.lit(0.0), q))).drop("_rank", "_n")


def ks_uniform(rows: DataFrame, share: Column, keys: list[str], ties: str) -> DataFrame:
    """Kolmogorov-Smirnov statistic of values between 0 and 1 against the uniform distribution, by group."""
    rows = rows.withColumn("_f", share)
    own = Window.partitionBy(*keys)
    rows = rows.withColumn("_r", F.row_number().over(own.orderBy("_f", ties))).withColumn("_n", F.count("*").over(own))
    return rows.groupBy(*keys).agg(F.max(F.greatest(F.col("_r") / F.col("_n") - F.col("_f"), F.col("_f") - (F.col("_r") - 1) / F.col("_n"))).alias("ks"))


def largest_threshold(scores: DataFrame, target: float) -> DataFrame:
    """threshold and accuracy: the largest of the thresholds whose accuracy is at least the target (threshold, good)."""
    by = scores.groupBy("threshold").agg(F.avg("good").alias("accuracy"))
    return by.where(F.col("accuracy") >= target).agg(F.max(F.struct("threshold", "accuracy")).alias("b")).select("b.*")


def bootstrap_mean(rows: DataFrame, value: str, key: str, draws: int = 200, seed: int = 123) -> DataFrame:
    """mean, low and high: the mean and its 95 percent band from resampling with Poisson weights, drawn by a hash of the key."""
    u = lambda i: (F.pmod(F.xxhash64(F.col(key), i, F.lit(seed)), F.lit(1 << 30)) + 0.5) / (1 << 30)
    each = rows.select(key, F.col(value).alias("_v"), F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).withColumn("_u", u(F.col("draw")))
    total, chance = F.lit(0), 0.0
    term = 2.718281828459045**-1
    for k in range(1, 8):  # the Poisson law with mean 1
        chance += term
        term /= k
        total = total + (F.col("_u") > chance).cast("int")
    means = each.withColumn("_w", total).groupBy("draw").agg((F.sum(F.col("_v") * F.col("_w")) / F.sum("_w")).alias("m"))
    band = means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return rows.agg(F.avg(value).alias("mean")).crossJoin(band)


def folds(rows: DataFrame, key: str, k: int = 5, seed: int = 123) -> DataFrame:
    """Adds fold from 0 to k - 1; rows of one key share it. The split is a hash's, not another library's shuffle."""
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))
    return rows.withColumn("fold", F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), F.lit(k)))


def peeking(rows: DataFrame, key: str, order: str, k: int = 5, seed: int = 123) -> DataFrame:
    """folds, with peek: the one row of each key, first by a hash of order, that may be seen while its fold is tested."""
    draw = F.struct(F.md5(F.concat_ws(":", F.col(order).cast("string"), F.lit(str(seed))).cast("binary")), F.col(order))
    first = rows.groupBy(key).agg(F.min_by(order, draw).alias("_first"))
    return folds(rows, key, k, seed).join(first, key).withColumn("peek", F.col(order) == F.col("_first")).drop("_first")


def leave_one_out(rows: DataFrame, key: str) -> DataFrame:
    """held_out and the rows of every other key, one training set for each key: as many copies as there are keys, less one."""
    keys = rows.select(F.col(key).alias("held_out")).distinct()
    return keys.join(rows, F.col("held_out") != F.col(key))


def nth(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The n-th row (from 0) of each group by order."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("_at", at).where(F.col("_at") == n + 1).drop("_at")
