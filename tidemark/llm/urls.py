"""URL filters: host and path rules, and gradient-boosted trees on lexical features, with SQL functions alone.

Rules label the urls that they fit. Trees learn from a bounded sample of those and judge the urls that no rule fits. Features
are cut into at most BINS bins, and the sample comes to the driver grouped by them; each split is picked from gradient sums by
feature and bin. The model is a CASE expression, so all urls are judged within the generated code.

Two features are statistics of the labels: how often the host's suffix, and the path's first segment, was blocked. A row that
the trees learn from takes them from the hosts of the other folds, so they don't give its own label away.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Host, path and verdict; the longest that fits wins.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Labelled urls learned from.
SAMPLE = 10_000
TREES, DEPTH, BINS, RATE, RIDGE = 10, 3, 12, 0.4, 1.0
SUFFIXES = 4_096
#: Hosts are dealt over so many folds for the statistics.
FOLDS = 4
STATISTICS = ("suffix", "segment")
FEATURES = ("length", "host_length", "depth", "digit_ratio", "entropy", "parameters", "labels", "longest_word", "suffix_rate", "segment_rate")


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parsed(pages: DataFrame) -> DataFrame:
    """Adds host and path of the column url: empty where it is null or has no ``://``."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    pages = pages.withColumn("_rest", rest)
    return pages.withColumn("host", _lower(F.regexp_extract("_rest", r"^([^/?#]*)", 1))).withColumn("path", F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1)).drop("_rest")


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule and rule_verdict of the longest rule that fits host (or a parent domain of it) and the start of path."""
    listed = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    known = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("host", "path", "verdict"), r, strict=True)]) for r in listed])

    def fits(r: Column) -> Column:
        return F.endswith(F.concat(F.lit("."), F.col("host")), F.concat(F.lit("."), r["host"])) & F.startswith(F.col("path"), r["path"])

    pages = pages.withColumn("_rule", F.get(F.filter(known, fits), 0))
    return pages.withColumn("rule", F.concat("_rule.host", "_rule.path")).withColumn("rule_verdict", F.col("_rule.verdict")).drop("_rule")


def lexical(pages: DataFrame) -> DataFrame:
    """Adds the features but the rates, and suffix_no and segment_no, the hashed places of the host's last two labels and of the
    path's first segment, and fold, that of the host."""
    pages = pages.withColumn("_u", F.coalesce(F.col("url").cast("string"), F.lit(""))).withColumn("_n", F.greatest(F.lit(1), F.length("_u")))
    pages = pages.withColumn("_plain", F.regexp_replace("_u", r"[^\x00-\x7F]", "~"))  # so there are at most 128 letters
    pages = pages.withColumn("_counts", F.transform(F.array_distinct(F.split("_plain", "")), lambda c: (F.col("_n") - F.length(F.replace(F.col("_plain"), c, F.lit("")))).cast("double")))
    parts = F.split("host", r"\.")
    return (
        pages.withColumn("length", F.col("_n").cast("double"))
        .withColumn("host_length", F.length("host").cast("double"))
        .withColumn("depth", F.size(F.split("path", "/")).cast("double"))
        .withColumn("digit_ratio", F.length(F.regexp_replace("_u", "[^0-9]", "")) / F.col("_n"))
        .withColumn("entropy", F.aggregate("_counts", F.lit(0.0), lambda s, c: s - F.when(c > 0, c / F.col("_n") * F.log2(c / F.col("_n"))).otherwise(0.0)))
        .withColumn("parameters", F.length(F.regexp_replace("_u", "[^?&]", "")).cast("double"))
        .withColumn("labels", F.size(parts).cast("double"))
        .withColumn("longest_word", F.array_max(F.transform(F.split("_u", "[^A-Za-z]+"), F.length)).cast("double"))
        .withColumn("suffix_no", F.pmod(F.xxhash64(F.array_join(F.slice(F.reverse(parts), 1, 2), ".")), F.lit(SUFFIXES)))
        .withColumn("segment_no", F.pmod(F.xxhash64(F.coalesce(F.get(F.split("path", "/"), 1), F.lit(""))), F.lit(SUFFIXES)))
        .withColumn("fold", F.pmod(F.xxhash64("host", F.lit(FOLDS)), F.lit(FOLDS)).cast("int"))
        .drop("_u", "_n", "_plain", "_counts")
    )


@dataclass
class Trees:
    """cuts: by feature, the upper bounds of its bins; a tree is (feature, bin, tree, tree) or the value of a leaf."""

    cuts: list[list[float]]
    trees: list

    def bins(self) -> list[Column]:
        return [reduce(lambda a, b: a + b, [(F.col(f) > c).cast("int") for c in cuts], F.lit(0)).alias(f"b{i}") for i, (f, cuts) in enumerate(zip(FEATURES, self.cuts, strict=True))]

    def score(self) -> Column:
        """Log-odds of block, of the columns b0, b1, ..."""
        return reduce(lambda a, b: a + b, [_value(t) for t in self.trees], F.lit(0.0))


def _value(tree) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    feature, place, left, right = tree
    return F.when(F.col(f"b{feature}") <= place, _value(left)).otherwise(_value(right))


def _grow(cells: list[tuple], scores: list[float], depth: int):
    """One tree from gradient and curvature sums by feature and bin; adds its values to the scores.

    cells: (y, n, bins) of the sample, grouped.
    """
    p = [1 / (1 + math.exp(-s)) for s in scores]
    pull = [(p[i] - y) * n for i, (y, n, _) in enumerate(cells)]
    bend = [p[i] * (1 - p[i]) * n for i, (_, n, _) in enumerate(cells)]

    def split(own: list[int], left: int):
        g, h = math.fsum(pull[i] for i in own), math.fsum(bend[i] for i in own)
        best, where = 1e-6, None
        for f in range(len(FEATURES)) if left else ():
            sums = [[0.0, 0.0] for _ in range(BINS + 1)]
            for i in own:
                x = sums[cells[i][2][f]]
                x[0] += pull[i]
                x[1] += bend[i]
            a = c = 0.0
            for place, (dg, dh) in enumerate(sums[:-1]):
                a, c = a + dg, c + dh
                gain = a**2 / (c + RIDGE) + (g - a) ** 2 / (h - c + RIDGE) - g**2 / (h + RIDGE)
                if gain > best + 1e-9:
                    best, where = gain, (f, place)
        if where is None:
            value = -RATE * g / (h + RIDGE)
            for i in own:
                scores[i] += value
            return value
        f, place = where
        return (f, place, split([i for i in own if cells[i][2][f] <= place], left - 1), split([i for i in own if cells[i][2][f] > place], left - 1))

    return split(list(range(len(cells))), depth)


@dataclass
class Rates:
    """table: (place, fold, suffix_rate, segment_rate) for each place and fold, without the fold's own labels; fold -1 has all
    of them. mean is the rate where none were seen."""

    table: DataFrame
    mean: float

    def add_to(self, pages: DataFrame, fold: Column) -> DataFrame:
        """Adds suffix_rate and segment_rate; two joins with a table of at most SUFFIXES x (FOLDS + 1) rows."""
        for name in STATISTICS:
            own = self.table.select(F.col("place").alias("_place"), F.col("fold").alias("_fold"), F.col(f"{name}_rate").alias("_rate"))
            pages = pages.join(F.broadcast(own), (F.col(f"{name}_no") == F.col("_place")) & (fold == F.col("_fold")), "left")
            pages = pages.withColumn(f"{name}_rate", F.coalesce("_rate", F.lit(self.mean))).drop("_place", "_fold", "_rate")
        return pages


def _rates(sample: DataFrame) -> Rates:
    mean = sample.agg(F.avg("y")).first()[0] or 0.0
    sums: dict = {}
    for name in STATISTICS:
        for r in sample.groupBy(f"{name}_no", "fold").agg(F.sum("y").alias("y"), F.count("*").alias("n")).collect():  # at most SUFFIXES x FOLDS rows
            for fold in (-1, *(k for k in range(FOLDS) if k != r["fold"])):
                x = sums.setdefault((r[0], fold), {}).setdefault(name, [0.0, 0])
                x[0] += r["y"]
                x[1] += r["n"]
    rate = lambda y, n: (y + 8 * mean) / (n + 8)
    rows = [(place, fold, *(rate(*found.get(name, (0.0, 0))) for name in STATISTICS)) for (place, fold), found in sorted(sums.items())]
    return Rates(sample.sparkSession.createDataFrame(rows, "place long, fold int, suffix_rate double, segment_rate double"), mean)


def fit(labelled: DataFrame) -> tuple[Trees, Rates]:
    """Trees and rates, from url features and y (1 to block). No labels: no trees, no rates."""
    total = labelled.count()
    share = min(1.0, SAMPLE / max(1, total))
    sample = labelled.where(F.pmod(F.xxhash64("url", "page_id"), F.lit(1 << 32)) < share * (1 << 32)).persist(StorageLevel.MEMORY_AND_DISK)
    rates = _rates(sample)
    sample_all = rates.add_to(sample, F.col("fold"))
    probabilities = [i / BINS for i in range(1, BINS)]
    cuts = sample_all.agg(*[F.percentile_approx(f, probabilities, 1_000).alias(f) for f in FEATURES]).first()
    model = Trees([sorted(set(cuts[f] or [])) for f in FEATURES], [])
    names = [f"b{i}" for i in range(len(FEATURES))]
    counted = sample_all.select("y", *model.bins()).groupBy("y", *names).agg(F.count("*").alias("n")).collect()  # at most the sample
    cells = sorted((r["y"], r["n"], tuple(r[x] for x in names)) for r in counted)
    scores = [0.0] * len(cells)
    for _ in range(TREES if cells else 0):
        model.trees.append(_grow(cells, scores, DEPTH))
    sample.unpersist()
    return model, rates


def scored(rows: DataFrame, model: Trees, rates: Rates) -> DataFrame:
    """rows of lexical() with block_odds, the trees' log-odds of block (below 0 without labels)."""
    rows = rates.add_to(rows, F.lit(-1))
    binned = rows.select("*", *model.bins())
    return binned.withColumn("block_odds", model.score() if model.trees else F.lit(-1.0)).drop(*[f"b{i}" for i in range(len(FEATURES))])


def features(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule, rule_verdict and the features of every row of pages."""
    return lexical(ruled(parsed(pages.select("page_id", "url")), rules))


def labelled(rows: DataFrame) -> DataFrame:
    """The rows that a rule fits, with y (1 to block)."""
    return rows.where("rule_verdict is not null").withColumn("y", (F.col("rule_verdict") == "block").cast("double"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and block_odds of every row of pages (page_id, url).

    The verdict is the rule's; without one, the trees' (block at even odds or more; allow without labels). Null and
    malformed urls have an empty host and path, and are judged by the trees. Rules of equal length go by host, then path.
    Repeated rows and null ids stay; other columns are ignored; an empty table gives an empty result. No row is shuffled: the
    only joins are with the table of rates, which has at most SUFFIXES x (FOLDS + 1) rows.
    """
    rows = features(pages, rules)
    odds = scored(rows, *fit(labelled(rows)))
    verdict = F.coalesce("rule_verdict", F.when(F.col("block_odds") >= 0, "block").otherwise("allow"))
    return odds.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_odds")
