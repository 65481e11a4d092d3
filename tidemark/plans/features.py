"""Queries over feature vectors, hashes, votes and training pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import images
from ..operators import ensemble, neighbours, pairs
from ..sources.proxies import VECTORS_SQL, features, load, screens
from .registry import query

#: Match thresholds: of 64 bits, of the angular distance, of a plain distance.
HAMMING, ANGULAR, EUCLIDEAN = 22, 0.8979591836734693, 9.0


def _knn(spark: SparkSession, sf_dir: str, metric: str, below: float, bits: bool = False) -> DataFrame:
    pages, queries = features(spark, sf_dir)
    if bits:
        pages, queries = (x.withColumn("vec", images.average_hash(F.col("vec"))) for x in (pages, queries))
    best = neighbours.best_or_none(queries, pages, metric, below)
    return best.select("id", "page", F.round("distance", 6).alias("distance"))


def _knn_sql(distance: str, below: float, vec: str = "vec") -> str:
    return f"""with {VECTORS_SQL}, p as (select id, {vec} as vec from pages_f), s as (select id, {vec} as vec from screens_f),
    d as (select s.id, p.id as page, {distance} as d from s, p), best as (select id, arg_min(page, (round(d, 9), page)) as page, min(d) as d from d group by id)
    select id, case when d < {below} then page end as page, case when d < {below} then round(d, 6) end as distance from best"""


_BITS = "list_transform(vec, lambda x: (x > list_avg(vec))::int)"


@query(_knn_sql("list_sum(list_transform(list_zip(s.vec, p.vec), lambda x: abs(x[1] - x[2])))::double", HAMMING, _BITS))
def knn_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir, "hamming", HAMMING, bits=True)


@query(_knn_sql("sqrt(greatest(0, 2 * (1 - list_cosine_similarity(s.vec, p.vec))))", ANGULAR))
def knn_angular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir, "angular", ANGULAR)


@query(_knn_sql("list_distance(s.vec, p.vec)", EUCLIDEAN))
def knn_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir, "euclidean", EUCLIDEAN)


@query()
def knn_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, queries = features(spark, sf_dir)
    return neighbours.nearest_lsh(queries, pages)


@query(f"with {VECTORS_SQL} select id, array_to_string(list_transform(vec, lambda x: (x > list_avg(vec))::int), '') as bits from vectors")
def hash_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, rest = features(spark, sf_dir)
    return pages.unionByName(rest).select("id", images.as_bits(images.average_hash(F.col("vec"))).alias("bits"))


@query(f"with {VECTORS_SQL} select id, array_to_string([(vec[i + 1] > vec[i])::int for i in range(1, 64) if i % 8 <> 0], '') as bits from vectors")
def hash_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, rest = features(spark, sf_dir)
    return pages.unionByName(rest).select("id", images.as_bits(images.difference_hash(F.col("vec"))).alias("bits"))


@query()
def hash_perceptual(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("struct<perceptual:string,wavelet:string>")
    def hashes(vectors: pd.Series) -> pd.DataFrame:
        text = lambda f, v: "".join(map(str, f(np.array(v).reshape(8, 8), 4).astype(int)))
        return pd.DataFrame({"perceptual": [text(images.perceptual_hash, v) for v in vectors], "wavelet": [text(images.wavelet_hash, v) for v in vectors]})

    pages, rest = features(spark, sf_dir)
    return pages.unionByName(rest).select("id", hashes("vec").alias("h")).select("id", "h.*")


_MOMENTS = f"""with {VECTORS_SQL}, flat as (select id, unnest(range(64)) as pos, unnest(vec) as x from screens_f),
m as (select pos, avg(x) as mean, avg(x * x) as sq from flat group by pos),
moments as (select pos, mean, case when sq - mean * mean > 1e-15 then 1 / sqrt(sq - mean * mean) else 0 end as inverse_std from m)"""


@query(f"{_MOMENTS} select pos::int as pos, round(mean, 6) as mean, round(inverse_std, 5) as inverse_std from moments")
def vector_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pairs.moments(features(spark, sf_dir)[1])
    return found.select("pos", F.round("mean", 6).alias("mean"), F.round("inverse_std", 5).alias("inverse_std"))


@query(f"{_MOMENTS} select id, round(sum((x - mean) * inverse_std), 5) as total, round(max((x - mean) * inverse_std), 5) as most from flat join moments using (pos) group by id")
def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir)[1]
    scaled = pairs.standardize(rows, pairs.moments(rows))
    return scaled.select("id", F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 5).alias("total"), F.round(F.array_max("vec"), 5).alias("most"))


@query(
    f"""with {VECTORS_SQL}, s as (select id as screen, label from screens_f), p as (select label as document, id as page from pages_f),
    e as (select screen, page, case when label = document and page % 20 = 0 then 2 when label = document and page % 20 = 10 and page % 30 = 0 then 1 end as hit, document,
      max(case when label = document and (page % 20 = 0 or page % 30 = 0) then 1 else 0 end) over (partition by screen, document) as near from s join p on s.label % 4 = document % 4),
    f as (select *, sum(case when hit is null then case when near = 1 then 5.0 else 2.0 end end) over (partition by screen) as others, count(hit) over (partition by screen) as n from e),
    g as (select screen, page, case when hit = 2 then 0 else 1 end::bigint as label, case when hit = 2 then (1 + coalesce(others, 0)) / n when near = 1 then 5.0 else 2.0 end::double as weight from f where hit is null or hit = 2)
    select screen, page, label, round(weight * (select count(*) / sum(weight) from g), 6) as weight from g"""
)
def training_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    page_rows, screen_rows = features(spark, sf_dir)
    # A document is a label; a video's documents are the labels that leave the same remainder by 4.
    every = screen_rows.select((F.col("label") % 4).alias("video"), F.col("id").alias("screen"), "label")
    pages = page_rows.select((F.col("label") % 4).alias("video"), F.col("label").alias("document"), F.col("id").alias("page"))
    both = every.drop("video").join(pages, F.col("label") == F.col("document"))
    similarity = F.when(F.col("page") % 20 == 0, "full").when(F.col("page") % 30 == 0, "incremental")
    matches = both.select("screen", "document", "page", similarity.alias("similarity")).where("similarity is not null")
    found = pairs.training_pairs(every.select("video", "screen"), pages, matches)
    return found.select("screen", "page", "label", F.round("weight", 6).alias("weight"))


@query(
    """with b as (select user_id as screen, m.member, m.weight, case (user_id * m.step + m.member) % 4 when 0 then null else (user_id * m.step + m.member) % 4 end as page
      from (select distinct user_id from events), (values (0, 0.5::double, 1), (1, 0.3::double, 2), (2, 0.2::double, 3), (3, 0.0::double, 5)) m(member, weight, step)),
    s as (select screen, page, sum(weight) as votes, min(member) as first from b where weight > 0 group by all),
    r as (select *, row_number() over (partition by screen order by round(votes, 9) desc, first) as rn from s)
    select screen, case when votes >= 0.5 then page end as page, round(votes, 6) as votes from r where rn = 1"""
)
def ensemble_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = spark.createDataFrame([(0, 0.5, 1), (1, 0.3, 2), (2, 0.2, 3), (3, 0.0, 5)], "member int, weight double, step int")
    ballots = load(spark, sf_dir, "events").select(F.col("user_id").alias("screen")).distinct().crossJoin(F.broadcast(members))
    page = (F.col("screen") * F.col("step") + F.col("member")) % 4
    found = ensemble.vote(ballots.withColumn("page", F.when(page != 0, page)), quorum=0.5)
    return found.select("screen", "page", F.round("votes", 6).alias("votes"))


@query(
    f"""with {VECTORS_SQL}, b as (select id, unnest(vec) > 0 as p, unnest(list_concat(vec[2:], vec[1:1])) > 0 as t from vectors)
    select id, round(avg((p = t)::int), 6) as accuracy, round(2.0 * sum((p and t)::int) / nullif(sum(p::int) + sum(t::int), 0), 6) as dice, round(sum((p and t)::int) / nullif(sum((p or t)::int), 0)::double, 6) as iou from b group by id"""
)
def mask_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, rest = features(spark, sf_dir)
    rows = pages.unionByName(rest).select("id", F.posexplode("vec").alias("i", "x"), F.concat(F.slice("vec", 2, 63), F.slice("vec", 1, 1)).alias("o"))
    bits = rows.select("id", (F.col("x") > 0).alias("p"), (F.get("o", F.col("i")) > 0).alias("t"))
    count = lambda c: F.count_if(c)
    both, either = count(F.col("p") & F.col("t")), count(F.col("p") | F.col("t"))
    sums = F.nullif(count(F.col("p")) + count(F.col("t")), F.lit(0))
    return bits.groupBy("id").agg(F.round(F.avg((F.col("p") == F.col("t")).cast("int")), 6).alias("accuracy"), F.round(both * 2.0 / sums, 6).alias("dice"), F.round(both / F.nullif(either, F.lit(0)), 6).alias("iou"))


def _corners(q) -> np.ndarray:
    return np.array([(q[c]["x"], q[c]["y"]) for c in ("tl", "tr", "bl", "br")], float)


@query()
def homography(spark: SparkSession, sf_dir: str) -> DataFrame:
    def solve(parts):
        for part in parts:
            rows = [images.homography(_corners(q), np.array([(0, 0), (63, 0), (0, 47), (63, 47)], float)).reshape(-1).tolist() for q in part["quad"]]
            yield pd.DataFrame({"event_id": part["event_id"], "matrix": rows})

    return screens(spark, sf_dir).select("event_id", "quad").mapInPandas(solve, "event_id long, matrix array<double>")


@query()
def mask_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    def draw(parts):
        for part in parts:
            masks = [images.fill_polygon([tuple(p) for p in _corners(q)[[0, 1, 3, 2]]], 64, 80) for q in part["quad"]]
            yield pd.DataFrame({"event_id": part["event_id"], "pixels": [int(m.sum()) for m in masks], "mask": [np.packbits(m).tobytes() for m in masks]})

    return screens(spark, sf_dir).select("event_id", "quad").mapInPandas(draw, "event_id long, pixels long, mask binary")


@query()
def distance_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    pages, queries = features(spark, sf_dir)
    near = neighbours.nearest(queries, pages, "euclidean").join(queries.select(F.col("id").alias("_s"), F.col("label").alias("a")), F.col("id") == F.col("_s")).join(pages.select(F.col("id").alias("_p"), F.col("label").alias("b")), F.col("page") == F.col("_p"))
    rows = near.select((F.col("a") != F.col("b")).cast("double").alias("label"), array_to_vector(F.array("distance")).alias("features"))
    model = LogisticRegression(maxIter=50).fit(rows)
    return spark.createDataFrame([(float(model.coefficients[0]), float(model.intercept))], "slope double, intercept double")
