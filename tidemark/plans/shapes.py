"""Queries over quadrangles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.scalars import bigger_than
from ..operators import spatial
from ..sources.proxies import SCREENS_SQL, overlap_sql, screens, two_screens
from .registry import query

_AREA = "abs((tlx * try_ - trx * tly) + (trx * bry - brx * try_) + (brx * bly - blx * bry) + (blx * tly - tlx * bly)) / 2"
_WIDTH = "greatest(floor(sqrt((tlx - trx) ** 2 + (tly - try_) ** 2)), floor(sqrt((blx - brx) ** 2 + (bly - bry) ** 2)))"
_HEIGHT = "greatest(floor(sqrt((tlx - blx) ** 2 + (tly - bly) ** 2)), floor(sqrt((trx - brx) ** 2 + (try_ - bry) ** 2)))"
#: Each screen with the one of the frame before.
PAIRS_SQL = (
    SCREENS_SQL
    + """, pairs as (
  select b.event_id as pair, """
    + ", ".join(f"a.{c} as a_{c}, b.{c} as b_{c}" for c in ("tlx", "tly", "trx", "try_", "blx", "bly", "brx", "bry"))
    + """ from screens a join screens b on a.video = b.video and b.frame_no = a.frame_no + 1)"""
)


def consecutive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id with the quadrangles a, of the frame before, and b."""
    rows = screens(spark, sf_dir)
    order = Window.partitionBy("video").orderBy("frame_no")
    pairs = rows.select("event_id", "frame_no", F.col("quad").alias("b"), F.lag("quad").over(order).alias("a"), F.lag("frame_no").over(order).alias("before"))
    return pairs.where("before = frame_no - 1")


@query(f"with {SCREENS_SQL} select event_id, {_AREA} as area from screens")
def quad_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screens(spark, sf_dir).select("event_id", G.area(F.col("quad")).alias("area"))


@query(f'with {SCREENS_SQL} select event_id, least(tlx, trx, blx, brx) as "left", least(tly, try_, bly, bry) as top, greatest(tlx, trx, blx, brx) as "right", greatest(tly, try_, bly, bry) as bottom from screens')
def quad_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screens(spark, sf_dir).select("event_id", G.bounds(F.col("quad")).alias("b")).select("event_id", "b.*")


@query(f"with {SCREENS_SQL} select event_id, ({_WIDTH})::bigint as width, ({_HEIGHT})::bigint as height from screens")
def quad_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screens(spark, sf_dir).select("event_id", G.size(F.col("quad")).alias("s")).select("event_id", "s.*")


_LESS = " and ".join(f"(a_{x} < b_{x} or a_{x} = b_{x} and a_{y} < b_{y})" for x, y in (("tlx", "tly"), ("trx", "try_"), ("blx", "bly"), ("brx", "bry")))
_SAME = " and ".join(f"a_{c} = b_{c}" for c in ("tlx", "tly", "trx", "try_", "blx", "bly", "brx", "bry"))


@query(f"with {PAIRS_SQL} select pair as event_id, {_SAME} as equal, {_LESS} as precedes from pairs")
def quad_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return consecutive(spark, sf_dir).select("event_id", (a == b).alias("equal"), G.precedes(a, b).alias("precedes"))


@query(f"with {PAIRS_SQL}, {overlap_sql('pairs')} select pair as event_id, round(inter, 6) as inter from shared_areas")
def quad_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consecutive(spark, sf_dir).select("event_id", F.round(G.overlap("a", "b"), 6).alias("inter"))


_AREA_A, _AREA_B = (f"abs(({p}tlx * {p}try_ - {p}trx * {p}tly) + ({p}trx * {p}bry - {p}brx * {p}try_) + ({p}brx * {p}bly - {p}blx * {p}bry) + ({p}blx * {p}tly - {p}tlx * {p}bly)) / 2" for p in ("a_", "b_"))


@query(f"with {PAIRS_SQL}, {overlap_sql('pairs')} select pair as event_id, round({_AREA_A} + {_AREA_B} - inter, 6) as area from shared_areas join pairs using (pair)")
def quad_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consecutive(spark, sf_dir).select("event_id", F.round(G.union_area("a", "b"), 6).alias("area"))


@query(f"with {PAIRS_SQL}, {overlap_sql('pairs')} select pair as event_id, round(inter / ({_AREA_A} + {_AREA_B} - inter), 4) as iou from shared_areas join pairs using (pair)")
def screen_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consecutive(spark, sf_dir).select("event_id", F.round(G.jaccard("a", "b"), 4).alias("iou"))


@query(
    f"""with {SCREENS_SQL}, members as (select distinct video, tlx, tly, trx, try_, blx, bly, brx, bry from screens),
    numbered as (select *, row_number() over (partition by video order by tlx, tly, trx, try_, blx, bly, brx, bry) as id from members),
    pairs as (select a.video * 1000000 + a.id * 1000 + b.id as pair, a.video, a.id as aid, b.id as bid, {", ".join(f"a.{c} as a_{c}, b.{c} as b_{c}" for c in ("tlx", "tly", "trx", "try_", "blx", "bly", "brx", "bry"))}
      from numbered a join numbered b on a.video = b.video and a.tlx < b.brx and b.tlx < a.brx and a.tly < b.bry and b.tly < a.bry), {overlap_sql("pairs")}
    select video, aid as id, bid as other, round(inter + 1e-7, 5) as inter, round(inter / ({_AREA_A} + {_AREA_B} - inter) + 1e-7, 5) as jaccard
    from shared_areas join pairs using (pair) where inter > 0"""
)
def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    distinct = screens(spark, sf_dir).select("video", "quad").distinct()
    rows = distinct.withColumn("id", F.row_number().over(Window.partitionBy("video").orderBy("quad.tl", "quad.tr", "quad.bl", "quad.br")).cast("long"))
    found = spatial.jaccard_join(rows, rows, ["video"])
    # The values are fractions that often end in 5; a little more makes them round alike, whatever their last bit.
    return found.select("video", "id", "other", F.round(F.col("inter") + 1e-7, 5).alias("inter"), F.round(F.col("jaccard") + 1e-7, 5).alias("jaccard"))


@query(
    f"""with {SCREENS_SQL}, q as (select event_id, [tlx, tly, trx, try_, blx, bly, brx, bry] as q from screens)
    select 'union' as op, count(*) as n from (select q from q where event_id % 2 = 0 union select q from q where event_id % 3 = 0)
    union all select 'both', count(*) from (select q from q where event_id % 2 = 0 intersect select q from q where event_id % 3 = 0)
    union all select 'discard', count(*) from (select q from q where event_id % 2 = 0 except select q from q where event_id % 3 = 0)
    union all select 'contains', count(*) from (select distinct q from q) where q in (select q from q where event_id % 5 = 0)"""
)
def index_set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = screens(spark, sf_dir)
    some = lambda n: rows.where(f"event_id % {n} = 0").select("quad")
    a, b = some(2), some(3)
    ops = {"union": a.union(b).distinct(), "both": a.intersect(b), "discard": a.subtract(b), "contains": rows.select("quad").distinct().join(some(5).distinct(), "quad", "left_semi")}
    out = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("op"), "n") for k, df in ops.items()]
    return out[0].union(out[1]).union(out[2]).union(out[3])


@query(f"with {SCREENS_SQL} select event_id, {' or '.join(f'{c}x < 0 or {c}x >= 60 or {c}{y} < 0 or {c}{y} >= 45' for c, y in (('tl', 'y'), ('bl', 'y'), ('br', 'y')))} or trx < 0 or trx >= 60 or try_ < 0 or try_ >= 45 as beyond from screens")
def beyond_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screens(spark, sf_dir).select("event_id", G.beyond(F.col("quad"), F.lit(60), F.lit(45)).alias("beyond"))


@query(f"with {SCREENS_SQL} select event_id, condition from screens where condition in ('pristine', 'windowed') and greatest(trx, brx) < 60 and greatest(bly, bry) < 45")
def screens_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screens(spark, sf_dir).where(F.col("condition").isin("pristine", "windowed") & ~G.beyond(F.col("quad"), F.lit(60), F.lit(45))).select("event_id", "condition")


@query(f"with {SCREENS_SQL} select event_id, 0.15 < {_AREA} * 100 / (720 * 576) as bigger from screens")
def area_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screens(spark, sf_dir).select("event_id", bigger_than(G.area(F.col("quad")), 0.15).alias("bigger"))


@query(
    f"""with {SCREENS_SQL}, split as (select *, {_HEIGHT} / {_WIDTH} > 0.7 as whole from screens)
    select event_id, 0 as half, tlx as x0, tly as y0, case when whole then brx else (blx + brx) / 2 end as x1, case when whole then bry else (bly + bry) / 2 end as y1 from split
    union all select event_id, 1, (tlx + trx) / 2, (tly + try_) / 2, brx, bry from split where not whole"""
)
def ratio_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    halves = screens(spark, sf_dir).select("event_id", F.posexplode(G.ratio_split(F.col("quad"))).alias("half", "q"))
    return halves.select("event_id", "half", F.col("q.tl.x").alias("x0"), F.col("q.tl.y").alias("y0"), F.col("q.br.x").alias("x1"), F.col("q.br.y").alias("y1"))


@query(
    f"""with {SCREENS_SQL}, pts as (select event_id, unnest([{{'i': 0, 'x': brx, 'y': bry}}, {{'i': 1, 'x': tlx, 'y': tly}}, {{'i': 2, 'x': blx, 'y': bly}}, {{'i': 3, 'x': trx, 'y': try_}}], recursive := true) from screens),
    top as (select *, max(y) over (partition by event_id) as my, max(x) over (partition by event_id) as mx from pts)
    select event_id, arg_min(x, (x + y, i)) as tlx, arg_min(y, (x + y, i)) as tly, arg_min(x, (-(my - y + x), i)) as trx, arg_min(y, (-(my - y + x), i)) as try,
      arg_min(x, (-(mx - x + y), i)) as blx, arg_min(y, (-(mx - x + y), i)) as bly, arg_min(x, (-(x + y), i)) as brx, arg_min(y, (-(x + y), i)) as bry
    from top group by event_id"""
)
def corner_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("quad")
    rows = screens(spark, sf_dir).select("event_id", G.assign_corners(F.array(q["br"], q["tl"], q["bl"], q["tr"])).alias("q"))
    return rows.select("event_id", *[F.col(f"q.{c}.{k}").alias(c + k) for c in G.CORNERS for k in "xy"])


@query(
    f"""with {SCREENS_SQL}, both_ as (select video, frame_no, tlx, 1 as ix from screens union all select video, frame_no, tlx + 400, 0 from screens where event_id % 4 = 0)
    select video, frame_no, row_number() over (partition by video, frame_no order by tlx, ix) - 1 as screen_index, tlx as x from both_"""
)
def screens_left_to_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("video", "frame_no").orderBy("quad.tl.x", "ix")
    return two_screens(spark, sf_dir).select("video", "frame_no", (F.row_number().over(order) - 1).cast("long").alias("screen_index"), F.col("quad.tl.x").alias("x"))


@query(f"with {SCREENS_SQL} select video, count(*) as n, avg({_WIDTH}) as width, max({_WIDTH}) as widest, avg({_HEIGHT}) as height, max({_HEIGHT}) as highest, avg({_HEIGHT} / {_WIDTH}) as ratio from screens group by rollup (video)")
def screen_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = screens(spark, sf_dir).withColumn("s", G.size(F.col("quad"))).withColumn("w", F.col("s.width").cast("double")).withColumn("h", F.col("s.height").cast("double"))
    return rows.rollup("video").agg(F.count("*").alias("n"), F.avg("w").alias("width"), F.max("w").alias("widest"), F.avg("h").alias("height"), F.max("h").alias("highest"), F.avg(F.col("h") / F.col("w")).alias("ratio"))
