"""Stand-ins over the star-schema tables for videos, frames, screens, pages and features.

A user is a video and its events, by time, are the frames; every event but an error shows one screen. Feature vectors are
embeddings; every tenth is a page's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import quad

FPS = 15


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video, frame_no (from 1 by time), event_id, ts, kind, value."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("video"), F.row_number().over(order).cast("long").alias("frame_no"), "event_id", "ts", F.col("event_type").alias("kind"), "value")


def page_of(kind: str = "kind") -> F.Column:
    return F.when(F.col(kind) == "view", 1).when(F.col(kind) == "click", 2).when(F.col(kind) == "purchase", 3).cast("long")


def box(shift: int = 0) -> F.Column:
    """The quadrangle of an event: a rectangle whose upper right corner is a little lower."""
    e = F.col("event_id")
    x, y, w, h = e * 7 % 40 + shift, e * 5 % 30, 20 + e % 11, 15 + e % 7
    return quad((x, y), (x + w, y + e % 3), (x, y + h), (x + w, y + h))


def with_quads(frame_rows: DataFrame) -> DataFrame:
    """Adds page and quad; frames of errors show nothing and drop out."""
    condition = F.element_at(F.array(F.lit("pristine"), F.lit("windowed"), F.lit("obstacle")), (F.col("event_id") % 3 + 1).cast("int"))
    return frame_rows.where("kind <> 'error'").withColumn("page", page_of()).withColumn("quad", box()).withColumn("condition", condition)


def shown(frame_rows: DataFrame) -> DataFrame:
    """The same with every frame; those of errors have neither page nor quad."""
    error = F.col("kind") == "error"
    return frame_rows.withColumn("page", page_of()).withColumn("quad", F.when(~error, box()))


def screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_quads(frames(spark, sf_dir))


def two_screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One screen a frame, and a second one 400 to the right where event_id is a multiple of 4; ix is the detector's order."""
    one = screens(spark, sf_dir)
    second = one.where("event_id % 4 = 0").withColumn("quad", box(400)).withColumn("ix", F.lit(0))
    return one.withColumn("ix", F.lit(1)).unionByName(second)


def features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(page features, screen features): id, label, vec as doubles."""
    rows = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("vec"))
    return rows.where("id % 10 = 0"), rows.where("id % 10 <> 0")


#: The same views as common table expressions.
FRAMES_SQL = """frames as (
  select user_id as video, row_number() over (partition by user_id order by ts, event_id) as frame_no, event_id, ts, event_type as kind, value
  from events)"""
SCREENS_SQL = (
    FRAMES_SQL
    + """, screens as (
  select video, frame_no, event_id, ts, kind, value,
    case kind when 'view' then 1 when 'click' then 2 when 'purchase' then 3 end as page,
    ['pristine', 'windowed', 'obstacle'][event_id % 3 + 1] as condition,
    (event_id * 7 % 40)::double as tlx, (event_id * 5 % 30)::double as tly,
    (event_id * 7 % 40 + 20 + event_id % 11)::double as trx, (event_id * 5 % 30 + event_id % 3)::double as try_,
    (event_id * 7 % 40)::double as blx, (event_id * 5 % 30 + 15 + event_id % 7)::double as bly,
    (event_id * 7 % 40 + 20 + event_id % 11)::double as brx, (event_id * 5 % 30 + 15 + event_id % 7)::double as bry
  from frames where kind <> 'error')"""
)
#: The scene filter over the values of frames.
FOLD_SQL = f"""with recursive {FRAMES_SQL},
fold as (select video, frame_no, value, value as kept, true as keep from frames where frame_no = 1
  union all select f.video, f.frame_no, f.value, case when ((f.value - o.kept) / 255) * ((f.value - o.kept) / 255) > 0.15 then f.value else o.kept end, ((f.value - o.kept) / 255) * ((f.value - o.kept) / 255) > 0.15
  from fold o join frames f on f.video = o.video and f.frame_no = o.frame_no + 1)"""
VECTORS_SQL = """vectors as (select vec_id as id, label, list_transform(embedding, lambda x: x::double) as vec from embeddings),
pages_f as (select * from vectors where id % 10 = 0), screens_f as (select * from vectors where id % 10 <> 0)"""


def overlap_sql(pairs: str) -> str:
    """Expressions over pairs(pair, a*, b* corners) that end in shared_areas(pair, inter), by clipping each quadrangle's edges."""
    corners = lambda p: ", ".join(f"{{'x': {p}{c}x, 'y': {p}{'try_' if c == 'tr' else c + 'y'}}}" for c in ("tl", "tr", "br", "bl"))
    return f"""rings0 as (
  select pair, 0 as own, [{corners('a_')}] as r from {pairs} union all select pair, 1, [{corners('b_')}] from {pairs}),
rings as (
  select pair, own, case when list_sum([r[i].x * r[i % 4 + 1].y - r[i % 4 + 1].x * r[i].y for i in [1, 2, 3, 4]]) < 0 then list_reverse(r) else r end as r from rings0),
edges as (
  select pair, own, i, r[i].x as px, r[i].y as py, r[i % 4 + 1].x as qx, r[i % 4 + 1].y as qy
  from rings, (values (1), (2), (3), (4)) t(i) where r[i] <> r[i % 4 + 1]),
dist as (
  select e.pair, e.own, e.i, e.px, e.py, e.qx, e.qy,
    (c.qx - c.px) * (e.py - c.py) - (c.qy - c.py) * (e.px - c.px) as d0, (c.qx - c.px) * (e.qy - c.py) - (c.qy - c.py) * (e.qx - c.px) as d1,
    (e.qx - e.px) * (c.qx - c.px) + (e.qy - e.py) * (c.qy - c.py) as along
  from edges e join edges c on c.pair = e.pair and c.own <> e.own),
clipped as (
  select pair, own, i, px, py, qx, qy, greatest(0, max(case when d0 < 0 and d1 > d0 then d0 / (d0 - d1) end)) as t0, least(1, min(case when d1 < 0 and d0 > d1 then d0 / (d0 - d1) end)) as t1,
    bool_or((d0 <= 0 and d1 <= 0 and not (d0 = 0 and d1 = 0)) or (d0 = 0 and d1 = 0 and (own = 1 or along < 0))) as gone
  from dist group by all),
shared_areas as (
  select pair, coalesce(sum(((px + t0 * (qx - px)) * (py + t1 * (qy - py)) - (px + t1 * (qx - px)) * (py + t0 * (qy - py))) / 2) filter (where not gone and t1 > t0), 0) as inter
  from clipped group by pair)"""
