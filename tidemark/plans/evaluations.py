"""Queries that join by time and range, score event logs, and compute statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asof, evaluation, scenes, statistics
from ..operators import events as E
from ..sources.proxies import FOLD_SQL, FRAMES_SQL, SCREENS_SQL, frames, load, screens, with_quads
from .alignment import EVENTS_SQL, events_log
from .registry import query


@query("with e as (select *, epoch_us(ts) as us from events), p as (select user_id as u, us as at, max(event_id) as pos from e where event_type = 'signup' group by all), l as (select user_id, max(us) as last from e where user_id % 2 = 0 group by 1), j as (select e.event_id, e.user_id, e.us, p.pos from e asof join p on e.user_id = p.u and e.us >= p.at where e.event_type <> 'signup') select event_id, pos from j left join l using (user_id) where last is null or us < last")
def asof_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    until = rows.where("user_id % 2 = 0").groupBy("user_id").agg(F.max("us").alias("last"))
    positions = rows.where("event_type = 'signup'").groupBy("user_id", "us").agg(F.max("event_id").alias("pos"))
    times = rows.where("event_type <> 'signup'").select("user_id", "us", "event_id").join(until, "user_id", "left")
    return asof.valid_positions(times, positions, ["user_id"], "us", F.col("pos"), "pos", until="last").select("event_id", "pos")


@query(f"with {FRAMES_SQL}, r as (select video, frame_no as a, lead(frame_no) over (partition by video order by frame_no) as b, case when event_id % 5 = 0 then null else event_id % 65 + 1 end as page from frames where kind = 'signup') select f.video, f.frame_no, r.page from frames f left join r on f.video = r.video and f.frame_no >= r.a and (r.b is null or f.frame_no < r.b)")
def range_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir)
    ranges = rows.where("kind = 'signup'").select("video", F.col("frame_no").alias("start"), F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 65 + 1).alias("page"))
    return asof.range_join(rows.select("video", "frame_no"), ranges, ["video"], "frame_no", "start", "page")


@query(f"{FOLD_SQL} select video, frame_no, value from fold where keep")
def scene_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes.scene_filter(frames(spark, sf_dir), 0.15)


_MATCHES = "matches as (select l_orderkey as screen, l_partkey as page, case when l_linenumber % 3 = 1 then 'full' else 'incremental' end as similarity, l_linenumber as pos, l_quantity as q from lineitem where l_quantity < 30 and (l_linenumber % 3 <> 1 or l_quantity < 10))"


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").where("l_quantity < 30 and (l_linenumber % 3 <> 1 or l_quantity < 10)")
    return rows.select(F.col("l_orderkey").alias("screen"), F.col("l_partkey").alias("page"), F.when(F.col("l_linenumber") % 3 == 1, "full").otherwise("incremental").alias("similarity"), F.col("l_linenumber").alias("pos"))


_CLOSEST = f"""with {_MATCHES}, c as (select screen, string_agg(page, ',' order by page) filter (similarity = 'full') as f, string_agg(page, ',' order by page) filter (similarity <> 'full') as i from matches group by screen)"""


@query(f'{_CLOSEST} select screen, coalesce(f, \'\') as "full", coalesce(i, \'\') as incremental, coalesce(f, i) as closest from c')
def closest_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluation.closest_pages(_matches(spark, sf_dir))
    return rows.select("screen", *[F.array_join(c, ",").alias(c) for c in ("full", "incremental", "closest")])


@query(f"with {_MATCHES}, r as (select *, rank() over (partition by screen order by case similarity when 'full' then 0 else 1 end) as k from matches) select o_orderkey as screen, arg_min(page, (pos, page)) filter (k = 1) as page from orders left join r on screen = o_orderkey group by 1")
def annotated_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _matches(spark, sf_dir).groupBy("screen").agg(F.min(F.struct((F.col("similarity") != "full").alias("s"), "pos", "page")).alias("b"))
    every = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("screen")).distinct()
    return every.join(best, "screen", "left").select("screen", F.col("b.page").alias("page"))


@query(f"with {_MATCHES} select screen, p_partkey as page, p_name as name from matches join part on p_partkey = page where similarity = 'full'")
def keyref_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("page"), F.col("p_name").alias("name"))
    return _matches(spark, sf_dir).where("similarity = 'full'").select("screen", "page").join(part, "page")


_NOTES = """notes as (select video, frame_no, case event_id % 4 when 0 then 'windowed' when 1 then 'obstacle' else 'pristine' end as condition,
  case event_id % 6 when 0 then []::bigint[] when 1 then [1::bigint, 2::bigint] else [(event_id % 3 + 1)::bigint] end as closest from frames),
valid as (select video, screen_id, page, kind, frame_no as a, lead(frame_no) over (partition by video, screen_id order by frame_no, phase) as b from log where kind <> 'moved')"""


def _notes(every: DataFrame) -> DataFrame:
    e = F.col("event_id")
    closest = F.when(e % 6 == 0, F.array().cast("array<bigint>")).when(e % 6 == 1, F.array(F.lit(1), F.lit(2)).cast("array<bigint>")).otherwise(F.array(e % 3 + 1))
    condition = F.when(e % 4 == 0, "windowed").when(e % 4 == 1, "obstacle").otherwise("pristine")
    return every.select("video", "frame_no", condition.alias("condition"), closest.alias("closest"), (e % 3 + 1).alias("page"))


_SHOWN = "shown as (select n.video, n.frame_no, n.condition, n.closest, coalesce(list(distinct v.page) filter (v.page is not null), []) as pages from notes n left join (select * from valid where kind <> 'disappeared') v on v.video = n.video and v.a <= n.frame_no and (v.b is null or n.frame_no < v.b) group by all)"


@query(f"with {EVENTS_SQL}, {_NOTES}, {_SHOWN} select video, frame_no, (condition <> 'pristine' or len(closest) = 0 or list_has_any(closest, pages)) and len(list_filter(pages, lambda p: condition <> 'pristine' or not list_contains(closest, p))) <= (case when condition <> 'pristine' then 1 else 0 end) as success from shown")
def evaluate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.evaluate_events(E.validity(events_log(spark, sf_dir)), _notes(frames(spark, sf_dir)))


@query(f"with {EVENTS_SQL}, {_NOTES}, {_SHOWN} select s.video, s.frame_no, case when f.event_id % 7 = 0 then len(pages) = 0 else pages = [f.event_id % 3 + 1] end as success from shown s join frames f using (video, frame_no)")
def evaluate_events_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = frames(spark, sf_dir)
    notes = every.select("video", "frame_no", F.when(F.col("event_id") % 7 != 0, F.col("event_id") % 3 + 1).alias("page"))
    return evaluation.evaluate_strictly(E.validity(events_log(spark, sf_dir)), notes)


@query("select user_id, count(*) filter (event_type = 'purchase') as successes, count(*) as trials, round(count(*) filter (event_type = 'purchase') / count(*), 6) as accuracy from events group by 1")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = F.count_if(F.col("event_type") == "purchase")
    return load(spark, sf_dir, "events").groupBy("user_id").agg(good.alias("successes"), F.count("*").alias("trials"), F.round(good / F.count("*"), 6).alias("accuracy"))


@query(
    f"""with {SCREENS_SQL}, b as (select video, frame_no, event_id, tlx, tly, brx, bry, event_id % 5 as d, event_id % 11 = 0 as missed from screens),
    f as (select video, frame_no, case when not missed then (brx - tlx - d) / (brx - tlx + d) end as iou, missed as wrong from b)
    select video, round(avg(iou), 6) as iou, count(*) filter (wrong) as wrong, count(*) filter (iou < 0.92) as poor from f group by video"""
)
def iou_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.geometry import quad

    rows = screens(spark, sf_dir)
    q, shift = F.col("quad"), F.col("event_id") % 5
    flat = lambda d: quad((q["tl"]["x"] + d, q["tl"]["y"]), (q["br"]["x"] + d, q["tl"]["y"]), (q["tl"]["x"] + d, q["br"]["y"]), (q["br"]["x"] + d, q["br"]["y"]))
    expected = rows.select("video", "frame_no", flat(F.lit(0)).alias("quad"))
    found = rows.where("event_id % 11 <> 0").select("video", "frame_no", flat(shift).alias("quad"))
    by = evaluation.iou_by_frame(expected, found)
    return by.groupBy("video").agg(F.round(F.avg("iou"), 6).alias("iou"), F.count_if("wrong").alias("wrong"), F.count_if(F.col("iou") < 0.92).alias("poor"))


@query("with g as (select l_linenumber % 3 as kernel, l_suppkey % 4 as bound, avg(l_discount) as iou, count(*) filter (l_tax > 0.07) as wrong from lineitem group by all) select kernel, bound, round(iou, 6) as iou, wrong from g order by wrong, iou, kernel, bound limit 1")
def best_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").groupBy((F.col("l_linenumber") % 3).alias("kernel"), (F.col("l_suppkey") % 4).alias("bound"))
    by = rows.agg(F.avg("l_discount").alias("iou"), F.count_if(F.col("l_tax") > 0.07).alias("wrong"))
    return by.orderBy("wrong", "iou", "kernel", "bound").limit(1).select("kernel", "bound", F.round("iou", 6).alias("iou"), "wrong")


_GRID = "g as (select t.t as threshold, b.b as bits, avg(((value > t.t * 10) = (event_id % 64 < b.b))::int) as accuracy from events, range(0, 50) t(t), (values (8), (16), (32)) b(b) group by all)"


@query(f"with {_GRID} select threshold, bits, round(accuracy, 6) as accuracy from g order by g.accuracy desc, threshold desc, bits desc limit 1")
def grid_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    # All cells of the grid in one pass: a value and a bit class say what each cell makes of a row, so rows are counted by them first.
    classes = load(spark, sf_dir, "events").groupBy(F.ceil(F.col("value") / 10).cast("long").alias("v"), F.when(F.col("event_id") % 64 < 8, 8).when(F.col("event_id") % 64 < 16, 16).when(F.col("event_id") % 64 < 32, 32).otherwise(64).alias("b")).agg(F.count("*").alias("n"))
    cells = classes.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(49).cast("long"))).alias("threshold")).select("*", F.explode(F.array(*[F.lit(k) for k in (8, 16, 32)])).alias("bits"))
    right = (F.col("v") > F.col("threshold")) == (F.col("b") <= F.col("bits"))
    by = cells.groupBy("threshold", "bits").agg((F.sum(F.when(right, F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    return by.agg(F.max(F.struct("accuracy", "threshold", "bits")).alias("b")).select("b.threshold", "b.bits", F.round("b.accuracy", 6).alias("accuracy"))


@query("with w as (select a.a / 10.0 as a, b.a / 10.0 as b, c.a / 10.0 as c from range(11) a(a), range(11) b(a), range(11) c(a)) select a::double as a, b::double as b, c::double as c from w where abs(a + b + c - 1) < 1e-9")
def weight_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    axis = lambda n: spark.range(11).select((F.col("id") / 10.0).alias(n))
    return axis("a").crossJoin(axis("b")).crossJoin(axis("c")).where(F.abs(F.col("a") + F.col("b") + F.col("c") - 1) < 1e-9)


@query(
    """with p as (select user_id, event_id, 1 / (1 + value) as p from events where event_type = 'click'),
    r as (select *, row_number() over (partition by user_id order by p, event_id) as k, count(*) over (partition by user_id) as n from p)
    select event_id, round(least(1, greatest(0, min(p * n / k) over (partition by user_id order by k desc rows between unbounded preceding and current row))), 6) as q from r"""
)
def benjamini_hochberg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").where("event_type = 'click'").select("user_id", "event_id", (1 / (1 + F.col("value"))).alias("p"))
    return statistics.benjamini_hochberg(rows, "p", "event_id", ["user_id"]).select("event_id", F.round("q", 6).alias("q"))


@query("select event_type as kind, floor(value / 2)::bigint as bin, count(*) as n from events group by all")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind"), F.floor(F.col("value") / 2).alias("bin")).agg(F.count("*").alias("n"))


@query(f"with {FRAMES_SQL}, f as (select video, event_id, frame_no / max(frame_no) over (partition by video) as f from frames where kind <> 'error'), r as (select *, row_number() over (partition by video order by f, event_id) as r, count(*) over (partition by video) as n from f) select video, round(max(greatest(r / n - f, f - (r - 1) / n)), 6) as ks from r group by video")
def ks_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = frames(spark, sf_dir)
    # The share is of the frames that show a screen, relative to the last of these.
    shown = with_quads(every).select("video", "event_id", "frame_no")
    last = shown.groupBy("video").agg(F.max("frame_no").alias("last"))
    found = statistics.ks_uniform(shown.join(last, "video"), F.col("frame_no") / F.col("last"), ["video"], "event_id")
    return found.select("video", F.round("ks", 6).alias("ks"))


@query("select l_shipmode_ as detector, round(max(case when l_returnflag = 'A' then v end), 6) as a, round(max(case when l_returnflag = 'N' then v end), 6) as n, round(max(case when l_returnflag = 'R' then v end), 6) as r from (select l_linenumber as l_shipmode_, l_returnflag, avg(l_extendedprice / l_quantity) as v from lineitem group by all) group by 1")
def pivot_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("detector")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")))
    return rows.select("detector", *[F.round(k, 6).alias(k.lower()) for k in "ANR"])


@query("with t as (select i / 64 as threshold from range(1, 64) r(i)), b as (select threshold, avg((value / 500 > threshold * threshold)::int::double) as accuracy from events, t group by threshold) select max(threshold) as threshold, arg_max(accuracy, threshold) as accuracy from b where accuracy >= 0.95 union all select max(threshold), arg_max(accuracy, threshold) from b where accuracy >= 0.5")
def threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    thresholds = F.explode(F.array(*[F.lit(i / 64) for i in range(1, 64)]))
    rows = load(spark, sf_dir, "events").select("value", thresholds.alias("threshold")).select("threshold", ((F.col("value") / 500) > F.col("threshold") * F.col("threshold")).cast("double").alias("good"))
    return statistics.largest_threshold(rows, 0.95).unionByName(statistics.largest_threshold(rows, 0.5))


@query("select ('0x' || substr(md5(user_id || ':123'), 1, 12))::bigint % 5 as fold, count(distinct user_id) as videos, count(*) as frames from events group by 1")
def kfold_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.folds(load(spark, sf_dir, "events"), "user_id").groupBy("fold").agg(F.countDistinct("user_id").alias("videos"), F.count("*").alias("frames"))


@query()
def bootstrap_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = load(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("value"))
    return statistics.bootstrap_mean(by, "value", "user_id")
