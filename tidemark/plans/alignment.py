"""Queries over tracks and change events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import scenes, tracking
from ..sources.proxies import FOLD_SQL, FRAMES_SQL, SCREENS_SQL, frames, overlap_sql, shown, two_screens, with_quads
from ..streaming.detector import detect_batch
from .registry import query

_CORNERS = ("tlx", "tly", "trx", "try_", "blx", "bly", "brx", "bry")
TRACKS_SQL = (
    SCREENS_SQL
    + ", pairs as (select b.event_id as pair, "
    + ", ".join(f"a.{c} as a_{c}, b.{c} as b_{c}" for c in _CORNERS)
    + " from screens a join screens b on a.video = b.video and b.frame_no = a.frame_no + 1), "
    + overlap_sql("pairs")
    + """, marked as (select s.*, coalesce(o.inter, 0) <= 1e-9 as new from screens s left join shared_areas o on o.pair = s.event_id),
tracks as (select *, sum(case when new then 1 else 0 end) over (partition by video order by frame_no) as track from marked)"""
)
EVENTS_SQL = (
    TRACKS_SQL
    + """, ends as (select video, max(frame_no) as last from frames group by video),
lagged as (
  select t.*, last, [tlx, tly, trx, try_, blx, bly, brx, bry] as quad, lag(track) over w = track as same, lag(page) over w as page0, lag([tlx, tly, trx, try_, blx, bly, brx, bry]) over w as quad0,
    coalesce(lead(track) over w = track, false) as stays
  from tracks t join ends using (video) window w as (partition by video order by frame_no)),
flagged as (select *, page is not null as on_, coalesce(same, false) and page0 is not null as was from lagged),
counted as (select *, sum(case when on_ and not was then 1 else 0 end) over (partition by video order by frame_no) as no from flagged),
log as (
  select video, frame_no, 1 as phase, 'appeared' as kind, 'screen-' || no as screen_id, page, quad from counted where on_ and not was
  union all select video, frame_no, 1, 'changed-content', 'screen-' || no, page, null from counted where on_ and was and page <> page0
  union all select video, frame_no, 2, 'moved', 'screen-' || no, null, quad from counted where on_ and was and quad <> quad0
  union all select video, frame_no, 1, 'disappeared', 'screen-' || no, null, quad0 from counted where not on_ and was
  union all select video, frame_no + 1, 0, 'disappeared', 'screen-' || no, null, quad from counted where on_ and not stays and frame_no < last)"""
)


def tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.track_single(shown(frames(spark, sf_dir)))


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.screen_events(tracked(spark, sf_dir))


def _flat(log: DataFrame) -> DataFrame:
    return log.select("video", "frame_no", "phase", "kind", "screen_id", "page", F.col("quad.tl.x").alias("x0"), F.col("quad.tl.y").alias("y0"), F.col("quad.br.x").alias("x3"), F.col("quad.br.y").alias("y3"))


_COLUMNS = "video, frame_no, phase, kind, screen_id, page, quad[1] as x0, quad[2] as y0, quad[7] as x3, quad[8] as y3"


@query(f"with {EVENTS_SQL} select {_COLUMNS} from log")
def screen_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(events_log(spark, sf_dir))


@query(f"with {EVENTS_SQL} select {_COLUMNS} from log where kind = 'appeared'")
def events_appeared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(events_log(spark, sf_dir).where("kind = 'appeared'"))


@query(f"with {EVENTS_SQL} select {_COLUMNS} from log where kind = 'changed-content'")
def events_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(events_log(spark, sf_dir).where("kind = 'changed-content'"))


@query(f"with {EVENTS_SQL} select {_COLUMNS} from log where kind = 'moved'")
def events_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(events_log(spark, sf_dir).where("kind = 'moved'"))


@query(f"with {EVENTS_SQL} select {_COLUMNS} from log where kind = 'disappeared'")
def events_disappeared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(events_log(spark, sf_dir).where("kind = 'disappeared'"))


_SCENES_SQL = (
    FOLD_SQL
    + ", kept as (select video, frame_no as was, row_number() over (partition by video order by frame_no) as frame_no from fold where keep), "
    + EVENTS_SQL.replace(FRAMES_SQL, "", 1).lstrip(", ").replace("from frames where kind <> 'error'", "from ranked where kind <> 'error'").replace("from frames group by video", "from ranked group by video")
)
_SCENES_SQL = _SCENES_SQL.replace("screens as (", "ranked as (select k.video, k.frame_no, event_id, ts, kind, value from kept k join frames f on f.video = k.video and f.frame_no = k.was),\nscreens as (", 1)


@query(f"{_SCENES_SQL} select l.video, k.was as frame_no, {_COLUMNS.split('video, frame_no, ')[1]} from log l join kept k on k.video = l.video and k.frame_no = l.frame_no")
def screen_events_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events over the frames that the scene filter keeps: the next processed frame is not the next number."""
    every = frames(spark, sf_dir)
    kept = scenes.scene_filter(every, 0.15).select("video", "frame_no")
    return _flat(E.screen_events(tracking.track_single(shown(every.join(kept, ["video", "frame_no"], "left_semi")))))


@query("select * from (values ('exclusive', 0::bigint), ('appeared once', 0::bigint), ('disappeared once', 0::bigint)) t(rule, violations)")
def event_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.contract_violations(events_log(spark, sf_dir))


@query(f"with {TRACKS_SQL} select video, frame_no, track, new from tracks")
def track_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracked(spark, sf_dir).select("video", "frame_no", "track", "new")


_LANES = ", ".join(f"{c} + 400 * lane as {c}" if c in ("tlx", "trx", "blx", "brx") else c for c in _CORNERS)
TRACKS_MANY_SQL = (
    SCREENS_SQL
    + f""", lanes as (select video, frame_no, event_id, lane, 1 - lane as ix, event_id * 2 + lane as shape, {_LANES} from screens, (values (0), (1)) l(lane) where lane = 0 or event_id % 4 = 0),
pairs as (select b.shape as pair, """
    + ", ".join(f"a.{c} as a_{c}, b.{c} as b_{c}" for c in _CORNERS)
    + " from lanes a join lanes b on a.video = b.video and a.lane = b.lane and b.frame_no = a.frame_no + 1), "
    + overlap_sql("pairs")
    + """, marked as (select l.*, coalesce(o.inter, 0) <= 1e-9 as new from lanes l left join shared_areas o on o.pair = l.shape),
begun as (select *, row_number() over (partition by video order by frame_no, ix) as track from marked where new),
islands as (select *, sum(case when new then 1 else 0 end) over (partition by video, lane order by frame_no) as island from marked),
named as (select i.*, b.track from islands i join islands s on s.video = i.video and s.lane = i.lane and s.island = i.island and s.new join begun b on b.shape = s.shape),
ended as (select video, track, max(frame_no) as final from named group by all)
select video, frame_no, ix, track, case when new then 'appeared' else 'existing' end as state from named
union all select e.video, final + 1, null, track, 'disappeared' from ended e join (select video, max(frame_no) as last from frames group by 1) v on v.video = e.video where final < last"""
)


def _two_screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to two screens a frame, and the frames that show none."""
    errors = frames(spark, sf_dir).where("kind = 'error'").select("video", "frame_no")
    return two_screens(spark, sf_dir).unionByName(errors, allowMissingColumns=True)


@query(f"with {TRACKS_MANY_SQL}")
def track_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.track_many(_two_screens(spark, sf_dir))


@query()
def screen_events_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change events with several screens a frame, each with its own page."""
    found = detect_batch(_two_screens(spark, sf_dir).withColumn("page", F.col("page") + F.when(F.col("ix") == 0, 10).otherwise(0)))
    return _flat(found)


@query(
    f"""with {TRACKS_SQL} select video, frame_no, track, least(3, row_number() over w) as kept, first_value(tlx) over (partition by video, track order by frame_no rows between 2 preceding and current row) as oldest
    from tracks window w as (partition by video, track order by frame_no)"""
)
def track_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tracking.history(tracked(spark, sf_dir), 3)
    return rows.select("video", "frame_no", "track", F.size("past").cast("long").alias("kept"), F.col("past")[0]["tl"]["x"].alias("oldest"))


@query(f"with {TRACKS_SQL} select video, frame_no, event_id, case when new then 'appeared' else 'existing' end as state from tracks")
def live_screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tracked(spark, sf_dir)
    part = lambda flag, name: rows.where(F.col("new") == flag).select("video", "frame_no", "event_id", F.lit(name).alias("state"))
    return part(True, "appeared").unionByName(part(False, "existing"))


@query(f"with {FRAMES_SQL} select f.video, f.frame_no, count(s.event_id) as screens from frames f left join (select * from frames where kind <> 'error') s on s.video = f.video and s.frame_no = f.frame_no group by all")
def screens_by_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = frames(spark, sf_dir)
    lit = with_quads(every).select("video", "frame_no", "event_id")
    return every.select("video", "frame_no").join(lit, ["video", "frame_no"], "left").groupBy("video", "frame_no").agg(F.count("event_id").alias("screens"))


