"""Queries over scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.proxies import FPS, FRAMES_SQL, frames, load
from .registry import query


@query(f"with {FRAMES_SQL} select video, frame_no, round_even((frame_no - 1) * 1000000.0::double / {FPS}, 0)::bigint as elapsed, epoch_us(timestamp '2024-01-01') + round_even((frame_no - 1) * 1000000.0::double / {FPS}, 0)::bigint as captured from frames")
def frame_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    elapsed = S.elapsed_micros(F.col("frame_no"), FPS)
    start = F.unix_micros(F.to_timestamp(F.lit("2024-01-01 00:00:00+00:00")))
    return frames(spark, sf_dir).select("video", "frame_no", elapsed.alias("elapsed"), (start + elapsed).alias("captured"))


@query(f"with {FRAMES_SQL} select video, (frame_no - 1) // 10 as batch, count(*) as n, min(frame_no) as first, max(frame_no) as last from frames group by all")
def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir).withColumn("batch", S.batch_no(F.col("frame_no"), 10))
    return rows.groupBy("video", "batch").agg(F.count("*").alias("n"), F.min("frame_no").alias("first"), F.max("frame_no").alias("last"))




@query(
    """with p as (select p_partkey, 600 + p_partkey % 400 as w, 400 + p_size as h, case p_partkey % 3 when 0 then 4 when 1 then 16 else 1 end as a, case p_partkey % 3 when 0 then 3 when 1 then 9 else 1 end as b from part)
    select p_partkey, case when w * b < h * a then round_even((h * a)::double / b, 0)::bigint else w end as width, case when w * b < h * a then h else round_even((w * b)::double / a, 0)::bigint end as height from p"""
)
def upscale_aspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_partkey") % 3
    a, b = F.when(kind == 0, 4).when(kind == 1, 16).otherwise(1), F.when(kind == 0, 3).when(kind == 1, 9).otherwise(1)
    size = S.upscale_aspect(600 + F.col("p_partkey") % 400, (400 + F.col("p_size")).cast("long"), a, b)
    return load(spark, sf_dir, "part").select("p_partkey", size.alias("s")).select("p_partkey", "s.*")


@query(
    """with p as (select p_partkey, 600 + p_partkey % 400 as w, 400 + p_size as h, case when p_partkey % 5 < 3 then 500 + p_partkey % 333 end as nw, case when p_partkey % 5 in (1, 2, 3) then 450 + p_size end as nh from part),
    q as (select *, least(nw::double / w, nh::double / h) as ratio, nw is not null and nh is not null as both_, nw is null and nh is null as none_ from p),
    r as (select *, round_even(w * ratio, 0) as rw, round_even(h * ratio, 0) as rh from q)
    select p_partkey, case when both_ then rw when none_ then w when nw is null then floor(nh * w / h) else nw end::bigint as width,
      case when both_ then rh when none_ then h when nw is null then nh else floor(nw * h / w) end::bigint as height,
      case when both_ then floor((nh - rh) / 2) else 0 end::bigint as top, case when both_ then ceil((nh - rh) / 2) else 0 end::bigint as bottom,
      case when both_ then floor((nw - rw) / 2) else 0 end::bigint as "left", case when both_ then ceil((nw - rw) / 2) else 0 end::bigint as "right" from r"""
)
def rescale_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    box = S.rescale_box(600 + key % 400, (400 + F.col("p_size")).cast("long"), F.when(key % 5 < 3, 500 + key % 333), F.when((key % 5).isin(1, 2, 3), (450 + F.col("p_size")).cast("long")))
    return load(spark, sf_dir, "part").select("p_partkey", box.alias("b")).select("p_partkey", "b.*")


ELAPSED_SQL = f"round_even((frame_no - 1) * 1000000.0::double / {FPS}, 0)::bigint"
_DURATION = "'P' || us // 86400000000 || 'DT' || us % 86400000000 // 1000000 || '.'"
#: The duration of ``us`` microseconds as the event documents have it.
DURATION_SQL = f"{_DURATION} || lpad((us % 1000000)::varchar, 6, '0') || 'S'"


@query(f"with {FRAMES_SQL}, t as (select video, frame_no, {ELAPSED_SQL} as us from frames) select video, frame_no, {_DURATION} || lpad((us % 1000000)::varchar, 6, '0') || 'S' as duration, {_DURATION} || us % 1000000 || 'S' as unpadded from t")
def xsd_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = S.elapsed_micros(F.col("frame_no"), FPS)
    return frames(spark, sf_dir).select("video", "frame_no", S.xsd_duration(us).alias("duration"), S.xsd_duration(us, False).alias("unpadded"))


@query(f"with {FRAMES_SQL} select video, frame_no, {ELAPSED_SQL} as micros from frames")
def xsd_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = S.elapsed_micros(F.col("frame_no"), FPS)
    return frames(spark, sf_dir).select("video", "frame_no", S.duration_micros(S.xsd_duration(us, False)).alias("micros"))


@query(
    """with c as (select user_id, count(*) filter (event_type = 'purchase')::double as k, count(*)::double as n from events group by 1), p as (select *, 3.841458820694124 as z2, 1.959963984540054 as z from c),
    a as (select *, (k + z2 / 2) / (n + z2) as m from p), r as (select *, z * sqrt(m * (1 - m) / (n + z2)) as r from a)
    select user_id, round(k / n, 6) as share, round(greatest(0, m - r), 6) as low, round(least(1, m + r), 6) as high from r"""
)
def wald_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = load(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("k"), F.count("*").alias("n"))
    rows = counts.select("user_id", S.wald_interval(F.col("k"), F.col("n")).alias("w"))
    return rows.select("user_id", *[F.round(f"w.{x}", 6).alias(x) for x in ("share", "low", "high")])


@query("select page_id, array_to_string(string_split(url, '/')[-2:], '/') as tail from pages")
def path_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", S.path_tail(F.col("url")).alias("tail"))


@query("select page_id, " + ", ".join(f"regexp_extract(url, '^(https?)://([^/?#]+)/([a-z]+)/([^?#]*)', {i}) as {n}" for i, n in enumerate(("scheme", "host", "section", "name"), 1)) + " from pages")
def uri_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", S.uri_parts(F.col("url")).alias("u")).select("page_id", "u.*")


@query("select event_id, (json_extract(props, '$.k'))::bigint as k, [[(json_extract(props, '$.k'))::double, value]] as vectors from events")
def json_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k bigint")["k"])
    text = F.to_json(F.array(F.array(F.col("k").cast("double"), F.col("value"))))
    return rows.select("event_id", "k", F.from_json(text, "array<array<double>>").alias("vectors"))


@query("select doc_id, count(*) as chunks, md5(string_agg(part, '' order by i)) as digest from (select doc_id, i, substr(text, i * 1000 + 1, 1000) as part from (select doc_id, text, unnest(range(greatest(1, (length(text) + 999) // 1000))) as i from documents)) group by doc_id")
def chunk_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, size = F.col("text"), 1000
    parts = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(text) - 1) / size)).cast("int")), lambda i: F.substr(text, i * size + 1, F.lit(size)))).alias("i", "part"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "part"))), lambda p: p["part"]), "")
    return parts.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.md5(whole.cast("binary")).alias("digest"))


@query("select source, md5(string_agg(name, ',' order by name)) as digest from (select distinct source, 'lecture-' || doc_id % 50 as name from documents) group by source")
def training_set_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = load(spark, sf_dir, "documents").select("source", F.concat(F.lit("lecture-"), (F.col("doc_id") % 50).cast("string")).alias("name")).distinct()
    return names.groupBy("source").agg(F.md5(F.array_join(F.array_sort(F.collect_list("name")), ",").cast("binary")).alias("digest"))


@query("select distinct l_partkey as missing from lineitem where l_partkey not in (select p_partkey from part where p_size > 5)")
def missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = load(spark, sf_dir, "part").where("p_size > 5").select("p_partkey")
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("missing")).distinct()
    return rows.join(known, F.col("missing") == F.col("p_partkey"), "left_anti")


@query(
    """with a as (select distinct user_id from events where event_type = 'view' and value > 400), b as (select distinct user_id from events where event_type = 'click' and value > 400)
    select 'union' as op, user_id from (select * from a union select * from b) union all select 'intersect', user_id from (select * from a intersect select * from b)
    union all select 'except', user_id from (select * from a except select * from b)"""
)
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda kind: load(spark, sf_dir, "events").where((F.col("event_type") == kind) & (F.col("value") > 400)).select("user_id").distinct()
    a, b = pick("view"), pick("click")
    named = lambda name, df: df.select(F.lit(name).alias("op"), "user_id")
    return named("union", a.union(b).distinct()).union(named("intersect", a.intersect(b))).union(named("except", a.join(b, "user_id", "left_anti")))


