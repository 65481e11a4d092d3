"""Queries over sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import media, xml_io
from ..sources.proxies import FPS, FRAMES_SQL, frames, load
from .alignment import EVENTS_SQL, events_log
from .registry import query
from .scalars import DURATION_SQL, ELAPSED_SQL


@query(f"with {FRAMES_SQL} select 'video-' || video as video_uri, frame_no, kind, value from frames")
def frames_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select(F.concat(F.lit("video-"), F.col("video").cast("string")).alias("video_uri"), "frame_no", "kind", "value")


@query("select source as document_uri, count(*) as pages, min(doc_id) as first, nullif(max(case when doc_id % 2 = 0 then lang end), 'en') as title from documents group by source")
def documents_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").groupBy(F.col("source").alias("document_uri"))
    title = F.max(F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    return rows.agg(F.count("*").alias("pages"), F.min("doc_id").alias("first"), F.nullif(title, F.lit("en")).alias("title"))


@query("select source as document_uri, doc_id, row_number() over (partition by source order by doc_id)::int as page_no from documents")
def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").select(F.col("source").alias("document_uri"), "doc_id")
    return media.numbered(rows, "document_uri", F.col("doc_id"))


@query("select p_partkey, case when lower(path) like '%.pdf' then 'pdf' else 'images' end as reader from (select p_partkey, 'docs/' || p_name || case p_partkey % 3 when 0 then '.pdf' when 1 then '.PDF' else '' end as path from part)")
def document_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.when(F.col("p_partkey") % 3 == 0, ".pdf").when(F.col("p_partkey") % 3 == 1, ".PDF").otherwise("")
    return media.routed(load(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("docs/"), F.col("p_name"), end).alias("path"))).select("p_partkey", "reader")


_ELEMENTS = (
    EVENTS_SQL
    + """, lines as (select video, frame_no, phase, screen_id, kind, page, quad,
  '<screen-' || kind || '-event screen-id="' || screen_id || '" frame-number="' || frame_no || '" frame-duration="' || """
    + DURATION_SQL
    + """ || '"' || case when page is not null then ' document-uri="document" page-number="' || page || '"' else '' end
  || case when kind in ('appeared', 'moved') then """
    + " || ".join(f"' {k}{i}=\"' || quad[{2 * i + 1 + (k == 'y')}] || '\"'" for i in range(4) for k in "xy")
    + """ else '' end || '/>' as element from (select *, """
    + ELAPSED_SQL
    + """ as us from log))"""
)


@query(f"with {_ELEMENTS} select video, '<events video-uri=\"' || video || '\">' || chr(10) || string_agg(element, chr(10) order by frame_no, phase, screen_id, kind, element) || chr(10) || '</events>' as xml from lines group by video")
def events_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xml_io.event_documents(events_log(spark, sf_dir), FPS)


@query(f"with {EVENTS_SQL} select video, kind, screen_id, frame_no, case when kind in ('appeared', 'moved') then quad[1] end as x0, page from log")
def xml_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads back, element by element, what the sink writes for every event."""
    elements = xml_io.event_elements(events_log(spark, sf_dir), FPS)
    parsed = F.from_xml("element", "`_screen-id` string, `_frame-number` bigint, `_frame-duration` string, `_x0` double, `_y0` double, `_page-number` bigint")
    return elements.select("video", "kind", parsed.alias("e")).select("video", "kind", F.col("e.`_screen-id`").alias("screen_id"), F.col("e.`_frame-number`").alias("frame_no"), F.col("e._x0").alias("x0"), F.col("e.`_page-number`").alias("page"))


@query("select user_id, value as x0, event_id::double as y0, epoch(ts)::bigint as at from (select user_id, value, event_id, date_trunc('second', ts) as ts from events where event_type = 'signup')")
def xml_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions as elements with a time, read back by time (whole seconds)."""
    rows = load(spark, sf_dir, "events").where("event_type = 'signup'")
    text = F.format_string('<position x0="%s" y0="%s" datetime="%s"/>', F.col("value").cast("string"), F.col("event_id").cast("string"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    parsed = F.from_xml(text, "_x0 double, _y0 double, _datetime timestamp")
    return rows.select("user_id", parsed.alias("p")).select("user_id", F.col("p._x0").alias("x0"), F.col("p._y0").alias("y0"), F.unix_seconds("p._datetime").alias("at"))
