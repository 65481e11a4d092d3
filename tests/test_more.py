"""Operators for several screens, gaps between processed frames, image scenes, positions, sets, artefacts and the command line."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import __main__ as command
from tidemark.functions import geometry as G
from tidemark.functions import images
from tidemark.operators import artefacts, detectors, events, neighbours, pairs, positions, scenes, spatial, statistics, tracking
from tidemark.plans.catalogue import QUERIES
from tidemark.sources import media, proxies, xml_io
from tidemark.streaming.detector import Detector, detect_batch, detect_events

FOLDER = "/root/testdata/sf0.001"


def rectangle(x, y, w=20, h=10):
    return {"tl": {"x": float(x), "y": float(y)}, "tr": {"x": float(x + w), "y": float(y)}, "bl": {"x": float(x), "y": float(y + h)}, "br": {"x": float(x + w), "y": float(y + h)}}


ROWS = f"video long, frame_no long, quad {G.QUAD}, page long"


def test_gaps_between_processed_frames(spark):
    still = spark.createDataFrame([(1, n, rectangle(0, 0), 3) for n in (1, 5, 9)], ROWS)
    log = events.screen_events(tracking.track_single(still)).collect()
    assert [(r.frame_no, r.kind) for r in log] == [(1, "appeared")]
    assert {r.track for r in tracking.track_many(still.withColumn("ix", F.lit(0))).collect()} == {1}
    lost = still.unionByName(spark.createDataFrame([(1, 6, None, None), (1, 30, None, None)], ROWS))
    log = events.screen_events(tracking.track_single(lost)).orderBy("frame_no").collect()
    assert [(r.frame_no, r.kind, r.screen_id) for r in log] == [(1, "appeared", "screen-1"), (6, "disappeared", "screen-1"), (9, "appeared", "screen-2"), (30, "disappeared", "screen-2")]
    apart = events.screen_events(tracking.track_single(still, lost.select("video", "frame_no")))
    assert sorted((r.frame_no, r.kind) for r in apart.collect()) == sorted((r.frame_no, r.kind) for r in log)


def several(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for video in (1, 2):
        for n in range(1, 60, 2):
            count = int(rng.integers(0, 4))
            rows += [(video, n, i, rectangle(60 * int(k) + int(rng.integers(0, 12)), 0), int(rng.integers(1, 3)) if rng.random() < 0.8 else None) for i, k in enumerate(rng.permutation(4)[:count])]
            rows += [(video, n, None, None, None)] * (not count)
    return rows


def test_several_screens_in_batch_and_stream(spark, tmp_path):
    rows = several(5)
    frames = spark.createDataFrame(rows, f"video long, frame_no long, ix long, quad {G.QUAD}, page long")
    want = []
    for video in (1, 2):
        d = Detector()
        for n in sorted({r[1] for r in rows if r[0] == video}):
            own = sorted((r for r in rows if r[:2] == (video, n) and r[3]), key=lambda r: r[2])
            want += [(video, *e) for e in d.frame(n, [(tracking.outline(r[3]), r[4]) for r in own])]
    found = detect_batch(frames.repartition(5))
    assert found.where("(quad is not null) = (kind in ('appeared', 'moved'))").count() == found.count()
    assert sorted(map(tuple, found.drop("quad").collect()), key=repr) == sorted(want, key=repr) and len(want) > 50
    tracks = tracking.track_many(frames)
    assert tracks.where("state <> 'disappeared'").count() == sum(r[3] is not None for r in rows)
    # Frames come out of order by up to two of them; a delay of four numbers puts them right.
    plain = spark.createDataFrame([(r[0], r[1], r[3], r[4]) for r in rows], ROWS)
    for i, part in enumerate((range(1, 20), range(22, 30), range(20, 22), range(30, 60))):
        plain.where(F.col("frame_no").isin(*part)).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    found = {}
    for delay in (0, 12):
        q = detect_events(stream, delay).writeStream.format("memory").queryName(f"several{delay}").option("checkpointLocation", f"{tmp_path}/state{delay}").start()
        q.processAllAvailable()
        q.stop()
        found[delay] = {tuple(r)[:5] for r in spark.table(f"several{delay}").collect()}
    batch = {tuple(r)[:5] for r in detect_batch(plain).collect()}
    assert found[12] == {e for e in batch if e[1] <= 59 - 12}
    assert found[0] != batch  # what came late was dropped


def test_image_scenes(spark):
    rng = np.random.default_rng(3)
    base = [rng.integers(0, 256, (30, 40, 4)).astype(np.uint8) for _ in range(3)]
    rows = [(v, n, 30, 40, bytearray(base[k].tobytes())) for v in (1, 2) for n, k in zip((1, 4, 6, 9, 11), (0, 0, 1, 1, 2), strict=True)]
    frames = spark.createDataFrame(rows, "video long, frame_no long, height int, width int, image binary")
    kept = scenes.scene_filter_images(frames, 0.01, 32, 24).orderBy("video", "frame_no").collect()
    assert [(r.video, r.frame_no) for r in kept] == [(v, n) for v in (1, 2) for n in (1, 6, 11)]
    grey = np.full((1, 1, 3), 255, np.uint8)
    assert images.lab(grey).tolist() == [[[255, 128, 128]]] and images.lab(grey * 0).tolist() == [[[0, 128, 128]]]
    assert images.lab(np.array([[[255, 0, 0]]], np.uint8)).tolist() == [[[136, 208, 195]]]
    plain = spark.createDataFrame([(1, n, float(v)) for n, v in enumerate((0, 5, 250, 251, 3))], "video long, frame_no long, value double")
    assert [r.frame_no for r in scenes.scene_filter(plain, 0.15).orderBy("frame_no").collect()] == [0, 2, 4]


def test_screens_by_annotated_positions(spark, tmp_path):
    side = lambda x: " ".join(f'{k}{i}="{v}"' for i, (a, b) in enumerate(((x, 0), (x + 9, 0), (x, 7), (x + 9, 7))) for k, v in (("x", a), ("y", b)))
    (tmp_path / "r.xml").write_text(
        f"""<i><institution id="u"><rooms><room id="7"><cameras><camera id="c1" name="c" width="100" height="80"/><camera id="c2" name="c" width="10" height="8"/></cameras><screens>
        <screen id="a" name="n" until="2018-03-01T00:00:00" aspect-width="4" aspect-height="3"><positions camera="c1"><position {side(5)} datetime="2018-01-10T00:00:00"/><position {side(95)} datetime="2018-02-01T00:00:00"/></positions></screen>
        <screen id="b" name="n" from="2018-01-20T00:00:00" aspect-width="4" aspect-height="3"><positions camera="c1"><position {side(30)} datetime="2018-01-01T00:00:00"/></positions></screen></screens></room></rooms></institution></i>"""
    )
    tables = xml_io.read_positions(spark, f"{tmp_path}/r.xml")
    days = ["2018-01-05", "2018-01-15", "2018-01-25", "2018-02-10", "2018-03-05"]
    frames = spark.createDataFrame([(d,) for d in days], "day string").withColumn("at", F.to_timestamp("day"))
    seen = lambda **k: {(r.day, r.screen, r.quad.tl.x) for r in positions.annotated_screens(frames, tables, "u", "7", "c1", **k).collect()}
    want = {("2018-01-15", "a", 5.0), ("2018-01-25", "a", 5.0), ("2018-01-25", "b", 30.0), ("2018-02-10", "a", 95.0), ("2018-02-10", "b", 30.0), ("2018-03-05", "b", 30.0)}
    assert seen() == want and seen(beyond_bounds=False) == {x for x in want if x[2] < 90}
    for wrong in (("x", "7", "c1"), ("u", "8", "c1"), ("u", "7", "c9")):
        with pytest.raises(KeyError):
            positions.annotated_screens(frames, tables, *wrong)


def test_sets_of_quadrangles(spark):
    rows = lambda xs: spark.createDataFrame([(1, i, rectangle(x, 0)) for i, x in xs], f"video long, id long, quad {G.QUAD}")
    held = spatial.QuadSet(rows([(1, 0), (2, 50), (3, 0)]), ["video"])
    assert held.rows.count() == 2
    more = held.add(rows([(9, 50), (8, 90)]))
    assert more.rows.count() == 3 and more.discard(rows([(0, 90), (0, 7)])).rows.count() == 2
    assert {r.id for r in more.holds(rows([(5, 90), (6, 91)])).collect()} == {5}
    assert {(r.id, r.other): round(r.jaccard, 6) for r in more.overlapping(rows([(5, 100)])).collect()} == {(5, 8): round(100 / 300, 6)}


def test_splits_and_artefacts(spark, tmp_path):
    rows = spark.createDataFrame([(f"v{i % 7}", i) for i in range(70)], "video string, frame long")
    parts = statistics.peeking(rows, "video", "frame").collect()
    assert all(len({r.fold for r in parts if r.video == v}) == 1 and sum(r.peek for r in parts if r.video == v) == 1 for v in {r.video for r in parts})
    assert statistics.leave_one_out(rows, "video").groupBy("held_out").count().where("count = 60").count() == 7
    assert {r.frame for r in statistics.nth(rows, ["video"], "frame", 2).collect()} == set(range(14, 21))
    moments = pairs.moments(spark.createDataFrame([([1.0, 2.0],), ([3.0, 2.0],)], "vec array<double>"))
    artefacts.save_moments(moments, f"{tmp_path}/m")
    assert sorted(map(tuple, artefacts.load_moments(spark, f"{tmp_path}/m").collect())) == sorted(map(tuple, moments.collect()))
    moments.withColumn("format_version", F.lit(2)).write.parquet(f"{tmp_path}/n")
    with pytest.raises(ValueError, match="format"):
        artefacts.load_moments(spark, f"{tmp_path}/n")
    assert artefacts.numbers("1.5, 2") == [1.5, 2.0] and artefacts.learning_rates("0.1") == (0.1, 0.1) and artefacts.learning_rates("0.1, 0.2") == (0.1, 0.2)
    assert artefacts.methods("on, off, on") == {"base": True, "erosion_dilation": False, "ratio_split": True}
    for wrong in (lambda: artefacts.learning_rates("1, 2, 3"), lambda: artefacts.methods("on, off")):
        with pytest.raises(ValueError):
            wrong()


def test_maps_pages_and_masks():
    corners = np.array([(10, 10), (50, 10), (10, 40), (50, 40)], float)
    plain, w, h = images.screen_map(corners)
    wide, w2, h2 = images.screen_map(corners, 2.0)
    assert (w, h, w2, h2) == (40, 30, 60, 30)
    at = lambda m, x, y: (lambda v: v[:2] / v[2])(m @ np.array([x, y, 1.0]))
    assert np.allclose(at(plain, 50, 40), (39, 29)) and np.allclose(at(wide, 50, 40), (39 * 1.5, 29))
    image = np.random.default_rng(1).integers(0, 256, (60, 80, 4)).astype(np.uint8)
    assert images.screen_image(image, corners).shape == (30, 40, 4) and images.screen_image(image, corners, 2.0).shape == (30, 60, 4)
    assert images.grey(image, 40, 30).shape == (30, 40)
    asked = []
    page = images.page_image(lambda zoom: asked.append(zoom) or np.full((round(100 * zoom), round(50 * zoom), 4), 200, np.uint8), (50, 100), 40, 40)
    assert page.shape == (40, 40, 4) and asked[0] >= 0.8 and page[:, :10].max() == 0 and page[:, 10:30].min() == 200
    halved = images.shrink(np.arange(16.0).reshape(4, 4, 1), 2, 2)
    assert halved[..., 0].tolist() == [[2.0, 4.0], [10.0, 12.0]]
    mask = (np.arange(12).reshape(3, 4) * 20).astype(np.uint8)
    assert (images.tensor_mask(images.mask_tensor(mask)) == mask).all() and images.tensor_mask(images.mask_tensor(mask), 8, 6).shape == (6, 8)


def test_sources_refuse_what_they_cannot_read(spark, tmp_path):
    for n in ("b.png", "a.JPG", "notes.txt"):
        (tmp_path / n).write_bytes(n.encode())
    assert [bytes(r.content) for r in media.image_directory(spark, str(tmp_path)).orderBy("page_no").collect()] == [b"a.JPG", b"b.png"]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.txt").write_text("x")
    with pytest.raises(ValueError, match="no images"):
        media.image_directory(spark, f"{tmp_path}/none")
    assert media.videos(spark, f"{tmp_path}/none", lambda data: [(1, 0, 2, 2, data), (2, 40_000, 2, 2, data)], "*.txt").count() == 2


def test_event_elements_follow_the_schema(spark):
    log = events.screen_events(tracking.track_single(spark.createDataFrame([(1, 1, rectangle(0, 0), 3), (1, 2, rectangle(1, 0), 4), (1, 3, None, None)], ROWS))).withColumn("document_uri", F.lit('a&b".pdf'))
    uris = spark.createDataFrame([(1, "file:///v.mp4")], "video long, video_uri string")
    text = xml_io.event_documents(log, 25, uris).first().xml
    assert text.startswith('<events video-uri="file:///v.mp4">')
    # Fixed values of the format: elements and the attributes each must have.
    head, page, place = ["screen-id", "frame-number", "frame-duration"], ["document-uri", "page-number"], [f"{k}{i}" for i in range(4) for k in "xy"]
    wanted = {"screen-appeared-event": head + page + place, "screen-changed-content-event": head + page, "screen-moved-event": head + place, "screen-disappeared-event": head}
    found = re.findall(r"<(screen-[a-z-]+)((?: [a-z0-9-]+=\"[^\"]*\")*)/>", text)
    assert [n for n, _ in found] == ["screen-appeared-event", "screen-changed-content-event", "screen-moved-event", "screen-disappeared-event"]
    for name, attributes in found:
        assert re.findall(r" ([a-z0-9-]+)=", attributes) == wanted[name]
    assert 'document-uri="a&amp;b&quot;.pdf"' in text


def test_trained_distance_and_recall(spark):
    rng = np.random.default_rng(2)
    make = lambda n, m: spark.createDataFrame([(n + i, v.tolist()) for i, v in enumerate(rng.normal(size=(m, 4)))], "id long, vec array<double>")
    screens, pages = make(0, 20), make(100, 10)
    distance = detectors.sigmoid_distance(3.0, -3.0, 0.42857142857142855)
    a = detectors.siamese(screens, pages, slope=3.0, intercept=-3.0).orderBy("id").collect()
    assert a == neighbours.best_or_none(screens, pages, "euclidean", distance).orderBy("id").collect()
    with pytest.raises(ValueError):
        detectors.siamese(screens, pages)
    near = {r.id: r.page for r in QUERIES["knn_lsh"](spark, FOLDER).collect()}
    whole = {r.id: r.page for r in neighbours.nearest(*reversed(proxies.features(spark, FOLDER)), "euclidean").collect()}
    assert np.mean([near.get(k) == v for k, v in whole.items()]) >= 0.9


def test_equal_screens_collapse(spark):
    rows = spark.createDataFrame([(1, 1, 0, rectangle(0, 0)), (1, 1, 1, rectangle(0, 0)), (1, 1, 2, rectangle(5, 0))], f"video long, frame_no long, ix long, quad {G.QUAD}")
    assert {r.ix for r in events.collapse_equal(rows).collect()} == {1, 2}


def test_command_line(spark, tmp_path):
    pages = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vec array<double>")
    rows = [(1, n, rectangle(0, 0), [1.0, 0.1] if n < 6 else [0.1, 1.0], 0.0 if n < 6 else 250.0) for n in range(1, 10)]
    spark.createDataFrame(rows, f"video long, frame_no long, quad {G.QUAD}, vec array<double>, value double").write.parquet(f"{tmp_path}/s")
    pages.write.parquet(f"{tmp_path}/p")
    for scene, tracker in (("none", "windows"), ("distance", "windows"), ("none", "fold")):
        out = f"{tmp_path}/{scene}-{tracker}"
        command.main(["--screens", f"{tmp_path}/s", "--pages", f"{tmp_path}/p", "--output", out, "--scene-detector", scene, "--tracker", tracker, "--page-detector", "vgg16", "--document-uri", "slides.pdf", "--quiet"])
        text = "\n".join(r.value for r in spark.read.text(out).collect())
        assert re.findall(r'<(screen-[a-z-]+) screen-id="([^"]*)" frame-number="(\d+)"', text) == [("screen-appeared-event", "screen-1", "1"), ("screen-changed-content-event", "screen-1", "6")]
        assert text.count('document-uri="slides.pdf"') == 2
