"""Fixed cases for geometry, tracking, events, joins, scalars, images, masks and sources."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import geometry as G
from tidemark.functions import images, scalars
from tidemark.operators import asof, ensemble, evaluation, events, neighbours, pairs, postprocess, scenes, spatial, statistics, tracking
from tidemark.plans.catalogue import QUERIES
from tidemark.sources import chunks, media, proxies, xml_io
from tidemark.streaming.detector import Detector, detect_events

FOLDER = "/root/testdata/sf0.001"
QUADS = {
    "q1": ((5, 3), (3, 5), (3, 1), (1, 3)), "q2": ((4, 2), (6, 1), (6, 4), (8, 2)), "q3": ((1, 4), (0, 4), (1, 2), (0, 2)), "q4": ((0, 0), (10, 0), (0, 10), (10, 10)),
    "q5": ((0, 0), (3, 0), (0, 6), (3, 6)), "t1": ((0, 2), (2, 2), (0, 0), (2, 0)), "t2": ((-1, 1), (1, 1), (-1, -1), (1, -1)), "t3": ((-2, 0), (0, 0), (-2, -2), (0, -2)),
    "t4": ((-4, 0), (-2, 0), (-4, -4), (-2, -4)), "m1": ((0, 0), (3, 3), (0, 3), (3, 3)), "m2": ((1, 1), (4, 4), (1, 4), (4, 4)), "m3": ((3, 3), (6, 6), (3, 6), (6, 6)),
    "e1": ((10, 10), (30, 10), (10, 30), (30, 30)), "e2": ((20, 20), (40, 20), (20, 40), (40, 40)), "a0": ((0, 0),) * 4, "a1": ((4, 0), (8, 0), (5, 6), (6, 6)),
}


def value(q):
    return None if q is None else {c: {"x": float(x), "y": float(y)} for c, (x, y) in zip(G.CORNERS, QUADS[q], strict=True)}


def quads(spark, names, more=()):
    return spark.createDataFrame([(n, value(n)) for n in names], f"id string, quad {G.QUAD}")


def test_areas_and_overlaps(spark):
    areas = {r.id: r.a for r in quads(spark, QUADS).select("id", G.area(F.col("quad")).alias("a")).collect()}
    assert (areas["q1"], areas["a0"], areas["a1"]) == (8, 0, 15)
    a, b = quads(spark, QUADS).toDF("a", "qa"), quads(spark, QUADS).toDF("b", "qb")
    shared = {(r.a, r.b): r.s for r in a.crossJoin(b).select("a", "b", G.overlap("qa", "qb").alias("s")).collect()}
    assert [round(shared["t1", t], 9) for t in ("t1", "t2", "t3", "t4")] == [4, 1, 0, 0]
    assert round(shared["q5", "q1"], 9) == 4 and round(shared["q5", "q2"], 9) == 0 and round(shared["m2", "m3"], 9) == 0.5
    for (x, y), s in shared.items():
        assert abs(s - shared[y, x]) < 1e-9
        outline = lambda n: tuple(QUADS[n][i] for i in (0, 1, 3, 2))
        assert abs(s - tracking.clip_area(outline(x), outline(y))) < 1e-9


def test_jaccard_join_needs_overlap(spark):
    left, right = (quads(spark, n).withColumn("video", F.lit(1)) for n in (["q5"], ["q1", "q2", "q3", "q4", "q5"]))
    for cell in (1.0, 4.0, 64.0):
        found = {r.other: round(r.jaccard, 9) for r in spatial.jaccard_join(left, right, ["video"], cell).collect()}
        assert found == {"q1": round(4 / 22, 9), "q3": round(2 / 18, 9), "q4": 0.18, "q5": 1.0}


def test_jaccard_join_takes_all_screens_of_a_video(spark):
    rows = {(r.video, *((q := r.quad)[c][x] for c in G.CORNERS for x in "xy")) for r in proxies.screens(spark, FOLDER).collect()}
    by, want = {}, {}
    for video, *corners in sorted(rows):
        by.setdefault(video, []).append([tuple(corners[i : i + 2]) for i in (0, 2, 4, 6)])
    for video, found in by.items():
        outlines = [tuple(q[i] for i in (0, 1, 3, 2)) for q in found]
        for i, a in enumerate(outlines):
            for j, b in enumerate(outlines):
                if (shared := tracking.clip_area(a, b)) > 1e-9:
                    want[video, i + 1, j + 1] = shared
    found = {(r.video, r.id, r.other): r.inter for r in QUERIES["jaccard_join"](spark, FOLDER).collect()}
    assert found.keys() == want.keys() and all(abs(v - want[k]) < 1e-5 for k, v in found.items())


def test_order_bounds_split_and_corners(spark):
    rows = quads(spark, ["t1"]).crossJoin(quads(spark, ["t2"]).toDF("o", "other"))
    r = rows.select(G.precedes(F.col("other"), F.col("quad")).alias("p"), G.bounds(F.col("quad")).alias("b"), G.ratio_split(F.col("quad")).alias("s")).first()
    assert r.p and (r.b.left, r.b.top, r.b.right, r.b.bottom) == (0, 0, 2, 2) and len(r.s) == 1


def test_tracker_script():
    outline = lambda n: tuple(QUADS[n][i] for i in (0, 1, 3, 2))
    t = tracking.Tracker()
    first = t.update([outline("m1")])
    assert first[1] == {0}
    assert t.update([outline("m2")]) == ({0: 1}, set(), [])
    assert t.update([outline("m3")]) == ({0: 1}, set(), [])
    given, new, gone = t.update([outline("m1"), outline("m3")])
    assert new == {0} and given[1] == 1 and not gone
    given, new, gone = t.update([outline("m2")])
    assert given == {0: 2} and not new and gone == [1]
    assert t.update([])[2] == [2] and not t.alive
    with pytest.raises(ValueError):
        tracking.history(None, 1)


SCRIPT = [(1, "e1", 1), (2, "e1", 2), (3, "e2", 2), (4, "e2", 1), (5, None, None)]
EXPECTED = [(1, "appeared", 1), (2, "changed-content", 2), (3, "moved", None), (4, "changed-content", 1), (5, "disappeared", None)]


def log_of(spark, script):
    frames = spark.createDataFrame([(7, n) for n, _, _ in script], "video long, frame_no long")
    shown = spark.createDataFrame([(7, n, value(q), p) for n, q, p in script if q], f"video long, frame_no long, quad {G.QUAD}, page long")
    return events.screen_events(tracking.track_single(shown), frames)


def test_scripted_video(spark):
    rows = log_of(spark, SCRIPT).orderBy("frame_no", "phase").collect()
    assert [(r.frame_no, r.kind, r.page) for r in rows] == EXPECTED and {r.screen_id for r in rows} == {"screen-1"}
    d = Detector()
    out = [e for n, q, p in SCRIPT for e in d.frame(n, [(tuple(QUADS[q][i] for i in (0, 1, 3, 2)), p)] if q else [])]
    assert [(n, k, p) for n, _, k, _, p in out] == EXPECTED
    assert log_of(spark, []).count() == 0
    again = log_of(spark, [(1, "e1", 1), (2, "e1", None), (3, "e1", 4)]).orderBy("frame_no").collect()
    assert [(r.kind, r.screen_id) for r in again] == [("appeared", "screen-1"), ("disappeared", "screen-1"), ("appeared", "screen-2")]
    assert [r.kind for r in log_of(spark, [(1, "e1", 1), (2, "e2", 2)]).orderBy("frame_no", "phase").collect()] == ["appeared", "changed-content", "moved"]


def test_stream_equals_batch(spark, tmp_path):
    schema = f"video long, frame_no long, quad {G.QUAD}, page long"
    for i, part in enumerate((SCRIPT[:2], SCRIPT[2:])):
        spark.createDataFrame([(v, n, value(q), p) for v in (1, 2) for n, q, p in part], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = detect_events(stream).writeStream.format("memory").queryName("found").option("checkpointLocation", f"{tmp_path}/state").start()
    q.processAllAvailable()
    q.stop()
    rows = spark.table("found").orderBy("video", "frame_no", "phase").collect()
    assert [(r.frame_no, r.kind, r.page) for r in rows if r.video == 2] == EXPECTED


def test_event_xml(spark, tmp_path):
    text = xml_io.event_documents(log_of(spark, SCRIPT), 15).first().xml
    assert text.startswith('<events video-uri="7">') and text.count("<screen-") == 5 and 'frame-duration="P0DT0.066667S"' in text
    xml_io.write_events(log_of(spark, SCRIPT), 15, f"{tmp_path}/out")
    assert "\n".join(r.value for r in spark.read.text(f"{tmp_path}/out").collect()) == text


def test_positions_as_of(spark):
    at = lambda s: f"timestamp'{s}'"
    screens = spark.sql(
        f"""select * from values ('none', null, null), ('late', {at("2018-01-01 00:00:01")}, null), ('ends', null, {at("2018-03-01")}) t(screen, since, until)"""
    )
    positions = screens.select("screen").crossJoin(spark.sql(f"select explode(array({at('2018-01-01')}, {at('2018-02-01')}, {at('2018-03-01')})) as at")).withColumn("p", F.date_format("at", "MM-dd"))
    times = screens.crossJoin(spark.sql(f"select explode(array({at('2017-12-31 23:59:59')}, {at('2018-01-01')}, {at('2018-01-01 00:00:01')}, {at('2018-02-28')}, {at('2018-03-01')})) as at"))
    rows = asof.valid_positions(times, positions, ["screen"], "at", F.col("p"), "p", until="until", since="since")
    found = {}
    for r in rows.orderBy("at").collect():
        found.setdefault(r.screen, []).append(r.p)
    assert found == {"none": ["01-01", "01-01", "02-01", "03-01"], "late": ["01-01", "02-01", "03-01"], "ends": ["01-01", "01-01", "02-01"]}


def test_scalars(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c.alias("v")).first().v
    lit = lambda *v: [F.lit(x) for x in v]
    assert [tuple(pick(scalars.upscale_aspect(*lit(800, 600, *r)))) for r in ((4, 3), (16, 9), (1, 1))] == [(800, 600), (1067, 600), (800, 800)]
    assert tuple(pick(scalars.rescale_box(*lit(800, 600, 960, 600)))) == (800, 600, 0, 0, 80, 80)
    assert tuple(pick(scalars.rescale_box(*lit(800, 600, 800, 800)))) == (800, 600, 100, 100, 0, 0)
    null = F.lit(None).cast("long")
    assert tuple(pick(scalars.rescale_box(*lit(800, 600), null, F.lit(900)))) == (1200, 900, 0, 0, 0, 0)
    w = pick(scalars.wald_interval(*lit(520, 1000)))
    assert (w.share, round(w.low, 7), round(w.high, 7)) == (0.52, 0.4890176, 0.5508293)
    for bad in (scalars.wald_interval(*lit(0, 0)), scalars.wald_interval(*lit(10, 5)), scalars.upscale_aspect(*lit(0, 600, 4, 3))):
        with pytest.raises(Exception, match="must be"):
            pick(bad)
    p = spark.createDataFrame([(0, i, x) for i, x in enumerate((0.005, 0.009, 0.05, 0.1, 0.2, 0.3))], "g int, i int, p double")
    q = [round(r.q, 6) for r in statistics.benjamini_hochberg(p, "p", "i", ["g"]).orderBy("i").collect()]
    assert q == [0.027, 0.027, 0.1, 0.15, 0.24, 0.3]


def test_votes_scenes_pairs(spark):
    ballots = spark.createDataFrame([(1, 0, 0.4, 5), (1, 1, 0.4, None), (1, 2, 0.0, 9), (2, 0, 0.4, None), (2, 1, 0.2, 3)], "screen int, member int, weight double, page int")
    assert {r.screen: r.page for r in ensemble.vote(ballots).collect()} == {1: 5, 2: None}
    assert {r.screen: r.page for r in ensemble.vote(ballots, 0.5).collect()} == {1: None, 2: None}
    rows = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate((0, 90, 120, 100, 12))], "video int, frame_no int, value double")
    assert [r.frame_no for r in scenes.scene_filter(rows, 0.15).orderBy("frame_no").collect()] == [0, 2, 4]
    assert 4 in [r.frame_no for r in scenes.scene_filter(rows, 0.15, wrap=True).collect()]
    pages = spark.createDataFrame([("d1", 1), ("d1", 2), ("d2", 3)], "document string, page int")
    matches = spark.createDataFrame([(0, "d1", 1, "full")], "screen int, document string, page int, similarity string")
    found = {r.page: (r.label, r.weight) for r in pairs.training_pairs(spark.createDataFrame([(0,)], "screen int"), pages, matches).collect()}
    assert found == {1: (0, 8 / 5), 2: (1, 5 / 5), 3: (1, 2 / 5)}
    flat = pairs.moments(spark.createDataFrame([([1.0, 2.0],), ([3.0, 2.0],)], "vec array<double>")).orderBy("pos").collect()
    assert [(r.mean, r.inverse_std) for r in flat] == [(2.0, 1.0), (2.0, 0.0)]


def test_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(1)
    make = lambda n, m: spark.createDataFrame([(i + n, v.tolist()) for i, v in enumerate(rng.normal(size=(m, 6)))], "id long, vec array<double>")
    pages, queries = make(0, 40).cache(), make(100, 25).cache()
    p, q = (np.array([r.vec for r in x.orderBy("id").collect()]) for x in (pages, queries))
    whole = neighbours.nearest(queries, pages, "euclidean", 3).orderBy("id", "rank").collect()
    d = np.linalg.norm(q[:, None] - p[None], axis=2)
    assert [r.page for r in whole] == np.argsort(d, 1)[:, :3].reshape(-1).tolist()
    monkeypatch.setattr(neighbours, "BLOCK", 7)
    assert neighbours.nearest(queries, pages, "euclidean", 3).orderBy("id", "rank").select("page").collect() == [(r.page,) for r in whole]
    best = neighbours.best_or_none(queries, pages, "euclidean", float(np.median(d.min(1))))
    assert best.where("page is null").count() == 13
    near = {r.id: r.page for r in neighbours.nearest_lsh(queries, pages, width=8.0).collect()}
    assert np.mean([near.get(100 + i) == x for i, x in enumerate(d.argmin(1))]) >= 0.9


def test_evaluation(spark):
    log = events.validity(log_of(spark, SCRIPT))
    notes = spark.createDataFrame([(7, 1, "pristine", [1]), (7, 2, "pristine", [1]), (7, 3, "obstacle", [1]), (7, 5, "pristine", [])], "video long, frame_no long, condition string, closest array<long>")
    assert {r.frame_no: r.success for r in evaluation.evaluate_events(log, notes).collect()} == {1: True, 2: False, 3: True, 5: True}
    strict = spark.createDataFrame([(7, 1, 1), (7, 2, 1), (7, 5, None)], "video long, frame_no long, page long")
    assert {r.frame_no: r.success for r in evaluation.evaluate_strictly(log, strict).collect()} == {1: True, 2: False, 5: True}


def test_images():
    image = np.random.default_rng(2).integers(0, 256, (20, 30, 4)).astype(np.uint8)
    corners = np.array([(0, 0), (29, 0), (0, 19), (29, 19)], float)
    w = images.warp(image, images.homography(corners, corners), 30, 20)
    assert (w == image).all()
    tall = images.render(np.full((10, 10, 4), 255, np.uint8), 30, 10)
    assert tall[:, :10].max() == 0 and tall[:, 10:20].min() == 255
    assert images.mean_squared_error(np.array([10], np.uint8), np.array([12], np.uint8), wrap=True) > 0.9
    flat = np.arange(64.0).reshape(8, 8)
    assert images.perceptual_hash(flat, 4).shape == (16,) and images.wavelet_hash(flat, 4).sum() == 8


def box(a, b, c, d):
    return [(a, b), (c, b), (c, d), (a, d)]


LEFT, RIGHT, JOINED, BRIDGE = box(50, 50, 350, 300), box(360, 50, 700, 300), box(50, 50, 700, 300), box(350, 180, 360, 200)
EROSION, SPLIT = postprocess.Options(base=False, erosion=True), postprocess.Options(split=True)


@pytest.mark.parametrize(
    ("shapes", "options", "screens"),
    [
        ([], postprocess.Options(), 0), ([LEFT], postprocess.Options(), 1), ([LEFT, RIGHT], postprocess.Options(), 2), ([LEFT, RIGHT, BRIDGE], postprocess.Options(), 1), ([LEFT], EROSION, 1), ([LEFT, RIGHT], EROSION, 2),
        ([LEFT, RIGHT, BRIDGE], EROSION, 2), ([JOINED], postprocess.Options(base=False, split=True), 0), ([JOINED], SPLIT, 2), ([[(50, 50), (300, 50), (150, 150), (50, 400)]], postprocess.Options(), 0), ([[(50, 50), (500, 50), (50, 500), (500, 500)]], postprocess.Options(), 0),
    ],
)
def test_masks(shapes, options, screens):
    mask = np.zeros((576, 720), bool)
    for s in shapes:
        mask |= images.fill_polygon(s, 576, 720)
    assert len(postprocess.detect(mask, options)) == screens


def test_sources(spark, tmp_path):
    data = spark.createDataFrame([("m", bytearray(range(256))), ("n", bytearray())], "name string, data binary")
    parts = chunks.split(data, "name", "data", 100)
    assert parts.count() == 4
    assert {r.name: bytes(r.data) for r in chunks.join(parts, "name").collect()} == {"m": bytes(range(256)), "n": b""}
    (tmp_path / "d").mkdir()
    for n in ("b.png", "a.png"):
        (tmp_path / "d" / n).write_bytes(n.encode())
    assert [(r.page_no, bytes(r.content)) for r in media.image_directory(spark, f"{tmp_path}/d").orderBy("page_no").collect()] == [(1, b"a.png"), (2, b"b.png")]
    pages = media.documents(spark, f"{tmp_path}/d", lambda data: [(1, None, None, 1, 1, data)], "*.png")
    assert pages.count() == 2
    with pytest.raises(Exception, match="nothing that can be read"):
        media.documents(spark, f"{tmp_path}/d", lambda data: [], "*.png").collect()


def test_annotation_xml(spark, tmp_path):
    side = " ".join(f'{k}{i}="{i}.5"' for i in range(4) for k in "xy")
    (tmp_path / "v.xml").write_text(
        f"""<videos><video uri="u" dirname="d" datetime="2016-10-26T00:00:00Z" frames="9" fps="15" width="720" height="576"><documents><document filename="s.pdf"><page key="k1" number="1" filename="1.png" vgg256="[[0.5],[1]]"/></document></documents>
        <frames><frame filename="f.png" number="4" vgg256="[[1],[2]]"><screens><screen {side} aspect-width="4" aspect-height="3" condition="pristine" vgg256="[[1],[2]]"><keyrefs><keyref similarity="full">k1</keyref></keyrefs></screen></screens></frame></frames></video></videos>"""
    )
    t = xml_io.read_annotations(spark, f"{tmp_path}/v.xml")
    assert t["videos"].first().fps == 15 and t["pages"].first().vgg256 == [[0.5], [1.0]] and t["frames"].first().number == 4
    assert t["screens"].first().quad.br.x == 3.5 and tuple(t["keyrefs"].first()) == ("u", 4, 0, "k1", "full")
    (tmp_path / "r.xml").write_text(
        f"""<i><institution id="example"><rooms><room id="123"><cameras><camera id="xm2" name="c" width="720" height="576"/></cameras>
        <screens><screen id="s" name="n" aspect-width="4" aspect-height="3"><positions camera="xm2"><position {side} datetime="2018-01-01T00:00:00"/></positions></screen></screens></room></rooms></institution></i>"""
    )
    t = xml_io.read_positions(spark, f"{tmp_path}/r.xml")
    assert t["cameras"].first().camera == "xm2" and t["screens"].first().installed_from is None and t["positions"].first().quad.tl.x == 0.5


def test_batch_tracker_equals_windows(spark):
    rng = np.random.default_rng(3)
    rows = [(1, int(n), 0, {c: {"x": float(x + a), "y": float(y + b)} for c, (a, b) in zip(G.CORNERS, ((0, 0), (9, 1), (0, 7), (9, 7)), strict=True)}) for n, x, y in zip(range(60), rng.integers(0, 14, 60), rng.integers(0, 9, 60), strict=True) if n % 9]
    screens = spark.createDataFrame(rows, f"video long, frame_no long, ix long, quad {G.QUAD}")
    one = {r.frame_no: r.track for r in tracking.track_single(screens).collect()}
    many = {r.frame_no: r.track for r in tracking.track_many(screens).where("state <> 'disappeared'").collect()}
    assert one == many


def test_registries_views_and_configuration(spark, tmp_path):
    from tidemark import configuration
    from tidemark.operators import detectors
    from tidemark.plans import views
    from tidemark.streaming.progress import Progress

    assert views.register(spark, "/root/testdata/sf0.001", ["histogram"]) == ["histogram"] and spark.table("histogram").count() > 0
    assert round(detectors.sigmoid_distance(2.0, -1.0, 0.5), 9) == 0.5
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "id long, image array<double>")
    assert [r.vec for r in detectors.extracted(rows, lambda: lambda x: x * 2, size=2).orderBy("id").collect()][4] == [8.0, 2.0]
    (tmp_path / "c.ini").write_text("[a]\nscene_threshold = 0.3\nhash_threshold = 9\n")
    c = configuration.load(f"{tmp_path}/c.ini", hash_threshold=5)
    assert (c.scene_threshold, c.hash_threshold, c.quorum) == (0.3, 5, 0.0)
    told = []
    Progress(10.0, told.append).onQueryTerminated(None)
    assert told == ["0 frames"]


def test_jaccard_join_measures_chunks(spark, monkeypatch):
    monkeypatch.setattr(spatial, "CHUNK", 3)
    monkeypatch.setattr(spatial, "PAIRS", 5)
    rng = np.random.default_rng(4)
    corners = [[(x, y), (x + w, y + s), (x, y + h), (x + w, y + h)] for x, y, w, h, s in rng.integers([-20, -20, 0, 1, -2], [40, 40, 30, 20, 5], (40, 5)).tolist()]
    rows = spark.createDataFrame([(f"v{n % 2}", n, [float(v) for p in q for v in p]) for n, q in enumerate(corners)], "video string, id int, v array<double>")
    rows = rows.select("video", "id", G.quad(*[(F.col("v")[2 * i], F.col("v")[2 * i + 1]) for i in range(4)]).alias("quad"))
    found = spatial.jaccard_join(rows, rows, ["video"], 16.0)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()  # no expression is interpreted for each pair
    a, b = rows.toDF("video", "id", "qa"), rows.toDF("video", "other", "qb")
    want = a.join(b, "video").select("video", "id", "other", G.overlap("qa", "qb").alias("inter"), G.jaccard("qa", "qb").alias("jaccard")).where("inter > 0")
    key = lambda r: (r.video, r.id, r.other)
    assert sorted(found.collect(), key=key) == sorted(want.collect(), key=key)


def test_lsh_finds_the_nearest_in_shared_buckets_without_copies(spark, monkeypatch):
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(300, 6)).round(1)
    vectors[250:] = vectors[200:250]  # the first id of equal ones counts
    make = lambda n, v: spark.createDataFrame([(n + i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>")
    queries = np.concatenate([rng.normal(size=(60, 6)), vectors[200:230], [[40.0] * 6]])
    axes = np.random.default_rng(1).normal(size=(6, 10))
    axes /= np.linalg.norm(axes, axis=0)
    monkeypatch.setattr(neighbours, "BLOCK", 90)
    for width in (4.0, 0.02):  # all vectors are near, hardly any is
        a, b = (np.floor(x @ axes / width) for x in (queries, vectors))
        want = {}
        for i, q in enumerate(queries):
            near = [(np.sqrt(((v - q) ** 2).sum()), 1000 + j) for j, v in enumerate(vectors) if (a[i] == b[j]).any()]
            if near:
                want[i] = min(near)
        df = neighbours.nearest_lsh(make(0, queries), make(1000, vectors), width)
        assert "Generate" not in df._jdf.queryExecution().executedPlan().toString()  # no row is sent once for each table
        found = {r.id: (r.distance, r.page) for r in df.collect()}
        assert found.keys() == want.keys()
        assert all(found[k][1] == want[k][1] and abs(found[k][0] - want[k][0]) < 1e-9 for k in want)
