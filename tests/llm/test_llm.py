"""The operators for training text against brute force, exact round trips and held-out accuracy, and their edge cases."""

import hashlib
import itertools
import pathlib
import random
import re
import struct
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import jpeg, language, mixing, nearjoin, packing, private, queries, separators, shingles, sketch, tokens, toolcalls, urls
from tidemark.llm.shared import Scratch

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names operators use themselves."""
    rng = random.Random(5)
    long_ = " ".join(rng.choice(["of", "the", "and", "it"]) + str(rng.randrange(50)) for _ in range(30_000))
    rows = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, None, None, None, None), (None, "x y z w v", "en", "s", 9), (3, "", "de", "t", 0), (4, " \n\t ", "de", None, 4),
            (5, long_, "en", "s", len(long_)), (6, "A B\tC D  E\nF", "en", "t", 11), (7, "é" * 30_000, "fr", "t", 30_000), (7, "other text of one id", "en", "u", 20), (8, "12 34", None, "u", 5)]
    extra = [F.lit(1).alias(n) for n in ("size", "score", "spans", "node", "hashes", "label", "number", "rep", "copies", "row_key")]
    return spark.createDataFrame(rows, SCHEMA).select("*", *extra).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_encoder_equals_the_tokenizer():
    code = tokens.encoder(tokens.vocabulary_path())
    rng = random.Random(1)
    parts = ["a", "b ", "\n", " ", "\t", "'s", "é", "12", ".", "\r", " the", "　", "\x1c", "<|endoftext|>"]
    for text in ["a\n \nb", " a", "a  b", "", " "] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(3000)]:
        assert code.encode(text) == code.whole(text)


def brute_fill(counts, room):
    sums = {0}
    for length, n in counts.items():
        sums = {s + k * length for s in sums for k in range(n + 1) if s + k * length <= room}
    return sums


def test_fills_are_the_closest():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randint(1, 40): rng.randint(1, 4) for _ in range(5)}
        room = rng.randint(0, 90)
        fill = packing.best_fill(counts, room, lambda s, r=room: r - s)
        assert all(n <= counts[k] for k, n in fill.items())
        assert sum(k * n for k, n in fill.items()) == max(brute_fill(counts, room))


def check_packing(rows, texts, window):
    code = tokens.encoder(tokens.vocabulary_path())
    want = Counter((d, code.encode(t) + struct.pack("<I", 1)) for d, t in texts)
    made = Counter()
    whole = Counter()
    for (d, ids), n in want.items():
        total = len(ids) // 4
        for s in range(0, total, window):
            made[d, s, min(window, total - s), zlib.crc32(ids[4 * s : 4 * (s + window)]), total] += n
    for r in rows:
        whole[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
    assert made == whole
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= window
    return sum(packing.padding(sum(x for _, x in v), window) for v in places.values()) / max(1, sum(r.length for r in rows))


def test_packing(docs, odd, empty):
    assert check_packing(packing.pack(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()], 2048) < 0.03
    check_packing(packing.pack(odd, window=64).collect(), [(r.doc_id, r.text) for r in odd.collect()], 64)
    assert packing.pack(empty).count() == 0


def test_forward_sums_over_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "bab"]
    model = language.LanguageModel(["x", "y"], pieces, np.random.default_rng(1).dirichlet(np.ones(9), 2).T)

    def brute(word, lang):
        if not word:
            return 1.0
        out = 0.0
        for k in range(1, len(word) + 1):
            p = word[:k]
            row = pieces.index(p) if p in pieces else 8 if k == 1 else None
            out += 0 if row is None else model.probabilities[row, lang] * brute(word[k:], lang)
        return out

    words = ["a", "ab", "abab", "babab", "cab", "q"]
    want = [[np.log(brute("▁" + w, k)) for k in (0, 1)] for w in words]
    assert np.allclose(model.word_scores(words), want)
    counts = Counter(words)
    made = model.expected(counts, 0)
    sizes = np.array([*map(len, pieces), 1])
    assert np.isclose((made * sizes).sum(), sum(len(w) + 1 for w in words))


def test_language_on_held_out_documents(docs, odd, empty):
    rows = language.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95 and all(0 <= r.score <= 1 for r in rows)
    for r in language.predict(docs).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    found = language.predict(odd).collect()
    assert len(found) == odd.count()
    assert {r.doc_id: r.lang_pred for r in found}[8] == "und" and {r.doc_id: r.lang_pred for r in found}[2] == "und"
    assert language.predict(empty).count() == 0


def test_urls_by_rules_and_trees(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "url")
    more = [(-1, None), (-2, "no scheme"), (-3, "http://Example.COM/en/x?y"), (-4, "http://www.example.com/en/"), (-5, "http://com"), (-6, "http://a.net/es/#"), (-7, "x://notexample.com/en/a"), (-8, "http://é.org/" + "x" * 50_000)]
    rows = urls.judge(pages.union(spark.createDataFrame(more, "page_id long, url string"))).collect()

    def rule(host, path):
        fit = [r for r in urls.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        return max(fit, key=lambda r: len(r[0] + r[1]), default=None)

    given = {r.page_id: r.url for r in pages.collect()} | dict(more)
    for r in rows:
        url = given[r.page_id] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        best = rule(low, path)
        assert (r.host, r.path, r.rule) == (low, path, best and best[0] + best[1])
        assert r.verdict in ("allow", "block") and (best is None or r.verdict == best[2])
    agree = [(r.block_odds >= 0) == (r.verdict == "block") for r in rows if r.rule and r.page_id >= 0]
    assert np.mean(agree) > 0.8
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_urls_run_no_python(spark):
    plan = urls.judge(spark.read.parquet(f"{FOLDER}/pages.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_targets():
    found = mixing.targets({"a": 100, "b": 100, None: 1000, "c": 10})
    assert list(found) and found["c"] == 20 and found["a"] == 200 and found["b"] == 200 and round(found[None], 6) == 1395
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0}


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(3)
    hits = np.zeros(40)
    p, z = rng.random(40), rng.integers(1, 500, 40).astype(float)
    for seed in range(300):
        q = mixing.flight(p, z, np.random.default_rng(seed))
        assert abs(q.sum() - p.sum()) < 1e-6 and abs((q * z).sum() - (p * z).sum()) < 1e-3
        assert ((q > 0) & (q < 1)).sum() <= 2
        hits += q
    assert np.abs(hits / 300 - p).max() < 0.12


def test_mix(docs, odd, empty):
    rows = mixing.mix(docs).collect()
    words = {r.doc_id: (r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs.collect()}
    by = {}
    for r in rows:
        assert r.size == words[r.doc_id][1] and 0 <= r.taken <= 2 * r.size
        by.setdefault((words[r.doc_id][0], r.target), []).append(r.taken)
    total = sum(n for _, n in words.values())
    assert abs(sum(t for _, t in by) - 1.5 * total) < 1e-6 * total
    assert sum(abs(sum(v) - t) for (_, t), v in by.items()) < 0.03 * 1.5 * total
    again = mixing.mix(docs.repartition(7)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(empty).count() == 0
    assert mixing.repeated(odd).count() == mixing.mix(odd).agg(F.sum("copies")).first()[0] and mixing.repeated(odd).columns == odd.columns


def brute_groups(texts, k, num, den):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)})
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                root[max(top(i), top(j))] = min(top(i), top(j))
    return sets, [top(i) for i in range(len(sets))]


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 4, 5)])
def test_near_groups(spark, monkeypatch, k, num, den):
    rng = random.Random(k)
    texts = []
    for _ in range(25):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                if copy:
                    copy[rng.randrange(len(copy))] = f"v{rng.randrange(40)}"
            texts.append(" ".join(copy))
    monkeypatch.setattr(nearjoin, "TILE", 4)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets, root = brute_groups(texts, k, num, den)
    for r in nearjoin.near_groups(df, k, num, den).collect():
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), root[r.doc_id])


def test_near_groups_of_odd_rows(odd, empty):
    rows = nearjoin.near_groups(odd, 3, 90, 100).collect()
    assert len(rows) == odd.count()
    assert {r.component_id for r in rows if r.doc_id in (1, 6)} == {1}
    assert nearjoin.near_groups(empty).count() == 0
    kept = nearjoin.one_of_each(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 1").count() == 1 and kept.where("doc_id = 6").count() == 0 and kept.where("doc_id in (2, 3, 4)").count() == 3


def test_null_ids_join_components(spark):
    words = [f"w{i}" for i in range(40)]
    change = lambda at: " ".join(w if i not in at else "z" for i, w in enumerate(words))
    ends, bridge = [change({0, 1}), change({38, 39})], change(())
    alone = [" ".join(f"v{i}" for i in range(n)) for n in (40, 39)]
    rows = [(7, ends[0]), (9, ends[1]), (None, bridge), (None, bridge), *((None, t) for t in alone)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets, root = brute_groups([t for _, t in rows], 3, 90, 100)
    assert root == [0, 0, 0, 0, 4, 4] and brute_groups(ends, 3, 90, 100)[1] == [0, 1]
    found = Counter((r.doc_id, r.n_shingles, r.component_id) for r in nearjoin.near_groups(df, 3, 90, 100).collect())
    assert found == Counter([(7, 38, 7), (9, 38, 7), (None, 38, 7), (None, 38, 7), (None, 38, None), (None, 37, None)])
    assert Counter(r.doc_id for r in nearjoin.one_of_each(df, 3, 90, 100).collect()) == {7: 1, None: 1}


def test_one_of_each_goes_by_text(spark):
    base = [f"w{i}" for i in range(60)]
    near, far = " ".join([*base[:-1], "z"]), " ".join(f"f{i}" for i in range(30))
    base, other = " ".join(base), " ".join(f"o{i}" for i in range(30))
    nulls = [" ".join(f"{c}{i}" for i in range(20)) for c in "pqr"]
    rows = [(1, base), (2, near), (2, far), (3, other), (3, nulls[0] + " x"), (3, ""), (None, ""), (None, nulls[1]), (None, nulls[2]), (None, nulls[2]), (None, nulls[2].upper()), (None, far), (4, None)]
    kept = nearjoin.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    left = Counter((r.doc_id, r.text and r.text.lower()) for r in kept.collect())
    assert left == Counter([(1, base), (2, far), (3, other), (3, nulls[0] + " x"), (3, ""), (None, ""), (None, nulls[1]), (None, nulls[2]), (4, None)])


def test_search_and_parts_lose_nothing():
    rng = random.Random(9)
    texts = []
    for _ in range(60):
        base = [f"w{rng.randrange(80)}" for _ in range(rng.choice([rng.randint(1, 80), 300, 900]))]
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randint(0, 3 + len(copy) // 50)):
                copy[rng.randrange(len(copy))] = "z"
            texts.append(" ".join(copy))
    for k, num, den in ((3, 90, 100), (5, 4, 5), (2, 1, 2)):
        sets, classes = shingles.shingle_sets(pa.array(texts), k), shingles.Classes(num, den)
        search, marks = shingles.Search(sets, num, den), [set(classes.numbers(x).tolist()) for x in sets]
        for i, a in enumerate(sets):
            want = {j for j, b in enumerate(sets) if den * len(np.intersect1d(a, b)) >= num * len(np.union1d(a, b))}
            assert set(search.similar(a).tolist()) == want
            for j in want:
                common = marks[i] & marks[j]
                kinds = Counter(x & (1 << 14) - 1 for x in common)
                assert np.array_equal(a, sets[j]) or any(n >= kind & 15 for kind, n in kinds.items())


def colour_jpeg(width, height, seed):
    """A progressive file with 4:2:0 chroma, written coefficient by coefficient, and its coefficients."""
    rng = np.random.default_rng(seed)
    mh, mw = -(-height // 16), -(-width // 16)
    shapes = [(2 * mh, 2 * mw), (mh, mw), (mh, mw)]
    blocks = [np.where(rng.random((*s, 64)) < 0.2, rng.integers(-30, 31, (*s, 64)), 0) for s in shapes]
    bits = []

    def put(value, n):
        bits.extend((value >> i) & 1 for i in range(n - 1, -1, -1))

    def signed(v):
        n = int(abs(v)).bit_length()
        return n, v if v > 0 else v + (1 << n) - 1

    def flush():
        while len(bits) % 8:
            bits.append(1)
        data = np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")
        bits.clear()
        return data

    seg = lambda m, b: struct.pack(">BBH", 0xFF, m, len(b) + 2) + b
    table = bytes([0] * 7 + [255] + [0] * 8) + bytes(range(255))  # every symbol but 255 in eight bits
    out = [b"\xff\xd8", seg(0xDB, b"\0" + b"\2" * 64), seg(0xC2, struct.pack(">BHHB", 8, height, width, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])), seg(0xC4, b"\0" + table), seg(0xC4, b"\x10" + table)]
    out.append(seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, 1])))
    past, order = [0, 0, 0], []
    for y in range(mh):
        for x in range(mw):
            order += [(0, 2 * y + a, 2 * x + b) for a in (0, 1) for b in (0, 1)] + [(1, y, x), (2, y, x)]
    for c, y, x in order:
        dc = int(blocks[c][y, x, 0]) >> 1
        n, v = signed(dc - past[c]) if dc != past[c] else (0, 0)
        put(n, 8), put(v, n)
        past[c] = dc
    out += [flush(), seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, 0x10]))]
    for c, y, x in order:
        put(int(blocks[c][y, x, 0]) & 1, 1)
    out.append(flush())
    own = [(-(-height // 8), -(-width // 8))] + [(-(-height // 16), -(-width // 16))] * 2
    for c in range(3):
        rows = [blocks[c][y, x] for y in range(own[c][0]) for x in range(own[c][1])]
        out.append(seg(0xDA, bytes([1, c + 1, 0, 1, 63, 1])))
        for b in rows:  # without the lowest bit
            run = 0
            for k in range(1, 64):
                v = int(np.sign(b[k])) * (abs(int(b[k])) >> 1)
                if not v:
                    run += 1
                    continue
                while run > 15:
                    put(0xF0, 8)
                    run -= 16
                n, e = signed(v)
                put(run << 4 | n, 8), put(e, n)
                run = 0
            if run:
                put(0, 8)
        out += [flush(), seg(0xDA, bytes([1, c + 1, 0, 1, 63, 0x10]))]
        for b in rows:
            run, wait = 0, []
            last = max([k for k in range(1, 64) if abs(int(b[k])) == 1], default=0)
            for k in range(1, 64):
                size = abs(int(b[k]))
                if size > 1:
                    wait.append(size & 1)
                elif size == 1:
                    put(run << 4 | 1, 8), put(int(b[k] > 0), 1)
                    for w in wait:
                        put(w, 1)
                    run, wait = 0, []
                elif k < last:
                    if run == 15:
                        put(0xF0, 8)
                        for w in wait:
                            put(w, 1)
                        run, wait = 0, []
                    else:
                        run += 1
            if last < 63:
                put(0, 8)
                for w in wait:
                    put(w, 1)
        out.append(flush())
    return b"".join([*out, b"\xff\xd9"]), blocks, own


@pytest.mark.parametrize(("w", "h"), [(16, 16), (37, 21), (64, 48)])
def test_progressive_colour(w, h):
    data, blocks, own = colour_jpeg(w, h, w)
    image = jpeg.Image(data)
    for c, (y, x) in enumerate(own):
        want = blocks[c][:y, :x].copy()
        want[..., 1:] = np.sign(want[..., 1:]) * np.abs(want[..., 1:])
        assert (image.components[c]["blocks"][:y, :x] == want).all()
    rgb = image.rgb()
    assert rgb.shape == (h, w, 3) and rgb.dtype == np.uint8
    flat = np.zeros((8, 8))
    u = image.components[1]["blocks"][0, 0]
    plain = np.zeros(64)
    plain[jpeg.ZIGZAG] = u * 2
    for a in range(8):
        for b in range(8):
            for i in range(8):
                for j in range(8):
                    flat[a, b] += (0.125**0.5 if i == 0 else 0.5) * (0.125**0.5 if j == 0 else 0.5) * plain[8 * i + j] * np.cos((2 * a + 1) * i * np.pi / 16) * np.cos((2 * b + 1) * j * np.pi / 16)
    assert np.abs(np.clip(np.rint(flat + 128), 0, 255) - image.planes()[1][:8, :8]).max() <= 1


def test_media_round_trip(odd, docs, empty, monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(jpeg, "COLUMN", 5)
    for n in (1, 2, 5, 6, 17, 40):
        payload = rng.integers(0, 256, 64 * n).astype(np.uint8).tobytes()
        assert jpeg.payload_of(jpeg.Image(jpeg.store(payload))) == payload
    for source in (odd, docs):
        texts = Counter((r.doc_id, jpeg.padded((r.text or "").encode())) for r in source.collect())
        rows = Counter((r.doc_id, r.payload_sha256, r.tail_crc32, r.payload_bytes) for r in jpeg.media_digest(source).collect())
        assert rows == Counter({(d, hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(p)): n for (d, p), n in texts.items()})
    first = jpeg.decode_media(jpeg.encode_media(docs.limit(1)), tensors=True).first()
    assert len(first.rgb) == first.height * first.width * 3
    assert jpeg.media_digest(empty).count() == 0


def likeness(a, b):
    cut = lambda t: (lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})(t.lower().split())
    a, b = cut(a), cut(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(docs, odd, empty, monkeypatch):
    monkeypatch.setattr(sketch, "BUCKET", 1)
    x = sorted((r.doc_id, r.text or "") for r in docs.collect())
    rows = {r.doc_id: r for r in sketch.fingerprints(docs).collect()}
    off = []
    for k, (d, t) in enumerate(x):
        n = x[(k + 1) % len(x)][1]
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert (rows[d].n_chars, rows[d].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        off += [abs(rows[d].near_edited - likeness(t, edited)), abs(rows[d].near_next - likeness(t, n))]
    assert max(off) < 0.2 and np.mean(off) < 0.03
    found = sketch.fingerprints(odd).collect()
    assert len(found) == odd.count() and len({r.fingerprint for r in found if r.doc_id == 1}) == 1
    assert sketch.fingerprints(empty).count() == 0
    one = sketch.fingerprints(docs.limit(1)).first()
    assert one.near_next == 1.0
    assert not re.search("Python|Pandas|Arrow", sketch.fingerprints(docs)._jdf.queryExecution().toString())


def test_sketches_merge(spark):
    parts = spark.createDataFrame([("k", " ".join(f"w{i}" for i in range(a, b))) for a, b in ((0, 400), (300, 900))], "k string, text string")
    rows = sketch.with_sketch(parts, "text", "s").cache()
    whole = sketch.merged(rows, ["k"], "s").first().s
    a, b = (r.s for r in rows.collect())
    assert whole == sorted({*a, *b})[: sketch.K]
    pair = spark.createDataFrame([(a, b)], "a array<long>, b array<long>").select(sketch.distinct_count(F.col("a")).alias("n"), sketch.containment(F.col("a"), F.col("b")).alias("c")).first()
    assert abs(pair.n - 396) < 120 and abs(pair.c - 96 / 396) < 0.15


KINDS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def brute_spans(text):
    out = []
    for kind, pattern in KINDS:
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19, "phone": 8 <= len(d) <= 15}[kind]
            if kind == "card" and ok:
                ok = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if ok:
                out.append((kind, *m.span()))
    return out


def test_patterns(docs):
    rng = random.Random(6)
    parts = ["a", "@", ".", "b.c", "+", "1", "255", "256", " ", "-", "4111 1111 1111 1111", "4111111111111111", "(2)", "_", "é", "\n", "x@y.z", "+1 555-1234", "1.2.3.4", "0.0"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(6000)] + [r.text or "" for r in docs.collect()]
    for t in texts:
        assert private.base_spans(t) == brute_spans(t), t
    for long_ in ("a" * 200_000, "1" * 200_000, "a@" * 50_000, "+1 " * 60_000, "1." * 60_000):
        private.base_spans(long_)


def test_private_digest(docs, odd, empty):
    for source in (docs, odd):
        texts = Counter((r.doc_id, private.spans_sha256(brute_spans(r.text or ""))) for r in source.collect())
        rows = private.digest(source).collect()
        assert Counter((r.doc_id, r.base_sha256) for r in rows) == texts
    for r in private.digest(docs).collect():
        assert len([s for s in r.spans.split(",") if s]) >= r.n_email + r.n_ip + r.n_card + r.n_phone
    assert private.digest(empty).count() == 0
    weights = private.learned(docs)
    clean = private.redact(docs, weights)
    assert not any(brute_spans(r.text or "") for r in clean.collect()) and clean.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in clean.collect())


def test_repeated_names_draw_their_label(docs):
    weights = private.learned(docs)
    text = "write to someone.12@mail3.example.com now\n" + "of the and " * 30 + "ask someone.12 again, or call 5557713 or 9876543, not +1 (017) 555-7713"
    added = lambda w: [(k, text[a:b]) for k, a, b, base in private.find_spans([text], w)[0] if not base]
    assert added(weights) == [("email", "someone.12"), ("phone", "5557713")]
    assert added(private.Field(weights.token, weights.chain, 0.0)) == []
    assert private.find_spans(["plain words only", None, ""], weights) == [[], [], []]


def exact_marginals(field, graph, evidence):
    k = len(private.LABELS) + 1
    own = np.array(graph.features) @ field.token
    total = np.zeros((len(own), k))
    for labels in itertools.product(range(k), repeat=len(own)):
        if any(e and e != y for e, y in zip(evidence, labels, strict=True)):
            continue
        score = sum((own[i, y] if not evidence[i] else 0.0) for i, y in enumerate(labels))
        score += sum(field.skip * (labels[i] == labels[j]) if skip else field.chain[labels[i], labels[j]] for i, j, skip in graph.edges)
        for i, y in enumerate(labels):
            total[i, y] += np.exp(score)
    return total / total.sum(1, keepdims=True)


def test_messages_equal_enumeration():
    rng = np.random.default_rng(3)
    k = len(private.LABELS) + 1
    tree = [(0, 1, 0), (1, 2, 1), (1, 3, 0), (3, 4, 1)]
    for edges, near in ((tree, 1e-4), ([*tree, (0, 4, 1)], 0.05), ([], 1e-9)):
        for _ in range(3):
            field = private.Field(rng.normal(0, 0.7, (private.WIDTH, k)), rng.normal(0, 0.5, (k, k)), 0.8)
            graph = private.Graph(features=rng.integers(0, 2, (5, private.WIDTH)).astype(float).tolist(), edges=edges)
            evidence = np.array([0, 0, 2, 0, 0])
            assert np.abs(field.posteriors(graph, evidence) - exact_marginals(field, graph, evidence)).max() < near


def test_secrets_and_long_texts(docs):
    weights = private.learned(docs.sparkSession.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    text = 'a token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" there, 1234567890123456 not'
    assert [(k, text[a:b]) for k, a, b, _ in private.find_spans([text], weights)[0]] == [("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962")]
    took = []
    for n in (4_000, 16_000):
        long_ = "".join(f"name{i}x@a.bc word " for i in range(n))
        began = time.perf_counter()
        assert len(private.find_spans([long_], weights)[0]) == n
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0]
    row = private.digest(docs.sparkSession.createDataFrame([(1, text), (None, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert row[0].n_private is not None and {r.spans for r in row} == {""}


def test_token_counts(docs, odd, empty):
    code = tokens.encoder(tokens.vocabulary_path())
    for source in (docs.repartition(3), odd):
        want = Counter((r.doc_id, len(code.encode(r.text)) // 4) for r in source.collect())
        assert Counter((r.doc_id, r.tokens) for r in separators.token_counts(source).collect()) == want
    assert separators.token_counts(empty).count() == 0


def test_blocks_are_stitched(spark):
    rng = np.random.default_rng(8)
    for size in (1, 3, 10, 1000):
        stream = np.where(rng.random(300) < 0.1, 9, 1).astype("<u2")
        stream[-1] = 9
        rows = [(0, i, bytearray(stream[k : k + size].tobytes())) for i, k in enumerate(range(0, len(stream), size))]
        found = separators.stitched(separators.scan_blocks(spark.createDataFrame(rows, "file long, block long, ids binary"), 9)).orderBy("document").collect()
        ends = np.flatnonzero(stream == 9)
        starts = np.concatenate([[0], ends[:-1] + 1])
        assert [(r.document, r.start, r.tokens) for r in found] == [(i, int(s), int(e - s)) for i, (s, e) in enumerate(zip(starts, ends, strict=True))]


def test_tool_calls(spark):
    calls = [("a", "ask", '{"turn": 1, "text": "x"}', None), ("b", "ask", '{"text": 5, "turn": 1}', "a"), ("c", "ask", "not json", "b"), ("d", "other", "{}", "missing"), ("e", "ask", '{"text": "y", "turn": 2, "more": 1}', "f"), ("f", "ask", None, "e"), (None, "ask", "{}", None)]
    results = [("a", "r1"), ("a", "r0"), ("zzz", "lost"), (None, "x")]
    rows = {r.id: r for r in toolcalls.link(spark.createDataFrame(calls, "id string, tool string, arguments string, after string"), spark.createDataFrame(results, "id string, content string")).collect()}
    assert {k: r.level for k, r in rows.items()} == {"a": 0, "b": 1, "c": 2, "d": 0, "e": None, "f": None}
    assert {k for k, r in rows.items() if r.valid} == {"a"} and {k for k, r in rows.items() if r.linked} == {"a"} and rows["a"].results == 2
    assert rows["a"].json == '{"arguments":{"text":"x","turn":1},"id":"a","level":0,"result":"r0","tool":"ask"}'
    chain = spark.createDataFrame([(str(i), str(i - 1)) for i in range(100)], "id string, after string")
    assert {r.id: r.level for r in toolcalls.levels(chain).collect()} == {str(i): i for i in range(100)}
    odd = spark.createDataFrame([(1, 0, "user", None), (1, 0, "user", "b"), (None, 1, "user", "x"), (2, None, "assistant", "x"), (1, 1, "assistant", "y")], "conv_id long, turn long, role string, text string")
    assert toolcalls.formatted(odd).count() == 1 and toolcalls.formatted(odd.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    df = queries.QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    found = con.execute(f"select {', '.join(names)} from ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted(found, key=repr)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows, before = docs, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, before, FOLDER).cache()
        assert rows.columns == docs.columns, name
        if name == "near copies":
            texts = sorted((r.doc_id, r.text) for r in before.collect())
            _, root = brute_groups([t for _, t in texts], 5, 4, 5)
            assert sorted(r.doc_id for r in rows.collect()) == sorted({texts[i][0] for i in root})
        if name == "personal data":
            assert rows.count() == before.count() and not any(brute_spans(r.text) for r in rows.collect())
        before = rows
    check_packing(corpus_pipeline.STAGES[-1][1](spark, rows, FOLDER).collect(), [(r.doc_id, r.text) for r in rows.collect()], 2048)


def test_long_words_and_unseen_letters():
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "bab"]
    model = language.LanguageModel(["x", "y"], pieces, np.random.default_rng(1).dirichlet(np.ones(9), 2).T)
    words = ["ab" * n for n in (3, 12, 13, 40)] + ["q" * 30]
    p = np.vstack([model.probabilities, np.zeros(2)])
    for w in words:
        sums = [np.ones(2)]
        text, scale = "▁" + w, np.zeros(2)
        for end in range(1, len(text) + 1):
            total = sum(sums[k] * p[pieces.index(text[k:end]) if text[k:end] in pieces else 8 if end - k == 1 else 9] for k in range(max(0, end - 4), end))
            sums.append(total)
        assert np.allclose(model.word_scores([w])[0], np.log(sums[-1]) + scale)
    long_ = model.word_scores(["ab" * 20_000, "q" * 20_000])
    assert np.isfinite(long_).all() and abs(long_[0] / 20_000 - (model.word_scores(["ab" * 200]) - model.word_scores(["ab" * 100]))[0] / 100).max() < 1e-3
    learned = language.fit([("en", "the cat and the hat " * 30), ("de", "der hund und das haus " * 10)], language.public_pieces())
    names, scores = language.Scorer(learned).score(["the cat", "und das haus", "ж" * 60, "12"])
    assert names[:2] == ["en", "de"] and names[3] == "und" and min(scores[:2]) > 0.8 and abs(scores[2] - 0.5) < 0.1 and scores[3] == 0


def test_trees_on_other_hosts(spark):
    rows = urls.labelled(urls.features(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"))).withColumn("kept", F.pmod(F.xxhash64("host", F.lit(99)), F.lit(4)) == 0)
    found = urls.scored(rows.where("kept"), *urls.fit(rows.where("not kept"))).select("y", (F.col("block_odds") >= 0).alias("block")).collect()
    base = np.mean([r.y for r in found])
    assert len(found) > 100 and np.mean([r.block == (r.y == 1) for r in found]) > max(base, 1 - base) + 0.1


def test_trees_judge_both_ways_and_ignore_other_columns(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url", F.lit(1).alias("fold"), F.lit("x").alias("host"), F.lit(2).alias("y"))
    rows = urls.judge(pages.unionByName(pages)).collect()
    assert len(rows) == 2 * pages.count() and {r.verdict for r in rows if r.rule is None} == {"allow", "block"}
    told = lambda found: Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in found)
    assert told(rows) == Counter({k: 2 * n for k, n in told(urls.judge(pages).collect()).items()})


def test_first_split_is_the_best():
    rng = random.Random(7)
    for _ in range(20):
        cells = [(float(rng.random() < 0.4), rng.randint(1, 5), tuple(rng.randrange(urls.BINS) for _ in urls.FEATURES)) for _ in range(60)]

        def gain(f, place, cells=cells):
            side = lambda own: (sum((0.5 - y) * n for y, n, _ in own), sum(0.25 * n for _, n, _ in own))
            (a, c), (b, d) = side([x for x in cells if x[2][f] <= place]), side([x for x in cells if x[2][f] > place])
            return a**2 / (c + urls.RIDGE) + b**2 / (d + urls.RIDGE)

        f, place, *_ = urls._grow(cells, [0.0] * len(cells), 1)
        assert gain(f, place) > max(gain(g, k) for g in range(len(urls.FEATURES)) for k in range(urls.BINS)) - 1e-6


def test_payload_in_several_files(spark, monkeypatch):
    monkeypatch.setattr(jpeg, "PART", 64 * 7)
    payload = np.random.default_rng(1).integers(0, 256, 64 * 30).astype(np.uint8).tobytes()
    files = list(jpeg.images(jpeg.store(payload)))
    assert len(files) == 5 and b"".join(map(jpeg.payload_of, files)) == payload
    rgb = files[0].rgb()
    chroma = files[0].planes()[1]
    assert rgb.shape == (32, 16, 3) and chroma.shape == (16, 8) and len(files[0].components) == 3
    lengths = {n for table in files[0].tables.values() for n, _ in table}
    assert len({n for n, _ in jpeg.Codes(*jpeg.DIFFERENCES)}) > 4 and lengths


def test_buckets_are_even_however_ids_lie(spark, monkeypatch):
    monkeypatch.setattr(sketch, "BUCKET", 20)
    monkeypatch.setattr(sketch, "FAN", 8)
    ids = [*range(2_000), *(10**12 + i for i in range(500)), *(k * 10**15 for k in range(1, 61)), *[77] * 900, *[None] * 400]
    docs = spark.createDataFrame([(d, f"text {i}") for i, d in enumerate(ids)], "doc_id long, text string")
    sizes = [r["count"] for r in sketch.bucketed(docs).groupBy("bucket").count().collect()]
    assert max(sizes) <= 4 * sum(sizes) / len(sizes) and len(sizes) > len(ids) / 60
    rows = sketch.with_next(docs.where("doc_id is not null and doc_id <> 77")).collect()
    text = {r.doc_id: r.text for r in rows}
    order = sorted(text)
    assert all(r.next_text == text[order[(order.index(r.doc_id) + 1) % len(order)]] for r in rows)


def test_files_of_many_groups(spark, monkeypatch):
    monkeypatch.setattr(separators, "GROUP", 1)
    rng = np.random.default_rng(2)
    rows, want = [], set()
    for file in (3, 4):
        stream = np.where(rng.random(400) < 0.05, 9, 1).astype("<u2")
        rows += [(file, i, bytearray(stream[k : k + 7].tobytes())) for i, k in enumerate(range(0, len(stream), 7))]
        ends = np.flatnonzero(stream == 9)
        want |= {(file, i, int(s), int(e - s)) for i, (s, e) in enumerate(zip(np.concatenate([[0], ends[:-1] + 1]), ends, strict=True))}
    found = separators.stitched(separators.scan_blocks(spark.createDataFrame(rows, "file long, block long, ids binary"), 9)).collect()
    assert {(r.file, r.document, r.start, r.tokens) for r in found} == want


def test_special_words_in_texts(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokens.vocabulary_path())
    texts = ["a<|endoftext|>b", "one <|endoftext|> two", "plain text"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in packing.pack(df).collect():
        ids = [*own.encode(texts[r.doc_id], add_special_tokens=False).ids, 1]
        assert (r.doc_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert separators.token_counts(df).count() == 3


def test_components_and_bit_maps(spark):
    rng = random.Random(4)
    edges = [(f"{a:03}".encode(), f"{b:03}".encode()) for a, b in ([(i, i + 1) for i in range(60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(90)])]
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    found = nearjoin.components(spark.createDataFrame([tuple(map(bytearray, e)) for e in edges if e[0] != e[1]], "a binary, b binary"), Scratch(spark)).collect()
    assert len(found) == len({r.node for r in found}) and {bytes(r.node): bytes(r.label) for r in found} == {x: top(x) for e in edges if e[0] != e[1] for x in e}
    keys = spark.range(5_000).select(F.xxhash64("id").alias("k"))
    bits = nearjoin.BitMap(keys)
    inside = np.array([r.k for r in keys.collect()])
    assert bits.among(inside).all() and bits.among(inside + (1 << 20)).mean() < 0.2


def test_many_texts_under_one_id_and_clashing_columns(spark):
    base = [f"w{i}" for i in range(50)]
    texts = [" ".join([*base[:k], "z", *base[k + 1 :]]) if k % 3 == 0 else " ".join(f"t{k}x{i}" for i in range(30)) for k in range(30)]
    names = ("key", "row", "wins", "worded", "node", "label", "_hash", "n", "least")
    df = spark.createDataFrame([(5, t) for t in texts], "doc_id long, text string").select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    _, root = brute_groups(texts, 5, 4, 5)
    kept = nearjoin.one_of_each(df)
    assert kept.columns == df.columns and kept.count() == len(set(root))
    assert {root[texts.index(r.text)] for r in kept.collect()} == set(root)


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_pipeline_on_odd_tables(spark, which, request):
    import corpus_pipeline

    rows = request.getfixturevalue(which).select(*corpus_pipeline.COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        before = rows
        rows = stage(spark, before, FOLDER).cache()
        assert rows.columns == (before.columns if name != "pack" else rows.columns)
        assert (rows.count() == 0) == (which == "empty" or before.count() == 0), name


def test_near_gives_up_common_numbers(spark):
    kind = 2  # of class 0, of which similar sets share three
    number = lambda n: n << nearjoin.KIND_BITS | kind
    rows = [(number(n), node) for node in range(40) for n in (1, 2, 100 + node // 2, 200 + node // 2)] + [(number(300 + node), node) for node in range(40)]
    scratch = Scratch(spark)
    kept = nearjoin.shared_numbers(scratch.cut(spark.createDataFrame(rows, "number long, node long")), scratch)
    assert {(r.number, r.node) for r in kept.collect()} == {(number(n + node // 2), node) for node in range(40) for n in (100, 200)}


def test_cut_leaves_no_shuffle_files(spark):
    folder = pathlib.Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath())
    there = lambda: {p.name for p in folder.rglob("shuffle_*.data")}
    before = there()
    df = spark.range(1000).repartition(7).groupBy(F.col("id") % 10).count()
    assert len(Scratch(spark).cut(df).collect()) == 10
    for _ in range(50):
        if not there() - before:
            break
        time.sleep(0.1)
    assert not there() - before
