import math

import numpy as np
import pytest

from contigua.llm import itq, media


def clustered(seed=0, dims=24):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((40, dims))
    rows = [(i, (centres[i % 40] + 0.12 * rng.standard_normal(dims)).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[5][1]) for i in range(30)] + [(2000, [2 * x for x in rows[5][1]])]
    bad = [None, [], [0.0] * dims, [float("nan")] * dims, [float("inf")] + [1.0] * (dims - 1), [None] + [1.0] * (dims - 1), [1.0] * (dims + 1)]
    return rows + [(3000 + i, v) for i, v in enumerate(bad)]


def brute_force(rows, dims=24):
    good = [(i, np.array(v)) for i, v in rows if v is not None and len(v) == dims and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)]
    x = np.array([v / np.linalg.norm(v) for _, v in good])
    linked = x @ x.T >= 0.9
    ids = [i for i, _ in good]
    least = list(ids)
    for _ in ids:
        new = [min(l for l, s in zip(least, row, strict=True) if s) for row in linked]
        if new == least:
            break
        least = new
    out = {i: (int(row.sum()) - 1, l) for i, row, l in zip(ids, linked, least, strict=True)}
    return {i: out.get(i, (0, i)) for i, _ in rows}


@pytest.mark.parametrize("hot", [False, True])
def test_near_duplicate_vectors(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(itq, "HOT_ROWS", 4)
        monkeypatch.setattr(itq, "BLOCK", 2)
    rows, want = clustered(), brute_force(clustered())
    got = itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == len(rows)
    total = sum(n for n, _ in want.values())
    found = sum(r.n_links for r in got)
    assert 0.95 * total <= found <= total
    assert all(r.n_links <= want[r.vec_id][0] for r in got)
    assert sum(r.component_id == want[r.vec_id][1] for r in got) >= 0.98 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


@pytest.mark.parametrize(("dims", "n"), [(1, 4000), (2, 4000), (3, 4000), (8, 4000), (24, 10**6), (64, 4000), (64, 10**6), (64, 10**9), (128, 4000)])
def test_recall_at_the_threshold(dims, n):
    """Pairs at cosine 0.9 exactly, the hardest there are, of vectors that weren't fitted on; n is that of a large table."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((8000, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes = itq.Codes.fit(x[:4000], n)
    x = x[4000:]
    across = rng.standard_normal(x.shape)
    across -= (across * x).sum(axis=1, keepdims=True) * x
    across /= np.maximum(np.linalg.norm(across, axis=1, keepdims=True), 1e-9)
    y = x if dims == 1 else 0.9 * x + math.sqrt(1 - 0.81) * across
    a, b = codes.encode(x), codes.encode(y)
    met = (codes.first_key(a, codes.mask(x), b, codes.mask(y)) >= 0) & (np.bitwise_count(a ^ b) <= codes.far)
    assert met.mean() >= 0.9
    assert codes.width >= math.log2(n) - itq.CROWD


def test_first_key_is_a_common_one_of_the_first_table():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 16))
    codes = itq.Codes.fit(x)
    code, mask = codes.encode(x), codes.mask(x)
    keys, own = codes.keys(code, mask)
    filed = [set() for _ in x]
    for k, o in zip(keys.tolist(), own.tolist(), strict=True):
        filed[o].add(k)
    i, j = np.triu_indices(300, 1)
    first = codes.first_key(code[i], mask[i], code[j], mask[j])
    for a, b, f in zip(i.tolist(), j.tolist(), first.tolist(), strict=True):
        common = filed[a] & filed[b]
        table = itq.LONGEST_PART
        assert (f in common and f >> table == min(common) >> table) if common else f == -1


def test_vectors_edges(spark):
    assert itq.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    rows = [(None, [1.0, 0.0]), (None, [1.0, 0.0]), (7, [0.0, 1.0]), (7, [0.0, 1.0]), (8, None)]
    got = itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as key", "2 as n", "3 as cid")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 1, None, True)] * 2 + [(7, 1, 7, True)] * 2 + [(8, 0, 8, True)], key=str)


def test_image_codec():
    x = media.draw(1)
    assert np.array_equal(media.decode(media.encode(x)), np.rint(x))
    assert media.decode(b"P5\n# note\n2 1\n255\n\x01\x02").tolist() == [[1, 2]]
    assert media.decode(b"P6 1 1 255\n\x0a\x0a\x0a").round(6).tolist() == [[10]]
    assert all(media.decode(x) is None for x in (None, b"", b"GIF89a", b"P5 2 2 255\n\x01", b"P5 a b 255\n", b"P5 2", b"P5 2 2 65535\n" + b"0" * 8))


def test_places_survive_packing():
    where = np.array([[1.25, 700.5, 1.0, media.STEP**2], [0.0, 3.0, -2.5, 1.0]])
    for (x, y, turn, scale), want in zip(media._unpacked(media._packed(where)).tolist(), where.tolist(), strict=True):
        assert (x, y) == tuple(want[:2]) and math.isclose(scale, want[3]) and abs(math.remainder(turn - want[2], 2 * math.pi)) < 0.001


def test_nearest_corners_equal_brute_force():
    rng = np.random.default_rng(2)
    xs, ys = rng.integers(0, 90, 200), rng.integers(0, 90, 200)
    near = media._nearest(xs, ys)
    d = (xs[:, None] - xs[None]) ** 2 + (ys[:, None] - ys[None]) ** 2 + np.where(np.eye(200, dtype=bool), 10**6, 0)
    for i in range(200):
        want = [x for x in sorted(d[i].tolist())[: media.NEIGHBOURS] if x <= media.SIGHT**2]
        assert [d[i, j] for j in near[i] if j >= 0] == want


def agreeing(queries, images):
    """Pairs whose corners agree on a similarity, compared all with all, without tables."""
    at = [(i, media.describe(media.decode(b))) for i, b in images]
    return {(q, i) for q, a in queries for x in [media.describe(media.decode(a))] for i, y in at if media.agreement(*x[:2], *y[:2])[0] >= media.MIN_VOTES}


KIND = "media_id long, image binary"


def test_copies_equal_brute_force(spark):
    images = [(i, media.encode(media.draw(i))) for i in range(24)]
    queries = [(100 + i, media.encode(media.edited(media.draw(i), i // 2 % 4))) for i in range(0, 24, 2)] + [(300, media.encode(media.draw(77)))]
    got = media.copies(spark.createDataFrame(queries, KIND), spark.createDataFrame(images, KIND)).collect()
    assert {(r.query_id, r.media_id) for r in got} == agreeing(queries, images) == {(100 + i, i) for i in range(0, 24, 2)}
    for r in got:
        turned = (r.query_id - 100) // 2 % 4 == 1
        assert abs(r.scale - 1) < 0.02 and abs(math.remainder(r.turn - 90 * turned, 360)) < 1
        assert turned or (abs(r.dx - 8) < 1 and abs(r.dy - 6) < 1)


EDITS = {"resized by 0.75": (80, 0.75, 0), "by 0.9": (80, 0.9, 0), "by 1.25": (80, 1.25, 0), "by 0.67": (160, 0.67, 0), "turned by 10": (80, 1, 10), "by 22.5": (80, 1, 22.5), "by 45": (80, 1, 45), "by 80": (80, 1, 80), "both": (160, 0.8, 33)}


def test_recall_of_resized_and_turned_copies(spark):
    """All of these in one search: at least nine of ten copies of each kind are found, with their turn and scale, and no others."""
    small = [media.draw(i) for i in range(24)]
    large = [np.block([[media.draw(1000 + 4 * i + 2 * r + c) for c in range(2)] for r in range(2)]) for i in range(24)]
    images = [(i, media.encode(g)) for i, g in enumerate(small)] + [(100 + i, media.encode(g)) for i, g in enumerate(large)]
    asked, want = [], {}
    for k, (name, (side, scale, turn)) in enumerate(EDITS.items()):
        for i in range(24):
            grey = small[i] if side == 80 else large[i]
            asked.append((1000 * k + i, media.encode(media.warped(grey, scale, turn))))
            want[1000 * k + i] = (name, i + 100 * (side > 80), scale, turn)
    got = media.copies(spark.createDataFrame(asked, KIND), spark.createDataFrame(images, KIND)).collect()
    found = {n: 0 for n in EDITS}
    for r in got:
        name, image, scale, turn = want[r.query_id]
        assert r.media_id == image and abs(r.scale * scale - 1) < 0.05 and abs(math.remainder(r.turn + turn, 360)) < 4
        found[name] += 1
    assert all(n >= 0.9 * 24 for n in found.values()), found


def test_same_bytes_without_corners(spark):
    flat, tiny = media.encode(np.full((40, 40), 9.0)), media.encode(np.full((2, 2), 1.0))
    images = spark.createDataFrame([(3, flat), (2, flat), (5, tiny), (6, None)], KIND)
    got = media.copies(spark.createDataFrame([(1, flat), (2, tiny), (3, None), (4, b"x")], KIND), images).collect()
    assert sorted((r.query_id, r.media_id, r.n_copies, r.votes) for r in got) == [(1, 2, 2, 0), (2, 5, 1, 0)]


def png(grey, filters, colour=0):
    """A PNG file whose lines have the filters in turn."""
    import struct
    import zlib

    samples = {0: 1, 2: 3}[colour]
    lines = np.repeat(grey.astype(int)[:, :, None], samples, axis=2).reshape(len(grey), -1)
    out, above = b"", np.zeros(lines.shape[1], int)
    for y, line in enumerate(lines):
        kind = filters[y % len(filters)]
        left = np.concatenate((np.zeros(samples, int), line[:-samples]))
        corner = np.concatenate((np.zeros(samples, int), above[:-samples]))
        a, b, c = np.abs(above - corner), np.abs(left - corner), np.abs(left + above - 2 * corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))
        guess = [0 * line, left, above, (left + above) // 2, paeth][kind]
        out += bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes()
        above = line
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    head = struct.pack(">IIBBBBB", grey.shape[1], grey.shape[0], 8, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("colour", [0, 2])
def test_png(colour):
    grey = np.rint(media.draw(2))
    raw = png(grey, [0, 1, 2, 3, 4], colour)
    assert np.allclose(media.decode(raw), grey)
    assert media.decode(raw[:60]) is None and media.decode(raw[:40]) is None and media.decode(raw[:8]) is None


def test_media_edges(spark):
    one = media.encode(media.draw(3))
    images = [(None, one), (5, one), (4, one), (6, None), (7, b""), (8, b"junk"), (9, media.encode(np.full((40, 40), 9.0)))]
    kind = "media_id long, image binary"
    table = spark.createDataFrame(images, kind).selectExpr("*", "1 as key", "2 as votes")
    got = media.copies(spark.createDataFrame([(1, one), (1, one), (2, None), (None, b"")], kind), table).collect()
    assert [(r.query_id, r.media_id, r.n_copies) for r in got] == [(1, 4, 3)] * 2
    empty = spark.createDataFrame([], kind)
    assert media.copies(empty, table).count() == 0 and media.copies(table, empty).count() == 0
    assert media.edits(media.rendered(spark.createDataFrame([(1, [0.5]), (2, None), (None, [])], "vec_id long, embedding array<float>"))).count() == 3


def test_small_crops_of_large_images(spark):
    """A crop of a fiftieth of the area; the parts of an image are pictures of their own."""
    large = [np.block([[media.draw(1000 * i + 10 * r + c) for c in range(7)] for r in range(7)]) for i in range(3)]
    crops = [(100 * i + 10 * k, large[i][y : y + 80, x : x + 80]) for i in range(3) for k, (y, x) in enumerate([(40, 60), (200, 330), (410, 150), (470, 475)])]
    kind = "media_id long, image binary"
    images = spark.createDataFrame([(i, media.encode(g)) for i, g in enumerate(large)], kind)
    got = media.copies(spark.createDataFrame([(i, media.encode(g)) for i, g in crops], kind), images).collect()
    assert {(r.query_id, r.media_id) for r in got} == {(i, i // 100) for i, _ in crops}


def test_corners_grow_with_the_area():
    one, many = (len(media.describe(np.tile(media.draw(5), (n, n)))[0]) for n in (1, 6))
    assert many > 36 * one


@pytest.mark.parametrize("hot", [1, 1000])
def test_every_member_of_a_class_is_told(spark, monkeypatch, hot):
    monkeypatch.setattr(media, "HOT_ROWS", hot)
    a, b = media.encode(media.draw(3)), media.encode(media.draw(4))
    images = [(i, a) for i in range(10, 40)] + [(50, b), (None, b), (7, None), (8, b""), (9, b"junk"), (None, b"other")]
    kind = "media_id long, image binary"
    table = spark.createDataFrame(images, kind)
    want = [(i, 10, 30) for i in range(10, 40)] + [(50, 50, 2), (None, 50, 2), (7, 7, 2), (8, 7, 2), (9, 9, 1), (None, None, 1)]
    assert sorted(map(tuple, media.members(table).collect()), key=str) == sorted(want, key=str)
    both = media.copies_and_members(spark.createDataFrame([(1, media.encode(media.edited(media.draw(3), 0)))], kind), table).collect()
    assert sorted([(r.media_id, r.class_id, r.n_copies) for r in both if r.kind == "member"], key=str) == sorted(want, key=str)
    assert [(r.query_id, r.media_id, r.class_id, r.n_copies) for r in both if r.kind == "copy"] == [(1, 10, 10, 30)]


def test_vectors_of_every_length(spark):
    rows = clustered() + [(5000 + i, v) for i, v in clustered(1, 16)[:60]] + [(6000, [1.0]), (6001, [3.0]), (6002, [-1.0]), (6003, [1.0] * 5)]
    rows += [(7000 + i, [1.0, 2.0, 3.0]) for i in range(3)]
    want = {}
    for d in {len(v) for _, v in rows if v}:
        part = [(i, v) for i, v in rows if v is not None and len(v) == d]
        want |= brute_force(part, d)
    got = {r.vec_id: r for r in itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert len(got) == len(rows)
    assert [tuple(got[i])[1:] for i in (6000, 6001, 6002, 6003)] == [(1, 6000, True), (1, 6000, False), (0, 6002, True), (0, 6003, True)]
    assert [tuple(got[7000 + i])[1:] for i in range(3)] == [(2, 7000, i == 0) for i in range(3)]
    ours = [i for i in want if 5000 <= i < 6000]
    assert sum(want[i][0] for i in ours) > 0 and sum(got[i].n_links for i in ours) >= 0.95 * sum(want[i][0] for i in ours)
    assert all(got[i].n_links <= want[i][0] for i in ours)
