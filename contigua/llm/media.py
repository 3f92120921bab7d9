"""Operator 8: local image descriptors that detect cropped or edited copies in a column of images.

Corners are found on a pyramid of scales; each gets an orientation from its intensity centroid and 256 brightness
tests on a pattern turned to it. Hamming tables, one for each 48 bits, are joined on equal keys; a query is also looked
up with its least certain bits of a key flipped. One such agreement may be chance, so a row carries the corner's nearest
neighbours too (place in the corner's own frame, and bits of their tests), and two corners meet if a neighbour of
either agrees as well: what the join makes follows the copies, not queries times images. Images that meet are compared
corner by corner, and the corners that agree on one similarity (turn, scale, shift) are counted.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: A step of the pyramid, which goes on while an image holds patches.
STEP = 2 ** (1 / 3)
#: Tests lie within this radius; a corner is the strongest within NEAREST pixels.
RADIUS, CENTROID, NEAREST = 9, 7, 3
#: Least corner response; what flat or faintly grained areas have is below it.
LEAST_RESPONSE = 1e5
#: Corners described at once, and sent from a task in one batch: bounds on memory, not on an image's corners.
PART = 2048
TURNS = 64
#: The tests are four words of 64 bits; a table's key is 48 bits of one word, of which the PROBES least certain are flipped.
WORDS, KEY_BITS, PROBES = 4, 48, 3
#: Neighbours of a corner that its rows carry, within SIGHT pixels, and how far apart two may be: angle and turn (64ths),
#: distance (quarters of a doubling), bits of 15.
NEIGHBOURS, SIGHT, ANGLE_APART, TURN_APART, AWAY_APART, BITS_APART = 4, 18, 2, 2, 1, 3
#: When images are compared: bits in which two corners may differ, pixels (at the corner's scale) off their place, votes.
MAX_BITS, OFF, MIN_VOTES = 56, 2.5, 6
HYPOTHESES = 2000

_rng = np.random.default_rng(5)
_polar = np.sqrt(_rng.uniform(0, 1, (64 * WORDS, 2))) * RADIUS * np.exp(2j * np.pi * _rng.uniform(0, 1, (64 * WORDS, 2)))
_TURNED = np.stack([_polar * np.exp(2j * np.pi * k / TURNS) for k in range(TURNS)])
_TURNED = np.rint(np.stack((_TURNED.real, _TURNED.imag), axis=-1)).astype(np.int64)
_GRID = np.arange(-CENTROID, CENTROID + 1)
_DISK = (_GRID[:, None] ** 2 + _GRID[None] ** 2 <= CENTROID**2).astype(np.float64)
#: A turned test reaches this far.
REACH = int(np.abs(_TURNED).max())


def _png(raw: bytes) -> np.ndarray | None:
    """Grey values of a PNG image of 8 bits a sample, not interlaced; None for any other."""
    at, packed, palette, head = 8, [], None, None
    while at + 8 <= len(raw):
        size, kind = int.from_bytes(raw[at : at + 4], "big"), raw[at + 4 : at + 8]
        body = raw[at + 8 : at + 8 + size]
        if kind == b"IHDR" and len(body) == 13:
            head = (int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big"), body[8], body[9], body[12])
        elif kind == b"PLTE" and size % 3 == 0:
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    samples = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(head[3]) if head else None
    if samples is None or head[2] != 8 or head[4] or not head[0] * head[1] or (head[3] == 3 and palette is None):
        return None
    width, height, row = head[0], head[1], head[0] * samples
    try:
        data = zlib.decompressobj().decompress(b"".join(packed), (row + 1) * height)
    except zlib.error:
        return None
    if len(data) < (row + 1) * height:
        return None
    lines = np.frombuffer(data, np.uint8).reshape(height, row + 1)
    out, above = np.zeros((height, row), np.uint8), np.zeros(row, np.uint8)
    for y in range(height):
        kind, line = int(lines[y, 0]), lines[y, 1:].copy()
        if kind == 2:
            line += above
        elif kind == 1:
            line = np.cumsum(line.reshape(width, samples), axis=0, dtype=np.uint8).ravel()
        elif kind in (3, 4):
            left, corner = np.zeros(samples, int), np.zeros(samples, int)
            for x in range(0, row, samples):
                up = above[x : x + samples].astype(int)
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    a, b, c = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                left, corner = (line[x : x + samples] + guess) % 256, up
                line[x : x + samples] = left
        elif kind:
            return None
        out[y] = above = line
    x = out.reshape(height, width, samples)
    x = palette[np.minimum(x[..., 0], len(palette) - 1)] if head[3] == 3 else x
    return x[..., :3] @ np.array([0.299, 0.587, 0.114]) if x.shape[2] >= 3 else x[..., 0].astype(np.float64)


def decode(raw: bytes | None) -> np.ndarray | None:
    """Grey values of a PNG or a binary PGM or PPM image of 8 bits; None for anything else."""
    if raw and raw[:8] == b"\x89PNG\r\n\x1a\n":
        return _png(raw)
    if not raw or raw[:2] not in (b"P5", b"P6"):
        return None
    fields, at = [], 2
    while len(fields) < 3 and at < len(raw):
        if raw[at : at + 1] == b"#":
            at = (raw.find(b"\n", at) + 1) or len(raw)
        elif raw[at : at + 1].isspace():
            at += 1
        else:
            end = at
            while end < len(raw) and not raw[end : end + 1].isspace():
                end += 1
            fields.append(raw[at:end])
            at = end
    if len(fields) < 3 or not all(f.isdigit() for f in fields) or fields[2] != b"255":
        return None
    width, height, depth = int(fields[0]), int(fields[1]), 1 if raw[:2] == b"P5" else 3
    body = raw[at + 1 :]
    if len(body) < width * height * depth or not width * height:
        return None
    x = np.frombuffer(body, np.uint8, width * height * depth).reshape(height, width, depth)
    return x[:, :, 0].astype(np.float64) if depth == 1 else x @ np.array([0.299, 0.587, 0.114])


def encode(grey: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (grey.shape[1], grey.shape[0]) + np.clip(np.rint(grey), 0, 255).astype(np.uint8).tobytes()


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Mean over a square of 2 r + 1, edges repeated."""
    n = 2 * r + 1
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (r + 1, r)
        c = np.cumsum(np.pad(x, pad, mode="edge"), axis=axis)
        x = (c[n:] - c[:-n]) / n if axis == 0 else (c[:, n:] - c[:, :-n]) / n
    return x


def _smaller(x: np.ndarray, factor: float) -> np.ndarray:
    """Bilinear samples of a smoothed image."""
    h, w = int(x.shape[0] / factor), int(x.shape[1] / factor)
    x = _box(x, 1)
    ys, xs = np.minimum(np.arange(h) * factor, x.shape[0] - 1.001), np.minimum(np.arange(w) * factor, x.shape[1] - 1.001)
    y0, x0 = ys.astype(int), xs.astype(int)
    fy, fx = (ys - y0)[:, None], (xs - x0)[None]
    return (x[y0][:, x0] * (1 - fx) + x[y0][:, x0 + 1] * fx) * (1 - fy) + (x[y0 + 1][:, x0] * (1 - fx) + x[y0 + 1][:, x0 + 1] * fx) * fy


def _corners(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the local maxima of the corner response, however many: a crop then has the corners of its area."""
    gy, gx = np.zeros_like(x), np.zeros_like(x)
    gy[1:-1], gx[:, 1:-1] = x[2:] - x[:-2], x[:, 2:] - x[:, :-2]
    a, b, c = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
    response = a * b - c * c - 0.05 * (a + b) ** 2
    most = response.copy()
    for axis in (0, 1):
        grown = most.copy()
        for s in range(1, NEAREST + 1):
            near, far = [slice(None)] * 2, [slice(None)] * 2
            near[axis], far[axis] = slice(None, -s), slice(s, None)
            grown[tuple(near)] = np.maximum(grown[tuple(near)], most[tuple(far)])
            grown[tuple(far)] = np.maximum(grown[tuple(far)], most[tuple(near)])
        most = grown
    peak = (response == most) & (response > LEAST_RESPONSE)
    peak[:REACH], peak[-REACH:], peak[:, :REACH], peak[:, -REACH:] = False, False, False, False
    return np.nonzero(peak)


def _nearest(xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """(n, NEIGHBOURS): for each corner its nearest others within SIGHT, of those in the cells around; -1 for none."""
    n = len(xs)
    out = np.full((n, NEIGHBOURS), -1)
    cell = (ys // SIGHT).astype(np.int64) * (1 << 32) + xs // SIGHT
    order = np.argsort(cell, kind="stable")
    ordered = cell[order]
    far = np.full((n, NEIGHBOURS), np.inf)
    for dy in (-1, 0, 1):
        lo = np.searchsorted(ordered, cell + dy * (1 << 32) - 1, side="left")
        hi = np.searchsorted(ordered, cell + dy * (1 << 32) + 1, side="right")
        for k in range(int((hi - lo).max(initial=0))):
            has = np.flatnonzero(lo + k < hi)
            j = order[lo[has] + k]
            has, j = has[j != has], j[j != has]
            d = (xs[has] - xs[j]) ** 2.0 + (ys[has] - ys[j]) ** 2.0
            has, j, d = has[d <= SIGHT**2], j[d <= SIGHT**2], d[d <= SIGHT**2]
            for rank in range(NEIGHBOURS):
                closer = d < far[has, rank]
                i = has[closer]
                was_d, was_j = far[i, rank].copy(), out[i, rank].copy()
                far[i, rank], out[i, rank] = d[closer], j[closer]
                # What was there moves on; the rest goes to the next rank as it is.
                d, j = d.copy(), j.copy()
                d[closer], j[closer] = was_d, was_j
    return out


def describe(grey: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(where, tests, unsure, beside) of the corners.

    where (n, 4): x, y in the image's own pixels, turn in radians, scale. tests (n, WORDS) and unsure: the bits, and for
    each word those PROBES of its key bits whose brightnesses differ least. beside (n, NEIGHBOURS / 2): packed neighbours, 0
    for none.
    """
    parts = [(np.zeros((0, 4)), np.zeros((0, WORDS), np.uint64), np.zeros((0, WORDS), np.uint64), np.zeros((0, NEIGHBOURS // 2), np.int64))]
    factor, x = 1.0, grey
    while grey is not None and min(x.shape) > 2 * REACH + 2:
        rows, columns = _corners(x)
        soft = _box(x, 1)
        where, tests, unsure = [np.zeros((0, 4))], [np.zeros((0, WORDS), np.uint64)], [np.zeros((0, WORDS), np.uint64)]
        for at in range(0, len(rows), PART):
            ys, xs = rows[at : at + PART], columns[at : at + PART]
            patch = soft[ys[:, None, None] + _GRID[:, None], xs[:, None, None] + _GRID[None]] * _DISK
            turn = np.arctan2((patch * _GRID[:, None]).sum(axis=(1, 2)), (patch * _GRID[None]).sum(axis=(1, 2)))
            pattern = _TURNED[np.rint(turn / (2 * np.pi) * TURNS).astype(int) % TURNS]
            values = soft[ys[:, None, None] + pattern[..., 1], xs[:, None, None] + pattern[..., 0]]
            bits = np.packbits(values[..., 0] < values[..., 1], axis=1, bitorder="little").view("<u8").astype(np.uint64)
            close = np.abs(values[..., 0] - values[..., 1]).reshape(len(ys), WORDS, 64)[:, :, :KEY_BITS]
            least = np.argpartition(close, PROBES, axis=2)[:, :, :PROBES].astype(np.uint64)
            tests.append(bits)
            unsure.append(np.bitwise_or.reduce(np.uint64(1) << least, axis=2))
            where.append(np.column_stack((xs * factor, ys * factor, turn, np.full(len(xs), factor))))
        where, tests, unsure = (np.concatenate(v) for v in (where, tests, unsure))
        parts.append((where, tests, unsure, _beside(columns, rows, where[:, 2], tests)))
        factor *= STEP
        x = _smaller(grey, factor)
    return tuple(np.concatenate([p[k] for p in parts]) for k in range(4))


def _beside(xs: np.ndarray, ys: np.ndarray, turn: np.ndarray, tests: np.ndarray) -> np.ndarray:
    """The nearest neighbours of each corner, two to a long: 6 bits of angle, 6 of turn in its own frame, 4 of log distance, 15 of tests."""
    near = _nearest(xs, ys)
    found = np.zeros(near.shape, np.int64)
    wheel = lambda a: np.rint(a * (64 / (2 * np.pi))).astype(np.int64) & 63
    for k in range(NEIGHBOURS):
        i = np.flatnonzero(near[:, k] >= 0)
        j = near[i, k]
        dx, dy = xs[j] - xs[i], ys[j] - ys[i]
        away = np.clip(np.rint(4 * np.log2(np.hypot(dx, dy))) - 3, 1, 15).astype(np.int64)
        seen = (tests[j, WORDS - 1] >> np.uint64(KEY_BITS)).astype(np.int64) & 0x7FFF
        found[i, k] = ((wheel(np.arctan2(dy, dx) - turn[i]) << 6 | wheel(turn[j] - turn[i])) << 4 | away) << 15 | seen
    return found[:, ::2] << 32 | found[:, 1::2]


def described(media: DataFrame, *, id_col: str = "media_id", image_col: str = "image", probed: bool = False) -> DataFrame:
    """(media_id, digest, decoded, corners): corners hold the packed place, tests and neighbours; probed, the unsure bits too.

    Undecodable images, and those too small or flat, have no corner.
    """
    names = ["at", *[f"t{k}" for k in range(WORDS)], *[f"n{k}" for k in range(NEIGHBOURS // 2)], *[f"u{k}" for k in range(WORDS if probed else 0)]]

    def sent(ids, digest, decoded, rows):
        counts = np.concatenate(([0], np.cumsum([len(r[0]) for r in rows])))
        where, tests, unsure, beside = (np.concatenate([r[k] for r in rows]) for k in range(4))
        columns = [_packed(where), *tests.view(np.int64).T, *beside.T, *(unsure.view(np.int64).T if probed else ())]
        corners = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names)
        listed = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), corners)
        return pa.RecordBatch.from_pydict({"media_id": ids, "digest": pa.array(digest, pa.binary()), "decoded": pa.array(decoded), "corners": listed})

    def run(batches):
        for batch in batches:
            digest, decoded, rows, begin, held = [], [], [], 0, 0
            for i, raw in enumerate(batch.column(1)):
                raw = raw.as_py()
                grey = decode(raw)
                digest.append(hashlib.md5(raw or b"").digest())
                decoded.append(grey is not None)
                rows.append(describe(grey))
                held += len(rows[-1][0])
                if held >= 32 * PART or i + 1 == batch.num_rows:
                    yield sent(batch.column(0).slice(begin, len(digest)), digest, decoded, rows)
                    digest, decoded, rows, begin, held = [], [], [], i + 1, 0

    kind = f"media_id long, digest binary, decoded boolean, corners array<struct<{', '.join(f'{n}: long' for n in names)}>>"
    return media.select(F.col(id_col).cast("long").alias("media_id"), F.col(image_col).cast("binary")).mapInArrow(run, kind)


#: A corner's place in quarters of a pixel, turn in 4096ths and step of the pyramid, packed as 20, 20, 12 and 6 bits of a long.
PLACE, TURN, SCALE = 20, 12, 6


def _packed(where: np.ndarray) -> np.ndarray:
    x, y = (np.clip(np.rint(where[:, k] * 4), 0, (1 << PLACE) - 1).astype(np.int64) for k in (0, 1))
    turn = np.rint(where[:, 2] / (2 * np.pi) * (1 << TURN)).astype(np.int64) & ((1 << TURN) - 1)
    return ((x << PLACE | y) << TURN | turn) << SCALE | np.rint(np.log(where[:, 3]) / np.log(STEP)).astype(np.int64)


def _unpacked(at: np.ndarray) -> np.ndarray:
    """(n, 4): x, y, turn, scale of packed places."""
    part = lambda shift, bits: (at >> shift) & ((1 << bits) - 1)
    x, y = part(PLACE + TURN + SCALE, PLACE) / 4, part(TURN + SCALE, PLACE) / 4
    return np.column_stack((x, y, part(SCALE, TURN) * (2 * np.pi / (1 << TURN)), STEP ** part(0, SCALE)))


def agreement(a: np.ndarray, a_tests: np.ndarray, b: np.ndarray, b_tests: np.ndarray) -> tuple[int, float, float, float, float]:
    """(votes, turn in degrees, scale, dx, dy) of the similarity on which most corners of a and b agree; it takes a to b.

    Two corners go together if the tests of neither have a nearer match. Every such match (of very many: HYPOTHESES at
    even steps) proposes a similarity; the best is fitted to the matches that agree with it, and these are counted, as
    many as have places of their own.
    """
    none = (0, 0.0, 1.0, 0.0, 0.0)
    if not len(a) or not len(b):
        return none
    best, apart = np.zeros(len(a), int), np.full(len(a), 999)
    back = np.full(len(b), 999)
    for at in range(0, len(a), PART):
        for to in range(0, len(b), PART):
            d = np.zeros((len(a[at : at + PART]), len(b[to : to + PART])), np.int64)
            for w in range(WORDS):
                d += np.bitwise_count(a_tests[at : at + PART, w, None] ^ b_tests[None, to : to + PART, w])
            back[to : to + PART] = np.minimum(back[to : to + PART], d.min(axis=0))
            near = d.argmin(axis=1)
            least = d[np.arange(len(d)), near]
            closer = least < apart[at : at + PART]
            best[at : at + PART][closer], apart[at : at + PART][closer] = near[closer] + to, least[closer]
    hit = np.flatnonzero((apart <= MAX_BITS) & (apart == back[best]))
    if len(hit) < MIN_VOTES:
        return none
    a, b = a[hit], b[best[hit]]
    za, zb = a[:, 0] + 1j * a[:, 1], b[:, 0] + 1j * b[:, 1]
    by = b[:, 3] / a[:, 3] * np.exp(1j * (b[:, 2] - a[:, 2]))
    tried = np.unique(np.linspace(0, len(hit) - 1, min(len(hit), HYPOTHESES)).astype(int))
    scale = np.maximum(b[:, 3], 1.0)
    counts = np.zeros(len(tried), int)
    for k in range(0, len(tried), 256):
        i = tried[k : k + 256]
        off = np.abs(by[i, None] * (za[None] - za[i, None]) + zb[i, None] - zb[None])
        # A proposal's own turn and scale are coarse: the further away, the more it may be off.
        counts[k : k + 256] = (off <= 2 * OFF * scale + 0.12 * np.abs(zb[None] - zb[i, None])).sum(axis=1)
    i = tried[counts.argmax()]
    inside = np.abs(by[i] * (za - za[i]) + zb[i] - zb) <= 2 * OFF * scale + 0.12 * np.abs(zb - zb[i])
    for _ in range(4):
        if inside.sum() < 2 or np.ptp(za[inside].real) + np.ptp(za[inside].imag) < 1:
            return none
        ca, cb = za[inside].mean(), zb[inside].mean()
        alpha = np.vdot(za[inside] - ca, zb[inside] - cb) / (np.abs(za[inside] - ca) ** 2).sum()
        beta = cb - alpha * ca
        inside = np.abs(alpha * za + beta - zb) <= OFF * scale
    votes = len(set(zip((a[inside, 0] // 3).tolist(), (a[inside, 1] // 3).tolist(), strict=True)))
    return votes, float(np.degrees(np.angle(alpha))) % 360, float(np.abs(alpha)), float(beta.real), float(beta.imag)


def _filed(found: DataFrame, own: str, probes: int) -> DataFrame:
    """(own, key, n0, n1): a row for each corner and table, and with probes for each of the flips of its unsure bits."""
    flat = found.select(F.col(own), F.explode("corners").alias("c"))
    keys = []
    for w in range(WORDS):
        key = F.col(f"c.t{w}").bitwiseAND(F.lit((1 << KEY_BITS) - 1)).bitwiseOR(F.lit(w << KEY_BITS))
        flips, left = [key], F.col(f"c.u{w}") if probes else None
        for _ in range(probes):
            bit = left.bitwiseAND(-left)
            left = left.bitwiseXOR(bit)
            flips += [f.bitwiseXOR(bit) for f in flips]
        keys += flips
    beside = [F.col(f"c.n{k}").alias(f"n{k}") for k in range(NEIGHBOURS // 2)]
    return flat.select(own, F.explode(F.array(*keys)).alias("key"), *beside)


def _beside_agrees():
    """Whether a neighbour of corner a and one of corner b stand alike and look alike."""
    halves = lambda side: [h for k in range(NEIGHBOURS // 2) for h in (F.shiftrightunsigned(F.col(f"{side}.n{k}"), 32), F.col(f"{side}.n{k}").bitwiseAND(F.lit(0xFFFFFFFF)))]
    found = F.lit(False)
    for x in halves("a"):
        for y in halves("b"):
            part = lambda shift, bits, x=x, y=y: F.shiftright(x, shift).bitwiseAND(F.lit((1 << bits) - 1)) - F.shiftright(y, shift).bitwiseAND(F.lit((1 << bits) - 1))
            around = lambda d, most: (d + most).bitwiseAND(F.lit(63)) <= 2 * most
            alike = around(part(25, 6), ANGLE_APART) & around(part(19, 6), TURN_APART) & part(15, 4).between(-AWAY_APART, AWAY_APART)
            found = found | ((x != 0) & (y != 0) & alike & (F.bit_count(x.bitwiseXOR(y).bitwiseAND(F.lit(0x7FFF))) <= BITS_APART))
    return found


def _indexed(media: DataFrame, **columns) -> tuple[DataFrame, DataFrame]:
    """All rows with a number (row), and a row for each class of the very same bytes: cid is the number of one of its rows."""
    rows = materialise(described(media, **columns).withColumn("row", F.monotonically_increasing_id()), "media")
    classes = rows.groupBy("digest").agg(F.min("media_id").alias("media_id"), F.count("*").alias("n_copies"), F.min("row").alias("cid"))
    return rows, materialise(classes, "media-classes")


#: Classes of more rows than these, or this share of all, are met without sending their rows to one task.
HOT_ROWS, HOT_SHARE = 1000, 1e-4


def _members(all_rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(media_id, class_id, n_copies) of every row."""
    limit = max(HOT_ROWS, int(all_rows.count() * HOT_SHARE))
    named = classes.select("digest", F.col("media_id").alias("class_id"), "n_copies")
    # At most 1 / HOT_SHARE classes are as large as that.
    hot = F.broadcast(named.where(F.col("n_copies") > limit))
    rows = all_rows.select("media_id", "digest")
    cold = rows.join(hot, "digest", "left_anti").join(named.where(F.col("n_copies") <= limit), "digest")
    return rows.join(hot, "digest").union(cold).select("media_id", "class_id", "n_copies")


def members(media: DataFrame, **columns) -> DataFrame:
    """(media_id, class_id, n_copies) of every row: class_id is the smallest id of the n_copies rows with the same bytes.

    Null and empty images are one class; class_id is null where all of a class have null ids.
    """
    return _members(*_indexed(media, **columns))


def copies_and_members(queries: DataFrame, media: DataFrame, *, min_votes: int = MIN_VOTES, **columns) -> DataFrame:
    """The rows of copies() as kind copy, and those of members() as kind member, with class_id in both.

    A copy's media_id is its class_id; rows of kind member with that class_id are all that the query is a copy of.
    """
    rows, classes = _indexed(media, **columns)
    found = _found(queries, rows, classes, min_votes, **columns).select(F.lit("copy").alias("kind"), "*", F.col("media_id").alias("class_id"))
    return found.unionByName(_members(rows, classes).select(F.lit("member").alias("kind"), "*"), allowMissingColumns=True)


def copies(queries: DataFrame, media: DataFrame, *, min_votes: int = MIN_VOTES, **columns) -> DataFrame:
    """Images of media that queries are copies of, cropped or edited or not: a row for each pair found.

    (query_id, media_id, n_copies, votes, turn, scale, dx, dy): media_id is the smallest id of n_copies rows with the
    very same bytes, which are searched as one. The query's pixels, turned by turn degrees, scaled and moved by dx, dy,
    are the image's; votes are the corners that agree. A query with the very bytes of a class is a copy whatever its
    corners. Null, empty and undecodable images match nothing; repeated queries are answered each; a null id among media
    stands for its class only if the class has no other. members() tells the other ids of the class. Images of any size
    are described whole, and no corner is left out.
    """
    return _found(queries, *_indexed(media, **columns), min_votes, **columns)


def _found(queries: DataFrame, rows: DataFrame, classes: DataFrame, min_votes: int, **columns) -> DataFrame:
    asked = materialise(described(queries, probed=True, **columns).withColumn("rid", F.monotonically_increasing_id()), "media-queries")
    a = _filed(asked, "rid", PROBES).alias("a")
    # One row of each class stands for all of it.
    b = _filed(rows.join(classes.select("cid"), F.col("row") == F.col("cid"), "left_semi").select(F.col("row").alias("cid"), "corners"), "cid", 0).alias("b")
    met = b.join(a, (F.col("a.key") == F.col("b.key")) & _beside_agrees()).select("rid", "cid")
    same = asked.where("decoded").select("rid", "digest").join(classes.select("digest", "cid"), "digest").select("rid", "cid")
    pairs = materialise(met.union(same).distinct(), "media-pairs")
    of_query = asked.select("rid", F.col("media_id").alias("query_id"), F.col("digest").alias("a_digest"), F.transform("corners", lambda c: F.struct(*[c[n].alias(n) for n in ("at", *_TESTS)])).alias("a"))
    of_image = rows.select(F.col("row").alias("cid"), F.col("digest").alias("b_digest"), F.transform("corners", lambda c: F.struct(*[c[n].alias(n) for n in ("at", *_TESTS)])).alias("b"))
    both = pairs.join(of_query, "rid").join(of_image, "cid").select("query_id", "cid", (F.col("a_digest") == F.col("b_digest")).alias("same"), "a", "b")

    def compare(batches):
        for batch in batches:
            out = [agreement(*_corners_of(x), *_corners_of(y)) for x, y in zip(batch.column(3), batch.column(4), strict=True)]
            columns = {"votes": pa.array([v[0] for v in out], pa.int64())}
            columns |= {n: pa.array([round(v[k], 3) for v in out], pa.float64()) for k, n in enumerate(("turn", "scale", "dx", "dy"), 1)}
            yield pa.RecordBatch.from_pydict({n: batch.column(k) for k, n in enumerate(("query_id", "cid", "same"))} | columns)

    kind = "query_id long, cid long, same boolean, votes long, turn double, scale double, dx double, dy double"
    sure = both.mapInArrow(compare, kind).where(F.col("same") | (F.col("votes") >= min_votes)).drop("same")
    return sure.join(classes.select("cid", "media_id", "n_copies"), "cid").select("query_id", "media_id", "n_copies", "votes", "turn", "scale", "dx", "dy")


_TESTS = tuple(f"t{k}" for k in range(WORDS))


def _corners_of(x: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """(where, tests) of a list of corners."""
    flat = x.values
    number = lambda n: flat.field(n).to_numpy(zero_copy_only=False)
    return _unpacked(number("at")), np.stack([number(t).view(np.uint64) for t in _TESTS], axis=1)


SIDE = 80


def rendered(vectors: DataFrame) -> DataFrame:
    """(media_id, image): a picture of overlapping shapes for each vector, the same for equal vectors.

    The test tables have no media column; this gives the operator one of the same size, copies and all.
    """

    def run(batches):
        for batch in batches:
            images = []
            for v in batch.column(1):
                seed = hashlib.md5(np.array([x or 0 for x in v.as_py() or []], np.float32).tobytes()).digest()
                images.append(encode(draw(int.from_bytes(seed[:8], "big"))))
            yield pa.RecordBatch.from_pydict({"media_id": batch.column(0), "image": pa.array(images, pa.binary())})

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "media_id long, image binary")


def draw(seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    grey = np.full((SIDE, SIDE), 128.0)
    left, size = rng.integers(0, SIDE - 6, (24, 2)), rng.integers(6, 24, (24, 2))
    for (x, y), (w, h), tone in zip(left.tolist(), size.tolist(), rng.integers(20, 235, 24).tolist(), strict=True):
        grey[y : y + h, x : x + w] = tone
    grain = _box(_box(rng.normal(0, 1, grey.shape), 2), 1)
    return np.clip(grey * 0.5 + 64 + grain / grain.std() * 28, 0, 255)


def warped(grey: np.ndarray, scale: float, degrees: float) -> np.ndarray:
    """The picture scaled and turned about its centre, bilinear; what lies beyond its edges is grey."""
    height, width = (round(n * scale) for n in grey.shape)
    y, x = np.mgrid[:height, :width]
    back = ((x - (width - 1) / 2) + 1j * (y - (height - 1) / 2)) / scale * np.exp(-1j * np.deg2rad(degrees))
    x, y = back.real + (grey.shape[1] - 1) / 2, back.imag + (grey.shape[0] - 1) / 2
    soft = _box(grey, 1) if scale < 0.8 else grey
    x0, y0 = np.clip(np.floor(x).astype(int), 0, grey.shape[1] - 2), np.clip(np.floor(y).astype(int), 0, grey.shape[0] - 2)
    fx, fy = np.clip(x - x0, 0, 1), np.clip(y - y0, 0, 1)
    out = (soft[y0, x0] * (1 - fx) + soft[y0, x0 + 1] * fx) * (1 - fy) + (soft[y0 + 1, x0] * (1 - fx) + soft[y0 + 1, x0 + 1] * fx) * fy
    beyond = (x < 0) | (y < 0) | (x > grey.shape[1] - 1) | (y > grey.shape[0] - 1)
    return np.where(beyond, 128.0, out)


def edited(grey: np.ndarray, kind: int) -> np.ndarray:
    """A copy cropped, by kind also turned by a quarter, darker with less contrast, or grained; or resized, turned, or both."""
    out = grey[6:76, 8:78]
    if kind == 1:
        out = np.rot90(out)
    if kind == 2:
        out = out * 0.7 + 20
    if kind == 3:
        out = out + np.random.default_rng(kind).normal(0, 3, out.shape)
    if kind >= 4:
        out = warped(grey, *((0.75, 0), (1.25, 0), (1, 30), (0.9, 10))[kind - 4])
    return out


def edits(media: DataFrame) -> DataFrame:
    """(media_id, image): the edited copy of each image."""

    def run(batches):
        for batch in batches:
            grey = [decode(raw.as_py()) for raw in batch.column(1)]
            images = [None if g is None else encode(edited(g, (i or 0) // 20 % 8)) for i, g in zip(batch.column(0).to_pylist(), grey, strict=True)]
            yield pa.RecordBatch.from_pydict({"media_id": batch.column(0), "image": pa.array(images, pa.binary())})

    return media.mapInArrow(run, "media_id long, image binary")
