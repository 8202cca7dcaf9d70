"""Copy detection in image columns by local descriptors.

Corners are found at several scales; around each, pairs of smoothed pixels are
compared after turning the patch to its own orientation, which gives 256 bits.
Images meet through tables of descriptor segments: an entry is one segment of
two neighbouring corners, since one corner alone may look alike in many images.
A query is entered as it is, slightly turned and slightly smaller, so that
resampling does not have to leave whole segments alone.  Pairs that meet are
compared by complete Hamming distances, and count as copies only if enough
matched corners agree on one similarity transform.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import _bytes as B
from quillstone.llm.winnow import build_filter
from quillstone.plans.store import small_batches, written

U64 = np.uint64
RADIUS, BITS, SCALES = 9, 256, (1.0, 0.8, 0.64, 0.5)
#: Strongest corners that describe each AREA of pixels of an image, at each scale; smaller images have as many.
CORNERS, AREA = 40, 64 * 64
#: Tables, and descriptor bits that make a table's segment; an image is entered under the segments of all corners.
TABLES, SEGMENT = 6, 64
#: Nearest corners that a corner is entered with, and the least pixels between the two.
NEIGHBOURS, APART = 3, 14.0
#: What a query is looked up as besides itself: scale and degrees.
PROBES = ((1.0, -10.0), (1.0, -5.0), (1.0, 5.0), (1.0, 10.0), (0.89, 0.0), (0.667, 0.0))
#: Distances or votes that are held at a time.
HELD = 1 << 20
#: Grey levels that a tested pixel must lie below the other; keeps even areas from flipping with noise.
MARGIN = 6.0
#: A match differs in so many bits at most; copies agree in so many corners, and in such a share of the corners of the one that has fewer.
MOST_BITS, LEAST_AGREEING, LEAST_SHARE, TOLERANCE = 40, 5, 0.2, 4.0

_rng = np.random.default_rng(11)
_TESTS = np.clip(_rng.normal(0, RADIUS / 2.2, (BITS, 4)), -(RADIUS - 2) / 1.42, (RADIUS - 2) / 1.42)
_SEGMENTS = [_rng.choice(BITS, SEGMENT, replace=False) for _ in range(TABLES)]
_YY, _XX = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
_DISC = (_YY**2 + _XX**2) <= RADIUS**2


def decode_image(raw: bytes | None) -> np.ndarray | None:
    """Grey levels of a binary PGM or PPM, or of an 8-bit PNG without interlace; else None.

    No more is inflated than the stated size asks for.
    """
    try:
        if raw and raw[:2] in (b"P5", b"P6"):
            fields, at = [], 2
            while len(fields) < 3:
                while raw[at : at + 1].isspace():
                    at += 1
                if raw[at : at + 1] == b"#":
                    at = raw.index(b"\n", at) + 1
                    continue
                end = at
                while raw[end : end + 1].isdigit():
                    end += 1
                fields.append(int(raw[at:end]))
                at = end
            wide, high, white = fields
            if not 0 < white < 256:  # two bytes a pixel
                return None
            deep = 3 if raw[:2] == b"P6" else 1
            return _grey(np.frombuffer(raw, np.uint8, wide * high * deep, at + 1).reshape(high, wide, deep))
        if raw and raw[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(raw)
    except (ValueError, IndexError, TypeError, OverflowError, zlib.error):
        return None
    return None


def _grey(pixels: np.ndarray) -> np.ndarray | None:
    if not pixels.size:
        return None
    return pixels[..., :3].mean(axis=2) if pixels.shape[2] >= 3 else pixels[..., 0].astype(np.float64)


def _png(raw: bytes) -> np.ndarray | None:
    at, data, head = 8, b"", None
    while at < len(raw):
        size, kind = int.from_bytes(raw[at : at + 4], "big"), raw[at + 4 : at + 8]
        body = raw[at + 8 : at + 8 + size]
        head, data = (body if kind == b"IHDR" else head), (data + body if kind == b"IDAT" else data)
        at += size + 12
    wide, high = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
    deep = {0: 1, 2: 3, 4: 2, 6: 4}.get(head[9])
    if head[8] != 8 or head[12] or deep is None:
        return None
    lines = np.frombuffer(zlib.decompressobj().decompress(data, max(1, high * (1 + wide * deep))), np.uint8).reshape(high, 1 + wide * deep)
    out = np.zeros((high, wide * deep), np.int64)
    for y in range(high):
        rule, line, above = lines[y, 0], lines[y, 1:].astype(np.int64), out[y - 1] if y else np.zeros(wide * deep, np.int64)
        if rule == 0:
            out[y] = line
        elif rule == 1:
            out[y] = (line.reshape(wide, deep).cumsum(axis=0) & 255).ravel()
        elif rule == 2:
            out[y] = (line + above) & 255
        else:
            row = out[y]
            for x in range(wide * deep):
                a, c = (row[x - deep], above[x - deep]) if x >= deep else (0, 0)
                b = above[x]
                if rule == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                row[x] = (line[x] + guess) & 255
    return _grey(out.reshape(high, wide, deep).astype(np.float64))


def encode_pgm(pixels: np.ndarray) -> bytes:
    grey = np.clip(np.rint(pixels), 0, 255).astype(np.uint8)
    return b"P5 %d %d 255\n" % (grey.shape[1], grey.shape[0]) + grey.tobytes()


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Mean over (2r + 1) squared, the edge continued."""
    p = np.pad(a, r + 1, mode="edge")[:-1, :-1].cumsum(0).cumsum(1)
    k = 2 * r + 1
    return (p[k:, k:] - p[:-k, k:] - p[k:, :-k] + p[:-k, :-k])[: a.shape[0], : a.shape[1]] / k**2


def _resized(a: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1.0:
        return a
    high, wide = int(a.shape[0] * scale), int(a.shape[1] * scale)
    y, x = (np.arange(high) + 0.5) / scale - 0.5, (np.arange(wide) + 0.5) / scale - 0.5
    y0, x0 = np.clip(y.astype(int), 0, a.shape[0] - 2), np.clip(x.astype(int), 0, a.shape[1] - 2)
    fy, fx = np.clip(y - y0, 0, 1)[:, None], np.clip(x - x0, 0, 1)[None, :]
    return (a[y0][:, x0] * (1 - fx) + a[y0][:, x0 + 1] * fx) * (1 - fy) + (a[y0 + 1][:, x0] * (1 - fx) + a[y0 + 1][:, x0 + 1] * fx) * fy


def _turned(a: np.ndarray, degrees: float) -> np.ndarray:
    """Turned about the middle, between pixels; the edge continues."""
    t = np.deg2rad(degrees)
    high, wide = a.shape
    yy, xx = np.mgrid[:high, :wide]
    yy, xx = yy - (high - 1) / 2, xx - (wide - 1) / 2
    x = np.clip(np.cos(t) * xx + np.sin(t) * yy + (wide - 1) / 2, 0, wide - 1)
    y = np.clip(np.cos(t) * yy - np.sin(t) * xx + (high - 1) / 2, 0, high - 1)
    x0, y0 = np.minimum(x.astype(int), wide - 2), np.minimum(y.astype(int), high - 2)
    fx, fy = x - x0, y - y0
    return (a[y0, x0] * (1 - fx) + a[y0, x0 + 1] * fx) * (1 - fy) + (a[y0 + 1, x0] * (1 - fx) + a[y0 + 1, x0 + 1] * fx) * fy


def probes(pixels: np.ndarray) -> list[np.ndarray]:
    """What a query is looked up as, itself first."""
    if min(pixels.shape) < 4:
        return [pixels]
    return [pixels, *[_turned(_resized(pixels, scale), degrees) if degrees else _resized(pixels, scale) for scale, degrees in PROBES]]


def describe(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners (x, y, scale, angle) in the image's own coordinates, and their 256 bits as four words."""
    points, words = [], []
    for scale in SCALES:
        a = _resized(pixels, scale) if min(pixels.shape) * scale > 2 * RADIUS + 2 else None
        if a is None:
            continue
        smooth = _box(a, 1)
        gy, gx = np.gradient(smooth)
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        strength = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        peak = strength
        for axis in (0, 1):
            peak = np.maximum.reduce([np.roll(peak, d, axis) for d in (-2, -1, 0, 1, 2)])
        inner = np.zeros(a.shape, bool)
        inner[RADIUS + 1 : -RADIUS - 1, RADIUS + 1 : -RADIUS - 1] = True
        y, x = np.nonzero((strength == peak) & (strength > 1.0) & inner)
        order = np.lexsort((x, y, -strength[y, x]))[: max(CORNERS, -(-CORNERS * pixels.size // AREA))]
        y, x = y[order], x[order]
        if not len(y):
            continue
        patches = smooth[y[:, None, None] + _YY, x[:, None, None] + _XX] * _DISC
        angle = np.arctan2((patches * _YY).sum((1, 2)), (patches * _XX).sum((1, 2)))
        cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]
        at = lambda dx, dy: smooth[np.rint(y[:, None] + sin * dx + cos * dy).astype(int), np.rint(x[:, None] + cos * dx - sin * dy).astype(int)]
        bits = at(_TESTS[:, 0], _TESTS[:, 1]) + MARGIN < at(_TESTS[:, 2], _TESTS[:, 3])
        points.append(np.stack([x / scale, y / scale, np.full(len(x), scale), angle], axis=1))
        words.append(np.packbits(bits, axis=1).view("<u8"))
    if not points:
        return np.zeros((0, 4)), np.zeros((0, 4), U64)
    return np.concatenate(points), np.concatenate(words)


def _neighbours(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each corner with its ``NEIGHBOURS`` nearest of the same scale that are ``APART`` pixels away or more."""
    one, two = [], []
    for scale in np.unique(points[:, 2]):
        at = np.flatnonzero(points[:, 2] == scale)
        z = (points[at, 0] + 1j * points[at, 1]) * scale
        k, step = min(NEIGHBOURS, len(at) - 1), max(1, HELD // len(at))
        for lo in range(0, len(at) if k else 0, step):
            far = np.abs(z[lo : lo + step, None] - z[None])
            far[far < APART] = np.inf
            near = np.argpartition(far, k - 1, axis=1)[:, :k]
            i, j = np.nonzero(np.isfinite(np.take_along_axis(far, near, axis=1)))
            one.append(at[lo + i])
            two.append(at[near[i, j]])
    empty = np.zeros(0, np.int64)
    return (np.concatenate(one), np.concatenate(two)) if one else (empty, empty)


def sketch(points: np.ndarray, words: np.ndarray) -> list[int]:
    """The table entries of an image: each table's segments of all pairs of neighbouring corners, in either order."""
    out: list[int] = []
    one, two = _neighbours(points)
    if len(one):
        bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(len(words), -1), axis=1)
        for t, chosen in enumerate(_SEGMENTS):
            name = B.mix64(np.ascontiguousarray(np.packbits(bits[:, chosen], axis=1)).view("<u8").ravel() ^ U64(t + 1))
            low, high = np.minimum(name[one], name[two]), np.maximum(name[one], name[two])
            out += np.unique(B.mix64(low * U64(0xBF58476D1CE4E5B9) ^ high)).view(np.int64).tolist()
    return out


def enough(agreeing_: int, a: np.ndarray, b: np.ndarray) -> bool:
    return agreeing_ >= max(LEAST_AGREEING, LEAST_SHARE * min(len(a), len(b)))


def agreeing(p: np.ndarray, a: np.ndarray, q: np.ndarray, b: np.ndarray) -> int:
    """Matched corners that agree on the best similarity transform from the first image to the second."""
    if not len(a) or not len(b):
        return 0
    i, j, least = np.arange(len(a)), np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    step = max(1, HELD // len(b))
    for lo in range(0, len(a), step):
        apart = np.bitwise_count(a[lo : lo + step, None] ^ b[None]).sum(axis=2)
        j[lo : lo + step], least[lo : lo + step] = apart.argmin(axis=1), apart.min(axis=1)
    ok = least <= MOST_BITS
    i, j = i[ok], j[ok]
    if len(i) < LEAST_AGREEING:
        return 0
    z, w = p[i, 0] + 1j * p[i, 1], q[j, 0] + 1j * q[j, 1]
    # each match alone fixes turn and scale; the others vote on its shift
    turn = np.exp(1j * (q[j, 3] - p[i, 3])) * (p[i, 2] / q[j, 2])
    best, most = None, 0
    step = max(1, HELD // len(z))
    for lo in range(0, len(z), step):
        at = slice(lo, lo + step)
        error = np.abs(w[None, :] - w[at, None] - turn[at, None] * (z[None, :] - z[at, None]))
        near = (error <= TOLERANCE) & (np.abs(np.log(np.abs(turn[None, :] / turn[at, None]))) < 0.3)
        votes = near.sum(axis=1)
        if votes.max() > most:
            best, most = near[votes.argmax()], votes.max()
    # corners of several scales on one place count once
    return len({(round(u.real / 3), round(u.imag / 3)) for u in z[best]})


def describe_images(images: DataFrame, id_col: str, image_col: str, asked: bool = False) -> DataFrame:
    """(id, digest, points, words); digest is of the pixels, null if the image can't be read.

    asked: ``sketch`` too, the entries of all that a query is looked up as.
    """
    small_batches(images.sparkSession, 256)
    kind = images.schema[id_col].dataType.simpleString()

    def kernel(batches):
        for batch in batches:
            rows: list[tuple] = []
            for raw in batch.column(1).to_pylist():
                pixels = decode_image(raw)
                if pixels is None:
                    rows.append((None, b"", b"", []))
                    continue
                points, words = describe(pixels)
                entries = sorted(set(sketch(points, words)).union(*[sketch(*describe(p)) for p in probes(pixels)[1:]])) if asked else []
                rows.append((hashlib.sha256(str(pixels.shape).encode() + pixels.tobytes()).hexdigest(), points.astype("<f4").tobytes(), words.astype("<u8").tobytes(), entries))
            digest, points, words, entries = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digest, pa.string()), pa.array(points, pa.binary()), pa.array(words, pa.binary()), *[pa.array(entries, pa.list_(pa.int64()))] * asked],
                names=["id", "digest", "points", "words", *["sketch"] * asked],
            )

    schema = f"id {kind}, digest string, points binary, words binary" + ", sketch array<bigint>" * asked
    return images.select(F.col(id_col).alias("id"), F.col(image_col).alias("image")).mapInArrow(kernel, schema)


def _corners(points: bytes, words: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(points, "<f4").reshape(-1, 4).astype(float), np.frombuffer(words, "<u8").reshape(-1, 4)


def _entries(shared):
    """(digest, points, words) -> (digest, key): the entries that some query may have, too."""

    def kernel(batches):
        for batch in batches:
            for digest, points, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys = np.array(sketch(*_corners(points, words)), np.int64)
                keys = keys[shared.value.passes(keys.view(U64))]
                yield pa.RecordBatch.from_arrays([pa.array([digest] * len(keys), pa.string()), pa.array(keys)], names=["digest", "key"])

    return kernel


def _verify(batches):
    """Pairs of images with their corners -> those that are copies."""
    for batch in batches:
        count, copies = [], []
        for pa_, a, pb, b in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
            (p, u), (q, v) = _corners(pa_, a), _corners(pb, b)
            count.append(agreeing(p, u, q, v))
            copies.append(enough(count[-1], u, v))
        held = pa.array(copies, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(held), batch.column(1).filter(held), pa.array(count, pa.int64()).filter(held)], names=["q", "r", "agreeing"])


def find_copies(images: DataFrame, queries: DataFrame, id_col: str = "id", image_col: str = "image") -> tuple[DataFrame, DataFrame]:
    """Classes of ``images`` and matches of ``queries`` among them.

    First table: ``id``, ``class_id`` (least id with the same pixels), one row
    per row.  Second: ``query`` (least id of the query images with the same
    pixels), ``class_id``, ``agreeing``; one row per pair of unlike pixels or
    like ones, so copies are compared once, whatever their number.  Images that
    are null or can't be read have a null class and match nothing; images of a
    few pixels or of one grey have no corners and match nothing.  Of equal votes
    for a transform the first corner's counts.  Repeated rows stay repeated; empty tables give no rows; other columns are ignored.
    """
    kind = images.schema[id_col].dataType.simpleString()
    table = written(describe_images(images, id_col, image_col), "images")
    asked = written(describe_images(queries, id_col, image_col, asked=True), "queries")
    # written, so that the joins are of two plain exchanges and hot pixels or entries can be split
    known = written(table.where("digest is not null").groupBy("digest").agg(F.min("id").alias("class_id")), "pixels")
    classes = table.join(known, "digest", "left").select(F.col("id").alias(id_col), "class_id")
    parts = ["points", "words", "sketch"]
    asked = written(asked.where("digest is not null").groupBy("digest").agg(F.min(F.struct("id", *parts)).alias("x")).select(F.col("x.id").alias("q"), *[F.col(f"x.{c}") for c in parts]), "asked")
    keys = asked.select("q", F.explode("sketch").alias("key"))
    shared = images.sparkSession.sparkContext.broadcast(build_filter(keys.select(F.col("key").alias("mark"))))  # 32 MB at most
    entered = table.where("digest is not null").select("digest", "points", "words").mapInArrow(_entries(shared), "digest string, key bigint").distinct()
    pairs = written(keys.join(written(entered, "entries"), "key").select("q", "digest").distinct(), "pairs")
    met = written(pairs.select("digest").distinct(), "met")
    stored = table.select("digest", "points", "words").join(met, "digest", "left_semi").dropDuplicates(["digest"]).join(known, "digest").select("digest", F.col("class_id").alias("r"), F.col("points").alias("p2"), F.col("words").alias("w2"))
    both = pairs.join(asked.select("q", F.col("points").alias("p1"), F.col("words").alias("w1")), "q").join(written(stored, "stored"), "digest")
    checked = both.select("q", "r", "p1", "w1", "p2", "w2").mapInArrow(_verify, f"q {kind}, r {kind}, agreeing bigint")
    return classes, checked.select(F.col("q").alias("query"), F.col("r").alias("class_id"), "agreeing")
