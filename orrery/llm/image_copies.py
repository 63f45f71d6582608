"""Copies of images, cropped or edited, by local descriptors and geometric consensus.

Images come as the structs of Spark's ``image`` source (height, width, nChannels,
data) or as grey grids.  Corners are local maxima of the Harris response on a
pyramid of scales.  A corner's direction is that of the intensity centroid around
it; its descriptor is 256 comparisons of smoothed pixel pairs, turned by that
direction: some close by, the rest in a wide ring around them, on a smoother image.
The two pixels of a pair lie side by side, across the direction, so that neither is
brighter as a rule: along it one nearly always is, and such bits put different
pictures into the same bucket.

Descriptors are looked up in ``TABLES`` hash tables, each keyed by ``KEY_BITS`` bits of
its own choice; two corners of a bucket meet if their last 64 bits differ in at most
``NEAR_BITS``.  A pair of images is verified if two or more of its meetings, of
different corners of both, agree in turn and in change of scale.  Verification
matches the descriptors themselves: mutual matches of least Hamming distance each
propose a similarity transform, and a link needs enough of them to agree on one.

Images with equal pixels are one node.  Links make nodes one class.  Nodes are dealt
over blocks by a hash; each two blocks meet in one task, with the images of both, so
no row per meeting leaves a task, only links.  There a bucket is never expanded into
all its pairs: in each round its members meet one of them (the last, later on one of
the first and one of the last class), and rounds go on while they find links.  After
that, buckets that still hold several classes give the pairs across these classes; of
those that have not met, the ones with two agreeing meetings are verified.  So every
such pair is decided or lies within one class.  Between two blocks only pairs across
them count.  The work still grows with the square of the number of images: chance
meetings do, at a constant rate a pair, and each image goes to as many tasks as there
are blocks.

The search is approximate in one point only: copies that meet less than twice are
not found.  Of edited copies that verification accepts, at least 0.9 meet (noise,
brightness, turns, sizes, crops; ``tests/llm/test_image_search.py`` measures this
against all pairs, the README gives figures).

Defined results: an image that is null, empty or of fewer than ``LEAST_AGREE``
corners is linked only to images of equal pixels (null: to none), as so few corners
agree by chance; one of 5 to 7 needs all of its corners; repeated rows share a class;
ties in a bucket do not matter, as classes depend on the links alone; an empty table
gives no rows; extra columns do not enter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch
from .words import U, mix64

BITS, TABLES, KEY_BITS, NEAR_BITS = 256, 4, 26, 9
SCALE_STEP, LEAST_SIDE = 1.4142135623730951, 24
#: Rings of pixel pairs: pairs, radius, further smoothings, pixels between the two across the direction (along it, at most 1).
RINGS = ((96, 12, 0, 3), (160, 24, 3, 6))
RADIUS = 10  # of the disc whose centroid gives the direction
CORNER = 0.05  # of the image's largest response
#: Of 256 bits, at most this many differ in a match; matches that must agree; part of the fewer corners that must.
MATCH_BITS, MIN_AGREE, MIN_PART = 48, 8, 0.35
#: An image of fewer than ``MIN_AGREE`` corners needs all of them to agree, and at least this many.
LEAST_AGREE = 5
#: Two meetings agree within so much of a turn and so many steps of scale.
TURN_OFF, STEPS_OFF = 0.1, 1
TILE = 6  # pixels to a cell of a grey grid
BLOCK = 1 << 22  # descriptor pairs that are compared at once
#: Images of a block, at most on average; blocks at least; meetings that a task looks at together.
BLOCK_IMAGES, LEAST_BLOCKS, MEETINGS = 8192, 4, 1 << 21

_KERNEL = np.exp(-0.5 * (np.arange(-3, 4) / 1.5) ** 2)
_KERNEL /= _KERNEL.sum()


def _blur(x: np.ndarray) -> np.ndarray:
    for axis in (0, 1):
        pad = [(3, 3) if a == axis else (0, 0) for a in (0, 1)]
        p = np.pad(x, pad, mode="edge")
        n = x.shape[axis]
        x = sum(k * (p[i : i + n] if axis == 0 else p[:, i : i + n]) for i, k in enumerate(_KERNEL))
    return x


def _resize(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear, with pixel centres aligned."""
    r = np.clip((np.arange(h) + 0.5) * x.shape[0] / h - 0.5, 0, x.shape[0] - 1)
    c = np.clip((np.arange(w) + 0.5) * x.shape[1] / w - 0.5, 0, x.shape[1] - 1)
    r0, c0 = np.minimum(r.astype(int), max(x.shape[0] - 2, 0)), np.minimum(c.astype(int), max(x.shape[1] - 2, 0))
    r1, c1 = np.minimum(r0 + 1, x.shape[0] - 1), np.minimum(c0 + 1, x.shape[1] - 1)
    fr, fc = (r - r0)[:, None], (c - c0)[None]
    return (x[r0][:, c0] * (1 - fr) + x[r1][:, c0] * fr) * (1 - fc) + (x[r0][:, c1] * (1 - fr) + x[r1][:, c1] * fr) * fc


def grey_of_struct(height: int, width: int, channels: int, data: bytes) -> np.ndarray | None:
    """Grey values of an image struct; channels are in the order blue, green, red(, alpha)."""
    if not data or height <= 0 or width <= 0 or len(data) != height * width * channels:
        return None
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
    return x[:, :, 0] if channels == 1 else x[:, :, :3] @ np.array([0.114, 0.587, 0.299])


def grey_of_grid(values) -> np.ndarray | None:
    """A square grid of numbers as an image of ``TILE`` pixels a cell; null or odd-sized grids have none."""
    side = int(len(values) ** 0.5) if values is not None else 0
    if not side or side * side != len(values) or any(v is None or v != v for v in values):
        return None
    x = np.array(values, float).reshape(side, side)
    span = x.max() - x.min()
    return _resize((x - x.min()) * (255 / span if span else 0), side * TILE, side * TILE)


def _pattern(ring: int) -> np.ndarray:
    """(pairs, 2, 2) pixel pairs around a corner, (across, along) its direction, fixed by a seed."""
    count, radius, _, least = RINGS[ring]
    r = mix64(np.arange(count * 400, dtype=U) ^ U(ring + 1)).view(np.int64) % (2 * radius + 1)
    pairs = np.abs(r).reshape(-1, 2, 2) - radius
    inside = (pairs**2).sum(axis=2).max(axis=1) <= radius**2
    across, along = np.abs(pairs[:, 0] - pairs[:, 1]).T
    return pairs[inside & (along <= 1) & (across >= least)][:count].astype(float)


_PAIRS = [_pattern(ring) for ring in range(len(RINGS))]
#: Which bits make the key of each table.
_KEYS = np.stack([np.argsort(mix64(np.arange(BITS, dtype=U) ^ mix64(np.full(BITS, t + 1, U))), kind="stable")[:KEY_BITS] for t in range(TABLES)])
_DISC = np.array([(r, c) for r in range(-RADIUS, RADIUS + 1) for c in range(-RADIUS, RADIUS + 1) if r * r + c * c <= RADIUS * RADIUS])


def _tests(smooth: np.ndarray, at: np.ndarray, angle: np.ndarray) -> list[np.ndarray]:
    """For each ring, whether the first pixel of each pair is darker."""
    cos, sin = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
    out = []
    for (_, radius, smoothings, _), pairs in zip(RINGS, _PAIRS):
        for _ in range(smoothings):
            smooth = _blur(smooth)
        edge = radius + 1
        padded = np.pad(smooth, edge, mode="edge")
        r = np.rint(cos * pairs[:, :, 0] + sin * pairs[:, :, 1]).astype(int)
        c = np.rint(-sin * pairs[:, :, 0] + cos * pairs[:, :, 1]).astype(int)
        values = padded[at[:, 0, None, None] + edge + r, at[:, 1, None, None] + edge + c]
        out.append(values[:, :, 0] < values[:, :, 1])
    return out


def corners(grey: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 4) float32 row, column, scale, direction in the image's pixels, and (n, BITS // 8) bytes."""
    points, codes = [], []
    scale, image = 1.0, grey
    while min(image.shape) >= LEAST_SIDE:
        smooth = _blur(image)
        gr, gc = np.gradient(smooth)
        rr, cc, rc = _blur(gr * gr), _blur(gc * gc), _blur(gr * gc)
        response = rr * cc - rc * rc - 0.05 * (rr + cc) ** 2
        inner = response[1:-1, 1:-1]
        peak = np.ones(inner.shape, bool)
        for dr in (0, 1, 2):
            for dc in (0, 1, 2):
                if (dr, dc) != (1, 1):
                    peak &= inner > response[dr : dr + inner.shape[0], dc : dc + inner.shape[1]]
        peak &= inner > max(CORNER * response.max(), 1e-9)
        at = np.argwhere(peak) + 1
        if len(at):
            padded = np.pad(smooth, RADIUS, mode="edge")
            patch = padded[at[:, :1] + RADIUS + _DISC[:, 0], at[:, 1:] + RADIUS + _DISC[:, 1]]
            angle = np.arctan2(patch @ _DISC[:, 0], patch @ _DISC[:, 1])
            codes.append(np.packbits(np.concatenate(_tests(smooth, at, angle), axis=1), axis=1))
            points.append(np.column_stack([at * scale, np.full(len(at), scale), angle]))
        scale *= SCALE_STEP
        shape = int(grey.shape[0] / scale), int(grey.shape[1] / scale)
        if min(shape) < LEAST_SIDE:
            break
        image = _resize(smooth, *shape)
    if not points:
        return np.zeros((0, 4), np.float32), np.zeros((0, BITS // 8), np.uint8)
    return np.concatenate(points).astype(np.float32), np.concatenate(codes)


def table_keys(points: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct buckets of an image's descriptors over all tables, and for each a corner in it and its last 64 bits.

    A key is exact: the table's number above its ``KEY_BITS`` bits.  A corner is one
    number: its index, the step of its scale (8 bits) and its direction in 256ths of a turn (8 bits).
    """
    bits = np.unpackbits(codes, axis=1)[:, _KEYS].astype(np.int64)  # corner, table, bit
    keys = (bits << np.arange(KEY_BITS)).sum(axis=2) | (np.arange(TABLES) << KEY_BITS)
    step = np.rint(np.log(np.maximum(points[:, 2], 1)) / np.log(SCALE_STEP)).astype(np.int64)
    turn = np.rint(points[:, 3].astype(float) * (128 / np.pi)).astype(np.int64) & 255
    corner = (np.arange(len(codes)) << 16) | (step << 8) | turn
    keys, first = np.unique(keys.reshape(-1), return_index=True)
    last = np.ascontiguousarray(codes).view(np.int64)[:, -1]
    return keys, corner[first // TABLES], last[first // TABLES]


def _matches(ca: np.ndarray, cb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mutual matches of least distance, not above ``MATCH_BITS``: indices into a and b."""
    wa, wb = (np.ascontiguousarray(c).view(U) for c in (ca, cb))
    nearest, distance = np.zeros(len(wa), np.int64), np.zeros(len(wa), np.int64)
    back, back_distance = np.zeros(len(wb), np.int64), np.full(len(wb), BITS + 1, np.int64)
    rows = max(1, BLOCK // len(wb))
    for at in range(0, len(wa), rows):
        part = wa[at : at + rows]
        d = np.bitwise_count(part[:, 0, None] ^ wb[None, :, 0]).astype(np.uint16)
        for k in range(1, wa.shape[1]):
            d += np.bitwise_count(part[:, k, None] ^ wb[None, :, k])
        nearest[at : at + rows] = d.argmin(axis=1)
        distance[at : at + rows] = d[np.arange(len(part)), nearest[at : at + rows]]
        own = d.argmin(axis=0)
        own_distance = d[own, np.arange(len(wb))]
        closer = own_distance < back_distance
        back[closer], back_distance[closer] = own[closer] + at, own_distance[closer]
    mine = np.flatnonzero((back[nearest] == np.arange(len(wa))) & (distance <= MATCH_BITS))
    return mine, nearest[mine]


def _consensus(a: np.ndarray, b: np.ndarray) -> int:
    """The most of the matched corners ``a`` -> ``b`` that one of them, as a similarity transform, maps onto their partners."""
    turn, grow = b[:, 3] - a[:, 3], b[:, 2] / a[:, 2]
    cos, sin = np.cos(turn) * grow, np.sin(turn) * grow
    near, best = 3 * np.maximum(b[None, :, 2], 1), 0
    rows = max(1, BLOCK // 8 // len(a))
    for at in range(0, len(a), rows):
        k = slice(at, at + rows)
        d = a[None, :, :2] - a[k, None, :2]
        r = b[k, None, 0] + cos[k, None] * d[:, :, 0] + sin[k, None] * d[:, :, 1]
        c = b[k, None, 1] - sin[k, None] * d[:, :, 0] + cos[k, None] * d[:, :, 1]
        off = np.hypot(r - b[None, :, 0], c - b[None, :, 1])
        best = max(best, int((off <= near + 0.1 * np.hypot(d[:, :, 0], d[:, :, 1])).sum(axis=1).max()))
    return best


def is_copy(pa_: np.ndarray, ca: np.ndarray, pb: np.ndarray, cb: np.ndarray) -> bool:
    """Whether enough matches agree in either direction; how far one may be off is counted in pixels of the second image."""
    fewer = min(len(pa_), len(pb))
    need = max(min(MIN_AGREE, max(fewer, LEAST_AGREE)), MIN_PART * fewer)
    if fewer < need:
        return False
    i, j = _matches(ca, cb)
    if len(i) < need:
        return False
    a, b = pa_[i].astype(float), pb[j].astype(float)
    return _consensus(a, b) >= need or _consensus(b, a) >= need


def _pack(points: np.ndarray, codes: np.ndarray) -> bytes:
    return points.tobytes() + codes.tobytes()


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw) // (16 + BITS // 8)
    return np.frombuffer(raw, np.float32, 4 * n).reshape(n, 4), np.frombuffer(raw, np.uint8, offset=16 * n).reshape(n, BITS // 8)


def _describe(grey) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                contents, features = [], []
                for value in part.column(1).to_pylist():
                    image = grey(value) if value is not None else None
                    if image is None:
                        contents.append(None), features.append(None)
                        continue
                    pixels = np.ascontiguousarray(np.rint(image), np.uint8)
                    h = mix64(pixels.reshape(-1).astype(U) + np.arange(pixels.size, dtype=U) * U(257) + U(pixels.shape[1]))
                    contents.append(np.array([h.sum(), mix64(h ^ U(0x1B873593)).sum()], U).tobytes())
                    features.append(_pack(*corners(image)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(contents, pa.binary()), pa.array(features, pa.binary())], ["id", "content", "features"])

    return run


def _agreeing(pairs: np.ndarray, corner_a: np.ndarray, corner_b: np.ndarray) -> np.ndarray:
    """The distinct ones of ``pairs`` (one number each) of which two or more meetings agree."""
    order = np.argsort(pairs, kind="stable")
    pairs, a, b = pairs[order], corner_a[order], corner_b[order]
    i, j, turn, step = a >> 16, b >> 16, b - a & 255, (b >> 8 & 255) - (a >> 8 & 255)
    at, off, good = np.arange(len(pairs)), 0, []
    while len(at):  # a pair has at most as many meetings as an image has keys
        off += 1
        at = at[at + off < len(pairs)]
        at = at[pairs[at] == pairs[at + off]]
        to = at + off
        turned = turn[at] - turn[to] & 255
        agree = (i[at] != i[to]) & (j[at] != j[to]) & (np.minimum(turned, 256 - turned) <= int(TURN_OFF * 256)) & (np.abs(step[at] - step[to]) <= STEPS_OFF)
        good.append(pairs[at[agree]])
    return np.unique(np.concatenate([pairs[:0], *good]))


class _Blocks:
    """The search among the images of one block, or between those of two (``side`` 0 and 1)."""

    def __init__(self, nodes: np.ndarray, side: np.ndarray, features: list[bytes], buckets: list[bytes | None]):
        order = np.lexsort((nodes, side))
        self.nodes, side = nodes[order], side[order]
        self.features = [features[k] for k in order]
        rows = [_buckets(features[k], buckets[k]) for k in order]
        self.n, self.two = len(order), bool(side.any())
        self.classes = np.arange(self.n)
        self.asked = np.zeros(0, np.int64)
        self.links: list[tuple[int, int]] = []
        own = np.repeat(np.arange(self.n), [len(r[0]) for r in rows])
        key, corner, last = (np.concatenate([r[c] for r in rows]) if rows else np.zeros(0, np.int64) for c in range(3))
        by_key = np.argsort(key, kind="stable")  # and so by side and image within a bucket
        self.key, self.own, self.corner, self.last, self.right = key[by_key], own[by_key], corner[by_key], last[by_key], side[own[by_key]] > 0

    def _open(self) -> None:
        """Leave the rows of buckets that hold several classes and, of two blocks, images of both."""
        while True:
            self.start = np.flatnonzero(np.r_[True, self.key[1:] != self.key[:-1]]) if len(self.key) else np.zeros(0, np.int64)
            self.size = np.diff(np.r_[self.start, len(self.key)])
            if not len(self.key):
                return
            of = self.classes[self.own]
            several = np.minimum.reduceat(of, self.start) < np.maximum.reduceat(of, self.start)
            if self.two:
                right = np.add.reduceat(self.right.astype(np.int64), self.start)
                several &= (right > 0) & (right < self.size)
            if several.all():
                return
            stay = np.repeat(several, self.size)
            self.key, self.own, self.corner, self.last, self.right = (x[stay] for x in (self.key, self.own, self.corner, self.last, self.right))

    def _ask(self, x: np.ndarray, y: np.ndarray) -> int:
        """Verify the pairs of which two meetings (rows ``x`` and ``y``) agree, unless they are of one class; the links found."""
        near = np.bitwise_count((self.last[x] ^ self.last[y]).view(U)) <= NEAR_BITS
        near &= self.classes[self.own[x]] != self.classes[self.own[y]]
        x, y = x[near], y[near]
        first = self.own[x] < self.own[y]
        x, y = np.where(first, x, y), np.where(first, y, x)
        pairs = _agreeing(self.own[x] * self.n + self.own[y], self.corner[x], self.corner[y])
        pairs = pairs[~np.isin(pairs, self.asked)]
        found, parent = len(self.links), self.classes
        for a, b in zip((pairs // self.n).tolist(), (pairs % self.n).tolist()):
            if parent[a] == parent[b]:
                continue
            lower, upper = (a, b) if self.nodes[a] < self.nodes[b] else (b, a)
            if is_copy(*_unpack(self.features[lower]), *_unpack(self.features[upper])):
                self.links.append((lower, upper))
                parent[parent == max(parent[a], parent[b])] = min(parent[a], parent[b])
        self.asked = np.union1d(self.asked, pairs)
        return len(self.links) - found

    def _pivots(self, extreme) -> tuple[np.ndarray, np.ndarray]:
        """Rows, and the row that each meets: the extreme one of its bucket, or of the bucket's images of the other block."""
        code = self.classes[self.own] * self.n + self.own
        worst = -1 if extreme is np.maximum else self.n * self.n
        x, y = [], []
        for there in (True, False) if self.two else (None,):
            can = np.ones(len(code), bool) if there is None else self.right == there
            best = np.repeat(extreme.reduceat(np.where(can, code, worst), self.start), self.size)
            pivot = np.repeat(np.flatnonzero(can & (code == best)), self.size)  # an image is once in a bucket
            meets = np.flatnonzero(pivot != np.arange(len(code)) if there is None else ~can)
            x.append(meets), y.append(pivot[meets])
        return np.concatenate(x), np.concatenate(y)

    def _rest(self) -> None:
        """All pairs across classes, of a few images with all their partners at a time."""
        at = np.arange(len(self.key))
        end = np.repeat(self.start + self.size, self.size)
        begin = end - np.repeat(np.add.reduceat(self.right.astype(np.int64), self.start), self.size) if self.two else at + 1
        partners = np.where(self.right, 0, end - begin)
        each = np.bincount(self.own, partners, self.n)
        for chunk in np.split(np.arange(self.n), np.flatnonzero(np.diff(np.cumsum(each) // MEETINGS)) + 1):
            rows = at[(self.own >= chunk[0]) & (self.own <= chunk[-1]) & (partners > 0)]
            many = partners[rows]
            x = np.repeat(rows, many)
            if len(x):
                self._ask(x, np.repeat(begin[rows] - np.cumsum(many) + many, many) + np.arange(len(x)))

    def run(self) -> list[tuple[int, int]]:
        """Links (of nodes, the lesser first) that connect all that the search finds."""
        self._open()
        found, later = len(self.key), False
        while found and len(self.key):
            found = self._ask(*self._pivots(np.maximum)) + (self._ask(*self._pivots(np.minimum)) if later else 0)
            later = True
            self._open()
        if len(self.key):
            self._rest()
        return [(int(self.nodes[a]), int(self.nodes[b])) for a, b in self.links]


def _buckets(features: bytes, given: bytes | None) -> np.ndarray | tuple[np.ndarray, ...]:
    """Keys, corners and last bits: as ``given``, else from the descriptors."""
    if given is not None:
        return np.frombuffer(given, np.int64).reshape(-1, 3).T
    return table_keys(*_unpack(features))


def _search(table: pa.Table) -> pa.Table:
    nodes, side = (table.column(c).to_numpy() for c in ("node", "side"))
    links = _Blocks(nodes, side, table.column("features").to_pylist(), table.column("buckets").to_pylist()).run()
    return pa.table([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _given(rows: pa.Table) -> pa.Table:
    packed = np.column_stack([rows.column(c).to_numpy() for c in ("key", "corner", "last")]).astype(np.int64).tobytes()
    return pa.table([rows.column("node").combine_chunks().slice(0, 1), pa.array([packed], pa.binary())], names=["node", "buckets"])


def classes_of(scratch: Scratch, features: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """(node, class) for the linked ones of the images (node, features).

    ``keys`` (key, node, corner, last) are the buckets they lie in; by default those of their descriptors.
    """
    if keys is None:
        images = features.withColumn("buckets", F.lit(None).cast("binary"))
    else:
        images = features.join(keys.groupBy("node").applyInArrow(_given, "node long, buckets binary"), "node")
    blocks = max(LEAST_BLOCKS, -(-features.count() // BLOCK_IMAGES))
    own = F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("own")
    met = images.select("node", "features", "buckets", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    first, second = F.least("own", "other"), F.greatest("own", "other")
    met = met.select("node", "features", "buckets", (F.col("own") > first).cast("int").alias("side"), (first * blocks + second).alias("blocks"))
    links = scratch.keep(met.groupBy("blocks").applyInArrow(_search, "a long, b long"), "links")
    classes = components(scratch, links)
    scratch.drop("links")
    return classes


def copies(images: DataFrame, id_column: str, image_column: str, grey=None) -> DataFrame:
    """One row per row of ``images``: id, class_id (smallest id of the class), class_size.

    ``grey`` turns a value of ``image_column`` into grey pixels; by default it is
    read as a struct of Spark's image source.
    """
    grey = grey or (lambda s: grey_of_struct(s["height"], s["width"], s["nChannels"], s["data"]))
    scratch = Scratch(images.sparkSession, "images")
    kind = images.schema[id_column].dataType.simpleString()
    rows = images.select(F.col(id_column).alias("id"), F.col(image_column).alias("image"))
    # Rows are numbered before they are written, so the numbers stay the same whoever reads them.
    described = rows.mapInArrow(_describe(grey), f"id {kind}, content binary, features binary").withColumn("row", F.monotonically_increasing_id())
    found = scratch.keep(described, "found")
    nodes = found.filter("content is not null").groupBy("content").agg(F.min("row").alias("node"), F.min("id").alias("id"), F.count("*").alias("rows"))
    nodes = scratch.keep(nodes, "nodes")
    features = found.select(F.col("row").alias("node"), "features").join(nodes, "node", "left_semi")
    classes = classes_of(scratch, features)
    named = nodes.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    per_class = named.groupBy("class").agg(F.min("id").alias("class_id"), F.sum("rows").alias("class_size"))
    named = named.join(per_class, "class").select("content", "class_id", "class_size")
    out = found.select("id", "content").join(named, "content", "left")
    return out.select(F.col("id").alias(id_column), F.when(F.col("content").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"))
