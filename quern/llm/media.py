"""Copies among pictures in a media column, cropped or edited ones included, by local descriptors.

Corners are found on several scales of a grey picture; each gets an orientation (intensity centroid) and a descriptor of
binary tests turned by it. Descriptors meet in Hamming tables: the eight blocks of 32 bits are join keys, so two that
differ in at most seven bits always meet in one, and others by chance (at 16 bits two in three do). A match is two
corners that are equal in a block and within the distance; a picture pair with enough of them is a link if one similarity
transform explains enough.

All pairs of every bucket are compared, whatever its size, and each match is listed once, with the first block in which
the two are equal. The lists of a picture meet in one task, which tries each pair and gives a count of links and a root
for each picture, so a group of near copies has all its links counted while what follows grows with its size and not
with its square. The pairs of a hot bucket are dealt by tiles, so that no task has more than two tiles' rows of it.
"""

from __future__ import annotations

import hashlib
from collections import Counter, deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Scratch, components

SCALES = (1.0, 0.84, 0.71, 0.59, 0.5)
#: A picture keeps its strongest corners, one for so many pixels and at least so many; the least Harris response.
CORNER_PIXELS, CORNERS, LEAST_RESPONSE = 288, 32, 2.0e4
#: Binary tests of a descriptor, and the blocks that are join keys.
BITS, TABLES, BLOCK_BYTES = 256, 8, 4
#: Radius of the tested patch; corners nearer to the border have no descriptor. Smaller patches are alike by chance: at 9
#: two unrelated corners are within MATCH_BITS in 9 of 10,000 cases, at 14 in one of a million.
RADIUS = 14
#: Largest Hamming distance of a match, matches a candidate pair needs, inliers of an accepted one, pixels of error.
MATCH_BITS, LEAST_MATCHES, LEAST_INLIERS, ERROR = 28, 4, 4, 3.0
#: Buckets up to this size are compared many at a time.
SMALL_BUCKET = 16
#: Pairs of corners that are compared at a time, and matches in one row of a list.
PAIRS, LIST = 200_000, 128
#: A bucket with more corners than this is dealt anew by pairs of tiles of about so many.
HOT_BUCKET, TILE = 16384, 8192
_POINT = np.dtype([("place", "<f2", 4), ("bits", "u1", BITS // 8)])


@lru_cache(1)
def _tests() -> np.ndarray:
    """Offsets of the pairs of points, for 30 turns: (turn, test, point, yx)."""
    rng = np.random.default_rng(20240101)
    points = rng.normal(0, RADIUS / 2.2, (BITS * 4, 2, 2))
    points = points[(np.hypot(points[..., 0], points[..., 1]) <= RADIUS - 1).all(1)][:BITS]
    turns = np.arange(30) * (2 * np.pi / 30)
    y, x = points[..., 0], points[..., 1]
    c, s = np.cos(turns)[:, None, None], np.sin(turns)[:, None, None]
    return np.rint(np.stack([s * x + c * y, c * x - s * y], axis=-1)).astype(np.int64)


@lru_cache(1)
def _disc() -> tuple[np.ndarray, np.ndarray]:
    y, x = np.mgrid[-7:8, -7:8]
    inside = y * y + x * x <= 49
    return y[inside], x[inside]


def _blur(a: np.ndarray) -> np.ndarray:
    """Binomial smoothing along both sides of stacked pictures."""
    for axis in (1, 2):
        p = np.pad(a, [(2, 2) if k == axis else (0, 0) for k in range(3)], mode="edge")
        n = a.shape[axis]
        cut = lambda i, p=p, axis=axis, n=n: p[:, i : i + n] if axis == 1 else p[:, :, i : i + n]
        a = (cut(0) + cut(4) + 4 * (cut(1) + cut(3)) + 6 * cut(2)) / 16
    return a


def resize(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear resampling of stacked pictures."""
    y, x = (np.arange(h) + 0.5) * a.shape[1] / h - 0.5, (np.arange(w) + 0.5) * a.shape[2] / w - 0.5
    y, x = np.clip(y, 0, a.shape[1] - 1), np.clip(x, 0, a.shape[2] - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, a.shape[1] - 1), np.minimum(x0 + 1, a.shape[2] - 1)
    v, u = (y - y0)[None, :, None], (x - x0)[None, None, :]
    top = a[:, y0][:, :, x0] * (1 - u) + a[:, y0][:, :, x1] * u
    return top * (1 - v) + (a[:, y1][:, :, x0] * (1 - u) + a[:, y1][:, :, x1] * u) * v


def describe(pictures: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For stacked grey pictures (n, h, w): of each its corners (x, y, scale, angle) and packed descriptors."""
    corners = max(CORNERS, pictures.shape[1] * pictures.shape[2] // CORNER_PIXELS)
    found: list[tuple[np.ndarray, ...]] = []
    for scale in SCALES:
        h, w = round(pictures.shape[1] * scale), round(pictures.shape[2] * scale)
        if min(h, w) <= 2 * RADIUS + 4:
            continue
        a = _blur(pictures.astype(np.float32) if scale == 1 else resize(pictures.astype(np.float32), h, w))
        gy, gx = np.gradient(a, axis=(1, 2))
        xx, yy, xy = _blur(gx * gx), _blur(gy * gy), _blur(gx * gy)
        r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        inner = r[:, RADIUS + 1 : h - RADIUS - 1, RADIUS + 1 : w - RADIUS - 1]
        peak = inner > LEAST_RESPONSE / 100
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dy or dx:
                    other = r[:, RADIUS + 1 + dy : h - RADIUS - 1 + dy, RADIUS + 1 + dx : w - RADIUS - 1 + dx]
                    peak &= (inner > other) if (dy, dx) < (0, 0) else (inner >= other)
        k, y, x = np.nonzero(peak)
        if not len(k):
            continue
        strength = inner[k, y, x]
        y, x = y + RADIUS + 1, x + RADIUS + 1
        dy, dx = _disc()
        patch = a[k[:, None], y[:, None] + dy, x[:, None] + dx]
        patch = patch - patch.mean(1, keepdims=True)
        angle = np.arctan2(patch @ dy.astype(np.float32), patch @ dx.astype(np.float32))
        tests = _tests()[np.rint(angle / (2 * np.pi / 30)).astype(int) % 30]
        at = lambda i: a[k[:, None], y[:, None] + tests[:, :, i, 0], x[:, None] + tests[:, :, i, 1]]  # noqa: B023, E731
        bits = np.packbits(at(0) < at(1), axis=1)
        places = np.stack([(x + 0.5) / scale, (y + 0.5) / scale, np.full(len(k), 1 / scale), angle], axis=1)
        order = np.lexsort((-strength, k))  # the place of each corner among its picture's at this scale
        place = np.empty(len(k), np.int64)
        place[order] = np.arange(len(k)) - np.searchsorted(k[order], k[order])
        found.append((k, place, places.astype(np.float32), bits))
    if not found:
        return [(np.zeros((0, 4), np.float32), np.zeros((0, BITS // 8), np.uint8))] * len(pictures)
    k, place, places, bits = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((place, k))  # the strongest of each scale by turns
    begin = np.searchsorted(k[order], np.arange(len(pictures) + 1))
    return [(places[own], bits[own]) for own in (order[b : min(e, b + corners)] for b, e in zip(begin[:-1], begin[1:], strict=True))]


def consensus(a: np.ndarray, b: np.ndarray, enough: int | None = None) -> int:
    """Most matches (rows of corners of either picture) that one similarity transform explains; with enough, no better
    transform is looked for once one explains so many.

    Each match proposes the transform of its own scale and angle; the best few are fitted again to what they explain
    roughly, and then counted closely. Several matches at one spot count once.
    """
    p, q = a[:, 0] + 1j * a[:, 1], b[:, 0] + 1j * b[:, 1]
    m = b[:, 2] / a[:, 2] * np.exp(1j * (b[:, 3] - a[:, 3]))
    m = m[(np.abs(m) > 0.3) & (np.abs(m) < 3.4)]
    gap = np.abs((q[None] - q[:, None]) - m[:, None] * (p[None] - p[:, None])) if len(m) == len(p) else None
    if gap is None:
        return 0 if not len(m) else consensus(*(x[(np.abs(b[:, 2] / a[:, 2]) > 0.3) & (np.abs(b[:, 2] / a[:, 2]) < 3.4)] for x in (a, b)), enough)
    best, spots = 0, lambda z: len({(int(x.real) // 3, int(x.imag) // 3) for x in z})
    for i in np.argsort(-(gap <= 3 * ERROR).sum(1), kind="stable")[:4]:
        near = gap[i] <= 3 * ERROR
        for _ in range(3):
            if near.sum() < 3:
                break
            u, v = p[near] - p[near].mean(), q[near] - q[near].mean()
            size = (np.abs(u) ** 2).sum()
            if size < 1:
                break
            k = (np.conj(u) * v).sum() / size
            off = np.abs(q - q[near].mean() - k * (p - p[near].mean()))
            before, near = near, off <= ERROR * max(1.0, abs(k))
            if (near == before).all():
                break
        best = max(best, min(spots(p[near]), spots(q[near])))
        if enough and best >= enough:
            break
    return best


def described(pictures: DataFrame) -> DataFrame:
    """From (image_id, width, height, pixels): rows (image_id, key, points), a digest of the picture and its corners.

    pixels are grey bytes by rows. A null or a wrong size has no corner; a null has no key either.
    """
    schema = pa.schema([("image_id", pa.int64()), ("key", pa.binary()), ("points", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):
                ids, widths, heights, pixels = (c.to_pylist() for c in whole.slice(lo, 64).columns)
                by: dict[tuple[int, int], list[int]] = {}
                for i, (w, h, p) in enumerate(zip(widths, heights, pixels, strict=True)):
                    if p is not None and w and h and len(p) == w * h:
                        by.setdefault((h, w), []).append(i)
                points: list[list[bytes]] = [[] for _ in ids]
                for (h, w), own in by.items():
                    stack = np.stack([np.frombuffer(pixels[i], np.uint8).reshape(h, w) for i in own])
                    for i, (places, bits) in zip(own, describe(stack), strict=True):
                        made = np.empty(len(places), _POINT)
                        made["place"], made["bits"] = places, bits
                        points[i] = [x.tobytes() for x in made]
                keys = [None if p is None else hashlib.sha256(f"{w}x{h}:".encode() + p).digest() for w, h, p in zip(widths, heights, pixels, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(points, pa.list_(pa.binary()))], schema=schema)

    rows = pictures.select(F.col("image_id").cast("long"), "width", "height", "pixels")
    return rows.mapInArrow(run, "image_id long, key binary, points array<binary>")


MATCHES = "a long, b long, pa long, pb long, large long"
LISTS = "a long, b array<long>, pa long, pb array<long>, large long"


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(-1, dtype=np.int64) <= MATCH_BITS


def _forest(bits: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows first reached from it) of a spanning forest of the descriptors within the distance of each other."""
    left = np.arange(len(bits))
    while len(left) > 1:
        queue, left = deque([int(left[0])]), left[1:]
        while queue and len(left):
            row = queue.popleft()
            near = _near(bits[left], bits[row])
            if near.any():
                found, left = left[near], left[~near]
                queue.extend(found.tolist())
                yield row, found


def _compare(hot: int | None, every: bool = False):
    """For rows (block, image_id, point) in order: matches of corners of different pictures, the smaller picture first;
    of each bucket with more rows than hot only its size, as a, and its block, as large.

    With every, all matches of any bucket, each in the first block in which the two are equal (the block's last three
    bits are its number), as lists for a corner; rows have a side more, and two of one side are compared only if it is
    negative. Without, a bucket of more than SMALL_BUCKET gives a spanning forest, which tells which corners hang together.
    """
    kind = pa.list_(pa.int64()) if every else pa.int64()
    schema = pa.schema([("a", pa.int64()), ("b", kind), ("pa", pa.int64()), ("pb", kind), ("large", pa.int64())])

    def solve(block, image, points, side=None):
        bits, places = np.ascontiguousarray(points["bits"]).view(np.uint64), np.ascontiguousarray(points["place"]).view(np.int64).ravel()
        words = np.ascontiguousarray(points["bits"]).view(f"u{BLOCK_BYTES}")

        def lists(p, q):
            ok = (image[p] != image[q]) & ((side[p] < 0) | (side[p] != side[q]))
            p, q = p[ok], q[ok]
            same, own = words[p] == words[q], block[p] % TABLES
            ok = same[np.arange(len(p)), own] & (same.argmax(1) == own)
            p, q = p[ok], q[ok]
            order = np.argsort(p, kind="stable")
            p, q = p[order], q[order]
            begin = np.flatnonzero(np.append(np.ones(min(1, len(p)), bool), p[1:] != p[:-1]))
            place = np.arange(len(p)) - np.repeat(begin, np.diff(np.append(begin, len(p))))
            row = np.flatnonzero(place % LIST == 0)
            ends = pa.array(np.append(row, len(p)), pa.int32())
            listed = lambda x: pa.ListArray.from_arrays(ends, pa.array(x[q], pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(image[p[row]]), listed(image), pa.array(places[p[row]]), listed(places), pa.nulls(len(row), pa.int64())], schema=schema)

        def matches(p, q):
            ok = image[p] != image[q]
            p, q = p[ok], q[ok]
            swap = image[p] > image[q]
            p, q = np.where(swap, q, p), np.where(swap, p, q)
            ends = [pa.array(places[r]) for r in (p, q)]
            return pa.RecordBatch.from_arrays([pa.array(image[p]), pa.array(image[q]), *ends, pa.nulls(len(p), pa.int64())], schema=schema)

        new = np.flatnonzero(block[1:] != block[:-1]) + 1
        lo, hi = np.concatenate(([0], new)), np.concatenate((new, [len(block)]))
        n = hi - lo
        over = n > hot if hot else np.zeros(len(n), bool)
        for size in np.unique(n[(n > 1) & (n <= SMALL_BUCKET) & ~over]):
            at = lo[n == size]
            i, j = np.triu_indices(size, 1)
            x, y = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
            for s in range(0, len(x), PAIRS):
                p, q = x[s : s + PAIRS], y[s : s + PAIRS]
                ok = _near(bits[p], bits[q])
                if ok.any():
                    yield (lists if every else matches)(p[ok], q[ok])
        for b, e in zip(*(c[(n > SMALL_BUCKET) & ~over].tolist() for c in (lo, hi)), strict=True):
            if every:
                step = max(1, PAIRS // (e - b))
                for r in range(b, e - 1, step):
                    p, q = np.nonzero(np.triu(_near(bits[r : min(r + step, e), None], bits[None, r + 1 : e])))
                    if len(p):
                        yield lists(p + r, q + r + 1)
            elif trees := list(_forest(bits[b:e])):
                p = np.repeat([x for x, _ in trees], [len(y) for _, y in trees])
                yield matches(p + b, np.concatenate([y for _, y in trees]) + b)
        if over.any():
            k = int(over.sum())
            yield pa.RecordBatch.from_arrays([pa.array(n[over]), *(pa.nulls(k, f.type) for f in list(schema)[1:4]), pa.array(block[lo[over]])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            points = np.frombuffer(b"".join(batch.column(2).to_pylist()), _POINT)
            cols = [*(c.to_numpy(zero_copy_only=False) for c in batch.columns[:2]), points, *(c.to_numpy(zero_copy_only=False) for c in batch.columns[3:])]
            last = cols[0] == cols[0][-1]
            cut = 0 if last.all() else int(len(last) - np.argmin(last[::-1]))
            if cut == 0 and held and held[-1][0][-1] == cols[0][-1]:
                held.append(cols)
                continue
            if held or cut:
                yield from solve(*(np.concatenate(c) for c in zip(*held, [c[:cut] for c in cols], strict=True)))
            held = [[c[cut:] for c in cols]]
        if held:
            yield from solve(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return run


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows (a, b, pa, pb) of lists in order of a: of each picture with links that this task finds, their number and the
    least picture that they lead to. A pair is a link if a transform explains enough of its matches."""
    parent: dict[int, int] = {}
    degree: Counter[int] = Counter()

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x], x = root, up
        return root

    def solve(a, b, ends, others):
        order = np.lexsort((others, ends, b))
        b, ends, others = b[order], ends[order], others[order]
        new = np.append(True, (b[1:] != b[:-1]) | (ends[1:] != ends[:-1]) | (others[1:] != others[:-1]))
        b, p, q = b[new], *(x[new].view("<f2").reshape(-1, 4).astype(float) for x in (ends, others))
        begin = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
        size = np.diff(np.append(begin, len(b)))
        for lo, n in zip(begin[size >= LEAST_MATCHES].tolist(), size[size >= LEAST_MATCHES].tolist(), strict=True):
            if consensus(p[lo : lo + n], q[lo : lo + n], LEAST_INLIERS) >= LEAST_INLIERS:
                other = int(b[lo])
                degree.update((a, other))
                x, y = find(a), find(other)
                if x != y:
                    parent[max(x, y)] = min(x, y)

    own, held = None, []
    for batch in batches:
        image, sizes = batch.column(0).to_numpy(), batch.column(1).value_lengths().to_numpy()
        cut = np.append(0, np.cumsum(sizes))
        cols = [batch.column(1).flatten().to_numpy(), np.repeat(batch.column(2).to_numpy(), sizes), batch.column(3).flatten().to_numpy()]
        begin = np.flatnonzero(np.append(np.ones(min(1, len(image)), bool), image[1:] != image[:-1]))
        for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(image)], strict=False):
            if image[lo] != own:
                if held:
                    solve(own, *(np.concatenate(c) for c in zip(*held, strict=True)))
                own, held = int(image[lo]), []
            held.append([c[cut[lo] : cut[hi]] for c in cols])
    if held:
        solve(own, *(np.concatenate(c) for c in zip(*held, strict=True)))
    found = list(degree)
    for lo in range(0, len(found), 100_000):
        part = found[lo : lo + 100_000]
        cols = (part, list(map(find, part)), [degree[x] for x in part])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["image_id", "root", "d"])


def copies(pictures: DataFrame, hot: int = HOT_BUCKET, tile: int = TILE) -> DataFrame:
    """Rows (image_id, class_id, n_links), one per row of pictures (image_id, width, height, pixels).

    class_id is the smallest id that is reachable over links; n_links counts all accepted pairs of a picture's exact
    copies' first one, and those copies. Equal pictures are one class from the start and only their first one is compared. Pictures without corners have links to equal ones alone, nulls to none. Null ids are carried with a null
    class, repeated ids are one picture each row, an empty table gives no row, and other columns are not read.
    """
    spark = pictures.sparkSession
    kept, scratch = Scratch(spark, "media"), Scratch(spark, "media-links")
    rows = kept.keep(described(pictures))
    alone = F.concat(F.lit("null"), F.coalesce(F.col("image_id").cast("string"), F.lit(""))).cast("binary")
    ids = rows.select("image_id", F.coalesce("key", alone).alias("key"))
    firsts = kept.keep(ids.where("image_id is not null").groupBy("key").agg(F.min("image_id").alias("first_id"), F.count_distinct("image_id").alias("n")))
    class_of = kept.keep(firsts.select(F.col("first_id").alias("image_id"), F.col("first_id").alias("cls")).distinct())
    points = rows.select("image_id", F.explode("points").alias("point"))
    word = lambda k: F.conv(F.hex(F.substring("point", 9 + k * BLOCK_BYTES, BLOCK_BYTES)), 16, 10).cast("long") * 8 + k
    cells = points.join(class_of.select("image_id"), "image_id").select(F.explode(F.array(*(word(k) for k in range(TABLES)))).alias("block"), "image_id", "point")
    order, all_sides = ["block", "image_id"], F.lit(-1).cast("long")
    found = kept.keep(cells.withColumn("side", all_sides).repartition("block").sortWithinPartitions(*order).mapInArrow(_compare(hot, True), LISTS))
    large = found.where("large is not null").select(F.col("large").alias("block"), F.ceil(F.col("a") / tile).alias("tiles"))
    matched = found.where("large is null")
    if not large.isEmpty():
        # a row of a hot bucket goes to each pair of tiles that its own is in
        own = cells.join(large, "block").withColumn("own", F.pmod(F.xxhash64("image_id", "point"), F.col("tiles")))
        met = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
        pair = F.xxhash64("block", F.least("own", "other"), F.greatest("own", "other"))
        table = F.shiftleft(pair, 3).bitwiseOR(F.pmod("block", F.lit(TABLES)))  # the block's number stays in its last bits
        side = F.when(F.col("own") == F.col("other"), all_sides).otherwise(F.col("own"))
        dealt = met.select(table.alias("block"), "image_id", "point", side.alias("side"))
        again = kept.keep(dealt.repartition("block").sortWithinPartitions(*order).mapInArrow(_compare(None, True), LISTS))
        matched = matched.unionByName(again)
    matched = matched.select("a", "b", "pa", "pb")
    links = kept.keep(matched.repartition("a").sortWithinPartitions("a").mapInArrow(_links, "image_id long, root long, d long"))
    # tasks name different roots of a group: each picture goes to its least one, and its others do
    least = kept.keep(links.groupBy("image_id").agg(F.min("root").alias("least"), F.sum("d").alias("d")))
    others = links.join(least.select("image_id", "least"), "image_id").select(F.col("root").alias("a"), F.col("least").alias("b")).distinct()
    roots = components(least.select(F.col("image_id").alias("a"), F.col("least").alias("b")).unionByName(others), scratch)
    class_of = kept.keep(class_of.select("image_id").join(roots.withColumnRenamed("node", "image_id"), "image_id", "left").select("image_id", F.coalesce("root", "image_id").alias("cls")))
    scratch.drop()
    degree = least.select(F.col("image_id").alias("first_id"), "d")
    named = firsts.join(class_of.withColumnRenamed("image_id", "first_id"), "first_id").join(degree, "first_id", "left")
    named = named.select("key", F.col("cls").alias("class_id"), (F.coalesce("d", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    out = ids.join(named, "key", "left")
    return out.select("image_id", F.when(F.col("image_id").isNotNull(), F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


@lru_cache(1)
def _patterns(size: int) -> np.ndarray:
    """64 fixed patterns of smooth noise, a third of each of three grains."""
    rng = np.random.default_rng(7)
    out = []
    for k in range(64):
        grain = (size // 12, size // 6, size // 4)[k % 3]
        out.append(resize(rng.normal(0, 1, (1, grain, grain)), size, size)[0].ravel())
    return np.stack(out).astype(np.float32)


def render(vector: list[float], size: int = 96) -> np.ndarray:
    """A grey picture of a vector, its weighted sum of patterns, so that near vectors give near pictures."""
    v = np.zeros(64, np.float32)
    v[: min(64, len(vector))] = np.nan_to_num(np.asarray(vector[:64], np.float32))
    a = v @ _patterns(size)
    return np.clip(128 + 60 * a / max(float(a.std()), 1e-6), 0, 255).astype(np.uint8).reshape(size, size)


def edit(a: np.ndarray, kind: int) -> np.ndarray:
    """Crop, contrast, or a smaller size."""
    if kind == 0:
        return np.ascontiguousarray(a[9:85, 7:87])
    if kind == 1:
        return np.clip(a.astype(float) * 0.8 + 22, 0, 255).astype(np.uint8)
    return np.clip(resize(a[None].astype(np.float32), 84, 84)[0], 0, 255).astype(np.uint8)


def rendered(vectors: DataFrame, planted: bool = True) -> DataFrame:
    """Pictures (image_id, width, height, pixels) of vectors (vec_id, embedding), as the tables hold no media column.

    With planted, every tenth picture (ids that end in 3) is an edited copy of that of the id before it, if there is one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, own, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                vector = before if before is not None else own
                if vector is None:
                    out.append((None, None, None))
                    continue
                a = render(vector)
                a = edit(a, key // 10 % 3) if before is not None else a
                out.append((a.shape[1], a.shape[0], a.tobytes()))
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.binary()), strict=True))], names=["image_id", "width", "height", "pixels"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("image_id"), "embedding")
    if planted:
        before = rows.where("image_id % 10 = 2").select((F.col("image_id") + 1).alias("image_id"), F.col("embedding").alias("before"))
        rows = rows.join(before, "image_id", "left")
    else:
        rows = rows.withColumn("before", F.lit(None).cast("array<float>"))
    # vectors are small and pictures take long: more tasks than the bytes of the vectors would have
    tasks = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), 3 * vectors.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(tasks, "image_id").mapInArrow(run, "image_id long, width int, height int, pixels binary")
