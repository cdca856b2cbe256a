"""Hard negatives by a dual-tree search over anchors and candidates.

One split tree, fitted on a bounded sample, gives every row a leaf; rows of a leaf are cut into pages. Anchors and
candidates have nodes of their own over it: pages (of anchors: groups), and limbs above them (a limb is the first half of
a leaf's path). A node has the centre of its vectors and a radius around it, measured over all its rows, so for a pair of
nodes with centres a, c and radii r, s every inner product lies within a.c +- (|a|s + |c|r + rs). The search descends from
the pair of roots to limbs and to pages, on both sides at once, and drops pairs (a whole group of anchors for a whole group
of candidates) whose interval can't hold what any anchor of the group still looks for. What is left is scored exactly, the
most promising page first. The tree's fit only decides how much is pruned, never what is found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import Scratch

#: Rows that the tree is fitted on, about, and the most levels that it may have.
SAMPLE, MOST_LEVELS = 20_000, 10
#: Bytes of a page of candidates, about (64 rows of 64 components), and rows of a group of anchors at most.
PAGE_BYTES, GROUP = 8192, 512
#: Pages that one task scores for one group of anchors, and rows that it scores at a time.
CHUNK, AT_ONCE = 512, 1024
_NONE = np.iinfo(np.int64).min
_PAGE = "side int, leaf int, ids binary, labels binary, vectors binary, center array<double>, radius double, label long"


def integer_rows(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Rows (id, label, vec) of those that take part: vec is floor(256 * x) of each component x as double, a long.

    Null ids, labels and vectors, and vectors with a null or non-finite component, take no part.
    """
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    known = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()
    vec = F.transform(x, lambda v: F.floor(v * F.lit(256.0)))
    return embeddings.where(known & finite).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), vec.alias("vec"))


class SplitTree:
    """Halves a sample again and again at the median of its direction of greatest spread, found by power iteration."""

    def __init__(self, sample: np.ndarray, levels: int, dims: int):
        self.levels = levels
        self.axes, self.cuts = np.zeros((1 << levels, dims)), np.zeros(1 << levels)
        rng, rows = np.random.default_rng(7), {1: np.arange(len(sample))}
        for node in range(1, 1 << levels):
            mine = rows.pop(node, None)
            if mine is None or len(mine) < 4:
                continue
            own = sample[mine]
            away, axis = own - own.mean(axis=0), rng.standard_normal(dims)
            for _ in range(8):
                axis = away.T @ (away @ axis)
                axis /= np.linalg.norm(axis) or 1.0
            along = own @ axis
            self.axes[node], self.cuts[node] = axis, np.median(along)
            rows[2 * node], rows[2 * node + 1] = mine[along <= self.cuts[node]], mine[along > self.cuts[node]]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        node = np.ones(len(x), np.int64)
        for _ in range(self.levels):
            node = 2 * node + (np.einsum("ij,ij->i", x, self.axes[node]) > self.cuts[node])
        return node - (1 << self.levels)


def matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    """The vectors of a batch; a component that a vector lacks is zero."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat, out = column.flatten().to_numpy(zero_copy_only=False), np.zeros((len(lengths), dims), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _narrow(x: np.ndarray) -> bytes:
    most = int(np.abs(x).max(initial=0))
    return x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64).tobytes()


def _wide(data: bytes, rows: int, dims: int) -> np.ndarray:
    size = len(data) // max(1, rows * dims)
    return np.frombuffer(data, {2: np.int16, 4: np.int32, 8: np.int64}[size]).reshape(rows, dims)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; an error where they may leave 64 bits."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most >= 2**63:
        raise OverflowError("inner products of these vectors may exceed 64 bits")
    return a.astype(np.int64) @ b.astype(np.int64).T


def _paged(dims: int, sizes: tuple[int, int]) -> Callable:
    """For rows (side, leaf, id, label, vec) in order of side and leaf: pages; side 0 candidates, side 1 anchors."""

    def page(side: int, leaf: int, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> tuple:
        order = np.argsort(ids, kind="stable")
        ids, labels, x = ids[order], labels[order], x[order]
        center = x.mean(axis=0)
        radius = float(np.sqrt(((x - center) ** 2).sum(axis=1).max()))
        only = int(labels[0]) if (labels == labels[0]).all() else None
        return side, leaf, ids.tobytes(), labels.tobytes(), _narrow(x), center, radius, only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            if not held:
                return
            side, leaf, ids, labels, x = (np.concatenate(c) for c in zip(*held, strict=True))
            ends = np.flatnonzero(np.concatenate(((side[1:] != side[:-1]) | (leaf[1:] != leaf[:-1]), [last])))
            out, lo = [], 0
            for hi in (ends + 1).tolist():
                step = sizes[side[lo]]
                for at in range(lo, hi, step):
                    own = slice(at, min(at + step, hi))
                    out.append(page(int(side[lo]), int(leaf[lo]), ids[own], labels[own], x[own]))
                lo = hi
            step = sizes[side[lo]] if lo < len(side) else 1
            while len(side) - lo >= step:  # whole pages of a leaf that goes on
                own = slice(lo, lo + step)
                out.append(page(int(side[lo]), int(leaf[lo]), ids[own], labels[own], x[own]))
                lo += step
            held = [(side[lo:], leaf[lo:], ids[lo:], labels[lo:], x[lo:])] if lo < len(side) else []
            if out:
                schema = pa.schema([("side", pa.int32()), ("leaf", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary()), ("center", pa.list_(pa.float64())), ("radius", pa.float64()), ("label", pa.int64())])
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            if batch.num_rows:
                held.append((*(batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)), matrix(batch.column(4), dims)))
                yield from cut(False)
        yield from cut(True)

    return run


def _dot(a, b) -> F.Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _interval(pairs: DataFrame, dims: int) -> DataFrame:
    """Adds lo and hi, between which all inner products of a pair of nodes (a_center, a_radius, c_center, c_radius) lie."""
    a, c, r, s = F.col("a_center"), F.col("c_center"), F.col("a_radius"), F.col("c_radius")
    norm = lambda x: F.sqrt(_dot(x, x))
    spread = norm(a) * s + norm(c) * r + r * s
    slack = F.lit(1.0) + F.lit(1e-9 * dims) * (norm(a) + r) * (norm(c) + s)  # for rounding; scores are whole numbers
    return pairs.withColumn("_m", _dot(a, c)).withColumn("_w", spread + slack).withColumn("lo", F.col("_m") - F.col("_w")).withColumn("hi", F.col("_m") + F.col("_w"))


def _limbs(pages: DataFrame, shift: int) -> DataFrame:
    """Nodes above pages: the mean of their centres, and a radius that holds every page's ball."""
    limb = F.shiftright("leaf", shift).alias("limb")
    mean = pages.select(limb, F.posexplode("center").alias("k", "v")).groupBy("limb", "k").agg(F.avg("v").alias("v"))
    center = mean.groupBy("limb").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("limb_center"))
    far = F.zip_with("center", "limb_center", lambda x, y: x - y)
    return pages.select(limb, "center", "radius").join(center, "limb").groupBy("limb").agg(
        F.first("limb_center").alias("center"), F.max(F.sqrt(_dot(far, far)) + F.col("radius")).alias("radius")
    )


def _named(nodes: DataFrame, side: str) -> DataFrame:
    return nodes.select(F.lit(0).alias("root"), *(F.col(c).alias(f"{side}_{c}") for c in nodes.columns))


class _Best:
    """The k best (score, id) of each query, higher scores first and ties by the smaller id."""

    def __init__(self, n: int, k: int):
        self.s, self.i = np.full((n, k), _NONE, np.int64), np.full((n, k), np.iinfo(np.int64).max, np.int64)

    def merge(self, s: np.ndarray, i: np.ndarray) -> None:
        s, i = np.concatenate([self.s, s], axis=1), np.concatenate([self.i, i], axis=1)
        order = np.lexsort((i, -1 - s), axis=1)[:, : self.s.shape[1]]  # -1 - s: the negative of the least long is no long
        self.s, self.i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def _positives(anchors: dict, k: int):
    """A scorer that keeps the k best other rows of each anchor's label."""
    ids, labels, x = anchors["ids"], anchors["labels"], anchors["x"]
    best = _Best(len(ids), k)

    def want() -> tuple[float, float]:
        worst = best.s[:, -1].min()
        return (-np.inf if worst == _NONE else float(worst)), np.inf

    def look(c_ids: np.ndarray, c_labels: np.ndarray, c: np.ndarray) -> None:
        s = scores(x, c)
        s[(labels[:, None] != c_labels) | (ids[:, None] == c_ids)] = _NONE
        top = np.argsort(-1 - s, axis=1, kind="stable")[:, :k]
        best.merge(np.take_along_axis(s, top, 1), np.where(np.take_along_axis(s, top, 1) == _NONE, np.iinfo(np.int64).max, c_ids[top]))

    def rows() -> Iterator[tuple]:
        for slot, rank in zip(*np.nonzero(best.s != _NONE), strict=True):
            yield int(slot), int(ids[slot]), int(best.i[slot, rank]), int(best.s[slot, rank])

    return want, look, rows


def _negatives(anchors: dict, k: int, low: int, high: int):
    """A scorer that keeps, for each wanted (slot, positive), the k best rows of other labels in the score's window."""
    labels, x, wanted = anchors["labels"], anchors["x"], anchors["wanted"]
    slots = np.array([w[0] for w in wanted], np.int64)
    top = np.array([w[3] for w in wanted], np.int64)
    least = np.array([-(-low * w[3] // high) for w in wanted], np.int64)
    best = _Best(len(wanted), k)

    def want() -> tuple[float, float]:
        need = np.maximum(least, best.s[:, -1])
        open_ = need <= top
        return (float(need[open_].min()), float(top[open_].max())) if open_.any() else (np.inf, -np.inf)

    def look(c_ids: np.ndarray, c_labels: np.ndarray, c: np.ndarray) -> None:
        s = scores(x, c)
        s[labels[:, None] == c_labels] = _NONE
        order = np.argsort(-1 - s, axis=1, kind="stable")
        s, found = np.take_along_axis(s, order, 1), c_ids[order]
        above = (s[slots] > top[:, None]).sum(axis=1)
        at = above[:, None] + np.arange(k)
        inside = at < s.shape[1]
        at = np.minimum(at, s.shape[1] - 1)
        own, own_ids = s[slots[:, None], at], found[slots[:, None], at]
        fit = inside & (own >= least[:, None]) & (own != _NONE)
        best.merge(np.where(fit, own, _NONE), np.where(fit, own_ids, np.iinfo(np.int64).max))

    def rows() -> Iterator[tuple]:
        ids = anchors["ids"]
        for q, rank in zip(*np.nonzero(best.s != _NONE), strict=True):
            yield int(slots[q]), int(ids[slots[q]]), int(wanted[q][1]), int(wanted[q][2]), int(top[q]), int(best.i[q, rank]), int(best.s[q, rank])

    return want, look, rows


def _searched(dims: int, scorer: Callable, names: list[str]) -> Callable:
    """For rows (gid, chunk, hi, lo, ids, labels, vectors, wanted) in order, the anchors of each (gid, chunk) first (hi is
    null), then its pages from the highest hi: what the scorer keeps. A page whose interval can't help is not scored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, want, look, rows, out, held = None, None, None, None, [], []

        def flush() -> None:
            if held:
                c_ids, c_labels, c = (np.concatenate(x) for x in zip(*held, strict=True))
                order = np.argsort(c_ids, kind="stable")  # so that a stable order of scores breaks ties by the smaller id
                look(c_ids[order], c_labels[order], c[order])
                held.clear()

        def emitted() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols)], names=["gid", *names])

        for batch in batches:
            for gid, chunk, hi, lo, ids, labels, vectors, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (gid, chunk) != key:
                    if rows:
                        flush()
                        out += [(key[0], *r) for r in rows()]
                    key = gid, chunk
                    a_ids = np.frombuffer(ids, np.int64)
                    want, look, rows = scorer({"ids": a_ids, "labels": np.frombuffer(labels, np.int64), "x": _wide(vectors, len(a_ids), dims), "wanted": [tuple(w.values()) for w in wanted or []]})
                    least, most = want()
                elif hi >= least and lo <= most:
                    c_ids = np.frombuffer(ids, np.int64)
                    held.append((c_ids, np.frombuffer(labels, np.int64), _wide(vectors, len(c_ids), dims)))
                    if sum(len(h[0]) for h in held) >= AT_ONCE:
                        flush()
                        least, most = want()
                if len(out) >= 10_000:
                    yield emitted()
                    out = []
        if rows:
            flush()
            out += [(key[0], *r) for r in rows()]
        if out:
            yield emitted()

    return run


class _Search:
    """Both trees over the rows, as written tables, and the descent over them."""

    def __init__(self, rows: DataFrame, scratch: Scratch, sample: int, most_levels: int):
        self.scratch, spark = scratch, rows.sparkSession
        rows = scratch.keep(rows)
        n, dims = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
        self.dims = max(1, dims)
        per_page = max(4, PAGE_BYTES // (2 * self.dims))
        # a level for each doubling beyond a few pages, and for the anchors as many of these as they fill groups
        n_anchors = rows.where("anchor").count()
        levels = min(most_levels, max(1, (n // (8 * per_page)).bit_length()))
        up = levels - min(levels, (n_anchors // GROUP).bit_length())
        self.up, self.shift = up, {"a": (levels - up + 1) // 2, "c": (levels + 1) // 2}
        # a bounded sample, spread over all rows by a hash of their ids
        picked = rows.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n // sample))) == 0).select("vec").limit(4 * sample)
        got = [r[0] for r in picked.collect()]
        fit = np.zeros((len(got), self.dims))
        for x, v in zip(fit, got, strict=True):
            x[: len(v)] = v
        tree, width = spark.sparkContext.broadcast(SplitTree(fit, levels, self.dims)), self.dims

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaf = tree.value.leaves(matrix(batch.column(2), width).astype(np.float64))
                yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), *batch.columns], names=["leaf", "id", "label", "vec", "anchor"])

        placed = rows.mapInArrow(assign, "leaf int, id long, label long, vec array<long>, anchor boolean")
        sides = F.explode(F.when(F.col("anchor"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
        placed = scratch.keep(placed.withColumn("side", sides).withColumn("leaf", F.when(F.col("side") == 1, F.shiftright("leaf", up)).otherwise(F.col("leaf"))))
        # a leaf of very many rows is dealt to several tasks, which page their own part of it; at most 2 ** levels rows a side
        dealt = placed.groupBy("side", "leaf").agg(F.ceil(F.count("*") / 50_000).cast("long").alias("tasks"))
        salt = F.pmod(F.xxhash64("id", "vec"), F.col("tasks"))
        ordered = placed.join(F.broadcast(dealt), ["side", "leaf"]).repartition("side", "leaf", salt).sortWithinPartitions("side", "leaf")
        pages = ordered.select("side", "leaf", "id", "label", "vec").mapInArrow(_paged(self.dims, (per_page, GROUP)), _PAGE)
        pages = scratch.keep(pages.withColumn("page", F.monotonically_increasing_id()))
        self.groups = pages.where("side = 1").withColumnRenamed("page", "gid").drop("side")
        self.pages = pages.where("side = 0").drop("side")
        self.chunks = max(1, -(-self.pages.count() // CHUNK))
        self.limbs_a, self.limbs_c = (_named(_limbs(x, self.shift[s]), s) for x, s in ((self.groups, "a"), (self.pages, "c")))

    def pairs(self, want: DataFrame, same_label: bool) -> DataFrame:
        """The descent: (gid, page, lo, hi) of the pairs that may hold what is wanted; want has gid, least and most.

        From the pair of roots to all pairs of limbs, and from those that stay to pairs of pages.
        """
        limb = lambda side: F.shiftright("leaf", self.shift[side]).alias(f"{side}_limb")
        groups = self.groups.join(want, "gid").select("gid", limb("a"), "least", "most", *(F.col(c).alias(f"a_{c}") for c in ("center", "radius", "label")))
        need = groups.groupBy("a_limb").agg(F.min("least").alias("least"), F.max("most").alias("most"))
        fits = (F.col("hi") >= F.col("least")) & (F.col("lo") <= F.col("most"))
        tops = _interval(self.limbs_a.join(self.limbs_c, "root").join(need, "a_limb"), self.dims).where(fits).select("a_limb", "c_limb")
        pages = self.pages.select("page", limb("c"), *(F.col(c).alias(f"c_{c}") for c in ("center", "radius", "label")))
        both = groups.join(tops, "a_limb").join(pages, "c_limb")
        one = F.col("a_label").isNotNull() & F.col("c_label").isNotNull()
        useless = one & ((F.col("a_label") != F.col("c_label")) if same_label else (F.col("a_label") == F.col("c_label")))
        return _interval(both.where(~useless), self.dims).where(fits).select("gid", "page", "lo", "hi")

    def scored(self, pairs: DataFrame, wanted: DataFrame | None, scorer: Callable, names: list[str]) -> DataFrame:
        """Rows (gid, names..) that the scorer keeps of each group and chunk of its pages."""
        blobs = ["ids", "labels", "vectors"]
        dealt = pairs.withColumn("chunk", F.pmod(F.xxhash64("page"), F.lit(self.chunks)))
        none = F.lit(None).cast("array<struct<slot:long,place:long,positive:long,score:long>>")
        groups = self.groups.join(wanted, "gid") if wanted is not None else self.groups.withColumn("wanted", none)
        heads = dealt.select("gid", "chunk").distinct().join(groups, "gid").select("gid", "chunk", F.lit(None).cast("double").alias("hi"), F.lit(None).cast("double").alias("lo"), *blobs, "wanted")
        tails = dealt.join(self.pages, "page").select("gid", "chunk", "hi", "lo", *blobs, none.alias("wanted"))
        rows = heads.unionByName(tails).repartition("gid", "chunk").sortWithinPartitions("gid", "chunk", F.col("hi").desc_nulls_first())
        return rows.mapInArrow(_searched(self.dims, scorer, names), ", ".join(["gid long", *(f"{c} long" for c in names)]))


def _best(found: DataFrame, keys: list[str], score: str, other: str, k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(other))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, sample: int = SAMPLE, most_levels: int = MOST_LEVELS) -> DataFrame:
    """Hard negatives of the rows of (id, label, vec array<long>, anchor boolean) that are anchors.

    An anchor's positives are its first rows of the same label by inner product, ties by the smaller id; for each, the
    first rows of other labels whose score is at most the positive's and at least low / high of it. Result: (anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score), exact for any data; an anchor without positives,
    or a positive without negatives in its window, has no row.

    A component that a vector lacks counts as zero. Rows that repeat an id are rows of their own, but none is a positive of
    an anchor of its own id; anchors that repeat give their rows each. Inner products that may exceed 64 bits are an
    error; an empty table gives no row; other columns are not read. Written tables of pages stay for the result.
    """
    scratch = Scratch(rows.sparkSession, "hardneg")
    search = _Search(rows.select("id", "label", "vec", "anchor"), scratch, sample, most_levels)
    inf, find, names = float("inf"), lambda a: _positives(a, positives), ["slot", "anchor_id", "positive_id", "positive_score"]
    # a first bound for each group: its best rows on one page of each leaf below its own
    home = search.pages.groupBy("leaf").agg(F.min("page").alias("page")).select("page", F.shiftright("leaf", search.up).alias("leaf"))
    near = search.groups.join(home, "leaf").select("gid", "page", F.lit(-inf).alias("lo"), F.lit(inf).alias("hi"))
    seen = search.scored(near, None, find, names).groupBy("gid", "slot").agg(F.count("*").alias("n"), F.min("positive_score").alias("s"))
    whole = seen.where(F.col("n") == positives).groupBy("gid").agg(F.min("s").cast("double").alias("s"), F.count("*").alias("slots"))
    sized = search.groups.select("gid", (F.octet_length("ids") / 8).alias("rows")).join(whole, "gid", "left")
    least = sized.select("gid", F.when(F.col("slots") == F.col("rows"), F.col("s")).otherwise(-inf).alias("least"), F.lit(inf).alias("most"))
    found = search.scored(scratch.keep(search.pairs(scratch.keep(least), True)), None, find, names)
    best = _best(found, ["gid", "slot"], "positive_score", "positive_id", positives).withColumnRenamed("rank", "place")
    best = scratch.keep(best.where("positive_score >= 0"))  # the window of a negative score is empty
    each = F.struct("slot", F.col("place").cast("long").alias("place"), F.col("positive_id").alias("positive"), F.col("positive_score").alias("score"))
    wanted = best.groupBy("gid").agg(F.collect_list(each).alias("wanted"))  # of one group: at most GROUP * positives
    span = best.groupBy("gid").agg((F.min("positive_score") * F.lit(low / high) - 1).alias("least"), F.max("positive_score").cast("double").alias("most"))
    names = ["slot", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"]
    found = search.scored(scratch.keep(search.pairs(scratch.keep(span), False)), scratch.keep(wanted), lambda a: _negatives(a, negatives, low, high), names)
    return _best(found, ["gid", "slot", "place"], "negative_score", "negative_id", negatives).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )
