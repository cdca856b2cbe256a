"""SimHash near-duplicates with covering locality-sensitive hashing.

A 64-bit fingerprint is the bitwise majority of the XXH64 hashes of a text's word shingles. Two fingerprints link when
at most ``radius`` bits differ. Candidate search is covering: each of the 64 bit positions gets a vector of radius + 1
bits, and for each non-zero vector v of that size a mask drops the positions whose vector is orthogonal to v. Up to
``radius`` positions span at most ``radius`` dimensions, so some v is orthogonal to all of them and its mask drops them
all: every pair within the radius agrees on at least one mask, without exception (R. Pagh, "CoveringLSH", 2015).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import Scratch, components

#: Shingles hashed at a time, so that a text of any length needs bounded memory.
_CHUNK = 1 << 16
#: A bucket with more fingerprints than this is dealt anew by blocks of its free bits.
HOT_BUCKET = 50_000


def fingerprint(text: str | None, k: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the k-word shingles, repeats included; without words it is zero."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    k = min(k, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    ends = ends[k - 1 :].tolist()
    n, ones = len(starts), np.zeros(64, np.int64)
    for lo in range(0, n, _CHUNK):
        span = zip(starts[lo : lo + _CHUNK], ends[lo : lo + _CHUNK], strict=True)
        h = np.array([digest(joined[s:e], seed) for s, e in span], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def text_digest(text: str = "text") -> F.Column:
    """SHA-256 of the whole text; texts of one digest are equal. A null text is an empty one."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, seed: int = 42) -> DataFrame:
    """One row (doc_id, fp) per row of docs: fp is the fingerprint as a signed long. A null text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, k, seed) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, fp long")


def _mixed(h: np.ndarray, view: int) -> np.ndarray:
    """Hashes of another family for each view: the finaliser of a 64-bit mixer over h and the view's number."""
    h = h ^ np.uint64((view * 0x9E3779B97F4A7C15) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def word_views(text: str | None, views: int, seed: int = 42) -> list[int]:
    """Signed 64-bit SimHashes of the set of a text's words under as many families of hashes; without words zeros.

    A changed word is one feature here and five among five-word shingles, so near copies differ in far fewer bits; and
    as families are independent, a pair that one view puts too far apart is likely to be near in another.
    """
    words = set(text.encode("utf-8", "surrogatepass").lower().split()) if text else ()
    if not words:
        return [0] * views
    h = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))
    out = []
    for v in range(views):
        x, ones = _mixed(h, v), np.zeros(64, np.int64)
        for lo in range(0, len(x), _CHUNK):
            ones += np.unpackbits(x[lo : lo + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(x), bitorder="little").view(np.int64)[0]))
    return out


def signatures(docs: DataFrame, views: int, seed: int = 42) -> DataFrame:
    """Rows (doc_id, digest, f0, f1, ..), one per row of docs: the digest of the text and its word views."""
    names = [f"f{v}" for v in range(views)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([word_views(t, views, seed) for t in batch.column(2).to_pylist()], np.int64).reshape(-1, views)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(f) for f in fps.T)], ["doc_id", "digest", *names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest().alias("digest"), "text")
    return rows.mapInArrow(run, ", ".join(["doc_id long, digest binary", *(f"{n} long" for n in names)]))


def covering_masks(radius: int = 4, bits: int = 64) -> list[int]:
    """2 ** (radius + 1) - 1 masks of ``bits`` bits; any two words within the radius agree on one of them at least."""
    size = (1 << (radius + 1)) - 1
    if radius == 7 and bits == 64:  # a quadratic bent function beside the six bits of i: every mask keeps 28 bits or more
        phi = [1 | i << 1 | ((i & i >> 1 & 1) ^ (i >> 2 & i >> 3 & 1) ^ (i >> 4 & i >> 5 & 1)) << 7 for i in range(bits)]
    else:
        phi = [1 + (i * 11) % size for i in range(bits)]  # non-zero vectors, dealt evenly
    return [sum(1 << i for i in range(bits) if (phi[i] & v).bit_count() % 2 == 1) for v in range(1, size + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _spans(words: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning forest (member, first member), by position, of the links among words, in memory linear in their count."""
    out, left = [], np.arange(len(words))
    while len(left) > 1:
        root, left = int(left[0]), left[1:]
        queue = [root]
        while queue and len(left):
            near = np.bitwise_count(words[left] ^ words[queue.pop()]) <= radius
            if near.any():
                found, left = left[near].tolist(), left[~near]
                queue += found
                out += [(x, root) for x in found]
    return out


def _link(radius: int, hot: int | None):
    """For rows (bucket, fp, node) in order: edges (a, b) with bucket -1, from each linked node to the least one of all that
    the task has found linked to it; of buckets larger than hot, rows (bucket, fp, node) to be dealt anew.

    Least nodes are the same ones in most buckets of a group, so tasks mostly report the same edges of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (up := parent.get(root, root)) != root:
                root = up
            while (up := parent.get(x, x)) != root:
                parent[x], x = root, up
            return root

        def join(xs: list[int], ys: list[int]) -> None:
            for x, y in zip(xs, ys, strict=True):
                x, y = find(x), find(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)

        def solve(bucket, fp, node):
            new = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
            lo, hi = np.concatenate(([0], new)), np.concatenate((new, [len(bucket)]))
            pairs = lo[hi - lo == 2]
            near = pairs[np.bitwise_count(fp[pairs] ^ fp[pairs + 1]) <= radius]
            join(node[near + 1].tolist(), node[near].tolist())
            for i in np.flatnonzero(hi - lo > 2):
                own = slice(lo[i], hi[i])
                if hot and hi[i] - lo[i] > hot:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (bucket[own], fp[own].view(np.int64), node[own])], schema=schema)
                elif edges := _spans(fp[own], radius):
                    x, y = np.array(edges, np.int64).T + lo[i]
                    join(node[x].tolist(), node[y].tolist())

        held: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cols[1] = cols[1].view(np.uint64)
            # rows before the last bucket of this batch are complete; the last one may go on
            same = cols[0] == cols[0][-1]
            cut = int(len(same) - np.argmin(same[::-1])) if not same.all() else 0
            if cut == 0 and held and held[-1][0][-1] == cols[0][-1]:
                held.append(tuple(cols))
                continue
            if held or cut:
                parts = [*held, tuple(c[:cut] for c in cols)]
                yield from solve(*(np.concatenate(c) for c in zip(*parts, strict=True)))
            held = [tuple(c[cut:] for c in cols)]
        if held:
            yield from solve(*(np.concatenate(c) for c in zip(*held, strict=True)))
        ends = list(parent)
        for lo in range(0, len(ends), 100_000):
            a = ends[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([-1] * len(a), pa.int64()), pa.array(a, pa.int64()), pa.array(list(map(find, a)), pa.int64())], schema=schema)

    return run


def links(words: DataFrame, scratch: Scratch, radius: int = 4, hot: int = HOT_BUCKET) -> DataFrame:
    """Edges (a, b) over nodes whose components are those of all pairs within the radius in any view.

    words has node and one fingerprint column for each view, any names. A bucket's number is its table (view and mask) in
    the first byte and a hash of the kept bits in the rest; equal hashes of different bits cost a comparison, no more.
    """
    schema, masks, views = "bucket long, a long, b long", covering_masks(radius), [c for c in words.columns if c != "node"]
    if len(views) * len(masks) > 127:
        raise ValueError("at most 127 tables: fewer views, or a smaller radius")
    low = F.lit((1 << 56) - 1).cast("long")
    tables = [(v * len(masks) + i, F.col(c), m) for v, c in enumerate(views) for i, m in enumerate(masks)]
    cell = lambda t, fp, m: F.struct((F.xxhash64(fp.bitwiseAND(F.lit(_signed(m)))).bitwiseAND(low) + F.lit(t << 56)).alias("bucket"), fp.alias("fp"))
    rows = words.select("node", F.explode(F.array(*(cell(*t) for t in tables))).alias("c")).select("c.bucket", "c.fp", "node")
    order = ["bucket", "fp", "node"]
    found = scratch.keep(rows.repartition("bucket").sortWithinPartitions(*order).mapInArrow(_link(radius, hot), schema))
    large = found.where("bucket >= 0")
    if large.isEmpty():
        return found.select("a", "b")
    # Pairs of a large bucket agree on its mask; their other bits fall into radius + 1 blocks, one of which is equal.
    blocks = []
    for t, _, m in tables:
        free = [p for p in range(64) if not m >> p & 1]
        blocks += [(t, j, _signed(sum(1 << p for p in free[j :: radius + 1]) | m)) for j in range(radius + 1)]
    block_of = words.sparkSession.createDataFrame(blocks, "table int, block int, bits long")  # (radius + 1) rows a table
    cells = (
        large.select("bucket", F.col("a").alias("fp"), F.col("b").alias("node"), F.shiftright("bucket", 56).cast("int").alias("table"))
        .join(F.broadcast(block_of), "table")
        .select(F.xxhash64("bucket", "block", F.col("fp").bitwiseAND(F.col("bits"))).alias("bucket"), "fp", "node")
    )
    again = cells.repartition("bucket").sortWithinPartitions(*order).mapInArrow(_link(radius, None), schema)
    return found.where("bucket < 0").unionByName(again).select("a", "b")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, seed: int = 42, radius: int = 4, hot: int = HOT_BUCKET
) -> DataFrame:
    """Rows (doc_id, fp, component_id), one for each row of docs.

    component_id is the smallest id that is reachable over links. Null texts and texts without words share fingerprint
    zero and are linked. Rows with a null id take part and get the smallest known id of their component, or null if it
    has none. Texts of any length are hashed whole; repeated rows stay repeated; an empty table gives an empty result;
    other columns of docs are not read. Of scratch tables, that of (doc_id, fp) and that of components stay for the result.
    """
    kept, scratch = Scratch(docs.sparkSession, "simhash"), Scratch(docs.sparkSession, "simhash-links")
    fps = kept.keep(fingerprints(docs, id_col, text_col, k, seed))
    own = scratch.keep(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(own.select("fp", F.col("fp").alias("node")), scratch, radius, hot), scratch)
    rooted = own.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    # the smallest id of each root that others point to; a fingerprint that is alone needs no second look
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = kept.keep(rooted.join(least, "root").select("fp", "component_id"))
    scratch.drop()
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def shingle_hashes(docs: DataFrame, k: int = 5) -> DataFrame:
    """The rows of docs with ``hashes`` for text: the distinct hashes of its k-word shingles, sorted."""
    kept = docs.drop("text")
    schema = kept.withColumn("hashes", F.array().cast("array<long>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part, rows = batch.slice(lo, 256), []
                for text in part.column(part.num_columns - 1).to_pylist():
                    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
                    spans = (b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1) if words else 0))
                    rows.append(np.unique(np.fromiter((xxhash.xxh64_intdigest(x) for x in spans), np.uint64).view(np.int64)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(rows, pa.list_(pa.int64()))], names=schema.names)

    return docs.select(*kept.columns, "text").mapInArrow(run, schema)


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have the given Jaccard similarity; two empty ones have."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common >= similarity * (len(x) + len(y) - common)


def _likes(similarity: float):
    """For rows (part, salt, kind, key columns, hashes) in order: the keys of those that are similar to an earlier one that
    stays, within (part, salt).

    Kind 0 stays without a look, kind 1 stays if it is unlike those, kind 2 is only compared. Two sets of that similarity
    share a hash among the first n - ceil(similarity * n) + 1 of either, n its size, so the ones that stay are found by
    these. Only the rows that stay are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, stay, at = None, [], {}
        for batch in batches:
            gone = []
            keys = zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True)
            for row, ((*own, kind), hashes) in enumerate(zip(keys, batch.column(batch.num_columns - 1), strict=True)):
                if own != part:
                    part, stay, at = own, [], {}
                x = np.asarray(hashes.values.to_numpy(zero_copy_only=False))
                n = len(x)
                # 1e-9: a product that rounding lifts above a whole number must not shorten the prefix
                prefix = x[: n - int(np.ceil(similarity * n - 1e-9)) + 1].tolist() if n else [None]
                near = dict.fromkeys(i for h in prefix for i in at.get(h, ())) if kind else ()
                if any(similarity * max(n, len(stay[i])) <= min(n, len(stay[i])) and similar(x, stay[i], similarity) for i in near):
                    gone.append(row)
                elif kind < 2:
                    for h in prefix:
                        at.setdefault(h, []).append(len(stay))
                    stay.append(x)
            if gone:
                yield batch.take(pa.array(gone)).select(batch.schema.names[3:-1])

    return run


#: Documents of a component that are settled among themselves in one task at a time. Up to 1000, Spark cuts each task's rows
#: of a component to as many before they are shuffled.
BLOCK = 1000


def _settled(rows: DataFrame, scratch: Scratch, key: list[str], similarity: float, block: int) -> list[DataFrame]:
    """Tables of the keys that go of rows (part, key columns, hashes), in the order of the keys.

    The first rows of each part are settled in one task; all others of the part are then compared with those of them that
    stay, in chunks that each meet a copy of these. What is left goes on in the same way, so a task never holds more than
    a block of a part, and the result is that of one loop over the whole part.
    """
    gone, schema = [], ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*key).schema)
    like = lambda df: scratch.keep(df.repartition("part", "salt").sortWithinPartitions("part", "salt", "kind", *key).mapInArrow(_likes(similarity), schema))
    kind = lambda n: F.lit(n).alias("kind")
    while not rows.isEmpty():
        place = F.row_number().over(Window.partitionBy("part").orderBy(*key))
        first = scratch.keep(rows.select("part", *key).withColumn("place", place).where(F.col("place") <= block).select(*key))
        own = rows.join(first, key, "left_semi")
        gone.append(like(own.select("part", F.lit(0).cast("long").alias("salt"), kind(1), *key, "hashes")))
        rest = rows.join(first, key, "left_anti")
        chunks = scratch.keep(rest.groupBy("part").agg(F.ceil(F.count("*") / (16 * block)).cast("long").alias("chunks")))
        if chunks.isEmpty():
            break
        stay = own.join(gone[-1], key, "left_anti").join(chunks, "part")
        stay = stay.select("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("salt"), kind(0), *key, "hashes")
        others = rest.join(chunks, "part").select("part", F.pmod(F.xxhash64("digest"), "chunks").alias("salt"), kind(2), *key, "hashes")
        gone.append(like(stay.unionByName(others)))
        rows = scratch.keep(rest.join(gone[-1], key, "left_anti"))
    return gone


#: Rounds in which each part's smallest id is compared with all others at once; what they leave is solved block by block.
LEADER_ROUNDS = 3
#: Word views of a text, and the radius of each. On pairs of a similarity of 0.8 or more, 97 % or more link in one of them.
VIEWS, VIEW_RADIUS = 4, 4


def distinct_documents(
    docs: DataFrame, k: int = 5, views: int = VIEWS, radius: int = VIEW_RADIUS, similarity: float = 0.8, seed: int = 42, hot: int = HOT_BUCKET, block: int = BLOCK
) -> DataFrame:
    """Rows (doc_id, digest) of the documents that stay when one document of each group of near copies does.

    Candidates are components of texts that link within the radius in any of their word views. Of equal texts the
    smallest id stands for all. In the order of their ids, a document of a component goes if its k-word shingles have the
    given Jaccard similarity with those of one that stays, so no two that stay in a component are near copies, and a chain
    of links or an equal fingerprint never takes a document that is unlike all that stay. Different texts of one id are
    judged each. Null ids stay, with a null digest. The result is a written table; all other scratch is dropped.
    """
    kept, scratch, key = Scratch(docs.sparkSession, "distinct"), Scratch(docs.sparkSession, "distinct-work"), ["doc_id", "digest"]
    names = [f"f{v}" for v in range(views)]
    signed = scratch.keep(signatures(docs, views, seed))
    least = signed.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), *(F.min(n).alias(n) for n in names)).where("doc_id is not null")
    own = scratch.keep(least.withColumn("node", F.xxhash64("digest")))
    linked = Scratch(docs.sparkSession, "distinct-links")
    roots = components(links(own.select("node", *names), linked, radius, hot), linked).select("node", F.col("root").alias("part"))
    member = roots.unionByName(roots.select(F.col("part").alias("node"), "part").distinct())
    wanted = scratch.keep(own.select("node", *key).join(member, "node").select("part", *key))
    linked.drop()
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    rows = texts.join(wanted, "doc_id").where(F.col("digest") == text_digest()).select("part", *key, "text")
    rows = scratch.keep(shingle_hashes(rows, k).dropDuplicates(key))
    gone = []
    for _ in range(LEADER_ROUNDS):
        first = rows.groupBy("part").agg(F.min(F.struct(*key)).alias("lead"), F.count("*").alias("n")).where("n > 1")
        leads = rows.withColumn("lead", F.struct(*key)).join(first, ["part", "lead"]).select("part", "lead", F.col("hashes").alias("y"))
        both = rows.join(leads, "part").where(F.struct(*key) != F.col("lead"))
        common = F.size(F.array_intersect("hashes", "y"))
        near = (common >= similarity * (F.size("hashes") + F.size("y") - common)) | (F.size("hashes") + F.size("y") == 0)
        judged = both.select("part", *key, "hashes", near.alias("near"))
        judged = scratch.keep(judged.select("part", *key, F.when(~F.col("near"), F.col("hashes")).alias("hashes"), "near"))
        gone.append(judged.where("near").select(*key))
        rows = judged.where("not near").select("part", *key, "hashes")
        if rows.isEmpty():
            break
    else:
        gone += _settled(rows, scratch, key, similarity, block)
    stay = own.select(*key).join(reduce(DataFrame.unionByName, gone), key, "left_anti")
    nulls = signed.where("doc_id is null").select("doc_id", F.lit(None).cast("binary").alias("digest")).limit(1)
    stay = kept.keep(stay.unionByName(nulls))
    scratch.drop()
    return stay


def hex16(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
