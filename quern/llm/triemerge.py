"""Prefix trie over rebuilt conversations, merged family by family.

A family is the conversations whose ids share ``conv_id - conv_id % 5``. Its rows meet in one task in order, the base's
turns first: a cogroup that streams, of which a task holds no more than the base's first turns, one conversation's
running digest and the family's small trie. Each family emits its nodes with the members that reach them, so what is
shuffled for the global merge is one row for each node of a family, not one for each turn of a conversation. A node is
named by a 128-bit digest chained over its turns; texts are read once, to be hashed, and never shuffled.

Sums over subtrees need no walk by depth. A node belongs to the smallest conversation that reaches it; then the nodes of
a conversation are the end of its path, from some depth on. So a subtree's sum is the running sum of the node's own
conversation from below, and the whole sums of all other conversations that reach the node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import Scratch

#: Conversations of a family, and the number that a conversation's borrowed turns stay below.
FAMILY, BORROWED = 5, 9
#: Nodes of a family's trie that a task holds; what is beyond is emitted in parts, which the merge adds up.
FAMILY_NODES = 50_000
ROOT = bytes(16)
_NODES = "node binary, parent binary, depth long, text_bytes long, members array<long>, ends array<long>"


def turn_rows(conversations: DataFrame) -> DataFrame:
    """Rows (base, other, conv_id, turn, role, text_digest, turn_digest, text_bytes, borrowed) of all turns with an id."""
    conv, role, text = F.col("conv_id").cast("long"), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where(F.col("conv_id").isNotNull()).select(
        (conv - conv % FAMILY).alias("base"),
        (conv % FAMILY != 0).alias("other"),
        conv.alias("conv_id"),
        "turn",
        role.alias("role"),
        F.unhex(F.sha2(text, 256)).alias("text_digest"),
        F.substring(F.unhex(F.sha2(whole, 256)), 1, 16).alias("turn_digest"),
        F.octet_length(text).cast("long").alias("text_bytes"),
        (F.crc32(F.encode(conv.cast("string"), "UTF-8")) % BORROWED).cast("int").alias("borrowed"),
    )


def chained(parent: bytes, turn: bytes) -> bytes:
    return hashlib.blake2b(parent + turn, digest_size=16).digest()


class _Family:
    """The small trie of one family: node -> [parent, depth, text_bytes, members, ends], all in the order of arrival."""

    def __init__(self):
        self.nodes: dict[bytes, list] = {}

    def visit(self, node: bytes, parent: bytes | None, depth: int, size: int, conv: int) -> None:
        own = self.nodes.get(node)
        if own is None:
            own = self.nodes[node] = [parent, depth, size, [], []]
        own[3].append(conv)

    def end(self, node: bytes, conv: int) -> None:
        self.nodes[node][4].append(conv)

    def rows(self) -> list[tuple]:
        out = [(node, *own) for node, own in self.nodes.items()]
        self.nodes = {}
        return out


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows (base, conv_id, turn_digest, text_bytes, borrowed) in order, the base first: each family's nodes."""
    schema = pa.schema([("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("text_bytes", pa.int64()), ("members", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])
    family, base, conv, out = _Family(), None, None, []
    head: list[tuple[bytes, bytes, int]] = []  # node, parent, text_bytes of the base's first turns
    node, depth, own = ROOT, 0, 0  # where the present conversation stands, and how many of its rows have passed

    def close() -> None:
        nonlocal out
        if conv is None:
            return
        if own <= borrowed:  # nothing of its own: it ends with what it borrowed
            start()
        family.end(node, conv)
        if len(family.nodes) >= FAMILY_NODES:
            out += family.rows()

    def start() -> None:
        """Walks over the borrowed turns."""
        nonlocal node, depth
        node, depth = ROOT, 0
        family.visit(ROOT, None, 0, 0, conv)
        for node, parent, size in head[:borrowed]:
            depth += 1
            family.visit(node, parent, depth, size, conv)

    def emitted() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    borrowed = 0
    for batch in batches:
        for b, c, turn, size, h in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if c != conv or b != base:
                close()
                if b != base:
                    out += family.rows()
                    base, head = b, []
                conv, borrowed, own = c, h, 0
            if c == base and len(head) < BORROWED - 1:
                parent = head[-1][0] if head else ROOT
                head.append((chained(parent, turn), parent, size))
            own += 1
            if own == borrowed + 1:
                start()
            if own > borrowed:
                parent, node = node, chained(node, turn)
                depth += 1
                family.visit(node, parent, depth, size, conv)
                if len(family.nodes) >= FAMILY_NODES:  # the present conversation's node stays, for its end
                    last = family.nodes.pop(node)
                    out += family.rows()
                    family.nodes[node] = last
            if len(out) >= 10_000:
                yield emitted()
                out = []
    close()
    out += family.rows()
    for lo in range(0, len(out), 10_000):
        rest, out = out, out[lo : lo + 10_000]
        yield emitted()
        out = rest


def family_nodes(conversations: DataFrame) -> DataFrame:
    """Rows (node, parent, depth, text_bytes, members, ends), one or more for each node of each family."""
    order = ["base", "other", "conv_id", F.col("turn").asc_nulls_first(), "role", "text_digest"]
    rows = turn_rows(conversations).repartition("base").sortWithinPartitions(*order)
    return rows.select("base", "conv_id", "turn_digest", "text_bytes", "borrowed").mapInArrow(_rebuilt, _NODES)


def _ends_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each node, for rows (node, conv_id) in order; holds one hash state."""
    node, state, done = None, None, []
    for batch in batches:
        for n, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if n != node:
                if node is not None:
                    done.append((node, state.hexdigest()))
                node, state = n, hashlib.sha256(str(c).encode())
            else:
                state.update(b",%d" % c)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["node", "ends_sha256"])
            done = []
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], ["node", "ends_sha256"])


def trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie over all rebuilt conversations.

    Turns are ordered by (turn, role, SHA-256 of the text), a null turn first; repeated rows are turns each. A null role
    or text is an empty one; rows with a null conv_id take no part; texts of any length are hashed whole; an empty table
    gives no node; other columns are not read. Long conversations stream through one task, since a chain of digests is
    one by nature, and so do the ids of a node's ends, since a SHA-256 is. The written table of family nodes and two of
    node sums stay for the result.
    """
    scratch = Scratch(conversations.sparkSession, "trie")
    parts = scratch.keep(family_nodes(conversations))
    nodes = parts.groupBy("node").agg(
        F.min(F.array_min("members")).alias("conv_id"),
        F.sum(F.size("members").cast("long")).alias("n_convs"),
        F.first("parent").alias("parent"),
        F.first("depth").alias("depth"),
        F.first("text_bytes").alias("text_bytes"),
    )
    nodes = scratch.keep(nodes)
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    ends = parts.select("node", F.explode("ends").alias("conv_id"))
    ends = ends.repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(_ends_digest, "node binary, ends_sha256 string")
    known = nodes.join(children, "node", "left").join(ends, "node", "left")
    known = known.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    known = known.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("text_bytes"))
    # what a conversation's own nodes add up to below each of them
    below = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    known = scratch.keep(known.withColumn("leaves_below", F.sum("leaf").over(below)).withColumn("saved_below", F.sum("saved").over(below)))
    totals = known.groupBy(F.col("conv_id").alias("member")).agg(
        F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"), F.min("depth").alias("own_from")
    )
    shared = parts.select("node", "depth", F.explode("members").alias("member")).join(totals, "member").where("depth < own_from")
    others = shared.groupBy("node").agg(F.sum("leaves").alias("leaves_others"), F.sum("saved").alias("saved_others"))
    ids = known.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    zero = F.lit(0).cast("long")
    return (
        known.join(others, "node", "left")
        .join(ids, "parent", "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            (F.col("leaves_below") + F.coalesce("leaves_others", zero)).alias("n_leaves"),
            (F.col("saved_below") + F.coalesce("saved_others", zero)).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        )
    )
