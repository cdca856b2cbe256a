"""Benchmark decontamination with an FM-index over each training shard.

A task gathers documents into shards of a bounded number of words and builds for each an FM-index over word codes:
suffix order by prefix doubling, the Burrows-Wheeler transform in a wavelet matrix, and suffix positions sampled along
the text. All windows of a benchmark block are searched backwards at once, their occurrences located by stepping to the
nearest sampled position, and the spans of a document merged.

The benchmark is cut into blocks of bounded size, files in the shared folder. A task holds one block at a time and one
index, which is built once per shard and serves all blocks.
"""

from __future__ import annotations

import pickle
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Folder, free_names, scratch_path, words_of

#: Words of a window; a shorter item is one window.
WINDOW = 13
#: Words of a shard (a longer document is a shard of its own) and the distance of sampled suffix positions.
SHARD_WORDS, SAMPLE = 500_000, 8
#: Benchmark text of a block, in bytes (a longer item is a block of its own); about ten times that is held in memory.
BLOCK_BYTES = 2 << 20
#: Blocks that a task writes, about, so that few of them are not full.
TASK_BLOCKS = 8
COLUMNS = ("n_words", "spans", "item_ids")


def suffix_order(codes: np.ndarray, distinct: int) -> np.ndarray:
    """Order of all suffixes by prefix doubling; only suffixes that are still tied are sorted again.

    The codes below the number of documents are the documents' ends, each its own, so no tie outlasts a document.
    """
    n = len(codes)
    bits = max(1, int(distinct).bit_length())
    width = max(1, 63 // bits)
    key = codes.astype(np.int64)
    for j in range(1, width):
        nxt = np.zeros(n, np.int64)
        nxt[: max(0, n - j)] = codes[j:]
        key = (key << bits) | nxt
    order = np.argsort(key)
    own = key[order]
    new = np.ones(n, bool)
    new[1:] = own[1:] != own[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    h = width
    tied = np.ones(n, bool)
    tied[:] = ~new
    tied[:-1] |= ~new[1:]
    slots = np.flatnonzero(tied)
    while len(slots):
        at = order[slots]
        group = rank[at]
        key = (group << 32) | np.where(at + h < n, rank[np.minimum(at + h, n - 1)] + 1, 0)
        again = np.argsort(key, kind="stable")
        at, key = at[again], key[again]
        order[slots] = at
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.maximum.accumulate(np.where(new, slots, 0))
        rank[at] = first
        left = ~new
        left[:-1] |= ~new[1:]
        slots, h = slots[left], h * 2
    return order


class Bits:
    """A bit vector with rank in constant time: packed words and the ones before each of them."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        packed = np.concatenate((packed, np.zeros(16 - len(packed) % 8, np.uint8)))
        self.words = packed.view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        w, k = i >> 6, (i & 63).astype(np.uint64)
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << k) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class FMIndex:
    """Self-index of documents of word codes 1..; codes and document starts are given, ends are added here."""

    def __init__(self, docs: list[np.ndarray], n_codes: int, sample: int = SAMPLE):
        k = len(docs)
        sizes = np.array([len(d) + 1 for d in docs], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        n = int(self.starts[-1])
        text = np.empty(n, np.int64)  # ends are 0..k-1, word codes follow
        within = np.arange(n) - np.repeat(self.starts[:-1], sizes)
        ends = self.starts[1:] - 1
        body = np.ones(n, bool)
        body[ends] = False
        text[ends] = np.arange(k)
        if n > k:
            text[body] = np.concatenate(docs) + (k - 1)
        order = suffix_order(text, n_codes + k)
        flat = np.where(body, text - (k - 1), 0)
        counts = np.bincount(flat, minlength=n_codes + 1)
        self.before = np.concatenate(([0], np.cumsum(counts)))
        bwt = flat[order - 1]  # the symbol before a document's first word is an end, which no search crosses
        self.levels = max(1, int(n_codes).bit_length())
        self.bits, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            one = (bwt >> level & 1).astype(bool)
            self.bits.append(Bits(one))
            self.zeros.append(int(n - one.sum()))
            bwt = np.concatenate((bwt[~one], bwt[one]))
        marked = (within % sample == 0)[order]
        self.marked, self.sampled = Bits(marked), order[marked]
        self.n = n

    def rank(self, code: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each code among the first i symbols of the transform."""
        lo, hi = np.zeros_like(i), i
        for bits, zeros, level in zip(self.bits, self.zeros, range(self.levels - 1, -1, -1), strict=True):
            one = (code >> level & 1).astype(bool)
            a, b = bits.rank(lo), bits.rank(hi)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return hi - lo

    def step(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix that is one word longer."""
        code, lo, hi = np.zeros_like(row), np.zeros_like(row), row
        for bits, zeros in zip(self.bits, self.zeros, strict=True):
            one = bits.get(hi).astype(bool)
            a, b = bits.rank(lo), bits.rank(hi)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
            code = code << 1 | one
        return self.before[code] + hi - lo

    def search(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of the suffixes that begin with each phrase; phrases are right-aligned rows of codes."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for back in range(1, phrases.shape[1] + 1):
            live = live[(sizes[live] >= back) & (lo[live] < hi[live])]
            if not len(live):
                break
            code = phrases[live, -back]
            both = self.rank(np.concatenate((code, code)), np.concatenate((lo[live], hi[live])))
            at = self.before[code]
            lo[live], hi[live] = at + both[: len(live)], at + both[len(live) :]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row, by steps back to the nearest sampled position."""
        out, at, steps = np.empty(len(rows), np.int64), rows.copy(), 0
        left = np.arange(len(rows))
        while len(left):
            done = self.marked.get(at[left]).astype(bool)
            hit = left[done]
            out[hit] = self.sampled[self.marked.rank(at[hit])] + steps
            left = left[~done]
            at[left] = self.step(at[left])
            steps += 1
        return out


class Block:
    """The distinct windows of some (id, text) items, as rows of word numbers (right-aligned, -1 before a shorter one), and
    the items that hold each."""

    def __init__(self, items: list[tuple], size: int = WINDOW):
        self.names = [x[0] for x in items]
        numbers: dict[bytes, int] = defaultdict(lambda: len(numbers))
        rows, owners = [np.zeros((0, size), np.int32)], [np.zeros(0, np.int64)]
        for k, (_, text) in enumerate(items):
            codes = np.array([numbers[w] for w in words_of(text)], np.int32)
            if len(codes):
                codes = np.concatenate((np.full(max(0, size - len(codes)), -1, np.int32), codes))
                rows.append(np.lib.stride_tricks.sliding_window_view(codes, size))
                owners.append(np.full(len(rows[-1]), k))
        self.words = list(numbers)
        self.windows, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        pairs = np.unique(np.column_stack((which.ravel(), np.concatenate(owners))), axis=0)
        self.first, self.owners = np.searchsorted(pairs[:, 0], np.arange(len(self.windows) + 1)), pairs[:, 1]


class Shard:
    """Documents (lists of words) and their index, which is built when a block's words first ask for it."""

    def __init__(self, docs: list[list[bytes]]):
        self.codes: dict[bytes, int] = defaultdict(lambda: len(self.codes) + 1)
        self.texts = [np.fromiter(map(self.codes.__getitem__, d), np.int64, len(d)) for d in docs]
        self.codes.default_factory = None
        self.index: FMIndex | None = None

    def scan(self, block: Block) -> tuple[list[list[tuple[int, int]]], list[set[int]]]:
        """Merged hit spans and the items met, by number, of each document."""
        spans, items = [[] for _ in self.texts], [set() for _ in self.texts]
        own = np.array([*(self.codes.get(w, 0) for w in block.words), 0], np.int64)
        codes = own[block.windows]
        which = np.flatnonzero(((codes > 0) | (block.windows < 0)).all(axis=1)) if self.codes else ()
        if not len(which):
            return spans, items
        if self.index is None:
            self.index = FMIndex(self.texts, len(self.codes))
        index, sizes = self.index, (block.windows[which] >= 0).sum(axis=1)
        lo, hi = index.search(codes[which], sizes)
        times = np.maximum(hi - lo, 0)
        met = np.repeat(np.arange(len(which)), times)
        if not len(met):
            return spans, items
        first = np.concatenate(([0], np.cumsum(times)[:-1]))
        at = index.locate(np.arange(len(met)) - np.repeat(first, times) + np.repeat(lo, times))
        doc = np.searchsorted(index.starts, at, side="right") - 1
        start = at - index.starts[doc]
        order = np.lexsort((start, doc))
        for d, s, m in zip(doc[order].tolist(), start[order].tolist(), met[order].tolist(), strict=True):
            end = s + int(sizes[m])
            if spans[d] and s <= spans[d][-1][1]:
                spans[d][-1] = (spans[d][-1][0], max(end, spans[d][-1][1]))
            else:
                spans[d].append((s, end))
            k = which[m]
            items[d].update(block.owners[block.first[k] : block.first[k + 1]].tolist())
        return spans, items


def write_blocks(benchmark: DataFrame, folder: str, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> list[str]:
    """Writes the benchmark's windows as block files in one distributed pass and returns their names, all that the driver gets.

    Rows are dealt with a salt, so items that repeat don't meet in one task, and a task cuts what it is given into blocks as
    it reads. A file has a name of its own for each attempt, so only those of attempts that ended are ever read.
    """
    rows = benchmark.select(F.col("item_id").alias("id"), "text", F.monotonically_increasing_id().alias("salt")).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    tasks = max(1, -(-size // (block_bytes * TASK_BLOCKS)))
    Folder(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Folder(folder)
        for items in _cut(batches, block_bytes):
            name = uuid.uuid4().hex
            temporary, stream = out.write(name)
            with stream:
                stream.write(pickle.dumps(Block(items, window)))
            out.settle(temporary, name)
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    dealt = rows.repartition(tasks, "id", "salt").select("id", "text")
    return sorted(r["name"] for r in dealt.mapInArrow(write, "name string").collect())


def _cut(batches: Iterable[pa.RecordBatch], block_bytes: int) -> Iterator[list[tuple]]:
    """The (id, text) rows of batches in lists of at most block_bytes of text; a longer one is alone."""
    items, size = [], 0
    for batch in batches:
        for i, text in zip(*(batch.column(k) for k in range(2)), strict=True):
            own = len(text.as_buffer())
            if items and size + own > block_bytes:
                yield items
                items, size = [], 0
            items.append((i.as_py(), text.as_py()))
            size += own
    if items:
        yield items


_HELD: dict[tuple[str, str], Block] = {}


def _block(folder: str, name: str) -> Block:
    """A block; the worker keeps the last one, so that a benchmark of one block is read once."""
    if (folder, name) not in _HELD:
        _HELD.clear()
        with Folder(folder).read(name) as stream:
            _HELD[folder, name] = pickle.loads(stream.read())
    return _HELD[folder, name]


def _shards(batches: Iterable[pa.RecordBatch], shard_words: int) -> Iterator[tuple[list[pa.RecordBatch], list[list[bytes]]]]:
    """Batches (the text last) cut where their words fill a shard: parts of batches and the words of their documents."""
    held, docs, size = [], [], 0
    for batch in batches:
        begin, texts = 0, batch.column(batch.num_columns - 1)
        for i in range(batch.num_rows):
            words = words_of(texts[i].as_py())
            if docs and size + len(words) > shard_words:
                if i > begin:
                    held.append(batch.slice(begin, i - begin))
                yield held, docs
                held, docs, size, begin = [], [], 0, i
            docs.append(words)
            size += len(words)
        if begin < batch.num_rows:
            held.append(batch.slice(begin))
    if docs:
        yield held, docs


def matches(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES, names: tuple[str, str, str] = COLUMNS
) -> DataFrame:
    """All columns of docs with n_words, spans (merged hit spans of words) and item_ids (strings, sorted, distinct).

    names are those of the three new columns; columns of docs with these names are replaced. A null text has no words; an
    item without words has no window; an item with a null id is searched but not listed. Texts of any length are searched
    whole, the longest in a shard of its own; repeated rows stay and are each searched; an empty table gives no row. The
    files of the benchmark's blocks stay in the shared folder, as the result reads them.
    """
    taken = {n.lower() for n in names}
    rows = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken), F.col("text").alias(free_names(docs.columns, ("__scanned",))[0]))
    folder = scratch_path(docs.sparkSession, "benchmark")
    blocks = write_blocks(benchmark, folder, window, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, own in _shards(batches, shard_words):
            shard, spans, ids = Shard(own), [[] for _ in own], [set() for _ in own]
            for name in blocks:
                block = _block(folder, name)
                for k, (found, met) in enumerate(zip(*shard.scan(block), strict=True)):
                    spans[k] += found
                    ids[k] |= {str(block.names[i]) for i in met if block.names[i] is not None}
            at = 0
            for batch in held:
                part = slice(at, at + batch.num_rows)
                at += batch.num_rows
                merged = [merge(x) for x in spans[part]]
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                extra = [
                    pa.array([len(d) for d in own[part]], pa.int64()),
                    pa.array([[{"start": s, "end": e} for s, e in x] for x in merged], kind),
                    pa.array([sorted(x) for x in ids[part]], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *extra], names=[*batch.schema.names[:-1], *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    more = "`{}` long, `{}` array<struct<start: long, end: long>>, `{}` array<string>".format(*names)
    return rows.mapInArrow(run, f"{fields}, {more}" if fields else more)


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def n_hit(spans) -> F.Column:
    """Words inside merged spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def contaminated(spans, n_words) -> F.Column:
    """Some word is hit, and at least one in twenty."""
    return (n_hit(spans) > 0) & (20 * n_hit(spans) >= n_words)
