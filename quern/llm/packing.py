"""Hierarchical multi-length packing of tokenised documents.

A task packs the documents of its own partition, a bounded buffer at a time, so nothing is shuffled. Each document is
cut into full windows of the largest tier and one rest; the rest is routed to the smallest tier that holds it. Each tier
is packed best-fit-decreasing into windows of its own size, rests of shorter tiers fill what stays free in longer
windows, and what still gapes is closed by cutting a rest. Sequences are dealt to step groups in a snake order of their
length, so that the groups of a buffer have about the same number of tokens.
"""

from __future__ import annotations

import bisect
import os
import re
import struct
import unicodedata
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Window sizes, powers of two.
TIERS = (2048, 1024, 512, 256)
#: Tokens of a buffer (a longer document is a buffer of its own), and sequences of a step group.
BUFFER_TOKENS, GROUP = 2_000_000, 16
#: The end-of-document id.
END_ID = 1
#: Chunks and runs whose ids a worker keeps; beyond it a memory is emptied, so both stay bounded.
MEMO_CHUNKS, MEMO_RUNS = 400_000, 250_000
_RUNS = re.compile(r"[^\W_]+|[\W_]+")
_KEPT_WHOLE = re.compile(r"['\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_TOKENIZERS: dict[str, WordTokenizer] = {}


def _byte_chars() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if visible, else the next from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in shown else next(rest)) for b in range(256)}


class _Memo(dict):
    """Makes the value of a key that is asked for the first time."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


class WordTokenizer:
    """Ids of a vocabulary file of ``tokenizers`` whose pieces never cross ASCII white space.

    That holds for a pre-tokenizer that drops white space, with a normalizer that keeps it apart. Texts are split at
    ASCII white space, and each distinct chunk is encoded once. With ``split_runs``, for a byte-level vocabulary, a chunk's runs of
    letters and digits are also encoded apart from what stands between them, as the pre-tokenizer must do; chunks with an
    apostrophe (contractions), a control character, decomposed or unknown letters are left whole. Texts with a special token's
    string go through the tokenizer as a whole.
    """

    def __init__(self, path: str, split_runs: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.special = [t.content for t in self.inner.get_added_tokens_decoder().values()]
        self.normalize, self.model, self.as_chars = self.inner.normalizer.normalize_str, self.inner.model, _byte_chars()
        self.pieces, self.chunks = _Memo(self._piece), _Memo(self._chunk if split_runs else lambda c: self._whole(c.decode("utf-8")))

    def _whole(self, text: str) -> bytes:
        ids = self.inner.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, text: str) -> bytes:
        """A word of letters alone is one pre-token: its bytes, as the characters that stand for them, go to the model."""
        if text.isalpha() and (word := text.lower() if text.isascii() else self.normalize(text)).isalpha():
            ids = [t.id for t in self.model.tokenize(word.encode("utf-8").decode("latin-1").translate(self.as_chars))]
            return struct.pack(f"<{len(ids)}I", *ids)
        return self._whole(text)

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8")
        if text.isascii():
            text = text.lower()
        elif not unicodedata.is_normalized("NFC", text) or max(text) > "\u024f" and any(unicodedata.category(c) == "Cn" for c in text):
            return self._whole(text)  # what this Python's tables don't know may be a letter in the tokenizer's
        if _KEPT_WHOLE.search(text):
            return self._whole(text)
        return b"".join(map(self.pieces.__getitem__, _RUNS.findall(text)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        for memo, most in ((self.pieces, MEMO_RUNS), (self.chunks, MEMO_CHUNKS)):
            if len(memo) > most:
                memo.clear()
        get = self.chunks.__getitem__
        return [self._whole(t) if any(s in t for s in self.special) else b"".join(map(get, t.encode("utf-8").split())) for t in texts]


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each worker and file."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def pack(sizes: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences (tier, pieces), a piece being (document, start, length), that hold every token of every document once.

    Full windows come first, in document order. At most one sequence of a call is not filled to a tier's size.
    """
    top = tiers[0]
    out: list[tuple[int, list[tuple[int, int, int]]]] = []
    rests: list[tuple[int, int, int]] = []  # length, document, start
    for d, n in enumerate(sizes):
        full = n - n % top
        out += [(top, [(d, s, top)]) for s in range(0, full, top)]
        if n > full:
            rests.append((n - full, d, full))
    # route each rest to the smallest tier that holds it; shortest first, so that the longest are taken from the end
    by_tier = {t: sorted(r for r in rests if r[0] <= t and (t == tiers[-1] or r[0] > t // 2)) for t in tiers}
    for k, tier in enumerate(tiers):
        short = [by_tier[t] for t in tiers[k:]]  # this tier, then the shorter ones, whose rests fill its gaps
        while sum(map(len, short)):
            pieces, free = [], tier
            while free:
                fit = None
                for queue in short:  # the longest rest that fits, from the longest tier that has one
                    i = bisect.bisect_right(queue, (free, 1 << 62, 0)) - 1
                    if i >= 0:
                        fit = queue.pop(i)
                        break
                if fit is None:  # nothing fits whole: cut the shortest of the longer rests
                    queue = next((q for q in reversed(short) if q), None)
                    if queue is None:
                        break
                    n, d, s = queue.pop(0)
                    pieces.append((d, s, free))
                    n, s, free = n - free, s + free, 0
                    home = next(q for t, q in zip(tiers[k:], short, strict=True) if n <= t and (t == tiers[-1] or n > t // 2))
                    bisect.insort(home, (n, d, s))
                else:
                    pieces.append((fit[1], fit[2], fit[0]))
                    free -= fit[0]
            if free and k + 1 < len(tiers):  # too little is left for this tier: the shorter tiers take it
                for d, s, n in pieces:
                    while n:
                        cut = min(n, tiers[k + 1])
                        home = next(t for t in reversed(tiers) if cut <= t)
                        bisect.insort(by_tier[home], (cut, d, s))
                        n, s = n - cut, s + cut
                break
            out.append((tier, pieces))
    return out


def step_groups(lengths: list[int], group: int = GROUP) -> list[int]:
    """A group for each sequence, dealt in a snake order from long to short, so that group totals are about equal."""
    n = max(1, -(-len(lengths) // group))
    out = [0] * len(lengths)
    for i, k in enumerate(sorted(range(len(lengths)), key=lambda k: -lengths[k])):
        lap, at = divmod(i, n)
        out[k] = n - 1 - at if lap % 2 else at
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def packed(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, buffer_tokens: int = BUFFER_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row per piece; with_ids adds the piece's ids as array<int>.

    A null text is empty and has the end id alone. Repeated rows are packed each on their own; a null id is carried. At
    most one sequence of a task's buffer is shorter than its tier. Only the id and the text of docs are read. A retried
    task gives the same rows: sequence ids hold the partition's number and a counter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        next_id = TaskContext.get().partitionId() << 36
        next_group = next_id
        tok = tokenizer(tokenizer_path)
        end = np.array([END_ID], "<u4").tobytes()
        held: deque[tuple] = deque()
        size = 0

        def solve():
            nonlocal next_id, next_group
            sequences = pack([len(x) // 4 for _, x in held], tiers)
            groups = step_groups([sum(p[2] for p in pieces) for _, pieces in sequences])
            cols: list[list] = [[] for _ in range(9)]
            ids = []
            for (tier, pieces), group in zip(sequences, groups, strict=True):
                offset = 0
                for d, s, n in pieces:
                    raw = held[d][1][4 * s : 4 * (s + n)]
                    for c, v in zip(cols, (held[d][0], s, n, zlib.crc32(raw), len(held[d][1]) // 4, next_id, offset, tier, next_group + group), strict=True):
                        c.append(v)
                    if with_ids:
                        ids.append(np.frombuffer(raw, "<u4").astype(np.int32))
                    offset += n
                next_id += 1
            next_group += max(groups, default=-1) + 1
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            for lo in range(0, len(cols[0]), 10_000):
                arrays = [pa.array(c[lo : lo + 10_000], k) for c, k in zip(cols, kinds, strict=True)]
                if with_ids:
                    arrays.append(pa.array(ids[lo : lo + 10_000], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for key, ids in zip(part.column(0).to_pylist(), tok.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    n = len(ids) // 4 + 1
                    if held and size + n > buffer_tokens:
                        yield from solve()
                        held.clear()
                        size = 0
                    held.append((key, ids + end))
                    size += n
        if held:
            yield from solve()

    schema = PIECES + (", ids array<int>" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, schema)
