"""Toxicity by maximum-scoring segments over token log-odds.

Training counts, for every word and each of its prefixes, the toxic and clean training documents that hold it. A token's
log-odds come from a chain of Dirichlet (here two-class) priors: a word's toxic share is shrunk to that of its longest
prefix, that one to the next shorter, down to the share of all training documents, so inflected forms that were never
seen borrow from their stem. A text is scanned once, in linear time, for all maximal-scoring segments (W. Ruzzo and
M. Tompa, 1999). Under random clean text a best segment follows an extreme-value law (S. Karlin and S. Altschul, 1990):
the scores of a text's best segments become one log P-value (S. Karlin and S. Altschul, 1993), which a logistic
regression on the same training documents, each document's own counts left out, turns into a probability.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import free_names, words_of

#: At most about this many labelled documents train the model, chosen by a hash of their ids; all are used where there
#: are fewer. This bounds the vocabulary that is gathered and sent to the executors.
TRAIN_DOCS = 12_000
#: Prefixes and words of fewer training documents are not kept.
LEAST_DOCS = 2
#: A word's prefixes of these lengths (in UTF-8 bytes) are its priors; the word itself comes last.
PREFIXES = (4, 5, 6, 7, 8, 10)
#: How many documents the prior of each level counts for, and how far scores drift down a token.
STRENGTH, DRIFT = 10.0, 1.3
#: Segments below this score are not considered.
LEAST_SEGMENT = 0.5
_FLUSH = 400_000
#: Words whose scores a worker keeps; beyond it the memory is emptied.
_MEMO = 120_000


def features(word: bytes) -> list[bytes]:
    """The prefixes of a word, shortest first, and the word with an end mark."""
    return [word[:n] for n in PREFIXES if len(word) > n] + [word + b"$"]


@dataclass
class Model:
    """Counts by feature, the base rate and the fitted weights; small enough to send to every executor."""

    toxic: int
    clean: int
    counts: dict[bytes, tuple[int, int]]
    lam: float = 1.0
    log_k: float = -3.0
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)
    memo: dict = field(default_factory=dict, repr=False)

    def token(self, word: bytes, own: int | None = None) -> float:
        """Log-odds of a word less the drift; own is the label of a training document whose counts are left out."""
        nt, nc = self.toxic - (own == 1), self.clean - (own == 0)
        rate = max(nt, 0.5) / max(nt + nc, 1)
        base = p = min(max(rate, 1e-4), 1 - 1e-4)
        for x in features(word):
            if not (got := self.counts.get(x)):
                continue
            a, b = got[0] - (own == 1), got[1] - (own == 0)
            p = (max(a, 0) + STRENGTH * p) / (max(a, 0) + max(b, 0) + STRENGTH)
        return math.log(p / (1 - p)) - math.log(base / (1 - base)) - DRIFT

    def scores(self, words: list[bytes], own: int | None = None) -> np.ndarray:
        memo = self.memo.setdefault(own, {})
        if len(memo) > _MEMO:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = self.token(w, own)
        return np.fromiter(map(memo.__getitem__, words), np.float64, len(words))

    def signal(self, scores: list[float], n_words: int) -> float:
        """Minus the log of the least P-value of a text's r best segments taken together, over all r (sum statistics)."""
        if not scores:
            return -3.0
        reach, total, best = self.log_k + math.log(n_words + 1), 0.0, -8.0
        for r, s in enumerate(sorted(scores, reverse=True), 1):
            gain = self.lam * s - reach
            total += gain
            best = max(best, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r) if total > r else total)
            if gain <= 0 and total <= r:  # the sum only falls from here, so no larger r is better
                break
        return min(best, 60.0)

    def probability(self, segments: list[tuple[float, int, int]], n_words: int) -> float:
        w = self.weights
        z = w[0] + w[1] * self.signal([x[0] for x in segments], n_words) + w[2] * math.log(n_words + 1)
        return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))


def segments(scores: np.ndarray, least: float = LEAST_SEGMENT) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, start, end) of at least the given score; end is exclusive.

    Runs of one sign are merged first, so the scan steps from one positive run to the next.
    """
    up = scores > 0
    if not up.any():
        return []
    edge = np.flatnonzero(np.diff(up.astype(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    total = np.concatenate(([0.0], np.cumsum(scores)))
    found: list[tuple[float, float, int, int]] = []  # total before and after, start, end
    for left, right, s, e in zip(total[starts].tolist(), total[ends].tolist(), starts.tolist(), ends.tolist(), strict=True):
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= left:
                j -= 1
            if j < 0 or found[j][1] >= right:
                found.append((left, right, s, e))
                break
            left, s = found[j][0], found[j][2]
            del found[j:]
    return [(r - x, s, e) for x, r, s, e in found if r - x >= least]


def _counted(rows: DataFrame) -> DataFrame:
    """From (text, toxic): rows (feature, a, b), the toxic and clean documents with it, summed per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = (Counter(), Counter())

        def out():
            keys = list(both[0].keys() | both[1].keys())
            a, b = ([c[k] for k in keys] for c in (both[1], both[0]))
            both[0].clear(), both[1].clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["feature", "a", "b"])

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                both[toxic].update({x for w in set(words_of(text)) for x in features(w)})
                if len(both[0]) + len(both[1]) > _FLUSH:
                    yield out()
        yield out()

    return rows.mapInArrow(run, "feature binary, a long, b long").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _karlin_altschul(hist: dict[float, float]) -> float:
    """The positive root of the mean of exp(lambda * score) = 1 over clean tokens."""
    x, p = np.array(list(hist)), np.array(list(hist.values()))
    p = p / p.sum() if len(p) else p
    if not len(x) or x.max() <= 0 or (x * p).sum() >= 0:
        return 1.0
    lo, hi = 1e-3, 20.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (p * np.exp(np.minimum(mid * x, 600))).sum() < 1 else (lo, mid)
    return min(max(lo, 0.05), 5.0)


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Fits a model on the labelled documents; labels has doc_id and toxic, and rows with a null in either are left out.

    Of repeated labels of an id the largest counts. Documents that repeat an id each count. Without both classes every
    score is the base rate.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    n = known.count()
    share = min(1.0, train_docs / max(n, 1))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("text", "toxic")
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    model = Model(totals.get(1, 0), totals.get(0, 0), {})
    if not model.toxic or not model.clean:
        share = model.toxic / max(model.toxic + model.clean, 1)
        model.weights = (math.log((share + 1e-3) / (1 - share + 1e-3)), 0.0, 0.0)
        return model
    kept = _counted(rows).where(F.col("a") + F.col("b") >= LEAST_DOCS).toArrow()
    for part in kept.to_batches(100_000):
        model.counts.update((f, (x, y)) for f, x, y in zip(*(c.to_pylist() for c in part.columns), strict=True))
    return _calibrate(rows, model)


def logistic(x: np.ndarray, y: np.ndarray, prior: float = 1e-2) -> np.ndarray:
    """Weights by Newton's method with backtracking; all but the first have a weak prior around zero."""
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], prior)
    ridge[0] = 1e-6

    def loss(w):
        z = x @ w
        return (np.logaddexp(0, z) - y * z).sum() + (ridge * w * w).sum() / 2

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), grad)
        t, now = 1.0, loss(w)
        while t > 1e-6 and loss(w - t * move) > now - 1e-4 * t * (grad @ move):
            t /= 2
        if t <= 1e-6 or t * np.abs(move).max() < 1e-8:
            break
        w = w - t * move
    return w


def _calibrate(rows: DataFrame, model: Model) -> Model:
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            out = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                s = model.scores(words, toxic)
                hist = Counter(np.round(s, 1).tolist()) if not toxic else {}
                out.append((toxic, len(words), [x[0] for x in segments(s)], list(hist), list(hist.values())))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["toxic", "n", "found", "x", "c"])
        model.memo.clear()

    seen = rows.mapInArrow(run, "toxic int, n long, found array<double>, x array<double>, c array<long>").persist()
    pairs = seen.select(F.explode(F.arrays_zip("x", "c")).alias("z")).groupBy("z.x").agg(F.sum("z.c").alias("c"))
    model.lam = _karlin_altschul({r["x"]: r["c"] for r in pairs.collect()})
    each = seen.select("toxic", "n", F.coalesce(F.array_max("found"), F.lit(0.0)).alias("best")).toArrow().to_pydict()
    # K from the median of the clean documents' best segments: lambda * S - log(K n) has median -log(log 2)
    clean = [model.lam * b - math.log(n + 1) for y, n, b in zip(each["toxic"], each["n"], each["best"], strict=True) if n and not y]
    model.log_k = (float(np.median(clean)) if clean else -3.0) + math.log(math.log(2))
    fitted = Model(0, 0, {}, model.lam, model.log_k)

    def signals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [fitted.signal(f, n) for f, n in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.float64())], ["toxic", "n", "signal"])

    each = seen.select("toxic", "n", "found").mapInArrow(signals, "toxic int, n long, signal double").toArrow().to_pydict()
    seen.unpersist()
    sent.unpersist()
    design = [(1.0, x, math.log(n + 1)) for n, x in zip(each["n"], each["signal"], strict=True)]
    model.weights = tuple(logistic(np.array(design), np.array(each["toxic"], float)).tolist())
    model.memo = {}
    return model


COLUMNS = ("score", "predicted", "passages")


def score(docs: DataFrame, model: Model, threshold: float = 0.7, names: tuple[str, str, str] = COLUMNS) -> DataFrame:
    """Adds score, predicted and passages (start word, end word, score of each significant segment) to all columns of docs.

    names are those of the three new columns; columns of docs with these names are replaced. A null or empty text has no
    passage and the lowest score. Texts of any length are scanned whole; repeated rows stay and score alike, ids are not
    read, and an empty table gives no row.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    taken = {n.lower() for n in names}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            scores, passages = [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                words = words_of(text)
                found = segments(model.scores(words)) if words else []
                scores.append(model.probability(found, len(words)))
                reach = model.log_k + math.log(len(words) + 1)
                passages.append([{"start": s, "end": e, "score": x} for x, s, e in found if model.lam * x > reach])
            p = np.array(scores)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            extra = [pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(passages, kind)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *extra], names=[*batch.schema.names[:-1], *names])
        model.memo.clear()

    rows = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken), F.col("text").alias(free_names(docs.columns, ("__scanned",))[0]))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    more = "`{}` double, `{}` int, `{}` array<struct<start: long, end: long, score: double>>".format(*names)
    return rows.mapInArrow(run, f"{fields}, {more}" if fields else more)
