"""Hard negatives, the conversation trie and the n-gram join against brute force, with awkward rows and small limits."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import hardneg, ngramjoin, queries, triemerge
from quern.llm.common import Scratch


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_prefix_trie", "op13_ngram_join"])
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df, want = queries.QUERIES[name](spark, sf_dir), con.sql(queries.ORACLES[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    got = sorted(tuple(r[c] for c in order) for r in df.collect())
    at = [want.columns.index(c) for c in order]
    assert got == sorted(tuple(r[i] for i in at) for r in want.fetchall()) and got


def mined(rows, k=5):
    """The rule in plain loops: rows (id, label, vec, anchor)."""
    def score(x, y):
        return sum(a * b for a, b in zip(x, y, strict=False))

    out = []
    for i, label, x, anchor in rows:
        if anchor:
            pos = sorted((-score(x, y), j) for j, m, y, _ in rows if m == label and j != i)[:k]
            for s, j in pos:
                neg = sorted((-score(x, y), n) for n, m, y, _ in rows if m != label and 80 * -s <= 100 * score(x, y) <= 100 * -s)[:k]
                out += [(i, j, rank, n, -s, -t) for rank, (t, n) in enumerate(neg, 1)]
    return sorted(out)


def test_mine_brute(spark, monkeypatch):
    """Clusters, a vector that a third of all rows share, ties, ragged and empty vectors; pages of a few rows."""
    rng = random.Random(3)
    centers = [[rng.randint(-90, 90) for _ in range(6)] for _ in range(5)]
    rows = []
    for i in range(400):
        c = centers[i % 5]
        v = centers[0] if i % 3 == 0 else [x + rng.randint(-9, 9) for x in c][: rng.choice([6, 6, 6, 4])]
        rows.append((i, rng.randint(0, 3), v, i % 20 == 0))
    rows += [(1001, 1, [], False), (1002, 2, [0] * 6, True), (1003, 9, centers[1], True)]
    df = spark.createDataFrame(rows, "id long, label long, vec array<long>, anchor boolean").withColumn("leaf", F.lit("clash"))
    want = mined(rows)
    assert rows_of(hardneg.mine(df)) == want and want
    for name, value in (("PAGE_BYTES", 48), ("GROUP", 3), ("CHUNK", 4), ("AT_ONCE", 8)):
        monkeypatch.setattr(hardneg, name, value)
    assert rows_of(hardneg.mine(df, most_levels=5)) == want


def test_intervals_prune(spark):
    """A far cluster is dropped as a whole, by its interval alone."""
    near = [(i, i % 2, [900 + i % 7, 10 - i % 5], i % 50 == 0) for i in range(300)]
    far = [(1000 + i, i % 2, [-900 - i % 7, i % 5], False) for i in range(300)]
    df = spark.createDataFrame(near + far, "id long, label long, vec array<long>, anchor boolean")
    scratch = Scratch(spark, "test-hardneg")
    search = hardneg._Search(df, scratch, 10_000, 4)
    want = search.groups.select("gid", F.lit(1e5).alias("least"), F.lit(float("inf")).alias("most"))
    met = search.pairs(want, True).select("page").distinct().count()
    assert 0 < met < search.pages.count()
    assert rows_of(hardneg.mine(df)) == mined(near + far)


def test_mine_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 1, [0.5]), (2, 1, [nan]), (3, 1, [inf]), (4, None, [0.5]), (5, 1, None), (None, 1, [0.5]), (6, 1, [None]), (7, 2, [-0.001]), (0, 1, [0.25])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    assert rows_of(hardneg.integer_rows(df)) == [(0, 1, [64]), (1, 1, [128]), (7, 2, [-1])]
    none = hardneg.integer_rows(df.where("false")).withColumn("anchor", F.lit(True))
    assert rows_of(hardneg.mine(none)) == []
    twice = spark.createDataFrame([(0, 1, [9], True), (0, 1, [9], True), (1, 1, [9], False), (2, 2, [8], False), (2, 2, [8], False)], "id long, label long, vec array<long>, anchor boolean")
    assert rows_of(hardneg.mine(twice)) == sorted(2 * [(0, 1, 1, 2, 81, 72), (0, 1, 2, 2, 81, 72)])
    with pytest.raises(Exception, match="64 bits"):
        big = spark.createDataFrame([(0, 1, [2**62], True), (1, 1, [2**62], False)], "id long, label long, vec array<long>, anchor boolean")
        hardneg.mine(big).collect()


def trie_brute(rows):
    turns, sha = defaultdict(list), lambda t: hashlib.sha256(t.encode()).digest()
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", sha(text or ""), text or ""))
    said = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in turns.items()}
    paths = {}
    for c in said:
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c >= 0 else -1)
        paths[c] = tuple(said.get(base, [])[:h] + said[c][h:])
    members = defaultdict(set)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].add(c)
    kids = defaultdict(list)
    for n in members:
        if n:
            kids[n[:-1]].append(n)
    out = []
    for n, who in members.items():
        below = [m for m in members if m[: len(n)] == n]
        saved = sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in below if m)
        ends = ",".join(map(str, sorted(c for c in who if paths[c] == n)))
        out.append((min(who), len(n), min(members[n[:-1]]) if n else None, len(who), len(kids[n]), sum(not kids[m] for m in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def test_trie_brute(spark, monkeypatch):
    rng, rows = random.Random(5), []
    for c in [*range(-12, 60), 105, 107, 1000]:
        for turn in range(rng.randint(1, 12)):
            rows.append((c, turn, rng.choice(["user", None, "assistant"]), rng.choice(["", "é", "hi", None, "x" * 70])))
    rows += [(7, None, "user", "first"), (7, 3, "user", "tie"), (7, 3, "user", "tie"), (None, 0, "user", "nobody")]
    rows += [(201 + 5 * i, t, "user", f"same {t}") for i in range(40) for t in range(10)]  # a conversation that is common
    rows += [(501, t, "user", "long " * (t % 3)) for t in range(600)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("clash"))
    want = trie_brute(rows)
    got = lambda: sorted((tuple(r) for r in triemerge.trie(df).collect()), key=str)
    assert got() == want
    monkeypatch.setattr(triemerge, "FAMILY_NODES", 20)  # families emitted in parts
    assert got() == want
    assert triemerge.trie(df.where("false")).collect() == []


def joined(rows, k=3, percent=90):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    low = {r: min((d for d in ds if d is not None), default=None) for r, ds in least.items()}
    return sorted(((d, len(s), low[find(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def copies(rng, n, words, edits):
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(words)]
    for _ in range(n):
        own = list(base)
        for at in rng.sample(range(words), rng.randint(0, edits)):
            own[at] = f"e{rng.randint(0, 10**6)}"
        yield " ".join(own)


def test_join_brute(spark):
    """Groups of near copies, a passage that unlike texts share, exact copies; buckets, parts, blocks and tiles."""
    rng = random.Random(11)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [t for n, words, edits in ((90, 120, 5), (60, 40, 2), (5, 300, 12), (30, 9, 1)) for t in copies(rng, n, words, edits)]
    texts += [f"{passage} " + " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(1, 30))) for _ in range(80)]
    texts += 40 * ["the same words again and again"] + [None, "", " ", "a", "A", "a b", "a  B", "a b c", "x " * 3000, "\x1c \x85 é"]
    rows = list(enumerate(texts)) + [(3, texts[3]), (3, "another text of one id"), (None, texts[95]), (None, "no id"), (None, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("n", F.lit(1))
    want = joined(rows)
    for small, block in ((32, 2000), (4, 2000), (3, 25)):
        got = ngramjoin.similar_documents(df, small=small, block=block).collect()
        assert sorted((tuple(r) for r in got), key=str) == want, (small, block)
    assert ngramjoin.similar_documents(df.where("false")).collect() == []


def test_prefixes_meet_under_every_order():
    rng = np.random.default_rng(2)
    sketch = rng.integers(0, 50, ngramjoin.DEPTH * ngramjoin.WIDTH)
    for _ in range(200):
        n = int(rng.integers(1, 80))
        a = rng.integers(0, 1 << 60, n).astype(np.uint64)
        gone = int(rng.integers(0, max(1, n // 10) + 1))
        b = np.unique(np.concatenate([a[gone:], rng.integers(0, 1 << 60, int(rng.integers(0, 4))).astype(np.uint64)]))
        a = np.unique(a)
        common = len(np.intersect1d(a, b))
        if len(b) and 100 * common >= 90 * (len(a) + len(b) - common):
            for x, y in zip(ngramjoin.prefixes(a, sketch, 90), ngramjoin.prefixes(b, sketch, 90), strict=True):
                assert set(x.tolist()) & set(y.tolist())
