"""The operators against brute force on the smallest tables, round trips, and edge cases."""

import hashlib
import itertools
import math
import random
import re
import struct
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import chat, decontam, licences, mainhtml, media, packing, queries, simhash, toxicity, urlfilter, warc
from quern.llm.common import Scratch, components, scratch_path, words_of
from tests.llm import brute

LONG = "alpha beta gamma " * 30_000
#: Texts of every awkward kind, with ties and repeats; the frame adds null ids, repeated rows and a clashing column.
TEXTS = [None, "", " ", "a", "a b c d e f g h i j k l m n o p", "A B C d e f g h i j k l m n o p", "it's é 한국어 </s> \\ [INST]", "\x1c \x85 x", LONG]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "again"), (None, "no id", "n")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return queries.table(spark, sf_dir, "documents")


def local(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


# --- shared ------------------------------------------------------------------------------------------------------


@given(st.text(max_size=200))
def test_words(text):
    assert [w.decode() for w in words_of(text)] == brute.words(text)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(500 + i, 501 + i) for i in range(40)]
    got = dict(local(components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")), "node", "root"))
    at = {x: x for e in edges for x in e}
    for _ in at:
        for a, b in edges:
            at[a] = at[b] = min(at[a], at[b])
    for x, root in at.items():
        assert got.get(x, x) == root


# --- SimHash -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("radius", [4, 7])
def test_covering(radius):
    masks, rng = simhash.covering_masks(radius), random.Random(radius)
    for _ in range(3000):
        off = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(not off & m for m in masks)
    assert min(m.bit_count() for m in masks) >= 28


def test_op2_matches_brute_force(spark, sf_dir, docs):
    got = local(queries.op2_simhash(spark, sf_dir), "doc_id", "fingerprint", "component_id")
    fps = [(d, brute.simhash(t)) for d, t in local(docs, "doc_id", "text")]
    parts = brute.linked(fps)
    assert sorted(got) == sorted((d, f"{fp:016x}", parts[d]) for d, fp in fps)


def test_links_in_hot_buckets(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 8, dtype=np.uint64)
    words = {int(b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 7), False)))) for b in base for _ in range(60)}
    signed = [w - 2**64 if w >= 2**63 else w for w in words]
    rows = spark.createDataFrame([(w,) for w in signed], "fp long")
    want = brute.linked([(w, w % 2**64) for w in sorted(signed)])
    for hot in (5, 50_000):
        scratch = Scratch(spark, "t")
        got = dict(local(components(simhash.links(rows.withColumn("node", F.col("fp")), scratch, hot=hot), scratch), "node", "root"))
        assert {w: got.get(w, w) for w in signed} == want


def test_simhash_edges(spark, odd):
    got = local(simhash.near_duplicates(odd), "doc_id", "fp", "component_id")
    assert len(got) == odd.count()
    by = {d: (fp, c) for d, fp, c in got}
    assert by[0] == by[1] == by[2] == (0, 0) and by[4] == by[5] and by[5][1] == 4
    assert by[None][1] is None
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
    kept = local(simhash.distinct_documents(odd), "doc_id")
    assert sorted(k[0] for k in kept if k[0] is not None) == [0, 3, 4, 6, 7, 8] and (None,) in kept


def test_distinct_documents_removes_only_similar_ones(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(5000)}" for _ in range(400)]
    near = words[:]
    near[200] = "other"
    rows = [(i, " ".join(words)) for i in range(3)] + [(9, " ".join(near))] + [(20 + i, " ".join(rng.sample(words, 300))) for i in range(30)]
    kept = {r[0] for r in local(simhash.distinct_documents(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id")}
    assert kept == {0, *range(20, 50)}


def test_distinct_documents_compares_all_of_a_component(spark):
    """Near copies go also where neither is like the component's smallest id, in the rounds and after them."""
    rng, words = random.Random(5), [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(6):  # unlike texts of the same words, whose views are equal, and a near copy of each
        rng.shuffle(words)
        texts += [" ".join(words), " ".join([*words[:-1], "other"])]
    frame = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    assert len({tuple(simhash.word_views(t, 4)) for t in texts[::2]}) == 1
    assert {r[0] for r in local(simhash.distinct_documents(frame), "doc_id")} == {0, 2, 4, 6, 8, 10}


def test_distinct_documents_settles_a_component_block_by_block(spark):
    """One component of texts of the same words in other orders, near copies among them: as one loop over all does."""
    rng = random.Random(5)
    words, rows = [f"w{i}" for i in range(60)], []
    for i in range(60):
        if i % 3 == 2:  # a near copy, or one that is just too far, of an earlier text
            own = list(rows[rng.randrange(len(rows))][1].split())
            for _ in range(rng.choice([1, 2])):
                at = rng.randrange(59)
                own[at], own[at + 1] = own[at + 1], own[at]
        else:
            own = rng.sample(words, 60)
        rows.append((i, " ".join(own)))
    want, stay = [], []
    for i, text in rows:
        w = text.split()
        own = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        if all(len(own & x) < 0.8 * len(own | x) for x in stay):
            want.append(i)
            stay.append(own)
    assert 40 <= len(want) < 60
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (7, 1000):
        assert sorted(r[0] for r in local(simhash.distinct_documents(frame, block=block), "doc_id")) == want


def test_distinct_documents_compares_equal_fingerprints(spark):
    """Texts of the same words share all fingerprints; only equal and similar ones go."""
    rng, words = random.Random(6), [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.sample(words, 200)) for _ in range(6)]
    rows = [*enumerate(texts), (10, texts[4]), (11, texts[5][: texts[5].rindex(" ")] + " other"), (5, "another text with the id 5"), (5, texts[5])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(local(simhash.distinct_documents(frame), "doc_id")) == [(i,) for i in (0, 1, 2, 3, 4, 5, 5)]
    out = corpus_pipeline.drop_near_duplicates(spark, frame, "")
    assert out.columns == frame.columns and set(local(out, "doc_id", "text")) == {*enumerate(texts), (5, "another text with the id 5")} and out.count() == 7


# --- packing -----------------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 6000), max_size=60))
def test_pack(sizes):
    sequences = packing.pack(sizes)
    seen = sorted(p for _, pieces in sequences for p in pieces)
    at = dict.fromkeys(range(len(sizes)), 0)
    for d, s, n in seen:
        assert s == at[d] and n > 0
        at[d] += n
    assert at == dict(enumerate(sizes))
    totals = [(t, sum(p[2] for p in pieces)) for t, pieces in sequences]
    assert all(n <= t for t, n in totals) and sum(n < t for t, n in totals) <= 1


def test_op3(spark, sf_dir, docs):
    rows = local(queries.op3_packing(spark, sf_dir), "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    check_pieces(rows, dict(local(docs, "doc_id", "text")))


def check_pieces(rows, texts):
    tok = packing.tokenizer(queries.tokenizer_path()).inner
    by, sequences = {}, {}
    for d, s, n, crc, total, q, o in rows:
        by.setdefault(d, []).append((s, n, crc, total))
        sequences.setdefault(q, []).append((o, n))
    assert set(by) == set(texts)
    for d, pieces in by.items():
        ids, at = np.array([*tok.encode(texts[d] or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for s, n, crc, total in sorted(pieces):
            assert (s, total, crc) == (at, len(ids), zlib.crc32(ids[s : s + n].tobytes()))
            at += n
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048


def test_packing_edges(odd):
    frame = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    cols = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    check_pieces(local(packing.packed(frame, queries.tokenizer_path()), *cols), dict(enumerate(TEXTS)))
    assert packing.packed(odd, queries.tokenizer_path()).select("doc_id").distinct().count() == len(TEXTS) + 1
    assert packing.packed(odd.limit(0), queries.tokenizer_path()).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_tokenizer_is_exact(text):
    tok = packing.tokenizer(queries.tokenizer_path())
    for t in (text, f"it's {text}'S, İ J̌ <|endoftext|>"):
        ids = tok.inner.encode(t, add_special_tokens=False).ids
        assert tok.encode([t]) == [struct.pack(f"<{len(ids)}I", *ids)]


def test_step_groups():
    lengths = [2048] * 30 + [256] * 30
    groups = packing.step_groups(lengths, 10)
    totals = [sum(n for n, g in zip(lengths, groups, strict=True) if g == k) for k in range(6)]
    assert max(totals) - min(totals) <= 2048


# --- decontamination ---------------------------------------------------------------------------------------------


def test_op9(spark, sf_dir, docs):
    cols = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    got = {r[0]: r[1:] for r in local(queries.op9_decontamination(spark, sf_dir), "doc_id", *cols)}
    items = local(queries.table(spark, sf_dir, "benchmark"), "item_id", "text")
    assert got == brute.decontaminated(local(docs, "doc_id", "text"), items)
    assert any(r[-1] for r in got.values())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=40), min_size=1, max_size=8), st.lists(st.lists(st.sampled_from("abcz"), max_size=8), max_size=6))
def test_index_against_brute_force(texts, items):
    named = [(k, " ".join(x)) for k, x in enumerate(items)]
    spans, met = decontam.Shard([[w.encode() for w in t] for t in texts]).scan(decontam.Block(named, 4))
    want = brute.decontaminated([(k, " ".join(t)) for k, t in enumerate(texts)], named, 4)
    for k, (s, m) in enumerate(zip(spans, met, strict=True)):
        assert (sum(b - a for a, b in decontam.merge(s)), len(m)) == want[k][1:3]


def test_benchmark_blocks_in_one_pass(spark):
    items = spark.createDataFrame([(f"b{k}", f"one two {k} {'w' * (k % 7)}") for k in range(300)] + [("same", "an item that repeats")] * 300, "item_id string, text string")
    jobs, seen = {}, {}
    for size in (1 << 20, 200):
        spark.sparkContext.setJobGroup(f"blocks-{size}", "blocks")
        folder = scratch_path(spark, "blocks")
        names = decontam.write_blocks(items, folder, 4, size)
        jobs[size] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"blocks-{size}"))
        blocks = [decontam._block(folder, n) for n in names]
        seen[size] = len(blocks), {(n, tuple(b.words[w] for w in b.windows[k] if w >= 0)) for b in blocks for k in range(len(b.windows)) for n in (b.names[o] for o in b.owners[b.first[k] : b.first[k + 1]])}
    spark.sparkContext._jsc.sc().clearJobGroup()
    assert jobs[200] == jobs[1 << 20] and seen[1 << 20][0] == 1 and seen[200][0] > 40
    assert seen[200][1] == seen[1 << 20][1] and {n for n, _ in seen[200][1]} == {"same"} | {f"b{k}" for k in range(300)}
    assert decontam.write_blocks(items.limit(0), scratch_path(spark, "blocks")) == []
    long = pa.RecordBatch.from_pydict({"id": [1, 2, 3, 4], "text": ["ab", "c" * 9, "d", "e"]})
    assert [[i for i, _ in x] for x in decontam._cut([long], 4)] == [[1], [2], [3, 4]]


def test_decontamination_edges(spark, odd):
    items = spark.createDataFrame([(1, "C D e f"), (2, None), (3, ""), (None, "a"), (4, "alpha beta")], "item_id long, text string")
    rows = {r["doc_id"]: r for r in decontam.matches(odd, items).collect()}
    assert rows[4]["item_ids"] == rows[5]["item_ids"] == ["1"] and rows[4]["score"] in ("x", "again")
    assert [tuple(s) for s in rows[4]["spans"]] == [(0, 1), (2, 6)] and rows[0]["n_words"] == 0
    assert sum(s["end"] - s["start"] for s in rows[8]["spans"]) == 60_000
    small = {r["doc_id"]: (r["spans"], r["item_ids"]) for r in decontam.matches(odd, items, shard_words=10, block_bytes=8).collect()}
    assert small == {k: (r["spans"], r["item_ids"]) for k, r in rows.items()}
    named = decontam.matches(odd.withColumn("spans", F.lit("own")), items, names=("_n", "_s", "_i"))
    assert {r["spans"] for r in named.collect()} == {"own"} and named.count() == odd.count()
    assert decontam.matches(odd.limit(0), items).count() == 0
    assert decontam.matches(odd, items.limit(0)).where(F.size("spans") > 0).count() == 0


def test_a_shard_is_indexed_once_and_bounded(monkeypatch):
    """All blocks search one index, and a shard ends before its words pass the bound."""
    built = []
    monkeypatch.setattr(decontam.FMIndex, "__init__", lambda self, *a, f=decontam.FMIndex.__init__: (built.append(1), f(self, *a))[1])
    shard = decontam.Shard([[b"a", b"b", b"c"]] * 3)
    assert all(shard.scan(decontam.Block([(k, "a b"), (k + 10, "c")], 4))[0] == [[(0, 3)]] * 3 for k in range(5)) and len(built) == 1
    batch = pa.RecordBatch.from_pylist([{"text": t} for t in ["a b", "c d e", None, "f", "g " * 20, "h"]])
    cut = [([b.num_rows for b in held], list(map(len, docs))) for held, docs in decontam._shards([batch, batch], 5)]
    assert cut == [([3], [2, 3, 0]), ([1], [1]), ([1], [20]), ([1, 1], [1, 2]), ([3], [3, 0, 1]), ([1], [20]), ([1], [1])]


# --- toxicity ----------------------------------------------------------------------------------------------------


@given(st.lists(st.integers(-5, 5), max_size=40))
def test_segments_are_maximal(scores):
    got = toxicity.segments(np.array(scores, float), 0.5)
    best, at = 0, 0
    for x in scores:
        at = max(at + x, 0)
        best = max(best, at)
    assert max((s for s, _, _ in got), default=0) == best
    assert all(sum(scores[a:b]) == s for s, a, b in got)
    assert all(b <= c for (_, _, b), (_, c, _) in zip(got, got[1:], strict=False))


def test_op7_holds_out_and_ranks(spark, docs):
    rng = random.Random(2)
    bad, plain = [f"bad{i}" for i in range(12)], [f"word{i}" for i in range(800)]
    rows = []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 200))]
        if toxic := i % 8 == 0:
            for _ in range(5):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), int(toxic)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = queries.toxicity_model(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))
    got = toxicity.score(frame, model).collect()
    out = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert sum(r["predicted"] == r["toxic"] for r in out) >= 0.97 * len(out)
    hits = next(r for r in out if r["toxic"] and r["predicted"])
    words = hits["text"].split()
    assert any(w.startswith("bad") for p in hits["passages"] for w in words[p["start"] : p["end"]])


def test_op7_on_its_table(spark):
    """The held-out fold of the larger table: its flag, and how well its labels are told apart."""
    sf_dir = "/root/testdata/sf0.1"
    rows = queries.op7_toxicity(spark, sf_dir).join(queries.table(spark, sf_dir, "labels"), "doc_id", "left").collect()
    assert len(rows) == queries.table(spark, sf_dir, "documents").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    out = [(r["score"], r["toxic"]) for r in rows if r["held_out"] and r["toxic"] is not None]
    bad, good = [s for s, y in out if y], [s for s, y in out if not y]
    assert sum((a > b) + (a == b) / 2 for a in bad for b in good) >= 0.95 * len(bad) * len(good)
    assert sum(s >= 0.7 for s in bad) >= 0.85 * len(bad) and sum(s >= 0.7 for s in good) <= 0.01 * len(good)


def test_sum_statistics_use_all_segments():
    model = toxicity.Model(1, 1, {}, 1.0, -3.0)

    def plain(scores, n):
        reach, sums = model.log_k + np.log(n + 1), np.cumsum(sorted(scores, reverse=True)).tolist()
        totals = [(r, x - r * reach) for r, x in enumerate(sums, 1)]
        return min(max([-8.0, *(t - (r - 1) * math.log(t) + math.lgamma(r + 1) + math.lgamma(r) if t > r else t for r, t in totals)]), 60.0)

    rng = random.Random(3)
    for _ in range(300):
        scores, n = [rng.expovariate(1 / 3) for _ in range(rng.randrange(1, 80))], rng.randrange(1, 500)
        assert abs(model.signal(scores, n) - plain(scores, n)) < 1e-9


def test_toxicity_edges(spark, odd):
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    for some in (labels, labels.limit(0), labels.where("toxic = 0")):
        model = toxicity.train(odd.select("doc_id", "text"), some)
        rows = toxicity.score(odd, model).collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(odd.limit(0), model).count() == 0
    named = toxicity.score(odd, model, names=("_s", "_p", "_g")).collect()
    assert {r["score"] for r in named} == {"x", "again", "n"} and len({r["_s"] for r in named if r["doc_id"] in (4, 5)}) == 1


# --- WARC --------------------------------------------------------------------------------------------------------


def test_op1(spark, sf_dir):
    rows = local(queries.op1_warc(spark, sf_dir), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(rows) == sorted(archived(local(queries.table(spark, sf_dir, "pages"), "page_id", "html")))


def archived(pages):
    groups = {}
    for p, h in pages:
        groups.setdefault(hashlib.sha1((h or "").encode()).hexdigest(), []).append(p)
    for p, h in pages:
        body = (h or "").encode()
        digest = hashlib.sha1(body).hexdigest()
        top = max((x for x in groups[digest] if x is not None), default=None)
        again = len(body) >= 1000 and top is not None and p != top
        yield p, len(body), digest, "revisit" if again else "response", top if again else None


def test_warc_edges(spark):
    big = "x" * 1000 + "é\r\n\r\nHTTP/1.1 200\n"
    rows = [(1, "http://a b/\n", big), (2, None, big), (3, "", "short"), (4, "http://c", "short"), (5, "http://d", None), (2, "http://e", big), (None, "http://f", big), (9, "http://g", "y" * 999), (8, "http://g", "y" * 999), (20, "http://h", "long " * 1_000_000), (21, "http://i", "long " * 1_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit("clash"))
    got = local(warc.archive(spark, pages)[0], "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(archived([(r[0], r[2]) for r in rows]), key=key)
    assert warc.archive(spark, pages.limit(0))[0].count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_conversion(version):
    reader = warc.ArcReader()
    head, _ = reader.parse(warc.arc_version_block(version, "n.arc"))
    assert reader.version == version and warc.parse_warc(warc.convert(head, b"", "n#0", None))[0]["WARC-Type"] == "warcinfo"
    payload = b"<p>\n\nhi</p>"
    block = warc.http_head(7, len(payload))
    head, got = reader.parse(warc.arc_record(version, "n.arc", 5, "http://x/?a b".replace(" ", "%20"), block, payload))
    assert got == block + payload and head["URL"] == "http://x/?a%20b"
    fields, out = warc.parse_warc(warc.convert(head, got, "n#5", None))
    assert out == block + payload and fields["WARC-Date"] == "2024-01-01T00:00:00Z"
    assert warc.digest_hex(fields["WARC-Payload-Digest"]) == hashlib.sha1(payload).hexdigest()
    first = fields["WARC-Record-ID"]
    fields, out = warc.parse_warc(warc.convert(head, got, "n#90", {"page_id": 9, "uri": "http://x/?a%20b", "file": "n", "at": 5}))
    assert fields["WARC-Type"] == "revisit" and out == block and fields["WARC-Refers-To"] == first != fields["WARC-Record-ID"]
    assert fields["WARC-Refers-To-Target-URI"] == "http://x/?a%20b" and fields["WARC-Refers-To-Date"] == "2024-01-01T00:00:00Z"
    with pytest.raises(ValueError, match="declares"):
        reader.parse(warc.arc_record(version, "n.arc", 5, "http://x", block, payload)[:-9])
    assert warc.parse_warc(warc.convert({**head, "URL": "dns:x"}, b"a", "n#0", None))[0]["WARC-Type"] == "resource"
    assert warc.iso_date("19990102") == "1999-01-02T00:00:00Z"


# --- URL rules ---------------------------------------------------------------------------------------------------


def judged(pages, rules, default="allow"):
    for p, u in pages:
        m = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)", u or "")
        host, path = (brute.lower(m[2]), m[3]) if m else ("", "")
        fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fit, key=lambda r: (len(r[0] + r[1]), r[0] + r[1]), default=None)
        yield p, host, path, best and best[0] + best[1], best[2] if best else default


def test_op4(spark, sf_dir):
    got = local(queries.op4_url_rules(spark, sf_dir), "page_id", "host", "path", "rule", "verdict")
    assert sorted(got) == sorted(judged(local(queries.table(spark, sf_dir, "pages"), "page_id", "url"), queries.RULES))


def test_url_edges(spark):
    rng = random.Random(4)
    hosts = ["com", "a.com", "b.a.com", "b\x01a.com", "a\x02.com", "x\U0010ffff.com", "A.com", "aa.com", "x-a.com", "net", "é.com", "", "a..com"]
    urls = [None, "", "nothing", "://", "http://", "x://a.com?q://b/", "http://a.com#/en/", "http://a.com/en/" + "x" * 1_000_000] + [f"http://{rng.choice(hosts)}/{rng.choice(['en/', 'en/7', 'de', ''])}{rng.choice(['', '?x', '#y'])}" for _ in range(200)]
    pages = spark.createDataFrame([(i % 150, u) for i, u in enumerate(urls)] + [(None, "http://a.com/en/")], "page_id long, url string").withColumn("host", F.lit("clash"))
    rules = [("com", "/en/", "block"), ("a.com", "/en/7", "allow"), ("b.a.com", "", "block"), ("a.com", "/", "block"), ("é.com", "/d", "block")]
    rules += [("com", f"/p{i}", "block") for i in range(3000)]
    frame = spark.createDataFrame([*rules, ("com", None, "block")], "host string, path string, verdict string")
    key = lambda r: tuple(str(x) for x in r)
    want = sorted(judged(local(pages, "page_id", "url"), rules), key=key)
    for n in (1, 7):
        assert sorted(local(urlfilter.judge(pages, frame, ranges=n), "page_id", "host", "path", "rule", "verdict"), key=key) == want
    assert urlfilter.judge(pages.limit(0), frame).count() == 0
    assert urlfilter.judge(pages, frame.limit(0)).where("rule is not null").count() == 0


# --- main text ---------------------------------------------------------------------------------------------------

HTML = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header>top</header><nav><ul><li><a href="/a">menu</a></ul></nav>
<div class="ad">buy</div><div class="cookie-notice">cookies</div><article><h1>Head &amp; line</h1><p>One&nbsp;two
 three <b>bold</b> and a much longer run of words in this paragraph.<br><p>Second &lt;p&gt; of the article, which is long as well.<script>var t="</p>";</script>
<form><input>send</form><ul><li>item one<li>item two</ul></article><aside>side</aside><section id="comments"><p>I disagree</p></section><footer>&copy; foot"""


def test_main_text():
    text, path = mainhtml.Page(HTML).text()
    assert text == "Head & line\n\nOne two three bold and a much longer run of words in this paragraph.\n\nSecond <p> of the article, which is long as well.\n\nitem one\n\nitem two"
    assert path == "html>body>article"


def test_main_text_of_split_articles():
    words = "many words of an article that goes on "
    page = f"<body><article><div class=lead><p>Lead {words}</div><div class=body><p>Body {words * 3}<p class=search>Kept {words}</div></article><div><p>x</p></div>"
    text, path = mainhtml.Page(page).text()
    assert [t.split()[0] for t in text.split("\n\n")] == ["Lead", "Body", "Kept"] and path == "html>body>article"
    deep = mainhtml.Page(f"<body><p>{words}<a href=x><b><i><u><s>{'link ' * 30}</s></u></i></b></a></p><p>{'text ' * 90}")
    assert [b[1] > 100 for b in deep.blocks] == [True, False]
    table = mainhtml.Page("<table><tr><td>a<td>b<tr><td>c</table>")
    assert [b[0] for b in table.blocks] == ["a", "b", "c"]


@pytest.mark.parametrize("part", ["<div>", "<b>", '<a "', "<a x='", "<p><b>", "<li>", "</i>", "<!", "=\"", "<td>", "<hr><b>"])
def test_main_text_takes_linear_time(part):
    """A megabyte of one awkward piece, before a paragraph."""
    began = time.process_time()
    page = mainhtml.Page(part * (1_000_000 // len(part)) + "<p>" + "the end " * 9)
    assert time.process_time() - began < 25 and len(page.text()[0]) < 2_000_000


def test_op5(spark, sf_dir):
    rows = queries.op5_main_text(spark, sf_dir).collect()
    pages = {r["page_id"]: r["html"] for r in queries.table(spark, sf_dir, "pages").collect()}
    import html as entities

    for r in rows:
        body = pages[r["page_id"]].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert " ".join(r["text"].split()) == " ".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_main_text_edges(spark):
    rows = [(1, "http://a/x", HTML), (2, "http://a/y", None), (3, None, ""), (4, "http://b", "plain words"), (None, "http://a/z", "<p>" * 2000), (1, "http://a/x", HTML), (5, "http://a", "<article><p>" + "long " * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit("clash"))
    got = mainhtml.extract(pages).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[2] == by[3] == by[None] == "" and by[4] == "plain words" and by[1].startswith("Head & line") and len(by[5]) == 50_000 * 5 - 1
    assert mainhtml.extract(pages.limit(0)).count() == 0
    assert sorted(map(str, mainhtml.extract(pages, broadcast_hosts=0).collect())) == sorted(map(str, got))


# --- licences ----------------------------------------------------------------------------------------------------


def test_op6(spark, sf_dir, docs):
    cols = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    got = local(queries.op6_licences(spark, sf_dir), *cols)
    assert sorted(map(str, got)) == sorted(str((d, *scanned(t))) for d, t in local(docs, "doc_id", "text"))


def scanned(text):
    w = brute.words(text)
    hits = [(i, v) for k, v in licences.BASE.items() for i in range(len(w)) if w[i : i + len(k.split())] == k.split()]
    starts = [i for i, _ in hits]
    return len(w), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({v for _, v in hits}))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("gnu general public license apache cc by mit é , CC".split()), max_size=30))
def test_licence_phrases(words):
    text = " ".join(words)
    assert licences.scan_text(text, licences.automaton())[:5] == scanned(text)


def test_licence_expressions():
    parse = licences.parse_expression
    assert parse("MIT OR Apache-2.0") == (["mit", "apache-2.0"], 1.0)
    assert parse("GPL-2.0 WITH Classpath-exception-2.0 AND MIT")[0] == ["gpl-2.0 with classpath-exception-2.0", "mit"]
    assert parse("(MIT AND GPL-3.0-or-later) OR CC-BY-NC-4.0")[1] == 0.6
    assert parse("GPL-2.0 OR GPL-2.0 WITH Classpath-exception-2.0")[0] == ["gpl-2.0", "gpl-2.0 with classpath-exception-2.0"]
    assert licences.scan_text("SPDX License Identifier: MIT", licences.automaton())[5] == "mit"
    assert parse("MIT and") is None and parse("(MIT") is None and parse("") is None
    row = licences.scan_text("x SPDX-License-Identifier: MIT OR GPL-2.0-only\ny", licences.automaton())
    assert row[5] == "gpl-2.0-only,mit" and row[6] == 1.0


def test_licence_edges(odd):
    rows = licences.scan(odd).collect()
    assert len(rows) == odd.count() and {r["score"] for r in rows} == {0.5} and max(r["n_words"] for r in rows) == 90_000
    assert licences.scan(odd.limit(0)).count() == 0


# --- chat --------------------------------------------------------------------------------------------------------


def digest(turns):
    loss = "".join(x or "" for r, x in turns if r == "assistant")
    lines = "".join(f"{r or ''}\n{x or ''}\n" for r, x in turns)
    return len(turns), hashlib.sha256(lines.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_op8(spark, sf_dir):
    rows = local(queries.table(spark, sf_dir, "conversations").orderBy("conv_id", "turn"), "conv_id", "role", "text")
    said = "</s>[INST] ok [/INST]"
    want = {}
    for c, r, x in [*rows, (-1, "user", said), (-1, "assistant", said)]:
        want.setdefault(c, []).append((r, x))
    got = {r[0]: r[1:] for r in local(queries.op8_chat(spark, sf_dir), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")}
    assert got == {c: digest(t) for c, t in want.items()}


def test_chat_edges(spark):
    bits = [*chat.LLAMA.controls, "\\", "\\.", "\\0;", "\\(", "$1", "<", "</", "é한", "\n", "", "(", ")"]
    rng = random.Random(6)
    rows, want = [], {}
    for c in range(60):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "", "</s>"]), "".join(rng.choice(bits) for _ in range(rng.randrange(8)))) for _ in range(rng.randrange(1, 6))]
        want[c] = digest(turns)
        rows += [(c, i, r, x) for i, (r, x) in enumerate(turns)]
    rows += [(None, 0, None, None), (None, 0, "user", "alone"), (101, 0, "user", LONG), (100, None, "user", "first"), (100, 1, "user", "b"), (100, 1, "user", "a")]
    want |= {101: digest([("user", LONG)]), 100: digest([("user", "first"), ("user", "a"), ("user", "b")])}
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    out = chat.formatted(frame)
    found = local(chat.digests(out), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    assert {r[0]: r[1:] for r in found if r[0] is not None} == want
    assert sorted(r[1:] for r in found if r[0] is None) == sorted([digest([("", "")]), digest([("user", "alone")])])
    state = {r["conv_id"]: (r["valid"], r["first_bad_turn"]) for r in out.collect()}
    assert state[100] == (False, 1)
    assert chat.formatted(frame.limit(0)).count() == 0
    ok = spark.createDataFrame([(1, i, r, "x") for i, r in enumerate(["system", "user", "assistant", "user", "assistant"])], "conv_id long, turn long, role string, text string")
    assert local(chat.formatted(ok), "valid", "first_bad_turn") == [(True, None)]


def test_chat_plan_has_no_python(spark, sf_dir):
    plan = queries.op8_chat(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_licence_expression_of_any_length():
    names = [f"licence-{i}" for i in range(60)]
    found = list(licences._EXPRESSION.finditer(f"SPDX-License-Identifier: ({' AND '.join(names)}) OR MIT\nnext line".encode()))
    assert licences.parse_expression(found[0][1].decode()) == ([*names, "mit"], 1.0)


# --- media -------------------------------------------------------------------------------------------------------


def test_media(spark):
    rng = np.random.default_rng(11)
    shots = [media.render(rng.normal(0, 0.12, 64).tolist()) for _ in range(24)]
    rows = [(i, a) for i, a in enumerate(shots)] + [(100 + i, media.edit(shots[i], i % 2)) for i in range(12)] + [(200, shots[3]), (201, shots[3])]
    frame = [(i, a.shape[1], a.shape[0], bytearray(a.tobytes())) for i, a in rows] + [(300, 4, 4, None), (301, 4, 4, bytearray(b"x")), (302, 8, 8, bytearray(64)), (None, 8, 8, bytearray(64)), (303, 8, 8, bytearray(64))]
    pictures = spark.createDataFrame(frame, "image_id long, width int, height int, pixels binary").withColumn("key", F.lit("clash"))
    got = {r["image_id"]: (r["class_id"], r["n_links"]) for r in media.copies(pictures).collect()}
    assert len(got) == len(frame)
    assert sum(got[100 + i][0] == i for i in range(12)) >= 10
    assert got[200][0] == got[201][0] == 3 and got[3][1] >= 2
    assert all(got[i][0] == i for i in range(24)) and got[300] == (300, 0) and got[303] == (302, 1) and got[None][0] is None
    assert media.copies(pictures.limit(0)).count() == 0


def test_media_matches_of_small_and_large_buckets(spark):
    """Corners of one block: all pairs of a small bucket match, and a spanning forest of a large one, wherever they stand."""
    rng = np.random.default_rng(4)
    points = np.zeros(70, media._POINT)
    points["bits"] = rng.integers(0, 256, (70, media.BITS // 8))
    points["bits"][:, : media.BLOCK_BYTES] = 7
    points["bits"][[40, 63]] = points["bits"][9]
    rows = [(1, i, bytearray(x.tobytes())) for i, x in enumerate(points)] + [(2, i, bytearray(points[i].tobytes())) for i in (9, 40, 50, 63)]
    frame = spark.createDataFrame(rows, "block long, image_id long, point binary").coalesce(1)
    large, small = frame.where("block = 1"), frame.where("block = 2")
    assert set(local(large.mapInArrow(media._compare(None), media.MATCHES), "a", "b")) == {(9, 40), (9, 63)}
    assert set(local(small.mapInArrow(media._compare(None), media.MATCHES), "a", "b")) == {(9, 40), (9, 63), (40, 63)}
    assert local(large.mapInArrow(media._compare(69), media.MATCHES), "a", "b", "large") == [(70, None, 1)]


def test_op10_finds_planted_copies(spark):
    """At least nine in ten of the edited pictures are in their original's class, and others are alone."""
    got = dict(local(queries.op10_media(spark, "/root/testdata/sf0.01"), "image_id", "class_id"))
    assert len(got) == queries.table(spark, "/root/testdata/sf0.01", "embeddings").count()
    planted = [i for i in got if i % 10 == 3 and i - 1 in got]
    assert sum(got[i] == got[i - 1] for i in planted) >= 0.9 * len(planted)
    assert all(got[i] == i for i in got if i not in planted)


def test_media_tiles_of_hot_buckets(spark):
    rng = np.random.default_rng(12)
    shots = [media.render(rng.normal(0, 0.12, 64).tolist()) for _ in range(3)]
    rows = [(i + 10 * k, np.clip(a.astype(int) + k, 0, 255).astype(np.uint8)) for k in range(6) for i, a in enumerate(shots)]
    frame = [(i, a.shape[1], a.shape[0], bytearray(a.tobytes())) for i, a in rows]
    pictures = spark.createDataFrame(frame, "image_id long, width int, height int, pixels binary")
    whole = sorted(local(media.copies(pictures), "image_id", "class_id", "n_links"))
    assert sorted(local(media.copies(pictures, hot=3, tile=2), "image_id", "class_id", "n_links")) == whole
    assert {(i, c) for i, c, _ in whole} == {(i, i % 10) for i, _ in rows} and {n for _, _, n in whole} == {5}


def test_media_lists_every_match_once():
    """All pairs within the distance, in a bucket of any size, in the first block in which they are equal and no other."""
    rng = np.random.default_rng(4)
    points = np.zeros(300, media._POINT)
    points["bits"] = rng.integers(0, 256, (300, media.BITS // 8))
    points["bits"][:, : 2 * media.BLOCK_BYTES] = 7
    alike = [9, *range(40, 240)]
    points["bits"][alike] = points["bits"][9]
    points["bits"][50, -1] ^= 15
    bits = lambda i: points["bits"][i]
    want = [(i, j) for i, j in itertools.combinations(range(300), 2) if np.bitwise_count(bits(i) ^ bits(j)).sum() <= media.MATCH_BITS]

    def found(block, side):
        columns = {"block": [block] * 300, "image_id": list(range(300)), "point": [x.tobytes() for x in points], "side": side}
        rows = [r for b in media._compare(None, True)([pa.RecordBatch.from_pydict(columns)]) for r in b.to_pylist()]
        assert all(len(r["b"]) == len(r["pb"]) <= media.LIST for r in rows)
        return sorted((r["a"], b) for r in rows for b in r["b"])

    assert len(want) == 201 * 200 // 2 and found(8, [-1] * 300) == want
    assert found(9, [-1] * 300) == []
    assert found(8, [i % 2 for i in range(300)]) == [(i, j) for i, j in want if (i + j) % 2]


@pytest.mark.parametrize("hot", [{}, {"hot": 10, "tile": 7}])
def test_media_counts_all_links_of_a_large_group(spark, hot):
    a = media.render(np.random.default_rng(12).normal(0, 0.12, 64).tolist())
    rows = [(k, np.clip(a.astype(int) + k, 0, 255).astype(np.uint8)) for k in range(24)]
    frame = [(i, a.shape[1], a.shape[0], bytearray(a.tobytes())) for i, a in rows]
    pictures = spark.createDataFrame(frame, "image_id long, width int, height int, pixels binary")
    assert sorted(local(media.copies(pictures, **hot), "image_id", "class_id", "n_links")) == [(k, 0, 23) for k in range(24)]


def test_consensus_needs_one_transform():
    rng = np.random.default_rng(2)
    a = np.column_stack([rng.uniform(0, 90, (12, 2)), np.ones(12), rng.uniform(-3, 3, 12)])
    turn = 0.4
    z = (a[:, 0] + 1j * a[:, 1]) * 0.8 * np.exp(1j * turn) + (5 + 9j)
    b = np.column_stack([z.real, z.imag, np.full(12, 0.8), a[:, 3] + turn])
    assert media.consensus(a, b) >= 10
    b[:, :2] = rng.uniform(0, 90, (12, 2))
    assert media.consensus(a, b) < 5


# --- SQL ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    import duckdb

    sf_dir, con = "/root/testdata/sf0.01", duckdb.connect()
    for t in ("pages", "conversations"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(str, local(got, *columns))) == sorted(str(r) for r in want.select(*columns).fetchall())


def test_texts_that_nothing_asks_for_are_not_shuffled(spark):
    from quern.llm import ngramjoin

    rows = spark.range(20_000).selectExpr("id * 7 - 70000 AS key", "string(id) AS text")
    wanted = rows.where("key % 97 = 0").select("key")
    kept = ngramjoin.perhaps(rows, wanted, "key")
    assert kept.columns == rows.columns and wanted.join(kept, "key", "left_anti").count() == 0
    assert wanted.count() <= kept.count() < wanted.count() + 50


def test_scratch_frees_shuffles_and_tables(spark):
    import os

    name, scratch = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", Scratch(spark, "t", True)
    before = spark.conf.get(name)
    kept = scratch.keep(spark.range(1000).repartition(7, "id"))
    other = scratch.keep(kept)
    folder = scratch.paths[0].removeprefix("file:")
    assert spark.conf.get(name) == before and os.path.isdir(folder)
    scratch.free(kept)
    assert not os.path.exists(folder) and other.count() == 1000 and len(scratch.paths) == 1
    scratch.drop()
