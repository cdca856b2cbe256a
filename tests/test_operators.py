"""Operators without an oracle against plain loops and invariants; edge cases of the ones with."""

import time

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern import config, registry
from quern.functions import script, tokens
from quern.operators import batching, corruption, mixing, ranks, relational, sampling
from quern.sources import readers, sinks


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 3000), max_size=60), st.floats(0.3, 1.0))
def test_next_fit_holds_every_document_once(lengths, threshold):
    packs, alone = batching.next_fit(lengths, 2048, threshold)
    assert sorted(i for p in [*packs, alone] for i in p) == list(range(len(lengths)))
    assert all(sum(min(lengths[i], 2048) for i in p) <= 2048 for p in packs)


def test_next_fit_golden():
    assert batching.next_fit([9, 5, 4, 1], 10, 0.9) == ([[0], [1, 2, 3]], [])
    assert batching.next_fit([6, 6, 3], 10, 0.9) == ([[0], [2]], [1])


def test_packs_match_the_loop(spark):
    rows = spark.createDataFrame([(i, "a" if i % 3 else "b", (i * 37) % 900 + 1) for i in range(200)], "id long, source string, n long")
    packs = batching.pack_documents(rows, "n", "id", ["source"], 1000, 0.8).collect()
    for source in "ab":
        own = sorted((r["id"], r["n"]) for r in rows.where(F.col("source") == source).collect())
        want, alone = batching.next_fit([n for _, n in own], 1000, 0.8)
        got = {}
        for r in packs:
            if r["source"] == source:
                got.setdefault(r["pack"], set()).add(r["id"])
        assert sorted(map(sorted, got.values())) == sorted([sorted(own[i][0] for i in p) for p in [*want, *([i] for i in alone)]])


def leftovers(buffers, limit, threshold, most):
    """A lane's packs in a plain loop: buffers of (id, length)."""
    out, carried = [], []
    for k, b in enumerate(buffers, 1):
        docs, carried, now = [*carried, *((i, n, 0) for i, n in b)], [], []
        for i, n, again in sorted(docs, key=lambda d: -d[1]):
            n = min(n, limit)
            if now and sum(x[1] for x in now) + n > limit:
                full = sum(x[1] for x in now) / limit >= threshold
                out.append([x[0] for x in now])
                now = []
                if not full:
                    if k < len(buffers) and n < limit // 2 and again < most:
                        carried.append((i, n, again + 1))
                    else:
                        out.append([i])
                    continue
            now.append((i, n))
        if now:
            out.append([x[0] for x in now])
    return out


def test_leftovers_keep_every_document(spark):
    rows = spark.createDataFrame([(i, "a", i // 16, (i * 53) % 1100 + 1) for i in range(150)], "id long, source string, b long, n long")
    got = batching.pack_with_leftovers(rows, "n", "id", ["source"], "b", 1000, 0.9).collect()
    assert sorted(r["id"] for r in got) == list(range(150))
    assert max(r["recycles"] for r in got) <= 2
    used = {}
    for r in got:
        used[r["pack"]] = used.get(r["pack"], 0) + r["used"]
    assert max(used.values()) <= 1000


def test_lanes_split_a_hot_source_and_match_the_loop(spark):
    """Nearly all rows are of one source: its lanes are packed apart, each as one loop over its buffers."""
    df = spark.createDataFrame([(i, "a" if i % 9 else "b", (i * 53) % 700 + 1) for i in range(600)], "id long, source string, n long")
    dealt = batching.buffer_ids(batching.laned(df, "id", 100), 16, "id", ["source", "lane"], "b")
    lanes = {}
    for r in dealt.collect():
        lanes.setdefault((r["source"], r["lane"]), {}).setdefault(r["b"], []).append((r["id"], r["n"]))
    assert len({lane for _, lane in lanes}) == 6 and max(sum(map(len, b.values())) for b in lanes.values()) < 150
    got = {}
    for r in batching.pack_with_leftovers(dealt, "n", "id", ["source", "lane"], "b", 1000, 0.9).collect():
        got.setdefault((r["source"], r["lane"]), {}).setdefault(r["pack"], set()).add(r["id"])
    for lane, buffers in lanes.items():
        want = leftovers([sorted(buffers[b]) for b in sorted(buffers)], 1000, 0.9, 2)
        assert sorted(map(sorted, got[lane].values())) == sorted(map(sorted, want))


def test_mixer_matches_the_loop(spark):
    rows = [(i, "xyz"[i % 3], (i * 31) % 90 + 1, 0) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, source string, n_tokens long, lane long")
    targets = {"x": 0.6, "y": 0.3, "z": 0.1}
    got = [r["id"] for r in mixing.mix(df, targets, "id").orderBy("order").collect()]
    queues = {s: [r for r in rows if r[1] == s] for s in "xyz"}
    used, want = dict.fromkeys("xyz", 0), []
    import hashlib

    for i in range(120):
        draw = int(hashlib.md5(f"42:0:{i}".encode()).hexdigest()[:8], 16) / 2**32
        s = mixing.choose_source(targets, used, {k: len(q) for k, q in queues.items()}, draw)
        r = queues[s].pop(0)
        used[s] += r[2]
        want.append(r[0])
    assert got == want
    half = mixing.mix(df, targets, "id").where("order < 40").groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()
    share = {r["source"]: r["n"] for r in half}
    assert share["x"] / sum(share.values()) == pytest.approx(0.6, abs=0.08)


def test_mixer_lanes_with_sources_that_run_dry(spark):
    """Each lane as one loop over its rows, with a source that ends early, one without a share, and one without a target."""
    import hashlib
    import random

    rng = random.Random(2)
    rows = [(i, rng.choice("xxxyzuq"), rng.randrange(0, 50), rng.randrange(3)) for i in range(400) if i % 5]
    rows = [r for r in rows if r[1] != "y" or r[0] < 120]
    targets = {"x": 0.5, "y": 0.4, "z": 0.1, "u": 0.0}
    df = spark.createDataFrame(rows, "id long, source string, n_tokens long, lane long").repartition(5)
    got = {}
    for r in mixing.mix(df, targets, "id").orderBy("lane", "order").collect():
        got.setdefault(r["lane"], []).append((r["id"], r["source"], r["n_tokens"]))
    for lane in range(3):
        queues = {s: [r[:3] for r in rows if r[1] == s and r[3] == lane] for s in targets}
        used, want = dict.fromkeys(targets, 0), []
        while any(queues.values()):
            draw = int(hashlib.md5(f"42:{lane}:{len(want)}".encode()).hexdigest()[:8], 16) / 2**32
            s = mixing.choose_source(targets, used, {k: len(q) for k, q in queues.items()}, draw)
            want.append(queues[s].pop(0))
            used[s] += want[-1][2]
        assert got[lane] == want
    assert mixing.mix(df.limit(0), targets, "id").count() == 0


def test_quantiles_ranks_and_running_values_against_plain_python(spark):
    import random

    import numpy as np

    from quern.operators import ranks
    from quern.operators import relational as rel

    rng = random.Random(4)
    values = [rng.choice([7.0, 7.0, rng.random() * 100]) for _ in range(501)]
    df = spark.createDataFrame([(i, v, f"https://{int(v)}/{i % 40}", "ab"[i % 2]) for i, v in enumerate(values)] + [(999, None, None, "a")], "id long, v double, url string, run string")
    at = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.991, "e": 1.0}
    q = rel.linear_quantiles(df, "v", at).first()
    assert [q[n] for n in at] == pytest.approx(list(np.quantile(values, list(at.values()))))
    q = rel.nearest_quantiles(df, "v", at).first()
    assert [q[n] for n in at] == [sorted(values)[int(p * 500 + 0.5)] for p in at.values()]
    assert rel.linear_quantiles(df.limit(0), "v", at).first()["c"] is None
    got = [r["id"] for r in ranks.row_index(df, "url", more=[F.col("id")]).orderBy("rn").collect()]
    assert got == [r[0] for r in sorted(((r["id"], r["url"] or "") for r in df.collect()), key=lambda r: (r[1], r[0]))]
    for run in (None, "run"):
        best, want = {}, set()
        for r in df.where("v is not null").orderBy("id").collect():
            k = r["run"] if run else 0
            if k not in best or r["v"] > best[k]:
                best[k] = r["v"]
                want.add(r["id"])
        assert {r["id"] for r in rel.running_best(df.where("v is not null"), "id", "v", run).where("is_best").collect()} == want
    assert rel.subgroup_means(df, "run", "v").count() == 2 and rel.subgroup_means(df.where("run = 'a'"), "run", "v").count() == 0


def spans_of(dec):
    spans, mark = {}, None
    for x in dec:
        if x >= 10_000:
            mark = x
            assert mark not in spans
            spans[mark] = []
        else:
            spans[mark].append(x)
    return spans


@pytest.mark.parametrize(("ratio", "mean"), [(0.15, 3.0), (0.5, 1.0), (0.05, 9.0), (0.9, 4.0)])
def test_sentinels_give_the_text_back(spark, ratio, mean):
    """Round trips, counts by the rule, few sentinels for long texts, and special ids (2) that stay where they are."""
    rng = random.Random(6)
    texts = [[], [5], [2], [2, 2, 2], [2, 2, 2, 2, 7, 7], [7, 8], list(range(3, 5003)), [3] * 20_000]
    texts += [[rng.choice([2, 3, 4, 5, 6]) for _ in range(rng.randint(0, 120))] for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, ids array<int>").repartition(8)
    for r in df.select("ids", corruption.sentinel_masking(ratio, mean, 10_000, (2,))(F.col("ids"), F.col("id")).alias("s")).collect():
        ids, enc, dec = r["ids"], r["s"]["encoder"], r["s"]["decoder"]
        plain, spans = [x for x in ids if x != 2], spans_of(dec)
        assert 2 not in dec and enc.count(2) == ids.count(2)
        if len(ids) < 2 or not plain:
            assert (enc, dec) == (ids, [])
            continue
        assert [y for x in enc if x != 2 for y in (spans[x] if x >= 10_000 else [x])] == plain
        m = len(plain)
        noise = max(1, min(round(m * ratio), m - 1))
        k = max(1, min(round(noise / mean), corruption.SENTINELS - 1, noise, m - noise))
        assert list(spans) == [10_000 + i for i in range(k)] and sum(map(len, spans.values())) == noise and all(spans.values())
        if m > noise:
            assert enc[0] < 10_000  # a kept part comes first


def test_masks_of_sentinels_use_no_python(spark, sf_dir):
    for name in ("cr3_sentinels", "cr6_morpheme_sentinels", "cr14_byte_reconstruction", "cr17_heavy_denoising"):
        plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=80), st.integers(0, 10**6))
def test_infilling_keeps_protected_tokens_and_order(text, key):
    out = corruption.infill(text, 0.3, 3.0, -1, {2}, corruption.rng_of(key))
    assert out.count(2) == text.count(2)
    assert not any(a == b == -1 for a, b in zip(out, out[1:], strict=False))
    kept = iter(text)
    assert all(any(x == y for y in kept) for x in out if x != -1)
    assert len([x for x in out if x != -1]) >= len(text) - int(0.3 * len(text))


def test_infilling_begins_few_spans_and_steps_over_protected_ids():
    n = 20_000
    rngs = [corruption.rng_of(k) for k in range(5)]
    few = [corruption.infill([7] * n, 0.9, 1.0, -1, set(), g) for g in rngs]
    assert all(0.1 < (n - out.count(7)) / n < 0.9 for out in few)  # with a start at 15 % of places the budget isn't spent
    out = corruption.infill([7, 2] * 500, 0.5, 30.0, -1, {2}, corruption.rng_of(1))
    assert out.count(2) == 500 and max(len(run) for run in "".join("m" if x == -1 else "k" if x == 7 else "" for x in out).split("k")) > 3


def test_transcription_golden():
    entries = {"美": "미", "女": "녀", "韓": "한", "國": "국", "樂": "락", "音": "음", "音樂": "음악"}
    widths = [2, 1]
    for text, want in (("音樂", "음악"), ("樂", "락"), ("女", "여"), ("韓國 x", "한국 x"), ("", ""), ("鬼", "鬼")):
        assert script.transcribe_text(text, entries, widths) == want


def test_ranks_are_exact(spark):
    rows = spark.createDataFrame([(i * 7 % 500, "a" if i % 3 else "b") for i in range(500)], "id long, g string")
    got = {r["id"]: r["rn"] for r in ranks.row_index(rows, "id").collect()}
    assert got == {i: i + 1 for i in range(500)}
    by = {}
    for r in ranks.hash_rank(rows, 1, "id", ["g"], total="n").collect():
        by.setdefault(r["g"], []).append((r["rn"], r["n"]))
    for own in by.values():
        assert sorted(x for x, _ in own) == list(range(1, len(own) + 1)) and {n for _, n in own} == {len(own)}
    assert ranks.row_index(rows.limit(0), "id").count() == 0


def test_quota_split_is_disjoint_and_exact(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(70)], "id long, b long")
    got = sampling.quota_split(rows, {"train": 12, "test": 4}, "id", "b").groupBy("b", "split").count().collect()
    assert {(r["b"], r["split"]): r["count"] for r in got} == {(b, s): n for b in range(3) for s, n in (("train", 12), ("test", 4))}
    small = sampling.quota_split(rows.where("id < 21"), {"train": 12, "test": 4}, "id", "b", fractions={"train": 0.6, "test": 0.4})
    got = small.groupBy("b", "split").count().collect()
    assert {(r["b"], r["split"]): r["count"] for r in got} == {(b, s): n for b in range(3) for s, n in (("train", 4), ("test", 3))}


def test_null_keys_stay_in_an_anti_join(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "id long")
    out = relational.without(left, spark.createDataFrame([(1,), (None,)], "id long"), "id")
    assert {r["id"] for r in out.collect()} == {2, None}


def test_unknown_source_is_an_error(spark):
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "source string")
    rows = names("a", "b", "c")
    with pytest.raises(Exception, match="unknown source c"):
        relational.active_sources(rows, names("a"), names("b")).collect()


def test_split_at_and_permute(spark):
    df = spark.createDataFrame([([1, 2, 3, 2, 4],), ([],)], "x array<int>")
    out = [r[0] for r in df.select(tokens.split_at(F.col("x"), 2)).collect()]
    assert out == [[[1, 2], [3, 2], [4]], []]


def test_config_errors():
    assert config.parse_denoisers("3,8;0.15,0.5") == [(3.0, 0.15), (8.0, 0.5)]
    for bad in ("3;0.1,0.2", "", "3;1.5"):
        with pytest.raises(ValueError):
            config.parse_denoisers(bad)
    assert [s.name for s in config.select_sources(config.pretraining_sources("r"), "none")] == ["curated", "web", "pdf", "historical"]


def test_sinks_and_caches(spark, tmp_path):
    rows = spark.createDataFrame([(1, "http://a"), (2, "http://b")], "id long, url string")
    sinks.write_parquet_and_csv(rows, f"{tmp_path}/t")
    assert spark.read.option("header", True).csv(f"{tmp_path}/t.csv").count() == 2
    sinks.write_lines(rows, "url", f"{tmp_path}/u")
    assert ids(readers.text_list(spark, f"{tmp_path}/u"), "value") == ["http://a", "http://b"]
    made = []
    for _ in range(2):
        _, n = readers.cached_with_count(spark, f"{tmp_path}/c", lambda: made.append(1) or rows)
        assert n == 2
    assert len(made) == 1
    sinks.write_json(rows.limit(1), f"{tmp_path}/j")
    sinks.append_metrics(relational.long_metrics(rows.agg(F.count("*").alias("n")), "x", ["n"]), f"{tmp_path}/m")
    assert readers.listing(spark, f"{tmp_path}/u").count() >= 1
    with pytest.raises(FileNotFoundError):
        readers.load(spark, f"{tmp_path}/none")


def test_arrow_files(spark, tmp_path):
    import pyarrow as pa

    from quern.sources import arrowfiles

    rows = pa.table({"id": [1, 2, 3], "text": ["a", None, "c"], "v": [[1], [], None]})
    with pa.OSFile(f"{tmp_path}/a.arrow", "wb") as f, pa.ipc.new_file(f, rows.schema) as w:
        w.write_table(rows, max_chunksize=2)
    with pa.OSFile(f"{tmp_path}/b.arrow", "wb") as f, pa.ipc.new_stream(f, rows.schema) as w:
        w.write_table(rows)
    df = arrowfiles.read_arrow(spark, f"{tmp_path}/*.arrow")
    assert df.columns == ["id", "text", "v"] and sorted(r["id"] for r in df.collect()) == [1, 1, 2, 2, 3, 3]
    assert df.rdd.getNumPartitions() == 3  # two batches of the first file, and the second
    own = arrowfiles.read_arrow(spark, f"{tmp_path}/a.arrow", ["v", "id"])
    assert own.columns == ["v", "id"] and {(r["id"], tuple(r["v"]) if r["v"] is not None else None) for r in own.collect()} == {(1, (1,)), (2, ()), (3, None)}
    arrowfiles.write_arrow(df.where("id < 0"), f"{tmp_path}/none")
    with pytest.raises(FileNotFoundError):
        arrowfiles.read_arrow(spark, f"{tmp_path}/none/*.arrow")
    arrowfiles.write_arrow(df.repartition(2), f"{tmp_path}/again", rows=1)
    back = arrowfiles.read_arrow(spark, f"{tmp_path}/again/*.arrow", ["id"])
    assert sorted(r["id"] for r in back.collect()) == [1, 1, 2, 2, 3, 3] and back.rdd.getNumPartitions() == 6


def test_mixed_stream_resumes_and_matches_the_mixer(spark, sf_dir):
    from quern.plans import q_sampling

    rows = batching.laned(q_sampling._words(spark, sf_dir), "doc_id", 1024)
    want = mixing.mix(rows, q_sampling._TARGETS, "doc_id", "lang").collect()
    got = registry.QUERIES["ss1_mixed_stream"](spark, sf_dir).collect()
    key = lambda r: (r["lane"], r["order"], r["doc_id"], r["lang"], r["n_tokens"])
    assert sorted(map(key, got)) == sorted(map(key, want)) and got


def test_streams(spark, tmp_path):
    from quern.streaming import mixer

    rows = spark.createDataFrame([(i, "xy"[i % 2], 10, 0) for i in range(40)], "id long, source string, n_tokens long, lane long")
    rows.repartition(2).write.parquet(f"{tmp_path}/s")
    stream = mixer.read_parquet_stream(spark, f"{tmp_path}/s", rows.schema, 2)
    with mixer.rocksdb(spark, 2):
        got = mixer.drain(mixer.mixed_stream(stream, {"x": 0.75, "y": 0.25}, "id"), "mixed").collect()
        assert len({r["id"] for r in got}) == len(got) > 0
        first = [r["source"] for r in sorted(got, key=lambda r: r["order"])[:20]]
        assert first.count("x") == pytest.approx(15, abs=2)
        query = mixer.mixed_stream(stream, {"x": 0.75, "y": 0.25}, "id", idle_ms=500).writeStream.format("memory").queryName("all").start()
        try:  # rows that wait for a source that ran dry go out when nothing more comes
            for _ in range(60):
                if (n := spark.table("all").count()) == 40:
                    break
                time.sleep(0.5)
        finally:
            query.stop()
    assert n == 40 and sorted(r["id"] for r in spark.table("all").collect()) == list(range(40))
    events = spark.createDataFrame([(1, "a", 5), (1, "a", 5), (2, "b", 7)], "id long, source string, n_tokens long").withColumn("at", F.timestamp_seconds(F.col("id") * 60))
    events.write.parquet(f"{tmp_path}/e")
    s = mixer.read_parquet_stream(spark, f"{tmp_path}/e", events.schema, 10)
    assert mixer.drain(mixer.unseen_stream(s, "id", "at"), "once").count() == 2
    assert mixer.drain(mixer.token_counts(s, "source", "n_tokens", "at"), "counts", "complete").count() == 2


def test_rouge_l_and_bleu_against_plain_python(spark):
    import math
    import random
    from collections import Counter

    from quern.operators import metrics as ev

    rng = random.Random(8)
    pairs = [(i, " ".join(rng.choices("a b".split(), k=rng.randrange(0, 12))), " ".join(rng.choices("a b".split(), k=rng.randrange(0, 12)))) for i in range(40)]
    df = spark.createDataFrame(pairs, "id int, r string, c string")
    got = {x["id"]: x for x in df.select("id", ev.rouge_l(F.col("r"), F.col("c")).alias("s")).select("id", "s.*").collect()}

    def lcs(x, y):
        return 0 if not x or not y else lcs(x[1:], y[1:]) + 1 if x[0] == y[0] else max(lcs(x[1:], y), lcs(x, y[1:]))

    for i, r, c in pairs[:15]:
        r, c = r.split()[:8], c.split()[:8]
        if len(pairs[i][1].split()) <= 8 and len(pairs[i][2].split()) <= 8:
            n = lcs(tuple(r), tuple(c))
            assert got[i]["precision"] == pytest.approx(n / len(c) if c and r else 0)
            assert got[i]["recall"] == pytest.approx(n / len(r) if c and r else 0)
    match, total = [0] * 4, [0] * 4
    for _, r, c in pairs:
        for n in range(1, 5):
            a, b = (Counter(zip(*(x.split()[i:] for i in range(n)), strict=False)) for x in (c, r))
            match[n - 1] += (a & b).total()
            total[n - 1] += a.total()
    nc, nr = sum(len(c.split()) for *_, c in pairs), sum(len(r.split()) for _, r, _ in pairs)
    want = math.exp(sum(math.log(m / t) for m, t in zip(match, total, strict=True)) / 4) * (1 if nc >= nr else math.exp(1 - nr / nc))
    assert ev.corpus_bleu(df, "r", "c").first()["bleu"] == pytest.approx(want)


def test_windows_encoders_and_decoders(spark):
    df = spark.createDataFrame([(i, list(range(3, 3 + i)) + [2] + list(range(3, 20))) for i in range(1, 20)], "id int, ids array<int>")
    for i, ids, out in df.select("id", "ids", tokens.sentence_window(F.col("ids"), 8, 2, "id")).collect():
        starts = [0] + [k + 1 for k, x in enumerate(ids) if x == 2 and k + 1 <= len(ids) - 8]
        assert out in [ids[s : s + 8] for s in starts]
    text = spark.createDataFrame([("a b c d",), (None,)], "t string")
    enc = tokens.encoder(tokens.words_tokenizer, bos=1, eos=2, max_length=4)
    rows = [r[0] for r in text.select(enc(F.col("t"))).collect()]
    assert [len(r) for r in rows] == [4, 2] and rows[0][0] == 1 and rows[0][-1] == 2
    dec = tokens.decoder(lambda: lambda ids: "".join(map(str, ids)), frozenset({2}))
    assert df.where("id = 1").select(dec(F.slice("ids", 1, 3))).first()[0] == "33"


def test_split_at_and_permuted_batches(spark):
    rows = [(1, [5, 2, 6, 7, 2]), (2, [5]), (3, []), (4, [2, 2, 9]), (5, list(range(3, 90)))]
    frame = spark.createDataFrame(rows, "id int, ids array<int>")
    got = dict(tuple(r) for r in frame.select("id", tokens.split_at(F.col("ids"), 2)).collect())
    assert got == {1: [[5, 2], [6, 7, 2]], 2: [[5]], 3: [], 4: [[2], [2], [9]], 5: [list(range(3, 90))]}
    for r in frame.select("ids", corruption.infilling_collate(F.col("ids"), F.col("id"), 64, mask=777).alias("s")).collect():
        s, ids = r["s"], r["ids"]
        assert s["labels"] == (ids + [-100] * 64)[:64] and s["decoder_input_ids"] == ([1] + [0 if x == -100 else x for x in s["labels"]])[:64]
        assert set(s["input_ids"]) <= {*ids, 777, 0} and s["attention_mask"] == [int(x != 0) for x in s["input_ids"]]


def test_packed_batch_holds_every_id_once(spark, sf_dir):
    from quern.plans.q_more import _sides

    docs = {r["doc_id"]: r["ids"] for r in _sides(spark, sf_dir).collect() if r["ids"] and r["dec"]}
    packs = registry.QUERIES["pk9_packed_batch"](spark, sf_dir).collect()
    found = []
    for p in packs:
        ids, segments = ([int(x) for x in p[c].split()] for c in ("input_ids", "segment_ids"))
        assert len(ids) == 512 and sorted(set(segments) - {0}) == list(range(1, p["n_docs"] + 1))
        found += [tuple(i for i, s in zip(ids, segments) if s == k) for k in range(1, p["n_docs"] + 1)]
    assert sorted(found) == sorted(tuple(x[:512]) for x in docs.values())


def test_common_subsequence():
    import random

    from quern.operators.metrics import common_length

    rng = random.Random(8)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(150))] for _ in range(2))
        before = [0] * (len(b) + 1)
        for x in a:
            now = [0]
            for j, y in enumerate(b):
                now.append(before[j] + 1 if x == y else max(before[j + 1], now[j]))
            before = now
        assert common_length(a, b) == before[-1]


def test_ranks_cut_a_frequent_key(spark):
    """Half of all rows have one key: the ranks are those of one sort, and no bucket holds more than a small share."""
    import random

    rng = random.Random(8)
    rows = [(i, 7 if i % 2 else rng.choice([None, *range(30)])) for i in rng.sample(range(100_000), 4000)]
    df = spark.createDataFrame(rows, "id long, k long")
    got = {r["id"]: r["rn"] for r in ranks.row_index(df, "k", tie="id").collect()}
    assert got == {i: n for n, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0])), 1)}
    sizes = df.groupBy(ranks.tied_bucket(df.where("k is not null"), "k", "id").alias("b")).count().where("b >= 0").collect()
    assert max(r["count"] for r in sizes) < 0.06 * len(rows)


def test_text_list_of_pages_that_share_an_address(spark, tmp_path):
    urls = ["http://a", " http://a", "http://b", "http://a", "", "  ", None]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    assert ids(registry.QUERIES["src6_text_list"](spark, str(tmp_path)), "value") == ["http://a", "http://b"]
    sinks.write_lines(spark.createDataFrame([("x",), (" x",)], "u string"), "u", f"{tmp_path}/u")
    with pytest.raises(ValueError, match="repeated"):
        readers.text_list(spark, f"{tmp_path}/u")


def test_morphemes_are_split_once(spark, sf_dir):
    plan = registry.QUERIES["cr6_morpheme_sentinels"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(text") == 1  # not anew for each span


def test_sentinels_of_null_empty_and_special_tokens(spark):
    rows = [(1, None), (2, []), (3, ["</s>"]), (4, ["a"]), (5, ["</s>", "</s>"]), (6, ["a", None, "b"]), (7, list("abcd")), (8, ["a", "</s>", "b", "c"])]
    df = spark.createDataFrame(rows, "id long, p array<string>").select("id", "p", corruption.morpheme_sentinels()(F.col("p"), F.col("id")).alias("s"))
    got = {r["id"]: (r["s"] and (r["s"]["encoder"], r["s"]["decoder"])) for r in df.collect()}
    for k in (2, 3, 4, 5):
        assert got[k] == (dict(rows)[k], [])
    for k in (7, 8):
        enc, dec = got[k]
        put = [y for x in enc for y in (dec[1:] if x == "<extra_id_0>" else [x])]
        assert dec[0] == "<extra_id_0>" and len(dec) == 2 and [x for x in put if x != "</s>"] == [x for x in dict(rows)[k] if x != "</s>"]
    assert None not in got[6][1]
