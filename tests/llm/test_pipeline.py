"""The pipeline's stages against their contracts, each judged on its own input."""

import corpus_pipeline as cp
from quern.llm import queries
from tests.llm import brute
from tests.llm.test_operators import check_pieces, local


def test_pipeline(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    columns, items = docs.columns, local(queries.table(spark, sf_dir, "benchmark"), "item_id", "text")
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "decontamination", "packing"]
    kept = docs
    for name, stage in cp.STAGES[:3]:
        out = stage(spark, kept, sf_dir).cache()
        assert out.columns == columns
        before, after = dict(local(kept, "doc_id", "text")), dict(local(out, "doc_id", "text"))
        assert after.items() <= before.items() and len(after) == out.count()
        if name == "near_duplicates":
            first = {}
            for d in sorted(before):
                first.setdefault(before[d], d)
            assert set(after) <= set(first.values()) and len(after) >= 0.97 * len(first)
        if name == "decontamination":
            want = brute.decontaminated(list(before.items()), items)
            assert set(after) == {d for d, r in want.items() if not r[-1]}
        kept = out
    rows = cp.STAGES[3][1](spark, kept, sf_dir)
    cols = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    check_pieces(local(rows, *cols), dict(local(kept, "doc_id", "text")))
    assert {r[0] for r in local(cp.run(spark, sf_dir), "doc_id")} == {r[0] for r in local(kept, "doc_id")}


def test_stages_on_awkward_rows(spark):
    """Nulls, empty and very long texts, repeated rows and names that the operators use: values stay as they are."""
    sf_dir = "/root/testdata/sf0.001"
    extra = {"score": "own", "predicted": "own", "passages": "own", "n_words": "own", "spans": "own", "item_ids": "own", "digest": "own", "id": "own", "kept": "own", "part": "own", "hashes": "own", "text_": None}
    texts = [None, "", " ", "a b", "a b", "long words of a very long text " * 20_000, "some clean words of an ordinary text that nobody repeats"]
    rows = [(i, t, *extra.values()) for i, t in enumerate(texts)] + [(6, texts[6], *extra.values()), (None, "no id", *extra.values()), (None, None, *extra.values())]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long, text string", *(f"{c} string" for c in extra)]))
    key = lambda r: str(tuple(r))
    for name, stage in cp.STAGES[:3]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and stage(spark, docs.limit(0), sf_dir).count() == 0
        found = [tuple(r) for r in out.collect()]
        if name == "near_duplicates":  # texts without words are copies of each other
            assert sorted(r[0] for r in found if r[0] is not None) == [0, 3, 5, 6] and sum(r[0] is None for r in found) == 2
        else:
            assert sorted(map(key, found)) == sorted(map(key, rows))
        assert {r[2:] for r in found} == {tuple(extra.values())}
    assert cp.STAGES[3][1](spark, docs, sf_dir).select("doc_id").distinct().count() == 8
    assert cp.STAGES[3][1](spark, docs.limit(0), sf_dir).count() == 0


def test_recall_of_near_copies(spark):
    """Of all pairs of different texts with a similarity of 0.8 or more, at most one in ten keeps both."""
    docs = queries.table(spark, "/root/testdata/sf0.1", "documents")
    sets = {}
    for d, t in local(docs, "doc_id", "text"):
        w = brute.lower(t).split()
        sets[d] = (t, frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4) if w else 0)))
    at, pairs = {}, set()
    for d, (_, s) in sets.items():  # by the rarest shingles of either, as many as a similar set can't all miss
        for g in sorted(s, key=hash)[: len(s) - -(-8 * len(s) // 10) + 1]:
            at.setdefault(g, []).append(d)
    for ids in at.values():
        pairs |= {(a, b) for k, b in enumerate(ids) for a in ids[max(0, k - 50) : k]}
    near = [(a, b) for a, b in pairs if sets[a][0] != sets[b][0] and len(sets[a][1] & sets[b][1]) >= 0.8 * len(sets[a][1] | sets[b][1])]
    kept = {r[0] for r in local(cp.drop_near_duplicates(spark, docs, ""), "doc_id")}
    assert len(near) >= 20 and sum(a in kept and b in kept for a, b in near) <= 0.1 * len(near)
