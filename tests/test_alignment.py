"""Matching blocks and Hanja accuracy against difflib and plain loops."""

import difflib
import random
import time

import pytest

from quern.functions.alignment import hanja_accuracy, hanja_in_blocks, hanja_recall, matching_blocks
from pyspark.sql import functions as F


def hanja(c):
    return 0x4E00 <= ord(c) <= 0x9FFF


def placed(p, r):
    places = [i for i in range(min(len(p), len(r))) if hanja(r[i])]
    return sum(p[i] == r[i] for i in places) / max(1, len(places))


def in_blocks(p, r):
    blocks = difflib.SequenceMatcher(None, p, r, autojunk=False).get_matching_blocks()
    return sum(hanja(c) for x in blocks for c in r[x.b : x.b + x.size]) / max(1, sum(map(hanja, r)))


def pairs(n, alphabet="音樂韓 가a", most=60, seed=1):
    rng = random.Random(seed)
    for _ in range(n):
        r = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, most)))
        p = list(r)
        for _ in range(rng.randint(0, 8)):
            at = rng.randint(0, len(p))
            p[at : at + rng.randint(0, 3)] = rng.choice(alphabet) * rng.randint(0, 3)
        yield "".join(p), r


def test_blocks_are_those_of_difflib():
    for p, r in [*pairs(800), *pairs(300, "音樂", 40, 2), ("", "音"), ("音", ""), ("", "")]:
        got = [x for x in difflib.SequenceMatcher(None, p, r, autojunk=False).get_matching_blocks() if x.size]
        merged = []
        for i, j, size in matching_blocks(p, r):  # difflib joins neighbours
            if merged and merged[-1][0] + merged[-1][2] == i and merged[-1][1] + merged[-1][2] == j:
                merged[-1][2] += size
            else:
                merged.append([i, j, size])
        assert merged == [list(x) for x in got]


def test_mistaken_hanja_count_as_missed():
    assert hanja_in_blocks("미술은 한국의 음악", "美術은 韓國의 音樂") == 0.0
    assert hanja_in_blocks("美術은 한국의 音樂", "美術은 韓國의 音樂") == 4 / 6


def test_accuracy(spark):
    rows = [*pairs(200), (None, "音"), ("音", None), (" 　 音", "音"), ("音 樂", "音樂")]
    df = spark.createDataFrame(rows, "p string, r string")
    p, r = F.col("p"), F.col("r")
    got = df.select("p", "r", hanja_accuracy(p, r), hanja_accuracy(p, r, True), hanja_recall(p, r)).collect()
    for p, r, aligned, spaceless, recall in got:
        p, r = p or "", r or ""
        assert aligned == pytest.approx(placed(p.lstrip(), r.lstrip()))
        assert spaceless == pytest.approx(placed("".join(p.split()), "".join(r.split())))
        assert recall == pytest.approx(in_blocks(p, r))


def test_time_of_long_texts():
    """20,000 words with a change in every hundredth character: far from the square of the length."""
    rng = random.Random(4)
    r = " ".join("".join(rng.choice("音樂韓國語女가美術한") for _ in range(5)) for _ in range(20_000))
    took = {}
    for n in (len(r) // 4, len(r)):
        p = "".join("로" if rng.random() < 0.01 else c for c in r[:n])
        began = time.time()
        assert 0.98 < hanja_in_blocks(p, r[:n]) < 1
        took[n] = time.time() - began
    short, whole = took.values()
    assert whole < 9 * short + 1


def test_query_against_difflib(spark, sf_dir):
    from quern.plans.q_metrics import _edited
    from quern.registry import QUERIES

    texts = {(x.conv_id, x.turn): in_blocks(x.p, x.r) for x in _edited(spark, sf_dir).collect() if len(x.r) < 600}
    got = {(x.conv_id, x.turn): x.recall for x in QUERIES["ev18_block_recall"](spark, sf_dir).collect()}
    assert texts and all(got[k] == pytest.approx(v) for k, v in texts.items())
