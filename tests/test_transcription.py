"""Transcription by a dictionary table against the greedy loop over the whole dictionary."""

from quern import registry
from quern.functions import script
from quern.operators.transcription import transcribed
from quern.plans import q_text


def test_query_equals_the_loop(spark, sf_dir):
    entries = {r["hanja"]: r["hangul"] for r in registry.QUERIES["src7_dictionary"](spark, sf_dir).collect()}
    widths = sorted({len(k) for k in entries}, reverse=True)
    want = {r["s"]: script.transcribe_text(r["s"], entries, widths) for r in q_text._words(spark, sf_dir).collect()}
    got = {r["s"]: r["out"] for r in registry.QUERIES["ko10_table_transcription"](spark, sf_dir).collect()}
    assert got == want and len(widths) > 2


def test_a_dictionary_of_a_million_entries(spark):
    base = 0x4E00
    pairs = spark.range(1_000_000).selectExpr(
        f"concat(decode(unhex(hex({base} + id div 1000)), 'UTF-16BE'), decode(unhex(hex({base} + id % 1000)), 'UTF-16BE')) AS hanja", "decode(unhex(hex(44032 + id % 11000)), 'UTF-16BE') || '가' AS hangul"
    )
    said = lambda a, b: chr(44032 + (a * 1000 + b) % 11000) + "가"
    text = "".join(chr(base + x) for x in (5, 7, 999, 998)) + " x " + chr(base + 3) + chr(base + 5000)
    rows = spark.createDataFrame([(1, text), (2, text), (3, None), (4, ""), (5, "none")], "id int, t string")
    got = {r["id"]: r["out"] for r in transcribed(rows, "t", pairs, "out").collect()}
    want = said(5, 7) + said(999, 998) + " x " + chr(base + 3) + chr(base + 5000)
    assert got == {1: want, 2: want, 3: None, 4: "", 5: "none"}


def test_longer_entries_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, "音樂樂 音A"), (2, "女鬼")], "id int, t string")
    entries = spark.createDataFrame([("音樂", "음악"), ("樂", "락"), ("女", "녀"), ("音A", "음에"), (None, "x"), ("鬼", None)], "hanja string, hangul string")
    said = lambda e: {r["id"]: r["transcribed"] for r in transcribed(rows, "t", e).collect()}
    assert said(entries) == {1: "음악락 음에", 2: "여鬼"}
    assert said(entries.limit(0)) == {1: "音樂樂 音A", 2: "女鬼"}
    assert transcribed(rows.limit(0), "t", entries).count() == 0


def test_a_dictionary_of_checked_size_moves_no_text(spark, sf_dir):
    plan = registry.QUERIES["ko10_table_transcription"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # before, each piece of a word that could be an entry was shuffled


def test_sent_and_joined_dictionaries_agree(spark, sf_dir, monkeypatch):
    words, entries = q_text._words(spark, sf_dir).where("length(s) > 3").limit(2000).localCheckpoint(), q_text.dictionary(spark, sf_dir)
    said = lambda: sorted((r["s"], r["out"]) for r in transcribed(words, "s", entries, "out").collect())
    sent = said()
    monkeypatch.setattr(script, "MAX_ENTRIES", 10)
    assert said() == sent and len(sent) == 2000 and any(a != b for a, b in sent)
