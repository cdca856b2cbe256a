"""Transcription by a dictionary table of any size: one of checked size is sent to the tasks, so that nothing of the texts is
shuffled; entries of a larger one meet the texts in a join, so no task holds the dictionary."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import script
from quern.functions.script import _PYTHON_HANJA, transcribe_text
from quern.operators.relational import text_digest


def _by_all(df: DataFrame, entries: dict[str, str]):
    """A function from text to its transcription by a dictionary that is sent to the tasks once."""
    sent = df.sparkSession.sparkContext.broadcast((entries, sorted({len(k) for k in entries}, reverse=True)))

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else transcribe_text(t, *sent.value))

    return run


def transcribed(df: DataFrame, text: str, entries: DataFrame, name: str = "transcribed") -> DataFrame:
    """Adds the transcription of a text by a table (hanja, hangul), longest entry first, as transcribe_text defines it.

    Up to script.MAX_ENTRIES entries are a dictionary that each task holds. Beyond, each text sends the distinct pieces that an entry could be, as long as entries are and beginning with a Hanja; those that
    are entries come back as the text's own small dictionary. Texts are known by digest, so copies are looked up as one. A
    null text stays null, an empty dictionary leaves only what it does not know, rows with a null entry are no entries.
    """
    named = entries.where("hanja is not null and hangul is not null").select("hanja", "hangul")
    held = named.limit(script.MAX_ENTRIES + 1).toArrow()
    if held.num_rows <= script.MAX_ENTRIES:
        return df.withColumn(name, _by_all(df, dict(zip(*(held.column(c).to_pylist() for c in ("hanja", "hangul")), strict=True)))(F.col(text)))
    known = named.select(F.col("hanja").alias("__p"), F.col("hangul").alias("__s"))
    widths = sorted((r["n"] for r in known.select(F.length("__p").alias("n")).distinct().collect()), reverse=True)  # lengths of entries

    @F.pandas_udf("array<string>")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted({t[m.start() : m.start() + n] for m in _PYTHON_HANJA.finditer(t) for n in widths if m.start() + n <= len(t)}))

    @F.pandas_udf("string")
    def said(texts: pd.Series, hanja: pd.Series, hangul: pd.Series) -> pd.Series:
        def one(t, a, b):
            return t if t is None or a is None else transcribe_text(t, dict(zip(a, b, strict=True)), widths)

        return pd.Series([one(*x) for x in zip(texts, hanja, hangul, strict=True)], dtype=object)

    wanted = df.where(F.col(text).isNotNull()).select(text_digest(F.col(text)).alias("__d"), F.explode(pieces(F.col(text))).alias("__p")).distinct()
    own = wanted.join(known, "__p").groupBy("__d").agg(F.collect_list(F.struct("__p", "__s")).alias("__e"))
    own = own.select("__d", F.col("__e.__p").alias("__hanja"), F.col("__e.__s").alias("__hangul"))
    rows = df.withColumn("__k", text_digest(F.col(text))).join(own, F.col("__k") == F.col("__d"), "left")
    return rows.withColumn(name, said(F.col(text), F.col("__hanja"), F.col("__hangul"))).drop("__k", "__d", "__hanja", "__hangul")
