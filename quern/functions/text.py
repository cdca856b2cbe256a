"""General text functions as column expressions: sentences, URLs, years, labels, n-grams, hashes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that don't count as text (fixed values).
NON_TEXT = r"[\d\s\.\,\·\-\(\)\[\]\{\}\+\=\*\/]+"
#: Literal replacements before a split, in their order (fixed values): of web text, and the shorter one.
BREAKS = [
    ("! ", "!"), ("? ", "?"), ("… ", "…"), ("…", "…"), ("... ", "..."), ("...", "..."), ("、、、、、", "、、、、、"), ("・・・", "・・・"),
    (". ", "."), (".", "."), ("。", "。"), ("。 ", "。"), ("！ ", "！"), ("？", "？"), ("\n", ""),
]
SHORT_BREAKS = [("! ", "!"), ("? ", "?"), ("... ", "..."), ("…", "…"), (". ", "."), ("。", "。"), ("！", "！"), ("？", "？"), ("\n", "")]
_MARK = "<SPLIT>"


def sufficient_text(text: Column, least: float = 0.3) -> Column:
    """Whether enough of a text is left without digits, white space and punctuation; false for an empty one."""
    n = F.length(text)
    return F.when(n > 0, F.length(F.regexp_replace(text, NON_TEXT, "")) / n >= least).otherwise(F.lit(False))


def _pieces(text: Column, breaks: list[tuple[str, str]]) -> Column:
    out = text
    for old, new in breaks:
        out = F.replace(out, F.lit(old), F.lit(new + _MARK))
    trimmed = F.transform(F.split(out, _MARK), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(trimmed, lambda s: s != "")


def sentences(text: Column) -> Column:
    """Sentences of web text; every full stop ends one."""
    return _pieces(text, BREAKS)


def sentences_short(text: Column) -> Column:
    """Sentences that end in a mark and a blank; the whole text if there are none, nothing if it is blank."""
    out, whole = _pieces(text, SHORT_BREAKS), F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(F.size(out) > 0, out).when(whole != "", F.array(whole)).otherwise(F.array().cast("array<string>"))


def full_stops(text: Column) -> Column:
    """Pieces between full stops; the whole text if there are none."""
    return F.split(text, r"\.")


def join_sentences(parts: Column, eos: str = "</s>") -> Column:
    return F.concat(F.array_join(parts, eos), F.lit(eos))


def title_and_body(title: Column, body: Column) -> Column:
    """The body alone where there is no title; a null body stays null."""
    return F.when(title.isNull() | (F.length(title) == 0), body).otherwise(F.concat(title, F.lit("\n"), body))


def first_text(*columns: Column) -> Column:
    """The first of several texts that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def url_tail(text: Column) -> Column:
    """The address at the end of ``… URL: address``, null without one."""
    return F.nullif(F.regexp_extract(text, r" URL: (\S+)$", 1), F.lit(""))


def year_from_metadata(metadata: Column, year: Column | None = None) -> Column:
    found = F.nullif(F.regexp_extract(metadata, r"연도:\s*(\d{4})", 1), F.lit("")).try_cast("int")
    return F.coalesce(year, found) if year is not None else found


def year_of(date: Column | None, text: Column | None) -> Column:
    """The year of a date, or of a text that is a number; invalid ones and zero are null."""
    found = [F.year(date)] if date is not None else []
    found += [text.try_cast("int")] if text is not None else []
    return F.nullif(F.coalesce(*found), F.lit(0))


def year_bucket(year: Column, base: int = 1920, width: int = 5) -> Column:
    return F.floor((year - base) / width).cast("bigint")


def temporal_label(year: Column) -> Column:
    """A decade from 1500, a century before."""
    decade = (F.floor(year / 10) * 10).cast("bigint").cast("string")
    return F.when(year >= 1500, F.concat(decade, F.lit("년대"))).otherwise(F.concat((F.floor(year / 100) + 1).cast("bigint").cast("string"), F.lit("세기")))


def parse_temporal(text: Column) -> Column:
    """A year: four digits first, else a decade's middle, else a century's, else null."""
    number = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("int")
    return F.coalesce(number(r"(\d{4})"), number(r"(\d{3,4})년대") + 5, (number(r"(\d{1,2})세기") - 1) * 100 + 50)


def parse_score(text: Column, low: float = 0.0, high: float = 5.0, default: float = 2.5) -> Column:
    """Struct (score, failed): the first number within bounds, or the default."""
    found = F.nullif(F.regexp_extract(text, r"(\d+\.?\d*)", 1), F.lit("")).try_cast("double")
    return F.struct(F.when(found.isNull(), F.lit(default)).otherwise(F.least(F.greatest(found, F.lit(low)), F.lit(high))).alias("score"), found.isNull().alias("failed"))


def match_label(prediction: Column, labels: list[str]) -> Column:
    """Position of the equal label, else of the first one within the prediction, else null."""
    said = F.trim(prediction)
    out = F.coalesce(*(F.when(said == x, F.lit(i)) for i, x in enumerate(labels)), *(F.when(said.contains(x), F.lit(i)) for i, x in enumerate(labels)))
    return out.cast("int")


def answer_after(text: Column, marker: str = "<|assistant|>", ends: tuple[str, ...] = ("<|end_of_turn|>", "</s>")) -> Column:
    """Struct (answer, parsed): what follows the marker up to an end; the whole text where there is no marker."""
    has = F.contains(text, F.lit(marker))
    rest = F.when(has, F.substring_index(text, marker, -1)).otherwise(text)
    for e in ends:
        rest = F.substring_index(rest, e, 1)
    return F.struct(F.trim(rest).alias("answer"), has.alias("parsed"))


def strip_echo(text: Column, within: int = 60) -> Column:
    """What follows ``: `` where one stands near the beginning."""
    return F.when(F.instr(F.substring(text, 1, within), ": ") > 0, F.substring(text, F.instr(text, ": ") + 2, F.length(text))).otherwise(text)


def halves(text: Column) -> Column:
    """Struct (input, target) of a text of more than six words, cut in the middle; null otherwise."""
    words = F.split(F.trim(text), r"\s+")
    half = F.floor(F.size(words) / 2).cast("int")
    part = lambda a, n: F.array_join(F.slice(words, a, n), " ")
    return F.when(F.size(words) > 6, F.struct(part(F.lit(1), half).alias("input"), part(half + 1, F.size(words) - half).alias("target")))


def pair_text(first: Column, second: Column, names: tuple[str, str] = ("sentence1", "sentence2")) -> Column:
    return F.concat(F.lit(f"{names[0]}: "), first, F.lit(f" {names[1]}: "), second)


def score_text(score: Column) -> Column:
    return F.format_string("%.1f", score.cast("double"))


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility composition with single blanks; Spark has no expression for it."""
    return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()))


@F.pandas_udf(T.StringType())
def byte_placeholders(texts: pd.Series) -> pd.Series:
    """Decodes runs of ``<0xE6>`` placeholders as UTF-8; invalid bytes become the replacement character."""
    import re

    run = re.compile(r"(?:<0x[0-9A-Fa-f]{2}>)+")
    decode = lambda m: bytes(int(x, 16) for x in re.findall(r"0x(..)", m[0])).decode("utf-8", "replace")
    return texts.map(lambda t: None if t is None else run.sub(decode, t))


def split_specials(text: Column, specials: list[str]) -> Column:
    """Segments of a text, special tokens apart, the longest first."""
    quoted = "|".join(r"\Q" + s + r"\E" for s in sorted(specials, key=len, reverse=True))
    return F.regexp_extract_all(text, F.lit(rf"(?s)({quoted}|.+?(?={quoted}|$(?!\n)))"), F.lit(1))


def utf8_length(text: Column, least: int = 0) -> Column:
    return F.greatest(F.octet_length(text), F.lit(least))


def ngrams(word: Column, low: int = 3, high: int = 18) -> Column:
    """Character n-grams of all sizes, by their start and then size; single characters at either end are left out."""
    return ngrams_of(word, list(range(low, high + 1)))


def ngrams_of(word: Column, sizes: list[int]) -> Column:
    """Character n-grams of the given sizes."""
    n = F.length(word)
    starts = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    own = F.array(*(F.lit(s) for s in sorted(sizes)))
    at = lambda i: F.transform(F.filter(own, lambda s: (i + s - 1 <= n) & ~((s == 1) & ((i == 1) | (i == n)))), lambda s: F.substring(word, i, s))
    return F.flatten(F.transform(starts, at))


def _hex_bytes(text: Column) -> Column:
    """The UTF-8 bytes of a text as pairs of hex digits, in one pass."""
    return F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(".."), F.lit(0))


def fnv1a32(text: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes."""
    codes = F.transform(_hex_bytes(text), lambda b: F.conv(b, 16, 10).cast("bigint"))
    step = lambda h, b: (h.bitwiseXOR(b) * F.lit(16777619).cast("bigint")).bitwiseAND(F.lit(4294967295).cast("bigint"))
    return F.aggregate(codes, F.lit(2166136261).cast("bigint"), step)


def utf8_bytes(text: Column, base: int = 0) -> Column:
    """The UTF-8 bytes of a text as ids from a base."""
    return F.transform(_hex_bytes(text), lambda b: F.conv(b, 16, 10).cast("int") + base)
