"""Hanja and Hangul functions: predicates, ratios, transcription by dictionary, and jamo.

Columns in, columns out, but for greedy transcription and regrouping of jamo, which carry state along a text and are
Arrow-batched pandas UDFs over a dictionary of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of Unicode: the nine ranges of CJK ideographs, and the basic block alone.
HANJA = (
    r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}"
    r"\x{2B820}-\x{2CEAF}\x{2CEB0}-\x{2EBEF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}"
)
HANJA_BMP = r"\x{4E00}-\x{9FFF}"
KANA = r"\x{3040}-\x{30FF}"
#: Fixed values of Korean spelling: initial sounds of single characters.
INITIAL_SOUND = {
    "녀": "여", "념": "염", "뇨": "요", "뉴": "유", "니": "이", "랴": "야", "려": "여", "례": "예", "료": "요",
    "류": "유", "리": "이", "림": "임", "라": "나", "래": "내", "로": "노", "뢰": "뇌", "루": "누", "르": "느",
}
#: Fixed values of Unicode: jamo in the order that Hangul syllables are composed of.
LEADS = list("ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ")
VOWELS = list("ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ")
TAILS = list(" ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ")
_PYTHON_HANJA = re.compile(
    "[一-鿿㐀-䶿\U00020000-\U0002a6df\U0002a700-\U0002b73f\U0002b740-\U0002b81f"
    "\U0002b820-\U0002ceaf\U0002ceb0-\U0002ebef豈-﫿\U0002f800-\U0002fa1f]"
)


def chars(text: Column) -> Column:
    """Code points of a text."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def has_hanja(text: Column, bmp_only: bool = False) -> Column:
    return text.rlike(f"[{HANJA_BMP if bmp_only else HANJA}]")


def is_all_hanja(text: Column) -> Column:
    """True for a non-empty text of Hanja alone."""
    return text.rlike(f"^[{HANJA}]+$")


def hanja_mask(text: Column) -> Column:
    """Per code point, whether it is Hanja."""
    return F.transform(chars(text), lambda c: c.rlike(f"[{HANJA}]"))


def hanja_ratio(text: Column) -> Column:
    """Share of code points in the basic block; 0 for an empty text."""
    n = F.length(text)
    return F.when(n > 0, F.regexp_count(text, F.lit(f"[{HANJA_BMP}]")) / n).otherwise(F.lit(0.0))


def token_hanja_ratio(encoder: Column, decoder: Column, flags: Column, pad: int, ignore: int = -100) -> Column:
    """Larger share of tokens with Hanja of two id arrays; flags is an array<boolean> by id, unknown ids count as none."""

    def share(ids: Column) -> Column:
        valid = F.filter(ids, lambda i: (i != pad) & (i != ignore))
        hit = F.filter(valid, lambda i: F.coalesce(F.get(flags, i), F.lit(False)))
        return F.when(F.size(valid) > 0, F.size(hit) / F.size(valid)).otherwise(F.lit(0.0))

    return F.greatest(share(encoder), share(decoder))


def hanja_class(ratio: Column, threshold: float = 0.18) -> Column:
    return F.when(ratio >= threshold, "hanja_heavy").otherwise("hanja_light")


def has_kana(text: Column) -> Column:
    return text.rlike(f"[{KANA}]")


def script_tag(text: Column) -> Column:
    return F.when(has_hanja(text, bmp_only=True), "<hanja>").otherwise("<hangul>")


def split_by_script(text: Column) -> Column:
    """Runs of Hanja and of anything else, each split at white space."""
    runs = F.regexp_extract_all(text, F.lit(f"([{HANJA}]+|[^{HANJA}]+)"), F.lit(1))
    return F.filter(F.flatten(F.transform(runs, lambda r: F.split(r, r"\s+"))), lambda s: s != "")


def initial_sound(syllable: Column) -> Column:
    """The initial-sound form of one syllable, itself if it has none."""
    pairs = F.create_map(*(F.lit(x) for kv in INITIAL_SOUND.items() for x in kv))
    return F.coalesce(F.element_at(pairs, syllable), syllable)


def dictionary(lines: DataFrame, line: str = "value", priority: str = "priority", position: str = "position") -> DataFrame:
    """Rows (hanja, hangul) of tab-separated lines: comments, blanks and lines without two parts go; of an entry that
    repeats, the last line of the file of highest priority stays. Entries of unequal length are an error."""
    text = F.trim(F.col(line))
    parts = F.split(text, "\t")
    kept = lines.where((text != "") & ~F.startswith(text, F.lit("#")) & (F.size(parts) == 2))
    rows = kept.select(F.trim(parts[0]).alias("hanja"), F.trim(parts[1]).alias("hangul"), priority, position)
    best = Window.partitionBy("hanja").orderBy(F.desc(priority), F.desc(position))
    rows = rows.withColumn("__r", F.row_number().over(best)).where("__r = 1")
    same = F.length("hanja") == F.length("hangul")
    checked = F.when(same, F.col("hangul")).otherwise(F.raise_error(F.concat(F.lit("unequal lengths: "), F.col("hanja"))).cast("string"))
    return rows.select("hanja", checked.alias("hangul"))


#: Entries of a dictionary that is sent to the executors; a larger one is refused.
MAX_ENTRIES = 500_000


def load_dictionary(rows: DataFrame, limit: int = MAX_ENTRIES) -> dict[str, str]:
    """A dictionary table on the driver, of checked size."""
    found = rows.select("hanja", "hangul").limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"the dictionary has more than {limit} entries")
    return {r["hanja"]: r["hangul"] for r in found}


def transcribe_text(text: str, entries: dict[str, str], widths: list[int]) -> str:
    """Longest entry first; a single character takes its initial-sound form; what is unknown stays."""
    if not _PYTHON_HANJA.search(text):
        return text
    out, i = [], 0
    while i < len(text):
        step, put = 1, text[i]
        if _PYTHON_HANJA.match(put):
            for n in widths:
                if n > 1 and (got := entries.get(text[i : i + n])) is not None and i + n <= len(text):
                    step, put = n, got
                    break
            else:
                got = entries.get(put)
                put = put if got is None else INITIAL_SOUND.get(got, got)
        out.append(put)
        i += step
    return "".join(out)


def transcriber(entries: dict[str, str]) -> Callable[[Column], Column]:
    """A function from text to its transcription, by Arrow batches."""
    widths = sorted({len(k) for k in entries}, reverse=True)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else transcribe_text(t, entries, widths))

    return run


def transcribe_single(text: Column, entries: dict[str, str]) -> Column:
    """Transcription in expressions, for a dictionary of single characters."""
    known = {k: INITIAL_SOUND.get(v, v) for k, v in entries.items() if len(k) == 1 and len(v) == 1}
    return F.translate(text, "".join(known), "".join(known.values()))


def direction(text: Column, transcribed: Column, way: Column) -> Column:
    """Struct (encoder, decoder): hangul_to_hanja transcribes the encoder's side, hanja_to_hangul the decoder's."""
    return F.struct(
        F.when(way == "hangul_to_hanja", transcribed).otherwise(text).alias("encoder"),
        F.when(way == "hanja_to_hangul", transcribed).otherwise(text).alias("decoder"),
    )


def annotated(text: Column, transcribed: Column) -> Column:
    return F.when(has_hanja(text), F.concat(text, F.lit("("), transcribed, F.lit(")"))).otherwise(text)


def is_korean(char: Column) -> Column:
    """A Hangul syllable or a compatibility jamo."""
    cp = F.ascii(char)
    return cp.between(44032, 55203) | cp.between(12593, 12643)


def _pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (at + 1).cast("int"))


def decompose(char: Column) -> Column:
    """Struct (lead, vowel, tail) of a syllable or jamo, blanks where there is none; null for anything else."""
    cp = F.ascii(char)
    i = cp - 44032
    lead, vowel, tail = F.floor(i / 588), F.floor((i % 588) / 28), i % 28
    blank = F.lit(" ")
    make = lambda a, b, c: F.struct(a.alias("lead"), b.alias("vowel"), c.alias("tail"))
    return (
        F.when(cp.between(44032, 55203), make(_pick(LEADS, lead), _pick(VOWELS, vowel), _pick(TAILS, tail)))
        .when(cp.between(12593, 12622), make(char, blank, blank))
        .when(cp.between(12623, 12643), make(blank, char, blank))
    )


def compose(lead: Column, vowel: Column, tail: Column) -> Column:
    """The syllable of a lead, a vowel and a tail (blank for none)."""
    at = lambda values, c: F.array_position(F.array(*(F.lit(v) for v in values)), c) - 1
    cp = 44032 + 588 * at(LEADS, lead) + 28 * at(VOWELS, vowel) + at(TAILS, tail)
    return F.decode(F.unhex(F.hex(cp)), "UTF-16BE")


def unified(text: Column) -> Column:
    """Compatibility ideographs (U+F900 to U+FAFF, U+2F800 to U+2FA1F) as the unified ones that Unicode gives for them."""
    import unicodedata

    table = {c: unicodedata.normalize("NFC", c) for lo, hi in ((0xF900, 0xFB00), (0x2F800, 0x2FA20)) for c in map(chr, range(lo, hi))}
    known = {c: u for c, u in table.items() if u != c and len(u) == 1}
    return F.translate(text, "".join(known), "".join(known.values()))


@cache
def _jamo_table() -> dict[int, str]:
    """Three jamo of each syllable and jamo, a dash for what is missing."""
    whole = {44032 + i: LEADS[i // 588] + VOWELS[i % 588 // 28] + TAILS[i % 28] for i in range(11172)}
    single = {c: f"{chr(c)}  " if c < 12623 else f" {chr(c)} " for c in range(12593, 12644)}
    return {c: x.replace(" ", "-") for c, x in (whole | single).items()}


@F.pandas_udf(T.StringType())
def _to_jamo(texts: pd.Series) -> pd.Series:
    table = _jamo_table()
    return texts.map(lambda t: None if t is None else t.translate(table))


def jamo_sentence(text: Column) -> Column:
    """Three jamo for each Korean character, a dash for what is missing, and single blanks.

    By Arrow batches: Spark's translate puts one character for one, and a transform over all characters of whole texts
    takes several times as long.
    """
    return F.regexp_replace(_to_jamo(text), r"\s+", " ")


_WHOLE = re.compile(f"[{''.join(LEADS)}][{''.join(VOWELS)}][{''.join(TAILS)}-]")


@F.pandas_udf(T.StringType())
def jamo_to_word(jamo: pd.Series) -> pd.Series:
    """Syllables of a jamo string, three at a time; what makes no whole syllable stays."""
    lead, vowel, tail = ({c: i for i, c in enumerate(part)} for part in (LEADS, VOWELS, TAILS))

    def syllable(m):
        a, b, c = m[0]
        return chr(44032 + 588 * lead[a] + 28 * vowel[b] + tail.get(c, 0))

    return jamo.map(lambda t: None if t is None else _WHOLE.sub(syllable, t))


def keep_cjk(text: Column) -> Column:
    """Replaces runs outside Hanja, Hangul, kana, brackets, digits and blanks by nothing."""
    allowed = rf"{HANJA}\x{{31C0}}-\x{{31EF}}\x{{2FF0}}-\x{{2FFF}}\x{{AC00}}-\x{{D7A3}}ㄱ-ㅎㅏ-ㅣ·ぁ-ゔァ-ヴー々〆〤【】『』「」\(\) \d"
    return F.regexp_replace(text, f"[^{allowed}]+", "")


def without_stopwords(words: Column, stopwords: list[str]) -> Column:
    return F.filter(words, lambda w: ~w.isin(stopwords))


def morphemes(tokenize: Callable[[str], list[str]], entries: dict[str, str], keep_spaces: bool = False) -> Callable[[Column], Column]:
    """Morphemes of a text with its Hanja kept: the transcription is tokenised, and offsets are mapped back one to one."""
    widths = sorted({len(k) for k in entries}, reverse=True)

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            plain, out, at = transcribe_text(text, entries, widths), [], 0
            for m in tokenize(plain):
                i = plain.find(m, at)
                if i < 0:
                    continue
                if keep_spaces and i > at:
                    out.append(text[at:i])
                out.append(text[i : i + len(m)])
                at = i + len(m)
            if keep_spaces and at < len(text):
                out.append(text[at:])
            return out

        return texts.map(one)

    return run
