"""Queries: text and script functions. The tables hold no Hanja or Hangul, so letters of documents are written as such."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import script as sc
from quern.functions import text as tx
from quern.operators.transcription import transcribed as transcribed_by
from quern.queryset import query, table
from quern.sources.sinks import written

#: A toy dictionary.
ENTRIES = {"美": "미", "術": "술", "女": "녀", "韓": "한", "國": "국", "語": "어", "音": "음", "樂": "락", "音樂": "음악"}
#: Letters and what stands for them: Hanja of the dictionary and outside it, Hangul, jamo, kana, compatibility ideographs.
LETTERS = ("therniasdoluwybfgcmpjv", "音樂韓國語女가美術한로례ㄱㅏ녀라리あカ𠀀\uf914\uf90a")
_MIXED = f"(SELECT doc_id AS id, translate(text, '{LETTERS[0]}', '{LETTERS[1]}') AS s FROM documents)"
_WORDS = f"(SELECT DISTINCT unnest(string_split(s, ' ')) AS s FROM {_MIXED})"
_CHARS = f"(SELECT DISTINCT unnest(regexp_extract_all(s, '(?s).')) AS c FROM {_MIXED})"
_HANJA = sc.HANJA
#: The transcription in SQL: the one long entry first, then single characters in their initial-sound form.
_SAID = "translate(replace(s, '音樂', '음악'), '美術女韓國語音樂', '미술여한국어음락')"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.translate("text", *LETTERS).alias("s"))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select(F.explode(F.split("s", " ")).alias("s")).distinct()


def _characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select(F.explode(F.array_distinct(sc.chars(F.col("s")))).alias("c")).distinct()


# --- scripts -----------------------------------------------------------------------------------------------------


@query("ko1_hanja_predicates", f"SELECT s, regexp_matches(s, '[{_HANJA}]') AS any_hanja, regexp_full_match(s, '[{_HANJA}]+') AS all_hanja, regexp_matches(s, '[{sc.HANJA_BMP}]') AS basic FROM {_WORDS}")
def hanja_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s")
    return _words(spark, sf_dir).select("s", sc.has_hanja(s).alias("any_hanja"), sc.is_all_hanja(s).alias("all_hanja"), sc.has_hanja(s, True).alias("basic"))


@query("ko4_hanja_mask", f"SELECT id, md5(regexp_replace(regexp_replace(replace(s, '1', '0'), '[{_HANJA}]', '1', 'g'), '[^1]', '0', 'g')) AS mask FROM {_MIXED}")
def hanja_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = F.transform(sc.hanja_mask(F.col("s")), lambda b: F.when(b, "1").otherwise("0"))
    return _texts(spark, sf_dir).select("id", F.md5(F.array_join(mask, "")).alias("mask"))


_RATIO = f"(SELECT id, CASE WHEN length(s) > 0 THEN len(regexp_extract_all(s, '[{sc.HANJA_BMP}]')) / CAST(length(s) AS DOUBLE) ELSE 0.0 END AS ratio FROM {_MIXED})"


@query("ko6_hanja_ratio", f"SELECT id, ratio, CASE WHEN ratio >= 0.18 THEN 'hanja_heavy' ELSE 'hanja_light' END AS kind FROM {_RATIO}")
def hanja_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = sc.hanja_ratio(F.col("s"))
    return _texts(spark, sf_dir).select("id", ratio.alias("ratio"), sc.hanja_class(ratio).alias("kind"))


_LENGTHS = r"(SELECT doc_id, list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''), lambda w: CAST(length(w) AS INTEGER)) AS e FROM documents)"
_SHARE = "CASE WHEN len(list_filter({0}, lambda i: i <> 3)) > 0 THEN len(list_filter({0}, lambda i: i IN (2, 5, 7))) / CAST(len(list_filter({0}, lambda i: i <> 3)) AS DOUBLE) ELSE 0.0 END"


@query("ko7_token_hanja_ratio", f"SELECT doc_id, greatest({_SHARE.format('e')}, {_SHARE.format('d')}) AS ratio FROM (SELECT doc_id, e, list_slice(e, 1, 9) AS d FROM {_LENGTHS})")
def token_hanja_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word lengths stand for ids: 3 pads, and 2, 5 and 7 carry the flag."""
    ids = F.transform(F.filter(F.split("text", r"\s+"), lambda w: w != ""), F.length)
    rows = table(spark, sf_dir, "documents").select("doc_id", ids.alias("e")).withColumn("d", F.concat(F.slice("e", 1, 9), F.array(F.lit(-100))))
    flags = F.array(*(F.lit(i in (2, 5, 7)) for i in range(8)))
    return rows.select("doc_id", sc.token_hanja_ratio(F.col("e"), F.col("d"), flags, 3).alias("ratio"))


@query("ko9_transcribed", f"SELECT id, md5({_SAID}) AS out FROM {_MIXED}")
def transcribed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("id", F.md5(sc.transcriber(ENTRIES)(F.col("s"))).alias("out"))


@query("ko9_single_characters", f"SELECT id, md5(translate(s, '美術女韓國語音樂', '미술여한국어음락')) AS out FROM {_MIXED}")
def single_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("id", F.md5(sc.transcribe_single(F.col("s"), ENTRIES)).alias("out"))


@query("ko11_initial_sound", f"SELECT c, translate(c, '녀라로례리', '여나노예이') AS out FROM {_CHARS}")
def initial_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _characters(spark, sf_dir).select("c", sc.initial_sound(F.col("c")).alias("out"))


@query("ko14_split_by_script", f"SELECT id, md5(array_to_string(list_filter(flatten(list_transform(regexp_extract_all(s, '[{_HANJA}]+|[^{_HANJA}]+'), lambda r: regexp_split_to_array(r, '\\s+'))), lambda x: x <> ''), '|')) AS parts FROM {_MIXED}")
def split_by_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("id", F.md5(F.array_join(sc.split_by_script(F.col("s")), "|")).alias("parts"))


#: Three jamo of a syllable c in SQL, with {0} for no tail.
_CODE = "(unicode(c) - 44032)"
_JAMO = (
    f"substr('{''.join(sc.LEADS)}', CAST({_CODE} // 588 + 1 AS INTEGER), 1) || substr('{''.join(sc.VOWELS)}', CAST({_CODE} % 588 // 28 + 1 AS INTEGER), 1)"
    f" || substr('{{0}}{''.join(sc.TAILS[1:])}', CAST({_CODE} % 28 + 1 AS INTEGER), 1)"
)
_SYLLABLE = "unicode(c) BETWEEN 44032 AND 55203"
_THREE = f"CASE WHEN {_SYLLABLE} THEN {_JAMO} WHEN unicode(c) BETWEEN 12593 AND 12622 THEN c || '{{0}}{{0}}' WHEN unicode(c) BETWEEN 12623 AND 12643 THEN '{{0}}' || c || '{{0}}'"
_ALL = "array_to_string(list_transform(regexp_extract_all(s, '(?s).'), lambda c: {0}), '')"


@query("ko15_decomposed", f"SELECT c, {_THREE.format(' ')} END AS parts FROM {_CHARS}")
def decomposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sc.decompose(F.col("c"))
    return _characters(spark, sf_dir).select("c", F.concat(d["lead"], d["vowel"], d["tail"]).alias("parts"))


@query("ko16_composed", f"SELECT c, c AS syllable FROM {_CHARS} WHERE {_SYLLABLE}")
def composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _characters(spark, sf_dir).where(F.ascii("c").between(44032, 55203)).withColumn("d", sc.decompose(F.col("c")))
    return rows.select("c", sc.compose(F.col("d.lead"), F.col("d.vowel"), F.col("d.tail")).alias("syllable"))


@query("ko17_is_korean", f"SELECT c, {_SYLLABLE} OR unicode(c) BETWEEN 12593 AND 12643 AS korean FROM {_CHARS}")
def is_korean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _characters(spark, sf_dir).select("c", sc.is_korean(F.col("c")).alias("korean"))


@query("ko18_jamo_sentence", rf"SELECT id, md5(regexp_replace({_ALL.format(_THREE.format('-') + ' ELSE c END')}, '\s+', ' ', 'g')) AS jamo FROM {_MIXED}")
def jamo_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("id", F.md5(sc.jamo_sentence(F.col("s"))).alias("jamo"))


@query("ko19_jamo_to_word", rf"SELECT id, md5(regexp_replace(replace(replace(s, 'ㄱ', 'ㄱ--'), 'ㅏ', '-ㅏ-'), '\s+', ' ', 'g')) AS word FROM {_MIXED}")
def jamo_to_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Back from jamo; a single jamo is no whole syllable and keeps its dashes."""
    return _texts(spark, sf_dir).select("id", F.md5(sc.jamo_to_word(sc.jamo_sentence(F.col("s")))).alias("word"))


@query("ko20_keep_cjk", rf"SELECT id, md5(regexp_replace(s, '[^{_HANJA}\x{{31C0}}-\x{{31EF}}\x{{2FF0}}-\x{{2FFF}}\x{{AC00}}-\x{{D7A3}}ㄱ-ㅎㅏ-ㅣ·ぁ-ゔァ-ヴー々〆〤【】『』「」() 0-9]+', '', 'g')) AS kept FROM {_MIXED}")
def keep_cjk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("id", F.md5(sc.keep_cjk(F.col("s"))).alias("kept"))


@query("ko21_annotated", f"SELECT s, CASE WHEN regexp_matches(s, '[{_HANJA}]') THEN s || '(' || {_SAID} || ')' ELSE s END AS out FROM {_WORDS}")
def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).select("s", sc.annotated(F.col("s"), sc.transcriber(ENTRIES)(F.col("s"))).alias("out"))


def _blanks(text: str) -> list[str]:
    return [w for w in text.split(" ") if w]


@query("ko22_morphemes", f"SELECT id, CAST(len(x) AS INTEGER) AS n, md5(array_to_string(x, '|')) AS parts FROM (SELECT id, list_filter(string_split(s, ' '), lambda w: w <> '') AS x FROM {_MIXED})")
def morphemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _texts(spark, sf_dir).select("id", sc.morphemes(_blanks, ENTRIES)(F.col("s")).alias("x"))
    return rows.select("id", F.size("x").alias("n"), F.md5(F.array_join("x", "|")).alias("parts"))


@query("ko23_without_stopwords", "SELECT doc_id, CAST(len(list_filter(string_split(text, ' '), lambda w: w NOT IN ('the', 'and', 'of'))) AS INTEGER) AS n FROM documents")
def without_stopwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = sc.without_stopwords(F.split("text", " "), ["the", "and", "of"])
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).alias("n"))


@query("ko24_script_tag", f"SELECT s, CASE WHEN regexp_matches(s, '[{sc.HANJA_BMP}]') THEN '<hanja>' ELSE '<hangul>' END AS tag FROM {_WORDS}")
def script_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).select("s", sc.script_tag(F.col("s")).alias("tag"))


@query("ko25_direction", f"SELECT id, md5(CASE WHEN id % 3 = 0 THEN {_SAID} ELSE s END) AS encoder, md5(CASE WHEN id % 3 = 1 THEN {_SAID} ELSE s END) AS decoder FROM {_MIXED}")
def direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id") % 3
    way = F.when(k == 0, "hangul_to_hanja").when(k == 1, "hanja_to_hangul").otherwise("none")
    d = sc.direction(F.col("s"), sc.transcriber(ENTRIES)(F.col("s")), way)
    return _texts(spark, sf_dir).select("id", d.alias("d")).select("id", F.md5("d.encoder").alias("encoder"), F.md5("d.decoder").alias("decoder"))


@query("src7_dictionary", rf"SELECT s AS hanja, CASE WHEN length(s) > 3 THEN {_SAID} ELSE translate(s, '美術女韓國語音樂', '미술녀한국어음락') END AS hangul FROM {_WORDS} WHERE regexp_full_match(s, '[{_HANJA}]+')")
def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files of lines: the later one holds the longer words anew; comments and lines without two parts are between."""
    return _dictionary(spark, sf_dir, _words(spark, sf_dir))


def _dictionary(spark: SparkSession, sf_dir: str, words: DataFrame) -> DataFrame:
    words = words.where(sc.is_all_hanja(F.col("s")))
    plain = F.translate("s", "美術女韓國語音樂", "미술녀한국어음락")
    line = lambda rows, said, n: rows.select(F.concat("s", F.lit("\t"), said).alias("value"), F.lit(n).alias("priority"), F.lit(0).alias("position"))
    names = table(spark, sf_dir, "region").select(F.explode(F.array(F.concat(F.lit("# "), "r_name", F.lit("\tx")), F.col("r_name"), F.lit(" "))).alias("value"), F.lit(2).alias("priority"), F.lit(0).alias("position"))
    later = words.where(F.length("s") > 3)
    return sc.dictionary(line(words, plain, 0).unionByName(line(later, sc.transcriber(ENTRIES)(F.col("s")), 1)).unionByName(names))


@query("ko10_table_transcription")
def table_transcription(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of the texts by the dictionary that was read from lines (no entry holds a space); a test holds it against the
    greedy loop over all entries."""
    words = written(_words(spark, sf_dir), "words")  # read three times
    return transcribed_by(words, "s", _dictionary(spark, sf_dir, words), "out").select("s", "out")


@query("flt14_kana", f"SELECT s, regexp_matches(s, '[あカ]') AS kana FROM {_WORDS}")
def kana(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).select("s", sc.has_kana(F.col("s")).alias("kana"))


@query("flt5_contains_hanja", f"SELECT s FROM {_WORDS} WHERE regexp_matches(s, '[音樂韓國語女美術]')")
def contains_hanja(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).where(sc.has_hanja(F.col("s"), bmp_only=True))


@query("ss3_hanja_routes", f"SELECT id, CASE WHEN ratio >= 0.5 THEN 'hanja_heavy' ELSE 'hanja_light' END AS buffer FROM {_RATIO}")
def hanja_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("id", sc.hanja_class(sc.hanja_ratio(F.col("s")), 0.5).alias("buffer"))


@query("ko13_unified", f"SELECT id, md5(translate(s, '\uf914\uf90a', '樂金')) AS s FROM {_MIXED}")
def unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("id", F.md5(sc.unified(F.col("s"))).alias("s"))


# --- general text ------------------------------------------------------------------------------------------------


def _chain(breaks) -> str:
    out = "text"
    for old, new in breaks:
        a, b = (f"'{x}'" if x != "\n" else "chr(10)" for x in (old, new + "<SPLIT>"))
        out = f"replace({out}, {a}, {b})"
    trim = r"regexp_replace(s, '^\s+|\s+$', '', 'g')"
    return f"list_filter(list_transform(string_split({out}, '<SPLIT>'), lambda s: {trim}), lambda s: s <> '')"


@query("tx1_sentences", f"SELECT doc_id, CAST(len(x) AS INTEGER) AS n, md5(array_to_string(x, '|')) AS digest FROM (SELECT doc_id, {_chain(tx.BREAKS)} AS x FROM documents)")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", tx.sentences(F.col("text")).alias("x"))
    return rows.select("doc_id", F.size("x").alias("n"), F.md5(F.array_join("x", "|")).alias("digest"))


@query("tx2_sentences_short", f"SELECT doc_id, CAST(len(x) AS INTEGER) AS n, md5(array_to_string(x, '|')) AS digest FROM (SELECT doc_id, {_chain(tx.SHORT_BREAKS)} AS x FROM documents)")
def sentences_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", tx.sentences_short(F.col("text")).alias("x"))
    return rows.select("doc_id", F.size("x").alias("n"), F.md5(F.array_join("x", "|")).alias("digest"))


@query("tx3_full_stop_split", "SELECT doc_id, CAST(len(string_split(text, '.')) AS INTEGER) AS n FROM documents")
def full_stop_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tx.full_stops(F.col("text"))).alias("n"))


@query("tx4_joined_sentences", f"SELECT doc_id, md5(array_to_string(x, '</s>') || '</s>') AS digest FROM (SELECT doc_id, {_chain(tx.BREAKS)} AS x FROM documents)")
def joined_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.join_sentences(tx.sentences(F.col("text")))).alias("digest"))


@query("tx5_url_tail", r"SELECT page_id, nullif(regexp_extract(m, ' URL: (\S+)$', 1), '') AS tail FROM (SELECT page_id, CASE WHEN page_id % 4 > 0 THEN concat('x URL: ', url) ELSE 'x' END AS m FROM pages)")
def url_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.when(F.col("page_id") % 4 > 0, F.concat(F.lit("x URL: "), F.col("url"))).otherwise("x")
    return table(spark, sf_dir, "pages").select("page_id", tx.url_tail(m).alias("tail"))


@query("tx6_year_from_metadata", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN CAST(year(o_orderdate) AS INTEGER) END AS year FROM orders")
def year_from_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two spellings of a year, one of two digits alone, and none."""
    k, year = F.col("o_orderkey") % 4, F.year("o_orderdate").cast("string")
    m = F.when(k == 0, F.concat(F.lit("연도: "), year, F.lit(" 시기"))).when(k == 1, F.concat(F.lit("연도:"), year)).when(k == 2, F.concat(F.lit("연도: "), F.substring(year, 1, 2)))
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.year_from_metadata(m.otherwise("없음")).alias("year"))


@query("tx7_year_of", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS by_date, CASE WHEN o_orderkey % 3 = 1 THEN CAST(o_orderkey AS INTEGER) END AS by_text FROM orders")
def year_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, F.lit("0")).when(k == 1, F.col("o_orderkey").cast("string")).otherwise("n/a")
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.year_of(F.col("o_orderdate"), None).alias("by_date"), tx.year_of(None, text).alias("by_text"))


@query("tx8_year_bucket", "SELECT o_orderkey, CAST(floor((year(o_orderdate) - 1995) / CAST(5 AS DOUBLE)) AS BIGINT) AS bucket FROM orders")
def year_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.year_bucket(F.year("o_orderdate"), 1995, 5).alias("bucket"))


@query("tx9_temporal_label", "SELECT o_orderkey, CASE WHEN y >= 1500 THEN y // 10 || '0년대' ELSE (y // 100 + 1) || '세기' END AS label FROM (SELECT o_orderkey, 1000 + o_orderkey % 1030 AS y FROM orders)")
def temporal_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.temporal_label(F.col("o_orderkey") % 1030 + 1000).alias("label"))


@query("tx10_parse_temporal", "SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN year(o_orderdate) WHEN 1 THEN 105 + o_orderkey % 900 WHEN 2 THEN (9 + o_orderkey % 11) * 100 + 50 END AS INTEGER) AS year FROM orders")
def parse_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of a year, a decade of three digits, a century, and nothing."""
    k, of = F.col("o_orderkey"), lambda n: F.col("o_orderkey") % n
    said = F.when(k % 4 == 0, F.concat(F.lit("약 "), F.year("o_orderdate").cast("string"), F.lit("년")))
    said = said.when(k % 4 == 1, F.concat((of(900) + 100).cast("string"), F.lit("년대"))).when(k % 4 == 2, F.concat((of(11) + 10).cast("string"), F.lit("세기 무렵")))
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.parse_temporal(said.otherwise("알 수 없음")).alias("year"))


@query("tx11_parse_score", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN CAST(2.5 AS DOUBLE) ELSE CAST(least(o_orderkey % 80 / 10, 5) AS DOUBLE) END AS score, o_orderkey % 5 = 0 AS failed FROM orders")
def parse_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 80
    said = F.when(F.col("o_orderkey") % 5 == 0, "no number").otherwise(F.concat(F.lit("score "), F.floor(k / 10).cast("string"), F.lit("."), (k % 10).cast("string"), F.lit(" of 5")))
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.parse_score(said).alias("p")).select("o_orderkey", "p.score", "p.failed")


@query("tx12_match_label", "SELECT doc_id, CAST(CASE WHEN doc_id % 3 < 2 AND lang IN ('fr', 'en', 'de') THEN list_position(['fr', 'en', 'de'], lang) - 1 END AS INTEGER) AS label FROM documents")
def match_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 3
    said = F.when(k == 0, F.concat(F.lit(" "), "lang", F.lit(" "))).when(k == 1, F.concat(F.lit("it is "), "lang", F.lit("."))).otherwise("?")
    return table(spark, sf_dir, "documents").select("doc_id", tx.match_label(said, ["fr", "en", "de"]).alias("label"))


@query("tx13_answer_after", "SELECT conv_id, turn, trim(string_split(string_split(string_split(s, '<|assistant|>')[-1], '<|end_of_turn|>')[1], '</s>')[1], ' ') AS answer, contains(s, '<|assistant|>') AS parsed FROM (SELECT conv_id, turn, CASE WHEN role = 'user' THEN text ELSE '<|think|>' || role || '<|assistant|> ' || text || ' <|end_of_turn|>rest' END AS s FROM conversations)")
def answer_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("role") == "user", F.col("text")).otherwise(F.concat(F.lit("<|think|>"), "role", F.lit("<|assistant|> "), "text", F.lit(" <|end_of_turn|>rest")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.answer_after(said).alias("a")).select("conv_id", "turn", "a.answer", "a.parsed")


@query("tx15_nfkc", "SELECT p_partkey, p_name || ' fi 1' AS out FROM part")
def nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in full-width letters, with a ligature, a raised digit and more blanks."""
    low = "abcdefghijklmnopqrstuvwxyz"
    wide = F.translate("p_name", low, "".join(chr(ord(c) + 0xFEE0) for c in low))
    return table(spark, sf_dir, "part").select("p_partkey", tx.nfkc(F.concat(F.lit(" "), wide, F.lit("　 ﬁ\t¹ "))).alias("out"))


@query("tx15_collapsed", r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest FROM documents")
def collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.collapse_spaces(F.col("text"))).alias("digest"))


@query("tx16_byte_placeholders", "SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN text || '�' ELSE text END) AS out FROM documents")
def byte_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every byte of a text as a placeholder, in each third one with a broken character at the end."""
    made = F.regexp_replace(F.hex(F.encode("text", "UTF-8")), "(..)", "<0x$1>")
    made = F.when(F.col("doc_id") % 3 == 0, F.concat(made, F.lit("<0xED>"))).otherwise(made)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.byte_placeholders(made)).alias("out"))


@query("tx17_split_specials", "SELECT doc_id, CAST(len(x) AS INTEGER) AS n, md5(array_to_string(x, chr(1))) AS parts FROM (SELECT doc_id, list_filter(string_split(replace(replace(replace(replace(text, ' the ', '<s>'), '. ', '</s>'), '<s>', chr(1) || '<s>' || chr(1)), '</s>', chr(1) || '</s>' || chr(1)), chr(1)), lambda p: p <> '') AS x FROM documents)")
def split_specials(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.replace(F.replace("text", F.lit(" the "), F.lit("<s>")), F.lit(". "), F.lit("</s>"))
    rows = table(spark, sf_dir, "documents").select("doc_id", tx.split_specials(s, ["<s>", "</s>"]).alias("x"))
    return rows.select("doc_id", F.size("x").alias("n"), F.md5(F.array_join("x", "\x01")).alias("parts"))


@query("tx18_utf8_length", "SELECT doc_id, CAST(greatest(octet_length(encode(text)), 1) AS INTEGER) AS n FROM documents")
def utf8_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.utf8_length(F.col("text"), 1).alias("n"))


@query("tx19_strip_echo", "SELECT conv_id, turn, CASE WHEN instr(substr(s, 1, 60), ': ') > 0 THEN substr(s, instr(s, ': ') + 2) ELSE s END AS out FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN role || ': ' || text ELSE text END AS s FROM conversations)")
def strip_echo(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("turn") % 2 == 0, F.concat("role", F.lit(": "), "text")).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.strip_echo(said).alias("out"))


@query("tx21_pair_text", "SELECT conv_id, turn, concat('sentence1: ', role, ' sentence2: ', text) AS pair, printf('%.1f', CAST(turn AS DOUBLE)) AS score FROM conversations")
def pair_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", tx.pair_text(F.col("role"), F.col("text")).alias("pair"), tx.score_text(F.col("turn")).alias("score"))


#: All words of the benchmark's items, whatever their letters, and their UTF-8 bytes.
_BENCH = r"(SELECT item_id, unnest(l) AS w, unnest(range(1, len(l) + 1)) AS pos FROM (SELECT item_id, regexp_extract_all(text, '[^ \t\n\r]+') AS l FROM benchmark))"
_WORD_BYTES = "list_transform(range(0, strlen({0})), lambda i: CAST('0x' || substr(hex({0}), CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT))"


def _bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit(r"[^ \t\n\r]+"), F.lit(0))
    return table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(found).alias("at", "w")).select("item_id", (F.col("at") + 1).cast("bigint").alias("pos"), "w")


@query("tx22_ngrams", f"SELECT item_id, pos, CAST(count(*) AS INTEGER) AS n, md5(string_agg(substr(w, CAST(i AS INTEGER), k), '|' ORDER BY i, k)) AS digest FROM (SELECT item_id, pos, w, unnest(range(1, length(w) + 1)) AS i FROM {_BENCH}), (VALUES (2), (3), (4), (5)) b(k) WHERE i + k - 1 <= length(w) GROUP BY item_id, pos")
def ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _bench(spark, sf_dir).select("item_id", "pos", tx.ngrams(F.col("w"), 2, 5).alias("g")).where(F.size("g") > 0)
    return g.select("item_id", "pos", F.size("g").alias("n"), F.md5(F.array_join("g", "|")).alias("digest"))


@query("tx23_ngrams_of_sizes", f"SELECT item_id, pos, string_agg(substr(w, CAST(i AS INTEGER), k), '|' ORDER BY i, k) AS g FROM (SELECT item_id, pos, w, unnest(range(1, length(w) + 1)) AS i FROM {_BENCH}), (VALUES (1), (3)) b(k) WHERE i + k - 1 <= length(w) AND NOT (k = 1 AND i IN (1, length(w))) GROUP BY item_id, pos")
def ngrams_of_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _bench(spark, sf_dir).select("item_id", "pos", tx.ngrams_of(F.col("w"), [1, 3]).alias("g")).where(F.size("g") > 0)
    return g.select("item_id", "pos", F.array_join("g", "|").alias("g"))


@query("tx24_fnv1a32", f"SELECT item_id, pos, CAST(list_reduce(list_prepend(CAST(2166136261 AS BIGINT), {_WORD_BYTES.format('w')}), lambda h, b: (xor(h, b) * CAST(16777619 AS BIGINT)) & CAST(4294967295 AS BIGINT)) AS BIGINT) AS h FROM {_BENCH}")
def fnv1a32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bench(spark, sf_dir).select("item_id", "pos", tx.fnv1a32(F.col("w")).alias("h"))
