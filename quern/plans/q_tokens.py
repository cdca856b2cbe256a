"""Queries: token arrays, corruption plans and masking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.functions import tokens as tk
from quern.operators import corruption as cr
from quern.plans.q_sampling import WORDS, _words
from quern.plans.q_text import _BENCH, ENTRIES, _bench
from quern.plans.sql import U
from quern.queryset import query, table

#: The lengths of a text's words stand for ids; an id of 2 ends a sentence.
_IDS = r"(SELECT doc_id, list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''), lambda w: CAST(length(w) AS INTEGER)) AS ids FROM documents)"


def _ids(spark, sf_dir) -> DataFrame:
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    return table(spark, sf_dir, "documents").select("doc_id", F.transform(words, F.length).alias("ids"))


def _text(ids) -> F.Column:
    return F.array_join(ids.cast("array<string>"), " ")


@query("tk5_utf8_bytes", "SELECT item_id, array_to_string(list_transform(range(0, strlen(text)), lambda i: CAST(CAST('0x' || substr(hex(text), CAST(2 * i + 1 AS INTEGER), 2) AS INTEGER) + 1000 AS VARCHAR)), ' ') AS ids FROM benchmark")
def utf8_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", _text(tx.utf8_bytes(F.col("text"), 1000)).alias("ids"))


@query("tk7_assembled", f"SELECT doc_id, array_to_string(list_concat(ids, [2, 9]), ' ') AS encoder, array_to_string(list_concat([9], ids, [2]), ' ') AS decoder FROM {_IDS}")
def assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("ids")
    return _ids(spark, sf_dir).select("doc_id", _text(tk.encoder_ids(i, 2, F.lit(9))).alias("encoder"), _text(tk.decoder_ids(i, 2, F.lit(9))).alias("decoder"))


@query("tk7_labels", f"SELECT doc_id, array_to_string(list_concat(list_slice(ids, 1, 5), [2], list_slice(ids, 6, 9), [2], list_slice(ids, 10, len(ids)), [2, 9]), ' ') AS labels FROM {_IDS}")
def assembled_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("ids")
    parts = F.array(F.slice(i, 1, 5), F.slice(i, 6, 4), F.slice(i, F.lit(10), F.greatest(F.size(i) - 9, F.lit(0))))
    return _ids(spark, sf_dir).select("doc_id", _text(tk.label_ids(parts, 2, F.lit(9))).alias("labels"))


@query("tk8_padded", f"SELECT doc_id, array_to_string(list_slice(list_concat(ids, list_transform(range(32), lambda x: 0)), 1, 32), ' ') AS ids FROM {_IDS}")
def padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(spark, sf_dir).select("doc_id", _text(tk.pad_to(F.col("ids"), 32, 0)).alias("ids"))


@query("tk9_masks", f"SELECT doc_id, array_to_string(list_transform(ids, lambda x: CAST(x <> 3 AS INTEGER)), ' ') AS mask, array_to_string(list_transform(ids, lambda x: CASE WHEN x = 3 THEN -100 ELSE x END), ' ') AS labels, CAST(len(list_filter(ids, lambda x: x <> 3)) AS INTEGER) AS labelled FROM {_IDS}")
def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("ids")
    labels = tk.mask_labels(i, 3)
    return _ids(spark, sf_dir).select("doc_id", _text(tk.attention_mask(i, 3)).alias("mask"), _text(labels).alias("labels"), tk.count_labelled(labels).alias("labelled"))


@query("tk10_shifted", f"SELECT doc_id, array_to_string(list_concat([1], list_slice(ids, 1, len(ids) - 1)), ' ') AS ids FROM {_IDS}")
def shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(spark, sf_dir).select("doc_id", _text(tk.shift_right(F.col("ids"), 1, 0)).alias("ids"))


@query("tk13_content_tokens", "SELECT l_orderkey, l_linenumber % 3 AS segment, count(*) AS n FROM lineitem WHERE l_quantity >= 20 AND l_linenumber % 3 > 0 GROUP BY 1, 2")
def content_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("z"))
    counts = tk.content_tokens(F.transform("z", lambda z: z["l_quantity"]), F.transform("z", lambda z: z["l_linenumber"] % 3), 20)
    return rows.select("l_orderkey", F.explode(counts).alias("segment", "n")).select("l_orderkey", "segment", F.col("n").cast("bigint"))


@query("tk14_valid_tokens", f"SELECT doc_id, CAST(2 * len(list_filter(ids, lambda x: x <> 3)) AS INTEGER) AS n FROM {_IDS}")
def valid_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(spark, sf_dir).select("doc_id", tk.valid_tokens(F.col("ids"), F.col("ids"), 3).alias("n"))


@query("tk4_vocabulary_lookup", f"SELECT w AS token, CASE WHEN count(*) = 1 THEN min(item_id * 100000 + pos) ELSE -1 END AS token_id, CASE WHEN count(*) = 1 THEN w ELSE '<unk>' END AS back FROM {_BENCH} GROUP BY w")
def vocabulary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words to ids and back, where the vocabulary holds the words that stand once, by their place."""
    words = _bench(spark, sf_dir).select((F.col("item_id") * 100_000 + F.col("pos")).alias("token_id"), F.col("w").alias("token"))
    vocab = words.groupBy("token").agg(F.min("token_id").alias("token_id"), F.count("*").alias("n")).where("n = 1")
    ids = tk.vocabulary_lookup(words.select("token").distinct(), vocab, -1)
    back = tk.vocabulary_lookup(ids.select(F.col("token").alias("word"), "token_id"), vocab, "<unk>")
    return back.select(F.col("word").alias("token"), "token_id", F.col("token").alias("back"))


@query("tk15_extended_vocabulary", "SELECT count(*) AS n, max(t) AS top FROM (SELECT n_nationkey AS t FROM nation UNION ALL SELECT CAST(24 + i AS INTEGER) FROM range(1, 357) r(i))")
def extended_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = table(spark, sf_dir, "nation").select(F.col("n_name").alias("token"), F.col("n_nationkey").alias("token_id"))
    return tk.byte_vocabulary(vocab, 100).agg(F.count("*").alias("n"), F.max("token_id").alias("top"))


@query("tk16_chat_tokens", "SELECT token, CAST((SELECT max(n_nationkey) FROM nation) + 256 + 96 + i AS INTEGER) AS token_id FROM (VALUES ('<|system|>', 0), ('<|user|>', 1), ('<|assistant|>', 2), ('<|end_of_turn|>', 3), ('<|think|>', 4)) t(token, i)")
def chat_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat tokens on the sentinels of a vocabulary that bytes and a hundred sentinels were added to."""
    vocab = table(spark, sf_dir, "nation").select(F.col("n_name").alias("token"), F.col("n_nationkey").alias("token_id"))
    sentinels = tk.byte_vocabulary(vocab, 100).where(F.col("token").startswith("<extra_id_")).collect()  # a hundred rows
    made = tk.map_chat_tokens({r["token"]: r["token_id"] for r in sentinels})
    return spark.createDataFrame(list(made.items()), "token string, token_id int")


#: Words of the benchmark, sentinels and byte pieces, as the pieces of a vocabulary.
_PIECES = f"(SELECT DISTINCT w AS token, FALSE AS special FROM {_BENCH} UNION ALL SELECT '<extra_id_' || item_id || '>', TRUE FROM benchmark UNION ALL SELECT printf('<0x%02X>', b), TRUE FROM range(256) r(b))"


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _bench(spark, sf_dir).select(F.col("w").alias("token")).distinct()
    sentinels = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("<extra_id_"), F.col("item_id").cast("string"), F.lit(">")).alias("token"))
    return words.unionByName(sentinels).unionByName(spark.range(256).select(F.format_string("<0x%02X>", "id").alias("token")))


@query("tk17_special_pieces", f"SELECT token, special FROM {_PIECES}")
def special_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).select("token", tk.is_extended(F.col("token")).alias("special"))


@query("tk20_plain_tokens", f"SELECT token FROM {_PIECES} WHERE NOT special")
def plain_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).where(~tk.is_extended(F.col("token")))


@query("tk6_byte_spans", "SELECT doc_id, md5(array_to_string(list_concat([100], list_transform(regexp_extract_all(text, '(?s).'), lambda c: unicode(c) + 301000), [101]), ' ')) AS ids FROM documents")
def byte_spans_to_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of a whole text between two sentinels, back to one id a character."""
    ids = F.concat(F.array(F.lit(100)), tx.utf8_bytes(F.col("text"), 1000), F.array(F.lit(101)))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(_text(tk.byte_spans_to_tokens(ids, F.lit(1000), F.lit(300_000)))).alias("ids"))


@query("tk24_bucket_batch_sizes", f"SELECT size, batch, CAST(count(*) AS BIGINT) AS n, CAST(ceil(count(*) / CAST(batch AS DOUBLE)) AS BIGINT) AS batches FROM (SELECT coalesce((SELECT min(b) FROM (VALUES (128), (256), (512), (1024), (2048), (4096), (8192)) t(b) WHERE b >= len(ids)), 8192) AS size FROM {_IDS}) JOIN (VALUES (128, 256), (256, 128), (512, 64), (1024, 32), (2048, 16), (4096, 8), (8192, 4)) t(s, batch) ON s = size GROUP BY size, batch")
def bucket_batch_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each length bucket and the batches that they make at its size."""
    size = F.element_at(F.array(*map(F.lit, tk.BUCKETS)), tk.bucket_of(F.size("ids")).cast("int") + 1)
    batch = F.coalesce(*(F.when(F.col("size") == s, F.lit(tk.bucket_batch_size(512, 8, s))) for s in tk.BUCKETS))
    counts = _ids(spark, sf_dir).select(size.cast("int").alias("size")).groupBy("size").agg(F.count("*").alias("n"))
    return counts.withColumn("batch", batch).select("size", "batch", "n", F.ceil(F.col("n") / F.col("batch")).alias("batches"))


@query("tk25_windows", f"SELECT doc_id, array_to_string(CASE WHEN len(ids) > 12 THEN list_slice(ids, s + 1, s + 12) ELSE ids END, ' ') AS ids FROM (SELECT doc_id, ids, CAST(floor({U(42, 'doc_id')} * (len(ids) - 11)) AS INTEGER) AS s FROM {_IDS})")
def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(spark, sf_dir).select("doc_id", _text(tk.window(F.col("ids"), 12, "doc_id")).alias("ids"))


@query("tk26_edge_windows", f"""SELECT doc_id, array_to_string(CASE WHEN len(ids) > 12 THEN list_slice(ids, s + 1, s + 12) ELSE ids END, ' ') AS ids FROM (SELECT doc_id, ids,
   CASE WHEN {U('42a', 'doc_id')} < 0.3 THEN 0 WHEN {U('42a', 'doc_id')} < 0.6 THEN len(ids) - 12 ELSE CAST(floor({U('42b', 'doc_id')} * (len(ids) - 11)) AS INTEGER) END AS s FROM {_IDS})""")
def edge_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(spark, sf_dir).select("doc_id", _text(tk.edge_window(F.col("ids"), 12, "doc_id")).alias("ids"))


@query("tk25_sentence_windows")
def sentence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(spark, sf_dir).select("doc_id", _text(tk.sentence_window(F.col("ids"), 12, 2, "doc_id")).alias("ids"))


_CUT = "(SELECT doc_id, ids, list_max(list_filter(list_transform(range(1, 13), lambda i: CASE WHEN i <= len(ids) AND ids[i] = 2 THEN i END), lambda p: p IS NOT NULL)) AS e FROM {})".format(_IDS)


@query("tk27_cut_at_sentence", f"SELECT doc_id, array_to_string(CASE WHEN len(ids) <= 12 THEN ids WHEN e IS NOT NULL THEN list_slice(ids, 1, e) ELSE list_slice(ids, 1, 12) END, ' ') AS ids FROM {_CUT}")
def cut_at_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(spark, sf_dir).select("doc_id", _text(tk.cut_at_sentence(F.col("ids"), 12, 2)).alias("ids"))


_SPLIT = f"""(SELECT doc_id, n, CASE WHEN n < 10 THEN list_slice(ids, 1, 0) WHEN n <= 126 THEN list_slice(ids, 1, c) ELSE list_slice(ids, s + 1, s + e) END AS enc,
   CASE WHEN n < 10 THEN ids WHEN n <= 126 THEN list_slice(ids, c + 1, n) ELSE list_slice(ids, s + e + 1, s + e + d) END AS dec
   FROM (SELECT *, CAST(floor({U('42start', 'doc_id')} * (n - e - d + 1)) AS INTEGER) AS s FROM (SELECT *, least(64, 126 - e) AS d FROM (SELECT doc_id, ids, len(ids) AS n,
     greatest(1, least(CAST(floor(len(ids) * (CAST(0.2 AS DOUBLE) + CAST(0.2 AS DOUBLE) * {U('42ratio', 'doc_id')})) AS INTEGER), len(ids) - 1)) AS c,
     CAST(floor(least(CAST(64 AS DOUBLE), 126 * (CAST(0.25 AS DOUBLE) + CAST(0.1 AS DOUBLE) * {U('42ratio', 'doc_id')}))) AS INTEGER) AS e FROM {_IDS}))))"""


@query("tk28_prefix_split", f"SELECT doc_id, array_to_string(enc, ' ') AS encoder, array_to_string(dec, ' ') AS decoder FROM {_SPLIT}")
def prefix_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ids(spark, sf_dir).select("doc_id", tk.prefix_split(F.col("ids"), 64, 64, "doc_id").alias("s"))
    return rows.select("doc_id", _text(F.col("s.encoder")).alias("encoder"), _text(F.col("s.decoder")).alias("decoder"))


@query("tk29_split_at_end", f"SELECT doc_id, CAST(len(list_filter(ids, lambda x: x = 2)) + coalesce(CAST(ids[len(ids)] <> 2 AS INTEGER), 0) AS INTEGER) AS n FROM {_IDS}")
def split_at_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(spark, sf_dir).select("doc_id", F.size(tk.split_at(F.col("ids"), 2)).alias("n"))


@query("tk30_permuted_sentences", "SELECT doc_id, string_agg(s, '|' ORDER BY md5(concat_ws(':', '42', CAST(doc_id AS VARCHAR), CAST(i AS VARCHAR))), i) AS parts FROM (SELECT doc_id, unnest(string_split(text, '.')) AS s, unnest(range(len(string_split(text, '.')))) AS i FROM documents WHERE len(string_split(text, '.')) >= 3) GROUP BY doc_id")
def permuted_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split("text", r"\.")
    rows = table(spark, sf_dir, "documents").where(F.size(F.split("text", r"\.")) >= 3)
    return rows.select("doc_id", F.array_join(tk.permute(parts, "doc_id"), "|").alias("parts"))


@query("tx14_until_end", f"SELECT doc_id, array_to_string(CASE WHEN e IS NULL THEN ids ELSE list_slice(ids, 1, e - 1) END, ' ') AS ids FROM (SELECT doc_id, ids, nullif(list_position(ids, 2), 0) AS e FROM {_IDS})")
def until_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(spark, sf_dir).select("doc_id", _text(tk.until(F.col("ids"), [2])).alias("ids"))


@query("tk1_encoded")
def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    encode = tk.encoder(tk.words_tokenizer, bos=1, eos=2, max_length=64)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(encode(F.col("text"))).alias("n"))


#: Words of the benchmark and tokens whose jamo are written out, with all n-grams of three and five of them.
_JAMO = f"""(SELECT token, substr(j, CAST(i AS INTEGER), k) AS g, i, k FROM (SELECT token, j, unnest(range(1, length(j) + 1)) AS i FROM (SELECT DISTINCT w AS token, w AS j FROM {_BENCH}
  UNION ALL SELECT * FROM (VALUES ('가', 'ㄱㅏ-'), ('한국', 'ㅎㅏㄴㄱㅜㄱ'), ('韓', 'ㅎㅏㄴ')) t(token, j))), (VALUES (3), (5)) s(k) WHERE i + k - 1 <= length(j))"""
_FNV = "list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(range(0, strlen({0})), lambda i: CAST(CAST('0x' || substr(hex({0}), CAST(2 * i + 1 AS INTEGER), 2) AS INTEGER) AS BIGINT))), lambda h, b: (xor(h, b) * CAST(16777619 AS BIGINT)) & CAST(4294967295 AS BIGINT))"


@query("tk18_jamo_buckets", f"""SELECT token, string_agg(CAST({_FNV.format('g')} % n + 1 AS VARCHAR), ' ' ORDER BY i, k) AS buckets, CAST(any_value(width) AS INTEGER) AS width
   FROM {_JAMO}, (SELECT count(DISTINCT g) AS n FROM {_JAMO}), (SELECT ceil(max(m) / CAST(128 AS DOUBLE)) * 128 AS width FROM (SELECT count(*) AS m FROM {_JAMO} GROUP BY token)) GROUP BY token""")
def jamo_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed n-grams of the jamo of each token that has any, without the padding, and the width of the padded rows."""
    from quern.functions import script as sc

    words = _bench(spark, sf_dir).select(F.col("w").alias("token")).distinct()
    rows = words.unionByName(spark.createDataFrame([("가",), ("한국",), ("韓",), ("<0x0A>",), ("<extra_id_3>",)], "token string"))
    made = tk.jamo_bucket_table(rows, "token", [3, 5], sc.transcriber(ENTRIES))
    return made.select("token", _text(F.filter("buckets", lambda b: b > 0)).alias("buckets"), F.size("buckets").alias("width")).where("buckets <> ''")


@query("tk19_char_rank_ids", "SELECT ch, CAST(row_number() OVER (ORDER BY n DESC, r, i) AS INTEGER) AS id FROM (SELECT ch, count(*) AS n, min(item_id) AS r, arg_min(i, item_id * 100000 + i) AS i FROM (SELECT item_id, unnest(string_split(text, '')) AS ch, unnest(range(length(text))) AS i FROM benchmark) WHERE ch <> '' GROUP BY ch)")
def char_rank_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    from quern.operators.relational import char_frequency

    counts = char_frequency(table(spark, sf_dir, "benchmark"), "text", "item_id")  # a row per character
    return counts.select("ch", F.row_number().over(Window.orderBy(F.desc("n"), "first")).alias("id"))


@query("tk21_tiled_rows", "SELECT CAST(n_nationkey AS INTEGER) AS token_id, concat_ws(' ', n_nationkey, n_regionkey + 1) AS features FROM nation UNION ALL SELECT CAST(i AS INTEGER), (SELECT concat_ws(' ', n_nationkey, n_regionkey + 1) FROM nation WHERE n_nationkey = 0) FROM range(25, 40) t(i)")
def tiled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a feature table for new tokens: the padding row over again."""
    made = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("token_id"), F.array(F.col("n_nationkey").cast("int"), (F.col("n_regionkey") + 1).cast("int")).alias("features"))
    return tk.extended_rows(made, 40).select("token_id", _text(F.col("features")).alias("features"))


# --- corruption --------------------------------------------------------------------------------------------------


@query("cr1_deleted", f"SELECT doc_id, array_to_string(list_filter(list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN ids[i] = 2 OR (CAST('0x' || substr(md5(concat_ws(':', '42', CAST(doc_id AS VARCHAR), CAST(i - 1 AS VARCHAR))), 1, 8) AS BIGINT) / CAST(4294967296.0 AS DOUBLE)) >= 0.3 THEN ids[i] END), lambda x: x IS NOT NULL), ' ') AS ids FROM {_IDS}")
def deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(spark, sf_dir).select("doc_id", _text(cr.delete_tokens(F.col("ids"), 0.3, [2], "doc_id")).alias("ids"))


_PADDED = "list_slice(list_concat({}, list_transform(range(64), lambda x: CAST(0 AS INTEGER))), 1, 64)"
_KEPT = "list_filter(list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN ids[i] IN (1, 2) OR (CAST('0x' || substr(md5(concat_ws(':', '42', CAST(doc_id AS VARCHAR), CAST(i - 1 AS VARCHAR))), 1, 8) AS BIGINT) / CAST(4294967296.0 AS DOUBLE)) >= 0.3 THEN ids[i] END), lambda x: x IS NOT NULL)"


@query("cr21_deletion_batch", f"""SELECT doc_id, array_to_string({_PADDED.format(_KEPT)}, ' ') AS input_ids, array_to_string(list_transform({_PADDED.format('ids')}, lambda x: CASE WHEN x = 0 THEN -100 ELSE x END), ' ') AS labels,
   array_to_string(list_concat([1], list_slice({_PADDED.format('ids')}, 1, 63)), ' ') AS decoder_input_ids, CAST(least(64, len({_KEPT})) AS INTEGER) AS n_shown FROM {_IDS}""")
def deletion_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ids(spark, sf_dir).select("doc_id", cr.deletion_collate(F.col("ids"), "doc_id", 64).alias("s"))
    shown = F.aggregate("s.attention_mask", F.lit(0), lambda n, x: n + x)
    return rows.select("doc_id", *(_text(F.col(f"s.{c}")).alias(c) for c in ("input_ids", "labels", "decoder_input_ids")), shown.alias("n_shown"))


@query("cr20_infilling_batch")
def infilling_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ids(spark, sf_dir).select("doc_id", cr.infilling_collate(F.col("ids"), F.col("doc_id"), 64, mask=9999).alias("s"))
    return rows.select("doc_id", *(_text(F.col(f"s.{c}")).alias(c) for c in ("input_ids", "labels", "decoder_input_ids")))


_EMPTIED = f"(SELECT doc_id, ids FROM {_IDS} UNION ALL SELECT item_id, CAST([] AS INTEGER[]) FROM benchmark)"


@query("cr22_empty_batch", """SELECT doc_id, CASE WHEN len(ids) = 0 THEN '0 0 0' ELSE array_to_string(list_slice(list_concat(ids, [0, 0, 0]), 1, 3), ' ') END AS input_ids, CASE WHEN len(ids) = 0 THEN '-100 -100' ELSE array_to_string(list_transform(list_slice(list_concat(ids, [0, 0]), 1, 2), lambda x: CASE WHEN x = 0 THEN -100 ELSE x END), ' ') END AS labels FROM """ + _EMPTIED)
def empty_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows padded to a batch's length; one without ids is the empty batch's row. Items of a benchmark have no ids here."""
    rows = _ids(spark, sf_dir).unionByName(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.array().cast("array<int>").alias("ids")))
    empty = tk.empty_row(3, 2, 0)
    own = F.struct(tk.pad_to(F.col("ids"), 3, 0).alias("input_ids"), tk.mask_labels(tk.pad_to(F.col("ids"), 2, 0), 0).alias("labels"))
    made = F.when(F.size("ids") == 0, F.struct(empty["input_ids"].alias("input_ids"), empty["labels"].alias("labels"))).otherwise(own)
    return rows.select("doc_id", made.alias("s")).select("doc_id", _text(F.col("s.input_ids")).alias("input_ids"), _text(F.col("s.labels")).alias("labels"))


@query("cr2_infilled")
def infilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = cr.infilling(0.3, 3.0, 9999, (2,))(F.col("ids"), F.col("doc_id"))
    return _ids(spark, sf_dir).select("doc_id", _text(masked).alias("ids"))


def _ends(total: str, parts: str, seed: str) -> str:
    """SQL of where the parts of a sum end, by the same draws."""
    u = f"(CAST('0x' || substr(md5(concat_ws(':', '{seed}', CAST(doc_id AS VARCHAR), CAST(x[1] AS VARCHAR))), 1, 8) AS BIGINT) / CAST(4294967296.0 AS DOUBLE))"
    t = f"(CAST(floor({u} * x[1]) AS BIGINT) + 1)"
    cuts = f"list_reduce(list_concat([CAST([] AS BIGINT[])], list_transform(range({total} - {parts} + 1, {total}), lambda j: [j])), lambda got, x: list_append(got, CASE WHEN list_contains(got, {t}) THEN x[1] ELSE {t} END))"
    return f"list_append(list_sort({cuts}), CAST({total} AS BIGINT))"


def _masked(source: str, ratio: float, mean: str, mark: str, special: str = "FALSE", seed: str = "42") -> str:
    """SQL of rows (doc_id, encoder, decoder, as lists) from rows (doc_id, ids); mark is of span j from 0, special of id x."""
    return f"""(WITH p AS (SELECT doc_id, ids, list_filter(range(1, len(ids) + 1), lambda i: NOT list_transform([ids[i]], lambda x: {special})[1]) AS p FROM {source}),
      n AS (SELECT *, len(p) AS m, greatest(1, least(CAST(round_even(len(p) * CAST({ratio} AS DOUBLE), 0) AS BIGINT), len(p) - 1)) AS n FROM p),
      k AS (SELECT *, greatest(1, least(CAST(round_even(n / CAST({mean} AS DOUBLE), 0) AS BIGINT), {cr.SENTINELS} - 1, n, m - n)) AS k FROM n),
      e AS (SELECT *, {_ends('(m - n)', 'k', f'{seed}kept')} AS a, {_ends('n', 'k', f'{seed}masked')} AS b FROM k WHERE len(ids) > 1 AND m > 0),
      w AS (SELECT doc_id, ids, k, list_transform(range(1, k + 1), lambda j: p[a[j] + CASE WHEN j > 1 THEN b[j - 1] ELSE 0 END + 1]) AS f, list_transform(range(1, k + 1), lambda j: p[a[j] + b[j]]) AS l FROM e)
      SELECT doc_id, list_filter(list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN list_transform([ids[i]], lambda x: {special})[1] THEN ids[i] ELSE
          coalesce(list_transform(list_filter(range(k), lambda j: f[j + 1] = i), lambda j: {mark})[1], CASE WHEN len(list_filter(range(k), lambda j: f[j + 1] <= i AND i <= l[j + 1])) = 0 THEN ids[i] END) END), lambda x: x IS NOT NULL) AS encoder,
        flatten(list_transform(range(k), lambda j: list_concat([{mark}], list_filter(list_slice(ids, f[j + 1], l[j + 1]), lambda x: NOT {special})))) AS decoder FROM w
      UNION ALL SELECT doc_id, ids, list_slice(ids, 1, 0) FROM k WHERE NOT (len(ids) > 1 AND m > 0))"""


_SHOWN = "SELECT doc_id, array_to_string(encoder, ' ') AS encoder, array_to_string(decoder, ' ') AS decoder FROM "


def _spans(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", _text(F.col("s.encoder")).alias("encoder"), _text(F.col("s.decoder")).alias("decoder"))


@query("cr3_sentinels", _SHOWN + _masked(_IDS, 0.15, "3", "CAST(10000 + j AS INTEGER)", "x = 2"))
def sentinels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(_ids(spark, sf_dir).select("doc_id", cr.sentinel_masking(0.15, 3.0, 10_000, (2,))(F.col("ids"), F.col("doc_id")).alias("s")))


@query("cr17_heavy_denoising", _SHOWN + _masked(_IDS, 0.5, "32", "CAST(10000 + j AS INTEGER)", "x = 2"))
def heavy_denoising(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heavy configuration: half of the tokens in spans of 32 on average."""
    return _spans(_ids(spark, sf_dir).select("doc_id", cr.sentinel_masking(0.5, 32.0, 10_000, (2,))(F.col("ids"), F.col("doc_id")).alias("s")))


@query("cr5_morpheme_masks")
def morpheme_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split("text", r"\s+")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(cr.morpheme_infilling()(parts, F.col("doc_id")), " ").alias("encoder"))


_PARTS = r"(SELECT doc_id, regexp_split_to_array(text, '\s+') AS ids FROM documents)"


@query("cr6_morpheme_sentinels", _SHOWN + _masked(_PARTS, 0.15, "3", "'<extra_id_' || j || '>'", "x = '</s>'"))
def morpheme_sentinels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(table(spark, sf_dir, "documents").select("doc_id", cr.morpheme_sentinels()(F.split("text", r"\s+"), F.col("doc_id")).alias("s")))


@query("cr7_denoiser_config", f"SELECT doc_id, CASE CAST(floor({U('config', 'doc_id')} * 2) AS INTEGER) WHEN 0 THEN CAST(0.15 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS ratio FROM documents")
def denoiser_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", cr.choose_config([(3, 0.15), (8, 0.5)], "doc_id", seed="config")["ratio"].alias("ratio"))


@query("cr8_intensity", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount < 0.02 THEN 'light' WHEN l_discount < 0.04 THEN 'medium' ELSE 'heavy' END AS level FROM lineitem")
def intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cr.intensity(F.round(F.col("l_discount") * 10, 6)).alias("level"))


_MODE = f"""CASE WHEN {U('42mode', 'doc_id')} < CAST(0.4 AS DOUBLE) + (CAST(0.2 AS DOUBLE) - CAST(0.2 AS DOUBLE) * s) / 2 THEN 'denoising'
  WHEN {U('42mode', 'doc_id')} < CAST(0.4 AS DOUBLE) + (CAST(0.2 AS DOUBLE) - CAST(0.2 AS DOUBLE) * s) / 2 + CAST(0.4 AS DOUBLE) + (CAST(0.2 AS DOUBLE) - CAST(0.2 AS DOUBLE) * s) / 2 THEN 'denoising_heavy' ELSE 'continuation' END"""
_SCALED = f"(SELECT *, CASE WHEN n_tokens < 0.3 * 1020 THEN 0.0 WHEN n_tokens < 0.6 * 1020 THEN 0.5 WHEN n_tokens < 1020 THEN 1.0 ELSE 0.0 END AS s FROM {WORDS})"


@query("cr10_mode_by_length", f"SELECT doc_id, {_MODE} AS mode FROM {_SCALED}")
def mode_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).select("doc_id", cr.choose_mode(F.col("n_tokens"), 1020, "doc_id", seed="42mode").alias("mode"))


@query("cr9_mode_by_ratio", f"SELECT doc_id, CASE WHEN {U(5, 'doc_id')} < CAST(0.7 AS DOUBLE) THEN 'denoising' ELSE 'denoising_heavy' END AS mode FROM documents")
def mode_by_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratios = {"denoising": 0.7, "denoising_heavy": 0.3, "continuation": 0.0}
    return table(spark, sf_dir, "documents").select("doc_id", cr.choose_mode(F.lit(10), 1020, "doc_id", ratios={k: v for k, v in ratios.items() if v}, seed=5).alias("mode"))


@query("cr11_plans", f"""SELECT doc_id, mode, CASE WHEN {U('42form', 'doc_id')} < 0.5 THEN 'sentinel' ELSE 'bart' END AS form,
   mode || '_' || CASE WHEN {U('42form', 'doc_id')} < 0.5 THEN 'sentinel' ELSE 'bart' || CASE WHEN mode IN ('denoising', 'denoising_heavy') THEN '_shuffled' ELSE '' END END AS training_mode
   FROM (SELECT doc_id, CASE WHEN m = 'denoising' AND {U('42morpheme', 'doc_id')} < 0.5 THEN 'morpheme_denoising' ELSE m END AS mode FROM (SELECT doc_id, {_MODE} AS m FROM {_SCALED}))""")
def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    made = cr.plan(F.col("text"), n, F.lit(None).cast("int"), "doc_id", permute=True)
    rows = table(spark, sf_dir, "documents").select("doc_id", made.alias("p"))
    return rows.select("doc_id", "p.mode", "p.form", "p.training_mode")


@query("cr12_training_mode", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'denoising_bart' || CASE WHEN n_chars > 500 THEN '_shuffled' ELSE '' END || '_transcription_hangul_to_hanja' WHEN 1 THEN 'continuation_sentinel' ELSE 'temporal_continuation' END AS label FROM documents")
def training_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 3
    mode = F.when(k == 0, "denoising").when(k == 1, "continuation").otherwise("temporal_continuation")
    label = cr.training_mode(mode, F.when(k == 0, "bart").when(k == 1, "sentinel"), F.col("n_chars") > 500, F.when(k == 0, "hangul_to_hanja"))
    return table(spark, sf_dir, "documents").select("doc_id", label.alias("label"))


_WINDOW = f"(SELECT doc_id, substr(text, CASE WHEN length(text) > 154 THEN CAST(floor({U('42window', 'doc_id')} * (length(text) - 154 + 1)) AS BIGINT) ELSE 0 END + 1, 154) AS t FROM documents)"
_BYTES = f"(SELECT doc_id, list_transform(range(0, strlen(t)), lambda i: CAST(CAST('0x' || substr(hex(t), CAST(2 * i + 1 AS INTEGER), 2) AS INTEGER) + 1000 AS INTEGER)) AS ids FROM {_WINDOW})"


@query("cr14_byte_reconstruction", _SHOWN + _masked(_BYTES, 0.3, "CASE WHEN len(ids) >= 500 THEN 64 WHEN len(ids) >= 200 THEN 8 ELSE 3 END", "CAST(100 + j AS INTEGER)"))
def byte_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(table(spark, sf_dir, "documents").select("doc_id", cr.byte_reconstruction()(F.col("text"), F.col("doc_id")).alias("s")))


@query("cr15_continuation", f"SELECT doc_id, array_to_string(list_concat(enc, [777]), ' ') AS encoder, array_to_string(list_concat([777], dec), ' ') AS decoder FROM {_SPLIT} WHERE n >= 10")
def continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ids(spark, sf_dir).where(F.size("ids") >= 10).select("doc_id", cr.continuation(F.col("ids"), 64, 64, 777, "doc_id").alias("s"))
    return rows.select("doc_id", _text(F.col("s.encoder")).alias("encoder"), _text(F.col("s.decoder")).alias("decoder"))


@query("cr16_temporal_text", "SELECT o_orderkey, concat(o_orderpriority, ' 연도: ', CAST(year(o_orderdate) AS VARCHAR)) AS text FROM orders")
def temporal_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", cr.temporal_text(F.col("o_orderpriority"), F.year("o_orderdate")).alias("text"))


@query("cr19_denoised")
def denoised(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = F.when(F.col("doc_id") % 2 == 0, "sentinel").otherwise("bart")
    rows = _ids(spark, sf_dir).select("doc_id", cr.denoise(F.col("ids"), F.col("doc_id"), form, ratio=0.15, mean=3.0, mask=9999, first_sentinel=10_000, eos=2, permute=True).alias("s"))
    return rows.select("doc_id", _text(F.col("s.encoder")).alias("encoder"), _text(F.col("s.decoder")).alias("decoder"))


@query("cr14_byte_spans", "SELECT doc_id, CAST(CASE WHEN strlen(text) >= 500 THEN 64 WHEN strlen(text) >= 200 THEN 8 ELSE 3 END AS INTEGER) AS span FROM documents")
def byte_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", cr.byte_span(F.octet_length("text")).alias("span"))
