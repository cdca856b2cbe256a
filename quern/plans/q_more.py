"""Queries: compositions and adapters that the other modules leave out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern import config
from quern.functions import script as sc
from quern.functions import text as tx
from quern.functions import tokens as tk
from quern.operators import batching, mixing
from quern.operators import corruption as cr
from quern.operators import relational as rel
from quern.operators import tasks as ts
from quern.operators.ranks import hash_rank
from quern.plans.q_relational import registered_rows, registered_sql
from quern.plans.q_sampling import WORDS, _words
from quern.plans.q_text import ENTRIES
from quern.plans.q_tokens import _IDS, _ids, _text
from quern.plans.sql import H, U
from quern.queryset import query, table
from quern.sources import readers, sinks


@query("src6_text_list", "SELECT DISTINCT trim(url) AS value FROM pages WHERE trim(url) <> ''")
def text_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trimmed lines without blanks, as a list file is read. Pages can share an address, which the list holds once."""
    path = f"{sinks.shared_folder(spark)}/lines"
    urls = table(spark, sf_dir, "pages").select(F.trim("url").alias("u")).distinct().select(F.concat(F.lit("  "), "u", F.lit(" ")).alias("u"))
    sinks.write_lines(urls.unionByName(spark.createDataFrame([(" ",)], "u string")), "u", path)
    return readers.text_list(spark, path)


@query("src13_supervised_sources", registered_sql([("temporal", "temporal_classification"), ("sts", "sts"), ("topics", "topic_classification"), ("nli", "nli"), ("transcription_articles", "transcription"), ("transcription_sentences", "transcription"), ("instruction", "instruction"), ("summaries", "summarization"), ("cot", "cot"), ("choices", "multiple_choice")]))
def supervised_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registered_rows(spark, sf_dir, config.supervised_sources)


@query("src14_eval_sources", registered_sql([("temporal", "temporal_classification"), ("sts", "sts"), ("topics", "topic_classification"), ("nli", "nli")]))
def supervised_eval_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registered_rows(spark, sf_dir, config.eval_sources)


@query("src17_head", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 16")
def head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.head(table(spark, sf_dir, "documents").select("doc_id"), 16, "doc_id")


@query("src18_smoke_rows", "SELECT 'text ' || i || '. It has two sentences.' AS original_text, CAST(1920 + i AS INTEGER) AS year, 'source' || i % 3 AS source FROM range(8) t(i)")
def smoke_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.smoke_rows(spark).select("original_text", tx.year_from_metadata(F.col("metadata")).alias("year"), "source")


@query("prj6_dropped_columns", "SELECT doc_id, lang, source, n_chars FROM documents")
def dropped_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").drop("text", "no_such_column")


@query("prj9_chat_adapter", "SELECT conv_id, turn, '' AS metadata, text AS original_text FROM conversations WHERE role = 'user'")
def chat_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "conversations").where("role = 'user'")
    return users.select("conv_id", "turn", ts.chat_example(F.col("text")).alias("e")).select("conv_id", "turn", "e.*")


@query("prj11_one_prompt", f"SELECT doc_id, (SELECT p FROM (VALUES ('a'), ('b'), ('c')) t(p) ORDER BY {H('slice', 'p')} LIMIT 1) AS metadata FROM documents")
def one_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One seeded prompt for a whole slice."""
    return table(spark, sf_dir, "documents").select("doc_id", ts.slice_prompt(["a", "b", "c"], "slice").alias("metadata"))


@query("jn10_token_flags", "SELECT l_orderkey, count(*) FILTER (l_linenumber IN (2, 3)) / CAST(count(*) AS DOUBLE) AS ratio FROM lineitem GROUP BY 1")
def token_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of tokens whose vocabulary entry carries a flag: ids joined with a small flag table."""
    flags = spark.createDataFrame([(i, i in (2, 3)) for i in range(8)], "l_linenumber int, flag boolean")
    rows = rel.lookup(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), flags, "l_linenumber", "flag", False)
    return rows.groupBy("l_orderkey").agg(F.avg(F.col("flag").cast("double")).alias("ratio"))


@query("ag23_length_bands", "SELECT CASE WHEN n_chars < 1024 THEN '0-1k' WHEN n_chars < 2048 THEN '1k-2k' WHEN n_chars < 4096 THEN '2k-4k' WHEN n_chars < 8192 THEN '4k-8k' WHEN n_chars < 16384 THEN '8k-16k' ELSE '16k+' END AS band, count(*) AS n FROM documents GROUP BY 1")
def length_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(rel.length_band(F.col("n_chars")).alias("band")).agg(F.count("*").alias("n"))


@query("ag27_namespaced_metrics", "SELECT 'cot_' || lang || '/n' AS name, CAST(count(*) AS DOUBLE) AS value FROM documents GROUP BY lang")
def namespaced_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").cast("double").alias("value"))
    return counts.select(F.concat(F.lit("cot_"), F.concat_ws("/", "lang", F.lit("n"))).alias("name"), "value")


@query("wn12_epoch_order", f"SELECT doc_id, row_number() OVER (ORDER BY {H('epoch2', 'doc_id')}, doc_id) AS rn FROM labels")
def epoch_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_rank(table(spark, sf_dir, "labels").select("doc_id"), "epoch2", "doc_id")


@query("st1_sorted_urls", "SELECT url, row_number() OVER (ORDER BY url, page_id) AS rn FROM pages")
def sorted_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks in url order, cut into buckets of whole urls so that no task sorts all of them."""
    from quern.operators.ranks import row_index

    return row_index(table(spark, sf_dir, "pages").select("url", "page_id"), "url", more=[F.col("page_id")]).select("url", "rn")


@query("tk3_decoded")
def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids back to text, special ones left out; here each id is a letter."""
    decode = tk.decoder(lambda: lambda ids: "".join(chr(97 + i % 26) for i in ids), frozenset({2}))
    return _ids(spark, sf_dir).select("doc_id", decode(F.col("ids")).alias("text"))


@query("tk12_labelled_tokens", f"SELECT doc_id, CAST(len(list_filter(ids, lambda x: x > 2)) AS INTEGER) AS n FROM {_IDS}")
def labelled_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.transform("ids", lambda x: F.when(x > 2, x).otherwise(-100))
    return _ids(spark, sf_dir).select("doc_id", tk.count_labelled(labels).alias("n"))


@query("cr18_morpheme_denoising")
def morpheme_denoising(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Morphemes of a text with spans masked in the encoder, the whole text in the decoder."""
    parts = sc.morphemes(str.split, ENTRIES)(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", parts.alias("parts"))
    return rows.select("doc_id", F.array_join(cr.morpheme_infilling()(F.col("parts"), F.col("doc_id")), "").alias("encoder"), F.array_join("parts", " ").alias("decoder"))


@query("cr23_denoiser_configs", f"SELECT doc_id, CASE WHEN {U('pairs', 'doc_id')} * 2 < 1 THEN CAST(3 AS DOUBLE) ELSE CAST(8 AS DOUBLE) END AS mean, CASE WHEN {U('pairs', 'doc_id')} * 2 < 1 THEN CAST(0.15 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS ratio FROM documents")
def denoiser_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with one of the configurations of a setting's text."""
    chosen = cr.choose_config(config.parse_denoisers("3,8;0.15,0.5"), "doc_id", seed="pairs")
    return table(spark, sf_dir, "documents").select("doc_id", chosen["lambda"].alias("mean"), chosen["ratio"].alias("ratio"))


@query("ts11_task_adapters", """SELECT conv_id, turn, handler, CASE WHEN handler = 'instruction' THEN 'Follow the instruction.' ELSE role END AS prompt_text, text AS input, CASE WHEN handler = 'summarization' THEN 'short' ELSE role END AS output
   FROM (SELECT *, (['instruction', 'summarization', 'cot', 'multiple_choice'])[turn % 4 + 1] AS handler FROM conversations WHERE text <> '')""")
def task_adapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as rows of four tasks, that of a turn by its number."""
    names = F.array(*(F.lit(n) for n in ("instruction", "summarization", "cot", "multiple_choice")))
    kind = F.element_at(names, (F.col("turn") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "conversations").where("text <> ''").select("conv_id", "turn", kind.alias("data_type"), F.when(kind != "instruction", F.col("role")).alias("metadata"), F.col("text").alias("input_text"), F.col("role").alias("target_text"), F.when(kind == "summarization", "short").alias("summary"))
    return ts.supervised(ts.routed(rows)).select("conv_id", "turn", "handler", "prompt_text", "input", "output")


@query("pk6_truncated", f"SELECT doc_id, CAST(least(len(ids), 128) AS INTEGER) AS n, md5(array_to_string(list_slice(ids, 1, 128), ' ')) AS digest FROM {_IDS}")
def truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents longer than a pack, cut before packing."""
    rows = batching.truncated(_ids(spark, sf_dir), ["ids"], 128)
    return rows.select("doc_id", F.size("ids").alias("n"), F.md5(_text(F.col("ids"))).alias("digest"))


@query("ba4_plain_batches", f"SELECT doc_id, (row_number() OVER (ORDER BY {H('e0', 'doc_id')}, doc_id) - 1) // 32 AS batch_id FROM documents")
def plain_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of a seeded order, the last one kept."""
    ranked = hash_rank(table(spark, sf_dir, "documents").select("doc_id"), "e0", "doc_id")
    return ranked.select("doc_id", F.floor((F.col("rn") - 1) / 32).cast("bigint").alias("batch_id"))


@query("ba7_eval_batches", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch_id FROM labels")
def eval_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.batches(table(spark, sf_dir, "labels").select("doc_id"), 16, "doc_id", drop_last=False)


@query("ss10_reset_state", "SELECT source, CAST(0 AS BIGINT) AS consumed FROM documents GROUP BY source")
def reset_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.reset(mixing.state(_words(spark, sf_dir))).select("source", "consumed")


@query("st9_beam_candidates", "SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS r FROM lineitem) WHERE r <= 4")
def beam_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2k candidates of a beam of k = 2."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return rel.top_k(rows, "l_orderkey", "l_extendedprice", "l_linenumber", 4).select("l_orderkey", "l_linenumber")


_CHAT = {"system": 195, "user": 196, "assistant": 197, "end": 198}
_LABELS = {"en": 0, "de": 1, "es": 2}
_CLS = "CASE WHEN len({0}) > {1} THEN list_concat(list_slice({0}, 1, {1} - 1), [198]) ELSE {0} END"
_ZEROS = "list_slice(list_concat({0}, list_transform(range({1}), lambda x: CAST(0 AS INTEGER))), 1, {1})"


@query("ts17_classifier_ids", f"""SELECT doc_id, CAST(CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END AS INTEGER) AS label, array_to_string({_ZEROS.format(_CLS.format('e', 48), 48)}, ' ') AS input_ids, array_to_string({_ZEROS.format(_CLS.format('d', 32), 32)}, ' ') AS decoder_input_ids, CAST(least(48, len(e)) AS INTEGER) AS n
   FROM (SELECT doc_id, lang, list_concat([195, 5, 6, 196], ids, [198]) AS e, list_concat([197], ids, [198]) AS d FROM {_IDS} i JOIN documents USING (doc_id) WHERE lang IN ('en', 'de', 'es'))""")
def classifier_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chat form; rows of a label that is not in the map are left out."""
    labels = spark.createDataFrame(list(_LABELS.items()), "lang string, label int")
    rows = rel.lookup(table(spark, sf_dir, "documents").select("doc_id", "lang"), labels, "lang", "label", -1).where("label >= 0")
    none = F.lit(None).cast("array<int>")
    made = ts.classifier_ids(F.col("ids"), none, F.array(F.lit(5), F.lit(6)), 48, 32, chat=_CHAT)
    rows = rows.join(_ids(spark, sf_dir), "doc_id").select("doc_id", "label", made.alias("s"))
    return rows.select("doc_id", "label", _text(F.col("s.input_ids")).alias("input_ids"), _text(F.col("s.decoder_input_ids")).alias("decoder_input_ids"), F.aggregate("s.attention_mask", F.lit(0), lambda n, x: n + x).alias("n"))


@query("ts17_classifier_script_ids", f"""SELECT doc_id, array_to_string({_ZEROS.format('e', 48)}, ' ') AS input_ids, array_to_string({_ZEROS.format('d', 32)}, ' ') AS decoder_input_ids
   FROM (SELECT doc_id, list_concat([5, 6], ids, [2, 9]) AS e, list_concat([9], ids, [2]) AS d FROM {_IDS})""")
def classifier_script_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("array<int>")
    rows = _ids(spark, sf_dir).select("doc_id", ts.classifier_ids(F.col("ids"), none, F.array(F.lit(5), F.lit(6)), 48, 32, script=F.lit(9)).alias("s"))
    return rows.select("doc_id", _text(F.col("s.input_ids")).alias("input_ids"), _text(F.col("s.decoder_input_ids")).alias("decoder_input_ids"))


_SIDES = f"(SELECT doc_id, ids, CASE WHEN doc_id % 7 > 0 THEN list_slice(ids, 1, len(ids) // 2) END AS dec FROM {_IDS})"


def _sides(spark, sf_dir):
    return _ids(spark, sf_dir).withColumn("dec", F.when(F.col("doc_id") % 7 > 0, F.slice("ids", F.lit(1), F.floor(F.size("ids") / 2).cast("int"))))


@query("pk5_standalone", f"SELECT doc_id, array_to_string({_ZEROS.format('ids', 64)}, ' ') AS input_ids, array_to_string({_ZEROS.format('dec', 64)}, ' ') AS decoder_input_ids, CAST(least(64, len(ids)) AS INTEGER) AS n, CAST(least(64, len(dec)) AS INTEGER) AS last FROM {_SIDES} WHERE len(ids) > 0 AND dec IS NOT NULL AND len(dec) > 0")
def standalone_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = batching.standalone(_sides(spark, sf_dir), "ids", "dec", 64)
    total = F.aggregate("segment_ids", F.lit(0), lambda n, x: n + x)
    return made.select("doc_id", _text(F.col("input_ids")).alias("input_ids"), _text(F.col("decoder_input_ids")).alias("decoder_input_ids"), total.alias("n"), F.array_max("decoder_position_ids").alias("last"))


@query("pk5_malformed", f"SELECT count(*) AS n FROM {_SIDES} WHERE len(ids) = 0 OR dec IS NULL OR len(dec) = 0")
def malformed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sides(spark, sf_dir).where(batching.malformed(F.col("ids"), F.col("dec"))).agg(F.count("*").alias("n"))


@query("pk9_packed_batch")
def packed_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs as arrays, from unpadded ids; tests hold them against the documents' ids."""
    rows = batching.buffer_ids(_sides(spark, sf_dir).withColumn("part", F.lit("all")), 64, "doc_id", ["part"])
    made = batching.packed_batch(rows, "ids", "dec", "doc_id", ["part", "buffer_id"], 512, 0.8)
    return made.select("buffer_id", "pack", "n_docs", _text(F.col("input_ids")).alias("input_ids"), _text(F.col("segment_ids")).alias("segment_ids"))


@query("snk1_parquet", "SELECT doc_id, lang, text FROM documents")
def parquet_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sinks.shared_folder(spark)}/zstd"
    sinks.write_parquet(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), path)
    return spark.read.parquet(path)


@query("snk2_parquet_and_csv", "SELECT doc_id, lang, 'csv' AS kind FROM documents UNION ALL SELECT doc_id, lang, 'parquet' FROM documents")
def dual_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sinks.shared_folder(spark)}/both"
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang")
    sinks.write_parquet_and_csv(rows, path)
    lines = spark.read.option("header", True).schema(rows.schema).csv(f"{path}.csv").withColumn("kind", F.lit("csv"))
    return lines.unionByName(spark.read.parquet(f"{path}.parquet").withColumn("kind", F.lit("parquet")))


@query("snk3_json_summary", """SELECT '{"n":' || count(*) || ',"chars":' || CAST(sum(n_chars) AS BIGINT) || '}' AS value FROM documents""")
def json_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sinks.shared_folder(spark)}/summary"
    sinks.write_json(table(spark, sf_dir, "documents").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")), path)
    return spark.read.text(path)


@query("snk4_lines", "SELECT url AS value FROM pages WHERE url IS NOT NULL")
def lines_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sinks.shared_folder(spark)}/urls"
    sinks.write_lines(table(spark, sf_dir, "pages"), "url", path)
    return spark.read.text(path)


@query("src9_cached_slice", "SELECT lang, count(*) AS n, (SELECT count(*) FROM documents WHERE n_chars > 500) AS whole FROM documents WHERE n_chars > 500 GROUP BY lang")
def cached_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made once and read back the second time, with its number of rows beside it."""
    path = readers.cache_path(sinks.shared_folder(spark), "documents", "full", 0, "train")
    rows = table(spark, sf_dir, "documents").where("n_chars > 500").select("doc_id", "lang")
    readers.cached_with_count(spark, path, lambda: rows)
    again, n = readers.cached_with_count(spark, path, lambda: rows.limit(0))
    return again.groupBy("lang").agg(F.count("*").alias("n")).withColumn("whole", F.lit(n).cast("bigint"))
