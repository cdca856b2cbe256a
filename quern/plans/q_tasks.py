"""Queries: task routing, prompts, chat strings and candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import tasks as ts
from quern.plans.q_tokens import _IDS, _ids
from quern.plans.sql import U
from quern.queryset import query, table

PROMPTS = {
    "denoising": ["Restore the text.", "Repair the passage."],
    "denoising:text": ["Restore this text."],
    "denoising:text:bart": ["Fill the masks."],
    "denoising:text:bart:shuffled": ["Fill the masks and order the sentences."],
    "continuation": ["Continue."],
    "transcription_hanja_to_hangul": ["Write in Hangul."],
    "transcription_hangul_to_hanja": ["Write in Hanja."],
}


def _chats(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


@query("ts1_task_types", "SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'sts' WHEN 1 THEN 'ocr_correction' WHEN 2 THEN 'unsupervised_pretraining' ELSE 'nli' END AS handler FROM conversations")
def task_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("turn") % 4
    rows = _chats(spark, sf_dir).select("conv_id", "turn", F.when(k == 0, "sts").when(k == 3, "nli").otherwise("mixed").alias("data_type"), F.when(k == 1, F.col("text")).alias("corrected"))
    return ts.routed(rows).select("conv_id", "turn", "handler")


@query("ts2_supervised", """SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN concat('sentence1: ', role, ' sentence2: ', text) ELSE text END AS input,
   CASE turn % 3 WHEN 0 THEN printf('%.1f', CAST(3.5 AS DOUBLE)) ELSE role END AS output FROM conversations WHERE text <> ''""")
def supervised(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("turn") % 3
    rows = _chats(spark, sf_dir).where("text <> ''").select(
        "conv_id", "turn", F.when(k == 0, "sts").when(k == 1, "nli").otherwise("instruction").alias("data_type"), F.col("text").alias("input_text"), F.when(k > 0, F.col("role")).alias("target_text"),
        F.when(k == 0, F.col("role")).alias("sentence1"), F.when(k == 0, F.col("text")).alias("sentence2"), F.lit(3.5).alias("rounded_score"),
    )
    return ts.supervised(ts.routed(rows)).select("conv_id", "turn", "input", "output")


@query("ts4_temporal_classification", "SELECT o_orderkey, o_orderpriority AS input, CAST(year(o_orderdate) AS VARCHAR) AS output FROM orders WHERE o_orderkey % 2 = 0")
def temporal_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.when(F.col("o_orderkey") % 2 == 0, F.year("o_orderdate"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("temporal_classification").alias("data_type"), F.col("o_orderpriority").alias("text"), year.alias("year"))
    return ts.supervised(ts.routed(rows)).select("o_orderkey", "input", "output")


@query("ts5_temporal_routes", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'temporal_continuation' ELSE 'unsupervised_pretraining' END AS route FROM orders")
def temporal_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.when(F.col("o_orderkey") % 2 == 0, F.year("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", ts.temporal_route(year).alias("route"))


@query("ts15_chat_strings", "SELECT u.conv_id, u.turn, CASE WHEN u.turn = 0 THEN '' ELSE '<|system|>sys' END || '<|user|>' || u.text || '<|end_of_turn|>' AS encoder, '<|think|>t<|assistant|>' || a.text || '<|end_of_turn|>' AS target FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'")
def chat_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _chats(spark, sf_dir).where("role = 'user'").select("conv_id", "turn", F.col("text").alias("user"))
    a = _chats(spark, sf_dir).where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    system = F.when(F.col("turn") > 0, "sys")
    return u.join(a, ["conv_id", "turn"]).select("conv_id", "turn", ts.chat_encoder(system, F.col("user")).alias("encoder"), ts.chat_target(F.col("answer"), F.lit("t")).alias("target"))


_CUT = "CASE WHEN len({0}) > {1} THEN list_concat(list_slice({0}, 1, {1} - 1), [93]) ELSE {0} END"


@query("ts15_chat_ids", f"""SELECT doc_id, array_to_string({_CUT.format('e', 40)}, ' ') AS input_ids, array_to_string(list_slice(t, 1, len(t) - 1), ' ') AS decoder_input_ids, array_to_string(list_slice(t, 2, len(t)), ' ') AS labels
   FROM (SELECT doc_id, e, {_CUT.format('t', 31)} AS t FROM (SELECT doc_id, list_concat(CASE WHEN doc_id % 2 = 0 THEN [90, 5] ELSE [] END, [91], ids, [93]) AS e, list_concat(CASE WHEN doc_id % 3 = 0 THEN [94, 8] ELSE [] END, [92], ids, [93]) AS t FROM {_IDS}))""")
def chat_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = {ts.SYSTEM: 90, ts.USER: 91, ts.ASSISTANT: 92, ts.END: 93, ts.THINK: 94}
    some = lambda n, x: F.when(F.col("doc_id") % n == 0, F.array(F.lit(x))).otherwise(F.array().cast("array<int>"))
    made = _ids(spark, sf_dir).select("doc_id", ts.chat_ids(some(2, 5), F.col("ids"), F.col("ids"), some(3, 8), ids, 40, 30).alias("c"))
    text = lambda n: F.array_join(F.col(f"c.{n}").cast("array<string>"), " ").alias(n)
    return made.select("doc_id", text("input_ids"), text("decoder_input_ids"), text("labels"))


_TEMPLATE = "string_agg(CASE WHEN role = 'system' THEN '<|system|>' || text ELSE '<|' || role || '|>' || text || '<|end_of_turn|>' END, '' ORDER BY turn)"


@query("ts16_chat_template", f"SELECT conv_id, {_TEMPLATE} || '<|assistant|>' AS formatted FROM conversations GROUP BY conv_id")
def chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.chat_template(_chats(spark, sf_dir), generation_prompt=True)


@query("ts18_candidates", "SELECT l_orderkey, CAST(i AS INTEGER) AS cand_idx, c AS candidate, CAST(greatest(1, octet_length(encode(c))) AS INTEGER) AS n_bytes FROM (SELECT DISTINCT l_orderkey FROM lineitem), (VALUES (0, 'yes'), (1, '아니오'), (2, '')) t(i, c)")
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey").distinct().withColumn("candidates", F.array(F.lit("yes"), F.lit("아니오"), F.lit("")))
    return ts.expand_candidates(rows, "candidates", ["l_orderkey"])


@query("ts19_decade_grid", "SELECT doc_id, CAST(i AS INTEGER) AS cand_idx, CAST(1920 + 10 * i AS INTEGER) AS decade, CAST(1925 + 10 * i AS INTEGER) AS midpoint FROM labels, range(8) t(i)")
def decade_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.decade_grid(table(spark, sf_dir, "labels"), ["doc_id"])


@query("ts20_prompt_keys", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN replace('denoising:text:bart:X:light|denoising:text:bart:X|denoising:text:bart|denoising:text|denoising', 'X', CASE WHEN n_chars > 500 THEN 'shuffled' ELSE 'no_shuffle' END)
   WHEN 1 THEN 'denoising:text:sentinel:heavy|denoising:text:sentinel|denoising:text|denoising' ELSE 'sts:text|sts' END AS keys FROM documents""")
def prompt_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 3
    keys = ts.prompt_keys(F.when(k < 2, "denoising").otherwise("sts"), F.lit("text"), F.when(k == 0, "bart").when(k == 1, "sentinel"), F.col("n_chars") > 500, F.when(k == 0, "light").when(k == 1, "heavy"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(keys, "|").alias("keys"))


@query("ts21_prompts", f"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Fill the masks and order the sentences.' WHEN 1 THEN 'Continue.'
   ELSE CASE WHEN {U('42way', 'doc_id')} < 0.5 THEN 'Write in Hangul.' ELSE 'Write in Hanja.' END END AS prompt FROM documents""")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 3
    task = ts.resolved_task(F.when(k == 0, "denoising").when(k == 1, "continuation").otherwise("transcription"), F.lit(None).cast("string"), "doc_id")
    keys = ts.prompt_keys(task, F.lit("text"), F.when(k == 0, "bart"), F.lit(True), F.lit(None).cast("string"))
    return ts.attach_prompt(table(spark, sf_dir, "documents").select("doc_id"), PROMPTS, keys, "doc_id").select("doc_id", "prompt")


@query("ts22_prompt_draw", f"SELECT doc_id, CASE CAST(floor({U('42prompt', 'doc_id')} * 2) AS INTEGER) WHEN 0 THEN 'Restore the text.' ELSE 'Repair the passage.' END AS metadata FROM documents")
def prompt_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.array(F.lit("missing"), F.lit("denoising"))
    return ts.attach_prompt(table(spark, sf_dir, "documents").select("doc_id"), PROMPTS, keys, "doc_id", name="metadata")


@query("jn11_prompt_lookup", "SELECT DISTINCT lang, CASE lang WHEN 'en' THEN 'A' WHEN 'de' THEN 'B' ELSE 'other' END AS prompt FROM documents")
def prompt_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = ts.first_registered({"en": "A", "de": "B", "*": "other"}, [F.col("lang"), F.lit("*")])
    return table(spark, sf_dir, "documents").select("lang", pick.alias("prompt")).distinct()
