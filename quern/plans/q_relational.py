"""Queries: projection, predicates, joins, aggregates, ranks, order, sets, packing and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import config
from quern.functions import text as tx
from quern.functions import tokens as tk
from quern.operators import metrics as ev
from quern.operators import batching, corruption, mixing
from quern.operators import relational as rel
from quern.operators.ranks import floor_div
from quern.plans.q_sampling import WORDS, _words
from quern.queryset import query, table
from quern.sources import arrowfiles, readers, sinks


def _docs(spark, sf_dir, *cols):
    return table(spark, sf_dir, "documents").select(*(cols or ("doc_id", "lang", "source", "text")))


# --- scans, sources, sinks ---------------------------------------------------------------------------------------


@query("src1_pruned_scan", "SELECT doc_id, source FROM documents")
def pruned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.scan(spark, f"{sf_dir}/documents.parquet", ["doc_id", "source"])


@query("src2_file_list", "SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM documents")
def file_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.scan(spark, [f"{sf_dir}/documents.parquet"] * 2, ["doc_id"])


@query("src3_checked_read", "SELECT count(*) AS n FROM benchmark")
def checked_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.load(spark, f"{sf_dir}/benchmark.parquet").agg(F.count("*").alias("n"))


@query("src5_first_values", "SELECT text FROM documents ORDER BY doc_id LIMIT 10")
def first_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.first_values(_docs(spark, sf_dir), "text", 10, "doc_id")


@query("src10_choice_benchmark", """SELECT encoder_input, correct_idx, category, benchmark FROM (
  SELECT *, row_number() OVER (PARTITION BY benchmark ORDER BY md5(concat_ws(':', '42', encoder_input)), encoder_input) AS rn FROM (
  SELECT CAST(o_orderkey AS VARCHAR) AS encoder_input, CAST(o_orderkey % 3 AS INTEGER) AS correct_idx, o_orderstatus AS category, o_orderpriority AS benchmark FROM orders)) WHERE rn <= 200""")
def choice_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(F.col("o_orderkey").cast("string").alias("encoder_input"), F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("candidates"), (F.col("o_orderkey") % 3).cast("int").alias("correct_idx"), F.col("o_orderstatus").alias("category"), F.col("o_orderpriority").alias("benchmark"))
    from quern.operators.sampling import cap_per_group

    checked = rel.require_columns(rows, list(readers.CHOICE_FIELDS))
    return cap_per_group(checked, 200, "benchmark", "encoder_input").select("encoder_input", "correct_idx", "category", "benchmark")


def registered_rows(spark: SparkSession, sf_dir: str, make) -> DataFrame:
    """Rows (source_name, data_type, text) of the sources that make(root) gives, read as they say from files that all documents
    are written to: each document goes to one source, in the columns that its fields name."""
    sources, docs = make(sinks.shared_folder(spark)), _docs(spark, sf_dir, "doc_id", "text", "lang")
    for k, s in enumerate(sources):
        filled = [(F.col("text") if c == s.text_field else F.concat_ws(":", F.lit(c), "lang")).alias(c) for c in s.required_columns]
        sinks.write_parquet(docs.where(F.col("doc_id") % len(sources) == k).select(*filled), s.pattern.rpartition("/")[0])
    rows = readers.scan_all(spark, sources)
    of = lambda s, c: F.when(F.col("source_name") == s.name, c)
    text = F.coalesce(*(of(s, F.col(s.text_field)) for s in sources))
    return rows.select("source_name", F.coalesce(*(of(s, F.lit(s.data_type)) for s in sources)).alias("data_type"), text.alias("text"))


def registered_sql(sources: list[tuple[str, str]]) -> str:
    values = ", ".join(f"({k}, '{n}', '{t}')" for k, (n, t) in enumerate(sources))
    return f"SELECT source_name, data_type, text FROM documents JOIN (VALUES {values}) s(k, source_name, data_type) ON doc_id % {len(sources)} = k"


@query("src12_source_registry", registered_sql([("curated", "mixed"), ("web", "denoising"), ("pdf", "denoising"), ("historical", "denoising"), ("sts", "sts"), ("topics", "topic_classification"), ("nli", "nli")]))
def source_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registered_rows(spark, sf_dir, config.pretraining_sources)


@query("src15_eval_sources", "SELECT 'docs_eval' AS source_name, text FROM benchmark UNION ALL SELECT 'turns_eval', text FROM conversations")
def eval_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation rows of training sources, of those that have any."""
    evals = {"docs": "benchmark", "turns": "conversations", "web": None}
    sources = [config.SourceConfig(n, f"{sf_dir}/documents.parquet", 1.0, "mixed", metadata_field=None, eval_pattern=t and f"{sf_dir}/{t}.parquet") for n, t in evals.items()]
    return readers.scan_all(spark, config.split_sources(sources, "eval")).select("source_name", "text")


@query("src16_all_sources", "SELECT 'docs' AS source_name, doc_id, NULL AS url, length(text) AS n FROM documents UNION ALL SELECT 'pages', page_id, url, NULL FROM pages")
def all_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = [config.SourceConfig("docs", f"{sf_dir}/documents.parquet", 1.0, "mixed", metadata_field=None, extra_columns=("doc_id",)), config.SourceConfig("pages", f"{sf_dir}/pages.parquet", 1.0, "mixed", text_field="page_id")]
    rows = readers.scan_all(spark, sources)
    return rows.select("source_name", F.coalesce("doc_id", "page_id").alias("doc_id"), "url", F.length("text").cast("bigint").alias("n"))


@query("src4_arrow_files", "SELECT doc_id, text, lang FROM documents")
def arrow_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as Arrow files and read back, three of their columns."""
    folder = f"{sinks.shared_folder(spark)}/arrow"
    arrowfiles.write_arrow(_docs(spark, sf_dir, "doc_id", "source", "text", "lang", "n_chars"), folder, rows=500)
    return arrowfiles.read_arrow(spark, f"{folder}/*.arrow", ["doc_id", "text", "lang"])


@query("src11_temporal_benchmark", """SELECT encoder_input, correct_idx, category, benchmark, true_year FROM (
  SELECT *, row_number() OVER (PARTITION BY benchmark ORDER BY md5(concat_ws(':', '42', encoder_input)), encoder_input) AS rn FROM (
  SELECT CAST(o_orderkey AS VARCHAR) AS encoder_input, CAST(o_orderkey % 3 AS INTEGER) AS correct_idx, o_orderstatus AS category, o_orderpriority AS benchmark, CAST(year(o_orderdate) AS INTEGER) AS true_year FROM orders)) WHERE rn <= 150""")
def temporal_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as questions in two files, read as a benchmark with years."""
    orders = table(spark, sf_dir, "orders")
    fields = [F.col("o_orderkey").cast("string").alias("encoder_input"), F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("candidates"), (F.col("o_orderkey") % 3).cast("int").alias("correct_idx")]
    rows = orders.select(*fields, F.col("o_orderstatus").alias("category"), F.col("o_orderpriority").alias("benchmark"), F.year("o_orderdate").alias("true_year"))
    folder = sinks.shared_folder(spark)
    paths = [f"{folder}/even", f"{folder}/odd"]
    for k, path in enumerate(paths):
        sinks.write_parquet(rows.where(F.col("correct_idx") % 2 == k), path)
    found = readers.benchmark(spark, paths, 150, temporal=True)
    return found.select("encoder_input", "correct_idx", "category", "benchmark", "true_year")


@query("src19_stale_files", "SELECT DISTINCT 'lang=' || lang AS name, CASE lang WHEN (SELECT min(lang) FROM documents) THEN 'missing' WHEN (SELECT max(lang) FROM documents) THEN 'changed' ELSE 'same' END AS state FROM documents UNION ALL SELECT 'extra', 'extra'")
def stale_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two written copies of documents, a file for each language; the second lacks one, has another changed and one more."""
    folder, docs = sinks.shared_folder(spark), _docs(spark, sf_dir, "lang", "text")
    first, last = docs.agg(F.min("lang"), F.max("lang")).first()
    put = lambda df, to: df.repartition("lang").write.partitionBy("lang").text(f"{folder}/{to}")
    put(docs, "remote")
    more = F.when(F.col("lang") == last, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    changed = docs.where(F.col("lang") != first).select("lang", more.alias("text"))
    put(changed.unionByName(docs.limit(1).withColumn("lang", F.lit("extra"))), "local")

    def listed(of: str) -> DataFrame:
        place = F.regexp_extract("path", "lang=([^/]*)", 1)
        rows = readers.listing(spark, f"{folder}/{of}", recursive=True)
        return rows.groupBy(F.when(place == "extra", place).otherwise(F.concat(F.lit("lang="), place)).alias("name")).agg(F.sum("size").alias("size"))

    stale = readers.stale_files(listed("remote"), listed("local"))
    return stale.unionByName(listed("remote").join(stale, "name", "left_anti").select("name", F.lit("same").alias("state")))


@query("snk5_long_metrics", "SELECT 'labels/' || name AS name, value, 3 AS step FROM (SELECT 'n' AS name, CAST(count(*) AS DOUBLE) AS value FROM labels UNION ALL SELECT 'quality', avg(quality) FROM labels)")
def long_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "labels").agg(F.count("*").alias("n"), F.avg("quality").alias("quality"))
    return rel.long_metrics(one, "labels", ["n", "quality"], 3)


@query("snk6_json_metadata", "SELECT doc_id, base64(encode(lang)) AS blob, CAST(doc_id * 2 AS BIGINT) AS tokens FROM documents")
def json_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    meta = sinks.json_metadata([F.encode("lang", "UTF-8"), (F.col("doc_id") * 2)], ("blob",), ["blob", "tokens_seen"])
    rows = docs.select("doc_id", meta.alias("m"))
    return rows.select("doc_id", F.get_json_object("m", "$.blob").alias("blob"), sinks.tokens_from_metadata(F.col("m")).alias("tokens"))


# --- projection and predicates -----------------------------------------------------------------------------------


@query("prj1_canonical", "SELECT text AS original_text, lang AS metadata, source, 'mixed' AS data_type, CAST(n_chars AS INTEGER) AS year, target IS NULL AS no_target FROM (SELECT *, NULL AS target FROM documents)")
def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = config.SourceConfig("docs", "", 1.0, "mixed", metadata_field="lang", year_field="n_chars", target_field="absent")
    rows = rel.canonical(table(spark, sf_dir, "documents"), source)
    return rows.select("original_text", "metadata", "source", "data_type", "year", F.col("target").isNull().alias("no_target"))


@query("prj3_title_and_body", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text WHEN doc_id % 3 = 1 THEN lang || chr(10) || text END AS body FROM documents")
def title_and_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 3
    title, body = F.when(k == 0, "").when(k == 1, F.col("lang")).otherwise(F.col("lang")), F.when(k < 2, F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", tx.title_and_body(title, body).alias("body"))


@query("prj4_literal_column", "SELECT doc_id, 'prompt' AS metadata FROM documents")
def literal_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "doc_id").withColumn("metadata", F.lit("prompt"))


@query("prj5_row_index", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS local_index FROM documents")
def row_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.add_row_index(_docs(spark, sf_dir, "doc_id"), "doc_id")


@query("prj8_first_text", "SELECT turn, conv_id, coalesce(nullif(CASE WHEN turn = 0 THEN '' END, ''), nullif(role, 'user'), text) AS pick FROM conversations")
def first_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select("turn", "conv_id", tx.first_text(F.when(F.col("turn") == 0, ""), F.nullif("role", F.lit("user")), F.col("text")).alias("pick"))


@query("prj7_eval_adapter", "SELECT page_id, url AS metadata, coalesce(nullif(html, ''), url) AS original_text, 'pages' AS source FROM pages")
def eval_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.col("url").alias("metadata"), tx.first_text(F.col("html"), F.col("url")).alias("original_text"), F.lit("pages").alias("source"))


@query("prj10_renamed", "SELECT item_id, text AS source_text FROM benchmark")
def renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").withColumnsRenamed({"text": "source_text"})


@query("flt1_drop_empty", "SELECT doc_id FROM documents WHERE text IS NOT NULL AND text <> ''")
def drop_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.drop_empty(_docs(spark, sf_dir), "text").select("doc_id")


@query("flt2_drop_empty_target", "SELECT conv_id, turn FROM conversations WHERE role = 'assistant' AND text <> ''")
def drop_empty_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("target", F.when(F.col("role") == "assistant", F.col("text")))
    return rel.drop_empty(rows, "role", "target").select("conv_id", "turn")


@query("flt3_year_range", "SELECT o_orderkey FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998")
def year_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(F.year("o_orderdate").between(1996, 1998)).select("o_orderkey")


@query("flt4_literal_absent", "SELECT count(*) AS n FROM documents WHERE NOT contains(text, '<unk>')")
def literal_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.require_absent(_docs(spark, sf_dir), "text", "<unk>").where("text is not null").agg(F.count("*").alias("n"))


@query("flt6_sufficient_text", r"SELECT doc_id, length(regexp_replace(text, '[\d\s.,·()\[\]{}+=*/-]+', '', 'g')) / CAST(length(text) AS DOUBLE) >= 0.85 AS enough FROM documents WHERE length(text) > 0")
def sufficient_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where("length(text) > 0").select("doc_id", tx.sufficient_text(F.col("text"), 0.85).alias("enough"))


@query("flt7_min_tokens", f"SELECT doc_id FROM {WORDS} WHERE n_tokens >= 20")
def min_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.transform(F.filter(F.split("text", r"\s+"), lambda w: w != ""), lambda w: F.length(w))
    return _docs(spark, sf_dir).where(tk.long_enough(F.concat(ids, F.array_repeat(F.lit(-1), 5)), -1)).select("doc_id")


@query("flt8_keep_mask", "SELECT page_id, coalesce(url NOT IN (SELECT url FROM pages WHERE page_id < 5), TRUE) AS keep FROM (SELECT page_id, CASE WHEN page_id % 10 > 0 THEN url END AS url FROM pages)")
def keep_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rows = pages.select("page_id", F.when(F.col("page_id") % 10 > 0, F.col("url")).alias("tail"))
    found = rel.flag_members(rows, pages.where("page_id < 5"), "tail", "excluded", "url")
    return found.select("page_id", (~F.col("excluded")).alias("keep"))


@query("flt9_corruption_eligible", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN TRUE WHEN 1 THEN TRUE WHEN 2 THEN TRUE ELSE FALSE END AS eligible FROM documents")
def corruption_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit(None).cast("string"), F.lit("mixed"), F.lit("denoising"), F.lit("sts")), (F.col("doc_id") % 4 + 1).cast("int"))
    return _docs(spark, sf_dir).select("doc_id", corruption.eligible(kind).alias("eligible"))


@query("flt10_byte_eligible", "SELECT doc_id, octet_length(encode(text)) <= 2048 - 48 AS eligible FROM documents")
def byte_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", corruption.byte_eligible(F.col("text"), 2048, 0.1).alias("eligible"))


@query("flt11_task_filter", "SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de', 'fr')")
def task_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the sources that a list of tasks leaves: those of pre-training always, of the others the named one."""
    kinds = {"en": "mixed", "de": "denoising", "fr": "sts", "es": "nli"}
    sources = [config.SourceConfig(name, f"{sf_dir}/documents.parquet", 0.25, kind) for name, kind in kinds.items()]
    return _docs(spark, sf_dir, "doc_id", "lang").where(F.col("lang").isin([s.name for s in config.select_sources(sources, "sts")]))


@query("flt12_valid_rows", "SELECT d.doc_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL AND d.text IS NOT NULL")
def valid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rel.complete(rows, ["quality", "text"]).select("doc_id")


@query("flt13_stale_sources", "SELECT doc_id, source FROM documents WHERE source NOT IN ('src0', 'src1')")
def stale_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir, "doc_id", "source")
    names = docs.select("source").distinct()
    stale = F.col("source").isin("src0", "src1")
    return rel.active_sources(docs, names.where(~stale), names.where(stale))


@query("flt15_sequence_length", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 0 WHEN n_chars - 500 >= 0 THEN n_chars - 500 ELSE 0 END AS n FROM documents")
def sequence_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.when(F.col("doc_id") % 5 > 0, F.col("n_chars") - 500)
    return table(spark, sf_dir, "documents").select("doc_id", tk.sequence_length(n).alias("n"))


@query("flt16_year_route", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'unsupervised_pretraining' ELSE 'temporal_continuation' END AS handler FROM orders")
def year_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.operators.tasks import temporal_route

    year = F.when(F.col("o_orderkey") % 3 > 0, F.year("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", temporal_route(year).alias("handler"))


@query("flt17_halves", r"""SELECT doc_id, array_to_string(list_slice(w, 1, len(w) // 2), ' ') AS input, array_to_string(list_slice(w, len(w) // 2 + 1, len(w)), ' ') AS target
   FROM (SELECT doc_id, regexp_split_to_array(trim(text), '\s+') AS w FROM documents) WHERE len(w) > 6""")
def halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", tx.halves(F.col("text")).alias("h")).where("h is not null")
    return rows.select("doc_id", "h.input", "h.target")


@query("flt18_char_budget", "SELECT CAST(count(*) FILTER (length(text) <= 3 * 512) AS BIGINT) AS kept, CAST(count(*) FILTER (length(text) > 3 * 512) AS BIGINT) AS dropped FROM documents")
def char_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.budget_counts(_docs(spark, sf_dir), "text", 512)


@query("flt19_named_sources", "SELECT 'text_documents' AS source_name, text FROM documents UNION ALL SELECT 'text_benchmark', text FROM benchmark")
def named_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the sources whose names have a part."""
    at = {"text_documents": "documents", "web_pages": "pages", "text_benchmark": "benchmark"}
    sources = [config.SourceConfig(name, f"{sf_dir}/{t}.parquet", 1.0, "mixed", metadata_field=None) for name, t in at.items()]
    return readers.scan_all(spark, config.named_like(sources, "text")).select("source_name", "text")


# --- joins and membership ----------------------------------------------------------------------------------------


@query("jn1_anti_join", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.without(_docs(spark, sf_dir, "doc_id"), table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")


@query("jn2_semi_join", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.within(_docs(spark, sf_dir, "doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query("jn3_referential_check", "SELECT count(*) AS n FROM labels")
def referential_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.require_all(table(spark, sf_dir, "labels"), _docs(spark, sf_dir, "doc_id"), "doc_id").agg(F.count("*").alias("n"))


@query("jn4_key_membership", "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS labelled FROM documents")
def key_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.flag_members(_docs(spark, sf_dir, "doc_id"), table(spark, sf_dir, "labels"), "doc_id", "labelled")


@query("jn5_text_membership", "SELECT doc_id, text IN (SELECT text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) AS known FROM documents")
def text_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir, "doc_id", "text")
    labelled = rel.within(docs, table(spark, sf_dir, "labels"), "doc_id")
    return rel.flag_text_members(docs, labelled, "text", "known").select("doc_id", "known")


@query("jn6_missing_count", "SELECT count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.without(_docs(spark, sf_dir, "doc_id"), table(spark, sf_dir, "labels"), "doc_id").agg(F.count("*").alias("n"))


@query("jn7_literal_members", "SELECT doc_id FROM documents WHERE source IN ('src1', 'src2')")
def literal_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "doc_id", "source").where(F.col("source").isin("src1", "src2")).select("doc_id")


@query("jn8_lookup_default", "SELECT c_custkey, coalesce(n_name, 'none') AS n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey")
def lookup_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").where("n_nationkey < 20").withColumnRenamed("n_nationkey", "c_nationkey")
    return rel.lookup(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), nations, "c_nationkey", "n_name", "none").select("c_custkey", "n_name")


@query("jn9_label_lookup", "SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE -1 END AS INTEGER) AS label FROM orders")
def label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.createDataFrame([("F", 0), ("O", 1)], "o_orderstatus string, label int")
    return rel.lookup(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), labels, "o_orderstatus", "label", -1).select("o_orderkey", "label")


@query("jn12_zip_by_key", "SELECT d.doc_id, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def zip_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id")


# --- aggregates --------------------------------------------------------------------------------------------------


@query("ag1_count", "SELECT count(*) AS n FROM lineitem")
def count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"))


@query("ag2_group_count", "SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("ag3_group_indices", "SELECT source, chunk, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids FROM (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 100 AS chunk FROM documents) GROUP BY source, chunk")
def group_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of each source in lists of a hundred, so that no list grows with its source."""
    rows = batching.buffer_ids(_docs(spark, sf_dir, "doc_id", "source"), 100, "doc_id", ["source"], "chunk")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("doc_id")), lambda i: i.cast("string")), ",")
    return rows.groupBy("source", "chunk").agg(ids.alias("ids"))


@query("ag4_distinct_keys", "SELECT count(DISTINCT text) AS texts, count(DISTINCT source) AS sources FROM documents")
def distinct_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).agg(F.count_distinct("text").alias("texts"), F.count_distinct("source").alias("sources"))


@query("ag5_one_pass", "SELECT count(*) AS n, CAST(sum(quality) AS BIGINT) AS good, count(*) FILTER (doc_id IN (1, 2, 3)) AS few, count(*) FILTER (toxic IS NULL) AS unknown, count(DISTINCT CASE WHEN toxic = 1 THEN doc_id END) AS toxic_docs FROM labels")
def one_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    toxic = F.count_distinct(F.when(F.col("toxic") == 1, F.col("doc_id")))
    return table(spark, sf_dir, "labels").agg(F.count("*").alias("n"), F.sum("quality").alias("good"), F.count_if(F.col("doc_id").isin(1, 2, 3)).alias("few"), F.count_if(F.col("toxic").isNull()).alias("unknown"), toxic.alias("toxic_docs"))


@query("ag6_filtered_distinct", "SELECT count(DISTINCT source) FILTER (lang = 'de') AS n FROM documents")
def filtered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).agg(F.count_distinct(F.when(F.col("lang") == "de", F.col("source"))).alias("n"))


@query("ag7_nearest_quantiles", """WITH r AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)
   SELECT max(n_chars) FILTER (i = CAST(round(0.1 * (n - 1)) AS BIGINT)) AS p10, max(n_chars) FILTER (i = CAST(round(0.9 * (n - 1)) AS BIGINT)) AS p90, max(n_chars) AS top FROM r""")
def nearest_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.nearest_quantiles(table(spark, sf_dir, "documents"), "n_chars", {"p10": 0.1, "p90": 0.9, "top": 1.0})


@query("ag8_linear_quantiles", "SELECT round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.9), 6) AS p90, round(quantile_cont(n_chars, 0.95), 6) AS p95, round(quantile_cont(n_chars, 0.99), 6) AS p99 FROM documents")
def linear_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = rel.linear_quantiles(table(spark, sf_dir, "documents"), "n_chars", {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})
    return q.select(*(F.round(c, 6).alias(c) for c in q.columns))


@query("ag9_window_loss", "SELECT event_id // 100 AS window_id, event_type, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1, 2")
def window_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.functions.numeric import smoothed

    out = smoothed(table(spark, sf_dir, "events"), "event_id", "value", 100, ["event_type"])
    return out.withColumn("mean", F.round("mean", 6))


@query("ag10_length_band_loss", "SELECT CASE WHEN n_chars < 1024 THEN '0-1k' WHEN n_chars < 2048 THEN '1k-2k' WHEN n_chars < 4096 THEN '2k-4k' WHEN n_chars < 8192 THEN '4k-8k' WHEN n_chars < 16384 THEN '8k-16k' ELSE '16k+' END AS band, round(avg(quality), 6) AS mean, count(*) AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def length_band_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("band", rel.length_band(F.col("n_chars")))
    return rows.groupBy("band").agg(F.round(F.avg("quality"), 6).alias("mean"), F.count("*").alias("n"))


@query("ag11_segment_sums", "SELECT l_orderkey, l_linenumber % 3 AS segment, round(sum(l_quantity), 6) AS total, count(*) AS n FROM lineitem WHERE l_linenumber % 3 > 0 GROUP BY 1, 2")
def segment_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("z"))
    rows = rows.select("l_orderkey", F.transform("z", lambda z: z["l_linenumber"] % 3).alias("segs"), F.transform("z", lambda z: z["l_quantity"]).alias("vals"))
    return rel.segment_sums(rows, "l_orderkey", "segs", "vals").withColumn("total", F.round("total", 6))


@query("ag12_weighted_totals", "SELECT l_returnflag, round(sum(l_tax) / sum(l_quantity), 9) AS loss, round(sum(l_discount) / sum(l_quantity), 9) AS accuracy, round(exp(sum(l_tax) / sum(l_quantity)), 9) AS perplexity FROM lineitem GROUP BY 1")
def weighted_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.operators.metrics import weighted_totals as wt

    out = wt(table(spark, sf_dir, "lineitem"), "l_tax", "l_discount", "l_quantity", ["l_returnflag"])
    return out.select("l_returnflag", *(F.round(c, 9).alias(c) for c in ("loss", "accuracy", "perplexity")))


@query("ag13_summary", "SELECT lang, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(median(n_chars), 6) AS median, round(stddev_pop(n_chars), 6) AS std, CAST(min(n_chars) AS DOUBLE) AS min, CAST(max(n_chars) AS DOUBLE) AS max FROM documents GROUP BY lang")
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rel.summary(table(spark, sf_dir, "documents"), "n_chars", ["lang"])
    return out.select("lang", "n", *(F.round(c, 6).alias(c) for c in ("mean", "median", "std", "min", "max")))


@query("ag14_subgroup_means", "SELECT source, round(avg(n_chars), 6) AS mean, count(*) AS n FROM documents GROUP BY source")
def subgroup_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.subgroup_means(table(spark, sf_dir, "documents"), "source", "n_chars").withColumn("mean", F.round("mean", 6))


@query("ag15_unpivoted_stats", "SELECT metric, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS min, max(v) AS max FROM (SELECT unnest(['quantity', 'discount', 'tax']) AS metric, unnest([l_quantity, l_discount, l_tax]) AS v FROM lineitem) GROUP BY metric")
def unpivoted_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("stack(3, 'quantity', l_quantity, 'discount', l_discount, 'tax', l_tax) as (metric, v)")
    return rows.groupBy("metric").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))


@query("ag16_category_accuracy", "SELECT lang, round(avg(CAST(quality = toxic AS INTEGER)), 9) AS accuracy, count(*) AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang")
def category_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir, "doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return ev.category_accuracy(rows, "lang", "quality", "toxic").withColumn("accuracy", F.round("accuracy", 9))


@query("ag17_macro_accuracy", "SELECT lang, round(avg(m), 9) AS macro FROM (SELECT lang, source, avg(CAST(quality AS DOUBLE)) AS m FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1, 2) GROUP BY lang")
def macro_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir, "doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return rel.macro_mean(rows, "lang", "source", F.col("quality").cast("double")).withColumn("macro", F.round("macro", 9))


@query("ag20_segments_per_row", "SELECT round(avg(m), 6) AS mean, max(m) AS top FROM (SELECT max(l_linenumber) AS m FROM lineitem GROUP BY l_orderkey)")
def segments_per_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("segments"))
    return ev.segments_per_row(rows, "segments").withColumn("mean", F.round("mean", 6))


@query("ag21_char_frequency", "SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM benchmark) WHERE ch <> '' GROUP BY ch")
def char_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.char_frequency(table(spark, sf_dir, "benchmark"), "text", "item_id").select("ch", "n")


@query("ag22_ngram_vocabulary", "SELECT count(DISTINCT substr(w, i, n)) AS n_distinct FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS w FROM benchmark), unnest(range(1, length(w) + 1)) a(i), (VALUES (2), (3)) b(n) WHERE i + n - 1 <= length(w)")
def ngram_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("w")).distinct()
    return words.select(F.explode(tx.ngrams_of(F.col("w"), [2, 3])).alias("g")).agg(F.count_distinct("g").alias("n_distinct"))


@query("ag25_stage_counts", "SELECT count(*) AS total, count(*) FILTER (n_chars > 500) AS long_enough, count(*) FILTER (n_chars > 500 AND lang = 'en') AS english FROM documents")
def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.stage_counts(table(spark, sf_dir, "documents"), {"long_enough": F.col("n_chars") > 500, "english": F.col("lang") == "en"})


@query("ag26_masked_stats", "SELECT round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(median(value), 6) AS median, min(value) AS min, max(value) AS max, count(value) AS n FROM events WHERE event_type <> 'click'")
def masked_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "events").where((F.col("event_type") != "click") & ~F.isnan("value"))
    out = rel.summary(kept, "value")
    return out.select(*(F.round(c, 6).alias(c) for c in ("mean", "std", "median")), "min", "max", "n")


@query("ag28_first_appearance", "SELECT source, min(doc_id) AS first_at FROM documents GROUP BY source")
def first_appearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.first_appearance(_docs(spark, sf_dir, "doc_id", "source"), "source", "doc_id")


# --- ranks, order, sets ------------------------------------------------------------------------------------------


@query("wn1_keep_first", "SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir, "doc_id", "lang", rel.text_digest(F.col("text")).alias("text"))
    return rel.keep_first(rows, ["text"], [F.col("doc_id")]).select("doc_id", "lang")


@query("wn2_bucket_rank", "SELECT o_orderkey, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderkey) AS rn FROM orders")
def bucket_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.operators.ranks import row_index as ranked

    return ranked(table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("y")), "o_orderkey", ["y"]).select("o_orderkey", "rn")


@query("wn4_segment_ids", "SELECT l_orderkey, l_linenumber, CAST(sum(CAST(l_linestatus = 'F' OR l_linenumber = 1 AS INTEGER)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS BIGINT) AS segment FROM lineitem")
def segment_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus")
    first = (F.col("l_linestatus") == "F") | (F.col("l_linenumber") == 1)
    return rel.segment_ids(rows, "l_orderkey", "l_linenumber", first).select("l_orderkey", "l_linenumber", "segment")


@query("wn5_restart_positions", "SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) - 1 AS INTEGER) AS position FROM lineitem")
def restart_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.restart_positions(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_returnflag").select("l_orderkey", "l_linenumber", "position")


@query("wn7_softmax", "SELECT l_orderkey, l_linenumber, round(exp(q - max(q) OVER w) / sum(exp(q - m)) OVER w, 9) AS p FROM (SELECT l_orderkey, l_linenumber, l_quantity / 10 AS q, max(l_quantity / 10) OVER (PARTITION BY l_orderkey) AS m FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey)")
def softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 10).alias("q"))
    return rel.softmax(rows, "l_orderkey", "q").select("l_orderkey", "l_linenumber", F.round("p", 9).alias("p"))


@query("wn8_argmax", "SELECT l_orderkey, l_linenumber, l_quantity AS score FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.argmax(table(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_quantity"), "l_linenumber")


@query("wn9_average_rank", "SELECT p_partkey, avg(r) OVER (PARTITION BY p_size) AS rank FROM (SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_size) AS r FROM part)")
def average_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.average_rank(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size", "rank").select("p_partkey", "rank")


@query("wn11_running_best", "SELECT event_id, coalesce(value > max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS is_best FROM events")
def running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.running_best(table(spark, sf_dir, "events"), "event_id", "value", "user_id").select("event_id", "is_best")


@query("st2_length_order", f"SELECT doc_id, row_number() OVER (ORDER BY n_tokens DESC, doc_id) AS rn FROM {WORDS}")
def length_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.operators.ranks import row_index as ranked

    rows = _words(spark, sf_dir).withColumn("k", -F.col("n_tokens"))
    return ranked(rows, "k", None, tie="doc_id").select("doc_id", "rn")


@query("st3_bucket_order", "SELECT source, n, row_number() OVER (ORDER BY n, source) AS odd_epoch FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def bucket_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    sizes = _docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))  # a row per source
    return sizes.withColumn("odd_epoch", F.row_number().over(Window.orderBy("n", "source")).cast("bigint"))


@query("st4_label_ids", "SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS label_id FROM part")
def label_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.label_ids(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand").select("p_partkey", "label_id")


@query("st6_row_range", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) WHERE i >= 20 AND i < 60")
def row_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.add_row_index(_docs(spark, sf_dir, "doc_id"), "doc_id").where("local_index >= 20 and local_index < 60").select("doc_id")


@query("st7_top_k", "SELECT l_orderkey, l_linenumber, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank FROM lineitem) WHERE rank <= 2")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.top_k(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_extendedprice", "l_linenumber", 2).select("l_orderkey", "l_linenumber", "rank")


_P = "(SELECT l_orderkey, l_linenumber, l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey) AS p FROM lineitem)"


@query("st8_top_p", f"WITH k AS (SELECT *, sum(p) OVER (PARTITION BY l_orderkey ORDER BY p DESC, l_linenumber ROWS UNBOUNDED PRECEDING) - p AS before FROM {_P}) SELECT l_orderkey, l_linenumber, round(p / sum(p) OVER (PARTITION BY l_orderkey), 6) AS p_kept FROM k WHERE before <= 0.77")
def top_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / F.sum("l_quantity").over(Window.partitionBy("l_orderkey"))).alias("p"))
    return rel.top_p(rows, "l_orderkey", "p", "l_linenumber", 0.77).select("l_orderkey", "l_linenumber", F.round("p_kept", 6).alias("p_kept"))


@query("st10_top_overlap", "WITH b AS (SELECT l_orderkey, l_quantity, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice) AS i FROM lineitem), a AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, i) AS r1, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, i) AS r2 FROM b) SELECT l_orderkey, count(*) FILTER (r1 <= 2 AND r2 <= 2) / CAST(2 AS DOUBLE) AS overlap FROM a GROUP BY l_orderkey")
def top_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.operators.metrics import top_overlap as overlap

    z = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_extendedprice")))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(z.alias("z"))
    return rows.select("l_orderkey", overlap(F.transform("z", lambda r: r["l_quantity"]), F.transform("z", lambda r: r["l_extendedprice"]), 2).alias("overlap"))


@query("so1_union_all", "SELECT doc_id AS id, text FROM documents UNION ALL SELECT item_id, text FROM benchmark")
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "doc_id", "text").withColumnRenamed("doc_id", "id").unionByName(table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "id"))


@query("so2_distinct", "SELECT DISTINCT lang, source FROM documents")
def distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "lang", "source").distinct()


@query("so3_key_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def key_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "doc_id").subtract(table(spark, sf_dir, "labels").select("doc_id"))


@query("so4_top_intersection", "SELECT count(*) AS n FROM (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50) a JOIN (SELECT doc_id FROM labels) b ON a.doc_id = b.doc_id")
def top_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    longest = table(spark, sf_dir, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(50).select("doc_id")
    return longest.intersect(table(spark, sf_dir, "labels").select("doc_id")).agg(F.count("*").alias("n"))


@query("so6_ordered_dedupe", "SELECT text, source, lang, doc_id FROM documents")
def ordered_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that a source's fields name, each once."""
    made = config.SourceConfig("x", f"{sf_dir}/documents.parquet", 1.0, "nli", metadata_field="source", target_field="lang", extra_columns=("text", "doc_id", "lang"))
    return readers.scan_source(spark, made)


# --- packing and batches -----------------------------------------------------------------------------------------


@query("pk8_buffer_ids", "SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 8 AS buffer_id FROM documents")
def buffer_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.buffer_ids(_docs(spark, sf_dir, "doc_id", "source"), 8, "doc_id", ["source"])


#: The packs of each buffer by the rule, a document at a time: the open pack's number, tokens and documents are carried along.
_PACKS = f"""(WITH RECURSIVE b AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 64 AS buffer_id FROM {WORDS}),
    d AS (SELECT source, buffer_id, doc_id, least(n_tokens, 2048) AS n, row_number() OVER (PARTITION BY source, buffer_id ORDER BY n_tokens DESC, doc_id) AS i FROM b),
    r AS (SELECT source, buffer_id, doc_id, n, i, CAST(0 AS BIGINT) AS pack, CAST(0 AS BIGINT) AS position, FALSE AS alone, CAST(0 AS BIGINT) AS open, n AS used, CAST(1 AS BIGINT) AS docs FROM d WHERE i = 1
      UNION ALL SELECT source, buffer_id, doc_id, n, i, pack, position, alone, CASE WHEN alone THEN last + 1 ELSE pack END, CASE WHEN alone THEN 0 WHEN over THEN n ELSE was + n END, CASE WHEN alone THEN 0 ELSE position + 1 END
      FROM (SELECT *, CASE WHEN alone THEN NULL WHEN over THEN last + 1 ELSE last END AS pack, CASE WHEN over THEN 0 ELSE held END AS position
        FROM (SELECT d.*, r.open AS last, r.used AS was, r.docs AS held, r.docs > 0 AND r.used + d.n > 2048 AS over, r.docs > 0 AND r.used + d.n > 2048 AND r.used < 0.8 * 2048 AS alone
          FROM r JOIN d ON d.source = r.source AND d.buffer_id = r.buffer_id AND d.i = r.i + 1)))
    SELECT source, buffer_id, doc_id, CAST(CASE WHEN alone THEN 1 + coalesce(max(pack) OVER w, -1) + row_number() OVER (PARTITION BY source, buffer_id, alone ORDER BY i) - 1 ELSE pack END AS INTEGER) AS pack,
      CAST(position AS INTEGER) AS position, CAST(n AS INTEGER) AS used, alone FROM r WINDOW w AS (PARTITION BY source, buffer_id))"""


@query("pk1_next_fit_packs", f"SELECT * FROM {_PACKS}")
def next_fit_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = batching.buffer_ids(_words(spark, sf_dir), 64, "doc_id", ["source"])
    return batching.pack_documents(rows, "n_tokens", "doc_id", ["source", "buffer_id"], 2048, 0.8)


@query("pk2_packs_with_leftovers")
def packs_with_leftovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leftovers go from buffer to buffer within a lane; tests hold a lane against a plain loop."""
    rows = batching.laned(_words(spark, sf_dir), "doc_id", 256)
    rows = batching.buffer_ids(rows, 32, "doc_id", ["source", "lane"])
    return batching.pack_with_leftovers(rows, "n_tokens", "doc_id", ["source", "lane"], "buffer_id")


@query("ag19_packing_stats", f"SELECT CAST(sum(n_docs) AS BIGINT) AS docs, count(*) AS packs, CAST(sum(n_docs) AS DOUBLE) / count(*) AS docs_per_pack, CAST(sum(n_tokens) AS DOUBLE) / (count(*) * 2048) AS efficiency FROM (SELECT count(*) AS n_docs, sum(used) AS n_tokens FROM {_PACKS} GROUP BY source, buffer_id, pack)")
def packing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    packs = next_fit_packs(spark, sf_dir).groupBy("source", "buffer_id", "pack").agg(F.count("*").alias("n_docs"), F.sum("used").alias("n_tokens"))
    return batching.packing_stats(packs, 2048)


@query("ba1_batches_drop_tail", "SELECT doc_id, (rn - 1) // 32 AS batch_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn, count(*) OVER () AS n FROM documents) WHERE rn <= n // 32 * 32")
def batches_drop_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.batches(_docs(spark, sf_dir, "doc_id"), 32, "doc_id")


@query("ba2_even_batches", "SELECT doc_id, CAST(ntile(CAST(ceil(n / CAST(48 AS DOUBLE)) AS BIGINT)) OVER (ORDER BY doc_id) - 1 AS BIGINT) AS batch_id FROM (SELECT doc_id, count(*) OVER () AS n FROM documents)".replace("ntile(CAST(ceil(n / CAST(48 AS DOUBLE)) AS BIGINT))", "ntile((SELECT CAST(ceil(count(*) / CAST(48 AS DOUBLE)) AS BIGINT) FROM documents))"))
def even_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.even_batches(_docs(spark, sf_dir, "doc_id"), 48, "doc_id")


@query("ba6_padded_batches", "WITH b AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 48 AS batch_id FROM documents), s AS (SELECT batch_id, count(*) AS n, min(doc_id) AS f FROM b GROUP BY 1) SELECT doc_id, batch_id, FALSE AS is_pad FROM b UNION ALL SELECT f, batch_id, TRUE FROM s, range(1, 65) t(k) WHERE k <= (64 - n % 64) % 64")
def padded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = batching.batches(_docs(spark, sf_dir, "doc_id"), 48, "doc_id", drop_last=False)
    return batching.pad_batches(rows, 64, "batch_id", "doc_id")


@query("ba5_micro_batches", "SELECT doc_id, b AS batch_id, b // 2 AS step FROM (SELECT doc_id, (rn - 1) // 16 AS b, n // 16 AS nb FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn, count(*) OVER () AS n FROM documents) WHERE rn <= n // 16 * 16) WHERE b < nb // 2 * 2")
def micro_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = batching.batches(_docs(spark, sf_dir, "doc_id"), 16, "doc_id")
    n = rows.agg((F.max("batch_id") + 1).alias("n")).first()["n"] or 0
    return batching.micro_batches(rows, 2, n).withColumn("step", F.col("step").cast("bigint"))


_BUCKET = "CASE WHEN n_tokens <= 128 THEN 0 WHEN n_tokens <= 256 THEN 1 WHEN n_tokens <= 512 THEN 2 WHEN n_tokens <= 1024 THEN 3 WHEN n_tokens <= 2048 THEN 4 WHEN n_tokens <= 4096 THEN 5 ELSE 6 END"


@query("tk23_length_buckets", f"SELECT doc_id, CAST({_BUCKET} AS INTEGER) AS bucket FROM {WORDS}")
def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).select("doc_id", tk.bucket_of(F.col("n_tokens")).alias("bucket"))


@query(
    "ba3_bucketed_batches",
    f"""WITH d AS (SELECT doc_id, {_BUCKET} AS bucket FROM {WORDS}), s AS (SELECT bucket, count(*) AS n FROM d GROUP BY 1),
        r AS (SELECT bucket, n // 16 AS f, row_number() OVER (ORDER BY n DESC, bucket) - 1 AS bucket_rank, coalesce(sum(n // 16) OVER (ORDER BY n DESC, bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
        SELECT doc_id, CAST(bucket_rank AS INTEGER) AS bucket_rank, CAST(before + b AS BIGINT) AS batch_id FROM (SELECT doc_id, bucket, (row_number() OVER (PARTITION BY bucket ORDER BY doc_id) - 1) // 16 AS b FROM d) x JOIN r USING (bucket) WHERE b < f AND before + b > 2""",
)
def bucketed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = length_buckets(spark, sf_dir)
    return batching.bucketed_batches(rows, "bucket", 16, "doc_id", resume_after=2).select("doc_id", "bucket_rank", "batch_id")


@query("pk7_attention_pairs", "WITH x AS (SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag) AS i FROM lineitem) SELECT a.l_orderkey, count(*) AS n FROM x a JOIN x b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag = b.l_returnflag AND b.i <= a.i GROUP BY 1")
def attention_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag")))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(z.alias("z"))
    segs = F.transform("z", lambda r: F.ascii(r["l_returnflag"]))
    return batching.attention_pairs(rows.select("l_orderkey", segs.alias("segs")), "l_orderkey", "segs", causal=True).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("pk3_packed_arrays", "SELECT l_orderkey, count(*) AS n_docs, string_agg(repeat(CAST(i AS VARCHAR), l_linenumber), '' ORDER BY i) AS segments FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i FROM lineitem) GROUP BY l_orderkey")
def packed_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", at.alias("position"), F.array_repeat(F.lit(7), F.col("l_linenumber")).alias("ids"))
    packs = batching.packed_arrays(rows, ["l_orderkey"], "ids", "ids", 256)
    return packs.select("l_orderkey", F.col("n_docs").cast("bigint").alias("n_docs"), F.array_join(F.filter("segment_ids", lambda s: s > 0).cast("array<string>"), "").alias("segments"))


@query("floor_division", "SELECT l_orderkey, l_linenumber, CAST(floor((l_quantity - 25) / CAST(5 AS DOUBLE)) AS BIGINT) AS q FROM lineitem")
def floor_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also of negative numbers."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", floor_div(F.col("l_quantity").cast("double") - 25, 5.0).alias("q"))


@query("ss2_interleaved", "SELECT lang, turn, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn FROM documents)")
def interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.round_robin(_docs(spark, sf_dir, "doc_id", "lang"), "doc_id", "lang")
    return mixing.interleaved([rows.where(F.col("lang") == x) for x in ("de", "en", "es", "fr")], ["turn", "lang"]).select("lang", "turn", "doc_id")
