"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import chat, decontam, hardneg, licences, mainhtml, media, ngramjoin, packing, simhash, toxicity, triemerge, urlfilter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(doc_id) -> F.Column:
    """crc32 of the id's decimal text, modulo 3."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Fitted on labelled rows outside the held-out fold."""
    return toxicity.train(docs, labels.where(fold(F.col("doc_id")) != 1))


#: The rules of op4: host, path, verdict.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _ = warc.archive(spark, table(spark, sf_dir, "pages"))
    return records


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urlfilter.judge(table(spark, sf_dir, "pages"), rules)


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainhtml.extract(table(spark, sf_dir, "pages"))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.formatted(rows))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.copies(media.rendered(table(spark, sf_dir, "embeddings")))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    found = toxicity.score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.matches(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        decontam.n_hit(F.col("spans")).alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        decontam.contaminated(F.col("spans"), F.col("n_words")).alias("contaminated"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hardneg.integer_rows(table(spark, sf_dir, "embeddings"))
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(rows.withColumn("label", label).withColumn("anchor", F.col("id") % 100 == 0))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triemerge.trie(table(spark, sf_dir, "conversations"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.similar_documents(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_simhash": op2_simhash,
    "op3_packing": op3_packing,
    "op4_url_rules": op4_url_rules,
    "op5_main_text": op5_main_text,
    "op6_licences": op6_licences,
    "op7_toxicity": op7_toxicity,
    "op8_chat": op8_chat,
    "op9_decontamination": op9_decontamination,
    "op10_media": op10_media,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_ngram_join": op13_ngram_join,
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
_OP4 = f"""WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
  m AS (SELECT page_id, host, path, rh || rp AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST, rh || rp DESC) AS n
        FROM u LEFT JOIN (VALUES {_RULES}) r(rh, rp, v) ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
  SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE n = 1"""


def _escaped(text: str, template: chat.Template = chat.LLAMA) -> str:
    """SQL of an escaped text: the codes of the control strings one after the other."""
    out = f"replace({text}, '\\', '\\.')"
    for k, c in enumerate(template.controls):
        out = f"replace({out}, '{c}', '\\{k};')"
    return out


def _op8(template: chat.Template = chat.LLAMA) -> str:
    around = " ".join(f"WHEN '{name}' THEN {len(r.begin + r.end)}" for name, r in template.roles.items())
    other = f"{len(template.other.begin + template.other.end + template.name_end)} + length({_escaped('role')})"
    order = "ORDER BY turn NULLS FIRST, role, text"
    said = "'</s>[INST] ok [/INST]'"
    return f"""WITH x AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
      UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', {said}), (-1, 1, 'assistant', {said})) t(conv_id, turn, role, text)),
    c AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' {order}) AS turns, coalesce(string_agg(text, '' {order}) FILTER (role = 'assistant'), '') AS loss,
      sum(CASE role {around} ELSE {other} END + length({_escaped('text')})) AS chars,
      string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' {order}) AS roles FROM x GROUP BY conv_id)
    SELECT CAST(conv_id AS BIGINT) AS conv_id, n AS n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars,
      regexp_full_match(roles, 's?(ua)+') AS valid, CAST(CASE WHEN length(regexp_extract(roles, '^s?(ua)*u?')) < n THEN length(regexp_extract(roles, '^s?(ua)*u?')) END AS INTEGER) AS first_bad_turn FROM c"""


_OP11 = """WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.id AS anchor_id, a.label = b.label AS same, b.id, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score FROM r a, r b WHERE a.id % 100 = 0 AND b.id <> a.id),
    p AS (SELECT anchor_id, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
    n AS (SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
          FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
  SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""

#: CRC-32 of a decimal text, bit by bit.
_CRC = "xor(list_reduce(list_concat([4294967295], list_transform(range(1, length({0}) + 1), lambda i: CAST(ascii(substr({0}, i, 1)) AS BIGINT))), lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"
_OP12 = f"""WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS n, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    h AS (SELECT c, c - c % 5 AS b, {_CRC.format("CAST(c AS VARCHAR)")} % 9 AS h FROM (SELECT DISTINCT c FROM t)),
    r AS (SELECT h.c, 0 AS own, t.n, t.role, t.text FROM h JOIN t ON t.c = h.b AND t.n <= h.h UNION ALL SELECT h.c, 1, t.n, t.role, t.text FROM h JOIN t ON t.c = h.c AND t.n > h.h),
    o AS (SELECT c, row_number() OVER w AS d, strlen(text) AS bytes, string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '') OVER (PARTITION BY c ORDER BY own, n) AS k FROM r WINDOW w AS (PARTITION BY c ORDER BY own, n)),
    p AS (SELECT c, 0 AS d, 0 AS bytes, '' AS k FROM h UNION ALL SELECT c, d, bytes, k FROM o),
    e AS (SELECT c, max(d) AS len FROM p GROUP BY c),
    x AS (SELECT k, d, min(p.c) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes, coalesce(string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) FILTER (len = d), '') AS ends FROM p JOIN e USING (c) GROUP BY k, d),
    up AS (SELECT x.k, x.d, y.k AS pk, y.conv_id AS pc FROM x JOIN p ON p.c = x.conv_id AND p.d = x.d - 1 JOIN x y ON y.k = p.k AND y.d = p.d),
    f AS (SELECT x.*, up.pk, up.pc, count(v.k) AS n_children FROM x LEFT JOIN up USING (k, d) LEFT JOIN up v ON v.pk = x.k AND v.d = x.d + 1 GROUP BY ALL),
    s AS (SELECT p.k, p.d, sum(CAST(f.n_children = 0 AS BIGINT)) AS n_leaves, sum((f.n_convs - 1) * f.bytes) AS saved FROM f JOIN p ON p.c = f.conv_id AND p.d <= f.d GROUP BY p.k, p.d)
  SELECT conv_id, CAST(d AS BIGINT) AS depth, pc AS parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256 FROM f JOIN s USING (k, d)"""

_OP13 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
    t AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
    c AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS m, b.n AS n, count(*) AS common FROM t a JOIN t b ON a.t = b.t AND a.doc_id <> b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n GROUP BY ALL),
    e AS (SELECT a, b FROM c WHERE 100 * common >= 90 * (m + n - common)),
    r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
  SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, CAST(least(doc_id, coalesce(m, doc_id)) AS BIGINT) AS component_id FROM s LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) ON a = doc_id"""

#: SQL of those that it can express: not the learned, hashed, tokenised or parsed ones.
ORACLES: dict[str, str] = {"op4_url_rules": _OP4, "op8_chat": _op8(), "op11_hard_negatives": _OP11, "op12_prefix_trie": _OP12, "op13_ngram_join": _OP13}
