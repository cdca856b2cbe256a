"""The held-out split, its exclusion registry and the acceptance check, as whole plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.operators import relational as rel
from quern.operators import sampling
from quern.plans.sql import H
from quern.queryset import query, table

TARGETS = {"train": 12, "validation": 4, "test": 4}
FRACTIONS = {"train": 0.6, "validation": 0.2, "test": 0.2}


def pool(docs: DataFrame, matched: DataFrame, impure: DataFrame) -> DataFrame:
    """Documents with enough text that are matched and not impure, the first of each text."""
    kept = docs.where(tx.sufficient_text(F.col("text"))).select("doc_id", rel.text_digest(F.col("text")).alias("digest"), "lang", "source")
    kept = rel.without(rel.within(kept, matched, "doc_id"), impure, "doc_id")
    return rel.keep_first(kept, ["digest"], [F.col("doc_id")])


_POOL = r"""
WITH kept AS (
  SELECT doc_id, text FROM documents d
  WHERE length(text) > 0
    AND length(regexp_replace(text, '[\d\s.,·()\[\]{}+=*/-]+', '', 'g')) / CAST(length(text) AS DOUBLE) >= 0.3
    AND doc_id IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
), pool AS (
  SELECT doc_id, text, doc_id % 16 AS bucket FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM kept) WHERE r = 1
)"""
_SPLIT = f"""{_POOL}, sizes AS (SELECT bucket, count(*) AS n FROM pool GROUP BY bucket),
raw AS (SELECT bucket, n, p, pos, n * f AS raw, CAST(floor(n * f) AS BIGINT) AS base
  FROM sizes, (VALUES ('train', 0, CAST(0.6 AS DOUBLE), 12), ('validation', 1, CAST(0.2 AS DOUBLE), 4), ('test', 2, CAST(0.2 AS DOUBLE), 4)) t(p, pos, f, q)),
quota AS (SELECT bucket, p, pos, CASE WHEN n >= 20 THEN CASE p WHEN 'train' THEN 12 ELSE 4 END
    ELSE base + CASE WHEN row_number() OVER (PARTITION BY bucket ORDER BY raw - base DESC, pos) <= n - sum(base) OVER (PARTITION BY bucket) THEN 1 ELSE 0 END END AS quota FROM raw),
ends AS (SELECT bucket, p, sum(quota) OVER (PARTITION BY bucket ORDER BY pos) AS upper, sum(quota) OVER (PARTITION BY bucket ORDER BY pos) - quota AS lower FROM quota),
ranked AS (SELECT doc_id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY {H("split", "concat_ws(':', CAST(42 + bucket AS VARCHAR), CAST(doc_id AS VARCHAR))")}) AS rk FROM pool)"""


@query("heldout_split", f"{_SPLIT} SELECT r.doc_id, r.bucket, e.p AS split FROM ranked r JOIN ends e ON r.bucket = e.bucket AND rk > lower AND rk <= upper")
def heldout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = pool(docs, labels, labels.where("toxic = 1")).withColumn("bucket", F.col("doc_id") % 16)
    return sampling.quota_split(found, TARGETS, "doc_id", "bucket", fractions=FRACTIONS).select("doc_id", "bucket", "split")


@query("heldout_split_sizes", f"{_SPLIT} SELECT r.bucket, e.p AS split, count(*) AS n FROM ranked r JOIN ends e ON r.bucket = e.bucket AND rk > lower AND rk <= upper GROUP BY 1, 2")
def heldout_split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heldout_split(spark, sf_dir).groupBy("bucket", "split").agg(F.count("*").alias("n"))


@query(
    "spl5_disjoint_splits",
    f"{_SPLIT} SELECT count(*) = count(DISTINCT doc_id) AS disjoint, count(*) AS n FROM (SELECT r.doc_id FROM ranked r JOIN ends e ON r.bucket = e.bucket AND rk > lower AND rk <= upper)",
)
def disjoint_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heldout_split(spark, sf_dir).agg((F.count("*") == F.count_distinct("doc_id")).alias("disjoint"), F.count("*").alias("n"))


@query("ag24_bucket_shortfall", f"{_POOL} SELECT bucket, count(*) AS available, least(count(*), 25) AS take, greatest(0, 25 - count(*)) AS missing FROM pool GROUP BY bucket")
def bucket_shortfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = pool(docs, labels, labels.where("toxic = 1")).withColumn("bucket", F.col("doc_id") % 16)
    return rel.shortfall(found, "bucket", 25).select("bucket", "available", F.col("take").cast("bigint"), F.col("missing").cast("bigint"))


@query(
    "ex_exclusion_registry",
    """SELECT d.doc_id, (l.doc_id IS NOT NULL) AS in_training,
         d.text IN (SELECT text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) AS by_text,
         CASE WHEN l.doc_id IS NOT NULL THEN 'key' WHEN d.text IN (SELECT text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) THEN 'text' ELSE 'none' END AS resolution
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def exclusion_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership of every document by key, else by a text equal to that of a member."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", rel.text_digest(F.col("text")).alias("text")), table(spark, sf_dir, "labels")
    found = rel.flag_members(docs, labels, "doc_id", "in_training")
    found = rel.flag_text_members(found, rel.within(docs, labels, "doc_id"), "text", "by_text")
    how = F.when(F.col("in_training"), "key").when(F.col("by_text"), "text").otherwise("none")
    return found.select("doc_id", "in_training", "by_text", how.alias("resolution"))


_META = "(SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'title' ELSE concat('title URL: ', url) END AS metadata FROM pages)"


@query(
    "vf_acceptance",
    f"""WITH t AS (SELECT page_id, nullif(regexp_extract(metadata, ' URL: (\\S+)$', 1), '') AS tail FROM {_META}),
        x AS (SELECT url FROM pages WHERE page_id % 3 = 0)
        SELECT count(*) AS n, CAST(sum(CASE WHEN x.url IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN x.url IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS members,
          CAST(sum(CASE WHEN tail IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS no_tail, count(DISTINCT CASE WHEN x.url IS NOT NULL THEN tail END) AS dropped_distinct
        FROM t LEFT JOIN (SELECT DISTINCT url FROM x) x ON t.tail = x.url""",
)
def acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over the training rows: kept, excluded, without an address, distinct excluded addresses."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    meta = pages.select("page_id", F.when(F.col("page_id") % 7 == 0, "title").otherwise(F.concat(F.lit("title URL: "), F.col("url"))).alias("metadata"))
    tails = meta.select("page_id", tx.url_tail(F.col("metadata")).alias("tail"))
    flagged = rel.flag_members(tails, pages.where("page_id % 3 = 0"), "tail", "excluded", "url")
    return rel.audit(flagged, ~F.col("excluded"), F.col("excluded"), F.col("tail"))
