"""Queries: host slices, budgets, samples, splits, mixtures, and the order of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import config
from quern.operators import batching, mixing, sampling
from quern.operators.ranks import hash_rank, uniform
from quern.operators.relational import row_running
from quern.plans.sql import H, U
from quern.queryset import query, table
from quern.sources import sinks
from quern.streaming import mixer


def _docs(spark, sf_dir, *cols):
    return table(spark, sf_dir, "documents").select(*(cols or ("doc_id", "lang", "source")))


def _words(spark, sf_dir):
    """Documents with a word count as their tokens."""
    n = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).cast("bigint")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", n.alias("n_tokens"))


WORDS = r"(SELECT doc_id, lang, source, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS BIGINT) AS n_tokens FROM documents)"


@query(
    "shd1_host_slices",
    "SELECT doc_id, CAST(CASE WHEN n // 4 = 0 THEN 3 ELSE least((rn - 1) // (n // 4), 3) END AS INTEGER) AS host FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn, count(*) OVER () AS n FROM documents)",
)
def host_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.host_slices(_docs(spark, sf_dir), 4, "doc_id").select("doc_id", "host")


@query(
    "shd2_host_slices_by_source",
    "SELECT doc_id, source, CAST(CASE WHEN n // 4 = 0 THEN 3 ELSE least((rn - 1) // (n // 4), 3) END AS INTEGER) AS host FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents)",
)
def host_slices_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.host_slices(_docs(spark, sf_dir), 4, "doc_id", ["source"]).select("doc_id", "source", "host")


@query(
    "shd3_slice_and_full_size",
    "SELECT count(*) AS slice_rows, (SELECT count(*) FROM documents) AS full_rows FROM (SELECT row_number() OVER (ORDER BY doc_id) AS rn, count(*) OVER () AS n FROM documents) WHERE least((rn - 1) // (n // 3), 2) = 1",
)
def slice_and_full_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    sliced = sampling.host_slices(_docs(spark, sf_dir), 3, "doc_id")
    return sliced.agg(F.count_if(F.col("host") == 1).alias("slice_rows"), F.count("*").alias("full_rows"))


@query("bud1_host_budgets", "SELECT source, mode, hosts, CAST(least(n, floor(n * least(gb / hosts, CAST(30 AS DOUBLE)) * 1e4 / bytes)) AS BIGINT) AS kept FROM (SELECT source, count(*) AS n, CAST(sum(strlen(text)) AS DOUBLE) AS bytes FROM documents GROUP BY source), (VALUES ('full', CAST(320 AS DOUBLE)), ('sweep', CAST(10 AS DOUBLE)), ('debug', CAST(1 AS DOUBLE))) m(mode, gb), (VALUES (8), (16)) h(hosts)")
def host_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each source that a host's budget holds, at ten kilobytes for a gigabyte."""
    sizes = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).cast("double").alias("bytes"))
    each = F.array(*(F.struct(F.lit(m).alias("mode"), F.lit(h).alias("hosts"), F.lit(sampling.host_budget_gb(h, m)).alias("gb")) for m in sampling.MODE_GB for h in (8, 16)))
    kept = F.least(F.col("n").cast("double"), F.floor(F.col("n") * F.col("b.gb") * 1e4 / F.col("bytes"))).cast("long")
    return sizes.withColumn("b", F.explode(each)).select("source", "b.mode", "b.hosts", kept.alias("kept"))


@query("bud2_source_budgets", "SELECT lang, round(100.0 * n / sum(n) OVER (), 6) AS budget FROM (SELECT lang, CAST(count(*) AS DOUBLE) AS n FROM documents GROUP BY lang)")
def source_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _docs(spark, sf_dir).groupBy("lang").agg(F.count("*").cast("double").alias("weight"))
    return sampling.source_budgets(sizes, 100.0).select("lang", F.round("budget", 6).alias("budget"))


@query(
    "bud3_truncate_to_bytes",
    f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY {H(42, 'doc_id')}, doc_id) AS rn FROM documents), (SELECT count(*) AS n, sum(octet_length(encode(text))) AS b FROM documents) WHERE rn <= CAST(floor(n * CAST(200000 AS DOUBLE) / b) AS BIGINT)",
)
def truncate_to_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.truncate_to_bytes(_docs(spark, sf_dir, "doc_id", "text"), 200_000, "text", "doc_id").select("doc_id")


@query(
    "smp1_stratified_sample",
    f"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {H(42, 'doc_id')}, doc_id) AS rn, count(*) OVER (PARTITION BY source) AS c, count(*) OVER () AS n FROM documents) WHERE rn <= greatest(1, floor(c * 100 / CAST(n AS DOUBLE)))",
)
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified_sample(_docs(spark, sf_dir), 100, "doc_id", "source").select("doc_id", "source")


@query("smp2_sample_n", f"SELECT doc_id FROM documents ORDER BY {H(7, 'doc_id')}, doc_id LIMIT 50")
def sample_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_n(_docs(spark, sf_dir), 50, "doc_id", 7).select("doc_id")


@query("smp3_shuffle_select", f"SELECT doc_id, CAST(row_number() OVER (ORDER BY {H(11, 'doc_id')}, doc_id) AS BIGINT) AS rn FROM documents QUALIFY rn <= 40")
def shuffle_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_rank(_docs(spark, sf_dir, "doc_id"), 11, "doc_id").where("rn <= 40")


@query("smp4_eval_sample", f"SELECT doc_id FROM labels ORDER BY {H(42, 'doc_id')}, doc_id LIMIT 30")
def eval_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_eval(table(spark, sf_dir, "labels"), 30, "doc_id").select("doc_id")


@query("smp5_first_n", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 25")
def first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "doc_id", "lang").orderBy("doc_id").limit(25)


@query("smp6_cap_per_group", f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {H(42, 'doc_id')}, doc_id) AS rn FROM documents) WHERE rn <= 20")
def cap_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.cap_per_group(_docs(spark, sf_dir), 20, "lang", "doc_id").select("doc_id", "lang")


@query(
    "smp7_epoch_sample",
    f"""WITH q AS (SELECT lang, ceil(60 * CAST(1.1 AS DOUBLE) * count(*) / (SELECT count(*) FROM documents)) AS quota FROM documents GROUP BY lang)
        SELECT doc_id, lang FROM (SELECT doc_id, d.lang, quota, row_number() OVER (PARTITION BY d.lang ORDER BY {H("epoch1", "doc_id")}, doc_id) AS rn FROM documents d JOIN q ON d.lang = q.lang WHERE doc_id NOT IN (SELECT doc_id FROM labels)) WHERE rn <= quota""",
)
def epoch_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.epoch_sample(_docs(spark, sf_dir), table(spark, sf_dir, "labels"), 60, "doc_id", "lang", 1).select("doc_id", "lang")


@query("smp8_weighted_choice", f"SELECT doc_id, CASE WHEN {U(42, 'doc_id')} < 0.4 THEN 'a' WHEN {U(42, 'doc_id')} < 0.8 THEN 'b' ELSE 'c' END AS choice FROM documents")
def weighted_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", sampling.weighted_choice({"a": 0.4, "b": 0.4, "c": 0.2}, "doc_id").alias("choice"))


@query("spl1_train_eval_split", f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {H(42, 'doc_id')}, doc_id) <= ceil(CAST(0.05 AS DOUBLE) * count(*) OVER ()) THEN 'eval' ELSE 'train' END AS split FROM documents")
def train_eval_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.train_eval_split(_docs(spark, sf_dir), 0.05, "doc_id").select("doc_id", "split")


@query(
    "spl2_predefined_or_random_split",
    f"""SELECT doc_id, CASE WHEN l.doc_id2 IS NOT NULL THEN 'eval' ELSE 'train' END AS split FROM documents d LEFT JOIN (SELECT doc_id AS doc_id2 FROM labels WHERE quality = 0) l ON d.doc_id = l.doc_id2""",
)
def predefined_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source that has its own eval rows keeps them; only the others are split at random."""
    given = table(spark, sf_dir, "labels").where("quality = 0")
    source = config.SourceConfig("docs", "", 1.0, "mixed", has_stratified_split=True)
    docs = _docs(spark, sf_dir)
    if not (source.has_stratified_split and not given.isEmpty()):
        return sampling.train_eval_split(docs, 0.05, "doc_id").select("doc_id", "split")
    from quern.operators.relational import flag_members

    return flag_members(docs, given, "doc_id", "e").select("doc_id", F.when(F.col("e"), "eval").otherwise("train").alias("split"))


@query(
    "spl3_year_quotas",
    f"""WITH o AS (SELECT o_orderkey, year(o_orderdate) - 1995 AS bucket FROM orders), s AS (SELECT bucket, count(*) AS n FROM o GROUP BY bucket),
        raw AS (SELECT bucket, n, pos, n * f AS raw, CAST(floor(n * f) AS BIGINT) AS base, q FROM s, (VALUES (0, CAST(0.6 AS DOUBLE), 1500), (1, CAST(0.2 AS DOUBLE), 500), (2, CAST(0.2 AS DOUBLE), 500)) t(pos, f, q)),
        quota AS (SELECT bucket, pos, CASE WHEN n >= 2500 THEN q ELSE base + CASE WHEN row_number() OVER (PARTITION BY bucket ORDER BY raw - base DESC, pos) <= n - sum(base) OVER (PARTITION BY bucket) THEN 1 ELSE 0 END END AS quota FROM raw),
        ends AS (SELECT bucket, pos, sum(quota) OVER (PARTITION BY bucket ORDER BY pos) AS upper, sum(quota) OVER (PARTITION BY bucket ORDER BY pos) - quota AS lower FROM quota),
        ranked AS (SELECT o_orderkey, bucket, row_number() OVER (PARTITION BY bucket ORDER BY {H("split", "concat_ws(':', CAST(42 + bucket AS VARCHAR), CAST(o_orderkey AS VARCHAR))")}) AS rk FROM o)
        SELECT o_orderkey, r.bucket, CASE pos WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split FROM ranked r JOIN ends e ON r.bucket = e.bucket AND rk > lower AND rk <= upper""",
)
def year_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.year("o_orderdate").cast("bigint") - 1995).alias("bucket"))
    return sampling.quota_split(orders, {"train": 1500, "validation": 500, "test": 500}, "o_orderkey", "bucket", fractions={"train": 0.6, "validation": 0.2, "test": 0.2}).select("o_orderkey", "bucket", "split")


@query(
    "spl4_largest_remainder",
    """WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source), raw AS (SELECT source, n, p, pos, n * f AS raw, CAST(floor(n * f) AS BIGINT) AS base FROM s, (VALUES ('train', 0, CAST(0.6 AS DOUBLE)), ('validation', 1, CAST(0.2 AS DOUBLE)), ('test', 2, CAST(0.2 AS DOUBLE))) t(p, pos, f))
       SELECT source, p AS part, CAST(base + CASE WHEN row_number() OVER (PARTITION BY source ORDER BY raw - base DESC, pos) <= n - sum(base) OVER (PARTITION BY source) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM raw""",
)
def largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))
    return sampling.largest_remainder(sizes, [("train", 0.6), ("validation", 0.2), ("test", 0.2)], "n", ["source"]).select("source", "part", "quota")


_SIZES = "(SELECT lang, count(*) AS n FROM documents GROUP BY lang)"


def _sizes(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"))


@query("mix1_manual", f"SELECT lang, round(w / sum(w) OVER (), 9) AS ratio FROM (SELECT lang, CAST(ascii(lang) AS DOUBLE) AS w FROM {_SIZES})")
def mix_manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.mixture(_sizes(spark, sf_dir).withColumn("weight", F.ascii("lang")), "manual").select("lang", F.round("ratio", 9).alias("ratio"))


@query("mix2_temperature", f"SELECT lang, round(pow(n, 0.5) / sum(pow(n, 0.5)) OVER (), 9) AS ratio FROM {_SIZES}")
def mix_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.mixture(_sizes(spark, sf_dir), "temperature", temperature=2.0).select("lang", F.round("ratio", 9).alias("ratio"))


@query("mix3_capped", f"SELECT lang, round(least(n, k) / sum(least(n, k)) OVER (), 9) AS ratio FROM (SELECT lang, CAST(n AS DOUBLE) AS n, CAST(3 * min(n) OVER () AS DOUBLE) AS k FROM {_SIZES})")
def mix_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.mixture(_sizes(spark, sf_dir), "capped", cap_multiplier=3).select("lang", F.round("ratio", 9).alias("ratio"))


@query("mix3_capped_fixed", f"SELECT lang, round(least(n, 100) / sum(least(n, 100)) OVER (), 9) AS ratio FROM (SELECT lang, CAST(n AS DOUBLE) AS n FROM {_SIZES})")
def mix_capped_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.mixture(_sizes(spark, sf_dir), "capped", cap=100).select("lang", F.round("ratio", 9).alias("ratio"))


@query(
    "mix4_heavy_light",
    f"""WITH r AS (SELECT lang AS name, CASE WHEN lang IN ('de', 'en') THEN 'denoising' ELSE 'sts' END AS data_type, CAST(n AS DOUBLE) / sum(n) OVER () AS ratio FROM {_SIZES})
        SELECT name, round(ratio, 9) AS ratio FROM r WHERE data_type <> 'denoising' UNION ALL SELECT n, round(f * s, 9) FROM (SELECT sum(ratio) AS s FROM r WHERE data_type = 'denoising'), (VALUES ('hanja_heavy', CAST(0.18 AS DOUBLE)), ('hanja_light', CAST(1 AS DOUBLE) - CAST(0.18 AS DOUBLE))) t(n, f)""",
)
def mix_heavy_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = sampling.mixture(_sizes(spark, sf_dir).withColumn("weight", F.col("n")), "manual")
    named = sizes.select(F.col("lang").alias("name"), F.when(F.col("lang").isin("de", "en"), "denoising").otherwise("sts").alias("data_type"), "ratio")
    return sampling.heavy_light(named).select("name", F.round("ratio", 9).alias("ratio"))


@query("mix5_renormalised", f"SELECT lang, round(CASE WHEN abs(sum(r) OVER () - 1) > 0.01 THEN r / sum(r) OVER () ELSE r END, 9) AS ratio FROM (SELECT lang, CAST(n AS DOUBLE) / 777 AS r FROM {_SIZES})")
def mix_renormalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.renormalised(_sizes(spark, sf_dir).select("lang", (F.col("n") / 777.0).alias("ratio"))).select("lang", F.round("ratio", 9).alias("ratio"))


@query("ss4_round_robin", "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.round_robin(_docs(spark, sf_dir), "doc_id").select("doc_id", "source", "turn")


@query("ss5_epochs", "SELECT doc_id, CAST(e AS INTEGER) AS epoch, md5(concat_ws(':', '42', 'epoch', doc_id)) AS shuffle_key FROM documents, range(2) t(e)".replace("'epoch', doc_id", "CAST(e AS VARCHAR), CAST(doc_id AS VARCHAR)"))
def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.epochs(_docs(spark, sf_dir, "doc_id"), 2, "doc_id")


@query(
    "ss6_phases",
    """WITH p AS (SELECT * FROM (VALUES ('warm', 0, 'src0', 1.0), ('warm', 0, 'src1', 3.0), ('main', 100, 'src1', 1.0), ('main', 100, 'src2', 1.0)) t(phase, from_step, source, ratio)),
        d AS (SELECT doc_id, source, CASE WHEN doc_id >= 100 THEN 'main' ELSE 'warm' END AS phase FROM documents WHERE source IN ('src0', 'src1', 'src2'))
        SELECT doc_id, d.source, d.phase, CAST(ratio / s AS DOUBLE) AS ratio, ratio IS NULL AS stale FROM d LEFT JOIN (SELECT *, sum(ratio) OVER (PARTITION BY phase) AS s FROM p) p ON d.source = p.source AND d.phase = p.phase""",
)
def phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("warm", 0, "src0", 1.0), ("warm", 0, "src1", 3.0), ("main", 100, "src1", 1.0), ("main", 100, "src2", 1.0)]
    plan = spark.createDataFrame(rows, "phase string, from_step long, source string, ratio double")
    docs = _docs(spark, sf_dir).where(F.col("source").isin("src0", "src1", "src2"))
    return mixing.by_phase(docs, plan, "doc_id").select("doc_id", "source", "phase", "ratio", "stale")


@query("ss7_cooldown", f"SELECT doc_id, CAST(sum(n_tokens) OVER (ORDER BY doc_id) AS BIGINT) AS tokens_seen, sum(n_tokens) OVER (ORDER BY doc_id) >= CAST(0.75 AS DOUBLE) * 300000 AS in_cooldown FROM {WORDS}")
def cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.cooldown(_words(spark, sf_dir), "n_tokens", "doc_id", 300_000, 0.25).select("doc_id", F.col("tokens_seen").cast("bigint").alias("tokens_seen"), "in_cooldown")


@query("ss8_resume", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn > CASE source WHEN 'src0' THEN 10 WHEN 'src1' THEN 3 ELSE 0 END")
def resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = spark.createDataFrame([("src0", 10), ("src1", 3)], "source string, consumed long")
    return mixing.resume(_docs(spark, sf_dir), done, "doc_id").select("doc_id", "source")


@query("ss9_state", f"SELECT source, count(*) AS consumed, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM {WORDS} GROUP BY source")
def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.state(_words(spark, sf_dir))


@query("ss11_milestones", f"SELECT doc_id, CAST(b // 20000 AS BIGINT) AS milestone FROM (SELECT doc_id, n_tokens, CAST(sum(n_tokens) OVER (ORDER BY doc_id) AS BIGINT) AS b FROM {WORDS}) WHERE b // 20000 > (b - n_tokens) // 20000")
def milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.milestones(_words(spark, sf_dir), "n_tokens", "doc_id", 20_000).select("doc_id", F.col("milestone").cast("bigint").alias("milestone"))


@query("ss12_unseen", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.unseen(_docs(spark, sf_dir, "doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("ss1_token_deficit_mix")
def token_deficit_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequential by nature within a lane, of which there are as many as the table asks for: tests hold it against a plain loop."""
    rows = batching.laned(_words(spark, sf_dir), "doc_id", 1024)
    return mixing.mix(rows, {"en": 0.4, "de": 0.3, "fr": 0.2, "es": 0.1}, "doc_id", "lang")


_TARGETS = {"en": 0.4, "de": 0.3, "fr": 0.2, "es": 0.1}


@query("ss1_mixed_stream")
def mixed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixer as a stream that is stopped after half of its files and goes on from its checkpoint; tests hold its rows
    against the mixer over the whole table."""
    folder = sinks.shared_folder(spark)
    rows = batching.laned(_words(spark, sf_dir), "doc_id", 1024).select("lane", "doc_id", "lang", F.col("n_tokens").cast("long").alias("n_tokens"))
    sinks.write_parquet(rows, f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    lanes, cuts = rows.agg(F.max("lane") + 1, F.percentile_approx("doc_id", [0.25, 0.5, 0.75])).first()
    bounds = [None, *sorted(set(cuts or [])), None]
    parts = [rows.where((F.lit(True) if lo is None else F.col("doc_id") > lo) & (F.lit(True) if hi is None else F.col("doc_id") <= hi)) for lo, hi in zip(bounds, bounds[1:], strict=False)]
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("lang", "string"), ("n_tokens", "long"))]
    parts.append(rows.select("lane").distinct().select("lane", *nothing))
    with mixer.rocksdb(spark, min(int(lanes or 1), int(spark.conf.get("spark.sql.shuffle.partitions")))):
        for half in (parts[: len(parts) // 2], parts[len(parts) // 2 :]):
            for part in half:  # later files hold later keys
                part.write.mode("append").parquet(f"{folder}/in")
            stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1000).parquet(f"{folder}/in")
            mixed = mixer.mixed_stream(stream, _TARGETS, "doc_id", "lang")
            mixer.run_available(mixed, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(mixed.schema).parquet(f"{folder}/out")


@query("ss2_refill_order", "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn, CAST(substr(source, 4) AS INTEGER) AS source_no FROM documents")
def refill_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of a round robin over the sources."""
    rows = mixing.round_robin(_docs(spark, sf_dir), "doc_id")
    return rows.select("doc_id", "source", "turn", F.substring("source", 4, 10).cast("int").alias("source_no"))


@query("ag18_token_shares", f"SELECT lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, count(*) AS n, round(sum(n_tokens) / CAST(sum(sum(n_tokens)) OVER () AS DOUBLE), 9) AS share FROM {WORDS} GROUP BY lang, source")
def token_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.token_shares(_words(spark, sf_dir), ["lang", "source"]).withColumn("share", F.round("share", 9))


@query("wn6_epoch_permutation", f"SELECT doc_id, row_number() OVER (ORDER BY {H(45, 'doc_id')}, doc_id) AS rn FROM documents")
def epoch_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed 42 in epoch 3."""
    return hash_rank(_docs(spark, sf_dir, "doc_id"), 42 + 3, "doc_id")


@query("wn3_running_tokens", f"SELECT doc_id, CAST(sum(n_tokens) OVER (ORDER BY doc_id) AS BIGINT) AS total FROM {WORDS}")
def running_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_running(_words(spark, sf_dir), "doc_id", "n_tokens", "total").select("doc_id", F.col("total").cast("bigint").alias("total"))


@query("uniform_draws", f"SELECT doc_id, round({U('seed', 'doc_id')}, 9) AS u FROM documents")
def uniform_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.round(uniform("seed", "doc_id"), 9).alias("u"))
