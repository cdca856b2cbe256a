"""Queries: evaluation metrics, schedules and sampling arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import numeric as nm
from quern.functions.alignment import hanja_accuracy, hanja_recall
from quern.operators import metrics as ev
from quern.operators import retrieval
from quern.operators.relational import row_running
from quern.plans.q_sampling import WORDS, _words
from quern.plans.q_text import LETTERS
from quern.plans.q_tokens import _IDS, _ids
from quern.plans.sql import U
from quern.queryset import query, table


def _rounded(df: DataFrame, *names: str, digits: int = 9) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


_LABELLED = "(SELECT lang, quality AS y, toxic AS p FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def _labelled(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").select("lang", F.col("quality").alias("y"), F.col("toxic").alias("p"))


@query("ev1_accuracy", f"SELECT round(avg(CAST(y = p AS INTEGER)), 9) AS accuracy FROM {_LABELLED}")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_labelled(spark, sf_dir).agg(ev.mean_of(F.col("y") == F.col("p")).alias("accuracy")), "accuracy")


_F1 = f"""(SELECT lang, c, CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) AS f1, tp + fn AS support FROM (
   SELECT lang, c, count(*) FILTER (y = c AND p = c) AS tp, count(*) FILTER (y <> c AND p = c) AS fp, count(*) FILTER (y = c AND p <> c) AS fn
   FROM {_LABELLED}, (VALUES (0), (1)) k(c) GROUP BY lang, c) WHERE tp + fp + fn > 0)"""


@query("ev2_macro_f1", f"SELECT lang, round(avg(f1), 9) AS macro_f1 FROM {_F1} GROUP BY lang")
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ev.f1_scores(_labelled(spark, sf_dir), "y", "p", ["lang"]), "macro_f1").select("lang", "macro_f1")


@query("ev3_weighted_f1", f"SELECT lang, round(sum(f1 * support) / sum(support), 9) AS weighted_f1 FROM {_F1} GROUP BY lang")
def weighted_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ev.f1_scores(_labelled(spark, sf_dir), "y", "p", ["lang"]), "weighted_f1").select("lang", "weighted_f1")


_RANKED = "(SELECT x, y, avg(rx) OVER (PARTITION BY x) AS rx, avg(ry) OVER (PARTITION BY y) AS ry FROM (SELECT CAST(p_size AS DOUBLE) AS x, p_retailprice AS y, row_number() OVER (ORDER BY p_size) AS rx, row_number() OVER (ORDER BY p_retailprice) AS ry FROM part))"


@query("ev4_correlations", f"SELECT round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, round(avg(abs(x - y)), 6) AS mae FROM {_RANKED}")
def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return _rounded(ev.correlations(rows, "x", "y"), "pearson", "spearman", "mae", digits=6)


@query("ev7_collapsed", "SELECT CAST(0 AS DOUBLE) AS pearson, CAST(0 AS DOUBLE) AS spearman, round(avg(abs(1 - p_retailprice)), 6) AS mae FROM part")
def collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.lit(1.0).alias("x"), F.col("p_retailprice").alias("y"))
    return _rounded(ev.correlations(rows, "x", "y"), "mae", digits=6)


@query("ev8_unmatched", "SELECT count(*) FILTER (label IS NULL) AS unmatched, round(avg(CAST(label IS NULL AS INTEGER)), 9) AS ratio, count(*) AS seen FROM (SELECT CASE WHEN o_orderstatus IN ('F', 'O') THEN 1 END AS label FROM orders)")
def unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("o_orderstatus").isin("F", "O"), 1)
    rows = table(spark, sf_dir, "orders").select(label.alias("label"))
    return _rounded(rows.agg(F.count_if(F.col("label").isNull()).alias("unmatched"), ev.mean_of(F.col("label").isNull()).alias("ratio"), F.count("*").alias("seen")), "ratio")


@query("ev9_temporal", """SELECT round(avg(CAST(abs(p - t) <= 5 AS INTEGER)), 9) AS exact, round(avg(CAST(floor(p / CAST(10 AS DOUBLE)) = floor(t / CAST(10 AS DOUBLE)) AS INTEGER)), 9) AS decade, round(avg(CAST(floor(p / CAST(100 AS DOUBLE)) = floor(t / CAST(100 AS DOUBLE)) AS INTEGER)), 9) AS century, round(avg(abs(p - t)), 9) AS mae,
   (SELECT count(*) FROM orders WHERE o_orderkey % 5 = 0) AS unparsed, (SELECT round(avg(CAST(o_orderkey % 5 > 0 AS INTEGER)), 9) FROM orders) AS parsed_ratio FROM (SELECT year(o_orderdate) AS t, year(o_orderdate) + o_orderkey % 13 AS p FROM orders WHERE o_orderkey % 5 > 0)""")
def temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.year("o_orderdate")
    rows = table(spark, sf_dir, "orders").select(t.alias("t"), F.when(F.col("o_orderkey") % 5 > 0, t + F.col("o_orderkey") % 13).alias("p"))
    return _rounded(ev.temporal_scores(rows, "p", "t"), "exact", "decade", "century", "mae", "parsed_ratio")


def _pairs(spark, sf_dir):
    """Each text against that of the id eight further on, both lower-cased with single blanks."""
    whole = F.array_join(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != ""), " ")
    docs = table(spark, sf_dir, "documents").select("doc_id", whole.alias("t"))
    return docs.join(docs.select((F.col("doc_id") - 8).alias("doc_id"), F.col("t").alias("c")), "doc_id")


_SPLIT = r"(SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '') AS w FROM documents)"
_PAIRED = f"(SELECT a.doc_id, a.n AS r, b.n AS c FROM (SELECT doc_id, len(w) AS n FROM {_SPLIT}) a JOIN (SELECT doc_id, len(w) AS n FROM {_SPLIT}) b ON b.doc_id - 8 = a.doc_id)"


def _grams(n: int) -> str:
    words = f"(SELECT doc_id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM {_SPLIT})"
    own = ", ".join(f"lead(w, {k}) OVER o" for k in range(n))
    return f"(SELECT doc_id, g, count(*) AS k FROM (SELECT doc_id, concat_ws(' ', {own}) AS g, lead(w, {n - 1}) OVER o AS z FROM {words} WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE z IS NOT NULL GROUP BY 1, 2)"


def _hits(n: int) -> str:
    return f"(SELECT r.doc_id, sum(least(c.k, r.k)) AS m FROM {_grams(n)} r JOIN {_grams(n)} c ON c.doc_id - 8 = r.doc_id AND c.g = r.g GROUP BY 1)"


_BLEU = f"""SELECT p.doc_id, CASE WHEN c < 4 THEN 0.0 ELSE round((CASE WHEN c >= r THEN 1.0 ELSE exp(1 - r / CAST(c AS DOUBLE)) END)
   * exp(({' + '.join(f"ln(CASE WHEN coalesce(h{n}.m, 0) = 0 THEN CAST(1 AS DOUBLE) / {2**n} ELSE h{n}.m / CAST(c - {n - 1} AS DOUBLE) END)" for n in range(1, 5))}) / 4), 6) END AS bleu
   FROM {_PAIRED} p {' '.join(f'LEFT JOIN {_hits(n)} h{n} ON h{n}.doc_id = p.doc_id' for n in range(1, 5))}"""


@query("ev10_sentence_bleu", _BLEU)
def sentence_bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.sentence_bleu(_pairs(spark, sf_dir), "t", "c").select("doc_id", F.round("bleu", 6).alias("bleu"))


@query("ev11_rouge_2", f"SELECT p.doc_id, round(coalesce(m / CAST(nullif(greatest(c - 1, 0), 0) AS DOUBLE), 0), 6) AS precision, round(coalesce(m / CAST(nullif(greatest(r - 1, 0), 0) AS DOUBLE), 0), 6) AS recall FROM {_PAIRED} p LEFT JOIN {_hits(2)} h ON h.doc_id = p.doc_id")
def rouge_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ev.rouge_n(_pairs(spark, sf_dir), "t", "c", 2), "precision", "recall", digits=6).select("doc_id", "precision", "recall")


@query("ev12_rouge_l")
def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).select("doc_id", ev.rouge_l(F.col("t"), F.col("c")).alias("s"))
    return rows.select("doc_id", *(F.round(f"s.{n}", 6).alias(n) for n in ("precision", "recall", "fmeasure")))


@query("ev13_corpus_bleu")
def corpus_bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ev.corpus_bleu(_pairs(spark, sf_dir), "t", "c"), "bleu", "brevity_penalty")


@query("ev14_exact_match", "SELECT round(avg(CAST(trim(o_orderstatus) = trim(o_orderstatus || CASE WHEN o_orderkey % 2 = 0 THEN ' ' ELSE 'x' END) AS INTEGER)), 9) AS exact_match FROM orders")
def exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat("o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, " ").otherwise("x"))
    return _rounded(table(spark, sf_dir, "orders").agg(ev.mean_of(F.trim("o_orderstatus") == F.trim(said)).alias("exact_match")), "exact_match")


_CHOICES = "(SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice) - 1 AS i, -l_quantity AS lp, length(l_returnflag) + l_linenumber AS nb, l_orderkey % 3 AS y FROM lineitem)"


def _choices(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", (F.row_number().over(w) - 1).alias("i"), (-F.col("l_quantity")).alias("lp"), (F.length("l_returnflag") + F.col("l_linenumber")).alias("nb"), (F.col("l_orderkey") % 3).alias("y"))


@query("ev15_choice_accuracy", f"SELECT round(avg(CAST(i = y AS INTEGER)), 9) AS accuracy, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY lp / nb DESC, i) AS r FROM {_CHOICES}) WHERE r = 1")
def choice_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ev.choice_accuracy(_choices(spark, sf_dir), "l_orderkey", "i", "lp", "nb", "y"), "accuracy")


@query("ev16_decade_scores", f"""WITH c AS (SELECT *, 1925 + 10 * i AS mid, exp(lp - max(lp) OVER (PARTITION BY l_orderkey)) AS e, row_number() OVER (PARTITION BY l_orderkey ORDER BY lp DESC, i) AS r, 1920 + l_orderkey % 70 AS t FROM {_CHOICES}),
   x AS (SELECT l_orderkey, sum(e * mid) / sum(e) AS x FROM c GROUP BY 1)
   SELECT round(avg(CAST(i = y AS INTEGER)), 6) AS decade_accuracy, round(avg(CAST(abs(i - y) <= 1 AS INTEGER)), 6) AS adjacent_accuracy, round(avg(abs(mid - t)), 6) AS year_mae, round(avg(abs(x - t)), 6) AS expected_year_mae FROM c JOIN x ON c.l_orderkey = x.l_orderkey WHERE r = 1""")
def decade_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _choices(spark, sf_dir).withColumns({"mid": 1925 + 10 * F.col("i"), "t": 1920 + F.col("l_orderkey") % 70})
    return _rounded(ev.decade_scores(rows, "l_orderkey", "i", "mid", "lp", "y", "t"), "decade_accuracy", "adjacent_accuracy", "year_mae", "expected_year_mae", digits=6)


_LOGITS = "(SELECT vec_id, list_slice(embedding, 1, 10) AS v, label, list_slice(embedding, 11, 20) AS u FROM embeddings)"


def _logits(spark, sf_dir):
    v = lambda a: F.slice("embedding", a, 10).cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", v(1).alias("v"), v(11).alias("u"), "label")


@query("ev17_token_metrics", f"SELECT round(avg(ln(list_sum(list_transform(v, lambda x: exp(CAST(x AS DOUBLE))))) - CAST(v[label + 1] AS DOUBLE)), 6) AS loss, round(exp(avg(ln(list_sum(list_transform(v, lambda x: exp(CAST(x AS DOUBLE))))) - CAST(v[label + 1] AS DOUBLE))), 6) AS perplexity, round(avg(CAST(list_position(v, list_max(v)) - 1 = label AS INTEGER)), 6) AS accuracy, count(*) AS n_tokens FROM {_LOGITS}")
def token_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ev.token_metrics(_logits(spark, sf_dir), "v", "label"), "loss", "perplexity", "accuracy", digits=6)


#: Turns with letters written as Hanja and Hangul, and what a transcription made of them: a letter more, another one, or other blanks.
_EDITED = f"(SELECT conv_id, turn, r, CASE turn % 3 WHEN 0 THEN '音' || r WHEN 1 THEN translate(r, '音國', '樂국') ELSE ' ' || replace(r, ' ', '') END AS p FROM (SELECT conv_id, turn, translate(text, '{LETTERS[0]}', '{LETTERS[1]}') AS r FROM conversations))"
_PLACES = "list_filter(range(1, least(length({0}), length({1})) + 1), lambda i: substr({1}, i, 1) BETWEEN '一' AND '\u9fff')"
_HITS = f"(len(list_filter({_PLACES}, lambda i: substr({{0}}, i, 1) = substr({{1}}, i, 1))) / CAST(greatest(len({_PLACES}), 1) AS DOUBLE))"


def _edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, r = F.col("turn") % 3, F.col("r")
    p = F.when(k == 0, F.concat(F.lit("音"), r)).when(k == 1, F.translate(r, "音國", "樂국")).otherwise(F.concat(F.lit(" "), F.replace(r, F.lit(" "), F.lit(""))))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.translate("text", *LETTERS).alias("r")).withColumn("p", p)


@query("ev18_aligned_accuracy", rf"SELECT conv_id, turn, {_HITS.format('p1', 'r1')} AS aligned, {_HITS.format('p2', 'r2')} AS spaceless FROM (SELECT conv_id, turn, ltrim(p, E' \t\n') AS p1, ltrim(r, E' \t\n') AS r1, regexp_replace(p, '\s+', '', 'g') AS p2, regexp_replace(r, '\s+', '', 'g') AS r2 FROM {_EDITED})")
def aligned_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, r = F.col("p"), F.col("r")
    return _edited(spark, sf_dir).select("conv_id", "turn", hanja_accuracy(p, r).alias("aligned"), hanja_accuracy(p, r, True).alias("spaceless"))


@query("ev18_block_recall")
def block_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edited(spark, sf_dir).select("conv_id", "turn", hanja_recall(F.col("p"), F.col("r")).alias("recall"))


@query("ev19_drift", f"WITH g AS (SELECT list_max(list_transform(range(1, 11), lambda i: abs(CAST(v[i] AS DOUBLE) - CAST(u[i] AS DOUBLE)))) AS d, list_position(v, list_max(v)) = list_position(u, list_max(u)) AS same FROM {_LOGITS}) SELECT round(avg(CAST(same AS INTEGER)), 6) AS agreement, round(quantile_cont(d, 0.5), 6) AS drift_p50, round(quantile_cont(d, 0.99), 6) AS drift_p99, round(max(d), 6) AS drift_max FROM g")
def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ev.drift(_logits(spark, sf_dir), "v", "u"), "agreement", "drift_p50", "drift_p99", "drift_max", digits=6)


_PROBS = f"(SELECT vec_id, list_transform(v, lambda x: exp(CAST(x AS DOUBLE)) / list_sum(list_transform(v, lambda z: exp(CAST(z AS DOUBLE))))) AS p, list_transform(u, lambda x: exp(CAST(x AS DOUBLE)) / list_sum(list_transform(u, lambda z: exp(CAST(z AS DOUBLE))))) AS q FROM {_LOGITS})"


@query("ev20_js_divergence", f"SELECT vec_id, round(list_sum(list_transform(range(1, 11), lambda i: p[i] * ln(2 * p[i] / (p[i] + q[i])) + q[i] * ln(2 * q[i] / (p[i] + q[i])))) / 2, 9) AS jsd FROM {_PROBS}")
def js_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    jsd = ev.js_divergence(ev.probabilities(F.col("v")), ev.probabilities(F.col("u")))
    return _logits(spark, sf_dir).select("vec_id", F.round(jsd, 9).alias("jsd"))


@query("ev20_mismatch_share", f"SELECT vec_id, round(list_sum(list_transform(range(1, 11), lambda i: CAST(abs(CAST(v[i] AS DOUBLE) - CAST(u[i] AS DOUBLE)) > CAST(0.05 AS DOUBLE) + CAST(0.1 AS DOUBLE) * abs(CAST(u[i] AS DOUBLE)) AS INTEGER))) / CAST(10 AS DOUBLE), 9) AS share FROM {_LOGITS}")
def mismatch_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _logits(spark, sf_dir).select("vec_id", F.round(ev.mismatch_share(F.col("v"), F.col("u"), 0.05, 0.1), 9).alias("share"))


@query("ev21_confidence_bands", "WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events) SELECT event_id, CASE WHEN value < a THEN 'random' WHEN value > b THEN 'teacher' ELSE 'model' END AS band FROM events, q")
def confidence_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.confidence_bands(table(spark, sf_dir, "events"), "value").select("event_id", "band")


@query("ev22_margins", "SELECT round(avg(greatest(0.0, 0.1 + l_tax - l_discount)), 6) AS hinge, round(avg(CAST(l_discount > l_tax AS INTEGER)), 6) AS win_rate, round(avg(l_discount - l_tax), 6) AS margin FROM lineitem")
def margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ev.margin_stats(table(spark, sf_dir, "lineitem"), "l_discount", "l_tax"), "hinge", "win_rate", "margin", digits=6)


_COS = "round(list_sum(list_transform(range(1, 65), lambda i: CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE))) / (sqrt(list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))), 6)"


@query("ev23_nearest", f"SELECT vec_id, nearest, score FROM (SELECT a.vec_id, b.vec_id AS nearest, {_COS} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS r FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id) WHERE r = 1")
def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: the stated queries (ids divisible by 100) against all rows."""
    rows = table(spark, sf_dir, "embeddings")
    return retrieval.nearest(rows.where("vec_id % 100 = 0"), retrieval.index(rows, "embedding", "vec_id"), "embedding", "vec_id")


_SIDES = "SELECT vec_id, label, (vec_id // 100) % 2 AS side, embedding FROM embeddings"
_CENTRED_SIDES = "SELECT vec_id, label, r.side, list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) - m[i]) AS embedding FROM r JOIN (SELECT side, list(m ORDER BY i) AS m FROM (SELECT side, i, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT side, unnest(range(1, 65)) AS i, unnest(embedding) AS x FROM r) GROUP BY side, i) GROUP BY side) USING (side)"
_CROSS = f"SELECT vec_id, side, nearest, score, hit FROM (SELECT a.vec_id, a.side, b.vec_id AS nearest, {_COS} AS score, a.label = b.label AS hit, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS k FROM s a JOIN s b ON a.side <> b.side WHERE a.vec_id % 100 = 0) WHERE k = 1"


def _cross_side(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (vec_id, side, nearest, score, hit): each stated query's nearest row of the other side, both directions."""
    out = None
    for side in (0, 1):
        cells = retrieval.index(rows.where(F.col("side") != side), "embedding", "vec_id")
        found = retrieval.nearest(rows.where((F.col("side") == side) & (F.col("vec_id") % 100 == 0)), cells, "embedding", "vec_id").withColumn("side", F.lit(side).cast("long"))
        out = found if out is None else out.unionByName(found)
    labels = labels.select("vec_id", "label")
    own = out.join(labels, "vec_id").join(labels.selectExpr("vec_id AS nearest", "label AS other"), "nearest")
    return own.select("vec_id", "side", "nearest", "score", (F.col("label") == F.col("other")).alias("hit"))


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").withColumn("side", F.floor(F.col("vec_id") / 100) % 2)


@query("ev23_bidirectional", f"WITH s AS ({_SIDES}) {_CROSS}")
def bidirectional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows stand for texts in two scripts by their hundreds; a hit is a nearest row of the same label."""
    rows = _sides(spark, sf_dir)
    return _cross_side(rows, rows)


@query("ev23_centred_accuracy", f"WITH r AS ({_SIDES}), s AS ({_CENTRED_SIDES}) SELECT side, count(*) AS n, round(avg(CAST(hit AS INTEGER)), 9) AS accuracy FROM ({_CROSS}) GROUP BY side")
def centred_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after each side's mean is taken off: top-1 accuracy per direction."""
    rows = _sides(spark, sf_dir)
    found = _cross_side(retrieval.centred(rows, "embedding", ["side"]), rows)
    return found.groupBy("side").agg(F.count("*").alias("n"), F.round(F.avg(F.col("hit").cast("int")), 9).alias("accuracy"))


# --- numeric -----------------------------------------------------------------------------------------------------

_RATE = "CASE WHEN x < 0.05 THEN x / 0.05 WHEN x < 0.15 THEN 1.0 WHEN x < 1.0 THEN CASE WHEN x >= 0.8 THEN 0.1 + 0.0 ELSE 0.1 + 0.9 * 0.5 * (1 + cos(pi() * least(greatest((x - 0.15) / 0.65, 0.0), 1.0))) END ELSE 0.1 END"


#: Each document with the share of all tokens that a run has seen when it comes.
_SEEN = f"(SELECT doc_id, CAST(sum(n_tokens) OVER (ORDER BY doc_id) AS DOUBLE) / CAST(sum(n_tokens) OVER () AS DOUBLE) AS x FROM {WORDS})"


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = row_running(_words(spark, sf_dir), "doc_id", "n_tokens", "seen")
    total = rows.agg(F.sum("n_tokens").cast("double").alias("total"))  # a row
    return rows.crossJoin(F.broadcast(total)).select("doc_id", (F.col("seen").cast("double") / F.col("total")).alias("x"))


@query("nm1_learning_rate", f"SELECT doc_id, round({_RATE}, 9) AS rate FROM {_SEEN}")
def learning_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = nm.learning_rate(F.col("x"), 1.0, 0.05, 0.10, 0.1, "cosine", cooldown=0.2)
    return _seen(spark, sf_dir).select("doc_id", F.round(rate, 9).alias("rate"))


@query("nm1_learning_rate_rsqrt", f"SELECT doc_id, round(CASE WHEN x < 0.05 THEN x / 0.05 WHEN x < 0.15 THEN 1.0 ELSE sqrt(CAST(0.15 AS DOUBLE) / x) END, 9) AS rate FROM {_SEEN}")
def learning_rate_rsqrt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = nm.learning_rate(F.col("x"), 1.0, 0.05, 0.10, 0.1, "rsqrt")
    return _seen(spark, sf_dir).select("doc_id", F.round(rate, 9).alias("rate"))


@query("nm2_aligned", "SELECT doc_id, CAST(ceil(n_chars / CAST(128 AS DOUBLE)) * 128 AS BIGINT) AS n FROM documents")
def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", nm.align_up(F.col("n_chars"), 128).alias("n"))


@query("nm3_repetition_penalty", "SELECT vec_id, round(CASE WHEN label >= 5 THEN x WHEN x > 0 THEN x / CAST(1.2 AS DOUBLE) ELSE x * CAST(1.2 AS DOUBLE) END, 9) AS logit FROM (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings)")
def repetition_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("embedding")[0].cast("double")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(nm.repetition_penalty(x, F.col("label") < 5, 1.2), 9).alias("logit"))


@query("nm4_blocked_ngrams", f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(range(1, len(ids) - 1), lambda i: ids[i] = ids[len(ids) - 1] AND ids[i + 1] = ids[len(ids)]), lambda i: ids[i + 2]))), ' ') AS blocked FROM {_IDS}")
def blocked_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(spark, sf_dir).select("doc_id", F.array_join(nm.blocked_ngrams(F.col("ids"), 3).cast("array<string>"), " ").alias("blocked"))


_G = f"(SELECT l_orderkey, l_linenumber, l_quantity / 10 - ln(-ln(greatest({U(42, 'l_orderkey').replace('CAST(l_orderkey AS VARCHAR)', 'CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR)')}, 1e-10))) AS s FROM lineitem)"


@query("nm5_gumbel_choice", f"SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY s DESC, l_linenumber) AS r FROM {_G}) WHERE r = 1")
def gumbel_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 10).alias("q"))
    return nm.gumbel_choice(rows, "l_orderkey", "q", "l_linenumber")


@query("nm6_weighted_average", "SELECT l_returnflag, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 6) AS l_extendedprice FROM lineitem GROUP BY 1")
def weighted_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(nm.weighted_average(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", "l_quantity"), "l_extendedprice", digits=6)


@query("nm7_phases", "SELECT event_id, CASE WHEN event_id < 0.1 * 1000 THEN 'warmup' WHEN event_id < 0.35 * 1000 THEN 'constant' ELSE 'decay' END AS phase FROM events")
def phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", nm.phase(F.col("event_id"), 1000, 0.1, 0.25).alias("phase"))


@query("so5_clipped_overlap", f"SELECT p.doc_id, CAST(coalesce(m, 0) AS INTEGER) AS n FROM {_PAIRED} p LEFT JOIN {_hits(1)} h ON h.doc_id = p.doc_id")
def clipped_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.operators.relational import clipped_overlap as overlap

    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    return _pairs(spark, sf_dir).select("doc_id", overlap(words("c"), words("t")).alias("n"))
