"""Evaluation metrics over tables of predictions: all are aggregates, so they scale as any group-by does."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.relational import average_rank, linear_quantiles


def mean_of(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def confusion(df: DataFrame, truth: str, prediction: str, by: list[str] | None = None) -> DataFrame:
    """Rows (by, class, tp, fp, fn, support) over the union of true and predicted classes."""
    by = by or []
    cells = df.groupBy(*by, truth, prediction).agg(F.count("*").alias("__n"))
    hit = F.col(truth) == F.col(prediction)
    as_truth = cells.select(*by, F.col(truth).alias("class"), F.when(hit, F.col("__n")).otherwise(0).alias("tp"), F.lit(0).alias("fp"), F.when(~hit, F.col("__n")).otherwise(0).alias("fn"), F.col("__n").alias("support"))
    as_prediction = cells.where(~hit).select(*by, F.col(prediction).alias("class"), F.lit(0).alias("tp"), F.col("__n").alias("fp"), F.lit(0).alias("fn"), F.lit(0).alias("support"))
    return as_truth.unionByName(as_prediction).groupBy(*by, "class").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "support")))


def f1_scores(df: DataFrame, truth: str, prediction: str, by: list[str] | None = None) -> DataFrame:
    """Macro and support-weighted F1; a class without any true or predicted positive counts as 0."""
    c = confusion(df, truth, prediction, by)
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    weighted = F.coalesce(F.try_divide(F.sum(f1 * F.col("support")), F.sum("support").cast("double")), F.lit(0.0))
    return c.groupBy(*(by or [])).agg(F.avg(f1).alias("macro_f1"), weighted.alias("weighted_f1"))


def correlations(df: DataFrame, x: str, y: str, flat: float = 1e-8) -> DataFrame:
    """One row: Pearson, Spearman (average ranks), mean absolute error; correlations of a constant prediction are 0."""
    ranked = average_rank(average_rank(df.select(x, y), x, "__rx"), y, "__ry")
    collapsed = F.stddev_pop(F.col(x).cast("double")) < flat

    def safe(a: Column, b: Column) -> Column:
        r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))  # corr itself fails where one is constant
        return F.when(collapsed, F.lit(0.0)).otherwise(r)

    return ranked.agg(
        safe(F.col(x).cast("double"), F.col(y).cast("double")).alias("pearson"),
        safe(F.col("__rx"), F.col("__ry")).alias("spearman"),
        F.avg(F.abs(F.col(x).cast("double") - F.col(y).cast("double"))).alias("mae"),
    )


def temporal_scores(df: DataFrame, predicted: str, truth: str) -> DataFrame:
    """One row: share within five years, of the same decade and century among parsed predictions, and of those parsed."""
    p, t = F.col(predicted), F.col(truth)
    same = lambda k: F.floor(p / k) == F.floor(t / k)
    return df.agg(
        F.avg(F.when(p.isNotNull(), (F.abs(p - t) <= 5).cast("double"))).alias("exact"),
        F.avg(F.when(p.isNotNull(), same(10).cast("double"))).alias("decade"),
        F.avg(F.when(p.isNotNull(), same(100).cast("double"))).alias("century"),
        F.coalesce(F.avg(F.abs(p - t).cast("double")), F.lit(float("inf"))).alias("mae"),
        F.count_if(p.isNull()).alias("unparsed"),
        mean_of(p.isNotNull()).alias("parsed_ratio"),
    )


def word_ngrams(text: Column, n: int) -> Column:
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    k = F.size(words) - n + 1
    return F.when(k > 0, F.transform(F.sequence(F.lit(1), k), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


_SIDES = [f"{k}{n}" for n in range(1, 5) for k in ("m", "t")] + ["nc", "nr"]


def _counted(words: list[str], n: int) -> Counter:
    return Counter(zip(*(words[i:] for i in range(n)), strict=False))


@F.pandas_udf(T.StructType([T.StructField(k, T.LongType()) for k in _SIDES]))
def overlap_counts(reference: pd.Series, candidate: pd.Series) -> pd.DataFrame:
    """Of each pair: clipped matches (m1..m4) and candidate n-grams (t1..t4) of one to four words, and both lengths.

    Counting with hash tables is linear in the words. As array expressions it is quadratic, and took some hundred times
    as long.
    """
    rows = []
    for r, c in zip(reference, candidate, strict=True):
        r, c = (r or "").lower().split(), (c or "").lower().split()
        row = []
        for n in range(1, 5):
            own = _counted(c, n)
            row += [(own & _counted(r, n)).total(), own.total()]
        rows.append((*row, len(c), len(r)))
    return pd.DataFrame(rows, columns=_SIDES)


def _penalty(nc: Column, nr: Column) -> Column:
    return F.when(nc >= nr, F.lit(1.0)).otherwise(F.exp(F.lit(1.0) - F.try_divide(nr.cast("double"), nc.cast("double"))))


def sentence_bleu(df: DataFrame, reference: str, candidate: str, name: str = "bleu") -> DataFrame:
    """Adds BLEU of one to four words with a brevity penalty; a size without a match counts as 1 / 2^n, a candidate of
    fewer than four words as 0."""
    counted = df.withColumn("__c", overlap_counts(F.col(reference), F.col(candidate)))
    c = lambda k: F.col(f"__c.{k}")
    logs = sum((F.log(F.when(c(f"m{n}") == 0, F.lit(1.0 / 2**n)).otherwise(F.try_divide(c(f"m{n}").cast("double"), c(f"t{n}").cast("double")))) for n in range(1, 5)), F.lit(0.0))
    return counted.withColumn(name, F.when(c("t4") > 0, _penalty(c("nc"), c("nr")) * F.exp(logs / 4)).otherwise(F.lit(0.0))).drop("__c")


def corpus_bleu(df: DataFrame, reference: str, candidate: str) -> DataFrame:
    """One row: BLEU of summed counts, and its brevity penalty."""
    counted = df.select(overlap_counts(F.col(reference), F.col(candidate)).alias("c"))
    one = counted.agg(*(F.sum(f"c.{k}").alias(k) for k in _SIDES))
    penalty = _penalty(F.col("nc"), F.col("nr"))
    parts = [F.try_divide(F.col(f"m{n}").cast("double"), F.col(f"t{n}").cast("double")) for n in range(1, 5)]
    whole = parts[0] > 0
    for p in parts[1:]:
        whole = whole & (p > 0)
    mean = F.exp(sum((F.log(p) for p in parts[1:]), F.log(parts[0])) / 4)
    return one.select(F.when(F.coalesce(whole, F.lit(False)), penalty * mean).otherwise(F.lit(0.0)).alias("bleu"), penalty.alias("brevity_penalty"))


def rouge_n(df: DataFrame, reference: str, candidate: str, n: int) -> DataFrame:
    """Adds precision, recall and fmeasure of n-word overlaps (n up to 4), 0 where either side has no n words."""
    counted = df.withColumn("__c", overlap_counts(F.col(reference), F.col(candidate)))
    hits, total = F.col(f"__c.m{n}").cast("double"), F.col(f"__c.t{n}")
    wanted = F.greatest(F.col("__c.nr") - (n - 1), F.lit(0))
    both = (total > 0) & (wanted > 0)
    p, r = F.when(both, F.try_divide(hits, total)).otherwise(F.lit(0.0)), F.when(both, F.try_divide(hits, wanted)).otherwise(F.lit(0.0))
    return counted.withColumns({"precision": p, "recall": r, "fmeasure": F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))}).drop("__c")


def common_length(a: list, b: list) -> int:
    """Length of the longest common subsequence: a row of the table is the bits of one integer."""
    where: dict = {}
    for j, y in enumerate(b):
        where.setdefault(y, []).append(j)
    masks = {y: sum(1 << j for j in at) for y, at in where.items() if len(at) < 64}
    for y, at in where.items():
        if y not in masks:
            bits = bytearray(len(b) // 8 + 1)
            for j in at:
                bits[j >> 3] |= 1 << (j & 7)
            masks[y] = int.from_bytes(bits, "little")
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & masks.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("precision", "recall", "fmeasure")]))
def rouge_l(reference: pd.Series, candidate: pd.Series) -> pd.DataFrame:
    """Of the longest common subsequence of words."""

    def one(r, c):
        r, c = (r or "").lower().split(), (c or "").lower().split()
        if not r or not c:
            return 0.0, 0.0, 0.0
        n = common_length(r, c)
        p, q = n / len(c), n / len(r)
        return p, q, 2 * p * q / (p + q) if p + q else 0.0

    return pd.DataFrame([one(r, c) for r, c in zip(reference, candidate, strict=True)], columns=["precision", "recall", "fmeasure"])


def category_accuracy(df: DataFrame, category: str, predicted: str, actual: str) -> DataFrame:
    """Accuracy and size of each category."""
    return df.groupBy(category).agg(mean_of(F.col(predicted) == F.col(actual)).alias("accuracy"), F.count("*").alias("n"))


def segments_per_row(df: DataFrame, segments: str) -> DataFrame:
    """One row: mean and largest number of segments of packed rows, by their segment ids from 1; 0 is padding."""
    top = F.coalesce(F.array_max(segments), F.lit(0))
    return df.agg(F.avg(top).alias("mean"), F.max(top).alias("top"))


def choice_accuracy(df: DataFrame, example: str, candidate: str, logprob: str, n_bytes: str, correct: str, by: list[str] | None = None) -> DataFrame:
    """Accuracy of the candidate with the largest log-probability a byte, the first on ties."""
    best = F.max(F.struct((F.col(logprob) / F.col(n_bytes)).alias("s"), (-F.col(candidate)).alias("c"))).alias("__b")
    picked = df.groupBy(*(by or []), example).agg(best, F.first(correct).alias("__y"))
    return picked.groupBy(*(by or [])).agg(mean_of(-F.col("__b.c") == F.col("__y")).alias("accuracy"), F.count("*").alias("n"))


def decade_scores(df: DataFrame, example: str, index: str, midpoint: str, logprob: str, correct: str, year: str) -> DataFrame:
    """One row: accuracy of the decade, of it or a neighbour, and year errors of the best and of the expected middle."""
    m = F.max(logprob).over(Window.partitionBy(example))
    e = df.withColumn("__e", F.exp(F.col(logprob) - m))
    best = F.max(F.struct(F.col(logprob).alias("s"), (-F.col(index)).alias("i"), F.col(midpoint).alias("mid"))).alias("__b")
    one = e.groupBy(example).agg(best, (F.sum(F.col("__e") * F.col(midpoint)) / F.sum("__e")).alias("__x"), F.first(correct).alias("__y"), F.first(year).alias("__t"))
    i = -F.col("__b.i")
    return one.agg(
        mean_of(i == F.col("__y")).alias("decade_accuracy"),
        mean_of(F.abs(i - F.col("__y")) <= 1).alias("adjacent_accuracy"),
        F.avg(F.abs(F.col("__b.mid") - F.col("__t"))).alias("year_mae"),
        F.avg(F.abs(F.col("__x") - F.col("__t"))).alias("expected_year_mae"),
    )


def cross_entropy(logits: Column, label: Column) -> Column:
    """Of one position: log-sum-exp of its logits less the label's."""
    m = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - m))
    return F.log(total) + m - F.get(logits, label)


def token_metrics(df: DataFrame, logits: str, label: str, ignore: int = -100) -> DataFrame:
    """One row over positions with a label: loss, perplexity, accuracy and their number."""
    kept = df.where(F.col(label) != ignore)
    best = F.array_position(logits, F.array_max(logits)) - 1
    loss = F.avg(cross_entropy(F.col(logits), F.col(label)))
    return kept.agg(loss.alias("loss"), F.exp(loss).alias("perplexity"), mean_of(best == F.col(label)).alias("accuracy"), F.count("*").alias("n_tokens"))


def weighted_totals(df: DataFrame, loss: str, correct: str, tokens: str, by: list[str] | None = None) -> DataFrame:
    """Sums of losses and hits over the sum of tokens, and the perplexity."""
    ratio = lambda c: F.sum(c) / F.sum(tokens)
    return df.groupBy(*(by or [])).agg(ratio(loss).alias("loss"), ratio(correct).alias("accuracy"), F.exp(ratio(loss)).alias("perplexity"), F.sum(tokens).alias("tokens"))


def drift(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row for two arrays of logits: agreement of the largest, and quantiles of the largest difference."""
    first = lambda x: F.array_position(x, F.array_max(x))
    gap = F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    totals = df.agg(mean_of(first(F.col(a)) == first(F.col(b))).alias("agreement"), F.max(gap).alias("drift_max"))
    return totals.crossJoin(F.broadcast(linear_quantiles(df.select(gap.alias("gap")), "gap", {"drift_p50": 0.5, "drift_p99": 0.99})))  # one row each


def probabilities(logits: Column) -> Column:
    m = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - m))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def js_divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence of two arrays of probabilities, in nats."""
    part = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x > 0, x * F.log(x / ((x + y) / 2))).otherwise(F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    return (part(p, q) + part(q, p)) / 2


def top_overlap(a: Column, b: Column, k: int) -> Column:
    """Share of the k largest positions that two arrays have in common; ties go to the earlier position."""
    best = lambda x: F.transform(F.slice(F.array_sort(F.transform(x, lambda v, i: F.struct((-v).alias("v"), i.alias("i")))), 1, k), lambda z: z["i"])
    return F.size(F.array_intersect(best(a), best(b))) / F.lit(float(k))


def mismatch_share(a: Column, b: Column, atol: float, rtol: float) -> Column:
    """Share of positions that differ by more than atol + rtol * |b|."""
    off = F.zip_with(a, b, lambda x, y: (F.abs(x - y) > atol + rtol * F.abs(y)).cast("double"))
    return F.aggregate(off, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def confidence_bands(df: DataFrame, loss: str, low: float | None = None, high: float | None = None, name: str = "band") -> DataFrame:
    """Adds random below the lower bound, teacher above the upper, model between; the bounds are quartiles if not given."""
    if low is None or high is None:
        df = df.crossJoin(F.broadcast(linear_quantiles(df, loss, {"__low": 0.25, "__high": 0.75})))  # one row
        a, b = F.col("__low"), F.col("__high")
    else:
        a, b = F.lit(low), F.lit(high)
    return df.withColumn(name, F.when(F.col(loss) < a, "random").when(F.col(loss) > b, "teacher").otherwise("model")).drop("__low", "__high")


def margin_stats(df: DataFrame, positive: str, negative: str, margin: float = 0.1) -> DataFrame:
    """One row: mean hinge, share of wins and mean margin."""
    p, n = F.col(positive), F.col(negative)
    return df.agg(F.avg(F.greatest(F.lit(0.0), F.lit(margin) + n - p)).alias("hinge"), mean_of(p > n).alias("win_rate"), F.avg(p - n).alias("margin"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
