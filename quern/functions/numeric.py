"""Schedules and sampling arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.ranks import uniform


def align_up(n: Column, multiple: int) -> Column:
    return (F.ceil(n / multiple) * multiple).cast("bigint")


def learning_rate(progress: Column, peak: float, warmup: float, constant: float, least: float, shape: str = "cosine", cooldown: float = 0.0, cooldown_shape: str = "linear") -> Column:
    """Rate at a share of the run: a linear warm-up, a constant part, a decay (cosine, linear or rsqrt) and a cooldown to
    the least share of the peak."""
    low, begin, cool = peak * least, warmup + constant, 1.0 - cooldown
    up = progress / max(warmup, 1e-8) * peak
    if shape == "rsqrt":
        top = peak * math.sqrt(begin / max(cool, 1e-8))
        body = F.sqrt(F.lit(begin) / F.greatest(progress, F.lit(1e-8))) * peak
        if cooldown > 0:
            body = F.when(progress >= cool, top + (low - top) * F.least((progress - cool) / cooldown, F.lit(1.0))).otherwise(body)
        return F.when(progress < warmup, up).when(progress < begin, F.lit(peak)).otherwise(body)
    room = (cool if cooldown > 0 else 1.0) - begin
    part = F.least(F.greatest((progress - begin) / max(room, 1e-8), F.lit(0.0)), F.lit(1.0))
    body = F.lit(peak) - (peak - low) * part if shape == "linear" else low + (peak - low) * 0.5 * (1.0 + F.cos(part * math.pi))
    if cooldown > 0:
        top = peak if begin >= cool else low
        gone = F.least((progress - cool) / cooldown, F.lit(1.0))
        body = F.when(progress >= cool, low + (top - low) * (1.0 - (F.sqrt(gone) if cooldown_shape == "sqrt" else gone))).otherwise(body)
    return F.when(progress < warmup, up).when(progress < begin, F.lit(peak)).when(progress < 1.0, body).otherwise(F.lit(low))


def phase(tokens: Column, total: int, warmup: float, constant: float) -> Column:
    """warmup, constant or decay by tokens."""
    return F.when(tokens < warmup * total, "warmup").when(tokens < (warmup + constant) * total, "constant").otherwise("decay")


def repetition_penalty(logit: Column, seen: Column, penalty: float) -> Column:
    """Positive logits of seen tokens are divided, others multiplied."""
    return F.when(~seen, logit).when(logit > 0, logit / penalty).otherwise(logit * penalty)


def blocked_ngrams(ids: Column, n: int) -> Column:
    """Ids that would repeat an n-gram: those that followed the last n - 1 ids before."""
    size = F.size(ids)
    tail = F.slice(ids, F.greatest(size - n + 2, F.lit(1)), n - 1)
    starts = F.when(size >= n, F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    hits = F.filter(starts, lambda i: F.slice(ids, i, n - 1) == tail)
    return F.array_sort(F.array_distinct(F.transform(hits, lambda i: F.get(ids, i + n - 2))))


def gumbel_choice(df: DataFrame, group: str, logit: str, index: str, temperature: float = 1.0, seed: int = 42) -> DataFrame:
    """A seeded draw per group from the softmax of its logits: the largest logit with Gumbel noise."""
    u = F.greatest(uniform(seed, group, index), F.lit(1e-10))
    noisy = F.col(logit) / temperature - F.log(-F.log(u))
    best = F.max(F.struct(noisy.alias("s"), (-F.col(index)).alias("i"))).alias("__b")
    return df.groupBy(group).agg(best).select(group, (-F.col("__b.i")).alias(index))


def weighted_average(df: DataFrame, name: str, value: str, weight: str) -> DataFrame:
    """Per name the weighted mean of its values, as for averaging the parameters of several steps."""
    return df.groupBy(name).agg((F.sum(F.col(weight) * F.col(value)) / F.sum(weight)).alias(value))


def smoothed(df: DataFrame, step: str, value: str, window: int, by: list[str] | None = None) -> DataFrame:
    """Mean over windows of so many steps."""
    return df.groupBy(F.floor(F.col(step) / window).alias("window_id"), *(by or [])).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def last_of(df: DataFrame, by: str, step: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(step))
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
