"""Projection, predicates, joins, membership, aggregates, ranks and set operations over corpus tables."""

from __future__ import annotations

from collections import Counter
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.config import SourceConfig
from quern.operators.ranks import key_bucket, row_index

# --- projection -------------------------------------------------------------------------------------------------


def canonical(df: DataFrame, source: SourceConfig) -> DataFrame:
    """The canonical schema of a source's rows; fields that it doesn't have are null."""
    have = set(df.columns)
    pick = lambda name, kind="string": (F.col(name) if name and name in have else F.lit(None)).cast(kind)
    return df.select(
        pick(source.text_field).alias("original_text"),
        pick(source.metadata_field).alias("metadata"),
        F.coalesce(pick("source"), F.lit(source.name)).alias("source"),
        F.lit(source.data_type).alias("data_type"),
        (F.col("sentences") if "sentences" in have else F.lit(None)).cast("array<string>").alias("sentences"),
        pick(source.target_field).alias("target"),
        pick(source.year_field, "int").alias("year"),
        pick(source.sentence1_field).alias("sentence1"),
        pick(source.sentence2_field).alias("sentence2"),
        pick(source.score_field, "double").alias("rounded_score"),
    )


def drop_empty(df: DataFrame, text: str = "original_text", target: str | None = None) -> DataFrame:
    """Rows with a text, and with a target where one is asked for."""
    kept = df.where(F.col(text).isNotNull() & (F.col(text) != ""))
    return kept.where(F.col(target).isNotNull() & (F.col(target) != "")) if target else kept


def add_row_index(df: DataFrame, key: str, name: str = "local_index") -> DataFrame:
    """A contiguous index from 0 in key order, ranked in buckets rather than in one task."""
    return row_index(df, key, name="__rn").withColumn(name, F.col("__rn") - 1).drop("__rn")


def require_absent(df: DataFrame, column: str, literal: str) -> DataFrame:
    """Fails while it runs if a text holds the literal."""
    bad = F.raise_error(F.concat(F.lit(f"{literal} in "), F.col(column))).cast("string")
    return df.withColumn(column, F.when(F.contains(F.col(column), F.lit(literal)), bad).otherwise(F.col(column)))


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def active_sources(df: DataFrame, active: DataFrame, stale: DataFrame, source: str = "source") -> DataFrame:
    """Rows of active sources; those of stale ones are dropped, and any other source is an error."""
    marks = active.select(source, F.lit("active").alias("__k")).unionByName(stale.select(source, F.lit("stale").alias("__k"))).groupBy(source).agg(F.min("__k").alias("__k"))
    joined = df.join(marks, source, "left")
    unknown = F.raise_error(F.concat(F.lit("unknown source "), F.coalesce(F.col(source), F.lit("null")))).cast("string")
    return joined.withColumn("__k", F.coalesce("__k", unknown)).where("__k = 'active'").select(*df.columns)


# --- joins and membership ----------------------------------------------------------------------------------------


def without(df: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Anti join; rows whose key is null stay."""
    return df.join(excluded.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def within(df: DataFrame, pool: DataFrame, key: str) -> DataFrame:
    """Semi join."""
    return df.join(pool.select(key), key, "left_semi")


def require_all(pool: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The pool, if every one of its keys was found."""
    if (n := pool.join(found.select(key), key, "left_anti").count()) > 0:
        raise ValueError(f"{n} keys of the pool are missing")
    return pool


def flag_members(df: DataFrame, members: DataFrame, key: str, flag: str, member_key: str | None = None) -> DataFrame:
    """Adds whether the key is among the members."""
    own = members.select(F.col(member_key or key).alias("__m")).where("__m is not null").distinct().withColumn("__f", F.lit(True))
    return df.join(own, F.col(key) == F.col("__m"), "left").withColumn(flag, F.coalesce("__f", F.lit(False))).drop("__m", "__f")


def text_digest(text: Column) -> Column:
    """32 bytes that stand for a text of any length; texts of one digest are equal, and null has none."""
    return F.unhex(F.sha2(text, 256))


def flag_text_members(df: DataFrame, members: DataFrame, text: str, flag: str, member_text: str | None = None) -> DataFrame:
    """Adds whether an equal text is among the members: by their SHA-256 digests, so no text of the members is shuffled, and
    those of df only where a later step reads them."""
    own = members.select(text_digest(F.col(member_text or text)).alias("__m")).where("__m is not null").distinct().withColumn("__f", F.lit(True))
    joined = df.withColumn("__k", text_digest(F.col(text))).join(own, F.col("__k") == F.col("__m"), "left")
    return joined.withColumn(flag, F.coalesce("__f", F.lit(False))).drop("__k", "__m", "__f")


def lookup(df: DataFrame, values: DataFrame, key: str, value: str, default, name: str | None = None) -> DataFrame:
    """Adds a value by key, the default for keys that are unknown."""
    own = values.select(F.col(key).alias("__k"), F.col(value).alias("__v"))
    return df.join(own, F.col(key) == F.col("__k"), "left").withColumn(name or value, F.coalesce("__v", F.lit(default))).drop("__k", "__v")


def keep_mask(tail: Column, excluded: list[str]) -> Column:
    """False for an excluded value, true for any other and for null."""
    return F.coalesce(~tail.isin(excluded), F.lit(True))


# --- aggregates --------------------------------------------------------------------------------------------------


def audit(df: DataFrame, keep: Column, member: Column, tail: Column) -> DataFrame:
    """One row: rows, kept, members, null tails, distinct dropped tails, in a single pass."""
    return df.agg(
        F.count("*").alias("n"),
        F.count_if(keep).alias("kept"),
        F.count_if(F.coalesce(member, F.lit(False))).alias("members"),
        F.count_if(tail.isNull()).alias("no_tail"),
        F.count_distinct(F.when(~keep, tail)).alias("dropped_distinct"),
    )


def summary(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """count, mean, median, population deviation, min and max of each group.

    The median comes from the counts of distinct values, ordered in buckets, so no reducer holds the values of a group.
    """
    by, v = by or [], F.col(value).cast("double")
    rest = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    counts = df.where(v.isNotNull()).groupBy(*by, v.alias("__v")).agg(F.count("*").alias("__c"))
    placed = row_running(counts, "__v", "__c", "__upto", by)
    whole = placed.groupBy(*(F.col(c).alias(f"__g{i}") for i, c in enumerate(by))).agg(F.max("__upto").alias("__n"))
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(by)), F.lit(True))
    held = placed.join(whole, same)
    middle = (_value_at(F.floor((F.col("__n") - 1) / 2)) + _value_at(F.floor(F.col("__n") / 2))) / 2
    both = rest.unionByName(held.groupBy(*by).agg(middle.alias("median")), allowMissingColumns=True)
    names = ("n", "mean", "median", "std", "min", "max")
    return both.groupBy(*by).agg(*(F.max(c).alias(c) for c in names))


def _placed(df: DataFrame, value: str) -> DataFrame:
    """Distinct values with their count, the number of rows up to them, and that of all rows: ties and order need no one task."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    return row_running(counts, "__v", "__c", "__upto").withColumn("__n", counts.agg(F.sum("__c")).scalar())


def _value_at(place: Column) -> Column:
    return F.max(F.when((F.col("__upto") - F.col("__c") <= place) & (place < F.col("__upto")), F.col("__v")))


def linear_quantiles(df: DataFrame, value: str, at: dict[str, float]) -> DataFrame:
    """One row of exact interpolated quantiles; nulls are left out."""
    picks = []
    for name, q in at.items():
        place = F.lit(q) * (F.col("__n") - 1)
        low, high, part = _value_at(F.floor(place)), _value_at(F.ceil(place)), F.max(place - F.floor(place))
        picks.append(F.when(part == 0, low.cast("double")).otherwise(low + (high - low) * part).alias(name))
    return _placed(df, value).agg(*picks)


def nearest_quantiles(df: DataFrame, value: str, at: dict[str, float]) -> DataFrame:
    """One row of quantiles that are values of rows: the one at rank round(q * (n - 1)), halves away from zero."""
    return _placed(df, value).agg(*(_value_at(F.round(F.lit(q) * (F.col("__n") - 1)).cast("long")).alias(name) for name, q in at.items()))


def stage_counts(df: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """Rows left after each of several predicates in turn, in one pass."""
    so_far, out = F.lit(True), [F.count("*").alias("total")]
    for name, keep in stages.items():
        so_far = so_far & F.coalesce(keep, F.lit(False))
        out.append(F.count_if(so_far).alias(name))
    return df.agg(*out)


def shortfall(df: DataFrame, bucket: str, target: int) -> DataFrame:
    """Rows of each bucket, how many are taken, and how many are missing."""
    n = F.col("available")
    return df.groupBy(bucket).agg(F.count("*").alias("available")).withColumns({"take": F.least(n, F.lit(target)), "missing": F.greatest(F.lit(0), F.lit(target) - n)})


def subgroup_means(df: DataFrame, group: str, value: str) -> DataFrame:
    """Mean and size of each group, where there is more than one."""
    means = df.groupBy(group).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return means.where(means.agg(F.count("*")).scalar() > 1)


def macro_mean(df: DataFrame, outer: str, inner: str, value: Column) -> DataFrame:
    """Per outer group the mean of its inner groups' means."""
    return df.groupBy(outer, inner).agg(F.avg(value).alias("__m")).groupBy(outer).agg(F.avg("__m").alias("macro"))


def long_metrics(df: DataFrame, prefix: str, names: list[str], step: int = 0) -> DataFrame:
    """Rows (name, value, step) of a one-row table's columns, named prefix/column."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f"{prefix}/{n}").alias("name"), F.col(n).cast("double").alias("value")) for n in names)))
    return df.select(pairs.alias("p")).select("p.name", "p.value", F.lit(step).alias("step"))


def length_band(n: Column) -> Column:
    """Names of length bands by powers of two from 1k to 16k."""
    out, low = None, 0
    for high, name in ((1024, "0-1k"), (2048, "1k-2k"), (4096, "2k-4k"), (8192, "4k-8k"), (16384, "8k-16k")):
        cond = (n >= low) & (n < high)
        out, low = F.when(cond, name) if out is None else out.when(cond, name), high
    return out.otherwise("16k+")


def segment_sums(rows: DataFrame, row: str, segments: str, values: str) -> DataFrame:
    """Sums and sizes by (row, segment) of packed rows, padding (segment 0) left out."""
    z = F.explode(F.arrays_zip(F.col(segments).alias("seg"), F.col(values).alias("val")))
    return rows.select(row, z.alias("z")).where("z.seg > 0").groupBy(row, F.col("z.seg").alias("segment")).agg(F.sum("z.val").alias("total"), F.count("*").alias("n"))


# --- ranks, order, sets ------------------------------------------------------------------------------------------


def keep_first(df: DataFrame, subset: list[str], order: list[Column]) -> DataFrame:
    """The first row in order of each value of the subset.

    The winner is found by an ordered minimum, which partial aggregation reduces before the shuffle, so a value that a
    third of all rows share is no hot task.
    """
    others = [c for c in df.columns if c not in subset]
    first = F.min(F.struct(*(o.alias(f"__o{i}") for i, o in enumerate(order)), *others)).alias("__first")
    return df.groupBy(*subset).agg(first).select(*(F.col(c) if c in subset else F.col(f"__first.{c}").alias(c) for c in df.columns))


def argmax(df: DataFrame, group: str, score: Column, index: str) -> DataFrame:
    """Per group the index of the largest score, the first on ties."""
    best = F.max(F.struct(score.alias("s"), (-F.col(index)).alias("i"))).alias("__b")
    return df.groupBy(group).agg(best).select(group, (-F.col("__b.i")).alias(index), F.col("__b.s").alias("score"))


def softmax(df: DataFrame, group: str, logit: str, name: str = "p") -> DataFrame:
    w = Window.partitionBy(group)
    shifted = df.withColumn("__e", F.exp(F.col(logit) - F.max(logit).over(w)))
    return shifted.withColumn(name, F.col("__e") / F.sum("__e").over(w)).drop("__e")


def average_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """Ranks with ties at their mean: from the counts of distinct values, so that only those are ordered."""
    counts = df.groupBy(F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    ranked = row_running(counts, "__v", "__c", "__upto")
    ranked = ranked.select("__v", (F.col("__upto") - (F.col("__c") - 1) / 2.0).alias(name))
    return df.join(ranked, df[value].eqNullSafe(ranked["__v"])).drop("__v")


def _running(df: DataFrame, key: str, value: str, how, upto: int, groups: list[str]) -> DataFrame:
    """Adds an aggregate of the rows of the own bucket up to a row (__own) and that of all buckets before it (__before)."""
    marked = df.withColumn("__b", key_bucket(df, key))
    keys = [*groups, "__b"]
    sums = marked.groupBy(*keys).agg(how(value).alias("__s"))  # a row per group and bucket
    before = how("__s").over(Window.partitionBy(*groups).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    own = how(value).over(Window.partitionBy(*keys).orderBy(key).rowsBetween(Window.unboundedPreceding, upto))
    sums = sums.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), before.alias("__before"))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)))
    return marked.withColumn("__own", own).join(sums, same)


def row_running(df: DataFrame, key: str, value: str, name: str, groups: list[str] | None = None) -> DataFrame:
    """Running sum of a value in the order of a key that has no repeats, in buckets rather than in one task."""
    out = _running(df, key, value, F.sum, 0, groups or [])
    return out.withColumn(name, F.col("__own") + F.coalesce("__before", F.lit(0))).select(*df.columns, name)


def restart_positions(df: DataFrame, row: str, at: str, segment: str, name: str = "position") -> DataFrame:
    """Positions from 0 that restart with each segment of a row."""
    w = Window.partitionBy(row, segment).orderBy(at)
    return df.withColumn(name, F.row_number().over(w) - 1)


def running_best(df: DataFrame, step: str, value: str, run: str | None = None, name: str = "is_best") -> DataFrame:
    """Whether a value is above all earlier ones of its run; the first is. Runs are cut into buckets of steps."""
    out = _running(df, step, value, F.max, -1, [run] if run else [])
    return out.withColumn(name, F.coalesce(F.col(value) > F.greatest("__own", "__before"), F.lit(True))).select(*df.columns, name)


def label_ids(df: DataFrame, label: str, name: str = "label_id") -> DataFrame:
    """Dense ids from 0 of the sorted distinct labels."""
    ids = row_index(df.select(label).where(F.col(label).isNotNull()).distinct(), label, name="__rn")
    return df.join(ids.select(label, (F.col("__rn") - 1).cast("int").alias(name)), label, "left")


def segment_ids(df: DataFrame, row: str, at: str, first: Column, name: str = "segment") -> DataFrame:
    """Segments of a row from 0, each opened by a flag on its first position."""
    w = Window.partitionBy(row).orderBy(at)
    return df.withColumn(name, F.sum(first.cast("int")).over(w) - 1)


def complete(df: DataFrame, required: list[str]) -> DataFrame:
    """Rows with all required columns; a column that is not there at all is an error."""
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"no column {missing}")
    return df.dropna(subset=required)


def budget_counts(df: DataFrame, text: str, tokens: int, chars_per_token: int = 3) -> DataFrame:
    """One row: how many texts fit into the characters of a number of tokens, and how many don't; null ones don't."""
    fits = F.coalesce(F.length(text) <= tokens * chars_per_token, F.lit(False))
    return df.agg(F.count_if(fits).alias("kept"), F.count_if(~fits).alias("dropped"))


def top_k(df: DataFrame, group: str, score: str, index: str, k: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc(score), index)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_p(df: DataFrame, group: str, p: str, index: str, threshold: float) -> DataFrame:
    """The nucleus: by falling probability, those whose predecessors sum to no more than the threshold, renormalised."""
    order = Window.partitionBy(group).orderBy(F.desc(p), index)
    before = F.sum(p).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col(p)
    kept = df.withColumn("__before", before).where(F.col("__before") <= threshold).drop("__before")
    return kept.withColumn("p_kept", F.col(p) / F.sum(p).over(Window.partitionBy(group)))


@F.pandas_udf(T.IntegerType())
def clipped_overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    """Size of the multiset intersection of two arrays, by counting; null for a null side."""
    return pd.Series([None if x is None or y is None else (Counter(x) & Counter(y)).total() for x, y in zip(a, b, strict=True)], dtype="Int32")


def first_appearance(df: DataFrame, value: str, position: str) -> DataFrame:
    """Distinct values by where they first appear."""
    return df.groupBy(value).agg(F.min(position).alias("first_at"))


def char_frequency(df: DataFrame, text: str, position: str) -> DataFrame:
    """Characters with their counts and first places, counted before they are shuffled."""
    ch = F.posexplode(F.filter(F.split(text, ""), lambda c: c != ""))
    return df.select(position, ch.alias("i", "ch")).groupBy("ch").agg(F.count("*").alias("n"), F.min(F.struct(F.col(position).alias("row"), F.col("i"))).alias("first"))
