"""Exact ranks without a single-partition sort, and deterministic stand-ins for random draws.

A global ``row_number`` moves every row to one task, and one over a hot group moves a third of them. Here the order is
cut into buckets first: rows are ranked within (group, bucket), and the counts of the buckets before are added. The
count table has one row per group and bucket, so it is small and joined as its size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Hex digits of the hash that make a bucket: 256 buckets for each group.
HASH_DIGITS = 2
#: Buckets that a numeric key is cut into.
KEY_BUCKETS = 128
#: Rows that the cuts of a string key are taken from.
STRING_SAMPLE = 4096


def hash_key(seed: int | str, *key: Column | str) -> Column:
    """md5 of the seed and the key: the order that stands for a seeded shuffle; the same in DuckDB."""
    parts = [F.col(k) if isinstance(k, str) else k for k in key]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts)))


def uniform(seed: int | str, *key: Column | str) -> Column:
    """A double in [0, 1) from 32 bits of hash_key."""
    return F.conv(F.substring(hash_key(seed, *key), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def bucketed_rank(df: DataFrame, bucket: Column, order: list[Column], groups: list[str] | None = None, name: str = "rn", total: str | None = None) -> DataFrame:
    """Adds the 1-based rank within groups by (bucket, order); bucket must never fall where order rises.

    total also adds the number of rows of the group.
    """
    groups = groups or []
    marked = df.withColumn("__b", bucket)
    keys = [*groups, "__b"]
    counts = marked.groupBy(*keys).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*groups).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1) if groups else Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    if total:
        whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))
        offsets = offsets.withColumn("__all", F.sum("__n").over(whole))
    ranked = marked.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    same = [ranked[k].eqNullSafe(offsets[k]) for k in keys]
    joined = ranked.join(offsets, on=same[0] if len(same) == 1 else [*same][0] & _all(same[1:]), how="left")
    out = [ranked[c] for c in df.columns] + [(F.col("__r") + F.col("__before")).cast("long").alias(name)]
    if total:
        out.append(F.col("__all").cast("long").alias(total))
    return joined.select(*out)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def hash_rank(df: DataFrame, seed: int | str, key: str, groups: list[str] | None = None, name: str = "rn", total: str | None = None) -> DataFrame:
    """1-based rank by hash_key, ties by the key: the rank of a seeded shuffle."""
    h = hash_key(seed, key)
    return bucketed_rank(df, F.substring(h, 1, HASH_DIGITS), [h, F.col(key)], groups, name, total)


def key_bucket(df: DataFrame, key: str) -> Column:
    """The bucket of a key: how many of at most 127 cuts are below it; -1 for null. Cuts decide the balance alone.

    Cuts of a number are quantiles that one pass finds. Those of a string are taken from the rows that have the least hashes.
    """
    if isinstance(df.schema[key].dataType, StringType):
        rows = df.where(F.col(key).isNotNull()).select(key)
        held = sorted(r[0] for r in rows.orderBy(F.xxhash64(key)).limit(STRING_SAMPLE).collect())
        cuts, of = sorted({held[len(held) * i // KEY_BUCKETS] for i in range(1, KEY_BUCKETS)} if held else ()), F.col(key)
    else:
        of = F.col(key).cast("double")
        cuts = df.select(F.percentile_approx(of, [i / KEY_BUCKETS for i in range(1, KEY_BUCKETS)], 10_000).alias("q")).first()["q"] or []
    bucket = F.size(F.filter(F.array(*(F.lit(c) for c in sorted(set(cuts)))), lambda c: c < of)) if cuts else F.lit(0)
    return F.when(of.isNull(), -1).otherwise(bucket)


def tied_bucket(df: DataFrame, key: str, tie: str) -> Column:
    """Buckets of (key, tie), both numbers, that rise with their order: a key that is itself a cut, as any frequent one is, has
    a bucket of its own, which is cut by the tie-breaker."""
    cuts_of = lambda c: F.percentile_approx(F.col(c).cast("double"), [i / KEY_BUCKETS for i in range(1, KEY_BUCKETS)], 10_000).alias(c)
    found = df.select(cuts_of(key), cuts_of(tie)).first()
    cuts, ties = (sorted(set(found[c] or [])) for c in (key, tie))
    below = lambda cs, of: F.size(F.filter(F.array(*map(F.lit, cs)), lambda c: c < of)) if cs else F.lit(0)
    of, by = F.col(key).cast("double"), F.col(tie).cast("double")
    own = of.isin(cuts) if cuts else F.lit(False)
    within = F.when(own & by.isNotNull(), below(ties, by) + 1).otherwise(0)
    return F.when(of.isNull(), -1).otherwise((2 * below(cuts, of) + own.cast("int")) * (KEY_BUCKETS + 1) + within)


def row_index(
    df: DataFrame, key: str, groups: list[str] | None = None, name: str = "rn", total: str | None = None, more: list[Column] | None = None, tie: str | None = None
) -> DataFrame:
    """1-based rank by a number or a string (ties by ``more``), cut into buckets of the key. ``tie`` names a number that
    breaks ties instead; then rows of one frequent key are cut as well."""
    if tie:
        return bucketed_rank(df, tied_bucket(df, key, tie), [F.col(key).asc_nulls_first(), F.col(tie).asc_nulls_first()], groups, name, total)
    return bucketed_rank(df, key_bucket(df, key), [F.col(key).asc_nulls_first(), *(more or [])], groups, name, total)


def floor_div(a: Column, b: Column | float) -> Column:
    """Floored division as in Python and Polars; Spark's div truncates."""
    return F.floor(a / b).cast("bigint")
