"""Slices per host, budgets, seeded samples, splits and source mixtures.

Every draw is a rank by a hash of the seed and the row's key, so results repeat and don't depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.ranks import hash_rank, row_index, uniform

#: GB of each training mode, and the most of one host.
MODE_GB = {"full": 320.0, "sweep": 10.0, "debug": 1.0}
HOST_GB = 30.0


def host_slices(df: DataFrame, hosts: int, key: str, groups: list[str] | None = None) -> DataFrame:
    """Adds ``host``: contiguous slices of equal size in key order (within groups); the last host takes the remainder."""
    ranked = row_index(df, key, groups, "__rn", "__n")
    size = F.floor(F.col("__n") / hosts)
    host = F.when(size == 0, F.lit(hosts - 1)).otherwise(F.least(F.floor((F.col("__rn") - 1) / F.greatest(size, F.lit(1))), F.lit(hosts - 1)))
    return ranked.withColumn("host", host.cast("int")).drop("__rn", "__n")


def host_budget_gb(hosts: int, mode: str = "full", cap_gb: float = HOST_GB) -> float:
    """GB of one host: its share of the mode's total, at most the cap."""
    if mode not in MODE_GB:
        raise ValueError(f"unknown mode {mode}; known: {', '.join(MODE_GB)}")
    return min(MODE_GB[mode] / hosts, cap_gb)


def source_budgets(weights: DataFrame, budget: float, weight: str = "weight") -> DataFrame:
    """Adds ``budget``: shares by weight, normalised where the weights' sum is off 1 by more than 0.01."""
    total = weights.agg(F.sum(weight).alias("__t"))
    share = F.when(F.abs(F.col("__t") - 1) > 0.01, F.col(weight) / F.col("__t")).otherwise(F.col(weight))
    return weights.crossJoin(F.broadcast(total)).withColumn("budget", share * budget).drop("__t")  # one row of totals


def truncate_to_bytes(df: DataFrame, budget_bytes: int, text: str, key: str, seed: int = 42) -> DataFrame:
    """A seeded sample of int(rows * budget / bytes) rows where the texts' bytes exceed the budget."""
    size = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).first()
    if size["b"] <= budget_bytes:
        return df
    return sample_n(df, int(size["n"] * budget_bytes / size["b"]), key, seed)


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows without replacement."""
    return hash_rank(df, seed, key, name="__rn").where(F.col("__rn") <= n).drop("__rn")


def sample_eval(df: DataFrame, n: int | None, key: str, seed: int = 42) -> DataFrame:
    """At most n rows; all of them where n is null."""
    return df if n is None else sample_n(df, n, key, seed)


def cap_per_group(df: DataFrame, n: int, group: str, key: str, seed: int = 42) -> DataFrame:
    """A seeded cap of n rows for each group."""
    return hash_rank(df, seed, key, [group], "__rn").where(F.col("__rn") <= n).drop("__rn")


def stratified_sample(df: DataFrame, target: int, key: str, group: str | None = None, seed: int = 42) -> DataFrame:
    """max(1, int(size * target / total)) rows of each group; all rows where there are no more than target."""
    n = df.count()
    if n <= target:
        return df
    if group is None:
        return sample_n(df, target, key, seed)
    quota = F.greatest(F.lit(1), F.floor(F.col("__n") * F.lit(target) / F.lit(n)))
    return hash_rank(df, seed, key, [group], "__rn", "__n").where(F.col("__rn") <= quota).drop("__rn", "__n")


def epoch_sample(df: DataFrame, seen: DataFrame, target: int, key: str, group: str, epoch: int, buffer: float = 1.1) -> DataFrame:
    """Rows of an epoch by the sources' original shares with a buffer, without those seen; if a source has too few left,
    all of them start anew."""
    quota = df.groupBy(group).agg(F.count("*").alias("__all")).crossJoin(F.broadcast(df.agg(F.count("*").alias("__total"))))  # one row
    quota = quota.select(group, F.ceil(F.lit(target * buffer) * F.col("__all") / F.col("__total")).alias("__quota"))
    left = df.join(seen.select(key).distinct(), key, "left_anti")
    have = left.groupBy(group).agg(F.count("*").alias("__have"))
    short = quota.join(have, group, "left").where(F.coalesce("__have", F.lit(0)) < F.least(F.col("__quota"), F.lit(target)))
    pool = df if not short.isEmpty() else left
    ranked = hash_rank(pool, f"epoch{epoch}", key, [group], "__rn")
    return ranked.join(quota, group).where(F.col("__rn") <= F.col("__quota")).select(*df.columns)


def weighted_choice(options: dict[str, float], *key: Column | str, seed: int | str = 42) -> Column:
    """One option by its weight: inverse cumulative shares of a hash in [0, 1)."""
    total = sum(options.values())
    if total <= 0:
        raise ValueError("the weights must have a positive sum")
    u, at, out = uniform(seed, *key), 0.0, None
    names = list(options)
    for name in names[:-1]:
        at += options[name] / total
        out = F.when(u < at, name) if out is None else out.when(u < at, name)
    return out.otherwise(names[-1]) if out is not None else F.lit(names[-1])


def train_eval_split(df: DataFrame, ratio: float, key: str, seed: int = 42) -> DataFrame:
    """Adds ``split``: the first ceil(ratio * rows) of the seeded order are eval."""
    ranked = hash_rank(df, seed, key, name="__rn", total="__n")
    return ranked.withColumn("split", F.when(F.col("__rn") <= F.ceil(F.lit(ratio) * F.col("__n")), "eval").otherwise("train")).drop("__rn", "__n")


def largest_remainder(sizes: DataFrame, fractions: list[tuple[str, float]], n: str, by: list[str]) -> DataFrame:
    """Rows (by, part, position, quota): whole shares of n that sum to it; what is left goes to the largest fractions,
    ties to the earlier part."""
    parts = F.explode(F.array(*(F.struct(F.lit(i).alias("position"), F.lit(p).alias("part"), F.lit(f).alias("f")) for i, (p, f) in enumerate(fractions))))
    raw = sizes.select(*by, n, parts.alias("p")).select(*by, n, "p.*").withColumn("raw", F.col(n) * F.col("f"))
    raw = raw.withColumn("base", F.floor("raw").cast("long"))
    own = Window.partitionBy(*by)
    raw = raw.withColumn("rest", F.col(n) - F.sum("base").over(own))
    rank = F.row_number().over(own.orderBy(F.desc(F.col("raw") - F.col("base")), "position"))
    return raw.withColumn("quota", F.col("base") + (rank <= F.col("rest")).cast("long")).select(*by, "part", "position", "quota")


def quota_split(df: DataFrame, targets: dict[str, int], key: str, bucket: str, seed: int = 42, fractions: dict[str, float] | None = None) -> DataFrame:
    """Adds ``split`` to the rows that fit the quotas of their bucket: fixed targets, or for a bucket that is too small
    shares by largest remainder. Rows of a bucket are in the order of the seed plus the bucket."""
    total = sum(targets.values())
    share = fractions or {p: t / total for p, t in targets.items()}
    sizes = df.groupBy(bucket).agg(F.count("*").alias("__n"))
    small = largest_remainder(sizes.where(F.col("__n") < total), list(share.items()), "__n", [bucket])
    parts = F.explode(F.array(*(F.struct(F.lit(p).alias("part"), F.lit(i).alias("position"), F.lit(int(t)).cast("long").alias("quota")) for i, (p, t) in enumerate(targets.items()))))
    large = sizes.where(F.col("__n") >= total).select(bucket, parts.alias("p")).select(bucket, "p.*")
    ends = small.unionByName(large).withColumn("upper", F.sum("quota").over(Window.partitionBy(bucket).orderBy("position")))
    ends = ends.groupBy(bucket).agg(F.sort_array(F.collect_list(F.struct("position", "part", "upper"))).alias("__ends"))  # a few per bucket
    seeded = df.withColumn("__key", F.concat_ws(":", (F.lit(seed) + F.col(bucket)).cast("string"), F.col(key).cast("string")))
    ranked = hash_rank(seeded, "split", "__key", [bucket], "__rn")
    joined = ranked.join(ends, bucket)
    return joined.withColumn("split", F.try_element_at(F.transform(F.filter("__ends", lambda e: F.col("__rn") <= e["upper"]), lambda e: e["part"]), F.lit(1))).where("split is not null").select(*df.columns, "split")


def mixture(sizes: DataFrame, strategy: str, size: str = "n", weight: str = "weight", temperature: float = 2.0, cap: int | None = None, cap_multiplier: float | None = None) -> DataFrame:
    """Adds ``ratio``: manual weights, sizes to the power 1/T, or sizes capped at K, each over its sum.

    K is given, or a multiple of the smallest size (rounded half to even, at least 1).
    """
    if strategy == "manual":
        mass = F.col(weight).cast("double")
    elif strategy == "temperature":
        if temperature <= 0:
            raise ValueError("the temperature must be positive")
        mass = F.pow(F.col(size).cast("double"), F.lit(1.0 / temperature))
    elif strategy == "capped":
        if (cap is None) == (cap_multiplier is None):
            raise ValueError("give either a cap or a multiplier of the smallest size")
        if cap is None:
            least = sizes.agg(F.greatest(F.lit(1.0), F.bround(F.min(size) * F.lit(float(cap_multiplier)), 0)).alias("__cap"))
            sizes = sizes.crossJoin(F.broadcast(least))  # one row
            mass = F.least(F.col(size).cast("double"), F.col("__cap"))
        else:
            mass = F.least(F.col(size).cast("double"), F.lit(float(cap)))
    else:
        raise ValueError(f"unknown strategy {strategy}")
    massed = sizes.withColumn("__mass", mass)
    total = massed.agg(F.sum("__mass").alias("__total"))
    out = massed.crossJoin(F.broadcast(total))  # one row
    checked = F.when(F.col("__total") > 0, F.col("__mass") / F.col("__total")).otherwise(F.raise_error(F.lit("the weights must have a positive sum")).cast("double"))
    return out.withColumn("ratio", checked).drop("__mass", "__total", "__cap")


def heavy_light(sizes: DataFrame, heavy: float = 0.18, ratio: str = "ratio", kind: str = "data_type", name: str = "name") -> DataFrame:
    """Rows (name, ratio): the weight of denoising and mixed sources goes to two sub-sources, the others keep theirs."""
    pooled = F.col(kind).isin("denoising", "mixed")
    own = sizes.where(~pooled).select(name, F.col(ratio).alias("ratio"))
    pool = sizes.where(pooled).agg(F.sum(ratio).alias("__r"))
    two = pool.select(F.explode(F.array(F.struct(F.lit("hanja_heavy").alias(name), F.lit(heavy).alias("f")), F.struct(F.lit("hanja_light").alias(name), F.lit(1 - heavy).alias("f")))).alias("p"), "__r")
    return own.unionByName(two.where("__r is not null").select(F.col(f"p.{name}").alias(name), (F.col("p.f") * F.col("__r")).alias("ratio")))


def renormalised(df: DataFrame, ratio: str = "ratio") -> DataFrame:
    """Divides ratios by their sum where it is off 1 by more than 0.01."""
    total = df.agg(F.sum(ratio).alias("__t"))
    return df.crossJoin(F.broadcast(total)).withColumn(ratio, F.when(F.abs(F.col("__t") - 1) > 0.01, F.col(ratio) / F.col("__t")).otherwise(F.col(ratio))).drop("__t")  # one row
