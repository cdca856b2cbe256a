"""Mixing of sources: the token-deficit choice, round robins, epochs, phases, cooldown and resumption."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.ranks import hash_key, row_index
from quern.operators.relational import row_running


def choose_source(targets: dict[str, float], tokens: dict[str, int], left: dict[str, int], draw: float) -> str:
    """The source with rows left whose share of tokens is furthest below its target; where none is by 0.01, a weighted draw."""
    names = [s for s in targets if left.get(s, 0) > 0]
    total = sum(tokens.values())
    deficit = {s: targets[s] - (tokens.get(s, 0) / total if total else 0.0) for s in names}
    best = max(names, key=lambda s: deficit[s])
    if deficit[best] >= 0.01:
        return best
    mass, at = sum(targets[s] for s in names), 0.0
    for s in names:
        at += targets[s] / mass if mass else 1 / len(names)
        if draw < at:
            return s
    return names[-1]


def mix(df: DataFrame, targets: dict[str, float], key: str, source: str = "source", tokens: str = "n_tokens", lane: str = "lane", seed: int = 42) -> DataFrame:
    """Rows (lane, key, source, tokens, order): the order in which a lane's mixer yields its rows.

    The choice is sequential by nature, so a lane (a host of a training run) is one stream of ids and token counts; payloads
    are joined back by key. Rows of a source come in key order; rows of sources without a target are left out. Rows reach
    the mixer by when they are due, their source's tokens so far over its target, so it holds the few that came too early.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in (lane, key, source, tokens)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        own, out = object(), []
        for batch in batches:
            for at, k, s, n, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != own:
                    own, i, want = at, 0, None
                    queues, left, used = {}, {}, {}
                if place == 0:  # ahead of all rows of the lane: how many a source has
                    queues[s], left[s], used[s] = deque(), n, 0
                    continue
                queues[s].append((k, n))
                while any(left.values()):
                    if want is None:
                        want = choose_source(targets, used, left, int(hashlib.md5(f"{seed}:{own}:{i}".encode()).hexdigest()[:8], 16) / 2**32)
                    if not queues[want]:
                        break
                    k, n = queues[want].popleft()
                    left[want], used[want] = left[want] - 1, used[want] + int(n)
                    out.append((own, k, want, n, i))
                    i, want = i + 1, None
            types = [batch.schema.field(c).type for c in range(4)] + [pa.int64()]
            columns = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [lane, key, source, tokens, "order"])
            out = []

    light = df.select(lane, key, source, tokens).where(F.col(source).isin(list(targets)))
    goal = F.create_map(*(F.lit(x) for s, t in targets.items() for x in (s, float(t))))[F.col(source)]
    due = F.when(goal > 0, F.col("__sum") / goal).otherwise(F.lit(float("inf")))
    rows = row_running(row_index(light, key, [lane, source], "__at"), key, tokens, "__sum", [lane, source])
    rows = rows.select(lane, key, source, tokens, "__at", due.alias("__due"))
    heads = light.groupBy(lane, source).agg(F.count("*").cast(kinds[tokens]).alias(tokens))
    heads = heads.select(lane, F.lit(None).cast(kinds[key]).alias(key), source, tokens, F.lit(0).cast("long").alias("__at"), F.lit(-1.0).alias("__due"))
    order = heads.unionByName(rows).repartition(lane).sortWithinPartitions(lane, "__due", source, "__at").drop("__due")
    return order.mapInArrow(run, f"`{lane}` {kinds[lane]}, `{key}` {kinds[key]}, `{source}` {kinds[source]}, `{tokens}` {kinds[tokens]}, order long")


def round_robin(df: DataFrame, key: str, source: str = "source", name: str = "turn") -> DataFrame:
    """Adds the turn of each row within its source; sorting by (turn, source) is a round robin."""
    return row_index(df, key, [source], name)


def epochs(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n copies of the rows with ``epoch`` and the hash that orders each copy anew."""
    return df.crossJoin(F.broadcast(df.sparkSession.range(n).select(F.col("id").cast("int").alias("epoch")))).withColumn("shuffle_key", hash_key(seed, "epoch", key))  # n rows


def by_phase(df: DataFrame, phases: DataFrame, step: str) -> DataFrame:
    """The ratio of a row's source in the phase its step falls in; sources that a phase leaves out are marked stale.

    phases has (phase, from_step, source, ratio), a few rows.
    """
    starts = phases.select("phase", "from_step").distinct()
    last = F.max_by("phase", "from_step").alias("phase")
    steps = df.select(step).distinct().join(F.broadcast(starts), F.col(step) >= F.col("from_step")).groupBy(step).agg(last)
    total = Window.partitionBy("phase")
    own = phases.withColumn("ratio", F.col("ratio") / F.sum("ratio").over(total)).select("phase", "source", "ratio")
    return df.join(steps, step).join(F.broadcast(own), ["phase", "source"], "left").withColumn("stale", F.col("ratio").isNull())


def cooldown(df: DataFrame, tokens: str, key: str, max_tokens: int, ratio: float) -> DataFrame:
    """Adds tokens_seen and whether the cooldown has begun: from (1 - ratio) of all tokens on."""
    out = row_running(df, key, tokens, "tokens_seen")
    return out.withColumn("in_cooldown", F.col("tokens_seen") >= (1 - ratio) * max_tokens)


def milestones(df: DataFrame, tokens: str, key: str, every: int) -> DataFrame:
    """Rows at which the running sum of tokens passes a multiple of ``every``, with the number of the multiple."""
    out = row_running(df, key, tokens, "tokens_seen")
    now, before = F.floor(F.col("tokens_seen") / every), F.floor((F.col("tokens_seen") - F.col(tokens)) / every)
    return out.where(now > before).withColumn("milestone", now)


def resume(df: DataFrame, consumed: DataFrame, key: str, source: str = "source") -> DataFrame:
    """Rows behind the first ``consumed`` raw rows of each source in key order."""
    ranked = row_index(df, key, [source], "__rn").join(consumed.select(source, F.col("consumed").alias("__c")), source, "left")
    return ranked.where(F.col("__rn") > F.coalesce("__c", F.lit(0))).select(*df.columns)


def state(df: DataFrame, source: str = "source") -> DataFrame:
    """Rows and tokens by source, to resume from."""
    return df.groupBy(source).agg(F.count("*").alias("consumed"), F.sum("n_tokens").alias("tokens"))


def reset(counts: DataFrame) -> DataFrame:
    """A state with the same sources and nothing consumed."""
    return counts.withColumns({c: F.lit(0).cast("long") for c in ("consumed", "tokens")})


def unseen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return df.join(seen.select(key).distinct(), key, "left_anti")


def token_shares(df: DataFrame, by: list[str], tokens: str = "n_tokens") -> DataFrame:
    """Tokens and rows of each group and their share of all."""
    sums = df.groupBy(*by).agg(F.sum(tokens).alias("tokens"), F.count("*").alias("n"))
    return sums.withColumn("share", F.col("tokens") / sums.agg(F.sum("tokens")).scalar())


def interleaved(frames: list[DataFrame], order: list[str]) -> DataFrame:
    """Rows of several frames, missing columns null, in a given order."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.orderBy(*order)


def batches_of(rows: Iterator, n: int) -> Iterator[list]:
    """Lists of n items; the rest is the last."""
    held: list = []
    for r in rows:
        held.append(r)
        if len(held) == n:
            yield held
            held = []
    if held:
        yield held
