"""Packing of variable-length examples and the arithmetic of batches.

Packs are made within a buffer of bounded size, so a group of any size is many buffers, each its own task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.tokens import pad_to
from quern.operators.ranks import row_index


def laned(df: DataFrame, key: str, rows: int, name: str = "lane") -> DataFrame:
    """Adds a lane, a hash of the key among as many lanes as hold so many rows each; a sequential step runs within a lane,
    so it is as many tasks as the input asks for, and none holds a whole group."""
    lanes = max(1, -(-df.count() // rows))
    return df.withColumn(name, F.pmod(F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")), F.lit(lanes)))


def buffer_ids(df: DataFrame, size: int, key: str, groups: list[str], name: str = "buffer_id") -> DataFrame:
    """Adds the buffer of each row: runs of ``size`` rows of a group in key order."""
    return row_index(df, key, groups, "__rn").withColumn(name, F.floor((F.col("__rn") - 1) / size).cast("bigint")).drop("__rn")


def next_fit(lengths: list[int], limit: int, threshold: float) -> tuple[list[list[int]], list[int]]:
    """Packs (positions) and the ones that stand alone, longest first with one open pack.

    Where a document doesn't fit, a pack that is full enough is closed and the document opens the next; otherwise the
    pack is closed and the document stands alone.
    """
    packs, alone, open_pack, used = [], [], [], 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = min(lengths[i], limit)
        if open_pack and used + n > limit:
            full = used / limit >= threshold
            packs.append(open_pack)
            open_pack, used = [], 0
            if not full:
                alone.append(i)
                continue
        open_pack.append(i)
        used += n
    if open_pack:
        packs.append(open_pack)
    return packs, alone


def pack_documents(df: DataFrame, length: str, key: str, groups: list[str], limit: int = 2048, threshold: float = 0.8) -> DataFrame:
    """Rows (groups, key, pack, position, used, alone): a pack number within the group for each document.

    Groups hold one buffer each, so a pandas frame is bounded by the buffer's rows.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(key, kind="stable").reset_index(drop=True)
        lengths = frame[length].astype(int).tolist()
        packs, alone = next_fit(lengths, limit, threshold)
        rows = []
        for p, members in enumerate([*packs, *([i] for i in alone)]):
            for at, i in enumerate(members):
                rows.append((i, p, at, min(lengths[i], limit), p >= len(packs)))
        found = pd.DataFrame(rows, columns=["i", "pack", "position", "used", "alone"]).set_index("i")
        return frame[[*groups, key]].join(found)[[*groups, key, "pack", "position", "used", "alone"]]

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [*groups, key])
    return df.select(*groups, key, length).groupBy(*groups).applyInPandas(run, f"{fields}, pack int, position int, used int, alone boolean")


def pack_with_leftovers(df: DataFrame, length: str, key: str, groups: list[str], buffer: str, limit: int = 2048, threshold: float = 0.8, max_recycles: int = 2) -> DataFrame:
    """As pack_documents over a group's buffers in order: a document below half the limit that doesn't fit goes into the
    next buffer, at most max_recycles times.

    A group's buffers are streamed through one task in order and never held together; lanes (a hash of the key among the
    groups) split a hot group.
    """
    order = [*groups, buffer, key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, current, carried, held, pack_no = None, None, [], [], 0

        def solve(last: bool):
            nonlocal carried, held, pack_no
            docs, carried, rows = [*carried, *held], [], []
            held = []
            open_pack, used = [], 0

            def close(members, alone=False):
                nonlocal pack_no
                for at, d in enumerate(members):
                    rows.append((*group, d[0], pack_no, at, min(d[1], limit), d[2], alone))
                pack_no += 1

            for d in sorted(docs, key=lambda d: -d[1]):
                n = min(d[1], limit)
                if open_pack and used + n > limit:
                    full = used / limit >= threshold
                    close(open_pack)
                    open_pack, used = [], 0
                    if not full:
                        if not last and n < limit // 2 and d[2] < max_recycles:
                            carried.append((d[0], d[1], d[2] + 1))
                        else:
                            close([d], alone=True)
                        continue
                open_pack.append(d)
                used += n
            if open_pack:
                close(open_pack)
            return pd.DataFrame(rows, columns=[*groups, key, "pack", "position", "used", "recycles", "alone"])

        for frame in frames:
            for row in frame[[*groups, buffer, key, length]].itertuples(index=False, name=None):
                own, b = row[: len(groups)], row[len(groups)]
                if group is not None and (own != group or b != current):
                    yield solve(last=own != group)
                    if own != group:
                        if carried:
                            yield solve(last=True)
                        pack_no = 0
                group, current = own, b
                held.append((row[-2], int(row[-1]), 0))
        if group is not None:
            yield solve(last=True)

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [*groups, key])
    dealt = df.select(*order, length).repartition(*groups).sortWithinPartitions(*order)
    return dealt.mapInPandas(run, f"{fields}, pack int, position int, used int, recycles int, alone boolean")


def malformed(ids: Column, decoder_ids: Column) -> Column:
    """Whether an example has no ids on a side."""
    return (F.coalesce(F.size(ids), F.lit(-1)) < 1) | (F.coalesce(F.size(decoder_ids), F.lit(-1)) < 1)


def truncated(df: DataFrame, columns: list[str], limit: int) -> DataFrame:
    """Id arrays cut to a pack's length."""
    return df.withColumns({c: F.slice(c, 1, limit) for c in columns})


def standalone(df: DataFrame, ids: str, decoder_ids: str, limit: int, pad: int = 0) -> DataFrame:
    """Rows outside any pack: both sides cut and padded to limit, one segment, positions from 1. Malformed rows are left
    out; count them with ``malformed``."""
    kept = df.where(~malformed(F.col(ids), F.col(decoder_ids)))
    ones = lambda c: pad_to(F.transform(c, lambda x: F.lit(1)), limit, 0)
    places = lambda c: pad_to(F.transform(c, lambda x, i: i + 1), limit, 0)
    made = {"input_ids": pad_to(F.col(ids), limit, pad), "decoder_input_ids": pad_to(F.col(decoder_ids), limit, pad), "segment_ids": ones(ids), "decoder_segment_ids": ones(decoder_ids), "position_ids": places(ids), "decoder_position_ids": places(decoder_ids)}
    return kept.select(*(c for c in df.columns if c not in (ids, decoder_ids)), *(v.alias(k) for k, v in made.items()))


def packed_batch(df: DataFrame, ids: str, decoder_ids: str, key: str, groups: list[str], limit: int = 2048, threshold: float = 0.8, pad: int = 0) -> DataFrame:
    """The whole way from unpadded ids to packs: malformed rows left out, both sides cut to limit, packed by the longer
    side within each group (a buffer), and laid out as arrays; rows (groups, pack, n_docs, arrays)."""
    cut = lambda c: F.slice(c, 1, limit)
    rows = df.where(~malformed(F.col(ids), F.col(decoder_ids))).select(*groups, key, cut(ids).alias("__e"), cut(decoder_ids).alias("__d"))
    sized = rows.withColumn("__n", F.greatest(F.size("__e"), F.size("__d")))
    packs = pack_documents(sized, "__n", key, groups, limit, threshold).select(key, *groups, "pack", "position")
    return packed_arrays(packs.join(rows, [*groups, key]), [*groups, "pack"], "__e", "__d", limit, pad)


def packed_arrays(packs: DataFrame, groups: list[str], ids: str, decoder_ids: str, limit: int, pad: int = 0) -> DataFrame:
    """Rows of a pack: ids, segments and positions of both sides, each document padded to its longer side, all to limit."""
    n = F.greatest(F.size(ids), F.size(decoder_ids))
    doc = F.struct("position", n.alias("n"), F.col(ids).alias("e"), F.col(decoder_ids).alias("d"))
    rows = packs.groupBy(*groups).agg(F.array_sort(F.collect_list(doc)).alias("docs"))  # a pack holds at most limit tokens

    def side(name, fill):
        return F.flatten(F.transform("docs", lambda d: pad_to(d[name], d["n"], fill)))

    def segments(name):
        return F.flatten(F.transform("docs", lambda d, i: F.concat(F.array_repeat(i + 1, F.size(d[name])), F.array_repeat(F.lit(0), d["n"] - F.size(d[name])))))

    def positions(name):
        seq = lambda d: F.when(F.size(d[name]) > 0, F.sequence(F.lit(1), F.size(d[name]))).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform("docs", lambda d: F.concat(seq(d), F.array_repeat(F.lit(0), d["n"] - F.size(d[name])))))

    made = {"input_ids": side("e", pad), "decoder_input_ids": side("d", pad), "segment_ids": segments("e"), "decoder_segment_ids": segments("d"), "position_ids": positions("e"), "decoder_position_ids": positions("d")}
    return rows.select(*groups, F.size("docs").alias("n_docs"), *(pad_to(v, limit, pad if "input" in k else 0).alias(k) for k, v in made.items()))


def attention_pairs(rows: DataFrame, row: str, segments: str, causal: bool = False) -> DataFrame:
    """Pairs (row, i, j) that may attend: equal segments, no padding; for checks, as masks grow with the square of a row."""
    cells = rows.select(row, F.posexplode(segments).alias("i", "seg")).where("seg > 0")
    other = cells.select(row, F.col("i").alias("j"), "seg")
    pairs = cells.join(other, [row, "seg"])
    return (pairs.where("j <= i") if causal else pairs).select(row, "i", "j")


def packing_stats(packs: DataFrame, limit: int) -> DataFrame:
    """One row: documents, packs, documents a pack and share of the packs' room that is used."""
    return packs.agg(F.sum("n_docs").alias("docs"), F.count("*").alias("packs"), (F.sum("n_docs") / F.count("*")).alias("docs_per_pack"), (F.sum("n_tokens") / (F.count("*") * limit)).alias("efficiency"))


def batches(df: DataFrame, size: int, key: str, drop_last: bool = True, name: str = "batch_id") -> DataFrame:
    """Adds the batch of each row in key order; rows of an incomplete last batch go, if asked."""
    out = row_index(df, key, None, "__rn", "__n").withColumn(name, F.floor((F.col("__rn") - 1) / size).cast("bigint"))
    kept = out.where(F.col("__rn") <= F.floor(F.col("__n") / size) * size) if drop_last else out
    return kept.drop("__rn", "__n")


def even_batches(df: DataFrame, size: int, key: str, name: str = "batch_id") -> DataFrame:
    """ceil(n / size) batches whose sizes differ by one at most, the larger ones first."""
    out = row_index(df, key, None, "__rn", "__n")
    k = F.ceil(F.col("__n") / size)
    base, more, i = F.floor(F.col("__n") / k), F.col("__n") % k, F.col("__rn") - 1
    edge = more * (base + 1)
    return out.withColumn(name, F.when(i < edge, F.floor(i / (base + 1))).otherwise(more + F.floor((i - edge) / base)).cast("bigint")).drop("__rn", "__n")


def pad_batches(df: DataFrame, multiple: int, batch: str, key: str) -> DataFrame:
    """Repeats a batch's first row until its size is a multiple; adds ``is_pad``."""
    sizes = df.groupBy(batch).agg(F.count("*").alias("__n"), F.min(key).alias(key))
    missing = sizes.select(batch, key, F.explode(F.sequence(F.lit(1), F.lit(multiple))).alias("__k"), "__n").where((F.pmod(-F.col("__n"), F.lit(multiple))) >= F.col("__k"))
    more = df.join(missing.select(batch, key), [batch, key]).select(*df.columns, F.lit(True).alias("is_pad"))
    return df.withColumn("is_pad", F.lit(False)).unionByName(more)


def micro_batches(df: DataFrame, group: int, n_batches: Column | int, batch: str = "batch_id", name: str = "step") -> DataFrame:
    """Adds the step of each batch, groups of ``group`` batches; batches of an incomplete last group go."""
    n = F.lit(n_batches) if isinstance(n_batches, int) else n_batches
    return df.withColumn(name, F.floor(F.col(batch) / group)).where(F.col(batch) < F.floor(n / group) * group)


def bucketed_batches(df: DataFrame, bucket: str, size: int, key: str, epoch: int = 0, resume_after: int = -1) -> DataFrame:
    """Rows of complete batches within length buckets, with ``bucket_rank`` (by rows, turned round in odd epochs),
    ``batch_in_bucket`` and ``batch_id`` in stream order; batches up to resume_after are left out."""
    from pyspark.sql import Window

    sizes = df.groupBy(bucket).agg(F.count("*").alias("__n"))  # a row per bucket
    way = F.col("__n").asc() if epoch % 2 else F.col("__n").desc()
    ordered = Window.orderBy(way, bucket)
    ranked = sizes.withColumn("bucket_rank", F.row_number().over(ordered) - 1)
    full = F.floor(F.col("__n") / size)
    ranked = ranked.withColumn("__before", F.coalesce(F.sum(full).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("__full", full)
    rows = row_index(df, key, [bucket], "__rn").join(ranked, bucket)
    rows = rows.withColumn("batch_in_bucket", F.floor((F.col("__rn") - 1) / size)).where("batch_in_bucket < __full")
    rows = rows.withColumn("batch_id", (F.col("__before") + F.col("batch_in_bucket")).cast("bigint")).where(F.col("batch_id") > resume_after)
    return rows.select(*df.columns, F.col("bucket_rank").cast("int"), F.col("batch_in_bucket").cast("bigint"), "batch_id")
