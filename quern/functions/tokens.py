"""Arrays of token ids: assembly, padding, masks, windows and splits; and pluggable tokenizers by Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.ranks import hash_key, uniform

#: A label that carries no loss.
IGNORE = -100
#: Lengths of the buckets.
BUCKETS = (128, 256, 512, 1024, 2048, 4096, 8192)


def pad_to(ids: Column, n: int | Column, fill: int) -> Column:
    """Cut or padded on the right to n."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.slice(F.concat(ids, F.array_repeat(F.lit(fill), n)), F.lit(1), n)


def attention_mask(ids: Column, pad: int) -> Column:
    return F.transform(ids, lambda i: (i != pad).cast("int"))


def shift_right(ids: Column, start: Column | int, pad: int) -> Column:
    """The start id, then all but the last id; ignored labels become padding."""
    start = F.lit(start) if isinstance(start, int) else start
    moved = F.concat(F.array(start), F.slice(ids, F.lit(1), F.greatest(F.size(ids) - 1, F.lit(0))))
    return F.transform(moved, lambda i: F.when(i == IGNORE, pad).otherwise(i))


def mask_labels(ids: Column, pad: int) -> Column:
    return F.transform(ids, lambda i: F.when(i == pad, IGNORE).otherwise(i))


def count_labelled(labels: Column) -> Column:
    return F.size(F.filter(labels, lambda i: i != IGNORE))


def valid_tokens(encoder: Column, decoder: Column, pad: int) -> Column:
    return F.size(F.filter(encoder, lambda i: i != pad)) + F.size(F.filter(decoder, lambda i: i != pad))


def content_tokens(ids: Column, segments: Column, least_id: int = 532) -> Column:
    """Content tokens by segment of a packed row: map from segment to count, padding left out."""
    pairs = F.filter(F.arrays_zip(ids.alias("id"), segments.alias("seg")), lambda z: (z["id"] >= least_id) & (z["seg"] > 0))
    own = F.array_sort(F.array_distinct(F.transform(pairs, lambda z: z["seg"])))
    return F.map_from_arrays(own, F.transform(own, lambda s: F.size(F.filter(pairs, lambda z: z["seg"] == s))))


def long_enough(ids: Column, pad: int, least: int = 20) -> Column:
    return F.size(F.filter(ids, lambda i: i != pad)) >= least


def encoder_ids(text: Column, eos: int, script: Column) -> Column:
    """text, end, script tag."""
    return F.concat(text, F.array(F.lit(eos), script))


def decoder_ids(text: Column, eos: int, script: Column) -> Column:
    """script tag, text, end."""
    return F.concat(F.array(script), text, F.array(F.lit(eos)))


def label_ids(sentences: Column, eos: int, script: Column) -> Column:
    """Sentences, each with its end, then the script tag."""
    return F.concat(F.flatten(F.transform(sentences, lambda s: F.concat(s, F.array(F.lit(eos))))), F.array(script))


def bucket_of(length: Column, sizes: tuple[int, ...] = BUCKETS) -> Column:
    """The first bucket that holds a length, else the last; null and negative lengths count as 0."""
    n = F.when(length >= 0, length).otherwise(0)
    out = F.lit(len(sizes) - 1)
    for i in range(len(sizes) - 2, -1, -1):
        out = F.when(n <= sizes[i], i).otherwise(out)
    return out


def bucket_batch_size(global_batch: int, processes: int, size: int, reference: int = 512, align: int = 8) -> int:
    """A process's batch of a bucket: as many tokens as at the reference length, aligned down, at least the alignment."""
    own = max(1, global_batch // processes) * reference // size
    align = 128 if own >= 128 else align
    return max(align, own // align * align) if own >= align else max(1, own)


def window(ids: Column, n: int, *key: Column | str, seed: int | str = 42) -> Column:
    """n ids from a seeded start; all of them where there are no more."""
    room = F.size(ids) - n
    start = F.floor(uniform(seed, *key) * (room + 1)).cast("int")
    return F.when(room > 0, F.slice(ids, start + 1, n)).otherwise(ids)


def sentence_window(ids: Column, n: int, eos: int, *key: Column | str, seed: int | str = 42) -> Column:
    """n ids from a seeded sentence start (the first id, or one after an end) that leaves n ids, else from the last room."""
    room = F.size(ids) - n
    ends = F.filter(F.transform(ids, lambda x, i: F.when(x == eos, i + 1)), lambda p: p.isNotNull() & (p <= room))
    starts = F.concat(F.array(F.lit(0)), ends)
    at = F.element_at(starts, (F.floor(uniform(seed, *key) * F.size(starts)) + 1).cast("int"))
    return F.when(room > 0, F.slice(ids, at + 1, n)).otherwise(ids)


def edge_window(ids: Column, n: int, *key: Column | str, seed: int | str = 42) -> Column:
    """The start in three draws of ten, the end in three, a middle in four."""
    room = F.size(ids) - n
    u, v = uniform(f"{seed}a", *key), uniform(f"{seed}b", *key)
    start = F.when(u < 0.3, 0).when(u < 0.6, room).otherwise(F.floor(v * (room + 1)).cast("int"))
    return F.when(room > 0, F.slice(ids, start + 1, n)).otherwise(ids)


def cut_at_sentence(ids: Column, n: int, eos: int) -> Column:
    """At most n ids, up to the last end among them; n ids where there is none."""
    ends = F.filter(F.transform(ids, lambda x, i: F.when(x == eos, i + 1)), lambda p: p.isNotNull() & (p <= n))
    return F.when(F.size(ids) <= n, ids).when(F.size(ends) > 0, F.slice(ids, F.lit(1), F.array_max(ends))).otherwise(F.slice(ids, 1, n))


def prefix_split(ids: Column, encoder_max: int, decoder_max: int, *key: Column | str, sentinel: bool = False, seed: int | str = 42) -> Column:
    """Struct (encoder, decoder): nothing and all below ten ids; a cut at 20 to 40 per cent within the capacity; else a
    seeded window whose encoder has 25 to 35 per cent of the capacity."""
    n = F.size(ids)
    capacity = encoder_max + decoder_max - (4 if sentinel else 2)
    u, v = uniform(f"{seed}ratio", *key), uniform(f"{seed}start", *key)
    cut = F.greatest(F.lit(1), F.least(F.floor(n * (0.2 + 0.2 * u)).cast("int"), n - 1))
    enc = F.floor(F.least(F.lit(float(encoder_max)), capacity * (0.25 + 0.1 * u))).cast("int")
    dec = F.least(F.lit(decoder_max), capacity - enc)
    start = F.floor(v * (n - enc - dec + 1)).cast("int")
    both = lambda a, b: F.struct(a.alias("encoder"), b.alias("decoder"))
    short = both(F.slice(ids, F.lit(1), F.greatest(cut, F.lit(0))), F.slice(ids, F.greatest(cut, F.lit(0)) + 1, F.greatest(n - cut, F.lit(0))))
    long = both(F.slice(ids, F.greatest(start, F.lit(0)) + 1, enc), F.slice(ids, F.greatest(start, F.lit(0)) + enc + 1, dec))
    return F.when(n < 10, both(F.slice(ids, 1, 0), ids)).when(n <= capacity, short).otherwise(long)


def split_at(ids: Column, eos: int) -> Column:
    """Segments of an id array, each with its end."""
    n = F.size(ids)
    ends = F.filter(F.transform(ids, lambda x, i: F.when(x == eos, i + 1)), lambda p: p.isNotNull())
    closed = F.coalesce(F.try_element_at(ends, F.lit(-1)) == n, n == 0)
    bounds = F.when(closed, ends).otherwise(F.concat(ends, F.array(n)))
    starts = F.slice(F.concat(F.array(F.lit(0)), bounds), F.lit(1), F.size(bounds))
    return F.zip_with(starts, bounds, lambda a, b: F.slice(ids, a + 1, b - a))


def permute(parts: Column, *key: Column | str, seed: int | str = 42, least: int = 3) -> Column:
    """Parts in a seeded order; fewer than the least stay as they are."""
    keyed = F.transform(parts, lambda p, i: F.struct(hash_key(seed, *key, i).alias("h"), i.alias("i"), p.alias("p")))
    return F.when(F.size(parts) >= least, F.transform(F.array_sort(keyed), lambda z: z["p"])).otherwise(parts)


def empty_row(encoder: int, decoder: int, pad: int) -> Column:
    """Struct (input_ids, attention_mask, decoder_input_ids, labels) of a batch without examples: all padding."""
    fill = lambda x, n: F.array_repeat(F.lit(x), n)
    return F.struct(fill(pad, encoder).alias("input_ids"), fill(0, encoder).alias("attention_mask"), fill(pad, decoder).alias("decoder_input_ids"), fill(IGNORE, decoder).alias("labels"))


def jamo_bucket_table(vocab: DataFrame, token: str, sizes: list[int], transcribe: Callable[[Column], Column] | None = None, align: int = 128, pad: int = 0) -> DataFrame:
    """Rows (token, buckets) of a vocabulary: hashes of the n-grams of each token's transcribed jamo, modulo the number of
    distinct n-grams, plus one; all rows padded to the longest, aligned up. Byte and sentinel pieces have none."""
    from quern.functions import script, text

    rows = vocab.select(token, script.jamo_sentence(transcribe(F.col(token)) if transcribe else F.col(token)).alias("__j"))
    grams = F.when(is_extended(F.col(token)), F.array().cast("array<string>")).otherwise(text.ngrams_of(F.col("__j"), sizes))
    rows = rows.select(token, grams.alias("__g"))
    n = max(1, rows.select(F.explode("__g").alias("g")).distinct().count())
    width = -(-max(1, rows.agg(F.max(F.size("__g"))).first()[0] or 0) // align) * align
    return rows.select(token, pad_to(F.transform("__g", lambda g: (text.fnv1a32(g) % n + 1).cast("int")), width, pad).alias("buckets"))


def until(ids: Column, ends: list[int]) -> Column:
    """Ids before the first of the end ids."""
    hits = F.filter(F.transform(ids, lambda x, i: F.when(x.isin(ends), i)), lambda p: p.isNotNull())
    return F.when(F.size(hits) > 0, F.slice(ids, F.lit(1), F.array_min(hits))).otherwise(ids)


def byte_vocabulary(vocab: DataFrame, sentinels: int = 100, token: str = "token", token_id: str = "token_id") -> DataFrame:
    """A vocabulary with byte and sentinel pieces added behind its largest id, those it has left out."""
    spark = vocab.sparkSession
    made = spark.range(256).select(F.format_string("<0x%02X>", F.col("id")).alias(token), F.col("id").alias("o")).unionByName(
        spark.range(sentinels).select(F.format_string("<extra_id_%d>", F.col("id")).alias(token), (F.col("id") + 256).alias("o"))
    )
    new = made.join(vocab.select(token), token, "left_anti")
    top = vocab.agg(F.max(token_id).alias("__top"))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.orderBy("o"))  # at most 256 + sentinels rows
    added = new.withColumn("__r", rank).crossJoin(F.broadcast(top)).select(token, (F.col("__top") + F.col("__r")).cast("int").alias(token_id))  # one row
    return vocab.select(token, F.col(token_id).cast("int").alias(token_id)).unionByName(added)


def sequence_length(length: Column) -> Column:
    """A length, or 0 where it is missing or negative."""
    return F.when(length >= 0, length).otherwise(0)


def vocabulary_lookup(asked: DataFrame, vocab: DataFrame, unknown: int | str) -> DataFrame:
    """Adds ids of tokens, or tokens of ids, by the column that both have; what is unknown gets the given one."""
    (key,) = set(asked.columns) & {"token", "token_id"}
    value = "token_id" if key == "token" else "token"
    return asked.join(vocab.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(unknown)))


def extended_rows(table: DataFrame, size: int, pad: int = 0) -> DataFrame:
    """A feature table (token_id, features) up to a size: the padding token's row stands for each new token."""
    first = table.agg(F.max("token_id") + 1).scalar()
    new = table.sparkSession.range(size).where(F.col("id") >= first)
    row = table.where(F.col("token_id") == pad).select("features").limit(1).scalar()
    return table.select("token_id", "features").unionByName(new.select(F.col("id").cast(table.schema["token_id"].dataType).alias("token_id"), row.alias("features")))


def is_extended(token: Column) -> Column:
    """Byte and sentinel pieces, which have no subword features."""
    return token.rlike(r"^<(extra_id_\d+|0x[0-9A-Fa-f]{2})>$")


def map_chat_tokens(sentinels: dict[str, int], roles: tuple[str, ...] = ("<|system|>", "<|user|>", "<|assistant|>", "<|end_of_turn|>", "<|think|>"), first: int = 95) -> dict[str, int]:
    """Chat tokens on the sentinels from ``first``; all must exist and differ."""
    names = [f"<extra_id_{first + i}>" for i in range(len(roles))]
    if missing := [n for n in names if n not in sentinels]:
        raise ValueError(f"no such sentinels: {', '.join(missing)}")
    return dict(zip(roles, (sentinels[n] for n in names), strict=True))


def words_tokenizer(buckets: int = 32_000) -> Callable[[str], list[int]]:
    """A tokenizer without a vocabulary file: ids of white-space words by a hash, for tests and length estimates."""
    import zlib

    return lambda text: [3 + zlib.crc32(w.encode()) % buckets for w in text.split()]


def encoder(make: Callable[[], Callable[[str], list[int]]], bos: int | None = None, eos: int | None = None, max_length: int | None = None, vocab_size: int | None = None, unk: int = 0) -> Callable[[Column], Column]:
    """Ids of a text by a tokenizer that each Python worker makes once: unknown ids, ends and a cut that keeps the end."""
    made: list = []

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        if not made:
            made.append(make())

        def one(text):
            ids = [i if vocab_size is None or 0 <= i < vocab_size else unk for i in made[0](text or "")]
            ids = [*([bos] if bos is not None else []), *ids]
            tail = [eos] if eos is not None else []
            return [*ids[: max_length - len(tail)], *tail] if max_length is not None else [*ids, *tail]

        return texts.map(one)

    return run


def decoder(make: Callable[[], Callable[[list[int]], str]], specials: frozenset[int] = frozenset()) -> Callable[[Column], Column]:
    """The text of ids, special ones left out."""
    made: list = []

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        if not made:
            made.append(make())
        return rows.map(lambda ids: None if ids is None else made[0]([int(i) for i in ids if int(i) not in specials]))

    return run


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def byte_spans_to_tokens(ids: pd.Series, first_byte: pd.Series, first_sentinel: pd.Series) -> pd.Series:
    """Runs of byte ids between sentinels as one id per valid code point above the byte range, sentinels kept."""

    def one(row, base, top):
        out, run = [], []

        def flush():
            text = bytes(run).decode("utf-8", "replace")
            out.extend(top + 1000 + ord(c) for c in text)
            run.clear()

        for i in row:
            if base <= i < base + 256:
                run.append(int(i) - int(base))
            else:
                flush()
                out.append(int(i))
        flush()
        return out

    return pd.Series([None if r is None else one(r, b, t) for r, b, t in zip(ids, first_byte, first_sentinel, strict=True)])
