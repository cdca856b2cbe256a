"""Denoising: corruption plans as expressions, and the masking itself by Arrow batches.

Plans draw from independent hashes of a row's key. Masking walks along a row's tokens with a generator that is seeded
from the same key, so a retried task masks the same tokens.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import script, tokens
from quern.functions.text import utf8_bytes
from quern.operators.ranks import uniform
from quern.operators.sampling import weighted_choice

MODES = {"denoising": 0.4, "denoising_heavy": 0.4, "continuation": 0.2}


def eligible(data_type: Column) -> Column:
    """Whether rows of a kind are corrupted at all."""
    return data_type.isNull() | data_type.isin("denoising", "mixed")


def byte_eligible(text: Column, encoder_max: int, ratio: float, headroom: int = 48) -> Column:
    return F.lit(ratio > 0) & (F.octet_length(text) <= encoder_max - headroom)


def intensity(ratio: Column) -> Column:
    return F.when(ratio < 0.20, "light").when(ratio < 0.40, "medium").otherwise("heavy")


def choose_config(configs: list[tuple[float, float]], *key: Column | str, seed: int | str) -> Column:
    """Struct (lambda, ratio), one of the configurations."""
    own = F.array(*(F.struct(F.lit(float(a)).alias("lambda"), F.lit(float(b)).alias("ratio")) for a, b in configs))
    return F.element_at(own, (F.floor(uniform(seed, *key) * len(configs)) + 1).cast("int"))


def continuation_scale(n: Column, capacity: int) -> Column:
    """Share of the continuation weight that a length keeps."""
    return F.when(n < 0.3 * capacity, 0.0).when(n < 0.6 * capacity, 0.5).when(n < capacity, 1.0).otherwise(0.0)


def choose_mode(n: Column, capacity: int, *key: Column | str, ratios: dict[str, float] | None = None, seed: int | str = 42) -> Column:
    """A mode by weights that move from continuation to the two denoisers for texts that fit badly."""
    ratios = ratios or MODES
    if not ratios.get("continuation"):
        return weighted_choice(ratios, *key, seed=seed)
    cont = ratios["continuation"] * continuation_scale(n, capacity)
    moved = (ratios["continuation"] - cont) / 2
    a, b = ratios.get("denoising", 0.4) + moved, ratios.get("denoising_heavy", 0.4) + moved
    total = sum(ratios.get(m, d) for m, d in MODES.items())
    u = uniform(seed, *key) * total
    return F.when(u < a, "denoising").when(u < a + b, "denoising_heavy").otherwise("continuation")


def training_mode(mode: Column, form: Column, shuffled: Column, transcription: Column) -> Column:
    """The label of a plan: its mode, form, shuffle and transcription, those that it has."""
    return F.concat_ws("_", mode, form, F.when((form == "bart") & shuffled, "shuffled"), F.when(transcription.isNotNull(), F.concat(F.lit("transcription_"), transcription)))


def plan(
    text: Column,
    n_tokens: Column,
    year: Column,
    key: Column | str,
    *,
    encoder_max: int = 512,
    decoder_max: int = 512,
    ratios: dict[str, float] | None = None,
    byte_ratio: float = 0.0,
    temporal_ratio: float = 0.0,
    morpheme_ratio: float = 0.5,
    sentinel_ratio: float = 0.5,
    transcription_ratio: float = 0.0,
    permute: bool = False,
    configs: list[tuple[float, float]] | None = None,
    seed: int = 42,
) -> Column:
    """Struct of every random decision about a row: byte reconstruction first, then temporal continuation, then by length."""
    u = lambda name: uniform(f"{seed}{name}", key)
    base = choose_mode(n_tokens, encoder_max + decoder_max - 4, key, ratios=ratios, seed=f"{seed}mode")
    mode = (
        F.when(byte_eligible(text, encoder_max, byte_ratio) & (u("byte") < byte_ratio), "byte_reconstruction")
        .when(year.isNotNull() & F.lit(temporal_ratio > 0) & (u("temporal") < temporal_ratio), "temporal_continuation")
        .otherwise(base)
    )
    mode = F.when((mode == "denoising") & (u("morpheme") < morpheme_ratio), "morpheme_denoising").otherwise(mode)
    formed = mode.isin("denoising", "denoising_heavy", "morpheme_denoising", "continuation", "byte_reconstruction")
    form = F.when(formed, F.when(u("form") < sentinel_ratio, "sentinel").otherwise("bart"))
    shuffled = mode.isin("denoising", "denoising_heavy") & F.coalesce(form == "bart", F.lit(False)) & F.lit(permute)
    config = F.when(mode == "denoising", choose_config(configs or [(3.0, 0.15), (8.0, 0.3)], key, seed=f"{seed}config"))
    overlay = mode.isin("denoising", "denoising_heavy", "morpheme_denoising") & script.has_hanja(text, bmp_only=True) & (u("overlay") < transcription_ratio)
    transcription = F.when(overlay, F.when(u("way") < 0.5, "hangul_to_hanja").otherwise("hanja_to_hangul"))
    return F.struct(
        F.lit("text").alias("format_name"),
        mode.alias("mode"),
        training_mode(mode, form, shuffled, transcription).alias("training_mode"),
        form.alias("form"),
        shuffled.alias("shuffled"),
        F.when(config.isNotNull(), intensity(config["ratio"])).alias("intensity"),
        config.alias("r_config"),
        transcription.alias("transcription"),
    )


def byte_span(n_bytes: Column) -> Column:
    """Mean span of byte masking by length."""
    return F.when(n_bytes < 200, 3).when(n_bytes < 500, 8).otherwise(64)


def delete_tokens(ids: Column, ratio: float, specials: list[int], *key: Column | str, seed: int | str = 42) -> Column:
    """Drops each token that is no special one with the given chance."""
    marked = F.transform(ids, lambda x, i: F.struct(x.alias("x"), (x.isin(specials) | (uniform(seed, *key, i) >= ratio)).alias("keep")))
    return F.transform(F.filter(marked, lambda z: z["keep"]), lambda z: z["x"])


def temporal_text(text: Column, year: Column) -> Column:
    """A text with its year behind it, for temporal continuation."""
    return F.concat(text, F.lit(" 연도: "), year.cast("string"))


def continuation(ids: Column, encoder_max: int, decoder_max: int, boundary: int, *key: Column | str, sentinel: bool = False, seed: int | str = 42) -> Column:
    """Struct (encoder, decoder): the prefix with the boundary id behind it; the boundary and the continuation."""
    cut = tokens.prefix_split(ids, encoder_max, decoder_max, *key, sentinel=sentinel, seed=seed)
    mark = F.array(F.lit(boundary))
    return F.struct(F.concat(cut["encoder"], mark).alias("encoder"), F.concat(mark, cut["decoder"]).alias("decoder"))


def rng_of(key) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.md5(str(key).encode()).digest()[:8], "little"))


#: Sentinel ids that a vocabulary has; a text has one span less at most.
SENTINELS = 100
#: Chance of a position to begin a span of infilling.
START = 0.15


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def part_ends(total: Column, parts: Column, *key: Column | str, seed: int | str) -> Column:
    """Where each part ends of a sum that is cut into so many positive parts, all ways alike.

    The cuts are a sample of the places between, by R. Floyd's rule: one draw for each cut, whatever the sum.
    """

    def drawn(got: Column, j: Column) -> Column:
        place = lambda t: F.concat(got, F.array(F.when(F.array_contains(got, t), j).otherwise(t)))
        return bound((F.floor(uniform(seed, *key, j) * j) + 1).cast("int"), place)

    cuts = F.aggregate(F.sequence(total - parts + 1, total - 1), F.array().cast("array<int>"), drawn)
    return F.when(parts > 1, F.concat(F.array_sort(cuts), F.array(total))).otherwise(F.array(total))


def sentinel_spans(
    ids: Column, ratio: float, mean: float | Column, mark: Callable[[Column], Column], *key: Column | str, specials: list = (), sentinels: int = SENTINELS, seed: int | str = 42
) -> Column:
    """Struct (encoder, decoder): masked spans as a mark each, and each mark with its span; mark gives that of the k-th span.

    Of the ids that are no special ones the ratio is masked, at least one and at most all but one, in spans of the given
    mean: as many as the mean says, fewer than there are sentinels. Kept and masked parts take turns, a kept one first,
    and each is one of all ways to cut them, by hashes of the key. Special ids stay in the encoder, also within a span,
    which they don't break. Without two ids, or with special ones alone, nothing is masked.
    """
    return bound(ids, lambda own: _spans_of(own, ratio, mean, mark, *key, specials=specials, sentinels=sentinels, seed=seed))


def _spans_of(ids: Column, ratio: float, mean: float | Column, mark: Callable[[Column], Column], *key: Column | str, specials: list, sentinels: int, seed: int | str) -> Column:
    """sentinel_spans of ids that are computed already: they are named once for each span and more."""
    special = lambda x: x.isin(list(specials)) if specials else F.lit(False)
    at = lambda xs, i: F.element_at(xs, i.cast("int"))
    every = F.when(F.size(ids) > 0, F.sequence(F.lit(1), F.size(ids))).otherwise(F.array().cast("array<int>"))
    plain = F.filter(F.transform(ids, lambda x, i: F.when(~special(x), i + 1)), lambda i: i.isNotNull())
    # most texts hold no special id, and need no walk for their places; array_contains is null where an id is
    held = F.lit(False)
    for x in specials:
        held = held | F.coalesce(F.array_contains(ids, F.lit(x)), F.lit(True))
    plain = F.when(held, plain).otherwise(every)
    noise = lambda m: F.greatest(F.lit(1), F.least(F.rint(m * F.lit(ratio)).cast("int"), m - 1))
    spread = mean if isinstance(mean, Column) else F.lit(float(mean))
    spans = lambda m, n: F.greatest(F.lit(1), F.least(F.rint(n / spread).cast("int"), F.lit(sentinels - 1), n, m - n))

    def counted(z: Column) -> Column:
        m = F.size(z["ids"])
        return bound(F.struct(m.alias("m"), noise(m).alias("n")), lambda c: F.struct(z["ids"].alias("ids"), c["m"].alias("m"), c["n"].alias("n"), spans(c["m"], c["n"]).alias("k")))

    def placed(z: Column) -> Column:
        kept, masked = part_ends(z["m"] - z["n"], z["k"], *key, seed=f"{seed}kept"), part_ends(z["n"], z["k"], *key, seed=f"{seed}masked")
        ends = F.struct(z["ids"].alias("ids"), kept.alias("kept"), masked.alias("masked"))

        def one(e: Column, kept_end: Column, j: Column) -> Column:
            before = F.when(j > 0, at(e["masked"], F.greatest(j, F.lit(1)))).otherwise(0)
            return F.struct(at(e["ids"], kept_end + before + 1).alias("first"), at(e["ids"], kept_end + at(e["masked"], j + 1)).alias("last"), j.alias("k"))

        return bound(ends, lambda e: F.transform(e["kept"], lambda kept_end, j: one(e, kept_end, j)))

    def shown(w: Column) -> Column:
        span = lambda s: F.slice(ids, s["first"], s["last"] - s["first"] + 1)
        after = lambda k: F.when(k > 0, at(w, F.greatest(k, F.lit(1)))["last"]).otherwise(0)
        between = lambda s: F.slice(ids, after(s["k"]) + 1, s["first"] - after(s["k"]) - 1)
        within = (lambda s: F.filter(span(s), special)) if specials else (lambda s: F.slice(ids, 1, 0))
        left = F.flatten(F.transform(w, lambda s: F.concat(between(s), F.array(mark(s["k"])), within(s))))
        rest = bound(F.element_at(w, -1)["last"], lambda last: F.slice(ids, last + 1, F.size(ids) - last))
        hidden = (lambda s: F.filter(span(s), lambda x: ~special(x))) if specials else span
        return F.struct(F.concat(left, rest).alias("encoder"), F.flatten(F.transform(w, lambda s: F.concat(F.array(mark(s["k"])), hidden(s)))).alias("decoder"))

    whole = F.struct(ids.alias("encoder"), F.slice(ids, 1, 0).alias("decoder"))
    return bound(F.struct(plain.alias("ids")), lambda p: F.when((F.size(ids) < 2) | (F.size(p["ids"]) == 0), whole).otherwise(bound(counted(p), lambda z: bound(placed(z), shown))))


def sentinel_masking(ratio: float = 0.15, mean: float = 3.0, first_sentinel: int = 100, specials: tuple[int, ...] = (), seed: int = 42):
    """A function of (ids, key) to struct (encoder, decoder), the k-th sentinel being first_sentinel + k."""
    return lambda ids, key: sentinel_spans(ids, ratio, mean, lambda k: k + first_sentinel, key, specials=list(specials), seed=seed)


def morpheme_sentinels(ratio: float = 0.15, mean: float = 3.0, eos: str = "</s>", seed: int = 42):
    """Sentinel masking over morphemes: struct (encoder, decoder) of strings with ``<extra_id_k>`` marks, ends protected."""
    return lambda parts, key: sentinel_spans(parts, ratio, mean, lambda k: F.format_string("<extra_id_%d>", k), key, specials=[eos], seed=seed)


def byte_reconstruction(byte_base: int = 1000, first_sentinel: int = 100, ratio: float = 0.3, encoder_max: int = 512, seed: int = 42):
    """A function of (text, key) to struct (encoder, decoder): a window of the text as bytes with masked spans, and the spans."""
    room = max(1, (encoder_max - 48) // 3)

    def run(text: Column, key: Column) -> Column:
        start = F.when(F.length(text) > room, F.floor(uniform(f"{seed}window", key) * (F.length(text) - room + 1)).cast("int")).otherwise(0)
        ids = utf8_bytes(F.substr(text, start + 1, F.lit(room)), byte_base)
        return bound(ids, lambda x: sentinel_spans(x, ratio, byte_span(F.size(x)), lambda k: k + first_sentinel, key, seed=seed))

    return run


def infill(ids: list, ratio: float, mean: float, mask, protected: set, rng: np.random.Generator, start: float = START) -> list:
    """Text infilling: of the positions in a seeded order some begin a span, of Poisson length, until the budget of the ratio
    is spent. Spans step over protected ids and what is masked already; neighbouring masked ids are one mask."""
    n, budget = len(ids), int(len(ids) * ratio)
    gone, free = np.zeros(n, bool), np.array([x not in protected for x in ids], bool)
    for at in rng.permutation(n).tolist():
        if budget <= 0:
            break
        if gone[at] or not free[at] or rng.random() >= start:
            continue
        span = np.arange(at, min(n, at + max(1, min(int(rng.poisson(mean)), budget))))
        span = span[free[span] & ~gone[span]]
        gone[span] = True
        budget -= len(span)
    out: list = []
    for i, x in enumerate(ids):
        if not gone[i]:
            out.append(x)
        elif i == 0 or not gone[i - 1]:
            out.append(mask)
    return out


def infilling(ratio: float = 0.3, mean: float = 3.0, mask: int = 4, protected: tuple[int, ...] = (0, 1, 2), seed: int = 42):
    """A function of (ids, key) to the ids with masks."""

    @F.pandas_udf("array<int>")
    def run(ids: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series([None if i is None else infill([int(x) for x in i], ratio, mean, mask, set(protected), rng_of(f"{seed}:{k}")) for i, k in zip(ids, key, strict=True)])

    return run


def morpheme_infilling(ratio: float = 0.3, mean: float = 3.0, mask: str = "<mask>", eos: str = "</s>", seed: int = 42):
    """Infilling over morphemes (strings), ends protected."""

    @F.pandas_udf("array<string>")
    def run(parts: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else infill(list(p), ratio, mean, mask, {eos}, rng_of(f"{seed}:{k}")) for p, k in zip(parts, key, strict=True)])

    return run


def _collated(shown: Column, ids: Column, n: int, pad: int, start: int) -> Column:
    labels = tokens.mask_labels(tokens.pad_to(ids, n, pad), pad)
    inputs = tokens.pad_to(shown, n, pad)
    return F.struct(inputs.alias("input_ids"), tokens.attention_mask(inputs, pad).alias("attention_mask"), tokens.shift_right(labels, start, pad).alias("decoder_input_ids"), labels.alias("labels"))


def deletion_collate(ids: Column, key: Column | str, n: int, *, ratio: float = 0.3, specials: tuple[int, ...] = (0, 1, 2), pad: int = 0, start: int = 1, seed: int = 42) -> Column:
    """Struct (input_ids, attention_mask, decoder_input_ids, labels) of n ids: tokens left out of the input, all in the labels."""
    return _collated(delete_tokens(ids, ratio, list(specials), key, seed=seed), ids, n, pad, start)


def infilling_collate(ids: Column, key: Column, n: int, *, ratio: float = 0.3, mean: float = 3.0, mask: int = 4, eos: int = 2, pad: int = 0, start: int = 1, seed: int = 42) -> Column:
    """As deletion_collate, with the sentences in a seeded order and spans of the input masked."""
    moved = F.flatten(tokens.permute(tokens.split_at(ids, eos), key, seed=seed))
    return _collated(infilling(ratio, mean, mask, (pad, start, eos), seed)(moved, key), ids, n, pad, start)


def denoise(ids: Column, key: Column, form: Column, *, ratio: float, mean: float, mask: int, first_sentinel: int, eos: int, permute: bool = False, seed: int = 42) -> Column:
    """Struct (encoder, decoder) by form: sentinels with their spans, or masks with the whole text, its sentences in a
    seeded order if asked."""
    shown = F.flatten(tokens.permute(tokens.split_at(ids, eos), key, seed=seed)) if permute else ids
    marked, whole = sentinel_masking(ratio, mean, first_sentinel, (eos,), seed)(ids, key), infilling(ratio, mean, mask, (eos,), seed)(shown, key)
    return F.struct(F.when(form == "sentinel", marked["encoder"]).otherwise(whole).alias("encoder"), F.when(form == "sentinel", marked["decoder"]).otherwise(ids).alias("decoder"))
