"""Task routing, prompts, chat strings and the expansion of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.tokens import decoder_ids, encoder_ids, pad_to
from quern.functions.text import first_text, pair_text, score_text
from quern.operators.ranks import hash_key, uniform

SYSTEM, USER, ASSISTANT, END, THINK = "<|system|>", "<|user|>", "<|assistant|>", "<|end_of_turn|>", "<|think|>"
HANDLERS = (
    "unsupervised_pretraining", "ocr_correction", "temporal_classification", "temporal_continuation", "sts", "transcription",
    "topic_classification", "nli", "multiple_choice", "instruction", "summarization", "cot",
)


def _has(df: DataFrame, name: str) -> Column:
    return F.col(name).isNotNull() if name in df.columns else F.lit(False)


def task_type(df: DataFrame) -> Column:
    """The handler of a row: its own mark, its kind unless mixed, its structure, else pre-training."""
    named = F.coalesce(*(([F.col("task_type")] if "task_type" in df.columns else []) + ([F.when(F.col("data_type") != "mixed", F.col("data_type"))] if "data_type" in df.columns else []) + [F.lit(None).cast("string")]))
    return (
        F.when(named.isin("denoising", "continuation", "morpheme_denoising"), "unsupervised_pretraining")
        .when(named.isNotNull() & (named != ""), named)
        .when(_has(df, "corrected"), "ocr_correction")
        .when(_has(df, "sentence1") & _has(df, "sentence2"), "sts")
        .when(_has(df, "transcribed"), "transcription")
        .otherwise("unsupervised_pretraining")
    )


def routed(df: DataFrame) -> DataFrame:
    """Adds ``handler``; a task that has none is an error."""
    kind = task_type(df)
    unknown = F.raise_error(F.concat(F.lit("no handler for task "), kind)).cast("string")
    return df.withColumn("handler", F.when(kind.isin(*HANDLERS), kind).otherwise(unknown))


def supervised(df: DataFrame) -> DataFrame:
    """Rows (handler, prompt, input, label, thinking) of routed rows, by handler; columns that are missing count as null."""
    c = lambda n: F.col(n).cast("string") if n in df.columns else F.lit(None).cast("string")
    h = F.col("handler")
    text, target = first_text(c("original_text"), c("input_text"), c("text")), first_text(c("target"), c("target_text"), c("label"))
    year = F.coalesce(c("year").try_cast("int"), c("label").try_cast("int"))
    source = (
        F.when(h == "ocr_correction", text)
        .when(h == "sts", pair_text(c("sentence1"), c("sentence2")))
        .when(h == "transcription", first_text(c("target"), text))
        .otherwise(text)
    )
    label = (
        F.when(h == "ocr_correction", c("corrected"))
        .when(h == "sts", score_text(F.coalesce(c("rounded_score"), target)))
        .when(h == "temporal_classification", year.cast("string"))
        .when(h == "transcription", c("transcribed"))
        .when(h == "summarization", first_text(c("summary"), target))
        .otherwise(target)
    )
    empty = (h == "multiple_choice") & (F.coalesce(source, F.lit("")).eqNullSafe("") | F.coalesce(label, F.lit("")).eqNullSafe(""))
    checked = F.when(empty, F.raise_error(F.lit("a multiple-choice row has no input or label")).cast("string")).otherwise(label)
    prompt = F.when(h == "instruction", first_text(c("metadata"), c("instruction"), F.lit("Follow the instruction."))).otherwise(c("metadata"))
    return df.select(*df.columns, prompt.alias("prompt_text"), source.alias("input"), checked.alias("output"), c("thinking").alias("thinking_text")).where(
        ~((h == "temporal_classification") & year.isNull())
    )


def temporal_route(year: Column) -> Column:
    """Rows without a usable year go to denoising."""
    return F.when(year.isNotNull() & (year > 0), "temporal_continuation").otherwise("unsupervised_pretraining")


def chat_encoder(system: Column, user: Column) -> Column:
    opened = F.when(F.coalesce(system, F.lit("")) != "", F.concat(F.lit(SYSTEM), system)).otherwise(F.lit(""))
    return F.concat(opened, F.lit(USER), user, F.lit(END))


def chat_target(response: Column, thinking: Column | None = None) -> Column:
    thought = F.lit("") if thinking is None else F.when(F.coalesce(thinking, F.lit("")) != "", F.concat(F.lit(THINK), thinking)).otherwise(F.lit(""))
    return F.concat(thought, F.lit(ASSISTANT), response, F.lit(END))


def chat_ids(system: Column, user: Column, response: Column, thinking: Column, ids: dict[str, int], encoder_max: int, decoder_max: int) -> Column:
    """Struct (input_ids, decoder_input_ids, labels) of id arrays; a cut keeps the end of turn."""
    one = lambda name: F.array(F.lit(ids[name]))
    opened = lambda mark, part: F.when(F.size(part) > 0, F.concat(one(mark), part)).otherwise(F.array().cast("array<int>"))
    cut = lambda a, n: F.when(F.size(a) > n, F.concat(F.slice(a, 1, n - 1), one(END))).otherwise(a)
    enc = cut(F.concat(opened(SYSTEM, system), one(USER), user, one(END)), encoder_max)
    target = cut(F.concat(opened(THINK, thinking), one(ASSISTANT), response, one(END)), decoder_max + 1)
    n = F.size(target)
    return F.struct(enc.alias("input_ids"), F.slice(target, F.lit(1), n - 1).alias("decoder_input_ids"), F.slice(target, F.lit(2), n - 1).alias("labels"))


def classifier_ids(text: Column, second: Column, prompt: Column, encoder_max: int, decoder_max: int, chat: dict[str, int] | None = None, script: Column | None = None, eos: int = 2) -> Column:
    """Struct (input_ids, attention_mask, decoder_input_ids, decoder_attention_mask) of id arrays, for a classifier.

    With chat ids (system, user, assistant, end): prompt and text as turns, a cut keeps the end. Otherwise the prompt
    stands before the text, with the script's tag behind it or before it on the decoder's side. The decoder gets the
    second text, or the first one again; padding is 0.
    """
    own = F.coalesce(second, text)
    if chat:
        one = lambda name: F.array(F.lit(chat[name]))
        cut = lambda a, n: F.when(F.size(a) > n, F.concat(F.slice(a, 1, n - 1), one("end"))).otherwise(a)
        opened = F.when(F.size(prompt) > 0, F.concat(one("system"), prompt)).otherwise(F.array().cast("array<int>"))
        enc, dec = cut(F.concat(opened, one("user"), text, one("end")), encoder_max), cut(F.concat(one("assistant"), own, one("end")), decoder_max)
    else:
        enc = F.slice(encoder_ids(F.concat(prompt, text), eos, script), 1, encoder_max)
        dec = F.slice(decoder_ids(own, eos, script), 1, decoder_max)
    mask = lambda a, n: pad_to(F.transform(a, lambda x: F.lit(1)), n, 0)
    return F.struct(pad_to(enc, encoder_max, 0).alias("input_ids"), mask(enc, encoder_max).alias("attention_mask"), pad_to(dec, decoder_max, 0).alias("decoder_input_ids"), mask(dec, decoder_max).alias("decoder_attention_mask"))


def chat_template(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", generation_prompt: bool = False, thinking: bool = False) -> DataFrame:
    """Rows (conv, formatted): a leading system message, then user and assistant turns; any other role is an error."""
    parts = F.array_sort(F.collect_list(F.struct(turn, "role", "text")))
    rows = turns.groupBy(conv).agg(parts.alias("t"))

    def one(t, i):
        lead = (i == 0) & (t["role"] == "system")
        bad = F.raise_error(F.concat(F.lit("a turn has the role "), t["role"])).cast("string")
        said = F.concat(F.lit("<|"), t["role"], F.lit("|>"), t["text"], F.lit(END))
        return F.when(lead, F.concat(F.lit(SYSTEM), t["text"])).when(t["role"].isin("user", "assistant"), said).otherwise(bad)

    tail = (THINK if thinking else ASSISTANT) if generation_prompt else ""
    return rows.select(conv, F.concat(F.array_join(F.transform("t", one), ""), F.lit(tail)).alias("formatted"))


def expand_candidates(df: DataFrame, candidates: str, keep: list[str]) -> DataFrame:
    """A row per question and candidate, with the candidate's UTF-8 length."""
    return df.select(*keep, F.posexplode(candidates).alias("cand_idx", "candidate")).withColumn("n_bytes", F.greatest(F.lit(1), F.octet_length("candidate")))


def decade_grid(df: DataFrame, keep: list[str], first: int = 1920, last: int = 1990) -> DataFrame:
    """A row per example and decade, with the decade's middle."""
    grid = F.sequence(F.lit(first), F.lit(last), F.lit(10))
    return df.select(*keep, F.posexplode(grid).alias("cand_idx", "decade")).withColumn("midpoint", F.col("decade") + 5)


def prompt_keys(task: Column, fmt: Column, form: Column, shuffled: Column, level: Column) -> Column:
    """Lookup keys from the most specific to the task alone; sentinel forms have no shuffle."""
    j = lambda *p: F.concat_ws(":", *p)
    order = F.when(shuffled, "shuffled").otherwise("no_shuffle")
    sentinel, other, leveled = form == "sentinel", form.isNotNull() & (form != "sentinel"), level.isNotNull()
    keys = F.array(
        F.when(sentinel & leveled, j(task, fmt, form, level)),
        F.when(other & leveled, j(task, fmt, form, order, level)),
        F.when(other, j(task, fmt, form, order)),
        F.when(form.isNotNull(), j(task, fmt, form)),
        j(task, fmt),
        task,
    )
    return F.filter(keys, lambda k: k.isNotNull())


def resolved_task(task: Column, transcription: Column, key: Column | str, seed: int | str = 42) -> Column:
    """A transcription overlay takes its direction's task, and the generic transcription task flips a seeded coin."""
    flip = F.when(uniform(f"{seed}way", key) < 0.5, "transcription_hanja_to_hangul").otherwise("transcription_hangul_to_hanja")
    return F.when(transcription.isNotNull(), F.concat(F.lit("transcription_"), transcription)).when(task == "transcription", flip).otherwise(task)


def chat_example(text: Column, prompt: Column | None = None) -> Column:
    """Struct (metadata, original_text): a chat prompt and its text under the names that the tasks read."""
    return F.struct(F.coalesce(prompt if prompt is not None else F.lit(None).cast("string"), F.lit("")).alias("metadata"), text.alias("original_text"))


def slice_prompt(prompts: list[str], seed: int | str) -> Column:
    """One prompt for a whole slice: that of the least seeded hash."""
    ranked = F.array_sort(F.array(*(F.struct(hash_key(seed, F.lit(p)).alias("h"), F.lit(p).alias("p")) for p in prompts)))
    return F.get(ranked, F.lit(0))["p"]


def first_registered(registry: dict[str, str], keys: list[Column]) -> Column:
    """The entry of the first key that is registered, else null."""
    table = F.create_map(*(F.lit(x) for kv in registry.items() for x in kv))
    return F.coalesce(*(F.try_element_at(table, k) for k in keys))


def attach_prompt(df: DataFrame, registry: dict[str, list[str]], keys: Column, key: str, seed: int | str = 42, name: str = "prompt") -> DataFrame:
    """Adds a prompt of the first key that is registered, by a seeded draw; a row without a registered key is an error."""
    table = F.create_map(*(x for k, v in registry.items() for x in (F.lit(k), F.array(*(F.lit(p) for p in v)))))
    hits = F.filter(keys, lambda k: F.map_contains_key(table, k))
    found = F.when(F.size(hits) > 0, F.element_at(table, F.get(hits, F.lit(0))))
    missing = F.raise_error(F.concat(F.lit("no prompt for "), F.array_join(keys, ", "))).cast("string")
    draw = F.element_at(found, (F.floor(uniform(f"{seed}prompt", key) * F.size(found)) + 1).cast("int"))
    return df.withColumn(name, F.when(found.isNull(), missing).otherwise(draw))
