"""Chat formatting in DataFrame expressions: a finite-state machine over roles, and segments with loss flags.

A template names for each role the strings around its text and whether the text is under the loss mask. Control strings
within a text are escaped reversibly: the escape character first, then each control string by a code of its own, so no
control string of a formatted conversation can come from a text, and reading one back is a split at control strings.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESC = "\\"


@dataclass(frozen=True)
class Role:
    begin: str
    end: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Roles by name; a role that has no entry is written as ``other``, with its escaped name before ``name_end``."""

    roles: dict[str, Role]
    other: Role
    name_end: str
    #: (state, role) -> state; "*" is any other role. A turn without an entry is out of order and leaves the state.
    moves: dict[tuple[str, str], str]
    start: str = "start"
    final: tuple[str, ...] = ("answered",)

    @property
    def controls(self) -> list[str]:
        """All control strings, longest first."""
        found = {self.name_end, self.other.begin, self.other.end} | {x for r in self.roles.values() for x in (r.begin, r.end)}
        return sorted(found, key=lambda x: (-len(x), x))


LLAMA = Template(
    roles={
        "system": Role("<<SYS>>", "<</SYS>>"),
        "user": Role("[INST]", "[/INST]"),
        "assistant": Role("<s>", "</s>", loss=True),
    },
    other=Role("[ROLE]", "[/ROLE]"),
    name_end="[:]",
    moves={
        ("start", "system"): "asked",
        ("start", "user"): "replying",
        ("asked", "user"): "replying",
        ("replying", "assistant"): "answered",
        ("answered", "user"): "replying",
    },
)


def escape(text: Column, template: Template) -> Column:
    """Reversible: no control string is left in the result, whatever stands before or after it."""
    out = F.replace(text, F.lit(ESC), F.lit(ESC + "."))
    pattern = "|".join(re.escape(c) for c in template.controls)
    # one pass marks each control string, then the marks become codes; the mark can't come from a text, whose escapes end in a dot
    out = F.regexp_replace(out, f"({pattern})", re.escape(ESC) + "($1" + re.escape(ESC) + ")")
    for k, c in enumerate(template.controls):
        out = F.replace(out, F.lit(f"{ESC}({c}{ESC})"), F.lit(f"{ESC}{k};"))
    return out


def unescape(text: Column, template: Template) -> Column:
    out = text
    for k, c in enumerate(template.controls):
        out = F.replace(out, F.lit(f"{ESC}{k};"), F.lit(c))
    return F.replace(out, F.lit(ESC + "."), F.lit(ESC))


def _segments(turn: Column, template: Template) -> Column:
    """Three segments of a turn: what stands before its text, the text, and what stands after it."""
    role, text = turn["role"], escape(turn["text"], template)
    other = F.concat(F.lit(template.other.begin), escape(role, template), F.lit(template.name_end))
    begin, end, loss = other, F.lit(template.other.end), F.lit(template.other.loss)
    for name, r in template.roles.items():
        own = role == name
        begin, end = F.when(own, F.lit(r.begin)).otherwise(begin), F.when(own, F.lit(r.end)).otherwise(end)
        loss = F.when(own, F.lit(r.loss)).otherwise(loss)
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    return F.array(piece(begin, F.lit(False)), piece(text, loss), piece(end, F.lit(False)))


def _state(roles: Column, template: Template) -> Column:
    """Runs the machine: a struct of the last state and the first turn out of order (0-based, null if none)."""

    def step(acc: Column, role: Column) -> Column:
        to = F.lit(None).cast("string")
        for (state, name), then in template.moves.items():
            to = F.when((acc["state"] == state) & ((role == name) if name != "*" else F.lit(True)), F.lit(then)).otherwise(to)
        bad = F.when(acc["bad"].isNull() & to.isNull(), acc["n"]).otherwise(acc["bad"])
        return F.struct(F.coalesce(to, acc["state"]).alias("state"), bad.alias("bad"), (acc["n"] + 1).alias("n"))

    zero = F.struct(F.lit(template.start).alias("state"), F.lit(None).cast("int").alias("bad"), F.lit(0).alias("n"))
    return F.aggregate(roles, zero, step)


def formatted(conversations: DataFrame, template: Template = LLAMA) -> DataFrame:
    """Rows (conv_id, n_turns, segments, formatted, valid, first_bad_turn), one per conversation.

    Turns are ordered by turn, ties by role and text; nulls come first, a null text or role is empty. A row with a null
    conv_id belongs to no conversation and is formatted alone, so such rows never gather in one task; repeated rows of an
    id are turns of their own. Texts of any length are kept whole; a conversation is one row. One whose turns are out of
    order is formatted all the same and marked; without a row there is no conversation. Other columns are not read.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = conversations.select("conv_id", turn.alias("__turn"))
    rows = turns.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list("__turn")).alias("__turns"))
    rows = rows.unionByName(turns.where("conv_id is null").select("conv_id", F.array("__turn").alias("__turns")))
    state = _state(F.transform("__turns", lambda t: t["role"]), template)
    rows = rows.select(
        "conv_id",
        F.size("__turns").cast("long").alias("n_turns"),
        F.flatten(F.transform("__turns", lambda t: _segments(t, template))).alias("segments"),
        state.alias("__state"),
    )
    return rows.select(
        "conv_id",
        "n_turns",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        (F.col("__state.bad").isNull() & F.col("__state.state").isin(*template.final)).alias("valid"),
        F.col("__state.bad").alias("first_bad_turn"),
    )


def read_back(formatted_text: Column, template: Template = LLAMA) -> Column:
    """Turns (role, text) of a formatted conversation, by its control strings alone."""
    quoted = lambda x: re.escape(x)
    kinds = [f"{quoted(r.begin)}.*?{quoted(r.end)}" for r in [*template.roles.values(), template.other]]
    found = F.regexp_extract_all(formatted_text, F.lit(f"(?s)({'|'.join(kinds)})"), F.lit(1))

    def turn(piece: Column) -> Column:
        inner = lambda r: F.substring(piece, F.lit(len(r.begin) + 1), F.length(piece) - len(r.begin) - len(r.end))
        body = inner(template.other)
        cut = F.locate(template.name_end, body)
        name = F.substring(body, F.lit(1), cut - 1)
        text = F.substring(body, cut + len(template.name_end), F.length(body))
        role, said = unescape(name, template), unescape(text, template)
        for known, r in template.roles.items():
            own = F.startswith(piece, F.lit(r.begin))
            role, said = F.when(own, F.lit(known)).otherwise(role), F.when(own, unescape(inner(r), template)).otherwise(said)
        return F.struct(role.alias("role"), said.alias("text"))

    return F.transform(found, turn)


def digests(chats: DataFrame, template: Template = LLAMA) -> DataFrame:
    """Digest columns of formatted conversations, all read back from the output: the turns from the formatted text, the
    loss text from the segments under the mask."""
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")
    turns = read_back(F.col("formatted"), template)
    rows = chats.select("conv_id", turns.alias("__turns"), loss.alias("__loss"), F.length("formatted").cast("long").alias("formatted_chars"), "valid", "first_bad_turn")
    lines = F.array_join(F.transform("__turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id",
        F.size("__turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(lines, "UTF-8"), 256).alias("turns_sha256"),
        F.length("__loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("__loss", "UTF-8"), 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
        "first_bad_turn",
    )
