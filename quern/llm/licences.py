"""Licence scans: notice phrases and identifier tags by an Aho-Corasick automaton, expressions by a shunting yard."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import words_of

#: Phrases with fixed labels (words of the contract).
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: More phrases and their labels.
MORE = {
    "affero general public license": "agpl",
    "all rights reserved": "all-rights-reserved",
    "apache license 2 0": "apache-2.0",
    "apache license version 2 0": "apache-2.0",
    "artistic license": "artistic",
    "beerware license": "beerware",
    "boost software license": "bsl",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "bsd license": "bsd",
    "business source license": "busl",
    "cc by nc": "cc-by-nc",
    "cc by nc nd": "cc-by-nc-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc0": "cc0",
    "common development and distribution license": "cddl",
    "common public license": "cpl",
    "copyleft": "copyleft",
    "creative commons attribution": "cc-by",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons attribution share alike": "cc-by-sa",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons zero": "cc0",
    "do what the fuck you want to public license": "wtfpl",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "for non commercial use only": "non-commercial",
    "free art license": "lal",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gpl v2": "gpl-2.0",
    "gpl v3": "gpl-3.0",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "mpl 2 0": "mpl-2.0",
    "open database license": "odbl",
    "open font license": "ofl",
    "permission is hereby granted free of charge": "mit",
    "permission to use copy modify and or distribute this software": "isc",
    "proprietary and confidential": "proprietary",
    "public domain": "public-domain",
    "python software foundation license": "psf",
    "redistribution and use in source and binary forms": "bsd",
    "server side public license": "sspl",
    "the unlicense": "unlicense",
    "this program is free software": "free-software",
    "zlib license": "zlib",
}
#: The tag before an identifier expression, as words.
TAG = "spdx license identifier"
#: Licences by how freely their texts can be used, for the score; others count as unknown.
OPEN = {
    "mit", "apache", "apache-2.0", "bsd", "bsd-2-clause", "bsd-3-clause", "isc", "bsl", "cc0", "cc0-1.0", "unlicense", "public-domain",
    "cc-by", "cc-by-4.0", "zlib", "bsl-1.0", "wtfpl", "beerware", "psf",
}
COPYLEFT = {"gpl", "lgpl", "agpl", "mpl", "epl", "cc-by-sa", "cddl", "cpl", "eupl", "gfdl", "odbl", "ofl", "lal", "copyleft", "artistic", "free-software"}
CLOSED = {"all-rights-reserved", "cc-by-nc", "cc-by-nd", "cc-by-nc-sa", "cc-by-nc-nd", "non-commercial", "proprietary", "sspl", "busl"}
#: The tag, its words apart as they may be in a text, and the rest of its line.
_EXPRESSION = re.compile(rb"spdx[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+license[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+identifier[ \t]*:?[ \t]*([a-z0-9.+:() \t-]+)", re.I)
_LEXEME = re.compile(r"\(|\)|[a-z0-9][a-z0-9.:+-]*", re.I)
_RANK = {"or": 1, "and": 2, "with": 3}


def freedom(label: str) -> float:
    """1 for licences without conditions on derived texts, 0.6 for copyleft, 0 for closed, 0.5 for unknown ones."""
    name = label.lower().removesuffix("+").removesuffix("-or-later").removesuffix("-only")
    family = re.sub(r"-\d[\d.]*$", "", name)
    if name in OPEN or family in OPEN:
        return 1.0
    return 0.6 if family in COPYLEFT else 0.0 if family in CLOSED else 0.5


def parse_expression(text: str) -> tuple[list[str], float] | None:
    """Identifiers of an and/or/with expression and its score: or takes the best side, and the worst; null if malformed.

    A shunting yard puts the operators behind their operands by rank (with, and, or). An exception after ``with`` eases
    its licence by a fifth of what it lacks and is listed with it.
    """
    out: list[str] = []
    ops: list[str] = []
    operand = True
    for t in _LEXEME.findall(text):
        low = t.lower()
        if low in _RANK:
            if operand:
                return None
            while ops and ops[-1] != "(" and _RANK[ops[-1]] >= _RANK[low]:
                out.append(ops.pop())
            ops.append(low)
            operand = True
        elif t == "(":
            if not operand:
                break  # prose after the expression
            ops.append(t)
        elif t == ")":
            if operand or "(" not in ops:
                return None
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
        else:
            if not operand:
                break
            out.append("=" + low)
            operand = False
    if operand or "(" in ops:
        return None
    values: list[tuple[str, float, list[str]]] = []  # an operand, its score and its identifiers
    for t in out + ops[::-1]:
        if t[0] == "=":
            values.append((t[1:], freedom(t[1:]), [t[1:]]))
            continue
        (b, y, right), (a, x, left) = values.pop(), values.pop()
        if t == "with":
            values.append((f"{a} with {b}", x + (1 - x) / 5, [*left[:-1], f"{left[-1]} with {b}"]))
        else:
            values.append((f"({a} {t} {b})", max(x, y) if t == "or" else min(x, y), left + right))
    return values[0][2], values[0][1]


def automaton() -> ahocorasick.Automaton:
    """Over words joined and framed by single spaces, as Latin-1 text of their UTF-8 bytes."""
    out = ahocorasick.Automaton()
    for base, phrases in ((False, MORE), (True, BASE)):
        for phrase, label in phrases.items():
            out.add_word(f" {phrase} ", (base, len(phrase) + 2, label))
    out.add_word(f" {TAG} ", (False, len(TAG) + 2, ""))
    out.make_automaton()
    return out


def scan_text(text: str | None, found) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels and score of a text."""
    words = words_of(text)
    line = f" {b' '.join(words).decode('latin-1')} "
    places, base, labels, scores, tagged = [], set(), set(), [], False
    for end, (is_base, size, label) in found.iter(line):
        if is_base:
            places.append(end - size + 1)
            base.add(label)
        if label:
            labels.add(label)
        else:
            tagged = True
    if tagged:
        for m in _EXPRESSION.finditer(text.encode("utf-8", "surrogatepass")):
            if got := parse_expression(m[1].decode("latin-1")):
                labels.update(got[0])
                scores.append(got[1])
    scores += [freedom(x) for x in labels if " with " not in x and not scores or x in base]
    score = min(scores) if scores else 0.5
    first = line.count(" ", 0, min(places)) if places else None
    last = line.count(" ", 0, max(places)) if places else None
    return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score


COLUMNS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one per row of docs.

    n_base counts all places of the base phrases; the words are their smallest and largest start, null without one. The
    score is how freely the text can be used, 0.5 without a label; of labels that tie the set holds each once. A null text
    is empty; texts of any length are scanned whole; ids may be null or repeat; an empty table gives no row; other columns
    are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton()
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        for batch in batches:
            rows = [scan_text(t, found) for t in batch.column(1).to_pylist()]
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", *names])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, f"doc_id long, {COLUMNS}")
