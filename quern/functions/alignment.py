"""Matching blocks of two texts by suffix automata, and the accuracy of transcribed Hanja that is counted over them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The block of unified ideographs that the accuracy counts.
FIRST_HANJA, LAST_HANJA = "一", "鿿"


class Automaton:
    """Suffix automaton of text[lo:hi]: one state for each set of places where a substring ends, at most two a character."""

    def __init__(self, text: str, lo: int, hi: int):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]  # suffix link, longest substring, where it ends first
        last = 0
        for at in range(lo, hi):
            c, state, p = text[at], len(self.next), last
            self._state({}, 0, self.length[last] + 1, at)
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = state
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                if self.length[p] + 1 == self.length[q]:
                    self.link[state] = q
                else:  # the shorter substrings of q end in more places from now on
                    copy = len(self.next)
                    self._state(dict(self.next[q]), self.link[q], self.length[p] + 1, self.first[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = self.link[p]
                    self.link[q] = self.link[state] = copy
            last = state

    def _state(self, following: dict[str, int], link: int, length: int, first: int) -> None:
        self.next.append(following), self.link.append(link), self.length.append(length), self.first.append(first)

    def longest(self, text: str, lo: int, hi: int) -> tuple[int, int, int]:
        """(start in text[lo:hi], start in the automaton's text, length) of the longest common substring: of equally long
        ones the first in text, and of its places in the other the first."""
        state = size = 0
        best = (lo, lo, 0)
        following, link, length = self.next, self.link, self.length
        for at in range(lo, hi):
            c = text[at]
            while state and c not in following[state]:
                state = link[state]
                size = length[state]
            if c in following[state]:
                state = following[state][c]
                size += 1
                if size > best[2]:
                    best = (at - size + 1, self.first[state] - size + 1, size)
        return best


def matching_blocks(a: str, b: str) -> list[tuple[int, int, int]]:
    """The longest common block of a and b, and so on to its left and right: (start in a, start in b, length), in order.

    Each part is matched in time linear in its length, so texts that differ here and there need little more than that.
    """
    out, open_ = [], [(0, len(a), 0, len(b))]
    while open_:
        a_lo, a_hi, b_lo, b_hi = open_.pop()
        if a_lo >= a_hi or b_lo >= b_hi:
            continue
        if a_hi - a_lo == b_hi - b_lo and a[a_lo:a_hi] == b[b_lo:b_hi]:
            out.append((a_lo, b_lo, a_hi - a_lo))
            continue
        i, j, size = Automaton(b, b_lo, b_hi).longest(a, a_lo, a_hi)
        if size:
            out.append((i, j, size))
            open_ += [(a_lo, i, b_lo, j), (i + size, a_hi, j + size, b_hi)]
    return sorted(out)


def _is_hanja(c: Column) -> Column:
    return (c >= FIRST_HANJA) & (c <= LAST_HANJA)


def _aligned(prediction: Column, reference: Column) -> Column:
    """Share of the reference's Hanja, within the shorter length, that the prediction has at the same place."""
    p, r = F.split(prediction, ""), F.split(reference, "")
    n = F.least(F.length(prediction), F.length(reference))
    pairs = F.filter(F.arrays_zip(F.slice(p, F.lit(1), n).alias("p"), F.slice(r, F.lit(1), n).alias("r")), lambda x: _is_hanja(x["r"]))
    hits = F.size(F.filter(pairs, lambda x: x["p"] == x["r"]))
    return F.coalesce(hits.cast("double") / F.greatest(F.size(pairs), F.lit(1)).cast("double"), F.lit(0.0))


def hanja_accuracy(prediction: Column, reference: Column, ignore_spaces: bool = False) -> Column:
    """Place by place, after white space before the texts, or all white space, is taken out. A null text is empty."""
    clean = lambda t: F.regexp_replace(F.coalesce(t, F.lit("")), r"(?U)[\s\x1c-\x1f]+" if ignore_spaces else r"(?U)^[\s\x1c-\x1f]+", "")
    return _aligned(clean(prediction), clean(reference))


def hanja_in_blocks(prediction: str, reference: str) -> float:
    """Share of all Hanja of the reference that lie in matching blocks."""
    total = sum(FIRST_HANJA <= c <= LAST_HANJA for c in reference)
    if not total:
        return 0.0
    blocks = matching_blocks(prediction, reference)
    return sum(FIRST_HANJA <= c <= LAST_HANJA for _, b, size in blocks for c in reference[b : b + size]) / total


@F.pandas_udf(T.DoubleType())
def hanja_recall(prediction: pd.Series, reference: pd.Series) -> pd.Series:
    """Share of the reference's Hanja in matching blocks, so that a letter more or less costs no more than itself."""
    return pd.Series([hanja_in_blocks(p or "", r or "") for p, r in zip(prediction, reference, strict=True)], dtype=float)
