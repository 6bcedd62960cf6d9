"""Many lists of terms looked up in one pass over a text, by one automaton."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a word: a term of one word has none of them on either side.
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz'")


class Terms:
    """Named lists of terms. A term of one word occurs as a whole word, a phrase wherever its characters stand.

    A term that is in several lists counts in each, one that is listed twice counts once. A term of one word that has other
    characters than LETTERS occurs nowhere, as it is no word; so does an empty one.
    """

    def __init__(self, lists: Mapping[str, Sequence[str]]):
        self.names = list(lists)
        known = sorted({t for terms in lists.values() for t in terms if t and (" " in t or LETTERS.issuperset(t))})
        self.member = np.array([[t in set(terms) for terms in lists.values()] for t in known], np.int32).reshape(len(known), len(self.names))
        self.automaton = ahocorasick.Automaton()
        for k, term in enumerate(known):
            self.automaton.add_word(term, (k, len(term), " " not in term))
        if known:
            self.automaton.make_automaton()
        self.known = known

    def found(self, low: str) -> set[int]:
        """Numbers of the terms that occur in a lower-cased text."""
        out: set[int] = set()
        if not self.known or not low:
            return out
        last = len(low) - 1
        for end, (k, size, word) in self.automaton.iter(low):
            if k not in out and not (word and (end < last and low[end + 1] in LETTERS or end >= size and low[end - size] in LETTERS)):
                out.add(k)
        return out

    def counts(self, raw: str | None) -> np.ndarray:
        """Of each list how many of its terms occur."""
        found = self.found((raw or "").lower())
        return self.member[list(found)].sum(axis=0) if found else np.zeros(len(self.names), np.int64)


def hits(texts: Column, lists: Mapping[str, Sequence[str]]) -> Column:
    """array<array<int>> for array<string>: of each text and each list, in their order, what text.term_hits gives.

    All lists are looked up in one pass. Null texts have no hits, a null array stays null.
    """
    terms = Terms(lists)

    @F.pandas_udf("array<array<int>>")
    def counted(column: pd.Series) -> pd.Series:
        return pd.Series([[terms.counts(t) for t in mine] if mine is not None else None for mine in column], dtype=object)

    return counted(texts)
