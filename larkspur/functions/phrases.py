"""Many phrases in one pass: an automaton over all of them, built once in each Python worker."""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=4)
def _automaton(phrases: tuple[str, ...]) -> ahocorasick.Automaton:
    """Each distinct phrase with the places that it has in phrases."""
    places: dict[str, list[int]] = {}
    for k, p in enumerate(phrases):
        if p:
            places.setdefault(p, []).append(k)
    out = ahocorasick.Automaton()
    for p, ks in places.items():
        out.add_word(p, (len(p), ks))
    out.make_automaton()
    return out


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def whole_words(text: str | None, phrases: tuple[str, ...]) -> list[int]:
    """The places in phrases of those that text, both lower-cased, holds as whole words; in order. An empty phrase is in no text."""
    if not text or not any(phrases):
        return []
    found: set[int] = set()
    for end, (n, ks) in _automaton(phrases).iter(text):
        if ks[0] in found or end + 1 < len(text) and _word(text[end + 1]) or end - n >= 0 and _word(text[end - n]):
            continue
        found.update(ks)
    return sorted(found)


def phrases_in(text: Column, phrases: list[str]) -> Column:
    """array<int>: which of phrases a text holds as whole words, see whole_words(); time doesn't grow with their number."""
    lowered = tuple(p.lower() for p in phrases)

    @F.pandas_udf("array<int>")
    def rows(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: whole_words(t.lower() if t else t, lowered))

    return rows(text)
