"""Text search over arrays of words in text order. Words are lower-cased letters and digits; there is no stemming."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    found = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")
    return F.array_remove(F.coalesce(found, F.array().cast("array<string>")), "")


def terms(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def _once(vector: Column, test: Callable[[Column], Column]) -> Column:
    """`test` of the words in one padded string. A variable holds it: a column named several times would be computed as often."""
    return F.exists(F.array(F.concat(F.lit(" "), F.array_join(vector, " "), F.lit(" "))), test)


def has_phrase(words: Column, phrase: list[str]) -> Column:
    """The terms in a row, in padded words. Words hold no blanks, so one search tells it."""
    return F.contains(words, F.lit(f" {' '.join(phrase)} "))


def has_all(vector: Column, wanted: list[str]) -> Column:
    """Plain search: every term occurs. No terms match nothing."""
    if not wanted:
        return F.lit(False)
    return _once(vector, lambda words: reduce(lambda a, b: a & b, [has_phrase(words, [t]) for t in dict.fromkeys(wanted)]))


def web_search(vector: Column, query: str) -> Column:
    """Words must all occur, `"quoted words"` in that order, `-word` must not, and `or` separates alternatives."""
    either: list[list[tuple[str, list[str]]]] = [[]]
    for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        if word.lower() == "or" and not minus:
            either.append([])
        elif found := terms(quoted or word):
            either[-1].append((minus, found))
    either = [every for every in either if every]
    if not either:
        return F.lit(False)

    def test(words: Column) -> Column:
        each = [[~has_phrase(words, found) if minus else has_phrase(words, found) for minus, found in every] for every in either]
        return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, every) for every in each])

    return _once(vector, test)
