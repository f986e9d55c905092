"""Token search with a score, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that stand alone as tokens.
PUNCTUATION = "\u2000-\u206f\u2e00-\u2e7f" + r"\\'!\"#$%&()*+,\-./:;<=>?@\[\]^_`{|}~"
WIDE = "\u0f00-\u0fff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f"
ALONE = f"[{PUNCTUATION}{WIDE}]"


def tokens(query: str) -> list[str]:
    """Lower-cased tokens: parted by white space; punctuation and wide characters are tokens of their own."""
    return re.findall(f"{ALONE}|[^\\s{PUNCTUATION}{WIDE}]+", query.lower())


def at_first_places(text: Column, parts: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of where each part of an array is found, from 0, each in the rest of the text after the one before; null if one is not found."""
    none = F.array().cast("array<int>")

    def look(state: Column, part: Column) -> Column:
        place = F.call_function("locate", part, text, state["end"] + 1) - 1
        grown = F.struct((place + F.length(part)).alias("end"), F.concat(state["places"], F.array(place)).alias("places"))
        lost = F.struct(F.lit(-1).alias("end"), none.alias("places"))
        return F.when((state["end"] >= 0) & (place >= 0), grown).otherwise(lost)

    begin = F.struct(F.lit(0).alias("end"), none.alias("places"))
    return F.aggregate(parts, begin, look, lambda s: F.when(s["end"] >= 0, then(s["places"])))


def begins_inside_word(text: Column, place: Column) -> Column:
    """Whether the character at a place goes on with a word: a small letter after part of a word, or a capital after a capital.

    Characters that stand alone, digits and letters without case never do.
    """
    here, before = F.substr(text, place + 1, F.lit(1)), F.substr(text, place, F.lit(1))
    is_capital, is_small = (lambda c: F.lower(c) != c), (lambda c: F.upper(c) != c)
    goes_on = F.when(is_capital(here), is_capital(before)).otherwise(F.lit(False)) | (is_small(here) & ~before.rlike(f"{ALONE}|\\s"))
    return (place > 0) & ~here.rlike(ALONE) & goes_on


def score_of(text: Column, places: Column, parts: Column, length: Column, count_inside: bool) -> Column:
    """The score of parts found at these places, for a query of a given length.

    Points go off for each further run (parts right after each other are one), for parts that begin inside a
    word, for a span longer than the query, for a late start and for a long text. Places are code points.
    """
    lengths = F.transform(parts, F.length)
    gap = F.transform(places, lambda p, k: (k > 0) & (p > F.get(places, k - 1) + F.get(lengths, k - 1)))
    further_runs = F.size(F.filter(gap, lambda g: g))
    inside = F.size(F.filter(places, lambda p: begins_inside_word(text, p))) if count_inside else F.lit(0)
    start = F.get(places, F.lit(0))
    too_long = F.element_at(places, -1) + F.element_at(lengths, -1) - start + 1 - length
    return -further_runs - inside / 10.0 - too_long / 100.0 - start / 1000.0 - F.length(text) / 10000.0


def score_by_parts(text: Column, words: Column, letters: Column, length: Column) -> Column:
    """The score of a text for the words and letters of a query of a given length; null where neither are found. Neither array is empty."""
    low = F.lower(text)
    by_word = at_first_places(low, words, lambda places: score_of(text, places, words, length, True))
    return F.coalesce(by_word, at_first_places(low, letters, lambda places: score_of(text, places, letters, length, False)))


def search_score(text: Column, query: str) -> Column:
    """The score of a text, higher is better; null where the query is not found.

    Found are texts that hold the query's tokens in this order; failing that, those that hold all its characters in
    this order, for which beginnings inside words cost nothing. An empty query scores 0 everywhere.
    """
    words, letters = tokens(query), list(query.lower())
    if not words:  # nothing, or nothing but white space: no token is missing
        return F.when(text.isNotNull(), F.lit(0.0))
    return score_by_parts(text, F.lit(words), F.lit(letters), F.lit(len(query)))
