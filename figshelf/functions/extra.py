"""Extra fields: lines `key: value` in one text, as column expressions.

Lines that are no pair (no ": ", or an empty key) are kept together under FREE. Where a key comes twice its
last value counts, at its first place, whatever spark.sql.mapKeyDedupPolicy says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

FREE = "__nonStandard__"  # fixed value


def _is_pair(line: Column) -> Column:
    return F.locate(": ", line) > 1


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is worked out once however often `then` names it: inside transform it is a variable."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _entries(text: Column) -> Column:
    """Structs (key, value) of the pairs in order, then of FREE."""
    return _once(F.split(text, "\n"), _parted)


def _parted(lines: Column) -> Column:
    pair = lambda s: F.struct(F.substring_index(s, ": ", 1).alias("key"), F.substr(s, F.locate(": ", s) + 2).alias("value"))
    pairs = F.transform(F.filter(lines, _is_pair), pair)
    free = F.array_join(F.filter(lines, lambda s: ~_is_pair(s)), "\n")
    return F.concat(pairs, F.array(F.struct(F.lit(FREE).alias("key"), free.alias("value"))))


def _last_of_each(entries: Column) -> Column:
    """A map of entries: each key at its first place, with its last value. By sorting, so any number of keys will do."""

    def collect(all_: Column) -> Column:
        other = lambda i, j: ~F.coalesce(F.get(all_, i)["key"] == F.get(all_, j)["key"], F.lit(False))
        firsts = F.filter(all_, lambda e, i: other(i, i - 1))
        lasts = F.filter(all_, lambda e, i: other(i, i + 1))
        kept = F.sort_array(F.zip_with(firsts, lasts, lambda a, b: F.struct(a["place"].alias("place"), a["key"].alias("key"), b["value"].alias("value"))))
        return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["key"], e["value"])))

    by_key = F.sort_array(F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), i.alias("place"), e["value"].alias("value"))))
    return _once(by_key, collect)


def parse_extra(text: Column) -> Column:
    """MAP<STRING, STRING> of the pairs, then FREE."""
    return _last_of_each(_entries(text))


def get_extra(text: Column, key: str) -> Column:
    return F.try_element_at(parse_extra(text), F.lit(key))


def set_extra(text: Column, key: str, value: Column) -> Column:
    """The text with one pair set: free lines first, then the pairs."""
    fields = _last_of_each(F.concat(_entries(text), F.array(F.struct(F.lit(key).alias("key"), value.alias("value")))))
    return _once(fields, _text)


def _text(fields: Column) -> Column:
    pairs = F.filter(F.map_entries(fields), lambda e: e["key"] != FREE)
    free = F.try_element_at(fields, F.lit(FREE))
    made = F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return F.concat_ws("\n", F.nullif(free, F.lit("")), made)
