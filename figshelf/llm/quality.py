"""Quality rules: word and line rules, then repetition found by a suffix array (operator 10).

Base rules (on words `[^\\x20\\x09-\\x0D]+`): a text fails with fewer than MIN_WORDS words, or if
more than MAX_REPEAT_WORDS per cent of its words lie in 5-word windows found twice or more.

Suffix-array repetition: of every suffix (at a word) that shares at least REPEAT_WORDS words with
another suffix of the same text, a suffix array is built by prefix doubling, and then the longest
common prefixes of neighbours by halving over hashes of prefixes; no level of the doubling is kept. The LCP intervals that hold a suffix name the repeated substrings that
begin there; all are prefixes of the deepest interval's, whose depth is the larger LCP of its two
neighbours. So the union of the spans of all maximal repeats is the union of [p, p + depth(p)). A text
is rejected if that union holds more than MAX_COVERED per cent of its words' characters, or if the
longest repeat has more than MAX_LONGEST words.

Texts of any length are handled whole. Null and empty texts have no words and fail the base rules;
repeated rows and rows with a null id get the same answer each; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from figshelf.llm.common import bounded_batches, col, documents, map_batches, quoted, row_chunks, text_bytes
from figshelf.llm.words import BASE, U, WHITE, Words, covered, mix, repeated, words_of

MIN_WORDS, WINDOW, MAX_REPEAT_WORDS = 10, 5, 20
REPEAT_WORDS, MAX_COVERED, MAX_LONGEST = 10, 20, 100
PAIRS = 1 << 18  # pairs of suffixes compared at once
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered_chars long, longest_repeat long, base_failed boolean, kept boolean"


def longest_repeats(words: Words, hashes: np.ndarray, at: np.ndarray, keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose `size`-word windows repeat in their text, and the length of each one's longest repeat.

    at, keys: the windows' first words and their keys, equal only for equal windows of one text.
    """
    twice = repeated(keys)
    small = np.int32 if len(words) < 1 << 30 else np.int64
    at, keys = at[twice].astype(small), keys[twice]
    n, m = len(at), len(words)
    if not n:
        return at, np.zeros(0, np.int64)
    # rank[i] orders the prefixes of suffix i; suffixes outside `at` occur once and rank by place
    place = np.full(m + 1, -1, small)
    place[at] = np.arange(n, dtype=small)
    rank, length = np.unique(keys, return_inverse=True)[1].astype(small), size
    del keys, twice
    while True:
        both = np.minimum(at.astype(np.int64) + length, m)
        there = place[both]
        both = np.where(there >= 0, rank[there], n + both)
        del there
        both += rank.astype(np.int64) * (n + m + 1)
        order = np.argsort(both, kind="stable").astype(small)
        both = both[order]
        rank[order] = np.append(0, np.cumsum(both[1:] != both[:-1])).astype(small)
        if rank[order[-1]] == n - 1:  # all ranks differ: the suffix array
            break
        length *= 2
    del both, place, rank
    lcp = _common(words, hashes, at[order[:-1]], at[order[1:]])
    lcp[lcp < size] = 0
    best = np.zeros(n, lcp.dtype)
    best[order[:-1]] = lcp
    best[order[1:]] = np.maximum(best[order[1:]], lcp)
    return at, best


def _common(words: Words, hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words from a and from b on are equal, inside the text of each: halved over hashes of prefixes of all words."""
    power = np.full(len(words) + 1, BASE, U)
    power[0] = 1
    np.cumprod(power, dtype=U, out=power)
    sums = np.zeros(len(words) + 1, U)
    np.cumsum(hashes * power[:-1], dtype=U, out=sums[1:])
    out = np.zeros(len(a), np.int32 if len(words) < 1 << 31 else np.int64)
    for k in range(0, len(a), PAIRS):
        x, y = a[k : k + PAIRS], b[k : k + PAIRS]
        first, apart = np.minimum(x, y), np.abs(y - x)
        low, high = np.zeros(len(x), np.int64), np.minimum(words.first[words.text[x] + 1] - x, words.first[words.text[y] + 1] - y)
        high[words.text[x] != words.text[y]] = 0
        while len(todo := np.flatnonzero(low < high)):
            at, d, middle = first[todo], apart[todo], (low[todo] + high[todo] + 1) // 2
            same = (sums[at + middle] - sums[at]) * power[d] == sums[at + d + middle] - sums[at + d]
            low[todo[same]] = middle[same]
            high[todo[~same]] = middle[~same] - 1
        out[k : k + PAIRS] = low
    return out


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[bytes] = set()
    again = 0
    for line in text.split(b"\n"):
        if line in seen:
            again += 1
        elif line.strip():
            seen.add(line)
    return again


def features(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The columns of FEATURES for the texts data[offsets[i]:offsets[i + 1]]."""
    n = len(offsets) - 1
    words = words_of(data, offsets)
    hashes, n_words = words.hashes(), words.per_text
    small = np.int32 if len(data) < 1 << 31 else np.int64
    starts = np.zeros(len(data) + 1, small)
    np.cumsum((data & 0xC0 != 0x80) & ~WHITE[data], dtype=small, out=starts[1:])
    word_chars = (starts[offsets[1:]] - starts[offsets[:-1]]).astype(np.int64)
    symbols = np.searchsorted(np.flatnonzero(SYMBOL[data]), offsets)
    at, grams = words.windows(WINDOW, hashes)
    # the text's number goes into the key: windows of different texts are never equal
    keys = mix(grams + mix(words.text[at].astype(U) + U(1)))
    twice = repeated(keys)
    n_repeat = np.bincount(words.text[covered(at[twice], WINDOW, len(words))], minlength=n)
    # windows of REPEAT_WORDS words can only repeat where both of their halves do
    key_at = np.zeros(len(words) + 1, U)
    key_at[at] = keys
    is_twice = np.zeros(len(words) + 1, bool)
    is_twice[at[twice]] = True
    half = REPEAT_WORDS - WINDOW
    a = at[twice]
    a = a[a + half < len(words)]
    a = a[is_twice[a + half] & (words.text[a] == words.text[a + half])]
    ten = mix(key_at[a] * U(0xD6E8FEB86659FD93) + key_at[a + half])
    del at, grams, keys, twice, key_at, is_twice
    p, best = longest_repeats(words, hashes, a, ten, REPEAT_WORDS)
    in_repeat = np.flatnonzero(covered(p, best, len(words)))
    n_covered = np.zeros(n, np.int64)
    np.add.at(n_covered, words.text[in_repeat], (starts[words.end[in_repeat]] - starts[words.start[in_repeat]]).astype(np.int64))
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, words.text[p], best)
    raw = data.tobytes()
    dup = np.array([repeated_lines(raw[s:e]) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())], np.int64)
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_WORDS * n_words)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": np.diff(symbols),
        "n_dup_lines": dup, "n_repeat_words": n_repeat, "n_covered_chars": n_covered, "longest_repeat": longest,
        "base_failed": failed, "kept": ~failed & (100 * n_covered <= MAX_COVERED * word_chars) & (longest <= MAX_LONGEST),
    }


def _scored(text: pa.Array) -> dict[str, np.ndarray]:
    data, offsets = text_bytes(text)
    found = [features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in row_chunks(offsets)]
    return {k: np.concatenate([x[k] for x in found]) for k in found[0]} if found else {}


def quality_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id and FEATURES. A map over the rows: nothing is shuffled."""
    bounded_batches(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (x := _scored(batch.column(1))).values())], [id_col, *x])

    two = docs.select(col(id_col), col(text_col))
    return map_batches(two, score, f"{quoted(id_col)} {two.dtypes[0][1]}, {FEATURES}")


def keep_quality(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that pass, unchanged and with all their columns, whatever these are called."""
    bounded_batches(docs.sparkSession)
    place = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(_scored(batch.column(place))["kept"]))

    return map_batches(docs, keep, docs.schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_features(documents(spark, sf_dir)).drop("longest_repeat")


#: A word lies in a repeat of REPEAT_WORDS words or more if and only if it lies in a window of that many
#: words found twice; the longest repeat exceeds MAX_LONGEST if and only if a window of one word more is.
OP10_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (SELECT r, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM d),
g AS (SELECT w.r, w.p, word, array_to_string(ws[p:p + 4], ' ') AS w5, array_to_string(ws[p:p + 9], ' ') AS w10,
    p + 4 <= len(ws) AS has5, p + 9 <= len(ws) AS has10 FROM w JOIN d ON w.r = d.r),
c AS (SELECT r, p, word, has5 AND count(*) OVER (PARTITION BY r, w5, has5) > 1 AS twice5,
    has10 AND count(*) OVER (PARTITION BY r, w10, has10) > 1 AS twice10 FROM g),
m AS (SELECT r, word, coalesce(bool_or(twice5) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), false) AS in5,
    coalesce(bool_or(twice10) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), false) AS in10 FROM c),
f AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars, count(*) FILTER (in5) AS n_repeat_words,
    coalesce(sum(length(word)) FILTER (in10), 0) AS n_covered_chars FROM m GROUP BY r),
big AS (SELECT DISTINCT r FROM (SELECT r, array_to_string(ws[p:p + 100], ' ') AS w101
    FROM (SELECT r, ws, unnest(range(1, len(ws) - 99)) AS p FROM d WHERE len(ws) > 100) y) z GROUP BY r, w101 HAVING count(*) > 1),
l AS (SELECT r, sum(n - 1) AS n_dup_lines FROM (SELECT r, line, count(*) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) y
    WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r, line) z GROUP BY r),
x AS (SELECT d.r, doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_covered_chars, 0) AS n_covered_chars, big.r IS NOT NULL AS has_big
    FROM d LEFT JOIN f ON d.r = f.r LEFT JOIN l ON d.r = l.r LEFT JOIN big ON d.r = big.r)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  CAST(n_covered_chars AS BIGINT) AS n_covered_chars, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_covered_chars > 20 * word_chars OR has_big) AS kept
FROM x
"""
