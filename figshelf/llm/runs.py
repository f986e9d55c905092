"""Runs of words that repeat with a period, and texts without the repeats (operator 11).

A run is a stretch of consecutive words `[^\\x20\\x09-\\x0D]+` of one text with smallest period q (words q
apart are equal) that no neighbouring word extends with that period, of at least MIN_EXPONENT periods and MIN_WORDS words.

Method: block convolution. At each scale B = 1, 2, 4, ... the words, as numbers, are cut into blocks of B. A run whose
period lies in [B, 2B) holds, with its four periods, two whole blocks in a row whose words come again one period later, so it
shows as two neighbouring blocks with an occurrence at the same distance. The occurrences of a block in the 2B - 1
words that follow it are where the sum of squared differences is 0: two sums of squares less twice a
correlation, which number-theoretic transforms give modulo two primes, without rounding. (Blocks shorter than DIRECT words
take the same sums written out.) Distances seed extensions: how far both ways the words agree at
that distance is looked up by halving over prefix hashes, and the stretch found is then compared word by word. Stretches of
the same place with a multiple of the period drop out, as the smallest period of each place stays.
Two exact tests save transforms: a block with a word that doesn't come again B to 2B - 1 words later has no occurrence, and a block whose
window lies in a run that a smaller scale has found has only that run's occurrences.

Texts are handled whole and whatever their length; null and empty ones have no words and no runs. Repeated rows and rows with a
null id get the same answer each; an empty table gives an empty one. A map over the rows: nothing is shuffled. Other columns, of any name, pass
through `collapse_runs` unchanged. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from figshelf.llm.common import CRC32_SQL, bounded_batches, col, documents, map_batches, quoted, row_chunks, text_bytes
from figshelf.llm.words import BASE, U, Words, mix, words_of

MIN_EXPONENT, MIN_WORDS = 4, 6
DIRECT = 16  # blocks shorter than this take sums written out
CELLS = 1 << 18  # numbers transformed at once
#: Primes k * 2**n + 1 that have 2**26-th roots of unity, and a generator of both.
PRIMES, GENERATOR = (469762049, 2013265921), {469762049: 3, 2013265921: 31}
_twiddles: dict[tuple[int, int, bool], np.ndarray] = {}


def _roots(prime: int, half: int, back: bool) -> np.ndarray:
    """Powers 0 .. half - 1 of a root of unity of order 2 * half, or of its inverse."""
    if (prime, half, back) not in _twiddles:
        root = pow(GENERATOR[prime], (prime - 1) // (2 * half), prime)
        if back:
            root = pow(root, -1, prime)
        out = np.ones(half, U)
        n = 1
        while n < half:  # doubled: out[n:2n] = out[:n] * root**n
            out[n : 2 * n] = out[: min(n, half - n)] * U(pow(root, n, prime)) % U(prime)
            n *= 2
        _twiddles[prime, half, back] = out
    return _twiddles[prime, half, back]


def _reduced(x: np.ndarray, p: np.uint64) -> np.ndarray:
    """x modulo p for x < 2 * p: below p, x - p wraps round to a huge number."""
    return np.minimum(x, x - p)


def transform(x: np.ndarray, prime: int) -> np.ndarray:
    """The number-theoretic transform of each row, in bit-reversed order."""
    p, (m, size) = U(prime), x.shape
    half = size // 2
    while half:
        pair = x.reshape(m, -1, 2, half)
        a, b = pair[:, :, 0], pair[:, :, 1]
        new = np.empty_like(pair)
        new[:, :, 0] = _reduced(a + b, p)
        new[:, :, 1] = (a + (p - b)) * _roots(prime, half, False) % p
        x, half = new.reshape(m, size), half // 2
    return x


def transform_back(x: np.ndarray, prime: int) -> np.ndarray:
    """The inverse of transform."""
    p, (m, size) = U(prime), x.shape
    half = 1
    while half < size:
        pair = x.reshape(m, -1, 2, half)
        a, b = pair[:, :, 0], pair[:, :, 1] * _roots(prime, half, True) % p
        new = np.empty_like(pair)
        new[:, :, 0] = _reduced(a + b, p)
        new[:, :, 1] = _reduced(a + (p - b), p)
        x, half = new.reshape(m, size), 2 * half
    return x * U(pow(size, -1, prime)) % p


def squared_differences(blocks: np.ndarray, windows: np.ndarray, prime: int) -> np.ndarray:
    """Modulo prime, for each row and each place of its block of B numbers in its window of 2 * B: the sum of squared differences."""
    p, (m, b) = U(prime), blocks.shape
    x, y = np.zeros((m, 2 * b), U), windows.astype(U) % p
    x[:, 0], x[:, b + 1 :] = blocks[:, 0], blocks[:, :0:-1]  # the block turned round
    x %= p
    dot = transform_back(transform(x, prime) * transform(y, prime) % p, prime)[:, :b]
    own = (x * x % p).sum(1) % p
    run = np.zeros((m, 2 * b + 1), U)
    np.cumsum(y * y % p, axis=1, out=run[:, 1:])
    there = (run[:, b : 2 * b] - run[:, :b]) % p
    return (own[:, None] + there + (p - dot) * U(2)) % p


def _direct(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and block numbers, in this order, of the zero sums of all blocks, sums written out."""
    n = len(ids) // size * size
    far, near = [], []
    for d in range(size, 2 * size):
        off = np.ones(n, bool)
        m = min(n, len(ids) - d)
        step = ids[:m] - ids[d : d + m]
        off[:m] = step * step != 0
        hit = np.flatnonzero(~off.reshape(-1, size).any(1))
        far.append(np.full(len(hit), d))
        near.append(hit)
    return np.concatenate(far), np.concatenate(near)


def _convolved(ids: np.ndarray, size: int, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of some blocks, by transforms."""
    padded = np.append(ids, ids.max() + 1 + np.arange(3 * size))  # numbers of their own: they equal nothing
    far, near = [], []
    step = max(1, CELLS // (2 * size))
    for k in range(0, len(blocks), step):
        at = blocks[k : k + step] * size
        x, y = padded[at[:, None] + np.arange(size)], padded[at[:, None] + np.arange(size, 3 * size)]
        zero = np.ones(x.shape, bool)
        for prime in PRIMES:
            zero &= squared_differences(x, y, prime) == 0
        row, d = np.nonzero(zero)
        far.append(d + size)
        near.append(blocks[k + row])
    d, j = np.concatenate(far), np.concatenate(near)
    order = np.lexsort((j, d))
    return d[order], j[order]


class Later:
    """Where words come again."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.order, self.wide = ids, np.argsort(ids, kind="stable"), len(ids) + 1
        self.keys = ids[self.order] * self.wide + self.order

    def within(self, at: np.ndarray, least: int, most: int) -> np.ndarray:
        """Whether the words at these places come again least to most - 1 words later."""
        wanted = self.ids[at] * self.wide + at
        k = np.minimum(np.searchsorted(self.keys, wanted + least), len(self.keys) - 1)
        return (self.keys[k] >= wanted + least) & (self.keys[k] < wanted + most) & (self.ids[self.order[k]] == self.ids[at])


def _open_blocks(later: Later, size: int, runs: np.ndarray) -> np.ndarray:
    """Blocks all whose words come again in time, less those inside a run of a smaller scale."""
    blocks = np.arange(len(later.ids) // size)
    if len(runs):
        by_start = runs[np.argsort(runs[:, 0], kind="stable")]
        reach, k = np.maximum.accumulate(by_start[:, 1]), np.searchsorted(by_start[:, 0], blocks * size, "right") - 1
        blocks = blocks[(k < 0) | (reach[k] < blocks * size + 3 * size)]
    tried, step = 0, 1
    while tried < size and len(blocks):  # one word of each block, then twice as many of the blocks left, ...
        offsets = np.arange(tried, min(size, tried + step))
        at = blocks[:, None] * size + offsets
        blocks = blocks[later.within(at.ravel(), size, 2 * size).reshape(at.shape).all(1)]
        tried, step = tried + step, 2 * step
    return blocks


class Prefixes:
    """Hashes of prefixes, for how far two places agree. A hash can only make that too long, never too short."""

    def __init__(self, ids: np.ndarray):
        power = np.full(len(ids) + 1, BASE, U)
        power[0] = 1
        self.power = np.cumprod(power, dtype=U)
        self.sums = np.zeros(len(ids) + 1, U)
        np.cumsum(mix(ids.astype(U) + U(1)) * self.power[:-1], dtype=U, out=self.sums[1:])

    def _equal(self, a: np.ndarray, d: np.ndarray, n: np.ndarray) -> np.ndarray:
        s = self.sums
        return (s[a + n] - s[a]) * self.power[d] == s[a + d + n] - s[a + d]

    def agree(self, a: np.ndarray, d: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words from a on (or before a) equal those d later."""
        low, high = np.zeros_like(a), a.copy() if back else len(self.sums) - 1 - a - d
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self._equal(a - middle if back else a, d, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low


def _stretch(ids: np.ndarray, at: int, d: int) -> tuple[int, int]:
    """The whole stretch with period d about the equal words at `at` and at + d, word by word."""
    off = np.flatnonzero(ids[:-d] != ids[d:])
    k = int(np.searchsorted(off, at))
    return (int(off[k - 1]) + 1 if k else 0), (int(off[k]) + d if k < len(off) else len(ids))


def all_runs(ids: np.ndarray, min_exponent: int = MIN_EXPONENT, min_words: int = MIN_WORDS) -> np.ndarray:
    """Rows (start, end, period) of the runs of a list of numbers (int64, not negative), by start, then period."""
    if min_exponent < 4:
        raise ValueError("blocks show runs of four periods and more")
    found, n, size = np.zeros((0, 3), np.int64), len(ids), 1
    later = prefixes = None
    while 4 * size <= n:
        if size < DIRECT:
            d, j = _direct(ids, size)
        else:
            later = later or Later(ids)
            blocks = _open_blocks(later, size, found)
            d, j = _convolved(ids, size, blocks) if len(blocks) > 1 else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if len(d):
            fresh = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (j[1:] != j[:-1] + 1)))
            count = np.diff(np.append(fresh, len(d)))
            d, j = d[fresh], j[fresh]
            # a chain's words agree on fewer than count + 2 blocks, and a run's on three periods at least
            long = (count > 1) & ((count + 2) * size > 3 * d)
            d, at = d[long], j[long] * size
            if len(d):
                prefixes = prefixes or Prefixes(ids)
                start, end = at - prefixes.agree(at, d, back=True), at + prefixes.agree(at, d) + d
                new = _long_enough(start, end, d, min_exponent, min_words)
                if not all(np.array_equal(ids[s : e - q], ids[s + q : e]) for s, e, q in new.tolist()):  # a hash was wrong
                    start, end = np.array([_stretch(ids, *x) for x in zip(at.tolist(), d.tolist())]).T
                    new = _long_enough(start, end, d, min_exponent, min_words)
                found = _least_periods(np.concatenate((found, new)))
        size *= 2
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _long_enough(start: np.ndarray, end: np.ndarray, d: np.ndarray, min_exponent: int, min_words: int) -> np.ndarray:
    return _least_periods(np.stack((start, end, d), 1)[end - start >= np.maximum(min_words, min_exponent * d)])


def _least_periods(runs: np.ndarray) -> np.ndarray:
    """Of the rows of one start and end that with the least period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    if not len(runs):
        return runs
    return runs[np.append(True, (runs[1:, :2] != runs[:-1, :2]).any(1))]


def runs_of(words: Words, min_exponent: int = MIN_EXPONENT, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Rows (start, length, period) of the runs of many texts, by text, start and period, and each one's text. Starts count from the text's first word."""
    n_texts = len(words.first) - 1
    place = np.arange(len(words)) + words.text  # after each text stands a number that comes nowhere else
    ids = np.arange(len(words) + n_texts, dtype=np.int64) + len(words)
    ids[place] = np.unique(words.hashes(), return_inverse=True)[1]
    runs = all_runs(ids, min_exponent, min_words)
    text = np.searchsorted(words.first[1:] + np.arange(n_texts), runs[:, 0], "right")
    return np.stack((runs[:, 0] - words.first[text] - text, runs[:, 1] - runs[:, 0], runs[:, 2]), 1), text


def dropped(words: Words, runs: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which words lie in a run after its first period."""
    step = np.zeros(len(words) + 1, np.int64)
    start = words.first[text] + runs[:, 0]
    np.add.at(step, start + runs[:, 2], 1)
    np.add.at(step, start + runs[:, 1], -1)
    return np.cumsum(step[:-1]) > 0


def _found(column: pa.Array, min_exponent: int, min_words: int) -> Iterator[tuple[int, Words, np.ndarray, np.ndarray, np.ndarray]]:
    """For some texts at a time: the number of the first, the words, runs with each one's text, and which words are dropped."""
    data, offsets = text_bytes(column)
    for lo, hi in row_chunks(offsets):
        words = words_of(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        runs, text = runs_of(words, min_exponent, min_words)
        yield lo, words, runs, text, dropped(words, runs, text)


def _joined(words: Words, keep: np.ndarray) -> list[bytes]:
    """Each text's kept words joined by one space."""
    start, end, text = words.start[keep], words.end[keep], words.text[keep]
    out_end = np.cumsum(end - start + 1)  # of each word and the space after it
    take = np.arange(out_end[-1] if len(out_end) else 0) + np.repeat(start - (out_end - (end - start + 1)), end - start + 1)
    flat = words.data[np.minimum(take, max(0, len(words.data) - 1))]
    flat[out_end - 1] = 32
    raw, bounds = flat.tobytes(), np.append(0, out_end)[np.searchsorted(text, np.arange(len(words.first)))].tolist()
    return [raw[a : max(a, b - 1)] for a, b in zip(bounds[:-1], bounds[1:])]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_exponent: int = MIN_EXPONENT, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per run: the id of its document, start (the number of its first word, from 0), length and period in words."""
    bounded_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, runs, text, _ in _found(batch.column(1), min_exponent, min_words):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text + lo)), *map(pa.array, np.ascontiguousarray(runs.T))], [id_col, "start", "length", "period"])

    two = docs.select(col(id_col), col(text_col))
    return map_batches(two, scan, f"{quoted(id_col)} {two.dtypes[0][1]}, start long, length long, period long")


def collapse_runs(docs: DataFrame, text_col: str = "text", min_exponent: int = MIN_EXPONENT, min_words: int = MIN_WORDS) -> DataFrame:
    """docs; of texts with runs only the words that no run holds after its first period, joined by one space. Other texts stay as they are."""
    bounded_batches(docs.sparkSession)
    names = docs.columns
    place = names.index(text_col)

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            out = columns[place].to_pylist()
            for lo, words, _, text, gone in _found(columns[place], min_exponent, min_words):
                if len(text):
                    made = _joined(words, ~gone)
                    for k in set(text.tolist()):
                        out[lo + k] = made[k].decode()
            columns[place] = pa.array(out, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return map_batches(docs, collapse, docs.schema)


REPORT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _strongest(runs: np.ndarray) -> tuple[int, int, int, int]:
    """(start, length, period, exponent in thousandths) of the run of most periods; ties to the first, then the shorter period."""
    ratio = runs[:, 1] / runs[:, 2]
    near = runs[ratio >= ratio.max() * (1 - 1e-12)].tolist()  # as doubles round, the last word is had by fractions
    start, length, period = min(near, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]))
    return start, length, period, 1000 * length // period


def run_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_exponent: int = MIN_EXPONENT, min_words: int = MIN_WORDS) -> DataFrame:
    """Per row of docs: its id, the number of runs, the strongest one, and digests of all runs and of the collapsed text."""
    bounded_batches(docs.sparkSession)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for _, words, runs, text, gone in _found(batch.column(1), min_exponent, min_words):
                first = np.searchsorted(text, np.arange(len(words.first))).tolist()
                for made, a, b in zip(_joined(words, ~gone), first[:-1], first[1:]):
                    lines = b"".join(b"%d,%d,%d\n" % tuple(x) for x in runs[a:b].tolist())
                    rows.append((b - a, *(_strongest(runs[a:b]) if b > a else (None,) * 4), hashlib.sha256(lines).hexdigest(), hashlib.sha256(made).hexdigest()))
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64() if k < 5 else pa.string()) for k, c in enumerate(columns))], [id_col, *(x.split()[0] for x in REPORT.split(", "))])

    two = docs.select(col(id_col), col(text_col))
    return map_batches(two, report, f"{quoted(id_col)} {two.dtypes[0][1]}, {REPORT}")


def periodic_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with planted runs: for a tenth of the documents, by the checksum of the id, the words from one on repeat with a period.

    A row without an id has no checksum and stays as it is.
    """
    bounded_batches(docs.sparkSession)

    def planted(doc_id: int | None, text: str) -> str:
        h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h % 10 or not text:
            return text
        raw = text.encode()
        words = words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        if not (n := len(words)):
            return text
        g = h // 10
        a = g % n
        take = np.append(np.arange(a), a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8)))
        return _joined(Words(words.data, words.start[take], words.end[take], words.first, words.text), np.ones(n, bool))[0].decode()

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [planted(i, t) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["doc_id", "text"])

    return map_batches(docs.select("doc_id", "text"), rewrite, "doc_id long, text string")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_report(periodic_tails(documents(spark, sf_dir)))


#: Words that agree at a distance show as windows of five words that agree: a run agrees on five words or more.
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws, {CRC32_SQL.format('doc_id')} AS h FROM documents),
x AS (SELECT r, doc_id, ws, len(ws) AS n, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a, 3 + (h // 10) % 8 AS k FROM d),
t AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // k) END]) END AS ws FROM x),
g AS (SELECT r, n, i, array_to_string(ws[i + 1:i + 5], ' ') AS five FROM (SELECT r, n, ws, unnest(range(n - 4)) AS i FROM t WHERE n > 5) z),
p AS (SELECT a.r, a.i, b.i - a.i AS d FROM g a JOIN g b ON a.r = b.r AND a.five = b.five AND a.i < b.i AND 4 * (b.i - a.i) <= a.n),
s AS (SELECT r, d, i, i - row_number() OVER (PARTITION BY r, d ORDER BY i) AS island FROM p),
u AS (SELECT r, d, min(i) AS start, count(*) + 4 + d AS length FROM s GROUP BY r, d, island),
v AS (SELECT r, start, length, min(d) AS period FROM u WHERE length >= greatest(6, 4 * d) GROUP BY r, start, length),
best AS (SELECT r, count(*) AS n_runs, arg_min({{'start': start, 'length': length, 'period': period}}, place) AS b,
    sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256
    FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS place FROM v) z GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM v),
w AS (SELECT r, unnest(range(n)) AS i, unnest(ws) AS word FROM t),
c AS (SELECT w.r, sha256(coalesce(string_agg(word, ' ' ORDER BY w.i) FILTER (gone.i IS NULL), '')) AS collapsed_sha256 FROM w LEFT JOIN gone ON w.r = gone.r AND w.i = gone.i GROUP BY w.r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(b.start AS BIGINT) AS start, CAST(b.length AS BIGINT) AS length, CAST(b.period AS BIGINT) AS period, CAST(1000 * b.length // b.period AS BIGINT) AS exponent_milli,
  coalesce(runs_sha256, sha256('')) AS runs_sha256, coalesce(collapsed_sha256, sha256('')) AS collapsed_sha256
FROM t LEFT JOIN best ON t.r = best.r LEFT JOIN c ON t.r = c.r
"""
