"""Words and word windows of many texts at once, as numpy arrays.

A word is a run of bytes other than space and \\t..\\r (the pattern `[^\\x20\\x09-\\x0D]+`), so
UTF-8 bytes and code points give the same words. Windows never cross from one text to the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

U = np.uint64
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
SEGMENT = 1 << 20  # bytes hashed at once
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finaliser)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _power() -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i <= SEGMENT."""
    if not _powers:
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            x = np.full(SEGMENT + 1, base, U)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=U)
    return _powers["up"], _powers["down"]


def _long_sum(word: np.ndarray) -> np.ndarray:
    """The sum of (byte + 1) * BASE**i over a word longer than SEGMENT."""
    up, total = _power()[0], np.zeros(1, U)
    for k in range(0, len(word), SEGMENT):
        part = word[k : k + SEGMENT]
        total += np.array([((part.astype(U) + U(1)) * up[: len(part)]).sum(dtype=U)]) * np.array([pow(BASE, k, 1 << 64)], U)
    return total


@dataclass
class Words:
    data: np.ndarray  # the bytes of all texts, end to end
    start: np.ndarray  # of each word, in data
    end: np.ndarray
    first: np.ndarray  # n_texts + 1: the index of each text's first word
    text: np.ndarray  # of each word: which text it is in

    def __len__(self) -> int:
        return len(self.start)

    @property
    def per_text(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        (up, down), out = _power(), np.empty(len(self), U)
        i = 0
        while i < len(self):  # words of one segment
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + SEGMENT, "right")))
            at = self.start[i]
            if self.end[j - 1] - at > SEGMENT:
                out[i:j] = _long_sum(self.data[at : self.end[i]])
            else:
                part = self.data[at : self.end[j - 1]]
                total = np.zeros(len(part) + 1, U)
                np.cumsum((part.astype(U) + U(1)) * up[: len(part)], out=total[1:])
                start = self.start[i:j] - at
                out[i:j] = (total[self.end[i:j] - at] - total[start]) * down[start]
            i = j
        return mix(out + (self.end - self.start).astype(U))

    def windows(self, size: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first words of all windows of `size` words, and a hash of each window."""
        if len(self) < size:
            return np.zeros(0, np.int64), np.zeros(0, U)
        n = len(self) - size + 1
        at = np.flatnonzero(self.text[:n] == self.text[size - 1 :])
        h = np.full(len(at), 0x2545F4914F6CDD1D, U)
        for k in range(size):
            h = mix(h * U(0xD6E8FEB86659FD93) + hashes[at + k])
        return at, h

    def span(self, a: int, b: int) -> bytes:
        """Words a to b (b excluded), joined by one space."""
        return b" ".join(bytes(self.data[s:e]) for s, e in zip(self.start[a:b].tolist(), self.end[a:b].tolist()))


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """The words of the texts data[offsets[i]:offsets[i + 1]]; lower: with A-Z lower-cased."""
    if lower:
        data = LOWER[data]
    inside = ~WHITE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    return Words(data, start, end, first, np.repeat(np.arange(len(offsets) - 1), np.diff(first)))


def covered(at: np.ndarray, size: int | np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in a window that starts at one of `at`."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + size, -1)
    return np.cumsum(step[:-1]) > 0


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which entries occur twice or more."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = k[1:] == k[:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice


def stretches(data: np.ndarray, overlap: int, lower: bool = False, most: int = SEGMENT) -> Iterator[tuple[int, Words]]:
    """One long text as runs of its words, of about `most` bytes: the number of the run's first word, and the run.

    Neighbours share `overlap` words, so that each window of overlap + 1 words lies in just one run.
    """
    at = number = 0
    while True:
        end = at + most
        while end < len(data) and not len(white := np.flatnonzero(WHITE[data[end : end + most]])):
            end += most  # a word longer than a stretch
        end = len(data) if end >= len(data) else end + int(white[0])
        words = words_of(data[at:end], np.array([0, end - at]), lower)
        if end < len(data) and len(words) <= overlap:  # no window ends here yet
            most = 2 * most
            continue
        yield number, words
        if end >= len(data):
            return
        number += len(words) - overlap
        at = at + int(words.start[len(words) - overlap]) if overlap else end
