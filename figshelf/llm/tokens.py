"""Token ids of whole texts by the tokenizers library, with chunks of text encoded once and remembered.

Where a tokenizer's pre-tokenizer never lets a token cross certain places (the two kinds below), the ids of a
text are the ids of the chunks between these places in order, so the library sees each distinct chunk once.
Texts are cut as byte arrays and numbered by Arrow's dictionary encoding; Python handles distinct chunks only.
White space that libraries class differently, and the mark of a special token, are encoded with what stands
about them between two places that are safe whatever they are, and the rest of the text as ever; a text of any other tokenizer is
encoded whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from figshelf.llm.common import row_chunks, text_bytes
from figshelf.llm.words import LOWER

REMEMBERED, LONGEST, STRETCH, TOGETHER = 500_000, 64, 2 << 20, 400
SPACE, LINE, QUOTE = 32, 10, 39
# White space of Python or Unicode other than the space and \\n, in UTF-8.
ODD_ASCII = [9, 11, 12, 13, 28, 29, 30, 31]
ODD_WIDE = ["\x85", "\xa0", " ", *map(chr, range(0x2000, 0x200B)), " ", " ", " ", " ", "　"]
IS_ODD = np.zeros(256, bool)
IS_ODD[ODD_ASCII] = True
LETTER, MARK, LATIN, ENDS_WORD = (np.zeros(256, bool) for _ in range(4))
STARTS_ODD = tuple(bytes([x]) for x in ODD_ASCII) + tuple(c.encode() for c in ODD_WIDE) + tuple(b" " + bytes([x]) for x in ODD_ASCII)
ENDS_WORD[[9, 10, 11, 12, 13, SPACE]] = True
LETTER[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
MARK[33:127] = ~LETTER[33:127]
MARK[QUOTE] = False  # binds to what follows, as in 's
LATIN[0xC3:0xC9] = True  # lead bytes of U+00C0 to U+023F, all letters but two


def _rows_with(hits: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which rows one of the places `hits` lies in."""
    found = np.zeros(len(offsets) - 1, bool)
    if len(hits):
        found[np.searchsorted(offsets, hits, "right") - 1] = True
    return found


class Encoder:
    """One per Python worker and tokenizer file."""

    _made: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.spaces = self._spaces(json.loads(self.tokenizer.to_str()))
        self.between = {"kept": "\n", "dropped": " | "}.get(self.spaces)
        if self.between:
            (self.between_id,) = self.tokenizer.encode(self.between, add_special_tokens=False).ids
        self.memo: dict[bytes, int] = {}  # chunk -> its number
        self.start, self.size, self.hits, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.dtype)

    @staticmethod
    def _spaces(made: dict) -> str | None:
        """kept: byte-level chunks that begin with at most one space; dropped: white space only parts words."""
        pre, model = made["pre_tokenizer"] or {}, made["model"]
        if any(not x["content"].startswith("<|") or len(x["content"].split()) != 1 or x["content"] != x["content"].strip() or x["lstrip"] or x["rstrip"] for x in made["added_tokens"]):
            return None
        if model["type"] != "BPE" or made["post_processor"] and made["post_processor"]["type"] not in ("ByteLevel",) or model.get("dropout"):
            return None
        if pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not made["normalizer"]:
            return "kept"
        if pre.get("type") == "Sequence" and len(both := pre["pretokenizers"]) == 2 and both[0]["type"] == "Split" and both[1]["type"] == "ByteLevel":
            split, steps = both[0], (made["normalizer"] or {}).get("normalizers", [])
            local = all(x["type"] in ("NFC", "Lowercase") or x["type"] == "Replace" and x["pattern"] == {"Regex": "\\s+"} for x in steps)
            local = local and "Lowercase" in {x["type"] for x in steps}
            if local and split["behavior"] == "Removed" and split["invert"] and not both[1]["use_regex"] and not both[1]["add_prefix_space"] and r"[^\s\p{L}\p{N}]+" in split["pattern"].get("Regex", ""):
                return "dropped"
        return None

    def _hits(self, data: np.ndarray) -> np.ndarray:
        """Places of what libraries class differently, in order: what stands there is encoded with its surroundings, in one piece."""
        hits = [np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))]
        if self.spaces == "kept":
            hits.append(np.flatnonzero(IS_ODD[data]))
            leads = {}
            for c in ODD_WIDE:
                leads.setdefault(c.encode()[0], []).append(c.encode()[1:])
            for lead, tails in leads.items():
                at = np.flatnonzero(data[:-1] == lead)
                for tail in tails if len(at) else ():
                    here = at[at + len(tail) < len(data)]
                    hits.append(here[np.logical_and.reduce([data[here + k + 1] == x for k, x in enumerate(tail)])])
        return np.unique(np.concatenate(hits))

    def _safe(self, data: np.ndarray) -> np.ndarray:
        """Places where a text can be cut in two whatever else is in it: white space that ends a word of ASCII letters or digits.

        No token goes on from a letter into white space, and what follows is read from the white space on. Where white space only parts
        words, a single space between two letters.
        """
        if self.spaces == "kept":
            return 1 + np.flatnonzero(LETTER[data[:-1]] & ENDS_WORD[data[1:]])
        return 1 + np.flatnonzero(LETTER[data[:-2]] & (data[1:-1] == SPACE) & LETTER[data[2:]])

    def pieces(self, data: np.ndarray, offsets: np.ndarray, most: int = STRETCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Offsets of pieces of the rows, the row of each, and whether it is to be encoded whole.

        Rows of more than 2 * most bytes are cut into stretches before single spaces; about each hit a piece from one safe place to the next is
        cut out, however long its row.
        """
        n = len(offsets) - 1
        if self.spaces is None or not len(data):
            return offsets, np.arange(n), np.ones(n, bool)
        hits, chosen = self._hits(data), []
        if len(hits):
            safe = np.concatenate(([0], self._safe(data), [len(data)]))
            k, j = np.searchsorted(safe, hits, "right"), np.searchsorted(offsets, hits, "right")
            chosen += [np.maximum(safe[k - 1], offsets[j - 1]), np.minimum(safe[np.minimum(k, len(safe) - 1)], offsets[j])]
        with_hits = _rows_with(hits, offsets)
        for row in np.flatnonzero(np.diff(offsets) > 2 * most).tolist():
            begin, end = int(offsets[row]), int(offsets[row + 1])
            body = data[begin:end]
            if with_hits[row]:
                places = begin + self._safe(body)
            else:
                gap = (body[1:-1] == SPACE) & (body[:-2] != SPACE) & (body[:-2] != LINE) & (body[2:] != SPACE) & (body[2:] != LINE)
                places = begin + 1 + np.flatnonzero(gap)
            at = np.unique(np.searchsorted(places, np.arange(begin + most, end - most, most)))
            chosen.append(places[at[at < len(places)]])
        inner = np.setdiff1d(np.concatenate(chosen), offsets) if chosen else np.zeros(0, np.int64)
        row, cut = np.concatenate((np.arange(n), np.searchsorted(offsets, inner, "right") - 1)), np.concatenate((offsets[:-1], inner))
        order = np.lexsort((cut, row))
        row, cuts = row[order], np.append(cut[order], offsets[-1])
        return cuts, row, _rows_with(hits, cuts)

    def _cuts(self, data: np.ndarray, offsets: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Where chunks begin. No token of the library's crosses such a place."""
        n = len(data)
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        first = first[:n]
        white = (data == SPACE) | (data == LINE)
        before = np.empty(n, bool)  # white space before, in the same row
        before[0] = False
        before[1:] = white[:-1]
        before &= ~first
        cut = white & ~before | first
        word = np.flatnonzero(~white & before)
        if self.spaces == "kept":  # the last space of a run goes to the word
            cut[word - 1] = True
            cut[word[data[word - 1] == LINE]] = True
        else:
            cut[word] = True
        # between letters or digits and marks other than the quote
        latin = np.zeros(n, bool)
        latin[1:] = LATIN[data[:-1]] & ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
        ends_letter, begins_letter = LETTER[data] | latin, LETTER[data].copy()
        begins_letter[:-1] |= latin[1:]
        mark = MARK[data]
        cut[1:] |= ends_letter[:-1] & mark[1:] | mark[:-1] & begins_letter[1:]
        if whole.any():
            cut[np.repeat(whole, np.diff(offsets))] = False
            cut[offsets[:-1][np.diff(offsets) > 0]] = True
        return np.flatnonzero(cut)

    def _encoded(self, chunks: list[bytes]) -> list[np.ndarray]:
        """The ids of each chunk; chunks are handed to the library many at a time, parted by a text of one id."""
        out: list[np.ndarray | None] = [None] * len(chunks)
        mark = self.between.strip(" ").encode() if self.between else b""
        together = [i for i, c in enumerate(chunks) if self.between and len(c) <= LONGEST and mark not in c and b"<|" not in c and c.strip(b" \n") and not c.startswith(STARTS_ODD)]
        groups = [together[k : k + TOGETHER] for k in range(0, len(together), TOGETHER)]
        texts = [self.between.encode().join([chunks[i] for i in group]).decode() for group in groups]
        for lo in range(0, len(texts), 16):
            for group, made in zip(groups[lo : lo + 16], self.tokenizer.encode_batch_fast(texts[lo : lo + 16], add_special_tokens=False)):
                ids = np.array(made.ids, self.dtype)
                at = np.flatnonzero(ids == self.between_id)
                if len(at) == len(group) - 1:
                    for i, a, b in zip(group, [0, *(at + 1).tolist()], [*at.tolist(), len(ids)]):
                        out[i] = ids[a:b]
        rest = [i for i, made in enumerate(out) if made is None]
        lo = 0
        while lo < len(rest):  # many to a call, but not many long ones
            hi, size = lo, 0
            while hi < len(rest) and (hi == lo or hi - lo < TOGETHER and size < 1 << 16):
                size += len(chunks[rest[hi]])
                hi += 1
            for i, made in zip(rest[lo:hi], self.tokenizer.encode_batch_fast([chunks[i].decode() for i in rest[lo:hi]], add_special_tokens=False)):
                out[i] = np.array(made.ids, self.dtype)
            lo = hi
        return out

    def _forget(self) -> None:
        """Keep what came back most, if too much is remembered."""
        if len(self.size) <= REMEMBERED and len(self.flat) <= 16 * REMEMBERED:
            return
        keep = np.flatnonzero((self.hits > 1) & (self.size <= LONGEST))
        if len(keep) > REMEMBERED // 2:
            keep = np.sort(keep[np.argpartition(-self.hits[keep], REMEMBERED // 2)[: REMEMBERED // 2]])
        flat = self._gather(keep)
        number = np.full(len(self.size), -1)
        number[keep] = np.arange(len(keep))
        self.memo = {c: int(k) for c, i in self.memo.items() if (k := number[i]) >= 0}
        self.size, self.hits, self.flat = self.size[keep], self.hits[keep] // 2, flat
        self.start = np.cumsum(self.size) - self.size

    def _gather(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of chunks by their numbers, end to end."""
        size = self.size[numbers]
        total = int(size.sum())
        shift = self.start[numbers] - (np.cumsum(size) - size)
        return self.flat[np.repeat(shift, size) + np.arange(total)]

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each distinct chunk; new ones are encoded."""
        get = self.memo.get
        numbers = np.array([get(w, -1) for w in words], np.int64)
        fresh = np.flatnonzero(numbers < 0)
        if len(fresh):
            new = [words[i] for i in fresh.tolist()]
            made = self._encoded(new)
            base, size = len(self.size), np.array([len(x) for x in made], np.int64)
            numbers[fresh] = base + np.arange(len(new))
            self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(size) - size))
            self.size, self.hits = np.concatenate((self.size, size)), np.concatenate((self.hits, np.zeros(len(new), np.int64)))
            self.flat = np.concatenate((self.flat, *made))
            self.memo.update((w, base + k) for k, w in enumerate(new) if len(w) <= LONGEST)
        self.hits[numbers] += 1
        return numbers

    def encode(self, data: np.ndarray, offsets: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of rows of UTF-8 end to end, and how many each row has."""
        if not len(data):
            return np.zeros(0, self.dtype), np.zeros(len(offsets) - 1, np.int64)
        self._forget()
        at = self._cuts(data, offsets, whole)
        end = np.append(at[1:], len(data))
        if self.spaces == "dropped":  # lower case comes to the same; white space gives no ids
            plain = np.maximum.reduceat(data, at) < 128
            in_whole = np.repeat(whole, np.diff(offsets))[at] if whole.any() else np.zeros(len(at), bool)
            data = np.where(np.repeat(plain & ~in_whole, end - at), LOWER[data], data)
        column = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = column.dictionary_encode()
        numbers = self._numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        before = np.append(0, np.cumsum(self.size[numbers]))
        edges = before[np.searchsorted(at, offsets)]
        return self._gather(numbers), np.diff(edges)

    def encode_column(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a string column; of null, none."""
        data, offsets = text_bytes(column)
        cuts, row, whole = self.pieces(data, offsets)
        last = np.append(row[1:] != row[:-1], True)  # of a row's pieces
        held: list[np.ndarray] = []
        for lo, hi in row_chunks(cuts, STRETCH):
            ids, n = self.encode(data[cuts[lo] : cuts[hi]], cuts[lo : hi + 1] - cuts[lo], whole[lo:hi])
            ends = np.cumsum(n)[last[lo:hi]].tolist()  # of the rows that end here
            for a, b in zip([0, *ends], ends):
                held.append(ids[a:b])
                yield held[0] if len(held) == 1 else np.concatenate(held)
                held = []
            if not last[hi - 1]:
                held.append(ids[ends[-1] if ends else 0 :])
