"""Texts with tabs, carriage returns, odd white space and special marks: whole texts by the library, time and memory."""

import random
import time

import pyarrow as pa
import pytest

from figshelf.llm import tokens
from figshelf.llm.tokens import Encoder

public = pytest.importorskip("public_tokenizers")
NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


def code(n, seed=0, tab="\t", end="\r\n"):
    """Lines of indented code."""
    rng = random.Random(seed)
    words = [f"name{i}" for i in range(3000)] + ["if", "é", "日本", "=", "==", "(x)", "{", "};", "'s", "it's", "100"]
    lines = []
    while sum(map(len, lines[-1000:])) * max(1, len(lines) / 1000) < n:
        lines += [tab * rng.randrange(4) + " ".join(rng.choice(words) for _ in range(rng.randrange(1, 12))) for _ in range(1000)]
    return end.join(lines)[:n]


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("stretch", [tokens.STRETCH, 300])
def test_equals_the_library(name, stretch, monkeypatch):
    monkeypatch.setattr(tokens, "STRETCH", stretch)
    monkeypatch.setattr(tokens.Encoder.pieces, "__defaults__", (stretch,))
    e, rng = Encoder(public.path(name)), random.Random(1)
    texts = [code(5000, 1), code(5000, 2, "    ", "\n"), code(5000, 3, "\t", "\n"), "a\tb\tc\r\n" * 300, "\r\n\r\n\t\tx", "a <|endoftext|> b c <| d", "x<|endoftext|>y " * 100, "\t", "\t\t", " \t a", "a \t", "a\t ", "a 　b", "日本　語 " * 200, "a\x0bb\x0cc\x1cd"]
    texts += ["".join(rng.choice(["ab", "a", "B9", "é", "日", "'s", ".", ",", " ", " ", "  ", "\n", "\t", "\r\n", "\r", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "<|", "<|endoftext|>", "|>"]) for _ in range(rng.randrange(80))) for _ in range(1500)]
    want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # the second time from what is remembered
        for t, got, ids in zip(texts, e.encode_column(pa.array(texts)), want, strict=True):
            assert got.tolist() == ids, repr(t)


@pytest.mark.parametrize("name", NAMES)
def test_one_odd_character_costs_little(name):
    """6 MB of clean text, of the same with a tab and a mark in it, and of indented code: equal, and not much slower."""
    clean = code(6 << 20, 4, "", "\n")
    half = clean.index(" ", len(clean) // 2)
    took = {}
    for kind, text in (("clean", clean), ("one", clean[:half] + " <|endoftext|>\tx" + clean[half:]), ("code", code(6 << 20, 5))):
        e = Encoder(public.path(name))
        begun = time.process_time()
        got = next(e.encode_column(pa.array([text])))
        took[kind] = time.process_time() - begun
        if kind != "clean":
            assert got.tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids
    assert took["one"] < 1.5 * took["clean"] + 0.5 and took["code"] < 6 * took["clean"] + 1, took


def _peaks():
    import resource

    peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
    out = {}
    for kind, made in (("clean", code(1 << 20, 6, "", "\n") * 32), ("code", code(1 << 20, 7) * 32)):
        column = pa.array([made])
        begun = peak()
        assert len(next(Encoder(public.path(NAMES[1])).encode_column(column))) > 0
        out[kind] = peak() - begun
    return out


def test_memory_of_indented_code():
    """32 MB of text, in a process of its own."""
    import multiprocessing

    with multiprocessing.get_context("spawn").Pool(1) as pool:
        peaks = pool.apply(_peaks)
    assert peaks["clean"] < 900 and peaks["code"] < 900, peaks
