"""Licence scans against a scanner of their own that looks everything up by plain search."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from figshelf.llm import licences

SENTENCES, RULES, GAP = dict(licences.SENTENCES), [(name, ids.split(" ")) for name, ids in licences.RULES], licences.MAX_GAP
SF = "/root/testdata/sf0.01"


def plain(text):
    """Lower-case words with single spaces."""
    return " ".join("".join(c if c.isalnum() else " " for c in text.lower()).split())


def without_leader(line):
    """A line without the comment mark or list mark that it begins with."""
    body = line.lstrip()
    for mark in ("<!--", "/*", "*/", "//"):
        if body.startswith(mark):
            body = body[len(mark) :]
            return body.lstrip("*").lstrip() if mark == "/*" else body.lstrip()
    for run in "*#;-":
        stripped = body.lstrip(run)
        n = len(body) - len(stripped)
        if n and (run != "-" or n > 1):
            return (stripped[1:] if run == "*" and stripped.startswith("/") else stripped).lstrip()
    head = body.split(".", 1)[0]
    if head.isdecimal() and len(head) < len(body):
        return body[len(head) + 1 :].lstrip()
    if len(body) > 2 and body[0] == "(" and body[2] == ")" and (body[1].isalnum() or body[1] == "_"):
        return body[3:].lstrip()
    return body


def cut(text):
    """(words, begin) of each fragment, a character at a time."""
    out, at = [], 0
    for line in text.split("\n"):
        body = without_leader(line)
        begin = at + len(line) - len(body)
        piece = ""
        for k, c in enumerate(body):
            piece += c
            if c in ".;:!?" and (k + 1 == len(body) or body[k + 1].isspace()) or k + 1 == len(body):
                if plain(piece):
                    out.append((plain(piece), begin + k + 1 - len(piece)))
                piece = ""
        at += len(line) + 1
    return out


def scan(text):
    """(licence, begin, sentences) of the matches, and how many known sentences no rule takes."""
    known = {" ".join(w for w, _ in cut(s)): name for name, s in SENTENCES.items()}
    longest = max(len(s.split(" ")) for s in known)
    parts, ids, i = cut(text), [], 0
    while i < len(parts):
        best, joined = None, ""
        for j in range(i, len(parts)):
            joined = f"{joined} {parts[j][0]}".strip()
            if joined in known:
                best = (known[joined], i, j + 1)
            if joined.count(" ") >= longest:
                break
        if best:
            ids.append((*best, parts[i][1]))
        i = best[2] if best else i + 1
    found, free, i = [], 0, 0
    while i < len(ids):
        fitting = []
        for name, rule in RULES:
            mine = ids[i : i + len(rule)]
            if [x[0] for x in mine] == rule and not [1 for a, b in zip(mine, mine[1:]) if b[1] - a[2] > GAP]:
                fitting.append((len(rule), name))
        if fitting:
            most = max(n for n, _ in fitting)
            found.append((next(name for n, name in fitting if n == most), ids[i][3], most))
        free += not fitting
        i += max((n for n, _ in fitting), default=1)
    return found, free


def cases():
    rng = random.Random(7)
    names = list(SENTENCES)
    filler = ["Some words in between.", "Copyright (c) 2020 Somebody", "and more", "The end; or not."]
    wrap = lambda s, mark: "".join((f" " if rng.random() < 0.85 else f"\n{mark} ") + w for w in s.split(" ")).strip()  # noqa: E731, F541
    for _, rule in RULES:  # every rule: as it is, wrapped in a comment, with gaps around the limit
        yield "\n".join(SENTENCES[i] for i in rule)
        yield "# " + "\n# ".join(wrap(SENTENCES[i], "#") for i in rule)
        for gap in (GAP, GAP + 1):
            yield ("\n" + "\n".join(["Not a known one."] * gap) + "\n").join(SENTENCES[i] for i in rule)
        yield "\n".join(SENTENCES[i] for i in rule[:-1])
        yield "\n".join(SENTENCES[i] for i in reversed(rule))
        cut_short = SENTENCES[rule[0]].split(" ")[:-2]
        yield " ".join(cut_short) + "\n" + "\n".join(SENTENCES[i] for i in rule)  # a beginning of a sentence, then the sentence
    for _ in range(300):  # anything after anything
        yield "\n".join(rng.choice([SENTENCES[rng.choice(names)], wrap(SENTENCES[rng.choice(names)], "//"), SENTENCES[rng.choice(names)].upper(), rng.choice(filler)]) for _ in range(rng.randint(1, 8)))


def test_every_rule_and_mixture():
    met = Counter()
    for text in cases():
        got = licences.licences(text)
        assert got == scan(text), text
        met.update(name for name, _, _ in got[0])
    assert set(met) == {name for name, _ in RULES}
    assert {i for _, rule in RULES for i in rule} == set(SENTENCES)


@pytest.mark.parametrize("text", ["", "\n", "   ", "SPDX-License-Identifier: MIT", "(c) SPDX-License-Identifier: MIT\n", "x" * 100_000, "license. " * 20_000])
def test_odd_texts(text):
    assert licences.licences(text) == scan(text)


def test_query_equals_the_scanner(spark):
    """op3_licences over its whole table."""
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        found, free = scan(r["text"] or "")
        want[r["doc_id"]] = (len(found), sum(n for _, _, n in found), free, ",".join(sorted({x for x, _, _ in found})), found[0][1] if found else None)
    got = {r["doc_id"]: tuple(r)[1:] for r in licences.op3_licences(spark, SF).select("doc_id", "n_matches", "n_sentences", "n_unmatched", "licences", "first_begin").collect()}
    assert got == want and sum(n > 0 for n, *_ in got.values()) > 20


def test_a_very_long_text(spark):
    text = "words of no licence here. " * 400_000 + "\n" + SENTENCES["mit-name"]
    row = licences.licence_scan(spark.range(1).select(F.lit(1).alias("doc_id"), F.lit(text).alias("text"))).first()
    assert (row["licences"], row["first_begin"]) == ("MIT", len(text) - len(SENTENCES["mit-name"]))
