"""Periodic runs, exact top-k search and the manifest against brute force, on odd rows, names and tables."""

import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from figshelf.llm import impact, manifest, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(x, exponent=4, least=6):
    """(start, length, period) of every maximal stretch, each with its smallest period."""
    found = {}
    for q in range(1, len(x) // exponent + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def odd_list(rng):
    kind, n = rng.randrange(4), rng.randrange(0, 300)
    if kind == 0:
        return [rng.randrange(2) for _ in range(n)]
    if kind == 1:  # runs inside runs
        x = []
        while len(x) < n:
            x += ([rng.randrange(3) for _ in range(rng.randrange(1, 40))] * rng.randrange(1, 9))[: rng.randrange(1, 400)]
        return x
    if kind == 2:  # long blocks of one word between others
        return (([0] * rng.randrange(1, 60) + [1]) * 12)[: rng.randrange(1, 600)]
    some = lambda m: [rng.randrange(50) for _ in range(rng.randrange(m))]
    return some(20) + some(100) * rng.randrange(3, 7) + some(20)


@pytest.mark.parametrize("direct", [runs.DIRECT, 1])
def test_runs_of_lists(direct, monkeypatch):
    monkeypatch.setattr(runs, "DIRECT", direct)
    rng = random.Random(direct)
    for _ in range(400):
        x = odd_list(rng)
        assert [(s, e - s, q) for s, e, q in runs.all_runs(np.array(x, np.int64)).tolist()] == brute_runs(x), x


def test_wrong_hashes_do_no_harm(monkeypatch):
    monkeypatch.setattr(runs, "mix", lambda x: x & np.uint64(0))  # all prefixes look alike
    rng = random.Random(5)
    for _ in range(100):
        x = odd_list(rng)
        assert [(s, e - s, q) for s, e, q in runs.all_runs(np.array(x, np.int64)).tolist()] == brute_runs(x)


def test_squared_differences():
    rng = np.random.default_rng(0)
    for b in (1, 2, 16, 64):
        x, y = rng.integers(0, 1000, (5, b)), rng.integers(0, 1000, (5, 2 * b))
        want = np.array([[((x[r] - y[r, d : d + b]) ** 2).sum() for d in range(b)] for r in range(5)])
        for prime in runs.PRIMES:
            assert (runs.squared_differences(x, y, prime) == want % prime).all()


RUN_TEXTS = [None, "", " \n", "a", "a a a a a", "a a a a a a", "x " + "b c " * 5 + "y", " ".join(map(str, range(300))), "é ü\t" * 40 + "end", "one two three " * 700 + "aa " * 9, "A a A a A a A a"]


def test_run_operators(spark):
    rows = [(i, t, "x", i) for i, t in enumerate(RUN_TEXTS)] + [(None, "q " * 8, "x", 0), (6, RUN_TEXTS[6], "x", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string, `odd.name` long").repartition(3)
    report = runs.run_report(docs).collect()
    assert len(report) == len(rows)
    by_id = dict((r[0], r[1]) for r in rows)
    collapsed = {r["doc_id"]: r["text"] for r in runs.collapse_runs(docs).collect()}
    listed = {}
    for r in runs.find_runs(docs).collect():
        listed.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["period"]))
    for r in report:
        words = WORD.findall(by_id[r["doc_id"]] or "")
        want = brute_runs(words)
        gone = {k for s, n, q in want for k in range(s + q, s + n)}
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        assert r["n_runs"] == len(want) and r["collapsed_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in want).encode()).hexdigest()
        best = min(want, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert collapsed[r["doc_id"]] == (kept if want else by_id[r["doc_id"]])
        assert sorted(set(listed.get(r["doc_id"], []))) == want
    assert runs.collapse_runs(docs).columns == docs.columns and len(listed[6]) == 2
    none = docs.limit(0)
    assert runs.run_report(none).count() == runs.find_runs(none).count() == runs.collapse_runs(none).count() == 0
    other = docs.select(F.col("doc_id").alias("a.b"), F.col("text").alias("length `x`"))
    assert runs.find_runs(other, "a.b", "length `x`").columns == ["a.b", "start", "length", "period"]


def test_planted_tails(spark):
    ids = list(range(400)) + [None]
    docs = spark.createDataFrame([(i, None if i == 3 else " ".join(f"w{k}" for k in range((i or 0) % 70))) for i in ids], "doc_id long, text string")
    changed = 0
    for r in runs.periodic_tails(docs).collect():
        i = r["doc_id"]
        words = [] if i == 3 else [f"w{k}" for k in range((i or 0) % 70)]
        h, n = (zlib.crc32(str(i).encode()) if i is not None else 1), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
            changed += 1
        assert WORD.findall(r["text"] or "") == words
    assert changed > 20


def test_runs_of_a_very_long_text(spark):
    """8 MB of one repeated phrase, and of a period of 100,000 words."""
    rng = random.Random(0)
    tail = [f"w{rng.randrange(50_000)}" for _ in range(100_000)]
    docs = spark.createDataFrame([(1, "ab " * 2_700_000), (2, " ".join(["begin", *tail * 12, "end"]))], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_runs"], r["start"], r["length"], r["period"]) for r in runs.run_report(docs).collect()}
    assert got == {1: (1, 0, 2_700_000, 1), 2: (1, 1, 1_200_000, 100_000)}


def block_of(v, levels):
    n, d = v.shape
    table = pa.table({"dim": pa.array([d] * n, pa.int32()), "cb": pa.array([0] * n, pa.int64()), "id": pa.array(np.arange(n)), "h": pa.array(np.arange(n)), "v": pa.array(v.tolist(), pa.list_(pa.int64()))})
    return impact.Block(impact.block_index(table, levels))


def test_impact_search_of_a_block():
    rng = np.random.default_rng(0)
    for t in range(200):
        n, d, wide = int(rng.integers(1, 200)), int(rng.integers(1, 12)), int(rng.choice([2, 5, 50, 3000]))
        v, q = rng.integers(-wide, wide + 1, (n, d)), rng.integers(-wide, wide + 1, d)
        if t % 3 == 0:
            v = np.abs(v)
        if t % 5 == 0:
            v[: n // 2] = v[0]
        own = np.arange(t % 2)
        rows, scores, _ = block_of(v, int(rng.choice([1, 2, 7, 64]))).best(q.tolist(), 10, own, few=int(rng.choice([0, 1, 8])))
        assert [(-int(s), int(r)) for s, r in zip(scores, rows)] == sorted((-x, i) for i, x in enumerate((v @ q).tolist()) if i not in own)[:10]


def test_impact_search_stops_on_proof():
    """Of vectors with a few great components most are ruled out before they are rescored."""
    rng = np.random.default_rng(1)
    v = np.floor(1024 * rng.normal(size=(5000, 32)) ** 3).astype(np.int64)
    block = block_of(v, impact.LEVELS)
    rescored = [block.best(v[i].tolist(), 10, np.array([i]))[2] for i in range(20)]
    assert max(rescored) < 500


def test_impact_search_of_many_queries():
    """Queries of a block share the way through its postings: numbers of all sizes, and 400 queries in far less than 400 times one."""
    rng = np.random.default_rng(3)
    v = rng.integers(-600, 600, (1024, 64))
    table = pa.table({"dim": pa.array([64] * 1024, pa.int32()), "cb": pa.array([0] * 1024, pa.int64()), "id": pa.array(np.arange(1024)), "h": pa.array(np.arange(1024)), "v": pa.array(v.tolist(), pa.list_(pa.int64()))})
    index, asked = impact.block_index(table, impact.LEVELS), table.slice(0, 400).select(["id", "h", "v"])
    began = time.perf_counter()
    got = impact.search_block(asked, index, 10)
    took = time.perf_counter() - began
    scores = v[:400] @ v.T
    want = [(i, int(j), int(scores[i, j])) for i in range(400) for j in [x for x in np.lexsort((np.arange(1024), -scores[i])) if x != i][:10]]
    assert list(zip(*(got[c].to_pylist() for c in ("query_id", "vec_id", "score")))) == want
    assert took < 2.5
    small, kinds = v[:300, :5], [1, 10**9, 10**18]
    queries = [[int(x) * kinds[j % 3] for x in v[j, :5]] for j in range(30)]
    found = {j: (rows.tolist(), [int(x) for x in s]) for j, rows, s, _ in block_of(small, 7).best_of_many(queries, 10, [np.array([j]) if j % 2 else np.zeros(0, np.int64) for j in range(30)])}
    for j, q in enumerate(queries):
        ranked = sorted((-sum(a * b for a, b in zip(q, w)), i) for i, w in enumerate(small.tolist()) if i != j or j % 2 == 0)[:10]
        assert found[j] == ([i for _, i in ranked], [-s for s, _ in ranked])


@pytest.mark.parametrize("block", [None, 3])
def test_exact_top(spark, block):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(40)]
    rows += [(100, [0.5, -0.25, 0.0, 1.0]), (200, [0.5, -0.25, 0.0, 1.0]), (41, [0.0] * 4), (100, [0.5, -0.25, 0.0, 1.0]), (100, [9.0, 0.0, 0.0, 0.0])]
    rows += [(50, [0.5, -0.25, 0.0, 1.0])] * 2 + [(k, [1.0, 1.0, 1.0, 1.0]) for k in range(60, 75)]
    rows += [(300, None), (301, [1.0, None, 1.0, 1.0]), (302, [1.0, nan, 1.0, 1.0]), (303, [inf, 0.0, 0.0, 0.0]), (None, [1.0] * 4), (400, []), (43, []), (500, [1e30, 0.0]), (501, [-1e30, 1.0]), (502, [2.0, 3.0])]
    df = spark.createDataFrame([(i, v, "x", 7) for i, v in rows], "vec_id long, embedding array<double>, h string, `a.b` int")
    numbers = {(i, tuple(min(max(int(np.floor(1024 * x)), -(2**63)), 2**63 - 1) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for i, v in numbers:
        if i % 100 == 0:
            clip = lambda x: min(max(x, -(2**63)), 2**63 - 1)
            ranked = sorted((-clip(sum(a * b for a, b in zip(v, w))), j) for j, w in numbers if len(w) == len(v) and (j, w) != (i, v))[:10]
            want |= {(i, k, j, -s, v) for k, (s, j) in enumerate(ranked, 1)}
    got = impact.top_scores(df, block=block).collect()
    assert sorted(map(tuple, got)) == sorted(x[:4] for x in want)
    assert impact.top_scores(df.limit(0)).count() == 0
    named = df.select("h", F.col("vec_id").alias("score"), F.col("embedding").alias("a `v`"))
    assert impact.top_scores(named, id_col="score", vector_col="a `v`").count() == len(got)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(nodes, k):
    """The root of nodes, and the siblings of node k as (before, after) of each level."""
    sides = []
    while len(nodes) > 1:
        at = k // 8 * 8
        sides.append(("".join(nodes[at:k]), "".join(nodes[k + 1 : at + 8])))
        nodes, k = [sha(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)], k // 8
    return nodes[0], sides


def brute_manifest(rows):
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r: sha(*(field(r[c]) for c in manifest.LEAF_COLUMNS))
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    sorted_ = {g: sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))) for g in order}
    subroots = [climb([leaf(r) for r in sorted_[g]], 0)[0] for g in order]
    out = []
    for k, g in enumerate(order):
        root, over = climb(subroots, k)
        for i, r in enumerate(sorted_[g]):
            sides = climb([leaf(x) for x in sorted_[g]], i)[1] + over
            changed = dict(r)
            if r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
                changed["text"] = r["text"].translate({c: c + 32 for c in range(65, 91)})
            node = leaf(changed)
            for a, b in sides:
                node = sha(a, node, b)
            out.append((r["doc_id"], leaf(r), subroots[k], root, sha(*(a + b for a, b in sides)), node, node == root))
    return sorted(map(repr, out))


MANIFEST = "doc_id long, text string, lang string, source string, n_chars long, node string, `all` int"


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_manifest(spark, tmp_path, monkeypatch, levels):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    monkeypatch.setattr(manifest, "BLOCK", 8**levels)
    monkeypatch.setattr(manifest, "SENT", 0 if levels == 2 else 2_000)
    langs = ["en"] * 150 + ["de"] * 65 + [None] * 9 + ["fr"] * 8 + ["日"] + ["Z"] * 7 + [f"l{k}" for k in range(5)]
    rows = [(i, f"Text {i} ÄÖ Ab" * (i % 4), g, None if i % 5 == 0 else f"s{i % 3}", None if i % 7 == 0 else i, "n", 1) for i, g in enumerate(langs)]
    rows += [(3, "other", "en", "s", 1, "n", 1), rows[4], rows[4], (None, "A", "en", None, None, "n", 1), (None, None, None, None, None, None, None), (7, None, "en", "", 0, "n", 1), (-5, "", "en", "x", 2, "n", 1)]
    docs = spark.createDataFrame(rows, MANIFEST)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = manifest.op13_manifest(spark, str(tmp_path)).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_manifest([r.asDict() for r in docs.collect()])
    assert 0 < sum(not r["verified"] for r in got) < len(got) // 2
    named = docs.toDF("a.b", "te`xt", "grp", "id", "sides", "__r", "__rows")
    made = manifest.merkle_manifest(named, "a.b", "grp", ("a.b", "id", "grp", "sides", "te`xt"))
    assert {r["root"] for r in made.select("root").distinct().collect()} == {got[0]["root"]} and made.where(manifest.folded(F.col("claim"), F.col("sides")) != F.col("root")).count() == 0


def test_manifest_of_small_tables(spark, tmp_path):
    one = spark.createDataFrame([(1, "T", "en", "s", 1, "n", 1)], MANIFEST)
    one.write.parquet(f"{tmp_path}/one/documents.parquet")
    assert [repr(tuple(r)) for r in manifest.op13_manifest(spark, f"{tmp_path}/one").collect()] == brute_manifest([one.first().asDict()])
    one.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert manifest.op13_manifest(spark, f"{tmp_path}/none").count() == 0


def test_manifest_is_sql_only(spark, tmp_path):
    spark.createDataFrame([(i, "T", "en", "s", 1, "n", 1) for i in range(20)], MANIFEST).write.parquet(f"{tmp_path}/documents.parquet")
    plan = manifest.op13_manifest(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
