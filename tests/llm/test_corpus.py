"""The corpus operators against brute force on small tables with nulls, ties, repeats and long texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from figshelf.llm import chat, common, licences, lines, mixing, near_duplicates, neighbours, packing, passages, quality, queries, token_files, tokens, words
from figshelf.llm.components import components
from figshelf.llm.tokens import Encoder

public = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, r string, label string, v string, size string"


def corpus(seed=0):
    """Rows with copies, near copies, shared lines and passages, nulls, empty, long and odd texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Ünï", "日本", "x\x1cy", "a b", "#tag", "100%"]
    words = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, line = words(70), "  This Line Is Shared By Many Of The Documents Here\t"
    texts = [None, "", " \n\t ", "one", "One two three", "\n\n", words(9), words(49), words(50), words(51), words(3000), passage]
    for k in range(12):
        texts.append(words(40) + "\n" + line + "\n" + words(30))
        texts.append(words(20) + " " + passage + " " + words(15 + k))
    base = words(200).split()
    for _ in range(8):
        near = list(base)
        for _ in range(rng.randint(0, 6)):
            near[rng.randrange(len(near))] = "changed"
        texts.append(" ".join(near))
    texts += [texts[20], texts[20], texts[30].upper(), line.lower() + "\n" + line, ("rep eat ed words here now " * 30), words(60) + " " + " ".join([words(120)] * 2) + words(900)]
    rng.shuffle(texts)
    rows = [(i, t, "en", rng.choice(["b", "a", "Z", None, "hot", "hot", "hot"]), None if t is None else len(t), "i", "r", "l", "v", "s") for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts():
    return {r[0]: r[1] or "" for r in corpus()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(name, same_as_sql):
    same_as_sql(queries.QUERIES[name], queries.ORACLE_SQL[name])


def repeats(words):
    """Longest repeat, and the places inside repeats of REPEAT_WORDS words or more."""
    n, inside, longest = len(words), set(), 0
    for i in range(n):
        best = 0
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and words[i + k] == words[j + k]:
                k += 1
            best = max(best, k)
        if best >= quality.REPEAT_WORDS:
            inside |= set(range(i, i + best))
            longest = max(longest, best)
    return longest, inside


def test_quality(docs, none):
    got = {r["doc_id"]: r for r in quality.quality_features(docs).collect()}
    for i, text in texts().items():
        words = WORD.findall(text)
        grams = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        twice = {k + d for k in range(len(words) - 4) if grams[tuple(words[k : k + 5])] > 1 for d in range(5)}
        ls = [x for x in text.split("\n") if WORD.search(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(ls) - len(set(ls)), len(twice))
        assert r["base_failed"] == (len(words) < 10 or 100 * len(twice) > 20 * len(words))
        if len(words) < 1500:
            longest, inside = repeats(words)
            assert (r["longest_repeat"], r["n_covered_chars"]) == (longest, sum(len(words[k]) for k in inside))
    kept = {r["doc_id"]: r for r in quality.keep_quality(docs).collect()}
    assert set(kept) == {i for i, r in got.items() if r["kept"]} and kept[min(kept)]["id"] == "i"
    assert any(not r["kept"] and not r["base_failed"] for r in got.values())
    assert quality.quality_features(none).count() == 0 == quality.keep_quality(none).count()


def test_lines(docs, none, spark):
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate({c: c + 32 for c in range(65, 91)})
    for repeated in (docs, docs.union(docs)):
        holders = defaultdict(set)
        for i, t in texts().items():
            for x in t.split("\n"):
                if len(key(x)) >= 40:
                    holders[key(x)].add(i)
        want = Counter()
        for i, t in texts().items():
            ls = t.split("\n")
            kept = [x for x in ls if not (len(holders.get(key(x), ())) >= 5 and i < max(holders[key(x)]))]
            want[i, len(ls), len(ls) - len(kept), sha("\n".join(kept))] += 2 if repeated is not docs else 1
        assert Counter(map(tuple, lines.line_report(repeated).collect())) == want
    made = {r["doc_id"]: r for r in lines.dedup_lines(docs).collect()}
    assert {i: sha(r["text"] or "") for i, r in made.items()} == {k[0]: k[3] for k in want} and all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in made.values())
    assert lines.dedup_lines(docs).columns == docs.columns and lines.dedup_lines(none).count() == 0
    loose = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert lines.line_report(loose).where("n_dropped > 0").count() == 0


@pytest.mark.parametrize("hot", [passages.HOT, 3])
def test_passages(docs, none, hot):
    first = {}
    split = {i: WORD.findall(t) for i, t in texts().items()}
    for i, words in split.items():
        for k in range(len(words) - 49):
            w = tuple(words[k : k + 50])
            first[w] = min(first.get(w, i), i)
    want = set()
    for i, words in split.items():
        gone = {k + d for k in range(len(words) - 49) if first[tuple(words[k : k + 50])] < i for d in range(50)}
        want.add((i, len(words), len(gone), sha(" ".join(w for k, w in enumerate(words) if k not in gone))))
    assert set(map(tuple, passages.passage_report(docs, hot=hot).collect())) == want
    changed = {i for i, _, gone, _ in want if gone}
    made = {r["doc_id"]: r["text"] for r in passages.dedup_passages(docs, hot=hot).collect()}
    assert changed and all((sha(made[i]) == s) if gone else (made[i] or "") == texts()[i] for i, _, gone, s in want)
    assert passages.passage_report(none).count() == 0
    assert passages.passage_report(docs.union(docs)).where("n_removed > 0").count() == 2 * len(changed)
    assert passages.passage_report(docs.withColumn("doc_id", F.lit(None).cast("long"))).where("n_removed > 0").count() == 0


def shingles(text):
    words = WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def linked_components(sets):
    label = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = {k: a if x == b else x for k, x in label.items()}
    return label


@pytest.mark.parametrize("limits", [{}, {"SMALL": 1, "LARGE": 4}])
def test_near_duplicates(docs, none, limits, monkeypatch):
    for name, value in limits.items():  # nodes that branch, and nodes that are cut into blocks
        monkeypatch.setattr(near_duplicates, name, value)
    sets = {i: shingles(t) for i, t in texts().items()}
    label = linked_components(sets)
    got = {r["id"]: r for r in near_duplicates.near_duplicates(docs).collect()}
    assert {i: (len(sets[i]), label[i], label[i] == i) for i in sets} == {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()}
    kept = near_duplicates.drop_near_duplicates(docs.union(docs))
    assert kept.columns == docs.columns
    want = Counter(i for i in sets if label[i] == i) + Counter(i for i in sets if not sets[i])  # rows without words all stay
    assert Counter(r["doc_id"] for r in kept.collect()) == want
    if not limits:
        assert near_duplicates.near_duplicates(none).count() == 0


@pytest.mark.parametrize("id_", [None, 7])
def test_near_duplicates_keeps_unrelated_texts_of_one_id(spark, id_):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(60)) for _ in range(9)]
    near, numbered = texts[0] + " one more", texts[1] + " one more"  # a copy without an id, and one under an id that is less
    rows = [(id_, t) for t in [*texts, texts[2], near, "", ""]] + [(3, numbered)]
    kept = Counter((r["doc_id"], r["text"]) for r in near_duplicates.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    first = next(t for t in (texts[0], near) if kept[id_, t])  # either of the two, but one
    assert kept == Counter([(id_, first), *((id_, t) for t in texts[2:]), (id_, ""), (id_, ""), (3, numbered)])


def test_components(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(200, 200)]
    rng.shuffle(chain)
    got = {r["v"]: r["label"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert len({got[i] for i in range(61)}) == 1 and len({got[i] for i in range(100, 160)}) == 1 and got[0] != got[100] and 200 not in got


def brute_targets(sizes, weights):
    out, open_, left = [None] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if unit * weights[i] > 3 * sizes[i] + 1e-9}
        for i in over or open_:
            out[i] = 3.0 * sizes[i] if over else unit * weights[i]
        left -= sum(out[i] for i in over)
        open_ -= over or set(open_)
    return out


def test_mixing(docs, none):
    plan = mixing.mix_plan(docs)
    rows = {r["id"]: r for r in plan.collect()}
    source = {r[0]: r[3] for r in corpus()}
    order = sorted(set(source.values()), key=lambda s: (s is None, s or ""))
    size = {i: len(WORD.findall(t)) for i, t in texts().items()}
    sizes = [sum(size[i] for i in size if source[i] == s) for s in order]
    goal = dict(zip(order, brute_targets(sizes, [1 + k % 3 for k in range(len(order))])))
    for s, total in zip(order, sizes):
        mine = [rows[i] for i in size if source[i] == s]
        assert all(r["size"] == size[r["id"]] and r["source_size"] == total and math.isclose(r["target"], goal[s]) for r in mine)
        taken = sum(len(r["shards"]) * r["size"] for r in mine)
        assert abs(taken - goal[s]) <= max(r["size"] for r in mine) and all(len(r["shards"]) <= 3 for r in mine)
    again = {r["id"]: r["shards"] for r in mixing.mix_plan(docs.repartition(2)).collect()}
    assert again == {i: r["shards"] for i, r in rows.items()}
    made = mixing.mixed(docs)
    assert made.columns == docs.columns and Counter(r["doc_id"] for r in made.collect()) == Counter({i: len(r["shards"]) for i, r in rows.items() if r["shards"]})
    small = mixing.mix_plan(docs, block_words=300, block_docs=5, blocks_per_shard=2).collect()
    assert len({s for r in small for s in r["shards"]}) > 3
    assert mixing.mix_plan(none).count() == 0 == mixing.mixed(none).count()
    with pytest.raises(ValueError):
        mixing.MAX_SOURCES, old = 2, mixing.MAX_SOURCES
        try:
            mixing.mix_plan(docs)
        finally:
            mixing.MAX_SOURCES = old


def test_mixing_takes_each_repeated_row_by_its_own_plan(spark):
    # one id and text in sources of different targets, and equal rows of which the block cut short takes a part
    shared = [(i, f"{i} shared words", s) for i in range(40) for s in ("a", "b", "c")]
    equal = [(None, "some more words", "b")] * 101 + [(7, "five words in each row", None)] * 60
    repeated = spark.createDataFrame(shared + equal, "doc_id long, text string, source string").repartition(4)
    want = Counter()
    for r in mixing.mix_plan(repeated).collect():
        want[r["id"], r["r"], r["source"]] += len(r["shards"])
    made = mixing.mixed(repeated).withColumn("hash", F.xxhash64("text")).collect()
    assert Counter((r["doc_id"], r["hash"], r["source"]) for r in made) == +want
    some = [n for k, n in want.items() if k[0] is None or k == (7, None)]
    assert any(n % 101 for n in some) and len({n for k, n in want.items() if k[0] in range(40)}) > 1


def test_blocks_are_permuted_anew_in_each_epoch():
    for n in (1, 2, 3, 17, 1000):
        orders = [mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key)) for key in (1, 2)]
        assert all(sorted(x.tolist()) == list(range(n)) for x in orders)
        neighbours = [set(zip(x.tolist(), x[1:].tolist())) for x in (np.argsort(o) for o in orders)]
        if n == 1000:  # the same two blocks hardly follow each other twice
            assert len(neighbours[0] & neighbours[1]) < 10
    n = np.array([5, 9, 70_000_000_000])
    assert (mixing.permuted(np.array([4, 8, 69_999_999_999]), n, np.array([1, 2, 3])) < n).all()


def test_splitting_tree_adds_up():
    quotas = np.array([50, 0, 7, 200])
    draws = {s: np.arange(q) for s, q in enumerate(quotas.tolist()) if q}
    leaf = mixing.split_quotas(quotas, 9, 5, draws)
    total = sum(np.bincount(x, minlength=9) for x in leaf.values())
    assert total.sum() == 257 and total.max() - total.min() <= 4 and all((np.diff(x) >= 0).all() for x in leaf.values())
    part = mixing.split_quotas(quotas, 9, 5, {3: np.arange(60, 90)})
    assert (part[3] == leaf[3][60:90]).all()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(name, monkeypatch):
    e = Encoder(public.path(name))
    odd = ["a\tb \n\n  c's don't  x\n", "  ", "\n\n", " x  y", "a\x1c!\x1d b", "foo  <|endoftext|> bar", "é ́x", "AİB ΣΣ", "", "x" * 3000 + " y", "日本 語　x", " 12 345! ?", "a \n b", "!\x85! b", "Word, word. WORD! (word) 'word', 7. é, É. ... ,. a|b| |"]
    cases = [*texts().values(), *odd]
    odd += ["it's, (o'clock). 'tis! rock'n'roll; a.'s x'.y 3.14e5 é,ñ ×a÷b Ǆ.x e\u0301.x J\u030c, ıI", "a" * 70 + "," + "b" * 70, "x_y-z/é.com?q=ñ&r", "\u2029x \u3000", "A\u00adB. C"]
    for k in range(300):
        odd.append("".join(random.Random(k).choice("aB9é'.,\n  Ö×|<\t\u0301日\xa0") for _ in range(40)))
    cases = [*cases, *odd]
    assert [x.tolist() for x in e.encode_column(pa.array([*cases, None]))] == [*(x.ids for x in e.tokenizer.encode_batch(cases, add_special_tokens=False)), []]
    long = " ".join(random.Random(1).choice(["ab", "Cd,", "é.", "x\n", "7"]) for _ in range(3000))
    monkeypatch.setattr(tokens, "STRETCH", 500)  # long texts in stretches, and little remembered
    monkeypatch.setattr(tokens, "REMEMBERED", 40)
    for _ in range(3):
        assert [x.tolist() for x in e.encode_column(pa.array([long, "", long[:1500], *odd]))] == [x.ids for x in e.tokenizer.encode_batch([long, "", long[:1500], *odd], add_special_tokens=False)]
    data, offsets = common.text_bytes(pa.array([long, "a"]))
    cuts, row, whole = e.pieces(data, offsets, 500)
    assert not whole.any() and len(cuts) > 10 and row[-1] == 1 and (np.diff(row) >= 0).all()


def test_token_files(docs, none, spark, tmp_path):
    tokenizer = public.path("word_bpe_49k.json")
    folder = f"file://{tmp_path}/a"
    n = token_files.write_token_files(docs, folder, tokenizer, task_bytes=3000, shard_bytes=4000, keys_per_index=7)
    got = {r["id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_token_files(spark, folder, n).collect()}
    library, start = Encoder(tokenizer).tokenizer, 0
    files = token_files.TokenFiles(folder, n)
    for i, text in sorted(texts().items()):
        ids = library.encode(text, add_special_tokens=False).ids + [2]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) and files.get(i).tolist() == ids
        start += len(ids)
    assert files.get(10**9) is None and n > 3
    twice = docs.union(docs).withColumn("doc_id", F.when(F.col("doc_id") % 7 > 0, F.col("doc_id")))
    n = token_files.write_token_files(twice, f"file://{tmp_path}/b", tokenizer, task_bytes=3000, shard_bytes=2000)
    rows = token_files.read_token_files(spark, f"file://{tmp_path}/b", n).orderBy("start").collect()
    assert len(rows) == 2 * docs.count() and rows[0]["id"] is None and all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(rows, rows[1:]))
    n = token_files.write_token_files(none, f"file://{tmp_path}/c", tokenizer)
    assert token_files.read_token_files(spark, f"file://{tmp_path}/c", n).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, (5000, 2)).astype(np.uint64)
    made = token_files.PerfectHash.build(keys)
    assert sorted(made.numbers(keys).tolist()) == list(range(5000))
    other = rng.integers(0, 2**63, (2000, 2)).astype(np.uint64)
    index = token_files.IndexFile(token_files._index_bytes(keys, *(np.arange(5000) for _ in range(4))))
    assert index.find(keys)[1].all() and index.find(other)[1].sum() <= 1


def test_packing(docs, none):
    tokenizer = public.path("byte_bpe_50k.json")
    library = Encoder(tokenizer).tokenizer
    got = packing.pack_documents(docs, tokenizer, capacity=256, group=20, keep_ids=True).collect()
    for i, text in texts().items():
        ids = library.encode(text, add_special_tokens=False).ids + [0]
        mine = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["start"] for r in mine] == [0, *np.cumsum([r["length"] for r in mine])[:-1].tolist()] and [r["piece"] for r in mine] == list(range(len(mine)))
        assert np.concatenate([np.frombuffer(r["ids"], "<u4") for r in mine]).tolist() == ids and all(r["length"] == 256 for r in mine[1:])
        assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in mine) and (len(mine) == 1 or len(ids) > 256)
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        places.sort()
        assert sum(n for _, n in places) <= 256 and [a for a, _ in places] == [0, *np.cumsum([n for _, n in places])[:-1].tolist()]
    assert packing.pack_documents(none, tokenizer).count() == 0
    assert packing.pack_documents(docs.union(docs), tokenizer).count() == 2 * packing.pack_documents(docs, tokenizer).count()


def test_local_search_saves_bins():
    rng = np.random.default_rng(2)
    sizes = rng.integers(500, 900, 600)
    search = packing.Search(packing.next_fit(sizes.tolist(), 2048), sizes, 2048)
    first, last = search.n_bins, search.run()
    assert sorted(i for b in last for i in b) == list(range(600)) and all(sizes[b].sum() <= 2048 for b in last)
    assert packing.fewest(sizes, 2048) <= len(last) < len(packing.best_fit(sizes.tolist(), 2048)) < first
    assert packing.pack(np.zeros(0, np.int64), 2048) == []


@pytest.mark.parametrize("n", [50, 2000])
def test_effort_per_document_has_a_bound(n):
    """Sizes that cannot fill bins: rounds end by what they went through, in groups of any size."""
    sizes = np.random.default_rng(n).integers(500, 1100, n)
    search = packing.Search(packing.next_fit(sizes.tolist(), 2048), sizes, 2048)
    last = search.run()
    assert sorted(i for b in last for i in b) == list(range(n)) and len(last) <= len(packing.best_fit(sizes.tolist(), 2048))
    assert search.effort <= (packing.EFFORT + 2) * n


@pytest.mark.parametrize("n", [2, 13, 40])
def test_pairs_of_every_two_sizes(n):
    rng = np.random.default_rng(n)
    group, sizes = rng.integers(0, 5, 5 * n), rng.integers(1, 30, 5 * n)
    i, j, both = packing.pairs_in(group, sizes)
    assert (i != j).all() and (group[i] == group[j]).all() and (both == sizes[i] + sizes[j]).all()
    got = Counter((g, *sorted(p)) for g, *p in zip(group[i].tolist(), sizes[i].tolist(), sizes[j].tolist()))
    want = {(int(group[a]), *sorted((int(sizes[a]), int(sizes[b])))) for a in range(5 * n) for b in range(a) if group[a] == group[b]}
    assert set(got) == want and max(got.values()) == 1


def test_search_packs_the_given_documents():
    """From next fit to the lower bound on the given tables, by steps of each kind; best fit is the measure."""
    import duckdb

    encoder = Encoder.of(public.path("byte_bpe_50k.json"))
    texts = duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' ORDER BY doc_id").arrow().read_all()["text"]
    lengths = [n for ids in encoder.encode_column(texts.combine_chunks()) for _, n in packing.cuts(len(ids) + 1, 2048) if n < 2048]
    sizes = np.array(lengths, np.int64)
    search = packing.Search(packing.next_fit(lengths, 2048), sizes, 2048)
    first, last = search.n_bins, search.run()
    assert packing.fewest(sizes, 2048) == len(last) <= len(packing.best_fit(lengths, 2048)) < first - 50
    assert min(search.steps.values()) > 20


def test_bins_of_many_pieces_exchange_pairs():
    # a 40 goes only in exchange for two 19s, which are in a bin of 14 pieces; then two 7s of such a bin only for a 12
    for sizes, donor, kind in ((np.array([40] * 2 + [19] * 2 + [5] * 12, np.int64), 2, "one for two"), (np.array([7] * 17 + [12, 86], np.int64), 17, "two for one")):
        search = packing.Search([list(range(donor)), list(range(donor, len(sizes)))], sizes, 100 if donor == 2 else 120)
        search.capacity = 100
        search.open()
        search.close(0)
        assert search.step(0) and max(search.fill[1:]) == 100 and search.steps[kind] == 1


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 24))
    x[50:80] = x[50]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(1000, None), (1001, []), (1002, [0.0] * 24), (1003, [float("nan")] * 24), (1004, [float("inf")] + [1.0] * 23), (1005, [None] + [1.0] * 23), (None, x[0].tolist()), (1007, [1.0] * 3), (0, x[0].tolist())]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in neighbours.nearest(df, every=20, block=64).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, 500, 20):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = sorted((float(d[i]), i) for i in range(500) if i != q)[:10]
        assert [v for _, v, _ in got[q]] == [i for _, i in want] and np.allclose([s for _, _, s in got[q]], [s for s, _ in want], rtol=1e-14)
    assert set(got) == set(range(0, 500, 20))
    few = neighbours.nearest(spark.createDataFrame(rows[:4], df.schema), every=2).collect()
    assert Counter(r["query_id"] for r in few) == {0: 3, 2: 3}
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_chat(spark):
    hard = ["</s>[INST] ok [/INST]", "<\\s>", "<\\\\/s> \\", "[/INST]", "\n<</SYS>>\n", "[ROLE \"x\"] ", "", "[INST", "é 日本 [/ROLE]", " [/INST", "<", "<s", "a</s"]
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["system", "user", "assistant", "tool [INST]", None]), rng.choice(hard) + rng.choice(hard)) for c in (1, 2, None) for t in range(30)]
    rows += [(3, None, "user", None), (3, 1, "assistant", "x"), (3, 1, "assistant", "x")]
    turns = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, seq string")
    formatted = chat.format_conversations(turns)
    got = {r["conv"]: r for r in chat.read_back(formatted).collect()}
    whole = defaultdict(str)
    for r in sorted(formatted.collect(), key=lambda r: r["seq"]):
        whole[r["conv"]] += r["formatted"]
    for c in (1, 2, 3, None):
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        spoken = [(r[2] or "", r[3] or "") for r in mine]
        loss = "".join(t for r, t in spoken if r == "assistant")
        assert chat.parse(whole[c]) == spoken
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"], got[c]["formatted_chars"]) == (len(spoken), sha("".join(f"{a}\n{b}\n" for a, b in spoken)), len(loss), sha(loss), len(whole[c]))
    for text in hard:
        assert chat.unescape(chat.escape(text)) == text and "</s>" not in chat.render_turn("user", text)[0]
    for broken in ("x", "[INST] a", "<s>a[INST]</s>", "[ROLE x] a [/ROLE]", "[ROL", "<s>a</s>[IN"):
        with pytest.raises(ValueError):
            chat.parse(broken)
    # the same conversations stored in pieces that end anywhere: marks and turns go over their ends
    pieces = [(c, k, t[a:b], a, None, None) for c, t in whole.items() for k, (a, b) in enumerate((a, a + 7) for a in range(0, len(t), 7))]
    again = {r["conv"]: r for r in chat.read_back(spark.createDataFrame(pieces, formatted.schema)).collect()}
    assert all((again[c]["n_turns"], again[c]["turns_sha256"]) == (got[c]["n_turns"], got[c]["turns_sha256"]) for c in got)
    with pytest.raises(Exception, match="ends inside a turn"):
        chat.read_back(spark.createDataFrame(pieces[:-1], formatted.schema)).collect()
    long = "a long turn [INST] </s> " * 200_000
    row = chat.read_back(chat.format_conversations(spark.createDataFrame([(1, 1, "user", long), (1, 2, "assistant", long)], "conv_id long, turn long, role string, text string"))).first()
    assert (row["n_turns"], row["loss_chars"], row["loss_sha256"]) == (2, len(long), sha(long))
    assert chat.read_back(chat.format_conversations(turns.limit(0))).count() == 0


def test_licences(docs, none, spark):
    for name, sentence in licences.SENTENCES.items():
        words = sentence.split(" ")
        wrapped = "// " + " ".join(words[:3]) + "\n// " + " ".join(words[3:])
        for text in (sentence, f"Before it.\n{sentence}\nAfter it.", wrapped, sentence.upper()):
            assert [x[3] for x in licences.sentence_ids(text)] == [name]
    rules = {lic: [i for x, i in licences.ORDERED if x == lic] for lic, _ in licences.ORDERED}
    for licence, forms in rules.items():
        for ids in forms:
            text = "Head.\n" + "\nSome words in between.\n".join(licences.SENTENCES[i] for i in ids)
            found, free = licences.licences(text)
            assert free == 0 and found == [(licence, 6, len(ids))]
    part = licences.SENTENCES["bsd-name"] + "\n" + licences.SENTENCES["mit-name"]
    assert licences.licences(part) == ([("MIT", len(licences.SENTENCES["bsd-name"]) + 1, 1)], 1)
    assert licences.licence_scan(docs).where("n_matches > 0").count() == 0 == licences.licence_scan(none).count()
    rows = spark.createDataFrame([(1, part), (1, part), (None, None)], "doc_id long, text string")
    assert sorted((r["n_matches"], r["licences"], r["n_unmatched"]) for r in licences.licence_scan(rows).collect()) == [(0, "", 0), (1, "MIT", 1), (1, "MIT", 1)]


def test_pipeline(spark, tmp_path):
    """Each stage against what brute force makes of its own input."""
    import corpus_pipeline

    spark.createDataFrame(corpus(5), SCHEMA).select("doc_id", "text", "lang", "source", "n_chars").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs.collect())
        assert k == 4 or docs.columns == columns
    ids = [Counter(r["doc_id"] for r in rows) for rows in seen]
    stays = Counter()  # quality rules, by counting windows
    for r in corpus(5):
        ws = WORD.findall(r[1] or "")
        windows = lambda n, ws=ws: [tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)]
        inside = lambda n, w=windows: {k + d for c in [Counter(w(n))] for k, x in enumerate(w(n)) if c[x] > 1 for d in range(n)}
        failed = len(ws) < 10 or 100 * len(inside(5)) > 20 * len(ws)
        repeats_ = 100 * sum(len(ws[k]) for k in inside(10)) > 20 * sum(map(len, ws)) or bool(inside(101))
        stays[r[0]] += not failed and not repeats_
    assert ids[0] == +stays and 0 < len(ids[0]) < len(corpus(5))
    assert ids[0] == ids[1]
    before, after = ({r["doc_id"]: r["text"] for r in rows} for rows in seen[:2])
    key = lambda x: x.strip(" \t\n\x0b\f\r").lower()
    holders = defaultdict(set)
    for i, t in before.items():
        for x in t.split("\n"):
            if len(key(x)) >= 40:
                holders[key(x)].add(i)
    gone = lambda i, x: len(holders[key(x)]) >= 5 and i < max(holders[key(x)])
    assert after == {i: "\n".join(x for x in t.split("\n") if not gone(i, x)) for i, t in before.items()} != before
    sets = {r["doc_id"]: shingles(r["text"] or "") for r in seen[1]}
    label = linked_components(sets)
    assert ids[2] == Counter(i for i in sets if label[i] == i)
    assert set(ids[3]) <= set(ids[2]) and max(ids[3].values()) <= 3
    source, size = {r["doc_id"]: r["source"] for r in seen[2]}, {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in seen[2]}
    order = sorted(set(source.values()), key=lambda s: (s is None, s or ""))
    sizes = [sum(size[i] for i in size if source[i] == s) for s in order]
    for s, goal in zip(order, brute_targets(sizes, [1 + k % 3 for k in range(len(order))])):
        mine = [i for i in size if source[i] == s]
        assert abs(sum(ids[3][i] * size[i] for i in mine) - goal) <= max(size[i] for i in mine)
    assert set(ids[4]) == set(ids[3]) and sum(r["piece"] == 0 for r in seen[4]) == len(seen[3])
    library = Encoder.of(public.path("byte_bpe_50k.json")).tokenizer
    for r in seen[3]:
        n = len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1
        assert sum(x["length"] for x in seen[4] if x["doc_id"] == r["doc_id"]) == n * ids[3][r["doc_id"]]
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(map(tuple, got.select("doc_id", "piece", "length", "ids_crc32").collect())) == Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in seen[4])


def test_pipeline_on_odd_tables(spark, tmp_path):
    """No rows; then nulls in every column, repeated rows, empty texts and one long text."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    good = " ".join(f"w{k}" for k in range(60))
    long = " ".join(f"v{k}" for k in range(300_000))
    rows = [(None, None, None, None, None), (1, "", "", "", 0), (None, good, None, None, None), (None, good, None, None, None), (2, good + " more", "en", "a", 5), (3, long, "en", None, 7), (3, long, "en", None, 7)]
    for name, table in (("none", []), ("odd", rows)):
        spark.createDataFrame(table, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        made = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert made.columns[:3] == ["doc_id", "piece", "start"]
        got = made.collect()
        if not table:
            assert got == []
    # of the near copies, document 2 stays, which has an id; of the repeated long text one row
    assert {r["doc_id"] for r in got} == {2, 3} and sum(r["piece"] == 0 for r in got if r["doc_id"] == 3) <= 3
