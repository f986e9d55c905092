"""Names that clash, very long texts, order of arrival, and how many pairs branching trees find."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from figshelf.llm import chat, common, licences, lines, mixing, near_duplicates, packing, passages, quality, token_files, words

public = pytest.importorskip("public_tokenizers")
ROWS = [(i, f"  This Line Is Shared By Many Of The Documents Here\n{i} " + " ".join(f"w{(i // 2) * 1000 + k}" for k in range(70)), "ab"[i % 2]) for i in range(8)] + [(None, None, None), (8, "", "a")]
RESERVED = ["__fs_id", "__FS_r", "__fs_drops", "__fs_spans", "__fs_hit", "__fs_shards", "id", "r", "h", "label", "size", "v", "text_", "cls"]


@pytest.fixture(scope="module", params=["plain", "reserved", "dotted"])
def named(spark, request):
    """The same rows under plain names, beside columns of reserved names, and under names with dots and quotes."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    if request.param == "reserved":
        df = df.select(*(F.lit(k).alias(c) for k, c in enumerate(RESERVED[:7])), "*", *(F.lit("x").alias(c) for c in RESERVED[7:]))
    if request.param == "dotted":
        return df.toDF("doc.id", "te.xt `q`", "sou.rce").withColumn("a.b", F.lit(1)), ("doc.id", "te.xt `q`", "sou.rce")
    return df, ("doc_id", "text", "source")


def test_names(named, spark, tmp_path):
    df, (id_, text, source) = named
    whole = lambda made: Counter((r[id_], r[text]) for r in made.collect())
    made = lines.dedup_lines(df, id_, text)
    assert made.columns == df.columns and sum("Shared" in (t or "") for _, t in whole(made)) == 1
    assert lines.line_report(df, id_, text).where("n_dropped > 0").count() == 7
    made = passages.dedup_passages(df, id_, text)
    assert made.columns == df.columns and made.count() == 10
    assert passages.passage_report(df, id_, text).where("n_removed > 0").count() == 4
    made = near_duplicates.drop_near_duplicates(df.union(df), id_, text)
    assert made.columns == df.columns and Counter(i for i, _ in whole(made).elements()) == {0: 1, 2: 1, 4: 1, 6: 1, None: 2, 8: 2}
    made = quality.keep_quality(df, text)
    assert made.columns == df.columns and made.count() == 8 == quality.quality_features(df, id_, text).where("kept").count()
    made = mixing.mixed(df, id_, text, source)
    assert made.columns == df.columns and made.count() > 0
    assert licences.licence_scan(df, id_, text).columns[0] == id_
    packed = packing.pack_documents(df, public.path("byte_bpe_50k.json"), id_col=id_, text_col=text)
    assert packed.columns[0] == id_ and packed.where(F.col(common.quoted(id_)).isNull()).count() == 1
    folder = f"file://{tmp_path}/files"
    n = token_files.write_token_files(df, folder, public.path("word_bpe_49k.json"), id_col=id_, text_col=text)
    assert token_files.read_token_files(spark, folder, n).count() == 10
    turns = df.select(*(common.col(c) for c in (id_, text, source)))
    assert chat.read_back(chat.format_conversations(turns, id_, id_, source, text)).count() == 10


def long_text(n_bytes, seed=0):
    """Words of a large vocabulary, and two passages that come twice."""
    rng = np.random.default_rng(seed)
    vocabulary = np.array([f"w{i}é" if i % 9 == 0 else f"word{i}" for i in range(50_000)])
    made = vocabulary[rng.integers(0, 50_000, n_bytes // 9)].tolist()
    made[5000:5060] = made[200:260]
    return " ".join(w + ("\n" if k % 40 == 0 else "") for k, w in enumerate(made))


def test_stretches_have_every_window_once():
    text = long_text(60_000)
    data = np.frombuffer(text.encode(), np.uint8)
    whole = words.words_of(data, np.array([0, len(data)]))
    want = whole.windows(5, whole.hashes())[1].tolist()
    for most in (300, 4_000, 10**6):
        got = []
        for number, part in words.stretches(data, 4, most=most):
            at, hashes = part.windows(5, part.hashes())
            assert not len(at) or number + at[0] == len(got)
            got += hashes.tolist()
        assert got == want
    huge = b"x" * 3_000_000 + b" y " + b"z" * 10
    data = np.frombuffer(huge, np.uint8)
    hashes = words.words_of(data, np.array([0, len(data)])).hashes()
    part = np.frombuffer(b"z" * 10, np.uint8)
    assert hashes[2] == words.words_of(part, np.array([0, 10])).hashes()[0] and len(set(hashes.tolist())) == 3
    assert [len(p) for _, p in words.stretches(data, 4)] == [3]


def test_long_texts(spark, monkeypatch):
    """One text far beyond what is handled at once equals the same text handled whole."""
    text = long_text(6 << 20)
    copy = text[: len(text) // 2] + " changed " + text[len(text) // 2 :]
    df = spark.createDataFrame([(1, text), (2, copy), (3, text[:400_000])], "doc_id long, text string").repartition(3)
    found = {r["id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates.near_duplicates(df).collect()}
    sets = {}
    for i, t in ((1, text), (2, copy), (3, text[:400_000])):
        w = t.split()
        sets[i] = len({tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    assert found == {1: (sets[1], 1), 2: (sets[2], 1), 3: (sets[3], 3)}
    gone = {r["doc_id"]: r["n_removed"] for r in passages.passage_report(df).collect()}
    n = {1: len(text.split()), 2: len(copy.split()), 3: len(text[:400_000].split())}
    assert gone[1] == 0 and gone[2] == n[2] - 1 and gone[3] >= n[3] - 1
    kept = {r["doc_id"]: r["longest_repeat"] for r in quality.quality_features(df).collect()}
    assert kept[1] == kept[2] == 60
    shared = {r["doc_id"]: r["n_dropped"] for r in lines.line_report(df).collect()}
    assert shared == {1: 0, 2: 0, 3: 0}
    packed = packing.pack_documents(df.where("doc_id = 1"), public.path("byte_bpe_50k.json"), keep_ids=True).orderBy("piece").collect()
    from figshelf.llm.tokens import Encoder

    want = Encoder.of(public.path("byte_bpe_50k.json")).tokenizer.encode(text, add_special_tokens=False).ids + [0]
    assert zlib.crc32(b"".join(r["ids"] for r in packed)) == zlib.crc32(np.array(want, "<u4").tobytes())


def test_memory_of_a_long_text():
    """64 MB of text in a process of its own: shingle sets, minimisers and ids stay within a bound."""
    import multiprocessing

    with multiprocessing.get_context("spawn").Pool(1) as pool:
        peaks = pool.apply(_peaks)
    assert peaks["sets"] < 900 and peaks["minimisers"] < 900 and peaks["ids"] < 1500, peaks


def _peaks():
    import resource

    from figshelf.llm.tokens import Encoder

    peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
    column, out = pa.array([long_text(4 << 20) * 16]), {}
    begun = peak()
    assert sum(len(x[1]) for x in near_duplicates._sets(column)) > 0
    out["sets"] = peak() - begun
    assert sum(len(passages.super_kmers(w, 50, 20)[0]) for _, _, w in passages._chunks(column, 50)) > 0
    out["minimisers"] = peak() - begun
    assert len(next(Encoder(public.path("byte_bpe_50k.json")).encode_column(column))) > 0
    out["ids"] = peak() - begun
    return out


def test_mixing_does_not_depend_on_arrival(spark):
    """Exact copies under other ids in the block cut short, in other orders and partitions."""
    rng = random.Random(8)
    rows = [(i, "same text for all of these" if i < 60 else " ".join(["w"] * rng.randint(1, 30)), rng.choice("abc")) for i in range(120)] + [(None, "same text for all of these", "a")] * 5
    plans = []
    for k, parts in enumerate((1, 3, 7, 1)):
        random.Random(k).shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
        plans.append(sorted(((r["id"] is not None, r["id"] or 0, r["source"], r["size"], len(r["shards"])) for r in mixing.mix_plan(df).collect())))
    assert len(plans[0]) == 125 and all(p == plans[0] for p in plans[1:])


def test_documents_that_fit():
    size, count = np.array([9, 5, 4, 0]), np.array([3, 2, 1, 4])
    assert mixing.fits(size, count, 20).tolist() == [2, 0, 0, 4]
    assert mixing.fits(size, count, 21).tolist() == [2, 0, 1, 4]  # one 4 more, 1 over, is nearer than 3 short
    assert mixing.fits(size, count, 41).tolist() == [3, 2, 1, 4]


@pytest.mark.parametrize("small", [near_duplicates.SMALL, 1])
def test_recall_near_the_threshold(spark, monkeypatch, small):
    """Pairs of similarity just over 0.75, with nodes that do not branch and with nodes that all do."""
    monkeypatch.setattr(near_duplicates, "SMALL", small)
    if small == 1:
        monkeypatch.setattr(near_duplicates, "LARGE", 2)
    rng = random.Random(11)
    rows = []
    for k in range(400):
        base = [f"x{rng.randrange(10**6)}" for _ in range(204)]
        other = base[:175] + [f"y{rng.randrange(10**6)}" for _ in range(29)]  # 171 of 229 shingles: 0.747; one word less: 0.754
        other[175] = base[175]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    grams = [{tuple(t.split()[j : j + 5]) for j in range(200)} for _, t in rows]
    near = [k for k in range(400) if 100 * len(grams[2 * k] & grams[2 * k + 1]) >= 75 * len(grams[2 * k] | grams[2 * k + 1])]
    found = {r["id"]: r["component_id"] for r in near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    linked = [k for k in range(400) if found[2 * k + 1] == 2 * k]
    assert len(near) == 400 and set(linked) <= set(near) and len(linked) >= 0.99 * len(near), len(linked)


def test_likely_rows(spark):
    rows = spark.range(5000).select("id", F.xxhash64("id").alias("r"))
    wanted = rows.where("id % 50 = 3").select("r")
    got = {r["id"] for r in common.likely_in(rows, wanted, "r").collect()}
    assert got >= {i for i in range(5000) if i % 50 == 3} and len(got) < 200
    assert common.likely_in(rows, wanted.limit(0), "r").count() == 0


def test_hash_is_of_the_text(spark):
    made = {r["doc_id"]: r["kept_sha256"] for r in lines.line_report(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()}
    assert made == {1: hashlib.sha256(b"").hexdigest(), 2: hashlib.sha256(b"").hexdigest()}
