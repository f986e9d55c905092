"""Many searches through the index equal one ranked search after another."""

import random

import pytest
from pyspark.sql import functions as F

from figshelf.operators import catalogue
from figshelf.operators.search_index import build_search_index, ranked_searches, search_many, search_work


def catalogue_rows(spark, n, seed):
    rng = random.Random(seed)
    words = ["Figure", "fig", "Table", "urgent", "URGENT", "gi", "1", "12", "2", ":", "-", "图", "表", "eFig", "x", "İ", "ß", "\t"]
    texts = ["".join(rng.choice(words) + rng.choice(["", " ", " ", "  "]) for _ in range(rng.randint(0, 9))) for _ in range(n)]
    texts[::7] = ["Figure 1: urgent"] * len(texts[::7])
    rows = [(i, t) for i, t in enumerate(texts)] + [(n, None), (n + 1, ""), (3, texts[3])]
    return spark.createDataFrame(rows, "figure_id long, caption string")


QUERIES = ["fig 1", "figure 1: urgent", "图", "图表", "f", "gi gi", "tb2", "1-", "  fig", "fig  ", "zzz", "fiz", "", " ", "\t", "x1x", "FIG", "igi", "ufg", "e12", "ß", "1 1", "i̇"]


@pytest.mark.parametrize("k", [1, 5, 60, 1000])
def test_equals_single_searches(spark, tmp_path, k):
    figures = catalogue_rows(spark, 300, k)
    queries = spark.createDataFrame([*enumerate(QUERIES), (99, None)], "query_id long, query string")
    index = build_search_index(figures, f"file://{tmp_path}/index")
    got = {}
    for r in search_many(index, queries, k).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["key"], r["score"]))
    for i, q in enumerate(QUERIES):
        want = [(r["figure_id"], r["score"]) for r in catalogue.ranked_search(figures, q, k).collect()]
        assert got.get(i, []) == [(n, key, s) for n, (key, s) in enumerate(want, 1)], q
    assert 99 not in got


def test_few_texts_are_scored(spark, tmp_path):
    """Of 20,000 texts that all hold the letters, those that the proof leaves."""
    figures = spark.range(20000).select(F.col("id").alias("figure_id"), F.concat(F.when(F.col("id") % 50 == 0, "Figure ").otherwise("f i g u r e "), F.col("id"), F.repeat(F.lit(" x"), (F.col("id") % 97).cast("int"))).alias("caption"))
    queries = spark.createDataFrame([(1, "figure"), (2, "fgre"), (3, "figure 150")], "query_id long, query string")
    index = build_search_index(figures, f"file://{tmp_path}/index")
    work = {r["query_id"]: r for r in search_work(index, queries, 10).collect()}
    assert work[1]["n_scored"] < 500 and work[3]["n_scored"] < 500
    assert work[1]["n_bounds"] < 2000
    assert search_many(index, queries, 10).where("query_id = 1").orderBy("rank").select("key", "score").collect() == catalogue.ranked_search(figures, "figure", 10).select("figure_id", "score").collect()


def test_empty(spark):
    none = spark.createDataFrame([], "figure_id long, caption string")
    queries = spark.createDataFrame([(1, "fig"), (2, "")], "query_id long, query string")
    assert ranked_searches(none, queries, 5).count() == 0
    some = spark.createDataFrame([(7, "Fig. 1")], "figure_id long, caption string")
    assert ranked_searches(some, queries.where("false"), 5).count() == 0
    assert [tuple(r) for r in ranked_searches(some.withColumn("score", F.lit("x")), queries, 5).select("query_id", "rank", "key").orderBy("query_id").collect()] == [(1, 1, 7), (2, 1, 7)]
