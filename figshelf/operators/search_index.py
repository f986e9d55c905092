"""Many ranked searches at once, through an index of the catalogue's texts.

The index has each different text once (`texts`), posting lists of its characters and pairs of neighbouring characters, each list
by length of the text (`postings`, and how many texts of each length a list has: `grams`), and the rows of each text (`members`).

No text can score better than what its length and the pairs it lacks leave: each part of a query that does not follow right after
the one before costs a run, and it does not where the pair of their letters is nowhere in the text. A search goes through the
posting lists of its query's pairs and of its rarest letter, shortest texts first; the candidates of the best bounds are scored first,
and the k-th best score ends the lists (by length) and drops candidates (by bound). All others are scored, by the same expression as
`catalogue.ranked_search`, so the result is the same.

Null texts are in no result, nor is a null query; a query of nothing but white space scores 0 everywhere. Ties go to the smaller key.
Rows that share a key and a text come as often as they are there.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from figshelf.functions.ranking import score_by_parts, tokens
from figshelf.sources.storage import new_folder, stored

#: Texts in a list of the rarest letter that a search begins with, for each row wanted.
FIRST = 4
SLACK = 1e-9  # sums of a bound and of a score may be rounded otherwise
PLAN = (
    "query_id {}, words array<string>, letters array<string>, length int, n_within int, n_cross int, n_next int, word_cost double, letter_cost double,"
    " grams array<struct<gram: string, within: int, cross: int, next: int, letter: boolean>>"
)


@dataclass(frozen=True)
class SearchIndex:
    texts: DataFrame  # text_id, text, n_rows, least_key
    postings: DataFrame  # gram, length, text_id
    grams: DataFrame  # gram, length, n
    members: DataFrame  # text_id, key


def build_search_index(figures: DataFrame, path: str, by: str = "caption", key: str = "figure_id") -> SearchIndex:
    """Write the index of a text column below a folder that is not there yet."""
    spark, text = figures.sparkSession, F.col(by)
    rows = figures.where(text.isNotNull()).select(text.alias("text"), F.col(key).alias("key"))
    texts = rows.groupBy("text").agg(F.count(F.lit(1)).alias("n_rows"), F.min("key").alias("least_key"))
    texts.withColumn("text_id", F.monotonically_increasing_id()).write.parquet(f"{path}/texts")
    texts = spark.read.parquet(f"{path}/texts")
    members = rows.join(texts.select("text", "text_id"), "text").select("text_id", "key")
    members.repartitionByRange("text_id", "key").sortWithinPartitions("text_id", "key").write.parquet(f"{path}/members")
    chars = F.split(F.lower("text"), "")
    pairs = F.transform(chars, lambda c, i: F.concat(c, F.get(chars, i + 1)))
    grams = F.explode(F.array_distinct(F.filter(F.concat(chars, pairs), lambda g: g.isNotNull() & (g != ""))))
    listed = texts.select(grams.alias("gram"), F.length("text").alias("length"), "text_id")
    listed.repartitionByRange("gram", "length", "text_id").sortWithinPartitions("gram", "length", "text_id").write.parquet(f"{path}/postings")
    spark.read.parquet(f"{path}/postings").groupBy("gram", "length").agg(F.count(F.lit(1)).alias("n")).repartitionByRange("gram", "length").write.parquet(f"{path}/grams")
    return open_search_index(spark, path)


def open_search_index(spark: SparkSession, path: str) -> SearchIndex:
    return SearchIndex(*(spark.read.parquet(f"{path}/{name}") for name in ("texts", "postings", "grams", "members")))


def query_plan(query: str) -> dict:
    """What a query (not blank) needs: its parts, and its grams with what each is for.

    within: a pair inside a token (without it the tokens are not in the text); cross, next: how often the pair leads from a token, or from a
    character, to the following one (without it they are in different runs); letter: a character that must be there.
    """
    words, letters = tokens(query), list(query.lower())
    within = {w[i : i + 2] for w in words for i in range(len(w) - 1)}
    cross = Counter(a[-1] + b[0] for a, b in zip(words, words[1:]))
    next_ = Counter(a + b for a, b in zip(letters, letters[1:]))
    # every character of a token is needed; white space only where single characters are looked for
    needed = set("".join(words))
    grams = [{"gram": g, "within": int(g in within), "cross": cross[g], "next": next_[g], "letter": False} for g in sorted(within | set(cross) | set(next_))]
    grams += [{"gram": g, "within": 0, "cross": 0, "next": 0, "letter": True} for g in sorted(needed)]
    cost = lambda parts: (sum(map(len, parts)) + 1 - len(query)) / 100
    return {
        "words": words, "letters": letters, "length": len(query), "n_within": len(within), "n_cross": cross.total(), "n_next": next_.total(),
        "word_cost": cost(words), "letter_cost": cost(letters), "grams": grams,
    }


@dataclass(frozen=True)
class _Search:
    """The stored steps of one run of searches."""

    plans: DataFrame  # query_id and the plan of each query that is not blank
    others: DataFrame  # query_id, text_id, length, bound: candidates beside the first scored
    scored: DataFrame  # those of the best bounds, and all others that the k-th best score leaves


def _candidates(index: SearchIndex, plans: DataFrame, grams: DataFrame, limits: DataFrame) -> DataFrame:
    """(query_id, text_id, length, bound) of the texts whose lengths are over `low` and up to `high` of a query's limits."""
    wanted = grams.join(limits, "query_id")
    hits = index.postings.join(wanted, "gram").where((F.col("length") > F.col("low")) & (F.col("length") <= F.col("high")))
    sums = [F.sum(c).alias(f"has_{c}") for c in ("within", "cross", "next")]
    met = hits.groupBy("query_id", "text_id").agg(F.max("length").alias("length"), F.bool_or("letter").alias("letter"), *sums).where("letter")
    rows = met.join(plans.select("query_id", "n_within", "n_cross", "n_next", "word_cost", "letter_cost"), "query_id")
    by_word = F.when(F.col("has_within") == F.col("n_within"), F.col("has_cross") - F.col("n_cross") - F.col("word_cost"))
    bound = F.greatest(by_word, F.col("has_next") - F.col("n_next") - F.col("letter_cost")) - F.col("length") / 10000.0
    return rows.select("query_id", "text_id", "length", bound.alias("bound"))


def _scored(index: SearchIndex, plans: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, text_id, n_rows, least_key, score) of candidates; score is null where the query is not found after all."""
    parts = plans.select("query_id", "words", "letters", F.col("length").alias("query_length"))
    rows = candidates.select("query_id", "text_id").join(index.texts, "text_id").join(parts, "query_id")
    score = score_by_parts(F.col("text"), F.col("words"), F.col("letters"), F.col("query_length"))
    return rows.select("query_id", "text_id", "n_rows", "least_key", score.alias("score"))


def _search(index: SearchIndex, queries: DataFrame, k: int) -> _Search:
    kind = dict(queries.dtypes)["query_id"]

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"query_id": i} | query_plan(q) for i, q in zip(batch["query_id"], batch["query"]) if q is not None and tokens(q)]
            yield pd.DataFrame(rows, columns=["query_id", "words", "letters", "length", "n_within", "n_cross", "n_next", "word_cost", "letter_cost", "grams"])

    plans = stored(queries.select("query_id", "query").mapInPandas(plan, PLAN.format(kind)), "search-plans")
    each = plans.select("query_id", F.inline("grams"))
    # the letter with the shortest list stands for all letters; one that no text has ends the search
    sizes = index.grams.groupBy("gram").agg(F.sum("n").alias("n"))
    rarest = each.where("letter").join(sizes, "gram", "left").groupBy("query_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "gram"))["gram"].alias("gram"))
    pairs = each.where("NOT letter")
    grams = stored(pairs.unionByName(each.where("letter").join(rarest, ["query_id", "gram"])), "search-grams")
    # where to stop at first: the length up to which that list has FIRST times k texts
    lists = rarest.join(index.grams, "gram")
    upto = F.sum("n").over(Window.partitionBy("query_id").orderBy("length"))
    lists = lists.withColumn("upto", upto)
    first_end = F.coalesce(F.min(F.when(F.col("upto") >= FIRST * k, F.col("length"))), F.max("length"))
    ends = stored(lists.groupBy("query_id").agg(first_end.alias("end"), F.max("length").alias("last")), "search-ends")

    first = stored(_candidates(index, plans, grams, ends.select("query_id", F.lit(-1).alias("low"), F.col("end").alias("high"))), "search-first")
    best = stored(_scored(index, plans, _best_bounds(first, k)), "search-best")
    most = F.greatest(-F.col("word_cost"), -F.col("letter_cost"))
    proof = _proof(plans.select("query_id", most.alias("most")), best, k)
    longest = F.floor((F.col("most") - F.col("least") + SLACK) * 10000)
    high = F.coalesce(F.least(F.col("last"), longest), F.col("last")).cast("int")
    limits = ends.join(proof, "query_id").select("query_id", F.col("end").alias("low"), high.alias("high")).where("high > low")
    others = first.join(best.select("query_id", "text_id"), ["query_id", "text_id"], "left_anti").unionByName(_candidates(index, plans, grams, limits))
    others = stored(_not_below(others, proof), "search-others")
    # the best bounds of all lengths, for a better proof
    second = stored(_scored(index, plans, _best_bounds(others, FIRST * k)), "search-second")
    proof = _proof(proof.select("query_id"), best.unionByName(second), k)
    left = _not_below(others.join(second.select("query_id", "text_id"), ["query_id", "text_id"], "left_anti"), proof)
    return _Search(plans, others, best.unionByName(second).unionByName(stored(_scored(index, plans, left), "search-left")))


def _best_bounds(candidates: DataFrame, n: int) -> DataFrame:
    """Of each query the n candidates of the best bounds."""
    by_bound = Window.partitionBy("query_id").orderBy(F.desc("bound"), "text_id")
    return candidates.withColumn("place", F.row_number().over(by_bound)).where(F.col("place") <= n)


def _proof(queries: DataFrame, scored: DataFrame, k: int) -> DataFrame:
    """queries with `least`: the score of the k-th row of scored texts; null if there are fewer rows."""
    so_far = F.sum("n_rows").over(Window.partitionBy("query_id").orderBy(F.desc("score"), "text_id"))
    reached = scored.where("score IS NOT NULL").withColumn("so_far", so_far).where(F.col("so_far") >= k)
    return stored(queries.join(reached.groupBy("query_id").agg(F.max("score").alias("least")), "query_id", "left"), "search-proof")


def _not_below(candidates: DataFrame, proof: DataFrame) -> DataFrame:
    """Candidates that can still reach the k-th score."""
    rows = candidates.join(proof.select("query_id", "least"), "query_id")
    return rows.where(F.col("least").isNull() | (F.col("bound") + SLACK >= F.col("least"))).drop("least")


def search_many(index: SearchIndex, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, key, score): the k best rows for each of queries (query_id, query), the first at rank 1.

    Equal queries are searched for once.
    """
    asked = queries.where("query IS NOT NULL").select(F.col("query").alias("query_id"), "query").distinct()
    hits = _search(index, asked, k).scored.where("score IS NOT NULL")
    # a text below k others, each with a better row, has none of the k best rows
    of_texts = Window.partitionBy("query_id").orderBy(F.desc("score"), "least_key")
    texts = stored(hits.withColumn("place", F.row_number().over(of_texts)).where(F.col("place") <= k).select("query_id", "text_id", "score"), "search-texts")
    # of a text that many rows share its k first keys are enough
    mine = index.members.join(texts.select("text_id").distinct(), "text_id")
    mine = mine.withColumn("place", F.row_number().over(Window.partitionBy("text_id").orderBy("key"))).where(F.col("place") <= k)
    rows = texts.join(mine.select("text_id", "key"), "text_id").select("query_id", "key", "score")
    blank = asked.where(F.regexp_replace("query", r"(?U)[\s\x1c-\x1f]", "") == "").select("query_id")
    least = index.members.orderBy("key").limit(k).select("key", F.lit(0.0).alias("score"))
    rows = rows.unionByName(blank.join(F.broadcast(least), F.lit(True)).select("query_id", "key", "score"))  # k rows for each blank query, as asked
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key"))
    best = rows.withColumn("rank", rank).where(F.col("rank") <= k).withColumnRenamed("query_id", "query")
    return queries.select("query_id", "query").join(best, "query").select("query_id", "rank", "key", "score")


def search_work(index: SearchIndex, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, n_bounds, n_scored): texts that were left with a bound only or scored later, and texts scored, for queries that are not blank."""
    found = _search(index, queries, k)
    count = lambda df, name: df.groupBy("query_id").agg(F.count(F.lit(1)).alias(name))
    rows = found.plans.select("query_id").join(count(found.others, "n_bounds"), "query_id", "left").join(count(found.scored, "n_scored"), "query_id", "left")
    return rows.select("query_id", F.coalesce("n_bounds", F.lit(0)).alias("n_bounds"), F.coalesce("n_scored", F.lit(0)).alias("n_scored"))


def ranked_searches(figures: DataFrame, queries: DataFrame, k: int, by: str = "caption", key: str = "figure_id") -> DataFrame:
    """search_many through an index made for the occasion."""
    return search_many(build_search_index(figures, new_folder(figures.sparkSession, "search-index"), by, key), queries, k)
