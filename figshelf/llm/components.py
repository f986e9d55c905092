"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figshelf.llm.common import Writer
from figshelf.llm.common import written as write_table


def components(links: DataFrame, written: Writer = write_table) -> DataFrame:
    """(v, label): for every end of a link (a, b) one end of its component, the same for all of it.

    Each round every vertex moves to the neighbour that is least in a fresh random order (or stays, if
    it is least itself), the links are drawn anew between the places and loops go. The number of places
    falls by a constant factor in expectation, whatever the shape. Nothing is collected: a vertex
    with very many links is a partial minimum on the map side.
    """
    edges = written(links.select("a", "b").where("a <> b").distinct(), "links")
    labels = written(edges.select(F.col("a").alias("v")).union(edges.select("b")).distinct().withColumn("label", F.col("v")), "labels")
    turn = 0
    while not edges.isEmpty():
        turn += 1
        order = lambda v: F.struct(F.xxhash64(F.lit(turn), v).alias("h"), v.alias("v"))  # noqa: B023, E731  used before the next turn
        ends = edges.select("a", "b").union(edges.select("b", "a"))
        least = ends.groupBy("a").agg(F.min(order(F.col("b"))).alias("m"))
        move = written(least.select("a", F.least(F.col("m"), order(F.col("a"))).alias("m")).select(F.col("a").alias("from"), F.col("m.v").alias("to")).where("from <> to"), "moves")

        def moved(df: DataFrame, column: str, move: DataFrame = move) -> DataFrame:
            return df.join(move, df[column] == move["from"], "left").withColumn(column, F.coalesce("to", column)).drop("from", "to")

        labels = written(moved(labels, "label"), "labels")
        edges = moved(moved(edges, "a"), "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        edges = written(edges, "links")
    return labels
