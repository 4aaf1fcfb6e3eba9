"""Connected components by contraction in a random order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node with an edge; root is one node of its
    component, the same for all of them.

    In each round every node goes to the neighbour, itself included, that comes
    first in an order of the round's own (a hash), and the edges are redrawn
    between where their ends went; loops fall away. Whatever the graph's shape
    a round leaves three quarters of the nodes or fewer on average. Edges never
    grow in number, high degrees meet partial aggregates and joins that
    adaptive execution can split, and each round is written to the shared
    folder.
    """
    e = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct()
    e = settle(e, "cc0")
    found, rounds = None, 0
    while not e.isEmpty():
        rounds += 1
        order = lambda c: F.struct(F.xxhash64(F.lit(rounds), c).alias("h"), F.col(c).alias("n"))
        ends = F.array(F.struct(F.col("u").alias("x"), order("v").alias("o")), F.struct(F.col("v").alias("x"), order("u").alias("o")))
        first = e.select(F.explode(ends).alias("r")).groupBy("r.x").agg(F.min("r.o").alias("o"))
        goes = settle(first.select("x", F.least("o", order("x"))["n"].alias("to")), f"cc{rounds}-goes")
        left = e.join(goes, F.col("u") == F.col("x")).select(F.col("to").alias("p"), "v")
        both = left.join(goes, F.col("v") == F.col("x")).select("p", F.col("to").alias("q")).where("p <> q")
        e = settle(both.select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).distinct(), f"cc{rounds}")
        if found is None:
            found = goes.select(F.col("x").alias("node"), F.col("to").alias("root"))
        else:
            step = goes.select("x", F.col("to").alias("then"))
            found = settle(found.join(step, F.col("root") == F.col("x"), "left").select("node", F.coalesce("then", "root").alias("root")), f"cc{rounds}-found")
    return found if found is not None else e.select(F.col("u").alias("node"), F.col("v").alias("root"))
