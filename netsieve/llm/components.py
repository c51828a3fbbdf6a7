"""Connected components of an edge table, by alternating large and small stars.

Nodes are longs; each round replaces edges by edges to the smallest neighbour
until every component is a star around its smallest node, after a number of
rounds that grows with the logarithm of the nodes. No step gathers a node's
neighbours: the smallest is a partial aggregate, joined back to the edges, and
as both sides of that join come from written tables, Spark splits a node with
very many edges over several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsieve.llm.shared import Tables


def _checked(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(edges: DataFrame, tables: Tables) -> DataFrame:
    """edges: (a long, b long). Returns (node, root) for each node with an edge, root being the smallest node reachable; roots themselves are left out.

    Null ends are dropped, loops and repeated edges change nothing, and an
    empty table gives an empty one.
    """
    now = tables.write(edges.where("a <> b").select("a", "b").distinct(), "edges_0")
    before, state, k = None, _checked(now), 0
    while state != before and state[0]:
        k += 1
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = tables.write(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), f"large_{k}")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = tables.write(large, f"stars_{k}")
        # every edge now leads to a smaller node
        least = tables.write(large.groupBy("a").agg(F.min("b").alias("m")), f"small_{k}")
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = tables.write(small.unionByName(least.withColumnRenamed("m", "b")).distinct(), f"edges_{k}")
        before, state = state, _checked(now)
        for name in (f"edges_{k - 1}", f"large_{k}", f"stars_{k}", f"small_{k}"):
            tables.drop(name)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
