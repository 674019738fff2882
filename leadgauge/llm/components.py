"""Connected components of a distributed edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadgauge.llm.shared import BROADCAST_ROWS, discard, stored

#: Edges that one task writes: few edges make few files, whatever the number of shuffle partitions.
TASK_EDGES = 100_000


def _both_ways(edges: DataFrame) -> DataFrame:
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return edges.select("a", "b").unionByName(turned)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): the smallest node of its component.

    Each round first ties a node's larger neighbours to its least one, then its smaller ones, and writes the result;
    the edges end as one star for each component after about log(nodes) rounds. No neighbourhood is gathered: the
    least neighbour is an aggregate, and pairs are joined to it: as a broadcast while the pairs are few, else from a stored
    table, so that Spark can split the rows of a node with very many neighbours. A round that changes nothing is the last.
    Edges are written by as many tasks as the last count asks for.
    """
    pairs = stored(edges.filter(F.col("a") != F.col("b")).select("a", "b").distinct(), "edges")
    mark, rows = None, pairs.count()

    def joined(least: DataFrame) -> DataFrame:
        return F.broadcast(least) if 2 * rows <= BROADCAST_ROWS else stored(least, "least")

    def few(found: DataFrame) -> DataFrame:
        return found.coalesce(rows // TASK_EDGES + 1)

    while True:
        ways = _both_ways(pairs)
        least = joined(ways.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least")))
        large = ways.join(least, "a").filter(F.col("b") > F.col("a"))
        large = large.select(F.col("b").alias("a"), F.col("least").alias("b"))
        # Now a > b everywhere: tie each node's smaller neighbours, and itself, to the least of them.
        low = joined(large.groupBy("a").agg(F.min("b").alias("least")))
        tied = large.join(low, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        small = tied.unionByName(low.select("a", F.col("least").alias("b"))).filter("a <> b").distinct()
        old, pairs = pairs, stored(few(small), "edges")
        discard(old)
        before, mark = mark, pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
        rows = mark[0]
        if mark == before:
            leaves = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return few(leaves.unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
