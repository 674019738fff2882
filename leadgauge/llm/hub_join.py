"""Pairs of texts brought together at one of them: each hub's text goes ahead of its partners' texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadgauge.llm.shared import small_or_shuffled, stored

#: Partners of a hub that one task reads; hubs with more are dealt to several shares, each with the hub's text.
HUB_SHARE = 256
#: Plain rows that a row with carried columns counts as, when it is decided what may be broadcast.
WIDE = 64


def holders_of(rows: DataFrame) -> DataFrame:
    """(node, key, times) of the nodes of rows (node, key): one key for each node, and how many rows have it."""
    times = rows.groupBy("node", "key").agg(F.count("*").alias("times"))
    return times.groupBy("node").agg(F.min(F.struct("key", "times")).alias("first")).select("node", "first.*")


def texts_of_nodes(pairs: DataFrame, holders: DataFrame, keyed: DataFrame) -> DataFrame:
    """(node, text) of the nodes of the pairs (a, b). `holders` is that of holders_of, `keyed` has (key, text); rows with
    equal keys have equal texts.

    Only rows that share their key with others are made distinct, so other texts are not shuffled for it.
    """
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    needed = stored(holders.join(nodes, "node", "left_semi"), "needed")
    held = keyed.select("key", "text").join(small_or_shuffled(needed, needed.count()), "key")
    once = held.filter("times = 1").select("node", "text")
    return once.unionByName(held.filter("times > 1").dropDuplicates(["node"]).select("node", "text"))


def at_hubs(
    pairs: DataFrame, texts: DataFrame, carried: tuple[str, ...] = (), share: int = HUB_SHARE, alone: bool = False, short: bool = False
) -> DataFrame:
    """(b, a, text, carried...) of the pairs (a, b, carried...) as sorted partitions: for each share of a hub b, first
    a row of the hub's own text with a null a, then its partners' rows. `alone` adds whether the share has all partners. `short`
    texts are shuffled to the pairs, which then need not pass the driver to be broadcast."""
    large = pairs.groupBy("b").agg(F.count("*").alias("n")).filter(F.col("n") > share)
    large = stored(large, "large-hubs")
    dealt = pairs.join(small_or_shuffled(large, large.count()), "b", "left")
    part = F.pmod(F.xxhash64("a"), F.coalesce(F.ceil(F.col("n") / share), F.lit(1)).cast("long"))
    own = ("share", *(["alone"] if alone else []))
    dealt = dealt.withColumn("alone", F.col("n").isNull()).select("b", part.alias("share"), "a", "alone", *carried)
    dealt = dealt.select(F.col("a").alias("node"), "b", "a", *own, *carried)
    blank = [F.lit(None).cast(pairs.schema[c].dataType).alias(c) for c in carried]
    hubs = dealt.select("b", *own).distinct()
    hubs = hubs.select(F.col("b").alias("node"), "b", F.lit(None).cast("long").alias("a"), *own, *blank)
    wanted = dealt.unionByName(hubs)  # at most twice as many rows as pairs
    rows = texts.join(wanted if short else small_or_shuffled(wanted, pairs.count() * (WIDE if carried else 2)), "node")
    rows = rows.select("b", "a", "text", *own, *carried).repartition("b", "share")
    return rows.sortWithinPartitions("b", "share", F.asc_nulls_first("a")).select("b", "a", "text", *own[1:], *carried)
