"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source has a share of all words in proportion to its weight, and at most `most` times its own words; what is above goes to the
other sources by weight until none is above. A source's documents fall into blocks of about equal size by a hash, and its blocks
into a fixed random order. The mix takes whole passes over them, then as many further blocks as the target has room for, and
from the next one the largest documents that fit. So much is decided exactly, for each source.

These block quotas are dealt to output shards by a tree: a node splits its shards in two and its quotas by one multivariate
hypergeometric draw, seeded by the node. Every shard finds its own quotas on its way down from the root, so shards are computed in
parallel and agree. A shard's quota of a source is the next run of blocks in that source's order; runs of different
shards are disjoint. Inside a shard the documents are ordered by a hash.

Only one row for each source (its weight, words and quota) goes through the driver. Null texts have size 0 and null
sources are one source, the last. Rows equal in all columns are told apart by a number, so each is taken on its own count. Reruns agree. No column
name is reserved; columns of map type do not tell rows apart. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import gcd

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadgauge.functions.measure import COPIES_PER_ROW, split_copies
from leadgauge.llm.hashing import SPACE, word_bounds
from leadgauge.llm.shared import quoted, row_of, small_or_shuffled, stored, text_chunks, text_or_empty

BLOCK_WORDS = 1 << 16
BLOCK_ROWS = 1 << 12
SHARD_WORDS = 1 << 26
#: Blocks whose sizes are summed up in one go.
RUN_BLOCKS = 1 << 10


@dataclass
class Source:
    name: str | None
    number: int
    words: int
    blocks: int
    target: Fraction
    step: int
    start: int

    @property
    def passes(self) -> int:
        return int(self.target // self.words) if self.words else 0

    @property
    def rest(self) -> int:
        return round(self.target - self.passes * self.words) if self.words else 0


def targets(words: list[int], weights: list[int], most: int) -> list[Fraction]:
    """Shares of the sum of all words by weight, none above `most` times its own; exact."""
    left, open_sources = Fraction(sum(words)), set(range(len(words)))
    result = [Fraction(0)] * len(words)
    while open_sources:
        unit = left / sum(weights[i] for i in open_sources)
        full = {i for i in open_sources if unit * weights[i] > most * words[i]}
        for i in full or open_sources:
            result[i] = Fraction(most * words[i]) if full else unit * weights[i]
        if not full:
            break
        left -= sum(result[i] for i in full)
        open_sources -= full
    return result


def _row_keys(docs: DataFrame) -> tuple[Column, Column]:
    told = [F.col(quoted(c)) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    return F.xxhash64(F.lit(1), *told), F.xxhash64(F.lit(2), *told)


def sized(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source") -> DataFrame:
    """(doc_id, key, key2, source, size, number): a row for each document; number tells equal rows apart."""
    key, key2 = _row_keys(docs)
    columns = [F.col(f"`{id_column}`").alias("doc_id"), key.alias("key"), key2.alias("key2")]
    columns += [F.col(f"`{source_column}`").cast("string").alias("source"), text_or_empty().alias("text")]
    rows = docs.select(*columns)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for _, data, offsets in text_chunks(batch.column(4)):
                starts, _ = word_bounds(data, offsets, SPACE)
                sizes.append(np.diff(np.searchsorted(starts, offsets)))
            size = pa.array(np.concatenate(sizes) if sizes else [], pa.int64())
            names = ["doc_id", "key", "key2", "source", "size"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], size], names)

    counted = rows.mapInArrow(count, f"doc_id {kind}, key long, key2 long, source string, size long")
    counted = counted.groupBy("doc_id", "key", "key2", "source", "size").agg(F.count("*").alias("copies"))
    parts = split_copies(counted)
    numbers = F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)
    parts = parts.withColumn("number", F.explode(numbers)).withColumn("number", F.col("piece") * COPIES_PER_ROW + F.col("number"))
    return parts.drop("copies", "piece")


def plan_sources(units: DataFrame, weights: tuple[int, ...], most: int, seed: int) -> list[Source]:
    totals = units.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("rows")).collect()
    totals.sort(key=lambda t: (t["source"] is None, t["source"] or ""))
    words = [t["words"] for t in totals]
    aims = targets(words, [weights[i % len(weights)] for i in range(len(words))], most)
    sources = []
    for i, (total, aim) in enumerate(zip(totals, aims)):
        blocks = max(1, -(-total["words"] // BLOCK_WORDS), -(-total["rows"] // BLOCK_ROWS))
        generator = np.random.default_rng([seed, i])
        step = int(generator.integers(1, blocks + 1))
        while gcd(step, blocks) != 1:
            step += 1
        sources.append(Source(total["source"], i, total["words"], blocks, aim, step, int(generator.integers(blocks))))
    return sources


def source_table(spark: SparkSession, sources: list[Source]) -> DataFrame:
    rows = [
        (s.name, s.number, s.words, s.blocks, float(s.target), s.step, s.start, s.passes, s.rest) for s in sources
    ]
    schema = "source string, source_number int, source_size long, blocks long, target double, step long, start long, "
    return spark.createDataFrame(rows, schema + "passes int, rest long")


def placed(units: DataFrame, table: DataFrame, sources: int, seed: int) -> DataFrame:
    """The documents with their source's numbers and `place`, that of their block in the source's order."""
    joined = units.join(small_or_shuffled(table, sources), units["source"].eqNullSafe(table["source"])).drop(table["source"])
    block = F.pmod(F.xxhash64("key", "key2", "number", F.lit(seed)), F.col("blocks"))
    return joined.withColumn("place", F.pmod(block * F.col("step") + F.col("start"), F.col("blocks")))


def last_blocks(rows: DataFrame) -> DataFrame:
    """(source_number, whole, room): blocks that the last pass takes whole, and the words still missing after them."""
    sizes = rows.groupBy("source_number", "place", "rest").agg(F.sum("size").alias("words"))
    sizes = sizes.withColumn("run", F.floor(F.col("place") / RUN_BLOCKS))
    runs = sizes.groupBy("source_number", "run").agg(F.sum("words").alias("words"))
    before = Window.partitionBy("source_number").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("source_number", "run", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("source_number", "run").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    sums = sizes.withColumn("inside", F.sum("words").over(within)).join(runs, ["source_number", "run"])
    sums = sums.withColumn("through", F.col("ahead") + F.col("inside"))
    fits = F.when(F.col("through") <= F.col("rest"), F.col("place") + 1).otherwise(0)
    taken = F.when(F.col("through") <= F.col("rest"), F.col("through")).otherwise(0)
    # Totals only grow with the place, so the last block that fits has the greatest place and total. A place without
    # documents has no words and may count as taken.
    ends = sums.groupBy("source_number").agg(F.max(fits).alias("whole"), F.max(taken).alias("words"), F.first("rest").alias("rest"))
    missing = sums.filter("through > rest").groupBy("source_number").agg(F.min("place").alias("next"))
    ends = ends.join(missing, "source_number", "left")
    return ends.select(
        "source_number", F.coalesce("next", "whole").alias("whole"), (F.col("rest") - F.col("words")).alias("room")
    )


def _fitting(block: pd.DataFrame) -> pd.DataFrame:
    """The documents of a block that fill the room left: the largest first, each that still fits, and one more if that
    comes nearer."""
    block = block.sort_values(["size", "order"], ascending=[False, True], ignore_index=True)
    room = int(block["room"].iloc[0]) if len(block) else 0
    chosen = []
    for i, size in enumerate(block["size"]):
        if 0 < size <= room:
            chosen.append(i)
            room -= size
    rest = block[~block.index.isin(chosen) & (block["size"] > 0)]
    if len(rest) and abs(room - rest["size"].iloc[-1]) < room:
        chosen.append(rest.index[-1])
    return block.loc[sorted(chosen), ["key", "key2", "number"]]


def quotas(spark: SparkSession, sources: list[Source], blocks: list[int], shards: int, seed: int) -> DataFrame:
    """(shard, source_number, first, n): each shard's run of blocks of each source, found by descent of the tree."""

    def descend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"].tolist():
                low, high, quota, first = 0, shards, np.array(blocks, dtype=np.int64), np.zeros(len(blocks), dtype=np.int64)
                while high - low > 1:
                    middle = (low + high) // 2
                    total = int(quota.sum())
                    size = total * (middle - low) // (high - low)
                    generator = np.random.default_rng([seed, low, high])
                    left = generator.multivariate_hypergeometric(quota, size, method="marginals") if total else quota
                    if shard < middle:
                        high, quota = middle, left
                    else:
                        low, first, quota = middle, first + left, quota - left
                yield pd.DataFrame({"shard": shard, "source_number": np.arange(len(blocks)), "first": first, "n": quota})

    schema = "shard long, source_number int, first long, n long"
    parts = max(1, min(shards, 64))
    return spark.range(0, shards, 1, parts).mapInPandas(descend, schema)


@dataclass
class Mix:
    """`documents`: every row with its source's size, target and the number of times it is taken. `copies`: every
    taken copy with shard and order inside the shard."""

    documents: DataFrame
    copies: DataFrame


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    most: int = 3,
    seed: int = 7,
    shard_words: int = SHARD_WORDS,
    id_column: str = "doc_id",
    source_column: str = "source",
) -> Mix:
    spark = docs.sparkSession
    units = stored(sized(docs, id_column, source_column), "sizes")
    sources = plan_sources(units, weights, most, seed)
    rows = placed(units, source_table(spark, sources), len(sources), seed)
    ends = last_blocks(rows)
    rows = rows.join(small_or_shuffled(ends, len(sources)), "source_number")
    order = F.xxhash64("key", "key2", "number", F.lit(seed + 1)).alias("order")
    partial = rows.filter("place = whole and room > 0").select("source_number", "key", "key2", "number", "size", "room", order)
    fill = partial.groupBy("source_number").applyInPandas(_fitting, "key long, key2 long, number long")
    chosen = fill.withColumn("chosen", F.lit(1))
    rows = rows.join(chosen, ["key", "key2", "number"], "left")
    last = F.when(F.col("place") < F.col("whole"), 1).otherwise(F.coalesce("chosen", F.lit(0)))
    last = F.when(F.col("rest") > 0, last).otherwise(0)
    decided = stored(rows.withColumn("last", last).drop("chosen", "step", "start"), "decided")

    # Passes over all blocks of a source, then the blocks of the last pass; the partial one counts as a block.
    used = decided.filter("last = 1").groupBy("source_number").agg(F.max("place").alias("at")).collect()
    further = {row["source_number"]: row["at"] + 1 for row in used}
    blocks = [s.passes * s.blocks + further.get(s.number, 0) for s in sources]
    shards = max(1, -(-sum(s.words for s in sources) // shard_words))
    runs = quotas(spark, sources, blocks, shards, seed).filter("n > 0")
    positions = runs.select(
        "shard", "source_number", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("position")
    )
    passes = F.sequence(F.lit(0), F.col("passes") - 1 + F.col("last"))
    taken = decided.filter(F.col("passes") + F.col("last") > 0).withColumn("copy", F.explode(passes))
    taken = taken.withColumn("position", F.col("copy") * F.col("blocks") + F.col("place"))
    taken = taken.join(positions, ["source_number", "position"])
    inside = Window.partitionBy("shard").orderBy(F.xxhash64("key", "key2", "number", "copy"), "key", "number", "copy")
    copies = taken.withColumn("order", F.row_number().over(inside))
    return Mix(
        decided.select("doc_id", "key", "key2", "number", "source", "size", "source_size", "target"),
        copies.select("key", "key2", "number", "copy", "shard", "order", "size"),
    )


def taken_words(mixed: Mix) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies) of every row."""
    counts = mixed.copies.groupBy("key", "key2", "number").agg(F.count("*").alias("copies"))
    rows = mixed.documents.join(counts, ["key", "key2", "number"], "left")
    copies = F.coalesce("copies", F.lit(0)).cast("long")
    taken = (copies * F.col("size")).alias("taken")
    return rows.select("doc_id", "source", "size", "source_size", "target", taken, copies.alias("copies"))


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """Every taken copy with all columns of its document, then shard and order, named so as not to clash."""
    copies = mix(docs, **settings).copies
    key, key2 = _row_keys(docs)
    names = {c.lower() for c in docs.columns}
    shard, order = "shard", "order"
    while names & {shard, order}:
        shard, order = f"mix_{shard}" if shard in names else shard, f"mix_{order}" if order in names else order
    whole = docs.select(row_of(docs).alias("row"), key.alias("key"), key2.alias("key2"))
    whole = whole.dropDuplicates(["key", "key2"])  # equal rows; the copies tell how often each is taken
    return whole.join(copies, ["key", "key2"]).select("row.*", F.col("shard").alias(shard), F.col("order").alias(order))
