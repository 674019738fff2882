"""Exact top-k inner products by ball trees, one for each shard of the vectors.

Components become whole numbers, floor(256 x) by default, so scores are exact. Vectors are dealt to shards of bounded size. A
task reads a shard's vectors, builds its ball tree and then searches it for one block of queries after the other; queries are
copied to the shards, vectors are not. Each node splits at the median of its widest axis and keeps centre and radius; no member's inner product
with query q is above q.centre + |q| radius. A search first descends from the root into the child of higher bound, down to a leaf, and
then searches the rest by falling bounds, each child only if its bound reaches the query's kth score so far. Queries descend
together, each by its own bounds.
The kth score is shared between shards: each query first searches its own shard, and the kth score found there is where
its search of every other shard begins.

Vectors that are null or hold a null or non-finite component take no part. Vectors of each length are searched by
themselves. Ties go to the smaller id, null ids last. Rows with equal ids are vectors of their own: each is a
query, and only the query's own row is left out of its candidates. An empty table gives an empty result; fewer
candidates than k give fewer ranks. Components too large for exact products in double precision are multiplied as unbounded integers, without
the tree; scores beyond the range of a long are given as its ends.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadgauge.llm.shared import small_or_shuffled, stored

SHARD_ROWS = 20_000
#: Queries that descend together.
BLOCK_ROWS = 2_000
LEAF_ROWS = 64
#: Above any rounding of the bounds, which are whole numbers' square roots in double precision.
SLACK = 1e-6
NO_SCORE = -(1 << 63)
NO_ID = (1 << 63) - 1

HITS = "query_row long, query_id long, row long, vec_id long, score long"


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as doubles, or as unbounded integers where doubles would not do."""
    with np.errstate(over="ignore"):
        floors = np.floor(vectors.astype(np.float64) * float(scale))
    if not floors.size or np.abs(floors).max() < 1 << 53:
        return floors
    exact = np.empty(vectors.shape, dtype=object)
    for at, x in np.ndenumerate(vectors.astype(np.float64)):
        exact[at] = math.floor(floors[at]) if math.isfinite(floors[at]) else int(x) * scale
    return exact


@dataclass
class Node:
    members: np.ndarray
    centre: np.ndarray
    radius: float
    children: tuple[Node, Node] | None = None


class BallTree:
    """A ball tree over vectors of whole numbers."""

    def __init__(self, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.vectors, self.leaf_rows = vectors, leaf_rows
        self.root = self._node(np.arange(len(vectors)))

    def _node(self, members: np.ndarray) -> Node:
        part = self.vectors[members]
        centre = part.mean(axis=0)
        node = Node(members, centre, float(np.sqrt(((part - centre) ** 2).sum(axis=1).max())))
        if len(members) > self.leaf_rows and node.radius > 0:
            axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            order, half = np.argpartition(part[:, axis], len(members) // 2), len(members) // 2
            node.children = self._node(members[order[:half]]), self._node(members[order[half:]])
        return node


class Search:
    """A block of queries over one shard. `floors` are scores that hits must reach."""

    def __init__(self, shard: Shard, queries: np.ndarray, query_rows: np.ndarray, floors: np.ndarray, k: int):
        self.shard, self.queries, self.query_rows, self.k = shard, queries, query_rows, k
        self.lengths = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
        self.least = floors.copy()
        #: A member of the leaf that each query was in first.
        self.first = np.full(len(queries), -1)
        n = len(queries)
        self.scores = np.full((n, k), NO_SCORE, dtype=np.int64)
        self.ids, self.rows = np.full((n, k), NO_ID, dtype=np.int64), np.full((n, k), NO_ID, dtype=np.int64)

    def run(self) -> None:
        everyone = np.arange(len(self.queries))
        if self.shard.tree is None or self.queries.dtype == object or not self.shard.exact_with(self.queries):
            for member in range(len(self.shard.vectors)):  # unbounded integers, one vector at a time
                own = self.shard.vectors[member].astype(object)
                products = [int((q * own).sum()) for q in self.queries.astype(object)]
                scores = np.array([min(max(p, NO_SCORE + 1), NO_ID) for p in products], dtype=np.int64)
                self._take(everyone, np.array([member]), scores[:, None])
            return
        self._descend(self.shard.tree.root, everyone)
        self._visit(self.shard.tree.root, everyone)

    def _bounds(self, node: Node, which: np.ndarray) -> np.ndarray:
        bounds = self.queries[which] @ node.centre + self.lengths[which] * node.radius
        return bounds + SLACK * (1 + np.abs(bounds))

    def _leaf(self, node: Node, which: np.ndarray) -> None:
        scores = self.queries[which] @ self.shard.vectors[node.members].T
        self._take(which, node.members, scores.astype(np.int64))

    def _descend(self, node: Node, which: np.ndarray) -> None:
        """Take each query into the child of higher bound, down to its first leaf."""
        if not len(which):
            return
        if node.children is None:
            self.first[which] = node.members[0]
            self._leaf(node, which)
            return
        left = self._bounds(node.children[0], which) >= self._bounds(node.children[1], which)
        for child, own in zip(node.children, (left, ~left)):
            self._descend(child, which[own])

    def _visit(self, node: Node, which: np.ndarray) -> None:
        """Search the rest: children by falling bounds, for those queries that the bounds let in."""
        if node.children is None:
            which = which[self.first[which] != node.members[0]]
            if len(which):
                self._leaf(node, which)
            return
        bounds = [(self._bounds(child, which), child) for child in node.children]
        for bound, child in sorted(bounds, key=lambda x: -float(x[0].sum())):
            reached = which[bound >= self.least[which]]
            if len(reached):
                self._visit(child, reached)

    def _take(self, which: np.ndarray, members: np.ndarray, scores: np.ndarray) -> None:
        """Merge scores of members into the best of the queries."""
        ids, rows = self.shard.ids[members], self.shard.rows[members]
        scores = np.where((rows[None, :] == self.query_rows[which][:, None]) | (scores < self.least[which][:, None]), NO_SCORE, scores)
        some = (scores > NO_SCORE).any(axis=1)
        which, scores = which[some], scores[some]
        if not len(which):
            return
        many = np.concatenate([self.scores[which], scores], axis=1)
        shape = (len(which), len(members))
        all_ids = np.concatenate([self.ids[which], np.broadcast_to(ids, shape)], axis=1)
        all_rows = np.concatenate([self.rows[which], np.broadcast_to(rows, shape)], axis=1)
        order = np.lexsort((all_rows, all_ids, ~many), axis=1)[:, : self.k]  # ~x falls as x rises, without overflow
        self.scores[which] = np.take_along_axis(many, order, axis=1)
        self.ids[which] = np.take_along_axis(all_ids, order, axis=1)
        self.rows[which] = np.take_along_axis(all_rows, order, axis=1)
        self.least[which] = np.maximum(self.least[which], self.scores[which, -1])


class Shard:
    def __init__(self, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        self.vectors, self.ids, self.rows = vectors, ids, rows
        self.largest = float(np.abs(vectors).max()) if vectors.size else 0.0
        self.tree = BallTree(vectors) if vectors.dtype != object and self.exact_with(vectors) else None

    def exact_with(self, queries: np.ndarray) -> bool:
        """Whether all products with such queries, and their sums, are whole numbers that a double holds."""
        if queries.dtype == object or self.vectors.dtype == object:
            return False
        return max(1, queries.shape[1]) * self.largest * (float(np.abs(queries).max()) if queries.size else 0.0) < 1 << 53


def _searched(rows: DataFrame, k: int, scale: int, block_rows: int) -> DataFrame:
    """HITS of the rows (length, shard, asked, row, vec_id, order_id, kth, vector): vectors, and queries if `asked`."""

    def matrix(column: pa.Array, length: int) -> np.ndarray:
        values = column.flatten().to_numpy(zero_copy_only=False)
        return whole(values.reshape(len(column), length), scale)

    def hits(search: Search, query_rows: np.ndarray, query_ids: list) -> pa.RecordBatch:
        search.run()
        which, place = np.nonzero(search.scores > NO_SCORE)
        ids = pa.array(query_ids, pa.int64()).take(pa.array(which))
        columns = [search.rows[which, place], search.ids[which, place], search.scores[which, place]]
        return pa.RecordBatch.from_arrays(
            [pa.array(query_rows[which]), ids, *map(pa.array, columns)], ["query_row", "query_id", "row", "vec_id", "score"]
        )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, shard = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(keys)]):
                if start == end:
                    continue
                length, number, asked = keys[start].tolist()
                part = batch.slice(start, end - start)
                if (length, number) != key:
                    key, held, shard = (length, number), [], None
                if not asked:
                    held.append((matrix(part.column(7), length), part.column(5).to_numpy(), part.column(3).to_numpy()))
                    continue
                if shard is None:
                    if not held:
                        continue
                    shard, held = Shard(*(np.concatenate(own) for own in zip(*held))), []
                floors = part.column(6).fill_null(NO_SCORE).to_numpy()
                for at in range(0, end - start, block_rows):
                    block = slice(at, at + block_rows)
                    query_rows = part.column(3).to_numpy()[block]
                    found = Search(shard, matrix(part.column(7), length)[block], query_rows, floors[block], k)
                    yield hits(found, query_rows, part.column(4).to_pylist()[block])

    rows = rows.select("length", "shard", "asked", "row", "vec_id", "order_id", "kth", "vector")
    ordered = rows.repartition("length", "shard").sortWithinPartitions("length", "shard", "asked")
    return ordered.mapInArrow(search, HITS)


def whole_vectors(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(row, vec_id, order_id, length, vector) of the rows that take part; row is a number of the row, whatever its id."""
    source = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    kept = source.filter(F.col("vector").isNotNull()).filter(finite)
    order_id = F.coalesce("vec_id", F.lit(NO_ID)).alias("order_id")
    return stored(
        kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", order_id, F.size("vector").alias("length"), "vector"), "vectors"
    )


def top_k(
    vectors: DataFrame,
    k: int = 5,
    every: int = 50,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    scale: int = 256,
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """For each row whose id is divisible by `every`, its k best others: (query_id, rank, vec_id, score)."""
    rows = whole_vectors(vectors, id_column, vector_column)
    lengths = rows.groupBy(F.col("length").alias("of_length")).agg(F.ceil(F.count("*") / shard_rows).cast("long").alias("shards"))
    lengths = stored(lengths, "lengths")
    rows = rows.join(small_or_shuffled(lengths, lengths.count()), F.col("length") == F.col("of_length")).drop("of_length")
    none = F.lit(None).cast("long").alias("kth")
    shard = F.pmod(F.xxhash64("row"), F.col("shards"))
    rows = rows.select("row", "vec_id", "order_id", "length", "vector", "shards", shard.alias("shard"), F.lit(0).alias("asked"), none)
    queries = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).withColumn("asked", F.lit(1))
    home = stored(_searched(rows.unionByName(queries), k, scale, block_rows), "home-hits")
    kth = home.groupBy("query_row").agg(F.min("score").alias("at_least"), F.count("*").alias("n")).filter(F.col("n") == k).drop("n")
    known = queries.filter("shards > 1").join(kth, F.col("row") == F.col("query_row"), "left").withColumn("kth", F.col("at_least"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1), lambda s: s != F.col("shard"))
    away = known.withColumn("shard", F.explode(others)).select(*rows.columns)
    hits = home.unionByName(_searched(rows.filter("shards > 1").unionByName(away), k, scale, block_rows))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    shown = F.when(F.col("vec_id") != NO_ID, F.col("vec_id"))
    return ranked.select("query_id", "rank", shown.alias("vec_id"), "score")
