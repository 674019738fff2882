"""Product codes of vectors: each part of a vector is replaced by the nearest entry of that part's codebook.

Components become whole numbers, floor(scale * x), and all that follows is exact. Vectors are cut into consecutive
parts. A part's codebook begins as that part of the vectors with the smallest ids; in each round every part is assigned to
its nearest entry by squared Euclidean distance, ties to the lower index, and each entry becomes the floor of the mean of
its parts; entries without parts stay. A last assignment gives the codes.

The nearest entry is found by a geometric near-neighbour access tree over the entries. A node has some entries as split
points, the others belong to their nearest split point, and for each split point and child the range of distances from
one to the entries of the other is kept. A query's distances to the split points are exact whole numbers; where such a
distance and the best distance so far cannot meet a child's range, the whole child is left out. Ranges, roots and
sums are rounded so that a child is left out only if all its entries are strictly farther than the best, so ties are
never lost, and those are decided by whole numbers and index. Many queries descend together, those that are nearest to a split point into
its child first.

Each assignment is one scan; a task returns the sums and counts of its own parts, one row for each entry, and these are added up
in one shuffle. The codebooks, of fixed size for a length of vectors, are all that meets the driver. Vectors of each length have codebooks of their
own, as many lengths at once as fit a bound. A length that the number of parts does not divide is cut into parts of the next whole width, the last ones shorter or empty.

Vectors that are null or hold null or non-finite components are dropped. Vectors of equal ids are ordered by their
components; null ids come last. Fewer vectors than entries give fewer entries. Components beyond 2^28 are
compared by unbounded integers, without the tree. Errors beyond the greatest long are given as that. Null labels are one label. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadgauge.llm.shared import small_or_shuffled, stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Split points of a node, and most entries of a leaf.
ARITY, LEAF = 8, 12
#: More than the relative error of a root and a sum of two.
SLACK = 1e-12
#: Queries that descend together.
TOGETHER = 4096
#: Components of the codebooks that are learned at once, but for a single longer length.
BLOCK_COMPONENTS = 1 << 21
MOST = (1 << 63) - 1
#: Largest component whose squared distances are kept in 64 bits here; a part may have 2^4 of them, or more of smaller ones.
LARGEST = 1 << 28

SUMS = "length int, part int, entry int, n long, sums array<string>"


def whole(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as 64-bit integers, or as unbounded ones where some would not fit."""
    with np.errstate(over="ignore"):
        floors = np.floor(vectors * float(scale))
    if not floors.size or np.abs(floors).max() <= LARGEST:
        return floors.astype(np.int64)
    exact = np.empty(vectors.shape, dtype=object)
    for at, x in np.ndenumerate(vectors):
        exact[at] = math.floor(floors[at]) if math.isfinite(floors[at]) else int(x) * scale
    return exact


def cuts(length: int, parts: int) -> list[slice]:
    width = -(-length // parts)
    return [slice(min(length, k * width), min(length, (k + 1) * width)) for k in range(parts)]


def fits_long(*arrays: np.ndarray) -> bool:
    """Whether squared distances between rows of the arrays, and so all sums on the way, fit 64 bits."""
    largest = max((int(abs(a).max()) for a in arrays if a.size), default=0)
    width = max((a.shape[1] for a in arrays), default=0)
    return all(a.dtype != object for a in arrays) and width * (2 * largest) ** 2 < MOST


def squared_distances(queries: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all queries to all entries."""
    width = entries.shape[1]
    largest = max((int(np.abs(a).max()) for a in (queries, entries) if a.size), default=0)
    if 4 * width * largest**2 < 1 << 53:  # every sum is a whole number that a double holds
        a, b = queries.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    return np.stack([((queries - entry) ** 2).sum(axis=1) for entry in entries], axis=1)


@dataclass
class Node:
    #: Indexes of the split points, or of a leaf's entries.
    points: np.ndarray
    children: list[Node | None] = field(default_factory=list)
    #: Least and greatest distance of each split point (row) to the entries of each child (column), rounded outwards.
    low: np.ndarray | None = None
    high: np.ndarray | None = None


class AccessTree:
    def __init__(self, entries: np.ndarray, arity: int = ARITY, leaf: int = LEAF):
        self.entries, self.arity, self.leaf = entries, arity, leaf
        self.root = self._node(np.arange(len(entries)))

    def _node(self, members: np.ndarray) -> Node:
        if len(members) <= self.leaf:
            return Node(members)
        points = self.entries[members]
        chosen, distances = [0], [squared_distances(points, points[:1])[:, 0]]
        while len(chosen) < self.arity:  # the entry farthest from all split points is the next one
            nearest = np.min(distances, axis=0)
            if not nearest.any():
                break
            chosen.append(int(np.argmax(nearest)))
            distances.append(squared_distances(points, points[chosen[-1] : chosen[-1] + 1])[:, 0])
        if len(chosen) == 1:  # all are equal
            return Node(members)
        to_split = np.stack(distances)
        owner = np.argmin(to_split, axis=0)
        owner[chosen] = -1
        roots = np.sqrt(to_split.astype(np.float64))
        low, high = np.zeros((len(chosen),) * 2), np.zeros((len(chosen),) * 2)
        children: list[Node | None] = []
        for j in range(len(chosen)):
            own = owner == j
            children.append(self._node(members[own]) if own.any() else None)
            if own.any():
                low[:, j] = roots[:, own].min(axis=1) * (1 - SLACK)
                high[:, j] = roots[:, own].max(axis=1) * (1 + SLACK)
        return Node(members[chosen], children, low, high)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each query's nearest entry, ties to the lower index."""
        at, best = np.full(len(queries), len(self.entries)), np.full(len(queries), MOST)
        for start in range(0, len(queries), TOGETHER):
            which = np.arange(start, min(start + TOGETHER, len(queries)))
            self._visit(self.root, queries, which, at, best)
        return at, best

    def _visit(self, node: Node, queries: np.ndarray, which: np.ndarray, at: np.ndarray, best: np.ndarray) -> None:
        if not len(which):
            return
        distances = squared_distances(queries[which], self.entries[node.points])
        self._improve(node.points, distances, which, at, best)
        if not node.children:
            return
        roots = np.sqrt(distances.astype(np.float64))
        nearest = np.argmin(distances, axis=1)
        for first in (True, False):
            for j, child in enumerate(node.children):
                if child is None:
                    continue
                turn = np.flatnonzero((nearest == j) == first)
                own, radius = roots[turn], np.sqrt(best[which[turn]].astype(np.float64))[:, None] * (1 + SLACK)
                beyond = own * (1 - SLACK) - radius > node.high[:, j] + SLACK * (own + radius)
                before = own * (1 + SLACK) + radius < node.low[:, j] - SLACK * (own + radius)
                reached = ~(beyond | before).any(axis=1)
                self._visit(child, queries, which[turn[reached]], at, best)

    def _improve(self, points: np.ndarray, distances: np.ndarray, which: np.ndarray, at: np.ndarray, best: np.ndarray) -> None:
        order = np.argsort(points)
        found = np.argmin(distances[:, order], axis=1)
        index, distance = points[order][found], distances[np.arange(len(which)), order[found]]
        better = (distance < best[which]) | ((distance == best[which]) & (index < at[which]))
        at[which[better]], best[which[better]] = index[better], distance[better]


class Coder:
    """The nearest entries of one part's codebook."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.tree = AccessTree(entries) if fits_long(entries) else None

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.tree is not None and fits_long(queries, self.entries):
            return self.tree.nearest(queries)
        at, best = [], []
        entries = self.entries.astype(object)
        for query in queries.astype(object):
            distance, index = min((int(sum((query - entry) ** 2)), i) for i, entry in enumerate(entries))
            at.append(index)
            best.append(distance)
        return np.array(at, dtype=np.int64), np.array(best, dtype=object)


Codebooks = dict[int, list[np.ndarray]]


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) for each length in a column of lists of doubles without nulls."""
    offsets = column.offsets.to_numpy()
    values, lengths = column.values.to_numpy(zero_copy_only=False), np.diff(offsets)
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        yield rows, values[offsets[rows][:, None] + np.arange(length)]


def codebooks_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position, as decimal numbers with commas."""
    numbers = (str(int(x)) for book in books for x in book.ravel())
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def _assigned(rows: DataFrame, books: Codebooks, scale: int) -> DataFrame:
    """SUMS of each task: how many parts each entry has and what they sum to."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = {length: [Coder(book) for book in own] for length, own in shared.value.items()}
        sums = {length: [np.zeros(book.shape, dtype=object) for book in own] for length, own in shared.value.items()}
        counts = {length: [np.zeros(len(book), dtype=np.int64) for book in own] for length, own in shared.value.items()}
        for batch in batches:
            for _, vectors in _by_length(batch.column(0)):
                length = vectors.shape[1]
                numbers = whole(vectors, scale)
                for k, cut in enumerate(cuts(length, len(coders[length]))):
                    at, _ = coders[length][k].nearest(numbers[:, cut])
                    own = np.zeros(sums[length][k].shape, dtype=numbers.dtype)  # a batch's sums fit 64 bits
                    np.add.at(own, at, numbers[:, cut])
                    sums[length][k] += own
                    counts[length][k] += np.bincount(at, minlength=len(counts[length][k]))
        found = [
            (length, k, entry, int(n), [str(int(x)) for x in sums[length][k][entry]])
            for length, own in counts.items() for k, many in enumerate(own) for entry, n in enumerate(many) if n
        ]
        if found:
            yield _sums_batch(found)

    return rows.select("vector").mapInArrow(assign, SUMS)


def _sums_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())]
    columns = [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(columns, ["length", "part", "entry", "n", "sums"])


def _means(sums: DataFrame) -> DataFrame:
    """SUMS with the floor of each entry's mean as its sums, from sorted partitions."""

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, count, total = None, 0, []

        def row() -> pa.RecordBatch:
            return _sums_batch([(*current, count, [str(x // count) for x in total])])

        for batch in batches:
            for length, part, entry, n, numbers in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (length, part, entry) != current:
                    if current is not None:
                        yield row()
                    current, count, total = (length, part, entry), 0, [0] * len(numbers)
                count, total = count + n, [x + int(y) for x, y in zip(total, numbers)]
        if current is not None:
            yield row()

    keys = ("length", "part", "entry")
    return sums.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(mean, SUMS)


def _learned(rows: DataFrame, lengths: list[int], parts: int, entries: int, rounds: int, scale: int) -> Codebooks:
    books: Codebooks = {}
    for length in lengths:
        first = rows.filter(F.size("vector") == length).orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries)
        numbers = whole(np.array([r["vector"] for r in first.select("vector").collect()], dtype=np.float64), scale)
        books[length] = [numbers[:, cut] for cut in cuts(length, parts)]
    for _ in range(rounds):
        for r in _means(_assigned(rows, books, scale)).collect():  # a row for each entry
            book = books[r["length"]][r["part"]]
            entry = [int(x) for x in r["sums"]]
            if book.dtype != object and any(abs(x) > LARGEST for x in entry):
                book = books[r["length"]][r["part"]] = book.astype(object)
            book[r["entry"]] = entry
    return books


def _coded(rows: DataFrame, books: Codebooks, scale: int) -> DataFrame:
    """(vec_id, label, code, error, codebooks_sha256) of the vectors."""
    shared = rows.sparkSession.sparkContext.broadcast((books, {n: codebooks_digest(own) for n, own in books.items()}))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, digests = shared.value
        coders = {length: [Coder(book) for book in own] for length, own in books.items()}
        for batch in batches:
            for where, vectors in _by_length(batch.column(2)):
                length = vectors.shape[1]
                numbers = whole(vectors, scale)
                errors, codes = np.zeros(len(where), dtype=object), np.full(len(where), "", dtype=object)
                for k, cut in enumerate(cuts(length, len(coders[length]))):
                    at, best = coders[length][k].nearest(numbers[:, cut])
                    digits = np.array([f"{i:02x}" for i in range(len(books[length][k]))], dtype=object)
                    errors, codes = errors + best.astype(object), codes + digits[at]
                most = pa.array([min(e, MOST) for e in errors.tolist()], pa.int64())
                ids = [batch.column(i).take(pa.array(where)) for i in (0, 1)]
                columns = [*ids, pa.array(codes.tolist(), pa.string()), most, pa.array([digests[length]] * len(where))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error", "codebooks_sha256"])

    schema = f"vec_id {kinds[0]}, label {kinds[1]}, code string, error long, codebooks_sha256 string"
    return rows.select("vec_id", "label", "vector").mapInArrow(code, schema)


def _blocks(lengths: list[int], entries: int) -> Iterator[list[int]]:
    """Lengths whose codebooks are learned together."""
    block: list[int] = []
    for length in lengths:
        if block and (sum(block) + length) * entries > BLOCK_COMPONENTS:
            yield block
            block = []
        block.append(length)
    if block:
        yield block


def _none(spark: SparkSession, rows: DataFrame) -> DataFrame:
    kinds = [rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    return spark.createDataFrame([], f"vec_id {kinds[0]}, label {kinds[1]}, code string, error long, codebooks_sha256 string")


def vector_codes(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector that is kept.

    code: the parts' entries, two hex digits each (so at most 256 entries); error: the squared distances of the parts to
    their entries, summed; label_error: error summed over equal labels.
    """
    raw = vectors.select(
        F.col(id_column).alias("vec_id"), F.col(label_column).alias("label"), F.col(vector_column).cast("array<double>").alias("vector")
    )
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    rows = raw.filter(F.col("vector").isNotNull()).filter(finite)
    lengths = sorted(r[0] for r in rows.groupBy(F.size("vector")).count().collect())  # one, if all have equal lengths
    coded = None
    for block in _blocks(lengths, entries):
        own = rows.filter(F.size("vector").isin(block))
        part = _coded(own, _learned(own, block, parts, entries, rounds, scale), scale)
        coded = part if coded is None else coded.unionByName(part)
    coded = stored(coded if coded is not None else _none(vectors.sparkSession, rows), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    errors = stored(coded.groupBy(F.col("label").alias("of_label")).agg(total.alias("label_error")), "label-errors")
    same = F.col("label").eqNullSafe(F.col("of_label"))
    summed = coded.join(small_or_shuffled(errors, errors.count()), same)
    return summed.select("vec_id", "code", "error", "label_error", "codebooks_sha256", "label")
