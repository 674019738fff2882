"""N-gram Jaccard self-join by universe partition and pigeonhole, with components of the links.

A text's set holds its distinct word shingles. Two sets link when their Jaccard similarity reaches the threshold, that
is, when they differ in at most (1 - t) / (1 + t) times the sum of their sizes. Sizes fall into bands. In each band
shingles are dealt to segments by the range of their hash, so that sets within that difference must agree, but for few
shingles, on some segment:

* a set's part in a segment is indexed by one signature;
* in segments that the band's cost-based allocation chose, the part's one-deletion neighbourhood is indexed as well,
  and a difference there counts for two;
* empty parts are left out. A set whose other parts no longer outnumber the difference (rare) indexes all its
  shingles in an index of such sets: of two linked sets, either one's parts suffice or both are in that index.

A set is indexed in its own band and, as the larger partner, in those below that a partner's size can fall in. Sets that
share a signature are candidates. Inside a bucket every set is paired with one hub, on whole texts, not with every other one.
Many sets share a signature by a common line or phrase and are far from each other. A sketch of each set tells so before texts are moved:
how many shingles it has in each of equal ranges of their hash. Two sets differ in at least as many shingles as these numbers do, so
a set whose sketch is too far from those of the hub and of all its other partners links with none of them and is left out.
What two sets of a hub have in common follows exactly from what each lacks of the hub and adds to it, so a task that holds all of a
hub's sets finds their links among each other by the differences that several of them share. Where a hub has too many sets for one
task, its buckets get the hub with most links, and sets in different components that share enough differences
from it are verified with each other. So no link is missed.

Signatures are sorted by signature and node over all tasks, one range of them after the other, so that the files of one range's shuffle
are gone before the next one's. A signature that a third of the sets have is so cut into
many tasks' shares; the few signatures at the edges of shares are put together by a table of them.

Equal sets are one node, so groups of copies cost one node each. Nodes are 64-bit hashes of the whole sets. Null and
empty texts have empty sets and link with nothing. Rows with equal ids and different texts are nodes of their own; a
component takes the smallest non-null id of its rows, a null id links as any other. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadgauge.llm.components import components
from leadgauge.llm.hashing import mixed, mixed_int, shingle_hashes, word_hashes
from leadgauge.llm.hub_join import at_hubs, holders_of, texts_of_nodes
from leadgauge.llm.shared import WIDE_CHUNK_BYTES, discard, row_of, small_or_shuffled, stored, text_chunks, text_or_empty

BAND_GROWTH = 1.5
#: Sets a task remembers, so as not to index equal ones again.
REMEMBERED = 200_000
#: Ranges of signatures that are sorted one after the other, as bits.
RANGE_BITS = 2
#: Partners and differences of one hub that a task holds at once; hubs with more are split.
HELD_PARTNERS, HELD_DIFFERENCES = 16_384, 1_000_000
#: Ranges of a sketch at most, as bits, and bytes of sketches that are compared among the sets of one hub; all pairs of hubs with more are kept.
SKETCH_BITS, COMPARED_BYTES = 12, 1 << 32


class Bands:
    """Size bands and the segments of each, for a threshold in hundredths."""

    def __init__(self, percent: int):
        self.percent = percent

    def most_difference(self, small: int, large: int) -> int:
        return (100 - self.percent) * (small + large) // (100 + self.percent)

    @staticmethod
    @lru_cache(maxsize=None)
    def limits(band: int) -> tuple[int, int]:
        """Least and largest size of a band."""
        low = 1 if band == 0 else Bands.limits(band - 1)[1] + 1
        return low, max(low, math.floor(low * BAND_GROWTH) - 1)

    def of(self, size: int) -> int:
        band = 0
        while self.limits(band)[1] < size:
            band += 1
        return band

    def probed(self, size: int) -> range:
        """Bands in which a set of this size is indexed: its own and those of its smaller partners."""
        least = -(-size * self.percent // 100)
        return range(self.of(max(1, least)), self.of(size) + 1)

    def difference(self, band: int) -> int:
        """The most that two linked sets differ in if the smaller one is in the band."""
        high = self.limits(band)[1]
        return self.most_difference(high, high * 100 // self.percent)

    def allocation(self, band: int) -> tuple[int, int]:
        """Segments and how many of them have deletion neighbourhoods: the fewest signatures that leave hardly any
        set with too few parts."""
        return _allocation(self.limits(band)[0], self.difference(band))


@lru_cache(maxsize=None)
def _allocation(size: int, difference: int) -> tuple[int, int]:
    best = None
    for segments in range(max(1, (difference + 1) // 2), 2 * difference + 4):
        empty = segments * math.exp(size * math.log1p(-1 / segments)) if segments > 1 else 0
        single = size * math.exp((size - 1) * math.log1p(-1 / segments)) if segments > 1 else float(size == 1)
        share = 1 - (empty + single) / segments
        spare = empty + 3 * math.sqrt(empty) if segments > 1 else 0
        missing = difference + 1 - (segments - spare)
        chosen = max(0, math.ceil(missing / max(share, 1e-9)))
        if chosen <= segments:
            cost = segments + chosen * (1 + size / segments)
            if best is None or cost < best[0]:
                best = cost, segments, chosen
    return (best[1], best[2]) if best else (2 * difference + 4, 2 * difference + 4)


@lru_cache(maxsize=64)
def _segment_salts(band: int, segments: int) -> np.ndarray:
    return mixed(np.arange(segments, dtype=np.uint64) + (np.uint64(band) << np.uint64(40)))


def node_of(shingles: np.ndarray) -> int:
    """The 64-bit hash of a set, whatever its order."""
    total = mixed(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(mixed(np.array([total + np.uint64(len(shingles))]))[0].view(np.int64))


def sketch_of(shingles: np.ndarray) -> bytes:
    """How many shingles of a set are in each of equal ranges of their hash, a quarter to half as many ranges as shingles; empty,
    which is near to all, if a number needs more than a byte."""
    bits = min(SKETCH_BITS, max(0, (len(shingles) - 1).bit_length() - 2))
    ranges = (shingles >> np.uint64(32)) >> np.uint64(32 - bits)
    counts = np.bincount(ranges.astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def near_another(sketches: list[bytes], percent: int) -> np.ndarray:
    """Which of the sets are near enough to another one of them, by their sketches, to link with it.

    Sizes of linked sets are so close that one has at most twice the other's ranges; neighbouring ranges are then added up.
    """
    m = len(sketches)
    lengths = np.array([len(x) for x in sketches])
    if not lengths.all() or m * int(lengths.sum()) > COMPARED_BYTES:
        return np.ones(m, dtype=bool)
    near = np.zeros(m, dtype=bool)
    counts = [np.frombuffer(x, dtype=np.uint8) for x in sketches]
    whole = np.array([x.sum(dtype=np.int64) for x in counts])
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero((lengths == length) | (lengths == 2 * length))
        at = at[np.argsort(whole[at], kind="stable")]
        rows = np.stack([counts[x] if lengths[x] == length else counts[x].reshape(-1, 2).sum(axis=1) for x in at]).astype(np.int16)
        sizes, own = whole[at], lengths[at] == length
        ends = np.searchsorted(sizes, sizes * 100 // percent, side="right")
        # The hub comes first, for many are near to it: sets found near are only compared with others that are not yet.
        for x in [*np.flatnonzero(at == 0), *range(len(at))]:
            if near[at].all():
                break
            first = int(np.searchsorted(ends, x, side="right")) if at[x] == 0 else x + 1
            compared = (own[first : ends[x]] | own[x]) & (np.arange(first, ends[x]) != x)
            if near[at[x]]:
                compared &= ~near[at[first : ends[x]]]
            others = slice(first, ends[x]) if compared.all() else first + np.flatnonzero(compared)
            apart = np.abs(rows[others] - rows[x]).sum(axis=1, dtype=np.int32)
            found = apart <= (100 - percent) * (sizes[others] + sizes[x]) // (100 + percent)
            near[at[others][found]] = True
            near[at[x]] |= found.any()
    return near


def signatures(shingles: np.ndarray, bands: Bands) -> np.ndarray:
    """All signatures of one set, given as its sorted shingle hashes."""
    found = []
    tokens = mixed(shingles + np.uint64(0x632BE59BD9B4E019))
    for band in bands.probed(len(shingles)):
        segments, chosen = bands.allocation(band)
        salts = _segment_salts(band, segments)
        segment = ((shingles >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
        filled = segment[starts].astype(np.int64)
        sums = np.add.reduceat(tokens, starts)
        found.append(mixed(sums ^ salts[filled]))
        counts = np.diff(np.append(starts, len(shingles)))
        with_deletions = (filled < chosen) & (counts > 1)
        if with_deletions.any():
            member = np.repeat(with_deletions, counts)
            part = np.repeat(np.arange(len(starts)), counts)[member]
            found.append(mixed((sums[part] - tokens[member]) ^ salts[filled[part]]))
        if len(filled) + int(with_deletions.sum()) <= bands.difference(band):
            found.append(mixed(tokens ^ mixed_int(~band)))
    return np.unique(np.concatenate(found))


def _sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, data, offsets in text_chunks(texts, WIDE_CHUNK_BYTES):
        hashes, first, _, _ = word_hashes(data, offsets)
        for start, end in zip(first[:-1], first[1:]):
            yield np.unique(shingle_hashes(hashes[start:end], words))


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, key, n_shingles, node, sketch) of every row; key is a hash of id and text, node and sketch are null for an empty set."""

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, sketches = [], [], []
            for shingles in _sets(batch.column(2), words):
                sizes.append(len(shingles))
                nodes.append(node_of(shingles) if len(shingles) else None)
                sketches.append(sketch_of(shingles) if len(shingles) else None)
            made = pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sketches, pa.binary())
            columns = [batch.column(0), batch.column(1), *made]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "n_shingles", "node", "sketch"])

    return docs.mapInArrow(described, f"doc_id {_type(docs, 'doc_id')}, key long, n_shingles long, node long, sketch binary")


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _indexed(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(signature, node) of every set that a task has not indexed lately."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(percent), set()
        for batch in batches:
            signs, nodes, held = [], [], 0
            for shingles in _sets(batch.column(0), words):
                if not len(shingles) or (node := node_of(shingles)) in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(node)
                own = signatures(shingles, bands)
                signs.append(own.view(np.int64))
                nodes.append(np.full(len(own), node, dtype=np.int64))
                held += len(own)
                if held >= 1 << 18:
                    yield _batch(signs, nodes)
                    signs, nodes, held = [], [], 0
            if signs:
                yield _batch(signs, nodes)

    def _batch(signs: list[np.ndarray], nodes: list[np.ndarray]) -> pa.RecordBatch:
        arrays = [pa.array(np.concatenate(signs)), pa.array(np.concatenate(nodes))]
        return pa.RecordBatch.from_arrays(arrays, ["signature", "node"])

    return docs.select("text").mapInArrow(index, "signature long, node long")


def _buckets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(signature, node, hub) of the signatures that several sets have; hub is the least of their nodes."""
    indexed = stored(_indexed(docs, words, percent), "signatures")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signature, node = (batch.column(i).to_numpy() for i in (0, 1))
            if not len(signature):
                continue
            new = np.append(True, (signature[1:] != signature[:-1]) | (node[1:] != node[:-1]))
            signature, node = signature[new], node[new]
            starts = np.flatnonzero(np.append(True, signature[1:] != signature[:-1]))
            sizes = np.diff(np.append(starts, len(signature)))
            edge = np.zeros(len(starts), dtype=bool)
            edge[[0, -1]] = True  # others may have more of these signatures
            kept = np.repeat((sizes > 1) | edge, sizes)
            columns = signature[kept], node[kept], np.repeat(node[starts], sizes)[kept], np.repeat(edge, sizes)[kept]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["signature", "node", "hub", "edge"])

    met = None
    for n in range(1 << RANGE_BITS):
        own = indexed.filter(F.shiftrightunsigned("signature", 64 - RANGE_BITS) == n)
        ordered = own.repartitionByRange("signature", "node").sortWithinPartitions("signature", "node")
        found = stored(ordered.mapInArrow(meet, "signature long, node long, hub long, edge boolean"), "buckets")
        met = found if met is None else met.unionByName(found)
    discard(indexed)
    edges = met.filter("edge").groupBy("signature").agg(F.min("node").alias("hub"), F.max("node").alias("last"))
    edges = stored(edges.filter("hub <> last").drop("last"), "edge-buckets")
    cut = met.filter("edge").drop("hub", "edge").join(small_or_shuffled(edges, edges.count()), "signature")
    return met.filter("not edge").drop("edge").unionByName(cut)


def links_of_partners(size: int, partners: list[tuple[int, bool, np.ndarray, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Links (a, b) among the sets of a hub that join what is not joined by links with the hub. A partner is (node, linked
    with the hub, what it adds to the hub's set, what it lacks of it); size is that of the hub's set.

    Sets x and y have size - lacks_x - lacks_y + s in common, where s is how many differences they share. If x does not link with
    the hub, s is at least lacks_x + t adds_x - (1 - t) size for the threshold t, for s is at most what y has; sets with fewer
    differences that any other has are left out.
    """
    p, m = percent, len(partners)
    if m < 2 or all(linked for _, linked, _, _ in partners):
        return []
    linked = np.array([x[1] for x in partners])
    adds, lacks = (np.array([len(x[i]) for x in partners]) for i in (2, 3))
    values = np.concatenate([mixed(v) for _, _, added, lacking in partners for v in (added, ~lacking)])
    owner = np.repeat(np.repeat(np.arange(m), 2), np.stack([adds, lacks], axis=1).ravel())
    order = np.argsort(values, kind="stable")
    starts = np.flatnonzero(np.append(True, values[order][1:] != values[order][:-1])) if len(values) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(values)))
    shared = np.repeat(sizes > 1, sizes)
    owner, starts, sizes = owner[order][shared], np.cumsum(sizes[sizes > 1]) - sizes[sizes > 1], sizes[sizes > 1]
    least = np.maximum(1, -(-(100 * lacks + p * adds - (100 - p) * size) // 100))
    able = ~linked & (np.bincount(owner, minlength=m) >= least)
    number = np.repeat(np.arange(len(starts)), sizes)
    by_owner = np.argsort(owner, kind="stable")
    of_owner = np.searchsorted(owner[by_owner], np.arange(m + 1))
    whole = size - lacks + adds
    root = np.where(linked, m, np.arange(m)).tolist() + [m]

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    for x in np.flatnonzero(able).tolist():
        own = number[by_owner[of_owner[x] : of_owner[x + 1]]]
        many = sizes[own]
        places = np.repeat(starts[own] - np.cumsum(many) + many, many) + np.arange(many.sum())
        common = size - lacks[x] - lacks + np.bincount(owner[places], minlength=m)
        for y in np.flatnonzero(100 * common >= p * (whole[x] + whole - common)).tolist():
            if y != x and find(x) != find(y):
                root[find(x)] = find(y)
                links.append((partners[x][0], partners[y][0]))
    return links


def _near(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The candidate pairs (a, b) but for those whose a is, by the sketches (node, sketch), too far from the hub b and from all its other
    partners. A hub with too many partners for one task keeps its pairs."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, whole, nodes, held = None, True, [], []

        def finished() -> list[tuple[int, int]]:
            return [(a, hub) for a, kept in zip(nodes, near_another(held, percent)[1:]) if kept] if nodes else []

        for batch in batches:
            rows: list[tuple[int, int]] = []
            for b, a, sketch, alone in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if a is None:
                    rows += finished()
                    hub, whole, nodes, held = b, alone, [], [sketch]
                elif whole:
                    nodes.append(a)
                    held.append(sketch)
                else:
                    rows.append((a, b))
            if rows:
                yield _rows(rows)
        if rows := finished():
            yield _rows(rows)

    def _rows(rows: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["a", "b"])

    texts = sketches.select("node", F.col("sketch").alias("text"))
    return at_hubs(pairs, texts, share=HELD_PARTNERS, alone=True, short=True).mapInArrow(near, "a long, b long")


VERIFIED = "a long, b long, linked boolean, size int, lacks int, adds int, differences array<int>"


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int, with_differences: bool = False) -> DataFrame:
    """The candidate pairs (a, b) on whole texts: do they link; the hub's size, how many of its shingles a lacks, how
    many others it adds. Further rows are links of two partners of a hub. A hub whose partners were not held together has a row without a;
    if asked for, its pairs have 32-bit hashes of what a adds and lacks. Where these collide, more pairs are
    verified, never fewer."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_id, whole, held = np.zeros(0, dtype=np.uint64), None, True, 0
        partners: list[tuple[int, bool, np.ndarray, np.ndarray]] = []

        def told(a: int, linked: bool, added: np.ndarray, lacking: np.ndarray, differences: bool) -> tuple:
            hashes = np.concatenate([mixed(added), mixed(~lacking)]) if differences else np.zeros(0, dtype=np.uint64)
            listed = (hashes >> np.uint64(32)).astype(np.uint32).view(np.int32)
            return a, hub_id, linked, len(hub), len(lacking), len(added), listed

        def finished() -> list[tuple]:
            links = links_of_partners(len(hub), partners, percent)
            return [(x, y, True, None, None, None, None) for x, y in links]

        for batch in batches:
            rows: list[tuple] = []
            ids = zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)))
            for (b, a, alone), shingles in zip(ids, _sets(batch.column(2), words)):
                if a is None:
                    rows += finished()
                    hub, hub_id, whole, held, partners = shingles, b, alone, 0, []
                    if not whole:
                        rows.append((None, b, False, None, None, None, None))
                    continue
                at = np.minimum(np.searchsorted(hub, shingles), len(hub) - 1)
                both = hub[at] == shingles
                kept = np.ones(len(hub), dtype=bool)
                kept[at[both]] = False
                added, lacking, common = shingles[~both], hub[kept], int(both.sum())
                linked = 100 * common >= percent * (len(hub) + len(shingles) - common)
                rows.append(told(a, linked, added, lacking, with_differences and not whole))
                if whole:
                    partners.append((a, linked, added, lacking))
                    held += len(added) + len(lacking)
                    if held > HELD_DIFFERENCES:
                        whole = False
                        rows.append((None, b, False, None, None, None, None))
                        if with_differences:
                            rows += [told(*partner, True) for partner in partners]
                        partners = []
            if rows:
                yield _rows(rows)
        if rows := finished():
            yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32())]
        names = ["a", "b", "linked", "size", "lacks", "adds", "differences"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return at_hubs(pairs, texts, share=HELD_PARTNERS, alone=True).mapInArrow(verify, VERIFIED)


def _sharing_differences(tested: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that can link, though not both link with a hub they have in common.

    Let a set lack some of the hub's shingles and add others. Two sets that differ from the hub in disjoint ways are no
    more similar than either is to it. With t the threshold, sets x and y link only if they share at least
    (t (size + adds_x + adds_y) - (size - lacks_x - lacks_y)) / (1 + t) of their differences. If x does not link with the hub,
    that is at least lacks_x + t adds_x - (1 - t) size, for what they share is at most what y has; and
    more than (lacks_y + t adds_y) / (1 + t). With the differences of a hub that several components have in one order, rare ones first, each set leaves out
    its last ones, one fewer than it must share: two sets that can link still share one. What is
    behind it in both orders tells how many more they can share at most.
    """
    p = percent
    held = tested.select("b", "a", F.explode("differences").alias("d")).distinct()
    held = held.join(roots.withColumnRenamed("node", "a"), "a", "left").withColumn("root", F.coalesce("root", "a"))
    held = stored(held, "differences")
    several = held.groupBy("b", "d").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"))
    several = stored(several.filter("low <> high").select("b", "d", "n"), "shared-differences")
    held = held.join(small_or_shuffled(several, several.count()), ["b", "d"])
    last = F.row_number().over(Window.partitionBy("b", "a").orderBy(F.desc("n"), F.desc("d")))
    held = held.withColumn("behind", last - 1).drop("n")
    unlinked = F.ceil((100 * F.col("lacks") + p * F.col("adds") - (100 - p) * F.col("size")) / 100)
    with_linked = F.floor((100 * F.col("lacks") + p * F.col("adds")) / (100 + p)) + 1
    least = F.greatest(F.lit(1), F.when(F.col("linked"), with_linked).otherwise(unlinked))
    sets = tested.select("b", "a", "linked", "size", "lacks", "adds", least.alias("least"))
    # A set leaves out its last ones, one fewer than it must share.
    ranked = held.join(sets, ["b", "a"]).filter(F.col("behind") >= F.col("least") - 1).drop("least")
    ranked = stored(ranked, "ranked-differences")
    x, y = ranked.filter("not linked").alias("x"), ranked.alias("y")
    met = (F.col("x.b") == F.col("y.b")) & (F.col("x.d") == F.col("y.d")) & (F.col("x.root") != F.col("y.root"))
    share = p * (F.col("x.size") + F.col("x.adds") + F.col("y.adds")).cast("long") - 100 * (
        F.col("x.size") - F.col("x.lacks") - F.col("y.lacks")
    )
    most = 1 + F.least("x.behind", "y.behind")
    pairs = x.join(y, met & (share <= (100 + p) * most))
    return pairs.select(F.greatest("x.a", "y.a").alias("a"), F.least("x.a", "y.a").alias("b")).distinct()


def linked_nodes(
    buckets: DataFrame, sketches: DataFrame, texts_of: Callable[[DataFrame], DataFrame], words: int, percent: int
) -> DataFrame:
    """(node, root) of all nodes that have links. `buckets` has (signature, node, hub), hub the least of its nodes.

    Each bucket's sets, but for those that their sketches tell to be far from the others, are verified against its hub, and with each other as
    far as a task holds the hub's sets. Buckets of
    other hubs that hold several components then take as hub the set with the most links so far. Two sets of such a bucket that link, but are
    still in different components, share differences from that hub; those that can link by what they share are verified
    with each other.
    """
    pairs = buckets.filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    candidates = stored(pairs, "candidates")
    pairs = stored(_near(candidates, sketches, percent), "pairs")
    discard(candidates)
    tested = stored(_verified(pairs, texts_of(pairs), words, percent), "verified")
    links = tested.filter("linked").select("a", "b")
    roots = stored(components(links), "roots")
    split = stored(tested.filter("a is null").select(F.col("b").alias("hub")).distinct(), "split-hubs")
    n = split.count()
    if not n:
        discard(pairs)
        return roots
    left = stored(buckets.join(small_or_shuffled(split, n), "hub", "left_semi").select("signature", "node"), "split-buckets")
    degrees = links.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("links"))
    rows = left.join(roots.join(degrees, "node", "left"), "node", "left")
    rows = rows.withColumns({"root": F.coalesce("root", "node"), "links": F.coalesce("links", F.lit(0))})
    best = rows.groupBy("signature").agg(
        F.max(F.struct("links", "node")).alias("best"), F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")
    )
    best = stored(best.filter("low <> high and n > 2").select("signature", F.col("best.node").alias("hub")), "best-hubs")
    again = left.join(small_or_shuffled(best, best.count()), "signature").filter("node <> hub")
    again = stored(again.select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), "pairs")
    if again.isEmpty():
        return roots
    closer = stored(_verified(again, texts_of(again), words, percent, True), "verified")
    links = links.unionByName(closer.filter("linked").select("a", "b"))
    roots = stored(components(links), "roots")
    more = _sharing_differences(closer.filter("size(differences) > 0"), roots, percent)
    more = stored(more.join(pairs, ["a", "b"], "left_anti"), "pairs")
    if more.isEmpty():
        return roots
    found = _verified(more, texts_of(more), words, percent).filter("linked").select("a", "b")
    return components(links.unionByName(stored(found, "verified")))


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id") -> DataFrame:
    """(id, key, n_shingles, root, component_id) of every row: links at percent / 100 or more, components by smallest id.

    `key` is a hash of id and text; rows with equal keys are equal in both. `root` is a component's least node, null for
    an empty set.
    """
    keyed = docs.select(F.col(id_column).alias("doc_id"), text_or_empty().alias("text"))
    keyed = keyed.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    sets = stored(shingle_sets(keyed, words), "sets")
    buckets = _buckets(keyed, words, percent)
    filled = sets.filter("node is not null")
    holders, sketches = holders_of(filled), filled.select("node", "sketch").dropDuplicates(["node"])
    sets = sets.drop("sketch")

    def texts_of(pairs: DataFrame) -> DataFrame:
        return texts_of_nodes(pairs, holders, keyed)

    roots = linked_nodes(buckets, sketches, texts_of, words, percent)
    rows = stored(sets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    smallest = rows.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("smallest"), F.count("*").alias("n"))
    smallest = stored(smallest.filter("n > 1").drop("n"), "smallest")
    rows = rows.join(small_or_shuffled(smallest, smallest.count()), "root", "left")
    component = F.coalesce("smallest", "doc_id")  # a component of one row, or of rows without ids, has the row's own
    return rows.select(F.col("doc_id").alias(id_column), "key", "n_shingles", "root", component.alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id") -> DataFrame:
    """The documents but for all of each component except that of the smallest id, nulls last; of rows equal in id and
    text one stays. Documents without words all stay. All columns are kept."""
    rows = stored(jaccard_components(docs, words, percent, id_column).filter("root is not null"), "components")
    place = F.struct(F.col(id_column).isNull().alias("no_id"), F.col(id_column).alias("id"), "key")
    first = rows.groupBy("root").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = stored(first.drop("n"), "first-of-each")
    later = rows.join(small_or_shuffled(first, first.count()), "root").filter(F.col("key") != F.col("first.key"))
    dropped = stored(later.select("key").distinct(), "dropped")
    repeated = stored(rows.groupBy("key").count().filter("count > 1").select("key"), "repeated")
    key = F.xxhash64(F.col(id_column), text_or_empty())
    keyed = docs.select(row_of(docs).alias("row"), key.alias("key"))
    kept = keyed.join(small_or_shuffled(dropped, dropped.count()), "key", "left_anti")
    several = small_or_shuffled(repeated, repeated.count())
    single = kept.join(several, "key", "left_anti")
    once = kept.join(several, "key", "left_semi").dropDuplicates(["key"])
    return single.unionByName(once).select("row.*")
