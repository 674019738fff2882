"""Passages that documents repeat, by compact windows of token min-hashes.

A text's tokens are its word shingles, in order. For each of several hash functions, all stretches of `length` or
more words that have the same least token hash form one compact window (left, centre, right): they start between left and centre
and end between centre and right. Windows are the nodes of a Cartesian tree over the hashes; only those wide enough matter,
and their centres are the least tokens of the stretches of just that length.

Equal passages are found without hubs: each stretch of `length` words lies in one window of the first function, so the
stretches of those windows whose least hash other texts share are hashed as wholes and grouped. Every text of a group
holds the stretch, whatever else they share.

Edited passages are found by two functions: two windows of different functions that cover one stretch are one key, so all
texts of a key agree in both functions with each other, not only with a hub. Keys whose texts are already in passages there and in one
class are settled. Each other key's texts are verified against a hub of the key, the text with most links: where stretches of `length` words
around both least tokens have so many shingles in common that their similarity can reach the threshold, and the
similarity of both passages does reach it, they are a passage. Texts of a key that are similar to each other but not
to the hub share tokens there that the hub lacks. A task that holds all texts of a hub verifies those with each other of
which one has enough tokens of a stretch of the other. Where a hub has more texts, the tokens that it lacks make keys of a longer
context, which are verified with a hub of their own in another round of shuffles, until no key is open. So a run that many texts
share, but no passage around it, costs one verification for each text, not for each pair.

Keys that a third of all rows hold are met in each batch of texts first: only a batch's least text goes into the shuffle
of the key, and the others are tied to it.

Result: one row for every document with its passages and a class: documents that are joined by shared passages, numbered by the
smallest id. Equal texts are one node, so groups of copies cost one node each; all their words are repeated if they are
long enough. Null, empty and shorter texts have no passages and are classes of their own. Ids may be null or repeated. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from leadgauge.llm.components import components
from leadgauge.llm.hashing import SPACE, mixed, mixed_int, run_hashes, shingle_hashes, word_bounds, word_hashes
from leadgauge.llm.hub_join import at_hubs, holders_of, texts_of_nodes
from leadgauge.llm.shared import WIDE_CHUNK_BYTES, discard, small_or_shuffled, stored, text_chunks, text_or_empty

HASHES = 4
#: Texts a task remembers, so as not to index equal ones again.
REMEMBERED = 200_000
#: Texts of one hub, and tokens and spots of them, that a task holds at once; hubs with more are split.
HELD_PARTNERS, HELD_TOKENS, HELD_SPOTS = 16_384, 8_000_000, 2_000_000
#: Tokens of a hub within which the spots of a text are one place.
PLACE = 16

#: `least` is the least node of a batch that has the key, if several of it do; rows of the others carry it and a salt.
WINDOWS = "hash long, node long, function int, l int, c int, r int, least long, salt long"
#: Stretches (pair 0: window and stretch hash, start) and function pairs (pair 1: both least hashes, both centres).
KEYS = "pair int, key long, key2 long, node long, p int, q int, least long, salt long"
#: Passages have a node, results a group: whether `a` has a passage with `b` at the places p and q, and tokens there that b lacks.
FOUND = "a long, b long, node long, start long, end long, group long, p int, q int, linked boolean, lacking array<int>"


def _running(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The best of every `width` neighbours, by best-so-far from both ends of blocks of that width."""
    n = len(values) - width + 1
    rows = -(-len(values) // width)
    padded = np.concatenate([values, np.full(rows * width - len(values), values[-1])]).reshape(rows, width)
    ahead = best.accumulate(padded, axis=1).ravel()
    behind = best.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[:n], ahead[width - 1 : width - 1 + n])


def _nearest(heights: np.ndarray, texts: np.ndarray, step: int, equal: bool) -> np.ndarray:
    """The next place before (step -1) or after (1) each one in its text whose height is less, or `equal` to it; -1 if none is."""
    n = len(heights)
    found = np.arange(n) + step
    inside = (found >= 0) & (found < n)
    inside[inside] = texts[found[inside]] == texts[inside]
    found[~inside] = -1
    open_ = np.flatnonzero(inside)
    while len(open_):  # what lies between is higher, and so is what lies between a higher one and its own next place
        at = found[open_]
        higher = heights[at] > heights[open_] if equal else heights[at] >= heights[open_]
        open_ = open_[higher]
        found[open_] = found[at[higher]]
        open_ = open_[found[open_] >= 0]
    return found


def compact_windows(
    values: np.ndarray, width: int, begins: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, centre, right) of all compact windows of at least `width` tokens, with inclusive ends. Of equal hashes the
    leftmost counts as least; neighbours with equal hashes have one window. Texts of at least `width` tokens may follow one
    another, each from its place in `begins` on; no window reaches over the end of its text."""
    n = len(values)
    none = np.zeros(0, dtype=np.int64)
    if n < width:
        return none, none, none
    begins = np.zeros(1, dtype=np.int64) if begins is None else begins
    ends = np.append(begins[1:], n)
    least = _running(values, width, np.minimum)
    over = (ends[:-1, None] - np.arange(1, width)).ravel()  # stretches from here on reach into the next text
    least[over] = 0
    # A token is the least of some stretch if the greatest of the minima around it is its own hash.
    edge = np.zeros(width - 1, dtype=values.dtype)
    around = _running(np.concatenate([edge, least, edge]), width, np.maximum)
    first = np.append(True, values[1:] != values[:-1])
    first[begins] = True
    centres = np.flatnonzero((around == values) & first)
    heights, texts = values[centres], np.searchsorted(begins, centres, side="right") - 1
    before, after = _nearest(heights, texts, -1, True), _nearest(heights, texts, 1, False)
    left = np.where(before >= 0, centres[before] + 1, begins[texts])
    right = np.where(after >= 0, centres[after] - 1, ends[texts] - 1)
    wide = right - left + 1 >= width
    return left[wide], centres[wide], right[wide]


def _indexed(docs: DataFrame, words: int, length: int, hashes: int) -> DataFrame:
    """The compact windows of every text that a task has not indexed lately. `docs` has (node, text)."""
    width = length - words + 1

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = [mixed_int(j + 1) for j in range(hashes)]
        seen: set[int] = set()
        for batch in batches:
            nodes, parts = batch.column(0).to_pylist(), []
            for rows, data, offsets in text_chunks(batch.column(1), WIDE_CHUNK_BYTES):
                word_hash, first, _, _ = word_hashes(data, offsets)
                own, bounds = [], []
                for node, start, end in zip(nodes[rows], first[:-1].tolist(), first[1:].tolist()):
                    if end - start < length or node in seen:
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(node)
                    own.append(node)
                    bounds.append((start, end - words + 1))
                if not own:
                    continue
                every = shingle_hashes(word_hash, words)
                tokens = np.concatenate([every[start:end] for start, end in bounds])
                sizes = np.array([end - start for start, end in bounds])
                begins, owner = np.cumsum(sizes) - sizes, np.array(own, dtype=np.int64)
                for j, salt in enumerate(salts):
                    values = mixed(tokens ^ salt)
                    left, centre, right = compact_windows(values, width, begins)
                    text = np.searchsorted(begins, centre, side="right") - 1
                    base = begins[text]
                    parts.append((values[centre], owner[text], j, left - base, centre - base, right - base))
            if parts:
                yield _batch(parts)

    def _batch(parts: list[tuple]) -> pa.RecordBatch:
        sizes = [len(p[0]) for p in parts]
        columns = [np.concatenate([p[0] for p in parts]).view(np.int64)]
        columns.append(np.concatenate([p[1] for p in parts]))
        columns.append(np.repeat(np.array([p[2] for p in parts], dtype=np.int32), sizes))
        columns += [np.concatenate([p[i] for p in parts]).astype(np.int32) for i in (3, 4, 5)]
        columns += _met(columns[0], columns[1])
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], _names(WINDOWS))

    return docs.mapInArrow(index, WINDOWS)


def _met(keys: np.ndarray, nodes: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """`least` and `salt` of the rows of a batch: the least node that has the key, null if no other has it; and the node, but
    0 if it is the least."""
    order = np.argsort(keys)
    starts = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1]))) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(keys)))
    least, most = (best.reduceat(nodes[order], starts) if len(keys) else nodes for best in (np.minimum, np.maximum))
    back = np.empty(len(keys), dtype=np.int64)
    back[order] = np.repeat(least, sizes)
    alone = np.empty(len(keys), dtype=bool)
    alone[order] = np.repeat(least == most, sizes)
    return pa.array(back, pa.int64(), mask=alone), np.where(alone | (nodes == back), 0, nodes)


def _names(schema: str) -> list[str]:
    return [field.strip().split(" ")[0] for field in schema.split(",")]


def stretch_keys(
    word_hash: np.ndarray, tokens: np.ndarray, last: np.ndarray, windows: np.ndarray, width: int, length: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least hash, hash of the stretch, start) of the stretches of `length` words in windows (hash, function, l, c, r) of
    the first function. A window stands for a run of equal tokens from its centre on, so stretches may begin in that run.
    Texts follow one another, and `last` is the last token of each that has a stretch."""
    own = windows[windows[:, 1] == 0]
    ends_run = np.append(tokens[1:] != tokens[:-1], True)
    ends_run[last] = True
    run_ends = np.flatnonzero(ends_run)
    latest = run_ends[np.searchsorted(run_ends, own[:, 3])]
    low = np.maximum(own[:, 2], own[:, 3] - width + 1)
    high = np.minimum(latest, own[:, 4] - width + 1)
    sizes = np.maximum(high - low + 1, 0)
    start = np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    whole = run_hashes(word_hash, length)
    return np.repeat(own[:, 0], sizes), whole[start].view(np.int64), start


def function_pairs(windows: np.ndarray, width: int) -> list[np.ndarray]:
    """(least hash, least hash, centre, centre) of every two windows (hash, function, l, c, r) of different functions that
    hold the least tokens of one stretch of `width` tokens."""
    order = windows[np.argsort(windows[:, 3], kind="stable")]
    centres = order[:, 3]
    first = np.arange(1, len(order) + 1)
    sizes = np.searchsorted(centres, centres + width) - first
    left, right = np.repeat(first - 1, sizes), np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    other = order[left, 1] != order[right, 1]
    left, right = order[left[other]], order[right[other]]
    earliest = np.maximum(np.maximum(left[:, 2], right[:, 2]), right[:, 3] - width + 1)
    latest = np.minimum(left[:, 3], np.minimum(left[:, 4], right[:, 4]) - width + 1)
    both = earliest <= latest
    left, right = left[both], right[both]
    turned = (left[:, 1] > right[:, 1])[:, None]
    left, right = np.where(turned, right, left), np.where(turned, left, right)
    return [left[:, 0], right[:, 0], left[:, 3], right[:, 3]]


def _moved(windows: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The windows (hash, function, l, c, r), each at places moved by so many."""
    return windows + np.outer(by, [0, 0, 1, 1, 1])


def _keyed(texts: DataFrame, words: int, length: int) -> DataFrame:
    """KEYS of the rows (node, text, windows), windows being arrays of (hash, function, l, c, r)."""
    width = length - words + 1

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, held, parts = batch.column(0).to_numpy(), batch.column(2), []
            bounds, fields = held.offsets.to_numpy().astype(np.int64), held.values.to_numpy()
            for rows, data, offsets in text_chunks(batch.column(1), WIDE_CHUNK_BYTES):
                word_hash, first, _, _ = word_hashes(data, offsets)
                windows = fields[bounds[rows.start] : bounds[rows.stop]].reshape(-1, 5)
                if not len(windows):
                    continue
                tokens, n_words = shingle_hashes(word_hash, words), np.diff(first)
                text = np.repeat(np.arange(rows.stop - rows.start), np.diff(bounds[rows.start : rows.stop + 1]) // 5)
                # Texts one after the other, as words and, for pairs, so far apart that none reaches from text to text.
                last = (first[1:] - words)[n_words >= length]
                hashes, stretches, places = stretch_keys(
                    word_hash, tokens, last, _moved(windows, first[text]), width, length
                )
                owner = np.searchsorted(first, places, side="right") - 1
                places = places - first[owner]
                parts.append((0, nodes[rows][owner], hashes, stretches, places, places))
                apart = first[:-1] + width * np.arange(len(n_words))
                least, other, p, q = function_pairs(_moved(windows, apart[text]), width)
                owner = np.searchsorted(apart, p, side="right") - 1
                parts.append((1, nodes[rows][owner], least, other, p - apart[owner], q - apart[owner]))
            for pair in (0, 1):
                own = [p for p in parts if p[0] == pair and len(p[2])]
                if not own:
                    continue
                sizes = [len(p[2]) for p in own]
                columns = [np.full(sum(sizes), pair, dtype=np.int32)]
                columns += [np.concatenate([p[i] for p in own]) for i in (2, 3)]
                columns.append(np.concatenate([p[1] for p in own]))
                columns += [np.concatenate([p[i] for p in own]).astype(np.int32) for i in (4, 5)]
                none = pa.nulls(sum(sizes), pa.int64()), np.zeros(sum(sizes), dtype=np.int64)
                columns += none if pair else _met(columns[2], columns[3])
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], _names(KEYS))

    return texts.mapInArrow(keys, KEYS)


def _spans(mask: np.ndarray) -> list[tuple[int, int]]:
    """Runs of true values as (start, end)."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _similar(mine: np.ndarray, hub: np.ndarray, shifts: list[int], a: int, b: int, percent: int) -> tuple[int, int] | None:
    """Where the hub has a stretch similar enough to mine from a to b, at one of the shifts."""
    ours = np.unique(mine[a:b])
    for shift in shifts:
        c, d = max(0, a + shift), min(len(hub), b + shift)
        if d <= c:
            continue
        theirs = np.unique(hub[c:d])
        common = int(_among(ours, theirs).sum())
        if 100 * common >= percent * (len(ours) + len(theirs) - common):
            return c, d
    return None


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are among ordered ones."""
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


@dataclass
class Spot:
    """What a text has around the places p and q of two least tokens that it shares with a hub."""

    p: int
    q: int
    hub_p: int
    hub_q: int
    #: Whether a passage with the hub holds both places.
    linked: bool
    #: The tokens of all stretches that hold both places, and which of them the hub has there.
    tokens: np.ndarray
    same: np.ndarray


def least_common(width: int, percent: int) -> int:
    """Similarity s of two stretches of n tokens takes at least 2 s n / (1 + s) common ones."""
    return -(-2 * percent * width // (100 + percent))


def shared_passages(
    mine: np.ndarray, hub: np.ndarray, spots: np.ndarray, width: int, percent: int
) -> tuple[list[tuple[int, int, int, int]], list[Spot]]:
    """Verified passages (start, end, start at hub, end at hub) in tokens, ends exclusive, around the spots (p, q, p at hub, q at
    hub), places of least tokens that both texts have; and what there is at each spot."""
    passages: list[tuple[int, int, int, int]] = []
    results: list[Spot | None] = [None] * len(spots)
    first, last = np.minimum(spots[:, 0], spots[:, 1]), np.maximum(spots[:, 0], spots[:, 1])
    begin, end = np.maximum(last - width + 1, 0), np.minimum(first + width, len(mine))
    low = np.maximum(np.maximum(spots[:, 2], spots[:, 3]) - width + 1, 0)
    high = np.minimum(np.minimum(spots[:, 2], spots[:, 3]) + width, len(hub))
    order = np.argsort(begin, kind="stable")
    reach = np.maximum.accumulate(end[order])
    least = least_common(width, percent)
    for own in np.split(order, np.flatnonzero(begin[order][1:] >= reach[:-1]) + 1):
        a, b = int(begin[own[0]]), int(end[own].max())
        same = _among(mine[a:b], np.sort(hub[int(low[own].min()) : int(high[own].max())]))
        values, times = np.unique(spots[own, 2] - spots[own, 0], return_counts=True)
        shifts = values[np.argsort(-times, kind="stable")].tolist()
        counts = np.concatenate(([0], np.cumsum(same)))
        close = np.zeros(b - a + 1, dtype=np.int64)
        begins = np.flatnonzero(counts[width:] - counts[:-width] >= least)
        np.add.at(close, begins, 1)
        np.add.at(close, begins + width, -1)
        found = []
        for c, d in _spans(np.cumsum(close[:-1]) > 0):
            inside = np.flatnonzero(same[c:d])
            whole = (a + c + int(inside[0]), a + c + int(inside[-1]) + 1)
            if (spot := _similar(mine, hub, shifts, *whole, percent)) is not None:
                found.append((*whole, *spot))
                continue
            for x, y in _spans(same[c:d]):  # the stretch as a whole differs too much: take its unbroken parts
                part = (a + c + x, a + c + y)
                if y - x >= width and (spot := _similar(mine, hub, shifts, *part, percent)) is not None:
                    found.append((*part, *spot))
        passages += found
        for i in own.tolist():
            linked = any(c <= first[i] and last[i] < d for c, d, _, _ in found)
            region = slice(begin[i], end[i])
            results[i] = Spot(*spots[i].tolist(), linked, mine[region], same[begin[i] - a : end[i] - a])
    return passages, results


class Partners:
    """The texts of one hub, by number, and their passages with each other. Keys that lie at one place of the hub are one."""

    def __init__(self, width: int, percent: int):
        self.width, self.percent = width, percent
        self.tokens: list[np.ndarray] = []
        self.covered: list[np.ndarray] = []
        self.root: list[int] = []
        self.links: list[int] = []
        self.keys: list[dict[tuple[int, int], Spot]] = []
        self.members: dict[tuple[int, int], list[int]] = defaultdict(list)
        self.tested: set[tuple[int, int]] = set()
        self.found: list[tuple[int, int, tuple[int, int, int, int]]] = []

    def add(self, tokens: np.ndarray, passages: list, spots: list[Spot]) -> None:
        """A text with its passages with the hub, and what it has at the spots that it shares with it."""
        x = len(self.tokens)
        self.tokens.append(tokens)
        self.covered.append(np.zeros(len(tokens), dtype=bool))
        for c, d, _, _ in passages:
            self.covered[x][c:d] = True
        self.root.append(-1 if passages else x)  # -1: the hub
        self.links.append(len(passages))
        self.keys.append({})
        for spot in spots:
            self.keys[x].setdefault((spot.hub_p // PLACE, spot.hub_q // PLACE), spot)
        for group in self.keys[x]:
            self.members[group].append(x)

    def _find(self, x: int) -> int:
        while x >= 0 and self.root[x] != x:
            x = self.root[x]
        return x

    def _covered(self, x: int, group: tuple[int, int]) -> bool:
        spot = self.keys[x][group]
        return bool(self.covered[x][min(spot.p, spot.q) : max(spot.p, spot.q) + 1].all())

    def _test(self, x: int, y: int) -> bool:
        """Look for passages of two texts around all keys that both have; whether there are any."""
        if (min(x, y), max(x, y)) in self.tested:
            return False
        self.tested.add((min(x, y), max(x, y)))
        both = [(self.keys[x][g], self.keys[y][g]) for g in self.keys[x] if g in self.keys[y]]
        last = len(self.tokens[y]) - 1
        spots = []
        for a, b in both:  # the place of y that lies at the hub where that of x does
            at = min(max(b.p + a.hub_p - b.hub_p, 0), last)
            spots.append((a.p, a.q, at, min(max(at + a.q - a.p, 0), last)))
        spots = np.array(spots, dtype=np.int64)
        passages, _ = shared_passages(self.tokens[x], self.tokens[y], spots, self.width, self.percent)
        for c, d, e, f in passages:
            self.covered[x][c:d] = self.covered[y][e:f] = True
            self.found.append((x, y, (c, d, e, f)))
            self.links[x] += 1
            self.links[y] += 1
        low, high = sorted((self._find(x), self._find(y)))
        if passages and high >= 0:
            self.root[high] = low
        return bool(passages)

    def passages(self) -> list[tuple[int, int, tuple[int, int, int, int]]]:
        """(x, y, passage) of the texts that are similar to each other where not all of a key's texts are to the hub."""
        for group, members in self.members.items():
            failed = [n for n, x in enumerate(members) if not self.keys[x][group].linked]
            if len(members) < 2 or not failed:
                continue
            one = len({self._find(x) for x in members}) == 1
            open_ = [n for n in failed if not (one and self._covered(members[n], group))]
            if open_:
                self._resolve(group, members, open_)
        return self.found

    def _resolve(self, group: tuple[int, int], members: list[int], open_: list[int]) -> None:
        """Test each open text with those that have enough tokens of one of its stretches there, those that have most first,
        until it is in a passage there and in one class with all of them."""
        least = least_common(self.width, self.percent)
        tokens = [self.keys[x][group].tokens for x in members]
        sizes = [len(t) for t in tokens]
        distinct, number = np.unique(np.concatenate(tokens), return_inverse=True)
        owner = np.repeat(np.arange(len(members)), sizes)
        single = np.unique(owner * len(distinct) + number)
        shared = np.bincount(single % len(distinct), minlength=len(distinct)) > 1
        column = np.where(shared, np.cumsum(shared) - 1, shared.sum())  # the last column: tokens that no other text has
        has = np.zeros((len(members), int(shared.sum()) + 1), dtype=bool)
        has[single // len(distinct), column[single % len(distinct)]] = True
        has[:, -1] = False
        columns = np.split(column[number], np.cumsum(sizes)[:-1])
        root = np.array([self._find(x) for x in members])
        links = np.array([self.links[x] for x in members])
        for n in open_:
            x, own = members[n], columns[n]
            width = min(self.width, len(own))
            if int((own < has.shape[1] - 1).sum()) < least:
                continue  # no text can have enough of its tokens
            sums = np.zeros((len(members), len(own) + 1), dtype=np.int16)
            np.cumsum(has[:, own], axis=1, out=sums[:, 1:])
            common = (sums[:, width:] - sums[:, : sums.shape[1] - width]).max(axis=1)
            common[n] = 0
            can = np.flatnonzero(common >= least)
            can, covered = can[np.lexsort((-links[can], -common[can]))], self._covered(x, group)
            while len(can):
                y, can = int(can[0]), can[1:]
                if not (covered and root[y] == root[n]) and self._test(x, members[y]):
                    links[[n, y]] += 1
                    root[(root == root[n]) | (root == root[y])] = min(root[n], root[y])
                    covered = self._covered(x, group)
                if covered:
                    can = can[root[can] != root[n]]


def _verified(pairs: DataFrame, texts: DataFrame, words: int, length: int, percent: int) -> DataFrame:
    """FOUND of the pairs (a, b, spots): verified passages of both texts, in words, those of a hub's texts with each other, and the
    results of the spots of keys of several texts where a task does not hold all texts of the hub. A hub's passages are merged over the
    partners that a task sees one after the other; rows have a null a where they stand for several."""
    width = length - words + 1

    def tokens_of(texts: pa.Array) -> Iterator[np.ndarray]:
        for _, data, offsets in text_chunks(texts):
            hashes, first, _, _ = word_hashes(data, offsets)
            for start, end in zip(first[:-1], first[1:]):
                yield shingle_hashes(hashes[start:end], words)

    def span(a: int | None, b: int, node: int, start: int, end: int) -> tuple:
        return a, b, node, start, end + words - 1, None, None, None, None, None

    def result(a: int, b: int, group: int, spot: Spot) -> tuple:
        hashes = (mixed(spot.tokens[~spot.same]) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        return a, b, None, None, None, group, spot.p, spot.q, spot.linked, np.unique(hashes)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_id, held = np.zeros(0, np.uint64), None, np.zeros(0, bool)
        partners, names, held_back, size, many = None, [], [], 0, 0

        def finished() -> list[tuple]:
            """The hub's passages, and those of its texts with each other."""
            rows = [span(None, hub_id, hub_id, s, e) for s, e in _spans(held)]
            for x, y, (s, e, c, d) in partners.passages() if partners is not None else ():
                rows += [span(names[x], names[y], names[x], s, e), span(None, names[y], names[y], c, d)]
            return rows

        for batch in batches:
            rows: list[tuple] = []
            ids = zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)))
            offsets, values = batch.column(4).offsets.to_numpy(), batch.column(4).values
            groups, several = values.field("group").to_numpy(), values.field("several").to_numpy(zero_copy_only=False)
            spots = np.stack([values.field(c).to_numpy() for c in ("p", "q", "hub_p", "hub_q")], axis=1).astype(np.int64)
            for n, ((b, a, alone), tokens) in enumerate(zip(ids, tokens_of(batch.column(2)))):
                if a is None:
                    rows += finished()
                    hub, hub_id, held = tokens, b, np.zeros(len(tokens), bool)
                    names, held_back, size, many = [], [], 0, 0
                    partners = Partners(width, percent) if alone else None
                    continue
                own = slice(offsets[n], offsets[n + 1])
                passages, results = shared_passages(tokens, hub, spots[own], width, percent)
                for s, e, c, d in passages:
                    rows.append(span(a, b, a, s, e))
                    held[c:d] = True
                kept = np.flatnonzero(several[own]).tolist()
                size, many = size + len(tokens), many + len(kept)
                if partners is not None and (size > HELD_TOKENS or many > HELD_SPOTS):
                    partners = None
                    for name, text, keys, places in held_back:
                        yield _rows([result(name, b, *x) for x in zip(keys, shared_passages(text, hub, places, width, percent)[1])])
                    held_back = []
                if partners is None:
                    rows += [result(a, b, int(groups[own][k]), results[k]) for k in kept]
                elif kept:
                    names.append(a)
                    partners.add(tokens, passages, [results[k] for k in kept])
                    held_back.append((a, tokens, groups[own][kept].tolist(), spots[own][kept]))
            if rows:
                yield _rows(rows)
        if rows := finished():
            yield _rows(rows)

    kinds = [pa.int64()] * 6 + [pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int32())]

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], _names(FOUND))

    return at_hubs(pairs, texts, ("spots",), HELD_PARTNERS, alone=True).mapInArrow(verify, FOUND)


def merged_spans(spans: DataFrame) -> DataFrame:
    """(node, start, end) with overlapping and touching spans of a node made one."""
    order = Window.partitionBy("node").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0)
    numbered = spans.distinct().withColumn("begins", begins).withColumn("island", F.sum("begins").over(order))
    return numbered.groupBy("node", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def _equal_stretches(keys: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Spans (node, start, end) of the stretches that several texts hold, and edges (a, b) that tie them together."""
    group = Window.partitionBy("key", "key2", "salt")  # one text of each batch, and one row for each of the others
    held = keys.filter("pair = 0").select("key", "key2", "salt", "node", "p", "least")
    held = held.withColumns({"low": F.min("node").over(group), "high": F.max("node").over(group)})
    held = held.filter("least is not null or low <> high")
    tied = F.when(F.col("salt") != 0, F.col("least")).otherwise(F.col("low")).alias("least")
    start = F.col("p").cast("long")
    held = stored(held.select("node", tied, start.alias("start"), (start + length).alias("end")), "stretches")
    edges = held.filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    found = stored(merged_spans(held.select("node", "start", "end")), "stretch-spans"), stored(edges, "stretch-edges")
    discard(held)
    return found


def _kept(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows whose group is among the stored groups."""
    return rows.join(small_or_shuffled(groups, groups.count()), "group", "left_semi")


def _unsettled(items: DataFrame, spans: DataFrame, edges: DataFrame, words: int) -> DataFrame:
    """The items (group, node, p, q) of the groups whose texts are not all in passages there and in one class."""
    low, high = F.least("p", "q").cast("long"), F.greatest("p", "q").cast("long") + words
    asked = items.select("node", low.alias("at"), F.lit(None).cast("long").alias("reach"), "group", high.alias("to"))
    blank = (F.lit(None).cast("long").alias(c) for c in ("group", "to"))
    marks = merged_spans(spans).select("node", F.col("start").alias("at"), F.col("end").alias("reach"), *blank)
    before = Window.partitionBy("node").orderBy("at", F.col("reach").isNull())  # of one text; its spans are disjoint
    reach = F.last("reach", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, 0))
    placed = marks.unionByName(asked).withColumn("covered", F.coalesce(F.col("to") <= reach, F.lit(False)))
    placed = placed.filter("group is not null").select("group", "node", "covered")
    rooted = placed.join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
    state = rooted.groupBy("group").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.min("covered").alias("all"))
    still = stored(state.filter("x <> y or not all").select("group"), "open-groups")
    return stored(_kept(items, still), "open-items")


def _finer(found: DataFrame) -> DataFrame | None:
    """Items of the keys by which texts that are not all linked with their hub share a token that it lacks. Keys of the
    same texts are one."""
    results = found.filter("group is not null")
    failed = stored(results.filter("not linked").select("group").distinct(), "failed-groups")
    each = _kept(results, failed).select("group", F.col("a").alias("node"), "p", "q", "linked", F.explode("lacking").alias("d"))
    each = stored(each, "lacking")
    members = F.bit_xor(F.xxhash64("node", "p", "q")).alias("members")
    keys = each.groupBy("group", "d").agg(
        F.min("node").alias("x"), F.max("node").alias("y"), F.min("linked").alias("all"), F.count("*").alias("n"), members
    )
    keys = keys.filter("x <> y and not all").groupBy("group", "n", "members").agg(F.min("d").alias("d"))
    keys = stored(keys.select("group", "d"), "longer-keys")
    n = keys.count()
    if not n:
        return None
    items = each.join(small_or_shuffled(keys, n), ["group", "d"])
    items = stored(items.select(F.xxhash64("group", "d").alias("group"), "node", "p", "q"), "items")
    discard(each, keys, failed)
    return items


def _edited_passages(
    keys: DataFrame,
    equal: DataFrame,
    edges: DataFrame,
    texts_of: Callable[[DataFrame], DataFrame],
    verified: Callable[[DataFrame, DataFrame], DataFrame],
    words: int,
) -> DataFrame | None:
    """Verified passages (a, b, node, start, end) of the texts that share a pair of functions' least hashes."""
    rows = keys.filter("pair = 1").select(F.xxhash64("key", "key2").alias("group"), "node", "p", "q")
    several = rows.groupBy("group").agg(F.min("node").alias("x"), F.max("node").alias("y")).filter("x <> y").select("group")
    items = stored(_kept(rows, stored(several, "pair-groups")), "items")
    passages, links = None, edges
    while items is not None:
        spans = equal if passages is None else equal.unionByName(passages.select("node", "start", "end"))
        open_items = _unsettled(items, spans, links, words)
        if open_items.isEmpty():
            break
        ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node")))
        ranked = open_items.join(ends.groupBy("node").agg(F.count("*").alias("links")), "node", "left")
        best = F.max(F.struct(F.coalesce("links", F.lit(0)).alias("links"), "node", "p", "q")).alias("hub")
        hubs = stored(ranked.groupBy("group").agg(best, (F.count("*") > 2).alias("several")), "hubs")
        met = open_items.join(small_or_shuffled(hubs, hubs.count()), "group").filter("node <> hub.node")
        met = met.select(
            F.col("node").alias("a"), F.col("hub.node").alias("b"), "p", "q", F.col("hub.p").alias("hub_p"), F.col("hub.q").alias("hub_q"), "several"
        )
        # Keys at one place of the hub are one from here on.
        place = [F.floor(F.col(c) / PLACE).alias(f"{c}_place") for c in ("hub_p", "hub_q")]
        spot = F.min(F.struct(F.abs(F.col("p") - F.col("q")), "p", "q", "hub_p", "hub_q")).alias("spot")
        places = met.repartition("a", "b").groupBy("a", "b", *place).agg(spot, F.max("several").alias("several"))
        group = F.xxhash64("b", "hub_p_place", "hub_q_place").alias("group")
        spot = F.struct(group, "several", *(f"spot.{c}" for c in ("p", "q", "hub_p", "hub_q")))
        pairs = places.groupBy("a", "b").agg(F.collect_list(spot).alias("spots"))
        pairs = stored(pairs, "pairs")  # no more spots than a text has windows
        found = stored(verified(pairs, texts_of(pairs)), "passages")
        discard(items, open_items, hubs, pairs)
        own = found.filter("node is not null").select("a", "b", "node", "start", "end")
        passages = own if passages is None else passages.unionByName(own)
        links = edges.unionByName(passages.filter("a is not null").select("a", "b").distinct())
        items = _finer(found)
    return passages


def _word_count(column: str) -> Column:
    @F.arrow_udf(LongType())
    def count(texts: pa.Array) -> pa.Array:
        counts = [np.zeros(0, dtype=np.int64)]
        for _, data, offsets in text_chunks(texts, WIDE_CHUNK_BYTES):
            starts, _ = word_bounds(data, offsets, SPACE)
            counts.append(np.diff(np.searchsorted(starts, offsets)))
        return pa.array(np.concatenate(counts), pa.int64())

    return count(column)


def repeated_passages(
    docs: DataFrame, length: int = 50, words: int = 5, percent: int = 80, hashes: int = HASHES
) -> DataFrame:
    """(doc_id, n_words, repeated_words, passages, class_id) of every row; a passage is (start, end) in words."""
    keyed = docs.select("doc_id", text_or_empty().alias("text"))
    keyed = keyed.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), F.xxhash64("text").alias("node"), "text")
    rows = stored(keyed.select("doc_id", "key", "node", _word_count("text").alias("n_words")), "texts-described")
    copies = rows.groupBy("node").agg(F.count("*").alias("copies"), F.min("n_words").alias("n_words"))
    holders = holders_of(rows)
    spread = Window.partitionBy("hash", "salt")  # one text of each batch, and one row for each of the others
    windows = _indexed(keyed.select("node", "text"), words, length, hashes).withColumns(
        {"x": F.min("node").over(spread), "y": F.max("node").over(spread)}
    )
    windows = windows.filter("least is not null or x <> y").groupBy("node")  # a text's windows are fewer than its words
    fields = (F.col(c).cast("long") for c in ("hash", "function", "l", "c", "r"))
    windows = stored(windows.agg(F.flatten(F.collect_set(F.array(*fields))).alias("windows")), "windows")

    def texts_of(pairs: DataFrame) -> DataFrame:
        return texts_of_nodes(pairs, holders, keyed)

    def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        return _verified(pairs, texts, words, length, percent)

    texts = texts_of(windows.select(F.col("node").alias("a"), F.col("node").alias("b")))
    keys = stored(_keyed(texts.join(windows, "node").select("node", "text", "windows"), words, length), "keys")
    equal, edges = _equal_stretches(keys, length)
    passages = _edited_passages(keys, equal, edges, texts_of, verified, words)
    whole = copies.filter((F.col("copies") > 1) & (F.col("n_words") >= length))
    spans = whole.select("node", F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end"))
    spans = spans.unionByName(equal)
    if passages is not None:
        spans = spans.unionByName(passages.select("node", "start", "end"))
        edges = edges.unionByName(passages.filter("a is not null").select("a", "b"))
    roots = components(edges)
    spans = merged_spans(spans)
    listed = F.array_sort(F.collect_list(F.struct("start", "end"))).alias("passages")  # disjoint spans of one text
    found = spans.groupBy("node").agg(listed, F.sum(F.col("end") - F.col("start")).alias("repeated_words"))
    result = rows.join(found, "node", "left")
    long_enough = F.when(F.col("n_words") >= length, F.col("node"))
    result = result.join(roots, "node", "left")
    result = result.withColumn("root", F.coalesce("root", long_enough))
    result = stored(result, "classed")
    smallest = stored(result.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("smallest")), "classes")
    result = result.join(small_or_shuffled(smallest, smallest.count()), "root", "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return result.select(
        "doc_id",
        "n_words",
        F.coalesce("repeated_words", F.lit(0).cast("long")).alias("repeated_words"),
        F.coalesce("passages", none).alias("passages"),
        F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("smallest")).alias("class_id"),
    )
