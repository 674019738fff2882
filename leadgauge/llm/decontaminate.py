"""Benchmark passages in documents, by q-gram lemma filtering and banded alignment.

Benchmark items are cut into overlapping windows, so close that every half of an item of 80 bytes or more, and every 79
bytes of a longer one, hold a whole window; an item shorter than the shortest window is one window. A stretch of text within k edits of a window
of w bytes shares at least w + 1 - q (k + 1) q-grams with it, all in a band of k + 1 diagonals (place in the text less
place in the item). Filters follow from that, each cheaper than the next: enough q-grams of any item near each other; enough
of one item's in one of the overlapping diagonal bands; enough of one window's there; enough shorter q-grams of the window there, which
tells more apart; an alignment of the window inside that band with at most k
edits. What is left are leaks, with places and edits. Counts are taken for many texts, items and bands at once. A-Z are lower-cased and runs of white
space in items and texts are kept as they are.

The index of a block of items is sent to the tasks; items are dealt to blocks of bounded size, and texts are scanned
once for each block, so benchmarks of any size are covered. Items of fewer than q bytes are found where their bytes are. Null and empty texts
and items match nothing. Repeated rows are reported each. An item that occurs several times in a text is reported for each
place; places less than GAP bytes apart are one. Texts are read whole. An empty table on either side gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadgauge.llm.hashing import LOWER
from leadgauge.llm.shared import row_of, text_chunks, text_or_empty

Q = 8
#: Bytes of the q-grams that a window's bands are looked through with once more.
SHORT_Q = 5
#: Most and least bytes of a window. Shorter ones would find everyday phrases.
WINDOW = 64
LEAST_WINDOW = 32
#: Most and least bytes between the starts of an item's windows.
STEP = 16
LEAST_STEP = 8
EDIT_SHARE = 0.1
#: Bytes of text between windows found that still count as one place.
GAP = 50
#: Bytes of items in one block's index.
INDEX_BYTES = 4 << 20
#: Bits of the sieve for each indexed q-gram, and its most and least size as powers of two.
SIEVE_SHARE, SIEVE_BITS = 64, (16, 27)
#: Windows looked through at once.
TOGETHER = 2048


def edit_budget(length: int) -> int:
    """Edits allowed in a window: a share of its length, and few enough to need Q + 1 shared q-grams."""
    return max(0, min(int(length * EDIT_SHARE), (length - 2 * Q) // Q))


def needed(length: int, q: int = Q) -> int:
    """q-grams that a stretch within the budget shares with a window of this length."""
    return length + 1 - q * (edit_budget(length) + 1)


def q_grams(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number."""
    if len(data) < Q:
        return np.zeros(0, dtype=np.uint64)
    one = data.astype(np.uint64)
    two = (one[:-1] << np.uint64(8)) | one[1:]
    four = (two[:-2] << np.uint64(16)) | two[2:]
    return (four[:-4] << np.uint64(32)) | four[4:]


def windows(length: int) -> list[tuple[int, int]]:
    """Starts and lengths of an item's windows, all of one length, the last one ending where the item does."""
    if length < Q:
        return []
    width = min(length, max(LEAST_WINDOW, min(WINDOW, 3 * length // 8)))
    step = max(LEAST_STEP, min(STEP, length // 2 - width + 1))
    return [(start, width) for start in [*range(0, length - width, step), length - width]]


def _spread(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... many[i] numbers for each i, one after the other."""
    return np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys begin, and their lengths."""
    if not len(keys):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return starts, np.diff(np.append(starts, len(keys)))


Found = tuple[int, int, int, int, int]


@dataclass
class Index:
    """The windows and q-grams of a block of items. Items lie one after the other in `letters`; places in them are places there."""

    ids: list
    letters: np.ndarray
    #: For each item: its first place, its first window, and its windows' width, edits and q-grams needed.
    base: np.ndarray
    first_window: np.ndarray
    width: np.ndarray
    edits: np.ndarray
    need: np.ndarray
    #: The first place of each window, ascending, and its item.
    window_at: np.ndarray
    window_item: np.ndarray
    #: Distinct q-grams; places[first[n] : first[n + 1]] are those of the n-th.
    grams: np.ndarray
    first: np.ndarray
    places: np.ndarray
    sieve: np.ndarray
    #: Widest stretch that holds so many q-grams of a window, by that number.
    reach: dict[int, int]
    #: Items of fewer than Q bytes: their bytes as numbers, with their items, by length.
    short: dict[int, tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def of(rows: list[tuple[object, str]]) -> Index:
        texts = [text.encode() for _, text in rows]
        letters = LOWER[np.frombuffer(b"".join(texts), dtype=np.uint8)]
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        base = np.cumsum(sizes) - sizes
        cut = [windows(n) for n in sizes.tolist()]
        width = np.array([own[0][1] if own else 0 for own in cut], dtype=np.int64)
        edits = np.array([edit_budget(w) for w in width.tolist()], dtype=np.int64)
        need = np.array([needed(w) for w in width.tolist()], dtype=np.int64)
        many = np.array([len(own) for own in cut], dtype=np.int64)
        window_at = np.array([start for own in cut for start, _ in own], dtype=np.int64) + np.repeat(base, many)
        place = _spread(base, np.maximum(sizes - Q + 1, 0))
        every = q_grams(letters)[place] if len(place) else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        grams, first = np.unique(every[order], return_index=True)
        bits = min(max(int(len(grams) * SIEVE_SHARE).bit_length(), SIEVE_BITS[0]), SIEVE_BITS[1])
        sieve = np.zeros(1 << bits, dtype=bool)
        sieve[_sieve_places(grams, bits)] = True
        reach: dict[int, int] = {}
        for w in np.unique(width[width > 0]).tolist():
            reach[needed(w)] = max(reach.get(needed(w), 0), w + edit_budget(w) - Q)
        short = {}
        for length in range(1, Q):
            own = np.flatnonzero(sizes == length)
            values = np.array([int.from_bytes(LOWER[np.frombuffer(texts[i], np.uint8)].tobytes(), "big") for i in own], dtype=np.uint64)
            if len(own):
                by_value = np.argsort(values, kind="stable")
                short[length] = values[by_value], own[by_value]
        return Index(
            [item_id for item_id, _ in rows], letters, base, np.cumsum(many) - many, width, edits, need, window_at,
            np.repeat(np.arange(len(rows)), many), grams, np.append(first, len(every)), place[order], sieve, reach, short,
        )

    def _dense_hits(self, grams: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Places of indexed q-grams that have enough others of any item near them."""
        hits = np.flatnonzero(self.sieve[_sieve_places(grams, len(self.sieve).bit_length() - 1)])
        at = np.searchsorted(self.grams, grams[hits])
        hits = hits[self.grams[np.minimum(at, len(self.grams) - 1)] == grams[hits]]
        hits = hits[hits + Q <= offsets[np.searchsorted(offsets, hits, side="right")]]
        marks = np.zeros(len(hits) + 1, dtype=np.int64)
        for few, most in self.reach.items():
            if len(hits) >= few:
                near = np.flatnonzero(hits[few - 1 :] - hits[: len(hits) - few + 1] <= most)
                np.add.at(marks, near, 1)
                np.add.at(marks, near + few, -1)
        return hits[np.cumsum(marks[:-1]) > 0]

    def _candidates(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, window, least diagonal) of the bands that hold enough of a window's q-grams. A diagonal is a place in the
        data less one in the items."""
        none = (np.zeros(0, dtype=np.int64),) * 3
        grams = q_grams(data)
        hits = self._dense_hits(grams, offsets) if len(self.grams) else grams[:0]
        if not len(hits):
            return none
        at = np.searchsorted(self.grams, grams[hits])
        many = self.first[at + 1] - self.first[at]
        inside, place = self.places[_spread(self.first[at], many)], np.repeat(hits, many)
        text = np.searchsorted(offsets, place, side="right") - 1
        item = np.searchsorted(self.base, inside, side="right") - 1
        shift = len(self.letters)
        band = (place - inside + shift) // (self.edits[item] + 1)
        bands = len(data) + shift + 2
        key = (text * len(self.ids) + item) * bands + band
        order = np.argsort(key)
        key, item, inside, text, band = key[order], item[order], inside[order], text[order], band[order]
        starts, sizes = _runs(key)
        after = np.zeros(len(starts), dtype=np.int64)
        follows = np.flatnonzero(key[starts[1:]] == key[starts[:-1]] + 1)
        after[follows] = sizes[follows + 1]
        enough = sizes + after >= self.need[item[starts]]
        # A band begins at a run and takes in the next one, or begins one before a run of which nothing came before.
        taken = np.concatenate([np.repeat(enough, sizes), np.zeros(1, dtype=bool)])
        upper = np.zeros(len(starts), dtype=bool)
        upper[follows + 1] = enough[follows]
        as_low, as_high = np.flatnonzero(taken[:-1]), np.flatnonzero(np.repeat(upper, sizes))
        rows = np.concatenate([as_low, as_high])
        low = np.concatenate([band[as_low], band[as_high] - 1])
        item, inside, text = item[rows], inside[rows], text[rows]
        from_window = np.searchsorted(self.window_at, inside - self.width[item] + Q)
        from_window = np.maximum(from_window, self.first_window[item])
        many = np.searchsorted(self.window_at, inside, side="right") - from_window
        window, where = _spread(from_window, many), np.repeat(np.arange(len(rows)), many)
        key = (text[where] * len(self.window_at) + window) * bands + low[where]
        order = np.lexsort((inside[where], key))
        key, seen = key[order], inside[where][order]
        fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (seen[1:] != seen[:-1]))) if len(key) else np.zeros(0, bool)
        order, key = order[fresh], key[fresh]
        starts, sizes = _runs(key)
        one = order[starts]
        item_of = self.window_item[window[one]]
        kept = one[sizes >= self.need[item_of]]
        of = self.window_item[window[kept]]
        return text[where[kept]], window[kept], low[where[kept]] * (self.edits[of] + 1) - shift

    def leaks(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[Found]:
        """(text, item, start, end, edits) for each place where an item is found in a text, in bytes of the text."""
        spans = self._short_items(data, offsets)
        text, window, low = self._candidates(data, offsets)
        width = self.width[self.window_item[window]]
        for w in np.unique(width).tolist():
            own = np.flatnonzero(width == w)
            for start in range(0, len(own), TOGETHER):
                part = own[start : start + TOGETHER]
                spans += self._verified(data, offsets, text[part], window[part], low[part], w)
        spans.sort()
        held: Found | None = None
        for found in spans:
            if held is not None and found[:2] == held[:2] and found[2] <= held[3] + GAP:
                held = (*held[:3], max(held[3], found[3]), max(held[4], found[4]))
                continue
            if held is not None:
                yield held
            held = found
        if held is not None:
            yield held

    def _verified(
        self, data: np.ndarray, offsets: np.ndarray, text: np.ndarray, window: np.ndarray, low: np.ndarray, w: int
    ) -> list[Found]:
        """The places of windows of w bytes in their bands: counted by shorter q-grams, then aligned."""
        k = edit_budget(w)
        diagonals = 2 * (k + 1)
        begin, end = offsets[text], offsets[text + 1]
        at = self.window_at[window]
        place = (at + low)[:, None] + np.arange(w + diagonals - 1)
        inside = (place >= begin[:, None]) & (place < end[:, None])
        near = np.where(inside, data[np.clip(place, 0, len(data) - 1)], 256)
        wanted = self.letters[at[:, None] + np.arange(w)]
        equal = np.lib.stride_tricks.sliding_window_view(near, w, axis=1) == wanted[:, None, :]
        grams = equal[:, :, : w - SHORT_Q + 1].copy()
        for j in range(1, SHORT_Q):
            grams &= equal[:, :, j : w - SHORT_Q + 1 + j]
        enough = grams.any(axis=1).sum(axis=1) >= needed(w, SHORT_Q)
        whole = equal.all(axis=2)
        exact = whole.any(axis=1)
        first = (at + low + np.argmax(whole, axis=1) - begin)[exact].tolist()
        item = self.window_item[window]
        found = [(t, i, a, a + w, 0) for t, i, a in zip(text[exact].tolist(), item[exact].tolist(), first)]
        for c in np.flatnonzero(enough & ~exact).tolist():
            own = data[begin[c] : end[c]]
            spot = aligned(wanted[c], own, int(at[c] + low[c] - begin[c]), diagonals, k)
            if spot is not None:
                found.append((int(text[c]), int(item[c]), *spot))
        return found

    def _short_items(self, data: np.ndarray, offsets: np.ndarray) -> list[Found]:
        """Where the bytes of the items are that are too short for windows."""
        found: list[Found] = []
        for length, (values, items) in self.short.items():
            if len(data) < length:
                continue
            grams = np.zeros(len(data) - length + 1, dtype=np.uint64)
            for j in range(length):
                grams = (grams << np.uint64(8)) | data[j : len(data) - length + 1 + j]
            first, last = np.searchsorted(values, grams), np.searchsorted(values, grams, side="right")
            place = np.flatnonzero(last > first)
            text = np.searchsorted(offsets, place, side="right") - 1
            place, text = place[place + length <= offsets[text + 1]], text[place + length <= offsets[text + 1]]
            many = last[place] - first[place]
            own = items[_spread(first[place], many)].tolist()
            starts = np.repeat(place - offsets[text], many).tolist()
            found += [(t, i, a, a + length, 0) for t, i, a in zip(np.repeat(text, many).tolist(), own, starts)]
        return found


def _sieve_places(grams: np.ndarray, bits: int) -> np.ndarray:
    return (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def aligned(window: np.ndarray, text: np.ndarray, low: int, width: int, most: int) -> tuple[int, int, int] | None:
    """Span and edits of the best alignment of a window in a text on the `width` diagonals from `low` on, or None if it
    takes more than `most` edits. Only the cells of the band are computed."""
    for diagonal in range(max(low, 0), low + width):
        if np.array_equal(text[diagonal : diagonal + len(window)], window):
            return diagonal, diagonal + len(window), 0
    far = most + 1
    letters = text[max(low, 0) : low + width + len(window)].tolist()
    shift = max(-low, 0)

    def letter(column: int) -> int:
        at = column - shift
        return letters[at] if 0 <= at < len(letters) else -1

    # best[d]: edits of the window's first r bytes ending on diagonal low + d; came[d]: the diagonal it started on.
    best, came = [0] * width, list(range(width))
    for r, wanted in enumerate(window.tolist()):
        row, origin = [far] * width, [0] * width
        for d in range(width):
            cost, start = best[d] + (letter(r + d) != wanted), came[d]
            if d + 1 < width and best[d + 1] + 1 < cost:
                cost, start = best[d + 1] + 1, came[d + 1]
            if d and row[d - 1] + 1 < cost:
                cost, start = row[d - 1] + 1, origin[d - 1]
            row[d], origin[d] = min(cost, far), start
        best, came = row, origin
        if min(best) > most:
            return None
    d = min(range(width), key=best.__getitem__)
    if best[d] > most:
        return None
    return max(0, low + came[d]), min(len(text), low + d + len(window)), best[d]


def _blocks(benchmark: DataFrame, index_bytes: int) -> Iterator[Index]:
    """Indexes of the items, block by block; each block's texts are of bounded size together."""
    items = benchmark.select("item_id", text_or_empty().alias("text")).filter(F.octet_length("text") > 0)
    total = items.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    blocks = -(-total // index_bytes)
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block) if blocks > 1 else items
        yield Index.of([(row["item_id"], row["text"]) for row in part.orderBy("item_id", "text").collect()])


def leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(id, item_id, start, end, edits) for each item found in a document; places are code points of the text."""
    rows = docs.select(F.col(id_column).alias("id"), text_or_empty().alias("text"))
    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"id {rows.schema['id'].dataType.simpleString()}, item_id {item_kind}, start long, end long, edits int"
    found = None
    for index in _blocks(benchmark, index_bytes):
        part = rows.mapInArrow(_finder(rows.sparkSession.sparkContext.broadcast(index)), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = rows.sparkSession.createDataFrame([], schema)
    return found.withColumnRenamed("id", id_column)


def _finder(shared):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            which, item, start, end, edits = [], [], [], [], []
            for rows, raw, offsets in text_chunks(batch.column(1)):
                data = LOWER[raw]
                for t, i, a, b, e in index.leaks(data, offsets):
                    text = data[offsets[t] : offsets[t + 1]]
                    points = np.cumsum((text & 0xC0) != 0x80)
                    which.append(rows.start + t)
                    item.append(index.ids[i])
                    start.append(int(points[a]) - 1)
                    end.append(int(points[b - 1]))
                    edits.append(e)
            ids = batch.column(0).take(pa.array(which, pa.int64()))
            arrays = [ids, pa.array(item), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(edits, pa.int32())]
            if which:
                yield pa.RecordBatch.from_arrays(arrays, ["id", "item_id", "start", "end", "edits"])

    return find


def decontaminated(docs: DataFrame, benchmark: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The documents in which no benchmark item is found, with all their columns."""
    kept = docs.select(row_of(docs).alias("row"), text_or_empty().alias("text"))
    for index in _blocks(benchmark, index_bytes):
        kept = kept.mapInArrow(_remover(docs.sparkSession.sparkContext.broadcast(index)), kept.schema)
    return kept.select("row.*")


def _remover(shared):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            clean = np.ones(batch.num_rows, dtype=bool)
            for rows, raw, offsets in text_chunks(batch.column(1)):
                for t, *_ in index.leaks(LOWER[raw], offsets):
                    clean[rows.start + t] = False
            yield batch.filter(pa.array(clean))

    return remove
