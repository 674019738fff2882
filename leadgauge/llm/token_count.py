"""Token counts by heap-and-linked-list byte-pair merging.

A word's symbols form a linked list and its mergeable pairs a heap of (rank, place). The pair of the lowest rank, the
leftmost of equals, is popped and merged until none is left. The count is the initial symbols minus the merges; no
token identifier is ever made. Counts of words seen lately are kept, so a word is merged once for each such memory.

Null texts count as empty and have no tokens. Texts are read whole, of any length; a run of letters is one word and its
merging takes time n log n. Equal rows have equal counts. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadgauge.llm.shared import text_or_empty

#: Words whose counts a worker keeps; with more, it starts afresh.
KEPT_WORDS = 1_000_000
KEPT_LENGTH = 64

# Capital letters of newer Unicode versions than Python's tables, as ranges with the distance to their small letters.
NEWER_CAPITALS = [
    (0x1C89, 0x1C89, 1),
    (0xA7CB, 0xA7CB, 0x264 - 0xA7CB),
    (0xA7CC, 0xA7CC, 1),
    (0xA7CE, 0xA7CE, 1),
    (0xA7D2, 0xA7D2, 1),
    (0xA7D4, 0xA7D4, 1),
    (0xA7DA, 0xA7DA, 1),
    (0xA7DC, 0xA7DC, 0x19B - 0xA7DC),
    (0x10D50, 0x10D65, 0x20),
    (0x16EA0, 0x16EB8, 0x1B),
]
#: From here on no code point is a letter; the tables of the regular expressions have a few there.
NO_LETTERS = "\U000323b0-\U0010ffff"

_NEWER = {c: c + step for first, last, step in NEWER_CAPITALS for c in range(first, last + 1)}
_RARE = regex.compile("[" + "".join(map(chr, _NEWER)) + NO_LETTERS + "]")


class Tokenizer:
    """The parts of a tokenizer file that decide how many tokens a text has."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {(left, right): (rank, left + right) for rank, (left, right) in enumerate(pairs)}
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(regex.escape(t) for t in special)) if special else None
        steps = spec["pre_tokenizer"]["pretokenizers"]
        pattern = steps[0]["pattern"]["Regex"]
        self.words = regex.compile(pattern, regex.V0)
        self.words_of_rare = regex.compile(pattern.replace(r"\p{L}", rf"[\p{{L}}--[{NO_LETTERS}]]"), regex.V1)
        self.letters = _byte_letters()
        self.known: dict[str, int] = {}

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self.count_plain(text)
        pieces = self.special.split(text)
        return len(pieces) - 1 + sum(map(self.count_plain, pieces))

    def count_plain(self, text: str) -> int:
        if not text.isascii():
            # Letters are lowered one by one, so a capital sigma at a word's end is no exception.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        if not text.isascii() and _RARE.search(text):
            words = self.words_of_rare.findall(text.translate(_NEWER).lower())
        else:
            words = self.words.findall(text.lower())
        known = self.known
        try:
            return sum(map(known.__getitem__, words))
        except KeyError:
            return sum(known[w] if w in known else self.learn(w) for w in words)

    def learn(self, word: str) -> int:
        n = self.merged(word)
        if len(word) <= KEPT_LENGTH:
            if len(self.known) >= KEPT_WORDS:
                self.known.clear()
            self.known[word] = n
        return n

    def merged(self, word: str) -> int:
        """Symbols left of one word after all merges."""
        letters, ranks = self.letters, self.ranks
        symbols: list[str | None] = [letters[b] for b in word.encode("utf-8")]
        symbols[-1] += self.suffix
        n = left = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        found = [ranks.get(pair) for pair in zip(symbols, symbols[1:])]
        heap = [(pair[0], i, pair[1]) for i, pair in enumerate(found) if pair]
        heapq.heapify(heap)
        heap_push, heap_pop = heapq.heappush, heapq.heappop
        while heap:
            rank, i, whole = heap_pop(heap)
            j = after[i]
            if symbols[i] is None or j >= n or ranks.get((symbols[i], symbols[j])) != (rank, whole):
                continue  # one of the two is no longer what it was when the pair was pushed
            symbols[i], symbols[j] = whole, None
            left -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := ranks.get((whole, symbols[k])):
                    heap_push(heap, (found[0], i, found[1]))
            h = before[i]
            if h >= 0 and (found := ranks.get((symbols[h], whole))):
                heap_push(heap, (found[0], h, found[1]))
        return left


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where printable, else the next one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


@lru_cache(maxsize=2)
def load(path: str) -> Tokenizer:
    with open(path, encoding="utf-8") as file:
        return Tokenizer(json.load(file))


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_column: str = "doc_id") -> DataFrame:
    """Bytes and tokens of every text: (id, n_bytes, n_tokens, over_limit). The file is read where the tasks run."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(tokenizer_path)
        for batch in batches:
            counts = pa.array([tokenizer.count(text) for text in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts], ["id", "n_bytes", "n_tokens"])

    text = text_or_empty()
    rows = docs.select(
        F.col(id_column).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")
    )
    id_type = rows.schema["id"].dataType.simpleString()
    counts = rows.mapInArrow(counted, f"id {id_type}, n_bytes long, n_tokens long")
    return counts.select(
        F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
