"""Filter interaction audit: what each of several filters removes at each step of every order in which they can be applied.

Each document has a mask of the filters that it fails. A mask fixes what happens to its document at every step of every
order, so it stands for one big integer whose fields are the counters of all steps (120 orders of five filters: 600
steps). Integers are summed instead of counters: each task adds up those of its documents by part, the sums meet in two
shuffles, the first spread over salts, and are unpacked last. Fields are 64 bits wide, more than any number of rows, so
no field overflows into the next.

Filters, by letter (words are maximal runs of other bytes than space and U+0009 to U+000D):

* A: fewer than 50 words; B: 100 * distinct words < 65 * words; C: 100 * letters A-Z > 5 * code points;
* D: holds one of #$%&*|; E: the text is also that of a document with a smaller id, anywhere in the table.

Null texts are empty; null and empty sources are one part. A null id is neither smaller than others nor is any smaller
than it. Rows with equal ids and texts do not count as copies of each other; each row is a document. Labels of an id that has
several count if any of them is 1. Texts are read whole. An empty table has no parts and gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadgauge.llm.shared import small_or_shuffled, stored, text_chunks, text_or_empty

FILTERS = "ABCDE"
ORDERS = ["".join(order) for order in permutations(FILTERS)]
STEPS = len(FILTERS)
COUNTERS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
FIELD_BYTES = 8
PACKED_BYTES = FIELD_BYTES * len(COUNTERS) * len(ORDERS) * STEPS
#: Bits of a document's code above its mask.
GOOD, TOXIC = 1 << STEPS, 2 << STEPS
#: Parts that a task sums at once; their sums are handed on beyond that.
HELD_PARTS = 1000
#: Tasks that the sums of one part meet in first.
SALTS = 64

_CAPITALS = bytes(range(65, 91))
_MARKS = b"#$%&*|"
_WITHIN_LETTER = bytes(range(0x80, 0xC0))

SUMS = "part string, salt int, packed binary"


def text_mask(text: bytes) -> int:
    """Bits of the filters A to D that a UTF-8 text fails."""
    words = text.split()  # of bytes: at space and U+0009 to U+000D
    points = len(text.translate(None, _WITHIN_LETTER))
    fails = (
        len(words) < 50,
        100 * len(set(words)) < 65 * len(words),
        100 * (len(text) - len(text.translate(None, _CAPITALS))) > 5 * points,
        len(text.translate(None, _MARKS)) < len(text),
    )
    return sum(1 << bit for bit, failing in enumerate(fails) if failing)


@lru_cache(maxsize=None)
def packed_outcomes(code: int) -> int:
    """One document's counters at all steps of all orders as the fields of one integer."""
    fields = np.zeros((len(COUNTERS), len(ORDERS), STEPS), dtype="<u8")
    for o, order in enumerate(ORDERS):
        gone = False
        for s, letter in enumerate(order):
            bit = 1 << FILTERS.index(letter)
            fails = bool(code & bit)
            here = fails and not gone
            gone_before, gone = gone, gone or fails
            alone = code & (GOOD - 1) == bit
            fields[:, o, s] = (not gone, here, fails and gone_before, alone, here and code & GOOD, here and code & TOXIC)
    return int.from_bytes(np.minimum(fields, 1).tobytes(), "little")


def unpacked(total: int) -> np.ndarray:
    """The fields of a sum, by counter, order and step."""
    fields = np.frombuffer(total.to_bytes(PACKED_BYTES, "little"), dtype="<u8")
    return fields.reshape(len(COUNTERS), len(ORDERS), STEPS).astype(np.int64)


def _described(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, key) of (doc_id, part, text); key is a 128-bit hash of the text."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, keys = [], []
            for _, data, offsets in text_chunks(batch.column(2)):
                for start, end in zip(offsets[:-1], offsets[1:]):
                    text = data[start:end].tobytes()
                    masks.append(text_mask(text))
                    keys.append(hashlib.blake2b(text, digest_size=16).digest())
            columns = [batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(keys, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "mask", "key"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(describe, f"doc_id {kind}, part string, mask int, key binary")


def _summed_by_task(codes: DataFrame) -> DataFrame:
    """SUMS of the rows (part, code, salt): each task adds up its documents' integers by part."""

    def rows(totals: dict[str, int], salt: int) -> pa.RecordBatch:
        packed = [total.to_bytes(PACKED_BYTES, "little") for total in totals.values()]
        columns = [pa.array(list(totals), pa.string()), pa.array([salt] * len(totals), pa.int32()), pa.array(packed, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["part", "salt", "packed"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, int] = {}
        salt = 0
        for batch in batches:
            parts = batch.column(0).dictionary_encode()
            names, salt = parts.dictionary.to_pylist(), batch.column(2)[0].as_py() if batch.num_rows else salt
            cells = parts.indices.to_numpy().astype(np.int64) * (4 * GOOD) + batch.column(1).to_numpy()
            for cell, n in zip(*(x.tolist() for x in np.unique(cells, return_counts=True))):
                part, code = names[cell // (4 * GOOD)], cell % (4 * GOOD)
                totals[part] = totals.get(part, 0) + n * packed_outcomes(code)
            if len(totals) > HELD_PARTS:
                yield rows(totals, salt)
                totals = {}
        if totals:
            yield rows(totals, salt)

    return codes.mapInArrow(add, SUMS)


def _merged(sums: DataFrame, *keys: str) -> DataFrame:
    """SUMS with equal keys added up, read one after the other in sorted partitions."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, total = None, 0

        def row() -> pa.RecordBatch:
            columns = [[current[0]], [current[-1] if len(keys) > 1 else 0], [total.to_bytes(PACKED_BYTES, "little")]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.binary()))], ["part", "salt", "packed"])

        for batch in batches:
            for part, salt, packed in zip(*(batch.column(i).to_pylist() for i in range(3))):
                key = (part, salt)[: len(keys)]
                if key != current:
                    if current is not None:
                        yield row()
                    current, total = key, 0
                total += int.from_bytes(packed, "little")
        if current is not None:
            yield row()

    return sums.repartition(*keys).sortWithinPartitions(*keys).select("part", "salt", "packed").mapInArrow(merge, SUMS)


def _table(sums: DataFrame) -> DataFrame:
    """All steps of all orders of each part's sum."""
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in (*COUNTERS, "shapley"))
    at = np.array([[FILTERS.index(letter) for letter in order] for order in ORDERS])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                fields = unpacked(int.from_bytes(packed, "little"))
                removed = np.zeros(STEPS, dtype=np.int64)
                np.add.at(removed, at.ravel(), fields[COUNTERS.index("removed")].ravel())
                columns = [pa.array([part] * at.size), pa.array(np.repeat(ORDERS, STEPS).tolist())]
                columns.append(pa.array(np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(ORDERS))))
                columns += [pa.array(counter.ravel()) for counter in fields] + [pa.array(removed[at].ravel())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "filter_order", "step", *COUNTERS, "shapley"])

    return sums.mapInArrow(unpack, schema)


def filter_audit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", part_column: str = "source") -> DataFrame:
    """(part, filter_order, step, counters..., shapley), one row for each step of each order in each part.

    kept: documents left after the step; removed: those removed in it; redundant: those that fail its filter but went
    before; unique_fails: those that fail its filter only; good_lost and toxic_lost: those removed here with
    quality or toxic 1 in `labels`; shapley: the filter's removed, summed over all orders.
    """
    part = F.coalesce(F.col(part_column).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_column).alias("doc_id"), part.alias("part"), text_or_empty().alias("text"))
    described = stored(_described(texts), "masks")
    firsts = described.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    firsts = stored(firsts.filter("first <> last").drop("last"), "copied")
    marked = labels.select(F.col("doc_id").alias("label_id"), F.col("quality") == 1, F.col("toxic") == 1).toDF("label_id", "good", "toxic")
    marked = marked.filter("label_id is not null and (good or toxic)").groupBy("label_id")
    marked = stored(marked.agg(F.max(F.coalesce("good", F.lit(False))).alias("good"), F.max(F.coalesce("toxic", F.lit(False))).alias("toxic")), "marked")
    rows = described.join(small_or_shuffled(firsts, firsts.count()), "key", "left")
    rows = rows.join(small_or_shuffled(marked, marked.count()), F.col("doc_id") == F.col("label_id"), "left")

    def bit(condition: F.Column, value: int) -> F.Column:
        return F.when(condition, value).otherwise(0)

    copy = bit(F.col("doc_id") > F.col("first"), 1 << FILTERS.index("E"))
    code = F.col("mask") + copy + bit(F.col("good"), GOOD) + bit(F.col("toxic"), TOXIC)
    codes = rows.select("part", code.alias("code"), F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"))
    return _table(_merged(_merged(_summed_by_task(codes), "part", "salt"), "part"))
