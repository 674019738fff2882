"""Quality scores by a support vector machine over naive Bayes features.

A text's features say which n-grams it holds: runs of one to three bytes, digits as one, and runs of one to three word shapes
(case, ending, length, whether the word before or some word of late is the same). They are hashed to a fixed number of
columns. Each column is scaled by the log ratio of its smoothed shares in the two classes, counted over all labelled
rows, and a linear hinge-loss model is fitted by dual coordinate descent on a bounded sample of them. A logistic curve,
fitted on rows of the sample that the model has not seen, makes margins scores.

Labels come only from rows that are not held out; scores see nothing but the text. Null and empty texts have no n-grams
and get the score of the bias. Without labels of both classes all scores are 0.5. Texts are read whole. Equal texts have
equal scores. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from leadgauge.llm.hashing import SPACE, mixed, word_hashes
from leadgauge.llm.labels import held_out, labelled_texts
from leadgauge.llm.linear import dual_coordinate_descent, logistic_curve, probability
from leadgauge.llm.shared import text_chunks, text_or_empty

COLUMN_BITS = 17
#: Rows that the model is fitted on at most, in expectation; each labelled row is as likely to be among them.
SAMPLE_ROWS = 12_000
#: One of so many sampled rows fits the curve instead of the model.
CURVE_SHARE = 4
#: Bytes whose n-grams are hashed at once: a worker keeps the memory of its largest arrays.
GRAM_BLOCK = 1 << 16

_DIGIT = np.array([48 <= b < 58 for b in range(256)])
_UPPER = np.array([65 <= b < 91 for b in range(256)])
_LETTER = np.array([65 <= b < 91 or 97 <= b < 123 or b >= 128 for b in range(256)])
_AS_ZERO = np.arange(256, dtype=np.uint64)
_AS_ZERO[48:58] = 48


def _column(codes: np.ndarray, kind: int) -> np.ndarray:
    return (mixed(codes + (np.uint64(kind) << np.uint64(56))) >> np.uint64(64 - COLUMN_BITS)).astype(np.uint32)


def _gram_columns(data: np.ndarray) -> list[np.ndarray]:
    """The columns of the runs of one, two and three bytes that end at each byte, digits as one."""
    columns = [np.empty(len(data), dtype=np.uint32) for _ in range(3)]
    for start in range(0, len(data), GRAM_BLOCK):
        before = min(start, 2)
        one = _AS_ZERO[data[start - before : start + GRAM_BLOCK]]
        two, three = one.copy(), one.copy()
        two[1:] |= one[:-1] << np.uint64(8)
        three[2:] |= (one[1:-1] << np.uint64(8)) | (one[:-2] << np.uint64(16))
        for n, gram in enumerate((one, two, three)):
            columns[n][start : start + GRAM_BLOCK] = _column(gram[before:], n)
    return columns


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A small number for each word: case, ending, length, and whether it repeats."""

    def share(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(table[data], dtype=np.int64)))
        return sums[ends] - sums[starts]

    length, upper, letters, digits = ends - starts, share(_UPPER), share(_LETTER), share(_DIGIT)
    case = np.where(letters == 0, 0, np.where(upper == 0, 1, np.where(upper == 1, 2, np.where(upper * 2 > letters, 3, 4))))
    last, head = data[ends - 1], data[starts]
    ending = np.where(_LETTER[last] | _DIGIT[last], 0, last.astype(np.int64))
    opening = (~(_LETTER[head] | _DIGIT[head])).astype(np.int64)
    size = np.minimum(np.log2(length).astype(np.int64), 7)
    again = np.zeros(len(hashes), dtype=np.int64)
    for back in (1, 2):
        again[back:] |= (hashes[back:] == hashes[:-back]).astype(np.int64) * back
    starts_text = first[:-1][first[:-1] < len(hashes)]
    again[starts_text] = 0
    return ((((case * 256 + ending) * 2 + opening) * 8 + size) * 4 + again) * 2 + (digits > 0)


def features(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted columns of the n-grams that each text holds."""
    for _, data, offsets in text_chunks(texts):
        if not len(data):
            yield from (np.zeros(0, np.uint32) for _ in range(len(offsets) - 1))
            continue
        columns = _gram_columns(data)
        hashes, first, starts, ends = word_hashes(data, offsets, SPACE)
        shapes = _shapes(data, starts, ends, hashes, first).astype(np.uint64) + np.uint64(1)
        runs = [shapes, shapes.copy(), shapes.copy()]
        runs[1][1:] |= shapes[:-1] << np.uint64(20)
        runs[2][2:] = runs[1][2:] ^ mixed(shapes[:-2])
        run_columns = [_column(r, 3 + n) for n, r in enumerate(runs)]
        for a, b, c, d in zip(offsets[:-1], offsets[1:], first[:-1], first[1:]):
            own = [x[a + n : b] for n, x in enumerate(columns)] + [x[c + n : d] for n, x in enumerate(run_columns)]
            yield np.unique(np.concatenate(own))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    curve: tuple[float, float]

    def scores(self, texts: pa.Array) -> np.ndarray:
        margins = [self.weights[own].sum() / max(1.0, np.sqrt(len(own))) for own in features(texts)]
        return probability(np.array(margins, dtype=float) + self.bias, self.curve)


def class_counts(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Texts of each class that hold an n-gram of a column, and texts of each class, over all labelled rows.

    Tasks count on their own; sums over tasks have one row for each column and class, a fixed number.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = np.zeros((2, 1 << COLUMN_BITS), dtype=np.int64), np.zeros(2, dtype=np.int64)
        for batch in batches:
            for label, own in zip(batch.column(0).to_pylist(), features(batch.column(1))):
                held[label, own] += 1
                rows[label] += 1
        for label in (0, 1):
            own = np.flatnonzero(held[label])
            arrays = [np.append(own, -1), np.append(held[label, own], rows[label])]
            columns = [pa.array(np.full(len(own) + 1, label)), *map(pa.array, arrays)]
            yield pa.RecordBatch.from_arrays(columns, ["label", "column", "n"])

    counts = labelled.select("label", "text").mapInArrow(count, "label long, column long, n long")
    summed = counts.groupBy("label", "column").agg(F.sum("n").alias("n")).toArrow()
    label, column, n = (summed.column(c).to_numpy() for c in ("label", "column", "n"))
    held, rows = np.zeros((2, 1 << COLUMN_BITS)), np.zeros(2)
    every = column >= 0
    held[label[every], column[every]] = n[every]
    rows[label[~every]] += n[~every]
    return held, rows


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    labelled = labelled_texts(docs, labels, label)
    held, rows = class_counts(labelled)
    if not rows.all():
        return Model(np.zeros(1 << COLUMN_BITS), 0.0, (0.0, 0.0))
    ratio = np.log((held[1] + 1) / (rows[1] + 2)) - np.log((held[0] + 1) / (rows[0] + 2))
    share = F.lit(min(1.0, sample_rows / rows.sum()))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) / 1_000_000
    sample = labelled.filter(place < share)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array([x.tobytes() for x in features(batch.column(2))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), own], ["doc_id", "label", "columns"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    table = sample.select("doc_id", "label", "text").mapInArrow(described, f"doc_id {kind}, label int, columns binary")
    taken = table.select(F.xxhash64("doc_id", "columns").alias("at"), "label", "columns").orderBy("at").toArrow()
    # Views of the received bytes, and values of single precision: the driver holds the sample once.
    columns = [np.frombuffer(x.as_buffer(), dtype=np.uint32) for x in taken.column("columns")]
    narrow = ratio.astype(np.float32)
    values = [narrow[c] / np.float32(max(1.0, np.sqrt(len(c)))) for c in columns]
    y = taken.column("label").to_numpy()
    for_curve = np.arange(len(y)) % CURVE_SHARE == 0
    for_model = np.flatnonzero(~for_curve)
    signs = np.where(y == 1, 1.0, -1.0)
    rows_in = [(columns[i], values[i]) for i in for_model]
    w = dual_coordinate_descent(rows_in, signs[for_model], np.ones(len(for_model)), 1 << COLUMN_BITS)
    unseen = np.flatnonzero(for_curve)
    margins = np.array([w[columns[i]] @ values[i] + w[-1] for i in unseen])
    return Model(w[:-1] * ratio, float(w[-1]), logistic_curve(margins, y[unseen]))


def scored(docs: DataFrame, model: Model, id_column: str = "doc_id", threshold: float = 0.7) -> DataFrame:
    """(id, held_out, score, predicted) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array(shared.value.scores(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], ["id", "score"])

    rows = docs.select(F.col(id_column).alias("id"), text_or_empty().alias("text"))
    scores = rows.mapInArrow(score, f"id {rows.schema['id'].dataType.simpleString()}, score double")
    return scores.select(
        F.col("id").alias(id_column),
        held_out(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The documents that score at least the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(texts))

    # Only texts go to Python, and only scores come back.
    return docs.filter(score(text_or_empty()) >= threshold)
