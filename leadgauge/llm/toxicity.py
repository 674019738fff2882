"""Toxicity by maximum-scoring segments of token log-odds, with extreme-value calibration.

Tokens are runs of letters, digits and non-ASCII bytes, A-Z lowered, hashed to a fixed number of buckets. A bucket's
log-odds of toxic against other labelled texts have a Dirichlet prior in proportion to its share of all documents; those
not clearly different from zero, among so many buckets, count as zero. Both count the distinct texts that hold a
token, so neither a text that repeats a token nor copies of a text weigh more. A token scores its log-odds less a fixed cost, so that scores fall on average. A linear
scan finds all maximal segments of positive score. Segment scores of texts without toxicity follow an extreme-value law: its
decay solves sum p exp(decay * score) = 1 over the tokens of other texts, its scale is fitted to their best segments. By that law
every segment has an expected number of chance occurrences in its text; a passage is significant if that is small.
The sum law of the best segments gives one evidence value for a text, and a logistic curve over all labelled
rows turns it into a score.

Labels come only from rows that are not held out; scores see nothing but the text. Null and empty texts have no segments
and get the lowest evidence, 0. Without labels of both classes all scores are 0.5. Texts are read whole. Equal texts have equal
scores. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadgauge.llm.hashing import PUNCTUATION, word_hashes
from leadgauge.llm.labels import held_out, labelled_texts
from leadgauge.llm.linear import probability
from leadgauge.llm.shared import stored, text_chunks, text_or_empty

BUCKET_BITS = 18
COST = 0.2
#: Signed root of the deviance beyond which log-odds are taken as different from zero.
CLEAR = 3.5
SIGNIFICANT = 0.01
#: Evidence is counted in bins that are so wide on a log scale, so there are few of them however great it gets.
BIN_WIDTH = 0.01

Segment = tuple[int, int, float]


def token_buckets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The buckets of each text's tokens, in order."""
    for _, data, offsets in text_chunks(texts):
        hashes, first, _, _ = word_hashes(data, offsets, PUNCTUATION)
        buckets = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        for start, end in zip(first[:-1], first[1:]):
            yield buckets[start:end]


def maximal_segments(scores: np.ndarray) -> list[Segment]:
    """All maximal segments (start, end, score) of a sequence of scores, in one pass over its positive runs.

    Each new positive run joins those before it from which the running total has been no lower, as long as
    that lets the joined segment end at a new height.
    """
    places = np.flatnonzero(scores > 0)
    if not len(places):
        return []
    heights = np.concatenate(([0.0], np.cumsum(scores)))
    breaks = np.flatnonzero(np.diff(places) > 1) + 1
    starts = places[np.concatenate(([0], breaks))]
    ends = places[np.append(breaks - 1, len(places) - 1)] + 1
    # Each open segment: start, end, height before it, height after it, nearest earlier one that starts lower.
    stack: list[list] = []
    for start, end in zip(starts.tolist(), ends.tolist()):
        low, high = float(heights[start]), float(heights[end])
        while True:
            earlier = len(stack) - 1
            while earlier >= 0 and stack[earlier][2] >= low:
                earlier = stack[earlier][4]
            if earlier < 0 or stack[earlier][3] >= high:
                stack.append([start, end, low, high, earlier])
                break
            start, low = stack[earlier][0], stack[earlier][2]
            del stack[earlier:]
    return [(start, end, high - low) for start, end, low, high, _ in stack]


def decay_of(scores: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of sum shares * exp(root * scores) = 1; scores fall on average and some are positive."""
    low, high = 0.0, 1.0
    with np.errstate(over="ignore"):
        while float(shares @ np.exp(high * scores)) < 1 and high < 64:
            high *= 2
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if float(shares @ np.exp(middle * scores)) < 1 else (low, middle)
    return (low + high) / 2


@dataclass
class Model:
    scores: np.ndarray
    decay: float
    log_scale: float
    curve: tuple[float, float]

    def evidence(self, tokens: int, best: list[float]) -> float:
        """Minus the log of the chance that a harmless text of this length has such best segments; the sum law, over as many
        segments as give most evidence. Segments that chance gives such a text at least once do not enter it."""
        most, total = 0.0, 0.0
        for r, score in enumerate(sorted(best, reverse=True), start=1):
            normalised = self.decay * score - self.log_scale - math.log(max(tokens, 1))
            if normalised <= 0:
                break
            total += normalised
            log_p = -total + (r - 1) * math.log(total) - math.lgamma(r + 1) - math.lgamma(r)
            most = max(most, -log_p - r * math.log(2))
        return most

    def expected(self, tokens: int, score: float) -> float:
        return math.exp(min(50.0, self.log_scale + math.log(max(tokens, 1)) - self.decay * score))


def bucket_counts(rows: DataFrame) -> np.ndarray:
    """Texts that hold a token of each bucket, over all rows of (label, text), by label 0, 1 or 2. Tasks count on their
    own and send at most one row for each bucket and label."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, 1 << BUCKET_BITS), dtype=np.int64)
        for batch in batches:
            for label, buckets in zip(batch.column(0).to_pylist(), token_buckets(batch.column(1))):
                held[label, np.unique(buckets)] += 1
        for label in range(3):
            own = np.flatnonzero(held[label])
            columns = [np.full(len(own), label), own, held[label, own]]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["label", "bucket", "n"])

    counts = rows.mapInArrow(count, "label long, bucket long, n long").groupBy("label", "bucket")
    summed = counts.agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros((3, 1 << BUCKET_BITS))
    label, bucket, n = (summed.column(c).to_numpy() for c in ("label", "bucket", "n"))
    total[label, bucket] = n
    return total


def token_scores(everywhere: np.ndarray, toxic: np.ndarray, other: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Log-odds of each bucket with a Dirichlet prior as strong as the toxic texts together, less the cost. `texts` are
    the distinct texts of label 0 and 1."""
    prior = (everywhere + 0.5) / (everywhere.sum() + 0.5 * len(everywhere)) * toxic.sum()
    one, zero = toxic + prior, other + prior
    odds = np.log(one / (one.sum() - one)) - np.log(zero / (zero.sum() - zero))
    share = texts[1] / texts.sum()
    both = toxic + other
    with np.errstate(divide="ignore", invalid="ignore"):
        deviance = 2 * (
            np.where(toxic > 0, toxic * np.log(toxic / (both * share)), 0.0)
            + np.where(other > 0, other * np.log(other / (both * (1 - share))), 0.0)
        )
    return np.where(deviance >= CLEAR**2, odds, 0.0) - COST


def _weighted_curve(evidence: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """A logistic curve through weighted points, by Newton steps on the log-likelihood with a weak ridge."""
    x = np.stack([evidence, np.ones_like(evidence)])
    ones, zeros = weight[label == 1].sum(), weight[label == 0].sum()
    target = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    beta = np.array([0.0, math.log((ones + 1) / (zeros + 1))])

    def loss(b: np.ndarray) -> float:
        z = b @ x
        return float((weight * (np.logaddexp(0, z) - target * z)).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(beta @ x, -500, 500)))
        curvature = (x * (weight * p * (1 - p))) @ x.T + 1e-6 * np.eye(2)
        step = np.linalg.solve(curvature, x @ (weight * (p - target)))
        size = 1.0
        while loss(beta - size * step) > loss(beta) and size > 1e-6:
            size /= 2
        beta = beta - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def labels_of(labelled: DataFrame) -> DataFrame:
    """Distinct texts of each label: two rows."""
    return labelled.groupBy("label").agg(F.countDistinct(F.xxhash64("text")).alias("n"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    everywhere = bucket_counts(docs.select(F.lit(2).alias("label"), text_or_empty().alias("text")))[2]
    labelled = labelled_texts(docs, labels, label).select("label", "text")
    distinct = labelled.withColumn("hash", F.xxhash64("text")).dropDuplicates(["label", "hash"]).drop("hash")
    counts = bucket_counts(distinct)
    if not counts[0].sum() or not counts[1].sum():
        return Model(np.full(1 << BUCKET_BITS, -COST), 1.0, 0.0, (0.0, 0.0))
    given = {row["label"]: row["n"] for row in labels_of(labelled).collect()}
    scores = token_scores(everywhere, counts[1], counts[0], np.array([given[0], given[1]], dtype=float))
    decay = decay_of(scores, counts[0] / counts[0].sum())
    model = Model(scores, decay, 0.0, (0.0, 0.0))
    shared = docs.sparkSession.sparkContext.broadcast(scores)  # a fixed number of buckets

    def best_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, best = [], []
            for buckets in token_buckets(batch.column(1)):
                tokens.append(len(buckets))
                best.append(sorted((score for _, _, score in maximal_segments(shared.value[buckets])), reverse=True))
            arrays = [batch.column(0), pa.array(tokens, pa.int64()), pa.array(best, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["label", "tokens", "best"])

    rows = stored(labelled.mapInArrow(best_segments, "label int, tokens long, best array<double>"), "segments")
    # The mean of a Gumbel law lies Euler's constant above its mode. Texts without a segment say nothing of it.
    top = rows.filter("label = 0 and size(best) > 0 and tokens > 0")
    mean = top.agg(F.avg(decay * F.get("best", F.lit(0)) - F.log("tokens")).alias("mean")).collect()[0]["mean"]
    if mean is not None:
        model.log_scale = mean - 0.5772156649015329

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            evidence = [model.evidence(n, best) for n, best in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            bins = np.rint(np.log1p(np.array(evidence, dtype=float)) / BIN_WIDTH).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bins)], ["label", "bin"])

    bins = rows.mapInArrow(binned, "label int, bin long").groupBy("label", "bin").count().toArrow()
    y, place, n = (bins.column(c).to_numpy() for c in ("label", "bin", "count"))
    order = np.lexsort((place, y))
    model.curve = _weighted_curve(np.expm1(place[order] * BIN_WIDTH), y[order], n[order].astype(float))
    return model


def scored(docs: DataFrame, model: Model, id_column: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """(id, held_out, score, predicted, passages) of every row; a passage is (start, end) in tokens, its score, and how
    many such are expected by chance in a harmless text of that length."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of buckets
    passage = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            evidence, passages = [], []
            for buckets in token_buckets(batch.column(1)):
                found = maximal_segments(model.scores[buckets])
                evidence.append(model.evidence(len(buckets), [s for _, _, s in found]))
                rated = [(start, end, s, model.expected(len(buckets), s)) for start, end, s in found]
                passages.append([dict(zip(("start", "end", "score", "expected"), x)) for x in rated if x[3] <= SIGNIFICANT])
            scores = pa.array(probability(np.array(evidence, dtype=float), model.curve))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), scores, pa.array(passages, pa.list_(passage))], ["id", "score", "passages"]
            )

    rows = docs.select(F.col(id_column).alias("id"), text_or_empty().alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    passages = "array<struct<start:long,end:long,score:double,expected:double>>"
    scores = rows.mapInArrow(score, f"id {kind}, score double, passages {passages}")
    return scores.select(
        F.col("id").alias(id_column),
        held_out(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "passages",
    )
