"""The corpus pipeline: stages over `documents`, each written as Parquet and reread as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadgauge.llm import decontaminate, jaccard_join, mixing, quality, secret_scan
from leadgauge.llm.queries import read
from leadgauge.llm.shared import stored


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects."""
    return quality.accepted(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return jaccard_join.one_of_each(docs, words=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark passage."""
    return decontaminate.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret span by a mark; the number of characters follows."""
    found = secret_scan.secret_spans(docs)
    clean = F.when(F.col("row.text").isNotNull(), secret_scan.redacted(F.col("text"), F.col("spans")))
    found = found.select("row", clean.alias("clean"))  # once: twice in one row, the folded spans of one would reach the other
    columns = {c: F.col("row").getField(c) for c in docs.columns} | {"text": F.col("clean")}
    if "n_chars" in columns:
        columns["n_chars"] = F.length("clean").cast(docs.schema["n_chars"].dataType)
    return found.select(*(column.alias(name) for name, column in columns.items()))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix the sources to their target weights: a row for each time a document is taken, with shard and order."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", without_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("mixing sources to target weights", mixed_sources),
]

#: Hashes, models and alignments have no SQL form. Tests hold each stage's rows against a plain computation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
