"""Labelled documents: which rows a model may learn from, and their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadgauge.llm.shared import small_or_shuffled, text_or_empty


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text leaves 2 when divided by 4. Null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, text, label) of the documents to learn from. Equal label rows of an id count once; ids with differing
    or no labels are left out."""
    given = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    given = given.filter(~held_out(F.col("doc_id")))
    single = given.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("high"))
    single = single.filter("label = high").drop("high")
    texts = docs.select("doc_id", text_or_empty().alias("text")).filter(~held_out(F.col("doc_id")))
    return texts.join(small_or_shuffled(single, given.count()), "doc_id")
