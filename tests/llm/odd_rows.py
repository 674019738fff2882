"""Rows that every operator has to bear, and fixtures for them."""

from __future__ import annotations

import pytest

from leadgauge.llm.shared import ship_package

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls in id, text and source, an empty and a blank text, repeated rows and ids, a very long word, letters of many bytes.
ODD = [
    (1, "plain words here and some more"),
    (None, "plain words here and some more"),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (5, "same row"),
    (5, "same row"),
    (5, "other text of the same id"),
    (6, "x" * 200_000),
    (7, "é𝄞ß " * 300, None),
]


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with a column whose name operators use themselves."""

    def make(rows, clash: str | None = None):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCUMENT)
        return df if clash is None else df.withColumn(clash, df["doc_id"])

    return make
