"""Aggregates, caps and flags shared by the features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def capped(value: Column, cap: int) -> Column:
    """At most `cap`; NULL stays NULL, which `least` would turn into the cap."""
    return F.when(value > cap, cap).otherwise(value)


def flag(condition: Column) -> Column:
    """1 when the condition holds, 0 when it is false or unknown."""
    return F.when(condition, 1).otherwise(0)


def distinct_over(value: Column, threshold: int) -> Column:
    """Aggregate: are there more than `threshold` distinct values?

    None or two of them are told from maximum and minimum alone, which combine map-side in one pass; only a higher
    threshold needs the distinct count and its second shuffle.
    """
    if threshold == 0:
        return F.max(value.isNotNull())
    if threshold == 1:
        return F.coalesce(F.min(value) < F.max(value), F.lit(False))
    return F.count_distinct(value) > threshold


def with_copies(df: DataFrame, *columns: str) -> DataFrame:
    """Equal rows as one row with their number in `copies`, so that a hot key crosses the shuffle once per task."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"))


# Equal rows held by one row while a hot group is taken apart again.
COPIES_PER_ROW = 1000


def split_copies(df: DataFrame) -> DataFrame:
    """Rows with many copies as several rows (`piece`) of at most COPIES_PER_ROW copies each."""
    last = F.expr(f"(copies - 1) div {COPIES_PER_ROW}")
    pieces = df.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    left = F.col("copies") - F.col("piece") * COPIES_PER_ROW
    return pieces.withColumn("copies", F.least(left, F.lit(COPIES_PER_ROW)))


def repeat_copies(df: DataFrame, *columns: str) -> DataFrame:
    """Undo `with_copies`: as many equal rows as `copies` says. Keeps the order of the rows."""
    rows = df.select(*columns, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("_copy"))
    return rows.drop("_copy")
