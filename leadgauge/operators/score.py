"""Weights, total and the score key."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadgauge.config import ScorecardConfig

ACCOUNT_COLUMNS = ("account_id", "bus_email_flag", "email", "FTC")


def weighted(events: DataFrame, config: ScorecardConfig, *extra: str) -> DataFrame:
    """Each feature times its weight, and their sum as `total`."""
    points = {f.name: F.col(f.name) * f.weight if f.weight != 1 else F.col(f.name) for f in config.features}
    return events.select(
        *ACCOUNT_COLUMNS,
        *(column.alias(name) for name, column in points.items()),
        reduce(add, points.values()).alias("total"),
        *extra,
    )


def score_key(spark: SparkSession, config: ScorecardConfig) -> DataFrame:
    """The highest score of each column: cap x weight, and their sum."""
    maxima = [(f.name, f.cap * f.weight) for f in config.features]
    maxima.append(("total", sum(points for _, points in maxima)))
    return spark.createDataFrame(maxima, "Event_Name string, Maximum_Score int")
