"""Engagement frequency reported for the last month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadgauge.config import ScorecardConfig
from leadgauge.functions.measure import capped
from leadgauge.functions.window import AsOf, in_window

FREQUENCY = "engagement_frequency"


def engagement(user_engagement: DataFrame, as_of: AsOf, config: ScorecardConfig) -> DataFrame:
    """All rows of the window; an account with several of them is scored several times."""
    return user_engagement.filter(in_window(user_engagement, "month", as_of, config.window_months)).select(
        "account_id", FREQUENCY
    )


def engagement_capped(rows: DataFrame, config: ScorecardConfig) -> DataFrame:
    return rows.withColumn(FREQUENCY, capped(F.col(FREQUENCY), config.cap(FREQUENCY)))
