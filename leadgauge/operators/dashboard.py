"""Days with a dashboard page view before the paid signup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadgauge.config import ScorecardConfig
from leadgauge.functions.measure import capped
from leadgauge.functions.text import int_key, is_numeric
from leadgauge.functions.window import AsOf, in_window

DAYS = "dashboard_daily_pageviews"


def dashboard_days(
    page_view: DataFrame, paid_signup: DataFrame, as_of: AsOf, config: ScorecardConfig
) -> DataFrame:
    """Active days per text account id.

    A view counts when it lies before the account's latest signup, when a signup has no time, or when there is none.
    A day has such a view exactly when its earliest view is one, so views shrink to one row per account and day
    before they meet the signups, and signups to one row per account.
    """
    views = page_view.filter(
        in_window(page_view, "created_at", as_of, config.window_months)
        & F.col("url").like(config.dashboard_url)
        & ~F.col("url").like(config.dashboard_url_excluded)
        & is_numeric(F.col("account_id"))
    ).withColumn("account_id", F.col("account_id").cast("string"))
    days = views.groupBy("account_id", F.to_date("created_at").alias("day")).agg(
        F.min("created_at").alias("first_view")
    )
    signups = (
        paid_signup.select(F.col("account_id").cast("string"), F.col("created_at").alias("signup"))
        .filter("account_id is not null")
        .groupBy("account_id")
        .agg(F.max("signup").alias("last_signup"), F.max(F.col("signup").isNull()).alias("undated"))
    )
    before_signup = (
        F.col("last_signup").isNull() | (F.col("first_view") < F.col("last_signup")) | F.col("undated")
    )
    return (
        days.join(signups, "account_id", "left")
        .filter(before_signup)
        .groupBy("account_id")
        .agg(F.count("day").alias(DAYS))
    )


def dashboard_capped(days: DataFrame, config: ScorecardConfig) -> DataFrame:
    return days.withColumn(DAYS, capped(F.col(DAYS), config.cap(DAYS)))


def dashboard_by_number(days: DataFrame) -> DataFrame:
    """Keyed by account number; ids that are no whole number are dropped, '7' and '07' stay two rows."""
    return days.select(int_key(F.col("account_id")).alias("account_id"), DAYS).filter("account_id is not null")
