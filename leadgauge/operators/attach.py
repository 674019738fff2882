"""Left joins of one feature to the accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadgauge.functions.measure import repeat_copies, split_copies, with_copies


def attach(accounts: DataFrame, feature: DataFrame, column: str, default: int | str) -> DataFrame:
    """Every account with the feature's `column`, or `default` where it has no row or NULL.

    Several feature rows of one account give several rows.
    """
    joined = accounts.join(feature.select("account_id", column), "account_id", "left")
    return joined.withColumn(column, F.coalesce(column, F.lit(default)))


def attach_repeated(accounts: DataFrame, feature: DataFrame, column: str, default: int | str) -> DataFrame:
    """Like `attach`, for a feature of many equal rows: they meet the accounts as one row with their number and are
    written out after that, spread over tasks."""
    held = with_copies(feature.filter("account_id is not null"), "account_id", column)
    joined = accounts.join(held, "account_id", "left")
    joined = joined.withColumns({column: F.coalesce(column, F.lit(default)), "copies": F.coalesce("copies", F.lit(1))})
    return repeat_copies(split_copies(joined).hint("rebalance"), *accounts.columns, column)


def attach_membership(accounts: DataFrame, members: DataFrame, column: str) -> DataFrame:
    """Every account with 1 in `column` when it is one of the (distinct) members, else 0."""
    return attach(accounts, members.select("account_id", F.lit(1).alias(column)), column, 0)
