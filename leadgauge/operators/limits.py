"""Did the account hit a soft limit?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadgauge.config import ScorecardConfig
from leadgauge.functions.measure import flag
from leadgauge.functions.window import AsOf, in_window

LIMIT = "hit_soft_limit"


def limit_hits(soft_limit: DataFrame, as_of: AsOf, config: ScorecardConfig) -> DataFrame:
    return soft_limit.filter(in_window(soft_limit, "created_at", as_of, config.window_months)).select("account_id")


def limit_accounts(soft_limit: DataFrame, as_of: AsOf, config: ScorecardConfig) -> DataFrame:
    """Accounts that hit the limit in the window, each once."""
    return limit_hits(soft_limit, as_of, config).distinct()


def limit_flag(flagged: DataFrame, config: ScorecardConfig) -> DataFrame:
    """One flag from the connection flag and the message flag, each 0 or 1.

    With the default threshold of 1 a message flag can never exceed it, so messages alone do not count.
    """
    over = (F.col("con_soft_limit_flag") > config.connection_limit_over) | (
        F.col("mes_soft_limit_flag") > config.message_limit_over
    )
    return flagged.withColumn(LIMIT, flag(over)).drop("con_soft_limit_flag", "mes_soft_limit_flag")


def limit_rows(
    connections: DataFrame, messages: DataFrame, as_of: AsOf, config: ScorecardConfig
) -> list[DataFrame]:
    """One row per hit of a limit that can set the flag; the other limit's table is not read."""
    tables = [(connections, config.connection_limit_over), (messages, config.message_limit_over)]
    return [
        limit_hits(table, as_of, config).withColumn(LIMIT, F.lit(1))
        for table, threshold in tables
        if threshold < 1
    ]
