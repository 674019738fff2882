"""Did the account invite anyone to its apps?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadgauge.config import ScorecardConfig
from leadgauge.functions.measure import flag
from leadgauge.functions.window import AsOf, in_window

COLLABORATORS = "collaborators"


def added(app_collaborator_added: DataFrame, as_of: AsOf, config: ScorecardConfig) -> DataFrame:
    return app_collaborator_added.filter(
        in_window(app_collaborator_added, "created_at", as_of, config.window_months)
    )


def collaborators(app_collaborator_added: DataFrame, as_of: AsOf, config: ScorecardConfig) -> DataFrame:
    """Distinct invited e-mails per account."""
    invited = F.count_distinct("collaborator_email")
    rows = added(app_collaborator_added, as_of, config)
    return rows.groupBy("account_id").agg(invited.alias(COLLABORATORS))


def collaborator_flag(counts: DataFrame) -> DataFrame:
    return counts.withColumn(COLLABORATORS, flag(F.col(COLLABORATORS) > 0))


def collaborator_rows(app_collaborator_added: DataFrame, as_of: AsOf, config: ScorecardConfig) -> DataFrame:
    """One row per invitation; for the flag it is enough that one has an e-mail."""
    rows = added(app_collaborator_added, as_of, config)
    return rows.select("account_id", flag(F.col("collaborator_email").isNotNull()).alias(COLLABORATORS))
