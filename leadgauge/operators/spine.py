"""The scored accounts and their business e-mail flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadgauge.config import ScorecardConfig
from leadgauge.functions.text import email_domain, sql_literal
from leadgauge.functions.window import AsOf, Clock


def spine(account: DataFrame, as_of: AsOf, config: ScorecardConfig) -> DataFrame:
    """Free-plan accounts with a usable e-mail, signed up since the start date."""
    clock = Clock(account, "created_at", as_of, config.window_months)
    return account.filter(
        (F.col("plan_id") == config.free_plan_id)
        & ~F.col("email").like(config.excluded_email)
        & clock.between(config.signed_up_from)
    ).select(F.col("id").alias("account_id"), "email")


def personal_domain(config: ScorecardConfig) -> Column:
    domains = ", ".join(sql_literal(domain) for domain in config.all_personal_domains())
    return F.expr(f"split_part(email, '@', 2) in ({domains})")


def personal_emails(account: DataFrame, config: ScorecardConfig) -> DataFrame:
    """All accounts, of any plan and age, with an e-mail at a personal domain."""
    return account.filter(personal_domain(config)).select(
        F.col("id").alias("account_id"), "email", email_domain(F.col("email")).alias("domain")
    )


def business_flag(accounts: DataFrame, config: ScorecardConfig) -> DataFrame:
    """`bus_email_flag` 0 for personal domains, 1 for all others.

    Decided from the account's own e-mail, so that a filter on the flag reaches the account scan.
    """
    flag = F.when(personal_domain(config), 0).otherwise(1)
    return accounts.withColumn("bus_email_flag", flag)
