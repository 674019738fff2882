"""Tutorial and docs page views of recently created accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadgauge.config import ScorecardConfig
from leadgauge.functions.measure import distinct_over, flag
from leadgauge.functions.window import AsOf, Clock
from leadgauge.sources import Sources

TUTORIALS = "tutorial_views"
DOCS = "docs_page_views"
CONTENT = "tut_doc_pv"


def is_tutorial(config: ScorecardConfig) -> Column:
    return F.col("web_asset") == config.tutorial_asset


def is_docs(config: ScorecardConfig) -> Column:
    """The URL without trailing slashes is like the docs pattern.

    They are only taken off where they can decide: an open-ended pattern without slash or `_` fits with them as well.
    """
    pattern, url = config.docs_url, F.col("url")
    open_ended = pattern.endswith("%") and not set(pattern) & set("/_\\")
    return (url if open_ended else F.rtrim(url, F.lit("/"))).like(pattern)


def human_views(sources: Sources, as_of: AsOf, config: ScorecardConfig) -> DataFrame:
    """Views by a known agent that is not the bot, up to the end of the day, with a usable account number.

    The number has the type of the channels' ids: one that does not fit it can have no channels row.
    """
    views, id_type = sources["splash_page_views"], sources["channels"].schema["id"].dataType
    clock = Clock(views, "created_at", as_of, config.window_months)
    return (
        views.filter((F.col("user_agent") != config.bot_agent) & (F.col("created_at") < clock.tomorrow))
        .withColumn("account_id", F.col("account_id").try_cast(id_type))
        .filter("account_id is not null")
    )


def session_state(web_sessions: DataFrame) -> DataFrame:
    """One row per account with sessions: did one begin before the account's creation, or lack a creation time?

    The views of an account count if so, or if it has no sessions at all. With one row per account the views are
    never multiplied by sessions.
    """
    unblocks = F.col("account_created_at").isNull() | F.coalesce(
        F.col("session_created_at") < F.col("account_created_at"), F.lit(False)
    )
    return (
        web_sessions.filter("account_id is not null")
        .groupBy("account_id")
        .agg(F.max(unblocks).alias("unblocked"))
    )


def recent_channels(channels: DataFrame, as_of: AsOf, config: ScorecardConfig) -> DataFrame:
    """Accounts with a channels row since midnight a month ago, each once.

    `before_today` tells whether one of the rows was also created before the day of `as_of`.
    """
    clock = Clock(channels, "created_at", as_of, config.window_months)
    recent = (F.col("created_at") >= clock.month_ago_midnight) & (F.col("created_at") < clock.now)
    return (
        channels.filter(recent)
        .groupBy(F.col("id").alias("account_id"))
        .agg(F.max(F.col("created_at") < clock.today).alias("before_today"))
    )


def eligible_accounts(sources: Sources, as_of: AsOf, config: ScorecardConfig) -> DataFrame:
    """(account_id, before_today) of the recent accounts whose sessions do not rule their views out, each once."""
    recent = recent_channels(sources["channels"], as_of, config).filter("account_id is not null")
    joined = recent.join(session_state(sources["web_sessions"]), "account_id", "left")
    return joined.filter(F.coalesce("unblocked", F.lit(True))).select("account_id", "before_today")


def of_eligible_accounts(per_account: DataFrame, sources: Sources, as_of: AsOf, config: ScorecardConfig) -> DataFrame:
    """Keep the rows of eligible accounts.

    The account id is taken from the left side: a runtime filter that Spark derives from the scored accounts then prunes
    the scan of the views, by far the largest of the three, and a hot account of the views can be split.
    """
    return per_account.join(eligible_accounts(sources, as_of, config), "account_id")


def tutorial_views(sources: Sources, as_of: AsOf, config: ScorecardConfig) -> DataFrame:
    """Distinct tutorial views of accounts created before today; 0 when an account has only other views.

    Views of all time meet the few eligible accounts before they are counted, so the count shuffles only theirs.
    """
    views = human_views(sources, as_of, config)
    views = views.select("account_id", F.when(is_tutorial(config), F.col("id")).alias("id"))
    kept = of_eligible_accounts(views, sources, as_of, config).filter("before_today")
    return kept.groupBy("account_id").agg(F.count_distinct("id").alias(TUTORIALS))


def docs_views(sources: Sources, as_of: AsOf, config: ScorecardConfig) -> DataFrame:
    """Distinct docs views of accounts created before `as_of`, counted after the join like tutorial views."""
    views = human_views(sources, as_of, config).filter(is_docs(config)).select("account_id", "id")
    kept = of_eligible_accounts(views, sources, as_of, config)
    return kept.groupBy("account_id").agg(F.count_distinct("id").alias(DOCS))


def content_flag(counted: DataFrame, config: ScorecardConfig) -> DataFrame:
    """1 for enough tutorial views or enough docs views."""
    enough = (F.col(TUTORIALS) > config.tutorials_over) | (F.col(DOCS) > config.docs_over)
    return counted.withColumn(CONTENT, flag(enough)).drop(TUTORIALS, DOCS)


def content_accounts(sources: Sources, as_of: AsOf, config: ScorecardConfig) -> DataFrame:
    """The accounts whose content flag is 1, from one scan of the views.

    Same result as counting tutorials and docs apart, but the views leave their scan as one row per account and
    task, whatever an account's share of them.
    """
    tutorial, docs = is_tutorial(config), is_docs(config)
    seen = (
        human_views(sources, as_of, config)
        .filter(tutorial | docs)
        .groupBy("account_id")
        .agg(
            distinct_over(F.when(tutorial, F.col("id")), config.tutorials_over).alias("tutorials"),
            distinct_over(F.when(docs, F.col("id")), config.docs_over).alias("docs"),
        )
        .filter("tutorials or docs")
    )
    return (
        of_eligible_accounts(seen, sources, as_of, config)
        .filter("docs or (tutorials and before_today)")
        .select("account_id", F.lit(1).alias(CONTENT))
    )
