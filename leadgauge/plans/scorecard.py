"""The whole scorecard as one plan.

Features that are sums or maxima over events are grouped together: the event rows of all their tables are stacked and
grouped once, which takes one shuffle of map-side combined rows where a join per feature would take one each. Every
other branch arrives at its join as a few rows per account. No branch is broadcast by hand; Spark broadcasts a side
only below `spark.sql.autoBroadcastJoinThreshold`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadgauge.config import ScorecardConfig
from leadgauge.functions.measure import capped, repeat_copies, split_copies, with_copies
from leadgauge.functions.window import AsOf
from leadgauge.operators import apps, channel, collaborators, content, dashboard, engagement, limits, score, spine
from leadgauge.sources import Sources

EVENT_COLUMNS = ("account_id", "bus_email_flag", "email")


def grouped_features(sources: Sources, as_of: AsOf, config: ScorecardConfig, with_channel: bool) -> DataFrame:
    """Apps, activity, collaborators, limits and channel sets of each account with any of them."""
    rows = [
        apps.created_rows(sources["app_created"], as_of, config),
        apps.active_rows(sources["daily_logs"], as_of, config),
        collaborators.collaborator_rows(sources["app_collaborator_added"], as_of, config),
        *limits.limit_rows(
            sources["connections_soft_limit"], sources["messages_soft_limit"], as_of, config
        ),
        *(channel.channel_set_rows(sources["channels"], sources["first_touch"], config) if with_channel else []),
    ]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    combine = {apps.NAMED: F.sum}
    return (
        stacked.filter("account_id is not null")
        .groupBy("account_id")
        .agg(*(combine.get(c, F.max)(c).alias(c) for c in stacked.columns if c != "account_id"))
        .transform(apps.named_apps_capped, config)
    )


def _counted_events(
    sources: Sources, as_of: AsOf, config: ScorecardConfig, with_channel: bool
) -> DataFrame:
    """Unweighted features of every scored account; equal engagement rows are kept as `copies`."""
    accounts = spine.business_flag(spine.spine(sources["account"], as_of, config), config)
    days = dashboard.dashboard_capped(
        dashboard.dashboard_days(sources["page_view"], sources["paid_signup"], as_of, config), config
    )
    frequency = engagement.engagement_capped(
        engagement.engagement(sources["user_engagement"], as_of, config), config
    ).filter("account_id is not null")
    grouped = grouped_features(sources, as_of, config, with_channel)
    if limits.LIMIT not in grouped.columns:
        grouped = grouped.withColumn(limits.LIMIT, F.lit(0))

    joined = (
        accounts.join(dashboard.dashboard_by_number(days), "account_id", "left")
        .join(with_copies(frequency, "account_id", engagement.FREQUENCY), "account_id", "left")
        .join(grouped, "account_id", "left")
        .join(content.content_accounts(sources, as_of, config), "account_id", "left")
    )
    columns = [F.coalesce(f.name, F.lit(0)).alias(f.name) for f in config.features]
    columns.append(F.coalesce("copies", F.lit(1)).alias("copies"))
    if with_channel:
        columns.append(F.explode_outer(channel.channels_of_set(config)).alias("FTC"))
    events = joined.select(*EVENT_COLUMNS, *columns)
    return events.fillna(config.default_channel, ["FTC"]) if with_channel else events


def counted_scorecard(sources: Sources, as_of: AsOf, config: ScorecardConfig) -> DataFrame:
    """The weighted scorecard with equal rows held together: `piece` and `copies` beside the report columns."""
    events = _counted_events(sources, as_of, config, with_channel=True)
    return split_copies(score.weighted(events, config, "copies"))


def _repeated(counted: DataFrame) -> DataFrame:
    """All rows, the copies of a hot account spread over tasks before they are written out."""
    columns = [c for c in counted.columns if c not in ("piece", "copies")]
    return repeat_copies(counted.hint("rebalance"), *columns)


def scorecard_events(sources: Sources, as_of: AsOf, config: ScorecardConfig) -> DataFrame:
    """Features of every scored account, before channel and weights."""
    return _repeated(split_copies(_counted_events(sources, as_of, config, with_channel=False)))


def scorecard_events_with_channel(sources: Sources, as_of: AsOf, config: ScorecardConfig) -> DataFrame:
    """Features and channel; an account with several channels is scored once for each."""
    return _repeated(split_copies(_counted_events(sources, as_of, config, with_channel=True)))


def weighted_scorecard(sources: Sources, as_of: AsOf, config: ScorecardConfig) -> DataFrame:
    """Report columns of every scored account with its total of 0..50."""
    return _repeated(counted_scorecard(sources, as_of, config))
