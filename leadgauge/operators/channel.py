"""First-touch marketing channel of an account.

An account's set of channels is kept as one boolean column for each channel name: combining the sets of any number of
rows is a maximum of each, done map-side before the only shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadgauge.config import PAID_MARKETING, Rule, ScorecardConfig, live_rules
from leadgauge.functions.measure import repeat_copies, split_copies, with_copies
from leadgauge.functions.text import first_rule, int_key, like_sql, sql_literal

CHANNEL = "first_touch_channel"

def touch_rules(config: ScorecardConfig) -> list[Rule]:
    """Rules that name a channel for what a mail, an ad or a referring site left behind, in order."""
    return live_rules(config.first_touch_rules())


def touch_labels(config: ScorecardConfig) -> list[str]:
    fallbacks = [config.other_channel, config.untracked_channel, config.default_channel]
    return list(dict.fromkeys([PAID_MARKETING, *(rule.label for rule in touch_rules(config)), *fallbacks]))


def touch_channel(config: ScorecardConfig) -> Column:
    """Channel of one first touch from its `medium`, `url` and `referrer`: a paid medium, else the first rule that holds."""
    paid = F.col("medium").isin([medium.upper() for medium in config.paid_mediums])
    fallback = (
        F.when(F.col("referrer").isNotNull() | F.expr(like_sql("url", config.tagged_url)), config.other_channel)
        .when(F.col("url").isNull(), config.untracked_channel)
        .otherwise(config.default_channel)
    )
    return F.when(paid, PAID_MARKETING).otherwise(F.coalesce(first_rule(touch_rules(config), str), fallback))


def touches(first_touch: DataFrame) -> DataFrame:
    """First touches by account number with what the rules look at; most URLs name no medium and are not split."""
    key = "utm_medium="
    after_key = F.split_part("url", F.lit(key), F.lit(2))
    medium = F.upper(F.split_part(after_key, F.lit("&"), F.lit(1)))
    return first_touch.select(
        int_key(F.col("account_id")).alias("account_id"),
        F.when(F.col("url").contains(key), medium).alias("medium"),
        "url",
        "referrer",
    )


def channel_accounts(channels: DataFrame) -> DataFrame:
    return channels.select(
        F.col("id").alias("account_id"), F.coalesce(F.col("heroku"), F.lit(False)).alias("heroku")
    )


def first_touch_rows(channels: DataFrame, first_touch: DataFrame, config: ScorecardConfig) -> DataFrame:
    """Every channels row with each of its first touches, and touches of no channels row with a NULL account.

    Both sides are reduced to distinct rows with their number before they meet, so neither touches without account
    nor a hot account travel row by row.
    """
    left = with_copies(channel_accounts(channels), "account_id", "heroku").withColumnRenamed("copies", "left_copies")
    labelled_touches = touches(first_touch).select("account_id", touch_channel(config).alias("touch"))
    right = with_copies(labelled_touches, "account_id", "touch").withColumnRenamed("copies", "right_copies")
    joined = left.withColumn("found", F.col("account_id")).join(right, "account_id", "full_outer")
    label = F.when(F.col("heroku"), config.heroku_channel).otherwise(
        F.coalesce("touch", F.lit(config.untracked_channel))
    )
    labelled = joined.select(
        F.col("found").alias("account_id"),
        label.alias(CHANNEL),
        (F.coalesce("left_copies", F.lit(1)) * F.coalesce("right_copies", F.lit(1))).alias("copies"),
    )
    return repeat_copies(split_copies(labelled).hint("rebalance"), "account_id", CHANNEL)


def set_columns(config: ScorecardConfig) -> list[str]:
    """Boolean columns of an account's set: hosted or other channels rows, then one for each label of a touch."""
    return ["_hosted", "_plain", *(f"_touch_{n}" for n in range(len(touch_labels(config))))]


def channel_set_rows(channels: DataFrame, first_touch: DataFrame, config: ScorecardConfig) -> list[DataFrame]:
    """What each channels row and each first touch adds to its account's set.

    A touch's number has the type of the channels' ids; one that does not fit it can have no channels row.
    """
    hosted, plain, *touched = set_columns(config)
    account = F.col("account_id").try_cast(channels.schema["id"].dataType).alias("account_id")
    labelled = touches(first_touch).select(account, touch_channel(config).alias("label"))
    labels = zip(touched, touch_labels(config))
    return [
        channel_accounts(channels).select("account_id", F.col("heroku").alias(hosted), (~F.col("heroku")).alias(plain)),
        labelled.select("account_id", *((F.col("label") == label).alias(name) for name, label in labels)),
    ]


def channels_of_set(config: ScorecardConfig) -> Column:
    """The channel names behind an account's set; empty without a channels row.

    The hosting partner's accounts have its channel, other accounts those of their touches, or the untracked one if
    they have none.
    """
    hosted, plain, *touched = set_columns(config)

    def has(name: str) -> Column:
        return F.coalesce(name, F.lit(False))

    any_touch = F.lit(False)
    names = []
    for name, label in zip(touched, touch_labels(config)):
        any_touch = any_touch | has(name)
        names.append(F.when(has(plain) & has(name), F.lit(label)))
    names = [F.when(has(hosted), F.lit(config.heroku_channel)), *names]
    names.append(F.when(has(plain) & ~any_touch, F.lit(config.untracked_channel)))
    return F.array_distinct(F.array_compact(F.array(*names)))


def first_touch_channels(channels: DataFrame, first_touch: DataFrame, config: ScorecardConfig) -> DataFrame:
    """The distinct channels of each account; several channels rows or touches can give several.

    Touches of no channels row, and all rows without id, belong to the NULL account: a channels row without id has no
    touches, a touch of no channels row keeps its own channel.
    """
    rows, touch_rows = channel_set_rows(channels, first_touch, config)
    stacked = rows.unionByName(touch_rows, allowMissingColumns=True)
    columns = set_columns(config)
    hosted, plain, *touched = columns
    sets = stacked.groupBy("account_id").agg(*(F.max(c).alias(c) for c in columns))
    known = F.col("account_id").isNotNull() & F.coalesce(F.col(hosted) | F.col(plain), F.lit(False))
    lone = sets.withColumns(
        {
            "labels": F.array_compact(
                F.array(
                    *(F.when(F.col(c), F.lit(label)) for c, label in zip(touched, touch_labels(config))),
                    F.when(F.col(hosted), F.lit(config.heroku_channel)),
                    F.when(F.col(plain), F.lit(config.untracked_channel)),
                )
            ),
            "known": known,
        }
    )
    listed = lone.withColumn("labels", F.when(F.col("known"), channels_of_set(config)).otherwise(F.col("labels")))
    account = F.when(F.col("known"), F.col("account_id")).alias("account_id")
    named = listed.select(account, F.explode("labels").alias(CHANNEL))
    # Accounts of channels rows have distinct channels by now; what is left over meets in few (NULL, channel) rows.
    return named.distinct()
