"""Features of the apps an account created and ran."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadgauge.config import ScorecardConfig
from leadgauge.functions.measure import capped, flag
from leadgauge.functions.text import has_word, name_part
from leadgauge.functions.window import AsOf, in_window

NAMED = "number_of_named_apps"
TECH = "tech_info"
ENVIRONMENTS = "multiple_env_flag"
ACTIVE = "active_app"


def generated_name(name: Column, config: ScorecardConfig) -> Column:
    """Does the name look like the generator's adjective-noun-x? Words count anywhere inside their part."""
    if not config.name_adjectives:
        raise ValueError("ScorecardConfig.name_adjectives must hold the generator's adjectives")
    noun = has_word(name_part(name, 2), config.name_nouns)
    return noun & has_word(name_part(name, 1), config.name_adjectives)


def is_named(config: ScorecardConfig) -> Column:
    """1 unless the name is a generated one; an app without a name counts as named."""
    return F.when(generated_name(F.col("app_name"), config), 0).otherwise(1)


def knows(technology: str, config: ScorecardConfig) -> Column:
    return flag(F.col(technology) != config.unknown_tech)


def tech_score(config: ScorecardConfig) -> Column:
    """0..2: is the back end known, is the front end known, of one app."""
    return knows("backend_tech", config) + knows("frontend_tech", config)


def has_environments() -> Column:
    return flag(F.col("multiple_environments").isNotNull())


def created(app_created: DataFrame, as_of: AsOf, config: ScorecardConfig) -> DataFrame:
    return app_created.filter(in_window(app_created, "created_at", as_of, config.window_months))


def created_rows(app_created: DataFrame, as_of: AsOf, config: ScorecardConfig) -> DataFrame:
    """What each created app adds to its account's three features, from one scan."""
    return created(app_created, as_of, config).select(
        "account_id",
        is_named(config).alias(NAMED),
        tech_score(config).alias(TECH),
        has_environments().alias(ENVIRONMENTS),
    )


def named_apps(app_created: DataFrame, as_of: AsOf, config: ScorecardConfig) -> DataFrame:
    apps = created(app_created, as_of, config)
    return apps.groupBy("account_id").agg(F.sum(is_named(config)).alias(NAMED))


def named_apps_capped(counts: DataFrame, config: ScorecardConfig) -> DataFrame:
    return counts.withColumn(NAMED, capped(F.col(NAMED), config.cap(NAMED)))


def tech_flags(app_created: DataFrame, as_of: AsOf, config: ScorecardConfig) -> DataFrame:
    """The combinations of known back end and known front end that an account's apps show."""
    back, front = F.col("backend_tech"), F.col("frontend_tech")
    none = F.lit(config.unknown_tech)
    nothing = (back.isNull() & front.isNull()) | ((back == none) & (front == none))
    return (
        created(app_created, as_of, config)
        .select(
            "account_id",
            knows("backend_tech", config).alias("backend_tech"),
            knows("frontend_tech", config).alias("frontend_tech"),
            F.when(nothing, 0).otherwise(1).alias(TECH),
        )
        .groupBy("account_id", "backend_tech", "frontend_tech")
        .agg(F.max(TECH).alias(TECH))
    )


def tech_info(app_created: DataFrame, as_of: AsOf, config: ScorecardConfig) -> DataFrame:
    """Best score of one app; two apps that each know one side do not add up."""
    apps = created(app_created, as_of, config)
    return apps.groupBy("account_id").agg(F.max(tech_score(config)).alias(TECH))


def multiple_environments(app_created: DataFrame, as_of: AsOf, config: ScorecardConfig) -> DataFrame:
    apps = created(app_created, as_of, config)
    return apps.groupBy("account_id").agg(F.max(has_environments()).alias(ENVIRONMENTS))


def active_days(daily_logs: DataFrame, as_of: AsOf, config: ScorecardConfig) -> DataFrame:
    """Days on which an app had both enough connections and enough messages."""
    return daily_logs.filter(
        (F.col("max_connections") >= config.active_connections)
        & (F.col("all_messages") >= config.active_messages)
        & in_window(daily_logs, "created_at", as_of, config.window_months)
    )


def active_apps(daily_logs: DataFrame, as_of: AsOf, config: ScorecardConfig) -> DataFrame:
    days = active_days(daily_logs, as_of, config)
    return days.groupBy("account_id").agg(F.count_distinct("app_id").alias("number_of_active_apps"))


def active_app(apps: DataFrame) -> DataFrame:
    return apps.select("account_id", flag(F.col("number_of_active_apps") > 0).alias(ACTIVE))


def active_rows(daily_logs: DataFrame, as_of: AsOf, config: ScorecardConfig) -> DataFrame:
    """One row per active day; for the flag it is enough that one names its app."""
    days = active_days(daily_logs, as_of, config)
    return days.select("account_id", flag(F.col("app_id").isNotNull()).alias(ACTIVE))
