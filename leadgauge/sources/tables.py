"""Readers for the input tables.

Every operator takes its tables from a mapping `role -> DataFrame`; the readers here only differ in how they fill it.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Sources = Mapping[str, DataFrame]

# Role -> columns used.
ROLES: dict[str, tuple[str, ...]] = {
    "account": ("id", "plan_id", "email", "created_at"),
    "page_view": ("account_id", "created_at", "url"),
    "paid_signup": ("account_id", "created_at"),
    "user_engagement": ("account_id", "engagement_frequency", "month"),
    "app_created": (
        "account_id", "app_name", "backend_tech", "frontend_tech", "multiple_environments", "created_at",
    ),
    "daily_logs": ("account_id", "app_id", "created_at", "max_connections", "all_messages"),
    "app_collaborator_added": ("account_id", "collaborator_email", "created_at"),
    "channels": ("id", "created_at", "heroku"),
    "splash_page_views": ("id", "account_id", "web_asset", "user_agent", "url", "created_at"),
    "web_sessions": ("account_id", "session_created_at", "account_created_at"),
    "first_touch": ("account_id", "url", "referrer"),
    "connections_soft_limit": ("account_id", "created_at"),
    "messages_soft_limit": ("account_id", "created_at"),
}

# Tables whose names carry a generated prefix: (name LIKE, name NOT LIKE).
SCRATCH_NAMES = {
    "user_engagement": ("%user_engagement", None),
    "channels": ("%channels", None),
    "first_touch": ("%first_touch", "%elements_first_touch"),
    "splash_page_views": ("%splash_page_views", None),
    "web_sessions": ("%web_sessions", "%elements_web_sessions"),
}


class Split(NamedTuple):
    """How a JDBC table is cut into parallel reads."""

    column: str
    lower: int | str
    upper: int | str
    partitions: int


def from_parquet(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """One Parquet folder or file per role: `<directory>/<role>.parquet`."""
    return {role: spark.read.parquet(f"{directory}/{role}.parquet") for role in ROLES}


def resolve_table(spark: SparkSession, database: str, like: str, not_like: str | None = None) -> str:
    """The first table of the database, by name, whose name fits `like` and not `not_like`."""
    names = spark.sql(f"SHOW TABLES IN `{database}`").filter(F.col("tableName").like(like))
    if not_like is not None:
        names = names.filter(~F.col("tableName").like(not_like))
    found = names.orderBy("tableName").select("tableName").first()
    if found is None:
        raise LookupError(f"no table like {like!r} in {database!r}")
    return f"`{database}`.`{found.tableName}`"


def from_catalog(
    spark: SparkSession,
    database: str = "default",
    scratch_database: str | None = None,
    tables: Mapping[str, str] | None = None,
) -> dict[str, DataFrame]:
    """Catalog tables: scratch roles by name pattern, the rest by name; `tables` gives the names of single roles.

    Tables with generated prefixes are looked for in `scratch_database`, by default where the others are.
    """

    def name(role: str) -> str:
        if tables and role in tables:
            return tables[role]
        if role in SCRATCH_NAMES:
            return resolve_table(spark, scratch_database or database, *SCRATCH_NAMES[role])
        return f"`{database}`.`{role}`"

    return {role: spark.table(name(role)) for role in ROLES}


def from_jdbc(
    spark: SparkSession,
    url: str,
    tables: Mapping[str, str],
    splits: Mapping[str, Split],
    properties: Mapping[str, str] | None = None,
) -> dict[str, DataFrame]:
    """Tables of a relational warehouse. Each needs a `Split`, for no table may come through a single task."""
    missing = sorted(set(tables) - set(splits))
    if missing:
        raise ValueError(f"no split given for {', '.join(missing)}")

    def read(role: str) -> DataFrame:
        split = splits[role]
        return spark.read.jdbc(
            url,
            tables[role],
            column=split.column,
            lowerBound=split.lower,
            upperBound=split.upper,
            numPartitions=split.partitions,
            properties=dict(properties or {}),
        )

    return {role: read(role) for role in tables}
