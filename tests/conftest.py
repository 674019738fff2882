from __future__ import annotations

import sys
from collections import Counter
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from leadgauge import ScorecardConfig  # noqa: E402

AS_OF = "2024-01-20 12:00:00"

# Addresses the default patterns look for.
_DEFAULTS = ScorecardConfig()
DASHBOARD = f"https://{_DEFAULTS.dashboard_url.strip('%')}/apps"
EXCLUDED = f"https://{_DEFAULTS.dashboard_url_excluded.strip('%')}/1"
BOT = _DEFAULTS.bot_agent
_SITE = _DEFAULTS.own_site
GROWTH, BLOG, OWN_SITE = f"https://growth.{_SITE}/a", f"https://blog.{_SITE}/a", f"https://{_SITE}/a"

SCHEMAS = {
    "account": "id int, plan_id int, email string, created_at timestamp_ntz",
    "page_view": "account_id string, created_at timestamp_ntz, url string",
    "paid_signup": "account_id int, created_at timestamp_ntz",
    "user_engagement": "account_id int, engagement_frequency int, month timestamp_ntz",
    "app_created": (
        "account_id int, app_name string, backend_tech string, frontend_tech string, multiple_environments string,"
        " created_at timestamp_ntz"
    ),
    "daily_logs": (
        "account_id int, app_id bigint, created_at timestamp_ntz, max_connections bigint, all_messages bigint"
    ),
    "app_collaborator_added": "account_id int, collaborator_email string, created_at timestamp_ntz",
    "channels": "id int, created_at timestamp_ntz, heroku boolean",
    "splash_page_views": (
        "id bigint, account_id string, web_asset string, user_agent string, url string, created_at timestamp_ntz"
    ),
    "web_sessions": "account_id int, session_created_at timestamp_ntz, account_created_at timestamp_ntz",
    "first_touch": "account_id string, url string, referrer string",
    "connections_soft_limit": "account_id int, created_at timestamp_ntz",
    "messages_soft_limit": "account_id int, created_at timestamp_ntz",
}


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.driver.memory", "4g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def config() -> ScorecardConfig:
    return ScorecardConfig(name_adjectives=("happy", "brave", "and"))


@pytest.fixture(scope="session")
def table(spark):
    """Make a role's table from tuples; timestamps may be given as text."""

    def parsed(value, kind: str):
        return datetime.fromisoformat(value) if value is not None and kind == "timestamp_ntz" else value

    def make(role: str, *rows: tuple) -> DataFrame:
        kinds = [column.strip().split(" ")[1] for column in SCHEMAS[role].split(",")]
        typed = [tuple(parsed(v, k) for v, k in zip(row, kinds, strict=True)) for row in rows]
        return spark.createDataFrame(typed, SCHEMAS[role])

    return make


def bag(df: DataFrame) -> Counter:
    return Counter(tuple(row) for row in df.collect())


def mapping(df: DataFrame) -> dict:
    """A two-column result with unique keys as a dict."""
    rows = [tuple(row) for row in df.collect()]
    assert len({key for key, _ in rows}) == len(rows)
    return dict(rows)
