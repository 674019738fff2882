"""The physical plans keep the properties the design relies on at scale."""

from __future__ import annotations

import re

import pytest
from conftest import AS_OF

from leadgauge import sheet
from leadgauge.operators import channel, content
from leadgauge.plans.scorecard import grouped_features
from leadgauge.sources import from_parquet
from testtables.roles import CONFIG, ROLE_SQL, SparkRoles


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The roles as Parquet tables, planned without broadcasts as large tables would be."""
    directory = tmp_path_factory.mktemp("roles")
    roles = SparkRoles(spark, "/root/testdata/sf0.001")
    for role in ROLE_SQL:
        roles[role].write.parquet(f"{directory}/{role}.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")  # else long paths are cut off in plans
    yield from_parquet(spark, str(directory))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scan(text: str, role: str) -> str:
    """The scan of one table; each table must be scanned once."""
    (line,) = [line for line in text.splitlines() if "FileScan" in line and f"/{role}.parquet" in line]
    return line


def exchanges(text: str) -> int:
    return len(re.findall(r"Exchange (hash|range|Round|Single)", text))


@pytest.mark.parametrize("role", ["page_view", "app_created", "daily_logs", "app_collaborator_added"])
def test_window_reaches_the_scan(stored, role):
    line = scan(plan(sheet(stored, AS_OF, CONFIG, "All")), role)
    assert "created_at" in re.search(r"PushedFilters: (.*)", line)[1]
    assert "cast(created_at" not in line


def test_scans_read_only_the_columns_used(stored):
    text = plan(sheet(stored, AS_OF, CONFIG, "All"))
    assert "struct<account_id:int,created_at:timestamp_ntz>" in scan(text, "connections_soft_limit")
    assert "struct<account_id:string,created_at:timestamp_ntz,url:string>" in scan(text, "page_view")


def test_each_event_table_is_scanned_once_and_unneeded_messages_not_at_all(stored):
    text = plan(sheet(stored, AS_OF, CONFIG, "All"))
    for role in set(ROLE_SQL) - {"channels", "messages_soft_limit"}:
        scan(text, role)
    assert "messages_soft_limit" not in text


def test_grouped_features_take_one_shuffle_after_a_partial_aggregate(stored):
    text = plan(grouped_features(stored, AS_OF, CONFIG, with_channel=True))
    assert exchanges(text) == 1
    assert re.search(r"Exchange hashpartitioning.*\n.*HashAggregate.*partial_sum", text)


def test_channels_shuffle_rows_once_and_finished_names_once(stored):
    text = plan(channel.first_touch_channels(stored["channels"], stored["first_touch"], CONFIG))
    assert exchanges(text) == 2
    assert re.search(r"Exchange hashpartitioning.*\n.*HashAggregate.*partial_max", text)


def test_content_shuffles_each_table_once(stored):
    text = plan(content.content_accounts(stored, AS_OF, CONFIG))
    assert exchanges(text) == 3
    assert text.count("partial_max") >= 3


@pytest.mark.parametrize("views", [content.tutorial_views, content.docs_views])
def test_views_meet_the_eligible_accounts_before_they_are_counted(stored, views):
    text = plan(views(stored, AS_OF, CONFIG))
    assert text.index("count(distinct") < text.index("Join")
    assert "count(distinct" not in text[text.index("Join") :]


def test_joins_are_hash_joins_on_keys_without_full_outer(stored):
    text = plan(sheet(stored, AS_OF, CONFIG, "All"))
    assert "FullOuter" not in text
    assert "Cartesian" not in text and "NestedLoop" not in text


def test_flag_filter_reaches_the_account_scan(stored):
    text = plan(sheet(stored, AS_OF, CONFIG, "Personal"))
    (account,) = [line for line in text.splitlines() if "+- Filter" in line and "plan_id#" in line]
    assert "gmail.com" in account


def test_runtime_filter_of_the_accounts_reaches_the_views(spark, stored):
    option = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    spark.conf.set(option, "1")
    try:
        text = plan(sheet(stored, AS_OF, CONFIG, "All"))
    finally:
        spark.conf.unset(option)
    filters = [line for line in text.splitlines() if "+- Filter" in line and "might_contain" in line]
    for column in ("user_agent", "max_connections", "month", "url", "try_cast(account_id"):
        assert any(re.search(rf"\b{re.escape(column)}#", line) for line in filters), column


def test_no_python_in_the_plan(stored):
    text = plan(sheet(stored, AS_OF, CONFIG, "All"))
    assert "Python" not in text and "Pandas" not in text
