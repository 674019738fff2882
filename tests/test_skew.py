"""One account holds more than a third of every table; results must stay whole and equal to plain SQL."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from leadgauge.sources import from_parquet
from testtables.oracle import oracle
from testtables.roles import ROLE_SQL, SparkRoles

HOT = {
    "page_view": "account_id = '7'",
    "user_engagement": "account_id = 7",
    "app_created": "account_id = 7",
    "daily_logs": "account_id = 7",
    "app_collaborator_added": "account_id = 7",
    "splash_page_views": "account_id = '7'",
    "web_sessions": "account_id = 8",
    "first_touch": "account_id = '7'",
    "channels": "id = 7",
    "connections_soft_limit": "account_id = 7",
    "messages_soft_limit": "account_id = 7",
    "paid_signup": "account_id = 9",
}


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """Role tables where the copies of one account's rows make up more than a third."""
    directory = tmp_path_factory.mktemp("hot")
    roles = SparkRoles(spark, "/root/testdata/sf0.001")
    for role in ROLE_SQL:
        rows = roles[role]
        if role in HOT:
            rows = rows.cache()
            mine = rows.filter(HOT[role])
            times = rows.count() // (2 * max(mine.count(), 1)) + 1
            if role == "user_engagement":
                times = 1500
            rows = rows.unionByName(mine.withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("_n"))
        rows.write.parquet(f"{directory}/{role}.parquet")
    return str(directory)


@pytest.fixture(scope="module")
def duck(hot):
    connection = duckdb.connect()
    for role in ROLE_SQL:
        connection.sql(f"create view {role} as select * from '{hot}/{role}.parquet/*.parquet'")
    return connection


@pytest.mark.parametrize(
    "name",
    ["dashboard_days", "active_apps", "tutorial_views", "docs_views", "channel_distinct", "full_outer_touch", "engagement_attached", "tut_doc_accounts", "weighted_scorecard",
     "sheet_all"],
)
def test_hot_account(spark, hot, duck, name):
    ours = contract.QUERIES[name](from_parquet(spark, hot)).toArrow()
    theirs = duck.sql(oracle(name, roles={})).to_arrow_table()

    def rows(result) -> Counter:
        columns = sorted(theirs.column_names)
        return Counter(zip(*(result.column(c).to_pylist() for c in columns), strict=True))

    assert rows(ours) == rows(theirs)
    if name == "weighted_scorecard":
        assert Counter(ours.column("account_id").to_pylist())[7] > 1500


def test_hot_rows_leave_the_join_in_pieces(spark, hot):
    """The rows of the hot account are written out by several tasks."""
    rows = contract.QUERIES["weighted_scorecard"](from_parquet(spark, hot))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = rows.filter("account_id = 7").select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks > 1
