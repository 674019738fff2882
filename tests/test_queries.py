"""Every registered query against its SQL in DuckDB, on the given tables."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as contract

SF_DIR = "/root/testdata/sf0.01"
NAMES = [*contract.QUERIES, *contract.THROUGH]
QUERIES = {name: contract.queries()[name] for name in NAMES}
SQL = {name: contract.oracle_sql()[name] for name in NAMES}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("customer", "orders", "lineitem", "events", "pages"):
        connection.sql(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return connection


def test_every_query_has_sql():
    assert list(QUERIES) == list(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    ours = QUERIES[name](spark, SF_DIR).toArrow()
    theirs = duck.sql(SQL[name]).to_arrow_table()
    columns = sorted(theirs.column_names)
    assert sorted(ours.column_names) == columns
    assert [str(ours.schema.field(c).type) for c in columns] == [str(theirs.schema.field(c).type) for c in columns]

    def rows(result) -> Counter:
        return Counter(zip(*(result.column(c).to_pylist() for c in columns), strict=True))

    assert rows(ours) == rows(theirs)
    assert ours.num_rows > 0


def test_entry(spark):
    totals = [row.total for row in contract.entry(spark).select("total").collect()]
    assert totals == sorted(totals, reverse=True)
    assert all(0 <= total <= 50 for total in totals)


def test_total_is_the_sum_of_its_columns(spark):
    rows = QUERIES["weighted_scorecard"](spark, SF_DIR)
    parts = rows.columns[4:-1]
    assert rows.filter(f"total <> {' + '.join(parts)} or total not between 0 and 50").count() == 0
