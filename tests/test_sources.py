from __future__ import annotations

import pytest
from conftest import SCHEMAS

from leadgauge.sources import ROLES, from_catalog, from_jdbc, resolve_table
from leadgauge.sources.tables import SCRATCH_NAMES


@pytest.fixture(scope="module")
def warehouse(spark):
    spark.sql("create database scratch")
    spark.sql("create database facts")
    for role, schema in SCHEMAS.items():
        name = f"scratch.lr_2_{role}" if role in SCRATCH_NAMES else f"facts.{role}"
        spark.createDataFrame([], schema).write.saveAsTable(name)
    for name in ("lr_1_elements_first_touch", "lr_1_elements_web_sessions", "lr_3_first_touch", "lr_3_web_sessions"):
        spark.range(1).write.saveAsTable(f"scratch.{name}")
    return spark


def test_resolve_takes_the_first_by_name(warehouse):
    pattern = SCRATCH_NAMES["first_touch"]
    assert resolve_table(warehouse, "scratch", *pattern) == "`scratch`.`lr_2_first_touch`"
    assert resolve_table(warehouse, "scratch", "%first_touch") == "`scratch`.`lr_1_elements_first_touch`"


def test_resolve_raises_without_a_match(warehouse):
    with pytest.raises(LookupError, match="no table like"):
        resolve_table(warehouse, "scratch", "%missing")


def test_catalog_fills_every_role(warehouse):
    sources = from_catalog(warehouse, "facts", "scratch")
    assert list(sources) == list(ROLES)
    for role, columns in ROLES.items():
        assert set(columns) <= set(sources[role].columns)


def test_catalog_override(warehouse):
    sources = from_catalog(warehouse, "facts", "scratch", {"first_touch": "scratch.lr_3_first_touch"})
    assert sources["first_touch"].columns == ["id"]


def test_jdbc_wants_a_split_for_each_table(spark):
    with pytest.raises(ValueError, match="no split given for account"):
        from_jdbc(spark, "jdbc:none", {"account": "account"}, {})
