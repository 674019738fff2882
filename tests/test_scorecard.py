"""The whole scorecard, its sheets and its CSV files on hand-made accounts."""

from __future__ import annotations

from datetime import date
from pathlib import Path

import pytest
from conftest import AS_OF, DASHBOARD, SCHEMAS, bag

from leadgauge import scorecard_events, sheet, weighted_scorecard, write_sheet_csv, write_sheets

NOON = "2024-01-10 12:00:00"


@pytest.fixture(scope="module")
def sources(table):
    """1 scores full marks, 2 nothing, 3 has two engagement rows and two channels, 4 is personal, 5 not scored."""
    rows = {
        "account": [
            (1, 1, "top@corp.example", NOON),
            (2, 1, "none@corp.example", NOON),
            (3, 1, 'a"b@corp.example', NOON),
            (4, 1, "p@gmail.com", NOON),
            (5, 2, "paid@corp.example", NOON),
        ],
        "page_view": [("1", f"2024-01-{day:02d} 12:00:00", DASHBOARD) for day in range(1, 13)]
        + [("4", NOON, DASHBOARD), ("04", NOON, DASHBOARD), ("5", NOON, DASHBOARD)],
        "user_engagement": [(1, 8, NOON), (3, 2, NOON), (3, 4, NOON), (3, 4, NOON)],
        "app_created": [(1, "shop", "go", "vue", "yes", NOON)] * 6,
        "daily_logs": [(1, 1, NOON, 5, 100)],
        "app_collaborator_added": [(1, "x@y.z", NOON)],
        "channels": [(1, NOON, True), (3, NOON, False), (4, NOON, None)],
        "splash_page_views": [(1, "1", "tutorials", "Mozilla", None, NOON)],
        "first_touch": [("3", None, "https://github.com"), ("3", "https://x.example", None)],
        "connections_soft_limit": [(1, NOON)],
        "messages_soft_limit": [(2, NOON)],
    }
    return {role: table(role, *rows.get(role, [])) for role in SCHEMAS}


def test_weighted_scorecard(sources, config):
    rows = weighted_scorecard(sources, AS_OF, config)
    assert rows.columns[:4] == ["account_id", "bus_email_flag", "email", "FTC"]
    third = (3, 1, 'a"b@corp.example')
    zeros = (0, 0, 0, 0, 0, 0, 0)
    assert bag(rows) == {
        (1, 1, "top@corp.example", "HEROKU", 20, 12, 8, 4, 2, 1, 1, 1, 1, 50): 1,
        (2, 1, "none@corp.example", "DIRECT", 0, 0, *zeros, 0): 1,
        (*third, "REFERRALS", 0, 4, *zeros, 4): 1,
        (*third, "REFERRALS", 0, 8, *zeros, 8): 2,
        (*third, "DIRECT", 0, 4, *zeros, 4): 1,
        (*third, "DIRECT", 0, 8, *zeros, 8): 2,
        (4, 0, "p@gmail.com", "AD BLOCKER", 2, 0, *zeros, 2): 2,
    }


def test_scorecard_events_are_unweighted(sources, config):
    top = [row for row in scorecard_events(sources, AS_OF, config).collect() if row.account_id == 1]
    assert [tuple(row) for row in top] == [(1, 1, "top@corp.example", 10, 6, 4, 2, 1, 1, 1, 1, 1)]


def test_sheets_are_sorted_and_split_the_scorecard(sources, config):
    business = sheet(sources, AS_OF, config, "Business")
    personal = sheet(sources, AS_OF, config, "Personal")
    everything = sheet(sources, AS_OF, config, "All")
    assert [(row.account_id, row.total) for row in everything.collect()] == [
        (1, 50), (3, 8), (3, 8), (3, 8), (3, 8), (3, 4), (3, 4), (4, 2), (4, 2), (2, 0),
    ]
    assert {row.account_id for row in personal.collect()} == {4}
    assert bag(business) + bag(personal) == bag(everything)
    assert "FTC" not in everything.columns and "bus_email_flag" not in everything.columns
    assert len(everything.columns) == 12


def test_unknown_sheet_is_refused(sources, config):
    with pytest.raises(ValueError, match="unknown sheet"):
        sheet(sources, AS_OF, config, "Nobody")


def test_csv(sources, config, tmp_path):
    rows = sheet(sources, AS_OF, config, "Business")
    path = write_sheet_csv(rows, str(tmp_path), "Business", date(2024, 1, 20))
    assert path.endswith("/scorecard_Business_2024-01-20.csv")
    lines = [line for part in sorted(Path(path).glob("part-*")) for line in part.read_text().splitlines()]
    header = "account_id,email,dashboard_daily_pageviews,engagement_frequency,number_of_named_apps,tech_info,"
    assert lines[0].startswith(header)
    data = [line for line in lines if not line.startswith("account_id")]
    assert data[0].startswith("1,top@corp.example,20,12,8,4,2,1,1,1,1,50")
    assert data[1].startswith('3,"a""b@corp.example",')
    assert len(data) == 8


def test_all_sheets_come_from_one_checkpointed_scorecard(spark, sources, config, tmp_path):
    paths = write_sheets(sources, AS_OF, config, f"{tmp_path}/out", date(2024, 1, 20), f"{tmp_path}/scratch", prefix="leads")
    assert [Path(path).name.split("_")[1] for path in paths] == ["Business", "Personal", "All"]
    for path, kind in zip(paths, ["Business", "Personal", "All"], strict=True):
        written = spark.read.option("header", True).option("escape", '"').csv(path)
        expected = sheet(sources, AS_OF, config, kind)
        assert bag(written) == bag(expected.select([expected[c].cast("string") for c in expected.columns]))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(Path(path).name for path in paths)


def test_csv_writes_null_as_na(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "x,y")], "account_id int, email string, note string")
    path = write_sheet_csv(df.coalesce(1), str(tmp_path), "All", date(2024, 1, 20))
    (part,) = Path(path).glob("part-*")
    assert part.read_text() == 'account_id,email,note\n1,NA,"x,y"\n'
