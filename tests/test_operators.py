"""Hand-made rows for every operator, with the semantic traps of FIXTURES.md."""

from __future__ import annotations

from collections import Counter
from dataclasses import replace
from datetime import datetime, timedelta, timezone

import pytest
from conftest import AS_OF, BLOG, BOT, DASHBOARD, EXCLUDED, GROWTH, OWN_SITE, bag, mapping
from pyspark.sql import functions as F

from leadgauge import ScorecardConfig
from leadgauge.config import Rule, live_rules
from leadgauge.functions.measure import distinct_over, repeat_copies, split_copies, with_copies
from leadgauge.functions.text import int_key, is_numeric
from leadgauge.functions.window import Clock
from leadgauge.operators import apps, channel, collaborators, content, dashboard, engagement, limits, score, spine
from leadgauge.operators.attach import attach, attach_membership

NOON = "2024-01-10 12:00:00"
OLD = "2023-12-20 11:59:59"
LOW = "2023-12-20 12:00:00"
AGENT = "Mozilla"


@pytest.mark.parametrize(
    ("as_of", "month_ago"),
    [
        ("2024-03-31 08:00:00", "2024-02-29 08:00:00"),
        ("2023-03-31 08:00:00", "2023-02-28 08:00:00"),
        ("2024-01-20 12:00:00", "2023-12-20 12:00:00"),
    ],
)
def test_window_steps_back_one_calendar_month(table, as_of, month_ago):
    df = table("paid_signup", (1, as_of))
    clock = Clock(df, "created_at", as_of, 1)
    assert str(df.select(clock.month_ago).first()[0]) == month_ago


def test_window_includes_both_ends(table, config):
    rows = table("user_engagement", (1, 1, LOW), (2, 1, AS_OF), (3, 1, OLD), (4, 1, "2024-01-20 12:00:01"))
    assert mapping(engagement.engagement(rows, AS_OF, config)) == {1: 1, 2: 1}


def test_window_on_zoned_and_date_columns(spark, config):
    zoned = spark.sql("select 1 as account_id, timestamp '2023-12-20 12:00:00' as created_at")
    assert bag(limits.limit_accounts(zoned, AS_OF, config)) == Counter([(1,)])
    dated = spark.sql(
        "select * from values (1, 2, date '2023-12-20'), (1, 3, date '2024-01-20')"
        " as t(account_id, engagement_frequency, month)"
    )
    assert mapping(engagement.engagement(dated, AS_OF, config)) == {1: 3}


def test_spine(table, config):
    account = table(
        "account",
        (1, 2, "a@b.c", NOON),
        (2, 1, None, NOON),
        (3, 1, "a@invalid.com", NOON),
        (4, 1, "a@b.c", "2017-12-31 23:59:59"),
        (5, 1, "a@b.c", "2024-01-20 12:00:01"),
        (6, 1, "a@b.c", AS_OF),
        (7, 1, "a@b.c", "2018-01-01 00:00:00"),
        (8, None, "a@b.c", NOON),
        (9, 1, "invalid", NOON),
        (10, 1, "INVALID@b.c", NOON),
    )
    assert set(mapping(spine.spine(account, AS_OF, config))) == {6, 7, 10}


def test_business_flag_and_personal_emails(table, config):
    emails = ["a@gmail.com", "a@GMAIL.com", "a@mit.edu", "a@gmail", "nodomain", "a@.edu", "a@qq.com@x.example"]
    account = table("account", *((n, 1, email, NOON) for n, email in enumerate(emails)), (9, 2, "z@aol.com", OLD))
    flags = spine.business_flag(spine.spine(account, AS_OF, config), config).select("account_id", "bus_email_flag")
    assert mapping(flags) == {0: 0, 1: 1, 2: 1, 3: 0, 4: 1, 5: 0, 6: 0}
    personal = bag(spine.personal_emails(account, config))
    assert (9, "z@aol.com", "aol.com") in personal
    assert {row[0] for row in personal} == {0, 3, 5, 6, 9}


def test_dashboard_days(table, config):
    views = table(
        "page_view",
        ("1", "2024-01-10 08:00:00", DASHBOARD),
        ("1", "2024-01-10 09:00:00", DASHBOARD),
        ("2", NOON, DASHBOARD),
        ("3", NOON, DASHBOARD + "/x"),
        ("4", NOON, EXCLUDED),
        ("5", NOON, None),
        ("abc", NOON, DASHBOARD),
        (None, NOON, DASHBOARD),
        ("6", OLD, DASHBOARD),
        ("7", "2024-01-10 08:00:00", DASHBOARD),
        ("8", NOON, DASHBOARD),
        ("09", NOON, DASHBOARD),
        ("11", "2024-01-10 08:00:00", DASHBOARD),
        ("11", "2024-01-10 10:00:00", DASHBOARD),
        ("11", "2024-01-11 10:00:00", DASHBOARD),
    )
    signups = table(
        "paid_signup",
        (2, NOON),
        (7, "2024-01-09 00:00:00"),
        (7, "2024-01-11 00:00:00"),
        (8, "2024-01-01 00:00:00"),
        (8, None),
        (9, "2024-01-01 00:00:00"),
        (11, "2024-01-10 09:00:00"),
        (None, "2024-01-01 00:00:00"),
    )
    days = mapping(dashboard.dashboard_days(views, signups, AS_OF, config))
    assert days == {"1": 1, "3": 1, "7": 1, "8": 1, "09": 1, "11": 1}


def test_is_numeric_is_what_a_decimal_cast_accepts(spark):
    texts = ["7", "07", " 7 ", "-7", "+7", "7.5", ".5", "7.", "1e3", "1E-3", "e", "-", "", " ", "anon", "1-2", "1.2.3"]
    texts += ["4f0c", "99999999999", "9" * 29, "9" * 30, "NaN", "0x1f", None]
    df = spark.createDataFrame([(text,) for text in texts], "id string")
    rows = df.select(is_numeric(F.col("id")), F.expr("try_cast(id as decimal(38,9)) is not null")).collect()
    assert [row[0] for row in rows] == [row[1] for row in rows]
    assert [text for text, row in zip(texts, rows) if row[0]][:9] == texts[:9]


@pytest.mark.parametrize(
    ("pattern", "ids"), [("%docs%", {1, 2, 3}), ("%docs", {1, 2}), ("%/docs/%", {3}), ("%docs_%", {3})]
)
def test_docs_url_is_matched_without_trailing_slashes(spark, pattern, ids):
    urls = [(1, "e.example/docs"), (2, "e.example/docs//"), (3, "e.example/docs/a/"), (4, "e.example/"), (5, None)]
    df = spark.createDataFrame(urls, "id int, url string")
    found = df.filter(content.is_docs(ScorecardConfig(docs_url=pattern)))
    assert {row.id for row in found.collect()} == ids


def test_dashboard_cap_and_number(spark, config):
    days = spark.createDataFrame(
        [("1", 11), ("2", 10), ("7", 3), ("07", 4), ("1.5", 5), (" 9 ", 1), ("1e3", 2)],
        "account_id string, dashboard_daily_pageviews bigint",
    )
    capped = dashboard.dashboard_capped(days, config)
    assert bag(dashboard.dashboard_by_number(capped)) == Counter([(1, 10), (2, 10), (7, 3), (7, 4), (9, 1)])


def test_engagement_cap_keeps_null_until_attached(spark, table, config):
    rows = table(
        "user_engagement", (1, None, NOON), (2, 9, NOON), (4, 3, "2024-01-01 00:00:00"), (4, 5, "2023-12-25 00:00:00")
    )
    capped = engagement.engagement_capped(engagement.engagement(rows, AS_OF, config), config)
    assert bag(capped) == Counter([(1, None), (2, 6), (4, 3), (4, 5)])
    accounts = spark.range(1, 5).select(F.col("id").cast("int").alias("account_id"))
    attached = attach(accounts, capped, "engagement_frequency", 0)
    assert bag(attached) == Counter([(1, 0), (2, 6), (3, 0), (4, 3), (4, 5)])


def test_named_apps(table, config):
    names = {
        1: "happy-tiger-12",
        2: "happy-tiger",
        3: "Happy-tiger",
        4: "shop",
        5: None,
        6: "sandy-sandy",
        7: "qwerty-sandy",
        8: "unhappyish-xtigerx",
        9: "",
    }
    app_created = table("app_created", *((n, name, None, None, None, NOON) for n, name in names.items()))
    counts = mapping(apps.named_apps(app_created, AS_OF, config))
    assert counts == {1: 0, 2: 0, 3: 1, 4: 1, 5: 1, 6: 0, 7: 1, 8: 0, 9: 1}


def test_named_apps_cap(table, config):
    app_created = table("app_created", *((1, "shop", None, None, None, NOON) for _ in range(6)))
    counts = apps.named_apps(app_created, AS_OF, config)
    assert mapping(counts) == {1: 6}
    assert mapping(apps.named_apps_capped(counts, config)) == {1: 4}


def test_named_apps_needs_the_adjectives(table):
    with pytest.raises(ValueError, match="name_adjectives"):
        apps.named_apps(table("app_created"), AS_OF, ScorecardConfig())


def test_tech_info_is_the_best_single_app(table, config):
    one_sided = [(1, "a", "ruby", "none", None, NOON), (1, "b", None, "react", None, NOON)]
    assert mapping(apps.tech_info(table("app_created", *one_sided), AS_OF, config)) == {1: 1}
    both = [*one_sided, (1, "c", "go", "vue", None, NOON), (2, "d", "none", None, None, NOON)]
    assert mapping(apps.tech_info(table("app_created", *both), AS_OF, config)) == {1: 2, 2: 0}


def test_tech_flags(table, config):
    app_created = table(
        "app_created",
        (1, "a", "ruby", "none", None, NOON),
        (1, "b", "go", None, None, NOON),
        (2, "c", None, None, None, NOON),
        (3, "d", "none", "none", None, NOON),
        (4, "e", None, "none", None, NOON),
    )
    flags = apps.tech_flags(app_created, AS_OF, config)
    assert bag(flags) == Counter([(1, 1, 0, 1), (2, 0, 0, 0), (3, 0, 0, 0), (4, 0, 0, 1)])


def test_active_apps(table, config):
    logs = table(
        "daily_logs",
        (1, 10, NOON, 5, 100),
        (1, 10, AS_OF, 7, 900),
        (1, 11, NOON, 5, 100),
        (2, 10, NOON, 4, 1000),
        (3, 10, NOON, 5, 99),
        (4, 10, NOON, None, 500),
        (5, None, NOON, 5, 100),
        (6, 10, OLD, 5, 100),
    )
    counts = apps.active_apps(logs, AS_OF, config)
    assert mapping(counts) == {1: 2, 5: 0}
    assert mapping(apps.active_app(counts)) == {1: 1, 5: 0}
    rows = apps.active_rows(logs, AS_OF, config).groupBy("account_id").agg(F.max("active_app"))
    assert mapping(rows) == {1: 1, 5: 0}


def test_multiple_environments(table, config):
    app_created = table(
        "app_created", (1, "a", None, None, "", NOON), (1, "b", None, None, None, NOON), (2, "c", None, None, None, NOON)
    )
    assert mapping(apps.multiple_environments(app_created, AS_OF, config)) == {1: 1, 2: 0}


def test_collaborators(table, config):
    added = table(
        "app_collaborator_added", (1, None, NOON), (2, "x", NOON), (2, "x", NOON), (2, "y", NOON), (3, "z", OLD)
    )
    counts = collaborators.collaborators(added, AS_OF, config)
    assert mapping(counts) == {1: 0, 2: 2}
    assert mapping(collaborators.collaborator_flag(counts)) == {1: 0, 2: 1}


def _content_sources(table, channels, views, sessions=()):
    return {
        "channels": table("channels", *channels),
        "splash_page_views": table("splash_page_views", *views),
        "web_sessions": table("web_sessions", *sessions),
    }


def _content(sources, config):
    return (
        mapping(content.tutorial_views(sources, AS_OF, config)),
        mapping(content.docs_views(sources, AS_OF, config)),
        {row.account_id for row in content.content_accounts(sources, AS_OF, config).collect()},
    )


def test_content_date_bounds(table, config):
    channels = [
        (1, "2024-01-20 00:00:00", None),
        (2, "2023-12-20 00:00:00", None),
        (3, "2023-12-19 23:59:59", None),
        (4, "2024-01-20 12:00:00", None),
        (5, "2024-01-19 23:59:59", None),
    ]
    views = [
        (10 * n + k, str(n), "tutorials", AGENT, "https://e.example/docs/", NOON) for n in range(1, 6) for k in (1, 2)
    ]
    tutorials, docs, flagged = _content(_content_sources(table, channels, views), config)
    assert tutorials == {2: 2, 5: 2}
    assert docs == {1: 2, 2: 2, 5: 2}
    assert flagged == {1, 2, 5}


def test_content_agents_assets_and_days(table, config):
    channels = [(n, NOON, None) for n in range(1, 9)]
    views = [
        (1, "1", "tutorials", BOT, "/docs", NOON),
        (2, "2", "tutorials", None, "/docs", NOON),
        (3, "3", "site", AGENT, "/x", NOON),
        (4, "4", "tutorials", AGENT, "/x", "2024-01-20 23:59:59"),
        (5, "5", "tutorials", AGENT, "/x", "2024-01-21 00:00:00"),
        (6, "6", "site", AGENT, "/docs/", NOON),
        (6, "6", "site", AGENT, "/docs/", NOON),
        (7, "06", "site", AGENT, "/docs/a", NOON),
        (8, "7", None, AGENT, "/docs", NOON),
        (9, "x", "tutorials", AGENT, "/docs", NOON),
        (None, "8", "tutorials", AGENT, "/docs", NOON),
    ]
    tutorials, docs, flagged = _content(_content_sources(table, channels, views), config)
    assert tutorials == {3: 0, 4: 1, 6: 0, 7: 0, 8: 0}
    assert docs == {6: 2, 7: 1, 8: 0}
    assert flagged == {4, 6}


def test_content_sessions(table, config):
    early, late = "2024-01-01 00:00:00", "2024-01-05 00:00:00"
    channels = [(n, NOON, None) for n in range(1, 7)] + [(2, NOON, True)]
    views = [(n, str(n), "tutorials", AGENT, "/x", NOON) for n in range(1, 7)]
    sessions = [
        (1, late, early),
        (1, early, early),
        (2, late, early),
        (2, early, late),
        (4, late, None),
        (5, None, late),
        (6, early, late),
        (6, early, late),
        (None, late, early),
    ]
    tutorials, docs, flagged = _content(_content_sources(table, channels, views, sessions), config)
    assert tutorials == {2: 1, 3: 1, 4: 1, 6: 1}
    assert docs == {}
    assert flagged == {2, 3, 4, 6}


def test_content_flag_thresholds(spark, config):
    counted = spark.createDataFrame(
        [(1, 0, 1), (2, 0, 2), (3, 1, 0), (4, 0, 0)], "account_id int, tutorial_views bigint, docs_page_views bigint"
    )
    assert mapping(content.content_flag(counted, config)) == {1: 0, 2: 1, 3: 1, 4: 0}


@pytest.mark.parametrize("threshold", [0, 1, 2, 3])
def test_distinct_over(spark, threshold):
    values = {1: [None], 2: [5], 3: [5, 5, None], 4: [5, 6], 5: [7, 5, 6], 6: [1, 2, 3, 4, 4]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "account_id int, v bigint")
    over = mapping(df.groupBy("account_id").agg(distinct_over(F.col("v"), threshold)))
    assert over == {k: len({v for v in vs if v is not None}) > threshold for k, vs in values.items()}


def test_limits(spark, table, config):
    connections = table("connections_soft_limit", (1, NOON), (1, NOON), (3, OLD))
    messages = table("messages_soft_limit", (2, NOON))
    hit = limits.limit_accounts(connections, AS_OF, config)
    assert bag(hit) == Counter([(1,)])
    accounts = spark.range(1, 4).select(F.col("id").cast("int").alias("account_id"))
    flagged = attach_membership(accounts, hit, "con_soft_limit_flag")
    flagged = attach_membership(flagged, limits.limit_accounts(messages, AS_OF, config), "mes_soft_limit_flag")
    assert bag(flagged) == Counter([(1, 1, 0), (2, 0, 1), (3, 0, 0)])
    assert mapping(limits.limit_flag(flagged, config)) == {1: 1, 2: 0, 3: 0}
    counting_messages = ScorecardConfig(message_limit_over=0)
    assert mapping(limits.limit_flag(flagged, counting_messages)) == {1: 1, 2: 1, 3: 0}
    assert len(limits.limit_rows(connections, messages, AS_OF, config)) == 1
    assert len(limits.limit_rows(connections, messages, AS_OF, counting_messages)) == 2


TOUCHES = [
    ("https://x.example/?utm_medium=cpc&x", None, "PAID MARKETING"),
    ("https://x.example/?utm_medium=Paid", "https://github.com", "PAID MARKETING"),
    ("https://x.example/?utm_medium=cpcx", None, "DIRECT"),
    ("https://x.example/?utm_source=adwords", None, "PAID MARKETING"),
    ("https://x.example/?utmXmedium=email", None, "EMAIL"),
    ("https://x.example/?utm_medium=referral", None, "REFERRALS"),
    ("https://x.example/?utm_medium=social", None, "SOCIAL"),
    ("https://x.example/?growth", None, "PAID MARKETING"),
    ("https://x.example/", GROWTH, "PAID MARKETING"),
    ("https://x.example/?gclid=1", "https://github.com", "PAID MARKETING"),
    (None, BLOG, "BLOG"),
    (None, OWN_SITE, ScorecardConfig().own_channel),
    ("https://x.example/", "https://mail.google.com/", "ORGANIC"),
    ("https://x.example/", "https://pinterest.com/", "SOCIAL"),
    ("https://x.example/", "https://laravel-news.com", "REFERRALS"),
    ("https://x.example/", "https://flask.example", "ORGANIC"),
    ("https://x.example/", "https://rubyweekly.com", "EMAIL"),
    ("https://x.example/", "https://GITHUB.com", "OTHER"),
    ("https://x.example/", "", "OTHER"),
    (None, None, "AD BLOCKER"),
    ("https://x.example/?utm_source=list", None, "OTHER"),
    ("https://x.example/", None, "DIRECT"),
]


def test_touch_channel(table, config):
    rows = table("first_touch", *((str(n), url, referrer) for n, (url, referrer, _) in enumerate(TOUCHES)))
    labels = channel.touches(rows).select("account_id", channel.touch_channel(config))
    assert mapping(labels) == {n: label for n, (_, _, label) in enumerate(TOUCHES)}


def test_every_live_referrer_rule_decides_for_its_own_text(table, config):
    rules = [rule for rule in live_rules(config.first_touch_rules()) if rule.column == "referrer"]
    rows = table("first_touch", *((str(n), None, rule.pattern.strip("%")) for n, rule in enumerate(rules)))
    labels = channel.touches(rows).select("account_id", channel.touch_channel(config))
    assert mapping(labels) == {n: rule.label for n, rule in enumerate(rules)}


def test_paid_mediums_are_equal_not_alike(table):
    config = ScorecardConfig(paid_mediums=("paid_search",))
    urls = ["https://x.example/?utm_medium=PAID_SEARCH", "https://x.example/?utm_medium=paidxsearch"]
    rows = table("first_touch", *((str(n), url, None) for n, url in enumerate(urls)))
    labels = channel.touches(rows).select("account_id", channel.touch_channel(config))
    assert mapping(labels) == {0: "PAID MARKETING", 1: "DIRECT"}


def test_more_channel_labels_than_a_number_has_bits(table, config):
    rules = tuple(Rule("url", f"%/p{n:02d}/%", f"LABEL {n}") for n in range(70))
    many = replace(config, url_rules=rules)
    channels = table("channels", *((n, NOON, False) for n in range(70)))
    touches = table("first_touch", *((str(n), f"https://x.example/p{n:02d}/", None) for n in range(70)))
    found = channel.first_touch_channels(channels, touches, many)
    assert mapping(found) == {n: f"LABEL {n}" for n in range(70)}


def test_rows_without_account_keep_their_channels(table, config):
    touch = table("first_touch", ("abc", "https://x.example/", "https://github.com"))
    both = Counter([(None, "AD BLOCKER"), (None, "REFERRALS")])
    assert bag(channel.first_touch_channels(table("channels", (None, NOON, False)), touch, config)) == both
    one = Counter([(1, "AD BLOCKER"), (None, "REFERRALS")])
    assert bag(channel.first_touch_channels(table("channels", (1, NOON, False)), touch, config)) == one


def test_ids_above_32_bits_keep_their_rows(spark):
    ids = spark.createDataFrame([("5000000000",), ("7",), ("x",)], "id string")
    assert [row[0] for row in ids.select(int_key(F.col("id"))).collect()] == [5_000_000_000, 7, None]


def test_as_of_with_a_zone_is_one_moment(spark):
    moment = datetime(2024, 1, 20, 12, tzinfo=timezone(timedelta(hours=5)))
    df = spark.range(1).select(F.lit(None).cast("timestamp_ntz").alias("a"), F.lit(None).cast("timestamp").alias("b"))
    for column in ("a", "b"):
        now = df.select(Clock(df, column, moment, 1).now.cast("string")).collect()[0][0]
        assert now == "2024-01-20 07:00:00"


def test_first_touch_channels(table, config):
    channels = table(
        "channels", (1, NOON, True), (2, NOON, None), (3, NOON, False), (4, NOON, True), (4, NOON, False), (5, NOON, False)
    )
    first_touch = table(
        "first_touch",
        ("1", "https://x.example/?utm_medium=cpc", None),
        ("3", "https://x.example/", "https://github.com"),
        ("03", "https://x.example/", None),
        ("3", "https://x.example/", None),
        ("4", "https://x.example/", "https://github.com"),
        ("5", None, None),
        ("8", "https://x.example/", "https://github.com"),
        ("x", None, None),
        (None, None, None),
    )
    expected = [
        (1, "HEROKU"), (2, "AD BLOCKER"), (3, "REFERRALS"), (3, "DIRECT"), (4, "HEROKU"), (4, "REFERRALS"),
        (5, "AD BLOCKER"),
    ]
    lone = [(None, "REFERRALS"), (None, "AD BLOCKER")]
    assert bag(channel.first_touch_channels(channels, first_touch, config)) == Counter(expected + lone)
    rows = Counter(expected) + Counter(
        [(3, "DIRECT"), (None, "REFERRALS"), (None, "AD BLOCKER"), (None, "AD BLOCKER")]
    )
    assert bag(channel.first_touch_rows(channels, first_touch, config)) == rows


def test_copies_round_trip(spark):
    rows = [(1, "a")] * 2500 + [(1, "b")] + [(2, None)] * 1000 + [(None, "c")] * 3
    df = spark.createDataFrame(rows, "account_id int, v string")
    held = split_copies(with_copies(df, "account_id", "v"))
    assert max(row.copies for row in held.collect()) <= 1000
    assert bag(repeat_copies(held, "account_id", "v")) == Counter(rows)


def test_score_key(spark, config):
    assert [tuple(row) for row in score.score_key(spark, config).collect()] == [
        ("dashboard_daily_pageviews", 20),
        ("engagement_frequency", 12),
        ("number_of_named_apps", 8),
        ("tech_info", 4),
        ("active_app", 2),
        ("multiple_env_flag", 1),
        ("collaborators", 1),
        ("tut_doc_pv", 1),
        ("hit_soft_limit", 1),
        ("total", 50),
    ]
