"""The registered queries in plain SQL, written from the meaning of each relation rather than from its Spark plan."""

from __future__ import annotations

import re
from collections.abc import Mapping

from testtables.roles import AS_OF, CONFIG, duckdb_roles

_NOW = f"timestamp '{AS_OF}'"
_AGO = f"({_NOW} - interval '1' month)"
_RECENT = f"between {_AGO} and {_NOW}"


def _list(values) -> str:
    return ", ".join(f"'{value}'" for value in values)


_DOMAINS = _list(CONFIG.all_personal_domains())
_RULES = "\n".join(
    f"when {rule.column} like '{rule.pattern}' then '{rule.label}'"
    for rule in CONFIG.first_touch_rules()
)
_TOUCH = f"""case
    when upper(split_part(split_part(url, 'utm_medium=', 2), '&', 1)) in ({_list(CONFIG.paid_mediums)})
      then 'PAID MARKETING'
    {_RULES}
    when referrer is not null or contains(url, 'utm_source=') then 'OTHER'
    when url is null then 'AD BLOCKER' else 'DIRECT' end"""
_GENERATED = (
    f"regexp_matches(split_part(app_name, '-', 1), '{'|'.join(CONFIG.name_adjectives)}')"
    f" and regexp_matches(split_part(app_name, '-', 2), '{'|'.join(CONFIG.name_nouns)}')"
)


def _known(column: str) -> str:
    return f"cast({column} is not null and {column} <> '{CONFIG.unknown_tech}' as int)"


def _capped(relation: str, feature: str) -> str:
    cap = CONFIG.cap(feature)
    return f"select account_id, case when {feature} > {cap} then {cap} else {feature} end as {feature} from {relation}"


def _some(relation: str, number: str, name: str, over: int = 0) -> str:
    return f"select account_id, cast({number} > {over} as int) as {name} from {relation}"


_BACK, _FRONT = _known("backend_tech"), _known("frontend_tech")
_IS_ID = "regexp_full_match({0}, '[0-9]+')"
_NAMES = [f.name for f in CONFIG.features]
_POINTS = [f"{f.name} * {f.weight}" for f in CONFIG.features]


def _attached(feature: str, column: str) -> str:
    return f"""select p.account_id, p.email, coalesce(f.{column}, 0) as {column}
        from spine p left join {feature} f on f.account_id = p.account_id"""


def _sheet(condition: str) -> str:
    return f"select account_id, email, {', '.join(_NAMES)}, total from weighted_scorecard where {condition}"


def _counted(eligible_before: str, counted: str, where: str, name: str) -> str:
    return f"""select c.id as account_id, count(distinct {counted}) as {name}
        from channels c join human_view v on v.account_number = c.id
        where c.created_at >= cast({_AGO} as date) and c.created_at < {eligible_before} and {where}
          and (not exists (select 1 from web_sessions s where s.account_id = c.id)
            or exists (select 1 from web_sessions s where s.account_id = c.id
              and (s.account_created_at is null or s.session_created_at < s.account_created_at)))
        group by c.id"""


# Registered query -> SQL. A query may read the roles and the other relations by name.
RELATIONS = {
    "spine": f"""select id as account_id, email from account
        where plan_id = 1 and not contains(email, 'invalid') and created_at >= timestamp '2018-01-01'
          and created_at <= {_NOW}""",
    "personal_emails": f"""select id as account_id, email, split_part(email, '@', 2) as domain from account
        where split_part(email, '@', 2) in ({_DOMAINS})""",
    "business_flag": """select account_id, email, case when exists (
          select 1 from personal_emails b where b.account_id = p.account_id) then 0 else 1 end as bus_email_flag
        from spine p""",
    "domain_member": f"""select id as account_id, coalesce(split_part(email, '@', 2) in ({_DOMAINS}), false)
        as personal from account""",
    "numeric_guard": f"""select account_id, count(*) as views,
          try_cast(account_id as decimal(38, 9)) is not null as is_numeric,
          case when {_IS_ID.format('account_id')} then try_cast(account_id as bigint) end as account_number
        from page_view group by account_id""",
    "dashboard_days": f"""select account_id, count(distinct cast(created_at as date)) as dashboard_daily_pageviews
        from page_view v
        where created_at {_RECENT} and contains(url, '{CONFIG.dashboard_url.strip('%')}')
          and not contains(url, '{CONFIG.dashboard_url_excluded.strip('%')}')
          and try_cast(account_id as decimal(38, 9)) is not null
          and (not exists (select 1 from paid_signup s where cast(s.account_id as varchar) = v.account_id)
            or exists (select 1 from paid_signup s where cast(s.account_id as varchar) = v.account_id
              and (s.created_at is null or v.created_at < s.created_at)))
        group by account_id""",
    "dashboard_capped": _capped("dashboard_days", "dashboard_daily_pageviews"),
    "dashboard_number": f"""select cast(account_id as bigint) as account_id, dashboard_daily_pageviews
        from (select * from dashboard_capped where {_IS_ID.format('account_id')})""",
    "dashboard_attached": _attached("dashboard_number", "dashboard_daily_pageviews"),
    "engagement": f"select account_id, engagement_frequency from user_engagement where month {_RECENT}",
    "engagement_capped": _capped("engagement", "engagement_frequency"),
    "engagement_attached": _attached("engagement_capped", "engagement_frequency"),
    "word_match": f"""select account_id, app_name, coalesce({_GENERATED}, false) as is_generated from app_created""",
    "named_apps": f"""select account_id, count(*) - count(*) filter (where {_GENERATED}) as number_of_named_apps
        from app_created where created_at {_RECENT} group by account_id""",
    "named_apps_capped": _capped("named_apps", "number_of_named_apps"),
    "named_apps_attached": _attached("named_apps_capped", "number_of_named_apps"),
    "tech_flags": f"""select account_id, {_BACK} as backend_tech, {_FRONT} as frontend_tech,
          max(cast(not (backend_tech is not distinct from frontend_tech
            and coalesce(backend_tech, '{CONFIG.unknown_tech}') = '{CONFIG.unknown_tech}') as int)) as tech_info
        from app_created where created_at {_RECENT} group by account_id, {_BACK}, {_FRONT}""",
    "tech_info": f"""select account_id, max({_BACK} + {_FRONT}) as tech_info
        from app_created where created_at {_RECENT} group by account_id""",
    "tech_info_attached": _attached("tech_info", "tech_info"),
    "active_apps": f"""select account_id, count(distinct app_id) as number_of_active_apps from daily_logs
        where max_connections >= 5 and all_messages >= 100 and created_at {_RECENT} group by account_id""",
    "active_app": _some("active_apps", "number_of_active_apps", "active_app"),
    "active_app_attached": _attached("active_app", "active_app"),
    "multiple_env": f"""select account_id, case when count(multiple_environments) > 0 then 1 else 0 end
          as multiple_env_flag from app_created where created_at {_RECENT} group by account_id""",
    "multiple_env_attached": _attached("multiple_env", "multiple_env_flag"),
    "collaborators": f"""select account_id, count(distinct collaborator_email) as collaborators
        from app_collaborator_added where created_at {_RECENT} group by account_id""",
    "collaborator_flag": _some("collaborators", "collaborators", "collaborators"),
    "collaborators_attached": _attached("collaborator_flag", "collaborators"),
    "tutorial_views": _counted(
        f"cast({_NOW} as date)", "case when v.web_asset = 'tutorials' then v.id end", "true", "tutorial_views"
    ),
    "tutorial_views_attached": _attached("tutorial_views", "tutorial_views"),
    "docs_views": _counted(_NOW, "v.id", "contains(v.url, 'docs')", "docs_page_views"),
    "docs_views_attached": _attached("docs_views", "docs_page_views"),
    "tut_doc_flag": """select p.account_id, p.email, case when coalesce(t.tutorial_views, 0) > 0
          or coalesce(d.docs_page_views, 0) > 1 then 1 else 0 end as tut_doc_pv
        from spine p left join tutorial_views t on t.account_id = p.account_id
          left join docs_views d on d.account_id = p.account_id""",
    "tut_doc_accounts": """select account_id, 1 as tut_doc_pv from tutorial_views where tutorial_views > 0
        union select account_id, 1 from docs_views where docs_page_views > 1""",
    "conn_soft_limit": f"select distinct account_id from connections_soft_limit where created_at {_RECENT}",
    "msg_soft_limit": f"select distinct account_id from messages_soft_limit where created_at {_RECENT}",
    "conn_soft_limit_attached": """select account_id, email, case when account_id in (
          select account_id from conn_soft_limit) then 1 else 0 end as con_soft_limit_flag from spine""",
    "msg_soft_limit_attached": """select account_id, email, case when account_id in (
          select account_id from msg_soft_limit) then 1 else 0 end as mes_soft_limit_flag from spine""",
    "hit_soft_limit": """select c.account_id, c.email, case when c.con_soft_limit_flag > 0 or m.mes_soft_limit_flag > 1
          then 1 else 0 end as hit_soft_limit
        from conn_soft_limit_attached c join msg_soft_limit_attached m on m.account_id = c.account_id""",
    "full_outer_touch": """select c.id as account_id,
          case when c.heroku then 'HEROKU' else coalesce(t.touch, 'AD BLOCKER') end as first_touch_channel
        from channels c full join touch t on t.account_number = c.id""",
    "channel_distinct": "select distinct account_id, first_touch_channel from full_outer_touch",
    "channel_attached": """select p.account_id, p.email, coalesce(f.first_touch_channel, 'DIRECT') as FTC
        from spine p left join channel_distinct f on f.account_id = p.account_id""",
    "scorecard_events": f"""select p.account_id, p.bus_email_flag, p.email, {', '.join(_NAMES)}
        from business_flag p
          join dashboard_attached using (account_id) join engagement_attached using (account_id)
          join named_apps_attached using (account_id) join tech_info_attached using (account_id)
          join active_app_attached using (account_id) join multiple_env_attached using (account_id)
          join collaborators_attached using (account_id) join tut_doc_flag using (account_id)
          join hit_soft_limit using (account_id)""",
    "scorecard_events_with_channel": """select e.*, coalesce(f.first_touch_channel, 'DIRECT') as FTC
        from scorecard_events e left join channel_distinct f on f.account_id = e.account_id""",
    "weighted_scorecard": f"""select account_id, bus_email_flag, email, FTC,
          {', '.join(f'{points} as {name}' for name, points in zip(_NAMES, _POINTS))},
          {' + '.join(_POINTS)} as total
        from scorecard_events_with_channel""",
    "sheet_business": _sheet("bus_email_flag = 1"),
    "sheet_personal": _sheet("bus_email_flag = 0"),
    "sheet_all": _sheet("true"),
}

# Relations that only the SQL above reads.
_HELPERS = {
    "human_view": f"""select *, case when {_IS_ID.format('account_id')} then try_cast(account_id as bigint) end
          as account_number
        from splash_page_views
        where user_agent <> '{CONFIG.bot_agent}' and cast(created_at as date) <= cast({_NOW} as date)""",
    "touch": f"""select case when {_IS_ID.format('account_id')} then try_cast(account_id as bigint) end
          as account_number, {_TOUCH} as touch from first_touch""",
}

def oracle(name: str, roles: Mapping[str, str] | None = None) -> str:
    """The query with every relation it reads, directly or not, as a CTE.

    `roles` is the SQL of the input tables, by default their mapping over the test tables; roles left out are taken
    to exist as tables.
    """
    known = {**(duckdb_roles() if roles is None else roles), **_HELPERS, **RELATIONS}
    ordered: dict[str, str] = {}

    def visit(relation: str) -> None:
        for source in re.findall(r"(?:from|join)\s+([a-z_]+)", known[relation]):
            if source in known and source != relation and source not in ordered:
                visit(source)
        ordered[relation] = known[relation]

    visit(name)
    ctes = ",\n".join(f"{relation} as ({sql})" for relation, sql in ordered.items())
    return f"with {ctes}\nselect * from {name}"
