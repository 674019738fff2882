"""Role mapping: each input table of the scorecard as a query over the test tables.

The same text runs in Spark and in DuckDB. Values are synthetic; only agreement of both engines matters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leadgauge import ScorecardConfig

AS_OF = "2024-01-20 12:00:00"

# A vocabulary as long as the generator's, made by a rule; the mapping below builds app names from 500 such words.
CONFIG = ScorecardConfig(
    own_site="site.example",
    own_hosts=("demo.host.example",),
    name_adjectives=("happy", "brave", "and", *(f"quick{n:03d}" for n in range(375))),
)

TABLES = ("customer", "orders", "lineitem", "events", "pages")

_DASHBOARD = f"https://{CONFIG.dashboard_url.strip('%')}"
_EXCLUDED = f"https://{CONFIG.dashboard_url_excluded.strip('%')}"
_BLOG = f"https://blog.{CONFIG.own_site}"

ROLE_SQL = {
    "account": """
        select cast(c_custkey as int) as id,
               case when c_mktsegment = 'BUILDING' then 2 else 1 end as plan_id,
               case when c_custkey % 97 = 0 then null else lower(c_name) || case c_custkey % 7
                 when 0 then '@gmail.com' when 1 then '@corp.example' when 2 then '@qq.com' when 3 then '@mit.edu'
                 when 4 then '@invalid.example' when 5 then '' else '@acme.example' end end as email,
               timestamp '2017-06-01 00:00:00' + (c_custkey * 37 % 2600) * interval '1' day as created_at
        from {customer}""",
    "page_view": f"""
        select case when event_id % 50 = 0 then 'anon' when event_id % 31 = 0 then cast(user_id as varchar(20)) || '.5'
                 when event_id % 17 = 0 then '0' || cast(user_id as varchar(20))
                 else cast(user_id as varchar(20)) end as account_id,
               ts as created_at,
               case when event_id % 7 = 0 then '{_EXCLUDED}/1' when event_id % 3 = 0 then 'https://example.org/'
                 when event_id % 19 = 0 then null else '{_DASHBOARD}/apps/' end as url
        from {{events}} where event_type in ('view', 'click')""",
    "paid_signup": """
        select cast(user_id * 3 as int) as account_id, case when event_id % 29 = 0 then null else ts end as created_at
        from {events} where event_type = 'signup'""",
    "user_engagement": """
        select cast(user_id as int) as account_id,
               cast(case when user_id % 10 = 0 then null else count(distinct cast(ts as date)) end as int)
                 as engagement_frequency,
               case event_type when 'click' then timestamp '2024-01-01 00:00:00'
                 when 'error' then timestamp '2023-12-25 00:00:00' else timestamp '2023-11-01 00:00:00' end as month
        from {events} group by user_id, event_type""",
    "app_created": """
        select cast(o_custkey as int) as account_id,
               case when o_orderkey % 11 = 0 then null when o_orderkey % 4 = 0 then
                   'quick' || lpad(cast(o_orderkey % 500 as varchar(20)), 3, '0') || '-tiger-1' when o_orderkey % 5 = 0 then 'brave-sunflower'
                 when o_orderkey % 7 = 0 then 'sandy-sandy' when o_orderkey % 13 = 0 then 'Happy-tiger'
                 else 'shop-' || lower(o_orderpriority) end as app_name,
               case o_orderkey % 3 when 0 then 'none' when 1 then 'ruby' else null end as backend_tech,
               case o_orderkey % 5 when 0 then 'react' when 1 then 'none' else null end as frontend_tech,
               case when o_orderkey % 9 = 0 then 'yes' else null end as multiple_environments,
               timestamp '2023-12-01 00:00:00' + (o_orderkey % 60) * interval '1' day as created_at
        from {orders}""",
    "daily_logs": """
        select cast(o_custkey as int) as account_id, l_partkey as app_id,
               timestamp '2023-12-01 00:00:00' + (l_orderkey % 60) * interval '1' day as created_at,
               cast(l_linenumber as bigint) as max_connections, cast(l_partkey % 200 as bigint) as all_messages
        from {lineitem} join {orders} on l_orderkey = o_orderkey""",
    "app_collaborator_added": """
        select cast(o_custkey as int) as account_id,
               case when o_orderkey % 3 = 0 or o_orderstatus <> 'F' then null else 'u' || cast(o_orderkey % 7 as varchar(20)) || '@x.example' end
                 as collaborator_email,
               timestamp '2023-12-01 00:00:00' + (o_orderkey % 60) * interval '1' day as created_at
        from {orders}""",
    "channels": """
        select case when c_custkey % 23 = 0 then null else cast(c_custkey as int) end as id,
               timestamp '2023-12-10 00:00:00' + (c_custkey % 50) * interval '1' day as created_at,
               case c_custkey % 10 when 0 then true when 1 then null else false end as heroku
        from {customer}""",
    "splash_page_views": f"""
        select event_id as id, cast(user_id as varchar(20)) as account_id,
               case when event_id % 3 = 0 then 'tutorials' else 'site' end as web_asset,
               case when event_id % 13 = 0 then null when event_id % 11 = 0 then '{CONFIG.bot_agent}'
                 else 'Mozilla' end as user_agent,
               case when event_id % 2 = 0 then 'https://example.org/docs/' else 'https://example.org/' end as url,
               ts as created_at
        from {{events}} where event_type in ('view', 'purchase')""",
    "web_sessions": """
        select cast(user_id * 2 as int) as account_id, ts as session_created_at,
               case when user_id % 4 = 0 then null when user_id % 4 = 1 then timestamp '2023-12-01 00:00:00'
                 else timestamp '2024-01-10 00:00:00' end as account_created_at
        from {events} where event_type = 'signup'""",
    "connections_soft_limit": """
        select cast(user_id as int) as account_id,
               case when value > 60 then ts when value > 40 then null else timestamp '2023-10-01 00:00:00' end as created_at
        from {events} where event_type = 'error'""",
    "messages_soft_limit": """
        select cast(user_id as int) as account_id,
               case when value > 60 then ts when value > 40 then null else timestamp '2023-10-01 00:00:00' end as created_at
        from {events} where event_type = 'purchase'""",
    "first_touch": f"""
        select case when page_id % 37 = 0 then null when page_id % 29 = 0 then 'anon' when page_id % 31 = 0 then '5000000000'
                 else cast(cast(floor(page_id / 2) as int) as varchar(20)) end as account_id,
               case page_id % 9 when 0 then null when 1 then url || '&utm_medium=cpc&x=1'
                 when 2 then url || '&utm_medium=email' when 3 then url || '?growth'
                 when 4 then url || '&utm_source=list' else url end as url,
               case page_id % 8 when 0 then null when 1 then 'https://github.com/a'
                 when 2 then 'https://www.google.com/' when 3 then 'https://pinterest.com/'
                 when 4 then 'https://rubyweekly.com/1' when 5 then '' when 6 then '{_BLOG}/x' else url end as referrer
        from {{pages}}""",
}


class SparkRoles(dict):
    """Role -> DataFrame, each made when it is first asked for, so a query opens only the files it reads."""

    def __init__(self, spark: SparkSession, directory: str) -> None:
        super().__init__()
        self._spark, self._directory = spark, directory
        self._tables: dict[str, DataFrame] = {}

    @staticmethod
    def texts(names: dict[str, str]) -> dict[str, str]:
        """Spark's SQL of every role, with the tables' names as given."""
        # The tables hold timestamps without zone; the literals must have that type whatever the session's default.
        return {role: sql.replace("timestamp '", "timestamp_ntz '").format(**names) for role, sql in ROLE_SQL.items()}

    def __missing__(self, role: str) -> DataFrame:
        sql = self.texts({name: f"{{{name}}}" for name in TABLES})[role]
        names = [name for name in TABLES if f"{{{name}}}" in sql]
        self[role] = self._spark.sql(sql, **{name: self._table(name) for name in names})
        return self[role]

    def _table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self._spark.read.parquet(f"{self._directory}/{name}.parquet")
        return self._tables[name]


def duckdb_roles() -> dict[str, str]:
    return {role: sql.format(**{name: name for name in TABLES}) for role, sql in ROLE_SQL.items()}
