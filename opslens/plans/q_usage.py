"""Registered usage, storage, organisation and AI spend queries (USE-*, STO-*, ORG-*, AIC-*)."""

from __future__ import annotations

from opslens.operators import usage as us
from opslens.plans.registry import register
from opslens.sources import testviews as tv
from opslens.sources.testviews import EVENTS_AS_OF, LINEITEM_AS_OF

TB = "(1024.0 * 1024 * 1024 * 1024)"


def _q(spark, sf):
    return tv.load(spark, sf, "query_history")


@register("user_activity", "query_history", "login_history", op="USE-1", sql="""
WITH qa AS (SELECT user_name, role_name, count(*) AS query_count, count(DISTINCT CAST(start_time AS DATE)) AS active_days,
                   round(sum(total_elapsed_time) / 1000.0 / 3600, 2) AS total_hours, count(DISTINCT warehouse_name) AS warehouses_used,
                   count(DISTINCT database_name) AS databases_accessed, min(start_time) AS first_query, max(start_time) AS last_query
            FROM query_history WHERE start_time >= TIMESTAMP '2024-01-01 00:00:00' AND user_name IS NOT NULL GROUP BY 1, 2),
la AS (SELECT user_name, count(*) AS login_count, count_if(is_success = 'NO') AS failed_logins FROM login_history
       WHERE event_timestamp >= TIMESTAMP '2024-01-01 00:00:00' GROUP BY 1)
SELECT qa.*, coalesce(la.login_count, 0) AS login_count, coalesce(la.failed_logins, 0) AS failed_logins,
       CASE WHEN active_days >= 21.0 THEN 'Power User' WHEN active_days >= 9.0 THEN 'Regular' WHEN active_days >= 3 THEN 'Occasional'
            ELSE 'Rare' END AS user_segment
FROM qa LEFT JOIN la ON qa.user_name = la.user_name
""")
def _(spark, sf):
    return us.user_activity(_q(spark, sf), tv.load(spark, sf, "login_history"), EVENTS_AS_OF, 30)


@register("usage_kpis", "query_history", "warehouse_metering", op="USE-2", sql="""
WITH q AS (SELECT * FROM query_history WHERE start_time >= TIMESTAMP '2024-01-24 00:00:00' AND start_time < TIMESTAMP '2024-01-31 00:00:00'),
w AS (SELECT round(sum(a * n) / sum(n) / 1000.0, 3) AS weighted_avg_sec FROM
      (SELECT warehouse_name, count(*) AS n, avg(total_elapsed_time) AS a FROM q GROUP BY 1)),
k AS (SELECT count(*) AS queries, count(DISTINCT user_name) AS users, count(DISTINCT warehouse_name) AS warehouses FROM q),
c AS (SELECT coalesce(round(sum(credits_used), 4), 0.0) AS credits FROM warehouse_metering
      WHERE start_time >= TIMESTAMP '2024-01-24 00:00:00' AND start_time < TIMESTAMP '2024-01-31 00:00:00')
SELECT * FROM k, c, w
""")
def _(spark, sf):
    return us.usage_kpis(_q(spark, sf), tv.load(spark, sf, "warehouse_metering"), EVENTS_AS_OF, 7)


@register("metering_period_compare", "metering_long", op="USE-3", sql="""
WITH g AS (SELECT sum(CASE WHEN start_time >= TIMESTAMP '2001-10-29 00:00:00' THEN credits_used ELSE 0 END) AS c,
                  sum(CASE WHEN start_time < TIMESTAMP '2001-10-29 00:00:00' THEN credits_used ELSE 0 END) AS p
           FROM metering_long WHERE start_time >= TIMESTAMP '2001-10-22 00:00:00' AND start_time < TIMESTAMP '2001-11-05 00:00:00')
SELECT round(c, 4) AS current_credits, round(p, 4) AS prior_credits, round((c - p) / nullif(p, 0) * 100, 1) AS pct_change FROM g
""")
def _(spark, sf):
    return us.metering_period_compare(tv.load(spark, sf, "metering_long"), LINEITEM_AS_OF, 7)


@register("storage_now_vs_prior", "database_storage", op="USE-4", sql=f"""
WITH g AS (SELECT database_name, arg_max(average_database_bytes, usage_date) AS n,
                  arg_max(CASE WHEN usage_date <= DATE '2001-10-06' THEN average_database_bytes END,
                          CASE WHEN usage_date <= DATE '2001-10-06' THEN usage_date END) AS p
           FROM database_storage WHERE usage_date < DATE '2001-11-05' GROUP BY 1)
SELECT database_name, round(n / {TB}, 6) AS current_tb, round(p / {TB}, 6) AS prior_tb, round((n - p) / nullif(p, 0) * 100, 1) AS pct_change
FROM g
""")
def _(spark, sf):
    return us.storage_now_vs_prior(tv.load(spark, sf, "database_storage"), LINEITEM_AS_OF, 30)


@register("pressured_warehouses", "query_history", op="USE-5", sql="""
WITH h AS (SELECT warehouse_name, date_trunc('hour', start_time) AS h, count(*) AS n, count_if(queued_overload_time > 0) AS queued
           FROM query_history WHERE start_time >= TIMESTAMP '2024-01-24 00:00:00' AND warehouse_name IS NOT NULL GROUP BY 1, 2),
w AS (SELECT warehouse_name, sum(queued) * 100.0 / sum(n) AS queued_pct FROM h GROUP BY 1)
SELECT count_if(queued_pct > 10.0) AS pressured_warehouses, count(*) AS warehouses FROM w
""")
def _(spark, sf):
    return us.pressured_warehouses(_q(spark, sf), EVENTS_AS_OF, 7, 10.0)


@register("warehouse_movers", "warehouse_metering", op="USE-6", sql="""
WITH g AS (SELECT warehouse_name, sum(CASE WHEN start_time >= TIMESTAMP '2024-01-24 00:00:00' THEN credits_used ELSE 0 END) AS c,
                  sum(CASE WHEN start_time < TIMESTAMP '2024-01-24 00:00:00' THEN credits_used ELSE 0 END) AS p
           FROM warehouse_metering WHERE start_time >= TIMESTAMP '2024-01-17 00:00:00' AND start_time < TIMESTAMP '2024-01-31 00:00:00'
           GROUP BY 1)
SELECT warehouse_name, round(c, 4) AS current_credits, round(p, 4) AS prior_credits, round(c - p, 4) AS credit_delta
FROM g ORDER BY abs(round(c - p, 4)) DESC, warehouse_name LIMIT 10
""")
def _(spark, sf):
    return us.warehouse_movers(tv.load(spark, sf, "warehouse_metering"), EVENTS_AS_OF, 7)


@register("query_type_mix", "query_history", op="USE-7", sql="""
WITH g AS (SELECT query_type, count(*) AS queries, round(avg(total_elapsed_time / 1000.0), 3) AS avg_sec FROM query_history
           WHERE start_time >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY 1)
SELECT query_type, queries, avg_sec, round(queries * 100.0 / (SELECT sum(queries) FROM g), 1) AS pct_of_queries FROM g
""")
def _(spark, sf):
    return us.query_type_mix(_q(spark, sf), EVENTS_AS_OF, 7)


@register("database_adoption", "query_history", op="USE-8", sql="""
SELECT database_name, count(DISTINCT user_name) AS users, count(DISTINCT role_name) AS roles, count(DISTINCT warehouse_name) AS warehouses,
       count(*) AS queries, count(DISTINCT CAST(start_time AS DATE)) AS active_days
FROM query_history WHERE start_time >= TIMESTAMP '2024-01-01 00:00:00' AND database_name IS NOT NULL GROUP BY 1
""")
def _(spark, sf):
    return us.database_adoption(_q(spark, sf), EVENTS_AS_OF, 30)


@register("service_health_by_warehouse", "query_history", op="USE-9", sql="""
WITH g AS (SELECT warehouse_name, count(*) AS queries, count_if(execution_status <> 'SUCCESS') AS failures,
                  round(avg(total_elapsed_time / 1000.0), 2) AS avg_sec
           FROM query_history WHERE start_time >= TIMESTAMP '2024-01-30 00:00:00' AND start_time < TIMESTAMP '2024-01-31 00:00:00'
             AND warehouse_name IS NOT NULL GROUP BY 1)
SELECT *, round(failures * 100.0 / queries, 1) AS failure_pct,
       CASE WHEN round(failures * 100.0 / queries, 1) >= 25 THEN 'Unhealthy' WHEN round(failures * 100.0 / queries, 1) >= 10 THEN 'Degraded'
            ELSE 'Healthy' END AS health
FROM g
""")
def _(spark, sf):
    return us.service_health_by_warehouse(_q(spark, sf), EVENTS_AS_OF, 24)


@register("storage_trend", "database_storage", op="STO-1", sql=f"""
SELECT usage_date, round(sum(average_database_bytes) / {TB}, 6) AS database_tb, round(sum(average_failsafe_bytes) / {TB}, 6) AS failsafe_tb,
       count(DISTINCT database_name) AS databases
FROM database_storage WHERE usage_date >= DATE '2001-10-06' AND usage_date < DATE '2001-11-05' GROUP BY 1
""")
def _(spark, sf):
    return us.storage_trend(tv.load(spark, sf, "database_storage"), LINEITEM_AS_OF, 30)


@register("largest_tables", "table_storage", op="STO-2", sql="""
SELECT table_catalog, table_schema, table_name, round(time_travel_bytes / (1024.0 * 1024 * 1024), 3) AS gb,
       round((active_bytes + time_travel_bytes + failsafe_bytes + retained_for_clone_bytes) / (1024.0 * 1024 * 1024), 3) AS total_gb
FROM table_storage ORDER BY gb DESC, 1, 2, 3 LIMIT 20
""")
def _(spark, sf):
    return us.largest_tables(tv.load(spark, sf, "table_storage"), "time_travel_bytes", 20)


_ORG = """
org AS (SELECT n.n_name AS account_name, r.r_name AS region, CAST(l.l_shipdate AS DATE) AS usage_date,
               CASE WHEN l.l_returnflag = 'R' THEN 'AI_SERVICES' ELSE 'WAREHOUSE_METERING' END AS service_type,
               l.l_quantity / 10 AS credits_used, l.l_quantity * (1 - l.l_discount) / 10 AS credits_used_compute
        FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey
        JOIN region r ON n.n_regionkey = r.r_regionkey)
"""


def _org(spark, sf):
    rd = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    return us.org_usage(rd("lineitem"), rd("supplier"), rd("nation"), rd("region"))


@register("org_credits", op="ORG-1", sql="WITH " + _ORG + """
SELECT account_name, usage_date, service_type, round(sum(credits_used), 4) AS credits_used FROM org
WHERE usage_date >= DATE '2001-10-06' AND usage_date < DATE '2001-11-05' GROUP BY 1, 2, 3
""")
def _(spark, sf):
    return us.org_credits(_org(spark, sf), LINEITEM_AS_OF, 30)


@register("account_comparison", op="ORG-2", sql="WITH " + _ORG + """,
d AS (SELECT account_name, region, usage_date, sum(credits_used) AS d, sum(credits_used_compute) AS dc FROM org
      WHERE usage_date >= DATE '2001-10-06' AND usage_date < DATE '2001-11-05' GROUP BY 1, 2, 3),
g AS (SELECT account_name, region, sum(d) AS t, sum(dc) AS c, count(*) AS active_days, avg(d) AS a, max(d) AS m FROM d GROUP BY 1, 2)
SELECT account_name, region, round(t, 2) AS total_credits, round(c, 2) AS compute_credits, active_days, round(a, 2) AS avg_daily_credits,
       round(m, 2) AS peak_daily_credits, round(t * 100.0 / nullif((SELECT sum(t) FROM g), 0), 1) AS pct_of_org
FROM g
""")
def _(spark, sf):
    return us.account_comparison(_org(spark, sf), LINEITEM_AS_OF, 30)


@register("ai_user_rollup", "ai_usage", op="AIC-1", sql="""
WITH g AS (SELECT user_name, CAST(start_time AS DATE) AS d, count(*) AS n, sum(credits_used) AS c FROM ai_usage
           WHERE start_time >= TIMESTAMP '2024-01-01 00:00:00' GROUP BY 1, 2),
u AS (SELECT user_name, count(*) AS active_days, sum(n) AS requests, sum(c) AS c FROM g GROUP BY 1)
SELECT user_name, active_days, CAST(requests AS BIGINT) AS requests, round(c, 6) AS credits, round(c / requests, 8) AS credits_per_request,
       round(c / active_days * 30, 6) AS projected_30d_credits, round(c * 2.2, 4) AS est_cost_usd
FROM u
""")
def _(spark, sf):
    return us.ai_user_rollup(tv.load(spark, sf, "ai_usage"), EVENTS_AS_OF, 30)


@register("ai_daily_by_function", "ai_usage", op="AIC-3", sql="""
SELECT CAST(start_time AS DATE) AS usage_date, function_name, count(*) AS requests, round(sum(credits_used), 6) AS credits
FROM ai_usage WHERE start_time >= TIMESTAMP '2024-01-01 00:00:00' GROUP BY 1, 2
""")
def _(spark, sf):
    return us.ai_daily_by_function(tv.load(spark, sf, "ai_usage"), EVENTS_AS_OF, 30)


@register("ai_totals", "ai_usage", op="AIC-4", sql="""
WITH per AS (SELECT user_name, sum(credits_used) AS c, count(*) AS n FROM ai_usage WHERE start_time >= TIMESTAMP '2024-01-01 00:00:00' GROUP BY 1)
SELECT round(sum(c), 6) AS credits, CAST(sum(n) AS BIGINT) AS requests, count(DISTINCT user_name) AS users,
       arg_max(user_name, {'c': c, 'u': user_name}) AS top_user, round(max(c), 6) AS top_user_credits
FROM per
""")
def _(spark, sf):
    return us.ai_totals(tv.load(spark, sf, "ai_usage"), EVENTS_AS_OF, 30)


@register("ai_quota_state", "ai_usage", op="AIC-5", sql="""
WITH g AS (SELECT user_name, round(sum(credits_used), 6) AS mtd_credits FROM ai_usage
           WHERE start_time >= TIMESTAMP '2024-01-01 00:00:00' AND start_time < TIMESTAMP '2024-02-01 00:00:00' GROUP BY 1)
SELECT *, round(mtd_credits * 100.0 / 0.05, 1) AS quota_pct,
       CASE WHEN round(mtd_credits * 100.0 / 0.05, 1) > 100 THEN 'Over quota' WHEN round(mtd_credits * 100.0 / 0.05, 1) >= 80 THEN 'Near quota'
            ELSE 'Within quota' END AS quota_state
FROM g
""")
def _(spark, sf):
    return us.ai_quota_state(tv.load(spark, sf, "ai_usage"), EVENTS_AS_OF, 0.05)
