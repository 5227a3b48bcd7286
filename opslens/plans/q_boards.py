"""Registered incident, board and remaining roll-up queries."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from opslens.functions import scope
from opslens.functions.timeutil import lookback, trunc
from opslens.operators import boards as bd
from opslens.operators import capacity as cap
from opslens.operators import chargeback as chb
from opslens.operators import cost
from opslens.operators import incidents as inc
from opslens.operators import security as sec
from opslens.operators import usage as us
from opslens.plans import q_alerts, q_capacity, q_change
from opslens.plans.fixtures import ENV_SQL, OWNER_RULES, OWNER_RULES_CTE, TENANT_SQL, environments, tenants
from opslens.plans.q_anomaly import COST_ANOMALIES_SQL as ORACLES_RAW_ANOM
from opslens.plans.q_cost import _LENS, pqc_cte
from opslens.plans.q_security import OWNER_MATCH_SQL
from opslens.plans.registry import register
from opslens.session import ensure_checkpoint_dir
from opslens.sources import testviews as tv
from opslens.sources.testviews import EVENTS_AS_OF, LINEITEM_AS_OF, ORDERS_AS_OF

TARGET = datetime(2024, 1, 20)
_CATEGORY = ("CASE WHEN regexp_matches(upper(coalesce(service_type, 'UNKNOWN')), '(^|[^A-Z])AI([^A-Z]|$)') "
             "OR contains(upper(coalesce(service_type, 'UNKNOWN')), 'INTELLIGENCE') THEN 'AI Services' "
             "WHEN upper(coalesce(service_type, 'UNKNOWN')) IN ('AUTOMATIC_CLUSTERING', 'COPY_FILES', "
             "'MATERIALIZED_VIEW', 'QUERY_ACCELERATION', 'SEARCH_OPTIMIZATION', 'SERVERLESS_ALERTS', 'SERVERLESS_TASK', 'SNOWPIPE', "
             "'SNOWPIPE_STREAMING', 'SNOWPARK_CONTAINER_SERVICES', 'REPLICATION') THEN 'Serverless / Managed Compute' "
             "WHEN contains(upper(coalesce(service_type, 'UNKNOWN')), 'STORAGE') THEN 'Storage' "
             "WHEN contains(upper(coalesce(service_type, 'UNKNOWN')), 'DATA_TRANSFER') OR contains(upper(coalesce(service_type, 'UNKNOWN')), 'PRIVATELINK') "
             "THEN 'Data Transfer / Network' WHEN upper(coalesce(service_type, 'UNKNOWN')) = 'WAREHOUSE_METERING' THEN 'Warehouse' ELSE 'Other' END")
CT = ", ".join(f"'{t}'" for t in inc.CHANGE_TYPES)


def _q(spark, sf):
    return tv.load(spark, sf, "query_history")


def _m(spark, sf):
    return tv.load(spark, sf, "warehouse_metering")


def _raw(spark, sf, t):
    return spark.read.parquet(f"{sf}/{t}.parquet")


_EXPLORER = ("WITH " + pqc_cte() + """,
t AS (SELECT warehouse_name, max(CASE WHEN tag_name = 'COST_CENTER' THEN tag_value END) AS cost_center,
             max(CASE WHEN tag_name = 'DEPARTMENT' THEN tag_value END) AS department FROM warehouse_tags GROUP BY 1),
qq AS (SELECT query_id, warehouse_name, """ + TENANT_SQL + """ AS company, """ + ENV_SQL + """ AS environment FROM query_history),
ex AS (SELECT company, environment, qq.warehouse_name, cost_center, department, count(*) AS queries,
              round(sum(p.metered_credits), 6) AS credits
       FROM pqc p JOIN qq ON p.query_id = qq.query_id LEFT JOIN t ON qq.warehouse_name = t.warehouse_name GROUP BY 1, 2, 3, 4, 5)
""")


_DDL = f"""
ddl AS (SELECT query_id, query_type, user_name, role_name, database_name, schema_name, warehouse_name, start_time,
               substr(query_text, 1, 200) AS query_preview, total_elapsed_time / 1000.0 AS elapsed_sec
        FROM query_history WHERE start_time >= TIMESTAMP '2024-01-19 00:00:00' AND start_time < TIMESTAMP '2024-01-21 00:00:00'
          AND query_type IN ({CT}))
"""
_USERS = """
base AS (SELECT DISTINCT user_name FROM query_history
         WHERE start_time >= TIMESTAMP '2024-01-12 00:00:00' AND start_time < TIMESTAMP '2024-01-19 00:00:00'),
inc AS (SELECT user_name, warehouse_name, count(*) AS query_count, round(sum(total_elapsed_time) / 1000.0, 1) AS total_sec,
               min(start_time) AS first_seen
        FROM query_history WHERE start_time >= TIMESTAMP '2024-01-19 00:00:00' AND start_time < TIMESTAMP '2024-01-21 00:00:00'
          AND warehouse_name IS NOT NULL GROUP BY 1, 2),
nu AS (SELECT inc.*, CASE WHEN base.user_name IS NULL THEN 'New' ELSE 'Existing' END AS user_status
       FROM inc LEFT JOIN base ON inc.user_name = base.user_name
       WHERE base.user_name IS NULL OR inc.query_count > 3)
"""
_VOL = """
h AS (SELECT CAST(date_trunc('hour', start_time) AS TIMESTAMP) AS hour_bucket, warehouse_name, count(*) AS query_count,
             sum(total_elapsed_time) / 1000.0 AS s
      FROM query_history WHERE start_time >= TIMESTAMP '2024-01-17 00:00:00' AND start_time < TIMESTAMP '2024-01-21 00:00:00'
        AND warehouse_name IS NOT NULL GROUP BY 1, 2),
vol AS (SELECT hour_bucket, warehouse_name, query_count, round(s, 1) AS total_exec_sec,
               lag(query_count) OVER (PARTITION BY warehouse_name ORDER BY hour_bucket) AS prev_hour_count,
               round((query_count - lag(query_count) OVER (PARTITION BY warehouse_name ORDER BY hour_bucket)) * 100.0
                     / nullif(lag(query_count) OVER (PARTITION BY warehouse_name ORDER BY hour_bucket), 0), 1) AS pct_change
        FROM h ORDER BY abs(pct_change) DESC NULLS LAST, hour_bucket, warehouse_name)
"""


@register("incident_ddl_changes", "query_history", op="ANO-10", sql="WITH " + _DDL + "SELECT * FROM ddl")
def _(spark, sf):
    return inc.ddl_changes(_q(spark, sf), TARGET, 1)


@register("incident_new_workload", "query_history", op="ANO-11", sql="WITH " + _USERS + "SELECT * FROM nu")
def _(spark, sf):
    return inc.new_workload(_q(spark, sf), TARGET, 1, heavy=3)


@register("incident_volume_changes", "query_history", op="ANO-12", sql="WITH " + _VOL + "SELECT * FROM vol")
def _(spark, sf):
    return inc.volume_changes(_q(spark, sf), TARGET)


@register("incident_correlation", "query_history", op="ANO-13", sql="WITH " + _DDL + "," + _USERS + "," + _VOL + """
SELECT 'change' AS cause_type, start_time AS event_time, concat_ws(' ', query_type, user_name) AS detail,
       CASE WHEN abs(date_diff('microsecond', start_time, TIMESTAMP '2024-01-20 00:00:00')) / 1e6 <= 21600 THEN 'High' ELSE 'Medium' END AS confidence
FROM ddl
UNION ALL
SELECT 'workload', first_seen, concat_ws(' ', user_status, user_name, warehouse_name),
       CASE WHEN user_status = 'New' THEN 'Medium' ELSE 'Low' END FROM nu
UNION ALL
SELECT 'volume', hour_bucket, concat_ws(' ', warehouse_name, CAST(pct_change AS VARCHAR)),
       CASE WHEN pct_change > 100 THEN 'High' WHEN pct_change > 50 THEN 'Medium' ELSE 'Low' END FROM vol WHERE pct_change IS NOT NULL
""")
def _(spark, sf):
    q = _q(spark, sf)
    return inc.incident_correlation(inc.ddl_changes(q, TARGET, 1), inc.new_workload(q, TARGET, 1, heavy=3),
                                    inc.volume_changes(q, TARGET), TARGET)


CUR = (datetime(2024, 1, 16), datetime(2024, 1, 31))
PRI = (datetime(2024, 1, 1), datetime(2024, 1, 16))


@register("bill_waterfall", "warehouse_metering", op="BRD-1", sql="""
WITH c AS (SELECT warehouse_name, sum(credits_used) AS credits FROM warehouse_metering
           WHERE start_time >= TIMESTAMP '2024-01-16 00:00:00' AND start_time < TIMESTAMP '2024-01-31 00:00:00' GROUP BY 1),
p AS (SELECT warehouse_name, sum(credits_used) AS credits FROM warehouse_metering
      WHERE start_time >= TIMESTAMP '2024-01-01 00:00:00' AND start_time < TIMESTAMP '2024-01-16 00:00:00' GROUP BY 1),
d AS (SELECT coalesce(c.warehouse_name, p.warehouse_name) AS warehouse_name, round(coalesce(c.credits, 0), 4) AS current_credits,
             round(coalesce(p.credits, 0), 4) AS prior_credits, round(coalesce(c.credits, 0) - coalesce(p.credits, 0), 4) AS credit_delta
      FROM c FULL OUTER JOIN p ON c.warehouse_name = p.warehouse_name ORDER BY abs(coalesce(c.credits, 0) - coalesce(p.credits, 0)) DESC, 1 LIMIT 25),
mv AS (SELECT warehouse_name AS step, credit_delta AS amount FROM d ORDER BY abs(credit_delta) DESC, warehouse_name LIMIT 5)
SELECT 0 AS step_order, 'Prior period' AS step, round(sum(prior_credits), 4) AS amount FROM d
UNION ALL SELECT 1, step, round(amount, 4) FROM mv
UNION ALL SELECT 2, 'All other', round(sum(current_credits) - sum(prior_credits) - (SELECT coalesce(sum(amount), 0.0) FROM mv), 4) FROM d
UNION ALL SELECT 3, 'Current period', round(sum(current_credits), 4) FROM d
""")
def _(spark, sf):
    return bd.bill_waterfall(cost.warehouse_period_delta(_m(spark, sf), CUR, PRI))


@register("service_pivot", "service_metering", op="BRD-2", sql=f"""
WITH s AS (SELECT *, CASE WHEN start_time >= TIMESTAMP '2001-10-29 00:00:00' THEN 'CURRENT' ELSE 'PRIOR' END AS period,
                  {_CATEGORY} AS service_category
           FROM service_metering WHERE start_time >= TIMESTAMP '2001-10-22 00:00:00' AND start_time < TIMESTAMP '2001-11-05 00:00:00')
SELECT service_category, round(coalesce(sum(CASE WHEN period = 'CURRENT' THEN credits_used END), 0.0), 4) AS current_credits,
       round(coalesce(sum(CASE WHEN period = 'PRIOR' THEN credits_used END), 0.0), 4) AS prior_credits
FROM s GROUP BY 1
""")
def _(spark, sf):
    return bd.service_pivot(tv.load(spark, sf, "service_metering"), LINEITEM_AS_OF, 7)


@register("attribution_gaps", "query_history", "warehouse_metering", op="BRD-4", sql="WITH " + pqc_cte("TIMESTAMP '2024-01-01 00:00:00'", "TIMESTAMP '2024-01-30 00:00:00'") + """,
md AS (SELECT date_trunc('day', start_time) AS usage_day, warehouse_name, round(sum(credits_used), 6) AS m
       FROM warehouse_metering WHERE start_time >= TIMESTAMP '2024-01-01 00:00:00' AND start_time < TIMESTAMP '2024-01-30 00:00:00' GROUP BY 1, 2),
ad AS (SELECT date_trunc('day', qh.start_time) AS usage_day, qh.warehouse_name, count(*) AS n, round(sum(coalesce(p.metered_credits, 0)), 6) AS a
       FROM query_history qh LEFT JOIN pqc p ON qh.query_id = p.query_id
       WHERE qh.start_time >= TIMESTAMP '2024-01-01 00:00:00' AND qh.start_time < TIMESTAMP '2024-01-30 00:00:00' AND qh.warehouse_name IS NOT NULL GROUP BY 1, 2),
j AS (SELECT coalesce(md.m, 0) AS m, coalesce(ad.a, 0) AS a, coalesce(ad.n, 0) AS n
      FROM md FULL OUTER JOIN ad ON md.usage_day = ad.usage_day AND md.warehouse_name = ad.warehouse_name),
k AS (SELECT *, round(m - a, 6) AS v, CASE WHEN m = 0 THEN 'No metering' WHEN abs(m - a) <= greatest(0.05, m * 0.05) THEN 'Reconciled'
                     WHEN n = 0 THEN 'Idle or non-query warehouse usage' ELSE 'Variance review' END AS st FROM j)
SELECT round(sum(m), 4) AS metered, round(sum(a), 4) AS allocated, round(sum(v), 4) AS gap,
       count_if(st = 'Variance review') AS days_in_review, count_if(st = 'Idle or non-query warehouse usage') AS idle_days FROM k
""")
def _(spark, sf):
    return bd.attribution_gaps(cost.cost_reconciliation(_m(spark, sf), _q(spark, sf), EVENTS_AS_OF, 30))


@register("top_driver_by_database", "query_history", op="BRD-5", sql="""
WITH g AS (SELECT database_name, sum(total_elapsed_time) AS v FROM query_history GROUP BY 1)
SELECT arg_max(database_name, {'v': v, 'd': database_name}) AS top_value, round(max(v), 4) AS top_amount,
       round(max(v) * 100.0 / sum(v), 1) AS top_share_pct, count(*) AS "values" FROM g
""")
def _(spark, sf):
    return bd.top_driver(_q(spark, sf).withColumn("total_elapsed_time", F.col("total_elapsed_time").cast("double")),
                         "database_name", "total_elapsed_time")


@register("cost_trust_classes", "query_history", "warehouse_metering", op="BRD-6", sql="WITH " + pqc_cte() + r"""
SELECT CASE WHEN credit_source = 'QUERY_ATTRIBUTION' THEN 'Exact' WHEN metered_credits > 0 THEN 'Estimated' ELSE 'Not defensible' END AS trust_class,
       count(*) AS queries, round(sum(metered_credits), 6) AS credits
FROM pqc GROUP BY 1
""")
def _(spark, sf):
    return bd.cost_trust(cost.per_query_credits(_q(spark, sf), _m(spark, sf), EVENTS_AS_OF, 7))


@register("source_health", "query_history", "warehouse_metering", "login_history", op="BRD-9", sql="""
SELECT source, "rows", last_event, date_diff('hour', last_event, TIMESTAMP '2024-01-31 00:00:00') AS hours_since_last,
       CASE WHEN last_event IS NULL THEN 'Missing' WHEN date_diff('hour', last_event, TIMESTAMP '2024-01-31 00:00:00') <= 24 THEN 'Fresh'
            WHEN date_diff('hour', last_event, TIMESTAMP '2024-01-31 00:00:00') <= 72 THEN 'Stale' ELSE 'Blocked' END AS gate
FROM (SELECT 'queries' AS source, max(start_time) AS last_event, count(*) AS "rows" FROM query_history WHERE start_time < TIMESTAMP '2024-01-31 00:00:00'
      UNION ALL SELECT 'metering', max(start_time), count(*) FROM warehouse_metering WHERE start_time < TIMESTAMP '2024-01-31 00:00:00'
      UNION ALL SELECT 'logins', max(event_timestamp), count(*) FROM login_history WHERE event_timestamp < TIMESTAMP '2024-01-31 00:00:00')
""")
def _(spark, sf):
    return bd.source_health({"queries": (_q(spark, sf), "start_time"), "metering": (_m(spark, sf), "start_time"),
                             "logins": (tv.load(spark, sf, "login_history"), "event_timestamp")}, EVENTS_AS_OF)


@register("task_failure_timeline", "task_history", "query_history", op="BRD-10", sql="""
SELECT scheduled_time AS event_time, CASE WHEN state = 'FAILED' THEN 'failure' WHEN state = 'SUCCEEDED' THEN 'run' ELSE 'other' END AS event_type,
       coalesce(error_message, state) AS detail,
       CASE WHEN state = 'FAILED' THEN 0 ELSE 2 END AS event_order
FROM task_history WHERE name = 'TASK_7' AND scheduled_time >= TIMESTAMP '2001-05-04 00:00:00'
UNION ALL
SELECT start_time, 'change', substr(query_text, 1, 120), 1 FROM query_history
WHERE start_time >= TIMESTAMP '2023-11-02 00:00:00' AND start_time < TIMESTAMP '2024-01-31 00:00:00'
  AND query_type IN ('ALTER_TABLE', 'CREATE_TABLE', 'DROP_TABLE')
""")
def _(spark, sf):
    return bd.task_failure_timeline(tv.load(spark, sf, "task_history"), _q(spark, sf), "TASK_7", ORDERS_AS_OF, 90, changes_as_of=EVENTS_AS_OF)


def _tri(spark, sf):
    from opslens.operators import alerts as al
    return al.triage(tv.load(spark, sf, "alerts"), ORDERS_AS_OF, 30)


@register("incident_board", "alerts", op="BRD-11", sql="WITH " + q_alerts._TRI + """
SELECT alert_type, owner AS route, count(*) AS open, count_if(severity IN ('Critical', 'High')) AS critical_high,
       count_if(sla_state = 'Overdue') AS overdue, min(alert_ts) AS oldest
FROM tri WHERE upper(status) NOT IN ('FIXED', 'IGNORED', 'RESOLVED') GROUP BY 1, 2
""")
def _(spark, sf):
    return bd.incident_board(_tri(spark, sf))


@register("queue_route_readiness", "login_history", op="BRD-12", sql=q_alerts._QUEUE + """,
g AS (SELECT severity AS route, count(*) AS actions, count_if(status = 'Fixed') AS closed,
             count_if(status <> 'Fixed' AND seen_count > 1) AS recurring_open FROM q GROUP BY 1)
SELECT *, round(closed * 100.0 / actions, 1) AS closure_pct,
       CASE WHEN round(closed * 100.0 / actions, 1) >= 80 THEN 'Ready' WHEN round(closed * 100.0 / actions, 1) >= 40 THEN 'Partial'
            ELSE 'Backlog' END AS readiness FROM g
""")
def _(spark, sf):
    return bd.queue_route_readiness(q_alerts._queue(spark, sf))


@register("alert_lifecycle", "alerts", "login_history", op="BRD-13", sql="WITH " + q_alerts._TRI + "," + q_alerts._QUEUE[5:] + """,
oq AS (SELECT DISTINCT upper(entity) AS e FROM q WHERE status <> 'Fixed')
SELECT CASE WHEN upper(status) IN ('FIXED', 'RESOLVED') THEN 'Closed' WHEN oq.e IS NOT NULL THEN 'In queue'
            WHEN sla_state = 'Overdue' THEN 'Breached' ELSE 'Open' END AS lifecycle_state, owner AS route, count(*) AS alerts
FROM tri LEFT JOIN oq ON upper(tri.entity) = oq.e GROUP BY 1, 2
""")
def _(spark, sf):
    return bd.alert_lifecycle(_tri(spark, sf), q_alerts._queue(spark, sf))


@register("alert_signal_counts", "alerts", op="BRD-14", sql="WITH " + q_alerts._TRI + """,
o AS (SELECT count_if(sla_state = 'Overdue') AS overdue, count_if(sla_state = 'Due Soon') AS due_soon,
             count_if(upper(owner) = 'DBA') AS unowned, count_if(severity = 'Critical') AS critical FROM tri)
SELECT 'overdue' AS signal, overdue AS alerts FROM o UNION ALL SELECT 'due_soon', due_soon FROM o
UNION ALL SELECT 'unowned', unowned FROM o UNION ALL SELECT 'critical', critical FROM o
""")
def _(spark, sf):
    return bd.alert_signal_counts(_tri(spark, sf))


@register("checklist_history", "login_history", op="BRD-15", sql=q_alerts._QUEUE + """
SELECT CAST(last_seen_at AS DATE) AS check_date, category, count(*) AS findings, count_if(status = 'Fixed') AS fixed,
       count_if(seen_count > 1) AS recurring FROM q GROUP BY 1, 2
""")
def _(spark, sf):
    return bd.checklist_history(q_alerts._queue(spark, sf))


@register("review_execution_match", "warehouses", "query_history", "warehouse_metering", op="BRD-16", sql="WITH " + q_capacity._SUSPEND + """,
rec AS (SELECT upper(warehouse_name) AS wh, min(recommendation_type) AS recommendation FROM sus GROUP BY 1),
ex AS (SELECT upper(warehouse_name) AS wh, count(*) AS executions, max(start_time) AS last_executed FROM query_history
       WHERE start_time >= TIMESTAMP '2024-01-01 00:00:00' AND query_type = 'ALTER_WAREHOUSE' GROUP BY 1)
SELECT rec.wh AS warehouse_name, recommendation, coalesce(executions, 0) AS executions, last_executed,
       CASE WHEN executions IS NULL THEN 'Not executed' ELSE 'Executed' END AS audit_state
FROM rec LEFT JOIN ex ON rec.wh = ex.wh
""")
def _(spark, sf):
    s = cap.suspend_timeout_analysis(tv.load(spark, sf, "warehouses"), _q(spark, sf), _m(spark, sf), EVENTS_AS_OF, 7)
    return bd.review_execution_match(s, _q(spark, sf), EVENTS_AS_OF, 30)


@register("warehouse_owner_inventory", "query_history", op="BRD-17", sql="WITH " + OWNER_RULES_CTE + """,
u AS (SELECT warehouse_name, user_name, count(*) AS n FROM query_history
      WHERE start_time >= TIMESTAMP '2024-01-01 00:00:00' AND warehouse_name IS NOT NULL GROUP BY 1, 2),
g AS (SELECT warehouse_name, count(*) AS users, CAST(sum(n) AS BIGINT) AS queries, arg_max(user_name, {'n': n, 'u': user_name}) AS top_user
      FROM u GROUP BY 1),
cand AS (SELECT w.warehouse_name, r.owner_name,
                row_number() OVER (PARTITION BY w.warehouse_name ORDER BY coalesce(r.match_priority, 0) DESC, r.entity_pattern DESC) AS rn
         FROM (SELECT DISTINCT warehouse_name FROM query_history) w
         JOIN owner_rules r ON upper(r.entity_type) = 'WAREHOUSE' AND coalesce(r.is_active, TRUE)
          AND ((r.entity_pattern = '*' AND r.match_priority > 0) OR upper(w.warehouse_name) = upper(r.entity_pattern)
               OR (r.entity_pattern LIKE '%*%' AND upper(w.warehouse_name) LIKE replace(upper(r.entity_pattern), '*', '%'))))
SELECT g.*, c.owner_name, CASE WHEN c.owner_name IS NULL THEN 'Needs owner' ELSE 'Owned' END AS owner_state
FROM g LEFT JOIN (SELECT * FROM cand WHERE rn = 1) c ON g.warehouse_name = c.warehouse_name
""")
def _(spark, sf):
    q = _q(spark, sf)
    owners = chb.resolve_owner(q, "warehouse_name", chb.rules_frame(spark, OWNER_RULES))
    return bd.warehouse_owner_inventory(q, owners, EVENTS_AS_OF, 30)


@register("guardrail_coverage", "warehouses", op="BRD-18", sql="""
SELECT warehouse_name, 'auto_suspend_on' AS guardrail, auto_suspend > 0 AS passed FROM warehouses
UNION ALL SELECT warehouse_name, 'fast_suspend', auto_suspend > 0 AND auto_suspend <= 600 FROM warehouses
UNION ALL SELECT warehouse_name, 'cluster_cap', max_cluster_count <= 2 FROM warehouses
""")
def _(spark, sf):
    return bd.guardrail_coverage(tv.load(spark, sf, "warehouses"))


@register("latest_active_grants", "grants_to_users", op="BRD-19", sql="""
SELECT grantee_name, role, (max({'c': created_on, 'g': granted_by})).c AS granted_on, (max({'c': created_on, 'g': granted_by})).g AS granted_by
FROM grants_to_users WHERE deleted_on IS NULL GROUP BY 1, 2
""")
def _(spark, sf):
    return bd.latest_active_grants(tv.load(spark, sf, "grants_to_users"))


@register("usage_change_explanation", "query_history", "warehouse_metering", op="BRD-20", sql="""
WITH q AS (SELECT CAST(count_if(start_time >= TIMESTAMP '2024-01-24 00:00:00') AS DOUBLE) AS q_c,
                  CAST(count_if(start_time < TIMESTAMP '2024-01-24 00:00:00') AS DOUBLE) AS q_p,
                  CAST(count(DISTINCT CASE WHEN start_time >= TIMESTAMP '2024-01-24 00:00:00' THEN user_name END) AS DOUBLE) AS u_c,
                  CAST(count(DISTINCT CASE WHEN start_time < TIMESTAMP '2024-01-24 00:00:00' THEN user_name END) AS DOUBLE) AS u_p
           FROM query_history WHERE start_time >= TIMESTAMP '2024-01-17 00:00:00' AND start_time < TIMESTAMP '2024-01-31 00:00:00'),
m AS (SELECT sum(CASE WHEN start_time >= TIMESTAMP '2024-01-24 00:00:00' THEN credits_used ELSE 0 END) AS c_c,
             sum(CASE WHEN start_time < TIMESTAMP '2024-01-24 00:00:00' THEN credits_used ELSE 0 END) AS c_p
      FROM warehouse_metering WHERE start_time >= TIMESTAMP '2024-01-17 00:00:00' AND start_time < TIMESTAMP '2024-01-31 00:00:00'),
s AS (SELECT 'credits' AS measure, c_c AS cv, c_p AS pv FROM q, m UNION ALL SELECT 'queries', q_c, q_p FROM q, m
      UNION ALL SELECT 'users', u_c, u_p FROM q, m)
SELECT measure, round(cv, 4) AS current_value, round(pv, 4) AS prior_value, round((cv - pv) / nullif(pv, 0) * 100, 1) AS pct_change FROM s
""")
def _(spark, sf):
    return bd.usage_change_explanation(_q(spark, sf), _m(spark, sf), EVENTS_AS_OF, 7)


@register("realised_value", "login_history", "warehouses", "query_history", "warehouse_metering", op="BRD-21", sql="WITH ver AS (" + q_alerts.SAVINGS_VERIFICATION_SQL + "), " + """
acts AS (SELECT 'act-' || w.warehouse_name AS action_id, 'warehouse' AS category, 'Open' AS status FROM warehouses w
         LEFT JOIN (SELECT warehouse_name, count(*) AS query_count FROM query_history
                    WHERE start_time >= TIMESTAMP '2024-01-24 00:00:00' AND warehouse_name IS NOT NULL GROUP BY 1) up
           ON w.warehouse_name = up.warehouse_name
         WHERE w.auto_suspend = 0 OR (w.auto_suspend > 120 AND coalesce(up.query_count, 0) < 1000))
SELECT category, count(*) AS actions, count_if(status = 'Fixed') AS fixed, count_if(outcome = 'Savings verified') AS verified,
       round(avg(savings_pct), 1) AS avg_savings_pct
FROM acts LEFT JOIN ver ON acts.action_id = ver.action_id GROUP BY 1
""")
def _(spark, sf):
    from datetime import timedelta
    from opslens.functions.timeutil import ts_lit
    from opslens.operators import alerts as al
    s = cap.suspend_timeout_analysis(tv.load(spark, sf, "warehouses"), _q(spark, sf), _m(spark, sf), EVENTS_AS_OF, 7)
    acts = s.select(F.col("warehouse_name").alias("entity"), F.concat(F.lit("act-"), "warehouse_name").alias("action_id"),
                    ts_lit(EVENTS_AS_OF - timedelta(days=10)).alias("acted_at"))
    ver = al.savings_verification(_m(spark, sf), acts, EVENTS_AS_OF, 28)
    queue = acts.select("action_id", F.lit("warehouse").alias("category"), F.lit("Open").alias("status"))
    return bd.realised_value(queue, ver)


@register("operations_now", "query_history", "task_history", op="BRD-22", sql="""
SELECT (SELECT count(*) FROM query_history WHERE start_time >= TIMESTAMP '2024-01-30 23:00:00' AND start_time < TIMESTAMP '2024-01-31 00:00:00') AS active,
       (SELECT count_if(queued_overload_time > 0) FROM query_history WHERE start_time >= TIMESTAMP '2024-01-30 23:00:00' AND start_time < TIMESTAMP '2024-01-31 00:00:00') AS queued,
       (SELECT count_if(transaction_blocked_time > 0) FROM query_history WHERE start_time >= TIMESTAMP '2024-01-30 23:00:00' AND start_time < TIMESTAMP '2024-01-31 00:00:00') AS blocked,
       (SELECT count(*) FROM task_history WHERE scheduled_time <= TIMESTAMP '2001-08-01 12:00:00'
          AND (completed_time IS NULL OR completed_time > TIMESTAMP '2001-08-01 12:00:00')
          AND scheduled_time >= TIMESTAMP '2001-07-31 12:00:00') AS running_tasks
""")
def _(spark, sf):
    return bd.operations_now(_q(spark, sf), tv.load(spark, sf, "task_history"), EVENTS_AS_OF, datetime(2001, 8, 1, 12))


@register("monitoring_cost", "query_history", "warehouse_metering", op="CST-4", sql="WITH " + pqc_cte() + """,
j AS (SELECT qh.warehouse_name AS component, p.metered_credits FROM pqc p JOIN query_history qh ON p.query_id = qh.query_id
      WHERE starts_with(qh.query_tag, 'team:etl')),
per AS (SELECT component, count(*) AS queries, round(sum(metered_credits), 6) AS credits FROM j GROUP BY 1),
u AS (SELECT * FROM per UNION ALL SELECT 'TOTAL', CAST(sum(queries) AS BIGINT), round(sum(credits), 6) FROM per)
SELECT u.*, (SELECT string_agg(DISTINCT component, ', ' ORDER BY component) FROM per) AS components, round(credits * 3.68, 2) AS est_cost_usd
FROM u
""")
def _(spark, sf):
    return bd.monitoring_cost(_q(spark, sf), _m(spark, sf), EVENTS_AS_OF)


@register("daily_service_spend", "service_metering", op="CST-15", sql="""
WITH per AS (SELECT CAST(start_time AS DATE) AS usage_date, service_type, sum(credits_used) AS c FROM service_metering
             WHERE start_time >= TIMESTAMP '2001-10-06 00:00:00' AND start_time < TIMESTAMP '2001-11-05 00:00:00' GROUP BY 1, 2)
SELECT usage_date, round(sum(c), 4) AS credits,
       round(sum(c * CASE WHEN regexp_matches(upper(coalesce(service_type, '')), '(^|[^A-Z])AI([^A-Z]|$)')
                               OR contains(upper(coalesce(service_type, '')), 'INTELLIGENCE') THEN 2.2 ELSE 3.68 END), 2) AS spend_usd,
       count(*) AS services
FROM per GROUP BY 1
""")
def _(spark, sf):
    return bd.daily_service_spend(tv.load(spark, sf, "service_metering"), LINEITEM_AS_OF, 30)


def _explorer(spark, sf):
    pqc = cost.per_query_credits(_q(spark, sf), _m(spark, sf), EVENTS_AS_OF, 7, keep=[
        scope.tenant_label(tenants()).alias("company"), scope.environment_label(environments()).alias("environment")])
    return bd.cost_explorer(pqc, tv.load(spark, sf, "warehouse_tags"))


@register("cost_explorer", "query_history", "warehouse_metering", "warehouse_tags", op="CST-18", sql=_EXPLORER + "SELECT * FROM ex")
def _(spark, sf):
    return _explorer(spark, sf)


@register("chargeback_detail", "query_history", "warehouse_metering", op="CHB-5", sql="WITH " + pqc_cte() + """,
qq AS (SELECT query_id, CAST(start_time AS DATE) AS usage_date, database_name, user_name, role_name, warehouse_name, warehouse_size,
              """ + TENANT_SQL + """ AS company, """ + ENV_SQL + """ AS environment FROM query_history)
SELECT usage_date, company, environment, database_name, user_name, role_name, qq.warehouse_name, warehouse_size,
       count(*) AS query_count, round(sum(p.metered_credits), 6) AS allocated_credits,
       round(sum(p.metered_credits) * 3.68, 2) AS est_cost_usd
FROM pqc p JOIN qq ON p.query_id = qq.query_id GROUP BY 1, 2, 3, 4, 5, 6, 7, 8
""")
def _(spark, sf):
    return chb.chargeback_detail(_q(spark, sf), _m(spark, sf), EVENTS_AS_OF, scope.tenant_label(tenants()),
                                 scope.environment_label(environments()), 7)


@register("cost_lens_summary", "query_history", "warehouse_metering", "warehouse_tags", op="CST-19", sql=_EXPLORER + """,
g AS (SELECT company, environment, sum(credits) AS c, count_if(cost_center IS NULL) AS u FROM ex GROUP BY 1, 2)
SELECT company, environment, round(c, 6) AS credits, round(c * 100 / nullif((SELECT sum(c) FROM g), 0), 1) AS share_pct,
       CASE WHEN u = 0 THEN 'Chargeback ready' ELSE 'Needs tags' END AS readiness FROM g
""")
def _(spark, sf):
    return bd.lens_summary(_explorer(spark, sf), ["company", "environment"])


@register("cost_gap_board", "query_history", "warehouse_metering", "warehouse_tags", op="CST-20", sql=_EXPLORER + """,
x AS (SELECT ex.*, gap_rule FROM ex, unnest(list_filter([CASE WHEN cost_center IS NULL THEN 'missing_cost_center' END,
                                                        CASE WHEN department IS NULL THEN 'missing_department' END,
                                                        CASE WHEN company = 'Shared/Unclassified' THEN 'unclassified_tenant' END],
                                                       lambda z: z IS NOT NULL)) AS u(gap_rule))
SELECT gap_rule, count(*) AS "rows", round(sum(credits), 6) AS credits, arg_max(warehouse_name, {'c': credits, 'w': warehouse_name}) AS top_driver
FROM x GROUP BY 1
""")
def _(spark, sf):
    return bd.cost_gap_board(_explorer(spark, sf))


@register("burn_with_size", "warehouse_metering", "query_history", op="CST-21", sql="""
WITH sz AS (SELECT warehouse_name, arg_max(warehouse_size, {'t': start_time, 'q': query_id}) AS current_size FROM query_history
            WHERE start_time >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY 1),
d AS (SELECT CAST(start_time AS DATE) AS usage_date, warehouse_name, round(sum(credits_used), 4) AS credits FROM warehouse_metering
      WHERE start_time >= TIMESTAMP '2024-01-24 00:00:00' AND start_time < TIMESTAMP '2024-01-31 00:00:00' GROUP BY 1, 2)
SELECT d.warehouse_name, usage_date, credits, current_size FROM d LEFT JOIN sz ON d.warehouse_name = sz.warehouse_name
""")
def _(spark, sf):
    return bd.burn_with_size(_m(spark, sf), _q(spark, sf), EVENTS_AS_OF, 7)


@register("outlier_evidence", "query_history", "warehouse_metering", op="CST-27", sql="WITH " + OWNER_RULES_CTE + "," + pqc_cte() + """,
j AS (SELECT qh.warehouse_name, qh.user_name, qh.query_type, p.metered_credits FROM pqc p JOIN query_history qh ON p.query_id = qh.query_id
      WHERE qh.warehouse_name = 'WH_3'),
pt AS (SELECT warehouse_name, query_type, sum(metered_credits) AS c FROM j GROUP BY 1, 2),
tp AS (SELECT warehouse_name, arg_max(query_type, {'c': c, 'q': query_type}) AS top_query_type FROM pt GROUP BY 1),
g AS (SELECT warehouse_name, count(*) AS queries, count(DISTINCT user_name) AS users, round(sum(metered_credits), 6) AS credits FROM j GROUP BY 1),
cand AS (SELECT w.warehouse_name, r.owner_name,
                row_number() OVER (PARTITION BY w.warehouse_name ORDER BY coalesce(r.match_priority, 0) DESC, r.entity_pattern DESC) AS rn
         FROM (SELECT DISTINCT warehouse_name FROM g) w
         JOIN owner_rules r ON upper(r.entity_type) = 'WAREHOUSE' AND coalesce(r.is_active, TRUE)
          AND ((r.entity_pattern = '*' AND r.match_priority > 0) OR upper(w.warehouse_name) = upper(r.entity_pattern)
               OR (r.entity_pattern LIKE '%*%' AND upper(w.warehouse_name) LIKE replace(upper(r.entity_pattern), '*', '%'))))
SELECT g.*, tp.top_query_type, c.owner_name AS owner_tag
FROM g JOIN tp ON g.warehouse_name = tp.warehouse_name LEFT JOIN (SELECT * FROM cand WHERE rn = 1) c ON g.warehouse_name = c.warehouse_name
""")
def _(spark, sf):
    pqc = cost.per_query_credits(_q(spark, sf), _m(spark, sf), EVENTS_AS_OF, 7, keep=["user_name", "query_type"])
    return bd.outlier_evidence(pqc, chb.rules_frame(spark, OWNER_RULES), "WH_3")


@register("remaining_balance", "contract_balances", op="FCT-3", sql="""
SELECT balance_date, capacity_balance, rollover_balance, free_usage_balance,
       coalesce(free_usage_balance, 0.0) + coalesce(capacity_balance, 0.0) + coalesce(rollover_balance, 0.0) AS total_remaining_credits
FROM contract_balances ORDER BY balance_date DESC LIMIT 7
""")
def _(spark, sf):
    return bd.remaining_balance(tv.load(spark, sf, "contract_balances"), 7)


@register("procedure_inventory", "query_history", "task_history", op="TSK-12", sql="""
WITH c AS (SELECT trim(regexp_extract(query_text, '(?i)CALL\\s+([^(]+)', 1)) AS procedure_name, database_name, schema_name,
                  count(*) AS calls, max(start_time) AS last_call
           FROM query_history WHERE start_time >= TIMESTAMP '2024-01-01 00:00:00' AND query_type = 'CALL' GROUP BY 1, 2, 3),
t AS (SELECT database_name, schema_name, count(DISTINCT name) AS schema_tasks FROM task_history GROUP BY 1, 2)
SELECT c.database_name, c.schema_name, procedure_name, calls, last_call, schema_tasks,
       CASE WHEN schema_tasks IS NULL THEN 'Ad hoc' ELSE 'Task scheduled' END AS orchestration
FROM c LEFT JOIN t ON c.database_name = t.database_name AND c.schema_name = t.schema_name
""")
def _(spark, sf):
    return bd.procedure_inventory(_q(spark, sf), tv.load(spark, sf, "task_history"), EVENTS_AS_OF, 30)


@register("governance_readiness", "columns", "tag_references", "access_history", op="GOV-3", sql="""
WITH c AS (SELECT DISTINCT table_catalog, table_schema, table_name, column_name, column_name AS cc FROM tag_references
           WHERE domain = 'COLUMN' AND tag_name IN ('SEMANTIC_CATEGORY', 'PRIVACY_CATEGORY', 'PII', 'SENSITIVITY')),
g AS (SELECT a.table_catalog AS database_name, count(DISTINCT a.column_name) AS total_columns, count(DISTINCT c.cc) AS classified_columns
      FROM columns a LEFT JOIN c ON a.table_catalog = c.table_catalog AND a.table_schema = c.table_schema
       AND a.table_name = c.table_name AND a.column_name = c.column_name GROUP BY 1),
cls AS (SELECT round(classified_columns * 100.0 / nullif(total_columns, 0), 1) AS classification_pct FROM g WHERE total_columns > 5),
t AS (SELECT DISTINCT table_catalog, table_schema, table_name FROM columns),
tg AS (SELECT DISTINCT table_catalog, table_schema, table_name FROM tag_references),
ut AS (SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM tg WHERE tg.table_catalog = t.table_catalog
                                         AND tg.table_schema = t.table_schema AND tg.table_name = t.table_name)),
ta AS (SELECT table_catalog, count(*) AS tables FROM t GROUP BY 1),
tb AS (SELECT table_catalog, count(*) AS u FROM ut GROUP BY 1),
cov AS (SELECT round((tables - coalesce(u, 0)) * 100.0 / tables, 1) AS tag_coverage_pct FROM ta LEFT JOIN tb ON ta.table_catalog = tb.table_catalog),
acc AS (SELECT count(*) AS access_days FROM (SELECT DISTINCT CAST(query_start_time AS DATE) FROM access_history
        WHERE query_start_time >= TIMESTAMP '2024-01-24 00:00:00')),
j AS (SELECT coalesce((SELECT avg(classification_pct) FROM cls), 0.0) AS classified, coalesce((SELECT avg(tag_coverage_pct) FROM cov), 0.0) AS tagged,
             (SELECT access_days FROM acc) AS access_days)
SELECT round(classified, 1) AS classification_pct, round(tagged, 1) AS tag_coverage_pct, access_days,
       round(classified * 0.4 + tagged * 0.4 + least(access_days, 7) / 7 * 20, 1) AS readiness_score,
       CASE WHEN classified * 0.4 + tagged * 0.4 + least(access_days, 7) / 7 * 20 >= 70 THEN 'Ready'
            WHEN classified * 0.4 + tagged * 0.4 + least(access_days, 7) / 7 * 20 >= 40 THEN 'Developing' ELSE 'Initial' END AS readiness
FROM j
""")
def _(spark, sf):
    c = sec.classification_coverage(tv.load(spark, sf, "columns"), tv.load(spark, sf, "tag_references"), 5)
    t = sec.tag_coverage(tv.load(spark, sf, "columns"), tv.load(spark, sf, "tag_references"))
    a = sec.access_history_availability(tv.load(spark, sf, "access_history"), EVENTS_AS_OF, 7)
    return bd.governance_readiness(c, t, a)


@register("tag_maturity", "columns", "tag_references", op="GOV-5", sql=r"""
WITH t AS (SELECT DISTINCT table_catalog, table_schema, table_name FROM columns),
tg AS (SELECT DISTINCT table_catalog, table_schema, table_name FROM tag_references),
ut AS (SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM tg WHERE tg.table_catalog = t.table_catalog
                                         AND tg.table_schema = t.table_schema AND tg.table_name = t.table_name)),
a AS (SELECT table_catalog, count(*) AS tables FROM t GROUP BY 1),
b AS (SELECT table_catalog, count(*) AS untagged_tables FROM ut GROUP BY 1),
cov AS (SELECT a.table_catalog, coalesce(untagged_tables, 0) AS untagged_tables,
               CASE WHEN (tables - coalesce(untagged_tables, 0)) * 100.0 / tables >= 80 THEN 'Managed'
                    WHEN (tables - coalesce(untagged_tables, 0)) * 100.0 / tables >= 40 THEN 'Developing' ELSE 'Initial' END AS maturity
        FROM a LEFT JOIN b ON a.table_catalog = b.table_catalog)
SELECT maturity, count(*) AS databases, CAST(sum(untagged_tables) AS BIGINT) AS untagged_tables FROM cov GROUP BY 1
""")
def _(spark, sf):
    return bd.tag_maturity(sec.tag_coverage(tv.load(spark, sf, "columns"), tv.load(spark, sf, "tag_references")))


@register("unclassified_assets", "query_history", op="GOV-6", sql="WITH tq AS (SELECT * FROM query_history WHERE start_time >= TIMESTAMP '2024-01-01 00:00:00' AND " + TENANT_SQL + " = 'Shared/Unclassified')" + r"""
SELECT asset_type, asset_name, count(*) AS statements FROM (
  SELECT 'warehouse' AS asset_type, warehouse_name AS asset_name FROM tq UNION ALL
  SELECT 'database', database_name FROM tq UNION ALL SELECT 'user', user_name FROM tq) GROUP BY 1, 2
""")
def _(spark, sf):
    return bd.unclassified_assets(_q(spark, sf), scope.tenant_label(tenants()), EVENTS_AS_OF, 30)


@register("owner_route_readiness", "query_history", op="GOV-8", sql="WITH " + OWNER_MATCH_SQL + """
SELECT count(*) AS entities, count_if(route_state = 'Routed') AS routed,
       round(count_if(route_state = 'Routed') * 100.0 / count(*), 1) AS routed_pct, count(DISTINCT owner_name) AS owners FROM own
""")
def _(spark, sf):
    from opslens.plans.q_security import _query_entities
    r = sec.owner_resolution(_query_entities(spark, sf), chb.rules_frame(spark, OWNER_RULES),
                             ["warehouse_name", "database_name", "user_name"])
    return bd.owner_route_readiness(r)


@register("change_integration_status", "source_commits", "change_tickets", "query_history", op="CHG-5", sql=r"""
WITH u AS (SELECT count(*) AS "rows", max(committed_at) AS last_event, 'source_control' AS surface FROM source_commits
           UNION ALL SELECT count(*), max(opened_at), 'tickets' FROM change_tickets
           UNION ALL SELECT count(*), max(start_time), 'observed' FROM query_history)
SELECT "rows", last_event, surface, date_diff('day', last_event, TIMESTAMP '2024-01-31 00:00:00') AS days_since_last,
       CASE WHEN "rows" = 0 THEN 'Not connected' WHEN date_diff('day', last_event, TIMESTAMP '2024-01-31 00:00:00') > 7 THEN 'Stale'
            ELSE 'Connected' END AS state
FROM u
""")
def _(spark, sf):
    return bd.integration_status({"source_control": (tv.load(spark, sf, "source_commits"), "committed_at"),
                                  "tickets": (tv.load(spark, sf, "change_tickets"), "opened_at"),
                                  "observed": (_q(spark, sf), "start_time")}, EVENTS_AS_OF)


@register("unmatched_change_evidence", "query_history", "source_commits", "change_tickets", op="CHG-6",
          sql="WITH " + q_change.RECONCILED_SQL + "SELECT * FROM rec WHERE reconciliation_state <> 'Reconciled'")
def _(spark, sf):
    from opslens.operators import change as chg
    ch = chg.changes(_q(spark, sf), EVENTS_AS_OF, 7)
    rec = chg.reconcile_changes(ch, tv.load(spark, sf, "source_commits"), tv.load(spark, sf, "change_tickets"))
    return bd.unmatched_evidence(rec)


@register("verification_health", "login_history", "warehouses", "query_history", "warehouse_metering", op="ACT-6", sql=q_alerts._QUEUE + ", ver AS (" + q_alerts.SAVINGS_VERIFICATION_SQL + ")" + """
SELECT (SELECT count(*) FROM ver) AS verified_actions, (SELECT count_if(outcome = 'Savings verified') FROM ver) AS savings_verified,
       (SELECT count_if(outcome = 'Insufficient data') FROM ver) AS insufficient,
       (SELECT count_if(status <> 'Fixed') FROM q) AS open_actions, (SELECT max(last_seen_at) FROM q) AS last_run
""")
def _(spark, sf):
    from datetime import timedelta
    from opslens.functions.timeutil import ts_lit
    from opslens.operators import alerts as al
    s = cap.suspend_timeout_analysis(tv.load(spark, sf, "warehouses"), _q(spark, sf), _m(spark, sf), EVENTS_AS_OF, 7)
    acts = s.select(F.col("warehouse_name").alias("entity"), F.concat(F.lit("act-"), "warehouse_name").alias("action_id"),
                    ts_lit(EVENTS_AS_OF - timedelta(days=10)).alias("acted_at"))
    return bd.verification_health(al.savings_verification(_m(spark, sf), acts, EVENTS_AS_OF, 28), q_alerts._queue(spark, sf))


@register("operability_facts", "login_history", op="ACT-7", sql=q_alerts._QUEUE + """
SELECT * FROM q WHERE category = 'security'
""")
def _(spark, sf):
    return bd.operability_facts(q_alerts._queue(spark, sf), "security")


@register("post_fix_evidence", "query_history", "task_history", "warehouse_metering", op="REC-5", sql="""
WITH m AS (SELECT warehouse_name, date_trunc('hour', start_time) AS hb, sum(coalesce(credits_used_compute, credits_used)) AS hc
           FROM warehouse_metering WHERE start_time >= TIMESTAMP '2024-01-24 00:00:00' AND start_time < TIMESTAMP '2024-01-30 00:00:00' GROUP BY 1, 2),
a AS (SELECT DISTINCT warehouse_name, date_trunc('hour', start_time) AS hb FROM query_history
      WHERE start_time >= TIMESTAMP '2024-01-24 00:00:00' AND start_time < TIMESTAMP '2024-01-30 00:00:00' AND warehouse_name IS NOT NULL),
idle AS (SELECT m.warehouse_name, round(sum(hc), 4) AS idle_credits FROM m
         WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.warehouse_name = m.warehouse_name AND a.hb = m.hb) GROUP BY 1 HAVING round(sum(hc), 4) > 0.0)
SELECT CAST(round(coalesce(sum(idle_credits), 0.0), 4) AS DOUBLE) AS value, 'idle_credits' AS signal FROM idle
UNION ALL SELECT CAST(round(sum(bytes_spilled_to_remote_storage) / (1024.0 * 1024 * 1024), 4) AS DOUBLE), 'remote_spill_gb' FROM query_history
WHERE start_time >= TIMESTAMP '2024-01-24 00:00:00'
UNION ALL SELECT CAST(count_if(state = 'FAILED') AS DOUBLE), 'task_failures' FROM task_history WHERE scheduled_time >= TIMESTAMP '2001-07-26 00:00:00'
UNION ALL SELECT CAST(count_if(execution_status <> 'SUCCESS') AS DOUBLE), 'query_failures' FROM query_history WHERE start_time >= TIMESTAMP '2024-01-24 00:00:00'
""")
def _(spark, sf):
    return bd.post_fix_evidence(_q(spark, sf), tv.load(spark, sf, "task_history"), _m(spark, sf), EVENTS_AS_OF, ORDERS_AS_OF)


@register("executive_health_score", "warehouse_metering", "task_history", "query_history", "login_history", op="SCR-2", sql="WITH ph AS (" + q_alerts.PLATFORM_HEALTH_SCORE_SQL + "), " + """
c AS (SELECT 'cost' AS component, cost_score AS score FROM ph UNION ALL SELECT 'reliability', reliability_score FROM ph
      UNION ALL SELECT 'performance', performance_score FROM ph UNION ALL SELECT 'security', security_score FROM ph),
w AS (SELECT * FROM (VALUES ('cost', 2.0), ('reliability', 3.0), ('performance', 2.0), ('security', 1.0)) t(component, weight)),
j AS (SELECT c.*, w.weight FROM c JOIN w ON c.component = w.component)
SELECT round(sum(score * weight) / sum(weight), 1) AS score,
       string_agg(component || '=' || CAST(score AS VARCHAR), ', ' ORDER BY component, score) AS components FROM j
""")
def _(spark, sf):
    from opslens.operators import alerts as al
    h = al.platform_health(_m(spark, sf), tv.load(spark, sf, "task_history"), _q(spark, sf),
                           tv.load(spark, sf, "login_history"), EVENTS_AS_OF, ORDERS_AS_OF)
    comps = h.select(F.expr("stack(4, 'cost', cost_score, 'reliability', reliability_score, 'performance', performance_score, "
                            "'security', security_score) AS (component, score)"))
    return bd.component_score(comps, {"cost": 2.0, "reliability": 3.0, "performance": 2.0, "security": 1.0})


@register("service_health_score", "query_history", op="SCR-3", sql="""
WITH g AS (SELECT warehouse_name, count(*) AS queries, count_if(execution_status <> 'SUCCESS') AS failures FROM query_history
           WHERE start_time >= TIMESTAMP '2024-01-30 00:00:00' AND start_time < TIMESTAMP '2024-01-31 00:00:00' AND warehouse_name IS NOT NULL GROUP BY 1),
c AS (SELECT warehouse_name AS component, 100 - round(failures * 100.0 / queries, 1) AS score FROM g)
SELECT round(sum(score * 1.0) / sum(1.0), 1) AS score,
       string_agg(component || '=' || CAST(score AS VARCHAR), ', ' ORDER BY component, score) AS components FROM c
""")
def _(spark, sf):
    h = us.service_health_by_warehouse(_q(spark, sf), EVENTS_AS_OF, 24)
    comps = h.select(F.col("warehouse_name").alias("component"), (100 - F.col("failure_pct")).alias("score"))
    return bd.component_score(comps)


def _transfers(spark, sf):
    return bd.transfer_rows(_raw(spark, sf, "lineitem"), _raw(spark, sf, "orders"), _raw(spark, sf, "customer"),
                            _raw(spark, sf, "supplier"), _raw(spark, sf, "nation"))


_TRANSFERS = """
tr AS (SELECT CAST(l.l_shipdate AS DATE) AS usage_date, ns.n_regionkey AS src_region, nc.n_regionkey AS dst_region,
              CASE WHEN ns.n_regionkey = nc.n_regionkey THEN 'SAME_REGION' ELSE 'CROSS_REGION' END AS transfer_type,
              l.l_extendedprice * 1e6 AS bytes_transferred
       FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
       JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation ns ON s.s_nationkey = ns.n_nationkey
       JOIN nation nc ON c.c_nationkey = nc.n_nationkey)
"""


@register("transfer_daily", op="NET-1", sql="WITH " + _TRANSFERS + """
SELECT usage_date, transfer_type, count(*) AS transfers, round(sum(bytes_transferred) / (1024.0 * 1024 * 1024), 3) AS gb,
       round(sum(bytes_transferred) / (1024.0 * 1024 * 1024 * 1024) * 1.0, 6) AS credits
FROM tr WHERE usage_date >= DATE '2001-10-06' AND usage_date < DATE '2001-11-05' GROUP BY 1, 2
""")
def _(spark, sf):
    return bd.transfer_daily(_transfers(spark, sf), LINEITEM_AS_OF, 30)


@register("replication_cost", op="NET-2", sql="WITH " + _TRANSFERS + """
SELECT src_region, dst_region, count(DISTINCT usage_date) AS days, round(sum(bytes_transferred) / (1024.0 * 1024 * 1024 * 1024), 6) AS tb,
       round(sum(bytes_transferred) / (1024.0 * 1024 * 1024 * 1024) * 2.0, 6) AS credits
FROM tr WHERE transfer_type = 'CROSS_REGION' AND usage_date >= DATE '2001-10-06' AND usage_date < DATE '2001-11-05' GROUP BY 1, 2
""")
def _(spark, sf):
    return bd.replication_cost(_transfers(spark, sf), LINEITEM_AS_OF, 30)


@register("account_balances", op="ORG-3", sql="""
SELECT n.n_name AS account_name, round(sum(c.c_acctbal), 2) AS balance, count_if(c.c_acctbal < 0) AS negative_balances,
       count(*) AS holders
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY 1
""")
def _(spark, sf):
    return bd.account_balances(_raw(spark, sf, "customer"), _raw(spark, sf, "nation"))


@register("ai_budget_exceptions", "ai_usage", op="AIC-2", sql=r"""
WITH g AS (SELECT user_name, CAST(start_time AS DATE) AS d, count(*) AS n, sum(credits_used) AS c FROM ai_usage
           WHERE start_time >= TIMESTAMP '2024-01-01 00:00:00' GROUP BY 1, 2),
u AS (SELECT user_name, count(*) AS active_days, sum(n) AS requests, sum(c) AS c FROM g GROUP BY 1),
r AS (SELECT user_name, active_days, CAST(requests AS BIGINT) AS requests, round(c, 6) AS credits, round(c / requests, 8) AS credits_per_request,
             round(c / active_days * 30, 6) AS projected_30d_credits, round(c * 2.2, 4) AS est_cost_usd FROM u)
SELECT *, round((projected_30d_credits / 0.05 - 1) * 100, 1) AS over_budget_pct FROM r WHERE projected_30d_credits > 0.05
""")
def _(spark, sf):
    return bd.ai_budget_exceptions(us.ai_user_rollup(tv.load(spark, sf, "ai_usage"), EVENTS_AS_OF, 30), 0.05)


@register("container_credits_daily", "service_metering", op="AIC-6", sql="""
SELECT CAST(start_time AS DATE) AS usage_date, service_type, round(sum(credits_used), 4) AS credits FROM service_metering
WHERE start_time >= TIMESTAMP '2001-10-06 00:00:00' AND start_time < TIMESTAMP '2001-11-05 00:00:00'
  AND upper(service_type) IN ('SNOWPARK_CONTAINER_SERVICES', 'QUERY_ACCELERATION') GROUP BY 1, 2
""")
def _(spark, sf):
    return bd.container_credits_daily(tv.load(spark, sf, "service_metering"), LINEITEM_AS_OF, 30)


@register("tag_hot_spots", "query_history", op="TEL-1", sql="""
SELECT split_part(query_tag, ';', 1) AS section, user_name, role_name, CAST(start_time AS DATE) AS usage_date, count(*) AS statements
FROM query_history WHERE start_time >= TIMESTAMP '2024-01-24 00:00:00' AND query_tag IS NOT NULL GROUP BY 1, 2, 3, 4
""")
def _(spark, sf):
    return bd.tag_hot_spots(_q(spark, sf), EVENTS_AS_OF, 7)


@register("tag_query_budget", "query_history", op="TEL-2", sql="""
WITH g AS (SELECT split_part(query_tag, ';', 1) AS section, count(*) AS calls, count(DISTINCT query_hash) AS unique_statements,
                  count_if(total_elapsed_time > 10000) AS expensive, round(sum(total_elapsed_time) / 1000.0, 1) AS elapsed_sec
           FROM query_history WHERE start_time >= TIMESTAMP '2024-01-24 00:00:00' AND query_tag IS NOT NULL GROUP BY 1)
SELECT *, CASE WHEN expensive * 10 > calls THEN 'High' WHEN expensive > 0 THEN 'Medium' ELSE 'Low' END AS risk FROM g
""")
def _(spark, sf):
    return bd.tag_query_budget(_q(spark, sf), EVENTS_AS_OF, 7)


@register("query_hourly_fact", "query_history", op="SUM-8", sql="""
SELECT date_trunc('hour', start_time) AS hour_start, """ + TENANT_SQL + """ AS company, """ + ENV_SQL + """ AS environment,
       warehouse_name, warehouse_size, user_name, role_name, database_name, query_type, count(*) AS query_count,
       count_if(execution_status <> 'SUCCESS') AS failed_count, CAST(sum(total_elapsed_time) AS BIGINT) AS total_elapsed_ms,
       round(avg(execution_time), 3) AS avg_execution_ms, round(quantile_cont(execution_time, 0.95), 3) AS p95_execution_ms,
       CAST(sum(queued_overload_time + queued_provisioning_time) AS BIGINT) AS total_queued_ms,
       CAST(sum(bytes_spilled_to_remote_storage) AS BIGINT) AS total_spill_bytes, CAST(sum(bytes_scanned) AS BIGINT) AS total_bytes_scanned
FROM query_history WHERE start_time >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9
""")
def _(spark, sf):
    return bd.query_hourly_fact(_q(spark, sf), scope.tenant_label(tenants()), scope.environment_label(environments()),
                                EVENTS_AS_OF, 7)


@register("query_daily_from_sketches", "query_history", op="SUM-8", sql="""
WITH q AS (SELECT CAST(date_trunc('day', start_time) AS TIMESTAMP) AS period_start, warehouse_name, execution_time FROM query_history
           WHERE start_time >= TIMESTAMP '2024-01-24 00:00:00' AND start_time < TIMESTAMP '2024-01-31 00:00:00'),
g AS (SELECT period_start, warehouse_name, count(*) AS query_count, CAST(sum(execution_time) AS BIGINT) AS total_execution_ms,
             max(execution_time) AS max_execution_ms FROM q GROUP BY 1, 2)
SELECT *, TRUE AS p50_within_error, TRUE AS p95_within_error FROM g
""")
def _(spark, sf):
    """Daily percentiles from the stored hourly sketches alone. A sketch is an
    estimate, so what is compared is whether its rank among all statements of the
    warehouse and day lies within the stated error."""
    path = f"{ensure_checkpoint_dir(spark)}/opslens-feeds/sketches-{uuid.uuid4().hex[:12]}"
    hourly = bd.query_sketch_fact(_q(spark, sf), EVENTS_AS_OF, 7)
    hourly.withColumn("usage_date", F.to_date("hour_start")).write.partitionBy("usage_date").parquet(path)
    day = bd.query_period_fact(spark.read.parquet(path), "day")
    q = _q(spark, sf).filter(lookback("start_time", EVENTS_AS_OF, 7))
    q = q.select(trunc("day", "start_time").alias("period_start"), "warehouse_name", "execution_time")
    key = ["period_start", "warehouse_name"]
    near = q.join(day.select(*key, "p50_execution_ms", "p95_execution_ms"), key)
    rank = near.groupBy(*key).agg(*[c for p in (50, 95) for c in (
        F.avg((F.col("execution_time") < F.col(f"p{p}_execution_ms")).cast("double")).alias(f"below{p}"),
        F.avg((F.col("execution_time") <= F.col(f"p{p}_execution_ms")).cast("double")).alias(f"upto{p}"))])
    ok = [((F.col(f"below{p}") <= p / 100 + 0.02) & (F.col(f"upto{p}") >= p / 100 - 0.02)).alias(f"p{p}_within_error") for p in (50, 95)]
    return day.join(rank, key).select(*key, "query_count", "total_execution_ms", "max_execution_ms", *ok)


@register("warehouse_hourly_fact", "warehouse_metering", op="SUM-9", sql=r"""
SELECT date_trunc('hour', start_time) AS hour_start,
       CASE WHEN upper(warehouse_name) IN ('WH_0', 'WH_1', 'WH_2') THEN 'NORTH' WHEN upper(warehouse_name) LIKE 'WH_5%' THEN 'SOUTH'
            ELSE 'Shared/Unclassified' END AS company, warehouse_name,
       round(sum(credits_used), 6) AS credits_used, round(sum(credits_used_compute), 6) AS credits_used_compute,
       round(sum(credits_used_cloud_services), 6) AS credits_used_cloud_services
FROM warehouse_metering WHERE start_time >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY 1, 2, 3
""")
def _(spark, sf):
    m = _m(spark, sf).withColumn("database_name", F.lit(None).cast("string")).withColumn("user_name", F.lit(None).cast("string"))
    return bd.warehouse_hourly_fact(m, scope.tenant_label(tenants()), EVENTS_AS_OF, 7)


@register("login_daily_fact", "login_history", op="SUM-10", sql="""
SELECT CAST(event_timestamp AS DATE) AS login_date, user_name, client_ip, reported_client_type, reported_client_version,
       count_if(is_success = 'YES') AS success_count, count_if(is_success = 'NO') AS failure_count
FROM login_history WHERE event_timestamp >= TIMESTAMP '2024-01-01 00:00:00' GROUP BY 1, 2, 3, 4, 5
""")
def _(spark, sf):
    return bd.login_daily_fact(tv.load(spark, sf, "login_history"), EVENTS_AS_OF, 30)


@register("latest_tenant_snapshot", "query_history", op="SUM-11", sql="""
WITH f AS (SELECT date_trunc('hour', start_time) AS hour_start, """ + TENANT_SQL + """ AS company, count(*) AS queries,
                  count_if(execution_status <> 'SUCCESS') AS failed
           FROM query_history WHERE start_time >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY 1, 2),
g AS (SELECT * FROM f WHERE hour_start <= TIMESTAMP '2024-01-31 00:00:00' AND hour_start >= TIMESTAMP '2024-01-30 00:00:00')
SELECT company, (max({'h': hour_start, 'q': queries, 'f': failed})).h AS hour_start,
       (max({'h': hour_start, 'q': queries, 'f': failed})).q AS queries, (max({'h': hour_start, 'q': queries, 'f': failed})).f AS failed
FROM g GROUP BY 1
""")
def _(spark, sf):
    facts = bd.query_hourly_fact(_q(spark, sf), scope.tenant_label(tenants()), scope.environment_label(environments()),
                                 EVENTS_AS_OF, 7)
    snap = facts.groupBy("company", "hour_start").agg(F.sum("query_count").alias("queries"), F.sum("failed_count").alias("failed"))
    return bd.latest_snapshot_per_tenant(snap, "company", "hour_start", EVENTS_AS_OF, 24)


@register("spend_ranking", "warehouse_metering", op="BRD-3", sql="""
WITH g AS (SELECT warehouse_name, sum(credits_used) AS c FROM warehouse_metering
           WHERE start_time >= TIMESTAMP '2024-01-01 00:00:00' AND start_time < TIMESTAMP '2024-01-31 00:00:00' GROUP BY 1)
SELECT row_number() OVER (ORDER BY c DESC, warehouse_name) AS spend_rank, warehouse_name, round(c, 4) AS credits,
       round(c * 100.0 / (SELECT sum(c) FROM g), 1) AS share_pct
FROM g ORDER BY c DESC, warehouse_name LIMIT 10
""")
def _(spark, sf):
    return bd.spend_ranking(_m(spark, sf), EVENTS_AS_OF, 30, 10)


@register("service_movement", "service_metering", op="BRD-3", sql="WITH lens AS (" + _LENS + ")" + r"""
SELECT service_category, service_type, estimated_cost_usd, prior_estimated_cost_usd, cost_delta_usd FROM lens
ORDER BY abs(cost_delta_usd) DESC, service_type LIMIT 10
""")
def _(spark, sf):
    return bd.service_movement(cost.service_cost_lens(tv.load(spark, sf, "service_metering"), LINEITEM_AS_OF, 7))


def _anoms(spark, sf):
    from opslens.operators import anomaly
    return anomaly.cost_anomalies(_m(spark, sf), EVENTS_AS_OF, 30, 2.0)


@register("cost_spike_signals", "warehouse_metering", "query_history", op="BRD-7", sql="WITH anom AS (" + ORACLES_RAW_ANOM + ")" + """,
dy AS (SELECT warehouse_name, CAST(start_time AS DATE) AS usage_date, count(*) AS statements,
              count_if(query_type IN (""" + CT + """)) AS changes, count_if(execution_status <> 'SUCCESS') AS failures
       FROM query_history WHERE start_time >= TIMESTAMP '2024-01-01 00:00:00' AND warehouse_name IS NOT NULL GROUP BY 1, 2),
b AS (SELECT warehouse_name, avg(statements) AS a FROM dy GROUP BY 1),
j AS (SELECT anom.usage_date, anom.warehouse_name, daily_credits, z_score, dy.statements, dy.changes, dy.failures,
             dy.statements / nullif(b.a, 0) AS vr
      FROM anom LEFT JOIN dy ON anom.warehouse_name = dy.warehouse_name AND anom.usage_date = dy.usage_date
      LEFT JOIN b ON anom.warehouse_name = b.warehouse_name)
SELECT usage_date, warehouse_name, daily_credits, z_score, coalesce(statements, 0) AS statements, coalesce(changes, 0) AS changes,
       coalesce(failures, 0) AS failures, round(vr, 2) AS volume_ratio,
       CASE WHEN changes > 0 THEN 'Change on spike day' WHEN vr >= 1.5 THEN 'Workload surge'
            WHEN failures > statements * 0.3 THEN 'Retry storm' ELSE 'No linked signal' END AS root_cause_signal
FROM j
""")
def _(spark, sf):
    return bd.cost_spike_signals(_anoms(spark, sf), _q(spark, sf), EVENTS_AS_OF, 30)


@register("cost_incident_timeline", "warehouse_metering", "alerts", op="BRD-8", sql="WITH anom AS (" + ORACLES_RAW_ANOM + ")" + r"""
SELECT CAST(usage_date AS TIMESTAMP) AS event_time, 'anomaly' AS event_type, warehouse_name AS entity, anomaly_severity AS severity FROM anom
UNION ALL SELECT created_at, 'alert', entity, severity FROM alerts WHERE alert_type = 'COST_SPIKE'
""")
def _(spark, sf):
    return bd.cost_incident_timeline(_anoms(spark, sf), tv.load(spark, sf, "alerts"))


@register("architecture_findings", "query_history", "warehouse_metering", op="BRD-23", sql="WITH " + OWNER_RULES_CTE + "," + q_capacity._UTIL[5:] + """,
s AS (SELECT warehouse_name, coalesce(avg_queue_sec, 0) AS aq, coalesce(peak_queue_sec, 0) AS pq, coalesce(total_remote_spill_gb, 0) AS sp,
             coalesce(peak_hourly_credits, 0) AS pc, coalesce(avg_hourly_credits, 0) AS ac FROM util),
t AS (SELECT *, CAST(aq > 5.0 AS INTEGER) + CAST(pq > 15.0 AS INTEGER) + CAST(sp > 1.0 AS INTEGER) AS up,
             (aq < 0.5 AND sp < 0.1 AND ac > 0 AND pc < ac * 1.5) AS down, (pq > 25.0 AND sp < 1.0) AS multi FROM s),
recs AS (SELECT warehouse_name, CASE WHEN multi THEN 'consider_multi_cluster' WHEN up >= 2 THEN 'upsize'
                                     WHEN down AND up = 0 THEN 'downsize' ELSE 'maintain' END AS recommendation FROM t),
pairs AS (SELECT warehouse_name, database_name, count(*) AS n FROM query_history
          WHERE start_time >= TIMESTAMP '2024-01-01 00:00:00' AND warehouse_name IS NOT NULL AND database_name IS NOT NULL GROUP BY 1, 2),
pdb AS (SELECT database_name, count(*) AS wh_per_db FROM pairs GROUP BY 1),
iso AS (SELECT warehouse_name, CASE WHEN count(*) >= 5 THEN 'Split: mixed workload'
                                    WHEN max(wh_per_db) >= 5 THEN 'Review: database spread over many warehouses' ELSE 'Isolated' END AS decision
        FROM pairs JOIN pdb USING (database_name) GROUP BY 1),
f AS (SELECT warehouse_name, 'sizing' AS finding_type, recommendation AS finding, 'Cost / performance balance' AS objective FROM recs
      WHERE recommendation <> 'maintain'
      UNION ALL SELECT warehouse_name, 'isolation', decision, 'Workload isolation' FROM iso WHERE decision <> 'Isolated'),
cand AS (SELECT w.warehouse_name, r.owner_name,
                row_number() OVER (PARTITION BY w.warehouse_name ORDER BY coalesce(r.match_priority, 0) DESC, r.entity_pattern DESC) AS rn
         FROM (SELECT DISTINCT warehouse_name FROM query_history) w
         JOIN owner_rules r ON upper(r.entity_type) = 'WAREHOUSE' AND coalesce(r.is_active, TRUE)
          AND ((r.entity_pattern = '*' AND r.match_priority > 0) OR upper(w.warehouse_name) = upper(r.entity_pattern)
               OR (r.entity_pattern LIKE '%*%' AND upper(w.warehouse_name) LIKE replace(upper(r.entity_pattern), '*', '%'))))
SELECT f.*, c.owner_name, coalesce(c.owner_name, 'Unrouted') AS route
FROM f LEFT JOIN (SELECT * FROM cand WHERE rn = 1) c ON f.warehouse_name = c.warehouse_name
""")
def _(spark, sf):
    q, m = _q(spark, sf), _m(spark, sf)
    recs = cap.size_recommendation(cap.warehouse_utilization(m, q, EVENTS_AS_OF, 30))
    iso = cap.workload_isolation(q, EVENTS_AS_OF, 30)
    owners = chb.resolve_owner(q, "warehouse_name", chb.rules_frame(spark, OWNER_RULES))
    return bd.architecture_findings(recs, iso, owners)


@register("conversion_readiness", "query_history", "warehouse_metering", "warehouses", op="CAP-18", sql=q_capacity._UTIL + """,
j AS (SELECT u.*, w.warehouse_size, w.max_cluster_count FROM util u LEFT JOIN warehouses w ON u.warehouse_name = w.warehouse_name),
k AS (SELECT *, CASE WHEN avg_queue_sec < 1 THEN 30 ELSE 0 END + CASE WHEN total_remote_spill_gb = 0 THEN 30 ELSE 0 END
                + CASE WHEN peak_hourly_credits <= avg_hourly_credits * 2 THEN 25 ELSE 0 END
                + CASE WHEN max_cluster_count <= 1 THEN 15 ELSE 0 END AS sc FROM j)
SELECT warehouse_name, warehouse_size, sc AS readiness_score,
       CASE WHEN sc >= 70 THEN 'Pilot ready' WHEN sc >= 40 THEN 'Needs review' ELSE 'Not ready' END AS readiness FROM k
""")
def _(spark, sf):
    util = cap.warehouse_utilization(_m(spark, sf), _q(spark, sf), EVENTS_AS_OF, 30)
    return bd.conversion_readiness(util, tv.load(spark, sf, "warehouses"))


@register("refresh_lag_history", "copy_history", op="PIP-8", sql="""
WITH d AS (SELECT table_name, CAST(last_load_time AS DATE) AS load_date, max(last_load_time) AS last_load FROM copy_history
           WHERE last_load_time >= TIMESTAMP '2001-10-06 00:00:00' AND status = 'LOADED' GROUP BY 1, 2)
SELECT table_name, load_date, last_load, lag(last_load) OVER (PARTITION BY table_name ORDER BY load_date) AS prev_load,
       round(date_diff('microsecond', lag(last_load) OVER (PARTITION BY table_name ORDER BY load_date), last_load) / 3.6e9, 2) AS refresh_lag_hours
FROM d
""")
def _(spark, sf):
    return bd.refresh_lag_history(tv.load(spark, sf, "copy_history"), LINEITEM_AS_OF, 30)
