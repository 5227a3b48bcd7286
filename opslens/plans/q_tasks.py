"""Registered task, procedure and SLO queries (TSK-*, SLO-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from opslens.operators.graph import graph_impact
from opslens.operators import tasks as tsk
from opslens.plans.fixtures import values_cte
from opslens.plans.q_graph import _EDGES
from opslens.plans.registry import register
from opslens.sources import testviews as tv
from opslens.sources.testviews import EVENTS_AS_OF, ORDERS_AS_OF

KEY = "database_name, schema_name, task_name"


def _t(spark, sf):
    return tv.load(spark, sf, "task_history")


def _runs(lo: str, extra: str = "") -> str:
    return f"""
r AS (SELECT database_name, schema_name, name AS task_name, state, query_id, scheduled_time, completed_time, error_code,
             error_message, root_task_id, date_diff('second', scheduled_time, completed_time) AS duration_sec
      FROM task_history WHERE scheduled_time >= TIMESTAMP '{lo}' {extra})
"""


D90 = "2001-05-04 00:00:00"
D30 = "2001-07-03 00:00:00"
D7 = "2001-07-26 00:00:00"

_STATUS = """CASE WHEN {p} IS NULL THEN 'No Data' WHEN {p} >= 99 THEN 'Excellent' WHEN {p} >= 95 THEN 'Good'
            WHEN {p} >= 90 THEN 'Acceptable' WHEN {p} >= 80 THEN 'At Risk' ELSE 'Critical' END"""


@register("task_sla_compliance", "task_history", op="TSK-1", sql="WITH " + _runs(D90, "AND state IN ('SUCCEEDED', 'FAILED', 'CANCELLED')") + f""",
b AS (SELECT {KEY}, avg(duration_sec) AS a, quantile_cont(duration_sec, 0.95) AS p95, count(*) AS total_runs,
             count_if(state = 'SUCCEEDED') AS success_count, count_if(state = 'FAILED') AS failure_count
      FROM r GROUP BY 1, 2, 3 HAVING count(*) >= 3),
g AS (SELECT b.database_name, b.schema_name, b.task_name, b.total_runs, b.success_count, b.failure_count, b.a, b.p95,
             count_if(r.duration_sec <= b.a * 1.5 AND r.state = 'SUCCEEDED') AS within_sla_count,
             count_if(r.duration_sec > b.a * 1.5 OR r.state <> 'SUCCEEDED') AS sla_miss_count
      FROM b JOIN r ON b.database_name = r.database_name AND b.schema_name = r.schema_name AND b.task_name = r.task_name
      GROUP BY 1, 2, 3, 4, 5, 6, 7, 8)
SELECT {KEY}, total_runs, success_count, failure_count, round(a, 1) AS avg_duration_sec, round(p95, 1) AS p95_duration_sec,
       round(a * 1.5, 1) AS sla_threshold_sec, within_sla_count, sla_miss_count,
       round(within_sla_count * 100.0 / nullif(total_runs, 0), 1) AS sla_compliance_pct,
       {_STATUS.format(p="(within_sla_count * 100.0 / nullif(total_runs, 0))")} AS sla_status
FROM g
""")
def _(spark, sf):
    return tsk.sla_compliance(_t(spark, sf), ORDERS_AS_OF, 90)


@register("task_overall_sla", "task_history", op="TSK-2", sql="WITH " + _runs(D90, "AND state IN ('SUCCEEDED', 'FAILED', 'CANCELLED')") + f""",
b AS (SELECT {KEY}, avg(duration_sec) AS a FROM r GROUP BY 1, 2, 3 HAVING count(*) >= 3),
c AS (SELECT r.task_name, CASE WHEN r.state = 'SUCCEEDED' AND r.duration_sec <= b.a * 1.5 THEN 1 ELSE 0 END AS met
      FROM r JOIN b ON b.database_name = r.database_name AND b.schema_name = r.schema_name AND b.task_name = r.task_name),
o AS (SELECT count(*) AS total_runs, CAST(sum(met) AS BIGINT) AS within_sla, count(DISTINCT task_name) AS tracked_tasks,
             count(DISTINCT CASE WHEN met = 0 THEN task_name END) AS tasks_with_misses FROM c)
SELECT total_runs, within_sla, total_runs - within_sla AS missed_sla,
       round(within_sla * 100.0 / nullif(total_runs, 0), 1) AS overall_sla_pct, tracked_tasks, tasks_with_misses,
       {_STATUS.format(p="round(within_sla * 100.0 / nullif(total_runs, 0), 1)")} AS status
FROM o
""")
def _(spark, sf):
    return tsk.overall_sla(_t(spark, sf), ORDERS_AS_OF, 90)


@register("task_failure_summary", "task_history", op="TSK-4", sql="WITH " + _runs(D30) + f"""
SELECT {KEY}, count(*) AS runs, count_if(state = 'FAILED') AS failures,
       max(CASE WHEN state = 'FAILED' THEN scheduled_time END) AS last_failure,
       (max(CASE WHEN state = 'FAILED' THEN {{'t': scheduled_time, 'e': error_message}} END)).e AS last_error,
       round(count_if(state = 'FAILED') * 100.0 / count(*), 1) AS failure_pct
FROM r GROUP BY 1, 2, 3 HAVING count_if(state = 'FAILED') > 0
""")
def _(spark, sf):
    return tsk.failure_summary(_t(spark, sf), ORDERS_AS_OF, 30)


@register("task_health_counters", "task_history", op="TSK-4", sql="WITH " + _runs(D7) + f"""
SELECT count(*) AS total_runs, count_if(state = 'SUCCEEDED') AS succeeded, count_if(state = 'FAILED') AS failed,
       count_if(state = 'CANCELLED') AS cancelled, count(DISTINCT ({KEY})) AS tasks_run,
       count(DISTINCT CASE WHEN state = 'FAILED' THEN concat_ws('.', {KEY}) END) AS failing_tasks
FROM r
""")
def _(spark, sf):
    return tsk.health_counters(_t(spark, sf), ORDERS_AS_OF, 7)


def _category_sql(col: str) -> str:
    u = f"upper(coalesce({col}, ''))"
    parts = []
    for label, tokens in tsk.FAILURE_CATEGORIES:
        cond = " OR ".join(f"contains({u}, '{t}')" for t in tokens)
        parts.append(f"WHEN {cond} THEN '{label}'")
    return "CASE " + " ".join(parts) + f" ELSE '{tsk.UNCLASSIFIED}' END"


_MASKED = ("regexp_replace(regexp_replace(trim(coalesce(error_message, '')), '\\s+', ' ', 'g'), "
           "'(?i)\\b[0-9a-f]{8,}[-0-9a-f]*\\b', '<id>', 'g')")
_SIG = f"CASE WHEN {_MASKED} = '' THEN 'No error text' ELSE {_MASKED} END"

_RECOVERY = f"""
lf AS (SELECT {KEY}, max(scheduled_time) AS failure_at FROM r WHERE state = 'FAILED' GROUP BY 1, 2, 3),
rc AS (SELECT r.database_name, r.schema_name, r.task_name, min(r.scheduled_time) AS recovery_at
       FROM r JOIN lf ON r.database_name = lf.database_name AND r.schema_name = lf.schema_name AND r.task_name = lf.task_name
       WHERE r.state = 'SUCCEEDED' AND r.scheduled_time > lf.failure_at GROUP BY 1, 2, 3),
j AS (SELECT lf.*, rc.recovery_at,
             CASE WHEN rc.recovery_at IS NOT NULL THEN date_diff('microsecond', lf.failure_at, rc.recovery_at) / 1e6 / 3600.0
                  ELSE date_diff('microsecond', lf.failure_at, TIMESTAMP '2001-08-02 00:00:00') / 1e6 / 3600.0 END AS h
      FROM lf LEFT JOIN rc ON lf.database_name = rc.database_name AND lf.schema_name = rc.schema_name AND lf.task_name = rc.task_name),
rec AS (SELECT {KEY}, failure_at, recovery_at, round(greatest(h, 0.0), 2) AS recovery_hours,
               CASE WHEN recovery_at IS NULL THEN 'Open Failure' WHEN h <= 4.0 THEN 'Recovered Within SLA' ELSE 'Recovered Late' END AS recovery_state
        FROM j)
"""

_CONSOLE = "WITH RECURSIVE " + _EDGES + """,
reach(anc, dsc) AS (SELECT source, target FROM edges UNION SELECT r.anc, e.target FROM reach r JOIN edges e ON r.dsc = e.source),
down AS (SELECT label AS task_name, max(c) AS c FROM (SELECT n.label, (SELECT count(*) FROM reach WHERE anc = n.task_id) AS c FROM nodes n) GROUP BY 1),
""" + _runs(D30, "AND scheduled_time < TIMESTAMP '2001-08-02 00:00:00'") + "," + _RECOVERY + f""",
f AS (SELECT {KEY}, query_id, scheduled_time, error_code, error_message, duration_sec, {_category_sql('error_message')} AS failure_category,
             {_SIG} AS error_signature FROM r WHERE state = 'FAILED'),
pat AS (SELECT failure_category, error_signature, count(*) AS pattern_failure_count,
               count(DISTINCT task_name) AS pattern_task_count FROM f GROUP BY 1, 2),
k AS (SELECT f.* REPLACE (substr(f.error_signature, 1, 180) AS error_signature), pattern_failure_count, pattern_task_count,
             CAST(coalesce(down.c, 0) AS BIGINT) AS downstream_task_count, coalesce(rec.recovery_state, 'No recent recovery signal') AS recovery_state
      FROM f JOIN pat ON f.failure_category = pat.failure_category AND f.error_signature = pat.error_signature
      LEFT JOIN down ON f.task_name = down.task_name
      LEFT JOIN rec ON f.database_name = rec.database_name AND f.schema_name = rec.schema_name AND f.task_name = rec.task_name),
c0 AS (SELECT *, failure_category IN ('Privilege / RBAC', 'Object Dependency / Drift', 'Warehouse / Runtime Capacity') AS crit FROM k),
c1 AS (SELECT * EXCLUDE (crit),
       CASE WHEN crit AND (downstream_task_count >= 3 OR pattern_task_count >= 2 OR pattern_failure_count >= 3) THEN 'P1 - Graph Incident'
            WHEN crit OR downstream_task_count >= 1 OR pattern_failure_count >= 3 THEN 'P2 - Production Risk'
            WHEN failure_category LIKE '%Data Quality%' OR duration_sec >= 300 THEN 'P3 - Pipeline Defect' ELSE 'P4 - Review' END AS incident_priority,
       CASE WHEN failure_category LIKE '%Privilege%' THEN 'Blocked - grant or role fix first'
            WHEN failure_category LIKE '%Object Dependency%' THEN 'Blocked - object dependency fix first'
            WHEN failure_category LIKE '%Warehouse%' THEN 'Blocked - warehouse or capacity review first'
            WHEN failure_category LIKE '%Data Quality%' THEN 'Blocked - data correction first'
            ELSE 'Ready after DBA owner approval' END AS recovery_readiness FROM c0),
con AS (SELECT *, CASE substr(incident_priority, 1, 2) WHEN 'P1' THEN 'Critical' WHEN 'P2' THEN 'High' WHEN 'P3' THEN 'Medium' ELSE 'Low' END AS severity
        FROM c1)
"""


def _console(spark, sf):
    failed = tsk.runs(_t(spark, sf), ORDERS_AS_OF, 30).filter(F.col("state") == "FAILED").select(F.col("task_name").alias("label"))
    return tsk.failure_console(_t(spark, sf), ORDERS_AS_OF, 30, impact=graph_impact(tv.load(spark, sf, "task_graph"), failed))


@register("task_failure_console", "task_history", "task_graph", op="TSK-5", sql=_CONSOLE + "SELECT * FROM con")
def _(spark, sf):
    return _console(spark, sf)


@register("task_failure_console_summary", "task_history", "task_graph", op="TSK-5", sql=_CONSOLE + """
SELECT count(*) AS failures, count(DISTINCT failure_category) AS categories, count(DISTINCT task_name) AS tasks,
       count_if(incident_priority LIKE 'P1%' OR incident_priority LIKE 'P2%') AS critical, count_if(incident_priority LIKE 'P1%') AS p1_incidents,
       count_if(recovery_readiness LIKE 'Blocked%') AS blocked_recoveries FROM con
""")
def _(spark, sf):
    return tsk.failure_console_summary(_console(spark, sf))


@register("task_failure_patterns", "task_history", "task_graph", op="TSK-5", sql=_CONSOLE + """
SELECT failure_category, error_signature, count(*) AS failure_count, count(DISTINCT task_name) AS task_count,
       min(incident_priority) AS incident_priority, min(recovery_readiness) AS recovery_readiness,
       max(downstream_task_count) AS downstream_task_count, min(scheduled_time) AS first_seen, max(scheduled_time) AS last_seen
FROM con GROUP BY 1, 2
""")
def _(spark, sf):
    return tsk.failure_patterns(_console(spark, sf))


@register("task_recovery_sla", "task_history", op="TSK-6", sql="WITH " + _runs(D30, "AND scheduled_time < TIMESTAMP '2001-08-02 00:00:00'") + f""",
lf AS (SELECT {KEY}, max(scheduled_time) AS failure_at FROM r WHERE state = 'FAILED' GROUP BY 1, 2, 3),
rc AS (SELECT r.database_name, r.schema_name, r.task_name, min(r.scheduled_time) AS recovery_at
       FROM r JOIN lf ON r.database_name = lf.database_name AND r.schema_name = lf.schema_name AND r.task_name = lf.task_name
       WHERE r.state = 'SUCCEEDED' AND r.scheduled_time > lf.failure_at GROUP BY 1, 2, 3),
j AS (SELECT lf.*, rc.recovery_at,
             CASE WHEN rc.recovery_at IS NOT NULL THEN date_diff('microsecond', lf.failure_at, rc.recovery_at) / 1e6 / 3600.0
                  ELSE date_diff('microsecond', lf.failure_at, TIMESTAMP '2001-08-02 00:00:00') / 1e6 / 3600.0 END AS h
      FROM lf LEFT JOIN rc ON lf.database_name = rc.database_name AND lf.schema_name = rc.schema_name AND lf.task_name = rc.task_name)
SELECT {KEY}, failure_at, recovery_at, round(greatest(h, 0.0), 2) AS recovery_hours,
       CASE WHEN recovery_at IS NULL THEN 'Open Failure' WHEN h <= 4.0 THEN 'Recovered Within SLA' ELSE 'Recovered Late' END AS recovery_state
FROM j
""")
def _(spark, sf):
    return tsk.recovery_sla(_t(spark, sf), ORDERS_AS_OF, 30, 4.0)


_PROC = "trim(regexp_extract(query_text, '(?i)CALL\\s+([^(]+)', 1))"


@register("procedure_calls", "query_history", op="TSK-9", sql=f"""
SELECT {_PROC} AS procedure_name, count(*) AS calls, max(start_time) AS last_call,
       round(avg(total_elapsed_time / 1000.0), 2) AS avg_elapsed_sec, count_if(execution_status <> 'SUCCESS') AS failed_calls
FROM query_history WHERE start_time >= TIMESTAMP '2024-01-24 00:00:00' AND query_type = 'CALL' GROUP BY 1
""")
def _(spark, sf):
    return tsk.procedure_calls(tv.load(spark, sf, "query_history"), EVENTS_AS_OF, 7)


@register("task_status_counts", "task_history", op="TSK-14", sql="WITH " + _runs(D30) + f"""
SELECT CASE WHEN regexp_matches(state, '(?i)^(succeeded|success|done|complete[d]?)$') THEN 'Success'
            WHEN regexp_matches(state, '(?i)(fail|error|abort)') THEN 'Failure'
            WHEN regexp_matches(state, '(?i)(cancel|skip)') THEN 'Cancelled'
            WHEN regexp_matches(state, '(?i)(run|execut|start|queue|schedul)') THEN 'Active' ELSE 'Other' END AS status_family,
       count(*) AS runs, count(DISTINCT ({KEY})) AS tasks
FROM r GROUP BY 1
""")
def _(spark, sf):
    return tsk.status_counts(_t(spark, sf), ORDERS_AS_OF, 30)


_SLI = """
t AS (SELECT count_if(state = 'SUCCEEDED') * 100.0 / nullif(count(*), 0) AS v FROM task_history
      WHERE scheduled_time >= TIMESTAMP '2001-07-26 00:00:00' AND state IN ('SUCCEEDED', 'FAILED')),
q AS (SELECT round(quantile_cont(total_elapsed_time / 1000.0, 0.95), 2) AS v FROM query_history
      WHERE start_time >= TIMESTAMP '2024-01-24 00:00:00' AND execution_status = 'SUCCESS' AND warehouse_name IS NOT NULL),
c AS (SELECT round(avg(d), 2) AS v FROM (SELECT CAST(start_time AS DATE), sum(credits_used) * 3.68 AS d FROM warehouse_metering
      WHERE start_time >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY 1)),
a AS (SELECT count_if(date_diff('hour', created_at, coalesce(resolved_at, TIMESTAMP '2001-08-02 00:00:00')) <= 24) * 100.0
             / nullif(count(*), 0) AS v FROM alerts WHERE created_at >= TIMESTAMP '2001-07-03 00:00:00'),
sli AS (SELECT 'task_success_rate' AS slo_id, CAST(v AS DOUBLE) AS sli_value FROM t
        UNION ALL SELECT 'query_p95_latency', v FROM q UNION ALL SELECT 'daily_cost_limit', v FROM c
        UNION ALL SELECT 'alert_resolution_24h', CAST(v AS DOUBLE) FROM a)
"""


def _indicators(spark, sf):
    return tsk.service_indicators(_t(spark, sf), tv.load(spark, sf, "query_history"),
                                  tv.load(spark, sf, "warehouse_metering"), tv.load(spark, sf, "alerts"),
                                  ORDERS_AS_OF, EVENTS_AS_OF, ORDERS_AS_OF)


@register("service_indicators", "task_history", "query_history", "warehouse_metering", "alerts", op="SLO-1",
          sql="WITH " + _SLI + "SELECT * FROM sli")
def _(spark, sf):
    return _indicators(spark, sf)


@register("error_budget", "task_history", "query_history", "warehouse_metering", "alerts", op="SLO-2",
          sql="WITH " + _SLI + "," + values_cte("slos", ["slo_id", "target", "higher_is_better"], tsk.DEFAULT_SLOS) + """,
j AS (SELECT sli.slo_id, CAST(target AS DOUBLE) AS target, sli_value,
             CASE WHEN higher_is_better THEN 100.0 - target ELSE target END AS allowed,
             CASE WHEN higher_is_better THEN 100.0 - sli_value ELSE sli_value END AS actual FROM sli JOIN slos USING (slo_id))
SELECT slo_id, target, round(sli_value, 2) AS sli_value,
       CASE WHEN allowed <= 0 THEN 0.0 ELSE round(100.0 - actual / allowed * 100, 1) END AS budget_remaining_pct,
       CASE WHEN allowed <= 0 THEN 99.0 ELSE round(actual / allowed * 100 / 100.0, 2) END AS burn_rate,
       CASE WHEN sli_value IS NULL THEN 'unmeasured' WHEN allowed <= 0 THEN 'breached'
            WHEN 100.0 - actual / allowed * 100 <= 0 THEN 'breached' WHEN actual / allowed * 100 / 100.0 > 2.0 THEN 'critical'
            WHEN actual / allowed * 100 / 100.0 > 1.0 THEN 'warning' ELSE 'healthy' END AS status
FROM j
""")
def _(spark, sf):
    return tsk.error_budget(_indicators(spark, sf))


@register("alert_resolution_metrics", "alerts", op="SLO-3", sql="""
WITH a AS (SELECT *, upper(status) IN ('NEW', 'OPEN', 'ESCALATED') AS is_open,
                  upper(status) IN ('RESOLVED', 'FIXED', 'CLOSED') AND resolved_at IS NOT NULL AS res,
                  date_diff('microsecond', created_at, TIMESTAMP '2001-08-02 00:00:00') / 1e6 / 3600.0 AS age,
                  date_diff('microsecond', created_at, resolved_at) / 1e6 / 3600.0 AS dur
           FROM alerts WHERE created_at < TIMESTAMP '2001-08-02 00:00:00')
SELECT count_if(is_open) AS total_open, coalesce(round(max(CASE WHEN is_open THEN age END), 1), 0.0) AS oldest_hours,
       coalesce(round(avg(CASE WHEN is_open THEN age END), 1), 0.0) AS avg_hours,
       coalesce(round(count_if(res AND dur <= 24) * 100.0 / nullif(count_if(res), 0), 1), 0.0) AS pct_resolved_24h,
       round(avg(CASE WHEN res AND dur > 0 THEN dur END), 1) AS mttr_hours
FROM a
""")
def _(spark, sf):
    return tsk.alert_resolution_metrics(tv.load(spark, sf, "alerts"), ORDERS_AS_OF)
