"""Registered alert, queue, recommendation and score queries (ALR-*, ACT-*, REC-*, SCR-*)."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from opslens.functions.timeutil import ts_lit
from opslens.operators import alerts as al
from opslens.operators import capacity as cap
from opslens.operators import security as sec
from opslens.plans import q_security, q_tasks
from opslens.plans.registry import register
from opslens.sources import testviews as tv
from opslens.sources.testviews import EVENTS_AS_OF, ORDERS_AS_OF

NOW = "TIMESTAMP '2001-08-02 00:00:00'"

_TRI = f"""
na AS (SELECT alert_id, created_at AS alert_ts, entity, alert_type,
              CASE upper(trim(coalesce(severity, 'Medium'))) WHEN 'CRITICAL' THEN 'Critical' WHEN 'HIGH' THEN 'High'
                   WHEN 'LOW' THEN 'Low' ELSE 'Medium' END AS severity,
              CASE WHEN upper(replace(trim(coalesce(status, 'New')), '_', ' ')) IN ('RESOLVED', 'FIXED') THEN 'Fixed'
                   WHEN upper(replace(trim(coalesce(status, 'New')), '_', ' ')) = 'IGNORED' THEN 'Ignored'
                   ELSE upper(substr(trim(status), 1, 1)) || lower(substr(trim(status), 2)) END AS status,
              coalesce(owner, 'DBA') AS owner, resolved_at, message
       FROM alerts WHERE created_at >= TIMESTAMP '2001-07-03 00:00:00' AND created_at < {NOW}),
na2 AS (SELECT *, severity || ' - ' || alert_type || ' - ' || entity AS subject,
               round(greatest(0.0, date_diff('microsecond', alert_ts, {NOW}) / 1e6 / 3600.0), 1) AS alert_age_hours,
               CASE severity WHEN 'Critical' THEN 4 WHEN 'High' THEN 8 WHEN 'Low' THEN 72 ELSE 24 END AS sla_target_hours,
               upper(status) IN ('FIXED', 'IGNORED', 'RESOLVED') AS closed FROM na),
na3 AS (SELECT *, CASE WHEN closed THEN 'Closed' WHEN alert_age_hours > sla_target_hours THEN 'Overdue'
                       WHEN alert_age_hours >= sla_target_hours * 0.75 THEN 'Due Soon' ELSE 'Within SLA' END AS sla_state FROM na2),
tri AS (SELECT alert_id, alert_ts, entity, alert_type, severity, status, owner, resolved_at, message, subject, alert_age_hours,
               sla_target_hours, sla_state,
               CASE WHEN sla_state = 'Overdue' AND severity IN ('Critical', 'High') THEN 'DBA Lead' ELSE owner END AS escalation_target,
               CAST(CASE severity WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END * 100
                    + CASE sla_state WHEN 'Overdue' THEN 0 WHEN 'Due Soon' THEN 1 WHEN 'Within SLA' THEN 2 ELSE 9 END * 10
                    + CASE WHEN upper(replace(status, ' ', '_')) IN ('NEW', 'EMAIL_READY', 'EMAIL_QUEUED', 'OPEN', 'ACTIVE', 'PENDING', 'ESCALATED') THEN 0
                           WHEN upper(replace(status, ' ', '_')) IN ('ACKNOWLEDGED', 'IN_PROGRESS') THEN 1
                           WHEN upper(replace(status, ' ', '_')) IN ('FIXED', 'RESOLVED') THEN 3
                           WHEN upper(replace(status, ' ', '_')) = 'IGNORED' THEN 4 ELSE 2 END AS INTEGER) AS triage_priority
        FROM na3)
"""


def _issues_sql():
    return (q_tasks._CONSOLE + "," + _TRI + ", sx AS (" + q_security.SECURITY_EXCEPTIONS_SQL + """),
u AS (SELECT 'alert' AS source, alert_id AS issue_id, severity, entity, alert_type AS issue_type, alert_ts AS seen_at FROM tri
      UNION ALL
      SELECT 'task_failure', query_id, severity, concat_ws('.', database_name, schema_name, task_name), failure_category,
             scheduled_time FROM con
      UNION ALL
      SELECT 'security', CAST(NULL AS VARCHAR), severity, entity, finding_type, last_seen FROM sx)
SELECT *, CASE upper(trim(coalesce(severity, 'Medium'))) WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'LOW' THEN 3 ELSE 2 END AS severity_rank
FROM u
""")


_ISSUES_SQL = _issues_sql()


def _tri(spark, sf):
    return al.triage(tv.load(spark, sf, "alerts"), ORDERS_AS_OF, 30)


@register("alert_triage", "alerts", op="ALR-2", sql="WITH " + _TRI + "SELECT * FROM tri")
def _(spark, sf):
    return _tri(spark, sf)


@register("alert_escalation_candidates", "alerts", op="ALR-3", sql="WITH " + _TRI + """
SELECT * FROM tri WHERE upper(status) NOT IN ('FIXED', 'IGNORED', 'RESOLVED')
  AND (severity IN ('Critical', 'High') OR sla_state IN ('Overdue', 'Due Soon') OR upper(coalesce(owner, '')) IN ('', 'DBA'))
ORDER BY triage_priority, alert_ts DESC, alert_id LIMIT 10
""")
def _(spark, sf):
    return al.escalation_candidates(_tri(spark, sf), 10)


@register("alert_digest_counters", "alerts", op="ALR-4", sql="WITH " + _TRI + """,
o AS (SELECT *, upper(status) NOT IN ('FIXED', 'IGNORED', 'RESOLVED') AS op FROM tri)
SELECT count(*) AS total, count_if(op) AS open, count_if(op AND severity IN ('Critical', 'High')) AS critical_high,
       count_if(op AND sla_state = 'Overdue') AS overdue, count_if(op AND sla_state = 'Due Soon') AS due_soon,
       count_if(op AND status = 'Email Ready') AS email_ready, count_if(op AND upper(owner) = 'DBA') AS needs_owner
FROM o
""")
def _(spark, sf):
    return al.digest_counters(_tri(spark, sf))


@register("alert_digest_body", "alerts", op="ALR-5", sql="WITH " + _TRI + """,
op AS (SELECT * FROM tri WHERE upper(status) NOT IN ('FIXED', 'IGNORED', 'RESOLVED')),
lines AS (SELECT CASE severity WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END AS r, alert_type,
                 severity || ' ' || alert_type || ': ' || CAST(count(*) AS VARCHAR) AS line FROM op GROUP BY severity, alert_type),
top AS (SELECT triage_priority, alert_id FROM op ORDER BY triage_priority, alert_ts DESC, alert_id LIMIT 25)
SELECT (SELECT string_agg(line, chr(10) ORDER BY r, alert_type, line) FROM lines) AS digest_body,
       (SELECT list(alert_id ORDER BY triage_priority, alert_id) FROM top) AS alert_ids
""")
def _(spark, sf):
    return al.digest_body(_tri(spark, sf), 25)


@register("issue_list", "alerts", "task_history", "login_history", "users", "role_grants", "object_grants", "databases", "task_graph", op="ALR-6",
          sql=_ISSUES_SQL)
def _(spark, sf):
    console = q_tasks._console(spark, sf)
    exc = q_security.exceptions(spark, sf)
    return al.issue_list(_tri(spark, sf), console, exc)


@register("alert_actions", "alerts", op="ALR-7", sql="WITH " + _TRI + """
SELECT alert_id, entity, alert_type, severity, status,
       TRY_CAST(regexp_extract(message, 'failed ([0-9]+) times', 1) AS INTEGER) AS failed_count,
       TRY_CAST(regexp_extract(message, 'duration ([0-9]+)s', 1) AS INTEGER) AS duration_sec,
       TRY_CAST(regexp_extract(message, 'baseline ([0-9]+)', 1) AS INTEGER) AS baseline_value,
       CASE WHEN TRY_CAST(regexp_extract(message, 'duration ([0-9]+)s', 1) AS INTEGER) IS NOT NULL
             AND TRY_CAST(regexp_extract(message, 'baseline ([0-9]+)', 1) AS INTEGER) > 0
            THEN round(TRY_CAST(regexp_extract(message, 'duration ([0-9]+)s', 1) AS INTEGER)
                       / TRY_CAST(regexp_extract(message, 'baseline ([0-9]+)', 1) AS INTEGER), 2) END AS slowdown_factor,
       CASE WHEN alert_type = 'TASK_FAILURE' THEN 'Retry task after fix' WHEN alert_type = 'COST_SPIKE' THEN 'Verify savings'
            ELSE 'Review' END AS next_action
FROM tri
""")
def _(spark, sf):
    return al.alert_actions(_tri(spark, sf))


@register("maintenance_suppression", "alerts", "maintenance_windows", op="ALR-8", sql="""
SELECT a.* FROM alerts a
WHERE NOT EXISTS (SELECT 1 FROM maintenance_windows w
                  WHERE a.created_at >= w.window_start AND a.created_at < w.window_end AND (w.entity IS NULL OR w.entity = a.entity))
""")
def _(spark, sf):
    return al.suppress_maintenance(tv.load(spark, sf, "alerts"), tv.load(spark, sf, "maintenance_windows"))


@register("daily_brief", "warehouse_metering", "task_history", "alerts", op="ALR-9", sql=f"""
WITH c AS (SELECT coalesce(sum(CASE WHEN start_time >= TIMESTAMP '2024-01-30 00:00:00' THEN credits_used END), 0.0) AS y,
                  coalesce(sum(CASE WHEN start_time < TIMESTAMP '2024-01-30 00:00:00' THEN credits_used END), 0.0) AS p
           FROM warehouse_metering WHERE start_time >= TIMESTAMP '2024-01-29 00:00:00' AND start_time < TIMESTAMP '2024-01-31 00:00:00'),
t AS (SELECT count_if(state = 'FAILED') AS failed_tasks FROM task_history
      WHERE scheduled_time >= TIMESTAMP '2001-08-01 00:00:00' AND scheduled_time < {NOW}),
a AS (SELECT count_if(upper(status) IN ('NEW', 'OPEN', 'ESCALATED')) AS open_alerts FROM alerts WHERE created_at < {NOW}),
j AS (SELECT *, round((y - p) / nullif(p, 0) * 100, 1) AS pct FROM c, t, a)
SELECT round(y, 4) AS credits_yesterday, pct AS credit_change_pct, failed_tasks, open_alerts,
       CAST(greatest(0, 100 - least(30, failed_tasks) - least(30, floor(open_alerts / 100)) - CASE WHEN pct > 20 THEN 10 ELSE 0 END) AS INTEGER) AS brief_score
FROM j
""")
def _(spark, sf):
    return al.daily_brief(tv.load(spark, sf, "warehouse_metering"), tv.load(spark, sf, "task_history"),
                          tv.load(spark, sf, "alerts"), EVENTS_AS_OF, ORDERS_AS_OF)


# ------------------------------------------------------------------ action queue

_EXC = """
exc_{n} AS (
SELECT 'Repeated login failures' AS finding, user_name AS entity, CAST(count(*) AS DOUBLE) AS value, 'High' AS severity
FROM login_history WHERE event_timestamp >= TIMESTAMP '{lo}' AND event_timestamp < TIMESTAMP '{hi}' AND is_success = 'NO'
GROUP BY user_name HAVING count(*) >= 5
UNION ALL
SELECT 'Many client addresses', user_name, CAST(count(DISTINCT client_ip) AS DOUBLE), 'Low' FROM login_history
WHERE event_timestamp >= TIMESTAMP '{lo}' AND event_timestamp < TIMESTAMP '{hi}' GROUP BY user_name HAVING count(DISTINCT client_ip) >= 4),
f_{n} AS (SELECT sha1(concat_ws('|', 'SECURITY', upper(trim(entity)), upper(trim(finding)))) AS action_id, 'security' AS category,
                 entity, finding, severity, coalesce(CAST(value AS VARCHAR), '') AS detail FROM exc_{n})
"""


def _login_findings(spark, sf, at):
    lg = tv.load(spark, sf, "login_history").filter(F.col("event_timestamp") < ts_lit(at))
    brute = (lg.filter((F.col("event_timestamp") >= ts_lit(at - timedelta(days=7))) & (F.col("is_success") == "NO"))
             .groupBy("user_name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 5)
             .select(F.lit("Repeated login failures").alias("finding"), F.col("user_name").alias("entity"),
                     F.col("n").cast("double").alias("value"), F.lit("High").alias("severity")))
    ips = (lg.filter(F.col("event_timestamp") >= ts_lit(at - timedelta(days=7)))
           .groupBy("user_name").agg(F.countDistinct("client_ip").alias("n")).filter(F.col("n") >= 4)
           .select(F.lit("Many client addresses").alias("finding"), F.col("user_name").alias("entity"),
                   F.col("n").cast("double").alias("value"), F.lit("Low").alias("severity")))
    return al.findings_from_exceptions(brute.unionByName(ips))


OLD_AT = EVENTS_AS_OF - timedelta(days=7)


def _stored(spark, sf):
    f = _login_findings(spark, sf, OLD_AT)
    fixed = F.col("severity") == "Low"
    return f.select("*", F.when(fixed, "Fixed").otherwise("Open").alias("status"),
                    ts_lit(OLD_AT).alias("first_seen_at"), ts_lit(OLD_AT).alias("last_seen_at"),
                    F.lit(1).cast("bigint").alias("seen_count"),
                    F.when(fixed, ts_lit(OLD_AT + timedelta(days=2))).alias("fixed_at"))


def _queue(spark, sf):
    return al.upsert_findings(_stored(spark, sf), _login_findings(spark, sf, EVENTS_AS_OF), EVENTS_AS_OF)


_QUEUE = ("WITH " + _EXC.format(n="old", lo="2024-01-17 00:00:00", hi="2024-01-24 00:00:00") + ","
          + _EXC.format(n="new", lo="2024-01-24 00:00:00", hi="2024-01-31 00:00:00") + """,
st AS (SELECT *, CASE WHEN severity = 'Low' THEN 'Fixed' ELSE 'Open' END AS status, TIMESTAMP '2024-01-24 00:00:00' AS first_seen_at,
              TIMESTAMP '2024-01-24 00:00:00' AS last_seen_at, CAST(1 AS BIGINT) AS seen_count,
              CASE WHEN severity = 'Low' THEN TIMESTAMP '2024-01-26 00:00:00' END AS fixed_at FROM f_old),
q AS (SELECT coalesce(n.action_id, o.action_id) AS action_id,
             coalesce(nullif(trim(n.category), ''), o.category) AS category, coalesce(nullif(trim(n.entity), ''), o.entity) AS entity,
             coalesce(nullif(trim(n.finding), ''), o.finding) AS finding, coalesce(nullif(trim(n.severity), ''), o.severity) AS severity,
             coalesce(nullif(trim(n.detail), ''), o.detail) AS detail, coalesce(o.status, 'Open') AS status,
             coalesce(o.first_seen_at, TIMESTAMP '2024-01-31 00:00:00') AS first_seen_at,
             CASE WHEN n.action_id IS NOT NULL THEN TIMESTAMP '2024-01-31 00:00:00' ELSE o.last_seen_at END AS last_seen_at,
             CAST(coalesce(o.seen_count, 0) + CASE WHEN n.action_id IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS seen_count,
             o.fixed_at
      FROM f_new n FULL OUTER JOIN st o ON n.action_id = o.action_id)
""")


@register("action_queue_upsert", "login_history", op="ACT-1", sql=_QUEUE + "SELECT * FROM q")
def _(spark, sf):
    return _queue(spark, sf)


@register("action_queue_enriched", "login_history", op="ACT-2", sql=_QUEUE + """,
e AS (SELECT *, CAST(first_seen_at AS DATE) + 14 AS due_date, date_diff('day', DATE '2024-01-31', CAST(first_seen_at AS DATE) + 14) AS days_left
      FROM q),
s AS (SELECT *, CASE WHEN status = 'Fixed' THEN 'Closed' WHEN days_left < 0 THEN 'Overdue' WHEN days_left <= 3 THEN 'Due Soon'
                     ELSE 'On Track' END AS due_state FROM e)
SELECT action_id, category, entity, finding, severity, detail, status, first_seen_at, last_seen_at, seen_count, fixed_at,
       due_date, days_left, due_state,
       CASE WHEN trim(coalesce(detail, '')) = '' THEN 'Missing evidence' ELSE 'Evidence attached' END AS evidence_gap,
       CASE WHEN status = 'Fixed' THEN 'Verify savings' WHEN severity = 'High' THEN 'Escalate to owner'
            WHEN seen_count > 1 THEN 'Confirm recurring finding' ELSE 'Assign owner' END AS next_action,
       CAST(CASE WHEN severity = 'High' THEN 300 WHEN severity = 'Medium' THEN 200 ELSE 100 END
            + CASE WHEN due_state = 'Overdue' THEN 50 WHEN due_state = 'Due Soon' THEN 25 ELSE 0 END + least(seen_count, 20) AS INTEGER) AS priority
FROM s
""")
def _(spark, sf):
    return al.enrich_queue(_queue(spark, sf), EVENTS_AS_OF, 14)


@register("action_closure_analytics", "login_history", op="ACT-3", sql=_QUEUE + """
SELECT category, count(*) AS actions, count_if(status <> 'Fixed') AS open, count_if(status = 'Fixed') AS fixed,
       round(avg(CASE WHEN status = 'Fixed' THEN date_diff('day', CAST(first_seen_at AS DATE), CAST(fixed_at AS DATE)) END), 1) AS avg_days_to_close,
       arg_max(entity, {'s': seen_count, 'e': entity}) AS top_entity,
       round(count_if(status = 'Fixed') * 100.0 / count(*), 1) AS closure_rate_pct
FROM q GROUP BY 1
""")
def _(spark, sf):
    return al.closure_analytics(_queue(spark, sf))


SAVINGS_VERIFICATION_SQL = """
WITH up AS (SELECT warehouse_name, count(*) AS query_count FROM query_history
            WHERE start_time >= TIMESTAMP '2024-01-24 00:00:00' AND warehouse_name IS NOT NULL GROUP BY 1),
acts AS (SELECT upper(w.warehouse_name) AS k, 'act-' || w.warehouse_name AS action_id, TIMESTAMP '2024-01-21 00:00:00' AS acted_at
         FROM warehouses w LEFT JOIN up ON w.warehouse_name = up.warehouse_name
         WHERE w.auto_suspend = 0 OR (w.auto_suspend > 120 AND coalesce(up.query_count, 0) < 1000)),
m AS (SELECT upper(warehouse_name) AS k, CAST(start_time AS DATE) AS d, sum(credits_used) AS c FROM warehouse_metering
      WHERE start_time >= TIMESTAMP '2023-12-27 00:00:00' AND start_time < TIMESTAMP '2024-01-31 00:00:00' GROUP BY 1, 2),
g AS (SELECT action_id, m.k, avg(CASE WHEN d >= DATE '2024-01-24' THEN c END) AS r,
             avg(CASE WHEN d < CAST(acted_at AS DATE) AND NOT (d >= DATE '2024-01-24') THEN c END) AS b
      FROM m JOIN acts ON m.k = acts.k GROUP BY 1, 2)
SELECT action_id, k AS warehouse_name, round(r, 4) AS recent_daily_credits, round(b, 4) AS baseline_daily_credits,
       round((b - r) / nullif(b, 0) * 100, 1) AS savings_pct,
       CASE WHEN r IS NULL OR b IS NULL THEN 'Insufficient data' WHEN (b - r) / nullif(b, 0) * 100 >= 10 THEN 'Savings verified'
            WHEN (b - r) / nullif(b, 0) * 100 > -10 THEN 'No change' ELSE 'Cost increased' END AS outcome
FROM g
"""


@register("savings_verification", "warehouses", "query_history", "warehouse_metering", op="ACT-5", sql=SAVINGS_VERIFICATION_SQL)
def _(spark, sf):
    s = cap.suspend_timeout_analysis(tv.load(spark, sf, "warehouses"), tv.load(spark, sf, "query_history"),
                                     tv.load(spark, sf, "warehouse_metering"), EVENTS_AS_OF, 7)
    acts = s.select(F.col("warehouse_name").alias("entity"), F.concat(F.lit("act-"), "warehouse_name").alias("action_id"),
                    ts_lit(EVENTS_AS_OF - timedelta(days=10)).alias("acted_at"))
    return al.savings_verification(tv.load(spark, sf, "warehouse_metering"), acts, EVENTS_AS_OF, 28)


@register("spill_candidates", "query_history", op="REC-2", sql="""
SELECT warehouse_name, count_if(bytes_spilled_to_remote_storage > 0) AS spill_queries,
       round(sum(bytes_spilled_to_remote_storage) / (1024.0 * 1024 * 1024), 3) AS remote_spill_gb
FROM query_history WHERE start_time >= TIMESTAMP '2024-01-24 00:00:00' AND warehouse_name IS NOT NULL GROUP BY 1
HAVING round(sum(bytes_spilled_to_remote_storage) / (1024.0 * 1024 * 1024), 3) >= 0.001
ORDER BY remote_spill_gb DESC, warehouse_name LIMIT 20
""")
def _(spark, sf):
    return al.spill_candidates(tv.load(spark, sf, "query_history"), EVENTS_AS_OF, 7)


@register("failing_task_candidates", "task_history", op="REC-3", sql="""
SELECT database_name, schema_name, name AS task_name, count_if(state = 'FAILED') AS failures, count(*) AS runs
FROM task_history WHERE scheduled_time >= TIMESTAMP '2001-07-03 00:00:00' GROUP BY 1, 2, 3 HAVING count_if(state = 'FAILED') >= 2
ORDER BY failures DESC, 1, 2, 3 LIMIT 20
""")
def _(spark, sf):
    return al.failing_task_candidates(tv.load(spark, sf, "task_history"), ORDERS_AS_OF, 30)


@register("query_error_candidates", "query_history", op="REC-4", sql="""
SELECT user_name, error_code, count(*) AS errors, max(start_time) AS last_error FROM query_history
WHERE start_time >= TIMESTAMP '2024-01-24 00:00:00' AND execution_status <> 'SUCCESS' GROUP BY 1, 2 HAVING count(*) >= 2
ORDER BY errors DESC, 1, 2 LIMIT 20
""")
def _(spark, sf):
    return al.query_error_candidates(tv.load(spark, sf, "query_history"), EVENTS_AS_OF, 7, 2)


@register("optimizer_candidates", "warehouses", "warehouse_metering", "login_history", op="REC-7", sql=_QUEUE + """,
m AS (SELECT warehouse_name, sum(credits_used) AS credits, count(DISTINCT date_trunc('hour', start_time)) AS hours
      FROM warehouse_metering WHERE start_time >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY 1),
j AS (SELECT w.warehouse_name, w.warehouse_size, w.auto_suspend,
             coalesce(m.credits, 0.0) * 100 / nullif(CASE w.warehouse_size WHEN 'X-Small' THEN 1 WHEN 'Small' THEN 2 WHEN 'Medium' THEN 4
                  WHEN 'Large' THEN 8 WHEN 'X-Large' THEN 16 WHEN '2X-Large' THEN 32 WHEN '3X-Large' THEN 64 WHEN '4X-Large' THEN 128
                  WHEN '5X-Large' THEN 256 WHEN '6X-Large' THEN 512 ELSE 1 END * coalesce(m.hours, 0), 0) AS util
      FROM warehouses w LEFT JOIN m ON w.warehouse_name = m.warehouse_name),
c AS (SELECT warehouse_name, warehouse_size, auto_suspend, round(util, 1) AS utilisation_pct,
             CASE WHEN auto_suspend = 0 THEN 'Never suspends' WHEN util < 20 THEN 'Under 20% used' END AS reason FROM j)
SELECT * FROM c WHERE reason IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM q WHERE q.status <> 'Fixed' AND upper(q.entity) = upper(c.warehouse_name))
""")
def _(spark, sf):
    return al.optimizer_candidates(tv.load(spark, sf, "warehouses"), tv.load(spark, sf, "warehouse_metering"),
                                   _queue(spark, sf), EVENTS_AS_OF, 7)


PLATFORM_HEALTH_SCORE_SQL = """
WITH t AS (SELECT count_if(state = 'SUCCEEDED') * 100.0 / nullif(count(*), 0) AS rel FROM task_history
           WHERE scheduled_time >= TIMESTAMP '2001-07-26 00:00:00' AND state IN ('SUCCEEDED', 'FAILED')),
q AS (SELECT count_if(total_elapsed_time <= 60000) * 100.0 / nullif(count(*), 0) AS perf FROM query_history
      WHERE start_time >= TIMESTAMP '2024-01-24 00:00:00'),
d AS (SELECT greatest(0.0, 100 - stddev_samp(c) * 100 / nullif(avg(c), 0)) AS cost FROM
      (SELECT CAST(start_time AS DATE), sum(credits_used) AS c FROM warehouse_metering
       WHERE start_time >= TIMESTAMP '2024-01-17 00:00:00' AND start_time < TIMESTAMP '2024-01-31 00:00:00' GROUP BY 1)),
s AS (SELECT 100 - count_if(is_success = 'NO') * 100.0 / nullif(count(*), 0) AS sec FROM login_history
      WHERE event_timestamp >= TIMESTAMP '2024-01-24 00:00:00'),
j AS (SELECT *, coalesce(cost, 0.0) * 0.25 + coalesce(rel, 0.0) * 0.30 + coalesce(perf, 0.0) * 0.25 + coalesce(sec, 0.0) * 0.20 AS score
      FROM t, q, d, s)
SELECT round(cost, 1) AS cost_score, round(rel, 1) AS reliability_score, round(perf, 1) AS performance_score,
       round(sec, 1) AS security_score, round(score, 1) AS health_score,
       CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade
FROM j
"""


@register("platform_health_score", "warehouse_metering", "task_history", "query_history", "login_history", op="SCR-4", sql=PLATFORM_HEALTH_SCORE_SQL)
def _(spark, sf):
    return al.platform_health(tv.load(spark, sf, "warehouse_metering"), tv.load(spark, sf, "task_history"),
                              tv.load(spark, sf, "query_history"), tv.load(spark, sf, "login_history"),
                              EVENTS_AS_OF, ORDERS_AS_OF)
