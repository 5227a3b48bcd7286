"""Registered action-queue views over alert rows with workflow columns."""

from __future__ import annotations

from opslens.operators import queue as qu
from opslens.plans.registry import register
from opslens.sources import testviews as tv
from opslens.sources.testviews import EVENTS_AS_OF, ORDERS_AS_OF

_D = "CAST(substr(alert_id, length(alert_id), 1) AS INT)"
_E = "CAST(substr(entity, length(entity), 1) AS INT)"
#: workflow columns of an action, written once and run by both engines
_COLUMNS = [
    "alert_id AS action_id", "entity AS entity_name", "'WAREHOUSE' AS entity_type", "severity", "'alerts' AS source",
    f"CASE {_D} % 5 WHEN 0 THEN 'New' WHEN 1 THEN 'Acknowledged' WHEN 2 THEN 'In Progress' WHEN 3 THEN 'Fixed' ELSE 'Ignored' END AS status",
    "CASE alert_type WHEN 'COST_SPIKE' THEN 'Cost Control' WHEN 'TASK_FAILURE' THEN 'Task & Procedure Reliability' ELSE 'Security' END AS category",
    f"CASE WHEN {_D} % 4 = 3 THEN NULL ELSE CAST(created_at AS DATE) + ({_D} * 4) END AS due_date",
    "coalesce(owner, 'DBA') AS owner", f"CASE WHEN {_E} = 4 THEN 'directory' END AS owner_source", f"CASE WHEN {_E} = 4 THEN 'oncall' END AS oncall_primary",
    f"CASE WHEN {_D} % 3 = 1 THEN 'N/A' ELSE 'CHG-1' END AS ticket_id", f"CASE WHEN {_E} % 5 = 2 THEN NULL ELSE 'lead' END AS approver",
    f"CASE {_E} WHEN 1 THEN NULL WHEN 3 THEN 'DROP TABLE t' WHEN 5 THEN 'SELECT 1; SELECT 2' WHEN 7 THEN 'SELECT ''drop'' AS x' ELSE 'SELECT 1' END AS verification_query",
    f"CASE WHEN {_E} > 5 THEN 'Verified' ELSE 'Pending' END AS verification_status", f"CASE WHEN {_E} > 6 THEN 'ok' END AS verification_result",
    f"CASE WHEN {_D} % 2 = 0 THEN 'noise' END AS ignored_reason",
    f"CASE WHEN {_E} = 6 THEN NULL ELSE CAST(40 + {_E} * 10 AS DOUBLE) END AS baseline_value", f"CAST(60 + {_E} * 10 AS DOUBLE) AS current_value",
    f"CASE WHEN {_E} % 3 = 0 THEN 'Requested' ELSE 'Approved' END AS owner_approval_status",
    f"CASE WHEN {_E} % 2 = 0 THEN 'Open Failure' END AS recovery_sla_state", f"CASE WHEN {_E} = 8 THEN 'run ok' END AS recovery_evidence",
    f"CAST({_E} AS DOUBLE) * 10.0 AS est_monthly_savings",
]
_A = "a AS (SELECT " + ", ".join(_COLUMNS) + " FROM alerts)"


def _actions(spark, sf):
    return tv.load(spark, sf, "alerts").selectExpr(*_COLUMNS)


def _has(c: str) -> str:
    return f"(upper(trim(coalesce(CAST({c} AS VARCHAR), ''))) NOT IN ('', 'N/A', 'NONE', 'NULL'))"


_UNQUOTED = "regexp_replace(regexp_replace(trim(coalesce(verification_query, '')), ';\\s*$', ''), '''[^'']*''', '''''', 'g')"


@register("action_queue_view", "alerts", op="ACT-2", sql=f"""
WITH {_A},
b AS (SELECT *, upper(status) AS st, upper(category) LIKE '%COST%' AS is_cost, category = 'Task & Procedure Reliability' AS is_task,
             DATE '{ORDERS_AS_OF:%Y-%m-%d}' AS today, upper(coalesce(owner_approval_status, '')) IN ('', 'PENDING', 'REQUESTED', 'REQUIRED') AS open_ap FROM a),
c AS (SELECT *, list_filter([
   CASE WHEN upper(trim(owner)) IN ('', 'N/A', 'UNKNOWN', 'UNKNOWN USER', 'UNKNOWN WAREHOUSE', 'DBA', 'DBA / FINOPS', 'DBA / DATA ENGINEERING')
             AND NOT ({_has('owner_source')} AND {_has('oncall_primary')}) THEN 'needs named owner' END,
   CASE WHEN NOT {_has('ticket_id')} THEN 'missing ticket/change ID' END, CASE WHEN NOT {_has('approver')} THEN 'missing approver' END,
   CASE WHEN coalesce(verification_query, '') = '' THEN 'missing verification query'
        WHEN contains({_UNQUOTED}, ';') OR NOT regexp_matches({_UNQUOTED}, '(?i)^\\s*(SELECT|WITH|SHOW|DESCRIBE|DESC|EXPLAIN)\\b')
             OR regexp_matches({_UNQUOTED}, '(?i)\\b(ALTER|INSERT|UPDATE|DELETE|MERGE|DROP|CREATE|GRANT|REVOKE|CALL|EXECUTE|COPY|PUT|GET|TRUNCATE|UNDROP)\\b')
        THEN 'verification query not runnable' END,
   CASE WHEN (is_cost OR is_task) AND (baseline_value IS NULL OR current_value IS NULL) THEN 'missing baseline/current value' END,
   CASE WHEN (is_cost OR is_task) AND open_ap THEN 'missing owner approval' END,
   CASE WHEN is_cost AND NOT {_has('recovery_sla_state')} THEN 'missing savings/chargeback closure state' END,
   CASE WHEN is_task AND upper(coalesce(recovery_sla_state, '')) IN ('OPEN FAILURE', 'RECOVERED LATE', 'RECOVERY SLA BREACH')
             AND NOT {_has('recovery_evidence')} THEN 'missing recovery evidence' END], lambda x: x IS NOT NULL) AS gaps FROM b),
d AS (SELECT *, CASE WHEN st IN ('FIXED', 'IGNORED') THEN 'Closed' WHEN due_date IS NULL THEN 'Unscheduled' WHEN due_date < today THEN 'Overdue'
                     WHEN due_date = today THEN 'Due today' WHEN due_date <= today + 2 THEN 'Due soon' ELSE 'Scheduled' END AS due_state,
             CAST(date_diff('day', today, due_date) AS INT) AS sla_days_remaining,
             CASE WHEN st = 'FIXED' AND upper(verification_status) IN ('VERIFIED', 'VERIFIED_SAVED', 'VERIFIED_NO_CHANGE') AND {_has('verification_result')} THEN 'Verified closure'
                  WHEN st = 'FIXED' THEN 'Fixed without verification' WHEN st = 'IGNORED' AND {_has('ignored_reason')} THEN 'Ignored with reason'
                  WHEN st = 'IGNORED' THEN 'Ignored without reason' WHEN len(gaps) = 0 THEN 'Ready to work'
                  ELSE array_to_string(gaps[1:3], '; ') END AS evidence_gap FROM c)
SELECT action_id, status, due_state, sla_days_remaining, evidence_gap,
       CASE WHEN st = 'FIXED' AND evidence_gap = 'Verified closure' THEN 'No action: keep verified closure evidence for audit.'
            WHEN st = 'FIXED' THEN 'Attach verification result/notes or reopen the item for DBA review.'
            WHEN st = 'IGNORED' THEN 'Retain the ignore reason and review if the signal reappears.'
            WHEN due_state = 'Overdue' THEN 'Escalate owner/ticket, validate proof, and move this before lower-risk work.'
            WHEN evidence_gap <> 'Ready to work' THEN 'Complete control metadata first: ' || evidence_gap || '.'
            WHEN is_cost THEN 'Explain the driver, approve any warehouse change, then verify next-period credits.'
            WHEN is_task THEN 'Fix root cause, retry only after owner approval, then verify the next run.'
            ELSE 'Acknowledge, assign ownership, perform the recommended action, and attach proof.' END AS next_action,
       CAST(CASE st WHEN 'NEW' THEN 0 WHEN 'ACKNOWLEDGED' THEN 1 WHEN 'IN PROGRESS' THEN 2 WHEN 'FIXED' THEN 4 WHEN 'IGNORED' THEN 5 ELSE 3 END * 20
            + CASE upper(severity) WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END
            + CASE due_state WHEN 'Overdue' THEN -20 WHEN 'Due today' THEN -15 WHEN 'Due soon' THEN -8 WHEN 'Scheduled' THEN 0 WHEN 'Unscheduled' THEN 4 ELSE 30 END
            + CASE evidence_gap WHEN 'Ready to work' THEN 0 WHEN 'Verified closure' THEN 30 WHEN 'Ignored with reason' THEN 30 ELSE -2 END AS DOUBLE) AS queue_priority
FROM d
""")
def _(spark, sf):
    return qu.queue_view(_actions(spark, sf), ORDERS_AS_OF).select(
        "action_id", "status", "due_state", "sla_days_remaining", "evidence_gap", "next_action", "queue_priority")


@register("savings_outcomes", "alerts", "warehouse_metering", op="ACT-5", sql=f"""
WITH {_A},
p AS (SELECT upper(warehouse_name) AS k, sum(coalesce(credits_used, 0)) AS c FROM warehouse_metering
      WHERE start_time >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 7 DAY AND start_time < TIMESTAMP '{EVENTS_AS_OF}' GROUP BY 1)
SELECT action_id, entity_name, status, baseline_value, current_value AS detection_current_value, round(c, 4) AS post_period_value,
       round(c - current_value, 4) AS measured_delta, est_monthly_savings,
       CASE WHEN upper(coalesce(owner_approval_status, '')) NOT IN ('APPROVED', 'NOT REQUIRED') THEN 'Approval Required' WHEN c IS NULL THEN 'No Metering Evidence'
            WHEN baseline_value IS NULL OR current_value IS NULL THEN 'Baseline Required' WHEN c <= baseline_value THEN 'Verified Savings'
            WHEN c < current_value THEN 'Improvement Needs Review' ELSE 'No Savings Yet' END AS verification_outcome
FROM a LEFT JOIN p ON upper(entity_name) = p.k
WHERE upper(status) <> 'IGNORED' AND category = 'Cost Control' AND coalesce(est_monthly_savings, 0) > 0
  AND upper(coalesce(verification_status, 'PENDING')) NOT IN ('VERIFIED', 'VERIFIED_SAVED', 'VERIFIED_NO_CHANGE')
""")
def _(spark, sf):
    return qu.verify_savings(_actions(spark, sf), tv.load(spark, sf, "warehouse_metering"), EVENTS_AS_OF)
