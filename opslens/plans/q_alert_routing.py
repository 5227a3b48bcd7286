"""Registered alert triage through rules and directory."""

from __future__ import annotations

from datetime import timedelta

from opslens.operators import alert_routing as ar
from opslens.plans.fixtures import values_cte
from opslens.plans.registry import register
from opslens.sources import testviews as tv
from opslens.sources.testviews import ORDERS_AS_OF

_RULES = [("COST_SPIKE", "FinOps", "Cost & Contract", "Explain the driver", 6, True), ("TASK_FAILURE", "Pipelines", "Task Center", None, None, True),
          ("LOGIN_FAILURE", None, "Security", "Check the source", 2, True), ("cost_spike", "Second", "Other", "Not taken", 9, True), ("STALE_TABLE", "Nobody", "Old", None, 1, False)]
_DIRECTORY = [("COST", "COST_CONTROL", "*", "Cost desk", "cost@example.com", "Cost board", "Cost lead", 80),
              ("TASKS", "TASK", "*", "Pipeline desk", "pipe@example.com", "Pipeline board", None, 70),
              ("WH3", "ALERT", "WH_3*", "Warehouse three", "wh3@example.com", None, "WH3 lead", 90),
              ("LOGIN", "ALERT", "LOGIN*", "Security desk", "sec@example.com", "Security board", "Security lead", 60),
              ("LOGIN2", "ALERT", "LOGIN_FAIL*", "Second desk", "sec2@example.com", None, None, 60)]
_BOTH = values_cte("rules", ["alert_type", "owner", "route", "runbook", "sla_hours", "is_active"], _RULES) + ", " + values_cte(
    "dir", ["owner_key", "entity_type", "entity_pattern", "owner_name", "owner_email", "approval_group", "escalation_target", "match_priority"], _DIRECTORY)
_LO = ORDERS_AS_OF - timedelta(days=30)


@register("alert_triage_routed", "alerts", op="ALR-2", sql="WITH " + _BOTH + f""",
a AS (SELECT * FROM alerts WHERE created_at >= TIMESTAMP '{_LO}' AND created_at < TIMESTAMP '{ORDERS_AS_OF}'),
m AS (SELECT a.alert_id, d.*, row_number() OVER (PARTITION BY a.alert_id ORDER BY coalesce(d.match_priority, 0) DESC, d.owner_key) AS rn
      FROM a JOIN dir d ON (d.entity_type IN ('GLOBAL', 'ALERT') OR d.entity_type = upper(a.alert_type)
           OR (d.entity_type = 'COST_CONTROL' AND upper(a.alert_type) LIKE '%COST%') OR (d.entity_type = 'TASK' AND upper(a.alert_type) LIKE '%TASK%'))
       AND (upper(a.entity) LIKE replace(upper(d.entity_pattern), '*', '%') OR upper(a.alert_type) LIKE replace(upper(d.entity_pattern), '*', '%')
            OR d.entity_pattern IN ('*', '%'))),
b AS (SELECT a.*, r.owner AS rule_owner, r.route, r.runbook, r.sla_hours, d.owner_key, d.owner_name, d.owner_email, d.approval_group AS od_group, d.escalation_target AS od_target,
             upper(replace(coalesce(a.status, 'New'), ' ', '_')) AS st, upper(coalesce(a.severity, 'Medium')) AS sev,
             CAST(coalesce(r.sla_hours, CASE upper(coalesce(a.severity, 'Medium')) WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 8 WHEN 'LOW' THEN 72 ELSE 24 END) AS INTEGER) AS hours,
             CAST(greatest(0, date_diff('hour', a.created_at, TIMESTAMP '{ORDERS_AS_OF}')) AS BIGINT) AS age
      FROM a LEFT JOIN (SELECT * FROM rules WHERE coalesce(is_active, TRUE) QUALIFY row_number() OVER (PARTITION BY upper(alert_type) ORDER BY sla_hours NULLS LAST, owner NULLS FIRST, route, runbook) = 1) r
        ON upper(a.alert_type) = upper(r.alert_type)
      LEFT JOIN (SELECT * FROM m WHERE rn = 1) d ON a.alert_id = d.alert_id),
s AS (SELECT *, CASE WHEN st IN ('FIXED', 'IGNORED', 'RESOLVED') THEN 'Closed' WHEN age > hours THEN 'Overdue' WHEN age >= hours * 0.75 THEN 'Due Soon'
                     ELSE 'Within SLA' END AS sla_state FROM b)
SELECT alert_id, created_at, entity, alert_type, severity, status, coalesce(owner_name, rule_owner, owner, 'DBA') AS routed_owner, owner_email,
       coalesce(od_group, rule_owner, owner, 'DBA Lead') AS approval_group, coalesce(od_target, od_group, rule_owner, owner, 'DBA Lead') AS escalation_target,
       coalesce(route, 'Alert Center') AS alert_route,
       coalesce(runbook, 'Review the Alert Center issue and route it through the DBA action queue.') AS alert_runbook,
       CASE WHEN owner_key IS NOT NULL THEN 'OWNER_DIRECTORY:' || owner_key ELSE 'ALERT_RULE' END AS owner_source,
       hours AS sla_target_hours, age AS alert_age_hours, sla_state,
       CAST(CASE sev WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END * 100
            + CASE sla_state WHEN 'Overdue' THEN 0 WHEN 'Due Soon' THEN 1 WHEN 'Within SLA' THEN 2 WHEN 'Closed' THEN 9 ELSE 5 END * 10
            + CASE WHEN st IN ('NEW', 'EMAIL_READY', 'EMAIL_QUEUED', 'OPEN', 'ACTIVE', 'PENDING') THEN 0 WHEN st IN ('ACKNOWLEDGED', 'IN_PROGRESS') THEN 1
                   WHEN st IN ('FIXED', 'RESOLVED') THEN 3 WHEN st = 'IGNORED' THEN 4 ELSE 2 END AS INTEGER) AS triage_priority
FROM s
""")
def _(spark, sf):
    return ar.routed_triage(tv.load(spark, sf, "alerts"), spark.createDataFrame(_RULES, ar.RULES), spark.createDataFrame(_DIRECTORY, ar.DIRECTORY), ORDERS_AS_OF)
