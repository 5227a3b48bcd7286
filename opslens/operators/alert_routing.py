"""Alert triage through the rule table and the owner directory (ALR-2, ALR-4).

Rules meet alerts on the alert type. The directory's patterns meet the distinct
(type, entity) pairs only, against the broadcast directory, and the best row of
each pair goes back to the alerts in one join: no alert is multiplied by rules.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.functions.timeutil import boundaries, lookback, ts_lit
from opslens.operators.chargeback import MAX_RULES

# Hours to act by severity, closed states, and the ranks of a triage priority.
SLA_HOURS = {"CRITICAL": 4, "HIGH": 8, "LOW": 72}
OTHER_HOURS = 24
CLOSED = ["FIXED", "IGNORED", "RESOLVED"]
SEVERITY_RANK = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3}
STATE_RANK = {"Overdue": 0, "Due Soon": 1, "Within SLA": 2, "Closed": 9}
STATUS_RANK = {"NEW": 0, "EMAIL_READY": 0, "EMAIL_QUEUED": 0, "OPEN": 0, "ACTIVE": 0, "PENDING": 0, "ACKNOWLEDGED": 1,
               "IN_PROGRESS": 1, "FIXED": 3, "RESOLVED": 3, "IGNORED": 4}
# Defaults where neither rule nor directory says anything.
DEFAULT_ROUTE = "Alert Center"
DEFAULT_RUNBOOK = "Review the Alert Center issue and route it through the DBA action queue."
DIRECTORY = ("owner_key string, entity_type string, entity_pattern string, owner_name string, owner_email string, "
             "approval_group string, escalation_target string, match_priority int")
RULES = "alert_type string, owner string, route string, runbook string, sla_hours int, is_active boolean"


def _rank(c: Column, ranks: dict, other: int) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for k, v in ranks.items():
        out = out.when(c == k, v)
    return out.otherwise(other)


def directory_matches(pairs: DataFrame, directory: DataFrame) -> DataFrame:
    """The best directory row (priority, then key) of each distinct
    (alert_type, entity)."""
    if directory.limit(MAX_RULES + 1).count() > MAX_RULES:
        raise ValueError(f"an owner directory of more than {MAX_RULES} rows can't be broadcast")
    kind, entity, rule = F.upper(F.coalesce("alert_type", F.lit(""))), F.upper(F.coalesce("entity", F.lit(""))), F.col("entity_type")
    fits = (rule.isin("GLOBAL", "ALERT") | (rule == kind) | ((rule == "COST_CONTROL") & kind.contains("COST"))
            | ((rule == "TASK") & kind.contains("TASK")) | ((rule == "PROCEDURE") & kind.contains("PROCEDURE"))
            | ((rule == "WAREHOUSE") & kind.contains("WAREHOUSE")) | ((rule == "SECURITY") & kind.rlike("GRANT|REVOKE|ROLE|SECURITY")))
    like = F.replace(F.upper("entity_pattern"), F.lit("*"), F.lit("%"))
    named = F.like(entity, like) | F.like(kind, like) | F.col("entity_pattern").isin("*", "%")
    found = pairs.select("alert_type", "entity").distinct().join(F.broadcast(directory), fits & named)
    rest = [c for c in directory.columns if c not in ("match_priority", "owner_key")]
    return found.groupBy("alert_type", "entity").agg(F.min(F.struct(
        (-F.coalesce("match_priority", F.lit(0))).alias("_p"), "owner_key", *rest)).alias("od"))


def routed_triage(alerts: DataFrame, rules: DataFrame, directory: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """ALR-2: owner, approval group, escalation target, route, SLA target (of the
    rule, else by severity), age in hours, SLA state and triage priority."""
    a = alerts.filter(lookback("created_at", as_of, days))
    # one rule for each type, however many are active: the one with the shortest SLA, then by its columns
    fields = ["owner", "route", "runbook"]
    active = (rules.filter(F.coalesce("is_active", F.lit(True)) & F.col("alert_type").isNotNull()).groupBy(F.upper("alert_type").alias("_k"))
              .agg(F.min(F.struct(F.coalesce("sla_hours", F.lit(2 ** 31 - 1)).alias("_o"), *fields, "sla_hours")).alias("r"))
              .select("_k", F.col("r.owner").alias("_rule_owner"), "r.route", "r.runbook", F.col("r.sla_hours").alias("_sla")))
    od = directory_matches(a, directory).withColumnsRenamed({"alert_type": "_t", "entity": "_e"})
    j = (a.join(active, F.upper(F.coalesce("alert_type", F.lit(""))) == F.col("_k"), "left")
         .join(od, a["alert_type"].eqNullSafe(od["_t"]) & a["entity"].eqNullSafe(od["_e"]), "left"))
    severity = F.upper(F.coalesce("severity", F.lit("Medium")))
    status = F.upper(F.replace(F.coalesce("status", F.lit("New")), F.lit(" "), F.lit("_")))
    hours = F.coalesce(F.col("_sla"), _rank(severity, SLA_HOURS, OTHER_HOURS))
    age = F.greatest(F.lit(0), F.coalesce(boundaries("HOUR", "created_at", ts_lit(as_of)), F.lit(0)))
    state = (F.when(status.isin(*CLOSED), "Closed").when(age > hours, "Overdue").when(age >= hours * 0.75, "Due Soon").otherwise("Within SLA"))
    owner = F.coalesce("od.owner_name", "_rule_owner", "owner", F.lit("DBA"))
    target = F.coalesce("od.escalation_target", "od.approval_group", "_rule_owner", "owner", F.lit("DBA Lead"))
    return j.select(
        "alert_id", "created_at", "entity", "alert_type", "severity", "status", owner.alias("routed_owner"),
        F.col("od.owner_email").alias("owner_email"), F.coalesce("od.approval_group", "_rule_owner", "owner", F.lit("DBA Lead")).alias("approval_group"),
        target.alias("escalation_target"), F.coalesce("route", F.lit(DEFAULT_ROUTE)).alias("alert_route"),
        F.coalesce("runbook", F.lit(DEFAULT_RUNBOOK)).alias("alert_runbook"),
        F.when(F.col("od").isNotNull(), F.concat(F.lit("OWNER_DIRECTORY:"), F.col("od.owner_key"))).otherwise("ALERT_RULE").alias("owner_source"),
        hours.alias("sla_target_hours"), age.cast("bigint").alias("alert_age_hours"), state.alias("sla_state"),
        (_rank(severity, SEVERITY_RANK, 4) * 100 + _rank(state, STATE_RANK, 5) * 10 + _rank(status, STATUS_RANK, 2)).alias("triage_priority"))
