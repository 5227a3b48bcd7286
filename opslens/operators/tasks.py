"""Tasks, procedures, SLA and SLO operators (TSK-*, SLO-*).

Per-task baselines (mean duration, latest failure, latest run) are partial
aggregates joined back to the runs on the task key; the aggregated side has
one row per task, so a task with a third of all runs only skews the join's
probe side, which AQE splits. No per-task window holds all runs of a task.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.functions.exprs import pctl, rounded
from opslens.functions.timeutil import between_ts, boundaries, lookback, seconds_between, ts_lit

TASK_KEY = ["database_name", "schema_name", "task_name"]

# Failure categories, first match wins, tokens matched on the upper-cased error text.
FAILURE_CATEGORIES = [
    ("Privilege / RBAC", ["INSUFFICIENT PRIVILEGE", "NOT AUTHORIZED", "ACCESS DENIED", "PERMISSION", "PRIVILEGE"]),
    ("Object Dependency / Drift", ["INVALID IDENTIFIER", "DOES NOT EXIST", "NOT EXIST", "OBJECT", "UNKNOWN TABLE",
                                   "UNKNOWN VIEW"]),
    ("Data Quality / Type Conversion", ["NUMERIC VALUE", "DATE", "TIMESTAMP", "BOOLEAN", "CAST", "CONVERT", "TRUNCATED",
                                        "INVALID VALUE"]),
    ("SQL / Procedure Code", ["SQL COMPILATION", "SYNTAX", "UNEXPECTED", "PARSE"]),
    ("Warehouse / Runtime Capacity", ["WAREHOUSE", "STATEMENT_TIMEOUT", "TIMEOUT", "MEMORY", "SPILL", "RESOURCE"]),
    ("Concurrency / Locking", ["LOCK", "TRANSACTION", "DEADLOCK", "BLOCKED"]),
]
UNCLASSIFIED = "Unclassified Failure"


def runs(tasks: DataFrame, as_of: datetime, days: int) -> DataFrame:
    """Task runs in the window with ``task_name`` and boundary-counted seconds."""
    return (tasks.filter(lookback("scheduled_time", as_of, days))
            .withColumnRenamed("name", "task_name")
            .withColumn("duration_sec", boundaries("SECOND", "scheduled_time", "completed_time")))


def sla_compliance(tasks: DataFrame, as_of: datetime, days: int = 7, multiplier: float = 1.5,
                   exact: bool = True) -> DataFrame:
    """TSK-1: SLA = ``multiplier`` x the task's own mean duration; compliance
    share and status bands, tasks with at least 3 runs."""
    days, m = max(1, int(days or 7)), max(1.0, float(multiplier or 1.5))
    r = runs(tasks, as_of, days).filter(F.col("state").isin("SUCCEEDED", "FAILED", "CANCELLED"))
    b = r.groupBy(*TASK_KEY).agg(F.avg("duration_sec").alias("_avg"),
                                 pctl("duration_sec", 0.95, exact).alias("_p95"),
                                 F.count(F.lit(1)).alias("total_runs"),
                                 F.count_if(F.col("state") == "SUCCEEDED").alias("success_count"),
                                 F.count_if(F.col("state") == "FAILED").alias("failure_count"))
    j = r.select(*TASK_KEY, "state", "duration_sec").join(b.filter(F.col("total_runs") >= 3), TASK_KEY)
    thr = F.col("_avg") * m
    g = j.groupBy(*TASK_KEY, "total_runs", "success_count", "failure_count", "_avg", "_p95").agg(
        F.count_if((F.col("duration_sec") <= thr) & (F.col("state") == "SUCCEEDED")).alias("within_sla_count"),
        F.count_if((F.col("duration_sec") > thr) | (F.col("state") != "SUCCEEDED")).alias("sla_miss_count"))
    pct = F.col("within_sla_count") * 100.0 / F.nullif(F.col("total_runs"), F.lit(0))
    return g.select(*TASK_KEY, "total_runs", "success_count", "failure_count",
                    rounded("_avg", 1).alias("avg_duration_sec"), rounded("_p95", 1).alias("p95_duration_sec"),
                    rounded(F.col("_avg") * m, 1).alias("sla_threshold_sec"), "within_sla_count", "sla_miss_count",
                    rounded(pct, 1).alias("sla_compliance_pct"), sla_status(pct).alias("sla_status"))


def sla_status(pct: Column) -> Column:
    """TSK-3: SLA status bands."""
    return (F.when(pct.isNull(), "No Data").when(pct >= 99, "Excellent").when(pct >= 95, "Good")
            .when(pct >= 90, "Acceptable").when(pct >= 80, "At Risk").otherwise("Critical"))


def overall_sla(tasks: DataFrame, as_of: datetime, days: int = 7, multiplier: float = 1.5) -> DataFrame:
    """TSK-2 + TSK-3: one row: runs, within, missed, overall %, tracked tasks,
    tasks with misses, status label."""
    days, m = max(1, int(days or 7)), max(1.0, float(multiplier or 1.5))
    r = runs(tasks, as_of, days).filter(F.col("state").isin("SUCCEEDED", "FAILED", "CANCELLED"))
    b = (r.groupBy(*TASK_KEY).agg(F.avg("duration_sec").alias("_avg"), F.count(F.lit(1)).alias("_n"))
         .filter(F.col("_n") >= 3))
    c = r.join(b, TASK_KEY).select(
        "task_name", F.when((F.col("state") == "SUCCEEDED") & (F.col("duration_sec") <= F.col("_avg") * m), 1)
        .otherwise(0).alias("met"))
    one = c.agg(F.count(F.lit(1)).alias("total_runs"), F.sum("met").cast("bigint").alias("within_sla"),
                F.countDistinct("task_name").alias("tracked_tasks"),
                F.countDistinct(F.when(F.col("met") == 0, F.col("task_name"))).alias("tasks_with_misses"))
    pct = rounded(F.col("within_sla") * 100.0 / F.nullif(F.col("total_runs"), F.lit(0)), 1)
    return one.select("total_runs", "within_sla", (F.col("total_runs") - F.col("within_sla")).alias("missed_sla"),
                      pct.alias("overall_sla_pct"), "tracked_tasks", "tasks_with_misses",
                      sla_status(pct).alias("status"))


def failure_summary(tasks: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """TSK-4: per task: runs, failures, last failure, latest error text."""
    r = runs(tasks, as_of, days)
    failed = F.col("state") == "FAILED"
    g = r.groupBy(*TASK_KEY).agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(failed).alias("failures"),
        F.max(F.when(failed, F.col("scheduled_time"))).alias("last_failure"),
        F.max(F.when(failed, F.struct("scheduled_time", "error_message"))).alias("_l"))
    return (g.filter(F.col("failures") > 0)
            .select(*TASK_KEY, "runs", "failures", "last_failure", F.col("_l.error_message").alias("last_error"),
                    rounded(F.col("failures") * 100.0 / F.col("runs"), 1).alias("failure_pct")))


def health_counters(tasks: DataFrame, as_of: datetime, days: int = 1) -> DataFrame:
    """TSK-4: one row of task health counters."""
    r = runs(tasks, as_of, days)
    return r.agg(F.count(F.lit(1)).alias("total_runs"),
                 F.count_if(F.col("state") == "SUCCEEDED").alias("succeeded"),
                 F.count_if(F.col("state") == "FAILED").alias("failed"),
                 F.count_if(F.col("state") == "CANCELLED").alias("cancelled"),
                 F.countDistinct(*TASK_KEY).alias("tasks_run"),
                 F.countDistinct(F.when(F.col("state") == "FAILED", F.concat_ws(".", *TASK_KEY))).alias("failing_tasks"))


def failure_category(text: Column) -> Column:
    """SCA-24: failure category from error text, first match wins."""
    u = F.upper(F.coalesce(text, F.lit("")))
    out = None
    for label, tokens in FAILURE_CATEGORIES:
        cond = None
        for t in tokens:
            c = u.contains(t)
            cond = c if cond is None else (cond | c)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(UNCLASSIFIED)


SIGNATURE_SHOWN = 180


# Patterns that an error signature masks.
BLANKS, LONG_ID = r"\s+", r"(?i)\b[0-9a-f]{8,}[-0-9a-f]*\b"


def error_signature(text: Column) -> Column:
    """SCA-6: collapse whitespace, mask hex ids. The whole text: patterns are
    grouped by it, and cut to ``SIGNATURE_SHOWN`` characters only where shown."""
    t = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), BLANKS, " ")
    t = F.regexp_replace(t, LONG_ID, "<id>")
    return F.when(t == "", "No error text").otherwise(t)


# The incident priorities.
PRIORITIES = ["P1 - Graph Incident", "P2 - Production Risk", "P3 - Pipeline Defect", "P4 - Review"]
# Categories whose failures are incidents, and what blocks a retry in each category.
CRITICAL_CATEGORIES = ["Privilege / RBAC", "Object Dependency / Drift", "Warehouse / Runtime Capacity"]
BLOCKED = [("Privilege", "Blocked - grant or role fix first"), ("Object Dependency", "Blocked - object dependency fix first"),
           ("Warehouse", "Blocked - warehouse or capacity review first"), ("Data Quality", "Blocked - data correction first")]


def failure_console(tasks: DataFrame, as_of: datetime, days: int = 7, impact: DataFrame | None = None) -> DataFrame:
    """TSK-5: each failed run with category (error and, where the feed has it,
    statement text), signature, how often its pattern failed and on how many
    tasks, downstream count, priority P1 to P4, severity, recovery readiness and
    the task's recovery state against the SLA.

    ``impact`` is :func:`opslens.operators.graph.graph_impact` (by task label);
    without it no task has dependents. Pattern counts are a grouped aggregate
    joined back, not a window."""
    text = F.concat_ws("\n", *[c for c in ("error_message", "query_text") if c in tasks.columns])
    f = (runs(tasks, as_of, days).filter(F.col("state") == "FAILED")
         .select(*TASK_KEY, "query_id", "scheduled_time", "error_code", "error_message", "duration_sec",
                 failure_category(text).alias("failure_category"),
                 error_signature(F.col("error_message")).alias("error_signature")))
    pat = f.groupBy("failure_category", "error_signature").agg(
        F.count(F.lit(1)).alias("pattern_failure_count"),
        F.countDistinct("task_name").alias("pattern_task_count"))
    j = (f.join(pat, ["failure_category", "error_signature"])
         .withColumn("error_signature", F.substring("error_signature", 1, SIGNATURE_SHOWN)))
    if impact is None:
        j = j.withColumn("downstream_task_count", F.lit(0).cast("bigint"))
    else:
        per_task = impact.groupBy(F.col("label").alias("task_name")).agg(
            F.max("downstream_task_count").cast("bigint").alias("downstream_task_count"))
        j = j.join(per_task, "task_name", "left").withColumn("downstream_task_count", F.coalesce("downstream_task_count", F.lit(0)))
    state = recovery_sla(tasks, as_of, days).select(*TASK_KEY, "recovery_state")
    j = j.join(state, TASK_KEY, "left").withColumn("recovery_state", F.coalesce("recovery_state", F.lit("No recent recovery signal")))
    cat, critical = F.col("failure_category"), F.col("failure_category").isin(*CRITICAL_CATEGORIES)
    down, fails, many = F.col("downstream_task_count"), F.col("pattern_failure_count"), F.col("pattern_task_count")
    prio = (F.when(critical & ((down >= 3) | (many >= 2) | (fails >= 3)), PRIORITIES[0])
            .when(critical | (down >= 1) | (fails >= 3), PRIORITIES[1])
            .when(cat.contains("Data Quality") | (F.col("duration_sec") >= 300), PRIORITIES[2])
            .otherwise(PRIORITIES[3]))
    ready = F.when(F.col("task_name").isNull() | (F.trim("task_name") == ""), "Blocked - task FQN missing")
    for part, label in BLOCKED:
        ready = ready.when(cat.contains(part), label)
    return (j.withColumn("incident_priority", prio)
            .withColumn("severity", F.when(prio.startswith("P1"), "Critical").when(prio.startswith("P2"), "High")
                        .when(prio.startswith("P3"), "Medium").otherwise("Low"))
            .withColumn("recovery_readiness", ready.otherwise("Ready after DBA owner approval")))


def failure_console_summary(console: DataFrame) -> DataFrame:
    """TSK-5 counters: failures, categories, tasks, critical (P1 and P2), P1
    incidents and blocked recoveries."""
    prio = F.col("incident_priority")
    return console.agg(F.count(F.lit(1)).alias("failures"), F.countDistinct("failure_category").alias("categories"),
                       F.countDistinct("task_name").alias("tasks"),
                       F.count_if(prio.startswith("P1") | prio.startswith("P2")).alias("critical"),
                       F.count_if(prio.startswith("P1")).alias("p1_incidents"),
                       F.count_if(F.col("recovery_readiness").startswith("Blocked")).alias("blocked_recoveries"))


def failure_patterns(console: DataFrame) -> DataFrame:
    """TSK-5 patterns: per category and signature, failures, tasks, first
    priority and readiness, largest downstream count, first and last seen."""
    return console.groupBy("failure_category", "error_signature").agg(
        F.count(F.lit(1)).alias("failure_count"), F.countDistinct("task_name").alias("task_count"),
        F.min("incident_priority").alias("incident_priority"), F.min("recovery_readiness").alias("recovery_readiness"),
        F.max("downstream_task_count").alias("downstream_task_count"),
        F.min("scheduled_time").alias("first_seen"), F.max("scheduled_time").alias("last_seen"))


def recovery_sla(tasks: DataFrame, as_of: datetime, days: int = 30, target_hours: float = 4.0) -> DataFrame:
    """TSK-6 / JOI-19: per task, the latest failure, the first success after
    it (forward as-of by two aggregates), recovery hours and state."""
    r = runs(tasks, as_of, days).filter(F.col("scheduled_time") < ts_lit(as_of))
    last_fail = (r.filter(F.col("state") == "FAILED").groupBy(*TASK_KEY)
                 .agg(F.max("scheduled_time").alias("failure_at")))
    rec = (r.filter(F.col("state") == "SUCCEEDED").select(*TASK_KEY, "scheduled_time")
           .join(last_fail, TASK_KEY)
           .filter(F.col("scheduled_time") > F.col("failure_at"))
           .groupBy(*TASK_KEY).agg(F.min("scheduled_time").alias("recovery_at")))
    j = last_fail.join(rec, TASK_KEY, "left")
    hours = F.when(F.col("recovery_at").isNotNull(), seconds_between("failure_at", "recovery_at") / 3600.0) \
        .otherwise(seconds_between(F.col("failure_at"), ts_lit(as_of)) / 3600.0)
    state = (F.when(F.col("recovery_at").isNull(), "Open Failure")
             .when(hours <= target_hours, "Recovered Within SLA").otherwise("Recovered Late"))
    return j.select(*TASK_KEY, "failure_at", "recovery_at", rounded(F.greatest(hours, F.lit(0.0)), 2).alias("recovery_hours"),
                    state.alias("recovery_state"))


PROC_RE = r"(?i)CALL\s+([^(]+)"


def procedure_calls(queries: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """TSK-9: procedure name from CALL statements; calls, last call, mean seconds."""
    q = queries.filter(lookback("start_time", as_of, days) & (F.col("query_type") == "CALL"))
    name = F.trim(F.regexp_extract("query_text", PROC_RE, 1))
    return (q.groupBy(name.alias("procedure_name"))
            .agg(F.count(F.lit(1)).alias("calls"), F.max("start_time").alias("last_call"),
                 rounded(F.avg(F.col("total_elapsed_time") / 1000.0), 2).alias("avg_elapsed_sec"),
                 F.count_if(F.col("execution_status") != "SUCCESS").alias("failed_calls")))


def status_family(state: Column) -> Column:
    """SCA-5: status families of external scheduler / task states."""
    return (F.when(state.rlike("(?i)^(succeeded|success|done|complete[d]?)$"), "Success")
            .when(state.rlike("(?i)(fail|error|abort)"), "Failure")
            .when(state.rlike("(?i)(cancel|skip)"), "Cancelled")
            .when(state.rlike("(?i)(run|execut|start|queue|schedul)"), "Active").otherwise("Other"))


def status_counts(tasks: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """TSK-14: runs per status family."""
    r = runs(tasks, as_of, days)
    return r.groupBy(status_family(F.col("state")).alias("status_family")).agg(
        F.count(F.lit(1)).alias("runs"), F.countDistinct(*TASK_KEY).alias("tasks"))


# ------------------------------------------------------------------ SLO

# Default objectives (id, target, higher_is_better)
DEFAULT_SLOS = [("task_success_rate", 99.0, True), ("query_p95_latency", 10.0, False),
                ("daily_cost_limit", 500.0, False), ("alert_resolution_24h", 90.0, True)]


def service_indicators(tasks: DataFrame, queries: DataFrame, metering: DataFrame, alerts: DataFrame,
                       task_as_of: datetime, query_as_of: datetime, alert_as_of: datetime,
                       price: float = 3.68, exact: bool = True) -> DataFrame:
    """SLO-1: the four indicators as rows (slo_id, sli_value)."""
    t = (tasks.filter(lookback("scheduled_time", task_as_of, 7) & F.col("state").isin("SUCCEEDED", "FAILED"))
         .agg((F.count_if(F.col("state") == "SUCCEEDED") * 100.0 / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("v")))
    q = (queries.filter(lookback("start_time", query_as_of, 7) & (F.col("execution_status") == "SUCCESS")
                        & F.col("warehouse_name").isNotNull())
         .agg(rounded(pctl(F.col("total_elapsed_time") / 1000.0, 0.95, exact), 2).alias("v")))
    c = (metering.filter(lookback("start_time", query_as_of, 7))
         .groupBy(F.to_date("start_time")).agg((F.sum("credits_used") * price).alias("d"))
         .agg(rounded(F.avg("d"), 2).alias("v")))
    a = (alerts.filter(lookback("created_at", alert_as_of, 30))
         .agg((F.count_if(boundaries("HOUR", F.col("created_at"), F.coalesce(F.col("resolved_at"), ts_lit(alert_as_of))) <= 24)
               * 100.0 / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("v")))
    parts = [t.select(F.lit("task_success_rate").alias("slo_id"), "v"),
             q.select(F.lit("query_p95_latency").alias("slo_id"), "v"),
             c.select(F.lit("daily_cost_limit").alias("slo_id"), "v"),
             a.select(F.lit("alert_resolution_24h").alias("slo_id"), "v")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumnRenamed("v", "sli_value")


def error_budget(indicators: DataFrame, slos=DEFAULT_SLOS) -> DataFrame:
    """SLO-2: remaining budget, burn rate and status per objective. As in the
    reference, a burn above 1 means the remaining budget is <= 0, so
    'breached' is tested first and 'warning'/'critical' cannot occur."""
    spark = indicators.sparkSession
    t = spark.createDataFrame(list(slos), "slo_id string, target double, higher_is_better boolean")
    j = indicators.join(F.broadcast(t), "slo_id")
    s = F.col("sli_value")
    allowed = F.when(F.col("higher_is_better"), 100.0 - F.col("target")).otherwise(F.col("target"))
    actual = F.when(F.col("higher_is_better"), 100.0 - s).otherwise(s)
    used = actual / allowed * 100
    remaining = 100.0 - used
    burn = used / 100.0
    status = (F.when(allowed <= 0, "breached").when(remaining <= 0, "breached").when(burn > 2.0, "critical")
              .when(burn > 1.0, "warning").otherwise("healthy"))
    return j.select("slo_id", "target", rounded(s, 2).alias("sli_value"),
                    F.when(allowed <= 0, 0.0).otherwise(rounded(remaining, 1)).alias("budget_remaining_pct"),
                    F.when(allowed <= 0, 99.0).otherwise(rounded(burn, 2)).alias("burn_rate"),
                    F.when(s.isNull(), "unmeasured").otherwise(status).alias("status"))


def alert_resolution_metrics(alerts: DataFrame, as_of: datetime) -> DataFrame:
    """SLO-3: open count, oldest and mean open age (hours), share of resolved
    alerts fixed within 24 h, and mean time to resolution."""
    st = F.upper("status")
    is_open = st.isin("NEW", "OPEN", "ESCALATED")
    resolved = st.isin("RESOLVED", "FIXED", "CLOSED") & F.col("resolved_at").isNotNull()
    age = seconds_between("created_at", ts_lit(as_of)) / 3600.0
    dur = seconds_between("created_at", "resolved_at") / 3600.0
    a = alerts.filter(F.col("created_at") < ts_lit(as_of))
    return a.agg(F.count_if(is_open).alias("total_open"),
                 F.coalesce(rounded(F.max(F.when(is_open, age)), 1), F.lit(0.0)).alias("oldest_hours"),
                 F.coalesce(rounded(F.avg(F.when(is_open, age)), 1), F.lit(0.0)).alias("avg_hours"),
                 F.coalesce(rounded(F.count_if(resolved & (dur <= 24)) * 100.0 / F.nullif(F.count_if(resolved), F.lit(0)), 1),
                            F.lit(0.0)).alias("pct_resolved_24h"),
                 rounded(F.avg(F.when(resolved & (dur > 0), dur)), 1).alias("mttr_hours"))

