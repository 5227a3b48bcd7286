"""Alerts, action queue, recommendations and scores (ALR-*, ACT-*, REC-*, SCR-*)."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.functions.exprs import rounded, safe_div
from opslens.functions.timeutil import between_ts, lookback, midnight, seconds_between, ts_lit

# SLA hours per severity and the closed statuses.
SLA_HOURS = {"Critical": 4, "High": 8, "Medium": 24, "Low": 72}
CLOSED = ["FIXED", "IGNORED", "RESOLVED"]


def norm_severity(c: Column) -> Column:
    """ALR-1 / SCA-25: Critical, High, Low, else Medium."""
    u = F.upper(F.trim(F.coalesce(c, F.lit("Medium"))))
    return F.when(u == "CRITICAL", "Critical").when(u == "HIGH", "High").when(u == "LOW", "Low").otherwise("Medium")


def norm_status(c: Column) -> Column:
    """ALR-1: status labels; resolved counts as Fixed."""
    u = F.upper(F.regexp_replace(F.trim(F.coalesce(c, F.lit("New"))), "_", " "))
    return (F.when(u == "EMAIL READY", "Email Ready").when(u == "EMAIL QUEUED", "Email Queued")
            .when(u == "IN PROGRESS", "In Progress").when(u.isin("RESOLVED", "FIXED"), "Fixed")
            .when(u == "IGNORED", "Ignored").when(u == "", "New").otherwise(F.initcap(F.lower(u))))


def severity_rank(c: Column) -> Column:
    s = norm_severity(c)
    return F.when(s == "Critical", 0).when(s == "High", 1).when(s == "Medium", 2).otherwise(3)


def status_rank(c: Column) -> Column:
    u = F.upper(F.regexp_replace(F.trim(F.coalesce(c, F.lit("New"))), " ", "_"))
    return (F.when(u.isin("NEW", "EMAIL_READY", "EMAIL_QUEUED", "OPEN", "ACTIVE", "PENDING", "ESCALATED"), 0)
            .when(u.isin("ACKNOWLEDGED", "IN_PROGRESS"), 1).when(u.isin("FIXED", "RESOLVED"), 3)
            .when(u == "IGNORED", 4).otherwise(2))


def normalize_alerts(alerts: DataFrame) -> DataFrame:
    """ALR-1: defaults, normalised severity and status, subject line."""
    return alerts.select("alert_id", F.col("created_at").alias("alert_ts"), "entity", "alert_type",
                         norm_severity(F.col("severity")).alias("severity"), norm_status(F.col("status")).alias("status"),
                         F.coalesce("owner", F.lit("DBA")).alias("owner"), "resolved_at", "message",
                         F.concat_ws(" - ", norm_severity(F.col("severity")), F.col("alert_type"), F.col("entity")).alias("subject"))


def triage(alerts: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """ALR-2: age, SLA target by severity, SLA state, escalation target and a
    priority number (severity x100 + SLA state x10 + status)."""
    a = normalize_alerts(alerts.filter(lookback("created_at", as_of, days) & (F.col("created_at") < ts_lit(as_of))))
    age = rounded(F.greatest(F.lit(0.0), seconds_between("alert_ts", ts_lit(as_of)) / 3600.0), 1)
    sla = F.when(F.col("severity") == "Critical", 4).when(F.col("severity") == "High", 8) \
        .when(F.col("severity") == "Low", 72).otherwise(24)
    closed = F.upper(F.col("status")).isin(*CLOSED)
    a = a.withColumn("alert_age_hours", age).withColumn("sla_target_hours", sla)
    over = (F.col("alert_age_hours") > F.col("sla_target_hours")) & ~closed
    soon = (F.col("alert_age_hours") >= F.col("sla_target_hours") * 0.75) & ~over & ~closed
    state = F.when(closed, "Closed").when(over, "Overdue").when(soon, "Due Soon").otherwise("Within SLA")
    a = a.withColumn("sla_state", state)
    esc = F.when((F.col("sla_state") == "Overdue") & F.col("severity").isin("Critical", "High"), "DBA Lead") \
        .otherwise(F.col("owner"))
    srank = F.when(F.col("sla_state") == "Overdue", 0).when(F.col("sla_state") == "Due Soon", 1) \
        .when(F.col("sla_state") == "Within SLA", 2).otherwise(9)
    pri = severity_rank(F.col("severity")) * 100 + srank * 10 + status_rank(F.col("status"))
    return a.withColumn("escalation_target", esc).withColumn("triage_priority", pri.cast("int"))


def escalation_candidates(tri: DataFrame, limit: int = 10) -> DataFrame:
    """ALR-3: open alerts that are severe, near or past SLA, or unowned; top by priority."""
    open_ = tri.filter(~F.upper("status").isin(*CLOSED))
    owner_gap = F.upper(F.coalesce("owner", F.lit(""))).isin("", "DBA")
    c = open_.filter(F.col("severity").isin("Critical", "High") | F.col("sla_state").isin("Overdue", "Due Soon") | owner_gap)
    return c.orderBy("triage_priority", F.desc("alert_ts"), "alert_id").limit(limit)


def digest_counters(tri: DataFrame) -> DataFrame:
    """ALR-4: digest counters, one row."""
    open_ = ~F.upper("status").isin(*CLOSED)
    return tri.agg(F.count(F.lit(1)).alias("total"), F.count_if(open_).alias("open"),
                   F.count_if(open_ & F.col("severity").isin("Critical", "High")).alias("critical_high"),
                   F.count_if(open_ & (F.col("sla_state") == "Overdue")).alias("overdue"),
                   F.count_if(open_ & (F.col("sla_state") == "Due Soon")).alias("due_soon"),
                   F.count_if(open_ & (F.col("status") == "Email Ready")).alias("email_ready"),
                   F.count_if(open_ & (F.upper("owner") == "DBA")).alias("needs_owner"))


def digest_body(tri: DataFrame, top_ids: int = 25) -> DataFrame:
    """ALR-5: one digest row: a line per (severity, type) with counts, and the
    ids of the ``top_ids`` highest-priority open alerts. The id list is cut
    with a distributed top-k before it is collected, so its size is bounded."""
    open_ = tri.filter(~F.upper("status").isin(*CLOSED))
    lines = (open_.groupBy("severity", "alert_type").agg(F.count(F.lit(1)).alias("n"))
             .select(severity_rank(F.col("severity")).alias("_r"), "alert_type",
                     F.concat(F.col("severity"), F.lit(" "), F.col("alert_type"), F.lit(": "), F.col("n").cast("string")).alias("line")))
    body = lines.agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("_r", "alert_type", "line"))),
                                                   lambda s: s["line"])).alias("digest_body"))
    ids = (open_.orderBy("triage_priority", F.desc("alert_ts"), "alert_id").limit(top_ids)
           .agg(F.transform(F.array_sort(F.collect_list(F.struct("triage_priority", "alert_id"))), lambda s: s["alert_id"])
                .alias("alert_ids")))
    return body.crossJoin(ids)


def issue_list(tri: DataFrame, task_console: DataFrame, sec_exceptions: DataFrame) -> DataFrame:
    """ALR-6 / SET-2: alerts, task failures and security exceptions aligned
    to one schema (missing columns become NULL) and ranked by severity."""
    a = tri.select(F.lit("alert").alias("source"), F.col("alert_id").alias("issue_id"), "severity",
                   F.col("entity"), F.col("alert_type").alias("issue_type"), F.col("alert_ts").alias("seen_at"))
    t = task_console.select(F.lit("task_failure").alias("source"), F.col("query_id").alias("issue_id"),
                            "severity",
                            F.concat_ws(".", "database_name", "schema_name", "task_name").alias("entity"),
                            F.col("failure_category").alias("issue_type"), F.col("scheduled_time").alias("seen_at"))
    s = sec_exceptions.select(F.lit("security").alias("source"), F.col("severity"), F.col("entity"),
                              F.col("finding_type").alias("issue_type"), F.col("last_seen").alias("seen_at"))
    u = a.unionByName(t).unionByName(s, allowMissingColumns=True)
    return u.withColumn("severity_rank", severity_rank(F.col("severity")))


def alert_actions(tri: DataFrame) -> DataFrame:
    """ALR-7 / SCA-8: numbers pulled from the alert text (failures, duration,
    baseline) turned into queue actions with a recovery metric."""
    failed = F.expr("try_cast(regexp_extract(message, 'failed ([0-9]+) times', 1) AS INT)")
    dur = F.expr("try_cast(regexp_extract(message, 'duration ([0-9]+)s', 1) AS INT)")
    base = F.expr("try_cast(regexp_extract(message, 'baseline ([0-9]+)', 1) AS INT)")
    return tri.select("alert_id", "entity", "alert_type", "severity", "status", failed.alias("failed_count"),
                      dur.alias("duration_sec"), base.alias("baseline_value"),
                      F.when(dur.isNotNull() & (base > 0), rounded(dur / base, 2)).alias("slowdown_factor"),
                      F.when(F.col("alert_type") == "TASK_FAILURE", "Retry task after fix")
                      .when(F.col("alert_type") == "COST_SPIKE", "Verify savings").otherwise("Review").alias("next_action"))


def suppress_maintenance(alerts: DataFrame, windows: DataFrame, ts: str = "created_at") -> DataFrame:
    """ALR-8 / JOI-18: drop alerts raised inside an active maintenance window
    (global when ``entity`` is NULL, else for that entity).

    An equi join on the day buckets that each window covers, then the exact
    range: the same plan for any number of windows (the planner broadcasts the
    windows where it measures them to be small)."""
    w = windows.select(F.col("window_start").alias("_ws"), F.col("window_end").alias("_we"), F.col("entity").alias("_went"))
    cond = ((F.col(ts) >= F.col("_ws")) & (F.col(ts) < F.col("_we"))
            & (F.col("_went").isNull() | (F.col("_went") == F.col("entity"))))
    wb = w.withColumn("_day", F.explode(F.sequence(F.to_date("_ws"), F.to_date("_we"))))
    day = F.to_date(ts) == F.col("_day")
    return alerts.join(wb, day & cond, "left_anti")


def daily_brief(metering: DataFrame, tasks: DataFrame, alerts: DataFrame, metering_as_of: datetime,
                task_as_of: datetime) -> DataFrame:
    """ALR-9: yesterday's credits, change vs the day before, failed task
    runs, open alerts and a simple score, one row."""
    d1, d0 = midnight(metering_as_of) - timedelta(days=1), midnight(metering_as_of) - timedelta(days=2)
    c = (metering.filter(between_ts("start_time", d0, midnight(metering_as_of)))
         .agg(F.coalesce(F.sum(F.when(F.col("start_time") >= ts_lit(d1), F.col("credits_used"))), F.lit(0.0)).alias("_y"),
              F.coalesce(F.sum(F.when(F.col("start_time") < ts_lit(d1), F.col("credits_used"))), F.lit(0.0)).alias("_p")))
    t = (tasks.filter(between_ts("scheduled_time", task_as_of - timedelta(days=1), task_as_of))
         .agg(F.count_if(F.col("state") == "FAILED").alias("failed_tasks")))
    a = alerts.filter(F.col("created_at") < ts_lit(task_as_of)).agg(
        F.count_if(F.upper("status").isin("NEW", "OPEN", "ESCALATED")).alias("open_alerts"))
    j = c.crossJoin(t).crossJoin(a)
    pct = rounded(safe_div(F.col("_y") - F.col("_p"), "_p") * 100, 1)
    score = F.greatest(F.lit(0), 100 - F.least(F.lit(30), F.col("failed_tasks")) - F.least(F.lit(30), F.floor(F.col("open_alerts") / 100))
                       - F.when(pct > 20, 10).otherwise(0))
    return j.select(rounded("_y", 4).alias("credits_yesterday"), pct.alias("credit_change_pct"), "failed_tasks",
                    "open_alerts", score.cast("int").alias("brief_score"))


# ------------------------------------------------------------------ action queue

def action_id(category: Column, entity: Column, finding: Column) -> Column:
    """SCA-11: stable id of a finding."""
    return F.sha1(F.concat_ws("|", F.upper(F.trim(category)), F.upper(F.trim(entity)), F.upper(F.trim(finding))))


def upsert_findings(stored: DataFrame, new: DataFrame, now: datetime) -> DataFrame:
    """ACT-1 / UPS-3: merge newly detected findings into the queue in one
    distributed pass (full outer join on the stable id): repeats bump
    ``seen_count`` and ``last_seen_at``; empty new fields keep the old value;
    first sightings are inserted; stored rows not seen again are kept."""
    n = new.select("action_id", "category", "entity", "finding", "severity", "detail")
    s = stored.select(*[F.col(c).alias(f"o_{c}") for c in stored.columns])
    j = n.join(s, n.action_id == s.o_action_id, "full")
    keep = lambda c: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.col(f"o_{c}"))
    seen = F.col("action_id").isNotNull()
    return j.select(
        F.coalesce("action_id", "o_action_id").alias("action_id"), keep("category").alias("category"),
        keep("entity").alias("entity"), keep("finding").alias("finding"), keep("severity").alias("severity"),
        keep("detail").alias("detail"),
        F.coalesce("o_status", F.lit("Open")).alias("status"),
        F.coalesce("o_first_seen_at", ts_lit(now)).alias("first_seen_at"),
        F.when(seen, ts_lit(now)).otherwise(F.col("o_last_seen_at")).alias("last_seen_at"),
        (F.coalesce("o_seen_count", F.lit(0)) + F.when(seen, 1).otherwise(0)).cast("bigint").alias("seen_count"),
        F.col("o_fixed_at").alias("fixed_at"))


def findings_from_exceptions(exc: DataFrame) -> DataFrame:
    """Security exceptions as queue findings with their stable id."""
    return exc.select(action_id(F.lit("security"), F.col("entity"), F.col("finding")).alias("action_id"),
                      F.lit("security").alias("category"), "entity", "finding", "severity",
                      F.coalesce(F.col("value").cast("string"), F.lit("")).alias("detail"))


def enrich_queue(queue: DataFrame, as_of: datetime, due_days: int = 14) -> DataFrame:
    """ACT-2: due date, days left, due state, evidence gap, next action, priority."""
    due = F.date_add(F.to_date("first_seen_at"), due_days)
    left = F.datediff(due, F.lit(as_of.date()))
    open_ = F.col("status") != "Fixed"
    state = F.when(~open_, "Closed").when(left < 0, "Overdue").when(left <= 3, "Due Soon").otherwise("On Track")
    gap = F.when(F.trim(F.coalesce("detail", F.lit(""))) == "", "Missing evidence").otherwise("Evidence attached")
    nxt = (F.when(~open_, "Verify savings").when(F.col("severity") == "High", "Escalate to owner")
           .when(F.col("seen_count") > 1, "Confirm recurring finding").otherwise("Assign owner"))
    pri = (F.when(F.col("severity") == "High", 300).when(F.col("severity") == "Medium", 200).otherwise(100)
           + F.when(state == "Overdue", 50).when(state == "Due Soon", 25).otherwise(0) + F.least(F.col("seen_count"), F.lit(20)))
    return queue.select("*", due.alias("due_date"), left.alias("days_left"), state.alias("due_state"),
                        gap.alias("evidence_gap"), nxt.alias("next_action"), pri.cast("int").alias("priority"))


def closure_analytics(queue: DataFrame, by: str = "category") -> DataFrame:
    """ACT-3 / ACT-4: per check (category): open, fixed, closure rate, mean
    days to close, most frequent entity."""
    fixed = F.col("status") == "Fixed"
    days_to_close = F.datediff(F.to_date("fixed_at"), F.to_date("first_seen_at"))
    g = queue.groupBy(by).agg(F.count(F.lit(1)).alias("actions"), F.count_if(~fixed).alias("open"),
                              F.count_if(fixed).alias("fixed"), rounded(F.avg(F.when(fixed, days_to_close)), 1).alias("avg_days_to_close"),
                              F.max_by("entity", F.struct("seen_count", "entity")).alias("top_entity"))
    return g.withColumn("closure_rate_pct", rounded(F.col("fixed") * 100.0 / F.col("actions"), 1))


def savings_verification(metering: DataFrame, actions: DataFrame, as_of: datetime, baseline_days: int = 28) -> DataFrame:
    """ACT-5: per acted-on warehouse, the mean daily credits of the last 7
    complete days against the baseline before the action; outcome label.
    The warehouse key is matched case-insensitively (JOI-11)."""
    today = midnight(as_of)
    a = actions.select(F.upper("entity").alias("_k"), "action_id", "acted_at")
    m = (metering.filter(lookback("start_time", as_of, baseline_days + 7, end=today))
         .groupBy(F.upper("warehouse_name").alias("_k"), F.to_date("start_time").alias("d"))
         .agg(F.sum("credits_used").alias("c")))
    j = m.join(a, "_k")
    recent = F.col("d") >= F.lit((today - timedelta(days=7)).date())
    before = F.col("d") < F.to_date("acted_at")
    g = j.groupBy("action_id", "_k").agg(F.avg(F.when(recent, F.col("c"))).alias("_r"),
                                          F.avg(F.when(before & ~recent, F.col("c"))).alias("_b"))
    pct = safe_div(F.col("_b") - F.col("_r"), "_b") * 100
    out = (F.when(F.col("_r").isNull() | F.col("_b").isNull(), "Insufficient data").when(pct >= 10, "Savings verified")
           .when(pct > -10, "No change").otherwise("Cost increased"))
    return g.select("action_id", F.col("_k").alias("warehouse_name"), rounded("_r", 4).alias("recent_daily_credits"),
                    rounded("_b", 4).alias("baseline_daily_credits"), rounded(pct, 1).alias("savings_pct"), out.alias("outcome"))


# ------------------------------------------------------------------ recommendations

def spill_candidates(queries: DataFrame, as_of: datetime, days: int = 7, min_gb: float = 0.001, limit: int = 20) -> DataFrame:
    """REC-2: warehouses with remote spill, ranked."""
    g = (queries.filter(lookback("start_time", as_of, days) & F.col("warehouse_name").isNotNull())
         .groupBy("warehouse_name")
         .agg(F.count_if(F.col("bytes_spilled_to_remote_storage") > 0).alias("spill_queries"),
              rounded(F.sum("bytes_spilled_to_remote_storage") / 1024.0 ** 3, 3).alias("remote_spill_gb")))
    return g.filter(F.col("remote_spill_gb") >= min_gb).orderBy(F.desc("remote_spill_gb"), "warehouse_name").limit(limit)


def failing_task_candidates(tasks: DataFrame, as_of: datetime, days: int = 7, min_failures: int = 2, limit: int = 20) -> DataFrame:
    """REC-3: tasks with repeated failures, ranked."""
    g = (tasks.filter(lookback("scheduled_time", as_of, days))
         .groupBy("database_name", "schema_name", F.col("name").alias("task_name"))
         .agg(F.count_if(F.col("state") == "FAILED").alias("failures"), F.count(F.lit(1)).alias("runs")))
    return (g.filter(F.col("failures") >= min_failures)
            .orderBy(F.desc("failures"), "database_name", "schema_name", "task_name").limit(limit))


def query_error_candidates(queries: DataFrame, as_of: datetime, days: int = 7, min_errors: int = 5, limit: int = 20) -> DataFrame:
    """REC-4: users with repeated statement errors per error code, ranked."""
    g = (queries.filter(lookback("start_time", as_of, days) & (F.col("execution_status") != "SUCCESS"))
         .groupBy("user_name", "error_code").agg(F.count(F.lit(1)).alias("errors"), F.max("start_time").alias("last_error")))
    return g.filter(F.col("errors") >= min_errors).orderBy(F.desc("errors"), "user_name", "error_code").limit(limit)


def optimizer_candidates(warehouses: DataFrame, metering: DataFrame, queue: DataFrame, as_of: datetime,
                         days: int = 7) -> DataFrame:
    """REC-7: never-suspend or under-used warehouses (credits below 20 % of
    the hours they could use) that are not already queued (JOI-5 anti join
    against open queue items)."""
    m = (metering.filter(lookback("start_time", as_of, days)).groupBy("warehouse_name")
         .agg(F.sum("credits_used").alias("credits"), F.countDistinct(F.date_trunc("hour", "start_time")).alias("hours")))
    from opslens.operators.cost import size_rate
    j = warehouses.join(m, "warehouse_name", "left")
    cap = size_rate(F.col("warehouse_size")) * F.coalesce("hours", F.lit(0))
    util = safe_div(F.coalesce("credits", F.lit(0.0)) * 100, cap)
    reason = F.when(F.col("auto_suspend") == 0, "Never suspends").when(util < 20, "Under 20% used")
    open_q = queue.filter(F.col("status") != "Fixed").select(F.upper("entity").alias("_e")).distinct()
    c = j.select("warehouse_name", "warehouse_size", "auto_suspend", rounded(util, 1).alias("utilisation_pct"),
                 reason.alias("reason")).filter(F.col("reason").isNotNull())
    return c.join(open_q, F.upper(c.warehouse_name) == open_q._e, "left_anti")


def automation_lane(recs: DataFrame) -> DataFrame:
    """REC-6: automation lane and score from a recommendation's type and severity."""
    sev = F.col("severity")
    score = (F.when(sev == "High", 40).when(sev == "Medium", 25).otherwise(10)
             + F.when(F.col("type") == "suspend_timeout", 40).when(F.col("type") == "consolidation", 10).otherwise(20))
    lane = F.when(score >= 70, "Auto-apply with approval").when(score >= 40, "Guided fix").otherwise("Manual review")
    return recs.withColumn("automation_score", score).withColumn("automation_lane", lane)


# ------------------------------------------------------------------ scores

def platform_health(metering: DataFrame, tasks: DataFrame, queries: DataFrame, logins: DataFrame,
                    events_as_of: datetime, task_as_of: datetime) -> DataFrame:
    """SCR-4: four weighted components (cost stability, reliability,
    performance, security) into one score, grade and components."""
    t = (tasks.filter(lookback("scheduled_time", task_as_of, 7) & F.col("state").isin("SUCCEEDED", "FAILED"))
         .agg((F.count_if(F.col("state") == "SUCCEEDED") * 100.0 / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("rel")))
    q = (queries.filter(lookback("start_time", events_as_of, 7))
         .agg((F.count_if(F.col("total_elapsed_time") <= 60000) * 100.0 / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("perf")))
    d = (metering.filter(lookback("start_time", events_as_of, 14, end=midnight(events_as_of)))
         .groupBy(F.to_date("start_time")).agg(F.sum("credits_used").alias("c"))
         .agg(F.greatest(F.lit(0.0), 100 - safe_div(F.stddev_samp("c") * 100, F.avg("c"))).alias("cost")))
    s = (logins.filter(lookback("event_timestamp", events_as_of, 7))
         .agg((100 - F.count_if(F.col("is_success") == "NO") * 100.0 / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("sec")))
    j = t.crossJoin(q).crossJoin(d).crossJoin(s)
    score = (F.coalesce("cost", F.lit(0.0)) * 0.25 + F.coalesce("rel", F.lit(0.0)) * 0.30
             + F.coalesce("perf", F.lit(0.0)) * 0.25 + F.coalesce("sec", F.lit(0.0)) * 0.20)
    grade = F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")
    return j.select(rounded("cost", 1).alias("cost_score"), rounded("rel", 1).alias("reliability_score"),
                    rounded("perf", 1).alias("performance_score"), rounded("sec", 1).alias("security_score"),
                    rounded(score, 1).alias("health_score"), grade.alias("grade"))


def bad_ratio_score(bad: Column, total: Column, weight: float = 100.0) -> Column:
    """SCR-1: ``weight x (1 - bad/total)``, 100 when nothing was measured."""
    return F.when(total > 0, rounded(F.lit(weight) * (1 - bad / total), 1)).otherwise(F.lit(weight))
