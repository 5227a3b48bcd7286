"""Scores (SCR-1..3): bad-event ratios, trends, weighted means, and the
executive and service scorecards built from them.

Each scorecard reduces every source to one row of counters first; the scores
are expressions over that row.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.functions.exprs import pctl, rounded
from opslens.functions.timeutil import between_ts, date_lit, lookback, ts_lit


def _num(c: str | Column) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("double"), F.lit(0.0))


def clamp_score(value: Column) -> Column:
    """SCR-1: a score held within 0 to 100, one decimal."""
    return rounded(F.greatest(F.lit(0.0), F.least(F.lit(100.0), value)), 1)


def score_label(score: Column) -> Column:
    return F.when(score >= 90, "Healthy").when(score >= 75, "Watch").when(score >= 60, "At Risk").otherwise("Critical")


def bad_ratio_score(total: str | Column, bad: str | Column, penalty: float = 100.0) -> Column:
    """SCR-1: 100 less ``penalty`` times the share of bad events; 100 without events."""
    return F.when(_num(total) <= 0, 100.0).otherwise(
        clamp_score(100.0 - F.greatest(_num(bad), F.lit(0.0)) / _num(total) * penalty))


def trend_score(current: str | Column, prior: str | Column, warning_pct: float, critical_pct: float,
                no_prior_score: float = 90.0) -> Column:
    """SCR-1: an upward trend costs up to 40 between the two limits, then the rest."""
    cur, pri = _num(current), _num(prior)
    d = (cur - pri) / pri * 100.0
    mid = clamp_score(100.0 - (d - warning_pct) / max(critical_pct - warning_pct, 1.0) * 40.0)
    far = clamp_score(60.0 - F.least(F.lit(60.0), (d - critical_pct) / max(critical_pct, 1.0) * 60.0))
    return (F.when((pri <= 0) & (cur <= 0), 100.0).when(pri <= 0, float(no_prior_score)).when(d <= warning_pct, 100.0)
            .when(d <= critical_pct, mid).otherwise(far))


def _scorecard(metrics: DataFrame, parts: list[tuple[str, Column, float]]) -> DataFrame:
    """(component, score, weight, total_score, label), one row per component."""
    total = sum(w for _, _, w in parts)
    scored = metrics.select(*[s.alias(f"_s{i}") for i, (_, s, _) in enumerate(parts)])
    overall = clamp_score(sum((F.col(f"_s{i}") * w for i, (_, _, w) in enumerate(parts)), F.lit(0.0)) / total)
    rows = F.array(*[F.struct(F.lit(n).alias("component"), F.col(f"_s{i}").alias("score"), F.lit(float(w)).alias("weight"))
                     for i, (n, _, w) in enumerate(parts)])
    return scored.withColumn("total_score", overall).select(F.inline(rows), "total_score") \
        .withColumn("label", score_label(F.col("total_score")))


def query_counters(queries: DataFrame, as_of: datetime, days: int, exact: bool = True) -> DataFrame:
    """One row of statement and warehouse counters over the window."""
    q = queries.filter(lookback("start_time", as_of, days))
    failed, queued = F.col("execution_status") != "SUCCESS", F.col("queued_overload_time") > 0
    one = q.agg(F.count(F.lit(1)).alias("total_queries"), F.count_if(failed).alias("failed_queries"),
                F.count_if(queued).alias("queued_queries"), F.count_if(F.col("transaction_blocked_time") > 0).alias("blocked_queries"),
                (F.avg("total_elapsed_time") / 1000.0).alias("avg_elapsed_sec"),
                (pctl("total_elapsed_time", 0.95, exact) / 1000.0).alias("p95_elapsed_sec"))
    pressed = F.count_if(queued | failed | (F.col("bytes_spilled_to_remote_storage") > 0))
    wh = (q.filter(F.col("warehouse_name").isNotNull()).groupBy("warehouse_name").agg(pressed.alias("_p"))
          .agg(F.count(F.lit(1)).alias("active_warehouses"), F.count_if(F.col("_p") > 0).alias("pressure_warehouses")))
    return one.crossJoin(wh)  # one row each


def executive_health_score(queries: DataFrame, tasks: DataFrame, metering: DataFrame, storage: DataFrame, as_of: datetime,
                           task_as_of: datetime, storage_as_of: date, days: int = 7) -> DataFrame:
    """SCR-2: seven weighted components over the last ``days``."""
    t = tasks.filter(lookback("scheduled_time", task_as_of, days)).agg(
        F.count(F.lit(1)).alias("task_runs"), F.count_if(F.col("state") == "FAILED").alias("failed_tasks"))
    cut = ts_lit(as_of - timedelta(days=days))
    c = metering.filter(between_ts("start_time", as_of - timedelta(days=2 * days), as_of)).agg(
        F.sum(F.when(F.col("start_time") >= cut, F.col("credits_used"))).alias("current_credits"),
        F.sum(F.when(F.col("start_time") < cut, F.col("credits_used"))).alias("prior_credits"))
    mid, low = storage_as_of - timedelta(days=days), storage_as_of - timedelta(days=2 * days)
    s = storage.filter((F.col("usage_date") >= date_lit(low)) & (F.col("usage_date") < date_lit(storage_as_of))).agg(
        (F.sum(F.when(F.col("usage_date") >= date_lit(mid), F.col("average_database_bytes"))) / 1e12).alias("current_storage_tb"),
        (F.sum(F.when(F.col("usage_date") < date_lit(mid), F.col("average_database_bytes"))) / 1e12).alias("prior_storage_tb"))
    m = query_counters(queries, as_of, days).crossJoin(t).crossJoin(c).crossJoin(s)  # one row each
    latency = clamp_score(100.0 - F.least(F.lit(45.0), F.greatest(_num("avg_elapsed_sec") - 2, F.lit(0.0)) * 4))
    return _scorecard(m, [
        ("Query failures", bad_ratio_score("total_queries", "failed_queries", 160), 25),
        ("Queue pressure", bad_ratio_score("total_queries", "queued_queries", 90), 15),
        ("Latency", latency, 10),
        ("Task reliability", bad_ratio_score("task_runs", "failed_tasks", 225), 15),
        ("Warehouse pressure", bad_ratio_score("active_warehouses", "pressure_warehouses", 160), 15),
        ("Credit spike", trend_score("current_credits", "prior_credits", 20, 60), 12),
        ("Storage growth", trend_score("current_storage_tb", "prior_storage_tb", 5, 25, 95), 8)])


def service_health_scorecard(queries: DataFrame, tasks: DataFrame, logins: DataFrame, loads: DataFrame, as_of: datetime,
                             task_as_of: datetime, load_as_of: datetime, days: int = 7) -> DataFrame:
    """SCR-3: five service classes with their own weights and penalties."""
    t = tasks.filter(lookback("scheduled_time", task_as_of, days)).agg(
        F.count(F.lit(1)).alias("task_runs"), F.count_if(F.col("state") == "FAILED").alias("failed_tasks"))
    lo = logins.filter(lookback("event_timestamp", as_of, days)).agg(
        F.count(F.lit(1)).alias("login_events"), F.count_if(F.col("is_success") == "NO").alias("failed_logins"))
    ld = loads.filter(lookback("last_load_time", load_as_of, days)).agg(
        F.count(F.lit(1)).alias("load_events"), F.count_if(F.col("status") != "LOADED").alias("failed_loads"))
    m = query_counters(queries, as_of, days).crossJoin(t).crossJoin(lo).crossJoin(ld)  # one row each
    bad = _num("failed_queries") + _num("queued_queries") * 0.35 + _num("blocked_queries") * 1.25
    query = clamp_score(bad_ratio_score("total_queries", bad, 140)
                        - F.least(F.lit(20.0), F.greatest(_num("p95_elapsed_sec") - 60, F.lit(0.0)) / 12))
    return _scorecard(m, [
        ("Query Processor", query, 30),
        ("Warehouse Availability", bad_ratio_score("active_warehouses", "pressure_warehouses", 180), 25),
        ("Task Service", bad_ratio_score("task_runs", "failed_tasks", 240), 20),
        ("Login/Auth", bad_ratio_score("login_events", "failed_logins", 45), 15),
        ("Data Load", bad_ratio_score("load_events", "failed_loads", 160), 10)])


# Baselines, deductions (above a limit, largest first) and weights of the platform health components.
PLATFORM = {"cost_control": (85.0, 0.30), "reliability": (90.0, 0.30), "security": (80.0, 0.20), "operations": (85.0, 0.20)}
VARIANCE_DEDUCTIONS = [(50, 25), (30, 15), (15, 5)]
FAILURE_DEDUCTIONS = [(50, 30), (20, 15), (5, 5)]
FAILED_TASK_DEDUCTIONS = [(10, 20), (3, 10)]
OPEN_ALERT_DEDUCTIONS = [(20, 25), (10, 15), (3, 5)]
OPEN_ALERTS = ["NEW", "OPEN", "ESCALATED"]
SEVERE = ["CRITICAL", "HIGH"]
RUN_RATE_CAP = 90.0
GRADES = [(90, "A"), (80, "B"), (70, "C"), (60, "D")]


def _deduct(value: Column, steps: list[tuple[int, int]]) -> Column:
    out = F.when(F.lit(False), F.lit(0.0))
    for limit, points in steps:
        out = out.when(value > limit, F.lit(float(points)))
    return out.otherwise(F.lit(0.0))


def platform_health(evidence: DataFrame) -> DataFrame:
    """SCR-4: cost control, reliability, security and operations, each a baseline
    less deductions for the evidence that is there, weighted into one score with
    grade and trend.

    ``evidence``: rows of max_variance_pct, has_run_rate, query_failures,
    failed_tasks, severe_findings, security_exceptions, open_alerts,
    morning_exceptions and previous_score (an account each, or one row); null
    means that nothing was measured."""
    base = {k: F.lit(v[0]) for k, v in PLATFORM.items()}
    cost = base["cost_control"] - _deduct(F.col("max_variance_pct"), VARIANCE_DEDUCTIONS)
    cost = F.when(F.coalesce("has_run_rate", F.lit(False)), F.least(cost, F.lit(RUN_RATE_CAP))).otherwise(cost)
    reliability = base["reliability"] - _deduct(F.col("query_failures"), FAILURE_DEDUCTIONS) - _deduct(F.col("failed_tasks"), FAILED_TASK_DEDUCTIONS)
    severe, exceptions = F.coalesce("severe_findings", F.lit(0)), F.coalesce("security_exceptions", F.lit(0))
    security = base["security"] - F.when(severe > 5, 30.0).otherwise(severe * 10.0) - F.least(F.lit(20.0), exceptions * 3.0)
    operations = base["operations"] - _deduct(F.col("open_alerts"), OPEN_ALERT_DEDUCTIONS) \
        - F.least(F.lit(15.0), F.coalesce("morning_exceptions", F.lit(0)) * 2.0)
    parts = {k: clamp_score(c) for k, c in zip(PLATFORM, (cost, reliability, security, operations))}
    score = clamp_score(sum((parts[k] * PLATFORM[k][1] for k in list(PLATFORM)[1:]), parts["cost_control"] * PLATFORM["cost_control"][1]))
    keys = [c for c in evidence.columns if c not in EVIDENCE]
    d = evidence.select(*keys, "previous_score", *[c.alias(f"{k}_score") for k, c in parts.items()], score.alias("_score"))
    grade = F.when(F.lit(False), "")
    for least, letter in GRADES:
        grade = grade.when(F.col("_score") >= least, letter)
    before = F.coalesce("previous_score", F.lit(0.0))
    trend = (F.when(before <= 0, "unknown").when(F.col("_score") - before > 3, "improving")
             .when(F.col("_score") - before < -3, "declining").otherwise("stable"))
    return d.select(*keys, *[rounded(f"{k}_score", 1).alias(f"{k}_score") for k in PLATFORM], rounded("_score", 1).alias("health_score"),
                    grade.otherwise("F").alias("grade"), trend.alias("trend"))


EVIDENCE = ["max_variance_pct", "has_run_rate", "query_failures", "failed_tasks", "severe_findings", "security_exceptions", "open_alerts",
            "morning_exceptions", "previous_score"]


def platform_evidence(metering: DataFrame, queries: DataFrame, tasks: DataFrame, alerts: DataFrame, logins: DataFrame, as_of: datetime,
                      task_as_of: datetime, days: int = 7) -> DataFrame:
    """One row of :func:`platform_health` evidence a warehouse: the largest change
    of a day's credits against the day before, failed statements; and, the same
    for every warehouse, failed tasks, severe and open alerts and users with
    failed logins."""
    day = metering.filter(between_ts("start_time", as_of - timedelta(days=days + 1), as_of)).groupBy(
        "warehouse_name", F.to_date("start_time").alias("d")).agg(F.sum("credits_used").alias("c"))
    prior = day.select("warehouse_name", F.date_add("d", 1).alias("d"), F.col("c").alias("p"))
    moved = day.join(prior, ["warehouse_name", "d"], "left").groupBy("warehouse_name").agg(
        F.max((F.col("c") - F.col("p")) * 100.0 / F.nullif("p", F.lit(0.0))).alias("max_variance_pct"))
    failed = queries.filter(lookback("start_time", as_of, days)).groupBy("warehouse_name").agg(
        F.count_if(F.col("execution_status") != "SUCCESS").alias("query_failures"))
    t = tasks.filter(lookback("scheduled_time", task_as_of, days)).agg(F.count_if(F.upper("state") == "FAILED").alias("failed_tasks"))
    a = alerts.filter(lookback("created_at", task_as_of, days)).agg(
        F.count_if(F.upper("severity").isin(*SEVERE)).alias("severe_findings"), F.count_if(F.upper("status").isin(*OPEN_ALERTS)).alias("open_alerts"))
    users = logins.filter(lookback("event_timestamp", as_of, days) & (F.col("is_success") == "NO")).agg(F.countDistinct("user_name").alias("security_exceptions"))
    one = t.crossJoin(a).crossJoin(users)  # one row each
    return (moved.join(failed, "warehouse_name", "left").crossJoin(one)
            .select("warehouse_name", "max_variance_pct", F.lit(True).alias("has_run_rate"), "query_failures", "failed_tasks", "severe_findings",
                    "security_exceptions", "open_alerts", F.lit(0).alias("morning_exceptions"), F.lit(None).cast("double").alias("previous_score")))
