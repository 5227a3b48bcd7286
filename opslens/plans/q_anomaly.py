"""Registered anomaly queries (ANO-*) over the projected driver tables."""

from __future__ import annotations

from opslens.operators import anomaly, summaries
from opslens.plans.registry import register
from opslens.sources import testviews as tv
from opslens.sources.testviews import EVENTS_AS_OF, ORDERS_AS_OF


@register("daily_warehouse_credits", "warehouse_metering", op="SUM-1", sql="""
SELECT CAST(start_time AS DATE) AS usage_date, warehouse_name,
       round(sum(coalesce(credits_used, 0)), 4) AS credits_used,
       round(sum(coalesce(credits_used_compute, 0)), 4) AS credits_compute,
       round(sum(coalesce(credits_used_cloud_services, 0)), 4) AS credits_cloud
FROM warehouse_metering
WHERE start_time >= TIMESTAMP '2023-11-02 00:00:00' AND start_time < TIMESTAMP '2024-01-31 00:00:00'
GROUP BY 1, 2
""")
def _(spark, sf):
    return summaries.daily_warehouse_credits(tv.load(spark, sf, "warehouse_metering"), EVENTS_AS_OF, 90)


COST_ANOMALIES_SQL = """
WITH daily AS (
  SELECT CAST(start_time AS DATE) AS usage_date, warehouse_name,
         round(sum(coalesce(credits_used, 0)), 4) AS daily_credits
  FROM warehouse_metering
  WHERE start_time >= TIMESTAMP '2024-01-01 00:00:00' AND start_time < TIMESTAMP '2024-01-31 00:00:00'
  GROUP BY 1, 2),
r AS (
  SELECT *, avg(daily_credits) OVER w AS m, stddev_samp(daily_credits) OVER w AS s
  FROM daily
  WINDOW w AS (PARTITION BY warehouse_name ORDER BY usage_date ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING))
SELECT usage_date, warehouse_name, round(daily_credits, 2) AS daily_credits,
       round(m, 2) AS baseline_mean, round(s, 2) AS baseline_stddev,
       round((daily_credits - m) / s, 2) AS z_score,
       round(daily_credits - m, 2) AS delta_from_baseline,
       round((daily_credits - m) / nullif(m, 0) * 100, 1) AS pct_above_baseline,
       CASE WHEN (daily_credits - m) / s >= 3.0 THEN 'Critical'
            WHEN (daily_credits - m) / s >= 2.0 THEN 'High'
            WHEN (daily_credits - m) / s >= 1.4 THEN 'Medium' ELSE 'Normal' END AS anomaly_severity
FROM r WHERE m IS NOT NULL AND s > 0 AND (daily_credits - m) / s >= 1.4
"""


@register("cost_anomalies", "warehouse_metering", op="ANO-1", sql=COST_ANOMALIES_SQL)
def _(spark, sf):
    return anomaly.cost_anomalies(tv.load(spark, sf, "warehouse_metering"), EVENTS_AS_OF, 30, 2.0)


@register("cost_anomalies_short", "warehouse_metering", op="ANO-2", sql="""
WITH daily AS (
  SELECT warehouse_name, date_trunc('day', start_time) AS day, sum(credits_used) AS daily_credits
  FROM warehouse_metering WHERE start_time >= TIMESTAMP '2024-01-01 00:00:00'
  GROUP BY 1, 2),
r AS (
  SELECT *, avg(daily_credits) OVER w AS m, stddev_samp(daily_credits) OVER w AS s
  FROM daily
  WINDOW w AS (PARTITION BY warehouse_name ORDER BY day ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING))
SELECT warehouse_name, day, round(daily_credits, 4) AS daily_credits, round(m, 4) AS rolling_avg,
       round(CASE WHEN s > 0 THEN (daily_credits - m) / s END, 2) AS zscore,
       CASE WHEN (daily_credits - m) / nullif(s, 0) > 2 THEN 'SPIKE'
            WHEN (daily_credits - m) / nullif(s, 0) > 1.5 THEN 'ELEVATED' END AS anomaly_flag
FROM r WHERE m IS NOT NULL AND (daily_credits - m) / nullif(s, 0) > 1.5
""")
def _(spark, sf):
    return anomaly.cost_anomalies_short(tv.load(spark, sf, "warehouse_metering"), EVENTS_AS_OF, 30)


_REGRESSION = """
q AS (
  SELECT query_hash, warehouse_name, database_name, user_name, total_elapsed_time / 1000.0 AS sec,
         start_time >= TIMESTAMP '2024-01-24 00:00:00' AS recent
  FROM query_history
  WHERE start_time >= TIMESTAMP '2024-01-17 00:00:00' AND execution_status = 'SUCCESS'
    AND total_elapsed_time > 1000 AND warehouse_name IS NOT NULL AND query_hash IS NOT NULL),
p AS (
  SELECT query_hash, recent, min(warehouse_name) AS warehouse_name, min(database_name) AS database_name,
         min(user_name) AS user_name, count(*) AS runs, round(avg(sec), 2) AS avg_sec,
         round(quantile_cont(sec, 0.95), 2) AS p95_sec, round(max(sec), 2) AS max_sec
  FROM q GROUP BY 1, 2 HAVING count(*) >= 3),
c AS (
  SELECT r.query_hash, r.warehouse_name, r.database_name, r.user_name,
         b.runs AS baseline_runs, r.runs AS recent_runs, b.p95_sec AS baseline_p95_sec, r.p95_sec AS recent_p95_sec,
         b.avg_sec AS baseline_avg_sec, r.avg_sec AS recent_avg_sec, r.max_sec AS recent_max_sec,
         round(r.p95_sec / nullif(b.p95_sec, 0), 2) AS regression_factor,
         round(r.p95_sec - b.p95_sec, 2) AS regression_delta_sec
  FROM p r JOIN p b ON r.query_hash = b.query_hash AND r.recent AND NOT b.recent
  WHERE r.p95_sec > b.p95_sec * 1.2 AND r.p95_sec > 5),
reg AS (SELECT *, CASE WHEN regression_factor >= 2.4 THEN 'Critical' WHEN regression_factor >= 1.7999999999999998 THEN 'High'
               WHEN regression_factor >= 1.2 THEN 'Medium' ELSE 'Watch' END AS severity FROM c)
"""


@register("query_regressions", "query_history", op="ANO-3", sql="WITH " + _REGRESSION + """
SELECT * FROM reg ORDER BY regression_delta_sec DESC, regression_factor DESC, query_hash LIMIT 50
""")
def _(spark, sf):
    return anomaly.query_regressions(tv.load(spark, sf, "query_history"), EVENTS_AS_OF, 14, 1.2)


@register("query_degradation", "query_history", op="ANO-4", sql="""
WITH g AS (
  SELECT query_hash,
         count_if(start_time >= TIMESTAMP '2024-01-24 00:00:00') AS recent_runs,
         count_if(start_time < TIMESTAMP '2024-01-24 00:00:00') AS prior_runs,
         avg(CASE WHEN start_time >= TIMESTAMP '2024-01-24 00:00:00' THEN total_elapsed_time / 1000.0 END) AS r,
         avg(CASE WHEN start_time < TIMESTAMP '2024-01-24 00:00:00' THEN total_elapsed_time / 1000.0 END) AS p,
         min(warehouse_name) AS warehouse_name
  FROM query_history WHERE start_time >= TIMESTAMP '2024-01-17 00:00:00' AND query_hash IS NOT NULL
  GROUP BY 1 HAVING count_if(start_time >= TIMESTAMP '2024-01-24 00:00:00') >= 5
                AND count_if(start_time < TIMESTAMP '2024-01-24 00:00:00') >= 5)
SELECT query_hash, warehouse_name, recent_runs, prior_runs, round(r, 2) AS recent_avg_sec,
       round(p, 2) AS prior_avg_sec, round((r - p) / nullif(p, 0) * 100, 1) AS pct_change
FROM g WHERE (r - p) / nullif(p, 0) * 100 >= 10
ORDER BY pct_change DESC, query_hash LIMIT 50
""")
def _(spark, sf):
    return anomaly.query_degradation(tv.load(spark, sf, "query_history"), EVENTS_AS_OF, 5, 10.0)


_BURSTS_SQL = """
SELECT CAST(scheduled_time AS DATE) AS failure_date, database_name, schema_name, name AS task_name,
       count(*) AS failure_count, min(scheduled_time) AS first_failure, max(scheduled_time) AS last_failure,
       array_to_string(list_sort(list_distinct(list(coalesce(error_code, 'UNKNOWN')))), ', ') AS error_codes,
       CASE WHEN count(*) >= 6 THEN 'Critical' WHEN count(*) >= 4 THEN 'High'
            WHEN count(*) >= 2 THEN 'Medium' ELSE 'Watch' END AS severity
FROM task_history
WHERE scheduled_time >= TIMESTAMP '2000-08-02 00:00:00' AND state = 'FAILED'
GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2
"""


@register("task_failure_bursts", "task_history", op="ANO-5", sql=_BURSTS_SQL)
def _(spark, sf):
    return anomaly.task_failure_bursts(tv.load(spark, sf, "task_history"), ORDERS_AS_OF, 365, 2)


@register("anomaly_findings_summary", "warehouse_metering", "task_history", "query_history", op="ANO-6", sql="WITH " + _REGRESSION + """,
daily AS (
  SELECT CAST(start_time AS DATE) AS usage_date, warehouse_name,
         round(sum(coalesce(credits_used, 0)), 4) AS daily_credits
  FROM warehouse_metering
  WHERE start_time >= TIMESTAMP '2024-01-01 00:00:00' AND start_time < TIMESTAMP '2024-01-31 00:00:00'
  GROUP BY 1, 2),
r AS (
  SELECT *, avg(daily_credits) OVER w AS m, stddev_samp(daily_credits) OVER w AS s
  FROM daily WINDOW w AS (PARTITION BY warehouse_name ORDER BY usage_date ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)),
cost AS (
  SELECT usage_date, warehouse_name, round((daily_credits - m) / s, 2) AS z_score,
         CASE WHEN (daily_credits - m) / s >= 3.0 THEN 'Critical' WHEN (daily_credits - m) / s >= 2.0 THEN 'High'
              ELSE 'Medium' END AS severity
  FROM r WHERE m IS NOT NULL AND s > 0 AND (daily_credits - m) / s >= 1.4),
bursts AS (""" + _BURSTS_SQL + """),
f AS (SELECT severity FROM cost UNION ALL SELECT severity FROM reg UNION ALL SELECT severity FROM bursts)
SELECT count(*) AS total_anomalies, count_if(severity = 'Critical') AS critical,
       count_if(severity = 'High') AS high, count_if(severity = 'Medium') AS medium
FROM f
""")
def _(spark, sf):
    cost = anomaly.cost_anomalies(tv.load(spark, sf, "warehouse_metering"), EVENTS_AS_OF, 30, 2.0)
    bursts = anomaly.task_failure_bursts(tv.load(spark, sf, "task_history"), ORDERS_AS_OF, 365, 2)
    slower = anomaly.query_regressions(tv.load(spark, sf, "query_history"), EVENTS_AS_OF, 14, 1.2, limit=None)
    return anomaly.findings_summary(anomaly.merge_findings(cost, slower, bursts))


_FP_SQL = """
WITH hp AS (
  SELECT warehouse_name, CAST(dayofweek(CAST(start_time AS DATE)) AS INTEGER) AS day_of_week,
         CAST(hour(start_time) AS INTEGER) AS hour_of_day, CAST(start_time AS DATE) AS usage_date,
         count(*) AS query_count, round(sum(total_elapsed_time) / 1000.0, 1) AS total_elapsed_sec,
         round(sum(bytes_scanned) / (1024.0 * 1024 * 1024), 2) AS gb_scanned,
         round(avg(total_elapsed_time) / 1000.0, 2) AS avg_elapsed_sec,
         count(DISTINCT user_name) AS unique_users
  FROM query_history
  WHERE start_time >= TIMESTAMP '2024-01-03 00:00:00' AND start_time < TIMESTAMP '2024-01-30 00:00:00'
    AND warehouse_name IS NOT NULL AND execution_status = 'SUCCESS'
  GROUP BY 1, 2, 3, 4)
SELECT warehouse_name, day_of_week, hour_of_day, count(*) AS sample_days,
       round(avg(query_count), 1) AS baseline_query_count, round(stddev_samp(query_count), 1) AS stddev_query_count,
       round(avg(total_elapsed_sec), 1) AS baseline_elapsed_sec, round(stddev_samp(total_elapsed_sec), 1) AS stddev_elapsed_sec,
       round(avg(gb_scanned), 2) AS baseline_gb_scanned, round(stddev_samp(gb_scanned), 2) AS stddev_gb_scanned,
       round(avg(unique_users), 1) AS baseline_users, round(avg(avg_elapsed_sec), 2) AS baseline_avg_query_sec
FROM hp GROUP BY 1, 2, 3 HAVING count(*) >= 2
"""


@register("workload_fingerprint", "query_history", op="ANO-7", sql=_FP_SQL)
def _(spark, sf):
    return anomaly.workload_fingerprint(tv.load(spark, sf, "query_history"), EVENTS_AS_OF, 4)


_CUR_SQL = """
SELECT warehouse_name, CAST(dayofweek(CAST(start_time AS DATE)) AS INTEGER) AS day_of_week,
       CAST(hour(start_time) AS INTEGER) AS hour_of_day, count(*) AS query_count,
       round(sum(total_elapsed_time) / 1000.0, 1) AS total_elapsed_sec,
       round(sum(bytes_scanned) / (1024.0 * 1024 * 1024), 2) AS gb_scanned,
       round(avg(total_elapsed_time) / 1000.0, 2) AS avg_elapsed_sec,
       count(DISTINCT user_name) AS unique_users
FROM query_history
WHERE start_time >= TIMESTAMP '2024-01-30 16:00:00' AND start_time < TIMESTAMP '2024-01-31 00:00:00'
  AND warehouse_name IS NOT NULL AND execution_status = 'SUCCESS'
GROUP BY 1, 2, 3
"""


@register("current_profile", "query_history", op="ANO-8", sql=_CUR_SQL)
def _(spark, sf):
    return anomaly.current_profile(tv.load(spark, sf, "query_history"), EVENTS_AS_OF, 8)


@register("workload_drift", "query_history", op="ANO-9", sql="""
WITH cur AS (""" + _CUR_SQL + """), base AS (""" + _FP_SQL + """),
j AS (
  SELECT c.warehouse_name, c.day_of_week, c.hour_of_day,
         CASE WHEN b.stddev_query_count > 0 THEN abs((c.query_count - b.baseline_query_count) / b.stddev_query_count) END AS z1,
         CASE WHEN b.stddev_elapsed_sec > 0 THEN abs((c.total_elapsed_sec - b.baseline_elapsed_sec) / b.stddev_elapsed_sec) END AS z2,
         CASE WHEN b.stddev_gb_scanned > 0 THEN abs((c.gb_scanned - b.baseline_gb_scanned) / b.stddev_gb_scanned) END AS z3
  FROM cur c JOIN base b USING (warehouse_name, day_of_week, hour_of_day)),
k AS (
  SELECT *, (CASE WHEN z1 IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN z2 IS NOT NULL THEN 1 ELSE 0 END
             + CASE WHEN z3 IS NOT NULL THEN 1 ELSE 0 END) AS n,
         coalesce(z1, 0) + coalesce(z2, 0) + coalesce(z3, 0) AS tot FROM j)
SELECT warehouse_name AS warehouse, day_of_week, hour_of_day, round(tot / n, 2) AS drift_score, n AS dimensions_scored,
       CASE WHEN tot / n >= 1.5 THEN 'Critical' WHEN tot / n >= 1.0 THEN 'High' WHEN tot / n >= 0.7 THEN 'Medium' END AS severity
FROM k WHERE n > 0 AND tot / n >= 0.7
""")
def _(spark, sf):
    q = tv.load(spark, sf, "query_history")
    return anomaly.workload_drift(anomaly.current_profile(q, EVENTS_AS_OF, 8),
                                  anomaly.workload_fingerprint(q, EVENTS_AS_OF, 4), 1.0)
