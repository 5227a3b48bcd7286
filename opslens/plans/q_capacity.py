"""Registered capacity and query-performance queries (CAP-*, QRY-*)."""

from __future__ import annotations

from datetime import datetime

from opslens.operators import capacity as cap
from opslens.operators import query as qry
from opslens.plans.registry import register
from opslens.sources import testviews as tv
from opslens.sources.testviews import EVENTS_AS_OF

GB = "(1024.0 * 1024 * 1024)"
QUEUED = "(coalesce(queued_overload_time, 0) + coalesce(queued_provisioning_time, 0))"
FAILED = "(error_code IS NOT NULL OR upper(coalesce(execution_status, '')) <> 'SUCCESS')"


def _q(spark, sf):
    return tv.load(spark, sf, "query_history")


def _m(spark, sf):
    return tv.load(spark, sf, "warehouse_metering")


_UTIL = f"""
WITH u AS (SELECT warehouse_name, date_trunc('hour', start_time) AS hour_bucket, sum(credits_used_compute) AS hourly_credits
           FROM warehouse_metering WHERE start_time >= TIMESTAMP '2024-01-01 00:00:00' AND start_time < TIMESTAMP '2024-01-31 00:00:00'
           GROUP BY 1, 2),
qp AS (SELECT warehouse_name, date_trunc('hour', start_time) AS hour_bucket, count(*) AS query_count,
              avg(queued_overload_time) / 1000.0 AS avg_queue_sec, max(queued_overload_time) / 1000.0 AS max_queue_sec,
              sum(bytes_spilled_to_remote_storage) / {GB} AS remote_spill_gb,
              quantile_cont(total_elapsed_time / 1000.0, 0.95) AS p95_elapsed_sec
       FROM query_history WHERE start_time >= TIMESTAMP '2024-01-01 00:00:00' AND warehouse_name IS NOT NULL
         AND execution_status = 'SUCCESS' GROUP BY 1, 2),
util AS (
SELECT u.warehouse_name, count(DISTINCT u.hour_bucket) AS active_hours, round(avg(u.hourly_credits), 4) AS avg_hourly_credits,
       round(max(u.hourly_credits), 4) AS peak_hourly_credits, round(quantile_cont(u.hourly_credits, 0.95), 4) AS p95_hourly_credits,
       round(avg(qp.query_count), 0) AS avg_hourly_queries, round(max(qp.query_count), 0) AS peak_hourly_queries,
       round(avg(qp.avg_queue_sec), 2) AS avg_queue_sec, round(max(qp.max_queue_sec), 2) AS peak_queue_sec,
       round(sum(qp.remote_spill_gb), 2) AS total_remote_spill_gb, round(avg(qp.p95_elapsed_sec), 2) AS avg_p95_elapsed_sec
FROM u LEFT JOIN qp ON u.warehouse_name = qp.warehouse_name AND u.hour_bucket = qp.hour_bucket
GROUP BY 1)
"""


@register("warehouse_utilization", "query_history", "warehouse_metering", op="CAP-1", sql=_UTIL + "SELECT * FROM util")
def _(spark, sf):
    return cap.warehouse_utilization(_m(spark, sf), _q(spark, sf), EVENTS_AS_OF, 30)


@register("size_recommendation", "query_history", "warehouse_metering", op="CAP-4", sql=_UTIL + """,
s AS (SELECT warehouse_name, coalesce(avg_queue_sec, 0) AS aq, coalesce(peak_queue_sec, 0) AS pq,
             coalesce(total_remote_spill_gb, 0) AS sp, coalesce(peak_hourly_credits, 0) AS pc,
             coalesce(avg_hourly_credits, 0) AS ac FROM util),
t AS (SELECT *, CAST(aq > 5.0 AS INTEGER) + CAST(pq > 15.0 AS INTEGER) + CAST(sp > 1.0 AS INTEGER) AS up,
             (aq < 0.5 AND sp < 0.1 AND ac > 0 AND pc < ac * 1.5) AS down, (pq > 25.0 AND sp < 1.0) AS multi FROM s)
SELECT warehouse_name,
       CASE WHEN multi THEN 'consider_multi_cluster' WHEN up >= 2 THEN 'upsize' WHEN down AND up = 0 THEN 'downsize' ELSE 'maintain' END AS recommendation,
       CASE WHEN multi THEN 'high' WHEN up >= 2 THEN CASE WHEN up >= 3 THEN 'high' ELSE 'medium' END
            WHEN down AND up = 0 THEN 'medium' WHEN up + CAST(down AS INTEGER) = 0 THEN 'high' ELSE 'medium' END AS confidence,
       up AS upsize_signals,
       concat_ws('; ', CASE WHEN aq > 5.0 THEN 'avg queue above threshold' END, CASE WHEN pq > 15.0 THEN 'peak queue 3x threshold' END,
                 CASE WHEN sp > 1.0 THEN 'remote spill above threshold' END, CASE WHEN down THEN 'low queue, no spill, stable load' END) AS evidence
FROM t
""")
def _(spark, sf):
    return cap.size_recommendation(cap.warehouse_utilization(_m(spark, sf), _q(spark, sf), EVENTS_AS_OF, 30))


@register("peak_hours", "query_history", op="CAP-2", sql=f"""
SELECT warehouse_name, CAST(hour(start_time) AS INTEGER) AS hour_of_day, CAST(dayofweek(start_time) AS INTEGER) AS day_of_week,
       count(*) AS query_count, round(avg(total_elapsed_time / 1000.0), 2) AS avg_elapsed_sec,
       round(avg(queued_overload_time / 1000.0), 2) AS avg_queue_sec,
       round(sum(bytes_spilled_to_remote_storage) / {GB}, 2) AS remote_spill_gb
FROM query_history WHERE start_time >= TIMESTAMP '2024-01-17 00:00:00' AND warehouse_name IS NOT NULL AND execution_status = 'SUCCESS'
GROUP BY 1, 2, 3
""")
def _(spark, sf):
    return cap.peak_hours(_q(spark, sf), EVENTS_AS_OF, 14)


@register("weekly_growth", "metering_long", op="CAP-3", sql="""
WITH wk AS (SELECT warehouse_name, date_trunc('week', CAST(start_time AS DATE)) AS week_start, round(sum(credits_used), 4) AS weekly_credits
            FROM metering_long WHERE start_time >= TIMESTAMP '2001-09-06 00:00:00' GROUP BY 1, 2)
SELECT warehouse_name, week_start, weekly_credits,
       lag(weekly_credits) OVER (PARTITION BY warehouse_name ORDER BY week_start) AS prev_week_credits,
       round((weekly_credits - lag(weekly_credits) OVER (PARTITION BY warehouse_name ORDER BY week_start))
             / nullif(lag(weekly_credits) OVER (PARTITION BY warehouse_name ORDER BY week_start), 0) * 100, 1) AS wow_growth_pct
FROM wk
""")
def _(spark, sf):
    return cap.weekly_growth(tv.load(spark, sf, "metering_long"), tv.LINEITEM_AS_OF, 60)


@register("capacity_outlook", "metering_long", "warehouses", op="CAP-5", sql="""
WITH wk AS (SELECT warehouse_name, date_trunc('week', CAST(start_time AS DATE)) AS week_start, round(sum(credits_used), 4) AS weekly_credits
            FROM metering_long WHERE start_time >= TIMESTAMP '2001-09-06 00:00:00' GROUP BY 1, 2),
g AS (SELECT *, round((weekly_credits - lag(weekly_credits) OVER w) / nullif(lag(weekly_credits) OVER w, 0) * 100, 1) AS wow_growth_pct
      FROM wk WINDOW w AS (PARTITION BY warehouse_name ORDER BY week_start)),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY warehouse_name ORDER BY week_start DESC) AS rn FROM g) WHERE rn = 1),
j AS (SELECT l.warehouse_name, w.warehouse_size, l.week_start, l.weekly_credits AS cur, coalesce(l.wow_growth_pct, 0.0) AS gr,
             CAST(CASE coalesce(w.warehouse_size, 'X-Small') WHEN 'X-Small' THEN 1 WHEN 'Small' THEN 2 WHEN 'Medium' THEN 4 WHEN 'Large' THEN 8
                  WHEN 'X-Large' THEN 16 WHEN '2X-Large' THEN 32 WHEN '3X-Large' THEN 64 WHEN '4X-Large' THEN 128
                  WHEN '5X-Large' THEN 256 WHEN '6X-Large' THEN 512 ELSE 1 END * 168 AS DOUBLE) AS cap
      FROM l LEFT JOIN warehouses w ON l.warehouse_name = w.warehouse_name),
k AS (SELECT *, CASE WHEN gr <= 0 OR cur <= 0 THEN NULL WHEN cur >= cap THEN 0
                     WHEN CAST(ceil(ln(cap / cur) / ln(1 + gr / 100)) AS INTEGER) >= 52 THEN NULL
                     ELSE CAST(ceil(ln(cap / cur) / ln(1 + gr / 100)) AS INTEGER) END AS weeks FROM j)
SELECT warehouse_name, warehouse_size, week_start, cur AS weekly_credits, gr AS wow_growth_pct, cap AS weekly_capacity_credits,
       round(cur * 100 / nullif(cap, 0), 2) AS capacity_score, weeks AS weeks_until_full,
       CASE WHEN weeks IS NULL THEN 'none' WHEN weeks = 0 THEN 'immediate' WHEN weeks <= 4 THEN 'critical'
            WHEN weeks <= 12 THEN 'plan' ELSE 'monitor' END AS urgency,
       coalesce(weeks <= 12, FALSE) AS action_needed
FROM k
""")
def _(spark, sf):
    return cap.capacity_outlook(tv.load(spark, sf, "metering_long"), tv.load(spark, sf, "warehouses"),
                                tv.LINEITEM_AS_OF, 60)


_CAPACITY = f"""
WITH q AS (SELECT warehouse_name, max(warehouse_size) AS warehouse_size, count(*) AS n, count_if({QUEUED} > 0) AS queued,
                  count_if(bytes_spilled_to_local_storage + bytes_spilled_to_remote_storage > 0) AS spilled, count_if(total_elapsed_time >= 30000) AS slow,
                  quantile_cont(total_elapsed_time / 1000.0, 0.95) AS p95, sum(bytes_spilled_to_remote_storage) / {GB} AS gb
           FROM query_history WHERE start_time >= TIMESTAMP '2024-01-24 00:00:00' AND warehouse_name IS NOT NULL GROUP BY 1),
m AS (SELECT warehouse_name, sum(CASE WHEN start_time >= TIMESTAMP '2024-01-24 00:00:00' THEN credits_used_compute ELSE 0 END) AS cur,
             sum(CASE WHEN start_time < TIMESTAMP '2024-01-24 00:00:00' THEN credits_used_compute ELSE 0 END) AS prior
      FROM warehouse_metering WHERE start_time >= TIMESTAMP '2024-01-17 00:00:00' GROUP BY 1),
c AS (SELECT coalesce(q.warehouse_name, m.warehouse_name) AS warehouse_name, warehouse_size, coalesce(n, 0) AS n, coalesce(queued, 0) AS queued,
             coalesce(spilled, 0) AS spilled, coalesce(slow, 0) AS slow, coalesce(p95, 0) AS p95, coalesce(gb, 0) AS gb, coalesce(cur, 0) AS cur,
             coalesce(prior, 0) AS prior, (coalesce(cur, 0) - coalesce(prior, 0)) / nullif(coalesce(prior, 0), 0) * 100 AS up
      FROM q FULL JOIN m ON q.warehouse_name = m.warehouse_name)
"""


@register("capacity_summary", "query_history", "warehouse_metering", op="CAP-5", sql=_CAPACITY + """
SELECT count(*) AS warehouses_active, CAST(sum(n) AS BIGINT) AS total_queries, CAST(sum(queued) AS BIGINT) AS queued_queries,
       CAST(sum(spilled) AS BIGINT) AS spill_queries, CAST(sum(slow) AS BIGINT) AS high_latency_queries, round(sum(cur), 4) AS metered_credits,
       round(sum(prior), 4) AS prior_credits, round((sum(cur) - sum(prior)) / nullif(sum(prior), 0) * 100, 1) AS credit_spike_pct,
       round(max(p95), 2) AS worst_p95_elapsed_sec, round(sum(gb), 2) AS remote_spill_gb FROM c
""")
def _(spark, sf):
    return cap.capacity_summary(tv.load(spark, sf, "query_history"), tv.load(spark, sf, "warehouse_metering"), EVENTS_AS_OF, 7)


@register("capacity_exceptions", "query_history", "warehouse_metering", op="CAP-5", sql=_CAPACITY + """
SELECT CASE WHEN queued >= 20 OR gb >= 20 THEN 'Critical' WHEN up >= 50 OR spilled >= 10 OR slow >= 25 THEN 'High' ELSE 'Medium' END AS severity,
       CASE WHEN queued >= 20 THEN 'Queue Pressure' WHEN gb >= 1 THEN 'Memory Spill' WHEN up >= 25 THEN 'Credit Spike' ELSE 'Latency Pressure' END AS signal,
       warehouse_name, warehouse_size, n AS total_queries, queued AS queued_queries, spilled AS spill_queries, slow AS high_latency_queries,
       round(p95, 2) AS p95_elapsed_sec, round(gb, 2) AS remote_spill_gb, round(cur, 4) AS metered_credits, round(prior, 4) AS prior_credits,
       round(coalesce(up, 0), 1) AS credit_spike_pct,
       CASE WHEN n > 0 THEN round(100 - least(queued * 100.0 / n * 2.0, 28) - least(spilled * 100.0 / n * 1.8, 24) - least(slow * 100.0 / n * 1.1, 18)
                                  - least(greatest(coalesce(up, 0), 0) / 4, 20), 1) END AS capacity_score
FROM c WHERE queued > 0 OR spilled > 0 OR slow > 0 OR up >= 25
""")
def _(spark, sf):
    return cap.capacity_exceptions(tv.load(spark, sf, "query_history"), tv.load(spark, sf, "warehouse_metering"), EVENTS_AS_OF, 7)


@register("pressure_exceptions", "query_history", op="CAP-6", sql=f"""
SELECT warehouse_name, max(warehouse_size) AS warehouse_size, count(*) AS total_queries,
       count_if({QUEUED} > 0) AS queued_queries,
       count_if(coalesce(bytes_spilled_to_remote_storage, 0) > 0) AS remote_spill_queries,
       round(sum(coalesce(bytes_spilled_to_remote_storage, 0)) / {GB}, 2) AS remote_spill_gb,
       round(quantile_cont(coalesce(total_elapsed_time, 0) / 1000.0, 0.95), 2) AS p95_elapsed_sec
FROM query_history WHERE start_time >= TIMESTAMP '2024-01-30 00:00:00' AND warehouse_name IS NOT NULL
GROUP BY 1
HAVING count_if({QUEUED} > 0) > 0 OR count_if(coalesce(bytes_spilled_to_remote_storage, 0) > 0) > 0 OR p95_elapsed_sec >= 60
ORDER BY queued_queries DESC, remote_spill_gb DESC, p95_elapsed_sec DESC, warehouse_name LIMIT 10
""")
def _(spark, sf):
    return cap.pressure_exceptions(_q(spark, sf), EVENTS_AS_OF, 24)


@register("warehouse_overview", "query_history", "warehouse_metering", op="CAP-7", sql=f"""
WITH qr AS (SELECT warehouse_name, max(warehouse_size) AS warehouse_size, count(*) AS total_queries,
                   round(sum(total_elapsed_time) / count(*) / 1000.0, 3) AS avg_elapsed_sec,
                   round(sum(queued_overload_time + queued_provisioning_time) / count(*) / 1000.0, 3) AS avg_queued_sec,
                   round(sum(bytes_spilled_to_remote_storage) / {GB}, 3) AS total_remote_spill_gb,
                   count_if(execution_status <> 'SUCCESS') AS error_count,
                   round(sum(bytes_scanned) / {GB}, 3) AS total_gb_scanned
            FROM query_history WHERE start_time >= TIMESTAMP '2024-01-24 00:00:00' AND start_time < TIMESTAMP '2024-01-31 00:00:00'
              AND warehouse_name IS NOT NULL GROUP BY 1),
cr AS (SELECT warehouse_name,
              sum(CASE WHEN start_time >= TIMESTAMP '2024-01-24 00:00:00' THEN coalesce(credits_used, 0) ELSE 0 END) AS c,
              sum(CASE WHEN start_time < TIMESTAMP '2024-01-24 00:00:00' THEN coalesce(credits_used, 0) ELSE 0 END) AS p,
              sum(CASE WHEN start_time >= TIMESTAMP '2024-01-24 00:00:00' THEN coalesce(credits_used_compute, 0) ELSE 0 END) AS cc,
              sum(CASE WHEN start_time >= TIMESTAMP '2024-01-24 00:00:00' THEN coalesce(credits_used_cloud_services, 0) ELSE 0 END) AS cl
       FROM warehouse_metering WHERE start_time >= TIMESTAMP '2024-01-17 00:00:00' AND start_time < TIMESTAMP '2024-01-31 00:00:00'
       GROUP BY 1)
SELECT qr.*, coalesce(round(c, 4), 0.0) AS metered_credits, coalesce(round(p, 4), 0.0) AS prior_metered_credits,
       coalesce(round(c - p, 4), 0.0) AS credit_delta, round((c - p) / nullif(p, 0) * 100, 1) AS credit_delta_pct,
       coalesce(round(cc, 4), 0.0) AS credits_used_compute, coalesce(round(cl, 4), 0.0) AS credits_used_cloud_services
FROM qr LEFT JOIN cr ON qr.warehouse_name = cr.warehouse_name
""")
def _(spark, sf):
    return cap.warehouse_overview(_q(spark, sf), _m(spark, sf), EVENTS_AS_OF, 7)


@register("largest_metering_hours", "warehouse_metering", op="CAP-8", sql="""
SELECT warehouse_name, date_trunc('hour', start_time) AS hour_start, round(sum(credits_used), 4) AS credits_used
FROM warehouse_metering WHERE start_time >= TIMESTAMP '2024-01-24 00:00:00' AND start_time < TIMESTAMP '2024-01-31 00:00:00'
GROUP BY 1, 2 ORDER BY credits_used DESC, 1, 2 LIMIT 20
""")
def _(spark, sf):
    return cap.largest_metering_hours(_m(spark, sf), EVENTS_AS_OF, 7, 20)


_SUSPEND = """
up AS (SELECT warehouse_name, count(DISTINCT date_trunc('hour', start_time)) AS active_hours, count(*) AS query_count,
              round(avg(total_elapsed_time / 1000.0), 1) AS avg_query_sec
       FROM query_history WHERE start_time >= TIMESTAMP '2024-01-24 00:00:00' AND warehouse_name IS NOT NULL GROUP BY 1),
m AS (SELECT warehouse_name, round(sum(credits_used), 4) AS total_credits, count(DISTINCT date_trunc('hour', start_time)) AS metered_hours
      FROM warehouse_metering WHERE start_time >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY 1),
sus AS (
SELECT w.warehouse_name, w.auto_suspend, w.warehouse_size, coalesce(up.active_hours, 0) AS active_hours,
       coalesce(up.query_count, 0) AS query_count, coalesce(up.avg_query_sec, 0.0) AS avg_query_sec,
       coalesce(m.total_credits, 0.0) AS total_credits, coalesce(m.metered_hours, 0) AS metered_hours,
       CASE WHEN w.auto_suspend = 0 THEN 'Never suspends'
            WHEN w.auto_suspend > 300 AND coalesce(up.query_count, 0) < 100 THEN 'High timeout + low usage'
            WHEN w.auto_suspend > 120 AND coalesce(m.total_credits, 0) > 10 THEN 'Could benefit from 60s timeout'
            ELSE 'Acceptable' END AS recommendation_type
FROM warehouses w LEFT JOIN up ON w.warehouse_name = up.warehouse_name LEFT JOIN m ON w.warehouse_name = m.warehouse_name
WHERE w.auto_suspend = 0 OR (w.auto_suspend > 120 AND coalesce(up.query_count, 0) < 1000))
"""


@register("suspend_timeout_analysis", "warehouses", "query_history", "warehouse_metering", op="CAP-10",
          sql="WITH " + _SUSPEND + "SELECT * FROM sus")
def _(spark, sf):
    return cap.suspend_timeout_analysis(tv.load(spark, sf, "warehouses"), _q(spark, sf), _m(spark, sf), EVENTS_AS_OF, 7)


_CONSOL = """
cons AS (SELECT warehouse_name, count(*) AS query_count, round(sum(total_elapsed_time) / 1000.0 / 3600, 2) AS total_hours_runtime
         FROM query_history WHERE start_time >= TIMESTAMP '2024-01-17 00:00:00' AND warehouse_name IS NOT NULL GROUP BY 1
         HAVING count(*) < 1000 AND round(sum(total_elapsed_time) / 1000.0 / 3600, 2) < 40
         ORDER BY total_hours_runtime, warehouse_name LIMIT 20)
"""


@register("consolidation_candidates", "query_history", op="CAP-11", sql="WITH " + _CONSOL + "SELECT * FROM cons")
def _(spark, sf):
    return cap.consolidation_candidates(_q(spark, sf), EVENTS_AS_OF, 14, max_queries=1000, max_hours=40.0)


@register("shared_hours", "query_history", op="CAP-12", sql="""
WITH act AS (SELECT DISTINCT warehouse_name, date_trunc('hour', start_time) AS hour_bucket FROM query_history
             WHERE start_time >= TIMESTAMP '2024-01-17 00:00:00' AND warehouse_name IS NOT NULL),
ph AS (SELECT hour_bucket, count(*) AS w FROM act GROUP BY 1)
SELECT warehouse_name, count(*) AS active_hours, count_if(w > 1) AS shared_hours, round(avg(w), 2) AS avg_concurrent_warehouses
FROM act JOIN ph USING (hour_bucket) GROUP BY 1
""")
def _(spark, sf):
    return cap.shared_hours(_q(spark, sf), EVENTS_AS_OF, 14)


@register("savings_estimates", "warehouses", "query_history", "warehouse_metering", op="CAP-13",
          sql="WITH " + _SUSPEND + "," + _CONSOL + """
SELECT warehouse_name AS warehouse, 'suspend_timeout' AS type,
       CASE WHEN coalesce(auto_suspend, 0) = 0 THEN 'High' ELSE 'Medium' END AS severity,
       round(total_credits * CASE WHEN coalesce(auto_suspend, 0) = 0 THEN 0.30 WHEN auto_suspend > 300 THEN 0.15
                                  WHEN auto_suspend > 120 THEN 0.10 ELSE 0.05 END * (30.0 / 7) * 3.68, 0) AS est_monthly_savings
FROM sus WHERE recommendation_type NOT LIKE '%Acceptable%'
UNION ALL
SELECT warehouse_name, 'consolidation', 'Low', CAST(7.0 AS DOUBLE) FROM cons
""")
def _(spark, sf):
    s = cap.suspend_timeout_analysis(tv.load(spark, sf, "warehouses"), _q(spark, sf), _m(spark, sf), EVENTS_AS_OF, 7)
    c = cap.consolidation_candidates(_q(spark, sf), EVENTS_AS_OF, 14, max_queries=1000, max_hours=40.0)
    return cap.savings_estimates(s, c)


@register("workload_isolation", "query_history", op="CAP-14", sql="""
WITH pairs AS (SELECT warehouse_name, database_name, count(*) AS n FROM query_history
               WHERE start_time >= TIMESTAMP '2024-01-01 00:00:00' AND warehouse_name IS NOT NULL AND database_name IS NOT NULL GROUP BY 1, 2),
pdb AS (SELECT database_name, count(*) AS wh_per_db FROM pairs GROUP BY 1),
g AS (SELECT warehouse_name, count(*) AS databases, CAST(sum(n) AS BIGINT) AS query_count, max(wh_per_db) AS max_warehouses_per_database
      FROM pairs JOIN pdb USING (database_name) GROUP BY 1)
SELECT *, CASE WHEN databases >= 5 THEN 'Split: mixed workload'
               WHEN max_warehouses_per_database >= 5 THEN 'Review: database spread over many warehouses' ELSE 'Isolated' END AS decision
FROM g
""")
def _(spark, sf):
    return cap.workload_isolation(_q(spark, sf), EVENTS_AS_OF, 30)


@register("isolation_decisions", "query_history", op="CAP-14", sql=f"""
WITH p AS (SELECT database_name, warehouse_name, count(*) AS query_count, count(DISTINCT user_name) AS users, count(DISTINCT role_name) AS roles,
                  count_if({FAILED}) AS failed_queries, round(avg(total_elapsed_time) / 1000.0, 2) AS avg_elapsed_sec,
                  round(quantile_cont(total_elapsed_time, 0.95) / 1000.0, 2) AS p95_elapsed_sec, round(sum(queued_overload_time) / 1000.0, 2) AS queued_sec,
                  round(sum(bytes_spilled_to_remote_storage) / {GB}, 2) AS remote_spill_gb, round(sum(bytes_scanned) / {GB}, 2) AS gb_scanned,
                  max(start_time) AS last_seen
           FROM query_history WHERE start_time >= TIMESTAMP '2024-01-01 00:00:00' AND start_time < TIMESTAMP '2024-01-31 00:00:00'
             AND warehouse_name IS NOT NULL AND database_name IS NOT NULL GROUP BY 1, 2),
w AS (SELECT *, count(*) OVER (PARTITION BY database_name) AS database_warehouses, count(*) OVER (PARTITION BY warehouse_name) AS warehouse_databases FROM p),
s AS (SELECT *, concat_ws(', ', CASE WHEN warehouse_databases >= 4 THEN 'warehouse serves many databases' END,
                          CASE WHEN database_warehouses >= 3 THEN 'database spans many warehouses' END, CASE WHEN queued_sec > 60 THEN 'queue pressure' END,
                          CASE WHEN remote_spill_gb > 1 THEN 'remote spill' END, CASE WHEN failed_queries > 0 THEN 'query failures' END) AS signals,
             CASE WHEN queued_sec > 300 OR (warehouse_databases >= 5 AND (remote_spill_gb > 5 OR failed_queries >= 10)) THEN 'Isolate'
                  WHEN warehouse_databases >= 4 AND (queued_sec > 60 OR remote_spill_gb > 1) THEN 'Isolate'
                  WHEN database_warehouses >= 3 THEN 'Standardize'
                  WHEN queued_sec > 60 OR remote_spill_gb > 1 OR failed_queries > 0 THEN 'Tune' ELSE 'Keep' END AS isolation_decision FROM w)
SELECT * EXCLUDE (signals), CASE isolation_decision WHEN 'Isolate' THEN 'High' WHEN 'Keep' THEN 'Low' ELSE 'Medium' END AS severity,
       CASE WHEN signals = '' THEN 'No material isolation signal' ELSE signals END AS finding
FROM s
""")
def _(spark, sf):
    return cap.isolation_decisions(_q(spark, sf), EVENTS_AS_OF, 30)


@register("clustering_review", "table_storage", op="CAP-15", sql=f"""
SELECT table_catalog, table_schema, table_name, round(active_bytes / {GB}, 2) AS active_gb, clustering_key,
       CASE WHEN clustering_key IS NULL AND active_bytes / {GB} >= 100 THEN 'Consider clustering key'
            WHEN clustering_key IS NULL THEN 'Monitor pruning' ELSE 'Clustered: check depth' END AS advice
FROM table_storage WHERE active_bytes / {GB} >= 1.0
""")
def _(spark, sf):
    return cap.clustering_review(tv.load(spark, sf, "table_storage"), 1.0)


@register("cache_reuse", "query_history", op="CAP-16", sql="""
WITH ph AS (SELECT warehouse_name, query_hash, count(*) AS n, sum(percentage_scanned_from_cache * bytes_scanned) AS cb,
                   sum(bytes_scanned) AS b
            FROM query_history WHERE start_time >= TIMESTAMP '2024-01-24 00:00:00' AND warehouse_name IS NOT NULL GROUP BY 1, 2),
g AS (SELECT warehouse_name, sum(n) AS query_count, count(DISTINCT query_hash) AS distinct_statements,
             sum(n - 1) AS repeated_queries, sum(cb) AS cb, sum(b) AS b FROM ph GROUP BY 1)
SELECT warehouse_name, CAST(query_count AS BIGINT) AS query_count, distinct_statements, CAST(repeated_queries AS BIGINT) AS repeated_queries,
       round(repeated_queries * 100 / nullif(query_count, 0), 2) AS repeat_ratio_pct, round(cb / nullif(b, 0), 2) AS weighted_cache_pct
FROM g
""")
def _(spark, sf):
    return cap.cache_reuse(_q(spark, sf), EVENTS_AS_OF, 7)


@register("cache_decisions", "query_history", "warehouses", op="CAP-16", sql=f"""
WITH g AS (SELECT warehouse_name, coalesce(database_name, 'NO_DATABASE') AS top_database, count(*) AS query_count,
                  count(DISTINCT coalesce(query_hash, query_text)) AS query_families, round(sum(bytes_scanned) / {GB}, 2) AS gb_scanned,
                  round(sum(bytes_scanned * percentage_scanned_from_cache) / nullif(sum(bytes_scanned), 0), 2) AS warehouse_cache_pct,
                  round(avg(total_elapsed_time) / 1000.0, 2) AS avg_elapsed_sec, max(start_time) AS last_seen
           FROM query_history WHERE start_time >= TIMESTAMP '2024-01-24 00:00:00' AND start_time < TIMESTAMP '2024-01-31 00:00:00'
             AND warehouse_name IS NOT NULL AND bytes_scanned > 0 GROUP BY 1, 2),
r AS (SELECT g.*, w.auto_suspend, greatest(query_count - greatest(query_families, 1), 0) AS repeated_queries
      FROM g LEFT JOIN warehouses w ON g.warehouse_name = w.warehouse_name),
d AS (SELECT *, round(repeated_queries * 100.0 / query_count, 2) AS repeat_ratio_pct,
             CASE WHEN coalesce(warehouse_cache_pct, 0) < 20 AND repeated_queries / query_count >= 0.35
                       AND coalesce(auto_suspend, 0) <> 0 AND auto_suspend <= 60 THEN 'Cache-hostile suspend'
                  WHEN coalesce(warehouse_cache_pct, 0) < 20 AND repeated_queries / query_count >= 0.35 THEN 'Poor cache reuse'
                  WHEN coalesce(warehouse_cache_pct, 0) < 10 AND gb_scanned > 100 THEN 'Scan-heavy no-cache workload'
                  ELSE 'Cache acceptable' END AS cache_decision FROM r)
SELECT *, CASE cache_decision WHEN 'Cache-hostile suspend' THEN 'High' WHEN 'Cache acceptable' THEN 'Low' ELSE 'Medium' END AS severity FROM d
""")
def _(spark, sf):
    return cap.cache_decisions(_q(spark, sf), tv.load(spark, sf, "warehouses"), EVENTS_AS_OF, 7)


@register("post_change_evidence", "query_history", "warehouse_metering", op="CAP-17", sql="""
WITH q AS (SELECT warehouse_name,
                  count_if(start_time < TIMESTAMP '2024-01-15 00:00:00') AS queries_before,
                  count_if(start_time >= TIMESTAMP '2024-01-15 00:00:00') AS queries_after,
                  round(avg(CASE WHEN start_time < TIMESTAMP '2024-01-15 00:00:00' THEN total_elapsed_time / 1000.0 END), 2) AS avg_sec_before,
                  round(avg(CASE WHEN start_time >= TIMESTAMP '2024-01-15 00:00:00' THEN total_elapsed_time / 1000.0 END), 2) AS avg_sec_after
           FROM query_history WHERE start_time >= TIMESTAMP '2024-01-08 00:00:00' AND start_time < TIMESTAMP '2024-01-22 00:00:00'
             AND warehouse_name IS NOT NULL GROUP BY 1),
m AS (SELECT warehouse_name,
             round(sum(CASE WHEN start_time < TIMESTAMP '2024-01-15 00:00:00' THEN credits_used ELSE 0 END), 4) AS credits_before,
             round(sum(CASE WHEN start_time >= TIMESTAMP '2024-01-15 00:00:00' THEN credits_used ELSE 0 END), 4) AS credits_after
      FROM warehouse_metering WHERE start_time >= TIMESTAMP '2024-01-08 00:00:00' AND start_time < TIMESTAMP '2024-01-22 00:00:00' GROUP BY 1)
SELECT coalesce(q.warehouse_name, m.warehouse_name) AS warehouse_name, queries_before, queries_after, avg_sec_before, avg_sec_after,
       credits_before, credits_after,
       CASE WHEN credits_after < credits_before * 0.9 THEN 'Improved' WHEN credits_after > credits_before * 1.1 THEN 'Regressed'
            ELSE 'Unchanged' END AS verdict
FROM q FULL OUTER JOIN m ON q.warehouse_name = m.warehouse_name
""")
def _(spark, sf):
    return cap.post_change_evidence(_q(spark, sf), _m(spark, sf), datetime(2024, 1, 15), 7)


# ------------------------------------------------------------------ QRY

@register("bottlenecks", "query_history", op="QRY-1", sql=f"""
SELECT query_id, start_time, user_name, warehouse_name, warehouse_size, database_name, query_type, execution_status,
       round(total_elapsed_time / 1000.0, 2) AS elapsed_sec, round(execution_time / 1000.0, 2) AS exec_sec,
       round({QUEUED} / 1000.0, 2) AS queued_sec, round(bytes_scanned / {GB}, 3) AS gb_scanned,
       round(bytes_spilled_to_remote_storage / {GB}, 3) AS remote_spill_gb, substr(query_text, 1, 200) AS query_preview
FROM query_history WHERE start_time >= TIMESTAMP '2024-01-30 00:00:00' AND start_time < TIMESTAMP '2024-01-31 00:00:00'
  AND warehouse_name IS NOT NULL AND total_elapsed_time >= 60000
ORDER BY elapsed_sec DESC, query_id LIMIT 50
""")
def _(spark, sf):
    return qry.bottlenecks(_q(spark, sf), EVENTS_AS_OF, 24, 60, 50)


_RC = f"""
rc AS (
  SELECT query_id, start_time, user_name, warehouse_name, query_type, round(el, 2) AS elapsed_sec, cause AS root_cause,
         round(CASE WHEN f THEN el WHEN cause = 'Queueing' THEN qs WHEN cause = 'Lock wait' THEN bl WHEN cause = 'Remote spill' THEN rs
                    WHEN cause = 'Local spill' THEN ls WHEN cause = 'Large scan' THEN gb ELSE el END, 3) AS impact_value,
         CASE WHEN cause IN ('Remote spill', 'Local spill', 'Large scan') THEN 'GB' ELSE 'sec' END AS impact_unit,
         CASE WHEN el >= 600 THEN 'Critical' WHEN el >= 120 THEN 'High' WHEN el >= 30 THEN 'Medium' ELSE 'Low' END AS severity
  FROM (SELECT *, CASE WHEN f THEN 'Failure' WHEN qs >= greatest(5.0, el * 0.3) THEN 'Queueing' WHEN bl >= 5 THEN 'Lock wait'
                       WHEN rs > 0 THEN 'Remote spill' WHEN ls >= 1 THEN 'Local spill' WHEN gb >= 10 THEN 'Large scan'
                       ELSE 'Long execution' END AS cause
        FROM (SELECT *, total_elapsed_time / 1000.0 AS el, {QUEUED} / 1000.0 AS qs, coalesce(transaction_blocked_time, 0) / 1000.0 AS bl,
                     coalesce(bytes_spilled_to_remote_storage, 0) / {GB} AS rs, coalesce(bytes_spilled_to_local_storage, 0) / {GB} AS ls,
                     coalesce(bytes_scanned, 0) / {GB} AS gb, {FAILED} AS f
              FROM query_history WHERE start_time >= TIMESTAMP '2024-01-24 00:00:00' AND warehouse_name IS NOT NULL) a
        WHERE f OR el >= 30) b)
"""


@register("root_cause", "query_history", op="QRY-2", sql="WITH " + _RC + "SELECT * FROM rc ORDER BY elapsed_sec DESC, query_id LIMIT 100")
def _(spark, sf):
    return qry.root_cause(_q(spark, sf), EVENTS_AS_OF, 7, 100)


@register("root_cause_summary", "query_history", op="QRY-2", sql="WITH " + _RC + """
SELECT root_cause, count(*) AS queries, round(sum(elapsed_sec), 2) AS total_elapsed_sec,
       count_if(severity IN ('Critical', 'High')) AS high_or_critical FROM rc GROUP BY 1
""")
def _(spark, sf):
    return qry.root_cause_summary(qry.root_cause(_q(spark, sf), EVENTS_AS_OF, 7, None))


@register("diagnosis_by_queue", "query_history", op="QRY-3", sql=f"""
SELECT query_id, start_time, user_name, warehouse_name, query_type, round({QUEUED} / 1000.0, 3) AS metric_value
FROM query_history WHERE start_time >= TIMESTAMP '2024-01-30 00:00:00' AND round({QUEUED} / 1000.0, 3) > 0
ORDER BY metric_value DESC, query_id LIMIT 25
""")
def _(spark, sf):
    return qry.diagnosis(_q(spark, sf), EVENTS_AS_OF, "queue", 1, 25)


@register("duplicate_queries", "query_history", op="QRY-4", sql="""
SELECT substr(min(query_text), 1, 200) AS query_sig, count(DISTINCT user_name) AS user_count, count(*) AS execution_count,
       round(sum(total_elapsed_time) / count(*) / 1000.0, 3) AS avg_elapsed_sec, round(sum(total_elapsed_time) / 1000.0, 3) AS total_wasted_sec
FROM query_history WHERE start_time >= TIMESTAMP '2024-01-24 00:00:00' AND upper(execution_status) = 'SUCCESS' AND warehouse_name IS NOT NULL
GROUP BY query_text HAVING count(*) >= 5
""")
def _(spark, sf):
    return qry.duplicate_queries(_q(spark, sf), EVENTS_AS_OF, 7, 5)


@register("failed_sample", "query_history", op="QRY-5", sql=f"""
SELECT query_id, start_time, user_name, warehouse_name, database_name, query_type, error_code, substr(error_message, 1, 200) AS error_message
FROM query_history WHERE start_time >= TIMESTAMP '2024-01-30 00:00:00' AND start_time < TIMESTAMP '2024-01-31 00:00:00'
  AND warehouse_name IS NOT NULL AND {FAILED}

""")
def _(spark, sf):
    return qry.failed_sample(_q(spark, sf), EVENTS_AS_OF, 24)


@register("failure_groups", "query_history", op="QRY-5", sql=f"""
SELECT query_type, error_code, count(*) AS failures, count(DISTINCT user_name) AS users, max(start_time) AS last_failure
FROM query_history WHERE start_time >= TIMESTAMP '2024-01-24 00:00:00' AND start_time < TIMESTAMP '2024-01-31 00:00:00'
  AND warehouse_name IS NOT NULL AND {FAILED}
GROUP BY 1, 2
""")
def _(spark, sf):
    return qry.failure_groups(_q(spark, sf), EVENTS_AS_OF, 168)


@register("operations_summary", "query_history", op="QRY-7", sql=f"""
SELECT count(*) AS total_queries, CAST(coalesce(sum(CAST({FAILED} AS INTEGER)), 0) AS BIGINT) AS failed_queries,
       CAST(coalesce(sum(CAST({QUEUED} > 0 AS INTEGER)), 0) AS BIGINT) AS queued_queries,
       CAST(coalesce(sum(CAST(coalesce(bytes_spilled_to_remote_storage, 0) > 0 AS INTEGER)), 0) AS BIGINT) AS remote_spill_queries,
       coalesce(round(avg(coalesce(total_elapsed_time, 0)) / 1000.0, 2), 0.0) AS avg_elapsed_sec,
       coalesce(round(quantile_cont(coalesce(total_elapsed_time, 0) / 1000.0, 0.95), 2), 0.0) AS p95_elapsed_sec,
       count(DISTINCT warehouse_name) AS active_warehouses, count(DISTINCT user_name) AS active_users
FROM query_history WHERE start_time >= TIMESTAMP '2024-01-30 00:00:00' AND start_time < TIMESTAMP '2024-01-31 00:00:00'
  AND warehouse_name IS NOT NULL
""")
def _(spark, sf):
    return qry.operations_summary(_q(spark, sf), EVENTS_AS_OF, 24)


@register("what_changed", "query_history", "warehouse_metering", op="QRY-8", sql=f"""
WITH q AS (SELECT count_if(start_time >= TIMESTAMP '2024-01-30 00:00:00') AS queries_now,
                  count_if(start_time < TIMESTAMP '2024-01-30 00:00:00') AS queries_before,
                  count_if(start_time >= TIMESTAMP '2024-01-30 00:00:00' AND {FAILED}) AS failures_now,
                  count_if(start_time < TIMESTAMP '2024-01-30 00:00:00' AND {FAILED}) AS failures_before
           FROM query_history WHERE start_time >= TIMESTAMP '2024-01-29 00:00:00' AND start_time < TIMESTAMP '2024-01-31 00:00:00'),
m AS (SELECT coalesce(round(sum(CASE WHEN start_time >= TIMESTAMP '2024-01-30 00:00:00' THEN credits_used END), 4), 0.0) AS credits_now,
             coalesce(round(sum(CASE WHEN start_time < TIMESTAMP '2024-01-30 00:00:00' THEN credits_used END), 4), 0.0) AS credits_before
      FROM warehouse_metering WHERE start_time >= TIMESTAMP '2024-01-29 00:00:00' AND start_time < TIMESTAMP '2024-01-31 00:00:00')
SELECT *, queries_now - queries_before AS query_delta, failures_now - failures_before AS failure_delta,
       round(credits_now - credits_before, 4) AS credit_delta
FROM q, m
""")
def _(spark, sf):
    return qry.what_changed(_q(spark, sf), _m(spark, sf), EVENTS_AS_OF, 24)


@register("lock_waits", "query_history", op="QRY-10", sql="""
SELECT query_id, start_time, user_name, warehouse_name, query_type, round(transaction_blocked_time / 1000.0, 2) AS blocked_sec
FROM query_history WHERE start_time >= TIMESTAMP '2024-01-30 00:00:00' AND start_time < TIMESTAMP '2024-01-31 00:00:00'
  AND warehouse_name IS NOT NULL AND transaction_blocked_time > 5000

""")
def _(spark, sf):
    return qry.lock_waits(_q(spark, sf), EVENTS_AS_OF, 24, 5)


@register("status_timeline", "query_history", op="QRY-11", sql="""
SELECT date_trunc('hour', start_time) AS hour_start, execution_status, count(*) AS query_count
FROM query_history WHERE start_time >= TIMESTAMP '2024-01-30 00:00:00' AND start_time < TIMESTAMP '2024-01-31 00:00:00'
  AND warehouse_name IS NOT NULL GROUP BY 1, 2
""")
def _(spark, sf):
    return qry.status_timeline(_q(spark, sf), EVENTS_AS_OF, 24)


@register("warehouse_drilldown", "query_history", op="QRY-12", sql="""
SELECT query_id, start_time, user_name, warehouse_name, database_name, query_type, execution_status,
       round(total_elapsed_time / 1000.0, 2) AS elapsed_sec
FROM query_history WHERE start_time >= TIMESTAMP '2024-01-24 00:00:00' AND warehouse_name = 'WH_3'

""")
def _(spark, sf):
    return qry.entity_drilldown(_q(spark, sf), EVENTS_AS_OF, "warehouse_name", "WH_3", 7)


@register("history_search", "query_history", op="QRY-13", sql="""
SELECT query_id, start_time, user_name, warehouse_name, query_type, execution_status, substr(query_text, 1, 200) AS query_preview
FROM query_history WHERE start_time >= TIMESTAMP '2024-01-24 00:00:00' AND contains(lower(query_text), 'grant role')

""")
def _(spark, sf):
    return qry.search_history(_q(spark, sf), EVENTS_AS_OF, "GRANT ROLE", "contains", 7)


@register("history_search_prefix", "query_history", op="FIL-11", sql="""
SELECT query_id, start_time, user_name, warehouse_name, query_type, execution_status, substr(query_text, 1, 200) AS query_preview
FROM query_history WHERE start_time >= TIMESTAMP '2024-01-24 00:00:00' AND start_time < TIMESTAMP '2024-01-31 00:00:00'
  AND query_text ILIKE 'grant select%'
""")
def _(spark, sf):
    return qry.search_history(_q(spark, sf), EVENTS_AS_OF, "Grant Select", "prefix", 7)
