"""Registered summary builders (SUM-2..SUM-7)."""

from __future__ import annotations

from opslens.operators import summaries
from opslens.plans.registry import register
from opslens.sources import testviews as tv
from opslens.sources.testviews import EVENTS_AS_OF, LINEITEM_AS_OF, ORDERS_AS_OF


@register("hourly_warehouse_credits", "warehouse_metering", op="SUM-2", sql="""
SELECT date_trunc('hour', start_time) AS hour_start, warehouse_name, round(sum(credits_used), 4) AS credits_used,
       round(sum(credits_used_compute), 4) AS credits_compute, round(sum(credits_used_cloud_services), 4) AS credits_cloud
FROM warehouse_metering WHERE start_time >= TIMESTAMP '2023-12-27 00:00:00' GROUP BY 1, 2
""")
def _(spark, sf):
    return summaries.hourly_warehouse_credits(tv.load(spark, sf, "warehouse_metering"), EVENTS_AS_OF, 35)


@register("daily_task_runs", "task_history", op="SUM-3", sql="""
SELECT CAST(scheduled_time AS DATE) AS run_date, database_name, schema_name, name AS task_name, state, count(*) AS run_count,
       round(avg(date_diff('microsecond', scheduled_time, completed_time) / 1e6), 2) AS avg_duration_sec,
       round(max(date_diff('microsecond', scheduled_time, completed_time) / 1e6), 2) AS max_duration_sec
FROM task_history WHERE scheduled_time >= TIMESTAMP '2001-05-04 00:00:00' GROUP BY 1, 2, 3, 4, 5
""")
def _(spark, sf):
    return summaries.daily_task_runs(tv.load(spark, sf, "task_history"), ORDERS_AS_OF, 90)


@register("daily_service_credits", "service_metering", op="SUM-4", sql="""
SELECT CAST(start_time AS DATE) AS usage_date, service_type, round(sum(credits_used), 4) AS credits_used
FROM service_metering WHERE start_time >= TIMESTAMP '2001-08-07 00:00:00' GROUP BY 1, 2
""")
def _(spark, sf):
    return summaries.daily_service_credits(tv.load(spark, sf, "service_metering"), LINEITEM_AS_OF, 90)


@register("hourly_query_bottlenecks", "query_history", op="SUM-5", sql="""
SELECT date_trunc('hour', start_time) AS hour_start, warehouse_name, count(*) AS query_count,
       round(quantile_cont(total_elapsed_time / 1000.0, 0.95), 2) AS p95_elapsed_sec,
       round(sum(bytes_spilled_to_remote_storage) / 1e9, 4) AS remote_spill_gb,
       round(avg((queued_overload_time + queued_provisioning_time) / 1000.0), 3) AS avg_queued_sec
FROM query_history WHERE start_time >= TIMESTAMP '2024-01-17 00:00:00' GROUP BY 1, 2
""")
def _(spark, sf):
    return summaries.hourly_query_bottlenecks(tv.load(spark, sf, "query_history"), EVENTS_AS_OF, 14)


@register("daily_storage_tb", "database_storage", op="SUM-6", sql="""
SELECT usage_date, database_name, round(average_database_bytes / 1e12, 6) AS database_tb,
       round(average_failsafe_bytes / 1e12, 6) AS failsafe_tb,
       round((average_database_bytes + average_failsafe_bytes) / 1e12, 6) AS total_tb
FROM database_storage WHERE usage_date >= DATE '2001-08-07'
""")
def _(spark, sf):
    return summaries.daily_storage_tb(tv.load(spark, sf, "database_storage"), LINEITEM_AS_OF, 90)


@register("daily_task_failures", "task_history", op="SUM-7", sql="""
SELECT CAST(scheduled_time AS DATE) AS run_date, database_name, schema_name, name AS task_name, count(*) AS run_count,
       count_if(state = 'FAILED') AS failure_count
FROM task_history WHERE scheduled_time >= TIMESTAMP '2001-07-03 00:00:00' GROUP BY 1, 2, 3, 4 HAVING count_if(state = 'FAILED') > 0
""")
def _(spark, sf):
    return summaries.daily_task_failures(tv.load(spark, sf, "task_history"), ORDERS_AS_OF, 30)
