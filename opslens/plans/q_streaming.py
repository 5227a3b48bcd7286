"""Registered streaming queries: each replays data derived from the driver
tables as a parquet file stream (several micro-batches, ``availableNow``),
merges every micro-batch into a partitioned summary (UPS-1) and returns the
summary; the oracle is the batch aggregate over the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from opslens.functions.exprs import rounded
from opslens.plans.registry import register
from opslens.sources import testviews as tv
from opslens.streaming import incremental as inc


def _event_metering(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select(F.col("ts").alias("start_time"),
                    F.concat(F.lit("WH_"), ((F.col("user_id") + F.col("event_id")) % 10).cast("string")).alias("warehouse_name"),
                    (F.col("value") / 100).alias("credits_used"), (F.col("value") / 100).alias("credits_used_compute"))


@register("stream_hourly_credits", op="STR-1", sql="""
SELECT date_trunc('hour', ts) AS hour_start, 'WH_' || CAST((user_id + event_id) % 10 AS VARCHAR) AS warehouse_name,
       round(sum(value / 100), 6) AS credits_used, round(sum(value / 100), 6) AS credits_compute, count(*) AS metering_rows,
       CAST(ts AS DATE) AS usage_date
FROM events GROUP BY 1, 2, 6
""")
def _(spark, sf):
    src_df = _event_metering(spark, sf)
    src, run = inc.stage_as_files(src_df, "hourly-credits", files=4, order_col="start_time")
    stream = inc.file_stream(spark, src, src_df.schema)
    agg = inc.hourly_credits_stream(stream).withColumn("usage_date", F.to_date("hour_start"))
    out = inc.run_available_now(agg, run, ["hour_start", "warehouse_name"], "usage_date")
    return out.select("hour_start", "warehouse_name", rounded("credits_used", 6).alias("credits_used"),
                      rounded("credits_compute", 6).alias("credits_compute"), "metering_rows", "usage_date")


@register("stream_daily_task_states", "task_history", op="STR-2", sql="""
SELECT CAST(scheduled_time AS DATE) AS run_date, state, count(*) AS runs FROM task_history GROUP BY 1, 2
""")
def _(spark, sf):
    src_df = tv.load(spark, sf, "task_history").select("scheduled_time", "state", "database_name", "schema_name", "name")
    src, run = inc.stage_as_files(src_df, "task-states", files=4, order_col="scheduled_time")
    stream = inc.file_stream(spark, src, src_df.schema)
    agg = inc.daily_task_states_stream(stream)
    # seven years of days: partition the summary by month, not by day
    agg = agg.withColumn("run_month", F.trunc("run_date", "month"))
    return inc.run_available_now(agg, run, ["run_date", "state"], "run_month").drop("run_month")


@register("stream_failure_bursts", "task_history", op="STR-3", sql="""
SELECT CAST(scheduled_time AS DATE) AS failure_date, database_name, schema_name, name AS task_name, count(*) AS failure_count
FROM task_history WHERE state = 'FAILED' GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2
""")
def _(spark, sf):
    src_df = tv.load(spark, sf, "task_history").select("scheduled_time", "state", "database_name", "schema_name", "name")
    src, run = inc.stage_as_files(src_df, "failure-bursts", files=4, order_col="scheduled_time")
    stream = inc.file_stream(spark, src, src_df.schema)
    agg = inc.failure_bursts_stream(stream, threshold=2).withColumn(
        "failure_month", F.trunc("failure_date", "month"))
    return inc.run_available_now(agg, run, ["failure_date", "database_name", "schema_name", "task_name"],
                                 "failure_month").drop("failure_month")


@register("stream_recovery_pairing", "task_history", op="STR-6", sql="""
WITH f AS (SELECT database_name, schema_name, name AS task_name, max(scheduled_time) AS failure_at FROM task_history WHERE state = 'FAILED' GROUP BY ALL),
r AS (SELECT f.*, (SELECT min(t.scheduled_time) FROM task_history t WHERE t.state = 'SUCCEEDED' AND t.database_name = f.database_name
                   AND t.schema_name = f.schema_name AND t.name = f.task_name AND t.scheduled_time > f.failure_at) AS recovery_at FROM f)
SELECT *, CASE WHEN recovery_at IS NULL THEN 'Open Failure' WHEN date_diff('second', failure_at, recovery_at) > 4 * 3600 THEN 'Recovered Late'
               ELSE 'Recovered Within SLA' END AS recovery_state FROM r
""")
def _(spark, sf):
    src_df = tv.load(spark, sf, "task_history").select("scheduled_time", "state", "database_name", "schema_name", "name")
    src, run = inc.stage_as_files(src_df, "recovery", files=4, order_col="scheduled_time")
    out = inc.recovery_summary(spark, src, src_df.schema, run)
    return out.select("database_name", "schema_name", "task_name", F.col("failure_at").cast("timestamp_ntz").alias("failure_at"),
                      F.col("recovery_at").cast("timestamp_ntz").alias("recovery_at"), "recovery_state")


@register("stream_live_operations", "query_history", op="STR-4", sql="""
WITH q AS (SELECT start_time, warehouse_name, queued_overload_time, transaction_blocked_time FROM query_history),
w AS (SELECT q.*, date_trunc('minute', start_time) - to_minutes(CAST(k AS BIGINT)) AS window_start
      FROM q, range(10) t(k))
SELECT window_start, window_start + INTERVAL 10 MINUTE AS window_end, warehouse_name, count(*) AS active,
       count_if(queued_overload_time > 0) AS queued, count_if(transaction_blocked_time > 0) AS blocked,
       CAST(window_start AS DATE) AS window_date
FROM w GROUP BY 1, 2, 3
""")
def _(spark, sf):
    q = tv.load(spark, sf, "query_history").select("start_time", "warehouse_name", "queued_overload_time", "transaction_blocked_time")
    src, run = inc.stage_as_files(q, "live-ops", files=4, order_col="start_time")
    agg = inc.live_operations_stream(inc.file_stream(spark, src, q.schema))
    agg = agg.withColumn("window_date", F.to_date("window_start"))
    return inc.run_available_now(agg, run, ["window_start", "warehouse_name"], "window_date")


@register("stream_activity_sessions", "query_history", op="STR-7", sql="""
WITH q AS (SELECT user_name, start_time, lag(start_time) OVER (PARTITION BY user_name ORDER BY start_time) AS prev FROM query_history),
s AS (SELECT *, sum(CASE WHEN prev IS NULL OR start_time >= prev + INTERVAL 30 MINUTE THEN 1 ELSE 0 END)
                  OVER (PARTITION BY user_name ORDER BY start_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM q)
SELECT user_name, min(start_time) AS session_start, max(start_time) + INTERVAL 30 MINUTE AS session_end, count(*) AS statements,
       CAST(min(start_time) AS DATE) AS session_date
FROM s GROUP BY user_name, sid
""")
def _(spark, sf):
    q = tv.load(spark, sf, "query_history").select("start_time", "user_name")
    src, run = inc.stage_as_files(q, "sessions", files=4, order_col="start_time")
    inc.flush_event(src, spark, q.schema, "start_time", "1 DAY")
    agg = inc.activity_sessions_stream(inc.file_stream(spark, src, q.schema), watermark="2 hours")
    agg = agg.withColumn("session_date", F.to_date("session_start"))
    return inc.run_available_now(agg, run, ["user_name", "session_start"], "session_date", mode="append")
