"""Summary builders (SUM-*): the pre-aggregated grains the other operators
read. Each is one ``groupBy`` over a look-back window, so Spark plans a
partial (map-side) aggregate, one shuffle on the grain keys and a final
aggregate; hot keys are combined before the shuffle."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.functions.exprs import pctl, rounded
from opslens.functions.timeutil import lookback, midnight, trunc


def daily_warehouse_credits(metering: DataFrame, as_of: datetime, days: int = 90,
                            complete_days: bool = True) -> DataFrame:
    """SUM-1: credits per (usage_date, warehouse): total, compute, cloud."""
    end = midnight(as_of) if complete_days else None
    return (metering
            .filter(lookback("start_time", as_of, days, end=end))
            .groupBy(F.to_date("start_time").alias("usage_date"), "warehouse_name")
            .agg(rounded(F.sum(F.coalesce("credits_used", F.lit(0.0))), 4).alias("credits_used"),
                 rounded(F.sum(F.coalesce("credits_used_compute", F.lit(0.0))), 4).alias("credits_compute"),
                 rounded(F.sum(F.coalesce("credits_used_cloud_services", F.lit(0.0))), 4).alias("credits_cloud")))


def hourly_warehouse_credits(metering: DataFrame, as_of: datetime, days: int = 35) -> DataFrame:
    """SUM-2: credits per (hour, warehouse)."""
    return (metering
            .filter(lookback("start_time", as_of, days))
            .groupBy(trunc("hour", "start_time").alias("hour_start"), "warehouse_name")
            .agg(rounded(F.sum("credits_used"), 4).alias("credits_used"),
                 rounded(F.sum("credits_used_compute"), 4).alias("credits_compute"),
                 rounded(F.sum("credits_used_cloud_services"), 4).alias("credits_cloud")))


def daily_task_runs(tasks: DataFrame, as_of: datetime, days: int = 90) -> DataFrame:
    """SUM-3: runs per (date, database, schema, task, state) with mean/max seconds."""
    dur = (F.unix_micros(F.col("completed_time").cast("timestamp"))
           - F.unix_micros(F.col("scheduled_time").cast("timestamp"))) / 1e6
    return (tasks
            .filter(lookback("scheduled_time", as_of, days))
            .groupBy(F.to_date("scheduled_time").alias("run_date"), "database_name", "schema_name",
                     F.col("name").alias("task_name"), "state")
            .agg(F.count(F.lit(1)).alias("run_count"),
                 rounded(F.avg(dur), 2).alias("avg_duration_sec"),
                 rounded(F.max(dur), 2).alias("max_duration_sec")))


def daily_service_credits(service: DataFrame, as_of: datetime, days: int = 90) -> DataFrame:
    """SUM-4: credits per (date, service type)."""
    return (service
            .filter(lookback("start_time", as_of, days))
            .groupBy(F.to_date("start_time").alias("usage_date"), "service_type")
            .agg(rounded(F.sum("credits_used"), 4).alias("credits_used")))


def hourly_query_bottlenecks(queries: DataFrame, as_of: datetime, days: int = 14,
                             exact: bool = True) -> DataFrame:
    """SUM-5: per (hour, warehouse): query count, p95 elapsed seconds, remote
    spill GB, mean queued seconds."""
    return (queries
            .filter(lookback("start_time", as_of, days))
            .groupBy(trunc("hour", "start_time").alias("hour_start"), "warehouse_name")
            .agg(F.count(F.lit(1)).alias("query_count"),
                 rounded(pctl(F.col("total_elapsed_time") / 1000.0, 0.95, exact), 2).alias("p95_elapsed_sec"),
                 rounded(F.sum("bytes_spilled_to_remote_storage") / 1e9, 4).alias("remote_spill_gb"),
                 rounded(F.avg((F.col("queued_overload_time") + F.col("queued_provisioning_time")) / 1000.0), 3)
                 .alias("avg_queued_sec")))


def daily_storage_tb(storage: DataFrame, as_of: datetime, days: int = 90) -> DataFrame:
    """SUM-6: storage per (date, database) in TB."""
    lo = (as_of - timedelta(days=days)).date()
    return (storage
            .filter(F.col("usage_date") >= F.lit(lo))
            .select("usage_date", "database_name",
                    rounded(F.col("average_database_bytes") / 1e12, 6).alias("database_tb"),
                    rounded(F.col("average_failsafe_bytes") / 1e12, 6).alias("failsafe_tb"),
                    rounded((F.col("average_database_bytes") + F.col("average_failsafe_bytes")) / 1e12, 6)
                    .alias("total_tb")))


def daily_task_failures(tasks: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """SUM-7: per (date, task): runs and failures."""
    return (tasks
            .filter(lookback("scheduled_time", as_of, days))
            .groupBy(F.to_date("scheduled_time").alias("run_date"), "database_name", "schema_name",
                     F.col("name").alias("task_name"))
            .agg(F.count(F.lit(1)).alias("run_count"),
                 F.count_if(F.col("state") == "FAILED").alias("failure_count"))
            .filter(F.col("failure_count") > 0))
