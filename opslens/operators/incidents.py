"""Incident correlation (ANO-10..ANO-13): what changed around a date."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opslens.functions.exprs import page, rounded, safe_div
from opslens.functions.timeutil import between_ts, seconds_between, ts_lit

# Statement types counted as changes around an incident.
CHANGE_TYPES = ["CREATE_TABLE", "ALTER_TABLE", "DROP_TABLE", "CREATE_VIEW", "ALTER_VIEW", "DROP_VIEW",
                "CREATE_SCHEMA", "ALTER_SCHEMA", "DROP_SCHEMA", "CREATE_DATABASE", "ALTER_DATABASE", "DROP_DATABASE",
                "CREATE_WAREHOUSE", "ALTER_WAREHOUSE", "DROP_WAREHOUSE", "CREATE_TASK", "ALTER_TASK", "DROP_TASK",
                "CREATE_PROCEDURE", "ALTER_PROCEDURE", "DROP_PROCEDURE", "GRANT", "REVOKE"]


def ddl_changes(queries: DataFrame, target: datetime, days: int = 1, limit: int | None = None) -> DataFrame:
    """ANO-10: change statements within +-``days`` of the target date."""
    days = max(1, int(days))
    q = queries.filter(between_ts("start_time", target - timedelta(days=days), target + timedelta(days=days))
                       & F.col("query_type").isin(*CHANGE_TYPES))
    return (q.select("query_id", "query_type", "user_name", "role_name", "database_name", "schema_name", "warehouse_name",
                     "start_time", F.substring("query_text", 1, 200).alias("query_preview"),
                     (F.col("total_elapsed_time") / 1000.0).alias("elapsed_sec"))
            .transform(page(limit, F.desc("start_time"), "query_id")))


def new_workload(queries: DataFrame, target: datetime, days: int = 1, heavy: int = 100, limit: int | None = None) -> DataFrame:
    """ANO-11 / SET-3: users active around the date that were absent in the
    week before (left-anti against the baseline users), or heavy."""
    days = max(1, int(days))
    base = (queries.filter(between_ts("start_time", target - timedelta(days=days + 7), target - timedelta(days=days)))
            .select("user_name").distinct().withColumn("_seen", F.lit(True)))
    inc = (queries.filter(between_ts("start_time", target - timedelta(days=days), target + timedelta(days=days))
                          & F.col("warehouse_name").isNotNull())
           .groupBy("user_name", "warehouse_name")
           .agg(F.count(F.lit(1)).alias("query_count"), rounded(F.sum("total_elapsed_time") / 1000.0, 1).alias("total_sec"),
                F.min("start_time").alias("first_seen")))
    j = inc.join(base, "user_name", "left")
    return (j.filter(F.col("_seen").isNull() | (F.col("query_count") > heavy))
            .select("user_name", "warehouse_name", "query_count", "total_sec", "first_seen",
                    F.when(F.col("_seen").isNull(), "New").otherwise("Existing").alias("user_status"))
            .transform(page(limit, F.desc("total_sec"), "user_name", "warehouse_name")))


def volume_changes(queries: DataFrame, target: datetime, limit: int | None = None) -> DataFrame:
    """ANO-12 / WIN-9: hour-to-hour statement volume change per warehouse
    (lag over each warehouse's hours; hours per warehouse are bounded)."""
    q = queries.filter(between_ts("start_time", target - timedelta(days=3), target + timedelta(days=1))
                       & F.col("warehouse_name").isNotNull())
    h = q.groupBy(F.date_trunc("hour", "start_time").cast("timestamp_ntz").alias("hour_bucket"), "warehouse_name").agg(
        F.count(F.lit(1)).alias("query_count"), (F.sum("total_elapsed_time") / 1000.0).alias("_s"))
    w = Window.partitionBy("warehouse_name").orderBy("hour_bucket")
    prev = F.lag("query_count").over(w)
    out = h.select("hour_bucket", "warehouse_name", "query_count", rounded("_s", 1).alias("total_exec_sec"),
                   prev.alias("prev_hour_count"),
                   rounded(safe_div((F.col("query_count") - prev) * 100.0, prev), 1).alias("pct_change"))
    return out.transform(page(limit, F.desc_nulls_last(F.abs("pct_change")), "hour_bucket", "warehouse_name"))


def incident_correlation(ddl: DataFrame, users: DataFrame, volume: DataFrame, target: datetime) -> DataFrame:
    """ANO-13 / SET-2: one time line of candidate causes with a confidence:
    changes within 6 h of the incident and volume jumps above 100 % are
    High, other changes and new users Medium, the rest Low."""
    t = ts_lit(target)
    near = F.abs(seconds_between("start_time", t)) <= 6 * 3600
    a = ddl.select(F.lit("change").alias("cause_type"), F.col("start_time").alias("event_time"),
                   F.concat_ws(" ", "query_type", "user_name").alias("detail"),
                   F.when(near, "High").otherwise("Medium").alias("confidence"))
    b = users.select(F.lit("workload").alias("cause_type"), F.col("first_seen").alias("event_time"),
                     F.concat_ws(" ", "user_status", "user_name", "warehouse_name").alias("detail"),
                     F.when(F.col("user_status") == "New", "Medium").otherwise("Low").alias("confidence"))
    c = volume.filter(F.col("pct_change").isNotNull()).select(
        F.lit("volume").alias("cause_type"), F.col("hour_bucket").alias("event_time"),
        F.concat_ws(" ", "warehouse_name", F.col("pct_change").cast("string")).alias("detail"),
        F.when(F.col("pct_change") > 100, "High").when(F.col("pct_change") > 50, "Medium").otherwise("Low").alias("confidence"))
    return a.unionByName(b).unionByName(c)
