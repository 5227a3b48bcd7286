"""Load freshness, pipes and data quality (PIP-*, DQ-*)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opslens.functions.exprs import page, rounded
from opslens.functions.timeutil import boundaries, lookback, ts_lit

GB = 1024.0 ** 3
TABLE_KEY = ["database_name", "schema_name", "table_name"]


def _loads(copy_history: DataFrame) -> DataFrame:
    return copy_history.select(F.col("table_catalog_name").alias("database_name"),
                               F.col("table_schema_name").alias("schema_name"), "*")


def pipeline_status(tasks: DataFrame, loads: DataFrame, as_of: datetime, days: int = 3) -> DataFrame:
    """PIP-1: the latest run of every task and the latest load of every pipe,
    as one list with minutes since the last run and a freshness class. Latest
    per key is a max-struct aggregate (no per-key window)."""
    days = max(1, int(days or 3))
    t = (tasks.filter(lookback("scheduled_time", as_of, days))
         .groupBy("database_name", "schema_name", F.col("name").alias("pipeline_name"))
         .agg(F.max(F.struct("scheduled_time", "completed_time", "state")).alias("l"))
         .select("database_name", "schema_name", "pipeline_name", F.lit("TASK").alias("pipeline_type"),
                 F.col("l.state").alias("state"), F.col("l.scheduled_time").alias("last_run_time"),
                 F.col("l.completed_time").alias("completed_time"),
                 boundaries("MINUTE", F.col("l.scheduled_time"), F.coalesce(F.col("l.completed_time"), ts_lit(as_of)))
                 .alias("duration_min")))
    p = (_loads(loads).filter(F.col("pipe_name").isNotNull() & lookback("last_load_time", as_of, days))
         .groupBy("database_name", "schema_name", F.col("pipe_name").alias("pipeline_name"))
         .agg(F.max("last_load_time").alias("t"))
         .select("database_name", "schema_name", "pipeline_name", F.lit("PIPE").alias("pipeline_type"),
                 F.lit("LOADED").alias("state"), F.col("t").alias("last_run_time"), F.col("t").alias("completed_time"),
                 F.lit(0).cast("bigint").alias("duration_min")))
    u = t.unionByName(p)
    last = F.coalesce("completed_time", "last_run_time")
    hrs = boundaries("HOUR", last, ts_lit(as_of))
    status = (F.when(F.col("state") == "FAILED", "Failed").when(hrs > 24, "Critical").when(hrs > 6, "Stale")
              .when(F.col("state").isin("SUCCEEDED", "LOADED"), "Fresh").otherwise("Unknown"))
    return u.withColumn("minutes_since_last", boundaries("MINUTE", last, ts_lit(as_of))).withColumn("freshness_status", status)


def pipe_volume(loads: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """PIP-2: per pipe and day: files, GB, rows and load events."""
    return (_loads(loads).filter(F.col("pipe_name").isNotNull() & lookback("last_load_time", as_of, days))
            .groupBy("database_name", "schema_name", "pipe_name", F.to_date("last_load_time").alias("load_date"))
            .agg(F.count_if(F.col("status") == "LOADED").alias("files_loaded"),
                 rounded(F.sum("file_size") / GB, 6).alias("gb_loaded"), F.sum("row_count").alias("rows_loaded"),
                 F.count(F.lit(1)).alias("load_events")))


def pipeline_summary(status: DataFrame) -> DataFrame:
    """PIP-3 / AGG-18: counts by freshness class and the overall state."""
    u = F.upper("freshness_status")
    one = status.agg(F.count(F.lit(1)).alias("total_pipelines"), F.count_if(u == "FRESH").alias("fresh"),
                     F.count_if(u == "STALE").alias("stale"), F.count_if(u == "FAILED").alias("failed"),
                     F.count_if(u == "CRITICAL").alias("critical"))
    st = (F.when((F.col("failed") > 0) | (F.col("critical") > 0), "critical").when(F.col("stale") > 3, "warning")
          .when(F.col("stale") > 0, "watch").otherwise("healthy"))
    return one.select("*", F.when(F.col("total_pipelines") > 0,
                                  rounded(F.col("fresh") * 100.0 / F.col("total_pipelines"), 1)).otherwise(0.0)
                      .alias("freshness_pct"),
                      F.when(F.col("total_pipelines") == 0, "unknown").otherwise(st).alias("status"))


def stale_tables(loads: DataFrame, as_of: datetime, stale_hours: int = 24, days: int = 30) -> DataFrame:
    """PIP-4: tables whose latest successful load is older than ``stale_hours``."""
    l = (_loads(loads).filter(lookback("last_load_time", as_of, days) & (F.col("status") == "LOADED"))
         .groupBy(*TABLE_KEY).agg(F.max("last_load_time").alias("last_load_time")))
    h = boundaries("HOUR", "last_load_time", ts_lit(as_of))
    return l.withColumn("hours_since_load", h).filter(h > stale_hours)


def load_failures(loads: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """PIP-5: loads by table and status with files, rows, errors and the
    latest error text."""
    return (_loads(loads).filter(lookback("last_load_time", as_of, days) & (F.col("status") != "LOADED"))
            .groupBy(*TABLE_KEY, "status")
            .agg(F.count(F.lit(1)).alias("file_count"), F.sum("row_count").alias("row_count"),
                 F.sum("error_count").alias("error_count"), F.max("last_load_time").alias("last_seen"),
                 F.max(F.struct("last_load_time", "first_error_message")).getField("first_error_message")
                 .alias("latest_error")))


def large_table_watch(tables: DataFrame, min_gb: float = 1.0, limit: int | None = None) -> DataFrame:
    """PIP-6: large tables with the reason they are watched."""
    act = F.col("active_bytes") / GB
    tt = F.col("time_travel_bytes") / GB
    fs = F.col("failsafe_bytes") / GB
    cl = F.col("retained_for_clone_bytes") / GB
    reason = (F.when(cl > act * 0.2, "Clone retention").when(tt > act * 0.5, "Time travel heavy")
              .when(fs > act * 0.5, "Fail-safe heavy").otherwise("Large active size"))
    return (tables.filter(act >= min_gb)
            .select(F.col("table_catalog").alias("database_name"), F.col("table_schema").alias("schema_name"),
                    "table_name", rounded(act, 2).alias("active_gb"), rounded(tt, 2).alias("time_travel_gb"),
                    rounded(fs, 2).alias("failsafe_gb"), rounded(cl, 2).alias("clone_gb"), reason.alias("reason"))
            .transform(page(limit, F.desc("active_gb"), "database_name", "schema_name", "table_name")))


def load_counters(loads: DataFrame, as_of: datetime, days: int = 1) -> DataFrame:
    """PIP-7: one row: load events, failed, rows and GB (zeros when empty)."""
    l = loads.filter(lookback("last_load_time", as_of, days) & (F.col("last_load_time") < ts_lit(as_of)))
    return l.agg(F.count(F.lit(1)).alias("load_events"),
                 F.count_if(F.col("status") != "LOADED").alias("failed_loads"),
                 F.coalesce(F.sum("row_count"), F.lit(0)).alias("rows_loaded"),
                 F.coalesce(rounded(F.sum("file_size") / GB, 6), F.lit(0.0)).alias("gb_loaded"))


def load_freshness(loads: DataFrame, tables: DataFrame, as_of: datetime, days: int = 7, stale_hours: int = 24,
                   limit: int | None = None) -> DataFrame:
    """DQ-1: tables with rows but no load within ``stale_hours`` (or none at
    all in the window), Critical beyond 3x."""
    days, sh = max(1, int(days or 7)), max(1, int(stale_hours or 24))
    rl = (_loads(loads).filter(lookback("last_load_time", as_of, days)).groupBy(*TABLE_KEY)
          .agg(F.max("last_load_time").alias("last_load_time"), F.count(F.lit(1)).alias("loads_in_window"),
               F.sum("row_count").alias("total_rows_loaded")))
    tm = tables.select(F.col("table_catalog").alias("database_name"), F.col("table_schema").alias("schema_name"),
                       "table_name", F.col("row_count").alias("current_rows"), "active_bytes").filter(F.col("current_rows") > 0)
    j = tm.join(rl, TABLE_KEY, "left")
    h = boundaries("HOUR", "last_load_time", ts_lit(as_of))
    status = (F.when(F.col("last_load_time").isNull() & (F.col("current_rows") > 1000), "No Recent Load")
              .when(h > sh * 3, "Critical").when(h > sh, "Stale").otherwise("Fresh"))
    order = F.when(status == "Critical", 1).when(status == "No Recent Load", 2).when(status == "Stale", 3).otherwise(4)
    out = (j.filter((F.col("current_rows") > 100) & (F.col("last_load_time").isNull() | (h > sh)))
           .select(*TABLE_KEY, "current_rows", rounded(F.col("active_bytes") / GB, 2).alias("size_gb"), "last_load_time",
                   "loads_in_window", "total_rows_loaded", h.alias("hours_since_load"), status.alias("freshness_status"),
                   order.alias("_o")))
    return out.transform(page(limit, "_o", F.desc("current_rows"), *TABLE_KEY)).drop("_o")


def size_drift(snapshots: DataFrame, limit: int | None = None, min_bytes: int = 1048576) -> DataFrame:
    """DQ-2: the last two size snapshots per table (long format:
    table key, snapshot_at, size), percent change and drift class."""
    w = Window.partitionBy(*TABLE_KEY).orderBy(F.desc("snapshot_at"))
    r = snapshots.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= 2)
    g = (r.groupBy(*TABLE_KEY)
         .agg(F.max(F.when(F.col("_rk") == 1, F.col("size"))).alias("current_size"),
              F.max(F.when(F.col("_rk") == 2, F.col("size"))).alias("previous_size"),
              F.max(F.when(F.col("_rk") == 1, F.col("snapshot_at"))).alias("current_at"),
              F.max(F.when(F.col("_rk") == 2, F.col("snapshot_at"))).alias("previous_at"))
         .filter(F.col("previous_size") > min_bytes))
    pct = rounded((F.col("current_size") - F.col("previous_size")) * 100.0 / F.nullif(F.col("previous_size"), F.lit(0)), 1)
    g = g.withColumn("pct_change", pct)
    drift = (F.when(F.col("pct_change") < -50, "Critical Shrink").when(F.col("pct_change") < -20, "Significant Shrink")
             .when(F.col("pct_change") > 200, "Explosive Growth").when(F.col("pct_change") > 50, "Rapid Growth")
             .otherwise("Normal"))
    return (g.filter(F.abs("pct_change") > 20).withColumn("drift_status", drift)
            .transform(page(limit, F.desc(F.abs("pct_change")), *TABLE_KEY)))


SCHEMA_CHANGE_TYPES = ["ALTER_TABLE", "ALTER_VIEW", "CREATE_TABLE", "CREATE_VIEW", "DROP_TABLE", "DROP_VIEW",
                       "RENAME_TABLE", "RENAME_COLUMN"]


def schema_changes(queries: DataFrame, as_of: datetime, days: int = 7, limit: int | None = None) -> DataFrame:
    """DQ-3: recent successful DDL statements."""
    q = queries.filter(lookback("start_time", as_of, max(1, days)) & F.col("query_type").isin(*SCHEMA_CHANGE_TYPES)
                       & (F.col("execution_status") == "SUCCESS"))
    return (q.select("query_id", "query_type", "user_name", "role_name", "database_name", "schema_name", "start_time",
                     F.substring("query_text", 1, 300).alias("query_preview"))
            .transform(page(limit, F.desc("start_time"), "query_id")))


def quality_summary(freshness: DataFrame, drift: DataFrame, changes: DataFrame) -> DataFrame:
    """DQ-4: one row: stale, critical, drift and schema-change counts and the
    overall status."""
    f = freshness.agg(F.count_if(F.col("freshness_status") == "Stale").alias("stale_tables"),
                      F.count_if(F.col("freshness_status").isin("Critical", "No Recent Load")).alias("critical_tables"))
    d = drift.agg(F.count(F.lit(1)).alias("drift_alerts"))
    c = changes.agg(F.count(F.lit(1)).alias("schema_changes"))
    j = f.crossJoin(d).crossJoin(c)
    st = (F.when(F.col("critical_tables") > 0, "critical")
          .when((F.col("stale_tables") > 0) | (F.col("drift_alerts") > 5), "warning").otherwise("healthy"))
    return j.withColumn("overall_status", st)


def inventory_compare(tables: DataFrame, schema_a: str, schema_b: str) -> DataFrame:
    """DQ-5 / JOI-22: tables of two schemas side by side with the row-count difference."""
    a = tables.filter(F.col("table_schema") == schema_a).groupBy("table_name").agg(F.sum("row_count").alias("rows_a"))
    b = tables.filter(F.col("table_schema") == schema_b).groupBy("table_name").agg(F.sum("row_count").alias("rows_b"))
    j = a.join(b, "table_name", "full")
    state = (F.when(F.col("rows_a").isNull(), f"only in {schema_b}").when(F.col("rows_b").isNull(), f"only in {schema_a}")
             .when(F.col("rows_a") == F.col("rows_b"), "same").otherwise("different"))
    return j.select("table_name", "rows_a", "rows_b",
                    (F.coalesce("rows_a", F.lit(0)) - F.coalesce("rows_b", F.lit(0))).alias("row_difference"),
                    state.alias("state"))


TABLE_REF = r"(?i)(?:FROM|INTO|UPDATE|TABLE)\s+([A-Z0-9_]+\.[A-Z0-9_]+\.[A-Z0-9_]+)"


def unused_tables(tables: DataFrame, queries: DataFrame, as_of: datetime, days: int = 90) -> DataFrame:
    """DQ-6: tables no statement in the window referenced (left-anti join of
    the inventory against the distinct referenced names)."""
    refs = (queries.filter(lookback("start_time", as_of, days))
            .select(F.explode(F.regexp_extract_all("query_text", F.lit(TABLE_REF), 1)).alias("fqn"))
            .select(F.upper("fqn").alias("fqn")).distinct())
    t = tables.select("table_catalog", "table_schema", "table_name", "active_bytes",
                      F.upper(F.concat_ws(".", "table_catalog", "table_schema", "table_name")).alias("fqn"))
    return t.join(refs, "fqn", "left_anti").drop("fqn")


def recently_changed(queries: DataFrame, as_of: datetime, days: int = 7, limit: int | None = None) -> DataFrame:
    """DQ-6: objects touched by DDL in the last days, latest change per object."""
    q = queries.filter(lookback("start_time", as_of, days) & F.col("query_type").isin(*SCHEMA_CHANGE_TYPES))
    obj = F.upper(F.regexp_extract("query_text", TABLE_REF, 1))
    g = (q.filter(obj != "").groupBy(obj.alias("object_name"))
         .agg(F.max("start_time").alias("last_changed"), F.count(F.lit(1)).alias("changes")))
    return g.transform(page(limit, F.desc("last_changed"), "object_name"))

