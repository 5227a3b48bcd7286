"""Registered load-freshness and data-quality queries (PIP-*, DQ-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from opslens.operators import freshness as pip
from opslens.plans.registry import register
from opslens.sources import testviews as tv
from opslens.sources.testviews import EVENTS_AS_OF, LINEITEM_AS_OF, ORDERS_AS_OF

GB = "(1024.0 * 1024 * 1024)"
NOW_O = "TIMESTAMP '2001-08-02 00:00:00'"
NOW_L = "TIMESTAMP '2001-11-05 00:00:00'"

_STATUS = f"""
t AS (SELECT database_name, schema_name, name AS pipeline_name,
             max({{'s': scheduled_time, 'c': completed_time, 'st': state}}) AS l
      FROM task_history WHERE scheduled_time >= TIMESTAMP '2001-07-30 00:00:00' AND scheduled_time < {NOW_O} GROUP BY 1, 2, 3),
p AS (SELECT table_catalog_name AS database_name, table_schema_name AS schema_name, pipe_name AS pipeline_name,
             max(last_load_time) AS lt
      FROM copy_history WHERE pipe_name IS NOT NULL AND last_load_time >= TIMESTAMP '2001-07-30 00:00:00' AND last_load_time < {NOW_O}
      GROUP BY 1, 2, 3),
u AS (SELECT database_name, schema_name, pipeline_name, 'TASK' AS pipeline_type, l.st AS state, l.s AS last_run_time,
             l.c AS completed_time, date_diff('minute', l.s, coalesce(l.c, {NOW_O})) AS duration_min FROM t
      UNION ALL
      SELECT database_name, schema_name, pipeline_name, 'PIPE', 'LOADED', lt, lt, CAST(0 AS BIGINT) FROM p),
st AS (SELECT *, date_diff('minute', coalesce(completed_time, last_run_time), {NOW_O}) AS minutes_since_last,
              CASE WHEN state = 'FAILED' THEN 'Failed'
                   WHEN date_diff('hour', coalesce(completed_time, last_run_time), {NOW_O}) > 24 THEN 'Critical'
                   WHEN date_diff('hour', coalesce(completed_time, last_run_time), {NOW_O}) > 6 THEN 'Stale'
                   WHEN state IN ('SUCCEEDED', 'LOADED') THEN 'Fresh' ELSE 'Unknown' END AS freshness_status FROM u)
"""


def _status(spark, sf):
    return pip.pipeline_status(tv.load(spark, sf, "task_history"), tv.load(spark, sf, "copy_history"), ORDERS_AS_OF, 3)


@register("load_pipe_status", "task_history", "copy_history", op="PIP-1", sql="WITH " + _STATUS + "SELECT * FROM st")
def _(spark, sf):
    return _status(spark, sf)


@register("pipe_volume", "copy_history", op="PIP-2", sql=f"""
SELECT table_catalog_name AS database_name, table_schema_name AS schema_name, pipe_name, CAST(last_load_time AS DATE) AS load_date,
       count_if(status = 'LOADED') AS files_loaded, round(sum(file_size) / {GB}, 6) AS gb_loaded,
       CAST(sum(row_count) AS BIGINT) AS rows_loaded, count(*) AS load_events
FROM copy_history WHERE pipe_name IS NOT NULL AND last_load_time >= TIMESTAMP '2001-10-29 00:00:00' GROUP BY 1, 2, 3, 4
""")
def _(spark, sf):
    return pip.pipe_volume(tv.load(spark, sf, "copy_history"), LINEITEM_AS_OF, 7)


@register("load_pipe_summary", "task_history", "copy_history", op="PIP-3", sql="WITH " + _STATUS + """,
o AS (SELECT count(*) AS total_pipelines, count_if(upper(freshness_status) = 'FRESH') AS fresh,
             count_if(upper(freshness_status) = 'STALE') AS stale, count_if(upper(freshness_status) = 'FAILED') AS failed,
             count_if(upper(freshness_status) = 'CRITICAL') AS critical FROM st)
SELECT *, CASE WHEN total_pipelines > 0 THEN round(fresh * 100.0 / total_pipelines, 1) ELSE 0.0 END AS freshness_pct,
       CASE WHEN total_pipelines = 0 THEN 'unknown' WHEN failed > 0 OR critical > 0 THEN 'critical'
            WHEN stale > 3 THEN 'warning' WHEN stale > 0 THEN 'watch' ELSE 'healthy' END AS status
FROM o
""")
def _(spark, sf):
    return pip.pipeline_summary(_status(spark, sf))


@register("stale_tables", "copy_history", op="PIP-4", sql=f"""
WITH l AS (SELECT table_catalog_name AS database_name, table_schema_name AS schema_name, table_name, max(last_load_time) AS last_load_time
           FROM copy_history WHERE last_load_time >= TIMESTAMP '2001-10-06 00:00:00' AND status = 'LOADED' GROUP BY 1, 2, 3)
SELECT *, date_diff('hour', last_load_time, {NOW_L}) AS hours_since_load FROM l WHERE date_diff('hour', last_load_time, {NOW_L}) > 72
""")
def _(spark, sf):
    return pip.stale_tables(tv.load(spark, sf, "copy_history"), LINEITEM_AS_OF, 72, 30)


@register("load_failures", "copy_history", op="PIP-5", sql="""
SELECT table_catalog_name AS database_name, table_schema_name AS schema_name, table_name, status, count(*) AS file_count,
       CAST(sum(row_count) AS BIGINT) AS row_count, CAST(sum(error_count) AS BIGINT) AS error_count, max(last_load_time) AS last_seen,
       (max({'t': last_load_time, 'e': first_error_message})).e AS latest_error
FROM copy_history WHERE last_load_time >= TIMESTAMP '2001-10-29 00:00:00' AND status <> 'LOADED' GROUP BY 1, 2, 3, 4
""")
def _(spark, sf):
    return pip.load_failures(tv.load(spark, sf, "copy_history"), LINEITEM_AS_OF, 7)


@register("large_table_watch", "table_storage", op="PIP-6", sql=f"""
SELECT table_catalog AS database_name, table_schema AS schema_name, table_name, round(active_bytes / {GB}, 2) AS active_gb,
       round(time_travel_bytes / {GB}, 2) AS time_travel_gb, round(failsafe_bytes / {GB}, 2) AS failsafe_gb,
       round(retained_for_clone_bytes / {GB}, 2) AS clone_gb,
       CASE WHEN retained_for_clone_bytes / {GB} > active_bytes / {GB} * 0.2 THEN 'Clone retention'
            WHEN time_travel_bytes / {GB} > active_bytes / {GB} * 0.5 THEN 'Time travel heavy'
            WHEN failsafe_bytes / {GB} > active_bytes / {GB} * 0.5 THEN 'Fail-safe heavy' ELSE 'Large active size' END AS reason
FROM table_storage WHERE active_bytes / {GB} >= 2.0

""")
def _(spark, sf):
    return pip.large_table_watch(tv.load(spark, sf, "table_storage"), 2.0)


@register("load_counters", "copy_history", op="PIP-7", sql=f"""
SELECT count(*) AS load_events, count_if(status <> 'LOADED') AS failed_loads, CAST(coalesce(sum(row_count), 0) AS BIGINT) AS rows_loaded,
       coalesce(round(sum(file_size) / {GB}, 6), 0.0) AS gb_loaded
FROM copy_history WHERE last_load_time >= TIMESTAMP '2001-11-04 00:00:00' AND last_load_time < {NOW_L}
""")
def _(spark, sf):
    return pip.load_counters(tv.load(spark, sf, "copy_history"), LINEITEM_AS_OF, 1)


_FRESH = f"""
rl AS (SELECT table_catalog_name AS database_name, table_schema_name AS schema_name, table_name, max(last_load_time) AS last_load_time,
              count(*) AS loads_in_window, CAST(sum(row_count) AS BIGINT) AS total_rows_loaded
       FROM copy_history WHERE last_load_time >= TIMESTAMP '2001-10-29 00:00:00' GROUP BY 1, 2, 3),
tm AS (SELECT table_catalog AS database_name, table_schema AS schema_name, table_name, row_count AS current_rows, active_bytes
       FROM table_storage WHERE row_count > 0),
j AS (SELECT tm.*, rl.last_load_time, rl.loads_in_window, rl.total_rows_loaded,
             date_diff('hour', rl.last_load_time, {NOW_L}) AS h
      FROM tm LEFT JOIN rl ON tm.database_name = rl.database_name AND tm.schema_name = rl.schema_name AND tm.table_name = rl.table_name),
k AS (SELECT *, CASE WHEN last_load_time IS NULL AND current_rows > 1000 THEN 'No Recent Load' WHEN h > 72 THEN 'Critical'
                     WHEN h > 24 THEN 'Stale' ELSE 'Fresh' END AS freshness_status FROM j
      WHERE current_rows > 100 AND (last_load_time IS NULL OR h > 24)),
fr AS (SELECT database_name, schema_name, table_name, current_rows, round(active_bytes / {GB}, 2) AS size_gb, last_load_time,
              loads_in_window, total_rows_loaded, h AS hours_since_load, freshness_status
       FROM k ORDER BY CASE freshness_status WHEN 'Critical' THEN 1 WHEN 'No Recent Load' THEN 2 WHEN 'Stale' THEN 3 ELSE 4 END,
                current_rows DESC, 1, 2, 3)
"""


def _fresh(spark, sf):
    return pip.load_freshness(tv.load(spark, sf, "copy_history"), tv.load(spark, sf, "table_storage"), LINEITEM_AS_OF, 7, 24)


@register("load_freshness", "copy_history", "table_storage", op="DQ-1", sql="WITH " + _FRESH + "SELECT * FROM fr")
def _(spark, sf):
    return _fresh(spark, sf)


def _snapshots(spark, sf):
    s = tv.load(spark, sf, "table_snapshots")
    return s.select("database_name", F.lit("SCH_0").alias("schema_name"), "table_name",
                    F.expr("stack(2, TIMESTAMP_NTZ '2001-11-03 00:00:00', rows_1 * 1000, "
                           "TIMESTAMP_NTZ '2001-11-04 00:00:00', rows_2 * 1000) AS (snapshot_at, size)"))


_DRIFT = """
snaps AS (SELECT database_name, 'SCH_0' AS schema_name, table_name, TIMESTAMP '2001-11-03 00:00:00' AS snapshot_at, rows_1 * 1000 AS size
          FROM table_snapshots
          UNION ALL SELECT database_name, 'SCH_0', table_name, TIMESTAMP '2001-11-04 00:00:00', rows_2 * 1000 FROM table_snapshots),
rk AS (SELECT *, row_number() OVER (PARTITION BY database_name, schema_name, table_name ORDER BY snapshot_at DESC) AS r FROM snaps),
g AS (SELECT database_name, schema_name, table_name, max(CASE WHEN r = 1 THEN size END) AS current_size,
             max(CASE WHEN r = 2 THEN size END) AS previous_size, max(CASE WHEN r = 1 THEN snapshot_at END) AS current_at,
             max(CASE WHEN r = 2 THEN snapshot_at END) AS previous_at FROM rk WHERE r <= 2 GROUP BY 1, 2, 3
      HAVING max(CASE WHEN r = 2 THEN size END) > 1048576),
h AS (SELECT *, round((current_size - previous_size) * 100.0 / nullif(previous_size, 0), 1) AS pct_change FROM g),
dr AS (SELECT *, CASE WHEN pct_change < -50 THEN 'Critical Shrink' WHEN pct_change < -20 THEN 'Significant Shrink'
                      WHEN pct_change > 200 THEN 'Explosive Growth' WHEN pct_change > 50 THEN 'Rapid Growth' ELSE 'Normal' END AS drift_status
       FROM h WHERE abs(pct_change) > 20 ORDER BY abs(pct_change) DESC, 1, 2, 3)
"""


@register("size_drift", "table_snapshots", op="DQ-2", sql="WITH " + _DRIFT + "SELECT * FROM dr")
def _(spark, sf):
    return pip.size_drift(_snapshots(spark, sf))


_SCHEMA = """
sc AS (SELECT query_id, query_type, user_name, role_name, database_name, schema_name, start_time, substr(query_text, 1, 300) AS query_preview
       FROM query_history WHERE start_time >= TIMESTAMP '2024-01-24 00:00:00'
         AND query_type IN ('ALTER_TABLE', 'ALTER_VIEW', 'CREATE_TABLE', 'CREATE_VIEW', 'DROP_TABLE', 'DROP_VIEW', 'RENAME_TABLE', 'RENAME_COLUMN')
         AND execution_status = 'SUCCESS')
"""


@register("schema_changes", "query_history", op="DQ-3", sql="WITH " + _SCHEMA + "SELECT * FROM sc")
def _(spark, sf):
    return pip.schema_changes(tv.load(spark, sf, "query_history"), EVENTS_AS_OF, 7)


@register("quality_summary", "copy_history", "table_storage", "table_snapshots", "query_history", op="DQ-4",
          sql="WITH " + _FRESH + "," + _DRIFT + "," + _SCHEMA + """
SELECT (SELECT count_if(freshness_status = 'Stale') FROM fr) AS stale_tables,
       (SELECT count_if(freshness_status IN ('Critical', 'No Recent Load')) FROM fr) AS critical_tables,
       (SELECT count(*) FROM dr) AS drift_alerts, (SELECT count(*) FROM sc) AS schema_changes,
       CASE WHEN (SELECT count_if(freshness_status IN ('Critical', 'No Recent Load')) FROM fr) > 0 THEN 'critical'
            WHEN (SELECT count_if(freshness_status = 'Stale') FROM fr) > 0 OR (SELECT count(*) FROM dr) > 5 THEN 'warning'
            ELSE 'healthy' END AS overall_status
""")
def _(spark, sf):
    return pip.quality_summary(_fresh(spark, sf), pip.size_drift(_snapshots(spark, sf)),
                               pip.schema_changes(tv.load(spark, sf, "query_history"), EVENTS_AS_OF, 7))


@register("inventory_compare", "table_storage", op="DQ-5", sql="""
WITH a AS (SELECT table_name, CAST(sum(row_count) AS BIGINT) AS rows_a FROM table_storage WHERE table_schema = 'SCH_0' GROUP BY 1),
b AS (SELECT table_name, CAST(sum(row_count) AS BIGINT) AS rows_b FROM table_storage WHERE table_schema = 'SCH_1' GROUP BY 1)
SELECT coalesce(a.table_name, b.table_name) AS table_name, rows_a, rows_b, coalesce(rows_a, 0) - coalesce(rows_b, 0) AS row_difference,
       CASE WHEN rows_a IS NULL THEN 'only in SCH_1' WHEN rows_b IS NULL THEN 'only in SCH_0' WHEN rows_a = rows_b THEN 'same'
            ELSE 'different' END AS state
FROM a FULL OUTER JOIN b ON a.table_name = b.table_name
""")
def _(spark, sf):
    return pip.inventory_compare(tv.load(spark, sf, "table_storage"), "SCH_0", "SCH_1")


@register("unused_tables", "table_storage", "query_history", op="DQ-6", sql="""
WITH refs AS (SELECT DISTINCT upper(unnest(regexp_extract_all(query_text, '(?i)(?:FROM|INTO|UPDATE|TABLE)\\s+([A-Z0-9_]+\\.[A-Z0-9_]+\\.[A-Z0-9_]+)', 1))) AS fqn
              FROM query_history WHERE start_time >= TIMESTAMP '2023-11-02 00:00:00')
SELECT table_catalog, table_schema, table_name, active_bytes FROM table_storage
WHERE upper(concat_ws('.', table_catalog, table_schema, table_name)) NOT IN (SELECT fqn FROM refs WHERE fqn IS NOT NULL)
""")
def _(spark, sf):
    return pip.unused_tables(tv.load(spark, sf, "table_storage"), tv.load(spark, sf, "query_history"), EVENTS_AS_OF, 90)


@register("recently_changed_objects", "query_history", op="DQ-6", sql="""
WITH q AS (SELECT start_time, upper(regexp_extract(query_text, '(?i)(?:FROM|INTO|UPDATE|TABLE)\\s+([A-Z0-9_]+\\.[A-Z0-9_]+\\.[A-Z0-9_]+)', 1)) AS o
           FROM query_history WHERE start_time >= TIMESTAMP '2024-01-24 00:00:00'
             AND query_type IN ('ALTER_TABLE', 'ALTER_VIEW', 'CREATE_TABLE', 'CREATE_VIEW', 'DROP_TABLE', 'DROP_VIEW', 'RENAME_TABLE', 'RENAME_COLUMN'))
SELECT o AS object_name, max(start_time) AS last_changed, count(*) AS changes FROM q WHERE o <> '' GROUP BY 1

""")
def _(spark, sf):
    return pip.recently_changed(tv.load(spark, sf, "query_history"), EVENTS_AS_OF, 7)

