"""Registered source/sink queries (SRC-*): feeds are written from data Spark
derives from the driver tables into the shared checkpoint directory, then
read back through the feed readers."""

from __future__ import annotations

import uuid
from datetime import date, datetime

from pyspark.sql import functions as F

from opslens.functions.exprs import rounded
from opslens.plans import q_alerts
from opslens.plans.registry import register
from opslens.session import ensure_checkpoint_dir
from opslens.sources import feeds, schemas
from opslens.sources import testviews as tv
from opslens.sources.testviews import EVENTS_AS_OF


def _run_dir(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/opslens-feeds/{name}-{uuid.uuid4().hex[:12]}"


@register("ticket_feed_status", "change_tickets", op="SRC-5", sql="""
SELECT ticket_status, count(*) AS tickets, count(DISTINCT ticket_key) AS keys, min(opened_at) AS first_opened
FROM change_tickets GROUP BY 1
""")
def _(spark, sf):
    path = _run_dir(spark, "tickets")
    t = tv.load(spark, sf, "change_tickets").select("ticket_key", F.date_format("opened_at", "yyyy-MM-dd HH:mm:ss").alias("opened_at"),
                                                   "ticket_status")
    feeds.export_csv(t, path)
    back = feeds.read_csv_feed(spark, path, feeds.TICKET_FEED, ["opened_at"])
    return back.groupBy("ticket_status").agg(F.count(F.lit(1)).alias("tickets"), F.countDistinct("ticket_key").alias("keys"),
                                             F.min("opened_at").alias("first_opened"))


@register("commit_feed_daily", "source_commits", op="SRC-4", sql="""
SELECT CAST(committed_at AS DATE) AS commit_date, count(*) AS commits, count(DISTINCT author) AS authors FROM source_commits GROUP BY 1
""")
def _(spark, sf):
    path = _run_dir(spark, "commits")
    c = tv.load(spark, sf, "source_commits").select(
        "commit_id", "object_fqn", F.date_format("committed_at", "yyyy-MM-dd'T'HH:mm:ss").alias("committed_at"), "author")
    feeds.export_csv(c, path)
    back = feeds.read_csv_feed(spark, path, feeds.COMMIT_FEED, ["committed_at"])
    return back.groupBy(F.to_date("committed_at").alias("commit_date")).agg(
        F.count(F.lit(1)).alias("commits"), F.countDistinct("author").alias("authors"))


@register("scheduler_feed_status", "task_history", op="SRC-6", sql="""
SELECT upper(coalesce(state, 'UNKNOWN')) AS status, count(*) AS jobs,
       round(avg(date_diff('second', scheduled_time, completed_time)), 3) AS avg_duration_sec
FROM task_history GROUP BY 1
""")
def _(spark, sf):
    path = _run_dir(spark, "scheduler")
    t = tv.load(spark, sf, "task_history").select(
        F.col("query_id").alias("job_id"), F.col("name").alias("job_name"), F.col("state").alias("status"),
        F.date_format("scheduled_time", "yyyy-MM-dd HH:mm:ss").alias("started_at"),
        F.date_format("completed_time", "yyyy-MM-dd HH:mm:ss").alias("ended_at"),
        F.timestamp_diff("SECOND", "scheduled_time", "completed_time").cast("string").alias("duration_sec"),
        F.lit("orders").alias("source_system"))
    t.write.json(path)
    back = feeds.read_scheduler_json(spark, path, multiline=False)
    from opslens.functions.exprs import rounded
    return back.groupBy("status").agg(F.count(F.lit(1)).alias("jobs"), rounded(F.avg("duration_sec"), 3).alias("avg_duration_sec"))


@register("control_feed", "task_history", op="SRC-6", sql="""
WITH t AS (SELECT *, CASE WHEN hash_id % 13 = 0 THEN NULL ELSE 'JOB_' || CAST(hash_id % 500 AS VARCHAR) END AS external_id
           FROM (SELECT *, CAST(substr(query_id, 2) AS BIGINT) AS hash_id FROM task_history)),
f AS (SELECT 'SCHEDULER' AS source_system, external_id, 'TASK' AS object_type, name AS object_name, state AS status,
             scheduled_time AS last_seen_at, CASE WHEN hash_id % 5 = 0 THEN 1 ELSE hash_id % 40 END AS seen_count,
             TIMESTAMP '2024-01-30 00:00:00' + to_days(CAST(hash_id % 2 AS INTEGER)) AS feed_ts, hash_id AS run_no
      FROM t WHERE external_id IS NOT NULL)
SELECT source_system, external_id, object_type, object_name, status, last_seen_at, seen_count, feed_ts, run_no FROM (
  SELECT *, row_number() OVER (PARTITION BY external_id ORDER BY feed_ts DESC, last_seen_at DESC, object_name DESC, status DESC, seen_count DESC, run_no DESC) AS rk
  FROM f) WHERE rk = 1
""")
def _(spark, sf):
    """Two batches of an outer array, written over many lines, merged one after
    the other; ``run_no`` has no column in the feed and survives in the payload."""
    path = _run_dir(spark, "control")
    t = tv.load(spark, sf, "task_history").withColumn("no", F.expr("CAST(substr(query_id, 2) AS BIGINT)"))
    job = F.struct(F.when(F.col("no") % 13 != 0, F.concat(F.lit("JOB_"), (F.col("no") % 500).cast("string"))).alias("job_id"),
                   F.col("name").alias("object_name"), F.col("state").alias("status"),
                   F.date_format("scheduled_time", "yyyy-MM-dd HH:mm:ss").alias("last_seen_at"),
                   F.when(F.col("no") % 5 == 0, F.lit("many")).otherwise((F.col("no") % 40).cast("string")).alias("seen_count"), F.col("no").alias("run_no"))
    for part in (0, 1):
        lines = t.filter(F.col("no") % 2 == part).select(F.concat(F.to_json(job), F.lit(",")).alias("value"))
        head = spark.createDataFrame([("[",)], "value string")
        head.unionByName(lines).unionByName(spark.createDataFrame([("]",)], "value string")).write.text(f"{path}/{part}")
    stored = None
    for part in (0, 1):
        batch = feeds.control_feed(feeds.read_variant_feed(spark, f"{path}/{part}"), datetime(2024, 1, 30 + part), "SCHEDULER")
        stored = feeds.merge_control_feed(stored, batch)
    return stored.select("source_system", "external_id", "object_type", "object_name", "status", "last_seen_at", "seen_count", "feed_ts",
                         F.try_variant_get("raw_payload", "$.run_no", "bigint").alias("run_no"))


@register("conformed_query_history", "query_history", op="SRC-2", sql="""
SELECT warehouse_name, count(*) AS queries, count(warehouse_size) AS with_size, count(query_tag) AS with_tag,
       CAST(0 AS BIGINT) AS with_bytes FROM query_history GROUP BY 1
""")
def _(spark, sf):
    q = tv.load(spark, sf, "query_history").drop("bytes_scanned")  # an account without this optional column
    c = schemas.conform(q.withColumnRenamed("warehouse_name", "WAREHOUSE_NAME"), "query_history")
    return c.groupBy("warehouse_name").agg(F.count(F.lit(1)).alias("queries"), F.count("warehouse_size").alias("with_size"),
                                           F.count("query_tag").alias("with_tag"), F.count("bytes_scanned").alias("with_bytes"))


@register("live_window_scan", "query_history", op="SRC-12", sql="""
SELECT query_id, start_time, warehouse_name, execution_status FROM query_history
WHERE start_time >= TIMESTAMP '2024-01-30 22:00:00' AND start_time < TIMESTAMP '2024-01-31 00:00:01'

""")
def _(spark, sf):
    q = tv.load(spark, sf, "query_history").select("query_id", "start_time", "warehouse_name", "execution_status")
    return feeds.live_scan(q, "start_time", EVENTS_AS_OF, minutes=120, order="query_id")


@register("tagged_metering_union", "warehouse_metering", "metering_long", op="SRC-13", sql="""
SELECT source, warehouse_name, round(sum(credits_used), 4) AS credits FROM (
  SELECT warehouse_name, credits_used, 'events' AS source FROM warehouse_metering WHERE start_time >= TIMESTAMP '2024-01-24 00:00:00'
  UNION ALL
  SELECT warehouse_name, credits_used, 'lineitem' FROM metering_long WHERE start_time >= TIMESTAMP '2001-10-29 00:00:00')
GROUP BY 1, 2
""")
def _(spark, sf):
    from opslens.functions.exprs import rounded
    from opslens.sources.testviews import LINEITEM_AS_OF
    a = feeds.scan(tv.load(spark, sf, "warehouse_metering"), "start_time", EVENTS_AS_OF, 7).select("warehouse_name", "credits_used")
    b = feeds.scan(tv.load(spark, sf, "metering_long"), "start_time", LINEITEM_AS_OF, 7).select("warehouse_name", "credits_used")
    u = feeds.tagged_union({"events": a, "lineitem": b})
    return u.groupBy("source", "warehouse_name").agg(rounded(F.sum("credits_used"), 4).alias("credits"))


@register("summary_first_daily_credits", "warehouse_metering", op="SRC-3", sql="""
SELECT CAST(start_time AS DATE) AS usage_date, warehouse_name, round(sum(coalesce(credits_used, 0)), 4) AS credits_used,
       round(sum(coalesce(credits_used_compute, 0)), 4) AS credits_compute,
       round(sum(coalesce(credits_used_cloud_services, 0)), 4) AS credits_cloud
FROM warehouse_metering WHERE start_time >= TIMESTAMP '2024-01-24 00:00:00' AND start_time < TIMESTAMP '2024-01-31 00:00:00'
GROUP BY 1, 2
""")
def _(spark, sf):
    from opslens.operators import summaries
    # the summary was never built for this run, so the detail is aggregated (same schema)
    return feeds.summary_first(spark, _run_dir(spark, "missing-summary"),
                               lambda: summaries.daily_warehouse_credits(tv.load(spark, sf, "warehouse_metering"), EVENTS_AS_OF, 7))


@register("scheduler_feed_latest", "task_history", op="UPS-2", sql="""
SELECT 'orders' AS source_system, name AS job_id,
       (max({'s': scheduled_time, 'st': upper(coalesce(state, 'UNKNOWN')), 'q': query_id})).s AS started_at,
       (max({'s': scheduled_time, 'st': upper(coalesce(state, 'UNKNOWN')), 'q': query_id})).st AS status,
       (max({'s': scheduled_time, 'st': upper(coalesce(state, 'UNKNOWN')), 'q': query_id})).q AS run_id
FROM task_history GROUP BY 2
""")
def _(spark, sf):
    from opslens.streaming.incremental import latest_by_key
    t = tv.load(spark, sf, "task_history")
    feed = t.select(F.lit("orders").alias("source_system"), F.col("name").alias("job_id"), F.col("scheduled_time").alias("started_at"),
                    F.upper(F.coalesce("state", F.lit("UNKNOWN"))).alias("status"), F.col("query_id").alias("run_id"))
    return latest_by_key(feed, ["source_system", "job_id"], "started_at")


@register("queue_after_verification", "warehouses", "query_history", "warehouse_metering", op="UPS-4",
          sql="WITH ver AS (" + q_alerts.SAVINGS_VERIFICATION_SQL + "), " + """
acts AS (SELECT 'act-' || w.warehouse_name AS action_id, w.warehouse_name AS entity, 'Open' AS status FROM warehouses w
         LEFT JOIN (SELECT warehouse_name, count(*) AS query_count FROM query_history
                    WHERE start_time >= TIMESTAMP '2024-01-24 00:00:00' AND warehouse_name IS NOT NULL GROUP BY 1) up
           ON w.warehouse_name = up.warehouse_name
         WHERE w.auto_suspend = 0 OR (w.auto_suspend > 120 AND coalesce(up.query_count, 0) < 1000))
SELECT acts.action_id, entity, CASE WHEN outcome = 'Savings verified' THEN 'Verified' ELSE status END AS status,
       round(savings_pct, 1) AS verified_savings_pct
FROM acts LEFT JOIN ver ON acts.action_id = ver.action_id
""")
def _(spark, sf):
    from datetime import timedelta

    from opslens.functions.timeutil import ts_lit
    from opslens.operators import alerts as al
    from opslens.operators import capacity as cap
    from opslens.streaming.incremental import apply_verification
    s = cap.suspend_timeout_analysis(tv.load(spark, sf, "warehouses"), tv.load(spark, sf, "query_history"),
                                     tv.load(spark, sf, "warehouse_metering"), EVENTS_AS_OF, 7)
    acts = s.select(F.col("warehouse_name").alias("entity"), F.concat(F.lit("act-"), "warehouse_name").alias("action_id"),
                    ts_lit(EVENTS_AS_OF - timedelta(days=10)).alias("acted_at"))
    ver = al.savings_verification(tv.load(spark, sf, "warehouse_metering"), acts, EVENTS_AS_OF, 28)
    queue = acts.select("action_id", "entity", F.lit("Open").alias("status"))
    return apply_verification(queue, ver)


def _credits_by_day(metering):
    return metering.groupBy(F.to_date("start_time").alias("usage_date"), "warehouse_name").agg(
        rounded(F.sum("credits_used"), 4).alias("credits_used"), F.count(F.lit(1)).alias("metering_rows"))


@register("stitched_daily_credits", "warehouse_metering", op="SRC-3", sql="""
SELECT CAST(start_time AS DATE) AS usage_date, warehouse_name, round(sum(credits_used), 4) AS credits_used, count(*) AS metering_rows
FROM warehouse_metering WHERE start_time >= TIMESTAMP '2024-01-01' AND start_time < TIMESTAMP '2024-01-31' GROUP BY 1, 2
""")
def _(spark, sf):
    """Half of the days come from a summary, one of them not closed yet."""
    metering, path = tv.load(spark, sf, "warehouse_metering"), _run_dir(spark, "stitched")
    even = F.dayofmonth("usage_date") % 2 == 0
    summary = _credits_by_day(metering).where(even)
    # the open day's summary is behind its detail, and must not be read
    behind = F.when(F.dayofmonth("usage_date") == 16, F.col("credits_used") / 2).otherwise(F.col("credits_used"))
    summary.withColumn("credits_used", behind).write.partitionBy("usage_date").parquet(f"{path}/summary")
    summary.select("usage_date").distinct().withColumn("complete", F.dayofmonth("usage_date") != 16).write.parquet(f"{path}/manifest")
    return feeds.stitched(spark, f"{path}/summary", f"{path}/manifest", metering, "start_time", _credits_by_day, date(2024, 1, 1), date(2024, 1, 30))
