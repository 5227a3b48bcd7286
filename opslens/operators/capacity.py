"""Capacity, sizing and warehouse health (CAP-*).

Everything starts from per-(warehouse, hour) partial aggregates, so the
shuffles carry at most warehouses x hours rows whatever the query volume.
Exact percentiles keep one counter per distinct value (bounded by distinct
elapsed milliseconds, not by rows); pass ``exact=False`` for the sketch.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opslens.functions.exprs import page, pctl, rounded, safe_div, severity_rank
from opslens.functions.timeutil import between_ts, dow0, lookback, trunc, ts_lit
from opslens.operators.cost import CREDIT_PRICE, size_rate
from opslens.operators.query import is_failed

GB = 1024.0 ** 3


def warehouse_utilization(metering: DataFrame, queries: DataFrame, as_of: datetime, days: int = 30,
                          exact: bool = True) -> DataFrame:
    """CAP-1: per warehouse: active hours, mean/peak/p95 hourly credits, mean
    and peak hourly queries, queue seconds, remote spill GB, mean hourly p95."""
    days = max(7, int(days or 30))
    u = (metering.filter(lookback("start_time", as_of, days, end=as_of))
         .groupBy("warehouse_name", trunc("hour", "start_time").alias("hour_bucket"))
         .agg(F.sum("credits_used_compute").alias("hourly_credits")))
    qp = (queries.filter(lookback("start_time", as_of, days) & F.col("warehouse_name").isNotNull()
                         & (F.col("execution_status") == "SUCCESS"))
          .groupBy("warehouse_name", trunc("hour", "start_time").alias("hour_bucket"))
          .agg(F.count(F.lit(1)).alias("query_count"),
               (F.avg("queued_overload_time") / 1000.0).alias("avg_queue_sec"),
               (F.max("queued_overload_time") / 1000.0).alias("max_queue_sec"),
               (F.sum("bytes_spilled_to_remote_storage") / GB).alias("remote_spill_gb"),
               pctl(F.col("total_elapsed_time") / 1000.0, 0.95, exact).alias("p95_elapsed_sec")))
    j = u.join(qp, ["warehouse_name", "hour_bucket"], "left")
    return (j.groupBy("warehouse_name")
            .agg(F.countDistinct("hour_bucket").alias("active_hours"),
                 rounded(F.avg("hourly_credits"), 4).alias("avg_hourly_credits"),
                 rounded(F.max("hourly_credits"), 4).alias("peak_hourly_credits"),
                 rounded(pctl("hourly_credits", 0.95, exact), 4).alias("p95_hourly_credits"),
                 rounded(F.avg("query_count"), 0).alias("avg_hourly_queries"),
                 rounded(F.max("query_count"), 0).alias("peak_hourly_queries"),
                 rounded(F.avg("avg_queue_sec"), 2).alias("avg_queue_sec"),
                 rounded(F.max("max_queue_sec"), 2).alias("peak_queue_sec"),
                 rounded(F.sum("remote_spill_gb"), 2).alias("total_remote_spill_gb"),
                 rounded(F.avg("p95_elapsed_sec"), 2).alias("avg_p95_elapsed_sec")))


def size_recommendation(util: DataFrame, queue_threshold_sec: float = 5.0, spill_threshold_gb: float = 1.0) -> DataFrame:
    """CAP-4 / CAP-9: upsize, downsize, multi-cluster or maintain from the
    utilisation row, with confidence and the evidence flags."""
    aq = F.coalesce("avg_queue_sec", F.lit(0.0))
    pq = F.coalesce("peak_queue_sec", F.lit(0.0))
    sp = F.coalesce("total_remote_spill_gb", F.lit(0.0))
    pc = F.coalesce("peak_hourly_credits", F.lit(0.0))
    ac = F.coalesce("avg_hourly_credits", F.lit(0.0))
    s1, s2, s3 = aq > queue_threshold_sec, pq > queue_threshold_sec * 3, sp > spill_threshold_gb
    up = s1.cast("int") + s2.cast("int") + s3.cast("int")
    down = (aq < 0.5) & (sp < 0.1) & (ac > 0) & (pc < ac * 1.5)
    multi = (pq > queue_threshold_sec * 5) & (sp < spill_threshold_gb)
    n_evidence = up + down.cast("int")
    rec = (F.when(multi, "consider_multi_cluster").when(up >= 2, "upsize")
           .when(down & (up == 0), "downsize").otherwise("maintain"))
    conf = (F.when(multi, "high").when(up >= 2, F.when(up >= 3, "high").otherwise("medium"))
            .when(down & (up == 0), "medium").when(n_evidence == 0, "high").otherwise("medium"))
    ev = F.concat_ws("; ", F.when(s1, F.lit("avg queue above threshold")), F.when(s2, F.lit("peak queue 3x threshold")),
                     F.when(s3, F.lit("remote spill above threshold")), F.when(down, F.lit("low queue, no spill, stable load")))
    return util.select("warehouse_name", rec.alias("recommendation"), conf.alias("confidence"),
                       up.alias("upsize_signals"), ev.alias("evidence"))


def peak_hours(queries: DataFrame, as_of: datetime, days: int = 14) -> DataFrame:
    """CAP-2: per warehouse x hour of day x weekday (0 = Sunday) heat map."""
    days = max(7, int(days or 14))
    q = queries.filter(lookback("start_time", as_of, days) & F.col("warehouse_name").isNotNull()
                       & (F.col("execution_status") == "SUCCESS"))
    return (q.groupBy("warehouse_name", F.hour("start_time").alias("hour_of_day"),
                      dow0("start_time").alias("day_of_week"))
            .agg(F.count(F.lit(1)).alias("query_count"),
                 rounded(F.avg(F.col("total_elapsed_time") / 1000.0), 2).alias("avg_elapsed_sec"),
                 rounded(F.avg(F.col("queued_overload_time") / 1000.0), 2).alias("avg_queue_sec"),
                 rounded(F.sum("bytes_spilled_to_remote_storage") / GB, 2).alias("remote_spill_gb")))


def weekly_growth(metering: DataFrame, as_of: datetime, days: int = 60) -> DataFrame:
    """CAP-3: weekly credits per warehouse with the previous week and growth %."""
    days = max(14, int(days or 60))
    wk = (metering.filter(lookback("start_time", as_of, days))
          .groupBy("warehouse_name", trunc("week", F.to_date("start_time")).alias("week_start"))
          .agg(rounded(F.sum("credits_used"), 4).alias("weekly_credits")))
    w = Window.partitionBy("warehouse_name").orderBy("week_start")
    prev = F.lag("weekly_credits").over(w)
    return wk.select("warehouse_name", "week_start", "weekly_credits", prev.alias("prev_week_credits"),
                     rounded(safe_div(F.col("weekly_credits") - prev, prev) * 100, 1).alias("wow_growth_pct"))


def capacity_outlook(metering: DataFrame, warehouses: DataFrame, as_of: datetime, days: int = 60) -> DataFrame:
    """CAP-5 + FCT-11: latest weekly credits and growth per warehouse against
    the weekly capacity of its size (size rate x 168 h), weeks until full (null
    from 52 on), urgency and a capacity score (percent of capacity used)."""
    from opslens.operators.forecast import capacity_exhaustion
    g = weekly_growth(metering, as_of, days)
    latest = g.groupBy("warehouse_name").agg(
        F.max(F.struct("week_start", "weekly_credits", "wow_growth_pct")).alias("l"))
    j = latest.join(warehouses.select("warehouse_name", "warehouse_size"), "warehouse_name", "left")
    cap = (size_rate(F.coalesce("warehouse_size", F.lit("X-Small"))) * 168).cast("double")
    cur, gr = F.col("l.weekly_credits"), F.coalesce(F.col("l.wow_growth_pct"), F.lit(0.0))
    weeks, urgency, action = capacity_exhaustion(gr, cur, cap, max_weeks=52)
    return j.select("warehouse_name", "warehouse_size", F.col("l.week_start").alias("week_start"),
                    cur.alias("weekly_credits"), gr.alias("wow_growth_pct"), cap.alias("weekly_capacity_credits"),
                    rounded(safe_div(cur * 100, cap), 2).alias("capacity_score"),
                    weeks.alias("weeks_until_full"), urgency.alias("urgency"), action.alias("action_needed"))


def _capacity(queries: DataFrame, metering: DataFrame, as_of: datetime, days: int, exact: bool) -> DataFrame:
    """Statements and credits of each warehouse, also of one known to a single
    side: both sides are reduced to a row a warehouse before the full join."""
    now, prior = as_of - timedelta(days=days), as_of - timedelta(days=2 * days)
    ms = lambda c: F.coalesce(c, F.lit(0))
    remote = ms("bytes_spilled_to_remote_storage")
    q = (queries.filter(between_ts("start_time", now, as_of) & F.col("warehouse_name").isNotNull()).groupBy("warehouse_name")
         .agg(F.max("warehouse_size").alias("warehouse_size"), F.count(F.lit(1)).alias("total_queries"),
              F.count_if(ms("queued_overload_time") + ms("queued_provisioning_time") > 0).alias("queued_queries"),
              F.count_if(ms("bytes_spilled_to_local_storage") + remote > 0).alias("spill_queries"),
              F.count_if(F.col("total_elapsed_time") >= 30000).alias("high_latency_queries"),
              pctl(F.col("total_elapsed_time") / 1000.0, 0.95, exact).alias("p95_elapsed_sec"), (F.sum(remote) / GB).alias("remote_spill_gb")))
    credits, cur = F.coalesce("credits_used_compute", "credits_used", F.lit(0.0)), F.col("start_time") >= ts_lit(now)
    m = (metering.filter(between_ts("start_time", prior, as_of) & F.col("warehouse_name").isNotNull()).groupBy("warehouse_name")
         .agg(F.sum(F.when(cur, credits).otherwise(0.0)).alias("current_credits"), F.sum(F.when(~cur, credits).otherwise(0.0)).alias("prior_credits")))
    j = q.join(m, "warehouse_name", "full")
    counts = ["total_queries", "queued_queries", "spill_queries", "high_latency_queries"]
    amounts = ["p95_elapsed_sec", "remote_spill_gb", "current_credits", "prior_credits"]
    j = j.select("warehouse_name", "warehouse_size", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], *[F.coalesce(c, F.lit(0.0)).alias(c) for c in amounts])
    return j.withColumn("credit_spike_pct", safe_div(F.col("current_credits") - F.col("prior_credits"), "prior_credits") * 100)


def capacity_summary(queries: DataFrame, metering: DataFrame, as_of: datetime, days: int = 7, exact: bool = True) -> DataFrame:
    """CAP-5: one row over all warehouses: statements, queued, spilled and slow
    (30 s) ones, credits of the period and the one before with the change, worst
    95th percentile and remote spill."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    a = _capacity(queries, metering, as_of, days, exact).agg(
        F.count(F.lit(1)).alias("warehouses_active"), *[total(c) for c in ("total_queries", "queued_queries", "spill_queries", "high_latency_queries")],
        F.coalesce(F.sum("current_credits"), F.lit(0.0)).alias("_c"), F.coalesce(F.sum("prior_credits"), F.lit(0.0)).alias("_p"),
        F.max("p95_elapsed_sec").alias("_w"), F.coalesce(F.sum("remote_spill_gb"), F.lit(0.0)).alias("_r"))
    return a.select(*a.columns[:5], rounded("_c", 4).alias("metered_credits"), rounded("_p", 4).alias("prior_credits"),
                    rounded(safe_div(F.col("_c") - F.col("_p"), "_p") * 100, 1).alias("credit_spike_pct"),
                    rounded("_w", 2).alias("worst_p95_elapsed_sec"), rounded("_r", 2).alias("remote_spill_gb"))


def capacity_exceptions(queries: DataFrame, metering: DataFrame, as_of: datetime, days: int = 7, exact: bool = True) -> DataFrame:
    """CAP-5: warehouses with queued, spilled or slow statements or credits up by
    25 %, with severity, first signal and a capacity score: 100 less up to 28
    for the queued share, 24 for the spilled, 18 for the slow one and 20 for
    the rise in credits. Without a statement the score has no shares to go by and
    is NULL. All such warehouses are listed."""
    c = _capacity(queries, metering, as_of, days, exact)
    queued, spilled, slow, gb, up = (F.col(x) for x in ("queued_queries", "spill_queries", "high_latency_queries", "remote_spill_gb", "credit_spike_pct"))
    rise = F.coalesce(up, F.lit(0.0))
    severity = (F.when((queued >= 20) | (gb >= 20), "Critical").when((rise >= 50) | (spilled >= 10) | (slow >= 25), "High").otherwise("Medium"))
    signal = (F.when(queued >= 20, "Queue Pressure").when(gb >= 1, "Memory Spill").when(rise >= 25, "Credit Spike").otherwise("Latency Pressure"))

    def lost(count, weight, most):
        return F.least(safe_div(count * 100.0, "total_queries") * weight, F.lit(float(most)))
    score = 100.0 - lost(queued, 2.0, 28) - lost(spilled, 1.8, 24) - lost(slow, 1.1, 18) - F.least(F.greatest(rise, F.lit(0.0)) / 4, F.lit(20.0))
    found = c.filter((queued > 0) | (spilled > 0) | (slow > 0) | (rise >= 25))
    return found.select(severity.alias("severity"), signal.alias("signal"), "warehouse_name", "warehouse_size", "total_queries", "queued_queries", "spill_queries",
                        "high_latency_queries", rounded("p95_elapsed_sec", 2).alias("p95_elapsed_sec"), rounded("remote_spill_gb", 2).alias("remote_spill_gb"),
                        rounded("current_credits", 4).alias("metered_credits"), rounded("prior_credits", 4).alias("prior_credits"),
                        rounded(rise, 1).alias("credit_spike_pct"), F.when(F.col("total_queries") > 0, rounded(score, 1)).alias("capacity_score"))


def pressure_exceptions(queries: DataFrame, as_of: datetime, hours_back: int = 24, limit: int = 10,
                        exact: bool = True) -> DataFrame:
    """CAP-6: warehouses with queued queries, remote spill or p95 >= 60 s."""
    q = queries.filter((F.col("start_time") >= ts_lit(as_of - timedelta(hours=hours_back)))
                       & F.col("warehouse_name").isNotNull())
    queued = (F.coalesce("queued_overload_time", F.lit(0)) + F.coalesce("queued_provisioning_time", F.lit(0))) > 0
    g = (q.groupBy("warehouse_name")
         .agg(F.max("warehouse_size").alias("warehouse_size"), F.count(F.lit(1)).alias("total_queries"),
              F.count_if(queued).alias("queued_queries"),
              F.count_if(F.coalesce("bytes_spilled_to_remote_storage", F.lit(0)) > 0).alias("remote_spill_queries"),
              rounded(F.sum(F.coalesce("bytes_spilled_to_remote_storage", F.lit(0))) / GB, 2).alias("remote_spill_gb"),
              rounded(pctl(F.coalesce("total_elapsed_time", F.lit(0)) / 1000.0, 0.95, exact), 2).alias("p95_elapsed_sec")))
    return (g.filter((F.col("queued_queries") > 0) | (F.col("remote_spill_queries") > 0) | (F.col("p95_elapsed_sec") >= 60))
            .orderBy(F.desc("queued_queries"), F.desc("remote_spill_gb"), F.desc("p95_elapsed_sec"), "warehouse_name")
            .limit(limit))


def warehouse_overview(queries: DataFrame, metering: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """CAP-7: query roll-up per warehouse beside the credit roll-up of the
    period and the prior period (conditional sums, one metering scan)."""
    a, b = as_of - timedelta(days=days), as_of - timedelta(days=2 * days)
    q = queries.filter(between_ts("start_time", a, as_of) & F.col("warehouse_name").isNotNull())
    qr = q.groupBy("warehouse_name").agg(
        F.max("warehouse_size").alias("warehouse_size"), F.count(F.lit(1)).alias("total_queries"),
        rounded(F.sum("total_elapsed_time") / F.count(F.lit(1)) / 1000.0, 3).alias("avg_elapsed_sec"),
        rounded(F.sum(F.col("queued_overload_time") + F.col("queued_provisioning_time")) / F.count(F.lit(1)) / 1000.0, 3)
        .alias("avg_queued_sec"),
        rounded(F.sum("bytes_spilled_to_remote_storage") / GB, 3).alias("total_remote_spill_gb"),
        F.count_if(F.col("execution_status") != "SUCCESS").alias("error_count"),
        rounded(F.sum("bytes_scanned") / GB, 3).alias("total_gb_scanned"))
    t = F.col("start_time")
    cur = (t >= ts_lit(a)) & (t < ts_lit(as_of))
    pri = (t >= ts_lit(b)) & (t < ts_lit(a))
    c = F.coalesce("credits_used", F.lit(0.0))
    cr = (metering.filter(between_ts("start_time", b, as_of))
          .groupBy("warehouse_name")
          .agg(F.sum(F.when(cur, c).otherwise(0.0)).alias("_c"), F.sum(F.when(pri, c).otherwise(0.0)).alias("_p"),
               F.sum(F.when(cur, F.coalesce("credits_used_compute", F.lit(0.0))).otherwise(0.0)).alias("_cc"),
               F.sum(F.when(cur, F.coalesce("credits_used_cloud_services", F.lit(0.0))).otherwise(0.0)).alias("_cl")))
    j = qr.join(cr, "warehouse_name", "left")
    return j.select(*qr.columns,
                    F.coalesce(rounded("_c", 4), F.lit(0.0)).alias("metered_credits"),
                    F.coalesce(rounded("_p", 4), F.lit(0.0)).alias("prior_metered_credits"),
                    F.coalesce(rounded(F.col("_c") - F.col("_p"), 4), F.lit(0.0)).alias("credit_delta"),
                    rounded(safe_div(F.col("_c") - F.col("_p"), "_p") * 100, 1).alias("credit_delta_pct"),
                    F.coalesce(rounded("_cc", 4), F.lit(0.0)).alias("credits_used_compute"),
                    F.coalesce(rounded("_cl", 4), F.lit(0.0)).alias("credits_used_cloud_services"))


def largest_metering_hours(metering: DataFrame, as_of: datetime, days: int = 7, limit: int = 20) -> DataFrame:
    """CAP-8: the largest warehouse-hours by credits."""
    return (metering.filter(between_ts("start_time", as_of - timedelta(days=days), as_of))
            .groupBy("warehouse_name", trunc("hour", "start_time").alias("hour_start"))
            .agg(rounded(F.sum("credits_used"), 4).alias("credits_used"))
            .orderBy(F.desc("credits_used"), "warehouse_name", "hour_start").limit(limit))


def suspend_timeout_analysis(warehouses: DataFrame, queries: DataFrame, metering: DataFrame, as_of: datetime,
                             days: int = 7) -> DataFrame:
    """CAP-10: warehouses that never suspend, or suspend late with little use."""
    days = max(1, int(days or 7))
    up = (queries.filter(lookback("start_time", as_of, days) & F.col("warehouse_name").isNotNull())
          .groupBy("warehouse_name")
          .agg(F.countDistinct(trunc("hour", "start_time")).alias("active_hours"),
               F.count(F.lit(1)).alias("query_count"),
               rounded(F.avg(F.col("total_elapsed_time") / 1000.0), 1).alias("avg_query_sec")))
    m = (metering.filter(lookback("start_time", as_of, days))
         .groupBy("warehouse_name")
         .agg(rounded(F.sum("credits_used"), 4).alias("total_credits"),
              F.countDistinct(trunc("hour", "start_time")).alias("metered_hours")))
    j = warehouses.join(up, "warehouse_name", "left").join(m, "warehouse_name", "left")
    s = F.col("auto_suspend")
    qc, tc = F.coalesce("query_count", F.lit(0)), F.coalesce("total_credits", F.lit(0.0))
    typ = (F.when(s == 0, "Never suspends").when((s > 300) & (qc < 100), "High timeout + low usage")
           .when((s > 120) & (tc > 10), "Could benefit from 60s timeout").otherwise("Acceptable"))
    return (j.filter((s == 0) | ((s > 120) & (qc < 1000)))
            .select("warehouse_name", "auto_suspend", "warehouse_size",
                    F.coalesce("active_hours", F.lit(0)).alias("active_hours"), qc.alias("query_count"),
                    F.coalesce("avg_query_sec", F.lit(0.0)).alias("avg_query_sec"), tc.alias("total_credits"),
                    F.coalesce("metered_hours", F.lit(0)).alias("metered_hours"), typ.alias("recommendation_type")))


def consolidation_candidates(queries: DataFrame, as_of: datetime, days: int = 14, max_queries: int = 100,
                             max_hours: float = 1.0, limit: int = 20) -> DataFrame:
    """CAP-11: low-use warehouses (few queries and little runtime)."""
    days = max(7, int(days or 14))
    g = (queries.filter(lookback("start_time", as_of, days) & F.col("warehouse_name").isNotNull())
         .groupBy("warehouse_name")
         .agg(F.count(F.lit(1)).alias("query_count"),
              rounded(F.sum("total_elapsed_time") / 1000.0 / 3600, 2).alias("total_hours_runtime")))
    return (g.filter((F.col("query_count") < max_queries) & (F.col("total_hours_runtime") < max_hours))
            .orderBy("total_hours_runtime", "warehouse_name").limit(limit))


def shared_hours(queries: DataFrame, as_of: datetime, days: int = 14) -> DataFrame:
    """CAP-12, re-aimed: per warehouse, active hours, hours shared with at least
    one other warehouse and the mean number of concurrent warehouses in its
    active hours. The reference's pairwise self-join (all warehouse pairs per
    hour) is replaced by one count per hour joined back, so no pairs are built."""
    days = max(7, int(days or 14))
    act = (queries.filter(lookback("start_time", as_of, days) & F.col("warehouse_name").isNotNull())
           .select("warehouse_name", trunc("hour", "start_time").alias("hour_bucket")).distinct())
    per_hour = act.groupBy("hour_bucket").agg(F.count(F.lit(1)).alias("_w"))
    return (act.join(per_hour, "hour_bucket")
            .groupBy("warehouse_name")
            .agg(F.count(F.lit(1)).alias("active_hours"),
                 F.count_if(F.col("_w") > 1).alias("shared_hours"),
                 rounded(F.avg("_w"), 2).alias("avg_concurrent_warehouses")))


def savings_estimates(suspend: DataFrame, consolidation: DataFrame, price: float = CREDIT_PRICE,
                      window_days: int = 7) -> DataFrame:
    """CAP-13: estimated monthly savings of the suspend and consolidation
    findings, one ranked list."""
    s = F.coalesce("auto_suspend", F.lit(0))
    pct = F.when(s == 0, 0.30).when(s > 300, 0.15).when(s > 120, 0.10).otherwise(0.05)
    a = (suspend.filter(~F.col("recommendation_type").contains("Acceptable"))
         .select(F.col("warehouse_name").alias("warehouse"), F.lit("suspend_timeout").alias("type"),
                 F.when(s == 0, "High").otherwise("Medium").alias("severity"),
                 rounded(F.col("total_credits") * pct * (30.0 / window_days) * price, 0).alias("est_monthly_savings")))
    b = consolidation.select(F.col("warehouse_name").alias("warehouse"), F.lit("consolidation").alias("type"),
                             F.lit("Low").alias("severity"), F.lit(float(round(price * 2))).alias("est_monthly_savings"))
    return a.unionByName(b)


def workload_isolation(queries: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """CAP-14: databases per warehouse and, for each warehouse, the largest
    number of warehouses any of its databases uses; isolation decision."""
    q = queries.filter(lookback("start_time", as_of, days) & F.col("warehouse_name").isNotNull()
                       & F.col("database_name").isNotNull())
    pairs = q.groupBy("warehouse_name", "database_name").agg(F.count(F.lit(1)).alias("n"))
    per_db = pairs.groupBy("database_name").agg(F.count(F.lit(1)).alias("wh_per_db"))
    j = pairs.join(per_db, "database_name")
    g = j.groupBy("warehouse_name").agg(F.count(F.lit(1)).alias("databases"), F.sum("n").alias("query_count"),
                                        F.max("wh_per_db").alias("max_warehouses_per_database"))
    dec = (F.when(F.col("databases") >= 5, "Split: mixed workload")
           .when(F.col("max_warehouses_per_database") >= 5, "Review: database spread over many warehouses")
           .otherwise("Isolated"))
    return g.withColumn("decision", dec)


def isolation_decisions(queries: DataFrame, as_of: datetime, days: int = 30, exact: bool = True, limit: int | None = None) -> DataFrame:
    """CAP-14: per (database, warehouse): load, failures, queue and spill, how many
    warehouses the database uses and how many databases the warehouse serves, and
    the decision Isolate, Standardize, Tune or Keep with its signals.

    The statements are read once, to a row a pair; both counts come from the pairs."""
    q = queries.filter(lookback("start_time", as_of, days) & F.col("warehouse_name").isNotNull() & F.col("database_name").isNotNull())
    gb = lambda c: rounded(F.coalesce(F.sum(c), F.lit(0)) / GB, 2)
    pairs = q.groupBy("database_name", "warehouse_name").agg(
        F.count(F.lit(1)).alias("query_count"), F.countDistinct("user_name").alias("users"), F.countDistinct("role_name").alias("roles"),
        F.count_if(is_failed()).alias("failed_queries"), rounded(F.avg("total_elapsed_time") / 1000.0, 2).alias("avg_elapsed_sec"),
        rounded(pctl("total_elapsed_time", 0.95, exact) / 1000.0, 2).alias("p95_elapsed_sec"),
        rounded(F.coalesce(F.sum("queued_overload_time"), F.lit(0)) / 1000.0, 2).alias("queued_sec"), gb("bytes_spilled_to_remote_storage").alias("remote_spill_gb"),
        gb("bytes_scanned").alias("gb_scanned"), F.max("start_time").alias("last_seen"))
    of_db = pairs.groupBy("database_name").agg(F.count(F.lit(1)).alias("database_warehouses"))
    of_wh = pairs.groupBy("warehouse_name").agg(F.count(F.lit(1)).alias("warehouse_databases"))
    j = pairs.join(of_db, "database_name").join(of_wh, "warehouse_name")
    dbs, whs = F.col("warehouse_databases"), F.col("database_warehouses")
    queued, spill, failed = F.col("queued_sec"), F.col("remote_spill_gb"), F.col("failed_queries")
    noisy = (queued > 60) | (spill > 1)
    isolate = (queued > 300) | ((dbs >= 5) & ((spill > 5) | (failed >= 10))) | ((dbs >= 4) & noisy)
    spread, tune = whs >= 3, noisy | (failed > 0)
    # fixed values: severities, decisions and signals
    signals = F.concat_ws(", ", F.when(dbs >= 4, "warehouse serves many databases"), F.when(spread, "database spans many warehouses"),
                          F.when(queued > 60, "queue pressure"), F.when(spill > 1, "remote spill"), F.when(failed > 0, "query failures"))
    out = j.select(
        "database_name", "warehouse_name", "query_count", "users", "roles", "failed_queries", "avg_elapsed_sec", "p95_elapsed_sec", "queued_sec",
        "remote_spill_gb", "gb_scanned", "last_seen", "database_warehouses", "warehouse_databases",
        F.when(isolate, "High").when(spread | tune, "Medium").otherwise("Low").alias("severity"),
        F.when(isolate, "Isolate").when(spread, "Standardize").when(tune, "Tune").otherwise("Keep").alias("isolation_decision"),
        F.when(signals == "", "No material isolation signal").otherwise(signals).alias("finding"))
    return out.transform(page(limit, severity_rank("severity"), F.desc("queued_sec"), F.desc("remote_spill_gb"), F.desc("query_count"),
                              "database_name", "warehouse_name"))


def clustering_review(tables: DataFrame, min_gb: float = 1.0) -> DataFrame:
    """CAP-15: large tables with their clustering state and advice."""
    gb = F.col("active_bytes") / GB
    t = tables.filter(gb >= min_gb)
    return t.select("table_catalog", "table_schema", "table_name", rounded(gb, 2).alias("active_gb"), "clustering_key",
                    F.when(F.col("clustering_key").isNull() & (gb >= 100), "Consider clustering key")
                    .when(F.col("clustering_key").isNull(), "Monitor pruning")
                    .otherwise("Clustered: check depth").alias("advice"))


def cache_reuse(queries: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """CAP-16: per warehouse, share of repeated statements (same hash seen
    before in the window) and the scan-weighted cache percentage."""
    q = queries.filter(lookback("start_time", as_of, days) & F.col("warehouse_name").isNotNull())
    per_hash = q.groupBy("warehouse_name", "query_hash").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("percentage_scanned_from_cache") * F.col("bytes_scanned")).alias("_cb"),
        F.sum("bytes_scanned").alias("_b"))
    g = per_hash.groupBy("warehouse_name").agg(
        F.sum("n").alias("query_count"), F.countDistinct("query_hash").alias("distinct_statements"),
        F.sum(F.col("n") - 1).alias("repeated_queries"), F.sum("_cb").alias("_cb"), F.sum("_b").alias("_b"))
    return g.select("warehouse_name", "query_count", "distinct_statements", "repeated_queries",
                    rounded(safe_div(F.col("repeated_queries") * 100, "query_count"), 2).alias("repeat_ratio_pct"),
                    rounded(safe_div("_cb", "_b"), 2).alias("weighted_cache_pct"))


def cache_decisions(queries: DataFrame, warehouses: DataFrame, as_of: datetime, days: int = 7, limit: int | None = None) -> DataFrame:
    """CAP-16: per warehouse and database, of the statements that scanned: query
    families, repeats, the scan-weighted cache share, and what follows from them
    and from the warehouse's suspend time (``auto_suspend`` seconds, 0 or NULL:
    none). A family is the parameterised hash, else the hash, else the text.

    Statements are folded to families first (a partial aggregate), so a hot
    warehouse doesn't carry its distinct hashes through one task."""
    has = {c.lower() for c in queries.columns}
    family = F.coalesce(*[F.col(c).cast("string") for c in ("query_parameterized_hash", "query_hash", "query_text") if c in has])
    q = queries.filter(lookback("start_time", as_of, days) & F.col("warehouse_name").isNotNull() & (F.col("bytes_scanned") > 0))
    keys = ["warehouse_name", "top_database"]
    one = q.groupBy("warehouse_name", F.coalesce("database_name", F.lit("NO_DATABASE")).alias("top_database"), family.alias("_family")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("bytes_scanned").alias("_bytes"),
        F.sum(F.col("bytes_scanned") * F.col("percentage_scanned_from_cache")).alias("_cached"),
        F.sum("total_elapsed_time").alias("_ms"), F.count("total_elapsed_time").alias("_timed"), F.max("start_time").alias("_seen"))
    g = one.groupBy(*keys).agg(
        F.sum("_n").alias("query_count"), F.count("_family").alias("query_families"), rounded(F.sum("_bytes") / GB, 2).alias("gb_scanned"),
        rounded(safe_div(F.sum("_cached"), F.sum("_bytes")), 2).alias("warehouse_cache_pct"),
        rounded(safe_div(F.sum("_ms"), F.sum("_timed")) / 1000.0, 2).alias("avg_elapsed_sec"), F.max("_seen").alias("last_seen"))
    j = g.join(warehouses.select("warehouse_name", "auto_suspend"), "warehouse_name", "left")
    repeats = F.greatest(F.col("query_count") - F.greatest(F.col("query_families"), F.lit(1)), F.lit(0))
    cache, often = F.coalesce("warehouse_cache_pct", F.lit(0.0)), repeats / F.col("query_count") >= 0.35
    suspend = F.coalesce("auto_suspend", F.lit(0))
    hostile, poor = (cache < 20) & often & (suspend != 0) & (suspend <= 60), (cache < 20) & often
    heavy = (cache < 10) & (F.col("gb_scanned") > 100)
    # fixed values: severities and decisions
    out = j.select(*keys, "query_count", "query_families", "gb_scanned", "warehouse_cache_pct", "avg_elapsed_sec", "last_seen", "auto_suspend",
                   repeats.alias("repeated_queries"), rounded(repeats * 100.0 / F.col("query_count"), 2).alias("repeat_ratio_pct"),
                   F.when(hostile, "High").when(poor | heavy, "Medium").otherwise("Low").alias("severity"),
                   F.when(hostile, "Cache-hostile suspend").when(poor, "Poor cache reuse").when(heavy, "Scan-heavy no-cache workload")
                   .otherwise("Cache acceptable").alias("cache_decision"))
    return out.transform(page(limit, severity_rank("severity"), F.desc("gb_scanned"), *keys))


def post_change_evidence(queries: DataFrame, metering: DataFrame, change_at: datetime, days: int = 7) -> DataFrame:
    """CAP-17: per warehouse, ``days`` before vs after a change: queries,
    mean elapsed, queued share and credits."""
    lo, hi = change_at - timedelta(days=days), change_at + timedelta(days=days)
    after = F.col("start_time") >= ts_lit(change_at)
    q = (queries.filter(between_ts("start_time", lo, hi) & F.col("warehouse_name").isNotNull())
         .groupBy("warehouse_name")
         .agg(F.count_if(~after).alias("queries_before"), F.count_if(after).alias("queries_after"),
              rounded(F.avg(F.when(~after, F.col("total_elapsed_time") / 1000.0)), 2).alias("avg_sec_before"),
              rounded(F.avg(F.when(after, F.col("total_elapsed_time") / 1000.0)), 2).alias("avg_sec_after")))
    m = (metering.filter(between_ts("start_time", lo, hi))
         .groupBy("warehouse_name")
         .agg(rounded(F.sum(F.when(~after, F.col("credits_used")).otherwise(0.0)), 4).alias("credits_before"),
              rounded(F.sum(F.when(after, F.col("credits_used")).otherwise(0.0)), 4).alias("credits_after")))
    j = q.join(m, "warehouse_name", "full")
    verdict = (F.when(F.col("credits_after") < F.col("credits_before") * 0.9, "Improved")
               .when(F.col("credits_after") > F.col("credits_before") * 1.1, "Regressed").otherwise("Unchanged"))
    return j.withColumn("verdict", verdict)

