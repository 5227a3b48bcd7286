"""Usage, storage, organisation and AI spend (USE-*, STO-*, ORG-*, AIC-*)."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.functions.exprs import rounded, safe_div
from opslens.functions.timeutil import between_ts, lookback, ts_lit

TB = 1024.0 ** 4


def user_activity(queries: DataFrame, logins: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """USE-1: per user and role: statements, active days, hours, warehouses,
    databases, logins, and a segment by active days."""
    days = max(7, int(days or 30))
    qa = (queries.filter(lookback("start_time", as_of, days) & F.col("user_name").isNotNull())
          .groupBy("user_name", "role_name")
          .agg(F.count(F.lit(1)).alias("query_count"), F.countDistinct(F.to_date("start_time")).alias("active_days"),
               rounded(F.sum("total_elapsed_time") / 1000.0 / 3600, 2).alias("total_hours"),
               F.countDistinct("warehouse_name").alias("warehouses_used"),
               F.countDistinct("database_name").alias("databases_accessed"),
               F.min("start_time").alias("first_query"), F.max("start_time").alias("last_query")))
    la = (logins.filter(lookback("event_timestamp", as_of, days)).groupBy("user_name")
          .agg(F.count(F.lit(1)).alias("login_count"), F.count_if(F.col("is_success") == "NO").alias("failed_logins")))
    j = qa.join(la, "user_name", "left")
    ad = F.col("active_days")
    seg = (F.when(ad >= days * 0.7, "Power User").when(ad >= days * 0.3, "Regular").when(ad >= 3, "Occasional")
           .otherwise("Rare"))
    return j.select(*qa.columns, F.coalesce("login_count", F.lit(0)).alias("login_count"),
                    F.coalesce("failed_logins", F.lit(0)).alias("failed_logins"), seg.alias("user_segment"))


def usage_kpis(queries: DataFrame, metering: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """USE-2: one KPI row: statements, users, warehouses, credits, weighted
    mean seconds (weights = statements per warehouse, AGG-12)."""
    q = queries.filter(between_ts("start_time", as_of - timedelta(days=days), as_of))
    per_wh = q.groupBy("warehouse_name").agg(F.count(F.lit(1)).alias("n"), F.avg("total_elapsed_time").alias("a"))
    w = per_wh.agg(rounded(F.sum(F.col("a") * F.col("n")) / F.sum("n") / 1000.0, 3).alias("weighted_avg_sec"))
    k = q.agg(F.count(F.lit(1)).alias("queries"), F.countDistinct("user_name").alias("users"),
              F.countDistinct("warehouse_name").alias("warehouses"))
    c = (metering.filter(between_ts("start_time", as_of - timedelta(days=days), as_of))
         .agg(F.coalesce(rounded(F.sum("credits_used"), 4), F.lit(0.0)).alias("credits")))
    return k.crossJoin(c).crossJoin(w)


def metering_period_compare(metering: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """USE-3 / AGG-4: current vs prior period credits in one scan, one row."""
    a, b = as_of - timedelta(days=days), as_of - timedelta(days=2 * days)
    cur = F.col("start_time") >= ts_lit(a)
    m = metering.filter(between_ts("start_time", b, as_of))
    g = m.agg(F.sum(F.when(cur, F.col("credits_used")).otherwise(0.0)).alias("_c"),
              F.sum(F.when(~cur, F.col("credits_used")).otherwise(0.0)).alias("_p"))
    return g.select(rounded("_c", 4).alias("current_credits"), rounded("_p", 4).alias("prior_credits"),
                    rounded(safe_div(F.col("_c") - F.col("_p"), "_p") * 100, 1).alias("pct_change"))


def storage_now_vs_prior(storage: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """USE-4: per database, bytes at the latest snapshot and at the latest
    snapshot before ``as_of - days`` (two ``max_by`` with date limits)."""
    cut = (as_of - timedelta(days=days)).date()
    s = storage.filter(F.col("usage_date") < F.lit(as_of.date()))
    g = s.groupBy("database_name").agg(
        F.max_by("average_database_bytes", "usage_date").alias("_now"),
        F.max_by(F.when(F.col("usage_date") <= F.lit(cut), F.col("average_database_bytes")),
                 F.when(F.col("usage_date") <= F.lit(cut), F.col("usage_date"))).alias("_prior"))
    return g.select("database_name", rounded(F.col("_now") / TB, 6).alias("current_tb"),
                    rounded(F.col("_prior") / TB, 6).alias("prior_tb"),
                    rounded(safe_div(F.col("_now") - F.col("_prior"), "_prior") * 100, 1).alias("pct_change"))


def pressured_warehouses(queries: DataFrame, as_of: datetime, days: int = 7, min_share: float = 10.0) -> DataFrame:
    """USE-5 / AGG-13: warehouses whose share of queued statements exceeds
    ``min_share`` % (per-hour aggregate first, then per warehouse), one row."""
    q = queries.filter(lookback("start_time", as_of, days) & F.col("warehouse_name").isNotNull())
    h = q.groupBy("warehouse_name", F.date_trunc("hour", "start_time").alias("h")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("queued_overload_time") > 0).alias("queued"))
    w = h.groupBy("warehouse_name").agg((F.sum("queued") * 100.0 / F.sum("n")).alias("queued_pct"))
    return w.agg(F.count_if(F.col("queued_pct") > min_share).alias("pressured_warehouses"),
                 F.count(F.lit(1)).alias("warehouses"))


def warehouse_movers(metering: DataFrame, as_of: datetime, days: int = 7, limit: int = 10) -> DataFrame:
    """USE-6: warehouses with the largest absolute credit change vs the prior period."""
    a, b = as_of - timedelta(days=days), as_of - timedelta(days=2 * days)
    cur = F.col("start_time") >= ts_lit(a)
    g = (metering.filter(between_ts("start_time", b, as_of)).groupBy("warehouse_name")
         .agg(F.sum(F.when(cur, F.col("credits_used")).otherwise(0.0)).alias("_c"),
              F.sum(F.when(~cur, F.col("credits_used")).otherwise(0.0)).alias("_p")))
    return (g.select("warehouse_name", rounded("_c", 4).alias("current_credits"), rounded("_p", 4).alias("prior_credits"),
                     rounded(F.col("_c") - F.col("_p"), 4).alias("credit_delta"))
            .orderBy(F.desc(F.abs("credit_delta")), "warehouse_name").limit(limit))


def query_type_mix(queries: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """USE-7: statements per type with share (grand total as one broadcast row)."""
    g = (queries.filter(lookback("start_time", as_of, days)).groupBy("query_type")
         .agg(F.count(F.lit(1)).alias("queries"), rounded(F.avg(F.col("total_elapsed_time") / 1000.0), 3).alias("avg_sec")))
    t = g.agg(F.sum("queries").alias("_t"))
    return g.crossJoin(F.broadcast(t)).select("query_type", "queries", "avg_sec",
                                              rounded(F.col("queries") * 100.0 / F.col("_t"), 1).alias("pct_of_queries"))


def database_adoption(queries: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """USE-7 / USE-8: per database: users, roles, warehouses, statements and active days."""
    return (queries.filter(lookback("start_time", as_of, days) & F.col("database_name").isNotNull())
            .groupBy("database_name")
            .agg(F.countDistinct("user_name").alias("users"), F.countDistinct("role_name").alias("roles"),
                 F.countDistinct("warehouse_name").alias("warehouses"), F.count(F.lit(1)).alias("queries"),
                 F.countDistinct(F.to_date("start_time")).alias("active_days")))


def service_health_by_warehouse(queries: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    """USE-9: per warehouse: statements, failures, failure %, mean seconds, health label."""
    q = queries.filter(between_ts("start_time", as_of - timedelta(hours=hours), as_of) & F.col("warehouse_name").isNotNull())
    g = q.groupBy("warehouse_name").agg(F.count(F.lit(1)).alias("queries"),
                                        F.count_if(F.col("execution_status") != "SUCCESS").alias("failures"),
                                        rounded(F.avg(F.col("total_elapsed_time") / 1000.0), 2).alias("avg_sec"))
    pct = rounded(F.col("failures") * 100.0 / F.col("queries"), 1)
    return g.withColumn("failure_pct", pct).withColumn(
        "health", F.when(pct >= 25, "Unhealthy").when(pct >= 10, "Degraded").otherwise("Healthy"))


def storage_trend(storage: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """STO-1: daily total TB over the window (all databases)."""
    return (storage.filter((F.col("usage_date") >= F.lit((as_of - timedelta(days=days)).date()))
                           & (F.col("usage_date") < F.lit(as_of.date())))
            .groupBy("usage_date")
            .agg(rounded(F.sum("average_database_bytes") / TB, 6).alias("database_tb"),
                 rounded(F.sum("average_failsafe_bytes") / TB, 6).alias("failsafe_tb"),
                 F.countDistinct("database_name").alias("databases")))


def largest_tables(tables: DataFrame, storage_class: str = "active_bytes", limit: int = 20) -> DataFrame:
    """STO-2: largest tables by a storage class (active, time travel, fail-safe, clone)."""
    total = F.col("active_bytes") + F.col("time_travel_bytes") + F.col("failsafe_bytes") + F.col("retained_for_clone_bytes")
    return (tables.select("table_catalog", "table_schema", "table_name",
                          rounded(F.col(storage_class) / 1024.0 ** 3, 3).alias("gb"), rounded(total / 1024.0 ** 3, 3).alias("total_gb"))
            .orderBy(F.desc("gb"), "table_catalog", "table_schema", "table_name").limit(limit))


def org_usage(lineitem: DataFrame, supplier: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """ORG source: account (supplier nation) and region per shipped credit row;
    the dimension joins are left to the planner (AQE broadcasts the small
    sides when their measured size is under the threshold)."""
    s = supplier.select("s_suppkey", "s_nationkey")
    n = nation.select("n_nationkey", "n_name", "n_regionkey")
    r = region.select("r_regionkey", "r_name")
    return (lineitem.select("l_suppkey", "l_shipdate", "l_quantity", "l_discount", "l_returnflag")
            .join(s, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(n, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("n_name").alias("account_name"), F.col("r_name").alias("region"),
                    F.to_date("l_shipdate").alias("usage_date"),
                    F.when(F.col("l_returnflag") == "R", "AI_SERVICES").otherwise("WAREHOUSE_METERING").alias("service_type"),
                    (F.col("l_quantity") / 10).alias("credits_used"),
                    (F.col("l_quantity") * (1 - F.col("l_discount")) / 10).alias("credits_used_compute")))


def org_credits(org: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """ORG-1: credits by account, day and service."""
    return (org.filter((F.col("usage_date") >= F.lit((as_of - timedelta(days=days)).date())) & (F.col("usage_date") < F.lit(as_of.date())))
            .groupBy("account_name", "usage_date", "service_type")
            .agg(rounded(F.sum("credits_used"), 4).alias("credits_used")))


def account_comparison(org: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """ORG-2: per account totals and share of the organisation (the grand
    total is a one-row broadcast, not ``SUM() OVER ()``)."""
    o = org.filter((F.col("usage_date") >= F.lit((as_of - timedelta(days=days)).date())) & (F.col("usage_date") < F.lit(as_of.date())))
    daily = o.groupBy("account_name", "region", "usage_date").agg(F.sum("credits_used").alias("d"),
                                                                   F.sum("credits_used_compute").alias("dc"))
    g = daily.groupBy("account_name", "region").agg(
        F.sum("d").alias("_t"), F.sum("dc").alias("_c"), F.count(F.lit(1)).alias("active_days"),
        F.avg("d").alias("_a"), F.max("d").alias("_m"))
    t = g.agg(F.sum("_t").alias("_org"))
    return g.crossJoin(F.broadcast(t)).select(
        "account_name", "region", rounded("_t", 2).alias("total_credits"), rounded("_c", 2).alias("compute_credits"),
        "active_days", rounded("_a", 2).alias("avg_daily_credits"), rounded("_m", 2).alias("peak_daily_credits"),
        rounded(F.col("_t") * 100.0 / F.nullif(F.col("_org"), F.lit(0)), 1).alias("pct_of_org"))


def ai_user_rollup(ai: DataFrame, as_of: datetime, days: int = 30, price: float = 2.20) -> DataFrame:
    """AIC-1: per user: active days, requests, credits, credits per request,
    30-day projection from the daily mean over active days."""
    g = (ai.filter(lookback("start_time", as_of, days)).groupBy("user_name", F.to_date("start_time").alias("d"))
         .agg(F.count(F.lit(1)).alias("n"), F.sum("credits_used").alias("c")))
    u = g.groupBy("user_name").agg(F.count(F.lit(1)).alias("active_days"), F.sum("n").alias("requests"),
                                   F.sum("c").alias("_c"))
    return u.select("user_name", "active_days", "requests", rounded("_c", 6).alias("credits"),
                    rounded(F.col("_c") / F.col("requests"), 8).alias("credits_per_request"),
                    rounded(F.col("_c") / F.col("active_days") * 30, 6).alias("projected_30d_credits"),
                    rounded(F.col("_c") * price, 4).alias("est_cost_usd"))


def ai_daily_by_function(ai: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """AIC-3: AI credits per day and function."""
    return (ai.filter(lookback("start_time", as_of, days)).groupBy(F.to_date("start_time").alias("usage_date"), "function_name")
            .agg(F.count(F.lit(1)).alias("requests"), rounded(F.sum("credits_used"), 6).alias("credits")))


def ai_quota_state(ai: DataFrame, as_of: datetime, monthly_quota: float = 0.05) -> DataFrame:
    """AIC-5: month-to-date credits per user against a quota: within, near (80 %), over."""
    ms = datetime(as_of.year, as_of.month, 1)
    g = (ai.filter(between_ts("start_time", ms, as_of + timedelta(days=1))).groupBy("user_name")
         .agg(rounded(F.sum("credits_used"), 6).alias("mtd_credits")))
    pct = rounded(F.col("mtd_credits") * 100.0 / monthly_quota, 1)
    return g.withColumn("quota_pct", pct).withColumn(
        "quota_state", F.when(pct > 100, "Over quota").when(pct >= 80, "Near quota").otherwise("Within quota"))


def ai_totals(ai: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """AIC-4: AI totals with the top user (WIN-2 as a max-struct aggregate), one row."""
    per = (ai.filter(lookback("start_time", as_of, days)).groupBy("user_name")
           .agg(F.sum("credits_used").alias("c"), F.count(F.lit(1)).alias("n")))
    return per.agg(rounded(F.sum("c"), 6).alias("credits"), F.sum("n").alias("requests"),
                   F.countDistinct("user_name").alias("users"),
                   F.max_by("user_name", F.struct("c", "user_name")).alias("top_user"),
                   rounded(F.max("c"), 6).alias("top_user_credits"))

