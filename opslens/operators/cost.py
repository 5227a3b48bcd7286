"""Cost attribution and bill analysis (CST-*).

Design notes for scale:

* Per-query credit allocation (CST-1) needs, for every query, its
  warehouse-hour's total execution time. The reference computes it with
  ``SUM() OVER (PARTITION BY warehouse, hour)``; a window puts every row of a
  hot warehouse-hour into one task. Here the hour totals are a partial
  aggregate (combined map-side) joined back on (warehouse, hour); the
  aggregated side is bounded by warehouses x hours, and AQE broadcasts it
  when its measured size is under the threshold, otherwise shuffles with
  skew-split enabled.
* Two-period comparisons (current vs prior) are one scan with conditional
  aggregates instead of two scans and a full outer join.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.functions.exprs import col, rounded, safe_div
from opslens.functions.timeutil import between_ts, lookback, midnight, trunc, ts_lit

# List prices per credit and hourly credits per warehouse size.
CREDIT_PRICE = 3.68
AI_CREDIT_PRICE = 2.20
SIZE_CREDITS_PER_HOUR = {
    "X-Small": 1, "Small": 2, "Medium": 4, "Large": 8, "X-Large": 16,
    "2X-Large": 32, "3X-Large": 64, "4X-Large": 128, "5X-Large": 256, "6X-Large": 512,
}
# Managed (serverless) service types as the metering feed spells them; a caller may pass others.
MANAGED_SERVICES = [
    "AUTOMATIC_CLUSTERING", "COPY_FILES", "MATERIALIZED_VIEW", "QUERY_ACCELERATION", "SEARCH_OPTIMIZATION", "SERVERLESS_ALERTS",
    "SERVERLESS_TASK", "SNOWPIPE", "SNOWPIPE_STREAMING", "SNOWPARK_CONTAINER_SERVICES", "REPLICATION",
]


def size_rate(size: str | Column) -> Column:
    """SCA-20: hourly credits for a warehouse size (1 when unknown)."""
    s = col(size)
    out = None
    for k, v in SIZE_CREDITS_PER_HOUR.items():
        out = F.when(s == k, F.lit(v)) if out is None else out.when(s == k, F.lit(v))
    return out.otherwise(F.lit(1))


def is_ai_service(service: str | Column) -> Column:
    """AI service test. 'AI' must be a whole token: the plain substring test
    also matches CONTAINER (SURVEY 2.27 fix)."""
    u = F.upper(col(service))
    return u.contains("INTELLIGENCE") | u.rlike("(^|[^A-Z])AI([^A-Z]|$)")


def service_category(service: str | Column, managed: Sequence[str] = tuple(MANAGED_SERVICES)) -> Column:
    """CST-9: display category of a service type (fixed labels)."""
    u = F.upper(F.coalesce(col(service), F.lit("UNKNOWN")))
    return (F.when(is_ai_service(u), "AI Services")
            .when(u.isin(*managed), "Serverless / Managed Compute")
            .when(u.contains("STORAGE"), "Storage")
            .when(u.contains("DATA_TRANSFER") | u.contains("PRIVATELINK"), "Data Transfer / Network")
            .when(u == "WAREHOUSE_METERING", "Warehouse")
            .otherwise("Other"))


def service_rate(service: str | Column, price: float = CREDIT_PRICE, ai_price: float = AI_CREDIT_PRICE) -> Column:
    return F.when(is_ai_service(F.upper(F.coalesce(col(service), F.lit("")))), F.lit(ai_price)).otherwise(F.lit(price))


@dataclass
class RateTable:
    """CST-8 rate sheet: exact service types, then substring either way in
    sheet order, then the AI keyword rate, then the compute price."""
    rates: dict[str, float] = field(default_factory=dict)
    price: float = CREDIT_PRICE
    ai_price: float = AI_CREDIT_PRICE

    def rate(self, service: str | Column) -> Column:
        u = F.upper(F.trim(F.coalesce(col(service), F.lit(""))))
        out = None

        def add(cond, v):
            nonlocal out
            out = F.when(cond, F.lit(float(v))) if out is None else out.when(cond, F.lit(float(v)))

        for k, v in self.rates.items():
            add(u == k.upper(), v)
        for k, v in self.rates.items():
            add(u.contains(k.upper()) | F.lit(k.upper()).contains(u), v)
        add(u.contains("INTELLIGENCE") | u.contains("TOKEN") | u.rlike("(^|[^A-Z])AI([^A-Z]|$)"), self.ai_price)
        return out.otherwise(F.lit(float(self.price)))


def price_credits(df: DataFrame, credits: str, service: str | None = None,
                  rates: RateTable | None = None) -> DataFrame:
    """CST-8: add ``<credits>_cost_usd`` right after the credit column. With a
    service column the rate is per row; without it, the compute price."""
    rates = rates or RateTable()
    cost_col = f"{credits}_cost_usd"
    rate = rates.rate(service) if service else F.lit(rates.price)
    cost = rounded(F.coalesce(F.col(credits).cast("double"), F.lit(0.0)) * rate, 2).alias(cost_col)
    cols = []
    for c in df.columns:
        if c == cost_col:
            continue
        cols.append(F.col(c))
        if c == credits:
            cols.append(cost)
    return df.select(*cols)


# --------------------------------------------------------------------------
# CST-1 per-query credits
# --------------------------------------------------------------------------

def hourly_compute_credits(metering: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Metered compute credits per (warehouse, hour) in ``[start, end)``."""
    return (metering.filter(between_ts("start_time", start, end))
            .groupBy("warehouse_name", trunc("hour", "start_time").alias("hour_bucket"))
            .agg(F.sum(F.coalesce("credits_used_compute", "credits_used")).alias("hourly_compute_credits")))


def per_query_credits(queries: DataFrame, metering: DataFrame, as_of: datetime, days: int = 7,
                      hours: int | None = None, include_recent: bool = False,
                      attribution: DataFrame | None = None, keep: Sequence[str | Column] = ()) -> DataFrame:
    """CST-1: credits per query. Official attribution when present, else the
    warehouse-hour's metered compute credits times the query's share of that
    hour's execution time. Window ends 24 h before ``as_of`` unless
    ``include_recent`` (partial billing hours).

    ``keep`` carries columns of the statement along, so that a caller that
    groups by them needs no second, unpruned read of the history to join to."""
    start = as_of - (timedelta(hours=hours) if hours else timedelta(days=days))
    end = as_of if include_recent else as_of - timedelta(hours=24)
    q = (queries.filter(between_ts("start_time", start, end) & F.col("warehouse_name").isNotNull()
                        & (F.col("execution_time") > 0))
         .select("query_id", "warehouse_name", trunc("hour", "start_time").alias("hour_bucket"),
                 F.col("execution_time").alias("exec_ms"), *keep))
    kept = [c for c in q.columns if c not in ("query_id", "warehouse_name", "hour_bucket", "exec_ms")]
    hour_exec = q.groupBy("warehouse_name", "hour_bucket").agg(F.sum("exec_ms").alias("hour_total_exec_ms"))
    m = hourly_compute_credits(metering, start, end)
    share = (F.coalesce(F.col("hourly_compute_credits"), F.lit(0.0)) * F.col("exec_ms")
             / F.nullif(F.col("hour_total_exec_ms"), F.lit(0)))
    j = (q.join(hour_exec, ["warehouse_name", "hour_bucket"], "inner")
         .join(m, ["warehouse_name", "hour_bucket"], "left"))
    if attribution is not None:
        a = (attribution.filter(between_ts("start_time", start, end))
             .groupBy("query_id")
             .agg(rounded(F.sum(F.coalesce("credits_attributed_compute", F.lit(0.0))
                                + F.coalesce("credits_used_query_acceleration", F.lit(0.0))), 6)
                  .alias("official_attributed_compute_credits")))
        j = j.join(a, "query_id", "left")
        official = F.col("official_attributed_compute_credits")
        source = F.when(official.isNotNull(), "QUERY_ATTRIBUTION").otherwise("ALLOCATED")
    else:
        official = F.lit(None).cast("double")
        source = F.lit("ALLOCATED")
    return j.select("query_id", "warehouse_name", "hour_bucket",
                    rounded(share, 6).alias("allocated_metered_credits"),
                    official.alias("official_attributed_compute_credits"),
                    source.alias("credit_source"),
                    rounded(F.coalesce(official, share), 6).alias("metered_credits"), *kept)


# --------------------------------------------------------------------------
# CST-2 service cost lens
# --------------------------------------------------------------------------

def service_cost_lens(service: DataFrame, as_of: datetime, days: int = 7,
                      price: float = CREDIT_PRICE, ai_price: float = AI_CREDIT_PRICE) -> DataFrame:
    """CST-2: per service type, current vs prior ``days`` (settled 24 h
    before ``as_of``), category, rate, deltas and observed days."""
    days = max(1, int(days or 7))
    settled = as_of - timedelta(hours=24)
    cut = settled - timedelta(days=days)
    s = (service.filter(between_ts("start_time", settled - timedelta(days=2 * days), settled))
         .select(F.to_date("start_time").alias("usage_date"),
                 F.upper(F.coalesce("service_type", F.lit("UNKNOWN"))).alias("service_type"),
                 F.coalesce("credits_used", F.lit(0.0)).alias("total_credits"),
                 F.coalesce(F.col("credits_used_compute") if "credits_used_compute" in service.columns
                            else F.lit(None).cast("double"), F.lit(0.0)).alias("compute_credits"),
                 F.coalesce(F.col("credits_used_cloud_services") if "credits_used_cloud_services" in service.columns
                            else F.lit(None).cast("double"), F.lit(0.0)).alias("cloud_credits"))
         # one row for each day and service first: the category and rate patterns then run on those
         .groupBy("usage_date", "service_type")
         .agg(*[F.sum(c).alias(c) for c in ("total_credits", "compute_credits", "cloud_credits")], F.count(F.lit(1)).alias("rows")))
    cur = F.col("usage_date").cast("timestamp_ntz") > ts_lit(cut)
    rate = service_rate("service_type", price, ai_price)

    def cs(x):
        return F.sum(F.when(cur, x).otherwise(F.lit(0.0)))

    def ps(x):
        return F.sum(F.when(~cur, x).otherwise(F.lit(0.0)))

    g = (s.groupBy(service_category("service_type").alias("service_category"), "service_type")
         .agg(F.max(rate).alias("rate_usd"),
              cs(F.col("total_credits")).alias("_c"), ps(F.col("total_credits")).alias("_p"),
              cs(F.col("compute_credits")).alias("_cc"), cs(F.col("cloud_credits")).alias("_cl"),
              cs(F.col("total_credits") * rate).alias("_cu"), ps(F.col("total_credits") * rate).alias("_pu"),
              F.countDistinct(F.when(cur, F.col("usage_date"))).alias("observed_days"),
              F.sum(F.when(cur, F.col("rows")).otherwise(F.lit(0))).alias("metering_rows"),
              F.sum("total_credits").alias("_t"), F.sum("compute_credits").alias("_tc"),
              F.sum("cloud_credits").alias("_tl"))
         .filter((F.abs("_t") > 0) | (F.abs("_tc") > 0) | (F.abs("_tl") > 0)))
    return g.select("service_category", "service_type", "rate_usd",
                    rounded("_c", 4).alias("credits_billed"), rounded("_p", 4).alias("credits_billed_prior"),
                    rounded(F.col("_c") - F.col("_p"), 4).alias("credit_delta"),
                    F.when(F.col("_p") == 0, F.lit(None).cast("double"))
                    .otherwise(rounded(safe_div(F.col("_c") - F.col("_p"), "_p") * 100, 2)).alias("pct_delta"),
                    rounded("_cc", 4).alias("credits_used_compute"),
                    rounded("_cl", 4).alias("credits_used_cloud_services"),
                    rounded("_cu", 2).alias("estimated_cost_usd"), rounded("_pu", 2).alias("prior_estimated_cost_usd"),
                    rounded(F.col("_cu") - F.col("_pu"), 2).alias("cost_delta_usd"),
                    "observed_days", "metering_rows")


# --------------------------------------------------------------------------
# CST-3 idle credits, CST-6 reconciliation, CST-7 live estimate
# --------------------------------------------------------------------------

def idle_warehouse_credits(metering: DataFrame, queries: DataFrame, as_of: datetime, days: int = 7,
                           min_idle_credits: float = 1.0) -> DataFrame:
    """CST-3 / REC-1: metered hours with no query, per warehouse. The
    'LEFT JOIN ... count = 0' of the reference is a left-anti join on
    (warehouse, hour) against the distinct active hours."""
    start, end = as_of - timedelta(days=days), as_of - timedelta(hours=24)
    m = hourly_compute_credits(metering, start, end)
    active = (queries.filter(between_ts("start_time", start, end) & F.col("warehouse_name").isNotNull())
              .select("warehouse_name", trunc("hour", "start_time").alias("hour_bucket")).distinct())
    idle = m.join(active, ["warehouse_name", "hour_bucket"], "left_anti")
    return (idle.groupBy("warehouse_name")
            .agg(rounded(F.sum("hourly_compute_credits"), 4).alias("idle_credits"),
                 F.count(F.lit(1)).alias("idle_hours"))
            .filter(F.col("idle_credits") > float(min_idle_credits)))


def cost_reconciliation(metering: DataFrame, queries: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """CST-6: metered vs allocated credits per warehouse and day, variance,
    status (tolerance max(0.05, 5 %))."""
    days = max(1, int(days or 30))
    start, end = as_of - timedelta(days=days), as_of - timedelta(hours=24)
    metered = (metering.filter(between_ts("start_time", start, end))
               .groupBy(trunc("day", "start_time").alias("usage_day"), "warehouse_name")
               .agg(rounded(F.sum("credits_used"), 6).alias("exact_metered_credits")))
    # the hour already gives the day; both sides are sums by (day, warehouse) before they meet
    shares = (per_query_credits(queries, metering, as_of, days=days)
              .groupBy(trunc("day", "hour_bucket").alias("usage_day"), "warehouse_name")
              .agg(F.sum(F.coalesce("metered_credits", F.lit(0.0))).alias("_m"),
                   F.sum(F.coalesce("allocated_metered_credits", F.lit(0.0))).alias("_a")))
    counts = (queries.filter(between_ts("start_time", start, end) & F.col("warehouse_name").isNotNull())
              .groupBy(trunc("day", "start_time").alias("usage_day"), "warehouse_name")
              .agg(F.count(F.lit(1)).alias("query_count")))
    allocated = counts.join(shares, ["usage_day", "warehouse_name"], "left").select(
        "usage_day", "warehouse_name", "query_count",
        rounded(F.coalesce("_m", F.lit(0.0)), 6).alias("allocated_query_credits"),
        rounded(F.coalesce("_a", F.lit(0.0)), 6).alias("allocated_share_credits"))
    j = metered.join(allocated, ["usage_day", "warehouse_name"], "full")
    m = F.coalesce("exact_metered_credits", F.lit(0.0))
    a = F.coalesce("allocated_query_credits", F.lit(0.0))
    n = F.coalesce("query_count", F.lit(0))
    return j.select("usage_day", "warehouse_name", n.alias("query_count"), m.alias("exact_metered_credits"),
                    a.alias("allocated_query_credits"),
                    F.coalesce("allocated_share_credits", F.lit(0.0)).alias("allocated_share_credits"),
                    rounded(m - a, 6).alias("variance_credits"),
                    rounded(safe_div(100 * F.abs(m - a), m), 2).alias("variance_pct"),
                    F.when(m == 0, "No metering")
                    .when(F.abs(m - a) <= F.greatest(F.lit(0.05), m * 0.05), "Reconciled")
                    .when(n == 0, "Idle or non-query warehouse usage")
                    .otherwise("Variance review").alias("reconciliation_status"))


def live_credit_estimate(running: DataFrame, as_of: datetime) -> DataFrame:
    """CST-7: estimated credits of running queries: size rate x seconds / 3600."""
    sec = F.coalesce(F.col("execution_time") / 1000.0, F.col("total_elapsed_time") / 1000.0, F.lit(0.0))
    return running.withColumn("estimated_credits", rounded(size_rate("warehouse_size") * sec / 3600.0, 6))


# --------------------------------------------------------------------------
# CST-10..14 bill analysis over hourly metering
# --------------------------------------------------------------------------

def bill_summary(metering: DataFrame, cur: tuple[datetime, datetime], prior: tuple[datetime, datetime]) -> DataFrame:
    """CST-10: credits, active warehouses and active days for two explicit periods."""
    period = (F.when(between_ts("start_time", *cur), "CURRENT")
              .when(between_ts("start_time", *prior), "PRIOR"))
    lo, hi = min(cur[0], prior[0]), max(cur[1], prior[1])
    m = (metering.filter(between_ts("start_time", lo, hi))
         .withColumn("period", period).filter(F.col("period").isNotNull()))
    # the two ranges may overlap: a row in both counts in both periods
    both = between_ts("start_time", *cur) & between_ts("start_time", *prior)
    m = m.unionByName(m.filter(both).withColumn("period", F.lit("PRIOR")))
    return (m.groupBy("period")
            .agg(rounded(F.sum("credits_used"), 4).alias("credits"),
                 F.countDistinct("warehouse_name").alias("active_warehouses"),
                 F.countDistinct(F.to_date("start_time")).alias("active_days")))


def warehouse_period_delta(metering: DataFrame, cur: tuple[datetime, datetime],
                           prior: tuple[datetime, datetime], limit: int = 25) -> DataFrame:
    """CST-11: per warehouse current vs prior credits; top ``limit`` by
    absolute delta. One scan with conditional sums replaces the full join."""
    lo, hi = min(cur[0], prior[0]), max(cur[1], prior[1])
    c_in, p_in = between_ts("start_time", *cur), between_ts("start_time", *prior)
    g = (metering.filter(between_ts("start_time", lo, hi))
         .groupBy("warehouse_name")
         .agg(F.sum(F.when(c_in, F.col("credits_used"))).alias("_c"),
              F.sum(F.when(p_in, F.col("credits_used"))).alias("_p"))
         .filter(F.col("_c").isNotNull() | F.col("_p").isNotNull()))
    c, p = F.coalesce("_c", F.lit(0.0)), F.coalesce("_p", F.lit(0.0))
    return (g.select("warehouse_name", rounded(c, 4).alias("current_credits"), rounded(p, 4).alias("prior_credits"),
                     rounded(c - p, 4).alias("credit_delta"),
                     F.when(p == 0, F.lit(None).cast("double"))
                     .otherwise(rounded(safe_div(c - F.col("_p"), "_p") * 100, 2)).alias("pct_delta"),
                     F.abs(c - p).alias("_abs"))
            .orderBy(F.desc("_abs"), "warehouse_name").limit(limit).drop("_abs"))


def cost_cockpit(metering: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """CST-12: one row: current and prior credits, active warehouses, the
    warehouse with the largest increase."""
    a, b = as_of - timedelta(days=days), as_of - timedelta(days=2 * days)
    cur = F.col("start_time") >= ts_lit(a)
    per_wh = (metering.filter(between_ts("start_time", b, as_of))
              .groupBy("warehouse_name")
              .agg(F.sum(F.when(cur, F.coalesce("credits_used", F.lit(0.0))).otherwise(0.0)).alias("cur"),
                   F.sum(F.when(~cur, F.coalesce("credits_used", F.lit(0.0))).otherwise(0.0)).alias("pri"))
              .withColumn("delta", F.col("cur") - F.col("pri")))
    return per_wh.agg(rounded(F.sum("cur"), 4).alias("current_credits"),
                      rounded(F.sum("pri"), 4).alias("prior_credits"),
                      F.count_if(F.col("cur") > 0).alias("active_warehouses"),
                      F.max_by("warehouse_name", F.struct("delta", F.col("warehouse_name"))).alias("top_increase_warehouse"),
                      rounded(F.max("delta"), 4).alias("top_increase_credits"))


def daily_credit_trend(metering: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """CST-14: credits per day."""
    return (metering.filter(lookback("start_time", as_of, days, end=as_of))
            .groupBy(F.to_date("start_time").alias("usage_date"))
            .agg(rounded(F.sum("credits_used"), 4).alias("credits_used"),
                 F.countDistinct("warehouse_name").alias("active_warehouses")))


def run_rate(metering: DataFrame, as_of: datetime, price: float = CREDIT_PRICE) -> DataFrame:
    """CST-13: complete-day run rates (7 d, 30 d), month-end projection,
    the same 7 days a year ago, and the top riser of the last 7 days vs the
    7 before; one scan with conditional aggregates, one row."""
    today = midnight(as_of)
    d7, d14, d30 = today - timedelta(days=7), today - timedelta(days=14), today - timedelta(days=30)
    ly_end, ly_start = today - timedelta(days=365), today - timedelta(days=372)
    month_start = today.replace(day=1)
    nxt = (month_start.replace(day=28) + timedelta(days=4)).replace(day=1)
    days_in_month = (nxt - month_start).days
    t = F.col("start_time")
    c = F.coalesce("credits_used", F.lit(0.0))
    m = metering.filter(((t >= ts_lit(d30)) & (t < ts_lit(today))) | ((t >= ts_lit(ly_start)) & (t < ts_lit(ly_end)))
                        | ((t >= ts_lit(month_start)) & (t < ts_lit(today))))

    def s(lo, hi):
        return F.sum(F.when((t >= ts_lit(lo)) & (t < ts_lit(hi)), c).otherwise(0.0))

    per_wh = (m.groupBy("warehouse_name")
              .agg(s(d7, today).alias("c7"), s(d14, d7).alias("p7"), s(d30, today).alias("c30"),
                   s(ly_start, ly_end).alias("ly7"), s(month_start, today).alias("mtd"))
              .withColumn("rise", F.col("c7") - F.col("p7")))
    elapsed = max(1, (today - month_start).days)
    one = per_wh.agg(F.sum("c7").alias("c7"), F.sum("c30").alias("c30"), F.sum("ly7").alias("ly7"),
                     F.sum("mtd").alias("mtd"),
                     F.max_by("warehouse_name", F.struct("rise", F.col("warehouse_name"))).alias("top_riser"),
                     F.max("rise").alias("top_rise"))
    return one.select(rounded(F.col("c7") / 7, 4).alias("run_rate_7d"),
                      rounded(F.col("c30") / 30, 4).alias("run_rate_30d"),
                      rounded("mtd", 4).alias("month_to_date_credits"),
                      rounded(F.col("mtd") / elapsed * days_in_month, 4).alias("month_end_projection"),
                      rounded(F.col("mtd") / elapsed * days_in_month * price, 2).alias("month_end_projection_usd"),
                      rounded("ly7", 4).alias("same_week_last_year"),
                      F.when(F.col("ly7") > 0, rounded(safe_div(F.col("c7") - F.col("ly7"), "ly7") * 100, 2))
                      .alias("yoy_pct"),
                      F.when(F.col("c7") / 7 > F.col("c30") / 30 * 1.1, "Accelerating")
                      .when(F.col("c7") / 7 < F.col("c30") / 30 * 0.9, "Slowing").otherwise("Steady").alias("run_rate_state"),
                      "top_riser", rounded("top_rise", 4).alias("top_rise_credits"))


# --------------------------------------------------------------------------
# CST-16..26 drivers, leaderboards, monthly spend, shares
# --------------------------------------------------------------------------

def cost_drivers(queries: DataFrame, metering: DataFrame, as_of: datetime, dims: list[str],
                 days: int = 7, price: float = CREDIT_PRICE, limit: int | None = 50) -> DataFrame:
    """CST-16 / CST-17: allocated credits grouped by a dimension list (user,
    role, warehouse, query type, database.schema, called procedure ...)."""
    names = queries.select(*dims).columns
    pqc = per_query_credits(queries, metering, as_of, days=days, keep=[d for d in dims if not isinstance(d, str) or d != "warehouse_name"])
    g = (pqc.groupBy(*names)
         .agg(F.count(F.lit(1)).alias("query_count"),
              rounded(F.sum("metered_credits"), 4).alias("credits"),
              rounded(F.sum("metered_credits") * price, 2).alias("est_cost_usd")))
    if limit:
        g = g.orderBy(F.desc("credits"), *[F.col(c) for c in g.columns if c not in ("credits", "query_count", "est_cost_usd")]).limit(limit)
    return g


def top_users_by_cost(queries: DataFrame, metering: DataFrame, as_of: datetime, days: int = 7,
                      limit: int = 10) -> DataFrame:
    """CST-22: top users by allocated credits with share of the total."""
    pqc = per_query_credits(queries, metering, as_of, days=days, keep=["user_name"])
    per_user = (pqc.groupBy("user_name").agg(F.sum("metered_credits").alias("_c"), F.count(F.lit(1)).alias("query_count")))
    total = per_user.agg(F.sum("_c").alias("_t"))
    return (per_user.crossJoin(F.broadcast(total))
            .select("user_name", "query_count", rounded("_c", 4).alias("credits"),
                    rounded(safe_div(F.col("_c") * 100, "_t"), 2).alias("pct_of_total"))
            .orderBy(F.desc("credits"), "user_name").limit(limit))


def monthly_spend(metering: DataFrame, as_of: datetime, months: int = 12, monthly_budget: float = 1000.0,
                  price: float = CREDIT_PRICE) -> DataFrame:
    """CST-23: credits and cost per month with budget line, over/under and
    cumulative spend. The cumulative window runs over <= ``months`` rows."""
    from pyspark.sql import Window
    start = datetime(as_of.year, as_of.month, 1)
    for _ in range(months - 1):
        start = (start - timedelta(days=1)).replace(day=1)
    g = (metering.filter(between_ts("start_time", start, as_of))
         .groupBy(trunc("month", "start_time").alias("month"))
         .agg(F.sum("credits_used").alias("_c")))
    w = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    cost = F.col("_c") * price
    return g.select("month", rounded("_c", 4).alias("credits"), rounded(cost, 2).alias("cost_usd"),
                    F.lit(float(monthly_budget)).alias("budget_usd"),
                    rounded(cost - monthly_budget, 2).alias("over_under_usd"),
                    F.when(cost > monthly_budget, "Over").otherwise("Within").alias("budget_state"),
                    rounded(F.sum(cost).over(w), 2).alias("cumulative_cost_usd"))


def service_share(service: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """CST-24: consumption share per service type (grand total broadcast as one row)."""
    g = (service.filter(lookback("start_time", as_of, days, end=as_of))
         .groupBy("service_type").agg(F.sum("credits_used").alias("_c")))
    total = g.agg(F.sum("_c").alias("_t"))
    return g.crossJoin(F.broadcast(total)).select(
        "service_type", rounded("_c", 4).alias("credits"),
        rounded(safe_div(F.col("_c") * 100, "_t"), 2).alias("pct_of_total"))


def period_credits(metering: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """CST-26: credits of the period, the prior period and year to date, one row."""
    a, b = as_of - timedelta(days=days), as_of - timedelta(days=2 * days)
    ytd = datetime(as_of.year, 1, 1)
    t = F.col("start_time")
    lo = min(b, ytd)
    m = metering.filter(between_ts("start_time", lo, as_of))
    return m.agg(rounded(F.sum(F.when(t >= ts_lit(a), F.col("credits_used")).otherwise(0.0)), 4).alias("period_credits"),
                 rounded(F.sum(F.when((t >= ts_lit(b)) & (t < ts_lit(a)), F.col("credits_used")).otherwise(0.0)), 4)
                 .alias("prior_period_credits"),
                 rounded(F.sum(F.when(t >= ts_lit(ytd), F.col("credits_used")).otherwise(0.0)), 4).alias("ytd_credits"))


def top_cost_drivers(queries: DataFrame, metering: DataFrame, as_of: datetime, days: int = 7,
                     limit: int = 20) -> DataFrame:
    """CST-25: statements ranked by their elapsed share of the warehouse's
    credits over the window (warehouse credits x user elapsed / warehouse elapsed)."""
    start = as_of - timedelta(days=days)
    q = queries.filter(between_ts("start_time", start, as_of) & F.col("warehouse_name").isNotNull())
    per = q.groupBy("warehouse_name", "user_name", "query_type").agg(
        F.count(F.lit(1)).alias("query_count"), F.sum("total_elapsed_time").alias("_e"))
    wh_e = q.groupBy("warehouse_name").agg(F.sum("total_elapsed_time").alias("_we"))
    wh_c = (metering.filter(between_ts("start_time", start, as_of))
            .groupBy("warehouse_name").agg(F.sum("credits_used").alias("_wc")))
    j = per.join(wh_e, "warehouse_name").join(wh_c, "warehouse_name", "left")
    return (j.select("warehouse_name", "user_name", "query_type", "query_count",
                     rounded(F.col("_e") / 1000.0, 1).alias("elapsed_sec"),
                     rounded(F.coalesce("_wc", F.lit(0.0)) * F.col("_e") / F.nullif(F.col("_we"), F.lit(0)), 4)
                     .alias("est_credits"))
            .orderBy(F.desc("est_credits"), "warehouse_name", "user_name", "query_type").limit(limit))
