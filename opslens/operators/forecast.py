"""Forecast, contract and trend operators (FCT-*).

All of these work on a *daily series* (one row per entity and day), which the
caller reduces from the raw metering with a partial aggregate first. Windows
then partition by entity and hold at most the look-back's days, so they stay
small at any input size. The reference's sequential loops (compound growth
per day or week) are replaced by their closed forms.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslens.functions.exprs import rounded, safe_div
from opslens.functions.timeutil import date_lit, lookback, midnight, ts_lit


def daily_burn(metering: DataFrame, as_of: datetime, days: int = 90, key: Sequence[str] = ()) -> DataFrame:
    """FCT-1: credits per day (and entity) with the number of service types."""
    days = max(7, int(days or 90))
    svc = (F.countDistinct("service_type").alias("service_count") if "service_type" in metering.columns
           else F.lit(None).cast("bigint").alias("service_count"))
    return (metering.filter(lookback("start_time", as_of, days, end=midnight(as_of)))
            .groupBy(*key, F.to_date("start_time").alias("usage_date"))
            .agg(rounded(F.sum(F.coalesce("credits_used", F.lit(0.0))), 4).alias("daily_credits"), svc))


def _numbered(daily: DataFrame, key: Sequence[str], value: str = "daily_credits") -> DataFrame:
    w_desc = Window.partitionBy(*key).orderBy(F.desc("usage_date"))
    w_asc = Window.partitionBy(*key).orderBy("usage_date")
    return (daily.withColumn("_v", F.coalesce(F.col(value).cast("double"), F.lit(0.0)))
            .withColumn("_rd", F.row_number().over(w_desc))
            .withColumn("_ra", F.row_number().over(w_asc)))


def burn_forecast(daily: DataFrame, as_of: datetime, contract_remaining: float | None = None,
                  contract_total: float | None = None, key: Sequence[str] = ()) -> DataFrame:
    """FCT-2: daily/weekly/monthly burn rate, last-7 vs prior-7 trend (+-10 %),
    confidence by observed days, exhaustion date and utilisation."""
    d = _numbered(daily, key)
    g = d.groupBy(*key).agg(
        F.count(F.lit(1)).alias("observed_days"), F.sum("_v").alias("_tot"),
        F.avg(F.when(F.col("_rd") <= 7, F.col("_v"))).alias("_r7"),
        F.avg(F.when((F.col("_rd") > 7) & (F.col("_rd") <= 14), F.col("_v"))).alias("_p7"))
    n = F.col("observed_days")
    ok = n >= 3
    avg = F.col("_tot") / n
    r7 = F.when(n >= 7, rounded("_r7", 2)).otherwise(F.lit(0.0))
    p7 = F.when(n >= 14, rounded("_p7", 2)).otherwise(F.lit(0.0))
    pct = (F.col("_r7") - F.col("_p7")) / F.col("_p7") * 100
    trend = (F.when(~ok, "unknown")
             .when(n >= 14, F.when(F.col("_p7") > 0,
                                   F.when(pct > 10, "accelerating").when(pct < -10, "decelerating").otherwise("stable"))
                   .otherwise("stable"))
             .when(n >= 7, "stable").otherwise("unknown"))
    conf = F.when(n >= 14, F.when(n >= 30, "high").otherwise("medium")).when(n >= 7, "medium").otherwise("low")
    out = g.select(
        *key, "observed_days",
        F.when(ok, rounded(avg, 2)).otherwise(0.0).alias("daily_burn_rate"),
        F.when(ok, rounded(avg * 7, 2)).otherwise(0.0).alias("weekly_burn_rate"),
        F.when(ok, rounded(avg * 30, 2)).otherwise(0.0).alias("monthly_burn_rate"),
        F.when(ok, trend).otherwise("unknown").alias("burn_trend"),
        F.when(ok & (n >= 14) & (F.col("_p7") > 0), rounded(pct, 1)).otherwise(0.0).alias("burn_trend_pct"),
        F.when(ok, conf).otherwise("low").alias("confidence"),
        F.when(ok, r7).otherwise(0.0).alias("recent_7d_avg"),
        F.when(ok, p7).otherwise(0.0).alias("prior_7d_avg"),
        F.when(ok, avg).alias("_avg"), F.col("_tot"))
    rate = F.when(F.col("recent_7d_avg") > 0, F.col("recent_7d_avg")).otherwise(F.col("_avg"))
    if contract_remaining and contract_remaining > 0:
        left = F.when(rate > 0, F.floor(F.lit(float(contract_remaining)) / rate).cast("bigint"))
        out = out.withColumn("days_remaining", left).withColumn(
            "projected_exhaustion_date", F.date_add(date_lit(as_of), F.col("days_remaining").cast("int")))
    else:
        out = (out.withColumn("days_remaining", F.lit(None).cast("bigint"))
               .withColumn("projected_exhaustion_date", F.lit(None).cast("date")))
    if contract_total and contract_total > 0:
        if contract_remaining is not None:
            util = F.lit(round((contract_total - contract_remaining) / contract_total * 100, 1))
        else:
            util = F.when(F.col("_tot") > 0, rounded(F.col("_tot") / contract_total * 100, 1))
        out = out.withColumn("utilization_pct", F.when(F.col("observed_days") >= 3, util).cast("double"))
    else:
        out = out.withColumn("utilization_pct", F.lit(None).cast("double"))
    return out.drop("_avg", "_tot")


def month_end_projection(metering: DataFrame, as_of: datetime, price: float = 3.68,
                         key: Sequence[str] = ()) -> DataFrame:
    """FCT-4: month-end credits under a flat scenario (recent 7-day mean for the
    remaining days) and a growth scenario (first-3 vs last-3 day growth per
    day, compounded: closed-form geometric sum instead of a loop)."""
    today = midnight(as_of)
    month_start = today.replace(day=1)
    nxt = (month_start.replace(day=28) + timedelta(days=4)).replace(day=1)
    remaining = max(0, (nxt - timedelta(days=1) - today).days)
    daily = (metering.filter((F.col("start_time") >= ts_lit(month_start)) & (F.col("start_time") < ts_lit(today)))
             .groupBy(*key, F.to_date("start_time").alias("usage_date"))
             .agg(rounded(F.sum(F.coalesce("credits_used", F.lit(0.0))), 4).alias("daily_credits")))
    d = _numbered(daily.withColumn("daily_credits", F.greatest(F.col("daily_credits"), F.lit(0.0))), key)
    g = d.groupBy(*key).agg(
        F.count(F.lit(1)).alias("days_observed"), F.sum("_v").alias("consumed"),
        F.avg(F.when(F.col("_rd") <= 7, F.col("_v"))).alias("_avg"),
        (F.sum(F.when(F.col("_ra") <= 3, F.col("_v"))) / 3).alias("_f3"),
        (F.sum(F.when(F.col("_rd") <= 3, F.col("_v"))) / 3).alias("_l3"))
    n = F.col("days_observed")
    growth = F.when((n >= 7) & (F.col("_f3") > 0),
                    (F.col("_l3") - F.col("_f3")) / F.col("_f3") / F.greatest(F.lit(1), n - 3)).otherwise(F.lit(0.0))
    g = g.withColumn("_g", growth)
    q = 1 + F.col("_g")
    geo = F.when(F.col("_g") == 0, F.lit(float(remaining))).otherwise(
        (F.pow(q, F.lit(remaining + 1)) - q) / F.col("_g"))
    flat = F.col("consumed") + F.col("_avg") * remaining
    trend = F.col("consumed") + F.col("_avg") * geo
    ok = n >= 3
    return g.select(
        *key,
        F.when(ok, rounded(flat, 1)).otherwise(0.0).alias("flat_projection_credits"),
        F.when(ok, rounded(trend, 1)).otherwise(0.0).alias("trend_projection_credits"),
        F.when(ok, rounded(flat * price, 0)).otherwise(0.0).alias("flat_projection_cost"),
        F.when(ok, rounded(trend * price, 0)).otherwise(0.0).alias("trend_projection_cost"),
        F.when(ok, n).otherwise(0).alias("days_observed"),
        F.when(ok, F.lit(remaining)).otherwise(0).alias("days_remaining"),
        F.when(ok, rounded("_avg", 1)).otherwise(0.0).alias("daily_avg_recent"),
        F.when(ok, rounded(F.col("_g") * 100, 2)).otherwise(0.0).alias("growth_rate_daily"),
        F.when(~ok, "insufficient_data").when(n >= 20, "high").when(n >= 10, "medium").otherwise("low").alias("confidence"),
        F.when(ok, rounded("consumed", 1)).alias("consumed_so_far"),
        F.when(ok, rounded(F.col("consumed") * price, 0)).alias("consumed_cost"))


def calendar_fill(daily: DataFrame, start: datetime, end: datetime, key: Sequence[str] = (),
                  value: str = "daily_credits") -> DataFrame:
    """Gap-fill a daily series with 0 for days in ``[start, end)`` (FCT-5).
    The calendar is generated by ``sequence`` + ``explode`` and joined; per
    entity, the entities come from the data."""
    cal = daily.sparkSession.range(1).select(
        F.explode(F.sequence(date_lit(start), date_lit(end - timedelta(days=1)))).alias("usage_date"))
    if key:
        cal = daily.select(*key).distinct().crossJoin(cal)
    return (cal.join(daily.select(*key, "usage_date", value), [*key, "usage_date"], "left")
            .withColumn(value, F.coalesce(F.col(value), F.lit(0.0))))


def projection_30d(metering: DataFrame, as_of: datetime, key: Sequence[str] = ()) -> DataFrame:
    """FCT-5: last 30 complete days gap-filled with 0, mean, 30-day projection."""
    today = midnight(as_of)
    daily = daily_burn(metering, as_of, 30, key).drop("service_count")
    filled = calendar_fill(daily, today - timedelta(days=30), today, key)
    return (filled.groupBy(*key)
            .agg(F.count_if(F.col("daily_credits") > 0).alias("active_days"),
                 F.count(F.lit(1)).alias("calendar_days"),
                 rounded(F.avg("daily_credits"), 4).alias("avg_daily_credits"),
                 rounded(F.avg("daily_credits") * 30, 2).alias("projected_30d_credits")))


def contract_pacing(metering: DataFrame, as_of: datetime, contract_credits: float,
                    contract_start: datetime, contract_end: datetime) -> DataFrame:
    """FCT-6: gap-filled contract-to-date use and four end-of-term projections
    (term rate, last 7 d, last 30 d, weekday/weekend seasonal), pacing ratio
    and runway date, as one row."""
    today = midnight(as_of)
    daily = (metering.filter((F.col("start_time") >= ts_lit(contract_start)) & (F.col("start_time") < ts_lit(today)))
             .groupBy(F.to_date("start_time").alias("usage_date"))
             .agg(F.sum(F.coalesce("credits_used", F.lit(0.0))).alias("daily_credits")))
    filled = calendar_fill(daily, contract_start, today)
    elapsed = max(1, (today - contract_start).days)
    left = max(0, (contract_end - today).days)
    total_days = max(1, (contract_end - contract_start).days)
    # remaining weekdays / weekend days from today to the end of the term (python calendar, no data)
    wk_left = sum(1 for i in range(left) if (today + timedelta(days=i)).weekday() < 5)
    we_left = left - wk_left
    is_we = F.dayofweek("usage_date").isin(1, 7)
    t7, t30 = date_lit(today - timedelta(days=7)), date_lit(today - timedelta(days=30))
    one = filled.agg(
        F.sum("daily_credits").alias("used"),
        F.avg(F.when(F.col("usage_date") >= t7, F.col("daily_credits"))).alias("r7"),
        F.avg(F.when(F.col("usage_date") >= t30, F.col("daily_credits"))).alias("r30"),
        F.avg(F.when(~is_we & (F.col("usage_date") >= t30), F.col("daily_credits"))).alias("wk"),
        F.avg(F.when(is_we & (F.col("usage_date") >= t30), F.col("daily_credits"))).alias("we"))
    rate_term = F.col("used") / elapsed
    runway = F.when(F.col("r30") > 0, F.floor((F.lit(contract_credits) - F.col("used")) / F.col("r30")).cast("int"))
    return one.select(
        rounded("used", 2).alias("used_credits"),
        rounded(F.lit(contract_credits) - F.col("used"), 2).alias("remaining_credits"),
        rounded(F.col("used") + rate_term * left, 2).alias("projection_term_rate"),
        rounded(F.col("used") + F.coalesce("r7", F.lit(0.0)) * left, 2).alias("projection_7d"),
        rounded(F.col("used") + F.coalesce("r30", F.lit(0.0)) * left, 2).alias("projection_30d"),
        rounded(F.col("used") + F.coalesce("wk", F.lit(0.0)) * wk_left + F.coalesce("we", F.lit(0.0)) * we_left, 2)
        .alias("projection_seasonal"),
        rounded(F.col("used") / (F.lit(contract_credits) * elapsed / total_days), 4).alias("pacing_ratio"),
        F.when(runway.isNotNull() & (runway >= 0), F.date_add(date_lit(today), runway)).alias("runway_date"))


def wow_delta(daily: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """FCT-7: last 7 values vs the 7 before (or all earlier when fewer than 14),
    direction at +-5 %; needs at least 8 values."""
    d = _numbered(daily, key)
    g = d.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"),
                            F.avg(F.when(F.col("_rd") <= 7, F.col("_v"))).alias("_r"),
                            F.avg(F.when((F.col("_rd") > 7) & (F.col("_rd") <= 14), F.col("_v"))).alias("_p"))
    ok = F.col("_n") >= 8
    pct = (F.col("_r") - F.col("_p")) / F.col("_p") * 100
    valid = ok & (F.col("_p") != 0)
    return g.select(*key,
                    F.when(valid, rounded(pct, 1)).otherwise(0.0).alias("delta_pct"),
                    F.when(valid & (pct > 5), "up").when(valid & (pct < -5), "down").otherwise("flat").alias("direction"),
                    F.when(valid, rounded("_r", 2)).when(ok, F.col("_r")).otherwise(0.0).alias("recent_avg"),
                    F.when(valid, rounded("_p", 2)).when(ok, F.col("_p")).otherwise(0.0).alias("prior_avg"))


def trend_class(daily: DataFrame, key: Sequence[str] = (), periods: int = 3) -> DataFrame:
    """FCT-8: chunk the series into ``len // periods`` sized chunks, compare
    consecutive chunk means: accelerating, decelerating, volatile, stable."""
    d = _numbered(daily, key)
    n = F.count(F.lit(1)).over(Window.partitionBy(*key)) if key else F.count(F.lit(1)).over(Window.partitionBy())
    d = d.withColumn("_n", n).withColumn("_size", F.greatest(F.lit(1), F.floor(F.col("_n") / periods)))
    d = d.withColumn("_chunk", F.floor((F.col("_ra") - 1) / F.col("_size")))
    ch = d.groupBy(*key, "_chunk").agg(F.avg("_v").alias("_avg"), F.first("_n").alias("_n"))
    w = Window.partitionBy(*key).orderBy("_chunk")
    ch = ch.withColumn("_d", F.col("_avg") - F.lag("_avg").over(w))
    g = ch.groupBy(*key).agg(F.max("_n").alias("_n"), F.count("_d").alias("_k"),
                             F.count_if(F.col("_d") > 0).alias("_pos"), F.count_if(F.col("_d") < 0).alias("_neg"),
                             F.sum("_d").alias("_s"), F.sum(F.abs("_d")).alias("_a"))
    cls = (F.when(F.col("_n") < periods + 1, "insufficient")
           .when(F.col("_k") < 1, "insufficient")
           .when(F.col("_pos") == F.col("_k"), "accelerating")
           .when(F.col("_neg") == F.col("_k"), "decelerating")
           .when(F.abs(F.col("_s")) / F.greatest(F.lit(1.0), F.col("_a")) < 0.3, "volatile")
           .otherwise("stable"))
    return g.select(*key, F.col("_n").alias("points"), cls.alias("trend_class"))


def moving_average(daily: DataFrame, key: Sequence[str] = (), window: int = 7,
                   value: str = "daily_credits") -> DataFrame:
    """FCT-9 / WIN-11: trailing mean over ``window`` rows, partial at the
    start; a series shorter than the window is returned as is."""
    w = Window.partitionBy(*key).orderBy("usage_date").rowsBetween(-(window - 1), 0)
    n = F.count(F.lit(1)).over(Window.partitionBy(*key))
    v = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    return daily.select(*key, "usage_date", F.col(value),
                        F.when(n < window, v).otherwise(rounded(F.avg(v).over(w), 2)).alias("moving_avg"))


def burn_label(short_avg: Column, long_avg: Column, tolerance: float = 0.15) -> Column:
    """FCT-10: Accelerating / Cooling / Stable from short vs long burn."""
    s, lg = F.coalesce(short_avg, F.lit(0.0)), F.coalesce(long_avg, F.lit(0.0))
    delta = (s - lg) / lg
    return (F.when((lg <= 0) & (s <= 0), "No data").when(lg <= 0, "Accelerating")
            .when(delta > tolerance, "Accelerating").when(delta < -tolerance, "Cooling").otherwise("Stable"))


def warehouse_burn_labels(metering: DataFrame, as_of: datetime) -> DataFrame:
    """FCT-10 per warehouse: last-7-day vs last-30-day mean daily credits."""
    today = midnight(as_of)
    t7 = ts_lit(today - timedelta(days=7))
    m = metering.filter(lookback("start_time", as_of, 30, end=today))
    g = m.groupBy("warehouse_name").agg(
        (F.sum(F.when(F.col("start_time") >= t7, F.col("credits_used")).otherwise(0.0)) / 7).alias("_s"),
        (F.sum("credits_used") / 30).alias("_l"))
    return g.select("warehouse_name", rounded("_s", 4).alias("avg_7d"), rounded("_l", 4).alias("avg_30d"),
                    burn_label(F.col("_s"), F.col("_l")).alias("burn_label"))


def capacity_exhaustion(growth_pct: Column, current: Column, capacity: Column, max_weeks: int | None = None):
    """FCT-11: weeks until ``current`` reaches ``capacity`` growing by
    ``growth_pct`` per week (closed form of the compounding loop, checked
    against exact powers), and urgency. Beyond ``max_weeks``, where given, null."""
    g = 1 + growth_pct / 100
    near = F.ceil(F.log(capacity / current) / F.log(g))
    # the logarithm may land a hair beside a whole number of weeks
    w = (F.when(current * F.pow(g, near - 1) >= capacity, near - 1)
         .when(current * F.pow(g, near) < capacity, near + 1).otherwise(near)).cast("int")
    weeks = (F.when((growth_pct <= 0) | (current <= 0), F.lit(None).cast("int"))
             .when(current >= capacity, F.lit(0))
             .when(F.lit(max_weeks is not None) & (w >= (max_weeks or 0)), F.lit(None).cast("int")).otherwise(w))
    urgency = (F.when(weeks.isNull(), "none").when(weeks == 0, "immediate")
               .when(weeks <= 4, "critical").when(weeks <= 12, "plan").otherwise("monitor"))
    return weeks, urgency, F.coalesce(weeks <= 12, F.lit(False))


def safe_pct(a: Column, b: Column) -> Column:
    return safe_div(a - b, b) * 100
