"""Registered forecast and trend queries (FCT-*)."""

from __future__ import annotations

from datetime import datetime

from opslens.operators import forecast as fc
from opslens.plans.registry import register
from opslens.sources import testviews as tv
from opslens.sources.testviews import LINEITEM_AS_OF

_DAILY_WH = """
daily AS (SELECT warehouse_name, CAST(start_time AS DATE) AS usage_date,
                 round(sum(coalesce(credits_used, 0)), 4) AS daily_credits
          FROM metering_long WHERE start_time >= TIMESTAMP '{lo}' AND start_time < TIMESTAMP '2001-11-05 00:00:00'
          GROUP BY 1, 2),
nd AS (SELECT *, coalesce(daily_credits, 0) AS v,
              row_number() OVER (PARTITION BY warehouse_name ORDER BY usage_date DESC) AS rd,
              row_number() OVER (PARTITION BY warehouse_name ORDER BY usage_date) AS ra FROM daily)
"""
D90 = "2001-08-07 00:00:00"
D30 = "2001-10-06 00:00:00"


def _wh_daily(spark, sf, days):
    return fc.daily_burn(tv.load(spark, sf, "metering_long"), LINEITEM_AS_OF, days, ["warehouse_name"]).drop("service_count")


@register("daily_burn", "service_metering", op="FCT-1", sql="""
SELECT CAST(start_time AS DATE) AS usage_date, round(sum(coalesce(credits_used, 0)), 4) AS daily_credits,
       count(DISTINCT service_type) AS service_count
FROM service_metering WHERE start_time >= TIMESTAMP '2001-08-07 00:00:00' AND start_time < TIMESTAMP '2001-11-05 00:00:00'
GROUP BY 1
""")
def _(spark, sf):
    return fc.daily_burn(tv.load(spark, sf, "service_metering"), LINEITEM_AS_OF, 90)


_BURN_COLS = """
  observed_days,
  CASE WHEN observed_days >= 3 THEN round(tot / observed_days, 2) ELSE 0 END AS daily_burn_rate,
  CASE WHEN observed_days >= 3 THEN round(tot / observed_days * 7, 2) ELSE 0 END AS weekly_burn_rate,
  CASE WHEN observed_days >= 3 THEN round(tot / observed_days * 30, 2) ELSE 0 END AS monthly_burn_rate,
  CASE WHEN observed_days < 3 THEN 'unknown'
       WHEN observed_days >= 14 THEN CASE WHEN p7 > 0 THEN CASE WHEN (r7 - p7) / p7 * 100 > 10 THEN 'accelerating'
                                                              WHEN (r7 - p7) / p7 * 100 < -10 THEN 'decelerating' ELSE 'stable' END
                                          ELSE 'stable' END
       WHEN observed_days >= 7 THEN 'stable' ELSE 'unknown' END AS burn_trend,
  CASE WHEN observed_days >= 14 AND p7 > 0 THEN round((r7 - p7) / p7 * 100, 1) ELSE 0 END AS burn_trend_pct,
  CASE WHEN observed_days < 3 THEN 'low' WHEN observed_days >= 14 THEN CASE WHEN observed_days >= 30 THEN 'high' ELSE 'medium' END
       WHEN observed_days >= 7 THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN observed_days >= 7 THEN round(r7, 2) ELSE 0 END AS recent_7d_avg,
  CASE WHEN observed_days >= 14 THEN round(p7, 2) ELSE 0 END AS prior_7d_avg
"""


@register("burn_forecast_by_warehouse", "metering_long", op="FCT-2", sql="WITH " + _DAILY_WH.format(lo=D90) + """,
g AS (SELECT warehouse_name, count(*) AS observed_days, sum(v) AS tot, avg(CASE WHEN rd <= 7 THEN v END) AS r7,
             avg(CASE WHEN rd > 7 AND rd <= 14 THEN v END) AS p7 FROM nd GROUP BY 1)
SELECT warehouse_name, """ + _BURN_COLS + """, CAST(NULL AS BIGINT) AS days_remaining,
       CAST(NULL AS DATE) AS projected_exhaustion_date, CAST(NULL AS DOUBLE) AS utilization_pct
FROM g
""")
def _(spark, sf):
    return fc.burn_forecast(_wh_daily(spark, sf, 90), LINEITEM_AS_OF, key=["warehouse_name"])


@register("contract_burn_forecast", "service_metering", op="FCT-2", sql="""
WITH daily AS (SELECT CAST(start_time AS DATE) AS usage_date, round(sum(coalesce(credits_used, 0)), 4) AS daily_credits
               FROM service_metering WHERE start_time >= TIMESTAMP '2001-08-07 00:00:00' AND start_time < TIMESTAMP '2001-11-05 00:00:00'
               GROUP BY 1),
nd AS (SELECT *, coalesce(daily_credits, 0) AS v, row_number() OVER (ORDER BY usage_date DESC) AS rd FROM daily),
g AS (SELECT count(*) AS observed_days, sum(v) AS tot, avg(CASE WHEN rd <= 7 THEN v END) AS r7,
             avg(CASE WHEN rd > 7 AND rd <= 14 THEN v END) AS p7 FROM nd),
b AS (SELECT """ + _BURN_COLS + """, tot FROM g),
c AS (SELECT *, CASE WHEN observed_days >= 3 THEN CASE WHEN recent_7d_avg > 0 THEN recent_7d_avg ELSE tot / observed_days END END AS rate FROM b)
SELECT observed_days, daily_burn_rate, weekly_burn_rate, monthly_burn_rate, burn_trend, burn_trend_pct, confidence,
       recent_7d_avg, prior_7d_avg,
       CASE WHEN rate > 0 THEN CAST(floor(5000.0 / rate) AS BIGINT) END AS days_remaining,
       DATE '2001-11-05' + CAST(CASE WHEN rate > 0 THEN floor(5000.0 / rate) END AS INTEGER) AS projected_exhaustion_date,
       CASE WHEN observed_days >= 3 THEN CAST(75.0 AS DOUBLE) END AS utilization_pct
FROM c
""")
def _(spark, sf):
    daily = fc.daily_burn(tv.load(spark, sf, "service_metering"), LINEITEM_AS_OF, 90).drop("service_count")
    return fc.burn_forecast(daily, LINEITEM_AS_OF, contract_remaining=5000.0, contract_total=20000.0)


MONTH_AS_OF = datetime(2001, 10, 25)


@register("month_end_projection", "metering_long", op="FCT-4", sql="""
WITH daily AS (SELECT warehouse_name, CAST(start_time AS DATE) AS usage_date,
                      greatest(round(sum(coalesce(credits_used, 0)), 4), 0.0) AS daily_credits
               FROM metering_long WHERE start_time >= TIMESTAMP '2001-10-01 00:00:00' AND start_time < TIMESTAMP '2001-10-25 00:00:00'
               GROUP BY 1, 2),
nd AS (SELECT *, coalesce(daily_credits, 0) AS v,
              row_number() OVER (PARTITION BY warehouse_name ORDER BY usage_date DESC) AS rd,
              row_number() OVER (PARTITION BY warehouse_name ORDER BY usage_date) AS ra FROM daily),
g AS (SELECT warehouse_name, count(*) AS n, sum(v) AS consumed, avg(CASE WHEN rd <= 7 THEN v END) AS a,
             sum(CASE WHEN ra <= 3 THEN v END) / 3 AS f3, sum(CASE WHEN rd <= 3 THEN v END) / 3 AS l3 FROM nd GROUP BY 1),
h AS (SELECT *, CASE WHEN n >= 7 AND f3 > 0 THEN (l3 - f3) / f3 / greatest(1, n - 3) ELSE 0.0 END AS gr FROM g),
k AS (SELECT *, consumed + a * 6 AS flat,
             consumed + a * CASE WHEN gr = 0 THEN 6.0 ELSE (pow(1 + gr, 7) - (1 + gr)) / gr END AS trend FROM h)
SELECT warehouse_name,
       CASE WHEN n >= 3 THEN round(flat, 1) ELSE 0 END AS flat_projection_credits,
       CASE WHEN n >= 3 THEN round(trend, 1) ELSE 0 END AS trend_projection_credits,
       CASE WHEN n >= 3 THEN round(flat * 3.68, 0) ELSE 0 END AS flat_projection_cost,
       CASE WHEN n >= 3 THEN round(trend * 3.68, 0) ELSE 0 END AS trend_projection_cost,
       CASE WHEN n >= 3 THEN n ELSE 0 END AS days_observed, CASE WHEN n >= 3 THEN 6 ELSE 0 END AS days_remaining,
       CASE WHEN n >= 3 THEN round(a, 1) ELSE 0 END AS daily_avg_recent,
       CASE WHEN n >= 3 THEN round(gr * 100, 2) ELSE 0 END AS growth_rate_daily,
       CASE WHEN n < 3 THEN 'insufficient_data' WHEN n >= 20 THEN 'high' WHEN n >= 10 THEN 'medium' ELSE 'low' END AS confidence,
       CASE WHEN n >= 3 THEN round(consumed, 1) END AS consumed_so_far,
       CASE WHEN n >= 3 THEN round(consumed * 3.68, 0) END AS consumed_cost
FROM k
""")
def _(spark, sf):
    return fc.month_end_projection(tv.load(spark, sf, "metering_long"), MONTH_AS_OF, key=["warehouse_name"])


@register("projection_30d", "metering_long", op="FCT-5", sql="""
WITH daily AS (SELECT warehouse_name, CAST(start_time AS DATE) AS usage_date, round(sum(coalesce(credits_used, 0)), 4) AS daily_credits
               FROM metering_long WHERE start_time >= TIMESTAMP '2001-10-06 00:00:00' AND start_time < TIMESTAMP '2001-11-05 00:00:00'
               GROUP BY 1, 2),
cal AS (SELECT w.warehouse_name, CAST(d AS DATE) AS usage_date
        FROM (SELECT DISTINCT warehouse_name FROM daily) w,
             (SELECT unnest(generate_series(TIMESTAMP '2001-10-06', TIMESTAMP '2001-11-04', INTERVAL 1 DAY)) AS d) c),
f AS (SELECT cal.warehouse_name, cal.usage_date, coalesce(daily.daily_credits, 0.0) AS daily_credits
      FROM cal LEFT JOIN daily ON cal.warehouse_name = daily.warehouse_name AND cal.usage_date = daily.usage_date)
SELECT warehouse_name, count_if(daily_credits > 0) AS active_days, count(*) AS calendar_days,
       round(avg(daily_credits), 4) AS avg_daily_credits, round(avg(daily_credits) * 30, 2) AS projected_30d_credits
FROM f GROUP BY 1
""")
def _(spark, sf):
    return fc.projection_30d(tv.load(spark, sf, "metering_long"), LINEITEM_AS_OF, ["warehouse_name"])


@register("contract_pacing", "metering_long", op="FCT-6", sql="""
WITH daily AS (SELECT CAST(start_time AS DATE) AS usage_date, sum(coalesce(credits_used, 0)) AS daily_credits
               FROM metering_long WHERE start_time >= TIMESTAMP '2001-01-01 00:00:00' AND start_time < TIMESTAMP '2001-11-05 00:00:00'
               GROUP BY 1),
cal AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2001-01-01', TIMESTAMP '2001-11-04', INTERVAL 1 DAY)) AS DATE) AS usage_date),
f AS (SELECT cal.usage_date, coalesce(daily.daily_credits, 0.0) AS daily_credits FROM cal LEFT JOIN daily USING (usage_date)),
o AS (SELECT sum(daily_credits) AS used,
             avg(CASE WHEN usage_date >= DATE '2001-10-29' THEN daily_credits END) AS r7,
             avg(CASE WHEN usage_date >= DATE '2001-10-06' THEN daily_credits END) AS r30,
             avg(CASE WHEN dayofweek(usage_date) NOT IN (0, 6) AND usage_date >= DATE '2001-10-06' THEN daily_credits END) AS wk,
             avg(CASE WHEN dayofweek(usage_date) IN (0, 6) AND usage_date >= DATE '2001-10-06' THEN daily_credits END) AS we FROM f)
SELECT round(used, 2) AS used_credits, round(60000.0 - used, 2) AS remaining_credits,
       round(used + used / 308 * 57, 2) AS projection_term_rate, round(used + coalesce(r7, 0) * 57, 2) AS projection_7d,
       round(used + coalesce(r30, 0) * 57, 2) AS projection_30d,
       round(used + coalesce(wk, 0) * 41 + coalesce(we, 0) * 16, 2) AS projection_seasonal,
       round(used / (60000.0 * 308 / 365), 4) AS pacing_ratio,
       CASE WHEN r30 > 0 AND floor((60000.0 - used) / r30) >= 0 THEN DATE '2001-11-05' + CAST(floor((60000.0 - used) / r30) AS INTEGER) END AS runway_date
FROM o
""")
def _(spark, sf):
    return fc.contract_pacing(tv.load(spark, sf, "metering_long"), LINEITEM_AS_OF, 60000.0,
                              datetime(2001, 1, 1), datetime(2002, 1, 1))


@register("wow_delta_by_warehouse", "metering_long", op="FCT-7", sql="WITH " + _DAILY_WH.format(lo=D30) + """,
g AS (SELECT warehouse_name, count(*) AS n, avg(CASE WHEN rd <= 7 THEN v END) AS r,
             avg(CASE WHEN rd > 7 AND rd <= 14 THEN v END) AS p FROM nd GROUP BY 1)
SELECT warehouse_name,
       CASE WHEN n >= 8 AND p <> 0 THEN round((r - p) / p * 100, 1) ELSE 0 END AS delta_pct,
       CASE WHEN n >= 8 AND p <> 0 AND (r - p) / p * 100 > 5 THEN 'up'
            WHEN n >= 8 AND p <> 0 AND (r - p) / p * 100 < -5 THEN 'down' ELSE 'flat' END AS direction,
       CASE WHEN n >= 8 AND p <> 0 THEN round(r, 2) WHEN n >= 8 THEN r ELSE 0 END AS recent_avg,
       CASE WHEN n >= 8 AND p <> 0 THEN round(p, 2) WHEN n >= 8 THEN p ELSE 0 END AS prior_avg
FROM g
""")
def _(spark, sf):
    return fc.wow_delta(_wh_daily(spark, sf, 30), ["warehouse_name"])


@register("trend_class_by_warehouse", "metering_long", op="FCT-8", sql="WITH " + _DAILY_WH.format(lo=D90) + """,
c AS (SELECT *, count(*) OVER (PARTITION BY warehouse_name) AS n FROM nd),
c2 AS (SELECT *, floor((ra - 1) / greatest(1, floor(n / 3))) AS chunk FROM c),
ch AS (SELECT warehouse_name, chunk, avg(v) AS a, max(n) AS n FROM c2 GROUP BY 1, 2),
dl AS (SELECT *, a - lag(a) OVER (PARTITION BY warehouse_name ORDER BY chunk) AS d FROM ch),
g AS (SELECT warehouse_name, max(n) AS n, count(d) AS k, count_if(d > 0) AS pos, count_if(d < 0) AS neg,
             sum(d) AS s, sum(abs(d)) AS ab FROM dl GROUP BY 1)
SELECT warehouse_name, n AS points,
       CASE WHEN n < 4 THEN 'insufficient' WHEN k < 1 THEN 'insufficient' WHEN pos = k THEN 'accelerating'
            WHEN neg = k THEN 'decelerating' WHEN abs(s) / greatest(1.0, ab) < 0.3 THEN 'volatile' ELSE 'stable' END AS trend_class
FROM g
""")
def _(spark, sf):
    return fc.trend_class(_wh_daily(spark, sf, 90), ["warehouse_name"])


@register("moving_average_by_warehouse", "metering_long", op="FCT-9", sql="WITH " + _DAILY_WH.format(lo=D30) + """
SELECT warehouse_name, usage_date, daily_credits,
       CASE WHEN count(*) OVER (PARTITION BY warehouse_name) < 7 THEN coalesce(daily_credits, 0)
            ELSE round(avg(coalesce(daily_credits, 0)) OVER (PARTITION BY warehouse_name ORDER BY usage_date
                                                            ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 2) END AS moving_avg
FROM daily
""")
def _(spark, sf):
    return fc.moving_average(_wh_daily(spark, sf, 30), ["warehouse_name"])


@register("warehouse_burn_labels", "metering_long", op="FCT-10", sql="""
WITH g AS (SELECT warehouse_name,
                  sum(CASE WHEN start_time >= TIMESTAMP '2001-10-29 00:00:00' THEN credits_used ELSE 0 END) / 7 AS s,
                  sum(credits_used) / 30 AS l
           FROM metering_long WHERE start_time >= TIMESTAMP '2001-10-06 00:00:00' AND start_time < TIMESTAMP '2001-11-05 00:00:00'
           GROUP BY 1)
SELECT warehouse_name, round(s, 4) AS avg_7d, round(l, 4) AS avg_30d,
       CASE WHEN coalesce(l, 0) <= 0 AND coalesce(s, 0) <= 0 THEN 'No data' WHEN coalesce(l, 0) <= 0 THEN 'Accelerating'
            WHEN (coalesce(s, 0) - l) / l > 0.15 THEN 'Accelerating' WHEN (coalesce(s, 0) - l) / l < -0.15 THEN 'Cooling'
            ELSE 'Stable' END AS burn_label
FROM g
""")
def _(spark, sf):
    return fc.warehouse_burn_labels(tv.load(spark, sf, "metering_long"), LINEITEM_AS_OF)
