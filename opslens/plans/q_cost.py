"""Registered cost and chargeback queries (CST-*, CHB-*)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from opslens.operators import chargeback as chb
from opslens.operators import cost, summaries
from opslens.plans.fixtures import OWNER_RULES, OWNER_RULES_CTE, RATE_SHEET
from opslens.plans.registry import register
from opslens.sources import testviews as tv
from opslens.sources.testviews import EVENTS_AS_OF, LINEITEM_AS_OF

E0 = "TIMESTAMP '2024-01-24 00:00:00'"   # as_of - 7 d
E1 = "TIMESTAMP '2024-01-30 00:00:00'"   # as_of - 24 h

_PQC = f"""
q AS (SELECT query_id, warehouse_name, date_trunc('hour', start_time) AS hour_bucket, execution_time AS exec_ms
      FROM query_history
      WHERE start_time >= {{lo}} AND start_time < {{hi}} AND warehouse_name IS NOT NULL AND execution_time > 0),
hx AS (SELECT warehouse_name, hour_bucket, sum(exec_ms) AS hour_total_exec_ms FROM q GROUP BY 1, 2),
m AS (SELECT warehouse_name, date_trunc('hour', start_time) AS hour_bucket,
             sum(coalesce(credits_used_compute, credits_used)) AS hourly_compute_credits
      FROM warehouse_metering WHERE start_time >= {{lo}} AND start_time < {{hi}} GROUP BY 1, 2),
pqc AS (
  SELECT q.query_id, q.warehouse_name, q.hour_bucket,
         round(coalesce(m.hourly_compute_credits, 0) * q.exec_ms / nullif(hx.hour_total_exec_ms, 0), 6) AS allocated_metered_credits,
         CAST(NULL AS DOUBLE) AS official_attributed_compute_credits, 'ALLOCATED' AS credit_source,
         round(coalesce(m.hourly_compute_credits, 0) * q.exec_ms / nullif(hx.hour_total_exec_ms, 0), 6) AS metered_credits
  FROM q JOIN hx ON q.warehouse_name = hx.warehouse_name AND q.hour_bucket = hx.hour_bucket
  LEFT JOIN m ON q.warehouse_name = m.warehouse_name AND q.hour_bucket = m.hour_bucket)
"""


def pqc_cte(lo=E0, hi=E1):
    return _PQC.format(lo=lo, hi=hi)


@register("per_query_credits", "query_history", "warehouse_metering", op="CST-1",
          sql="WITH " + pqc_cte() + " SELECT * FROM pqc")
def _(spark, sf):
    return cost.per_query_credits(tv.load(spark, sf, "query_history"), tv.load(spark, sf, "warehouse_metering"),
                                  EVENTS_AS_OF, days=7)


_LENS = """
WITH s AS (
  SELECT CAST(start_time AS DATE) AS usage_date, upper(coalesce(service_type, 'UNKNOWN')) AS service_type,
         coalesce(credits_used, 0) AS total_credits
  FROM service_metering
  WHERE start_time >= TIMESTAMP '2001-10-21 00:00:00' AND start_time < TIMESTAMP '2001-11-04 00:00:00'),
c AS (
  SELECT *, CAST(usage_date AS TIMESTAMP) > TIMESTAMP '2001-10-28 00:00:00' AS cur,
         CASE WHEN regexp_matches(service_type, '(^|[^A-Z])AI([^A-Z]|$)') OR service_type LIKE '%INTELLIGENCE%' THEN 'AI Services'
              WHEN service_type IN ('AUTOMATIC_CLUSTERING', 'COPY_FILES', 'MATERIALIZED_VIEW',
                 'QUERY_ACCELERATION', 'SEARCH_OPTIMIZATION', 'SERVERLESS_ALERTS', 'SERVERLESS_TASK', 'SNOWPIPE',
                 'SNOWPIPE_STREAMING', 'SNOWPARK_CONTAINER_SERVICES', 'REPLICATION') THEN 'Serverless / Managed Compute'
              WHEN service_type LIKE '%STORAGE%' THEN 'Storage'
              WHEN service_type LIKE '%DATA_TRANSFER%' OR service_type LIKE '%PRIVATELINK%' THEN 'Data Transfer / Network'
              WHEN service_type = 'WAREHOUSE_METERING' THEN 'Warehouse' ELSE 'Other' END AS service_category,
         CASE WHEN regexp_matches(service_type, '(^|[^A-Z])AI([^A-Z]|$)') OR service_type LIKE '%INTELLIGENCE%' THEN CAST(2.2 AS DOUBLE) ELSE CAST(3.68 AS DOUBLE) END AS rate_usd
  FROM s)
SELECT service_category, service_type, max(rate_usd) AS rate_usd,
       round(sum(CASE WHEN cur THEN total_credits ELSE 0 END), 4) AS credits_billed,
       round(sum(CASE WHEN NOT cur THEN total_credits ELSE 0 END), 4) AS credits_billed_prior,
       round(sum(CASE WHEN cur THEN total_credits ELSE 0 END) - sum(CASE WHEN NOT cur THEN total_credits ELSE 0 END), 4) AS credit_delta,
       CASE WHEN sum(CASE WHEN NOT cur THEN total_credits ELSE 0 END) = 0 THEN NULL
            ELSE round((sum(CASE WHEN cur THEN total_credits ELSE 0 END) - sum(CASE WHEN NOT cur THEN total_credits ELSE 0 END))
                       / sum(CASE WHEN NOT cur THEN total_credits ELSE 0 END) * 100, 2) END AS pct_delta,
       CAST(0 AS DOUBLE) AS credits_used_compute, CAST(0 AS DOUBLE) AS credits_used_cloud_services,
       round(sum(CASE WHEN cur THEN total_credits * rate_usd ELSE 0 END), 2) AS estimated_cost_usd,
       round(sum(CASE WHEN NOT cur THEN total_credits * rate_usd ELSE 0 END), 2) AS prior_estimated_cost_usd,
       round(sum(CASE WHEN cur THEN total_credits * rate_usd ELSE 0 END) - sum(CASE WHEN NOT cur THEN total_credits * rate_usd ELSE 0 END), 2) AS cost_delta_usd,
       count(DISTINCT CASE WHEN cur THEN usage_date END) AS observed_days,
       count_if(cur) AS metering_rows
FROM c GROUP BY 1, 2 HAVING abs(sum(total_credits)) > 0
"""


@register("service_cost_lens", "service_metering", op="CST-2", sql=_LENS)
def _(spark, sf):
    return cost.service_cost_lens(tv.load(spark, sf, "service_metering"), LINEITEM_AS_OF, 7)


@register("idle_warehouse_credits", "query_history", "warehouse_metering", op="CST-3", sql=f"""
WITH m AS (SELECT warehouse_name, date_trunc('hour', start_time) AS hour_bucket,
                  sum(coalesce(credits_used_compute, credits_used)) AS hourly_compute_credits
           FROM warehouse_metering WHERE start_time >= {E0} AND start_time < {E1} GROUP BY 1, 2),
a AS (SELECT warehouse_name, date_trunc('hour', start_time) AS hour_bucket, count(*) AS n
      FROM query_history WHERE start_time >= {E0} AND start_time < {E1} AND warehouse_name IS NOT NULL GROUP BY 1, 2)
SELECT m.warehouse_name, round(sum(m.hourly_compute_credits), 4) AS idle_credits, count(*) AS idle_hours
FROM m LEFT JOIN a ON m.warehouse_name = a.warehouse_name AND m.hour_bucket = a.hour_bucket
WHERE coalesce(a.n, 0) = 0
GROUP BY 1 HAVING round(sum(m.hourly_compute_credits), 4) > 1.0
""")
def _(spark, sf):
    return cost.idle_warehouse_credits(tv.load(spark, sf, "warehouse_metering"), tv.load(spark, sf, "query_history"),
                                       EVENTS_AS_OF, 7, 1.0)


R0 = "TIMESTAMP '2024-01-01 00:00:00'"


@register("cost_reconciliation", "query_history", "warehouse_metering", op="CST-6", sql="WITH " + pqc_cte(R0, E1) + f""",
md AS (SELECT date_trunc('day', start_time) AS usage_day, warehouse_name, round(sum(credits_used), 6) AS exact_metered_credits
       FROM warehouse_metering WHERE start_time >= {R0} AND start_time < {E1} GROUP BY 1, 2),
ad AS (SELECT date_trunc('day', qh.start_time) AS usage_day, qh.warehouse_name, count(*) AS query_count,
              round(sum(coalesce(p.metered_credits, 0)), 6) AS allocated_query_credits,
              round(sum(coalesce(p.allocated_metered_credits, 0)), 6) AS allocated_share_credits
       FROM query_history qh LEFT JOIN pqc p ON qh.query_id = p.query_id
       WHERE qh.start_time >= {R0} AND qh.start_time < {E1} AND qh.warehouse_name IS NOT NULL GROUP BY 1, 2),
j AS (SELECT coalesce(md.usage_day, ad.usage_day) AS usage_day, coalesce(md.warehouse_name, ad.warehouse_name) AS warehouse_name,
             coalesce(ad.query_count, 0) AS query_count, coalesce(md.exact_metered_credits, 0) AS m,
             coalesce(ad.allocated_query_credits, 0) AS a, coalesce(ad.allocated_share_credits, 0) AS allocated_share_credits
      FROM md FULL OUTER JOIN ad ON md.usage_day = ad.usage_day AND md.warehouse_name = ad.warehouse_name)
SELECT usage_day, warehouse_name, query_count, m AS exact_metered_credits, a AS allocated_query_credits,
       allocated_share_credits, round(m - a, 6) AS variance_credits, round(100 * abs(m - a) / nullif(m, 0), 2) AS variance_pct,
       CASE WHEN m = 0 THEN 'No metering' WHEN abs(m - a) <= greatest(0.05, m * 0.05) THEN 'Reconciled'
            WHEN query_count = 0 THEN 'Idle or non-query warehouse usage' ELSE 'Variance review' END AS reconciliation_status
FROM j
""")
def _(spark, sf):
    return cost.cost_reconciliation(tv.load(spark, sf, "warehouse_metering"), tv.load(spark, sf, "query_history"),
                                    EVENTS_AS_OF, 30)


@register("live_credit_estimate", "query_history", op="CST-7", sql="""
SELECT *, round(CASE warehouse_size WHEN 'X-Small' THEN 1 WHEN 'Small' THEN 2 WHEN 'Medium' THEN 4 WHEN 'Large' THEN 8
                  WHEN 'X-Large' THEN 16 WHEN '2X-Large' THEN 32 WHEN '3X-Large' THEN 64 WHEN '4X-Large' THEN 128
                  WHEN '5X-Large' THEN 256 WHEN '6X-Large' THEN 512 ELSE 1 END
                * coalesce(execution_time / 1000.0, total_elapsed_time / 1000.0, 0) / 3600.0, 6) AS estimated_credits
FROM query_history WHERE start_time >= TIMESTAMP '2024-01-30 22:00:00' AND start_time < TIMESTAMP '2024-01-31 00:00:00'
""")
def _(spark, sf):
    from opslens.functions.timeutil import between_ts
    q = tv.load(spark, sf, "query_history").filter(
        between_ts("start_time", datetime(2024, 1, 30, 22), EVENTS_AS_OF))
    return cost.live_credit_estimate(q, EVENTS_AS_OF)


@register("price_service_credits", "service_metering", op="CST-8", sql="""
SELECT CAST(start_time AS DATE) AS usage_date, service_type, round(sum(credits_used), 4) AS credits_used,
       round(coalesce(round(sum(credits_used), 4), 0) *
         CASE WHEN upper(trim(service_type)) = 'WAREHOUSE_METERING' THEN 3.68
              WHEN upper(trim(service_type)) = 'SNOWPIPE' THEN 1.25
              WHEN upper(trim(service_type)) = 'AUTOMATIC_CLUSTERING' THEN 2.5
              WHEN contains(upper(trim(service_type)), 'WAREHOUSE_METERING') OR contains('WAREHOUSE_METERING', upper(trim(service_type))) THEN 3.68
              WHEN contains(upper(trim(service_type)), 'SNOWPIPE') OR contains('SNOWPIPE', upper(trim(service_type))) THEN 1.25
              WHEN contains(upper(trim(service_type)), 'AUTOMATIC_CLUSTERING') OR contains('AUTOMATIC_CLUSTERING', upper(trim(service_type))) THEN 2.5
              WHEN contains(upper(trim(service_type)), 'INTELLIGENCE') OR contains(upper(trim(service_type)), 'TOKEN')
                OR regexp_matches(upper(trim(service_type)), '(^|[^A-Z])AI([^A-Z]|$)') THEN 2.2
              ELSE 3.68 END, 2) AS credits_used_cost_usd
FROM service_metering WHERE start_time >= TIMESTAMP '2001-08-07 00:00:00'
GROUP BY 1, 2
""")
def _(spark, sf):
    daily = summaries.daily_service_credits(tv.load(spark, sf, "service_metering"), LINEITEM_AS_OF, 90)
    return cost.price_credits(daily, "credits_used", "service_type", cost.RateTable(RATE_SHEET))


CUR = (datetime(2024, 1, 16), datetime(2024, 1, 31))
PRI = (datetime(2024, 1, 1), datetime(2024, 1, 16))


@register("bill_summary", "warehouse_metering", op="CST-10", sql="""
WITH x AS (
  SELECT 'CURRENT' AS period, warehouse_name, start_time, credits_used FROM warehouse_metering
  WHERE start_time >= TIMESTAMP '2024-01-16 00:00:00' AND start_time < TIMESTAMP '2024-01-31 00:00:00'
  UNION ALL
  SELECT 'PRIOR', warehouse_name, start_time, credits_used FROM warehouse_metering
  WHERE start_time >= TIMESTAMP '2024-01-01 00:00:00' AND start_time < TIMESTAMP '2024-01-16 00:00:00')
SELECT period, round(sum(credits_used), 4) AS credits, count(DISTINCT warehouse_name) AS active_warehouses,
       count(DISTINCT CAST(start_time AS DATE)) AS active_days
FROM x GROUP BY 1
""")
def _(spark, sf):
    return cost.bill_summary(tv.load(spark, sf, "warehouse_metering"), CUR, PRI)


@register("warehouse_period_delta", "warehouse_metering", op="CST-11", sql="""
WITH c AS (SELECT warehouse_name, sum(credits_used) AS credits FROM warehouse_metering
           WHERE start_time >= TIMESTAMP '2024-01-16 00:00:00' AND start_time < TIMESTAMP '2024-01-31 00:00:00' GROUP BY 1),
p AS (SELECT warehouse_name, sum(credits_used) AS credits FROM warehouse_metering
      WHERE start_time >= TIMESTAMP '2024-01-01 00:00:00' AND start_time < TIMESTAMP '2024-01-16 00:00:00' GROUP BY 1)
SELECT coalesce(c.warehouse_name, p.warehouse_name) AS warehouse_name, round(coalesce(c.credits, 0), 4) AS current_credits,
       round(coalesce(p.credits, 0), 4) AS prior_credits, round(coalesce(c.credits, 0) - coalesce(p.credits, 0), 4) AS credit_delta,
       CASE WHEN coalesce(p.credits, 0) = 0 THEN NULL ELSE round((coalesce(c.credits, 0) - p.credits) / p.credits * 100, 2) END AS pct_delta
FROM c FULL OUTER JOIN p ON c.warehouse_name = p.warehouse_name
ORDER BY abs(coalesce(c.credits, 0) - coalesce(p.credits, 0)) DESC, 1 LIMIT 25
""")
def _(spark, sf):
    return cost.warehouse_period_delta(tv.load(spark, sf, "warehouse_metering"), CUR, PRI)


@register("cost_cockpit", "warehouse_metering", op="CST-12", sql="""
WITH d AS (
  SELECT warehouse_name,
         sum(CASE WHEN start_time >= TIMESTAMP '2024-01-24 00:00:00' THEN coalesce(credits_used, 0) ELSE 0 END) AS cur,
         sum(CASE WHEN start_time < TIMESTAMP '2024-01-24 00:00:00' THEN coalesce(credits_used, 0) ELSE 0 END) AS pri
  FROM warehouse_metering
  WHERE start_time >= TIMESTAMP '2024-01-17 00:00:00' AND start_time < TIMESTAMP '2024-01-31 00:00:00' GROUP BY 1)
SELECT round(sum(cur), 4) AS current_credits, round(sum(pri), 4) AS prior_credits, count_if(cur > 0) AS active_warehouses,
       arg_max(warehouse_name, (cur - pri, warehouse_name)) AS top_increase_warehouse,
       round(max(cur - pri), 4) AS top_increase_credits
FROM d
""")
def _(spark, sf):
    return cost.cost_cockpit(tv.load(spark, sf, "warehouse_metering"), EVENTS_AS_OF, 7)


@register("run_rate", "metering_long", op="CST-13", sql="""
WITH w AS (
  SELECT warehouse_name,
    sum(CASE WHEN start_time >= TIMESTAMP '2001-10-29 00:00:00' AND start_time < TIMESTAMP '2001-11-05 00:00:00' THEN coalesce(credits_used, 0) ELSE 0 END) AS c7,
    sum(CASE WHEN start_time >= TIMESTAMP '2001-10-22 00:00:00' AND start_time < TIMESTAMP '2001-10-29 00:00:00' THEN coalesce(credits_used, 0) ELSE 0 END) AS p7,
    sum(CASE WHEN start_time >= TIMESTAMP '2001-10-06 00:00:00' AND start_time < TIMESTAMP '2001-11-05 00:00:00' THEN coalesce(credits_used, 0) ELSE 0 END) AS c30,
    sum(CASE WHEN start_time >= TIMESTAMP '2000-10-29 00:00:00' AND start_time < TIMESTAMP '2000-11-05 00:00:00' THEN coalesce(credits_used, 0) ELSE 0 END) AS ly7,
    sum(CASE WHEN start_time >= TIMESTAMP '2001-11-01 00:00:00' AND start_time < TIMESTAMP '2001-11-05 00:00:00' THEN coalesce(credits_used, 0) ELSE 0 END) AS mtd
  FROM metering_long
  WHERE (start_time >= TIMESTAMP '2001-10-06 00:00:00' AND start_time < TIMESTAMP '2001-11-05 00:00:00')
     OR (start_time >= TIMESTAMP '2000-10-29 00:00:00' AND start_time < TIMESTAMP '2000-11-05 00:00:00')
  GROUP BY 1),
o AS (SELECT sum(c7) AS c7, sum(c30) AS c30, sum(ly7) AS ly7, sum(mtd) AS mtd,
             arg_max(warehouse_name, (c7 - p7, warehouse_name)) AS top_riser, max(c7 - p7) AS top_rise FROM w)
SELECT round(c7 / 7, 4) AS run_rate_7d, round(c30 / 30, 4) AS run_rate_30d, round(mtd, 4) AS month_to_date_credits,
       round(mtd / 4 * 30, 4) AS month_end_projection, round(mtd / 4 * 30 * 3.68, 2) AS month_end_projection_usd,
       round(ly7, 4) AS same_week_last_year,
       CASE WHEN ly7 > 0 THEN round((c7 - ly7) / ly7 * 100, 2) END AS yoy_pct,
       CASE WHEN c7 / 7 > c30 / 30 * 1.1 THEN 'Accelerating' WHEN c7 / 7 < c30 / 30 * 0.9 THEN 'Slowing' ELSE 'Steady' END AS run_rate_state,
       top_riser, round(top_rise, 4) AS top_rise_credits
FROM o
""")
def _(spark, sf):
    return cost.run_rate(tv.load(spark, sf, "metering_long"), LINEITEM_AS_OF)


@register("daily_credit_trend", "warehouse_metering", op="CST-14", sql="""
SELECT CAST(start_time AS DATE) AS usage_date, round(sum(credits_used), 4) AS credits_used,
       count(DISTINCT warehouse_name) AS active_warehouses
FROM warehouse_metering WHERE start_time >= TIMESTAMP '2024-01-01 00:00:00' AND start_time < TIMESTAMP '2024-01-31 00:00:00'
GROUP BY 1
""")
def _(spark, sf):
    return cost.daily_credit_trend(tv.load(spark, sf, "warehouse_metering"), EVENTS_AS_OF, 30)


@register("cost_drivers_user_role_warehouse", "query_history", "warehouse_metering", op="CST-16",
          sql="WITH " + pqc_cte() + """
SELECT qh.user_name, qh.role_name, qh.warehouse_name, count(*) AS query_count, round(sum(p.metered_credits), 4) AS credits,
       round(sum(p.metered_credits) * 3.68, 2) AS est_cost_usd
FROM pqc p JOIN query_history qh ON p.query_id = qh.query_id
GROUP BY 1, 2, 3 ORDER BY credits DESC, 1, 2, 3 LIMIT 50
""")
def _(spark, sf):
    return cost.cost_drivers(tv.load(spark, sf, "query_history"), tv.load(spark, sf, "warehouse_metering"),
                             EVENTS_AS_OF, ["user_name", "role_name", "warehouse_name"], 7)


@register("cost_drivers_by_schema", "query_history", "warehouse_metering", op="CST-17",
          sql="WITH " + pqc_cte() + """
SELECT qh.database_name || '.' || qh.schema_name AS db_schema, count(*) AS query_count,
       round(sum(p.metered_credits), 4) AS credits, round(sum(p.metered_credits) * 3.68, 2) AS est_cost_usd
FROM pqc p JOIN query_history qh ON p.query_id = qh.query_id
GROUP BY 1 ORDER BY credits DESC, 1 LIMIT 50
""")
def _(spark, sf):
    return cost.cost_drivers(tv.load(spark, sf, "query_history"), tv.load(spark, sf, "warehouse_metering"),
                             EVENTS_AS_OF, [F.concat_ws(".", "database_name", "schema_name").alias("db_schema")], 7)


@register("top_users_by_cost", "query_history", "warehouse_metering", op="CST-22", sql="WITH " + pqc_cte() + """,
u AS (SELECT qh.user_name, sum(p.metered_credits) AS c, count(*) AS query_count
      FROM pqc p JOIN query_history qh ON p.query_id = qh.query_id GROUP BY 1)
SELECT user_name, query_count, round(c, 4) AS credits, round(c * 100 / nullif((SELECT sum(c) FROM u), 0), 2) AS pct_of_total
FROM u ORDER BY credits DESC, user_name LIMIT 10
""")
def _(spark, sf):
    return cost.top_users_by_cost(tv.load(spark, sf, "query_history"), tv.load(spark, sf, "warehouse_metering"),
                                  EVENTS_AS_OF, 7, 10)


@register("monthly_spend", "metering_long", op="CST-23", sql="""
WITH g AS (SELECT date_trunc('month', start_time) AS month, sum(credits_used) AS c FROM metering_long
           WHERE start_time >= TIMESTAMP '2000-12-01 00:00:00' AND start_time < TIMESTAMP '2001-11-05 00:00:00' GROUP BY 1)
SELECT month, round(c, 4) AS credits, round(c * 3.68, 2) AS cost_usd, CAST(1000.0 AS DOUBLE) AS budget_usd,
       round(c * 3.68 - 1000.0, 2) AS over_under_usd, CASE WHEN c * 3.68 > 1000.0 THEN 'Over' ELSE 'Within' END AS budget_state,
       round(sum(c * 3.68) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS cumulative_cost_usd
FROM g
""")
def _(spark, sf):
    return cost.monthly_spend(tv.load(spark, sf, "metering_long"), LINEITEM_AS_OF, 12, 1000.0)


@register("service_share", "service_metering", op="CST-24", sql="""
WITH g AS (SELECT service_type, sum(credits_used) AS c FROM service_metering
           WHERE start_time >= TIMESTAMP '2001-10-06 00:00:00' AND start_time < TIMESTAMP '2001-11-05 00:00:00' GROUP BY 1)
SELECT service_type, round(c, 4) AS credits, round(c * 100 / nullif((SELECT sum(c) FROM g), 0), 2) AS pct_of_total FROM g
""")
def _(spark, sf):
    return cost.service_share(tv.load(spark, sf, "service_metering"), LINEITEM_AS_OF, 30)


@register("top_cost_drivers", "query_history", "warehouse_metering", op="CST-25", sql="""
WITH q AS (SELECT * FROM query_history WHERE start_time >= TIMESTAMP '2024-01-24 00:00:00'
           AND start_time < TIMESTAMP '2024-01-31 00:00:00' AND warehouse_name IS NOT NULL),
per AS (SELECT warehouse_name, user_name, query_type, count(*) AS query_count, sum(total_elapsed_time) AS e FROM q GROUP BY 1, 2, 3),
we AS (SELECT warehouse_name, sum(total_elapsed_time) AS we FROM q GROUP BY 1),
wc AS (SELECT warehouse_name, sum(credits_used) AS wc FROM warehouse_metering
       WHERE start_time >= TIMESTAMP '2024-01-24 00:00:00' AND start_time < TIMESTAMP '2024-01-31 00:00:00' GROUP BY 1)
SELECT per.warehouse_name, user_name, query_type, query_count, round(e / 1000.0, 1) AS elapsed_sec,
       round(coalesce(wc, 0) * e / nullif(we, 0), 4) AS est_credits
FROM per JOIN we USING (warehouse_name) LEFT JOIN wc USING (warehouse_name)
ORDER BY est_credits DESC, 1, 2, 3 LIMIT 20
""")
def _(spark, sf):
    return cost.top_cost_drivers(tv.load(spark, sf, "query_history"), tv.load(spark, sf, "warehouse_metering"),
                                 EVENTS_AS_OF, 7, 20)


@register("period_credits", "metering_long", op="CST-26", sql="""
SELECT round(sum(CASE WHEN start_time >= TIMESTAMP '2001-10-06 00:00:00' THEN credits_used ELSE 0 END), 4) AS period_credits,
       round(sum(CASE WHEN start_time >= TIMESTAMP '2001-09-06 00:00:00' AND start_time < TIMESTAMP '2001-10-06 00:00:00' THEN credits_used ELSE 0 END), 4) AS prior_period_credits,
       round(sum(CASE WHEN start_time >= TIMESTAMP '2001-01-01 00:00:00' THEN credits_used ELSE 0 END), 4) AS ytd_credits
FROM metering_long WHERE start_time >= TIMESTAMP '2001-01-01 00:00:00' AND start_time < TIMESTAMP '2001-11-05 00:00:00'
""")
def _(spark, sf):
    return cost.period_credits(tv.load(spark, sf, "metering_long"), LINEITEM_AS_OF, 30)


# ---------------------------------------------------------------- chargeback

_OWNER_DAILY = """
daily AS (SELECT warehouse_name, CAST(start_time AS DATE) AS usage_date, round(sum(coalesce(credits_used, 0)), 4) AS daily_credits
          FROM warehouse_metering WHERE start_time >= TIMESTAMP '2024-01-01 00:00:00' AND start_time < TIMESTAMP '2024-01-31 00:00:00'
          GROUP BY 1, 2),
cand AS (
  SELECT w.warehouse_name, r.owner_name, r.owner_email, r.service_tier,
         row_number() OVER (PARTITION BY w.warehouse_name ORDER BY coalesce(r.match_priority, 0) DESC, r.entity_pattern DESC) AS rn
  FROM (SELECT DISTINCT warehouse_name FROM daily) w
  JOIN owner_rules r ON upper(r.entity_type) = 'WAREHOUSE' AND coalesce(r.is_active, TRUE)
   AND ((r.entity_pattern = '*' AND r.match_priority > 0) OR upper(w.warehouse_name) = upper(r.entity_pattern)
        OR (r.entity_pattern LIKE '%*%' AND upper(w.warehouse_name) LIKE replace(upper(r.entity_pattern), '*', '%')))),
attributed AS (
  SELECT d.warehouse_name, d.usage_date, d.daily_credits, coalesce(c.owner_name, 'Unattributed') AS cost_owner,
         coalesce(c.owner_email, '') AS owner_email, coalesce(c.service_tier, 'Unclassified') AS service_tier,
         CASE WHEN c.owner_name IS NOT NULL THEN 'Owner Directory' ELSE 'Unattributed' END AS attribution_source
  FROM daily d LEFT JOIN (SELECT * FROM cand WHERE rn = 1) c ON d.warehouse_name = c.warehouse_name),
by_owner AS (
  SELECT cost_owner, owner_email, service_tier, attribution_source, count(DISTINCT warehouse_name) AS warehouse_count,
         count(DISTINCT usage_date) AS active_days, round(sum(daily_credits), 2) AS total_credits,
         round(avg(daily_credits), 2) AS avg_daily_credits, round(max(daily_credits), 2) AS peak_daily_credits,
         string_agg(DISTINCT warehouse_name, ', ' ORDER BY warehouse_name) AS warehouses
  FROM attributed GROUP BY 1, 2, 3, 4)
"""


def _rules(spark):
    return chb.rules_frame(spark, OWNER_RULES)


@register("chargeback_by_owner", "warehouse_metering", op="CHB-1",
          sql="WITH " + OWNER_RULES_CTE + "," + _OWNER_DAILY + "SELECT * FROM by_owner")
def _(spark, sf):
    return chb.chargeback_by_owner(tv.load(spark, sf, "warehouse_metering"), _rules(spark), EVENTS_AS_OF, 30)


@register("chargeback_by_database", "query_history", "warehouse_metering", op="CHB-2", sql="""
WITH q AS (SELECT database_name, warehouse_name, CAST(start_time AS DATE) AS usage_date,
                  date_trunc('hour', start_time) AS hour_bucket, execution_time AS exec_ms
           FROM query_history WHERE start_time >= TIMESTAMP '2024-01-01 00:00:00' AND start_time < TIMESTAMP '2024-01-31 00:00:00'
             AND warehouse_name IS NOT NULL AND execution_time > 0 AND database_name IS NOT NULL),
hx AS (SELECT warehouse_name, hour_bucket, sum(exec_ms) AS hx FROM q GROUP BY 1, 2),
m AS (SELECT warehouse_name, date_trunc('hour', start_time) AS hour_bucket, sum(coalesce(credits_used_compute, credits_used)) AS hc
      FROM warehouse_metering WHERE start_time >= TIMESTAMP '2024-01-01 00:00:00' AND start_time < TIMESTAMP '2024-01-31 00:00:00' GROUP BY 1, 2),
a AS (SELECT q.database_name, q.warehouse_name, q.usage_date,
             round(sum(coalesce(m.hc, 0) * q.exec_ms / nullif(hx.hx, 0)), 6) AS allocated_credits
      FROM q JOIN hx ON q.warehouse_name = hx.warehouse_name AND q.hour_bucket = hx.hour_bucket
      LEFT JOIN m ON q.warehouse_name = m.warehouse_name AND q.hour_bucket = m.hour_bucket GROUP BY 1, 2, 3)
SELECT database_name, count(DISTINCT warehouse_name) AS warehouse_count, count(DISTINCT usage_date) AS active_days,
       round(sum(allocated_credits), 2) AS total_credits, round(avg(allocated_credits), 2) AS avg_daily_credits,
       string_agg(DISTINCT warehouse_name, ', ' ORDER BY warehouse_name) AS warehouses
FROM a GROUP BY 1 HAVING sum(allocated_credits) > 0.01
""")
def _(spark, sf):
    return chb.chargeback_by_database(tv.load(spark, sf, "query_history"), tv.load(spark, sf, "warehouse_metering"),
                                      EVENTS_AS_OF, 30)


@register("chargeback_trend", "warehouse_metering", op="CHB-3", sql="WITH " + OWNER_RULES_CTE + """,
wk AS (SELECT warehouse_name, date_trunc('week', CAST(start_time AS DATE)) AS week_start,
              round(sum(coalesce(credits_used, 0)), 4) AS weekly_credits
       FROM warehouse_metering WHERE start_time >= TIMESTAMP '2024-01-01 00:00:00' AND start_time < TIMESTAMP '2024-01-31 00:00:00'
       GROUP BY 1, 2),
cand AS (
  SELECT w.warehouse_name, r.owner_name,
         row_number() OVER (PARTITION BY w.warehouse_name ORDER BY coalesce(r.match_priority, 0) DESC, r.entity_pattern DESC) AS rn
  FROM (SELECT DISTINCT warehouse_name FROM wk) w
  JOIN owner_rules r ON upper(r.entity_type) = 'WAREHOUSE' AND coalesce(r.is_active, TRUE)
   AND (upper(w.warehouse_name) = upper(r.entity_pattern)
        OR (r.entity_pattern LIKE '%*%' AND upper(w.warehouse_name) LIKE replace(upper(r.entity_pattern), '*', '%'))))
SELECT week_start, coalesce(c.owner_name, 'Unattributed') AS cost_owner, round(sum(weekly_credits), 2) AS weekly_credits
FROM wk LEFT JOIN (SELECT * FROM cand WHERE rn = 1) c ON wk.warehouse_name = c.warehouse_name
GROUP BY 1, 2
""")
def _(spark, sf):
    return chb.chargeback_trend(tv.load(spark, sf, "warehouse_metering"), _rules(spark), EVENTS_AS_OF, 30)


@register("chargeback_report", "warehouse_metering", op="CHB-4", sql="WITH " + OWNER_RULES_CTE + "," + _OWNER_DAILY + """,
t AS (SELECT sum(total_credits) AS t, sum(CASE WHEN cost_owner = 'Unattributed' THEN round(total_credits, 2) ELSE 0 END) AS u,
             count_if(cost_owner <> 'Unattributed') AS owner_count FROM by_owner)
SELECT cost_owner AS owner, owner_email AS email, service_tier AS tier, round(total_credits, 2) AS credits,
       round(total_credits * 3.68, 2) AS cost_usd,
       CASE WHEN t > 0 THEN round(total_credits / t * 100, 1) ELSE 0 END AS pct_of_total,
       CASE WHEN t > 0 THEN round(u / t * 100, 1) ELSE 0 END AS unattributed_pct, owner_count, warehouses,
       attribution_source AS source
FROM by_owner, t
""")
def _(spark, sf):
    by_owner = chb.chargeback_by_owner(tv.load(spark, sf, "warehouse_metering"), _rules(spark), EVENTS_AS_OF, 30)
    return chb.chargeback_report(by_owner)
