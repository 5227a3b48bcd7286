"""Registered scorecards (SCR-1..3)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from opslens.operators import scores as sc
from opslens.plans.registry import register
from opslens.sources import testviews as tv
from opslens.sources.testviews import EVENTS_AS_OF, LINEITEM_AS_OF, ORDERS_AS_OF

DAY = date(LINEITEM_AS_OF.year, LINEITEM_AS_OF.month, LINEITEM_AS_OF.day)


def _clamp(x: str) -> str:
    return f"round(greatest(0.0, least(100.0, {x})), 1)"


def _bad(total: str, bad: str, penalty: float) -> str:
    return f"CASE WHEN {total} <= 0 THEN 100.0 ELSE {_clamp(f'100.0 - greatest({bad}, 0.0) / {total} * {penalty}')} END"


def _trend(cur: str, pri: str, warn: float, crit: float, none: float) -> str:
    d = f"(({cur} - {pri}) / {pri} * 100.0)"
    return (f"CASE WHEN {pri} <= 0 AND {cur} <= 0 THEN 100.0 WHEN {pri} <= 0 THEN {none} WHEN {d} <= {warn} THEN 100.0 "
            f"WHEN {d} <= {crit} THEN {_clamp(f'100.0 - ({d} - {warn}) / {max(crit - warn, 1.0)} * 40.0')} "
            f"ELSE {_clamp(f'60.0 - least(60.0, ({d} - {crit}) / {max(crit, 1.0)} * 60.0)')} END")


def _window(col: str, end, days: int) -> str:
    return f"{col} >= TIMESTAMP '{end}' - INTERVAL {days} DAY AND {col} < TIMESTAMP '{end}'"


_Q = f"""q AS (SELECT * FROM query_history WHERE {_window('start_time', EVENTS_AS_OF, 7)}),
qc AS (SELECT CAST(count(*) AS DOUBLE) AS tq, CAST(count_if(execution_status <> 'SUCCESS') AS DOUBLE) AS fq,
              CAST(count_if(queued_overload_time > 0) AS DOUBLE) AS qq, CAST(count_if(transaction_blocked_time > 0) AS DOUBLE) AS bq,
              avg(total_elapsed_time) / 1000.0 AS av, quantile_cont(total_elapsed_time, 0.95) / 1000.0 AS p95 FROM q),
wc AS (SELECT CAST(count(*) AS DOUBLE) AS aw, CAST(count_if(p > 0) AS DOUBLE) AS pw FROM (
         SELECT warehouse_name, count_if(queued_overload_time > 0 OR execution_status <> 'SUCCESS' OR bytes_spilled_to_remote_storage > 0) AS p
         FROM q WHERE warehouse_name IS NOT NULL GROUP BY 1)),
tc AS (SELECT CAST(count(*) AS DOUBLE) AS tr, CAST(count_if(state = 'FAILED') AS DOUBLE) AS ft FROM task_history
       WHERE {_window('scheduled_time', ORDERS_AS_OF, 7)})"""


def _card(parts: list[tuple[str, str, float]]) -> str:
    rows = " UNION ALL ".join(f"SELECT '{n}' AS component, CAST({s} AS DOUBLE) AS score, {float(w)}::DOUBLE AS weight FROM m" for n, s, w in parts)
    return f""",
p AS ({rows}),
o AS (SELECT {_clamp('sum(score * weight) / sum(weight)')} AS total_score FROM p)
SELECT component, score, weight, total_score, CASE WHEN total_score >= 90 THEN 'Healthy' WHEN total_score >= 75 THEN 'Watch'
       WHEN total_score >= 60 THEN 'At Risk' ELSE 'Critical' END AS label FROM p, o"""


@register("executive_scorecard", "query_history", "task_history", "warehouse_metering", "database_storage", op="SCR-2", sql=f"""
WITH {_Q},
cc AS (SELECT coalesce(sum(CASE WHEN start_time >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 7 DAY THEN credits_used END), 0) AS c,
              coalesce(sum(CASE WHEN start_time < TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 7 DAY THEN credits_used END), 0) AS p
       FROM warehouse_metering WHERE {_window('start_time', EVENTS_AS_OF, 14)}),
sc AS (SELECT coalesce(sum(CASE WHEN usage_date >= DATE '{DAY}' - 7 THEN average_database_bytes END), 0) / 1e12 AS c,
              coalesce(sum(CASE WHEN usage_date < DATE '{DAY}' - 7 THEN average_database_bytes END), 0) / 1e12 AS p
       FROM database_storage WHERE usage_date >= DATE '{DAY}' - 14 AND usage_date < DATE '{DAY}'),
m AS (SELECT qc.*, wc.*, tc.*, cc.c AS c1, cc.p AS c0, sc.c AS s1, sc.p AS s0 FROM qc, wc, tc, cc, sc)""" + _card([
    ("Query failures", _bad("tq", "fq", 160), 25), ("Queue pressure", _bad("tq", "qq", 90), 15),
    ("Latency", _clamp("100.0 - least(45.0, greatest(coalesce(av, 0) - 2, 0.0) * 4)"), 10),
    ("Task reliability", _bad("tr", "ft", 225), 15), ("Warehouse pressure", _bad("aw", "pw", 160), 15),
    ("Credit spike", _trend("c1", "c0", 20, 60, 90.0), 12), ("Storage growth", _trend("s1", "s0", 5, 25, 95.0), 8)]))
def _(spark, sf):
    return sc.executive_health_score(*[tv.load(spark, sf, t) for t in ("query_history", "task_history", "warehouse_metering", "database_storage")],
                                     EVENTS_AS_OF, ORDERS_AS_OF, DAY)


@register("service_scorecard", "query_history", "task_history", "login_history", "copy_history", op="SCR-3", sql=f"""
WITH {_Q},
lc AS (SELECT CAST(count(*) AS DOUBLE) AS le, CAST(count_if(is_success = 'NO') AS DOUBLE) AS fl FROM login_history
       WHERE {_window('event_timestamp', EVENTS_AS_OF, 7)}),
dc AS (SELECT CAST(count(*) AS DOUBLE) AS de, CAST(count_if(status <> 'LOADED') AS DOUBLE) AS fd FROM copy_history
       WHERE {_window('last_load_time', LINEITEM_AS_OF, 7)}),
m AS (SELECT * FROM qc, wc, tc, lc, dc)""" + _card([
    ("Query Processor", _clamp(f"{_bad('tq', '(fq + qq * 0.35 + bq * 1.25)', 140)} - least(20.0, greatest(coalesce(p95, 0) - 60, 0.0) / 12)"), 30),
    ("Warehouse Availability", _bad("aw", "pw", 180), 25), ("Task Service", _bad("tr", "ft", 240), 20),
    ("Login/Auth", _bad("le", "fl", 45), 15), ("Data Load", _bad("de", "fd", 160), 10)]))
def _(spark, sf):
    return sc.service_health_scorecard(*[tv.load(spark, sf, t) for t in ("query_history", "task_history", "login_history", "copy_history")],
                                       EVENTS_AS_OF, ORDERS_AS_OF, LINEITEM_AS_OF)


@register("warehouse_trend_scores", "warehouse_metering", "query_history", op="SCR-1", sql=f"""
WITH c AS (SELECT warehouse_name, coalesce(sum(CASE WHEN start_time >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 7 DAY THEN credits_used END), 0) AS cur,
                  coalesce(sum(CASE WHEN start_time < TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 7 DAY THEN credits_used END), 0) AS pri
           FROM warehouse_metering WHERE {_window('start_time', EVENTS_AS_OF, 14)} GROUP BY 1),
q AS (SELECT warehouse_name, CAST(count(*) AS DOUBLE) AS n, CAST(count_if(execution_status <> 'SUCCESS') AS DOUBLE) AS b FROM query_history
      WHERE {_window('start_time', EVENTS_AS_OF, 7)} GROUP BY 1)
SELECT c.warehouse_name, {_trend('cur', 'pri', 20, 60, 90.0)} AS credit_trend_score, {_bad('coalesce(n, 0)', 'coalesce(b, 0)', 160)} AS failure_score
FROM c LEFT JOIN q ON c.warehouse_name = q.warehouse_name
""")
def _(spark, sf):
    from opslens.functions.timeutil import lookback, ts_lit
    from datetime import timedelta
    cut = ts_lit(EVENTS_AS_OF - timedelta(days=7))
    c = tv.load(spark, sf, "warehouse_metering").filter(lookback("start_time", EVENTS_AS_OF, 14)).groupBy("warehouse_name").agg(
        F.sum(F.when(F.col("start_time") >= cut, F.col("credits_used"))).alias("cur"),
        F.sum(F.when(F.col("start_time") < cut, F.col("credits_used"))).alias("pri"))
    q = tv.load(spark, sf, "query_history").filter(lookback("start_time", EVENTS_AS_OF, 7)).groupBy("warehouse_name").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("execution_status") != "SUCCESS").alias("b"))
    return c.join(q, "warehouse_name", "left").select(
        "warehouse_name", sc.trend_score("cur", "pri", 20, 60).alias("credit_trend_score"), sc.bad_ratio_score("n", "b", 160).alias("failure_score"))


@register("platform_health_card", "warehouse_metering", "query_history", "task_history", "alerts", "login_history", op="SCR-4", sql=f"""
WITH day AS (SELECT warehouse_name, CAST(start_time AS DATE) AS d, sum(credits_used) AS c FROM warehouse_metering
             WHERE {_window('start_time', EVENTS_AS_OF, 8)} GROUP BY 1, 2),
mv AS (SELECT x.warehouse_name, max((x.c - y.c) * 100.0 / nullif(y.c, 0)) AS v
       FROM day x LEFT JOIN day y ON x.warehouse_name = y.warehouse_name AND y.d = x.d - 1 GROUP BY 1),
f AS (SELECT warehouse_name, count_if(execution_status <> 'SUCCESS') AS qf FROM query_history WHERE {_window('start_time', EVENTS_AS_OF, 7)} GROUP BY 1),
one AS (SELECT (SELECT count(*) FROM task_history WHERE upper(state) = 'FAILED' AND {_window('scheduled_time', ORDERS_AS_OF, 7)}) AS ft,
               (SELECT count(*) FROM alerts WHERE upper(severity) IN ('CRITICAL', 'HIGH') AND {_window('created_at', ORDERS_AS_OF, 7)}) AS sf,
               (SELECT count(*) FROM alerts WHERE upper(status) IN ('NEW', 'OPEN', 'ESCALATED') AND {_window('created_at', ORDERS_AS_OF, 7)}) AS oa,
               (SELECT count(DISTINCT user_name) FROM login_history WHERE is_success = 'NO' AND {_window('event_timestamp', EVENTS_AS_OF, 7)}) AS fu),
s AS (SELECT mv.warehouse_name,
             CAST(least(85.0 - CASE WHEN v > 50 THEN 25 WHEN v > 30 THEN 15 WHEN v > 15 THEN 5 ELSE 0 END, 90.0) AS DOUBLE) AS cost,
             CAST(90.0 - CASE WHEN qf > 50 THEN 30 WHEN qf > 20 THEN 15 WHEN qf > 5 THEN 5 ELSE 0 END
                  - CASE WHEN ft > 10 THEN 20 WHEN ft > 3 THEN 10 ELSE 0 END AS DOUBLE) AS rel,
             CAST(greatest(0.0, 80.0 - CASE WHEN sf > 5 THEN 30 ELSE 10 * sf END - least(20, fu * 3)) AS DOUBLE) AS sec,
             CAST(85.0 - CASE WHEN oa > 20 THEN 25 WHEN oa > 10 THEN 15 WHEN oa > 3 THEN 5 ELSE 0 END AS DOUBLE) AS ops
      FROM mv LEFT JOIN f ON f.warehouse_name = mv.warehouse_name, one),
t AS (SELECT *, cost * 0.3 + rel * 0.3 + sec * 0.2 + ops * 0.2 AS score FROM s)
SELECT warehouse_name, round(cost, 1) AS cost_control_score, round(rel, 1) AS reliability_score, round(sec, 1) AS security_score,
       round(ops, 1) AS operations_score, round(score, 1) AS health_score,
       CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade,
       'unknown' AS trend FROM t
""")
def _(spark, sf):
    return sc.platform_health(sc.platform_evidence(*[tv.load(spark, sf, t) for t in (
        "warehouse_metering", "query_history", "task_history", "alerts", "login_history")], EVENTS_AS_OF, ORDERS_AS_OF))
