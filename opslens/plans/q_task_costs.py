"""Registered queries over task and procedure runs with credits (TSK-7, 8, 10, 11, 13)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from opslens.operators import task_costs as tc
from opslens.operators.cost import SIZE_CREDITS_PER_HOUR
from opslens.operators.graph import graph_impact
from opslens.plans.q_graph import _EDGES
from opslens.plans.registry import register
from opslens.sources import testviews as tv
from opslens.sources.testviews import EVENTS_AS_OF, ORDERS_AS_OF

KEY = "database_name, schema_name, task_name"
ON = "{a}.database_name = {b}.database_name AND {a}.schema_name = {b}.schema_name AND {a}.task_name = {b}.task_name"
DAYS = 730                       # a task runs a few times a month in the tables
SINCE = "1999-08-03 00:00:00"
MONTH_AGO, WEEK_AGO = "2024-01-01 00:00:00", "2024-01-24 00:00:00"


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _credits(size: str, sec: str, cloud: str) -> str:
    rates = " ".join(f"WHEN '{k.upper()}' THEN {v}" for k, v in SIZE_CREDITS_PER_HOUR.items())
    return (f"round(CASE WHEN {sec} > 0 THEN (CASE upper(trim(coalesce({size}, ''))) {rates} ELSE 1 END) * {sec} / 3600.0 ELSE 0.0 END "
            f"+ coalesce({cloud}, 0.0), 6)")


def _objects(text: str) -> str:
    found = ", ".join(f"regexp_extract_all(regexp_replace(coalesce({text}, ''), '\\s+', ' ', 'g'), '(?i){p}{tc.NAME}', 1)" for p in tc.OBJECT_PATTERNS)
    names = f"list_filter(list_transform(flatten([{found}]), lambda x: replace(x, '\"', '')), lambda x: x <> '' AND upper(x) NOT IN {_in(tc.NOT_OBJECTS)})"
    return f"list_slice({_distinct(names)}, 1, 12)"


def _distinct(names: str) -> str:
    return f"list_filter({names}, lambda x, i: list_position({names}, x) = i)"


_FAILED = f"(coalesce(upper(state) IN {_in(tc.FAILED_STATES)}, false) OR upper(trim(coalesce(error_message, ''))) NOT IN {_in(tc.NO_TEXT)})"


def _costed(lo: str, hi: str, failed: str = _FAILED) -> str:
    return f"""
cr AS (SELECT t.database_name, t.schema_name, t.name AS task_name, t.query_id, t.scheduled_time, t.state, {failed} AS failed,
              coalesce(date_diff('second', t.scheduled_time, t.completed_time), 0) AS duration_sec, s.query_text,
              CASE WHEN s.query_id IS NULL THEN 0.0 ELSE {_credits('s.warehouse_size', '(s.total_elapsed_time / 1000.0)', 's.credits_used_cloud_services')} END
                AS est_total_credits
       FROM task_history t LEFT JOIN task_statements s ON t.query_id = s.query_id
       WHERE t.scheduled_time >= TIMESTAMP '{lo}' AND t.scheduled_time < TIMESTAMP '{hi}')
"""


_INVENTORY = """
inv AS (SELECT task_name, upper(state) AS inventory_state, coalesce(warehouse_name, '') AS warehouse_name, coalesce(definition, '') AS definition,
               replace(regexp_extract(definition, '(?i)\\bCALL\\s+([A-Za-z0-9_.$"]+)', 1), '"', '') AS procedure_name,
               CASE WHEN predecessors = '[]' THEN task_name
                    ELSE split_part(split_part(regexp_replace(predecessors, '[\\[\\]''"\\s]', '', 'g'), ',', 1), '.', -1) END AS root_task_name
        FROM task_graph)
"""

_REACH = """
reach(anc, dsc) AS (SELECT source, target FROM edges UNION SELECT r.anc, e.target FROM reach r JOIN edges e ON r.dsc = e.source),
below AS (SELECT anc, count(*) AS c FROM reach GROUP BY 1),
scoped AS (SELECT DISTINCT target FROM edges WHERE source IN (SELECT task_id FROM nodes)),
imp AS (SELECT n.label AS task_name, coalesce(b.c, 0) AS down,
               CASE WHEN s.target IS NULL THEN 'Root' WHEN n.dependent_count = 0 THEN 'Leaf' ELSE 'Intermediate' END AS graph_role
        FROM nodes n LEFT JOIN below b ON n.task_id = b.anc LEFT JOIN scoped s ON n.task_id = s.target)
"""


def _t(spark, sf, view="task_history"):
    return tv.load(spark, sf, view)


_PRIORITY = "CASE " + f"WHEN signal = '{tc.SUSPENDED}' AND (down >= 1 OR role = 'Root') THEN 'P2 - Production Risk' " + " ".join(
    f"WHEN signal = '{n}' AND down >= 3 THEN '{many}' WHEN signal = '{n}' THEN '{few}'" for n, (few, many) in tc.PRIORITY.items()) + " ELSE 'P4 - Review' END"
_READY = "CASE signal " + " ".join(f"WHEN '{n}' THEN '{label}'" for n, label in tc.READINESS.items()) + " END"


@register("task_latest_run_exceptions", "task_history", "task_statements", "task_graph", op="TSK-7", sql="WITH RECURSIVE " + _EDGES + "," + _REACH + ","
          + _INVENTORY + "," + _costed(SINCE, "2001-08-02 00:00:00") + f""",
g AS (SELECT {KEY}, avg(duration_sec) AS ms, avg(est_total_credits) AS mc,
             max({{'t': scheduled_time, 'q': query_id, 's': state, 'd': duration_sec, 'c': est_total_credits, 'f': failed, 'x': query_text}}) AS l
      FROM cr GROUP BY 1, 2, 3),
lf AS (SELECT {KEY}, max(scheduled_time) AS failure_at FROM cr WHERE state = 'FAILED' GROUP BY 1, 2, 3),
rc AS (SELECT {KEY.replace('d', 'lf.d', 1).replace(', ', ', lf.')}, failure_at, min(cr.scheduled_time) AS recovery_at
       FROM lf LEFT JOIN cr ON {ON.format(a='lf', b='cr')} AND cr.state = 'SUCCEEDED' AND cr.scheduled_time > lf.failure_at GROUP BY 1, 2, 3, 4),
rh AS (SELECT *, date_diff('microsecond', failure_at, coalesce(recovery_at, TIMESTAMP '2001-08-02 00:00:00')) / 1e6 / 3600.0 AS h FROM rc),
j AS (SELECT g.*, CASE WHEN rh.failure_at IS NULL THEN NULL WHEN recovery_at IS NULL THEN 'Open Failure' WHEN h <= 4.0 THEN 'Recovered Within SLA'
                       ELSE 'Recovered Late' END AS recovery_state, CASE WHEN h IS NOT NULL THEN round(greatest(h, 0.0), 2) END AS recovery_hours
      FROM g LEFT JOIN rh ON {ON.format(a='g', b='rh')}),
sig AS (SELECT *, '{tc.FAILED}' AS signal, 'High' AS sev, true AS own FROM j WHERE l.f
        UNION ALL SELECT *, '{tc.SLOW}', CASE WHEN l.d > ms * 2 THEN 'High' ELSE 'Medium' END, true FROM j WHERE ms > 0 AND l.d > ms * 1.5 AND l.d > 300
        UNION ALL SELECT *, '{tc.COST}', CASE WHEN l.c > mc * 2 THEN 'High' ELSE 'Medium' END, true FROM j WHERE mc > 0 AND l.c > mc * 1.5 AND l.c >= 0.01
        UNION ALL SELECT *, '{tc.OPEN}', 'High', false FROM j WHERE recovery_state = 'Open Failure' AND NOT l.f
        UNION ALL SELECT *, '{tc.LATE}', 'Late', false FROM j WHERE recovery_state = 'Recovered Late'),
u AS (SELECT {KEY}, signal, sev, l.q AS query_id, l.s AS state, CASE WHEN own THEN l.d ELSE 0 END AS duration_sec,
             CASE WHEN own THEN round(ms, 1) ELSE 0 END AS avg_duration_sec,
             CASE WHEN own AND ms > 0 THEN round((l.d - ms) / ms * 100, 1) ELSE 0 END AS duration_change_pct,
             CASE WHEN own THEN l.c ELSE 0 END AS est_total_credits, CASE WHEN own THEN round(mc, 6) ELSE 0 END AS avg_est_credits,
             CASE WHEN own AND mc > 0 THEN round((l.c - mc) / mc * 100, 1) ELSE 0 END AS cost_change_pct, recovery_state, recovery_hours, l.x AS txt
      FROM sig
      UNION ALL SELECT database_name, schema_name, task_name, '{tc.SUSPENDED}', 'Medium', '', state, 0, 0, 0, 0, 0, 0, NULL, NULL, ''
      FROM task_graph WHERE upper(state) = 'SUSPENDED'),
w AS (SELECT u.*, coalesce(inv.root_task_name, '') AS root_task_name, coalesce(inv.procedure_name, '') AS procedure_name, inv.definition,
             CAST(coalesce(imp.down, 0) AS BIGINT) AS down, coalesce(imp.graph_role, 'Unknown') AS role, imp.task_name IS NOT NULL AS known
      FROM u LEFT JOIN inv ON u.task_name = inv.task_name LEFT JOIN imp ON u.task_name = imp.task_name),
o AS (SELECT *, list_concat({_objects("coalesce(definition, '')")}, {_objects("coalesce(txt, '')")}) AS found FROM w)
SELECT {KEY}, signal, CASE WHEN sev <> 'Late' THEN sev WHEN down >= 3 THEN 'High' ELSE 'Medium' END AS severity, query_id, state,
       CAST(duration_sec AS DOUBLE) AS duration_sec, avg_duration_sec, duration_change_pct, est_total_credits, avg_est_credits, cost_change_pct,
       recovery_state, recovery_hours, root_task_name, procedure_name,
       coalesce(array_to_string(list_slice(list_filter(found, lambda x, i: list_position(found, x) = i), 1, 12), ', '), '') AS impact_objects,
       down AS downstream_task_count, role AS graph_role,
       CASE WHEN NOT known THEN 'Unknown' WHEN down >= 5 THEN 'High' WHEN down >= 1 THEN 'Medium' ELSE 'Local' END AS blast_radius,
       CASE WHEN role = 'Root' THEN 'Root graph retry' ELSE 'Targeted task retry' END AS retry_scope,
       {_PRIORITY} AS incident_priority, {_READY} AS recovery_readiness
FROM o
""")
def _(spark, sf):
    inventory = _t(spark, sf, "task_graph")
    return tc.run_exceptions(_t(spark, sf), _t(spark, sf, "task_statements"), inventory, graph_impact(inventory), ORDERS_AS_OF, DAYS)


@register("task_critical_path", "task_history", "task_graph", op="TSK-8", sql="WITH RECURSIVE " + _EDGES + "," + _REACH + "," + _INVENTORY + f""",
r AS (SELECT coalesce(inv.root_task_name, t.name) AS root, {_FAILED} AS failed, coalesce(upper(t.state) IN {_in(tc.SUCCESS_STATES)}, false) AS ok,
             coalesce(completed_time, scheduled_time) AS seen, coalesce(date_diff('second', scheduled_time, completed_time), 0) AS sec
      FROM task_history t LEFT JOIN inv ON t.name = inv.task_name WHERE scheduled_time >= TIMESTAMP '{SINCE}'),
h AS (SELECT root, count(*) AS runs, count_if(failed) AS failures, count_if(ok) AS successes, max(seen) AS last_run_at, max(sec) AS max_duration_sec
      FROM r GROUP BY 1),
gs AS (SELECT root_task_name, count(DISTINCT inv.task_name) AS task_count, count_if(inventory_state = 'SUSPENDED') AS suspended_tasks,
              CAST(max(coalesce(imp.down, 0)) AS BIGINT) AS downstream_task_count,
              array_to_string(list_slice(list_sort(list_filter(list_distinct(list(warehouse_name)), lambda x: trim(x) <> '')), 1, 5), ', ') AS warehouses,
              array_to_string(list_slice(list_sort(list_filter(list_distinct(list(procedure_name)), lambda x: trim(x) <> '')), 1, 5), ', ') AS procedures
       FROM inv LEFT JOIN imp ON inv.task_name = imp.task_name GROUP BY 1),
s AS (SELECT gs.*, coalesce(runs, 0) AS runs, coalesce(failures, 0) AS failures, coalesce(successes, 0) AS successes,
             coalesce(max_duration_sec, 0) AS max_duration_sec, last_run_at FROM gs LEFT JOIN h ON gs.root_task_name = h.root)
SELECT *, CASE WHEN downstream_task_count >= 5 THEN 'High' WHEN downstream_task_count >= 1 THEN 'Medium' ELSE 'Local' END AS blast_radius,
       round(failures * 12 + suspended_tasks * 10 + downstream_task_count * 5 + least(max_duration_sec / 300.0, 20.0), 1) AS critical_path_score,
       CASE WHEN failures > 0 OR suspended_tasks > 0 THEN 'Incident Path' WHEN downstream_task_count >= 3 OR max_duration_sec >= 900 THEN 'Watch Path'
            ELSE 'Stable Path' END AS critical_path_state
FROM s
""")
def _(spark, sf):
    inventory = _t(spark, sf, "task_graph")
    return tc.critical_paths(_t(spark, sf), inventory, graph_impact(inventory), ORDERS_AS_OF, DAYS)


def _procedures(where: str) -> str:
    return f"""
q AS (SELECT * FROM query_history WHERE {where}),
calls AS (SELECT query_id AS root_query_id, trim(regexp_extract(query_text, '(?i)CALL\\s+([^(]+)', 1)) AS procedure_name, database_name, schema_name,
                 user_name, role_name, warehouse_name, warehouse_size AS call_size, start_time FROM q WHERE query_type = 'CALL'),
kids AS (SELECT coalesce(root_query_id, query_id) AS root, count(query_id) AS n, sum(coalesce(total_elapsed_time, 0)) AS ms,
                sum(coalesce(credits_used_cloud_services, 0.0)) AS cloud, max(warehouse_size) AS kid_size,
                count_if(execution_status <> 'SUCCESS') AS failed FROM q GROUP BY 1),
k AS (SELECT c.*, coalesce(kid_size, call_size) AS warehouse_size, coalesce(n, 0) AS n, coalesce(ms, 0) / 1000.0 AS sec, coalesce(cloud, 0.0) AS cloud,
             coalesce(failed, 0) > 0 AS failed FROM calls c LEFT JOIN kids ON c.root_query_id = kids.root),
pr AS (SELECT root_query_id, procedure_name, database_name, schema_name, user_name, role_name, warehouse_name, warehouse_size, start_time,
              n AS downstream_query_count, sec AS total_elapsed_sec, round(cloud, 6) AS cloud_credits,
              {_credits('warehouse_size', 'sec', 'cloud')} AS est_total_credits, failed FROM k)
"""


@register("procedure_lineage", "query_history", op="TSK-10", sql="WITH " + _procedures(f"start_time >= TIMESTAMP '{WEEK_AGO}'") + "SELECT * FROM pr")
def _(spark, sf):
    return tc.procedure_runs(_t(spark, sf, "query_history"), EVENTS_AS_OF, 7)


_PROC_BASE = "WITH " + _procedures(f"start_time >= TIMESTAMP '{MONTH_AGO}'") + """,
g AS (SELECT upper(concat_ws('.', database_name, schema_name, split_part(procedure_name, '.', -1))) AS procedure_key, count(*) AS runs,
             avg(total_elapsed_sec) AS ms, avg(est_total_credits) AS mc,
             max({'t': start_time, 'q': root_query_id, 'd': total_elapsed_sec, 'c': est_total_credits, 'w': warehouse_name, 'z': warehouse_size,
                  'n': downstream_query_count}) AS l
      FROM pr GROUP BY 1),
""" + f"""
e AS (SELECT *, '{tc.PROC_SLOW}' AS signal, CASE WHEN l.d > ms * 2 THEN 'High' ELSE 'Medium' END AS severity FROM g
      WHERE ms > 0 AND l.d > ms * 1.5 AND l.d > 300
      UNION ALL SELECT *, '{tc.PROC_COST}', CASE WHEN l.c > mc * 2 THEN 'High' ELSE 'Medium' END FROM g WHERE mc > 0 AND l.c > mc * 1.5 AND l.c >= 0.01)
"""


@register("procedure_exceptions", "query_history", op="TSK-11", sql=_PROC_BASE + """
SELECT procedure_key, signal, severity, runs, l.q AS root_query_id, l.t AS latest_call_at, l.w AS warehouse_name, l.z AS warehouse_size,
       l.d AS latest_elapsed_sec, round(ms, 3) AS avg_elapsed_sec, CASE WHEN ms > 0 THEN round((l.d - ms) / ms * 100, 1) ELSE 0 END AS runtime_change_pct,
       l.c AS est_total_credits, round(mc, 6) AS avg_est_credits, CASE WHEN mc > 0 THEN round((l.c - mc) / mc * 100, 1) ELSE 0 END AS cost_change_pct,
       l.n AS downstream_query_count
FROM e
""")
def _(spark, sf):
    return tc.procedure_exceptions(tc.procedure_runs(_t(spark, sf, "query_history"), EVENTS_AS_OF, 30))


@register("procedure_run_summary", "query_history", op="TSK-11", sql=_PROC_BASE + f"""
SELECT (SELECT count(*) FROM pr) AS runs, (SELECT count(*) FROM g) AS procedures,
       (SELECT count(*) FROM e WHERE signal = '{tc.PROC_SLOW}') AS sla_breaches, (SELECT count(*) FROM e WHERE signal = '{tc.PROC_COST}') AS cost_breaches
""")
def _(spark, sf):
    return tc.procedure_summary(tc.procedure_runs(_t(spark, sf, "query_history"), EVENTS_AS_OF, 30))


def _compared(source: str, entity: str, time: str, at: str) -> str:
    sides = []
    for side, flag in (("before", f"{time} < TIMESTAMP '{at}'"), ("after", f"{time} >= TIMESTAMP '{at}'")):
        when = f"CASE WHEN {flag} THEN {{}} END"
        sec, cr = when.format("duration_sec"), when.format("est_total_credits")
        sides.append(f"count_if({flag}) AS runs_{side}, count_if({flag} AND failed) AS failures_{side}, coalesce(avg({sec}), 0) AS as_{side}, "
                     f"coalesce(quantile_cont({sec}, 0.95), 0) AS p_{side}, CAST(coalesce(max({sec}), 0) AS DOUBLE) AS max_sec_{side}, "
                     f"coalesce(sum({cr}), 0) AS c_{side}")
    pct = "CASE WHEN {m}_before = 0 THEN CASE WHEN {m}_after > 0 THEN 100.0 ELSE 0.0 END ELSE round(({m}_after - {m}_before) / {m}_before * 100, 1) END"
    return f"""
a AS (SELECT {entity}, {', '.join(sides)} FROM {source} GROUP BY ALL),
b AS (SELECT *, failures_after - failures_before AS fd, as_after - as_before AS sd, c_after - c_before AS cd,
             {pct.format(m='as')} AS sp, {pct.format(m='c')} AS cp FROM a),
c AS (SELECT *, sp >= 25 AND sd >= 30 AS slow, cp >= 25 AND cd > 5e-7 AS dear FROM b)
SELECT {entity}, runs_before, runs_after, failures_before, failures_after, round(as_before, 1) AS avg_sec_before, round(as_after, 1) AS avg_sec_after,
       round(p_before, 1) AS p95_sec_before, round(p_after, 1) AS p95_sec_after, max_sec_before, max_sec_after, round(c_before, 6) AS credits_before,
       round(c_after, 6) AS credits_after, fd AS failures_delta, round(sd, 1) AS avg_sec_delta, CAST(sp AS DOUBLE) AS avg_sec_change_pct,
       round(cd, 6) AS credits_delta, CAST(cp AS DOUBLE) AS credits_change_pct,
       CASE WHEN NOT (fd > 0 OR slow OR dear) THEN 'Stable' WHEN fd > 0 OR sp >= 50 OR cp >= 50 THEN 'High' ELSE 'Medium' END AS severity,
       concat_ws('; ', CASE WHEN fd > 0 THEN CAST(fd AS VARCHAR) || ' more failures' END,
                 CASE WHEN slow THEN 'runtime +' || CAST(CAST(sp AS DECIMAL(20, 1)) AS VARCHAR) || '%' END,
                 CASE WHEN dear THEN 'credits +' || CAST(CAST(cp AS DECIMAL(20, 1)) AS VARCHAR) || '%' END) AS signal
FROM c
"""


@register("task_release_comparison", "task_history", "task_statements", op="TSK-13", sql="WITH "
          + _costed("2000-08-01 00:00:00", "2001-08-01 00:00:00", f"(coalesce(upper(state) IN {_in(tc.FAILED_STATES)}, false) OR trim(coalesce(error_code, '')) <> '')")
          + "," + _compared("cr", KEY, "scheduled_time", "2001-01-30 12:00:00"))
def _(spark, sf):
    return tc.task_release_comparison(_t(spark, sf), _t(spark, sf, "task_statements"), datetime(2001, 1, 30, 12), 182.5)


@register("procedure_release_comparison", "query_history", op="TSK-13", sql="WITH "
          + _procedures("start_time >= TIMESTAMP '2024-01-05 00:00:00' AND start_time < TIMESTAMP '2024-01-25 00:00:00'")
          + ", prd AS (SELECT *, total_elapsed_sec AS duration_sec FROM pr WHERE procedure_name <> ''),"
          + _compared("prd", "procedure_name", "start_time", "2024-01-15 00:00:00"))
def _(spark, sf):
    return tc.procedure_release_comparison(_t(spark, sf, "query_history"), datetime(2024, 1, 15), 10)


@register("statement_objects", "query_history", op="SCA-7", sql=f"""
SELECT query_id, array_to_string({_objects('query_text')}, ', ') AS objects FROM query_history
""")
def _(spark, sf):
    return _t(spark, sf, "query_history").select("query_id", F.concat_ws(", ", tc.object_names("query_text")).alias("objects"))
