"""Registered queries over daily and hourly facts, AI usage by source and
governance (SUM-8, SUM-10, USE-5, USE-8, USE-9, STO-1, AIC-1..3, GOV-2..5)."""

from __future__ import annotations


from opslens.functions import scope
from opslens.functions.timeutil import trunc
from opslens.operators import boards as bd
from opslens.operators import chargeback as chb
from opslens.operators import rollups as ru
from opslens.operators import security as sec
from opslens.plans.fixtures import ENV_SQL, TENANT_SQL, environments, tenants
from opslens.plans.q_cost import pqc_cte
from opslens.plans.q_task_costs import MONTH_AGO, WEEK_AGO, _procedures
from opslens.plans.registry import register
from opslens.sources import testviews as tv
from opslens.sources.testviews import EVENTS_AS_OF, LINEITEM_AS_OF

GB, TB = "(1024.0 * 1024 * 1024)", "(1024.0 * 1024 * 1024 * 1024)"
DAY_AGO = "2024-01-30 00:00:00"


def _v(spark, sf, name):
    return tv.load(spark, sf, name)


def _fact(spark, sf, days):
    return bd.query_hourly_fact(_v(spark, sf, "query_history"), scope.tenant_label(tenants()), scope.environment_label(environments()), EVENTS_AS_OF, days)


# ------------------------------------------------------------------ adoption

_MEASURES = ("count(*) AS query_count, count(DISTINCT user_name) AS users, round(count(*) / nullif(count(DISTINCT user_name), 0), 1) AS queries_per_user, "
             "round(sum(total_elapsed_time) / nullif(count(*), 0) / 1000, 2) AS avg_elapsed_sec, "
             "round(100 * count_if(execution_status <> 'SUCCESS') / nullif(count(*), 0), 1) AS error_rate")


def _adoption(name, sql_dims, *dims):
    keys = "".join(d + ", " for d in sql_dims)
    group = f" GROUP BY {', '.join(str(i + 1) for i in range(len(sql_dims)))}" if sql_dims else ""

    @register(name, "query_history", op="USE-8", sql=f"SELECT {keys}{_MEASURES} FROM query_history "
              f"WHERE start_time >= TIMESTAMP '{MONTH_AGO}' AND warehouse_name IS NOT NULL{group}")
    def _(spark, sf):
        return ru.adoption(_fact(spark, sf, 30), EVENTS_AS_OF, 30, *[d() if callable(d) else d for d in dims])


_adoption("adoption_summary", [])
_adoption("adoption_by_size", ["coalesce(warehouse_size, 'UNKNOWN') AS warehouse_size"], "warehouse_size")
_adoption("adoption_trend", ["CAST(date_trunc('day', start_time) AS TIMESTAMP) AS activity_day"], lambda: trunc("day", "hour_start").alias("activity_day"))
_adoption("adoption_by_warehouse", ["warehouse_name"], "warehouse_name")
_adoption("adoption_by_database", ["coalesce(database_name, 'UNKNOWN') AS database_name"], "database_name")
_adoption("adoption_by_role_and_type", ["coalesce(role_name, 'UNKNOWN') AS role_name", "coalesce(query_type, 'UNKNOWN') AS query_type"], "role_name", "query_type")

_QUEUED = "sum(queued_overload_time + queued_provisioning_time)"


@register("warehouse_pressure", "query_history", op="USE-9", sql=f"""
SELECT warehouse_name, max(warehouse_size) AS warehouse_size, count(*) AS total_queries, count_if(execution_status <> 'SUCCESS') AS failed_queries,
       round({_QUEUED} / 1000.0, 2) AS queued_sec, round(sum(bytes_spilled_to_remote_storage) / {GB}, 2) AS remote_spill_gb
FROM query_history WHERE start_time >= TIMESTAMP '{DAY_AGO}' AND warehouse_name IS NOT NULL GROUP BY 1
""")
def _(spark, sf):
    return ru.warehouse_pressure(_fact(spark, sf, 7), EVENTS_AS_OF, 24)


@register("pressure_counts", "query_history", op="USE-5", sql=f"""
WITH w AS (SELECT warehouse_name, {_QUEUED} AS q, sum(bytes_spilled_to_remote_storage) / {GB} AS s, count_if(execution_status <> 'SUCCESS') AS f
           FROM query_history WHERE start_time >= TIMESTAMP '{WEEK_AGO}' AND warehouse_name IS NOT NULL GROUP BY 1)
SELECT count(*) AS active_warehouses, count_if(q > 0 OR s > 1 OR f > 0) AS pressure_warehouses FROM w
""")
def _(spark, sf):
    return ru.pressured(_fact(spark, sf, 7), EVENTS_AS_OF, 7)


# ------------------------------------------------------------------ facts

def _detail(spark, sf):
    return ru.query_detail_fact(_v(spark, sf, "query_history"), scope.tenant_label(tenants()), scope.environment_label(environments()), EVENTS_AS_OF, 7)


@register("query_detail_fact", "query_history", op="SUM-8", sql=f"""
SELECT {TENANT_SQL} AS company, {ENV_SQL} AS environment, query_id, start_time, user_name, role_name, warehouse_name, warehouse_size, database_name, schema_name,
       query_type, execution_status, error_code, error_message, total_elapsed_time, execution_time, queued_overload_time, queued_provisioning_time, bytes_scanned,
       bytes_spilled_to_local_storage, bytes_spilled_to_remote_storage, query_hash, root_query_id, query_text
FROM query_history WHERE start_time >= TIMESTAMP '{WEEK_AGO}'
""")
def _(spark, sf):
    return _detail(spark, sf)


@register("control_room_summary", "query_history", op="SUM-8", sql=f"""
SELECT count(*) AS total_queries, count_if(error_code IS NOT NULL OR upper(coalesce(execution_status, '')) = 'FAILED_WITH_ERROR') AS failed_queries,
       count_if(queued_overload_time + queued_provisioning_time > 0) AS queued_queries, count_if(bytes_spilled_to_remote_storage > 0) AS remote_spill_queries,
       round(avg(total_elapsed_time / 1000.0), 2) AS avg_elapsed_sec, round(quantile_cont(total_elapsed_time / 1000.0, 0.95), 2) AS p95_elapsed_sec,
       count(DISTINCT warehouse_name) AS active_warehouses, count(DISTINCT user_name) AS active_users
FROM query_history WHERE start_time >= TIMESTAMP '{DAY_AGO}' AND warehouse_name IS NOT NULL
""")
def _(spark, sf):
    return ru.control_room_summary(_detail(spark, sf), EVENTS_AS_OF, 24)


@register("grant_daily_fact", "role_grants", op="SUM-10", sql=f"""
SELECT CAST(created_on AS DATE) AS grant_date, role, grantee_name, count(*) AS grant_count, count_if(deleted_on IS NOT NULL) AS revoked_count,
       max(created_on) AS last_granted FROM role_grants WHERE created_on >= TIMESTAMP '{MONTH_AGO}' GROUP BY 1, 2, 3
""")
def _(spark, sf):
    return ru.grant_daily_fact(_v(spark, sf, "role_grants"), EVENTS_AS_OF, 30)


@register("recent_grants", "role_grants", op="SUM-10", sql=f"""
SELECT count_if(deleted_on IS NULL) AS recent_grants FROM role_grants WHERE created_on >= TIMESTAMP '{WEEK_AGO}'
""")
def _(spark, sf):
    return ru.recent_grants(ru.grant_daily_fact(_v(spark, sf, "role_grants"), EVENTS_AS_OF, 30), EVENTS_AS_OF, 7)


_LOADS = """table_catalog_name AS database_name, table_schema_name AS schema_name, table_name, status, count(*) AS file_count,
       CAST(sum(row_count) AS BIGINT) AS row_count, CAST(sum(error_count) AS BIGINT) AS error_count, CAST(sum(file_size) AS BIGINT) AS file_size_bytes,
       max(last_load_time) AS last_seen, max(first_error_message) AS latest_error FROM copy_history"""


@register("copy_load_daily_fact", "copy_history", op="SUM-10", sql=f"""
SELECT CAST(last_load_time AS DATE) AS load_date, {_LOADS} WHERE last_load_time >= TIMESTAMP '2001-10-06 00:00:00' AND last_load_time < TIMESTAMP '2001-11-05 00:00:00'
GROUP BY 1, 2, 3, 4, 5
""")
def _(spark, sf):
    return ru.copy_load_daily_fact(_v(spark, sf, "copy_history"), LINEITEM_AS_OF, 30)


@register("load_failures_from_fact", "copy_history", op="SUM-10", sql=f"""
SELECT {_LOADS} WHERE last_load_time >= TIMESTAMP '2000-11-05 00:00:00' AND last_load_time < TIMESTAMP '2001-11-05 00:00:00' AND status <> 'LOADED' GROUP BY 1, 2, 3, 4
""")
def _(spark, sf):
    return ru.load_failures(ru.copy_load_daily_fact(_v(spark, sf, "copy_history"), LINEITEM_AS_OF, 365), LINEITEM_AS_OF, 365)


def _procedure_fact(spark, sf):
    return ru.procedure_run_fact(_v(spark, sf, "query_history"), scope.tenant_label(tenants()), EVENTS_AS_OF, 30)


_PR = "WITH " + _procedures(f"start_time >= TIMESTAMP '{MONTH_AGO}'")


@register("procedure_run_fact", "query_history", op="SUM-10", sql=_PR + f"""
SELECT root_query_id, {TENANT_SQL} AS company, database_name, schema_name, procedure_name, user_name, start_time, downstream_query_count AS child_query_count,
       CAST(total_elapsed_sec * 1000 AS BIGINT) AS total_duration_ms, est_total_credits AS est_credits FROM pr
""")
def _(spark, sf):
    return _procedure_fact(spark, sf)


@register("procedure_usage", "query_history", op="SUM-10", sql=_PR + """
SELECT database_name, schema_name, procedure_name, count(*) AS call_count, CAST(sum(downstream_query_count) AS BIGINT) AS downstream_query_count,
       round(sum(est_total_credits), 6) AS total_credits, max(start_time) AS last_call, round(avg(total_elapsed_sec), 3) AS avg_elapsed_sec
FROM pr GROUP BY 1, 2, 3
""")
def _(spark, sf):
    return ru.procedure_usage(_procedure_fact(spark, sf), EVENTS_AS_OF, 30)


@register("chargeback_rollup", "query_history", "warehouse_metering", op="SUM-10", sql="WITH " + pqc_cte() + f""",
qq AS (SELECT query_id, CAST(start_time AS DATE) AS usage_date, database_name, user_name, role_name, warehouse_name, warehouse_size,
              {TENANT_SQL} AS company, {ENV_SQL} AS environment FROM query_history),
d AS (SELECT usage_date, company, environment, database_name, user_name, role_name, qq.warehouse_name, warehouse_size, count(*) AS n,
             round(sum(p.metered_credits), 6) AS c, round(sum(p.metered_credits) * 3.68, 2) AS usd
      FROM pqc p JOIN qq ON p.query_id = qq.query_id GROUP BY ALL)
SELECT company, environment, database_name, user_name, role_name, warehouse_name, warehouse_size, CAST(sum(n) AS BIGINT) AS query_count,
       round(sum(c), 4) AS total_credits, round(sum(usd), 2) AS est_cost FROM d GROUP BY 1, 2, 3, 4, 5, 6, 7
""")
def _(spark, sf):
    fact = chb.chargeback_detail(_v(spark, sf, "query_history"), _v(spark, sf, "warehouse_metering"), EVENTS_AS_OF, scope.tenant_label(tenants()),
                                 scope.environment_label(environments()), 7)
    return ru.chargeback_rollup(fact, EVENTS_AS_OF, 7)


# ------------------------------------------------------------------ storage

_STORAGE = f"""
sf AS (SELECT usage_date AS snapshot_date, database_name, sum(average_database_bytes) AS active_bytes, sum(average_failsafe_bytes) AS failsafe_bytes,
              round((sum(average_database_bytes) + sum(average_failsafe_bytes)) / {TB}, 6) AS est_storage_tb,
              round((sum(average_database_bytes) + sum(average_failsafe_bytes)) / {TB} * 23.0, 4) AS est_cost_usd
       FROM database_storage GROUP BY 1, 2)
"""


def _storage(spark, sf):
    return ru.storage_daily_fact(_v(spark, sf, "database_storage"), 23.0)


@register("storage_days", "database_storage", "stage_storage", op="STO-1", sql="WITH " + _STORAGE + f""",
d AS (SELECT snapshot_date, sum(active_bytes) AS a, sum(failsafe_bytes) AS f, sum(est_cost_usd) AS c FROM sf
      WHERE snapshot_date >= DATE '2001-10-06' AND snapshot_date < DATE '2001-11-05' GROUP BY 1),
s AS (SELECT usage_date, average_stage_bytes AS s FROM stage_storage WHERE usage_date >= DATE '2001-10-06' AND usage_date < DATE '2001-11-05')
SELECT coalesce(d.snapshot_date, s.usage_date) AS usage_date, round(coalesce(a, 0) / {GB}, 3) AS storage_gb, round(coalesce(f, 0) / {GB}, 3) AS failsafe_gb,
       round(coalesce(s, 0) / {GB}, 3) AS stage_gb, round((coalesce(a, 0) + coalesce(f, 0) + coalesce(s, 0)) / {TB}, 6) AS total_storage_tb,
       round(coalesce(c, 0), 2) AS est_monthly_cost_usd
FROM d FULL JOIN s ON d.snapshot_date = s.usage_date
""")
def _(spark, sf):
    return ru.storage_days(_storage(spark, sf), _v(spark, sf, "stage_storage"), LINEITEM_AS_OF, 30)


@register("storage_latest_by_database", "database_storage", op="STO-1", sql="WITH " + _STORAGE + f"""
SELECT database_name, snapshot_date AS usage_date, round(active_bytes / {GB}, 3) AS database_gb, round(failsafe_bytes / {GB}, 3) AS failsafe_gb,
       est_storage_tb, est_cost_usd FROM sf WHERE snapshot_date = (SELECT max(snapshot_date) FROM sf)
""")
def _(spark, sf):
    return ru.storage_latest(_storage(spark, sf))


@register("storage_latest_total", "database_storage", op="STO-1", sql="WITH " + _STORAGE + """
SELECT coalesce(round(sum(est_storage_tb), 2), 0) AS storage_tb FROM sf WHERE snapshot_date = (SELECT max(snapshot_date) FROM sf)
""")
def _(spark, sf):
    return ru.storage_kpi(_storage(spark, sf))


# ------------------------------------------------------------------ AI usage

BUDGET = 0.2                    # dollars: credits of the fixture are small


def _ai(spark, sf):
    return _v(spark, sf, "ai_usage").withColumnRenamed("interface", "source")


_AI = f"""
WITH d AS (SELECT user_name, interface AS source, CAST(start_time AS DATE) AS d, count(*) AS n, sum(credits_used) AS c, sum(tokens) AS t
           FROM ai_usage WHERE start_time >= TIMESTAMP '{MONTH_AGO}' GROUP BY 1, 2, 3),
u AS (SELECT user_name, source, count(*) AS active_days, CAST(sum(n) AS BIGINT) AS total_requests, sum(c) AS c, CAST(sum(t) AS BIGINT) AS total_tokens,
             sum(c) / sum(n) AS cpr, sum(c) / count(*) AS daily, sum(c) / count(*) * 30 AS month FROM d GROUP BY 1, 2)
"""
_AI_SHOWN = """user_name, source, active_days, total_requests, round(c, 6) AS total_credits, total_tokens, round(cpr, 6) AS credits_per_request,
       round(daily, 6) AS avg_daily_credits, round(month, 6) AS projected_30d_credits, round(month * 2.2, 2) AS projected_30d_cost"""


@register("ai_source_rollup", "ai_usage", op="AIC-1", sql=_AI + f"SELECT {_AI_SHOWN} FROM u")
def _(spark, sf):
    return ru.ai_source_rollup(_ai(spark, sf), EVENTS_AS_OF, 30)


@register("ai_source_summary", "ai_usage", op="AIC-1", sql=_AI + f"""
SELECT count(DISTINCT user_name) AS active_users, CAST(sum(total_requests) AS BIGINT) AS total_requests, round(sum(c), 6) AS total_credits,
       CAST(sum(total_tokens) AS BIGINT) AS total_tokens, round(sum(c) / nullif(sum(total_requests), 0), 6) AS credits_per_request,
       round(sum(c) / 30 * 30, 6) AS projected_30d_credits, round(sum(c) / 30 * 30 * 2.2, 2) AS projected_30d_cost,
       count_if(month > {BUDGET} / 2.2 * 0.25) AS heavy_users
FROM u
""")
def _(spark, sf):
    return ru.ai_source_summary(_ai(spark, sf), EVENTS_AS_OF, BUDGET, 30)


@register("ai_source_exceptions", "ai_usage", op="AIC-2", sql=_AI + f"""
SELECT CASE WHEN month > {BUDGET} / 2.2 THEN 'Critical' WHEN month > {BUDGET} / 2.2 * 0.5 OR cpr > 0.002 THEN 'High' ELSE 'Medium' END AS severity,
       CASE WHEN month > {BUDGET} / 2.2 THEN 'Budget Breach' WHEN month > {BUDGET} / 2.2 * 0.5 THEN 'Budget Concentration'
            WHEN cpr > 0.002 THEN 'Cost Per Request Spike' ELSE 'High Usage' END AS signal, {_AI_SHOWN}
FROM u WHERE month > {BUDGET} / 2.2 * 0.25 OR cpr > 0.002
""")
def _(spark, sf):
    return ru.ai_source_exceptions(_ai(spark, sf), EVENTS_AS_OF, BUDGET, 30, per_request=0.002)


@register("ai_daily_by_source", "ai_usage", op="AIC-3", sql=f"""
SELECT CAST(start_time AS DATE) AS usage_date, interface AS source, count(DISTINCT user_name) AS active_users, count(*) AS total_requests,
       round(sum(credits_used), 6) AS total_credits, CAST(sum(tokens) AS BIGINT) AS total_tokens, round(sum(credits_used) * 2.2, 2) AS cost_usd
FROM ai_usage WHERE start_time >= TIMESTAMP '{MONTH_AGO}' GROUP BY 1, 2
""")
def _(spark, sf):
    return ru.ai_daily_by_source(_ai(spark, sf), EVENTS_AS_OF, 30)


# ------------------------------------------------------------------ governance

@register("policy_references", "policy_references", op="GOV-2", sql="""
SELECT policy_catalog AS database_name, policy_schema AS schema_name, policy_name, policy_kind, ref_database_name, ref_schema_name,
       ref_entity_name AS table_name, ref_column_name AS column_name FROM policy_references WHERE deleted IS NULL
""")
def _(spark, sf):
    return ru.policy_references(_v(spark, sf, "policy_references"))


_DAYS = f"""
days AS (SELECT CAST(query_start_time AS DATE) AS access_date, count(*) AS access_records, count(DISTINCT user_name) AS unique_users,
                count(DISTINCT json_array_length(CAST(direct_objects_accessed AS JSON))) AS object_diversity
         FROM access_history WHERE query_start_time >= TIMESTAMP '{WEEK_AGO}' GROUP BY 1)
"""


@register("access_history_days", "access_history", op="GOV-2", sql="WITH " + _DAYS + "SELECT * FROM days")
def _(spark, sf):
    return ru.access_history_days(_v(spark, sf, "access_history"), EVENTS_AS_OF, 7)


@register("governance_scorecard", "columns", "tag_references", "policy_references", "access_history", op="GOV-3", sql="WITH " + _DAYS + """,
c AS (SELECT DISTINCT table_catalog, table_schema, table_name, column_name, column_name AS cc FROM tag_references
      WHERE domain = 'COLUMN' AND tag_name IN ('SEMANTIC_CATEGORY', 'PRIVACY_CATEGORY', 'PII', 'SENSITIVITY')),
g AS (SELECT a.table_catalog, count(DISTINCT a.column_name) AS n, count(DISTINCT c.cc) AS k FROM columns a LEFT JOIN c
        ON a.table_catalog = c.table_catalog AND a.table_schema = c.table_schema AND a.table_name = c.table_name AND a.column_name = c.column_name GROUP BY 1),
j AS (SELECT (SELECT avg(round(k * 100.0 / n, 1)) FROM g WHERE n > 5) AS pct, (SELECT count(*) FROM policy_references WHERE deleted IS NULL) AS policy_count,
             (SELECT count_if(upper(policy_kind) = 'MASKING_POLICY') FROM policy_references WHERE deleted IS NULL) AS masking_policies,
             (SELECT count_if(upper(policy_kind) = 'ROW_ACCESS_POLICY') FROM policy_references WHERE deleted IS NULL) AS row_access_policies,
             (SELECT count(*) FROM days) AS access_history_days),
s AS (SELECT *, least(100, 50 + CASE WHEN pct >= 80 THEN 20 WHEN pct >= 40 THEN 10 ELSE 0 END + CASE WHEN masking_policies > 0 THEN 10 ELSE 0 END
                + CASE WHEN row_access_policies > 0 THEN 10 ELSE 0 END + CASE WHEN access_history_days >= 5 THEN 10 ELSE 0 END) AS score FROM j)
SELECT CAST(score AS BIGINT) AS overall_score, coalesce(round(pct, 1), 0) AS classification_pct, policy_count, masking_policies, row_access_policies,
       access_history_days, CASE WHEN score >= 80 THEN 'Audit Ready' WHEN score >= 60 THEN 'Progressing' WHEN score >= 40 THEN 'Gaps Identified'
                                 ELSE 'Not Ready' END AS readiness_level
FROM s
""")
def _(spark, sf):
    return ru.governance_scorecard(sec.classification_coverage(_v(spark, sf, "columns"), _v(spark, sf, "tag_references"), 5),
                                   ru.policy_references(_v(spark, sf, "policy_references")), ru.access_history_days(_v(spark, sf, "access_history"), EVENTS_AS_OF, 7))


_COVERED = """
WITH a AS (SELECT DISTINCT 'DATABASE' AS object_type, database_name AS object_name FROM databases WHERE deleted IS NULL
           UNION ALL SELECT DISTINCT 'WAREHOUSE', warehouse_name FROM warehouses),
t AS (SELECT DISTINCT upper(domain) AS object_type, upper(object_name) AS object_name, tag_name FROM object_tags
      WHERE tag_name IN ('COST_OWNER', 'DATA_OWNER', 'APP_OWNER', 'SERVICE_TIER', 'SENSITIVITY')),
cov AS (SELECT a.object_type, a.object_name, count(DISTINCT tag_name) AS tag_count, coalesce(string_agg(DISTINCT tag_name, ', ' ORDER BY tag_name), '') AS applied_tags,
               CASE WHEN count(DISTINCT tag_name) >= 3 THEN 'Well Tagged' WHEN count(DISTINCT tag_name) >= 1 THEN 'Partially Tagged' ELSE 'Untagged' END AS coverage_status
        FROM a LEFT JOIN t ON a.object_type = t.object_type AND upper(a.object_name) = t.object_name GROUP BY 1, 2)
"""


def _coverage(spark, sf):
    return ru.owner_tag_coverage(_v(spark, sf, "databases"), _v(spark, sf, "warehouses"), _v(spark, sf, "object_tags"))


@register("owner_tag_coverage", "databases", "warehouses", "object_tags", op="GOV-4", sql=_COVERED + "SELECT * FROM cov")
def _(spark, sf):
    return _coverage(spark, sf)


@register("unowned_warehouses", "warehouses", "object_tags", op="GOV-4", sql="""
SELECT DISTINCT warehouse_name AS object_name, 'WAREHOUSE' AS object_type FROM warehouses
WHERE upper(warehouse_name) NOT IN (SELECT upper(object_name) FROM object_tags WHERE tag_name = 'COST_OWNER' AND upper(domain) = 'WAREHOUSE')
""")
def _(spark, sf):
    return ru.unowned_warehouses(_v(spark, sf, "warehouses"), _v(spark, sf, "object_tags"))


@register("owner_tag_maturity", "databases", "warehouses", "object_tags", op="GOV-5", sql=_COVERED + """,
m AS (SELECT count(*) AS total_objects, count_if(coverage_status = 'Well Tagged') AS well_tagged, count_if(coverage_status = 'Partially Tagged') AS partially_tagged,
             count_if(coverage_status = 'Untagged') AS untagged, coalesce(round(count_if(coverage_status <> 'Untagged') * 100.0 / nullif(count(*), 0), 1), 0) AS coverage_pct FROM cov)
SELECT *, CASE WHEN total_objects = 0 THEN 'Not Assessed' WHEN coverage_pct >= 90 THEN 'Mature' WHEN coverage_pct >= 60 THEN 'Developing'
               WHEN coverage_pct >= 30 THEN 'Early' ELSE 'Ad Hoc' END AS maturity FROM m
""")
def _(spark, sf):
    return ru.owner_tag_maturity(_coverage(spark, sf))
