"""Registered change-control queries (CHG-*) and scope labels (SCA-21/22, FIL-6..8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from opslens.functions import scope
from opslens.operators import change as chg
from opslens.plans.fixtures import ENV_SQL, TENANT_SQL, environments, tenants
from opslens.plans.registry import register
from opslens.sources import testviews as tv
from opslens.sources.testviews import EVENTS_AS_OF

_CH = f"""
ch AS (SELECT query_id, user_name, role_name, warehouse_name, database_name, schema_name, start_time, query_tag, query_text,
              CASE WHEN upper(query_text) LIKE 'DROP%' THEN 'DESTRUCTIVE'
                   WHEN upper(query_text) LIKE '%MASKING POLICY%' OR upper(query_text) LIKE '%ROW ACCESS POLICY%' OR upper(query_text) LIKE '%TAG%' THEN 'POLICY'
                   WHEN upper(query_text) LIKE '%OWNERSHIP%' THEN 'OWNER'
                   WHEN upper(query_text) LIKE 'GRANT%' OR upper(query_text) LIKE 'REVOKE%' OR upper(query_text) LIKE 'CREATE%ROLE%'
                     OR upper(query_text) LIKE 'ALTER%ROLE%' OR upper(query_text) LIKE 'DROP%ROLE%' THEN 'ACCESS'
                   WHEN upper(query_text) LIKE 'CREATE%' OR upper(query_text) LIKE 'ALTER%' THEN 'OBJECT' ELSE 'OTHER' END AS change_family,
              upper(regexp_extract(query_text, '{chg.FQN_RE}', 1)) AS object_fqn,
              upper(regexp_extract(coalesce(query_tag, ''), '{chg.TICKET_RE}', 1)) AS ticket_key
       FROM query_history WHERE start_time >= TIMESTAMP '2024-01-24 00:00:00'
         AND (upper(query_text) LIKE 'CREATE%' OR upper(query_text) LIKE 'ALTER%' OR upper(query_text) LIKE 'DROP%'
              OR upper(query_text) LIKE 'GRANT%' OR upper(query_text) LIKE 'REVOKE%' OR upper(query_text) LIKE '%OWNERSHIP%'
              OR upper(query_text) LIKE '%MASKING POLICY%' OR upper(query_text) LIKE '%ROW ACCESS POLICY%' OR upper(query_text) LIKE '%TAG%'))
"""


def _ch(spark, sf):
    return chg.changes(tv.load(spark, sf, "query_history"), EVENTS_AS_OF, 7)


def _env():
    return scope.environment_label(environments())


@register("change_summary", "query_history", op="CHG-1", sql="WITH " + _CH + """
SELECT count_if(change_family IN ('OBJECT', 'DESTRUCTIVE')) AS object_changes, count_if(change_family IN ('ACCESS', 'OWNER')) AS access_changes,
       count_if(change_family = 'OWNER') AS owner_changes, count_if(change_family = 'POLICY') AS policy_changes,
       count_if(change_family = 'DESTRUCTIVE') AS destructive_changes, count_if(change_family <> 'OTHER' AND ticket_key = '') AS manual_drift,
       count(DISTINCT user_name) AS actors, count(DISTINCT database_name) AS affected_databases,
       count_if(database_name IS NULL) AS account_scope_changes
FROM ch
""")
def _(spark, sf):
    return chg.change_summary(_ch(spark, sf))


@register("change_exceptions", "query_history", op="CHG-2", sql="WITH " + _CH + f"""
SELECT query_id, start_time, user_name, role_name, database_name, change_family, object_fqn, ticket_key, {ENV_SQL} AS environment,
       CASE WHEN change_family IN ('DESTRUCTIVE', 'POLICY', 'OWNER') THEN 'High' WHEN change_family = 'ACCESS' THEN 'Medium' ELSE 'Low' END AS severity,
       coalesce(database_name || '.' || schema_name, database_name, query_id) AS entity,
       CASE WHEN database_name IS NULL THEN 'Account/Role Context' ELSE 'Database Context' END AS scope_confidence
FROM ch WHERE change_family <> 'OTHER'
""")
def _(spark, sf):
    return chg.change_exceptions(_ch(spark, sf), _env())


def _ctype_sql():
    parts = []
    for k in ["TABLE", "VIEW", "PROCEDURE", "TASK"]:
        for verb in ["CREATE", "ALTER", "DROP"]:
            parts.append(f"WHEN upper(query_text) LIKE '{verb}%{k}%' THEN '{verb} {k}'")
    return "CASE " + " ".join(parts) + " ELSE query_type END"


def _ccond_sql():
    return " OR ".join(f"upper(query_text) LIKE '{verb}%{k}%'" for k in ["TABLE", "VIEW", "PROCEDURE", "TASK"]
                       for verb in ["CREATE", "ALTER", "DROP"])


@register("object_change_list", "query_history", op="CHG-3", sql=f"""
SELECT query_id, user_name, role_name, warehouse_name, database_name, schema_name, start_time, {_ctype_sql()} AS change_type,
       substr(query_text, 1, 1500) AS query_text
FROM query_history WHERE start_time >= TIMESTAMP '2024-01-24 00:00:00' AND ({_ccond_sql()})

""")
def _(spark, sf):
    return chg.object_change_list(tv.load(spark, sf, "query_history"), EVENTS_AS_OF, 7)


RECONCILED_SQL = _CH + """,
c AS (SELECT DISTINCT upper(object_fqn) AS fqn, split_part(upper(object_fqn), '.', 1) AS db, split_part(upper(object_fqn), '.', 2) AS sch,
             upper(commit_id) AS sha, upper(change_ticket_id) AS own FROM source_commits),
t AS (SELECT DISTINCT upper(ticket_key) AS ticket_key FROM change_tickets),
j0 AS (SELECT ch.*, CASE WHEN ch.ticket_key <> '' AND ch.ticket_key IN (SELECT own FROM c) THEN 'ticket'
                         WHEN EXISTS (SELECT 1 FROM c WHERE sha <> '' AND contains(upper(coalesce(ch.query_tag, '')), sha)) THEN 'commit'
                         WHEN EXISTS (SELECT 1 FROM c WHERE fqn <> '' AND contains(upper(coalesce(ch.query_text, '')), fqn)) THEN 'object'
                         WHEN EXISTS (SELECT 1 FROM c WHERE db = upper(coalesce(ch.database_name, '')) AND (sch = '' OR sch = upper(coalesce(ch.schema_name, '')))) THEN 'schema'
                         END AS commit_match, ch.ticket_key IN (SELECT ticket_key FROM t) AS ht FROM ch),
j AS (SELECT *, commit_match IS NOT NULL AS hc FROM j0),
rec AS (SELECT query_id, start_time, user_name, change_family, object_fqn, ticket_key, commit_match, hc AS has_commit, ht AS has_ticket,
       CASE WHEN hc AND ht THEN 'Reconciled' WHEN hc THEN 'Commit without ticket' WHEN ht THEN 'Ticket without commit'
            ELSE 'Unmatched drift' END AS reconciliation_state
FROM j)
"""


@register("change_reconciliation", "query_history", "source_commits", "change_tickets", op="CHG-4", sql="WITH " + RECONCILED_SQL + "SELECT * FROM rec")
def _(spark, sf):
    return chg.reconcile_changes(_ch(spark, sf), tv.load(spark, sf, "source_commits"), tv.load(spark, sf, "change_tickets"))


@register("change_timeline", "query_history", "source_commits", "change_tickets", op="CHG-7", sql="WITH " + _CH + """
SELECT CAST(start_time AS DATE) AS event_date, count(*) AS events, 'observed' AS source FROM ch GROUP BY 1
UNION ALL SELECT CAST(committed_at AS DATE), count(*), 'source_control' FROM source_commits GROUP BY 1
UNION ALL SELECT CAST(opened_at AS DATE), count(*), 'tickets' FROM change_tickets GROUP BY 1
""")
def _(spark, sf):
    return chg.change_timeline(_ch(spark, sf), tv.load(spark, sf, "source_commits"), tv.load(spark, sf, "change_tickets"))


_USAGE = """
x AS (SELECT query_id, user_name, role_name,
             unnest(from_json(direct_objects_accessed, '[{"objectName":"VARCHAR","objectDomain":"VARCHAR","columns":[{"columnName":"VARCHAR"}]}]')) AS o
      FROM access_history WHERE query_start_time >= TIMESTAMP '2024-01-01 00:00:00'),
us AS (SELECT upper(o.objectName) AS object_fqn, count(DISTINCT query_id) AS query_count, count(DISTINCT user_name) AS unique_users,
              count(DISTINCT role_name) AS unique_roles FROM x GROUP BY 1)
"""


@register("object_usage", "access_history", op="CHG-9", sql="WITH " + _USAGE + "SELECT * FROM us")
def _(spark, sf):
    return chg.object_usage(tv.load(spark, sf, "access_history"), EVENTS_AS_OF, 30)


@register("change_impact_score", "access_history", "object_dependencies", op="CHG-10", sql="WITH " + _USAGE + """,
u2 AS (SELECT *, CASE WHEN starts_with(object_fqn, 'DB_0.') THEN 'Tier 0' WHEN starts_with(object_fqn, 'DB_1.') THEN 'Tier 1'
                      ELSE 'Tier 2' END AS tier, split_part(object_fqn, '.', 3) AS object_short FROM us),
dep AS (SELECT upper(referenced_object_name) AS object_short, count(*) AS dependent_objects FROM object_dependencies GROUP BY 1),
j AS (SELECT u2.*, coalesce(dep.dependent_objects, 0) AS d FROM u2 LEFT JOIN dep ON u2.object_short = dep.object_short),
b AS (SELECT *, CASE WHEN query_count > 1000 THEN 35 WHEN query_count > 100 THEN 20 WHEN query_count > 10 THEN 10 ELSE 0 END
                + CASE WHEN unique_users > 20 THEN 20 WHEN unique_users > 5 THEN 10 ELSE 0 END
                + CASE WHEN d > 10 THEN 25 WHEN d > 3 THEN 15 WHEN d > 0 THEN 5 ELSE 0 END AS base FROM j),
s AS (SELECT *, CAST(CASE WHEN tier = 'Tier 0' THEN least(100, floor(base * 1.5)) WHEN tier = 'Tier 1' THEN least(100, floor(base * 1.2))
                          ELSE base END AS INTEGER) AS score FROM b)
SELECT object_fqn, query_count, unique_users, unique_roles, d AS dependent_objects, tier AS database_tier, score AS impact_score,
       CASE WHEN score >= 75 THEN 'Critical' WHEN score >= 50 THEN 'High' WHEN score >= 25 THEN 'Medium' ELSE 'Low' END AS severity
FROM s
""")
def _(spark, sf):
    u = chg.object_usage(tv.load(spark, sf, "access_history"), EVENTS_AS_OF, 30)
    u = (u.withColumn("_tier", F.when(F.col("object_fqn").startswith("DB_0."), "Tier 0")
                      .when(F.col("object_fqn").startswith("DB_1."), "Tier 1").otherwise("Tier 2"))
         .withColumn("object_short", F.split("object_fqn", r"\.").getItem(2)))
    dep = (tv.load(spark, sf, "object_dependencies").groupBy(F.upper("referenced_object_name").alias("object_short"))
           .agg(F.count(F.lit(1)).alias("dependent_objects")))
    return chg.impact_score(u, dep, F.col("_tier"), key="object_short").drop("object_short")


@register("change_control_readiness", "query_history", op="CHG-11", sql="WITH " + _CH + f""",
g AS (SELECT {ENV_SQL} AS environment, count(*) AS changes, count_if(ticket_key <> '') AS ticketed,
             count_if(change_family = 'DESTRUCTIVE') AS destructive, count(DISTINCT user_name) AS actors FROM ch GROUP BY 1)
SELECT *, round(ticketed * 100.0 / changes, 1) AS ticketed_pct,
       CASE WHEN round(ticketed * 100.0 / changes, 1) >= 90 THEN 'Controlled' WHEN round(ticketed * 100.0 / changes, 1) >= 50 THEN 'Partial'
            ELSE 'Uncontrolled' END AS readiness
FROM g
""")
def _(spark, sf):
    return chg.control_readiness(_ch(spark, sf), _env())


@register("tenant_environment_labels", "query_history", op="SCA-21", sql=f"""
SELECT {TENANT_SQL} AS company, {ENV_SQL} AS environment, count(*) AS queries, count(DISTINCT user_name) AS users
FROM query_history GROUP BY 1, 2
""")
def _(spark, sf):
    q = tv.load(spark, sf, "query_history")
    return (q.groupBy(scope.tenant_label(tenants()).alias("company"), _env().alias("environment"))
            .agg(F.count(F.lit(1)).alias("queries"), F.countDistinct("user_name").alias("users")))


@register("tenant_scope_filter", "query_history", op="FIL-6", sql="""
SELECT warehouse_name, database_name, count(*) AS queries FROM query_history
WHERE ((upper(warehouse_name) LIKE 'WH_1%' OR upper(warehouse_name) = 'WH_2') AND NOT (upper(warehouse_name) = 'WH_12'))
  AND (upper(database_name) IN ('DB_0', 'DB_1') OR database_name IS NULL OR trim(database_name) = '')
GROUP BY 1, 2
""")
def _(spark, sf):
    q = tv.load(spark, sf, "query_history")
    cond = (scope.tenant_scope(["WH_1%", "WH_2"], ["WH_12"], "warehouse_name")
            & scope.environment_scope(environments(), "PROD", keep_no_database=True))
    return q.filter(cond).groupBy("warehouse_name", "database_name").agg(F.count(F.lit(1)).alias("queries"))


@register("signal_scope_filter", "query_history", op="FIL-8", sql="""
SELECT warehouse_name, role_name, count(*) AS queries FROM query_history
WHERE ((warehouse_name IS NOT NULL AND trim(warehouse_name) <> '') OR (role_name IS NOT NULL AND trim(role_name) <> ''))
  AND (NOT (warehouse_name IS NOT NULL AND trim(warehouse_name) <> '') OR upper(warehouse_name) IN ('WH_1', 'WH_3', 'WH_5'))
  AND (NOT (role_name IS NOT NULL AND trim(role_name) <> '') OR upper(role_name) LIKE 'ROLE_%')
GROUP BY 1, 2
""")
def _(spark, sf):
    q = tv.load(spark, sf, "query_history")
    cond = scope.signal_scope({"warehouse_name": ["WH_1", "WH_3", "WH_5"], "role_name": ["ROLE_%"]})
    return q.filter(cond).groupBy("warehouse_name", "role_name").agg(F.count(F.lit(1)).alias("queries"))
