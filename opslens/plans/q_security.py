"""Registered security and governance queries (SEC-*, GOV-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from opslens.functions import scope
from opslens.operators import security as sec
from opslens.operators.asof import statement_programs
from opslens.plans.fixtures import ENV_SQL, OWNER_RULES, OWNER_RULES_CTE, environments
from opslens.plans.registry import register
from opslens.sources import testviews as tv
from opslens.sources.testviews import EVENTS_AS_OF

NOW = "TIMESTAMP '2024-01-31 00:00:00'"
D7 = "TIMESTAMP '2024-01-24 00:00:00'"
D30 = "TIMESTAMP '2024-01-01 00:00:00'"
ESC = " OR ".join(f"contains(upper(query_text), '{t}')" for t in sec.ESCALATION_TERMS)
SENS = " OR ".join(f"contains(upper(o.objectName), '{t}')" for t in sec.SENSITIVE_TERMS)
PRIV = ", ".join(f"'{r}'" for r in sec.PRIVILEGED_ROLES)


def _v(spark, sf, name):
    return tv.load(spark, sf, name)


_ESC = f"""
esc AS (SELECT query_id, query_type, user_name AS granted_by, role_name AS granting_role, start_time,
               substr(query_text, 1, 500) AS grant_statement, execution_status
        FROM query_history WHERE start_time >= {D30} AND query_type IN ('GRANT', 'REVOKE') AND execution_status = 'SUCCESS'
          AND ({ESC}))
"""
_FAILED = f"""
fl AS (SELECT event_id, user_name, client_ip, reported_client_type, error_code, event_timestamp,
              count(*) OVER (PARTITION BY user_name, CAST(event_timestamp AS DATE)) AS daily_failures
       FROM login_history WHERE event_timestamp >= {D7} AND is_success = 'NO'
      )
"""
_DORMANT = f"""
last AS (SELECT user_name, max(event_timestamp) AS last_login FROM login_history
         WHERE is_success = 'YES' AND event_timestamp >= TIMESTAMP '2023-08-04 00:00:00' GROUP BY 1),
dor AS (SELECT u.name AS user_name, u.created_on, u.disabled, l.last_login,
               date_diff('day', coalesce(l.last_login, u.created_on), {NOW}) AS days_inactive,
               CASE WHEN l.last_login IS NULL AND date_diff('day', u.created_on, {NOW}) > 90 THEN 'Never Logged In'
                    WHEN date_diff('day', l.last_login, {NOW}) > 90 THEN 'Dormant' WHEN u.disabled = 'true' THEN 'Disabled'
                    ELSE 'Active' END AS account_status
        FROM users u LEFT JOIN last l ON u.name = l.user_name
        WHERE (l.last_login IS NULL OR date_diff('day', l.last_login, {NOW}) > 90) AND u.disabled <> 'true')
"""


@register("privilege_escalations", "query_history", op="SEC-1", sql="WITH " + _ESC + "SELECT * FROM esc")
def _(spark, sf):
    return sec.privilege_escalations(_v(spark, sf, "query_history"), EVENTS_AS_OF, 30)


@register("failed_logins", "login_history", op="SEC-2", sql="WITH " + _FAILED + "SELECT * FROM fl")
def _(spark, sf):
    return sec.failed_logins(_v(spark, sf, "login_history"), EVENTS_AS_OF, 7)


@register("dormant_users", "users", "login_history", op="SEC-3", sql="WITH " + _DORMANT + "SELECT * FROM dor")
def _(spark, sf):
    return sec.dormant_users(_v(spark, sf, "users"), _v(spark, sf, "login_history"), EVENTS_AS_OF, 90)


@register("sensitive_access", "access_history", op="SEC-4", sql=f"""
WITH x AS (SELECT query_id, user_name, role_name, query_start_time, query_type,
                  unnest(from_json(direct_objects_accessed,
                    '[{{"objectName":"VARCHAR","objectDomain":"VARCHAR","columns":[{{"columnName":"VARCHAR"}}]}}]')) AS o
           FROM access_history WHERE query_start_time >= {D7})
SELECT query_id, user_name, role_name, query_start_time, o.objectName AS accessed_object, o.objectDomain AS object_type,
       CAST(len(o.columns) AS INTEGER) AS columns_accessed, query_type
FROM x WHERE {SENS}
""")
def _(spark, sf):
    return sec.sensitive_access(_v(spark, sf, "access_history"), EVENTS_AS_OF, 7)


@register("privileged_holders", "grants_to_users", op="SEC-5", sql=f"""
SELECT grantee_name AS user_name, role AS privileged_role, granted_by, created_on,
       date_diff('day', created_on, {NOW}) AS days_since_granted
FROM grants_to_users WHERE deleted_on IS NULL AND role IN ({PRIV})
""")
def _(spark, sf):
    return sec.privileged_holders(_v(spark, sf, "grants_to_users"), EVENTS_AS_OF)


@register("compliance_scorecard", "query_history", "login_history", "users", op="SEC-6",
          sql="WITH " + _ESC + "," + _FAILED + "," + _DORMANT + """,
j AS (SELECT (SELECT count(*) FROM esc) AS escalations, (SELECT count(*) FROM fl) AS failed_logins,
             (SELECT coalesce(max(daily_failures), 0) FROM fl) AS max_daily_failures, (SELECT count(*) FROM dor) AS dormant_users)
SELECT *, greatest(0, least(100, 80 - CASE WHEN escalations > 10 THEN 20 WHEN escalations > 0 THEN 5 ELSE 0 END
                                 - CASE WHEN max_daily_failures > 20 THEN 15 ELSE 0 END
                                 - CASE WHEN dormant_users > 20 THEN 10 WHEN dormant_users > 5 THEN 5 ELSE 0 END)) AS overall_score,
       greatest(0, 100 - escalations * 5) AS privilege_management_score,
       greatest(0, 100 - least(30, failed_logins)) AS login_security_score,
       greatest(0, 100 - dormant_users * 2) AS access_hygiene_score,
       concat_ws(',', CASE WHEN escalations > 10 THEN 'PRIVILEGE_ESCALATION' END, CASE WHEN max_daily_failures > 20 THEN 'BRUTE_FORCE' END,
                 CASE WHEN dormant_users > 20 THEN 'DORMANT_USERS' END) AS finding_codes
FROM j
""")
def _(spark, sf):
    q, lg, u = _v(spark, sf, "query_history"), _v(spark, sf, "login_history"), _v(spark, sf, "users")
    return sec.compliance_scorecard(sec.privilege_escalations(q, EVENTS_AS_OF, 30), sec.failed_logins(lg, EVENTS_AS_OF, 7),
                                    sec.dormant_users(u, lg, EVENTS_AS_OF, 90))


@register("security_kpis", "login_history", "grants_to_users", "users", "query_history", op="SEC-7", sql=f"""
SELECT (SELECT count_if(is_success = 'NO') FROM login_history WHERE event_timestamp >= {D7}) AS failed_logins,
       (SELECT count(DISTINCT CASE WHEN is_success = 'NO' THEN user_name END) FROM login_history WHERE event_timestamp >= {D7}) AS users_with_failures,
       (SELECT count_if(role IN ({PRIV})) FROM grants_to_users WHERE deleted_on IS NULL) AS privileged_grants,
       (SELECT count_if(disabled <> 'true' AND ext_authn_duo <> 'true') FROM users) AS users_without_mfa,
       (SELECT count(*) FROM query_history WHERE start_time >= {D7} AND query_type IN ('GRANT', 'REVOKE')) AS grant_statements
""")
def _(spark, sf):
    return sec.security_kpis(_v(spark, sf, "login_history"), _v(spark, sf, "grants_to_users"), _v(spark, sf, "users"),
                             _v(spark, sf, "query_history"), EVENTS_AS_OF, 7)


SECURITY_EXCEPTIONS_SQL = f"""
SELECT 'Failed Login' AS finding_type, CASE WHEN count(*) >= 25 OR count(DISTINCT client_ip) >= 5 THEN 'High' ELSE 'Medium' END AS severity,
       user_name AS entity, count(*) AS event_count, count(DISTINCT client_ip) AS distinct_sources, max(event_timestamp) AS last_seen,
       CAST(NULL AS VARCHAR) AS database_name
FROM login_history WHERE event_timestamp >= {D7} AND event_timestamp < {NOW} AND is_success = 'NO' GROUP BY user_name HAVING count(*) >= 3
UNION ALL
SELECT 'MFA Gap', 'High', name, 1, 0, created_on, NULL FROM users
WHERE NOT coalesce(TRY_CAST(disabled AS BOOLEAN), FALSE) AND NOT coalesce(TRY_CAST(ext_authn_duo AS BOOLEAN), FALSE)
UNION ALL
SELECT 'Recent Grant', CASE WHEN count(*) >= 10 THEN 'Medium' ELSE 'Low' END, grantee_name, count(*), count(DISTINCT role), max(created_on), NULL
FROM role_grants WHERE deleted_on IS NULL AND created_on >= {D7} AND created_on < {NOW} GROUP BY grantee_name HAVING count(*) >= 3
UNION ALL
SELECT 'Object Grant', CASE WHEN count(*) >= 10 OR count_if(coalesce(grant_option, 'false') = 'true') > 0 THEN 'High' ELSE 'Medium' END,
       coalesce(table_catalog || '.' || table_schema || '.' || name, table_catalog, name), count(*), count(DISTINCT grantee_name),
       max(created_on), table_catalog
FROM object_grants WHERE deleted_on IS NULL AND created_on >= {D7} AND created_on < {NOW} AND table_catalog IS NOT NULL
GROUP BY table_catalog, table_schema, name HAVING count(*) >= 3 OR count_if(coalesce(grant_option, 'false') = 'true') > 0
UNION ALL
SELECT 'Shared Database Exposure', 'Medium', database_name, 1, 0, created, database_name FROM databases
WHERE deleted IS NULL AND type IN ('IMPORTED DATABASE', 'SHARE')
"""


def exceptions(spark, sf):
    return sec.security_exceptions(_v(spark, sf, "login_history"), _v(spark, sf, "users"), _v(spark, sf, "role_grants"),
                                   _v(spark, sf, "object_grants"), _v(spark, sf, "databases"), EVENTS_AS_OF, 7)


@register("security_exceptions", "login_history", "users", "role_grants", "object_grants", "databases", op="SEC-8", sql=SECURITY_EXCEPTIONS_SQL)
def _(spark, sf):
    return exceptions(spark, sf)


ADMIN = """(upper(role) IN ('ACCOUNTADMIN', 'ORGADMIN', 'SECURITYADMIN', 'SYSADMIN', 'USERADMIN') OR upper(role) LIKE '%ADMIN%'
            OR upper(role) LIKE '%SECURITY%')"""


@register("privileged_grant_review", "grants_to_users", "object_grants", op="SEC-9", sql=f"""
WITH u AS (
SELECT 'Privileged Role Grant' AS finding_type,
       CASE WHEN upper(role) IN ('ACCOUNTADMIN', 'ORGADMIN', 'SECURITYADMIN') THEN 'Critical' ELSE 'High' END AS severity,
       grantee_name AS entity, role AS role_name, CAST(NULL AS VARCHAR) AS privilege, FALSE AS grant_option, CAST(NULL AS VARCHAR) AS object_name,
       CAST(NULL AS VARCHAR) AS database_name, granted_by, created_on, FALSE AS database_context
FROM grants_to_users WHERE deleted_on IS NULL AND {ADMIN}
UNION ALL
SELECT 'Privileged Object Grant',
       CASE WHEN upper(privilege) IN ('OWNERSHIP', 'APPLY MASKING POLICY', 'APPLY ROW ACCESS POLICY') OR coalesce(grant_option, 'false') = 'true'
            THEN 'High' ELSE 'Medium' END,
       grantee_name, NULL, privilege, coalesce(grant_option, 'false') = 'true', name, table_catalog, granted_by, created_on, TRUE
FROM object_grants WHERE deleted_on IS NULL AND created_on >= {D30} AND created_on < {NOW} AND table_catalog IS NOT NULL
  AND (upper(privilege) IN ('OWNERSHIP', 'MANAGE GRANTS', 'APPLY MASKING POLICY', 'APPLY ROW ACCESS POLICY', 'CREATE DATABASE ROLE',
                            'CREATE SCHEMA', 'CREATE TABLE', 'CREATE VIEW') OR coalesce(grant_option, 'false') = 'true'))
SELECT *, {ENV_SQL} AS environment, date_diff('day', created_on, {NOW}) AS grant_age_days FROM u
""")
def _(spark, sf):
    return sec.privileged_grant_review(_v(spark, sf, "grants_to_users"), _v(spark, sf, "object_grants"),
                                       scope.environment_label(environments()), EVENTS_AS_OF, 30)


@register("access_hygiene", "users", "login_history", "grants_to_users", op="SEC-10", sql=f"""
WITH l AS (SELECT user_name, count_if(is_success = 'NO') AS f, count(DISTINCT CASE WHEN is_success = 'NO' THEN client_ip END) AS ips,
                  max(CASE WHEN is_success = 'YES' THEN event_timestamp END) AS last
           FROM login_history WHERE event_timestamp >= {D30} AND event_timestamp < {NOW} GROUP BY 1),
g AS (SELECT grantee_name, count(DISTINCT role) AS n, string_agg(DISTINCT role, ', ' ORDER BY role) AS names FROM grants_to_users
      WHERE deleted_on IS NULL AND {ADMIN} GROUP BY 1),
p AS (SELECT u.name AS user_name, coalesce(disabled, 'false') AS disabled, coalesce(has_password, 'false') AS has_password,
             coalesce(ext_authn_duo, 'unknown') AS mfa_signal, coalesce(l.last, u.created_on) AS last_seen, coalesce(l.f, 0) AS failed_logins,
             coalesce(l.ips, 0) AS failed_ips, coalesce(g.n, 0) AS admin_role_count, coalesce(g.names, '') AS admin_roles
      FROM users u LEFT JOIN l ON upper(u.name) = upper(l.user_name) LEFT JOIN g ON upper(u.name) = upper(g.grantee_name)),
d AS (SELECT *, date_diff('day', last_seen, {NOW}) AS days_since_seen, mfa_signal <> 'unknown' AND lower(mfa_signal) <> 'true' AS gap FROM p)
SELECT * EXCLUDE (gap),
       CASE WHEN failed_logins >= 25 OR failed_ips >= 5 THEN 'High'
            WHEN admin_role_count > 0 AND (mfa_signal = 'unknown' OR lower(mfa_signal) <> 'true') THEN 'High'
            WHEN days_since_seen >= 90 THEN 'Medium' WHEN failed_logins > 0 OR admin_role_count > 0 OR gap THEN 'Medium' ELSE 'Low' END AS severity,
       concat_ws('; ', CASE WHEN disabled = 'true' THEN 'disabled user retained in account' END,
                 CASE WHEN failed_logins > 0 THEN failed_logins || ' failed login(s)' END,
                 CASE WHEN failed_ips >= 5 THEN failed_ips || ' failed login source IP(s)' END,
                 CASE WHEN admin_role_count > 0 THEN admin_role_count || ' privileged role grant(s)' END,
                 CASE WHEN gap THEN 'MFA signal missing' END, CASE WHEN days_since_seen >= 90 THEN 'dormant >= 90 days' END) AS posture_findings
FROM d WHERE failed_logins > 0 OR admin_role_count > 0 OR gap OR days_since_seen >= 90
""")
def _(spark, sf):
    return sec.access_hygiene(_v(spark, sf, "users"), _v(spark, sf, "login_history"), _v(spark, sf, "grants_to_users"),
                              EVENTS_AS_OF, 30)


@register("mfa_coverage", "users", op="SEC-11", sql="""
SELECT name AS user_name, ext_authn_duo = 'true' AS mfa_enabled, has_password = 'true' AS has_password,
       CASE WHEN ext_authn_duo = 'true' THEN 'Covered' WHEN has_password = 'true' THEN 'Password only' ELSE 'Key or SSO' END AS coverage
FROM users WHERE disabled <> 'true'
""")
def _(spark, sf):
    return sec.mfa_coverage(_v(spark, sf, "users"))


@register("login_audit", "login_history", op="SEC-12", sql=f"""
SELECT CAST(event_timestamp AS DATE) AS login_date, user_name, client_ip, reported_client_type, reported_client_version,
       count_if(is_success = 'YES') AS success_count, count_if(is_success = 'NO') AS failure_count
FROM login_history WHERE event_timestamp >= {D7} GROUP BY 1, 2, 3, 4, 5
""")
def _(spark, sf):
    return sec.login_audit(_v(spark, sf, "login_history"), EVENTS_AS_OF, 7)


def _daily(spark, sf):
    return sec.login_audit(_v(spark, sf, "login_history"), EVENTS_AS_OF, 30)


_LOGINS = f"lg AS (SELECT * FROM login_history WHERE event_timestamp >= {D30} AND event_timestamp < {NOW})"


@register("login_audit_totals", "login_history", op="SEC-12", sql=f"""
WITH {_LOGINS}
SELECT s.is_success, count(lg.is_success) AS event_count, count(DISTINCT user_name) AS distinct_users, count(DISTINCT client_ip) AS distinct_ips
FROM (VALUES ('YES'), ('NO')) s(is_success) LEFT JOIN lg ON lg.is_success = s.is_success GROUP BY 1
""")
def _(spark, sf):
    return sec.login_totals(_daily(spark, sf))


@register("login_audit_trend", "login_history", op="SEC-12", sql=f"""
WITH {_LOGINS}
SELECT CAST(event_timestamp AS DATE) AS day, 'YES' AS is_success, count_if(is_success = 'YES') AS event_count FROM lg GROUP BY 1
UNION ALL SELECT CAST(event_timestamp AS DATE), 'NO', count_if(is_success = 'NO') FROM lg GROUP BY 1
""")
def _(spark, sf):
    return sec.login_trend(_daily(spark, sf))


@register("login_audit_failures", "login_history", op="SEC-12", sql=f"""
WITH {_LOGINS}
SELECT user_name, client_ip, reported_client_type, count(*) AS attempt_count, CAST(max(CAST(event_timestamp AS DATE)) AS TIMESTAMP) AS last_attempt
FROM lg WHERE is_success = 'NO' GROUP BY 1, 2, 3
ORDER BY attempt_count DESC, last_attempt DESC, user_name, client_ip, reported_client_type LIMIT 50
""")
def _(spark, sf):
    return sec.login_failures(_daily(spark, sf), 50)


@register("login_audit_addresses", "login_history", op="SEC-12", sql=f"""
WITH {_LOGINS}
SELECT client_ip, count(*) AS login_events, count(DISTINCT user_name) AS users, count_if(is_success = 'YES') AS success_events,
       count_if(is_success = 'NO') AS failed_events, CAST(max(CAST(event_timestamp AS DATE)) AS TIMESTAMP) AS last_seen
FROM lg GROUP BY 1 ORDER BY login_events DESC, client_ip LIMIT 50
""")
def _(spark, sf):
    return sec.login_addresses(_daily(spark, sf), 50)


@register("login_audit_clients", "login_history", op="SEC-12", sql=f"""
WITH {_LOGINS}
SELECT coalesce(reported_client_type, 'UNKNOWN') AS reported_client_type, coalesce(reported_client_version, 'UNKNOWN') AS reported_client_version,
       count(*) AS login_events, count(DISTINCT user_name) AS users, count_if(is_success = 'NO') AS failed_events
FROM lg GROUP BY 1, 2 ORDER BY login_events DESC, reported_client_type, reported_client_version LIMIT 50
""")
def _(spark, sf):
    return sec.login_clients(_daily(spark, sf), 50)


@register("connected_programs", "sessions", "login_history", op="SEC-13", sql=f"""
WITH s AS (SELECT user_name, CAST(created_on AS DATE) AS d, client_application_id, statement_count FROM sessions WHERE created_on >= {D7}),
l AS (SELECT user_name, CAST(event_timestamp AS DATE) AS d, min(reported_client_type) AS login_client FROM login_history
      WHERE event_timestamp >= {D7} AND is_success = 'YES' GROUP BY 1, 2),
j AS (SELECT coalesce(s.user_name, l.user_name) AS user_name, client_application_id, login_client, statement_count
      FROM s FULL OUTER JOIN l ON s.user_name = l.user_name AND s.d = l.d)
SELECT coalesce(client_application_id, login_client, 'UNKNOWN') AS client,
       CASE WHEN client_application_id IS NOT NULL THEN 'session' WHEN login_client IS NOT NULL THEN 'login' ELSE 'unknown' END AS identity_source,
       count(DISTINCT user_name) AS users, count(*) AS user_days, CAST(coalesce(sum(statement_count), 0) AS BIGINT) AS statements
FROM j GROUP BY 1, 2
""")
def _(spark, sf):
    return sec.connected_programs(_v(spark, sf, "sessions"), _v(spark, sf, "login_history"), EVENTS_AS_OF, 7)


@register("grant_blast_radius", "grants_to_users", "grants_to_roles", op="SEC-14", sql="""
WITH RECURSIVE held AS (SELECT * FROM grants_to_users WHERE deleted_on IS NULL),
roles AS (SELECT role FROM held UNION SELECT name FROM grants_to_roles UNION SELECT grantee_name FROM grants_to_roles),
reach(role, node) AS (SELECT role, role FROM roles UNION SELECT r.role, g.grantee_name FROM reach r JOIN grants_to_roles g ON g.name = r.node),
d AS (SELECT role, count(DISTINCT grantee_name) AS users, min(created_on) AS first_granted FROM held GROUP BY 1),
i AS (SELECT r.role, count(DISTINCT h.grantee_name) AS impacted_users FROM reach r JOIN held h ON h.role = r.node GROUP BY 1)
SELECT r.role, coalesce(d.users, 0) AS users, d.first_granted, (SELECT count(*) FROM reach x WHERE x.role = r.role AND x.node <> r.role) AS inheriting_roles,
       coalesce(i.impacted_users, 0) AS impacted_users
FROM roles r LEFT JOIN d ON d.role = r.role LEFT JOIN i ON i.role = r.role
""")
def _(spark, sf):
    return sec.grant_blast_radius(_v(spark, sf, "grants_to_users"), _v(spark, sf, "grants_to_roles"))


@register("role_utilisation", "grants_to_users", "query_history", op="SEC-15", sql=f"""
WITH used AS (SELECT role_name AS role, count(*) AS statements, max(start_time) AS last_used FROM query_history
              WHERE start_time >= {D30} GROUP BY 1),
roles AS (SELECT role, count(DISTINCT grantee_name) AS grantees FROM grants_to_users WHERE deleted_on IS NULL GROUP BY 1)
SELECT roles.role, grantees, coalesce(statements, 0) AS statements, last_used,
       CASE WHEN statements IS NULL THEN 'Dormant' ELSE 'Active' END AS role_state
FROM roles LEFT JOIN used ON roles.role = used.role
""")
def _(spark, sf):
    return sec.role_utilisation(_v(spark, sf, "grants_to_users"), _v(spark, sf, "query_history"), EVENTS_AS_OF, 30)


@register("long_sessions", "sessions", op="SEC-16", sql=f"""
SELECT session_id, user_name, client_application_id, created_on, last_access_time,
       round(date_diff('microsecond', created_on, last_access_time) / 3.6e9, 2) AS session_hours
FROM sessions WHERE created_on >= {D7} AND date_diff('microsecond', created_on, last_access_time) / 3.6e9 > 8
""")
def _(spark, sf):
    return sec.long_sessions(_v(spark, sf, "sessions"), EVENTS_AS_OF, 8, 7)


@register("classification_coverage", "columns", "tag_references", op="GOV-1", sql="""
WITH c AS (SELECT DISTINCT table_catalog, table_schema, table_name, column_name, column_name AS cc FROM tag_references
           WHERE domain = 'COLUMN' AND tag_name IN ('SEMANTIC_CATEGORY', 'PRIVACY_CATEGORY', 'PII', 'SENSITIVITY')),
g AS (SELECT a.table_catalog AS database_name, count(DISTINCT a.column_name) AS total_columns, count(DISTINCT c.cc) AS classified_columns
      FROM columns a LEFT JOIN c ON a.table_catalog = c.table_catalog AND a.table_schema = c.table_schema
       AND a.table_name = c.table_name AND a.column_name = c.column_name GROUP BY 1)
SELECT *, round(classified_columns * 100.0 / nullif(total_columns, 0), 1) AS classification_pct FROM g WHERE total_columns > 5
""")
def _(spark, sf):
    return sec.classification_coverage(_v(spark, sf, "columns"), _v(spark, sf, "tag_references"), 5)


@register("access_history_availability", "access_history", op="GOV-2", sql=f"""
SELECT CAST(query_start_time AS DATE) AS access_date, count(*) AS access_rows, count(DISTINCT user_name) AS users
FROM access_history WHERE query_start_time >= {D7} GROUP BY 1
""")
def _(spark, sf):
    return sec.access_history_availability(_v(spark, sf, "access_history"), EVENTS_AS_OF, 7)


@register("tag_coverage", "columns", "tag_references", op="GOV-4", sql="""
WITH t AS (SELECT DISTINCT table_catalog, table_schema, table_name FROM columns),
tg AS (SELECT DISTINCT table_catalog, table_schema, table_name FROM tag_references),
ut AS (SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM tg WHERE tg.table_catalog = t.table_catalog
                                         AND tg.table_schema = t.table_schema AND tg.table_name = t.table_name)),
a AS (SELECT table_catalog, count(*) AS tables FROM t GROUP BY 1),
b AS (SELECT table_catalog, count(*) AS untagged_tables FROM ut GROUP BY 1)
SELECT a.table_catalog AS database_name, tables, coalesce(untagged_tables, 0) AS untagged_tables,
       round((tables - coalesce(untagged_tables, 0)) * 100.0 / tables, 1) AS tag_coverage_pct,
       CASE WHEN (tables - coalesce(untagged_tables, 0)) * 100.0 / tables >= 80 THEN 'Managed'
            WHEN (tables - coalesce(untagged_tables, 0)) * 100.0 / tables >= 40 THEN 'Developing' ELSE 'Initial' END AS maturity
FROM a LEFT JOIN b ON a.table_catalog = b.table_catalog
""")
def _(spark, sf):
    return sec.tag_coverage(_v(spark, sf, "columns"), _v(spark, sf, "tag_references"))


def _query_entities(spark, sf):
    from pyspark.sql import functions as F
    q = _v(spark, sf, "query_history")
    return (q.select(F.col("query_id").alias("entity_id"), F.lit("WAREHOUSE").alias("entity_type"),
                     "warehouse_name", "database_name", "user_name"))


# written from the directory's rules: priority + 85 or 55 for the type + 100, 40, 20 or 1 for the pattern
OWNER_MATCH_SQL = OWNER_RULES_CTE + """,
e AS (SELECT query_id AS entity_id, 'WAREHOUSE' AS etype, warehouse_name, database_name, user_name FROM query_history),
cand AS (SELECT DISTINCT entity_id, etype, upper(trim(v)) AS value
         FROM (SELECT entity_id, etype, unnest([warehouse_name, database_name, user_name]) AS v FROM e) WHERE trim(coalesce(v, '')) <> ''),
s AS (SELECT c.entity_id, c.value, upper(r.entity_pattern) AS pat, r.owner_name, coalesce(r.match_priority, 0) AS p,
             CASE WHEN upper(r.entity_type) = 'WAREHOUSE' THEN 85 WHEN upper(r.entity_type) IN ('ALERT', 'GLOBAL') THEN 55 END AS ts,
             CASE WHEN upper(r.entity_pattern) IN ('*', '%') THEN 1 WHEN upper(r.entity_pattern) = c.value THEN 100
                  WHEN c.value LIKE replace(replace(upper(r.entity_pattern), '_', '\\_'), '*', '%') ESCAPE '\\' THEN 40
                  WHEN replace(upper(r.entity_pattern), '*', '') <> '' AND contains(c.value, replace(upper(r.entity_pattern), '*', '')) THEN 20
                  ELSE 0 END AS fit
      FROM cand c CROSS JOIN owner_rules r WHERE coalesce(r.is_active, TRUE)),
b AS (SELECT entity_id, max({'score': p + ts + fit, 'p': p, 'pat': pat, 'owner_name': owner_name, 'mv': value}) AS b
      FROM s WHERE fit > 0 AND ts IS NOT NULL GROUP BY 1),
own AS (SELECT e.entity_id, coalesce(b.b.owner_name, 'DBA') AS owner_name, b.b.score AS match_score, b.b.pat AS matched_pattern,
               b.b.mv AS matched_value, CASE WHEN b.b IS NULL THEN 'Unrouted' ELSE 'Routed' END AS route_state
        FROM (SELECT DISTINCT entity_id FROM e) e LEFT JOIN b ON e.entity_id = b.entity_id)
"""


@register("owner_resolution", "query_history", op="GOV-7", sql="WITH " + OWNER_MATCH_SQL + "SELECT * FROM own")
def _(spark, sf):
    from opslens.operators.chargeback import rules_frame
    return sec.owner_resolution(_query_entities(spark, sf), rules_frame(spark, OWNER_RULES),
                                ["warehouse_name", "database_name", "user_name"])


@register("ai_usage_by_user", "ai_usage", op="GOV-9", sql="""
WITH g AS (SELECT user_name, interface, count(*) AS requests, count(DISTINCT CAST(start_time AS DATE)) AS active_days,
                  CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(credits_used), 6) AS credits
           FROM ai_usage WHERE start_time >= TIMESTAMP '2024-01-01 00:00:00' GROUP BY 1, 2)
SELECT *, round(credits / nullif(requests, 0), 8) AS credits_per_request,
       CASE WHEN credits > 0.05 THEN 'Over budget' WHEN credits > 0.04 THEN 'Near budget' ELSE 'Within' END AS guardrail
FROM g
""")
def _(spark, sf):
    return sec.ai_usage_by_user(_v(spark, sf, "ai_usage"), EVENTS_AS_OF, 30, 0.05)


@register("statement_programs", "query_history", "sessions", "login_history", op="JOI-15", sql="""
WITH q AS (SELECT query_id, user_name, start_time, query_tag, total_elapsed_time FROM query_history
           WHERE start_time >= TIMESTAMP '2024-01-24 00:00:00' AND start_time < TIMESTAMP '2024-01-31 00:00:00'),
s AS (SELECT user_name, created_on, max(client_application_id) AS c FROM sessions WHERE statement_count > 1 AND client_application_id IS NOT NULL GROUP BY 1, 2),
l AS (SELECT user_name, event_timestamp, max(reported_client_type) AS c FROM login_history WHERE is_success = 'YES' AND reported_client_type IS NOT NULL GROUP BY 1, 2),
a AS (SELECT q.*, s.c AS sc FROM q ASOF LEFT JOIN s ON q.user_name = s.user_name AND q.start_time >= s.created_on),
b AS (SELECT a.*, l.c AS lc FROM a ASOF LEFT JOIN l ON a.user_name = l.user_name AND a.start_time >= l.event_timestamp)
SELECT coalesce(sc, lc, nullif(query_tag, ''), 'UNTAGGED') AS program,
       CASE WHEN sc IS NOT NULL THEN 'session' WHEN lc IS NOT NULL THEN 'login' WHEN nullif(query_tag, '') IS NOT NULL THEN 'query tag' ELSE 'unknown' END AS identity_source,
       count(*) AS statements, count(DISTINCT user_name) AS users, round(sum(CAST(coalesce(total_elapsed_time, 0) AS DOUBLE)) / 1000.0, 3) AS elapsed_sec
FROM b GROUP BY 1, 2
""")
def _(spark, sf):
    """Sessions of one statement report no client, so that logins and tags count."""
    s = _v(spark, sf, "sessions").withColumn("client_application_id", F.when(F.col("statement_count") > 1, F.col("client_application_id")))
    return statement_programs(_v(spark, sf, "query_history"), s, _v(spark, sf, "login_history"), EVENTS_AS_OF, 7)
