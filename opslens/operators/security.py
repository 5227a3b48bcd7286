"""Security and governance (SEC-*, GOV-*)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.functions.exprs import page, rounded, safe_div, severity_rank, sorted_distinct_list
from opslens.functions.timeutil import boundaries, lookback, ts_lit
from opslens.operators.graph import _walk
from opslens.sources.schemas import conform

# Privileged role names and escalation keywords.
PRIVILEGED_ROLES = ["ACCOUNTADMIN", "SECURITYADMIN", "SYSADMIN", "ORGADMIN"]
ESCALATION_TERMS = ["ACCOUNTADMIN", "SECURITYADMIN", "SYSADMIN", "ALL PRIVILEGES", "OWNERSHIP"]
# Account administration roles, those whose grants are critical, and object privileges to review.
ADMIN_ROLES = ["ACCOUNTADMIN", "ORGADMIN", "SECURITYADMIN", "SYSADMIN", "USERADMIN"]
CRITICAL_ROLES = ["ACCOUNTADMIN", "ORGADMIN", "SECURITYADMIN"]
HIGH_PRIVILEGES = ["OWNERSHIP", "APPLY MASKING POLICY", "APPLY ROW ACCESS POLICY"]
REVIEWED_PRIVILEGES = ["OWNERSHIP", "MANAGE GRANTS", "APPLY MASKING POLICY", "APPLY ROW ACCESS POLICY", "CREATE DATABASE ROLE",
                       "CREATE SCHEMA", "CREATE TABLE", "CREATE VIEW"]
SHARED_DATABASES = ["IMPORTED DATABASE", "SHARE"]
# Object-name markers of sensitive data.
SENSITIVE_TERMS = ["PII", "SENSITIVE", "PHI", "CUSTOMER", "SSN", "CREDIT_CARD"]

ACCESS_SCHEMA = "array<struct<objectName:string,objectDomain:string,columns:array<struct<columnName:string>>>>"


def _ilike_any(c: Column, terms) -> Column:
    """Case-insensitive "contains any of": one regex, one reference to ``c``."""
    return c.rlike("(?i)" + "|".join(r"\Q" + t + r"\E" for t in terms))


def privilege_escalations(queries: DataFrame, as_of: datetime, days: int = 30, limit: int | None = None) -> DataFrame:
    """SEC-1: successful GRANT/REVOKE statements that touch privileged roles."""
    q = queries.filter(lookback("start_time", as_of, max(1, days)) & F.col("query_type").isin("GRANT", "REVOKE")
                       & (F.col("execution_status") == "SUCCESS") & _ilike_any(F.col("query_text"), ESCALATION_TERMS))
    return (q.select("query_id", "query_type", F.col("user_name").alias("granted_by"), F.col("role_name").alias("granting_role"),
                     "start_time", F.substring("query_text", 1, 500).alias("grant_statement"), "execution_status")
            .transform(page(limit, F.desc("start_time"), "query_id")))


def failed_logins(logins: DataFrame, as_of: datetime, days: int = 7, limit: int | None = None) -> DataFrame:
    """SEC-2: failed logins with the user's failure count that day. The
    per-(user, day) count is an aggregate joined back, not a window."""
    f = logins.filter(lookback("event_timestamp", as_of, max(1, days)) & (F.col("is_success") == "NO"))
    daily = f.groupBy("user_name", F.to_date("event_timestamp").alias("_d")).agg(F.count(F.lit(1)).alias("daily_failures"))
    return (f.withColumn("_d", F.to_date("event_timestamp")).join(daily, ["user_name", "_d"])
            .select("event_id", "user_name", "client_ip", "reported_client_type", "error_code", "event_timestamp",
                    "daily_failures")
            .transform(page(limit, F.desc("event_timestamp"), "event_id")))


def dormant_users(users: DataFrame, logins: DataFrame, as_of: datetime, days: int = 90) -> DataFrame:
    """SEC-3: enabled users with no successful login within ``days``."""
    days = max(30, int(days or 90))
    last = (logins.filter((F.col("is_success") == "YES") & lookback("event_timestamp", as_of, days * 2))
            .groupBy("user_name").agg(F.max("event_timestamp").alias("last_login")))
    u = users.select(F.col("name").alias("user_name"), "created_on", "disabled")
    j = u.join(last, "user_name", "left")
    now = ts_lit(as_of)
    inactive = boundaries("DAY", F.coalesce("last_login", "created_on"), now)
    status = (F.when(F.col("last_login").isNull() & (boundaries("DAY", "created_on", now) > days), "Never Logged In")
              .when(boundaries("DAY", "last_login", now) > days, "Dormant")
              .when(F.col("disabled") == "true", "Disabled").otherwise("Active"))
    return (j.filter((F.col("last_login").isNull() | (boundaries("DAY", "last_login", now) > days))
                     & (F.col("disabled") != "true"))
            .select("user_name", "created_on", "disabled", "last_login", inactive.alias("days_inactive"),
                    status.alias("account_status")))


def sensitive_access(access: DataFrame, as_of: datetime, days: int = 7, limit: int | None = None) -> DataFrame:
    """SEC-4 / JOI-16: statements that read an object whose name marks it
    sensitive; the JSON object array is parsed with a schema and exploded."""
    a = access.filter(lookback("query_start_time", as_of, max(1, days)))
    x = a.select("query_id", "user_name", "role_name", "query_start_time", "query_type",
                 F.explode(F.from_json("direct_objects_accessed", ACCESS_SCHEMA)).alias("o"))
    return (x.filter(_ilike_any(F.col("o.objectName"), SENSITIVE_TERMS))
            .select("query_id", "user_name", "role_name", "query_start_time",
                    F.col("o.objectName").alias("accessed_object"), F.col("o.objectDomain").alias("object_type"),
                    F.size(F.col("o.columns")).alias("columns_accessed"), "query_type")
            .transform(page(limit, F.desc("query_start_time"), "query_id", "accessed_object")))


def privileged_holders(grants: DataFrame, as_of: datetime) -> DataFrame:
    """SEC-5: active grants of privileged roles with their age in days."""
    g = grants.filter(F.col("deleted_on").isNull() & F.col("role").isin(*PRIVILEGED_ROLES))
    return g.select(F.col("grantee_name").alias("user_name"), F.col("role").alias("privileged_role"), "granted_by",
                    "created_on", boundaries("DAY", "created_on", ts_lit(as_of)).alias("days_since_granted"))


def compliance_scorecard(escalations: DataFrame, failures: DataFrame, dormant: DataFrame) -> DataFrame:
    """SEC-6: penalty-based scorecard from three evidence sets, one row, with
    codes of the findings that cost the most (a caller has its own words)."""
    e = escalations.agg(F.count(F.lit(1)).alias("escalations"))
    f = failures.agg(F.count(F.lit(1)).alias("failed_logins"),
                     F.coalesce(F.max("daily_failures"), F.lit(0)).alias("max_daily_failures"))
    d = dormant.agg(F.count(F.lit(1)).alias("dormant_users"))
    j = e.crossJoin(f).crossJoin(d)
    ec, fc, dc, mx = F.col("escalations"), F.col("failed_logins"), F.col("dormant_users"), F.col("max_daily_failures")
    many, brute, stale = ec > 10, mx > 20, dc > 20
    score = (F.lit(80) - F.when(many, 20).when(ec > 0, 5).otherwise(0) - F.when(brute, 15).otherwise(0)
             - F.when(stale, 10).when(dc > 5, 5).otherwise(0))
    codes = F.concat_ws(",", F.when(many, "PRIVILEGE_ESCALATION"), F.when(brute, "BRUTE_FORCE"), F.when(stale, "DORMANT_USERS"))
    return j.select("*", F.greatest(F.lit(0), F.least(F.lit(100), score)).alias("overall_score"),
                    F.greatest(F.lit(0), 100 - ec * 5).alias("privilege_management_score"),
                    F.greatest(F.lit(0), 100 - F.least(F.lit(30), fc)).alias("login_security_score"),
                    F.greatest(F.lit(0), 100 - dc * 2).alias("access_hygiene_score"), codes.alias("finding_codes"))


def security_kpis(logins: DataFrame, grants: DataFrame, users: DataFrame, queries: DataFrame, as_of: datetime,
                  days: int = 7) -> DataFrame:
    """SEC-7 / JOI-9: one KPI row from four one-row aggregates."""
    l = (logins.filter(lookback("event_timestamp", as_of, days))
         .agg(F.count_if(F.col("is_success") == "NO").alias("failed_logins"),
              F.countDistinct(F.when(F.col("is_success") == "NO", F.col("user_name"))).alias("users_with_failures")))
    g = (grants.filter(F.col("deleted_on").isNull())
         .agg(F.count_if(F.col("role").isin(*PRIVILEGED_ROLES)).alias("privileged_grants")))
    u = users.agg(F.count_if((F.col("disabled") != "true") & (F.col("ext_authn_duo") != "true")).alias("users_without_mfa"))
    q = (queries.filter(lookback("start_time", as_of, days) & F.col("query_type").isin("GRANT", "REVOKE"))
         .agg(F.count(F.lit(1)).alias("grant_statements")))
    return l.crossJoin(g).crossJoin(u).crossJoin(q)


def _flag(c: str) -> Column:
    """A text or boolean column as a boolean; what can't be read is false."""
    return F.coalesce(F.expr(f"try_cast({c} AS boolean)"), F.lit(False))


def _live_users(users: DataFrame) -> DataFrame:
    """Users that aren't dropped, with the optional columns filled."""
    return conform(users, "users").filter(F.col("deleted_on").isNull())


def is_admin_role(c: str = "role") -> Column:
    """Roles that administer the account, by name."""
    u = F.upper(F.col(c))
    return u.isin(*ADMIN_ROLES) | u.contains("ADMIN") | u.contains("SECURITY")


def security_exceptions(logins: DataFrame, users: DataFrame, grants: DataFrame, object_grants: DataFrame, databases: DataFrame,
                        as_of: datetime, days: int = 7, limit: int | None = None) -> DataFrame:
    """SEC-8 / SET-1: five detectors as one finding list (finding_type, severity,
    entity, event_count, distinct_sources, last_seen, database_name).

    Failed logins of a user (3 or more), enabled users without MFA, users with 3
    or more new role grants, objects with 3 or more new grants or one that may be
    passed on, and databases that another account shares. Each detector is one
    partial aggregate or a filter; none joins."""
    now = [lookback(c, as_of, days) for c in ("event_timestamp", "created_on")]
    nothing, no_db = F.lit(0).cast("bigint"), F.lit(None).cast("string")

    def found(df, kind, severity, entity, events, sources, seen, db=no_db):
        return df.select(F.lit(kind).alias("finding_type"), severity.alias("severity"), entity.alias("entity"), events.alias("event_count"),
                         sources.alias("distinct_sources"), seen.alias("last_seen"), db.alias("database_name"))

    n, src = F.col("n"), F.col("sources")
    counted = [F.count(F.lit(1)).alias("n")]
    failed = (logins.filter(now[0] & (F.col("is_success") == "NO")).groupBy("user_name")
              .agg(*counted, F.countDistinct("client_ip").alias("sources"), F.max("event_timestamp").alias("seen")).filter(n >= 3))
    gaps = _live_users(users).filter(~_flag("disabled") & ~_flag("ext_authn_duo"))
    recent = (grants.filter(F.col("deleted_on").isNull() & now[1]).groupBy("grantee_name")
              .agg(*counted, F.countDistinct("role").alias("sources"), F.max("created_on").alias("seen")).filter(n >= 3))
    may_pass = F.col("passed_on") > 0
    objects = (object_grants.filter(F.col("deleted_on").isNull() & now[1] & F.col("table_catalog").isNotNull())
               .groupBy("table_catalog", "table_schema", "name")
               .agg(*counted, F.countDistinct("grantee_name").alias("sources"), F.max("created_on").alias("seen"),
                    F.count_if(_flag("grant_option")).alias("passed_on")).filter((n >= 3) | may_pass))
    # a missing part makes the joined name NULL
    full_name = F.coalesce(F.concat("table_catalog", F.lit("."), "table_schema", F.lit("."), "name"), "table_catalog", "name")
    shared = databases.filter(F.col("deleted").isNull() & F.col("type").isin(*SHARED_DATABASES))
    out = found(failed, "Failed Login", F.when((n >= 25) | (src >= 5), "High").otherwise("Medium"), F.col("user_name"), n, src, F.col("seen"))
    for part in (found(gaps, "MFA Gap", F.lit("High"), F.col("name"), nothing + 1, nothing, F.coalesce("last_success_login", "created_on")),
                 found(recent, "Recent Grant", F.when(n >= 10, "Medium").otherwise("Low"), F.col("grantee_name"), n, src, F.col("seen")),
                 found(objects, "Object Grant", F.when((n >= 10) | may_pass, "High").otherwise("Medium"), full_name, n, src, F.col("seen"),
                       F.col("table_catalog")),
                 found(shared, "Shared Database Exposure", F.lit("Medium"), F.col("database_name"), nothing + 1, nothing, F.col("created"),
                       F.col("database_name"))):
        out = out.unionByName(part)
    return out.transform(page(limit, severity_rank("severity"), F.desc("event_count"), F.desc("last_seen"), "entity"))


def privileged_grant_review(grants: DataFrame, object_grants: DataFrame, environment: Column, as_of: datetime, days: int = 30,
                            limit: int | None = None) -> DataFrame:
    """SEC-9 / SET-1: grants to review. Administrative roles that users hold (any
    age, no database) and privileges on objects granted in the window that can
    change access or be passed on. ``environment`` labels ``database_name``."""
    now, text = ts_lit(as_of), F.lit(None).cast("string")
    role = F.upper(F.col("role"))
    held = grants.filter(F.col("deleted_on").isNull() & is_admin_role()).select(
        F.lit("Privileged Role Grant").alias("finding_type"), F.when(role.isin(*CRITICAL_ROLES), "Critical").otherwise("High").alias("severity"),
        F.col("grantee_name").alias("entity"), F.col("role").alias("role_name"), text.alias("privilege"), F.lit(False).alias("grant_option"),
        text.alias("object_name"), text.alias("database_name"), "granted_by", "created_on")
    privilege, passes = F.upper(F.col("privilege")), _flag("grant_option")
    on_objects = object_grants.filter(
        F.col("deleted_on").isNull() & lookback("created_on", as_of, max(1, min(int(days or 30), 90))) & F.col("table_catalog").isNotNull()
        & (privilege.isin(*REVIEWED_PRIVILEGES) | passes)).select(
        F.lit("Privileged Object Grant").alias("finding_type"), F.when(privilege.isin(*HIGH_PRIVILEGES) | passes, "High").otherwise("Medium").alias("severity"),
        F.col("grantee_name").alias("entity"), text.alias("role_name"), "privilege", passes.alias("grant_option"), F.col("name").alias("object_name"),
        F.col("table_catalog").alias("database_name"), "granted_by", "created_on")
    u = held.unionByName(on_objects)
    return u.select("*", F.col("database_name").isNotNull().alias("database_context"), environment.alias("environment"),
                    boundaries("DAY", "created_on", now).alias("grant_age_days")) \
        .transform(page(limit, severity_rank("severity"), F.desc("created_on"), "entity"))


def access_hygiene(users: DataFrame, logins: DataFrame, grants: DataFrame, as_of: datetime, days: int = 30,
                   limit: int | None = None) -> DataFrame:
    """SEC-10: the users that need a look: failed logins or their addresses in the
    window, administrative roles, no MFA, or not seen for 90 days, with a
    severity and the findings as text. Names meet in upper case; logins and
    grants are reduced to a row a user before the joins."""
    name = F.upper(F.col("user_name"))
    failed = F.col("is_success") == "NO"
    l = (logins.filter(lookback("event_timestamp", as_of, max(1, int(days or 30)))).groupBy(name.alias("_user"))
         .agg(F.count_if(failed).alias("_failed"), F.countDistinct(F.when(failed, F.col("client_ip"))).alias("_ips"),
              F.max(F.when(F.col("is_success") == "YES", F.col("event_timestamp"))).alias("_last")))
    g = (grants.filter(F.col("deleted_on").isNull() & is_admin_role()).groupBy(F.upper(F.col("grantee_name")).alias("_admin"))
         .agg(F.countDistinct("role").alias("_roles"), sorted_distinct_list("role").alias("_names")))
    u = _live_users(users)
    has = {c.lower() for c in users.columns}
    j = u.join(l, F.upper(F.col("name")) == F.col("_user"), "left").join(g, F.upper(F.col("name")) == F.col("_admin"), "left")
    zero = F.lit(0).cast("bigint")
    p = j.select(
        F.col("name").alias("user_name"), F.coalesce("disabled", F.lit("false")).alias("disabled"),
        F.coalesce("has_password", F.lit("false" if "has_password" in has else "unknown")).alias("has_password"),
        F.coalesce("ext_authn_duo", F.lit("unknown")).alias("mfa_signal"), F.coalesce("_last", "last_success_login", "created_on").alias("last_seen"),
        F.coalesce("_failed", zero).alias("failed_logins"), F.coalesce("_ips", zero).alias("failed_ips"),
        F.coalesce("_roles", zero).alias("admin_role_count"), F.coalesce("_names", F.lit("")).alias("admin_roles"))
    p = p.withColumn("days_since_seen", boundaries("DAY", "last_seen", ts_lit(as_of)))
    fails, ips, roles = F.col("failed_logins"), F.col("failed_ips"), F.col("admin_role_count")
    no_mfa, unknown = F.lower(F.col("mfa_signal")) != "true", F.col("mfa_signal") == "unknown"
    missing, dormant = no_mfa & ~unknown, F.coalesce(F.col("days_since_seen") >= 90, F.lit(False))
    severity = (F.when((fails >= 25) | (ips >= 5), "High").when((roles > 0) & no_mfa, "High").when(dormant, "Medium")
                .when((fails > 0) | (roles > 0) | missing, "Medium").otherwise("Low"))
    # fixed values: the texts of the findings
    findings = F.concat_ws("; ", F.when(F.col("disabled") == "true", "disabled user retained in account"),
                           F.when(fails > 0, F.concat(fails.cast("string"), F.lit(" failed login(s)"))),
                           F.when(ips >= 5, F.concat(ips.cast("string"), F.lit(" failed login source IP(s)"))),
                           F.when(roles > 0, F.concat(roles.cast("string"), F.lit(" privileged role grant(s)"))),
                           F.when(missing, "MFA signal missing"), F.when(dormant, "dormant >= 90 days"))
    out = p.filter((fails > 0) | (roles > 0) | missing | dormant).withColumn("severity", severity).withColumn("posture_findings", findings)
    return out.transform(page(limit, severity_rank("severity"), F.desc("failed_logins"), F.desc("admin_role_count"), F.desc("days_since_seen"), "user_name"))


def mfa_coverage(users: DataFrame) -> DataFrame:
    """SEC-11: enabled users and their MFA / password state."""
    return (users.filter(F.col("disabled") != "true")
            .select(F.col("name").alias("user_name"), (F.col("ext_authn_duo") == "true").alias("mfa_enabled"),
                    (F.col("has_password") == "true").alias("has_password"),
                    F.when(F.col("ext_authn_duo") == "true", "Covered")
                    .when(F.col("has_password") == "true", "Password only").otherwise("Key or SSO").alias("coverage")))


def login_audit(logins: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """SEC-12: per day, user, address and client: successes and failures."""
    return (logins.filter(lookback("event_timestamp", as_of, days))
            .groupBy(F.to_date("event_timestamp").alias("login_date"), "user_name", "client_ip",
                     "reported_client_type", "reported_client_version")
            .agg(F.count_if(F.col("is_success") == "YES").alias("success_count"),
                 F.count_if(F.col("is_success") == "NO").alias("failure_count")))


def _outcomes(fact: DataFrame) -> DataFrame:
    """The daily login fact as a row an outcome: is_success, n."""
    both = F.array(*[F.struct(F.lit(label).alias("is_success"), F.coalesce(c, F.lit(0)).cast("bigint").alias("n"))
                     for label, c in (("YES", "success_count"), ("NO", "failure_count"))])
    return fact.select("login_date", "user_name", "client_ip", F.inline(both))


def login_totals(fact: DataFrame) -> DataFrame:
    """SEC-12: per outcome the events, users and addresses; the fact is
    :func:`login_audit` or the stored daily summary. Both outcomes are there for
    any fact, an empty one too."""
    some = F.col("n") > 0
    g = _outcomes(fact).groupBy("is_success").agg(
        F.sum("n").alias("event_count"), F.countDistinct(F.when(some, F.col("user_name"))).alias("distinct_users"),
        F.countDistinct(F.when(some, F.col("client_ip"))).alias("distinct_ips"))
    labels = fact.sparkSession.createDataFrame([("YES",), ("NO",)], "is_success string")
    zero = F.lit(0).cast("bigint")
    return labels.join(g, "is_success", "left").select("is_success", *[F.coalesce(c, zero).alias(c) for c in ("event_count", "distinct_users", "distinct_ips")])


def login_trend(fact: DataFrame) -> DataFrame:
    """SEC-12: events per day and outcome."""
    return _outcomes(fact).groupBy(F.col("login_date").alias("day"), "is_success").agg(F.sum("n").alias("event_count"))


def login_failures(fact: DataFrame, limit: int | None = 50) -> DataFrame:
    """SEC-12: the most failed (user, address, client), a report of ``limit`` rows."""
    g = (fact.filter(F.coalesce("failure_count", F.lit(0)) > 0).groupBy("user_name", "client_ip", "reported_client_type")
         .agg(F.sum("failure_count").alias("attempt_count"), F.max("login_date").cast("timestamp_ntz").alias("last_attempt")))
    return g.transform(page(limit, F.desc("attempt_count"), F.desc("last_attempt"), "user_name", "client_ip", "reported_client_type"))


def _events() -> list[Column]:
    ok, bad = F.coalesce("success_count", F.lit(0)), F.coalesce("failure_count", F.lit(0))
    return [F.sum(ok + bad).alias("login_events"), F.countDistinct("user_name").alias("users")]


def login_addresses(fact: DataFrame, limit: int | None = 50) -> DataFrame:
    """SEC-12: the busiest addresses, a report of ``limit`` rows."""
    g = fact.groupBy("client_ip").agg(*_events(), F.coalesce(F.sum("success_count"), F.lit(0)).alias("success_events"),
                                      F.coalesce(F.sum("failure_count"), F.lit(0)).alias("failed_events"),
                                      F.max("login_date").cast("timestamp_ntz").alias("last_seen"))
    return g.transform(page(limit, F.desc("login_events"), "client_ip"))


def login_clients(fact: DataFrame, limit: int | None = 50) -> DataFrame:
    """SEC-12: the busiest client programs and versions, a report of ``limit`` rows."""
    named = [F.coalesce(c, F.lit("UNKNOWN")).alias(c) for c in ("reported_client_type", "reported_client_version")]
    g = fact.groupBy(*named).agg(*_events(), F.coalesce(F.sum("failure_count"), F.lit(0)).alias("failed_events"))
    return g.transform(page(limit, F.desc("login_events"), "reported_client_type", "reported_client_version"))


def connected_programs(sessions: DataFrame, logins: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """SEC-13 / JOI-15: programs per client identity. A session's client id
    is used when present; otherwise the login's client type; the source of
    the label is kept."""
    s = (sessions.filter(lookback("created_on", as_of, days))
         .select("user_name", F.to_date("created_on").alias("d"), "client_application_id", "statement_count"))
    l = (logins.filter(lookback("event_timestamp", as_of, days) & (F.col("is_success") == "YES"))
         .groupBy("user_name", F.to_date("event_timestamp").alias("d"))
         .agg(F.min("reported_client_type").alias("login_client")))
    j = s.join(l, ["user_name", "d"], "full")
    client = F.coalesce("client_application_id", "login_client")
    src = F.when(F.col("client_application_id").isNotNull(), "session").when(F.col("login_client").isNotNull(), "login") \
        .otherwise("unknown")
    return (j.groupBy(F.coalesce(client, F.lit("UNKNOWN")).alias("client"), src.alias("identity_source"))
            .agg(F.countDistinct("user_name").alias("users"), F.count(F.lit(1)).alias("user_days"),
                 F.coalesce(F.sum("statement_count"), F.lit(0)).alias("statements")))


def grant_blast_radius(grants: DataFrame, role_grants: DataFrame) -> DataFrame:
    """SEC-14: for each role, the users that hold it, the roles that inherit it
    over any chain of grants (``role_grants``: ``name`` granted to the role
    ``grantee_name``; cycles end), and the users that hold it or one of those.

    The hierarchy is walked from the roles; users meet the reached roles in one
    join, folded to distinct (role, user) before they are counted."""
    held = grants.filter(F.col("deleted_on").isNull()).select("role", "grantee_name", "created_on")
    edges = role_grants.select(F.col("name").alias("source"), F.col("grantee_name").alias("target")).where("source <> target").distinct()
    roles = held.select("role").unionByName(edges.select(F.col("source").alias("role"))).unionByName(edges.select(F.col("target").alias("role"))).distinct()
    reach = _walk(roles.select("role", F.col("role").alias("node")), edges, ["role"])
    parents = reach.where("node <> role").groupBy("role").agg(F.count(F.lit(1)).alias("inheriting_roles"))
    direct = held.groupBy("role").agg(F.countDistinct("grantee_name").alias("users"), F.min("created_on").alias("first_granted"))
    impacted = (reach.join(held.select(F.col("role").alias("node"), "grantee_name").distinct(), "node")
                .select("role", "grantee_name").distinct().groupBy("role").agg(F.count(F.lit(1)).alias("impacted_users")))
    zero = F.lit(0).cast("bigint")
    return (roles.join(direct, "role", "left").join(parents, "role", "left").join(impacted, "role", "left")
            .select("role", F.coalesce("users", zero).alias("users"), "first_granted", F.coalesce("inheriting_roles", zero).alias("inheriting_roles"),
                    F.coalesce("impacted_users", zero).alias("impacted_users")))


def role_utilisation(grants: DataFrame, queries: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """SEC-15: roles granted and whether any statement used them in the window."""
    used = (queries.filter(lookback("start_time", as_of, days)).groupBy(F.col("role_name").alias("role"))
            .agg(F.count(F.lit(1)).alias("statements"), F.max("start_time").alias("last_used")))
    roles = grants.filter(F.col("deleted_on").isNull()).groupBy("role").agg(F.countDistinct("grantee_name").alias("grantees"))
    j = roles.join(used, "role", "left")
    return j.select("role", "grantees", F.coalesce("statements", F.lit(0)).alias("statements"), "last_used",
                    F.when(F.col("statements").isNull(), "Dormant").otherwise("Active").alias("role_state"))


def long_sessions(sessions: DataFrame, as_of: datetime, min_hours: float = 8, days: int = 7) -> DataFrame:
    """SEC-16: sessions that stayed open longer than ``min_hours``."""
    dur = (F.unix_micros(F.col("last_access_time").cast("timestamp")) - F.unix_micros(F.col("created_on").cast("timestamp"))) / 3.6e9
    return (sessions.filter(lookback("created_on", as_of, days) & (dur > min_hours))
            .select("session_id", "user_name", "client_application_id", "created_on", "last_access_time",
                    rounded(dur, 2).alias("session_hours")))


# ------------------------------------------------------------------ governance

CLASS_TAGS = ["SEMANTIC_CATEGORY", "PRIVACY_CATEGORY", "PII", "SENSITIVITY"]


def classification_coverage(columns: DataFrame, tags: DataFrame, min_columns: int = 10) -> DataFrame:
    """GOV-1: classified share of columns per database (distinct names, as
    in the reference)."""
    key = ["table_catalog", "table_schema", "table_name", "column_name"]
    c = tags.filter((F.col("domain") == "COLUMN") & F.col("tag_name").isin(*CLASS_TAGS)).select(
        *key, F.col("column_name").alias("_cc")).distinct()
    j = columns.select(*key).join(c, key, "left")
    g = (j.groupBy(F.col("table_catalog").alias("database_name"))
         .agg(F.countDistinct("column_name").alias("total_columns"), F.countDistinct("_cc").alias("classified_columns")))
    return (g.filter(F.col("total_columns") > min_columns)
            .withColumn("classification_pct",
                        rounded(F.col("classified_columns") * 100.0 / F.nullif(F.col("total_columns"), F.lit(0)), 1)))


def access_history_availability(access: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """GOV-2: access-history rows and users per day."""
    return (access.filter(lookback("query_start_time", as_of, days))
            .groupBy(F.to_date("query_start_time").alias("access_date"))
            .agg(F.count(F.lit(1)).alias("access_rows"), F.countDistinct("user_name").alias("users")))


def tag_coverage(tables: DataFrame, tags: DataFrame) -> DataFrame:
    """GOV-4: per database: tables, tagged tables and the untagged list size
    (left-anti join for the untagged assets)."""
    t = tables.select(F.col("table_catalog"), F.col("table_schema"), "table_name").distinct()
    tagged = tags.select("table_catalog", "table_schema", "table_name").distinct()
    untagged = t.join(tagged, ["table_catalog", "table_schema", "table_name"], "left_anti")
    a = t.groupBy("table_catalog").agg(F.count(F.lit(1)).alias("tables"))
    b = untagged.groupBy("table_catalog").agg(F.count(F.lit(1)).alias("untagged_tables"))
    j = a.join(b, "table_catalog", "left")
    ut = F.coalesce("untagged_tables", F.lit(0))
    return j.select(F.col("table_catalog").alias("database_name"), "tables", ut.alias("untagged_tables"),
                    rounded((F.col("tables") - ut) * 100.0 / F.col("tables"), 1).alias("tag_coverage_pct"),
                    F.when((F.col("tables") - ut) * 100.0 / F.col("tables") >= 80, "Managed")
                    .when((F.col("tables") - ut) * 100.0 / F.col("tables") >= 40, "Developing").otherwise("Initial")
                    .alias("maturity"))


# Entity types by the words that name them, first match wins for the canonical type.
ENTITY_TYPES = [("COST_CONTROL", ["COST", "FINOPS", "CHARGEBACK"]), ("PROCEDURE", ["PROCEDURE", "PROC", "CALL"]), ("TASK", ["TASK"]),
                ("WAREHOUSE", ["WAREHOUSE"]), ("CHANGE_CONTROL", ["CHANGE", "DRIFT", "DDL", "IAC"]),
                ("SECURITY", ["GRANT", "ROLE", "SECURITY"]), ("ACCOUNT_HEALTH", ["ACCOUNT HEALTH", "CHECKLIST", "CONTROL ROOM"])]
# Owners that a directory owner replaces.
GENERIC_OWNERS = ["", "DBA", "DBA / FINOPS", "DBA / PLATFORM", "DBA / SECURITY", "DBA / WORKLOAD OWNER", "DBA / PIPELINE OWNER",
                  "DBA / PROCEDURE OWNER", "DBA / DATA ENGINEERING", "DATA ENGINEERING", "UNKNOWN", "UNASSIGNED", "N/A", "NONE", "NULL"]
# Scores of a type (the canonical one, a candidate) and of a pattern (equal, wildcard, part of it, everything).
TYPE_EXACT, TYPE_CANDIDATE = 85, 55
EQUAL, WILDCARD, PART, EVERYTHING = 100, 40, 20, 1
DEFAULT_OWNER = "DBA"


def _upper_text(c: str | Column) -> Column:
    return F.upper(F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))))


def _any_of(text: Column, words: list[str]) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | text.contains(w)
    return cond


def canonical_entity_type(value: Column) -> Column:
    """One type for an entity's type text; the text itself where no word fits."""
    out = F.when(F.lit(False), F.lit(""))
    for name, words in ENTITY_TYPES:
        out = out.when(_any_of(value, words), name)
    return out.when(value.contains("ALERT"), "ALERT").otherwise(value)


def entity_type_candidates(*values: Column) -> Column:
    """The rule types that an entity with these type texts may match."""
    joined = F.concat_ws(" ", *values)
    named = [F.when(_any_of(joined, words), F.lit(name)) for name, words in ENTITY_TYPES]
    return F.array_distinct(F.array_compact(F.array(
        *[F.when(v != "", v) for v in values], *named, canonical_entity_type(values[0]), F.lit("ALERT"), F.lit("GLOBAL"))))


def pattern_score(pattern: Column, value: Column) -> Column:
    """How well an upper-case directory pattern fits an upper-case value."""
    like = F.replace(F.replace(F.replace(pattern, F.lit("\\"), F.lit("\\\\")), F.lit("_"), F.lit("\\_")), F.lit("*"), F.lit("%"))
    part = F.replace(F.replace(pattern, F.lit("*"), F.lit("")), F.lit("%"), F.lit(""))
    return (F.when(value == "", 0).when(pattern.isin("*", "%"), EVERYTHING).when(pattern == value, EQUAL)
            .when(F.like(value, like), WILDCARD).when((part != "") & value.contains(part), PART).otherwise(0))


def owner_resolution(entities: DataFrame, rules: DataFrame, candidates: list[str], entity_type_col: str = "entity_type",
                     category_col: str | None = None, alert_type_col: str | None = None, owner_col: str | None = None) -> DataFrame:
    """GOV-7: the best owner rule of each entity over its candidate values (entity,
    database, warehouse, task, procedure, category, alert type, source): score =
    rule priority + type score + best pattern score; rules of a type that is
    neither a candidate type nor GLOBAL or ALERT don't apply. An owner that isn't
    generic is kept; without a rule the owner is ``DEFAULT_OWNER``.

    Entities are reduced to their distinct (types, values) first. Patterns meet
    the broadcast rule table (bounded by ``rules_frame``) on distinct values
    only, and the outcome goes back to the entities by one join."""
    types = [entity_type_col, category_col, alert_type_col]
    texts = [_upper_text(c) if c else F.lit("") for c in types]
    e = entities.select("entity_id", *[x.alias(f"_t{i}") for i, x in enumerate(texts)], _upper_text(owner_col or F.lit("")).alias("_owner"),
                        F.trim(F.coalesce(F.col(owner_col) if owner_col else F.lit(""), F.lit(""))).alias("_given"),
                        F.array_sort(F.array_distinct(F.array(*[_upper_text(c) for c in candidates]))).alias("_values"))
    key = ["_t0", "_t1", "_t2", "_values"]
    kinds = e.select(*key).distinct()
    cand = kinds.select(*key, F.explode("_values").alias("_value")).filter(F.col("_value") != "")
    r = rules.filter(F.coalesce("is_active", F.lit(True))).select(
        F.when(_upper_text("entity_type") == "", "GLOBAL").otherwise(_upper_text("entity_type")).alias("_rtype"),
        F.when(_upper_text("entity_pattern") == "", "*").otherwise(_upper_text("entity_pattern")).alias("_pat"),
        "owner_name", "entity_pattern", F.coalesce("match_priority", F.lit(0)).alias("_prio"))
    vals = cand.select("_value").distinct()
    m = vals.join(F.broadcast(r), pattern_score(F.col("_pat"), F.col("_value")) > 0) \
        .withColumn("_fit", pattern_score(F.col("_pat"), F.col("_value")))
    j = cand.join(m, "_value")
    may = entity_type_candidates(F.col("_t0"), F.col("_t1"), F.col("_t2"))
    kind_score = (F.when(F.col("_rtype") == canonical_entity_type(F.col("_t0")), TYPE_EXACT)
                  .when(F.array_contains(may, F.col("_rtype")), TYPE_CANDIDATE))
    best = (j.withColumn("_score", F.col("_prio") + kind_score + F.col("_fit")).filter(F.col("_score").isNotNull())
            .groupBy(*key).agg(F.max(F.struct(F.col("_score"), F.col("_prio"), F.col("_pat"), F.col("owner_name"),
                                              F.col("_value"))).alias("b")))
    named = e.join(best, key, "left")
    generic = F.replace(F.col("_owner"), F.lit("\\"), F.lit("/")).isin(*GENERIC_OWNERS)
    directory = F.coalesce(F.col("b.owner_name"), F.lit(DEFAULT_OWNER))
    return named.select("entity_id", F.when(generic, directory).otherwise(F.col("_given")).alias("owner_name"),
                        F.col("b._score").alias("match_score"), F.col("b._pat").alias("matched_pattern"),
                        F.col("b._value").alias("matched_value"),
                        F.when(F.col("b").isNull(), "Unrouted").otherwise("Routed").alias("route_state")).distinct()


def ai_usage_by_user(ai: DataFrame, as_of: datetime, days: int = 30, budget_credits: float = 5.0) -> DataFrame:
    """GOV-9 / AIC-1: AI credits and calls per user and interface with a
    guardrail class."""
    g = (ai.filter(lookback("start_time", as_of, days))
         .groupBy("user_name", "interface")
         .agg(F.count(F.lit(1)).alias("requests"), F.countDistinct(F.to_date("start_time")).alias("active_days"),
              F.sum("tokens").alias("tokens"), rounded(F.sum("credits_used"), 6).alias("credits")))
    cls = (F.when(F.col("credits") > budget_credits, "Over budget").when(F.col("credits") > budget_credits * 0.8, "Near budget")
           .otherwise("Within"))
    return g.withColumn("credits_per_request", rounded(safe_div("credits", "requests"), 8)).withColumn("guardrail", cls)

