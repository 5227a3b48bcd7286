"""Access rules (SEC-6, SEC-8 to SEC-10, SEC-12) on small fixtures: limits,
missing columns, nulls and empty tables."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from opslens.functions.scope import Environments, environment_label
from opslens.operators import security as sec

NOW = datetime(2024, 1, 31)
LOGIN = "event_timestamp timestamp_ntz, user_name string, is_success string, client_ip string, reported_client_type string, reported_client_version string"
GRANT = "created_on timestamp_ntz, role string, grantee_name string, deleted_on timestamp_ntz, granted_by string"
OBJECT = ("created_on timestamp_ntz, table_catalog string, table_schema string, name string, privilege string, grant_option string, "
          "grantee_name string, granted_by string, deleted_on timestamp_ntz")
BASES = "database_name string, type string, created timestamp_ntz, deleted timestamp_ntz"
USER = ("name string, disabled string, has_password string, ext_authn_duo string, created_on timestamp_ntz, last_success_login timestamp_ntz, "
        "deleted_on timestamp_ntz")


def ago(days):
    return NOW - timedelta(days=days)


def fails(user, n, ips=1, days=1):
    return [(ago(days), user, "NO", f"10.0.0.{i % ips}", None, None) for i in range(n)]


@pytest.fixture(scope="module")
def parts(spark):
    logins = fails("two", 2) + fails("three", 3) + fails("many", 25) + fails("spread", 5, ips=5) + fails("old", 9, days=8) + fails(None, 3)
    users = [("safe", "false", "true", "true", ago(500), None, None), ("gap", "false", "true", None, ago(500), ago(3), None),
             ("off", "TRUE", "true", "false", ago(500), None, None), ("gone", "false", "true", "false", ago(500), None, ago(9)),
             ("odd", "maybe", "true", "unclear", ago(500), None, None)]
    grants = ([(ago(1), f"R{i}", "ten", None, "x") for i in range(10)] + [(ago(1), "R", "three", None, "x")] * 3
              + [(ago(1), "R", "two", None, "x")] * 2 + [(ago(1), "R", "taken", ago(0.5), "x")] * 5)
    one = (ago(1), "DB", "S", "one", "SELECT", "false", "R", "x", None)
    objects = [one, (ago(1), "DB", None, "passed", "SELECT", "true", "R", "x", None), (ago(1), None, None, "nowhere", "OWNERSHIP", "true", "R", "x", None)]
    objects += [(ago(1), "DB", "S", "three", "select", None, f"R{i}", "x", None) for i in range(3)]
    bases = [("A", "SHARE", ago(9), None), ("B", "IMPORTED DATABASE", ago(9), ago(1)), ("C", "STANDARD", ago(9), None)]
    make = spark.createDataFrame
    return make(logins, LOGIN), make(users, USER), make(grants, GRANT), make(objects, OBJECT), make(bases, BASES)


def test_exceptions_follow_their_limits(parts):
    got = {(r.finding_type, r.entity): r for r in sec.security_exceptions(*parts, NOW, 7).collect()}
    assert {k: r.severity for k, r in got.items() if k[0] == "Failed Login"} == {
        ("Failed Login", "three"): "Medium", ("Failed Login", "many"): "High", ("Failed Login", "spread"): "High", ("Failed Login", None): "Medium"}
    assert {k[1] for k in got if k[0] == "MFA Gap"} == {"gap", "odd"}
    assert got["MFA Gap", "gap"].last_seen == ago(3) and got["MFA Gap", "odd"].last_seen == ago(500)
    assert {k[1]: r.severity for k, r in got.items() if k[0] == "Recent Grant"} == {"ten": "Medium", "three": "Low"}
    # a name with a missing part falls back to its database
    assert {k[1]: r.severity for k, r in got.items() if k[0] == "Object Grant"} == {"DB": "High", "DB.S.three": "Medium"}
    assert got["Object Grant", "DB.S.three"].distinct_sources == 3
    assert {k[1] for k in got if k[0].startswith("Shared")} == {"A"}


def test_exceptions_of_nothing(spark, parts):
    assert sec.security_exceptions(*[p.limit(0) for p in parts], NOW, 7).count() == 0


def test_a_page_starts_with_the_worst(parts):
    top = sec.security_exceptions(*parts, NOW, 7, limit=1).collect()
    assert [(r.finding_type, r.entity) for r in top] == [("Failed Login", "many")]


def test_grant_review(spark, parts):
    held = spark.createDataFrame([(ago(900), "accountadmin", "a", None, "x"), (ago(9), "USERADMIN", "b", None, "x"), (ago(9), "Data_Security_Ops", "c", None, "x"),
                                  (ago(9), "READER", "d", None, "x"), (ago(9), "ORGADMIN", "e", ago(1), "x"), (ago(9), None, "f", None, "x")], GRANT)
    objects = spark.createDataFrame(
        [(ago(1), "PRD", "S", "o", "ownership", None, "R", "x", None), (ago(1), "PRD", "S", "o", "CREATE VIEW", "false", "R", "x", None),
         (ago(1), "DEV", "S", "o", "SELECT", "true", "R", "x", None), (ago(1), "DEV", "S", "o", "SELECT", "false", "R", "x", None),
         (ago(31), "DEV", "S", "o", "OWNERSHIP", "false", "R", "x", None)], OBJECT)
    got = sec.privileged_grant_review(held, objects, environment_label(Environments(prod=["PRD"], dev=["DEV"])), NOW, 30).collect()
    assert {(r.entity, r.severity, r.environment, r.grant_age_days) for r in got if not r.database_context} == {
        ("a", "Critical", "No Database Context", 900), ("b", "High", "No Database Context", 9), ("c", "High", "No Database Context", 9)}
    assert sorted((r.privilege, r.severity, r.environment, r.grant_option) for r in got if r.database_context) == [
        ("CREATE VIEW", "Medium", "PROD", False), ("SELECT", "High", "DEV", True), ("ownership", "High", "PROD", False)]


def test_hygiene_findings(spark):
    users = spark.createDataFrame([("Ann", "true", "true", "true", ago(5), None, None), ("bob", "false", "true", None, ago(5), None, None),
                                   ("cy", "false", None, "false", ago(200), None, None), ("di", "false", "true", "true", ago(5), None, None),
                                   ("ed", "false", "true", "true", ago(5), None, ago(1))], USER)
    logins = spark.createDataFrame(fails("ANN", 2) + fails("ann", 1) + [(ago(2), "di", "YES", "1", None, None)], LOGIN)
    grants = spark.createDataFrame([(ago(9), "SYSADMIN", "BOB", None, "x"), (ago(9), "ACCOUNTADMIN", "bob", None, "x")], GRANT)
    got = {r.user_name: r for r in sec.access_hygiene(users, logins, grants, NOW, 30).collect()}
    assert set(got) == {"Ann", "bob", "cy"}
    # spellings of one name are one user
    assert got["Ann"].failed_logins == 3 and got["Ann"].posture_findings == "disabled user retained in account; 3 failed login(s)"
    assert got["bob"].severity == "High" and got["bob"].admin_roles == "ACCOUNTADMIN, SYSADMIN" and got["bob"].mfa_signal == "unknown"
    assert got["cy"].posture_findings == "MFA signal missing; dormant >= 90 days" and got["cy"].has_password == "false"


def test_hygiene_without_optional_columns(spark):
    users = spark.createDataFrame([("a", "false", ago(100))], "name string, disabled string, created_on timestamp_ntz")
    r = sec.access_hygiene(users, spark.createDataFrame([], LOGIN), spark.createDataFrame([], GRANT), NOW).first()
    assert (r.has_password, r.mfa_signal, r.severity, r.posture_findings) == ("unknown", "unknown", "Medium", "dormant >= 90 days")


def test_login_reports(spark):
    rows = fails("a", 3, ips=2) + [(ago(1), "a", "YES", "10.0.0.0", "JDBC", "1"), (ago(2), "b", "YES", None, None, None)]
    fact = sec.login_audit(spark.createDataFrame(rows, LOGIN), NOW, 7)
    assert {r.is_success: tuple(r)[1:] for r in sec.login_totals(fact).collect()} == {"YES": (2, 2, 1), "NO": (3, 1, 2)}
    assert {(r.day.day, r.is_success): r.event_count for r in sec.login_trend(fact).collect()} == {
        (30, "YES"): 1, (30, "NO"): 3, (29, "YES"): 1, (29, "NO"): 0}
    assert [r.attempt_count for r in sec.login_failures(fact).collect()] == [2, 1]
    assert sorted((r.client_ip or "", r.login_events, r.failed_events) for r in sec.login_addresses(fact).collect()) == [
        ("", 1, 0), ("10.0.0.0", 3, 2), ("10.0.0.1", 1, 1)]
    assert sorted(r.reported_client_type for r in sec.login_clients(fact).collect()) == ["JDBC", "UNKNOWN"]
    empty = fact.limit(0)
    assert {tuple(r) for r in sec.login_totals(empty).collect()} == {("YES", 0, 0, 0), ("NO", 0, 0, 0)}
    assert sec.login_trend(empty).count() == 0 and sec.login_failures(empty).count() == 0


def test_scorecard_names_its_findings(spark):
    rows = lambda n: spark.range(n).select(F.lit("u").alias("user_name"))
    failed = spark.createDataFrame([("u", 21)], "user_name string, daily_failures int")
    assert sec.compliance_scorecard(rows(11), failed, rows(21)).first().finding_codes == "PRIVILEGE_ESCALATION,BRUTE_FORCE,DORMANT_USERS"
    quiet = sec.compliance_scorecard(rows(0), failed.limit(0), rows(0)).first()
    assert quiet.finding_codes == "" and quiet.overall_score == 80
