"""Operator unit tests on small in-memory frames (the reference's fixtures
re-expressed as Spark DataFrames), threshold edges included."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from opslens.operators import alerts as al
from opslens.operators import chargeback as chb
from opslens.operators import cost
from opslens.operators import forecast as fc
from opslens.operators import graph as g
from opslens.operators import freshness as pip
from opslens.operators import security as sec
from opslens.sources import schemas


def _daily(spark, n):
    rows = [(date(2024, 1, 1) + timedelta(days=i), float(100 + (i % 7) * 10 + 2 * i)) for i in range(n)]
    return spark.createDataFrame(rows, "usage_date date, daily_credits double")


def test_burn_forecast_confidence_and_trend(spark):
    r30 = fc.burn_forecast(_daily(spark, 30), datetime(2024, 1, 31)).first()
    assert r30.observed_days == 30 and r30.confidence == "high"
    assert r30.burn_trend == "stable"  # +14 credits on ~180 is below 10 %
    r7 = fc.burn_forecast(_daily(spark, 7), datetime(2024, 1, 8)).first()
    assert r7.confidence == "medium" and r7.burn_trend == "stable" and r7.prior_7d_avg == 0.0
    r2 = fc.burn_forecast(_daily(spark, 2), datetime(2024, 1, 3)).first()
    assert r2.confidence == "low" and r2.burn_trend == "unknown" and r2.daily_burn_rate == 0.0


def test_burn_forecast_exhaustion(spark):
    r = fc.burn_forecast(_daily(spark, 30), datetime(2024, 1, 31), contract_remaining=1000.0, contract_total=4000.0).first()
    assert r.days_remaining == int(1000.0 / r.recent_7d_avg)
    assert r.projected_exhaustion_date == date(2024, 1, 31) + timedelta(days=r.days_remaining)
    assert r.utilization_pct == 75.0


def test_capacity_exhaustion_closed_form(spark):
    df = spark.createDataFrame([(10.0, 100.0, 200.0), (0.0, 100.0, 200.0), (10.0, 300.0, 200.0), (1.0, 10.0, 1000.0)],
                               "g double, cur double, cap double")
    w, u, _ = fc.capacity_exhaustion(F.col("g"), F.col("cur"), F.col("cap"))
    got = [(r[0], r[1]) for r in df.select(w, u).collect()]
    # 100 * 1.1^8 = 214 >= 200 -> 8 weeks; no growth -> none; already over -> 0; 1 % to 100x -> beyond 52 weeks
    assert got == [(8, "plan"), (None, "none"), (0, "immediate"), (463, "monitor")]


def test_chargeback_report_shares(spark):
    rows = [("Finance", "f@x", "Gold", "Owner Directory", "WH_1", 500.0),
            ("Ops", "o@x", "Silver", "Owner Directory", "WH_2", 250.0),
            ("Unattributed", "", "Unclassified", "Unattributed", "WH_9", 100.0)]
    by_owner = spark.createDataFrame(rows, "cost_owner string, owner_email string, service_tier string, "
                                           "attribution_source string, warehouses string, total_credits double")
    rep = {r.owner: r for r in chb.chargeback_report(by_owner).collect()}
    assert sum(r.credits for r in rep.values()) == 850.0
    assert rep["Unattributed"].unattributed_pct == round(100 / 850 * 100, 1)
    assert rep["Finance"].owner_count == 2 and rep["Finance"].cost_usd == round(500 * 3.68, 2)


def test_owner_pattern_resolution(spark):
    rules = chb.rules_frame(spark, [("WAREHOUSE", "WH_1*", "Finance", "", "Silver", 50, True),
                                    ("WAREHOUSE", "WH_10", "Exact", "", "Gold", 90, True),
                                    ("WAREHOUSE", "*", "Shared", "", "Bronze", 1, True),
                                    ("WAREHOUSE", "WH_2", "Retired", "", "Bronze", 99, False)])
    wh = spark.createDataFrame([("WH_10",), ("WH_11",), ("WH_2",)], "warehouse_name string")
    got = {r.warehouse_name: r.owner_name for r in chb.resolve_owner(wh, "warehouse_name", rules).collect()}
    assert got == {"WH_10": "Exact", "WH_11": "Finance", "WH_2": "Shared"}


def test_multi_rate_pricing_inserts_cost_after_credits(spark):
    df = spark.createDataFrame([("PIPE", 10.0), ("AI_SERVICES", 10.0), ("CONTAINER_SERVICES", 10.0), ("OTHER", 10.0)],
                               "service_type string, credits double")
    out = cost.price_credits(df, "credits", "service_type", cost.RateTable({"PIPE": 1.25}))
    assert out.columns == ["service_type", "credits", "credits_cost_usd"]
    got = {r.service_type: r.credits_cost_usd for r in out.collect()}
    # CONTAINER contains the letters AI but is not an AI service
    assert got == {"PIPE": 12.5, "AI_SERVICES": 22.0, "CONTAINER_SERVICES": 36.8, "OTHER": 36.8}


def test_compliance_scorecard_penalties(spark):
    esc = spark.range(15).select(F.lit("x").alias("query_id"))
    failed = spark.createDataFrame([("u1", 25)], "user_name string, daily_failures int")
    dormant = spark.range(25).select(F.lit("u").alias("user_name"))
    r = sec.compliance_scorecard(esc, failed, dormant).first()
    assert r.overall_score == 80 - 20 - 15 - 10
    assert r.privilege_management_score == 25 and r.access_hygiene_score == 50 and r.login_security_score == 99


def test_quality_summary_status(spark):
    fr = spark.createDataFrame([("t", "Critical")], "table_name string, freshness_status string")
    drift = spark.range(6)
    none = spark.range(0)
    assert pip.quality_summary(fr, drift, none).first().overall_status == "critical"
    fr2 = spark.createDataFrame([("t", "Fresh")], "table_name string, freshness_status string")
    assert pip.quality_summary(fr2, drift, none).first().overall_status == "warning"
    assert pip.quality_summary(fr2, spark.range(5), none).first().overall_status == "healthy"


def _task_graph(spark):
    rows = [("D", "S", "A", "started", "[]"), ("D", "S", "B", "started", '["A"]'), ("D", "S", "C", "started", '["D.S.A"]'),
            ("D", "S", "E", "suspended", '["B", "C"]'), ("D", "S", "F", "started", "not json")]
    return spark.createDataFrame(rows, "database_name string, schema_name string, task_name string, state string, "
                                       "predecessors string")


def test_task_graph_shape(spark):
    tg = _task_graph(spark)
    s = g.dag_summary(tg).first()
    assert (s.nodes, s.edges, s.roots, s.leaves, s.depth) == (5, 4, 2, 2, 2)
    b = g.blast_radius(tg, "D.S.A").first()
    assert b.downstream_count == 3 and b.blast_radius == "Medium"
    imp = {r.task_id: r for r in g.graph_impact(tg).collect()}
    assert imp["D.S.A"].downstream_task_count == 3 and imp["D.S.A"].graph_role == "Root"
    assert imp["D.S.E"].graph_role == "Leaf" and imp["D.S.B"].graph_role == "Intermediate"


def test_maintenance_suppression_global_and_entity(spark):
    alerts = spark.createDataFrame([("a1", datetime(2024, 1, 1, 1), "WH_1"), ("a2", datetime(2024, 1, 1, 1), "WH_2"),
                                    ("a3", datetime(2024, 1, 2, 1), "WH_1"), ("a4", datetime(2024, 1, 3, 1), "WH_1")],
                                   "alert_id string, created_at timestamp_ntz, entity string")
    windows = spark.createDataFrame([(datetime(2024, 1, 1), datetime(2024, 1, 1, 2), "WH_1"),
                                     (datetime(2024, 1, 2), datetime(2024, 1, 2, 2), None)],
                                    "window_start timestamp_ntz, window_end timestamp_ntz, entity string")
    kept = sorted(r.alert_id for r in al.suppress_maintenance(alerts, windows).collect())
    assert kept == ["a2", "a4"]


def test_upsert_findings_bumps_and_keeps_old_fields(spark):
    schema = ("action_id string, category string, entity string, finding string, severity string, detail string, "
              "status string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, seen_count bigint, fixed_at timestamp_ntz")
    t0 = datetime(2024, 1, 1)
    stored = spark.createDataFrame([("k1", "c", "e1", "f", "High", "old", "Open", t0, t0, 1, None),
                                    ("k2", "c", "e2", "f", "Low", "x", "Fixed", t0, t0, 2, t0)], schema)
    new = spark.createDataFrame([("k1", "c", "e1", "f", "High", ""), ("k3", "c", "e3", "f", "Medium", "n")],
                                "action_id string, category string, entity string, finding string, severity string, detail string")
    t1 = datetime(2024, 1, 8)
    out = {r.action_id: r for r in al.upsert_findings(stored, new, t1).collect()}
    assert out["k1"].seen_count == 2 and out["k1"].last_seen_at == t1 and out["k1"].detail == "old"
    assert out["k2"].seen_count == 2 and out["k2"].status == "Fixed"
    assert out["k3"].seen_count == 1 and out["k3"].first_seen_at == t1 and out["k3"].status == "Open"


def test_conform_adds_typed_nulls_and_rejects_missing_required(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00", "WH", "1.5")], "START_TIME string, Warehouse_Name string, credits_used string")
    c = schemas.conform(df, "warehouse_metering")
    assert c.columns == ["start_time", "warehouse_name", "credits_used", "credits_used_compute", "credits_used_cloud_services"]
    assert dict(c.dtypes)["credits_used_compute"] == "double" and c.first().credits_used == 1.5
    with pytest.raises(schemas.MissingColumns):
        schemas.conform(df.drop("credits_used"), "warehouse_metering")


def test_owner_rules_bounded_and_unmatched_entities_kept(spark):
    with pytest.raises(ValueError):
        chb.rules_frame(spark, [("WAREHOUSE", f"WH_{i}", "o", "", "Bronze", 1, True) for i in range(chb.MAX_RULES + 1)])
    rules = chb.rules_frame(spark, [("WAREHOUSE", "ETL_*", "Data Eng", "de@x", "Gold", 10, True)])
    wh = spark.createDataFrame([("etl_nightly",), ("BI_1",), ("BI_1",)], "warehouse_name string")
    got = {r.warehouse_name: (r.owner_name, r.match_priority)
           for r in chb.resolve_owner(wh, "warehouse_name", rules).collect()}
    assert got == {"etl_nightly": ("Data Eng", 10), "BI_1": (None, None)}


def test_blast_radius_terminates_on_cycles(spark):
    rows = [("D", "S", "A", "started", '["C"]'), ("D", "S", "B", "started", '["A"]'), ("D", "S", "C", "started", '["B"]'),
            ("D", "S", "X", "started", '["C"]')]
    tg = spark.createDataFrame(rows, "database_name string, schema_name string, task_name string, state string, "
                                     "predecessors string")
    b = g.blast_radius(tg, "D.S.A").first()
    assert b.downstream_count == 3 and b.blast_radius == "Medium"


def test_per_query_credits_split_by_execution_share(spark):
    t = datetime(2024, 1, 28, 10)  # inside the settled 7-day window [Jan 24, Jan 30)
    q = spark.createDataFrame([("q1", "WH_1", t, 1000), ("q2", "WH_1", t + timedelta(minutes=30), 3000),
                               ("q3", "WH_2", t, 500), ("q4", "WH_1", datetime(2024, 1, 30, 12), 100)],
                              "query_id string, warehouse_name string, start_time timestamp_ntz, execution_time bigint")
    m = spark.createDataFrame([(t, "WH_1", 4.5, 4.0)],
                              "start_time timestamp_ntz, warehouse_name string, credits_used double, credits_used_compute double")
    got = {r.query_id: r.metered_credits for r in cost.per_query_credits(q, m, datetime(2024, 1, 31)).collect()}
    # q4 is inside the last 24 h (not settled); q3's hour has no metering
    assert got == {"q1": 1.0, "q2": 3.0, "q3": 0.0}
