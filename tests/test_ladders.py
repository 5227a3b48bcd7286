"""Classification ladders at their threshold edges (the reference's pure-function tests)."""

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from opslens.operators import capacity as cap
from opslens.operators import change as chg
from opslens.operators import cost
from opslens.operators import forecast as fc
from opslens.operators import tasks as tsk


def _one(spark, expr, schema, rows):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_sla_status_bands(spark):
    got = _one(spark, tsk.sla_status(F.col("p")), "p double", [(None,), (99.0,), (95.0,), (94.9,), (90.0,), (80.0,), (79.9,)])
    assert got == ["No Data", "Excellent", "Good", "Acceptable", "Acceptable", "At Risk", "Critical"]


def test_failure_category_first_match_wins(spark):
    rows = [("Insufficient privileges; object does not exist",), ("Object does not exist",), ("Numeric value 'x' is not recognized",),
            ("SQL compilation error",), ("Statement timeout on warehouse",), ("Deadlock detected",), ("boom",), (None,)]
    got = _one(spark, tsk.failure_category(F.col("t")), "t string", rows)
    assert got == ["Privilege / RBAC", "Object Dependency / Drift", "Data Quality / Type Conversion", "SQL / Procedure Code",
                   "Warehouse / Runtime Capacity", "Concurrency / Locking", tsk.UNCLASSIFIED, tsk.UNCLASSIFIED]


def test_error_signature_masks_ids_and_whitespace(spark):
    got = _one(spark, tsk.error_signature(F.col("t")), "t string",
               [("  query  01a2b3c4d5e6 failed\n\tnow ",), ("",), (None,)])
    assert got == ["query <id> failed now", "No error text", "No error text"]


def test_change_family_precedence(spark):
    rows = [("DROP ROLE r",), ("ALTER TABLE t SET TAG x = 'y'",), ("GRANT OWNERSHIP ON TABLE t TO ROLE r",),
            ("grant select on table t to role r",), ("CREATE ROLE r",), ("create table t (id int)",), ("SELECT 1",)]
    got = _one(spark, chg.change_family(F.col("t")), "t string", rows)
    assert got == ["DESTRUCTIVE", "POLICY", "OWNER", "ACCESS", "ACCESS", "OBJECT", "OTHER"]


def test_service_category_and_ai_token(spark):
    rows = [("AI_SERVICES",), ("SNOWPARK_CONTAINER_SERVICES",), ("WAREHOUSE_METERING",), ("STORAGE",), ("DATA_TRANSFER",), ("x",), (None,)]
    got = _one(spark, cost.service_category(F.col("s")), "s string", rows)
    assert got == ["AI Services", "Serverless / Managed Compute", "Warehouse", "Storage", "Data Transfer / Network", "Other", "Other"]


def test_size_recommendation_ladder(spark):
    schema = ("warehouse_name string, avg_queue_sec double, peak_queue_sec double, total_remote_spill_gb double, "
              "peak_hourly_credits double, avg_hourly_credits double")
    rows = [("multi", 1.0, 30.0, 0.0, 2.0, 1.0),   # peak queue > 5x threshold, no spill -> concurrency
            ("up", 6.0, 16.0, 2.0, 2.0, 1.0),      # three signals
            ("down", 0.1, 0.1, 0.0, 1.2, 1.0),     # quiet and steady
            ("keep", 0.1, 0.1, 0.0, 3.0, 1.0)]     # quiet but spiky
    out = {r.warehouse_name: (r.recommendation, r.confidence)
           for r in cap.size_recommendation(spark.createDataFrame(rows, schema)).collect()}
    assert out == {"multi": ("consider_multi_cluster", "high"), "up": ("upsize", "high"),
                   "down": ("downsize", "medium"), "keep": ("maintain", "high")}


def test_burn_label_tolerance(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (1.16, 1.0), (1.15, 1.0), (0.84, 1.0)], "s double, l double")
    got = [r[0] for r in df.select(fc.burn_label(F.col("s"), F.col("l"))).collect()]
    assert got == ["No data", "Accelerating", "Accelerating", "Stable", "Cooling"]


def test_wow_delta_direction(spark):
    def series(prior, recent):
        vals = [prior] * 7 + [recent] * 7
        return spark.createDataFrame([(date(2024, 1, 1) + timedelta(days=i), float(v)) for i, v in enumerate(vals)],
                                     "usage_date date, daily_credits double")
    assert fc.wow_delta(series(100, 106)).first().direction == "up"
    assert fc.wow_delta(series(100, 105)).first().direction == "flat"
    assert fc.wow_delta(series(100, 94)).first().direction == "down"
    short = spark.createDataFrame([(date(2024, 1, i + 1), 1.0) for i in range(7)], "usage_date date, daily_credits double")
    assert fc.wow_delta(short).first().direction == "flat"


def test_trend_class(spark):
    def series(vals):
        return spark.createDataFrame([(date(2024, 1, 1) + timedelta(days=i), float(v)) for i, v in enumerate(vals)],
                                     "usage_date date, daily_credits double")
    assert fc.trend_class(series([1, 1, 2, 2, 3, 3])).first().trend_class == "accelerating"
    assert fc.trend_class(series([3, 3, 2, 2, 1, 1])).first().trend_class == "decelerating"
    assert fc.trend_class(series([1, 1, 5, 5, 1, 1])).first().trend_class == "volatile"
    assert fc.trend_class(series([1, 2, 3])).first().trend_class == "insufficient"


def test_month_end_projection_flat_and_growth(spark):
    rows = [(datetime(2024, 1, d), "WH", float(10 + d)) for d in range(1, 11)]
    m = spark.createDataFrame(rows, "start_time timestamp_ntz, warehouse_name string, credits_used double")
    r = fc.month_end_projection(m, datetime(2024, 1, 11)).first()
    consumed = sum(10 + d for d in range(1, 11))
    recent = sum(10 + d for d in range(4, 11)) / 7
    assert r.days_remaining == 20 and r.days_observed == 10
    assert r.flat_projection_credits == round(consumed + recent * 20, 1)
    g = ((sum([18, 19, 20]) / 3 - sum([11, 12, 13]) / 3) / (sum([11, 12, 13]) / 3)) / 7
    trend = consumed + sum(recent * (1 + g) ** k for k in range(1, 21))
    assert abs(r.trend_projection_credits - round(trend, 1)) <= 0.1
    assert r.confidence == "medium"
