"""Platform health: baselines, deductions, grade and trend."""

import pytest

from opslens.operators import scores as sc

COLUMNS = ("name string, max_variance_pct double, has_run_rate boolean, query_failures long, failed_tasks long, severe_findings long, "
           "security_exceptions long, open_alerts long, morning_exceptions long, previous_score double")


@pytest.fixture(scope="module")
def card(spark):
    rows = [("nothing", *[None] * 9),
            ("healthy", 3.0, True, 1, 0, 0, 0, 0, 0, 60.0),
            ("failures", None, None, 100, 11, None, None, None, None, 99.0),
            ("findings", None, None, None, None, 6, 9, None, None, 77.5),
            ("alerts", 31.0, None, 6, 4, 2, 1, 21, 20, None),
            ("worst", 51.0, True, 51, 11, 100, 100, 100, 100, 0.0)]
    return {r.name: r for r in sc.platform_health(spark.createDataFrame(rows, COLUMNS)).collect()}


def test_baselines_and_grades(card):
    n = card["nothing"]
    assert (n.cost_control_score, n.reliability_score, n.security_score, n.operations_score) == (85.0, 90.0, 80.0, 85.0)
    assert n.health_score == 85.5 and n.grade == "B" and n.trend == "unknown"


def test_deductions(card):
    assert card["failures"].reliability_score == 40.0
    assert card["findings"].security_score == 30.0
    a = card["alerts"]
    assert (a.cost_control_score, a.reliability_score, a.security_score, a.operations_score) == (70.0, 75.0, 57.0, 45.0)
    w = card["worst"]
    assert (w.cost_control_score, w.reliability_score, w.security_score, w.operations_score) == (60.0, 40.0, 30.0, 45.0)
    assert w.health_score == 45.0 and w.grade == "F"


def test_trend(card):
    assert {k: card[k].trend for k in ("healthy", "failures", "findings", "worst")} == {
        "healthy": "improving", "failures": "declining", "findings": "stable", "worst": "unknown"}
