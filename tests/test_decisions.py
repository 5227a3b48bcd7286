"""Decisions of CAP-14 and CAP-16 at their limits, and the history search."""

from datetime import datetime, timedelta

import pytest

from opslens.operators import capacity as cap
from opslens.operators import query as qry

NOW = datetime(2024, 1, 31)
GB = 1024 ** 3
COLS = ("start_time timestamp_ntz, database_name string, warehouse_name string, user_name string, role_name string, error_code string, execution_status string, "
        "total_elapsed_time bigint, queued_overload_time bigint, bytes_spilled_to_remote_storage bigint, bytes_scanned bigint, "
        "percentage_scanned_from_cache double, query_hash string, query_text string, query_id string, query_type string")


def row(db, wh, queued=0, spill=0, failed=False, scanned=0, cache=0.0, family="f", text="t", hours=1):
    return (NOW - timedelta(hours=hours), db, wh, "u", "r", "E" if failed else None, "FAIL" if failed else "SUCCESS", 1000, queued, spill, scanned,
            cache, family, text, "q", "SELECT")


def test_isolation_ladder(spark):
    rows = [row("calm", "W1"), row("queued", "W2", queued=61_000), row("jam", "W3", queued=301_000), row("bad", "W4", failed=True), row(None, "W5"), row("x", None)]
    rows += [row("wide", f"V{i}") for i in range(3)]                                   # one database over three warehouses
    rows += [row(f"d{i}", "SHARED", spill=2 * GB if i == 0 else 0) for i in range(4)]  # four databases, one spills
    rows += [row(f"e{i}", "FIVE", failed=i == 0) for i in range(5) for _ in range(10)]  # five databases, ten failures
    got = {(r.database_name, r.warehouse_name): r for r in cap.isolation_decisions(spark.createDataFrame(rows, COLS), NOW, 30).collect()}
    decision = {k: (r.severity, r.isolation_decision) for k, r in got.items()}
    assert decision["calm", "W1"] == ("Low", "Keep") and got["calm", "W1"].finding == "No material isolation signal"
    assert decision["queued", "W2"] == ("Medium", "Tune") and decision["jam", "W3"] == ("High", "Isolate") and decision["bad", "W4"] == ("Medium", "Tune")
    assert decision["wide", "V0"] == ("Medium", "Standardize") and got["wide", "V0"].database_warehouses == 3
    assert decision["d0", "SHARED"] == ("High", "Isolate") and decision["d1", "SHARED"] == ("Low", "Keep")
    assert decision["e0", "FIVE"] == ("High", "Isolate") and got["e0", "FIVE"].finding == "warehouse serves many databases, query failures"
    assert not any(None in k for k in got)
    assert cap.isolation_decisions(spark.createDataFrame([], COLS), NOW).count() == 0


def test_cache_ladder(spark):
    same = lambda wh, **k: [row("D", wh, scanned=GB, **k) for _ in range(4)]
    rows = same("SHORT") + same("LONG") + same("NONE") + same("WARM", cache=20.0) + [row("D", "HEAVY", scanned=101 * GB)] + [row(None, "N", scanned=1)]
    rows += [row("D", "TEXT", scanned=1, family=None, text=f"t{i}") for i in range(4)] + [row("D", "IDLE", scanned=0), row("D", "NULLS", scanned=5, cache=None)]
    wh = spark.createDataFrame([("SHORT", 60), ("LONG", 61), ("NONE", 0), ("WARM", 60)], "warehouse_name string, auto_suspend bigint")
    got = {r.warehouse_name: r for r in cap.cache_decisions(spark.createDataFrame(rows, COLS), wh, NOW, 7).collect()}
    assert {k: r.cache_decision for k, r in got.items()} == {
        "SHORT": "Cache-hostile suspend", "LONG": "Poor cache reuse", "NONE": "Poor cache reuse", "WARM": "Cache acceptable",
        "HEAVY": "Scan-heavy no-cache workload", "N": "Cache acceptable", "TEXT": "Cache acceptable", "NULLS": "Cache acceptable"}
    assert got["N"].top_database == "NO_DATABASE" and got["TEXT"].query_families == 4 and got["SHORT"].repeat_ratio_pct == 75.0


def test_search_modes(spark):
    texts = ["Select 100% of it", "select 1000 of it", "x select 100% of it", None]
    rows = [(*row("D", "W", text=t)[:-2], f"01a2-0000-0000-{i}", "SELECT") for i, t in enumerate(texts)]
    q = spark.createDataFrame(rows, COLS)
    ids = lambda *a: sorted(r.query_id[-1] for r in qry.search_history(q, NOW, *a).collect())
    assert ids("SELECT 100%", "prefix") == ["0"] and ids("select 100%", "contains") == ["0", "2"]
    assert ids("01a2-0000-0000-1", "auto") == ["1"] and ids("100% of it", "auto") == ["0", "2"]
    for term, mode in (("ab", "prefix"), ("abcde", "contains"), ("", "id"), ("abcdef", "fuzzy")):
        with pytest.raises(ValueError):
            qry.search_history(q, NOW, term, mode)
