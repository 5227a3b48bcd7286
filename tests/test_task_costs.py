"""Signals, credits and releases of task and procedure runs, at their limits."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from opslens.operators import task_costs as tc

NOW = datetime(2024, 1, 31)
TASKS = ("database_name string, schema_name string, name string, query_id string, scheduled_time timestamp_ntz, completed_time timestamp_ntz, "
         "state string, error_code string, error_message string")
STATEMENTS = "query_id string, start_time timestamp_ntz, total_elapsed_time bigint, warehouse_size string, credits_used_cloud_services double, query_text string"
INVENTORY = "database_name string, schema_name string, task_name string, state string, predecessors string, warehouse_name string, definition string"
IMPACT = "label string, downstream_task_count bigint, graph_role string, blast_radius string, retry_scope string"
QUERIES = ("query_id string, root_query_id string, query_type string, query_text string, database_name string, schema_name string, user_name string, "
           "role_name string, warehouse_name string, warehouse_size string, start_time timestamp_ntz, total_elapsed_time bigint, "
           "credits_used_cloud_services double, execution_status string")


def run(name, n, sec, state="SUCCEEDED", error=None, qid=True, code=None):
    at = NOW - timedelta(hours=n)
    return ("D", "S", name, f"{name}-{n}" if qid else None, at, None if sec is None else at + timedelta(seconds=sec), state, code, error)


def frames(spark, runs, statements=(), inventory=(), impact=()):
    return (spark.createDataFrame(runs, TASKS), spark.createDataFrame(list(statements), STATEMENTS),
            spark.createDataFrame(list(inventory), INVENTORY), spark.createDataFrame(list(impact), IMPACT))


def test_signals_of_the_latest_run(spark):
    runs = [run("long", 9, 100), run("long", 8, 100), run("long", 1, 800)]           # mean 333.3, over 2 x
    runs += [run("edge", 9, 100), run("edge", 1, 300)]                               # 1.5 x its mean, not above 300 s
    runs += [run("text", 1, 10, "SUCCEEDED", "oops"), run("word", 1, 10, "SUCCEEDED", " none ")]
    runs += [run("open", 9, 10, "FAILED"), run("open", 1, 10, "CANCELLED")]
    runs += [run("late", 9, 10, "FAILED"), run("late", 1, 10)] + [run("fine", 3, 10, "failed"), run("fine", 1, 10)]
    runs += [run("dear", 9, 10), run("dear", 8, 10), run("dear", 1, 10), run("nul", 1, None, None, qid=False), run("nul", 2, 5, qid=False)]
    at = NOW - timedelta(hours=1)
    stm = [("dear-1", at, 36_000, " x-small ", 0.05, 'MERGE INTO "D".T USING S2'), ("dear-1", at, 1, None, None, None), ("dear-8", at - timedelta(hours=7), 0, "Large", None, ""),
           (None, at, 99_999_999, "Large", 1.0, "x")]
    inv = [("D", "S", "dear", "started", "[]", "W", "CALL D.S.P(1); INSERT INTO T9 SELECT 1"), ("D", "S", "rest", "suspended", '["D.S.dear"]', None, None),
           ("D", "S", "lone", "SUSPENDED", None, "W", "")]
    imp = [("late", 3, "Intermediate", "Medium", "Targeted task retry"), ("open", 2, "Root", "Medium", "Root graph retry"),
           ("rest", 0, "Leaf", "Local", "Targeted task retry"), ("lone", 0, "Root", "Local", "Root graph retry")]
    rows = tc.run_exceptions(*frames(spark, runs, stm, inv, imp), NOW, 2).collect()
    got = {(r.task_name, r.signal): r for r in rows}
    assert len(got) == len(rows)
    assert {k: (r.severity, r.incident_priority[:2]) for k, r in got.items()} == {
        ("long", tc.SLOW): ("High", "P3"), ("text", tc.FAILED): ("High", "P2"), ("open", tc.OPEN): ("High", "P2"), ("late", tc.LATE): ("High", "P2"),
        ("dear", tc.COST): ("High", "P3"), ("rest", tc.SUSPENDED): ("Medium", "P4"), ("lone", tc.SUSPENDED): ("Medium", "P2")}
    long, dear = got["long", tc.SLOW], got["dear", tc.COST]
    assert (long.duration_sec, long.avg_duration_sec, long.duration_change_pct, long.blast_radius) == (800.0, 333.3, 140.0, "Unknown")
    assert (dear.est_total_credits, dear.avg_est_credits, dear.cost_change_pct) == (0.06, 0.02, 200.0)
    assert dear.impact_objects == "T9, D.S.P, S2, D.T" and dear.procedure_name == "D.S.P" and got["rest", tc.SUSPENDED].root_task_name == "dear"
    assert got["late", tc.LATE].duration_sec == 0.0 and got["late", tc.LATE].recovery_state == "Recovered Late"
    assert tc.run_exceptions(*frames(spark, []), NOW).count() == 0


def test_many_runs_without_an_id_meet_no_statement(spark):
    runs = [run("n", h, 10, qid=False) for h in range(1, 40)]
    t, s, _, _ = frames(spark, runs, [(None, NOW - timedelta(hours=5), 3_600_000, "Large", 9.0, "x")])
    got = tc.costed_runs(t, s, NOW - timedelta(days=3), NOW)
    assert got.count() == 39 and got.where("est_total_credits <> 0").count() == 0


def test_critical_path_states(spark):
    inv = [("D", "S", "a", "started", "[]", f"W{i}", "CALL P1()") for i in range(1)]
    inv += [("D", "S", f"a{i}", "started", '["D.S.a"]', f"W{i}", f"call P{i}()") for i in range(1, 8)]
    inv += [("D", "S", "b", "started", "null", "", None), ("D", "S", "c", "Suspended", " ", None, None), ("D", "S", "d", "started", "[]", "W", None)]
    imp = [("a", 7, "Root", "High", "x"), ("a", 1, "Root", "High", "x"), ("d", 3, "Root", "Medium", "x")]
    runs = [run("a", 1, 60_000), run("a3", 2, 30, "FAILED"), run("b", 3, 899), run("b", 4, None, "SKIPPED"), run("zz", 1, 10), run("a", 30, 10, "FAILED")]
    t, _, i, m = frames(spark, runs, (), inv, imp)
    got = {r.root_task_name: r for r in tc.critical_paths(t, i, m, NOW, 1).collect()}
    assert set(got) == {"a", "b", "c", "d"}
    a = got["a"]
    assert (a.task_count, a.runs, a.failures, a.successes, a.critical_path_score, a.critical_path_state) == (8, 2, 1, 1, 12 + 35 + 20.0, "Incident Path")
    assert a.warehouses == "W0, W1, W2, W3, W4" and a.procedures == "P1, P2, P3, P4, P5" and a.blast_radius == "High"
    assert (got["b"].critical_path_state, got["b"].critical_path_score, got["b"].runs) == ("Stable Path", 3.0, 2)
    assert (got["c"].critical_path_state, got["c"].critical_path_score, got["c"].last_run_at) == ("Incident Path", 10.0, None)
    assert got["d"].critical_path_state == "Watch Path"
    assert tc.critical_paths(t.limit(0), i.limit(0), m.limit(0), NOW).count() == 0


def call(qid, hours, sec, text='call "db".sch.p(1)', db=None, size="Small", root=None, kind="CALL", cloud=0.0, status="SUCCESS"):
    return (qid, root, kind, text, db, "", "u", "r", "w", size, NOW - timedelta(hours=hours), None if sec is None else int(sec * 1000), cloud, status)


def test_procedures(spark):
    rows = [call("1", 9, 100), call("2", 8, 100), call("3", 1, 50)]
    rows += [call(f"3{i}", 1, 100, "x", root="3", kind="SELECT", size="X-Small", cloud=0.01, status="FAIL" if i else "SUCCESS") for i in range(4)]
    rows += [call("7", 2, None, "CALL other()", db="DB"), call("8", 2, 10, None), call("9", 2, 10, "s", root="nowhere", kind="SELECT"), call(None, 2, 10)]
    runs = tc.procedure_runs(spark.createDataFrame(rows, QUERIES), NOW, 2)
    got = {r.root_query_id: r for r in runs.collect()}
    assert set(got) == {"1", "2", "3", "7", "8"}
    r = got["3"]
    assert (r.downstream_query_count, r.total_elapsed_sec, r.warehouse_size, r.cloud_credits, r.failed) == (5, 450.0, "X-Small", 0.04, True)
    assert r.est_total_credits == round(450 / 3600 + 0.04, 6) and got["7"].total_elapsed_sec == 0.0 and got["1"].est_total_credits == round(200 / 3600, 6)
    ex = {e.signal: e for e in tc.procedure_exceptions(runs).collect()}
    assert set(ex) == {tc.PROC_SLOW, tc.PROC_COST} and ex[tc.PROC_SLOW].procedure_key == "DB.SCH.P" and ex[tc.PROC_SLOW].runtime_change_pct == 107.7
    assert ex[tc.PROC_SLOW].severity == "High" and ex[tc.PROC_SLOW].root_query_id == "3"
    assert tuple(tc.procedure_summary(runs).first()) == (5, 3, 1, 1)
    assert tuple(tc.procedure_summary(runs.limit(0)).first()) == (0, 0, 0, 0)


def test_names_ending_in_digits_stay_whole(spark):
    rows = [call("1", 9, 10, "CALL A0.B1.C2(1)"), call("2", 8, 1000, "CALL A0.B1.C2 (1)")]
    key = tc.procedure_exceptions(tc.procedure_runs(spark.createDataFrame(rows, QUERIES), NOW, 2)).first().procedure_key
    assert key == "A0.B1.C2"


def test_release_signals(spark):
    at = NOW - timedelta(hours=10)
    runs = [("same", h, 100, 1.0, False) for h in (1, 15)] + [("new", 1, 5, 0.0, False)] + [("gone", 15, 5, 1.0, True)]
    runs += [("slow", 15, 100, 0.0, False), ("slow", 1, 130, 0.0, False), ("brief", 15, 10, 0.0, False), ("brief", 1, 39, 0.0, False)]
    runs += [("fail", 1, 0, 0.0, True), ("dear", 15, 1, 4.0, False), ("dear", 1, 1, 5.0, False), ("at", 10, 60, 0.0, False)]
    df = spark.createDataFrame([(n, NOW - timedelta(hours=h), s, c, f) for n, h, s, c, f in runs],
                               "e string, t timestamp_ntz, duration_sec bigint, est_total_credits double, failed boolean")
    got = {r.e: r for r in tc.compare_release(df, ["e"], "t", at).collect()}
    assert {k: (r.severity, r.signal) for k, r in got.items()} == {
        "same": ("Stable", ""), "new": ("Stable", ""), "gone": ("Stable", ""), "slow": ("Medium", "runtime +30.0%"), "brief": ("Stable", ""),
        "fail": ("High", "1 more failures"), "dear": ("Medium", "credits +25.0%"), "at": ("High", "runtime +100.0%")}
    assert got["at"].runs_after == 1 and got["new"].avg_sec_change_pct == 100.0 and got["gone"].failures_delta == -1


def test_a_run_with_an_error_code_fails_a_release(spark):
    runs = [run("t", 15, 10), run("t", 1, 10, code="E1"), run("t", 2, 10, error="text")]
    t, s, _, _ = frames(spark, runs)
    r = tc.task_release_comparison(t, s, NOW - timedelta(hours=10), 1).first()
    assert (r.failures_before, r.failures_after, r.severity) == (0, 1, "High")


def test_object_names(spark):
    df = spark.createDataFrame([('select * from a join "B".c using (x) where y in (select 1 from a)',), (None,), ("",), ("insert into table t",),
                                (" ".join(f"from t{i}" for i in range(20)),)], "q string")
    got = [r.n for r in df.select(tc.object_names(F.col("q")).alias("n")).collect()]
    assert got[:4] == [["a", "B.c"], [], [], []] and got[4] == [f"t{i}" for i in range(12)]
